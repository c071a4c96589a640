"""Readers: JSON lines, polymorphic JSON, globs, marked-up text, delimited messages, nested JSON."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: schema of a narrative case.
CASE = "case_id string, description string, user string, expected_conditions array<string>, expected_loincs array<string>, expected_rxnorms array<string>, system string, source_url string, case_dt string, encounter_id string, eicr_version string, patient struct<given:string,family:string,dob:string>"


def jsonl(spark: SparkSession, paths: str | list[str], schema: str | T.StructType = CASE) -> DataFrame:
    """JSON lines; blank lines are skipped, fields that a row lacks are null; paths may hold globs."""
    return spark.read.schema(schema).json(paths)


def jsonl_strict(spark: SparkSession, paths: str | list[str], schema: str = CASE) -> DataFrame:
    """Like ``jsonl``, but the query fails at the first line that is not JSON, naming file and line."""
    lines = spark.read.text(paths).select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("n"), "value").where("trim(value) <> ''")
    parsed = lines.withColumn("row", F.from_json("value", schema, {"mode": "PERMISSIVE"})).withColumn("valid", F.try_parse_json("value").isNotNull())
    fault = F.raise_error(F.concat_ws(": ", "file", F.substring("value", 1, 80)))
    return parsed.where(F.when(F.col("valid"), F.lit(True)).otherwise(fault.cast("boolean"))).select("row.*")


def json_any(spark: SparkSession, paths: str | list[str], schema: str = CASE) -> DataFrame:
    """S3: a JSON array, an object with ``rows`` or ``cases``, or JSON lines, in any mix of files; anything else gives no row."""
    files = spark.read.option("wholetext", True).text(paths)
    many = f"array<struct<{_inner(schema)}>>"
    whole = F.col("value")
    holder = F.from_json(whole, f"struct<rows:{many},cases:{many}>")
    is_array, is_object = F.ltrim(whole).startswith("["), F.ltrim(whole).startswith("{")
    lines = F.transform(F.filter(F.split(whole, "\r?\n"), lambda x: F.trim(x) != ""), lambda x: F.from_json(x, f"struct<{_inner(schema)}>"))
    rows = F.when(is_array, F.from_json(whole, many)).when(is_object, F.coalesce(holder["rows"], holder["cases"], lines)).otherwise(lines)
    return files.select(F.explode(rows).alias("row")).where("row is not null").select("row.*")


def _inner(schema: str) -> str:
    fields = T._parse_datatype_string(schema)
    return fields.simpleString()[len("struct<") : -1]


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Manifest rows with ``bundle_path`` made absolute against the manifest's folder, joined with the files' text."""
    folder = path.rsplit("/", 1)[0]
    rows = spark.read.option("multiLine", True).schema("case_id string, patient_hash string, case_dt string, bundle_path string").json(path)
    rows = rows.withColumn("bundle_path", F.when(F.col("bundle_path").rlike("^([a-z0-9]+:)?/"), F.col("bundle_path")).otherwise(F.concat(F.lit(folder + "/"), "bundle_path")))
    plain = lambda c: F.regexp_replace(c, "^file:/+", "/")
    files = spark.read.option("wholetext", True).text(f"{folder}/*.json").select(plain(F.col("_metadata.file_path")).alias("p"), F.col("value").alias("bundle"))
    return rows.join(files, plain(F.col("bundle_path")) == F.col("p"), "left").drop("p")


def experiments(spark: SparkSession, text: str) -> DataFrame:
    """A flat YAML list of mappings (``- key: value`` blocks) as rows of strings."""
    rows: list[dict[str, str]] = []
    for line in text.splitlines():
        body = line.split(" #")[0].rstrip()
        if body.lstrip().startswith("- "):
            rows.append({})
            body = body.lstrip()[2:]
        if rows and ":" in body:
            key, _, value = body.strip().partition(":")
            rows[-1][key.strip()] = value.strip().strip("'\"")
    keys = sorted({k for r in rows for k in r})
    return spark.createDataFrame([tuple(r.get(k) for k in keys) for r in rows], ", ".join(f"`{k}` string" for k in keys) or "empty string")


def ticket(table: DataFrame, wanted: str, status: str = "queue_status", hidden: str = "Graylist") -> DataFrame:
    """The rows of ``cases`` or ``cases?status=X``; without a status the hidden one is left out. A server streams them with ``toLocalIterator`` or writes them as Arrow files."""
    name, _, query = wanted.partition("?")
    if name != "cases" or (query and not query.startswith("status=")):
        raise ValueError(f"unknown ticket {wanted!r}")
    chosen = F.col(status) == query.removeprefix("status=") if query else F.coalesce(F.col(status) != hidden, F.lit(True))
    return table.where(chosen)


def sniff(text: Column) -> Column:
    """hl7, fhir or eicr by the first characters."""
    lead = F.ltrim(text)
    return F.when(lead.startswith("MSH|"), "hl7").when(lead.startswith("{") & text.contains('"resourceType"'), "fhir").otherwise("eicr")


def format_hint(hint: Column, text: Column) -> Column:
    """A known hint decides, anything else leaves it to the text."""
    low = F.lower(F.trim(hint))
    return F.when(low.isin("hl7", "hl7v2", "v2"), "hl7").when(low.isin("fhir", "json"), "fhir").when(low.isin("eicr", "cda", "xml"), "eicr").otherwise(sniff(text))


def hl7_segments(messages: DataFrame, id_column: str, text: str) -> DataFrame:
    """Id, seq, segment, fields (index 0 is the segment's name); lines end in \\r or \\n, empty ones go."""
    lines = F.filter(F.split(F.col(text), "[\r\n]+"), lambda x: F.length(x) > 0)
    out = messages.select(id_column, F.posexplode(lines).alias("seq", "line"))
    fields = F.split("line", "[|]")
    return out.select(id_column, "seq", F.get(fields, F.lit(0)).alias("segment"), fields.alias("fields"))


def component(field: Column, k: int) -> Column:
    """Component k (from 1) of an HL7 field; null where it is absent or empty."""
    value = F.get(F.split(field, "\\^"), F.lit(k - 1))
    return F.get(F.filter(F.array(value), lambda v: v != ""), F.lit(0))


def hl7_date(value: Column) -> Column:
    return F.when(value.rlike("^[0-9]{8}"), F.concat_ws("-", F.substring(value, 1, 4), F.substring(value, 5, 2), F.substring(value, 7, 2)))


def hl7_prompt(messages: DataFrame, id_column: str, text: str) -> DataFrame:
    """Id, prompt: patient, visit, diagnoses, observations, then RXA or else RXE drugs, in segment order. MSH fields count from the separator, as the standard has it.

    One row a message with any line, made within the row: no shuffle.
    """
    # patterns of one plain character are split without a regular expression; lines are made once, so no filter behind
    segments = F.transform(F.filter(F.split(F.translate(F.col(text), "\r", "\n"), "\n"), lambda x: F.length(x) > 0), lambda x: F.split(x, "\\|"))
    of = lambda *names: lambda s: F.get(s, F.lit(0)).isin(*names)
    field = lambda s, k: F.get(s, F.lit(k))
    part = lambda s, k, c: F.coalesce(component(field(s, k), c), F.lit(""))

    def said(kept: Callable[[Column], Column], line: Callable[[Column], Column]) -> Column:
        return F.filter(F.transform(F.filter("s", kept), line), lambda x: x.isNotNull() & (x != ""))

    patient = lambda s: F.concat_ws("\n", F.concat(F.lit("Patient: "), F.concat_ws(" ", component(field(s, 5), 2), component(field(s, 5), 1))), F.concat(F.lit("DOB: "), hl7_date(field(s, 7))), F.concat(F.lit("Gender: "), F.when(field(s, 8) != "", field(s, 8))))
    visit = lambda s: F.concat_ws("\n", F.concat(F.lit("Facility: "), component(field(s, 3), 1)), F.concat(F.lit("Date: "), hl7_date(field(s, 6))))
    diagnosis = lambda s: F.concat(F.lit("Dx: "), part(s, 3, 2), F.lit(" ("), part(s, 3, 1), F.lit(")"))
    observation = lambda s: F.concat(F.lit("Lab: "), part(s, 3, 2), F.lit(" (LOINC "), part(s, 3, 1), F.lit("): "), F.coalesce(component(field(s, 5), 2), field(s, 5), F.lit("")))
    drug = lambda k: lambda s: F.concat(F.lit("Meds: "), part(s, k, 2))
    drugs = F.when(F.exists("s", of("RXA")), said(of("RXA"), drug(5))).otherwise(said(of("RXE"), drug(2)))
    lines = F.concat(said(of("PID"), patient), said(of("MSH"), visit), said(of("DG1"), diagnosis), said(of("OBX"), observation), drugs)
    return messages.select(id_column, segments.alias("s")).select(id_column, F.explode(F.filter(F.array(F.array_join(lines, "\n")), lambda p: p != "")).alias("prompt"))


def safe_batch(items: DataFrame, id_column: str, text: str, schema: str) -> DataFrame:
    """Id, ok, value, error: each item parsed by itself; a bad one is a row with its error, not a failure."""
    value = F.try_parse_json(F.col(text))
    parsed = F.when(value.isNotNull(), F.from_json(F.col(text), schema))
    error = F.when(F.col(text).isNull() | (F.trim(F.col(text)) == ""), "empty").when(value.isNull(), "not JSON")
    return items.select(id_column, error.isNull().alias("ok"), parsed.alias("value"), error.alias("error"))
