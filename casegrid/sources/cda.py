"""Marked-up case reports as typed records, without Python."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casegrid.functions.codes import compact_date, tag_attribute
from casegrid.operators.interop import prompt

#: Single fields of a report and where they stand (the first group counts).
FIELDS = {
    "given": r"<given>([^<]+)</given>",
    "family": r"<family>([^<]+)</family>",
    "gender": r'administrativeGenderCode code="([^"]+)"',
    "dob": r'<birthTime value="([0-9]{8})"/>',
    "race": r'raceCode[^>]*displayName="([^"]+)"',
    "ethnicity": r'ethnicGroupCode[^>]*displayName="([^"]+)"',
    "city": r"<city>([^<]+)</city>",
    "state": r"<state>([^<]+)</state>",
    "zip": r"<postalCode>([^<]+)</postalCode>",
    "phone": r'telecom value="tel:([^"]+)"',
    "npi": r'<id root="2\.16\.840\.1\.113883\.4\.6" extension="([^"]+)"',
    "encounter_date": r'(?s)<encounter[^>]*>.*?<effectiveTime>.*?<low value="([0-9]{8})',
}
FACILITY = [r"(?s)representedCustodianOrganization[^>]*>.*?<name>([^<]+)</name>", r"(?s)representedOrganization[^>]*>.*?<name>([^<]+)</name>"]
REASON = [r'(?s)displayName="Reason for visit"[^/]*/>\s*<text>([^<]+)</text>', r"<text>Patient presents with ([^<]+)</text>"]
#: Result words that are no diagnoses, and section codes that are no laboratory tests.
SKIP_DIAGNOSES = ["Detected", "Positive", "Negative", "Not detected", "Salmonella"]
SKIP_SECTIONS = ["55751-2", "46240-8", "29299-5", "11450-4", "30954-2", "10160-0"]
SNOMED, LOINC, RXNORM = "2.16.840.1.113883.6.96", "2.16.840.1.113883.6.1", "2.16.840.1.113883.6.88"


def _first(xml: Column, *patterns: str) -> Column:
    found = [F.regexp_extract(xml, p, 1) for p in patterns]
    return F.coalesce(*[F.when(f != "", f) for f in found], F.lit(""))


def _coded(xml: Column, tag: str, system: str) -> Column:
    """struct(code, name, tag) of the tags of a system with a code and a display, in order."""
    tags = F.regexp_extract_all(xml, F.lit(rf"<{tag}\b[^>]*>"), F.lit(0))
    held = F.filter(tags, lambda t: tag_attribute(t, "codeSystem") == system)
    rows = F.transform(held, lambda t: F.struct(tag_attribute(t, "code").alias("code"), tag_attribute(t, "displayName").alias("name")))
    return F.filter(rows, lambda r: r["code"].isNotNull() & r["name"].isNotNull())


def records(reports: DataFrame, id_column: str, xml: str) -> DataFrame:
    """id, the single fields ('' where absent), facility, reason (150 characters at most), conditions, labs, vitals, medications."""
    x = F.coalesce(F.col(xml), F.lit(""))
    single = [compact_date(_first(x, p)).alias(k) if k in ("dob", "encounter_date") else _first(x, p).alias(k) for k, p in FIELDS.items()]
    conditions = F.filter(_coded(x, "value", SNOMED), lambda r: ~r["name"].isin(SKIP_DIAGNOSES))
    after = lambda code: F.call_function("substring", x, F.call_function("instr", x, F.concat(F.lit('code="'), code, F.lit('"'))))
    # a laboratory result is the display of the first value after its code
    labs = F.transform(
        F.filter(_coded(x, "code", LOINC), lambda r: ~r["code"].isin(SKIP_SECTIONS)),
        lambda r: F.struct(r["code"].alias("code"), r["name"].alias("name"), F.regexp_extract(after(r["code"]), r'<value[^>]*displayName="([^"]+)"', 1).alias("result")),
    )
    # a vital sign is a code, its status and time, and a measured value, one behind the other
    runs = F.regexp_extract_all(x, F.lit(r"(?s)<code\b[^>]*>\s*<statusCode\b[^>]*>\s*<effectiveTime\b[^>]*>\s*<value\b[^>]*>"), F.lit(0))
    tags = lambda run: F.regexp_extract_all(run, F.lit("<[^>]*>"), F.lit(0))
    measured = lambda t: F.struct(tag_attribute(t[0], "code").alias("code"), tag_attribute(t[0], "displayName").alias("name"), tag_attribute(t[3], "value").alias("value"), tag_attribute(t[3], "unit").alias("unit"))
    vitals = F.filter(F.transform(F.transform(runs, tags), measured), lambda v: v["code"].isNotNull() & v["name"].isNotNull() & v["value"].isNotNull() & v["unit"].isNotNull())
    return reports.select(id_column, *single, _first(x, *FACILITY).alias("facility"), F.substring(_first(x, *REASON), 1, 150).alias("reason"), conditions.alias("conditions"), labs.alias("labs"), vitals.alias("vitals"), _coded(x, r"\w+", RXNORM).alias("medications"))


def prompt_column() -> Column:
    """The record's columns as labelled lines in a fixed order."""
    coded = lambda c, system: F.array_join(F.transform(c, lambda r: F.concat(r["name"], F.lit(f" ({system} "), r["code"], F.lit(")"))), "; ")
    lines = [
        ("Patient", F.trim(F.concat_ws(" ", "given", "family"))), ("Gender", F.col("gender")), ("DOB", F.col("dob")), ("Race", F.col("race")),
        ("Ethnicity", F.col("ethnicity")), ("Location", F.concat_ws(", ", *[F.when(F.col(k) != "", F.col(k)) for k in ("city", "state", "zip")])),
        ("Phone", F.col("phone")), ("Facility", F.col("facility")), ("Encounter", F.col("encounter_date")), ("Reason", F.col("reason")),
        ("Dx", coded(F.col("conditions"), "SNOMED")), ("Lab", coded(F.col("labs"), "LOINC")),
        ("Vitals", F.array_join(F.transform("vitals", lambda v: F.concat_ws(" ", v["name"], v["value"], v["unit"])), "; ")), ("Meds", coded(F.col("medications"), "RxNorm")),
    ]
    return prompt(lines)


def record_prompt(rows: DataFrame, id_column: str) -> DataFrame:
    """Id, prompt."""
    return rows.select(id_column, prompt_column().alias("prompt"))


#: Synonyms of fields in model output, the best first.
SYNONYMS = {
    "patient": ["patient", "patient_demographics"],
    "meds": ["meds", "medications"],
    "summary": ["summary", "case_summary"],
    "conf": ["conf", "confidence"],
    "sex": ["sex", "gender"],
    "addr": ["addr", "location", "address"],
    "name": ["name", "condition", "description"],
}


def _path(v: Column, kind: str, *paths: str) -> Column:
    return F.coalesce(*[F.try_variant_get(v, p, kind) for p in paths])


def typed(rows: DataFrame, id_column: str, json: str) -> DataFrame:
    """Id, name, sex, addr, summary, conditions, labs, meds from tolerant JSON: synonyms, and items that are texts or objects."""
    v = F.try_parse_json(F.col(json))
    who = lambda field: _path(v, "string", *[f"$.{p}.{k}" for p in SYNONYMS["patient"] for k in SYNONYMS.get(field, [field])])

    def items(names: list[str], code_keys: list[str]) -> Column:
        held = _path(v, "array<variant>", *[f"$.{n}" for n in names])
        text = lambda x: F.try_variant_get(x, "$", "string")
        in_text = lambda x: F.regexp_extract(text(x), r"\(([A-Za-z]+)[\s:]+([A-Za-z0-9.-]+)\)\s*$", 2)
        is_object = lambda x: F.schema_of_variant(x).startswith("OBJECT")
        item = lambda x: F.struct(
            F.when(is_object(x), _path(x, "string", *[f"$.{n}" for n in SYNONYMS["name"]])).otherwise(F.trim(F.regexp_replace(text(x), r"\s*\([^()]*\)\s*$", ""))).alias("name"),
            F.when(is_object(x), _path(x, "string", *[f"$.{k}" for k in code_keys])).otherwise(F.when(in_text(x) != "", in_text(x))).alias("code"),
            F.when(is_object(x), _path(x, "double", *[f"$.{k}" for k in SYNONYMS["conf"]])).alias("conf"),
        )
        return F.transform(F.coalesce(held, F.array().cast("array<variant>")), item)

    return rows.select(
        id_column, who("name").alias("name"), who("sex").alias("sex"), who("addr").alias("addr"), _path(v, "string", *[f"$.{k}" for k in SYNONYMS["summary"]]).alias("summary"),
        items(["conditions"], ["snomed", "code"]).alias("conditions"), items(["labs"], ["loinc", "code"]).alias("labs"), items(SYNONYMS["meds"], ["rxnorm", "code"]).alias("meds"),
    )
