"""Queries on made-up case reports, whose rows are known in advance.

The texts stand here with what they must give; rows of a driver table choose
among them, so the whole operator runs over a table and SQL can state its result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casegrid.functions import extract
from casegrid.operators import interop, merge
from casegrid.plans.registry import Registry
from casegrid.session import spread, table
from casegrid.sources import cda, readers

R = Registry()

TERMS = [
    extract.Term("snomed", "27836007", ("Pertussis", "whooping cough")),
    extract.Term("loinc", "600-7", ("blood culture", "CBC")),
    extract.Term("rxnorm", "70618", ("penicillin",)),
]
ENTRIES = [extract.Entry("3928002", "SNOMED", "Zika virus disease", ("Zika fever",), "https://example.org/zika", "arbovirus")]
FILLER = "words that say nothing about the matter at hand and go on for a while yet"

#: (text, rows: bucket, code, tier, display, offset)
CASES: list[tuple[str, list[tuple[str, str, str, str, int]]]] = [
    # A label close by; the display is what stands between the label and the code
    ("Dx: Pertussis (SNOMED 27836007)", [("snomed", "27836007", "inline", "Pertussis", 15)]),
    # Neither label nor lexicon
    ("seen with SNOMED 27836008 today", []),
    # denied
    ("Dx: ruled out SNOMED 11111111", []),
    # T4: LOINC codes are kept whatever stands before
    ("Lab: no growth LOINC 601-5", [("loinc", "601-5", "inline", "no growth", 15)]),
    # The label is far, but on the line
    (f"Assessment: {FILLER} RxNorm 5678", [("rxnorm", "5678", "inline", FILLER, 13 + len(FILLER))]),
    # The label is far and on another line
    (f"Assessment:\n{FILLER}\nRxNorm 5678", []),
    # No label, but in the lexicon; T9: the name gives way to the code that follows
    ("Pertussis and SNOMED 27836007", [("snomed", "27836007", "inline", "Pertussis and", 14)]),
    # A tag with its display
    ('<value code="27836007" codeSystem="2.16.840.1.113883.6.96" displayName="Pertussis"/>', [("snomed", "27836007", "cda", "Pertussis", 0)]),
    # Attributes in another order, no display
    ("<code codeSystem='2.16.840.1.113883.6.1' code='600-7'/>", [("loinc", "600-7", "cda", "600-7", 0)]),
    # An unknown system
    ('<code code="1" codeSystem="1.2.3" displayName="Thing"/>', []),
    # The second alias
    ("Patient has whooping cough.", [("snomed", "27836007", "lookup", "whooping cough", 12)]),
    # Denied before and behind
    ("Patient denies whooping cough.", []),
    ("pertussis was ruled out", []),
    # The clause ends between the denial and the name
    ("no fever; pertussis confirmed", [("snomed", "27836007", "lookup", "Pertussis", 10)]),
    # Only a vaccine's target
    ("missed pertussis booster", []),
    # A sentence about somebody else
    ("Family history of pertussis in the mother.", []),
    # The name of a coded laboratory line
    ("Lab: Pertussis culture LOINC 548-8", [("loinc", "548-8", "inline", "Pertussis culture", 23)]),
    # An acronym as a heading, and one in a sentence
    ("CBC: normal", []),
    ("The CBC was normal", [("loinc", "600-7", "lookup", "CBC", 4)]),
    # Compatibility forms
    ("Ｐｅｒｔｕｓｓｉｓ confirmed", [("snomed", "27836007", "lookup", "Pertussis", 0)]),
    # The base is asked only without a condition
    ("Zika virus disease was found", [("snomed", "3928002", "rag", "Zika virus disease", 0)]),
    ("no Zika virus disease", []),
    ("pertussis, and Zika virus disease", [("snomed", "27836007", "lookup", "Pertussis", 0)]),
    # Order of tiers and of buckets; a code counts once
    ("Meds: penicillin RxNorm 70618, penicillin; whooping cough", [("rxnorm", "70618", "inline", "penicillin", 17), ("snomed", "27836007", "lookup", "whooping cough", 43)]),
    ("", []),
]


def _literal(x: object) -> str:
    return str(x) if isinstance(x, int) else "'" + str(x).replace("'", "''") + "'"


def _expected() -> str:
    rows = [(k, pos, *row) for k, (_, listed) in enumerate(CASES) for pos, row in enumerate(listed)]
    return ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in rows)


def _chosen(spark: SparkSession, d: str) -> DataFrame:
    """event_id, text: each event has one of the texts."""
    texts = F.array(*[F.lit(text) for text, _ in CASES])
    return spread(table(spark, d, "events").select("event_id"), "event_id").select("event_id", F.get(texts, (F.col("event_id") % len(CASES)).cast("int")).alias("text"))


@R.add("t15_cascade_cases", f"""
SELECT event_id, pos, bucket, code, tier, display, place FROM events JOIN (VALUES {_expected()}) AS t(k, pos, bucket, code, tier, display, place) ON k = event_id % {len(CASES)}""")
def t15_cases(spark: SparkSession, d: str) -> DataFrame:
    """The tiered extraction over texts with known rows."""
    got = extract.extract(_chosen(spark, d), TERMS, ENTRIES, "event_id")
    return got.select("event_id", "pos", "bucket", "code", "tier", "display", F.col("source_offset").alias("place"))


def _joined_codes() -> str:
    """user's texts in chunks: the codes of both, each once, in order."""
    rows = []
    for a in range(len(CASES)):
        b = (7 * a + 3) % len(CASES)
        codes = list(dict.fromkeys(row[1] for row in [*CASES[a][1], *CASES[b][1]]))
        rows.append((a, ",".join(codes)))
    return ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in rows)


@R.add("t37_chunked_run", f"SELECT event_id, codes FROM events JOIN (VALUES {_joined_codes()}) AS t(k, codes) ON k = event_id % {len(CASES)}")
def t37(spark: SparkSession, d: str) -> DataFrame:
    """A text in chunks, codes of each chunk, merged in order of chunks."""
    part = lambda k: CASES[k % len(CASES)][0].ljust(150) + "</section>"
    texts = F.array(*[F.lit(part(k) + part(7 * k + 3)) for k in range(len(CASES))])
    rows = spread(table(spark, d, "events").select("event_id"), "event_id").select("event_id", F.get(texts, (F.col("event_id") % len(CASES)).cast("int")).alias("text"))
    got = extract.extract_chunked(rows, TERMS, ENTRIES, "event_id", "text", most=200)
    return got.select("event_id", F.array_join(F.transform("merged", lambda m: m["code"]), ",").alias("codes"))


@R.add("s6_t29_records", """
SELECT c_custkey, 'Given' || c_custkey AS given, replace(c_name, '#', ' ') AS family, '19' || lpad((c_custkey % 100)::VARCHAR, 2, '0') || '-02-03' AS dob, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'City' || c_nationkey END AS city,
 'C' || c_custkey AS conditions, 'L' || c_custkey || '-1=Found' AS labs, '8310-5=' || (30 + c_custkey % 12) || 'Cel' AS vitals, CASE WHEN c_custkey % 2 = 0 THEN 'M' || c_custkey ELSE '' END AS meds,
 'Patient: Given' || c_custkey || ' ' || replace(c_name, '#', ' ') || chr(10) || 'DOB: 19' || lpad((c_custkey % 100)::VARCHAR, 2, '0') || '-02-03' AS first_lines FROM customer""")
def s6(spark: SparkSession, d: str) -> DataFrame:
    """Marked-up reports as records: single fields, coded lists with their skip lists, and the prompt's first lines."""
    n = F.col("c_custkey").cast("string")
    tag = lambda name, code, system, shown: F.concat(F.lit(f'<{name} code="'), code, F.lit(f'" codeSystem="{system}" displayName="'), shown, F.lit('"/>'))
    city = F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.concat(F.lit("<city>City"), F.col("c_nationkey").cast("string"), F.lit("</city>")))
    born = F.concat(F.lit('<birthTime value="19'), F.lpad((F.col("c_custkey") % 100).cast("string"), 2, "0"), F.lit('0203"/>'))
    vital = F.concat(tag("code", F.lit("8310-5"), cda.LOINC, F.lit("Temp")), F.lit('<statusCode code="c"/><effectiveTime value="1"/><value xsi:type="PQ" value="'), (30 + F.col("c_custkey") % 12).cast("string"), F.lit('" unit="Cel"/>'))
    meds = F.when(F.col("c_custkey") % 2 == 0, tag("manufacturedMaterial", F.concat(F.lit("M"), n), cda.RXNORM, F.lit("Drug"))).otherwise("")
    xml = F.concat(
        tag("code", F.lit("55751-2"), cda.LOINC, F.lit("Report")), F.lit("<given>Given"), n, F.lit("</given><family>"), F.regexp_replace("c_name", "#", " "), F.lit("</family>"), born, city,
        tag("value", F.concat(F.lit("C"), n), cda.SNOMED, F.lit("Cond")), tag("value", F.lit("1"), cda.SNOMED, F.lit("Detected")), tag("code", F.concat(F.lit("L"), n, F.lit("-1")), cda.LOINC, F.lit("Test")),
        F.lit('<value xsi:type="CD" displayName="Found"/>'), vital, meds,
    )
    reports = spread(table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey"), "c_custkey").select("c_custkey", xml.alias("xml"))
    got = cda.records(reports, "c_custkey", "xml")
    first_lines = F.substring_index(cda.prompt_column(), "\n", 2)
    codes = lambda c: F.array_join(F.transform(c, lambda r: r["code"]), ",")
    labs = F.array_join(F.transform(F.filter("labs", lambda r: r["code"] != "8310-5"), lambda r: F.concat(r["code"], F.lit("="), r["result"])), ",")
    vitals = F.array_join(F.transform("vitals", lambda v: F.concat(v["code"], F.lit("="), v["value"], v["unit"])), ",")
    return got.select("c_custkey", "given", "family", "dob", "city", codes("conditions").alias("conditions"), labs.alias("labs"), vitals.alias("vitals"), codes("medications").alias("meds"), first_lines.alias("first_lines"))


@R.add("s7_t42_hl7_prompt", """
SELECT o_orderkey, 'Patient: Ann Lee' || o_custkey || chr(10) || 'DOB: 1990-01-02' || chr(10) || 'Gender: F' || chr(10) || 'Facility: F' || (o_custkey % 7) || chr(10) || 'Date: 2024-03-04' || chr(10) || 'Dx: Flu (' || (o_custkey + 1000) || ')' || chr(10)
 || 'Lab: Culture (LOINC 600-7): ' || CASE WHEN o_custkey % 2 = 0 THEN 'Positive' ELSE '7' END || CASE WHEN o_custkey % 3 = 0 THEN chr(10) || 'Meds: Shot' WHEN o_custkey % 3 = 1 THEN chr(10) || 'Meds: Pill' ELSE '' END AS prompt FROM orders""")
def s7(spark: SparkSession, d: str) -> DataFrame:
    """Delimited messages, line ends of either kind, to prompt lines; RXA drugs hide RXE ones."""
    n = F.col("o_custkey")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    drugs = F.when(n % 3 == 0, "RXE||1^Pill\rRXA|0|1|x||9^Shot\r").when(n % 3 == 1, "RXE||1^Pill\n").otherwise("")
    message = text(
        "MSH|^~\\&|APP|F", (n % 7).cast("string"), "|||20240304101112||ORU^R01|1|P|2.5.1\r\rPID|1||9||Lee", n.cast("string"), "^Ann||19900102|F\n",
        "OBX|1|CWE|600-7^Culture^LN||", F.when(n % 2 == 0, "10828004^Positive^SCT").otherwise("7"), "||||||F\rDG1|1||", (n + 1000).cast("string"), "^Flu^SCT||20240101|A\r", drugs,
    )
    return readers.hl7_prompt(spread(table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_orderkey").select("o_orderkey", message.alias("m")), "o_orderkey", "m")


@R.add("t43_entities", """
SELECT s_suppkey, 1 AS pos, 'condition' AS axis, 'http://snomed.info/sct' AS code_system, (s_suppkey + 100000)::VARCHAR AS code FROM supplier
UNION ALL SELECT s_suppkey, 2, CASE WHEN s_suppkey % 3 = 2 THEN 'lab' ELSE 'vital' END, 'http://loinc.org', CASE s_suppkey % 3 WHEN 0 THEN '8462-4' WHEN 1 THEN '8867-4' ELSE s_suppkey || '-1' END FROM supplier
UNION ALL SELECT s_suppkey, 3, 'medication', 'http://www.nlm.nih.gov/research/umls/rxnorm', '7' FROM supplier""")
def t43(spark: SparkSession, d: str) -> DataFrame:
    """Bundles read back as coded entities, blood pressure as its own component."""
    n = F.col("s_suppkey").cast("string")
    lab = F.when(F.col("s_suppkey") % 3 == 0, "8462-4").when(F.col("s_suppkey") % 3 == 1, "8867-4").otherwise(F.concat(n, F.lit("-1")))
    json = interop.bundle(n, F.array((F.col("s_suppkey") + 100000).cast("string")), F.array(lab), F.array(F.lit("7")))
    return interop.bundle_entities(table(spark, d, "supplier").select("s_suppkey", json.alias("json")), "s_suppkey", "json")


@R.add("t43_codings", """
SELECT s_suppkey, 0 AS pos, k::INTEGER AS coding, 'Condition' AS kind, CASE k WHEN 0 THEN 'http://snomed.info/sct' ELSE '' END AS code_system, CASE k WHEN 0 THEN s_suppkey::VARCHAR ELSE 'A' || s_nationkey END AS code, CASE k WHEN 0 THEN s_name ELSE '' END AS display
FROM supplier, range(2) t(k)
UNION ALL SELECT s_suppkey, 1, k::INTEGER, CASE s_suppkey % 3 WHEN 0 THEN 'Observation (Lab)' WHEN 1 THEN 'Observation (Vital)' ELSE 'Observation' END, 'http://loinc.org', k || '-' || s_nationkey, '' FROM supplier, range(3) t(k) WHERE k < s_suppkey % 4
UNION ALL SELECT s_suppkey, 2, 0, 'MedicationStatement', '', '7', s_name FROM supplier""")
def t43_codings(spark: SparkSession, d: str) -> DataFrame:
    """Every coding of each resource; other resources have none."""
    text = lambda c: F.col(c).cast("string")
    coding = lambda **f: F.struct(*[(v if hasattr(v, "alias") else F.lit(v)).alias(k) for k, v in f.items()])
    condition = F.array(F.to_json(coding(system="http://snomed.info/sct", code=text("s_suppkey"), display=F.col("s_name"))), F.to_json(coding(code=F.concat(F.lit("A"), text("s_nationkey")))))
    loincs = F.filter(F.transform(F.array(*map(F.lit, range(3))), lambda k: F.when(k < F.col("s_suppkey") % 4, F.to_json(F.struct(F.lit("http://loinc.org").alias("system"), F.concat(k.cast("string"), F.lit("-"), text("s_nationkey")).alias("code"))))), lambda x: x.isNotNull())
    category = F.when(F.col("s_suppkey") % 3 == 0, "laboratory").when(F.col("s_suppkey") % 3 == 1, "vital-signs").otherwise("exam")
    json = F.concat(
        F.lit('{"entry":[{"resource":{"resourceType":"Condition","code":{"coding":['), F.array_join(condition, ","),
        F.lit(']}}},{"resource":{"resourceType":"Observation","category":[{"coding":[{"code":"'), category, F.lit('"}]}],"code":{"coding":['), F.array_join(loincs, ","),
        F.lit(']}}},{"resource":{"resourceType":"MedicationStatement","medicationCodeableConcept":{"coding":['), F.to_json(coding(code="7", display=F.col("s_name"))), F.lit(']}}},{"resource":{"resourceType":"Patient","code":{"coding":[{"code":"no"}]}}}]}'),
    )
    return interop.bundle_codings(table(spark, d, "supplier").select("s_suppkey", json.alias("json")), "s_suppkey", "json")


@R.add("k20_status_rejects", """
WITH u AS (SELECT o_orderkey + (o_orderkey % 5 = 0)::INT * 1000000000 AS k, CASE WHEN o_orderkey % 7 = 0 THEN 'Odd' ELSE 'F' END AS s FROM orders)
SELECT count(DISTINCT k) FILTER (WHERE s = 'F' AND k < 1000000000)::BIGINT AS updated, count(*) FILTER (WHERE s = 'Odd')::BIGINT AS invalid, count(*) FILTER (WHERE s = 'F' AND k >= 1000000000)::BIGINT AS missing FROM u""")
def k20(spark: SparkSession, d: str) -> DataFrame:
    """Status changes with the number updated, and rejects by reason."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s"))
    far = F.when(F.col("k") % 5 == 0, 1000000000).otherwise(0)
    updates = o.select((F.col("k") + far).alias("k"), F.when(F.col("k") % 7 == 0, "Odd").otherwise("F").alias("s"), F.lit(1).alias("at"))
    return merge.apply_statuses(o, updates, "k", "s", "at", ["F", "O", "P"])[1]
