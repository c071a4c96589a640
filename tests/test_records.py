"""Records, traces, sinks and generators on hand-made rows."""

import json
import random

import pytest
from pyspark.sql import functions as F

from casegrid.operators import conversations, generate, interop, traces
from casegrid.sources import cda, sinks

XML = """<ClinicalDocument><code code="55751-2" codeSystem="2.16.840.1.113883.6.1" displayName="Report"/>
<given>Ann</given><family>Lee</family><administrativeGenderCode code="F"/><birthTime value="19900102"/><city>Denver</city><state>CO</state>
<representedOrganization><name>Clinic</name></representedOrganization><id root="2.16.840.1.113883.4.6" extension="77"/>
<encounter classCode="x"><effectiveTime><low value="20240203101112"/></effectiveTime></encounter><text>Patient presents with fever</text>
<value xsi:type="CD" code="27836007" codeSystem="2.16.840.1.113883.6.96" displayName="Pertussis"/>
<code code="600-7" codeSystem="2.16.840.1.113883.6.1" displayName="Culture"/><value code="10828004" codeSystem="2.16.840.1.113883.6.96" displayName="Positive"/>
<code code="8310-5" codeSystem="2.16.840.1.113883.6.1" displayName="Temp"/> <statusCode code="c"/> <effectiveTime value="1"/> <value xsi:type="PQ" value="38.2" unit="Cel"/>
<manufacturedMaterial code="70618" codeSystem="2.16.840.1.113883.6.88" displayName="Penicillin"/></ClinicalDocument>"""


def test_report_record_and_prompt(spark):
    df = spark.createDataFrame([(1, XML), (2, None)], "id int, x string")
    rows = {r["id"]: r for r in cda.records(df, "id", "x").collect()}
    r = rows[1]
    assert (r["given"], r["gender"], r["dob"], r["facility"], r["npi"], r["encounter_date"], r["reason"]) == ("Ann", "F", "1990-01-02", "Clinic", "77", "2024-02-03", "fever")
    assert [tuple(c) for c in r["conditions"]] == [("27836007", "Pertussis")]
    assert [tuple(x) for x in r["labs"]][0] == ("600-7", "Culture", "Positive")
    assert [tuple(v) for v in r["vitals"]] == [("8310-5", "Temp", "38.2", "Cel")] and [m["code"] for m in r["medications"]] == ["70618"]
    assert rows[2]["given"] == "" and rows[2]["conditions"] == []
    text = {p["id"]: p["prompt"] for p in cda.record_prompt(cda.records(df, "id", "x"), "id").collect()}
    assert text[1].startswith("Patient: Ann Lee\nGender: F\nDOB: 1990-01-02") and "Dx: Pertussis (SNOMED 27836007)" in text[1] and text[2] == ""


def test_tolerant_parse(spark):
    raw = json.dumps({"patient_demographics": {"name": "Ann", "gender": "F"}, "conditions": ["Flu (SNOMED 6142004)", {"condition": "Measles", "code": "14189004", "confidence": 0.9}], "medications": [{"name": "X", "rxnorm": 5}], "case_summary": "s"})
    r = cda.typed(spark.createDataFrame([(1, raw), (2, "broken")], "id int, j string"), "id", "j").orderBy("id").collect()
    assert (r[0]["name"], r[0]["sex"], r[0]["summary"]) == ("Ann", "F", "s")
    assert [(c["name"], c["code"], c["conf"]) for c in r[0]["conditions"]] == [("Flu", "6142004", None), ("Measles", "14189004", 0.9)]
    assert r[0]["meds"][0]["code"] == "5" and r[1]["conditions"] == [] and r[1]["name"] is None


def test_trace_to_conversation(spark):
    trace = [
        {"tool_calls": [{"id": "c1", "function": {"name": "a", "arguments": '{"x": 1}'}}, {"function": {"name": "b"}}], "turn": 1},
        {"tool_result": "a", "result": {"r": 1}}, {"tool_result": "b", "result": []}, {"tool_result": "z", "args": {"q": 2}, "result": 3}, {"tool_result": "z", "forced": True, "result": "text"},
    ]
    rows = [("1", "s", "u", json.dumps(trace), '{"k": []}'), ("2", "s", "u", None, None), ("3", "s", "u", "[", "{}"), ("4", "s", "u", '[{"content": "x"}]', "{}")]
    df = spark.createDataFrame(rows, "case_id string, system string, user string, trace string, target string")
    got = {r["case_id"]: r["conversations"] for r in conversations.conversations(df).collect()}
    turns = json.loads(got["1"])
    assert [t["role"] for t in turns] == ["system", "user", "assistant", "tool", "tool", "assistant", "tool", "assistant", "tool", "assistant"]
    assert [t["tool_call_id"] for t in turns if t["role"] == "tool"] == ["c1", "trace_turn_1_call_1", "synthetic_tool_call_0", "forced_extract_0"]
    assert turns[2]["tool_calls"][0] == {"id": "c1", "type": "function", "function": {"name": "a", "arguments": '{"x":1}'}} and turns[3]["content"] == '{"r":1}'
    assert turns[5]["tool_calls"][0]["function"]["arguments"] == '{"q":2}' and turns[-1]["content"] == '{"k":[]}' and turns[8]["content"] == "text"
    assert got["2"] is None and got["3"] is None and got["4"] is None


def test_trace_pairs_equal_a_queue(spark):
    """Random traces against a queue that is walked step by step."""
    rng = random.Random(4)
    rows, want = [], []
    for case in range(30):
        trace, waiting, made = [], [], 0
        for pos in range(rng.randrange(1, 14)):
            if rng.random() < 0.5:
                trace.append({"tool_result": "t", "result": 1})
                if not waiting:
                    waiting.append(f"synthetic_tool_call_{made}")
                    made += 1
                want.append((case, pos, waiting.pop(0)))
            else:
                ids = [f"{pos}-{k}" for k in range(rng.randrange(3))]
                trace.append({"content": "m", "tool_calls": [{"id": i, "function": {"name": "n"}} for i in ids]})
                waiting += ids
        rows.append((case, json.dumps(trace)))
    got = conversations.trace_turns(spark.createDataFrame(rows, "case_id int, trace string"), "case_id", "trace")
    assert sorted((r["case_id"], r["pos"], r["call_id"]) for r in got.where("role = 'tool'").collect()) == sorted(want)


def test_gold_conversation(spark):
    rows = spark.createDataFrame(
        [(1, "s", "the text", (["a"], [], None), (["a", "b", "c"], ["1-2"], ["9"]), '{"valid": true}'), (2, None, "u", ([], [], []), ([], [], []), None)],
        "case_id int, system string, user string, candidate struct<conditions:array<string>,loincs:array<string>,rxnorms:array<string>>, target struct<conditions:array<string>,loincs:array<string>,rxnorms:array<string>>, validation string",
    )
    names = spark.createDataFrame([("conditions", "c", "Cold", '[{"code": "c"}]'), ("loincs", "1-2", "Lab", "{}")], "axis string, code string, query string, result string")
    got = {r["case_id"]: r for r in conversations.gold_conversations(rows, names).collect()}
    turns = json.loads(got[1]["conversations"])
    calls = [t["tool_calls"][0] for t in turns if t.get("tool_calls")]
    assert [c["id"] for c in calls] == ["gold_extract_0", "gold_lookup_0", "gold_lookup_1", "gold_validate_0"]
    assert [json.loads(c["function"]["arguments"]) for c in calls] == [{"text": "the text"}, {"query": "Cold", "top_k": 3}, {"name": "Lab", "codeset": "loinc"}, {"extraction": {"conditions": ["a", "b", "c"], "loincs": ["1-2"], "rxnorms": ["9"]}}]
    assert (got[1]["lookup_calls"], got[1]["missing_lookup_queries"]) == (2, ["conditions:b", "rxnorms:9"])
    assert json.loads(turns[-1]["content"])["rxnorms"] == ["9"] and len(json.loads(got[2]["conversations"])) == 7 and got[2]["lookup_calls"] == 0
    o8 = spark.createDataFrame([(["a", "b"], ["b", "x"]), ([], ["x", "x"])], "g array<string>, m array<string>")
    assert [r[0] for r in o8.select(conversations.grounded_union(F.col("g"), F.col("m"))).collect()] == [["a", "b"], ["x"]]


def test_decisions(spark):
    df = spark.createDataFrame([("condition", "rejected", "a"), ("condition", "needs_review", "a"), ("lab", None, None), ("condition", None, None), ("condition", None, "a"), ("condition", None, "b")], "axis string, review string, category string")
    got = [r[0] for r in df.select(traces.decision(F.col("axis"), F.col("review"), F.col("category"), ["a"], True)).collect()]
    assert got == ["not_included", "needs_review", "reportable", "needs_review", "reportable", "not_included"]
    rows = spark.createDataFrame([(3, 3, 0), (3, 3, 1), (None, 3, 0)], "m int, e int, f int")
    assert [r[0] for r in rows.select(traces.perfect(F.col("m"), F.col("e"), F.col("f"))).collect()] == [True, False, False]


def test_grounding_and_chunks(spark):
    hits = spark.createDataFrame([(1, 1, "LOINC", 0.9, False, "a"), (1, 2, "snomed", 0.5, False, "b"), (2, 1, "SNOMED", 0.3, False, "c"), (3, 1, "SNOMED", 0.9, True, "d")], "q int, rank int, system string, score double, denied boolean, code string")
    assert [(r["q"], r["code"]) for r in traces.grounded(hits, "q").collect()] == [(1, "b")]
    parts = spark.createDataFrame([(1, 1, ["b", "a"], None), (1, 0, [], ["c"]), (1, 2, ["a", "d"], ["z"])], "d int, i int, c array<string>, s array<string>")
    assert traces.merged_chunks(parts, "d", "i", "c", "s").first()["c"] == ["c", "b", "a", "d"]


def test_validator_log(spark):
    log = "Validate a.json\n Error @ x\n 2 errors, 1 warnings\nValidate b.json\n 0 errors, 3 warnings\nValidate c.json\n crash"
    got = sorted(tuple(r) for r in traces.validator_log(spark.createDataFrame([(1, log), (2, None)], "id int, t string"), "id", "t").collect())
    assert got == [(1, "a.json", 2, 1, False), (1, "b.json", 0, 3, True), (1, "c.json", None, None, False)]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("p", "c2", "2024-02", "lab", "s", "1", "d", "added"), ("p", "c1", "2024-01", "lab", "s", "2", None, "removed")], ", ".join(f"{c} string" for c in sinks.DIFF_HEADER))
    sinks.diff_csv(rows, str(tmp_path / "csv"))
    lines = [line for p in sorted((tmp_path / "csv").glob("part-*")) for line in p.read_text().splitlines()]
    assert lines[0] == ",".join(sinks.DIFF_HEADER) and [line.split(",")[1] for line in lines if not line.startswith("patient_hash")] == ["c1", "c2"]
    sinks.jsonl(rows, str(tmp_path / "jsonl"))
    first = [line for p in sorted((tmp_path / "jsonl").glob("part-*")) for line in p.read_text().splitlines()][0]
    assert list(json.loads(first)) == sorted(json.loads(first))
    assert sinks.markdown(rows.select("case_id").orderBy("case_id")).splitlines() == ["| case_id |", "|---|", "| c1 |", "| c2 |"]
    with pytest.raises(ValueError):
        sinks.markdown(rows, most=1)
    manifest = sinks.split_dataset(rows, F.when(F.col("case_id") == "c1", "val").otherwise("train"), str(tmp_path / "split"))
    assert sorted(tuple(r) for r in manifest.collect()) == [("train", 1), ("val", 1)]
    sinks.append(rows, str(tmp_path / "t")), sinks.append(rows, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 4
    payload = sinks.diff_payload(rows.withColumn("decision", F.lit("reportable")), "case_id", only_added=True).collect()
    assert [json.loads(r["payload"])["changes"][0]["code"] for r in payload] == ["1"]


def test_generator_is_stable(spark):
    make = lambda: generate.cases(spark, 20, [("1", "Flu"), ("2", "Measles")], ["Dx: {term} (SNOMED {code})", "{name} has {term}"], [("Ann", "Lee"), ("Bo", "Kim")])
    a, b = make().orderBy("case_id").collect(), make().repartition(3).orderBy("case_id").collect()
    assert a == b and len({r["user"] for r in a}) > 3
    v = spark.createDataFrame([(["a", "b"], ["b", "c"], ["a"], ["c"]), (["a"], None, None, ["x"])], "c array<string>, p array<string>, ea array<string>, er array<string>")
    assert [r["ok"] for r in generate.check_visits(v, "c", "p", {"added": "ea", "removed": "er"}).collect()] == [True, False]


def test_message_values_are_escaped(spark):
    """A value with separators, escapes and line ends adds no field, component or segment, and comes back."""
    odd = ["a|b^c&d~e\\f", "\\F\\", "one\rtwo\nthree", "", "plain", "\\X0D\\|"]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(odd)], "id int, v string")
    back = df.select("id", interop.hl7_unescaped(interop.hl7_escaped(F.col("v"))).alias("b")).orderBy("id").collect()
    assert [r["b"] for r in back] == odd
    empty = F.array().cast("array<struct<code:string,name:string,result_code:string,result:string,date:string>>")
    report = interop.hl7_report({k: F.col("v") for k in "facility at message_id patient_id family given birth sex race city state zip phone ethnicity visit_date".split()}, F.array(F.struct(F.lit("1").alias("code"), F.col("v").alias("name"))), empty, {}, F.array(F.struct(F.lit("2").alias("code"), F.col("v").alias("name"))))
    for r in df.select("v", report.alias("m")).collect():
        lines = r["m"].split("\r")
        assert [x[:3] for x in lines] == ["MSH", "PID", "PV1", "DG1", "RXA"] and len(lines[3].split("|")) == 7 and len(lines[3].split("|")[3].split("^")) == 3


def test_all_codings_of_odd_bundles(spark):
    rows = [(1, None), (2, "no json"), (3, "{}"), (4, '{"entry":[{"resource":{"resourceType":"Condition"}},{"resource":{"resourceType":"Observation","category":[],"code":{"coding":[{"code":"x"},{}]}}},{}]}')]
    got = interop.bundle_codings(spark.createDataFrame(rows, "id int, j string"), "id", "j").orderBy("coding").collect()
    assert [tuple(r) for r in got] == [(4, 1, 0, "Observation", "", "x", ""), (4, 1, 1, "Observation", "", "", "")]
