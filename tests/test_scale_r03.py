"""Findings of round 3: rows and counts that the small tables don't hold."""

import duckdb

from casegrid.plans import catalog


def test_bundle_fields_with_a_key_that_makes_a_vital_code(spark, tmp_path):
    """supplier 9279 makes the laboratory code 9279-1, which is also that of a vital sign."""
    keys = [9276, 9277, 9278, 9279, 9280]
    spark.createDataFrame([(k, f"S{k}") for k in keys], "s_suppkey long, s_name string").coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW supplier AS SELECT * FROM '{tmp_path}/supplier.parquet/*.parquet'")
    want = con.execute(catalog.ORACLE["t44_bundle_fields"])
    names = [c[0] for c in want.description]
    got = catalog.QUERIES["t44_bundle_fields"](spark, str(tmp_path)).select(*names).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want.fetchall()))


def test_record_is_made_and_parsed_once(spark):
    """the texts of a record are parsed once each, and odd parts hold no codes."""
    import json

    from pyspark.sql import functions as F

    from casegrid.operators import scores

    pred = {"conditions": [{"snomed": "1", "icd10": ""}, 5, None, "x", ["y"], {"snomed": 1, "loinc": {"a": 1}, "other": "z"}], "labs": {"loinc": "2"}, "meds": [{"rxnorm": None}], "vitals": {"hr": 0, "t": "", "bp": None, "x": {"y": 1}, "l": []}}
    held = spark.createDataFrame([(json.dumps(pred),)], "t string").select(scores.record_codes(F.try_parse_json("t")).alias("c")).first()["c"]
    assert sorted(held) == ['loinc|{"a":1}', "snomed|1", "vital|hr", "vital|l", "vital|x"]
    plan = catalog.QUERIES["v4_record_score"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("parseJson(") == 2


def _plan(spark, name):
    return catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()


def test_reports_are_read_once_by_many_tasks(spark):
    """no join of a report's record with its own prompt; few row groups don't mean few tasks."""
    plan = _plan(spark, "s6_t29_records")
    assert "Join" not in plan and "REPARTITION_BY_NUM" in plan


def test_messages_become_prompts_within_their_row(spark):
    """no aggregation; messages that share an id stay apart, one without lines has no row."""
    from casegrid.sources import readers

    rows = [(1, "MSH|^~\\&|A|F1|||20240304\r\nPID|1||9||Lee^Ann||19900102|F\rRXE||1^Pill\rRXA|0|1|x||9^Shot"), (1, "RXE||1^Pill\n\nDG1|1||7^^SCT"), (2, "ZZZ|1"), (3, None), (4, "")]
    got = readers.hl7_prompt(spark.createDataFrame(rows, "id int, m string"), "id", "m").collect()
    assert sorted((r["id"], r["prompt"]) for r in got) == [(1, "Dx:  (7)\nMeds: Pill"), (1, "Patient: Ann Lee\nDOB: 1990-01-02\nGender: F\nFacility: F1\nDate: 2024-03-04\nMeds: Shot")]
    assert "Aggregate" not in _plan(spark, "s7_t42_hl7_prompt")


def test_chunks_leave_in_bounded_batches():
    """a batch of long texts leaves in several, with every character."""
    import pyarrow as pa

    from casegrid.functions import extract

    texts = [("word\n" * 400_000), None, "", *["x" * 3_000_000] * 4]
    came = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["id", "text"])
    left = list(extract.chunk_batches(iter([came]), "id", 14_000))
    assert len(left) > 1 and max(sum(map(len, b.column(2).to_pylist())) for b in left) <= 2 * extract.CHUNKS_HELD
    joined = ["".join(c for b in left for k, c in zip(b.column(0).to_pylist(), b.column(2).to_pylist()) if k == i) for i in range(len(texts))]
    assert joined == [t or "" for t in texts]


def test_chunked_codes_leave_in_one_pass(spark):
    """no shuffle but the one that spreads the texts; rows with one id stay apart."""
    from casegrid.functions import extract
    from casegrid.plans import cases

    rows = [(1, "Dx: Pertussis (SNOMED 27836007)" + "\n" * 200 + "The CBC was normal"), (1, None), (2, "")]
    got = extract.extract_chunked(spark.createDataFrame(rows, "id int, text string"), cases.TERMS, cases.ENTRIES, "id", "text", most=200).collect()
    assert sorted((r["id"], [(m["code"], m["chunk_index"]) for m in r["merged"]]) for r in got) == [(1, []), (1, [("27836007", 0), ("600-7", 2)]), (2, [])]
    plan = _plan(spark, "t37_chunked_run")
    assert plan.count("Exchange") == 1 and "REPARTITION_BY_NUM" in plan


def test_copies_of_a_text_are_read_once(spark):
    """each different text of a batch is read once, and rows get the matches of their own text."""
    import pyarrow as pa

    from casegrid.functions import extract
    from casegrid.plans import cases

    different, place = extract.distinct_texts(pa.array(["b", None, "a", "b", ""]))
    assert [different[int(k)].as_py() for k in place] == ["b", "", "a", "b", ""] and len(different) == 3
    texts = ["whooping cough and the CBC", "", "penicillin", None, "whooping cough and the CBC"]
    got = extract.extract(spark.createDataFrame(list(enumerate(texts)), "id int, text string").coalesce(1), cases.TERMS, [], "id").collect()
    assert sorted((r["id"], r["pos"], r["code"]) for r in got) == [(0, 0, "27836007"), (0, 1, "600-7"), (2, 0, "70618"), (4, 0, "27836007"), (4, 1, "600-7")]
    assert "REPARTITION_BY_NUM" in _plan(spark, "t15_cascade_cases")


def test_chunks_of_a_stream_leave_without_the_stream(spark):
    """what is exploded is the list of chunks; the whole stream isn't copied beside each."""
    from casegrid.plans import sources

    turns = spark.createDataFrame([(2, 1, "word " * 40), (3, 1, "")], "conv_id long, turn int, text string")
    made = sources.recorded(turns)
    node = made._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode(transform(" in node
    by = {}
    for r in made.orderBy("transcript", "k").collect():
        by.setdefault(r["transcript"], []).append(bytes(r["chunk"]))
    assert all(len(c) == sources.CHUNK for parts in by.values() for c in parts[:-1]) and b"".join(by["2-1"]).endswith(b"data: [DONE]\n\n")


def test_bundles_are_read_within_their_row(spark):
    """what is read back of a bundle isn't exploded and aggregated; odd bundles hold no entities."""
    from casegrid.operators import interop

    rows = [(1, '{"entry":[{"resource":{"resourceType":"Observation","id":"observation-8462-4","category":[{"coding":[{"code":"x"}]},{"coding":[{"code":"vital-signs"}]}],"code":{"coding":[{"code":"85354-9"}]},"component":[{"code":{"coding":[{"code":"8480-6"}]}},{"code":{"coding":[{"code":"8462-4"}]}}]}},{"resource":{"resourceType":"Observation","code":{"coding":[{"code":"1-1"}]}}},{"resource":{"resourceType":"Condition"}},{"resource":{"resourceType":"MedicationRequest","medicationCodeableConcept":{"coding":[{"code":"7"}]}}}]}'), (2, "["), (3, "{}"), (4, None)]
    got = interop.bundle_entities(spark.createDataFrame(rows, "id int, j string"), "id", "j").collect()
    assert sorted((r["id"], r["pos"], r["axis"], r["code"]) for r in got) == [(1, 0, "vital", "8462-4"), (1, 1, "lab", "1-1"), (1, 3, "medication", "7")]
    assert "Generate" not in _plan(spark, "k12_bundle_json")


def test_steps_of_traces_are_dealt_out_by_their_number(spark, tmp_path, monkeypatch):
    """tasks hold about so many steps at any size, and no step's unread parts are sorted with it."""
    from casegrid.plans import dialogue
    from casegrid.session import spread

    assert spread(spark.range(1000), "id", 10).rdd.getNumPartitions() == 100
    monkeypatch.setattr(dialogue, "STEPS_A_TASK", 50)
    plan = _plan(spark, "k16_trace_turns")
    assert "REPARTITION_BY_NUM" in plan and not [line for line in plan.splitlines() if "Window [" in line and ("step_content" in line or "step_result" in line)]
