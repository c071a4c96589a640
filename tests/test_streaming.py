"""Streaming forms against the same rules over all rows at once: late rows, restarts, repeated and broken batches."""

import random
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from casegrid.streaming import store
from casegrid.streaming.ingest import ingest
from casegrid.streaming.status_table import Outbox, StatusTable

T0 = datetime(2024, 1, 1)
EVENT = "event_id long, user_id long, event_type string, ts timestamp"


def values(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def by_window(rows, window):
    want = {}
    for e, u, kind, ts in rows:
        before = [x for x in rows if x[1] == u and (x[3], x[0]) < (ts, e)]
        want[e] = (any(x[2] == kind and timedelta(0) < ts - x[3] <= window for x in before), max(before, key=lambda x: (x[3], x[0]))[0] if before else None)
    return want


def run(spark, rows, files, build, tmp_path, name="a"):
    """Rows dealt to so many files, one file a trigger, in the order of ``rows``; the newest output of an event counts."""
    step = -(-len(rows) // files)
    for k in range(files):
        spark.createDataFrame(rows[k * step : (k + 1) * step], EVENT).coalesce(1).write.parquet(str(tmp_path / f"{name}-in/part={k:03d}"))
    got = store.replay_updates(spark, str(tmp_path / f"{name}-in/*"), EVENT, lambda s: build(s), str(tmp_path / f"{name}-out"), str(tmp_path / f"{name}-cp"), ["event_id"], max_files=1)
    return got


def test_flags_links_and_queues(spark, tmp_path):
    rows = [(1, 5, "a", T0), (2, 5, "a", T0 + timedelta(days=1)), (3, 5, "a", T0 + timedelta(days=5)), (4, 7, "error", T0), (5, 8, "error", T0), (6, None, None, T0), (7, None, None, T0 + timedelta(hours=1))]
    got = run(spark, rows, 1, lambda s: ingest(s, timedelta(days=2), out_of_state=F.col("user_id") == 7, flagged=F.col("event_type") == "error"), tmp_path)
    assert values(got.select("event_id", "seen", "prior_id", "queue"), "event_id") == [
        (1, False, None, "Processed"), (2, True, 1, "Graylist"), (3, False, 2, "Processed"), (4, False, None, "OutOfState"), (5, False, None, "Flagged"),
        (6, False, None, "Processed"), (7, True, 6, "Graylist"),
    ]


def test_shuffled_files_equal_the_window(spark, tmp_path):
    """Late rows get their link and flag, and put right what came out before."""
    rng = random.Random(2)
    rows = [(k, k % 3, rng.choice("ab"), T0 + timedelta(hours=rng.choice([0, 1, 1, 2, 30, 60, 61, 61, 200]))) for k in range(60)]
    rows += [(100 + k, 9, rng.choice("abc"), T0 + timedelta(minutes=rng.randrange(20_000))) for k in range(80)]
    rng.shuffle(rows)
    got = run(spark, rows, 6, lambda s: ingest(s, timedelta(days=2), late=timedelta(days=20)), tmp_path)
    assert {r["event_id"]: (r["seen"], r["prior_id"]) for r in got.collect()} == by_window(rows, timedelta(days=2))


def test_state_is_bounded_by_the_window(spark, tmp_path):
    """In order, with no lateness: still equal, with a link over a gap longer than the window."""
    rows = [(k, 1, "ab"[k % 2], T0 + timedelta(hours=3 * k + (500 if k > 20 else 0))) for k in range(40)]
    got = run(spark, rows, 4, lambda s: ingest(s, timedelta(hours=10), late=timedelta(0)), tmp_path)
    assert {r["event_id"]: (r["seen"], r["prior_id"]) for r in got.collect()} == by_window(rows, timedelta(hours=10))

    class Map(dict):
        getValue, removeKey, updateValue = dict.__getitem__, dict.__delitem__, dict.__setitem__

    from casegrid.streaming.ingest import Cases

    state = Map({(s,): ([(s * 10 + k, s * 10 + k, "a", "", False, None) for k in range(3)],) for s in range(50)})
    cases = Cases(state, 10)
    cases.forget(455)
    cases.save()
    assert sorted(state) == [(s,) for s in range(44, 50)] and len(state[(44,)][0]) == 1


def test_calls_to_state_grow_with_chunks():
    """A subject's cases were written one call a span, about one a case; order, neighbours and what is kept stay right in any order of arrival."""
    from casegrid.streaming.ingest import CHUNK, Cases

    class Map(dict):
        calls = 0
        getValue, removeKey = dict.__getitem__, dict.__delitem__

        def updateValue(self, key, value):
            self.calls += 1
            self[key] = value

    rng = random.Random(8)
    rows = [(at, k, "a", "", False, None) for k, at in enumerate(rng.choices(range(-500, 6000), k=900))]
    for ordered in (True, False):
        state, known = Map(), []
        for batch in (rows[:300], rows[300:600], rows[600:]):
            cases = Cases(state, 10)
            for c in sorted(batch) if ordered else batch:
                below, above = [x for x in known if x[:2] < c[:2]], [x for x in known if x[:2] > c[:2]]
                assert cases.neighbours(*c[:2]) == (max(below, default=None), min(above, default=None))
                cases.add(c)
                known.append(c)
                assert cases.at_place(*c[:2]) == [c] and set(cases.at_time(c[0], "a")) == {x for x in known if x[0] == c[0]}
            cases.save()
        assert state.calls < 60
        kept = [c for key in sorted(state) for c in state[key][0]]
        assert kept == sorted(rows) and all(len(v[0]) <= CHUNK for v in state.values())
        cases = Cases(state, 10)
        cases.forget(3000)
        cases.save()
        kept = [c for key in sorted(state) for c in state[key][0]]
        newer = sorted(c for c in rows if c[0] >= 3000)
        assert kept[-len(newer) :] == newer and kept[-len(newer) - 1] == max(c for c in rows if c[0] < 3000) and len(kept) < len(newer) + CHUNK


def table_of(spark, path, buckets=8):
    t = StatusTable(spark, str(path), "id", "status", "at", ["P", "F", "S"], buckets)
    t.create(spark.createDataFrame([(k, "new", 0, f"n{k}") for k in range(40)], "id long, status string, at long, name string"))
    return t


def parts(path):
    return {str(p.relative_to(path)): p.stat().st_mtime_ns for p in Path(path).rglob("*.parquet")}


UPDATE = "id long, status string, at long"


def test_merging_stream(spark, tmp_path):
    rng = random.Random(4)
    t = table_of(spark, tmp_path / "t")
    updates = [(rng.randrange(50), rng.choice(["P", "F", "S", "X", None]), rng.randrange(1, 1000)) for _ in range(200)]
    for k in range(4):
        spark.createDataFrame(updates[k * 50 : (k + 1) * 50], UPDATE).coalesce(1).write.parquet(str(tmp_path / f"in/part={k}"))
    stream = lambda n: spark.readStream.schema(UPDATE).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / f"in/part={n}"))
    t.follow(stream("[01]"), str(tmp_path / "cp"))
    t.follow(stream("[0123]"), str(tmp_path / "cp"))  # a restart goes on with the files that are new
    want = {k: "new" for k in range(40)}
    newest = {}
    for i, s, at in updates:
        if i < 40 and s in ("P", "F", "S"):
            newest[i] = max(newest.get(i, (0, "")), (at, s))
    want.update({i: s for i, (_, s) in newest.items()})
    assert dict(values(t.rows().select("id", "status"), "id")) == want
    assert t.rows().where("name = concat('n', id)").count() == 40
    seen = t.batches().agg(F.sum("invalid"), F.sum("missing"), F.count("*")).first()
    assert tuple(seen) == (sum(s not in ("P", "F", "S") for _, s, _ in updates), sum(i >= 40 and s in ("P", "F", "S") for i, s, _ in updates), 4)
    assert t.rejects().where("reject = 'not found'").count() == seen[1]


def test_repeated_and_broken_batches(spark, tmp_path):
    t = table_of(spark, tmp_path / "t")
    one = spark.createDataFrame([(3, "P", 5), (3, "F", 4), (99, "P", 1), (4, "X", 9)], UPDATE)
    before = parts(tmp_path / "t/rows")
    t.merge(one, 0)
    after = parts(tmp_path / "t/rows")
    changed = {p.split("/")[0] for p, _ in set(before.items()) ^ set(after.items())}
    assert len(changed) == 1  # the other buckets keep their files
    assert values(t.batches().select("updated", "stale", "invalid", "missing")) == [(1, 0, 1, 1)]
    t.merge(one, 0)
    assert parts(tmp_path / "t/rows") == after  # a batch that is repeated changes nothing
    t.merge(spark.createDataFrame([(3, "S", 5), (5, "S", 1)], UPDATE), 1)
    assert values(t.batches().where("batch = 1").select("updated", "stale")) == [(1, 1)]

    two = spark.createDataFrame([(k, "F", 10) for k in range(40)], UPDATE)
    t._prepare(two, 2, f"{t.path}/redo/batch=2")
    for p in list(Path(tmp_path / "t/rows").glob("bucket=*"))[:3]:  # it broke off while buckets were being replaced
        for f in p.iterdir():
            f.unlink()
    t.merge(two, 2)
    assert t.rows().where("status = 'F'").count() == 40 and values(t.batches().where("batch = 2").select("updated")) == [(40,)]
    empty = spark.createDataFrame([], UPDATE)
    t.merge(empty, 3)
    assert values(t.batches().where("batch = 3").select("updated", "invalid", "missing")) == [(0, 0, 0)] and t.rows().count() == 40


def test_outbox(spark, tmp_path):
    schema = "case_id int, status string, created_at int"
    df = spark.createDataFrame([(1, "pending", 2), (2, "pending", 1), (3, "failed", 0), (4, "pending", 3)], schema)
    box = Outbox(spark, str(tmp_path / "log"), "case_id", "created_at", "http://here")
    assert values(box.states(df).select("case_id", "status", F.size("sync_history")), "case_id")[0] == (1, "pending", 0)
    sent = []

    def send(rows):
        sent.append([r["case_id"] for r in rows.orderBy("created_at").collect()])
        return rows.withColumns({"succeeded": F.col("case_id") != 2, "message": F.lit("m")})

    box.drain(send)(df, 0)
    want = [(1, "submitted", 1), (2, "failed", 1), (3, "failed", 0), (4, "submitted", 1)]
    state = lambda: values(box.states(df).select("case_id", "status", F.size("sync_history")), "case_id")
    assert state() == want and sent == [[2, 1, 4]]
    box.drain(send)(df, 0)  # the batch is repeated
    box.drain(send)(df, 1)  # its rows come again: none is sent twice, failed ones aren't retried
    assert state() == want and sent[1:] == [[]]

    more = spark.createDataFrame([(5, "pending", 1), (6, "pending", 2)], schema)

    def broken(rows):
        sent.append([r["case_id"] for r in rows.orderBy("created_at").collect()])
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        box.drain(broken)(more, 2)
    assert values(box.states(more).select("case_id", "status"), "case_id") == [(5, "syncing"), (6, "syncing")]
    box.drain(send)(more, 2)  # what was in syncing is reported, not sent again
    assert values(box.states(more).select("case_id", "status", "sync_history.message"), "case_id") == [(5, "interrupted", ["interrupted while syncing"]), (6, "interrupted", ["interrupted while syncing"])]
    assert sent[2:] == [[5, 6]]
    record = box.states(df).where("case_id = 2").first()["sync_history"][0]
    assert (record["succeeded"], record["endpoint"]) == (False, "http://here") and record["attempted_at"] is not None


def test_windowed_rate(spark, tmp_path):
    spark.createDataFrame([(T0,), (T0 + timedelta(milliseconds=900),), (T0 + timedelta(seconds=1),)], "ts timestamp").write.parquet(str(tmp_path / "in"))
    got = store.replay_updates(spark, str(tmp_path / "in"), "ts timestamp", lambda s: store.windowed_rate(s, "ts"), str(tmp_path / "out"), str(tmp_path / "cp"), ["start"])
    assert [r["n"] for r in got.orderBy("start").collect()] == [2, 1]
