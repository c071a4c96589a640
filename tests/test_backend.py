"""The batched call: a backend that fails on some batches, is late, or answers too little loses no row and doubles none."""

import threading
import time

import pytest
from pyspark.sql import functions as F

from casegrid.operators.backend import Policy, called

QUICK = Policy(batch_rows=8, timeout=5.0, retries=1, pause=0.01)


def upper(texts):
    return [t.upper() for t in texts]


def picky(texts):
    if any("bad" in t for t in texts):
        raise RuntimeError("can't take that")
    return upper(texts)


def flaky(texts, seen={}):  # noqa: B006  one dictionary a worker: the first call of each batch fails
    key = (threading.get_native_id() and texts[0], len(texts))
    seen[key] = seen.get(key, 0) + 1
    if seen[key] == 1:
        raise OSError("lost")
    return upper(texts)


def short(texts):
    return upper(texts)[: max(1, len(texts) - 1)] if len(texts) > 2 else upper(texts)


def slow(texts):
    if "sleep" in texts:
        time.sleep(3)
    return upper(texts)


@pytest.fixture(scope="module")
def rows(spark):
    texts = [f"t{k}" for k in range(50)] + ["bad 1", None, "bad 2", "", "t1"]
    return spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3).cache()


def result(df):
    got = [tuple(r) for r in df.orderBy("id").collect()]
    assert [g[0] for g in got] == list(range(55))
    return got


@pytest.mark.parametrize("backend", [upper, flaky, short])
def test_every_row_gets_its_answer(rows, backend):
    for k, answer, error, calls in result(called(rows, "id", "text", backend, QUICK)):
        assert (answer is None) == (k == 51) and error == ("no text" if k == 51 else None) and (calls > 0) == (k != 51)
        assert answer is None or answer == {50: "BAD 1", 52: "BAD 2", 53: "", 54: "T1"}.get(k, f"T{k}")


def test_a_bad_row_costs_no_other(rows):
    got = result(called(rows, "id", "text", picky, QUICK))
    assert [k for k, a, e, _ in got if a is None] == [50, 51, 52] and got[50][2] == "RuntimeError: can't take that" and got[50][3] > 2
    assert got[0][1] == "T0"


def test_late_calls(spark):
    df = spark.createDataFrame([(1, "sleep"), (2, "x")], "id long, text string").coalesce(1)
    got = {r["id"]: (r["answer"], r["error"]) for r in called(df, "id", "text", slow, Policy(batch_rows=2, timeout=0.3, retries=0)).collect()}
    assert got == {1: (None, "no answer within 0.3 s"), 2: ("X", None)}
    assert called(df.where(F.lit(False)), "id", "text", upper).count() == 0
