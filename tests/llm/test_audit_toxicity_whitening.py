"""Operators 11 to 13 against brute force: nulls, empty and long texts, ties and repeated rows, empty tables, clashing names."""

import itertools
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from casegrid.llm import filter_audit, oracle, queries, toxicity, whitening
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

# --- 11 -------------------------------------------------------------------------------

LABELS = "doc_id long, quality int, toxic int"
AUDITED = "doc_id long, text string, source string, part string, n long, filter int, state int, fails int, carried_row int"


def audit_rows():
    rng = random.Random(8)
    vocab = [a + b for a in "bcdfgh" for b in ("a", "en", "or", "ist")] + ["Été", "NAÏVE", "x#", "100%", "A", "B"]
    rows = []
    for k in range(70):
        text = " ".join(rng.choice(vocab[: rng.choice([8, 24, 30])]) for _ in range(rng.choice([3, 49, 50, 51, 90])))
        rows.append((k, text, rng.choice(["a", "b", None, ""])))
    rows += [(100 + k, rows[k % 3][1], "a") for k in range(9)]
    rows += [(7, rows[7][1], rows[7][2]), (None, rows[5][1], "b"), (None, "only here", "b"), (None, None, None), (110, None, "a"), (111, "", "a"), (112, " \n\t", "c")]
    rows += [(113, "wörd Ab " * 100_000, "c"), (114, "ÀÉ" * 30 + " " + "ok " * 60, "c"), (115, "A" + "b" * 19, "c"), (116, "A" + "b" * 18, "c")]
    return rows


def audit_by_hand(rows, labels):
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    key = lambda d: (d is None, d or 0)  # noqa: E731  null comes last
    first = {}
    for d, t, _ in rows:
        first[t or ""] = min(first.get(t or "", key(d)), key(d))
    docs = []
    for d, t, s in rows:
        t = t or ""
        ws = re.findall(r"[^\x20\x09-\x0D]+", t)
        docs.append((s or "", {
            "A": len(ws) < 50, "B": 100 * len(set(ws)) < 65 * len(ws), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": key(d) > first[t],
        }, d in good, d in toxic))
    out = {}
    for part in {p for p, *_ in docs}:
        own = [d for d in docs if d[0] == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, f in enumerate(order):
                gone = [d for d in left if d[1][f]]
                left = [d for d in left if not d[1][f]]
                shapley[f] += len(gone)
                out[part, "".join(order), step + 1] = [
                    len(left), len(gone), sum(d[1][f] for d in own) - len(gone), sum(d[1][f] and sum(d[1].values()) == 1 for d in own), sum(d[2] for d in gone), sum(d[3] for d in gone), f,
                ]
        for k, v in out.items():
            if k[0] == part:
                v[-1] = shapley[v[-1]]
    return {k: tuple(v) for k, v in out.items()}


def test_op11_equals_brute_force_and_sql(spark, tmp_path):
    import duckdb

    rows = audit_rows()
    labels = [(k, k % 2, int(k % 5 == 0)) for k in range(0, 60, 2)] + [(3, None, 1), (4, 0, 0), (4, 1, 1), (None, 1, 1), (999, 1, 1), (5, None, None)]
    docs = spark.createDataFrame([(*r, "p", 1, 2, 3, 4, 5) for r in rows], AUDITED).repartition(4)
    marks = spark.createDataFrame(labels, LABELS)
    got = filter_audit.audit(docs, marks)
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    mine = {tuple(r)[:3]: tuple(r)[3:] for r in got.collect()}
    want = audit_by_hand(rows, labels)
    assert mine == want and len(mine) == 600 * 4
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    marks.write.parquet(str(tmp_path / "labels.parquet"))
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    rel = con.sql(oracle.ORACLE["op11_filter_audit"]).select("part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley")
    assert {r[:3]: r[3:] for r in rel.fetchall()} == want
    assert filter_audit.audit(docs.limit(0), marks).count() == 0
    alone = filter_audit.audit(docs, marks.limit(0), part="part").collect()
    assert len(alone) == 600 and {r["part"] for r in alone} == {"p"} and not any(r["good_lost"] or r["toxic_lost"] for r in alone)


def test_op11_walks_each_set_once(spark, tmp_path):
    root = spark.createDataFrame([("p", k, False, False, 1) for k in range(32)], "part string, fails int, good boolean, toxic boolean, n long")
    assert filter_audit.walk(root, 5, str(tmp_path / "edges")) == 32
    edges = spark.read.parquet(str(tmp_path / "edges"))
    assert edges.count() == edges.select("state", "filter").distinct().count() == 80
    assert edges.where("removed <> before / 2 or before <> shiftleft(1, 5 - bit_count(state))").count() == 0
    assert not spark.sparkContext._jsc.getPersistentRDDs()


# --- 12 -------------------------------------------------------------------------------


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_op12_automata_equal_brute_force():
    rng = random.Random(0)
    terms = ["ox", "scum", "loser", "idiot", "stupid", "worthless", "disgusting", "aaaa", "abababab", "ñandúes", "été"]
    trie = toxicity.Trie(sorted(terms))
    lookup = toxicity.Lookup(dict.fromkeys(terms, 1.0), {}, {})
    for _ in range(4000):
        letters = list(rng.choice(terms))
        for _ in range(rng.randrange(4)):
            op, i = rng.randrange(3), rng.randrange(len(letters) + 1)
            if op == 0:
                letters.insert(i, rng.choice("abcdeiorstuñ"))
            elif i < len(letters):
                letters[i : i + 1] = [rng.choice("abcdeiorstu")] if op == 1 else []
        word = "".join(letters)
        near = [(distance(word, t), t) for t in terms if toxicity.allowed(t) and distance(word, t) <= toxicity.allowed(t)]
        assert toxicity.nearest(word, trie) == min(near, default=None)
        if len(word) >= 3:
            got = lookup.find(word)
            assert got == ((word, 0) if word in terms else min(near)[::-1] if near else None)
    lookup = toxicity.Lookup({"loser": 2.0}, {"mean": 3.0}, {"closer": 4})
    assert [lookup.of(w) for w in (b"LOSER!!", b"losers", b"closer", b"meanest", b"l.o.s.e.r", b"rose")] == [("loser", 0), ("loser", 1), None, ("mean", 0), ("loser", 1), None]


def toxic_corpus(n=400):
    rng = random.Random(5)
    clean = [a + b + c for a in ("ta", "mo", "li", "re") for b in ("na", "so", "ti", "lu") for c in ("", "r", "nd", "ke")]
    rows = []
    for k in range(n):
        ws = [rng.choice(clean) for _ in range(rng.randrange(20, 120))]
        bad = k % 5 == 0
        if bad:
            for _ in range(rng.randrange(2, 6)):
                ws[rng.randrange(len(ws))] = rng.choice(["dreckig", "vileworm", "blockhead", "filth", *(f"gruzz{e}" for e in ("a", "en", "ist", "or"))])
        rows.append((k, " ".join(ws), int(bad)))
    copied = rows[5][1].split()  # a toxic text that is copied around: its own words are no terms
    copied[3:6] = ["passage", "copied", "around"]
    rows += [(n + k, " ".join([*copied[:-1], f"end{k}"]), 1) for k in range(40)]
    return rows


def test_op12_learns_terms_stems_and_contexts(spark):
    rows = toxic_corpus()
    docs = spark.createDataFrame([(*r[:2], 1.0, "x") for r in rows], "doc_id long, text string, toxicity double, carried_row string").repartition(3)
    labels = spark.createDataFrame([(d, t) for d, _, t in rows] + [(None, 1), (1, None)], "doc_id long, toxic int")
    model = toxicity.learn(docs, labels)
    assert {"dreckig", "vileworm", "blockhead", "filth"} <= set(model.weights) and any("gruzz".startswith(s) or s == "gruzz" for s in model.stems)
    assert not {"passage", "copied", "around"} & set(model.weights)
    again = toxicity.learn(docs, labels)
    assert again.weights == model.weights and np.array_equal(again.theta, model.theta)
    base = "tana mosor litind reluke " * 10
    extra = [
        (1001, base + "you dreckig blockhead filth", 1), (1002, base + "you blokchead vilewrm dreckik filfth", 1), (1003, base + "G.R.U.Z.Z gruzzenheimer, FILTH!! vileworm", 1),
        (1004, base, 0), (1005, base + 'she said the word "dreckig" is an insult', 0), (1006, "", 0), (1007, None, 0), (1008, base + "> he wrote: vileworm", 0),
    ]
    seen = spark.createDataFrame([(*r[:2], 1.0, "x") for r in [*rows, *extra, extra[0]]], docs.schema)
    out = toxicity.score(seen, model)
    assert out.columns == ["doc_id", "carried_row", "toxicity"]
    got = {}
    for r in out.collect():
        got.setdefault(r["doc_id"], []).append(r["toxicity"])
    assert len(got[1001]) == 2 and got[1001][0] == got[1001][1] and got[1006] == got[1007] == [min(x[0] for x in got.values())]
    wrong = [(d, got[d][0]) for d, _, t in [*rows, *extra] if (got[d][0] >= 0.5) != (t == 1)]
    assert not wrong


def test_op12_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "a text"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    scored = toxicity.score(docs, toxicity.learn(docs, none)).collect()
    assert len(scored) == 2 and all(0 < r["toxicity"] < 0.1 for r in scored)
    clean = spark.createDataFrame([(1, 0)], none.schema)
    assert all(r["toxicity"] < 0.1 for r in toxicity.score(docs, toxicity.learn(docs, clean)).collect())
    assert toxicity.score(docs.limit(0), toxicity.learn(docs, none)).count() == 0


def test_op12_long_texts_and_quotes():
    lookup = toxicity.Lookup({"loser": 2.0}, {}, {})
    settings = toxicity.Settings()
    x = toxicity.features(("thing " * 300_000 + "loser " * 1000).encode(), lookup, settings)
    assert x[1] == pytest.approx(np.log1p(2000)) and x[2] == x[3] == 0
    share = lambda t: toxicity.features(t.encode(), lookup, settings)
    assert share("the loser")[3] == 0 < share('"loser"')[3] < share('they said "a loser" once')[3]
    assert share("« loser »")[3] > 0 and share("> loser")[3] > 0 and share('"a" loser')[3] == 0 and share("you said loser")[3] < share("they said loser")[3]


def test_op12_query_holds_out(spark, sf_dir):
    got = queries.op12_toxicity(spark, sf_dir).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == int(r["score"] >= 0.5) and 0 <= r["score"] <= 1 for r in got)


# --- 13 -------------------------------------------------------------------------------

VECTORS = StructType([StructField("vec_id", LongType()), StructField("embedding", ArrayType(DoubleType())), StructField("vector", StringType()), StructField("code", StringType())])


def whitened_by_hand(vectors, k):
    """Exact sums and covariance by fractions, solved in doubles."""
    x = [[int(np.floor(64 * c)) + 1_000_000 for c in v] for v in vectors]
    fit = sorted(set(map(tuple, x)))
    n, d = len(fit), len(fit[0])
    s = [sum(v[j] for v in fit) for j in range(d)]
    z = [[n * v[j] - s[j] for j in range(d)] for v in fit]
    cov = np.array([[float(Fraction(sum(r[i] * r[j] for r in z), n**3)) for j in range(d)] for i in range(d)])
    values, basis = np.linalg.eigh(cov)
    values, basis = values[::-1][:k], basis[:, ::-1][:, :k]
    centred = np.array([[float(Fraction(n * v[j] - s[j], n)) for j in range(d)] for v in x])
    return n, [sum((n * v[j] - s[j]) ** 2 for j in range(d)) for v in x], centred @ basis / np.sqrt(values), values / np.trace(cov)


def test_op13_equals_exact_arithmetic(spark):
    rng = np.random.default_rng(3)
    scales = np.array([40.0, 9, 5, 3, 2, 1.5, 1, 0.5])
    base = rng.normal(size=(150, 8)) * scales + 1000
    base = base.tolist()
    good = [*base, *([base[0]] * 40), [c + 1e-9 for c in base[1]]]
    bad = [None, [], [None] * 8, [float("nan")] * 8, [float("inf")] + [0.0] * 7, [1e30] * 8, [1.0] * 7, [1.0, None] + [0.0] * 6]
    rows = [(k, v, "v", "c") for k, v in enumerate(good)] + [(None, good[3], "v", "c"), (0, good[0], "v", "c")] + [(1000 + k, v, "v", "c") for k, v in enumerate(bad)]
    df = spark.createDataFrame(rows, VECTORS).repartition(5)
    got = whitening.whiten(df, settings=whitening.Settings(components=5)).collect()
    n, deviation, white, explained = whitened_by_hand(good, 5)
    assert len(got) == 5 * (len(good) + 2) and {r["n"] for r in got} == {n} and {r["vec_id"] for r in got} == {*range(len(good)), None}
    mine = np.zeros((len(good), 5))
    for r in got:
        if r["vec_id"] is not None:
            mine[r["vec_id"], r["component"] - 1] = r["whitened"]
            assert r["deviation"] == deviation[r["vec_id"]]
        assert abs(r["explained"] / explained[r["component"] - 1] - 1) < 1e-12
    signs = np.sign((mine * white).sum(axis=0))
    assert np.abs(mine * signs - white).max() < 1e-9
    assert max(r["identity_error"] for r in got) < 1e-12 and len({r["identity_error"] for r in got}) == 1


def test_op13_small_and_flat_tables(spark):
    schema = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None)], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(k, [1.0, 2.0]) for k in range(9)], schema)).count() == 0
    flat = whitening.whiten(spark.createDataFrame([(k, [float(k), 5.0]) for k in range(9)], schema)).collect()
    assert len(flat) == 9 and {r["component"] for r in flat} == {1} and {r["explained"] for r in flat} == {1.0}
    white = sorted(r["whitened"] for r in flat)
    assert np.allclose(white, (np.arange(9) - 4) / np.sqrt(60 / 9))


def test_op13_compensated_sums():
    """Blocks are exact, and double-double sums keep what doubles lose; wide integers go by Python's."""
    rng = np.random.default_rng(1)
    for top in (2**10, 2**30, 2**55):
        z = rng.integers(-top, top, size=(300, 4))
        want = [[sum(int(a) * int(b) for a, b in zip(z[:, i], z[:, j])) for j in range(4)] for i in range(4)]
        high, low = whitening.outer_sums(iter([z[:100], z[100:]]), 4)
        exact = max(abs(Fraction(float(high[i, j])) + Fraction(float(low[i, j])) - want[i][j]) / max(1, abs(want[i][j])) for i in range(4) for j in range(4))
        assert exact < Fraction(1, 2**95)
    high, low = whitening.dd_add(np.array([1e16]), np.array([0.0]), np.array([1.0]))
    assert Fraction(high[0]) + Fraction(low[0]) == 10**16 + 1
    wide = whitening.Centre(2**40, np.array([0]), np.array([3])).numerators(np.array([[2**30], [-1]]))
    assert wide.dtype == object and wide[0, 0] == 2**70 - 3
    assert whitening.deviations(wide) == [None, None] and whitening.deviations(np.array([[3, 4]])) == [25]
    codes = whitening.packed(np.array([[1, -128], [128, 0], [-(2**31), 2**31 - 1]]))
    assert [len(c) for c in codes] == [3, 5, 9] and [int(c[0]) for c in codes] == [1, 2, 4]


def test_op13_merges_many_partials(spark, monkeypatch):
    monkeypatch.setattr(whitening, "LAST_BYTES", 64)
    monkeypatch.setattr(whitening, "MERGE", 3)
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(rng.normal(size=(200, 3)) * 10)], "vec_id long, embedding array<double>")
    many = whitening.whiten(df.repartition(20)).select("vec_id", "component", "whitened").collect()
    monkeypatch.undo()
    few = whitening.whiten(df.coalesce(1)).select("vec_id", "component", "whitened").collect()
    a, b = ({(r[0], r[1]): r[2] for r in rows} for rows in (many, few))
    assert a.keys() == b.keys() and max(abs(abs(a[k]) - abs(b[k])) for k in a) < 1e-10
