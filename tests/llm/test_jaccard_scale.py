"""Round 3: what the join writes, moves and repeats."""

import random

import numpy as np

from casegrid.llm import components, jaccard_join


def counted(monkeypatch, module, into):
    kept = module.stored

    def stored(df, spark, name, *more, **named):
        into.append((name, df.columns))
        return kept(df, spark, name, *more, **named)

    monkeypatch.setattr(module, "stored", stored)


def test_few_links_need_no_rounds(spark, monkeypatch):
    rng = random.Random(4)
    pairs = [(k, k + 1) for k in range(60)] + [(100 + rng.randrange(40), 100 + rng.randrange(40)) for _ in range(30)]
    links = spark.createDataFrame(pairs, "a long, b long").repartition(3).cache()
    tables = []
    counted(monkeypatch, components, tables)
    few = {(r["node"], r["label"]) for r in components.connected(spark, links).collect()}
    assert [n for n, _ in tables].count("links") == 2
    monkeypatch.setattr(components, "EDGES", 0)  # the driver's rounds; to their end
    assert {(r["node"], r["label"]) for r in components.connected(spark, links).collect()} == few
    assert {k: v for k, v in few if k <= 60} == dict.fromkeys(range(61), 0)
    u, v = components.stars(np.array([5, 9, 7]), np.array([4, 5, 2]))
    assert sorted(zip(u.tolist(), v.tolist())) == [(5, 4), (7, 2), (9, 4)]


def test_later_links_join_old_labels(spark):
    labels = spark.createDataFrame([(1, 1), (2, 1), (5, 5), (6, 5)], "node long, label long")
    links = spark.createDataFrame([(2, 6), (8, 9), (0, 9)], "a long, b long")
    got = {r["node"]: r["label"] for r in jaccard_join.relabelled(spark, labels, links).collect()}
    assert got == {1: 1, 2: 1, 5: 1, 6: 1, 0: 0, 8: 0, 9: 0}


def test_op9_signatures_are_not_stored(spark, monkeypatch):
    """Signatures were written to the shared folder and then shuffled: twice their bytes of disk."""
    tables = []
    counted(monkeypatch, jaccard_join, tables)
    rows = [(k, f"w{k} " + " ".join(f"t{i}" for i in range(80)) + f" e{k}") for k in range(5)]
    got = jaccard_join.components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["component_id"] for r in got} == {0}
    assert not [n for n, columns in tables if "data" in columns]


def open_rows(families):
    """Texts that share most segments: families of two, about the limit from each other."""
    rng = random.Random(families)
    rows = []
    for family in range(families):
        own = [f"w{k}" for k in range(160)]
        for k in rng.sample(range(20, 160), 3):
            own[k] = f"f{family}x{k}"
        for copy in range(2):
            ws = list(own)
            for k in rng.sample(range(20, 160), copy):
                ws[k] = f"c{family}x{copy}x{k}"
            rows.append((family * 10 + copy, " ".join(ws)))
    return rows


def linked_least(rows):
    shingler = jaccard_join.Shingler(5)
    sets = [shingler(text) for _, text in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if jaccard_join.linked(sets[i], sets[j], 75)]
    node, top = components.stars(*(np.array(x) for x in zip(*pairs)))  # rows are in order of their ids
    return {d: rows[t][0] for d, t in [(d, dict(zip(node.tolist(), top.tolist())).get(k, k)) for k, (d, _) in enumerate(rows)]}


def test_op9_no_pair_of_an_open_group_is_stored(spark, monkeypatch):
    """Pairs that failed were written for each group that they met in and joined with all groups' cells again every round."""
    made = {}
    kept = jaccard_join.stored

    def stored(df, session, name, *more, **named):
        table = kept(df, session, name, *more, **named)
        if name in ("jaccard-open", "jaccard-cross", "jaccard-links"):
            made.setdefault(name, []).append(table.count())
        return table

    monkeypatch.setattr(jaccard_join, "stored", stored)
    rows = open_rows(24)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.components(df).collect()}
    want = linked_least(rows)
    assert got == want and 1 < len(set(want.values())) < len(rows)
    assert "jaccard-cross" not in made
    memberships, of_clusters = made["jaccard-open"]
    assert of_clusters <= len(rows) and sum(made["jaccard-links"]) <= 3 * len(rows)


def test_op9_equal_memberships_are_one_group(spark):
    """They were one group in each bucket that found them, so a set was a member as often as it had signatures."""
    s = jaccard_join.Settings()
    rows = [(k, f"w{k} " + " ".join(f"t{i}" for i in range(160)) + f" e{k}") for k in range(8)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    both = jaccard_join.groups_of(jaccard_join.described(df, s, 40, jaccard_join.drawn_sample(df, s)), s, 40)
    found = both.where("kind = 1").select("a", "b").distinct().collect()
    groups = {}
    for r in found:
        groups.setdefault(r["a"], set()).add(r["b"])
    assert groups and len(groups) == len({frozenset(x) for x in groups.values()})
