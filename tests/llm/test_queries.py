"""The registered queries and the pipeline: on the smallest tables, and on a fixture against brute force."""

import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
from casegrid.llm import line_crf, line_rules, queries
from casegrid.llm.common import documents
from tokenizers import Tokenizer
from tests.llm.test_operators import WORD_BPE, brute_components, fixture_rows


def test_registered(spark):
    import __spark_entry__ as entry

    names = entry.queries()
    assert set(queries.QUERIES) <= set(names) and names["pipeline"] is corpus_pipeline.run
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


def test_columns(spark, sf_dir):
    n = documents(spark, sf_dir).count()
    want = {
        "op2_language": {"doc_id", "held_out", "lang_pred", "score"},
        "op3_line_rules": {"doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"},
        "op4_line_crf": {"doc_id", "held_out", "score", "predicted"},
        "op7_token_files": {"doc_id", "start", "n_tokens", "ids_crc32"},
        "op9_jaccard_join": {"doc_id", "n_shingles", "component_id"},
        "op12_toxicity": {"doc_id", "held_out", "score", "predicted"},
    }
    for name, columns in want.items():
        got = queries.QUERIES[name](spark, sf_dir)
        assert columns <= set(got.columns) and got.count() == n


def test_pipeline_stages(spark, sf_dir, tmp_path):
    docs = documents(spark, sf_dir)
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf_dir)
        path = str(tmp_path / name)
        out.write.parquet(path)
        after = spark.read.parquet(path)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert after.columns == columns and 0 < after.count() <= docs.count()
        docs = after
    assert {"sequence_id", "offset", "length"} <= set(docs.columns) and docs.count() > 0


COLUMNS = "doc_id long, text string, lang string, source string, n_chars int, kept string, quality_score long, row int, carried_row long, key string, left_text string, spans array<int>, n_bytes double"


def left_after_spans(data: list[bytes], span: int = 200) -> list[str]:
    count = Counter(d[i : i + span] for d in data for i in range(len(d) - span + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - span + 1):
            if count[d[i : i + span]] > 1:
                gone[i : i + span] = True
        out.append(bytes(c for c, g in zip(d, gone) if not g).decode("utf-8", "ignore"))
    return out


def test_pipeline_equals_brute_force(spark, tmp_path):
    """Every stage on rows with nulls, empty and long texts, repeated rows and columns whose names the operators use."""
    words = "some plain words that make up a line of text and more of them".split()
    rng = np.random.default_rng(7)
    texts = [(r[0], r[1]) for r in fixture_rows()]
    texts += [(100 + k, "\n".join(" ".join(rng.choice(words, 9)) + "." for _ in range(6))) for k in range(20)]
    texts += [(130 + k, texts[3][1] + f"\nA line of its own, number {k}, with some words.\n" + "shared passage of words. " * 12) for k in range(3)] + [(140, "long text of words. " * 60_000), (130, None)]
    rows = [(d, t, "en", "s", len(t or ""), "yes", 5, 1, 2, "k", f"l{d}", [1], 0.5) for d, t in texts]
    spark.createDataFrame(rows, COLUMNS).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(k, int(k not in (77, 71, 72))) for k in range(150)] + [(77, None), (None, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = documents(spark, str(tmp_path))
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        after = spark.read.parquet(f"{tmp_path}/{name}")
        before = [(r["doc_id"], r["text"]) for r in docs.collect()]
        order = lambda pairs: sorted(pairs, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        if number < 4:
            assert after.columns == docs.columns
            got = [(r["doc_id"], r["text"]) for r in after.collect()]
            for r in after.collect():
                assert (r["kept"], r["quality_score"], r["row"], r["carried_row"], r["key"], r["left_text"], r["spans"], r["n_bytes"], r["n_chars"]) == ("yes", 5, 1, 2, "k", f"l{r['doc_id']}", [1], 0.5, len(r["text"]))
        if number == 0:
            judged = [(d, line_rules.judge(t, line_rules.Rules())) for d, t in before]
            want = [(d, j[10]) for d, j in judged if j[6]]
        elif number == 1:
            train = [(d, line_crf.line_features(t)) for d, t in before if d is not None and zlib.crc32(str(d).encode()) % 4 != 2]
            of = {d: q for d, q in labels if q is not None}
            train = sorted(((of[d], len(x), x, n) for d, (x, n) in train if d in of), key=lambda r: (r[0], r[2].tobytes()))
            model = line_crf.fit(np.concatenate([r[2] for r in train]), np.array([r[1] for r in train]), np.concatenate([r[3] for r in train]), np.array([r[0] for r in train]))
            want = []
            for d, t in before:
                x, n = line_crf.line_features(t)
                if model.scores(x, np.array([len(n)]), n)[0] >= 0.7:
                    want.append((d, t))
        elif number == 2:
            least = brute_components(before)
            component = {}
            for (d, t), (e, n, c) in zip(sorted(before, key=lambda r: r[0] if r[0] is not None else -1), least):
                component.setdefault(c if n else ("empty", d), []).append((d, t))
            want = [order(v)[0] for v in component.values()]
            assert len(got) == len(want)
        elif number == 3:
            want = list(zip([d for d, _ in before], left_after_spans([t.encode() for _, t in before])))
        else:
            encoder = Tokenizer.from_file(WORD_BPE)
            want = Counter()
            for d, t in before:
                ids = [*encoder.encode(t, add_special_tokens=False).ids, 0]
                want.update((d, k // 2048, len(ids[k : k + 2048]), zlib.crc32(np.array(ids[k : k + 2048], "<u4").tobytes())) for k in range(0, len(ids), 2048))
            assert Counter((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in after.collect()) == want
            fill = Counter()
            for r in after.collect():
                fill[r["sequence_id"]] += r["length"]
            assert max(fill.values()) <= 2048
            break
        assert order(got) == order(want) and 0 < len(got)
        docs = after


def test_pipeline_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
