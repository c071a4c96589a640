"""Training-data operators 1 to 10 against brute force, on a fixture with nulls, empty and long texts, ties and repeated rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from casegrid.llm import duck_bpe, edit_embedding, jaccard_join, language, line_crf, line_rules, maxent_lm, packing, suffix_dedup, token_files
from casegrid.llm.tokens import vocabulary_path
from tokenizers import Tokenizer

WORD_BPE = vocabulary_path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, key long, row long, fill long"


def fixture_rows():
    rng = random.Random(5)
    vocab = {"en": "the of and to in is that was for with".split(), "fr": "le la des est dans pour que une sur été".split()}
    rows = []
    for k in range(60):
        lang = "en" if k % 2 else "fr"
        words = [rng.choice(vocab[lang]) + rng.choice(["", "a", "on", "ing"]) for _ in range(rng.choice([3, 30, 80, 200]))]
        rows.append((k, ". ".join(" ".join(words[i : i + 12]) for i in range(0, len(words), 12)) + ".", lang, "s", 1, 2, 3))
    base = rows[3 if len(rows[3][1]) > 300 else max(range(60), key=lambda i: len(rows[i][1]))][1]
    words = base.split()
    for k in range(60, 66):  # near copies
        changed = list(words)
        changed[rng.randrange(len(changed))] = f"edit{k}"
        rows.append((k, " ".join(changed), "en", "s", None, None, None))
    rows += [
        (66, base, "en", "s", 0, 0, 0), (67, base, None, None, 0, 0, 0), (68, None, "en", "s", 0, 0, 0), (69, "", "fr", "s", 0, 0, 0),
        (70, " \n\t ", "en", "s", 0, 0, 0), (71, "a" * 5000, "en", "s", 0, 0, 0), (72, "123 456", "en", "s", 0, 0, 0), (73, "Été NAÏVE 你好 x", "fr", "s", 0, 0, 0),
        (74, (base + "\n") * 12, "en", "s", 0, 0, 0), (75, "one", "en", "s", 0, 0, 0), (76, "one", "en", "s", 0, 0, 0), (None, "no id here", "en", "s", 0, 0, 0),
        (77, "THE!! OF!! AND!! " * 30, "en", "s", 0, 0, 0), (78, "Home | About | Contact | Login\n" + base, "en", "s", 0, 0, 0),
        (75, "one", "en", "s", 0, 0, 0),
    ]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(fixture_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def texts(rows):
    return [r[1] or "" for r in rows]


def shingles(text):
    ws = text.encode().lower().split()
    n = min(5, len(ws))
    return {tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)} if ws else set()


def test_op1_base_scores_and_gain(docs, none):
    held = docs.withColumn("held_out", F.coalesce(F.col("doc_id") % 4 == 1, F.lit(False))).select("doc_id", "text", "key", "held_out")
    got = maxent_lm.score_documents(held, maxent_lm.Settings(head=64, most_head=64, width=8, frequent=20, rows=2048)).collect()
    rows = [(r[0], r[1], bool(r[0] is not None and r[0] % 4 == 1)) for r in fixture_rows()]
    tokens = lambda t: [*re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower()), b""]
    counts = Counter(w for _, t, h in rows if not h for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    want = sorted((d if d is not None else -1, len(tokens(t)), sum(w in counts for w in tokens(t)), round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens(t)), 6)) for d, t, _ in rows)
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in got) == want
    assert {r["train_tokens"] for r in got} == {n} and all(math.isfinite(r["score"]) for r in got)
    long = [r for r in got if r["held_out"] and r["n_tokens"] > 30]
    assert sum(r["score"] for r in long) > sum(r["base_score"] for r in long)
    assert maxent_lm.score_documents(none.withColumn("held_out", F.lit(False)).select("doc_id", "text", "held_out")).count() == 0
    alone = maxent_lm.score_documents(docs.withColumn("held_out", F.lit(True)).select("doc_id", "text", "held_out")).collect()
    assert all(math.isfinite(r["score"]) and r["train_tokens"] == 0 for r in alone)


def small_vocabulary(**more):
    s = maxent_lm.Settings(head=8, width=4, endings=3, marks=16, rows=256, **more)
    tail = np.arange(12.0).reshape(3, 4)
    return maxent_lm.Vocabulary(s, 100, 20, {b"%d" % k: k for k in range(8)}, np.arange(8, 0, -1.0), {b"ab": 0, b"cd": 1}, tail, np.ones((3, 4)), np.empty(0, np.int64), np.empty(0, np.int64))


def brute_log_prob(m, v, symbols, at):
    """Natural log probability of the token at a place, feature by feature."""
    of, inside, coarse = v.layout()
    one = lambda values, k: np.array([int(values[at - k]) + 1 if at >= k else 0], np.uint64)
    near, a, b, c = one(symbols, 1), one(coarse[symbols], 1), one(coarse[symbols], 2), one(coarse[symbols], 3)
    own = np.array([of[symbols[at]]], np.uint64)
    n = v.settings.rows
    z = m.bias.astype(float).copy()
    for kind, values in enumerate(((near,), (a, b), (b,), (c,))):
        z = z + m.classes[maxent_lm.region(kind, 4, n, *values)[0]]
    w = m.inner[of[symbols[at]]].astype(float).copy()
    for kind, values in enumerate(((near, own), (b, own))):
        w = w + m.words[maxent_lm.region(kind, 2, n, *values)[0]]
    return z[of[symbols[at]]] - np.log(np.exp(z).sum()) + w[inside[symbols[at]]] - np.log(np.exp(w).sum())


def test_op1_outcomes_sum_to_one_and_equal_brute_force():
    v = small_vocabulary()
    m = maxent_lm.Model.start(v)
    rng = np.random.default_rng(0)
    m.classes[:], m.words[:] = rng.normal(size=m.classes.shape), rng.normal(size=m.words.shape)
    first_of = {}
    for symbol, cell in enumerate(zip(*v.layout()[:2])):
        first_of.setdefault(cell, symbol)
    total = sum(np.exp(maxent_lm.Features(np.array([3, 40, k]), np.array([3]), v).log_prob(m)[2]) for k in first_of.values())
    assert len(first_of) == 8 + 3 * 4 and total == pytest.approx(1, abs=1e-5)
    docs = [rng.integers(0, 8 + 3 * 16, n) for n in (1, 2, 3, 9)]
    got = maxent_lm.Features(np.concatenate(docs), np.array([len(d) for d in docs]), v).log_prob(m)
    assert np.allclose(got, [brute_log_prob(m, v, d, k) for d in docs for k in range(len(d))], atol=1e-4)


def test_op1_passes_move_along_the_gradient(monkeypatch):
    """Sums of a pass equal brute force, and a pass over the text makes it likelier."""
    v = small_vocabulary(batch=7)
    rng = np.random.default_rng(1)
    docs = [np.resize(rng.integers(0, 56, 5), n) for n in (1, 4, 30, 60)]
    symbols, sizes = np.concatenate(docs), np.array([len(d) for d in docs])
    f = maxent_lm.Features(symbols, sizes, v)
    m = maxent_lm.Model.start(v)
    likely = [f.log_prob(m).sum()]
    for number, (kinds, inner) in enumerate(maxent_lm.PASSES):
        sums = [np.zeros(x.shape) for x in (m.classes, m.classes, m.words, m.words)]
        f.add_to(m, number, sums)
        z = m.bias + sum(m.classes[f.rows[k]] for k in range(4))
        p = np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)
        seen, expected = np.zeros(m.classes.shape), np.zeros(m.classes.shape)
        for k in kinds:
            np.add.at(seen, (f.rows[k], f.of), 1)
            np.add.at(expected, f.rows[k], p)
        assert np.allclose(sums[0], seen) and np.allclose(sums[1], expected, atol=1e-4)
        w = m.inner[f.of] + sum(m.words[f.inner_rows[k]] for k in range(2))
        q = np.exp(w) / np.exp(w).sum(axis=1, keepdims=True)
        expected = np.zeros(m.words.shape)
        for k in inner:
            np.add.at(expected, f.inner_rows[k], q)
        assert np.allclose(sums[3], expected, atol=1e-4)
        m = maxent_lm.step(m, sums, number, v.settings)
        likely.append(f.log_prob(m).sum())
    assert likely == sorted(likely) and likely[1] > likely[0] + 10


def test_op1_sizes_grow():
    sizes = [maxent_lm.Settings().grown(n) for n in (0, 10**6, 8 * 10**7, 5 * 10**9, 10**13)]
    assert [x.rows for x in sizes] == [32768, 32768, 32768, 131072, 131072] and [x.head for x in sizes] == [1024, 1024, 1024, 4096, 4096] and [x.marks for x in sizes] == [32, 32, 32, 256, 256]


def test_op1_column_names_that_clash(spark):
    df = spark.createDataFrame([(k, f"some words {k}", k % 3 == 1, -k, "x", [k]) for k in range(9)], "doc_id long, text string, held_out boolean, row long, carried_row string, SCORE array<long>")
    got = maxent_lm.score_documents(df)
    assert got.columns == ["doc_id", "held_out", "row", "carried_row", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    assert sorted((r["doc_id"], r["row"], r["carried_row"], r["n_tokens"]) for r in got.collect()) == [(k, -k, "x", 4) for k in range(9)]


def test_op2_languages(docs, none):
    known = docs.where("doc_id % 3 <> 1")
    got = {r["doc_id"]: r for r in language.identify(docs.select("doc_id", "text", "source"), language.learn(known)).collect()}
    rows = [r for r in fixture_rows() if r[0] is not None and r[0] < 60 and len(r[1]) > 100]
    assert sum(got[r[0]]["lang_pred"] == r[2] for r in rows) / len(rows) > 0.9
    for k in (68, 69, 70, 72):
        assert (got[k]["lang_pred"], got[k]["score"], got[k]["rejected"]) == ("und", 0.0, True)
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert language.identify(none.select("doc_id", "text"), language.learn(none)).count() == 0
    assert {r["lang_pred"] for r in language.identify(docs.select("doc_id", "text"), {}).collect()} == {"und"}


def test_op2_marks_stay_and_scores_equal_brute_force(spark):
    assert language.normal("हिन्दी भाषा में 12") == "हिन्दी भाषा में".encode() and language.normal("தமிழ், மொழி!") == "தமிழ் மொழி".encode()
    assert language.normal("\u0301 12") == b"" and language.normal("Été_x 你好") == "été x 你好".encode()
    rng = random.Random(2)
    texts = ["".join(rng.choice(letters) for _ in range(n)) for letters in ("abcde fgh", "klmno pqé") for n in (5, 300, 9000)] + [None, "123"]
    dictionaries = {"one": b"abcde fgh abc def gha" * 40, "two": "klmno pqé nop".encode() * 40}
    s = language.Settings()
    df = spark.createDataFrame([(k, t, "x", 9) for k, t in enumerate(texts)], "doc_id long, text string, LANG_PRED string, rows int")
    got = {r["doc_id"]: r for r in language.identify(df, dictionaries).collect()}
    for k, text in enumerate(texts):
        data = language.normal(text) if text else b""
        if not data:
            assert (got[k]["lang_pred"], got[k]["score"]) == ("und", 0.0)
            continue
        sizes = {}
        for lang, words in dictionaries.items():
            coder = lambda: zstandard.ZstdCompressor(level=s.level, dict_data=zstandard.ZstdCompressionDict(words, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False)  # noqa: E731, B023
            sizes[lang] = sum(len(coder().compress(data[at : at + s.block_bytes])) for at in range(0, len(data), s.block_bytes))
        best = min(sizes, key=lambda x: (sizes[x], x))
        want = 1 / sum(math.exp(-s.sharpness * min(500, n - sizes[best])) for n in sizes.values())
        assert got[k]["lang_pred"] == best and got[k]["score"] == pytest.approx(want, abs=0.2 if len(data) < 50 else 1e-3)
        assert got[k]["rows"] == 9
    many = language.learn(spark.createDataFrame([(f"l{k}", "".join(rng.choice("abcdefgh ") for _ in range(4000))) for k in range(8)], "lang string, text string"), language.Settings(most_bytes=8000, piece_bytes=64))
    assert len(many) == 8 and sum(map(len, many.values())) <= 8000


def brute_rules(text):
    text = text or ""
    ws = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    grams = Counter(tuple(ws[i : i + 5]) for i in range(len(ws) - 4))
    again = {j for i in range(len(ws) - 4) if grams[tuple(ws[i : i + 5])] > 1 for j in range(i, i + 5)}
    return len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text), dup, len(again)


def test_op3_counts_and_verdicts(docs, none):
    got = line_rules.clean_lines(docs).collect()
    key = lambda r: (r[0] if r[0] is not None else -1, *r[1:])
    assert sorted(key(tuple(r)[:6]) for r in got) == sorted(key((r[0], *brute_rules(r[1]))) for r in fixture_rows())
    by_id = {r["doc_id"]: r for r in got}
    assert not by_id[77]["kept"] and by_id[77]["n_bad_lines"] == 1
    assert by_id[78]["n_bad_lines"] == 1 and "Home |" not in by_id[78]["cleaned_text"]
    assert by_id[68]["base_failed"] and by_id[69]["cleaned_text"] == ""
    assert line_rules.clean_lines(none).count() == 0
    wide = docs.select("doc_id", "text", F.lit(3).alias("kept"), F.lit("c").alias("carried_row"), "fill")
    cleaned = {r["doc_id"]: r for r in line_rules.clean_documents(wide).collect()}
    assert cleaned[78]["carried_row"] == "c" and cleaned[78]["cleaned_text"] == by_id[78]["cleaned_text"] and cleaned[77]["kept"] is False
    assert line_rules.repeated_words([b"x"] * 9) == 9 and line_rules.repeated_words([b"x"] * 5) == 0


def test_op4_marginals_equal_enumeration():
    rng = np.random.default_rng(3)
    emit, trans, lengths = rng.normal(size=(7, 2)), rng.normal(size=(2, 2)), np.array([4, 1, 2])
    both, pairs, log_z = line_crf.forward_backward(emit, lengths, trans)
    at, all_pairs = 0, np.zeros((2, 2))
    for k, n in enumerate(lengths):
        paths = [[(p >> i) & 1 for i in range(n)] for p in range(2**n)]
        weight = np.exp([sum(emit[at + i, y] for i, y in enumerate(p)) + sum(trans[a, b] for a, b in zip(p, p[1:])) for p in paths])
        assert log_z[k] == pytest.approx(np.log(weight.sum()))
        for i in range(n):
            assert both[at + i, 1] == pytest.approx(sum(w for w, p in zip(weight, paths) if p[i]) / weight.sum())
        for w, p in zip(weight, paths):
            for a, b in zip(p, p[1:]):
                all_pairs[a, b] += w / weight.sum()
        at += n
    assert np.allclose(pairs, all_pairs)


def test_op4_scores_equal_brute_force(spark):
    """The score from all labellings of the lines, weighted by length, and calibrated."""
    rng = np.random.default_rng(5)
    model = line_crf.Model(rng.normal(size=line_crf.N_FEATURES), rng.normal(size=(2, 2)), 0.7, 0.2)
    texts = [None, "", "One line here.", "A | B | C\nA longer line, with words.\n\nTHE!! OF!!\nend", "x\nx\nx y z"]
    df = spark.createDataFrame([(k, t, 5.0) for k, t in enumerate(texts)], "doc_id long, text string, QUALITY_SCORE double")
    got = {r["doc_id"]: r["quality_score"] for r in line_crf.score(df, model).collect()}
    for k, text in enumerate(texts):
        x, sizes = line_crf.line_features(text)
        z = x.astype(float) @ model.weights
        n = len(sizes)
        total, good = 0.0, np.zeros(n)
        for path in range(2**n):
            y = [path >> i & 1 for i in range(n)]
            weight = math.exp(sum((z[i] if y[i] else -z[i]) / 2 for i in range(n)) + sum(model.trans[a, b] for a, b in zip(y, y[1:])))
            total += weight
            good += weight * np.array(y)
        mean = min(max(float((good / total * sizes).sum() / sizes.sum()), 1e-4), 1 - 1e-4)
        assert got[k] == pytest.approx(1 / (1 + math.exp(-(0.7 * math.log(mean / (1 - mean)) + 0.2))))


def test_op4_lines_differ_inside_a_document(spark):
    """A bad line in every good document: its marginal is low though the document's label is good, and labels change between lines."""
    rng = random.Random(8)
    good = lambda: " ".join(rng.choice("some plain words that make up a line of text".split()) for _ in range(rng.randint(6, 14))) + "."
    bad = lambda: " ".join(rng.choice("$$$ ### THE!! | OF!! |||".split()) for _ in range(rng.randint(4, 9)))
    rows = [(k, "\n".join(bad() if j == 4 else good() for j in range(9)), 1) for k in range(60)] + [(k, "\n".join(bad() for _ in range(9)), 0) for k in range(60, 120)]
    df = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    model = line_crf.learn(df, spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, quality int"))
    x, sizes = line_crf.line_features(rows[0][1])
    score = x.astype(float) @ model.weights
    marginal = line_crf.forward_backward(np.stack([-score / 2, score / 2], axis=1), np.array([9]), model.trans)[0][:, 1]
    assert marginal[4] < 0.5 < np.delete(marginal, 4).min()
    got = {r["doc_id"]: r["quality_score"] for r in line_crf.score(df, model).collect()}
    assert min(got[k] for k in range(60)) > 0.7 > max(got[k] for k in range(60, 120))


def test_op4_learns_and_scores(spark, docs, none):
    rows = [(k, ("the of and to in. " * 8 + "\n") * 3, 1) for k in range(40)] + [(k, ("THE!! | OF!! $$$ | " * 8 + "\n") * 3, 0) for k in range(40, 80)]
    df = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows] + [(None, 1), (3, None)], "doc_id long, quality int")
    model = line_crf.learn(df, labels, line_crf.Settings(steps=80))
    got = {r["doc_id"]: r["quality_score"] for r in line_crf.score(df, model).collect()}
    assert min(got[k] for k in range(40)) > 0.7 > 0.3 > max(got[k] for k in range(40, 80))
    assert all(0 <= r["quality_score"] <= 1 for r in line_crf.score(docs.select("doc_id", "text", "key"), model).collect())
    empty = line_crf.learn(none.select("doc_id", "text"), labels.limit(0))
    assert line_crf.score(none.select("doc_id", "text"), empty).count() == 0
    assert [r["quality_score"] for r in line_crf.score(df.limit(2), empty).collect()] == pytest.approx([0.5, 0.5])


def brute_spans(rows, span=200):
    data = [t.encode() for t in texts(rows)]
    count = Counter(d[i : i + span] for d in data for i in range(len(d) - span + 1))
    out = []
    for r, d in zip(rows, data):
        gone = np.zeros(len(d) + 1, bool)
        for i in range(len(d) - span + 1):
            if count[d[i : i + span]] > 1:
                gone[i : i + span] = True
        left = bytes(c for c, g in zip(d, gone) if not g)
        out.append((r[0] if r[0] is not None else -1, len(d), int(gone.sum()), int((gone[1:] < gone[:-1]).sum()), hashlib.sha256(left).hexdigest()))
    return sorted(out)


def test_op5_equals_brute_force(docs, none):
    got = suffix_dedup.dedup(docs.select("doc_id", "text", "key")).collect()
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, *(r[c] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256"))) for r in got) == brute_spans(fixture_rows())
    assert {(r["doc_id"], r["key"]) for r in got} == {(r[0], r[4]) for r in fixture_rows()}
    assert suffix_dedup.dedup(none.select("doc_id", "text")).count() == 0
    back = {r["doc_id"]: r["left_text"] for r in suffix_dedup.dedup(docs.select("doc_id", "text"), with_text=True).collect()}
    assert back[66] == "" and back[75] == "one"


def test_op5_column_names_that_clash(spark):
    rows = [(k, "x" * 250 if k < 2 else f"text {k}", 10 * k, "s", -1, [k]) for k in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, key long, k1 string, N_Bytes long, spans array<long>")
    got = sorted(tuple(r) for r in suffix_dedup.dedup(df).select("doc_id", "key", "k1", "spans", "n_bytes", "n_removed").collect())
    assert got == [(k, 10 * k, "s", [k], 250 if k < 2 else 6, 250 if k < 2 else 0) for k in range(4)]
    assert [r[0] for r in suffix_dedup.dedup(df.select("text"), with_text=True).select("left_text").sort("left_text").collect()] == ["", "", "text 2", "text 3"]


@pytest.mark.parametrize("settings", [{}, {"chunk": 700, "sample": 5}])
def test_op5_hot_passages_and_long_texts(spark, monkeypatch, settings):
    """A passage in every second text, so frequent that its strings are dealt by hash; a text that is read in slices; boundaries inside runs."""
    rng = random.Random(9)
    made = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    hot, rare = made(330), made(260)
    rows = [(k, made(rng.randrange(150, 400)) + (hot if k % 2 else rare if k % 9 == 0 else "") + made(rng.randrange(250))) for k in range(120)]
    rows += [(200, made(900) + hot + made(3000) + hot[:220]), (201, made(10) + rows[0][1]), (202, "ab" * 400)]
    got = suffix_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), suffix_dedup.Settings(**settings)).collect()
    assert sorted(tuple(r) for r in got) == brute_spans(rows)


@pytest.mark.parametrize("seed", range(3))
def test_op5_random_passages(spark, seed):
    rng = random.Random(seed)
    passages = ["".join(rng.choice("abc é\n") for _ in range(rng.choice([150, 199, 200, 205, 600]))) for _ in range(6)]
    rows = [(k, "".join(rng.choice([rng.choice(passages), "".join(rng.choice("xyz ") for _ in range(rng.randrange(300)))]) for _ in range(rng.randrange(1, 6)))) for k in range(40)]
    got = suffix_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)).collect()
    assert sorted(tuple(r) for r in got) == brute_spans(rows)


def test_op6_neighbours_and_likeness(docs, none):
    got = edit_embedding.fingerprint_edits(docs).collect()
    rows = sorted(fixture_rows(), key=lambda r: (r[0] is not None, r[0] if r[0] is not None else 0, r[1] or ""), reverse=True)
    t = texts(rows)
    want = []
    for k, r in enumerate(rows):
        half, after = len(t[k]) // 2, t[(k + 1) % len(t)]
        want.append((r[0] if r[0] is not None else -1, len(t[k]), hashlib.sha256((t[k][: len(t[k]) - half] + after[:half]).encode()).hexdigest()))
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_chars"], r["edited_sha256"]) for r in got) == sorted(want)
    prints = {}
    for r in got:
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        prints.setdefault(r["doc_id"], r["fingerprint"])
    assert prints[66] == prints[67] and prints[68] == prints[69]
    assert edit_embedding.fingerprint_edits(none).count() == 0
    near = edit_embedding.with_near_class(edit_embedding.fingerprints(docs.select("doc_id", "text")), "doc_id").collect()
    found = {r["doc_id"]: r["near_class"] for r in near}
    assert len(near) == len(fixture_rows()) and found[68] == found[69] and sum(found[k] == found[66] for k in range(60, 66)) >= 5
    walker = edit_embedding.walk(edit_embedding.Settings())
    for r in got:  # likeness and fingerprints against a step-by-step walk
        text = next(t[1] or "" for t in fixture_rows() if t[0] == r["doc_id"])
        assert r["fingerprint"] == brute_print(walker, text)
        a, b = (np.array([int(c, 16) for c in r[name]]) for name in ("fingerprint", "edited_fingerprint"))
        assert r["near_edited"] == pytest.approx(max(0.0, ((a == b).mean() - 1 / 16) / (1 - 1 / 16)))


def brute_print(walker, text):
    """The fingerprint of one text, clock by clock."""
    codes = [ord(c) for c in text]
    seen, at, clock = [], 0, 0
    stay = walker.stay.reshape(walker.CLOCKS, 256)
    while at < len(codes):
        for _ in range(int(stay[clock % walker.CLOCKS, (codes[at] ^ (codes[at] >> 8)) & 255])):
            seen.append(at)
            clock += 1
        at += 1
    out = []
    for slot in range(walker.settings.slots):
        record = max(int(r) for r in walker.records[slot] if r < max(1, clock))
        place = seen[record] if seen else 0
        gram = [codes[place + k] + 1 if place + k < len(codes) else 1 for k in range(walker.settings.gram)]
        value = sum((g * g + g) * int(m) for g, m in zip(gram, walker.mixers)) % 2**64
        value = (value ^ (value >> 29)) * 0x9E3779B97F4A7C15 % 2**64
        out.append("%x" % (value >> (64 - walker.settings.bits)))
    return "".join(out)


def test_op6_banding_recall(spark):
    """At least nine tenths of all near pairs are in one class, against all pairs."""
    rng = random.Random(3)
    rows = []
    for k in range(40):
        base = [rng.choice("abcdefghij ") for _ in range(rng.choice([300, 800, 1500]))]
        for _ in range(rng.choice([1, 3, 6])):
            changed = list(base)
            for at in rng.sample(range(len(base)), rng.choice([0, 3, 8, 15, 30])):
                changed[at] = rng.choice(["", "zz", "y"])
            rows.append((len(rows), "".join(changed)))
    got = edit_embedding.with_near_class(edit_embedding.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")), "doc_id").collect()
    class_of = {r["doc_id"]: r["near_class"] for r in got}
    walker = edit_embedding.walk(edit_embedding.Settings())
    prints = walker.prints([t for _, t in rows])
    near = [(i, j) for i in range(len(rows)) for j in range(i) if walker.likeness(prints[i], prints[j]) >= 0.75]
    hit = sum(class_of[i] == class_of[j] for i, j in near)
    assert len(near) > 50 and hit >= 0.9 * len(near)
    assert all(class_of[k] <= k for k in class_of)


def test_op6_edits_cost_little():
    walker = edit_embedding.walk(edit_embedding.Settings())
    rng = random.Random(1)
    a = "".join(rng.choice("abcdefghij ") for _ in range(1500))
    b = a[:700] + "zz" + a[701:]
    c = "".join(rng.choice("abcdefghij ") for _ in range(1500))
    prints = walker.prints([a, b, c])
    assert walker.likeness(prints[0], prints[1]) > 0.8 and walker.likeness(prints[0], prints[2]) < 0.1


def test_op7_round_trip(docs, none):
    encoder = Tokenizer.from_file(WORD_BPE)
    got = sorted(((r["doc_id"] if r["doc_id"] is not None else -(2**63), r["start"], r["n_tokens"], r["ids_crc32"]) for r in token_files.round_trip(docs, WORD_BPE).collect()), key=lambda r: r[1])
    rows = sorted(fixture_rows(), key=lambda r: (r[0] if r[0] is not None else -(2**63), r[1] or ""))
    start, want = 0, []
    for r in rows:
        ids = [*encoder.encode(r[1] or "", add_special_tokens=False).ids, 1]
        want.append((r[0] if r[0] is not None else -(2**63), start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want
    assert token_files.round_trip(none, WORD_BPE).count() == 0


#: strings of the tokenizer's special tokens: alone, among words, glued to words and to each other
SPECIAL = ["say <|endoftext|> now", "<|endoftext|>", "a<|endoftext|>b<|startoftext|>", "<|startoftext|><|endoftext|>\t<|ENDOFTEXT|> <|endoftext|", " <|endoftext|>\n\n<|startoftext|> x"]


def test_op7_and_op10_ids_of_special_strings(spark):
    library = Tokenizer.from_file(WORD_BPE)
    rows = list(enumerate([*SPECIAL, " ".join(SPECIAL * 50)]))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    ids = {d: library.encode(t, add_special_tokens=False).ids for d, t in rows}
    assert 49407 in ids[0] and len(ids[0]) == 3
    crc = lambda x: zlib.crc32(np.array(x, "<u4").tobytes())
    assert {r["doc_id"]: (r["n_tokens"], r["ids_crc32"]) for r in token_files.round_trip(df, WORD_BPE, end_id=1).collect()} == {d: (len(x) + 1, crc([*x, 1])) for d, x in ids.items()}
    assert {r["doc_id"]: (r["length"], r["ids_crc32"]) for r in packing.pack(df, WORD_BPE).collect()} == {d: (len(x) + 1, crc([*x, 0])) for d, x in ids.items()}


def test_op7_shards_and_slices(spark, tmp_path):
    """Null and repeated ids are spread over shards; shards roll; slices cut between documents."""
    rows = [(None, f"no id {k % 5}") for k in range(40)] + [(7, "same text")] * 40 + [(k, "some words of text " * (k % 9)) for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    limits = token_files.Limits(ids=50, documents=9, slice_ids=20, slice_documents=4)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        shards = token_files.write(df, WORD_BPE, 1, f"file://{tmp_path}/ids", limits)
        got = sorted((tuple(r) for r in token_files.read(spark, f"file://{tmp_path}/ids", limits).collect()), key=lambda r: r[1])
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(shards) > 10 and len({s.name.split("-")[1] for s in shards if s.n_docs}) == 4
    encoder = Tokenizer.from_file(WORD_BPE)
    want = sorted(((d if d is not None else -(2**63)), len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for d, t in rows for ids in [[*encoder.encode(t, add_special_tokens=False).ids, 1]])
    assert sorted((d if d is not None else -(2**63), n, c) for d, _, n, c in got) == want
    assert [r[1] for r in got] == np.concatenate([[0], np.cumsum([r[2] for r in got])])[:-1].tolist()
    assert [d if d is not None else -(2**63) for d, *_ in got] == sorted(d if d is not None else -(2**63) for d, _ in rows)


def test_op8_equals_the_library(docs, none):
    import public_tokenizers
    import tiktoken

    path = vocabulary_path("byte_bpe_multi_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=duck_bpe.read_ranks(path), special_tokens={})
    got = duck_bpe.encode(docs.select("doc_id", "text", "key"), path, public_tokenizers.PATTERN).collect()
    want = []
    for r in fixture_rows():
        ids = library.encode_ordinary(r[1] or "")
        want.append((r[0] if r[0] is not None else -1, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest()))
    assert sorted((r[0] if r[0] is not None else -1, *tuple(r)[1:]) for r in got) == sorted(want)
    assert duck_bpe.encode(none.select("doc_id", "text"), path, public_tokenizers.PATTERN).count() == 0
    hard = ["ab" * 300, "aaaa" * 99, "-=" * 200, " " * 70, "".join(random.Random(2).choice("abAB") for _ in range(500)), "<|endoftext|>"]
    coder = duck_bpe.coder(path, public_tokenizers.PATTERN)
    assert [np.frombuffer(a, "<u4").tolist() for a, _ in coder.encode_texts(hard)] == [library.encode_ordinary(t) for t in hard]


def test_op8_long_pieces():
    """Pieces of up to 1 MB equal the library's; time grows in line with them."""
    import time

    import public_tokenizers
    import tiktoken

    path = vocabulary_path("byte_bpe_multi_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=duck_bpe.read_ranks(path), special_tokens={})
    rng = random.Random(4)
    made = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    coder = duck_bpe.DuckBpe(path, public_tokenizers.PATTERN)
    hard = [made("ACGT", 5000), made("etaoinshrdlu", 5000), made("ab", 3000), "a" * 9999, "abc" * 2500, "-" * 3000, "=-" * 1500, " " * 5000, made("éàü", 2000), made("你好世界", 900), "the" * 2000]
    assert [np.frombuffer(a, "<u4").tolist() for a, _ in coder.encode_texts(hard)] == [library.encode_ordinary(t) for t in hard]
    took = []
    for n in (100_000, 1_000_000):
        text = made("abcdefghijklmnopqrstuvwxyz", n)
        began = time.perf_counter()
        (ids, back), = coder.encode_texts([text])
        took.append(time.perf_counter() - began)
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text) and back == text.encode()
    assert took[1] < 25 * took[0]


def brute_components(rows, percent=75):
    sets = [shingles(t) for t in texts(rows)]
    parent = list(range(len(rows)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                parent[top(i)] = top(j)
    least = {}
    for i, r in enumerate(rows):
        least.setdefault(top(i), []).append(r[0])
    smallest = lambda ids: min((x for x in ids if x is not None), default=None)
    return sorted((r[0] if r[0] is not None else -1, len(sets[i]), smallest(least[top(i)]) if smallest(least[top(i)]) is not None else -1) for i, r in enumerate(rows))


def test_op9_equals_brute_force(docs, none):
    got = jaccard_join.components(docs.select("doc_id", "text")).collect()
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_shingles"], r["component_id"] if r["component_id"] is not None else -1) for r in got) == brute_components(fixture_rows())
    assert jaccard_join.components(none).count() == 0
    kept = jaccard_join.representatives(docs.select("doc_id", "text", "key")).collect()
    assert sorted(r["doc_id"] for r in kept if r["doc_id"] in (66, 67, 75, 76)) == [75] and {68, 69, 70} <= {r["doc_id"] for r in kept}


@pytest.mark.parametrize("seed", range(3))
def test_op9_pairs_about_the_limit(spark, seed):
    rng = random.Random(seed)
    rows, k = [], 0
    for size in (6, 9, 14, 30, 60, 150):
        base = [f"w{rng.randrange(400)}" for _ in range(size)]
        for edits in (0, 1, 1, 2, 3, size // 20, size // 15, size // 10):
            ws = list(base)
            for _ in range(edits):
                ws[rng.randrange(len(ws))] = f"e{rng.randrange(99999)}"
            if rng.random() < 0.5:
                ws = ws[rng.randrange(3) :]
            rows.append((k, " ".join(ws)))
            k += 1
    got = jaccard_join.components(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute_components(rows)


@pytest.mark.parametrize("settings", [{"part": 5, "parts": 4, "block": 4}, {}])
def test_op9_open_groups(spark, settings):
    """Groups of equal signatures whose members are in many components: dealt over pairs of parts, forests until no pair is left."""
    rng = random.Random(11)
    base = [f"w{k}" for k in range(160)]
    rows = []
    for family in range(9):
        own = list(base)
        for k in rng.sample(range(20, 160), 14):
            own[k] = f"f{family}x{k}"
        for copy in range(5):
            ws = list(own)
            for k in rng.sample(range(20, 160), rng.choice([0, 2, 4])):
                ws[k] = f"c{family}x{copy}x{k}"
            rows.append((family * 10 + copy, " ".join(ws)))
    rng.shuffle(rows)
    got = jaccard_join.components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), jaccard_join.Settings(**settings)).collect()
    want = brute_components(rows)
    assert 3 < len({w[2] for w in want}) < 45
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == want


def test_op9_column_names_that_clash(spark):
    rows = [(k, " ".join(f"w{j}" for j in range(40)) if k < 3 else f"text {k}", k, f"r{k}", 1.5) for k in range(5)] + [(2, " ".join(f"w{j}" for j in range(40)), 2, "r2", 1.5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, key long, text_key string, carried_row double")
    kept = jaccard_join.representatives(df)
    assert kept.columns == df.columns and sorted((r["doc_id"], r["key"], r["text_key"]) for r in kept.collect()) == [(0, 0, "r0"), (3, 3, "r3"), (4, 4, "r4")]
    labelled = jaccard_join.components(df).collect()
    assert len(labelled) == 6 and {r["component_id"] for r in labelled} == {0, 3, 4}


@pytest.mark.parametrize("n_words", [1, 2, 7, 40, 300])
def test_op9_signatures_lose_no_pair(n_words):
    """Any two sets that link share a signature in some band, whichever allocation the band takes."""
    rng = np.random.default_rng(n_words)
    s = jaccard_join.Settings()
    for sets in ({}, {b: 10**7 for b in range(60)}):
        bands = jaccard_join.Bands(s, sets)
        for _ in range(60):
            a = np.unique(rng.integers(0, 2**63, n_words, dtype=np.uint64))
            cut = rng.integers(0, max(1, len(a) // 4) + 1)
            b = np.unique(np.concatenate([a[cut:], rng.integers(0, 2**63, rng.integers(0, max(1, len(a) // 6) + 1), dtype=np.uint64)]))
            if not jaccard_join.linked(a, b, 75):
                continue
            shared = False
            for x, y in ((a, b), (b, a)):
                level = bands.band(len(x))
                if bands.band(len(y)) <= level:
                    mine, theirs = (jaccard_join.signatures(z, level, bands, jaccard_join.frequent_sums(z, a[:3])) for z in (x, y))
                    both = len(np.intersect1d(mine[0], theirs[0]))
                    shared |= both >= max(1, mine[1], theirs[1])
            assert shared
            assert jaccard_join.may_link(jaccard_join.sketch(a), jaccard_join.sketch(b), len(a), len(b), 75)


def test_op10_packs_all_pieces(docs, none):
    got = packing.pack(docs.select("doc_id", "text", "fill"), WORD_BPE).collect()
    encoder = Tokenizer.from_file(WORD_BPE)
    want = []
    for r in fixture_rows():
        ids = [*encoder.encode(r[1] or "", add_special_tokens=False).ids, 0]
        want += [(r[0] if r[0] is not None else -1, k // 2048, k, len(ids[k : k + 2048]), zlib.crc32(np.array(ids[k : k + 2048], "<u4").tobytes())) for k in range(0, len(ids), 2048)]
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == sorted(want)
    held = {}
    for r in got:
        held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in held.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(held) <= -(-sum(w[3] for w in want) // 2048) + 1
    assert packing.pack(none, WORD_BPE).count() == 0


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_op10_keeps_every_capacity(rule):
    rng = np.random.default_rng(0)
    lengths = rng.integers(1, 100, 500)
    capacity = packing.Capacity(tokens=100, documents=4, attention=6000, rule=rule)
    lengths = lengths[lengths * lengths <= capacity.attention]
    bins, offsets = packing.best_fit(lengths, capacity)
    for b in np.unique(bins):
        own = lengths[bins == b]
        assert own.sum() <= 100 and len(own) <= 4 and (own.astype(float) ** 2).sum() <= 6000
        order = np.argsort(offsets[bins == b])
        assert (np.cumsum(own[order]) - own[order] == offsets[bins == b][order]).all()


def test_op10_capacities_and_levels_of_the_query_path(spark):
    """Tiny pieces fill their sequences at the defaults, and a lower capacity for documents binds; many partitions take several levels."""
    df = spark.createDataFrame([(k, None if k % 2 else "") for k in range(1400)], "doc_id long, text string").repartition(5)
    held = Counter(r["sequence_id"] for r in packing.pack(df, WORD_BPE, capacity=packing.Capacity(documents=512)).collect())
    assert max(held.values()) == 512 and len(held) == 3
    tiny = spark.range(10_000).withColumnRenamed("id", "doc_id").withColumn("text", F.lit("a")).repartition(6)
    fill = packing.pack(tiny, WORD_BPE).groupBy("sequence_id").agg(F.sum("length").alias("n"), F.min("length").alias("least")).collect()
    assert len(fill) == 10 and sum(r["n"] for r in fill) == 20_000 and {r["least"] for r in fill} == {2}
    rng = random.Random(6)
    rows = [(k, " ".join(rng.choice(["word", "other", "text"]) for _ in range(rng.choice([3, 40, 300, 900])))) for k in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(9)
    got = packing.pack(df, WORD_BPE, capacity=packing.Capacity(regroup=2)).collect()
    fill = Counter()
    for r in got:
        fill[r["sequence_id"]] += r["length"]
    alone = packing.best_fit(np.array([r["length"] for r in got]), packing.Capacity())[0].max() + 1  # all in one group
    assert max(fill.values()) <= 2048 and len(fill) <= alone + 2
    for key in fill:
        at = 0
        for r in sorted((r for r in got if r["sequence_id"] == key), key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
    assert sorted({r["doc_id"] for r in got}) == list(range(500))


@pytest.mark.parametrize(
    ("rule", "line"),
    [
        ("navigation", "Accueil À propos Contact Aide"), ("navigation", "Startseite Über Kontakt Impressum"), ("navigation", "Inicio Acerca Contacto MENÚ"), ("navigation", "Home About Login now"),
        ("boilerplate", "© 2020 Tous droits réservés."), ("boilerplate", "POLITIQUE DE CONFIDENTIALITÉ du site"), ("boilerplate", "Unsere Datenschutzerklärung gilt."), ("boilerplate", "Todos los derechos reservados"),
        ("boilerplate", "Consulta la POLÍTICA de cookies"), ("boilerplate", "Klicken Sie hier, um mehr zu lesen"), ("boilerplate", "J'accepte les conditions d'utilisation"), (None, "Le plan de la ville est affiché près de la gare."),
        (None, "Er geht weiter über die Brücke nach Hause."), (None, "La casa anterior era grande y bonita."),
    ],
)
def test_op3_rules_of_four_languages(rule, line):
    data = line.encode()
    assert line_rules.failing_rule(data, data.split(), line_rules.Rules()) == rule


def test_op9_records_of_many_signatures(spark, monkeypatch):
    """A set with more signatures in a bucket than a record holds has several records; results are the same, and no table is left behind."""
    import os

    rows = [(k, f"w{k} " + " ".join(f"t{i}" for i in range(120)) + f" e{k}") for k in range(12)] + [(50, "other words " * 3), (51, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = lambda: sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.components(df).collect())
    want = found()
    monkeypatch.setattr(jaccard_join, "MANY", 1)
    assert found() == want and {c for d, _, c in want if d < 12} == {0}
    root = spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:").rsplit("/", 1)[0]
    assert not [f for f in os.listdir(root) if f.startswith(("casegrid-jaccard-cross", "casegrid-jaccard-links", "casegrid-jaccard-texts"))]
