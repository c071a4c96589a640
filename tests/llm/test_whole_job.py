"""Places where an operator once did less than the whole job."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from casegrid.llm import duck_bpe, edit_embedding, jaccard_join, language, line_crf, line_rules, maxent_lm, packing, suffix_dedup, token_files
from casegrid.llm.tokens import vocabulary_path
from tokenizers import Tokenizer


def test_op1_third_word_back_counts():
    s = maxent_lm.Settings(head=8, width=4, endings=3, marks=16, rows=4096)
    v = maxent_lm.Vocabulary(s, 0, 0, {}, np.empty(0), {}, np.zeros((3, 4)), np.zeros((3, 4)), np.empty(0, np.int64), np.empty(0, np.int64))
    one, two = (maxent_lm.Features(np.array([first, 1, 2, 3]), np.array([4]), v).rows for first in (4, 5))
    assert maxent_lm.N_FEATURES == 4 == sum(len(kinds) for kinds, _ in maxent_lm.PASSES)
    assert [bool(one[k][3] != two[k][3]) for k in range(4)] == [False, False, False, True]


def made_text(seed, size, letters="abcdefghijklmnopqrst"):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 9))) for _ in range(size // 6))


def test_op2_copies_leave_the_dictionary_full(spark):
    s = language.Settings(dictionary_bytes=8192, piece_bytes=128)
    hot = [("aa", made_text(1, 5000))] * 2000
    cold = [("bb", made_text(k, 5000)) for k in range(2, 6)] + [("bb", made_text(2, 5000))] * 500
    got = language.learn(spark.createDataFrame(hot + cold, "lang string, text string").repartition(4), s)
    once = language.learn(spark.createDataFrame(list(dict.fromkeys(hot + cold)), "lang string, text string"), s)
    assert got == once
    assert len(got["aa"]) > 4000 and len(got["bb"]) == s.dictionary_bytes


def classes(n, pairs):
    of = list(range(n))
    for a, b in pairs:
        old, new = of[b], of[a]
        of = [new if x == old else x for x in of]
    return {frozenset(k for k in range(n) if of[k] == x) for x in of}


@pytest.mark.parametrize("part", [2000, 50])
def test_op6_large_bucket_loses_no_class(spark, monkeypatch, part):
    """60 groups of fingerprints in one bucket; the order in it says nothing about the groups."""
    monkeypatch.setattr(edit_embedding, "NEAR_PART", part)
    rng = np.random.default_rng(5)
    groups = rng.integers(0, 16, (60, 128))
    codes = np.repeat(groups, 5, axis=0)
    change = rng.random(codes.shape) < 0.15
    codes = np.where(change, rng.integers(0, 16, codes.shape), codes)
    shared = np.broadcast_to(rng.integers(0, 16, 128), codes.shape)
    prints = np.concatenate([shared, codes], axis=1)
    w = edit_embedding.walk(edit_embedding.Settings())
    for slot in edit_embedding.band_slots(edit_embedding.Settings(), 1, 6)[0]:
        prints[:, slot] = prints[0, slot]
    texts = w.written(prints)
    want = [(i, j) for i in range(len(texts)) for j in range(i) if w.likeness(prints[i], prints[j]) >= 0.75]
    got = edit_embedding.near_pairs(spark.createDataFrame(list(enumerate(texts)), "number long, fingerprint string"), bands=1, slots=6).collect()
    assert want and classes(len(texts), want) == classes(len(texts), [(r["a"], r["b"]) for r in got])
    assert all(abs(r["likeness"] - w.likeness(prints[r["a"]], prints[r["b"]])) < 1e-12 and r["likeness"] >= 0.75 for r in got)


def test_op4_trains_on_all_lines(spark, monkeypatch):
    """A run of lines between two evenly spaced places of a long text counts too."""
    seen = []
    monkeypatch.setattr(line_crf, "fit", lambda x, lengths, sizes, labels, settings: seen.append((x, lengths.tolist())))
    text = "\n".join("$$$ ###" if k in range(2, 5) else f"This is line number {k} of a long text." for k in range(1001))
    line_crf.learn(spark.createDataFrame([(1, text)], "doc_id long, text string"), spark.createDataFrame([(1, 0)], "doc_id long, quality int"))
    (x, lengths), = seen
    assert lengths == [1001]
    assert np.array_equal(x, line_crf.line_features(text)[0])


def test_texts_above_a_megabyte(spark):
    """Every operator on a text of 1.5 MB, one line of 300,000 letters among it, beside short ones."""
    rng = random.Random(12)
    vocab = ["".join(rng.choice("abcdefghijklmnopqrst") for _ in range(rng.randint(2, 9))) for _ in range(4000)]
    long = ". ".join(" ".join(rng.choice(vocab) for _ in range(15)) for _ in range(13_000)) + "\n" + "".join(rng.choice("abcdefgh") for _ in range(300_000))
    assert len(long) > 1_500_000
    rows = [(1, long, "aa"), (2, "short text of some words.", "bb"), (3, None, None), (4, long[100_000:200_000], "aa")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(2)
    by_id = lambda made, *columns: {r["doc_id"]: tuple(r[c] for c in columns) for r in made.collect()}
    words = {d: len((t or "").split()) for d, t, _ in rows}

    scored = by_id(maxent_lm.score_documents(df.withColumn("held_out", F.lit(False))), "n_tokens", "n_known", "score")
    assert all(scored[d][0] == scored[d][1] == words[d] + 1 and scored[d][2] < 0 for d in words)
    assert by_id(language.identify(df, language.learn(df)), "lang_pred") == {1: ("aa",), 2: ("bb",), 3: ("und",), 4: ("aa",)}
    assert {d: n for d, (n,) in by_id(line_rules.clean_lines(df), "n_words").items()} == words
    model = line_crf.learn(df.select("doc_id", "text"), spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int"))
    assert all(0 <= s <= 1 for (s,) in by_id(line_crf.score(df, model), "quality_score").values())
    spans = by_id(suffix_dedup.dedup(df), "n_bytes", "n_removed", "n_spans")
    assert spans[1] == (len(long), 100_000, 1) and spans[4] == (100_000, 100_000, 1) and spans[2][1] == 0
    prints = by_id(edit_embedding.fingerprint_edits(df), "n_chars", "near_edited")
    assert prints[1][0] == len(long) and prints[3] == (0, 1.0)
    vocabulary = vocabulary_path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(vocabulary)
    ids = {d: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for d, t, _ in rows}
    assert {d: (n, c) for d, (n, c) in by_id(token_files.round_trip(df, vocabulary), "n_tokens", "ids_crc32").items()} == {d: (len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for d, x in ids.items()}
    packed = packing.pack(df, vocabulary).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {r["doc_id"]: r["n"] for r in packed} == {d: len(x) for d, x in ids.items()}
    sets = by_id(jaccard_join.components(df), "n_shingles", "component_id")
    assert sets[1][0] > 190_000 and {d: c for d, (_, c) in sets.items()} == {1: 1, 2: 2, 3: 3, 4: 4}
    path = vocabulary_path("byte_bpe_multi_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=duck_bpe.read_ranks(path), special_tokens={})
    encoded = by_id(duck_bpe.encode(df, path, public_tokenizers.PATTERN), "n_tokens", "decoded_sha256")
    assert {d: (len(library.encode_ordinary(t or "")), hashlib.sha256((t or "").encode()).hexdigest()) for d, t, _ in rows} == encoded
