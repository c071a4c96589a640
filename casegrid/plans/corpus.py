"""Corpus building: deduplication, decontamination, admission, selection, gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casegrid.functions import keys
from casegrid.operators import ranks
from casegrid.operators.selection import round_robin
from casegrid.plans.registry import Registry
from casegrid.session import table

R = Registry()

_KEY = r"sha256(lower(trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g'))))"


def _keyed(spark: SparkSession, d: str, *more: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", *more, keys.text_key(F.col("text")).alias("text_key"))


def _protected(spark: SparkSession, d: str) -> DataFrame:
    """Texts that must stay out of training: the benchmark and, so that the small tables hold some, labelled toxic documents."""
    bench = table(spark, d, "benchmark").select(keys.text_key(F.col("text")).alias("text_key"))
    toxic = table(spark, d, "labels").where("toxic = 1").select("doc_id")
    return bench.union(_keyed(spark, d).join(toxic, "doc_id").select("text_key")).distinct()


_PROTECTED = f"(SELECT {_KEY} AS k FROM benchmark UNION SELECT {_KEY} FROM documents JOIN labels USING (doc_id) WHERE toxic = 1)"


def keep_first(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row of each key, the least by ``order``; hot keys shrink before the shuffle."""
    rest = [c for c in df.columns if c not in (key, order)]
    return df.groupBy(key).agg(F.min(F.struct(order, *rest)).alias("r")).select(*[F.col(key) if c == key else F.col(f"r.{c}") for c in df.columns])


@R.add("t32_text_hash_dedup", f"SELECT {_KEY} AS text_key, min(doc_id) AS doc_id, count(*)::BIGINT AS copies FROM documents GROUP BY 1")
def t32(spark: SparkSession, d: str) -> DataFrame:
    """First document of each normalized text, with its copies."""
    return _keyed(spark, d).groupBy("text_key").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@R.add("j3_decontaminate", f"SELECT doc_id FROM documents WHERE {_KEY} NOT IN (SELECT k FROM {_PROTECTED}) AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def j3(spark: SparkSession, d: str) -> DataFrame:
    """Anti-joins with protected ids and protected texts."""
    docs = _keyed(spark, d)
    ids = table(spark, d, "labels").where("toxic = 1").select("doc_id")
    return docs.join(ids, "doc_id", "left_anti").join(_protected(spark, d), "text_key", "left_anti").select("doc_id")


@R.add("j4_leak_check", f"SELECT doc_id FROM documents WHERE {_KEY} IN (SELECT k FROM {_PROTECTED})")
def j4(spark: SparkSession, d: str) -> DataFrame:
    """What of the corpus is protected; empty after ``j3``."""
    return _keyed(spark, d).join(_protected(spark, d), "text_key", "left_semi").select("doc_id")


@R.add("split_hash", f"""
SELECT doc_id, CASE WHEN ('0x' || substr(sha256('s1:' || doc_id::VARCHAR || ':' || {_KEY}), 1, 8))::BIGINT / 4294967295.0 < 0.1 THEN 'val' ELSE 'train' END AS split FROM documents""")
def split_hash(spark: SparkSession, d: str) -> DataFrame:
    """Train or val by a keyed hash."""
    return _keyed(spark, d).select("doc_id", keys.split_of("s1", F.col("doc_id"), F.col("text_key"), 0.1).alias("split"))


@R.add("e2_admission_reasons", f"""
WITH d AS (SELECT doc_id, text, {_KEY} AS k, quality, toxic FROM documents LEFT JOIN labels USING (doc_id)),
r AS (SELECT *, CASE WHEN quality IS NULL THEN 'missing_label' WHEN quality = 0 THEN 'imperfect' WHEN toxic = 1 THEN 'protected_id' WHEN trim(text) = '' THEN 'empty' END AS early FROM d),
p AS (SELECT *, k IN (SELECT k FROM {_PROTECTED}) AS guarded, row_number() OVER (PARTITION BY early IS NULL, k IN (SELECT k FROM {_PROTECTED}), k ORDER BY doc_id) AS n FROM r)
SELECT doc_id, coalesce(early, CASE WHEN guarded THEN 'protected_text' WHEN n > 1 THEN 'duplicate' ELSE 'admitted' END) AS reason FROM p""")
def e2(spark: SparkSession, d: str) -> DataFrame:
    """The first reason that applies keeps a row out.

    A text is seen once a row with it has passed the protection check, so rows
    with protected texts never make others duplicates.
    """
    labels = table(spark, d, "labels").select("doc_id", "quality", "toxic")
    docs = table(spark, d, "documents").select("doc_id", (F.trim("text") == "").alias("blank"), keys.text_key(F.col("text")).alias("text_key")).join(labels, "doc_id", "left")
    early = F.when(F.col("quality").isNull(), "missing_label").when(F.col("quality") == 0, "imperfect").when(F.col("toxic") == 1, "protected_id").when(F.col("blank"), "empty")
    docs = docs.withColumn("early", early)
    guarded = docs.join(_protected(spark, d).withColumn("guarded", F.lit(True)), "text_key", "left")
    first = guarded.where("early is null and guarded is null").groupBy("text_key").agg(F.min("doc_id").alias("first"))
    reason = F.coalesce("early", F.when(F.col("guarded"), "protected_text").when(F.col("doc_id") > F.col("first"), "duplicate").otherwise("admitted"))
    return guarded.join(first, "text_key", "left").select("doc_id", reason.alias("reason"))


@R.add("e3_gold_order", f"""
WITH d AS (SELECT doc_id, {_KEY} AS k FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id) AS n FROM d)
SELECT doc_id, CASE WHEN n > 1 THEN 'duplicate' WHEN k IN (SELECT k FROM {_PROTECTED}) THEN 'protected_text' ELSE 'admitted' END AS reason FROM r""")
def e3(spark: SparkSession, d: str) -> DataFrame:
    """The same with duplicates checked before protection."""
    docs = _keyed(spark, d)
    first = docs.groupBy("text_key").agg(F.min("doc_id").alias("first"))
    marked = docs.join(first, "text_key").join(_protected(spark, d).withColumn("guarded", F.lit(True)), "text_key", "left")
    return marked.select("doc_id", F.when(F.col("doc_id") > F.col("first"), "duplicate").when(F.col("guarded"), "protected_text").otherwise("admitted").alias("reason"))


@R.add("e1_heldout_select", f"""
WITH d AS (SELECT min(doc_id) AS doc_id, {_KEY} AS k FROM documents WHERE {_KEY} NOT IN (SELECT k FROM {_PROTECTED}) GROUP BY 2)
SELECT doc_id, substr(k, 1, 16) AS stable_id, lang, source FROM d JOIN documents USING (doc_id)""")
def e1(spark: SparkSession, d: str) -> DataFrame:
    """Held-out candidates: protected texts out, one row a text, a stable id and provenance."""
    free = _keyed(spark, d, "lang", "source").join(_protected(spark, d), "text_key", "left_anti")
    return keep_first(free, "text_key", "doc_id").select("doc_id", F.substring("text_key", 1, 16).alias("stable_id"), "lang", "source")


@R.add("w11_round_robin", """
WITH s AS (SELECT source, count(*) AS n FROM documents GROUP BY 1), r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS pos FROM documents),
o AS (SELECT doc_id, row_number() OVER (ORDER BY pos, n, source) AS turn FROM r JOIN s USING (source)) SELECT doc_id, turn::INTEGER AS turn FROM o WHERE turn <= 50""")
def w11(spark: SparkSession, d: str) -> DataFrame:
    """A broad selection of fifty documents over all sources."""
    return round_robin(table(spark, d, "documents"), "doc_id", "source", 50)


@R.add("w11_shared_rows", """
WITH RECURSIVE c AS (SELECT doc_id, source AS bucket FROM documents UNION SELECT doc_id, 'lang ' || lang FROM documents),
o AS (SELECT row_number() OVER (ORDER BY count(*), bucket) AS k, bucket, list(doc_id ORDER BY doc_id)[1:40] AS ids FROM c GROUP BY bucket),
g(step, taken) AS (SELECT 0, []::BIGINT[] UNION ALL
 SELECT step + 1, list_append(taken, list_filter(ids, lambda x: NOT list_contains(taken, x))[1]) FROM g JOIN o ON k = step % (SELECT count(*) FROM o) + 1 WHERE step < 40)
SELECT unnest(taken) AS doc_id, unnest(range(1, 41))::INTEGER AS turn FROM g WHERE step = 40""")
def w11_shared(spark: SparkSession, d: str) -> DataFrame:
    """Forty documents in turn over all sources and all languages; each document is in two buckets."""
    docs = table(spark, d, "documents")
    pairs = docs.select("doc_id", F.col("source").alias("bucket")).unionByName(docs.select("doc_id", F.concat(F.lit("lang "), "lang").alias("bucket")))
    return round_robin(pairs, "doc_id", "bucket", 40)


@R.add("e4_gate", f"""
SELECT 'duplicate_id' AS check_name, count(*)::BIGINT AS errors FROM (SELECT doc_id FROM documents GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'duplicate_text', count(*) FROM (SELECT {_KEY} FROM documents GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'leak', count(*) FROM documents WHERE {_KEY} IN (SELECT k FROM {_PROTECTED})
UNION ALL SELECT 'length_mismatch', count(*) FROM documents WHERE n_chars <> length(text)
UNION ALL SELECT 'label_without_text', count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)
UNION ALL SELECT 'bad_label', count(*) FROM labels WHERE quality NOT IN (0, 1) OR toxic NOT IN (0, 1)
UNION ALL SELECT 'empty', count(*) FROM documents WHERE trim(text) = ''""")
def e4(spark: SparkSession, d: str) -> DataFrame:
    """Every invariant of the corpus as a count of offences."""
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    keyed = _keyed(spark, d)
    parts = {
        "duplicate_id": docs.groupBy("doc_id").count().where("count > 1"),
        "duplicate_text": keyed.groupBy("text_key").count().where("count > 1"),
        "leak": keyed.join(_protected(spark, d), "text_key", "left_semi"),
        "length_mismatch": docs.where(F.col("n_chars") != F.length("text")),
        "label_without_text": labels.join(docs.select("doc_id"), "doc_id", "left_anti"),
        "bad_label": labels.where("quality not in (0, 1) or toxic not in (0, 1)"),
        "empty": docs.where(F.trim("text") == ""),
    }
    out = None
    for name, rows in parts.items():
        row = rows.agg(F.count("*").alias("errors")).select(F.lit(name).alias("check_name"), "errors")
        out = row if out is None else out.unionByName(row)
    return out


@R.add("e5_corpus_summary", """
SELECT d.source, count(*)::BIGINT AS n, count(l.doc_id)::BIGINT AS labelled, sum((l.quality = 0)::INT)::BIGINT AS hard_negatives, min(n_chars)::BIGINT AS shortest, max(n_chars)::BIGINT AS longest,
       round(quantile_cont(n_chars, 0.5), 2) AS p50 FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1""")
def e5(spark: SparkSession, d: str) -> DataFrame:
    """E5: counts, hard negatives and lengths by source; the median by value ranges, so that no group is gathered."""
    j = table(spark, d, "documents").select("doc_id", "source", "n_chars").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    counts = j.groupBy("source").agg(
        F.count("*").alias("n"), F.count("quality").alias("labelled"), F.sum((F.col("quality") == 0).cast("long")).alias("hard_negatives"), F.min("n_chars").cast("long").alias("shortest"), F.max("n_chars").cast("long").alias("longest")
    )
    middle = ranks.interpolated(j, ["source"], "n_chars", {"p50": 0.5})
    return counts.join(middle, "source", "left").select(*counts.columns, F.round("p50", 2).alias("p50"))


@R.add("e10_row_checks", """
WITH c AS (SELECT conv_id, list(role ORDER BY turn) AS roles, count(*) AS n, max(CASE WHEN role = 'assistant' THEN length(text) END) AS longest, sum((trim(text) = '')::INT) AS blank FROM conversations GROUP BY 1)
SELECT conv_id, n::BIGINT AS turns, CASE WHEN n < 2 THEN 'too few turns' WHEN longest IS NULL THEN 'no answer' WHEN blank > 0 THEN 'blank turn' WHEN roles[-1] <> 'assistant' THEN 'ends without answer' ELSE 'ok' END AS verdict FROM c""")
def e10(spark: SparkSession, d: str) -> DataFrame:
    """Structure checks of conversation rows; the first fault names the row."""
    c = table(spark, d, "conversations").groupBy("conv_id").agg(
        F.count("*").alias("turns"), F.max_by("role", "turn").alias("last"), F.bool_or(F.col("role") == "assistant").alias("answered"), F.count_if(F.trim("text") == "").alias("blank")
    )
    verdict = F.when(F.col("turns") < 2, "too few turns").when(~F.col("answered"), "no answer").when(F.col("blank") > 0, "blank turn").when(F.col("last") != "assistant", "ends without answer").otherwise("ok")
    return c.select("conv_id", "turns", verdict.alias("verdict"))


@R.add("k9_jsonl_rows", """SELECT doc_id, '{"doc_id":' || doc_id || ',"lang":"' || lang || '","n_chars":' || n_chars || ',"source":"' || source || '"}' AS line FROM documents""")
def k9(spark: SparkSession, d: str) -> DataFrame:
    """K9: compact JSON rows with sorted keys."""
    docs = table(spark, d, "documents")
    return docs.select("doc_id", F.to_json(F.struct(*sorted(["doc_id", "lang", "n_chars", "source"]))).alias("line"))
