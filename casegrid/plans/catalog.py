"""Query catalogue: every registered query of the engine and its oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casegrid.functions import keys
from casegrid.plans import cases, corpus, dialogue, evaluation, interop, longitudinal, relational, sources, stream, text, variants
from casegrid.session import table

MODULES = (relational, longitudinal, evaluation, corpus, text, cases, dialogue, interop, sources, stream, variants)
QUERIES = {name: q for m in MODULES for name, q in m.R.queries.items()}
ORACLE = {name: sql for m in MODULES for name, sql in m.R.oracle.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalize, deduplicate, decontaminate and split the documents, then summarize each split by language."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars", keys.text_key(F.col("text")).alias("text_key"))
    guarded = table(spark, sf_dir, "benchmark").select(keys.text_key(F.col("text")).alias("text_key")).distinct()
    first = corpus.keep_first(docs, "text_key", "doc_id").join(guarded, "text_key", "left_anti")
    split = first.withColumn("split", keys.split_of("s1", F.col("doc_id"), F.col("text_key"), 0.1))
    return split.groupBy("split", "lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"), F.max("n_chars").alias("longest"))


QUERIES["flagship_admission"] = flagship
ORACLE["flagship_admission"] = f"""
WITH d AS (SELECT min(doc_id) AS doc_id, {corpus._KEY} AS k FROM documents GROUP BY 2),
f AS (SELECT d.doc_id, k, lang, n_chars FROM d JOIN documents USING (doc_id) WHERE k NOT IN (SELECT {corpus._KEY} FROM benchmark)),
s AS (SELECT *, CASE WHEN ('0x' || substr(sha256('s1:' || doc_id::VARCHAR || ':' || k), 1, 8))::BIGINT / 4294967295.0 < 0.1 THEN 'val' ELSE 'train' END AS split FROM f)
SELECT split, lang, count(*)::BIGINT AS n, sum(n_chars)::BIGINT AS chars, max(n_chars)::BIGINT AS longest FROM s GROUP BY 1, 2"""
