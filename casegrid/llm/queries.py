"""The thin ``opN_<name>`` queries of the training-data operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casegrid.llm import duck_bpe, edit_embedding, filter_audit, jaccard_join, language, line_crf, line_rules, maxent_lm, oracle, packing, suffix_dedup, token_files, toxicity, whitening
from casegrid.llm.common import documents, fold, labelled
from casegrid.llm.tokens import vocabulary_path


def op1_maxent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text").withColumn("held_out", fold(F.col("doc_id")) % 7 == 2)
    return maxent_lm.score_documents(docs)


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang").withColumn("held_out", fold(F.col("doc_id")) % 3 == 1)
    dictionaries = language.learn(docs.where("not held_out"))
    return language.identify(docs.select("doc_id", "held_out", "text"), dictionaries)


def op3_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules.clean_lines(documents(spark, sf_dir), with_text=False)


def op4_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text").withColumn("held_out", fold(F.col("doc_id")) % 4 == 2)
    model = line_crf.learn(docs, labelled(spark, sf_dir).where(fold(F.col("doc_id")) % 4 != 2))
    scored = line_crf.score(docs, model)
    return scored.select("doc_id", "held_out", F.col("quality_score").alias("score"), (F.col("quality_score") >= 0.7).cast("int").alias("predicted"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(documents(spark, sf_dir).select("doc_id", "text"))


def op6_edit_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_embedding.with_near_class(edit_embedding.fingerprint_edits(documents(spark, sf_dir)), "doc_id")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(documents(spark, sf_dir), vocabulary_path("word_bpe_49k.json"), end_id=1)


def op8_duck_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return duck_bpe.encode(documents(spark, sf_dir), vocabulary_path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.components(documents(spark, sf_dir).select("doc_id", "text")).drop("key", "text_key")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), vocabulary_path("word_bpe_49k.json"), end_id=0)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(documents(spark, sf_dir), labelled(spark, sf_dir))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text").withColumn("held_out", fold(F.col("doc_id")) % 5 == 0)
    model = toxicity.learn(docs, labelled(spark, sf_dir).where(fold(F.col("doc_id")) % 5 != 0))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", "held_out", F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(spark.read.parquet(f"{sf_dir.rstrip('/')}/embeddings.parquet"))


QUERIES = {
    "op1_maxent_lm": op1_maxent_lm,
    "op2_language": op2_language,
    "op3_line_rules": op3_line_rules,
    "op4_line_crf": op4_line_crf,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_edit_embedding": op6_edit_embedding,
    "op7_token_files": op7_token_files,
    "op8_duck_bpe": op8_duck_bpe,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_packing": op10_packing,
    "op11_filter_audit": op11_filter_audit,
    "op12_toxicity": op12_toxicity,
    "op13_whitening": op13_whitening,
}
ORACLE = oracle.ORACLE
