"""The corpus pipeline: five stages over ``documents``, each written as Parquet and reread by the next.

Defined results, for all stages: a null or empty text has no words, so the first
stage rejects it; stages that meet one later (a text of which nothing is left)
keep it as an empty text, and packing gives it one piece of the end id. Null ids
are ids like others and come last. Equal rows are judged alike, and of them, as
of all near duplicates, the one of the least id stays (of rows that repeat in
full, one). An empty table gives no rows in every stage. Long texts are read
whole; memory grows with the longest. Further columns travel along unchanged,
whatever their names, but for ``n_chars``, which follows the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casegrid.llm import jaccard_join, line_crf, line_rules, packing, suffix_dedup
from casegrid.llm.common import documents, fold, remove_dir, shared_dir
from casegrid.llm.tokens import vocabulary_path


def _whole(docs: DataFrame) -> DataFrame:
    """row (all columns as one struct) and text: what operators get, so that no name of a column meets one of theirs."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text").cast("string").alias("text"))


def _columns(made: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """The columns of ``docs`` from ``made`` (row, ...), with a new text and its length."""

    def column(name: str):
        if name == "text":
            return F.col(text)
        if name == "n_chars":
            return F.length(text).cast(docs.schema["n_chars"].dataType)
        return F.col("row").getField(name)

    return made.select(*[column(c).alias(c) for c in docs.columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the line rules, without their failing lines."""
    judged = line_rules.clean_documents(_whole(docs))
    return _columns(judged.where("kept"), docs, "cleaned_text")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line CRF, learned on this input's labelled training rows, scores 0.7 or more."""
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")
    model = line_crf.learn(docs, labels.where(fold(F.col("doc_id")) % 4 != 2))
    scored = line_crf.score(_whole(docs), model, with_text=True)
    return _columns(scored.where(F.col("quality_score") >= 0.7), docs, "text")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of the n-gram Jaccard join: the one of the least doc_id."""
    return jaccard_join.representatives(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without the bytes of passages that repeat; what is left of a character that was cut goes too."""
    return _columns(suffix_dedup.dedup(_whole(docs), with_text=True), docs, "left_text")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, packed into sequences; workers that have run the other stages remember fewer words."""
    return packing.pack(docs, vocabulary_path("word_bpe_49k.json"), end_id=0, remember=120_000)


STAGES = [
    ("quality_rules", quality_rules),
    ("quality_classifier", quality_classifier),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("best_fit_packing", packed),
]

#: No stage but the first could be said in SQL: a trained model, connected components over similarities and a greedy packing follow.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; every result but the last is written to the shared folder and reread."""
    docs = documents(spark, sf_dir)
    before = None
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        path = shared_dir(spark, f"pipeline-{name}")
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
        if before:
            remove_dir(spark, before)
        before = path
    return docs
