"""Evaluation queries on labels and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casegrid.operators import backend, scores
from casegrid.plans.registry import Registry
from casegrid.session import table

R = Registry()

#: A rule-based predictor to be evaluated: few symbols for the length, and not all capitals.
_RULE = "length(regexp_replace(d.text, '[^#*$%&|!]', '', 'g')) * 50 < length(d.text)"
_PRED = f"WITH p AS (SELECT d.doc_id, d.lang, l.quality = 1 AS gold, ({_RULE}) AS said FROM documents d JOIN labels l ON l.doc_id = d.doc_id) "


def _predicted(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "lang", (F.length(F.regexp_replace("text", "[^#*$%&|!]", "")) * 50 < F.length("text")).alias("said"))
    return docs.join(table(spark, d, "labels").select("doc_id", (F.col("quality") == 1).alias("gold")), "doc_id")


def _counts() -> list:
    return [
        F.count_if(F.col("said") & F.col("gold")).alias("tp"),
        F.count_if(F.col("said") & ~F.col("gold")).alias("fp"),
        F.count_if(~F.col("said") & F.col("gold")).alias("fn"),
    ]


_TPS = "sum((said AND gold)::INT)::BIGINT AS tp, sum((said AND NOT gold)::INT)::BIGINT AS fp, sum((NOT said AND gold)::INT)::BIGINT AS fn"


@R.add("j14_tp_fp_fn", _PRED + f"SELECT lang, {_TPS} FROM p GROUP BY 1")
def j14(spark: SparkSession, d: str) -> DataFrame:
    """True and false positives and misses by group."""
    return _predicted(spark, d).groupBy("lang").agg(*_counts())


@R.add("a12_micro_macro_f1", _PRED + f""", g AS (SELECT lang, {_TPS} FROM p GROUP BY 1),
m AS (SELECT *, tp / nullif(tp + fp, 0) AS pr, tp / nullif(tp + fn, 0) AS re FROM g),
t AS (SELECT sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM g)
SELECT 'macro' AS kind, round(avg(coalesce(pr, 0)), 4) AS precision, round(avg(coalesce(re, 0)), 4) AS recall,
       round(avg(CASE WHEN coalesce(pr, 0) + coalesce(re, 0) > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END), 4) AS f1 FROM m
UNION ALL SELECT 'micro', round(tp / (tp + fp), 4), round(tp / (tp + fn), 4), round(2 * tp / (2 * tp + fp + fn), 4) FROM t""")
def a12(spark: SparkSession, d: str) -> DataFrame:
    """Micro scores from sums, macro scores as means over groups."""
    groups = _predicted(spark, d).groupBy("lang").agg(*_counts())
    by_group = groups.select(*[c.alias(k) for k, c in scores.precision_recall(F.col("tp"), F.col("fp"), F.col("fn")).items()])
    macro = by_group.agg(*[F.round(F.avg(k), 4).alias(k) for k in ("precision", "recall", "f1")]).select(F.lit("macro").alias("kind"), "*")
    total = groups.agg(*[F.sum(k).alias(k) for k in ("tp", "fp", "fn")])
    micro = total.select(F.lit("micro").alias("kind"), *[F.round(c, 4).alias(k) for k, c in scores.precision_recall(F.col("tp"), F.col("fp"), F.col("fn")).items()])
    return macro.unionByName(micro)


@R.add("a14_null_safe_rates", _PRED + "SELECT lang, gold, round(sum((said AND gold)::INT) / nullif(sum(gold::INT), 0), 4) AS rate FROM p GROUP BY 1, 2")
def a14(spark: SparkSession, d: str) -> DataFrame:
    """Rates that are null, not zero, without trials."""
    rate = scores.ratio(F.count_if(F.col("said") & F.col("gold")), F.count_if(F.col("gold")), None)
    return _predicted(spark, d).groupBy("lang", "gold").agg(F.round(rate, 4).alias("rate"))


@R.add("a15_wilson", _PRED + """, g AS (SELECT lang, count(*)::DOUBLE AS n, sum((said = gold)::INT)::DOUBLE AS k FROM p GROUP BY 1)
SELECT lang, round(greatest(0.0, (k / n + 3.8416 / (2 * n) - 1.96 * sqrt((k / n * (1 - k / n) + 3.8416 / (4 * n)) / n)) / (1 + 3.8416 / n)), 4) AS low FROM g""")
def a15(spark: SparkSession, d: str) -> DataFrame:
    """Lower end of the Wilson interval of the accuracy."""
    p = _predicted(spark, d).groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.col("said") == F.col("gold")).alias("k"))
    return p.select("lang", F.round(scores.wilson_low(F.col("k"), F.col("n")), 4).alias("low"))


@R.add("a26_composite", """
SELECT doc_id, round(0.20 + 0.20 * CASE WHEN n_chars > 200 THEN 1.0 ELSE 0.5 END + 0.30 * c + 0.15 * l + 0.15, 4) AS score FROM (
 SELECT doc_id, n_chars,
   CASE WHEN lang = 'en' THEN (contains(text, 'the')::INT + contains(text, 'license')::INT) / 2.0 ELSE 1.0 END AS c,
   (contains(text, '.')::INT + contains(text, ',')::INT + contains(text, '|')::INT) / 3.0 AS l FROM documents)""")
def a26(spark: SparkSession, d: str) -> DataFrame:
    """Composite score; expected lists against what a text holds, an empty list counts as found."""
    want = lambda *words: F.array(*[F.lit(w) for w in words])
    held = lambda *words: F.array_compact(F.array(*[F.when(F.col("text").contains(w), w) for w in words]))
    conditions = scores.share_found(F.when(F.col("lang") == "en", want("the", "license")).otherwise(F.array().cast("array<string>")), held("the", "license"))
    labs = scores.share_found(want(".", ",", "|"), held(".", ",", "|"))
    schema = F.when(F.col("n_chars") > 200, 1.0).otherwise(0.5)
    drugs = scores.share_found(F.array().cast("array<string>"), F.array().cast("array<string>"))
    return table(spark, d, "documents").select("doc_id", F.round(scores.composite(F.lit(True), schema, conditions, labs, drugs), 4).alias("score"))


@R.add("a27_bands", """
WITH s AS (SELECT lang, avg((quality = 1)::INT) OVER (PARTITION BY source, lang) AS r FROM documents JOIN labels USING (doc_id))
SELECT CASE WHEN r >= 1 THEN 'perfect' WHEN r >= 0.8 THEN 'good' WHEN r > 0 THEN 'partial' ELSE 'none' END AS band, count(*)::BIGINT AS n FROM s GROUP BY 1""")
def a27(spark: SparkSession, d: str) -> DataFrame:
    """Histogram by score band."""
    docs = table(spark, d, "documents").select("doc_id", "lang", "source").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id")
    cells = docs.groupBy("source", "lang").agg(F.count("*").alias("n"), F.avg((F.col("quality") == 1).cast("int")).alias("r"))
    band = F.when(F.col("r") >= 1, "perfect").when(F.col("r") >= 0.8, "good").when(F.col("r") > 0, "partial").otherwise("none")
    return cells.groupBy(band.alias("band")).agg(F.sum("n").alias("n"))


@R.add("a16_top_codes", """
SELECT lang, source, n FROM (SELECT lang, source, count(*)::BIGINT AS n, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, source) AS r FROM documents GROUP BY 1, 2) WHERE r <= 10""")
def a16(spark: SparkSession, d: str) -> DataFrame:
    """The ten most common values of each bucket."""
    from pyspark.sql import Window

    counted = table(spark, d, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"))
    r = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "source"))
    return counted.withColumn("r", r).where("r <= 10").drop("r")


@R.add("a31_pass_rates", _PRED + "SELECT round(avg(CASE WHEN said THEN gold::INT END), 4) AS over_answers, round(avg((said AND gold)::INT), 4) AS over_all FROM p")
def a31(spark: SparkSession, d: str) -> DataFrame:
    """Pass rate over rows with an answer, and over all rows."""
    ok = (F.col("said") & F.col("gold")).cast("int")
    return _predicted(spark, d).agg(F.round(F.avg(F.when(F.col("said"), F.col("gold").cast("int"))), 4).alias("over_answers"), F.round(F.avg(ok), 4).alias("over_all"))


@R.add("a32_missing_extra", """
WITH v AS (SELECT user_id, list(DISTINCT event_type) FILTER (WHERE value >= 40) AS gold, list(DISTINCT event_type) FILTER (WHERE value < 60) AS said FROM events GROUP BY 1)
SELECT user_id, len(list_filter(coalesce(gold, []), lambda x: NOT list_contains(coalesce(said, []), x)))::INTEGER AS missing,
       len(list_filter(coalesce(said, []), lambda x: NOT list_contains(coalesce(gold, []), x)))::INTEGER AS extra FROM v""")
def a32(spark: SparkSession, d: str) -> DataFrame:
    """Missing and false-positive codes by set difference."""
    v = table(spark, d, "events").groupBy("user_id").agg(F.collect_set(F.when(F.col("value") >= 40, F.col("event_type"))).alias("gold"), F.collect_set(F.when(F.col("value") < 60, F.col("event_type"))).alias("said"))
    return v.select("user_id", F.size(F.array_except("gold", "said")).alias("missing"), F.size(F.array_except("said", "gold")).alias("extra"))


@R.add("a24_section_counts", """
SELECT count(*)::BIGINT AS n, sum((role_n > 0)::INT)::BIGINT AS with_system, sum((user_n > 0)::INT)::BIGINT AS with_user, round(avg((role_n > 0 AND user_n > 0 AND asst_n > 0)::INT), 4) AS complete
FROM (SELECT conv_id, count(*) FILTER (WHERE role = 'system') AS role_n, count(*) FILTER (WHERE role = 'user') AS user_n, count(*) FILTER (WHERE role = 'assistant') AS asst_n FROM conversations GROUP BY 1)""")
def a24(spark: SparkSession, d: str) -> DataFrame:
    """Rows that have a section, and the share that has all."""
    has = lambda r: F.bool_or(F.col("role") == r)
    c = table(spark, d, "conversations").groupBy("conv_id").agg(has("system").alias("s"), has("user").alias("u"), has("assistant").alias("a"))
    return c.agg(F.count("*").alias("n"), F.count_if("s").alias("with_system"), F.count_if("u").alias("with_user"), F.round(F.avg((F.col("s") & F.col("u") & F.col("a")).cast("int")), 4).alias("complete"))


def rule_validator(texts: list[str]) -> list[str]:
    """Stands for an outside validator: a log for each ``key:priority``; it can't take a batch that holds a text with ``!``."""
    if any("!" in t for t in texts):
        raise ValueError("unreadable")
    parts = [t.split(":") for t in texts]
    return [f"Validate order-{key}.json\n  {len(priority) % 3} errors, {int(key) % 2} warnings" for key, priority in parts]


@R.add("a30_validator", """
SELECT o_orderkey, CASE WHEN o_orderkey % 211 = 0 THEN 'ValueError: unreadable' END AS error,
 CASE WHEN o_orderkey % 211 <> 0 THEN length(o_orderpriority) % 3 END::BIGINT AS errors, CASE WHEN o_orderkey % 211 <> 0 THEN o_orderkey % 2 END::BIGINT AS warnings,
 o_orderkey % 211 <> 0 AND length(o_orderpriority) % 3 = 0 AS valid FROM orders""")
def a30(spark: SparkSession, d: str) -> DataFrame:
    """Every order sent to a validator in batches; what it can't take is a row with an error, and costs no other row its answer."""
    text = F.concat_ws(":", F.col("o_orderkey").cast("string"), F.concat("o_orderpriority", F.when(F.col("o_orderkey") % 211 == 0, "!").otherwise("")))
    sent = backend.called(table(spark, d, "orders").select("o_orderkey", text.alias("text")), "o_orderkey", "text", rule_validator, backend.Policy(retries=0))
    # one answer holds one file's block
    counts = F.regexp_extract_all("answer", F.lit(r"(\d+) (?:errors|warnings)"), F.lit(1))
    row = sent.select("o_orderkey", "error", F.get(counts, F.lit(0)).cast("long").alias("errors"), F.get(counts, F.lit(1)).cast("long").alias("warnings"))
    return row.withColumn("valid", F.coalesce(F.col("errors") == 0, F.lit(False)))
