"""Queries over the planned sources: tables written in a source's format by Spark, then read by it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casegrid.plans.registry import Registry
from casegrid.session import spread, table, work_folder
from casegrid.sources import planned
from casegrid.sources.transcripts import record_lines

R = Registry()

#: letters of a piece of text, bytes of a chunk and milliseconds between chunks of the recorded transcripts
PIECE, CHUNK, GAP_MS = 7, 23, 5
_ROLE = 'data: {"choices":[{"delta":{"role":"assistant"}}]}\n\n'


def recorded(turns: DataFrame) -> DataFrame:
    """Assistant turns as the chunks of an event stream: a role event, a comment, a broken event, pieces of text, usage, and (in even conversations) the end mark."""
    pieces = F.expr(f"filter(sequence(1, greatest(1, int(ceil(length(text) / {PIECE})))), i -> (i - 1) * {PIECE} < length(text))")
    event = lambda body: F.concat(F.lit("data: "), F.to_json(body), F.lit("\n\n"))
    delta = lambda i: event(F.struct(F.array(F.struct(F.struct(F.substring("text", (i - 1) * PIECE + 1, F.lit(PIECE)).alias("content")).alias("delta"))).alias("choices")))
    usage = event(F.struct(F.array(F.struct(F.struct(F.lit(None).cast("string").alias("content")).alias("delta"))).alias("choices"), F.struct(F.length("text").alias("prompt_tokens"), F.size(pieces).alias("completion_tokens")).alias("usage")))
    end = F.when(F.col("conv_id") % 2 == 0, "data: [DONE]\n\n").otherwise("data: {\"choi")
    stream = F.concat(F.lit(_ROLE), F.lit(": keep-alive\n\ndata: {oops\r\n\r\n"), F.array_join(F.transform(pieces, delta), ""), usage, end)
    data = turns.select(F.concat_ws("-", "conv_id", "turn").alias("transcript"), F.encode(stream, "utf-8").alias("data"))
    # only the chunks leave the row: a copy of the whole stream beside each would grow with the square of its length
    cut = F.expr(f"transform(sequence(0, int((length(data) - 1) / {CHUNK})), k -> substring(data, k * {CHUNK} + 1, {CHUNK}))")
    return data.select("transcript", F.posexplode(cut).alias("k", "chunk"))


@R.add("s13_transcripts", f"""
SELECT conv_id || '-' || turn AS transcript, text AS content, ({GAP_MS} * ceil({len(_ROLE) - 1} / {CHUNK}.0))::DOUBLE AS ttft_ms, length(text)::BIGINT AS prompt_tokens,
 ceil(length(text) / {PIECE}.0)::BIGINT AS completion_tokens, (2 + ceil(length(text) / {PIECE}.0))::BIGINT AS events, (CASE WHEN conv_id % 2 = 0 THEN 1 ELSE 2 END)::BIGINT AS malformed,
 conv_id % 2 = 0 AS complete FROM conversations WHERE role = 'assistant'""")
def s13(spark: SparkSession, d: str) -> DataFrame:
    """Recorded event streams, cut anywhere and partly broken off, read back by the planned source."""
    planned.register(spark)
    folder = work_folder(spark, "transcripts")
    chunks = recorded(spread(table(spark, d, "conversations").where("role = 'assistant'"), "conv_id"))
    record_lines(chunks, F.col("transcript"), F.col("k"), GAP_MS * (F.col("k") + 1), F.col("chunk")).write.text(folder)
    return spark.read.format("sse_transcripts").option("split_bytes", 8 << 20).load(folder).select("transcript", "content", "ttft_ms", "prompt_tokens", "completion_tokens", "events", "malformed", "complete")


@R.add("s2_strict_lines", "SELECT doc_id, lang, n_chars::BIGINT AS n_chars, source FROM documents WHERE source = 'src3' AND lang IN ('en', 'fr')")
def s2(spark: SparkSession, d: str) -> DataFrame:
    """Strict JSON lines by byte ranges; both filters are the source's."""
    planned.register(spark)
    folder = work_folder(spark, "lines")
    table(spark, d, "documents").select("doc_id", "lang", "n_chars", "source").write.json(folder)
    rows = spark.read.format("case_lines").schema("doc_id long, lang string, n_chars long, source string").option("split_bytes", 1 << 20).load(folder)
    return rows.where((F.col("source") == "src3") & F.col("lang").isin("en", "fr"))


@R.add("s11_ticket_batches", "SELECT event_id AS case_id, event_type AS queue_status FROM events WHERE event_type = 'purchase' AND user_id = 3 UNION ALL SELECT event_id, event_type FROM events WHERE event_type <> 'error' AND user_id = 5")
def s11(spark: SparkSession, d: str) -> DataFrame:
    """A ticket with a status and one without (which leaves the hidden status out), both with a filter that the source takes."""
    planned.register(spark)
    folder = work_folder(spark, "cases")
    table(spark, d, "events").select(F.col("event_id").alias("case_id"), F.col("event_type").alias("queue_status"), "user_id", "ts").write.parquet(folder)
    store = spark.read.format("case_tickets").option("columns", "case_id, queue_status, user_id").option("hidden", "error")
    with_status = store.option("ticket", "cases?status=purchase").load(folder).where("user_id = 3")
    every = spark.read.format("case_tickets").option("columns", "case_id, queue_status, user_id").option("hidden", "error").load(folder).where("user_id = 5")
    return with_status.unionByName(every).drop("user_id")
