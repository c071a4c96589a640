"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Fixed value: the only characters that separate words (space, \t, \n, \v, \f, \r).
#: ``bytes.split()`` splits on exactly these.
WHITE = b" \t\n\x0b\x0c\r"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")


def words(text: str | None) -> list[bytes]:
    """Maximal runs of characters other than the six ASCII white-space ones, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def fold(col: Column) -> Column:
    """crc32 of the id written as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary"))


def lower_ascii(data: bytes) -> bytes:
    """Lower-case A-Z only (``bytes.lower`` touches no other byte)."""
    return data.lower()


#: the one column in which an operator carries its input's other columns
CARRIED = "carried_row"


def carry(docs: DataFrame, *more: Column) -> DataFrame:
    """(carried_row, text, *more): all columns but text travel as one struct, so none of their names can clash with an operator's own."""
    others = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    packed = F.struct(*others) if others else F.lit(None).cast("struct<none:int>")
    return docs.select(packed.alias(CARRIED), F.col("text").cast("string").alias("text"), *more)


def opened(made: DataFrame, docs: DataFrame, new: list[str]) -> DataFrame:
    """The columns of ``docs`` out of carried_row, then ``new``. A column of the input that has a new one's name gives way to it."""
    taken = {"text", *(c.lower() for c in new)}
    kept = [c for c in docs.columns if c.lower() not in taken]
    return made.select(*[F.col(CARRIED).getField(c).alias(c) for c in kept], *new)


def drawn(key: Column | str, share: float) -> Column:
    """True for about a share of different keys, the same ones every time; fine enough for any number of them (a step is 2**-64)."""
    return F.lit(True) if share >= 1 else F.xxhash64(F.lit("drawn"), key) < F.lit(int(share * 2**64) - 2**63)


def sample_share(rows: DataFrame, size: Column, rows_at_most: int, bytes_at_most: int) -> float:
    """The share of rows that keeps a sample within both bounds (as expected); 0 for an empty table."""
    n, size = rows.agg(F.count("*"), F.sum(size)).first()
    return min(1.0, rows_at_most / n, bytes_at_most / max(1, size or 0)) if n else 0.0


def refuse_empty(found: int, share: float, what: str) -> None:
    """A sample of a part that came out empty would leave all rows to one task."""
    if not found and 0 < share < 1:
        raise ValueError(f"the sample of {what} is empty at a share of {share:.3g}: raise its bounds")


def widened(df: DataFrame, drop: tuple[str, ...], added: str) -> StructType:
    """Schema of ``df`` without ``drop``, then the fields of the DDL text ``added``."""
    return StructType([f for f in df.schema.fields if f.name not in drop] + StructType.fromDDL(added).fields)


def release() -> None:
    """Give memory that is no longer used back to the system: Python workers live on from task to task."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidy(fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``fn`` for mapInArrow, with ``release`` after its last batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(batches)
        release()

    return run


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder (URI) that the driver and every executor can see.

    Lies under ``spark.checkpoint.dir``; where that is unset a local session
    (tests) gets a folder of its own, and a cluster an error: executors couldn't
    see a folder of the driver's machine.
    """
    root = checkpoint_root(spark)
    return f"{root.rstrip('/')}/casegrid-{name}-{uuid.uuid4().hex[:12]}"


def checkpoint_root(spark: SparkSession) -> str:
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if root is None:
        current = sc._jsc.sc().getCheckpointDir()
        if not current.isDefined() and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = current.get() if current.isDefined() else f"file://{tempfile.mkdtemp(prefix='casegrid-')}"
        if not current.isDefined():
            sc.setCheckpointDir(root)
    elif not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(root)
    return root


def stored(df: DataFrame, spark: SparkSession, name: str, block_size: int | None = None) -> DataFrame:
    """Write a table once to the shared folder and read it back: cuts lineage, survives lost executors.

    ``block_size``: bytes that a writer holds before it writes them, for tables of large values.
    """
    path = shared_dir(spark, name)
    writer = df.write if block_size is None else df.write.option("parquet.block.size", str(block_size))
    writer.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.stored_at = path  # for ``forget``: an empty table has no files to tell by
    return table


def free_finished(spark: SparkSession) -> None:
    """Let the context drop shuffle files of stages whose result is written."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def forget(*tables: DataFrame) -> None:
    """Delete the folders of ``stored`` tables that nothing reads any more."""
    for table in tables:
        at = vars(table).get("stored_at")
        for path in [at] if at else [file.rsplit("/", 1)[0] for file in table.inputFiles()[:1]]:
            remove_dir(table.sparkSession, path)


def remove_dir(spark: SparkSession, path: str) -> None:
    """Delete a folder written by ``stored`` or an operator."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
