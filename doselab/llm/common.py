"""What the operators share: shared scratch tables, Arrow batch bounds, column checks."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: A side is broadcast only when it has at most so many rows (of a few longs each); otherwise it is shuffled.
BROADCAST_ROWS = 200_000
#: A key is split over tasks from so many rows on, and if it holds more than one in so many of all rows.
HEAVY_ROWS, HEAVY_KEYS = 2000, 5000


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors and the driver share. A local session that names none gets one; a cluster must name its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        context = spark.sparkContext
        if context.getCheckpointDir() is None:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise ValueError("spark.checkpoint.dir names no folder that the executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="doselab-"))
        found = context.getCheckpointDir()
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/doselab-{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared folder and read again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder of scratch data."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def bounded_batches(spark: SparkSession, rows: int = 2000, size: int = 4 << 20) -> None:
    """Keep Arrow batches small, however long the texts: a worker holds one batch at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def freed(fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """fn, at whose end the worker gives freed memory back to the system: Spark keeps idle workers beside the running ones."""

    def give_back() -> None:
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
        if trim:
            trim(0)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()  # what the worker's last task left
        try:
            yield from fn(batches)
        finally:
            give_back()

    return each


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | Iterable[pa.RecordBatch] | None], schema: str) -> DataFrame:
    """fn over every Arrow batch."""
    bounded_batches(df.sparkSession)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = fn(batch)
            if out is not None:
                yield from [out] if isinstance(out, pa.RecordBatch) else out

    return df.mapInArrow(freed(each), schema)


def held_out(doc_id: Column, modulus: int, rest: int) -> Column:
    return F.crc32(doc_id.cast("string")) % modulus == rest


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> bool:
    """Whether df has at most limit rows; reads at most limit + 1 of them."""
    return df.limit(limit + 1).count() <= limit


def whole_rows(docs: DataFrame) -> DataFrame:
    """docs as one struct column ``row``, so that no name of an operator's own meets a column of docs."""
    return docs.select(F.struct("*").alias("row"))


def split_keys(many: DataFrame, keys: list[str], least: int = HEAVY_ROWS) -> tuple[DataFrame, Callable[[DataFrame], DataFrame], list[str]]:
    """many and a function for tables that have each key once at most, so that both join on the keys returned.

    Keys with more than a share of 1 / ``HEAVY_KEYS`` of many's rows (so under ``HEAVY_KEYS`` of them, whatever the size)
    are dealt over several tasks: their rows by a hash of all columns, their row of the other table to each part.
    A key of up to least rows is never split.
    """
    n = many.count()
    per = max(least, n // HEAVY_KEYS)
    if n <= per:
        return many, lambda one: one, keys
    heavy = many.groupBy(*keys).agg(F.count("*").alias("_c")).where(F.col("_c") > per).select(*keys, F.ceil(F.col("_c") / per).cast("int").alias("_parts"))
    heavy = materialise(heavy, "heavy")
    if not heavy.limit(1).count():
        return many, lambda one: one, keys
    parts = F.coalesce("_parts", F.lit(1))
    dealt = many.join(F.broadcast(heavy), keys, "left").withColumn("_part", F.pmod(F.xxhash64(*many.columns), parts).cast("int")).drop("_parts")
    return dealt, lambda one: one.join(F.broadcast(heavy), keys, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts"), [*keys, "_part"]


def split_join(many: DataFrame, one: DataFrame, keys: list[str], how: str = "inner", least: int = HEAVY_ROWS) -> DataFrame:
    """many joined with one, which has each key once at most; keys that are heavy in many are split. many should be written."""
    many, give, on = split_keys(many, keys, least)
    out = many.join(give(one), on, how)
    return out.drop("_part") if len(on) > len(keys) else out


def running(table: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """table with, for each name in sums, the column's total over all rows before; order must tell all rows apart.

    Rows are dealt into ranges and written, so that the ranges stay the same; totals of ranges (one row each) run in
    one window, rows in a window of their range.
    """
    ranged = materialise(table.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranged")
    before = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    inside = W.partitionBy("_range").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    totals = ranged.groupBy("_range").agg(*[F.sum(c).alias(f"_{n}") for n, c in sums.items()])
    totals = totals.select("_range", *[F.sum(f"_{n}").over(before).alias(f"_{n}") for n in sums])
    out = ranged.join(F.broadcast(totals), "_range")
    for n, c in sums.items():
        out = out.withColumn(n, F.coalesce(F.col(f"_{n}"), F.lit(0)) + F.coalesce(F.sum(c).over(inside), F.lit(0))).drop(f"_{n}")
    return out.drop("_range")


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs without the rows whose doc_id and text's hash are in gone (doc_id, text_hash); null is a doc_id like any other."""
    rows = whole_rows(docs).withColumn("doc_id", F.col("row.doc_id").cast("long")).withColumn("text_hash", F.xxhash64("row.text"))
    gone = gone.select(F.col("doc_id").alias("_doc_id"), F.col("text_hash").alias("_text_hash"))
    same = F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("text_hash") == F.col("_text_hash"))
    return rows.join(gone, same, "left_anti").select("row.*")


def release(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete written tables that nothing reads any more and let Spark drop the shuffle files of finished phases."""
    for table in tables:
        discard(spark, table.scratch_path)
    gc.collect()
    spark._jvm.System.gc()
