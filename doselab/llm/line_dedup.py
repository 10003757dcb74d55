"""Line deduplication over levelled sorted runs of line hashes.

Every line key that counts is hashed to 128 bits. Documents are taken in ascending batches of doc_id. A run is a
table of distinct keys with their first document, bucketed and sorted by hash, so that a batch's own keys
merge-join all runs bucket by bucket without moving them again; keys found in no run form the batch's new run.
``FAN`` runs of one level are compacted into one of the next. Only positions to drop go back to the texts.
Everything is DataFrame operations.

Defined results: null and empty texts are one empty line; texts of any length are split whole (a row's lines are one
array); rows without doc_id take no part and keep their lines; rows that share a doc_id are one document, whose lines
none of its rows loses to another, but each row loses and keeps lines of its own text alone; repeated rows each keep
theirs; an empty table gives an empty result; extra columns of any name are kept by deduplicate_lines().
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from doselab.llm.common import HEAVY_KEYS, HEAVY_ROWS, discard, materialise, scratch, small, whole_rows

#: Batches at least, documents a batch from there on, keys in a bucket of a run; runs that are compacted at once.
BATCHES, PER_BATCH, PER_BUCKET, FAN, MIN_POINTS = 4, 50_000_000, 20_000_000, 2, 10
#: Fixed values of the contract: what is stripped from a line's ends.
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(BLANKS)), _UPPER, _LOWER)


class Runs:
    """The levelled runs: (level, bucketed table of h1, h2, first)."""

    def __init__(self, spark: SparkSession, buckets: int):
        self.spark, self.buckets = spark, buckets
        self.levels: list[tuple[int, str]] = []
        self.paths: dict[str, str] = {}

    def write(self, keys: DataFrame) -> str:
        """keys as a bucketed, sorted table."""
        name, path = f"doselab_run_{uuid.uuid4().hex}", scratch(self.spark, "run")
        self.paths[name] = path
        (keys.repartition(self.buckets, "h1").write.option("path", path).bucketBy(self.buckets, "h1").sortBy("h1", "h2").format("parquet").saveAsTable(name))
        return name

    def drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        discard(self.spark, self.paths.pop(name))

    def first_seen(self, own: str) -> DataFrame:
        """A batch's keys with the earliest document of any run, null where no run has the key."""
        found = self.spark.table(own)
        seen = []
        for k, (_, name) in enumerate(self.levels):
            run = self.spark.table(name).select("h1", "h2", F.col("first").alias(f"_r{k}"))
            found = found.hint("merge").join(run, ["h1", "h2"], "left")
            seen.append(F.col(f"_r{k}"))
        before = F.coalesce(*seen) if seen else F.lit(None).cast("long")
        return found.select("h1", "h2", "first", "last", "n", before.alias("before"))

    def add(self, keys: DataFrame) -> None:
        self.levels.append((0, self.write(keys)))
        while len(self.levels) >= FAN and len({level for level, _ in self.levels[-FAN:]}) == 1:
            old = self.levels[-FAN:]
            merged = None
            for _, name in old:
                part = self.spark.table(name)
                merged = part if merged is None else merged.unionByName(part)
            self.levels[-FAN:] = [(old[0][0] + 1, self.write(merged))]
            for _, name in old:
                self.drop(name)

    def close(self) -> None:
        for name in list(self.paths):
            self.drop(name)


def drops(docs: DataFrame, batches: int | None = None) -> DataFrame:
    """doc_id, _own (the text's hash) and the sorted positions of the lines that such a row loses, if it loses any."""
    spark = docs.sparkSession
    key = F.transform(lines_of(F.col("text")), line_key)
    docs = docs.where("doc_id is not null")
    batches = batches or max(BATCHES, math.ceil(docs.count() / PER_BATCH))
    cuts = docs.select(F.percentile_approx("doc_id", [k / batches for k in range(1, batches)], 1000)).first()[0] or [] if batches > 1 else []
    batch = F.lit(0)
    for cut in cuts:
        batch = batch + (F.col("doc_id") > F.lit(cut)).cast("int")
    lines = docs.select("doc_id", F.xxhash64("text").alias("_own"), F.posexplode(key).alias("pos", "key")).where(F.length("key") >= MIN_POINTS)
    path = scratch(spark, "lines")
    lines.select("doc_id", "_own", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), batch.alias("batch")).write.partitionBy("batch").parquet(path)
    table = spark.read.schema("doc_id long, _own long, pos int, h1 long, h2 long, batch int").parquet(path)
    size = table.count()
    runs = Runs(spark, max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / PER_BUCKET)))
    out = scratch(spark, "drops")
    keys = ["h1", "h2"]
    try:
        for b in range(batches):
            part = table.where(F.col("batch") == b)
            own = runs.write(part.groupBy(*keys).agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("n")))
            seen = materialise(runs.first_seen(own), "seen")
            twice = seen.where("before is not null or last > first").select(*keys, F.coalesce("before", "first").alias("first"), "n")
            if small(twice):
                found = part.join(F.broadcast(twice.drop("n")), keys)
            else:
                # The few keys that hold a large share of all lines (under HEAVY_KEYS of them) are looked up, the rest merged.
                common = F.col("n") > max(HEAVY_ROWS, size // HEAVY_KEYS)
                heavy = F.broadcast(twice.where(common).drop("n"))
                found = part.join(heavy, keys).unionByName(part.join(heavy.select(*keys), keys, "left_anti").join(twice.where(~common).drop("n").hint("merge"), keys))
            found.where("doc_id > first").select("doc_id", "_own", "pos").write.mode("append").parquet(out)
            if b + 1 < batches:
                runs.add(seen.where("before is null").select(*keys, "first"))
            runs.drop(own)
            discard(spark, seen.scratch_path)
    finally:
        runs.close()
    lost = spark.read.schema("doc_id long, _own long, pos int").parquet(out).groupBy("doc_id", "_own").agg(F.sort_array(F.collect_set("pos")).alias("_lost"))
    lost = materialise(lost, "lost")
    discard(spark, path)
    discard(spark, out)
    return lost


def _with_drops(docs: DataFrame) -> DataFrame:
    """row (docs' columns) and _lost (null: nothing)."""
    lost = drops(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    rows = whole_rows(docs).withColumn("doc_id", F.col("row.doc_id").cast("long")).withColumn("_own", F.xxhash64("row.text"))
    # One shuffle of the texts at every size: the documents that lose lines grow with the corpus.
    return rows.join(lost.hint("merge"), ["doc_id", "_own"], "left").select("row", "_lost")


def _kept(text: Column, lost: Column) -> Column:
    """The text without its lost lines. The lines are bound once, however many lambdas read them."""

    def keep(lines: Column) -> Column:
        places = F.array_except(F.sequence(F.lit(1), F.size(lines)), F.transform(lost, lambda p: p + 1))
        return F.array_join(F.transform(places, lambda p: F.element_at(lines, p)), "\n")

    return F.when(lost.isNull(), F.coalesce(text, F.lit(""))).otherwise(F.transform(F.array(lines_of(text)), keep)[0])


def deduplicate_lines(docs: DataFrame) -> DataFrame:
    """docs with text rewritten; the other columns and their order stay."""
    text = F.when(F.col("_lost").isNull(), F.col("row.text")).otherwise(_kept(F.col("row.text"), F.col("_lost")))
    return _with_drops(docs).select(F.col("row").withField("text", text).alias("row")).select("row.*")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _with_drops(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    text = F.col("row.text")
    return out.select(
        F.col("row.doc_id").alias("doc_id"),
        F.size(lines_of(text)).cast("long").alias("n_lines"),
        F.when(F.col("_lost").isNull(), F.lit(0)).otherwise(F.size("_lost")).cast("long").alias("n_dropped"),
        F.sha2(F.encode(_kept(text, F.col("_lost")), "UTF-8"), 256).alias("kept_sha256"),
    )


ORACLE = r"""
WITH l AS (
  SELECT doc_id, pos, line,
         translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents), unnest(a) WITH ORDINALITY AS u(line, pos)
), f AS (
  SELECT k, min(doc_id) AS first FROM l WHERE length(k) >= 10 GROUP BY k
), m AS (
  SELECT l.doc_id, l.pos, l.line, coalesce(l.doc_id > f.first, FALSE) AS gone FROM l LEFT JOIN f ON l.k = f.k
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
