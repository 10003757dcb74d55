"""Exact top-k inner products by a three-phase uniform threshold.

Vectors are dealt into blocks of about ``BLOCK`` rows by length (norm), then by a hash; query blocks meet candidate
blocks, never rows rows. A vector is ``SLICES`` slices, each a score list of its own. Phase one: every query block meets
a few pilot blocks, in which the slices' local top lists are gathered and resolved; the k-th best total found is a safe
cutoff, since further candidates can only raise it. Phase two: the cutoffs go back with their query blocks. A total that
reaches the cutoff needs a slice of at least cutoff / SLICES, and what a block's vectors can still add to the slices read
so far is bounded by their norms: block pairs that can't reach any cutoff are skipped, candidates that can't are dropped
slice by slice, and only sufficient entries are collected. Phase three resolves those exactly. Cutoffs travel with their
query block (a bounded block of numbers), not as one broadcast. Block pairs are dealt over a grid of tasks.

Defined results: vectors that are null, empty, or hold null or non-finite components take no part (a query of that
kind has no rows), nor do rows without vec_id; vectors of any width are compared with those of the same width only; rows
that share the query's vec_id are its own (of queries that share a vec_id one stays); other repeated rows each count;
equal scores go to the smaller vec_id; an empty table gives an empty result; extra columns of any name are ignored.
Scores are exact for products below 2**53.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from doselab.llm.common import map_batches, materialise, small

#: Factor of the components; slices; rows in a block of candidates and of queries; pilot blocks of phase one.
SCALE, SLICES, BLOCK, QUERY_BLOCK, PILOTS = 256, 4, 8192, 1024, 4
#: Block pairs a task; bytes of query blocks up to which they are broadcast.
PER_TASK, BROADCAST_BYTES = 64, 32 << 20


def integer_vectors(table: DataFrame) -> DataFrame:
    """vec_id and v (array of whole doubles) of the rows that take part."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    table = table.select("vec_id", "embedding")
    good = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0) & ~F.exists("_x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    # floor() of a double gives a long; beyond that range the double itself is whole already.
    whole = F.transform("_x", lambda c: F.when(F.abs(c) < 2.0**50, F.floor(c * SCALE).cast("double")).otherwise(c * SCALE))
    return table.withColumn("_x", x).where(good).select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("v"))


def _blocks(vectors: DataFrame, rows: int) -> DataFrame:
    """One row per (width, block): ids and the matrix as bytes.

    Vectors are dealt by width and norm (in steps of a quarter of an octave), and within these by a hash of the id.
    """
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, c: s + c * c))
    dealt = vectors.withColumn("width", F.size("v")).withColumn("band", F.when(norm > 0, F.floor(4 * F.log2(norm))).otherwise(-1).cast("int"))
    # Bands are few: the floating range has under 10,000 of them a width, and data a handful.
    load = dealt.groupBy("width", "band").agg(F.ceil(F.count("*") / rows).cast("int").alias("n"))
    load = materialise(load, "load")
    dealt = dealt.join(F.broadcast(load) if small(load) else load, ["width", "band"]).withColumn("block", F.pmod(F.xxhash64("vec_id"), "n").cast("int"))

    def pack(group: pa.Table) -> pa.Table:
        width = group.column("width")[0].as_py()
        ids = np.asarray(group.column("vec_id"))
        matrix = np.asarray(group.column("v").combine_chunks().flatten()).reshape(-1, width)
        order = np.argsort(ids, kind="stable")
        return pa.table({**{c: group.column(c)[:1] for c in ("width", "band", "block")}, "ids": pa.array([ids[order].tobytes()], pa.binary()), "matrix": pa.array([matrix[order].tobytes()], pa.binary())})

    return dealt.select("width", "band", "block", "vec_id", "v").groupBy("width", "band", "block").applyInArrow(pack, "width int, band int, block int, ids binary, matrix binary")


def _pairs(blocks: DataFrame, queries: DataFrame) -> DataFrame:
    """Every pair of a candidate and a query block of one width.

    Few query blocks are broadcast; otherwise both sides are dealt over the rows and columns of a grid of tasks, each block
    to all cells of its row and each query block to all cells of its column.
    """
    spark = blocks.sparkSession
    b = blocks.agg(F.count("*"), F.sum(F.octet_length("matrix"))).first()
    q = queries.agg(F.count("*"), F.sum(F.octet_length("q_matrix"))).first()
    tasks = max(spark.sparkContext.defaultParallelism, b[0] * q[0] // PER_TASK)
    if (q[1] or 0) <= BROADCAST_BYTES:
        return blocks.repartition(max(1, min(tasks, b[0]))).join(F.broadcast(queries), "width")
    rows = int(min(b[0], max(1, round(math.sqrt(tasks * b[1] / q[1])))))
    columns = int(min(q[0], max(1, math.ceil(tasks / rows))))
    place = lambda names, n: F.pmod(F.xxhash64(*names), F.lit(n)).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = blocks.withColumn("_row", place(["band", "block"], rows)).withColumn("_column", spread(columns))
    right = queries.withColumn("_column", place(["q_band", "q_block"], columns)).withColumn("_row", spread(rows))
    cell = ["width", "_row", "_column"]
    n = rows * columns
    return left.repartition(n, *cell).hint("shuffle_hash").join(right.repartition(n, *cell), cell).drop("_row", "_column")


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id."""
    if len(scores) > 4 * k:
        cut = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= cut)
        return some[np.lexsort((ids[some], -scores[some]))[:k]]
    return np.lexsort((ids, -scores))[:k]


def _local_lists(ids: np.ndarray, m: np.ndarray, q_ids: np.ndarray, q: np.ndarray, edges: list[int], k: int) -> list[tuple]:
    """Phase one: for each query the best k totals among the entries of its slices' top lists."""
    found = []
    for at in range(0, len(q), 128):
        part = [q[at : at + 128, a:b] @ m[:, a:b].T for a, b in zip(edges, edges[1:], strict=False)]
        for j in range(len(part[0])):
            lists = [p[j] for p in part]
            near = np.unique(np.concatenate([np.argpartition(x, len(x) - k - 1)[len(x) - k - 1 :] if len(x) > k + 1 else np.arange(len(x)) for x in lists]))
            near = near[ids[near] != q_ids[at + j]]
            total = sum(x[near] for x in lists)
            best = _best(ids[near], total, k)
            found.append((np.full(len(best), q_ids[at + j]), ids[near[best]], total[best]))
    return found


def _entries(ids: np.ndarray, m: np.ndarray, q_ids: np.ndarray, q: np.ndarray, edges: list[int], cut: np.ndarray, k: int) -> list[tuple]:
    """Phases two and three: for each query the best k entries whose total reaches its cutoff."""
    slices = list(zip(edges, edges[1:], strict=False))
    # What slices s and later can add at most: the product of the norms of what is left of both vectors.
    rest = lambda x: [np.sqrt((x[:, a:] ** 2).sum(1)) * (1 + 1e-9) for a, _ in slices] + [np.zeros(len(x))]
    m_rest, q_rest = rest(m), rest(q)
    open_ = np.flatnonzero(q_rest[0] * m_rest[0].max(initial=0.0) >= cut)
    found = []
    for at in range(0, len(open_), 128):
        rows = open_[at : at + 128]
        total, largest, i, j = None, None, None, None  # i, j: the entries still open once they are few
        for s, (a, b) in enumerate(slices):
            if i is None:
                part = q[rows, a:b] @ m[:, a:b].T
                total, largest = (part, part.copy()) if total is None else (total + part, np.maximum(largest, part))
                alive = total + q_rest[s + 1][rows][:, None] * m_rest[s + 1] >= cut[rows][:, None]
                if s + 1 < len(slices) and alive.mean() < 0.2:
                    i, j = np.nonzero(alive)
                    total, largest = total[i, j], largest[i, j]
            else:
                part = np.empty(len(i))
                for at_ in range(0, len(i), 1 << 16):
                    x = slice(at_, at_ + (1 << 16))
                    part[x] = (q[rows[i[x]], a:b] * m[j[x], a:b]).sum(1)
                total, largest = total + part, np.maximum(largest, part)
                alive = total + q_rest[s + 1][rows[i]] * m_rest[s + 1][j] >= cut[rows[i]]
                i, j, total, largest = i[alive], j[alive], total[alive], largest[alive]
        if i is None:
            i, j = np.nonzero(alive)
            total, largest = total[i, j], largest[i, j]
        # The uniform threshold is implied by the total; entries under it can't be right.
        keep = (largest >= cut[rows[i]] / len(slices)) & (total >= cut[rows[i]]) & (ids[j] != q_ids[rows[i]])
        i, j, total = i[keep], j[keep], total[keep]
        bounds = np.searchsorted(i, np.arange(len(rows) + 1))
        for r, (x, y) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
            if y > x:
                best = _best(ids[j[x:y]], total[x:y], k)
                found.append((np.full(len(best), q_ids[rows[r]]), ids[j[x:y]][best], total[x:y][best]))
    return found


def _meet(pairs: DataFrame, k: int, cutoffs: bool) -> DataFrame:
    """query_id, vec_id, score: local lists (phase one) or all that reaches the cutoffs, k a block at most."""

    def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        out = []
        for n in range(batch.num_rows):
            r = batch.slice(n, 1).to_pylist()[0]
            ids, q_ids = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["q_ids"], np.int64)
            m, q = np.frombuffer(r["matrix"]).reshape(-1, r["width"]), np.frombuffer(r["q_matrix"]).reshape(-1, r["width"])
            edges = sorted({r["width"] * s // SLICES for s in range(SLICES + 1)})
            found = _entries(ids, m, q_ids, q, edges, np.frombuffer(r["cutoff"]), k) if cutoffs else _local_lists(ids, m, q_ids, q, edges, k)
            cols = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
            out.append(pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64())], names=["query_id", "vec_id", "score"]))
        return out

    return map_batches(pairs, each, "query_id long, vec_id long, score double")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score. vectors, queries: vec_id, v."""
    vectors = materialise(vectors.select("vec_id", "v"), "vectors")
    queries = materialise(queries.select("vec_id", "v").dropDuplicates(["vec_id"]), "queries")
    blocks = materialise(_blocks(vectors, BLOCK), "blocks")
    asked = _blocks(queries, QUERY_BLOCK).withColumnRenamed("band", "q_band").withColumnRenamed("block", "q_block")
    asked = materialise(asked.select("width", "q_band", "q_block", F.col("ids").alias("q_ids"), F.col("matrix").alias("q_matrix")), "asked")
    # The longest vectors are the likeliest to score high; any block would do.
    order = W.partitionBy("width").orderBy(F.desc("band"), F.xxhash64("block"), "block")
    pilots = blocks.select("width", "band", "block").withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= PILOTS).drop("_r")
    # At most PILOTS rows a width.
    pilots = blocks.join(F.broadcast(pilots), ["width", "band", "block"])
    first = materialise(_meet(_pairs(pilots, asked), k, False), "local")
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    cut = first.withColumn("_r", place).where(F.col("_r") <= k).groupBy("query_id").agg(F.min("score").alias("cutoff"), F.count("*").alias("_n"))
    # Fewer than k entries so far: every entry counts.
    cut = cut.select("query_id", F.when(F.col("_n") < k, float("-inf")).otherwise(F.col("cutoff")).alias("cutoff"))
    names = ["width", "q_band", "q_block"]

    def ids_of(batch: pa.RecordBatch) -> list[pa.RecordBatch]:
        out = []
        for r in batch.to_pylist():
            ids = np.frombuffer(r["q_ids"], np.int64)
            own = [pa.array([r[c]] * len(ids), pa.int32()) for c in names]
            out.append(pa.RecordBatch.from_arrays([*own, pa.array(ids), pa.array(np.arange(len(ids)), pa.int32())], names=[*names, "query_id", "at"]))
        return out

    def back(group: pa.Table) -> pa.Table:
        order = np.argsort(np.asarray(group.column("at")))
        return pa.table({**{c: group.column(c)[:1] for c in names}, "cutoff": pa.array([np.asarray(group.column("cutoff"))[order].tobytes()], pa.binary())})

    listed = map_batches(asked.select(*names, "q_ids"), ids_of, "width int, q_band int, q_block int, query_id long, at int")
    cutoffs = listed.join(cut, "query_id", "left").fillna(float("-inf"), ["cutoff"]).groupBy(*names).applyInArrow(back, "width int, q_band int, q_block int, cutoff binary")
    asked = materialise(asked.join(materialise(cutoffs, "cutoffs"), names), "cut")
    second = _meet(_pairs(blocks, asked), k, True)
    return second.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", F.col("score").cast("long").alias("score"))


def op7_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = materialise(integer_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet")), "integer")
    return top_k(vectors, vectors.where("vec_id % 50 = 0"), 5)


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5
"""
