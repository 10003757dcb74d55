"""Best-fit packing by exact complements.

Documents become token pieces of at most ``LENGTH`` ids. Only the histogram of piece lengths (LENGTH numbers,
whatever the input) comes to the driver. There, from the longest pieces down, single, pair and triple sums of the
lengths still available are looked up for combinations that fill a gap exactly, and each is consumed as often as
its counts allow; what is left goes best-fit. The plan has a few entries per length. Pieces take their places by
their rank within a length: ranks come from counts per (length, salt), and a length has as many salts as its count
asks for.

Defined results: null and empty texts are one piece of the closing id alone; very long texts are cut into pieces;
pieces of equal length are interchangeable and take their places in the order of a hash, doc_id and piece; repeated
rows are packed each; a null doc_id stays null; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from doselab.llm import textnp as tx
from doselab.llm.common import map_batches, materialise, small
from doselab.llm.tokens import Encoder

#: Longest sequence; pieces of one length that a task ranks; the id that closes a document.
LENGTH, PER_SALT, CLOSING = 2048, 200_000, 0


def pieces(docs: DataFrame, encoder: Encoder, length: int = LENGTH) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32. Only texts of more than length ids are cut; their first piece is the short one."""

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        doc, piece, start, size, crc = [], [], [], [], []
        ids_of = batch.column("doc_id").to_pylist()
        for at, buf, offsets in tx.chunks(batch.column("text")):
            for k, ids in enumerate(encoder.encode(buf, offsets)):
                data = np.append(ids, np.uint32(CLOSING)).astype("<u4")
                cuts = [0, *range(len(data) % length or length, len(data) + 1, length)] if len(data) > length else [0, len(data)]
                for p in range(len(cuts) - 1):
                    doc.append(ids_of[at + k])
                    piece.append(p)
                    start.append(cuts[p])
                    size.append(cuts[p + 1] - cuts[p])
                    crc.append(zlib.crc32(data[cuts[p] : cuts[p + 1]].tobytes()))
        cols = [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, size, crc))]
        return pa.RecordBatch.from_arrays(cols, names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return map_batches(docs.selectExpr("cast(doc_id as long) doc_id", "text"), each, "doc_id long, piece int, start long, length long, ids_crc32 long")


def _pair(counts: np.ndarray, gap: int) -> tuple[int, int, int]:
    """Of the lengths a >= b with a + b = gap those available most often, and how often; (0, 0, 0) if none."""
    if gap < 2:
        return 0, 0, 0
    a = np.arange((gap + 1) // 2, gap)
    often = np.minimum(counts[a], counts[gap - a])
    if gap % 2 == 0:
        often[0] = counts[gap // 2] // 2
    k = int(often.argmax()) if len(often) else 0
    return (int(a[k]), gap - int(a[k]), int(often[k])) if len(often) and often[k] else (0, 0, 0)


def plan_packing(histogram: dict[int, int], length: int = LENGTH) -> list[tuple[int, list[int]]]:
    """(how many sequences, the lengths in each) for the piece counts by length."""
    counts = np.zeros(length + 1, np.int64)
    for size, n in histogram.items():
        counts[size] = n
    done: list[tuple[int, list[int]]] = [(int(counts[length]), [length])] if counts[length] else []
    counts[length] = 0
    left: list[int] = []

    def consume(lengths: list[int]) -> None:
        values, need = np.unique(lengths, return_counts=True)
        k = int((counts[values] // need).min())
        counts[values] -= k * need
        done.append((k, lengths))

    def fits(lengths: list[int]) -> bool:
        values, need = np.unique(lengths, return_counts=True)
        return bool((counts[values] >= need).all())

    pair_sums = None
    for size in range(length - 1, 0, -1):
        gap = length - size
        while counts[size]:
            if fits([size, gap]):
                consume([size, gap])
                continue
            counts[size] -= 1  # the piece that is being completed can't complete itself
            a, b, n = _pair(counts, gap)
            found = [a, b] if n else None
            if not found and gap > 2:
                for fresh in (False, True):
                    if pair_sums is None or fresh:
                        here = (counts > 0).astype(float)
                        pair_sums = np.rint(np.fft.irfft(np.fft.rfft(here, 4 * length) ** 2, 4 * length))[: length + 1] > 0
                    third = np.arange(1, gap - 1)
                    third = third[(counts[third] > 0) & pair_sums[gap - third]]
                    # Sums that may be out of date are tried a few times only; after that all are tried against fresh ones.
                    for c in third[np.argsort(-counts[third], kind="stable")][: None if fresh else 64].tolist():
                        counts[c] -= 1
                        a, b, n = _pair(counts, gap - c)
                        counts[c] += 1
                        if n:
                            found = [a, b, c]
                            break
                    if found or not len(third):
                        break
            counts[size] += 1
            if not found:
                break
            consume([size, *found])
        if counts[size]:
            left.append(size)
    # Best fit, longest first, over classes of sequences that look alike.
    open_: dict[int, list[tuple[int, list[int]]]] = {}
    for size in (s for s in left if counts[s]):
        n = int(counts[size])
        while n:
            gap = min((g for g, groups in open_.items() if g >= size and groups), default=0)
            if gap:
                k, lengths = open_[gap].pop()
                used = min(k, n)
                if k > used:
                    open_[gap].append((k - used, lengths))
                open_.setdefault(gap - size, []).append((used, [*lengths, size]))
                n -= used
            else:
                each = length // size
                whole, rest = divmod(n, each)
                if whole:
                    open_.setdefault(length - each * size, []).append((whole, [size] * each))
                if rest:
                    open_.setdefault(length - rest * size, []).append((1, [size] * rest))
                n = 0
    return done + [x for groups in open_.values() for x in groups]


def _places(plan: list[tuple[int, list[int]]]) -> np.ndarray:
    """For each (length, slot of a plan entry): length, first rank, first sequence, offset; sorted by length and rank."""
    rows, taken, sequence = [], {}, 0
    for k, lengths in plan:
        at = 0
        for size in lengths:
            rows.append((size, taken.get(size, 0), sequence, at))
            taken[size] = taken.get(size, 0) + k
            at += size
        sequence += k
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def pack(table: DataFrame, length: int = LENGTH) -> DataFrame:
    """table (with a column length) with sequence_id and offset. It is read three times, so it should be written."""
    histogram = {r[0]: r[1] for r in table.groupBy("length").agg(F.count("*")).collect()}
    plan = plan_packing(histogram, length)
    places = _places(plan)
    salts = F.element_at(F.array(*[F.lit(-(-histogram.get(k, 1) // PER_SALT)) for k in range(length + 1)]), (F.col("length") + 1).cast("int"))
    salted = table.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), salts).cast("int"))
    groups = materialise(salted.groupBy("length", "_salt").agg(F.count("*").alias("_n")), "lengths")
    base = groups.withColumn("_base", F.sum("_n").over(W.partitionBy("length").orderBy("_salt")) - F.col("_n")).drop("_n")
    base = F.broadcast(base) if small(groups) else base
    order = W.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("_rank", F.row_number().over(order)).join(base, ["length", "_salt"]).withColumn("_rank", F.col("_rank") - 1 + F.col("_base"))
    names = [c for c in table.columns]
    fields = ", ".join(f"`{c}` {t}" for c, t in table.dtypes)
    span = 1 << 44
    keys = places[:, 0] * span + places[:, 1]

    def place(batch: pa.RecordBatch) -> pa.RecordBatch:
        size, rank = np.asarray(batch.column("length")), np.asarray(batch.column("_rank"))
        at = np.searchsorted(keys, size * span + rank, "right") - 1
        out = [pa.array(places[at, 2] + rank - places[at, 1]), pa.array(places[at, 3])]
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *out], names=[*names, "sequence_id", "offset"])

    return map_batches(ranked.select(*names, "_rank"), place, f"{fields}, sequence_id long, offset long")


def best_fit_packing(docs: DataFrame, encoder: Encoder, length: int = LENGTH) -> DataFrame:
    """docs: doc_id, text. Per piece its ids' checksum, its sequence and its place there."""
    return pack(materialise(pieces(docs, encoder, length), "pieces"), length)


def public_encoder() -> Encoder:
    import public_tokenizers as public

    return Encoder(public.path("byte_bpe_50k.json"), public.path("byte_bpe_50k.tiktoken"), public.PATTERN)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_encoder())
