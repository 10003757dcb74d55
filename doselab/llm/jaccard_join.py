"""N-gram Jaccard join in the metric space of Jaccard distance: pivots, Voronoi regions, windows, recursion.

A document is the set of its distinct word shingles (64-bit hashes); texts of equal sets are one class and only a
class's first document goes on. Two texts link when their distance is at most 1 - J (J = 0.8).

Unrelated texts are all at distance 1, so no pivot document tells them apart. The first pivots are therefore
single shingles, ordered by hash: a text's home region is that of its first shingle (its nearest pivot, ties in
hash order). By the triangle inequality a text within the window differs in at most n - ceil(J n) of its n
shingles, so one of its first n - ceil(J n) + 1 pivots is shared with every partner: to these boundary regions
it is replicated. Pivots shared by more than ``CROWD`` texts come last in the order (a window then moves on to the
next pivots), which dissolves regions around passages that many texts share.

Within regions pivots are documents. Every text is measured against its region's pivot exactly; texts within the
window link to it and need no comparison among themselves. Regions that still hold several components recurse with
further pivots; then pairs of different components that the triangle inequality on the distances to the pivots leaves
open are measured: pair by pair in regions of at most ``CROWD`` texts, in blocks in larger ones. There the texts outside
the region's main component are dealt by their distance to the pivot (rings) into blocks that fit in memory, every text
travels to the blocks within its window, and one lookup counts what it has in common with a whole block. No link between
different texts is lost; nothing is capped.

All texts are tokenised once: the first shingles of their sets in hash order (about three tenths, as pivots and as
sketches) are written with a row number; whole sets are made again for the few texts whose sketches leave a link open.
Shingles that a sample shows to be crowded are known as such and need not meet; other keys with many rows are split over tasks.

Defined results: texts without words or null have no shingles and link with nothing; texts of fewer words than a
shingle are one shingle; texts of any length are whole sets; rows are texts of their own: those that share a doc_id link
each by its own text, repeated rows are one class; rows without doc_id take part by their text and name no component
(theirs is null if no row in it has a doc_id); an empty table gives an empty result; extra columns of any name are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from doselab.llm import textnp as tx
from doselab.llm.common import bounded_batches, discard, freed, map_batches, materialise, release, small, split_join, split_keys, whole_rows, without

#: Words in a shingle; similarity in hundredths; texts at a pivot from which on it comes last; texts per salt.
WORDS, PERCENT, CROWD, PER_SALT = 5, 80, 64, 64
#: Further pivots a round and rounds at most; texts and shingles in a block of a large region; texts that meet it in a task.
PIVOTS, ROUNDS, BLOCK, BLOCK_SHINGLES, PER_TASK = 8, 4, 2048, 800_000, 4_000
#: Largest table of crowded pivots that executors get whole (8 bytes each); a larger one is joined.
CROWDED_ROWS = 500_000
#: Rows of two numbers from which on a key's are dealt over tasks.
LEAST = 100_000
#: Texts that crowded pivots are looked for in beforehand; parts that these are dealt in; rows from which lists of trips are shuffled.
SAMPLE, PARTS, TRIPS = 20_000, 1024, 200_000
#: Texts of a block from which a shingle is counted in a table of bytes; bytes of that table at most.
DENSE, DENSE_BYTES = 16, 32 << 20
#: Blocks on a side that a component's texts are dealt in when its links are counted, while blocks have so many texts.
SIDES, LEAST_BLOCK = 16, 128
#: Bits that mark a row which others are to meet, and bitmaps of marks (4 KB each) at most.
MARK_BITS, MARK_BITMAPS = 8, 8192
#: Bytes of sets that are looked at together.
PART_BYTES = 512 << 10
_TWO = np.uint64(0xD6E8FEB86659FD93)


def shingle_sets(buf: np.ndarray, offsets: np.ndarray, n: int = WORDS) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each row."""
    starts, ends, first = tx.runs(buf, offsets, tx.NOT_SPACE)
    words = tx.hash_runs(buf, starts, ends, tx.FOLDED)
    grams = tx.ngrams(words, n)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= n:
            part = np.sort(grams[a : b - n + 1])
            yield part[np.append(True, part[1:] != part[:-1])]
        else:
            yield tx.ngrams(words[a:b], b - a) if b > a else np.zeros(0, tx.U64)


def prefix(n: Column | np.ndarray) -> Column | np.ndarray:
    """How many first pivots a text of n shingles is replicated to: n - ceil(J n) + 1."""
    if not isinstance(n, Column):
        return n - (PERCENT * n + 99) // 100 + 1
    return n - F.floor((F.lit(PERCENT) * n + 99) / 100) + 1


def _fit(a: Column, b: Column) -> Column:
    """Whether sets of these sizes can link at all."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * PERCENT


def reserve(n: np.ndarray) -> np.ndarray:
    """How many pivots a text of n shingles brings: its first ones and half as many in reserve."""
    return np.minimum(n, prefix(n) + prefix(n) // 2 + 4)


def sketched(n: int | np.ndarray) -> int | np.ndarray:
    """How many shingles a sketch of a set of n holds: the first seventh in hash order and a few more."""
    return n // 7 + 8


def _binary(parts: list[np.ndarray]) -> pa.Array:
    edges = np.concatenate([[0], np.cumsum([len(x) for x in parts])]) * 8
    return pa.Array.from_buffers(pa.binary(), len(parts), [None, pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(np.concatenate(parts))])


class Texts:
    """The texts of docs (doc_id, text): table (row, a number of its own, doc_id, text_hash, n, fp1, fp2, data) and whole()."""

    def __init__(self, docs: DataFrame):
        self.docs = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")

        def each(batch: pa.RecordBatch) -> list[pa.RecordBatch]:
            out = []
            for at, buf, offsets in tx.chunks(batch.column("text")):
                sets = list(shingle_sets(buf, offsets))
                size = np.array([len(s) for s in sets], np.int64)
                every, edges = np.concatenate(sets), np.concatenate([[0], np.cumsum(size)])
                sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(tx.mix(every ^ _TWO), dtype=np.uint64)])
                folds = np.concatenate([np.zeros(1, np.uint64), np.bitwise_xor.accumulate(tx.mix(every + _TWO))])
                fp = [(sums[edges[1:]] - sums[edges[:-1]]).view(np.int64), (folds[edges[1:]] ^ folds[edges[:-1]]).view(np.int64)]
                first = np.minimum(size, np.maximum(reserve(size), sketched(size)))
                data = _binary([s[:k] for s, k in zip(sets, first.tolist(), strict=True)])
                cols = [batch.column("doc_id").slice(at, len(sets)), batch.column("text_hash").slice(at, len(sets)), pa.array(size), *map(pa.array, fp), data]
                out.append(pa.RecordBatch.from_arrays(cols, names=["doc_id", "text_hash", "n", "fp1", "fp2", "data"]))
            return out

        found = map_batches(self.docs, each, "doc_id long, text_hash long, n long, fp1 long, fp2 long, data binary")
        self.table = materialise(found.withColumn("row", F.monotonically_increasing_id()), "heads")
        self.spark = docs.sparkSession
        # Whole sets are found again by doc_id and text; where rows agree in both, one of them is kept for that.
        if _some(self.table.groupBy("doc_id", "text_hash").agg(F.count("*").alias("c")).where("c > 1")):
            self.docs = materialise(self.docs.dropDuplicates(["doc_id", "text_hash"]), "kinds")

    def heads(self, side: DataFrame, few: bool) -> DataFrame:
        """rep, n, data (the first shingles) of the rows in side (column rep), with side's other columns; few: to be broadcast."""
        rows = self.table.select(F.col("row").alias("rep"), "n", "data")
        return rows.join(F.broadcast(side), "rep") if few else _marked(rows, F.xxhash64("rep"), side, F.xxhash64("rep")).join(side, "rep")

    def whole(self, side: DataFrame, few: bool) -> DataFrame:
        """heads(), with whole sets as data and without n. side: rep and at most a column trips."""
        kinds = self.table.select(F.col("row").alias("rep"), F.col("doc_id").alias("_d"), F.col("text_hash").alias("_t")).join(F.broadcast(side) if few else side, "rep")
        same = F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("text_hash") == F.col("_t"))
        names = side.columns
        docs = self.docs
        if not few:  # of the texts only those that are asked for are shuffled
            kinds = materialise(kinds, "asked")
            docs = _marked(docs, F.col("text_hash"), kinds, F.col("_t"))
        rows = docs.join(F.broadcast(kinds) if few else kinds, same).select(*names, "text")

        def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for at, buf, offsets in tx.chunks(batch.column("text")):
                sets = list(shingle_sets(buf, offsets))
                own = [batch.column(c).slice(at, len(sets)) for c in names]
                yield pa.RecordBatch.from_arrays([*own, pa.array([len(s) for s in sets], pa.int64()), _binary(sets)], names=[*names, "n", "data"])

        fields = ", ".join(f"{c} {t}" for c, t in side.dtypes)
        return map_batches(rows, each, f"{fields}, n long, data binary")


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in parts of about PART_BYTES of data."""
    edges = np.frombuffer(batch.column("data").buffers()[1], np.int32)[batch.column("data").offset :][: batch.num_rows + 1].astype(np.int64) if batch.num_rows else np.zeros(1, np.int64)
    at = 0
    while at < batch.num_rows:
        end = min(batch.num_rows, max(at + 1, int(np.searchsorted(edges, edges[at] + PART_BYTES, "right")) - 1))
        yield batch.slice(at, end - at)
        at = end


def _read(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All sets of a column, one after the other, and the place at which each begins (n + 1)."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(column):
        return np.zeros(0, np.uint64), np.zeros(1, np.int64)
    edges = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[edges[0] : edges[-1]] if edges[-1] > edges[0] else np.zeros(0, np.uint8)
    return data.view(np.uint64), (edges - edges[0]) // 8


def _marked(rows: DataFrame, key: Column, side: DataFrame, wanted: Column) -> DataFrame:
    """rows without most of those whose key (a hash) is no wanted key of side, before they are shuffled to meet it; none of side's goes.

    Marks are a table of MARK_BITS bits a row of side, in bitmaps of 4 KB, of which up to MARK_BITMAPS are broadcast.
    """
    side = side.select(F.abs(wanted % (1 << 62)).alias("_h"))
    bits = min(MARK_BITMAPS << 15, max(1, side.count()) * MARK_BITS)
    place = F.col("_h") % bits
    marks = side.groupBy(F.bitmap_bucket_number(place).alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("_bits"))
    own = F.abs(key % (1 << 62)) % bits
    met = rows.withColumn("_place", own).join(F.broadcast(marks), F.bitmap_bucket_number("_place") == F.col("_bucket"))
    bit = F.bitmap_bit_position("_place")
    byte = F.conv(F.hex(F.substring("_bits", F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return met.where(F.getbit(byte, (bit % 8).cast("int")) == 1).select(*rows.columns)


def _hinted(df: DataFrame, limit: int | None = None) -> DataFrame:
    """df, broadcast if it is checked to be small."""
    return F.broadcast(df) if (small(df, limit) if limit else small(df)) else df


def shingles(rows: DataFrame, whole: bool, known: np.ndarray | None = None) -> DataFrame:
    """s, rep, n, k (place in hash order), part of rows (rep, n, data): whole sets or what they bring.

    part is 0, or tells the rows of a pivot in known apart.
    """
    share = rows.sparkSession.sparkContext.broadcast(known if known is not None else np.zeros(0, np.uint64))

    def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for some in _parts(batch):
            every, edges = _read(some.column("data"))
            owner, size = np.asarray(some.column("rep")), np.asarray(some.column("n"))
            held = size if whole else reserve(size)
            place = np.arange(held.sum()) - np.repeat(np.cumsum(held) - held, held)
            s = every[np.repeat(edges[:-1], held) + place]
            part = np.where(np.isin(s, share.value), np.repeat(owner % PARTS + 1, held), 0) if len(share.value) else np.zeros(len(s), np.int64)
            cols = [s.view(np.int64), np.repeat(owner, held), np.repeat(size, held).astype(np.int32), place.astype(np.int32), part.astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["s", "rep", "n", "k", "part"])

    return map_batches(rows, each, "s long, rep long, n int, k int, part int")


def crowded_sample(texts: Texts, ids: DataFrame) -> np.ndarray:
    """Pivots that more than CROWD of SAMPLE texts bring, so surely crowded. SAMPLE bounds what comes to the driver."""
    some = ids.orderBy(F.xxhash64("rep")).limit(SAMPLE)
    found = shingles(texts.heads(some, True), False).groupBy("s").agg(F.count("*").alias("c")).where(F.col("c") > CROWD).select("s").toPandas()
    return np.sort(found["s"].to_numpy().astype(np.int64).view(np.uint64))


def reordered(texts: Texts, ids: DataFrame, hot: DataFrame) -> DataFrame:
    """s, rep, n: the first pivots of the rows in ids (column rep) over their whole sets, those in hot (s) last."""
    few = small(ids)
    if not small(hot, CROWDED_ROWS):
        entries = shingles(texts.whole(ids, few), True).drop("part").join(hot.withColumn("hot", F.lit(1)), "s", "left")
        # By place k, as everywhere: s is a signed long here, and its order is another one than that of the unsigned hashes.
        order = F.row_number().over(W.partitionBy("rep").orderBy(F.col("hot").asc_nulls_first(), "k"))
        return entries.withColumn("_r", order).where(F.col("_r") <= prefix(F.col("n"))).select("s", "rep", "n")
    last = texts.spark.sparkContext.broadcast(np.sort(hot.toPandas()["s"].to_numpy().astype(np.int64).view(np.uint64)))

    def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for some in _parts(batch):
            every, edges = _read(some.column("data"))
            size = np.diff(edges)
            owner = np.repeat(np.arange(len(size)), size)
            behind = np.isin(every, last.value)
            # A stable sort by (text, crowded) keeps hash order inside both parts.
            order = np.argsort(owner * 2 + behind, kind="stable")
            place = np.arange(len(every)) - np.repeat(edges[:-1], size)
            keep = place < np.repeat(prefix(size), size)
            cols = [every[order][keep].view(np.int64), np.asarray(some.column("rep"))[owner[keep]], size[owner[keep]].astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["s", "rep", "n"])

    return map_batches(texts.whole(ids, few), each, "s long, rep long, n int")


def shared(entries: DataFrame) -> DataFrame:
    """entries whose pivot another text has too, with hot: whether more than CROWD have it.

    One shuffle by pivot; a sorted stream tells group sizes with at most CROWD rows in hand, however large a group is.
    Pivots known to be crowded (part above 0) are dealt over tasks.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["s", "rep", "n", "k", "part"]
        held, crowded = None, None  # rows of the group that goes on; the pivot whose crowd is known already
        for batch in batches:
            rows = [batch.column(c).to_numpy() for c in names]
            if held is not None:
                rows = [np.concatenate([h, r]) for h, r in zip(held, rows, strict=True)]
            pivots = rows[0]
            starts = np.flatnonzero(np.append(True, pivots[1:] != pivots[:-1])) if len(pivots) else np.zeros(0, np.int64)
            size = np.diff(np.append(starts, len(pivots)))
            hot = (size > CROWD) | (rows[4][starts] > 0) | (pivots[starts] == crowded if crowded is not None else False)
            keep = (size > 1) | hot
            held = None
            if len(size) and not hot[-1]:
                held, keep[-1] = [r[starts[-1] :] for r in rows], False
            crowded = pivots[-1] if len(size) and hot[-1] else None
            at = np.repeat(keep, size)
            yield pa.RecordBatch.from_arrays([*(pa.array(r[at]) for r in rows[:4]), pa.array(np.repeat(hot, size)[at])], names=[*names[:4], "hot"])
        if held is not None and len(held[0]) > 1:
            yield pa.RecordBatch.from_arrays([*(pa.array(r) for r in held[:4]), pa.array(np.zeros(len(held[0]), bool))], names=[*names[:4], "hot"])

    bounded_batches(entries.sparkSession, rows=50_000)
    return entries.repartition("s", "part").sortWithinPartitions("s").mapInArrow(freed(each), "s long, rep long, n int, k int, hot boolean")


def regions(texts: Texts, reps: DataFrame) -> DataFrame:
    """s, rep, n: each class's first document in its regions, those that hold it alone left out."""
    spark = texts.spark
    live = materialise(shared(shingles(texts.heads(reps, small(reps, 1_000_000)), False, crowded_sample(texts, reps))), "live")
    release(spark)
    crowd = live.where("hot").select("s").distinct()
    before = F.sum(F.col("hot").cast("int")).over(W.partitionBy("rep").orderBy("k").rowsBetween(W.unboundedPreceding, -1))
    every = F.sum(F.col("hot").cast("int")).over(W.partitionBy("rep"))
    first = prefix(F.col("n"))
    held = F.least(F.col("n"), first + F.floor(first / 2) + 4)
    ranked = live.withColumn("_b", F.coalesce(before, F.lit(0))).withColumn("_h", every).withColumn("_held", held)
    place = F.when(F.col("hot"), F.col("_held") - F.col("_h") + F.col("_b")).otherwise(F.col("k") - F.col("_b"))
    short = (F.col("_held") - F.col("_h") < first) & (F.col("_held") < F.col("n"))
    ranked = materialise(ranked.select("s", "rep", "n", place.alias("place"), short.alias("short")), "ranked")
    settled = ranked.where(~F.col("short") & (F.col("place") < first)).select("s", "rep", "n")
    ids = materialise(ranked.where("short").select("rep").distinct(), "short")
    if not ids.limit(1).count():
        return settled
    # The reserve does not reach: these texts are ordered over their whole sets, crowded pivots last.
    hot = materialise(crowd, "crowded")
    whole = materialise(reordered(texts, ids, hot), "whole")
    release(spark)
    # Their new pivots may meet texts that were alone there.
    fresh = materialise(whole.select("s").distinct(), "fresh")
    others = materialise(reps.join(_hinted(ids), "rep", "left_anti"), "others")
    alone = shingles(texts.heads(others, small(others, 1_000_000)), False).join(_hinted(fresh, 1_000_000), "s", "left_semi").select("s", "rep", "n")
    return settled.unionByName(whole).unionByName(alone).distinct()


def sketch(s: np.ndarray, n: int) -> np.ndarray:
    """The part of a set, or of its first shingles, that its sketch is; n: the set's size."""
    return s[: sketched(n)]


def may_link(a: np.ndarray, b: np.ndarray, na: int, nb: int) -> bool:
    """Whether sketches a and b leave a link open.

    Up to the hash to which both sketches reach, they show what the sets differ in; linked sets differ in at most
    (na + nb) (1 - J) / (1 + J) shingles altogether.
    """
    ends = [int(x[-1]) for x, n in ((a, na), (b, nb)) if len(x) < n]
    if ends:
        top = np.uint64(min(ends))
        a, b = a[: np.searchsorted(a, top, "right")], b[: np.searchsorted(b, top, "right")]
    return (len(a) + len(b) - 2 * _common(a, b)) * (100 + PERCENT) <= (na + nb) * (100 - PERCENT)


def _common(a: np.ndarray, b: np.ndarray) -> int:
    if not len(a) or not len(b):
        return 0
    return int((a[np.minimum(np.searchsorted(a, b), len(a) - 1)] == b).sum())


def _trips(rows: DataFrame) -> tuple[DataFrame, bool]:
    """rep and its list of trips t, written, and whether there are few trips in all."""
    trips = materialise(rows.groupBy("rep").agg(F.collect_list("t").alias("trips")), "trips")
    total = trips.agg(F.sum(F.size("trips"))).first()[0] or 0
    return trips, total <= TRIPS


def _travel(rows: DataFrame, fields: dict[str, pa.DataType], schema: str, part: Callable[[np.ndarray, int], np.ndarray] = lambda s, n: s) -> DataFrame:
    """A row for every trip: its fields, x (the row), n and data (the set, or a part of it). rows: rep, n, data, trips."""

    def sending(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every, edges = _read(batch.column("data"))
            cols, held, at = {c: [] for c in fields}, ([], [], []), 0
            for k, (x, n, trip) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("rep", "n", "trips")), strict=True)):
                data = part(every[edges[k] : edges[k + 1]], n).tobytes()
                for t in trip:
                    for c in fields:
                        cols[c].append(t[c])
                    for h, v in zip(held, (x, n, data), strict=True):
                        h.append(v)
                    at += len(data) + 64
                    if at > 4 << 20:  # what leaves at once stays small, however many trips a text has
                        yield _trip_batch(cols, held, fields)
                        cols, held, at = {c: [] for c in fields}, ([], [], []), 0
            if held[0]:
                yield _trip_batch(cols, held, fields)

    bounded_batches(rows.sparkSession)
    return rows.select("rep", "n", "data", "trips").mapInArrow(freed(sending), f"{schema}, x long, n long, data binary")


def _trip_batch(cols: dict[str, list], held: tuple[list, list, list], fields: dict[str, pa.DataType]) -> pa.RecordBatch:
    own = [pa.array(held[0], pa.int64()), pa.array(held[1], pa.int64()), pa.array(held[2], pa.binary())]
    return pa.RecordBatch.from_arrays([*(pa.array(cols[c], t) for c, t in fields.items()), *own], names=[*fields, "x", "n", "data"])


def _meet(texts: Texts, pairs: DataFrame, whole: bool) -> DataFrame:
    """x, p, common, joint of the pairs (x, p); of sketches, only of those that leave a link open (sizes 0 then).

    Each set travels to its pivot once a pair; the pairs of a hot pivot are salted.
    """
    load = pairs.groupBy("p").agg(F.ceil(F.count("*") / PER_SALT).cast("int").alias("salts"))
    load = materialise(load, "load")
    trip = lambda salt, role: F.struct("p", salt.cast("int").alias("salt"), F.lit(role).alias("role")).alias("t")
    ask = split_join(pairs, load, ["p"]).select(F.col("x").alias("rep"), trip(F.pmod(F.xxhash64("x"), "salts"), 1))
    give = load.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).select(F.col("p").alias("rep"), trip(F.col("salt"), 0))
    trips, few = _trips(ask.unionByName(give))
    fields = {"p": pa.int64(), "salt": pa.int32(), "role": pa.int32()}
    sent = _travel(texts.whole(trips, few), fields, "p long, salt int, role int") if whole else _travel(texts.heads(trips, few), fields, "p long, salt int, role int", sketch)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, pivot, size = None, None, 0
        for batch in batches:
            out = ([], [], [], [])
            for p, salt, role, x, n, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = np.frombuffer(data, np.uint64)
                if role == 0:
                    key, pivot, size = (p, salt), own, n
                    continue
                if key != (p, salt) or not whole and not may_link(own, pivot, n, size):
                    continue
                common = _common(pivot, own) if whole else 0
                for c, v in zip(out, (x, p, common, n + size - common if whole else 0), strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["x", "p", "common", "joint"])

    ordered = sent.repartition("p", "salt").sortWithinPartitions("p", "salt", "role")
    out = materialise(ordered.mapInArrow(freed(compare), "x long, p long, common long, joint long"), "measured")
    discard(texts.spark, trips.scratch_path)
    return out


def measure(texts: Texts, pairs: DataFrame) -> DataFrame:
    """The pairs (x, p) that sketches don't rule out, with common and joint sizes of the whole sets, exactly. pairs: written."""
    open_ = _meet(texts, pairs, False)
    out = _meet(texts, open_.select("x", "p"), True)
    release(texts.spark, open_)
    return out


def components(links: DataFrame) -> DataFrame:
    """id, label (the smallest id reachable) of the linked ids: minimum labels spread, then jump to their label's label.

    A text that links with several pivots keeps its link to the smallest; the others hang on that pivot instead. This connects the
    same ids, and the texts of a large group, which share their pivots, leave each such pair of pivots once.
    """
    stars = links.withColumn("m", F.min("p").over(W.partitionBy("x")))
    thin = stars.select(F.col("x").alias("a"), F.col("m").alias("b")).union(stars.where("p <> m").select("m", "p")).distinct()
    edges = materialise(thin.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.*"), "edges")
    dealt, give, on = split_keys(edges, ["b"], LEAST)
    state = materialise(edges.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("id")).alias("label")), "labels")
    while True:
        spread = dealt.join(give(state.withColumnRenamed("id", "b")), on).groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        new = state.join(spread, "id").select("id", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        # Many ids share a label, which is an id of its own: the jump is a look-up of labels in the labels.
        new = materialise(new, "near")
        jump = state.select(F.col("id").alias("label"), F.col("label").alias("far"))
        new = materialise(split_join(new, jump, ["label"], "left", LEAST).select("id", "old", F.least("label", F.coalesce("far", "label")).alias("label")), "labels")
        changed = new.where("old <> label").limit(1).count()
        state = new.select("id", "label")
        if not changed:
            return state


class Block:
    """Sets that sit in a task; common() counts what a visitor has in common with each of them.

    Shingles of many of the sets are rows of a table of bytes, the others a sorted list.
    """

    def __init__(self, sets: list[np.ndarray]):
        self.size = np.array([len(s) for s in sets], np.int64)
        every = np.concatenate(sets)
        order = np.argsort(every, kind="stable")
        every, owner = every[order], np.repeat(np.arange(len(sets)), self.size)[order]
        starts = np.flatnonzero(np.append(True, every[1:] != every[:-1])) if len(every) else np.zeros(0, np.int64)
        held = np.diff(np.append(starts, len(every)))
        dense = held >= DENSE
        most = DENSE_BYTES // max(1, len(sets))
        if dense.sum() > most:
            dense &= held > np.sort(held)[-most]
        self.crowded = every[starts[dense]]
        self.table = np.zeros((len(self.crowded), len(sets)), np.uint8)
        at = np.repeat(dense, held)
        self.table[np.repeat(np.arange(len(self.crowded)), held[dense]), owner[at]] = 1
        self.rest, self.owner = every[~at], owner[~at]

    def common(self, own: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self.size), np.int64)
        if len(self.crowded):
            at = np.minimum(np.searchsorted(self.crowded, own), len(self.crowded) - 1)
            at = at[self.crowded[at] == own]
            for k in range(0, len(at), 255):
                out += np.add.reduce(self.table[at[k : k + 255]], axis=0, dtype=np.uint8)
        lo, hi = np.searchsorted(self.rest, own, "left"), np.searchsorted(self.rest, own, "right")
        lo, hi = lo[hi > lo], hi[hi > lo]
        if len(lo):
            size = hi - lo
            at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(lo, size)
            out += np.bincount(self.owner[at], minlength=len(out))
        return out

    def linked(self, own: np.ndarray) -> np.ndarray:
        """Which of the sets link with own."""
        common = self.common(own)
        return common * 100 >= (self.size + len(own) - common) * PERCENT


def blocks(texts: Texts, named: DataFrame) -> DataFrame:
    """Links (x, p) between different components inside large regions, enough to connect what they connect.

    named: rep, n, p (the region), d (distance to p or null), label, main. Texts outside the main component form blocks,
    ring by ring of d; all texts of the region meet the blocks of the rings within their window.
    """
    spark = texts.spark
    reach = (100 - PERCENT) / 100 + 1e-9
    named = named.withColumn("ring", F.coalesce(F.floor(F.col("d") * 10), F.lit(-1)).cast("int"))
    askers = named.where("label <> main")
    load = askers.groupBy("p", "ring").agg(F.greatest(F.ceil(F.sum("n") / BLOCK_SHINGLES), F.ceil(F.count("*") / BLOCK)).cast("int").alias("blocks"))
    load = load.join(named.groupBy("p").agg(F.ceil(F.count("*") / PER_TASK).cast("int").alias("salts")), "p")
    load = materialise(load, "load")
    trip = lambda block, salt, role: F.struct("p", F.col("to").alias("ring"), block.cast("int").alias("block"), salt.cast("int").alias("salt"), F.lit(role).alias("role"), "label")
    to = load.withColumnRenamed("ring", "to")
    sit = askers.join(to.withColumnRenamed("p", "_p"), (F.col("p") == F.col("_p")) & (F.col("ring") == F.col("to")))
    sit = sit.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).select("rep", trip(F.pmod(F.xxhash64("rep"), "blocks"), F.col("salt"), 0).alias("t"))
    within = F.col("d").isNull() | (F.col("to") < 0) | F.col("to").between(F.floor((F.col("d") - reach) * 10), F.floor((F.col("d") + reach) * 10))
    come = named.join(to.withColumnRenamed("p", "_p"), (F.col("p") == F.col("_p")) & within)
    come = come.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("rep", trip(F.col("block"), F.pmod(F.xxhash64("rep", F.lit(7)), "salts"), 1).alias("t"))
    trips, few = _trips(sit.unionByName(come))
    fields = {"p": pa.int64(), "ring": pa.int32(), "block": pa.int32(), "salt": pa.int32(), "role": pa.int32(), "label": pa.int64()}
    sent = _travel(texts.whole(trips, few), fields, "p long, ring int, block int, salt int, role int, label long")
    cell = ["p", "ring", "block", "salt"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, ids, labels, block, joined = None, [], [], [], None, set()
        for batch in batches:
            found = ([], [])
            for p, ring, place, salt, role, label, x, _, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != (p, ring, place, salt):
                    key, held, ids, labels, block, joined = (p, ring, place, salt), [], [], [], None, set()
                own = np.frombuffer(data, np.uint64)
                if role == 0:
                    held.append(own)
                    ids.append(x)
                    labels.append(label)
                    continue
                if not held:
                    continue
                if block is None:
                    block, groups = Block(held), np.array(labels)
                for k in np.flatnonzero(block.linked(own) & (groups != label)).tolist():
                    both = (labels[k], label)  # one link joins two components
                    if both not in joined:
                        joined.add(both)
                        found[0].append(x)
                        found[1].append(ids[k])
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in found], names=["x", "p"])

    out = materialise(sent.repartition(*cell).sortWithinPartitions(*cell, "role").mapInArrow(freed(compare), "x long, p long"), "block_links")
    discard(spark, trips.scratch_path)
    release(spark)
    return out


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    return rows.join(labels, F.col("rep") == F.col("id"), "left").drop("id").withColumn("label", F.coalesce("label", "rep"))


def _large(crowds: DataFrame, labels: DataFrame) -> DataFrame:
    """rep, n, p, d, label of the large regions that still hold several components, with main, the label most have."""
    named = materialise(_labelled(crowds, labels), "crowds")
    main = named.groupBy("p", "label").agg(F.count("*").alias("c")).groupBy("p").agg(F.max(F.struct("c", "label")).alias("m"), F.sum("c").alias("all"))
    return named.join(main.where(F.col("m.c") < F.col("all")).select("p", F.col("m.label").alias("main"), (F.col("all") - F.col("m.c")).alias("asking")), "p")


def _unlike(asks: DataFrame, done: DataFrame) -> DataFrame:
    """asks (x, p) without those in done, either way round."""
    done = done.select("x", "p").unionByName(done.select(F.col("p").alias("x"), F.col("x").alias("p")))
    return asks.join(done, ["x", "p"], "left_anti")


def links(texts: Texts, reps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links (x, p) that connect all components, and their labels. reps: rep, each class's first document."""
    spark = texts.spark
    table = materialise(regions(texts, reps), "regions")
    release(spark)
    piv = table.groupBy("s").agg(F.min(F.struct("rep", "n")).alias("v"), F.count("*").alias("cnt")).where("cnt > 1")
    table = materialise(split_join(table, piv.select("s", "cnt", F.col("v.rep").alias("p"), F.col("v.n").alias("pn")), ["s"]), "pivoted")
    good = F.col("common") * 100 >= F.col("joint") * PERCENT
    first = table.where((F.col("rep") != F.col("p")) & _fit(F.col("n"), F.col("pn"))).select(F.col("rep").alias("x"), "p").distinct()
    first = materialise(first, "first")
    tested = measure(texts, first)
    found = tested.where(good).select("x", "p")
    labels = components(found)
    far = tested.select(F.col("x").alias("rep"), "p", (1 - F.col("common") / F.col("joint")).alias("d"))
    # Large regions with the same pivot are one.
    crowds = table.where(F.col("cnt") > CROWD).select("rep", "n", "p").distinct().join(far, ["rep", "p"], "left")
    crowds = materialise(crowds.withColumn("d", F.when(F.col("rep") == F.col("p"), 0.0).otherwise(F.col("d"))), "crowds")
    # Small regions of several components go on, each text with its distance to the region's pivot where it was measured.
    named = _labelled(table.where(F.col("cnt") <= CROWD), labels)
    mixed = named.groupBy("s").agg(F.min("label").alias("_a"), F.max("label").alias("_z")).where("_a < _z").select("s", "_a")
    named = materialise(named.join(mixed, "s").join(far, ["rep", "p"], "left"), "mixed")
    # Recursion: in small regions a second pivot from a component other than the first's, in large ones several a round.
    other = named.where("label > _a").groupBy("s").agg(F.min(F.struct("rep", "n", "label")).alias("v"))
    asks = named.join(other, "s").where((F.col("label") != F.col("v.label")) & _fit(F.col("n"), F.col("v.n"))).select(F.col("rep").alias("x"), F.col("v.rep").alias("p"))
    done, asking, crowded = first, None, _some(crowds)
    for turn in range(ROUNDS):
        now = 0
        if crowded:
            large = materialise(_large(crowds, labels).where(F.col("asking") > BLOCK), "large")
            now = large.agg(F.sum((F.col("label") != F.col("main")).cast("long"))).first()[0] or 0
        more = bool(now) and (asking is None or now < 0.9 * asking)
        if turn and not more:
            break
        asking = now
        if more:
            drawn = [F.min(F.struct(F.xxhash64("rep", F.lit(turn * PIVOTS + k)).alias("h"), "rep", "n", "label")) for k in range(PIVOTS)]
            drawn = large.groupBy("p").agg(F.array(*drawn).alias("vs")).select("p", F.explode("vs").alias("v"))
            wide = large.join(drawn, "p").where((F.col("label") != F.col("v.label")) & _fit(F.col("n"), F.col("v.n"))).select(F.col("rep").alias("x"), F.col("v.rep").alias("p"))
            asks = asks.unionByName(wide) if asks is not None else wide
        asks = materialise(_unlike(asks.distinct(), done), "asks")
        if _some(asks):
            again = measure(texts, asks)
            done = done.unionByName(again.select("x", "p"))
            found, labels = _joined(found, again.where(good).select("x", "p"), labels)
        asks = None
    if crowded:
        large = materialise(_large(crowds, labels), "large")
        if _some(large):
            found, labels = _joined(found, blocks(texts, large), labels)
    named = materialise(_labelled(named.drop("label"), labels).select("s", "rep", "n", "p", "d", "label"), "open")
    # What is left in small regions: pairs of different components within the triangle window of their region's pivot.
    a, b = named.alias("a"), named.alias("b")
    window = F.abs(F.col("a.d") - F.col("b.d")) <= (100 - PERCENT) / 100 + 1e-9
    apart = (F.col("a.s") == F.col("b.s")) & (F.col("a.rep") < F.col("b.rep")) & (F.col("a.label") != F.col("b.label")) & _fit(F.col("a.n"), F.col("b.n")) & F.coalesce(window, F.lit(True))
    rest = a.join(b, apart).select(F.col("b.rep").alias("x"), F.col("a.rep").alias("p")).distinct()
    rest = materialise(_unlike(rest, done), "rest")
    if _some(rest):
        found, labels = _joined(found, measure(texts, rest).where(good).select("x", "p"), labels)
    return found, labels


def _some(df: DataFrame) -> bool:
    return bool(df.limit(1).count())


def _joined(found: DataFrame, new: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All links with the new ones, and the labels of their components."""
    new = materialise(new, "new")
    if not _some(new):
        return found, labels
    found = materialise(found.unionByName(new), "links")
    return found, components(found)


def degrees(texts: Texts, members: DataFrame) -> DataFrame:
    """rep, n_links: with how many other classes each class links. members: rep, n, label of all classes that have a link.

    All links of a class are inside its component. Where that has two classes they link; in larger ones its texts sit in
    blocks, and every text of the component meets every block once. Only counts leave.
    """
    spark = texts.spark
    members = materialise(members, "members")
    # Up to SIDES squared cells of LEAST_BLOCK texts or more, then as many as blocks of BLOCK texts make.
    side = F.least(F.lit(BLOCK), F.greatest(F.lit(LEAST_BLOCK), F.ceil(F.count("*") / SIDES)))
    load = members.groupBy("label").agg(F.greatest(F.ceil(F.sum("n") / BLOCK_SHINGLES), F.ceil(F.count("*") / side)).cast("int").alias("blocks"), F.ceil(F.count("*") / side).cast("int").alias("salts"), F.count("*").alias("classes"))
    placed = materialise(split_join(members, materialise(load, "load"), ["label"]), "placed")
    pairs = placed.where("classes = 2").select("rep", F.lit(1).cast("long").alias("n_links"))
    placed = placed.where("classes > 2")
    trip = lambda block, salt, role: F.struct("label", block.cast("int").alias("block"), salt.cast("int").alias("salt"), F.lit(role).alias("role")).alias("t")
    # A component of one block and task sits there and needs no visits; its texts travel once (role 2).
    alone = (F.col("blocks") == 1) & (F.col("salts") == 1)
    only = placed.where(alone).select("rep", trip(F.lit(0), F.lit(0), 2))
    large = placed.where(~alone)
    sit = large.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).select("rep", trip(F.pmod(F.xxhash64("rep"), "blocks"), F.col("salt"), 0))
    come = large.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("rep", trip(F.col("block"), F.pmod(F.xxhash64("rep", F.lit(7)), "salts"), 1))
    trips, few = _trips(only.unionByName(sit).unionByName(come))
    fields = {"label": pa.int64(), "block": pa.int32(), "salt": pa.int32(), "role": pa.int32()}
    cell = ["label", "block", "salt"]
    sent = _travel(texts.whole(trips, few), fields, "label long, block int, salt int, role int")

    def counts(held: list[np.ndarray], ids: list[int]) -> Iterator[tuple[int, int]]:
        """What the texts of a cell of their own link with; each links with itself."""
        block = Block(held) if held else None
        for x, own in zip(ids, held, strict=True):
            yield x, int(block.linked(own).sum()) - 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, ids, block, own_cell = None, [], [], None, False
        for batch in batches:
            found = []
            for label, place, salt, role, x, _, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != (label, place, salt):
                    found.extend(counts(held, ids) if own_cell else ())
                    key, held, ids, block, own_cell = (label, place, salt), [], [], None, role == 2
                own = np.frombuffer(data, np.uint64)
                if role != 1:
                    held.append(own)
                    ids.append(x)
                    continue
                if not held:
                    continue
                if block is None:
                    block, names = Block(held), np.array(ids)
                found.append((x, int((block.linked(own) & (names != x)).sum())))
            yield _degree_batch(found)
        if own_cell:
            yield _degree_batch(list(counts(held, ids)))

    counted = sent.repartition(*cell).sortWithinPartitions(*cell, "role").mapInArrow(freed(count), "rep long, n_links long")
    out = materialise(counted.groupBy("rep").agg(F.sum("n_links").alias("n_links")).unionByName(pairs), "degrees")
    discard(spark, trips.scratch_path)
    release(spark)
    return out


def _degree_batch(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], names=["rep", "n_links"])


def jaccard_join(docs: DataFrame, count_links: bool = True) -> DataFrame:
    """docs: doc_id, text. doc_id, n_shingles, component_id, class_id (first document of equal sets), n_links, text_hash, row, component.

    A row each. n_links counts all other classes that the row's class links with; it is null if count_links is false, which
    saves the texts' visits to their components' blocks. text_hash (of the text) and doc_id name
    a row's kind, row tells equal rows apart, and component is the same for all rows that links connect.
    """
    texts = Texts(docs.selectExpr("cast(doc_id as long) doc_id", "text"))
    key = ["n", "fp1", "fp2"]
    classes = materialise(texts.table.where("n > 0").groupBy(*key).agg(F.min("row").alias("rep"), F.min("doc_id").alias("class_id")), "classes")
    _, labels = links(texts, classes.select("rep"))
    linked = materialise(classes.join(labels, F.col("rep") == F.col("id")).select("rep", "n", "class_id", "label"), "linked")
    degree = degrees(texts, linked.select("rep", "n", "label")) if count_links else linked.select("rep", F.lit(None).cast("long").alias("n_links"))
    named = materialise(linked.groupBy("label").agg(F.min("class_id").alias("component_id")), "named")
    linked = split_join(linked, named, ["label"]).select("rep", "label", "component_id").join(degree, "rep")
    known = materialise(classes.join(linked, "rep", "left").withColumn("component_id", F.when(F.col("label").isNull(), F.col("class_id")).otherwise(F.col("component_id"))), "known")
    out = split_join(texts.table.select("row", "doc_id", "text_hash", *key), known, key, "left")
    empty = F.col("n") == 0
    return out.select(
        "doc_id", F.col("n").alias("n_shingles"), *[F.when(empty, F.col("doc_id")).otherwise(F.col(c)).alias(c) for c in ("component_id", "class_id")],
        (F.coalesce("n_links", F.lit(0)) if count_links else F.col("n_links")).cast("long").alias("n_links"), "text_hash", "row", F.coalesce("label", "rep", "row").alias("component"),
    )


def one_of_each(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of every component one row stays: the smallest doc_id's (rows without one come last). found: jaccard_join(), written.

    doc_id and text_hash of the kinds of rows of which none stays, and of those of which one of several equal rows does.
    """
    order = F.struct(F.col("doc_id").isNull().alias("a"), "doc_id", "text_hash", "row")
    kept = found.groupBy("component").agg(F.min(order).alias("k")).select(F.col("k.row").alias("row"), F.lit(1).alias("kept"))
    kinds = found.join(kept, "row", "left").groupBy("doc_id", "text_hash").agg(F.count("*").alias("rows"), F.count("kept").alias("kept"))
    kinds = materialise(kinds.where("kept < rows"), "kinds")
    return kinds.where("kept = 0").select("doc_id", "text_hash"), kinds.where("kept > 0").select("doc_id", "text_hash")


def deduplicate(docs: DataFrame) -> DataFrame:
    """docs with one row of each component."""
    gone, several = one_of_each(materialise(jaccard_join(docs, count_links=False), "joined"))
    out = without(docs, gone)
    if not several.limit(1).count():
        return out
    # Equal rows (doc_id and text) of which one stays: they are few kinds, and go through a shuffle of their own.
    rest = without(out, several)
    rows = whole_rows(out).withColumn("_d", F.col("row.doc_id").cast("long")).withColumn("_t", F.xxhash64("row.text"))
    same = F.col("_d").eqNullSafe(F.col("doc_id")) & (F.col("_t") == F.col("text_hash"))
    equal = rows.join(several, same).dropDuplicates(["_d", "_t"]).select("row.*")
    return rest.unionByName(equal)


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_shingles", "component_id", "class_id", "n_links")
