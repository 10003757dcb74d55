"""Occurrences of given n-grams, and of all words, in texts: found in Arrow batches, over the bytes of all their texts at once, and
summed by Spark."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_APOSTROPHE, _SPACES = ord("'"), np.isin(np.arange(256), list(b" \t\n\x0b\f\r"))
#: Slots a pair of an index has in its table of marks; slots at most.
SLOTS, MOST_SLOTS = 16, 1 << 24


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of texts (none null) and where each begins; the last one's end is the last place."""
    texts = texts.cast(pa.string())
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    edges = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[edges[0] : edges[-1]] if edges[-1] > edges[0] else np.zeros(0, np.uint8)
    return data, edges - edges[0]


def _runs(member: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the runs of member bytes begin and stop; none reaches from one text into the next."""
    first, last = member.copy(), member.copy()
    first[1:] &= ~member[:-1]
    last[:-1] &= ~member[1:]
    starts, ends = edges[:-1][edges[:-1] < len(member)], edges[1:][edges[1:] > 0] - 1
    first[starts], last[ends] = member[starts], member[ends]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words (functions.text.WORD) of lower-cased texts, in order, and how many each text has."""
    data, edges = _bytes(texts)
    kept = data - np.uint8(ord("a")) < 26
    begin, stop = _runs(kept, edges)
    # Runs with an apostrophe between them, in one text: of such a chain the first run takes the second, the third the fourth.
    near = np.flatnonzero(begin[1:] - stop[:-1] == 1)
    near = near[data[stop[near]] == _APOSTROPHE]
    near = near[np.searchsorted(edges, begin[near], "right") == np.searchsorted(edges, begin[near + 1], "right")]
    if len(near):
        at = np.arange(len(near))
        fresh = np.concatenate([[True], np.diff(near) != 1])
        near = near[(at - np.maximum.accumulate(np.where(fresh, at, 0))) % 2 == 0]
        kept[stop[near]] = True
        stop[near] = stop[near + 1]
        begin, stop = np.delete(begin, near + 1), np.delete(stop, near + 1)
    offsets = np.concatenate([[0], np.cumsum(stop - begin)]).astype(np.int32)
    held = (data * kept).tobytes().translate(None, b"\0")  # several times as fast as data[kept]
    found = pa.StringArray.from_buffers(len(begin), pa.py_buffer(offsets), pa.py_buffer(held))
    return found, np.diff(np.searchsorted(begin, edges))


def space_counts(texts: pa.Array) -> np.ndarray:
    """How many runs of `\\S` each text has."""
    data, edges = _bytes(texts)
    return np.diff(np.searchsorted(_runs(~_SPACES[data], edges)[0], edges))


class Index:
    """Token windows of one width and all shorter n-grams in them, numbered by length.

    A number is the place of (the prefix's number, the last word's) among the sorted pairs of its length; single words have
    their place in ``words``, the mark of a text's start place 0.
    """

    def __init__(self, windows: list[list[str]], width: int, start: str, end: str):
        flat = pa.array([t for w in windows for t in w], pa.string())
        self.width, self.end = width, end
        self.words = pc.unique(pa.concat_arrays([pa.array([start, end]), flat]))
        last = pc.index_in(flat, value_set=self.words).to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)
        self.pairs, self.names, numbers = [], [self.words], last
        for _ in range(1, width):
            pair = numbers[:, :-1] * len(self.words) + last[:, last.shape[1] - numbers.shape[1] + 1 :]
            known, numbers = np.unique(pair, return_inverse=True)
            numbers = numbers.reshape(pair.shape)
            prefix, word = np.divmod(known, len(self.words))
            self.pairs.append(known)
            self.names.append(pc.binary_join_element_wise(self.names[-1].take(pa.array(prefix)), self.words.take(pa.array(word)), " "))

    def empty(self) -> list[np.ndarray]:
        """Zero counts: of the n-grams of each length as contexts (the longest are none), then of those of two words on."""
        return [np.zeros(len(n), np.int64) for n in self.names[:-1] + self.names[1:]]

    def marks(self) -> list[np.ndarray]:
        """For each length, which slots its pairs have: most other pairs fall into free ones and are not looked up."""
        out = []
        for known in self.pairs:
            marks = np.zeros(min(MOST_SLOTS, 1 << (SLOTS * len(known)).bit_length()), bool)
            marks[_slots(known, len(marks))] = True
            out.append(marks)
        return out

    def count(self, texts: pa.Array, sums: list[np.ndarray], marks: list[np.ndarray]) -> tuple[pa.Array, np.ndarray]:
        """Adds the n-grams of lower-cased texts to sums; returns the words, ends of texts among them, and how often each occurs.
        Each text is padded with width - 1 starts and one end, so that no n-gram that ends at a word reaches into the text before."""
        found, each = words(texts)
        coded = found.dictionary_encode()
        codes = coded.indices.to_numpy()
        ids = pc.index_in(coded.dictionary, value_set=self.words).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        last, pad = np.zeros(len(codes) + self.width * len(each), np.int64), self.width * np.arange(1, len(each) + 1)
        last[np.arange(len(codes)) + np.repeat(pad - 1, each)] = ids[codes]
        last[np.cumsum(each) + pad - 1] = 1
        at, n = np.flatnonzero(last >= 0), len(self.pairs)
        number = last[at]
        for i, known in enumerate(self.pairs):
            if not len(known):  # no windows at all
                break
            if len(at) and at[-1] == len(last) - 1:
                at, number = at[:-1], number[:-1]
            word = last[at + 1]
            sums[i] += np.bincount(number[word != 0], minlength=len(sums[i]))
            # Starts are last words of contexts, so they are numbered, but not counted.
            pair = number * len(self.words) + word
            near = np.flatnonzero((word >= 0) & marks[i][_slots(pair, len(marks[i]))])
            place = np.minimum(np.searchsorted(known, pair[near]), len(known) - 1)
            met = known[place] == pair[near]
            at, number, word = at[near[met]] + 1, place[met], word[near[met]]
            sums[n + i] += np.bincount(number[word != 0], minlength=len(sums[n + i]))
        often = np.bincount(codes, minlength=len(coded.dictionary))
        if not len(each):
            return coded.dictionary, often
        return pa.concat_arrays([coded.dictionary, pa.array([self.end])]), np.append(often, len(each))

    def rows(self, sums: list[np.ndarray]) -> Iterator[tuple[int, pa.Array, pa.Array, np.ndarray]]:
        """o, ctx, w (null: a context's total) and counts of all n-grams with a count."""
        n = len(self.pairs)
        for i in range(n):
            at = np.flatnonzero(sums[i])
            yield i + 1, self.names[i].take(pa.array(at)), pa.nulls(len(at), pa.string()), sums[i][at]
            at = np.flatnonzero(sums[n + i])
            prefix, word = np.divmod(self.pairs[i][at], len(self.words))
            yield i + 1, self.names[i].take(pa.array(prefix)), self.words.take(pa.array(word)), sums[n + i][at]


def _slots(pairs: np.ndarray, n: int) -> np.ndarray:
    """A hash of each pair below n, a power of two."""
    return ((pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) & (n - 1)


def _batched(rows: DataFrame) -> DataFrame:
    """rows, to leave in batches that are bounded by bytes, however long the texts."""
    rows.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    return rows


def _kinds(rows: DataFrame, *names: str) -> str:
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return "".join(f"{n} {kinds[n]}, " for n in names)


def tallied(texts: DataFrame, index: Index, *by: str) -> DataFrame:
    """by, o, ctx, w, c: partial counts, to be summed, of all words and text ends (o 0, ctx empty), of the index's n-grams (o words
    before w) and of its contexts before any word (w null). texts: by and text; nulls are no texts. A task holds counts of the
    index for each by that it meets."""
    rows = _batched(texts.select(*by, F.lower("text").alias("text")).where("text is not null"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, types, marks = {}, [], index.marks()

        def out(own: tuple, o: int, ctx: pa.Array, w: pa.Array, c: np.ndarray) -> pa.RecordBatch:
            keys = [pa.array([v] * len(c), t) for v, t in zip(own, types, strict=True)]
            return pa.RecordBatch.from_arrays([*keys, pa.array(np.full(len(c), o, np.int32)), ctx, w, pa.array(c, pa.int64())], names=[*by, "o", "ctx", "w", "c"])

        for batch in batches:
            types = [batch.schema.field(b).type for b in by]
            places = defaultdict(list)
            for i, own in enumerate(zip(*[batch.column(b).to_pylist() for b in by], strict=True)):
                places[own].append(i)
            text = batch.column("text")
            for own, part in [(own, text.take(pa.array(at))) for own, at in places.items()] if by else [((), text)]:
                w, c = index.count(part, sums.setdefault(own, index.empty()), marks)
                yield out(own, 0, pa.array([""] * len(c), pa.string()), w, c)
        for own, counts in sums.items():
            for o, ctx, w, c in index.rows(counts):
                yield out(own, o, ctx, w, c)

    return rows.mapInArrow(each, _kinds(texts, *by) + "o int, ctx string, w string, c long")


def sized(rows: DataFrame, *keep: str) -> DataFrame:
    """keep and n: how many runs of `\\S` the text of each of rows has. Rows without a text have none."""
    rows = _batched(rows.select(*keep, F.coalesce("text", F.lit("")).alias("text")))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keep], pa.array(space_counts(batch.column("text")), pa.int32())], names=[*keep, "n"])

    return rows.mapInArrow(each, _kinds(rows, *keep) + "n int")


def candidates(rows: DataFrame, needed: str) -> DataFrame:
    """The rows whose text has a match of needed, an expression in RE2's syntax; for searches that settle which of them count."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pc.match_substring_regex(batch.column("text"), needed))

    return _batched(rows).mapInArrow(each, rows.schema)
