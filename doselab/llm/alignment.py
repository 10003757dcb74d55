"""Alignment of two tokenizers' tokens over byte ranges, a distinct segment at a time.

Texts, with one space before, are split before runs of white space. There no token of either vocabulary can span: the
first (byte-level) splits its input there by its pattern, and of the second (pieces) ``check_vocabularies`` looks at every
piece for one that holds such white space after another character, and leaves out white space where it finds one.
So the tokens of a text are those of its segments, one after another, and each distinct segment is tokenised and aligned
once.

1. Each Arrow batch of documents becomes a block: its distinct segments, and each text as a sequence of their numbers.
2. A block's distinct segments go to the task of their segment, which tokenises each once, with both tokenizers, cuts the tokens
   into groups where tokens of both end, and packs the groups for each block. A hot segment comes once a block.
3. Alignments join back to the blocks, where documents are composed: counts, groups in order, and the id pairs that each
   document links.
4. Pairs are counted over documents, first in blocks. The counts join back to the blocks' pairs, and each document sums those of
   its links through its segments.

No step holds more than one block or one segment's tokens (one document, if it is longer than a batch).

Defined results: null and empty texts have no tokens: zeros and an empty string; so do texts that one of the tokenizers
doesn't give back byte for byte (as with U+2581 in the text, or bytes that are no UTF-8), and their links count for nothing;
very long texts are whole; repeated rows and rows that share a doc_id are documents each; ties for a highest count are
all best; a null doc_id stays null; an empty table gives an empty one; of the input's columns only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import itertools
import os
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from doselab.llm.common import bounded_batches, materialise, split_join

#: The white space that may begin a segment, and what stands for a space in pieces.
CANDIDATES, SPACE_MARK = " \t\n", "▁"
#: Rows and bytes of a block at most (a longer text is a block of its own).
BLOCK = 8000, 16 << 20
#: Rows that a task packs for their blocks at once.
PACKED = 200_000
_BYTE_PIECE = re.compile(r"<0x([0-9A-F]{2})>")


def check_vocabularies(pieces: list[str], candidates: str = CANDIDATES) -> str:
    """Of candidates those that no piece holds after another kind of character, and that no space mark is joined with."""
    out = []
    for c in candidates:
        mark = SPACE_MARK if c == " " else c
        spans = any(p[k] == mark and not (p[k - 1] == SPACE_MARK and mark == SPACE_MARK) for p in pieces for k in range(1, len(p)))
        if not spans:
            out.append(c)
    return "".join(out)


class Pair:
    """Tokenizer A (a byte-level tokenizer file) and B (a model of pieces that puts one space before its input)."""

    def __init__(self, byte_level: str, pieces: str):
        self.args = (byte_level, pieces)
        self.ready = False

    def __getstate__(self):
        return {"args": self.args, "ready": False}

    def open(self) -> Pair:
        if self.ready:
            return self
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.a = Tokenizer.from_file(self.args[0])
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=self.args[1])
        # Byte-level letters: bytes that print stand for themselves, the others for the letters from U+0100 on, in order.
        letters = set(ByteLevel.alphabet())
        own = [b for b in range(256) if chr(b) in letters]
        byte = {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(sorted(set(range(256)) - set(own)))}
        self.a_bytes = [bytes(byte.get(c, 0) for c in self.a.id_to_token(i) or "") for i in range(self.a.get_vocab_size())]
        listed = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [self._piece(i, p) for i, p in enumerate(listed)]
        self.starts = check_vocabularies([p for i, p in enumerate(listed) if not self.b.is_byte(i)])
        if " " not in self.starts:
            raise ValueError("a piece spans a space: texts can't be split there")
        self.mark = self.b.piece_to_id(SPACE_MARK)
        s = self.starts
        self.plain = re.compile(rf"[{s}]*[^{s}]+|[{s}]+")
        self.exact = re.compile(rf"(?<=\S)(?=[{s}])")
        self.other = re.compile(rf"[^\S{s}]")
        self.ready = True
        return self

    def _piece(self, i: int, piece: str) -> bytes:
        if self.b.is_byte(i):
            return bytes([int(_BYTE_PIECE.fullmatch(piece)[1], 16)])
        return b"" if self.b.is_control(i) or self.b.is_unknown(i) else piece.replace(SPACE_MARK, " ").encode()

    def segments(self, text: str) -> list[str]:
        """text, which begins with a space, split before runs of white space."""
        # Other white space before a segment's would be part of its run: such texts take the exact pattern.
        return self.exact.split(text) if self.other.search(text) else self.plain.findall(text)

    def tokens(self, segments: list[str]) -> Iterator[tuple[list[int], list[int]]]:
        """The ids of both tokenizers for each segment."""
        b = self.b.encode([s[1:] if s[0] == " " else s for s in segments], num_threads=1)
        for s, x, y in zip(segments, self.a.encode_batch(segments, add_special_tokens=False), b, strict=True):
            # Before white space other than a space, the space that B puts first stays a token of its own. B puts none before nothing.
            yield x.ids, [self.mark] if s == " " else y if s[0] == " " else y[1:] if y[:1] == [self.mark] else []

    def align(self, segment: str, a: list[int], b: list[int]) -> str | None:
        """The ids in groups between offsets where tokens of both end, as text; None where bytes differ from the segment's."""
        raw = segment.encode()
        own, other = [self.a_bytes[i] for i in a], [self.b_bytes[i] for i in b]
        if b"".join(own) != raw or b"".join(other) != raw:
            return None
        if len(a) == 1 or len(b) == 1:
            return f"{','.join(map(str, a))}|{','.join(map(str, b))}"
        ends_a, ends_b = list(itertools.accumulate(map(len, own))), list(itertools.accumulate(map(len, other)))
        out, i, j = [], 0, 0
        for end in sorted(set(ends_a) & set(ends_b)):
            k, m = ends_a.index(end, i) + 1, ends_b.index(end, j) + 1
            out.append(f"{','.join(map(str, a[i:k]))}|{','.join(map(str, b[j:m]))}")
            i, j = k, m
        return ";".join(out)


def _blocks(docs: DataFrame, pair: Pair) -> DataFrame:
    """block; ids: doc_id of each text; sizes: its number of segments (0: no tokens); places: numbers of its segments; segments."""
    bounded_batches(docs.sparkSession, *BLOCK)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pair.open()
        part = TaskContext.get().partitionId() << 32
        for k, batch in enumerate(batches):
            number = defaultdict(itertools.count().__next__)
            sizes, places = [], []
            for text in batch.column("text").to_pylist():
                try:
                    found = pair.segments(" " + text.decode()) if text else []
                except UnicodeDecodeError:
                    found = []
                sizes.append(len(found))
                places.append(np.fromiter(map(number.__getitem__, found), "<u4", len(found)))
            flat = np.concatenate(places) if places else np.zeros(0, "<u4")
            # Frequent segments first: small numbers pack better.
            order = np.argsort(-np.bincount(flat, minlength=len(number)), kind="stable")
            place = np.empty(len(order), "<u4")
            place[order] = np.arange(len(order))
            names = list(number)
            row = [[part + k], [batch.column("doc_id").to_pylist()], [sizes], [zlib.compress(place[flat].tobytes() if len(flat) else b"", 1)], [[names[i] for i in order.tolist()]]]
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, kinds, strict=True)], names=["block", "ids", "sizes", "places", "segments"])

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return read.mapInArrow(each, "block long, ids array<long>, sizes array<long>, places binary, segments array<string>")


def _aligned(places: DataFrame, pair: Pair) -> DataFrame:
    """places (block, place, segment) as packs: per block some places, and for each the segment's groups, `a1,a2|b1;a3|b2,b3`.

    Equal segments meet in one task and in order, so each is tokenised once; its rows stream by, at most one a block. Groups
    are empty where the bytes of tokens differ from the segment's.
    """
    n = int(places.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = places.repartition(n, "segment").sortWithinPartitions("segment")
    bounded_batches(places.sparkSession)

    def pack(blocks: list[np.ndarray], at: list[np.ndarray], groups: list[str]) -> pa.RecordBatch:
        block, place = np.concatenate(blocks), np.concatenate(at)
        order = np.argsort(block, kind="stable")
        edges = np.flatnonzero(np.diff(block[order], prepend=-1, append=-1))
        spans = [order[x:y] for x, y in zip(edges[:-1], edges[1:], strict=True)]
        columns = [
            pa.array(block[[x[0] for x in spans]], pa.int64()),
            pa.array([zlib.compress(place[x].astype("<u4").tobytes(), 1) for x in spans], pa.binary()),
            pa.array([zlib.compress("\n".join([groups[i] for i in x.tolist()]).encode(), 1) for x in spans], pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["block", "place", "groups"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair.open()
        blocks, at, groups, last = [], [], [], ("", "")
        for batch in batches:
            coded = batch.column("segment").dictionary_encode()
            names = coded.dictionary.to_pylist()
            new = [s for s in names if s != last[0]]
            found = {s: pair.align(s, a, b) or "" for s, (a, b) in zip(new, pair.tokens(new), strict=True)} if new else {}
            found.setdefault(*last)
            texts = [found[s] for s in names]
            groups += [texts[i] for i in coded.indices.to_pylist()]
            blocks.append(np.asarray(batch.column("block"), np.int64))
            at.append(np.asarray(batch.column("place"), np.int64))
            if names:
                last = names[-1], texts[-1]
            if len(groups) >= PACKED:
                yield pack(blocks, at, groups)
                blocks, at, groups = [], [], []
        if groups:
            yield pack(blocks, at, groups)

    return ordered.mapInArrow(each, "block long, place binary, groups binary")


def _texts(block: pa.Table) -> tuple[list, np.ndarray, np.ndarray]:
    """doc_ids, bounds of texts within places, and places of a block of one row."""
    places = np.frombuffer(zlib.decompress(block.column("places")[0].as_py()), "<u4")
    return block.column("ids")[0].as_py(), np.concatenate([[0], np.cumsum(np.array(block.column("sizes")[0].as_py(), np.int64))]), places


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The sum of values between consecutive bounds."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[bounds[1:]] - total[bounds[:-1]]


_COMPOSED = "block long, good array<boolean>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, sha array<string>, links binary, own binary, times binary, a array<int>, b array<int>, n array<long>"


def _compose(block: pa.Table, side: pa.Table) -> pa.Table:
    """Of each text its counts and the hash of its groups; of each segment its linked pairs (how many, their numbers in the
    block, how often each); of each pair of the block how many texts link it."""
    ids, bounds, places = _texts(block)
    packs = [np.frombuffer(zlib.decompress(x.as_py()), "<u4") for x in side.column("place")]
    groups = [""] * sum(map(len, packs))
    for at, texts in zip(packs, side.column("groups"), strict=True):
        for i, text in zip(at.tolist(), zlib.decompress(texts.as_py()).decode().split("\n"), strict=True):
            groups[i] = text
    number = defaultdict(itertools.count().__next__)
    counts, own, times = [], [], []
    for text in groups:
        n_a = n_b = n_links = 0
        before = len(own)
        parts = text.split(";") if text else []
        for part in parts:
            x, y = part.split("|")
            x, y = x.split(","), y.split(",")
            if len(x) * len(y) <= 64:
                own += [number[i, j] for i in x for j in y]
            else:  # the same ids again and again: each pair once, with how often
                found = [(number[i, j], m * n) for i, m in Counter(x).items() for j, n in Counter(y).items()]
                times += [1] * (len(own) - len(times)) + [n for _, n in found]
                own += [k for k, _ in found]
            n_a, n_b, n_links = n_a + len(x), n_b + len(y), n_links + len(x) * len(y)
        counts.append((n_a, n_b, len(parts), n_links, not text, len(own) - before))
    times += [1] * (len(own) - len(times))
    counts, own, times = np.array(counts, np.int64).reshape(-1, 6), np.array(own, np.int64), np.array(times, np.int64)
    links = counts[:, 5]
    good = (_sums(counts[places, 4], bounds) == 0) & (np.diff(bounds) > 0)
    sha = [hashlib.sha256(";".join([groups[i] for i in places[bounds[k] : bounds[k + 1]].tolist()]).encode()).hexdigest() if good[k] else "" for k in range(len(ids))]
    sums = [np.where(good, _sums(counts[places, c], bounds), 0) for c in range(4)]
    first, held = np.cumsum(links) - links, np.zeros(len(number), np.int64)
    for at in range(0, len(ids), 256):  # keeps scratch small
        rows = np.flatnonzero(good[at : at + 256]) + at
        spans = [np.unique(places[bounds[k] : bounds[k + 1]]) for k in rows.tolist()]
        if spans:
            text, segment = np.repeat(np.arange(len(rows)), [len(x) for x in spans]), np.concatenate(spans)
            size = links[segment]
            inner = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            seen = np.unique(np.repeat(text, size) * len(number) + own[np.repeat(first[segment], size) + inner])
            held += np.bincount(seen % max(len(number), 1), minlength=len(number))
    a, b = (np.array([int(pair[c]) for pair in number], np.int32) for c in (0, 1))
    pack = lambda x: zlib.compress(x.astype("<i8").tobytes(), 1)
    row = [block.column("at")[0].as_py(), good, *sums, sha, pack(links), pack(own), pack(times), a, b, held]
    kinds = [pa.int64(), pa.list_(pa.bool_()), *[pa.list_(pa.int64())] * 4, pa.list_(pa.string()), *[pa.binary()] * 3, pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64())]
    return pa.table([pa.array([x], t) for x, t in zip(row, kinds, strict=True)], names=[x.split()[0] for x in _COMPOSED.split(", ")])


_RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _finish(block: pa.Table, side: pa.Table) -> pa.Table:
    """A row a text: what was composed, and the sums of its links' counts."""
    ids, bounds, places = _texts(block)
    links, own, times = (np.frombuffer(zlib.decompress(block.column(c)[0].as_py()), "<i8") for c in ("links", "own", "times"))
    good = np.array(block.column("good")[0].as_py(), bool)
    edges = np.concatenate([[0], np.cumsum(links)])
    scores = []
    for name in ("top", "n"):
        of_pair = np.zeros(len(side) and int(np.asarray(side.column("pair")).max()) + 1, np.int64)
        of_pair[np.asarray(side.column("pair"))] = np.asarray(side.column(name))
        scores.append(np.where(good, _sums(_sums(of_pair[own] * times, edges)[places], bounds), 0))
    composed = [pa.array(block.column(c)[0].as_py(), pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")]
    sha = pa.array(block.column("sha")[0].as_py(), pa.string())
    return pa.table([pa.array(ids, pa.int64()), *composed, *map(pa.array, scores), sha], names=[x.split()[0] for x in _RESULT.split(", ")])


def align(docs: DataFrame, pair: Pair) -> DataFrame:
    """docs: doc_id, text. Per document n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    blocks = materialise(_blocks(docs, pair), "blocks")
    places = blocks.select("block", F.posexplode("segments").alias("place", "segment"))
    texts = blocks.select(F.col("block").alias("at"), "ids", "sizes", "places")
    composed = materialise(texts.groupBy("at").cogroup(_aligned(places, pair).groupBy("block")).applyInArrow(_compose, _COMPOSED), "composed")
    pairs = composed.select("block", F.posexplode(F.arrays_zip("a", "b", "n")).alias("pair", "x")).select("block", "pair", "x.*")
    counted = pairs.groupBy("a", "b").agg(F.sum("n").alias("n"))
    # As many rows an id of A as B has ids, at most.
    counted = materialise(counted.withColumn("top", (F.col("n") == F.max("n").over(W.partitionBy("a"))).cast("long")), "counted")
    counts = split_join(pairs.drop("n"), counted, ["a", "b"]).select("block", "pair", "n", "top")
    whole = texts.join(composed.drop("a", "b", "n").withColumnRenamed("block", "at"), "at")
    return whole.groupBy("at").cogroup(counts.groupBy("block")).applyInArrow(_finish, _RESULT)


def public_pair() -> Pair:
    import public_tokenizers as public

    return Pair(public.path("byte_bpe_50k.json"), public.path("piece_bpe_32k.model"))


def op12_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_pair())
