"""Byte-level BPE over a local rank file: texts to ids, ids to bytes.

Each match of the vocabulary's pattern is merged on its own by the tiktoken library. Texts longer than ``PART`` characters
go to it in parts, cut only where a match ends whatever stands around: before white space that follows other characters, and
between ASCII letters, digits and signs. White-space runs of more than ``RUN`` characters, on which the library's
pattern matcher runs out of stack, are single matches by rule (all of the run, without its last character if more text
follows) and go to the merges directly. A match without any such place stays whole, whatever its length.

Ids travel packed, as little-endian unsigned 32-bit integers in a binary column. Decoding joins the bytes of the ids, so
that ids which end inside a character give back the bytes as they are.

Defined results: null and empty texts have no ids and no bytes; bytes that are no UTF-8 count as U+FFFD; a very long text is
one row; rows are encoded one by one, so repeated rows repeat and rows that share a doc_id each keep their own; a null
doc_id stays null; an empty table gives an empty one; of the input's columns only doc_id and text are read. Packed ids that are
null decode to no bytes; an id outside of the vocabulary, or a torn one, is an error.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doselab.llm.common import map_batches

#: Characters of a part (more where no safe boundary comes); white-space runs from which on the matcher is not asked.
PART, RUN = 1 << 16, 4096
#: The white space of the pattern's \s (Unicode White_Space).
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_SAFE = re.compile(
    rf"(?<=[^{WHITE}])(?=[{WHITE}])"
    r"|(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])"
    r"|(?<=[A-Za-z0-9])(?=[!-/:-@\[-`{-~])"
    r"|(?<=[!-&(-/:-@\[-`{-~])(?=[A-Za-z0-9])"  # not after an apostrophe, which may begin a contraction
)
_LONG = re.compile(rf"[{WHITE}]{{{RUN + 1},}}")


def parts(text: str, part: int = PART) -> Iterator[str]:
    """text in parts of part characters or more, cut at safe boundaries."""
    at = 0
    while len(text) - at > part:
        found = _SAFE.search(text, at + part)
        if not found:
            break
        yield text[at : found.start()]
        at = found.start()
    yield text[at:]


class RankEncoder:
    """ranks: path of a rank file (base64 bytes and a rank a line); pattern: what splits texts before the merges."""

    def __init__(self, ranks: str, pattern: str):
        self.args = (ranks, pattern)
        self.library = None

    def __getstate__(self):
        return {"args": self.args, "library": None}

    def _open(self):
        if self.library is None:
            import tiktoken

            ranks, pattern = self.args
            with open(ranks, "rb") as lines:
                merges = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
            self.library = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=merges, special_tokens={})
        return self.library

    def encode(self, text: str) -> np.ndarray:
        library, out, at = self._open(), [], 0
        if len(text) <= RUN:
            return np.array(library.encode_ordinary(text), "<u4")
        for run in _LONG.finditer(text):
            end = run.end() if run.end() == len(text) else run.end() - 1
            out += [library.encode_ordinary(p) for p in parts(text[at : run.start()])]
            out.append(library._core_bpe.encode_single_piece(text[run.start() : end].encode()))
            at = end
        out += [library.encode_ordinary(p) for p in parts(text[at:])]
        return np.concatenate([np.array(x, "<u4") for x in out])

    def decode(self, ids: np.ndarray) -> bytes:
        return self._open().decode_bytes(ids.tolist())


def encode(docs: DataFrame, encoder: RankEncoder) -> DataFrame:
    """docs: doc_id, text. doc_id, ids (packed)."""

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = [encoder.encode(t.as_py().decode("utf-8", "replace")).tobytes() if t.is_valid else b"" for t in batch.column("text")]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")), each, "doc_id long, ids binary")


def decode(tokens: DataFrame, encoder: RankEncoder) -> DataFrame:
    """tokens: doc_id, ids (packed). The same and decoded, the bytes of the ids."""

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [encoder.decode(np.frombuffer(t.as_py(), "<u4")) if t.is_valid else b"" for t in batch.column("ids")]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("ids"), pa.array(found, pa.binary())], names=["doc_id", "ids", "decoded"])

    return map_batches(tokens.select("doc_id", "ids"), each, "doc_id long, ids binary, decoded binary")


def unpack(tokens: DataFrame) -> DataFrame:
    """tokens with the packed ids as an array of longs."""
    names = [c for c in tokens.columns if c != "ids"]
    fields = ", ".join(f"`{c}` {t}" for c, t in tokens.select(*names).dtypes)

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = pa.array([np.frombuffer(t.as_py() or b"", "<u4").astype(np.int64) for t in batch.column("ids")], pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), ids], names=[*names, "ids"])

    return map_batches(tokens.select(*names, "ids"), each, f"{fields + ', ' if fields else ''}ids array<long>")


def multilingual_encoder() -> RankEncoder:
    import public_tokenizers as public

    return RankEncoder(public.path("byte_bpe_multi_50k.tiktoken"), public.PATTERN)


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoder = multilingual_encoder()
    coded = decode(encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), encoder), encoder)
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
