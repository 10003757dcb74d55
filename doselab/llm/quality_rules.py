"""Repetition-coverage quality rules.

Rolling hashes over several n-gram lengths mark words inside duplicated n-grams; the measure is the share of
word characters that duplicated n-grams and duplicated lines cover. Rows pass through once; there is no shuffle.

Defined results: null text counts as empty (no words, base_failed true, kept false); very long texts are measured whole;
a share equal to its limit passes; repeated rows each get their own row, a null doc_id stays null; extra columns of any
name are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from doselab.llm import textnp as tx
from doselab.llm.common import map_batches

SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, dup_line_chars long, coverage array<double>, base_failed boolean, kept boolean"
#: n-gram lengths and the largest share of word characters that duplicated n-grams of that length may cover.
NGRAM_LIMITS = {5: 0.30, 6: 0.28, 8: 0.25, 10: 0.22}
DUP_LINE_CHARS = 0.30
SYMBOLS_PER_CHAR = 0.10
MIN_WORDS = 20
BASE_N = 8


def _is_repeated(h: np.ndarray) -> np.ndarray:
    """For each hash whether it occurs twice or more."""
    order = np.argsort(h)
    s = h[order]
    same = np.zeros(len(h), bool)
    equal = s[1:] == s[:-1]
    same[1:] |= equal
    same[:-1] |= equal
    out = np.empty(len(h), bool)
    out[order] = same
    return out


def covered(words: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """For each word whether it lies in an n-word window of its row that occurs twice or more in that row."""
    out = np.zeros(len(words), bool)
    if len(words) < n:
        return out
    own = row[: len(words) - n + 1]
    whole = np.flatnonzero(own == row[n - 1 :])
    repeated = whole[_is_repeated(tx.ngrams(words, n)[whole] ^ tx.mix(own[whole].astype(tx.U64) + tx.U64(1)))]
    edge = np.zeros(len(words) + 1, np.int64)
    edge[repeated] += 1
    np.add.at(edge, repeated + n, -1)
    return np.cumsum(edge[:-1]) > 0


def measure(buf: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The statistics of each row of a chunk."""
    n = len(offsets) - 1
    starts, ends, first = tx.runs(buf, offsets, tx.NOT_SPACE)
    n_words = np.diff(first)
    row = np.repeat(np.arange(n), n_words)
    points = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])
    chars = points[ends] - points[starts]
    per_row = lambda x: np.bincount(row, weights=x, minlength=n).astype(np.int64)
    words = tx.hash_runs(buf, starts, ends)
    word_chars = per_row(chars)
    symbol = np.zeros(256, bool)
    symbol[np.frombuffer(b"#*$%&|<>", np.uint8)] = True
    n_symbols = tx.counts_between(np.flatnonzero(symbol[buf]), offsets)
    # Lines: runs of anything but \n, without those that hold no word; the first of equal lines is not counted.
    other = np.ones(256, bool)
    other[0x0A] = False
    ls, le, lf = tx.runs(buf, offsets, other)
    lrow = np.repeat(np.arange(n), np.diff(lf))
    at = np.searchsorted(starts, ls)
    has_word = np.searchsorted(starts, le) > at
    ls, le, lrow, at, past = ls[has_word], le[has_word], lrow[has_word], at[has_word], np.searchsorted(starts, le)[has_word]
    key = tx.hash_runs(buf, ls, le) ^ tx.mix(lrow.astype(tx.U64) + tx.U64(1))
    order = np.argsort(key, kind="stable")
    later = np.zeros(len(key), bool)
    later[order[1:]] = key[order][1:] == key[order][:-1]
    sums = np.concatenate([[0], np.cumsum(chars)])
    line_chars = sums[past] - sums[at]
    out = {
        "n_words": n_words, "word_chars": word_chars, "n_symbols": n_symbols,
        "n_dup_lines": np.bincount(lrow[later], minlength=n),
        "dup_line_chars": np.bincount(lrow[later], weights=line_chars[later], minlength=n).astype(np.int64),
    }
    share = []
    for k in sorted({*NGRAM_LIMITS, BASE_N}):
        inside = covered(words, row, k)
        if k == BASE_N:
            out["n_repeat_words"] = per_row(inside)
        if k in NGRAM_LIMITS:
            share.append(per_row(chars * inside) / np.maximum(word_chars, 1))
    out["coverage"] = np.stack(share, 1)
    return out


def quality_rules(docs: DataFrame) -> DataFrame:
    """Per document the repetition statistics and the verdict ``kept``. docs: doc_id, text."""

    def rules(batch: pa.RecordBatch) -> list[pa.RecordBatch]:
        found = []
        for at, buf, offsets in tx.chunks(batch.column("text")):
            m = measure(buf, offsets)
            failed = (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > 30 * m["n_words"])
            chars = np.maximum(m["word_chars"], 1)
            limits = np.array([NGRAM_LIMITS[k] for k in sorted(NGRAM_LIMITS)])
            kept = ~failed & (m["coverage"] <= limits).all(1) & (m["dup_line_chars"] <= DUP_LINE_CHARS * chars) & (m["n_symbols"] <= SYMBOLS_PER_CHAR * chars)
            size, width = m["coverage"].shape
            coverage = pa.ListArray.from_arrays(pa.array(np.arange(0, size * width + 1, width), pa.int32()), pa.array(m["coverage"].ravel()))
            cols = [batch.column("doc_id").slice(at, size), *(pa.array(m[k], pa.int64()) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_chars")), coverage, pa.array(failed), pa.array(kept)]
            found.append(pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in SCHEMA.split(", ")]))
        return found

    return map_batches(docs.selectExpr("cast(doc_id as long) doc_id", "text"), rules, SCHEMA)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))
