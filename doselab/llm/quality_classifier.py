"""Quality classifier: regularised quadratic discriminant analysis.

Each document becomes a vector of transformed statistics. Per class, count, mean and second moments are summed
over all labelled training rows; covariances are shrunk towards the pooled diagonal; a score is the logistic of
the difference of Mahalanobis log densities, from Cholesky factors that are computed once.

Defined results: null and empty texts have all-zero statistics and get a score like any other; very long texts are
measured whole; equal texts get equal scores; with no labelled training rows, or one class only, every score is that
class's share (0.5 without any); null labels and labels without doc_id are left out; repeated rows each get a row (and
count each in training), as do rows that share a doc_id; an empty table gives an empty result; extra columns of any name
are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doselab.llm import textnp as tx
from doselab.llm.common import held_out, map_batches, materialise
from doselab.llm.quality_rules import covered

#: Share of the pooled diagonal in each class covariance, and what is added to every variance.
SHRINKAGE, RIDGE = 0.1, 1e-4
FEATURES = ["words", "word_length", "symbols", "punctuation", "upper", "digits", "line_words", "duplicate_lines", "repeats_5", "repeats_8", "distinct", "commonest", "adjacent", "wide"]


def _class(*ranges: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, bool)
    for a, b in ranges:
        out[a : b + 1] = True
    return out


UPPER, DIGIT = _class((0x41, 0x5A)), _class((0x30, 0x39))
SYMBOL, PUNCTUATION = np.zeros(256, bool), np.zeros(256, bool)
SYMBOL[np.frombuffer(b"#*$%&|<>{}[]~^=+_\\@/", np.uint8)] = True
PUNCTUATION[np.frombuffer(b".,;:!?", np.uint8)] = True


def features(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of transformed statistics per text."""
    n = len(offsets) - 1
    starts, ends, first = tx.runs(buf, offsets, tx.NOT_SPACE)
    count = np.diff(first)
    row = np.repeat(np.arange(n), count)
    words = tx.hash_runs(buf, starts, ends, tx.FOLDED)
    size = np.bincount(row, weights=ends - starts, minlength=n)
    some, chars = np.maximum(count, 1), np.maximum(size, 1)
    of = lambda member: tx.counts_between(np.flatnonzero(member[buf]), offsets) / chars
    share = lambda flags, of: np.bincount(row[: len(flags)], weights=flags, minlength=n) / of
    # Words by row and value: distinct ones, the commonest one.
    key = words ^ tx.mix(row.astype(tx.U64) + tx.U64(1))
    order = np.argsort(key)
    head = np.ones(len(key), bool)
    head[1:] = key[order][1:] != key[order][:-1]
    group = np.flatnonzero(head)
    reps = np.diff(np.append(group, len(key)))
    owner = row[order][group]
    distinct = np.bincount(owner, minlength=n)
    commonest = np.zeros(n)
    np.maximum.at(commonest, owner, reps)
    same = np.zeros(len(words), bool)
    same[1:] = (words[1:] == words[:-1]) & (row[1:] == row[:-1])
    other = np.ones(256, bool)
    other[0x0A] = False
    ls, le, lf = tx.runs(buf, offsets, other)
    lrow = np.repeat(np.arange(n), np.diff(lf))
    lkey = tx.hash_runs(buf, ls, le) ^ tx.mix(lrow.astype(tx.U64) + tx.U64(1))
    lo = np.argsort(lkey)
    again = np.zeros(len(lkey), bool)
    again[lo[1:]] = lkey[lo][1:] == lkey[lo][:-1]
    lines = np.diff(lf)
    wide = np.bincount(row, weights=(ends - starts) > 24, minlength=n) / some
    out = np.stack([
        np.log1p(count), size / some, np.log(of(SYMBOL) + 0.01), np.log(of(PUNCTUATION) + 0.01), np.sqrt(of(UPPER)), np.sqrt(of(DIGIT)),
        np.log1p(count / np.maximum(lines, 1)), np.sqrt(np.bincount(lrow[again], minlength=n) / np.maximum(lines, 1)),
        np.sqrt(share(covered(words, row, 5), some)), np.sqrt(share(covered(words, row, 8), some)),
        np.log(distinct / some + 0.01) + 0.15 * np.log1p(count), np.log(commonest / some + 0.01), np.log(share(same, some) + 0.01), np.sqrt(wide),
    ], 1)
    return np.where(count[:, None] > 0, out, 0.0)


def feature_table(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash and x; written once, as training and scoring read it."""

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = [features(buf, offsets) for _, buf, offsets in tx.chunks(batch.column("text"))]
        x = np.concatenate(x) if x else np.zeros((0, len(FEATURES)))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.ravel()))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), lists], names=["doc_id", "text_hash", "x"])

    return map_batches(docs.selectExpr("cast(doc_id as long) doc_id", "xxhash64(text) text_hash", "text"), each, "doc_id long, text_hash long, x array<double>")


class Model:
    """Means, Cholesky factors and log constants of both classes."""

    def __init__(self, moments: dict[int, tuple[float, np.ndarray, np.ndarray]]):
        self.n = {c: moments.get(c, (0.0, None, None))[0] for c in (0, 1)}
        self.parts = {}
        if not min(self.n.values()):
            return
        cov = {c: m[2] / m[0] - np.outer(m[1], m[1]) / m[0] ** 2 for c, m in moments.items()}
        total = sum(self.n.values())
        pooled = np.diag(np.diag(sum(self.n[c] * cov[c] for c in cov)) / total)
        for c, (n, s, _) in moments.items():
            # Few rows lean on the pooled diagonal more.
            share = min(1.0, SHRINKAGE + len(FEATURES) / (n + len(FEATURES)))
            factor = np.linalg.cholesky((1 - share) * cov[c] + share * pooled + RIDGE * np.eye(len(s)))
            self.parts[c] = (s / n, np.linalg.inv(factor), -np.log(np.diag(factor)).sum() + np.log(n / total))

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.parts:
            total = sum(self.n.values())
            return np.full(len(x), self.n[1] / total if total else 0.5)
        density = {c: k - 0.5 * (((x - mean) @ inv.T) ** 2).sum(1) for c, (mean, inv, k) in self.parts.items()}
        return 1 / (1 + np.exp(-np.clip(density[1] - density[0], -500, 500)))


def fit(table: DataFrame, labels: DataFrame) -> Model:
    """labels: doc_id, label (0 or 1). Moments are summed on the executors; a few hundred numbers come back."""
    d = len(FEATURES)
    rows = table.join(labels.where("doc_id is not null and label in (0, 1)"), "doc_id").select("label", "x")

    def moments(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = np.asarray(batch.column("x").flatten()).reshape(-1, d)
        y = np.asarray(batch.column("label"))
        x1 = np.concatenate([np.ones((len(x), 1)), x], 1)
        sums = np.concatenate([(x1[y == c].T @ x1[y == c]).ravel() for c in (0, 1)])
        return pa.RecordBatch.from_arrays([pa.array(np.arange(len(sums)), pa.int32()), pa.array(sums)], names=["i", "v"])

    got = {r[0]: r[1] for r in map_batches(rows, moments, "i int, v double").groupBy("i").agg(F.sum("v")).collect()}
    flat = np.array([got.get(i, 0.0) for i in range(2 * (d + 1) ** 2)]).reshape(2, d + 1, d + 1)
    return Model({c: (m[0, 0], m[0, 1:], m[1:, 1:]) for c, m in enumerate(flat) if m[0, 0] > 0})


def score(table: DataFrame, model: Model) -> DataFrame:
    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = np.asarray(batch.column("x").flatten()).reshape(-1, len(FEATURES))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(model.score(x))], names=["doc_id", "text_hash", "score"])

    return map_batches(table, each, "doc_id long, text_hash long, score double")


def quality_classifier(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text_hash, score of every row. docs: doc_id, text. labels: doc_id, label, the rows to learn from."""
    table = materialise(feature_table(docs), "features")
    return score(table, fit(table, labels.selectExpr("cast(doc_id as long) doc_id", "cast(label as int) label")))


def good_documents(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of docs whose score is least or more, all columns as they are; texts are scored where they are read, and not shuffled."""
    table = materialise(feature_table(docs), "features")
    model = fit(table, labels.selectExpr("cast(doc_id as long) doc_id", "cast(label as int) label"))
    names = docs.columns
    places = [f"_{k}" for k in range(len(names))]
    at = places[names.index("text")]

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = [features(buf, offsets) for _, buf, offsets in tx.chunks(batch.column(at))]
        return batch.filter(pa.array(model.score(np.concatenate(x)) >= least)) if x else batch

    # Columns travel under numbers: extra ones may have any name.
    numbered = docs.toDF(*places)
    return map_batches(numbered, each, ", ".join(f"{p} {t}" for p, t in numbered.dtypes)).toDF(*names)


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    train = labels.where(~held_out(F.col("doc_id"), 3, 1)).select("doc_id", F.col("quality").alias("label"))
    out = quality_classifier(docs, train)
    return out.select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
