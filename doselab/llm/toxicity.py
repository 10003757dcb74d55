"""Toxicity scores: Levenshtein automata intersected with a lexicon trie, read with their context windows.

The lexicon (words and word stems that mark toxic texts) is learnt from labelled training rows: a bounded sample,
``SAMPLE`` documents of each class in hash order. Its trie is intersected with the Levenshtein automaton of
distance one (with transpositions) over bytes; the product is determinised lazily and run over all distinct words
of a chunk at once. Each hit's context window tells quotation (quote marks, verbs of speech) from abuse; a
logistic model over the hits gives the score. Whole texts are scanned and there is no shuffle of them.

Defined results: null and empty texts have no hits and get the score of a text without hits; very long texts are
scanned whole; equal texts get equal scores; without labelled rows of both classes every score is the toxic share (0
without any); null labels are left out; labelled rows that tie for the sample are taken by hash and doc_id; repeated rows
each get a row; an empty table gives an empty result; extra columns of any name are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doselab.llm import textnp as tx
from doselab.llm.common import held_out, map_batches, materialise

#: Labelled documents of each class to learn from at most.
SAMPLE = 4000
#: Letters of the stems tried; the shortest word that a misspelling may stand for; words on each side of a hit.
STEMS, FUZZY_FROM, WINDOW = (4, 5, 6, 7), 5, 8
#: What a misspelt hit counts of a plain one.
MISSPELT = 0.75
#: How often a lexicon entry's documents are toxic, at least.
PRECISION = 0.97
#: Digits and signs read as letters.
LEET = dict(zip("013457", "oieast", strict=True))
QUOTING = ["said", "says", "wrote", "writes", "called", "calls", "quoted", "quote", "quotes", "word", "term", "dit", "sagte", "dijo"]

FOLD = np.arange(256, dtype=np.uint8)
FOLD[0x41:0x5B] += 0x20
for _d, _c in LEET.items():
    FOLD[ord(_d)] = ord(_c)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_QUOTE = np.zeros(256, bool)
_QUOTE[[0x22, 0x60]] = True
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SIZE = 6


class Automaton:
    """The lazily determinised product of a lexicon trie and the Levenshtein automaton of distance one.

    entries: {word: weight}; stems: {prefix: weight}, which accept every longer word. A state is a set of
    (trie node, errors, byte still owed by a transposition). run() gives for each word 0, or 1 + the index of the
    entry found with the fewest errors, and the errors.
    """

    DEAD = 0

    def __init__(self, entries: list[bytes], stems: list[bytes]):
        self.children: list[dict[int, int]] = [{}]
        self.end: list[int] = [0]
        self.stem: list[int] = [0]
        self.depth: list[int] = [0]
        for k, word in enumerate(entries):
            self.end[self._add(word)] = k + 1
        for k, word in enumerate(stems):
            self.stem[self._add(word)] = len(entries) + k + 1
        self.states: dict[frozenset, int] = {frozenset(): 0}
        self.sets = [frozenset()]
        self.table = np.zeros((64, 256), np.int32)
        self.table[1:] = -1
        self.found = np.zeros((64, 2), np.int32)
        self.start = self._state(self._close({(0, 0, -1)}))

    def _add(self, word: bytes) -> int:
        node = 0
        for c in word:
            if c not in self.children[node]:
                self.children[node][c] = len(self.children)
                self.children.append({})
                self.end.append(0)
                self.stem.append(0)
                self.depth.append(self.depth[node] + 1)
            node = self.children[node][c]
        return node

    def _close(self, states: set) -> frozenset:
        """With what follows without reading: a byte of the entry left out."""
        out = set(states)
        for v, e, owed in states:
            if e == 0 and owed < 0:
                out.update((u, 1, -1) for u in self.children[v].values())
        return frozenset(out)

    def _state(self, states: frozenset) -> int:
        if states not in self.states:
            k = self.states[states] = len(self.sets)
            self.sets.append(states)
            if k == len(self.table):
                self.table = np.concatenate([self.table, np.full_like(self.table, -1)])
                self.found = np.concatenate([self.found, np.zeros_like(self.found)])
            best = min(((e, -self.depth[v], self.end[v]) for v, e, owed in states if owed < 0 and self.end[v] and (e == 0 or self.depth[v] >= FUZZY_FROM)), default=None)
            stem = next((self.stem[v] for v, e, owed in states if e == 0 and owed < 0 and self.stem[v]), 0)
            if best and best[0] == 0 or best and not stem:
                self.found[k] = best[2], best[0]
            elif stem:
                self.found[k] = stem, 0
        return self.states[states]

    def _step(self, state: int, c: int) -> int:
        out = set()
        for v, e, owed in self.sets[state]:
            if owed >= 0:
                if owed == c:
                    out.add((v, 1, -1))
                continue
            if self.stem[v] and e == 0:
                out.add((v, 0, -1))
            child = self.children[v].get(c)
            if child is not None:
                out.add((child, e, -1))
            if e == 0:
                out.add((v, 1, -1))
                for b, u in self.children[v].items():
                    out.add((u, 1, -1))
                    if c in self.children[u] and b != c:
                        out.add((self.children[u][c], 1, b))
        return self._state(self._close(out))

    def run(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entry (0: none) and errors of each word."""
        state = np.full(len(starts), self.start, np.int32)
        alive, k = np.arange(len(starts)), 0
        while len(alive):
            alive = alive[(starts[alive] + k < ends[alive]) & (state[alive] != self.DEAD)]
            if not len(alive):
                break
            old, c = state[alive], buf[starts[alive] + k]
            new = self.table[old, c]
            unknown = np.flatnonzero(new < 0)
            if len(unknown):
                for pair in np.unique(old[unknown].astype(np.int64) * 256 + c[unknown]).tolist():
                    to = self._step(pair >> 8, pair & 255)
                    self.table[pair >> 8, pair & 255] = to
                new = self.table[old, c]
            state[alive] = new
            k += 1
        return self.found[state, 0], self.found[state, 1]


def _units(text: bytes) -> set[bytes]:
    """What a text may contribute to the lexicon: its words and, marked by a leading *, the stems of two or more of them.

    One word may begin with a stem by chance, where words are made of few syllables.
    """
    words = set(_WORD.findall(text.translate(_LOWER.tobytes())))
    stems = Counter(w[:n] for w in words for n in STEMS if len(w) > n)
    return {w for w in words if 3 <= len(w) <= 40} | {b"*" + u for u, n in stems.items() if n > 1}


def learn_lexicon(rows: DataFrame) -> tuple[list[bytes], list[bytes]]:
    """rows: text, label. Words and stems whose documents are toxic more often than chance allows."""

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        seen = (Counter(), Counter())
        for text, y in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
            seen[y].update(_units((text or "").encode()))
        # Only what a toxic text holds may enter; clean counts of others are not needed, but the batch can't know.
        keys = list(seen[0].keys() | seen[1].keys())
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array([seen[1][k] for k in keys], pa.int64()), pa.array([seen[0][k] for k in keys], pa.int64())], names=["unit", "toxic", "clean"])

    n = {r[0]: r[1] for r in rows.groupBy("label").count().collect()}
    if not n.get(0) or not n.get(1):
        return [], []
    counts = map_batches(rows.select("text", "label"), count, "unit binary, toxic long, clean long").groupBy("unit").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    share = n[1] / (n[0] + n[1])
    # Chance that all of a unit's documents are toxic, against as many units as there may be: share ** toxic * 1e6 < 0.01.
    least = max(3, math.ceil(8 * math.log(10) / -math.log(share)))
    rate = F.col("toxic") / n[1] / (F.col("toxic") / n[1] + F.col("clean") / n[0])
    # Units of the sample's toxic texts alone: bounded by SAMPLE.
    best = counts.where((F.col("toxic") >= F.least(F.lit(least), F.lit(max(3, n[1] // 4)))) & (rate >= PRECISION)).select("unit").collect()
    return _confirmed(rows, [bytes(r[0]) for r in best], least)


def _confirmed(rows: DataFrame, units: list[bytes], least: int) -> tuple[list[bytes], list[bytes]]:
    """Of the units those that toxic texts use in enough different contexts.

    Copies of one text repeat its words between the same neighbours and so count once. A stem must also begin
    enough different words, and gives way to a longer one that says as much.
    """
    words = {u for u in units if u[:1] != b"*"}
    stems = {u[1:] for u in units if u[:1] == b"*"}

    def contexts(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = set()
        for text, y in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
            all_words = _WORD.findall((text or "").encode().translate(_LOWER.tobytes()))
            for i, w in enumerate(all_words if y else []):
                around = b" ".join(all_words[max(0, i - 1) : i + 2])
                if w in words:
                    found.add((w, w, around))
                found.update((b"*" + w[:n], w, around) for n in STEMS if len(w) > n and w[:n] in stems)
        cols = list(zip(*found, strict=True)) or [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in cols], names=["unit", "word", "around"])

    seen = map_batches(rows.select("text", "label"), contexts, "unit binary, word binary, around binary").groupBy("unit").agg(F.countDistinct("around").alias("n"), F.countDistinct("word").alias("words")).collect()
    kept = {bytes(r[0]): r[1] for r in seen if r[1] >= least and (r[0][:1] != b"*" or r[2] >= least)}
    longest = {u[1:]: n for u, n in kept.items() if u[:1] == b"*"}
    longest = [u for u, n in longest.items() if not any(v != u and v.startswith(u) and m >= 0.7 * n for v, m in longest.items())]
    return sorted(u for u in kept if u[:1] != b"*"), sorted(longest)


def _repeated(row: np.ndarray, entry: np.ndarray, words: np.ndarray) -> np.ndarray:
    """For each hit, whether its row holds a second, different word that hits the same entry."""
    order = np.lexsort((words, entry, row))
    r, e, w = row[order], entry[order], words[order]
    new_group = np.ones(len(order), bool)
    new_group[1:] = (r[1:] != r[:-1]) | (e[1:] != e[:-1])
    new_word = new_group.copy()
    new_word[1:] |= w[1:] != w[:-1]
    group = np.cumsum(new_group) - 1
    out = np.zeros(len(order), bool)
    out[order] = np.bincount(group, weights=new_word)[group] > 1
    return out


def context_features(buf: np.ndarray, offsets: np.ndarray, automaton: Automaton) -> np.ndarray:
    """Per row: exact, misspelt and stem hits outside quotation, hits within it, share of words hit, densest window."""
    n = len(offsets) - 1
    starts, ends, first = tx.runs(buf, offsets, tx.ALNUM)
    words = tx.hash_runs(buf, starts, ends, tx.FOLDED)
    _, at, back = np.unique(words, return_index=True, return_inverse=True)
    lowered, leet = _LOWER[buf], FOLD[buf]
    entry, errors = automaton.run(lowered, starts[at], ends[at])
    digits = np.concatenate([[0], np.cumsum((lowered != leet))])
    redo = np.flatnonzero((entry == 0) & (digits[ends[at]] > digits[starts[at]]))
    if len(redo):
        found, wrong = automaton.run(leet, starts[at][redo], ends[at][redo])
        entry[redo], errors[redo] = found, np.where(found > 0, 1, wrong)
    entry, errors = entry[back], errors[back]
    row = np.repeat(np.arange(n), np.diff(first))
    hit = np.flatnonzero(entry > 0)
    # As in learning, a stem counts where two different words have it.
    hit = hit[(entry[hit] <= len(automaton.entries)) | _repeated(row[hit], entry[hit], words[hit])]
    quotes = np.concatenate([[0], np.cumsum(_QUOTE[buf])])
    speech = np.isin(words, _SPEECH)
    low, high = np.maximum(hit - WINDOW, first[row[hit]]), np.minimum(hit + WINDOW, first[row[hit] + 1] - 1)
    spoken = np.concatenate([[0], np.cumsum(speech)])
    inside = (quotes[starts[hit]] - quotes[starts[low]] > 0) & (quotes[ends[high]] - quotes[ends[hit]] > 0)
    quoted = inside | (spoken[high + 1] - spoken[low] > 0) & ((quotes[ends[high]] - quotes[starts[low]]) > 0)
    order = np.searchsorted(hit, hit + WINDOW, "right") - np.arange(len(hit))
    out = np.zeros((n, SIZE))
    stem = entry[hit] > len(automaton.entries)
    for k, flag in enumerate(((errors[hit] == 0) & ~stem & ~quoted, (errors[hit] > 0) & ~quoted, stem & ~quoted, quoted)):
        out[:, k] = np.bincount(row[hit[flag]], minlength=n)
    # A misspelt hit counts as most of a plain one, whether or not the labelled texts misspell.
    out[:, 0] += MISSPELT * out[:, 1]
    out[:, :4] = np.log1p(out[:, :4])
    out[:, 4] = np.sqrt(np.bincount(row[hit], minlength=n) / np.maximum(np.diff(first), 1))
    dense = np.zeros(n)
    np.maximum.at(dense, row[hit], order)
    out[:, 5] = np.log1p(dense)
    return out


_SPEECH = np.array([tx.text_hash(w, tx.FOLDED) for w in QUOTING], tx.U64)


def _fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Logistic regression by Newton steps; both classes weigh as many rows as they have."""
    x1 = np.concatenate([np.ones((len(x), 1)), x], 1)
    w = np.zeros(x1.shape[1])
    penalty = ridge * np.eye(len(w))
    penalty[0, 0] = 1e-3
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        step = np.linalg.solve(x1.T @ (x1 * (p * (1 - p))[:, None]) + penalty, x1.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, score, hits, quoted. docs: doc_id, text. labels: doc_id, label, the rows to learn from."""
    docs = docs.selectExpr("cast(doc_id as long) doc_id", "text")
    labels = labels.selectExpr("cast(doc_id as long) doc_id", "cast(label as int) label").where("doc_id is not null and label in (0, 1)")
    pick = None
    for y in (0, 1):
        part = labels.where(F.col("label") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
        pick = part if pick is None else pick.unionByName(part)
    # At most 2 * SAMPLE rows of a long and an int: bounded, so broadcast.
    rows = materialise(docs.join(F.broadcast(pick), "doc_id").select("text", "label"), "toxic-sample")
    entries, stems = learn_lexicon(rows)
    automaton = Automaton(entries, stems)
    automaton.entries = entries

    def each(batch: pa.RecordBatch) -> np.ndarray:
        found = [context_features(buf, offsets, automaton) for _, buf, offsets in tx.chunks(batch.column("text"))]
        return np.concatenate(found) if found else np.zeros((0, SIZE))

    def train(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = each(batch)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, SIZE), pa.int32()), pa.array(x.ravel()))
        return pa.RecordBatch.from_arrays([batch.column("label"), lists], names=["y", "x"])

    sample = map_batches(rows, train, "y int, x array<double>").collect()
    y, x = np.array([r[0] for r in sample], float), np.array([r[1] for r in sample]).reshape(-1, SIZE)
    weights = _fit(x, y) if len(set(y.tolist())) == 2 else None
    constant = float(y.mean()) if len(y) else 0.0

    def scored(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = each(batch)
        p = np.full(len(x), constant) if weights is None else 1 / (1 + np.exp(-np.clip(weights[0] + x @ weights[1:], -30, 30)))
        hits = np.expm1(x[:, :4])
        hits[:, 0] -= MISSPELT * hits[:, 1]
        hits = hits.round().astype(np.int64)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p), pa.array(hits.sum(1)), pa.array(hits[:, 3])], names=["doc_id", "score", "hits", "quoted"])

    return map_batches(docs, scored, "doc_id long, score double, hits long, quoted long")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    train = labels.where(~held_out(F.col("doc_id"), 5, 0)).select("doc_id", F.col("toxic").alias("label"))
    out = toxicity(docs, train)
    return out.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "hits", "quoted")
