"""License scan over a positional rare-token index.

Every template's words are indexed with their positions and weighed by IDF, counted over all documents. A place where a
template stands has ``COVERAGE`` of its weight, so of the template's words of highest IDF that weigh more than the rest
may lack two must stand there: only these are posted. A file's licence words are looked up from the highest IDF
down; their postings, as file position minus template position, are intersected: places on which two of them agree up
to ``SLACK`` are verified, by the weight of the words found and by the mandatory key phrases. No place is missed by that.

Defined results: null and empty texts have no words, no labels and score 0; very long texts are scanned whole, window by
window; of templates of one label the best counts; repeated rows each get a row, a null doc_id stays null; an empty table
gives an empty result; extra columns of any name are ignored. There is no shuffle but of the vocabulary counts, whose
number the templates bound.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from doselab.llm import textnp as tx
from doselab.llm.common import map_batches

#: Fixed values of the contract: a phrase's words and its label.
BASE_PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: The public licences' own texts.
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify,
merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished
to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies
or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED,
INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT
SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT
OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
BSD_2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the
following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the
following disclaimer in the documentation and/or other materials provided with the distribution."""
BSD_3 = f"""{BSD_2} 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
products derived from this software without specific prior written permission."""
BSD_WARRANTY = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO
EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR
CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS;
OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING
NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE
AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO
EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING
FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN
CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for
any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including
commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this
software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product,
an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly
marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any
source distribution."""
#: Label, wording, mandatory key phrases: whole licences and the notices that files carry in their stead.
TEMPLATES = [
    ("apache-2.0", "licensed under the apache license version 2 0", ["apache license"]),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", ["apache org licenses"]),
    ("mit", "released under the mit license", ["mit license"]),
    ("mit", "licensed under the mit license", ["mit license"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ["permission is hereby granted free of charge", "without restriction"]),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", ["general public license version 3"]),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ["general public license", "free software foundation"]),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license", ["lesser general public license"]),
    ("agpl", "licensed under the gnu affero general public license", ["affero general public license"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["redistribution and use in source and binary forms"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["with or without fee is hereby granted"]),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["released into the public domain"]),
    ("cc-by", "licensed under cc by 4 0", ["cc by 4 0"]),
    ("cc-by-nc", "licensed under cc by nc 4 0", ["cc by nc"]),
    ("cc-by-sa", "licensed under cc by sa 4 0", ["cc by sa"]),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", ["creative commons attribution"]),
    ("reserved", "all rights reserved", ["all rights reserved"]),
    ("mit-full", MIT, ["permission is hereby granted free of charge", "the software is provided as is"]),
    ("bsd-2-clause", f"{BSD_2} {BSD_WARRANTY}", ["redistribution and use in source and binary forms", "redistributions in binary form must reproduce"]),
    ("bsd-3-clause", f"{BSD_3} {BSD_WARRANTY}", ["redistribution and use in source and binary forms", "endorse or promote products derived from this software"]),
    ("isc-full", ISC, ["with or without fee is hereby granted", "the software is provided as is"]),
    ("zlib", ZLIB, ["altered source versions must be plainly marked as such"]),
]
#: Words of slack in relative positions; weight share that must be found; words of a window, and places times words verified at once.
SLACK, COVERAGE, STEP, AT_ONCE = 2, 0.75, 1 << 18, 1 << 20
SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def _hashes(text: str) -> np.ndarray:
    return np.array([tx.text_hash(w, tx.FOLDED) for w in re.findall(r"[0-9a-z]+", text.lower())], tx.U64)


def phrase_starts(words: np.ndarray, phrase: np.ndarray) -> np.ndarray:
    """Where the phrase's words stand consecutively; across a whole chunk of rows, so callers drop row crossings."""
    k = len(phrase)
    if len(words) < k:
        return np.zeros(0, np.int64)
    at = np.flatnonzero(words[: len(words) - k + 1] == phrase[0])
    for i in range(1, k):
        at = at[words[at + i] == phrase[i]]
    return at


class Index:
    """The templates with their IDF weights; small and fixed, sent with the tasks.

    postings: word -> (template, position) where the word is one of those of which ``need[template]`` must stand at a place.
    """

    def __init__(self, frequency: dict[int, int] | None = None, n_docs: int = 0):
        self.base = [(label, _hashes(p)) for p, label in BASE_PHRASES.items()]
        self.templates = [(label, _hashes(text), [_hashes(p) for p in keys]) for label, text, keys in TEMPLATES]
        self.vocabulary = np.unique(np.concatenate([t for _, t, _ in self.templates]))
        counts = np.array([(frequency or {}).get(i, 0) for i in range(len(self.vocabulary))], float)
        self.idf = np.log((n_docs + 1) / (counts + 1)) + 1e-3
        self.weights, self.need, postings = [], [], {}
        for i, (_, words, _) in enumerate(self.templates):
            own = np.searchsorted(self.vocabulary, words)
            w = self.idf[own]
            self.weights.append(w)
            posted, two = 0.0, False
            for v in sorted({*own.tolist()}, key=lambda v: (-self.idf[v], v)):
                places = np.flatnonzero(own == v)
                posted += float(w[places].sum())
                postings.setdefault(v, []).extend((i, int(t)) for t in places)
                # Without one place of the highest weight the posted ones still outweigh what may be lacking. The margin is for rounding.
                if two := posted - w.max() > (1 - COVERAGE) * w.sum() * (1 + 1e-9):
                    break
            self.need.append(2 if two else 1)
        posted = np.array(sorted(postings), np.int64)
        self.anchors, self.anchor_idf = self.vocabulary[posted], self.idf[posted]
        self.postings = [postings[v] for v in posted.tolist()]
        self.longest = max(len(t) for _, t, _ in self.templates)

    def places(self, at: np.ndarray, anchor: np.ndarray) -> dict[int, np.ndarray]:
        """Template -> places on which enough of the file's rarest licence words agree. at, anchor: where which anchor stands."""
        order = np.argsort(anchor, kind="stable")
        held, first = np.unique(anchor[order], return_index=True)
        stands = np.split(at[order], first[1:])
        offsets: dict[int, list[np.ndarray]] = {}
        for k in np.lexsort((held, -self.anchor_idf[held])).tolist():
            for i, t in self.postings[held[k]]:
                offsets.setdefault(i, []).append(stands[k] - t)
        out = {}
        for i, lists in offsets.items():
            if len(lists) < self.need[i]:
                continue
            votes = np.sort(np.concatenate(lists))
            near = np.unique(np.concatenate([votes + d for d in range(-SLACK, SLACK + 1)]))
            agree = np.searchsorted(votes, near + SLACK, "right") - np.searchsorted(votes, near - SLACK)
            out[i] = near[agree >= self.need[i]]
        return out

    def verify(self, words: np.ndarray, i: int, places: np.ndarray) -> float:
        """The best share of the template's weight at places where all its key phrases stand; 0 if that is under ``COVERAGE``."""
        _, template, keys = self.templates[i]
        best, n = 0.0, len(template)
        for k in range(0, len(places), max(1, AT_ONCE // n)):
            o = places[k : k + max(1, AT_ONCE // n)]
            hit = np.zeros((len(o), n), bool)
            for d in range(-SLACK, SLACK + 1):
                p = o[:, None] + np.arange(n) + d
                hit |= (words[np.clip(p, 0, len(words) - 1)] == template) & (p >= 0) & (p < len(words))
            share = (hit * self.weights[i]).sum(1) / self.weights[i].sum()
            for x in np.flatnonzero(share >= COVERAGE).tolist():
                part = words[max(0, o[x] - SLACK) : max(0, o[x] + n + SLACK)]
                if share[x] > best and all(len(phrase_starts(part, key)) for key in keys):
                    best = float(share[x])
        return best

    def scan(self, words: np.ndarray, at: np.ndarray, anchor: np.ndarray) -> dict[str, float]:
        """Labels with their coverage. words: one file's; at, anchor: where which anchor stands, by place."""
        found: dict[str, float] = {}
        # Words that agree on a place stand within a template's length and slack, so in one window.
        for low in range(0, len(words), STEP):
            a, b = np.searchsorted(at, [low, low + STEP + self.longest + 2 * SLACK])
            for i, places in self.places(at[a:b], anchor[a:b]).items() if b > a else ():
                share = self.verify(words, i, places)
                if share:
                    found[self.templates[i][0]] = max(share, found.get(self.templates[i][0], 0.0))
        return found


def _frequencies(docs: DataFrame, index: Index) -> tuple[dict[int, int], int]:
    """Documents that hold each vocabulary word, and all documents."""

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        total = np.zeros(len(index.vocabulary) + 1, np.int64)
        total[-1] = batch.num_rows
        for _, buf, offsets in tx.chunks(batch.column("text")):
            starts, ends, first = tx.runs(buf, offsets, tx.ALNUM)
            words = tx.hash_runs(buf, starts, ends, tx.FOLDED)
            at = np.minimum(np.searchsorted(index.vocabulary, words), len(index.vocabulary) - 1)
            hit = index.vocabulary[at] == words
            row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))[hit]
            pairs = np.unique(row * len(index.vocabulary) + at[hit])
            total[:-1] += np.bincount(pairs % len(index.vocabulary), minlength=len(index.vocabulary))
        return pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(total)], names=["word", "n"])

    rows = map_batches(docs.select("text"), count, "word int, n long").groupBy("word").sum("n").collect()
    counts = {r[0]: r[1] for r in rows}
    return counts, counts.pop(len(index.vocabulary), 0)


def license_scan(docs: DataFrame) -> DataFrame:
    """Per document the places of the base phrases, labels and score. docs: doc_id, text.

    The score is the best coverage of a label's wording: 1 for a base phrase, a template's share of IDF weight, 0 without labels.
    """
    index = Index(*_frequencies(docs, Index()))

    def scan(batch: pa.RecordBatch) -> list[pa.RecordBatch]:
        out = []
        for row0, buf, offsets in tx.chunks(batch.column("text")):
            n = len(offsets) - 1
            starts, ends, first = tx.runs(buf, offsets, tx.ALNUM)
            words = tx.hash_runs(buf, starts, ends, tx.FOLDED)
            row = np.repeat(np.arange(n), np.diff(first))
            places, base = [[] for _ in range(n)], [set() for _ in range(n)]
            for label, phrase in index.base:
                at = phrase_starts(words, phrase)
                for p in at[row[at] == row[at + len(phrase) - 1]].tolist():
                    places[row[p]].append(p - int(first[row[p]]))
                    base[row[p]].add(label)
            # A base phrase stands there word for word: full coverage.
            labels, score = [set(b) for b in base], np.array([1.0 if b else 0.0 for b in base])
            slot = np.minimum(np.searchsorted(index.anchors, words), len(index.anchors) - 1)
            rare = np.flatnonzero(index.anchors[slot] == words)
            bound = np.searchsorted(rare, first)
            for i in np.flatnonzero(np.diff(bound)).tolist():
                at = rare[bound[i] : bound[i + 1]]
                found = index.scan(words[first[i] : first[i + 1]], at - first[i], slot[at])
                labels[i] |= found.keys()
                score[i] = max(score[i], *found.values()) if found else score[i]
            text = lambda sets: pa.array([",".join(sorted(s)) for s in sets], pa.string())
            cols = [batch.column("doc_id").slice(row0, n), pa.array(np.diff(first), pa.int64()), pa.array([len(p) for p in places], pa.int64()), pa.array([min(p) if p else None for p in places], pa.int64()), pa.array([max(p) if p else None for p in places], pa.int64()), text(base), text(labels), pa.array(np.minimum(score, 1.0))]
            out.append(pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in SCHEMA.split(", ")]))
        return out

    return map_batches(docs.selectExpr("cast(doc_id as long) doc_id", "text"), scan, SCHEMA)


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
