"""Rows that share ids, nulls, ties and clashing names; and the operators whose fields SQL can't express, by brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from doselab.llm import jaccard_join, license_scan, line_dedup, packing, quality_classifier, quality_rules, topk_search, warc
from tests.llm.test_operators import ROWS, WORD, _labelled, shingles, table

CLASH = "doc_id long, text string, lang string, source string, n_chars long, _lost int, _own int, _doc int, row int, _copies int, _rows int, _k int, _d int, component long, text_hash long"
A = "a b c d e f g h i j k l m n o p q r s t u v w"
B = " ".join("z" + x for x in A.split())


def clashing(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), *range(10)) for i, t, s in rows], CLASH)


def test_jaccard_rows(spark):
    rows = [(1, A, "a"), (1, B, "a"), (2, A + " x", "a"), (3, B + " y", "a"), (None, A + " q", "b"), (None, "no one else has these words", "b"), (None, None, "b"), (7, "", None), (7, A, "b"), (8, A, "c"), (8, A, "c")]
    sets = [shingles(t) for _, t, _ in rows]
    linked = lambda x, y: bool(sets[x]) and 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y])
    group = list(range(len(rows)))
    for _ in rows:
        group = [min([group[x], *(group[y] for y in range(len(rows)) if linked(x, y))]) for x in range(len(rows))]
    want = []
    for x, (i, t, _) in enumerate(rows):
        ids = [rows[y][0] for y in range(len(rows)) if group[y] == group[x] and rows[y][0] is not None]
        want.append((i, len(sets[x]), min(ids, default=None), len({frozenset(sets[y]) for y in range(len(rows)) if linked(x, y)} - {frozenset(sets[x])})))
    got = [(r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in jaccard_join.jaccard_join(clashing(spark, rows)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    kept = [(r.doc_id, r.text) for r in jaccard_join.deduplicate(clashing(spark, rows)).collect()]
    assert sorted(kept, key=str) == sorted([(1, A), (1, B), (None, "no one else has these words"), (None, None), (7, "")], key=str)


def test_line_rows(spark):
    rows = [(1, "shared line of text\nfirst", "a"), (2, "unique payload of row b\nrest", "a"), (2, "SHARED line of text \nunique payload of row c", "a"), (2, "unique payload of row b\nrest", "a"), (3, "unique payload of row b", "b"), (None, "shared line of text", "b"), (4, None, "b"), (5, "", None)]
    want = sorted([(1, rows[0][1]), (2, rows[1][1]), (2, "unique payload of row c"), (2, rows[1][1]), (3, ""), (None, "shared line of text"), (4, None), (5, "")], key=str)
    out = line_dedup.deduplicate_lines(clashing(spark, rows))
    assert out.columns == clashing(spark, []).columns and sorted([(r.doc_id, r.text) for r in out.collect()], key=str) == want


def test_warc_rows(spark, monkeypatch):
    """Rows that share a page_id and differ; runs joined in several levels; ranges cut inside one URL."""
    monkeypatch.setattr(warc, "FAN_IN", 2)
    monkeypatch.setattr(warc, "GROUP", 3)
    big, other = "<p>" + "x" * 1200, "<q>" + "y" * 1200
    rows = [(1, "http://a.com", big), (1, "http://a.com", other), (2, "http://a.com", big), (3, "http://b.com", other), (3, "http://b.com", "z" * 1500), (None, "http://c.com", big), (None, None, None), *[(10 + i, "http://hot.com/x", f"page {i}") for i in range(40)]]
    got = warc.archive_pages(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(7)).collect()
    last = {}
    for i, _, t in rows:
        if i is not None:
            last[t] = max(last.get(t, i), i)
    want = []
    for i, _, t in rows:
        data, keep = (t or "").encode(), last.get(t)
        to = keep if i is not None and len(data) >= 1000 and i < keep else None
        want.append((i, len(data), hashlib.sha1(data).hexdigest(), "response" if to is None else "revisit", to))
    assert sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got], key=str) == sorted(want, key=str)
    keys = [(r.urlkey, r.timestamp) for r in got]
    assert keys == sorted(keys)


def test_topk_grid(spark, monkeypatch):
    """Many small blocks over a grid of tasks, vectors of very different lengths, cutoffs that prune."""
    for name, value in {"BLOCK": 16, "QUERY_BLOCK": 3, "PILOTS": 1, "BROADCAST_BYTES": 0, "PER_TASK": 2}.items():
        monkeypatch.setattr(topk_search, name, value)
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=8) * 4.0 ** (i % 3)]) for i in range(150)]
    vectors = topk_search.integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = [tuple(r) for r in topk_search.top_k(vectors, vectors.where("vec_id % 10 = 0"), 5).orderBy("query_id", "rank").collect()]
    ok = {i: np.floor(256 * np.array(v)).astype(np.int64) for i, v in rows}
    want = [(q, k + 1, i, -s) for q in range(0, 150, 10) for k, (s, i) in enumerate(sorted((-int(ok[q] @ v), i) for i, v in ok.items() if i != q)[:5])]
    assert got == want


def test_quality_rules_fields(spark):
    """Symbols, lines, coverage and verdict of every text."""
    for r in quality_rules.quality_rules(table(spark, ROWS)).collect():
        text = next(t for i, t, _ in ROWS if i == r.doc_id) or ""
        words, chars = WORD.findall(text), sum(map(len, WORD.findall(text)))
        seen, again = set(), 0
        for line in text.split("\n"):
            if WORD.search(line):
                again += sum(map(len, WORD.findall(line))) if line in seen else 0
                seen.add(line)
        share = []
        for n in sorted(quality_rules.NGRAM_LIMITS):
            at = {}
            for k in range(len(words) - n + 1):
                at.setdefault(tuple(words[k : k + n]), []).append(k)
            inside = {j for ks in at.values() if len(ks) > 1 for k in ks for j in range(k, k + n)}
            share.append(sum(len(words[j]) for j in inside) / max(1, chars))
        assert (r.n_symbols, r.dup_line_chars) == (len(re.findall(r"[#*$%&|<>]", text)), again) and np.allclose(r.coverage, share)
        kept = not r.base_failed and all(s <= quality_rules.NGRAM_LIMITS[n] for s, n in zip(share, sorted(quality_rules.NGRAM_LIMITS), strict=True)) and again <= 0.3 * max(1, chars) and r.n_symbols <= 0.1 * max(1, chars)
        assert r.kept == kept


def test_license_fields(spark):
    """Base places, base labels and the score's bounds; labels hold the base ones."""
    rows = [(1, "CC  by-cc BY, all rights\nRESERVED cc", "a"), (2, "general public license General-Public License", "a"), (3, "see CC BY here", "a"), *[(100 + i, t, s) for i, t, s in ROWS]]
    for r in license_scan.license_scan(clashing(spark, rows)).collect():
        text = next(t for i, t, _ in rows if i == r.doc_id) or ""
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate({i: i + 32 for i in range(65, 91)}))
        places = [(k, label) for p, label in license_scan.BASE_PHRASES.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        first, last = (min(k for k, _ in places), max(k for k, _ in places)) if places else (None, None)
        base = sorted({label for _, label in places})
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(w), len(places), first, last, ",".join(base))
        assert set(base) <= set(r.labels.split(",")) | {""} and (r.score == 1.0 if base else 0 <= r.score <= 1) and (r.score > 0) == bool(r.labels)


def test_license_places_by_brute_force():
    """Labels and shares against every place of every template, in texts made of licences with words changed, lost and added."""
    rng = random.Random(12)
    index = license_scan.Index({i: rng.choice([0, 1, 5, 40, 90]) for i in range(len(license_scan.Index().vocabulary))}, 100)
    filler = [w for _, t, _ in license_scan.TEMPLATES for w in re.findall("[0-9a-z]+", t.lower())] + ["other", "words"] * 20
    hits = 0
    for _ in range(25):
        words = [rng.choice(filler) for _ in range(rng.randrange(30))]
        for _ in range(rng.randrange(3)):
            notice = re.findall("[0-9a-z]+", rng.choice(license_scan.TEMPLATES)[1].lower())
            for _ in range(rng.randrange(1 + len(notice) // 5)):
                k = rng.randrange(len(notice))
                notice[k : k + rng.randrange(2)] = [rng.choice(filler)] * rng.randrange(2)
            words += notice + [rng.choice(filler) for _ in range(rng.randrange(9))]
        file = license_scan._hashes(" ".join(words))
        slot = np.minimum(np.searchsorted(index.anchors, file), len(index.anchors) - 1)
        at = np.flatnonzero(index.anchors[slot] == file)
        want = {}
        for (label, template, keys), weight in zip(index.templates, index.weights, strict=True):
            for o in range(-len(template) - 2, len(file) + 2):
                part = file[max(0, o - 2) : max(0, o + len(template) + 2)].tolist()
                hit = [any(0 <= o + k + d < len(file) and file[o + k + d] == w for d in range(-2, 3)) for k, w in enumerate(template)] if set(part) & set(template.tolist()) else [False]
                share = float(weight[np.array(hit)].sum() / weight.sum()) if len(hit) == len(template) else 0.0
                if share >= license_scan.COVERAGE and all(any(part[j : j + len(k)] == k.tolist() for j in range(len(part))) for k in keys):
                    want[label] = max(want.get(label, 0.0), share)
        got = index.scan(file, at, slot[at])
        assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-12 for x in want), words
        hits += len(want)
    assert hits > 10


def test_license_windows(monkeypatch):
    """Windows change nothing, wherever their borders fall."""
    index = license_scan.Index({}, 50)
    file = license_scan._hashes("some words " * 9 + license_scan.MIT + " and more " * 9 + "all rights reserved" + " license" * 500 + license_scan.ZLIB)
    slot = np.minimum(np.searchsorted(index.anchors, file), len(index.anchors) - 1)
    at = np.flatnonzero(index.anchors[slot] == file)
    whole = index.scan(file, at, slot[at])
    assert {"mit", "mit-full", "reserved", "zlib"} <= whole.keys()
    for step in (90, 300):
        monkeypatch.setattr(license_scan, "STEP", step)
        monkeypatch.setattr(license_scan, "AT_ONCE", 50 * step)
        assert index.scan(file, at, slot[at]) == whole


def test_quality_by_formula(spark):
    """Scores against the log densities written out with plain matrix algebra."""
    rows, labels = _labelled(spark, 5)
    train = labels.where("doc_id % 3 <> 1").select("doc_id", F.col("quality").alias("label"))
    docs = table(spark, rows)
    x = {r.doc_id: np.array(r.x) for r in quality_classifier.feature_table(docs).collect()}
    y = {r.doc_id: r.label for r in train.collect()}
    d, parts = len(quality_classifier.FEATURES), {c: np.array([x[i] for i in y if y[i] == c]) for c in (0, 1)}
    pooled = np.diag(sum(len(p) * p.var(0) for p in parts.values()) / len(y))
    density = {}
    for c, p in parts.items():
        share = min(1.0, quality_classifier.SHRINKAGE + d / (len(p) + d))
        cov = (1 - share) * np.cov(p.T, bias=True) + share * pooled + quality_classifier.RIDGE * np.eye(d)
        density[c] = {i: np.log(len(p) / len(y)) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * (v - p.mean(0)) @ np.linalg.solve(cov, v - p.mean(0)) for i, v in x.items()}
    for r in quality_classifier.quality_classifier(docs, train).collect():
        assert abs(r.score - 1 / (1 + np.exp(np.clip(density[0][r.doc_id] - density[1][r.doc_id], -500, 500)))) < 1e-6


def test_packing_many_salts(spark, monkeypatch):
    monkeypatch.setattr(packing, "PER_SALT", 3)
    out = packing.best_fit_packing(table(spark, ROWS), packing.public_encoder(), 256).collect()
    assert len({(r.sequence_id, r.offset) for r in out}) == len(out) and len({(r.doc_id, r.piece) for r in out}) == len(out)
    by = {}
    for r in sorted(out, key=lambda r: (r.sequence_id, r.offset)):
        assert by.get(r.sequence_id, 0) == r.offset
        by[r.sequence_id] = r.offset + r.length
    assert max(by.values()) <= 256


def test_stages_with_odd_rows(spark, tmp_path):
    """Nulls in every column, ties, repeated and conflicting rows, clashing names: all stages decide rows by their own text."""
    rows, labels = _labelled(spark, 3)
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    rows = rows[:60] + [(None, rows[2][1], None), (None, None, None), (2, rows[5][1], "a"), (900, "", "b"), (900, None, None), rows[7], rows[7]]
    docs = clashing(spark, rows)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, str(tmp_path))
        assert after.columns == docs.columns, name
        texts = {(r.doc_id, r.text) for r in after.collect()}
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
        if name == "quality classifier":
            good = {zlib.crc32((t or "").encode()) for i, t, _ in rows[:60] if i % 5}
            assert all((zlib.crc32((t or "").encode()) in good) == ((i, t) in texts) for i, t, _ in rows if t)
        if name == "n-gram Jaccard join":
            assert (None, rows[2][1]) not in texts and (2, rows[2][1]) in texts and (None, None) in texts
    assert corpus_pipeline.packing_stage(spark, docs, str(tmp_path)).where("piece = 0").count() == len(rows)
