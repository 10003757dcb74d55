"""The ten operators against brute force on small tables that hold nulls, empty and long texts, ties and repeats."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from doselab.llm import jaccard_join, license_scan, line_dedup, mixing, packing, quality_classifier, quality_rules, topk_search, toxicity, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SHAPE = "doc_id long, text string, lang string, source string, n_chars long, size long, score double, s long, rep long"


def table(spark, rows):
    """rows: doc_id, text, source; with columns whose names operators use themselves."""
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), 7, 0.1, 1, 2) for i, t, s in rows], SHAPE)


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(80)]
    text = lambda k: "\n".join(" ".join(rng.choice(vocab) for _ in range(k // 4 + 1)) for _ in range(4))
    rows = [(i, text(rng.choice([1, 8, 40, 120])), rng.choice(["a", "b", None])) for i in range(n)]
    base = text(160).split(" ")
    for i in range(12):
        w = list(base)
        w[rng.randrange(len(w))] = f"edit{i}"
        rows.append((100 + i, " ".join(w), "a"))
    shared = " ".join(rng.choice(vocab) for _ in range(60))
    rows += [(200 + i, f"{text(60)} {shared} {text(60)}", "b") for i in range(6)]
    rows += [(300, None, "a"), (301, "", "b"), (302, " \n\t ", None), (303, "one two", "a"), (304, "ONE  two", "b"), (305, "word " * 30000, "a"), (306, rows[0][1], "c"), (307, rows[0][1].upper(), "c"), (308, "x" * 70000, "c"), (309, "é ç ß ñ " * 9, "c")]
    return rows


ROWS = corpus()


def shingles(text):
    w = [x.translate({i: i + 32 for i in range(65, 91)}) for x in WORD.findall(text or "")]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_components(rows):
    sets, parent = {i: shingles(t) for i, t, *_ in rows}, {i: i for i, *_ in rows}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("crowd", [64, 3])
def test_jaccard_join(spark, monkeypatch, crowd):
    monkeypatch.setattr(jaccard_join, "CROWD", crowd)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_join(table(spark, ROWS)).collect()}
    assert got == brute_components(ROWS)


def test_jaccard_join_crowd(spark, monkeypatch):
    """A large group of near copies, some linked and some not, in blocks and rings smaller than the group."""
    for name, value in {"CROWD": 5, "BLOCK": 6, "BLOCK_SHINGLES": 500, "PER_TASK": 20, "PIVOTS": 2, "ROUNDS": 2, "CROWDED_ROWS": 10_000}.items():
        monkeypatch.setattr(jaccard_join, name, value)
    rng = random.Random(3)
    base = [f"w{k}" for k in range(100)]
    rows = []
    for i in range(120):
        w = list(base)
        for _ in range(rng.choice([1, 2, 3, 4, 6])):
            w[rng.randrange(100)] = f"e{rng.randrange(40)}"
        rows.append((i, " ".join(w), "a"))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_join(table(spark, rows)).collect()}
    want = brute_components(rows)
    assert got == want and 1 < len({c for _, c in want.values()}) < 120


def test_jaccard_join_links(spark, monkeypatch):
    """n_links is the number of other classes linked, in one block and in several."""
    for name, value in {"BLOCK": 6, "BLOCK_SHINGLES": 700, "PER_TASK": 10}.items():
        monkeypatch.setattr(jaccard_join, name, value)
    rng, rows = random.Random(4), [(500, "alone in the world with no one else", "a"), (501, None, "a")]
    for i in range(30):
        w = [f"w{k}" for k in range(100)]
        for _ in range(rng.choice([0, 1, 2, 3])):
            w[rng.randrange(100)] = f"e{rng.randrange(40)}"
        rows.append((i, " ".join(w), "a"))
    rows += [(600, rows[2][1], "b"), (601, "a b c d e f g h i j k l m n o p q r s t", "a"), (602, "a b c d e f g h i j k l m n o p q r s t u", "a")]
    classes = {frozenset(shingles(t)) for _, t, _ in rows} - {frozenset()}
    linked = {a: sum(a != b and 100 * len(a & b) >= 80 * len(a | b) for b in classes) for a in classes}
    want = {i: linked.get(frozenset(shingles(t)), 0) for i, t, _ in rows}
    assert {r.doc_id: r.n_links for r in jaccard_join.jaccard_join(table(spark, rows)).collect()} == want and max(want.values()) > 9


@pytest.mark.parametrize("most", [0, 10_000])
def test_jaccard_join_crowded_order(spark, monkeypatch, most):
    """Pairs of which one text is ordered over its whole set and the other by its reserve, in both forms of reordered()."""
    monkeypatch.setattr(jaccard_join, "CROWD", 3)
    monkeypatch.setattr(jaccard_join, "CROWDED_ROWS", most)
    rows, passage = [], [f"p{k}" for k in range(60)]
    for i in range(40):
        # The common passage, in one text shorter than in the other, makes only one of many pairs run out of reserve.
        own = [f"o{i}_{k}" for k in range(60)]
        rows += [(10 * i, " ".join(own + passage), "a"), (10 * i + 1, " ".join(own + passage[:52]), "a")]
    want = brute_components(rows)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_join(table(spark, rows)).collect()}
    assert got == want and len({c for _, c in want.values()}) == 40


def test_jaccard_join_empty(spark):
    assert jaccard_join.jaccard_join(table(spark, [])).count() == 0
    assert jaccard_join.jaccard_join(table(spark, [(1, None, "a"), (2, "", "a")])).count() == 2


def test_quality_rules(spark):
    got = {r.doc_id: r for r in quality_rules.quality_rules(table(spark, ROWS)).collect()}
    for i, text, _ in ROWS:
        w = WORD.findall(text or "")
        seen = {}
        for k in range(len(w) - 7):
            seen.setdefault(tuple(w[k : k + 8]), []).append(k)
        repeat = {j for ks in seen.values() if len(ks) > 1 for k in ks for j in range(k, k + 8)}
        lines = [x for x in (text or "").split("\n") if WORD.search(x)]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(lines) - len(set(lines)), len(repeat)), i
        assert r.base_failed == (len(w) < 20 or 100 * len(repeat) > 30 * len(w)) and not (r.base_failed and r.kept)
    assert quality_rules.quality_rules(table(spark, [])).count() == 0


def test_line_dedup(spark):
    rows = [(1, "same line here\nother\nsame line here", "a"), (2, "  SAME line HERE \nshort\nshort", "a"), (3, "short\nunique line 3", "b"), (4, None, "b"), (5, "", "b"), (6, "same line here", None), (None, "same line here", "a"), *[(i + 10, t, s) for i, t, s in ROWS]]
    keys, strip = {}, " \t\n\x0b\x0c\r"
    key = lambda x: x.strip(strip).translate({i: i + 32 for i in range(65, 91)})
    for i, t, _ in rows:
        if i is not None:
            for x in (t or "").split("\n"):
                if len(key(x)) >= 10:
                    keys.setdefault(key(x), set()).add(i)
    for batches in (4, 7):
        lost = {r.doc_id: list(r._lost) for r in line_dedup.drops(table(spark, rows).select("doc_id", "text"), batches).collect()}
        want = {i: [p for p, x in enumerate((t or "").split("\n")) if key(x) in keys and i != min(keys[key(x)])] for i, t, _ in rows if i is not None}
        assert lost == {i: p for i, p in want.items() if p}
    out = {r.doc_id: r.text for r in line_dedup.deduplicate_lines(table(spark, rows)).collect()}
    assert out[1] == rows[0][1] and out[2] == "short\nshort" and out[6] == "" and out[4] is None and out[None] == "same line here"
    assert line_dedup.deduplicate_lines(table(spark, [])).count() == 0


def test_mixing(spark):
    rows = [(i, t, s) for i, t, s in ROWS if len(t or "") < 60000] + [(i, "w " * (i % 9), "z") for i in range(1000, 1200)]
    docs = table(spark, rows).drop("size").withColumn("size", mixing.n_words(F.col("text")))
    got = mixing.mix_sizes(docs.select("doc_id", "source", "size")).collect()
    assert sorted((r.doc_id, r.taken) for r in got) == sorted((r.doc_id, r.taken) for r in mixing.mix_sizes(docs.select("doc_id", "source", "size").repartition(3)).collect())
    sizes = {i: len(WORD.findall(t or "")) for i, t, _ in rows}
    order = sorted({s for *_, s in rows}, key=lambda s: (s is None, s or ""))
    total = {s: sum(sizes[i] for i, _, x in rows if x == s) for s in order}
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    want, free, left = {}, set(order), 1.5 * sum(total.values())
    while free:
        level = left / sum(weight[s] for s in free)
        over = [s for s in free if weight[s] * level > 2 * total[s]]
        for s in over or free:
            want[s] = 2 * total[s] if over else weight[s] * level
        left -= sum(want[s] for s in over)
        free = free - set(over) if over else set()
    taken = dict.fromkeys(order, 0)
    source = {i: s for i, _, s in rows}
    for r in got:
        s = source[r.doc_id]
        taken[s] += r.taken
        assert r.size == sizes[r.doc_id] and r.source_size == total[s] and abs(r.target - want[s]) < 1e-6 * (1 + want[s]) and 0 <= r.taken <= 2 * r.size
    assert all(abs(taken[s] - want[s]) <= max(9, 0.02 * want[s]) or s != "z" for s in order)
    assert mixing.mix_sizes(docs.select("doc_id", "source", "size").limit(0)).count() == 0


def test_packing(spark):
    encoder = packing.public_encoder()
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(encoder.args[0])
    rows = [*ROWS, (400, "it's <|endoftext|> ok", "a"), (401, "日本語 and tabs\t\tx", "a"), (5, ROWS[5][1], "a")]
    got = packing.best_fit_packing(table(spark, rows), encoder).collect()
    by_doc, by_seq = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    for i, t, _ in rows:
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 0]
        cuts = [0, *range(len(ids) % 2048 or 2048, len(ids) + 1, 2048)] if len(ids) > 2048 else [0, len(ids)]
        want = {(p, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for p, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))}
        assert {(r.piece, r.start, r.length, r.ids_crc32) for r in by_doc[i]} == want, i
    for rs in by_seq.values():
        end = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == end
            end += r.length
        assert end <= 2048
    assert len(by_seq) <= -(-sum(r.length for r in got) // 2048) + 2
    assert packing.best_fit_packing(table(spark, []), encoder).count() == 0


def test_plan_packing():
    rng = np.random.default_rng(0)
    for n in (1, 50, 5000):
        sizes = np.minimum(2048, np.maximum(1, rng.lognormal(6, 1.2, n))).astype(int)
        want = {int(k): int(v) for k, v in zip(*np.unique(sizes, return_counts=True), strict=True)}
        found = {}
        plan = packing.plan_packing(want)
        for k, lengths in plan:
            assert sum(lengths) <= 2048
            for x in lengths:
                found[x] = found.get(x, 0) + k
        assert found == want and sum(k for k, _ in plan) <= 1.02 * sizes.sum() / 2048 + 2


def test_topk(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=16).astype("f4")]) for i in range(300)] + [(300 + i, [0.5] * 16) for i in range(20)] + [(400, None), (450, [1.0, None]), (500, [float("nan")] * 16), (550, [])]
    vectors = topk_search.integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    got = [tuple(r) for r in topk_search.top_k(vectors, vectors.where("vec_id % 50 = 0"), 5).orderBy("query_id", "rank").collect()]
    ok = {i: np.floor(256 * np.array(v, np.float64)).astype(np.int64) for i, v in rows if v and None not in v and np.isfinite(v).all()}
    want = []
    for q in sorted(i for i in ok if i % 50 == 0):
        best = sorted(((-int(ok[q] @ v), i) for i, v in ok.items() if i != q and len(v) == len(ok[q])))[:5]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert got == want
    assert topk_search.top_k(vectors.limit(0), vectors.limit(0)).count() == 0


def test_warc(spark):
    big = "<p>" + "x" * 1200
    rows = [(1, "http://www.a.com/b?z=1&a=2#f", big), (2, "https://b.org", big), (3, None, None), (4, "http://a.com/a b", "small"), (5, "http://c.net/\r\nX: y", "small"), (6, "http://a.com/b?a=2&z=1", big + "WARC/1.1\r\n\r\n é"), (7, "http://d.de", big), (7, "http://d.de", big)]
    index = warc.archive_pages(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("x")))
    got = index.collect()
    assert len(got) == len(rows)
    kept = {i: (t or "").encode() for i, _, t in rows}
    for r in got:
        assert (r.payload_bytes, r.payload_digest) == (len(kept[r.page_id]), hashlib.sha1(kept[r.page_id]).hexdigest())
        assert (r.record_type, r.refers_to) == (("revisit", 7) if r.page_id in (1, 2) else ("response", None))
    keys = [(r.urlkey, r.timestamp) for r in got]
    assert keys == sorted(keys) and ("com,a)/b?a=2&z=1", "20240101000001") in keys
    assert warc.archive_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_loser_tree():
    rng = random.Random(5)
    for k in (0, 1, 2, 5, 8, 13):
        runs = [sorted(((f"u{rng.randrange(9)}", str(rng.randrange(9)), rng.randrange(99), *[None] * 4, "a", j, 0, "r") for j in range(rng.randrange(7))), key=warc._order) for _ in range(k)]
        assert [warc._order(r) for r in warc.LoserTree([iter(r) for r in runs])] == sorted(warc._order(x) for r in runs for x in r)


def test_license(spark):
    rows = [(1, "x\nThis work is licensed under the GNU General Public License, version 3.", "a"), (2, "see CC BY-NC 4.0 cc by", "a"), (3, None, "a"), (4, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction", "a"), (5, "All Rights Reserved. all rights\nreserved", "b"), (6, "rights all reserved general public", "b"), *[(100 + i, t, s) for i, t, s in ROWS]]
    got = {r.doc_id: r for r in license_scan.license_scan(table(spark, rows)).collect()}
    assert (got[1].n_base, got[1].base_labels, got[1].labels, got[1].first_word) == (1, "gpl", "gpl,gpl-3.0", 8)
    assert (got[2].n_base, got[2].first_word, got[2].last_word, got[2].base_labels) == (2, 1, 6, "cc-by")
    assert (got[3].n_words, got[3].labels, got[3].first_word, got[3].score) == (0, "", None, 0.0)
    assert got[4].labels == "mit" and got[5].n_base == 2 and got[6].labels == ""
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    for i, t, _ in rows:
        assert got[i].n_words == len(pattern.findall((t or "").translate({i: i + 32 for i in range(65, 91)})))


def _labelled(spark, seed):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("etaoinsr") for _ in range(rng.randint(3, 8))) for _ in range(400)]
    bad = ["idiot", "scumbag", "moronic"]
    rows, labels = [], []
    for i in range(300):
        words = [rng.choice(vocab) for _ in range(rng.randint(30, 90))]
        toxic = int(i % 4 == 0)
        if toxic:
            for _ in range(3):
                words[rng.randrange(len(words))] = rng.choice(bad)
        poor = int(i % 5 == 0)
        rows.append((i, " ".join(w + ("###" if poor else "") for w in words), "a"))
        labels.append((i, 1 - poor, toxic))
    return rows, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality_classifier(spark):
    rows, labels = _labelled(spark, 1)
    docs = table(spark, [*rows, (900, None, "a"), (901, "", "a")])
    train = labels.where("doc_id % 3 <> 1").select("doc_id", F.col("quality").alias("label")).union(spark.createDataFrame([(5, None)], "doc_id long, label int"))
    got = {r.doc_id: r.score for r in quality_classifier.quality_classifier(docs, train).collect()}
    assert len(got) == 302 and all(0 <= s <= 1 for s in got.values())
    assert sum((got[i] >= 0.5) == (i % 5 > 0) for i in range(300) if i % 3 == 1) >= 98
    none = quality_classifier.quality_classifier(docs, train.limit(0)).select("score").distinct().collect()
    assert [r.score for r in none] == [0.5]


def test_toxicity(spark):
    rows, labels = _labelled(spark, 2)
    odd = [(900, None, "a"), (901, "", "a"), (902, "you are an idoit and a scumbg you moroniic id1ot", "a"), (903, "calm words only here", "a")]
    train = labels.where("doc_id % 5 <> 0").select("doc_id", F.col("toxic").alias("label"))
    got = {r.doc_id: r for r in toxicity.toxicity(table(spark, [*rows, *odd]), train).collect()}
    assert all((got[i].score >= 0.5) == (i % 4 == 0) for i in range(300) if i % 5 == 0)
    assert got[902].score >= 0.5 and got[902].hits >= 3 and got[900].score < 0.5 and got[901].score == got[900].score and got[903].score < 0.5
    assert toxicity.toxicity(table(spark, odd), train.limit(0)).select("score").distinct().count() == 1


def test_toxic_stems(spark):
    """A stem marks a text that holds two different words of it; one such word says nothing. Long and repeated texts count whole."""
    rng = random.Random(8)
    parts = ["ta", "re", "mi", "so", "lu", "ne"]
    word = lambda: "".join(rng.choice(parts) for _ in range(rng.randint(2, 4)))
    rows, labels = [], []
    for i in range(240):
        words = [word() for _ in range(60)]
        tails = rng.sample([a + b + c for a in parts for b in parts for c in parts], 3)
        for t in tails if i % 4 == 0 else tails[: i % 2]:
            words[rng.randrange(60)] = "gromut" + t
        rows.append((i, " ".join(words), "a"))
        labels.append((i, int(i % 4 == 0)))
    long = " ".join(word() for _ in range(60000))
    odd = [(900, f"{long} gromutmi {long} gromutsolu gromutrere", "a"), (901, long, "a"), (902, rows[0][1], "b"), (902, rows[0][1], "b")]
    labels = spark.createDataFrame(labels, "doc_id long, label int")
    train = labels.where("doc_id % 5 <> 0")
    got = toxicity.toxicity(table(spark, [*rows, *odd]), train).collect()
    score = {r.doc_id: r for r in got}
    assert len(got) == 244 and {r.score for r in got if r.doc_id == 902} == {score[0].score}
    # A text whose three words fell on each other's places may hold fewer than two.
    stems = {i: len(set(re.findall(r"gromut\w+", t))) for i, t, _ in rows}
    assert all((score[i].score >= 0.5) == (stems[i] > 1) for i in range(240) if i % 5 == 0)
    assert score[900].hits == 3 and score[901].hits == 0 and score[901].score < 0.5


def test_hits_by_hand():
    """Hits of words, misspellings and stems against a plain count."""
    rng = random.Random(9)
    auto = toxicity.Automaton([b"idiot", b"scum"], [b"moron"])
    auto.entries = [b"idiot", b"scum"]
    pool = ["idiot", "idoit", "scum", "scam", "moronic", "moronly", "moron", "fine", "words", "1d10t"]
    texts = [" ".join(rng.choice(pool) for _ in range(rng.randrange(9))) for _ in range(200)] + ["", "moronic moronic", "moronic moronly moronic"]
    joined = "".join(texts).encode()
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    x = toxicity.context_features(np.frombuffer(joined, np.uint8), offsets, auto)
    for t, row in zip(texts, np.expm1(x[:, :4]), strict=True):
        w = t.split()
        stem = {v for v in w if v.startswith("moron") and v != "moron"} | ({"moron"} & set(w))
        plain, wrong = sum(v in ("idiot", "scum") for v in w), sum(v in ("idoit", "1d10t") for v in w)
        assert np.allclose(row, [plain + toxicity.MISSPELT * wrong, wrong, sum(v in stem for v in w) if len(stem) > 1 else 0, 0]), t


def test_automaton_against_edit_distance():
    def distance(a, b):
        d = [[i + j if i * j == 0 else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
        return d[-1][-1]

    rng = random.Random(4)
    lexicon = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(5, 7))) for _ in range(6)})
    auto = toxicity.Automaton([w.encode() for w in lexicon], [])
    for _ in range(800):
        x = "".join(rng.choice("abc") for _ in range(rng.randint(1, 9)))
        data = np.frombuffer(x.encode(), np.uint8)
        entry, errors = auto.run(data, np.array([0]), np.array([len(data)]))
        best = min(distance(x, w) for w in lexicon)
        assert (entry[0] > 0) == (best <= 1) and (best > 1 or errors[0] == best), (x, lexicon)
