"""Queries over a small folder of tables against plain Python: they do the whole job, on all rows and all cells."""

import math
import re
from collections import Counter

import pytest

from doselab.functions import text as T
from doselab.queries import core, stats
from doselab.queries import views as V


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    """Documents in all classes of doc_id that filters could pick, each with a word of its own."""
    top = tmp_path_factory.mktemp("sf")
    own = lambda i: "own" + "".join(chr(97 + int(d)) for d in str(i))
    rows = [(i, f"the {own(i)} and the running dog\n{own(i)} is ready to go" + ("\nthe faster cat ran" if i % 20 < 3 and i < 60 else ""), "en", "web", 40) for i in range(100)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame([(i, f"{own(7 * i)} zzz" if i % 2 else "zzz") for i in range(10)], "item_id long, text string").write.parquet(f"{top}/benchmark.parquet")
    return str(top)


def lines(sf, spark):
    """(doc_id, sent_id, text) of all records."""
    return [(r.doc_id, r.doc_id * V.LINES + k, t) for r in spark.read.parquet(f"{sf}/documents.parquet").collect() for k, t in enumerate(r.text.split("\n"))]


def test_every_cell_has_a_corpus(spark, sf):
    base = [x for x in lines(sf, spark) if x[0] // 20 % 2 == 0]
    total = {c: sum(bool(re.search(p, t)) for _, _, t in base) for c, p in V.PATTERNS.items()}
    assert 4 < total["the_comparative"] < 16
    got = {(r.construction, r.dose): r for r in core.dose_corpus(spark, sf).collect()}
    assert set(got) == {(c, d) for c in V.PATTERNS for d in core.DOSES}
    for (c, d), r in got.items():
        kept = total[c] if d == "all" else min(int(d), total[c])
        assert (r.n, r.replaced) == (len(base), total[c] - kept)
        if kept == total[c]:
            assert (r.ids, r.chars) == (sum(i % 1000003 for _, i, _ in base), sum(len(t) for *_, t in base))
    sane = {(r.construction, r.dose): r for r in core.dose_sanity(spark, sf).collect()}
    assert set(sane) == {(c, d) for c in V.PATTERNS for d in core.DOSES if total[c]}
    for (c, d), r in sane.items():
        kept = total[c] if d == "all" else min(int(d), total[c])
        assert r.expected == kept and (r.observed == kept and r["pass"] or kept < total[c])


def grams(texts):
    """{(o, ctx, w): count}."""
    counts = Counter()
    for t in texts:
        p = ["<s>"] * 3 + re.findall(r"[a-z]+(?:'[a-z]+)?", t.lower()) + ["</s>"]
        counts.update((o, tuple(p[k - o : k]), p[k]) for k in range(3, len(p)) for o in range(4))
    return counts


def test_models_are_fitted_on_all_documents(spark, sf):
    rows = lines(sf, spark)
    want = grams(t for *_, t in rows)
    got = {r.o: (r.kinds, r.n) for r in core.ngram_counts(spark, sf).collect()}
    assert got == {o: (sum(g[0] == o for g in want), sum(c for g, c in want.items() if g[0] == o)) for o in range(4)}
    assert core.vocab_size(spark, sf).first().vocab == sum(g[0] == 0 for g in want)
    changed = grams([t for _, i, t in rows if i % 7] + [t for _, i, t in rows if i % 7 == 1])
    got = {r.o: (r.kinds, r.n) for r in core.signed_counts(spark, sf).collect()}
    assert got == {o: (sum(g[0] == o for g in changed), sum(c for g, c in changed.items() if g[0] == o)) for o in range(4)}
    unigrams = {g[2]: c for g, c in want.items() if g[0] == 0}
    total, vocab = sum(unigrams.values()), len(unigrams)
    # "zzz" is in no sentence: its own position has the unigram floor alone, the end's has no context beyond it either.
    ends = [math.log(0.1 * (unigrams.get(w, 0) + 0.01) / (total + 0.01 * vocab)) for w in ("zzz", "</s>")]
    got = {r.item_id: r.score for r in core.ngram_cond_prob(spark, sf).where("side = 'good'").collect()}
    assert abs(got["b0"] - sum(ends) / 2) < 1e-5


def test_vocabulary_of_every_cell(spark, sf):
    """Items are looked up in the whole corpus of their own cell."""
    base = [x for x in lines(sf, spark) if x[0] // 20 % 2 == 0]
    words = {w for *_, t in base for w in re.findall(r"[a-z]+", t)}
    texts = {f"b{r.item_id}": r.text.split() for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    got = stats.seen_novel(spark, sf).where("item_id <> 'missing'").collect()
    assert {r.dose for r in got} == set(core.DOSES)
    assert {r.item_id: r.group for r in got if r.dose == "all"} == {i: "seen" if words & set(t) else "novel" for i, t in texts.items()}
    assert {r.group for r in got} == {"seen", "novel"}
    sizes = {(r.construction, r.dose): r.n_words for r in core.cell_vocab(spark, sf).collect()}
    assert {n for (_, d), n in sizes.items() if d == "all"} == {len(words - set(T.OVERLAP_STOPWORDS))}
    n = {}
    for r in stats.seen_novel_accuracy(spark, sf).where("dose = '4'").collect():
        n[r.group] = n.get(r.group, 0) + r.n
    assert sum(n.values()) == 10


def test_a_document_of_very_many_lines(spark, tmp_path):
    """Ids of lines stay apart, however many lines a document has."""
    rows = [(1, "\n".join(["x"] * 100_001), "en", "web", 1), (2, "the last word", "en", "web", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = V.records(spark, str(tmp_path))
    assert got.count() == 100_002 == got.select("sent_id").distinct().count()


def test_readers_and_statistics_see_all_documents(spark, sf):
    rows = lines(sf, spark)
    ids = sorted(i for _, i, _ in rows)
    for q in (core.conllu_header, core.conllu_token_count, core.scan_conllu_blocks):
        assert sorted(r.sent_id for r in q(spark, sf).select("sent_id").collect()) == ids
    assert core.conllu_words(spark, sf).count() == sum(len(re.findall(V.TOKEN, t)) for *_, t in rows)
    found = {c: [(i, t) for _, i, t in rows if re.search(p, t)] for c, p in V.PATTERNS.items()}
    got = {r.construction: (r.n, r.words) for r in core.find_positives(spark, sf).collect()}
    assert got == {c: (len(x), sum(len(t.split()) for _, t in x)) for c, x in found.items() if x}
    assert sorted(map(tuple, stats._instances(spark, sf).collect())) == sorted((c, i, t) for c, x in found.items() for i, t in x)
    # The statistics over these instances: the words of one construction by hand.
    words = [w for _, t in found["be_to"] for w in t.split() if w not in T.INSTANCE_STOPWORDS]
    got = {r.construction: r.productivity for r in stats.productivity(spark, sf).collect()}
    assert got["be_to"] == pytest.approx(len(set(words)) / len(words), abs=1e-7)
