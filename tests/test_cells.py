"""Many corpora as one base and signed changes: every cell must equal what its own corpus gives when it is built."""

import random
import re

import pytest
from pyspark.sql import functions as F

from doselab.functions import special
from doselab.functions import text as T
from doselab.operators import dose, evaluation, lm

DOSES = ("0", "2", "5", "all")


@pytest.fixture(scope="module")
def corpora(spark):
    pick = random.Random(4)
    words = [f"w{chr(97 + i)}" for i in range(12)] + ["hit", "the", "it's"]
    text = lambda n: " ".join(pick.choice(words) for _ in range(n))
    shape = "sent_id bigint, domain string, text string"
    base = [(3 * i, f"d{i % 4}", text(pick.randint(1, 9)) + (" hit" if i % 3 == 0 else "")) for i in range(60)]
    pool = [(1000 + 7 * i, f"d{i % 3}", text(pick.randint(1, 12))) for i in range(80)]
    base, pool = (spark.createDataFrame(x, shape).withColumn("n", T.space_count(F.col("text"))).cache() for x in (base, pool))
    rules = {"a": "%hit", "b": "%wa%", "none": "%zzz%"}
    positives = None
    for c, p in rules.items():
        part = base.where(F.col("text").like(p)).withColumn("construction", F.lit(c))
        positives = part if positives is None else positives.unionByName(part)
    positives = positives.cache()
    cells = spark.createDataFrame([(c, d) for c in rules for d in DOSES], "construction string, dose string")
    fillers = dose.match_filler(positives.select("sent_id", "domain", "n").distinct(), pool).cache()
    changed = dose.changes(dose.ladder(positives), fillers, pool).cache()
    built = dose.dose_corpus(base, pool, dose.substitutions(dose.keep_positives(positives, cells), fillers), cells).cache()
    return base, pool, positives, cells, fillers, changed, built


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_totals_of_cells(corpora):
    base, _, positives, cells, _, changed, built = corpora
    sums = {"n": F.lit(1), "chars": F.length("text"), "replaced": (F.col("slot_id") != F.col("sent_id")).cast("int")}
    want = built.groupBy("construction", "dose").agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    assert rows(dose.corpus_totals(base, changed, cells, sums)) == rows(want)
    assert built.where("slot_id <> sent_id").count() > 0 and want.where("n < 60").count() > 0  # slots of domain d3 have no filler
    hit = F.when(F.col("construction") == "a", F.col("text").like("%hit")).when(F.col("construction") == "b", F.col("text").like("%wa%")).otherwise(F.lit(False))
    want = {(c, d): 0 for c, d in rows(cells)} | {(r.construction, r.dose): r["count"] for r in built.where(hit).groupBy("construction", "dose").count().collect()}
    assert {(r.construction, r.dose): r.observed for r in dose.observed_hits(positives, changed, cells, hit).collect()} == want


def test_models_of_cells(spark, corpora):
    base, _, _, cells, _, changed, built = corpora
    items = spark.createDataFrame([(1, "a", "wa wb hit", "hit wb wa"), (2, "a", "the wc wd we", "we wd"), (3, "b", "zzz wa", "wa"), (4, "b", "it's the wa wa", "")], "item_id int, construction string, good_sentence string, bad_sentence string")
    sides = items.select(F.struct("item_id", F.lit("good").alias("side")).alias("k"), F.col("good_sentence").alias("text")).union(items.select(F.struct("item_id", F.lit("bad").alias("side")), "bad_sentence"))
    got = {(r.construction, r.dose, r.item_id, r.side): r.score for r in lm.cell_scores(sides, base, changed, cells, "k").select("construction", "dose", "k.*", "score").collect()}
    assert len(got) == 12 * 8
    correct = {}
    for c, d in rows(cells):
        counts = lm.ngram_counts(built.where((F.col("construction") == c) & (F.col("dose") == d)))
        scores = {(r.item_id, r.side): r.score for r in lm.ngram_scores(sides, counts, "k").select("k.*", "score").collect()}
        assert scores.keys() == {k[2:] for k in got if k[:2] == (c, d)}
        assert all(abs(got[c, d, *k] - v) < 1e-9 for k, v in scores.items())
        correct[c, d] = [scores[i, "good"] > scores[i, "bad"] + 1e-9 for i in (1, 2, 3, 4)]
    table = lm.cell_accuracy(items, base, changed, cells, [42, 43]).collect()
    assert len(table) == 12 * 2 * 2
    for r in table:
        want = sum(correct[r.model_construction, r.dose][:2] if r.eval_construction == "a" else correct[r.model_construction, r.dose][2:])
        assert (r.n_pairs, r.n_correct, r.accuracy) == (2, want, want / 2)


def test_vocabularies_of_cells(spark, corpora):
    base, _, _, cells, _, changed, built = corpora
    want = {}
    for r in built.collect():
        want.setdefault((r.construction, r.dose), set()).update(w for w in re.findall(r"[a-z]+(?:'[a-z]+)?", r.text) if w not in T.OVERLAP_STOPWORDS)
    words, moved = evaluation.cell_vocab(base, changed, cells)
    assert {(r.construction, r.dose): r.vocab for r in lm.cell_sizes(words, moved, cells).collect()} == {k: len(v) for k, v in want.items()}
    items = [(c, d, i, s) for c, d in rows(cells) for i, s in enumerate(["wa the", "hit", "zzz", "the", "", "wb wc"])] + [("other", "0", 9, "wa")]
    got = evaluation.seen_novel_cells(spark.createDataFrame(items, "construction string, dose string, item_id int, sentence string"), base, changed, cells).collect()
    assert {(r.construction, r.dose, r.item_id): r.group for r in got} == {(c, d, i): "seen" if want.get((c, d), set()) & set(s.split()) else "novel" for c, d, i, s in items}
    assert {r.group for r in got} == {"seen", "novel"}


@pytest.mark.parametrize("pick", ["hash", "near"])
def test_fillers_by_index(spark, monkeypatch, pick):
    """Chunks of a few rows, one domain with most rows, equal lengths, domains without a pool."""
    monkeypatch.setattr(dose, "CHUNK_BITS", 2)
    draw = random.Random(9)
    pool = [(draw.randrange(10**15), "big" if i % 5 else f"d{i % 3}", draw.choice([1, 2, 3, 3, 3, 8, 9, 10, 11, 40])) for i in range(400)]
    slots = [(i, draw.choice(["big", "d0", "d1", "d2", "gone"]), draw.choice([1, 2, 5, 9, 10, 20, 35, 90])) for i in range(300)]
    shape = "sent_id bigint, domain string, n int"
    pool, slots = spark.createDataFrame(pool, shape).repartition(3), spark.createDataFrame(slots, shape)
    got = dose.match_filler(slots, pool, pick)
    if pick == "hash":
        key = ["sent_id", "filler_id", "tier", "n_candidates"]
        assert rows(got.select(*key)) == rows(dose.match_filler_rows(slots, pool).select(*key))
    else:
        best = {}
        for d, n, i in pool.select("domain", "n", "sent_id").collect():
            best.setdefault(d, []).append((n, i))
        for r in slots.join(got, "sent_id").collect():
            assert r.filler_id == min(((abs(n - r.n), i) for n, i in best.get(r.domain, [])), default=(0, None))[1]
    assert dose.match_filler(slots, pool.limit(0), pick).where("filler_id is not null").count() == 0


def test_special_functions(spark):
    """Against values from tables and from identities: I_x(a, 1) = x^a, symmetry, I_1/2(a, a) = 1/2, Student's t."""
    cases = [(2.0, 1.0, 0.3, 0.09), (5.5, 1.0, 0.7, 0.7**5.5), (3.0, 3.0, 0.5, 0.5), (400.0, 400.0, 0.5, 0.5), (0.5, 0.5, 0.25, 1 / 3), (2.0, 3.0, 0.4, 0.5248), (1.0, 4.0, 0.2, 1 - 0.8**4), (2.0, 2.0, 0.0, 0.0), (2.0, 2.0, 1.0, 1.0)]
    got = spark.createDataFrame(cases, "a double, b double, x double, want double").select("want", special.beta_inc(F.col("a"), F.col("b"), F.col("x")).alias("v"), special.beta_inc(F.col("b"), F.col("a"), 1 - F.col("x")).alias("w")).collect()
    assert all(abs(r.v - r.want) < 1e-12 and abs(r.w - (1 - r.want)) < 1e-12 for r in got)
    # r = 0.632 with 10 pairs and r = 0.9877 with 4 are the tabled 5 % and (0.01229) values.
    p = spark.createDataFrame([(0.6319, 10), (-0.6319, 10), (0.0, 5), (1.0, 5), (0.5, 2), (0.3, 10000)], "r double, n int").select(special.correlation_p(F.col("r"), F.col("n")).alias("p")).collect()
    assert abs(p[0].p - 0.05) < 1e-4 and p[0].p == p[1].p and abs(p[2].p - 1) < 1e-12 and p[3].p == 0 and p[4].p is None and 0 <= p[5].p < 1e-200
    whole = spark.range(1, 8).select(special.log_gamma(F.col("id")).alias("v")).collect()
    assert all(abs(r.v - v) < 1e-12 for r, v in zip(whole, [0, 0, 0.693147180559945, 1.791759469228055, 3.178053830347946, 4.787491742782046, 6.579251212010101]))


PLAIN = {"texts": ["wa wb wc", "", None, "wb wa wb wa zz", "it's the wa wa 9", "<s> wa"] + [f"wa x{chr(97 + i)}" for i in range(20)], "items": ["wa wb wc wd", "", "wa wa"]}


def _counted(text, asked=None):
    """(o, ctx, w) of a text's positions and (o, ctx, None) of the contexts before them; those that asked holds, and all words."""
    p = ["<s>"] * 3 + re.findall(r"[a-z]+(?:'[a-z]+)?", text.lower()) + ["</s>"]
    out = [(o, " ".join(p[i - o : i]), w) for i in range(3, len(p)) for o in range(4) for w in ([p[i], None] if o else [p[i]])]
    return [g for g in out if asked is None or g[0] == 0 or g in asked]


@pytest.mark.parametrize("limit", [200_000, 0])
def test_counts_of_what_is_asked(spark, limit):
    """By the items' index and by joins: the same counts as a plain count, by the columns asked for."""
    asked = {g for t in PLAIN["items"] for g in _counted(t)}
    want = {}
    for i, t in enumerate(PLAIN["texts"]):
        for g in _counted(t, asked) if t is not None else ():
            want[i % 2, *g] = want.get((i % 2, *g), 0) + 1
    texts = spark.createDataFrame([(i % 2, t) for i, t in enumerate(PLAIN["texts"])], "side int, text string").repartition(3)
    items = lm.grams(spark.createDataFrame([(t,) for t in PLAIN["items"]], "text string"))
    sums = lambda df, *by: {tuple(r[:-1]): r[-1] for r in df.groupBy(*by, "o", "ctx", "w").agg(F.sum("c").alias("c")).collect()}
    assert sums(lm.asked_counts(texts, items, "side", limit=limit), "side") == want
    both = {}
    for (_, *g), c in want.items():
        both[tuple(g)] = both.get(tuple(g), 0) + c
    assert sums(lm.asked_counts(texts, items, limit=limit)) == both
    # No item at all, no text at all.
    assert {g[0] for g in sums(lm.asked_counts(texts, items.limit(0), limit=limit))} == {0}
    assert sums(lm.asked_counts(texts.limit(0), items, limit=limit)) == {}


def test_cells_keep_only_what_is_asked(spark, corpora, monkeypatch):
    """What else follows an item's context is part of its total and no row of its own: tables grow with items and words."""
    base, _, _, cells, _, changed, _ = corpora
    kept = {}

    def seen(df, name):
        kept[name] = df.cache()
        return kept[name]

    monkeypatch.setattr(lm, "written", seen)
    items = spark.createDataFrame([(1, "wa the")], "k int, text string")
    lm.cell_scores(items, base, changed, cells, "k").collect()
    asked = {g for g in _counted("wa the") if g[0]}
    for name in ("known", "moved"):
        got = {(r.o, r.ctx, r.w) for r in kept[name].where("o > 0").select("o", "ctx", "w").distinct().collect()}
        assert got and got <= asked, name


def test_scores_copy_only_asked_words_to_cells(spark, corpora, monkeypatch):
    """Changed words that no item holds count for a cell's size only; scores by joins are those by the index."""
    base, _, _, cells, _, changed, _ = corpora
    kept, counted = {}, lm.asked_counts

    def seen(df, name):
        kept[name] = df.cache()
        return kept[name]

    items = spark.createDataFrame([(1, "wa the"), (2, "wb wb hit zzz")], "k int, text string")
    few = cells.where("dose in ('2', 'all')")
    scores = lambda: {tuple(r[:3]): r.score for r in lm.cell_scores(items, base, changed, few, "k").collect()}
    monkeypatch.setattr(lm, "written", seen)
    got = scores()
    assert {r.w for r in kept["moved"].where("o = 0").select("w").distinct().collect()} <= {"wa", "the", "wb", "hit", "zzz", "</s>"}
    monkeypatch.setattr(lm, "asked_counts", lambda *a: counted(*a, limit=0))
    want = scores()
    assert got.keys() == want.keys() and len(got) == 12 and all(abs(got[k] - v) < 1e-12 for k, v in want.items())
