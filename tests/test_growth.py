"""Steps that would grow faster than their input: results against plain Python, and where the plan does the work."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from doselab.functions import text as T
from doselab.operators import analysis, match
from doselab.queries import core, stats
from doselab.queries import views as V


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_surface_sizes_instances_once(spark):
    rows = [("a", 1, "the dog ran, dog!"), ("a", 2, "a quick dog"), ("a", 3, "the of"), ("a", 4, "—"), ("a", 5, "don't run 42 dogs"), ("b", 1, "the dog ran, dog!"), ("b", 1, "ran dog dog now"), ("c", 1, "...")]
    out = analysis.surface_predictability(spark.createDataFrame(rows, "construction string, sent_id long, text string"))
    assert r"(?U)\S+" not in plan(out).split("Generate explode")[0]  # the divisor is worked out below the generator
    got = {r.construction: r.surface for r in out.collect()}
    words = lambda t: re.findall(T.WORD, t.lower())
    size = lambda t: max(1, sum(x not in T.INSTANCE_STOPWORDS and x != "" for x in (y.strip(T.EDGE_MARKS) for y in t.lower().split())))
    assert set(got) == {"a", "b", "c"} and got["c"] == 0
    for c in "ab":
        counts = Counter(w for k, _, t in rows if k == c for w in words(t))
        sums = Counter()
        for k, i, t in rows:
            if k == c:
                sums[i, size(t)] += sum(math.log(counts[w] / counts.total()) for w in words(t))
        assert abs(got[c] - sum(v / n for (_, n), v in sums.items()) / len(sums)) < 1e-12


@pytest.fixture(scope="module")
def lines(spark):
    """Random lines full of what the predicates look for, with all kinds of gaps between the words."""
    draw = random.Random(7)
    words = "the The a an to is was are be be Be he it It they there There 3 42 more less , . ! lower er faster able ble tired running ing quickly ti forty dogs dog on person don't never not only no sooner until who that" .split()
    words += match.TOUGH[:4] + match.RAISING[:3] + ["believeing", "éer", "x_er", "the", ",", "is"]
    gaps = [" "] * 12 + ["  ", "\t", "-", "'", "", "\u00a0", " é ", "\""]
    rows = [(i, "".join(draw.choice(words) + draw.choice(gaps) for _ in range(draw.randint(1, 14)))) for i in range(12_000)]
    rows += [(20_000, "the faster it is, the more it can"), (20_001, "is easy to running"), (20_002, "it is he who"), (20_003, "never is he"), (20_004, ""), (20_005, "no sooner is he"), (20_006, "the éer it is, the more"), (20_007, "the x_er dog,the less")]
    return spark.createDataFrame(rows, "sent_id long, text string").repartition(4).cache()


@pytest.mark.parametrize("code", [*match.REGISTRY, "window"])
def test_candidates_hold_every_match(spark, lines, code):
    if code == "window":
        found = lambda rows: rows.select("sent_id", "text", match.window(F.col("words"), match.upos("DET"), match.upos("ADJ"), match.upos("NOUN")).alias("m")).where("m is not null")
    else:
        found = lambda rows: rows.select("sent_id", "text", match.get_predicate(code)(F.col("words"), F.col("text")).alias("m")).where("m.matched")
    every = {(r.sent_id, str(r.m)) for r in found(V.annotated(lines)).collect()}
    some = V.candidates(lines, code)
    assert {(r.sent_id, str(r.m)) for r in found(V.annotated(some)).collect()} == every
    assert some.count() < lines.count()
    assert every or code in ("aann", "subject_to_object_raising")  # the tagger's classes leave these few or none


def test_queries_annotate_candidates_only(spark, tmp_path):
    spark.createDataFrame([(1, "the faster cat", "s")], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("match_comparative_correlative", "match_tough_movement", "match_resultative", "kernel_window"):
        assert "RLIKE" in plan(core.QUERIES[name](spark, str(tmp_path)))
    assert "transform(" not in plan(core.feat_get(spark, str(tmp_path)))  # single words are compiled


def test_words_one_by_one(spark, lines):
    fields = ["id", "text", "lemma", "upos", "xpos", "feats", "head", "deprel"]
    whole = V.annotated(lines).select("sent_id", F.inline("words"))
    single = V.annotated_words(lines, "sent_id", *fields)
    assert whole.columns == single.columns == ["sent_id", *fields]
    assert whole.exceptAll(single).count() == single.exceptAll(whole).count() == 0


def test_feature(spark):
    rows = [("Number=Plur|Case=Nom", "Plur"), ("Case=Nom|Number=Sing", "Sing"), ("XNumber=Plur", None), ("Number=", None), ("Number", None), (None, None), ("_", None), ("Number=a=b", "a=b")]
    for r in spark.createDataFrame(rows, "feats string, want string").select("want", T.feature(F.col("feats"), "Number").alias("got")).collect():
        assert r.got == r.want


def test_audits_search_texts_once(spark, tmp_path, monkeypatch):
    """The audit's plan reads hits that are written; before, each of its readers searched all texts again."""
    rows = [(i, f"the faster cat {i}\nthe dog is ready to go" if i % 3 else "a quick dog runs", "web") for i in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    kept = core.keep_positives(spark, str(tmp_path))
    audit = stats.audit_json(spark, str(tmp_path))
    assert "RLIKE" not in plan(kept) and "RLIKE" not in plan(audit)
    assert plan(audit).count("from_json") + plan(audit).count("jsontostructs") <= 1 and "get_json_object" not in plan(audit)
    hits = {c: sum(bool(re.search(p, line)) for i, t, _ in rows if i // 20 % 2 == 0 for line in t.split("\n")) for c, p in V.PATTERNS.items()}
    got = {r.cell: (r.n_positive_total, r.n_kept) for r in audit.collect()}
    assert got == {f"{c}_dose-{d}": (n, n if d == "all" else min(int(d), n)) for c, n in hits.items() if n for d in core.DOSES}
