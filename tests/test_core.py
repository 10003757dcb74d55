"""Text functions, dose corpora, language models, evaluation, readers, runner, streams."""

import json
import math

import pytest
from pyspark.sql import functions as F

from doselab.functions import scalars as S
from doselab.functions import text as T
from doselab.operators import analysis, curves, dose, evaluation, lm, match
from doselab.plans.design import Design
from doselab.plans import runner
from doselab.sources import readers, writers

TOY = ["the cat sat on the mat", "the dog sat on the rug", "a cat ran in the park"]


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return row.select(column.alias("v")).first()["v"]


def test_text(spark):
    t = F.col("t")
    assert one(spark, T.word_tokens(t), t="It's THE dog's 2nd o''clock") == ["it's", "the", "dog's", "nd", "o", "clock"]
    assert one(spark, T.normalize_space(t), t=" a\u00a0b \n c ") == "a b c"
    assert sorted(one(spark, T.content_set(t), t="The cat and the other cat")) == ["cat", "other"]
    assert one(spark, T.content_list(t), t="The cat, (and) the cat!") == ["cat", "cat"]
    assert one(spark, T.content_list(t), t="`cat` (dog)`") == ["`cat`", "dog)`"]
    assert one(spark, T.feature(t, "Number"), t="Number=Plur|Person=3") == "Plur"
    assert one(spark, T.feature(t, "Case"), t="Number=Plur") is None


def test_scalars(spark):
    assert one(spark, S.dose_value(F.col("d"), F.lit(340)), d=" ALL ") == 340.0
    assert one(spark, S.dose_value(F.col("d"), F.lit(None)), d="all") is None
    assert one(spark, S.expected_count(F.col("d"), F.lit(10)), d="16") == 10
    assert one(spark, S.binomial_error(F.lit(0.5), F.lit(0))) == 0.0
    assert one(spark, S.hill(F.lit(0.0), F.lit(0.2), F.lit(0.9), F.lit(16.0), F.lit(50.0))) == 0.2
    assert abs(one(spark, S.hill(F.lit(16.0), F.lit(0.2), F.lit(0.9), F.lit(16.0), F.lit(2.0))) - 0.55) < 1e-12


def _corpus(spark):
    base = [(i, "d1" if i % 3 else "d2", f"row {i} " + "x " * (i % 7 + 2)) for i in range(60)]
    pool = [(1000 + i, "d1", "p " * (i % 9 + 1)) for i in range(25)]
    shape = "sent_id bigint, domain string, text string"
    n = T.space_count(F.col("text")).cast("bigint")
    return spark.createDataFrame(base, shape).withColumn("n", n), spark.createDataFrame(pool, shape).withColumn("n", n)


def test_dose_invariants(spark):
    base, pool = _corpus(spark)
    pos = base.where("sent_id % 2 = 0").withColumn("construction", F.lit("c"))
    cells = spark.createDataFrame([("c", d) for d in ("0", "4", "16", "all")], "construction string, dose string")
    kept = dose.keep_positives(pos, cells).cache()
    ids = {d: {r.sent_id for r in kept.where((F.col("dose") == d) & F.col("kept")).collect()} for d in ("0", "4", "16", "all")}
    assert [len(ids[d]) for d in ("0", "4", "16", "all")] == [0, 4, 16, 30]
    assert ids["4"] < ids["16"] < ids["all"]
    fast, plain = dose.match_filler(pos, pool), dose.match_filler_rows(pos, pool)
    key = lambda df: sorted(map(tuple, df.select("sent_id", "filler_id", "tier", "n_candidates").collect()))
    assert key(fast) == key(plain)
    unmatched = {r.sent_id for r in fast.where("filler_id is null").collect()}
    assert unmatched == {i for i in range(0, 60, 2) if i % 3 == 0}
    audit = {r.dose: r for r in dose.dose_audit(kept, fast).collect()}
    out = dose.dose_corpus(base, pool, dose.substitutions(kept, fast)).groupBy("dose").count().collect()
    for r in out:
        assert r["count"] == 60 - audit[r.dose].n_unmatched
    assert audit["0"].n_removed == 30 and audit["all"].n_removed == 0


def test_language_model(spark):
    counts = lm.ngram_counts(spark.createDataFrame([(t,) for t in TOY], "text string")).cache()
    items = spark.createDataFrame([(k, t) for k, t in enumerate(["the cat sat on the mat", "mat the on sat cat the", "zzz qqq"])], "k int, text string")
    s = {r.k: r.score for r in lm.ngram_scores(items, counts, "k").collect()}
    assert s[0] > s[1] and math.isfinite(s[2])
    rows = spark.createDataFrame([(t,) for t in TOY], "text string")
    signed = lm.signed_ngram_counts(counts, rows.where("text like 'a cat%'"), rows.limit(0))
    want = lm.ngram_counts(rows.where("text not like 'a cat%'"))
    assert sorted(map(tuple, signed.collect())) == sorted(map(tuple, want.collect()))


def test_audit_and_decision_edges(spark):
    rows = spark.createDataFrame([(1, "1"), (0, "1"), (0, "0"), (1, "")], "filter_label int, human_label string")
    r = evaluation.filter_report(rows).first()
    assert (r.recall, r.precision, r.n_skipped, r.passes) == (0.5, 1.0, 1, False)
    with pytest.raises(Exception, match="no labelled row"):
        evaluation.filter_report(rows.where("human_label = ''")).collect()
    with pytest.raises(Exception, match="dose-0"):
        analysis.indirect_evidence(spark.createDataFrame([("a", "4", 1, "a", 0.5)], "model_construction string, dose string, seed int, eval_construction string, accuracy double"), ["a"]).collect()


def test_curve_recovery():
    import numpy as np

    d = np.array([0, 4, 16, 64, 256.0])
    y = curves.hill_curve(d, np.array([0.25, 0.92, 16, 2]))
    p, cost = curves.fit_hill(d, y)
    assert cost < 1e-10 and np.allclose(p, [0.25, 0.92, 16, 2], rtol=1e-2)
    assert curves.fit_hill(d[:3], y[:3]) is None


def test_readers_and_writers(spark, tmp_path):
    (tmp_path / "switchboard.train.txt").write_text("B:\tYeah, right\n\n  \nmore\n")
    got = readers.scan_domain_text(spark, str(tmp_path)).orderBy("seq").select("domain", "text").collect()
    assert [tuple(r) for r in got] == [("switchboard", "B:\tYeah, right"), ("switchboard", "more")]
    writers.write_tagged(spark.createDataFrame([("s", "B:\tYeah, right", 1)], "domain string, text string, k int"), str(tmp_path / "out"), "k")
    assert [tuple(r) for r in readers.scan_tagged_lines(spark, str(tmp_path / "out")).collect()] == [("s", "B: Yeah, right")]
    ws = [(1, "a", "a", "DET", None, None, 2, "det"), (2, "cat", "cat", "NOUN", None, "Number=Sing", 0, "root")]
    table = spark.createDataFrame([(7, "d", "a cat", ws)], f"sent_id bigint, source_domain string, text string, words {match.WORDS_TYPE}")
    writers.write_conllu(table, str(tmp_path / "c"))
    back = readers.scan_conllu(spark, str(tmp_path / "c")).first()
    assert (back.sent_id, back.source_domain, back.text, back.word_count) == (7, "d", "a cat", 2)
    assert [tuple(x) for x in back.words] == ws
    (tmp_path / "m.conllu").write_text("# text = x\n1-2\tab\n1\ta\n1.1\te\n2\tb\n \t \n1\tz")
    rows = readers.scan_conllu(spark, str(tmp_path / "m.conllu")).orderBy("seq").collect()
    assert [(r.sent_id, r.source_domain, r.text, r.word_count) for r in rows] == [(-1, "unknown", "x", 2), (-1, "unknown", "", 1)]
    lines = spark.createDataFrame([('{"text": "", "sentence": "s"}',), ('"bare"',), ("plain {",), ("{bad",), ('{"x": 1}',)], "l string")
    assert [r.v for r in lines.select(readers.positive_text(F.col("l")).alias("v")).collect()] == ["s", "bare", "plain {", "{bad", None]
    res = spark.createDataFrame([("a", 1)], "k string, v int")
    for _ in range(2):
        writers.append_results(res, str(tmp_path / "r"), ["k"])
    assert spark.read.parquet(str(tmp_path / "r")).count() == 1


def test_design(spark):
    d = Design()
    assert d.cells(spark).count() == 21 and d.runs(spark).count() == 63 and d.ceiling("aann") == "full"
    assert d.curve_doses("aann") == [0, 4, 16, 64, "all"] and d.curve_doses("it_cleft") == [0, "all"]


def test_runner(tmp_path):
    def fail():
        raise ValueError("no")

    ran, step = [], runner.Step
    plan = {"c": step(lambda: ran.append("c"), needs=("b",)), "e": step(lambda: ran.append("e"), needs=("d",)), "a": step(lambda: ran.append("a")), "b": step(fail), "d": step(lambda: ran.append("d"), lambda: True)}
    out = runner.run(plan, tmp_path / "j")
    assert {k: v.state for k, v in out.items()} == {"a": "made", "b": "broken", "c": "waiting", "d": "present", "e": "made"}
    assert ran == ["a", "e"] and "ValueError: no" in out["b"].why and out["c"].why == "for b"
    assert runner.status_code(out) == 1 and runner.tally(out)["made"] == 2
    with open(tmp_path / "j", "a") as lines:
        lines.write('{"step": "a", "st')
    assert runner.read_journal(tmp_path / "j") == out
    assert runner.run(plan, again=["d"], only=["d", "e"])["d"].state == "made"
    assert runner.run(plan, only=["e"])["e"].state == "made" and runner.run(plan, only=["c"])["c"].state == "waiting"
    with pytest.raises(KeyError, match="zz"):
        runner.run({"a": step(fail, needs=("zz",))})
    with pytest.raises(ValueError, match="a, b"):
        runner.run({"a": step(fail, needs=("b",)), "b": step(fail, needs=("a",))})


def test_stream(spark, tmp_path):
    from doselab.streaming.incremental import read_sentences, stream_positives

    ws = [(1, "there", "there", "PRON", None, None, 2, "expl"), (2, "are", "be", "VERB", None, None, 0, "root"), (3, "cats", "cat", "NOUN", None, None, 2, "nsubj")]
    shape = f"sent_id bigint, text string, words {match.WORDS_TYPE}"
    spark.createDataFrame([(1, "there are cats", ws)], shape).write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        stream = read_sentences(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema)
        stream_positives(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert [r.construction for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["existential_there"]


def test_longer_ngrams_give_the_shorter_ones(spark):
    """Counts of all orders come from one count of the longest; each key's own with by-columns."""
    texts = spark.createDataFrame([(k % 2, t) for k, t in enumerate([*TOY, "", "it's", "a a a a a a"])], "k int, text string")
    for by in ([], ["k"]):
        counts = lm.ngram_counts(texts, *by)
        want = lm.grams(texts, *by).groupBy(*by, "o", "ctx", "w").agg(F.count("*").alias("c"))
        assert counts.columns == want.columns and sorted(map(tuple, counts.collect())) == sorted(map(tuple, want.collect()))
    assert "inline(" not in lm.ngram_counts(texts)._jdf.queryExecution().optimizedPlan().toString()


def test_scores_count_the_texts_once(spark):
    """The plan that scores reads counts, not texts."""
    texts = spark.createDataFrame([(t,) for t in TOY], "raw string").select(F.concat("raw", F.lit(" zqmarker")).alias("text"))
    out = lm.ngram_scores(spark.createDataFrame([(1, TOY[0])], "k int, text string"), lm.ngram_counts(texts), "k")
    assert "zqmarker" not in out._jdf.queryExecution().optimizedPlan().toString() and out.count() == 1
