"""Texts searched in Arrow batches: the same words, counts and hits as by expressions, and what no longer passes through these."""

import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from doselab.functions import text as T
from doselab.operators import dose, lm, sizes, tallies
from doselab.queries import core
from doselab.queries import views as V


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture(scope="module")
def lines(spark):
    """Random lines with all kinds of gaps, letters that fold to ASCII's, and runs of apostrophes."""
    draw = random.Random(5)
    words = "the The THE a A and is was Be to To er faster FASTER dogs dog running don't a'b'c'd 'tis x' it''s ſ İ K K é aé éa é 3the the_ 9s".split() + ["İs", "theKer", "thE", "oſ"]
    gaps = [" "] * 14 + ["  ", "\t", "\x0b", "\f", "\r", " ", " ", "-", "'", "", "."]
    rows = [(i, "".join(draw.choice(words) + draw.choice(gaps) for _ in range(draw.randint(1, 12)))) for i in range(6000)]
    rows += [(7000, "a"), (7001, " "), (7002, "the \x0bfaster"), (7003, "éthe faster"), (7004, "a b c d's"), (7005, "is so to Ka"), (7006, "and the İing"), (7007, "the fasteré")]
    return spark.createDataFrame(rows, "sent_id long, text string").withColumn("domain", F.lit("d")).repartition(4).cache()


def test_words_and_space_counts_of_bytes():
    draw = random.Random(1)
    for _ in range(1500):
        texts = ["".join(draw.choice("ab'' é\t\x0b9") for _ in range(draw.randint(0, 9))) for _ in range(draw.randint(0, 6))]
        array, texts = pa.array(texts, pa.string()).slice(1), texts[1:]  # a slice begins inside its buffers
        found, each = tallies.words(array)
        want = [re.findall(T.WORD, t) for t in texts]
        assert found.to_pylist() == [w for ws in want for w in ws] and each.tolist() == [len(ws) for ws in want]
        assert tallies.space_counts(array).tolist() == [len(re.findall(r"[^ \t\n\x0b\f\r]+", t)) for t in texts]


def test_sizes_of_lines(spark, lines):
    want = lines.select("sent_id", "domain", F.size(F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0))).alias("n"))
    got = tallies.sized(lines, "sent_id", "domain")
    assert got.schema.simpleString() == want.schema.simpleString() and got.exceptAll(want).count() == want.exceptAll(got).count() == 0


def test_words_of_lines_leave_in_batches(spark, lines):
    """All words and what is asked for, as by expressions; no text passes a regular expression on its way."""
    items = lm.grams(spark.createDataFrame([("the faster dogs",), ("don't a'b c'd K",)], "text string"))
    got = lm.asked_counts(lines, items)
    assert "regexp_extract_all" not in plan(got)
    sums = lambda df: {tuple(r[:-1]): r[-1] for r in df.groupBy("o", "ctx", "w").agg(F.sum("c").alias("c")).collect()}
    assert sums(got) == sums(lm.asked_counts(lines, items, limit=0))


def test_hits_among_candidates(spark, lines):
    """Candidates are more than the hits, hold all of them, and leave most lines out."""
    found = V.hits(lines)
    assert "filter(" not in plan(found)  # an interpreted lambda over four searches of every line
    want = None
    for c, p in V.PATTERNS.items():
        part = lines.where(F.regexp_like(F.lower("text"), F.lit(p))).select(F.lit(c).alias("construction"), "sent_id", "domain", "text", F.size(F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0))).alias("n"))
        want = part if want is None else want.unionByName(part)
    assert found.exceptAll(want).count() == want.exceptAll(found).count() == 0 and want.select("construction").distinct().count() == 4
    assert tallies.candidates(lines, V.HIT_NEEDED).where(~F.rlike("text", F.lit("[İſK]"))).count() < lines.count() / 2


def test_marks_drop_most_others_and_no_wanted_row(spark):
    rows, side = spark.range(20_000).withColumn("x", F.lit(1)), spark.range(0, 20_000, 10)
    met = sizes.marked(rows, side, "id")
    assert met.columns == ["id", "x"] and met.join(side, "id").count() == 2000 and met.count() < 6000
    assert sizes.marked(rows, side.limit(0), "id").count() == 0


def test_changes_move_few_texts_of_the_pool(spark, monkeypatch):
    """The pool's texts that no slot takes are left where they are read."""
    pool = spark.createDataFrame([(i, "d", f"pool {i}") for i in range(1000)], "sent_id long, domain string, text string")
    ranked = spark.createDataFrame([("c", i + 1, 5000 + i, "d", f"own {i}") for i in range(10)], "construction string, rank long, sent_id long, domain string, text string")
    fillers = spark.createDataFrame([(5000 + i, 37 * i if i % 3 else None) for i in range(10)], "sent_id long, filler_id long")
    moved, own = [], dose.marked
    monkeypatch.setattr(dose, "marked", lambda *a: moved.append(own(*a)) or moved[-1])
    got = {(r.rank, r.sent_id, r.text, r.sign) for r in dose.changes(ranked, fillers, pool).collect()}
    assert got == {(i + 1, 5000 + i, f"own {i}", -1) for i in range(10)} | {(i + 1, 37 * i, f"pool {37 * i}", 1) for i in range(10) if i % 3}
    assert len(moved) == 1 and moved[0].count() < 500


def test_pool_sizes_without_expressions(spark, tmp_path):
    spark.createDataFrame([(25, "two words\n\x0bone more line", "s"), (5, "base", "s")], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    pool = core._pool(spark, str(tmp_path))
    assert "regexp_extract_all" not in plan(pool) and sorted(r.n for r in pool.collect()) == [2, 3]
