"""What queries leave on disk: how often rows are shuffled, and what is kept of corpora that were read back."""

from pyspark.sql import functions as F

from doselab.operators import dose, lm
from doselab.queries import core
from doselab.sources import artefacts


def exchanges(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_signed_counts_shuffle_no_more_than_counts(spark, tmp_path):
    """Before, the counts of all sentences were shuffled again to meet their changes."""
    rows = [(i, f"the dog {i % 5} ran and the cat sat\nit's the dog {i % 3}", "web") for i in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    assert exchanges(core.signed_counts(spark, str(tmp_path))) == exchanges(core.ngram_counts(spark, str(tmp_path)))


def test_changed_counts_are_signed_counts(spark):
    """One aggregate over signs gives what counts with their changes give, down to n-grams that vanish and sentences without words."""
    base = [("a b c d",), ("a b c d",), ("b c d e f",), ("x",), ("",)]
    removed, added = [("a b c d",), ("x",)], [("b c d e f",), ("g a b",)]
    frame = lambda rows: spark.createDataFrame(rows, "text string")
    want = lm.signed_ngram_counts(lm.ngram_counts(frame(base)), frame(removed), frame(added))
    signed = frame(base + added).withColumn("sign", F.lit(1)).union(frame(removed).withColumn("sign", F.lit(-1)))
    got = lm.changed_ngram_counts(signed)
    key = lambda df: sorted(tuple(r) for r in df.select("o", "ctx", "w", "c").collect())
    assert key(got) == key(want) and ("x",) not in {r[2:3] for r in key(got)}


def test_shared_slots_give_every_cell_its_corpus(spark, tmp_path):
    """Same blocks at the same places as from rows copied to cells, dropped slots and a cell without changes included; files are
    compressed, and a range's file of a cell is in order."""
    shape = "sent_id long, domain string, text string"
    base = spark.createDataFrame([(3 * i, f"d{i % 3}", f"own text {i}") for i in range(300)], shape)
    pool = spark.createDataFrame([(5000 + i, f"d{i % 2}", f"filler number {i}") for i in range(90)], shape)
    subs = [("a", d, 3 * i, None if i % 3 == 2 else 5000 + i % 90) for d in ("0", "4") for i in range(0, 300, 4) if d == "0" or i > 90] + [("b", "0", 3 * i, 5001 + i % 90) for i in range(0, 300, 5)]
    subs = spark.createDataFrame(subs, "construction string, dose string, slot_id long, filler_id long")
    cells = spark.createDataFrame([("a", "0"), ("a", "4"), ("b", "0"), ("b", "all")], "construction string, dose string")
    rows = dose.dose_corpus(base, pool, subs, cells).withColumnRenamed("domain", "source_domain")
    artefacts.write_cell_corpora(rows, f"{tmp_path}/rows")
    name = artefacts.cell_name(F.col("construction"), F.col("dose"))
    artefacts.write_slotted_corpora(dose.slotted(base, pool, subs, name), [r[0] for r in cells.select(name).collect()], f"{tmp_path}/slots")
    read = lambda p: sorted(tuple(r) for r in artefacts.read_cell_corpora(spark, f"{tmp_path}/{p}").select("cell", "pos", "block").collect())
    want = read("rows")
    assert read("slots") == want and {w[0] for w in want} == {"a_dose-0", "a_dose-4", "b_dose-0", "b_dose-all"} and len(want) < 1200
    assert not list(tmp_path.glob("slots/corpora/*/*.txt")) and len(list(tmp_path.glob("slots/corpora/*/*.txt.gz"))) >= 4


def test_corpora_are_not_copied_before_they_are_written(spark, tmp_path, monkeypatch):
    """Before, all cells' rows were written as a table and their files were plain text."""
    texts = [(i, f"the faster dog {i} and the cat sat\nis ready to go {i}", "web") for i in range(80)]
    spark.createDataFrame(texts, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(core, "scratch_path", lambda *_: f"{tmp_path}/corpora")
    got = {r.cell: r.n for r in core.cell_corpora(spark, str(tmp_path)).collect()}
    assert len(got) == 21 and set(got.values()) == {80}
    assert list(tmp_path.glob("corpora/corpora/*/*.gz")) and not list(tmp_path.glob("corpora/corpora/*/*.txt"))
