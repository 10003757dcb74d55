"""The Jaccard join on tables too large to broadcast what a step asks for: only texts that are asked for are shuffled."""

from pyspark.sql import functions as F

from doselab.llm import jaccard_join as J


def test_marks_drop_most_others_and_no_wanted_row(spark):
    rows, side = spark.range(20_000).select(F.col("id").alias("rep")), spark.range(0, 20_000, 10).select(F.col("id").alias("rep"))
    met = J._marked(rows, F.xxhash64("rep"), side, F.xxhash64("rep"))
    assert met.columns == ["rep"] and met.join(side, "rep").count() == 2000 and met.count() < 6000
    assert J._marked(rows, F.xxhash64("rep"), side.limit(0), F.xxhash64("rep")).count() == 0


def test_shuffled_sets_give_the_same_links(spark, monkeypatch):
    text = lambda i: " ".join(f"w{(i // 3 * 131 + k) % 997}" for k in range(60))
    rows = [(i, text(i) + (f" x{i}" if i % 3 else "")) for i in range(240)] + [(999, ""), (1000, None), (None, text(3))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = lambda: sorted(map(str, J.jaccard_join(docs).select("doc_id", "n_shingles", "component_id", "class_id", "n_links").collect()))
    before = found()
    marked, own = [], J._marked
    monkeypatch.setattr(J, "TRIPS", 0)
    monkeypatch.setattr(J, "_marked", lambda *a: marked.append(1) or own(*a))
    assert found() == before and len(marked) > 1
