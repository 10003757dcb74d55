"""The pipeline's stages on a small folder, each against brute force on its own input."""

from pyspark.sql import functions as F

import corpus_pipeline
from doselab.llm import common, queries
from doselab.llm.quality_classifier import quality_classifier
from tests.llm.test_operators import _labelled, brute_components, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark, tmp_path):
    rows, labels = _labelled(spark, 3)
    rows += [(1000 + i, t + " extra", "b") for i, t, _ in rows[:20]]
    docs = table(spark, rows).select(*COLUMNS)
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    before, kept = docs, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = common.materialise(stage(spark, before, str(tmp_path)), "t")
        assert after.columns == COLUMNS and after.dtypes == docs.dtypes
        kept.append((name, before, after))
        before = after
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    _, first, second = kept[0]
    train = labels.where(~common.held_out(F.col("doc_id"), 3, 1)).select("doc_id", F.col("quality").alias("label"))
    assert ids(second) == ids(quality_classifier(first, train).where("score >= 0.5"))
    assert ids(kept[1][1]) == ids(kept[1][2])
    texts = [(r.doc_id, r.text) for r in kept[2][1].collect()]
    assert ids(kept[2][2]) == sorted(i for i, (_, c) in brute_components(texts).items() if i == c) and len(ids(kept[2][2])) < len(texts)
    counts = {r.doc_id: r["count"] for r in kept[3][2].groupBy("doc_id").count().collect()}
    assert max(counts.values()) <= 2
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id: r.n for r in out.where("piece = 0").groupBy("doc_id").agg(F.count("*").alias("n")).collect()} == counts


def test_registered():
    assert [q.split("_")[0] for q in sorted(queries.queries(), key=lambda q: int(q[2:].split("_")[0]))] == [f"op{n}" for n in range(1, 14)]
    assert set(queries.oracle_sql()) <= set(queries.queries())
