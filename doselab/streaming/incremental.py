"""The scan, match and append path as a stream: the same stateless predicates, exactly once per sentence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from doselab.operators.match import positives
from doselab.sources.writers import append_results


def stream_positives(sentences: DataFrame, out: str, checkpoint: str, codes: list[str] | None = None) -> StreamingQuery:
    """sentences: a streaming frame of sent_id, text, words. Each batch adds the hits that out does not hold yet."""

    def append(batch: DataFrame, _: int) -> None:
        append_results(positives(batch, codes), out, ["construction", "sent_id"])

    return sentences.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_sentences(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 8).parquet(path)
