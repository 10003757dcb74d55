"""Running totals in the order of a whole-numbered key, without a window over the whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Keys in a span: totals run over spans first, then inside each.
SPAN = 4096


def totals(rows: DataFrame, key: str, value: str, name: str, descending: bool = False, span: int = SPAN) -> DataFrame:
    """rows with name: the sum of value over all rows that come before by key. Keys are whole numbers, each once.

    Only sums of spans of keys (one row for up to span keys) are in one window; rows meet in windows of one span.
    """
    order = (lambda c: F.desc(c)) if descending else (lambda c: F.asc(c))
    dealt = rows.withColumn("_span", F.expr(f"`{key}` div {span}"))
    sums = dealt.groupBy("_span").agg(F.sum(value).alias("_sum"))
    before = sums.select("_span", (F.sum("_sum").over(W.orderBy(order("_span"))) - F.col("_sum")).alias("_before"))
    inside = F.sum(value).over(W.partitionBy("_span").orderBy(order(key))) - F.col(value)
    return dealt.withColumn("_inside", inside).join(before, "_span").withColumn(name, F.col("_before") + F.col("_inside")).drop("_span", "_before", "_inside")
