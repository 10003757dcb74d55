"""Mixing sources to target weights by entropy balancing.

Documents of one source get rates r = 2 / (1 + exp(-lambda * size)): of all rates between 0 and 2 whose expected
words meet the source's target these keep the most entropy (exponential tilting with both ends bounded). lambda is
the root of a convex dual, found by distributed Newton iterations: each sums gradient and curvature over the
histogram of (source, size) and updates the table of sources, which stays a table. Rates become whole copies:
cumulative rounding over a source's sizes, then rounds of corrections by the largest size that still fits the
remaining error. Everything is DataFrame operations; documents are shuffled once, by (source, size, salt).

Defined results: null and empty texts have size 0 and are taken 0 words; very long texts are one size like any other;
a null source is a source of its own, last in order; a source without words has target 0; documents of equal source and
size are interchangeable, and the order of a hash of doc_id says which of them get one copy more; repeated rows count
each, and rows that share a doc_id are documents of their own; a null doc_id is a doc_id; an empty table gives an empty
result; extra columns of any name are ignored by mix_sizes() and kept by repeat().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from doselab.llm.common import materialise, running, small, whole_rows

#: Source weights in order, repeating; words of the mix per word of the input; the most a document may be repeated.
WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2
#: The relative error at which Newton iterations end; documents of one source and size that a task ranks.
CLOSE, PER_SALT = 1e-9, 200_000


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def targets(sources: DataFrame) -> DataFrame:
    """sources: source, words. Adds target: weighted shares with the excess over MOST times a source's words reshared.

    Sources are filled in the order of their cap per weight; the level is the first at which the next cap is high enough.
    """
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (F.col("_k") % len(WEIGHTS) + 1).cast("int"))
    ordered = running(sources.select("source", "words"), [F.col("source").asc_nulls_last()], {"_k": F.lit(1)})
    s = ordered.withColumn("_w", weight).withColumn("_cap", F.lit(float(MOST)) * F.col("words")).withColumn("_ratio", F.col("_cap") / F.col("_w"))
    s = materialise(s, "weights")
    sums = s.agg((F.sum("words") * SHARE).alias("_total"), F.sum("_w").alias("_weights"))
    filled = running(s, [F.col("_ratio"), F.col("_k")], {"_full": F.col("_cap"), "_gone": F.col("_w")}).crossJoin(F.broadcast(sums))
    # The level if all sources before this one are at their caps and this one and later ones are not.
    filled = materialise(filled.withColumn("_level", (F.col("_total") - F.col("_full")) / (F.col("_weights") - F.col("_gone"))), "levels")
    chosen = filled.where("_level <= _ratio").agg(F.min(F.struct("_ratio", "_k", "_level"))["_level"].alias("_chosen"))
    filled = filled.drop("_level").crossJoin(F.broadcast(chosen))
    return filled.select("source", "words", F.least(F.col("_cap"), F.coalesce(F.col("_w") * F.col("_chosen"), F.col("_cap"))).alias("target"))


def _rate(tilt: Column, x: Column) -> Column:
    z = F.greatest(F.lit(-700.0), F.least(F.lit(700.0), tilt * x))
    return F.when(F.col("full"), F.lit(float(MOST))).otherwise(F.lit(float(MOST)) / (1 + F.exp(-z)))


def tilts(cells: DataFrame, sources: DataFrame) -> DataFrame:
    """source, tilt, full: the dual's root for each source. cells: source, size, n. sources: source, words, target, mean.

    A Newton step that leaves the bracket of the root is replaced by its middle, as is every third step after the first
    sixteen, so the brackets close; it ends when every source is close, or its bracket holds no further number.
    """
    state = sources.select("source", "target", "mean", (F.col("target") >= MOST * F.col("words")).alias("full"), F.lit(0.0).alias("tilt"), F.lit(-1e4).alias("low"), F.lit(1e4).alias("high"), F.lit(float("inf")).alias("error"))
    state = materialise(state, "tilts")
    open_, turn = (F.col("error") > CLOSE) & (F.col("high") - F.col("low") > 1e-14 * (1 + F.abs("tilt"))), 0
    while True:
        turn += 1
        side = F.broadcast(state) if small(state) else state
        both = cells.join(side, cells["source"].eqNullSafe(state["source"])).drop(cells["source"])
        x = F.col("size") / F.col("mean")
        r = _rate(F.col("tilt"), x)
        words = F.col("size") * F.col("n")
        summed = both.groupBy("source", "target", "mean", "full", "tilt", "low", "high").agg(F.sum(words * r).alias("_got"), F.sum(words * x * r * (MOST - r) / MOST).alias("_slope"))
        gap = F.col("target") - F.col("_got")
        low = F.when(gap > 0, F.col("tilt")).otherwise(F.col("low"))
        high = F.when(gap > 0, F.col("high")).otherwise(F.col("tilt"))
        step = F.col("tilt") + F.try_divide(gap, F.col("_slope"))
        summed = summed.select("source", "target", "mean", "full", "tilt", low.alias("low"), high.alias("high"), step.alias("_step"), F.when(F.col("full") | (F.col("target") <= 0), 0.0).otherwise(F.abs(gap) / F.col("target")).alias("error"))
        inside = (F.col("_step") > F.col("low")) & (F.col("_step") < F.col("high")) & F.lit(turn <= 16 or turn % 3 > 0)
        summed = summed.withColumn("tilt", F.when(F.col("error") <= CLOSE, F.col("tilt")).when(inside, F.col("_step")).otherwise((F.col("low") + F.col("high")) / 2)).drop("_step")
        state = materialise(summed.select(*state.columns), "tilts")
        if not state.where(open_).limit(1).count():
            break
    return state.select("source", "target", "mean", "full", "tilt")


def copies_by_size(cells: DataFrame, state: DataFrame) -> DataFrame:
    """source, size, n, base (copies of every document), extra (documents that get one more)."""
    side = F.broadcast(state) if small(state) else state
    c = cells.join(side, cells["source"].eqNullSafe(state["source"])).drop(state["source"])
    c = c.withColumn("rate", _rate(F.col("tilt"), F.col("size") / F.col("mean")))
    # Cumulative rounding from the largest size down keeps each size's copies within one of n * rate.
    run = W.partitionBy("source").orderBy(F.desc("size"))
    c = c.withColumn("_sum", F.sum(F.col("n") * F.col("rate")).over(run))
    c = c.withColumn("copies", (F.floor(F.col("_sum") + 0.5) - F.floor(F.coalesce(F.lag("_sum").over(run), F.lit(0.0)) + 0.5)).cast("long"))
    c = c.withColumn("copies", F.greatest(F.lit(0), F.least(F.col("n") * MOST, F.col("copies"))))
    c = materialise(c.select("source", "size", "n", "target", "copies"), "copies")
    while True:
        # Each round: per source the size whose copies, added or taken away, come nearest to the error; errors only fall.
        error = c.groupBy("source").agg((F.first("target") - F.sum(F.col("size") * F.col("copies"))).alias("_error"))
        error = F.broadcast(error) if small(error) else error
        e = c.join(error.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
        room = F.when(F.col("_error") > 0, F.col("n") * MOST - F.col("copies")).otherwise(F.col("copies"))
        fits = F.floor(F.abs("_error") / F.col("size") + 0.5)
        step = F.least(room, fits).cast("long")
        left = F.abs(F.abs("_error") - step * F.col("size"))
        e = e.withColumn("_step", F.when(F.col("size") > 0, step).otherwise(F.lit(0)).cast("long")).withColumn("_left", F.when((F.col("size") > 0) & (step > 0), left).otherwise(F.abs("_error")))
        best = e.where(F.col("_left") < F.abs("_error")).groupBy("source").agg(F.min(F.struct("_left", "size", "_step", "_error")).alias("b"))
        best = materialise(best.select(F.col("source").alias("_s"), F.col("b.size").alias("_size"), (F.col("b._step") * F.signum("b._error")).cast("long").alias("_change")), "correction")
        if not best.limit(1).count():
            break
        best = F.broadcast(best) if small(best) else best
        c = c.join(best, F.col("source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_size")), "left")
        c = materialise(c.select("source", "size", "n", "target", (F.col("copies") + F.coalesce("_change", F.lit(0))).alias("copies")), "copies")
    base = F.floor(F.col("copies") / F.col("n")).cast("long")
    return c.select("source", "size", "target", base.alias("_base"), (F.col("copies") - base * F.col("n")).alias("_extra"))


def mix_sizes(out: DataFrame) -> DataFrame:
    """out (with doc_id, source, size) with source_size, target, copies and taken. It is read twice."""
    cells = materialise(out.groupBy("source", "size").agg(F.count("*").alias("n")), "cells")
    # Cells that many documents share are ranked in parts; under one for PER_SALT documents.
    crowded = cells.where(F.col("n") > PER_SALT).select(F.col("source").alias("_s"), F.col("size").alias("_z"), F.ceil(F.col("n") / PER_SALT).cast("int").alias("_parts"))
    crowded = F.broadcast(crowded) if small(crowded) else crowded
    own = F.col("source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_z"))
    out = out.select("doc_id", "source", "size").join(crowded, own, "left").drop("_s", "_z")
    out = out.withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.coalesce("_parts", F.lit(1))).cast("int")).drop("_parts")
    salted = materialise(out.groupBy("source", "size", "_salt").agg(F.count("*").alias("_n")), "salted")
    sums = cells.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("words"), F.sum("n").alias("_docs"))
    mean = F.greatest(F.lit(1.0), F.col("words") / F.col("_docs"))
    sums = materialise(sums.withColumn("mean", mean).drop("_docs"), "sources")
    wanted = targets(sums.select("source", "words"))
    full = sums.join(wanted.drop("words").withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    full = materialise(full, "targets")
    decided = copies_by_size(cells, tilts(cells, full))
    # A document's rank within (source, size): its rank within the salt, after the salts before.
    before = F.sum("_n").over(W.partitionBy("source", "size").orderBy("_salt")) - F.col("_n")
    plan = salted.withColumn("_before", before).drop("_n").join(decided.withColumnRenamed("source", "_s").withColumnRenamed("size", "_z"), F.col("source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_z"))).drop("_s", "_z")
    plan = plan.join(F.broadcast(sums.select(F.col("source").alias("_s"), F.col("words").alias("source_size"))) if small(sums) else sums.select(F.col("source").alias("_s"), F.col("words").alias("source_size")), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    plan = plan.select(F.col("source").alias("_s"), F.col("size").alias("_z"), F.col("_salt").alias("_t"), "_before", "_base", "_extra", "target", "source_size")
    both = out.join(plan, F.col("source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_z")) & (F.col("_salt") == F.col("_t")))
    rank = F.row_number().over(W.partitionBy("_s", "_z", "_t").orderBy(F.xxhash64("doc_id", F.lit("mix")), "doc_id")) - 1 + F.col("_before")
    both = both.withColumn("copies", F.col("_base") + (rank < F.col("_extra")).cast("long"))
    return both.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def repeat(docs: DataFrame) -> DataFrame:
    """docs as mixed: each row as often as it has copies; the columns stay."""
    rows = whole_rows(docs).select("row", F.col("row.doc_id").alias("doc_id"), F.col("row.source").alias("source"), n_words(F.col("row.text")).alias("size"))
    sizes = materialise(rows.drop("row"), "sizes")
    taken = mix_sizes(sizes).groupBy("doc_id", "source", "size").agg(F.sum("copies").alias("_copies"), F.count("*").alias("_rows"))
    taken = taken.select(*[F.col(c).alias(f"_{c}") for c in ("doc_id", "source", "size")], "_copies", "_rows")
    same = F.col("doc_id").eqNullSafe(F.col("_doc_id")) & F.col("source").eqNullSafe(F.col("_source")) & (F.col("size") == F.col("_size"))
    # Rows that agree in doc_id, source and size share their copies; the first of them by text take what does not divide.
    place = F.row_number().over(W.partitionBy("doc_id", "source", "size").orderBy(F.xxhash64("row.text"))) - 1
    mixed = rows.join(taken, same).withColumn("_place", place)
    own = F.floor(F.col("_copies") / F.col("_rows")) + (F.col("_place") < F.col("_copies") % F.col("_rows")).cast("int")
    return mixed.select("row", own.cast("int").alias("_own")).where("_own > 0").withColumn("_k", F.explode(F.sequence(F.lit(1), F.col("_own")))).select("row.*")


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", n_words(F.col("text")).alias("size"))
    # The texts are read for their sizes once; all that follows needs numbers only.
    table = materialise(docs, "sizes")
    return mix_sizes(table).select("doc_id", "size", "source_size", "target", "taken", "copies")
