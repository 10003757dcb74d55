"""Accuracy tables, audits of detectors, resumable results, and the joins around them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from doselab.functions import scalars as S
from doselab.functions.text import content_set
from doselab.operators import dose
from doselab.operators.sizes import hinted
from doselab.operators.stable import written

#: What a detector's audit must reach; rows a class in an audit sample.
PRECISION, RECALL, PER_CLASS = 0.90, 0.85, 200


def pair_accuracy(rows: DataFrame, *keys: str) -> DataFrame:
    """keys, n_pairs, n_correct, accuracy, std_error (rounded to 6 places, ties to even). rows: correct (0 or 1)."""
    a = rows.groupBy(*keys).agg(F.count("*").cast("int").alias("n_pairs"), F.coalesce(F.sum("correct"), F.lit(0)).cast("int").alias("n_correct"))
    p = F.when(F.col("n_pairs") > 0, F.col("n_correct") / F.greatest("n_pairs", F.lit(1))).otherwise(0.0)
    return a.withColumn("accuracy", F.bround(p, 6)).withColumn("std_error", F.bround(S.binomial_error(p, F.col("n_pairs")), 6))


def filter_report(rows: DataFrame, *keys: str) -> DataFrame:
    """Precision and recall of a detector on human labels; labels other than 0 and 1 are skipped and counted.

    rows: filter_label, human_label (text). Raises where no row is labelled.
    """
    human = F.trim(F.col("human_label").cast("string"))
    y, f = human == "1", F.col("filter_label") == 1
    good = human.isin("0", "1")
    out = rows.groupBy(*keys).agg(
        F.count_if(good & f & y).alias("tp"), F.count_if(good & f & ~y).alias("fp"), F.count_if(good & ~f & y).alias("fn"), F.count_if(good & ~f & ~y).alias("tn"),
        F.count_if(F.coalesce(~good, F.lit(True))).alias("n_skipped"),
    )
    n = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    out = out.withColumn("n_audited", F.when(n > 0, n).otherwise(F.raise_error(F.lit("no labelled row")).cast("bigint"))).withColumn("n_positive", F.col("tp") + F.col("fp"))
    out = out.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    return out.withColumn("passes", (F.col("precision") >= PRECISION) & (F.col("recall") >= RECALL))


def audit_sample(rows: DataFrame, seed: int = 42, per_class: int = PER_CLASS) -> DataFrame:
    """Up to per_class rows of each filter_label in hash order, mixed by a second hash: column place. rows: sent_id."""
    rank = F.row_number().over(W.partitionBy("filter_label").orderBy(S.shuffle_key(F.col("sent_id"), seed), "sent_id"))
    picked = rows.withColumn("_r", rank).where(F.col("_r") <= per_class).drop("_r")
    # At most 2 * per_class rows are numbered.
    return picked.withColumn("place", F.row_number().over(W.orderBy(S.shuffle_key(F.col("sent_id"), seed + 1), "sent_id")))


def resume(todo: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """What of todo has no result yet."""
    return todo.join(done.select(*keys).distinct(), keys, "left_anti")


def seed_replicate(rows: DataFrame, seeds: list[int]) -> DataFrame:
    return rows.crossJoin(rows.sparkSession.createDataFrame([(s,) for s in seeds], "seed int"))


def item_sentences(per_item: DataFrame, items: DataFrame) -> DataFrame:
    """per_item with its good sentence; '' where no item matches. Ids compare as text."""
    known = items.select(F.col("construction").alias("eval_construction"), F.col("item_id").cast("string").alias("item_id"), F.col("good_sentence").alias("sentence"))
    return per_item.withColumn("item_id", F.col("item_id").cast("string")).join(known, ["eval_construction", "item_id"], "left").withColumn("sentence", F.coalesce("sentence", F.lit("")))


def corpus_vocab(texts: DataFrame, *by: str) -> DataFrame:
    return texts.select(*by, F.explode(content_set(F.col("text"))).alias("w")).distinct()


def cell_vocab(texts: DataFrame, changed: DataFrame, cells: DataFrame, asked: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The content vocabularies of all cells as signed multisets: (w, c) of the base, (construction, dose, w, d) of each cell's changes.

    A word is in a cell's vocabulary if c + d > 0, missing values being 0. asked: w; only these words, if given.
    texts: text of the base; changed: dose.changes().
    """
    only = (lambda rows: rows) if asked is None else (lambda rows: rows.join(hinted(asked), "w", "left_semi"))
    words = F.explode(content_set(F.col("text"))).alias("w")
    base = only(texts.select(words)).groupBy("w").agg(F.count("*").alias("c"))
    signed = only(dose.stepped(changed, cells).select("construction", "step", "sign", words)).groupBy("construction", "step", "w").agg(F.sum("sign").alias("d")).where("d <> 0")
    return base, dose.by_cell(signed, cells, ["w"], ["d"])


def seen_novel_cells(items: DataFrame, texts: DataFrame, changed: DataFrame, cells: DataFrame) -> DataFrame:
    """items (construction, dose, sentence, ...) with group: seen if a content word is in the vocabulary of their cell's corpus, else novel.

    Items of a cell without a corpus are novel. Words are looked up in the base's counts and in the cell's changes to them;
    no cell's vocabulary is built.
    """
    keyed = written(items.withColumn("_n", F.monotonically_increasing_id()), "items")
    words = keyed.join(hinted(cells.select("construction", "dose").distinct()), ["construction", "dose"], "left_semi").select("construction", "dose", "_n", F.explode(content_set(F.col("sentence"))).alias("w"))
    base, moved = cell_vocab(texts, changed, cells, words.select("w").distinct())
    found = words.join(base, "w", "left").join(moved, ["construction", "dose", "w"], "left")
    hit = found.where(F.coalesce("c", F.lit(0)) + F.coalesce("d", F.lit(0)) > 0).select("_n").distinct().withColumn("_hit", F.lit(True))
    return keyed.join(hit, "_n", "left").withColumn("group", F.when(F.col("_hit"), "seen").otherwise("novel")).drop("_n", "_hit")


def seen_novel(items: DataFrame, vocab: DataFrame, by: list[str]) -> DataFrame:
    """items with group: seen if any content word is in the vocabulary of its cell (by-columns), else novel.

    items: _id-free rows with sentence; vocab: by, w. A semi join of exploded words, so the vocabulary may be large.
    """
    keyed = items.withColumn("_n", F.xxhash64(*[F.col(c).cast("string") for c in items.columns]))
    words = keyed.select(*by, "_n", F.explode(content_set(F.col("sentence"))).alias("w"))
    hit = words.join(vocab, [*by, "w"], "left_semi").select("_n").distinct().withColumn("_hit", F.lit(True))
    return keyed.join(hit, "_n", "left").withColumn("group", F.when(F.col("_hit"), "seen").otherwise("novel")).drop("_n", "_hit")


def seen_novel_accuracy(labelled: DataFrame) -> DataFrame:
    """construction, dose, group, n, accuracy, std_error on the dense grid; empty cells have n 0 and accuracy 0."""
    cells = labelled.select("construction", "dose").distinct()
    grid = cells.crossJoin(labelled.sparkSession.createDataFrame([("seen",), ("novel",)], "`group` string"))
    found = labelled.groupBy("construction", "dose", "group").agg(F.count("*").alias("n"), F.avg("correct").alias("accuracy"))
    out = grid.join(found, ["construction", "dose", "group"], "left").fillna(0, ["n"]).fillna(0.0, ["accuracy"])
    return out.withColumn("std_error", S.binomial_error(F.col("accuracy"), F.col("n")))


def self_rows(results: DataFrame) -> DataFrame:
    return results.where(F.col("model_construction") == F.col("eval_construction"))


def runs_in(files: DataFrame, constructions: list[str], doses: list[str], seeds: list[int]) -> DataFrame:
    """construction, dose, seed, path, named: the folders of a listing (path of files) that are runs.

    A run's folder holds a configuration and weights. A canonical name of the design comes first (named); any other
    name may still hold construction, dose and seed in this order; folders of neither kind are left out.
    """
    parts = files.select(F.regexp_extract("path", "^(.*)/[^/]+$", 1).alias("path"), F.regexp_extract("path", "([^/]+)$", 1).alias("file"))
    folders = parts.groupBy("path").agg(F.bool_or(F.col("file") == "config.json").alias("c"), F.bool_or(F.col("file").isin("model.safetensors", "pytorch_model.bin")).alias("w")).where("c and w")
    spark = files.sparkSession
    known = spark.createDataFrame([(c, str(d), s) for c in constructions for d in doses for s in seeds], "construction string, dose string, seed int")  # the design's size
    known = known.select(S.run_name(F.col("construction"), F.col("dose"), F.col("seed")).alias("_name"), F.struct("construction", "dose", "seed").alias("_known"))
    folders = folders.withColumn("_name", F.regexp_extract("path", "([^/]+)$", 1)).join(hinted(known), "_name", "left")
    pattern = "(" + "|".join(sorted([*constructions, "full"], key=len, reverse=True)) + ").*?(?:dose[-_]?|D)(\\d+|all).*?seed[-_]?(\\d+)"
    read = F.struct(*[F.regexp_extract("_name", pattern, k).alias(c) for k, c in ((1, "construction"), (2, "dose"))], F.regexp_extract("_name", pattern, 3).try_cast("int").alias("seed"))
    out = folders.select("path", F.coalesce("_known", read).alias("r"), F.col("_known").isNotNull().alias("named")).where("r.construction <> ''")
    return out.select("r.construction", "r.dose", "r.seed", "path", "named")


def discover_runs(spark: SparkSession, root: str, constructions: list[str], doses: list[str] = ("0", "4", "16", "64", "all"), seeds: list[int] = (42, 43, 44)) -> DataFrame:
    """runs_in() all files under root, in order of construction, dose and seed. Only names are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")
    return runs_in(files, list(constructions), list(doses), list(seeds)).orderBy("construction", "dose", "seed", "path")


def health_check(runs: DataFrame, low: float = 15.0, high: float = 40.0) -> DataFrame:
    """status, n, lowest and highest perplexity, runs out of the band. runs: status, perplexity."""
    p = F.col("perplexity")
    return runs.groupBy("status").agg(F.count("*").alias("n"), F.min("perplexity").alias("lowest"), F.max("perplexity").alias("highest"), F.count_if(~p.between(low, high)).alias("n_out_of_band"))
