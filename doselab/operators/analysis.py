"""Closed-form statistics over the table of results, as DataFrame plans.

results: model_construction, dose (text), seed, eval_construction, accuracy.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from doselab.functions import scalars as S
from doselab.functions.special import correlation_p
from doselab.functions.text import content_list, jaccard
from doselab.operators import lm
from doselab.plans.design import FULL, Design

#: Fixed values of the decision rules.
SMOOTH_N, PHASE_N, SPLIT, SMALL_GAIN = (0.5, 2.0), 4.0, 0.5, 0.1
#: Fixed value: the recall assumed where no audit gives one.
DEFAULT_RECALL = 0.85


def _grid(df: DataFrame, column: str, names: list[str]) -> DataFrame:
    return df.sparkSession.createDataFrame([(n,) for n in names], f"{column} string")


def indirect_evidence(results: DataFrame, constructions: list[str], recall: DataFrame | None = None) -> DataFrame:
    """construction, E0, E0_se, Emax, direct_value, filter_recall, leakage_bound_note; raises where rows are missing."""
    own = (F.col("model_construction") == F.col("eval_construction")) & (F.trim("dose") == "0")
    top = (F.col("model_construction") == FULL) & S.is_all(F.col("dose"))
    x = F.col("accuracy")
    got = results.groupBy(F.col("eval_construction").alias("construction")).agg(
        F.avg(F.when(own, x)).alias("E0"), F.stddev_samp(F.when(own, x)).alias("_sd"), F.count(F.when(own, x)).alias("_n"), F.avg(F.when(top, x)).alias("Emax")
    )
    out = _grid(results, "construction", constructions).join(got, "construction", "left")
    for name, what in (("E0", "dose-0"), ("Emax", "ceiling")):
        out = out.withColumn(name, F.coalesce(F.col(name), F.raise_error(F.concat(F.lit(f"no {what} row for "), "construction")).cast("double")))
    out = out.withColumn("E0_se", F.when(F.col("_n") > 1, F.col("_sd") / F.sqrt("_n")).otherwise(0.0)).withColumn("direct_value", F.col("Emax") - F.col("E0"))
    out = out.join(recall.select("construction", F.col("recall").alias("_r")), "construction", "left") if recall is not None else out.withColumn("_r", F.lit(None).cast("double"))
    out = out.withColumn("filter_recall", F.coalesce("_r", F.lit(DEFAULT_RECALL)))
    note = S.leakage_note(F.col("filter_recall"), F.when(F.col("_r").isNull(), "default").otherwise("audit"))
    return out.withColumn("leakage_bound_note", note).select("construction", "E0", "E0_se", "Emax", "direct_value", "filter_recall", "leakage_bound_note")


def _cv(x: Column) -> Column:
    return F.when(F.avg(x) != 0, F.stddev_pop(x) / F.avg(x)).otherwise(0.0)


def seed_dose_cv(results: DataFrame) -> DataFrame:
    """One row: mean variation within (construction, dose) over seeds, and between doses within (construction, seed)."""
    own = results.where("model_construction = eval_construction")
    within = own.groupBy("model_construction", "dose").agg(_cv(F.col("accuracy")).alias("cv")).agg(F.avg("cv").alias("within_cv"))
    between = own.groupBy("model_construction", "seed").agg(_cv(F.col("accuracy")).alias("cv")).agg(F.avg("cv").alias("between_cv"))
    return within.crossJoin(between)


def seed_cv_matrix(results: DataFrame, doses: list[str]) -> DataFrame:
    """A row per construction, a column per dose; null with under two seeds or mean 0."""
    own = results.where("model_construction = eval_construction").withColumn("dose", F.trim("dose"))
    cv = F.when((F.count("accuracy") >= 2) & (F.avg("accuracy") != 0), F.try_divide(F.stddev_pop("accuracy"), F.avg("accuracy")))
    return own.groupBy(F.col("model_construction").alias("construction")).pivot("dose", doses).agg(cv)


def collateral_matrix(results: DataFrame, constructions: list[str]) -> DataFrame:
    return results.groupBy("model_construction").pivot("eval_construction", constructions).agg(F.avg("accuracy"))


def transfer_slopes(results: DataFrame) -> DataFrame:
    """train, eval, n, slope, std_error of accuracy on log10(dose + 1); null with under 3 points or one dose.

    Doses without a number (all without an attested count) are left out and counted as unresolved.
    """
    value = S.dose_value(F.col("dose"), S.attested_count(F.col("model_construction")))
    x, y = F.col("_x"), F.col("accuracy")
    rows = results.withColumn("_x", S.log_dose(value))
    known = F.when(x.isNotNull(), y)
    agg = rows.groupBy(F.col("model_construction").alias("train"), F.col("eval_construction").alias("eval")).agg(
        F.count(x).alias("n"), F.count_if(x.isNull()).alias("unresolved"), F.regr_slope(known, x).alias("_b"), F.regr_sxx(known, x).alias("_sxx"), F.regr_syy(known, x).alias("_syy"), F.regr_sxy(known, x).alias("_sxy"),
        (F.max(x) - F.min(x)).alias("_range"),
    )
    good = (F.col("n") >= 3) & (F.col("_range") > 0)
    rest = F.greatest(F.lit(0.0), F.col("_syy") - F.col("_b") * F.col("_sxy"))
    error = F.sqrt(rest / F.nullif(F.col("n") - 2, F.lit(0)) / F.nullif(F.col("_sxx"), F.lit(0.0)))
    return agg.select("train", "eval", "n", "unresolved", F.when(good, F.col("_b")).alias("slope"), F.when(good, error).alias("std_error"))


def transfer_grid(results: DataFrame, constructions: list[str]) -> DataFrame:
    """train, eval, slope, std_error on the dense square; null where there is no slope."""
    grid = _grid(results, "train", constructions).crossJoin(_grid(results, "eval", constructions))
    return grid.join(transfer_slopes(results).select("train", "eval", "slope", "std_error"), ["train", "eval"], "left")


def shared_ceiling(results: DataFrame, design: Design) -> DataFrame:
    """construction, seed, dose, dose_value, accuracy: each ladder's own rows and the shared ceiling's row on it."""
    spark = results.sparkSession
    want = spark.createDataFrame([(c, str(d), design.ceiling(c) if str(d) == "all" else c, c in design.core) for c in design.constructions for d in design.curve_doses(c)], "construction string, dose string, model_construction string, is_core boolean")
    rows = results.withColumn("dose", F.lower(F.trim("dose"))).withColumnRenamed("eval_construction", "construction")
    got = rows.join(F.broadcast(want), ["construction", "dose", "model_construction"])
    value = S.dose_value(F.col("dose"), S.attested_count(F.col("construction")))
    value = F.when(value.isNull() & F.col("is_core"), F.raise_error(F.concat(F.lit("no attested count for "), "construction")).cast("double")).otherwise(F.coalesce(value, F.lit(float("inf"))))
    return got.select("construction", "seed", "dose", value.alias("dose_value"), "accuracy", "is_core")


def breadth_rows(series: DataFrame) -> DataFrame:
    """construction, seed, E0, Emax of ladders that are not fitted: the first and last accuracy by dose."""
    return series.where(~F.col("is_core")).groupBy("construction", "seed").agg(F.min_by("accuracy", "dose_value").alias("E0"), F.max_by("accuracy", "dose_value").alias("Emax")).withColumn("converged", F.lit(False))


def step_threshold(series: DataFrame) -> DataFrame:
    """construction, seed, threshold, low, high, rss: the best split by prefix sums; ties to the smaller threshold."""
    own = W.partitionBy("construction", "seed")
    run = own.orderBy("dose_value").rowsBetween(W.unboundedPreceding, 0)
    x = series.where(F.col("dose_value") < float("inf"))
    for name, what in (("_n", F.lit(1)), ("_s", F.col("accuracy")), ("_q", F.col("accuracy") ** 2)):
        x = x.withColumn(name, F.sum(what).over(run)).withColumn(f"{name}t", F.sum(what).over(own))
    x = x.withColumn("_next", F.lead("dose_value").over(own.orderBy("dose_value"))).where(F.col("_next") > F.col("dose_value"))
    n2, s2, q2 = F.col("_nt") - F.col("_n"), F.col("_st") - F.col("_s"), F.col("_qt") - F.col("_q")
    rss = (F.col("_q") - F.col("_s") ** 2 / F.col("_n")) + (q2 - s2**2 / n2)
    found = x.select("construction", "seed", F.struct(F.round(rss, 12).alias("rss"), ((F.col("dose_value") + F.col("_next")) / 2).alias("threshold"), (F.col("_s") / F.col("_n")).alias("low"), (s2 / n2).alias("high")).alias("b"))
    return found.groupBy("construction", "seed").agg(F.min("b").alias("b")).select("construction", "seed", "b.threshold", "b.low", "b.high", "b.rss")


def information(rss: Column, n: Column, k_shape: int) -> tuple[Column, Column, Column]:
    """loglik, AIC, BIC of a Gaussian fit with k_shape shape parameters and the variance."""
    safe = F.when(rss > 0, rss).otherwise(1e-12)
    loglik = -n / 2 * (F.ln(2 * F.lit(3.141592653589793) * safe / n) + 1)
    k = k_shape + 1
    return loglik, 2 * k - 2 * loglik, k * F.ln(n) - 2 * loglik


def closed_form_models(series: DataFrame) -> DataFrame:
    """construction, seed, model, n_params, loglik, aic, bic of the mean, the log-linear line and the step; 4 points at least."""
    x = series.where(F.col("dose_value") < float("inf"))
    logx, y = F.ln(F.col("dose_value") + 1), F.col("accuracy")
    agg = x.groupBy("construction", "seed").agg(F.count("*").alias("n"), F.regr_syy(y, logx).alias("_syy"), F.regr_sxx(y, logx).alias("_sxx"), F.regr_sxy(y, logx).alias("_sxy")).where("n >= 4")
    step = step_threshold(series).select("construction", "seed", F.col("rss").alias("_step"))
    agg = agg.join(step, ["construction", "seed"], "left").withColumn("n", F.col("n").cast("double"))
    line = F.greatest(F.lit(0.0), F.col("_syy") - F.coalesce(F.try_divide(F.col("_sxy") ** 2, F.nullif("_sxx", F.lit(0.0))), F.lit(0.0)))
    out = None
    for model, rss, k in (("null", F.col("_syy"), 1), ("log_linear", line, 2), ("step", F.greatest(F.lit(0.0), F.col("_step")), 3)):
        ll, aic, bic = information(rss, F.col("n"), k)
        part = agg.where(rss.isNotNull()).select("construction", "seed", F.lit(model).alias("model"), F.lit(k + 1).alias("n_params"), ll.alias("loglik"), aic.alias("aic"), bic.alias("bic"), F.lit(True).alias("converged"))
        out = part if out is None else out.unionByName(part)
    return out


def best_model(models: DataFrame) -> DataFrame:
    """construction, model of the smallest mean AIC over converged rows; ties by name."""
    mean = models.where("converged").groupBy("construction", "model").agg(F.avg("aic").alias("aic"))
    return mean.groupBy("construction").agg(F.min(F.struct("aic", "model")).alias("b")).select("construction", "b.model", F.col("b.aic").alias("mean_aic"))


def average_rank(rows: DataFrame, value: str, out: str = "rank", by: tuple[str, ...] = ()) -> DataFrame:
    """Ranks with ties averaged."""
    order = W.partitionBy(*by).orderBy(value)
    return rows.withColumn(out, F.rank().over(order) + (F.count("*").over(W.partitionBy(*by, value)) - 1) / 2)


def correlations(rows: DataFrame, predictors: list[str], target: str) -> DataFrame:
    """predictor, n, pearson, pearson_p, spearman, spearman_p; null with under 3 rows or without spread. rows: one a construction.

    The p-values are two-sided, by Student's t.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(p).alias("predictor"), F.col(p).cast("double").alias("x")) for p in predictors]))
    long = rows.select(F.col(target).cast("double").alias("y"), pairs.alias("p")).select("y", "p.*").where("x is not null and y is not null and not isnan(x) and not isnan(y)")
    long = average_rank(average_rank(long, "x", "rx", ("predictor",)), "y", "ry", ("predictor",))
    spread = (F.max("x") > F.min("x")) & (F.max("y") > F.min("y")) & (F.count("*") >= 3)
    out = long.groupBy("predictor").agg(F.count("*").alias("n"), F.when(spread, F.corr("x", "y")).alias("pearson"), F.when(spread, F.corr("rx", "ry")).alias("spearman"))
    p = lambda c: correlation_p(F.col(c), F.col("n")).alias(f"{c}_p")
    return out.select("predictor", "n", "pearson", p("pearson"), "spearman", p("spearman"))


def strongest_predictor(corr: DataFrame, fallback: str) -> DataFrame:
    """The predictor of the largest absolute rank correlation; the fallback where none has one."""
    best = corr.agg(F.max_by("predictor", F.struct(F.abs("spearman"), F.col("predictor"))).alias("p"), F.count("spearman").alias("n"))
    return best.select(F.when(F.col("n") > 0, F.col("p")).otherwise(fallback).alias("predictor"))


def productivity(instances: DataFrame) -> DataFrame:
    """construction, productivity: distinct by all content tokens; null without any. instances: construction, text."""
    tokens = instances.select("construction", F.explode(content_list(F.col("text"))).alias("w"))
    got = tokens.groupBy("construction").agg((F.countDistinct("w") / F.count("*")).alias("productivity"))
    return instances.select("construction").distinct().join(got, "construction", "left")


def surface_predictability(instances: DataFrame, key: str = "sent_id") -> DataFrame:
    """construction, surface: mean over instances of unigram log probability by content tokens, counts from the instances.

    The numerator runs over word tokens, the divisor counts content tokens.
    """
    # The divisor first, in a projection of its own: beside the generator it would be worked out once a word.
    sized = instances.select("construction", key, F.greatest(F.lit(1), F.size(content_list(F.col("text")))).alias("_n"), lm.word_tokens(F.col("text")).alias("_w"))
    # A word's share of all means is ln(count / total) times its sum of 1 / _n, so words meet their counts in one aggregate. A row
    # without a word (its key and _n) stands for each instance.
    tokens = sized.select("construction", key, "_n", F.explode(F.concat("_w", F.array(F.lit(None).cast("string")))).alias("w"))
    word = F.col("w").isNotNull()
    own = [F.when(~word, F.col(c)).alias(f"_{c}") for c in (key, "_n")]
    counted = tokens.groupBy("construction", "w", *own).agg(F.count("*").alias("c"), F.sum(1 / F.col("_n")).alias("share"))
    # By construction: a handful of rows, each of sums.
    sums = {"_lp": F.sum(F.when(word, F.ln("c") * F.col("share"))), "_share": F.sum(F.when(word, F.col("share"))), "_total": F.sum(F.when(word, F.col("c"))), "_instances": F.count_if(~word)}
    found = counted.groupBy("construction").agg(*[c.alias(n) for n, c in sums.items()])
    return found.select("construction", (F.coalesce(F.col("_lp") - F.col("_share") * F.ln("_total"), F.lit(0.0)) / F.col("_instances")).alias("surface"))


def neighbor_density(instances: DataFrame, counts: DataFrame) -> DataFrame:
    """construction, density: over the others, their count times the Jaccard overlap of vocabularies.

    One row a construction meets the others: a product of a handful of rows.
    """
    vocab = instances.select("construction", F.explode(content_list(F.col("text"))).alias("w")).groupBy("construction").agg(F.collect_set("w").alias("v"))
    a = counts.join(vocab, "construction", "left").withColumn("v", F.coalesce("v", F.array().cast("array<string>")))
    b = a.select(F.col("construction").alias("_o"), F.col("n").alias("_n"), F.col("v").alias("_v"))
    met = a.join(b, F.col("construction") != F.col("_o"), "left")
    return met.groupBy("construction").agg(F.coalesce(F.sum(F.col("_n") * jaccard(F.col("v"), F.col("_v"))), F.lit(0.0)).alias("density"))


def target_means(fits: DataFrame) -> DataFrame:
    """construction with mean and sample deviation of E0 and E50 over finite rows; either side may be missing."""
    def one(c: str) -> DataFrame:
        good = fits.where(F.col(c).isNotNull() & ~F.isnan(c))
        return good.groupBy("construction").agg(F.avg(c).alias(f"{c}_mean"), F.stddev_samp(c).alias(f"{c}_std"))

    return one("E0").join(one("E50"), "construction", "outer")


def hill_plot(series: DataFrame) -> DataFrame:
    """construction, seed, E0, Emax, E50, n, converged: the saturating curve by its linear form, log((y - E0) / (Emax - y)) on log dose.

    E0 is the accuracy at the smallest dose, Emax the largest accuracy; points strictly between take part. A ladder with
    under two of them, or whose line doesn't rise, has no E50 and n and isn't converged.
    """
    own = W.partitionBy("construction", "seed")
    dose, y, low, top = F.col("dose_value"), F.col("accuracy"), F.col("_low"), F.col("_top")
    rows = series.withColumn("_low", F.min_by("accuracy", "dose_value").over(own)).withColumn("_top", F.max("accuracy").over(own))
    odds = F.when((y > low) & (y < top) & (dose > 0) & (dose < float("inf")), F.ln((y - low) / (top - y)))
    rows = rows.withColumn("_o", odds).withColumn("_x", F.when(odds.isNotNull(), F.ln(dose)))
    lines = rows.groupBy("construction", "seed").agg(F.first("_low").alias("E0"), F.first("_top").alias("Emax"), F.regr_slope("_o", "_x").alias("_m"), F.regr_intercept("_o", "_x").alias("_b"), F.count("_o").alias("_k"))
    good = F.coalesce((F.col("_k") >= 2) & (F.col("_m") > 0), F.lit(False))
    return lines.select("construction", "seed", "E0", "Emax", F.when(good, F.exp(-F.col("_b") / F.col("_m"))).alias("E50"), F.when(good, F.col("_m")).alias("n"), good.alias("converged"))


def curve_features(fits: DataFrame) -> DataFrame:
    """construction, seed, E0, Emax, log_E50, n of converged fits."""
    return fits.where("converged").select("construction", "seed", "E0", "Emax", F.ln(F.greatest("E50", F.lit(1e-6))).alias("log_E50"), "n")


def zscore(rows: DataFrame, columns: list[str]) -> DataFrame:
    every = W.partitionBy()
    for c in columns:
        sd = F.stddev_pop(c).over(every)
        rows = rows.withColumn(f"{c}_z", (F.col(c) - F.avg(c).over(every)) / F.when(sd == 0, 1.0).otherwise(sd))
    return rows


def silhouette(points: DataFrame) -> DataFrame:
    """k, silhouette: mean Euclidean silhouette of each labelling; null with one cluster. points: k, id, label, x (array).

    One row a fitted curve; the pairwise distances are among these few points.
    """
    a = points.where("label >= 0")
    b = a.select("k", F.col("id").alias("_i"), F.col("label").alias("_l"), F.col("x").alias("_x"))
    dist = F.sqrt(F.aggregate(F.zip_with("x", "_x", lambda u, v: (u - v) * (u - v)), F.lit(0.0), lambda s, v: s + v))
    near = a.join(b, "k").where("id <> _i").groupBy("k", "id", "label", "_l").agg(F.avg(dist).alias("d"))
    each = near.groupBy("k", "id", "label").agg(F.max(F.when(F.col("label") == F.col("_l"), F.col("d"))).alias("a"), F.min(F.when(F.col("label") != F.col("_l"), F.col("d"))).alias("b"))
    s = F.when(F.col("b").isNull(), None).when(F.col("a").isNull(), 0.0).otherwise(F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0)))
    return each.groupBy("k").agg(F.avg(s).alias("silhouette"))


def bootstrap_mean_ci(rows: DataFrame, key: str, value: str, draws: int = 1000, seed: int = 42) -> DataFrame:
    """key, mean, low, high: 2.5 and 97.5 percentiles of resampled means; draws are picked by hashes, so reruns agree."""
    own = W.partitionBy(key)
    numbered = rows.select(key, value).withColumn("_i", F.row_number().over(own.orderBy(value)) - 1).withColumn("_n", F.count("*").over(own))
    picks = numbered.select(key, F.col("_i").alias("_slot"), "_n", F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("_draw"))
    picks = picks.withColumn("_i", F.pmod(F.xxhash64(F.lit(seed), F.col(key), "_draw", "_slot"), F.col("_n")).cast("int"))
    means = picks.join(numbered.select(key, "_i", value), [key, "_i"]).groupBy(key, "_draw").agg(F.avg(value).alias("m"))
    ci = means.groupBy(key).agg(F.percentile("m", 0.025).alias("low"), F.percentile("m", 0.975).alias("high"))
    centre = rows.groupBy(key).agg(F.avg(value).alias("mean"), F.count("*").alias("n"))
    return centre.join(ci, key).select(key, "mean", F.when(F.col("n") >= 2, F.col("low")).otherwise(F.col("mean")).alias("low"), F.when(F.col("n") >= 2, F.col("high")).otherwise(F.col("mean")).alias("high"))


def decision(fits: DataFrame, models: DataFrame, results: DataFrame, silhouette_k2: DataFrame, constructions: list[str] | None = None) -> DataFrame:
    """One row: the rules' inputs, the fired hypotheses, and the verdict (Mixed unless exactly one fired).

    constructions: those that must all be best fitted by the saturating curve; by default those with models.
    """
    best = best_model(models)
    named = best.where(F.col("construction").isin(constructions)) if constructions else best
    need = len(constructions) if constructions else None
    shape = named.agg((F.coalesce(F.bool_and(F.col("model") == "hill"), F.lit(False)) & (F.count("*") == need if need else F.count("*") > 0)).alias("hill_best_all"))
    some = best.agg(F.coalesce(F.bool_or(F.col("model") == "hill"), F.lit(False)).alias("some_hill"), F.coalesce(F.bool_or(F.col("model") == "step"), F.lit(False)).alias("some_step"))
    means = fits.where("converged").agg(F.avg("n").alias("mean_n"), F.avg(S.relative_gain(F.col("Emax"), F.col("E0"))).alias("rel_gain"))
    sil = silhouette_k2.agg(F.first("silhouette", ignorenulls=True).alias("silhouette_k2"))
    row = shape.crossJoin(some).crossJoin(means).crossJoin(sil).crossJoin(seed_dose_cv(results))
    yes = lambda c: F.coalesce(c, F.lit(False))
    rules = {
        "H1": yes(F.col("hill_best_all") & F.col("mean_n").between(*SMOOTH_N)),
        "H2": yes(F.col("hill_best_all") & (F.col("mean_n") > PHASE_N)),
        "H3": yes(F.col("silhouette_k2") > SPLIT) | (F.col("some_hill") & F.col("some_step")),
        "H4": yes(F.col("rel_gain") < SMALL_GAIN),
        "H5": yes(F.col("within_cv") > F.col("between_cv")),
    }
    fired = F.filter(F.array(*[F.when(test, F.lit(name)) for name, test in rules.items()]), lambda h: h.isNotNull())
    out = row.withColumn("fired", fired)
    return out.withColumn("verdict", F.when(F.size("fired") == 1, F.get("fired", F.lit(0))).otherwise("Mixed"))
