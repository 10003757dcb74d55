"""Queries over the table of results, and the joins and statistics of the analysis."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doselab.functions import scalars as S
from doselab.functions import text as T
from doselab.operators import analysis, curves, evaluation
from doselab.operators.positions import first_rows
from doselab.operators.stable import scratch_path, written
from doselab.plans.design import FULL, SEEDS, Design
from doselab.queries import core
from doselab.queries import views as V
from doselab.queries.core import query
from doselab.sources import artefacts, readers, writers

DESIGN = Design()
CODES = DESIGN.constructions


#: Order lines stand in for the outcomes of items: keys deal a line to a run and a test set, a hash of them is its good
#: sentence's score, and the bar that it must pass falls with the run's dose. Both engines evaluate the same text.
_CELL = f"(l_orderkey * 31 + l_linenumber * 7 + l_partkey) % {len(core._CELL_ROWS)}"
_SCORE = "((l_partkey * 7919 + l_suppkey * 104729 + l_orderkey * 31 + l_linenumber * 1299721) % 1000) / 1000.0"
_BAR = "(CASE WHEN model_construction = 'full' THEN 140 - 8 * e WHEN c = e THEN 500 - 10 * e - floor(320 * d / (d + 9 + 2 * c)) ELSE 500 - 10 * e - floor(d / 4) END) / 1000.0"
_CODE_LIST = [(i, c) for i, c in enumerate(CODES)]
RES = f"""
runs AS (SELECT * FROM (VALUES {", ".join(f"({k}, '{c}', '{d}', {CODES.index(c) if c in CODES else -1}, {'NULL' if d == 'all' else d}::DOUBLE)" for k, (c, d) in enumerate(core._CELL_ROWS))}) AS t(k, model_construction, dose, c, d)),
log AS (
  SELECT model_construction, dose, seed, t.code AS eval_construction, item_id, good, {_BAR} AS bad
  FROM (SELECT {_CELL} AS k, 42 + l_linenumber % 3 AS seed, l_suppkey % {len(CODES)} AS e, l_orderkey AS item_id, {_SCORE} AS good FROM lineitem) l JOIN runs USING (k) JOIN (VALUES {", ".join(f"({i}, '{c}')" for i, c in _CODE_LIST)}) AS t(i, code) ON t.i = e
),
results AS (SELECT model_construction, dose, seed, eval_construction, round_even(avg((good > bad)::INTEGER), 6) AS accuracy FROM log GROUP BY ALL)"""
_VALUE = "CASE WHEN lower(trim(dose)) = 'all' THEN CASE model_construction " + " ".join(f"WHEN '{c}' THEN {n}::DOUBLE" for c, n in S.ATTESTED.items()) + " END ELSE try_cast(dose AS DOUBLE) END"


def outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """model_construction, dose, seed, eval_construction, item_id, good, bad: a row an order line."""
    runs = [(k, c, d, CODES.index(c) if c in CODES else -1, None if d == "all" else float(d)) for k, (c, d) in enumerate(core._CELL_ROWS)]
    rows = spark.read.parquet(f"{sf}/lineitem.parquet").select(F.expr(_CELL).alias("k"), F.expr("42 + l_linenumber % 3").cast("int").alias("seed"), F.expr(f"l_suppkey % {len(CODES)}").alias("e"), F.col("l_orderkey").alias("item_id"), F.expr(_SCORE).alias("good"))
    # The design's cells and codes: a few rows each.
    rows = rows.join(F.broadcast(spark.createDataFrame(runs, "k bigint, model_construction string, dose string, c int, d double")), "k")
    rows = rows.join(F.broadcast(spark.createDataFrame(_CODE_LIST, "e bigint, eval_construction string")), "e")
    return rows.select("model_construction", "dose", "seed", "eval_construction", "item_id", "good", F.expr(_BAR).alias("bad"))


def results(spark: SparkSession, sf: str) -> DataFrame:
    """model_construction, dose, seed, eval_construction, accuracy: the table of results over all outcomes."""
    keys = ["model_construction", "dose", "seed", "eval_construction"]
    return evaluation.pair_accuracy(outcomes(spark, sf).withColumn("correct", S.pair_correct(F.col("good"), F.col("bad"))), *keys).select(*keys, "accuracy")


@query(f"SELECT model_construction, dose, seed, eval_construction, {_VALUE} AS value FROM results WHERE model_construction <> 'full'", RES)
def dose_value(spark: SparkSession, sf: str) -> DataFrame:
    rows = results(spark, sf).where("model_construction <> 'full'")
    return rows.select("model_construction", "dose", "seed", "eval_construction", S.dose_value(F.col("dose"), S.attested_count(F.col("model_construction"))).alias("value"))


@query("SELECT construction AS c, observed AS n FROM (" + core.SANITY_SQL + ") WHERE dose = 'all'", V.RECORDS, V.POSITIVES, core._CELLS, core._KEPT, core._FILLERS, core._CORPUS, core._OBSERVED)
def sanity_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Attested counts as the sanity document of all cells has them; the document has an entry a cell of the design."""
    doc = artefacts.sanity_json(core.dose_sanity(spark, sf)).first()["value"]
    return readers.sanity_counts(spark, core.CODES, doc).where("n is not null").select(F.col("construction").alias("c"), "n")


@query("SELECT model_construction, dose, seed, accuracy FROM results WHERE model_construction = eval_construction", RES)
def self_eval_rows(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.self_rows(results(spark, sf)).select("model_construction", "dose", "seed", "accuracy")


@query("""
SELECT construction, round(e0, 8) AS E0, round(coalesce(sd / sqrt(n), 0), 8) AS E0_se, round(emax, 8) AS Emax, round(emax - e0, 8) AS direct_value FROM (
  SELECT eval_construction AS construction, avg(accuracy) FILTER (WHERE model_construction = eval_construction AND dose = '0') AS e0, stddev_samp(accuracy) FILTER (WHERE model_construction = eval_construction AND dose = '0') AS sd,
    count(*) FILTER (WHERE model_construction = eval_construction AND dose = '0') AS n, avg(accuracy) FILTER (WHERE model_construction = 'full' AND dose = 'all') AS emax FROM results GROUP BY 1)""", RES)
def indirect_evidence(spark: SparkSession, sf: str) -> DataFrame:
    out = analysis.indirect_evidence(results(spark, sf), CODES)
    return out.select("construction", *[F.round(c, 8).alias(c) for c in ("E0", "E0_se", "Emax", "direct_value")])


_CV = "CASE WHEN avg(accuracy) <> 0 THEN stddev_pop(accuracy) / avg(accuracy) ELSE 0 END AS cv"


@query(f"SELECT (SELECT round(avg(cv), 8) FROM (SELECT {_CV} FROM results WHERE model_construction = eval_construction GROUP BY model_construction, dose)) AS within_cv, (SELECT round(avg(cv), 8) FROM (SELECT {_CV} FROM results WHERE model_construction = eval_construction GROUP BY model_construction, seed)) AS between_cv", RES)
def seed_dose_cv(spark: SparkSession, sf: str) -> DataFrame:
    return analysis.seed_dose_cv(results(spark, sf)).select(F.round("within_cv", 8).alias("within_cv"), F.round("between_cv", 8).alias("between_cv"))


@query("SELECT model_construction AS construction, " + ", ".join(f"round(stddev_pop(accuracy) FILTER (WHERE dose = '{d}') / avg(accuracy) FILTER (WHERE dose = '{d}'), 8) AS d{d}" for d in (0, 4, 16, 64)) + " FROM results WHERE model_construction = eval_construction GROUP BY 1", RES)
def seed_cv_matrix(spark: SparkSession, sf: str) -> DataFrame:
    out = analysis.seed_cv_matrix(results(spark, sf), ["0", "4", "16", "64"])
    return out.select("construction", *[F.round(d, 8).alias(f"d{d}") for d in ("0", "4", "16", "64")])


@query("SELECT model_construction, " + ", ".join(f"round(avg(accuracy) FILTER (WHERE eval_construction = '{c}'), 8) AS {c}" for c in CODES) + " FROM results GROUP BY 1", RES)
def collateral_matrix(spark: SparkSession, sf: str) -> DataFrame:
    out = analysis.collateral_matrix(results(spark, sf), CODES)
    return out.select("model_construction", *[F.round(c, 8).alias(c) for c in CODES])


_SLOPES = f"""
points AS (SELECT *, log10({_VALUE} + 1) AS x FROM results),
slopes AS (
  SELECT model_construction AS train, eval_construction AS eval, count(x) AS n, count(*) - count(x) AS unresolved, max(x) > min(x) AS spread, regr_slope(accuracy, x) AS b, regr_sxx(accuracy, x) AS sxx, regr_syy(accuracy, x) AS syy, regr_sxy(accuracy, x) AS sxy
  FROM points GROUP BY 1, 2
)"""
_SLOPE = "CASE WHEN n >= 3 AND spread THEN round(b, 8) END AS slope, CASE WHEN n >= 3 AND spread THEN round(sqrt(greatest(0, syy - b * sxy) / nullif(n - 2, 0) / nullif(sxx, 0)), 8) END AS std_error"


@query(f"SELECT train, eval, n, unresolved, {_SLOPE} FROM slopes", RES, _SLOPES)
def transfer_slopes(spark: SparkSession, sf: str) -> DataFrame:
    out = analysis.transfer_slopes(results(spark, sf))
    return out.select("train", "eval", "n", "unresolved", F.round("slope", 8).alias("slope"), F.round("std_error", 8).alias("std_error"))


_LIST = "codes AS (SELECT unnest([" + V.quoted(CODES) + "]) AS c)"


@query(f"SELECT a.c AS train, b.c AS eval, s.slope, s.std_error FROM codes a CROSS JOIN codes b LEFT JOIN (SELECT train, eval, {_SLOPE} FROM slopes) s ON s.train = a.c AND s.eval = b.c", RES, _SLOPES, _LIST)
def transfer_grid(spark: SparkSession, sf: str) -> DataFrame:
    out = analysis.transfer_grid(results(spark, sf), CODES)
    return out.select("train", "eval", F.round("slope", 8).alias("slope"), F.round("std_error", 8).alias("std_error"))


_SERIES = f"""
series AS (
  SELECT eval_construction AS construction, seed, dose, try_cast(dose AS DOUBLE) AS dose_value, accuracy, eval_construction IN ({V.quoted(DESIGN.core)}) AS is_core FROM results WHERE model_construction = eval_construction
  UNION ALL
  SELECT eval_construction, seed, dose, CASE eval_construction {" ".join(f"WHEN '{c}' THEN {n}::DOUBLE" for c, n in S.ATTESTED.items())} ELSE 'inf'::DOUBLE END, accuracy, eval_construction IN ({V.quoted(DESIGN.core)}) FROM results WHERE model_construction = 'full'
)"""


def series(spark: SparkSession, sf: str) -> DataFrame:
    return analysis.shared_ceiling(results(spark, sf), DESIGN)


@query("SELECT construction, seed, dose, CASE WHEN isinf(dose_value) THEN -1 ELSE dose_value END AS dose_value, accuracy, is_core FROM series", RES, _SERIES)
def shared_ceiling(spark: SparkSession, sf: str) -> DataFrame:
    return series(spark, sf).withColumn("dose_value", F.when(F.col("dose_value") == float("inf"), -1.0).otherwise(F.col("dose_value")))


@query("SELECT construction, seed, arg_min(accuracy, dose_value) AS E0, arg_max(accuracy, dose_value) AS Emax FROM series WHERE NOT is_core GROUP BY construction, seed", RES, _SERIES)
def breadth_rows(spark: SparkSession, sf: str) -> DataFrame:
    return analysis.breadth_rows(series(spark, sf)).drop("converged")


_STEP = """
splits AS (
  SELECT a.construction, a.seed, a.dose_value, (SELECT min(c.dose_value) FROM series c WHERE c.construction = a.construction AND c.seed = a.seed AND c.dose_value > a.dose_value) AS nxt,
    var_pop(b.accuracy) FILTER (WHERE b.dose_value <= a.dose_value) * count(*) FILTER (WHERE b.dose_value <= a.dose_value) + var_pop(b.accuracy) FILTER (WHERE b.dose_value > a.dose_value) * count(*) FILTER (WHERE b.dose_value > a.dose_value) AS rss,
    avg(b.accuracy) FILTER (WHERE b.dose_value <= a.dose_value) AS low, avg(b.accuracy) FILTER (WHERE b.dose_value > a.dose_value) AS high
  FROM series a JOIN series b ON b.construction = a.construction AND b.seed = a.seed WHERE a.is_core GROUP BY a.construction, a.seed, a.dose_value
),
steps AS (SELECT * FROM splits WHERE nxt IS NOT NULL QUALIFY row_number() OVER (PARTITION BY construction, seed ORDER BY round(rss, 12), dose_value) = 1)"""


@query("SELECT construction, seed, (dose_value + nxt) / 2 AS threshold, round(low, 8) AS low, round(high, 8) AS high, round(rss, 6) AS rss FROM steps", RES, _SERIES, _STEP)
def step_threshold(spark: SparkSession, sf: str) -> DataFrame:
    out = analysis.step_threshold(series(spark, sf).where("is_core"))
    return out.select("construction", "seed", "threshold", *[F.round(c, 8).alias(c) for c in ("low", "high")], F.round("rss", 6).alias("rss"))


_MODELS = """
base_fit AS (SELECT construction, seed, count(*) AS n, regr_syy(accuracy, ln(dose_value + 1)) AS syy, regr_sxx(accuracy, ln(dose_value + 1)) AS sxx, regr_sxy(accuracy, ln(dose_value + 1)) AS sxy FROM series WHERE is_core GROUP BY construction, seed),
rss AS (
  SELECT construction, seed, n, 'null' AS model, 1 AS k, syy AS rss FROM base_fit UNION ALL SELECT construction, seed, n, 'log_linear', 2, syy - sxy * sxy / sxx FROM base_fit
  UNION ALL SELECT b.construction, b.seed, n, 'step', 3, s.rss FROM base_fit b JOIN steps s USING (construction, seed)
),
scored AS (SELECT construction, seed, model, k + 1 AS n_params, -n / 2.0::DOUBLE * (ln(2 * pi() * rss / n) + 1) AS loglik, n, k FROM rss),
models AS (SELECT construction, seed, model, n_params, loglik, 2 * (k + 1) - 2 * loglik AS aic, (k + 1) * ln(n) - 2 * loglik AS bic FROM scored)"""


@query("SELECT construction, seed, model, n_params, round(loglik, 5) AS loglik, round(aic, 5) AS aic, round(bic, 5) AS bic FROM models", RES, _SERIES, _STEP, _MODELS)
def model_comparison(spark: SparkSession, sf: str) -> DataFrame:
    out = analysis.closed_form_models(series(spark, sf).where("is_core"))
    return out.select("construction", "seed", "model", "n_params", *[F.round(c, 5).alias(c) for c in ("loglik", "aic", "bic")])


@query("SELECT construction, arg_min(model, aic) AS model, round(min(aic), 5) AS mean_aic FROM (SELECT construction, model, avg(aic) AS aic FROM models GROUP BY 1, 2) GROUP BY construction", RES, _SERIES, _STEP, _MODELS)
def best_model(spark: SparkSession, sf: str) -> DataFrame:
    return analysis.best_model(analysis.closed_form_models(series(spark, sf).where("is_core"))).withColumn("mean_aic", F.round("mean_aic", 5))


def _instances(spark: SparkSession, sf: str) -> DataFrame:
    return V.hits(V.records(spark, sf)).select("construction", "sent_id", "text")


_TOK = core._LIST


@query(f"SELECT construction, round(count(DISTINCT w)::DOUBLE / count(*), 8) AS productivity FROM (SELECT construction, unnest({_TOK}) AS w FROM hits) GROUP BY construction", V.RECORDS, V.HITS)
def productivity(spark: SparkSession, sf: str) -> DataFrame:
    return analysis.productivity(_instances(spark, sf)).withColumn("productivity", F.round("productivity", 8))


@query(f"""
SELECT construction, round(avg(lp / greatest(1, n)), 6) AS surface FROM (
  SELECT p.construction, p.sent_id, any_value(len({_TOK})) AS n, sum(ln(c.c::DOUBLE / t.total)) AS lp FROM (SELECT *, unnest({core.TOK}) AS w FROM hits) p
  JOIN (SELECT construction, w, count(*) AS c FROM (SELECT construction, unnest({core.TOK}) AS w FROM hits) GROUP BY 1, 2) c ON c.construction = p.construction AND c.w = p.w
  JOIN (SELECT construction, count(*) AS total FROM (SELECT construction, unnest({core.TOK}) AS w FROM hits) GROUP BY 1) t ON t.construction = p.construction GROUP BY 1, 2) GROUP BY construction""", V.RECORDS, V.HITS)
def surface_predictability(spark: SparkSession, sf: str) -> DataFrame:
    return analysis.surface_predictability(_instances(spark, sf)).withColumn("surface", F.round("surface", 6))


@query(f"""
SELECT a.construction, round(coalesce(sum(b.n * len(list_intersect(a.v, b.v))::DOUBLE / len(list_distinct(a.v || b.v))), 0), 6) AS density FROM (SELECT construction, count(DISTINCT sent_id) AS n, list(DISTINCT w) AS v FROM (SELECT construction, sent_id, unnest({_TOK}) AS w FROM hits) GROUP BY 1) a
JOIN (SELECT construction, count(DISTINCT sent_id) AS n, list(DISTINCT w) AS v FROM (SELECT construction, sent_id, unnest({_TOK}) AS w FROM hits) GROUP BY 1) b ON a.construction <> b.construction GROUP BY a.construction""", V.RECORDS, V.HITS)
def neighbor_density(spark: SparkSession, sf: str) -> DataFrame:
    rows = _instances(spark, sf)
    return analysis.neighbor_density(rows, rows.groupBy("construction").agg(F.countDistinct("sent_id").alias("n"))).withColumn("density", F.round("density", 6))


_FITS = """
ends AS (SELECT construction, seed, dose_value, accuracy AS y, arg_min(accuracy, dose_value) OVER w AS lo, max(accuracy) OVER w AS hi FROM series WINDOW w AS (PARTITION BY construction, seed)),
inner_ AS (SELECT *, CASE WHEN y > lo AND y < hi AND dose_value > 0 AND NOT isinf(dose_value) THEN ln((y - lo) / (hi - y)) END AS odds FROM ends),
fits AS (
  SELECT construction, seed, E0, Emax, CASE WHEN good THEN exp(-b / m) END AS E50, CASE WHEN good THEN m END AS n, good AS converged FROM (
    SELECT construction, seed, any_value(lo) AS E0, any_value(hi) AS Emax, regr_slope(odds, x) AS m, regr_intercept(odds, x) AS b, coalesce(count(odds) >= 2 AND regr_slope(odds, x) > 0, FALSE) AS good
    FROM (SELECT *, CASE WHEN odds IS NOT NULL THEN ln(dose_value) END AS x FROM inner_) GROUP BY construction, seed))"""


def fits(spark: SparkSession, sf: str) -> DataFrame:
    return analysis.hill_plot(series(spark, sf))


@query("SELECT coalesce(a.construction, b.construction) AS construction, round(e0m, 8) AS E0_mean, round(e0s, 8) AS E0_std, round(e50m, 8) AS E50_mean, round(e50s, 8) AS E50_std FROM (SELECT construction, avg(E0) AS e0m, stddev_samp(E0) AS e0s FROM fits WHERE E0 IS NOT NULL GROUP BY 1) a FULL JOIN (SELECT construction, avg(E50) AS e50m, stddev_samp(E50) AS e50s FROM fits WHERE E50 IS NOT NULL GROUP BY 1) b ON a.construction = b.construction", RES, _SERIES, _FITS)
def targets_outer(spark: SparkSession, sf: str) -> DataFrame:
    out = analysis.target_means(fits(spark, sf))
    return out.select("construction", *[F.round(c, 8).alias(c) for c in ("E0_mean", "E0_std", "E50_mean", "E50_std")])


_PRED = "pred AS (SELECT construction, avg(E0) AS y, avg(Emax) AS p1, -avg(n) AS p2, avg(n) * avg(n) + CASE WHEN construction LIKE 'i%' THEN 3 ELSE 0 END AS p3 FROM fits GROUP BY construction)"


def _predictors(spark: SparkSession, sf: str) -> DataFrame:
    return fits(spark, sf).groupBy("construction").agg(F.avg("E0").alias("y"), F.avg("Emax").alias("p1"), (-F.avg("n")).alias("p2"), (F.avg("n") * F.avg("n") + F.when(F.col("construction").like("i%"), 3).otherwise(0)).alias("p3"))


_RANKS = "ranked AS (SELECT predictor, x, y, rank() OVER (PARTITION BY predictor ORDER BY x) + (count(*) OVER (PARTITION BY predictor, x) - 1) / 2.0::DOUBLE AS rx, rank() OVER (PARTITION BY predictor ORDER BY y) + (count(*) OVER (PARTITION BY predictor, y) - 1) / 2.0::DOUBLE AS ry FROM (SELECT 'p1' AS predictor, p1 AS x, y FROM pred UNION ALL SELECT 'p2', p2, y FROM pred UNION ALL SELECT 'p3', p3, y FROM pred) WHERE x IS NOT NULL AND y IS NOT NULL)"


# Student's t by its finite series for whole degrees of freedom.
_SERIES_P = """
CASE WHEN (n - 2) % 2 = 0 THEN 1 - abs({r}) * list_sum(list_transform(range(0, (n - 2) // 2), lambda k: exp(lgamma(2 * k + 1) - 2 * lgamma(k + 1) - k * ln(4)) * pow(1 - {r} * {r}, k)))
  ELSE 1 - 2 / pi() * (asin(abs({r})) + abs({r}) * sqrt(1 - {r} * {r}) * coalesce(list_sum(list_transform(range(0, (n - 3) // 2), lambda k: exp(k * ln(4) + 2 * lgamma(k + 1) - lgamma(2 * k + 2)) * pow(1 - {r} * {r}, k))), 0)) END"""


@query(f"SELECT predictor, n, round(pearson, 8) AS pearson, round({_SERIES_P.format(r='pearson')}, 8) AS pearson_p, round(spearman, 8) AS spearman, round({_SERIES_P.format(r='spearman')}, 8) AS spearman_p FROM (SELECT predictor, count(*) AS n, corr(x, y) AS pearson, corr(rx, ry) AS spearman FROM ranked GROUP BY predictor)", RES, _SERIES, _FITS, _PRED, _RANKS)
def predictor_correlations(spark: SparkSession, sf: str) -> DataFrame:
    out = analysis.correlations(_predictors(spark, sf), ["p1", "p2", "p3"], "y")
    return out.select("predictor", "n", *[F.round(c, 8).alias(c) for c in ("pearson", "pearson_p", "spearman", "spearman_p")])


@query("SELECT predictor FROM (SELECT predictor, round(abs(corr(rx, ry)), 9) AS r FROM ranked GROUP BY predictor) ORDER BY r DESC, predictor DESC LIMIT 1", RES, _SERIES, _FITS, _PRED, _RANKS)
def strongest_predictor(spark: SparkSession, sf: str) -> DataFrame:
    corr = analysis.correlations(_predictors(spark, sf), ["p1", "p2", "p3"], "y").withColumn("spearman", F.round("spearman", 9))
    return analysis.strongest_predictor(corr, "p1")


@query("SELECT o_orderkey, rank() OVER (ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY o_totalprice) - 1) / 2.0::DOUBLE AS rank FROM (SELECT o_orderkey, o_custkey, round(o_totalprice, -3) AS o_totalprice FROM orders) WHERE o_custkey % 10 = 3".replace("ORDER BY o_totalprice)", "PARTITION BY o_custkey ORDER BY o_totalprice)").replace("PARTITION BY o_totalprice)", "PARTITION BY o_custkey, o_totalprice)").replace(" WHERE o_custkey % 10 = 3", ""))
def avg_rank(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", "o_custkey", F.round("o_totalprice", -3).alias("v"))
    return analysis.average_rank(rows, "v", "rank", ("o_custkey",)).select("o_orderkey", "rank")


@query("SELECT construction, seed, E0, Emax, round(ln(greatest(E50, 1e-6)), 8) AS log_E50, n FROM fits WHERE converged", RES, _SERIES, _FITS)
def curve_features(spark: SparkSession, sf: str) -> DataFrame:
    return analysis.curve_features(fits(spark, sf)).withColumn("log_E50", F.round("log_E50", 8))


@query("SELECT construction, seed, round((n - avg(n) OVER ()) / stddev_pop(n) OVER (), 8) AS n_z, round((E0 - avg(E0) OVER ()) / stddev_pop(E0) OVER (), 8) AS E0_z FROM fits WHERE converged", RES, _SERIES, _FITS)
def zscore(spark: SparkSession, sf: str) -> DataFrame:
    out = analysis.zscore(analysis.curve_features(fits(spark, sf)), ["n", "E0"])
    return out.select("construction", "seed", F.round("n_z", 8).alias("n_z"), F.round("E0_z", 8).alias("E0_z"))


@query("SELECT round(avg(n), 8) AS mean_n, round(avg((Emax - E0) / nullif(Emax, 0)), 8) AS rel_gain FROM fits WHERE converged", RES, _SERIES, _FITS)
def mean_hill_n(spark: SparkSession, sf: str) -> DataFrame:
    good = fits(spark, sf).where("converged")
    return good.agg(F.round(F.avg("n"), 8).alias("mean_n"), F.round(F.avg(S.relative_gain(F.col("Emax"), F.col("E0"))), 8).alias("rel_gain"))


_SIL = """
pts AS (SELECT construction || '_' || seed AS id, E0, n, (n > 1.5)::INTEGER AS label FROM fits WHERE converged),
near AS (SELECT a.id, a.label, b.label AS l, avg(sqrt((a.E0 - b.E0) * (a.E0 - b.E0) + (a.n - b.n) * (a.n - b.n))) AS d FROM pts a JOIN pts b ON a.id <> b.id GROUP BY 1, 2, 3),
each_ AS (SELECT id, label, max(d) FILTER (WHERE label = l) AS a, min(d) FILTER (WHERE label <> l) AS b FROM near GROUP BY 1, 2)"""


@query("SELECT 2 AS k, round(avg((b - a) / greatest(a, b)), 8) AS silhouette FROM each_", RES, _SERIES, _FITS, _SIL)
def silhouette(spark: SparkSession, sf: str) -> DataFrame:
    p = fits(spark, sf).where("converged").select(F.lit(2).alias("k"), F.concat_ws("_", "construction", "seed").alias("id"), (F.col("n") > 1.5).cast("int").alias("label"), F.array("E0", "n").alias("x"))
    return analysis.silhouette(p).withColumn("silhouette", F.round("silhouette", 8))


@query("SELECT round(1 - sum((y - f) * (y - f)) / (SELECT var_pop(l_tax) * count(*) FROM lineitem), 8) AS r2 FROM (SELECT l_tax AS y, l_discount AS f FROM lineitem)")
def r_squared(spark: SparkSession, sf: str) -> DataFrame:
    y, f = F.col("l_tax"), F.col("l_discount")
    out = spark.read.parquet(f"{sf}/lineitem.parquet").agg(F.sum((y - f) ** 2).alias("s"), (F.var_pop(y) * F.count("*")).alias("t"))
    return out.select(F.round(F.when(F.col("t") > 0, 1 - F.col("s") / F.col("t")).otherwise(0.0), 8).alias("r2"))


@query("SELECT model_construction, dose, seed, eval_construction FROM results r WHERE NOT EXISTS (SELECT 1 FROM results d WHERE d.seed = 42 AND d.model_construction = r.model_construction AND d.dose = r.dose AND d.seed = r.seed AND d.eval_construction = r.eval_construction)", RES)
def resume_anti(spark: SparkSession, sf: str) -> DataFrame:
    keys = ["model_construction", "dose", "seed", "eval_construction"]
    return evaluation.resume(results(spark, sf).select(*keys), results(spark, sf).where("seed = 42"), keys)


@query("SELECT construction, s AS seed, count(*) AS n FROM items CROSS JOIN (VALUES (42), (43), (44)) AS t(s) GROUP BY 1, 2", core._ITEMS)
def seed_replicate(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.seed_replicate(core.items(spark, sf), SEEDS).groupBy("construction", "seed").agg(F.count("*").alias("n"))


def _per_item(spark: SparkSession, sf: str) -> DataFrame:
    """Outcomes of items by cell; some items' sentences are missing."""
    rows = core.cell_items(spark, sf).select(F.col("construction").alias("eval_construction"), F.when(F.length("item_id") % 5 == 0, F.lit("missing")).otherwise(F.col("item_id")).alias("item_id"), (F.length("good_sentence") % 3 > 0).cast("int").alias("correct"))
    return rows.join(core.cells(spark).withColumnRenamed("construction", "eval_construction"), "eval_construction")


_PER = "per_item AS (SELECT construction AS eval_construction, CASE WHEN length(item_id) % 5 = 0 THEN 'missing' ELSE item_id END AS item_id, (length(good_sentence) % 3 > 0)::INTEGER AS correct, dose FROM items CROSS JOIN cells), sentences AS (SELECT p.*, coalesce(i.good_sentence, '') AS sentence FROM per_item p LEFT JOIN items i ON i.construction = p.eval_construction AND i.item_id = p.item_id)"


@query("SELECT eval_construction, item_id, dose, sentence FROM sentences", core._CELLS, core.CELL_ITEMS, _PER)
def item_sentences(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.item_sentences(_per_item(spark, sf), core.cell_items(spark, sf)).select("eval_construction", "item_id", "dose", "sentence")


def _seen(spark: SparkSession, sf: str) -> DataFrame:
    labelled = evaluation.item_sentences(_per_item(spark, sf), core.cell_items(spark, sf)).withColumnRenamed("eval_construction", "construction")
    return evaluation.seen_novel_cells(labelled, V.base(V.records(spark, sf)), core.changes(spark, sf), core.cells(spark))


_CORPORA = (V.RECORDS, V.POSITIVES, core._CELLS, core._KEPT, core._FILLERS, core._CORPUS)
_SEEN = f"vocab AS (SELECT DISTINCT construction, dose, w FROM (SELECT construction, dose, unnest({core.TOK}) AS w FROM corpus) WHERE w NOT IN ({core.STOP1})), hits AS (SELECT DISTINCT s.eval_construction, s.dose, s.item_id FROM (SELECT eval_construction, dose, item_id, unnest(regexp_extract_all(lower(sentence), '[a-z]+(?:''[a-z]+)?')) AS w FROM sentences) s JOIN vocab v ON v.construction = s.eval_construction AND v.dose = s.dose AND v.w = s.w), labelled AS (SELECT s.*, CASE WHEN h.item_id IS NULL THEN 'novel' ELSE 'seen' END AS grp FROM sentences s LEFT JOIN hits h ON h.eval_construction = s.eval_construction AND h.dose = s.dose AND h.item_id = s.item_id)"


@query("SELECT eval_construction AS construction, item_id, dose, grp AS \"group\" FROM labelled", *_CORPORA, core.CELL_ITEMS, _PER, _SEEN)
def seen_novel(spark: SparkSession, sf: str) -> DataFrame:
    return _seen(spark, sf).select("construction", "item_id", "dose", "group")


@query("SELECT c.construction, c.dose, g.grp AS \"group\", count(l.item_id) AS n, round(coalesce(avg(l.correct), 0), 8) AS accuracy, round(coalesce(sqrt(avg(l.correct) * (1 - avg(l.correct)) / count(l.item_id)), 0), 8) AS std_error FROM (SELECT DISTINCT eval_construction AS construction, dose FROM labelled) c CROSS JOIN (VALUES ('seen'), ('novel')) AS g(grp) LEFT JOIN labelled l ON l.eval_construction = c.construction AND l.dose = c.dose AND l.grp = g.grp GROUP BY 1, 2, 3", *_CORPORA, core.CELL_ITEMS, _PER, _SEEN)
def seen_novel_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    out = evaluation.seen_novel_accuracy(_seen(spark, sf))
    return out.select("construction", "dose", "group", "n", F.round("accuracy", 8).alias("accuracy"), F.round("std_error", 8).alias("std_error"))


@query("SELECT event_type AS status, count(*) AS n, min(value) AS lowest, max(value) AS highest, count(*) FILTER (WHERE NOT value BETWEEN 15 AND 40) AS n_out_of_band FROM events GROUP BY 1")
def health_check(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.health_check(spark.read.parquet(f"{sf}/events.parquet").select(F.col("event_type").alias("status"), F.col("value").alias("perplexity")))


@query("SELECT model_construction AS construction, dose, row_number() OVER (ORDER BY dose = 'all', dose, model_construction) AS place FROM (SELECT DISTINCT model_construction, dose FROM results)", RES)
def all_last_order(spark: SparkSession, sf: str) -> DataFrame:
    """The cells of the results, which the design bounds: all comes last, other doses sort as text."""
    from pyspark.sql import Window as W

    found = results(spark, sf).select(F.col("model_construction").alias("construction"), "dose").distinct()
    return found.withColumn("place", F.row_number().over(W.orderBy(S.is_all(F.col("dose")), "dose", "construction")).cast("bigint"))


@query(f"SELECT construction, d.dose, d.dose = 'all' AS is_all, try_cast(d.dose AS INTEGER) AS dose_num, count(r.accuracy) AS n_results FROM ({core._CELL_SQL}) d LEFT JOIN results r ON r.model_construction = construction AND r.dose = d.dose GROUP BY ALL", RES)
def design_cells(spark: SparkSession, sf: str) -> DataFrame:
    """The design's cells, with how many results each has."""
    found = results(spark, sf).groupBy(F.col("model_construction").alias("construction"), "dose").agg(F.count("accuracy").alias("n_results"))
    return DESIGN.cells(spark).join(found, ["construction", "dose"], "left").fillna(0, ["n_results"])


@query(f"SELECT construction, d.dose, s.seed, count(r.accuracy) AS n_results FROM ({core._CELL_SQL}) d CROSS JOIN (VALUES (42), (43), (44)) AS s(seed) LEFT JOIN results r ON r.model_construction = construction AND r.dose = d.dose AND r.seed = s.seed GROUP BY ALL", RES)
def design_runs(spark: SparkSession, sf: str) -> DataFrame:
    """The design's runs, with how many results each has: what is left to do has fewer than test sets."""
    found = results(spark, sf).groupBy(F.col("model_construction").alias("construction"), "dose", "seed").agg(F.count("accuracy").alias("n_results"))
    return DESIGN.runs(spark).select("construction", "dose", "seed").join(found, ["construction", "dose", "seed"], "left").fillna(0, ["n_results"])


@query("SELECT DISTINCT model_construction AS construction, dose, seed, format('ltgbert_{}_D{}_seed{}', model_construction, dose, seed) AS run FROM results", RES)
def run_name(spark: SparkSession, sf: str) -> DataFrame:
    """The names of the runs in the results."""
    runs = results(spark, sf).select(F.col("model_construction").alias("construction"), "dose", "seed").distinct()
    return runs.withColumn("run", S.run_name(F.col("construction"), F.col("dose"), F.col("seed")))


@query("SELECT construction, dose, CASE dose WHEN 'all' THEN n ELSE least(dose::INTEGER, n) END::BIGINT AS expected FROM (SELECT construction, count(*) AS n FROM positives GROUP BY construction) CROSS JOIN cells", V.RECORDS, V.POSITIVES, core._CELLS)
def expected_count(spark: SparkSession, sf: str) -> DataFrame:
    n = V.positives(spark, sf).groupBy("construction").agg(F.count("*").alias("n"))
    return n.join(core.cells(spark), "construction").select("construction", "dose", S.expected_count(F.col("dose"), F.col("n")).alias("expected"))


@query()
def hill_fit(spark: SparkSession, sf: str) -> DataFrame:
    return curves.hill_fit(series(spark, sf))


@query()
def hill_bootstrap(spark: SparkSession, sf: str) -> DataFrame:
    return curves.hill_bootstrap(series(spark, sf))


@query()
def curve_models(spark: SparkSession, sf: str) -> DataFrame:
    return curves.curve_models(series(spark, sf).where("is_core"))


def _clusters(spark: SparkSession, sf: str, ks: tuple[int, ...]) -> DataFrame:
    rows = analysis.zscore(analysis.curve_features(fits(spark, sf)), ["E0", "Emax", "log_E50", "n"]).withColumn("id", F.concat_ws("_", "construction", "seed"))
    return curves.kmeans(rows, ["E0_z", "Emax_z", "log_E50_z", "n_z"], ks)


@query()
def kmeans(spark: SparkSession, sf: str) -> DataFrame:
    return _clusters(spark, sf, (2, 3, 4)).select("k", "id", "label")


@query()
def bootstrap_mean_ci(spark: SparkSession, sf: str) -> DataFrame:
    own = results(spark, sf).where("model_construction = eval_construction").withColumn("cell", F.concat_ws("_", "model_construction", "dose"))
    return analysis.bootstrap_mean_ci(own, "cell", "accuracy")


@query()
def decision(spark: SparkSession, sf: str) -> DataFrame:
    models = analysis.closed_form_models(series(spark, sf).where("is_core")).unionByName(curves.curve_models(series(spark, sf).where("is_core")))
    sil = analysis.silhouette(_clusters(spark, sf, (2,)))
    return analysis.decision(fits(spark, sf), models, results(spark, sf), sil)


@query("SELECT model_construction, dose, seed, eval_construction, accuracy, row_number() OVER (ORDER BY model_construction, dose, seed, eval_construction) AS place FROM results", RES)
def ordered_results(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of the table of results in the order of construction, dose and seed; the design bounds them."""
    from pyspark.sql import Window as W

    return results(spark, sf).withColumn("place", F.row_number().over(W.orderBy("model_construction", "dose", "seed", "eval_construction")).cast("bigint"))


@query("SELECT construction, row_number() OVER (ORDER BY E0 DESC, construction) AS place FROM (SELECT eval_construction AS construction, round(avg(accuracy), 8) AS E0 FROM results WHERE model_construction = eval_construction AND dose = '0' GROUP BY 1)", RES)
def e0_order(spark: SparkSession, sf: str) -> DataFrame:
    """Constructions by their dose-0 accuracy, highest first."""
    from pyspark.sql import Window as W

    out = analysis.indirect_evidence(results(spark, sf), CODES).withColumn("E0", F.round("E0", 8))
    return out.select("construction", F.row_number().over(W.orderBy(F.desc("E0"), "construction")).cast("bigint").alias("place"))


@query("SELECT dose_value FROM series WHERE construction = 'aann' AND NOT isinf(dose_value) INTERSECT SELECT dose_value FROM series WHERE construction = 'resultative'", RES, _SERIES)
def shared_doses(spark: SparkSession, sf: str) -> DataFrame:
    s = series(spark, sf)
    return artefacts.shared_doses(s.where("construction = 'aann'"), s.where("construction = 'resultative'"))


@query("SELECT round(sum(length(text))::DOUBLE / sum(len(regexp_extract_all(text, '\\S+'))), 8) AS chars_per_word FROM (SELECT text FROM records ORDER BY sent_id LIMIT 2000)", V.RECORDS)
def chars_per_word(spark: SparkSession, sf: str) -> DataFrame:
    """The same ratio with characters as tokens, which SQL can express too."""
    out = artefacts.tokens_per_word(V.records(spark, sf).select("sent_id", "text"), F.length("text"), T.space_count(F.col("text")), "sent_id")
    return out.select(F.round("tokens_per_word", 8).alias("chars_per_word"))


@query()
def tokens_per_word(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens of a public byte-level vocabulary by words, over the first 2000 sentences (the operator's sample)."""
    import public_tokenizers

    first = first_rows(V.records(spark, sf).select("sent_id", "text"), ["sent_id"], 2000)
    counted = artefacts.token_counts(first, public_tokenizers.path("byte_bpe_50k.json"))
    return artefacts.tokens_per_word(counted, F.col("n_tokens"), T.space_count(F.col("text")), "sent_id")


@query("SELECT model_construction AS construction, dose, seed, '/models/' || CASE WHEN seed = 44 THEN model_construction || '-dose_' || dose || '-seed-44' ELSE format('ltgbert_{}_D{}_seed{}', model_construction, dose, seed) END AS path, seed <> 44 AS named FROM (SELECT DISTINCT model_construction, dose, seed FROM results) WHERE NOT (dose = '0' AND seed = 43)", RES)
def discover_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Runs in a listing of files, made from the results: canonical and other names, and folders without a configuration."""
    runs = results(spark, sf).select("model_construction", "dose", "seed").distinct()
    c, d, s = (F.col(x) for x in ("model_construction", "dose", "seed"))
    name = F.when(s == 44, F.concat(c, F.lit("-dose_"), d, F.lit("-seed-44"))).otherwise(S.run_name(c, d, s))
    wanted = F.when((d == "0") & (s == 43), F.array(F.lit("model.safetensors"))).otherwise(F.array(F.lit("config.json"), F.lit("model.safetensors")))
    files = runs.select(F.concat(F.lit("/models/"), name).alias("f"), F.explode(wanted).alias("x")).select(F.concat_ws("/", "f", "x").alias("path"))
    return evaluation.runs_in(files, [*CODES, FULL], ["0", "4", "16", "64", "all"], SEEDS)


@query("SELECT construction, dose, n_pairs, n_correct, n_items, n_pairs AS n_pending FROM (SELECT eval_construction AS construction, dose, count(*)::INTEGER AS n_pairs, sum(correct)::INTEGER AS n_correct, count(*) AS n_items FROM per_item GROUP BY ALL) WHERE dose NOT IN ('0', '4') UNION ALL SELECT eval_construction, dose, count(*)::INTEGER, sum(correct)::INTEGER, count(*), 0 FROM per_item WHERE dose IN ('0', '4') GROUP BY ALL", core._CELLS, core.CELL_ITEMS, _PER)
def scored_sink(spark: SparkSession, sf: str) -> DataFrame:
    """Outcomes appended in parts, one append dead between its two writes, and the whole run again: each group is there once."""
    rows = core.cell_items(spark, sf).select("construction", "item_id", (F.length("good_sentence") % 3 > 0).cast("int").alias("correct")).join(core.cells(spark), "construction")
    sink = writers.ScoredSink(spark, scratch_path(spark, "sink"), ["construction", "dose"], "construction string, dose string, item_id string, correct int")
    sink.append(rows.where("dose in ('0', '4')"))
    sink.write_items(rows.where("dose = '16'"))
    pending = written(sink.pending(rows).groupBy("construction", "dose").agg(F.count("*").cast("int").alias("n_pending")), "pending")
    sink.append(rows)
    counts = sink.items().groupBy("construction", "dose").agg(F.count("*").alias("n_items"))
    return sink.groups().join(counts, ["construction", "dose"]).join(pending, ["construction", "dose"], "left").fillna(0, ["n_pending"]).select("construction", "dose", "n_pairs", "n_correct", "n_items", "n_pending")


@query("SELECT o_orderkey, o_orderkey % 4 = 1 AS done FROM orders")
def run_complete(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("o_orderkey") % 4
    manifest = F.when(n == 0, "{cut off").when(n == 1, '{"perplexity": 21.5}').when(n == 2, '{"loss": 3}').otherwise('{"perplexity": "NaN"}')
    return spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", artefacts.run_complete(manifest).alias("done"))


@query(f"SELECT construction || '_dose-' || dose AS cell, count(*) AS n_positive_total, count(*) FILTER (WHERE kept) AS n_kept FROM kept GROUP BY construction, dose", V.RECORDS, V.POSITIVES, core._CELLS, core._KEPT)
def audit_json(spark: SparkSession, sf: str) -> DataFrame:
    """Audits as JSON documents, read again."""
    rows = artefacts.audit_json(core.audits(spark, sf))
    # A document lists all ids of its cell, so it is parsed once for both numbers.
    return rows.select("cell", F.from_json("value", "n_positive_total bigint, n_kept bigint").alias("v")).select("cell", "v.n_positive_total", "v.n_kept")


@query(core.SANITY_SQL.replace("SELECT a.construction, a.dose,", "SELECT a.construction || '_dose-' || a.dose AS cell,", 1), V.RECORDS, V.POSITIVES, core._CELLS, core._KEPT, core._FILLERS, core._CORPUS, core._OBSERVED)
def sanity_json(spark: SparkSession, sf: str) -> DataFrame:
    """The sanity document of all cells, read again."""
    doc = artefacts.sanity_json(core.dose_sanity(spark, sf))
    parsed = doc.select(F.explode(F.from_json("value", "map<string,struct<expected:bigint,observed:bigint,pass:boolean>>")).alias("cell", "v"))
    return parsed.select("cell", "v.expected", "v.observed", "v.pass")


@query("SELECT sent_id AS sentence_id, text AS sentence_text, filter_label, '' AS human_label FROM (SELECT *, row_number() OVER (PARTITION BY filter_label ORDER BY md5('42:' || sent_id), sent_id) AS r FROM flagged) WHERE r <= 200", V.RECORDS, core._LABELLED)
def audit_sheet(spark: SparkSession, sf: str) -> DataFrame:
    return artefacts.audit_sheet(evaluation.audit_sample(core._flagged(spark, sf))).drop("notes")


@query()
def decision_report(spark: SparkSession, sf: str) -> DataFrame:
    return artefacts.report_lines(decision(spark, sf))
