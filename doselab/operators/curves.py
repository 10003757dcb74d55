"""Iterative fits: bounded saturating curves, their bootstrap, power laws, k-means. Small groups, numpy in Arrow groups."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PARAMETERS = ["E0", "Emax", "E50", "n"]
#: Bounds of the parameters, draws of the bootstrap.
LOWER, UPPER, DRAWS = np.array([0, 0, 1e-6, 1e-3]), np.array([1, 1, np.inf, 50.0]), 1000
FIT_SCHEMA = "construction string, seed int, is_core boolean, E0 double, Emax double, E50 double, n double, r_squared double, converged boolean"
CI_SCHEMA = "construction string, seed int, " + ", ".join(f"{p}_lo double, {p}_hi double" for p in PARAMETERS) + ", draws int"


def hill_curve(d: np.ndarray, p: np.ndarray) -> np.ndarray:
    low, top, half, n = p
    out = np.full(len(d), low, float)
    some = d > 0
    with np.errstate(over="ignore"):
        out[some] = low + (top - low) / (1 + np.exp(n * (np.log(half) - np.log(d[some]))))
    return out


def _jacobian(f, d: np.ndarray, p: np.ndarray, lower: np.ndarray, upper: np.ndarray) -> np.ndarray:
    out = np.empty((len(d), len(p)))
    for k in range(len(p)):
        h = 1e-6 * max(1.0, abs(p[k]))
        a, b = p.copy(), p.copy()
        a[k], b[k] = max(lower[k], p[k] - h), min(upper[k], p[k] + h)
        out[:, k] = (f(d, b) - f(d, a)) / (b[k] - a[k])
    return out


def least_squares(f, d: np.ndarray, y: np.ndarray, start: np.ndarray, lower: np.ndarray, upper: np.ndarray, steps: int = 300) -> tuple[np.ndarray, float]:
    """Levenberg-Marquardt with projection onto the bounds. Returns parameters and the sum of squares."""
    p = np.clip(np.asarray(start, float), lower, upper)
    cost, damp = float(((f(d, p) - y) ** 2).sum()), 1e-3
    for _ in range(steps):
        j, r = _jacobian(f, d, p, lower, upper), f(d, p) - y
        free = ~(((p <= lower) & (j.T @ r > 0)) | ((p >= upper) & (j.T @ r < 0)))
        if not free.any() or not np.isfinite(j).all():
            break
        a, g = j[:, free].T @ j[:, free], j[:, free].T @ r
        moved = False
        for _ in range(12):
            try:
                step = np.linalg.solve(a + damp * (np.diag(np.diag(a)) + 1e-12 * np.eye(len(g))), -g)
            except np.linalg.LinAlgError:
                damp *= 10
                continue
            q = p.copy()
            q[free] = np.clip(p[free] + step, lower[free], upper[free])
            new = float(((f(d, q) - y) ** 2).sum())
            if np.isfinite(new) and new < cost:
                moved, gain = True, cost - new
                p, cost, damp = q, new, max(damp / 5, 1e-12)
                break
            damp *= 4
        if not moved or gain < 1e-15 * (1 + cost):
            break
    return p, cost


def fit_hill(d: np.ndarray, y: np.ndarray, starts: list[np.ndarray] | None = None) -> tuple[np.ndarray, float] | None:
    """The best of several starts; None with under four finite points."""
    if len(d) < 4 or not (np.isfinite(d).all() and np.isfinite(y).all()):
        return None
    if starts is None:
        positive = np.sort(d[d > 0])
        middle = (y.min() + y.max()) / 2
        at = [x for x, v in sorted(zip(d, y, strict=True)) if x > 0 and v >= middle]
        halves = {float(at[0]) if at else 1.0, *(float(np.exp(v)) for v in (np.linspace(np.log(positive[0]), np.log(positive[-1]), 5) if len(positive) else []))}
        starts = [np.array([y[d.argmin()], y.max(), h, n]) for h in sorted(halves) for n in (1.0, 0.5, 3.0)]
    return min((least_squares(hill_curve, d, y, s, LOWER, UPPER) for s in starts), key=lambda t: t[1])


def _r2(y: np.ndarray, cost: float) -> float:
    total = float(((y - y.mean()) ** 2).sum())
    return 1 - cost / total if total > 0 else 0.0


def hill_fit(series: DataFrame) -> DataFrame:
    """One fit per (construction, seed). series: construction, seed, dose_value, accuracy, is_core.

    Ladders that are not core, or too short, give their first and last accuracy (by dose) and no fit.
    """

    def one(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("dose_value")
        d, y = g.dose_value.to_numpy(float), g.accuracy.to_numpy(float)
        core = bool(g.is_core.iloc[0])
        row = {"construction": g.construction.iloc[0], "seed": g.seed.iloc[0], "is_core": core, "E0": y[0], "Emax": y[-1], "E50": None, "n": None, "r_squared": None, "converged": False}
        found = fit_hill(d, y) if core else None
        if found:
            p, cost = found
            row |= dict(zip(PARAMETERS, p.tolist(), strict=True)) | {"r_squared": _r2(y, cost), "converged": True}
        elif core:
            row |= {"E0": None, "Emax": None}
        return pd.DataFrame([row])

    return series.groupBy("construction", "seed").applyInPandas(one, FIT_SCHEMA)


def hill_bootstrap(series: DataFrame, draws: int = DRAWS, parts: int = 8) -> DataFrame:
    """Percentile intervals from residual resamples onto the fit; draws are dealt out, each with its own seed."""

    def refit(g: pd.DataFrame) -> pd.DataFrame:
        first = g[g.draw == g.draw.iloc[0]].sort_values("dose_value")
        d, y = first.dose_value.to_numpy(float), first.accuracy.to_numpy(float)
        found = fit_hill(d, y)
        rows = []
        for draw in sorted(g.draw.unique()) if found else []:
            p, _ = found
            fitted = hill_curve(d, p)
            rng = np.random.default_rng([42, zlib.crc32(g.construction.iloc[0].encode()), int(g.seed.iloc[0]), int(draw)])
            again = np.clip(fitted + rng.choice(y - fitted, len(d)), 0, 1)
            q, cost = fit_hill(d, again, [p])
            if np.isfinite(cost):
                rows.append([g.construction.iloc[0], g.seed.iloc[0], *q.tolist()])
        return pd.DataFrame(rows, columns=["construction", "seed", *PARAMETERS])

    core = series.where("is_core").crossJoin(series.sparkSession.range(draws).withColumnRenamed("id", "draw")).withColumn("part", F.col("draw") % parts)
    fits = core.groupBy("construction", "seed", "part").applyInPandas(refit, "construction string, seed int, E0 double, Emax double, E50 double, n double")
    aggs = [F.percentile(p, q).alias(f"{p}_{side}") for p in PARAMETERS for side, q in (("lo", 0.025), ("hi", 0.975))]
    return fits.groupBy("construction", "seed").agg(*aggs, F.count("*").cast("int").alias("draws"))


def curve_models(series: DataFrame) -> DataFrame:
    """construction, seed, model, n_params, loglik, aic, bic, converged of the saturating curve and the power law."""

    def one(g: pd.DataFrame) -> pd.DataFrame:
        d, y = g.dose_value.to_numpy(float), g.accuracy.to_numpy(float)
        ok = np.isfinite(d)
        d, y = d[ok], y[ok]
        out = []
        if len(d) >= 4:
            wide = np.full(3, np.inf)
            power = min((least_squares(lambda x, p: p[0] * np.power(x + 1, p[1]) + p[2], d, y, np.array([a, b, y.min()]), -wide, wide) for a, b in ((0.1, 0.5), (0.1, 0.1), (-0.5, -0.5))), key=lambda t: t[1])
            for model, found, k in (("hill", fit_hill(d, y), 4), ("power", power, 3)):
                rss = max(found[1], 0.0) or 1e-12
                ll = -len(y) / 2 * (np.log(2 * np.pi * rss / len(y)) + 1)
                out.append([g.construction.iloc[0], g.seed.iloc[0], model, k + 1, ll, 2 * (k + 1) - 2 * ll, (k + 1) * np.log(len(y)) - 2 * ll, bool(np.isfinite(ll))])
        return pd.DataFrame(out, columns=["construction", "seed", "model", "n_params", "loglik", "aic", "bic", "converged"])

    return series.groupBy("construction", "seed").applyInPandas(one, "construction string, seed int, model string, n_params int, loglik double, aic double, bic double, converged boolean")


def kmeans(features: DataFrame, columns: list[str], ks: tuple[int, ...] = (2, 3, 4), restarts: int = 10, seed: int = 0) -> DataFrame:
    """k, id, label, x: the labelling of least cost over restarts; label -1 where there are not more rows than k.

    features: id and the columns. One row a fitted curve: the table is small, each k and restart is a Spark job.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    rows = VectorAssembler(inputCols=columns, outputCol="features").transform(features).select("id", "features").persist()
    n, out = rows.count(), None
    for k in ks:
        if n <= k:
            part = rows.select(F.lit(k).alias("k"), "id", F.lit(-1).alias("label"), vector_to_array("features").alias("x"))
        else:
            models = [KMeans(k=k, seed=seed + r, initMode="random" if r % 2 else "k-means||").fit(rows) for r in range(restarts)]
            best = min(models, key=lambda m: m.summary.trainingCost)
            part = best.transform(rows).select(F.lit(k).alias("k"), "id", F.col("prediction").alias("label"), vector_to_array("features").alias("x"))
        out = part if out is None else out.unionByName(part)
    # The models are fitted; the labels read the rows of the input again.
    rows.unpersist()
    return out
