"""Point forecasts for whole panels at every anchor date. Forecast rows are (location, reference_date, h, point).

Expanding refits are cumulative sums: the normal equations of all anchors of a series come from one window pass, and only the small solve per row is numpy.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewell.operators.features import series
from tidewell.operators.joins import label_at_horizon

HORIZONS = (1, 2, 3, 4)


def _horizons(horizons: Sequence[int]):
    return F.explode(F.array(*map(F.lit, horizons))).alias("h")


def forecast_persistence(df: DataFrame, horizons: Sequence[int] = HORIZONS, key: str = "location", date: str = "date", y: str = "y") -> DataFrame:
    """The last known value at each date, for each horizon."""
    last = F.last(y, ignorenulls=True).over(series(key, date).rowsBetween(Window.unboundedPreceding, 0))
    rows = df.select(F.col(key).alias("location"), F.col(date).alias("reference_date"), last.alias("point")).where("point is not null")
    return rows.select("location", "reference_date", _horizons(horizons), "point")


def forecast_ar1(df: DataFrame, horizons: Sequence[int] = HORIZONS, min_n: int = 10, key: str = "location", date: str = "date", y: str = "y") -> DataFrame:
    """First-order autoregression refitted at every date on the rows so far, in window functions only; persistence with fewer than min_n pairs or no slope."""
    so_far = series(key, date).rowsBetween(Window.unboundedPreceding, 0)
    rows = df.withColumn("__x", F.lag(y).over(series(key, date)))
    pair = F.col("__x").isNotNull() & F.col(y).isNotNull()
    x_, y_ = F.when(pair, F.col("__x")), F.when(pair, F.col(y))
    slope = F.try_divide(F.covar_pop(x_, y_).over(so_far), F.var_pop(x_).over(so_far))
    rows = rows.select(F.col(key).alias("location"), F.col(date).alias("reference_date"), F.col(y).alias("__y"), F.count(x_).over(so_far).alias("__n"), slope.alias("__b"), F.avg(x_).over(so_far).alias("__mx"), F.avg(y_).over(so_far).alias("__my"))
    rows = rows.where("__y is not null").withColumn("__a", F.col("__my") - F.col("__b") * F.col("__mx")).select("*", _horizons(horizons))
    ladder = F.aggregate(F.sequence(F.lit(1), F.col("h")), F.col("__y"), lambda v, _: F.col("__a") + F.col("__b") * v)
    return rows.select("location", "reference_date", "h", F.when((F.col("__n") >= min_n) & F.col("__a").isNotNull(), ladder).otherwise(F.col("__y")).alias("point"))


def _gram(df: DataFrame, past: dict[str, object], y: str, key: str, date: str, keep: Sequence) -> DataFrame:
    """For each row `keep`, and the running sums `n`, `xx` (upper triangle of products of the past columns and 1) and `xy`. Rows with a null in `past` or y add
    nothing."""
    names = list(past)
    df = df.withColumns({f"__p{i}": e for i, e in enumerate(past.values())})
    columns = [F.lit(1.0), *(F.col(f"__p{i}") for i in range(len(names)))]
    fine = F.col(y).isNotNull()
    for c in columns[1:]:
        fine = fine & c.isNotNull()
    so_far = series(key, date).rowsBetween(Window.unboundedPreceding, 0)

    def running(e):
        return F.sum(F.when(fine, e).otherwise(0.0)).over(so_far)

    xx = F.array(*(running(columns[i] * columns[j]) for i in range(len(columns)) for j in range(i, len(columns))))
    xy = F.array(*(running(c * F.col(y)) for c in columns))
    return df.select(*keep, running(F.lit(1.0)).alias("n"), xx.alias("xx"), xy.alias("xy"))


def solve(xx: np.ndarray, xy: np.ndarray, ridge: float) -> np.ndarray:
    """Coefficients (rows, k) of the ridge solutions for upper triangles xx (rows, k (k + 1) / 2) and xy (rows, k). The penalty is relative to the mean diagonal
    of each row; the intercept, first, has none."""
    k = xy.shape[1]
    full = np.zeros((len(xy), k, k))
    i, j = np.triu_indices(k)
    full[:, i, j] = full[:, j, i] = xx
    scale = np.maximum(np.einsum("rkk->rk", full)[:, 1:], 1e-12)
    full[:, np.arange(1, k), np.arange(1, k)] += ridge * scale
    full[:, 0, 0] = np.maximum(full[:, 0, 0], 1e-12)
    return np.einsum("rij,rj->ri", np.linalg.pinv(full, hermitian=True), xy)


def determined(xx: np.ndarray, k: int, least: float = 1e-6) -> np.ndarray:
    """Which rows' sums tell the coefficients apart without a penalty: each column varies, and the determinant of their correlations is above `least`."""
    full = np.zeros((len(xx), k, k))
    i, j = np.triu_indices(k)
    full[:, i, j] = full[:, j, i] = xx
    mean = full[:, 0, 1:] / np.maximum(full[:, :1, 0], 1e-12)
    spread = full[:, 1:, 1:] / np.maximum(full[:, :1, :1], 1e-12) - mean[:, :, None] * mean[:, None, :]
    own = np.einsum("rkk->rk", spread)
    varies = (own > least * (1 + mean * mean)).all(axis=1)
    root = np.sqrt(np.where(varies[:, None], own, 1.0))
    return varies & (np.linalg.det(np.where(varies[:, None, None], spread, np.eye(k - 1)) / root[:, :, None] / root[:, None, :]) > least)


def forecast_ar(df: DataFrame, p: int = 2, horizons: Sequence[int] = HORIZONS, ridge: float = 1e-8, log: bool = False, min_n: int = 10, key: str = "location", date: str = "date", y: str = "y") -> DataFrame:
    """Autoregression of order p refitted at every date; on log(y + 1) if `log`; persistence with fewer than min_n + p fitted rows, and, without
    a penalty, where these don't determine the coefficients. Values are not negative."""
    df = df.withColumn(y, F.log1p(F.greatest(F.col(y), F.lit(0.0))) if log else F.col(y))
    w = series(key, date)
    past = {f"lag{k}": F.lag(y, k).over(w) for k in range(1, p + 1)}
    now = F.array(*(F.lag(y, k).over(w) if k else F.col(y) for k in range(p)))
    df = df.withColumn("__now", now)
    sums = _gram(df, past, y, key, date, [F.col(key).alias("location"), F.col(date).alias("reference_date"), F.col("__now").alias("now")]).where(F.col("now")[0].isNotNull())
    steps = max(horizons)

    def ahead(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            now = np.array([[np.nan if v is None else v for v in x] for x in b.now], float)
            coef = solve(np.stack(b.xx.to_numpy()), np.stack(b.xy.to_numpy()), ridge)
            known = (b.n.to_numpy() >= min_n + p) & ~np.isnan(now).any(axis=1)
            if not ridge:
                known &= determined(np.stack(b.xx.to_numpy()), p + 1)
            path, state = np.zeros((len(b), steps)), now.copy()
            for h in range(steps):
                path[:, h] = coef[:, 0] + (coef[:, 1:] * state).sum(axis=1)
                state = np.column_stack([path[:, h], state[:, :-1]])
            path = np.where(known[:, None], path, now[:, :1])
            path = np.maximum(np.expm1(np.minimum(path, 50.0)) if log else path, 0.0)
            for h in horizons:
                yield pd.DataFrame({"location": b.location, "reference_date": b.reference_date, "h": h, "point": path[:, h - 1]})

    return sums.mapInPandas(ahead, "location string, reference_date date, h int, point double")


def select_order(df: DataFrame, candidates: Sequence[int] = (1, 2, 3), min_rows: int = 20, default: int = 1, ridge: float = 1e-8, key: str = "location", date: str = "date", y: str = "y") -> DataFrame:
    """(location, p): the order of least mean absolute one-step error over the first half of each series; `default` with fewer than min_rows rows."""
    from tidewell.operators.select import split_half

    half = split_half(df, key, date).where("half = 1").drop("half")
    truth = half.select(F.col(key).alias("location"), F.date_sub(date, 7).alias("reference_date"), F.col(y).alias("obs")).where("obs is not null")
    errors = None
    for p in candidates:
        e = forecast_ar(half, p, (1,), ridge, key=key, date=date, y=y).join(truth, ["location", "reference_date"]).select("location", F.lit(p).alias("p"), F.abs(F.col("obs") - F.col("point")).alias("e"))
        errors = e if errors is None else errors.unionByName(e)
    best = errors.groupBy("location", "p").agg(F.avg("e").alias("e")).groupBy("location").agg(F.min_by("p", F.struct(F.round("e", 9), "p")).alias("best"))
    sizes = df.groupBy(F.col(key).alias("location")).agg(F.count(y).alias("n"))
    return sizes.join(best, "location", "left").select("location", F.when(F.col("n") >= min_rows, F.coalesce("best", F.lit(default))).otherwise(default).alias("p"))


def with_covariates(df: DataFrame, selected: DataFrame, k: int = 3, key: str = "location", date: str = "date", y: str = "y") -> DataFrame:
    """df with x1 to xk, the values on the same date of the series' covariate locations in `selected` (target, covariate, rank); 0 where there is none."""
    other = df.select(F.col(key).alias("covariate"), F.col(date), F.col(y).alias("__x"))
    pairs = selected.where(F.col("rank") <= k).select(F.col("target").alias(key), "covariate", "rank").join(other, "covariate")
    wide = pairs.groupBy(key, date).agg(*(F.max(F.when(F.col("rank") == r, F.col("__x"))).alias(f"x{r}") for r in range(1, k + 1)))
    return df.join(wide, [key, date], "left").fillna(0.0, subset=[f"x{r}" for r in range(1, k + 1)])


def forecast_linear(df: DataFrame, features: Sequence[str], horizons: Sequence[int] = HORIZONS, ridge: float = 1e-3, min_n: int = 25, key: str = "location", date: str = "date", y: str = "y") -> DataFrame:
    """Direct ridge regression of y on the features h rows before, refitted at every date on labels known by then; persistence with fewer than min_n rows, and,
    without a penalty, where these don't determine the coefficients."""
    out = None
    w = series(key, date)
    for h in horizons:
        past = {f: F.lag(f, h).over(w) for f in features}
        keep = [F.col(key).alias("location"), F.col(date).alias("reference_date"), F.col(y).alias("last"), F.array(*(F.col(f).cast("double") for f in features)).alias("now")]
        sums = _gram(df, past, y, key, date, keep).where("last is not null")

        def direct(batches: Iterator[pd.DataFrame], h: int = h) -> Iterator[pd.DataFrame]:
            for b in batches:
                if not len(b):
                    continue
                now = np.array([[np.nan if v is None else v for v in x] for x in b.now], float)
                coef = solve(np.stack(b.xx.to_numpy()), np.stack(b.xy.to_numpy()), ridge)
                value = coef[:, 0] + (coef[:, 1:] * now).sum(axis=1)
                known = (b.n.to_numpy() >= min_n) & np.isfinite(value)
                if not ridge:
                    known &= determined(np.stack(b.xx.to_numpy()), len(features) + 1)
                point = np.maximum(np.where(known, value, b["last"].to_numpy()), 0.0)
                yield pd.DataFrame({"location": b.location, "reference_date": b.reference_date, "h": h, "point": point})

        one = sums.mapInPandas(direct, "location string, reference_date date, h int, point double")
        out = one if out is None else out.unionByName(one)
    return out


def _vectors(df: DataFrame, features: Sequence[str]) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    filled = df.fillna(0.0, subset=[f for f, t in df.dtypes if f in features and t == "double"])
    return VectorAssembler(inputCols=list(features), outputCol="__x", handleInvalid="keep").transform(filled)


def forecast_trees_mu(df: DataFrame, features: Sequence[str], h: int, cutoff, trees: int = 20, depth: int = 4, seed: int = 1, location_index: bool = True, key: str = "location", date: str = "date", y: str = "y") -> DataFrame:
    """One boosted-tree model of all series for y at h weeks, fitted on labels known by the cut-off, applied to every row: df with `mu` and, where known, `label`
    and `label_date`. location_index: the series' place by name among all is a feature (one row for each series is counted)."""
    from pyspark.ml.feature import StringIndexer
    from pyspark.ml.regression import GBTRegressor

    if location_index:
        df = StringIndexer(inputCol=key, outputCol="__location", stringOrderType="alphabetAsc", handleInvalid="keep").fit(df.select(key)).transform(df)
        features = [*features, "__location"]

    labels = label_at_horizon(df.select(key, date, y), (h,), key, date, y).select(key, date, "label", "label_date")
    rows = _vectors(df, features).join(labels, [key, date], "left")
    train = rows.where((F.col("label_date") <= F.lit(cutoff).cast("date")) & F.col("label").isNotNull())
    bins = max(32, df.select("__location").distinct().count() + 1) if location_index else 32  # a tree cuts between any two series only if it has so many bins
    model = GBTRegressor(maxBins=bins, featuresCol="__x", labelCol="label", predictionCol="mu", maxIter=trees, maxDepth=depth, seed=seed).fit(train)
    return model.transform(rows)


def fit_scale(rows: DataFrame, cutoff, ridge: float = 0.1) -> DataFrame:
    """Adds `sigma` to forecast_trees_mu() rows with mu fixed: a linear model of log squared residuals known by the cut-off; sigma is at least 1e-6. The mean
    log of a chi-square of one degree is -1.2704."""
    from pyspark.ml.regression import LinearRegression

    rows = rows.withColumn("__e", F.ln((F.col("label") - F.col("mu")) * (F.col("label") - F.col("mu")) + 1e-6))
    train = rows.where((F.col("label_date") <= F.lit(cutoff).cast("date")) & F.col("__e").isNotNull())
    model = LinearRegression(featuresCol="__x", labelCol="__e", predictionCol="__v", regParam=ridge).fit(train)
    return model.transform(rows).withColumn("sigma", F.greatest(F.exp((F.least(F.col("__v"), F.lit(60.0)) + 1.2704) / 2), F.lit(1e-6))).drop("__v", "__e")


def forecast_two_stage(df: DataFrame, features: Sequence[str], cutoff, horizons: Sequence[int] = HORIZONS, trees: int = 20, key: str = "location", date: str = "date", y: str = "y") -> DataFrame:
    """(location, reference_date, h, mu, sigma, quantiles) for anchors from the cut-off on: trees for mu, then a model of the scale around it."""
    from tidewell.functions.numeric import gaussian_array

    out = None
    for h in horizons:
        rows = fit_scale(forecast_trees_mu(df, features, h, cutoff, trees, key=key, date=date, y=y), cutoff).where(F.col(date) >= F.lit(cutoff).cast("date"))
        one = rows.select(F.col(key).alias("location"), F.col(date).alias("reference_date"), F.lit(h).alias("h"), "mu", "sigma", gaussian_array(F.col("mu"), F.col("sigma")).alias("quantiles"))
        out = one if out is None else out.unionByName(one)
    return out


def calibrate_bias_blend(rows: DataFrame, by: Sequence[str] = ("location", "h"), step: float = 0.05, min_bias: int = 5, min_n: int = 20) -> DataFrame:
    """Of rows (point, last, obs): `bias`, the median of obs - point (0 with fewer than min_bias), and `alpha`, the blend alpha * (point + bias) + (1 - alpha) * last of least
    mean absolute error over 0, step, ... 1 (the smallest of equal ones; 1 with fewer than min_n)."""
    bias = rows.groupBy(*by).agg(F.count("*").alias("n"), F.when(F.count("*") >= min_bias, F.percentile(F.col("obs") - F.col("point"), F.lit(0.5))).otherwise(0.0).alias("bias"))
    n = round(1 / step)
    alphas = F.array(*(F.lit(k / n) for k in range(n + 1)))
    tried = rows.join(bias, list(by)).withColumn("alpha", F.explode(alphas))
    error = F.abs(F.col("alpha") * (F.col("point") + F.col("bias")) + (1 - F.col("alpha")) * F.col("last") - F.col("obs"))
    scores = tried.groupBy(*by, "alpha").agg(F.round(F.avg(error), 9).alias("mae"))
    best = scores.groupBy(*by).agg(F.min_by("alpha", F.struct("mae", "alpha")).alias("best"))
    return bias.join(best, list(by)).select(*by, "n", "bias", F.when(F.col("n") >= min_n, F.col("best")).otherwise(1.0).alias("alpha"))


def tune(df: DataFrame, grid: Sequence[dict], cutoff, horizons: Sequence[int] = (1,), key: str = "location", date: str = "date", y: str = "y") -> DataFrame:
    """(location, params, mae): of the autoregression settings in the grid (p, ridge, log) the one of least rolling-origin error on anchors up to the cut-off."""
    truth = df.select(F.col(key).alias("location"), F.col(date).alias("__t"), F.col(y).alias("obs")).where("obs is not null")
    out = None
    for k, params in enumerate(grid):
        fc = forecast_ar(df, horizons=horizons, key=key, date=date, y=y, **params).withColumn("__t", F.date_add("reference_date", F.col("h") * 7)).where(F.col("__t") <= F.lit(cutoff).cast("date"))
        e = fc.join(truth, ["location", "__t"]).groupBy("location").agg(F.avg(F.abs(F.col("obs") - F.col("point"))).alias("mae"))
        e = e.select("location", F.lit(k).alias("k"), F.create_map(*(F.lit(x) for n, v in params.items() for x in (n, float(v)))).alias("params"), "mae")
        out = e if out is None else out.unionByName(e)
    return out.groupBy("location").agg(F.min_by("params", F.struct(F.round("mae", 9), "k")).alias("params"), F.min("mae").alias("mae"))
