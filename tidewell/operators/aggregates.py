"""Grouped statistics, small regressions, pivots and covariate ranking."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewell.functions.numeric import LEVELS


def geo_mean(df: DataFrame, value: str, by: Sequence[str], within: str | None = None, name: str = "geo_mean") -> DataFrame:
    """exp of the mean log of positive finite values; with `within`, of the means inside each of its groups. Groups without such a value give null."""
    if within:
        df = df.groupBy(*by, within).agg(F.avg(value).alias(value))
    fine = F.when((F.col(value) > 0) & ~F.isnan(value) & (F.col(value) < float("inf")), F.ln(value))
    return df.groupBy(*by).agg(F.exp(F.avg(fine)).alias(name))


def weighted_mean(df: DataFrame, v: str, w: str, by: Sequence[str], name: str = "value") -> DataFrame:
    """Mean weighted by the positive weights; the plain mean where a group has none."""
    use = (F.col(w) > 0) & F.col(v).isNotNull()
    total = F.sum(F.when(use, F.col(w)))
    return df.groupBy(*by).agg(F.coalesce(F.try_divide(F.sum(F.when(use, F.col(v) * F.col(w))), total), F.avg(v)).alias(name))


def fit_lm(df: DataFrame, y: str, x: str, by: Sequence[str] | str | None = None) -> DataFrame:
    """Least squares y = intercept + slope x, of each group or of all rows: n, intercept, slope, r2 and the slope's t value (n - 2 degrees of freedom)."""
    keys = [by] if isinstance(by, str) else list(by or [])
    y_, x_ = F.col(y).cast("double"), F.col(x).cast("double")
    out = df.groupBy(*keys).agg(
        F.regr_count(y_, x_).alias("n"),
        F.regr_intercept(y_, x_).alias("intercept"),
        F.regr_slope(y_, x_).alias("slope"),
        F.regr_r2(y_, x_).alias("r2"),
        F.regr_sxx(y_, x_).alias("sxx"),
        F.regr_syy(y_, x_).alias("syy"),
        F.regr_sxy(y_, x_).alias("sxy"),
    )
    left = F.greatest(F.col("syy") - F.try_divide(F.col("sxy") * F.col("sxy"), F.col("sxx")), F.lit(0.0))
    error = F.sqrt(F.try_divide(left, F.col("n") - 2) / F.col("sxx"))
    return out.withColumn("t_value", F.when(F.col("n") > 2, F.try_divide(F.col("slope"), error))).drop("sxx", "syy", "sxy")


def fit_lm_pooled(df: DataFrame, y: str, x: str) -> DataFrame:
    """fit_lm() over all rows, with the slope's two-sided p-value (Student's t with n - 2 degrees of freedom) by the normal solver of MLlib."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    known = df.select(F.col(y).cast("double").alias("__y"), F.col(x).cast("double").alias("__x")).where(F.col("__y").isNotNull() & F.col("__x").isNotNull())
    rows = VectorAssembler(inputCols=["__x"], outputCol="__v").transform(known)
    summary = LinearRegression(featuresCol="__v", labelCol="__y", solver="normal").fit(rows).summary
    return fit_lm(df, y, x).withColumn("p_value", F.lit(float(summary.pValues[0])))


def predict_lm(df: DataFrame, model: DataFrame, x: str, back: str | None = None) -> DataFrame:
    """Adds `pred` by a one-row model; back='exp-1': max(0, round(exp(pred) - 1, 2))."""
    out = df.crossJoin(F.broadcast(model.select("intercept", "slope")))  # one row
    pred = F.col("intercept") + F.col("slope") * F.col(x)
    if back == "exp-1":
        pred = F.greatest(F.lit(0.0), F.round(F.exp(pred) - 1, 2))
    return out.withColumn("pred", pred).drop("intercept", "slope")


def availability(df: DataFrame, key: str = "location", date: str = "date", y: str = "y") -> DataFrame:
    return df.groupBy(key).agg(F.min(date).alias("first_date"), F.max(date).alias("last_date"), F.count(y).alias("weeks"))


def pivot_locations(df: DataFrame, locations: Sequence[str], key: str = "location", date: str = "date", y: str = "y") -> DataFrame:
    """A column for each of the given locations; repeated values are averaged."""
    return df.groupBy(date).pivot(key, list(locations)).agg(F.avg(y))


def unpivot_locations(wide: DataFrame, key: str = "location", date: str = "date", y: str = "y") -> DataFrame:
    return wide.unpivot(date, [c for c in wide.columns if c != date], key, y)


def quantile_vectors(fc: DataFrame, by: Sequence[str]) -> DataFrame:
    """`quantiles`: the values of each forecast in order of level."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col("output_type_id").alias("q"), F.col("value").alias("v"))))
    return fc.groupBy(*by).agg(F.transform(pairs, lambda p: p["v"]).alias("quantiles"), F.transform(pairs, lambda p: p["q"]).alias("levels"))


def nearest_levels(fc: DataFrame, by: Sequence[str], levels: dict[str, float]) -> DataFrame:
    """A column for each name: the value at the level nearest to the given one (the lower of two as near)."""
    return fc.groupBy(*by).agg(*(F.min_by("value", F.struct(F.round(F.abs(F.col("output_type_id") - q), 9), "output_type_id")).alias(n) for n, q in levels.items()))


def forecast_summary(rows: DataFrame, key: str = "location") -> DataFrame:
    """Of rows (location, date, obs, model_median, baseline_median): n, mean and population deviation of obs, means of the medians, first and last date."""
    return rows.groupBy(key).agg(
        F.count("*").alias("n_forecasts"),
        F.avg("obs").alias("actual_mean"),
        F.stddev_pop("obs").alias("actual_std"),
        F.avg("model_median").alias("model_median_mean"),
        F.avg("baseline_median").alias("baseline_median_mean"),
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
    )


def prospective_summary(fc: DataFrame, levels: Sequence[float] = LEVELS) -> DataFrame:
    """(location, forecast_date, target_date, horizon, mu, sigma, median_forecast, lower_95, upper_95) of forecasts (location, reference_date, h, mu, sigma, quantiles): the
    median and the values at levels 0.025 and 0.975. `horizon` is h."""
    at = lambda q: F.get("quantiles", F.lit(list(levels).index(q)))
    ahead = F.date_add("reference_date", (F.col("h") * 7).cast("int"))
    return fc.select("location", F.col("reference_date").alias("forecast_date"), ahead.alias("target_date"), F.col("h").alias("horizon"), "mu", "sigma", at(0.5).alias("median_forecast"), at(0.025).alias("lower_95"), at(0.975).alias("upper_95"))


def error_statistics(errors: DataFrame, by: Sequence[str] = ("location", "h")) -> DataFrame:
    return errors.groupBy(*by).agg(F.avg("error").alias("mean"), F.stddev_pop("error").alias("std"), F.count("error").alias("n"))


def median_bias(residuals: DataFrame, by: Sequence[str] = ("location", "h"), min_n: int = 5) -> DataFrame:
    """`bias`: the median residual, 0 with fewer than min_n."""
    return residuals.groupBy(*by).agg(F.when(F.count("error") >= min_n, F.percentile("error", F.lit(0.5))).otherwise(0.0).alias("bias"))


def percentiles(df: DataFrame, value: str, levels: Sequence[float], by: Sequence[str], name: str = "quantiles") -> DataFrame:
    """Exact percentiles with linear interpolation, an array of all levels."""
    return df.groupBy(*by).agg(F.percentile(value, F.array(*map(F.lit, levels))).alias(name))


def rank_covariates(pairs: DataFrame, method: str = "corr", k: int = 3, bins: int = 8) -> DataFrame:
    """(target, covariate, score, rank) of the best k covariates of each target, from joins.covariate_join rows. `corr`: absolute correlation; `mi`: mutual
    information of the pair's values in `bins` equal-width bins."""
    if method == "corr":
        score = F.abs(F.try_divide(F.covar_pop("x", "y"), F.stddev_pop("x") * F.stddev_pop("y")))  # null for a constant series
        scored = pairs.groupBy("target", "covariate").agg(F.round(score, 9).alias("score"))  # rounded: equal scores stay ties
    elif method == "mi":
        keys = ["target", "covariate"]
        ends = pairs.groupBy(*keys).agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.count("*").alias("n"))

        def level(v: str):
            return F.least(F.coalesce(F.floor(F.try_divide(F.col(v) - F.col(f"{v}0"), F.col(f"{v}1") - F.col(f"{v}0")) * bins), F.lit(0)), F.lit(bins - 1)).alias(f"b{v}")

        cells = pairs.join(ends, keys).select(*keys, "n", level("x"), level("y")).groupBy(*keys, "n", "bx", "by").agg(F.count("*").alias("nxy"))
        cells = cells.withColumn("nx", F.sum("nxy").over(Window.partitionBy(*keys, "bx"))).withColumn("ny", F.sum("nxy").over(Window.partitionBy(*keys, "by")))
        part = F.col("nxy") / F.col("n") * F.ln(F.col("nxy") * F.col("n") / (F.col("nx") * F.col("ny")))
        scored = cells.groupBy(*keys).agg(F.round(F.sum(part), 9).alias("score"))
    else:
        raise ValueError(method)
    rank = F.row_number().over(Window.partitionBy("target").orderBy(F.desc_nulls_last("score"), "covariate"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def standardise(df: DataFrame, cols: Sequence[str], mode: str = "expanding", key: str = "location", date: str = "date", train: str | None = None) -> DataFrame:
    """Adds <col>_z = (value - mean) / population deviation, 0 for a zero deviation. `expanding`: of the rows so far; `train`: of the rows where the boolean column
    `train` holds, applied to all."""
    if mode == "expanding":
        w = Window.partitionBy(key).orderBy(date).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumns({f"{c}_z": F.coalesce(F.try_divide(F.col(c) - F.avg(c).over(w), F.stddev_pop(c).over(w)), F.lit(0.0)) for c in cols})
    stats = df.where(F.col(train)).groupBy(key).agg(*(f(c).alias(f"__{n}_{c}") for c in cols for n, f in (("m", F.avg), ("s", F.stddev_pop))))
    out = df.join(stats, key, "left")
    return out.withColumns({f"{c}_z": F.coalesce(F.try_divide(F.col(c) - F.col(f"__m_{c}"), F.col(f"__s_{c}")), F.lit(0.0)) for c in cols}).drop(*(f"__{n}_{c}" for c in cols for n in "ms"))
