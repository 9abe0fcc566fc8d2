"""Scores of quantile forecasts. Interval scores are expressions over the array of quantiles: no shuffle beyond the one that collects it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions.numeric import LEVELS
from tidewell.operators.aggregates import geo_mean, quantile_vectors
from tidewell.operators.joins import attach_truth

MEDIAN = LEVELS.index(0.5)
#: How often a level's interval enters the log score: levels that meet their mirror image only up to rounding count twice (fixed values).
TWICE = (0.01, 0.025, 0.05, 0.1, 0.15, 0.2, 0.3, 0.45)


def _sum(terms: Sequence[Column]) -> Column:
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return out


def _interval(q: Column, y: Column, k: int, factor: float) -> tuple[Column, Column, Column]:
    """Width, and factor times how far y lies below and above, of the interval of level k and its mirror."""
    lo, hi = F.get(q, F.lit(k)), F.get(q, F.lit(len(LEVELS) - 1 - k))
    return hi - lo, F.greatest(F.lit(0.0), lo - y) * factor, F.greatest(F.lit(0.0), y - hi) * factor


def wis_column(q: Column, y: Column, variant: str = "weighted_sum") -> Column:
    """`weighted_sum`: 0.5 |y - median| + sum of weight (1 - 2 level) / 2 times interval scores of coverage alpha = 1 - 2 level, penalty 2 / alpha, not divided.
    `log_mean`: mean interval score on log(x + 1), alpha = level, penalty 2 / alpha. `standard`: (0.5 |y - median| + sum alpha / 2 * interval score) / (K + 0.5) with
    alpha = 2 level."""
    if variant == "log_mean":
        q, y = F.transform(q, lambda v: F.ln(v + 1.0)), F.ln(y + 1.0)
        terms, n = [], 0
        for k, level in enumerate(LEVELS[: MEDIAN + 1]):
            times = 2 if level in TWICE else 1
            terms.append(_sum(_interval(q, y, k, 2 / level)) * float(times))
            n += times
        return _sum(terms) / float(n)
    middle = F.abs(y - F.get(q, F.lit(MEDIAN))) * 0.5
    if variant == "weighted_sum":
        return middle + _sum([_sum(_interval(q, y, k, 2 / (1 - 2 * v))) * ((1 - 2 * v) / 2) for k, v in enumerate(LEVELS[:MEDIAN])])
    if variant == "standard":
        return (middle + _sum([_sum(_interval(q, y, k, 1 / v)) * v for k, v in enumerate(LEVELS[:MEDIAN])])) / (MEDIAN + 0.5)
    raise ValueError(variant)


def components(q: Column, y: Column) -> dict[str, Column]:
    """Means over the intervals of the weighted-sum score: dispersion, and the penalties for forecasts that are too high (over) and too low (under)."""
    parts = [_interval(q, y, k, 2 / (1 - 2 * v)) for k, v in enumerate(LEVELS[:MEDIAN])]
    return {n: _sum([p[i] for p in parts]) / float(MEDIAN) for i, n in enumerate(("dispersion", "overprediction", "underprediction"))}


def wis(fc: DataFrame, truth: DataFrame | None = None, variant: str = "weighted_sum", with_components: bool = False) -> DataFrame:
    """Adds `wis` to rows with `quantiles`, location and target_end_date (and `obs`, unless truth (location, date, y) is given)."""
    rows = attach_truth(fc, truth) if truth is not None else fc
    out = rows.withColumn("wis", wis_column(F.col("quantiles"), F.col("obs"), variant))
    return out.withColumns(components(F.col("quantiles"), F.col("obs"))) if with_components else out


def wis_long(fc: DataFrame, truth: DataFrame, by: Sequence[str], variant: str = "weighted_sum") -> DataFrame:
    """Scores of forecasts in long form (a row for each level); by: what a forecast is, with location and target_end_date."""
    return wis(quantile_vectors(fc, by), truth, variant)


def mean_wis(scores: DataFrame, by: Sequence[str]) -> DataFrame:
    return scores.groupBy(*by).agg(F.avg("wis").alias("mean_wis"))


def geometric_wis(scores: DataFrame, by: Sequence[str]) -> DataFrame:
    return geo_mean(scores, "wis", by, name="geo_wis")


def log_shifted(rows: DataFrame, eps: float = 1e-6) -> DataFrame:
    """Quantiles and obs on log(x + eps), for geometric scores."""
    return rows.withColumns({"quantiles": F.transform("quantiles", lambda v: F.ln(v + eps)), "obs": F.ln(F.col("obs") + eps)})


def relative_wis(scores: DataFrame, baseline: str, by: Sequence[str] = ("h",), model: str = "model") -> DataFrame:
    """Geometric mean score of each model divided by the baseline's in the same group; null where that is 0 or unknown."""
    geo = geometric_wis(scores, [*by, model])
    base = geo.where(F.col(model) == baseline).select(*by, F.col("geo_wis").alias("base_wis"))
    return geo.join(base, list(by), "left").withColumn("relative_wis", F.try_divide("geo_wis", "base_wis"))


def evaluate_relative(forecasts: DataFrame, truth: DataFrame, baseline: DataFrame, group_by: Sequence[str] = ("location", "target_end_date")) -> DataFrame:
    """Relative score of wide forecasts (columns q_0.01 ...) against a wide baseline, for each group; truth has the group columns and `value`."""
    names = sorted((c for c in forecasts.columns if c.startswith("q_")), key=lambda c: float(c[2:]))

    def vectors(df: DataFrame) -> DataFrame:
        return df.select(*group_by, F.array(*(F.col(f"`{c}`").cast("double") for c in names)).alias("quantiles"))

    def scored(df: DataFrame, name: str) -> DataFrame:
        rows = vectors(df).join(truth.select(*group_by, F.col("value").alias("obs")), list(group_by))
        return geo_mean(wis(log_shifted(rows)), "wis", group_by, name=name)

    return scored(forecasts, "model_wis").join(scored(baseline, "baseline_wis"), list(group_by)).withColumn("relative_wis", F.try_divide("model_wis", "baseline_wis"))


def mae(rows: DataFrame, by: Sequence[str], pred: str = "point", obs: str = "obs") -> DataFrame:
    return rows.groupBy(*by).agg(F.avg(F.abs(F.col(obs) - F.col(pred))).alias("mae"))


def mape(rows: DataFrame, by: Sequence[str], pred: str = "point", obs: str = "obs", eps: float = 1e-8) -> DataFrame:
    return rows.groupBy(*by).agg((F.avg(F.abs((F.col(obs) - F.col(pred)) / (F.col(obs) + eps))) * 100).alias("mape"))


def combined_loss(scores: DataFrame, by: Sequence[str], mae_weight: float = 1.0, wis_weight: float = 0.0) -> DataFrame:
    """mae_weight * MAE + wis_weight * WIS of rows with quantiles, obs and wis, both divided by mean obs + 1 where that mean is positive."""
    error = F.avg(F.abs(F.col("obs") - F.get("quantiles", F.lit(MEDIAN))))
    base = F.when(F.avg("obs") > 0, F.avg("obs") + 1.0).otherwise(1.0)
    return scores.groupBy(*by).agg((error / base * mae_weight + F.avg("wis") / base * wis_weight).alias("loss"))
