"""From points to 23 quantiles. Forecast rows are (location, reference_date, h, point); results add `quantiles`."""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewell.functions.numeric import LEVELS, finite, gaussian_array, z_values
from tidewell.operators.features import detrended_std
from tidewell.operators.joins import offset_differences
from tidewell.operators.scan import in_order, scan


def validation_errors(fc: DataFrame, truth: DataFrame, key: str = "location", date: str = "date", y: str = "y") -> DataFrame:
    """(location, h, anchor, target_date, point, obs, error): actual less predicted, by lead."""
    seen = truth.where(F.col(y).isNotNull()).select(F.col(key).alias("location"), F.col(date).alias("target_date"), F.col(y).alias("obs"))
    ahead = fc.select("location", "h", F.col("reference_date").alias("anchor"), F.date_add("reference_date", F.col("h") * 7).alias("target_date"), "point")
    return ahead.join(seen, ["location", "target_date"]).withColumn("error", F.col("obs") - F.col("point"))


def scaled_residuals(errors: DataFrame, scale: str = "log1p") -> DataFrame:
    """Adds `residual` on the scale log1p, pct or raw; rows where it is not finite go."""
    obs, point = F.col("obs"), F.col("point")
    value = {"log1p": F.log1p(F.greatest(obs, F.lit(0.0))) - F.log1p(F.greatest(point, F.lit(0.0))), "pct": (obs - point) / F.greatest(point, F.lit(1e-8)), "raw": obs - point}[scale]
    return errors.withColumn("residual", finite(value)).where("residual is not null")


def _fallback(point: Column) -> Column:
    return gaussian_array(point, F.greatest(F.abs(point) * 0.25, F.lit(5.0)))


def _shifted(point: Column, offsets: Column) -> Column:
    return F.transform(offsets, lambda e: F.greatest(F.lit(0.0), point + e))


_AT = np.array(LEVELS)


def _between(low: np.ndarray, high: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Linear interpolation between the values at the whole places below and above."""
    part = place - np.floor(place)
    return np.where(low == high, low, (1 - part) * low + part * high)


def _running_percentiles(b: pd.DataFrame, starts: np.ndarray, carried) -> tuple[pd.DataFrame, object]:
    """Percentiles at LEVELS of the errors so far at each date of a series and lead. The errors so far are one sorted list, 8 bytes and a pointer for each, into which each new one is put at
    its place; it goes on from block to block."""
    errors, ends = b.error.to_numpy(float), np.append(starts[1:], len(b))
    fresh, count = ~np.isnan(errors), np.empty(len(b), np.int64)
    for k, (lo, hi) in enumerate(zip(starts, ends, strict=True)):
        count[lo:hi] = np.cumsum(fresh[lo:hi]) + (len(carried) if k == 0 and carried else 0)
    place = np.maximum(count - 1, 0)[:, None] * _AT
    first, second = np.floor(place).astype(int).tolist(), np.ceil(place).astype(int).tolist()
    low, high, seen = np.zeros((len(b), len(_AT))), np.zeros((len(b), len(_AT))), []
    for k, (lo, hi) in enumerate(zip(starts, ends, strict=True)):
        seen = carried if k == 0 and carried else []
        for r in range(lo, hi):
            if fresh[r]:
                insort(seen, errors[r])
            if seen:
                low[r], high[r] = [seen[i] for i in first[r]], [seen[i] for i in second[r]]
    found = _between(low, high, place)
    return pd.DataFrame({"location": b.location, "h": b.h, "reference_date": b.target_date, "__q": [x if n else None for x, n in zip(found, count, strict=True)], "__n": count}), seen


def error_quantiles(fc: DataFrame, errors: DataFrame, min_n: int = 10, expanding: bool = True) -> DataFrame:
    """Point plus percentiles of the errors of the same location and lead; a normal of deviation max(0.25 |point|, 5) with fewer than min_n errors. `expanding`: only
    errors whose target date is at or before the reference date count; otherwise all. None is below 0."""
    levels = F.array(*map(F.lit, LEVELS))
    if expanding:
        by = ["location", "h"]
        known = scan(in_order(errors.select(*by, "target_date", "error"), by, "target_date"), _running_percentiles, "location string, h int, reference_date date, __q array<double>, __n long", by, "target_date")
        rows = fc.join(known, ["location", "h", "reference_date"], "left")
    else:
        known = errors.groupBy("location", "h").agg(F.percentile("error", levels).alias("__q"), F.count("error").alias("__n"))
        rows = fc.join(known, ["location", "h"], "left")
    return rows.withColumn("quantiles", F.when(F.col("__n") >= min_n, _shifted(F.col("point"), F.col("__q"))).otherwise(_fallback(F.col("point")))).drop("__q", "__n")


def _back(point: Column, r: Column, scale: str) -> Column:
    value = {"log1p": F.expm1(F.log1p(F.greatest(point, F.lit(0.0))) + r), "pct": point * (r + 1.0), "raw": point + r}[scale]
    return F.greatest(F.lit(0.0), value)


def residual_quantiles(fc: DataFrame, residuals: DataFrame, scale: str = "log1p", small_sample: str = "scaled", errors: DataFrame | None = None) -> DataFrame:
    """Point moved by percentiles of scaled residuals of its location and lead, on the scale and back, from 10 residuals on.

    With 1 to 9: small_sample='scaled' takes a normal on the scale of their deviation (0.5 for one, or none to speak of); 'skip' goes on as without any. Without:
    percentiles of `errors` (10 or more), else a normal of deviation max(std of errors, 5), or max(0.25 |point|, 5) with fewer than two.
    """
    levels = F.array(*map(F.lit, LEVELS))
    point = F.col("point")
    own = residuals.groupBy("location", "h").agg(F.percentile("residual", levels).alias("__q"), F.count("residual").alias("__n"), F.stddev_pop("residual").alias("__s"))
    rows = fc.join(own, ["location", "h"], "left")
    if errors is not None:
        old = errors.groupBy("location", "h").agg(F.percentile("error", levels).alias("__eq"), F.count("error").alias("__en"), F.stddev_pop("error").alias("__es"))
        rows = rows.join(old, ["location", "h"], "left")
    else:
        rows = rows.withColumns({"__eq": F.lit(None).cast("array<double>"), "__en": F.lit(0), "__es": F.lit(None).cast("double")})
    n, en = F.coalesce("__n", F.lit(0)), F.coalesce("__en", F.lit(0))
    spread = F.when((n > 1) & (F.col("__s") > 1e-8), F.col("__s")).otherwise(0.5)
    empirical = F.transform(F.col("__q"), lambda r: _back(point, r, scale))
    small = F.array(*(_back(point, spread * z, scale) for z in z_values()))
    rest = F.when(en >= 10, _shifted(point, F.col("__eq"))).when(en > 1, gaussian_array(point, F.greatest(F.col("__es"), F.lit(5.0)))).otherwise(_fallback(point))
    quantiles = F.when(n >= 10, empirical)
    if small_sample == "scaled":
        quantiles = quantiles.when(n >= 1, small)
    return rows.withColumn("quantiles", quantiles.otherwise(rest)).drop("__q", "__n", "__s", "__eq", "__en", "__es")


def baseline_quantiles(df: DataFrame, horizons: Sequence[int] = (1, 2, 3, 4), min_n: int = 10, key: str = "location", date: str = "date", y: str = "y") -> DataFrame:
    """Persistence with a normal of the detrended deviation so far (W17), from min_n values on; else of max(0.25 |last|, 5)."""
    rows = detrended_std(df, y, key, date)
    last = F.last(y, ignorenulls=True).over(Window.partitionBy(key).orderBy(date).rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.select(F.col(key).alias("location"), F.col(date).alias("reference_date"), last.alias("point"), "detrended_std", "n_seen").where("point is not null")
    sigma = F.when(F.col("n_seen") >= min_n, F.col("detrended_std")).otherwise(F.greatest(F.abs("point") * 0.25, F.lit(5.0)))
    rows = rows.withColumn("sigma", sigma).withColumn("quantiles", gaussian_array(F.col("point"), F.col("sigma")))
    return rows.select("location", "reference_date", F.explode(F.array(*map(F.lit, horizons))).alias("h"), "point", "sigma", "quantiles")


def difference_quantiles(df: DataFrame, h: int = 1, key: str = "location", date: str = "date", y: str = "y") -> DataFrame:
    """At the end of each series: last value plus its h-step differences without outliers (beyond 1.5 quartile distances), none below 0, as percentiles; else the
    normal fallback."""
    known = df.where(F.col(y).isNotNull())
    last = known.groupBy(key).agg(F.max(date).alias("reference_date"), F.max_by(y, date).alias("point"))
    diffs = offset_differences(known, h, key, date, y).select(key, "diff")
    quartiles = diffs.groupBy(key).agg(F.percentile("diff", F.array(F.lit(0.25), F.lit(0.75))).alias("__q"))
    lo, hi = F.col("__q")[0], F.col("__q")[1]
    fine = diffs.join(quartiles, key).where((F.col("diff") >= lo - (hi - lo) * 1.5) & (F.col("diff") <= hi + (hi - lo) * 1.5))
    moved = fine.join(last, key).groupBy(key).agg(F.percentile(F.greatest(F.col("point") + F.col("diff"), F.lit(0.0)), F.array(*map(F.lit, LEVELS))).alias("__v"))
    out = last.join(moved, key, "left").withColumn("quantiles", F.coalesce("__v", _fallback(F.col("point"))))
    return out.select(F.col(key).alias("location"), "reference_date", F.lit(h).alias("h"), "point", "quantiles")


def expanding_difference_quantiles(df: DataFrame, horizons: Sequence[int] = (1, 2, 3, 4), key: str = "location", date: str = "date", y: str = "y") -> DataFrame:
    """(location, reference_date, h, point, quantiles): difference_quantiles() at every date with a known y, from the differences known by then. Quartiles, fences and the differences within
    them are anew for each date, found by place in one sorted list for each series and horizon. Differences are by date, so gaps do no harm."""
    day = Window.partitionBy(key).orderBy("__day")
    rows = in_order(df.where(F.col(y).isNotNull()).select(key, date, F.col(y).cast("double").alias("point")), [key], date)
    rows = rows.withColumn("__day", F.unix_date(F.col(date).cast("date")))
    rows = rows.withColumn("diffs", F.array(*(F.col("point") - F.first("point").over(day.rangeBetween(-7 * h, -7 * h)) for h in horizons))).drop("__day")
    rows = rows.sortWithinPartitions(key, date)

    def block(b: pd.DataFrame, starts: np.ndarray, carried) -> tuple[pd.DataFrame, object]:
        point, ends, out, state = b.point.to_numpy(float), np.append(starts[1:], len(b)), [], []
        for n in range(len(horizons)):
            diff = np.array([np.nan if x[n] is None else x[n] for x in b.diffs], float)
            low, high, place, some = np.zeros((len(b), len(_AT))), np.zeros((len(b), len(_AT))), np.zeros((len(b), len(_AT))), np.zeros(len(b), bool)
            seen: list[float] = []
            for k, (lo, hi) in enumerate(zip(starts, ends, strict=True)):
                seen = carried[n] if k == 0 and carried else []
                for r in range(lo, hi):
                    if diff[r] == diff[r]:
                        insort(seen, diff[r])
                    if not seen:
                        continue
                    q1, q3 = (seen[int(p)] if p == int(p) else (int(p) + 1 - p) * seen[int(p)] + (p - int(p)) * seen[int(p) + 1] for p in (0.25 * (len(seen) - 1), 0.75 * (len(seen) - 1)))
                    i, j = bisect_left(seen, q1 - (q3 - q1) * 1.5), bisect_right(seen, q3 + (q3 - q1) * 1.5)
                    if i >= j:
                        continue
                    some[r], place[r] = True, i + _AT * (j - i - 1)
                    low[r], high[r] = [seen[int(p)] for p in place[r]], [seen[-int(-p // 1)] for p in place[r]]
            moved = _between(np.maximum(point[:, None] + low, 0.0), np.maximum(point[:, None] + high, 0.0), place)
            out.append(pd.DataFrame({"location": b[key], "reference_date": b[date], "h": np.int32(horizons[n]), "point": point, "__v": [v if s else None for v, s in zip(moved, some, strict=True)]}))
            state.append(seen)
        return pd.concat(out, ignore_index=True), state

    made = scan(rows, block, "location string, reference_date date, h int, point double, __v array<double>", [key], date)
    return made.select("location", "reference_date", "h", "point", F.coalesce("__v", _fallback(F.col("point"))).alias("quantiles"))


def gaussian_quantiles(df: DataFrame, mu: str = "mu", sigma: str = "sigma", levels=LEVELS) -> DataFrame:
    return df.withColumn("quantiles", gaussian_array(F.col(mu), F.col(sigma), levels))
