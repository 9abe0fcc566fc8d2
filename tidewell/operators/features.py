"""Causal features of each series: one window specification, one sort. Row offsets are weeks on a completed calendar (impute.complete_weekly)."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewell.functions.calendar import in_peak, in_season, iso_week, year_phase


def series(key: str = "location", date: str = "date") -> Window:
    return Window.partitionBy(key).orderBy(date)


def _last(k: int, key: str, date: str) -> Window:
    return series(key, date).rowsBetween(1 - k, 0)


def lag_columns(cols: Sequence[str], lags: Sequence[int], key: str = "location", date: str = "date") -> dict[str, Column]:
    if min(lags, default=1) < 1:
        raise ValueError("lags begin at 1: lag 0 would be the value to forecast")
    return {f"{c}_lag{k}": F.lag(c, k).over(series(key, date)) for c in cols for k in lags}


def lag_features(df: DataFrame, lags: Sequence[int] = (*range(1, 13), 52), cols: Sequence[str] = ("y",), key: str = "location", date: str = "date") -> DataFrame:
    return df.withColumns(lag_columns(cols, lags, key, date))


def rolling_columns(y: str = "y", windows: Sequence[int] = (2, 4, 8, 12), key: str = "location", date: str = "date") -> dict[str, Column]:
    """Mean, minimum, maximum of the last k rows, and their sample deviation (null of one value)."""
    out = {}
    for k in windows:
        w = _last(k, key, date)
        out |= {f"{y}_mean{k}": F.avg(y).over(w), f"{y}_min{k}": F.min(y).over(w), f"{y}_max{k}": F.max(y).over(w), f"{y}_std{k}": F.stddev_samp(y).over(w)}
    return out


def rolling_features(df: DataFrame, windows: Sequence[int] = (2, 4, 8, 12), y: str = "y", key: str = "location", date: str = "date") -> DataFrame:
    return df.withColumns(rolling_columns(y, windows, key, date))


def _reach(a: float) -> int:
    """After so many values, weights are below 1e-16."""
    return next(k for k in range(1, 100_000) if (1 - a) ** k < 1e-16)


def ewm_features(df: DataFrame, alphas: Sequence[float] = (0.1, 0.3, 0.5), y: str = "y", key: str = "location", date: str = "date") -> DataFrame:
    """Adds <y>_ewm<100 alpha>: the exponentially weighted mean of the known values so far, with weights that add to one.

    Decayed running sums: in blocks of known values, each value is multiplied by (1 - alpha) ** -place, so plain running sums of a block, times (1 - alpha) ** place, are its decayed
    ones; of what came before, the block before is all that still weighs anything. So a row costs the same however long the memory is.
    """
    w = series(key, date)
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    size = max(map(_reach, alphas))
    sizes = {a: size if -size * math.log(1 - a) < 575 else _reach(a) for a in alphas}  # one size for all as long as the powers are numbers
    rows = df.withColumn("__seen", F.count(y).over(so_far))
    at = F.greatest(F.col("__seen") - 1, F.lit(0))
    new = []
    for k in sorted(set(sizes.values())):
        rows = rows.withColumns({f"__b{k}": F.floor(at / k), f"__r{k}": (at % k).cast("double")})
    for a, k in sizes.items():
        n = round(a * 100)
        inner = Window.partitionBy(key, f"__b{k}").orderBy(date).rowsBetween(Window.unboundedPreceding, 0)
        up = F.pow(F.lit(1 - a), -F.col(f"__r{k}"))
        rows = rows.withColumns({f"__s{n}": F.sum(F.when(F.col(y).isNotNull(), F.col(y) * up).otherwise(0.0)).over(inner), f"__w{n}": F.sum(F.when(F.col(y).isNotNull(), up).otherwise(0.0)).over(inner)})
        new.append((a, k, n))
    for a, k, n in new:
        # The sums at the end of the block before: those of its last value.
        ends = {f"__{c}{n}p": F.last(F.when((F.col(f"__r{k}") == k - 1) & F.col(y).isNotNull(), F.col(f"__{c}{n}")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)) for c in "sw"}
        rows = rows.withColumns(ends)
    made = {}
    for a, k, n in new:
        old = F.pow(F.lit(1 - a), F.lit(float(k)))
        inside = F.col(f"__b{k}") > 0
        total = {c: F.col(f"__{c}{n}") + F.when(inside, F.coalesce(F.col(f"__{c}{n}p"), F.lit(0.0)) * old).otherwise(0.0) for c in "sw"}
        here = F.when(F.col(y).isNotNull(), F.try_divide(total["s"], total["w"]))
        made[f"{y}_ewm{n}"] = F.last(here, ignorenulls=True).over(so_far)  # a row without a value has that of the last one with
    inner_names = ["__seen", *(f"__{c}{k}" for k in set(sizes.values()) for c in "br"), *(f"__{c}{n}{p}" for _, _, n in new for c in "sw" for p in ("", "p"))]
    return rows.withColumns(made).drop(*inner_names)


def change_columns(y: str = "y", diffs: Sequence[int] = (1, 2, 4, 8, 52), momentum: Sequence[int] = (4, 8, 12), eps: float = 1e-8, key: str = "location", date: str = "date") -> dict[str, Column]:
    """Differences, relative changes (null on a zero base) and momentum y / (lag + eps) - 1."""
    w = series(key, date)
    out = {f"{y}_diff{k}": F.col(y) - F.lag(y, k).over(w) for k in diffs}
    out |= {f"{y}_pct{k}": F.try_divide(F.col(y), F.lag(y, k).over(w)) - 1 for k in diffs}
    return out | {f"{y}_mom{k}": F.try_divide(F.col(y), F.lag(y, k).over(w) + eps) - 1 for k in momentum}


def diff_features(df: DataFrame, lags: Sequence[int] = (1, 2, 4, 8, 52), y: str = "y", key: str = "location", date: str = "date") -> DataFrame:
    return df.withColumns({c: e for c, e in change_columns(y, lags, (), key=key, date=date).items() if "_diff" in c})


def pct_change_features(df: DataFrame, lags: Sequence[int] = (1, 2, 4, 8, 52), y: str = "y", key: str = "location", date: str = "date") -> DataFrame:
    return df.withColumns({c: e for c, e in change_columns(y, lags, (), key=key, date=date).items() if "_pct" in c})


def momentum_features(df: DataFrame, lags: Sequence[int] = (4, 8, 12), eps: float = 1e-8, y: str = "y", key: str = "location", date: str = "date") -> DataFrame:
    return df.withColumns(change_columns(y, (), lags, eps, key, date))


def expanding_mean(df: DataFrame, y: str = "y", key: str = "location", date: str = "date") -> DataFrame:
    return df.withColumn(f"{y}_cummean", F.avg(y).over(series(key, date).rowsBetween(Window.unboundedPreceding, 0)))


def theil_sen_columns(y: str = "y", windows: Sequence[int] = (8, 12), key: str = "location", date: str = "date") -> dict[str, Column]:
    """Median slope over all pairs of the last k points; null for the first k rows and where a value is missing."""
    out = {}
    for k in windows:
        values = F.collect_list(F.col(y)).over(_last(k, key, date))
        slope = _median_slope(values, k)
        full = (F.row_number().over(series(key, date)) > k) & (F.size(values) == k)
        out[f"{y}_slope{k}"] = F.when(full, slope)
    return out


def _median_slope(values: Column, k: int) -> Column:
    """Median of (v[j] - v[i]) / (j - i) over i < j < k."""
    ends = F.sequence(F.lit(1), F.lit(k - 1))
    from_end = lambda j: F.transform(F.sequence(F.lit(0), j - 1), lambda i: (F.get(values, j) - F.get(values, i)) / (j - i))
    slopes, n = F.array_sort(F.flatten(F.transform(ends, from_end))), k * (k - 1) // 2
    middle = lambda s: (F.get(s, F.lit((n - 1) // 2)) + F.get(s, F.lit(n // 2))) / 2
    return F.get(F.transform(F.array(slopes), middle), F.lit(0))  # the sorted array is made once


def theil_sen(df: DataFrame, windows: Sequence[int] = (8, 12), y: str = "y", key: str = "location", date: str = "date") -> DataFrame:
    return df.withColumns(theil_sen_columns(y, windows, key, date))


def seasonal_columns(date: str = "date") -> dict[str, Column]:
    d = F.col(date)
    out = {f"{name}_{wave}": year_phase(d, times, wave) for name, times in (("year", 1), ("quarter", 4), ("month", 12)) for wave in ("sin", "cos")}
    return out | {"in_season": in_season(d), "in_peak": in_peak(d), "week_num": iso_week(d)}


def seasonal_features(df: DataFrame, date: str = "date") -> DataFrame:
    return df.withColumns(seasonal_columns(date))


def fill_features(df: DataFrame, cols: Sequence[str], value: float = 0.0, key: str = "location", date: str = "date") -> DataFrame:
    """The last known value of the series, and `value` before there is one."""
    w = series(key, date).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({c: F.coalesce(F.last(c, ignorenulls=True).over(w), F.lit(value)) for c in cols})


def detrended_std(df: DataFrame, y: str = "y", key: str = "location", date: str = "date") -> DataFrame:
    """`detrended_std`: population deviation of what a straight line in time leaves of the values so far; `n_seen` values. The week's number from the first
    one is the time, which keeps the sums small."""
    w = series(key, date)
    df = df.withColumn("__t", (F.datediff(F.col(date), F.min(date).over(Window.partitionBy(key).orderBy(date).rowsBetween(Window.unboundedPreceding, 0))) / 7.0))
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    vt, vy, cov = F.var_pop("__t").over(so_far), F.var_pop(y).over(so_far), F.covar_pop("__t", y).over(so_far)
    left = F.greatest(vy - F.coalesce(F.try_divide(cov * cov, vt), F.lit(0.0)), F.lit(0.0))
    return df.withColumn("detrended_std", F.sqrt(left)).withColumn("n_seen", F.count(y).over(so_far)).drop("__t")


def future_weeks(df: DataFrame, n: int = 4, key: str = "location", date: str = "date") -> DataFrame:
    """(key, date, week_num): n weeks after the last one of each series, with their ISO week, for forecasts beyond the panel."""
    last = df.groupBy(key).agg(F.max(date).alias("__d")).where("__d is not null")
    rows = last.select(key, F.explode(F.sequence(F.date_add("__d", 7), F.date_add("__d", 7 * n), F.expr("interval 7 days"))).alias(date))
    return rows.withColumn("week_num", iso_week(F.col(date)))


def gap_check(df: DataFrame, key: str = "location", date: str = "date") -> DataFrame:
    """(gap, n): the differences in days between neighbouring rows and how often they occur."""
    return df.select(F.datediff(F.col(date), F.lag(date).over(series(key, date))).alias("gap")).where("gap is not null").groupBy("gap").agg(F.count("*").alias("n"))


def build_features(df: DataFrame, covariates: Sequence[str] = (), y: str = "y", key: str = "location", date: str = "date", groups: Sequence[str] = ("lags", "rolling", "changes", "season", "trend"), fill: bool = True, external: Sequence[str] = (), external_lags: Sequence[int] = (0, 1, 2)) -> DataFrame:
    """All features of a completed panel in one select; with `fill`, nulls take the last known value, then 0. Covariates are columns of df. External columns, known at the row's date (of
    another feed, say), may have lag 0, their value on the date itself: <column>_ext0."""
    if y in external and 0 in external_lags:
        raise ValueError("lag 0 of y would be the value to forecast")
    out: dict[str, Column] = {}
    if "lags" in groups:
        out |= lag_columns([y, *list(covariates)[:3]], (*range(1, 13), 52), key, date)
    if "rolling" in groups:
        df = ewm_features(df, (0.1, 0.3, 0.5), y, key, date)
        out |= rolling_columns(y, (2, 4, 8, 12), key, date) | {c: F.col(c) for c in (f"{y}_ewm10", f"{y}_ewm30", f"{y}_ewm50")}
    if "changes" in groups:
        out |= change_columns(y, key=key, date=date)
    if "season" in groups:
        out |= seasonal_columns(date)
    if "trend" in groups:
        out |= {f"{y}_cummean": F.avg(y).over(series(key, date).rowsBetween(Window.unboundedPreceding, 0))} | theil_sen_columns(y, key=key, date=date)
    out |= {f"{c}_current": F.col(c) for c in covariates}
    out |= {f"{c}_ext{k}": F.lag(c, k).over(series(key, date)) if k else F.col(c) for c in external for k in external_lags}
    made, always = df.withColumns(out), set(seasonal_columns(date))
    return fill_features(made, [c for c in out if c not in always], 0.0, key, date) if fill else made


def feature_names(df: DataFrame, drop: Sequence[str] = ("location", "date", "y")) -> list[str]:
    return [c for c, t in df.dtypes if c not in drop and t in ("double", "int", "bigint")]
