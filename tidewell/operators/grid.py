"""Autoregressions of a whole grid of settings in one pass: the settings are a dimension of the arrays, not plans of their own.

A setting is a dict of p (order), d (0, or 1: of differences, added up again along the path), log (on log(1 + y)) and ridge. Settings that differ in their ridge alone share sums.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.functions.numeric import gaussian_array
from tidewell.operators.features import series
from tidewell.operators.models import determined, solve
from tidewell.operators.scan import in_order, numbers, running, scan
from tidewell.operators.scoring import wis_column

DEFAULTS = {"p": 2, "d": 0, "log": False, "ridge": 1e-8}


def _settings(grid: Sequence[dict]) -> list[dict]:
    for g in grid:
        if set(g) - set(DEFAULTS) or g.get("d", 0) not in (0, 1):
            raise ValueError(f"settings are p, d (0 or 1), log and ridge: {g}")
    return [DEFAULTS | g for g in grid]


def _levels(past: np.ndarray, log: bool, d: int) -> np.ndarray:
    """The value and those before it, newest first, on the setting's scale and differenced."""
    z = np.log1p(np.maximum(past, 0.0)) if log else past
    return z[:, :-1] - z[:, 1:] if d else z


def _ahead(coef: np.ndarray, now: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Values 1 to `steps` ahead of the (differenced) series, and the moving-average weights 0 to steps - 1."""
    state, path, psi = now.copy(), np.zeros((len(now), steps)), np.zeros((len(now), steps))
    psi[:, 0] = 1.0
    for h in range(steps):
        path[:, h] = coef[:, 0] + (coef[:, 1:] * state).sum(axis=1)
        state = np.column_stack([path[:, h], state[:, :-1]])
        for i in range(min(h, coef.shape[1] - 1)):
            psi[:, h] += coef[:, 1 + i] * psi[:, h - 1 - i]
    return path, psi


def forecast_grid(df: DataFrame, grid: Sequence[dict], horizon: int = 1, min_n: int = 10, anchor: str | None = None, keep: Sequence[str] = (), ordered: bool = False, key: str = "location", date: str = "date", y: str = "y") -> DataFrame:
    """(location, reference_date, k, h, point, sigma, and the columns of df named in `keep`) for each anchor with a known y, setting k of the grid and h up to `horizon`: the path
    of an autoregression fitted on the rows up to the anchor, and its deviation: the residuals' deviation times the root of the sum of squared moving-average weights; on the log scale times 1 + point.
    Anchors are all rows, or those where the boolean column `anchor` holds. Persistence, and deviation max(0.25 |y|, 5), with fewer than min_n + p fitted rows, and without a penalty
    where these don't determine the coefficients. Points are not negative. `ordered`: df is scan.in_order() already."""
    settings = _settings(grid)
    shapes = sorted({(g["p"], g["d"], g["log"]) for g in settings})
    reach = max((p + d for p, d, _ in shapes), default=1)
    w = series(key, date)
    rows = df.withColumn(y, F.col(y).cast("double"))
    rows = rows if ordered else in_order(rows, [key], date)
    rows = rows.withColumns({"__past": F.array(*(F.lag(y, k).over(w) if k else F.col(y) for k in range(reach + 1))), "__anchor": F.coalesce(F.col(anchor), F.lit(False)) if anchor else F.lit(True)})
    rows = rows.select(key, date, *keep, "__past", "__anchor")

    def block(b: pd.DataFrame, starts: np.ndarray, carried):
        past = numbers(b["__past"])
        at = np.flatnonzero(b["__anchor"].to_numpy(bool) & ~np.isnan(past[:, 0]))
        last, state, sums = past[at, 0], {}, {}
        for shape in shapes:
            p, d, log = shape
            z = _levels(past[:, : p + d + 1], log, d)
            x, target = np.column_stack([np.ones(len(z)), z[:, 1 : p + 1]]), z[:, 0]
            fine = ~np.isnan(z[:, : p + 1]).any(axis=1)
            x, target = np.where(fine[:, None], x, 0.0), np.where(fine, target, 0.0)
            i, j = np.triu_indices(p + 1)
            terms = np.concatenate([x[:, i] * x[:, j], x * target[:, None], (target * target)[:, None]], axis=1)
            total = running(terms, starts, carried and carried[shape])
            state[shape] = total[-1]
            sums[shape] = total[at], _levels(past[at, : p + d], log, d)[:, :p], len(i)
        out = []
        for k, g in enumerate(settings):
            total, now, m = sums[g["p"], g["d"], g["log"]]
            p = g["p"]
            xx, xy, yy, n = total[:, :m], total[:, m : m + p + 1], total[:, -1], total[:, 0]
            coef = solve(xx, xy, g["ridge"]) if len(at) else np.zeros((0, p + 1))
            known = (n >= min_n + p) & ~np.isnan(now).any(axis=1)
            if not g["ridge"]:
                known &= determined(xx, p + 1) if len(at) else known
            i, j = np.triu_indices(p + 1)
            fitted = (np.where(i == j, 1.0, 2.0) * xx * coef[:, i] * coef[:, j]).sum(axis=1)
            spread = np.sqrt(np.maximum(yy - 2 * (coef * xy).sum(axis=1) + fitted, 0.0) / np.maximum(n, 1.0))
            path, psi = _ahead(coef, np.nan_to_num(now), horizon)
            if g["d"]:
                base = np.log1p(np.maximum(last, 0.0)) if g["log"] else last
                path, psi = base[:, None] + np.cumsum(path, axis=1), np.cumsum(psi, axis=1)
            sigma = spread[:, None] * np.sqrt(np.cumsum(psi * psi, axis=1))
            if g["log"]:
                path = np.expm1(np.minimum(path, 50.0))
                sigma = sigma * (1 + np.maximum(path, 0.0))
            point = np.maximum(np.where(known[:, None], path, last[:, None]), 0.0)
            sigma = np.where(known[:, None], sigma, np.maximum(0.25 * np.abs(last), 5.0)[:, None])
            for h in range(horizon):
                out.append(pd.DataFrame({"location": b[key].iloc[at], "reference_date": b[date].iloc[at], "k": np.int32(k), "h": np.int32(h + 1), "point": point[:, h], "sigma": sigma[:, h]} | {c: b[c].iloc[at] for c in keep}))
        return pd.concat(out, ignore_index=True), state

    kept = dict(df.dtypes)
    schema = "location string, reference_date date, k int, h int, point double, sigma double" + "".join(f", {c} {kept[c]}" for c in keep)
    return scan(rows, block, schema, [key], date)


def grid_scores(df: DataFrame, grid: Sequence[dict], folds: DataFrame | None = None, cutoff=None, horizon: int = 1, score: str = "mae", key: str = "location", date: str = "date", y: str = "y") -> DataFrame:
    """(location, k, fold, score, n): the mean absolute error, or the weighted interval score of a normal forecast, of each setting in each fold, over the fold's test rows up to
    `horizon` rows after its last training row. folds: backtest.rolling_folds() of df; without, each row is a fold of its own, numbered from 0, up to targets at `cutoff`.
    The panel is read once whatever the grid; its calendar is complete, so row offsets are weeks."""
    if score not in ("mae", "wis"):
        raise ValueError(score)
    w = series(key, date)
    rows = in_order(df.select(key, date, F.col(y).cast("double").alias(y)), [key], date)
    rows = rows.withColumns({"fold": F.row_number().over(w) - 1, "obs": F.array(*(F.lead(y, h).over(w) for h in range(1, horizon + 1))), "ends": F.array(*(F.lead(date, h).over(w) for h in range(1, horizon + 1)))})
    if folds is None:
        rows = rows.withColumns({"tests": F.lit(horizon), "chosen": F.lit(True)})
    else:
        ends = folds.select(key, (F.col("train_rows") - 1).alias("__row"), F.col("fold").alias("__fold"), (F.col("test_end") - F.col("train_rows")).cast("int").alias("tests"))
        rows = rows.withColumnRenamed("fold", "__row").join(ends, [key, "__row"], "left").withColumns({"fold": F.coalesce("__fold", F.lit(-1)).cast("int"), "chosen": F.col("__fold").isNotNull()})
    tried = forecast_grid(rows, grid, horizon, anchor="chosen", keep=("fold", "tests", "obs", "ends"), ordered=folds is None, key=key, date=date, y=y)
    tried = tried.withColumns({"obs": F.get("obs", F.col("h") - 1), "end": F.get("ends", F.col("h") - 1)}).where((F.col("h") <= F.col("tests")) & F.col("obs").isNotNull())
    if cutoff is not None:
        tried = tried.where(F.col("end") <= F.lit(cutoff).cast("date"))
    value = F.abs(F.col("obs") - F.col("point")) if score == "mae" else wis_column(gaussian_array(F.col("point"), F.col("sigma")), F.col("obs"))
    return tried.groupBy("location", "k", "fold").agg(F.avg(value).alias("score"), F.count("*").alias("n"))


def best_settings(scores: DataFrame, grid: Sequence[dict]) -> DataFrame:
    """(location, k, params, score): of each location the setting of least mean score over its folds; of equal ones (to nine digits) the first of the grid."""
    means = scores.groupBy("location", "k").agg(F.avg("score").alias("score"))
    best = means.groupBy("location").agg(F.min_by("k", F.struct(F.round("score", 9), "k")).alias("k"), F.min("score").alias("score"))
    maps = F.array(*(F.create_map(*(F.lit(x) for n, v in g.items() for x in (n, float(v)))) for g in grid))
    return best.select("location", "k", F.get(maps, F.col("k")).alias("params"), "score")


def tune(df: DataFrame, grid: Sequence[dict], folds: DataFrame | None = None, score: str = "mae", cutoff=None, horizon: int = 1, key: str = "location", date: str = "date", y: str = "y") -> DataFrame:
    """(location, k, params, score): best_settings() of grid_scores()."""
    return best_settings(grid_scores(df, grid, folds, cutoff, horizon, score, key, date, y), grid)


def select_orders(df: DataFrame, orders: Sequence[tuple[int, int]] = ((1, 0), (2, 0), (1, 1), (2, 1)), min_rows: int = 20, default: tuple[int, int] = (1, 0), ridge: float = 1e-8, log: bool = False, key: str = "location", date: str = "date", y: str = "y") -> DataFrame:
    """(location, p, d): the order of least mean absolute one-step error over the first half of each series (of equal ones the first); `default` with fewer than min_rows rows."""
    from tidewell.operators.select import split_half

    grid = [{"p": p, "d": d, "ridge": ridge, "log": log} for p, d in orders]
    half = split_half(df, key, date).where("half = 1")
    scores = grid_scores(half, grid, key=key, date=date, y=y).groupBy("location", "k").agg((F.sum(F.col("score") * F.col("n")) / F.sum("n")).alias("score"))
    best = scores.groupBy("location").agg(F.min_by("k", F.struct(F.round("score", 9), "k")).alias("k"))
    sizes = df.groupBy(F.col(key).alias("location")).agg(F.count(y).alias("n"))
    order = F.array(*(F.struct(F.lit(p).alias("p"), F.lit(d).alias("d")) for p, d in (*orders, default)))
    chosen = F.get(order, F.when(F.col("n") >= min_rows, F.coalesce("k", F.lit(len(orders)))).otherwise(len(orders)))
    return sizes.join(best, "location", "left").select("location", chosen.alias("o")).select("location", "o.p", "o.d")


def forecast_orders(df: DataFrame, orders: DataFrame, candidates: Sequence[tuple[int, int]], horizon: int = 4, ridge: float = 1e-8, log: bool = False, key: str = "location", date: str = "date", y: str = "y") -> DataFrame:
    """(location, reference_date, h, point, sigma) of every anchor, by the order that `orders` (location, p, d) gives the location."""
    tried = forecast_grid(df, [{"p": p, "d": d, "ridge": ridge, "log": log} for p, d in candidates], horizon, key=key, date=date, y=y)
    place = F.array_position(F.array(*(F.struct(F.lit(p).alias("p"), F.lit(d).alias("d")) for p, d in candidates)), F.struct(F.col("p").cast("int").alias("p"), F.col("d").cast("int").alias("d"))) - 1
    return tried.join(orders.select("location", place.cast("int").alias("k")), ["location", "k"]).select("location", "reference_date", "h", "point", "sigma")


