"""Robust direct regressions at every anchor date: large errors pull linearly, not quadratically.

Weights are found by steps. In each, a row's error under the coefficients of the step before, as they stood before that row, decides what the row counts; weighted sums over the
rows so far then give this step's coefficients. A row's weight rests on earlier rows only (that of the first rows, before there are forecasts, on all of those), so one pass in order
of date makes all steps for all anchors, and nothing is refitted.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.operators.features import series
from tidewell.operators.models import HORIZONS
from tidewell.operators.scan import before, in_order, numbers, running, scan

#: Errors up to so many standard deviations count in full.
BEND = 1.345
#: Errors up to this share of 1 + |y| always count in full, so that a stretch of exact fits doesn't silence what follows.
TUBE = 1e-3
#: Standard deviations in a mean absolute error, for a normal distribution: the square root of pi / 2.
SPREAD = 1.2533141373155001


def standard_solution(sums: np.ndarray, k: int, ridge: float) -> np.ndarray:
    """Coefficients (intercept first) of ridge regressions on standardised features with a free intercept, in the features' own units, of rows of sums: weight, k sums of
    features, sum of y, upper triangle of products, k products with y. Features that don't vary get 0."""
    w = np.maximum(sums[:, :1], 1e-300)
    mean, y = sums[:, 1 : k + 1] / w, sums[:, k + 1 : k + 2] / w
    i, j = np.triu_indices(k)
    m = len(i)
    cov = np.zeros((len(sums), k, k))
    cov[:, i, j] = cov[:, j, i] = sums[:, k + 2 : k + 2 + m] / w - mean[:, i] * mean[:, j]
    with_y = sums[:, k + 2 + m :] / w - mean * y
    own = np.einsum("rkk->rk", cov).copy()
    varies = own > 1e-9 * (1 + mean * mean)
    root = np.sqrt(np.where(varies, own, 1.0))
    both = varies[:, :, None] & varies[:, None, :]
    cor = np.where(both, cov / root[:, :, None] / root[:, None, :], 0.0)
    cor[:, np.arange(k), np.arange(k)] = 1.0 + ridge
    slope = np.linalg.solve(cor, np.where(varies, with_y / root, 0.0)[:, :, None])[:, :, 0] if ridge else np.einsum("rij,rj->ri", np.linalg.pinv(cor, hermitian=True), np.where(varies, with_y / root, 0.0))
    slope = np.where(varies, slope / root, 0.0)
    return np.concatenate([y - (slope * mean).sum(axis=1, keepdims=True), slope], axis=1)


def _products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    i, j = np.triu_indices(x.shape[1])
    return np.concatenate([np.ones((len(x), 1)), x, y[:, None], x[:, i] * x[:, j], x * y[:, None]], axis=1)


def _fitted(x: np.ndarray, y: np.ndarray, fine: np.ndarray, starts: np.ndarray, carried: dict | None, ridge: float, steps: int, bend: float, min_n: int) -> tuple[np.ndarray, np.ndarray, dict]:
    """(rows so far, coefficients at each row, what goes on into the next block); `fine` are the rows that count. A series' first min_n rows are weighed together, by the coefficients at
    the last of them; a series that ends the block with fewer hands its rows on."""
    held = 0
    if carried and "rows" in carried:
        px, py = carried["rows"]
        held, carried = len(py), None
        x, y, fine, starts = np.concatenate([px, x]), np.concatenate([py, y]), np.concatenate([np.ones(held, bool), fine]), np.append(0, starts[1:] + held)
    had = carried or {"count": None, "coef": [None] * steps, "scale": [None] * steps, "sums": [None] * (steps + 1)}
    count = running(fine.astype(float), starts, had["count"])
    own = np.searchsorted(starts, np.arange(len(y)), "right") - 1
    first = fine & (count <= min_n)
    full = np.full(len(starts), -1)
    full[own[fine & (count == min_n)]] = np.flatnonzero(fine & (count == min_n))
    known = fine & (~first | (full[own] >= 0))
    goes_on = {"count": count[-1], "coef": [], "scale": [], "sums": []}
    terms = _products(np.where(fine[:, None], x, 0.0), np.where(fine, y, 0.0)) * fine[:, None]
    weight, coef = fine.astype(float), None
    for step in range(steps + 1):
        if step:
            beta = np.where(first[:, None], coef[full[own]], before(coef, starts, had["coef"][step - 1]))
            goes_on["coef"].append(coef[-1])
            error = np.where(known, np.abs(y - beta[:, 0] - (x * beta[:, 1:]).sum(axis=1)), 0.0)
            both = np.column_stack([weight * error, weight * known])
            seen = running(both, starts, had["scale"][step - 1])
            goes_on["scale"].append(seen[-1])
            prior = before(seen, starts, had["scale"][step - 1])
            prior[first] = np.column_stack([np.bincount(own[first], c[first], len(starts)) for c in both.T])[own[first]]
            limit = np.maximum(bend * SPREAD * np.divide(prior[:, 0], prior[:, 1], out=np.zeros(len(y)), where=prior[:, 1] > 0), TUBE * (1 + np.abs(y)))
            heavy = known & (prior[:, 1] > 0) & (error > limit)
            weight = np.divide(limit, error, out=np.ones(len(y)), where=heavy) * fine
        sums = running(terms * weight[:, None], starts, had["sums"][step])
        goes_on["sums"].append(sums[-1])
        coef = standard_solution(sums, x.shape[1], ridge)
    if count[-1] < min_n:
        last = np.flatnonzero(fine[starts[-1] :]) + starts[-1]
        goes_on = {"rows": (x[last], y[last])}
    return count[held:], coef[held:], goes_on


def forecast_robust(df: DataFrame, features: Sequence[str], horizons: Sequence[int] = HORIZONS, ridge: float = 1e-3, steps: int = 3, bend: float = BEND, log: bool = False, min_n: int = 25, key: str = "location", date: str = "date", y: str = "y") -> DataFrame:
    """Direct regression of y on the features h rows before, at every date, on the labels known by then, on standardised features; points are not negative. Rows with errors
    beyond `bend` times the mean absolute error of the rows before them (as a deviation; TUBE at least) count less, in proportion (the loss is linear there); steps=0 is the plain ridge regression.
    `log`: features and y as log(1 + value) of what is not negative, and the point back.

    Persistence with fewer than min_n rows or where a feature is null; rows without a known y have no forecast. Null labels and features add nothing to the sums.
    """
    def scaled(c: str):
        return F.log1p(F.greatest(F.col(c).cast("double"), F.lit(0.0))) if log else F.col(c).cast("double")

    w = series(key, date)
    rows = in_order(df.select(key, date, F.col(y).cast("double").alias("last"), scaled(y).alias("label"), F.array(*map(scaled, features)).alias("now")), [key], date)
    rows = rows.select("*", *(F.lag("now", h).over(w).alias(f"past{h}") for h in horizons))
    width = len(features)

    def block(b: pd.DataFrame, starts: np.ndarray, carried):
        label, last, now = b.label.to_numpy(float), b["last"].to_numpy(float), numbers(b.now)
        out, state = [], {}
        for h in horizons:
            past = numbers(b[f"past{h}"]).reshape(len(b), -1) if b[f"past{h}"].notna().any() else np.full((len(b), width), np.nan)
            fine = ~np.isnan(label) & ~np.isnan(past).any(axis=1)
            count, coef, state[h] = _fitted(np.nan_to_num(past), np.nan_to_num(label), fine, starts, carried and carried[h], ridge, steps, bend, min_n)
            value = coef[:, 0] + (coef[:, 1:] * now).sum(axis=1)
            if log:
                value = np.expm1(np.minimum(value, 50.0))
            point = np.maximum(np.where((count >= min_n) & np.isfinite(value), value, last), 0.0)
            seen = ~np.isnan(last)
            out.append(pd.DataFrame({"location": b[key][seen], "reference_date": b[date][seen], "h": np.int32(h), "point": point[seen]}))
        return pd.concat(out, ignore_index=True), state

    return scan(rows, block, "location string, reference_date date, h int, point double", [key], date)
