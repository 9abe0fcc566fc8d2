"""One-pass operators over whole series: robust regressions, grids of settings, covariates by blocks, against plain loops."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewell.operators import aggregates, backtest, covariates, grid, joins, models, robust
from tidewell.operators.scan import in_order, running, scan

START = dt.date(2001, 1, 6)


def frame(spark, series: dict[str, list], columns: str = "y"):
    """A row a week for each value; None is a null, "-" no row."""
    rows = [(k, START + dt.timedelta(7 * i), None if v is None else float(v)) for k, values in series.items() for i, v in enumerate(values) if v != "-"]
    return spark.createDataFrame(rows, f"location string, date date, {columns} double")


def plain_robust(x, y, fine, ridge, steps, min_n):
    n = len(y)
    weight, betas = fine.astype(float), None
    for step in range(steps + 1):
        if step:
            count = np.cumsum(fine)
            first = fine & (count <= min_n)
            new, error, known = fine.astype(float), np.zeros(n), fine & (count.max() >= min_n)
            full = int(np.argmax(count >= min_n))
            for s in np.flatnonzero(known):
                beta = betas[full] if first[s] else betas[s - 1]
                error[s] = abs(y[s] - beta[0] - x[s] @ beta[1:])
            for s in np.flatnonzero(known):
                before = first if first[s] else known & (np.arange(n) < s)
                limit = max(robust.BEND * robust.SPREAD * (weight * error)[before].sum() / weight[before].sum(), robust.TUBE * (1 + abs(y[s])))
                new[s] = min(1.0, limit / error[s]) if error[s] else 1.0
            weight = new
        betas = []
        for t in range(n):
            w = weight[: t + 1, None]
            if not w.sum():
                betas.append(np.zeros(x.shape[1] + 1))
                continue
            mean, my = (w * x[: t + 1]).sum(0) / w.sum(), (w[:, 0] * y[: t + 1]).sum() / w.sum()
            cov, with_y = ((x[: t + 1] - mean) * w).T @ (x[: t + 1] - mean) / w.sum(), ((x[: t + 1] - mean) * w).T @ (y[: t + 1] - my) / w.sum()
            sd = np.sqrt(np.diag(cov))
            if (sd < 1e-4).any():
                betas.append(np.append(my, np.zeros(x.shape[1])))
                continue
            slope = np.linalg.solve(cov / np.outer(sd, sd) + ridge * np.eye(len(sd)), with_y / sd) / sd
            betas.append(np.append(my - slope @ mean, slope))
    return np.array(betas)


def test_robust_coefficients_in_blocks():
    rng = np.random.default_rng(0)
    x, fine = rng.normal(10, 3, (150, 2)), np.ones(150, bool)
    y = 1 + 2 * x[:, 0] - x[:, 1] + rng.normal(0, 1, 150)
    y[::17] += 60
    fine[[5, 40]] = False
    want = plain_robust(x, y, fine, 0.01, 2, 20)
    for cuts in ((0, 150), (0, 7, 13, 14, 51, 120, 150)):
        state, parts = None, []
        for a, b in zip(cuts, cuts[1:], strict=False):
            _, coef, state = robust._fitted(x[a:b], y[a:b], fine[a:b], np.array([0]), state, 0.01, 2, robust.BEND, 20)
            parts.append(coef)
        assert np.abs(np.concatenate(parts) - want)[25:].max() < 1e-9  # from min_n rows on there are forecasts


def test_robust_forecasts_withstand_outliers(spark):
    """y follows its last value; one label in twelve is far off. The plain fit is drawn away, the robust one is not."""
    rng = np.random.default_rng(3)
    series, clean = {}, {}
    for name in "abcd":
        v = [50.0]
        for _ in range(259):
            v.append(10 + 0.8 * v[-1] + rng.normal(0, 4))
        clean[name] = v
        series[name] = [x + (400 if i % 12 == 7 else 0) for i, x in enumerate(v)]
    rows = frame(spark, series).withColumn("x", F.col("y"))
    good = frame(spark, clean).withColumnRenamed("y", "x")  # the feature itself is clean: only labels are off
    rows = rows.drop("x").join(good, ["location", "date"])
    errors = {}
    for steps in (0, 2, 5):
        got = robust.forecast_robust(rows, ["x"], (1,), steps=steps).toPandas()
        truth = {(k, START + dt.timedelta(7 * i)): 10 + 0.8 * x for k, v in clean.items() for i, x in enumerate(v)}
        late = got[got.reference_date > START + dt.timedelta(7 * 150)]
        errors[steps] = np.mean([abs(r.point - truth[r.location, r.reference_date]) for r in late.itertuples()])
    assert errors[5] < 2 < 25 < errors[0] and errors[5] <= errors[2], errors


def test_robust_is_ridge_without_steps_and_takes_odd_rows(spark):
    rows = frame(spark, {"a": [float(k % 7) for k in range(40)] + [None] * 3 + [4.0] * 30, "b": [5.0] * 60, "c": [1.0, 2.0]}).withColumn("other", F.lit("clash"))
    got = robust.forecast_robust(rows, ["y"], (1, 3)).toPandas()
    assert len(got) == 2 * (70 + 60 + 2) and got.point.notna().all()
    assert (got[got.location == "b"].point - 5).abs().max() < 1e-9 and set(got[got.location == "c"].point) == {1.0, 2.0}
    assert robust.forecast_robust(rows.limit(0), ["y"]).count() == 0
    short = rows.where("location = 'a'").limit(40)
    plain = robust.forecast_robust(short, ["y"], (1,), steps=0).toPandas().set_index("reference_date").point.sort_index()
    x, y = np.array([k % 7 for k in range(39)], float)[:, None], np.array([k % 7 for k in range(1, 40)], float)
    beta = plain_robust(x, y, np.ones(39, bool), 1e-3, 0, 25)[-1]
    assert plain.iloc[-1] == pytest.approx(max(beta[0] + beta[1] * (39 % 7), 0))


def test_scan_wants_order(spark):
    rows = spark.createDataFrame([("a", START, 1.0), ("a", START - dt.timedelta(7), 2.0)], "location string, date date, y double").coalesce(1)
    with pytest.raises(Exception, match="in order of date"):
        scan(rows, lambda b, starts, carried: (b[["y"]], None), "y double").collect()
    assert running(np.ones((5, 1)), np.array([0, 3]), np.array([10.0]))[:, 0].tolist() == [11, 12, 13, 1, 2]


def test_scan_carries_over_batches(spark):
    """A long series in small Arrow batches beside short ones and one of a null key."""
    rows = [("a", START + dt.timedelta(7 * i), 1.0) for i in range(500)] + [(None, START + dt.timedelta(7 * i), 2.0) for i in range(5)] + [("b", START, 4.0)]
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        def block(b, starts, carried):
            total = running(b.y.to_numpy()[:, None], starts, carried)
            return pd.DataFrame({"location": b.location, "total": total[:, 0]}), total[-1]

        got = scan(in_order(spark.createDataFrame(rows, "location string, date date, y double")), block, "location string, total double").toPandas()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert got[got.location == "a"].total.max() == 500 and got[got.location.isna()].total.max() == 10 and got[got.location == "b"].total.tolist() == [4.0]


@pytest.mark.parametrize(("block", "days"), [(3, 70), (100, 7), (5, 10_000)])
def test_covariates_by_blocks(spark, block, days):
    rng = random.Random(block)
    series = {f"s{k:02}": [rng.choice([rng.gauss(100, 5), rng.gauss(100, 5), None, "-"]) for _ in range(40)] for k in range(14)}
    series |= {"flat": [7.1] * 40, "flat2": [0.1] * 40, "copy": series["s03"], "late": ["-"] * 39 + [3.0], "twice": [None if v in (None, "-") else 2 * v for v in series["s03"]]}
    rows = frame(spark, series)
    want = aggregates.rank_covariates(joins.covariate_join(rows.where("y is not null")), "corr", 4)
    got = covariates.top_covariates(rows, 4, block=block, days=days)
    keys = ["target", "rank"]
    both = got.toPandas().merge(want.toPandas(), on=keys, how="outer", suffixes=("", "_"), indicator=True)
    assert (both._merge == "both").all() and (both.covariate == both.covariate_).all()
    assert ((both.score - both.score_).abs().fillna(0) < 2e-9).all() and (both.score.isna() == both.score_.isna()).all()
    assert got.groupBy("target").count().where("count > 4").count() == 0
    assert covariates.top_covariates(rows.limit(0)).count() == 0 and covariates.top_covariates(rows.where("location = 's01'")).count() == 0


def noisy(spark):
    rng = np.random.default_rng(8)
    return frame(spark, {k: list(np.abs(np.cumsum(rng.normal(0, 3, 90)) + 40).round(2)) for k in "abc"} | {"short": [3.0, 4.0], "flat": [2.0] * 50})


def test_grid_holds_the_single_forecasts(spark):
    rows = noisy(spark)
    settings = [{"p": 1}, {"p": 2, "log": True}, {"p": 3, "ridge": 1e-2}, {"p": 1, "ridge": 0.0}]
    got = grid.forecast_grid(rows, settings, 3).toPandas()
    for k, g in enumerate(settings):
        want = models.forecast_ar(rows, horizons=(1, 2, 3), **({"p": 2} | g)).toPandas()
        both = got[got.k == k].merge(want, on=["location", "reference_date", "h"], how="outer", suffixes=("", "_"))
        assert len(both) == len(want) and (both.point - both.point_).abs().max() < 1e-6
    with pytest.raises(ValueError, match="settings"):
        grid.forecast_grid(rows, [{"p": 1, "trees": 3}])


def test_paths_of_differences(spark):
    """A line with an alternating step goes on as it is, with no deviation."""
    rows = frame(spark, {"line": [3.0 + 2 * k + (k % 2) for k in range(40)]})
    got = grid.forecast_grid(rows, [{"p": 1, "d": 1, "ridge": 0.0}], 4).toPandas()
    last = got[got.reference_date == got.reference_date.max()].sort_values("h")
    assert np.allclose(last.point, [3.0 + 2 * k + (k % 2) for k in range(40, 44)], atol=1e-6) and last.sigma.max() < 1e-3


def test_tuning_by_folds(spark):
    rows = noisy(spark)
    settings = [{"p": 1, "ridge": 0.0}, {"p": 2, "ridge": 0.0}]
    old = models.tune(rows, settings, START + dt.timedelta(7 * 60)).toPandas().set_index("location")
    new = grid.tune(rows, settings, cutoff=START + dt.timedelta(7 * 60)).toPandas().set_index("location")
    assert (old.mae - new.score).abs().max() < 1e-9 and all(old.params[x]["p"] == new.params[x]["p"] for x in old.index)
    folds = backtest.rolling_folds(rows, 40, 3, n_splits=4)
    scores = grid.grid_scores(rows, settings, folds, horizon=3).toPandas()
    single = {k: models.forecast_ar(rows, horizons=(1, 2, 3), **g).toPandas().set_index(["location", "reference_date", "h"]).point for k, g in enumerate(settings)}
    seen = rows.toPandas().set_index(["location", "date"]).y
    for r in folds.toPandas().itertuples():
        anchor = START + dt.timedelta(7 * (r.train_rows - 1))
        for k in (0, 1):
            errors = [abs(seen[r.location, START + dt.timedelta(7 * i)] - single[k][r.location, anchor, i - r.train_rows + 1]) for i in range(r.test_start, r.test_end)]
            own = scores[(scores.location == r.location) & (scores.fold == r.fold) & (scores.k == k)]
            assert len(own) == 1 and own.n.iloc[0] == 3 and own.score.iloc[0] == pytest.approx(np.mean(errors), abs=1e-6)
    assert set(scores.location) == {"a", "b", "c", "flat"}


def test_orders_with_differences(spark):
    """A drifting walk is best differenced, a series that returns to its mean is not; short series take the default."""
    rng = np.random.default_rng(5)
    walk, back = [500.0], [100.0]
    for _ in range(119):
        walk.append(walk[-1] + 3 + 0.9 * (walk[-1] - walk[-2] - 3 if len(walk) > 1 else 0) + rng.normal(0, 0.5))
        back.append(100 + 0.2 * (back[-1] - 100) + rng.normal(0, 5))
    rows = frame(spark, {"walk": walk, "back": back, "short": [1.0] * 5})
    got = {r.location: (r.p, r.d) for r in grid.select_orders(rows, ((1, 0), (1, 1))).collect()}
    assert got == {"walk": (1, 1), "back": (1, 0), "short": (1, 0)}
    made = grid.forecast_orders(rows, grid.select_orders(rows, ((1, 0), (1, 1))), ((1, 0), (1, 1)), 2)
    assert made.count() == 2 * (120 + 120 + 5)


def test_faded_means_over_blocks_and_gaps(spark):
    """As many values as several blocks hold, with nulls at their ends, and a fast decay whose powers need blocks of their own."""
    from tidewell.operators.features import ewm_features

    rng = np.random.default_rng(1)
    values = [None if k % 351 in (0, 1) or k % 97 == 5 else float(rng.normal(50, 20)) for k in range(1500)]
    rows = frame(spark, {"a": values, "b": [None, 3.0], "c": [1e6] * 400 + [1.0] * 30})
    got = ewm_features(rows, (0.1, 0.3, 0.5, 0.9)).orderBy("date").toPandas()
    assert list(got.columns) == ["location", "date", "y", "y_ewm10", "y_ewm30", "y_ewm50", "y_ewm90"]
    for name, g in got.groupby("location"):
        for a in (0.1, 0.3, 0.5, 0.9):
            s, w, want = 0.0, 0.0, []
            for v in g.y:
                if v == v:
                    s, w = s * (1 - a) + v, w * (1 - a) + 1
                want.append(s / w if w else np.nan)
            assert np.allclose(g[f"y_ewm{round(a * 100)}"], want, rtol=1e-12, equal_nan=True), (name, a)


def test_running_percentiles_of_a_long_series(spark):
    """20,000 weeks of one series in small blocks, against numpy at some dates; differences likewise."""
    from tidewell.functions.numeric import LEVELS
    from tidewell.operators.quantiles import error_quantiles, expanding_difference_quantiles

    rng = np.random.default_rng(4)
    y = rng.normal(0, 10, 20_000).round(1)
    rows = spark.createDataFrame(pd.DataFrame({"location": "a", "h": 1, "d": np.arange(len(y)), "error": y})).selectExpr("location", "cast(h as int) h", "date_add(date '1600-01-01', cast(d * 7 as int)) target_date", "error")
    fc = rows.selectExpr("location", "h", "target_date as reference_date", "100.0D as point")
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "999")
    try:
        got = error_quantiles(fc, rows).orderBy("reference_date").toPandas()
        panel = rows.selectExpr("location", "target_date as date", "error + 100 as y")
        moved = expanding_difference_quantiles(panel, (3,)).orderBy("reference_date").toPandas()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    for t in (10, 998, 999, 5000, 19_999):
        assert np.allclose(got.quantiles[t], np.maximum(100 + np.quantile(y[: t + 1], LEVELS), 0))
        diff = (y[3 : t + 1] + 100) - (y[: t - 2] + 100)
        q1, q3 = np.quantile(diff, [0.25, 0.75])
        fine = diff[(diff >= q1 - 1.5 * (q3 - q1)) & (diff <= q3 + 1.5 * (q3 - q1))]
        assert np.allclose(moved.quantiles[t], np.quantile(np.maximum(y[t] + 100 + fine, 0), LEVELS))
    assert moved.quantiles[0][11] == pytest.approx(y[0] + 100)  # no difference yet: the normal fallback


def test_weights_of_models_with_missing_dates(spark):
    """Model b lacks a date: its window still ends at the same dates. Where a model has no score, all are equal."""
    from tidewell.operators.ensemble import rolling_weights

    rows = [(h, START + dt.timedelta(7 * k), m, w) for h in (1, 2) for k in range(8) for m, w in (("a", 1.0), ("b", 3.0 if k < 5 else 1.0)) if not (m == "b" and k == 4)]
    scores = spark.createDataFrame(rows, "h int, reference_date date, model string, wis double")
    got = {(r.h, (r.reference_date - START).days // 7, r.model): r.weight for r in rolling_weights(scores, 2).collect()}
    assert len(got) == 2 * 8 * 2
    assert got[1, 2, "a"] == got[1, 3, "a"] == got[2, 4, "a"] == pytest.approx(0.75) and got[1, 0, "a"] == got[2, 1, "b"] == 0.5
    assert got[1, 5, "b"] == pytest.approx(0.25)  # of dates 3 and 4 it has the first only
    assert got[2, 6, "b"] == pytest.approx(0.25) and got[1, 7, "b"] == got[2, 7, "b"] + 0.0 == pytest.approx(0.5)
