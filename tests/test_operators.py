"""Operators on small panels made by hand."""

from datetime import date, timedelta
from statistics import NormalDist

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewell.functions import calendar, numeric
from tidewell.operators import aggregates, backtest, ensemble, features, impute, joins, models, quantiles, scoring, select
from tidewell.sources import tables

START = date(2024, 1, 6)


def panel(spark, **series):
    rows = [(k, START + timedelta(7 * i), None if v is None else float(v)) for k, values in series.items() for i, v in enumerate(values) if v != "gap"]
    return spark.createDataFrame(rows, "location string, date date, y double")


def by_key(df, key, value):
    return {tuple(r[k] for k in key): r[value] for r in df.collect()}


def values(df, location="a", column="y", date="date"):
    return [r[column] for r in df.where(F.col("location") == location).orderBy(date).collect()]


def test_calendar(spark):
    rows = spark.createDataFrame([(2015, 1), (2020, 1), (2020, 53), (2021, 1), (2025, 1), (2026, 1)], "y int, w int")
    found = [r[0] for r in rows.select(calendar.mmwr_to_date(F.col("y"), F.col("w"))).collect()]
    assert found == [date(2015, 1, 10), date(2020, 1, 4), date(2021, 1, 2), date(2021, 1, 9), date(2025, 1, 4), date(2026, 1, 10)]
    days = spark.createDataFrame([(date(2025, 1, 3),), (date(2025, 1, 4),), (date(2025, 1, 5),)], "d date")
    assert [tuple(r) for r in days.select(calendar.week_ending(F.col("d")), calendar.last_saturday(F.col("d"))).collect()] == [
        (date(2025, 1, 4), date(2024, 12, 28)), (date(2025, 1, 4), date(2025, 1, 4)), (date(2025, 1, 11), date(2025, 1, 4))]


def test_complete_and_interpolate(spark):
    p = panel(spark, a=[None, 2, "gap", 4, "gap", "gap", "gap", 8, None], b=[1, "gap", 9])
    done = impute.complete_weekly(p)
    assert len(values(done)) == 9 and len(values(done, "b")) == 3
    assert len(values(impute.complete_weekly(p, "global"), "b")) == 9
    assert values(impute.interpolate(done)) == [None, 2, 3, 4, 5, 6, 7, 8, None]
    assert values(impute.fill_down(done, ["y"]))[0] is None and values(impute.fill_down(done, ["y"]))[-1] == 8
    cube = [i**3 for i in range(8)]
    gappy = impute.complete_weekly(panel(spark, a=[v if i not in (3, 4) else "gap" for i, v in enumerate(cube)]))
    assert np.allclose(values(impute.interpolate(gappy, "cubic", 0.0)), cube)
    with pytest.raises(ValueError):
        impute.interpolate(gappy, "other")


def test_features_are_causal_and_match_pandas(spark):
    rng = np.random.default_rng(1)
    y = rng.poisson(20, 70).astype(float)
    y[5] = 0
    full, cut = (features.build_features(panel(spark, a=y[:n], b=y[:n][::-1])) for n in (70, 60))
    a, b = (x.where("location = 'a'").orderBy("date").toPandas() for x in (full, cut))
    pd.testing.assert_frame_equal(a.head(60), b)
    s = pd.Series(y)
    assert np.allclose(a.y_lag52[52:], s.shift(52)[52:]) and np.allclose(a.y_mean4, s.rolling(4, min_periods=1).mean())
    assert np.allclose(a.y_std8[1:], s.rolling(8, min_periods=2).std()[1:]) and np.allclose(a.y_ewm30, s.ewm(alpha=0.3).mean())
    pct = s.pct_change(1).replace([np.inf, -np.inf], np.nan).ffill().fillna(0)
    assert np.allclose(a.y_pct1, pct) and np.allclose(a.y_cummean, s.expanding().mean())
    with pytest.raises(ValueError):
        features.lag_features(full, (0, 1))


def test_line(spark):
    p = panel(spark, a=[3 * t + 2 for t in range(20)])
    assert np.allclose(values(features.theil_sen(p), column="y_slope8")[8:], 3) and values(features.theil_sen(p), column="y_slope8")[:8] == [None] * 8
    assert np.allclose(values(features.detrended_std(p), column="detrended_std"), 0, atol=1e-5)
    ar = models.forecast_ar1(p, (1, 4)).toPandas()
    last = ar[ar.reference_date == ar.reference_date.max()].set_index("h").point
    assert np.isclose(last[1], 62) and np.isclose(last[4], 71)
    two = models.forecast_ar(p, 2, (1, 4)).toPandas()
    assert np.allclose(two[two.reference_date == two.reference_date.max()].set_index("h").point[[1, 4]], [62, 71], atol=1e-2)


def test_ar_equals_least_squares(spark):
    rng = np.random.default_rng(3)
    y = np.abs(np.cumsum(rng.normal(0, 1, 60))) + 5
    got = models.forecast_ar(panel(spark, a=y), 2, (1,)).toPandas().sort_values("reference_date").point.to_numpy()
    for n in (30, 60):
        x = np.column_stack([np.ones(n - 2), y[1 : n - 1], y[: n - 2]])
        c = np.linalg.lstsq(x, y[2:n], rcond=None)[0]
        assert np.isclose(got[n - 1], max(0, c @ [1, y[n - 1], y[n - 2]]), atol=1e-5)


def test_order_of_rows_does_not_matter(spark):
    p = panel(spark, a=list(range(1, 40)), b=[5, 3] * 20)
    once, again = (models.forecast_ar1(q).orderBy("location", "reference_date", "h").toPandas() for q in (p, p.orderBy(F.rand(3)).repartition(7)))
    pd.testing.assert_frame_equal(once, again)


def test_linear_uses_only_known_labels(spark):
    y = [float(v) for v in np.random.default_rng(5).poisson(30, 60)]
    rows = lambda v: features.lag_features(panel(spark, a=v), (1,))
    a, b = (models.forecast_linear(rows(v), ["y", "y_lag1"], (2,)).orderBy("reference_date").toPandas() for v in (y, y[:50]))
    assert np.allclose(a.point[:50], b.point)


def test_small_samples(spark):
    for n in (1, 9, 10, 25):
        p = panel(spark, a=range(n))
        assert models.forecast_persistence(p).count() == 4 * n
        assert models.forecast_ar1(p).count() == 4 * n
        assert select.min_history(p, 10).count() == (n if n >= 10 else 0)
    assert quantiles.baseline_quantiles(panel(spark, a=[])).count() == 0


def wide(spark, rows):
    return spark.createDataFrame(rows, "model string, h int, location string, reference_date date, target_end_date date, quantiles array<double>, obs double")


def test_scores(spark):
    d = START
    exact = ("m", 1, "a", d, d, [5.0] * 23, 5.0)
    off = ("m", 1, "b", d, d, [7.0] * 23, 5.0)
    for variant in ("weighted_sum", "log_mean", "standard"):
        got = by_key(scoring.wis(wide(spark, [exact, off]), None, variant), ["location"], "wis")
        assert got[("a",)] == 0 and got[("b",)] > 0
    q = sorted(NormalDist(10, 3).inv_cdf(x) for x in numeric.LEVELS)
    one = scoring.wis(wide(spark, [("m", 1, "a", d, d, q, 14.0)]), None, "weighted_sum", True).first()
    want, low = 0.5 * 4, 0.0
    for k, level in enumerate(numeric.LEVELS[:11]):
        a = 1 - 2 * level
        want += a / 2 * (q[22 - k] - q[k] + 2 / a * (max(0, q[k] - 14) + max(0, 14 - q[22 - k])))
        low += 2 / a * max(0, 14 - q[22 - k]) / 11
    assert np.isclose(one.wis, want) and np.isclose(one.underprediction, low) and one.overprediction == 0


def test_log_score_counts_twenty_terms(spark):
    q = sorted(NormalDist(10, 2).inv_cdf(x) for x in numeric.LEVELS)
    got = scoring.wis(wide(spark, [("m", 1, "a", START, START, q, 11.0)]), None, "log_mean").first().wis
    terms = []
    for k, level in enumerate(numeric.LEVELS[:12]):
        lo, hi, y = np.log(q[k] + 1), np.log(q[22 - k] + 1), np.log(12)
        terms += [hi - lo + 2 / level * (max(0, lo - y) + max(0, y - hi))] * (2 if level in scoring.TWICE else 1)
    assert len(terms) == 20 and np.isclose(got, np.mean(terms))


def scores(spark, table):
    rows = [(m, 1, "a", START + timedelta(7 * t), START + timedelta(7 * t + 7), float(w)) for m, ws in table.items() for t, w in enumerate(ws) if w is not None]
    return spark.createDataFrame(rows, "model string, h int, location string, reference_date date, target_end_date date, wis double")


def test_weights(spark):
    s = scores(spark, {"x": [1] * 6, "y": [3] * 6, "z": [None] * 6})
    names = spark.createDataFrame([(1, m) for m in "xyz"], "h int, model string")
    w = by_key(ensemble.ensemble_weights(s, names, START + timedelta(42)), ["model"], "weight")
    assert np.isclose(w["x",], 0.75) and np.isclose(w["y",], 0.25) and w["z",] == 0
    none = by_key(ensemble.ensemble_weights(s, names, START), ["model"], "weight")
    assert all(np.isclose(v, 1 / 3) for v in none.values())
    roll = ensemble.rolling_weights(scores(spark, {"x": [1] * 6, "y": [3, 3, 3, 3, 1, 1]}), 4).toPandas()
    assert np.allclose(roll.groupby("reference_date").weight.sum(), 1)
    assert np.isclose(roll[(roll.reference_date == START) & (roll.model == "x")].weight.iloc[0], 0.5)
    late = ensemble.rolling_weights(scores(spark, {"x": [1] * 6, "y": [3] * 6}), 4, True).toPandas()
    assert np.isclose(late[(late.reference_date == START + timedelta(35)) & (late.model == "x")].weight.iloc[0], 0.75)


def test_combine_without_weights_is_the_mean(spark):
    fc = spark.createDataFrame([(m, 1, START, START, "t", "a", "quantile", 0.5, v) for m, v in (("x", 1.0), ("y", 3.0))], "model string, h int, reference_date date, target_end_date date, target string, location string, output_type string, output_type_id double, value double")
    for w, want in (((0.0, 0.0), 2.0), ((1.0, 0.0), 1.0), ((0.25, 0.75), 2.5)):
        weights = spark.createDataFrame([(1, "x", w[0]), (1, "y", w[1])], "h int, model string, weight double")
        assert ensemble.ensemble_combine(fc, weights).first().value == want


def test_residual_ladder(spark):
    fc = spark.createDataFrame([("a", START, 1, 10.0)], "location string, reference_date date, h int, point double")
    for n in (0, 5, 10):
        r = spark.createDataFrame([("a", 1, 0.1 * k) for k in range(n)], "location string, h int, residual double")
        for scale in ("log1p", "pct", "raw"):
            for rule in ("scaled", "skip"):
                q = quantiles.residual_quantiles(fc, r, scale, rule).first().quantiles
                assert len(q) == 23 and q == sorted(q) and q[0] >= 0
                if n == 10 and scale == "raw":
                    assert np.allclose(q, 10 + np.quantile([0.1 * k for k in range(10)], numeric.LEVELS))
                if n == 0 or n == 5 and rule == "skip":
                    assert np.isclose(q[11], 10) and np.isclose(q[22], 10 + 5 * NormalDist().inv_cdf(0.99))


def test_difference_quantiles_drop_outliers(spark):
    y = [10.0, 11, 10, 11, 10, 11, 10, 11, 1000, 10, 11, 10]
    q = quantiles.difference_quantiles(panel(spark, a=y), 1).first().quantiles
    assert max(q) < 20 and q == sorted(q)


def test_joins(spark):
    p = panel(spark, a=[1, 2, "gap", 4], b=[5, 6, 7, 8])
    labels = by_key(joins.label_at_horizon(p, (1, 2)), ["location", "date", "h"], "label")
    assert ("a", START + timedelta(7), 1) not in labels and labels["a", START + timedelta(7), 2] == 4
    anchors = spark.createDataFrame([("a", START + timedelta(15)), ("a", START - timedelta(1))], "location string, anchor date")
    assert [r.row.y for r in joins.row_as_of(p, anchors).collect()] == [2.0]
    assert select.complete_case_dates(p).count() == 6
    pairs = joins.covariate_join(p)
    assert pairs.count() == 6 and aggregates.rank_covariates(pairs, "corr", 1).count() == 2
    s = spark.createDataFrame([("x", 1, "a", START), ("y", 1, "a", START), ("x", 1, "b", START)], "model string, h int, location string, target_end_date date")
    assert {r.location for r in joins.common_keys(s).collect()} == {"a"}


def test_aggregates(spark):
    df = spark.createDataFrame([("a", 1.0, 0.0), ("a", 4.0, 0.0), ("b", 0.0, 2.0)], "g string, v double, w double")
    assert by_key(aggregates.geo_mean(df, "v", ["g"]), ["g"], "geo_mean") == {("a",): pytest.approx(2.0), ("b",): None}
    assert by_key(aggregates.weighted_mean(df, "v", "w", ["g"]), ["g"], "value") == {("a",): 2.5, ("b",): 0.0}
    line = spark.createDataFrame([(float(x), 2.0 * x + 1 + (0.1 if x % 2 else -0.1)) for x in range(10)], "x double, y double")
    fit = aggregates.fit_lm(line, "y", "x").first()
    assert np.isclose(fit.slope, 2, atol=0.05) and fit.t_value > 50 and fit.n == 10
    assert aggregates.fit_lm(line.limit(1), "y", "x").first().t_value is None
    half = aggregates.median_bias(spark.createDataFrame([("a", 1, float(k)) for k in range(4)], "location string, h int, error double"))
    assert half.first().bias == 0


def test_backtests(spark):
    p = panel(spark, a=range(30), b=range(8))
    folds = backtest.rolling_folds(p, 10, 2, 5)
    assert [(r.location, r.train_rows, r.test_end) for r in folds.orderBy("fold").collect()] == [("a", n, n + 2) for n in (10, 15, 20, 25)]
    rows = backtest.fold_rows(p, folds)
    assert rows.count() == 8 and rows.where("y < train_rows").count() == 0
    assert backtest.rolling_folds(p, 10, 2, n_splits=3).count() == 3
    cut = backtest.assemble(p, 3, START + timedelta(70))
    assert cut.where("split = 'train'").agg(F.max("label_date")).first()[0] <= START + timedelta(70)
    assert backtest.half_anchors_sample(p, 5, (1,)).groupBy("location").count().agg(F.max("count")).first()[0] == 5


def test_blend_and_fan(spark):
    rows = spark.createDataFrame([("a", 1, 10.0 + k, 20.0, 11.0 + k) for k in range(25)], "location string, h int, point double, last double, obs double")
    got = models.calibrate_bias_blend(rows).first()
    assert got.bias == 1 and got.alpha == 1
    assert models.calibrate_bias_blend(rows.limit(3)).first().bias == 0
    long = spark.createDataFrame([("a", START, START, q, v) for q, v in ((0.01, 5.0), (0.25, 2.0), (0.5, 3.0), (0.75, 9.0), (0.99, 4.0))], "location string, reference_date date, target_end_date date, output_type_id double, value double")
    fan = ensemble.fan_chart(long).first()
    assert fan.q01 <= fan.q05 <= fan.q25 <= fan.median <= fan.q75 <= fan.q95 <= fan.q99


def test_inverse_normal(spark):
    p = [0.001, 0.02, 0.3, 0.5, 0.9, 0.9999]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in p], "p double").select(numeric.inverse_normal(F.col("p"))).collect()]
    assert np.allclose(got, [NormalDist().inv_cdf(x) for x in p], atol=1e-8)


def test_sources(spark, tmp_path):
    (tmp_path / "loc.csv").write_text("﻿abbreviation,location,location_name,population,count_rate1per100k,count_rate2per100k\nAL,01,Alabama,5024279,15,100\n", encoding="utf-8")
    dim = tables.read_locations(spark, str(tmp_path / "loc.csv")).first()
    assert dim.location == "01" and dim.abbreviation == "AL" and dim.population == 5024279
    (tmp_path / "rates.csv").write_text("AGE CATEGORY,SEX CATEGORY,RACE CATEGORY,CATCHMENT,WEEKLY RATE,MMWR-YEAR,MMWR-WEEK\nOverall,Overall,Overall,Entire Network,null,2020,1\nOverall,Male,Overall,Ohio,3,2020,1\nOverall,Overall,Overall,Ohio,1.5,2020,2\n")
    assert {(r.location_name, r.rate, str(r.date)) for r in tables.read_rate_feed(spark, str(tmp_path / "rates.csv")).collect()} == {("US", 0.0, "2020-01-04"), ("Ohio", 1.5, "2020-01-11")}
    for n, day in (("t1", "2022-01-01"), ("t2", "2022-07-02")):
        (tmp_path / f"{n}.csv").write_text(f"date,location,location_name,value\n{day},01,Alabama,4\n2030-01-01,01,Alabama,9\n")
    truth = tables.read_truth(spark, [str(tmp_path / "t1.csv"), str(tmp_path / "t2.csv")], [("2021-07-01", "2022-06-01"), ("2022-06-01", "2029-01-01")])
    assert sorted(str(r.date) for r in truth.collect()) == ["2022-01-01", "2022-07-02"]
    p = panel(spark, a=[1, 2])
    for day in ("2024-01-13", "2024-01-20", "2024-01-20"):
        tables.write_panel(p, str(tmp_path / "panel"), day)
    stored = spark.read.parquet(str(tmp_path / "panel"))
    assert stored.count() == 4 and str(tables.latest_snapshot(stored).first().as_of) == "2024-01-20"
    assert str(tables.snapshot_bounds(p, 1).first().cutoff) == "2024-01-06"
    fc = select.format_forecast(quantiles.baseline_quantiles(p)).withColumns({"model": F.lit("m"), "h": F.col("horizon") + 1})
    tables.write_forecasts(fc, str(tmp_path / "fc"))
    back = tables.read_forecasts(spark, str(tmp_path / "fc"), ["m", "absent"], [1, 2])
    assert back.count() == fc.where("h <= 2").count() and back.columns[:8] == list(tables.FORECAST)
    old = fc.withColumnRenamed("output_type_id", "quantile").drop("output_type")
    assert tables.conform_forecasts(old).first().output_type == "quantile"
    runs = back.withColumn("run", F.lit(1)).unionByName(back.withColumn("run", F.lit(2)))
    assert tables.newest_run(runs).where("run = 1").count() == 0
    assert {(r.folder, r.h) for r in tables.list_configurations(spark, str(tmp_path / "fc"), r"(model=\w+)/h=(\d)").collect()} == {("model=m", h) for h in (1, 2, 3, 4)}
    params = spark.createDataFrame([("a", {"p": 1.0}, [1]), ("b", {"p": 1.0, "ridge": 0.1}, [0]), ("c", None, None)], "location string, params map<string,double>, lags array<int>")
    assert sorted((r.location, r.problem) for r in tables.validate_params(params).collect()) == [("a", "missing: ridge"), ("b", "lag below 1"), ("c", "missing: p"), ("c", "missing: ridge")]
