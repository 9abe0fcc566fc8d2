"""Pooled models at several cut-offs: nothing is learnt from after a cut-off, intervals cover, features are worth what a plain permutation says."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewell.operators import pooled
from tidewell.operators.features import lag_features

START = dt.date(2001, 1, 6)


def day(k: int) -> dt.date:
    return START + dt.timedelta(7 * k)


def simulated(spark, weeks: int = 160, places: int = 6):
    """Each series returns to a level of its own, with noise that grows with the level."""
    rng = np.random.default_rng(2)
    rows = []
    for p in range(places):
        v, level = 20.0 * (p + 1), 20.0 * (p + 1)
        for k in range(weeks):
            v = max(level + 0.7 * (v - level) + rng.normal(0, 0.1 * level), 0)
            rows.append((f"s{p}", day(k), float(v)))
    return spark.createDataFrame(rows, "location string, date date, y double")


@pytest.fixture(scope="module")
def panel(spark):
    return lag_features(simulated(spark), (1, 2)).fillna(0.0)


NAMES = ["y", "y_lag1", "y_lag2"]


def test_nothing_is_learnt_from_after_a_cutoff(panel):
    """What comes after the first cut-off changes nothing that is forecast at it."""
    cutoffs = [day(80), day(120)]
    after = F.col("date") > F.lit(day(80))
    spoilt = panel.withColumn("y", F.when(after, F.col("y") * 100 + 7).otherwise(F.col("y"))).withColumns({c: F.when(after, F.lit(1e6)).otherwise(F.col(c)) for c in NAMES[1:]})
    first, second = (pooled.forecast_pooled(x, NAMES, cutoffs, (2,), trees=3, scale="linear").where(F.col("reference_date") == F.lit(day(80))).toPandas().set_index("location").sort_index() for x in (panel, spoilt))
    assert len(first) == 6 and np.allclose(first.mu, second.mu) and np.allclose(first.sigma, second.sigma) and not np.allclose(first.label, second.label)


def test_folds_and_errors(panel):
    fc = pooled.forecast_pooled(panel, NAMES, [day(140), day(80)], (1, 3), trees=8)
    rows = fc.toPandas()
    assert rows.groupby(["h", "fold"]).size().to_dict() == {(h, f): 6 * n for h in (1, 3) for f, n in ((0, 60), (1, 20))}
    assert (rows[rows.fold == 0].reference_date.max(), rows[rows.fold == 1].reference_date.min()) == (day(139), day(140))
    seen = panel.select("location", "date", "y").toPandas().set_index(["location", "date"]).y
    for r in rows.sample(40, random_state=1).itertuples():
        want = seen.get((r.location, r.reference_date + dt.timedelta(7 * r.h)))
        assert (pd.isna(r.label) and want is None) or r.label == want
    errors = pooled.fold_errors(fc, panel).toPandas().set_index(["h", "fold"])
    own = rows[(rows.h == 3) & (rows.fold == 0)].dropna(subset="label")
    assert errors.mae[3, 0] == pytest.approx((own.label - own.mu).abs().mean()) and errors.n[3, 0] == len(own)
    assert errors.mae[3, 0] < 1.15 * errors.mae_last[3, 0] and errors.mae[3, 0] < 0.5 * rows.label.std()


@pytest.mark.parametrize(("scale", "log"), [("trees", True), ("linear", False)])
def test_intervals_cover(panel, scale, log):
    rows = pooled.forecast_pooled(panel, NAMES, [day(100)], (1,), scale=scale, log=log, trees=8).where("label is not null").toPandas()
    q = np.array(rows.quantiles.tolist())
    assert (np.diff(q, axis=1) >= -1e-9).all() and 0.65 < np.mean((rows.label >= q[:, 3]) & (rows.label <= q[:, 19])) < 0.93
    assert rows[rows.location == "s5"].sigma.mean() > 1.5 * rows[rows.location == "s0"].sigma.mean()
    assert abs(np.mean(rows.label - rows.mu)) < 0.1 * rows.label.mean()


def test_no_labels_yet(panel):
    with pytest.raises(ValueError, match="no label"):
        pooled.forecast_pooled(panel, NAMES, [day(0)], (1,), trees=2)
    with pytest.raises(ValueError, match="sideways"):
        pooled.forecast_pooled(panel, NAMES, [day(50)], (1,), scale="sideways")


def test_permutation_importance(panel):
    rows = panel.where(F.col("date") >= F.lit(day(2)))
    line = lambda c: 0.6 * c["y_lag1"] + 0.3 * c["y_lag2"] + 5
    got = pooled.permutation_importance(rows, NAMES[1:], line, seed=3).toPandas()
    frame = rows.toPandas()
    for name, g in frame.groupby("location"):
        key = [((d - dt.date(1970, 1, 1)).days * (2_654_435_761 + 6) % 4_294_967_296, d) for d in g.date]
        order = sorted(range(len(g)), key=key.__getitem__)
        worth = {}
        for f in NAMES[1:]:
            values = g[f].to_numpy()
            moved = values.copy()
            for a, b in zip(order, [*order[1:], order[0]], strict=True):
                moved[a] = values[b]
            x = {c: moved if c == f else g[c].to_numpy() for c in NAMES[1:]}
            worth[f] = np.mean(np.abs(g.y - line(x)) - np.abs(g.y - line({c: g[c].to_numpy() for c in NAMES[1:]})))
        own = got[got.location == name].set_index("feature")
        assert all(own.importance[f] == pytest.approx(worth[f], abs=1e-6) for f in worth) and own["rank"].to_dict() == {f: k + 1 for k, f in enumerate(sorted(worth, key=lambda f: -worth[f]))}


def test_tree_importances(panel):
    rng = F.rand(5)
    got = pooled.tree_importances(panel.withColumn("noise", rng), [*NAMES, "noise"], 1, day(150), trees=5).toPandas().set_index("feature")
    assert got.importance.sum() == pytest.approx(1.0) and got["rank"]["y"] == 1 and got.importance["noise"] < 0.2 and list(got["rank"]) == [1, 2, 3, 4, 5]
