"""Queries of the model families that work through whole series in one pass: robust regressions, grids of settings, orders with differences, covariates by blocks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.functions.numeric import inverse_normal
from tidewell.operators import aggregates, backtest, covariates, ensemble, features, grid, pooled, quantiles, robust, scoring
from tidewell.plans.queries import _COV, _QS, _ROLL, _W, _levels_out, _panel, _r, _rounded, _stored_scores, _with, query
from tidewell.plans.views import filled, rank_scores, shipped

# ---------------------------------------------------------------------------------------------- robust regression


def _robust(ridge: float, steps: int, bend: float, min_n: int) -> dict[str, str]:
    """Parts that fit y on x1 (with w0, 1 where both are known) in `steps` steps of weights at every row of each (location, h): the last one has a, b and n."""
    series = "PARTITION BY location, h ORDER BY date"
    out = {"step_0": "SELECT *, CASE WHEN x1 IS NOT NULL AND y IS NOT NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS w0 FROM lagged"}
    for k in range(steps + 1):
        if k:
            later = f"first_value(CASE WHEN n{k - 1} >= {min_n} THEN {{0}}{k - 1} END IGNORE NULLS) OVER (s ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
            at = {c: f"CASE WHEN n{k - 1} <= {min_n} THEN {later.format(c)} ELSE lag({c}{k - 1}) OVER s END" for c in "ab"}
            out[f"error_{k}"] = f"""
                SELECT *, CASE WHEN w0 = 1 THEN abs(y - {at['a']} - {at['b']} * x1) END AS e{k}, w0 = 1 AND n{k - 1} <= {min_n} AS first{k}
                FROM fit_{k - 1} WINDOW s AS ({series})"""
            total = f"{bend * robust.SPREAD!r} * sum(w{k - 1} * e{k}) OVER {{0}} / nullif(sum(CASE WHEN e{k} IS NOT NULL THEN w{k - 1} END) OVER {{0}}, 0)"
            out[f"scale_{k}"] = f"""
                SELECT *, CASE WHEN first{k} THEN {total.format('f')} ELSE {total.format('p')} END AS q{k}
                FROM error_{k} WINDOW p AS ({series} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), f AS (PARTITION BY location, h, first{k})"""
            out[f"limit_{k}"] = f"SELECT *, CASE WHEN q{k} IS NOT NULL THEN greatest(q{k}, {robust.TUBE} * (1 + abs(y))) END AS m{k} FROM scale_{k}"
            out[f"step_{k}"] = f"SELECT *, CASE WHEN e{k} > m{k} THEN m{k} / e{k} ELSE w0 END AS w{k} FROM limit_{k}"
        w = f"w{k}"
        sums = ", ".join(f"sum(CASE WHEN w0 = 1 THEN {w} * {e} ELSE 0 END) OVER s AS {n}" for n, e in (("sw", "1"), ("sx", "x1"), ("sy", "y"), ("sxx", "x1 * x1"), ("sxy", "x1 * y")))
        out[f"sums_{k}"] = f"SELECT *, sum(w0) OVER s AS n{k}, {sums} FROM step_{k} WINDOW s AS ({series} ROWS UNBOUNDED PRECEDING)"
        out[f"means_{k}"] = f"SELECT * EXCLUDE (sw, sx, sy, sxx, sxy), sx / nullif(sw, 0) AS mx, sy / nullif(sw, 0) AS my, sxx / nullif(sw, 0) AS mxx, sxy / nullif(sw, 0) AS mxy FROM sums_{k}"
        slope = f"CASE WHEN mxx - mx * mx > 1e-9 * (1 + mx * mx) THEN (mxy - mx * my) / ((mxx - mx * mx) * {1 + ridge!r}) ELSE 0 END"
        out[f"slope_{k}"] = f"SELECT *, {slope} AS b{k} FROM means_{k}"
        out[f"fit_{k}"] = f"SELECT * EXCLUDE (mx, my, mxx, mxy), my - b{k} * mx AS a{k} FROM slope_{k}"
    return out


_LAGGED = " UNION ALL ".join(f"SELECT *, {h} AS h, lag(y, {h}) OVER {_W} AS x1 FROM filled" for h in (1, 2, 3, 4))


@query(_with(
    "filled", lagged=_LAGGED, **_robust(1e-3, 2, robust.BEND, 25),
    final=f"SELECT location, date AS reference_date, h, {_r('greatest(0, CASE WHEN n2 >= 25 THEN a2 + b2 * y ELSE y END) AS point', digits=4)} FROM fit_2",
))
def robust_of_one(spark, sf_dir):
    return _rounded(robust.forecast_robust(filled(spark, sf_dir), ["y"], steps=2), 4)


@query(_with(
    "filled", pairs_c=_COV, scored_c="SELECT target, covariate, round(abs(covar_pop(x, y) / nullif(stddev_pop(x) * stddev_pop(y), 0)), 9) AS score FROM pairs_c GROUP BY 1, 2",
    best_c="SELECT * FROM scored_c QUALIFY row_number() OVER (PARTITION BY target ORDER BY score DESC NULLS LAST, covariate) = 1",
    logs="SELECT location, date, ln(greatest(y, 0) + 1) AS y FROM filled",
    lagged="SELECT l.location, l.date, l.y, 2 AS h, lag(o.y, 2) OVER (PARTITION BY l.location ORDER BY l.date) AS x1, coalesce(o.y, 0) AS now FROM logs l LEFT JOIN best_c b ON b.target = l.location LEFT JOIN logs o ON o.location = b.covariate AND o.date = l.date".replace("lag(o.y, 2)", "lag(coalesce(o.y, 0), 2)"),
    **_robust(1e-3, 2, robust.BEND, 25),
    final=f"SELECT location, date AS reference_date, CAST(h AS INTEGER) AS h, {_r('greatest(0, CASE WHEN n2 >= 25 THEN exp(a2 + b2 * now) - 1 ELSE exp(y) - 1 END) AS point', digits=4)} FROM fit_2",
))
def robust_of_covariate(spark, sf_dir):
    """On the log scale, from the best covariate alone, two weeks ahead."""
    rows = covariates.with_top_covariates(_panel(spark, sf_dir), 1)
    return _rounded(robust.forecast_robust(rows, ["x1"], (2,), steps=2, log=True), 4)


# ---------------------------------------------------------------------------------------------- covariates by blocks


@query(_with(
    "filled", pairs=_COV, scored="SELECT target, covariate, round(abs(covar_pop(x, y) / nullif(stddev_pop(x) * stddev_pop(y), 0)), 9) AS score FROM pairs GROUP BY 1, 2",
    final="SELECT target, covariate, round(score, 6) + 0.0 AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY score DESC NULLS LAST, covariate) AS rank FROM scored) WHERE rank <= 5",
))
def covariates_by_blocks(spark, sf_dir):
    return _rounded(covariates.top_covariates(filled(spark, sf_dir), 5, block=8, days=7 * 64))


# ---------------------------------------------------------------------------------------------- grids of settings

_GRID = [{"p": 1, "ridge": 1e-3}, {"p": 1, "ridge": 0.5}]
_FOLDS = {
    "n_f": "SELECT location, count(*) AS n, greatest(1, floor((count(*) - 102) / 2)) AS width FROM filled GROUP BY 1 HAVING count(*) > 102",
    "folds": "SELECT location, f AS fold, CAST(100 + f * width AS INTEGER) AS train_rows FROM n_f, (VALUES (0), (1)) t(f) WHERE 100 + f * width <= n - 2",
}
_TUNE = {
    "pairs_t": f"SELECT *, row_number() OVER {_W} AS r, lag(y) OVER {_W} AS x1, lead(y) OVER {_W} AS o1, lead(y, 2) OVER {_W} AS o2 FROM filled",
    "sums_t": "SELECT *, count(x1) OVER w AS n, sum(x1) OVER w AS sx, sum(CASE WHEN x1 IS NOT NULL THEN y END) OVER w AS sy, sum(x1 * x1) OVER w AS sxx, sum(x1 * y) OVER w AS sxy, sum(CASE WHEN x1 IS NOT NULL THEN y * y END) OVER w AS syy FROM pairs_t WINDOW w AS (PARTITION BY location ORDER BY date ROWS UNBOUNDED PRECEDING)",
    "slopes_t": "SELECT s.*, fold, k, (n * sxy - sx * sy) / (n * sxx * (1 + ridge) - sx * sx) AS b FROM sums_t s JOIN folds USING (location) CROSS JOIN (VALUES " + ", ".join(f"({k}, {g['ridge']}::DOUBLE)" for k, g in enumerate(_GRID)) + ") g(k, ridge) WHERE r = train_rows",
    "fits_t": "SELECT *, (sy - b * sx) / n AS a FROM slopes_t",
    "spread_t": "SELECT *, sqrt(greatest(0, syy - 2 * (a * sy + b * sxy) + a * a * n + 2 * a * b * sx + b * b * sxx) / n) AS s FROM fits_t",
    "ahead_t": "SELECT location, fold, k, greatest(0, a + b * y) AS point, s AS sigma, o1 AS obs, 1 AS h FROM spread_t UNION ALL SELECT location, fold, k, greatest(0, a + b * (a + b * y)), s * sqrt(1 + b * b), o2, 2 FROM spread_t",
}
_WIS_T = "SELECT location, fold, ahead_t.k, 0.5 * abs(obs - point) + sum(alpha / 2 * (greatest(0, point + zh * sigma) - greatest(0, point + zl * sigma) + 2 / alpha * (greatest(0, greatest(0, point + zl * sigma) - obs) + greatest(0, obs - greatest(0, point + zh * sigma))))) AS wis FROM ahead_t, ivals GROUP BY location, fold, ahead_t.k, h, point, sigma, obs"


@query(_with(
    "filled", "ivals", **_FOLDS, **_TUNE, wis_t=_WIS_T,
    final=f"SELECT location, CAST(k AS INTEGER) AS k, CAST(fold AS INTEGER) AS fold, {_r('avg(wis) AS score', digits=4)}, count(*) AS n FROM wis_t GROUP BY 1, 2, 3",
))
def grid_by_folds(spark, sf_dir):
    """Two settings by two folds, by the interval score of two weeks."""
    panel = _panel(spark, sf_dir)
    return _rounded(grid.grid_scores(panel, _GRID, backtest.rolling_folds(panel, 100, 2, n_splits=2), horizon=2, score="wis"), 4)


@query(_with(
    "filled", "ivals", **_FOLDS, **_TUNE, wis_t=_WIS_T,
    per_fold="SELECT location, k, fold, avg(wis) AS score FROM wis_t GROUP BY 1, 2, 3", means_t="SELECT location, k, avg(score) AS score FROM per_fold GROUP BY 1, 2",
    final=f"SELECT location, CAST(first(k ORDER BY round(score, 9), k) AS INTEGER) AS k, first(CASE k WHEN 0 THEN 1e-3 ELSE 0.5 END::DOUBLE ORDER BY round(score, 9), k) AS ridge, {_r('min(score) AS score', digits=4)} FROM means_t GROUP BY 1",
))
def tuned_by_folds(spark, sf_dir):
    panel = _panel(spark, sf_dir)
    best = grid.tune(panel, _GRID, backtest.rolling_folds(panel, 100, 2, n_splits=2), score="wis", horizon=2)
    return _rounded(best.select("location", "k", F.col("params")["ridge"].alias("ridge"), "score"), 4)


@query()
def tuned_grid(spark, sf_dir):
    """Twelve settings by eight folds of four weeks, in one pass."""
    panel = _panel(spark, sf_dir)
    settings = [{"p": p, "d": d, "log": log, "ridge": ridge} for p, d in ((1, 0), (2, 0), (2, 1)) for log in (False, True) for ridge in (1e-6, 1e-2)]
    return _rounded(grid.tune(panel, settings, backtest.rolling_folds(panel, 60, 4, n_splits=8), score="wis", horizon=4))


# ---------------------------------------------------------------------------------------------- orders with differences


def _order_one(source: str, d: int) -> dict[str, str]:
    """Parts that fit the value (or its difference) on the one before, at every row: the last one has a, b (null where not determined) and n."""
    z = f"SELECT *, {f'y - lag(y) OVER {_W}' if d else 'y'} AS z FROM {source}"
    return {
        f"z_{d}": z,
        f"pairs_{d}": f"SELECT *, lag(z) OVER {_W} AS x1 FROM z_{d}",
        f"fit_{d}": f"SELECT location, date, y, z, count(x1) OVER w AS n, CASE WHEN var_pop(x1) OVER w > 1e-6 * (1 + pow(avg(x1) OVER w, 2)) THEN covar_pop(x1, z) OVER w / var_pop(x1) OVER w END AS b, avg(x1) OVER w AS mx, avg(CASE WHEN x1 IS NOT NULL THEN z END) OVER w AS mz, var_pop(CASE WHEN x1 IS NOT NULL THEN z END) OVER w AS vz, covar_pop(x1, z) OVER w AS cz FROM pairs_{d} WINDOW w AS (PARTITION BY location ORDER BY date ROWS UNBOUNDED PRECEDING)",
        f"order_{d}": f"SELECT *, mz - b * mx AS a, sqrt(greatest(0, vz - b * cz)) AS s FROM fit_{d}",
    }


@query(_with(
    "filled", **_order_one("filled", 1),
    path="SELECT *, a + b * z AS z1, a + b * (a + b * z) AS z2, a + b * (a + b * (a + b * z)) AS z3 FROM order_1",
    steps="SELECT *, 1 + b AS p2, 1 + b + b * b AS p3 FROM path",
    ahead="SELECT location, date AS reference_date, 1 AS h, n, b, y, z, y + z1 AS f, s AS sigma FROM steps UNION ALL SELECT location, date, 2, n, b, y, z, y + z1 + z2, s * sqrt(1 + p2 * p2) FROM steps UNION ALL SELECT location, date, 3, n, b, y, z, y + z1 + z2 + z3, s * sqrt(1 + p2 * p2 + p3 * p3) FROM steps",
    final=f"SELECT location, reference_date, CAST(h AS INTEGER) AS h, {_r('greatest(0, CASE WHEN n >= 11 AND b IS NOT NULL AND z IS NOT NULL THEN f ELSE y END) AS point', 'CASE WHEN n >= 11 AND b IS NOT NULL AND z IS NOT NULL THEN sigma ELSE greatest(0.25 * abs(y), 5.0) END AS sigma', digits=4)} FROM ahead",
))
def differenced_ar1(spark, sf_dir):
    """Order one of the differences, added up along the path, with deviations."""
    return _rounded(grid.forecast_grid(filled(spark, sf_dir), [{"p": 1, "d": 1, "ridge": 0.0}], 3).drop("k"), 4)


_ORDERS = {
    "half": f"SELECT location, date, y FROM (SELECT *, row_number() OVER {_W} AS r, count(*) OVER (PARTITION BY location) AS c FROM filled) WHERE r <= c // 2",
    **_order_one("half", 0),
    **_order_one("half", 1),
    "tried": "SELECT 0 AS d, location, date, greatest(0, CASE WHEN n >= 11 AND b IS NOT NULL THEN a + b * z ELSE y END) AS point FROM order_0 UNION ALL SELECT 1, location, date, greatest(0, CASE WHEN n >= 11 AND b IS NOT NULL AND z IS NOT NULL THEN y + a + b * z ELSE y END) FROM order_1",
    "errs": "SELECT t.location, d, avg(abs(o.y - point)) AS e FROM tried t JOIN half o ON o.location = t.location AND o.date = t.date + 7 GROUP BY 1, 2",
    "best": "SELECT location, first(d ORDER BY round(e, 9), d) AS d FROM errs GROUP BY 1",
}


@query(_with("filled", **_ORDERS, final="SELECT c.location, 1 AS p, CAST(CASE WHEN n >= 20 THEN coalesce(d, 0) ELSE 0 END AS INTEGER) AS d FROM (SELECT location, count(y) AS n FROM filled GROUP BY 1) c LEFT JOIN best USING (location)"))
def order_with_differences(spark, sf_dir):
    return grid.select_orders(_panel(spark, sf_dir), ((1, 0), (1, 1)), ridge=0.0)


@query()
def forecast_by_order(spark, sf_dir):
    """The order of each location chosen on its first half, then forecasts of four weeks on the log scale at every anchor."""
    panel, orders = _panel(spark, sf_dir), ((1, 0), (2, 0), (1, 1), (2, 1))
    return _rounded(grid.forecast_orders(panel, grid.select_orders(panel, orders, log=True), orders, log=True))


# ---------------------------------------------------------------------------------------------- pooled models at several cut-offs

_CUTOFFS = ("1997-06-07", "1998-12-05", "2000-06-03")


def _features(spark, sf_dir):
    rows = features.build_features(_panel(spark, sf_dir), groups=("rolling", "season"))
    return rows, [*features.feature_names(rows), "y"]


@query()
def trees_by_fold(spark, sf_dir):
    """Errors of pooled trees at three cut-offs, one and three weeks ahead, beside those of the last value."""
    rows, names = _features(spark, sf_dir)
    return _rounded(pooled.fold_errors(pooled.forecast_pooled(rows, names, _CUTOFFS, (1, 3), trees=5), rows))


@query()
def two_stage_by_fold(spark, sf_dir):
    """Location and scale by trees on the log scale, fitted at two cut-offs: interval scores and coverage of the middle 80 %."""
    rows, names = _features(spark, sf_dir)
    fc = pooled.forecast_pooled(rows, names, _CUTOFFS[1:], (1, 2), scale="trees", log=True, trees=5).where("label is not null").withColumnRenamed("label", "obs")
    inside = F.avg(((F.col("obs") >= F.col("quantiles")[3]) & (F.col("obs") <= F.col("quantiles")[19])).cast("double")).alias("coverage")
    scored = scoring.wis(fc)
    return _rounded(scored.groupBy("h", "fold").agg(F.avg("wis").alias("mean_wis"), inside, F.count("*").alias("n")))


@query()
def feature_gains(spark, sf_dir):
    rows, names = _features(spark, sf_dir)
    return _rounded(pooled.tree_importances(rows, names, 1, _CUTOFFS[-1], trees=5))


_MOVED = "CASE WHEN row_number() OVER s = count(*) OVER (PARTITION BY location) THEN first_value({0}) OVER (s ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) ELSE lead({0}) OVER s END AS m_{0}"


@query(_with(
    "filled", "shipped",
    joined="SELECT f.location, f.date, f.y, s.x, lag(f.y) OVER (PARTITION BY f.location ORDER BY f.date) AS l FROM filled f JOIN shipped s ON f.location = s.location AND f.date = s.date",
    rows_i="SELECT * FROM joined WHERE l IS NOT NULL",
    fits_i="SELECT location, regr_slope(y, x) AS bx, regr_intercept(y, x) AS ax, regr_slope(y, l) AS bl, regr_intercept(y, l) AS al FROM rows_i GROUP BY 1",
    moved_i=f"SELECT *, {_MOVED.format('x')}, {_MOVED.format('l')} FROM rows_i WINDOW s AS (PARTITION BY location ORDER BY (CAST(date - DATE '1970-01-01' AS HUGEINT) * 2654435763) % 4294967296, date)",
    both_i="SELECT *, (ax + bx * x + al + bl * l) / 2 AS p0, (ax + bx * m_x + al + bl * l) / 2 AS px, (ax + bx * x + al + bl * m_l) / 2 AS pl FROM moved_i JOIN fits_i USING (location)",
    worth="SELECT location, 'x' AS feature, avg(abs(y - px) - abs(y - p0)) AS importance FROM both_i GROUP BY 1 UNION ALL SELECT location, 'l', avg(abs(y - pl) - abs(y - p0)) FROM both_i GROUP BY 1",
    final=f"SELECT location, feature, {_r('importance', digits=5)} FROM worth",
))
def permuted_features(spark, sf_dir):
    """The worth of last week's value and of the quantity shipped, in the mean of two lines fitted for each location."""
    w = features.series()
    rows = filled(spark, sf_dir).join(shipped(spark, sf_dir).select("location", "date", "x"), ["location", "date"]).withColumn("l", F.lag("y").over(w)).where("l is not null")
    lines = {f: aggregates.fit_lm(rows, "y", f, "location").select("location", F.col("intercept").alias(f"a{f}"), F.col("slope").alias(f"b{f}")) for f in ("x", "l")}
    rows = rows.join(lines["x"], "location").join(lines["l"], "location")
    line = lambda c: (F.col("ax") + F.col("bx") * c["x"] + F.col("al") + F.col("bl") * c["l"]) / 2
    return _rounded(pooled.permutation_importance(rows, ["x", "l"], line).drop("rank"), 5)


# ---------------------------------------------------------------------------------------------- quantiles and weights at every date


@query(_with(
    "filled", "levels",
    moves="SELECT a.location, a.date, a.y - b.y AS diff FROM filled a JOIN filled b ON a.location = b.location AND a.date = b.date + 14",
    fences="SELECT p.location, p.date, any_value(p.y) AS point, quantile_cont(diff, 0.25) AS q1, quantile_cont(diff, 0.75) AS q3 FROM filled p LEFT JOIN moves m ON m.location = p.location AND m.date <= p.date GROUP BY 1, 2",
    inside=f"""SELECT f.location, f.date, quantile_cont(greatest(0, point + diff), {_QS}) AS qs FROM fences f JOIN moves m ON m.location = f.location AND m.date <= f.date
        WHERE diff BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) GROUP BY 1, 2""",
    final=f"SELECT f.location, f.date AS reference_date, CAST(2 AS INTEGER) AS h, k, {_r('coalesce(qs[k + 1], greatest(0, point + z * greatest(0.25 * abs(point), 5.0))) AS value', digits=5)} FROM fences f LEFT JOIN inside i ON i.location = f.location AND i.date = f.date, levels",
))
def difference_quantiles_expanding(spark, sf_dir):
    return _levels_out(quantiles.expanding_difference_quantiles(filled(spark, sf_dir), (2,)), 5)


_KNOWN = dict(_ROLL)
_KNOWN["means"] = " UNION ALL ".join(
    "SELECT h, reference_date, " + ", ".join(f"sum(s_{m}) OVER w / nullif(sum(n_{m}) OVER w, 0) AS {m}" for m in ("ar1", "persistence", "seasonal"))
    + f" FROM per WHERE h = {h} WINDOW w AS (PARTITION BY h ORDER BY reference_date ROWS BETWEEN {3 + h} PRECEDING AND {h} PRECEDING)" for h in (1, 2, 3, 4)
)


@query(_with("wis", **_KNOWN, final=f"SELECT h, reference_date, model, {_r('weight')} FROM weights"))
def rolling_weights_known(spark, sf_dir):
    """Weights from scores whose targets were known at each date; models by what the scores hold."""
    return _rounded(ensemble.rolling_weights(_stored_scores(spark, sf_dir)))


# ---------------------------------------------------------------------------------------------- scores of ranks, external columns

#: The coefficients of functions.numeric.inverse_normal, in its order (fixed values).
_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0)
_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0)


def _poly(x: str, terms) -> str:
    out = f"({terms[0]!r}::DOUBLE)"
    for t in terms[1:]:
        out = f"({out} * {x} + {t!r}::DOUBLE)"
    return out


@query(_with(
    "filled", ranked="SELECT *, (rank() OVER (PARTITION BY location ORDER BY y) + (count(*) OVER (PARTITION BY location, y) - 1) / 2.0 - 0.5)::DOUBLE / count(y) OVER (PARTITION BY location) AS p FROM filled",
    roots="SELECT *, sqrt(-2 * ln(CASE WHEN p < 0.5 THEN p ELSE 1 - p END)) AS t, (p - 0.5) * (p - 0.5) AS m FROM ranked",
    final=f"SELECT location, date, {_r(f'CASE WHEN p < 0.02425 THEN {_poly("t", _C)} / {_poly("t", _D)} WHEN p > 1 - 0.02425 THEN -{_poly("t", _C)} / {_poly("t", _D)} ELSE (p - 0.5) * {_poly("m", _A)} / {_poly("m", _B)} END AS z')} FROM roots",
))
def rank_normal_scores(spark, sf_dir):
    """Normal scores of the ranks of each series' values."""
    rows = rank_scores(filled(spark, sf_dir), "y").withColumn("z", inverse_normal(F.col("p")))
    return _rounded(rows.select("location", "date", "z"))


@query(_with(
    "filled", "shipped",
    joined="SELECT f.location, f.date, s.x, s.share FROM filled f LEFT JOIN shipped s ON s.location = f.location AND s.date = f.date",
    lagged="SELECT location, date, " + ", ".join(f"{f'lag({c}, {k}) OVER {_W}' if k else c} AS {c}_ext{k}" for c in ("x", "share") for k in (0, 2)) + " FROM joined",
    final="SELECT location, date, " + ", ".join(_r(f"coalesce(last_value({c} IGNORE NULLS) OVER w, 0) AS {c}") for c in ("x_ext0", "x_ext2", "share_ext0", "share_ext2")) + " FROM lagged WINDOW w AS (PARTITION BY location ORDER BY date ROWS UNBOUNDED PRECEDING)",
))
def external_columns(spark, sf_dir):
    """Two columns of another feed with lags 0 and 2, filled."""
    rows = filled(spark, sf_dir).join(shipped(spark, sf_dir), ["location", "date"], "left")
    made = features.build_features(rows, groups=(), external=("x", "share"), external_lags=(0, 2))
    return _rounded(made.select("location", "date", "x_ext0", "x_ext2", "share_ext0", "share_ext2"))


# ---------------------------------------------------------------------------------------------- autoregression on the log scale

_LOG_AR = {
    "logs": "SELECT location, date, ln(greatest(y, 0) + 1) AS y FROM filled",
    **_order_one("logs", 0),
}


@query(_with(
    "filled", **_LOG_AR,
    path="SELECT *, a + b * y AS f1, a + b * (a + b * y) AS f2 FROM order_0",
    ahead="SELECT location, date AS reference_date, 1 AS h, n, b, y, f1 AS f, s AS sigma FROM path UNION ALL SELECT location, date, 2, n, b, y, f2, s * sqrt(1 + b * b) FROM path",
    final=f"SELECT location, reference_date, CAST(h AS INTEGER) AS h, {_r('greatest(0, CASE WHEN n >= 11 AND b IS NOT NULL THEN exp(f) - 1 ELSE exp(y) - 1 END) AS point', 'CASE WHEN n >= 11 AND b IS NOT NULL THEN sigma * (1 + greatest(0, exp(f) - 1)) ELSE greatest(0.25 * abs(exp(y) - 1), 5.0) END AS sigma', digits=4)} FROM ahead",
))
def log_ar1(spark, sf_dir):
    """Order one on log(1 + y), with deviations carried back."""
    return _rounded(grid.forecast_grid(filled(spark, sf_dir), [{"p": 1, "log": True, "ridge": 0.0}], 2).drop("k"), 4)
