"""Queries on the driver's tables, each with DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions.calendar import last_saturday, mmwr_to_date
from tidewell.functions.numeric import LEVELS, count_of, inverse_normal, rate_of, z_values
from tidewell.operators import aggregates, backtest, ensemble, features, impute, joins, models, quantiles, scoring, select
from tidewell.plans import views
from tidewell.plans.views import completed, filled, population, shipped, weekly_panel
from tidewell.sources import tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

# ---------------------------------------------------------------------------------------------- SQL parts

_WEEK = "CAST({0} AS DATE) + CAST(6 - dayofweek(CAST({0} AS DATE)) AS INTEGER)"
CTE = {
    "panel": f"SELECT n_name AS location, {_WEEK.format('o_orderdate')} AS date, CAST(count(*) AS DOUBLE) AS y FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2",
    "completed": "SELECT g.location, g.date, p.y FROM (SELECT location, CAST(unnest(generate_series(lo, hi, INTERVAL 7 DAY)) AS DATE) AS date FROM (SELECT location, min(date) AS lo, max(date) AS hi FROM panel GROUP BY 1)) g LEFT JOIN panel p ON g.location = p.location AND g.date = p.date",
    "marks": "SELECT *, date - DATE '1970-01-01' AS x, last_value(y IGNORE NULLS) OVER b AS v1, last_value(CASE WHEN y IS NOT NULL THEN date - DATE '1970-01-01' END IGNORE NULLS) OVER b AS x1, first_value(y IGNORE NULLS) OVER a AS v2, first_value(CASE WHEN y IS NOT NULL THEN date - DATE '1970-01-01' END IGNORE NULLS) OVER a AS x2 FROM completed WINDOW b AS (PARTITION BY location ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), a AS (PARTITION BY location ORDER BY date ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)",
    "filled": "SELECT location, date, coalesce(y, v1 + (v2 - v1) * (x - x1) / (x2 - x1)) AS y FROM marks",
    "shipped": f"SELECT n_name AS location, {_WEEK.format('l_shipdate')} AS date, CAST(sum(l_quantity) AS DOUBLE) AS x, CAST(count(*) FILTER (WHERE l_returnflag = 'R') AS DOUBLE) / count(*) AS share FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2",
    "population": "SELECT n_name AS location, lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS location_code, count(*) AS population FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2",
    "levels": "SELECT * FROM (VALUES " + ", ".join(f"({k}, CAST({q!r} AS DOUBLE), CAST({z!r} AS DOUBLE))" for k, (q, z) in enumerate(zip(LEVELS, z_values(), strict=True))) + ") t(k, q, z)",
    "hs": "SELECT * FROM (VALUES (1), (2), (3), (4)) t(h)",
    "timed": "SELECT *, (date - min(date) OVER (PARTITION BY location)) / 7.0::DOUBLE AS t FROM filled",
    "spread": "SELECT location, date, y, count(y) OVER w AS n_seen, sqrt(greatest(var_pop(y) OVER w - coalesce(pow(covar_pop(t, y) OVER w, 2) / nullif(var_pop(t) OVER w, 0), 0), 0)) AS sd FROM timed WINDOW w AS (PARTITION BY location ORDER BY date ROWS UNBOUNDED PRECEDING)",
    "ar_sums": "SELECT *, count(xx) OVER w AS n, covar_pop(xx, yy) OVER w / nullif(var_pop(xx) OVER w, 0) AS b, avg(xx) OVER w AS mx, avg(yy) OVER w AS my FROM (SELECT *, CASE WHEN l IS NOT NULL AND y IS NOT NULL THEN l END AS xx, CASE WHEN l IS NOT NULL AND y IS NOT NULL THEN y END AS yy FROM (SELECT *, lag(y) OVER (PARTITION BY location ORDER BY date) AS l FROM filled)) WINDOW w AS (PARTITION BY location ORDER BY date ROWS UNBOUNDED PRECEDING)",
    "ar": "SELECT location, date AS reference_date, h, CASE WHEN n < 10 OR b IS NULL THEN y WHEN h = 1 THEN my - b * mx + b * y WHEN h = 2 THEN (my - b * mx) * (1 + b) + b * b * y WHEN h = 3 THEN (my - b * mx) * (1 + b + b * b) + b * b * b * y ELSE (my - b * mx) * (1 + b + b * b + b * b * b) + b * b * b * b * y END AS point FROM ar_sums, hs",
    "points": "SELECT 'persistence' AS model, location, date AS reference_date, h, y AS point FROM filled, hs UNION ALL SELECT 'ar1', location, reference_date, h, point FROM ar UNION ALL SELECT 'seasonal', f.location, f.date, h, p.y FROM filled f CROSS JOIN hs JOIN filled p ON p.location = f.location AND p.date = f.date + 7 * h - 364",
    "fc": "SELECT p.*, reference_date + 7 * h AS target_end_date, CASE WHEN n_seen >= 10 THEN sd ELSE greatest(0.25 * abs(point), 5.0) END AS sigma FROM points p JOIN spread s ON s.location = p.location AND s.date = p.reference_date",
    "scored": "SELECT fc.*, f.y AS obs FROM fc JOIN filled f ON f.location = fc.location AND f.date = fc.target_end_date",
    "ivals": "SELECT a.k, a.q, a.z AS zl, b.z AS zh, 1 - 2 * a.q AS alpha FROM levels a JOIN levels b ON b.k = 22 - a.k WHERE a.k < 11",
    "wis": "SELECT model, location, reference_date, h, target_end_date, any_value(point) AS point, any_value(obs) AS obs, 0.5 * abs(any_value(obs) - greatest(0, any_value(point))) + sum(alpha / 2 * (hi - lo + 2 / alpha * (greatest(0, lo - obs) + greatest(0, obs - hi)))) AS wis, avg(hi - lo) AS dispersion, avg(2 / alpha * greatest(0, lo - obs)) AS overprediction, avg(2 / alpha * greatest(0, obs - hi)) AS underprediction FROM (SELECT scored.*, alpha, greatest(0, point + zl * sigma) AS lo, greatest(0, point + zh * sigma) AS hi FROM scored, ivals) GROUP BY ALL HAVING TRUE",
}
CTE["wis"] = CTE["wis"].replace("GROUP BY ALL HAVING TRUE", "GROUP BY model, location, reference_date, h, target_end_date")
NEEDS = {
    "completed": ["panel"], "marks": ["completed"], "filled": ["marks"], "timed": ["filled"], "spread": ["timed"], "ar_sums": ["filled"], "ar": ["ar_sums", "hs"],
    "points": ["filled", "hs", "ar"], "fc": ["points", "spread"], "scored": ["fc", "filled"], "ivals": ["levels"], "wis": ["scored", "ivals"],
}


def _with(*names: str, final: str, **own: str) -> str:
    """WITH the named parts, all they need, and the given ones; then the final SELECT."""
    order: list[str] = []

    def add(n: str) -> None:
        for m in NEEDS.get(n, []):
            add(m)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    parts = [f"{n} AS ({CTE[n]})" for n in order] + [f"{n} AS ({s})" for n, s in own.items()]
    return "WITH " + ",\n".join(parts) + "\n" + final


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, without a negative zero, so that both engines show the same digits."""
    return df.select(*((F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def _r(*names: str, digits: int = 6) -> str:
    return ", ".join(f"round({n.split(' AS ')[0]}, {digits}) + 0.0 AS {n.split(' AS ')[-1]}" for n in names)


# ---------------------------------------------------------------------------------------------- calendar and imputation


@query(_with("panel", final="SELECT location, date, y FROM panel"))
def panel_weekly(spark, sf_dir):
    return weekly_panel(spark, sf_dir)


@query(_with("completed", final="SELECT location, date, y FROM completed"))
def complete_series(spark, sf_dir):
    return completed(spark, sf_dir)


@query(_with("panel", final="SELECT g.location, g.date, p.y FROM (SELECT location, CAST(unnest(generate_series(lo, hi, INTERVAL 7 DAY)) AS DATE) AS date FROM (SELECT DISTINCT location FROM panel) CROSS JOIN (SELECT min(date) AS lo, max(date) AS hi FROM panel)) g LEFT JOIN panel p ON g.location = p.location AND g.date = p.date"))
def complete_global(spark, sf_dir):
    return impute.complete_weekly(weekly_panel(spark, sf_dir), "global")


@query(_with("filled", final=f"SELECT location, date, {_r('y')} FROM filled"))
def interpolate_linear(spark, sf_dir):
    return _rounded(filled(spark, sf_dir))


_B = "(PARTITION BY location ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
_A = "(PARTITION BY location ORDER BY date ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)"


def _cubic(source: str, y: str) -> dict[str, str]:
    """Parts that fill the gaps of source.y by cubics: the last is `cubic`."""
    known = f"CASE WHEN {y} IS NOT NULL THEN date - DATE '1970-01-01' END"
    near = f"SELECT *, date - DATE '1970-01-01' AS x, last_value({y} IGNORE NULLS) OVER {_B} AS v1, last_value({known} IGNORE NULLS) OVER {_B} AS x1, first_value({y} IGNORE NULLS) OVER {_A} AS v2, first_value({known} IGNORE NULLS) OVER {_A} AS x2 FROM {source}"
    carried = ", ".join(f"{f}(CASE WHEN {y} IS NOT NULL THEN {a} END IGNORE NULLS) OVER {w} AS {b}" for f, w, a, b in (("last_value", _B, "v1", "v0"), ("last_value", _B, "x1", "x0"), ("first_value", _A, "v2", "v3"), ("first_value", _A, "x2", "x3")))
    terms = []
    for i in range(4):
        others = [j for j in range(4) if j != i]
        terms.append(f"v{i} * " + " * ".join(f"(x - x{j})" for j in others) + " / (" + " * ".join(f"(x{i} - x{j})::DOUBLE" for j in others) + ")")
    cubic = f"SELECT location, date, greatest(0, coalesce({y}, CASE WHEN x0 < x1 AND x3 > x2 THEN {' + '.join(terms)} ELSE v1 + (v2 - v1) * (x - x1) / (x2 - x1) END)) AS {y} FROM far"
    return {"near": near, "far": f"SELECT *, {carried} FROM near", "cubic": cubic}


@query(_with("completed", **_cubic("completed", "y"), final=f"SELECT location, date, {_r('y')} FROM cubic"))
def interpolate_cubic(spark, sf_dir):
    return _rounded(impute.interpolate(completed(spark, sf_dir), "cubic", 0.0))


_DAYS = "SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders"


@query(_with(days=_DAYS, parts="SELECT d, CAST(year(d) AS INTEGER) AS year, CAST(weekofyear(d) AS INTEGER) AS week, make_date(year(d), 1, 3) AS j FROM days", final="SELECT DISTINCT year, week, CAST(j + CAST(CASE dayofweek(j) WHEN 6 THEN 7 ELSE 6 - dayofweek(j) END AS INTEGER) + 7 * (week - 1) AS DATE) AS saturday, CAST(d - CAST((dayofweek(d) + 1) % 7 AS INTEGER) AS DATE) AS before FROM parts"))
def mmwr_dates(spark, sf_dir):
    d = F.col("o_orderdate").cast("date")
    rows = views.table(spark, sf_dir, "orders").select(F.year(d).alias("year"), F.weekofyear(d).alias("week"), last_saturday(d).alias("before"))
    return rows.distinct().withColumn("saturday", mmwr_to_date(F.col("year"), F.col("week")))


@query(_with("panel", final="SELECT CAST(gap AS INTEGER) AS gap, count(*) AS n FROM (SELECT date - lag(date) OVER (PARTITION BY location ORDER BY date) AS gap FROM panel) WHERE gap IS NOT NULL GROUP BY 1"))
def gap_report(spark, sf_dir):
    return features.gap_check(weekly_panel(spark, sf_dir))


@query(_with("completed", final="SELECT location, min(date) AS first_date, max(date) AS last_date, count(y) AS weeks FROM completed GROUP BY 1"))
def availability_report(spark, sf_dir):
    return aggregates.availability(completed(spark, sf_dir))


@query(_with("completed", final="SELECT location, date, last_value(y IGNORE NULLS) OVER (PARTITION BY location ORDER BY date ROWS UNBOUNDED PRECEDING) AS y FROM completed"))
def fill_down_series(spark, sf_dir):
    return impute.fill_down(completed(spark, sf_dir), ["y"])


_LM = _with("filled", "shipped", both="SELECT f.location, ln(y + 1) AS y, ln(x + 1) AS x FROM filled f JOIN shipped s ON f.location = s.location AND f.date = s.date", final=f"SELECT location, count(*) AS n, {_r('regr_intercept(y, x) AS intercept', 'regr_slope(y, x) AS slope', 'regr_r2(y, x) AS r2')}, {_r('regr_slope(y, x) / sqrt((regr_syy(y, x) - pow(regr_sxy(y, x), 2) / regr_sxx(y, x)) / (count(*) - 2) / regr_sxx(y, x)) AS t_value', digits=4)} FROM both GROUP BY 1").replace("both AS (", "pairs AS (").replace("FROM both", "FROM pairs")


@query(_LM)
def fit_lm_by_nation(spark, sf_dir):
    rows = filled(spark, sf_dir).join(shipped(spark, sf_dir), ["location", "date"]).select("location", F.ln(F.col("y") + 1).alias("y"), F.ln(F.col("x") + 1).alias("x"))
    return _rounded(aggregates.fit_lm(rows, "y", "x", "location")).withColumn("t_value", F.round("t_value", 4) + 0.0)


_PAIRS = "SELECT f.location, f.date, ln(y + 1) AS y, ln(x + 1) AS x FROM filled f JOIN shipped s ON f.location = s.location AND f.date = s.date"


@query(_with("filled", "shipped", pairs=_PAIRS, lm="SELECT regr_intercept(y, x) AS a, regr_slope(y, x) AS b FROM pairs", final="SELECT location, CAST(date + 728 AS DATE) AS date, greatest(0, round(exp(a + b * ln(x + 1)) - 1, 2)) + 0.0 AS pred FROM shipped, lm"))
def backfill(spark, sf_dir):
    rate = filled(spark, sf_dir).withColumn("y", F.ln(F.col("y") + 1))
    predictor = shipped(spark, sf_dir).select("location", "date", F.ln(F.col("x") + 1).alias("x"))
    return impute.backfill_history(rate, predictor)


_CUT = "1999-06-05"
_STITCH = {
    "pairs": _PAIRS,
    "lm": "SELECT regr_intercept(y, x) AS a, regr_slope(y, x) AS b FROM pairs",
    "pred": "SELECT location, CAST(date + 728 AS DATE) AS date, greatest(0, round(exp(a + b * ln(x + 1)) - 1, 2)) AS pred FROM shipped, lm",
    "rates": "SELECT coalesce(p.location, t.location) AS location, coalesce(p.date, t.date) AS date, pred, y AS obs FROM pred p FULL JOIN panel t ON p.location = t.location AND p.date = t.date",
    "early": f"SELECT r.location, r.date, round_even(coalesce(pred, obs) * (population * 1000) / 100000.0, 0) * coalesce(share, 1.0) AS total FROM rates r LEFT JOIN shipped s ON s.location = r.location AND s.date = r.date JOIN population q ON q.location = r.location WHERE r.date < DATE '{_CUT}'",
    "feeds": f"SELECT * FROM early UNION ALL SELECT location, date, y FROM panel WHERE date >= DATE '{_CUT}'",
    "weeks": "SELECT g.location, g.date, f.total FROM (SELECT location, CAST(unnest(generate_series(lo, hi, INTERVAL 7 DAY)) AS DATE) AS date FROM (SELECT location, min(date) AS lo, max(date) AS hi FROM feeds GROUP BY 1)) g LEFT JOIN feeds f ON g.location = f.location AND g.date = f.date",
    **_cubic("weeks", "total"),
}


@query(_with("filled", "shipped", "population", **_STITCH, final=f"SELECT location, date, {_r('total', digits=4)} FROM cubic"))
def stitch_panel(spark, sf_dir):
    panel = tables.stored(weekly_panel(spark, sf_dir), "weekly")
    rate = impute.interpolate(impute.complete_weekly(panel)).withColumn("y", F.ln(F.col("y") + 1))
    feed = tables.stored(shipped(spark, sf_dir), "shipped")
    modelled = impute.backfill_history(rate, feed.select("location", "date", F.ln(F.col("x") + 1).alias("x")))
    truth = panel.withColumnRenamed("y", "obs")
    people = population(spark, sf_dir).select("location", (F.col("population") * 1000).alias("population"))
    return _rounded(impute.stitch(modelled, truth, feed.select("location", "date", "share"), people, panel.withColumnRenamed("y", "total"), _CUT), 4)


# ---------------------------------------------------------------------------------------------- features

_W = "(PARTITION BY location ORDER BY date)"
_LAGS = (*range(1, 13), 52)


@query(_with("filled", final="SELECT location, date, " + ", ".join(_r(f"lag(y, {k}) OVER {_W} AS y_lag{k}") for k in _LAGS) + " FROM filled"))
def lag_ladder(spark, sf_dir):
    return _rounded(features.lag_features(filled(spark, sf_dir)).drop("y"))


@query(_with("filled", final="SELECT location, date, " + ", ".join(_r(f"{f}(y) OVER (PARTITION BY location ORDER BY date ROWS {k - 1} PRECEDING) AS y_{n}{k}") for k in (2, 4, 8, 12) for n, f in (("mean", "avg"), ("min", "min"), ("max", "max"), ("std", "stddev_samp"))) + " FROM filled"))
def rolling_stats(spark, sf_dir):
    return _rounded(features.rolling_features(filled(spark, sf_dir)).drop("y"))


@query(_with(
    "filled", numbered=f"SELECT *, row_number() OVER {_W} AS i FROM filled",
    final="SELECT a.location, a.date, " + ", ".join(_r(f"sum(pow({1 - a}, a.i - b.i) * b.y) / sum(pow({1 - a}, a.i - b.i)) AS y_ewm{round(a * 100)}") for a in (0.1, 0.3, 0.5)) + " FROM numbered a JOIN numbered b ON a.location = b.location AND b.i <= a.i GROUP BY 1, 2",
))
def ewm(spark, sf_dir):
    return _rounded(features.ewm_features(filled(spark, sf_dir)).drop("y"))


@query(_with("filled", final="SELECT location, date, " + ", ".join(
    [_r(f"y - lag(y, {k}) OVER {_W} AS y_diff{k}") for k in (1, 2, 4, 8, 52)]
    + [_r(f"y / nullif(lag(y, {k}) OVER {_W}, 0) - 1 AS y_pct{k}") for k in (1, 2, 4, 8, 52)]
    + [_r(f"y / (lag(y, {k}) OVER {_W} + 1e-8) - 1 AS y_mom{k}") for k in (4, 8, 12)]
) + " FROM filled"))
def diff_pct_momentum(spark, sf_dir):
    rows = filled(spark, sf_dir)
    return _rounded(rows.withColumns(features.change_columns()).drop("y"))


@query(_with("filled", final=f"SELECT location, date, {_r('avg(y) OVER w AS y_cummean')}, {_r('coalesce((y - avg(y) OVER w) / nullif(stddev_pop(y) OVER w, 0), 0) AS y_z')} FROM filled WINDOW w AS (PARTITION BY location ORDER BY date ROWS UNBOUNDED PRECEDING)"))
def expanding_mean(spark, sf_dir):
    return _rounded(aggregates.standardise(features.expanding_mean(filled(spark, sf_dir)), ["y"]).drop("y"))


@query(_with(
    "filled", numbered=f"SELECT *, row_number() OVER {_W} AS i FROM filled",
    s8="SELECT a.location, a.date, median((c.y - b.y) / (c.i - b.i)) AS m FROM numbered a JOIN numbered b ON a.location = b.location AND b.i BETWEEN a.i - 7 AND a.i JOIN numbered c ON a.location = c.location AND c.i > b.i AND c.i <= a.i WHERE a.i > 8 GROUP BY 1, 2",
    s12="SELECT a.location, a.date, median((c.y - b.y) / (c.i - b.i)) AS m FROM numbered a JOIN numbered b ON a.location = b.location AND b.i BETWEEN a.i - 11 AND a.i JOIN numbered c ON a.location = c.location AND c.i > b.i AND c.i <= a.i WHERE a.i > 12 GROUP BY 1, 2",
    final=f"SELECT n.location, n.date, {_r('s8.m AS y_slope8', 's12.m AS y_slope12')} FROM numbered n LEFT JOIN s8 ON n.location = s8.location AND n.date = s8.date LEFT JOIN s12 ON n.location = s12.location AND n.date = s12.date",
))
def theil_sen(spark, sf_dir):
    return _rounded(features.theil_sen(filled(spark, sf_dir)).drop("y"))


_PHASE = "{1}(2.0 * pi() * dayofyear(date) / 365.25 * {0})"


@query(_with("panel", final="SELECT date, " + ", ".join(_r(f"{_PHASE.format(t, w)} AS {n}_{w}") for n, t in (("year", 1), ("quarter", 4), ("month", 12)) for w in ("sin", "cos")) + ", CAST(month(date) >= 10 OR month(date) <= 3 AS INTEGER) AS in_season, CAST(month(date) IN (12, 1, 2) AS INTEGER) AS in_peak, CAST(least(weekofyear(date), 52) AS INTEGER) AS week_num FROM (SELECT DISTINCT date FROM panel)"))
def seasonal(spark, sf_dir):
    return _rounded(features.seasonal_features(weekly_panel(spark, sf_dir).select("date").distinct()))


@query(_with("filled", lagged="SELECT location, date, lag(y, 4) OVER (PARTITION BY location ORDER BY date) AS a, y / nullif(lag(y) OVER (PARTITION BY location ORDER BY date), 0) - 1 AS b FROM filled", final=f"SELECT location, date, {_r('coalesce(last_value(a IGNORE NULLS) OVER w, 0) AS y_lag4', 'coalesce(last_value(b IGNORE NULLS) OVER w, 0) AS y_pct1')} FROM lagged WINDOW w AS (PARTITION BY location ORDER BY date ROWS UNBOUNDED PRECEDING)"))
def fill_features(spark, sf_dir):
    rows = features.pct_change_features(features.lag_features(filled(spark, sf_dir), (4,)), (1,)).drop("y")
    return _rounded(features.fill_features(rows, ["y_lag4", "y_pct1"]))


@query(_with("spread", final=f"SELECT location, date, n_seen, {_r('sd AS detrended_std')} FROM spread"))
def detrended_std(spark, sf_dir):
    return _rounded(features.detrended_std(filled(spark, sf_dir)).drop("y"))


@query(_with("filled", "hs", final=f"SELECT a.location, a.date, {_r('a.y AS y')}, h, b.date AS label_date, {_r('b.y AS label')} FROM filled a CROSS JOIN hs JOIN filled b ON b.location = a.location AND b.date = a.date + 7 * h"))
def label_at_horizon(spark, sf_dir):
    return _rounded(joins.label_at_horizon(filled(spark, sf_dir)))


@query()
def build_features(spark, sf_dir):
    rows = filled(spark, sf_dir).join(shipped(spark, sf_dir).drop("share"), ["location", "date"], "left")
    return features.build_features(rows, ["x"])


@query(_with("filled", ranked="SELECT *, (rank() OVER (PARTITION BY location ORDER BY y) + (count(*) OVER (PARTITION BY location, y) - 1) / 2.0 - 0.5) / count(y) OVER (PARTITION BY location) AS p FROM filled", final=f"SELECT location, date, {_r('p')} FROM ranked"))
def rank_normal(spark, sf_dir):
    rows = views.rank_scores(filled(spark, sf_dir), "y").withColumn("z", inverse_normal(F.col("p")))
    return _rounded(rows.where(F.col("z").isNotNull()).select("location", "date", "p"))


_COV = "SELECT a.location AS target, b.location AS covariate, b.y AS x, a.y AS y FROM filled a JOIN filled b ON a.date = b.date AND a.location <> b.location"


@query(_with("filled", pairs=_COV, scored="SELECT target, covariate, round(abs(covar_pop(x, y) / nullif(stddev_pop(x) * stddev_pop(y), 0)), 9) AS score FROM pairs GROUP BY 1, 2", final="SELECT target, covariate, round(score, 6) + 0.0 AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY score DESC NULLS LAST, covariate) AS rank FROM scored) WHERE rank <= 3"))
def covariate_rank_corr(spark, sf_dir):
    return _rounded(aggregates.rank_covariates(joins.covariate_join(filled(spark, sf_dir)), "corr", 3))


_MI = dict(
    pairs=_COV,
    ends="SELECT *, min(x) OVER w AS x0, max(x) OVER w AS x1, min(y) OVER w AS y0, max(y) OVER w AS y1, count(*) OVER w AS n FROM pairs WINDOW w AS (PARTITION BY target, covariate)",
    cells="SELECT target, covariate, n, least(coalesce(floor((x - x0) / nullif(x1 - x0, 0) * 8), 0), 7) AS bx, least(coalesce(floor((y - y0) / nullif(y1 - y0, 0) * 8), 0), 7) AS bn, count(*) AS nxy FROM ends GROUP BY 1, 2, 3, 4, 5",
    sides="SELECT *, sum(nxy) OVER (PARTITION BY target, covariate, bx) AS nx, sum(nxy) OVER (PARTITION BY target, covariate, bn) AS ny FROM cells",
    scored="SELECT target, covariate, round(sum(nxy / n::DOUBLE * ln(nxy::DOUBLE * n / (nx * ny))), 9) AS score FROM sides GROUP BY 1, 2",
)


@query(_with("filled", **_MI, final="SELECT target, covariate, round(score, 6) + 0.0 AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY score DESC NULLS LAST, covariate) AS rank FROM scored) WHERE rank <= 3"))
def covariate_rank_mi(spark, sf_dir):
    return _rounded(aggregates.rank_covariates(joins.covariate_join(filled(spark, sf_dir)), "mi", 3))


# ---------------------------------------------------------------------------------------------- selection, labels, joins


@query("SELECT n_name AS location, CASE n_name WHEN 'NATION_3' THEN 'north' WHEN 'NATION_7' THEN 'south' ELSE n_name END AS label, CASE WHEN n_nationkey < 20 THEN lpad(CAST(n_nationkey AS VARCHAR), 2, '0') ELSE n_name END AS location_code FROM nation WHERE n_name NOT IN ('NATION_5', 'NATION_6')")
def map_labels(spark, sf_dir):
    nations = views.table(spark, sf_dir, "nation")
    dim = nations.where("n_nationkey < 20").select(F.col("n_name").alias("location_name"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0").alias("location_code"))
    rows = select.exclude_locations(nations.select(F.col("n_name").alias("location")), ["NATION_5", "NATION_6"])
    rows = select.map_code(rows, dim)
    return select.normalise_label(rows.withColumn("label", F.col("location")), "label", {"NATION_3": "north", "NATION_7": "south"})


@query(_with("panel", full_="SELECT date FROM panel GROUP BY date HAVING count(DISTINCT location) = (SELECT count(DISTINCT location) FROM panel)", final="SELECT location, date, y FROM panel WHERE date IN (SELECT date FROM full_)"))
def complete_case_dates(spark, sf_dir):
    return select.complete_case_dates(weekly_panel(spark, sf_dir))


@query(_with("panel", final="SELECT location, date, y, CAST(CASE WHEN row_number() OVER (PARTITION BY location ORDER BY date) <= count(*) OVER (PARTITION BY location) // 2 THEN 1 ELSE 2 END AS INTEGER) AS half, CASE WHEN date <= DATE '1998-01-03' THEN 'train' ELSE 'test' END AS split FROM panel QUALIFY count(*) OVER (PARTITION BY location) >= 50"))
def split_rows(spark, sf_dir):
    return select.split_at(select.split_half(select.min_history(weekly_panel(spark, sf_dir), 50)), "1998-01-03")


@query(_with("panel", numbered="SELECT *, row_number() OVER (PARTITION BY location ORDER BY date) - 1 AS i, count(*) OVER (PARTITION BY location) AS n FROM panel", final="SELECT location, date, y FROM numbered WHERE n <= 30 OR i IN (SELECT unnest([CAST(floor(j * (n - 1) / 29.0::DOUBLE) AS BIGINT) for j in range(30)]))".replace("i IN (SELECT unnest([CAST(floor(j * (n - 1) / 29.0::DOUBLE) AS BIGINT) for j in range(30)]))", "list_contains([CAST(floor(j * (n - 1) / 29.0::DOUBLE) AS BIGINT) for j in range(30)], i)")))
def even_subsample(spark, sf_dir):
    return select.even_subsample(weekly_panel(spark, sf_dir), 30)


@query(_with("panel", anchors="SELECT DISTINCT location, make_date(year(date), 7, 1) AS anchor FROM panel", final="SELECT a.location, a.anchor, max(p.date) AS date, arg_max(p.y, p.date) AS y FROM anchors a JOIN panel p ON p.location = a.location AND p.date <= a.anchor GROUP BY 1, 2"))
def row_as_of(spark, sf_dir):
    panel = weekly_panel(spark, sf_dir)
    days = panel.select("location", F.make_date(F.year("date"), F.lit(7), F.lit(1)).alias("anchor")).distinct()
    return joins.row_as_of(panel, days).select("location", "anchor", "row.date", "row.y")


@query(_with("panel", "shipped", "population", final=f"SELECT location, date, y, {_r('x')}, {_r('share')}, population, location_code, {_r('y * 100000.0 / population AS rate')}, {_r('round_even(y * 100000.0 / population * population / 100000.0, 0) AS back')} FROM (SELECT coalesce(p.location, s.location) AS location, coalesce(p.date, s.date) AS date, y, x, coalesce(share, 1.0) AS share FROM panel p FULL JOIN shipped s ON p.location = s.location AND p.date = s.date) JOIN population USING (location)"))
def merge_feeds(spark, sf_dir):
    both = joins.full_merge(weekly_panel(spark, sf_dir), shipped(spark, sf_dir), ["location", "date"]).withColumn("share", F.coalesce("share", F.lit(1.0)))
    rows = joins.attach_population(both, population(spark, sf_dir)).withColumn("rate", rate_of(F.col("y"), F.col("population")))
    return _rounded(rows.withColumn("back", count_of(F.col("rate"), F.col("population"))))


@query(_with("panel", pivoted="PIVOT (SELECT date, location, y FROM panel WHERE location IN ('NATION_1', 'NATION_2', 'NATION_0')) ON location IN ('NATION_0', 'NATION_1', 'NATION_2') USING avg(y) GROUP BY date", final="SELECT date, 'NATION_0' AS location, NATION_0 AS y FROM pivoted UNION ALL SELECT date, 'NATION_1', NATION_1 FROM pivoted UNION ALL SELECT date, 'NATION_2', NATION_2 FROM pivoted").replace("pivoted AS (PIVOT (SELECT date, location, y FROM panel WHERE location IN ('NATION_1', 'NATION_2', 'NATION_0')) ON location IN ('NATION_0', 'NATION_1', 'NATION_2') USING avg(y) GROUP BY date)", "pivoted AS (SELECT date, avg(y) FILTER (WHERE location = 'NATION_0') AS NATION_0, avg(y) FILTER (WHERE location = 'NATION_1') AS NATION_1, avg(y) FILTER (WHERE location = 'NATION_2') AS NATION_2 FROM panel GROUP BY date)"))
def pivot_unpivot(spark, sf_dir):
    return aggregates.unpivot_locations(aggregates.pivot_locations(weekly_panel(spark, sf_dir), ["NATION_0", "NATION_1", "NATION_2"]))


@query(_with("panel", final="SELECT d.date, n_name AS location, avg(y) AS y FROM (SELECT DISTINCT date FROM panel) d CROSS JOIN nation LEFT JOIN panel p ON p.date = d.date AND p.location = n_name GROUP BY 1, 2"))
def pivot_unpivot_all(spark, sf_dir):
    """Every location: the nations bound them."""
    locations = sorted(r.n_name for r in views.table(spark, sf_dir, "nation").select("n_name").distinct().collect())
    return aggregates.unpivot_locations(aggregates.pivot_locations(weekly_panel(spark, sf_dir), locations))


@query(_with("panel", final="SELECT max(date) AS last_date, CAST(max(date) - 56 AS DATE) AS cutoff FROM panel"))
def snapshot_bounds(spark, sf_dir):
    return tables.snapshot_bounds(weekly_panel(spark, sf_dir))


# ---------------------------------------------------------------------------------------------- forecasts and quantiles


@query(_with("filled", "hs", final=f"SELECT location, date AS reference_date, h, {_r('y AS point')} FROM filled, hs"))
def persistence(spark, sf_dir):
    return _rounded(models.forecast_persistence(filled(spark, sf_dir)))


@query(_with("ar", final=f"SELECT location, reference_date, h, {_r('point', digits=5)} FROM ar"))
def ar1_expanding(spark, sf_dir):
    return _rounded(models.forecast_ar1(filled(spark, sf_dir)), 5)


@query()
def ar_p(spark, sf_dir):
    return models.forecast_ar(filled(spark, sf_dir), 3, log=True)


@query()
def order_choice(spark, sf_dir):
    return models.select_order(_panel(spark, sf_dir))


@query()
def tuned(spark, sf_dir):
    return models.tune(_panel(spark, sf_dir), [{"p": 1}, {"p": 2}, {"p": 4, "ridge": 1e-2}], "1999-06-05")


@query()
def linear(spark, sf_dir):
    rows = features.lag_features(filled(spark, sf_dir), (1, 2, 52)).withColumns(features.rolling_columns(windows=(4,)))
    return models.forecast_linear(rows, ["y", "y_lag1", "y_lag2", "y_mean4"])


@query()
def two_stage(spark, sf_dir):
    rows = features.build_features(_panel(spark, sf_dir), groups=("rolling", "season"))
    return models.forecast_two_stage(rows, features.feature_names(rows) + ["y"], "1999-06-05")


def _levels_out(df: DataFrame, digits: int = 6) -> DataFrame:
    """A row for each level, k from 0."""
    return _rounded(df.select("location", "reference_date", "h", F.posexplode("quantiles").alias("k", "value")), digits)


@query(_with("spread", "hs", "levels", final=f"SELECT location, date AS reference_date, h, k, {_r('greatest(0, y + z * CASE WHEN n_seen >= 10 THEN sd ELSE greatest(0.25 * abs(y), 5.0) END) AS value')} FROM spread, hs, levels"))
def baseline_quantiles(spark, sf_dir):
    return _levels_out(quantiles.baseline_quantiles(filled(spark, sf_dir)))


_QS = "[" + ", ".join(repr(q) for q in LEVELS) + "]"
_ZS = "[" + ", ".join(f"{z!r}::DOUBLE" for z in z_values()) + "]"
_ERR = {
    "err": "SELECT a.location, a.reference_date, a.h, a.point, CAST(a.reference_date + 7 * a.h AS DATE) AS target_date, f.y - a.point AS error, f.y AS obs FROM ar a JOIN filled f ON f.location = a.location AND f.date = a.reference_date + 7 * a.h",
}


@query(_with(
    "ar", "filled", **_ERR,
    known=f"SELECT location, h, target_date, quantile_cont(error, {_QS}) OVER w AS qs, count(error) OVER w AS n FROM err WINDOW w AS (PARTITION BY location, h ORDER BY target_date ROWS UNBOUNDED PRECEDING)",
    each=f"SELECT a.location, a.reference_date, a.h, point, n, unnest(qs) AS qv, unnest({_ZS}) AS z, CAST(unnest(range(23)) AS INTEGER) AS k FROM ar a LEFT JOIN known n ON n.location = a.location AND n.h = a.h AND n.target_date = a.reference_date",
    final=f"SELECT location, reference_date, h, k, {_r('greatest(0, CASE WHEN n >= 10 THEN point + qv ELSE point + z * greatest(0.25 * abs(point), 5.0) END) AS value', digits=5)} FROM each",
))
def error_quantiles(spark, sf_dir):
    panel = _panel(spark, sf_dir)
    fc = models.forecast_ar1(panel)
    return _levels_out(quantiles.error_quantiles(fc, quantiles.validation_errors(fc, panel)), 5)


@query(_with(
    "filled", "levels",
    last="SELECT location, max(date) AS reference_date, arg_max(y, date) AS point FROM filled GROUP BY 1",
    d="SELECT a.location, a.y - b.y AS diff FROM filled a JOIN filled b ON a.location = b.location AND a.date = b.date + 14",
    fence="SELECT location, quantile_cont(diff, 0.25) AS q1, quantile_cont(diff, 0.75) AS q3 FROM d GROUP BY 1",
    moved=f"SELECT d.location, quantile_cont(greatest(0, point + diff), {_QS}) AS qs FROM d JOIN fence USING (location) JOIN last USING (location) WHERE diff BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) GROUP BY 1",
    final=f"SELECT location, reference_date, CAST(2 AS INTEGER) AS h, k, {_r('coalesce(qs[k + 1], greatest(0, point + z * greatest(0.25 * abs(point), 5.0))) AS value')} FROM last LEFT JOIN moved USING (location), levels",
))
def difference_quantiles(spark, sf_dir):
    return _levels_out(quantiles.difference_quantiles(filled(spark, sf_dir), 2))


@query(_with(
    "ar", "filled", "levels", **_ERR,
    res="SELECT *, ln(greatest(obs, 0) + 1) - ln(greatest(point, 0) + 1) AS residual FROM err WHERE reference_date < DATE '1999-06-05'",
    own=f"SELECT location, h, quantile_cont(residual, {_QS}) AS qs FROM res GROUP BY 1, 2 HAVING count(*) >= 10",
    final=f"SELECT a.location, a.reference_date, a.h, k, {_r('greatest(0, exp(ln(greatest(point, 0) + 1) + qs[k + 1]) - 1) AS value', digits=5)} FROM ar a JOIN own o ON o.location = a.location AND o.h = a.h, levels WHERE a.reference_date >= DATE '1999-06-05'",
))
def residual_quantiles(spark, sf_dir):
    panel = _panel(spark, sf_dir)
    fc = models.forecast_ar1(panel)
    early, late = fc.where("reference_date < '1999-06-05'"), fc.where("reference_date >= '1999-06-05'")
    resid = quantiles.scaled_residuals(quantiles.validation_errors(early, panel))
    enough = resid.groupBy("location", "h").count().where("count >= 10")
    late = late.join(enough, ["location", "h"], "left_semi")
    return _levels_out(quantiles.residual_quantiles(late, resid), 5)


@query(_with("ar", "filled", **_ERR, final=f"SELECT location, h, {_r('avg(error) AS mean', 'stddev_pop(error) AS std', digits=5)}, count(error) AS n, {_r('CASE WHEN count(*) >= 5 THEN quantile_cont(error, 0.5) ELSE 0 END AS bias', 'avg(abs(error)) AS mae', digits=5)} FROM err GROUP BY 1, 2"))
def error_statistics(spark, sf_dir):
    panel = _panel(spark, sf_dir)
    errors = quantiles.validation_errors(models.forecast_ar1(panel), panel)
    out = aggregates.error_statistics(errors).join(aggregates.median_bias(errors), ["location", "h"]).join(scoring.mae(errors, ["location", "h"]), ["location", "h"])
    return _rounded(out, 5)


_BLEND = {
    "rows_": "SELECT e.location, e.h, e.point, e.obs, f.y AS last FROM err e JOIN filled f ON f.location = e.location AND f.date = e.reference_date",
    "bias": "SELECT location, h, count(*) AS n, CASE WHEN count(*) >= 5 THEN quantile_cont(obs - point, 0.5) ELSE 0.0 END AS bias FROM rows_ GROUP BY 1, 2",
    "alphas": "SELECT range / 20.0::DOUBLE AS alpha FROM range(21)",
    "maes": "SELECT location, h, alpha, round(avg(abs(alpha * (point + bias) + (1 - alpha) * last - obs)), 7) AS mae FROM rows_ JOIN bias USING (location, h), alphas GROUP BY 1, 2, 3",
    "best": "SELECT location, h, alpha FROM maes QUALIFY row_number() OVER (PARTITION BY location, h ORDER BY mae, alpha) = 1",
}


@query(_with("ar", "filled", **_ERR, **_BLEND, final=f"SELECT location, h, n, {_r('bias')}, {_r('CASE WHEN n >= 20 THEN alpha ELSE 1.0 END AS alpha')} FROM bias JOIN best USING (location, h)"))
def bias_blend(spark, sf_dir):
    panel = _panel(spark, sf_dir)
    errors = quantiles.validation_errors(models.forecast_ar1(panel), panel)
    rows = errors.join(panel.select("location", F.col("date").alias("anchor"), F.col("y").alias("last")), ["location", "anchor"])
    return _rounded(models.calibrate_bias_blend(rows))


@query(_with("fc", "levels", final=f"SELECT reference_date, CAST(h - 1 AS INTEGER) AS horizon, 'wk inc' AS target, CAST(target_end_date AS DATE) AS target_end_date, location, 'quantile' AS output_type, q AS output_type_id, {_r('greatest(0, point + z * sigma) AS value', digits=5)} FROM fc, levels WHERE model = 'ar1'"))
def forecast_table(spark, sf_dir):
    return _rounded(select.format_forecast(views.forecasts(_panel(spark, sf_dir)).where("model = 'ar1'")), 5)


# ---------------------------------------------------------------------------------------------- scores and ensembles


def _panel(spark, sf_dir) -> DataFrame:
    """The filled panel, stored: for queries that use it several times."""
    return tables.stored(filled(spark, sf_dir), "panel")


def _scores(spark, sf_dir, variant="weighted_sum", with_components=False) -> DataFrame:
    """Scored forecasts of three models."""
    panel = _panel(spark, sf_dir)
    return scoring.wis(views.forecasts(panel), panel, variant, with_components)


def _stored_scores(spark, sf_dir) -> DataFrame:
    """The same without quantiles, stored: for queries that use them several times."""
    return tables.stored(_scores(spark, sf_dir).drop("quantiles"), "scores")


_KEYS = ("model", "location", "reference_date", "h")


@query(_with("wis", final=f"SELECT model, location, reference_date, h, {_r('wis', 'dispersion', 'overprediction', 'underprediction', digits=5)} FROM wis"))
def wis_weighted_sum(spark, sf_dir):
    return _rounded(_scores(spark, sf_dir, with_components=True).select(*_KEYS, "wis", "dispersion", "overprediction", "underprediction"), 5)


_TIMES = "CASE WHEN a.k IN (0, 1, 2, 3, 4, 5, 7, 10) THEN 2 ELSE 1 END"


@query(_with(
    "scored", "levels", iv=f"SELECT a.k, a.q, a.z AS zl, b.z AS zh, {_TIMES} AS times FROM levels a JOIN levels b ON b.k = 22 - a.k WHERE a.k <= 11",
    lg="SELECT model, location, reference_date, h, q, times, ln(greatest(0, point + zl * sigma) + 1) AS lo, ln(greatest(0, point + zh * sigma) + 1) AS hi, ln(obs + 1) AS o FROM scored, iv",
    final=f"SELECT model, location, reference_date, h, {_r('sum(times * (hi - lo + 2 / q * (greatest(0, lo - o) + greatest(0, o - hi)))) / 20 AS wis')} FROM lg GROUP BY 1, 2, 3, 4",
))
def wis_log_mean(spark, sf_dir):
    return _rounded(_scores(spark, sf_dir, "log_mean").select(*_KEYS, "wis"))


@query(_with("scored", "ivals", final=f"SELECT model, location, reference_date, h, {_r('(0.5 * abs(any_value(obs) - greatest(0, any_value(point))) + sum(q * (hi - lo + (greatest(0, lo - obs) + greatest(0, obs - hi)) / q))) / 11.5 AS wis', digits=5)} FROM (SELECT scored.*, q, greatest(0, point + zl * sigma) AS lo, greatest(0, point + zh * sigma) AS hi FROM scored, ivals) GROUP BY 1, 2, 3, 4"))
def wis_standard(spark, sf_dir):
    return _rounded(_scores(spark, sf_dir, "standard").select(*_KEYS, "wis"), 5)


_GEO = "exp(avg(CASE WHEN round(wis, 6) > 0 THEN ln(round(wis, 6)) END))"  # rounded: a score of 0 is 0 in both engines


@query(_with("wis", geo=f"SELECT h, model, {_GEO} AS g, avg(wis) AS m FROM wis GROUP BY 1, 2", final=f"SELECT a.h, a.model, {_r('a.g AS geo_wis', 'b.g AS base_wis', 'a.g / b.g AS relative_wis', 'a.m AS mean_wis', digits=5)} FROM geo a JOIN geo b ON a.h = b.h AND b.model = 'persistence'"))
def relative_wis(spark, sf_dir):
    scores = _stored_scores(spark, sf_dir).withColumn("wis", F.round("wis", 6))
    return _rounded(scoring.relative_wis(scores, "persistence").join(scoring.mean_wis(scores, ["h", "model"]), ["h", "model"]), 5)


@query(_with("wis", final=f"SELECT h, model, {_r('avg(abs(obs - greatest(0, point))) / (avg(obs) + 1) + 0.5 * avg(wis) / (avg(obs) + 1) AS loss', 'avg(abs(obs - point)) AS mae', 'avg(abs((obs - point) / (obs + 1e-8))) * 100 AS mape', digits=5)} FROM wis GROUP BY 1, 2"))
def error_metrics(spark, sf_dir):
    scores, by = _scores(spark, sf_dir), ["h", "model"]
    return _rounded(scoring.combined_loss(scores, by, 1.0, 0.5).join(scoring.mae(scores, by), by).join(scoring.mape(scores, by), by), 5)


_ASOF = "1999-06-05"


@query(_with(
    "wis", known=f"SELECT * FROM wis WHERE target_end_date <= DATE '{_ASOF}'",
    refs=f"SELECT DISTINCT reference_date FROM known WHERE reference_date < DATE '{_ASOF}' ORDER BY 1 DESC LIMIT 4",
    s="SELECT h, model, avg(wis) AS score FROM known WHERE reference_date IN (SELECT reference_date FROM refs) GROUP BY 1, 2",
    m="SELECT DISTINCT h, model FROM wis",
    final=f"SELECT m.h, m.model, {_r('coalesce(coalesce(1 / s.score, 0) / nullif(sum(1 / s.score) OVER (PARTITION BY m.h), 0), 1.0 / count(*) OVER (PARTITION BY m.h)) AS weight')} FROM m LEFT JOIN s ON m.h = s.h AND m.model = s.model",
))
def ensemble_weights(spark, sf_dir):
    scores = _stored_scores(spark, sf_dir)
    return _rounded(ensemble.ensemble_weights(scores, scores.select("h", "model").distinct(), _ASOF))


_ROLL = {
    "per": "SELECT h, reference_date, " + ", ".join(f"sum(wis) FILTER (WHERE model = '{m}') AS s_{m}, count(wis) FILTER (WHERE model = '{m}') AS n_{m}" for m in ("ar1", "persistence", "seasonal")) + " FROM wis GROUP BY 1, 2",
    "means": "SELECT h, reference_date, " + ", ".join(f"sum(s_{m}) OVER w / nullif(sum(n_{m}) OVER w, 0) AS {m}" for m in ("ar1", "persistence", "seasonal")) + " FROM per WINDOW w AS (PARTITION BY h ORDER BY reference_date ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING)",
    "tot": "SELECT *, 1 / ar1 + 1 / persistence + 1 / seasonal AS t FROM means",
    "weights": " UNION ALL ".join(f"SELECT h, reference_date, '{m}' AS model, coalesce(1 / {m} / t, 1.0 / 3) AS weight FROM tot" for m in ("ar1", "persistence", "seasonal")),
}


@query(_with("wis", **_ROLL, final=f"SELECT h, reference_date, model, {_r('weight')} FROM weights"))
def rolling_weights(spark, sf_dir):
    return _rounded(ensemble.rolling_weights(_stored_scores(spark, sf_dir), 4, False, models=("ar1", "persistence", "seasonal")))


def _long(fc: DataFrame) -> DataFrame:
    rows = fc.select("model", "h", "reference_date", "target_end_date", "location", F.posexplode("quantiles").alias("k", "value"))
    return rows.withColumns({"target": F.lit("wk inc"), "output_type": F.lit("quantile"), "output_type_id": F.get(F.array(*map(F.lit, LEVELS)), F.col("k"))}).drop("k")


@query(_with(
    "wis", "fc", "levels", **_ROLL,
    lg="SELECT fc.h, fc.reference_date, target_end_date, location, q, greatest(0, point + z * sigma) AS value, weight FROM fc LEFT JOIN weights w ON w.h = fc.h AND w.reference_date = fc.reference_date AND w.model = fc.model, levels",
    final=f"SELECT h, reference_date, CAST(target_end_date AS DATE) AS target_end_date, location, q AS output_type_id, {_r('coalesce(sum(value * weight) FILTER (WHERE weight > 0) / nullif(sum(weight) FILTER (WHERE weight > 0), 0), avg(value)) AS value', digits=5)}, CAST(h - 1 AS INTEGER) AS horizon FROM lg GROUP BY 1, 2, 3, 4, 5",
))
def ensemble_combine(spark, sf_dir):
    panel = _panel(spark, sf_dir)
    fc = tables.stored(views.forecasts(panel), "forecasts")
    weights = ensemble.rolling_weights(scoring.wis(fc, panel), 4, False, models=("ar1", "persistence", "seasonal"))
    out = ensemble.ensemble_combine(_long(fc), weights, ("h", "reference_date", "model"))
    return _rounded(out.drop("target", "output_type", "model"), 5)


@query(_with(
    "wis", kept="SELECT * FROM wis WHERE target_end_date >= DATE '1998-01-03' AND location NOT IN ('NATION_5')",
    fair="SELECT * FROM kept WHERE (h, location, target_end_date) IN (SELECT (h, location, target_end_date) FROM kept GROUP BY h, location, target_end_date HAVING count(DISTINCT model) = (SELECT count(DISTINCT model) FROM kept))",
    each="SELECT h, model, location, avg(round(wis, 6)) AS wis FROM fair GROUP BY 1, 2, 3 UNION ALL SELECT NULL, model, location, avg(round(wis, 6)) FROM fair GROUP BY 2, 3",
    geo=f"SELECT h, model, {_GEO} AS g FROM each GROUP BY 1, 2",
    final=f"SELECT h, model, {_r('g AS geo_wis', 'g / max(CASE WHEN model = ' + chr(39) + 'persistence' + chr(39) + ' THEN g END) OVER (PARTITION BY h) AS relative_wis', digits=5)} FROM geo",
))
def evaluation_report(spark, sf_dir):
    return _rounded(ensemble.evaluate(_stored_scores(spark, sf_dir).withColumn("wis", F.round("wis", 6)), "persistence", "1998-01-03", ["NATION_5"]), 5)


_Q = {n: z_values()[LEVELS.index(q)] for n, q in ensemble.BANDS.items()}


@query(_with("fc", last="SELECT location, max(date) AS d FROM filled GROUP BY 1", final="SELECT location, reference_date, CAST(target_end_date AS DATE) AS target_end_date, " + ", ".join(_r(f"greatest(0, point + {z!r} * sigma) AS {n}", digits=5) for n, z in _Q.items()) + " FROM fc JOIN last USING (location) WHERE model = 'persistence' AND target_end_date > d"))
def fan_chart(spark, sf_dir):
    panel = _panel(spark, sf_dir)
    return _rounded(ensemble.fan_chart(_long(views.forecasts(panel).where("model = 'persistence'")), panel), 5)


@query(_with("scored", final=f"SELECT location, count(*) AS n_forecasts, {_r('avg(obs) AS actual_mean', 'stddev_pop(obs) AS actual_std', 'avg(point) AS model_median_mean', 'avg(base) AS baseline_median_mean', digits=5)}, min(reference_date) AS first_date, max(reference_date) AS last_date FROM (SELECT s.*, f.y AS base FROM scored s JOIN filled f ON f.location = s.location AND f.date = s.reference_date WHERE model = 'ar1' AND h = 1) GROUP BY 1"))
def forecast_summary(spark, sf_dir):
    panel = _panel(spark, sf_dir)
    rows = joins.attach_truth(views.forecasts(panel).where("model = 'ar1' AND h = 1"), panel)
    base = panel.select("location", F.col("date").alias("reference_date"), F.col("y").alias("baseline_median"))
    rows = rows.join(base, ["location", "reference_date"]).select("location", F.col("reference_date").alias("date"), "obs", F.col("point").alias("model_median"), "baseline_median")
    return _rounded(aggregates.forecast_summary(rows), 5)


@query(_with("wis", final=f"SELECT location, h, {_r('avg(wis) AS mean_wis', digits=5)} FROM wis WHERE model = 'persistence' GROUP BY 1, 2"))
def baseline_scores(spark, sf_dir):
    """The minimum slice: weekly panel, completed and filled, persistence quantiles, scored."""
    panel = _panel(spark, sf_dir)
    fc = quantiles.baseline_quantiles(panel).withColumn("target_end_date", F.date_add("reference_date", F.col("h") * 7))
    return _rounded(scoring.mean_wis(scoring.wis(fc, panel), ["location", "h"]), 5)


# ---------------------------------------------------------------------------------------------- backtests


@query(_with("panel", n_="SELECT location, count(*) AS n FROM panel GROUP BY 1 HAVING count(*) > 104", final="SELECT location, CAST(fold AS INTEGER) AS fold, CAST(100 + fold * step AS INTEGER) AS train_rows, CAST(100 + fold * step AS INTEGER) AS test_start, CAST(104 + fold * step AS INTEGER) AS test_end FROM (SELECT location, n, greatest(1, (n - 104) // 5) AS step, unnest(range(5)) AS fold FROM n_) WHERE 104 + fold * step <= n"))
def rolling_folds(spark, sf_dir):
    return backtest.rolling_folds(weekly_panel(spark, sf_dir), 100, 4, n_splits=5)


@query(_with("panel", h_="SELECT *, row_number() OVER (PARTITION BY location ORDER BY date) AS r, count(*) OVER (PARTITION BY location) AS n FROM panel", final="SELECT a.location, a.date AS anchor, CAST(2 AS INTEGER) AS h, b.date AS label_date, b.y AS label FROM h_ a JOIN panel b ON b.location = a.location AND b.date = a.date + 14 WHERE r > n // 2"))
def backtest_anchors(spark, sf_dir):
    return backtest.anchors(weekly_panel(spark, sf_dir), 2)


@query(_with("filled", final=f"SELECT a.location, a.date, {_r('a.y AS y')}, CAST(3 AS INTEGER) AS h, b.date AS label_date, {_r('b.y AS label')}, CASE WHEN b.date <= DATE '1998-01-03' THEN 'train' ELSE 'test' END AS split FROM filled a JOIN filled b ON b.location = a.location AND b.date = a.date + 21 WHERE b.date <= DATE '1998-01-03' OR a.date > DATE '1998-01-03'"))
def assemble_rows(spark, sf_dir):
    return _rounded(backtest.assemble(filled(spark, sf_dir), 3, "1998-01-03"))


from tidewell.plans import model_queries, more_queries  # noqa: E402, F401 (register their queries)
