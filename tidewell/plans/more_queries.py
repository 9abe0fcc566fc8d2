"""Further queries on the driver's tables: sources and sinks (written to the shared folder and read back), selections, scores and forecasts that no other query reaches."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.functions.numeric import LEVELS, z_values
from tidewell.operators import aggregates, features, joins, models, quantiles, scoring, select
from tidewell.plans import views
from tidewell.plans.queries import _ERR, _KEYS, _LAGS, _PAIRS, _QS, _W, _ZS, _levels_out, _long, _panel, _r, _rounded, _with, query
from tidewell.plans.views import filled, population, shipped, weekly_panel
from tidewell.sources import tables


def _place(spark, name: str) -> str:
    return f"{tables.shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


# ---------------------------------------------------------------------------------------------- sources and sinks


@query("SELECT n_name AS abbreviation, lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS location, n_name AS location_name, count(c_custkey) AS population, CAST(n_nationkey * 3 AS BIGINT) AS count_rate1per100k, CAST(n_nationkey * 5 AS BIGINT) AS count_rate2per100k FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_name, n_nationkey")
def locations_file(spark, sf_dir):
    people = views.table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"))
    rows = views.table(spark, sf_dir, "nation").join(people, F.col("n_nationkey") == F.col("c_nationkey"), "left").select(
        F.col("n_name").alias("abbreviation"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0").alias("location"), F.col("n_name").alias("location_name"), F.coalesce("n", F.lit(0)).alias("population"),
        (F.col("n_nationkey") * 3).alias("count_rate1per100k"), (F.col("n_nationkey") * 5).alias("count_rate2per100k"),
    )
    path = _place(spark, "locations")
    rows.write.option("header", True).csv(path)
    return tables.read_locations(spark, path)


_SATURDAY = "CAST(make_date(year, 1, 3) + CAST(CASE dayofweek(make_date(year, 1, 3)) WHEN 6 THEN 7 ELSE 6 - dayofweek(make_date(year, 1, 3)) END AS INTEGER) + 7 * (week - 1) AS DATE)"


@query(_with("panel", parts="SELECT *, CAST(year(date) AS INTEGER) AS year, CAST(weekofyear(date) AS INTEGER) AS week FROM panel", final=f"SELECT {_SATURDAY} AS date, CASE location WHEN 'NATION_0' THEN 'US' ELSE location END AS location_name, CASE WHEN y % 7 = 0 THEN 0.0 ELSE y END AS rate FROM parts WHERE {_SATURDAY} <= DATE '2000-01-01'"))
def rate_feed(spark, sf_dir):
    panel = weekly_panel(spark, sf_dir).withColumns({"year": F.year("date"), "week": F.weekofyear("date")})
    text = F.when(F.col("y") % 7 == 0, "null").otherwise(F.col("y").cast("string"))
    name = F.when(F.col("location") == "NATION_0", "Entire Network").otherwise(F.col("location"))
    rows = panel.select(F.explode(F.array(F.lit("Overall"), F.lit("0-4 yr"))).alias("AGE CATEGORY"), F.lit("Overall").alias("SEX CATEGORY"), F.lit("Overall").alias("RACE CATEGORY"), name.alias("CATCHMENT"), text.alias("WEEKLY RATE"), F.col("year").alias("MMWR-YEAR"), F.col("week").alias("MMWR-WEEK"))
    path = _place(spark, "rates")
    rows.write.option("header", True).csv(path)
    return tables.read_rate_feed(spark, path, "2000-01-01")


@query(_with("panel", final="SELECT date, lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS location, p.location AS location_name, y AS value FROM panel p JOIN nation ON n_name = p.location"))
def truth_files(spark, sf_dir):
    codes = views.table(spark, sf_dir, "nation").select(F.col("n_name").alias("location_name"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0").alias("location"))
    rows = tables.stored(weekly_panel(spark, sf_dir).withColumnRenamed("location", "location_name").join(codes, "location_name").select("date", "location", "location_name", F.col("y").alias("value")), "truth")
    old, new = _place(spark, "truth-old"), _place(spark, "truth-new")
    rows.where("date < '1999-01-09'").write.option("header", True).csv(old)  # the files overlap in one week; the ranges don't
    rows.where("date >= '1999-01-02'").write.option("header", True).csv(new)
    return tables.read_truth(spark, [old, new], [(None, "1999-01-02"), ("1999-01-02", None)])


@query(_with("completed", final="SELECT location, date, y FROM completed"))
def panel_file(spark, sf_dir):
    none = F.lit(None)
    rows = views.completed(spark, sf_dir).select(
        "date", F.col("location").alias("location_name"), none.cast("double").alias("ili"), none.cast("double").alias("pred_hosp"), F.col("y").alias("true_hosp"), F.lit(1.0).alias("scale_factor"), F.lit(1).alias("population"), none.cast("double").alias("prelim_hosp"), F.col("y").alias("total_hosp")
    )
    path = _place(spark, "panel")
    rows.write.option("header", True).csv(path)
    return tables.read_panel(spark, path)


@query(_with("panel", final="SELECT location, date, y, DATE '2001-08-04' AS as_of FROM panel"))
def panel_snapshots(spark, sf_dir):
    """Two dated snapshots, one of them written twice; the newest is read."""
    panel, root = tables.stored(weekly_panel(spark, sf_dir), "weekly"), _place(spark, "snapshots")
    early = select.as_of(panel, "1999-06-05")
    tables.write_panel(early.limit(1), root, "1999-06-05")
    tables.write_panel(early, root, "1999-06-05")
    tables.write_panel(panel, root, "2001-08-04")
    return tables.latest_snapshot(spark.read.parquet(root)).select("location", "date", "y", "as_of")


@query(_with("fc", "levels", final=f"SELECT model, h, reference_date, CAST(h - 1 AS INTEGER) AS horizon, 'wk inc' AS target, CAST(target_end_date AS DATE) AS target_end_date, location, 'quantile' AS output_type, q AS output_type_id, {_r('greatest(0, point + z * sigma) AS value', digits=5)} FROM fc, levels WHERE model IN ('ar1', 'persistence') AND h IN (1, 3)"))
def forecast_store(spark, sf_dir):
    """Forecasts of three models and four horizons written by model and horizon; two of each are read, and one more that isn't there."""
    root = _place(spark, "forecasts")
    tables.write_forecasts(_long(views.forecasts(_panel(spark, sf_dir))).withColumn("horizon", F.col("h") - 1), root)
    return _rounded(tables.read_forecasts(spark, root, ["ar1", "persistence", "absent"], [1, 3]), 5)


def _params(spark, sf_dir) -> DataFrame:
    nations = views.table(spark, sf_dir, "nation")
    made = F.when(F.col("n_nationkey") % 2 == 0, F.create_map(F.lit("p"), F.lit(1.0), F.lit("ridge"), F.col("n_nationkey") / 10)).otherwise(F.create_map(F.lit("p"), F.lit(2.0)))
    lags = F.when(F.col("n_nationkey") % 3 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(1), F.lit(2)))
    return nations.select(F.col("n_name").alias("location"), F.explode(F.array(F.lit(1), F.lit(2))).alias("h"), made.alias("params"), lags.alias("lags"), F.array(F.lit(0.5), F.col("n_nationkey").cast("double")).alias("residuals"), F.lit("log1p").alias("residual_scale"))


@query(_with("panel", final="SELECT location, h, date, y, CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey / 10.0::DOUBLE END AS ridge, CASE WHEN n_nationkey % 2 = 0 THEN 1.0 ELSE 2.0 END::DOUBLE AS p, CASE WHEN n_nationkey % 3 = 0 THEN 0 ELSE 1 END::INTEGER AS first_lag, n_nationkey::DOUBLE AS residual, 'log1p' AS residual_scale FROM panel JOIN nation ON n_name = location, (VALUES (1), (2)) t(h)"))
def params_store(spark, sf_dir):
    """Parameters with maps and arrays, written, read back and joined to the panel by location."""
    root = _place(spark, "params")
    tables.write_params(_params(spark, sf_dir), root)
    rows = weekly_panel(spark, sf_dir).join(tables.read_params(spark, root), "location")
    return rows.select("location", "h", "date", "y", F.col("params")["ridge"].alias("ridge"), F.col("params")["p"].alias("p"), F.col("lags")[0].alias("first_lag"), F.col("residuals")[1].alias("residual"), "residual_scale")


@query("SELECT n_name AS location, 'missing: ridge' AS problem FROM nation, (VALUES (1), (2)) t(h) WHERE n_nationkey % 2 <> 0 UNION ALL SELECT n_name, 'lag below 1' FROM nation, (VALUES (1), (2)) t(h) WHERE n_nationkey % 3 = 0")
def params_problems(spark, sf_dir):
    return tables.validate_params(_params(spark, sf_dir))


@query("SELECT DISTINCT r_name AS folder, h FROM region JOIN nation ON n_regionkey = r_regionkey, (VALUES (1), (2)) t(h)")
def configurations(spark, sf_dir):
    """Parameter files below a folder for each region and horizon, found by their names."""
    root = _place(spark, "configurations")
    regions = views.table(spark, sf_dir, "nation").join(views.table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("location"), F.col("r_name").alias("folder"))
    _params(spark, sf_dir).join(regions, "location").withColumn("set", F.concat(F.lit("run_h"), F.col("h"))).drop("h").write.partitionBy("folder", "set").parquet(root)
    return tables.list_configurations(spark, root, r"folder=([^/]+)/set=run_h(\d+)/[^/]*$")


# ---------------------------------------------------------------------------------------------- selections


@query(f"SELECT CAST(o_orderdate AS DATE) AS date, count(*) AS n FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' AND CAST(o_orderdate AS DATE) <= DATE '1998-01-03' GROUP BY 1")
def strata_as_of(spark, sf_dir):
    rows = select.filter_strata(views.table(spark, sf_dir, "orders"), o_orderstatus="F", o_orderpriority="1-URGENT").select(F.col("o_orderdate").cast("date").alias("date"))
    return select.as_of(rows, "1998-01-03").groupBy("date").agg(F.count("*").alias("n"))


@query(_with("completed", final="SELECT location, date, y FROM completed WHERE y IS NOT NULL"))
def known_rows(spark, sf_dir):
    return select.drop_na(views.completed(spark, sf_dir), "y")


@query(_with("panel", final="SELECT location, date, y, CASE WHEN date < DATE '1998-01-03' THEN 'train' ELSE 'test' END AS split FROM panel"))
def split_before(spark, sf_dir):
    return select.split_at(weekly_panel(spark, sf_dir), "1998-01-03", inclusive=False)


@query(_with("filled", final=f"SELECT location, date, {_r(f'greatest(0, y - lag(y) OVER {_W}) AS y_diff1', f'greatest(0, coalesce(y - lag(y, 4) OVER {_W}, 0)) AS y_diff4')} FROM filled".replace(f"greatest(0, y - lag(y) OVER {_W})", f"greatest(0, coalesce(y - lag(y) OVER {_W}, 0))")))
def clamped_changes(spark, sf_dir):
    return _rounded(select.clamp_nonneg(features.diff_features(filled(spark, sf_dir), (1, 4)).fillna(0.0).drop("y"), ["y_diff1", "y_diff4"]))


@query(_with("points", final=f"SELECT model, location, reference_date, h, {_r('point', digits=5)} FROM points WHERE model IN ('persistence', 'seasonal')"))
def two_models(spark, sf_dir):
    return _rounded(select.keep_models(views.points(_panel(spark, sf_dir)), ["persistence", "seasonal"]), 5)


@query(_with("panel", final="SELECT location, date, y FROM panel QUALIFY dense_rank() OVER (PARTITION BY location ORDER BY date) <= 5"))
def first_weeks(spark, sf_dir):
    return select.first_dates(weekly_panel(spark, sf_dir), 5)


@query(_with("panel", "shipped", final=f"SELECT location, date, y, NULL::DOUBLE AS x, NULL::DOUBLE AS share FROM panel UNION ALL SELECT location, date, NULL, {_r('x', 'share')} FROM shipped"))
def appended_feeds(spark, sf_dir):
    return _rounded(joins.append_rows(weekly_panel(spark, sf_dir), shipped(spark, sf_dir)))


@query("SELECT n_name AS location, lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS location_code FROM nation WHERE n_nationkey < 20")
def known_codes(spark, sf_dir):
    nations = views.table(spark, sf_dir, "nation")
    dim = nations.where("n_nationkey < 20").select(F.col("n_name").alias("location_name"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0").alias("location_code"))
    return select.map_code(nations.select(F.col("n_name").alias("location")), dim, drop_unknown=True)


@query(_with("panel", last="SELECT location, max(date) AS d FROM panel GROUP BY 1", final="SELECT location, CAST(d + 7 * k AS DATE) AS date, CAST(least(weekofyear(CAST(d + 7 * k AS DATE)), 52) AS INTEGER) AS week_num FROM last, (VALUES (1), (2), (3), (4)) t(k)"))
def future_weeks(spark, sf_dir):
    return features.future_weeks(weekly_panel(spark, sf_dir), 4)


@query(_with("filled", stats="SELECT location, avg(y) AS m, stddev_pop(y) AS s FROM filled WHERE date <= DATE '1998-01-03' GROUP BY 1", final=f"SELECT f.location, date, {_r('coalesce((y - m) / nullif(s, 0), 0) AS y_z')} FROM filled f LEFT JOIN stats USING (location)"))
def standardised_by_train(spark, sf_dir):
    rows = filled(spark, sf_dir).withColumn("train", F.col("date") <= F.lit("1998-01-03").cast("date"))
    return _rounded(aggregates.standardise(rows, ["y"], "train", train="train").drop("y", "train"))


_T = {
    "pairs": _PAIRS,
    "lm": "SELECT count(*) AS n, regr_intercept(y, x) AS intercept, regr_slope(y, x) AS slope, regr_r2(y, x) AS r2, regr_slope(y, x) / sqrt((regr_syy(y, x) - pow(regr_sxy(y, x), 2) / regr_sxx(y, x)) / (count(*) - 2) / regr_sxx(y, x)) AS t FROM pairs",
    "angle": "SELECT *, n - 2 AS v, atan(abs(t) / sqrt(n - 2)) AS a FROM lm",
    # Student's distribution with a whole number v of degrees of freedom is a finite sum of powers of cos(a)
    "terms": "SELECT v, a, k, CASE WHEN v % 2 = 0 THEN (2 * k - 1) / (2.0 * k) ELSE 2.0 * k / (2 * k + 1) END * pow(cos(a), 2) AS f FROM angle, (SELECT unnest(range(1, 100000)) AS k) WHERE k <= (v - 2 - v % 2) // 2",
    "total": "SELECT v, a, 1 + coalesce((SELECT sum(p) FROM (SELECT exp(sum(ln(f)) OVER (ORDER BY k)) AS p FROM terms)), 0) AS s FROM angle",
    "student": "SELECT CASE WHEN v % 2 = 0 THEN sin(a) * s ELSE 2 / pi() * (a + CASE WHEN v > 1 THEN sin(a) * cos(a) * s ELSE 0 END) END AS inside FROM total",
}


@query(_with("filled", "shipped", **_T, final=f"SELECT n, {_r('intercept', 'slope', 'r2', '1 - inside AS p_value')}, {_r('t AS t_value', digits=4)} FROM lm, student"))
def fit_lm_pooled(spark, sf_dir):
    rows = filled(spark, sf_dir).join(shipped(spark, sf_dir), ["location", "date"]).select(F.ln(F.col("y") + 1).alias("y"), F.ln(F.col("x") + 1).alias("x"))
    return _rounded(aggregates.fit_lm_pooled(tables.stored(rows, "pairs"), "y", "x")).withColumn("t_value", F.round("t_value", 4) + 0.0)


# ---------------------------------------------------------------------------------------------- scores


@query(_with("wis", final=f"SELECT model, location, reference_date, h, {_r('wis', digits=5)} FROM wis"))
def wis_of_long_rows(spark, sf_dir):
    panel = _panel(spark, sf_dir)
    out = scoring.wis_long(_long(views.forecasts(panel)), panel, ["model", "location", "reference_date", "h", "target_end_date"])
    return _rounded(out.select(*_KEYS, "wis"), 5)


_LOG = (
    "SELECT model, location, reference_date, h, target_end_date, 0.5 * abs(any_value(o) - ln(greatest(0, any_value(point)) + 1e-6)) + sum(alpha / 2 * (hi - lo + 2 / alpha * (greatest(0, lo - o) + greatest(0, o - hi)))) AS wis FROM ("
    "SELECT scored.*, alpha, ln(obs + 1e-6) AS o, ln(greatest(0, point + zl * sigma) + 1e-6) AS lo, ln(greatest(0, point + zh * sigma) + 1e-6) AS hi FROM scored, ivals) GROUP BY 1, 2, 3, 4, 5"
)
_POSITIVE = "exp(avg(CASE WHEN round(wis, 6) > 0 THEN ln(round(wis, 6)) END))"


@query(_with("scored", "ivals", lw=_LOG, final=f"SELECT h, model, {_r(_POSITIVE + ' AS geo_wis', digits=5)} FROM lw GROUP BY 1, 2"))
def geometric_log_wis(spark, sf_dir):
    panel = _panel(spark, sf_dir)
    rows = scoring.log_shifted(joins.attach_truth(views.forecasts(panel), panel))
    return _rounded(scoring.geometric_wis(scoring.wis(rows).withColumn("wis", F.round("wis", 6)), ["h", "model"]), 5)


@query(_with(
    "scored", "ivals", lw=_LOG.replace("FROM scored, ivals)", "FROM scored, ivals WHERE h = 1 AND sigma > 1e-6)"),
    final=f"SELECT a.location, CAST(a.target_end_date AS DATE) AS target_end_date, {_r('a.wis AS model_wis', 'b.wis AS baseline_wis', 'a.wis / b.wis AS relative_wis', digits=4)} FROM lw a JOIN lw b ON a.location = b.location AND a.target_end_date = b.target_end_date WHERE a.model = 'ar1' AND b.model = 'persistence'",
))
def relative_wis_of_wide_rows(spark, sf_dir):
    panel = _panel(spark, sf_dir)
    fc = tables.stored(views.forecasts(panel).where("h = 1 AND sigma > 1e-6"), "forecasts")

    def wide(model: str) -> DataFrame:
        return fc.where(F.col("model") == model).select("location", "target_end_date", *(F.col("quantiles")[k].alias(f"q_{q}") for k, q in enumerate(LEVELS)))

    truth = panel.select("location", F.col("date").alias("target_end_date"), F.col("y").alias("value"))
    return _rounded(scoring.evaluate_relative(wide("ar1"), truth, wide("persistence")), 4)


_RES = "SELECT *, {0} AS residual FROM err WHERE reference_date < DATE '1999-06-05'"
_PCT, _RAW = "(obs - point) / greatest(point, 1e-8)", "obs - point"


@query(_with("ar", "filled", **_ERR, final=f"SELECT location, h, reference_date AS anchor, {_r(_PCT + ' AS pct', _RAW + ' AS raw', digits=5)} FROM err WHERE point > 1e-3"))
def residuals_by_scale(spark, sf_dir):
    panel = _panel(spark, sf_dir)
    errors = quantiles.validation_errors(models.forecast_ar1(panel), panel).where("point > 1e-3")
    both = quantiles.scaled_residuals(errors, "pct").withColumnRenamed("residual", "pct")
    return _rounded(quantiles.scaled_residuals(both, "raw").withColumnRenamed("residual", "raw").select("location", "h", "anchor", "pct", "raw"), 5)


def _ladder(back: str) -> dict[str, str]:
    """Quantiles of late forecasts from so many residuals of each location as its number modulo 14 says: all rungs from none to 13. `back` moves point by r."""
    return {
        "ranked": "SELECT e.*, row_number() OVER (PARTITION BY e.location, h ORDER BY reference_date) AS i, n_nationkey % 14 AS most FROM res e JOIN nation ON n_name = e.location",
        "own": f"SELECT location, h, quantile_cont(residual, {_QS}) AS qs, count(*) AS n, stddev_pop(residual) AS s FROM ranked WHERE i <= most GROUP BY 1, 2",
        "old": f"SELECT location, h, quantile_cont(error, {_QS}) AS eq, count(*) AS en, stddev_pop(error) AS es FROM ranked WHERE i <= 20 - most GROUP BY 1, 2",
        "late": "SELECT a.*, coalesce(n, 0) AS n, qs, CASE WHEN n > 1 AND s > 1e-8 THEN s ELSE 0.5 END AS s, coalesce(en, 0) AS en, eq, es FROM ar a LEFT JOIN own o ON o.location = a.location AND o.h = a.h LEFT JOIN old e ON e.location = a.location AND e.h = a.h WHERE a.reference_date >= DATE '1999-06-05'",
        "each": f"SELECT * EXCLUDE (qs, eq), unnest(qs) AS qv, unnest(eq) AS ev, unnest({_ZS}) AS z, CAST(unnest(range(23)) AS INTEGER) AS k FROM late",
        "moved": f"SELECT location, reference_date, h, k, greatest(0, CASE WHEN n >= 10 THEN {back.format('qv')} WHEN n >= 1 THEN {back.format('(s * z)')} WHEN en >= 10 THEN point + ev WHEN en > 1 THEN point + z * greatest(es, 5.0) ELSE point + z * greatest(0.25 * abs(point), 5.0) END) AS value FROM each",
    }


def _ladder_rows(spark, sf_dir, scale: str) -> DataFrame:
    panel = _panel(spark, sf_dir)
    fc = models.forecast_ar1(panel)
    early, late = fc.where("reference_date < '1999-06-05'"), fc.where("reference_date >= '1999-06-05'")
    number = views.table(spark, sf_dir, "nation").select(F.col("n_name").alias("location"), (F.col("n_nationkey") % 14).alias("most"))
    errors = quantiles.validation_errors(early, panel).join(number, "location")
    w = features.series("location", "anchor").partitionBy("location", "h").orderBy("anchor")
    ranked = tables.stored(quantiles.scaled_residuals(errors.withColumn("i", F.row_number().over(w)), scale), "residuals")
    return _levels_out(quantiles.residual_quantiles(late, ranked.where("i <= most"), scale, "scaled", ranked.where("i <= 20 - most")), 4)


@query(_with("ar", "filled", **_ERR, res=_RES.format(_RAW), **_ladder("point + {0}"), final=f"SELECT location, reference_date, h, k, {_r('value', digits=4)} FROM moved"))
def residual_ladder_raw(spark, sf_dir):
    return _ladder_rows(spark, sf_dir, "raw")


@query(_with("ar", "filled", **_ERR, res=_RES.format(_PCT), **_ladder("point * ({0} + 1.0)"), final=f"SELECT location, reference_date, h, k, {_r('value', digits=4)} FROM moved"))
def residual_ladder_pct(spark, sf_dir):
    return _ladder_rows(spark, sf_dir, "pct")


_Z = dict(zip(LEVELS, z_values(), strict=True))


@query(_with("fc", last="SELECT location, max(date) AS d FROM filled GROUP BY 1", final=f"SELECT location, reference_date AS forecast_date, CAST(target_end_date AS DATE) AS target_date, h AS horizon, {_r('point AS mu', 'sigma', 'greatest(0, point) AS median_forecast', f'greatest(0, point + {_Z[0.025]!r} * sigma) AS lower_95', f'greatest(0, point + {_Z[0.975]!r} * sigma) AS upper_95', digits=5)} FROM fc JOIN last USING (location) WHERE model = 'ar1' AND reference_date = d"))
def prospective_summary(spark, sf_dir):
    panel = _panel(spark, sf_dir)
    last = panel.groupBy("location").agg(F.max("date").alias("reference_date"))
    fc = views.forecasts(panel).where("model = 'ar1'").join(last, ["location", "reference_date"])
    return _rounded(aggregates.prospective_summary(fc.withColumnRenamed("point", "mu")), 5)


# ---------------------------------------------------------------------------------------------- forecasts

#: Autoregression of order 2 at every date: normal equations of two centred variables from running moments.
_AR2 = {
    "pairs2": f"SELECT *, CASE WHEN l2 IS NOT NULL THEN l1 END AS x1, CASE WHEN l2 IS NOT NULL THEN l2 END AS x2, CASE WHEN l2 IS NOT NULL THEN y END AS t FROM (SELECT *, lag(y) OVER {_W} AS l1, lag(y, 2) OVER {_W} AS l2 FROM {{0}})",
    "sums2": "SELECT *, count(t) OVER w AS n, avg(x1) OVER w AS m1, avg(x2) OVER w AS m2, avg(t) OVER w AS mt, var_pop(x1) OVER w AS v1, var_pop(x2) OVER w AS v2, covar_pop(x1, x2) OVER w AS c12, covar_pop(x1, t) OVER w AS c1, covar_pop(x2, t) OVER w AS c2 FROM pairs2 WINDOW w AS (PARTITION BY location ORDER BY date ROWS UNBOUNDED PRECEDING)",
    "coef2": "SELECT *, CASE WHEN v1 > 1e-6 * (1 + m1 * m1) AND v2 > 1e-6 * (1 + m2 * m2) AND v1 * v2 - c12 * c12 > 1e-6 * v1 * v2 THEN (c1 * v2 - c2 * c12) / (v1 * v2 - c12 * c12) END AS b1, (c2 * v1 - c1 * c12) / nullif(v1 * v2 - c12 * c12, 0) AS b2 FROM sums2",
    "step1": "SELECT *, mt - b1 * m1 - b2 * m2 AS a, mt - b1 * m1 - b2 * m2 + b1 * y + b2 * l1 AS f1 FROM coef2",
    "step2": "SELECT *, a + b1 * f1 + b2 * y AS f2 FROM step1",
    "step3": "SELECT *, a + b1 * f2 + b2 * f1 AS f3 FROM step2",
    "ar2": "SELECT location, date AS reference_date, h, greatest(0, CASE WHEN n < 12 OR b1 IS NULL OR l1 IS NULL THEN y WHEN h = 1 THEN f1 WHEN h = 2 THEN f2 WHEN h = 3 THEN f3 ELSE a + b1 * f3 + b2 * f2 END) AS point FROM step3, hs",
}


def _ar2(source: str) -> dict[str, str]:
    return {k: v.replace("{0}", source) for k, v in _AR2.items()}


@query(_with("filled", "hs", **_ar2("filled"), final=f"SELECT location, reference_date, h, {_r('point + 1e-9 AS point', digits=4)} FROM ar2"))
def ar_2(spark, sf_dir):
    """The small shift keeps exact halves, which are frequent, away from the edge of rounding."""
    return _rounded(models.forecast_ar(filled(spark, sf_dir), 2, ridge=0.0).withColumn("point", F.col("point") + 1e-9), 4)


_HALF = f"SELECT location, date, y FROM (SELECT *, row_number() OVER {_W} AS i, count(*) OVER (PARTITION BY location) AS c FROM filled) WHERE i <= c // 2"
_AR1 = {
    "pairs1": f"SELECT *, lag(y) OVER {_W} AS x1 FROM half",
    "sums1": "SELECT *, count(x1) OVER w AS n, avg(x1) OVER w AS m1, avg(CASE WHEN x1 IS NOT NULL THEN y END) OVER w AS mt, CASE WHEN var_pop(x1) OVER w > 1e-6 * (1 + pow(avg(x1) OVER w, 2)) THEN covar_pop(x1, y) OVER w / var_pop(x1) OVER w END AS b FROM pairs1 WINDOW w AS (PARTITION BY location ORDER BY date ROWS UNBOUNDED PRECEDING)",
    "ar1h": "SELECT location, date AS reference_date, greatest(0, CASE WHEN n < 11 OR b IS NULL THEN y ELSE mt - b * m1 + b * y END) AS point FROM sums1",
}


@query(_with(
    "filled", "hs", half=_HALF, **_ar2("half"), **_AR1,
    tried="SELECT 1 AS p, location, reference_date, point FROM ar1h UNION ALL SELECT 2, location, reference_date, point FROM ar2 WHERE h = 1",
    errs="SELECT t.location, p, avg(abs(h2.y - point)) AS e FROM tried t JOIN half h2 ON h2.location = t.location AND h2.date = t.reference_date + 7 GROUP BY 1, 2",
    best="SELECT location, first(p ORDER BY round(e, 9), p) AS p FROM errs GROUP BY 1",
    final="SELECT c.location, CAST(CASE WHEN n >= 20 THEN coalesce(p, 1) ELSE 1 END AS INTEGER) AS p FROM (SELECT location, count(y) AS n FROM filled GROUP BY 1) c LEFT JOIN best USING (location)",
))
def order_of_two(spark, sf_dir):
    return models.select_order(_panel(spark, sf_dir), (1, 2), ridge=0.0)


@query(_with(
    "filled", "hs", half="SELECT location, date, y FROM filled", **_ar2("half"), **_AR1,
    tried="SELECT 1 AS p, location, reference_date, point FROM ar1h UNION ALL SELECT 2, location, reference_date, point FROM ar2 WHERE h = 1",
    errs="SELECT t.location, p, avg(abs(f.y - point)) AS e FROM tried t JOIN filled f ON f.location = t.location AND f.date = t.reference_date + 7 WHERE f.date <= DATE '1999-06-05' GROUP BY 1, 2",
    final=f"SELECT location, CAST(first(p ORDER BY round(e, 9), p) AS DOUBLE) AS p, {_r('min(e) AS mae', digits=5)} FROM errs GROUP BY 1",
))
def tuned_of_two(spark, sf_dir):
    out = models.tune(_panel(spark, sf_dir), [{"p": 1, "ridge": 0.0}, {"p": 2, "ridge": 0.0}], "1999-06-05")
    return _rounded(out.select("location", F.col("params")["p"].alias("p"), "mae"), 5)


@query(_with(
    "filled",
    lagged=" UNION ALL ".join(f"SELECT *, {h} AS h, lag(y, {h}) OVER {_W} AS x1 FROM filled" for h in (1, 2, 3, 4)),
    sums1="SELECT *, count(x1) OVER w AS n, avg(x1) OVER w AS m1, avg(CASE WHEN x1 IS NOT NULL THEN y END) OVER w AS mt, CASE WHEN var_pop(x1) OVER w > 1e-6 * (1 + pow(avg(x1) OVER w, 2)) THEN covar_pop(x1, y) OVER w / var_pop(x1) OVER w END AS b FROM lagged WINDOW w AS (PARTITION BY location, h ORDER BY date ROWS UNBOUNDED PRECEDING)",
    final=f"SELECT location, date AS reference_date, h, {_r('greatest(0, CASE WHEN n < 25 OR b IS NULL THEN y ELSE mt - b * m1 + b * y END) + 1e-9 AS point', digits=4)} FROM sums1",
))
def linear_of_one(spark, sf_dir):
    """Direct regression at each horizon on the value itself; shifted as in ar_2."""
    return _rounded(models.forecast_linear(filled(spark, sf_dir), ["y"], ridge=0.0).withColumn("point", F.col("point") + 1e-9), 4)


@query()
def linear_with_covariates(spark, sf_dir):
    """Regression on own lags and on the three locations of highest correlation before the cut-off."""
    panel = _panel(spark, sf_dir)
    ranked = aggregates.rank_covariates(joins.covariate_join(select.as_of(panel, "1998-01-03")), "corr", 3)
    rows = features.lag_features(models.with_covariates(panel, tables.stored(ranked, "covariates")), (1, 2))
    return models.forecast_linear(rows, ["y", "y_lag1", "y_lag2", "x1", "x2", "x3"])


_DIFFS = {f"y_diff{k}": f"y - lag(y, {k}) OVER {_W}" for k in (1, 2, 4, 8, 52)}
_PCTS = {f"y_pct{k}": f"y / nullif(lag(y, {k}) OVER {_W}, 0) - 1" for k in (1, 2, 4, 8, 52)}
_MOMS = {f"y_mom{k}": f"y / (lag(y, {k}) OVER {_W} + 1e-8) - 1" for k in (4, 8, 12)}
_MADE = {f"{c}_lag{k}": f"lag({c}, {k}) OVER {_W}" for c in "yx" for k in _LAGS} | _DIFFS | _PCTS | _MOMS
_MADE |= {f"y_{n}{k}": f"{f}(y) OVER (PARTITION BY location ORDER BY date ROWS {k - 1} PRECEDING)" for k in (2, 4, 8, 12) for n, f in (("mean", "avg"), ("min", "min"), ("max", "max"), ("std", "stddev_samp"))}
_MADE |= {"x_current": "x"}


@query(_with(
    "filled", "shipped",
    joined="SELECT f.location, f.date, f.y, s.x FROM filled f LEFT JOIN shipped s ON s.location = f.location AND s.date = f.date",
    made="SELECT location, date, y, x, " + ", ".join(f"{e} AS {c}" for c, e in _MADE.items()) + " FROM joined",
    final="SELECT location, date, " + ", ".join(_r(f"coalesce(last_value({c} IGNORE NULLS) OVER w, 0) AS {c}", digits=5) for c in _MADE) + " FROM made WINDOW w AS (PARTITION BY location ORDER BY date ROWS UNBOUNDED PRECEDING)",
))
def feature_table(spark, sf_dir):
    """All features of build_features() that window functions give, filled; the others have queries of their own."""
    rows = tables.stored(filled(spark, sf_dir).join(shipped(spark, sf_dir).drop("share"), ["location", "date"], "left"), "features")
    made = features.build_features(rows, ["x"], groups=("lags", "rolling", "changes"))
    return _rounded(made.select("location", "date", *_MADE), 5)
