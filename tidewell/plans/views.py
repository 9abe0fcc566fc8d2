"""The driver's tables in the roles of the feeds: weekly orders of each nation are the panel, shipped quantity the predictor, returns the share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewell.functions.calendar import week_ending
from tidewell.functions.numeric import gaussian_array
from tidewell.operators.features import detrended_std
from tidewell.operators.impute import complete_weekly, interpolate
from tidewell.operators.models import forecast_ar1, forecast_persistence

HORIZONS = (1, 2, 3, 4)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def weekly_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(location, date, y): orders of a nation's customers, by week."""
    orders = table(spark, sf_dir, "orders").groupBy("o_custkey", week_ending(F.col("o_orderdate").cast("date")).alias("date")).agg(F.count("*").alias("n"))
    customers = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_name").alias("location"))
    return orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).groupBy("location", "date").agg(F.sum("n").cast("double").alias("y"))


def completed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return complete_weekly(weekly_panel(spark, sf_dir))


def filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interpolate(completed(spark, sf_dir))


def shipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(location, date, x, share): quantity shipped by a nation's suppliers, by week, and the share of returned lines."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", week_ending(F.col("l_shipdate").cast("date")).alias("date")).agg(
        F.sum(F.col("l_quantity").cast("double")).alias("q"), F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("r")
    )
    suppliers = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_name").alias("location"))
    rows = lines.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey")).groupBy("location", "date").agg(F.sum("q").alias("x"), F.sum("n").alias("n"), F.sum("r").alias("r"))
    return rows.select("location", "date", "x", (F.col("r") / F.col("n")).alias("share"))


def population(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(location, location_code, population): customers of each nation."""
    nations = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("location"))
    counts = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("population"))
    return nations.join(counts, F.col("n_nationkey") == F.col("c_nationkey")).select("location", F.lpad(F.col("n_nationkey").cast("string"), 2, "0").alias("location_code"), "population")


def points(panel: DataFrame) -> DataFrame:
    """(model, location, reference_date, h, point) of three models: persistence, first-order autoregression, and the value a year before the target."""
    year = panel.select(F.col("location"), F.date_add("date", 364).alias("target"), F.col("y").alias("point"))
    ahead = panel.select("location", F.col("date").alias("reference_date"), F.explode(F.array(*map(F.lit, HORIZONS))).alias("h")).withColumn("target", F.date_add("reference_date", F.col("h") * 7))
    seasonal = ahead.join(year, ["location", "target"]).select("location", "reference_date", "h", "point")
    named = [f.select(F.lit(n).alias("model"), "location", "reference_date", "h", "point") for n, f in (("persistence", forecast_persistence(panel, HORIZONS)), ("ar1", forecast_ar1(panel, HORIZONS)), ("seasonal", seasonal))]
    return named[0].unionByName(named[1]).unionByName(named[2])


def forecasts(panel: DataFrame) -> DataFrame:
    """points() with target_end_date, sigma and quantiles: normal, of the panel's detrended deviation at the reference date."""
    spread = detrended_std(panel).select("location", F.col("date").alias("reference_date"), "detrended_std", "n_seen")
    rows = points(panel).join(spread, ["location", "reference_date"])
    sigma = F.when(F.col("n_seen") >= 10, F.col("detrended_std")).otherwise(F.greatest(F.abs("point") * 0.25, F.lit(5.0)))
    rows = rows.withColumn("sigma", sigma).withColumn("target_end_date", F.date_add("reference_date", F.col("h") * 7))
    return rows.withColumn("quantiles", gaussian_array(F.col("point"), F.col("sigma"))).drop("detrended_std", "n_seen")


def rank_scores(df: DataFrame, value: str, key: str = "location") -> DataFrame:
    """`p`: (average rank - 0.5) / n of a value in its series."""
    w = Window.partitionBy(key)
    ties = Window.partitionBy(key, value)
    rank = F.rank().over(w.orderBy(value)) + (F.count("*").over(ties) - 1) / 2.0
    return df.withColumn("p", (rank - 0.5) / F.count(value).over(w))
