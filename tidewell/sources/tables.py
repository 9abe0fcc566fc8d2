"""Sources and sinks. Schemas are explicit: codes keep their leading zeros. Snapshots and forecasts are tables partitioned by what readers filter on."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tidewell.functions.calendar import mmwr_to_date
from tidewell.functions.numeric import number_of

LOCATIONS = "abbreviation string, location string, location_name string, population long, count_rate1per100k long, count_rate2per100k long"
PANEL = "date date, location_name string, ili double, pred_hosp double, true_hosp double, scale_factor double, population long, prelim_hosp double, total_hosp double"
PARAMS = "location string, h int, params map<string, double>, lags array<int>, residuals array<double>, residual_scale string, bias double, alpha double"
FORECAST = ("reference_date", "horizon", "target", "target_end_date", "location", "output_type", "output_type_id", "value")
_FORECAST_TYPES = ("date", "int", "string", "date", "string", "string", "double", "double")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Without that setting a local master gets a folder of its own; a cluster is an error."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="spark-shared-")
        sc.setCheckpointDir(base)
    return base.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, computed once into a Parquet table of the shared folder and read from there: what several steps use is read, not computed anew, and a lost executor costs its
    tasks only."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_locations(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LOCATIONS).option("header", True).csv(path)


def read_rate_feed(spark: SparkSession, path: str, until=None) -> DataFrame:
    """(date, location_name, rate) of the overall strata of a rate network; the whole network is `US`, the word null a rate of 0."""
    raw = spark.read.option("header", True).csv(path)
    rows = raw.where((F.col("AGE CATEGORY") == "Overall") & (F.col("SEX CATEGORY") == "Overall") & (F.col("RACE CATEGORY") == "Overall"))
    name = F.when(F.col("CATCHMENT") == "Entire Network", "US").otherwise(F.col("CATCHMENT"))
    day = mmwr_to_date(F.col("MMWR-YEAR").try_cast("int"), F.col("MMWR-WEEK").try_cast("int"))
    out = rows.select(day.alias("date"), name.alias("location_name"), number_of(F.col("WEEKLY RATE")).alias("rate")).where("date is not null")
    return out if until is None else out.where(F.col("date") <= F.lit(until).cast("date"))


def read_truth(spark: SparkSession, paths: Sequence[str], ranges: Sequence[tuple]) -> DataFrame:
    """(date, location, location_name, value) of files with ranges [from, to) of dates, either end open as None. Ranges must not overlap, so rows are appended."""
    out = None
    for path, (start, end) in zip(paths, ranges, strict=True):
        raw = spark.read.option("header", True).csv(path)
        rows = raw.select(F.col("date").try_cast("date").alias("date"), "location", "location_name", F.col("value").try_cast("double").alias("value"))
        if start is not None:
            rows = rows.where(F.col("date") >= F.lit(start).cast("date"))
        if end is not None:
            rows = rows.where(F.col("date") < F.lit(end).cast("date"))
        out = rows if out is None else out.unionByName(rows)
    return out


def read_panel(spark: SparkSession, path: str) -> DataFrame:
    """(location, date, y) of a stitched CSV panel; malformed rows are skipped."""
    rows = spark.read.schema(PANEL).option("header", True).option("mode", "DROPMALFORMED").csv(path)
    return rows.select(F.col("location_name").alias("location"), "date", F.col("total_hosp").alias("y"))


def latest_snapshot(df: DataFrame, as_of_col: str = "as_of") -> DataFrame:
    """Rows of the newest snapshot. The date is looked up first, so that only its partition is read."""
    newest = df.agg(F.max(as_of_col)).first()[0]  # one value
    return df.where(F.col(as_of_col) == F.lit(newest))


def latest_file(df: DataFrame, pattern: str = r"(\d{4}-\d{2}-\d{2}|\d{8})") -> DataFrame:
    """Rows of the file whose name holds the newest date, of a DataFrame read from loose files."""
    named = df.withColumn("__d", F.replace(F.regexp_extract(F.col("_metadata.file_name"), pattern, 1), F.lit("-"), F.lit("")))
    newest = named.agg(F.max("__d")).first()[0]
    return named.where(F.col("__d") == F.lit(newest)).drop("__d")


def snapshot_bounds(df: DataFrame, weeks: int = 8, date: str = "date") -> DataFrame:
    """One row: last_date and the date `weeks` weeks before."""
    return df.agg(F.max(date).alias("last_date")).withColumn("cutoff", F.date_sub("last_date", 7 * weeks))


def conform_forecasts(df: DataFrame) -> DataFrame:
    """Older column names (type, quantile) renamed, a missing output type set, columns typed and ordered; other columns follow."""
    for old, new in (("type", "output_type"), ("quantile", "output_type_id")):
        if old in df.columns and new not in df.columns:
            df = df.withColumnRenamed(old, new)
    if "output_type" not in df.columns:
        df = df.withColumn("output_type", F.lit("quantile"))
    typed = [F.col(c).try_cast(t).alias(c) for c, t in zip(FORECAST, _FORECAST_TYPES, strict=True)]
    return df.select(*typed, *(c for c in df.columns if c not in FORECAST))


def newest_run(df: DataFrame, run: str = "run", keys: Sequence[str] = ("model", "h", "reference_date", "target_end_date", "location", "output_type_id")) -> DataFrame:
    """One row for each key: of the newest run."""
    w = Window.partitionBy(*keys).orderBy(F.desc_nulls_last(run))
    return df.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def read_forecasts(spark: SparkSession, root: str, models: Sequence[str] | None = None, horizons: Sequence[int] | None = None) -> DataFrame:
    """Forecasts of a table that write_forecasts() made; model and h are partitions, so only those asked for are read. Models that are absent are skipped."""
    df = conform_forecasts(spark.read.parquet(root))
    if models is not None:
        df = df.where(F.col("model").isin(list(models)))
    if horizons is not None:
        df = df.where(F.col("h").isin(list(horizons)))
    return newest_run(df) if "run" in df.columns else df


def write_panel(panel: DataFrame, root: str, as_of: str) -> None:
    """Adds or replaces one dated snapshot."""
    panel.withColumn("as_of", F.lit(as_of).cast("date")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("as_of").parquet(root)


def write_forecasts(fc: DataFrame, root: str) -> None:
    """Eight columns in fixed order, partitioned by model and h; Spark deals the rows of a partition to as many writers as their size asks for."""
    rows = fc.select(*FORECAST, "model", "h")
    rows.hint("rebalance", F.col("model"), F.col("h")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("model", "h").parquet(root)


def write_params(params: DataFrame, root: str) -> None:
    """One row for each (location, h), columns as in PARAMS; those that are missing are null."""
    fields = T.StructType.fromDDL(PARAMS).fields
    params.select(*((F.col(f.name) if f.name in params.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields)).write.mode("overwrite").parquet(root)


def read_params(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(PARAMS).parquet(root)


def validate_params(params: DataFrame, required: Sequence[str] = ("p", "ridge"), lags: str | None = "lags") -> DataFrame:
    """(location, problem): a row for each missing key of the map `params`, and for lags below 1."""
    missing = params.select("location", F.explode(F.array_except(F.array(*map(F.lit, required)), F.coalesce(F.map_keys("params"), F.array().cast("array<string>")))).alias("k"))
    out = missing.select("location", F.concat(F.lit("missing: "), F.col("k")).alias("problem"))
    if lags and lags in params.columns:
        low = params.where(F.exists(lags, lambda x: x < 1)).select("location", F.lit("lag below 1").alias("problem"))
        out = out.unionByName(low)
    return out


def list_configurations(spark: SparkSession, root: str, pattern: str = r"([^/]+)/[^/]*_h(\d+)[^/]*$", horizons: Sequence[int] | None = None) -> DataFrame:
    """(folder, h) told by the names of the files below root; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path")
    rows = files.select(F.regexp_extract("path", pattern, 1).alias("folder"), F.regexp_extract("path", pattern, 2).alias("h")).where("h != ''")
    rows = rows.select("folder", F.col("h").cast("int").alias("h")).distinct()
    return rows if horizons is None else rows.where(F.col("h").isin(list(horizons)))
