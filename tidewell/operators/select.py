"""Filters, labels and splits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewell.functions.numeric import LEVELS


def filter_strata(df: DataFrame, **equals) -> DataFrame:
    return reduce(lambda d, kv: d.where(F.col(kv[0]) == kv[1]), equals.items(), df)


def exclude_locations(df: DataFrame, names, key: str = "location") -> DataFrame:
    """Rows of other locations; those without a location stay."""
    return df.where(~F.coalesce(F.col(key).isin(list(names)), F.lit(False)))


def normalise_label(df: DataFrame, col: str, mapping: dict[str, str]) -> DataFrame:
    """Whole labels are replaced by the mapping; others stay."""
    table = F.create_map(*(F.lit(x) for kv in mapping.items() for x in kv))
    return df.withColumn(col, F.coalesce(table[F.col(col)], F.col(col)))


def map_code(df: DataFrame, dim: DataFrame, key: str = "location", name: str = "location_name", code: str = "location_code", keep_unknown: bool = True, drop_unknown: bool = False) -> DataFrame:
    """Adds `code` from a dimension (name, code); an unknown name keeps itself or gives null, or its rows go (drop_unknown). The join is left to Spark, which broadcasts a small dimension by its size."""
    small = dim.select(F.col(name).alias(key), F.col(code).alias(code))
    if drop_unknown:
        return df.join(small, key).where(F.col(code).isNotNull())
    out = df.join(small, key, "left")
    return out.withColumn(code, F.coalesce(F.col(code), F.col(key))) if keep_unknown else out


def drop_na(df: DataFrame, *cols: str) -> DataFrame:
    return df.dropna(subset=list(cols) or None)


def as_of(df: DataFrame, day, date: str = "date") -> DataFrame:
    return df.where(F.col(date) <= F.lit(day).cast("date"))


def split_at(df: DataFrame, cutoff, inclusive: bool = True, date: str = "date") -> DataFrame:
    """Adds `split`: train up to the cut-off (with it, or before it), test after."""
    day = F.lit(cutoff).cast("date")
    train = F.col(date) <= day if inclusive else F.col(date) < day
    return df.withColumn("split", F.when(train, "train").otherwise("test"))


def split_half(df: DataFrame, key: str = "location", date: str = "date") -> DataFrame:
    """Adds `half`: the first n // 2 rows of each series by date are 1, the rest 2."""
    w = Window.partitionBy(key)
    return df.withColumn("half", F.when(F.row_number().over(w.orderBy(date)) <= F.floor(F.count("*").over(w) / 2), 1).otherwise(2))


def min_history(df: DataFrame, n: int, key: str = "location") -> DataFrame:
    """Series with n rows or more. Counts join the rows, so a long series isn't gathered in one task."""
    enough = df.groupBy(key).count().where(F.col("count") >= n).select(key)
    return df.join(enough, key, "left_semi")


def clamp_nonneg(df: DataFrame, cols) -> DataFrame:
    return df.withColumns({c: F.greatest(F.lit(0.0), F.col(c)) for c in cols})


def complete_case_dates(df: DataFrame, key: str = "location", date: str = "date", y: str = "y") -> DataFrame:
    """Rows of the dates on which every location of the table has a value."""
    full = df.where(F.col(y).isNotNull()).groupBy(date).agg(F.countDistinct(key).alias("n"))
    total = df.agg(F.countDistinct(key).alias("n"))
    return df.join(full.join(F.broadcast(total), "n").select(date), date, "left_semi")  # total: one row


def format_forecast(df: DataFrame, target: str = "wk inc", levels=LEVELS, quantiles: str = "quantiles", code: str | Column = "location") -> DataFrame:
    """The eight forecast columns, a row for each level, from rows (location, reference_date, h, quantiles)."""
    rows = df.select("*", F.posexplode(quantiles).alias("__at", "__value"))
    table = F.array(*map(F.lit, levels))
    return rows.select(
        "reference_date",
        (F.col("h") - 1).cast("int").alias("horizon"),
        F.lit(target).alias("target"),
        F.date_add("reference_date", (F.col("h") * 7).cast("int")).alias("target_end_date"),
        (F.col(code) if isinstance(code, str) else code).alias("location"),
        F.lit("quantile").alias("output_type"),
        F.get(table, F.col("__at")).alias("output_type_id"),
        F.greatest(F.lit(0.0), F.col("__value")).alias("value"),
    )


def keep_models(df: DataFrame, names) -> DataFrame:
    return df.where(F.col("model").isin(list(names)))


def future_only(fc: DataFrame, panel: DataFrame, key: str = "location", date: str = "date") -> DataFrame:
    """Forecast rows whose target lies after the last date of their location in the panel."""
    last = panel.groupBy(key).agg(F.max(date).alias("__last"))
    return fc.join(last, key).where(F.col("target_end_date") > F.col("__last")).drop("__last")


def first_dates(df: DataFrame, n: int, key: str = "location", date: str = "date") -> DataFrame:
    """The first n dates of each series."""
    return df.withColumn("__r", F.dense_rank().over(Window.partitionBy(key).orderBy(date))).where(F.col("__r") <= n).drop("__r")


def even_subsample(df: DataFrame, k: int, key: str = "location", date: str = "date") -> DataFrame:
    """At most k rows of each series, evenly spread from the first to the last (k >= 2)."""
    w = Window.partitionBy(key)
    rows = df.withColumn("__i", F.row_number().over(w.orderBy(date)) - 1).withColumn("__n", F.count("*").over(w))
    picks = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.floor(i * (F.col("__n") - 1) / F.lit(float(k - 1))).cast("int"))
    return rows.where((F.col("__n") <= k) | F.array_contains(picks, F.col("__i"))).drop("__i", "__n")
