"""Joins of feeds, dimensions, forecasts and truth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def full_merge(a: DataFrame, b: DataFrame, on) -> DataFrame:
    return a.join(b, on, "full")


def append_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of both; columns that one lacks are null there."""
    return a.unionByName(b, allowMissingColumns=True)


def attach_population(df: DataFrame, dim: DataFrame, key: str = "location") -> DataFrame:
    """Inner join: rows of unknown locations go."""
    return df.join(dim, key)


def attach_truth(fc: DataFrame, truth: DataFrame, key: str = "location", date: str = "date", y: str = "y") -> DataFrame:
    """Adds `obs`, the value at the target date; forecasts without one go."""
    seen = truth.where(F.col(y).isNotNull()).select(F.col(key), F.col(date).alias("target_end_date"), F.col(y).alias("obs"))
    return fc.join(seen, [key, "target_end_date"])


def common_keys(scores: DataFrame, keys=("location", "target_end_date"), by: str = "h", model: str = "model") -> DataFrame:
    """Scores of those keys for which every model of their group has one."""
    total = scores.groupBy(by).agg(F.countDistinct(model).alias("__n"))
    each = scores.groupBy(by, *keys).agg(F.countDistinct(model).alias("__n"))
    return scores.join(each.join(total, [by, "__n"]), [by, *keys], "left_semi")


def label_at_horizon(df: DataFrame, horizons=(1, 2, 3, 4), key: str = "location", date: str = "date", y: str = "y") -> DataFrame:
    """For each row and h the value 7 h days later (`label`, at `label_date`); rows without one go. By date, so gaps do no harm."""
    ahead = df.select("*", F.explode(F.array(*map(F.lit, horizons))).alias("h")).withColumn("label_date", F.date_add(date, F.col("h") * 7))
    later = df.where(F.col(y).isNotNull()).select(F.col(key), F.col(date).alias("label_date"), F.col(y).alias("label"))
    return ahead.join(later, [key, "label_date"])


def row_as_of(df: DataFrame, anchors: DataFrame, key: str = "location", date: str = "date") -> DataFrame:
    """For each (key, anchor) the latest row at or before the anchor, as column `row`; anchors before the first row go. Rows and anchors of a key are put in one order, in which each anchor
    takes the last row before it: as much work as there are rows and anchors, not their product."""
    rows = df.where(F.col(date).isNotNull()).select(F.col(key), F.col(date).alias("__d"), F.lit(0).alias("__kind"), F.struct(*df.columns).alias("row"))
    asked = anchors.where(F.col("anchor").isNotNull()).select(F.col(key), F.col("anchor").alias("__d"), F.lit(1).alias("__kind"), F.lit(None).cast(rows.schema["row"].dataType).alias("row"))
    w = Window.partitionBy(key).orderBy("__d", "__kind").rowsBetween(Window.unboundedPreceding, 0)
    found = rows.unionByName(asked).withColumn("row", F.last("row", ignorenulls=True).over(w)).where((F.col("__kind") == 1) & F.col("row").isNotNull() & F.col(key).isNotNull())
    return found.groupBy(key, F.col("__d").alias("anchor")).agg(F.first("row").alias("row"))


def covariate_join(df: DataFrame, selected: DataFrame | None = None, key: str = "location", date: str = "date", y: str = "y") -> DataFrame:
    """(target, covariate, date, y, x): the values of other locations on the same date; of the selected (target, covariate) pairs only, if given. Pairs
    of all locations are as many as locations squared; give `selected` where that is too many."""
    a = df.select(F.col(key).alias("target"), F.col(date), F.col(y).alias("y"))
    b = df.select(F.col(key).alias("covariate"), F.col(date), F.col(y).alias("x"))
    if selected is not None:
        return a.join(selected.select("target", "covariate"), "target").join(b, ["covariate", date])
    return a.join(b, date).where(F.col("target") != F.col("covariate"))


def offset_differences(df: DataFrame, h: int, key: str = "location", date: str = "date", y: str = "y") -> DataFrame:
    """`diff`: the value less that 7 h days before."""
    before = df.select(F.col(key), F.date_add(date, 7 * h).alias(date), F.col(y).alias("__b"))
    return df.join(before, [key, date]).withColumn("diff", F.col(y) - F.col("__b")).drop("__b")
