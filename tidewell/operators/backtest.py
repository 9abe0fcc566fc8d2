"""Rolling-origin evaluation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewell.operators.aggregates import availability
from tidewell.operators.features import gap_check
from tidewell.operators.joins import label_at_horizon


def rolling_folds(df: DataFrame, min_train: int = 100, horizon: int = 1, step: int = 1, n_splits: int | None = None, key: str = "location") -> DataFrame:
    """(key, fold, train_rows, test_start, test_end): fold k trains on the first train_rows rows of a series by date and tests on rows test_start up to, not with,
    test_end (from 0). With n_splits the folds are evenly spaced and no more than that. Series that are too short have none."""
    sizes = df.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > min_train + horizon)
    width = F.greatest(F.lit(1), F.floor((F.col("n") - min_train - horizon) / n_splits).cast("int")) if n_splits else F.lit(step)
    rows = sizes.select(key, F.posexplode(F.sequence(F.lit(min_train), (F.col("n") - horizon).cast("int"), width)).alias("fold", "train_rows"))
    if n_splits:
        rows = rows.where(F.col("fold") < n_splits)
    return rows.select(key, "fold", "train_rows", F.col("train_rows").alias("test_start"), (F.col("train_rows") + horizon).alias("test_end"))


def fold_rows(df: DataFrame, folds: DataFrame, key: str = "location", date: str = "date") -> DataFrame:
    """The test rows of each fold, with `fold` and `train_rows`; a row is in as many folds as the horizon at most for steps of 1."""
    numbered = df.withColumn("__i", F.row_number().over(Window.partitionBy(key).orderBy(date)) - 1)
    tests = folds.select(key, "fold", "train_rows", F.explode(F.sequence("test_start", F.col("test_end") - 1)).alias("__i"))
    return numbered.join(tests, [key, "__i"]).drop("__i")


def anchors(df: DataFrame, horizon: int, start=None, key: str = "location", date: str = "date", y: str = "y") -> DataFrame:
    """(key, anchor, h, label_date, label): dates of the second half of each series, or from `start` on, whose target exists."""
    rows = df.where(F.col(y).isNotNull())
    if start is None:
        w = Window.partitionBy(key)
        rows = rows.withColumn("__r", F.row_number().over(w.orderBy(date))).withColumn("__n", F.count("*").over(w)).where(F.col("__r") > F.floor(F.col("__n") / 2))
    else:
        rows = rows.where(F.col(date) >= F.lit(start).cast("date"))
    ahead = rows.select(F.col(key), F.col(date).alias("anchor"), F.lit(horizon).alias("h"), F.date_add(date, 7 * horizon).alias("label_date"))
    truth = df.where(F.col(y).isNotNull()).select(F.col(key), F.col(date).alias("label_date"), F.col(y).alias("label"))
    return ahead.join(truth, [key, "label_date"]).select(key, "anchor", "h", "label_date", "label")


def assemble(features: DataFrame, horizon: int, train_end=None, key: str = "location", date: str = "date", y: str = "y") -> DataFrame:
    """Feature rows with their label h weeks on. With train_end: those whose label was known by then (split `train`), and later anchors (`test`); anchors up to
    train_end with later labels belong to neither, so nothing is learnt from after it."""
    rows = label_at_horizon(features, (horizon,), key, date, y)
    if train_end is None:
        return rows
    end = F.lit(train_end).cast("date")
    return rows.withColumn("split", F.when(F.col("label_date") <= end, "train").when(F.col(date) > end, "test")).where("split is not null")


def panel_checks(df: DataFrame, key: str = "location", date: str = "date", y: str = "y") -> dict[str, DataFrame]:
    return {"gaps": gap_check(df, key, date), "availability": availability(df, key, date, y)}


def half_anchors_sample(df: DataFrame, k: int = 30, horizons: Sequence[int] = (1,), key: str = "location", date: str = "date", y: str = "y") -> DataFrame:
    """anchors() of each horizon, thinned evenly to k for each series."""
    from tidewell.operators.select import even_subsample

    out = None
    for h in horizons:
        one = even_subsample(anchors(df, h, key=key, date=date, y=y), k, key, "anchor")
        out = one if out is None else out.unionByName(one)
    return out
