"""The best covariates of every series without a row for each pair of series: cross-products of blocks."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Series of a block, and days of a piece of their history.
BLOCK, DAYS = 128, 7 * 512

_NAMES = ("n", "x", "y", "xx", "yy", "xy")


class _Sums:
    """Running cross-products of the series of two blocks: for each pair, over the dates both have, the count and the sums of x, y, x^2, y^2 and xy."""

    def __init__(self):
        self.left, self.right, self.means = {}, {}, {}
        self.sums = np.zeros((len(_NAMES), 0, 0))

    def add(self, rows: list) -> None:
        """One piece of history: rows (side, name, days, values, mean); side 0 is left, 1 right, 2 both."""
        days = np.unique(np.concatenate([r[2] for r in rows]))

        def matrix(sides: tuple[int, int], place: dict) -> tuple[np.ndarray, np.ndarray]:
            own = [r for r in rows if r[0] in sides]
            for r in own:
                place.setdefault(r[1], len(place))
                self.means[r[1]] = r[4]
            values, seen = np.zeros((len(place), len(days))), np.zeros((len(place), len(days)))
            for r in own:
                at = np.searchsorted(days, r[2])
                values[place[r[1]], at], seen[place[r[1]], at] = r[3], 1.0
            return values, seen

        (x, mx), (y, my) = matrix((0, 2), self.left), matrix((1, 2), self.right)
        more = [(0, 0), (0, len(x) - self.sums.shape[1]), (0, len(y) - self.sums.shape[2])]
        self.sums = np.pad(self.sums, more) + np.stack([mx @ my.T, x @ my.T, mx @ y.T, (x * x) @ my.T, mx @ (y * y).T, x @ y.T])

    def best(self, k: int) -> Iterator[pd.DataFrame]:
        """(target, covariate, score) of the best k of this pair of blocks, for the targets of either side."""
        if not self.left or not self.right:
            return
        n, x, y, xx, yy, xy = self.sums
        left, right = np.array(list(self.left), object), np.array(list(self.right), object)
        with np.errstate(divide="ignore", invalid="ignore"):
            vx, vy, cov = xx / n - (x / n) ** 2, yy / n - (y / n) ** 2, xy / n - x * y / n / n
            flat = [v <= np.maximum(1e-13 * s / n, 1e-20 * (1 + m * m)) for v, s, m in ((vx, xx, np.array([self.means[a] for a in left])[:, None]), (vy, yy, np.array([self.means[a] for a in right])[None]))]
            score = np.where(flat[0] | flat[1], np.nan, np.round(np.abs(cov) / np.sqrt(np.maximum(vx, 0) * np.maximum(vy, 0)), 9))
        met = n > 0
        if self.left == self.right:
            met = met & ~np.eye(len(left), dtype=bool)
            sides = ((left, right, score, met),)
        else:
            sides = ((left, right, score, met), (right, left, score.T, met.T))
        for targets, others, s, fine in sides:
            turn = np.argsort(others.astype(str), kind="stable")
            s, fine, others = s[:, turn], fine[:, turn], others[turn]
            order = np.argsort(np.where(fine, np.where(np.isnan(s), 1.0, -s), 2.0), axis=1, kind="stable")[:, :k]  # without a score after all with one
            row = np.repeat(np.arange(len(targets)), order.shape[1])
            col = order.ravel()
            keep = fine[row, col]
            yield pd.DataFrame({"target": targets[row[keep]], "covariate": others[col[keep]], "score": s[row[keep], col[keep]]})


def top_covariates(df: DataFrame, k: int = 3, block: int = BLOCK, days: int = DAYS, key: str = "location", date: str = "date", y: str = "y") -> DataFrame:
    """(target, covariate, score, rank): for each series the k others of greatest absolute correlation with it over the dates both have; of equal scores (to nine digits) the first
    by name; series without variation have no score and come last. The rows of rank_covariates() on all pairs, which are never made.

    Series are dealt to blocks of about `block`, and each pair of blocks is one task's work: matrix products of pieces of `days` days, added up, of which only the best k for
    each series leave the task. A block's pieces go to every other block: what is shuffled is the panel times the number of blocks; a task holds one piece of two blocks and the
    sums of their pairs. Rows without y or key play no part.
    """
    rows = df.where(F.col(y).isNotNull() & F.col(key).isNotNull()).select(F.col(key).cast("string").alias("name"), F.unix_date(F.col(date).cast("date")).alias("day"), F.col(y).cast("double").alias("v"))
    blocks = math.ceil(rows.select("name").distinct().count() / block) or 1
    rows = rows.repartition("name").withColumn("piece", F.floor(F.col("day") / days))
    cells = rows.groupBy("name", "piece").agg(F.collect_list(F.struct("day", "v")).alias("cells"), F.sum("v").alias("s"), F.count("v").alias("c"))
    w = Window.partitionBy("name")
    cells = cells.select("name", "piece", F.col("cells.day").alias("day"), F.col("cells.v").alias("v"), (F.sum("s").over(w) / F.sum("c").over(w)).alias("mean"), F.pmod(F.xxhash64("name"), F.lit(blocks)).alias("own"))
    each = cells.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<long>")))
    side = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1)
    pairs = each.select(F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "piece", side.alias("side"), "name", "day", "v", "mean")
    pairs = pairs.repartition("a", "b").sortWithinPartitions("a", "b", "piece")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pair, piece, held, sums = None, None, [], _Sums()
        for batch in batches:
            for a, b, p, side, name, day, v, mean in zip(batch.a, batch.b, batch.piece, batch.side, batch.name_, batch.day, batch.v, batch["mean"], strict=True):
                if held and (pair, piece) != ((a, b), p):
                    sums.add(held)
                    held = []
                if pair is not None and pair != (a, b):
                    yield from sums.best(k)
                    sums = _Sums()
                pair, piece = (a, b), p
                held.append((side, name, day, np.asarray(v) - mean, mean))
        if held:
            sums.add(held)
            yield from sums.best(k)

    found = pairs.withColumnRenamed("name", "name_").mapInPandas(run, "target string, covariate string, score double")
    score = F.when(~F.isnan("score"), F.col("score"))
    rank = F.row_number().over(Window.partitionBy("target").orderBy(F.desc_nulls_last("score"), "covariate"))
    return found.withColumn("score", score).withColumn("rank", rank).where(F.col("rank") <= k)


def with_top_covariates(df: DataFrame, k: int = 3, key: str = "location", date: str = "date", y: str = "y") -> DataFrame:
    """df with x1 to xk, the values of each series' best covariates on the same date; 0 where there is none."""
    from tidewell.operators.models import with_covariates

    return with_covariates(df, top_covariates(df, k, key=key, date=date, y=y), k, key, date, y)

