"""Gap-free panels: calendars, interpolation, stitching of feeds, backfill by regression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewell.functions.calendar import shift_weeks
from tidewell.functions.numeric import count_of
from tidewell.operators.aggregates import fit_lm, predict_lm


def complete_weekly(df: DataFrame, bounds: str = "series", key: str = "location", date: str = "date") -> DataFrame:
    """Every seventh day from a series' first to its last date (bounds='series'), or from the table's (bounds='global'); missing values are null. Repeated
    (key, date) rows stay."""
    if bounds == "series":  # each row with the weeks up to the next one: df is read once
        w = Window.partitionBy(key).orderBy(date)
        rows = df.where(F.col(date).isNotNull()).withColumn("__first", F.min(date).over(w)).where(F.pmod(F.datediff(date, "__first"), F.lit(7)) == 0)
        last = F.greatest(F.coalesce(F.date_sub(F.lead(date).over(w), 7), F.col(date)), F.col(date))
        rows = rows.withColumn("__last", last).select("*", F.posexplode(F.sequence(F.col(date), F.col("__last"), F.expr("interval 7 days"))).alias("__k", "__d"))
        return rows.select(key, F.col("__d").alias(date), *(F.when(F.col("__k") == 0, F.col(c)).alias(c) for c in df.columns if c not in (key, date)))
    ends = df.groupBy(key).agg(F.min(date).alias("lo"))
    whole = df.agg(F.min(date).alias("lo"), F.max(date).alias("hi"))
    ends = ends.where("lo is not null").select(key).crossJoin(F.broadcast(whole))  # one row
    grid = ends.select(key, F.explode(F.sequence("lo", "hi", F.expr("interval 7 days"))).alias(date))
    return grid.join(df, [key, date], "left")


def _known(cond: Column, value: Column, w: Window, ahead: bool) -> Column:
    picked = F.when(cond, value)
    if ahead:
        return F.first(picked, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    return F.last(picked, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))


def interpolate(df: DataFrame, method: str = "linear", clamp: float | None = None, y: str = "y", key: str = "location", date: str = "date") -> DataFrame:
    """Fills gaps between known values of a series by date; nothing before the first or after the last. `linear`, or `cubic`: through two known values on
    each side, linear where there is only one. `clamp`: least value of what is filled or known."""
    w = Window.partitionBy(key).orderBy(date)
    d = F.datediff(F.col(date), F.lit("1970-01-01").cast("date")).cast("double")
    known = F.col(y).isNotNull()
    point = F.struct(d.alias("x"), F.col(y).cast("double").alias("v"))
    df = df.withColumn("__p1", _known(known, point, w, False)).withColumn("__n1", _known(known, point, w, True))
    x = d

    def lagrange(points: list[Column]) -> Column:
        out = None
        for i, p in enumerate(points):
            term = p["v"]
            for j, q in enumerate(points):
                if i != j:
                    term = term * (x - q["x"]) / (p["x"] - q["x"])
            out = term if out is None else out + term
        return out

    p1, n1 = F.col("__p1"), F.col("__n1")
    value = p1["v"] + (n1["v"] - p1["v"]) * (x - p1["x"]) / (n1["x"] - p1["x"])
    extra: list[str] = []
    if method == "cubic":
        # the known value before (after) a known one, carried to the rows of the gap behind (ahead of) it
        df = df.withColumn("__p2", _known(known, p1, w, False)).withColumn("__n2", _known(known, n1, w, True))
        p2, n2 = F.col("__p2"), F.col("__n2")
        value = F.when(p2.isNotNull() & n2.isNotNull(), lagrange([p2, p1, n1, n2])).otherwise(value)
        extra = ["__p2", "__n2"]
    elif method != "linear":
        raise ValueError(method)
    filled = F.coalesce(F.col(y).cast("double"), F.when(p1.isNotNull() & n1.isNotNull(), value))
    if clamp is not None:
        filled = F.when(filled.isNotNull(), F.greatest(filled, F.lit(float(clamp))))
    return df.withColumn(y, filled).drop("__p1", "__n1", *extra)


def fill_down(df: DataFrame, cols, key: str = "location", date: str = "date") -> DataFrame:
    """The last known value of the same series; what lies before it stays null."""
    w = Window.partitionBy(key).orderBy(date).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in cols})


def backfill_history(rate: DataFrame, predictor: DataFrame, shift_days: int = 728, key: str = "location", date: str = "date") -> DataFrame:
    """Regresses rate.y (a log rate) on predictor.x over the dates and locations of both, predicts max(0, round(exp(...) - 1, 2)) for the whole predictor history and
    shifts it by whole weeks: (location, date, pred)."""
    model = fit_lm(rate.join(predictor, [key, date]).dropna(subset=["y", "x"]), "y", "x")
    return predict_lm(predictor, model, "x", "exp-1").select(key, shift_weeks(F.col(date), shift_days // 7).alias(date), "pred")


def stitch(modelled: DataFrame, truth: DataFrame, share: DataFrame, population: DataFrame, recent: DataFrame, cut, prefer: str = "modelled", key: str = "location", date: str = "date") -> DataFrame:
    """One gap-free panel: modelled rates (pred), observed rates (obs), shares (share, 1 where unknown), population and recent counts (total).

    Rates are joined by (location, date); the preferred one counts where both are known; times population and share, in whole counts, before `cut`;
    recent counts follow from `cut` on; weeks are completed and inner gaps filled by cubics, none below 0.
    """
    first, second = ("pred", "obs") if prefer == "modelled" else ("obs", "pred")
    rates = modelled.join(truth, [key, date], "full").join(share, [key, date], "left").join(population, key)
    rate = F.coalesce(F.col(first), F.col(second))
    early = rates.where(F.col(date) < F.lit(cut).cast("date")).select(key, date, (count_of(rate, F.col("population")) * F.coalesce("share", F.lit(1.0))).alias("total"))
    late = recent.where(F.col(date) >= F.lit(cut).cast("date")).select(key, date, F.col("total").cast("double").alias("total"))
    return interpolate(complete_weekly(early.unionByName(late), key=key, date=date), "cubic", 0.0, "total", key, date)
