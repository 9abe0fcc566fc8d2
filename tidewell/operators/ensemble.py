"""Score-weighted ensembles and evaluation. Scores are rows (model, h, location, reference_date, target_end_date, wis)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewell.operators.aggregates import nearest_levels, weighted_mean
from tidewell.operators.joins import common_keys
from tidewell.operators.select import exclude_locations, future_only


def last_references(refs: DataFrame, as_of, lookback: int = 4, history: int = 8) -> DataFrame:
    """The last `lookback` of the last `history` distinct reference dates before as_of."""
    n = min(lookback, history)
    return refs.select("reference_date").where(F.col("reference_date") < F.lit(as_of).cast("date")).distinct().orderBy(F.desc("reference_date")).limit(n)


def ensemble_weights(scores: DataFrame, models: DataFrame, as_of, lookback: int = 4, history: int = 8, known_by_as_of: bool = True) -> DataFrame:
    """(h, model, weight): inverse mean score over the last reference dates, adding to one for each h. A model without a score has weight 0; where no model of
    models (h, model) has one, all are equal. Scores of targets after as_of do not count, unless known_by_as_of is off."""
    if known_by_as_of:
        scores = scores.where(F.col("target_end_date") <= F.lit(as_of).cast("date"))
    refs = last_references(scores, as_of, lookback, history)
    mean = scores.join(F.broadcast(refs), "reference_date", "left_semi").groupBy("h", "model").agg(F.avg("wis").alias("score"))  # refs: `lookback` rows
    w = Window.partitionBy("h")
    rows = models.join(mean, ["h", "model"], "left").withColumn("inv", F.when(F.col("score") > 0, 1 / F.col("score")))
    share = F.try_divide(F.coalesce(F.col("inv"), F.lit(0.0)), F.sum("inv").over(w))
    return rows.select("h", "model", F.coalesce(share, 1.0 / F.count("*").over(w)).alias("weight"))


def rolling_weights(scores: DataFrame, lookback: int = 4, known_by_as_of: bool = True, models: Sequence[str] | None = None) -> DataFrame:
    """(h, reference_date, model, weight) at every reference date, from the scores of the `lookback` reference dates before it. If any model has no score there, all are equal.
    known_by_as_of: the window ends h reference dates back (weekly ones), where the target is known; without it scores of targets that lie ahead count as well. Models: all that have
    a score anywhere, or those given."""
    if models is not None:
        scores = scores.where(F.col("model").isin(list(models)))
    per = scores.groupBy("h", "reference_date", "model").agg(F.sum("wis").alias("s"), F.count("wis").alias("n"))
    dates = scores.select("h", "reference_date").distinct().withColumn("place", F.dense_rank().over(Window.partitionBy("h").orderBy("reference_date")))
    named = F.array(*map(F.lit, models)) if models is not None else None
    if named is None:  # one row: an array of the names
        dates = dates.crossJoin(scores.agg(F.array_sort(F.collect_set("model")).alias("names")))
    cells = dates.select("h", "reference_date", "place", F.explode(F.col("names") if named is None else named).alias("model")).join(per, ["h", "reference_date", "model"], "left")
    # A score counts from the place on at which its target is known; frames are by place, so one frame serves all horizons and models with missing dates.
    given = cells.where("n > 0").select("h", "model", (F.col("place") + ((F.col("h") - 1) if known_by_as_of else 0)).cast("long").alias("place"), "s", "n", F.lit(None).cast("date").alias("reference_date"))
    asked = cells.select("h", "model", F.col("place").cast("long").alias("place"), F.lit(None).cast("double").alias("s"), F.lit(None).cast("long").alias("n"), "reference_date")
    frame = Window.partitionBy("h", "model").orderBy("place").rangeBetween(-lookback, -1)
    means = given.unionByName(asked).withColumn("inv", F.try_divide(F.sum("n").over(frame), F.sum("s").over(frame))).where(F.col("reference_date").isNotNull())
    all_models = Window.partitionBy("h", "reference_date")
    every = F.count("*").over(all_models)
    share = F.when(F.count("inv").over(all_models) == every, F.try_divide(F.col("inv"), F.sum("inv").over(all_models)))
    return means.select("h", "reference_date", "model", F.coalesce(share, 1.0 / every).alias("weight"))


def ensemble_combine(fc: DataFrame, weights: DataFrame, on: Sequence[str] = ("h", "model")) -> DataFrame:
    """Weighted mean of each level over the models of forecast rows in long form; the plain mean where no model has a weight above 0. `horizon` is h - 1."""
    by = ["h", "reference_date", "target", "target_end_date", "location", "output_type", "output_type_id"]
    rows = fc.join(weights, list(on), "left")
    return weighted_mean(rows, "value", "weight", by).withColumn("horizon", (F.col("h") - 1).cast("int")).withColumn("model", F.lit("ensemble"))


def evaluate(scores: DataFrame, baseline: str, since=None, drop: Sequence[str] = ()) -> DataFrame:
    """(h, model, geo_wis, relative_wis): geometric means over locations of mean scores on the keys that all models share; each h, and h null for all together;
    relative to the baseline of the same h."""
    if since is not None:
        scores = scores.where(F.col("target_end_date") >= F.lit(since).cast("date"))
    fair = common_keys(exclude_locations(scores, drop) if drop else scores)
    each = fair.groupBy("h", "model", "location").agg(F.sum("wis").alias("s"), F.count("wis").alias("n"))  # the only aggregate over all scores
    h, model, place = F.col("h"), F.col("model"), F.col("location")
    both = each.groupingSets([[h, model, place], [model, place]], h, model, place).agg(F.try_divide(F.sum("s"), F.sum("n")).alias("wis"))
    geo = both.groupBy("h", "model").agg(F.exp(F.avg(F.when(F.col("wis") > 0, F.ln("wis")))).alias("geo_wis"))
    base = F.max(F.when(F.col("model") == baseline, F.col("geo_wis"))).over(Window.partitionBy("h"))
    return geo.withColumn("relative_wis", F.try_divide("geo_wis", base))


BANDS = {"q01": 0.01, "q05": 0.05, "q25": 0.25, "median": 0.5, "q75": 0.75, "q95": 0.95, "q99": 0.99}


def fan_chart(fc: DataFrame, panel: DataFrame | None = None, by: Sequence[str] = ("location", "reference_date", "target_end_date")) -> DataFrame:
    """Bands of each forecast by nearest level, made monotone from the median outwards; of dates after the panel's last, if it is given."""
    rows = nearest_levels(fc, by, BANDS)
    for inner, outer in (("median", "q25"), ("q25", "q05"), ("q05", "q01")):
        rows = rows.withColumn(outer, F.least(outer, inner))
    for inner, outer in (("median", "q75"), ("q75", "q95"), ("q95", "q99")):
        rows = rows.withColumn(outer, F.greatest(outer, inner))
    return future_only(rows, panel) if panel is not None else rows
