"""Models of all series together, fitted at several cut-off dates: boosted trees for the location, trees or a line for the scale around it, and what their features are worth.

Features are cut into bins once, on the rows up to the first cut-off, and stored with the labels of all horizons; every fit reads that table. A series enters by its mean so far, not by its
number, so the histograms of the trees do not grow with the number of series.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewell.functions.numeric import gaussian_array, z_values
from tidewell.operators.features import series
from tidewell.operators.models import HORIZONS
from tidewell.sources.tables import stored

#: The mean log of a chi-square of one degree of freedom is -LOG_CHI.
LOG_CHI = 1.2704


def binned(df: DataFrame, features: Sequence[str], cutoff, horizons: Sequence[int] = HORIZONS, bins: int = 32, log: bool = False, key: str = "location", date: str = "date", y: str = "y") -> DataFrame:
    """(location, date, last, x, labels): x has the bin of each feature and of the series' mean of y so far, by quantiles of the rows up to `cutoff`; labels has (h, date, y) of the rows h further
    on, where the calendar has no gap up to them. `log`: labels on log(1 + y)."""
    from pyspark.ml.feature import Bucketizer, VectorAssembler

    w = series(key, date)
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    ahead = [F.when(F.lead(date, h).over(w) == F.date_add(date, 7 * h), F.struct(F.lit(h).alias("h"), F.lead(date, h).over(w).alias("date"), F.lead(y, h).over(w).alias("y"))) for h in horizons]
    names = [f"__f{k}" for k in range(len(features) + 1)]
    values = [*(F.col(f).cast("double") for f in features), F.avg(y).over(so_far)]
    rows = df.select(F.col(key).alias("location"), F.col(date).alias("date"), F.col(y).cast("double").alias("last"), F.array(*ahead).alias("labels"), *(F.coalesce(v, F.lit(0.0)).alias(n) for v, n in zip(values, names, strict=True)))
    rows = stored(rows, "features")
    cuts = rows.where(F.col("date") <= F.lit(cutoff).cast("date")).approxQuantile(names, [k / bins for k in range(1, bins)], 0.001)  # bins numbers for each feature come to the driver
    splits = [[float("-inf"), *sorted(set(c)), float("inf")] if c else [float("-inf"), 0.0, float("inf")] for c in cuts]
    cut = Bucketizer(splitsArray=splits, inputCols=names, outputCols=[f"{n}b" for n in names], handleInvalid="keep").transform(rows)
    out = VectorAssembler(inputCols=[f"{n}b" for n in names], outputCol="x").transform(cut).select("location", "date", "last", "x", "labels")
    if log:
        out = out.withColumn("labels", F.transform("labels", lambda r: F.when(r.isNotNull(), F.struct(r["h"].alias("h"), r["date"].alias("date"), F.log1p(F.greatest(r["y"], F.lit(0.0))).alias("y")))))
    return stored(out, "binned")


def _trees(label: str, out: str, bins: int, trees: int, depth: int, seed: int):
    from pyspark.ml.regression import GBTRegressor

    return GBTRegressor(featuresCol="x", labelCol=label, predictionCol=out, maxBins=bins + 2, maxIter=trees, maxDepth=depth, seed=seed)


def _scale_model(kind: str, rows: DataFrame, bins: int, trees: int, depth: int, seed: int):
    """A model of the log squared errors of rows (x, label, mu): column `v`."""
    from pyspark.ml.regression import LinearRegression

    e = F.col("label") - F.col("mu")
    rows = rows.withColumn("e", F.ln(e * e + 1e-6)).drop("mu")
    model = _trees("e", "v", bins, trees, depth, seed) if kind == "trees" else LinearRegression(featuresCol="x", labelCol="e", predictionCol="v", regParam=0.1)
    return model.fit(rows)


def forecast_pooled(df: DataFrame, features: Sequence[str], cutoffs: Sequence, horizons: Sequence[int] = HORIZONS, scale: str | None = None, log: bool = False, trees: int = 20, depth: int = 4, bins: int = 32, seed: int = 1, key: str = "location", date: str = "date", y: str = "y") -> DataFrame:
    """(location, reference_date, h, fold, cutoff, mu, label, and with `scale` sigma and quantiles) for the anchors from each cut-off up to, not with, the next: boosted trees of all series for y
    at h weeks, fitted at each cut-off on labels known by then. label: what came, null if it isn't there yet.

    scale ('linear' or 'trees'): a model of the log squared errors that trees fitted on the first two thirds of those dates make on the rest, so errors are of rows they haven't seen.
    `log`: both models on log(1 + y). Then quantiles are those of the normal on that scale carried back, and mu and sigma the mean and deviation of what is carried back. A cut-off
    before which no label is known has no forecasts.
    """
    if scale not in (None, "linear", "trees"):
        raise ValueError(scale)
    ends = sorted(str(c) for c in cutoffs)
    table = binned(df, features, ends[0], horizons, bins, log, key, date, y)
    out = None
    for k, h in enumerate(horizons):
        one = F.get("labels", F.lit(k))
        rows = table.select("location", "date", "last", "x", one["y"].alias("label"), one["date"].alias("label_date"))
        for fold, (cutoff, after) in enumerate(zip(ends, [*ends[1:], None], strict=True)):
            known = rows.where((F.col("label_date") <= F.lit(cutoff).cast("date")) & F.col("label").isNotNull())
            first, last = known.agg(F.min("date"), F.max("date")).first()
            if first is None:
                continue
            tests = rows.where(F.col("date") >= F.lit(cutoff).cast("date"))
            tests = tests.where(F.col("date") < F.lit(after).cast("date")) if after else tests
            made = _trees("label", "mu", bins, trees, depth, seed).fit(known).transform(tests)
            if scale:
                inner = first + (last - first) * 2 / 3
                early = _trees("label", "mu", bins, trees, depth, seed).fit(known.where(F.col("label_date") <= F.lit(inner).cast("date")))
                unseen = early.transform(known.where(F.col("date") > F.lit(inner).cast("date")))
                model = _scale_model(scale, unseen, bins, max(3, trees // 4), min(depth, 3), seed)
                made = model.transform(made).withColumn("sigma", F.greatest(F.exp((F.least("v", F.lit(60.0)) + LOG_CHI) / 2), F.lit(1e-6))).drop("v")
            made = made.select("location", F.col("date").alias("reference_date"), F.lit(h).alias("h"), F.lit(fold).alias("fold"), F.lit(cutoff).cast("date").alias("cutoff"), "mu", "label", *(["sigma"] if scale else []))
            out = made if out is None else out.unionByName(made)
    if out is None:
        raise ValueError("no label is known by the last cut-off")
    return _carried_back(out, scale, log)


def _carried_back(rows: DataFrame, scale: str | None, log: bool) -> DataFrame:
    mu, label = F.col("mu"), F.col("label")
    if not log:
        rows = rows.withColumn("mu", F.greatest(mu, F.lit(0.0)))
        return rows.withColumn("quantiles", gaussian_array(F.col("mu"), F.col("sigma"))) if scale else rows
    back = {"label": F.expm1(label)}
    if scale:
        s = F.least(F.col("sigma"), F.lit(5.0))
        back["quantiles"] = F.array(*(F.greatest(F.expm1(mu + s * z), F.lit(0.0)) for z in z_values()))
        back["sigma"] = F.exp(mu + s * s / 2) * F.sqrt(F.expm1(s * s))
        back["mu"] = F.greatest(F.exp(mu + s * s / 2) - 1, F.lit(0.0))
    else:
        back["mu"] = F.greatest(F.expm1(mu), F.lit(0.0))
    return rows.withColumns(back)


def fold_errors(fc: DataFrame, last: DataFrame | None = None, key: str = "location", date: str = "date", y: str = "y") -> DataFrame:
    """(h, fold, n, mae, mae_last) of forecast_pooled() rows whose label came; mae_last is that of the value at the anchor, of the panel `last`."""
    rows = fc.where(F.col("label").isNotNull())
    error = [F.avg(F.abs(F.col("label") - F.col("mu"))).alias("mae")]
    if last is not None:
        rows = rows.join(last.select(F.col(key).alias("location"), F.col(date).alias("reference_date"), F.col(y).alias("last")), ["location", "reference_date"])
        error.append(F.avg(F.abs(F.col("label") - F.col("last"))).alias("mae_last"))
    return rows.groupBy("h", "fold").agg(F.count("*").alias("n"), *error)


# ---------------------------------------------------------------------------------------------- worth of features


def shuffled(df: DataFrame, columns: Sequence[str], seed: int = 1, key: str = "location", date: str = "date") -> DataFrame:
    """Adds <column>_moved: inside each series, the column's value in the row that follows in the order of a hash of the date (the first row's after the last): a permutation that is the same on
    every run."""
    day = F.datediff(F.col(date).cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    w = Window.partitionBy(key).orderBy(F.pmod(day * (2_654_435_761 + 2 * seed), F.lit(4_294_967_296)), date)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    last = F.row_number().over(w) == F.count("*").over(Window.partitionBy(key))
    return df.withColumns({f"{c}_moved": F.when(last, F.first(c).over(whole)).otherwise(F.lead(c).over(w)) for c in columns})


def permutation_importance(df: DataFrame, features: Sequence[str], predict: Callable[[dict[str, Column]], Column], y: str = "y", by: Sequence[str] = ("location",), seed: int = 1, key: str = "location", date: str = "date") -> DataFrame:
    """(by, feature, importance, rank): how much the mean absolute error of a prediction grows when a feature's values change places inside their series. predict: the prediction, of
    the features' columns. All features are tried in one pass over the rows."""
    rows = shuffled(df, features, seed, key, date)
    own = {f: F.col(f) for f in features}
    base = F.abs(F.col(y) - predict(own))
    tried = [F.avg(F.abs(F.col(y) - predict(own | {f: F.col(f"{f}_moved")})) - base).alias(f"__i{k}") for k, f in enumerate(features)]
    means = rows.groupBy(*by).agg(*tried)
    long = means.select(*by, F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), F.round(f"__i{k}", 9).alias("importance")) for k, f in enumerate(features)))).alias("r")).select(*by, "r.*")
    return long.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc_nulls_last("importance"), "feature")))


def tree_importances(df: DataFrame, features: Sequence[str], h: int, cutoff, trees: int = 20, depth: int = 4, bins: int = 32, seed: int = 1, key: str = "location", date: str = "date", y: str = "y") -> DataFrame:
    """(feature, importance, rank) of the pooled trees for y at h weeks: each feature's share of the gain in all splits, the series' mean so far as `series_mean`."""
    table = binned(df, features, cutoff, (h,), bins, False, key, date, y)
    first = F.get("labels", F.lit(0))
    one = table.select("x", first["y"].alias("label"), first["date"].alias("label_date")).where((F.col("label_date") <= F.lit(cutoff).cast("date")) & F.col("label").isNotNull())
    shares = _trees("label", "mu", bins, trees, depth, seed).fit(one).featureImportances.toArray().tolist()
    rows = sorted(zip([*features, "series_mean"], shares, strict=True), key=lambda r: (-r[1], r[0]))
    return df.sparkSession.createDataFrame([(f, float(s), k + 1) for k, (f, s) in enumerate(rows)], "feature string, importance double, rank int")
