"""Mixing sources to target weights by Pareto order sampling.

A source's target, in words, is its weighted share of the mixture, stopped at `most` times its size. A document gets as many whole copies as its source's
target holds whole passes over the source. What is missing then is a sample of fixed size with unequal probabilities: a document's inclusion probability is its size
times one factor of its source, chosen so that the expected words are those that are missing; documents for which that would be 1 or more are certain and get their copy
first, and the factor is that of the others. The others are ranked by (u / (1 - u)) / (p / (1 - p)), with u a uniform number drawn from doc_id and p the inclusion
probability, and the first ones up to the number of words that is missing get a copy more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewell.llm.common import written

#: Ranks are gathered into so many classes for each source, and those of the class in which a source's sample ends into as many again; only the last one is sorted row
#: by row: one row of CLASSES * CLASSES of the source.
CLASSES = 4096


def _targets(sized: DataFrame, share: float, weights: tuple[int, ...], most: int) -> DataFrame:
    """source, source_size, target, whole, rest: one row for each source (sorted as one table: sources are taken to be few against documents). Excess over `most` times a source's size goes to the others by weight: with
    sources ordered by limit / weight, the level that is left to one when all before it are full is largest where the first isn't full."""
    by_name = Window.orderBy(F.col("source").isNull(), "source")  # rows: one for each source
    by_limit = Window.orderBy(F.col("limit") / F.col("weight"), "place")
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    sources = sources.withColumn("place", F.row_number().over(by_name) - 1).withColumn("limit", F.col("source_size") * most)
    sources = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.col("place") % len(weights) + 1).cast("long"))
    everything = Window.partitionBy()
    before = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(everything) * F.lit(share) - F.coalesce(F.sum("limit").over(before), F.lit(0))
    level = left / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    sources = sources.withColumn("level", level).withColumn("target", F.least(F.col("limit").cast("double"), F.col("weight") * F.max("level").over(everything)))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    sources = sources.withColumn("whole", whole.cast("long")).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    return sources.select("source", "source_size", "target", "whole", "rest")


def sized_documents(docs: DataFrame, keep: bool = False) -> DataFrame:
    """source, doc_id, size (words of the text; null: 0), u (the uniform number of doc_id); keep: and the row itself as `row`."""
    u = F.conv(F.substring(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("/mix"))), 1, 13), 16, 10).cast("long")
    size = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    own = [F.struct(*(docs[c] for c in docs.columns)).alias("row")] if keep else []
    return docs.select(F.col("source").cast("string").alias("source"), F.col("doc_id").cast("long").alias("doc_id"), size.alias("size"), ((u + 0.5) / float(1 << 52)).alias("u"), *own)


def _joined(left: DataFrame, right: DataFrame) -> DataFrame:
    """With the stored row of the source; whether that table is broadcast is left to Spark, which knows its size."""
    return left.join(right, left["source"].eqNullSafe(right["source"])).drop(right["source"])


def _factors(sized: DataFrame, sources: DataFrame) -> DataFrame:
    """sources with `factor`, and `largest`, the largest size of which documents aren't certain. Sizes are counted first: a row for each size of a source."""
    sizes = _joined(sized.where("size > 0").groupBy("source", "size").agg(F.count("*").alias("n")), sources)
    up = Window.partitionBy("source").orderBy("size")
    squares = F.sum((F.col("size").cast("decimal(38,0)") * F.col("size") * F.col("n")).cast("decimal(38,0)")).over(up.rowsBetween(Window.unboundedPreceding, 0)).cast("double")
    words = F.sum(F.col("size") * F.col("n")).over(up.rowsBetween(1, Window.unboundedFollowing))
    sizes = sizes.withColumn("factor", (F.col("rest") - F.coalesce(words, F.lit(0))) / squares)
    best = sizes.where(F.col("factor") * F.col("size") < 1).groupBy("source").agg(F.max(F.struct("size", "factor")).alias("b")).select("source", F.col("b.size").alias("largest"), F.col("b.factor").alias("factor"))
    return sources.join(best, sources["source"].eqNullSafe(best["source"]), "left").drop(best["source"])


def _ends(rows: DataFrame, cell: str) -> DataFrame:
    """For each source the cell of `cell` in which its sample ends, and the words before it; rows have `rest` and `before`, the words of the rows that are left out."""
    words = rows.groupBy("source", cell).agg(F.sum("size").alias("words"), F.first("rest").alias("rest"), F.first("before").alias("before"))
    up_to = Window.partitionBy("source").orderBy(cell).rowsBetween(Window.unboundedPreceding, 0)  # CLASSES + 2 rows at most
    ends = words.withColumn("cum", F.col("before") + F.sum("words").over(up_to)).where((F.col("cum") >= F.col("rest")) & (F.col(cell) >= 0))
    ends = ends.groupBy("source").agg(F.min(F.struct(cell, "cum", "words")).alias("e"))
    return ends.select("source", F.col(f"e.{cell}").alias("end"), (F.col("e.cum") - F.col("e.words")).alias("start"))


def mix_sizes(sized: DataFrame, share: float, weights: tuple[int, ...], most: int) -> DataFrame:
    """The stored rows of sized_documents() with source_size, target and copies."""
    sources = written(_targets(sized.select("source", "size"), share, weights, most), "sources")
    sources = written(_factors(sized.select("source", "size"), sources), "factors")
    p = F.col("factor") * F.col("size")
    odds = p / (1 - p)
    v = F.when(F.col("size") > F.col("largest"), 0.0).when(F.col("size") > 0, F.col("u") / (F.col("u") + odds * (1 - F.col("u")))).otherwise(1.0)
    cell = F.when(F.col("size") > F.col("largest"), -1).otherwise(F.floor(F.col("v") * CLASSES))
    ranked = _joined(sized, sources).withColumn("v", v).withColumn("class", cell).withColumn("before", F.lit(0).cast("long"))
    first = written(_ends(ranked, "class"), "ends")
    placed = _joined(ranked, first)
    fine = placed.where(F.col("class") == F.col("end")).drop("end", "before").withColumnRenamed("start", "before").withColumn("fine", F.floor((F.col("v") * CLASSES - F.col("class")) * CLASSES))
    second = written(_ends(fine, "fine").select("source", F.col("end").alias("fine_end"), F.col("start").alias("fine_start")), "fine-ends")
    fine = _joined(fine, second)
    run = Window.partitionBy("source").orderBy("v", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    last = fine.where(F.col("fine") == F.col("fine_end"))
    last = last.withColumn("more", F.when(F.col("fine_start") + F.sum("size").over(run) - F.col("size") / 2 < F.col("rest"), 1).otherwise(0))
    near = fine.where(F.col("fine") != F.col("fine_end")).withColumn("more", F.when(F.col("fine") < F.col("fine_end"), 1).otherwise(0))
    far = placed.where(F.col("class") != F.col("end")).withColumn("more", F.when(F.col("class") < F.col("end"), 1).otherwise(0))
    kept = [c for c in ranked.columns if c != "before"] + ["more"]
    both = far.select(kept).unionByName(near.select(kept)).unionByName(last.select(kept))
    return both.withColumn("copies", F.col("whole") + F.when(F.col("size") > 0, F.col("more")).otherwise(0))


def mix_documents(docs: DataFrame, share: float = 1.5, weights: tuple[int, ...] = (3, 1, 2), most: int = 2) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies for every row of docs (doc_id, text, source).

    Sources by code point, a null source last, have the weights in turn and share `share` times all words. Null and empty texts have size 0: nothing is
    taken of them. Rows that repeat a doc_id draw the same number and are documents of their own. No documents: no rows. Other columns are ignored.
    """
    out = mix_sizes(written(sized_documents(docs), "sized"), share, weights, most)
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def mixed(docs: DataFrame, share: float = 1.5, weights: tuple[int, ...] = (3, 1, 2), most: int = 2) -> DataFrame:
    """The rows of docs themselves, each repeated as often as the mixture takes it (not at all for some). Other columns go along, whatever their names."""
    drawn = mix_sizes(written(sized_documents(docs, keep=True), "sized"), share, weights, most)
    return drawn.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")


#: DuckDB SQL of mix_documents() with its default parameters.
SQL = r"""
WITH sized AS (SELECT doc_id, source, text, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '/mix'), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u FROM documents),
s1 AS (SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n FROM sized GROUP BY source),
s2 AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS place, source_size * 2 AS lim FROM s1),
s3 AS (SELECT *, CASE place % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight FROM s2),
s4 AS (SELECT *, (sum(source_size) OVER ()::DOUBLE * 1.5::DOUBLE - coalesce(sum(lim) OVER w, 0)::DOUBLE) / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0))::DOUBLE AS level
    FROM s3 WINDOW w AS (ORDER BY lim::DOUBLE / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s5 AS (SELECT *, least(lim::DOUBLE, weight * max(level) OVER ()) AS target FROM s4),
s6 AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM s5),
s7 AS (SELECT *, target - whole * source_size AS rest FROM s6),
f1 AS (SELECT source, size, count(*) AS n FROM sized WHERE size > 0 GROUP BY source, size),
f2 AS (SELECT f1.*, (rest - coalesce(sum(size * f1.n) OVER (PARTITION BY f1.source ORDER BY size ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0)::DOUBLE)
    / (sum(size * size * f1.n) OVER (PARTITION BY f1.source ORDER BY size ROWS UNBOUNDED PRECEDING))::DOUBLE AS factor FROM f1 JOIN s7 ON f1.source IS NOT DISTINCT FROM s7.source),
f3 AS (SELECT source, max(size) AS largest, arg_max(factor, size) AS factor FROM f2 WHERE factor * size < 1 GROUP BY source),
d1 AS (SELECT sized.*, source_size, target, whole, rest, CASE WHEN size > largest THEN 0.0::DOUBLE
    WHEN size > 0 THEN u / (u + factor * size / (1 - factor * size) * (1 - u)) ELSE 1.0::DOUBLE END AS v
    FROM sized JOIN s7 ON sized.source IS NOT DISTINCT FROM s7.source LEFT JOIN f3 ON sized.source IS NOT DISTINCT FROM f3.source),
d2 AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY v, doc_id ROWS UNBOUNDED PRECEDING) AS cum FROM d1)
SELECT doc_id, size, source_size, target,
    (size * (whole + CASE WHEN size > 0 AND cum - size / 2.0::DOUBLE < rest THEN 1 ELSE 0 END))::BIGINT AS taken,
    (whole + CASE WHEN size > 0 AND cum - size / 2.0::DOUBLE < rest THEN 1 ELSE 0 END)::BIGINT AS copies FROM d2
"""
