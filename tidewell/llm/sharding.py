"""Sharding by Hilbert-curve order: several metadata columns are quantised, rows sorted by their place on the curve, and the order cut into runs of equal length.

Rows of a shard are near each other in all the columns at once, so ranges kept for each file prune files for filters on any of them.
Only DataFrame functions are used.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewell.llm.common import written

#: Bits for each dimension: three dimensions have 2 ** 15 cells.
BITS = 5
#: A cell with more rows is divided by a hash of doc_id.
RUN = 50_000


def ranked(df: DataFrame, columns: list[str], spread: bool = False) -> DataFrame:
    """df with text columns replaced by levels, by the order of whole strings, nulls first: as many as there are, up to 2 ** BITS, of about equally many rows. spread: a
    value's level is its place in the cumulative share of rows times 2 ** BITS, so that few values, too, lie apart over all bits. The limits come from counts of all
    values: those are sorted in ranges, and the rows before each range come from its sum, so no task sorts more than a range. At most 2 ** BITS limits of a column reach
    the driver."""
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("axis"), F.col(c).alias("value")) for c in columns)))
    counts = df.select(pairs.alias("pair")).groupBy("pair.axis", "pair.value").agg(F.count("*").alias("n"))
    counts = written(counts.repartitionByRange(F.asc("axis"), F.asc_nulls_first("value")).withColumn("part", F.spark_partition_id()), "values")
    along = Window.partitionBy("axis").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = counts.groupBy("axis", "part").agg(F.sum("n").alias("n"))
    parts = parts.select("axis", "part", F.coalesce(F.sum("n").over(along), F.lit(0)).alias("part_start"), F.sum("n").over(Window.partitionBy("axis")).alias("total"))
    within = Window.partitionBy("axis", "part").orderBy(F.asc_nulls_first("value")).rowsBetween(Window.unboundedPreceding, 0)
    rows = counts.join(F.broadcast(parts), ["axis", "part"]).withColumn("upto", F.col("part_start") + F.sum("n").over(within))
    at = lambda x: F.expr(f"({x}) * {1 << BITS} div total")
    if spread:
        firsts = rows.groupBy("axis", at("upto - (n + 1) div 2").cast("int").alias("level")).agg(F.min("value").alias("value")).collect()
        out = {}
        for c in columns:
            levels = sorted(((r.level, r.value) for r in firsts if r.axis == c), key=lambda x: x[0])
            expr = F.lit(levels[0][0] if levels else 0)
            for (low, _), (level, first) in zip(levels, levels[1:], strict=False):  # only the lowest level can hold nulls alone
                expr = expr + F.when(F.coalesce(F.col(c) >= F.lit(first), F.lit(False)), level - low).otherwise(0)
            out[c] = expr
        return df.withColumns(out)
    limits = rows.where(F.least(at("upto"), F.lit((1 << BITS) - 1)) > at("upto - n")).select("axis", "value").collect()
    above = lambda c, x: F.col(c).isNotNull() if x is None else F.coalesce(F.col(c) > F.lit(x), F.lit(False))
    return df.withColumns({c: sum((above(c, r.value).cast("int") for r in limits if r.axis == c), F.lit(0)) for c in columns})


def quantised(df: DataFrame, columns: list[str]) -> DataFrame:
    """df with numeric columns replaced by levels 0 to 2 ** BITS - 1 of about equally many rows; a value of many rows leaves the levels that it fills over unused. The limits
    come from quantile summaries of all rows."""
    shares = [k / (1 << BITS) for k in range(1, 1 << BITS)]
    limits = df.agg(*(F.percentile_approx(c, shares, 10_000).alias(c) for c in columns)).first()
    return df.withColumns({c: sum(((F.col(c) > x).cast("int") * n for x, n in sorted(Counter(limits[c] or []).items())), F.lit(0)) for c in columns})


def hilbert_index(x: Column, y: Column, z: Column, bits: int = BITS) -> Column:
    """Place of a cell on the three-dimensional Hilbert curve. From the highest bit down, the axes are mirrored or exchanged so that each octant is entered
    where the last was left; a Gray code of the resulting bits, interleaved, is the place."""
    steps = [(1 << b, axis) for b in range(bits - 1, 0, -1) for axis in range(3)]
    plan = F.array(*(F.struct(F.lit(q).alias("q"), F.lit(a).alias("a")) for q, a in steps))

    def turn(p: Column, s: Column) -> Column:
        low = s["q"] - 1
        value = F.when(s["a"] == 0, p["x"]).when(s["a"] == 1, p["y"]).otherwise(p["z"])
        mirror = value.bitwiseAND(s["q"]) != 0
        swap = F.when(mirror, 0).otherwise(p["x"].bitwiseXOR(value).bitwiseAND(low))
        first = F.when(mirror, p["x"].bitwiseXOR(low)).otherwise(p["x"].bitwiseXOR(swap))
        y2, z2 = (F.when(s["a"] == k, p[c].bitwiseXOR(swap)).otherwise(p[c]) for k, c in ((1, "y"), (2, "z")))
        return F.struct(first.alias("x"), y2.alias("y"), z2.alias("z"))

    def place(p: Column) -> Column:
        y, z = p["x"].bitwiseXOR(p["y"]), p["x"].bitwiseXOR(p["y"]).bitwiseXOR(p["z"])
        flips = F.aggregate(F.array(*(F.lit(1 << b) for b in range(bits - 1, 0, -1))), F.lit(0), lambda t, q: F.when(z.bitwiseAND(q) != 0, t.bitwiseXOR(q - 1)).otherwise(t))
        axes = F.array(p["x"].bitwiseXOR(flips), y.bitwiseXOR(flips), z.bitwiseXOR(flips))
        pairs = F.array(*(F.struct(F.lit(1 << b).alias("q"), F.lit(a).alias("a")) for b in range(bits - 1, -1, -1) for a in range(3)))
        return F.aggregate(pairs, F.lit(0), lambda acc, s: acc * 2 + (F.get(axes, s["a"]).bitwiseAND(s["q"]) != 0).cast("int"))

    return F.aggregate(plan, F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"), z.cast("int").alias("z")), turn, place)


def shard_documents(docs: DataFrame, shards: int = 16) -> DataFrame:
    """Puts every document (doc_id, text, lang, source) into one of `shards` shards whose numbers of rows are at most one apart (law `rows`): doc_id, size,
    text_crc32, law, shard, slot, grown_shard, curve.

    Dimensions are source, lang and size (UTF-8 bytes plus 1). A null text has size 1 and checksum 0; null lang and source come first; equal rows may
    stand in any order. No documents: no rows. Other columns are ignored. Rows of a curve cell are numbered within hash parts of about RUN rows, and
    the numbers before each part come from counts, so no task sorts more than a part.
    """
    text = F.col("text").cast("string")
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), size.alias("size"), F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"), F.col("source").cast("string").alias("d1"), F.col("lang").cast("string").alias("d2"), size.alias("d3"))
    rows = quantised(ranked(written(rows, "metadata"), ["d1", "d2"], spread=True), ["d3"])
    rows = rows.select("doc_id", "size", "text_crc32", hilbert_index(F.col("d1"), F.col("d2"), F.col("d3")).alias("curve"), F.xxhash64("doc_id", "text_crc32").alias("draw"))
    rows = written(rows, "curve")
    along = Window.orderBy("curve").rowsBetween(Window.unboundedPreceding, -1)  # one row for each cell: 2 ** 15 at most
    cells = rows.groupBy("curve").agg(F.count("*").alias("n"))
    cells = cells.select("curve", F.ceil(F.col("n") / RUN).alias("parts"), F.coalesce(F.sum("n").over(along), F.lit(0)).alias("cell_start"), F.sum("n").over(Window.partitionBy()).alias("total"))
    rows = rows.join(F.broadcast(cells), "curve").withColumn("part", F.pmod("draw", "parts"))
    within = Window.partitionBy("curve").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("curve", "part").agg(F.count("*").alias("n")).select("curve", "part", F.coalesce(F.sum("n").over(within), F.lit(0)).alias("part_start"))
    rows = rows.join(parts, ["curve", "part"])
    number = F.row_number().over(Window.partitionBy("curve", "part").orderBy("draw", "doc_id"))
    rows = rows.withColumn("rank", F.col("cell_start") + F.col("part_start") + number - 1)
    rows = rows.withColumn("shard", F.expr(f"cast(rank * {shards} div total as int)"))
    slot = F.expr(f"rank - ((shard * total + {shards - 1}) div {shards})")
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), F.col("curve").cast("int").alias("curve"))
