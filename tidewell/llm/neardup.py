"""Near-duplicate groups by MinHash: one-permutation hashing with optimal densification, banded buckets, star-shaped candidate edges.

One pass over the texts gives each document its number of shingles, a 128-bit digest of its shingle set, and BANDS bucket keys. Documents with equal sets
are one class from then on. In each bucket a hub is compared with the members that are not yet in its component: a bucket of m members gives m - 1
candidate edges, not m * m / 2. Edges are confirmed on the full shingle sets. A hub is then done and leaves its buckets; rounds go on, with more hubs each,
until no bucket holds two components, so a link that a star misses is found by a later hub.

Most members of a large group need no rounds. Of a set's n shingles only the c that some other candidate has can be in an intersection, so a partner
has (100 + percent) / percent * c - n shingles at most; a member for which that is less than any size in its bucket leaves the bucket at once. Hubs are the
members with fewest shingles of their own, which are near the original of a group of edited copies. A member that is not linked with its hub and has i
shingles in common with it can have partners of more than (100 + percent) / percent * i - n shingles only if it shares a shingle outside the hub with them:
these are found by an index of such shingles, rarest first, and the member leaves the buckets that have no smaller ones.

A class goes by the number of its first row, so a doc_id may stand on rows of different texts; classes that share a doc_id are linked at the end. Rows of a large
bucket are dealt over several tasks, by a hash of their ids, wherever they meet their hubs.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewell.llm.common import chunks, mix, trimmed, utf8, word_hashes, written

BANDS, ROWS = 25, 5
BINS = BANDS * ROWS
_EDGES = (np.arange(BINS + 1, dtype=object) * (1 << 64) // BINS)[:BINS].astype(np.uint64)
_SALT = mix(np.arange(1, 65, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
SKETCH = "row long, doc_id long, text_hash long, n_shingles long, set_a long, set_b long, bands array<long>"
#: Members of a bucket that meet a hub in one task, about.
SPLIT = 400


def shingle_sets(texts: list, words: int) -> Iterator[np.ndarray]:
    """For each text its distinct `words`-word shingles as sorted 64-bit hashes; with fewer words, the whole sequence as one; without words, none.
    A-Z are lower-cased; words are runs of characters other than space and U+0009 to U+000D."""
    factors = _SALT[:words] | np.uint64(1)
    for run in chunks(map(utf8, texts)):
        hashes, first = word_hashes(run, lower=True)
        n = max(0, len(hashes) - words + 1)
        grams = np.zeros(n, np.uint64)
        for k in range(words):
            grams += hashes[k : n + k] * factors[k]
        grams = mix(grams)
        for lo, hi in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if hi - lo >= words:
                yield np.unique(grams[lo : hi - words + 1])
            elif hi > lo:
                own = (hashes[lo:hi] * factors[: hi - lo]).sum(dtype=np.uint64, keepdims=True)
                yield mix(own + _SALT[63 - (hi - lo) : 64 - (hi - lo)])
            else:
                yield np.zeros(0, np.uint64)


def _fill_order() -> np.ndarray:
    """For each bin, the order in which it looks at other bins when it is empty: a random one of its own (optimal densification), the same for all sets."""
    rng = np.random.default_rng(11)
    return np.array([rng.permutation(BINS) for _ in range(BINS)])


_FILL = _fill_order()


def band_keys(grams: np.ndarray) -> np.ndarray:
    """BANDS 64-bit bucket keys of a sorted set of hashes. The range of hashes is cut into BINS bins; a bin's value is its smallest hash; an empty bin
    borrows that of the first filled bin in an order of its own."""
    at = np.searchsorted(grams, _EDGES)
    ends = np.append(at[1:], len(grams))
    full = at < ends
    values = grams[np.minimum(at, len(grams) - 1)]
    if not full.all():
        empty = np.flatnonzero(~full)
        lender = _FILL[empty, np.argmax(full[_FILL[empty]], axis=1)]
        values[empty] = mix(values[lender] + empty.astype(np.uint64))
    rows = values.reshape(BANDS, ROWS) * (_SALT[:ROWS] | np.uint64(1))
    return mix(rows.sum(axis=1, dtype=np.uint64) + _SALT[:BANDS])


def sketches(docs: DataFrame, words: int) -> DataFrame:
    """A SKETCH row for each document; `row` numbers the rows."""

    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 36
        for batch in trimmed(batches):
            out = []
            for doc_id, text_hash, grams in zip(batch.doc_id, batch.text_hash, shingle_sets(batch.text.tolist(), words), strict=True):
                if len(grams):
                    a, b = (int(x.sum(dtype=np.uint64).astype(np.int64)) for x in (mix(grams + _SALT[0]), mix(grams ^ _SALT[1])))
                    out.append((row, doc_id, text_hash, len(grams), a, b, band_keys(grams).view(np.int64)))
                else:
                    out.append((row, doc_id, text_hash, 0, 0, 0, np.zeros(0, np.int64)))
                row += 1
            frame = pd.DataFrame(out, columns=["row", "doc_id", "text_hash", "n_shingles", "set_a", "set_b", "bands"])
            yield frame.assign(doc_id=frame.doc_id.astype("Int64"))

    return _texts(docs).mapInPandas(sketch, SKETCH)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("text_hash"), F.col("text").cast("string").alias("text"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of the edges (a, b) reaches. Each step points every node at the smallest neighbour of its
    neighbourhood, larger neighbours first and then smaller ones, until all edges lead to roots; the table of each step is stored."""
    pairs = edges.select("a", "b")
    while True:
        both = pairs.union(pairs.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        star = large.join(least, "a").select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("e")).select(F.col("e.b").alias("a"), F.col("e.m").alias("b"))
        pairs = written(star.where("a > b").distinct(), "star")
        ends = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("x"), F.lit(1).alias("down")), F.struct(F.col("b").alias("x"), F.lit(0).alias("down")))).alias("e"))
        ends = ends.groupBy("e.x").agg(F.sum("e.down").alias("down"), F.min("e.down").alias("least"))
        if ends.where("down > 1 or down = 1 and least = 0").isEmpty():  # every node points at one root, and no root at any
            return pairs.select(F.col("a").alias("node"), F.col("b").alias("root"))


def shingle_table(docs: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """(id, grams): the full shingle sets of the classes in ids (id, doc_id, text_hash, repeated: whether several rows have that doc_id and text), made anew from the texts of these
    rows."""

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in trimmed(batches):
            for lo in range(0, len(batch), 500):  # sets of some documents at a time
                part = batch.iloc[lo : lo + 500]
                yield pd.DataFrame({"id": part.id, "grams": [g.view(np.int64) for g in shingle_sets(part.text.tolist(), words)]})

    # Ids are as many as documents in the worst case: texts meet them in a hashed shuffle at every size, without a sort.
    texts = _texts(docs).join(ids.select("id", "doc_id", "text_hash", "repeated").hint("shuffle_hash"), ["doc_id", "text_hash"])
    if not ids.where("repeated").isEmpty():  # only texts of repeated rows are told apart once more
        texts = texts.where(~F.col("repeated")).select("id", "text").unionByName(texts.where("repeated").select("id", "text").dropDuplicates(["id"]))
    return written(texts.select("id", "text").mapInPandas(sets, "id long, grams array<long>"), "sets")


def _part(id_: str) -> Column:
    """Which of its bucket's `parts` a member is in."""
    return F.pmod(F.xxhash64(id_), F.col("parts"))


def _to_parts(df: DataFrame) -> DataFrame:
    """A row for each of a bucket's parts."""
    return df.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts")


def compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (hub, id, parts) of classes with `both`, the size of the intersection of their full shingle sets, and `total`, the sum of the sets' sizes. A hub of many
    pairs meets them in `parts` tasks."""
    hubs = _to_parts(sets.withColumnRenamed("id", "hub").join(pairs.groupBy("hub").agg(F.max("parts").alias("parts")), "hub").withColumnRenamed("grams", "hub_grams"))
    met = pairs.withColumn("part", _part("id")).join(hubs, ["hub", "part"]).join(sets, "id")
    return met.select("hub", "id", F.size(F.array_intersect("hub_grams", "grams")).alias("both"), (F.size("hub_grams") + F.size("grams")).alias("total"))


def _linked(percent: int) -> Column:
    return 100 * F.col("both") >= percent * (F.col("total") - F.col("both"))


def _candidates(classes: DataFrame, repeated: DataFrame, docs: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(bucket, parts, part, id, n, most, own) for the members of buckets that can have a partner there, and the shingle sets of all of them. own: shingles that no other
    candidate of a bucket of three or more has; most: shingles that a partner can have at most. repeated: (doc_id, text_hash) that stand on several rows."""
    members = classes.select("id", "doc_id", "text_hash", F.explode("bands").alias("bucket"))
    shared = members.groupBy("bucket").agg(F.count("*").alias("members"), F.max("id").alias("top"), F.min("id").alias("low")).where("members > 1 and top > low").select("bucket", "members")
    buckets = written(members.join(written(shared, "shared"), "bucket"), "buckets")
    ids = buckets.groupBy("id").agg(F.max("members").alias("members"), F.first("doc_id").alias("doc_id"), F.first("text_hash").alias("text_hash"))
    again = repeated.select("doc_id", "text_hash", F.lit(True).alias("repeated"))
    ids = written(ids.join(again, ["doc_id", "text_hash"], "left").withColumn("repeated", F.coalesce("repeated", F.lit(False))), "candidates")
    sets = shingle_table(docs, ids, words)
    several = sets.join(ids.where("members > 2").select("id"), "id", "left_semi")
    single = several.select("id", F.explode("grams").alias("gram")).groupBy("gram").agg(F.count("*").alias("k"), F.min("id").alias("id")).where("k = 1")
    own = single.groupBy("id").agg(F.count("*").alias("own"))
    sizes = sets.select("id", F.size("grams").cast("long").alias("n")).join(own, "id", "left").withColumn("own", F.coalesce("own", F.lit(0)))
    sizes = sizes.withColumn("most", F.floor((100 + percent) * (F.col("n") - F.col("own")) / percent - F.col("n")).cast("long"))
    most = F.when(F.col("members") > 2, F.col("most")).otherwise(2 * F.col("n"))  # own shingles are counted among members of the larger buckets only
    parts = F.ceil(F.col("members") / SPLIT).cast("long")
    sized = buckets.select("bucket", "id", "members").join(sizes, "id").withColumns({"most": most, "parts": parts}).drop("members").withColumn("part", _part("id"))
    sized = written(sized, "sized")
    least = _to_parts(sized.groupBy("bucket").agg(F.min("n").alias("least"), F.max("parts").alias("parts")))
    return written(sized.join(least, ["bucket", "part"]).where("most >= least").drop("least"), "open"), sets


def near_duplicate_groups(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every document of docs (doc_id, text).

    Two documents are linked if 100 * |A & B| >= percent * |A | B| for their shingle sets A, B; a component is what links connect, its id the smallest
    doc_id in it, and that document is kept. Null texts and texts without words have no shingles and are linked with nothing. Rows that repeat a doc_id
    give a row each and are one document in links: what is linked with one of its texts is linked with all. A null doc_id is never linked: component_id null, kept
    true. Other columns are ignored; an empty table gives no rows.
    """
    sketch = written(sketches(docs, words), "sketch")
    known = sketch.where(F.col("n_shingles") > 0).where(F.col("doc_id").isNotNull())
    keys = ["set_a", "set_b", "n_shingles"]
    classes = known.groupBy(*keys).agg(F.min(F.struct("row", "doc_id", "text_hash")).alias("first"), F.min("doc_id").alias("low"), F.first("bands").alias("bands"))
    classes = written(classes.select(*keys, F.col("first.row").alias("id"), F.col("first.doc_id").alias("doc_id"), F.col("first.text_hash").alias("text_hash"), "low", "bands"), "classes")
    rows = written(known.select("doc_id", *keys).join(classes.select(*keys, "id"), keys).select("doc_id", "n_shingles", "id"), "rows")
    repeated = rows.groupBy("doc_id").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a < b").select("doc_id", "a")
    same = written(rows.join(repeated, "doc_id").where("a < id").select("a", F.col("id").alias("b")).distinct(), "same-ids")
    roots = _joined(None, same)
    again = known.groupBy("doc_id", "text_hash").count().where("count > 1")
    buckets, sets = _candidates(classes, again, docs, words, percent)
    turn = 0
    while True:
        found = written(_open_buckets(buckets, roots), "unsolved")
        if found.isEmpty():
            break
        stars = written(_stars(found, 1 << 3 * turn, turn, percent), "stars")
        met = written(compared(stars.where("id is not null").groupBy("hub", "id").agg(F.max("parts").alias("parts")), sets), "compared")
        roots = _joined(roots, met.where(_linked(percent)).select(F.col("hub").alias("a"), F.col("id").alias("b")))
        buckets = found.drop("root").join(stars.select("bucket", F.col("hub").alias("id")).distinct(), ["bucket", "id"], "left_anti")
        if turn == 0:
            buckets, roots = _beside_hubs(written(_open_buckets(buckets, roots), "beside"), met, sets, roots, percent)
        turn += 1
    named = classes.select("id", "low")
    if roots is not None:
        rooted = named.join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
        least = rooted.groupBy("root").agg(F.min("low").alias("component_id"), F.count("*").alias("k")).where("k > 1").select("root", "component_id")
        named = rooted.join(least, "root", "left").select("id", F.coalesce("component_id", "low").alias("component_id"))
    else:
        named = named.withColumnRenamed("low", "component_id")
    out = rows.join(named, "id").select("doc_id", "n_shingles", "component_id")
    alone = sketch.where((F.col("n_shingles") == 0) | F.col("doc_id").isNull()).select("doc_id", "n_shingles")
    # a text without shingles goes with the other texts of its doc_id
    alone = alone.join(rows.join(named, "id").groupBy("doc_id").agg(F.min("component_id").alias("component_id")), "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.union(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _joined(roots: DataFrame | None, links: DataFrame) -> DataFrame | None:
    """The roots (node, root) after new links (a, b)."""
    if links.isEmpty():
        return roots
    return components(links if roots is None else roots.toDF("a", "b").union(links))


def _open_buckets(buckets: DataFrame, roots: DataFrame | None) -> DataFrame:
    """The rows of the buckets that hold two components or more, with `root`."""
    if roots is None:
        rooted = buckets.withColumn("root", F.col("id"))
    else:
        rooted = buckets.join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    mixed = rooted.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("top"), F.max("parts").alias("parts")).where("low < top").select("bucket", "parts")
    return rooted.join(_to_parts(mixed), ["bucket", "part"])


def _stars(rows: DataFrame, hubs: int, turn: int, percent: int) -> DataFrame:
    """(bucket, parts, hub, id): edges of up to `hubs` hubs of each bucket to the members of other components, after the first turn to those whose sizes allow a link; id is
    null for a hub itself. At first hubs are the members with fewest shingles of their own, later those of the components with fewest members in the bucket, so that
    what is left soon is of one component. Hubs are found by aggregation, so no bucket is sorted or gathered in one task."""
    slot = F.pmod(F.xxhash64("id", F.lit(turn), F.lit(7)), F.lit(hubs))
    best = F.struct("own", F.xxhash64("id", F.lit(turn)).alias("draw"), "id", "root", "n", "most")
    if turn:
        each = rows.groupBy("bucket", "root", slot.alias("slot")).agg(F.count("*").alias("k"), F.min(best).alias("h"), F.max("parts").alias("parts"))
        each = each.withColumn("size", F.sum("k").over(Window.partitionBy("bucket", "root")))  # `hubs` rows at most
    else:
        each = rows.groupBy("bucket", slot.alias("slot")).agg(F.min(best).alias("h"), F.max("parts").alias("parts")).withColumn("size", F.lit(1).cast("long"))
    hub = each.groupBy("bucket", "slot").agg(F.min(F.struct("size", "h")).alias("s"), F.max("parts").alias("parts")).select("bucket", "parts", F.col("s.h").alias("h"))
    other = F.col("root") != F.col("h.root")
    if turn:
        other = other & (F.col("n") <= F.col("h.most")) & (F.col("h.n") <= F.col("most")) & (100 * F.least("n", "h.n") >= percent * F.greatest("n", "h.n"))
    met = rows.join(_to_parts(hub), ["bucket", "part"]).where(other).select("bucket", "parts", F.col("h.id").alias("hub"), "id")
    return met.unionByName(hub.select("bucket", "parts", F.col("h.id").alias("hub"), F.lit(None).cast("long").alias("id")))


def _beside_hubs(rows: DataFrame, met: DataFrame, sets: DataFrame, roots: DataFrame | None, percent: int) -> tuple[DataFrame, DataFrame | None]:
    """For the rows of open buckets after the first turn: the rows with a smaller `most` where a member is linked with none of its hubs, less those that can have no
    partner left; and the roots after the links of such members by shingles outside the hub that has most in common with them. A member that lacks d shingles of the least
    intersection with a partner, apart from those it has in common with the hub, shares one of its m - d + 1 rarest others with any partner."""
    tried = met.withColumn("linked", _linked(percent)).groupBy("id").agg(F.max_by("hub", F.struct("both", "hub")).alias("hub"), F.max("both").alias("both"), F.max("linked").alias("linked"))
    least = _to_parts(rows.groupBy("bucket").agg(F.min("n").alias("least"), F.max("parts").alias("parts")))
    rows = written(rows.join(tried, "id", "left").join(least, ["bucket", "part"]), "tried")
    apart = rows.where(~F.col("linked"))
    lack = F.ceil(F.lit(percent) * (F.col("n") + F.min("least")) / (100 + percent)) - F.col("both")
    needs = apart.groupBy("id", "hub", "n", "both").agg(F.greatest(lack, F.lit(1)).cast("int").alias("lack"), F.max("parts").alias("parts"))
    people = rows.select("id", "root", "n", "own").distinct()
    grams = sets.join(people, "id").select("id", "root", "n", "own", F.explode("grams").alias("gram"))
    hubs = _to_parts(sets.withColumnRenamed("id", "hub").join(needs.groupBy("hub").agg(F.max("parts").alias("parts")), "hub").withColumnRenamed("grams", "hub_grams"))
    own = needs.withColumn("part", _part("id")).join(hubs, ["hub", "part"]).join(sets, "id").select("id", "hub", "lack", F.explode(F.array_except("grams", "hub_grams")).alias("gram"))
    own = written(own, "outside")
    counts = grams.groupBy("gram").agg(F.count("*").alias("k")).where("k > 1")
    order = Window.partitionBy("id", "hub")  # as many rows as a set has shingles at most
    rare = own.join(counts, "gram").withColumn("place", F.row_number().over(order.orderBy("k", "gram"))).withColumn("m", F.count("*").over(order)).where("place <= m - lack + 1")
    rare = written(rare.groupBy("id", "gram").agg(F.ceil(F.first("k") / SPLIT).cast("long").alias("parts")), "rare")
    roots = _outer_links(rare, grams, sets, roots, percent)
    reach = F.floor((100 + percent) * F.col("both") / percent - F.col("n")).cast("long")
    rows = rows.withColumn("most", F.when(~F.coalesce("linked", F.lit(True)), F.least("most", reach)).otherwise(F.col("most")))
    return rows.where("most >= least").select("bucket", "parts", "part", "id", "n", "most", "own"), roots


def _outer_links(rare: DataFrame, grams: DataFrame, sets: DataFrame, roots: DataFrame | None, percent: int) -> DataFrame | None:
    """The roots after the links of each member in rare (id, gram, parts) with all of grams (id, root, n, own, gram) that have the shingle. First the members with a shingle
    meet one hub of it, a star; then those of rare meet only members that are of another component still. A shingle of many members is dealt over `parts` tasks."""
    parts = rare.groupBy("gram").agg(F.first("parts").alias("parts"))
    seeking = rare.select("id", "gram", F.lit(True).alias("seeks"))
    members = grams.join(parts, "gram").join(seeking, ["id", "gram"], "left").withColumn("seeks", F.coalesce("seeks", F.lit(False)))
    members = written(members.withColumn("part", _part("id")), "sharing")
    near = 100 * F.least("n", "n_x") >= percent * F.greatest("n", "n_x")
    draw = F.struct("own", F.xxhash64("id").alias("draw"), "id", "root", "n")
    hub = members.groupBy("gram").agg(F.min(draw).alias("h"), F.max("parts").alias("parts"), F.min("root").alias("low"), F.max("root").alias("top")).where("low < top")
    hub = _to_parts(hub.select("gram", "parts", F.col("h.id").alias("hub"), F.col("h.root").alias("root_x"), F.col("h.n").alias("n_x")))
    star = members.join(hub, ["gram", "part"]).where(near & (F.col("root") != F.col("root_x"))).groupBy("hub", "id").agg(F.max("parts").alias("parts"))
    roots = _joined(roots, written(compared(star, sets).where(_linked(percent)).select(F.col("hub").alias("a"), F.col("id").alias("b")), "outer-stars"))
    if roots is not None:
        members = members.drop("root").join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    mixed = members.groupBy("gram").agg(F.min("root").alias("low"), F.max("root").alias("top"), F.max("parts").alias("parts")).where("low < top").select("gram", "parts")
    members = members.drop("parts").join(_to_parts(mixed.withColumn("all_parts", F.col("parts"))), ["gram", "part"]).withColumnRenamed("all_parts", "parts")
    members = written(members, "sharing-still")
    seekers = _to_parts(members.where("seeks").select("gram", "parts", F.col("id").alias("x"), F.col("root").alias("root_x"), F.col("n").alias("n_x")))
    pairs = seekers.join(members, ["gram", "part"]).where(near & (F.col("root") != F.col("root_x")))
    pairs = pairs.groupBy(F.least("x", "id").alias("hub"), F.greatest("x", "id").alias("id")).agg(F.max("parts").alias("parts"))
    return _joined(roots, written(compared(pairs, sets).where(_linked(percent)).select(F.col("hub").alias("a"), F.col("id").alias("b")), "outer-links"))


def without_near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs less those of documents that near_duplicate_groups() does not keep. Rows that repeat a kept doc_id, and those with a null one, all
    stay. All columns stay, whatever their names."""
    name = f"dropped_{uuid.uuid4().hex}"
    dropped = near_duplicate_groups(docs, words, percent).where(~F.col("kept")).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(dropped, docs["doc_id"].cast("long") == dropped[name], "left_anti")
