"""Media, shards, mixtures and the pipeline."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import SCHEMA, odd_rows
from tidewell.llm import media, mixing, sharding


def test_frames_round_trip():
    rng = np.random.default_rng(0)
    frames = np.concatenate([rng.integers(0, 256, (50, media.FRAME), dtype=np.uint8), np.full((2, media.FRAME), 255, np.uint8), np.zeros((1, media.FRAME), np.uint8), np.tile(np.array([0, 255], np.uint8), media.FRAME // 2)[None]])
    images = media.encode_frames(frames)
    assert (media.decode_frames(images) == frames).all()
    rate, back = media.read_avi(media.write_avi(images))
    assert rate == media.RATE and back == images
    assert all(b"\xff\xd9" not in x[len(media.HEADER) : -2] for x in images)
    for bad in (b"", b"RIFF1234AVI ", media.write_avi(images)[:-40]):
        with pytest.raises((ValueError, Exception)):
            media.decode_frames(media.read_avi(bad)[1])


def test_code_is_a_prefix_code():
    """Every difference has nine bits, no two the same, and the code word of all ones is free, as the format demands."""
    words = media._WORDS.tolist()
    assert len(set(words)) == 511 and max(words) < 511 and all(media._BACK[w] == d for d, w in zip(range(-255, 256), words, strict=True))


def test_decoder_by_bits():
    """A frame read bit by bit, as the format describes it, gives the same samples."""
    rng = np.random.default_rng(1)
    frame = rng.integers(0, 256, media.FRAME, dtype=np.uint8)
    data = media.encode_frames(frame[None])[0][len(media.HEADER) : -2].replace(b"\xff\x00", b"\xff")
    bits = "".join(f"{b:08b}" for b in data)
    at, out = 0, np.zeros((media.SIDE, media.SIDE), int)
    for y in range(media.SIDE):
        for x in range(media.SIDE):
            ones = 0
            while bits[at] == "1":
                ones, at = ones + 1, at + 1
            at += 1
            s = 8 - ones
            v = int(bits[at : at + s], 2) if s else 0
            at += s
            d = v if s == 0 or v >> (s - 1) else v - (1 << s) + 1
            before = out[y, x - 1] if x else out[y - 1, x] if y else 128
            out[y, x] = before + d
    assert at == len(bits) and (out.ravel() == frame).all()


def test_cuts():
    dark, light = np.zeros((20, media.FRAME), np.uint8), np.full((20, media.FRAME), 200, np.uint8)
    assert media.cuts(np.concatenate([dark, light, dark])) == [20, 40] and media.cuts(dark) == [] and media.cuts(dark[:1]) == []


def test_media_odd(spark, clashing, none):
    got = {r.doc_id: r for r in media.digest(clashing).collect()}
    for d, text, *_ in odd_rows():
        data = (text or "").encode()
        padded = data + b"\xff" * (-len(data) % 576 if data else 576)
        r = got[d]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-32:]))
    assert got[11].feature == got[12].feature and got[11].media_sha256 == got[12].media_sha256
    assert media.digest(none).count() == 0
    files = media.to_media(spark.createDataFrame([(1, bytearray(b"\0" * 5760 + b"\xc8" * 5760)), (2, None)], "k int, data binary"), F.col("data"))
    shots = media.clips(files, "k").orderBy("k", "clip").collect()
    assert [(r.k, r.first_frame, r.n_frames) for r in shots] == [(1, 0, 10), (1, 10, 10), (2, 0, 1)] and shots[1].start_s == 10 / media.RATE
    broken = spark.createDataFrame([(1, bytearray(b"no file")), (2, None)], "k int, media binary")
    assert [(r.k, r.error is not None) for r in media.clips(broken, "k").collect()] == [(1, True)]


def test_hilbert_neighbours(spark):
    """Every cell has its own place, and cells next to each other on the curve are next to each other in space."""
    cells = spark.range(512).select((F.col("id") % 8).alias("x"), (F.floor(F.col("id") / 8) % 8).alias("y"), F.floor(F.col("id") / 64).alias("z"))
    rows = cells.withColumn("d", sharding.hilbert_index(F.col("x"), F.col("y"), F.col("z"), 3)).orderBy("d").collect()
    assert [r.d for r in rows] == list(range(512))
    assert all(abs(a.x - b.x) + abs(a.y - b.y) + abs(a.z - b.z) == 1 for a, b in zip(rows, rows[1:], strict=False))


def test_shards(spark, clashing, none, docs, monkeypatch):
    monkeypatch.setattr(sharding, "RUN", 7)
    for df in (clashing, docs):
        rows = sharding.shard_documents(df, 16).toPandas()
        sizes = rows.groupby("shard").size().reindex(range(16), fill_value=0)
        assert len(rows) == df.count() and sizes.max() - sizes.min() <= 1
        assert all(sorted(g.slot) == list(range(len(g))) for _, g in rows.groupby("shard"))
    by = {r.doc_id: r for r in sharding.shard_documents(clashing).collect()}
    for d, text, *_ in odd_rows():
        assert (by[d]["size"], by[d].text_crc32, by[d].law, by[d].grown_shard) == (len((text or "").encode()) + 1, zlib.crc32((text or "").encode()), "rows", None)
    assert sharding.shard_documents(none).count() == 0


def test_shards_prune(docs):
    """Shards cover fewer sources than random ones would."""
    rows = sharding.shard_documents(docs).join(docs.select("doc_id", "source"), "doc_id").toPandas()
    assert rows.groupby("shard").source.nunique().mean() < 0.8 * min(rows.source.nunique(), len(rows) / 16)


def test_mixture(clashing, none, docs):
    rows = mixing.mix_documents(docs).join(docs.select("doc_id", "source"), "doc_id").toPandas()
    assert (rows.taken <= 2 * rows["size"]).all() and np.isclose(rows.groupby("source").target.first().sum(), 1.5 * rows["size"].sum())
    for _, g in rows.groupby("source"):
        assert abs(g.taken.sum() - g.target.iloc[0]) <= g["size"].max() / 2 + 1 and g.target.iloc[0] <= 2 * g["size"].sum()
    again = mixing.mix_documents(docs.repartition(7)).toPandas().set_index("doc_id").taken
    assert (rows.set_index("doc_id").taken.sort_index() == again.sort_index()).all()
    odd = mixing.mix_documents(clashing).collect()
    assert len(odd) == len(odd_rows()) and all(r.taken == 0 for r in odd if r.doc_id in (0, 1, 2))
    out = mixing.mixed(clashing)
    assert out.columns == clashing.columns and out.count() == sum(r.copies for r in odd)
    assert mixing.mix_documents(none).count() == 0 and mixing.mixed(none).count() == 0


def test_targets_fill_up(spark):
    """Weights 3, 1, 2 over sizes 10, 100, 30, 5: limits are 20, 200, 60, 10, and the whole is 217.5."""
    rows = [(k, "w " * n, "en", s, 0) for k, (s, n) in enumerate((("a", 10), ("b", 100), ("c", 30), (None, 5)))]
    got = {r.doc_id: r.target for r in mixing.mix_documents(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {0: 20.0, 1: 127.5, 2: 60.0, 3: 10.0}


def test_mixture_sql(docs):
    import duckdb

    con = duckdb.connect()
    con.execute("create view documents as select * from read_parquet('/root/testdata/sf0.001/documents.parquet')")
    theirs = con.execute(mixing.SQL).df().sort_values("doc_id").reset_index(drop=True)
    ours = mixing.mix_documents(docs).toPandas().sort_values("doc_id").reset_index(drop=True)
    assert (ours[["doc_id", "size", "source_size", "taken", "copies"]] == theirs[["doc_id", "size", "source_size", "taken", "copies"]]).all().all() and np.allclose(ours.target, theirs.target)


def test_pipeline(spark, docs):
    import corpus_pipeline as p

    left, seen = docs, {}
    for name, stage in p.STAGES:
        out = stage(spark, left, "/root/testdata/sf0.001")
        if name != p.STAGES[-1][0]:
            assert out.columns == docs.columns
            out = out.cache()
        seen[name] = out.count()
        left = out
    assert seen["language"] >= 0.95 * docs.count() and seen["quality"] <= seen["language"] and seen["near duplicates"] < seen["quality"]
    assert left.agg(F.sum("length")).first()[0] > 0 and p.run(spark, "/root/testdata/sf0.001").count() == seen["packing"]


def test_pipeline_stages_take_odd_rows(spark, clashing, none):
    import corpus_pipeline as p

    for df in (clashing, none):
        for _, stage in p.STAGES[:-1]:
            out = stage(spark, df, "/root/testdata/sf0.001")
            assert out.columns == df.columns
            out.count()


def test_shards_prune_sources_of_common_start(spark):
    """Sources that differ only late make levels of their own: shards cover few of them."""
    rng = random.Random(6)
    rows = [(k, "x" * rng.randint(1, 400), "en", f"https://common.example/crawl/{rng.randint(2010, 2025)}") for k in range(1600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = sharding.shard_documents(df, 16).join(df.select("doc_id", "source"), "doc_id").toPandas()
    assert got.groupby("shard").source.nunique().mean() <= 8


def test_ranked_levels(spark):
    """Levels follow the order of whole strings, nulls first, with about equally many rows."""
    rng = random.Random(7)
    rows = [(rng.choice([None, "", *(f"same start {k:03d}" for k in range(100))]), rng.choice(["de", "en", None])) for _ in range(3000)]
    df = spark.createDataFrame(rows, "a string, b string").selectExpr("a", "b", "a AS a0", "b AS b0")
    got = sharding.ranked(df, ["a", "b"]).toPandas()
    for level, value, n in (("a", "a0", 32), ("b", "b0", 3)):
        by = sorted({(x is not None and x == x, x or "", v) for x, v in zip(got[value].where(got[value].notna(), None), got[level], strict=True)})
        assert [v for *_, v in by] == sorted(v for *_, v in by) and {v for *_, v in by} == set(range(n))
    assert got.groupby("a").size().max() <= 3 * 3000 / 32


def test_cut_at_the_second_frame():
    dark, light = np.zeros((20, media.FRAME), np.uint8), np.full((20, media.FRAME), 200, np.uint8)
    assert media.cuts(np.concatenate([dark[:1], light])) == [1] and media.cuts(np.concatenate([dark[:1], light, dark])) == [1, 21]


def test_spread_levels(spark):
    """A value's level is the middle of its rows in the cumulative share, for strings of all kinds, nulls first."""
    rng = random.Random(9)
    rows = [(rng.choice([None, "", *(f"same start {k:03d}" for k in range(100))]), rng.choice(["de", *["en"] * 6, "es", "fr", None])) for _ in range(3000)]
    df = spark.createDataFrame(rows, "a string, b string").selectExpr("a", "b", "a AS a0", "b AS b0")
    got = sharding.ranked(df, ["a", "b"], spread=True).collect()
    for k in (0, 1):
        values = sorted((r[k] for r in rows), key=lambda v: (v is not None, v or ""))
        want = {v: (values.index(v) + values.count(v) - (values.count(v) + 1) // 2) * 32 // len(rows) for v in set(values)}
        assert all(r["ab"[k]] == want[r["ab"[k] + "0"]] for r in got)
    assert len({r.b for r in got}) == 5 and max(r.b for r in got) >= 24
    assert sharding.ranked(df.limit(0), ["a", "b"], spread=True).count() == 0


def test_equal_numbers_keep_their_share(spark):
    df = spark.createDataFrame([(1,)] * 500 + [(k,) for k in range(2, 502)], "v long")
    got = sharding.quantised(df.withColumn("v0", F.col("v")), ["v"]).groupBy("v0").agg(F.max("v").alias("v")).collect()
    level = {r.v0: r.v for r in got}
    assert level[1] == 0 and 14 <= level[2] <= 16 and level[501] == 31


def test_shards_prune_languages_and_sources(spark):
    """Of the driver's documents a shard holds few languages and a narrow part of the sources."""
    docs_ = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = sharding.shard_documents(docs_).join(docs_.select("doc_id", "source", "lang"), "doc_id").toPandas()
    assert rows.groupby("shard").lang.nunique().mean() <= 2.2 and rows.lang.nunique() == 4
    assert rows.groupby("shard").source.nunique().mean() <= 0.5 * rows.source.nunique()


def test_inclusion_shares(spark):
    """Over many draws a document is taken as often as its inclusion probability says: certain large ones always, others in proportion to their size."""
    rng = random.Random(3)
    sizes = [300, 200, *(rng.randint(1, 40) for _ in range(60))]
    hits, draws, rest = np.zeros(len(sizes)), 250, None
    for turn in range(draws):
        u = np.random.default_rng(turn).random(len(sizes))
        rows = [("s", k, n, float(x)) for k, (n, x) in enumerate(zip(sizes, u, strict=True))]
        if turn == 0:
            sources = mixing._targets(spark.createDataFrame(rows, "source string, doc_id long, size long, u double"), 0.6, (1,), 2)
            source = mixing._factors(spark.createDataFrame(rows, "source string, doc_id long, size long, u double"), sources).first()
            rest, factor, largest = source.rest, source.factor, source.largest
        if turn < 2:  # the job itself
            got = mixing.mix_sizes(mixing.written(spark.createDataFrame(rows, "source string, doc_id long, size long, u double"), "drawn"), 0.6, (1,), 2).collect()
            taken = {r.doc_id for r in got if r.copies}
        p = np.minimum(factor * np.array(sizes), 1)
        p[np.array(sizes) > largest] = 1
        v = np.where(p == 1, 0, u / (u + p / (1 - np.where(p == 1, 0, p)) * (1 - u)))
        order = np.lexsort((np.arange(len(sizes)), v))
        cum = np.cumsum(np.array(sizes)[order])
        own = {int(k) for k, c in zip(order, cum, strict=True) if c - sizes[k] / 2 < rest}
        if turn < 2:
            assert taken == own
        hits[list(own)] += 1
    assert abs((p * sizes).sum() - rest) < 1e-6 and (p == 1).sum() >= 1
    assert (hits[p == 1] == draws).all()
    assert np.abs(hits / draws - p).max() < 0.13 and np.corrcoef(hits / draws, p)[0, 1] > 0.97
