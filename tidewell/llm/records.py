"""Token-ID output: length-delimited binary records with masked checksums and a separate offset index.

Data file: for each document one frame
    length u64 | masked CRC-32 of the length u32 | body | masked CRC-32 of the body u32
with body = doc_id i64 | flags u8 (1: doc_id is null) | id width in bytes u8 | ids. A masked checksum is the checksum rotated right by 15 bits plus
0xA282EAD8, so that a checksum stored inside checksummed data doesn't upset it. All numbers are little-endian.
Index file beside it: doc_id i64 | frame offset u64 | frame bytes u64 | number of ids u64 for each document in the same order.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.common import open_fs, trimmed
from tidewell.llm.tokens import encoder

INDEX = np.dtype([("doc_id", "<i8"), ("offset", "<u8"), ("size", "<u8"), ("n_tokens", "<u8")])
SHARD = "shard int, path string, n_docs long, n_tokens long"
ROWS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: bytes, width: int = 2) -> bytes:
    body = struct.pack("<qBB", doc_id or 0, doc_id is None, width) + ids
    size = struct.pack("<Q", len(body))
    return size + struct.pack("<I", masked(size)) + body + struct.pack("<I", masked(body))


def unframe(data: memoryview | bytes, at: int = 0) -> tuple[int | None, np.ndarray]:
    """(doc_id, ids) of the frame at this place; ValueError if a length or checksum is wrong."""
    size = bytes(data[at : at + 8])
    if len(size) < 8 or struct.unpack_from("<I", data, at + 8)[0] != masked(size):
        raise ValueError(f"frame at {at}: damaged length")
    n = struct.unpack("<Q", size)[0]
    body = bytes(data[at + 12 : at + 12 + n])
    if len(body) < n or struct.unpack_from("<I", data, at + 12 + n)[0] != masked(body):
        raise ValueError(f"frame at {at}: damaged body")
    doc_id, null, width = struct.unpack_from("<qBB", body)
    return None if null else doc_id, np.frombuffer(body, f"<u{width}", offset=10)


def write_records(docs: DataFrame, path: str, tokenizer: str, end_id: int, words: bool) -> list:
    """Encodes every whole text, appends end_id and writes shards in ascending doc_id order below `path` (in the shared folder). Returns a row for each shard
    (SHARD), in order. Null text: only end_id. Null doc_ids come first. Repeated doc_ids: a record each. No documents: one shard at most, without records.

    Rows are dealt by ranges of doc_id and, among equal ones and nulls, of a hash of the text, so a shard is one task's sorted run and a doc_id of many rows isn't
    one task's. A task writes under a name of its own and renames at the end: a task that
    runs again, after a lost executor, leaves the same files.
    """

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        fs, base = open_fs(path)
        fs.create_dir(base, recursive=True)
        name, own = f"{base}/tokens-{shard:06d}", uuid.uuid4().hex
        end, encode = np.array([end_id], "<u2").tobytes(), encoder(tokenizer, words).encode
        index, at, total, n = [], 0, 0, 0
        with fs.open_output_stream(f"{name}.{own}") as out:
            for batch in trimmed(batches):
                for doc_id, null, text in zip(batch.doc_id, batch.gone, batch.text, strict=True):
                    ids = encode(text) + end
                    data = frame(None if null else int(doc_id), ids)
                    out.write(data)
                    index.append((int(doc_id), at, len(data), len(ids) // 2))
                    at, total, n = at + len(data), total + len(ids) // 2, n + 1
        with fs.open_output_stream(f"{name}.idx.{own}") as out:
            out.write(np.array(index, INDEX).tobytes())
        fs.move(f"{name}.{own}", f"{name}.rec")
        fs.move(f"{name}.idx.{own}", f"{name}.idx")
        yield pd.DataFrame({"shard": [shard], "path": [f"tokens-{shard:06d}"], "n_docs": [n], "n_tokens": [total]})

    rows = docs.select(F.coalesce(F.col("doc_id"), F.lit(0)).cast("long").alias("doc_id"), F.col("doc_id").isNull().alias("gone"), F.col("text").cast("string").alias("text"))
    order = [F.col("gone").desc(), F.col("doc_id"), F.xxhash64("text")]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return sorted(ordered.mapInPandas(write, SHARD).collect(), key=lambda r: r.shard)  # a row for each task


def read_records(spark: SparkSession, path: str, shards: list) -> DataFrame:
    """A row for each record, read from the files: doc_id, start (ids before it in all shards), n_tokens, ids_crc32 (of the ids as 32-bit integers). Checksums are verified."""
    starts = np.cumsum([0, *(r.n_tokens for r in shards)])
    table = spark.createDataFrame([(r.path, int(s)) for r, s in zip(shards, starts, strict=False) if r.n_docs] or [], "path string, start long")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = open_fs(path)
        for batch in batches:
            for name, start in zip(batch.path, batch.start, strict=True):
                with fs.open_input_file(f"{base}/{name}.idx") as f:
                    index = np.frombuffer(f.read(), INDEX)
                before = start + np.cumsum(index["n_tokens"].astype(np.int64)) - index["n_tokens"].astype(np.int64)
                with fs.open_input_stream(f"{base}/{name}.rec") as f:
                    for lo in range(0, len(index), 1000):
                        part, rows = index[lo : lo + 1000], []
                        for size in part["size"]:
                            doc_id, ids = unframe(f.read(int(size)))
                            rows.append((doc_id, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        out = pd.DataFrame(rows, columns=["doc_id", "n_tokens", "ids_crc32"])
                        yield out.assign(doc_id=out.doc_id.astype("Int64"), start=before[lo : lo + 1000])[["doc_id", "start", "n_tokens", "ids_crc32"]]

    return table.repartition(max(1, len(shards))).mapInPandas(read, ROWS)


def read_shuffled(spark: SparkSession, path: str, shards: list, seed: int = 0) -> DataFrame:
    """(doc_id, ids array<int>) of all records in an order drawn by seed: only the index is shuffled; each task then seeks its records."""
    names = spark.createDataFrame([(r.path,) for r in shards if r.n_docs] or [], "path string")

    def places(batches):
        fs, base = open_fs(path)
        for batch in batches:
            for name in batch.path:
                with fs.open_input_file(f"{base}/{name}.idx") as f:
                    index = np.frombuffer(f.read(), INDEX)
                yield pd.DataFrame({"path": name, "offset": index["offset"].astype(np.int64), "size": index["size"].astype(np.int64)})

    def seek(batches):
        fs, base = open_fs(path)
        open_files = {}
        for batch in batches:
            rows = []
            for name, offset, size in zip(batch.path, batch.offset, batch["size"], strict=True):
                if name not in open_files:
                    open_files[name] = fs.open_input_file(f"{base}/{name}.rec")
                rows.append(unframe(open_files[name].read_at(int(size), int(offset))))
            yield pd.DataFrame({"doc_id": pd.array([r[0] for r in rows], "Int64"), "ids": [r[1].astype(np.int32) for r in rows]})

    drawn = names.mapInPandas(places, "path string, offset long, size long").withColumn("at", F.xxhash64("path", "offset", F.lit(seed)))
    return drawn.repartitionByRange("at").sortWithinPartitions("at").mapInPandas(seek, "doc_id long, ids array<int>")
