"""Media columns: AVI files with motion-JPEG video.

Payload bytes become 8-bit samples of SIDE x SIDE grey frames. Each frame is a JPEG image of the lossless process (predictor: the sample to the left, in the
first column the one above). Its Huffman code gives a difference of b bits a code word of 9 - b + 1 bits at most so that each difference takes 9 bits with
its magnitude: frames are coded and decoded by table look-ups over whole arrays, and any JPEG reader of that process can read them.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import chunks, trimmed, utf8
from tidewell.llm.jpeg import brightness

SIDE, RATE = 24, 25
FRAME = SIDE * SIDE
#: Frames that are coded or decoded at once.
RUN = 4096
#: A cut needs a histogram difference above mean + CUT standard deviations of the WINDOW differences before it, and above LEAST in any case.
WINDOW, CUT, LEAST, HISTOGRAM = 12, 2.0, 0.12, 16


def _code() -> tuple[np.ndarray, np.ndarray]:
    """Code word of each difference (at difference + 255), and the difference of each code word. The magnitude class s of a difference (its bits) has the code
    word 1...10 of 9 - s bits, for s = 8 down to 0; then follow s bits: the difference, or for a negative one the difference - 1 in s bits."""
    words, back = np.zeros(511, np.uint16), np.zeros(512, np.int16)
    for d in range(-255, 256):
        s = abs(d).bit_length()
        head = (1 << (9 - s)) - 2
        words[d + 255] = head << s | (d if d >= 0 else d + (1 << s) - 1)
        back[words[d + 255]] = d
    return words, back


_WORDS, _BACK = _code()
#: Start of image; frame header of the lossless process: 8 bits, SIDE x SIDE, one component; Huffman table: one code each of 1 to 9 bits for classes 8 to 0;
#: scan header: predictor 1.
HEADER = b"\xff\xd8" + b"\xff\xc3" + struct.pack(">HBHHBBBB", 11, 8, SIDE, SIDE, 1, 1, 0x11, 0) + b"\xff\xc4" + struct.pack(">HB", 28, 0) + bytes([1] * 9 + [0] * 7) + bytes(range(8, -1, -1)) + b"\xff\xda" + struct.pack(">HBBBBBB", 8, 1, 1, 0, 1, 0, 0)
END = b"\xff\xd9"


def encode_frames(samples: np.ndarray) -> list[bytes]:
    """A JPEG image of each frame of samples (n, FRAME), uint8."""
    n = len(samples)
    grid = samples.reshape(n, SIDE, SIDE).astype(np.int16)
    diff = np.empty_like(grid)
    diff[:, :, 1:] = grid[:, :, 1:] - grid[:, :, :-1]
    diff[:, 1:, 0] = grid[:, 1:, 0] - grid[:, :-1, 0]
    diff[:, 0, 0] = grid[:, 0, 0] - 128
    words = _WORDS[diff.reshape(-1, 8) + 255]  # eight words of 9 bits are nine bytes
    packed = np.empty((len(words), 9), np.uint8)
    for k in range(9):
        bits = words[:, k - 1] << (8 - k) if k else 0  # what is left of the word before
        packed[:, k] = (bits | (words[:, k] >> (k + 1) if k < 8 else 0)).astype(np.uint8)
    flat = packed.reshape(-1)
    marks = np.flatnonzero(flat == 255)
    stuffed = np.insert(flat, marks + 1, 0).tobytes()  # a byte 255 inside a scan is followed by 0
    ends = np.arange(1, n + 1) * (FRAME // 8 * 9)
    ends = (ends + np.searchsorted(marks, ends)).tolist()
    return [HEADER + stuffed[lo:hi] + END for lo, hi in zip([0, *ends[:-1]], ends, strict=True)]


def decode_frames(images: list[bytes]) -> np.ndarray:
    """The samples (n, FRAME) of JPEG images of the lossless process as encode_frames() writes them; ValueError for any other."""
    h = len(HEADER)
    if not all(x.startswith(HEADER) and x.endswith(END) for x in images):
        raise ValueError("not a lossless frame of this shape and code")
    flat = np.frombuffer(b"".join(x[h:-2] for x in images), np.uint8)
    stuffing = np.flatnonzero((flat[:-1] == 255) & (flat[1:] == 0)) + 1
    packed = np.delete(flat, stuffing)
    if len(packed) != len(images) * (FRAME // 8 * 9):
        raise ValueError("a frame is too short or too long")
    packed = packed.reshape(-1, 9).astype(np.uint16)
    words = np.empty((len(packed), 8), np.uint16)
    for k in range(8):
        words[:, k] = (packed[:, k] << (k + 1) | packed[:, k + 1] >> (7 - k)) & 511
    grid = _BACK[words].reshape(-1, SIDE, SIDE)
    grid[:, 0, 0] += 128
    grid[:, :, 0] = np.cumsum(grid[:, :, 0], axis=1, dtype=np.int16)
    return np.cumsum(grid, axis=2, dtype=np.int16).astype(np.uint8).reshape(-1, FRAME)


def _chunk(name: bytes, data: bytes) -> bytes:
    return name + struct.pack("<I", len(data)) + data + b"\0" * (len(data) & 1)


def write_avi(images: list[bytes]) -> bytes:
    """RIFF file: list of headers, list `movi` of frames, index `idx1` of their places."""
    largest = max(map(len, images))
    main = struct.pack("<14I", 1_000_000 // RATE, largest * RATE, 0, 0x10, len(images), 0, 1, largest, SIDE, SIDE, 0, 0, 0, 0)
    stream = b"vidsMJPG" + struct.pack("<10I4H", 0, 0, 0, 1, RATE, 0, len(images), largest, 0xFFFFFFFF, 0, 0, 0, SIDE, SIDE)
    image = struct.pack("<IiiHH4sIiiII", 40, SIDE, SIDE, 1, 8, b"MJPG", FRAME, 0, 0, 0, 0)
    header = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", main) + _chunk(b"LIST", b"strl" + _chunk(b"strh", stream) + _chunk(b"strf", image)))
    sizes = np.array(list(map(len, images)), np.int64)
    places = 4 + np.cumsum(np.concatenate(([0], (8 + sizes + (sizes & 1))[:-1])))
    index = np.zeros(len(images), [("name", "S4"), ("flags", "<u4"), ("at", "<u4"), ("size", "<u4")])
    index["name"], index["flags"], index["at"], index["size"] = b"00dc", 0x10, places, sizes
    movie = b"movi" + b"".join([_chunk(b"00dc", x) for x in images])
    body = b"AVI " + header + _chunk(b"LIST", movie) + _chunk(b"idx1", index.tobytes())
    return b"RIFF" + struct.pack("<I", len(body)) + body


def read_avi(data: bytes) -> tuple[int, list[bytes]]:
    """Frames a second and the frames, found by the index, of an AVI file; ValueError if it is none."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("no AVI file")
    at, rate, movie, index = 12, RATE, None, None
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        kind = data[at + 8 : at + 12]
        if name == b"LIST" and kind == b"hdrl":
            micros = struct.unpack_from("<I", data, at + 20)[0]
            rate = round(1_000_000 / micros) if micros else RATE
        elif name == b"LIST" and kind == b"movi":
            movie = at + 8
        elif name == b"idx1":
            index = np.frombuffer(data, np.dtype([("name", "S4"), ("flags", "<u4"), ("at", "<u4"), ("size", "<u4")]), size // 16, at + 8)
        at += 8 + size + (size & 1)
    if movie is None or index is None:
        raise ValueError("no frames or no index")
    index = index[np.isin(index["name"], [b"00dc", b"00db"])]
    if len(index):  # places count from the list's name, in some files from the start of the file
        first = int(index["at"][0])
        movie = 0 if data[movie + first : movie + first + 4] != index["name"][0] else movie
    return rate, [data[movie + a + 8 : movie + a + 8 + s] for a, s in zip(index["at"].tolist(), index["size"].tolist(), strict=True)]


def histograms(frames: np.ndarray) -> np.ndarray:
    """For each frame (n, samples) the share of its samples in each of HISTOGRAM classes."""
    n = len(frames)
    flat = (frames >> 4).astype(np.int64) + np.arange(n)[:, None] * HISTOGRAM
    return np.bincount(flat.ravel(), minlength=n * HISTOGRAM).reshape(n, HISTOGRAM) / max(frames.shape[1], 1)


def image_histograms(images: list[bytes]) -> np.ndarray:
    """The histograms of JPEG images: those written here all at once, baseline images one by one, so that memory holds one of them; ValueError for any other."""
    if all(x.startswith(HEADER) for x in images):
        return histograms(decode_frames(images))
    return np.concatenate([histograms((decode_frames([x]) if x.startswith(HEADER) else brightness(x)).reshape(1, -1)) for x in images])


def cuts(frames: np.ndarray) -> list[int]:
    """shot_starts() of frames (n, samples)."""
    return shot_starts(histograms(frames)) if len(frames) else []


def shot_starts(shares: np.ndarray) -> list[int]:
    """Frames at which a shot begins, 0 left out: the histogram differs from the one before by far more than those of the last WINDOW frames did. The first
    difference has none before it and needs LEAST only."""
    if len(shares) < 2:
        return []
    diff = np.abs(np.diff(shares, axis=0)).sum(axis=1) / 2
    one, two = (np.concatenate(([0], np.cumsum(x))) for x in (diff, diff * diff))
    at = np.arange(len(diff))
    lo = np.maximum(at - WINDOW, 0)
    seen = np.maximum(at - lo, 1)
    mean = (one[at] - one[lo]) / seen
    spread = np.sqrt(np.maximum((two[at] - two[lo]) / seen - mean * mean, 0))
    return (np.flatnonzero((diff > LEAST) & (diff > mean + CUT * spread)) + 1).tolist()


def padded(data: bytes) -> bytes:
    """The bytes, and bytes 255 up to a positive multiple of FRAME."""
    return data + b"\xff" * (FRAME - len(data) % FRAME if len(data) % FRAME or not data else 0)


def to_media(df: DataFrame, payload: Column, name: str = "media") -> DataFrame:
    """df with a column of AVI files, each holding a binary payload (padded to whole frames with bytes 255; null: one frame of them)."""

    @F.pandas_udf("binary")
    def encode(data: pd.Series) -> pd.Series:
        out = []
        for x in data:
            x = padded(bytes(x) if x is not None else b"")
            frames = np.frombuffer(x, np.uint8).reshape(-1, FRAME)
            out.append(write_avi([f for lo in range(0, len(frames), RUN) for f in encode_frames(frames[lo : lo + RUN])]))
        return pd.Series(out, dtype=object)

    return df.withColumn(name, encode(payload))


def clips(df: DataFrame, key: str, media: str = "media") -> DataFrame:
    """A row for each shot of each file: key, clip, first_frame, n_frames, start_s, end_s, error. Frames may be those written here or
    baseline images of any size. A file that can't be read gives one row with its error; a null file none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, data in zip(batch.key, batch.media, strict=True):
                try:
                    rate, images = read_avi(bytes(data))
                    shares = np.concatenate([image_histograms(images[lo : lo + RUN]) for lo in range(0, len(images), RUN)])
                    edges = [0, *shot_starts(shares), len(shares)]
                    rows += [(k, n, lo, hi - lo, lo / rate, hi / rate, None) for n, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False))]
                except (ValueError, struct.error) as e:
                    rows.append((k, None, None, None, None, None, str(e)))
            out = pd.DataFrame(rows, columns=["key", "clip", "first_frame", "n_frames", "start_s", "end_s", "error"])
            yield out.astype({"clip": "Int32", "first_frame": "Int64", "n_frames": "Int64"})

    kind = dict(df.dtypes)[key]
    rows = df.select(F.col(key).alias("key"), F.col(media).alias("media")).where(F.col("media").isNotNull())
    return rows.mapInPandas(run, f"key {kind}, clip int, first_frame long, n_frames long, start_s double, end_s double, error string").withColumnRenamed("key", key)


def digest(docs: DataFrame) -> DataFrame:
    """Stores every whole text of docs (doc_id, text; null: empty) as an AVI file, reads the files back, and returns doc_id, n_bytes, payload_bytes,
    payload_sha256, tail_crc32, media_bytes, media_sha256, feature. The payload's figures are those of the decoded samples; feature tells frames, shots,
    cuts and the mean sample. Equal texts have equal values. Other columns are ignored. Files live in a column between the two steps."""

    def store(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in trimmed(batches):
            at = 0
            for blobs in chunks(map(utf8, batch.text), RUN * FRAME):  # bounded memory: files of so many bytes at a time
                sizes = list(map(len, blobs))
                blobs = [padded(b) for b in blobs]
                frames = np.frombuffer(b"".join(blobs), np.uint8).reshape(-1, FRAME)
                images = [f for k in range(0, len(frames), RUN) for f in encode_frames(frames[k : k + RUN])]
                ends = np.cumsum([0, *(len(b) // FRAME for b in blobs)]).tolist()
                media = [write_avi(images[a:b]) for a, b in zip(ends, ends[1:], strict=False)]
                yield pd.DataFrame({"doc_id": pd.array(batch.doc_id.iloc[at : at + len(blobs)], "Int64"), "n_bytes": sizes, "media": media})
                at += len(blobs)

    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in trimmed(batches):
            at = 0
            for part in chunks(map(bytes, batch.media), 2 * RUN * FRAME):
                files = [read_avi(m)[1] for m in part]
                images = [x for f in files for x in f]
                frames = np.concatenate([decode_frames(images[k : k + RUN]) for k in range(0, len(images), RUN)]) if images else np.zeros((0, FRAME), np.uint8)
                ends, rows = np.cumsum([0, *map(len, files)]).tolist(), []
                for media, a, b in zip(part, ends, ends[1:], strict=False):
                    own = frames[a:b]
                    data, found = own.tobytes(), cuts(own)
                    feature = f"frames={b - a};shots={len(found) + 1};cuts={'/'.join(map(str, found))};mean={int(own.sum(dtype=np.int64)) // len(data)}"
                    rows.append((len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature))
                out = pd.DataFrame(rows, columns=["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])
                here = batch.iloc[at : at + len(part)]
                out.insert(0, "n_bytes", here.n_bytes.to_numpy())
                out.insert(0, "doc_id", pd.array(here.doc_id, "Int64"))
                yield out
                at += len(part)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    stored = rows.mapInPandas(store, "doc_id long, n_bytes long, media binary")
    return stored.mapInPandas(load, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
