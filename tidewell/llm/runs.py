"""Periodic runs of words: stretches that repeat a block of q words at least four times, by longest common extensions on a difference cover and a harmonic grid.

Each text is searched on its own, whole; texts of one Arrow batch share their arrays, in groups of about GROUP bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import chunks, trimmed, utf8

#: Every distance below V is a difference of two members of the cover, so any two positions meet the cover together within V - 1 steps.
V = 31
#: A perfect difference set modulo 31.
COVER = np.array([0, 1, 3, 8, 12, 18])
#: A run has at least so many periods and so many words.
TIMES, LEAST = 4, 6
GROUP = 1 << 21
#: Grid points looked at in one go.
GRID = 1 << 20
#: Bytes of a text that are split into words in one go.
PIECE = 1 << 22

_PLACE = np.full(V, -1)
_PLACE[COVER] = np.arange(len(COVER))
#: _SHIFT[a, b]: the least number of steps after which positions a and b (modulo V) are both in the cover.
_SHIFT = np.array([[next(t for t in range(V) if _PLACE[(a + t) % V] >= 0 and _PLACE[(b + t) % V] >= 0) for b in range(V)] for a in range(V)], np.int32)

RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


class Extensions:
    """Longest common extensions to the right within an array of positive ids. Some ids (separators) stand once in it, one of them at its end, so no extension
    passes one of those.

    Only suffixes that start in the cover are sorted: first by V ids, a few at a time and only where ties are left, then by doubling, for which the suffix V * 2^k
    further on is in the cover too. Minima of neighbours' common prefixes stand in a sparse table.
    """

    def __init__(self, ids: np.ndarray):
        self.s = np.concatenate([ids, np.zeros(V, ids.dtype)])
        n = len(ids)
        at = np.arange(0, n, V)[:, None] + COVER
        at = at[at < n]  # in ascending order, so a sampled position's number is _number()
        m, bits = len(at), max(1, int(ids.max()).bit_length())
        order, name, made = np.arange(m), np.zeros(m, np.int64), np.zeros(m, np.int64)
        tied = np.arange(m) if m > 1 else np.arange(0)

        def split(key: np.ndarray, length: int) -> None:
            """Sorts the tied suffixes by (name, key); neighbours that differ now have `length` ids in common at least."""
            nonlocal tied
            turn = np.argsort(key, kind="stable")
            order[tied] = order[tied][turn]
            key = key[turn]
            new = np.ones(len(key), bool)
            new[1:] = key[1:] != key[:-1]
            fresh = tied[new]
            made[fresh[name[order[fresh]] != fresh]] = length
            name[order[tied]] = fresh[np.cumsum(new) - 1]
            tied = tied[~(new & np.append(new[1:], True))]

        done = 0
        while done < V and len(tied):
            own = order[tied]
            key, many = name[own].copy(), min(V - done, (62 - (m if done else 1).bit_length()) // bits)
            for t in range(many):
                key = (key << bits) | self.s[at[own] + (done + t)]
            split(key, done)
            done += many
        names, step = [name.copy()], V
        while len(tied):
            own = order[tied]
            split(name[own] * m + names[-1][_number(at[own] + step)], step)
            names.append(name.copy())
            step *= 2
        self.slot = np.empty(m, np.int64)
        self.slot[order] = np.arange(m)
        self.lcp = self._common(at, order, made, names)
        self.table = [self.lcp]
        while (half := 1 << (len(self.table) - 1)) * 2 <= m:
            last = self.table[-1]
            self.table.append(np.minimum(last[:-half], last[half:]))

    def _common(self, at, order, made, names) -> np.ndarray:
        """Common prefix of each sorted suffix and the one before it."""
        out = made.astype(np.int32)
        a, b = at[order], np.concatenate([[0], at[order[:-1]]])
        act = np.flatnonzero(made >= V)
        for level in range(len(names) - 2, -1, -1):
            x, y = a[act] + out[act], b[act] + out[act]
            same = names[level][_number(x)] == names[level][_number(y)]
            out[act[same]] += V << level
        act = np.arange(1, len(a))
        while len(act):
            act = act[self.s[a[act] + out[act]] == self.s[b[act] + out[act]]]
            out[act] += 1
        return out

    def of(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """For each pair of different positions, how many ids from there on agree."""
        out, shift, act = np.zeros(len(i), np.int64), _SHIFT[i % V, j % V], np.arange(len(i))
        for t in range(V):
            met = shift[act] == t
            if met.any():
                own = act[met]
                out[own] = t + self._least(self.slot[_number(i[own] + t)], self.slot[_number(j[own] + t)])
                act = act[~met]
            if not len(act):
                break
            same = self.s[i[act] + t] == self.s[j[act] + t]
            out[act[~same]] = t
            act = act[same]
        return out

    def _least(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        lo, hi = np.minimum(x, y) + 1, np.maximum(x, y) + 1
        level = np.frexp((hi - lo).astype(np.float64))[1] - 1
        out = np.empty(len(x), np.int64)
        for k in np.unique(level):
            own = level == k
            out[own] = np.minimum(self.table[k][lo[own]], self.table[k][hi[own] - (1 << int(k))])
        return out


def _number(position: np.ndarray) -> np.ndarray:
    """Number among the sampled positions of one of them."""
    return position // V * len(COVER) + _PLACE[position % V]


def _grid(first: np.ndarray, size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(position, period) of all grid points of texts that start at `first`: for each period every (TIMES - 1) periods. A run of period p has at least TIMES - 1
    periods of words that equal the word p further on, so one of them is a grid point."""
    most = np.where(size >= LEAST, size // TIMES, 0)
    ends = np.cumsum(most)
    text = np.repeat(np.arange(len(size)), most)
    period = np.arange(len(text)) - (ends - most)[text] + 1
    many = (size[text] - period - 1) // ((TIMES - 1) * period) + 1
    total = np.cumsum(many)
    lo = 0
    while lo < len(text):
        hi = max(lo + 1, int(np.searchsorted(total, total[lo] - many[lo] + GRID, "right")))
        own = np.repeat(np.arange(lo, hi), many[lo:hi])
        step = np.arange(len(own)) - (total[own] - many[own] - (total[lo] - many[lo]))
        yield first[text[own]] + step * (TIMES - 1) * period[own], period[own]
        lo = hi


def runs_of(texts: list[np.ndarray], words: int) -> list[np.ndarray]:
    """For each text (ids from 1 to `words`) its runs as rows (start, length, period) in order of start, then period."""
    none = np.zeros((0, 3), np.int64)
    size = np.array([len(x) for x in texts], np.int64)
    if not len(size) or size.max() < LEAST:
        return [none] * len(texts)
    apart = np.arange(words + 1, words + len(texts) + 2, dtype=np.int64)  # a separator before, between and after the texts
    s = np.concatenate([np.concatenate([apart[k : k + 1], x]) for k, x in enumerate(texts)] + [apart[-1:]])
    first = np.cumsum(size + 1) - size
    hits = [(at[same], p[same]) for at, p in _grid(first, size) if (same := s[at] == s[at + p]).any()]
    if not hits:
        return [none] * len(texts)
    at, period = (np.concatenate(x) for x in zip(*hits, strict=True))
    back = Extensions(s[::-1]).of(len(s) - at, len(s) - at - period)
    near = (back > 0) | (period == 1) | (s[at + 1] == s[at + 1 + period])  # else a stretch of one word
    at, period, back = at[near], period[near], back[near]
    start = at - back
    length = back + Extensions(s).of(at, at + period) + period
    fine = length >= np.maximum(LEAST, TIMES * period)
    start, length, period = start[fine], length[fine], period[fine]
    turn = np.lexsort((period, length, start))
    start, length, period = start[turn], length[turn], period[turn]
    keep = np.ones(len(start), bool)  # the same stretch at a multiple of its period, or from another grid point
    keep[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    start, length, period = start[keep], length[keep], period[keep]
    turn = np.lexsort((period, start))
    start, length, period = start[turn], length[turn], period[turn]
    text = np.searchsorted(first, start, "right") - 1
    rows = np.column_stack([start - first[text], length, period])
    return np.split(rows, np.searchsorted(text, np.arange(1, len(texts))))


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of n words stay when each run is cut to its first period."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(edge[:-1]) == 0


class _Ids(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self) + 1
        return n

    def of(self, text: bytes) -> np.ndarray:
        parts, at = [], 0
        while at < len(text):
            end = min(len(text), at + PIECE)
            while end < len(text) and text[end : end + 1].strip():  # to the end of the word
                end += 1
            own = text[at:end].split()  # of bytes: at space and U+0009 to U+000D
            parts.append(np.fromiter(map(self.__getitem__, own), np.int64, len(own)))
            at = end
        return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = 0
        for group in chunks(map(utf8, batch.column(1).to_pylist()), GROUP):
            ids = _Ids()
            texts = [ids.of(x) for x in group]
            found = runs_of(texts, len(ids))
            words = [b"", *ids]
            short = [b" ".join(map(words.__getitem__, (x[kept_words(len(x), r)] if len(r) else x).tolist())) for x, r in zip(texts, found, strict=True)]
            rows, many = np.concatenate(found), [len(r) for r in found]
            spans = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(many)]), pa.int32()), pa.StructArray.from_arrays([pa.array(rows[:, k]) for k in range(3)], fields=list(RUNS.value_type)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(group)), pa.array([len(x) for x in texts], pa.int64()), spans.cast(RUNS), pa.array(short, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "runs", "collapsed"])
            at += len(group)


def periodic_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) for every row of docs: the runs of its whole text as (start, length, period) in words, by start, then period, and its words joined
    by single spaces after each run is cut to its first period.

    A run is a stretch of words that equal the word q further on, q the smallest such distance, of at least 4 q and 6 words, that no neighbouring word extends. Null
    and blank texts have no words and no runs. Equal rows give equal rows; other columns play no part, whatever their names. An empty table gives an empty one.
    """
    rows = docs.select(F.col("doc_id"), F.col("text").cast("string"))
    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(lambda batches: trimmed(_search(batches)), f"doc_id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def with_periodic_tails(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) with the words of about one text in ten rewritten: for h = crc32 of the decimal doc_id, where 10 divides h, each word from a on becomes word
    a + (i - a) mod p; g = floor(h / 10), a = g mod n, p = 1 + floor((n - a) / (3 + g mod 8)). Rows without words or without id stay as they are."""
    rows = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"), F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("h"))
    marked = F.col("h") % 10 == 0
    rows = rows.withColumn("words", F.when(marked, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))))
    n, g = F.size("words"), F.floor(F.col("h") / 10)
    rows = rows.withColumn("n", n).withColumn("a", F.when(n > 0, g % n).cast("int")).withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + g % 8))).cast("int"))
    left = F.col("n") - F.col("a")
    block = F.slice("words", F.col("a") + 1, F.col("p"))
    tail = F.slice(F.flatten(F.array_repeat(block, F.ceil(left / F.col("p")).cast("int"))), F.lit(1), left)
    return rows.select("doc_id", F.when(F.coalesce(marked & (F.col("n") > 0), F.lit(False)), F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a")), tail), " ")).otherwise(F.col("text")).alias("text"))


def digest(found: DataFrame) -> DataFrame:
    """periodic_runs() rows as (doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256): the run of greatest length / period, compared exactly
    (of equal ones the first by start, then period; nulls without a run), and hashes of the list of runs and of the collapsed text."""
    better = lambda best, r: F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best)
    best = F.aggregate("runs", F.lit(None).cast("struct<start:long,length:long,period:long>"), better)
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    rows = found.withColumn("best", best)
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
