"""Grouping of spelling variants: words at one edit from each other, found by search schemes over FM-indexes of the vocabulary.

A word within one edit of a query has one half of the query unchanged: its first half at the start, or its second half at the end. So two searches find all: match a half
exactly, then extend across the other half allowing one error. Of the two directions of the index each search needs one: words are indexed forwards for the search that
starts with the second half and extends to the left, and reversed for the one that starts with the first half. The vocabulary is dealt to many indexes by the letters at
the start or the end, which a query shares with whatever the search can find.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import trim, trimmed, utf8, written

RUN = re.compile("[a-zÀ-ÿ]+")
#: Words have so many letters at least, and occur so often.
LETTERS, OCCURRENCES = 7, 2
#: A form is so many times as frequent as its variant.
RATIO = 10
#: Letters by which words are dealt to indexes: no more than the shorter half of a word has.
EDGE = LETTERS // 2
#: Words of an index, about; an edge with more words than CROWDED is dealt by whole halves instead.
SHARD, CROWDED = 20_000, 50_000
#: Words that a task counts before it hands its counts on.
HELD = 300_000
#: Queries that a search takes in one go.
QUERIES = 8192


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, int] = {}

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])
        held.clear()
        return out

    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            own: dict[str, int] = {}
            for word in RUN.findall(utf8(text).lower().decode("utf-8", "surrogatepass")):  # of bytes: A-Z only
                if len(word) >= LETTERS:
                    own[word] = own.get(word, 0) + 1
            name = f"{'' if doc_id is None else doc_id}:"
            for word, n in own.items():
                h = zlib.crc32((name + word).encode())
                if h % 31 == 0:
                    k = h % len(word)
                    word = word[:k] + word[k + 1 :]
                    if len(word) < LETTERS:
                        continue
                held[word] = held.get(word, 0) + n
            if len(held) >= HELD:
                yield flush()
    yield flush()
    trim()


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n): the lower-cased runs of letters of all whole texts, of at least LETTERS letters, that occur at least OCCURRENCES times in all; where the checksum of
    `<doc_id>:<run>` is a multiple of 31, a run counts without one of its letters. Null texts have none; a null doc_id stands as an empty one."""
    rows = docs.select(F.col("doc_id").cast("string"), F.col("text").cast("string"))
    return rows.mapInArrow(_count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= OCCURRENCES)


class Index:
    """FM-index of a list of different words of one-byte letters, each followed by a delimiter. Row r is the r-th suffix in order; delimiters are told apart by their word,
    so suffixes that end words alike stand in the order of their words.

    `steps` has (letter before the row, row) in order, as one number: the place of (c, r) in it is the row at which suffixes c + suffix start, for suffixes from row r on.
    """

    def __init__(self, words: list[bytes]):
        text = np.frombuffer(b"\0".join(words) + b"\0", np.uint8)
        size, count = len(text), len(words)
        ends = np.flatnonzero(text == 0)
        rank = text.astype(np.int64) + count
        rank[ends] = np.arange(count)
        top, step = int(rank.max()) + 1, 1
        while True:  # doubling; a delimiter's rank is its own, so no comparison reaches the next word
            key = rank * top
            key[:-step] += rank[step:]
            order = np.argsort(key, kind="stable")
            new = np.ones(size, np.int64)
            new[1:] = key[order][1:] != key[order][:-1]
            rank = np.empty(size, np.int64)
            rank[order] = np.cumsum(new) - 1
            if new.all() or step >= size:
                break
            top, step = size, step * 2
        before = text[order - 1]  # of the first letter of all: the last delimiter
        rows = np.argsort(before, kind="stable")
        self.size, self.count, self.before = size, count, before
        self.steps = before[rows].astype(np.int64) * size + rows
        self.letters = np.unique(text[text > 0]).astype(np.int64)
        self.word = np.searchsorted(ends, order[rows[:count]])  # of rows that begin a word

    def step(self, letter, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows of letter + suffix, for the suffixes of rows lo to hi."""
        return np.searchsorted(self.steps, letter * self.size + lo), np.searchsorted(self.steps, letter * self.size + hi)

    def branches(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(number of the interval, letter, lo, hi) of every letter that stands before a suffix of an interval: of narrow intervals their rows are read, for wide ones every letter
        is tried."""
        wide = hi - lo > len(self.letters)
        narrow = np.flatnonzero(~wide)
        many = (hi - lo)[narrow]
        row = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many - lo[narrow], many)
        pairs = np.unique(np.repeat(narrow, many) * 256 + self.before[row])
        pairs = np.concatenate([pairs[pairs % 256 > 0], (np.flatnonzero(wide)[:, None] * 256 + self.letters).ravel()])
        of, letter = pairs // 256, pairs % 256
        lo, hi = self.step(letter, lo[of], hi[of])
        some = hi > lo
        return of[some], letter[some], lo[some], hi[some]

    def near(self, queries: list[bytes], exact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All (query, word), by number, where the word comes from the query by one insertion, deletion or replacement to the left of the query's last `exact` letters."""
        size = np.array([len(q) for q in queries])
        letters = np.zeros((len(queries), int(size.max(initial=0)) + 1), np.int64)
        for k, q in enumerate(queries):
            letters[k, : len(q)] = np.frombuffer(q, np.uint8)
        own, lo, hi = np.arange(len(queries)), np.zeros(len(queries), np.int64), np.full(len(queries), self.count)
        at = size.copy()  # letters to the left that aren't matched yet
        waiting, found = [], []
        while len(own):  # exact half
            ready = size[own] - at[own] == exact[own]
            waiting.append((own[ready], lo[ready], hi[ready]))
            own, lo, hi = own[~ready], lo[~ready], hi[~ready]
            at[own] -= 1
            lo, hi = self.step(letters[own, at[own]], lo, hi)
            some = hi > lo
            own, lo, hi = own[some], lo[some], hi[some]
        own, lo, hi = (np.concatenate(x) for x in zip(*waiting, strict=True))
        at = at[own]
        while len(own):
            of, letter, blo, bhi = self.branches(lo, hi)
            wrong = (at[of] > 0) & (letter != letters[own[of], at[of] - 1])
            skip = at > 0
            found.append(self._finish(
                letters,
                np.concatenate([own[of], own[of][wrong], own[skip]]),  # one letter more, another letter, one letter less
                np.concatenate([blo, blo[wrong], lo[skip]]), np.concatenate([bhi, bhi[wrong], hi[skip]]),
                np.concatenate([at[of], at[of][wrong] - 1, at[skip] - 1]),
            ))
            own, lo, hi, at = own[skip], lo[skip], hi[skip], at[skip] - 1
            lo, hi = self.step(letters[own, at], lo, hi)
            some = hi > lo
            own, lo, hi, at = own[some], lo[some], hi[some], at[some]
        pairs = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        return pairs // self.count, pairs % self.count

    def _finish(self, letters, own, lo, hi, at) -> np.ndarray:
        """Extends without further errors to the words' starts."""
        done = []
        while len(own):
            over = at == 0
            first, last = self.step(0, lo[over], hi[over])
            whole = last > first  # the words differ, so there is one
            done.append(own[over][whole] * self.count + self.word[first[whole]])
            own, lo, hi, at = own[~over], lo[~over], hi[~over], at[~over] - 1
            lo, hi = self.step(letters[own, at], lo, hi)
            some = hi > lo
            own, lo, hi, at = own[some], lo[some], hi[some], at[some]
        return np.concatenate(done) if done else np.zeros(0, np.int64)


NEAR = "word string, n_near long, best_n long, best string"


def _search(rows: pd.DataFrame) -> pd.DataFrame:
    """Of the words and queries of one index and side: for each query with near words their number, and the most frequent of them."""
    out = {"word": [], "n_near": [], "best_n": [], "best": []}
    first = rows.side.iloc[0] == 0
    words, queries = rows[~rows.asks], rows[rows.asks]
    if len(words) and len(queries):
        text, n = words.word.to_numpy(), words.n.to_numpy()
        turn = np.argsort(text.astype(str), kind="stable")
        text, n = text[turn], n[turn]
        place = np.lexsort((np.arange(len(text)), -n))
        order = np.empty(len(place), np.int64)  # the most frequent first; of equal ones the first in code-point order
        order[place] = np.arange(len(place))

        def letters(word: str) -> bytes:
            return (word[::-1] if first else word).encode("latin-1")

        index = Index([letters(w) for w in text])
        asked = queries.word.to_numpy()
        for lo in range(0, len(asked), QUERIES):
            part = asked[lo : lo + QUERIES]
            half = np.array([len(w) // 2 for w in part])
            own, hit = index.near([letters(w) for w in part], half if first else np.array([len(w) for w in part]) - half)
            if not first:  # those that share the first half too are found on the other side
                new = np.array([not text[b].startswith(part[a][: half[a]]) for a, b in zip(own.tolist(), hit.tolist(), strict=True)], bool)
                own, hit = own[new], hit[new]
            if not len(own):
                continue
            starts = np.flatnonzero(np.append(True, own[1:] != own[:-1]))  # near() gives them in order of the query
            best = place[np.minimum.reduceat(order[hit], starts)]
            out["word"].append(part[own[starts]])
            out["n_near"].append(np.diff(np.append(starts, len(own))))
            out["best_n"].append(n[best])
            out["best"].append(text[best])
    trim()
    return pd.DataFrame({k: np.concatenate(v) if v else np.array([], object if k in ("word", "best") else np.int64) for k, v in out.items()})


def near_words(words: DataFrame, crowded: int = CROWDED, shard: int = SHARD) -> DataFrame:
    """(word, n, n_near, best_n, best) for each row of words (word, n; a stored table, read several times): how many other words are one edit away, and the most frequent of
    them (of equal ones the first in code-point order; nulls if there is none)."""
    shards = math.ceil(words.count() / shard) or 1
    sides = words.select("word", "n", F.explode(F.array(F.lit(0), F.lit(1))).alias("side"))
    size = F.length("word")

    def edge(letters):
        return F.when(F.col("side") == 0, F.substring("word", 1, letters) if isinstance(letters, int) else F.expr(f"left(word, {letters})")).otherwise(F.expr(f"right(word, {letters})"))

    full = sides.groupBy("side", edge(EDGE).alias("edge")).count().where(F.col("count") > crowded).select("side", "edge", F.lit(True).alias("crowded"))  # at most a row for each `crowded` words
    sides = sides.withColumn("edge", edge(EDGE)).join(F.broadcast(full), ["side", "edge"], "left")
    # A word of m letters is found with halves of the queries of m - 1 to m + 1 letters: floor(m / 2) first ones, the others last.
    halves = F.when(F.col("side") == 0, F.array(F.floor((size - 1) / 2), F.floor((size + 1) / 2))).otherwise(F.array(F.ceil((size - 1) / 2), F.ceil((size + 1) / 2)))
    own = F.when(F.col("side") == 0, F.floor(size / 2)).otherwise(F.ceil(size / 2))
    crowd = F.col("crowded").isNotNull()
    indexed = sides.select("word", "n", "side", "edge", "crowded", F.explode(F.when(crowd, halves).otherwise(F.array(F.lit(EDGE).cast("long")))).alias("letters"), F.lit(False).alias("asks"))
    asked = sides.select("word", "n", "side", "edge", "crowded", F.when(crowd, own).otherwise(F.lit(EDGE).cast("long")).alias("letters"), F.lit(True).alias("asks"))
    key = F.xxhash64("side", F.when(crowd, edge("cast(letters as int)")).otherwise(F.col("edge")), "letters")
    dealt = indexed.unionByName(asked).select("word", "n", "side", "asks", F.pmod(key, F.lit(shards)).alias("shard"))
    found = dealt.groupBy("side", "shard").applyInPandas(_search, NEAR)
    every = words.select("word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("long").alias("best_n"), F.lit(None).cast("string").alias("best"))
    both = every.unionByName(found.select("word", F.lit(None).cast("long").alias("n"), "n_near", "best_n", "best"))
    best = F.min(F.when(F.col("best").isNotNull(), F.struct((-F.col("best_n")).alias("k"), F.col("best").alias("w"))))
    return both.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n", "n_near", (-F.col("b.k")).alias("best_n"), F.col("b.w").alias("best"))


def spelling_variants(docs: DataFrame) -> DataFrame:
    """(word, n, form, root, n_near, form_n) for each word of vocabulary(docs): `form` is its most frequent near word (of equal ones the first in code-point order) if that
    is RATIO times as frequent, else null; `root` the end of the chain of forms, the word itself without a form; n_near counts its near words. Without words, no rows.
    Repeated rows of docs count again; columns other than doc_id and text play no part, whatever their names."""
    words = written(vocabulary(docs), "words")
    near = near_words(words).withColumn("form", F.when(F.col("best_n") >= RATIO * F.col("n"), F.col("best")))
    near = written(near.select("word", "n", "form", "n_near", F.when(F.col("form").isNotNull(), F.col("best_n")).alias("form_n")), "near")
    roots = near.where("form is not null").select("word", F.col("form").alias("root"))
    most = near.agg(F.max("n")).first()[0] or 1
    for _ in range(math.ceil(math.log2(max(2.0, math.log10(most) + 1)))):  # a chain gains a factor RATIO with each form
        roots = written(roots, "roots")
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        roots = roots.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"))
    return near.join(roots, "word", "left").select("word", "n", "form", F.coalesce("root", "word").alias("root"), "n_near", "form_n")
