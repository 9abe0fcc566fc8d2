"""Language identification, words first: a known word scores by its log frequency in each language; an unseen one by the longest character n-grams of it that are known."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.llm.common import held, trim, trimmed

#: Labelled documents to learn from: about so many in all, the same number of each language (drawn by a hash of doc_id), but LEAST of each language if it has them.
SAMPLE, LEAST = 6000, 20
LONGEST = 5
#: A text's mean word score counts as that of so many words at most, so that the posterior says something of long texts too.
WEIGHT = 25
#: Unseen words whose n-grams a worker remembers.
CACHE = 100_000
WORD = re.compile(r"[^\W\d_]+")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2, F.lit(False))


def grams(word: str, n: int) -> list[str]:
    """Character n-grams of a word with its ends marked."""
    marked = f"<{word}>" if n > 1 else word
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


class Model:
    """Log frequencies of entries: words, and character n-grams of each length. An entry's frequency in a language is (count + 1/2) / (total + 1). Only the languages that
    have an entry are stored with it, as log(2 count + 1); what all others have, log(1/2 / (total + 1)), is one table, `floors`, of a row for each length (0: words).

    words, grams: entry -> number; its languages and scores stand at starts[number] to starts[number + 1] of langs and gains.
    """

    def __init__(self, languages: list[str], counts: list[tuple[str, int, str, int]]):
        place = {x: k for k, x in enumerate(languages)}
        rows = sorted((n, entry, place[lang], count) for lang, n, entry, count in counts)
        n, entries, langs, count = zip(*rows, strict=True) if rows else ((), (), (), ())
        self._set(languages, np.array(n, np.int64), np.array(entries, object), np.array(langs, np.int32), np.array(count, np.int64))

    @classmethod
    def of(cls, languages: list[str], n, entries, langs, counts) -> Model:
        """From arrays in order of (n, entry)."""
        self = cls.__new__(cls)
        self._set(languages, n, entries, langs, counts)
        return self

    def _set(self, languages, n, entries, langs, counts) -> None:
        self.languages, size = languages, len(languages)
        totals = np.bincount(n * size + langs, counts, (LONGEST + 1) * size).reshape(-1, size) if size else np.zeros((LONGEST + 1, 0))
        self.floors = np.log(0.5 / (totals + 1.0))
        self.langs, self.gains = langs.astype(np.int32), np.log(2.0 * counts + 1.0).astype(np.float32)
        new = np.ones(len(n), bool)
        new[1:] = (n[1:] != n[:-1]) | (entries[1:] != entries[:-1])
        first = np.flatnonzero(new)
        self.starts = np.append(first, len(n)).astype(np.int64)
        cut = int(np.searchsorted(n[first], 1))
        self.words = dict(zip(entries[first[:cut]].tolist(), range(cut), strict=True))
        self.grams = dict(zip(entries[first[cut:]].tolist(), range(cut, len(first)), strict=True))


class Scorer:
    """Scores texts with a model; the n-grams of unseen words are remembered."""

    def __init__(self, model: Model):
        self.model, self.at = model, {}
        self.floors = np.vstack([model.floors, np.zeros_like(model.floors[:1])])  # the last: words of which nothing is known

    def unseen(self, word: str) -> tuple[int, tuple[int, ...]]:
        """The greatest length of which the word has known n-grams, and these; if there is none, LONGEST + 1."""
        known = self.model.grams.get
        found = LONGEST + 1, ()
        for n in range(min(LONGEST, len(word) + 2), 0, -1):
            rows = tuple(r for g in grams(word, n) if (r := known(g)) is not None)
            if rows:
                found = n, rows
                break
        if len(self.at) >= CACHE:
            self.at.clear()
        self.at[word] = found
        return found

    def predict(self, text) -> tuple[str, float]:
        """(language, probability); of languages that are equally likely the first by name."""
        words = Counter(WORD.findall(text.lower())) if isinstance(text, str) else {}
        if not words or not self.model.languages or not (any(map(str.isalpha, words)) or any(c.isalpha() for w in words for c in w)):
            return "und", 0.0
        m, known, at = self.model, self.model.words.get, self.at.get
        rows, weights, kinds = [], [], [0.0] * (LONGEST + 2)
        for word, count in words.items():
            row = known(word)
            if row is not None:
                rows.append(row)
                weights.append(count)
                kinds[0] += count
            else:
                n, own = at(word) or self.unseen(word)
                kinds[n] += count
                if own:
                    rows += own
                    weights += [count / len(own)] * len(own)
        total = sum(kinds)
        score = np.array(kinds) @ self.floors
        if rows:
            lo = m.starts[rows]
            many = m.starts[1:][rows] - lo
            ends = np.cumsum(many)
            cells = np.arange(ends[-1]) + np.repeat(lo - ends + many, many)
            score += np.bincount(m.langs[cells], m.gains[cells] * np.repeat(weights, many), len(m.languages))
        score *= min(total, WEIGHT) / total
        odds = np.exp(score - score.max())
        best = int(odds.argmax())
        return m.languages[best], float(odds[best] / odds.sum())


def learn(docs: DataFrame) -> Model:
    """Learns from text and non-null lang of documents that are not held out. Sizes of languages are counted over all, and every language is learnt; words and n-grams are
    counted over whole texts of the sample (SAMPLE, LEAST), which bounds what comes to the driver: only rows equal in id and text are drawn together, and
    they bring the same entries. Without labelled documents the model knows no language."""
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))).select(F.col("doc_id").alias("id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    sizes = labelled.groupBy("lang").count().orderBy("lang").collect()  # a row for each language
    if not sizes:
        return Model([], [])
    wanted = max(SAMPLE / len(sizes), LEAST)
    shares = docs.sparkSession.createDataFrame([(k, r.lang, min(1.0, wanted / r["count"])) for k, r in enumerate(sizes)], "place int, lang string, share double")
    drawn = labelled.join(F.broadcast(shares), "lang").where((F.pmod(F.xxhash64("id", "text"), F.lit(1 << 20)) + 1) / float(1 << 20) <= F.col("share"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            tables: dict[tuple[int, int], Counter] = {}
            for place, text in zip(batch.place, batch.text, strict=True):
                tables.setdefault((place, 0), Counter()).update(WORD.findall(text.lower()))
            for (place, _), words in [*tables.items()]:
                for n in range(1, LONGEST + 1):
                    table = tables[place, n] = Counter()
                    for w, k in words.items():
                        for g in grams(w, n):
                            table[g] += k
            for (place, n), table in tables.items():
                yield pd.DataFrame({"place": place, "n": n, "entry": table.keys(), "count": table.values()})

    counts = drawn.select("place", "text").mapInPandas(count, "place int, n int, entry string, count long").groupBy("n", "entry", "place").agg(F.sum("count").alias("count"))
    found = counts.orderBy("n", "entry", "place").toArrow()  # of the bounded sample
    n, entries, places, sums = (found.column(c).combine_chunks() if found.num_rows else found.column(c) for c in ("n", "entry", "place", "count"))
    model = Model.of([r.lang for r in sizes], np.asarray(n, np.int64), np.asarray(entries.to_pylist(), object), np.asarray(places, np.int32), np.asarray(sums, np.int64))
    del found, n, entries, places, sums
    trim()
    return model


def _scorer(shared) -> Scorer:
    return held(("langid", shared.value), lambda: Scorer(shared.value))  # the same value as long as a worker lives


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of docs (doc_id, text). A null text or one without a letter: `und` and 0. Other columns are ignored."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = _scorer(shared)
        for batch in trimmed(batches):
            found = [scorer.predict(t) for t in batch.text]
            yield pd.DataFrame({"doc_id": batch.doc_id.astype("Int64"), "held_out": batch.held_out, "lang_pred": [f[0] for f in found], "score": [f[1] for f in found]})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInPandas(run, "doc_id long, held_out boolean, lang_pred string, score double")


def identified(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows of docs whose language is known (not `und`) with a score of `least` or more; all columns stay."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample

    @F.pandas_udf(T.BooleanType())
    def known(text: pd.Series) -> pd.Series:
        scorer = _scorer(shared)
        found = [scorer.predict(t) for t in text]
        trim()
        return pd.Series([lang != "und" and score >= least for lang, score in found], dtype=bool)

    return docs.where(known(F.col("text").cast("string")))
