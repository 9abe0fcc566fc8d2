"""Quality rules: a linear-chain conditional random field labels each line of a text as content or boilerplate; Viterbi decoding finds the likeliest labels
of all lines together, and the share of words in content lines decides whether a document is kept.

Labelled are documents, not lines. So the lines of labelled documents get labels of their own: at first by evidence of each line alone (how much more frequent its
features are in good documents), later by the field fitted on the labels before. A document's label is a constraint: more than half of the words of a good one, and
less than half of a bad one, are in content lines; lines change sides in order of their evidence until that holds. Fitting and labelling take turns TURNS times.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.llm.common import trim, trimmed, utf8, word_hashes

#: Labelled documents that the field is fitted on, at most (drawn by a hash of doc_id).
SAMPLE = 1500
#: Least share of a kept document's words that are in content lines.
CONTENT = 0.5
STEPS, RATE, PENALTY, TURNS = 60, 0.15, 2e-3, 3
#: Lines of a chain in fitting, at most: longer documents are several chains, so a step goes over many chains at once. Decoding doesn't cut.
CHAIN = 64

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOLS = re.compile(r"[#*$%&|<>]")
NOISE = re.compile(r"[#*$%&|<>!?{}=~^_\\]")
DIGITS = re.compile(r"[0-9]")
#: Limits of the classes of each feature of a line: number of words; noise characters a word; share of distinct words; share of words in capitals;
#: digits a word; mean word length; 1 if an earlier line is equal.
LIMITS = ((2, 4, 9, 25), (0.02, 0.15, 0.5, 0.9), (0.2, 0.4, 0.7), (0.3, 0.8), (0.2, 1.0), (2.5, 12.0), (0.5,))
CLASSES = [len(x) + 1 for x in LIMITS]
OFFSETS = np.cumsum([0, *CLASSES[:-1]])


def line_features(text: str) -> tuple[list[tuple], list[int]]:
    """The features of each line that has a word, and its number of words."""
    found, sizes, seen = [], [], set()
    for line in text.split("\n"):
        words = WORDS.findall(line)
        n = len(words)
        if n:
            found.append((n, len(NOISE.findall(line)) / n, len(set(words)) / n, sum(map(str.isupper, words)) / n if n > 2 else 0, len(DIGITS.findall(line)) / n, len(line) / n - 1, line in seen))
            sizes.append(n)
            seen.add(line)
    return found, sizes


def binned(lines: list[tuple]) -> np.ndarray:
    """For each line and feature the number of its indicator."""
    table = np.array(lines, np.float64).reshape(-1, len(LIMITS))
    return np.stack([np.searchsorted(x, table[:, k], side="right") + OFFSETS[k] for k, x in enumerate(LIMITS)], axis=1)


class Chains:
    """The lines of several chains in one flat array, chain after chain. at(t): the places of the t-th lines of all chains that are so long; these chains are the first
    ones in order of falling length, so `n` of them have more than t lines."""

    def __init__(self, lengths):
        lengths = np.asarray(lengths, np.int64)
        order = np.argsort(-lengths, kind="stable")
        self.size, self.first = lengths[order], (np.cumsum(lengths) - lengths)[order]
        self.longest = int(self.size[0]) if len(self.size) else 0
        self.alive = np.searchsorted(-self.size, -np.arange(self.longest), side="left")

    def at(self, t: int) -> np.ndarray:
        return self.first[: self.alive[t]] + t


@dataclass
class Field:
    """emit: indicator x label; move: label x label; label 1 is content."""

    emit: np.ndarray
    move: np.ndarray

    def decode(self, indicators: np.ndarray, lengths: list[int]) -> np.ndarray:
        """The likeliest labels of the lines of several documents."""
        chains, scores = Chains(lengths), self.emit[indicators].sum(axis=1)
        labels, back = np.ones(len(scores), np.int64), np.zeros((len(scores), 2), np.int8)
        best = np.zeros((len(chains.size), 2))
        for t in range(chains.longest):
            at = chains.at(t)
            n = len(at)
            if t:
                paths = best[:n, :, None] + self.move[None]
                back[at] = paths.argmax(axis=1)
                best[:n] = paths.max(axis=1)
            best[:n] += scores[at]
        state = best.argmax(axis=1)
        for t in range(chains.longest - 1, -1, -1):
            at = chains.at(t)
            n = len(at)
            labels[at] = state[:n]
            if t:
                state[:n] = back[at, state[:n]]
        return labels

    def marginals(self, indicators: np.ndarray, chains: Chains, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities of the labels of each line (forward-backward), and the weighted sum of those of neighbours' label pairs; a pair has its later line's weight."""
        score = self.emit[indicators].sum(axis=1)
        ahead, behind, pairs = score.copy(), np.zeros_like(score), np.zeros((2, 2))
        for t in range(1, chains.longest):
            at = chains.at(t)
            ahead[at] += np.logaddexp(ahead[at - 1, 0, None] + self.move[0], ahead[at - 1, 1, None] + self.move[1])
        for t in range(chains.longest - 1, 0, -1):
            at = chains.at(t)
            tail = score[at] + behind[at]
            behind[at - 1] = np.logaddexp(self.move[:, 0] + tail[:, 0, None], self.move[:, 1] + tail[:, 1, None])
            both = ahead[at - 1, :, None] + self.move + tail[:, None, :]
            both = np.exp(both - both.max(axis=(1, 2), keepdims=True))
            pairs += (both * (weight[at] / both.sum(axis=(1, 2)))[:, None, None]).sum(axis=0)
        node = ahead + behind
        node = np.exp(node - node.max(axis=1, keepdims=True))
        return node / node.sum(axis=1, keepdims=True), pairs


def cut_chains(lengths: list[int]) -> Chains:
    return Chains([min(CHAIN, n - lo) for n in lengths for lo in range(0, n, CHAIN)])


def fit(indicators: np.ndarray, labels: np.ndarray, weight: np.ndarray, lengths: list[int], start: Field | None = None) -> Field:
    """Field of greatest penalised likelihood for labelled lines of several documents, by gradient steps of adaptive size from `start`. Arrays are flat: memory is in
    proportion to the lines."""
    chains = cut_chains(lengths)
    width = sum(CLASSES)
    inner = np.ones(len(labels), bool)
    inner[chains.first] = False
    later = np.flatnonzero(inner)
    truth = np.bincount(labels[later - 1] * 2 + labels[later], weight[later], 4).reshape(2, 2)
    params = np.zeros(width * 2 + 4) if start is None else np.concatenate([start.emit.ravel(), start.move.ravel()])
    first, second = 0.0, 0.0
    rows = np.arange(len(labels))
    for step in range(1, STEPS + 1):
        node, pairs = Field(params[:-4].reshape(width, 2), params[-4:].reshape(2, 2)).marginals(indicators, chains, weight)
        node[rows, labels] -= 1
        node *= weight[:, None]
        emit = np.stack([np.bincount(indicators.ravel(), np.repeat(node[:, y], len(LIMITS)), width) for y in (0, 1)], axis=1)
        grad = np.concatenate([emit.ravel(), (pairs - truth).ravel()]) + PENALTY * params
        first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad * grad
        params = params - RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return Field(params[:-4].reshape(width, 2), params[-4:].reshape(2, 2))


def constrained(evidence: np.ndarray, sizes: np.ndarray, lengths: list[int], good: np.ndarray) -> np.ndarray:
    """Labels of lines: content (1) where evidence is above 0. If half of a good document's words or more aren't content then, further lines become content, those of
    most evidence first; likewise boilerplate in a bad one, those of least evidence first."""
    labels = (evidence > 0).astype(np.int64)
    for lo, hi, fine in zip(np.cumsum([0, *lengths[:-1]]), np.cumsum(lengths), good, strict=True):
        own = labels[lo:hi] if fine else 1 - labels[lo:hi]
        words = sizes[lo:hi]
        if 2 * (own * words).sum() <= words.sum():
            order = np.argsort(-evidence[lo:hi] if fine else evidence[lo:hi], kind="stable")
            enough = int(np.searchsorted(2 * np.cumsum(words[order]), words.sum(), side="right")) + 1
            labels[lo:hi][order[:enough]] = int(fine)
    return labels


def fit_documents(documents: list[tuple[np.ndarray, np.ndarray, int]]) -> Field:
    """A field for documents (indicators of each line, words of each line, label of the document), whose lines get labels of their own."""
    indicators = np.concatenate([d[0] for d in documents])
    sizes = np.concatenate([d[1] for d in documents]).astype(np.float64)
    lengths = [len(d[0]) for d in documents]
    good = np.array([d[2] for d in documents])
    words = np.add.reduceat(sizes, np.cumsum([0, *lengths[:-1]]))
    own = 1 / np.bincount(good, minlength=2)[good] / 2  # a document, and either label, counts alike
    weight = np.repeat(own / words, lengths) * sizes
    seen = [np.bincount(indicators.ravel(), np.repeat(weight * (np.repeat(good, lengths) == y), len(LIMITS)), sum(CLASSES)) for y in (0, 1)]
    evidence = np.log((seen[1] + 1e-4) / (seen[0] + 1e-4))[indicators].sum(axis=1)
    field = None
    for _ in range(TURNS):
        field = fit(indicators, constrained(evidence, sizes, lengths, good), weight, lengths, field)
        node, _ = field.marginals(indicators, cut_chains(lengths), weight)
        evidence = np.log((node[:, 1] + 1e-12) / (node[:, 0] + 1e-12))
    return field


def learn(docs: DataFrame, labels: DataFrame) -> Field | None:
    """A field fitted on at most SAMPLE labelled documents, whole texts. None if there aren't documents of both labels; then the rules alone decide. Of a doc_id with
    several labels the best counts; of one with several texts the one whose hash is least."""
    drawn = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("quality").cast("int")).alias("quality"))
    drawn = drawn.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)

    def lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [line_features(t) for t in batch.text]
            yield pd.DataFrame({"doc_id": batch.doc_id, "quality": batch.quality, "draw": batch.draw, "marks": [binned(x).astype("<i2").tobytes() for x, _ in found], "sizes": [np.array(n, "<i4").tobytes() for _, n in found]})

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(F.col("text").isNotNull()).withColumn("draw", F.xxhash64("text"))
    rows = texts.join(F.broadcast(drawn), "doc_id").mapInPandas(lines, "doc_id long, quality int, draw long, marks binary, sizes binary")  # SAMPLE rows at most but for repeated ids
    rows = rows.groupBy("doc_id").agg(F.min_by(F.struct("quality", "marks", "sizes"), F.struct("draw", "sizes", "marks")).alias("d")).select("doc_id", "d.*").orderBy("doc_id")
    found = [(np.frombuffer(r.marks, "<i2").reshape(-1, len(LIMITS)).astype(np.int64), np.frombuffer(r.sizes, "<i4"), int(r.quality > 0)) for r in rows.collect()]
    found = [x for x in found if len(x[0])]
    return fit_documents(found) if {x[2] for x in found} == {0, 1} else None


def repeated_words(hashes: np.ndarray) -> int:
    """Words inside three-word windows that are found twice or more in the text."""
    n = len(hashes) - 2
    if n < 2:
        return 0
    with np.errstate(over="ignore"):
        windows = hashes[:n] * np.uint64(3) + hashes[1 : n + 1] * np.uint64(0x9E3779B97F4A7C15) + hashes[2 : n + 2] * np.uint64(0xC2B2AE3D27D4EB4F)
    _, which, counts = np.unique(windows, return_inverse=True, return_counts=True)
    twice = counts[which] > 1
    if not twice.any():
        return 0
    inside = np.zeros(len(hashes), bool)
    for k in range(3):
        inside[k : n + k] |= twice
    return int(inside.sum())


FIGURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def judge(texts: list, field: Field | None) -> pd.DataFrame:
    """FIGURES, base_failed, content_share and kept of each text."""
    rows, lines, lengths, sizes = [], [], [], []
    for text in texts:
        text = text if isinstance(text, str) else ""
        blob = utf8(text)
        hashes, _ = word_hashes([blob], lower=False)
        found, own = line_features(text)
        lines += found
        lengths.append(len(found))
        sizes += own
        codes = np.frombuffer(blob, np.uint8)
        spaces = int(((codes == 32) | ((codes >= 9) & (codes <= 13))).sum())
        rows.append((len(hashes), len(text) - spaces, len(SYMBOLS.findall(text)), sum(x[-1] for x in found), repeated_words(hashes)))
    out = pd.DataFrame(rows, columns=FIGURES, dtype="int64")
    out["base_failed"] = (out.n_words < 50) | (100 * out.n_repeat_words > 50 * out.n_words)
    content = field.decode(binned(lines), lengths) if field is not None else np.ones(len(lines))
    sums = np.concatenate(([0], np.cumsum(content * np.array(sizes, np.float64))))
    ends = np.cumsum([0, *lengths])
    out["content_share"] = (sums[ends[1:]] - sums[ends[:-1]]) / np.maximum(out.n_words, 1)
    out["kept"] = ~out.base_failed & (out.content_share >= CONTENT)
    return out


def assess(docs: DataFrame, field: Field | None) -> DataFrame:
    """doc_id, FIGURES, base_failed, kept, content_share for every row of docs (doc_id, text). Null, empty and blank texts have no words and fail. Whole texts
    are judged, however long. Other columns are ignored."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in trimmed(batches):
            for lo in range(0, len(batch), 500):
                part = batch.iloc[lo : lo + 500]
                found = judge(part.text.tolist(), field)
                found.insert(0, "doc_id", part.doc_id.astype("Int64").to_numpy())
                yield found.assign(doc_id=pd.array(found.doc_id, "Int64"))[["doc_id", *FIGURES, "base_failed", "kept", "content_share"]]

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInPandas(run, "doc_id long, " + ", ".join(f"{x} long" for x in FIGURES) + ", base_failed boolean, kept boolean, content_share double")


def good(docs: DataFrame, field: Field | None) -> DataFrame:
    """The rows of docs that assess() keeps; all columns stay."""

    @F.pandas_udf(T.BooleanType())
    def kept(text: pd.Series) -> pd.Series:
        found = pd.concat([judge(text.iloc[lo : lo + 500].tolist(), field).kept for lo in range(0, len(text), 500)], ignore_index=True) if len(text) else pd.Series([], dtype=bool)
        trim()
        return found

    return docs.where(kept(F.col("text").cast("string")))
