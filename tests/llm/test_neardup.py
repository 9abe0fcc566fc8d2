"""Near-duplicate groups against all pairs."""

import random
import re
import string

import numpy as np
import pytest

from tests.llm.conftest import CLASHES, SCHEMA, odd_rows, prose
from tidewell.llm import neardup

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def brute(rows, words, percent=80):
    sets = {}
    for d, t, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets[d] = {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()
    root = {d: d for d in sets if d is not None}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    ids = sorted(root)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(sets[d]), find(d)) for d in root}


def edited(rng, text, n):
    words = text.split(" ")
    for i in rng.sample(range(len(words)), n):
        words[i] = prose(rng, 1)
    return " ".join(words)


def cluster_rows():
    """Groups of edited copies, from light to beyond the limit; copies of copies; short texts; equal texts."""
    rng, rows = random.Random(9), []
    for size, length in ((160, 150), (25, 90), (12, 40), (8, 12), (6, 5)):
        base = prose(rng, length)
        copies = [edited(rng, base, min(length - 1, rng.randint(0, max(1, length // 10)))) for _ in range(size)]
        rows += copies + [edited(rng, c, min(length - 1, rng.randint(0, 3))) for c in copies[::4]]  # copies of copies share edits
        rows += [base.upper(), base]
    chain = prose(rng, 200)
    for _ in range(12):
        chain = edited(rng, chain, 4)
        rows.append(chain)
    rows += [prose(rng, 60) for _ in range(30)] + ["one two", "one two", "one", "two one"]
    rng.shuffle(rows)
    return [(k, t, "en", "s", len(t)) for k, t in enumerate(rows)]


@pytest.mark.parametrize("words", [4, 5])
def test_against_all_pairs(spark, words):
    rows = cluster_rows()
    got = neardup.near_duplicate_groups(spark.createDataFrame(rows, SCHEMA).repartition(5), words).collect()
    want = brute(rows, words)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert len({c for _, c in want.values()}) < len(rows) - 40


def test_odd(clashing, none):
    rows = odd_rows()
    got = neardup.near_duplicate_groups(clashing, 4).collect()
    want = brute(rows, 4)
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id) == want[r.doc_id]
    assert neardup.near_duplicate_groups(none).count() == 0
    left = neardup.without_near_duplicates(clashing, 4)
    assert left.columns == clashing.columns and set(CLASHES) <= set(left.columns)
    assert left.count() == sum(r.kept for r in got)
    assert neardup.without_near_duplicates(none).count() == 0


def test_components(spark):
    chain = [(k, k + 1) for k in range(1, 30)] + [(100, 50), (70, 100)]
    got = {r.node: r.root for r in neardup.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert all(got[k] == 1 for k in range(2, 31)) and got[100] == got[70] == 50


def test_sketch_collides_as_sets_agree():
    rng = np.random.default_rng(2)
    for n in (9, 20, 400):
        hits = 0
        for _ in range(200):
            a = rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2)
            b = a.copy()
            b[: max(1, n // 10)] = rng.integers(0, 1 << 63, max(1, n // 10), dtype=np.uint64)
            hits += bool((neardup.band_keys(np.sort(a)) == neardup.band_keys(np.sort(b))).any())
        assert hits >= 198


def by_row(rows, words, percent=80):
    """(n_shingles, component) of each row, all pairs of rows; rows of one doc_id are one document."""
    sets = []
    for _, t, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets.append({tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set())
    root = list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i, (d, *_) in enumerate(rows):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if d is not None and rows[j][0] is not None and (d == rows[j][0] or both and 100 * both >= percent * len(sets[i] | sets[j])):
                root[find(i)] = find(j)
    low = {}
    for i, (d, *_) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(d, low.get(find(i), d))
    return [(len(s), None if rows[i][0] is None else low[find(i)]) for i, s in enumerate(sets)]


def test_ids_of_several_texts(spark):
    """A doc_id on rows of different texts: no link of either text is lost, and what they link is one component."""
    ten = "one two three four five six seven eight nine ten"
    rows = [(5, "alpha beta gamma delta epsilon zeta eta theta"), (5, ten), (7, ten + " eleven"), (8, ten + " twelve"), (9, "alpha beta gamma delta epsilon zeta eta theta"), (10, "else"), (10, None), (11, None), (None, ten), (12, "x"), (3, "x"), (12, "no")]
    got = neardup.near_duplicate_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 4).collect()
    want = sorted(((r[0] is not None, r[0] or 0, *w) for r, w in zip(rows, by_row(rows, 4), strict=True)), key=str)
    assert sorted(((r.doc_id is not None, r.doc_id or 0, r.n_shingles, r.component_id) for r in got), key=str) == want
    assert {r.component_id for r in got if r.doc_id in (5, 7, 8, 9)} == {5}


def test_many_ids_of_several_texts(spark):
    rows = [(d % 150, t, *rest) for d, t, *rest in cluster_rows()]
    got = neardup.near_duplicate_groups(spark.createDataFrame(rows, SCHEMA).repartition(4), 4).collect()
    want = sorted((r[0], *w) for r, w in zip(rows, by_row(rows, 4), strict=True))
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == want


def test_large_buckets_are_split(spark, monkeypatch):
    monkeypatch.setattr(neardup, "SPLIT", 7)
    rows = cluster_rows()
    got = neardup.near_duplicate_groups(spark.createDataFrame(rows, SCHEMA).repartition(5), 4).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows, 4)


@pytest.mark.parametrize("split", [5, 400])
def test_shared_outer_shingles_meet_in_stars(spark, monkeypatch, split):
    """Members that share shingles outside their hubs: those of one group meet one of them, not each other; no link is lost, though a star's hub may be linked with few."""
    rng = random.Random(4)
    groups = [set(range(1000 * g, 1000 * g + 40)) for g in range(3)]
    sets = {}
    for size, group in zip((60, 20, 8), groups, strict=True):
        for _ in range(size):
            sets[len(sets)] = group - set(rng.sample(sorted(group), 1)) | {rng.randrange(10**6, 10**9) for _ in range(3)}
    for _ in range(25):  # parts of a group, linked with some of the others
        sets[len(sets)] = set(rng.sample(sorted(groups[2]), 33))
    monkeypatch.setattr(neardup, "SPLIT", split)
    k = {}
    for grams in sets.values():
        for g in grams:
            k[g] = k.get(g, 0) + 1
    has = spark.createDataFrame([(i, sorted(s)) for i, s in sets.items()], "id long, grams array<long>")
    people = spark.createDataFrame([(i, i, len(s), sum(k[g] == 1 for g in s), g) for i, s in sets.items() for g in s], "id long, root long, n long, own long, gram long")
    rare = spark.createDataFrame([(i, g, -(-k[g] // split)) for i, s in sets.items() for g in s if k[g] > 1], "id long, gram long, parts long")
    met, compared = [], neardup.compared

    def counted(pairs, sets):
        met.append(pairs.count())
        return compared(pairs, sets)

    monkeypatch.setattr(neardup, "compared", counted)
    got = {r.node: r.root for r in neardup._outer_links(rare, people, has, None, 80).collect()}
    root = {i: i for i in sets}

    def find(i):
        return i if root[i] == i else find(root[i])

    for i in sets:
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                low, high = sorted((find(i), find(j)))
                root[high] = low
    assert all(got.get(i, i) == find(i) for i in sets)
    assert len({find(i) for i in sets}) > 3
    assert met[0] < 5 * len(sets) and sum(met) < 1770 // 2  # all pairs of the largest group: 1770
