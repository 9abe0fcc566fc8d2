"""Periodic runs, spelling variants and personal data, against plain definitions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tests.llm.conftest import SCHEMA, odd_rows
from tidewell.llm import privacy, queries, runs, spelling

SF = "/root/testdata/sf0.001"


def plain_runs(x) -> list[tuple[int, int, int]]:
    """Every maximal stretch of matches p apart, for each p; of equal stretches the least p."""
    found = {}
    for p in range(1, len(x) // 4 + 1):
        same = np.concatenate([[False], np.asarray(x[:-p]) == np.asarray(x[p:]), [False]]).astype(int)
        for a, b in zip(np.flatnonzero(np.diff(same) == 1), np.flatnonzero(np.diff(same) == -1), strict=True):
            if b - a + p >= max(6, 4 * p):
                found.setdefault((int(a), int(b - a + p)), p)
    return sorted(((a, n, p) for (a, n), p in found.items()), key=lambda r: (r[0], r[2]))


def plain_digest(doc_id, text) -> tuple:
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    number = {w: k for k, w in enumerate(dict.fromkeys(words))}
    found = plain_runs([number[w] for w in words])
    gone = {i for a, length, p in found for i in range(a + p, a + length)}
    best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None,) * 3)
    lines = "".join(f"{a},{length},{p}\n" for a, length, p in found)
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(found), *best, None if best[0] is None else 1000 * best[1] // best[2], hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def order(rows) -> list:
    return sorted(map(tuple, rows), key=repr)


def test_cover_meets_every_distance():
    assert {(a - b) % runs.V for a in runs.COVER.tolist() for b in runs.COVER.tolist()} == set(range(runs.V))


def test_runs_of_made_texts(monkeypatch):
    monkeypatch.setattr(runs, "GRID", 100)
    rng = random.Random(1)
    for _ in range(150):
        texts = []
        for _ in range(rng.randint(1, 6)):
            k, n = rng.choice([1, 2, 3, 30]), rng.choice([0, 3, 6, 20, 100, 400])
            x = [rng.randint(1, k) for _ in range(n)]
            if rng.random() < 0.6 and n > 10:
                a = rng.randrange(n)
                p = 1 + rng.randrange(max(1, (n - a) // 4 + 1))
                x = [x[i] if i < a else x[a + (i - a) % p] for i in range(n)]
            texts.append(np.array(x, np.int64))
        for x, got in zip(texts, runs.runs_of(texts, 30), strict=True):
            assert [tuple(r) for r in got.tolist()] == plain_runs(x)


def test_extensions():
    rng = np.random.default_rng(4)
    block = rng.integers(1, 3, 90)
    s = np.concatenate([block, [5], block, block, [6], np.ones(200, np.int64), [7]])
    i, j = (x.ravel() for x in np.meshgrid(np.arange(len(s)), np.arange(len(s))))
    i, j = i[i != j], j[i != j]
    got = runs.Extensions(s).of(i, j)
    for a, b, n in zip(i[::7].tolist(), j[::7].tolist(), got[::7].tolist(), strict=True):
        m = min(len(s) - a, len(s) - b)
        assert n == next((k for k in range(m) if s[a + k] != s[b + k]), m)


def test_runs_query(spark, docs):
    want = order(plain_digest(r.doc_id, r.text) for r in docs.collect())
    assert order(queries.op11_runs(spark, SF).collect()) == want and sum(r[1] for r in want) > 0


def test_runs_odd(spark, clashing, none, monkeypatch):
    monkeypatch.setattr(runs, "PIECE", 50)
    rows = [*odd_rows(), (5, "a " * 5000, None, None, None), (6, "ab cd\n" * 7 + "x", None, None, None)]
    more = clashing.select(*SCHEMA_NAMES).unionByName(spark.createDataFrame(rows[-2:], SCHEMA))
    got = runs.digest(runs.periodic_runs(runs.with_periodic_tails(more))).collect()
    assert order(got) == order(plain_digest(d, t) for d, t, *_ in rows)
    assert runs.digest(runs.periodic_runs(runs.with_periodic_tails(clashing))).count() == len(odd_rows())
    assert runs.periodic_runs(none).count() == 0 and runs.digest(runs.periodic_runs(runs.with_periodic_tails(none))).count() == 0
    cut = runs.periodic_runs(spark.createDataFrame([(1, "x a b a b a b a b a y")], "doc_id int, text string")).first()
    assert cut.collapsed == "x a b y" and [tuple(r) for r in cut.runs] == [(1, 9, 2)]


SCHEMA_NAMES = [x.split()[0] for x in SCHEMA.split(", ")]


def edits(word: str, letters: str) -> set[str]:
    out = {word[:k] + word[k + 1 :] for k in range(len(word))} | {word[:k] + c + word[k:] for k in range(len(word) + 1) for c in letters}
    return (out | {word[:k] + c + word[k + 1 :] for k in range(len(word)) for c in letters}) - {word}


def plain_variants(rows) -> list[tuple]:
    count = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    n = {w: k for w, k in count.items() if len(w) >= 7 and k >= 2}
    letters = "".join(sorted({c for w in n for c in w}))
    near = {w: [x for x in edits(w, letters) if x in n] for w in n}
    best = {w: min(x, key=lambda v: (-n[v], v)) for w, x in near.items() if x}
    form = {w: b for w, b in best.items() if n[b] >= 10 * n[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return [(w, n[w], form.get(w), root(w), len(near[w]), n[form[w]] if w in form else None) for w in n]


def test_spelling_query(spark, docs):
    want = plain_variants([(r.doc_id, r.text) for r in docs.collect()])
    assert order(queries.op12_spelling(spark, SF).collect()) == order(want) and any(r[2] for r in want)


@pytest.mark.parametrize("crowded", [1, 20, 10**6])
def test_near_words(spark, crowded):
    """Few letters, so that near words are many; edges dealt by whole halves, in part, and not at all."""
    rng = random.Random(crowded)
    words = {"".join(rng.choice("abé÷") for _ in range(rng.randint(7, 9))): rng.randint(2, 9) for _ in range(900)}
    got = {r.word: r for r in spelling.near_words(spark.createDataFrame(list(words.items()), "word string, n long"), crowded=crowded, shard=200).collect()}
    assert len(got) == len(words)
    for w, n in words.items():
        near = [x for x in edits(w, "abé÷") if x in words]
        best = min(near, key=lambda v: (-words[v], v), default=None)
        assert (got[w].n, got[w].n_near, got[w].best, got[w].best_n) == (n, len(near), best, words.get(best))


def test_chains_of_forms(spark):
    """Each word is ten times as frequent as the one before: the root of all is the last."""
    words = ["aaaaaaa", "aaaaaab", "aaaaabb", "aaaabbb", "aaabbbb"]
    rows = [(f"x{k}", " ".join([w] * (2 * 10**k))) for k, w in enumerate(words)]
    rows = [(d, t) for d, t in rows if zlib.crc32(f"{d}:{t.split()[0]}".encode()) % 31]
    got = {r.word: r for r in spelling.spelling_variants(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert len(rows) == 5 and {r.root for r in got.values()} == {"aaabbbb"} and got["aaaaaaa"].form == "aaaaaab" and got["aaabbbb"].form is None


def test_spelling_odd(spark, clashing, none, monkeypatch):
    monkeypatch.setattr(spelling, "HELD", 3)
    want = plain_variants([(d, t) for d, t, *_ in odd_rows()])
    assert order(r[:6] for r in spelling.spelling_variants(clashing).collect()) == order(want)
    assert spelling.spelling_variants(none).count() == 0
    one = spelling.spelling_variants(spark.createDataFrame([(1, "ÀÖabcdefg Àöabcdefg Àöabcdefg ÀÖabcdefg")], "doc_id long, text string")).collect()
    assert {r.word for r in one} <= {"ÀÖabcdefg", "Àöabcdefg"} | {r.word for r in one if len(r.word) == 8}


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
ADDRESS = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")


def plain_base(text) -> list[tuple[int, int, int]]:
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    found += [(m.start(), 1, m.end()) for m in ADDRESS.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    for kind, pattern, lo, hi in ((2, r"[0-9]([\x20-]?[0-9])+", 14, 19), (3, r"\+[0-9][\x20().0-9-]+[0-9]", 10, 15)):
        for m in re.finditer(pattern, text):
            digits = [int(c) for c in m[0] if c in "0123456789"]
            twice = sum(d if k % 2 == 0 else d * 2 - 9 * (d > 4) for k, d in enumerate(reversed(digits)))
            if lo <= len(digits) <= hi and (kind == 3 or twice % 10 == 0):
                found.append((m.start(), kind, m.end()))
    return sorted(found)


def test_patterns():
    rng = random.Random(2)
    for alphabet in ("a@.- ", "1.2 5", "1+ -4(.@b", "4 -0123456789"):
        for _ in range(4000):
            text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40)))
            assert [x[:3] for x in privacy.base_spans(text)] == plain_base(text), text


def plain_spans(rows) -> list[tuple]:
    """(doc_id, spans) by the definitions, with all counts held in dictionaries."""
    kinds, total = ("email", "ip", "card", "phone", "term"), len(rows)
    term_docs, entity_docs, both_docs, both_texts, uses = Counter(), Counter(), Counter(), defaultdict(set), []
    for _, text in rows:
        own = {w.lower() for w in re.findall(r"[^\W\d_]+", text or "") if len(w) >= 5}
        term_docs.update(own)
        term_docs.update({w[:4] + "*" for w in own})
        spans, mine = privacy.base_spans(text) if text else [], []
        for m in re.finditer(r"[^\W\d_]+", text or ""):
            if len(m[0]) >= 5 and not any(m.start() < b and a < m.end() for a, _, b, _ in spans):
                mine += [(m.start(), m.end(), m[0].lower(), e) for a, _, b, e in spans if (m.end() <= a <= m.start() + 100) or (b <= m.start() and m.end() <= b + 100)]
        mine = sorted(set(mine))
        uses.append(mine)
        entity_docs.update({e for *_, e in mine})
        for pair in {p for _, _, t, e in mine for p in ((t, e), (t[:4] + "*", e))}:
            both_docs[pair] += 1
            both_texts[pair].add(text)

    def told(t, e):
        whole = math.log2(total / entity_docs[e])
        return math.log2(both_docs[t, e] * total / (term_docs[t] * entity_docs[e])) / whole if whole else 0

    out = []
    for (doc_id, text), mine in zip(rows, uses, strict=True):
        spans = {(a, k, b, None) for a, k, b, _ in (privacy.base_spans(text) if text else [])}
        gone = defaultdict(bool)
        for a, b, t, e in mine:
            if len(both_texts[t, e]) >= 2 and told(t, e) >= 0.9:
                gone[a, b, t] |= told(t[:4] + "*", e) >= 0.9
        spans |= {(a, 4, b, None if g else t[:4] + "*") for (a, b, t), g in gone.items()}
        out.append((doc_id, ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b, _ in sorted(spans, key=lambda x: x[:3])), sorted((a, g or "") for a, k, _, g in spans if k == 4)))
    return out


def test_personal_query(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = {r.doc_id: r for r in queries.op13_personal(spark, SF).collect()}
    for doc_id, spans, _ in plain_spans(rows):
        assert got[doc_id].spans == spans
    for doc_id, text in rows:
        base = plain_base(text)
        names = [f"{privacy.KINDS[k]}:{a}:{b}" for a, k, b in base]
        count = Counter(k for _, k, _ in base)
        r = got[doc_id]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(count[k] for k in range(4)) and r.base_sha256 == hashlib.sha256(",".join(names).encode()).hexdigest()


def test_disclosing_terms(spark):
    """A nickname stands by one address only, its class too: it goes. The class of a trade's name stands in other texts as well: it takes the name's place. Common words stay."""
    rows = [(k, f"number {k} says hello to Zorblax the carpentress at zed@mail.example.com about number {k}") for k in range(3)]
    rows += [(10 + k, f"hello number {k} says the carpenter about something else") for k in range(40)]
    rows += [(60, "Zorblaxian music is about nothing and says hello"), (61, None), (62, "")]
    docs = spark.createDataFrame([*rows, rows[0]], "doc_id long, text string")
    spans = privacy.personal_spans(docs)
    got = {r.doc_id: r.spans for r in spans.collect()}
    text = rows[0][1]
    assert {text[s.start : s.end]: s.general for s in got[0] if s.kind == 4} == {"Zorblax": None, "carpentress": "carp*"}
    assert all(not got[k] for k in (*range(10, 50), 60, 61, 62))
    clean = {r.doc_id: r.text for r in privacy.sanitised(docs, spans).collect()}
    assert clean[0] == "number 0 says hello to [removed] the carp* at [email] about number 0" and clean[60] == rows[-3][1] and clean[61] is None
    want = {d: s for d, s, _ in plain_spans([*rows, rows[0]])}
    assert {r.doc_id: r.spans for r in privacy.report(spans).collect()} == want


def test_personal_odd(spark, clashing, none):
    got = privacy.report(privacy.personal_spans(clashing)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.spans) for r in got) == sorted((d is None, d or 0, s) for d, s, _ in plain_spans([(d, t) for d, t, *_ in odd_rows()]))
    spans = privacy.personal_spans(clashing)
    out = privacy.sanitised(clashing, spans)
    assert out.columns == clashing.columns and out.count() == len(odd_rows())
    assert privacy.report(privacy.personal_spans(none)).count() == 0
    long = "1" * 200000 + " " + "a." * 100000 + "@" + "+1" * 50000 + "x@y" * 50000
    r = privacy.report(privacy.personal_spans(spark.createDataFrame([(1, long)], "doc_id long, text string"))).first()
    assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == (0, 0, 0, 0)


def whole_spans(rows) -> dict:
    """Spans by document, from counts held in dictionaries: a term and an entity stand together wherever they stand in one text, and terms are marked at every place."""
    total, pieces = len(rows), []
    term_docs, entity_docs, both_docs, both_texts = Counter(), Counter(), Counter(), defaultdict(set)
    for _, text in rows:
        base = privacy.base_spans(text) if text else []
        words = [(m.start(), m.end(), m[0].lower()) for m in re.finditer(r"[^\W\d_]+", text or "") if len(m[0]) >= 5]
        free = [w for w in words if not any(w[0] < b and a < w[1] for a, _, b, _ in base)]
        pieces.append((base, free))
        entities = {e for *_, e in base}
        term_docs.update({x for *_, t in words for x in (t, t[:4] + "*")})
        entity_docs.update(entities)
        for pair in {(x, e) for *_, t in free for x in (t, t[:4] + "*") for e in entities}:
            both_docs[pair] += 1
            both_texts[pair].add(text)

    def told(t, e):
        whole = math.log2(total / entity_docs[e])
        return math.log2(both_docs[t, e] * total / (term_docs[t] * entity_docs[e])) / whole if whole else 0

    gives = defaultdict(set)
    for (t, e), texts in both_texts.items():
        if not t.endswith("*") and len(texts) >= 2 and told(t, e) >= 0.9:
            gives[t].add(e)
    general = {t: "" if any(told(t[:4] + "*", e) >= 0.9 for e in found) else t[:4] + "*" for t, found in gives.items()}
    return {d: sorted([(a, k, b, "") for a, k, b, _ in base] + [(a, 4, b, general[t]) for a, b, t in free if t in general]) for (d, _), (base, free) in zip(rows, pieces, strict=True)}


def spans_of(docs) -> dict:
    return {r.doc_id: [(s.start, s.kind, s.end, s.general or "") for s in r.spans] for r in privacy.personal_spans(docs).collect()}


def test_terms_far_from_the_entity(spark):
    """A nickname tells of an address however far from it it stands, at each of its places, and in a text without any address."""
    far = " so it was and so it is" * 400
    rows = [(k, f"{k} met Zorblax.{far} Mail zed@mail.example.com.{far} Then Zorblax left") for k in range(3)]
    rows += [(3, f"Who is Zorblax?{far}"), *((10 + k, f"nothing {k}{far}") for k in range(60))]
    got = spans_of(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {d: [rows[d][1][a:b] for a, k, b, _ in got[d] if k == 4] for d in range(4)} == {0: ["Zorblax"] * 2, 1: ["Zorblax"] * 2, 2: ["Zorblax"] * 2, 3: ["Zorblax"]}
    assert got == whole_spans(rows) and not any(got[10 + k] for k in range(60))


def test_terms_of_made_corpora(spark):
    rng = random.Random(6)
    for _ in range(3):
        words = ["".join(rng.choice("abcÉ") for _ in range(rng.randint(4, 6))) for _ in range(150)]
        people = [(f"p{k}@mail{k}.example", f"+49 170 55512{k:02}", ["".join(rng.choice("abcÉ") for _ in range(7)) for _ in range(3)]) for k in range(12)]
        rows = []
        for d in range(150):
            parts = rng.sample(words, rng.randint(0, 12))
            for mail, phone, own in rng.sample(people, rng.choice((0, 0, 0, 1, 2))):
                parts += [rng.choice((mail, mail.upper(), phone)), *rng.sample(own, 2), rng.choice(own).upper()]
            parts += [rng.choice(people)[2][0]] * (rng.random() < 0.05)
            rng.shuffle(parts)
            rows.append((d, " ".join(parts) + rng.choice(("", "." * 150 + rng.choice(words)))))
        rows += [(200 + k, rows[k][1]) for k in range(20)]
        want = whole_spans(rows)
        assert sum(s[1] == 4 and s[3] == "" for x in want.values() for s in x) > 0 and sum(s[3] != "" for x in want.values() for s in x) > 0
        assert spans_of(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)) == want
