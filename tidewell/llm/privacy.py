"""Information-theoretic sanitisation: personal data found by pattern, and the terms that give it away.

How much a term tells of an entity (an e-mail address, say) is estimated from the corpus: of the entity's information, -log2 p(entity), the share that is their pointwise mutual
information, log2(p(entity | term) / p(entity)). A term and an entity stand together if one text has both, however far apart. A term that tells too much is replaced by a more
general one (all words with its first letters) if that tells little enough, else it is removed, at every place of every text.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import trim, trimmed, written

#: The kinds in their order, and their patterns. A lookbehind keeps addresses from being tried at each of their digits; nothing else can start there.
KINDS = ("email", "ip", "card", "phone", "term")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NOT_DIGIT = re.compile("[^0-9]+")
#: A term: letters, at least SHORTEST; its class: all terms with its first STEM letters.
SHORTEST, STEM = 5, 4
TERM = re.compile(r"[^\W\d_]+")
#: A term gives an entity away from this share of its information on, if they stand together in at least SUPPORT different texts.
SHARE, SUPPORT = 0.9, 2
#: Terms or places that a task holds before it hands them on.
HELD = 300_000
#: Bits of the set of disclosing terms that tasks test terms against, a multiple of 32768.
BITS = 1 << 25


def luhn(digits: str) -> bool:
    odd, even = digits[::-1][::2], digits[::-1][1::2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches that don't overlap of a local part ([A-Za-z0-9._%+-]+) and DOMAIN: at each @ the letters before it, as far as the last match."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at)):
            last = m.end()
            yield start, last
        at = text.find("@", max(at + 1, last))


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind's number, end, entity) of personal data, in order; the entity is its kind and what it holds, without its writing."""
    found = [(a, 0, b, "email " + text[a:b].lower()) for a, b in emails(text)]
    for m in IP.finditer(text):
        parts = [x.lstrip("0") or "0" for x in m[0].split(".")]
        if all(len(x) <= 3 and int(x) <= 255 for x in parts):
            found.append((m.start(), 1, m.end(), "ip " + ".".join(parts)))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(digits := NOT_DIGIT.sub("", m[0])) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end(), "card " + digits))
    for m in PHONE.finditer(text):
        if 10 <= len(digits := NOT_DIGIT.sub("", m[0])) <= 15:
            found.append((m.start(), 3, m.end(), "phone " + digits))
    return sorted(found)


def free_terms(text: str, spans: list[tuple[int, int, int, str]]) -> Iterator[tuple[int, int, str]]:
    """(start, end, term) of all terms of the whole text that share no code point with a span."""
    inside = np.zeros(len(text) + 1 if spans else 0, bool)
    for a, _, b, _ in spans:
        inside[a:b] = True
    for m in TERM.finditer(text):
        if m.end() - m.start() >= SHORTEST and not inside[m.start() : m.end()].any():
            yield m.start(), m.end(), m[0].lower()


FOUND = "key string, base array<struct<start:long,kind:int,end:long>>, entities array<string>, terms array<string>"


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    base_type, names = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())])), pa.list_(pa.string())
    for batch in batches:
        first, n, base, entities, terms = 0, 0, [], [], []
        for row, text in enumerate(batch.column(2).to_pylist(), 1):
            spans = base_spans(text) if text else []
            base.append([{"start": a, "kind": k, "end": b} for a, k, b, _ in spans])
            entities.append(sorted({entity for *_, entity in spans}))
            terms.append(sorted({term for *_, term in free_terms(text, spans)}) if spans else [])
            n += len(terms[-1])
            if n >= HELD or row == batch.num_rows:
                ids = [batch.column(i).slice(first, row - first) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([*ids, pa.array(base, base_type), pa.array(entities, names), pa.array(terms, names)], ["doc_id", "key", "base", "entities", "terms"])
                first, n, base, entities, terms = row, 0, [], [], []


def own_terms(text: str | None) -> set[str]:
    return {w.lower() for w in set(TERM.findall(text)) if len(w) >= SHORTEST} if text else set()


def _places(batches: Iterator[pa.RecordBatch], bits: bytes) -> Iterator[pa.RecordBatch]:
    """(key, term, start, end) for rows of (key, text): every place outside personal data of each term whose bit is set, in batches of about HELD places."""
    found: list[tuple] = []

    def flush() -> pa.RecordBatch:
        columns = list(zip(*found, strict=True)) or [()] * 4
        out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["key", "term", "start", "end"])
        found.clear()
        return out

    def marked(term: str) -> bool:
        bit = zlib.crc32(term.encode()) % BITS
        return bool(bits[bit >> 3] >> (bit & 7) & 1)

    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if own := set(filter(marked, own_terms(text))):
                found += [(key, term, a, b) for a, b, term in free_terms(text, base_spans(text)) if term in own]
                if len(found) >= HELD:
                    yield flush()
        yield flush()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, int] = {}

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["term", "n"])
        held.clear()
        return out

    for batch in batches:
        for text in batch.column(0).to_pylist():
            own = own_terms(text)
            for w in own:
                held[w] = held.get(w, 0) + 1
            for w in {w[:STEM] + "*" for w in own}:
                held[w] = held.get(w, 0) + 1
            if len(held) >= HELD:
                yield flush()
    yield flush()
    trim()


def term_counts(docs: DataFrame) -> DataFrame:
    """(term, n): in how many documents each term stands, and each class of terms (its letters and *)."""
    return docs.select(F.col("text").cast("string")).mapInArrow(_count, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))


def disclosure(both: Column, term: Column, entity: Column, total: Column) -> Column:
    """The share of an entity's information that a term tells, of numbers of documents; 0 where every document has the entity."""
    return F.coalesce(F.try_divide(F.log2(both * total / (term * entity)), F.log2(total / entity)), F.lit(0.0))


def keyed() -> tuple[Column, Column]:
    """key, the text's hash, and text."""
    text = F.col("text").cast("string")
    return F.md5(text.cast("binary")).alias("key"), text.alias("text")


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, key, base, entities, terms) for each row of docs, as a stored table: its personal data, what it holds, and the text's terms outside it, each once; texts
    without personal data have none of these. key: the text's hash."""
    rows = docs.select("doc_id", *keyed())
    return written(rows.mapInArrow(lambda batches: trimmed(_find(batches)), f"doc_id {dict(rows.dtypes)['doc_id']}, {FOUND}"), "personal")


def telling_terms(docs: DataFrame, found: DataFrame, share: float = SHARE, support: int = SUPPORT) -> DataFrame:
    """(term, general) for each term that gives an entity away, as a stored table: general is the class that replaces the term, null if it is removed.

    Documents are counted with their copies, support by different texts. A class is judged like a term, with no least support; where a term gives several entities away, it
    is removed if its class gives any of them away.
    """
    total = F.lit(found.count()).cast("double")
    texts = found.where(F.size("entities") > 0).groupBy("key").agg(F.first("entities").alias("entities"), F.first("terms").alias("terms"), F.count("*").alias("copies"))
    texts = written(texts, "texts")
    holds = texts.select("key", "copies", F.explode("entities").alias("entity"))
    entities = holds.groupBy("entity").agg(F.sum("copies").alias("of_entity"), F.count("*").alias("texts")).where(F.col("texts") >= support).drop("texts")
    holds = written(holds.join(entities, "entity"), "entities")
    texts = texts.join(holds.select("key").distinct(), "key", "left_semi")

    def general(term: Column) -> Column:
        return F.concat(F.substring(term, 1, STEM), F.lit("*"))

    uses = texts.select("key", F.explode("terms").alias("term"))
    names = uses.groupBy("term").agg(F.count("*").alias("texts")).where(F.col("texts") >= support).select("term")
    names = written(names, "names")
    counts = written(term_counts(docs).join(names.unionByName(names.select(general(F.col("term")).alias("term")).distinct()), "term", "left_semi"), "terms")
    # both <= of_entity, so a term in more documents than this can't tell the share; the last factor is for rounding
    most = F.pow(F.col("of_entity"), F.lit(share)) * F.pow(total, F.lit(1 - share)) * (1 + 1e-9)
    told = disclosure(F.col("both"), F.col("n"), F.col("of_entity"), total)
    pairs = uses.join(counts, "term").join(holds, "key").where(F.col("n") <= most).groupBy("term", "n", "entity", "of_entity").agg(F.sum("copies").alias("both"), F.count("*").alias("texts"))
    shown = pairs.where((F.col("texts") >= support) & (told >= share)).select("term", general(F.col("term")).alias("general"), "entity")
    shown = written(shown, "telling")
    classes = texts.select("key", F.explode(F.array_distinct(F.transform("terms", general))).alias("general"))
    classes = classes.join(holds.join(shown.select("general", "entity").distinct(), "entity"), ["key", "general"]).groupBy("general", "entity", "of_entity").agg(F.sum("copies").alias("both"))
    classes = classes.join(counts.withColumnRenamed("term", "general"), "general").where(told >= share).select("general", "entity", F.lit(True).alias("whole"))
    each = shown.join(classes, ["general", "entity"], "left").groupBy("term", "general").agg(F.max(F.coalesce("whole", F.lit(False))).alias("gone"))
    return written(each.select("term", F.when(~F.col("gone"), F.col("general")).alias("general")), "dictionary")


def term_bits(terms: DataFrame) -> bytes:
    """BITS bits, those of the checksums of `term` set: what a task needs to pass over nearly all other terms, of one size for any number of terms."""
    place = F.crc32(F.col("term").cast("binary")) % BITS + 1
    parts = terms.groupBy(F.bitmap_bucket_number(place).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")).collect()
    bits = bytearray(BITS // 8)
    for r in parts:
        size = len(r["bits"])
        bits[(r["part"] - 1) * size : r["part"] * size] = r["bits"]
    return bytes(bits)


def disclosing(docs: DataFrame, found: DataFrame, share: float = SHARE, support: int = SUPPORT) -> DataFrame:
    """(key, terms) for each text with terms that give an entity away, as a stored table: terms has (start, end, general) for all their places in the text, general as in
    telling_terms. Every place of every text is looked at; a term whose bit another one has set drops out in the join."""
    telling = telling_terms(docs, found, share, support)
    bits = docs.sparkSession.sparkContext.broadcast(term_bits(telling))
    places = docs.select(*keyed()).mapInArrow(lambda batches: trimmed(_places(batches, bits.value)), "key string, term string, start long, end long")
    places = places.join(telling, "term").select("key", "start", "end", "general").distinct()  # copies of a text have the same places
    return written(places.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("start", "end", "general"))).alias("terms")), "places")  # at most the terms of one text


SPAN = "struct<start:long,kind:int,end:long,general:string>"


def personal_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, key, spans) for each row of docs: its personal data and disclosing terms as (start, kind's number, end, general), by start, then kind; code points, end
    exclusive. Null and empty texts have none. Disclosing terms are looked for at every place of every text, whether or not it has personal data of its own. Equal texts have
    equal spans; columns other than doc_id and text play no part, whatever their names. An empty table gives an empty one."""
    found = find(docs)
    terms = disclosing(docs, found)
    own = F.transform("base", lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"), F.lit(None).cast("string").alias("general")))
    more = F.transform("terms", lambda x: F.struct(x["start"].alias("start"), F.lit(KINDS.index("term")).alias("kind"), x["end"].alias("end"), x["general"].alias("general")))
    rows = found.select("doc_id", "key", own.alias("base")).join(terms, "key", "left")
    return rows.select("doc_id", "key", F.sort_array(F.concat("base", F.coalesce(more, F.array().cast(f"array<{SPAN}>")))).alias("spans"))


def sanitised(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """docs with each span of personal_spans(docs) replaced in `text`: personal data by its kind in brackets, terms by their class or by [removed]; of spans that overlap the
    first counts. All columns stay."""
    place = docs.select("*").alias("d")
    unique = spans.groupBy("key").agg(F.first("spans").alias("spans")).alias("s")
    key = F.md5(F.col("d.text").cast("string").cast("binary"))
    names = docs.columns
    joined = place.join(unique, key == F.col("s.key"), "left").select(F.struct(*(F.col(f"d.`{c}`") for c in names)).alias("row"), F.col("d.text").cast("string").alias("text"), F.col("s.spans").alias("spans"))

    @F.pandas_udf("string")
    def clean(text: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([_replaced(t, s) for t, s in zip(text, spans, strict=True)])

    done = joined.select("row", clean("text", "spans").alias("text"))
    return done.select(*(F.col("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in names))


def _replaced(text, spans) -> str | None:
    if text is None or spans is None or not len(spans):
        return text
    out, at = [], 0
    for x in spans:
        if x["start"] >= at:
            out += [text[at : x["start"]], x["general"] or ("[removed]" if KINDS[x["kind"]] == "term" else f"[{KINDS[x['kind']]}]")]
            at = x["end"]
    return "".join([*out, text[at:]])


def report(spans: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of personal_spans() rows; spans as kind:start:end, joined by commas, the hash of those but the terms."""
    names = F.array(*map(F.lit, KINDS))

    def line(x: Column) -> Column:
        return F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))

    def number(k: int) -> Column:
        return F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long")

    base = F.filter("spans", lambda x: x["kind"] < KINDS.index("term"))
    counts = [number(k).alias(f"n_{name}") for k, name in enumerate(KINDS[:-1])]
    return spans.select("doc_id", *counts, F.sha2(F.array_join(F.transform(base, line), ",").cast("binary"), 256).alias("base_sha256"), F.array_join(F.transform("spans", line), ",").alias("spans"))
