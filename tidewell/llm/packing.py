"""Best-fit packing of token sequences by a grouping genetic algorithm on islands.

Documents longer than a sequence are cut into full pieces; their first piece is what is left over. Full pieces are sequences of their own. The others are
dealt at random into cells of about CELL pieces, and each cell is a bin-packing problem of bounded size, however large the table or any document group is. For each cell
some islands evolve populations of packings apart from each other, as separate rows of a Spark job; after each round an island's best packing migrates to the next
island of its cell. The WORST least filled sequences of every cell then meet those of other cells in new cells, level by level until one cell is left, so that a cell's
last sequence doesn't stay half empty. Every cell of every level is searched until it has as few sequences as its lengths force, or PATIENCE runs out; where best fit by
falling length has as few at once, nothing can be better and nothing is searched.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import trimmed, written
from tidewell.llm.tokens import encoder

CELL, ISLANDS, ROUNDS, GENERATIONS, POPULATION = 3000, 2, 2, 60, 8
#: Generations without a better packing after which an island ends its round.
PATIENCE = 30
#: Most tasks of a round of islands.
PARTS = 4096
#: Of a cell's sequences those with most room that go on to the next level, at most half of them.
WORST = 6
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, piece_key long"
#: crossed and migrated: children of crossover and migrants that an island has taken in so far.
STATE = "cell long, island int, lengths binary, keys binary, kind string, packings array<binary>, crossed long, migrated long"


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int) -> DataFrame:
    """A row for each piece of each document's ids (text's ids, then end_id; null text: only end_id): doc_id, piece, start, length, ids_crc32, and a
    piece_key that is unique even where documents repeat. Ids go no further than their checksum."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        encode, key = encoder(tokenizer, False).encode, TaskContext.get().partitionId() << 36
        for batch in trimmed(batches):
            rows = []
            for doc_id, text in zip(batch.doc_id, batch.text, strict=True):
                ids = np.append(np.frombuffer(encode(text), "<u2"), np.uint16(end_id)).astype("<u4")
                first = len(ids) % capacity or capacity
                for k, lo in enumerate([0, *range(first, len(ids), capacity)]):
                    part = ids[lo : first if k == 0 else lo + capacity]
                    rows.append((doc_id, k, lo, len(part), zlib.crc32(part.tobytes()), key))
                    key += 1
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", "piece_key"])
            yield out.assign(doc_id=out.doc_id.astype("Int64"))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInPandas(cut, PIECES)


class Packer:
    """Packings of one cell: lists of bins, a bin being a list of item numbers. Items are numbered by falling length."""

    def __init__(self, lengths: np.ndarray, capacity: int, seed: int):
        self.sizes, self.capacity, self.rng, self.crossed = lengths.tolist(), capacity, np.random.default_rng(seed), 0

    def best_fit(self, items: list[int], bins: list[list[int]]) -> list[list[int]]:
        """Puts items, in the given order, each into the fullest of the bins that has room. Bins are kept by room left, and the set of rooms in use as
        the bits of one integer, so the fullest fitting bin is the lowest bit from the item's size on."""
        sizes, rooms, used = self.sizes, [[] for _ in range(self.capacity + 1)], 0
        for b in bins:
            room = self.capacity - sum(map(sizes.__getitem__, b))
            rooms[room].append(b)
            used |= 1 << room
        for i in items:
            s = sizes[i]
            fit = used >> s
            if fit:
                room = s + (fit & -fit).bit_length() - 1
                b = rooms[room].pop()
                if not rooms[room]:
                    used &= ~(1 << room)
            else:
                room, b = self.capacity, []
                bins.append(b)
            b.append(i)
            rooms[room - s].append(b)
            used |= 1 << (room - s)
        return bins

    def first(self, k: int) -> list[list[int]]:
        """Best fit by falling length; for k > 0 the lengths are shaken a little first."""
        order = np.arange(len(self.sizes))
        if k:
            order = np.argsort(-np.array(self.sizes) * (1 + 0.05 * k * self.rng.random(len(order))), kind="stable")
        return self.best_fit(order.tolist(), [])

    def fills(self, bins: list[list[int]]) -> np.ndarray:
        return np.array([sum(map(self.sizes.__getitem__, b)) for b in bins], np.int64)

    def fitness(self, bins: list[list[int]]) -> tuple[int, float]:
        """Fewer bins first; then uneven filling, which leaves bins that are easy to empty."""
        fills = self.fills(bins)
        return -len(bins), float(fills @ fills) / self.capacity**2

    def exchange(self, bins: list[list[int]], loose: list[int]) -> list[list[int]]:
        """Goes over the bins in random order and exchanges up to two items of a bin for one or two loose ones so that it is filled best; what is loose then is put by
        best fit. All choices of items are tried at once: sizes that can leave are the bits of one integer, those that can enter of another, and the first shifted by a
        gain meets the second. Bits of loose sizes are added as items come loose, and go when no loose items of that size are found."""
        sizes, within, free, ones, enter = self.sizes, (2 << self.capacity) - 1, {}, 0, 0
        coming = loose
        for k in self.rng.permutation(len(bins)).tolist():
            for i in coming:
                free.setdefault(sizes[i], []).append(i)
                enter |= (ones << sizes[i] | 1 << sizes[i]) & within
                ones |= 1 << sizes[i]
            coming = []
            if not free:
                break
            of = [sizes[i] for i in bins[k]]
            room = self.capacity - sum(of)
            if not room:
                continue
            single, pairs = 1, 0
            for s in of:
                pairs |= single << s
                single |= 1 << s
            leave, gain = single | pairs, room
            while gain:
                both = leave << gain & enter
                if not both:
                    gain -= 1
                    continue
                size = (both & -both).bit_length() - 1
                into = self.of_size(free, size)
                if not into:
                    enter &= ~(1 << size)
                    continue
                inside: dict[int, list[int]] = {}
                for i in bins[k]:
                    inside.setdefault(sizes[i], []).append(i)
                coming = self.of_size(inside, size - gain)
                bins[k] = [i for i in bins[k] if i not in coming] + [*into]
                for i in into:
                    free[sizes[i]].remove(i)
                    if not free[sizes[i]]:
                        del free[sizes[i]]
                break
        return self.best_fit(sorted([i for v in free.values() for i in v] + [*coming]), bins)

    def of_size(self, by_size: dict[int, list[int]], size: int) -> tuple[int, ...]:
        """One or two of the items that have this size together; none if no choice has."""
        if size in by_size:
            return (by_size[size][-1],)
        for s, items in by_size.items():
            if size - s in by_size and (2 * s != size or len(items) > 1):
                return (items[-1], by_size[size - s][0])
        return ()

    def cross(self, mother: list[list[int]], father: list[list[int]]) -> list[list[int]]:
        """Injects a random half of the mother's well-filled bins whole; of the father's bins those without any of their items stay; the other items,
        and those of some badly filled bins, are exchanged for items that fill bins worse and put by best fit."""
        fill = self.fills(mother)
        good = np.flatnonzero(fill >= np.quantile(fill, 0.5))
        taken = [mother[k] for k in good[self.rng.random(len(good)) < 0.5]]
        inside = bytearray(len(self.sizes))
        for b in taken:
            for i in b:
                inside[i] = 1
        kept, loose = [], []
        for b in father:
            if any(map(inside.__getitem__, b)):
                loose += [i for i in b if not inside[i]]
            else:
                kept.append(b)
        for k in sorted(np.argsort(self.fills(kept), kind="stable")[:2].tolist(), reverse=True):
            loose += kept.pop(k)
        return self.exchange([[*b] for b in taken + kept], loose)

    def mutate(self, bins: list[list[int]]) -> list[list[int]]:
        """Empties the worst filled bin and some at random, the badly filled rather, and puts their items anew."""
        fill = self.fills(bins)
        n = min(len(bins), 2 + int(self.rng.integers(0, 4)))
        odds = self.capacity - fill + 0.02 * self.capacity
        gone = {int(fill.argmin()), *self.rng.choice(len(bins), n, replace=False, p=odds / odds.sum()).tolist()}
        return self.exchange([[*b] for k, b in enumerate(bins) if k not in gone], [i for k in gone for i in bins[k]])

    def evolve(self, population: list[list[list[int]]], least: int) -> list[list[list[int]]]:
        """Up to GENERATIONS steps, each replacing the worst packing by a child of two others that won against another each, or by a changed copy of one; ends early once
        no packing can be better, or after PATIENCE steps without a better one."""
        scored = sorted(((self.fitness(p), p) for p in population), key=lambda x: x[0], reverse=True)
        idle = 0
        for _ in range(GENERATIONS):
            if len(scored[0][1]) <= least or len(scored) < 2 or idle >= PATIENCE:
                break
            a, b = (int(self.rng.integers(0, len(scored), 2).min()) for _ in range(2))
            alone = a == b or self.rng.random() < 0.4
            child = self.mutate(scored[a][1]) if alone else self.cross(scored[a][1], scored[b][1])
            new = self.fitness(child)
            idle = 0 if new > scored[0][0] else idle + 1
            if all(new != f for f, _ in scored):  # equal packings would fill the population
                self.crossed += not alone
                scored[-1] = (new, child)
                scored.sort(key=lambda x: x[0], reverse=True)
        return [p for _, p in scored]


def _pack(bins: list[list[int]], n: int) -> bytes:
    out = np.zeros(n, "<i4")
    for k, b in enumerate(bins):
        out[b] = k
    return out.tobytes()


def _unpack(data: bytes) -> list[list[int]]:
    at = np.frombuffer(data, "<i4")
    order = np.argsort(at, kind="stable")
    return [x.tolist() for x in np.split(order, np.flatnonzero(np.diff(at[order])) + 1)] if len(at) else []


def _start(group: pd.DataFrame) -> pd.DataFrame:
    """The cell's items by falling length, one state row for each island; a packing that they have already is in every island's population."""
    group = group.sort_values(["length", "piece_key"], ascending=[False, True])
    lengths, keys = group.length.to_numpy("<i4").tobytes(), group.piece_key.to_numpy("<i8").tobytes()
    known = [] if group.sequence_id.isna().any() else [pd.factorize(group.sequence_id)[0].astype("<i4").tobytes()]
    return pd.DataFrame({"cell": group.cell.iloc[0], "island": range(ISLANDS), "lengths": lengths, "keys": keys, "kind": "own", "packings": [known for _ in range(ISLANDS)], "crossed": 0, "migrated": 0})


def _round(capacity: int, turn: int):
    def step(group: pd.DataFrame) -> pd.DataFrame:
        """One island's round: its own packings (in the first round, new ones) and the migrant evolve; then its best goes on to the next island as well. A migrant is
        taken in unless the island has a packing just as good already."""
        own, cell, island = group[group.kind == "own"].iloc[0], int(group.cell.iloc[0]), int(group.island.iloc[0])
        lengths = np.frombuffer(own.lengths, "<i4")
        packer = Packer(lengths, capacity, (cell * ISLANDS + island) * 1000 + turn)
        least = -(-int(lengths.sum()) // capacity)
        population = [_unpack(p) for p in own.packings]
        if turn == 0:
            for k in range(POPULATION):
                population.append(packer.first(k if island == 0 else k + (k > 0) * island * POPULATION))
                if len(population[-1]) <= least:
                    break
        migrants = [_unpack(p[0]) for p in group[group.kind == "migrant"].packings]
        known = {packer.fitness(p) for p in population}
        migrants = [p for p in migrants if packer.fitness(p) not in known]
        population = packer.evolve(population + migrants, least)[:POPULATION]
        packed = [_pack(p, len(lengths)) for p in (population[:1] if len(population[0]) <= least else population)]
        rows = [(cell, island, own.lengths, own["keys"], "own", packed, own.crossed + packer.crossed, own.migrated + len(migrants))]
        if turn < ROUNDS - 1:
            rows.append((cell, (island + 1) % ISLANDS, b"", b"", "migrant", packed[:1], 0, 0))
        return pd.DataFrame(rows, columns=["cell", "island", "lengths", "keys", "kind", "packings", "crossed", "migrated"])

    return step


def _result(group: pd.DataFrame) -> pd.DataFrame:
    """Of the cell's islands the best packing: for each piece the sequence and its place in it; `more` for the pieces of the worst filled sequences."""
    row = min((r for r in group.itertuples()), key=lambda r: (max(np.frombuffer(r.packings[0], "<i4"), default=0), r.island))
    at, lengths, keys = np.frombuffer(row.packings[0], "<i4"), np.frombuffer(row.lengths, "<i4"), np.frombuffer(row.keys, "<i8")
    order = np.lexsort((keys, at))
    total = np.cumsum(lengths[order]) - lengths[order]
    first = np.searchsorted(at[order], at[order])
    fill = np.bincount(at, lengths)
    worst = np.argsort(fill, kind="stable")[: min(WORST, max(1, len(fill) // 2))]
    sequence = (int(row.cell) << 20 | at[order].astype(np.int64)) << 1
    return pd.DataFrame({"piece_key": keys[order], "sequence_id": sequence, "offset": (total - total[first]).astype(np.int64), "length": lengths[order], "more": np.isin(at[order], worst)})


def islands(items: DataFrame, capacity: int, cells: int, first: int = 0) -> DataFrame:
    """The last state of every island of every cell: items (length, piece_key, sequence_id, null or that of a packing they have) dealt into `cells` cells, numbered from
    `first`. Columns crossed and migrated tell how many children of crossover and how many migrants an island took in."""
    cell = F.pmod(F.xxhash64(F.coalesce("sequence_id", "piece_key"), F.lit(first)), F.lit(cells)) + first
    state = items.withColumn("cell", cell).groupBy("cell").applyInPandas(_start, STATE)
    for turn in range(ROUNDS):
        # a stated number of parts: by their few bytes all islands would be joined into one task
        state = state.repartition(min(max(1, cells * ISLANDS // 4), PARTS), "cell", "island").groupBy("cell", "island").applyInPandas(_round(capacity, turn), STATE)
    return state


def pack(table: DataFrame, capacity: int) -> DataFrame:
    """sequence_id and offset for every row of a stored pieces() table (columns length, piece_key). Pieces must be 1 to capacity long."""
    whole, part = table.where(F.col("length") == capacity), table.where(F.col("length") < capacity)
    items, placed, first = part.select("length", "piece_key", F.lit(None).cast("long").alias("sequence_id")), None, 0
    count = items.count()
    while True:
        cells = max(1, round(count / CELL))
        done = written(islands(items, capacity, cells, first).groupBy("cell").applyInPandas(_result, "piece_key long, sequence_id long, offset long, length int, more boolean"), "placed")
        more, before, first = done.where("more"), count, first + cells
        count = 0 if cells == 1 else more.count()
        last = not 0 < count < before
        final = (done if last else done.where("not more")).select("piece_key", "sequence_id", "offset")
        placed = final if placed is None else placed.unionByName(final)
        if last:
            break
        items = more.select("length", "piece_key", "sequence_id")
    return part.join(placed, "piece_key").unionByName(whole.withColumns({"sequence_id": F.col("piece_key") * 2 + 1, "offset": F.lit(0).cast("long")}))


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = 2048) -> DataFrame:
    """Packs the ids of all documents (columns doc_id, text) into sequences of at most `capacity` ids: a row for each piece with doc_id, piece, start,
    length, ids_crc32, sequence_id, offset.

    Null or empty text: a piece with only end_id. Repeated doc_ids, null ones too, are packed as documents of their own. No documents: no rows. Other
    columns are ignored. Texts are encoded once: the pieces, without ids, are kept as a table in the shared folder.
    """
    return pack(written(pieces(docs, tokenizer, end_id, capacity), "pieces"), capacity).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
