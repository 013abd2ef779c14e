"""Benchmark decontamination by the q-gram lemma.

Texts are compared as folded characters: lower-cased, runs of white space as one space. An item
of m characters that stands in a document with at most k = floor(rate * m) edits shares at least
m - q + 1 - k * q of its character q-grams with that place, all on diagonals that differ by at
most k. Diagonals are cut into cells of k + 1; a band is two neighbouring cells, so bands overlap
by a cell and some band holds all of them. Bands whose count of shared q-grams reaches the bound are verified by banded
alignment: the item against the region, within the band, free at the region's two ends.

Items too short for a bound above zero are counted with the edits that leave one shared q-gram
(at least none: the whole item); items shorter than q are searched as they are.

The benchmark is a stated query set: it is read in blocks of at most ``BLOCK`` folded characters,
each sent to the executors in turn (its size is the bound of what is broadcast), and every block is
held against all documents, whole texts, in one pass without a shuffle.

Defined cases: a null or empty text matches nothing; a null or white-space item matches nothing; an
item that stands several times in a document gives one row with the number of places; repeated rows
of documents or items each count; a null doc_id or item_id is carried as null; empty tables give
an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, need, stored

Q = 8
#: Edits allowed, as a share of the item's characters.
RATE = 0.1
#: Folded characters of benchmark items in a block.
BLOCK = 2_000_000
_M = np.uint64(0x9E3779B97F4A7C15)
_TABLE_BITS = 22
#: Diagonals are numbered from far below zero; an item has so many cells of them at most.
_SHIFT, _CELLS = 1 << 32, 1 << 40
#: Stands between texts that are searched together, more often than an item may have edits.
_BETWEEN = 0x110000
#: Characters of texts that are searched together (a longer text is searched whole).
CHUNK = 1 << 19


def fold(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)


def _grams(c: np.ndarray, q: int = Q) -> np.ndarray:
    """64-bit codes of the q-grams of a text, q a power of two."""
    step = 1
    while step < q:
        c = (c[:-step] * (_M + np.uint64(2 * step)) + c[step:]) if len(c) > step else c[:0]
        c = c ^ (c >> np.uint64(29))
        step *= 2
    return c * _M


def edit_budget(m: int, rate: float = RATE, q: int = Q) -> int:
    """The edits allowed in an item: its share, or what leaves one shared q-gram."""
    return max(0, min(int(rate * m), (m - q) // q))


class Index:
    """The q-grams of a block of items, by code, with item and place."""

    def __init__(self, items: list[tuple], rate: float):
        self.ids = [i for i, _ in items]
        self.codes = [_codes(fold(t)) for _, t in items]
        self.budget = np.array([edit_budget(len(c), rate) for c in self.codes], np.int64)
        self.length = np.array([len(c) for c in self.codes], np.int64)
        self.least = self.length - Q + 1 - self.budget * Q
        self.short = [k for k, c in enumerate(self.codes) if 0 < len(c) < Q]
        own = [_grams(c) if len(c) >= Q else c[:0] for c in self.codes]
        grams = np.concatenate([*own, np.zeros(0, np.uint64)])
        order = np.argsort(grams, kind="stable")
        self.item = np.repeat(np.arange(len(own)), [len(g) for g in own])[order]
        self.place = np.concatenate([*[np.arange(len(g)) for g in own], np.zeros(0, np.int64)])[order]
        self.gram, self.first, self.count = np.unique(grams[order], return_index=True, return_counts=True)
        self.table = np.zeros(1 << _TABLE_BITS, bool)
        self.table[(self.gram >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)] = True

    def bands(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(item, first diagonal) of the bands that hold enough shared q-grams."""
        none = np.zeros(0, np.int64)
        if len(text) < Q or not len(self.gram):
            return none, none
        g = _grams(text)
        at = np.flatnonzero(self.table[(g >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)])
        g = g[at]
        slot = np.minimum(np.searchsorted(self.gram, g), len(self.gram) - 1)
        real = self.gram[slot] == g
        at, slot = at[real], slot[real]
        keys, counts = [], []
        for lo, hi in self._cuts(at, slot):  # bounded memory for very long texts
            n = self.count[slot[lo:hi]]
            entry = np.repeat(self.first[slot[lo:hi]] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            item = self.item[entry]
            diagonal = np.repeat(at[lo:hi], n) - self.place[entry] + _SHIFT
            # each place of an item counts once in a cell
            pair = np.unique(entry * _CELLS + diagonal // (self.budget[item] + 1))
            key, hits = np.unique(self.item[pair // _CELLS] * _CELLS + pair % _CELLS, return_counts=True)
            keys.append(key)
            counts.append(hits)
        if not keys:
            return none, none
        # cells of k + 1 diagonals; a band is a cell and the next one, so bands overlap by a cell
        key, back = np.unique(np.concatenate(keys), return_inverse=True)
        hits = np.bincount(back, np.concatenate(counts)).astype(np.int64)
        key, hits = np.concatenate([key, key - 1]), np.concatenate([hits, hits])
        key, back = np.unique(key, return_inverse=True)
        hits = np.bincount(back, hits).astype(np.int64)
        enough = hits >= self.least[key // _CELLS]
        item, cell = key[enough] // _CELLS, key[enough] % _CELLS
        return item, cell * (self.budget[item] + 1) - _SHIFT

    def _cuts(self, at: np.ndarray, slot: np.ndarray, most: int = 4_000_000):
        """Runs of hits with at most ``most`` entries together (one hit at least)."""
        if not len(at):
            return
        total = np.cumsum(self.count[slot])
        lo = 0
        while lo < len(at):
            hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + most, "right")))
            yield lo, hi
            lo = hi

    def verify(self, k: int, text: np.ndarray, diagonal: int) -> tuple[int, int] | None:
        """(edits, end) of the best alignment of item ``k`` within the band of diagonals
        [diagonal, diagonal + 2k + 1], or None beyond the budget. Cell j of row i stands for the text
        up to place i + diagonal + j; the ends of the text are free."""
        item, most = self.codes[k], int(self.budget[k])
        m, n, w = len(item), len(text), 2 * most + 2
        if not most:
            lo = [d for d in range(max(0, diagonal), diagonal + w) if 0 <= d <= n - m and np.array_equal(text[d:d + m], item)]
            return (0, lo[0] + m) if lo else None
        big = m + n + 1
        pad = np.full(m + w, 1 << 40, np.uint64)  # characters outside the text match nothing
        lo, hi = max(0, diagonal), min(n, diagonal + m + w)
        if lo < hi:
            pad[lo - diagonal:hi - diagonal] = text[lo:hi]
        place = diagonal + np.arange(w)
        row = np.where((place >= 0) & (place <= n), 0, big)
        steps, edges = np.arange(w), diagonal < 0 or diagonal + m + w > n
        for i in range(m):
            new = row + (pad[i:i + w] != item[i])  # match or exchange
            new[:-1] = np.minimum(new[:-1], row[1:] + 1)  # a character of the item is missing
            new = np.minimum.accumulate(new - steps) + steps  # a character of the text is extra
            row = np.where((place + i + 1 >= 0) & (place + i + 1 <= n), new, big) if edges else new
            if i % 8 == 7 and row.min() > most:
                return None
        best = int(row.min())
        return (best, diagonal + m + int(np.flatnonzero(row == best)[0])) if best <= most else None


def find(index: Index, texts: list[str | None]) -> Iterator[tuple[int, int, int, int]]:
    """(text number, item number, places, least edits) of the items that stand in the texts."""
    gap = np.full(int(index.budget.max(initial=0)) + Q, _BETWEEN, np.uint64)
    held, number, size = [], [], 0
    for n, text in enumerate(texts):
        codes = _codes(fold(text))
        if len(codes):
            held += [codes, gap]
            number.append(n)
            size += len(codes) + len(gap)
        if held and (size >= CHUNK or n == len(texts) - 1):
            yield from _find(index, held, number)
            held, number, size = [], [], 0
    if held:
        yield from _find(index, held, number)


def _find(index: Index, held: list[np.ndarray], number: list[int]) -> Iterator[tuple[int, int, int, int]]:
    codes = np.concatenate(held)
    ends = np.cumsum([len(h) for h in held])[1::2]
    out: dict[tuple[int, int], dict[int, int]] = {}
    for k, diagonal in zip(*(x.tolist() for x in index.bands(codes))):
        hit = index.verify(k, codes, diagonal)
        if hit:
            places = out.setdefault((int(np.searchsorted(ends, hit[1], "right")), k), {})
            places[hit[1]] = min(hit[0], places.get(hit[1], hit[0]))
    for (n, k), places in out.items():
        at = sorted(places)
        # ends within the budget of each other are one place
        count = 1 + sum(b - a > 2 * int(index.budget[k]) + 1 for a, b in zip(at, at[1:]))
        yield number[n], k, count, min(places.values())
    for k in index.short:
        word = "".join(map(chr, index.codes[k].tolist()))
        for n, text in zip(number, held[::2]):
            count = text.astype("<u4").tobytes().decode("utf-32-le", "replace").count(word)
            if count:
                yield n, k, count, 0


def _blocks(benchmark: DataFrame, size: int) -> Iterator[list[tuple]]:
    """The items, at most ``size`` characters (one item at least) at a time."""
    held, n = [], 0
    for row in need(benchmark, "item_id", "text").toLocalIterator():
        if held and n + len(row["text"] or "") > size:
            yield held
            held, n = [], 0
        held.append((row["item_id"], row["text"]))
        n += len(row["text"] or "")
    if held:
        yield held


def matches(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, block: int = BLOCK) -> DataFrame:
    """(doc_id, item_id, n_places, edits): the items that stand in each document."""
    spark = docs.sparkSession
    own = need(docs, "doc_id", "text")
    id_type, item_type = own.schema["doc_id"].dataType, benchmark.schema["item_id"].dataType
    out = None
    for items in _blocks(benchmark, block):
        shared = spark.sparkContext.broadcast([(None if i is None else str(i), t) for i, t in items])

        def each(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            index = Index(shared.value, rate)
            for b in batches:
                ids = b["doc_id"].tolist()
                rows = [(ids[n], index.ids[k], places, edits) for n, k, places, edits in find(index, b["text"].tolist())]
                yield pd.DataFrame(rows, columns=["doc_id", "item_id", "n_places", "edits"])

        found = own.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(
            each, "doc_id string, item_id string, n_places long, edits long")
        out = found if out is None else out.union(found)
    if out is None:
        out = spark.createDataFrame([], "doc_id string, item_id string, n_places long, edits long")
    return out.select(F.col("doc_id").cast(id_type).alias("doc_id"), F.col("item_id").cast(item_type).alias("item_id"), "n_places", "edits")


def decontaminate(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """``docs`` without the documents in which a benchmark item stands."""
    mark = fresh(docs, "_hit")
    bad = stored(matches(docs, benchmark, rate).select(F.col("doc_id").alias(mark)).distinct(), "contaminated")
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad[mark]), "left_anti")
