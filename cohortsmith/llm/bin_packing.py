"""Best-fit packing of token sequences, mended by swap-based local search.

Documents are tokenized once (ids of the given byte-level vocabulary, then the id that ends a
document), cut into pieces only where they are longer than a sequence, and the narrow table of
pieces is stored. Full pieces are sequences of their own. The others are dealt at random into
groups of bounded size; each group is packed by best fit, longest first, and its underfull
sequences are then searched: moves and one-for-one and two-for-one exchanges that increase the
sum of squared fills push tokens together until sequences empty. What is still underfull in any
group is dissolved and packed again, group sizes bounded as before, until one group holds it or
nothing more is gained.

The ids come from a fast encoder over the ranks of the same vocabulary, or from the tokenizer file's
own where a text has a very long run of white space; tests hold them equal. A sequence's number is
its level, group and bin in 8, 32 and 24 bits (a full piece: its place in the stored table), so no
two sequences share one.

Defined cases: a null or empty text is the end id alone; a repeated row is packed as often as it
stands (rows of one doc_id and text get their places in any order); a very long text is cut into
full pieces of which only the first may be shorter; a null doc_id is packed like any other; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import vocabulary
from .common import need, stored

CAPACITY = 2048
#: Pieces of a group: what one task packs.
GROUP = 50_000
END_ID = 0


def cuts(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids; the first one may be shorter than the others."""
    first = n % capacity or capacity
    return [(0, min(first, n))] + [(s, capacity) for s in range(first, n, capacity)]


def pieces(docs: DataFrame, capacity: int = CAPACITY, with_ids: bool = False, ranks_path: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every row of ``docs``."""
    narrow = need(docs, "doc_id", "text")
    id_type = narrow.schema["doc_id"].dataType
    schema = "doc_id string, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = vocabulary.byte_encoder(ranks_path)
        for b in batches:
            rows = []
            for doc_id, text in zip(b["doc_id"], b["text"]):
                ids = np.array([*encode(text or ""), END_ID], "<u4")
                for k, (start, length) in enumerate(cuts(len(ids), capacity)):
                    raw = ids[start:start + length].tobytes()
                    rows.append((doc_id, k, start, length, zlib.crc32(raw), raw)[:5 + with_ids])
            yield pd.DataFrame(rows, columns=[f.strip().split()[0] for f in schema.split(",")])

    return narrow.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(each, schema).withColumn(
        "doc_id", F.col("doc_id").cast(id_type))


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of indices: longest first, each into the fullest bin that still takes it."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_rooms = 0  # bit r: some bin has r free
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fit = open_rooms >> n
        if fit:
            room = n + (fit & -fit).bit_length() - 1
            k = by_room[room].pop()
            if not by_room[room]:
                open_rooms &= ~(1 << room)
            bins[k].append(i)
        else:
            room, k = capacity, len(bins)
            bins.append([i])
        rest = room - n
        if rest:
            by_room[rest].append(k)
            open_rooms |= 1 << rest
    return bins


class _Takers:
    """Underfull bins by room, by (item, room) and by (sum of two items, room), as bit masks of rooms."""

    #: Pairs are looked up in bins of at most so many items; longer bins take part with single items.
    PAIR_ITEMS = 12

    def __init__(self):
        self.mask: dict = defaultdict(int)
        self.at: dict = defaultdict(set)

    @classmethod
    def _keys(cls, items: list[int]) -> set:
        pairs = combinations(items, 2) if len(items) <= cls.PAIR_ITEMS else ()
        return {0, *items, *(-(a + b) for a, b in pairs)}  # 0: nothing leaves; negative: two leave

    def add(self, k: int, items: list[int], room: int) -> None:
        for key in self._keys(items):
            self.at[key, room].add(k)
            self.mask[key] |= 1 << room

    def drop(self, k: int, items: list[int], room: int) -> None:
        for key in self._keys(items):
            held = self.at[key, room]
            held.discard(k)
            if not held:
                self.mask[key] &= ~(1 << room)

    def find(self, key: int, least: int) -> int | None:
        """A bin with the items of ``key`` and at least that room, the least room of such."""
        rooms = self.mask.get(key, 0) >> least
        if not rooms:
            return None
        return min(self.at[key, least + (rooms & -rooms).bit_length() - 1])


def local_search(bins: list[list[int]], lengths: np.ndarray, capacity: int, rounds: int = 3) -> list[list[int]]:
    """Moves, one-for-one and two-for-one exchanges between underfull bins that increase the sum
    of squared fills, until bins empty.

    All free room together bounds how many bins can go, so the givers are a few times as many of
    the emptiest ones. A giver's item goes to another bin that has room, or that has it when one
    shorter item, or two, come back: the giver loses tokens to a bin at least as full, which
    increases the squares. What is moved most is tried first."""
    size = lengths.tolist()
    fills = [sum(size[i] for i in b) for b in bins]
    can_go = sum(capacity - f for f in fills) // capacity
    if not can_go:
        return bins
    takers = _Takers()
    order = sorted((k for k, f in enumerate(fills) if f < capacity), key=lambda k: fills[k])
    givers = order[:4 * can_go + 16]
    rest = set(order) - set(givers)
    widest = 0
    for k in rest:
        takers.add(k, [size[i] for i in bins[k]], capacity - fills[k])
        widest = max(widest, capacity - fills[k])
    for giver in givers:  # earlier givers that were not emptied stand in the index again
        for _ in range(rounds):
            gained = False
            for i in sorted(bins[giver], key=lambda i: -size[i]):
                n = size[i]
                k, out = takers.find(0, n), []
                if k is None:
                    for d in range(min(widest, n), 0, -1):
                        k = takers.find(n - d, d) if n > d else None
                        if k is not None:
                            out = [next(j for j in bins[k] if size[j] == n - d)]
                            break
                        k = takers.find(d - n, d) if n > d else None
                        if k is not None:
                            out = next(list(p) for p in combinations(bins[k], 2) if size[p[0]] + size[p[1]] == n - d)
                            break
                    if k is None:
                        continue
                moved = n - sum(size[j] for j in out)
                if fills[k] + moved <= fills[giver]:  # the squares would not grow
                    continue
                takers.drop(k, [size[j] for j in bins[k]], capacity - fills[k])
                bins[giver] = [j for j in bins[giver] if j != i] + out
                bins[k] = [j for j in bins[k] if j not in out] + [i]
                fills[giver] -= moved
                fills[k] += moved
                if fills[k] < capacity:
                    takers.add(k, [size[j] for j in bins[k]], capacity - fills[k])
                gained = True
            if not gained or not bins[giver]:
                break
        if bins[giver]:
            takers.add(giver, [size[j] for j in bins[giver]], capacity - fills[giver])
            widest = max(widest, capacity - fills[giver])
    return [b for b in bins if b]


def _pack_groups(rows: DataFrame, groups: int, capacity: int, seed: int) -> DataFrame:
    """One packing round: (key..., group, bin, offset, fill) of each row of ``rows``."""
    schema = T.StructType([*rows.schema.fields, T.StructField("group", T.LongType()), T.StructField("bin", T.LongType()),
                           T.StructField("offset", T.LongType()), T.StructField("fill", T.LongType())])

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["length", "_key", "piece"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        lengths = frame["length"].to_numpy(np.int64)
        bins = local_search(best_fit(lengths, capacity), lengths, capacity)
        order = np.concatenate([np.array(b, np.int64) for b in bins])
        counts = np.array([len(b) for b in bins])
        in_order = lengths[order]
        ends = np.cumsum(in_order)
        fills = np.add.reduceat(in_order, np.concatenate(([0], np.cumsum(counts)[:-1])))
        out = frame.iloc[order].copy()
        out["bin"] = np.repeat(np.arange(len(bins)), counts)
        out["offset"] = ends - in_order - np.repeat(np.cumsum(fills) - fills, counts)
        out["fill"] = np.repeat(fills, counts)
        return out

    group = F.pmod(F.xxhash64(F.lit(seed), "_key", "piece"), F.lit(groups)).alias("group")
    return rows.select("*", group).groupBy("group").applyInPandas(pack, schema)


def _number(level: int) -> Column:
    return F.lit((level + 1) << 56) + F.shiftleft(F.col("group"), 24) + F.col("bin")


def pack(docs: DataFrame, capacity: int = CAPACITY, group: int = GROUP, with_ids: bool = False, ranks_path: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset) of every piece."""
    cut = stored(pieces(docs, capacity, with_ids, ranks_path), "pieces")
    columns = cut.columns
    keyed = cut.withColumn("_key", F.monotonically_increasing_id())  # the stored table gives it the same order again
    full = keyed.where(F.col("length") == capacity).select(
        *columns, F.col("_key").alias("_seq"), F.lit(0).cast("long").alias("offset"))
    rest, n, level = keyed.where(F.col("length") < capacity), None, 0
    done = []
    while True:
        n_now = rest.count()
        if not n_now or (n is not None and n_now > 0.9 * n):
            break
        n, groups = n_now, -(-n_now // group)
        packed = stored(_pack_groups(rest, groups, capacity, level), f"packed{level}")
        last = groups == 1
        # a sequence with less than one part in 64 free is as good as full
        good = F.lit(True) if last else F.col("fill") >= capacity - capacity // 64
        done.append(packed.where(good).select(*columns, _number(level).alias("_seq"), "offset"))
        rest, level = packed.where(~good).select(*columns, "_key"), level + 1
        if last:
            rest = None
            break
    if rest is not None and n_now:  # the last round gained little: its sequences stay as they are
        done.append(packed.where(~good).select(*columns, _number(level - 1).alias("_seq"), "offset"))
    out = full
    for d in done:
        out = out.union(d)
    return out.select(*columns, F.col("_seq").alias("sequence_id"), "offset")
