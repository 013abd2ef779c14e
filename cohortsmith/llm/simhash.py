"""SimHash near-duplicates by anchor points of a covering code.

A covering code of radius R has, for any word, a codeword within R bits. If two fingerprints
differ in at most t bits, the codeword nearest to the one lies within R + t bits of the other.
So each fingerprint has one *home* anchor (its nearest codeword) and is replicated to every
anchor within R + t; comparing homes with replicas anchor by anchor meets each linked pair.

The code is a direct sum of perfect cyclic codes over the first bits of the fingerprint. In a
direct sum the nearest codeword is found block by block, and only replicas whose excess over
the block radii sums to at most t can meet a home, so no others are made. Bits outside the
blocks count in the comparison alone: leaving bits out never lengthens a distance. Two binary
Golay codes (46 bits, 2**24 anchors, about 60 replicas for t = 2) are the default; a third
block widens the anchor space for larger corpora (`HAMMING15`: 2**35 anchors, about 150).

Only distinct fingerprints are replicated and compared, so groups of copies cost nothing, and
links are contracted by large-star/small-star rounds on tables in the shared folder.

Defined cases: a null or empty text, or one without words, has fingerprint zero and is linked
like any other; a repeated row is a row of its own with the same fingerprint; a null doc_id
never names a component unless all ids of the component are null; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, hex64, need, stored

#: (length, check bits, generator polynomial, covering radius) of perfect cyclic codes.
GOLAY = (23, 11, 0b101011100011, 3)
HAMMING15 = (15, 4, 0b10011, 1)
CODE = (GOLAY, GOLAY)


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The 64-bit SimHash of a whole text, unsigned."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    joined, sizes = b" ".join(words), np.fromiter(map(len, words), np.int64, len(words))
    k = min(shingle, len(words))
    start = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
    end = start[k - 1:] + sizes[k - 1:]
    digest = xxhash.xxh64_intdigest
    ones, n = np.zeros(64, np.int64), len(end)
    for at in range(0, n, 1 << 16):  # bounded memory for very long texts
        ends = end[at:at + (1 << 16)].tolist()
        h = np.fromiter((digest(joined[a:b], 42) for a, b in zip(start[at:].tolist(), ends)), np.uint64, len(ends))
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > n, bitorder="little")
    return int(bits.view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, t, fp) for every row: t is a hash of the text, fp the fingerprint, both long."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fp = np.array([fingerprint(t, shingle) for t in b["text"]], np.uint64)
            yield pd.DataFrame({"doc_id": b["doc_id"], "t": b["t"], "fp": fp.view(np.int64)})

    narrow = need(docs, "doc_id", "text")
    return narrow.select(F.col("doc_id").cast("string").alias("doc_id"), F.xxhash64("text").alias("t"), "text").mapInPandas(
        each, "doc_id string, t long, fp long").withColumn("doc_id", F.col("doc_id").cast(narrow.schema["doc_id"].dataType))


def _syndromes(words: np.ndarray, n: int, check: int, poly: int) -> np.ndarray:
    """Remainders of polynomials of degree < n by the generator."""
    rest = words.copy()
    for bit in range(n - 1, check - 1, -1):
        rest ^= ((rest >> np.int64(bit)) & 1) * np.int64(poly << (bit - check))
    return rest


def _near(block: tuple[int, int, int, int], extra: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """By syndrome: the error patterns to the codewords within radius + extra, and how far each
    exceeds the radius."""
    n, check, poly, radius = block
    patterns = np.array([sum(1 << b for b in c) for w in range(radius + extra + 1) for c in combinations(range(n), w)], np.int64)
    excess = np.array([max(0, bin(p).count("1") - radius) for p in patterns.tolist()], np.int64)
    by = _syndromes(patterns, n, check, poly)
    order = np.argsort(by, kind="stable")
    cuts = np.searchsorted(by[order], np.arange((1 << check) + 1))
    return [(patterns[o], excess[o]) for o in (order[a:b] for a, b in zip(cuts, cuts[1:]))]


def anchors(fp: int, tables: list, bits: int, code=CODE) -> tuple[int, np.ndarray]:
    """The home anchor of a fingerprint and all anchors within radius + ``bits`` that a home can need."""
    home, keys, over, at = 0, np.zeros(1, np.int64), np.zeros(1, np.int64), 0
    for (n, check, poly, _), near in zip(code, tables):
        word = (fp >> at) & ((1 << n) - 1)
        patterns, excess = near[int(_syndromes(np.array([word], np.int64), n, check, poly)[0])]
        home |= int(word ^ patterns[excess == 0][0]) << at
        keys = (keys[:, None] | ((word ^ patterns) << np.int64(at))[None, :]).ravel()
        over = (over[:, None] + excess[None, :]).ravel()
        keys, over, at = keys[over <= bits], over[over <= bits], at + n
    return home, keys


def links(distinct: DataFrame, bits: int = 2, code=CODE) -> DataFrame:
    """(a, b): pairs of different fingerprints of ``distinct`` at ``bits`` or fewer differing bits,
    each at least once and in either order."""

    def replicate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tables = [_near(b, bits) for b in code]
        for frame in batches:
            fps = frame["fp"].to_numpy(np.int64)
            for at in range(0, len(fps), 2000):
                part = fps[at:at + 2000]
                keys = [anchors(int(x) & (2**64 - 1), tables, bits, code)[1] for x in part]
                yield pd.DataFrame({"anchor": np.concatenate(keys), "b": np.repeat(part, [len(k) for k in keys])})

    def at_home(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tables = [_near(b, 0) for b in code]
        for frame in batches:
            fps = frame["fp"].to_numpy(np.int64)
            yield pd.DataFrame({"anchor": np.array([anchors(int(x) & (2**64 - 1), tables, 0, code)[0] for x in fps], np.int64), "a": fps})

    homes = distinct.mapInPandas(at_home, "anchor long, a long")
    replicas = distinct.mapInPandas(replicate, "anchor long, b long")
    return replicas.join(homes.hint("shuffle_hash"), "anchor").where(
        (F.col("a") != F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= bits)).select("a", "b")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node of each connected component, for nodes that have an edge.

    Large-star, then small-star, until the edges are a star around each root; every round is a
    table in the shared folder, and minima are partial aggregates, so a hub isn't gathered."""
    now = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    sign = None
    for _ in range(max_rounds):
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        # small-star: a node's smaller neighbours and the node itself meet its smallest neighbour
        small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").union(
            down.select("u", F.col("m").alias("v"))).distinct()
        now = stored(small, "edges")
        was, sign = sign, tuple(now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first())
        if sign == was:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _labelled(docs: DataFrame, shingle: int, bits: int, code) -> DataFrame:
    """(doc_id, t, fp, root, component_id) per row of ``docs``."""
    fps = stored(fingerprints(docs, shingle), "fingerprints")
    classes = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    member = components(links(classes.select("fp"), bits, code))
    rooted = classes.join(member, F.col("fp") == F.col("node"), "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return fps.join(rooted.join(named, "root").select("fp", "root", "component_id"), "fp")


def simhash_components(docs: DataFrame, shingle: int = 3, bits: int = 2, code=CODE) -> DataFrame:
    """Per row of ``docs``: doc_id, fingerprint, component_id (the smallest doc_id reachable)."""
    return _labelled(docs, shingle, bits, code).select("doc_id", hex64(F.col("fp")).alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame, shingle: int = 3, bits: int = 2, code=CODE) -> DataFrame:
    """``docs`` with one row for each component: a row of its smallest doc_id (null only where all its
    ids are null); of several such rows, one of the least text hash."""
    of, text = fresh(docs, "_of"), fresh(docs, "_text")
    lead = _labelled(docs, shingle, bits, code).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    kept = lead.groupBy("root").agg(F.min(F.struct("t", "doc_id")).alias("row")).select(F.col("row.doc_id").alias(of), F.col("row.t").alias(text)).distinct()
    marked = docs.withColumn(text, F.xxhash64("text"))
    own = marked.join(kept, marked["doc_id"].eqNullSafe(kept[of]) & (marked[text] == kept[text]), "left_semi")
    return own.dropDuplicates(["doc_id", text]).drop(text)
