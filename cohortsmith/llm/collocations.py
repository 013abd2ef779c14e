"""Phrase collocations of every language, counted in quotient filters that lose nothing.

Words become ids by a dictionary of the frequent words of each language (a phrase can't stand more
often than its words), packed n-grams of ids are permuted invertibly, and the permuted number is
split into a block, a quotient and the full remainder. A filter is the sorted remainders of a block,
the number of them under each quotient, and their counters (a byte each, larger ones apart). As
nothing of the number is left out, a filter counts exactly and gives the n-gram back. Each task
makes filters of bounded size; those of one block meet in one group, are merged by sorted runs, and
their counters added. A common phrase is one counter in each filter, and the permutation makes the
blocks even, so no phrase weighs on a task.

Two-word phrases are counted first. Longer ones can't be frequent unless all their two-word parts
are, so only windows over frequent pairs are counted next; which pairs are, each task sees in a
bitmap of ``PAIR_BITS`` bits at most (16 MB, the one broadcast table). A bit that stands for several
pairs lets windows through that are counted and then found rare, so the result doesn't depend on
the bitmap; from some 10^8 frequent pairs on it is full and saves nothing.

The dictionary is never sent whole to a task. Texts are cut once into blocks of at most ``BLOCK``
tokens with a vocabulary of their own (stored; smaller than the texts); the vocabularies are
joined with the dictionary, and each block gets the ids of its own words back.

Scores, cuts and containment are joins over the frequent phrases, with exact decimal arithmetic.

Defined cases: a null text has no words; a null lang is ``und``; pieces never cross documents;
repeated rows count as often as they stand; a text of any length is cut between words, the next
block repeating the last words before the cut without counting them; an empty table gives an empty
result; other columns, clashing names included, are ignored.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import need, stored

MIN_COUNT = 100
LONGEST = 5
TOP = 2000
#: Tokens of a block of text, windows of a filter, and the windows that a merged block may come from.
BLOCK = 1 << 19
HELD = 1 << 21
#: The bitmap of frequent pairs: bits for each pair, least and most bits, bits of a slice (as powers of two).
PAIR_SHARE, PAIR_LEAST, PAIR_BITS, PAIR_SLICE = 6, 16, 27, 20
#: Bytes of a text that are split into words at a time.
CHUNK = 1 << 22
#: Buckets in which the dictionary is numbered, and in which a language's phrases are ranked first.
NUMBERING, RANKING = 1024, 64

_END = b"\xff"  # never a byte of UTF-8
#: A-Z to lower case, the ends of pieces to _END, a tab to a space.
_FOLD = bytes(0xFF if c in b".,;:!?\n\x0b\x0c\r" else 0x20 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))


# --- blocks of tokens with a vocabulary of their own ---------------------------------------------

def _tokens(text: str) -> Iterator[list[bytes]]:
    """The words of a text in lists, with _END between pieces and after the last."""
    data = text.encode().translate(_FOLD)
    at = 0
    while at < len(data):
        to = len(data)
        if to - at > CHUNK:
            to = data.rfind(b" ", at, at + CHUNK)
            to = to if to > at else data.find(b" ", at + CHUNK)
            to = to if to > at else len(data)
        yield data[at:to].replace(_END, b" \xff ").split()
        at = to
    yield [_END]


class _Block:
    """Tokens of one language as local ids; id 0 ends a piece."""

    def __init__(self, before: list[bytes] = ()):
        self.ids: dict[bytes, int] = {_END: 0}
        self.tokens = array("I")
        self.add(before)
        self.skip = len(self.tokens)

    def add(self, words: list[bytes]) -> None:
        ids = self.ids
        self.tokens.extend([ids.setdefault(w, len(ids)) for w in words])

    def last(self, longest: int) -> list[bytes]:
        """The words that a window over the end of the block may need."""
        names = list(self.ids)
        tail = [names[i] for i in self.tokens[max(0, len(self.tokens) - longest + 1):]]
        return tail[len(tail) - tail[::-1].index(_END):] if _END in tail else tail

    def row(self, number: int, lang: str) -> dict:
        tokens = np.frombuffer(self.tokens, np.uint32)
        counts = np.bincount(tokens[self.skip:], minlength=len(self.ids))
        return {"block": [number], "lang": [lang], "skip": [self.skip], "tokens": [tokens.astype("<u2" if len(self.ids) <= 1 << 16 else "<u4").tobytes()],
                "wide": [len(self.ids) > 1 << 16], "words": [[w.decode() for w in list(self.ids)[1:]]], "counts": [counts[1:].tolist()]}


_BLOCKS = pa.schema([("block", pa.int64()), ("lang", pa.string()), ("skip", pa.int32()), ("tokens", pa.binary()), ("wide", pa.bool_()),
                     ("words", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))])


def token_blocks(docs: DataFrame, longest: int = LONGEST, block: int = BLOCK) -> DataFrame:
    """(block, lang, skip, tokens, wide, words, counts): all texts, a row for each block."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held: dict[str, _Block] = {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                for words in _tokens(text):
                    for at in range(0, len(words), block):
                        own = held.setdefault(lang, _Block())
                        own.add(words[at:at + block])
                        if len(own.tokens) >= block:
                            yield pa.RecordBatch.from_pydict(own.row(number, lang), _BLOCKS)
                            number += 1
                            held[lang] = _Block(own.last(longest))
                if sum(len(b.tokens) for b in held.values()) >= 4 * block:  # many languages in one task
                    for name, b in held.items():
                        yield pa.RecordBatch.from_pydict(b.row(number, name), _BLOCKS)
                        number += 1
                    held = {}
        for name, b in held.items():
            yield pa.RecordBatch.from_pydict(b.row(number, name), _BLOCKS)
            number += 1

    own = need(docs, "lang", "text").select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    return own.mapInArrow(each, "block long, lang string, skip int, tokens binary, wide boolean, words array<string>, counts array<long>")


def numbered(words: DataFrame) -> DataFrame:
    """``words`` with gapless ``gid`` from 1, numbered in buckets and shifted by the buckets' counts."""
    parts = words.withColumn("_bucket", F.pmod(F.xxhash64("lang", "word"), F.lit(NUMBERING)))
    before = parts.groupBy("_bucket").count().select(
        "_bucket", F.coalesce(F.sum("count").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_bucket").orderBy("lang", "word"))
    return parts.join(F.broadcast(before), "_bucket").withColumn("gid", F.col("_before") + place).drop("_bucket", "_before")


# --- counting quotient filters --------------------------------------------------------------------

_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _ODD[0]
    x = (x ^ (x >> np.uint64(29))) * _ODD[1]
    return x ^ (x >> np.uint64(32))


def permute(words: list[np.ndarray], bits: int, back: bool = False) -> list[np.ndarray]:
    """An invertible permutation of n-grams of ``bits``-bit ids: round by round one word is xored
    with a hash of the others; ``back`` undoes it."""
    words, n = list(words), len(words)
    rounds = range(n + 2)
    for r in reversed(rounds) if back else rounds:
        h = np.full(len(words[0]), r + 1, np.uint64)
        for j in range(n):
            if j != r % n:
                h += (words[j] + np.uint64(r)) * _ODD[(j + r) % 5]
        words[r % n] = words[r % n] ^ (_scramble(h) >> np.uint64(64 - bits))
    return words


def pack(words: list[np.ndarray], bits: int) -> list[np.ndarray]:
    """The words one after the other as a number in 64-bit limbs, its first bit the highest."""
    limbs = [np.zeros(len(words[0]), np.uint64) for _ in range(-(-len(words) * bits // 64))]
    for i, w in enumerate(words):
        k, used = divmod(i * bits, 64)
        over = used + bits - 64
        if over <= 0:
            limbs[k] |= w << np.uint64(-over)
        else:
            limbs[k] |= w >> np.uint64(over)
            limbs[k + 1] |= w << np.uint64(64 - over)
    return limbs


def unpack(limbs: list[np.ndarray], n: int, bits: int) -> list[np.ndarray]:
    mask, out = np.uint64((1 << bits) - 1), []
    for i in range(n):
        k, used = divmod(i * bits, 64)
        over = used + bits - 64
        w = limbs[k] >> np.uint64(-over) if over <= 0 else (limbs[k] << np.uint64(over)) | (limbs[k + 1] >> np.uint64(64 - over))
        out.append(w & mask)
    return out


def _added(limbs: list[np.ndarray], counts: np.ndarray | None) -> tuple[list[np.ndarray], np.ndarray]:
    """Sorted distinct numbers and the sums of their counts; runs that are sorted are merged."""
    order = np.argsort(limbs[0], kind="stable")
    first = limbs[0][order]
    same = first[1:] == first[:-1]
    if len(limbs) > 1 and same.any():
        places = np.flatnonzero(same)
        if any((x[order[places]] != x[order[places + 1]]).any() for x in limbs[1:]):
            order = np.lexsort(limbs[::-1])
            first = limbs[0][order]
            same = first[1:] == first[:-1]
    limbs = [first] + [x[order] for x in limbs[1:]]
    for x in limbs[1:]:
        same &= x[1:] == x[:-1]
    starts = np.flatnonzero(np.concatenate(([True], ~same)))
    counts = np.add.reduceat(counts[order], starts) if counts is not None else np.diff(np.append(starts, len(first)))
    return [x[starts] for x in limbs], counts.astype(np.int64)


def _least(a: np.ndarray) -> bytes:
    """Unsigned numbers in the least width that holds them, which stands first."""
    width = next(w for w in (1, 2, 4, 8) if int(a.max(initial=0)) < 1 << (8 * w))
    return bytes([width]) + a.astype(f"<u{width}").tobytes()


def _from_least(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"<u{raw[0]}", offset=1).astype(np.int64)


def _widths(total: int, head: int) -> list[int]:
    """Bytes that each limb's remainder takes: of the first what is left behind the head."""
    limbs = -(-total // 64)
    return [-(-(min(64, total - 64 * i) - (head if i == 0 else 0)) // 8) for i in range(limbs)]


def encode(limbs: list[np.ndarray], counts: np.ndarray, total: int, block_bits: int) -> tuple[int, bytes, bytes, bytes]:
    """A filter of sorted distinct numbers of one block: (quotient bits, runs, remainders, counters)."""
    q = max(0, min(len(counts).bit_length() - 1, min(total, 63) - block_bits))
    head = block_bits + q
    low = limbs[0] << np.uint64(block_bits)
    quotient = (low >> np.uint64(64 - q)).astype(np.int64) if q else np.zeros(len(counts), np.int64)
    parts = []
    for x, width in zip([limbs[0] << np.uint64(head), *limbs[1:]], _widths(total, head)):
        parts.append(x.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes())
    small = np.minimum(counts, 255).astype(np.uint8)
    return q, _least(np.bincount(quotient, minlength=1 << q)), b"".join(parts), small.tobytes() + counts[small == 255].astype("<i8").tobytes()


def decode(block: int, q: int, runs: bytes, rests: bytes, counters: bytes, entries: int, total: int, block_bits: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The numbers of a filter in their order, and their counts."""
    head, limbs, at = block_bits + q, [], 0
    for width in _widths(total, head):
        wide = np.zeros((entries, 8), np.uint8)
        wide[:, :width] = np.frombuffer(rests, np.uint8, entries * width, at).reshape(entries, width)
        limbs.append(wide.view(">u8").ravel().astype(np.uint64))
        at += entries * width
    top = np.repeat(np.arange(1 << q, dtype=np.uint64), _from_least(runs)) | np.uint64(block << q)
    limbs[0] = (limbs[0] >> np.uint64(head)) | (top << np.uint64(64 - head) if head else np.uint64(0))
    counts = np.frombuffer(counters, np.uint8, entries).astype(np.int64)
    counts[counts == 255] = np.frombuffer(counters, "<i8", offset=entries)
    return limbs, counts


_FILTER = "n_words int, block long, entries int, q int, runs binary, rests binary, counters binary"


def pair_bitmap(pairs: DataFrame, bits: int, size: int) -> np.ndarray:
    """2**size bits; set where the permuted number of a frequent pair begins with the bit's place."""
    step = min(size, PAIR_SLICE)

    def places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                gids = np.stack(b["gids"].to_numpy()).astype(np.uint64)
                at = pack(permute([gids[:, 0], gids[:, 1]], bits), bits)[0] >> np.uint64(64 - size)
                yield pd.DataFrame({"at": np.unique(at.astype(np.int64))})

    def slice_of(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        dense = np.zeros(1 << step, bool)
        dense[frame["at"].to_numpy() & ((1 << step) - 1)] = True
        return pd.DataFrame({"slice": [int(key[0])], "bits": [np.packbits(dense).tobytes()]})

    found = pairs.mapInPandas(places, "at long").distinct().groupBy(F.shiftright("at", step).alias("slice")).applyInPandas(slice_of, "slice long, bits binary")
    out = np.zeros(1 << size, bool)
    for at, raw in found.toLocalIterator():
        out[at << step:(at + 1) << step] = np.unpackbits(np.frombuffer(raw, np.uint8))[:1 << step]
    return np.packbits(out)


def filters(blocks: DataFrame, bits: int, block_bits: int, lengths: range, held: int = HELD, pairs: np.ndarray | None = None) -> DataFrame:
    """Filters of the windows of known words of the given lengths (from 2, or from 3 over the bitmap
    of pairs): blocks of tokens, with the ids of their words, in; a row for each length and block of
    numbers out."""
    names = [f.split()[0] for f in _FILTER.split(", ")]
    shared = blocks.sparkSession.sparkContext.broadcast(pairs)

    def flush(n: int, parts: list[list[np.ndarray]]) -> pa.RecordBatch:
        limbs, counts = _added([np.concatenate(x) for x in zip(*parts)], None)
        shift = min(block_bits, n * bits)
        of = (limbs[0] >> np.uint64(64 - shift)).astype(np.int64) if shift else np.zeros(len(counts), np.int64)
        edges = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1], [True])))
        rows = [(n, int(of[a]), int(b - a), *encode([x[a:b] for x in limbs], counts[a:b], n * bits, shift)) for a, b in zip(edges[:-1], edges[1:])]
        types = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, list] = {n: [] for n in lengths}
        size = dict.fromkeys(parts, 0)
        for batch in batches:
            for r in range(batch.num_rows):
                row = {name: batch.column(name)[r] for name in batch.schema.names}
                tokens = np.frombuffer(row["tokens"].as_buffer(), "<u4" if row["wide"].as_py() else "<u2")
                known = row["known"].values
                ids = np.zeros(int(tokens.max(initial=0)) + 1, np.uint64)
                ids[known.field("local").to_numpy(zero_copy_only=False)] = known.field("gid").to_numpy(zero_copy_only=False).astype(np.uint64)
                seq, skip = ids[tokens], row["skip"].as_py()
                good = (seq[:-1] > 0) & (seq[1:] > 0)  # a pair starts here
                if shared.value is not None:
                    at = np.flatnonzero(good)
                    size_bits = (8 * len(shared.value)).bit_length() - 1
                    place = (pack(permute([seq[at], seq[at + 1]], bits), bits)[0] >> np.uint64(64 - size_bits)).astype(np.int64)
                    good[at] = (shared.value[place >> 3] << (place & 7).astype(np.uint8)) & 128 > 0
                ok = good
                for n in range(2, lengths[-1] + 1):
                    ok = ok if n == 2 else ok[:-1] & good[n - 2:]  # a window of n words starts here
                    if n not in parts:
                        continue
                    at = np.flatnonzero(ok)
                    at = at[at + n - 1 >= skip]
                    if len(at):
                        parts[n].append(pack(permute([seq[at + j] for j in range(n)], bits), bits))
                        size[n] += len(at)
                    if size[n] >= held:
                        yield flush(n, parts[n])
                        parts[n], size[n] = [], 0
        for n in parts:
            if size[n]:
                yield flush(n, parts[n])

    return blocks.mapInArrow(each, _FILTER)


def merged(rows: DataFrame, bits: int, block_bits: int, min_count: int = MIN_COUNT) -> DataFrame:
    """(gids, a): the n-grams that all filters together count ``min_count`` times or more."""
    def merge(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        n = int(key[0])
        shift = min(block_bits, n * bits)
        limbs, counts = [], []
        for f in frame.itertuples():
            x, c = decode(int(f.block), int(f.q), f.runs, f.rests, f.counters, int(f.entries), n * bits, shift)
            limbs.append(x)
            counts.append(c)
        sums, total = _added([np.concatenate(x) for x in zip(*limbs)], np.concatenate(counts))
        keep = total >= min_count
        words = permute(unpack([x[keep] for x in sums], n, bits), bits, back=True)
        return pd.DataFrame({"gids": pd.Series(list(np.stack(words, 1).astype(np.int64)), dtype=object), "a": total[keep]})

    return rows.groupBy("n_words", "block").applyInPandas(merge, "gids array<long>, a long")


# --- the operator ---------------------------------------------------------------------------------

def collocations(docs: DataFrame, min_count: int = MIN_COUNT, longest: int = LONGEST, top: int = TOP, block: int = BLOCK,
                 held: int = HELD, merge: int = HELD, contained_percent: int = 100) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of each language's best phrases."""
    blocks = stored(token_blocks(docs, longest, block), "token-blocks")
    sizes = blocks.groupBy("lang").agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda x, y: x + y)).alias("n"))
    words = blocks.select("block", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("local", "w")).select(
        "block", "lang", (F.col("local") + 1).alias("local"), F.col("w.words").alias("word"), F.col("w.counts").alias("count"))
    frequent = words.groupBy("lang", "word").agg(F.sum("count").alias("f")).where(F.col("f") >= min_count)
    dictionary = stored(numbered(frequent).select("lang", "word", "f", "gid"), "dictionary")
    known, windows = dictionary.agg(F.count("*"), F.coalesce(F.sum("f"), F.lit(0))).first()
    bits = max(1, int(known).bit_length())
    block_bits = min(2 * bits, 40, max(0, int(windows - 1) // merge).bit_length())
    ids = words.join(dictionary.select("lang", "word", "gid"), ["lang", "word"]).groupBy("block").agg(F.collect_list(F.struct("local", "gid")).alias("known"))
    with_ids = stored(blocks.select("block", "skip", "tokens", "wide").join(ids, "block").drop("block"), "known")

    def counted(lengths: range, pairs: np.ndarray | None = None) -> DataFrame:
        return stored(merged(filters(with_ids, bits, block_bits, lengths, held, pairs), bits, block_bits, min_count), "phrases")

    phrases = counted(range(2, 3))
    if longest > 2:
        size = min(PAIR_BITS, max(PAIR_LEAST, phrases.count().bit_length() + PAIR_SHARE))
        phrases = phrases.union(counted(range(3, longest + 1), pair_bitmap(phrases, bits, size)))

    # every part of a frequent phrase is itself frequent, so the joins below lose nothing
    parts = phrases.select("gids", F.col("a").alias("f")).union(dictionary.select(F.array("gid"), "f"))
    langs = dictionary.select(F.col("gid").alias("_first"), "lang").join(sizes, "lang")
    whole = phrases.withColumn("_first", F.col("gids")[0]).join(langs, "_first").drop("_first")
    cuts = whole.select("*", F.explode(F.sequence(F.lit(1), F.size("gids") - 1)).alias("k")).select(
        "*", F.slice("gids", F.lit(1), F.col("k")).alias("_left"), F.slice("gids", F.col("k") + 1, F.size("gids")).alias("_right"))
    cuts = cuts.join(parts.select(F.col("gids").alias("_left"), F.col("f").alias("l")), "_left").join(
        parts.select(F.col("gids").alias("_right"), F.col("f").alias("r")), "_right")
    value = F.expr("CAST(a * 1000 AS DECIMAL(19,0)) * CAST(n AS DECIMAL(18,0)) DIV (CAST(l AS DECIMAL(19,0)) * CAST(r AS DECIMAL(18,0)))")
    scored = cuts.withColumn("score", value).groupBy("gids").agg(
        F.min(F.struct("score", "k", "l", "r")).alias("cut"), F.first("a").alias("a"), F.first("n").alias("n"), F.first("lang").alias("lang"))

    n_gids = F.size("gids")
    inner = phrases.select("a", "gids", F.explode(F.sequence(F.lit(2), F.greatest(n_gids - 1, F.lit(2)))).alias("_n")).where(F.col("_n") < n_gids)
    inner = inner.select("a", "_n", "gids", F.explode(F.sequence(F.lit(1), n_gids - F.col("_n") + 1)).alias("_at"))
    longer = inner.groupBy(F.slice("gids", F.col("_at"), F.col("_n")).alias("gids")).agg(F.max("a").alias("_longer"))
    kept = scored.join(longer, "gids", "left").where(F.col("_longer").isNull() | (100 * F.col("_longer") < contained_percent * F.col("a")))

    best = [F.desc("score"), F.desc("a")]
    flat = kept.select("gids", "lang", "a", "n", "cut.score", "cut.l", "cut.r")
    first = flat.withColumn("_r", F.rank().over(Window.partitionBy("lang", F.pmod(F.xxhash64("gids"), F.lit(RANKING))).orderBy(*best))).where(F.col("_r") <= top)
    some = first.withColumn("_r", F.rank().over(Window.partitionBy("lang").orderBy(*best))).where(F.col("_r") <= top).drop("_r")
    text = some.select("gids", F.posexplode("gids").alias("_at", "gid")).join(dictionary.select("gid", "word"), "gid").groupBy("gids").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*best, "phrase")).cast("long")
    return some.join(text, "gids").withColumn("rank", rank).where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


#: The same rows from lists of words, for DuckDB.
SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
words AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
sizes AS (SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang),
grams AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM words),
f AS (SELECT lang, w[i:i + k - 1] AS g, count(*) AS a FROM grams, range(1, 6) AS t(k) WHERE i + k - 1 <= len(w) GROUP BY ALL HAVING count(*) >= 100),
cuts AS (SELECT lang, g, a, unnest(range(1, len(g))) AS k FROM f WHERE len(g) > 1),
scored AS (
  SELECT c.lang, c.g, c.a, x.a AS l, y.a AS r, s.n, c.k, (1000::HUGEINT * c.a * s.n) // (x.a::HUGEINT * y.a) AS score
  FROM cuts c JOIN sizes s USING (lang) JOIN f x ON x.lang = c.lang AND x.g = c.g[1:c.k] JOIN f y ON y.lang = c.lang AND y.g = c.g[c.k + 1:]),
one AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
starts AS (SELECT lang, g, a, k, unnest(range(1, len(g) - k + 2)) AS i FROM f, range(2, 5) AS t(k) WHERE k < len(g)),
longer AS (SELECT lang, g[i:i + k - 1] AS g, max(a) AS most FROM starts GROUP BY ALL),
named AS (
  SELECT o.lang, array_to_string(o.g, ' ') AS phrase, o.a, l, r, n, score::BIGINT AS score
  FROM one o LEFT JOIN longer z ON z.lang = o.lang AND z.g = o.g WHERE z.most IS NULL OR 100 * z.most < 100 * o.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM named QUALIFY rank <= 2000
"""
