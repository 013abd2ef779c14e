"""Removal of repeated word windows, behind a count-min sketch.

A window is 20 consecutive words of one document; a word goes if a window over it has a word
sequence that also starts earlier (smaller doc_id, or the same document and an earlier start).

Pass 1 counts windows in a count-min sketch of two rows. Each partition makes its own sketch, cut
into slices of the cell space; slices are shuffled and merged by stream, a slice at a time, and
what stays of the merged sketch is one bit a cell: counted more than once or not. A window is
counted under its key, the least hash of the 8-word grams within it, at the place where that
gram stands. Equal windows have equal keys at the same offset, so a key's count is no less than
the number of its equal windows, and neighbouring windows share a count, which makes the sketch
about seven times emptier.

Pass 2 reads the documents again and keeps the windows that the sketch estimates as repeated:
these alone are grouped, by 96 bits of two hashes of the window's words. Within a task only the
first of equal windows goes on to the shuffle; the others are known to be repeated there and
then, so a passage of a third of all documents reaches the shuffle once for each task. Windows
travel in packed blocks, a block for each hash bucket; buckets grow in number with the corpus.
Overestimates cost a shuffled row and change nothing; a repeated window is never missed.

The sketch has 8 cells or more for each expected key, up to ``MAX_BITS``; what is broadcast is
at most 2 * 2**MAX_BITS bits (64 MB), whatever the input. Beyond that size the sketch fills up
and pass 2 groups more windows; the result is the same.

Defined cases: a null or empty text has no words, and its kept text is empty; a text of fewer than
20 words stays; a null doc_id counts as smaller than any other; rows of equal doc_id and text are
one document that stands more than once, each getting that document's result; rows of equal
doc_id and other texts are different documents whose equal places do not remove each other; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import need

WINDOW = 20
GRAM = 8
MIN_BITS, MAX_BITS = 20, 28
#: Cells of a slice of the sketch, as a power of two.
SLICE_BITS = 16
#: Window rows, or counted keys, that a task holds before it sends them on.
HELD = 1_000_000
#: Words of the corpus for each bucket of the exact grouping.
BUCKET_WORDS = 6_000_000
#: Bytes of text that are hashed at a time (a longer text is hashed whole).
CHUNK = 1 << 20
_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M[2]
    x = (x ^ (x >> np.uint64(27))) * _M[3]
    return x ^ (x >> np.uint64(31))


class _Hasher:
    """64-bit hashes of words and of runs of words: polynomials modulo 2**64 in an odd point, over
    random values of bytes, by prefix sums."""

    def __init__(self, salt: int):
        rng = np.random.default_rng(salt)
        self.value = rng.integers(0, 2**64, 256, np.uint64)
        self.point = int(rng.integers(0, 2**63, dtype=np.uint64)) * 2 + 1
        self.many = rng.integers(0, 2**63, 6, np.uint64) * np.uint64(2) + np.uint64(1)
        self.up = self.down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            inverse = pow(self.point, -1, 2**64)
            for name, x in (("up", self.point), ("down", inverse)):
                p = np.full(n, x, np.uint64)
                p[0] = 1
                setattr(self, name, np.multiply.accumulate(p))

    def words(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        n = len(data)
        self._powers(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.value[data] * self.up[:n], out=sums[1:])
        return _mix((sums[end] - sums[start]) * self.down[start] + (end - start).astype(np.uint64) * _M[0])

    def runs(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the grams and of the windows that start at each word."""
        m = self.many
        two = w[:-1] * m[0] + w[1:]
        four = two[:-2] * m[1] + two[2:]
        eight = four[:-4] * m[2] + four[4:]
        sixteen = eight[:-8] * m[3] + eight[8:]
        return _mix(eight), _mix(sixteen[:-4] * m[4] + four[16:])


def _sliding(op, a: np.ndarray) -> np.ndarray:
    """``op`` over each run of WINDOW - GRAM + 1 = 13 neighbours."""
    for step in (1, 2, 4):
        a = op(a[:-step], a[step:])
    return op(a[:-5], a[5:])


def _keys(eight: np.ndarray) -> np.ndarray:
    """The key of each window: the least hash of its grams."""
    return _sliding(np.minimum, eight)


def _counted(eight: np.ndarray, keys: np.ndarray, valid: np.ndarray) -> np.ndarray:
    """The hashes of the grams that give a valid window its key, each place once."""
    wide = np.zeros(len(keys) + 24, np.uint64)
    wide[12:12 + len(keys)] = np.where(valid, keys, 0)
    top = _sliding(np.maximum, wide)
    return eight[(top == eight) & (top > 0)]


def _cells(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    return (keys >> np.uint64(64 - bits)).astype(np.int64), (_mix(keys * _M[4] + _M[1]) >> np.uint64(64 - bits)).astype(np.int64)


def _chunks(batch: pa.RecordBatch):
    """(first row, bytes, starts and ends of words, row of each word) of the texts, some at a time."""
    text = batch.column("text").cast(pa.large_binary())
    offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset:text.offset + len(text) + 1]
    data = np.frombuffer(text.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(text):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK, "right")) - 1)
        part, bounds = data[offsets[at]:offsets[to]], offsets[at:to + 1] - offsets[at]
        inside = np.zeros(len(part) + 1, bool)
        inside[:-1] = ~_SPACE[part]
        edge = np.zeros(len(part) + 1, bool)
        edge[bounds] = True
        begins = inside.copy()
        begins[1:] &= ~inside[:-1] | edge[1:]
        ends = np.zeros(len(part) + 1, bool)
        ends[1:] = inside[:-1] & (~inside[1:] | edge[1:])
        start, end = np.flatnonzero(begins), np.flatnonzero(ends)
        yield at, part, start, end, np.searchsorted(bounds, start, "right") - 1
        at = to


def _windows(batch: pa.RecordBatch, first: _Hasher):
    """(first row, bytes, word starts, word ends, rows, grams, windows, keys, valid): the hashes of
    a batch's texts, some at a time; windows over two texts are not valid."""
    for at, part, start, end, row in _chunks(batch):
        if len(start) >= WINDOW:
            eight, twenty = first.runs(first.words(part, start, end))
            yield at, part, start, end, row, eight, twenty, _keys(eight), row[:-WINDOW + 1] == row[WINDOW - 1:]


def _pack_deltas(cells: np.ndarray) -> bytes:
    """Ascending distinct cells of one slice as bytes: differences, 255 adding to the next."""
    d = np.diff(cells, prepend=0)
    size = d // 255 + 1
    out = np.full(int(size.sum()), 255, np.uint8)
    out[np.cumsum(size) - 1] = d % 255
    return out.tobytes()


def _unpack_deltas(raw: bytes) -> np.ndarray:
    a = np.frombuffer(raw, np.uint8)
    return np.cumsum(a, dtype=np.int64)[a != 255]


def _sketch_parts(docs: DataFrame, bits: int) -> DataFrame:
    """(sketch_row, slice, once, more): the partitions' own sketches, packed."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, held, n = _Hasher(1), ([], []), 0

        def packed():
            for r in (0, 1):
                cells, count = np.unique(np.concatenate(held[r]), return_counts=True)
                held[r].clear()
                slices = cells >> SLICE_BITS
                starts = np.flatnonzero(np.diff(slices, prepend=-1))
                rows = {"sketch_row": [], "slice": [], "once": [], "more": []}
                for a, b in zip(starts, [*starts[1:], len(cells)]):
                    own, many = cells[a:b] & ((1 << SLICE_BITS) - 1), count[a:b] > 1
                    rows["sketch_row"].append(r)
                    rows["slice"].append(int(slices[a]))
                    rows["once"].append(_pack_deltas(own[~many]))
                    rows["more"].append(_pack_deltas(own[many]))
                for at in range(0, len(starts), 4096):
                    yield pa.RecordBatch.from_pydict({k: v[at:at + 4096] for k, v in rows.items()}, schema=schema)

        schema = pa.schema([("sketch_row", pa.int32()), ("slice", pa.int32()), ("once", pa.binary()), ("more", pa.binary())])
        for batch in batches:
            for *_, eight, _, keys, valid in _windows(batch, first):
                own = _counted(eight, keys, valid)
                for r, cells in enumerate(_cells(own, bits)):
                    held[r].append(cells)
                n += len(own)
                if n >= 4 * HELD:
                    yield from packed()
                    n = 0
        if n:
            yield from packed()

    return docs.select("text").mapInArrow(each, "sketch_row int, slice int, once binary, more binary")


def _merged(parts: DataFrame) -> DataFrame:
    """(sketch_row, slice, repeated): one bit a cell. Streams a partition sorted by slice."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("sketch_row", pa.int32()), ("slice", pa.int32()), ("repeated", pa.binary())])
        now, seen, twice = None, None, None

        def done():
            return pa.RecordBatch.from_pydict({"sketch_row": [now[0]], "slice": [now[1]], "repeated": [np.packbits(twice, bitorder="little").tobytes()]}, schema=schema)

        for batch in batches:
            for r, s, once, more in zip(*(batch.column(c).to_pylist() for c in ("sketch_row", "slice", "once", "more"))):
                if (r, s) != now:
                    if now is not None:
                        yield done()
                    now, seen, twice = (r, s), np.zeros(1 << SLICE_BITS, bool), np.zeros(1 << SLICE_BITS, bool)
                cells = _unpack_deltas(once)
                twice[cells[seen[cells]]] = True
                seen[cells] = True
                many = _unpack_deltas(more)
                seen[many] = twice[many] = True
        if now is not None:
            yield done()

    n = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return parts.repartition(n, "sketch_row", "slice").sortWithinPartitions("sketch_row", "slice").mapInArrow(
        each, "sketch_row int, slice int, repeated binary")


def text_bytes(docs: DataFrame) -> int:
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def sketch_bits(size: int) -> int:
    """Cells of a sketch row for so many bytes of text, as a power of two: 8 for each expected key
    (about 6 bytes a word; two places in 13 + 1 words are counted), within the bounds."""
    return int(min(MAX_BITS, max(MIN_BITS, np.ceil(np.log2(max(1, 8 * size / 6 / 6.5))))))


def sketch(docs: DataFrame, bits: int) -> tuple[int, np.ndarray]:
    """(bits, repeated): the merged sketch, two rows of packed bits, at most 64 MB together."""
    bits = min(MAX_BITS, max(SLICE_BITS, bits))
    slice_bytes = 1 << (SLICE_BITS - 3)
    whole = np.zeros((2, 1 << (bits - SLICE_BITS), slice_bytes), np.uint8)
    for row in _merged(_sketch_parts(docs, bits)).toLocalIterator(prefetchPartitions=True):
        whole[row["sketch_row"], row["slice"]] = np.frombuffer(row["repeated"], np.uint8)
    return bits, whole.reshape(2, -1)


def _packed(h1, h2, doc, pos, key, tid) -> bytes:
    """A block of windows; ``doc`` indexes the documents' (key, tid), of which those it needs go along."""
    used, doc = np.unique(doc, return_inverse=True)
    return b"".join([np.array([len(h1), len(used)], np.int64).tobytes(), key[used].tobytes(), tid[used].tobytes(), h1.tobytes(),
                     h2.astype(np.uint32).tobytes(), doc.astype(np.uint32).tobytes(), pos.astype(np.uint32).tobytes()])


def _unpacked(raw: bytes) -> tuple:
    n, docs = np.frombuffer(raw, np.int64, 2).tolist()
    out, at = [], 16
    for kind, count in ((np.int64, docs), (np.int64, docs), (np.uint64, n), (np.uint32, n), (np.uint32, n), (np.uint32, n)):
        out.append(np.frombuffer(raw, kind, count, at))
        at += out[-1].nbytes
    key, tid, h1, h2, doc, pos = out
    return h1, h2, doc, pos, key, tid


def _later(h1, h2, doc, pos, key, tid) -> tuple[np.ndarray, np.ndarray]:
    """Of windows in any order: those that are the first of their content, and those that are not.
    A document that stands more than once counts once; a start equal to the first (documents of
    one doc_id) is not later than it. Equal windows are found by 96 bits."""
    order = np.lexsort((tid[doc], pos, key[doc], h2, h1))
    new = np.ones(len(order), bool)
    new[1:] = (h1[order][1:] != h1[order][:-1]) | (h2[order][1:] != h2[order][:-1])
    k, p, t = key[doc[order]], pos[order], tid[doc[order]]
    again = np.zeros(len(order), bool)
    again[1:] = ~new[1:] & (k[1:] == k[:-1]) & (p[1:] == p[:-1]) & (t[1:] == t[:-1])
    lead = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    least = (k == k[lead]) & (p == p[lead])
    return order[least & ~again], order[~least & ~again]


def _by_document(key, tid) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number, key, tid): each entry's document number, and the documents, each once."""
    order = np.lexsort((tid, key))
    k, t = key[order], tid[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (t[1:] != t[:-1])
    number = np.empty(len(k), np.int64)
    number[order] = np.cumsum(new) - 1
    return number, k[new], t[new]


def _packed_starts(doc, pos) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(documents, bytes of each, all bytes): ascending distinct starts as differences, 255 adding
    to the next."""
    order = np.lexsort((pos, doc))
    doc, pos = doc[order].astype(np.int64), pos[order].astype(np.int64)
    keep = np.ones(len(doc), bool)
    keep[1:] = (doc[1:] != doc[:-1]) | (pos[1:] != pos[:-1])
    doc, pos = doc[keep], pos[keep]
    at = np.flatnonzero(np.diff(doc, prepend=-1))
    d = np.diff(pos, prepend=0)
    d[at] = pos[at]
    size = d // 255 + 1
    raw = np.full(int(size.sum()), 255, np.uint8)
    raw[np.cumsum(size) - 1] = d % 255
    return doc[at], np.add.reduceat(size, at), raw


def _starts_block(doc, pos, key, tid) -> bytes:
    docs, sizes, raw = _packed_starts(doc, pos)
    return b"".join([np.int64(len(docs)).tobytes(), key[docs].tobytes(), tid[docs].tobytes(), sizes.astype(np.int64).tobytes(), raw.tobytes()])


def _starts_of(raw: bytes) -> tuple:
    """(doc, pos, key, tid) of a block."""
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    key, tid, sizes = (np.frombuffer(raw, np.int64, n, 8 + 8 * n * i) for i in range(3))
    a = np.frombuffer(raw, np.uint8, -1, 8 + 24 * n)
    ends = a != 255
    doc = np.repeat(np.arange(n), sizes)
    sums = np.cumsum(a, dtype=np.int64)
    first = np.cumsum(sizes) - sizes
    before = np.where(first > 0, sums[first - 1], 0)
    return doc[ends], (sums - before[doc])[ends], key, tid


_FOUND = pa.schema([("bucket", pa.int32()), ("place", pa.int32()), ("data", pa.binary())])
_FOUND_DDL = "bucket int, place int, data binary"


def _to_places(doc, pos, key, tid, places: int) -> Iterator[pa.RecordBatch]:
    """Rows (no bucket, place, block) of starts, dealt by their document."""
    place = (_mix(key.view(np.uint64)) >> np.uint64(33)).astype(np.int64) * places >> 31
    own = place[doc]
    order = np.argsort(own, kind="stable")
    cut = np.flatnonzero(np.diff(own[order], prepend=-1))
    for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(order)]):
        i = order[a:b]
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int32()), pa.array([int(own[i[0]])], pa.int32()), pa.array([_starts_block(doc[i], pos[i], key, tid)], pa.binary())], schema=_FOUND)


def _candidates(docs: DataFrame, shared, bits: int, buckets: int) -> DataFrame:
    """Windows estimated as repeated: a row with a bucket is a block of windows that are the first
    of their content in a task; a row with a place is a block of starts known to be repeated."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repeated, one, two = shared.value, _Hasher(1), _Hasher(2)
        held: list = []
        docs_held: list = []
        n = 0

        def sent():
            h1, h2, doc, pos = (np.concatenate(x) for x in zip(*held))
            key, tid = (np.concatenate(x) for x in zip(*docs_held))
            held.clear()
            docs_held.clear()
            lead, late = _later(h1, h2, doc, pos, key, tid)
            if len(late):
                yield from _to_places(doc[late], pos[late], key, tid, buckets)
            bucket = (h1[lead] >> np.uint64(33)).astype(np.int64) * buckets >> 31
            cut = np.flatnonzero(np.diff(bucket, prepend=-1))  # ascending, as the hashes are
            for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(lead)]):
                own = lead[a:b]
                yield pa.RecordBatch.from_arrays([
                    pa.array([int(bucket[a])], pa.int32()), pa.nulls(1, pa.int32()),
                    pa.array([_packed(h1[own], h2[own], doc[own], pos[own], key, tid)], pa.binary())], schema=_FOUND)

        for batch in batches:
            key_id, text_id = (batch.column(c).to_numpy() for c in ("key_id", "text_id"))
            for at, part, start, end, row, _, h1, keys, valid in _windows(batch, one):
                maybe = valid.copy()
                for r, cells in enumerate(_cells(keys, bits)):
                    maybe &= (repeated[r][cells >> 3] >> (cells & 7).astype(np.uint8) & 1).astype(bool)
                i = np.flatnonzero(maybe)
                if not len(i):
                    continue
                h2 = two.runs(two.words(part, start, end))[1]
                begin = np.searchsorted(row, np.arange(row[-1] + 1))  # each text's first word
                doc0 = sum(len(x[0]) for x in docs_held)
                held.append((h1[i], (h2[i] >> np.uint64(32)).astype(np.uint32), (doc0 + row[i]).astype(np.uint32), (i - begin[row[i]]).astype(np.uint32)))
                docs_held.append((key_id[at:at + row[-1] + 1], text_id[at:at + row[-1] + 1]))
                n += len(i)
                if n >= HELD:
                    yield from sent()
                    n = 0
        if n:
            yield from sent()

    return docs.mapInArrow(each, _FOUND_DDL)


def _by_key(rows: DataFrame, key: str, done, schema: str) -> DataFrame:
    """Deal the rows by ``key`` and stream them in its order: ``done`` gets the blocks of a key."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for i, k in enumerate(batch.column(key).to_pylist()):
                if k != now:
                    if held:
                        yield from done(held)
                    now, held = k, []
                if k is None:
                    yield batch.slice(i, 1)
                else:
                    held.append(batch.column("data")[i].as_py())
        if held:
            yield from done(held)

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    deal = F.coalesce(*[c for c in ("bucket", "place") if c in rows.columns])
    return rows.withColumn("deal", deal).repartition(n, "deal").sortWithinPartitions(key).drop("deal").mapInArrow(each, schema)


def _grouped(found: DataFrame, places: int) -> DataFrame:
    """(key_id, text_id, starts): each document's starts whose windows also start earlier."""

    def compare(blocks: list[bytes]) -> Iterator[pa.RecordBatch]:
        parts = [_unpacked(x) for x in blocks]
        base = np.cumsum([0, *(len(p[4]) for p in parts)])
        h1, h2, pos, key, tid = (np.concatenate([p[i] for p in parts]) for i in (0, 1, 3, 4, 5))
        doc = np.concatenate([p[2] + np.uint32(b) for p, b in zip(parts, base)])
        late = _later(h1, h2, doc, pos, key, tid)[1]
        if len(late):
            number, key, tid = _by_document(key, tid)
            yield from _to_places(number[doc[late]], pos[late], key, tid, places)

    def gather(blocks: list[bytes]) -> Iterator[pa.RecordBatch]:
        parts = [_starts_of(x) for x in blocks]
        base = np.cumsum([0, *(len(p[2]) for p in parts)])
        doc = np.concatenate([p[0] + b for p, b in zip(parts, base)])
        number, key, tid = _by_document(*(np.concatenate([p[i] for p in parts]) for i in (2, 3)))
        docs, sizes, raw = _packed_starts(number[doc], np.concatenate([p[1] for p in parts]))
        ends = np.concatenate(([0], np.cumsum(sizes)))
        for a in range(0, len(docs), 5_000):
            b = min(a + 5_000, len(docs))
            own = raw[ends[a]:ends[b]]
            blobs = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer((ends[a:b + 1] - ends[a]).astype(np.int32)), pa.py_buffer(own.tobytes())])
            yield pa.RecordBatch.from_arrays([pa.array(key[docs[a:b]]), pa.array(tid[docs[a:b]]), blobs],
                                             names=["key_id", "text_id", "starts"])

    late = _by_key(found, "bucket", compare, _FOUND_DDL).drop("bucket")
    return _by_key(late, "place", gather, "key_id long, text_id long, starts binary")


def _identified(docs: DataFrame) -> DataFrame:
    return need(docs, "doc_id", "text").select(
        "doc_id", "text", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("key_id"),
        F.coalesce(F.xxhash64("text"), F.lit(0)).alias("text_id"))


def repeated_starts(docs: DataFrame, bits: int | None = None) -> DataFrame:
    """(key_id, text_id, starts): each document's packed starts of windows that also start earlier."""
    own = _identified(docs)
    size = text_bytes(docs)
    bits, whole = sketch(own, bits or sketch_bits(size))
    shared = docs.sparkSession.sparkContext.broadcast(whole)
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // (6 * BUCKET_WORDS)))
    return _grouped(_candidates(own.select("text", "key_id", "text_id"), shared, bits, buckets), buckets)


def _covered(n: int, packed: bytes) -> np.ndarray:
    """The words covered by the windows that start where the packed starts say."""
    starts, edge = _unpack_deltas(packed), np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + WINDOW, -1)
    return np.cumsum(edge[:n]) > 0


def remove_repeats(docs: DataFrame, bits: int | None = None) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept (the words left, joined by one space)."""
    runs = repeated_starts(docs, bits)
    own = _identified(docs)
    id_type = own.schema["doc_id"].dataType
    schema = "doc_id long, n_words long, n_removed long, kept string"

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = {"doc_id": b.column("doc_id"), "n_words": [], "n_removed": [], "kept": []}
            for text, starts in zip(*(b.column(c).to_pylist() for c in ("text", "starts"))):
                words = text.encode("utf-8", "replace").split() if text else []
                n = len(words)
                if starts:
                    gone = _covered(n, starts)
                    words = [w for w, g in zip(words, gone.tolist()) if not g]
                out["n_words"].append(n)
                out["n_removed"].append(n - len(words))
                out["kept"].append(b" ".join(words).decode("utf-8"))
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema(
                [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())]))

    joined = own.join(runs, ["key_id", "text_id"], "left")
    return joined.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "starts").mapInArrow(each, schema).withColumn(
        "doc_id", F.col("doc_id").cast(id_type))


def digest(kept: DataFrame) -> DataFrame:
    """The columns of :func:`remove_repeats` with the kept text as its SHA-256."""
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
