"""Alignment of two tokenizers' tokens over the same text, and corpus-wide counts of linked ids.

Each text is encoded whole by both tokenizers. Byte offsets at which both end a token and both
start the next one with a space are verified anchors; they split the document into windows, each
a tuple of the one's ids and a tuple of the other's. What a window looks like inside (groups between
shared ends, links) depends on the ids alone, so it is worked out once for each pair of tuples and
remembered. A link is a pair of token occurrences whose byte ranges end together.

Both tokenizers encode the text between two single blanks on its own (a blank that stands between
visible characters always begins a token and no merge crosses it; this is tested on the whole
vocabulary). Where both give a stretch back byte for byte its ends are anchors, so the windows of such
a stretch are remembered. A text with another stretch is encoded in one.

A task cuts what it finds into blocks of bounded size (stored): the windows of its documents as
numbers, the distinct windows' links, and the distinct id pairs with their counts. The pairs are
summed over all blocks, their totals joined back to the blocks that have them, and each block
adds up its documents, so no table of pairs is sent whole to any task.

Defined cases: a null or empty text, or one that a tokenizer doesn't give back byte for byte, has no
tokens: zeros and an empty digest; repeated rows are aligned and counted as often as they stand;
a very long text is aligned whole, its windows dealt over several blocks; a null doc_id is kept; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import gc
import hashlib
import re
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vocabulary
from .common import need, stored

#: Windows of a block; window alignments, and stretches' ids, that a task remembers at a time.
BLOCK = 1 << 18
REMEMBERED = 1 << 18
_BETWEEN = re.compile(r"(?<=\S) (?=\S)")


def window_groups(a: list[int], b: list[int], a_sizes: list[int], b_sizes: list[int], a_names: list[str], b_names: list[str]) -> tuple[str, list[int]]:
    """The groups of one window as text, and its links as packed id pairs (a << 32 | b); an id's name
    is a comma and its number."""
    groups = left = right = ""
    links, j, at_a, at_b, y = [], 0, 0, 0, 0
    for x in a:
        at_a += a_sizes[x]
        left += a_names[x]
        while at_b < at_a:
            y = b[j]
            at_b += b_sizes[y]
            right += b_names[y]
            j += 1
        if at_a == at_b:
            groups += f"{left[1:]}|{right[1:]};"
            links.append(x << 32 | y)
            left = right = ""
    return groups[:-1], links


class Aligner:
    """Documents to numbers of windows; ``texts`` and ``links`` hold what each number stands for."""

    def __init__(self, ranks_path: str | None = None, model_path: str | None = None):
        self.encode_a, self.encode_b = vocabulary.byte_encoder(ranks_path), vocabulary.piece_encoder(model_path)
        self.bytes_a, self.bytes_b = vocabulary.byte_tokens(ranks_path), vocabulary.piece_tokens(model_path)
        (self.size_a, self.space_a), (self.size_b, self.space_b) = vocabulary.shape(self.bytes_a), vocabulary.shape(self.bytes_b)
        both = self.bytes_a, self.bytes_b
        self.shapes = *([len(t) for t in tokens] for tokens in both), *([f",{i}" for i in range(len(tokens))] for tokens in both)
        # no piece has a blank behind another character, so none crosses the blank before a word
        self.separable = not any(b" " in t.lstrip(b" ") for t in self.bytes_b)
        self.forget()

    def forget(self) -> None:
        self.numbers: dict[bytes, int] = {}
        self.texts: list[str] = []
        self.links, self.n_links = array("q"), array("q")  # of all windows in a row; each one's number of them
        self.n_a, self.n_b = array("q"), array("q")
        self.stretches: dict[str, tuple[int, ...]] = {}

    def _given_back(self, text: str, a: list[int], b: list[int]) -> bool:
        want = (" " + text).encode()
        return b"".join(map(self.bytes_a.__getitem__, a)) == want and b"".join(map(self.bytes_b.__getitem__, b)) == want

    def _shared(self, text: str, a: list[int], b: list[int]) -> tuple[int, ...] | None:
        """The windows, where both tokenizers give the text back."""
        if not self._given_back(text, a, b):
            return None
        # without a blank in the text no token but the first is marked
        return tuple(self.windows(a, b)) if " " in text else (self._number(a, b),)

    def _aligned(self, text: str, a: list[int], b: list[int]) -> tuple[int, int, list[int]] | None:
        """(ids of A, ids of B, windows) of a text encoded in one."""
        found = self._shared(text, a, b)
        return found and (len(a), len(b), list(found))

    def _by_stretch(self, text: str) -> list[tuple[int, ...]] | None:
        """The same for each stretch of a text, where it holds for all of them."""
        if "\u2581" in text or not self.separable:
            return None
        known, stretches = self.stretches, _BETWEEN.split(text)
        found = list(map(known.get, stretches))
        if None in found:
            new = list(dict.fromkeys(x for x, f in zip(stretches, found) if f is None))
            made = {x: self._shared(x, self.encode_a(" " + x), b) for x, b in zip(new, self.encode_b(new))}
            if None in made.values():
                return None
            found = [made[x] if f is None else f for x, f in zip(stretches, found)]
            if len(known) + len(made) > REMEMBERED:
                known.clear()
            known.update((x, f) for x, f in made.items() if len(x) <= 64)
        return found

    def windows(self, a: list[int], b: list[int]) -> list[int]:
        """The windows of a text, as numbers."""
        a4, b4 = np.array(a, "<u4"), np.array(b, "<u4")
        marks_a, marks_b = np.flatnonzero(self.space_a[a4[1:]]), np.flatnonzero(self.space_b[b4[1:]])
        ends_a, ends_b = np.cumsum(self.size_a[a4])[marks_a], np.cumsum(self.size_b[b4])[marks_b]
        _, at_a, at_b = np.intersect1d(ends_a, ends_b, assume_unique=True, return_indices=True)
        cut_a = [0, *(marks_a[at_a] + 1).tolist(), len(a)]
        cut_b = [0, *(marks_b[at_b] + 1).tolist(), len(b)]
        return [self._number(a[i:j], b[k:m]) for i, j, k, m in zip(cut_a, cut_a[1:], cut_b, cut_b[1:])]

    def _number(self, a: list[int], b: list[int]) -> int:
        key = array("i", (*a, -1, *b)).tobytes()
        number = self.numbers.get(key)
        if number is None:
            number = self.numbers[key] = len(self.texts)
            text, links = window_groups(a, b, *self.shapes)
            self.texts.append(text)
            self.links.extend(links)
            self.n_a.append(len(a))
            self.n_b.append(len(b))
            self.n_links.append(len(links))
        return number

    def document(self, text: str | None) -> tuple[int, int, str, list[int]]:
        """(n_a, n_b, groups digest, windows) of one text."""
        parts = self._by_stretch(text) if text else None
        if parts is not None:
            found = list(chain.from_iterable(parts))
            n_a, n_b = self.total(self.n_a, found), self.total(self.n_b, found)
        else:
            n_a, n_b, found = text and self._aligned(text, self.encode_a(" " + text), self.encode_b(text)) or (0, 0, [])
        return n_a, n_b, hashlib.sha256(";".join(map(self.texts.__getitem__, found)).encode()).hexdigest() if found else "", found

    @staticmethod
    def total(numbers: array, windows: list[int]) -> int:
        """The sum of a number that each window has."""
        return int(np.frombuffer(numbers, np.int64)[windows].sum()) if windows else 0


_DOC = [("row", pa.int64()), ("doc_id", pa.string()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("sha", pa.string()), ("size", pa.int64())]
_BLOCKS = pa.schema([("block", pa.int64()), *[(name, pa.list_(t)) for name, t in _DOC], ("windows", pa.binary()), ("wsizes", pa.binary()),
                     ("wlinks", pa.binary()), ("pairs", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64()))])
_BLOCKS_DDL = ("block long, row array<long>, doc_id array<string>, n_a array<long>, n_b array<long>, n_groups array<long>, sha array<string>, "
               "size array<long>, windows binary, wsizes binary, wlinks binary, pairs array<long>, counts array<long>")


def _block_row(number: int, docs: list[tuple], windows: list[int], aligner: Aligner) -> pa.RecordBatch:
    """Documents' windows with the distinct windows' links and the distinct pairs of the block."""
    distinct, place, times = np.unique(np.array(windows, np.int64), return_inverse=True, return_counts=True)
    all_sizes = np.array(aligner.n_links, np.int64)
    sizes, starts = all_sizes[distinct], (np.cumsum(all_sizes) - all_sizes)[distinct]
    flat = np.array(aligner.links, np.int64)[np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())]
    pairs, local = np.unique(flat, return_inverse=True)
    counts = np.bincount(local, np.repeat(times, sizes), len(pairs)).astype(np.int64)
    columns = {name: [[d[i] for d in docs]] for i, (name, _) in enumerate(_DOC)}
    return pa.RecordBatch.from_pydict({"block": [number], **columns, "windows": [place.astype("<u4").tobytes()], "wsizes": [sizes.astype("<u4").tobytes()],
                                       "wlinks": [local.astype("<u4").tobytes()], "pairs": [pairs], "counts": [counts]}, _BLOCKS)


def aligned_blocks(docs: DataFrame, block: int = BLOCK, remembered: int = REMEMBERED, ranks_path: str | None = None, model_path: str | None = None) -> DataFrame:
    """All documents aligned, a row for each block of windows; a long document stands in several."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # what is remembered has no cycles, and scanning it again and again takes half the time
        try:
            yield from dealt(batches)
        finally:
            gc.enable()

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = row = TaskContext.get().partitionId() << 33
        aligner = Aligner(ranks_path, model_path)
        docs, windows = [], []
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                n_a, n_b, sha, found = aligner.document(text)
                n_groups = aligner.total(aligner.n_links, found)
                for at in range(0, max(1, len(found)), block):
                    part = found[at:at + block]
                    docs.append((row, doc_id, n_a, n_b, n_groups, sha, len(part)) if at == 0 else (row, doc_id, 0, 0, 0, "", len(part)))
                    windows += part
                    if len(windows) >= block or len(docs) >= block:
                        yield _block_row(number, docs, windows, aligner)
                        number, docs, windows = number + 1, [], []
                row += 1
                if len(aligner.texts) >= remembered:  # their numbers are given anew, so the block ends
                    if docs:
                        yield _block_row(number, docs, windows, aligner)
                        number, docs, windows = number + 1, [], []
                    aligner.forget()
        if docs:
            yield _block_row(number, docs, windows, aligner)

    own = need(docs, "doc_id", "text")
    return own.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInArrow(each, _BLOCKS_DDL)


def pair_totals(blocks: DataFrame) -> DataFrame:
    """(pair, total, best): corpus-wide links of each id pair; best: no other pair of its B id has more."""
    totals = blocks.select(F.explode(F.arrays_zip("pairs", "counts")).alias("p")).groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.counts").alias("total"))
    totals = totals.withColumn("b", F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)))
    most = totals.groupBy("b").agg(F.max("total").alias("most"))
    return totals.join(most, "b").select("pair", "total", (F.col("total") == F.col("most")).alias("best"))


_DOCS = "row long, doc_id string, n_a long, n_b long, n_groups long, groups_sha256 string, n_best long, count_sum long"


def _sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of runs of the given sizes, empty ones included."""
    total = np.concatenate(([0], np.cumsum(values)))
    end = np.cumsum(sizes)
    return total[end] - total[end - sizes]


def _totalled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in _DOCS.split(", ")]
    for batch in batches:
        for r in range(batch.num_rows):
            row = {name: batch.column(name)[r] for name in batch.schema.names}
            lists = {name: row[name].values for name, _ in _DOC}
            total, best = np.zeros(row["n_pairs"].as_py(), np.int64), np.zeros(row["n_pairs"].as_py(), np.int64)
            if row["known"].is_valid:
                local = row["known"].values.field("local").to_numpy(zero_copy_only=False)
                total[local] = row["known"].values.field("total").to_numpy(zero_copy_only=False)
                best[local] = row["known"].values.field("best").to_numpy(zero_copy_only=False)
            windows, wsizes, wlinks = (np.frombuffer(row[c].as_buffer(), "<u4").astype(np.int64) for c in ("windows", "wsizes", "wlinks"))
            size = lists["size"].to_numpy(zero_copy_only=False)
            sums = [_sums(_sums(x[wlinks], wsizes)[windows], size) for x in (best, total)]
            yield pa.RecordBatch.from_arrays([*(lists[c] for c in ("row", "doc_id", "n_a", "n_b", "n_groups", "sha")), *map(pa.array, sums)], names)


def align(docs: DataFrame, block: int = BLOCK, remembered: int = REMEMBERED, ranks_path: str | None = None, model_path: str | None = None) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each row of ``docs``."""
    blocks = stored(aligned_blocks(docs, block, remembered, ranks_path, model_path), "aligned")
    mine = blocks.select("block", F.posexplode("pairs").alias("local", "pair"))
    known = mine.join(stored(pair_totals(blocks), "pairs"), "pair").groupBy("block").agg(F.collect_list(F.struct("local", "total", "best")).alias("known"))
    whole = blocks.withColumn("n_pairs", F.size("pairs")).drop("pairs", "counts").join(known, "block", "left")
    parts = whole.mapInArrow(_totalled, _DOCS)
    return parts.groupBy("row").agg(
        F.max("doc_id").cast(docs.schema["doc_id"].dataType).alias("doc_id"),
        *[F.sum(c).alias(c) for c in ("n_a", "n_b", "n_groups")], F.sum("n_groups").alias("n_links"),
        *[F.sum(c).alias(c) for c in ("n_best", "count_sum")], F.max("groups_sha256").alias("groups_sha256")).drop("row")
