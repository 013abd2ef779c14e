"""Toxic passages by maximum-scoring segment search over token log-odds.

Learning. Labelled documents outside the held-out fifth count, for each unit of a word (its first
4, 5 and 6 letters and the whole word), the toxic and the clean documents that have it; documents of
one pair of min-hashes (copies, near copies) count once together. Counts of all such documents are
added in Spark into two rows of ``CELLS`` cells, the model's fixed size; a unit's counts are those of
its emptier cell. A unit's share of toxic documents has a Dirichlet prior: its shorter unit's
share, and the labels' base rate for the shortest, worth ``PRIOR`` documents. A word's score is
the log-odds of its share against the base rate, less ``DRIFT``, so an ordinary word costs.

Search. The maximal scoring segments of a text are found in one linear scan over its words. By
extreme-value theory the best segment S of n ordinary words has P(S >= x) = 1 - exp(-K n exp(-lambda x));
lambda and K are the likeliest for the clean training documents, and a passage is significant if
fewer than ``SIGNIFICANT`` such would be expected in its text by chance. A document's evidence is the least
chance, over r, of r segments as good as its r best; a logistic curve, fitted to the counts of
evidence by label, makes it the probability that the label is 1. For K, lambda and the curve a
document is scored without its own part of the counts.

Defined cases: a null or empty text has no words and the least score; rows that repeat a doc_id are
scored on their own; a doc_id labelled more than once is toxic if any label says so, null labels are
none; a null doc_id has no label and is held out if the contract's remainder of the empty text is 0
(it is); without labels of both kinds every score is the base rate (0 without any); an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import need, stored

#: Letters of the units of a word besides the whole word, cells of a row of the model, prior documents.
PREFIXES = (4, 5, 6)
CELLS = 1 << 20
SLICE = 1 << 15
PRIOR = 4.0
DRIFT = 1.5
#: Parts of a document's weight in the sums.
UNIT = 1 << 24
#: Bounds of a word's score, the expected number below which a passage is significant.
LEAST, MOST = -4.0, 9.0
SIGNIFICANT = 0.01
#: Evidence is counted in so many bins of this width for the logistic curve.
BINS, BIN = 400, 0.25
#: Lambdas among which the likeliest is taken.
LAMBDAS = [0.05 * 1.1 ** i for i in range(48)]
#: Labels (12 bytes each) and groups of copies (28) up to which they are broadcast; beyond it they are joined.
BROADCAST = 300_000
#: Words whose scores or cells a task remembers at a time.
REMEMBERED = 500_000

_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def units(word: str) -> list[str]:
    """The units of a word, the shortest first; the whole word is marked by a final blank."""
    return [word[:k] for k in PREFIXES if k < len(word)] + [word + " "]


def cells(unit: str, n: int = CELLS) -> tuple[int, int]:
    """The unit's cell in either row of the model."""
    h = xxhash.xxh3_64_intdigest(unit)
    return (h & 0xFFFFFFFF) % n, n + (h >> 32) % n


# --- segments -------------------------------------------------------------------------------------

def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) in one linear scan.

    Candidates are kept with the prefix sums before and after them and the nearest earlier candidate
    that starts at a lower sum. A positive word joins the nearest candidate that starts lower if that
    makes a better segment than it was, and then the one before, as often as this holds. Words that
    cost are only seen in the prefix sums."""
    up = np.flatnonzero(scores > 0)
    if not len(up):
        return []
    total = np.concatenate(([0.0], np.cumsum(scores)))
    kept: list[tuple[int, int, float, float, int]] = []
    for i, before, after in zip(up.tolist(), total[up].tolist(), total[up + 1].tolist()):
        start = i
        j = len(kept) - 1
        while True:
            while j >= 0 and kept[j][2] >= before:
                j = kept[j][4]
            if j < 0 or kept[j][3] >= after:
                break
            start, before, lower = kept[j][0], kept[j][2], kept[j][4]
            del kept[j:]
            j = lower
        kept.append((start, i + 1, before, after, j))
    return [(start, end, after - before) for start, end, before, after, _ in kept]


# --- the model ------------------------------------------------------------------------------------

@dataclass
class Model:
    """Counts of documents by cell, base rate, and what calibrates a score."""

    toxic: np.ndarray
    clean: np.ndarray
    base: float
    lam: float = 1.0
    k: float = 0.1
    slope: float = 1.0
    offset: float = 0.0

    def word(self, word: str, own_toxic: float = 0.0, own_clean: float = 0.0) -> float:
        """The score of a word, without the given counts of the document itself."""
        share = self.base
        half = len(self.toxic) // 2
        for unit in units(word):
            c = min(cells(unit, half), key=lambda c: self.toxic[c] + self.clean[c])
            t, n = max(0.0, self.toxic[c] - own_toxic), max(0.0, self.clean[c] - own_clean)
            share = (t + PRIOR * share) / (t + n + PRIOR)
        odds = math.log(share / (1 - share)) - math.log(self.base / (1 - self.base))
        return min(MOST, max(LEAST, odds)) - DRIFT

    def evidence(self, segments: list[float], n: int) -> float:
        """-ln of the least chance, over r, that r segments are as good as the r best of n words."""
        best = 0.0
        for r, s in enumerate(sorted(segments, reverse=True)[:16], 1):
            expected = self.k * n * math.exp(-self.lam * s)
            if r == 1:
                chance = -math.log(-math.expm1(-expected)) if expected > 1e-12 else -math.log(expected + 1e-300)
            else:  # P(Poisson >= r) <= expected^r / r!
                chance = math.lgamma(r + 1) - r * math.log(expected + 1e-300) if expected < 1 else 0.0
            best = max(best, chance)
        return best

    def score(self, evidence: float) -> float:
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, self.slope * evidence + self.offset))))


class _Scores(dict):
    """Remembered scores of words."""

    def __init__(self, model: Model, own_toxic: float = 0.0, own_clean: float = 0.0):
        super().__init__()
        self.of = lambda w: model.word(w, own_toxic, own_clean)

    def __missing__(self, word: str) -> float:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = s = self.of(word)
        return s

    def segments(self, text: str | None) -> tuple[int, list[tuple[int, int, float]]]:
        words = words_of(text)
        return len(words), maximal_segments(np.fromiter(map(self.__getitem__, words), float, len(words)))


# --- learning -------------------------------------------------------------------------------------

def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(toxic, text) of the labelled documents outside the held-out fifth."""
    known = need(labels, "doc_id", "toxic").where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    # while labels are few the texts stay where they are
    known = stored(known, "labels")
    side = F.broadcast(known) if known.count() <= BROADCAST else known
    return need(docs, "doc_id", "text").where(~held_out()).join(side, "doc_id").select("toxic", "text")


def held_out() -> F.Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0


def _seen(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each document with its two min-hashes over three-word runs."""
    for b in batches:
        rows = []
        for toxic, text in zip(b["toxic"], b["text"]):
            words = words_of(text)
            runs = {" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))}
            h = np.fromiter((xxhash.xxh3_64_intdigest(r) for r in runs), np.uint64, len(runs))
            rows.append((int(toxic), int(h.min().astype(np.int64)), int((h * np.uint64(0x9E3779B97F4A7C15)).min().astype(np.int64)), text))
        yield pd.DataFrame(rows, columns=["toxic", "g1", "g2", "text"])


def _counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Weights of documents added up by cell and label, as whole parts so that sums don't depend on order."""
    sums = np.zeros((2, 2 * CELLS), np.int64)
    remembered: dict[str, list[int]] = {}
    for b in batches:
        for toxic, size, text in zip(b["toxic"], b["size"], b["text"]):
            if len(remembered) > REMEMBERED:
                remembered = {}
            found: set[int] = set()
            for w in set(words_of(text)):
                own = remembered.get(w)
                if own is None:
                    own = remembered[w] = [c for u in units(w) for c in cells(u)]
                found.update(own)
            sums[int(toxic > 0)][np.fromiter(found, np.int64, len(found))] += max(1, UNIT // int(size))
    at = np.flatnonzero(sums.any(0))
    yield pd.DataFrame({"cell": at, "clean": sums[0][at], "toxic": sums[1][at]})


def _slice(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
    """A slice of the model's cells as two binary arrays."""
    dense = {c: np.zeros(SLICE, np.float32) for c in ("toxic", "clean")}
    for c in dense:
        dense[c][frame["cell"] % SLICE] = frame[c] / UNIT
    return pd.DataFrame({"at": [int(key[0])], **{c: [x.tobytes()] for c, x in dense.items()}})


def train(docs: DataFrame, labels: DataFrame) -> Model | float:
    """The model, or the base rate where the labels are not of both kinds."""
    seen = stored(labelled(docs, labels).mapInPandas(_seen, "toxic int, g1 long, g2 long, text string"), "labelled")
    sizes = seen.groupBy("toxic", "g1", "g2").agg(F.count("*").alias("size"))
    groups = sizes.groupBy().agg(F.sum((F.col("toxic") > 0).cast("long")).alias("t"), F.count("*").alias("n")).first()
    if not groups["n"] or groups["t"] in (0, groups["n"]):
        return (groups["t"] or 0) / max(1, groups["n"])
    # only groups of several documents need a weight; while they are few the texts stay where they are
    several = stored(sizes.where("size > 1"), "copies")
    side = F.broadcast(several) if several.count() <= BROADCAST else several
    rows = seen.join(side, ["toxic", "g1", "g2"], "left").select("toxic", F.coalesce("size", F.lit(1)).alias("size"), "text").mapInPandas(_counts, "cell long, clean long, toxic long")
    summed = rows.groupBy("cell").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    toxic, clean = np.zeros(2 * CELLS, np.float32), np.zeros(2 * CELLS, np.float32)
    # 2 * CELLS / SLICE rows of SLICE cells, 16 MB together whatever the input
    for at, t, c in summed.groupBy(F.expr(f"cell div {SLICE}").alias("at")).applyInPandas(_slice, "at long, toxic binary, clean binary").toLocalIterator():
        toxic[at * SLICE:(at + 1) * SLICE], clean[at * SLICE:(at + 1) * SLICE] = np.frombuffer(t, np.float32), np.frombuffer(c, np.float32)
    model = Model(toxic, clean, groups["t"] / groups["n"])
    found = stored(_searched(seen, model), "segments")
    model.lam, model.k = _extreme_values(found)
    model.slope, model.offset = _logistic(found, model)
    return model


def _searched(seen: DataFrame, model: Model) -> DataFrame:
    """(toxic, n, scores) of each labelled document, found without its own part of the counts."""
    shared = seen.sparkSession.sparkContext.broadcast(model)

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo = {1: _Scores(shared.value, 1.0, 0.0), 0: _Scores(shared.value, 0.0, 1.0)}
        for b in batches:
            rows = []
            for toxic, text in zip(b["toxic"], b["text"]):
                n, found = memo[int(toxic > 0)].segments(text)
                rows.append((int(toxic > 0), n, sorted((s for _, _, s in found), reverse=True)[:16]))
            yield pd.DataFrame(rows, columns=["toxic", "n", "scores"])

    return seen.select("toxic", "text").mapInPandas(each, "toxic int, n long, scores array<double>")


def _extreme_values(found: DataFrame) -> tuple[float, float]:
    """The likeliest lambda and K for the best segments of clean documents: for each lambda K is
    documents / sum(n exp(-lambda S)), and all sums are made in one pass."""
    best = F.coalesce(F.try_element_at("scores", F.lit(1)), F.lit(0.0))
    sums = found.where("toxic = 0 AND n > 0").agg(
        F.count("*").alias("docs"), F.sum(best).alias("s"), F.sum(F.log("n")).alias("ln"),
        *[F.sum(F.col("n") * F.exp(-F.lit(x) * best)).alias(f"e{i}") for i, x in enumerate(LAMBDAS)]).first()
    if not sums["docs"]:
        return 1.0, 0.1

    def likelihood(i: int) -> float:
        k = sums["docs"] / sums[f"e{i}"]
        return sums["docs"] * (math.log(LAMBDAS[i]) + math.log(k) - 1) + sums["ln"] - LAMBDAS[i] * sums["s"]

    i = max(range(len(LAMBDAS)), key=likelihood)
    return LAMBDAS[i], sums["docs"] / sums[f"e{i}"]


def _logistic(found: DataFrame, model: Model) -> tuple[float, float]:
    """Slope and offset of the logistic curve, by Newton steps over counts of evidence by label."""
    plain = Model(np.zeros(2, np.float32), np.zeros(2, np.float32), model.base, model.lam, model.k)

    @F.pandas_udf(T.IntegerType())
    def binned(n: pd.Series, scores: pd.Series) -> pd.Series:
        return pd.Series([min(BINS - 1, int(plain.evidence(list(s), int(k)) / BIN)) for k, s in zip(n, scores)], dtype="int32")

    table = found.groupBy(binned("n", "scores").alias("bin")).agg(F.sum("toxic").alias("t"), F.count("*").alias("n")).orderBy("bin").collect()
    x = np.array([(r["bin"] + 0.5) * BIN for r in table])
    t, n = np.array([r["t"] for r in table], float), np.array([r["n"] for r in table], float)
    beta = np.array([0.0, math.log(model.base / (1 - model.base))])
    design = np.stack([x, np.ones_like(x)], 1)
    ridge = np.array([1e-2, 1e-4])  # keeps the curve finite where evidence separates the labels
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -50, 50)))
        step = np.linalg.solve(design.T @ (design * (n * p * (1 - p))[:, None]) + np.diag(ridge), design.T @ (t - n * p) - ridge * beta)
        beta = beta + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0]), float(beta[1])


# --- scoring --------------------------------------------------------------------------------------

_PASSAGES = "array<struct<start:int,end:int,score:double>>"


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted, passages) of every row of ``docs``; passages are the
    significant segments as word numbers, end exclusive, with their scores."""
    model = train(docs, labels)
    own = need(docs, "doc_id", "text").select("doc_id", held_out().alias("held_out"), "text")
    if not isinstance(model, Model):
        return own.select("doc_id", "held_out", F.lit(float(model)).alias("score"), F.lit(int(model >= 0.5)).alias("predicted"), F.array().cast(_PASSAGES).alias("passages"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, m = _Scores(shared.value), shared.value
        for b in batches:
            scores, passages = [], []
            for text in b.column("text").to_pylist():
                n, found = memo.segments(text)
                scores.append(m.score(m.evidence([s for _, _, s in found], n)))
                passages.append([{"start": i, "end": j, "score": s} for i, j, s in found if m.k * n * math.exp(-m.lam * s) < SIGNIFICANT])
            spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(scores, pa.float64()),
                                              pa.array([int(s >= 0.5) for s in scores], pa.int32()), pa.array(passages, spans)],
                                             ["doc_id", "held_out", "score", "predicted", "passages"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return own.mapInArrow(each, f"doc_id {id_type}, held_out boolean, score double, predicted int, passages {_PASSAGES}")
