"""Seeded, partition-independent random draws as plain column expressions (GEN-01…06).

A draw is a pure function of ``(seed, stage, key, draw name)``: it hashes those four values
and scales the hash to ``[0, 1)``. No Python UDF, no ``rand()`` (whose value depends on the
partition a row lands in), so a cohort is identical for any partitioning, any batch size
and after any task retry.

``hash="md5"`` (default) takes the first 13 hex digits of the MD5 of
``seed|stage|key|draw`` divided by 2^52; DuckDB computes the very same bits, which makes
every generated table checkable by an independent SQL oracle. ``hash="xxhash64"`` is
~4x cheaper inside Spark and is meant for large runs where no oracle is needed.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import str_array

TWO_POW_52 = float(2**52)
TWO_POW_53 = float(2**53)


def uniform(key: Column, stage: str, draw: str, seed: int, hash: str = "md5") -> Column:
    """GEN-01: seeded uniform in [0, 1) for the row identified by ``key``."""
    if hash == "md5":
        digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(stage), key.cast("string"), F.lit(draw)))
        return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(TWO_POW_52)
    if hash == "xxhash64":
        h = F.xxhash64(F.lit(seed), F.lit(stage), key, F.lit(draw))
        return F.shiftrightunsigned(h, 11).cast("double") / F.lit(TWO_POW_53)
    raise ValueError(f"unknown hash {hash!r}")


def raw(key: Column, stage: str, draw: str, seed: int, hash: str = "md5") -> Column:
    """The draw in its cheapest comparable form: for md5 the 13-hex-digit prefix itself (a
    lowercase hex string of fixed width orders like the integer it encodes), for xxhash64
    the uniform double. Compare it with ``below`` only."""
    if hash == "md5":
        digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(stage), key.cast("string"), F.lit(draw)))
        return F.substring(digest, 1, 13)
    return uniform(key, stage, draw, seed, hash)


def below(raw_draw: Column, p: float, hash: str = "md5") -> Column:
    """``u < p`` on a ``raw`` draw. For md5, ``u = k / 2^52`` with integer ``k``, so ``u < p``
    iff ``k < ceil(p * 2^52)``: one fixed-width string comparison instead of a base
    conversion per draw (same bits as the numeric form, ~2x faster)."""
    p = float(p)
    if hash != "md5":
        return raw_draw < F.lit(p)
    if p <= 0.0:
        return F.lit(False)
    t = math.ceil(p * TWO_POW_52)
    if t >= 2**52:
        return F.lit(True)
    return raw_draw < F.lit(format(t, "013x"))


class Drawer:
    """Binds seed, stage, key and hash so call sites read ``d("age")``."""

    def __init__(self, key: Column, stage: str, seed: int, hash: str = "md5"):
        self.key, self.stage, self.seed, self.hash = key, stage, seed, hash

    def __call__(self, draw: str) -> Column:
        return uniform(self.key, self.stage, draw, self.seed, self.hash)

    def raw(self, draw: str) -> Column:
        return raw(self.key, self.stage, draw, self.seed, self.hash)


def index_below(u: Column, n) -> Column:
    """GEN-02: uniform index in ``0..n-1``; ``n`` may be an int or an int column."""
    n_col = n if isinstance(n, Column) else F.lit(n)
    return F.floor(u * n_col).cast("int")


def int_between(u: Column, lo: int, hi: int) -> Column:
    """GEN-02: uniform integer in ``[lo, hi]`` (inclusive)."""
    return (F.lit(lo) + index_below(u, hi - lo + 1)).cast("int")


def bernoulli(u: Column, p) -> Column:
    """GEN-03: true with probability ``p`` (strict ``<``)."""
    return u < (p if isinstance(p, Column) else F.lit(float(p)))


def pick(u: Column, items) -> Column:
    """GEN-04: uniform pick from a Python list or an array column (null when empty)."""
    arr = items if isinstance(items, Column) else str_array(items)
    return F.try_element_at(arr, index_below(u, F.size(arr)) + 1)


def pick_pair_indices(u_a: Column, u_b: Column, n: int) -> tuple[Column, Column]:
    """GEN-05: two distinct 0-based indices (ordered pair) out of ``n >= 2`` items."""
    a = index_below(u_a, n)
    b0 = index_below(u_b, n - 1)
    return a, F.when(b0 >= a, b0 + 1).otherwise(b0)


def pick_pair(u_a: Column, u_b: Column, items: Sequence[str]) -> tuple[Column, Column]:
    arr = str_array(items)
    a, b = pick_pair_indices(u_a, u_b, len(items))
    return F.element_at(arr, a + 1), F.element_at(arr, b + 1)


def cumulative_thresholds(weights: Sequence[tuple[str, float]]) -> list[tuple[str, float]]:
    """Cumulative weight per class, computed once on the driver in IEEE doubles."""
    out, acc = [], 0.0
    for name, w in weights:
        acc += w
        out.append((name, acc))
    return out


def weighted_pick(u: Column, weights: Sequence[tuple[str, float]]) -> Column:
    """GEN-06: class whose cumulative weight first reaches ``u * total``; the first class
    when rounding leaves the roll above every threshold."""
    cum = cumulative_thresholds(weights)
    total = cum[-1][1]
    roll = u * F.lit(total)
    expr = F.lit(weights[0][0])
    for name, c in reversed(cum):
        expr = F.when(roll <= F.lit(c), F.lit(name)).otherwise(expr)
    return expr
