"""A uniform shuffle into shards of exact sizes, by a hypergeometric communication matrix.

Every partition permutes its rows locally. Given the partitions' counts, the number of rows that
partition p sends to shard s in a uniformly random permutation of all rows is a multivariate
hypergeometric draw; the matrix of these draws (one row of counts a partition) is made on the
driver from counts alone. A partition's first rows in its local order go to shard 0, the next to
shard 1, and so on; after the exchange each shard is permuted again. Shard sizes are exact, at
most one apart, and every arrangement is equally likely as far as the random keys go.

A shard is permuted in buckets by the leading bits of its random keys, with the buckets' counts
summed up as offsets, so no task holds a shard, and slots are gapless from 0.

The permuted table is stored once, with partition and local place: counts, matrix and exchange all
refer to that table, whatever executors are lost.

Defined cases: nulls in any column and repeated rows are rows like any other, each with a slot of
its own; an empty table gives an empty result; with fewer rows than shards some shards are
empty; the caller's columns stay as they are (new columns whose names clash get underscores first).
"""

from __future__ import annotations

import math
import random

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import fresh, stored

#: Rows of a bucket in which a shard is permuted, about.
BUCKET = 250_000
#: Partitions whose matrix rows are broadcast; more are joined by shuffle.
BROADCAST = 20_000


def hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """How many of ``draws`` without replacement from good + bad are good: an exact draw of any size,
    by inversion from the mode outwards."""
    low, high = max(0, draws - bad), min(draws, good)
    if low == high:
        return low
    mode = min(high, max(low, (draws + 1) * (good + 1) // (good + bad + 2)))
    c = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    p = math.exp(c(good, mode) + c(bad, draws - mode) - c(good + bad, draws))
    u = rng.random() - p
    up, down, at_up, at_down = p, p, mode, mode
    while u > 0:
        if at_up < high:
            up *= (good - at_up) * (draws - at_up) / ((at_up + 1) * (bad - draws + at_up + 1))
            at_up += 1
            u -= up
            if u <= 0:
                return at_up
        if at_down > low:
            down *= at_down * (bad - draws + at_down) / ((good - at_down + 1) * (draws - at_down + 1))
            at_down -= 1
            u -= down
            if u <= 0:
                return at_down
        if at_up == high and at_down == low or up + down < 1e-300:
            break  # rounding: the tails are used up
    return mode


def communication_matrix(counts: list[int], shards: int, seed: int) -> list[list[int]]:
    """Row p, column s: the rows that partition p sends to shard s. Columns sum to sizes at most one apart."""
    rng, n = random.Random(seed), sum(counts)
    extra = set(rng.sample(range(shards), n % shards))
    room = [n // shards + (s in extra) for s in range(shards)]
    out = []
    for count in counts:
        row, left, total = [], count, sum(room)
        for s in range(shards):
            total -= room[s]
            k = hypergeometric(rng, room[s], total, left)
            row.append(k)
            left -= k
        room = [r - k for r, k in zip(room, row)]
        out.append(row)
    return out


def shuffle(rows: DataFrame, shards: int, seed: int = 0, bucket: int = BUCKET) -> DataFrame:
    """``rows`` with shard int and slot long (the place within the shard, gapless from 0)."""
    spark, columns = rows.sparkSession, rows.columns
    shard, slot, at, key, part, upto, group, offset = (fresh(rows, c) for c in ("shard", "slot", "_at", "_key", "_part", "_upto", "_group", "_offset"))
    # the row number after a local sort holds partition and place
    local = stored(rows.withColumn(key, F.rand(seed)).sortWithinPartitions(key).drop(key).withColumn(at, F.monotonically_increasing_id()), "permuted")
    local = local.withColumns({part: F.shiftright(at, 33), at: F.col(at).bitwiseAND(F.lit((1 << 33) - 1))})
    counts = sorted((r[0], r[1]) for r in local.groupBy(part).count().collect())
    n = sum(c for _, c in counts)
    matrix = communication_matrix([c for _, c in counts], shards, seed)
    sums = [(p, [sum(row[:s + 1]) for s in range(shards)]) for (p, _), row in zip(counts, matrix)]
    table = spark.createDataFrame(sums, T.StructType([T.StructField(part, T.LongType()), T.StructField(upto, T.ArrayType(T.LongType()))]))
    if len(sums) <= BROADCAST:
        table = F.broadcast(table)
    groups = max(1, -(-n // (shards * bucket)))
    sent = local.join(table, part).withColumn(shard, F.size(F.filter(upto, lambda c: c <= F.col(at))))
    sent = sent.withColumn(key, F.xxhash64(F.lit(seed + 1), part, at)).drop(upto)
    sent = sent.withColumn(group, F.shiftright(F.shiftrightunsigned(key, 33) * F.lit(groups), 31).cast("int"))
    sizes = sent.groupBy(shard, group).agg(F.count("*").alias(offset))
    before = Window.partitionBy(shard).orderBy(group).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn(offset, F.coalesce(F.sum(offset).over(before), F.lit(0)))
    again = Window.partitionBy(shard, group).orderBy(key, part, at)
    ranked = sent.withColumn(slot, F.row_number().over(again) - 1)
    return ranked.join(offsets, [shard, group]).select(*[F.col(f"`{c}`") for c in columns], F.col(shard), (F.col(slot) + F.col(offset)).cast("long").alias(slot))


def sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, size, text_crc32): UTF-8 bytes of the text and one, and its checksum."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
