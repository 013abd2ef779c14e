"""Collapse of cumulative conversation logs, and rendering of what remains.

Logs often hold a conversation again after every turn. Turns are numbered in their order, each
numbered turn is hashed twice with its place (128 bits together), and a running xor of these is the
hash of every prefix. A conversation whose whole hash is a proper prefix's hash of a longer one is
dropped by an anti-join; of equal conversations the smallest conv_id stays. The remaining
conversations are rendered turn by turn with the chat template.

Order and running hashes are made in blocks of turns, with the blocks' counts and hashes summed up
as offsets, so a conversation of any length is spread over tasks; equal prefixes (a first turn that
a third of all conversations share) meet in partial aggregates. The result has a row for each turn,
so no cell holds a whole conversation.

Defined cases: turns are ordered by turn (null last), ties by content; gaps in the numbers don't
matter; rows that repeat conv_id, turn, role and text count once; a null role or text is different
from an empty one, and rendered as empty; a null conv_id is one conversation, smaller than any
other; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import need, stored

#: Turn numbers of a block.
BLOCK = 256
START, MIDDLE, END = "<|im_start|>", "\n", "<|im_end|>\n"


def _xor(*c: str) -> F.Column:
    return F.coalesce(F.col(c[0]), F.lit(0)).bitwiseXOR(F.coalesce(F.col(c[1]), F.lit(0)))


def numbered(turns: DataFrame) -> DataFrame:
    """(conv, turn, d1, d2, position, p1, p2): every distinct turn with its place from 1 and the
    hashes of the prefix that it ends."""
    what = F.struct(F.col("role").isNull(), "role", F.col("text").isNull(), "text")
    own = need(turns, "conv_id", "turn", "role", "text").select(
        F.coalesce(F.col("conv_id").cast("long"), F.lit(-(2**63))).alias("conv"), F.coalesce(F.col("turn").cast("long"), F.lit(2**63 - 1)).alias("turn"),
        F.xxhash64(what).alias("d1"), F.xxhash64(F.lit("second"), what).alias("d2")).distinct()
    own = own.withColumn("block", F.floor(F.col("turn") / BLOCK))
    order = Window.partitionBy("conv", "block").orderBy("turn", "d1", "d2")
    before = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    counts = own.groupBy("conv", "block").agg(F.count("*").alias("n"))
    starts = counts.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    placed = own.join(starts, ["conv", "block"]).withColumn("position", F.col("start") + F.row_number().over(order))
    placed = stored(placed.withColumns({"h1": F.xxhash64("position", "d1", "d2"), "h2": F.xxhash64(F.lit("second"), "position", "d2", "d1")}).drop("start"), "turns")
    blocks = placed.groupBy("conv", "block").agg(F.bit_xor("h1").alias("x1"), F.bit_xor("h2").alias("x2"))
    blocks = blocks.withColumns({f"b{i}": F.bit_xor(f"x{i}").over(before) for i in (1, 2)}).drop("x1", "x2")
    running = order.rowsBetween(Window.unboundedPreceding, 0)
    local = placed.withColumns({f"r{i}": F.bit_xor(f"h{i}").over(running) for i in (1, 2)})
    return local.join(blocks, ["conv", "block"]).select(
        "conv", "turn", "d1", "d2", "position", _xor("r1", "b1").alias("p1"), _xor("r2", "b2").alias("p2"))


def maximal(prefixes: DataFrame) -> DataFrame:
    """(conv, n_turns, n_copies): conversations that prefix no longer one, equal ones once."""
    length = prefixes.groupBy("conv").agg(F.max("position").alias("n_turns"))
    sized = prefixes.join(length, "conv")
    ends = sized.where(F.col("position") == F.col("n_turns")).select("conv", "n_turns", "p1", "p2")
    inner = sized.where(F.col("position") < F.col("n_turns")).select(F.col("position").alias("n_turns"), "p1", "p2").distinct()
    once = ends.groupBy("n_turns", "p1", "p2").agg(F.min("conv").alias("conv"), F.count("*").alias("n_copies"))
    return once.join(inner, ["n_turns", "p1", "p2"], "left_anti").select("conv", "n_turns", "n_copies")


def collapse_and_render(turns: DataFrame) -> DataFrame:
    """(conv_id, position, n_turns, n_copies, rendered): the turns of the maximal conversations in
    their order; a conversation's text is its rendered turns one after the other."""
    prefixes = stored(numbered(turns), "prefixes")
    kept = prefixes.select("conv", "turn", "d1", "d2", "position").join(maximal(prefixes), "conv")
    what = F.struct(F.col("role").isNull(), "role", F.col("text").isNull(), "text")
    own = need(turns, "conv_id", "turn", "role", "text")
    id_type = own.schema["conv_id"].dataType
    texts = own.select(
        F.coalesce(F.col("conv_id").cast("long"), F.lit(-(2**63))).alias("conv"), F.coalesce(F.col("turn").cast("long"), F.lit(2**63 - 1)).alias("turn"),
        F.xxhash64(what).alias("d1"), F.xxhash64(F.lit("second"), what).alias("d2"),
        F.concat(F.lit(START), F.coalesce("role", F.lit("")), F.lit(MIDDLE), F.coalesce("text", F.lit("")), F.lit(END)).alias("rendered"))
    # rows that repeat a turn meet the turn's one number; one of them stays
    joined = texts.join(kept, ["conv", "turn", "d1", "d2"])
    return joined.groupBy("conv", "position").agg(F.first("n_turns").alias("n_turns"), F.first("n_copies").alias("n_copies"), F.first("rendered").alias("rendered")).select(
        F.when(F.col("conv") != -(2**63), F.col("conv")).cast(id_type).alias("conv_id"), "position", "n_turns", "n_copies", "rendered")


#: The same rows by lists of turns, for DuckDB.
SQL = r"""
WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
c AS (SELECT conv_id, list({'role': role, 'text': text} ORDER BY turn NULLS LAST) AS turns FROM t GROUP BY conv_id),
p AS (SELECT DISTINCT turns[1:k] AS turns FROM (SELECT turns, unnest(range(1, len(turns))) AS k FROM c)),
kept AS (SELECT min(conv_id) AS conv_id, turns, count(*) AS n_copies FROM c WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.turns = c.turns) GROUP BY turns)
SELECT conv_id, k AS position, len(turns) AS n_turns, n_copies,
  '<|im_start|>' || coalesce(turns[k].role, '') || chr(10) || coalesce(turns[k].text, '') || '<|im_end|>' || chr(10) AS rendered
FROM (SELECT conv_id, turns, n_copies, unnest(range(1, len(turns) + 1)) AS k FROM kept)
"""
