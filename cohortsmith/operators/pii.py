"""PII scan, redaction and detection on any text column (GRD-01…04).

The six patterns run in order on the *progressively redacted* text, so an earlier pattern
masks what a later one would see; positions are byte offsets in the text the pattern ran
on. All of it is built from native regex functions in one projection — one scan of the
table for all patterns — behind a cheap prefilter: every pattern needs three digits in a row or an ``@``,
so rows without three consecutive digits or an ``@`` skip the six regex passes (their text
is returned unchanged).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.arrays import bind, running_sum

UNICODE = "(?U)"  # \d \s \b are Unicode-aware in the behaviour we reproduce
# Necessary condition for any match of the fixed patterns: three consecutive digits (SSN,
# phone, ZIP, card) or an "@" (email). Redaction tags contain neither, so masking never
# creates a candidate. With user patterns the prefilter is dropped.
PREFILTER = UNICODE + r"\d{3}|@"


def patterns(extra: Sequence[tuple[str, str, str]] = ()) -> list[tuple[str, str, str]]:
    """GRD-01: the fixed pattern table (plus user patterns appended at the end)."""
    return [(n, UNICODE + rx, tag) for n, rx, tag in list(K.PII_PATTERNS) + list(extra)]


def _candidates(text: Column, pats) -> Column:
    """The prefilter, valid only for the fixed pattern table."""
    fixed = [(n, UNICODE + rx, t) for n, rx, t in K.PII_PATTERNS]
    return text.rlike(PREFILTER) if list(pats) == fixed else F.lit(True)


def _escape_replacement(tag: str) -> str:
    return tag.replace("\\", "\\\\").replace("$", "\\$")


def redact(text: Column, pats=None) -> Column:
    """GRD-03: text after all replacements, in pattern order."""
    out = text
    for _, rx, tag in pats or patterns():
        out = F.regexp_replace(out, F.lit(rx), F.lit(_escape_replacement(tag)))
    return out


def contains_pii(text: Column, pats=None) -> Column:
    """GRD-04: any pattern matches the original text."""
    pats = pats or patterns()
    expr = F.lit(False)
    for _, rx, _ in pats:
        expr = expr | text.rlike(rx)
    return _candidates(text, pats) & expr


def _offsets(matches: Column, segments: Column) -> Column:
    """Byte offset of every match: the segments and matches before it, one running sum in the row."""
    ends = bind(segments, lambda s: running_sum(F.transform(
        matches, lambda m, j: (F.octet_length(F.get(s, j)) + F.octet_length(m)).cast("long"))))
    return bind(ends, lambda e: F.transform(matches, lambda m, j: F.get(e, j) - F.octet_length(m)))


def _staged(df: DataFrame, pats, with_positions: bool, guard: Column | None = None) -> DataFrame:
    """Add ``_t0`` … ``_tN`` (text before / after each replacement) and, per pattern, the
    matches ``_m{i}`` and their byte offsets ``_p{i}`` in the text that pattern runs on.

    Each stage is its own column, so every regex pass runs once per row; the position
    lambdas then read plain array columns."""
    for i, (_, rx, tag) in enumerate(pats):
        cur = F.col(f"_t{i}")
        found = F.regexp_extract_all(cur, F.lit(rx), F.lit(0))
        if guard is not None:  # rows failing the prefilter never run the regex
            found = F.when(guard, found).otherwise(F.array().cast("array<string>"))
        df = df.withColumn(f"_m{i}", found)
        if with_positions:  # split only texts the pattern matched
            df = df.withColumn(f"_p{i}", F.when(F.size(f"_m{i}") > 0, _offsets(F.col(f"_m{i}"), F.split(cur, rx, -1))))
        df = df.withColumn(f"_t{i + 1}", F.when(F.size(f"_m{i}") > 0, F.regexp_replace(
            cur, F.lit(rx), F.lit(_escape_replacement(tag)))).otherwise(cur))
    return df


def _hits(i: int, name: str, tag: str, before: Column) -> Column:
    """Matches of pattern ``i`` as structs, with their places."""
    places, ms = F.col(f"_p{i}"), F.col(f"_m{i}")
    return F.transform(ms, lambda m, j: F.struct(
        (before + j).cast("long").alias("seq"), F.lit(name).alias("pattern_type"),
        F.get(places, j).alias("position"), F.lit(tag).alias("redacted_to"), m.alias("match")))


def scan(df: DataFrame, id_col: str, text_col: str, pats=None, keep: Sequence[str] = ()) -> DataFrame:
    """GRD-02: one row per match — ``pattern_type, position, redacted_to, match, seq``.

    ``seq`` orders the matches of one text (pattern order, then position); ``position`` is
    the byte offset of the match in the text the pattern ran on, summed inside the row: the
    matches are exploded once and not shuffled."""
    pats = pats or patterns()
    cand = (df.select(F.col(id_col).alias("record_id"), F.col(text_col).alias("_t0"), *keep)
            .where(_candidates(F.col("_t0"), pats)))
    st = _staged(cand, pats, with_positions=True)
    per_pattern, before = [], F.lit(0)
    for i, (name, _, tag) in enumerate(pats):
        per_pattern.append(_hits(i, name, tag, before))
        before = before + F.size(f"_m{i}")
    return (st.select("record_id", *keep, F.explode(F.flatten(F.array(*per_pattern))).alias("h"))
            .select("record_id", *keep, "h.*"))


def counts(df: DataFrame, text_col: str, pats=None) -> DataFrame:
    """Matches per pattern over the whole table (sequential masking), zero rows included."""
    pats = pats or patterns()
    cand = df.select(F.col(text_col).alias("_t0")).where(_candidates(F.col("_t0"), pats))
    st = _staged(cand, pats, with_positions=False)
    per_row = st.select(*[F.size(f"_m{i}").alias(n) for i, (n, _, _) in enumerate(pats)])
    agg = per_row.agg(*[F.coalesce(F.sum(n), F.lit(0)).cast("long").alias(n) for n, _, _ in pats])
    stack = ", ".join(f"'{n}', `{n}`" for n, _, _ in pats)
    return agg.selectExpr(f"stack({len(pats)}, {stack}) AS (pattern_type, n_matches)")


def redact_column(df: DataFrame, text_col: str, out_col: str | None = None, pats=None) -> DataFrame:
    """GRD-03 on a table; rows without a digit or ``@`` keep their text untouched."""
    t = F.col(text_col)
    pats = pats or patterns()
    return df.withColumn(out_col or text_col, F.when(_candidates(t, pats), redact(t, pats)).otherwise(t))
