"""Quality rules: base measures of a text, and the frequency of lines across a host's documents.

Lines are normalised (lower case, white space collapsed) and hashed; Spark counts on how many
distinct documents of a host each line stands. A line on more documents than both limits (a least
number, and a share of the host's distinct documents) is boilerplate: it is removed, and a document
of which too little is left is rejected. Documents of equal text on a host are one document, so
groups of copies make no line frequent; counts are partial aggregates, so a line of a third of all
documents meets in one row a task.

The base rules reject short and repetitive texts. Their measures are taken within the row; what
repeats is found by sorting the row's window hashes, whatever the length of the text.

Defined cases: a null or empty text has no words and fails the base rules; a null host is a host of
its own; lines without a word don't count; repeated rows get a result each; a null doc_id is carried;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, WORD, fresh, need, stored

#: Limits of a line: documents of a host, and share of the host's distinct documents.
MIN_DOCS, SHARE = 20, 0.05
#: A document is depleted with fewer words left than this, or than this share of its words.
MIN_LEFT, LEFT_SHARE = 10, 0.3
#: Base rules: least words, most words in repeated windows (per cent), words of a window.
LEAST_WORDS, REPEAT_PERCENT, WINDOW = 10, 20, 5


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeated_words(words: Column) -> Column:
    """Words covered by the 5-word windows that stand twice or more in an array of words."""

    def covered(places: Column) -> Column:
        last = F.size(places) - 1
        return let(last, lambda n: F.aggregate(
            F.transform(places, lambda p, i: F.when(i < n, F.least(F.lit(WINDOW), F.get(places, i + 1) - p)).otherwise(F.lit(WINDOW))),
            F.lit(0).cast("long"), lambda a, x: a + x))

    def places(windows: Column) -> Column:
        """Ascending places of the windows whose hash stands twice or more."""
        by_hash = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return let(by_hash, lambda s: F.array_sort(F.transform(
            F.filter(F.transform(s, lambda x, k: F.struct(
                x["i"].alias("i"), ((F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"])).alias("twice"))), lambda x: x["twice"]),
            lambda x: x["i"])))

    def count(windows: Column) -> Column:
        none = F.size(F.array_distinct(windows)) == F.size(windows)
        return F.when(none, F.lit(0).cast("long")).otherwise(let(places(windows), covered))

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    windows = let(hashes, lambda h: F.transform(
        F.slice(h, 1, F.greatest(F.size(h) - WINDOW + 1, F.lit(0))),
        lambda x, i: F.xxhash64(x, *[F.get(h, i + k) for k in range(1, WINDOW)])))
    return let(windows, count)


def normal(line: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(line, f"{SPACE_CLASS}+", " ")))


def text_lines(text: Column) -> Column:
    """Array of (line hash, words) of the lines that have a word."""
    lines = F.filter(F.transform(F.split(text, "\n", -1), normal), lambda x: x != "")
    return F.transform(lines, lambda x: F.struct(F.xxhash64(x).alias("h"), (F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))) + 1).cast("long").alias("n")))


def measures(docs: DataFrame, host: str) -> DataFrame:
    """doc_id, host, the text's two hashes, and the base measures of each row."""
    text = F.coalesce("text", F.lit(""))
    own = need(docs, "doc_id", "text", host).select("doc_id", F.col(host).alias("host"), text.alias("text"))
    words = F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1))
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(WORD))
    counted = let(words, lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).alias("repeat")))
    found = own.select(
        "doc_id", "host", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), "text").alias("t2"), counted.alias("w"),
        (F.char_length("text") - F.regexp_count("text", F.lit(SPACE_CLASS))).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))
    return found.select("doc_id", "host", "t1", "t2", F.col("w.n").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", F.col("w.repeat").alias("n_repeat_words"))


def host_lines(docs: DataFrame, host: str) -> DataFrame:
    """(host, t1, t2, lines) of each distinct text of a host."""
    text = F.coalesce("text", F.lit(""))
    own = need(docs, "text", host).select(F.col(host).alias("host"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2"), text_lines(text).alias("lines"))
    return own.groupBy("host", "t1", "t2").agg(F.first("lines").alias("lines"))


def frequent_lines(lines: DataFrame, min_docs: int = MIN_DOCS, share: float = SHARE) -> DataFrame:
    """(host, h): lines on more distinct documents of their host than the limits."""
    docs = lines.groupBy("host").agg(F.count("*").alias("docs")).withColumnRenamed("host", "of")
    count = lines.select("host", F.explode(F.array_distinct(F.transform("lines", lambda x: x["h"]))).alias("h")).groupBy("host", "h").agg(
        F.count("*").alias("n")).where(F.col("n") > min_docs)
    return count.join(docs, F.col("host").eqNullSafe(F.col("of"))).where(F.col("n") > share * F.col("docs")).select("host", "h")


def depletion(docs: DataFrame, host: str, min_docs: int = MIN_DOCS, share: float = SHARE) -> DataFrame:
    """(host, t1, t2, removed, gone): words lost and hashes of the lines lost, of texts that lose any."""
    lines = stored(host_lines(docs, host), "lines")
    frequent = frequent_lines(lines, min_docs, share).select(F.col("host").alias("of"), F.col("h").alias("line"))
    each = lines.select("host", "t1", "t2", F.explode("lines").alias("l")).select("host", "t1", "t2", "l.h", "l.n")
    lost = each.join(frequent, F.col("host").eqNullSafe(F.col("of")) & (F.col("h") == F.col("line")))
    return lost.groupBy("host", "t1", "t2").agg(F.sum("n").alias("removed"), F.collect_set("h").alias("gone"))


def _same(a: DataFrame, b: DataFrame) -> Column:
    return a["host"].eqNullSafe(b["lost_host"]) & (a["t1"] == b["lost_t1"]) & (a["t2"] == b["lost_t2"])


def _judged(docs: DataFrame, host: str, min_docs: int, share: float) -> DataFrame:
    base = measures(docs, host)
    lost = depletion(docs, host, min_docs, share).select(*[F.col(c).alias(f"lost_{c}") for c in ("host", "t1", "t2")], "removed", "gone")
    joined = base.join(lost, _same(base, lost), "left")
    left = F.col("n_words") - F.coalesce("removed", F.lit(0))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    depleted = F.col("removed").isNotNull() & ((left < MIN_LEFT) | (left < LEFT_SHARE * F.col("n_words")))
    return joined.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & ~depleted)


def judge(docs: DataFrame, host: str = "source", min_docs: int = MIN_DOCS, share: float = SHARE) -> DataFrame:
    """Per row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept."""
    return _judged(docs, host, min_docs, share).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def clean(docs: DataFrame, host: str = "source", min_docs: int = MIN_DOCS, share: float = SHARE) -> DataFrame:
    """``docs`` without the rejected documents, and without the lines above the limits in the others;
    n_chars, where there is one, follows the text."""
    t1, t2, gone, *lost = [fresh(docs, c) for c in ("_t1", "_t2", "_gone", "_lost_host", "_lost_t1", "_lost_t2")]
    verdict = _judged(docs, host, min_docs, share).where("kept").select(
        *[F.col(c).alias(n) for c, n in zip(("host", "t1", "t2"), lost)], F.col("gone").alias(gone)).dropDuplicates(lost)
    text = F.coalesce("text", F.lit(""))
    own = docs.withColumns({t1: F.xxhash64(text), t2: F.xxhash64(F.lit(1), text)})
    joined = own.join(verdict, F.col(f"`{host}`").eqNullSafe(F.col(lost[0])) & (F.col(t1) == F.col(lost[1])) & (F.col(t2) == F.col(lost[2])))
    left = F.array_join(F.filter(F.split("text", "\n", -1), lambda x: ~F.array_contains(F.col(gone), F.xxhash64(normal(x))) | (normal(x) == "")), "\n")
    columns = {"text": F.when(F.col(gone).isNull(), F.col("text")).otherwise(left)}
    out = joined.withColumns(columns)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(gone).isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


#: The same rows by lists and string windows, for DuckDB.
SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, string_split(text, chr(10)) AS lines FROM d),
win AS (SELECT r, i, words[i:i+4] AS five FROM (SELECT r, words, unnest(range(1, len(words) - 3)) AS i FROM w WHERE len(words) >= 5)),
twice AS (SELECT r, five FROM win GROUP BY r, five HAVING count(*) > 1),
rep AS (SELECT r, sum(least(5, coalesce(nxt - i, 5))) AS n FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt FROM win JOIN twice USING (r, five)) GROUP BY r),
l AS (SELECT DISTINCT r, host, text, h FROM (SELECT r, lower(trim(regexp_replace(unnest(lines), '[\x20\x09-\x0D]+', ' ', 'g'))) AS h FROM w) JOIN d USING (r) WHERE h <> ''),
docs AS (SELECT host, count(DISTINCT text) AS n FROM d GROUP BY host),
freq AS (SELECT l.host, h FROM l JOIN docs ON docs.host IS NOT DISTINCT FROM l.host GROUP BY l.host, h, docs.n
  HAVING count(DISTINCT text) > 20 AND count(DISTINCT text) > 0.05 * docs.n),
lost AS (SELECT r, sum(len(string_split(x.h, ' '))) AS removed
  FROM (SELECT r, host, lower(trim(regexp_replace(unnest(lines), '[\x20\x09-\x0D]+', ' ', 'g'))) AS h FROM w JOIN d USING (r)) x
  JOIN freq ON freq.host IS NOT DISTINCT FROM x.host AND freq.h = x.h GROUP BY r),
m AS (SELECT r, doc_id, len(words) AS n_words, len(list_aggregate(words, 'string_agg', '')) AS chars,
  len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
  len(list_filter(lines, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) - len(list_distinct(list_filter(lines, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS n_dup_lines
  FROM w JOIN d USING (r)),
b AS (SELECT m.*, coalesce(rep.n, 0) AS n_repeat, coalesce(lost.removed, 0) AS removed FROM m LEFT JOIN rep USING (r) LEFT JOIN lost USING (r))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(coalesce(chars, 0) AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat AS BIGINT) AS n_repeat_words,
  n_words < 10 OR 100 * n_repeat > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat > 20 * n_words) AND NOT (removed > 0 AND (n_words - removed < 10 OR n_words - removed < 0.3 * n_words)) AS kept
FROM b
"""
