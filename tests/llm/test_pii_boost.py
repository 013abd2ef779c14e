"""Personal data against plain regular expressions."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from cohortsmith.llm import pii_boost as P

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def valid(kind, x):
    d = re.sub("[^0-9]", "", x)
    if kind == "ip":
        return all(int(p) <= 255 for p in x.split("."))
    if kind == "card":
        s = sum(v if i % 2 == 0 else (2 * v - 9 if v > 4 else 2 * v) for i, v in enumerate(map(int, reversed(d))))
        return 12 <= len(d) <= 19 and s % 10 == 0
    return kind == "email" or 9 <= len(d) <= 15


def slow(text):
    out = [(m.start(), k, m.end()) for k, kind in enumerate(P.KINDS) for m in re.finditer(PLAIN[kind], text or "") if valid(kind, m[0])]
    return sorted(out)


def row(doc_id, text):
    b = slow(text)
    n = [sum(m[1] == k for m in b) for k in range(4)]
    return (doc_id, *n, hashlib.sha256(",".join(f"{P.KINDS[k]}:{s}:{e}" for s, k, e in b).encode()).hexdigest())


EDGES = [(1, None), (2, ""), (3, "a@b.c%x@d.e a@b..c @x.y a@b"), (4, "1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.0255 1.2.3 10.0.0.1."), (None, "mail é\U0001f600 me@x-y.org +44 20 7946 0958 9"),
         (5, "4111 1111-1111 1111 4111111111111111x 4111111111111112 123-4567 4111111111111111"), (6, "+1 (788) 555-0037 4111111111111111 and +1 (788) 555-0037"),
         (7, "1 " * 20000 + "x" * 30000 + "9" * 20000 + "." * 1000), (8, "+" * 500 + "1" * 12 + " " + "ab." * 9000), (9, "a@b.co " * 2000), (9, "a@b.co " * 2000), (10, "@" * 3000 + "a" * 3000 + "@"),
         (11, "john [at] mail [dot] com, call (212) 555-1234 now")]


def test_documents_and_edges(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()] + EDGES
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("label", F.lit(1)).withColumn("base", F.lit("x"))
    got = P.report(df).collect()
    assert sorted((tuple(r)[:6] for r in got), key=str) == sorted((row(*r) for r in rows), key=str)
    for r in got:  # base spans stay
        own = set(r.spans.split(",")) - {""}
        texts = [t for d, t in rows if d == r.doc_id]
        assert any(own >= {f"{P.KINDS[k]}:{s}:{e}" for s, k, e in slow(t)} for t in texts)
    added = {r.doc_id: set(r.spans.split(",")) for r in got}
    assert "card:64:80" in added[5]  # a card that the greedy rule swallows with the number before it
    by = {r.doc_id: r for r in got}
    assert by[2].spans == "" and by[1].base_sha256 == hashlib.sha256(b"").hexdigest()


def test_prefix_sums(spark):
    n = [0, 1, 255, 256, 257, 1000]
    for k in n:
        got = spark.range(1).select(P.sums_before(F.transform(F.sequence(F.lit(1), F.lit(max(k, 1))), lambda i: i.cast("int"))).alias("x")).first().x
        assert got == [sum(range(1, i + 1)) for i in range(max(k, 1))]


@pytest.mark.parametrize("text, want", [("mail a@b.co, ip 1.2.3.4!", "mail [EMAIL], ip [IP]!"), ("none", "none"), ("", ""), ("é +44 20 7946 0958 é", "é [PHONE] é")])
def test_redaction(spark, text, want):
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert P.find(df, None).select(P.redacted(F.col("text"), F.col("spans"))).first()[0] == want


def test_overlapping_spans_are_one(spark):
    df = spark.range(1).select(F.lit("0123456789").alias("t"), F.expr("array(named_struct('s',1,'k',2,'e',4), named_struct('s',3,'k',3,'e',6), named_struct('s',6,'k',0,'e',7))").alias("s"))
    assert df.select(P.redacted(F.col("t"), F.col("s"))).first()[0] == "0[CARD][EMAIL]789"


def test_empty_table(spark):
    assert P.report(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_overlaps(spark):
    import random
    rng = random.Random(3)
    spans = [(a, a + rng.randrange(1, 5)) for a in (rng.randrange(900) for _ in range(600))]
    others = sorted((a, a + rng.randrange(1, 4)) for a in rng.sample(range(0, 900, 5), 90))
    sql = lambda x: "array(" + ",".join(f"named_struct('s',{s},'e',{e})" for s, e in x) + ")"
    got = spark.range(1).select(P.overlaps(F.expr(sql(spans)), F.expr(sql(others)))).first()[0]
    assert got == [any(s < y and x < e for x, y in others) for s, e in spans]


@pytest.mark.parametrize("mark", [" ", "-"])
def test_card_spelled_digit_by_digit(spark, mark):
    """No two digits stand side by side in the text."""
    card = mark.join("4111111111111111")
    df = spark.createDataFrame([(1, f"pay with {card} now")], "doc_id long, text string")
    assert tuple(P.report(df).first())[:6] == row(1, f"pay with {card} now") and slow(card) == [(0, 2, 31)]
    assert P.redact(df).first().text == "pay with [CARD] now"


def mixed(n):
    """Documents with a number or address of each kind, right and wrong."""
    from random import Random
    rng = Random(5)
    digits = lambda k: "".join(rng.choice("0123456789") for _ in range(k))

    def card():
        d = digits(15)
        return next(d + c for c in "0123456789" if valid("card", d + c))

    def other():
        d = digits(15)
        return next(d + c for c in "0123456789" if not valid("card", d + c))

    octet = lambda: rng.randrange(256)
    return [(i, f"mail u{digits(3)}@x{digits(2)}.com or u{digits(3)}@x; ip {octet()}.{octet()}.{octet()}.{octet()} not {octet()}.{rng.randrange(256, 999)}.1.{octet()}; "
             f"card {card()} not {other()}; call +44 20 7{digits(3)} {digits(4)} not {digits(4)}") for i in range(n)]


def test_a_hot_source_or_copies_leave_every_kind_its_threshold(spark):
    docs = mixed(150)
    tables = [(1000 + i, " ; ".join(str(10000 + 211 * i + k) for k in range(200))) for i in range(100)]
    frame = lambda rows: P.proposals(spark.createDataFrame(rows, "doc_id long, text string"))
    plain, hot = P.train(frame(docs), 400), P.train(frame(docs + tables), 400)
    assert set(plain.thresholds) == set(hot.thresholds) == set(P.KINDS)
    copies = P.train(frame(docs + [(5000 + i, docs[0][1]) for i in range(300)]), 400)
    assert copies.gbt.toDebugString.split("\n")[1:] == plain.gbt.toDebugString.split("\n")[1:] and set(copies.thresholds) == set(P.KINDS)
