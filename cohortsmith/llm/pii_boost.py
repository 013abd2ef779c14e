"""Personal data: rules, and boosted trees over the spans that rules miss.

The base rules find e-mail and IP addresses, card and phone numbers: leftmost, non-overlapping
matches of a kind, kept if they pass the kind's test. They are greedy, so a number that stands right
beside another one is swallowed by a longer match that fails; and they know one spelling only.

High-recall generators propose overlapping spans of every kind (loose and inner matches, numbers
without prefix, spelled-out addresses). Gradient-boosted trees score them by format (digits,
groups, separators, check digit, octets) and context (the characters beside them, words before
them). The training rows are proposals with a weak label: those that are base spans are positive;
those that overlap none and fail their kind's test are negative. The others are not trained on;
they are what the trees decide. Each kind has a threshold, calibrated on all held-out labelled
proposals for ``PRECISION``; spans above it that overlap no base span are added.

Matching, features and the trees (as nested conditions) are SQL expressions within the row. Labelled
proposals are counted by kind, label and features, copies of a span (with what stands around it) as
one for the fit. The fit reads a bounded number of these rows for each kind and label, so neither
copies nor a source full of one kind displace the others; the thresholds come from the counts of
all held-out proposals by kind and score.

Patterns are written without the backtracking that overflows or becomes quadratic on long runs;
they match what the plain ones match.

Defined cases: a null or empty text has no spans; positions are code points, the end exclusive;
repeated rows and null doc_ids get a result each; a text of any length is searched whole; without
both kinds of labels nothing is trained and nothing added, and to a kind without held-out base spans
nothing is added; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import need, stored
from .line_frequency import let

KINDS = ("email", "ip", "card", "phone")
#: Rows of the fit, for all kinds and labels together, at most; one span in five is held out.
SAMPLE = 20_000
PRECISION = 0.98
TREES, DEPTH = 12, 4

_LOCAL = "A-Za-z0-9._%+-"
#: The base patterns. A run of digits or of address characters is tried from its start, or from the
#: end of the match before; groups are possessive.
BASE = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9]){11,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Generators of proposals: inner and loose matches.
PROPOSE = {
    "email": [rf"(?<![{_LOCAL}])[{_LOCAL}]{{1,64}}+[ ]?(?:\[at\]|\(at\)|@)[ ]?[A-Za-z0-9-]{{1,63}}(?:[ ]?(?:\[dot\]|\(dot\)|\.)[ ]?[A-Za-z0-9-]{{1,63}})*+",
              rf"(?<![{_LOCAL}])[{_LOCAL}]{{1,64}}+@[^\s@]{{1,80}}"],
    "ip": [r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9])", r"(?<![0-9])[0-9]{1,6}(?:\.[0-9]{1,6}){1,6}+"],
    "card": [r"(?<![0-9])[0-9]{12,19}(?![0-9])", r"(?<![0-9])[0-9]{4}(?:[ -][0-9]{4}){3}(?![0-9])", r"(?<![0-9])[0-9]{4,11}(?![0-9])"],
    "phone": [r"\+[0-9]{1,3}[ .-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])", r"(?<![0-9+])\([0-9]{2,4}\)[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])",
              r"(?<![0-9])[0-9]{2,5}(?:[ .-][0-9]{2,5}){0,3}(?![0-9])"],
}
#: Words that announce a kind, in the forty characters before a span.
CUES = {
    "email": r"(?i)mail|contact|write to|@", "ip": r"(?i)\bip\b|address|host|server|client|addr",
    "card": r"(?i)card|visa|master|amex|credit|kredit|carte|tarjeta", "phone": r"(?i)phone|tel|call|mobile|cell|fax|whatsapp|\+",
}
#: What every match of a kind's patterns contains.
_HINT = {"email": r"@|\[at\]|\(at\)", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"[0-9]"}
_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
FEATURES = ("kind", "digits", "chars", "marks", "groups", "longest", "luhn", "octets", "plus", "paren", "at", "dots", "letters", "joined_before", "joined_after", "cue")
_CHUNK = 256


def before(values: Column, join) -> Column:
    """For each element of an int array the sum (or what ``join`` of two makes, from 0) of the elements
    before it, in blocks: a long array costs no square."""
    fold = lambda c: F.aggregate(c, F.lit(0), join)

    def body(x: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor(F.size(x) / _CHUNK).cast("int")), lambda c: fold(F.slice(x, c * _CHUNK + 1, F.lit(_CHUNK))))
        starts = F.aggregate(blocks, F.array(F.lit(0)), lambda a, v: F.concat(a, F.array(join(F.element_at(a, -1), v))))
        return let(starts, lambda s: F.transform(x, lambda v, i: join(F.get(s, F.floor(i / _CHUNK).cast("int")), fold(
            F.slice(x, F.floor(i / _CHUNK).cast("int") * _CHUNK + 1, i % _CHUNK)))))

    return let(values, body)


def sums_before(lengths: Column) -> Column:
    return before(lengths, lambda a, b: a + b)


def _counts(points: Column, marks: Column, inclusive: bool) -> Column:
    """How many of ``marks`` are below each of ``points`` (or equal, if inclusive), by one sort."""
    first, second = (0, 1) if inclusive else (1, 0)
    events = F.concat(F.transform(marks, lambda m: F.struct(m.alias("at"), F.lit(first).alias("o"), F.lit(-1).alias("i"), F.lit(1).alias("v"))),
                      F.transform(points, lambda p, i: F.struct(p.alias("at"), F.lit(second).alias("o"), i.alias("i"), F.lit(0).alias("v"))))

    def body(e: Column) -> Column:
        return let(sums_before(F.transform(e, lambda x: x["v"])), lambda n: F.transform(F.array_sort(F.filter(
            F.transform(e, lambda x, k: F.struct(x["i"].alias("i"), F.get(n, k).alias("n"))), lambda x: x["i"] >= 0)), lambda x: x["n"]))

    return let(F.array_sort(events), body)


def overlaps(spans: Column, others: Column) -> Column:
    """For each span whether it overlaps one of ``others``: more of them start before its end than
    end up to its start."""
    begun = _counts(F.transform(spans, lambda m: m["e"]), F.transform(others, lambda m: m["s"]), False)
    over = _counts(F.transform(spans, lambda m: m["s"]), F.transform(others, lambda m: m["e"]), True)
    return F.when(F.size(others) == 0, F.transform(spans, lambda m: F.lit(False))).otherwise(F.zip_with(begun, over, lambda a, b: a > b))


_SPAN = "array<struct<s:int,e:int,x:string,before:string,after:string>>"


def spans_of(text: Column, pattern: str, hint: str) -> Column:
    """Array of (s, e, x, before, after) of a pattern's matches, left to right, non-overlapping."""

    def body(found: Column) -> Column:
        def placed(pieces: Column) -> Column:
            lengths = F.transform(found, lambda m, i: F.length(F.get(pieces, i)) + F.length(m))
            return let(sums_before(lengths), lambda at: F.transform(found, lambda m, i: let(
                F.get(at, i) + F.length(F.get(pieces, i)), lambda s: F.struct(
                    s.alias("s"), (s + F.length(m)).alias("e"), m.alias("x"), F.right(F.get(pieces, i), F.lit(40)).alias("before"),
                    F.left(F.get(pieces, i + 1), F.lit(1)).alias("after")))))

        return F.when(F.size(found) == 0, F.array().cast(_SPAN)).otherwise(let(F.split(text, pattern, -1), placed))

    return F.when(text.rlike(hint), let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), body)).otherwise(F.array().cast(_SPAN))


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the check digit of a string of digits is right."""

    def value(i: Column) -> Column:
        d = F.substring(digits, F.length(digits) + 1 - i, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, d).otherwise(2 * d - F.when(d > 4, 9).otherwise(0))

    return (F.length(digits) > 0) & (F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(digits), F.lit(1))), F.lit(0), lambda a, i: a + F.coalesce(value(i), F.lit(0))) % 10 == 0)


def passes(kind: str, x: Column) -> Column:
    """The kind's test of a match."""
    if kind == "email":
        return x.rlike(rf"^[{_LOCAL}]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+$")
    if kind == "ip":
        return x.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        return let(_digits(x), lambda d: F.length(d).between(12, 19) & luhn(d))
    return F.length(_digits(x)).between(9, 15)


def base_spans(text: Column, kind: str) -> Column:
    return F.filter(spans_of(text, BASE[kind], _HINT[kind]), lambda m: passes(kind, m["x"]))


def _features(kind: str, m: Column) -> list[Column]:
    x, d = m["x"], _digits(m["x"])
    number = lambda c: c.cast("double")
    values = (F.lit(float(KINDS.index(kind))), number(F.length(d)), number(F.length(x)), number(F.regexp_count(x, F.lit("[^A-Za-z0-9]"))),
              number(F.regexp_count(x, F.lit("[0-9]+"))), number(F.array_max(F.transform(F.split(x, "[^0-9]+"), lambda g: F.length(g)))), number(luhn(d)),
              number(x.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")), number(x.startswith("+")), number(F.contains(x, F.lit("("))), number(F.contains(x, F.lit("@"))),
              number(F.regexp_count(x, F.lit(r"\."))), number(F.regexp_count(x, F.lit("[A-Za-z]"))), number(m["before"].rlike("[A-Za-z0-9]$")),
              number(m["after"].rlike("[A-Za-z0-9]")), number(m["before"].rlike(CUES[kind])))
    return [v.alias(n) for n, v in zip(FEATURES, values)]


def _labelled(kind: str) -> Column:
    """The kind's proposals with their features: base spans (label 1); spans over another kind's base
    span, and spans that overlap none and fail the test (0); and those that overlap none and pass it
    or are of another spelling (null). Spans ``taken`` by a base span are not added."""
    spelled = F.lit(r"\[at\]|\(at\)|\[dot\]|\(dot\)|^\(|^\+|@ | @")

    def row(m: Column, label: Column, taken: Column) -> Column:
        return F.struct(F.lit(kind).alias("of"), m["s"].alias("s"), m["e"].alias("e"), label.alias("label"), taken.alias("taken"),
                        F.xxhash64(m["x"], m["before"], m["after"]).alias("span"), *_features(kind, m))

    def one(m: Column, own: Column, taken: Column) -> Column:
        return row(m, F.when(own, -1.0).when(taken, 0.0).when(~passes(kind, m["x"]) & ~F.regexp_like(m["x"], spelled), 0.0), own | taken)

    other = let(F.col(f"own_{kind}"), lambda own: let(F.col(f"taken_{kind}"), lambda taken: F.transform(
        f"once_{kind}", lambda m, i: one(m, F.get(own, i), F.get(taken, i)))))
    return F.concat(F.transform(f"b_{kind}", lambda m: row(m, F.lit(1.0), F.lit(True))), F.filter(other, lambda m: F.coalesce(m["label"] >= 0, F.lit(True))))


def with_spans(rows: DataFrame, propose: bool = True) -> DataFrame:
    """``rows`` (text not null) with b_<kind>, the base spans, and the array ``proposed``. Each step is a
    column of its own, and a column that a lambda reads is bound first, so nothing is computed anew
    for every element."""
    columns, text = rows.columns, F.col("text")
    out = rows.withColumns({f"b_{k}": base_spans(text, k) for k in KINDS})
    if not propose:
        return out
    differs = lambda x: F.filter(x, lambda m, i: (i == 0) | (F.get(x, i - 1)["s"] != m["s"]) | (F.get(x, i - 1)["e"] != m["e"]))
    out = out.withColumns({f"loose_{k}": F.array_sort(F.concat(*[spans_of(text, p, _HINT[k]) for p in PROPOSE[k]])) for k in KINDS})
    out = out.withColumns({f"once_{k}": let(F.col(f"loose_{k}"), differs) for k in KINDS})
    out = out.withColumns({f"others_{k}": F.concat(*[F.col(f"b_{x}") for x in KINDS if x != k]) for k in KINDS})
    out = out.withColumns({f"own_{k}": overlaps(F.col(f"once_{k}"), F.col(f"b_{k}")) for k in KINDS} | {
        f"taken_{k}": overlaps(F.col(f"once_{k}"), F.col(f"others_{k}")) for k in KINDS})
    return out.withColumn("proposed", F.concat(*[_labelled(k) for k in KINDS])).select(*columns, *[f"b_{k}" for k in KINDS], "proposed")


def proposals(docs: DataFrame) -> DataFrame:
    return with_spans(need(docs, "text").select(F.coalesce("text", F.lit("")).alias("text")))


def _tree(node, value) -> Column:
    """A decision tree as nested conditions; ``value`` gives a feature's column."""
    if node.getClass().getSimpleName() == "LeafNode":
        return F.lit(float(node.prediction()))
    split = node.split()
    return F.when(value(FEATURES[split.featureIndex()]) <= float(split.threshold()), _tree(node.leftChild(), value)).otherwise(_tree(node.rightChild(), value))


class Model:
    """The boosted trees and each kind's threshold of the score."""

    def __init__(self, gbt, thresholds: dict[str, float]):
        self.gbt, self.thresholds = gbt, thresholds

    @staticmethod
    def margin(gbt, value) -> Column:
        out = F.lit(0.0)
        for tree, weight in zip(gbt.trees, gbt.treeWeights):
            out = out + F.lit(float(weight)) * _tree(tree._java_obj.rootNode(), value)
        return out

    def accepts(self, m: Column) -> Column:
        score = self.margin(self.gbt, lambda name: m[name])
        least = F.lit(None).cast("double")
        for kind, t in self.thresholds.items():
            least = F.when(m["of"] == kind, F.lit(t)).otherwise(least)
        return F.coalesce(score >= least, F.lit(False))


def train(found: DataFrame, sample: int = SAMPLE) -> Model | None:
    """Fit on at most about ``sample`` rows, as many for each kind and label; calibrate on all that is held out."""
    # outer: else a filter on the array's size is inferred below, which computes the array once more
    rows = found.select(F.explode_outer("proposed").alias("m")).select("m.*").where("label is not null")
    key = ["of", "label", *FEATURES]
    spans = rows.groupBy(*key, "span").agg(F.count("*").alias("n"))
    counted = stored(spans.groupBy(*key, (F.pmod("span", F.lit(5)) == 0).alias("held")).agg(
        F.sum("n").alias("n"), F.count("*").cast("double").alias("spans")), "labelled")
    fit, part = counted.where("not held").withColumn("deal", F.xxhash64(*FEATURES)), sample // (2 * len(KINDS))
    strata = fit.groupBy("of", "label").agg(F.count("*").alias("rows")).collect()
    if {r["label"] for r in strata} != {0.0, 1.0}:
        return None
    here, most = F.lit(False), 1 << 30
    for r in strata:
        here = here | ((F.col("of") == r["of"]) & (F.col("label") == r["label"]) & (F.pmod("deal", F.lit(most)) < -(-part * most // r["rows"])))
    fit = stored(fit.where(here), "fit").coalesce(1).sortWithinPartitions("deal", *key)  # bounded by the sample
    # the spans of a kind and label together weigh no more than as many as a part
    total = {(r["of"], r["label"]): r["spans"] for r in fit.groupBy("of", "label").agg(F.sum("spans").alias("spans")).collect()}
    weight = F.lit(1.0)
    for (of, label), n in sorted(total.items()):
        weight = F.when((F.col("of") == of) & (F.col("label") == label), F.lit(min(1.0, part / n))).otherwise(weight)
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(
        fit.withColumn("weight", F.col("spans") * weight)).select("features", "label", "weight").cache()
    gbt = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=7, stepSize=0.3, weightCol="weight").fit(vectors)
    vectors.unpersist()
    held = counted.where("held").select("of", "label", "n", Model.margin(gbt, F.col).alias("score")).groupBy("of", "score").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("label")).alias("right")).collect()
    thresholds = {}
    for kind in KINDS:
        n = right = 0.0
        for score, of_score, right_of_score in sorted(((r["score"], r["n"], r["right"]) for r in held if r["of"] == kind), reverse=True):
            n, right = n + of_score, right + right_of_score
            if score > 0 and right / n >= PRECISION:
                thresholds[kind] = score
    return Model(gbt, thresholds) if thresholds else None


def _searched(rows: DataFrame, model: Model | None) -> DataFrame:
    """``rows`` with base and spans: sorted arrays of (s, kind number k, e), ``base`` of the rules alone."""
    mark = lambda k: F.transform(f"b_{k}", lambda m: F.struct(m["s"].alias("s"), F.lit(KINDS.index(k)).alias("k"), m["e"].alias("e")))
    base = F.array_sort(F.concat(*[mark(k) for k in KINDS])).alias("base")
    found = with_spans(rows, model is not None)
    if model is None:
        return found.select(*rows.columns, base).withColumn("spans", F.col("base"))
    more = F.transform(F.filter("proposed", lambda m: ~m["taken"] & model.accepts(m)),
                       lambda m: F.struct(m["s"].alias("s"), m["kind"].cast("int").alias("k"), m["e"].alias("e")))
    return found.select(*rows.columns, base, more.alias("more")).select(
        *rows.columns, "base", F.when(F.size("more") == 0, F.col("base")).otherwise(F.array_sort(F.concat("base", "more"))).alias("spans"))


def find(docs: DataFrame, model: Model | None | str = "train") -> DataFrame:
    """(doc_id, text, base, spans) per row of ``docs``."""
    if model == "train":
        model = train(proposals(docs))
    return _searched(need(docs, "doc_id", "text").withColumn("text", F.coalesce("text", F.lit(""))), model)


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda m: F.concat_ws(":", F.get(names, m["k"]), m["s"], m["e"])), ",")


def report(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, the base rules' counts and digest, and all spans."""
    count = lambda k: F.size(F.filter("base", lambda m: m["k"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    return find(docs).select("doc_id", *[count(k) for k in KINDS], F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def redacted(text: Column, spans: Column) -> Column:
    """The text with every span, overlapping ones as one, replaced by the first one's kind in brackets.
    ``spans`` are sorted."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    ends = F.transform(spans, lambda m: m["e"])

    def body(upto: Column) -> Column:
        # what lies between the spans before and this one; nothing if it overlaps them
        parts = F.transform(spans, lambda m, i: F.when(m["s"] >= F.get(upto, i), F.concat(
            F.substring(text, F.get(upto, i) + 1, m["s"] - F.get(upto, i)), F.get(names, m["k"]))))
        return F.concat(F.array_join(parts, ""), F.substring(text, F.array_max(ends) + 1, F.length(text)))

    return F.when(F.size(spans) == 0, text).otherwise(let(before(ends, lambda a, b: F.greatest(a, b)), body))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; n_chars, where there is one, follows a
    changed text. A null text stays null."""
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    found = _searched(whole, train(proposals(docs)))
    changed, text = F.size("spans") > 0, redacted(F.col("text"), F.col("spans"))
    out = found.select("row", changed.alias("changed"), F.when(changed, text).otherwise(F.col("row.text")).alias("now"))
    columns = {c: F.col(f"row.`{c}`") for c in docs.columns} | {"text": F.col("now")}
    if "n_chars" in columns:
        columns["n_chars"] = F.when(F.col("changed"), F.char_length("now").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return out.select(*[columns[c].alias(c) for c in docs.columns])
