"""Personal data by boosted candidates.

Strict patterns with checks (octets, Luhn, number of digits) find the base
spans. High-recall generators then propose overlapping spans: long tokens,
digit groups, dotted and spelled-out addresses. Gradient-boosted trees score
each candidate from its format (length, kinds of characters, checks) and its
context (what stands before it); calibrated thresholds select further spans.
Base spans always stay.

There are no labelled spans, so labels come from witnesses. A candidate is
positive if a base span covers it, if it is assigned to a name such as
``password``, or if it passes its generator's own format check (grouped digits of
a phone, two card numbers run together, a valid spelled-out domain, a MAC or IPv6
address). It is unknown, and neither fitted nor counted, if it overlaps a base span in
part or looks as random as a key without being named; anything else is negative.
The features do not name the generator, and every row is fitted (and held out) in
two more views, without context and with that of prose, so that the trees cannot
just repeat the naming rule: a key without a name is judged by its format.

A fourth of the distinct values is held out. Thresholds, one for each generator, are the
lowest ones that keep ``PRECISION`` on held-out candidates that no base span
covers, which are the ones a threshold can add; a generator with fewer than
``FIT_CLASS`` of them shares the threshold of all. All distinct candidates of all documents are
fitted or held out; equal features are one row that weighs as many as it stands for. With
fewer than ``FIT_CLASS`` candidates in a class nothing is fitted, and the witnesses
themselves select. The trees' bins come from all rows as well: MLlib samples rows for them
only beyond the square of their number. Rows are dealt by hash into parts of about
``PART_ROWS`` and sorted; one part gives the same trees in every run, of several the sums are added in any order, so that
equally good splits may change places. The fitted trees become one SQL expression, so that scoring is
a plain projection: nothing is shuffled, no document is split.

Main path: DataFrame functions only.

Patterns use possessive repetition and may only start where a run of their first
class starts, so that long runs cost linear time; what they match is unchanged. A text with
k spans costs, beside its length, about k times the square root of k.

Defined results: null counts as empty; offsets are code points, end exclusive;
repeated rows are independent; very long texts are read whole (their time is stated above); an
empty table gives an empty result; input columns
named like an added one are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import written

KINDS = ("email", "ip", "card", "phone")
EXTRA = "other"
FIT_CLASS = 10
PART_ROWS = 200_000
PRECISION = 0.95

_LOCAL = "A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Which texts a pattern is tried on at all: those that hold a mark, and a digit if it needs one.
_NEEDS = {"email": ("@", False), "ip": (".", True), "card": ("", True), "phone": ("+", True)}

GENERATORS = {
    "token": r"(?<![A-Za-z0-9_+/=-])[A-Za-z0-9_+/-]{16,}+={0,2}",
    "digits": r"(?<![0-9])\(?[0-9][0-9()\x20./-]{5,40}+",
    "spelled": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?[\[(]\x20?(?:at|AT)\x20?[\])]\x20?[A-Za-z0-9-]++(?:(?:\.|\x20?[\[(]\x20?(?:dot|DOT)\x20?[\])]\x20?)[A-Za-z0-9-]++)++",
    "colons": r"(?<![0-9A-Fa-f:])[0-9A-Fa-f]{2,4}+(?::[0-9A-Fa-f]{0,4}+){4,7}+",
}
_ASSIGNED = r"(?i)(?:token|secret|passw(?:or)?d|pwd|passphrase|api.?key|access.?key|credential|ssn|passport|iban)[\x20\"']{0,2}[:=][\x20\"']{0,3}$"
CONTEXT = 32
BLOCK = 64


def _bound(value: Column, body) -> Column:
    """``body(value)`` with the value computed once: what a lambda names outside its arguments
    is computed again for every element."""
    return F.get(F.transform(F.array(value), body), 0)


def occurrences(text: Column, pattern: str, context: int = 0) -> Column:
    """Array of (start, end, value, before): leftmost non-overlapping matches, code points, and
    the up to ``context`` (at most BLOCK / 2) characters before each.

    Texts between matches and matches alternate. A fold that lengthens an array copies it at each step,
    so matches are folded in blocks of ``BLOCK``, from 0 on, and moved by the
    lengths of the blocks before."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    near = (lambda gap: F.right(gap, F.lit(context))) if context else (lambda gap: F.lit(""))
    paired = F.zip_with(found, F.split(text, pattern, -1), lambda value, gap: F.struct(value.alias("value"), F.length(gap).alias("gap"), near(gap).alias("near")))

    def step(state: Column, m: Column) -> Column:
        start = state["at"] + m["gap"]
        end = start + F.length(m["value"])
        before = F.right(F.concat(state["tail"], m["near"]), F.lit(context)) if context else F.lit("")
        tail = F.right(F.concat(state["tail"], m["near"], m["value"]), F.lit(context)) if context else F.lit("")
        here = F.struct(start.alias("start"), end.alias("end"), m["value"].alias("value"), before.alias("before"))
        return F.when(m["value"].isNull(), state).otherwise(F.struct(end.alias("at"), tail.alias("tail"), F.concat(state["out"], F.array(here)).alias("out")))

    none = F.array().cast("array<struct<start:int,end:int,value:string,before:string>>")

    def block(pairs: Column, i: Column) -> Column:
        # Each match has a character, so that the last ``context`` of them hold the text before the block.
        last = F.slice(pairs, F.greatest(i * BLOCK - context + 1, F.lit(1)), F.least(i * BLOCK, F.lit(context)))
        tail = F.right(F.array_join(F.transform(last, lambda m: F.concat(m["near"], m["value"])), ""), F.lit(context)) if context else F.lit("")
        return F.aggregate(F.slice(pairs, i * BLOCK + 1, F.lit(BLOCK)), F.struct(F.lit(0).alias("at"), tail.alias("tail"), none.alias("out")), step)

    def moved(blocks: Column) -> Column:
        zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        before = F.aggregate(blocks, zero, lambda s, b: F.struct((s["at"] + b["at"]).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")))["out"]
        shift = lambda b, by: F.transform(b["out"], lambda m: F.struct((m["start"] + by).alias("start"), (m["end"] + by).alias("end"), m["value"].alias("value"), m["before"].alias("before")))
        return F.flatten(F.zip_with(blocks, before, shift))

    blocks = _bound(paired, lambda pairs: F.transform(F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / BLOCK).cast("int")), lambda i: block(pairs, i)))
    return F.when(F.size(found) > 0, _bound(blocks, moved)).otherwise(none)


def _parts(base: Column) -> Column:
    return F.ceil(F.sqrt(F.size(base))).cast("int") + 1


def _width(base: Column, length: Column) -> Column:
    return F.greatest(F.ceil(length / _parts(base)), F.lit(1)).cast("int")


def _cells(base: Column, width: Column) -> Column:
    """The spans that touch each of about as many equal parts of the text as the square root
    of their number, so that a candidate looks at its own parts only."""
    return F.transform(F.sequence(F.lit(0), _parts(base) - 1), lambda i: F.filter(base, lambda b: (b["start"] < (i + 1) * width) & (b["end"] > i * width)))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Luhn check of a string of at most 40 digits."""
    turned = F.reverse(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.ascii(F.substring(turned, i, F.lit(1))) - 48
        twice = d * 2
        return total + F.when(i % 2 == 1, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(turned), F.lit(1))), F.lit(0), add) % 10 == 0


def _octets(value: Column) -> Column:
    def small(part: Column) -> Column:
        bare = F.regexp_replace(part, "^0+", "")
        return F.when(F.length(bare) == 0, True).when(F.length(bare) > 3, False).otherwise(F.coalesce(bare.try_cast("int") <= 255, F.lit(False)))

    return F.forall(F.split(value, r"\."), small)


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return _octets(value)
    n = F.length(_digits(value))
    if kind == "card":
        return F.when(n.between(12, 19), luhn(_digits(value))).otherwise(False)
    if kind == "phone":
        return n.between(9, 15)
    return F.lit(True)


def has_digit(text: Column) -> Column:
    return text.rlike("[0-9]")


def may_match(text: Column, digit: Column) -> dict[str, Column]:
    """For each generator, whether the text holds what each of its matches holds."""
    return {"token": text.rlike("[A-Za-z0-9_+/-]{16}"), "digits": digit, "spelled": may_be_spelled(text), "colons": F.contains(text, F.lit(":"))}


def may_be_spelled(text: Column) -> Column:
    """Holds a bracket and "at": only then can an address be spelled out."""
    either = lambda a, b: F.contains(text, F.lit(a)) | F.contains(text, F.lit(b))
    return either("[", "(") & either("at", "AT")


def _spans(text: Column, kind: str, digit: Column) -> Column:
    mark, counted = _NEEDS[kind]
    tried = F.contains(text, F.lit(mark)) & (digit if counted else F.lit(True))
    order = KINDS.index(kind)
    good = F.filter(occurrences(text, PATTERNS[kind]), lambda m: _valid(kind, m["value"]))
    out = F.transform(good, lambda m: F.struct(m["start"].alias("start"), F.lit(order).alias("rank"), m["end"].alias("end"), F.lit(kind).alias("kind")))
    return F.when(tried, out).otherwise(F.array().cast("array<struct<start:int,rank:int,end:int,kind:string>>"))


def _formed(generator: str, value: Column) -> Column:
    """The generator's own format check; a token has none."""
    if generator == "digits":
        grouped = value.rlike(r"^(?:\([0-9]{2,4}\)|[0-9]{2,4})(?:[\x20./-]{1,2}[0-9]{2,4}){2,4}$")
        digits = _digits(value)
        phone = grouped & F.length(digits).between(9, 15) & ~value.rlike(r"^[0-9]+(?:\.[0-9]+){3}$")
        half = (F.length(digits) / 2).cast("int")
        twice = (F.length(digits) % 2 == 0) & half.between(12, 19) & luhn(F.substring(digits, F.lit(1), half)) & luhn(F.substring(digits, half + 1, half))
        return phone | F.coalesce(twice, F.lit(False))
    if generator == "spelled":
        ended = value.rlike(r"(?i)(?:\.|[\[(]\x20?dot\x20?[\])]\x20?)[a-z]{2,24}$")
        return ended & ~value.rlike(r"[\])\x20.]-|-(?:$|[\[(\x20.])")
    if generator == "colons":
        mac = value.rlike("^[0-9A-Fa-f]{2}(?::[0-9A-Fa-f]{2}){5}$")
        whole = value.rlike("^[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}$")
        short = value.rlike("^[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4})*+::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4})*+)?$")
        return mac | whole | short & (F.size(F.split(value, ":", -1)) <= 8)
    return F.lit(False)


def _unsure(generator: str, value: Column) -> Column:
    """Looks like a key: letters and digits mixed without a word between separators."""
    if generator == "token":
        return value.rlike(r"^(?=[^0-9]*[0-9])(?=[^A-Za-z]*[A-Za-z])[A-Za-z0-9+/_=-]{20,}$") & ~value.rlike(r"(?:^|[/_-])[a-z]{3,}(?:[/_-]|$)")
    return F.lit(False)


CONTEXTUAL = ("assigned", "quoted", "plus", "sentence")
FEATURES = ("length", "digits", "letters", "capitals", "separators", "hex", "groups", "luhn", "octets", "digit_share", "assigned", "quoted", "plus", "sentence")


def _candidates(text: Column, base: Column, digit: Column, labelled: bool = True, width: Column | None = None, cells: Column | None = None) -> Column:
    """Array of candidates with their features and, if asked for, what the witnesses say.

    ``width`` and ``cells`` may name columns that hold those of ``base``."""
    width = _width(base, F.length(text)) if width is None else width
    cells = _cells(base, width) if cells is None else cells

    def shaped(generator: str):
        def make(m: Column) -> Column:
            value = F.rtrim(m["value"])
            digits = _digits(value)
            n, length = F.length(digits), F.length(value)
            letters = F.length(F.regexp_replace(value, "[^A-Za-z]", ""))
            before = m["before"]
            end = m["start"] + length
            first = F.floor(m["start"] / width).cast("int")
            near = F.flatten(F.slice(cells, first + 1, F.floor((end - 1) / width).cast("int") - first + 1))
            flag = lambda c: F.when(c, 1.0).otherwise(0.0)
            covered = F.exists(near, lambda b: (b["start"] <= m["start"]) & (b["end"] >= end) | (b["start"] >= m["start"]) & (b["end"] <= end) & (2 * (b["end"] - b["start"]) >= length))
            label = F.lit(None).cast("double")
            if labelled:
                touched = F.exists(near, lambda b: (b["start"] < end) & (b["end"] > m["start"]))
                witnessed = covered | before.rlike(_ASSIGNED) | _formed(generator, value)
                label = F.when(witnessed, 1.0).when(~(touched | _unsure(generator, value)), 0.0)
            return F.struct(
                m["start"].alias("start"),
                end.alias("end"),
                covered.alias("covered"),
                F.lit(generator).alias("generator"),
                F.xxhash64(value).alias("value"),
                label.alias("label"),
                *(
                    c.cast("double").alias(name)
                    for name, c in zip(
                        FEATURES,
                        (
                            length,
                            n,
                            letters,
                            F.length(F.regexp_replace(value, "[^A-Z]", "")),
                            length - n - letters,
                            flag(value.rlike("^[0-9a-fA-F]+$")),
                            F.size(F.split(value, "[^0-9A-Za-z]+", -1)),
                            flag(F.when(n.between(12, 19), luhn(digits)).otherwise(False)),
                            flag(F.when(value.rlike(r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$"), _octets(value)).otherwise(False)),
                            n / F.greatest(length, F.lit(1)),
                            flag(before.rlike(r"[:=][\x20\"']{0,3}$")),
                            flag(before.rlike("[\"']$")),
                            flag(before.rlike(r"\+[0-9]{0,3}\x20?$")),
                            flag(before.rlike(r"[A-Za-z][.!?,]?\x20$")),
                        ),
                        strict=True,
                    )
                ),
            )

        return make

    tried = may_match(text, digit)
    parts = []
    for name, pattern in GENERATORS.items():
        found = F.when(tried[name], occurrences(text, pattern, CONTEXT)).otherwise(F.array().cast("array<struct<start:int,end:int,value:string,before:string>>"))
        parts.append(F.transform(found, shaped(name)))
    return F.concat(*parts)


def _tree_column(node, row: Column) -> Column:
    """A fitted tree as nested CASE expressions over a candidate's features."""
    if node.numDescendants() == 0:
        return F.lit(float(node.prediction()))
    split = node.split()
    feature, threshold = FEATURES[split.featureIndex()], float(split.threshold())
    return F.when(row[feature] <= threshold, _tree_column(node.leftChild(), row)).otherwise(_tree_column(node.rightChild(), row))


class Booster:
    """Boosted trees as (java node, weight), with the least total of each generator."""

    def __init__(self, trees: list, margins: dict[str, float | None]):
        self.trees, self.margins = trees, margins

    def selects(self, row: Column) -> Column:
        if not self.trees:
            return F.coalesce(row["label"] > 0, F.lit(False))
        total = F.lit(0.0)
        for node, weight in self.trees:
            total = total + F.lit(weight) * _tree_column(node, row)
        least = F.lit(None).cast("double")
        for generator, margin in self.margins.items():
            if margin is not None:
                least = F.when(row["generator"] == generator, F.lit(margin)).otherwise(least)
        return F.coalesce(total >= least, F.lit(False))


def fit(found: DataFrame, rounds: int = 8, depth: int = 3, precision: float = PRECISION) -> Booster:
    """Fit on all distinct labelled candidates of ``found`` (candidates: array)."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    # The outer form: of the other Spark first filters by the size of the array, for which
    # it writes out and computes all candidates a second time.
    flat = found.select(F.explode_outer("candidates").alias("c")).select("c.generator", "c.value", "c.covered", "c.label", *(f"c.{f}" for f in FEATURES)).where("label is not null")
    flat = written(flat.distinct(), "candidates").withColumn("held", F.pmod("value", F.lit(4)) == 0)
    # The same candidates with no context, and as they would stand in prose.
    bare = flat.withColumns({c: F.lit(0.0) for c in CONTEXTUAL})
    views = flat.unionByName(bare).unionByName(bare.withColumn("sentence", F.lit(1.0)))
    order = ["generator", "covered", "label", *FEATURES]
    shapes = written(views.groupBy("held", *order).agg(F.count("*").alias("n")), "shapes")
    # One row for each generator and class.
    sizes = shapes.where("not held").groupBy("generator", "label").agg(F.sum("n").alias("n"), F.count("*").alias("rows")).collect()
    if min(sum(r["n"] for r in sizes if r["label"] == c) for c in (0.0, 1.0)) < 3 * FIT_CLASS:
        return Booster([], {})
    total = sum(r["rows"] for r in sizes)
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    fitted = shapes.where("not held").repartition(1 + total // PART_ROWS, *order).sortWithinPartitions(*order)
    data = vectors.transform(fitted).select("features", "label", "n", F.col("n").cast("double").alias("weight")).cache()
    try:
        model = GBTClassifier(maxIter=rounds, maxDepth=depth, maxBins=max(32, math.isqrt(total) + 1), stepSize=0.3, seed=7, maxMemoryInMB=64, weightCol="weight").fit(data)
    finally:
        data.unpersist()
    trees = [(t._call_java("rootNode"), w) for t, w in zip(model.trees, model.treeWeights, strict=True)]
    # Raw prediction 1 is the trees' sum. Only candidates that a threshold could add are counted; sums of
    # eight trees differ by few thousand thousandths, so that few rows are collected.
    scored = model.transform(vectors.transform(shapes.where("held and not covered"))).select("generator", "label", "n", F.element_at(_to_array("rawPrediction"), 2).alias("raw"))
    steps = scored.groupBy("generator", F.round("raw", 3).alias("m")).agg(F.sum(F.col("label") * F.col("n")).alias("good"), F.sum("n").alias("n")).collect()
    common = _margin(steps, precision)
    margins = {g: [s for s in steps if s["generator"] == g] for g in GENERATORS}
    return Booster(trees, {g: _margin(mine, precision) if sum(s["n"] for s in mine) >= FIT_CLASS else common for g, mine in margins.items()})


def _margin(steps: list, precision: float) -> float | None:
    """The lowest threshold that keeps the precision; None if none does.

    It stands in the middle of the gap below the last margin that keeps it; where
    nothing was held out below that, at 0, where the trees themselves turn to no."""
    totals: dict[float, list[float]] = {}
    for s in steps:
        at = totals.setdefault(s["m"], [0.0, 0])
        at[0], at[1] = at[0] + s["good"], at[1] + s["n"]
    good = n = 0
    margins = sorted(totals, reverse=True)
    last = None
    for k, m in enumerate(margins):
        good, n = good + totals[m][0], n + totals[m][1]
        if good / n >= precision:
            last = k
    if last is None:
        return None
    return (margins[last] + margins[last + 1]) / 2 if last + 1 < len(margins) else min(margins[last] - 0.0005, 0.0)


def _to_array(name: str) -> Column:
    from pyspark.ml.functions import vector_to_array

    return vector_to_array(F.col(name))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _is(kind: str):
    return lambda span: span["kind"] == kind


RESULT = ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_other", "n_spans", "redactions")


def proposed(docs: DataFrame, columns: list[Column], text_col: str = "text", labelled: bool = True) -> DataFrame:
    """``columns`` with __base (array of base spans) and candidates."""
    text = F.col("__text")
    based = docs.select(*columns, F.coalesce(text_col, F.lit("")).alias("__text")).withColumn("__digit", has_digit(text))
    based = based.withColumn("__base", F.array_sort(F.concat(*(_spans(text, k, F.col("__digit")) for k in KINDS))))
    base, width = F.col("__base"), F.col("__width")
    based = based.withColumn("__width", _width(base, F.length(text))).withColumn("__cells", _cells(base, width))
    return based.withColumn("candidates", _candidates(text, base, F.col("__digit"), labelled, width, F.col("__cells"))).drop("__text", "__digit", "__width", "__cells")


def train(docs: DataFrame, text_col: str = "text") -> Booster:
    """Fit on the candidates of all documents."""
    return fit(proposed(docs, [], text_col))


def find_personal_data(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, booster: Booster | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with counts of base spans, their digest, all
    spans listed, ``n_other`` and ``n_spans`` (spans added, and all), and ``redactions``:
    array of (start, rank, end, kind). Without a ``booster`` one is trained on ``docs``."""
    booster = booster or train(docs, text_col)
    kept = [c for c in (docs.columns if keep is None else keep) if c not in RESULT]
    found = proposed(docs, [F.struct(*kept).alias("__row")] if kept else [F.lit(None).alias("__row")], text_col, labelled=not booster.trees)
    added = F.filter("candidates", lambda c: ~c["covered"] & booster.selects(c))
    added = F.transform(added, lambda c: F.struct(c["start"].alias("start"), F.lit(len(KINDS)).alias("rank"), c["end"].alias("end"), F.lit(EXTRA).alias("kind")))
    # Equal spans are neighbours once they are sorted; structs have no set to be kept in.
    every = _bound(F.array_sort(F.concat("__base", added)), lambda spans: F.filter(spans, lambda s, i: (i == 0) | (s != F.get(spans, i - 1))))
    marked = found.select("__row", "__base", every.alias("redactions"))
    counts = [F.size(F.filter("__base", _is(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    other = F.size(F.filter("redactions", _is(EXTRA))).cast("long").alias("n_other")
    rows = [F.col(f"__row.{c}") for c in kept]
    return marked.select(*rows, *counts, F.sha2(_listed(F.col("__base")), 256).alias("base_sha256"), _listed(F.col("redactions")).alias("spans"), other, F.size("redactions").cast("long").alias("n_spans"), "redactions")
