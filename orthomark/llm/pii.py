"""Personal data by candidates and boosted trees, in DataFrame functions only.

High-recall patterns propose overlapping spans: the base patterns of each kind, and wider ones
(addresses with a written-out at and dot, numbers of seven digits or more in any grouping,
numeric groups with dots or colons). Every candidate gets a few binned features of its format
and of the characters around it. Boosted trees are fitted on the candidates of all documents: a
candidate that touches a base span which passed its test (Luhn sum, octets, digit count) is a
positive example, and so is a wider one that is valid once normalised (``VALID``: an address with at
and dot written out, an IPv6 address of eight groups, a phone number in a usual grouping without
plus); any other one is a negative example. The tests themselves are no features. Per kind the
threshold is the lowest one that keeps ``PRECISION`` against these labels on the folds held out from
fitting, or on all folds where the held-out ones have too few candidates. The trees then become one
column expression, and candidates that are valid or over the threshold and touch no base span are
added. Base spans always stay.

Fitting reads the number of candidates per combination of bins, fold and label, a table whose
size is bounded by the number of bins (``MAX_CELLS``) whatever the input; every document counts.

Defined results: a null or empty text has no spans; repeated rows are judged alike.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orthomark.session import cut_lineage

KINDS = ("email", "ip", "card", "phone")
#: Base patterns. Possessive repeats and the conditions before the first character
#: change no match; they keep the search linear. Card asks for the 12 digits of the test at once.
LOCAL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++"
BASE = {
    "email": LOCAL + r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
OCTETS = r"^(?:0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.|$)){4}$"
#: Wider patterns and the kind their spans are added to.
WIDE = {
    "email": LOCAL + r"\x20?(?:@|\(at\)|\[at\])\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|\(dot\)|\[dot\])\x20?[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9A-Fa-f:.])[0-9A-Fa-f]{1,4}+(?:[:.][0-9A-Fa-f]{1,4}+){3,7}+(?![0-9A-Fa-f:])",
    "phone": r"(?<![0-9+])[(]?[0-9](?:[\x20()./-]{0,2}[0-9]){6,}+",
}
#: Tests of wider spans, of addresses as normalised by _valid.
VALID = {
    "email": r"^[A-Za-z0-9](?:[A-Za-z0-9._%+-]*[A-Za-z0-9_%+-])?@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,}$",
    "ip": r"^(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}$",
    "phone": r"^(?:[(]0?[1-9][0-9]{1,3}[)][\x20./-]?|0[1-9][0-9]{1,3}[\x20./-]|00[1-9][0-9]{0,2}[\x20.-])[0-9]{2,4}(?:[\x20.-]?[0-9]{2,4})+$"
             r"|^(?:1[\x20.-])?[2-9][0-9]{2}([\x20.-])[2-9][0-9]{2}\1[0-9]{4}$",
}
#: Cheap tests before a pattern is tried at all.
NEEDS = {"email": r"@|\(at\)|\[at\]", "ip": r"[0-9A-Fa-f][:.][0-9A-Fa-f]", "card": r"[0-9]", "phone": r"[0-9]"}
PRECISION = 0.95
#: Held-out examples of a kind from which they alone set its threshold.
LEAST_HELD_OUT = 20
ROUNDS, RATE = 12, 0.4
FEATURES = {"digits": 7, "groups": 6, "separators": 6, "letters": 3, "before": 5, "after": 5}
MAX_CELLS = 2 * 2 * len(KINDS) * math.prod(FEATURES.values())


PLACED = "array<struct<start:bigint,end:bigint,m:string,before:string,after:string>>"


def _placed(pieces: str, found: str) -> Column:
    """PLACED of the matches ``found`` and the ``pieces`` of text between them: a match starts where the
    pieces and matches before it end."""
    rows = F.zip_with(F.zip_with(pieces, found, lambda p, m: F.struct(p.alias("p"), m.alias("m"))), F.slice(pieces, 2, 2_000_000_000),
                      lambda r, q: F.struct(F.char_length(r["p"]).alias("gap"), r["m"].alias("m"), F.right(r["p"], F.lit(1)).alias("before"), F.left(q, F.lit(1)).alias("after")))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(PLACED).alias("out"))

    def step(state, r):
        begin = state["at"] + r["gap"]
        end = begin + F.char_length(r["m"])
        return F.struct(end.cast("long").alias("at"), F.array_append(state["out"], F.struct(
            begin.cast("long").alias("start"), end.cast("long").alias("end"), r["m"].alias("m"), r["before"].alias("before"), r["after"].alias("after"))).alias("out"))

    return F.aggregate(F.filter(rows, lambda r: r["m"].isNotNull()), start, step, lambda state: state["out"])


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _passes(kind: str, m: Column) -> Column:
    count = F.char_length(_digits(m))
    if kind == "ip":
        return m.rlike(OCTETS)
    if kind == "card":
        return count.between(12, 19) & F.call_function("luhn_check", _digits(m))
    if kind == "phone":
        return count.between(9, 15)
    return F.lit(True)


def _valid(kind: str, m: Column) -> Column:
    """Whether a wider match is what its kind says."""
    if kind == "email":
        return F.regexp_replace(F.regexp_replace(m, r"\x20?(?:@|\(at\)|\[at\])\x20?", "@"), r"\x20?(?:\(dot\)|\[dot\])\x20?", ".").rlike(VALID[kind])
    if kind == "phone":
        return m.rlike(VALID[kind]) & F.char_length(_digits(m)).between(9, 15)
    return m.rlike(VALID[kind])


def _bins(c: Column) -> dict[str, Column]:
    """Binned format and context of a candidate."""
    m = c["m"]
    digits = F.char_length(_digits(m))

    def around(ch: Column) -> Column:
        return (F.when(F.coalesce(ch, F.lit("")) == "", 0).when(ch.rlike(r"\s"), 1).when(ch.rlike(r"\p{L}"), 2).when(ch.rlike("[0-9]"), 3).otherwise(4))

    return {
        "digits": F.when(digits < 4, 0).when(digits < 7, 1).when(digits < 9, 2).when(digits < 12, 3).when(digits < 16, 4).when(digits < 20, 5).otherwise(6),
        "groups": F.least(F.size(F.split(m, "[^A-Za-z0-9]+")), F.lit(6)) - 1,
        "separators": (F.when(m.rlike(r"\((?:at|dot)\)|\[(?:at|dot)\]"), 5).when(m.contains("+") | m.contains("("), 4).when(m.contains(":"), 3)
                       .when(m.contains("."), 2).when(m.rlike("[ /-]"), 1).otherwise(0)),
        "letters": F.when(~m.rlike("[A-Za-z]"), 0).when(m.rlike("[G-Zg-z]"), 2).otherwise(1),
        "before": around(c["before"]), "after": around(c["after"])}


def candidates(docs: DataFrame) -> DataFrame:
    """(doc, text, base, found): the row, base spans that pass, all candidates with bins, whether they are valid wider ones and touch a base span."""
    texts = docs.select(F.struct("*").alias("doc"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    tested = texts.select("*", *[F.col("text").rlike(p).alias(f"need_{k}") for k, p in NEEDS.items()])
    patterns = {**{f"base_{k}": (k, p) for k, p in BASE.items()}, **{f"wide_{k}": (k, p) for k, p in WIDE.items()}}
    none = F.array().cast("array<string>")
    cut = tested.select("doc", "text", *[column for name, (k, p) in patterns.items() for column in (
        F.when(F.col(f"need_{k}"), F.split("text", p, -1)).otherwise(none).alias(f"pieces_{name}"),
        F.when(F.col(f"need_{k}"), F.regexp_extract_all("text", F.lit(p), F.lit(0))).otherwise(none).alias(f"found_{name}"))])
    found = cut.select("doc", "text", *[_placed(f"pieces_{name}", f"found_{name}").alias(name) for name in patterns])

    def named(kind: str, column: str, wide: bool) -> Column:
        ordinal = KINDS.index(kind)
        return F.transform(column, lambda c: F.struct(
            c["start"].alias("start"), F.lit(ordinal).alias("ord"), c["end"].alias("end"),
            (F.lit(False) if wide else _passes(kind, c["m"])).alias("passes"),
            (_valid(kind, c["m"]) if wide else F.lit(False)).alias("valid"),
            F.struct(*[v.cast("int").alias(k) for k, v in _bins(c).items()]).alias("bins")))

    everything = F.concat(*[named(k, f"base_{k}", False) for k in BASE], *[named(k, f"wide_{k}", True) for k in WIDE])
    listed = found.select("doc", "text", everything.alias("all"))
    base = F.filter("all", lambda c: c["passes"])
    return listed.select("doc", "text", "all", base.alias("base")).select(
        "doc", "text", F.transform("base", lambda c: F.struct(c["start"], c["ord"], c["end"])).alias("base"),
        F.transform("all", lambda c: F.struct(
            c["start"].alias("start"), c["ord"].alias("ord"), c["end"].alias("end"), c["bins"].alias("bins"), c["valid"].alias("valid"),
            F.exists("base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])).alias("touches"))).alias("found"))


class Trees:
    """Boosted trees of two levels on binned features, fitted on counts of equal rows."""

    def __init__(self, cells: list[tuple[tuple[int, ...], int, int]]):
        """``cells``: (bins with the kind first, positives, negatives)."""
        self.names = ["ord", *FEATURES]
        total, positive = sum(p + n for _, p, n in cells), sum(p for _, p, _ in cells)
        self.bias = math.log((positive + 1) / (total - positive + 1))
        scores = [self.bias] * len(cells)
        self.trees: list[tuple] = []
        for _ in range(ROUNDS):
            rows = []
            for (bins, p, n), s in zip(cells, scores):
                chance = 1 / (1 + math.exp(-s))
                rows.append((bins, p - (p + n) * chance, (p + n) * chance * (1 - chance)))
            tree = self._grow(rows, 2)
            self.trees.append(tree)
            scores = [s + self._value(tree, bins) for s, (bins, _, _) in zip(scores, cells)]

    def _grow(self, rows, depth: int):
        gradient, weight = sum(g for _, g, _ in rows), sum(h for _, _, h in rows)
        leaf = RATE * gradient / (weight + 1)
        if not depth:
            return leaf
        best = (1e-6, None)
        for f in range(len(self.names)):
            sums: dict[int, list[float]] = {}
            for bins, g, h in rows:
                own = sums.setdefault(bins[f], [0.0, 0.0])
                own[0] += g
                own[1] += h
            left_g = left_h = 0.0
            for cut in sorted(sums)[:-1]:
                left_g, left_h = left_g + sums[cut][0], left_h + sums[cut][1]
                gain = (left_g ** 2 / (left_h + 1) + (gradient - left_g) ** 2 / (weight - left_h + 1) - gradient ** 2 / (weight + 1))
                if gain > best[0]:
                    best = (gain, (f, cut))
        if best[1] is None:
            return leaf
        f, cut = best[1]
        return (f, cut, self._grow([r for r in rows if r[0][f] <= cut], depth - 1), self._grow([r for r in rows if r[0][f] > cut], depth - 1))

    def _value(self, tree, bins) -> float:
        while isinstance(tree, tuple):
            tree = tree[2] if bins[tree[0]] <= tree[1] else tree[3]
        return tree

    def score(self, bins: tuple[int, ...]) -> float:
        return self.bias + sum(self._value(t, bins) for t in self.trees)

    def column(self, c: Column) -> Column:
        """The score of a candidate as an expression."""
        def node(tree) -> Column:
            if not isinstance(tree, tuple):
                return F.lit(float(tree))
            name = self.names[tree[0]]
            value = c["ord"] if name == "ord" else c["bins"][name]
            return F.when(value <= tree[1], node(tree[2])).otherwise(node(tree[3]))

        return reduce(lambda a, b: a + b, [node(t) for t in self.trees], F.lit(float(self.bias)))


def fit(found: DataFrame) -> tuple[Trees, dict[str, float]]:
    """Trees and the threshold of every kind, from the candidates of all documents."""
    rows = found.select(F.pmod(F.xxhash64("doc_id"), F.lit(4)).alias("fold"), F.explode("found").alias("c"))
    label = F.col("c.touches") | F.col("c.valid")
    keys = [F.col("c.ord"), *[F.col(f"c.bins.{k}").alias(k) for k in FEATURES]]
    counted = rows.groupBy(*keys, (F.col("fold") == 0).alias("held")).agg(
        F.count_if(label).alias("p"), F.count_if(~label).alias("n")).collect()
    fitted = [(tuple(r)[:len(keys)], r.p, r.n) for r in counted if not r.held]
    trees = Trees(fitted)
    thresholds = {}
    for ordinal, kind in enumerate(KINDS):
        own = [r for r in counted if r.ord == ordinal]
        apart = [r for r in own if r.held]
        few = sum(r.p + r.n for r in apart) < LEAST_HELD_OUT
        held = sorted(((trees.score(tuple(r)[:len(keys)]), r.p, r.n) for r in (own if few else apart)), reverse=True)
        thresholds[kind], p, n = math.inf, 0, 0
        for k, (score, more_p, more_n) in enumerate(held):
            p, n = p + more_p, n + more_n
            last = k + 1 == len(held) or held[k + 1][0] < score
            if last and p >= PRECISION * (p + n):
                thresholds[kind] = score
    return trees, thresholds


def _chosen(trees: Trees, thresholds: dict[str, float]) -> Column:
    """Base spans and added ones of candidates(), ascending."""
    def over(c: Column) -> Column:
        score = trees.column(c)
        chosen = F.lit(False)
        for ordinal, kind in enumerate(KINDS):
            if thresholds[kind] < math.inf:
                chosen = F.when(c["ord"] == ordinal, score >= thresholds[kind]).otherwise(chosen)
        return ~c["touches"] & (c["valid"] | chosen)

    added = F.transform(F.filter("found", over), lambda c: F.struct(c["start"], c["ord"], c["end"]))
    return F.array_sort(F.array_distinct(F.concat("base", added)))


def detect(docs: DataFrame) -> DataFrame:
    """(doc_id, base, spans): arrays of struct(start, ord, end), ascending; ``spans`` holds the base
    spans and the added ones. Places are code points, end exclusive."""
    found = cut_lineage(candidates(docs.select("doc_id", "text")).select("doc.doc_id", "base", "found"))
    return found.select("doc_id", F.array_sort("base").alias("base"), _chosen(*fit(found)).alias("spans"))


def written(spans: str) -> Column:
    """kind:start:end of every span, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["ord"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind in angle brackets; overlapping spans
    become one, of the kind of the first. A null text stays null. Fitting reads the texts once (only the
    candidates are written) and redaction once more, so that rows need no key."""
    found = candidates(docs)
    trees, thresholds = fit(cut_lineage(found.select("doc.doc_id", "found")))
    kind = "array<struct<start:bigint,ord:int,end:bigint>>"

    def grow(out, s):
        last = F.element_at(out, -1)
        touching = F.coalesce(F.try_element_at(out, F.lit(-1))["end"] > s["start"], F.lit(False))
        wider = F.concat(F.slice(out, 1, F.size(out) - 1), F.array(F.struct(
            last["start"].alias("start"), last["ord"].alias("ord"), F.greatest(last["end"], s["end"]).alias("end"))))
        return F.when(touching, wider).otherwise(F.array_append(out, s))

    spans = found.select("doc", "text", _chosen(trees, thresholds).cast(kind).alias("spans"))
    merged = spans.select("doc", "text", F.aggregate("spans", F.array().cast(kind), grow).alias("spans"))
    starts = F.concat(F.array(F.lit(0).cast("long")), F.transform("spans", lambda s: s["end"]))
    ends = F.concat(F.transform("spans", lambda s: s["start"]), F.array(F.char_length("text").cast("long")))
    pieces = F.zip_with(starts, ends, lambda a, b: F.substring(F.col("text"), (a + 1).cast("int"), (b - a).cast("int")))
    kinds = F.array(*[F.lit(f"<{k}>") for k in KINDS])
    marks = F.concat(F.transform("spans", lambda s: F.get(kinds, s["ord"])), F.array(F.lit("")))
    cut = F.when(F.size("spans") > 0, F.array_join(F.zip_with(pieces, marks, lambda p, m: F.concat(p, m)), "")).otherwise(F.col("doc.text").cast("string"))
    return merged.select(*[cut.alias("text") if c == "text" else F.col(f"doc.`{c}`").alias(c) for c in docs.columns])
