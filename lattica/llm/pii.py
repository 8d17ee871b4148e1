"""Personal data: candidate spans judged by gradient-boosted trees, all in DataFrame expressions.

High-recall generators propose spans that may overlap. Every candidate is seen in two views that share
nothing. The label view is what can be known of it for certain: for kinds with a validator (octets,
Luhn sum, number of digits) its verdict, for the others whether a word for the kind stands in or before
the match, or whether a secret has the published form of some service's keys. The feature view is format
and surroundings without what the label view reads: kinds with a validator keep their context words as
features, the others do not, and no feature tells a validator's verdict, a secret's key word or a
published form.

`fit` counts candidates per feature vector, label and half (by a checksum of the text) over the whole
table (one grouped aggregate; the number of vectors is bounded by MAX_CELLS). Trees are boosted on the
counts of one half on the driver, which is the same as boosting on its rows; the threshold of each kind
is the least score at which the isotonic rate of true labels in the other half reaches the precision.
The trees come back as one expression, so scoring runs in the JVM, row by row, without shuffle or Python.

Spans of the base rules always stay. Of the rest, a candidate is added if its score reaches its kind's
threshold, and for no other reason; one that fails its validator must also stand behind a word for its
kind. Added spans overlap neither base spans nor better added ones.

Defined results: null text counts as empty and has no span. Repeated rows are treated alike, ties go
to the earlier span and then to the kind listed first. Null ids and other columns do not matter
(working columns start with `__p_`). An empty table gives an empty table and an empty model. Texts
of any length are searched whole, in time that grows with their length: matches are placed by running
sums in chunks, and only spans of one run of overlaps are compared.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.common import once, running, written

#: Kinds in their order; the first four have base rules.
KINDS = ("email", "ip", "card", "phone", "email_spelled", "phone_local", "id_number", "secret")
BASE_KINDS = 4

#: Possessive forms of the base rules: the same matches, without backtracking over long runs.
GENERATORS = (
    r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    r"[0-9]++(?:[\x20-][0-9]++)*+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}\x20?[\[(]\x20?at\x20?[\])]\x20?[A-Za-z0-9-]{1,63}(?:\x20?(?:\.|[\[(]\x20?dot\x20?[\])])\x20?[A-Za-z0-9-]{2,63}){1,4}",
    r"(?<![0-9+])(?<!\+[0-9]{1,3}[\x20.(-]{1,2})\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
    r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    r"(?i:\b(?:token|api_?key|secret|password|passwd)\b\x20?[=:]\x20?[\"']?[A-Za-z0-9/+_-]{12,256}[\"']?)|(?<![A-Za-z0-9/+_-])[A-Za-z0-9/+_-]{20,256}+(?![A-Za-z0-9/+_-])",
)
#: Texts that match none of it have no candidate.
GATE = r"[0-9@]|[\[(]\x20?at\x20?[\])]|(?i:token|api_?key|secret|passw)"

#: Words that name a kind, and the group of words of each kind.
CONTEXTS = (
    r"\b(?:e-?mails?|mail|contact|write to|reach)\b",
    r"\b(?:ip|host|server|address|ping)\b",
    r"\b(?:card|visa|mastercard|amex|credit|payment|iban)\b",
    r"\b(?:phone|call|tel|fax|mobile|telephone)\b",
    r"\b(?:ssn|social security|id number|passport)\b",
    r"\b(?:token|key|secret|password|passwd)\b",
)
GROUP_OF = (0, 1, 2, 3, 0, 3, 4, 5)
#: Published forms of keys of well-known services.
KEY_FORMS = r"^(?:AKIA|ASIA)[0-9A-Z]{16}$|^gh[pousr]_[A-Za-z0-9]{36}$|^AIza[0-9A-Za-z_-]{35}$|^xox[abprs]-[0-9A-Za-z-]{10,}$|^sk-[A-Za-z0-9_-]{20,}$"
#: Features and their number of values. named: 1 a word for the kind, 2 for another (kinds with a
#: validator only); mix: 0 no letters, 1 no digits, 2 small letters, 3 capitals, 4 both with digits.
FEATURES = {"kind": 8, "named": 3, "open": 2, "shut": 2, "seps": 4, "size": 5, "mix": 5}
MAX_CELLS = math.prod(FEATURES.values()) * 4

#: Code points of a block of text in `redact`.
BLOCK = 16384

_DIGITS = "regexp_replace({m}, '[^0-9]', '')"
_LUHN = (
    "(aggregate(transform(split(reverse({d}), ''), (x, i) -> if(i % 2 = 0, cast(x as int), cast(x as int) * 2 - if(cast(x as int) > 4, 9, 0))), 0, (a, x) -> a + x) % 10 = 0)"
)


def _spans(kind: int, text: str) -> str:
    """All matches of a generator with their places: lengths of the pieces between them add up."""
    rx = GENERATORS[kind].replace("\\", "\\\\").replace("'", "\\'")
    digits = _DIGITS.format(m="q.m")
    keep = {2: f"length({digits}) between 12 and 19", 3: f"length({digits}) >= 7"}.get(kind, "true")
    found = f"zip_with(regexp_extract_all({text}, '{rx}', 0), split({text}, '{rx}', -1), (m, g) -> named_struct('m', coalesce(m, ''), 'g', g))"
    # What is around a match comes from the pieces, as a substring of the text would walk up to it each time.
    around = "'b', lower(right(concat(coalesce(get(z, j - 1).m, ''), x.g), 32)), 'a', left(concat(get(z, j + 1).g, get(z, j + 1).m), 1)"
    placed = f"transform(z, (x, j) -> named_struct('k', {kind}, 's', get(w, j) + length(x.g), 'e', get(w, j) + length(x.g) + length(x.m), 'm', x.m, {around}))"
    widths = "transform(z, x -> length(x.g) + length(x.m))"
    return f"filter(transform(array({found}), z -> transform(array(transform(array({widths}), y -> {running('y')})[0]), w -> {placed})[0])[0], q -> q.m != '' and {keep})"


_VALID = (
    "case c.k when 0 then true"
    " when 1 then forall(split(c.m, '[.]'), x -> length(ltrim('0', x)) < 3 or (length(ltrim('0', x)) = 3 and ltrim('0', x) <= '255'))"
    f" when 2 then {_LUHN.format(d=_DIGITS.format(m='c.m'))}"
    f" when 3 then length({_DIGITS.format(m='c.m')}) between 9 and 15"
    " else false end"
)


def candidates(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add `__p_c`: array of candidates (k kind, s start, e end, v valid, y label, and the features
    f_...), and `__p_h`, the half that the text belongs to."""
    docs = docs.withColumn("__p_t", F.expr(f"coalesce(`{text}`, '')"))
    gate = GATE.replace("\\", "\\\\")
    empty = "cast(array() as array<struct<k:int,s:int,e:int,m:string,b:string,a:string>>)"
    found = " || ".join(_spans(k, "__p_t") for k in range(len(KINDS)))
    docs = docs.withColumn("__p_r", F.expr(f"if(__p_t rlike '{gate}', {found}, {empty})"))
    value = "if(c.k = 7, regexp_extract(c.m, '([A-Za-z0-9/+_-]+)[^A-Za-z0-9/+_-]?$', 1), c.m)"
    docs = docs.withColumn(
        "__p_v",
        F.expr(
            f"transform(__p_r, c -> named_struct('k', c.k, 's', c.s, 'e', c.e, 'm', {value}, 'v', {_VALID}, 'i', c.k = 7 and length(c.m) > length({value}),"
            " 'b', c.b, 'a', c.a))"
        ),
    )
    names = "array({})".format(", ".join("c.b rlike '{}'".format(rx.replace("\\", "\\\\")) for rx in CONTEXTS))
    docs = docs.withColumn("__p_v", F.expr(f"transform(__p_v, c -> named_struct('c', c, 'n', {names}))"))
    forms = KEY_FORMS.replace("\\", "\\\\")
    own = "element_at(q.n, element_at(array({}), q.c.k + 1))".format(", ".join(str(g + 1) for g in GROUP_OF))
    return docs.withColumn("__p_h", F.expr("cast(crc32(cast(__p_t as binary)) % 2 as int)")).withColumn(
        "__p_c",
        F.expr(
            f"transform(__p_v, q -> named_struct('k', q.c.k, 's', q.c.s, 'e', q.c.e, 'v', q.c.v, 'y', if(q.c.k < {BASE_KINDS}, q.c.v, {own} or q.c.i or (q.c.k = 7 and q.c.m rlike '{forms}')), 'f_kind', q.c.k,"
            f" 'f_named', case when q.c.k >= {BASE_KINDS} then 0 when {own} then 1 when exists(q.n, x -> x) then 2 else 0 end,"
            " 'f_open', cast(q.c.k = 7 or q.c.b = '' or right(q.c.b, 1) rlike '[^a-z0-9]' as int), 'f_shut', cast(q.c.k = 7 or q.c.a rlike '^[^A-Za-z0-9]?$' as int),"
            " 'f_seps', least(3, length(q.c.m) - length(regexp_replace(q.c.m, '[ ().-]', ''))),"
            " 'f_size', case when length(q.c.m) < 8 then 0 when length(q.c.m) < 16 then 1 when length(q.c.m) < 24 then 2 when length(q.c.m) < 36 then 3 else 4 end,"
            " 'f_mix', case when not q.c.m rlike '[A-Za-z]' then 0 when not q.c.m rlike '[0-9]' then 1 when q.c.m rlike '[a-z]' and q.c.m rlike '[A-Z]' then 4 when q.c.m rlike '[A-Z]' then 3 else 2 end))"
        ),
    ).drop("__p_r", "__p_v")


@dataclass
class Model:
    """Boosted trees as nested tuples (feature, highest value going left, left, right) or leaves."""

    start: float = 0.0
    trees: list = field(default_factory=list)
    thresholds: tuple = (1.0,) * len(KINDS)
    #: By kind, in the half that thresholds are taken from: candidates, labels, candidates chosen, labels among them.
    report: dict = field(default_factory=dict)

    def sql(self, c: str = "c") -> str:
        def of(t):
            return repr(t) + "D" if isinstance(t, float) else f"if({c}.f_{t[0]} <= {t[1]}, {of(t[2])}, {of(t[3])})"

        return f"1D / (1D + exp(-({self.start!r}D{''.join(' + ' + of(t) for t in self.trees)})))".replace("+ -", "- ")

    def score(self, x: dict[str, np.ndarray]) -> np.ndarray:
        def of(t):
            return t if isinstance(t, float) else np.where(x[t[0]] <= t[1], of(t[2]), of(t[3]))

        return 1 / (1 + np.exp(-(self.start + sum((of(t) for t in self.trees), np.zeros(len(x["kind"]))))))


def _calibrated(score: np.ndarray, n: np.ndarray, y: np.ndarray, precision: float) -> float:
    """The least score whose isotonic (pool-adjacent-violators) rate of true labels reaches precision."""
    pools: list[list[float]] = []  # least score, count, true
    for s in sorted(set(score)):
        pools.append([s, n[score == s].sum(), y[score == s].sum()])
        while len(pools) > 1 and pools[-2][2] * pools[-1][1] >= pools[-1][2] * pools[-2][1]:
            _, c, t = pools.pop()
            pools[-1][1:] = [pools[-1][1] + c, pools[-1][2] + t]
    return float(next((s - 1e-9 for s, c, t in pools if t >= precision * c), 1.0))


def fit(docs: DataFrame, text: str = "text", **settings) -> Model:
    """Count labelled candidates over all documents, then boost on one half and calibrate on the other."""
    return boost(candidates(docs.select(text), text), **settings)


def boost(found: DataFrame, trees: int = 16, depth: int = 3, rate: float = 0.4, precision: float = 0.9) -> Model:
    """The model of a table of `candidates`."""
    names = list(FEATURES)
    listed = ", ".join(f"'{n}', c.f_{n}" for n in names)
    cells = (
        found.select(F.expr(f"explode(transform(__p_c, c -> named_struct({listed}, 'half', __p_h, 'y', cast(c.y as int))))").alias("x"))
        .groupBy(*(F.col("x")[n].alias(n) for n in (*names, "half")))
        .agg(F.count("*").alias("n"), F.sum("x.y").alias("y"))
        .collect()  # at most MAX_CELLS rows
    )
    if not cells:
        return Model()
    cells.sort(key=lambda r: tuple(r[k] for k in (*names, "half")))
    every = {k: np.array([r[k] for r in cells]) for k in names}
    taught = np.array([r["half"] == 0 for r in cells])
    if not taught.any():
        return Model()
    n_all, y_all = (np.array([r[k] for r in cells], dtype=float) for k in ("n", "y"))
    x, n, y = {k: v[taught] for k, v in every.items()}, n_all[taught], y_all[taught]
    base = (y.sum() + 1) / (n.sum() + 2)
    model = Model(start=float(math.log(base / (1 - base))))
    splits = [(k, v) for k in names for v in range(FEATURES[k] - 1)]
    left = np.array([x[k] <= v for k, v in splits])

    def grow(mask, g, h, level):
        gs, hs = g[mask].sum(), h[mask].sum()
        leaf = float(round(rate * gs / (hs + 1.0), 6))
        if level == 0 or mask.sum() < 2:
            return leaf
        gl, hl = (left & mask) @ g, (left & mask) @ h
        gain = gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1)
        best = int(np.argmax(gain))
        if gain[best] < 1e-6:
            return leaf
        return (*splits[best], grow(mask & left[best], g, h, level - 1), grow(mask & ~left[best], g, h, level - 1))

    for _ in range(trees):
        p = model.score(x)
        model.trees.append(grow(np.ones(len(n), bool), y - n * p, n * p * (1 - p), depth))
    score, limits = model.score(every), []
    for k, kind in enumerate(KINDS):
        own = np.flatnonzero((every["kind"] == k) & ~taught)
        limits.append(_calibrated(score[own], n_all[own], y_all[own], precision))
        taken = own[score[own] >= limits[-1]]
        model.report[kind] = tuple(int(v.sum()) for v in (n_all[own], y_all[own], n_all[taken], y_all[taken]))
    model.thresholds = tuple(limits)
    return model


def find(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Add `__p_base` (spans of the base rules) and `__p_all` (with what is added): arrays of
    (s, k, e), by start and kind."""
    return choose(candidates(docs, text), model)


def choose(found: DataFrame, model: Model) -> DataFrame:
    """`__p_base` and `__p_all` of a table of `candidates`."""
    limit = "element_at(array({}), c.k + 1)".format(", ".join(f"{t!r}D" for t in model.thresholds))
    fixed = f"c.k < {BASE_KINDS} and c.v"
    found = found.withColumn("__p_base", once(F.expr(f"array_sort(transform(filter(__p_c, c -> {fixed}), c -> named_struct('s', c.s, 'k', c.k, 'e', c.e)))")))
    # All spans that may stay, by start; p is 2 for base spans, so that they win.
    wanted = f"((c.k >= {BASE_KINDS} or c.f_named = 1) and {model.sql()} >= {limit})"
    found = found.withColumn("__p_q", F.expr(f"array_sort(transform(filter(__p_c, c -> ({fixed}) or {wanted}), c -> named_struct('s', c.s, 'k', c.k, 'e', c.e, 'b', {fixed}, 'p', if({fixed}, 2D, {model.sql()}))))"))
    # The furthest end before each; runs of overlapping spans begin where it is passed.
    found = found.withColumn("__p_e", once(F.expr(f"transform(array(transform(__p_q, c -> c.e)), y -> {running('y', 'greatest({a}, {b})')})[0]")))
    found = found.withColumn("__p_f", once(F.expr("filter(transform(__p_q, (c, i) -> if(c.s >= get(__p_e, i), i, -1)), i -> i >= 0)")))
    better = "o.s < c.e and c.s < o.e and (o.p > c.p or (o.p = c.p and (o.s < c.s or (o.s = c.s and o.k < c.k))))"
    runs = "transform(__p_f, (i, j) -> slice(__p_q, i + 1, coalesce(get(__p_f, j + 1), size(__p_q)) - i))"
    kept = f"flatten(transform({runs}, r -> if(size(r) = 1, r, filter(r, c -> c.b or not exists(r, o -> {better})))))"
    found = found.withColumn("__p_all", once(F.expr(f"array_sort(transform({kept}, c -> named_struct('s', c.s, 'k', c.k, 'e', c.e)))")))
    return found.drop("__p_c", "__p_q", "__p_e", "__p_f", "__p_h")


_KIND = "element_at(array({}), c.k + 1)".format(", ".join(f"'{k}'" for k in KINDS))


def redact(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The documents with every found span replaced by its kind in brackets; overlapping spans become
    one. Null texts stay null."""
    found = find(docs, model, text)
    # The furthest end before each span, and the text in blocks, as a substring walks up to its place.
    found = found.withColumns({
        "__p_e": once(F.expr(f"transform(array(transform(__p_all, c -> c.e)), y -> {running('y', 'greatest({a}, {b})')})[0]")),
        "__p_b": once(F.expr(f"if(size(__p_all) = 0, array(), transform(sequence(0, length(__p_t) div {BLOCK}), k -> substring(__p_t, k * {BLOCK} + 1, {BLOCK})))")),
    })
    piece = f"substring(array_join(slice(__p_b, {{a}} div {BLOCK} + 1, {{b}} div {BLOCK} - {{a}} div {BLOCK} + 1), ''), {{a}} % {BLOCK} + 1, {{b}} - {{a}})"
    # Of each span the text before it and its mark, or nothing if it begins within another.
    marks = f"transform(__p_all, (c, i) -> if(c.s < get(__p_e, i), '', concat({piece.format(a='get(__p_e, i)', b='c.s')}, '[', upper({_KIND}), ']')))"
    text_ = f"concat(array_join({marks}, ''), substring(__p_t, array_max(transform(__p_all, c -> c.e)) + 1))"
    return found.select(*(F.expr(f"if(size(__p_all) = 0, `{c}`, {text_})").alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns))


def digest(spark: SparkSession, docs: DataFrame) -> DataFrame:
    found = written(spark, candidates(docs.select("doc_id", "text")).select("doc_id", "__p_c", "__p_h"), "candidates")
    listed = f"array_join(transform({{}}, c -> concat({_KIND}, ':', c.s, ':', c.e)), ',')"
    return choose(found, boost(found)).select(
        "doc_id",
        *(F.expr(f"cast(size(filter(__p_base, c -> c.k = {k})) as bigint)").alias(f"n_{KINDS[k]}") for k in range(BASE_KINDS)),
        F.sha2(F.expr(listed.format("__p_base")), 256).alias("base_sha256"),
        F.expr(listed.format("__p_all")).alias("spans"),
    )
