"""Quality rules: a threshold table compiled into one projection, without user functions.

Defined results: a null or blank text has no words, so the length rule rejects it. Rows are judged
one by one, so repeated rows, ties and null ids change nothing. Other columns pass through; working
columns start with `__q_` and are dropped again. An empty table gives an empty table. A text of any
length stays in its own row. 3-word windows are sorted by a part of their hash and confirmed word by
word; a text in which two different windows share that part is sorted by the windows themselves, so
counts are exact at any length.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import once

SYMBOLS = "#*$%&|<>"

#: Frequent function words of languages in Latin letters; texts in other letters are not held to them.
STOP_WORDS = (
    "the be to of and that have with a in is it for on as at by are was this from or an not you "
    "le la les un une de du des et est en que qui dans pour par sur il elle avec au ne se "
    "der die das und ist den von zu mit ein eine auf im für nicht dem sich "
    "el los las una del y es por con para lo su al como no "
    "di il che per non una sono gli della si anche ma ha nel "
    "os um uma em se da do dos das mais mas foi ao ele "
    "het een van dat niet op te zijn voor met er maar om hij ook "
    "na nie że jest od jak po co tak ale przez "
    "och att som det är av för inte han jag till men ett har "
    "og af til der ikke på jeg vi kan så hun den "
    "ja ei se että oli hän mutta kun niin ovat "
    "se je že do ale by si jsem tak "
    "bir ve bu da için ile çok ne daha gibi ama olarak "
    "și în cu nu mai din este pe care sau ca fi "
    "yang dan ini itu dari untuk dengan tidak akan ke ada"
).split()


@dataclass(frozen=True)
class Rule:
    """A document of min_words or more, with min_latin of its code points in words basic Latin letters,
    fails unless low <= metric <= high."""

    metric: str
    low: float | None = None
    high: float | None = None
    min_words: int = 0
    min_latin: float = 0.0

    def failed(self, metrics: dict[str, Column]) -> Column:
        value, out = metrics[self.metric], F.lit(False)
        if self.low is not None:
            out = out | (value < self.low)
        if self.high is not None:
            out = out | (value > self.high)
        if self.min_latin:
            out = out & (metrics["latin_ratio"] >= self.min_latin)
        return out & (metrics["n_words"] >= self.min_words) if self.min_words else out


#: They decide `base_failed`.
BASE_RULES = (Rule("n_words", low=50), Rule("repeat_ratio", high=0.5))
#: The method's own thresholds. All are ratios, so the length of a text does not matter.
RULES = (
    Rule("mean_word_chars", low=1.5, high=25.0),
    Rule("symbol_ratio", high=0.3),
    Rule("upper_ratio", high=0.6),
    Rule("dup_line_ratio", high=0.5),
    Rule("stop_ratio", low=0.01, min_words=100, min_latin=0.5),
)

#: Bits of a sorted window that hold its place; the others hold the upper bits of its hash.
PLACE_BITS = 31

#: Projections, in order: each uses what those before it made.
_STEPS = (
    {"__q_t": "coalesce({text}, '')"},
    {
        "__q_w": r"filter(split(btrim(__q_t, ' \t\n\u000b\u000c\r'), '[\\x20\\x09-\\x0D]+'), x -> x != '')",
        "__q_l": r"filter(split(__q_t, '\n'), x -> length(btrim(x, ' \t\n\u000b\u000c\r')) > 0)",
    },
    {"__q_n": "cast(size(__q_w) as bigint)", "__q_m": "{mask}L"},
    {"__q_p": "if(__q_n < 3, array(), sort_array(transform(sequence(0, cast(__q_n as int) - 3), i -> (xxhash64(get(__q_w, i), get(__q_w, i + 1), get(__q_w, i + 2)) & ~__q_m) | i)))"},
    {"__q_k": "transform(__q_p, (v, j) -> named_struct('at', cast(v & __q_m as int), 'near', j > 0 and (v & ~__q_m) = (get(__q_p, j - 1) & ~__q_m),"
              " 'same', j > 0 and (v & ~__q_m) = (get(__q_p, j - 1) & ~__q_m) and get(__q_w, cast(v & __q_m as int)) = get(__q_w, cast(get(__q_p, j - 1) & __q_m as int))"
              " and get(__q_w, cast(v & __q_m as int) + 1) = get(__q_w, cast(get(__q_p, j - 1) & __q_m as int) + 1)"
              " and get(__q_w, cast(v & __q_m as int) + 2) = get(__q_w, cast(get(__q_p, j - 1) & __q_m as int) + 2)))"},
    # Different windows under one part of a hash: all of the text's windows, sorted.
    {"__q_x": "if(exists(__q_k, k -> k.near and not k.same), array_sort(transform(sequence(0, cast(__q_n as int) - 3),"
              " i -> named_struct('s', concat_ws(' ', get(__q_w, i), get(__q_w, i + 1), get(__q_w, i + 2)), 'i', i))), cast(array() as array<struct<s:string,i:int>>))"},
    # Windows equal to the one before or after them, by place.
    {"__q_d": "sort_array(transform(filter(if(size(__q_x) = 0, transform(__q_k, (k, j) -> if(k.same or coalesce(get(__q_k, j + 1).same, false), k.at, -1)),"
              " transform(__q_x, (x, j) -> if(x.s = get(__q_x, j - 1).s or x.s = get(__q_x, j + 1).s, x.i, -1))), a -> a >= 0), a -> cast(a as bigint)))"},
    {
        "n_words": "__q_n",
        "word_chars": "aggregate(__q_w, 0L, (a, x) -> a + length(x))",
        "n_symbols": f"cast(length(__q_t) - length(translate(__q_t, '{SYMBOLS}', '')) as bigint)",
        "n_lines": "cast(size(__q_l) as bigint)",
        "n_dup_lines": "cast(size(__q_l) - size(array_distinct(__q_l)) as bigint)",
        "n_repeat_words": "aggregate(transform(__q_d, (a, j) -> least(3L, coalesce(get(__q_d, j + 1) - a, 3L))), 0L, (a, x) -> a + x)",
        "n_upper": "cast(length(__q_t) - length(translate(__q_t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')) as bigint)",
        "n_latin": "cast(length(__q_t) - length(translate(__q_t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz', '')) as bigint)",
        "n_stop": "cast(size(filter(__q_w, x -> lower(x) in ({stops}))) as bigint)",
    },
)
METRICS = tuple(_STEPS[-1])


def measure(docs: DataFrame, text: str = "text", into: str = "__q_metrics") -> DataFrame:
    """Add one struct column with the counts of METRICS."""
    names = {"text": f"`{text}`", "mask": (1 << PLACE_BITS) - 1, "stops": ", ".join(f"'{w}'" for w in STOP_WORDS)}
    for step in _STEPS[:-1]:
        docs = docs.withColumns({k: F.expr(v.format(**names)) for k, v in step.items()})
    fields = ", ".join(f"'{k}', {v.format(**names)}" for k, v in _STEPS[-1].items())
    return docs.withColumn(into, once(F.expr(f"named_struct({fields})"))).drop(*(k for s in _STEPS[:-1] for k in s))


def ratios(metrics: Column) -> dict[str, Column]:
    """What rules may name, from the struct of `measure`."""
    count = {k: metrics[k] for k in METRICS}
    over = lambda a, b: F.coalesce(count[a] / F.nullif(count[b], F.lit(0)), F.lit(0.0))
    return count | {
        "repeat_ratio": over("n_repeat_words", "n_words"),
        "mean_word_chars": over("word_chars", "n_words"),
        "symbol_ratio": over("n_symbols", "n_words"),
        "upper_ratio": over("n_upper", "word_chars"),
        "dup_line_ratio": over("n_dup_lines", "n_lines"),
        "stop_ratio": over("n_stop", "n_words"),
        "latin_ratio": over("n_latin", "word_chars"),
    }


def failed(metrics: Column, rules: tuple[Rule, ...]) -> Column:
    """The threshold table as one boolean expression."""
    values, out = ratios(metrics), F.lit(False)
    for rule in rules:
        out = out | rule.failed(values)
    return out


def judge(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents with the struct `__q_metrics` and the columns `__q_base_failed`, `__q_kept`."""
    out = measure(docs, text).withColumn("__q_base_failed", failed(F.col("__q_metrics"), BASE_RULES))
    return out.withColumn("__q_kept", ~F.col("__q_base_failed") & ~failed(F.col("__q_metrics"), rules))


def filter_documents(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents that pass, with the columns they came with."""
    return judge(docs, text, rules).where("__q_kept").select(*(F.col(f"`{c}`") for c in docs.columns))


def digest(docs: DataFrame) -> DataFrame:
    m = F.col("__q_metrics")
    return judge(docs.select("doc_id", "text")).select(
        "doc_id",
        *(m[k].alias(k) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
        F.col("__q_base_failed").alias("base_failed"),
        F.col("__q_kept").alias("kept"),
    )


#: DuckDB SQL for `digest`.
ORACLE = r"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS x FROM documents),
w AS (SELECT rid, doc_id, x, list_filter(string_split_regex(x, '[\x20\x09-\x0D]+'), lambda a: a <> '') AS w,
  list_filter(string_split(x, chr(10)), lambda a: regexp_matches(a, '[^\x20\x09-\x0D]')) AS l FROM t),
p AS (SELECT rid, unnest(range(1, len(w) - 1)) AS i, w FROM w WHERE len(w) >= 3),
g AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, w[i], w[i + 1], w[i + 2]) AS c FROM p),
r AS (SELECT rid, count(DISTINCT i + k) AS n FROM g, (SELECT unnest([0, 1, 2]) AS k) WHERE c > 1 GROUP BY rid),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda a: length(a))), 0)::BIGINT AS word_chars,
  (length(x) - length(translate(x, '#*$%&|<>', '')))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, len(l) AS n_lines,
  coalesce(n, 0)::BIGINT AS n_repeat_words, length(x) - length(translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')) AS n_upper,
  length(x) - length(translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz', '')) AS n_latin,
  len(list_filter(w, lambda a: list_contains([{stops}], lower(a)))) AS n_stop FROM w LEFT JOIN r USING (rid)),
v AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (word_chars < 1.5 * n_words OR word_chars > 25 * n_words OR n_symbols > 0.3 * n_words OR n_upper > 0.6 * word_chars
  OR n_dup_lines > 0.5 * n_lines OR (n_words >= 100 AND 2 * n_latin >= word_chars AND n_stop < 0.01 * n_words)) AS kept FROM v
""".format(stops=", ".join(f"'{w}'" for w in STOP_WORDS))
