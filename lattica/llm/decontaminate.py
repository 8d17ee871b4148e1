"""Benchmark decontamination with a BM25 index of the test items and block-max pruning.

The items are indexed: postings with BM25 impacts, in blocks of items with the largest impact of each
term in a block. Every document is cut into passages that overlap by half, so that each item that a
document holds lies whole in one of them. A passage's terms are the query. Impacts are divided by the
score that a passage must reach for the item, so 1 is the threshold for all items. That score is the
least that a passage with OVERLAP of the item's shingles can have: a word that is missing takes a
shingle of its own with it (one that begins or ends with it), so at most as many words are missing as
shingles may be, or twice as many where shingles repeat; the dearest ones are taken off. A
passage is dropped when the largest impacts of its terms do not add up to 1; a block is skipped when
its largest impacts do not; items of the other blocks get their full scores, and all that reach 1 are
retrieved. Then the words are compared: a hit holds OVERLAP of the item's 5-word shingles, and of its
answer's where the benchmark names answers (else the answer counts as part of the question).

Numbers of items, their mean length and the items of each term are counted over the whole benchmark.
The index is cut by size: items are dealt into parts of about PART_BYTES of text, each broadcast
and searched in its own pass, so a larger benchmark costs passes, not memory, and changes no score.

Defined results: null and empty texts hold nothing; items without words are left out. A document with
an item several times gives one row for the item, with its best passage (the first of a tie).
Repeated rows are searched each. Null ids are returned as they are; other columns pass through
`clean`, whatever their names. Empty documents or an empty benchmark give no hit. Whole texts are
searched.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.llm.common import prepare, written

SHINGLE = 5
OVERLAP = 0.8
BLOCK = 16
PART_BYTES = 8 << 20
#: Passages for items of up to so many words, doubled for longer ones, are twice as long.
LEAST_SPAN = 64

_WORDS = re.compile(r"[^\W_]+").findall


def _shingles(ids: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit number for each run of n words."""
    count = len(ids) - n + 1
    out = np.zeros(max(count, 0), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            out = (out ^ (ids[k : k + count].astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9)
            out ^= out >> np.uint64(29)
    return out


class Index:
    """BM25 index of the items of one length class; idf by term, and the mean length, of all items."""

    def __init__(self, items: list, span: int, terms: dict[str, int], idf: np.ndarray, mean: float, k1: float = 1.2, b: float = 0.75):
        self.span, self.ids = span, [i for i, _, _ in items]
        words = [np.array([terms[w] for w in q], dtype=np.int64) for _, q, _ in items]
        size = np.array([len(w) for w in words], dtype=float)
        rows = [np.unique(w, return_counts=True) for w in words]
        own = [idf[t] * n * (k1 + 1) / (n + k1 * (1 - b + b * size[i] / mean)) for i, (t, n) in enumerate(rows)]
        self.question = [np.unique(_shingles(w, min(SHINGLE, len(w)))) for w in words]
        self.width = [min(SHINGLE, len(w)) for w in words]
        self.need = np.array([self._least(x, len(w) - k + 1, len(q)) for x, w, k, q in zip(own, words, self.width, self.question)])
        term = np.concatenate([t for t, _ in rows])
        item = np.repeat(np.arange(len(items)), [len(t) for t, _ in rows])
        impact = np.concatenate([x / need for x, need in zip(own, self.need)])
        order = np.lexsort((item, term))
        self.item, self.impact, term = item[order], impact[order], term[order]
        self.at = np.searchsorted(term, np.arange(len(terms) + 1))
        self.most = np.zeros(len(terms))
        np.maximum.at(self.most, term, self.impact)
        cell, where = np.unique(term * (len(items) // BLOCK + 1) + self.item // BLOCK, return_inverse=True)
        self.block_most = np.zeros(len(cell))
        np.maximum.at(self.block_most, where, self.impact)
        self.blocks = len(items) // BLOCK + 1
        self.block = cell % self.blocks
        self.block_at = np.searchsorted(cell // self.blocks, np.arange(len(terms) + 1))
        answers = [np.array([terms[w] for w in a], dtype=np.int64) for _, _, a in items]
        self.answer = [np.unique(_shingles(w, min(SHINGLE, len(w)))) if len(w) else None for w in answers]
        self.answer_width = [min(SHINGLE, len(w)) for w in answers]

    @staticmethod
    def _least(own: np.ndarray, shingles: int, distinct: int) -> float:
        """The least score of a passage that holds OVERLAP of the distinct shingles."""
        missing = int((1 - OVERLAP) * distinct + 1e-9) * (1 if shingles == distinct else 2)
        return float(np.sort(own)[: max(1, len(own) - missing)].sum())

    @staticmethod
    def _ranges(at: np.ndarray, terms: np.ndarray) -> np.ndarray:
        n = at[terms + 1] - at[terms]
        ends = np.cumsum(n)
        return np.repeat(at[terms] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)

    def search(self, ids: np.ndarray):
        """Hits (item, score, question overlap, answer overlap, first word) of a text's word ids; -1 is no term."""
        bound = np.append(self.most, 0.0)[ids]
        sums = np.concatenate([[0.0], np.cumsum(bound)])
        starts = np.arange(0, max(1, len(ids) - self.span), self.span)
        ends = np.minimum(starts + 2 * self.span, len(ids))
        for s, e in zip(*(x[sums[ends] - sums[starts] >= 1 - 1e-9] for x in (starts, ends))):
            terms = np.unique(ids[s:e])
            terms = terms[terms >= 0]
            if self.most[terms].sum() < 1 - 1e-9:
                continue
            r = self._ranges(self.block_at, terms)
            open_block = np.bincount(self.block[r], self.block_most[r], self.blocks) >= 1 - 1e-9
            if not open_block.any():
                continue
            r = self._ranges(self.at, terms)
            r = r[open_block[self.item[r] // BLOCK]]
            score = np.bincount(self.item[r], self.impact[r], len(self.ids))
            for i in np.flatnonzero(score >= 1 - 1e-9):
                q = np.isin(self.question[i], _shingles(ids[s:e], self.width[i])).mean()
                a = q if self.answer[i] is None else np.isin(self.answer[i], _shingles(ids[s:e], self.answer_width[i])).mean()
                if q >= OVERLAP and a >= OVERLAP:
                    yield i, float(score[i] * self.need[i]), float(q), float(a), int(s)


class Part:
    """The items of one part, by length class, with one table of terms. df: items of each term of
    their questions, in the whole benchmark of `count` items with `mean` words."""

    def __init__(self, items: list[tuple], df: dict[str, int], count: int, mean: float):
        split = [(i, _WORDS((q or "").lower()), _WORDS((a or "").lower())) for i, q, a in items]
        split = sorted((x for x in split if x[1]), key=lambda x: str(x[0]))
        self.terms = {w: k for k, w in enumerate(sorted({w for _, q, a in split for w in [*q, *a]}))}
        seen = np.array([df.get(w, 0) for w in self.terms], dtype=float)
        idf = np.log1p((count - seen + 0.5) / (seen + 0.5))
        classes: dict[int, list] = {}
        for x in split:
            span = LEAST_SPAN
            while span < max(len(x[1]), len(x[2])):
                span *= 2
            classes.setdefault(span, []).append(x)
        self.classes = [Index(x, span, self.terms, idf, mean) for span, x in sorted(classes.items())]

    def hits(self, text: str | None) -> dict:
        """Best hit of each item in a text: item_id -> (score, question, answer, first word)."""
        if not text or not self.terms:
            return {}
        get = self.terms.get
        ids = np.array([get(w, -1) for w in _WORDS(text.lower())], dtype=np.int64)
        out: dict = {}
        for index in self.classes:
            for i, *hit in index.search(ids):
                k = index.ids[i]
                if k not in out or (hit[1], hit[0]) > (out[k][1], out[k][0]):
                    out[k] = hit
        return out


def _terms(batches):
    """A row for each item and term of its question, and one without a term and with the words of the item."""
    for batch in batches:
        part, term, n = [], [], []
        for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words = _WORDS((text or "").lower())
            if words:
                own = sorted(set(words))
                part += [k] * (len(own) + 1)
                term += [None, *own]
                n += [len(words)] + [1] * len(own)
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(term, pa.string()), pa.array(n, pa.int64())], ["part", "term", "n"])


def parts(spark: SparkSession, bench: DataFrame, item: str = "item_id", question: str = "text", answer: str | None = None):
    """Broadcast parts of about PART_BYTES of text each, made one at a time."""
    size = F.coalesce(F.octet_length(question), F.lit(0)) + (F.coalesce(F.octet_length(answer), F.lit(0)) if answer else 0)
    n = -(-(bench.agg(F.sum(size)).first()[0] or 0) // PART_BYTES) or 1
    columns = [F.col(item), F.col(question), F.col(answer) if answer else F.lit(None).cast("string")]
    dealt = bench.select(F.pmod(F.xxhash64(item, question), F.lit(n)).cast("int").alias("__part"), *columns)
    terms = written(spark, dealt.select("__part", question).mapInArrow(_terms, "part int, term string, n long"), "terms")
    total = terms.where("term is null").agg(F.count("*").alias("n"), F.sum("n").alias("words")).first()
    df = written(spark, terms.where("term is not null").groupBy("term").agg(F.sum("n").alias("df")), "frequencies")
    for k in range(n):
        rows = dealt.where(F.col("__part") == k).drop("__part").collect()  # bounded by PART_BYTES, as are its terms
        own = df.join(terms.where(F.col("part") == k).select("term").distinct(), "term").collect()
        yield spark.sparkContext.broadcast(Part([tuple(r) for r in rows], {r.term: r.df for r in own}, total.n, (total.words or 0) / max(1, total.n)))


def search(spark: SparkSession, docs: DataFrame, bench: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", question: str = "text", answer: str | None = None) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap, first_word) of all hits; first_word
    is where the passage begins."""
    prepare(spark)
    schema = T.StructType([T.StructField("doc_id", docs.schema[key].dataType), T.StructField("item_id", bench.schema[item].dataType)])
    schema = schema.add("score", "double").add("question_overlap", "double").add("answer_overlap", "double").add("first_word", "long")

    def run_of(part):
        def run(batches):
            names = [f.name for f in schema]
            for batch in batches:
                found = [(k, i, *hit) for k, x in enumerate(batch.column(0).to_pylist()) for i, hit in part.value.hits(x).items()]
                cols = list(zip(*found)) or [()] * 6
                kinds = [pa.float64(), pa.float64(), pa.float64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([batch.column(1).take(pa.array(cols[0], pa.int64())), pa.array(cols[1], item_type), *map(pa.array, cols[2:], kinds)], names)

        return run

    from pyspark.sql.pandas.types import to_arrow_type

    item_type = to_arrow_type(bench.schema[item].dataType)
    rows = docs.select(text, key)
    out = [rows.mapInArrow(run_of(p), schema) for p in parts(spark, bench, item, question, answer)]
    for more in out[1:]:
        out[0] = out[0].unionByName(more)
    return out[0]


def clean(spark: SparkSession, docs: DataFrame, bench: DataFrame, text: str = "text", item: str = "item_id", question: str = "text", answer: str | None = None) -> DataFrame:
    """The documents that hold no item, with the columns they came with."""
    prepare(spark)
    column = docs.columns.index(text)

    def run_of(part):
        def run(batches):
            for batch in batches:
                yield batch.filter(pa.array([not part.value.hits(x) for x in batch.column(column).to_pylist()], pa.bool_()))

        return run

    for p in parts(spark, bench, item, question, answer):
        docs = docs.mapInArrow(run_of(p), docs.schema)
    return docs
