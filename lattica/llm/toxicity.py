"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Words, their stems (the first STEM letters of longer words), pairs of neighbours and pairs with one word between are hashed into 2 ** BITS places; a place
that a text has counts once. FTRL-proximal keeps a rate for each coordinate, and its L1 term leaves
most weights at zero, so the model is a short list of places and weights, which is broadcast (at most
2 ** BITS of them). It is fitted on at most FIT_ROWS labelled ids, those with the least hash, one text for
each (that of least hash where an id has several), and of a text on at most FIT_PLACES of its places, those of
least hash under a seed from all of them. No row is left out for its size. Features are made on
the executors, and one task runs the epochs over the features of that bounded sample (FIT_ROWS * FIT_PLACES * 4
bytes at most). Scores are sums over all places of a text.

Defined results: null and empty texts have no feature and get the model's prior. Without labelled
rows the score is 0.5 everywhere. Documents labelled several times count as toxic if any label says
so. Repeated rows get equal scores and count once in the fit. A null id has no label and is not held out. Other columns do not
matter. Whole texts are read, of any length.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.common import prepare

BITS = 20
FIT_ROWS, FIT_PLACES = 20_000, 4096
EPOCHS = 4
ALPHA, BETA, L1, L2 = 1.0, 1.0, 8.0, 1.0
STEM = 5
THRESHOLD = 0.3
#: Words remembered in a worker, then forgotten together.
REMEMBERED = 500_000

_WORDS = re.compile(r"[^\W_]+").findall


class _Numbers(dict):
    """Hash of each word and of its stem, in two columns of `table`, by a number for the word."""

    def __init__(self):
        self.table = np.zeros((1 << 12, 2), dtype=np.uint64)

    def __missing__(self, word):
        k = self[word] = len(self)
        if k == len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        made = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"), 7)
        stem = xxhash.xxh64_intdigest(word[:STEM].encode("utf-8", "surrogatepass"), 11) if len(word) > STEM else made
        self.table[k] = made, stem
        return k


_numbers = _Numbers()


def places(text: str | None) -> np.ndarray:
    """Places of all words, stems, pairs and skip pairs of a text, repeats included."""
    words = _WORDS((text or "").lower())
    if len(_numbers) > REMEMBERED:
        _numbers.clear()
    at = np.fromiter(map(_numbers.__getitem__, words), dtype=np.int64, count=len(words))
    h, stems = _numbers.table[at].T
    with np.errstate(over="ignore"):
        left = h * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x632BE59BD9B4E019)
        pairs = [(left[:-k] ^ (h[k:] * np.uint64(2 * k + 1))) * np.uint64(0xBF58476D1CE4E5B9) for k in (1, 2) if len(h) > k]
    return np.concatenate([h, stems, *pairs]) >> np.uint64(64 - BITS)


def fit_places(text: str | None) -> np.ndarray:
    """The places of a text that a model is fitted on."""
    found = np.unique(places(text)).astype("<u4")
    if len(found) <= FIT_PLACES:
        return found
    seed = np.uint64(xxhash.xxh64_intdigest(found.tobytes(), 13))
    with np.errstate(over="ignore"):
        turn = (found.astype(np.uint64) ^ seed) * np.uint64(0x9E3779B97F4A7C15)
    return np.sort(found[np.argsort(turn ^ (turn >> np.uint64(32)), kind="stable")[:FIT_PLACES]])


def _features(batches):
    for batch in batches:
        made = [fit_places(x).tobytes() for x in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary()), *batch.columns[1:]], ["places", "toxic", "turn"])


def _ftrl(batches):
    rows = []
    for batch in batches:
        rows += [(np.frombuffer(x, "<u4"), y) for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
    size = 1 << BITS
    z, n = np.zeros(size + 1), np.zeros(size + 1)

    def weights(i):
        return -np.sign(z[i]) * np.maximum(np.abs(z[i]) - l1[i], 0) / ((BETA + np.sqrt(n[i])) / ALPHA + L2)

    l1 = np.full(size + 1, L1)
    l1[size] = 0.0  # the prior is not shrunk
    for _ in range(EPOCHS):
        for x, y in rows:
            i = np.append(x, size)
            w = weights(i)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y
            step = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA
            z[i] += g - step * w
            n[i] += g * g
    w = weights(np.arange(size + 1))
    keep = np.flatnonzero(w)
    yield pa.RecordBatch.from_arrays([pa.array(keep, pa.int64()), pa.array(w[keep])], ["place", "weight"])


def held_out(key: str = "doc_id") -> Column:
    """crc32 of the id as text leaves 2 when divided by 4."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> dict[int, float]:
    """Weights by place; the place 2 ** BITS is the prior."""
    prepare(spark)
    chosen = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = chosen.withColumn("turn", F.xxhash64("doc_id")).orderBy("turn", "doc_id").limit(rows)
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    one = sample.groupBy("doc_id", "toxic", "turn").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))  # at most `rows` rows
    made = one.select("text", "toxic", "turn").mapInArrow(_features, "places binary, toxic int, turn long")
    fitted = made.repartition(1).sortWithinPartitions("turn", "places").mapInArrow(_ftrl, "place long, weight double")
    return {r.place: r.weight for r in fitted.collect()}  # at most 2 ** BITS + 1 rows, few with L1


def score(spark: SparkSession, docs: DataFrame, weights: dict[int, float], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score)."""
    prepare(spark)
    size = 1 << BITS
    prior = weights.get(size, 0.0)
    model = spark.sparkContext.broadcast({k: v for k, v in weights.items() if k != size})

    def run(batches):
        from lattica.llm import toxicity

        table = np.zeros(size)
        table[np.array(list(model.value), dtype=np.int64)] = list(model.value.values())
        for batch in batches:
            out = []
            for x in batch.column(0).to_pylist():
                at = toxicity.places(x)
                at = np.unique(at[table[at] != 0])
                out.append(1 / (1 + np.exp(-np.clip(prior + table[at].sum(), -35, 35))))
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(out, pa.float64())], ["doc_id", "score"])

    schema = docs.select(F.col(key).alias("doc_id")).schema.add("score", "double")
    return docs.select(text, key).mapInArrow(run, schema)


def digest(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    docs = docs.select("doc_id", "text")
    scored = score(spark, docs, fit(spark, docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
