"""Quality classifier: importance resampling with hashed n-gram generative models.

Two bag-of-n-grams models are counted over BUCKETS hash buckets of words and word pairs: one over the
target texts and one over all raw texts. A document's log weight is the sum of log(target / raw) over
its n-grams. Adding standard Gumbel noise to the log weight and keeping the k largest keys draws k
documents one after another, each with a chance in proportion to its weight among those left. k is a
budget, KEEP of all documents, whatever their labels.

The target is a bounded sample: the texts of at most TARGET_ROWS rows labelled good, those with the
least hash of their id. Raw counts and statistics cover all documents. The k-th largest key is found
exactly by counting keys by their leading bits, 16 at a time, over the written keys: no sort, and no
more than 65,536 counts on the driver. Noise is a hash of id, checksum and seed, so runs repeat.

Defined results: null and blank texts have weight zero. Repeated rows share a key and are taken or
left together unless the cut falls among them; ties at the cut are settled by id, checksum and then
at random among equal rows. A null id takes part like any other. Other columns pass through `sample`. An empty
table, or one without labelled rows (all weights zero), is defined: the draw is then uniform.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.common import SPACE_CLASS, prepare, written

BUCKETS = 10_000
TARGET_ROWS = 20_000
#: Share of the documents that is drawn.
KEEP = 0.7
SEED = 17
REMEMBERED = 500_000

_WORDS = re.compile(f"[^{SPACE_CLASS[1:-1]}]+").findall


class _Hashes(dict):
    def __missing__(self, word):
        if len(self) >= REMEMBERED:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"), SEED)
        return h


_hashes = _Hashes()


def grams(text: str | None) -> np.ndarray:
    """Buckets of all words and pairs of a text; the case of A-Z counts, as shouting is a feature."""
    words = _WORDS(text or "")
    h = np.fromiter(map(_hashes.__getitem__, words), dtype=np.uint64, count=len(words))
    with np.errstate(over="ignore"):
        pairs = (h[:-1] * np.uint64(0x9E3779B97F4A7C15) ^ h[1:]) * np.uint64(0xBF58476D1CE4E5B9) if len(h) > 1 else h[:0]
    return (np.concatenate([h, pairs]) >> np.uint64(20)) % np.uint64(BUCKETS)


def models(spark: SparkSession, docs: DataFrame, target_ids: DataFrame) -> np.ndarray:
    """log(target / raw) by bucket; target_ids (doc_id) must be bounded."""
    prepare(spark)

    def count(batches):
        from lattica.llm import resample

        raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for text, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                got = np.bincount(resample.grams(text).astype(np.int64), minlength=BUCKETS)
                raw += got
                if wanted:
                    target += got
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BUCKETS)), pa.array(raw), pa.array(target)], ["bucket", "raw", "target"])

    marked = docs.select("doc_id", "text").join(F.broadcast(target_ids.select("doc_id").withColumn("wanted", F.lit(True))), "doc_id", "left").select("text", "wanted")
    rows = marked.mapInArrow(count, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect()  # BUCKETS rows
    raw, target = np.ones(BUCKETS), np.ones(BUCKETS)
    for r in rows:
        raw[r.bucket] += r.raw
        target[r.bucket] += r.target
    if not any(r.target for r in rows):
        return np.zeros(BUCKETS)
    return np.log(target / target.sum()) - np.log(raw / raw.sum())


def targets(labels: DataFrame, rows: int = TARGET_ROWS) -> DataFrame:
    good = labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    return good.withColumn("turn", F.xxhash64("doc_id")).orderBy("turn", "doc_id").limit(rows).select("doc_id")


def weigh(spark: SparkSession, docs: DataFrame, ratio: np.ndarray) -> DataFrame:
    """(doc_id, crc, n_grams, log_weight) of all documents."""
    prepare(spark)
    table = spark.sparkContext.broadcast(ratio)

    def run(batches):
        from lattica.llm import resample

        for batch in batches:
            n, weight = [], []
            for text in batch.column(1).to_pylist():
                g = resample.grams(text)
                n.append(len(g))
                weight.append(float(table.value[g.astype(np.int64)].sum()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(weight, pa.float64())], ["doc_id", "crc", "n_grams", "log_weight"])

    rows = docs.select("doc_id", "text", F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("crc"))
    schema = rows.select("doc_id", "crc").schema.add("n_grams", "long").add("log_weight", "double")
    return rows.mapInArrow(run, schema)


def keyed(weights: DataFrame, seed: Column | int = SEED) -> DataFrame:
    """Add gumbel_key, and rank_bits: a long that grows with the key, with ties settled by a hash."""
    seed = seed if isinstance(seed, Column) else F.lit(seed)
    u = (F.shiftrightunsigned(F.xxhash64(seed, "doc_id", "crc"), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
    out = weights.withColumn("gumbel_key", F.col("log_weight") - F.log(-F.log(u)))
    # 46 bits of the key in steps of 1e-5 (texts of 10^7 words fit) above 17 bits of a hash.
    step = F.greatest(F.lit(0), F.least(F.lit((1 << 46) - 1), F.floor((F.col("gumbel_key") + 350_000_000) * 100_000)))
    return out.withColumn("rank_bits", F.shiftleft(step.cast("long"), 17).bitwiseOR(F.shiftrightunsigned(F.xxhash64("crc", "doc_id", seed), 47)))


def cut(keys: DataFrame, k: int) -> tuple[int, int]:
    """The k-th largest rank_bits and how many rows of that very value belong to the k largest."""
    known, bits, left = 0, 63, k
    while bits > 0:
        take = min(16, bits)
        bits -= take
        here = keys.where(F.shiftrightunsigned("rank_bits", bits + take) == (known >> (bits + take)))
        counts = here.groupBy(F.shiftrightunsigned("rank_bits", bits).alias("v")).agg(F.count("*").alias("n")).collect()  # at most 65,536 rows
        for r in sorted(counts, key=lambda r: -r.v):
            if r.n >= left:
                known = r.v << bits
                break
            left -= r.n
    return known, left


def draw(spark: SparkSession, docs: DataFrame, labels: DataFrame, keep: float = KEEP) -> DataFrame:
    """(doc_id, crc, n_grams, log_weight, gumbel_key) of the drawn documents: keep of all, rounded up."""
    weights = weigh(spark, docs, models(spark, docs, targets(labels)))
    keys = keyed(written(spark, weights, "weights"))
    k = math.ceil(keep * keys.count())
    if not k:
        return keys.drop("rank_bits")
    edge, left = cut(keys, k)
    over = keys.where(F.col("rank_bits") > edge)
    even = keys.where(F.col("rank_bits") == edge).orderBy("doc_id", "crc").limit(left)  # rows equal in all 63 bits
    return over.unionByName(even).drop("rank_bits")


def digest(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    return draw(spark, docs.select("doc_id", "text"), labels).drop("crc")
