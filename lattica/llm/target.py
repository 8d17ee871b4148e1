"""Importance resampling towards a target text: array-scored weights, sorted runs, tournament trees.

Every word of a text is a feature; its bucket is the CRC-32 of its bytes modulo BUCKETS. Counts of the
buckets over all documents and over all target texts are summed in each task first, so BUCKETS rows
reach the driver, whatever the input; from them comes one array of gains, which is broadcast (BUCKETS
numbers). A document's weight is the sum of the gains at its features, looked up in that array, and
its score adds Gumbel noise drawn from a hash of the id.

The draw is an external merge. Each task sorts its eligible documents into a run and writes it. Runs
are cut into bands by score (range partitioning, a sampled split that decides balance alone), so that
a band is one task's whatever the number of runs, and documents with one score spread by id and row.
Bands are written and counted; the counts tell in which band the last drawn document lies. Each band
down to that one merges its slices of the runs with a tournament tree, a slice at a time in memory and
spilled by Spark's sort before; the last band stops at the exact number. A rank is the number of
documents in earlier bands and the place within the band, so nothing is sorted or numbered in one task.

Defined results: null and blank texts have no features and weight 0, and are not eligible. A null id
draws as an empty one and comes after all ids in ties. Repeated rows are scored and ranked like
different ones, one after another. Other columns pass through `draw`, apart from those named as its results,
which are replaced. An empty table gives an empty table; empty target texts give gains from documents alone.
Scores fit a long for texts of up to 10^14 words.
"""

from __future__ import annotations

import math
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.llm.common import discard, prepare, written

BUCKETS = 10_000
SEED = 2024
LEAST_WORDS = 20
#: Per cent of the eligible documents that is drawn.
DRAW = 10
#: Eligible documents to a band of the merge.
BAND_ROWS = 200_000
REMEMBERED = 500_000

_WORDS = re.compile(rb"[0-9a-z\x80-\xff]+").findall


class _Buckets(dict):
    def __missing__(self, word):
        if len(self) >= REMEMBERED:
            self.clear()
        b = self[word] = zlib.crc32(word) % BUCKETS
        return b


_buckets = _Buckets()


def features(text: str | None) -> np.ndarray:
    """Buckets of all words, A-Z in lower case; bytes.lower changes those letters alone."""
    words = _WORDS((text or "").encode().lower())
    return np.fromiter(map(_buckets.__getitem__, words), np.int64, len(words))


def counts(texts: DataFrame) -> np.ndarray:
    """Features by bucket over all rows."""

    def run(batches):
        from lattica.llm import target

        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                found = target.features(text)
                if len(found) < BUCKETS // 8:
                    np.add.at(total, found, 1)
                else:
                    total += np.bincount(found, minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    out = np.zeros(BUCKETS, np.int64)
    for r in texts.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most BUCKETS rows
        out[r.bucket] = r.n
    return out


def gains(raw: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of the smoothed ratio of shares, a long a bucket."""
    raw_all, wanted_all = float(raw.sum()) + BUCKETS, float(wanted.sum()) + BUCKETS
    return np.array([math.floor(1000 * math.log((t + 1.0) * raw_all / ((s + 1.0) * wanted_all))) for s, t in zip(raw.tolist(), wanted.tolist())], np.int64)


MADE = ["n_features", "weight", "score"]


def score(spark: SparkSession, docs: DataFrame, gain: np.ndarray, seed: int = SEED) -> DataFrame:
    """All columns of docs, and n_features, weight and score."""
    prepare(spark)
    table = spark.sparkContext.broadcast(gain)

    def run(batches):
        from lattica.llm import target

        for batch in batches:
            n, weight = [], []
            for text in batch.column(0).to_pylist():
                found = target.features(text)
                n.append(len(found))
                weight.append(int(table.value[found].sum()))
            noise = [math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))) for h in batch.column(1).to_pylist()]
            made = [pa.array(n, pa.int64()), pa.array(weight, pa.int64()), pa.array([w + x for w, x in zip(weight, noise)], pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], *made], [*batch.schema.names[2:], *MADE])

    kept = [c for c in docs.columns if c not in MADE]
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    schema = T.StructType([docs.schema[c] for c in kept])
    for name in MADE:
        schema = schema.add(name, "long")
    return docs.select(F.coalesce("text", F.lit("")).alias("__i_text"), h.alias("__i_h"), *kept).mapInArrow(run, schema)


class Tournament:
    """The smallest of the heads of k sorted runs, again and again: each node of the tree keeps the
    loser of its match, so the next winner takes one match a level."""

    def __init__(self, runs: list[list[tuple]]):
        self.runs, self.at = runs, [0] * len(runs)
        self.leaves = 1 << max(0, len(runs) - 1).bit_length()
        self.losers = [-1] * self.leaves
        self.winner = self._play(1)

    def _head(self, run: int):
        """None, which loses against all, when a run is used up."""
        return self.runs[run][self.at[run]] if 0 <= run < len(self.runs) and self.at[run] < len(self.runs[run]) else None

    def _first(self, a: int, b: int) -> tuple[int, int]:
        x, y = self._head(a), self._head(b)
        return (a, b) if y is None or (x is not None and x <= y) else (b, a)

    def _play(self, node: int) -> int:
        if node >= self.leaves:
            return node - self.leaves
        won, self.losers[node] = self._first(self._play(2 * node), self._play(2 * node + 1))
        return won

    def __iter__(self):
        return self

    def __next__(self):
        run = self.winner
        out = self._head(run)
        if out is None:
            raise StopIteration
        self.at[run] += 1
        node = (run + self.leaves) // 2
        while node:
            run, self.losers[node] = self._first(run, self.losers[node])
            node //= 2
        self.winner = run
        return out


def _merge(first: dict, total: int):
    """Ranks of rows that come by band, run and place: columns band, run, key score, key id, then the others."""

    def ranked(band, columns):
        runs, starts = [], np.flatnonzero(np.diff(columns[1].to_numpy(), prepend=-1))
        ids = columns[3].to_pylist()
        keys = [(-s, i is None, i if i is not None else 0, k) for k, (s, i) in enumerate(zip(columns[2].to_pylist(), ids))]
        for a, b in zip(starts, [*starts[1:], len(keys)]):
            runs.append(keys[a:b])
        rank, left = np.zeros(len(keys), np.int64), total - first[band]
        for place, key in enumerate(Tournament(runs), 1):
            if place > left:  # the exact draw count
                break
            rank[key[3]] = first[band] + place
        return pa.array(rank, mask=rank == 0)

    def whole(batches):
        """One table a band."""
        held, now = [], None
        for batch in batches:
            bands = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(bands)) + 1).tolist(), len(bands)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if held and bands[a] != now:
                    yield now, pa.Table.from_batches(held)
                    held = []
                now = int(bands[a])
                held.append(batch.slice(a, b - a))
        if held:
            yield now, pa.Table.from_batches(held)

    def run(batches):
        for band, rows in whole(batches):
            rows = rows.combine_chunks()
            out = pa.Table.from_arrays([*rows.columns[4:], ranked(band, rows.columns)], [*rows.column_names[4:], "rank"])
            yield from out.combine_chunks().to_batches()

    return run


def draw(spark: SparkSession, docs: DataFrame, target: DataFrame, percent: int = DRAW, least_words: int = LEAST_WORDS, seed: int = SEED, band_rows: int = BAND_ROWS) -> DataFrame:
    """All columns of docs but the text, and n_features, weight, score and rank (null where not drawn)."""
    prepare(spark)
    gain = gains(counts(docs), counts(target))
    kept = [c for c in docs.columns if c not in (*MADE, "rank", "text")]
    scored = score(spark, docs.select("text", *kept), gain, seed).drop("text")
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    runs = scored.withColumn("__i_run", F.spark_partition_id()).sortWithinPartitions(F.col("n_features") < least_words, *order)
    runs = written(spark, runs.withColumn("__i_place", F.monotonically_increasing_id()), "runs")
    eligible, others = runs.where(F.col("n_features") >= least_words), runs.where(F.col("n_features") < least_words)
    n = eligible.count()
    total = n * percent // 100
    names = [*kept, *MADE]
    none = F.lit(None).cast("long").alias("rank")
    if not total:
        return runs.select(*names, none)
    bands = max(-(-n // band_rows), min(n, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    banded = eligible.repartitionByRange(bands, *order, "__i_place").withColumn("__i_band", F.spark_partition_id())
    banded = written(spark, banded, "bands")
    first, before = {}, 0
    for r in sorted(banded.groupBy("__i_band").count().collect()):  # a row a band
        if before < total:
            first[r[0]] = before
        before += r[1]
    last = max(first)
    columns = ["__i_band", "__i_run", F.col("score").alias("__i_score"), F.col("doc_id").alias("__i_id"), *names]
    taken = banded.where(F.col("__i_band") <= last).repartition(len(first), "__i_band").sortWithinPartitions("__i_band", "__i_run", "__i_place").select(*columns)
    schema = T.StructType([banded.schema[c] for c in names]).add("rank", "long")
    ranked = taken.mapInArrow(_merge(first, total), schema)
    return ranked.unionByName(banded.where(F.col("__i_band") > last).select(*names, none)).unionByName(others.select(*names, none))


def digest(spark: SparkSession, docs: DataFrame, target: DataFrame) -> DataFrame:
    return draw(spark, docs.select("doc_id", "text"), target).select("doc_id", "n_features", "weight", "score", "rank")


ORACLE = r"""
WITH RECURSIVE steps AS (
  SELECT i, i AS c, 0 AS k FROM (SELECT unnest(range(256)) AS i)
  UNION ALL SELECT i, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, k + 1 FROM steps WHERE k < 8
), crc AS (
  SELECT list(c ORDER BY i) AS entry FROM steps WHERE k = 8
), found AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), wanted AS (
  SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark
), raw AS (
  SELECT w, count(*) AS s FROM (SELECT unnest(w) AS w FROM found) GROUP BY w
), goal AS (
  SELECT w, count(*) AS t FROM wanted GROUP BY w
), words AS (
  SELECT w, coalesce(s, 0) AS s, coalesce(t, 0) AS t, hex(encode(w)) AS x FROM raw FULL JOIN goal USING (w)
), hashed AS (
  SELECT w, s, t, xor(list_reduce(list_transform(range(length(x) // 2), lambda k: ('0x' || substr(x, CAST(2 * k + 1 AS BIGINT), 2))::BIGINT), lambda a, b: xor(a // 256, crc.entry[xor(a % 256, b) + 1]), 4294967295), 4294967295) % 10000 AS b
  FROM words, crc
), buckets AS (
  SELECT b, sum(s) AS s, sum(t) AS t FROM hashed GROUP BY b
), totals AS (
  SELECT coalesce(sum(s), 0) AS sa, coalesce(sum(t), 0) AS ta FROM buckets
), gain AS (
  SELECT b, CAST(floor(1000 * ln((t + 1.0::DOUBLE) * (sa + 10000)::DOUBLE / ((s + 1.0::DOUBLE) * (ta + 10000)::DOUBLE))) AS BIGINT) AS g FROM buckets, totals
), gained AS (
  SELECT w, g FROM hashed JOIN gain USING (b)
), numbered AS (
  SELECT row_number() OVER () AS r, doc_id, w FROM found
), weights AS (
  SELECT r, CAST(sum(g) AS BIGINT) AS weight FROM (SELECT r, unnest(w) AS w FROM numbered) JOIN gained USING (w) GROUP BY r
), scored AS (
  SELECT r, doc_id, CAST(len(w) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
  FROM numbered LEFT JOIN weights USING (r)
), ranked AS (
  SELECT r, row_number() OVER (ORDER BY score DESC, doc_id) AS k, count(*) OVER () AS n FROM scored WHERE n_features >= 20
)
SELECT doc_id, n_features, weight, score, CASE WHEN k <= n * 10 // 100 THEN k END AS rank FROM scored LEFT JOIN ranked USING (r)
"""
