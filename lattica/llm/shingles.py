"""SimHash near-dedup of sets of word shingles, with an exact check: links at a Jaccard of at least 4/5.

Each text has a SimHash fingerprint of BITS bits of its set of 5-word shingles. Two texts are candidates when their
fingerprints differ in at most RADIUS bits, and linked when the sets then have a Jaccard of at least 4/5; groups are
the components of these links. Nothing is linked but by its fingerprint. RADIUS is so wide that no linked pair is
lost: at a Jaccard of 4/5 a bit differs with a chance below 0.19 (0.15 for long texts), so 48 of 256 bits are
expected at most and 96 lie 7.7 standard deviations off; bits of unrelated texts differ by halves.

Where candidates are looked for: the deletion variants of `simhash` on the first 64 bits join the near fingerprints.
No index of variants reaches the wide radius (its keys would have five bits), so the rest are looked for among texts
that share a rare shingle. No pair is missed there: shingles that only one text has cannot be common, and
with the others in one order for all texts (rare ones first), linked texts of which n shingles are
distinct share one of the first `shared - ceil(4 n / 5) + 1`. Texts with fewer than 4/5 of their
shingles shared drop out at once, so little is left of texts that have no near-copy.

Texts that meet in a variant or a shingle are chained to the smallest of them (a row a text, never a row a
pair), and each chain holds whole groups. A chain of up to BLOCK texts is walked in one task, where fingerprints are
compared and each candidate is checked. A longer one is parted by size class (linked texts are of one class or of neighbours)
and by hash into blocks, and each two blocks that can hold a link are walked together and give the spanning
forest of their links; groups are the components of all forests. So no task holds more than two blocks,
however many texts a common passage chains, and no link is lost.

Defined results: shingles are of the words of `simhash`, as 64-bit hashes; a text of 1 to 4 words is
one shingle. Texts with the same words are equal, and so are all blank and null ones, which have no
shingle. Texts are read whole, whatever their length.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.llm import simhash
from lattica.llm.common import prepare, written

WORDS = 5
#: Bits of a fingerprint, and how many of them may differ in a candidate.
BITS, RADIUS = 256, 96
#: Words and texts that a worker remembers; forgetting costs time only.
HELD = 150_000
#: Texts of a chain, or of a part of a longer one, that are walked together.
BLOCK = 512
#: Counts of texts from here on are alike in the order of shingles, so that no run of them is held whole.
COMMON = 100_000

_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xBF58476D1CE4E5B9], np.uint64)


class _Hashes(dict):
    def __missing__(self, word):
        h = self[word] = xxhash.xxh64_intdigest(word, 5)
        return h


_hashes = _Hashes()


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()


def identity(w: list[bytes]) -> tuple[bytes, int]:
    """128 bits of a text's words, and the first 64 as a signed number."""
    fp = xxhash.xxh3_128_digest(b" ".join(w))
    return fp, int.from_bytes(fp[:8], "big", signed=True)


def shingles(w: list[bytes]) -> np.ndarray:
    """Hashes of the distinct shingles, ascending."""
    if not w:
        return np.zeros(0, np.int64)
    if len(_hashes) > HELD:
        _hashes.clear()
    h, n = np.fromiter(map(_hashes.__getitem__, w), dtype=np.uint64, count=len(w)), min(len(w), WORDS)
    with np.errstate(over="ignore"):
        x = np.full(len(h) - n + 1, n, np.uint64)
        for k in range(n):
            x = (x ^ (x >> np.uint64(29)) ^ h[k : len(h) - n + 1 + k]) * _MIX[k]
    return np.unique((x ^ (x >> np.uint64(32))).view(np.int64))


def _printer(batches):
    from lattica.llm import shingles as own

    for batch in batches:
        got = [own.words(x) for x in batch.column(0).cast(pa.binary()).to_pylist()]
        fps = [own.identity(w) for w in got]
        sets = [own.shingles(w) for w in got]
        prints = [simhash.sketch(x, own.BITS // 64) for x in sets]
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array([f for f, _ in fps], pa.binary()), pa.array([k for _, k in fps], pa.int64()), pa.array([len(x) for x in sets], pa.int64()), pa.array(prints, pa.binary())], ["doc_id", "fp", "key", "n", "print"])


def _spread(batches):
    """A row a shingle; texts met before in the task are left out."""
    from lattica.llm import shingles as own

    met: set = set()
    for batch in batches:
        keys, found = [], []
        for text in batch.column(0).cast(pa.binary()).to_pylist():
            w = own.words(text)
            key = own.identity(w)[1]
            if key in met:
                continue
            if len(met) > HELD:
                met.clear()
            met.add(key)
            keys.append(key)
            found.append(own.shingles(w))
        if found:
            gram = np.concatenate(found)
            yield pa.RecordBatch.from_arrays([pa.array(gram), pa.array(np.repeat(np.array(keys, np.int64), [len(x) for x in found]))], ["gram", "key"])


def _shared(batches):
    """Rows of shingles that several texts have, with their number (COMMON at most); rows come sorted by shingle
    and key. A run is held until it ends or passes COMMON."""

    def out(gram, key, common=None):
        first = np.flatnonzero(np.r_[True, gram[1:] != gram[:-1]])
        size = np.diff(np.r_[first, len(gram)])
        many = np.minimum(np.repeat(size, size), COMMON)
        if common is not None:  # a run that goes on from before, or beyond
            many[gram == common] = COMMON
        keep = many > 1
        return pa.RecordBatch.from_arrays([pa.array(key[keep]), pa.array(gram[keep]), pa.array(many[keep].astype(np.int64))], ["key", "gram", "texts"])

    gram, key, common, last = np.zeros(0, np.int64), np.zeros(0, np.int64), None, None
    for batch in batches:
        g, k = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(2))
        once = np.r_[last is None or (g[:1] != last[0]) | (k[:1] != last[1]), (g[1:] != g[:-1]) | (k[1:] != k[:-1])].astype(bool) if len(g) else np.zeros(0, bool)
        if len(g):
            last = (g[-1], k[-1])
        gram, key = np.concatenate([gram, g[once]]), np.concatenate([key, k[once]])
        if len(gram) < 2 * COMMON:
            continue
        whole = np.searchsorted(gram, gram[-1])  # the last run may go on
        if whole:
            yield out(gram[:whole], key[:whole], common)
            gram, key, common = gram[whole:], key[whole:], None
        if len(gram) >= COMMON:
            common = gram[-1]
            yield out(gram, key, common)
            gram, key = gram[:0], key[:0]
    if len(gram):
        yield out(gram, key, common)


def walk(n: np.ndarray, lists: list[np.ndarray], prints: np.ndarray) -> np.ndarray:
    """The number of each text's group, by the links among texts with n shingles, of which lists are shared.
    prints: a row of 64-bit words a text; only texts within RADIUS bits are checked."""
    order = np.argsort(n, kind="stable")
    n, lists, prints = n[order], [lists[k] for k in order], prints[order]
    size = np.array([len(x) for x in lists])
    at = np.cumsum(size) - size
    values, flat = np.unique(np.concatenate(lists), return_inverse=True)
    mark, left, group = np.zeros(len(values), np.int64), np.ones(len(n), bool), np.zeros(len(n), np.int64)
    for start in range(len(n)):
        if not left[start]:
            continue
        left[start], group[start], front = False, start, [start]
        while front:
            x = front.pop()
            low, high = np.searchsorted(5 * n, 4 * n[x]), np.searchsorted(4 * n, 5 * n[x], "right")
            rest = low + np.flatnonzero(left[low:high])
            rest = rest[np.bitwise_count(prints[rest] ^ prints[x]).sum(1) <= RADIUS]
            if not len(rest):
                continue
            own = flat[at[x] : at[x] + size[x]]
            mark[own] = 1
            first = np.cumsum(size[rest]) - size[rest]
            both = np.add.reduceat(mark[flat[np.repeat(at[rest] - first, size[rest]) + np.arange(size[rest].sum())]], first)
            mark[own] = 0
            near = rest[5 * both >= 4 * (n[rest] + n[x] - both)]
            left[near], group[near] = False, start
            front.extend(near.tolist())
    out = np.zeros(len(n), np.int64)
    out[order] = group
    return out


def _walker(batches):
    """(node, root): each text and the smallest of its group; rows come sorted by chain."""
    from lattica.llm import shingles as own

    now, keys, sizes, lists, prints = None, [], [], [], []

    def done():
        key = np.array(keys, np.int64)
        group = own.walk(np.array(sizes, np.int64), lists, np.frombuffer(b"".join(prints), np.uint64).reshape(len(keys), -1))
        least = np.full(group.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, group, key)
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(least[group])], ["key", "least"])

    for batch in batches:
        grams, cuts = batch.column(3).values.to_numpy(zero_copy_only=False), batch.column(3).offsets.to_numpy()
        for k, (chain, key, n, fingerprint) in enumerate(zip(*(batch.column(c).to_pylist() for c in (0, 1, 2, 4)))):
            if chain != now:
                if keys:
                    yield done()
                now, keys, sizes, lists, prints = chain, [], [], [], []
            keys.append(key)
            sizes.append(n)
            prints.append(fingerprint)
            lists.append(grams[cuts[k] : cuts[k + 1]].copy())
    if keys:
        yield done()


def near(spark: SparkSession, few: DataFrame) -> DataFrame:
    """(a, b): keys that connect all whose fingerprints are within the radius of the index of deletion variants."""
    config = simhash.Config(words=WORDS, repeats=False)
    prints = few.select(F.substring("print", 1, config.bits // 8).alias("fp"), "key")
    firsts = prints.groupBy("fp").agg(F.min("key").alias("first"))
    equal = prints.join(firsts, "fp").select(F.col("first").alias("a"), F.col("key").alias("b"))
    own = lambda c: firsts.select(F.col("fp").alias(c), F.col("first").alias(f"first_{c}"))
    links = simhash.links(spark, firsts.select("fp"), config).join(own("a"), "a").join(own("b"), "b")
    return equal.unionByName(links.select(F.least("first_a", "first_b").alias("a"), F.greatest("first_a", "first_b").alias("b")))


def roots(spark: SparkSession, docs: DataFrame, sizes: DataFrame, text: str = "text") -> DataFrame:
    """(key, least): the smallest key of the group, for texts that may have a near-copy."""
    rows = docs.select(text).mapInArrow(_spread, "gram long, key long")
    shared = rows.repartition("gram").sortWithinPartitions("gram", "key").mapInArrow(_shared, "key long, gram long, texts long")
    lists = shared.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("texts", "gram"))).alias("x"))
    need = F.expr("(4 * n + 4) div 5")
    few = lists.join(sizes, "key").where(F.size("x") >= need)
    few = few.select("key", "n", "print", F.col("x.gram").alias("grams"), (F.size("x") - need + 1).cast("int").alias("reach"))
    few = written(spark, few, "shingles")
    meet = few.select("key", F.explode(F.slice("grams", F.lit(1), F.col("reach"))).alias("gram"))
    least = meet.groupBy("gram").agg(F.min("key").alias("a"))
    met = meet.join(least, "gram").select("a", F.col("key").alias("b")).unionByName(near(spark, few))
    chains = simhash.components(spark, met.where("a < b").distinct())
    chains = chains.select(F.col("node").alias("key"), "root").unionByName(chains.select(F.col("root").alias("key"), "root")).distinct()
    chains = written(spark, few.select("key", F.floor(F.log(F.col("n").cast("double")) / math.log(1.26)).cast("int").alias("class")).join(chains, "key"), "chains")
    blocks = chains.groupBy("root", "class").agg(F.count("*").alias("n")).groupBy("root").agg(F.sum("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("class", F.ceil(F.col("n") / BLOCK).cast("int")))).alias("blocks"))
    walked = lambda df: df.repartition("chain").sortWithinPartitions("chain").mapInArrow(_walker, "key long, least long")
    short = chains.join(blocks.where(F.col("n") <= BLOCK).select("root"), "root").select("key", F.col("root").alias("chain"))
    short = walked(few.join(short, "key").select("chain", "key", "n", "grams", "print"))
    # Two blocks of a class, or of neighbours: a text goes to each pair that its block is in.
    own = F.pmod(F.xxhash64("key"), F.col("blocks")[F.col("class")]).cast("int")
    places = lambda c: F.when(F.coalesce(F.col("blocks")[c], F.lit(0)) > 0, F.sequence(F.lit(0), F.col("blocks")[c] - 1)).otherwise(F.array().cast("array<int>"))
    c, i = F.col("class"), F.col("__own")
    pairs = F.concat(
        F.transform(places(c), lambda j: F.xxhash64("root", c, F.least(i, j), c, F.greatest(i, j))),
        F.transform(places(c + 1), lambda j: F.xxhash64("root", c, i, c + 1, j)),
        F.transform(places(c - 1), lambda j: F.xxhash64("root", c - 1, j, c, i)),
    )
    long_ = chains.join(blocks.where(F.col("n") > BLOCK), "root").withColumn("__own", own).select("key", F.explode(pairs).alias("chain"))
    forest = walked(few.join(long_, "key").select("chain", "key", "n", "grams", "print"))
    whole = simhash.components(spark, forest.where("least < key").select(F.col("least").alias("a"), F.col("key").alias("b")).distinct())
    return short.unionByName(whole.select(F.col("node").alias("key"), F.col("root").alias("least")))


def groups(spark: SparkSession, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp, component_id): one row per document."""
    prepare(spark)
    schema = T.StructType([T.StructField("doc_id", docs.schema[key].dataType), T.StructField("fp", T.BinaryType()), T.StructField("key", T.LongType()), T.StructField("n", T.LongType()), T.StructField("print", T.BinaryType())])
    prints = written(spark, docs.select(text, key).mapInArrow(_printer, schema), "fingerprints")
    found = roots(spark, docs, prints.select("key", "n", "print").distinct(), text)
    firsts = written(spark, prints.groupBy("fp", "key").agg(F.min("doc_id").alias("first")), "distinct")
    named = firsts.join(found, "key", "left").select("fp", "first", F.coalesce("least", "key").alias("root"))
    return simhash.named(spark, prints.select("doc_id", "fp"), named)
