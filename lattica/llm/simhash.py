"""SimHash near-dedup by deletion-variant signatures.

A fingerprint is cut into so few segments that, among those within `max_bits`, two always agree in
one segment up to one bit: (max_bits + 1) // 2 segments. Each segment gives one variant for every
place of a wildcard; fingerprints that share a variant (an equality join on one long) are compared.

Only distinct fingerprints are indexed, so copies cost nothing here. A variant shared by many is
never expanded into pairs: its members are walked as a graph, and each keeps one link to the member
that reached it (a spanning forest of the true links, so components are exact). Components come from
alternating star contractions over tables in the shared folder; nothing is gathered on the driver
but counts.

Defined results: null or blank texts have fingerprint zero and are linked like any other. Repeated
rows and equal texts fall together; of a tie the smallest doc_id names the group. A null doc_id is
kept, but never names a group that has another. Other columns pass through; an empty table gives an
empty table. Texts are read whole, whatever their length.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.llm.common import discard, prepare, written

#: Members of a variant that are compared pair by pair; larger ones are walked.
DIRECT = 32


@dataclass(frozen=True)
class Config:
    """words: shingle length; repeats: whether a repeated shingle counts again; bits: 64 or 128."""

    words: int = 3
    repeats: bool = True
    bits: int = 64
    max_bits: int = 3

    @property
    def segments(self) -> list[tuple[int, int]]:
        """(first bit, length) of each segment, counted from the highest bit."""
        m = (self.max_bits + 2) // 2
        cuts = [self.bits * k // m for k in range(m + 1)]
        return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _fingerprinter(config: Config):
    n = config.words
    lanes = config.bits // 64

    def run(batches):
        digest = xxhash.xxh64_intdigest
        for batch in batches:
            out = []
            for text in batch.column(0).cast(pa.binary()).to_pylist():
                w = (text or b"").lower().split()  # of bytes: A-Z, and the white space of the word rule
                if len(w) > n:
                    s = map(b" ".join, zip(*(w[i:] for i in range(n))))
                    s = list(s if config.repeats else set(s))
                else:
                    s = [b" ".join(w)] if w else []
                if not s:
                    out.append(bytes(8 * lanes))
                    continue
                got = b""
                for lane in range(lanes):
                    total = np.zeros(64, dtype=np.int64)
                    for at in range(0, len(s), 65536):
                        part = s[at : at + 65536]
                        h = np.fromiter((digest(x, 42 + lane) for x in part), dtype=">u8", count=len(part))
                        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
                    got += np.packbits(2 * total > len(s)).tobytes()
                out.append(got)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(out, pa.binary())], ["doc_id", "fp"])

    return run


def sketch(hashes: np.ndarray, lanes: int) -> bytes:
    """The fingerprint of 64 bits a lane of a set of 64-bit hashes: a bit is 1 if set in over half of them, each
    lane by a mix of its own. Of no hashes it is zero."""
    total = np.zeros((lanes, 64), np.int64)
    seeds = np.arange(1, lanes + 1, dtype=np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15)
    for at in range(0, len(hashes), 65536):
        with np.errstate(over="ignore"):
            x = (hashes[at : at + 65536].view(np.uint64) + seeds) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
        x = (x ^ (x >> np.uint64(29))).astype(">u8")
        total += np.unpackbits(x.view(np.uint8).reshape(lanes, -1, 8), axis=2).sum(1, dtype=np.int64)
    return np.packbits(2 * total > len(hashes)).tobytes()


def fingerprints(spark: SparkSession, docs: DataFrame, config: Config, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp): the key as it is and the fingerprint as 8 or 16 bytes, highest bit first."""
    prepare(spark)
    schema = T.StructType([T.StructField("doc_id", docs.schema[key].dataType), T.StructField("fp", T.BinaryType())])
    return docs.select(text, key).mapInArrow(_fingerprinter(config), schema)


def _linker(config: Config):
    """Links within runs of equal variants; rows come sorted by variant."""
    lanes = config.bits // 64

    def distance(a, b):
        return np.bitwise_count(a ^ b).sum(axis=-1)

    def links(keys, fps):
        """Index pairs: all true links in short runs, a spanning forest in long ones."""
        n = len(keys)
        start = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        size = np.diff(np.r_[start, n])
        left = np.repeat(size, size) - (np.arange(n) - np.repeat(start, size)) - 1  # members after this one
        left[np.repeat(size, size) > DIRECT] = 0
        found = []
        for d in range(1, min(DIRECT, int(left.max(initial=0)) + 1)):
            i = np.flatnonzero(left >= d)
            i = i[distance(fps[i], fps[i + d]) <= config.max_bits]
            found.append(np.stack([i, i + d], 1))
        for at, count in zip(start[size > DIRECT], size[size > DIRECT]):
            rest = np.arange(at, at + count)
            while len(rest):
                front, rest = [rest[0]], rest[1:]
                while front and len(rest):
                    x = front.pop()
                    near = distance(fps[rest], fps[x]) <= config.max_bits
                    if near.any():
                        found.append(np.stack([np.full(near.sum(), x), rest[near]], 1))
                        front.extend(rest[near])
                        rest = rest[~near]
        return np.concatenate(found) if found else np.zeros((0, 2), dtype=np.int64)

    def run(batches):
        held_k, held_f = np.zeros(0, np.int64), np.zeros((0, lanes), np.uint64)

        def joined(k, f, parts):
            more = np.frombuffer(b"".join(x for _, p in parts for x in p), dtype=">u8").reshape(-1, lanes).astype(np.uint64)
            return np.concatenate([k, *(p for p, _ in parts)]), np.concatenate([f, more])

        def emit(k, f):
            seen = links(k, f)
            a, b = f[seen[:, 0]].astype(">u8").tobytes(), f[seen[:, 1]].astype(">u8").tobytes()
            w = 8 * lanes
            cut = lambda x: pa.array([x[i : i + w] for i in range(0, len(x), w)], pa.binary())
            return pa.RecordBatch.from_arrays([cut(a), cut(b)], ["a", "b"])

        parts, count = [], 0
        for batch in batches:
            parts.append((batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist()))
            count += batch.num_rows
            if count < 200_000:
                continue
            held_k, held_f = joined(held_k, held_f, parts)
            parts, count = [], 0
            whole = np.searchsorted(held_k, held_k[-1])  # the last run may go on
            if whole:
                yield emit(held_k[:whole], held_f[:whole])
                held_k, held_f = held_k[whole:], held_f[whole:]
        held_k, held_f = joined(held_k, held_f, parts)
        if len(held_k):
            yield emit(held_k, held_f)

    return run


def variants(fps: DataFrame, config: Config) -> DataFrame:
    """(variant, fp): segment number, wildcard place and the segment's other bits in one long."""
    segments = config.segments
    width = max(n for _, n in segments)
    assert width <= 48, "a segment must leave room for its number and the wildcard's place"
    lane = {k: F.conv(F.substring(F.hex("fp"), 16 * k + 1, 16), 16, -10).cast("long") for k in range(config.bits // 64)}
    cols = []
    for first, n in segments:  # value of the segment, which may lie across two lanes
        k, off = divmod(first, 64)
        take = min(n, 64 - off)
        value = F.shiftrightunsigned(F.shiftleft(f"__v_{k}", off), 64 - take)
        if take < n:
            value = F.shiftleft(value, n - take).bitwiseOR(F.shiftrightunsigned(F.col(f"__v_{k + 1}"), 64 - (n - take)))
        cols.append(value)
    base = fps.select("fp", *(v.alias(f"__v_{k}") for k, v in lane.items())).select("fp", F.array(*cols).alias("values"))
    out = base.select("fp", F.posexplode("values").alias("seg", "value"))
    sizes = F.array(*(F.lit(n) for _, n in segments))
    out = out.select("fp", "seg", "value", F.explode(F.sequence(F.lit(0), F.get(sizes, F.col("seg")) - 1)).alias("at"))
    masked = F.expr(f"value & ~shiftleft(1L, at)")
    return out.select(F.expr(f"shiftleft(cast(seg * 64 + at as bigint), {width})").bitwiseOR(masked).alias("variant"), "fp")


def links(spark: SparkSession, fps: DataFrame, config: Config) -> DataFrame:
    """(a, b), a < b: links between distinct fingerprints that connect all that are within max_bits."""
    # Small rows: long batches are safe here.
    rows = variants(fps, config).repartition("variant").sortWithinPartitions("variant")
    return rows.mapInArrow(_linker(config), "a binary, b binary").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable, for every node that has an edge."""
    edges = written(spark, edges.select("a", "b").where("a < b"), "edges")
    before = None
    while True:
        # Large star: neighbours larger than a node go to its smallest neighbour.
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a != b").distinct()
        # Small star: smaller neighbours of a node, and it itself, go to the smallest of them.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("x"), F.col("m")).where("x != m").unionByName(least.select(F.col("a").alias("x"), "m"))
        past, edges = edges, written(spark, small.select(F.col("m").alias("a"), F.col("x").alias("b")).distinct(), "edges")
        discard(past)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
        before = now


def named(spark: SparkSession, prints: DataFrame, roots: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) from (doc_id, fp) and (fp, first, root): a root's smallest doc_id names it."""
    roots = written(spark, roots, "roots")
    best = roots.groupBy("root").agg(F.min("first").alias("component_id"))
    class_of = roots.join(best, "root").select("fp", "component_id")
    return prints.join(class_of, "fp").select("doc_id", "fp", "component_id")


def groups(spark: SparkSession, docs: DataFrame, config: Config = Config(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp, component_id): one row per document."""
    prints = written(spark, fingerprints(spark, docs, config, key, text), "fingerprints")
    firsts = written(spark, prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    roots = components(spark, links(spark, firsts.select("fp"), config))
    return named(spark, prints, firsts.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root")))


def deduplicate(spark: SparkSession, docs: DataFrame, config: Config = Config(), key: str = "doc_id", text: str = "text", grouped=None) -> DataFrame:
    """One row of each group (of `groups`, or of `grouped`), with the columns it came with: the row with the smallest key, of equal
    keys the smallest checksums (128 bits) and length, and of rows equal in all of these any one."""
    whole, size = F.coalesce(F.col(f"`{text}`"), F.lit("")), F.coalesce(F.octet_length(f"`{text}`"), F.lit(-1))
    row = F.struct(F.col(f"`{key}`").isNull().alias("o"), F.col(f"`{key}`").alias("k"), F.xxhash64(whole).alias("c"), F.xxhash64(F.lit(1), whole).alias("d"), size.alias("n"))
    name = lambda x: F.concat_ws(":", F.coalesce(x["k"].cast("string"), F.lit("-")), x["c"], x["d"], x["n"])
    rows = docs.select(row.alias("doc_id"), F.col(f"`{text}`").alias("text"))
    found = grouped(spark, rows) if grouped else groups(spark, rows, config)
    found = written(spark, found.select(name(F.col("doc_id")).alias("__d_key"), (~F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("goes")), "decided")
    left = docs.withColumn("__d_key", name(row)).join(found.where("goes").select("__d_key").distinct(), "__d_key", "left_anti")
    many = written(spark, found.where("not goes").groupBy("__d_key").count().where("count > 1").select("__d_key"), "repeated")
    if not many.isEmpty():  # repeated rows, which no key tells apart
        turn = Window.partitionBy("__d_key").orderBy("__d_key")
        one = left.join(many, "__d_key", "left_semi").withColumn("__d_turn", F.row_number().over(turn)).where("__d_turn = 1").drop("__d_turn")
        left = left.join(many, "__d_key", "left_anti").unionByName(one)
    return left.select(*(F.col(f"`{c}`") for c in docs.columns))


def digest(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return groups(spark, docs.select("doc_id", "text")).select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")
