"""LM scoring with a log-frequency Bloom filter.

A bigram model of words (texts end with an end token) is held in Bloom filters of quantised counts:
level i holds every n-gram with a count of at least 2 ** i, so a count is read by probing levels
upwards until one says no. Filters are dealt into parts whose number grows with the corpus, and no
part leaves its worker: all bigrams of a text go to their parts once, where those that train are
counted, filters of all levels are made and probed for all bigrams, and the sums of each text go back.
No level, word or bigram is left out, and nothing that grows with the vocabulary is broadcast.

P(w | v) = (c(v w) + MU * P(w)) / (c(v) + MU) with P(w) = (c(w) + 1) / (N + V + 1). Counts read from
the filters are the lower ends of their steps, so the chances of all w add up to 1 at most, false
positives aside. A text begins behind an end token and ends with one, so the words that are foreseen
and the words before them are the same ones, and the sum of log(c(v) + MU) can be taken over the
words foreseen. So a bigram needs c(v w) and c(w) only: bigrams are dealt by their word, whose part
counts it too. Bigrams of the HEAD most frequent words, whose counts are broadcast, are dealt by
both words, so no frequent word lies in one part.

The exact unigram counts of the base score come from a table of counts: the HEAD most frequent
tokens of at most HEAD_BYTES bytes are broadcast, and the other tokens of a text join the table by
token, once for each text and token.

Defined results: a null or empty text is the end token alone. A null id counts as empty text in the
hash that picks held-out rows (so it trains). Repeated rows are scored each, and train each. Ties in
frequency at the end of the head go by token. With no training rows all chances are 1. Other columns
do not matter. Whole texts are read, of any length.
"""

from __future__ import annotations

import math
import re
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.common import prepare, written

#: The end token cannot be a word, as it is white space.
END = b"\n"
HEAD, HEAD_BYTES = 150_000, 64
#: Bits for each n-gram of a level, and bits set for it in one 64-bit word of the filter.
BITS_EACH, SET_BITS = 12, 4
LEVELS = 40
#: Bits of a bigram's number that tell its first word, if it is dealt by its second, whose bits are above.
PAIR_BITS = 28
MU = 6.0
#: Bigrams of a part, about.
PART = 4_000_000
#: Counts kept in a worker before they are passed on.
HELD = 150_000


def tokens(text: bytes | None) -> list[bytes]:
    """Words and the end: bytes.lower and bytes.split know A-Z and the white space of the rule only."""
    out = (text or b"").lower().split()
    out.append(END)
    return out


def texts(column) -> list:
    return column.cast(pa.binary()).to_pylist()


def is_held_out(doc_id) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 7 == 2


def pair_hashes(h: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Of each token with the one before it; a text begins after an end token."""
    before = np.empty_like(h)
    before[1:] = h[:-1]
    before[starts] = xxhash.xxh64_intdigest(END, 3)
    with np.errstate(over="ignore"):
        x = (before * np.uint64(0x9E3779B97F4A7C15) ^ h) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(31))


def _count_words(batches):
    from collections import Counter

    held: Counter = Counter()

    def out():
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["token", "n"])

    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), texts(batch.column(1))):
            if not is_held_out(key):
                held.update(tokens(text))
        if len(held) > HELD:
            yield out()
            held.clear()
    yield out()


def _levels(counts: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(counts).astype(np.int64), LEVELS - 1)


def _masks(h: np.ndarray) -> np.ndarray:
    """The bits of each hash in its word of a filter."""
    with np.errstate(over="ignore"):
        x = h * np.uint64(0xD6E8FEB86659FD93)
    mask = np.zeros(len(h), np.uint64)
    for k in range(SET_BITS):
        mask |= np.uint64(1) << ((x >> np.uint64(64 - 6 * (k + 1))) & np.uint64(63))
    return mask


def _high(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(32)).astype(np.int64)


def build(h: np.ndarray) -> np.ndarray:
    """A Bloom filter of 64-bit words for hashes in ascending order: those of a word follow each other."""
    out = np.zeros(max(1, -(-len(h) * BITS_EACH // 64)), np.uint64)
    if len(h):
        at = (_high(h) * len(out)) >> 32
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        out[at[first]] = np.bitwise_or.reduceat(_masks(h), first)
    return out


def part_of(h: np.ndarray, parts: int) -> np.ndarray:
    """Low bits, which place in a filter does not use."""
    return (h & np.uint64(parts - 1)).astype(np.int64)


def mixed(h: np.ndarray) -> np.ndarray:
    """Numbers of few bits spread over all 64, as `build` and `Levels` expect."""
    with np.errstate(over="ignore"):
        x = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


class Levels:
    """The filters of all levels of some distinct n-grams, by hash, and their counts."""

    def __init__(self, h: np.ndarray, counts: np.ndarray):
        order = np.argsort(h)
        h, level = h[order], _levels(counts[order])
        self.filters = [build(h[level >= k]) for k in range(int(level.max(initial=-1)) + 1)]

    def counts(self, h: np.ndarray) -> np.ndarray:
        """Lower ends of the counts' steps, by probing upwards until a level says no; 0 for what is not held."""
        out, left, high, mask = np.zeros(len(h)), np.arange(len(h)), _high(h), _masks(h)
        for level, words in enumerate(self.filters):
            place = (high[left] * len(words)) >> 32
            left = left[(words[place] & mask[left]) == mask[left]]
            out[left] = 2.0**level
        return out


def train(spark: SparkSession, docs: DataFrame):
    """(table of token counts, N, V, broadcast counts of the head)."""
    prepare(spark)
    rows = docs.select("doc_id", "text")
    counts = written(spark, rows.mapInArrow(_count_words, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n")), "tokens")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    top = counts.where(F.octet_length("token") <= HEAD_BYTES).orderBy(F.desc("n"), "token").limit(HEAD).toArrow()  # at most HEAD rows of HEAD_BYTES
    head = dict(zip(top.column(0).to_pylist(), top.column(1).to_pylist()))
    return counts, total.n, total.v, spark.sparkContext.broadcast(head)


class Words(dict):
    """Numbers words as they are met, with log10(count + 1) for those of the head (else -1), the hash
    and the code of the head's count (else 0) by number."""

    def __init__(self, head: dict[bytes, int]):
        self.head = head
        self.forget()

    def forget(self):
        self.clear()
        self.listed: list[bytes] = []
        self.logs, self.hashes, self.codes = np.zeros(0), np.zeros(0, np.uint64), np.zeros(0, np.uint8)

    def __missing__(self, word: bytes) -> int:
        k = self[word] = len(self.listed)
        self.listed.append(word)
        return k

    def numbers(self, docs: list[list[bytes]]) -> list[np.ndarray]:
        if len(self) > HELD:
            self.forget()
        out = [np.fromiter(map(self.__getitem__, x), dtype=np.int64, count=len(x)) for x in docs]
        new = self.listed[len(self.logs) :]
        if new:
            h = np.fromiter((xxhash.xxh64_intdigest(w, 3) for w in new), dtype=np.uint64, count=len(new))
            got = np.array([self.head.get(w, 0) for w in new], dtype=float)
            self.logs = np.concatenate([self.logs, np.where(got > 0, np.log10(got + 1), -1.0)])
            self.hashes = np.concatenate([self.hashes, h])
            self.codes = np.concatenate([self.codes, _codes(got)])
        return out


def _codes(counts: np.ndarray) -> np.ndarray:
    """0 for 0, and k + 1 for counts from 2 ** k on."""
    return np.where(counts > 0, np.log2(np.maximum(counts, 1)).astype(np.int64) + 1, 0).astype(np.uint8)


def _pack(*parts: np.ndarray) -> bytes:
    raw = b"".join(x.tobytes() for x in parts)
    return len(raw).to_bytes(4, "little") + pa.compress(raw, "zstd", asbytes=True)


def _unpack(raw: bytes, kind) -> np.ndarray:
    return np.frombuffer(pa.decompress(raw[4:], int.from_bytes(raw[:4], "little"), "zstd", asbytes=True), kind)


def numbers_of(h: np.ndarray, codes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of each bigram, and the hash that deals it: its own for words of the head; else that
    of its word, whose upper bits are the number's, above some of the bigram's own."""
    gram, low = pair_hashes(h, starts), np.uint64((1 << PAIR_BITS) - 1)
    return np.where(codes > 0, gram, (h & ~low) | (gram & low)), np.where(codes > 0, gram, h)


def _answers(n_all: int, v_all: int):
    """Filters of a part, and the sum of log chances of each text over its bigrams there. Rows come
    sorted by part, so one part is held at a time."""

    def run(batches):
        from lattica.llm import lm

        now, held = None, []

        def done():
            runs = [lm._unpack(x[1], np.uint32).reshape(2, -1) for x in held]
            text, times = np.concatenate(runs, 1)
            code = np.concatenate([lm._unpack(x[2], np.uint8) for x in held])
            gram = np.concatenate([np.frombuffer(x[3], "<u8") for x in held])
            teaches, rare = np.repeat(text & 1 == 0, times), np.flatnonzero(code == 0)
            seen = lm.mixed(gram)
            seen = lm.Levels(*np.unique(seen[teaches], return_counts=True)).counts(seen)
            word, once = lm.mixed(gram[rare] >> np.uint64(lm.PAIR_BITS)), 2.0 ** (code.astype(float) - 1)
            once[rare] = lm.Levels(*np.unique(word[teaches[rare]], return_counts=True)).counts(word)
            value = np.log10((np.minimum(seen, once) + MU * (once + 1) / (n_all + v_all + 1)) / (once + MU))
            first = np.cumsum(times, dtype=np.int64) - times
            total, at, rows = np.add.reduceat(value, first), 0, []
            for (row, *_), (mine, _) in zip(held, runs):
                rows.append((row, now, (mine >> 1).tobytes(), total[at : at + len(mine)].tobytes()))
                at += len(mine)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.int32(), pa.binary(), pa.binary()))], ["row", "part", "texts", "sums"])

        for batch in batches:
            for part, *rest in zip(*(c.to_pylist() for c in batch.columns)):
                if part != now:
                    if held:
                        yield done()
                    now, held = part, []
                held.append(rest)
        if held:
            yield done()

    return run


def _sums(batches):
    """(row, score); rows come sorted by the first row of their texts, and part."""
    now, total = None, np.zeros(0)

    def done():
        return pa.RecordBatch.from_arrays([pa.array(now + np.arange(len(total))), pa.array(total)], ["row", "score"])

    for batch in batches:
        for row, _, texts_, sums in zip(*(c.to_pylist() for c in batch.columns)):
            if row != now:
                if len(total):
                    yield done()
                now, total = row, np.zeros(0)
            at = np.frombuffer(texts_, np.uint32).astype(np.int64)
            total = np.pad(total, (0, max(0, int(at[-1]) + 1 - len(total))))
            total[at] += np.frombuffer(sums)
    if len(total):
        yield done()


#: Steps of a plan that give the same rows in the same order each time it runs.
_STEADY = re.compile(r"(?:\*?\(\d+\)\s*)?(?:AdaptiveSparkPlan|WholeStageCodegen|InputAdapter|ColumnarToRow|Project|Filter|FileScan|BatchScan|Scan parquet)\b")


def steady(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The table itself if it is columns and conditions of files, else written: rows are numbered in two runs."""
    lines = [line.lstrip(" +-:") for line in docs._jdf.queryExecution().executedPlan().toString().splitlines()]
    return docs if all(_STEADY.match(x) for x in lines if x) else written(spark, docs, "rows")


def score(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)."""
    docs = steady(spark, docs.select("doc_id", "text"))
    counts, n_all, v_all, head = train(spark, docs)
    base = math.log10(n_all + v_all + 1)
    parts = 1 << max(4, math.ceil(math.log2(max(1, n_all / PART))))
    names = ["row", "token", "times", "doc_id", "n_tokens", "n_known", "base", "held_out", "part", "texts", "codes", "grams"]
    kinds = [pa.int64(), pa.binary(), pa.int64(), None, pa.int64(), pa.int64(), pa.float64(), pa.bool_(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]

    def run(batches, asking):
        # Both runs read the same splits in the same order (`steady`), so a row has the same number in both.
        from pyspark import TaskContext

        from lattica.llm import lm

        row = TaskContext.get().partitionId() << 33
        words = lm.Words(head.value)
        for batch in batches:
            if not batch.num_rows:
                continue

            def made(**given):
                n = len(next(iter(given.values())))
                types = [batch.column(0).type if name == "doc_id" else kind for name, kind in zip(names, kinds)]
                return pa.RecordBatch.from_arrays([given[x] if isinstance(given.get(x), pa.Array) else pa.array(given[x], t) if x in given else pa.nulls(n, t) for x, t in zip(names, types)], names)

            at = words.numbers([lm.tokens(x) for x in lm.texts(batch.column(1))])
            size = np.array([len(x) for x in at], dtype=np.int64)
            starts, at = np.cumsum(size) - size, np.concatenate(at)
            n, out = len(size), [is_held_out(k) for k in batch.column(0).to_pylist()]
            if asking:
                code = words.codes[at]
                gram, dealer = lm.numbers_of(words.hashes[at], code, starts)
                part = lm.part_of(dealer, parts)
                text = np.repeat(2 * np.arange(n, dtype=np.uint32) + np.array(out, np.uint32), size)
                order = np.argsort(part, kind="stable")
                cuts = np.searchsorted(part[order], np.arange(parts + 1))
                mine = [(p, order[a:b]) for p, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]
                texts_ = [lm._pack(*(x.astype(np.uint32) for x in np.unique(text[k], return_counts=True))) for _, k in mine]
                yield made(row=np.full(len(mine), row), part=[p for p, _ in mine], texts=texts_, codes=[lm._pack(code[k]) for _, k in mine], grams=[gram[k].astype("<u8").tobytes() for _, k in mine])
                row += n
                continue
            value = words.logs[at]
            known = value >= 0
            total = lambda v: np.add.reduceat(v, starts)
            yield made(
                row=row + np.arange(n),
                token=[b"\0%d" % (row + k) for k in range(n)],  # no word, and another for each row
                times=np.zeros(n, np.int64),
                doc_id=batch.column(0),
                n_tokens=size,
                n_known=total(known.astype(np.int64)),
                base=total(np.where(known, value, 0.0)) - size * base,
                held_out=out,
            )
            rare = np.flatnonzero(~known)
            pairs, times = np.unique((np.repeat(np.arange(n), size)[rare] << 32) | at[rare], return_counts=True)
            yield made(row=row + (pairs >> 32), token=[words.listed[k] for k in pairs & 0xFFFFFFFF], times=times.astype(np.int64))
            row += n

    schema = f"row long, token binary, times long, doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, n_known long, base double, held_out boolean, part int, texts binary, codes binary, grams binary"
    rows, asked = (docs.select("doc_id", "text").mapInArrow(lambda batches, asking=asking: run(batches, asking), schema) for asking in (False, True))
    asked = asked.select("part", "row", "texts", "codes", "grams").repartition("part").sortWithinPartitions("part", "row")
    answers = asked.mapInArrow(_answers(n_all, v_all), "row long, part int, texts binary, sums binary")
    sums = answers.repartition("row").sortWithinPartitions("row", "part").mapInArrow(_sums, "row long, score double")
    joined = rows.drop("part", "texts", "codes", "grams").join(counts, "token", "left")
    return joined.unionByName(sums, allowMissingColumns=True).groupBy("row").agg(
        F.max("doc_id").alias("doc_id"),
        F.coalesce(F.max("held_out"), F.lit(False)).alias("held_out"),
        F.max("n_tokens").alias("n_tokens"),
        (F.coalesce(F.max("n_known"), F.lit(0)) + F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0))).alias("n_known"),
        F.lit(n_all).cast("long").alias("train_tokens"),
        (F.max("base") + F.sum(F.when(F.col("n").isNotNull(), F.col("times") * F.log10(F.col("n") + 1)).otherwise(0.0))).alias("base_score"),
        F.least(F.max("score"), F.lit(0.0)).alias("score"),
    ).drop("row")


def digest(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return score(spark, docs.select("doc_id", "text"))
