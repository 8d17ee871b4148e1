"""Best-fit packing in bulk-synchronous rounds.

Pieces and gaps are range-sorted tables, and as lengths are whole numbers from 1 to `room` their rows
are runs: so many pieces of a length from a rank on, so many sequences with a gap from a number on. A
grouped aggregate makes the pieces' runs (at most `room` rows, whatever the input).

A round sweeps both tables from the largest size down. A piece's successor is the smallest gap that
takes it and that no larger piece of the round has taken; a gap takes as many pieces of the run as
fit. The sweep is done in ranges of sizes side by side; what finds no partner in its range goes on to
a second sweep over the ranges, which gives the same pairs as one sweep over all. Pieces and gaps of
two runs are matched by rank, so no two want the same place. Then the gaps shrink, sequences are
opened for pieces longer than any gap (as few as hold them), and the next round begins, until no piece
is left. Each round is a table in the shared folder, and only sums reach the driver on the way. At the
end the rounds' matches are broadcast (a row a run and round), and one pass over the pieces looks up
each piece's row by its length and rank.

Ranks come from a salted count (pieces of a length are numbered within SALTS parts), so that a
length shared by a third of all pieces still spreads. There are about as many rounds as a sequence
holds different lengths.

Defined results: a null or empty text is the end token alone. Only documents longer than a sequence
are cut. Repeated rows are separate documents; ties are settled by salt and order within it. Null
ids are kept; other columns do not matter. An empty table gives an empty table. Whole texts are
tokenized, in chunks between white space, whatever their length.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.llm.common import discard, prepare, written

ROOM = 4096
SALTS = 512
#: Ranges of sizes that are swept side by side.
RANGES = 8
TOKENIZER = "word_bpe_49k.json"
END_ID = 1
#: Chunks of text remembered in a worker, then forgotten together.
REMEMBERED = 400_000


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class _Numbered(dict):
    """Numbers chunks as they are met; those without ids yet wait in `new`."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, chunk: str) -> int:
        k = self[chunk] = len(self)
        self.new.append(chunk)
        return k


class Chunks:
    """Ids of texts, with the ids of each chunk between white space looked up once.

    The tokenizer drops white space and never joins what it parts, so ids of chunks are the ids of
    the text. New chunks of plain letters are tokenized together in one text, whose ids are parted
    after each end of a word; stops behind them are looked up apart, as the tokenizer parts letters
    from other signs. All other chunks are tokenized one by one. Texts with separators that
    str.split takes and the tokenizer keeps go to it whole.
    """

    STOPS = ".,;:!?"

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[k for t, k in vocabulary.items() if t.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        self.known = _Numbered()
        self.flat, self.used = np.zeros(1 << 20, dtype=np.uint32), 0
        self.start, self.count = np.zeros(1 << 16, dtype=np.int64), np.zeros(1 << 16, dtype=np.int64)

    @staticmethod
    def plain(chunk: str) -> bool:
        """Letters that stay one letter each in lower case and in composed form."""
        return chunk.isalpha() and (chunk.isascii() or max(chunk) < "\u0130")

    def encode(self, chunks: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]

    def put(self, numbers: list[int], ids: np.ndarray, counts: np.ndarray) -> None:
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.start[numbers] = self.used + np.cumsum(counts) - counts
        self.count[numbers] = counts
        self.used += len(ids)

    def learn(self) -> None:
        known, words, stopped, others = self.known, [], [], []
        for chunk in known.new:
            if self.plain(chunk):
                words.append(chunk)
                continue
            core = chunk.rstrip(self.STOPS)
            if core is not chunk and core and self.plain(core):
                stopped.append((chunk, core, chunk[len(core) :]))
            else:
                others.append(chunk)
        known.new = []
        numbers = [known[c] for _, core, stops in stopped for c in (core, stops)]
        for chunk in known.new:
            (words if self.plain(chunk) else others).append(chunk)
        known.new = []
        while len(known) > len(self.start):
            self.start, self.count = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.count))
        if words:
            ids = np.array(self.encode([" ".join(words)])[0], dtype=np.uint32)
            ends = np.flatnonzero(self.ends[ids])
            if len(ends) != len(words):
                others += words
            else:
                self.put([known[c] for c in words], ids, np.diff(ends, prepend=-1))
        if others:
            ids = self.encode(others)
            self.put([known[c] for c in others], np.array([i for x in ids for i in x], dtype=np.uint32), np.array([len(x) for x in ids], dtype=np.int64))
        if stopped:
            at = np.array(numbers, dtype=np.int64)
            self.put([known[c] for c, _, _ in stopped], self.joined(at), self.count[at].reshape(-1, 2).sum(1))

    def joined(self, at: np.ndarray) -> np.ndarray:
        """The ids of chunks, by number, behind each other."""
        n = self.count[at]
        ends = np.cumsum(n)
        return self.flat[np.repeat(self.start[at] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)]

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.known) > REMEMBERED:
            self.clear()
        find, numbers = self.known.__getitem__, []
        for text in texts:
            if text.isprintable() or not any(c in text for c in "\x1c\x1d\x1e\x1f"):
                chunks = text.split()
                numbers.append(np.fromiter(map(find, chunks), dtype=np.int64, count=len(chunks)))
            else:
                numbers.append(np.array(self.encode([text])[0], dtype=np.uint32))
        self.learn()
        return [x if x.dtype == np.uint32 else self.joined(x) for x in numbers]


#: By path, for the life of a worker.
_chunks: dict[str, Chunks] = {}


def _cutter(path: str, room: int, end_id: int):
    def run(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from lattica.llm import packing

        chunks = packing._chunks.get(path) or packing._chunks.setdefault(path, packing.Chunks(path))
        for batch in batches:
            rows, piece, start, length, crc = [], [], [], [], []
            for k, ids in enumerate(chunks.ids([x or "" for x in batch.column(0).to_pylist()])):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                for p, at in enumerate(range(0, len(ids), room)):
                    part = ids[at : at + room]
                    rows.append(k)
                    piece.append(p)
                    start.append(at)
                    length.append(len(part))
                    crc.append(zlib.crc32(part.tobytes()))
            keys = batch.column(1).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [keys, pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return run


def pieces(spark: SparkSession, docs: DataFrame, path: str | None = None, room: int = ROOM, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of all documents."""
    prepare(spark)
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType)]).add("piece", "integer").add("start", "long").add("length", "long").add("ids_crc32", "long")
    return docs.select("text", "doc_id").mapInArrow(_cutter(path or tokenizer_path(), room, end_id), schema)


_RUNS = "size int, kind int, at long, n long, gap int, first long, q int"
GAP, PIECE, MATCH = 0, 1, 2


def _sweep(batches):
    """Matches of runs that come sorted by range, size (largest first), kind and number; what has no
    partner in its range is passed on as it is left, and matches of an earlier sweep as they are."""
    names = [x.split()[0] for x in _RUNS.split(", ")]
    out, stack, now = [], [], None

    def left():
        out.extend((size, GAP, at, n, None, None, None) for size, at, n in stack)
        stack.clear()

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            part, size, kind, at, n, *_ = row
            if part != now:
                left()
                now = part
            if kind == MATCH:
                out.append(row[1:])
                continue
            if kind == GAP:
                stack.append([size, at, n])
                continue
            while n and stack:
                gap, first, have = stack[-1]
                q = gap // size  # at least 1: gaps on the stack are not smaller
                full = min(have, n // q)
                take, used = (full * q, full) if full else (n, 1)
                out.append((size, MATCH, at, take, gap, first, q if full else n))
                at, n = at + take, n - take
                stack[-1][1:] = first + used, have - used
                if have == used:
                    stack.pop()
            if n:
                out.append((size, PIECE, at, n, None, None, None))
    left()
    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32())
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [()] * 7, kinds)], names)


def rounds(spark: SparkSession, counts: DataFrame, room: int = ROOM) -> np.ndarray:
    """Rounds of best fit on counts (length, n): rows (length, first rank, first sequence, offset,
    pieces in a sequence). Sequences of a row follow each other."""

    def swept(runs, part):
        runs = runs.select(part.alias("part"), *(x.split()[0] for x in _RUNS.split(", ")))
        return runs.repartition("part").sortWithinPartitions("part", F.desc("size"), "kind", "at").mapInArrow(_sweep, _RUNS)

    none = lambda *names: [F.lit(None).cast(t).alias(n) for n, t in names]
    match = none(("gap", "int"), ("first", "long"), ("q", "int"))
    state = counts.select(F.col("length").cast("int").alias("size"), F.lit(PIECE).alias("kind"), F.lit(0).cast("long").alias("at"), "n", *match)
    opened, done, wide = 0, [], -(-(room + 1) // RANGES)
    while True:
        top = state.agg(F.max(F.when(F.col("kind") == GAP, F.col("size"))).alias("gap"), F.max(F.when(F.col("kind") == PIECE, F.col("size"))).alias("piece")).first()
        if top.piece is None:
            break
        if top.piece > (top.gap or 0):
            over = state.where((F.col("kind") == PIECE) & (F.col("size") > (top.gap or 0))).agg(F.sum(F.col("size") * F.col("n"))).first()[0]
            more = -(-over // room)
            fresh = [F.lit(room).alias("size"), F.lit(GAP).alias("kind"), F.lit(opened).cast("long").alias("at"), F.lit(more).cast("long").alias("n"), *match]
            state, opened = state.unionByName(spark.range(1).select(*fresh)), opened + more
        found = swept(swept(state, F.floor(F.col("size") / wide).cast("int")), F.lit(0))
        found = written(spark, found, "round")
        done.append(found)
        shrunk = found.where((F.col("kind") == MATCH) & (F.col("gap") > F.col("q") * F.col("size"))).select(
            (F.col("gap") - F.col("q") * F.col("size")).alias("size"), F.lit(GAP).alias("kind"), F.col("first").alias("at"), F.floor(F.col("n") / F.col("q")).alias("n"), *match
        )
        state = found.where(F.col("kind") != MATCH).unionByName(shrunk)
    rows = []
    for found in done:
        own = found.where(F.col("kind") == MATCH).select("size", "at", "first", (F.lit(room) - F.col("gap")).cast("long").alias("offset"), "q").toArrow()
        rows.append(np.stack([c.to_numpy() for c in own.columns], 1).astype(np.int64))
        discard(found)
    return np.concatenate(rows) if rows else np.zeros((0, 5), np.int64)


def _placer(rounds):
    def run(batches):
        length, rank, first, offset, q = rounds.value.T
        key = length * (1 << 40) + rank
        order = np.argsort(key)
        key = key[order]
        for batch in batches:
            if not batch.num_rows:
                continue
            l, r = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
            at = order[np.searchsorted(key, l * (1 << 40) + r, side="right") - 1]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[2:], pa.array(l), pa.array(first[at] + (r - rank[at]) // q[at]), pa.array(offset[at] + (r - rank[at]) % q[at] * l)],
                ["doc_id", "piece", "start", "ids_crc32", "length", "sequence_id", "offset"],
            )

    return run


def pack(spark: SparkSession, docs: DataFrame, path: str | None = None, room: int = ROOM, end_id: int = END_ID) -> DataFrame:
    """Pieces with sequence_id and offset."""
    cut = written(spark, pieces(spark, docs, path, room, end_id), "pieces")
    cut = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(SALTS)).cast("int"))
    per_salt = cut.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_salt.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))  # at most SALTS rows a length
    matches = spark.sparkContext.broadcast(rounds(spark, cut.groupBy("length").agg(F.count("*").alias("n")), room))
    own = Window.partitionBy("length", "salt").orderBy("ids_crc32", "doc_id", "piece")
    ranked = cut.withColumn("own", F.row_number().over(own) - 1).join(starts.select("length", "salt", "before"), ["length", "salt"])
    schema = T.StructType([cut.schema["doc_id"]]).add("piece", "integer").add("start", "long").add("ids_crc32", "long").add("length", "long").add("sequence_id", "long").add("offset", "long")
    return ranked.select("length", (F.col("own") + F.col("before")).alias("rank"), "doc_id", "piece", "start", "ids_crc32").mapInArrow(_placer(matches), schema)


def digest(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return pack(spark, docs.select("doc_id", "text")).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
