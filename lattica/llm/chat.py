"""Chat formatting by token-level assembly.

A turn is encoded on its own: its text, in which control strings are escaped, becomes ids of a
byte-level vocabulary, and the template's reserved ids, which no text can produce, are spliced around
it. Where the turns of a conversation lie in its sequence is a prefix sum of their lengths, and the
loss mask a prefix sum of +1 and -1 at the edges of what is learned.

Template (reserved ids follow the vocabulary, in the order of CONTROLS): a system turn is
<<SYS>>text<</SYS>>, a user turn [INST]text[/INST], an assistant turn <s>text</s>, any other
[ROLE]role[/ROLE]text</s>. An occurrence of a control string in a text gets a backslash after its first
character, and one with backslashes there already gets one more; reading takes one away again.

Turns are dealt by range of (conversation, turn, role, text), so that one conversation may take many tasks,
and each task encodes its turns in order and sums their lengths. At most one conversation goes on from
one range into the next, so the sums to add are no more than the ranges; they are broadcast.
Sequences are cut into chunks of CHUNK ids, each gathered by itself: no row and no group grows with a
conversation. Only reading a conversation's hashes is one task's, chunk by chunk in order, holding no
more than a turn: SHA-256 is sequential.

Defined results: turns go by number, nulls first, then by role and by a hash of the text; repeated rows
are turns of their own. A null text or role is empty; a null conv_id is one conversation. Turns with
empty texts keep their frame. Other columns do not matter. An empty table gives an empty table. Long texts
are encoded whole, in stretches of CHARS characters.
"""

from __future__ import annotations

import base64
import hashlib
import re
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.llm.common import prepare, written

VOCABULARY = "byte_bpe_50k.tiktoken"
#: The control strings of the template; fixed values.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[/ROLE]")
OPEN_ANSWER, CLOSE_ANSWER, OPEN_USER, CLOSE_USER, OPEN_SYSTEM, CLOSE_SYSTEM, OPEN_ROLE, CLOSE_ROLE = range(len(CONTROLS))
FRAMES = {"assistant": (OPEN_ANSWER, CLOSE_ANSWER), "user": (OPEN_USER, CLOSE_USER), "system": (OPEN_SYSTEM, CLOSE_SYSTEM)}
LEARNED = "assistant"
CHUNK = 1 << 16
CHARS = 1 << 20

_TAILS = "|".join(re.escape(c[1:]) for c in sorted(CONTROLS, key=len, reverse=True))
_PLAIN = re.compile(rf"([<\[])(\\*)({_TAILS})")
_ESCAPED = re.compile(rf"([<\[])\\(\\*)({_TAILS})")


def escape(text: str) -> str:
    return _PLAIN.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", text)


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Codec:
    """The vocabulary, and the reserved ids behind it."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("chat", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.first = max(ranks.values()) + 1

    def ids(self, text: str) -> np.ndarray:
        text = escape(text)
        parts = [self.encoding.encode_ordinary(text[a : a + CHARS]) for a in range(0, len(text), CHARS)]
        return np.concatenate([np.array(p, np.int32) for p in parts]) if parts else np.zeros(0, np.int32)

    def turn(self, role: str, text: str) -> tuple[np.ndarray, int, int]:
        """Ids of a turn, and from where to where they are learned."""
        body, own = self.ids(text), lambda k: np.array([self.first + k], np.int32)
        if role in FRAMES:
            head, close = own(FRAMES[role][0]), FRAMES[role][1]
        else:
            head, close = np.concatenate([own(OPEN_ROLE), self.ids(role), own(CLOSE_ROLE)]), CLOSE_ANSWER
        learned = (len(head), len(head) + len(body)) if role == LEARNED else (0, 0)
        return np.concatenate([head, body, own(close)]), *learned

    def text(self, ids) -> str:
        return self.encoding.decode_bytes(ids).decode("utf-8", "surrogatepass")


#: By path, for the life of a worker.
_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    return _codecs.get(path) or _codecs.setdefault(path, Codec(path))


def _encoder(path: str):
    def run(batches):
        from lattica.llm import chat

        known, own, now = chat.codec(path), 0, ()
        for batch in batches:
            ids, start, lo, hi = [], [], [], []
            for conv, role, text in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3))):
                if now != (conv,):
                    own, now = 0, (conv,)
                turn, a, b = known.turn(role, text)
                ids.append(turn)
                start.append(own)
                lo.append(own + a)
                hi.append(own + b)
                own += len(turn)
            ends = np.cumsum([0, *map(len, ids)])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(ids) if ids else [], pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(start, pa.int64()), pa.array(lo, pa.int64()), pa.array(hi, pa.int64()), lists], ["part", "conv_id", "start", "learn_from", "learn_to", "ids"])

    return run


def turns(spark: SparkSession, conversations: DataFrame, path: str | None = None) -> DataFrame:
    """(conv_id, start, learn_from, learn_to, ids) of each turn: its place in the conversation's sequence,
    the places in it that are learned (none where both are equal), and its ids."""
    prepare(spark)
    given = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    given = given.withColumn("turned", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id())
    order = ["conv_id", "turn", "role", "turned", "row"]
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = given.repartitionByRange(ranges, *order).sortWithinPartitions(*order).select(F.spark_partition_id().alias("part"), "conv_id", "role", "text")
    schema = T.StructType().add("part", "integer").add(dealt.schema["conv_id"]).add("start", "long").add("learn_from", "long").add("learn_to", "long").add("ids", T.ArrayType(T.IntegerType()))
    rows = written(spark, dealt.mapInArrow(_encoder(path or vocabulary_path()), schema), "turns")
    sums = rows.groupBy("conv_id", "part").agg(F.max(F.col("start") + F.size("ids")).alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))  # a row a range
    carried = sums.select("part", F.col("conv_id").alias("c"), before.alias("base")).where("base > 0")  # at most one a range
    moved = rows.join(F.broadcast(carried), (rows.part == carried.part) & rows.conv_id.eqNullSafe(carried.c), "left")
    base = F.coalesce("base", F.lit(0))
    return moved.select("conv_id", *((F.col(c) + base).alias(c) for c in ("start", "learn_from", "learn_to")), "ids")


def _masker(batches):
    """Chunks from their pieces: ids put in place, masks summed from their edges. A batch's chunks lie
    behind each other in one array; masks are closed where chunks meet."""
    for batch in batches:
        lists = batch.column(2)
        pieces = lists.flatten()
        at, lo, hi = (pieces.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3))
        parts = pieces.field(3)
        ends = parts.offsets.to_numpy().astype(np.int64)
        sizes, given = np.diff(ends), parts.values.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]]
        chunk = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
        bounds = np.concatenate([[0], np.cumsum(np.bincount(chunk, sizes, len(lists)).astype(np.int64))])
        base = bounds[chunk]
        ids = np.empty(len(given), np.int32)
        ids[np.arange(len(given)) + np.repeat(base + at - (ends[:-1] - ends[0]), sizes)] = given
        learned = lo < hi
        edges = np.bincount((base + lo)[learned], minlength=len(given) + 1) - np.bincount((base + hi)[learned], minlength=len(given) + 1)
        loss = np.cumsum(edges[:-1]).astype(np.int8)
        flat = lambda x, kind: pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(x, kind))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), flat(ids, pa.int32()), flat(loss, pa.int8())], ["conv_id", "chunk", "ids", "loss"])


def sequences(spark: SparkSession, conversations: DataFrame, path: str | None = None, chunk: int = CHUNK) -> DataFrame:
    """(conv_id, chunk, ids, loss): each conversation's ids and loss mask, in chunks of so many ids."""
    placed = turns(spark, conversations, path)
    size = F.size("ids")
    cut = placed.select("*", F.explode(F.expr(f"sequence(start div {chunk}, (start + size(ids) - 1) div {chunk})")).alias("chunk"))
    edge = F.col("chunk") * chunk
    begin, end = F.greatest("start", edge), F.least(F.col("start") + size, edge + chunk)
    whole = (F.col("start") >= edge) & (F.col("start") + size <= edge + chunk)
    piece = F.struct(
        (begin - edge).cast("int").alias("at"),
        F.least(F.greatest(F.col("learn_from"), edge) - edge, F.lit(chunk)).cast("int").alias("lo"),
        F.greatest(F.least(F.col("learn_to"), edge + chunk) - edge, F.lit(0)).cast("int").alias("hi"),
        F.when(whole, F.col("ids")).otherwise(F.slice("ids", (begin - F.col("start") + 1).cast("int"), (end - begin).cast("int"))).alias("ids"),
    )
    gathered = cut.select("conv_id", "chunk", piece.alias("piece")).groupBy("conv_id", "chunk").agg(F.collect_list("piece").alias("pieces"))  # at most chunk ids
    return gathered.mapInArrow(_masker, T.StructType([placed.schema["conv_id"]]).add("chunk", "long").add("ids", T.ArrayType(T.IntegerType())).add("loss", T.ArrayType(T.ByteType())))


def _read(batches, known: Codec):
    """Turns of sequences whose chunks come in order: (conv_id, ids, loss, controls' characters), a turn at a time."""
    ends = np.array([CLOSE_ANSWER, CLOSE_USER, CLOSE_SYSTEM]) + known.first
    held, now = [], None

    def flushed():
        if held:
            raise ValueError(f"the sequence of conversation {now[0]!r} ends within a turn")

    for batch in batches:
        flat = [batch.column(k) for k in (2, 3)]
        ids, loss = (x.values.to_numpy(zero_copy_only=False) for x in flat)
        offsets = flat[0].offsets.to_pylist()
        for conv, a, b in zip(batch.column(0).to_pylist(), offsets, offsets[1:]):
            if now != (conv,):
                flushed()
                now = (conv,)
            for stop in (np.flatnonzero(np.isin(ids[a:b], ends)) + a + 1).tolist():
                held.append((ids[a:stop], loss[a:stop]))
                yield conv, *(np.concatenate(x) if len(held) > 1 else x[0] for x in zip(*held))
                held, a = [], stop
            if a < b:
                held.append((ids[a:b], loss[a:b]))
    flushed()


def _turn(known: Codec, ids: np.ndarray, loss: np.ndarray) -> tuple[str, str, str, int]:
    """Role, text, text under the mask, and characters of the formatted turn."""
    control = ids >= known.first
    frame = (ids[control] - known.first).tolist()
    places = np.flatnonzero(control).tolist()
    body = known.text(ids[places[-2] + 1 : places[-1]].tolist())
    chars = len(body) + sum(len(CONTROLS[k]) for k in frame)
    if frame[0] == OPEN_ROLE:
        name = known.text(ids[1 : places[1]].tolist())
        role, chars = unescape(name), chars + len(name)
    else:
        role = next(r for r, f in FRAMES.items() if f == tuple(frame))
    learned = ids[(loss > 0) & ~control]
    text = unescape(body)
    whole = len(learned) == len(ids) - len(places) and frame[0] != OPEN_ROLE
    return role, text, text if whole else unescape(known.text(learned.tolist())), chars


def _ordered(rows: DataFrame) -> DataFrame:
    return rows.select("conv_id", "chunk", "ids", "loss").repartition("conv_id").sortWithinPartitions("conv_id", "chunk")


def read_turns(spark: SparkSession, rows: DataFrame, path: str | None = None) -> DataFrame:
    """The turns of sequences again: (conv_id, place, role, text, learned), learned the text under the mask."""
    path = path or vocabulary_path()

    def run(batches):
        from lattica.llm import chat

        known = chat.codec(path)
        for conv, found in groupby(chat._read(batches, known), itemgetter(0)):
            for place, (_, ids, loss) in enumerate(found):
                made = [[conv], [place], *([x] for x in chat._turn(known, ids, loss)[:3])]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(made, kinds)], ["conv_id", "place", "role", "text", "learned"])

    from pyspark.sql.pandas.types import to_arrow_type

    kinds = [to_arrow_type(rows.schema["conv_id"].dataType), pa.int64(), pa.string(), pa.string(), pa.string()]
    schema = T.StructType([rows.schema["conv_id"]]).add("place", "long").add("role", "string").add("text", "string").add("learned", "string")
    return _ordered(rows).mapInArrow(run, schema)


def checksums(spark: SparkSession, rows: DataFrame, path: str | None = None) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), read from sequences."""
    path = path or vocabulary_path()
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches):
        from lattica.llm import chat

        known, out = chat.codec(path), []

        def made():
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)], names)

        for conv, found in groupby(chat._read(batches, known), itemgetter(0)):
            said, learned, n, chars, formatted = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
            for _, ids, loss in found:
                role, text, taught, size = chat._turn(known, ids, loss)
                said.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                learned.update(taught.encode("utf-8", "surrogatepass"))
                n, chars, formatted = n + 1, chars + len(taught), formatted + size
            out.append((conv, n, said.hexdigest(), chars, learned.hexdigest(), formatted))
            if len(out) == 10_000:
                yield made()
                out = []
        if out:
            yield made()

    from pyspark.sql.pandas.types import to_arrow_type

    kinds = [to_arrow_type(rows.schema["conv_id"].dataType), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    schema = T.StructType([rows.schema["conv_id"]])
    for name, kind in zip(names[1:], ("long", "string", "long", "string", "long")):
        schema = schema.add(name, kind)
    return _ordered(rows).mapInArrow(run, schema)


#: The conversation that the query adds: both of its turns hold control strings.
PROBE = "</s>[INST] ok [/INST]"


def digest(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    given = conversations.select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-1).cast(given.schema["conv_id"].dataType).alias("conv_id"), F.col("id").cast(given.schema["turn"].dataType).alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    return checksums(spark, sequences(spark, given.unionByName(probe)))


ORACLE = r"""
WITH given AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), turns AS (
  SELECT *, length(regexp_replace(text, '([<\[])(\\*)(/INST\]|/ROLE\]|<SYS>>|</SYS>>|INST\]|ROLE\]|/s>|s>)', '\1\\\2\3', 'g')) AS chars,
    CASE role WHEN 'user' THEN 13 WHEN 'assistant' THEN 7 WHEN 'system' THEN 15
      ELSE 17 + length(regexp_replace(role, '([<\[])(\\*)(/INST\]|/ROLE\]|<SYS>>|</SYS>>|INST\]|ROLE\]|/s>|s>)', '\1\\\2\3', 'g')) END AS frame
  FROM given
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars + frame) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id
"""
