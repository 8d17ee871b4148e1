"""Fill-in-the-middle by succinct rank and select.

A text's tokens are runs of letters A-Z and a-z, and single code points otherwise. Each Arrow batch of
texts lies in one buffer of bytes. `Bits` marks in one packed bitvector the bytes where a token starts
(a second one marks where a code point starts), with a directory of the marks before each block of 512
bits. Ranks at the ends of a text give its number of tokens n, selects on the two drawn ranks give the
bytes at which it is cut, and ranks in the second vector turn those into lengths in code points. Bits
are made a stretch of bytes at a time, so besides the texts themselves a batch takes a quarter of a
byte a byte. Nothing is shuffled: the work is one pass, row by row.

Draws are hashes of the id: h1 to h4 are the first four 8-digit groups of sha256("<seed>:<doc_id>").
The prefix ends after the smaller of h1 % (n + 1) and h2 % (n + 1) tokens, the middle after the larger.

Defined results: null and empty texts, texts that hold one of the three marks, and those that h3 leaves
out stay as they are (form plain). A null id draws as an empty one. Repeated rows give repeated rows;
other columns pass through `transform`, apart from those named as its results, which are replaced. An
empty table gives an empty table. Texts of any length are cut whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.llm.common import prepare

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 1
#: Per cent of the texts that are cut, and of those the per cent that begin with the suffix.
CUT, SUFFIX_FIRST = 90, 20

_BLOCK, _WORDS = 512, 8
_STRETCH = 1 << 20
_LETTER = np.zeros(256, bool)
_LETTER[ord("A") : ord("Z") + 1] = _LETTER[ord("a") : ord("z") + 1] = True
_INSIDE = np.zeros(256, bool)  # bytes within a code point
_INSIDE[0x80:0xC0] = True


class Bits:
    """A packed bitvector with a popcount directory over blocks of 512 bits."""

    def __init__(self, size: int, fill):
        """fill(a, b): the bits from a to b, as booleans; asked for in stretches of whole blocks."""
        packed = np.zeros(-(-(size + 1) // _BLOCK) * _BLOCK // 8, np.uint8)
        for a in range(0, size, _STRETCH):
            part = np.packbits(fill(a, min(size, a + _STRETCH)), bitorder="little")
            packed[a // 8 : a // 8 + len(part)] = part
        self.words = packed.view("<u8").reshape(-1, _WORDS)
        self.before = np.zeros(len(self.words) + 1, np.int64)
        np.cumsum(np.bitwise_count(self.words).sum(1, dtype=np.int64), out=self.before[1:])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Marks before the places."""
        block, word, bit = at // _BLOCK, at % _BLOCK // 64, (at % 64).astype(np.uint64)
        words = self.words[block]
        whole = (np.bitwise_count(words) * (np.arange(_WORDS) < word[:, None])).sum(1, dtype=np.int64)
        part = np.bitwise_count(words[np.arange(len(at)), word] & ((np.uint64(1) << bit) - np.uint64(1)))
        return self.before[block] + whole + part

    def select(self, k: np.ndarray) -> np.ndarray:
        """Places of the marks numbered k, from 0."""
        block = np.searchsorted(self.before, k, side="right") - 1
        words, rows = self.words[block], np.arange(len(k))
        upto = np.cumsum(np.bitwise_count(words), axis=1, dtype=np.int64)
        left = k - self.before[block]
        word = (upto <= left[:, None]).sum(1)
        left = left - np.where(word, upto[rows, word - 1], 0)
        bits = (words[rows, word][:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)
        return block * _BLOCK + word * 64 + (np.cumsum(bits, axis=1, dtype=np.int64) <= left[:, None]).sum(1)


def boundaries(data: np.ndarray, starts: np.ndarray) -> tuple[Bits, Bits]:
    """Starts of tokens and of code points in UTF-8 texts that begin at the (sorted) places `starts`."""

    def tokens(a, b):
        letter = _LETTER[data[a:b]]
        bits = ~_INSIDE[data[a:b]]
        bits[1:] &= ~(letter[1:] & letter[:-1])
        if a and len(letter):
            bits[0] &= not (letter[0] and _LETTER[data[a - 1]])
        lo, hi = np.searchsorted(starts, [a, b])
        bits[starts[lo:hi] - a] = True
        return bits

    return Bits(len(data), tokens), Bits(len(data), lambda a, b: ~_INSIDE[data[a:b]])


def cut_points(data: np.ndarray, offsets: np.ndarray, h1: np.ndarray, h2: np.ndarray):
    """n, then the two cuts in bytes, then the lengths of prefix and middle in code points."""
    begin, end = offsets[:-1], offsets[1:]
    token, point = boundaries(data, begin[begin < end])
    first = token.rank(begin)
    n = token.rank(end) - first
    a, b = h1 % (n + 1), h2 % (n + 1)
    low, high = np.minimum(a, b), np.maximum(a, b)

    def place(r):
        at, within = end.copy(), r < n
        at[within] = token.select(first[within] + r[within])
        return at

    one, two = place(low), place(high)
    base = point.rank(begin)
    return n, one, two, point.rank(one) - base, point.rank(two) - point.rank(one)


def _run(batches):
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]
    for batch in batches:
        if not batch.num_rows:
            continue
        text = batch.column(0).cast(pa.large_string())
        _, ends, buffer = text.buffers()
        offsets = np.frombuffer(ends, np.int64, len(text) + 1, text.offset * 8)
        data = np.frombuffer(buffer, np.uint8, offsets[-1] - offsets[0], offsets[0]) if buffer and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
        offsets = offsets - offsets[0]
        form = batch.column(1).to_pylist()
        n, one, two, head, middle = cut_points(data, offsets, batch.column(2).to_numpy(), batch.column(3).to_numpy())
        view, out, plain = memoryview(data), [], np.array([f == "plain" for f in form])
        for f, a, b, c, d in zip(form, offsets[:-1].tolist(), one.tolist(), two.tolist(), offsets[1:].tolist()):
            if f == "psm":
                out.append(b"".join((marks[0], view[a:b], marks[1], view[c:d], marks[2], view[b:c])))
            elif f == "spm":
                out.append(b"".join((marks[1], view[c:d], marks[0], view[a:b], marks[2], view[b:c])))
            else:
                out.append(bytes(view[a:d]))
        made = [pa.array(n), batch.column(1), pa.array(head, mask=plain), pa.array(middle, mask=plain), pa.array(out, pa.binary()).cast(pa.string())]
        yield pa.RecordBatch.from_arrays([*batch.columns[4:], *made], [*batch.schema.names[4:], *MADE])


MADE = ["n", "form", "prefix_chars", "middle_chars", "output"]


def transform(spark: SparkSession, docs: DataFrame, seed: int = SEED, cut: int = CUT, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """All columns of docs, and n, form (plain, psm or spm), prefix_chars, middle_chars and output."""
    prepare(spark)
    digits = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = [F.conv(F.substring(digits, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]
    text = F.coalesce("text", F.lit(""))
    marked = F.lit(False)
    for m in (PREFIX, SUFFIX, MIDDLE):
        marked |= F.contains(text, F.lit(m))
    form = F.when((text == "") | marked | (h[2] % 100 >= cut), "plain").when(h[3] % 100 < suffix_first, "spm").otherwise("psm")
    kept = [c for c in docs.columns if c not in MADE]
    given = docs.select(text.alias("__f_text"), form.alias("__f_form"), h[0].alias("__f_h1"), h[1].alias("__f_h2"), *kept)
    schema = T.StructType([docs.schema[c] for c in kept])
    for name, kind in zip(MADE, ("long", "string", "long", "long", "string")):
        schema = schema.add(name, kind)
    return given.mapInArrow(_run, schema)


def restore(output: Column, form: Column) -> Column:
    """The text again. A mark is found at its first place, as no text with a mark is cut."""

    def after(x, mark):
        return F.substr(x, F.locate(mark, x) + len(mark))

    def upto(x, mark):
        return F.substring_index(x, mark, 1)

    psm = F.concat(after(upto(output, SUFFIX), PREFIX), after(output, MIDDLE), after(upto(output, MIDDLE), SUFFIX))
    spm = F.concat(after(upto(output, MIDDLE), PREFIX), after(output, MIDDLE), after(upto(output, PREFIX), SUFFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def digest(spark: SparkSession, docs: DataFrame) -> DataFrame:
    out = transform(spark, docs.select("doc_id", "text")).drop("text")
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


ORACLE = r"""
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d FROM documents
), tokens AS (
  SELECT doc_id, t, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS w,
    ('0x' || substr(d, 1, 8))::BIGINT AS h1, ('0x' || substr(d, 9, 8))::BIGINT AS h2,
    ('0x' || substr(d, 17, 8))::BIGINT AS h3, ('0x' || substr(d, 25, 8))::BIGINT AS h4
  FROM drawn
), cuts AS (
  SELECT doc_id, t, w, CAST(len(w) AS BIGINT) AS n, least(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS a, greatest(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM tokens
), parts AS (
  SELECT doc_id, t, n, form, array_to_string(w[1:a], '') AS p, array_to_string(w[a + 1:b], '') AS m, array_to_string(w[b + 1:], '') AS s FROM cuts
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE t END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM parts
"""
