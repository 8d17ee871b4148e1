"""Chat formatting, fill-in-the-middle and resampling towards a target, against brute force and on odd rows."""

import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lattica.llm import chat, middle, target

DATA = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
EDGE = [
    (1, None), (2, ""), (3, " \t\n\x0b\f\r "), (4, "one"), (4, "one"), (None, "one two three four"), (None, None), (5, "word " * 30_000), (6, "x" * 400_000),
    (7, "Été K İ naïve \x1cfoo\x1dbar 漢字 don't\x00q"), (8, "a<P>b"), (9, "a<S"), (10, "<<M>>"), (11, "é" * 3000), (12, "ab<" * 700), (13, "The end<P"),
    (14, " ".join(f"w{k}" for k in range(20))), (15, " ".join(f"w{k}" for k in range(19))), *((k, "same words in all of these texts " * 4) for k in range(16, 60)), *((60, "repeated row " * 15),) * 30,
]


@pytest.fixture(scope="module")
def edge(spark):
    """With further columns whose names clash with results and working names."""
    return spark.createDataFrame([(i, t, "en", 7, "y", 2.0) for i, t in EDGE], "doc_id long, text string, form string, n int, output string, score double").repartition(3)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")


def rows(df):
    return df.select("doc_id", "text").collect()


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def against_sql(got, sql, **tables):
    c = duckdb.connect()
    for name, df in tables.items():
        c.register(name, df.toPandas())
    want, got = c.sql(sql).df(), got.toPandas()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    pd.testing.assert_frame_equal(*(x[cols].sort_values(cols).reset_index(drop=True) for x in (got, want)), check_dtype=False)


# 12


def middle_row(doc_id, text):
    t = text or ""
    w = re.findall(r"[A-Za-z]+|[^A-Za-z]", t)
    d = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(d[k : k + 8], 16) for k in (0, 8, 16, 24)]
    n = len(w)
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, digest(t), digest(t)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(w[:a]), "".join(w[a:b]), "".join(w[b:])
    form = "spm" if h[3] % 100 < 20 else "psm"
    out = f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"
    return n, form, len(p), len(m), digest(out), digest(t)


def test_middle(spark, docs, edge):
    more = spark.createDataFrame([(k, "abc ß" * 5 + "<" * (k % 4)) for k in range(5000, 5400)], "doc_id long, text string")
    df = docs.unionByName(edge.select("doc_id", "text")).unionByName(more)
    got = Counter(map(tuple, middle.digest(spark, df).collect()))
    assert got == Counter((i, *middle_row(i, t)) for i, t in rows(df))
    assert {x[2] for x in got} == {"plain", "psm", "spm"}


def test_middle_keeps_columns_and_sql_agrees(spark, docs, edge):
    out = middle.transform(spark, edge)
    assert out.columns == ["doc_id", "text", "score", "n", "form", "prefix_chars", "middle_chars", "output"] and out.count() == len(EDGE)
    assert out.where(~middle.restore(F.col("output"), F.col("form")).eqNullSafe(F.coalesce("text", F.lit("")))).count() == 0
    against_sql(middle.digest(spark, docs), middle.ORACLE, documents=docs)
    assert middle.digest(spark, docs.limit(0)).count() == 0


def test_rank_and_select():
    """Against plain counting, across blocks and stretches."""
    rng = np.random.default_rng(0)
    for size, share in ((1, 1.0), (511, 0.5), (512, 0.5), (5000, 0.01), (3_000_000, 0.3), (70_000, 0.0)):
        marks = rng.random(size) < share
        bits = middle.Bits(size, lambda a, b: marks[a:b])
        before = np.concatenate([[0], np.cumsum(marks)])
        at = np.unique(np.concatenate([rng.integers(0, size + 1, 500), [0, size]]))
        assert (bits.rank(at) == before[at]).all()
        places = np.flatnonzero(marks)
        k = np.unique(rng.integers(0, max(1, len(places)), 500)) if len(places) else np.zeros(0, int)
        assert (bits.select(k) == places[k]).all()


def test_boundaries_of_texts_that_touch():
    """A letter that ends a text does not join the one that begins the next; stretches do not part runs."""
    data = np.frombuffer(b"ab" + b"c" * (middle._STRETCH + 5) + "é".encode(), np.uint8)
    token, point = middle.boundaries(data, np.array([0, 2]))
    assert token.rank(np.array([len(data)]))[0] == 3 and point.rank(np.array([len(data)]))[0] == len(data) - 1


# 13


def target_rows(docs, wanted):
    words = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate(LOWER))
    bucket = lambda w: zlib.crc32(w.encode()) % 10000
    raw, goal = Counter(), Counter()
    for _, t in docs:
        raw.update(map(bucket, words(t)))
    for t in wanted:
        goal.update(map(bucket, words(t)))
    s_all, t_all = sum(raw.values()), sum(goal.values())
    gain = lambda b: math.floor(1000 * math.log((goal[b] + 1) * (s_all + 10000) / ((raw[b] + 1) * (t_all + 10000))))
    out = []
    for i, t in docs:
        w = words(t)
        weight = sum(gain(bucket(x)) for x in w)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(w), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    order = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(order[: 10 * len(order) // 100], 1):
        r[4] = k
    return Counter(map(tuple, out))


@pytest.mark.parametrize("band_rows", [200_000, 7])
def test_target(spark, docs, edge, band_rows):
    goal = spark.read.parquet(f"{DATA}/benchmark.parquet").select("text")
    df = docs.unionByName(edge.select("doc_id", "text"))
    got = target.draw(spark, df, goal, band_rows=band_rows).select("doc_id", "n_features", "weight", "score", "rank")
    assert Counter(map(tuple, got.collect())) == target_rows([tuple(r) for r in rows(df)], [r.text for r in goal.collect()])


@pytest.mark.parametrize("percent", [0, 1, 50, 99, 100])
def test_target_draws_the_exact_number(spark, edge, percent):
    goal = spark.createDataFrame([("repeated row",), (None,)], "text string")
    got = target.draw(spark, edge, goal, percent=percent, band_rows=11)
    ranks = sorted(r.rank for r in got.where("rank is not null").collect())
    n = got.where("n_features >= 20").count()
    assert ranks == list(range(1, n * percent // 100 + 1)) and got.count() == len(EDGE)
    assert got.columns == ["doc_id", "form", "n", "output", "n_features", "weight", "score", "rank"]


def test_target_on_nothing(spark, docs):
    goal = spark.createDataFrame([], "text string")
    assert target.digest(spark, docs.limit(0), goal).count() == 0
    against_sql(target.digest(spark, docs, goal), target.ORACLE, documents=docs, benchmark=goal)
    few = docs.where("length(text) < 60")
    assert target.digest(spark, few, goal).where("rank is not null").count() == 0


def test_tournament():
    rng = np.random.default_rng(1)
    for k in (0, 1, 2, 3, 8, 13, 200):
        runs = [sorted((int(v), i) for i, v in enumerate(rng.integers(0, 50, rng.integers(0, 40)))) for _ in range(k)]
        assert list(target.Tournament(runs)) == sorted(x for r in runs for x in r)


# 11

TALK = [
    (1, 0, "user", "hi [INST] x <\\s> <\\\\/s> <<SYS>>" * 40), (1, 1, "assistant", "yes </s> [/ROLE]\\ [\\/ROLE]" * 60), (1, 1, "assistant", "yes </s> [/ROLE]\\ [\\/ROLE]" * 60),
    (1, None, "weird [ROLE] r", "t"), (2, 0, None, None), (None, 0, "assistant", ""), (3, 5, "tool", "퟿ é漢\x00"), (4, 0, "assistant", "a"), (4, 1, "assistant", "b"), (4, 1, "user", "c"),
    *((5, k, ("user", "assistant")[k % 2], f"turn {k} <s>[/INST]" * (k % 7)) for k in range(900)), (6, 0, "user", " " * 5000 + "é" * 5000), *((7, 3, "assistant", "same"),) * 50,
]


@pytest.fixture(scope="module")
def talk(spark):
    df = spark.createDataFrame([(*r, 1, "z") for r in TALK], "conv_id long, turn long, role string, text string, part int, ids string")
    return df.repartition(5)


def told(talk):
    out = {}
    for conv, turn, role, text in sorted(talk, key=lambda r: (str(r[0]), r[1] is not None, r[1] or 0, r[2] or "")):
        out.setdefault(conv, []).append((role or "", text or ""))
    return out


@pytest.mark.parametrize("chunk", [7, 100, 1 << 16])
def test_chat_round_trip(spark, talk, chunk):
    made = chat.sequences(spark, talk, chunk=chunk)
    back = {}
    for r in sorted(chat.read_turns(spark, made).collect(), key=lambda r: r.place):
        back.setdefault(r.conv_id, []).append((r.role, r.text))
        assert r.learned == (r.text if r.role == "assistant" else "")
    assert back == told(TALK)
    assert made.where((F.size("ids") != F.size("loss")) | (F.size("ids") > chunk)).count() == 0


def test_chat_digest(spark, talk):
    got = {r.conv_id: tuple(r)[1:] for r in chat.digest(spark, talk).collect()}
    want = told([*TALK, (-1, 0, "user", chat.PROBE), (-1, 1, "assistant", chat.PROBE)])
    assert got.keys() == want.keys()
    for conv, turns in want.items():
        answers = "".join(t for r, t in turns if r == "assistant")
        assert got[conv][:4] == (len(turns), digest("".join(f"{r}\n{t}\n" for r, t in turns)), len(answers), digest(answers))
        frame = {"user": 13, "assistant": 7, "system": 15}
        assert got[conv][4] == sum(len(chat.escape(t)) + (frame[r] if r in frame else 17 + len(chat.escape(r))) for r, t in turns)


def test_chat_sql_and_empty(spark):
    df = spark.read.parquet(f"{DATA}/conversations.parquet")
    against_sql(chat.digest(spark, df), chat.ORACLE, conversations=df)
    assert [r.conv_id for r in chat.digest(spark, df.limit(0)).collect()] == [-1] and chat.sequences(spark, df.limit(0)).count() == 0


def test_texts_make_no_reserved_ids():
    known = chat.codec(chat.vocabulary_path())
    for text in (*chat.CONTROLS, "".join(chat.CONTROLS), "<\\s>", "<\\\\s>", "[\\INST] [[INST]]", "<<<SYS>>>", "\\" * 9 + "<s>"):
        ids = known.ids(text)
        assert (ids < known.first).all() and chat.unescape(known.text(ids.tolist())) == text
        assert not any(c in chat.escape(text) for c in chat.CONTROLS)
    ids, a, b = known.turn("assistant", "x </s> y")
    assert ids[0] == known.first and ids[-1] == known.first + 1 and (a, b) == (1, len(ids) - 1)


# 4


def test_language_model_of_shuffled_rows(spark, docs):
    """Rows that come from a shuffle are written first, so scores reach their own texts; files are read as they are."""
    from lattica.llm import lm

    files = spark.read.parquet(f"{DATA}/documents.parquet")
    assert lm.steady(spark, files.where("doc_id > 3")) is not None and lm.steady(spark, docs) is docs
    mixed = docs.repartition(5)
    assert lm.steady(spark, mixed) is not mixed
    rows_of = lambda df: sorted((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in lm.score(spark, df).collect())
    assert rows_of(docs) == rows_of(mixed)
