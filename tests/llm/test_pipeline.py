"""The pipeline's stages against brute force."""

import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lattica.llm import pii, quality

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    """Input and output of each stage."""
    docs, out = spark.read.parquet(f"{DATA}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, DATA).cache()
        out.append((name, docs, made))
        docs = made
    return out


def ids(df):
    return {r.doc_id for r in df.select("doc_id").collect()}


def test_columns_and_order(stages):
    assert [n for n, *_ in stages] == ["quality_rules", "simhash_near_dedup", "decontamination", "personal_data", "best_fit_packing"]
    for _, before, after in stages[:-1]:
        assert after.columns == before.columns


def test_quality(stages):
    _, before, after = stages[0]
    assert ids(after) == ids(quality.digest(before).where("kept"))


def test_near_dedup(stages):
    _, before, after = stages[1]
    shingles = {}
    for r in before.collect():
        w = r.text.lower().split()
        shingles[r.doc_id] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
    keep, gone = ids(after), ids(before) - ids(after)
    best = lambda i: max(len(shingles[i] & shingles[j]) / len(shingles[i] | shingles[j]) for j in shingles if j != i)
    assert all(best(i) >= 0.8 for i in gone)  # no clean document goes
    equal = {}
    for r in before.collect():
        equal.setdefault(r.text, []).append(r.doc_id)
    assert all(len(set(g) & keep) <= 1 for g in equal.values())


def test_decontamination(stages, spark):
    _, before, after = stages[2]
    words = lambda t: re.findall(r"[^\W_]+", t.lower())
    items = [words(r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    grams = lambda w: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
    want = {r.doc_id for r in before.collect() if not any(len(grams(i) & grams(words(r.text))) >= 0.8 * len(grams(i)) for i in items)}
    assert ids(after) == want and len(want) < before.count()


def test_personal_data(stages, spark):
    _, before, after = stages[3]
    assert ids(before) == ids(after)
    left = pii.digest(spark, after).agg(*(F.sum(f"n_{k}") for k in pii.KINDS[:4])).first()
    assert not any(left)


def test_packing(stages):
    _, before, after = stages[4]
    assert ids(after) == ids(before)
    assert after.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 4096").count() == 0


def test_run_is_all_stages(spark, stages):
    assert corpus_pipeline.run(spark, DATA).count() == stages[-1][2].count()


def test_near_dedup_is_jaccard_of_shingles(stages):
    """One document of each component of the true links (5-word shingles, Jaccard >= 0.8), no other goes."""
    _, before, after = stages[1]
    rows = sorted((r.doc_id, tuple(r.text.lower().encode().split())) for r in before.select("doc_id", "text").collect())
    sets = [{w[i : i + 5] for i in range(max(1, len(w) - 4))} for _, w in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)) and 5 * (both := len(a & b)) >= 4 * (len(a) + len(b) - both):
                x, y = top(i), top(j)
                root[max(x, y)] = min(x, y)
    assert ids(after) == {rows[top(i)][0] for i in range(len(rows))}


#: Null ids and texts, repeated rows, empty and blank texts, a long text; and names that stages work with.
ODD = [(1, None), (2, ""), (3, " \n"), (None, "one two"), (None, None), (4, "one two three"), (4, "one two three"), (5, "call +1 (555) 555-1234 now " * 3000), (6, "word " * 20_000)]


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_on_odd_rows(spark, name, stage):
    """Each stage keeps its columns, whatever they are called, and neither fails nor makes rows up."""
    df = spark.createDataFrame([(i, t, "en", "s", 1, 2.0, "k") for i, t in ODD], "doc_id long, text string, lang string, source string, n_chars int, size double, item_id string").repartition(2)
    out = stage(spark, df, DATA)
    rows = out.collect()
    if name == "best_fit_packing":
        assert {r.doc_id for r in rows} == {i for i, _ in ODD} and sum(r.piece == 0 for r in rows) == len(ODD)
    else:
        assert out.columns == df.columns and len(rows) <= len(ODD)
        assert {r.doc_id for r in rows} <= {i for i, _ in ODD}
    if name == "simhash_near_dedup":
        assert sorted((r.doc_id is None, r.doc_id or 0) for r in rows) == [(False, 1), (False, 4), (False, 5), (False, 6), (True, 0)]
    if name == "personal_data":
        text = {r.doc_id: r.text for r in rows}
        assert len(rows) == len(ODD) and text[1] is None and text[5] == "call [PHONE] now " * 3000
    assert stage(spark, df.limit(0), DATA).count() == 0


def test_pipeline_of_nothing(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    docs.limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{DATA}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_long_chains_are_walked_in_blocks(spark, monkeypatch):
    """A planted paragraph in all texts chains them; groups are the same, no task walks more than two blocks."""
    import numpy as np

    from lattica.llm import shingles

    rng = np.random.default_rng(4)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 4))
    common = [word() for _ in range(60)]
    texts = []
    for k in range(70):
        own = [word() for _ in range(int(rng.integers(5, 40)))]
        texts.append([*common, *own])
        for _ in range(k % 4):  # near copies, links of links among them
            last = list(texts[-1])
            last[int(rng.integers(60, len(last)))] = word()
            texts.append(last)
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in texts]
    root = list(range(len(texts)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 5 * (both := len(a & b)) >= 4 * (len(a) + len(b) - both):
                x, y = top(i), top(j)
                root[max(x, y)] = min(x, y)
    df = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(texts)], "doc_id long, text string")
    monkeypatch.setattr(shingles, "BLOCK", 8)
    got = {r.doc_id: r.component_id for r in shingles.groups(spark, df).collect()}
    assert got == {k: top(k) for k in range(len(texts))} and 1 < len(set(got.values())) < len(texts)


def test_runs_of_shingles_are_not_held(monkeypatch):
    """Runs that pass COMMON, over many batches, with repeats: each row once, one count for a run."""
    import numpy as np
    import pyarrow as pa

    from lattica.llm import shingles

    monkeypatch.setattr(shingles, "COMMON", 10)
    rng = np.random.default_rng(2)
    rows = sorted([(g, int(k)) for g, n in ((1, 1), (2, 2), (3, 9), (4, 95), (5, 3), (6, 41), (7, 1), (8, 10)) for k in rng.integers(0, 60, n)])
    for size in (1, 3, 7, 1000):
        parts = [rows[k : k + size] for k in range(0, len(rows), size)]
        batches = [pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*p)], ["gram", "key"]) for p in parts]
        got = sorted((r["gram"], r["key"], r["texts"]) for b in shingles._shared(iter(batches)) for r in b.to_pylist())
        keys = {g: {k for h, k in rows if h == g} for g in range(1, 9)}
        assert got == sorted((g, k, min(len(keys[g]), 10)) for g in keys for k in keys[g] if len(keys[g]) > 1)


def test_near_dedup_links_by_fingerprints(spark, monkeypatch):
    """Candidates come from SimHash fingerprints: of texts that are linked, none is when no bit may differ."""
    import numpy as np

    from lattica.llm import shingles, simhash

    rng = np.random.default_rng(8)
    texts = []
    for n in (30, 60, 400, 3000):
        texts.append([f"w{k}" for k in rng.integers(0, 5000, n)])
        texts.append([*texts[-1][:-1], "other"])
    df = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(texts)], "doc_id long, text string")
    groups = lambda: [r.component_id for r in sorted(shingles.groups(spark, df).collect())]
    assert groups() == [0, 0, 2, 2, 4, 4, 6, 6]
    kept = shingles.walk(np.array([3, 3]), [np.arange(3)] * 2, np.array([[0, 0, 0, 0], [2**64 - 1, 2**33 - 1, 0, 0]], np.uint64))
    assert kept.tolist() == [0, 1]  # 97 bits differ
    found = []
    links = simhash.links
    monkeypatch.setattr(simhash, "links", lambda *args: found.append(links(*args)) or found[-1])
    groups()
    assert len(found) == 1 and found[0].count() >= 1  # the index of deletion variants is asked


def test_fingerprints_lose_no_link():
    """Distances of sets at a Jaccard of 4/5, of few and of many shingles, stay far below the radius; unrelated ones do not."""
    import numpy as np

    from lattica.llm import shingles, simhash

    rng = np.random.default_rng(3)
    far, apart = 0, 256
    for common in [4] * 300 + [8] * 200 + [40] * 100 + [400] * 50 + [70_000]:
        x = rng.integers(-(2**63), 2**63 - 1, common + common // 4)
        a, b, c = (simhash.sketch(v, 4) for v in (x, x[:common], rng.integers(-(2**63), 2**63 - 1, common)))
        bits = lambda p, q: int.from_bytes(p).__xor__(int.from_bytes(q)).bit_count()
        far, apart = max(far, bits(a, b)), min(apart, bits(a, c) if common > 8 else 256)
    assert far <= 80 and apart > shingles.RADIUS - 10
    assert simhash.sketch(np.zeros(0, np.int64), 4) == bytes(32)
    whole = rng.integers(-(2**63), 2**63 - 1, 70_001)
    assert simhash.sketch(whole, 4) == simhash.sketch(rng.permutation(whole), 4)
