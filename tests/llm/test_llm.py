"""The training-data operators against brute force, on small tables and on edge cases."""

import hashlib
import re
import zlib
from collections import Counter
from math import log10

import duckdb
import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from lattica.llm import decontaminate, licenses, lm, packing, pii, quality, resample, sharding, simhash, toxicity

DATA = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORDS = re.compile("[^\x20\x09-\x0d]+").findall
#: Null and empty texts, blanks, repeated rows, a null id, a very long text, odd characters, personal
#: data in odd places, license lines.
EDGE = [
    (1, None), (2, ""), (3, " \t\n\x0b\f\r "), (4, "one"), (4, "one"), (None, "one two three four"), (None, None), (5, "word " * 30_000),
    (6, "A b C d e f g h\nA b C d e f g h\n\n \nz"), (7, "Été K İ naïve \x1cfoo\x1dbar \x85q\xa0r 漢字 <|endoftext|>x don't"),
    (8, "a@b.co_c@d.ee 1.2.3.4.5 300.1.1.1 001.255.0.255; 4111 1111-1111 1111; 4111111111111112; +1 (555) 555-1234; +123"),
    (9, "1" * 40_000 + " 2 +" + "3" * 20), (10, "MIT License, mit license. Apache License; CC BY 4.0\nGNU General Public License v3"),
    (11, "f f leading f\n\nf\nf"), (12, "x" * 5000), (13, "ff the The THE the of of the the of of"),
]


@pytest.fixture(scope="module")
def edge(spark):
    """With further columns whose names clash with working names."""
    return spark.createDataFrame([(i, t, "en", 7, "y", 2.0) for i, t in EDGE], "doc_id long, text string, shard string, size int, fp string, score double").repartition(3)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{DATA}/labels.parquet")


def both(docs, edge):
    return docs.select("doc_id", "text").unionByName(edge.select((F.col("doc_id") + 1_000_000).alias("doc_id"), "text"))


def rows(df):
    return df.select("doc_id", "text").collect()


def counted(found, want):
    assert Counter(found) == Counter(want)


# 9


def quality_row(text):
    t = text or ""
    w = WORDS(t)
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = {j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORDS(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(hit)


def test_quality(docs, edge):
    df = both(docs, edge)
    got = quality.digest(df).collect()
    counted([(r.doc_id, *r[1:6]) for r in got], [(i, *quality_row(t)) for i, t in rows(df)])
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.kept and r.base_failed)


def test_quality_is_exact_when_hashes_meet(docs, edge, monkeypatch):
    """With two bits of hash all long texts hold different windows under one part."""
    monkeypatch.setattr(quality, "PLACE_BITS", 62)
    df = both(docs.limit(60), edge.where("doc_id != 5 or doc_id is null"))
    counted([(r.doc_id, *r[1:6]) for r in quality.digest(df).collect()], [(i, *quality_row(t)) for i, t in rows(df)])


def test_quality_filter_keeps_columns(edge, docs):
    out = quality.filter_documents(edge)
    assert out.columns == edge.columns and out.count() == 0
    kept = {r.doc_id for r in quality.digest(docs).where("kept").collect()}
    assert {r.doc_id for r in quality.filter_documents(docs).collect()} == kept and kept
    assert quality.filter_documents(docs.limit(0)).count() == 0 and quality.digest(docs.limit(0)).count() == 0


def test_texts_in_other_letters_need_no_stop_words(spark):
    rng = np.random.default_rng(1)
    word = lambda low, n: "".join(chr(low + k) for k in rng.integers(0, n, 5))
    texts = [" ".join(word(low, n) for _ in range(150)) for low, n in ((0x430, 30), (0x4E00, 900), (0x62, 24))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id for r in quality.digest(df).where("kept").collect()} == {0, 1}


def test_quality_oracle(docs):
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{DATA}/documents.parquet'")
    a, b = quality.digest(docs).toPandas(), c.sql(quality.ORACLE).df()
    pd.testing.assert_frame_equal(*(x.sort_values("doc_id")[sorted(x.columns)].reset_index(drop=True) for x in (a, b)), check_dtype=False)


# 8


def license_row(text):
    w, at, found = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER)), [], set()
    for phrase, label in licenses.BASE.items():
        p = phrase.split()
        for k in range(len(w) - len(p) + 1):
            if w[k : k + len(p)] == p:
                at.append(k)
                found.add(label)
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(found))


def test_licenses(docs, edge):
    df = both(docs, edge)
    got = licenses.digest(df).collect()
    counted([tuple(r)[:6] for r in got], [(i, *license_row(t)) for i, t in rows(df)])
    for r in got:
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) or not r.base_labels
        assert 0 <= r.score <= 1 and (r.score > 0) == bool(r.labels)
    assert licenses.digest(docs.limit(0)).count() == 0 and len(licenses.rules()) > 400


def matches(rx, rng):
    """A text that an expression matches, drawn from its parts."""
    from re import _constants as c
    from re import _parser

    def of(items):
        out = ""
        for op, arg in items:
            if op is c.LITERAL:
                out += chr(arg)
            elif op is c.IN:
                kind, value = rng.choice(arg)
                out += chr(value) if kind is c.LITERAL else "x"
            elif op is c.BRANCH:
                out += of(rng.choice(arg[1]))
            elif op is c.SUBPATTERN:
                out += of(arg[3])
            else:
                low, high, inner = arg
                out += "".join(of(inner) for _ in range(rng.choice([low, min(high, low + 1)])))
        return out

    return of(_parser.parse(rx))


def test_license_rules_are_distinct_and_gated():
    """No expression occurs twice, and each keyword stands in all texts that its rule matches."""
    import random

    rng, found = random.Random(1), licenses.rules()
    assert len({rx for *_, rx in found}) == len(found) and len({r[2] for r in found}) > 180
    for _, _, label, keyword, rx in found:
        for text in {matches(rx, rng) for _ in range(40)}:
            assert re.fullmatch(rx, text) and f" {keyword} " in f" {text} ", (label, text)


def test_license_rules_against_plain_matching(spark, docs):
    """Labels of the corpus and of a text for each rule, against all rules tried on every text."""
    import random

    rng, found = random.Random(2), licenses.rules()
    planted = [(5000 + k, f"Words before, {matches(rx, rng)} and, after it: {matches(found[(7 * k) % len(found)][4], rng)}.") for k, (*_, rx) in enumerate(found)]
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame(planted, "doc_id long, text string"))
    compiled = [(p, conf, label, re.compile(f" (?:{rx})(?= )")) for p, conf, label, _, rx in found]
    got = {r.doc_id: (r.labels, r.score) for r in licenses.digest(df).collect()}
    for doc_id, text in rows(df):
        x = " " + " ".join(re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").lower())) + " "
        spans = [(m.start(), m.end(), p, label, conf) for p, conf, label, rx in compiled for m in rx.finditer(x)]
        kept = [a for a in spans if not any((b[0] <= a[0] and a[1] <= b[1] and b[2] <= a[2]) and (b[:3] != a[:3] or b[3] < a[3]) for b in spans)]
        base = {label for phrase, label in licenses.BASE.items() if f" {phrase} " in x}
        assert got[doc_id][0] == ",".join(sorted(base | {k[3] for k in kept})), (doc_id, text[-200:])
        assert got[doc_id][1] == max([0.9] * bool(base) + [k[4] for k in kept], default=0.0)


def test_license_texts(spark):
    texts = {
        "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated files",
        "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that",
        "bsd-3-clause": "Neither the name of the Foo Project nor the names of its contributors may be used to endorse or promote products",
        "apache-2.0": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS",
        "unlicense": "This is free and unencumbered software released into the public domain.",
        "cc-by-sa-4.0": "see https://creativecommons.org/licenses/by-sa/4.0/",
        "zlib": "The origin of this software must not be misrepresented",
        "gpl-3.0-or-later": "the GNU General Public License as published by the FSF, either version 3 of the License, or (at your option) any later version",
        "": "a clean text about open windows, apple trees and the public garden",
    }
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts.values())], "doc_id long, text string")
    got = {r.doc_id: r.labels.split(",") for r in licenses.digest(df).collect()}
    assert all(label in got[k] for k, label in enumerate(texts)) and got[len(texts) - 1] == [""]


def test_license_containment(spark):
    df = spark.createDataFrame([(1, "Licensed under the Apache License, Version 2.0"), (2, "SPDX-License-Identifier: GPL-3.0-only"), (3, "cc by-nc-sa 4.0"), (4, "the apache tribe")], "doc_id long, text string")
    found = {r.doc_id: r.labels for r in licenses.digest(df).collect()}
    assert found == {1: "apache,apache-2.0", 2: "gpl-3.0", 3: "cc-by,cc-by-nc-sa-4.0", 4: "apache"}


# 2


def pii_spans(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        g = re.sub("[^0-9]", "", m[0])
        if 12 <= len(g) <= 19 and sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(g[::-1])) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


def test_pii(spark, docs, edge):
    df = both(docs, edge)
    want = []
    for i, t in rows(df):
        s = pii_spans(t or "")
        listed = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in s)
        want.append((i, *(sum(k == j for _, k, _ in s) for j in range(4)), hashlib.sha256(listed.encode()).hexdigest()))
    got = pii.digest(spark, df).collect()
    counted([tuple(r)[:6] for r in got], want)
    for r in got:
        base = [f"{k}" for k in r.spans.split(",") if k.split(":")[0] in pii.KINDS[:4]]
        assert len(base) >= r.n_email + r.n_ip + r.n_card + r.n_phone


def test_redaction(spark, edge, docs):
    out = pii.redact(edge, pii.fit(docs))
    assert out.columns == edge.columns and out.count() == len(EDGE)
    text = {r.doc_id: r.text for r in out.collect()}
    assert text[1] is None and text[2] == "" and text[4] == "one"
    assert "4111 1111" not in text[8] and "@" not in text[8] and "[PHONE]" in text[8] and "300.1.1.1" in text[8]
    assert pii.fit(docs.limit(0)).trees == [] and pii.digest(spark, docs.limit(0)).count() == 0


def secrets(spark):
    """Values behind a key word, long plain words, and a bare value of the same look as the first."""
    rng, out = np.random.default_rng(5), []
    for k in range(400):
        value = "".join(rng.choice(list("0123456789abcdef"), 40))
        word = "".join(rng.choice(list("abcdefghij"), 30))
        out.append((k, f"number 7 some words here token = {value} and more {k}"))
        out.append((1000 + k, f"number 7 here {word} is a long word {k}"))
    out.append((5000, "number 7 here " + "0a1b2c3d4e" * 4 + " stands alone"))
    return spark.createDataFrame(out, "doc_id long, text string")


def test_boosting_follows_labels(spark):
    """A bare value is chosen where values of its look stand behind key words, and not where the words say nothing."""
    spans = lambda df: {r.doc_id: r.spans for r in pii.digest(spark, df).collect()}
    got = spans(secrets(spark))
    assert got[5000] == "secret:14:54" and got[1000] == "" and got[0].startswith("secret:")
    assert not set(pii.FEATURES) & {"valid", "digits", "context"}


def test_shuffled_labels_change_spans(spark):
    """The same candidates with labels dealt at random: no cell reaches the precision, nothing bare is added."""
    found = pii.candidates(secrets(spark))
    mixed = found.withColumn("__p_c", F.expr("transform(__p_c, c -> named_struct('k', c.k, 's', c.s, 'e', c.e, 'v', c.v, 'y', (xxhash64(__p_t, c.s) & 1) = 1, " + ", ".join(f"'f_{n}', c.f_{n}" for n in pii.FEATURES) + "))"))
    true, random = pii.boost(found), pii.boost(mixed)
    assert true.report["secret"][2] > 100 and random.report["secret"][2] == 0
    alone = lambda m: pii.choose(found, m).where("doc_id = 5000").select(F.size("__p_all")).first()[0]
    assert (alone(true), alone(random)) == (1, 0)


def test_spans_are_added_by_their_scores_alone(spark):
    """With no score ever high enough, spans of sf0.01 change: only those of the base rules are left."""
    from dataclasses import replace

    found = pii.candidates(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")).cache()
    model = pii.boost(found)
    added = lambda m: {(r.doc_id, k) for r in pii.choose(found, m).select("doc_id", "__p_all", "__p_base").collect() for k in r["__p_all"] if k not in r["__p_base"]}
    on, off = added(model), added(replace(model, thresholds=(1.1,) * len(pii.KINDS)))
    assert on and not off


def test_added_kinds_are_found(spark):
    """Planted secrets: behind words, in published forms, and bare ones of the same look, among long words; at
    least nine of ten are found and no word is."""
    rng = np.random.default_rng(8)
    pick = lambda letters, n: "".join(rng.choice(list(letters), n))
    low, up, plain = "0123456789abcdef", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnop"
    out, want = [], {}
    for k in range(900):
        value, lead = ((pick(low, 40), "token = "), ("a1" + pick(low, 18), "password="), ("AKIA7" + pick(up, 15), ""), ("7b" + pick(low, 38), ""), (pick(plain, 22), ""))[k % 5]
        if k % 5 == 3 and k > 100:  # few bare ones
            continue
        out.append((k, f"some text of row {k} with {lead}{value} and more of it"))
        want[k] = (k % 5 != 4, value)
    got = {r.doc_id: r.spans for r in pii.digest(spark, spark.createDataFrame(out, "doc_id long, text string")).collect()}
    hit = [bool(got[k]) for k, (true, _) in want.items() if true]
    assert np.mean(hit) >= 0.9 and not any(got[k] for k, (true, _) in want.items() if not true)


def test_pii_of_very_long_texts(spark):
    """A million digits, and a hundred thousand matches."""
    import time

    many = "a@b.co 1.2.3.4 " * 50_000
    df = spark.createDataFrame([(1, "1" * 1_000_000), (2, "1." * 300_000), (3, many)], "doc_id long, text string")
    began = time.time()
    got = {r.doc_id: r for r in pii.digest(spark, df).collect()}
    assert time.time() - began < 120
    assert (got[3].n_email, got[3].n_ip) == (50_000, 50_000)
    listed = ",".join(f"{k}:{15 * i + a}:{15 * i + b}" for i in range(50_000) for k, a, b in (("email", 0, 6), ("ip", 7, 14)))
    assert got[3].base_sha256 == hashlib.sha256(listed.encode()).hexdigest() and got[2].n_ip == 75_000
    out = pii.redact(df.where("doc_id = 3"), pii.Model()).first().text
    assert out == "[EMAIL] [IP] " * 50_000


# 7


def fingerprint(text):
    w = WORDS((text or "").translate(LOWER))
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    if not s:
        return 0
    bits = sum(np.unpackbits(np.array([xxhash.xxh64_intdigest(x.encode(), 42)], ">u8").view("u1")).astype(int) for x in s)
    return int("".join("1" if 2 * b > len(s) else "0" for b in bits), 2)


def linked(prints, most):
    """Smallest id reachable, by comparing all pairs."""
    ids, root = sorted(prints), {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and bin(prints[a] ^ prints[b]).count("1") <= most:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_simhash(spark, docs, edge):
    extra = [(2_000_000 + k, "a b c d e f g h i j k l m n o p " + "q" * (k % 3)) for k in range(6)]
    df = both(docs, edge).where("doc_id is not null").dropDuplicates(["doc_id"]).unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    prints = {i: fingerprint(t) for i, t in rows(df)}
    got = {r.doc_id: r for r in simhash.digest(spark, df).collect()}
    assert {i: int(r.fingerprint, 16) for i, r in got.items()} == prints
    assert {i: r.component_id for i, r in got.items()} == linked(prints, 3)


@pytest.mark.parametrize("config", [simhash.Config(), simhash.Config(bits=128, max_bits=11), simhash.Config(max_bits=6)])
def test_simhash_links_keep_components(spark, config):
    """Random fingerprints around few centers, and more of them than are compared pair by pair."""
    rng, prints = np.random.default_rng(1), set()
    for _ in range(4):
        center = int.from_bytes(rng.bytes(config.bits // 8), "big")
        for _ in range(60):
            x = center
            for b in rng.choice(config.bits, rng.integers(0, config.max_bits + 2), replace=False):
                x ^= 1 << int(b)
            prints.add(x)
    key = {x: k for k, x in enumerate(sorted(prints))}
    fps = spark.createDataFrame([(bytearray(x.to_bytes(config.bits // 8, "big")),) for x in prints], "fp binary")
    got = simhash.components(spark, simhash.links(spark, fps, config)).collect()
    found = {key[int.from_bytes(r.node, "big")]: key[int.from_bytes(r.root, "big")] for r in got}
    assert {k: found.get(k, k) for k in key.values()} == linked({k: x for x, k in key.items()}, config.max_bits)


def test_deduplicate(spark, edge):
    out = simhash.deduplicate(spark, edge)
    assert out.columns == edge.columns
    assert sorted(r.doc_id for r in out.collect() if r.doc_id in (1, 2, 3, 4)) == [1, 4]
    assert simhash.deduplicate(spark, edge.limit(0)).count() == 0 and simhash.digest(spark, edge.limit(0)).count() == 0


# 6


def test_decontamination(spark, docs):
    bench = spark.read.parquet(f"{DATA}/benchmark.parquet")
    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())

    def held(item, text):
        n = min(5, len(item))
        a = {tuple(item[i : i + n]) for i in range(len(item) - n + 1)}
        b = {tuple(text[i : i + n]) for i in range(len(text) - n + 1)}
        return bool(a) and len(a & b) >= 0.8 * len(a)

    items = bench.collect()
    whole = items[0].text
    planted = spark.createDataFrame([(9001, "lead in " + whole + " and out"), (9002, whole.upper()), (9003, " ".join(whole.split()[: len(whole.split()) // 2])), (9004, None), (9005, ""), (None, whole), (9006, "w " * 20_000 + whole)], "doc_id long, text string")
    df = docs.select("doc_id", "text").unionByName(planted)
    found = {(r.doc_id, r.item_id) for r in decontaminate.search(spark, df, bench).collect()}
    texts = [(r.doc_id, words(r.text)) for r in df.collect()]
    want = {(i, b.item_id) for i, t in texts for b in items if held(words(b.text), t)}
    assert found == want and {(i, items[0].item_id) for i in (9001, 9002, 9006, None)} <= found
    kept = decontaminate.clean(spark, df.withColumn("item_id", F.lit(1)), bench)
    assert kept.columns == ["doc_id", "text", "item_id"]
    assert {r.doc_id for r in kept.collect()} == {i for i, _ in texts} - {i for i, _ in want}
    assert decontaminate.search(spark, df, bench.limit(0)).count() == 0 and decontaminate.search(spark, df.limit(0), bench).count() == 0


def test_decontamination_in_parts(spark, docs, monkeypatch):
    bench = spark.read.parquet(f"{DATA}/benchmark.parquet")
    rounded = lambda: sorted((r.doc_id, r.item_id, round(r.score, 6), r.first_word) for r in decontaminate.search(spark, docs, bench).collect())
    whole = rounded()
    monkeypatch.setattr(decontaminate, "PART_BYTES", 3000)
    assert rounded() == whole and whole


def test_decontamination_misses_no_overlap(spark):
    """Items whose rare words all lie in the part that is cut off are retrieved as long as 0.8 of the shingles are there."""
    common = [f"w{k}" for k in range(40)]
    items = [(k, " ".join(common + [f"rare{k}x{j}" for j in range(9)])) for k in range(30)]
    texts = [(k, " ".join(t.split()[: len(t.split()) - cut])) for k, t in items for cut in [k % 10]]
    bench, docs = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(texts, "doc_id long, text string")
    grams = lambda t: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)}
    want = {(i, j) for i, t in texts for j, x in items if len(grams(t) & grams(x)) >= 0.8 * len(grams(x))}
    assert {(r.doc_id, r.item_id) for r in decontaminate.search(spark, docs, bench).collect()} == want and len(want) > 30


# 5


def test_packing(spark, docs, edge):
    from tokenizers import Tokenizer

    df = both(docs, edge)
    got = packing.digest(spark, df).toPandas()
    tok, want = Tokenizer.from_file(packing.tokenizer_path()), []
    for i, t in rows(df):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want += [(i, k // 4096, k, len(ids[k : k + 4096]), zlib.crc32(ids[k : k + 4096].tobytes())) for k in range(0, len(ids), 4096)]
    clean = lambda x: None if x is None or x != x else int(x)
    counted([tuple(map(clean, r)) for r in got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False)], want)
    for _, x in got.sort_values("offset").groupby("sequence_id"):
        assert x.length.sum() <= 4096 and list(x.offset) == [0, *x.length.cumsum()[:-1]]
    assert got.sequence_id.nunique() <= -(-got.length.sum() // 4096) * 1.02 + 1
    assert packing.digest(spark, docs.limit(0)).count() == 0


def sequential(counts, room=4096):
    """Sequences that best fit, longest first, one piece after another, opens."""
    gaps = np.zeros(room + 1, int)
    opened = 0
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            near = np.flatnonzero(gaps[length:])
            gap = length + int(near[0]) if len(near) else room
            opened += not len(near)
            gaps[gap] -= bool(len(near))
            gaps[gap - length] += gap > length
    return opened


@pytest.mark.parametrize("low, high, n", [(1, 4097, 6000), (1, 40, 30_000), (1366, 1367, 3000), (4096, 4097, 50), (2000, 2100, 2000)])
def test_packing_rounds(spark, low, high, n):
    """Every piece has a place, places are gapless, and there are at most 1 % (and 1) more sequences than one after another."""
    counts = {int(k): int(v) for k, v in zip(*np.unique(np.random.default_rng(2).integers(low, high, n), return_counts=True))}
    got = packing.rounds(spark, spark.createDataFrame(list(counts.items()), "length int, n long"))
    pieces = []
    for length in counts:
        own = got[got[:, 0] == length]
        own = own[np.argsort(own[:, 1])]
        assert own[0, 1] == 0
        for (_, rank, first, offset, q), end in zip(own, [*own[1:, 1], counts[length]]):
            pieces += [(first + k // q, offset + k % q * length, length) for k in range(end - rank)]
    assert len(pieces) == n
    pieces.sort()
    for (s, o, length), (s2, o2, _) in zip(pieces, pieces[1:]):
        assert o2 == (o + length if s == s2 else 0) and o + length <= 4096
    assert len({s for s, *_ in pieces}) <= sequential(counts) * 1.01 + 1


# 1


def test_sharding(spark, docs, edge):
    df = both(docs, edge)
    got = sharding.digest(spark, df).toPandas()
    counted(zip(got["size"], got.text_crc32), [(len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for _, t in rows(df)])
    assert set(got.law) == {"bytes"} and got.grown_shard.isna().all() and got.shard.between(0, 39).all()
    assert all(sorted(x) == list(range(len(x))) for _, x in got.groupby("shard").slot)
    load = got.groupby("shard")["size"].sum().reindex(range(40), fill_value=0)
    assert load.max() <= load.sum() / 40 + got["size"].max()
    assert sharding.digest(spark, docs.limit(0)).count() == 0


def test_sharding_edits_the_stored_map(spark, docs, tmp_path):
    """The first run deals slots blindly and balances them; a later run edits what is stored, and moves few slots."""
    path = str(tmp_path / "map")
    first = sharding.digest(spark, docs, path=path).toPandas()
    assert set(first.map_version) == {2} and sharding.SlotMap.load(spark, path, 1).shard_of[:80] == tuple(range(40)) * 2
    more = docs.unionByName(docs.limit(20).withColumn("doc_id", F.col("doc_id") + 10_000_000))
    second = sharding.digest(spark, more, path=path).toPandas()
    stored = [sharding.SlotMap.load(spark, path, v) for v in (2, int(second.map_version[0]))]
    assert stored[1].version >= 2 and len(stored[0].moves(stored[1])) < 200
    for got in (first, second):
        load = got.groupby("shard")["size"].sum()
        assert len(load) == 40 and load.max() <= load.sum() / 40 + got["size"].max()


def test_slot_map_versions(spark, tmp_path):
    rng = np.random.default_rng(3)
    load = {k: int(v) for k, v in enumerate(rng.integers(1, 1000, sharding.SLOTS))}
    first = sharding.SlotMap.fresh(load, 10)
    assert max(first.loads(load)) - min(first.loads(load)) < 2000
    load = {k: v * (5 if first.shard_of[k] == 3 else 1) for k, v in load.items()}
    second = first.balanced(load)
    assert second.version == 2 and max(second.loads(load)) < 1.02 * sum(load.values()) / 10
    third = second.grown(load)
    assert third.version == 3 and third.shards == 11 and {b for _, _, b in second.moves(third)} == {10}
    assert abs(third.loads(load)[10] - sum(load.values()) / 11) < 0.05 * sum(load.values()) / 11
    for m in (first, second, third):
        m.save(spark, str(tmp_path / "map"))
    assert sharding.SlotMap.load(spark, str(tmp_path / "map")) == third and sharding.SlotMap.load(spark, str(tmp_path / "map"), 1).shard_of == first.shard_of


# 3


def test_resampling(spark, docs, labels):
    drawn = resample.draw(spark, docs, labels)
    n = docs.count()
    assert drawn.count() == -(-7 * n // 10)
    weights = resample.keyed(resample.weigh(spark, docs, resample.models(spark, docs, resample.targets(labels)))).collect()
    best = sorted(weights, key=lambda r: -r.rank_bits)[: drawn.count()]
    assert {r.doc_id for r in drawn.collect()} == {r.doc_id for r in best}
    bad = {r.doc_id for r in labels.where("quality = 0").collect()} & {r.doc_id for r in docs.collect()}
    good = {r.doc_id for r in labels.where("quality = 1").collect()} & {r.doc_id for r in docs.collect()}
    kept = {r.doc_id for r in drawn.collect()}
    assert len(kept & good) / len(good) > 0.7 and len(kept & bad) / max(1, len(bad)) < 0.3
    by_weight = {r.doc_id for r in sorted(weights, key=lambda r: -r.log_weight)[: drawn.count()]}
    assert len(kept & by_weight) < drawn.count()  # chance has a say


def test_draws_follow_weights(spark):
    """Over 6,000 seeds: first draws in proportion to the weights, pairs as drawn without replacement."""
    w = {1: 1.0, 2: 2.0, 3: 4.0, 4: 8.0, 5: 1.0}
    table = spark.createDataFrame([(i, 0, 1, float(np.log(x))) for i, x in w.items()], "doc_id long, crc long, n_grams long, log_weight double")
    seeds, n = spark.range(6000).withColumnRenamed("id", "seed"), 6000
    keys = resample.keyed(table.withColumn("x", F.lit(1)).join(seeds.withColumn("x", F.lit(1)), "x"), F.col("seed"))
    first = Counter(r.d[0] for r in keys.groupBy("seed").agg(F.expr("transform(slice(reverse(array_sort(collect_list(struct(rank_bits, doc_id)))), 1, 2), x -> x.doc_id)").alias("d")).collect())
    total = sum(w.values())
    for i, x in w.items():
        assert abs(first[i] / n - x / total) < 4 * np.sqrt(x / total / n)
    both_ = Counter(frozenset(r.d) for r in keys.groupBy("seed").agg(F.expr("transform(slice(reverse(array_sort(collect_list(struct(rank_bits, doc_id)))), 1, 2), x -> x.doc_id)").alias("d")).collect())
    want = lambda a, b: w[a] / total * w[b] / (total - w[a]) + w[b] / total * w[a] / (total - w[b])
    for a, b in ((3, 4), (1, 2), (1, 5)):
        assert abs(both_[frozenset((a, b))] / n - want(a, b)) < 4 * np.sqrt(want(a, b) / n)


def test_resampling_ties_at_the_cut(spark):
    """Equal rows share a key; the cut falls among them and takes as many as are left."""
    same = spark.createDataFrame([(7, "same words here")] * 10 + [(8, "other")], "doc_id long, text string")
    drawn = resample.draw(spark, same, spark.createDataFrame([], "doc_id long, quality int"), 0.5)
    assert drawn.count() == 6


def test_resampling_models_and_edges(spark, edge, docs, labels):
    ids = resample.targets(labels, 5)
    ratio = resample.models(spark, docs, ids)
    raw, target, chosen = np.ones(resample.BUCKETS), np.ones(resample.BUCKETS), {r.doc_id for r in ids.collect()}
    for i, t in rows(docs):
        b = np.bincount(resample.grams(t).astype(int), minlength=resample.BUCKETS)
        raw += b
        target += b * (i in chosen)
    assert np.allclose(ratio, np.log(target / target.sum()) - np.log(raw / raw.sum()))
    assert resample.draw(spark, edge, labels, 0.5).count() == 8
    assert resample.draw(spark, edge, labels.limit(0)).count() == -(-7 * len(EDGE) // 10)
    assert resample.draw(spark, edge.limit(0), labels).count() == 0


# 4


@pytest.mark.parametrize("head", [3, 10_000])
def test_language_model(spark, docs, edge, monkeypatch, head):
    monkeypatch.setattr(lm, "HEAD", head)
    df = both(docs, edge)
    texts = [(i, [*WORDS((t or "").translate(LOWER)), "\n"]) for i, t in rows(df)]
    out = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    c = Counter(x for i, w in texts if not out(i) for x in w)
    n, v = sum(c.values()), len(c)
    want = Counter((i, out(i), len(w), sum(x in c for x in w), n, round(sum(log10((c[x] + 1) / (n + v + 1)) for x in w), 4)) for i, w in texts)
    got = lm.digest(spark, df).collect()
    assert Counter((*tuple(r)[:5], round(r.base_score, 4)) for r in got) == want
    per = lambda k: sum(r[k] for r in got if r.held_out) / sum(r.n_tokens for r in got if r.held_out)
    assert per("score") > per("base_score") and all(r.score <= 0 for r in got)


def test_filter_counts_are_one_sided():
    rng = np.random.default_rng(4)
    h = np.unique(rng.integers(0, 1 << 63, 20_000).astype(np.uint64) * np.uint64(2))
    true = np.minimum(rng.zipf(1.5, len(h)), 1 << 30)
    held = lm.Levels(h, true)
    got, floor = held.counts(h), 2.0 ** np.log2(true).astype(int)
    assert (got >= floor).all() and (got == floor).mean() > 0.95
    assert (held.counts(h + np.uint64(1) ^ np.uint64(1 << 40)) > 0).mean() < 0.05
    assert (lm.Levels(h[:0], true[:0]).counts(h) == 0).all()


def test_language_model_of_nothing(spark, docs):
    assert lm.digest(spark, docs.limit(0)).count() == 0
    one = docs.limit(3).withColumn("doc_id", F.lit(3).cast("long"))  # crc32 of "3" leaves another remainder
    assert lm.digest(spark, one).count() == 3


@pytest.mark.parametrize("head, part", [(150_000, 4_000_000), (20, 2_000), (0, 500)])
def test_scores_are_those_of_all_counts(spark, docs, edge, monkeypatch, head, part):
    """Against chances from exact quantised counts, with all words, few or none broadcast, in few parts or many."""
    monkeypatch.setattr(lm, "HEAD", head)
    monkeypatch.setattr(lm, "PART", part)
    df = docs.select("doc_id", "text").unionByName(edge.where("doc_id in (1, 2, 4, 7, 13)").dropDuplicates(["doc_id"]).select((F.col("doc_id") + 1_000_000).alias("doc_id"), "text"))
    texts = {i: [b"\n", *lm.tokens((t or "").encode())] for i, t in rows(df)}
    taught = [w for i, w in texts.items() if not lm.is_held_out(i)]
    one, two = Counter(x for w in taught for x in w[1:]), Counter(p for w in taught for p in zip(w, w[1:]))
    low = lambda c: 2.0 ** int(np.log2(c)) if c else 0.0
    n = sum(one.values()) + len(one) + 1
    chance = lambda a, b: (low(two[a, b]) + lm.MU * (low(one[b]) + 1) / n) / (low(one[a]) + lm.MU)
    got = {r.doc_id: r.score for r in lm.digest(spark, df).collect()}
    want = {i: sum(log10(chance(*p)) for p in zip(w, w[1:])) for i, w in texts.items()}
    off = [abs(got[i] - want[i]) / len(texts[i]) for i in want]
    assert got.keys() == want.keys() and np.mean(off) < 0.02 and np.median(off) < 0.01  # false positives of the filters


# 10


def test_toxicity(spark, edge, labels):
    big = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    marks = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = toxicity.digest(spark, big, marks).join(marks, "doc_id").toPandas()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got.doc_id]).all()
    assert (got.predicted == (got.score >= 0.3)).all() and got.score.between(0, 1).all()
    held = got[got.held_out]
    rank, toxic = held.score.rank(), held.toxic == 1
    assert (rank[toxic].sum() - toxic.sum() * (toxic.sum() + 1) / 2) / (toxic.sum() * (~toxic).sum()) > 0.8
    weights = toxicity.fit(spark, big, marks)
    assert len(weights) < 5000 and weights == toxicity.fit(spark, big, marks)
    out = toxicity.score(spark, edge, weights).collect()
    assert len(out) == len(EDGE) and all(0 <= r.score <= 1 for r in out)
    assert toxicity.digest(spark, edge, labels.limit(0)).select("score").distinct().collect()[0].score == 0.5
    assert toxicity.digest(spark, big.limit(0), marks).count() == 0


def test_held_out_rows_teach_nothing(spark):
    big = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    marks = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    flipped = marks.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")).cast("int"))
    assert toxicity.fit(spark, big, marks) == toxicity.fit(spark, big, flipped)


def test_toxicity_is_ftrl_proximal(spark):
    """The weights of the operator against the update rule written out coordinate by coordinate, and its scores
    against features written out text by text."""
    rng, words = np.random.default_rng(2), [f"w{k}" for k in range(12)] + ["insulting", "insults"]
    docs = [(k, " ".join(rng.choice(words, rng.integers(0, 9)))) for k in range(500)]
    df = spark.createDataFrame([*docs, (900, None), (901, "word " * 40_000)], "doc_id long, text string")
    marks = spark.createDataFrame([(k, int("insult" in t)) for k, t in docs], "doc_id long, toxic int")

    def features(text):
        w = re.findall(r"[^\W_]+", (text or "").lower())
        h = lambda x, seed: xxhash.xxh64_intdigest(x.encode(), seed)
        one = [h(x, 7) for x in w]
        out = one + [h(x[:5], 11) if len(x) > 5 else h(x, 7) for x in w]
        for gap in (1, 2):
            for a, b in zip(one, one[gap:]):
                left = (a * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64
                out.append((left ^ (b * (2 * gap + 1) % 2**64)) * 0xBF58476D1CE4E5B9 % 2**64)
        return sorted({x >> 44 for x in out})

    order = {r.doc_id: r.t for r in df.select("doc_id", F.xxhash64("doc_id").alias("t")).collect()}
    taught = sorted((i for i, _ in docs if zlib.crc32(str(i).encode()) % 4 != 2), key=lambda i: order[i])
    texts, z, n = dict(docs), Counter(), Counter()
    l1 = lambda i: toxicity.L1 if i < 2**20 else 0.0
    weight = lambda i: 0.0 if abs(z[i]) <= l1(i) else -(z[i] - l1(i) * np.sign(z[i])) / ((toxicity.BETA + np.sqrt(n[i])) / toxicity.ALPHA + toxicity.L2)
    for _ in range(toxicity.EPOCHS):
        for i in taught:
            x = [*features(texts[i]), 2**20]
            g = 1 / (1 + np.exp(-sum(map(weight, x)))) - ("insult" in texts[i])
            for k, w in [(k, weight(k)) for k in x]:
                z[k] += g - (np.sqrt(n[k] + g * g) - np.sqrt(n[k])) / toxicity.ALPHA * w
                n[k] += g * g
    want = {k: weight(k) for k in z if weight(k)}
    got = toxicity.fit(spark, df, marks)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want) and len(want) > 3
    scores = {r.doc_id: r.score for r in toxicity.score(spark, df, got).collect()}
    for i, t in df.collect():
        assert abs(scores[i] - 1 / (1 + np.exp(-sum(want.get(k, 0.0) for k in [*features(t), 2**20])))) < 1e-9


def test_toxicity_is_fitted_beside_long_and_repeated_texts(spark):
    """A text of a million words early in the order, and an id with thousands of rows, leave the model fitted."""
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 5))
    out = [(k, " ".join(["vile"] * (k % 2) + [word() for _ in range(30)])) for k in range(1200)]
    marks = spark.createDataFrame([(k, k % 2) for k in range(1200)] + [(9001, 0), (9002, 1)], "doc_id long, toxic int")
    long_ = " ".join(f"{w}{k}" for k in range(200) for w in (word() for _ in range(5000)))
    df = spark.createDataFrame([*out, (9001, long_)], "doc_id long, text string")
    many = spark.range(5000).select(F.lit(9002).cast("long").alias("doc_id"), F.concat(F.lit("vile row "), "id").alias("text"))
    weights = toxicity.fit(spark, df.unionByName(many), marks)
    scores = {r.doc_id: r.score for r in toxicity.score(spark, df, weights).collect()}
    odd, even = (np.array([scores[k] for k in range(r, 1200, 2)]) for r in (1, 0))
    assert odd.min() > even.max() and len(toxicity.fit_places(long_)) == toxicity.FIT_PLACES
