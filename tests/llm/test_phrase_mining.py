"""Collocations against counting in plain Python."""

import random
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from conftest import SF_MID
from quizlens.llm import common
from quizlens.llm import phrase_mining as pm

LOWER = {c: c + 32 for c in range(65, 91)}


def brute(docs, threshold=10, top=2000, longest=3):
    f, n = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            f.update((lang, *words[i:i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1))
    found = {p: a for p, a in f.items() if len(p) > 2 and a >= threshold}
    hidden = Counter()
    for p, a in found.items():
        for k in range(2, len(p) - 1):
            for i in range(1, len(p) - k + 1):
                inner = (p[0], *p[i:i + k])
                hidden[inner] = max(hidden[inner], a)
    by_lang = {}
    for p, a in found.items():
        if 100 * hidden[p] >= 50 * a and hidden[p]:
            continue
        cuts = [(10 ** 6 * a * a // (f[p[:k + 1]] * f[(p[0], *p[k + 1:])]), k) for k in range(1, len(p) - 1)]
        score, k = min(cuts)
        phrase = " ".join(p[1:])
        by_lang.setdefault(p[0], []).append((-score, -a, phrase.encode(), phrase, a, f[p[:k + 1]], f[(p[0], *p[k + 1:])], score))
    out = []
    for lang, rows in by_lang.items():
        out += [(lang, i + 1, r[3], r[4], r[5], r[6], n[lang], r[7]) for i, r in enumerate(sorted(rows)[:top])]
    return sorted(out)


def found(df):
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in df.collect())


def test_query_matches_brute_force(spark):
    docs = [(r.lang, r.text) for r in spark.read.parquet(f"{SF_MID}/documents.parquet").collect()]
    assert found(pm.op13_phrase_mining(spark, SF_MID)) == brute(docs)


@pytest.mark.parametrize("shards, bits", [(1, 16), (2, 16), (4, 16), (5, 1)])
def test_cycles_and_full_filters(spark, monkeypatch, shards, bits):
    """Any number of shards gives the same; so do filters that let much through."""
    monkeypatch.setattr(pm, "SHARDS", shards)
    monkeypatch.setattr(pm.frequent, "__defaults__", (shards,))
    if bits == 1:
        monkeypatch.setattr(common, "MAX_FILTER_BITS", 1 << 6)
    r = random.Random(shards)
    words = [f"w{int(30 * r.random() ** 3)}" for _ in range(9000)]
    docs = [(r.choice(["x", "y", None]), " ".join(words[i:i + 40]) + r.choice([".", "\n", "", "!? "])) for i in range(0, 9000, 37)]
    df = spark.createDataFrame(docs, "lang string, text string").repartition(5)
    want = brute(docs, threshold=7)
    assert found(pm.collocations(df, threshold=7)) == want and len(want) > 100
    if shards == 2:
        assert found(pm.collocations(df, max_words=4, threshold=5, top=30)) == brute(docs, 5, 30, 4)


def test_odd_rows(spark):
    docs = [(None, "A b A b a B, c"), ("und", "a b\ta b"), ("en", None), ("en", ""), ("en", " .;!\n\t"), ("é", "ÄB äb äB. " * 12),
            ("a\tb", "x\x00y z " * 20), ("l", "q " * 60000), ("l", "日本 語 " * 15)] * 3
    df = spark.createDataFrame(docs, "lang string, text string").selectExpr("*", "1 as shard", "2 as h", "3 as `a.b`", "4 as phrase")
    assert found(pm.collocations(df)) == brute(docs)
    assert pm.collocations(df.limit(0)).count() == 0
    assert pm.collocations(df.where("lang = 'en'")).count() == 0


def test_scores_beyond_64_bits(spark):
    a = 3 * 10 ** 12
    got = spark.range(1).select(F.lit(a).alias("a"), F.lit(a + 1).alias("l"), F.lit(a + 2).alias("r")).selectExpr(
        "(1000000 * cast(a as decimal(19,0)) * cast(a as decimal(19,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0))) s").first().s
    assert got == 10 ** 6 * a * a // ((a + 1) * (a + 2))


def test_filter_has_every_key(spark):
    keys = spark.range(5000).select(F.xxhash64("id").alias("h"))
    f = pm.filter_of(keys, 5000)
    h = np.array([r.h for r in keys.collect()], np.int64).view(np.uint64)
    assert f(h).all() and f(np.random.default_rng(1).integers(0, 2 ** 63, 5000, dtype=np.uint64)).mean() < 0.1


def test_sql_is_the_same_rule():
    con = duckdb.connect()
    con.sql("create table documents(lang varchar, text varchar)")
    docs = [("en", "In fact, in fact it is. In fact it was" + " so" * k) for k in range(15)] + [(None, "a b c. " * 11)]
    con.executemany("insert into documents values (?, ?)", docs)
    rel = con.sql(pm.SQL)
    assert sorted(tuple(dict(zip(rel.columns, r))[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in rel.fetchall()) == brute(docs)


def test_tally_combines_and_stays_small(monkeypatch):
    """Occurrences are combined as they come: a task holds the distinct ones, not all, and passes on small batches."""
    monkeypatch.setattr(pm, "RAW", 100)
    monkeypatch.setattr(pm, "ROWS_OUT", 64)
    rng, tally, all_ = np.random.default_rng(1), pm.Tally(), []
    for _ in range(200):
        h = rng.integers(0, 300, 50, dtype=np.uint64) << np.uint64(55)
        all_.append(h)
        tally.add(h)
        assert sum(map(len, tally.raw)) <= 150 and len(tally.h) <= 300
    tally.combine()
    got = list(tally.batches())
    assert max(b.num_rows for b in got) <= 64 and not len(tally.h)
    h, n = np.unique(np.concatenate(all_).view(np.int64), return_counts=True)
    assert dict(zip(h.tolist(), n.tolist())) == {k: v for b in got for k, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist())}
    empty = pm.Tally()
    empty.combine()
    assert not list(empty.batches())


def test_a_slice_keeps_its_words_in_arrow():
    """Distinct words are never a list of Python strings, nor are the counted phrases."""
    x = pm.Slice("en", [b"A b. a\tb;b", b"\xc3\xa9 a"])
    assert isinstance(x.words, pa.Array) and x.words[0].as_py() == "a"
    names = x.words.to_pylist()
    assert ["|" if i < 0 else names[i] for i in x.ids.tolist()] == ["a", "b", "|", "a", "b", "|", "b", "|", "é", "a"]
