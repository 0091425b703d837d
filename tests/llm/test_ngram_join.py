"""Similarity join against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_MID
from quizlens.llm import ngram_join as nj
from quizlens.llm.common import Scratch
from quizlens.llm.components import connected_components

WS = " \t\n\x0b\x0c\r"


def brute_sets(texts, k):
    out = []
    for t in texts:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        for c in WS:
            low = low.replace(c, " ")
        w = [x for x in low.split(" ") if x]
        out.append({tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    return out


def brute_components(ids, sets, percent):
    parent = {i: i for i in range(len(ids))}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    owners = {}
    for i, s in enumerate(sets):
        for x in s:
            owners.setdefault(x, []).append(i)
    for i, s in enumerate(sets):
        for j in {j for x in s for j in owners[x] if j > i}:
            both = len(s & sets[j])
            if 100 * both >= percent * len(s | sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    least = {}
    for i, d in enumerate(ids):
        r = find(i)
        least[r] = min(least.get(r, d), d)
    return {d: least[find(i)] for i, d in enumerate(ids)}


def near_copies(seed, n=260):
    """Groups of copies at all distances around the threshold, of all sizes, and a shared passage."""
    r = random.Random(seed)
    passage = [f"p{i}" for i in range(60)]
    texts = []
    while len(texts) < n:
        base = [f"w{r.randrange(2000)}" for _ in range(r.choice([1, 3, 5, 8, 12, 20, 40, 62, 66, 70, 75, 120, 130, 250, 260, 600]))]
        if r.random() < 0.3:
            base = base + passage
        for _ in range(r.choice([1, 2, 6])):
            w = list(base)
            for _ in range(r.randrange(0, 2 + len(w) // 25)):
                at = r.randrange(len(w))
                w[at:at + 1] = r.choice([[], [f"x{r.randrange(99)}"], [w[at], "y"]])
            texts.append(" ".join(w))
    return texts


@pytest.mark.parametrize("k,percent", [(4, 85), (5, 80)])
def test_documents_match_brute_force(spark, k, percent):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_MID}/documents.parquet").collect()}
    sets = brute_sets(docs.values(), k)
    want = brute_components(list(docs), sets, percent)
    rows = nj.ngram_join(spark.read.parquet(f"{SF_MID}/documents.parquet"), k, percent).collect()
    assert {r.id: r.n_shingles for r in rows} == {d: len(s) for d, s in zip(docs, sets)}
    assert {r.id: r.component_id for r in rows} == want and sum(d != c for d, c in want.items()) > 50


@pytest.mark.parametrize("seed", [1, 2])
def test_planted_distances(spark, monkeypatch, seed):
    monkeypatch.setattr(nj, "BLOCK", 5)  # many blocks a key
    monkeypatch.setattr(nj, "ROUNDS", 0)  # leave work to the trees
    texts = near_copies(seed)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    want = brute_components(list(range(len(texts))), brute_sets(texts, 4), 85)
    assert {r.id: r.component_id for r in nj.ngram_join(df).collect()} == want


@pytest.mark.parametrize("percent", [75, 80, 85, 95])
def test_keys_lose_no_pair(percent):
    r = np.random.default_rng(percent)
    for n in [2, 3, 6, 7, 20, 50, 63, 64, 65, 75, 76, 100, 127, 128, 140, 255, 256, 257, 500, 1000, 4000]:
        for _ in range(30):
            a = np.unique(r.integers(0, 1 << 64, n, np.uint64))
            gone = r.integers(0, len(a) * (100 - percent) // 100 + 1)
            b = np.delete(a, r.choice(len(a), gone, replace=False))
            both = len(b)
            room = both * 100 // percent - len(a)  # union at most both * 100 / percent
            b = np.union1d(b, r.integers(0, 1 << 64, r.integers(0, max(room, 0) + 1), np.uint64))
            if not np.array_equal(a, b) and 100 * both >= percent * len(np.union1d(a, b)):
                assert len(np.intersect1d(nj.keys(a, percent), nj.keys(b, percent))), (n, len(b))
                m = nj.folded([nj.bitmap(a).tobytes(), nj.bitmap(b).tobytes()])
                assert nj.possible(np.array([len(a)]), np.array([len(b)]), m[:1], m[1:], percent)[0]


def test_dual_traversal_is_complete_and_prunes():
    r = np.random.default_rng(3)
    sets = []
    for _ in range(120):
        base = r.integers(0, 1 << 64, r.integers(5, 300), np.uint64)
        sets += [np.unique(np.concatenate([base[r.random(len(base)) > x], r.integers(0, 1 << 64, 2, np.uint64)])) for x in (0, 0.02, 0.1)]
    size, bits = np.array([len(s) for s in sets]), nj.folded([nj.bitmap(s).tobytes() for s in sets])
    comp = np.arange(len(sets)) // 2
    t = nj.SignatureTree(size, bits, comp)
    got = {tuple(sorted(p)) for i, j in nj.dual_traversal(t, t, 85) for p in zip(i.tolist(), j.tolist())}
    want = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if comp[i] != comp[j]
            and 100 * (b := len(np.intersect1d(sets[i], sets[j]))) >= 85 * (len(sets[i]) + len(sets[j]) - b)}
    assert want <= got and len(got) < 20 * len(want)
    half = np.arange(len(sets)) % 7 == 0
    x, y = nj.SignatureTree(size[half], bits[half], comp[half]), nj.SignatureTree(size[~half], bits[~half], comp[~half])
    a, b = np.flatnonzero(half), np.flatnonzero(~half)
    across = {tuple(sorted(p)) for i, j in nj.dual_traversal(x, y, 85) for p in zip(a[i].tolist(), b[j].tolist())}
    assert {p for p in want if half[p[0]] != half[p[1]]} <= across


def test_edge_rows(spark):
    rows = [(5, None), (6, ""), (7, " \n"), (8, "one"), (9, "ONE"), (9, "ONE"), (None, "one"), (3, "É x"), (2, "é x"), (1, "a b c d e " * 20000), (None, "zz")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("key", F.lit(1)).withColumn("node", F.lit("n"))
    got = [(r.id, r.n_shingles, r.component_id) for r in nj.ngram_join(df).collect()]
    assert sorted(got, key=str) == sorted([(5, 0, 5), (6, 0, 6), (7, 0, 7), (8, 1, 8), (9, 1, 8), (9, 1, 8), (None, 1, 8), (3, 1, 3), (2, 1, 2),
                                           (1, 5, 1), (None, 1, None)], key=str)
    assert nj.ngram_join(df.limit(0)).count() == 0


def test_connected_components(spark):
    r = random.Random(4)
    edges = [(i, i + 1) for i in range(0, 300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(r.randrange(2000, 2400), r.randrange(2000, 2400)) for _ in range(300)] + [(7, 7)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {x.node: x.root for x in connected_components(spark.createDataFrame(edges, "a bigint, b bigint"), Scratch(spark)).collect()}
    assert got == {n: find(n) for n in parent}


def test_tables_go_when_they_are_read(spark):
    """Keys, exact sets and what leads to them do not lie on disk to the end; the result needs none of them."""
    docs = spark.createDataFrame(list(enumerate(near_copies(3, 60))), "doc_id long, text string")
    s = Scratch(spark)
    out = nj.ngram_join(docs, 4, 85, scratch=s)
    assert not {n.split("-")[0] for n in s.paths} & {"signatures", "shared", "need", "filter", "sets"}
    assert out.count() == docs.count()


def test_sets_of_one_hash_stay_apart(spark, monkeypatch):
    """Different sets whose digests have the same hash are different nodes."""
    texts, real = near_copies(4, 60), F.xxhash64
    monkeypatch.setattr(F, "xxhash64", lambda *c: F.pmod(real(*c), F.lit(40)) if str(c[0]) == "digest" else real(*c))
    got = nj.ngram_join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 4, 85).collect()
    assert {r.id: r.component_id for r in got} == brute_components(range(len(texts)), brute_sets(texts, 4), 85)
