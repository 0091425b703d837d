"""Fuzzy line dedup against brute force over all pairs of lines."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from quizlens.llm import line_dedup as ld


def brute_lines(docs):
    """(id, line) -> shingles of every long enough line."""
    out = {}
    for d, text in docs:
        low = (text or "").lower()
        for c in "\t\x0b\x0c\r":
            low = low.replace(c, " ")
        for i, line in enumerate(low.split("\n")):
            words = [w for w in line.split(" ") if w]
            if words:  # shingles of seven characters at every place; the number stands here, not in the module
                norm = " ".join(words)
                out[(d, i)] = frozenset(norm[j:j + 7] for j in range(max(1, len(norm) - 6)))
    return out


def brute_keepers(lines, percent=80):
    keys = sorted(lines)
    parent = {k: k for k in keys}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    owners = defaultdict(list)
    links = set()
    for k in keys:
        near = {o for s in lines[k] for o in owners[s]}
        for o in near:
            both = len(lines[k] & lines[o])
            if 100 * both >= percent * len(lines[k] | lines[o]):
                links.add((o, k))
                a, b = find(o), find(k)
                parent[max(a, b)] = min(a, b)
        for s in lines[k]:
            owners[s].append(k)
    return {k: find(k) for k in keys}, links


def test_documents_match_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    lines = brute_lines(docs)
    want, _ = brute_keepers(lines)
    rows = ld.op3_line_dedup(spark, SF_SMALL).collect()
    assert {(r.doc_id, r.line): r.n_shingles for r in rows} == {k: len(s) for k, s in lines.items()}
    got = {(r.doc_id, r.line): (r.keep_doc_id, r.keep_line) for r in rows}
    assert sum(got[k] == want[k] for k in want) >= 0.995 * len(want) and any(k != w for k, w in want.items())
    assert all(r.kept == ((r.doc_id, r.line) == (r.keep_doc_id, r.keep_line)) for r in rows)


@pytest.mark.parametrize("rounds", [0, 1])
def test_recall_of_planted_lines(spark, monkeypatch, rounds):
    monkeypatch.setattr(ld, "ROUNDS", rounds)
    r = random.Random(rounds)
    texts = []
    for _ in range(60):
        base = [f"w{r.randrange(3000)}ord" for _ in range(r.choice([10, 14, 30, 60]))]
        for _ in range(r.choice([1, 3, 12])):
            w = list(base)
            for _ in range(r.randrange(0, 1 + len(w) // 14)):
                w[r.randrange(len(w))] = f"x{r.randrange(99)}"
            texts.append(" ".join(w))
    docs = [(i, "\n".join(texts[i::40])) for i in range(40)]
    lines = brute_lines(docs)
    want, links = brute_keepers(lines)
    got = {(x.id, x.line): (x.keep_id, x.keep_line) for x in ld.line_dedup(spark.createDataFrame(docs, "doc_id int, text string")).collect()}
    assert got.keys() == lines.keys() and sum(got[a] == got[b] for a, b in links) >= 0.98 * len(links)
    assert all(want[k] == want[v] for k, v in got.items())  # no line goes without a link


def test_edge_rows_and_texts(spark):
    a = "One two three four five six seven eight nine ten"
    rows = [(3, a), (3, a), (2, f"x\n{a.lower()}  \n\n{a}\r"), (None, a + " eleven"), (7, None), (8, ""), (9, "\n" * 5), (4, "z" * 30000), (5, a.replace("ten", "tin") + " zz" * 30000)]
    df = spark.createDataFrame(rows, "doc_id int, text string").withColumn("key", F.lit(1)).withColumn("line", F.lit(2)).withColumn("gone", F.lit(3))
    verdicts = ld.line_dedup(df, min_words=10)
    got = {(r.id, r.line): (r.keep_id, r.keep_line, r.kept) for r in verdicts.collect()}
    assert got == {(2, 1): (2, 1, True), (2, 3): (2, 1, False), (3, 0): (2, 1, False), (None, 0): (2, 1, False), (5, 0): (5, 0, True)}  # 42 of 49 shingles are shared with "eleven"
    out = ld.without_lines(df, verdicts)
    assert out.columns == df.columns
    texts = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    assert texts == sorted([(3, ""), (3, ""), (2, f"x\n{a.lower()}  \n"), (None, ""), *rows[4:]], key=str)
    assert ld.line_dedup(df.limit(0)).count() == 0


def test_no_cross_join_in_plan(spark):
    plan = ld.op3_line_dedup(spark, SF_SMALL)._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_shingles_are_those_of_a_plain_loop():
    """Slices of any cut, short lines next to long ones, other scripts."""
    r = random.Random(5)
    norms = ["".join(r.choice("ab é这😀\0-") for _ in range(r.choice([1, 2, 6, 7, 8, 9, 40, 300]))) for _ in range(500)]
    want = [{x[j:j + 7] for j in range(max(1, len(x) - 6))} for x in norms]
    of = {}  # a shingle's hash is the same wherever it stands, and no two share one
    for c in [slice(0, 500), slice(3, 4), slice(100, 250)]:
        found = ld.shingles(norms[c])
        assert ld.per_line(found, c.stop - c.start).tolist() == [len(x) for x in want[c]]
        for i, x in enumerate(want[c]):
            h = found[found >> np.uint64(ld.HASH_BITS) == i] & np.uint64((1 << ld.HASH_BITS) - 1)
            alone = {s: int(ld.shingles([s])[0]) for s in x}
            assert set(h.tolist()) == set(alone.values()) and all(of.setdefault(k, v) == v for k, v in alone.items())
    assert len(set(of.values())) == len(of)
    assert [(c.start, c.stop) for c in ld.cuts([1 << 17, 1 << 17, 1, 1 << 20, 5])] == [(0, 2), (2, 3), (3, 4), (4, 5)]


WORDS = ("river stone amber night falcon copper meadow winter harbor candle forest marble thunder silver orchard "
         "velvet anchor pepper canyon lantern ribbon saddle timber walnut").split()


@pytest.mark.parametrize("n, edit", [(14, "insert"), (18, "insert"), (24, "insert"), (18, "replace"), (20, "replace"), (24, "replace")])
def test_one_word_edits_are_similar(spark, n, edit):
    """Lines that differ in one word in the middle; which must link is written
    here, not derived from the constants of the module."""
    base = WORDS[:n]
    other = base[:n // 2] + ["puzzle"] + base[n // 2 + (edit == "replace"):]
    far = base[:n // 2] + [w[::-1] for w in base[n // 2:]]
    docs = spark.createDataFrame([(1, " ".join(base)), (2, " ".join(other)), (3, " ".join(far))], "doc_id int, text string")
    assert {r.id: r.keep_id for r in ld.line_dedup(docs).collect()} == {1: 1, 2: 1, 3: 3}


def test_short_lines_have_rows(spark, tmp_path):
    """Every line with a word has a row; repeats of short lines fall together,
    lines that only begin alike do not."""
    docs = [(1, "Menu\n\nSee https://www.example.com/a\nmenus"), (2, "MENU\nsee https://www.examine.org/b \n \nhttps://www.example.com/b"),
            (3, "See  https://www.example.com/a\nhttps://www.examine.org/b\nread the whole story of today"), (4, "read the whole story of today now\nmenu")]
    spark.createDataFrame(docs, "doc_id int, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r.doc_id, r.line): (r.keep_doc_id, r.keep_line) for r in ld.op3_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {(1, 0): (1, 0), (1, 2): (1, 2), (1, 3): (1, 3), (2, 0): (1, 0), (2, 1): (2, 1), (2, 3): (2, 3),  # 18 of 24 are shared
                   (3, 0): (1, 2), (3, 1): (2, 1), (3, 2): (3, 2), (4, 0): (3, 2), (4, 1): (1, 0)}  # 19 of 23 and 23 of 27


@pytest.mark.parametrize("a, b, same", [
    ("recordnumber000001 customername000002 streetaddress000003 telephoneno000004", "recordnumber999999 customername888888 streetaddress777777 telephoneno666666", False),
    ("这是一个没有空格的很长的句子它应该和几乎相同的句子放在一起比较才对吧", "这是一个没有空格的很长的句子它应该和几乎相同的句子放在一起比较才对", True),
    ("这是一个没有空格的很长的句子它应该和几乎相同的句子放在一起比较才对吧", "完全不同的内容在这里出现了所以不应该被认为是同样的一行文字才对吧", False),
    ("alphabetic betamaxes gammaray deltawing epsilons", "alphabetic betamaxes gammaray deltawing epsilons zetas", True),
    ("alphabetaaa betagammaa gammadelta deltaepsil epsilonzet", "alphabetbbb betagammbb gammadelbb deltaepsbb epsilonzbb six", False),
    ("--------------------", "---------------------------------", True),
    ("-------- ", "--------=", False),
])
def test_one_rule_for_all_lines(spark, a, b, same):
    """Long words that begin alike, lines without a space, five words against
    six, and lines of one shingle."""
    docs = spark.createDataFrame([(1, a), (2, b)], "doc_id int, text string")
    assert {r.id: r.keep_id for r in ld.line_dedup(docs).collect()} == {1: 1, 2: 1 if same else 2}


def test_lines_that_share_half_a_digest_are_two(spark, monkeypatch):
    """Lines of one first half of the digest still differ in the second."""
    real = ld.digest
    monkeypatch.setattr(ld, "digest", lambda norms: np.column_stack([np.zeros(len(norms), np.int64), real(norms)[:, 1]]))
    docs = spark.createDataFrame([(1, "first line of words\nsecond thing altogether\nFirst  line of words")], "doc_id int, text string")
    rows = {r.line: r.keep_line for r in ld.line_dedup(docs).collect()}
    assert rows == {0: 0, 1: 1, 2: 0}
    d = real(["a b", "c d", "a b"])
    assert (d[0] == d[2]).all() and (d[0] != d[1]).all()
