"""The pipeline's stages, one by one and together, against brute force."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from conftest import SF_MID, SF_SMALL
from quizlens.llm import mix_sources as ms
from test_ngram_join import brute_components, brute_sets
from test_tokens import check_pieces, reference  # noqa: F401

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What each stage returned over the documents, as its successor reads it."""
    out = [spark.read.parquet(f"{SF_MID}/documents.parquet")]
    for name, f in cp.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "t")
        f(spark, out[-1], SF_MID).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def test_columns(stages):
    assert len(cp.STAGES) == 5 and all(s.columns == COLUMNS for s in stages[:5])


def test_language_keeps_clean_documents(stages):
    before, after = stages[0].count(), stages[1].count()
    assert 0.99 * before <= after <= before


def test_exact_keeps_one_of_each_text(stages):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    least = {}
    for r in stages[1].collect():
        least[norm(r.text)] = min(r.doc_id, least.get(norm(r.text), r.doc_id))
    assert sorted(r.doc_id for r in stages[2].collect()) == sorted(least.values())


def test_near_keeps_one_of_each_component(stages):
    rows = stages[2].collect()
    comp = brute_components([r.doc_id for r in rows], brute_sets([r.text for r in rows], 5), 80)
    assert sorted(r.doc_id for r in stages[3].collect()) == sorted(d for d, c in comp.items() if d == c)
    assert stages[3].count() < len(rows)


def test_near_keeps_one_with_repeated_or_null_ids(spark):
    """Near copies that share the smallest id, or have no id at all."""
    text = {c: " ".join(f"{c}{i}" for i in range(60)) for c in "abcd"}
    rows = [(1, text["a"]), (1, text["a"] + " one"), (2, text["a"] + " two"), (None, text["b"]), (None, text["b"] + " one"),
            (None, text["c"]), (None, text["c"] + " one"), (3, text["d"]), (None, text["d"] + " one"), (1, "no copy of it"), (None, ""), (None, None)]
    left = [(r.doc_id, (r.text or "")[:1]) for r in cp.near(spark, spark.createDataFrame(rows, "doc_id bigint, text string"), SF_SMALL).collect()]
    assert Counter(left) == Counter([(1, "a"), (None, "b"), (None, "c"), (3, "d"), (1, "n"), (None, ""), (None, "")])


def test_mix_and_packing(stages, reference):  # noqa: F811
    sizes, taken = Counter(), Counter()
    for rows, c in ((stages[3].collect(), sizes), (stages[4].collect(), taken)):
        for r in rows:
            c[r.source] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
    df = stages[0].sparkSession.createDataFrame(list(sizes.items()), "source string, size bigint")
    want = {r.source: r.target for r in ms.targets(df, (5, 2, 1), 3).collect()}
    assert all(abs(taken[s] - want[s]) <= 0.1 * want[s] for s in want)
    copies = Counter(r.doc_id for r in stages[4].collect())
    pieces = stages[5].collect()
    assert sum(r.length for r in pieces) == sum(copies[r.doc_id] * (len(reference(r.text)) + 1) for r in stages[3].collect())
    assert max(Counter((r.doc_id, r.start) for r in pieces if r.start == 0).values()) == max(copies.values())


def test_run_is_the_stages_together(spark, stages):
    key = lambda df: Counter((r.doc_id, r.doc_tokens) for r in df.where("start = 0").collect())
    assert key(cp.run(spark, SF_MID)) == key(stages[5])


def test_edge_rows(spark, tmp_path):
    """Nulls in every column, empty texts, repeated rows, extra columns; and no rows at all."""
    long = "the quick brown fox jumps over the lazy dog and runs away " * 30
    rows = [(1, long, "en", "a", 1), (2, long + "x", "en", "a", 1), (3, None, None, None, None), (4, "", "en", None, 0), (None, "null id text of some words", "en", "b", 5),
            (5, "other words entirely for this row", None, None, 5), (5, "other words entirely for this row", None, None, 5)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").withColumn("row", F.lit(1)).withColumn("k", F.lit(2))
    for label, docs in (("rows", df), ("none", df.limit(0))):
        for i, (name, f) in enumerate(cp.STAGES):
            path = str(tmp_path / f"{name}-{label}")
            f(spark, docs, SF_SMALL).write.parquet(path)
            docs = spark.read.schema(f(spark, docs, SF_SMALL).schema).parquet(path)
            if i < 4:
                assert docs.columns == df.columns
        assert docs.columns[0] == "doc_id"
