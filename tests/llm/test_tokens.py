"""Encoder, packing and edit-aware counts against the tokenizer library."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from conftest import SF_SMALL
from quizlens.llm import packing, token_counts, tokens


@pytest.fixture(scope="module")
def reference():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


def words(seed, n, alphabet="ab  \n\t'’sé \x1c9#日²"):
    r = random.Random(seed)
    return "".join(r.choice(alphabet) for _ in range(n))


def test_encoder_equals_library(reference, spark):
    enc = tokens.encoder(tokens.default_path())
    texts = [r.text for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("text").collect() if r.text]
    texts += [words(i, i % 60) for i in range(400)] + ["<|endoftext|>", "a  b", " x", "x ", "\n \n", "it's  'll we'd", "x" * 3000]
    for t in texts:
        assert np.frombuffer(enc.encode(t), "<u4").tolist() == reference(t), t[:80]
    assert enc.encode(None) == enc.encode("") == b""


def test_word_cache_is_bounded(reference, monkeypatch):
    monkeypatch.setattr(tokens, "CACHE", 5)
    enc = tokens.Encoder(tokens.default_path())
    for _ in range(2):
        for t in ("a b c d e f g h i", "i h g f e d c b a z y x w"):
            assert np.frombuffer(enc.encode(t), "<u4").tolist() == reference(t)
    assert len(enc._words) <= 5 and len(enc._words.old) <= 5


def test_texts_are_encoded_without_the_cache(reference, spark):
    """Packing's encoder gives the library's ids and keeps no word of a text."""
    enc = tokens.Encoder(tokens.default_path())
    texts = [words(i, i % 60) for i in range(400)] + ["<|endoftext|>", f"a {tokens._NO_TEXT} b", "a  b", " x", "x ", "\n \n", "it's  'll we'd", "x" * 3000, "日本 é\x00"]
    for t in texts:
        assert np.frombuffer(enc.encode_once(t), "<u4").tolist() == reference(t), t[:80]
        assert enc.encode_once(t) == enc.encode(t)
    assert enc.encode_once(None) == enc.encode_once("") == b""
    cached = len(enc._words)
    enc.encode_once(" ".join(f"new{i}" for i in range(1000)))
    assert len(enc._words) == cached


def check_pieces(rows, texts, reference, length=packing.LENGTH):
    """Exact round trip: every id of every document in one piece, no gaps."""
    docs, seqs = {}, {}
    for r in rows:
        docs.setdefault(r.doc, []).append(r)
        seqs.setdefault(r.sequence_id, []).append(r)
    assert set(docs) == set(texts)
    for d, own in docs.items():
        want = np.array(reference(texts[d] or "") + [0], dtype="<u4").tobytes()
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(want) // 4
            assert r.crc == zlib.crc32(want[4 * at:4 * (at + r.length)])
            assert r.ids is None or bytes(r.ids) == want[4 * at:4 * (at + r.length)]
            at += r.length
        assert at == len(want) // 4
    pad = 0
    for own in seqs.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= length
        pad += 0 if at & (at - 1) == 0 else length - at
    return pad, sum(r.length for r in rows)


def test_packing_documents(reference, spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").repartition(7, "doc_id")
    rows = packing.pack(docs, fan_in=3).collect()
    pad, total = check_pieces(rows, {r.doc_id: r.text for r in docs.collect()}, reference)
    assert pad <= 0.01 * total


def test_packing_edge_rows(reference, spark):
    texts = {1: None, 2: "", 3: "word " * 5000, 4: "a b", 5: "<|endoftext|>"}
    df = spark.createDataFrame([(k, v, "x") for k, v in texts.items()], "doc_id int, text string, doc string")
    rows = packing.pack(df, windows=2).collect()
    check_pieces(rows, texts, reference)
    assert packing.pack(df.limit(0)).count() == 0
    twice = packing.pack(df.where("doc_id = 4").union(df.where("doc_id = 4"))).collect()
    assert sum(r.length for r in twice) == 2 * (len(reference("a b")) + 1)
    none = packing.pack(df.selectExpr("cast(null as int) as doc_id", "text")).collect()
    assert {r.doc for r in none} == {None} and sum(r.length for r in none) == sum(r.length for r in rows)


def test_edited_counts_equal_full_encoding(reference):
    count = token_counts._counter(tokens.default_path())
    r = random.Random(5)
    for i in range(150):
        text = words(i, r.randrange(0, 400), "abc d  \n1'é ef gh") * r.choice([1, 1, 6])
        c, t = token_counts.build(text, count)
        for _ in range(2):  # edits on edited trees as well
            own, at = [], 0
            while at < len(text) and r.random() < 0.7:
                a = r.randrange(at, len(text) + 1)
                b = min(len(text) + 3, a + r.choice([0, 0, 1, 2, 30]))
                own.append((a, b, r.choice(["", "x", " ", "  y z\n", "'ll", "long new text " * 60])))
                at = b + r.choice([0, 1, 100])
            want, p = [], 0
            for a, b, new in own:
                want += [text[p:a], new]
                p = min(b, len(text))
            want = "".join([*want, text[p:]])
            text, n, again = token_counts.edit(text, c, t, own, count)
            assert text == want and n == len(own)
            assert c.sum[1] == len(want) and t.sum[1] == len(reference(want))


def test_only_touched_leaves_are_encoded():
    count = token_counts._counter(tokens.default_path())
    text = "some words of a long text " * 4000
    c, t = token_counts.build(text, count)
    calls = []
    token_counts.edit(text, c, t, [(50_000, 50_003, "new")], lambda x: calls.append(len(x)) or count(x))
    assert sum(calls) < 3000


def test_overlapping_and_late_edits():
    count = token_counts._counter(tokens.default_path())
    c, t = token_counts.build("abc def", count)
    text, n, _ = token_counts.edit("abc def", c, t, [(0, 3, "x"), (1, 5, "no"), (90, 99, "!")], count)
    assert (text, n) == ("x def!", 2) and t.sum[1] == count(text)


def test_token_count_query(reference, spark):
    from quizlens.llm.token_counts import op4_token_counts, secret_edits
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    rows = op4_token_counts(spark, SF_SMALL).collect()
    assert len(rows) == len(texts) and any(r.n_edits for r in rows)
    for r in rows:
        new, p = [], 0
        for e in secret_edits(texts[r.doc_id]):
            new += [texts[r.doc_id][p:e[0]], e[2]]
            p = e[1]
        new = "".join([*new, (texts[r.doc_id] or "")[p:]])
        assert (r.n_tokens, r.n_tokens_edited, r.n_chars_edited) == (len(reference(texts[r.doc_id] or "")), len(reference(new)), len(new))


def test_count_trees_edge_rows(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (2, "a b"), (None, "x" * 20000)], "doc_id int, text string").withColumn("tree", token_counts.F.lit(1))
    trees = token_counts.count_trees(df).withColumn("edits", token_counts.F.lit(None).cast(token_counts.EDITS))
    out = {(r.row.doc_id, len(r.text)): r for r in token_counts.apply_edits(trees).collect()}
    assert out[(1, 0)].tree["tokens"] == [0, 0][:len(out[(1, 0)].tree["tokens"])] and out[(2, 3)].tree["tokens"][1] == 2
    assert token_counts.count_trees(df.limit(0)).count() == 0
    fused = token_counts.apply_edits(df.selectExpr("struct(doc_id) row", "text"), find=lambda t: [(0, 1, "yy")])
    kept = token_counts.apply_edits(trees.withColumn("edits", token_counts.F.expr("array(struct(0 as start, 1 as end, 'yy' as replacement))").cast(token_counts.EDITS)))
    plain = lambda df: sorted((tuple(r) for r in df.selectExpr("row.doc_id", "text", "tree", "n_before", "edits_applied", "chars_encoded").collect()), key=str)
    assert plain(fused) == plain(kept)
