"""Exact dedup, mixing, language identification, quality rules and repeated
lines against brute force; edge rows of each."""

import hashlib
import re
from collections import Counter, defaultdict
from types import SimpleNamespace

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_MID, SF_SMALL
from quizlens.llm import exact_dedup, language_id, mix_sources, quality_rules, substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")
EDGE = [(1, None, "en", "a"), (2, "", "en", None), (3, " \t", None, "b"), (4, "x y", "en", "b"), (4, "x y", "en", "b"),
        (None, "x  y", "fr", "a"), (5, "long " * 30000, "fr", "Z"), (6, "日本語 12 — ñ", "es", "é"), (7, "12 34", None, "a")]
SCHEMA = "doc_id int, text string, lang string, source string"


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(EDGE, SCHEMA).withColumn("row", F.lit(1)).withColumn("id", F.lit("x")).withColumn("copies", F.lit(2)).withColumn("key", F.lit(0))


def documents(spark, sf=SF_MID):
    return spark.read.parquet(f"{sf}/documents.parquet")


def test_exact_dedup_edge_rows(edge):
    got = [(r.row.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(edge, carry=["doc_id"]).collect()]
    assert sorted(got, key=str) == sorted([(1, 1, 2, True), (2, 1, 2, False), (3, 3, 1, True), (4, 4, 3, True), (4, 4, 3, False),
                                           (None, 4, 3, False), (5, 5, 1, True), (6, 6, 1, True), (7, 7, 1, True)], key=str)
    assert exact_dedup.exact_dedup(edge.limit(0)).count() == 0


def test_exact_dedup_colliding_chunk_ids(spark, monkeypatch):
    """Chunks with one 64-bit id but other digests get other identifiers."""
    real = F.xxhash64
    monkeypatch.setattr(exact_dedup.F, "xxhash64", lambda *c: real(F.lit(1)) if len(c) == 1 else real(*c))
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, "a" * 9000 + "b"), (5, "a" * 9000 + "c")], "doc_id int, text string")
    assert {r.id: r.keep_id for r in exact_dedup.exact_dedup(df).collect()} == {1: 1, 2: 2, 3: 1, 4: 4, 5: 5}


def test_chunks_are_the_text(spark):
    chunk = re.compile(exact_dedup.CHUNK.replace(r"\z", r"\Z"))
    for r in documents(spark, SF_SMALL).collect():
        parts = chunk.findall(r.text)
        assert "".join(parts) == r.text and all(len(p) <= 8192 for p in parts)


def water_fill(sizes, weights=(5, 2, 1), cap=3):
    """Share, cut at the caps, share the excess again until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    fixed, total = {}, sum(sizes.values())
    while True:
        free = [s for s in order if s not in fixed]
        left = total - sum(fixed.values())
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        above = [s for s in free if share[s] > cap * sizes[s]]
        if not above:
            return fixed | share
        fixed |= {s: cap * sizes[s] for s in above}


def test_mixing_matches_brute_force(spark):
    rows = mix_sources.op2_mix_sources(spark, SF_MID).collect()
    docs = {r.doc_id: r for r in documents(spark).collect()}
    sizes = Counter()
    for d in docs.values():
        sizes[d.source] += len(WORD.findall(d.text or ""))
    want, taken = water_fill(sizes), Counter()
    assert len(rows) == len(docs)
    for r in rows:
        d = docs[r.doc_id]
        assert r.size == len(WORD.findall(d.text or "")) and r.source_size == sizes[d.source]
        assert abs(r.target - want[d.source]) < 1e-6 * max(1, r.target) and 0 <= r.taken <= 3 * r.size
        assert r.taken in (r.size * int(r.target / r.source_size), r.size * (int(r.target / r.source_size) + 1))
        taken[d.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 0.05 * want[s] for s in want)
    assert sorted(rows) == sorted(mix_sources.op2_mix_sources(spark, SF_MID).collect())


@pytest.mark.parametrize("sizes", [{"a": 1, "b": 1000}, {"a": 10, "b": 1, "c": 0}, {None: 5, "z": 5, "é": 1, "a": 400}, {"a": 0}, {"q": 7}])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, size bigint")
    got = {r.source: r.target for r in mix_sources.targets(df, (5, 2, 1), 3).collect()}
    want = water_fill(sizes)
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-9 * max(1, want[s]) for s in want)


def test_mix_emits_rows(spark, edge):
    out = mix_sources.mix_sources(edge)
    assert out.columns == edge.columns and out.where("doc_id = 5").count() <= 3
    assert mix_sources.mix_sources(edge.limit(0)).count() == 0
    docs = documents(spark)
    took = {r.doc_id: r.copies for r in mix_sources.op2_mix_sources(spark, SF_MID).collect() if r.copies}
    assert Counter(r.doc_id for r in mix_sources.mix_sources(docs).collect()) == Counter(took)


def test_language_held_out_accuracy(spark):
    rows = language_id.op10_language_id(spark, SF_MID).collect()
    docs = {r.doc_id: r for r in documents(spark).collect()}
    assert len(rows) == len(docs) and all(0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.lang_pred == docs[r.doc_id].lang for r in held]) >= 0.97 and np.mean([r.rejected for r in rows]) <= 0.01
    import zlib
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)


def test_language_edge_rows(spark, edge):
    model = language_id.fit(edge)
    got = {r.row.doc_id: (r.lang_pred, r.rejected) for r in language_id.language_id(edge, model).collect()}
    assert [got[k] for k in (1, 2, 3, 7)] == [("und", True)] * 4 and got[6][0] == "es" and got[5] == ("fr", False)
    assert language_id.fit(edge.where("lang is null")) is None
    assert {r.lang_pred for r in language_id.language_id(edge, None).collect()} == {"und"}
    assert language_id.language_id(edge.limit(0), model).count() == 0


def test_language_rejects_far_texts(spark):
    docs = documents(spark)
    model = language_id.fit(docs)
    odd = spark.createDataFrame([(1, "日本語の文章です。" * 20), (2, "Ω ξένη γλώσσα " * 20)], "doc_id int, text string")
    assert [r.rejected for r in language_id.language_id(odd, model).collect()] == [True, True]


def test_language_clusters_are_populated_and_short_texts_stay(spark):
    rows = [(r.lang, language_id.ngram_counts(r.text)) for r in documents(spark).where("lang is not null").orderBy("doc_id").collect()]
    langs, counts = zip(*[r for r in rows if r[1] is not None])
    m = language_id.Model(np.stack(counts), list(langs))
    x, names, langs = m.vectors(np.stack(counts)), np.array(m.names), np.array(langs)
    for name in sorted(set(langs)):
        near = (x[langs == name] @ m.centres[names == name].T).argmax(axis=1)
        sizes = np.bincount(near, minlength=(names == name).sum())
        assert len(sizes) == 3 and sizes.min() >= 0.05 * sizes.sum() and len(set(m.floors[names == name])) == 1
    short = ["The shor.", "Thre er. And erhe.", "Ingea therre he.", "The of, onrely ntre blely the of, th."]
    assert m.predict([language_id.ngram_counts(t) for t in short])[2] == [False] * 4
    odd = ["日本語の文章です。" * 20, "Ω ξένη γλώσσα " * 20]
    assert m.predict([language_id.ngram_counts(t) for t in odd])[2] == [True] * 2


def repeats(words, n=8):
    at = defaultdict(list)
    for i in range(len(words) - n + 1):
        at[tuple(words[i:i + n])].append(i)
    return len({j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + n)})


def test_quality_matches_brute_force(spark):
    docs = {r.doc_id: r.text for r in documents(spark).collect()}
    rows = quality_rules.op8_quality_rules(spark, SF_MID).collect()
    assert len(rows) == len(docs)
    for r in rows:
        t = docs[r.doc_id] or ""
        words = WORD.findall(t)
        lines = [x for x in t.split("\n") if WORD.search(x)]
        assert (r.n_words, r.word_chars, r.n_symbols) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)))
        assert (r.n_dup_lines, r.n_repeat_words) == (len(lines) - len(set(lines)), repeats(words))
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) and not (r.base_failed and r.kept)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF_MID}/labels.parquet").collect()}
    by = {q: [r.kept for r in rows if labels.get(r.doc_id) == q] for q in (0, 1)}
    assert np.mean(by[1]) >= 0.95 and np.mean(by[0]) <= 0.4, (np.mean(by[0]), np.mean(by[1]))


def test_repeat_words_small():
    for text in ("a " * 20, "a b c d e f g h " * 2, "a b c d e f g h x a b c d e f g h", "a b c d e f g", ""):
        w = text.split()
        assert quality_rules.repeat_words([x.encode() for x in w]) == repeats(w)


def test_trees_are_monotonic_and_flat():
    r = np.random.default_rng(0)
    x = r.random((600, 3))
    y = ((x[:, 0] + 0.3 * x[:, 1] + 0.3 * r.random(600)) > 0.8).astype(float)
    t = quality_rules.Trees(x, y, [1, 0, -1])
    assert t.feature.shape == t.cut.shape == (quality_rules.TREES, 7) and t.value.shape == (quality_rules.TREES, 8)
    assert ((t.score(x) > 0.5) == (y > 0.5)).mean() > 0.9
    for j, sign in ((0, 1), (2, -1)):
        grid = np.repeat(x[:50], 41, axis=0)
        grid[:, j] = np.tile(np.linspace(0, 1, 41), 50)
        assert (np.diff(t.score(grid).reshape(50, 41), axis=1) * sign >= -1e-12).all()


def test_quality_edge_rows(spark, edge):
    labels = spark.createDataFrame([], "doc_id int, quality int")
    assert quality_rules.fit(edge, labels) is None
    got = {r.row.doc_id: r for r in quality_rules.quality_rules(edge, None).collect()}
    assert got[1].base_failed and got[2].n_words == 0 and got[5].n_repeat_words == 30000 and not got[5].kept
    assert got[3].word_chars == 0 and got[6].n_words == 4 and quality_rules.quality_rules(edge.limit(0), None).count() == 0


def clauses(text):
    """(start, end, normalised) of every clause with a word."""
    out, start = [], 0
    marks = ".!?,;:"
    for i, c in enumerate(text or ""):
        nxt = text[i + 1:i + 2]
        if c == "\n" or (c in marks and not (nxt and nxt in marks)):
            out.append((start, i + 1))
            start = i + 1
    out.append((start, len(text or "")))
    return [(a, z, " ".join(text[a:z].split()).lower()) for a, z in out if (text or "")[a:z].split()]


def repeats_and_passages(docs, least):
    """Per document the repeated clauses (number, where it stays), and the numbers
    of those in passages of ``least`` words or more."""
    seen, out = {}, {}
    for d, text in sorted(docs, key=lambda x: (x[0] is None, x[0] or 0)):
        own = clauses(text)
        again = []
        for i, (_, _, norm) in enumerate(own):
            if norm in seen:
                again.append((i, seen[norm]))
            else:
                seen[norm] = d
        numbers, gone, run = {i for i, _ in again}, [], []
        for i in range(len(own) + 1):
            if i in numbers:
                run.append(i)
            else:
                gone += run if sum(len(own[j][2].split()) for j in run) >= least else []
                run = []
        out[d] = (own, again, gone)
    return out


@pytest.mark.parametrize("least", [1, 30])
def test_substring_dedup_matches_brute_force(spark, least):
    docs = {r.doc_id: r.text for r in documents(spark).collect()}
    want = repeats_and_passages(docs.items(), least)
    rows = (substring_dedup.substring_dedup(documents(spark), min_run=least) if least == 1 else substring_dedup.substring_dedup(documents(spark))).collect()
    assert len(rows) == len(docs) and sum(len(w[2]) for w in want.values()) > 100
    for r in rows:
        t = docs[r.row.doc_id]
        own, again, gone = want[r.row.doc_id]
        assert [(x.unit, x.stays_in) for x in r.repeats] == again and [x.unit for x in r.removed] == gone and r.n_units == len(own)
        assert all((x.start, x.end) == own[x.unit][:2] for x in r.repeats)
        assert r.text == "".join(t[s.start:s.end] for s in r.kept_spans)
        away = [(own[i][0], own[i][1] if i + 1 not in gone else own[i + 1][0]) for i in gone]
        assert r.text == "".join(c for at, c in enumerate(t) if not any(a <= at < z for a, z in away))


def test_substring_dedup_edge_rows(spark, edge):
    out = substring_dedup.substring_dedup(edge, min_run=1).collect()
    got = {r.row.doc_id: r for r in out}
    assert len(out) == len(EDGE) and got[1].text is None and got[2].text == "" and got[3].text == " \t"
    assert got[None].text == "" and [r.text for r in out if r.row.doc_id == 4] == ["x y", "x y"]
    assert substring_dedup.substring_dedup(edge.limit(0)).count() == 0


def test_substring_dedup_catches_passages_and_leaves_chance_repeats(spark):
    """A passage of over 50 words inside other text goes from the second document
    on; short phrases that repeat stay, but are told of."""
    passage = " ".join(f"Clause number {i} of the text, which runs on and on;" for i in range(8))
    df = spark.createDataFrame([(1, f"One. {passage} Two."), (2, f"Something else here {passage}\nSee also: One. More"), (3, "See also: a thing. One.")], "doc_id int, text string")
    got = {r.row.doc_id: r for r in substring_dedup.substring_dedup(df).collect()}
    assert got[1].text == f"One. {passage} Two." and got[3].text == "See also: a thing. One."
    kept = got[2].text
    assert kept.startswith("Something else here Clause number 0 of the text,") and kept.endswith("\nSee also: One. More") and "number 5" not in kept
    assert [x.stays_in for x in got[3].repeats] == [2, 1] and got[3].removed == []


def test_language_is_the_nearest_centroid(spark):
    """Predictions recomputed in plain Python from the model's centroids."""
    docs = documents(spark, SF_SMALL)
    model = language_id.fit(docs)
    rows = {r.row.doc_id: r for r in language_id.language_id(docs, model).collect()}
    for r in docs.collect()[:60]:
        counts = language_id.ngram_counts(r.text)
        if counts is None:
            assert rows[r.doc_id].lang_pred == "und" and rows[r.doc_id].rejected
            continue
        v = [np.log1p(float(c)) * float(w) for c, w in zip(counts, model.idf)]
        size = sum(x * x for x in v) ** 0.5
        cos = [sum(x / size * float(y) for x, y in zip(v, c)) for c in model.centres]
        best = max(range(len(cos)), key=cos.__getitem__)
        assert rows[r.doc_id].lang_pred == model.names[best] and abs(rows[r.doc_id].score - cos[best]) < 1e-4
        assert rows[r.doc_id].rejected == (cos[best] < model.floors[best])


def test_language_sample_is_bounded(spark, monkeypatch):
    """At most MOST_ROWS documents are learned from, however many languages there are."""
    docs = spark.range(3000).selectExpr("id as doc_id", "concat('text ', id) as text", "concat('l', id % 500) as lang")
    seen = []
    monkeypatch.setattr(language_id, "Model", lambda counts, langs: seen.append((len(langs), len(set(langs)))))
    monkeypatch.setattr(language_id, "MOST_ROWS", 700)
    language_id.fit(docs)
    assert seen == [(700, 500)]


def test_letters_of_any_script():
    for text in ("Обычный русский текст о погоде и природе.", "Ein gewöhnlicher Satz über das Wetter heute."):
        features = dict(zip(quality_rules.FEATURES, quality_rules.statistics(text)[1]))
        assert features["letter_share"] > 0.9 and 0 < features["upper_share"] < 0.15


def test_columns_of_any_name(spark):
    from quizlens.llm import line_dedup, token_counts, url_filters
    docs = documents(spark, SF_SMALL).withColumn("a.b", F.lit(1)).withColumn("row.text", F.lit("x"))
    n, model = docs.count(), language_id.fit(docs)
    assert language_id.language_id(docs, model).select("row.*").columns == docs.columns
    assert exact_dedup.exact_dedup(docs, carry=docs.columns).select("row.*").columns == docs.columns
    assert mix_sources.mix_sources(docs).columns == docs.columns
    assert substring_dedup.substring_dedup(docs).count() == n
    labels = spark.read.parquet(f"{SF_SMALL}/labels.parquet")
    assert quality_rules.quality_rules(docs, quality_rules.fit(docs, labels)).count() == n
    assert token_counts.count_trees(docs).count() == n
    small = docs.limit(20)
    assert line_dedup.without_lines(small, line_dedup.line_dedup(small)).columns == docs.columns
    pages = spark.read.parquet(f"{SF_SMALL}/pages.parquet").withColumn("a.b", F.lit(1))
    assert url_filters.url_filters(pages, url_filters.spam_keys, url_filters.RULES).count() == pages.count()


def test_samples_take_one_row_an_id(spark, monkeypatch):
    """An id that repeats gives one row to learn from, and takes no other id's place."""
    rows = [(7, f"the same id again {i}", "en") for i in range(50)] + [(i, f"text number {i} of many", "en") for i in range(10, 13)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, lang string")
    seen = []
    monkeypatch.setattr(language_id, "Model", lambda counts, langs: seen.append(len(langs)))
    for per_language in (4, 400):
        language_id.fit(docs, per_language=per_language)
    assert seen == [4, 4]
    labels = spark.createDataFrame([(7, 1)] * 9 + [(10, 0), (11, 0), (12, 1)], "doc_id int, quality int")
    monkeypatch.setattr(quality_rules, "Trees", lambda x, y, signs: seen.append(sorted(y)) or SimpleNamespace(score=lambda x: np.zeros(len(x))))
    quality_rules.fit(docs, labels, sample=4)
    assert seen[2] == [0, 0, 1, 1]


def test_only_texts_go_to_the_classifier(spark):
    """Carried columns stay out of Python; every row comes back with its own verdict."""
    docs = spark.createDataFrame([(i, None if i % 7 == 0 else f"text number {i} " * (i % 5), "en", "s") for i in range(600)], "doc_id int, text string, lang string, source string").coalesce(1)
    got = language_id.language_id(docs, language_id.fit(docs))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and "ArrowEvalPython" in plan
    rows = got.collect()
    assert sorted((r.row.doc_id, r.row.text) for r in rows) == sorted((r.doc_id, r.text) for r in docs.collect())
    assert all((r.lang_pred == "und") == (not r.row.text) for r in rows)
