"""Language identification by nearest centroids."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import read, row_of
from .registry import register

BUCKETS = 4096          #: hashed character n-grams of lengths 1 to 3
PER_LANGUAGE = 400      #: labelled documents per language to learn from, at most
CENTROIDS = 3           #: clusters per language
MOST_ROWS = 8192        #: labelled documents of all languages together, at most
SLICE = 256             #: documents whose counts a task holds at once
LEAST_SHARE = 0.05      #: of a language's documents that a cluster must have
LOW = 0.0025            #: quantile of a language's training cosines that its floor comes from
SLACK = 0.5             #: a text is rejected below this part of it
_MULT = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35], dtype=np.uint32)
_LETTER: np.ndarray | None = None


def _letters() -> np.ndarray:
    """Code point -> itself if it is a letter, else a space."""
    global _LETTER
    if _LETTER is None:
        _LETTER = np.fromiter((c if chr(c).isalpha() else 32 for c in range(0x110000)), np.uint32, 0x110000)
    return _LETTER


def ngram_counts(text: str | None) -> np.ndarray | None:
    """Counts of hashed 1-, 2- and 3-grams of the lower-cased letters, all other
    characters taken as spaces; None without a letter."""
    if not text:
        return None
    c = _letters()[np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype=np.uint32)]
    blank = c == 32
    if blank.all():
        return None
    c = np.concatenate(([32], c[~(blank & np.concatenate(([True], blank[:-1])))], [32])).astype(np.uint32)  # one space a run
    one = c * _MULT[0]
    two = (one[:-1] ^ (one[:-1] >> 15)) * _MULT[1] + c[1:] * _MULT[2]
    three = (two[:-1] ^ (two[:-1] >> 13)) * _MULT[0] + c[2:] * _MULT[1]
    shift = np.uint32(32 - BUCKETS.bit_length() + 1)
    return np.bincount(np.concatenate([one, two, three]) >> shift, minlength=BUCKETS).astype(np.float32)


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=-1, keepdims=True)
    return x / np.where(n > 0, n, 1)


def clusters(own: np.ndarray, k: int) -> np.ndarray:
    """At most ``k`` centroids by spherical k-means, without chance: the start
    is the means of equal slices by the cosine to the mean of all. A cluster
    that falls below ``LEAST_SHARE`` starts again with the farthest third of the
    largest; one that is still below in the end goes."""
    order = np.argsort(own @ _unit(own.mean(axis=0)), kind="stable")
    c = _unit(np.stack([own[part].mean(axis=0) for part in np.array_split(order, min(k, len(own)))]))
    least = max(1, LEAST_SHARE * len(own))
    for _ in range(10):
        near = (own @ c.T).argmax(axis=1)
        for j in np.flatnonzero(np.bincount(near, minlength=len(c)) < least):
            large = np.bincount(near, minlength=len(c)).argmax()
            mine = np.flatnonzero(near == large)
            near[mine[np.argsort(own[mine] @ c[large], kind="stable")[:len(mine) // 3]]] = j
        c = _unit(np.stack([own[near == j].mean(axis=0) if (near == j).any() else c[j] for j in range(len(c))]))
    return c[np.bincount((own @ c.T).argmax(axis=1), minlength=len(c)) >= least]


class Model:
    """Centroids (rows of unit length), their languages, lowest accepted cosines
    (one for a language) and the weights of the n-grams."""

    def __init__(self, counts: np.ndarray, langs: list[str], k: int = CENTROIDS, slack: float = SLACK):
        self.idf = (np.log((1 + len(counts)) / (1 + (counts > 0).sum(axis=0))) + 1).astype(np.float32)
        x, lang = self.vectors(counts), np.array(langs)
        centres, names, floors = [], [], []
        for name in sorted(set(langs)):
            own = x[lang == name]
            c = clusters(own, k)
            floors += [slack * np.quantile((own @ c.T).max(axis=1), LOW)] * len(c)
            centres.append(c)
            names += [name] * len(c)
        self.centres, self.names, self.floors = np.concatenate(centres).astype(np.float32), names, np.array(floors)

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        return _unit(np.log1p(counts).astype(np.float32) * self.idf)

    def predict(self, counts: list[np.ndarray | None]) -> tuple[list[str], list[float], list[bool]]:
        """Language, cosine and whether the text is too far from its centroid."""
        lang, score, far = ["und"] * len(counts), [0.0] * len(counts), [True] * len(counts)
        for a in range(0, len(counts), 256):
            at = [i for i in range(a, min(a + 256, len(counts))) if counts[i] is not None]
            if at:
                cos = self.vectors(np.stack([counts[i] for i in at])) @ self.centres.T
                best = cos.argmax(axis=1)
                for i, j, v in zip(at, best, cos[np.arange(len(at)), best]):
                    lang[i], score[i], far[i] = self.names[j], min(1.0, max(0.0, float(v))), bool(v < self.floors[j])
        return lang, score, far


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        per_language: int = PER_LANGUAGE) -> Model | None:
    """Learn from at most ``per_language`` documents of every language and
    ``MOST_ROWS`` of all (languages with few documents first), chosen by a hash
    of id. A language's number of ids says which part of the hashes is more
    than enough, so only about twice the documents in question, not all of a
    frequent language, are put in order. Of the rows of one id and language the
    one with the least hash of its text is taken; the driver gets n-gram counts,
    16 KB a document, not texts. None if no row has a language."""
    names = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang")).where("lang is not null")
    part = names.distinct().groupBy("lang").agg(F.least(F.lit(1.0), F.lit(2.0 * per_language) / F.count(F.lit(1))).alias("part"))
    share = (F.shiftrightunsigned(F.xxhash64("id"), 11).cast("double") / float(1 << 53))
    few = names.join(part, "lang").where(share < F.col("part")).select("id", "lang").distinct()
    by_hash = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id")
    pick = (few.withColumn("n", F.row_number().over(by_hash)).where(F.col("n") <= per_language)
            .orderBy("n", "lang", F.xxhash64("id")).limit(MOST_ROWS).select(F.col("id").alias("pick"), F.col("lang").alias("pick_lang")))
    rows = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    rows = rows.join(F.broadcast(pick), F.expr("id <=> pick and lang = pick_lang"), "left_semi")     # at most MOST_ROWS rows
    rows = rows.groupBy("id", "lang").agg(F.min_by("text", F.xxhash64("text")).alias("text"))

    def features(batches):
        for b in batches:
            got = [(i, x, c) for i, x, t in zip(*map(pa.Array.to_pylist, b.columns)) if (c := ngram_counts(t)) is not None]
            yield pa.record_batch([pa.array([str(g[0]) for g in got], pa.string()), pa.array([g[1] for g in got], pa.string()),
                                   pa.array([g[2].astype("<f4").tobytes() for g in got], pa.binary())], ["id", "lang", "counts"])

    got = sorted((r.lang, r.id, bytes(r.counts)) for r in rows.mapInArrow(features, "id string, lang string, counts binary").collect())
    if not got:
        return None
    return Model(np.stack([np.frombuffer(g[2], "<f4") for g in got]), [g[0] for g in got])


def language_id(docs: DataFrame, model: Model | None, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The columns ``carry`` of every row (all by default, as struct ``row``)
    with ``lang_pred``, ``score`` (cosine, 0 to 1) and ``rejected``.

    Whole texts count. A null, empty or letterless text is ``und``, score 0,
    rejected; so is every text if there was nothing to learn from. A text whose
    best cosine is below its language's floor is rejected, but still carries
    the nearest language. Ties go to the first language by name. Repeated rows
    get equal results; no row moves between tasks. Only texts go to Python, not
    the carried columns; a task holds the counts of ``SLICE`` documents at a
    time. A very long text is counted whole. An empty table gives no row;
    columns of any name are carried in ``row``.
    """
    cols = docs.columns if carry is None else carry
    d = docs.select(row_of(docs, cols).alias("row"), F.col(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("lang_pred string, score double, rejected boolean")
    def judge(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = shared.value
        for texts in batches:
            lang, cos, far = [], [], []
            for i in range(0, len(texts), SLICE):
                counts = [ngram_counts(t.as_py()) for t in texts.slice(i, SLICE)]
                got = m.predict(counts) if m else (["und"] * len(counts), [0.0] * len(counts), [True] * len(counts))
                for all_, some in zip((lang, cos, far), got):
                    all_ += some
            yield pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(cos, pa.float64()), pa.array(far, pa.bool_())],
                                             ["lang_pred", "score", "rejected"])

    return d.select("row", judge("text").alias("v")).select("row", "v.lang_pred", "v.score", "v.rejected")


HELD_OUT = "crc32(cast(doc_id as string)) % 5 = 0"


@register("op10_language_id")
def op10_language_id(spark, sf_dir):
    """One row per document; learns from the documents that are not held out."""
    docs = read(spark, sf_dir, "documents")
    model = fit(docs.where(f"not {HELD_OUT}"))
    return language_id(docs, model, carry=["doc_id"]).select(
        "row.doc_id", "lang_pred", "score", "rejected").withColumn("held_out", F.expr(HELD_OUT))
