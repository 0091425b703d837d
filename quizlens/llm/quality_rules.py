"""Quality rules by gradient-boosted trees over document statistics."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import read, row_of
from .registry import register

WINDOW = 8              #: words of a window that may repeat
MIN_WORDS = 20          #: base rule
MAX_REPEAT = 30         #: base rule: percent of words in repeated windows
SAMPLE = 8192           #: labelled documents to learn from, at most
TREES, DEPTH, BINS, RATE, LEAST = 60, 3, 32, 0.15, 5
GOOD_KEPT = 0.99        #: the verdict's threshold keeps this part of the good documents learned from
SYMBOLS = "#*$%&|<>"
_WS = [chr(c) for c in (32, *range(9, 14))]

#: Features and how the score may move with them: -1 down, 1 up, 0 freely.
FEATURES = {"log_words": 0, "mean_word": 0, "symbol_share": -1, "dup_line_share": -1, "repeat_share": -1,
            "upper_share": 0, "digit_share": 0, "letter_share": 1, "mark_share": 0, "mean_line": 0, "distinct_share": 1, "bar_share": -1}


def repeat_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows of ``window`` words that occur twice or more."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    w = np.zeros(n, np.uint64)
    for j in range(window):
        w = w * np.uint64(0x9E3779B97F4A7C15) + h[j:j + n]
    s = np.sort(w)
    twice = s[1:][s[1:] == s[:-1]]
    if not len(twice):
        return 0
    starts = np.flatnonzero(np.isin(w, twice))
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + window, -1)
    return int((np.cumsum(cover)[:-1] > 0).sum())


@functools.cache
def _kinds() -> np.ndarray:
    """Code point -> 1 upper-case letter, 2 other letter (of any script), 3 digit, 0 else."""
    return np.array([1 if c.isupper() else 2 if c.isalpha() else 3 if c.isdigit() else 0 for c in map(chr, range(0x110000))], np.uint8)


def statistics(text: str | None) -> tuple[list[int], list[float]]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words), features."""
    text = text or ""
    words = text.encode("utf-8", "replace").split()  # of bytes: splits at ASCII white space alone
    n, chars = len(words), len(text) - sum(map(text.count, _WS))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(" \t\n\r\x0b\x0c")]
    dup = len(lines) - len(set(lines))
    repeat = repeat_words(words)
    c = max(chars, 1)
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    upper, letter, digit = np.bincount(_kinds()[points], minlength=4)[1:].tolist()
    letter += upper
    marks, bars = sum(map(text.count, "!,.:;")), text.count("|")
    return [n, chars, symbols, dup, repeat], [
        float(np.log1p(n)), chars / max(n, 1), symbols / c, dup / max(len(lines), 1), repeat / max(n, 1), upper / c, digit / c,
        letter / c, marks / c, n / max(len(lines), 1), len(set(words)) / max(n, 1), bars / c]


class Trees:
    """Boosted regression trees of fixed depth. All nodes are in flat arrays:
    tree t has its 2**DEPTH - 1 splits at ``feature[t]``, ``cut[t]`` (heap
    order) and 2**DEPTH leaf values at ``value[t]``."""

    def __init__(self, x: np.ndarray, y: np.ndarray, signs: list[int]):
        self.feature, self.cut, self.value = [], [], []
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        b = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)], axis=1)  # bin k: at most edges[k]
        p = np.clip(y.mean(), 0.01, 0.99)
        self.base = float(np.log(p / (1 - p)))
        f = np.full(len(y), self.base)
        for _ in range(TREES):
            q = 1 / (1 + np.exp(-f))
            tree = self._tree(b, edges, y - q, q * (1 - q), signs)
            self.feature.append(tree[0])
            self.cut.append(tree[1])
            self.value.append(tree[2])
            f += self._leaf(x, len(self.value) - 1)
        self.feature, self.cut, self.value = map(np.array, (self.feature, self.cut, self.value))

    @staticmethod
    def _tree(b, edges, g, h, signs):
        """One tree by Newton steps. A split against its feature's sign is not
        made; both sides then stay on their sides of the middle, so the whole
        tree is monotonic in the feature."""
        n_split, n_leaf = 2 ** DEPTH - 1, 2 ** DEPTH
        feature, cut = np.zeros(n_split, np.int32), np.full(n_split, np.inf)
        rows, low, high = {0: np.arange(len(g))}, {0: -np.inf}, {0: np.inf}
        weight = lambda i, at: float(np.clip(g[at].sum() / (h[at].sum() + 1.0), low[i], high[i]))
        for i in range(n_split):
            at, best = rows[i], (1e-9, 0, None, 0.0)
            G, H = g[at].sum(), h[at].sum()
            for j, e in enumerate(edges):
                if not len(e):
                    continue
                gl = np.cumsum(np.bincount(b[at, j], g[at], len(e) + 1))[:-1]
                hl = np.cumsum(np.bincount(b[at, j], h[at], len(e) + 1))[:-1]
                nl = np.cumsum(np.bincount(b[at, j], minlength=len(e) + 1))[:-1]
                wl, wr = np.clip(gl / (hl + 1), low[i], high[i]), np.clip((G - gl) / (H - hl + 1), low[i], high[i])
                gain = gl * wl - (hl + 1) * wl ** 2 / 2 + (G - gl) * wr - (H - hl + 1) * wr ** 2 / 2
                whole = weight(i, at) if len(at) else 0.0
                gain -= G * whole - (H + 1) * whole ** 2 / 2
                ok = (nl >= LEAST) & (len(at) - nl >= LEAST) & ((wr - wl) * signs[j] >= 0)
                if ok.any() and (k := int(np.where(ok, gain, -np.inf).argmax())) is not None and gain[k] > best[0]:
                    best = (gain[k], j, k, (wl[k] + wr[k]) / 2)
            _, j, k, mid = best
            feature[i] = j
            for side, child in ((0, 2 * i + 1), (1, 2 * i + 2)):
                low[child], high[child] = low[i], high[i]
                rows[child] = at if k is None and side == 0 else at[:0] if k is None else at[(b[at, j] > k) == bool(side)]
                if k is not None and signs[j]:
                    (high if (signs[j] > 0) != bool(side) else low)[child] = mid
            if k is not None:
                cut[i] = edges[j][k]
        value = np.array([RATE * weight(i, rows[i]) if len(rows[i]) else 0.0 for i in range(n_split, n_split + n_leaf)])
        return feature, cut, value

    def _leaf(self, x: np.ndarray, t: int) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        for _ in range(DEPTH):
            at = 2 * at + 1 + (x[np.arange(len(x)), self.feature[t][at]] > self.cut[t][at])
        return self.value[t][at - 2 ** DEPTH + 1]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of good quality for every row of features."""
        f = np.full(len(x), self.base)
        for t in range(len(self.value)):
            f += self._leaf(x, t)
        return 1 / (1 + np.exp(-f))


def _run(docs: DataFrame, schema: T.StructType, rows):
    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict(rows(b), schema=pa.schema(
                [(f.name, b.column(0).type if f.name == "row" else {"long": pa.int64(), "double": pa.float64(), "integer": pa.int32(),
                  "boolean": pa.bool_()}.get(f.dataType.typeName(), pa.list_(pa.float64()))) for f in schema]))
    return docs.mapInArrow(run, schema)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
        sample: int = SAMPLE) -> tuple[Trees, float] | None:
    """Trees and the verdict's threshold, learned from at most ``sample``
    labelled ids, those of the smallest hashes, one document (the one with the
    least hash of its text) for each label of an id. None unless both labels occur. The driver gets statistics, not texts."""
    pick = (labels.select(F.col(id_col).alias("pick"), F.col(label_col).cast("int").alias("good"))
            .where("pick is not null and good in (0, 1)").distinct().orderBy(F.xxhash64("pick"), "pick", "good").limit(sample))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    texts = texts.join(F.broadcast(pick), F.col("id") == F.col("pick"))
    texts = texts.groupBy("id", "good").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select(F.struct("id").alias("row"), "text", "good")
    schema = T.StructType([T.StructField("good", T.IntegerType()), T.StructField("x", T.ArrayType(T.DoubleType()))])
    got = sorted((r.good, r.x) for r in _run(texts, schema, lambda b: {
        "good": b.column(2).to_pylist(), "x": [statistics(t.as_py())[1] for t in b.column(1)]}).collect())
    if len({g for g, _ in got}) < 2:
        return None
    y, x = np.array([g for g, _ in got], float), np.array([v for _, v in got])
    trees = Trees(x, y, list(FEATURES.values()))
    return trees, float(min(0.5, np.quantile(trees.score(x)[y == 1], 1 - GOOD_KEPT)))


def quality_rules(docs: DataFrame, model: tuple[Trees, float] | None, text_col: str = "text",
                  carry: list[str] | None = None) -> DataFrame:
    """``row`` (struct of ``carry``, all columns by default) of every row with
    the base statistics, ``base_failed``, ``score`` and ``kept``.

    Whole texts are counted, each row by itself, without a shuffle. A null or
    empty text has zero counts and fails the base rules. Without a model (no
    labels of both kinds) the score is null and the base rules decide alone.
    Repeated rows get equal verdicts; an empty table stays empty.
    """
    d = docs.select(row_of(docs, carry).alias("row"), F.col(text_col).alias("text"))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    schema = T.StructType([d.schema["row"], *[T.StructField(n, T.LongType()) for n in names], T.StructField("base_failed", T.BooleanType()),
                           T.StructField("score", T.DoubleType()), T.StructField("kept", T.BooleanType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rows(b):
        counts, x = zip(*(statistics(t.as_py()) for t in b.column(1))) if b.num_rows else ((), ())
        failed = [c[0] < MIN_WORDS or 100 * c[4] > MAX_REPEAT * c[0] for c in counts]
        score, least = [None] * len(x), 0.0
        if shared.value and x:
            trees, least = shared.value
            score = trees.score(np.array(x)).tolist()
        return {"row": b.column(0), **{n: [c[i] for c in counts] for i, n in enumerate(names)}, "base_failed": failed, "score": score,
                "kept": [not f and (s is None or s >= least) for f, s in zip(failed, score)]}

    return _run(d, schema, rows)


@register("op8_quality_rules")
def op8_quality_rules(spark, sf_dir):
    """One row per document: statistics, base rules and the trees' verdict."""
    docs = read(spark, sf_dir, "documents")
    return quality_rules(docs, fit(docs, read(spark, sf_dir, "labels")), carry=["doc_id"]).select("row.doc_id", "*").drop("row")
