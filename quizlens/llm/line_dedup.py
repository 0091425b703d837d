"""Fuzzy deduplication of lines by MinHash."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, filter_of, read, row_of
from .components import connected_components
from .registry import register

PERCENT = 80        #: least Jaccard similarity of linked lines
CHARS = 7           #: characters of a shingle; one starts at every place of a line
BANDS, ROWS = 8, 4  #: bands of a line, MinHashes of a band: two lines share a band with probability 0.985 at similarity 0.8, 0.013 at 0.2
ROUNDS = 2          #: rounds against the best linked, then any line of each band, before the rest of the pairs
HASH_BITS = 52      #: of a shingle; the bits above number the lines of a slice
SLICE_CHARS = 1 << 18   #: characters that become arrays at once (a longer line is a slice of its own)
ROWS_OUT = 1 << 15  #: lines a task holds before it passes them on
_PAD = 0x1FFFFF     # behind a line shorter than a shingle; no character has this number
_K1, _K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_SEEDS = np.random.default_rng(1).integers(0, 1 << 32, (BANDS * ROWS, 2), np.uint32) | np.array([0, 1], np.uint32)  # the multipliers are odd
_SPACES = str.maketrans("\t\x0b\x0c\r", "    ")


def lines_of(text: str | None, min_words: int) -> Iterator[tuple[int, str]]:
    """``(line, norm)`` of the lines of ``min_words`` words or more: numbers from
    0, lower case, one space between words."""
    text = (text or "").lower()
    if any(c in text for c in "\t\x0b\x0c\r"):
        text = text.translate(_SPACES)
    for i, line in enumerate(text.split("\n")):
        line = line.strip(" ")
        if "  " in line:
            line = " ".join(filter(None, line.split(" ")))
        if line and line.count(" ") + 1 >= min_words:
            yield i, line


def digest(norms: list[str]) -> np.ndarray:
    """128-bit digests, as two columns of signed 64-bit numbers."""
    return np.frombuffer(b"".join(xxhash.xxh3_128_digest(x.encode("utf-8", "replace")) for x in norms), np.int64).reshape(-1, 2)


def _hash(c: Iterable[np.ndarray]) -> np.ndarray:
    """Hashes of ``CHARS`` = 7 neighbouring code points, given by 64-bit arrays
    of pairs of neighbours at places 0, 2, 3 and 5 (3 is in two of them)."""
    p0, p2, p3, p5 = c
    x = (p0 * _K1 + p2) * _K2 + (p3 * _K1 + p5)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x >> np.uint64(64 - HASH_BITS)


def shingles(norms: list[str]) -> np.ndarray:
    """Distinct shingles of at most ``1 << (64 - HASH_BITS)`` lines, sorted: a
    line's number in the high bits, a hash of the ``CHARS`` characters from any
    of its places in the low ones. A line that has no more than that is one
    shingle."""
    size = np.fromiter(map(len, norms), np.int64, len(norms))
    end = np.cumsum(size)
    start = end - size
    code = np.frombuffer("".join(norms).encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    code = np.concatenate([code, np.full(CHARS, _PAD, np.uint64)])
    pair = (code[:-1] << np.uint64(21)) | code[1:]
    n = int(end[-1])
    h = _hash([pair[i:i + n] for i in (0, 2, 3, 5)])
    h |= np.repeat(np.arange(len(norms), dtype=np.uint64) << np.uint64(HASH_BITS), size)
    whole = np.ones(n, bool)   # places where a shingle lies within its line
    for i in range(1, CHARS):
        whole[np.maximum(end - i, start)] = False
    short = np.flatnonzero(size < CHARS)
    at = np.arange(CHARS)
    part = np.where(at < size[short, None], code[np.minimum(start[short, None] + at, n)], np.uint64(_PAD))
    pair = (part[:, :-1] << np.uint64(21)) | part[:, 1:]
    few = _hash([pair[:, i] for i in (0, 2, 3, 5)]) | (short.astype(np.uint64) << np.uint64(HASH_BITS))
    h = np.sort(np.concatenate([h[whole], few]))
    return h[np.concatenate([[True], h[1:] != h[:-1]])]


def per_line(found: np.ndarray, n: int) -> np.ndarray:
    """How many of the shingles each of ``n`` lines has."""
    return np.bincount((found >> np.uint64(HASH_BITS)).astype(np.int64), minlength=n)


def signed(norms: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of the shingle sets of a slice, and the keys of each line's bands:
    a hash of ``ROWS`` MinHashes and of the band's number."""
    found = shingles(norms)
    n = per_line(found, len(norms))
    start = np.cumsum(n) - n
    h = (found >> np.uint64(HASH_BITS - 32)).astype(np.uint32)  # the high half of a hash, without the line
    keys = np.empty((len(norms), BANDS), np.uint64)
    for band in range(BANDS):
        key = np.full(len(norms), band + 1, np.uint64)
        for add, by in _SEEDS[band * ROWS:(band + 1) * ROWS]:
            key = (key ^ np.minimum.reduceat((h ^ add) * by, start)) * _K1
            key ^= key >> np.uint64(29)
        keys[:, band] = key * _K2
    return n, keys.view(np.int64)


def cuts(sizes: Iterable[int]) -> Iterator[slice]:
    """Slices of neighbouring rows with these numbers of characters."""
    a = b = held = 0
    for x in sizes:
        if b > a and (held + x > SLICE_CHARS or b - a == 1 << (64 - HASH_BITS)):
            yield slice(a, b)
            a, held = b, 0
        b, held = b + 1, held + x
    if b > a:
        yield slice(a, b)


def signatures(docs: DataFrame, min_words: int) -> DataFrame:
    """``docs(id, key, text)`` -> one row per line: ``id, key, line``, digest
    ``h1, h2``, size ``n`` of its shingle set, keys of its ``bands``."""

    def run(batches):
        for b in batches:
            rows, line, norms, held = [], [], [], 0

            def out():
                d = digest(norms)
                n, keys = map(np.concatenate, zip(*[signed(norms[c]) for c in cuts(map(len, norms))]))
                keys = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * BANDS), pa.array(keys.ravel()))
                at = pa.array(rows, pa.int32())
                return pa.record_batch([b.column(0).take(at), b.column(1).take(at), pa.array(line, pa.int32()), pa.array(d[:, 0]), pa.array(d[:, 1]),
                                        pa.array(n.astype(np.int32)), keys],
                                       ["id", "key", "line", "h1", "h2", "n", "bands"])

            for r, text in enumerate(b.column(2)):
                for i, norm in lines_of(text.as_py(), min_words):
                    rows.append(r), line.append(i), norms.append(norm)
                    held += len(norm)
                if len(rows) >= ROWS_OUT or held > 16 * SLICE_CHARS:
                    if rows:
                        yield out()
                    rows, line, norms, held = [], [], [], 0
            if rows:
                yield out()

    of = docs.schema["id"].dataType.simpleString()
    return docs.select("id", "key", "text").mapInArrow(run, f"id {of}, key bigint, line int, h1 bigint, h2 bigint, n int, bands array<bigint>")


def _pair(df: DataFrame, x: str, y: str) -> DataFrame:
    """Pairs of two columns of nodes, the smaller one first."""
    return df.where(f"{x} <> {y}").select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))


def texts_of(docs: DataFrame, need: DataFrame, scratch: Scratch, min_words: int) -> DataFrame:
    """The rows ``need(node, h1, h2, ...)`` with the line, ``norm``, from the texts, read
    once more. A Bloom filter of bounded size (a fuller one lets more lines
    through, never fewer) thins the lines before they are shuffled; equal lines
    are combined first, so a very common line costs one row a task."""
    shared = docs.sparkSession.sparkContext.broadcast(filter_of(need.select(F.col("h1").alias("h")), need.count()))

    def run(batches):
        for b in batches:
            norms = {norm for text in b.column(2) for _, norm in lines_of(text.as_py(), min_words)}
            if norms:
                norms = list(norms)
                d = digest(norms)
                hit = np.flatnonzero(shared.value(d[:, 0].view(np.uint64)))
                yield pa.record_batch([pa.array(d[hit, 0]), pa.array(d[hit, 1]), pa.array([norms[i] for i in hit.tolist()], pa.string())], ["h1", "h2", "norm"])

    found = docs.select("id", "key", "text").mapInArrow(run, "h1 bigint, h2 bigint, norm string")
    found = found.groupBy("h1", "h2").agg(F.first("norm").alias("norm"))
    return scratch.keep(found.join(need, ["h1", "h2"]).drop("h1", "h2"), "texts")


def similar(pairs: DataFrame, percent: int) -> DataFrame:
    """``(a, b)`` of the rows ``(a, b, ta, tb)`` whose texts' shingle sets have
    a Jaccard similarity of ``percent`` or more. Pairs pass through, a batch at a
    time."""

    def run(batches):
        for batch in batches:
            ta, tb = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            fits = []
            for c in cuts(len(x) + len(y) for x, y in zip(ta, tb)):
                x, y, n = shingles(ta[c]), shingles(tb[c]), c.stop - c.start
                both = np.sort(np.concatenate([x, y]))
                both = per_line(both[:-1][both[1:] == both[:-1]], n)
                fits.append(100 * both >= percent * (per_line(x, n) + per_line(y, n) - both))
            if fits:
                yield batch.select([0, 1]).filter(pa.array(np.concatenate(fits)))

    return pairs.select("a", "b", "ta", "tb").mapInArrow(run, "a bigint, b bigint")


class _Links:
    """Exact tests of pairs of nodes (distinct lines)."""

    def __init__(self, texts: DataFrame, percent: int, scratch: Scratch):
        self.texts, self.percent, self.s = texts, percent, scratch
        self.tested = self.links = None
        self.n = 0

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        self.n += 1
        return self.s.keep(df, f"{name}-{self.n}")

    def add(self, links: DataFrame) -> bool:
        new = self.keep(links, "links")
        self.links = new if self.links is None else self.links.union(new)
        return bool(new.head(1))

    def test(self, pairs: DataFrame) -> bool:
        """Tests pairs (a < b) that were not tested yet; whether links came of it."""
        pairs = pairs.distinct()
        if self.tested is not None:
            pairs = pairs.join(self.tested, ["a", "b"], "left_anti")
        self.tested = self.keep(pairs, "pairs")
        side = lambda x: self.texts.select(F.col("node").alias(x), F.col("norm").alias("t" + x), F.col("n").alias("n" + x))
        both = self.tested.join(side("a"), "a").join(side("b"), "b").where(f"{self.percent} * greatest(na, nb) <= 100 * least(na, nb)")
        return self.add(similar(both, self.percent))

    def components(self) -> DataFrame:
        self.n += 1
        return self.keep(connected_components(self.links, self.s, f"cc-{self.n}"), "components")


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT,
               scratch: Scratch | None = None, min_words: int = 1) -> DataFrame:
    """One row per line of ``min_words`` words or more (1: every line with a
    word): ``id, key`` (of id and text), ``line`` (from 0), ``n_shingles``, ``keep_id, keep_key, keep_line``
    (the line of its component that stays) and ``kept``.

    Equal lines (lower-cased, white space squeezed) are one node. MinHash: a
    line has ``BANDS`` bands of ``ROWS`` least hashes of its character shingles;
    lines that share a band are candidates, tested exactly by the Jaccard
    similarity of their shingles. The nodes of a band meet one leader first, then the best
    linked one and a few others; what is linked is one component, and after that
    only lines of different components are compared, in the join's own tasks, so
    no pairs but links come out of it. Exact sets are made in the tests, from the
    texts of the lines that share a band, which are read once more. Linked lines form components; of each, the line
    with the smallest id (null ids last), then the first in the text, stays.

    One rule holds for all lines, whatever their length or script: lines up to
    ``CHARS`` characters are one shingle, so they join only their equals.

    Rows with equal id and text count as one document. Null, empty and too short
    lines give no row; a very long line is one larger set. An empty table gives
    an empty result; other columns, whatever their names, are not looked at.
    """
    s = scratch or Scratch(docs.sparkSession)
    d = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(id_col).cast("string"), F.col(text_col)).alias("key"), F.col(text_col).alias("text"))
    occ = s.keep(signatures(d, min_words), "lines")
    rank = F.struct(F.col("id").isNull().alias("no"), "id", "key", "line")
    nodes = occ.groupBy("h1", "h2").agg(F.min(rank).alias("first"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    nodes = s.keep(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")

    rows = nodes.select(F.explode("bands").alias("key"), "node", "n")
    of = [F.min("node").alias("lo"), F.max("node").alias("hi"), F.min("n").alias("n_lo"), F.max("n").alias("n_hi"), F.count(F.lit(1)).alias("total")]
    shared = s.keep(rows.groupBy("key").agg(*of).where("total > 1"), "shared")
    members = s.keep(rows.select("key", "node").join(shared.where("total > 2").select("key", "lo"), "key"), "members")
    two = shared.where(f"total = 2 and {percent} * n_hi <= 100 * n_lo")
    need = members.select("node").union(two.select("lo")).union(two.select("hi")).distinct()
    need = s.keep(nodes.select("node", "h1", "h2", "n", "bands").join(need, "node"), "need")
    links = _Links(texts_of(d, need, s, min_words), percent, s)
    more = links.test(_pair(two, "lo", "hi").union(_pair(members, "node", "lo")))
    for r in range(ROUNDS + 1):
        comp = links.components()
        best = links.links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("links"))
        own = (members.select("key", "node").join(comp, "node", "left").join(best, "node", "left")
               .select("key", "node", F.coalesce("root", "node").alias("comp"), F.coalesce("links", F.lit(0)).alias("links")))
        order = F.struct("links", "node") if r == 0 else F.struct(F.xxhash64("node", F.lit(r)).alias("links"), "node")
        mixed = own.groupBy("key").agg(F.min("comp").alias("c1"), F.max("comp").alias("c2"),
                                       F.max_by(F.struct("node", "comp"), order).alias("leader")).where("c1 < c2")
        left = links.keep(own.drop("links").join(mixed.select("key", "leader"), "key"), "left")
        if r == ROUNDS or not more:
            break
        more = links.test(_pair(left.where("comp <> leader.comp").select("node", F.col("leader.node").alias("first")), "node", "first"))
    # the rest: lines of one band, but of different components; they are tested as
    # they leave the join, each pair in the first of its bands
    rest = links.keep(left.select("key", "comp", "node").join(links.texts, "node"), "rest")
    other = rest.select("key", *[F.col(c).alias(c + "2") for c in ("node", "comp", "n", "norm", "bands")])
    first = F.element_at(F.array_intersect("bands", "bands2"), 1) == F.col("x.key")
    apart = ((F.col("x.key") == F.col("y.key")) & (F.col("node") < F.col("node2")) & (F.col("comp") != F.col("comp2"))
             & (percent * F.greatest("n", "n2") <= 100 * F.least("n", "n2")) & first)
    pairs = rest.alias("x").join(other.alias("y"), apart)
    if links.add(similar(pairs.select(F.col("node").alias("a"), F.col("node2").alias("b"), F.col("norm").alias("ta"), F.col("norm2").alias("tb")), percent)):
        comp = links.components()

    named = nodes.select("h1", "h2", "node", "first").join(comp, "node", "left").withColumn("root", F.coalesce("root", "node"))
    stays = named.groupBy("root").agg(F.min("first").alias("stays"))
    named = s.keep(named.join(stays, "root").select("h1", "h2", "stays"), "named")
    out = occ.drop("bands").join(named, ["h1", "h2"])
    return out.select("id", "key", "line", F.col("n").alias("n_shingles"), F.col("stays.id").alias("keep_id"), F.col("stays.key").alias("keep_key"),
                      F.col("stays.line").alias("keep_line"), rank.eqNullSafe(F.col("stays")).alias("kept"))


def without_lines(docs: DataFrame, verdicts: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the lines that do not stay taken out of the text. A null
    text stays null; columns and their names are unchanged."""
    gone = verdicts.where("not kept").groupBy("id", "key").agg(F.collect_set("line").alias("gone"))
    gone = gone.select(F.col("id").alias("gid"), F.col("key").alias("gkey"), "gone")
    d = docs.select(row_of(docs).alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"),
                    F.xxhash64(F.col(id_col).cast("string"), F.col(text_col)).alias("key"))
    both = d.join(gone, (F.col("key") == F.col("gkey")) & F.col("id").eqNullSafe(F.col("gid")), "left")
    flags = F.map_from_arrays("gone", F.transform("gone", lambda x: F.lit(True)))
    left = F.array_join(F.filter(F.split("text", "\n"), lambda x, i: F.try_element_at(flags, i).isNull()), "\n")
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(left)
    return both.select(*[text.alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns])


@register("op3_line_dedup")
def op3_line_dedup(spark, sf_dir):
    """One row per line with a word: where its component's line that stays is."""
    return line_dedup(read(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "line", "n_shingles", F.col("keep_id").alias("keep_doc_id"), "keep_line", "kept")
