"""Similarity join of documents on word shingles, with signature trees."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, filter_of, read, small
from .components import connected_components
from .registry import register

SMALL = 64          #: sets below this size use pairs of neighbouring hashes as keys
ROUNDS = 1          #: rounds against one node of each key (the best linked, then any) before the trees do the rest
BLOCK = 2048        #: rows of a key that one tree holds
LISTED = 64         #: nodes of at most so many open keys carry them, so that a pair comes from one of its keys only
FAN_OUT = 8         #: children of a tree node
CHUNK = 1 << 17     #: node pairs tested at once
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, k: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct k-word shingles, A-Z lower-cased; a
    text of fewer words is one shingle, one without words has none."""
    words = (text or "").encode("utf-8", "replace").lower().split()  # of bytes: ASCII case and white space alone
    if not words:
        return np.zeros(0, np.uint64)
    h = _mix(np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)))
    m = max(1, len(words) - k + 1)
    w = np.full(m, min(k, len(words)), np.uint64)
    for j in range(min(k, len(words))):
        w = w * _ODD + h[j:j + m]
    return np.unique(_mix(w))


def keys(s: np.ndarray, percent: int) -> np.ndarray:
    """64-bit keys such that two sets of at least ``percent`` Jaccard similarity
    share one (equal sets aside).

    A partner differs from a set of n hashes in at most ``d = n (100 - percent)
    / percent`` of them. Sets of ``SMALL`` or more are cut into hash ranges, as
    many as the size's power of two says; each differing hash spoils one range,
    so of the first d + 1 ranges that are not empty one has the same hashes in
    the partner, and the side whose keys reach less far finds it among the
    other's. Smaller sets take the first neighbouring hashes: at most ``2 n (100
    - percent) / 100`` of such couples are spoilt. Sizes near a power of two, or
    near ``SMALL``, have the keys of both sides.
    """
    n, out = len(s), []
    if n < 2:
        return np.zeros(0, np.uint64)
    if n < SMALL or n * percent <= 100 * (SMALL - 1):
        m = min(n - 1, 2 * n * (100 - percent) // 100 + 1)
        out.append(_mix(s[:m] * _ODD + s[1:m + 1] + np.uint64(7)))
    shift = 1 if 2.6 * (100 - percent) <= 0.5 * percent else 0
    power = n.bit_length() - 1
    for p in [power] + [power + 1] * (100 * n >= percent << (power + 1)):
        if 1 << p < SMALL:
            continue
        range_of = s >> np.uint64(64 - p + shift)
        starts = np.flatnonzero(np.concatenate(([True], range_of[1:] != range_of[:-1])))
        take = n * (100 - percent) // percent + 1
        if take < len(starts):
            end, starts = starts[take], starts[:take]
        else:
            end = n
        out.append(_mix(np.add.reduceat(_mix(s[:end] + np.uint64(p)), starts) * _ODD + range_of[starts] + np.uint64(p)))
    return np.concatenate(out)


def bitmap(s: np.ndarray) -> np.ndarray:
    """The hashes as bits, four times the next power of two above their number
    (1024 at least): few hashes share a bit, so sets just below the threshold
    are told apart."""
    width = max(1024, 4 << len(s).bit_length())
    bits = np.zeros(width, np.uint8)
    bits[(s & np.uint64(width - 1)).astype(np.int64)] = 1
    return np.packbits(bits)


def folded(maps: list[bytes]) -> np.ndarray:
    """The bitmaps as rows of 64-bit words, all folded to the least width."""
    width, out = min(map(len, maps)), []
    for m in maps:
        a = np.frombuffer(m, np.uint8)
        while len(a) > width:
            a = a[:len(a) // 2] | a[len(a) // 2:]
        out.append(a)
    return np.stack(out).view(np.uint64)


def _pop(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).sum(axis=-1, dtype=np.int64)


def possible(na, nb, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of these sizes and bitmaps can be similar: each bit of one
    that the other lacks is at least one element not shared."""
    most = np.minimum(na - _pop(a & ~b), nb - _pop(b & ~a))
    return (100 + percent) * most >= percent * (na + nb)


class SignatureTree:
    """Leaves are sets: size, bitmap, component. A node above has its children's
    range of sizes, the OR of their bitmaps, the most elements that share bits,
    and the component if they agree on one (else -1)."""

    def __init__(self, size: np.ndarray, bits: np.ndarray, comp: np.ndarray):
        self.order = np.lexsort((*bits.T[:4], comp, size))
        size, bits, comp = size[self.order], bits[self.order], comp[self.order]
        self.levels = [(size, size, bits, size - _pop(bits), comp)]
        while len(self.levels[-1][0]) > 1:
            lo, hi, b, excess, c = self.levels[-1]
            at = np.arange(0, len(lo), FAN_OUT)
            first, last = np.minimum.reduceat(c, at), np.maximum.reduceat(c, at)
            self.levels.append((np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at), np.bitwise_or.reduceat(b, at, axis=0),
                                np.maximum.reduceat(excess, at), np.where(first == last, first, -1)))


def _children(i: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Index of the parent and number of each child of nodes i, of n below."""
    child = i[:, None] * FAN_OUT + np.arange(FAN_OUT)
    ok = child < n
    return np.repeat(np.arange(len(i)), FAN_OUT)[ok.ravel()], child[ok]


def dual_traversal(x: SignatureTree, y: SignatureTree, percent: int):
    """Yields index arrays (a, b) of the leaf pairs that can be similar and are
    of different components; of a tree with itself, each pair once. Pairs of
    nodes go if the sizes, the largest possible overlap or a common component
    exclude every pair below. Depth first, in chunks, so memory is bounded."""
    same = x is y
    top = max(len(x.levels), len(y.levels)) - 1
    stack = [(top, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    level = lambda t, d: t.levels[min(d, len(t.levels) - 1)]  # noqa: E731  a lower tree's root waits
    while stack:
        d, i, j = stack.pop()
        if len(i) > CHUNK:
            for a in range(0, len(i), CHUNK):
                stack.append((d, i[a:a + CHUNK], j[a:a + CHUNK]))
            continue
        (lo1, hi1, b1, e1, c1), (lo2, hi2, b2, e2, c2) = level(x, d), level(y, d)
        ok = (percent * np.maximum(lo1[i], lo2[j]) <= 100 * np.minimum(hi1[i], hi2[j])) & ((c1[i] != c2[j]) | (c1[i] == -1))
        i, j = i[ok], j[ok]
        if d == 0:
            ok = possible(lo1[i], lo2[j], b1[i], b2[j], percent)
            if same:
                ok &= i < j
            if ok.any():
                yield x.order[i[ok]], y.order[j[ok]]
            continue
        most = np.minimum(_pop(b1[i] & b2[j]) + np.minimum(e1[i], e2[j]), np.minimum(hi1[i], hi2[j]))
        ok = (100 + percent) * most >= percent * (lo1[i] + lo2[j])
        i, j = i[ok], j[ok]
        if d < len(x.levels):
            at, i = _children(i, len(x.levels[d - 1][0]))
            j = j[at]
        if d < len(y.levels):
            at, j = _children(j, len(y.levels[d - 1][0]))
            i = i[at]
        if same:
            i, j = i[i <= j], j[i <= j]
        if len(i):
            stack.append((d - 1, i, j))


def _signatures(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Per row: row key, id, size, 128-bit digest of the set, keys, bitmap."""
    def run(batches):
        for b in small(batches):
            n, digest, key, bits = [], [], [], []
            for t in b.column(2):
                s = shingles(t.as_py(), k)
                n.append(len(s))
                digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                key.append(keys(s, percent).view(np.int64))
                bits.append(bitmap(s).tobytes())
            at = np.concatenate(([0], np.cumsum([len(x) for x in key]))).astype(np.int32)
            lists = pa.ListArray.from_arrays(at, np.concatenate(key) if key else np.zeros(0, np.int64))
            yield pa.record_batch([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), lists, pa.array(bits, pa.binary())],
                                  ["row_key", "id", "n", "digest", "keys", "bits"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(run, f"row_key bigint, id {kind}, n bigint, digest binary, keys array<bigint>, bits binary")


class _Join:
    """Tests pairs of nodes (distinct shingle sets) and gathers links."""

    def __init__(self, docs: DataFrame, nodes: DataFrame, k: int, percent: int, scratch: Scratch):
        self.docs, self.nodes, self.k, self.percent, self.s = docs, nodes, k, percent, scratch
        self.tested = self.links = None
        self.n = 0
        self.passing: list[str] = []    # tables that only the test under way reads

    def keep(self, df: DataFrame, name: str, passing: bool = False) -> DataFrame:
        self.n += 1
        if passing:
            self.passing.append(f"{name}-{self.n}")
        return self.s.keep(df, f"{name}-{self.n}")

    def similar(self, pairs: DataFrame) -> bool:
        """Tests the pairs (a < b) not tested before; whether links came of it."""
        pairs = pairs.distinct()
        if self.tested is not None:
            pairs = pairs.join(self.tested, ["a", "b"], "left_anti")
        percent = self.percent

        def by_bitmap(batches):
            for b in batches:
                a, c, na, nb = (b.column(i).to_numpy(zero_copy_only=False) for i in range(4))
                ok = percent * np.maximum(na, nb) <= 100 * np.minimum(na, nb)
                for i in np.flatnonzero(ok):
                    m = folded([b.column(4)[i].as_py(), b.column(5)[i].as_py()])
                    ok[i] = possible(na[i], nb[i], m[:1], m[1:], percent)[0]
                yield pa.record_batch([pa.array(a), pa.array(c), pa.array(ok)], ["a", "b", "ok"])

        side = lambda x: self.nodes.select(F.col("node").alias(x), F.col("n").alias("n" + x), F.col("bits").alias("bits" + x))
        tried = self.keep(pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "bitsa", "bitsb")
                          .mapInArrow(by_bitmap, "a bigint, b bigint, ok boolean"), "tried")
        likely = tried.where("ok").select("a", "b")
        sets = self._sets(likely.select(F.col("a").alias("node")).union(likely.select("b")).distinct())

        def exactly(batches):
            for b in batches:
                ok = []
                for x, y in zip(b.column(2), b.column(3)):
                    x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    ok.append(100 * both >= percent * (len(x) + len(y) - both))
                yield b.select([0, 1]).filter(pa.array(ok, pa.bool_()))

        side = lambda x: sets.select(F.col("node").alias(x), F.col("set").alias("set" + x))
        new = self.keep(likely.join(side("a"), "a").join(side("b"), "b").select("a", "b", "seta", "setb")
                        .mapInArrow(exactly, "a bigint, b bigint"), "links")
        self.s.drop(*self.passing)
        self.passing = []
        self.tested = tried.select("a", "b") if self.tested is None else self.tested.union(tried.select("a", "b"))
        self.links = new if self.links is None else self.links.union(new)
        return bool(new.head(1))

    def _sets(self, need: DataFrame) -> DataFrame:
        """The sets of these nodes, made again from the text of one row each. A
        Bloom filter of bounded size thins the texts before the join; too many
        rows only make it useless, not wrong."""
        rows = self.keep(need.join(self.nodes, "node").select("node", "row_key"), "need", passing=True)
        k, bits = self.k, 1 << 25
        at = lambda c: c.bitwiseAND(F.lit(bits - 1))
        words = (rows.select(F.shiftright(at(F.col("row_key")), 6).alias("word"), F.expr("shiftleft(1L, cast(row_key & 63 as int))").alias("v"))
                 .groupBy("word").agg(F.bit_or("v").alias("v")))
        words = words.union(rows.sparkSession.range(bits // 64).select(F.col("id"), F.lit(0).cast("bigint")))
        words = words.groupBy("word").agg(F.bit_or("v").alias("v")).agg(F.sort_array(F.collect_list(F.struct("word", "v")))["v"].alias("w"))
        table = self.keep(words, "filter", passing=True).scalar()
        hit = F.getbit(F.element_at(table, (F.shiftright(at(F.col("row_key")), 6) + 1).cast("int")), F.col("row_key").bitwiseAND(F.lit(63)).cast("int")) == 1
        texts = self.docs.select("row_key", "text").where(hit)

        def run(batches):
            for b in small(batches):
                yield pa.record_batch([b.column(0), pa.array([shingles(t.as_py(), k).tobytes() for t in b.column(1)], pa.binary())], ["node", "set"])

        # one row a node: rows of equal key have equal text
        own = texts.join(rows, "row_key").select("node", "text").mapInArrow(run, "node bigint, set binary")
        return self.keep(own.dropDuplicates(["node"]), "sets", passing=True)

    def components(self) -> DataFrame:
        self.n += 1
        return self.keep(connected_components(self.links, self.s, f"cc-{self.n}"), "components")

    def with_trees(self, rows: DataFrame) -> DataFrame:
        """Pairs (a, b) of different components that share a key of ``rows(key,
        node, comp, total)`` and can be similar by sizes and bitmaps. Keys of
        many rows are dealt over blocks, and each two blocks meet in a task of
        their own, so a tree holds ``BLOCK`` rows or so of any key."""
        percent = self.percent

        def traverse(table):
            node, n, comp, side = (table.column(c).to_numpy() for c in ("node", "n", "comp", "side"))
            bits = folded([x.as_py() for x in table.column("bits")])
            lists, here = [None if x is None else set(x) for x in table.column("lists").to_pylist()], table.column("key")[0].as_py()
            at = [np.flatnonzero(side == i) for i in (0, 1)]

            def mine(i, j):     # of the keys that both have, the least tells of the pair
                return lists[i] is None or lists[j] is None or min(lists[i] & lists[j]) == here

            x, *y = [SignatureTree(n[i], bits[i], comp[i]) for i in at if len(i)]
            if y or not len(at[1]):
                for i, j in dual_traversal(x, y[0] if y else x, percent):
                    i, j = at[0][i], at[1 if y else 0][j]
                    once = np.fromiter(map(mine, i.tolist(), j.tolist()), bool, len(i))
                    p, q = node[i[once]], node[j[once]]
                    yield pa.table({"a": np.minimum(p, q), "b": np.maximum(p, q)})

        def group(table):
            found = list(traverse(table))
            return pa.concat_tables(found) if found else pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})

        blocks = F.ceil(F.col("total") / BLOCK)
        listed = rows.groupBy("node").agg(F.collect_set("key").alias("lists")).where(F.size("lists") <= LISTED)
        rows = rows.join(self.nodes.select("node", "n", "bits"), "node").join(listed, "node", "left")
        r = (rows.withColumn("own", F.pmod(F.xxhash64("node", F.lit(5)), blocks))
             .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
             .select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
                     (F.col("own") > F.col("other")).cast("long").alias("side"), "node", "n", "bits", "comp", "lists"))
        return r.groupBy("key", "i", "j").applyInArrow(group, "a bigint, b bigint")


def ngram_join(docs: DataFrame, k: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text",
               scratch: Scratch | None = None) -> DataFrame:
    """For every row: ``row_key``, ``id``, ``n_shingles``, ``component_id``, the
    smallest id reachable by links, and ``kept``: whether it is the one row of its
    component that stays, of the smallest id (null last), then row key. Two rows link when ``100 * intersection >=
    percent * union`` of their sets of distinct k-word shingles (75 or more).

    Equal sets are one node. Nodes that share a key (``keys``) are candidates:
    no link lies outside. First every node of a key meets one leader of it;
    what is linked then is one component, and only pairs of different
    components remain to be tested. Rounds against the node with most links of
    each key (the middle of a group of near copies), then against other members,
    join most of what is left in linear work; signature trees then find the rest of the pairs of
    each key exactly, so no link that joins two components is lost. Pairs that sizes and bitmaps allow are tested on their exact sets.

    A null, empty or wordless text has no shingles, links with nothing and is
    its own component. Rows with equal sets, so also repeated rows, share a
    component; null ids take part, but do not name one unless all are null. A
    very long text is one larger set. An empty table gives an empty result.
    """
    if not 75 <= percent <= 100:
        raise ValueError("percent must be from 75 to 100")
    s = scratch or Scratch(docs.sparkSession)
    d = docs.select(row_key(id_col, text_col).alias("row_key"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sig = s.keep(_signatures(d, k, percent), "signatures")

    sets = sig.where("n > 0").groupBy("digest").agg(F.min("row_key").alias("row_key"), F.min("id").alias("id"), F.first("n").alias("n"),
                                                    F.first("bits").alias("bits"))
    nodes = s.keep(sets.withColumn("node", F.xxhash64("digest")), "nodes")
    numbered = sig.withColumn("node", F.xxhash64("digest"))
    twice = nodes.groupBy("node").agg(F.count(F.lit(1)).alias("digests")).where("digests > 1").select("node")
    if twice.head(1):  # different sets with one hash: a handful in 10**10
        clash = nodes.join(F.broadcast(twice), "node").selectExpr("digest", "node", "row_number() over (partition by node order by digest) as variant")
        clash = clash.where("variant > 1").selectExpr("digest", "xxhash64(digest, variant) as other")
        other = lambda df: df.join(F.broadcast(clash), "digest", "left").withColumn("node", F.coalesce("other", "node")).drop("other")
        nodes, numbered = s.keep(other(nodes), "nodes-apart"), other(numbered)

    rows = numbered.where("n > 1").select("node", F.explode("keys").alias("key"))
    shared = s.keep(rows.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi"), F.count(F.lit(1)).alias("total")).where("lo < hi"), "shared")
    # a key of two rows needs no second look at the keys
    often = shared.where("total > 2")
    open_ = docs.sparkSession.sparkContext.broadcast(filter_of(often.select(F.col("key").alias("h")), often.count()))

    def hits(batches):  # most keys have one row; those need not be shuffled again
        for b in batches:
            key = b.column(1).flatten()
            owner = np.repeat(np.arange(b.num_rows), b.column(1).value_lengths().to_numpy())
            at = np.flatnonzero(open_.value(key.to_numpy().view(np.uint64)))
            yield pa.record_batch([b.column(0).take(pa.array(owner[at])), key.take(pa.array(at))], ["node", "key"])

    some = numbered.where("n > 1").select("node", "keys").mapInArrow(hits, "node bigint, key bigint")
    members = s.keep(some.join(often.select("key", "lo"), "key").distinct(), "members")
    # keys and bitmaps of the rows are not needed any more; those of the nodes are
    numbered = s.keep(numbered.select("row_key", "id", "n", "node"), "rows")
    s.drop("signatures")
    join = _Join(d, nodes, k, percent, s)
    pair = lambda df, x, y: df.where(f"{x} <> {y}").select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    more = join.similar(pair(shared.where("total = 2"), "lo", "hi").union(pair(members, "node", "lo")))
    s.drop("shared")
    for r in range(ROUNDS + 1):
        comp = join.components()
        own = members.select("key", "node").join(comp, "node", "left").select("key", "node", F.coalesce("root", "node").alias("comp"))
        best = join.links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("links"))
        own = own.join(best, "node", "left")
        by = F.struct(F.coalesce("links", F.lit(0)), "node") if r == 0 else F.struct(F.xxhash64("node", F.lit(r)), "node")
        mixed = own.groupBy("key").agg(F.min("comp").alias("c1"), F.max("comp").alias("c2"), F.count(F.lit(1)).alias("total"),
                                       F.max_by(F.struct("node", "comp"), by).alias("leader")).where("c1 < c2")
        left = join.keep(own.drop("links").join(mixed.select("key", "leader", "total"), "key"), "left")
        if r == ROUNDS or not more:
            break
        more = join.similar(pair(left.where("comp <> leader.comp").select("node", F.col("leader.node").alias("first")), "node", "first"))
    if join.similar(join.with_trees(left.select("key", "node", "comp", "total"))):
        comp = join.components()

    named = sets_of(numbered, comp)
    rank = F.struct(F.col("id").isNull().alias("no"), "id", "row_key")
    least = named.where("n > 0").groupBy("root").agg(F.min("id").alias("component"), F.min(rank).alias("stays"))
    return (named.join(least, "root", "left")
            .select("row_key", "id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id")).alias("component_id"),
                    ((F.col("n") == 0) | rank.eqNullSafe(F.col("stays"))).alias("kept")))


def sets_of(numbered: DataFrame, comp: DataFrame) -> DataFrame:
    return (numbered.select("row_key", "id", "n", "node").join(comp.withColumnRenamed("root", "r"), "node", "left")
            .select("row_key", "id", "n", F.when(F.col("n") > 0, F.coalesce("r", "node")).alias("root")))


def row_key(id_col: str, text_col: str):
    return F.xxhash64(F.col(id_col).cast("string"), F.col(text_col))


@register("op6_ngram_join")
def op6_ngram_join(spark, sf_dir):
    """One row per document: size of its shingle set and its component."""
    return ngram_join(read(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "n_shingles", "component_id")
