"""Exact top-k by inner product with cover trees over queries and data."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, read
from .registry import register

PIVOTS = 64             #: cells of the top level, from a sample of 16 times as many vectors
BLOCK = 1 << 12         #: vectors of a data tree, about
QUERY_BLOCK = 1 << 12   #: vectors of a query tree, about
BASE = 1.4              #: a child's radius is at most its parent's divided by this
LEAF = 16               #: queries that are scored together
_EPS = 1e-9             #: relative slack of bounds, for rounding


def _unpack(col: pa.Array) -> np.ndarray:
    """Binary vectors of whole numbers -> rows, padded with zeros."""
    parts = [np.frombuffer(v.as_py(), np.float64) for v in col]
    out = np.zeros((len(parts), max(1, *map(len, parts)) if parts else 1))
    for row, p in zip(out, parts):
        row[:len(p)] = p
    return out


def scaled(df: DataFrame, id_col: str, vec_col: str, factor: float) -> DataFrame:
    """``id, vec`` with vec as binary ``floor(factor * x)``; vectors that are null
    or hold null or non-finite components are left out."""
    def run(batches):
        for b in batches:
            out, keep = [], []
            for i, v in enumerate(b.column(1)):
                x = None if not v.is_valid else v.values.cast(pa.float64())
                if x is not None and not x.null_count:
                    a = np.floor(factor * x.to_numpy(zero_copy_only=False))
                    if np.isfinite(a).all():
                        keep.append(i)
                        out.append(a.tobytes())
            yield pa.record_batch([b.column(0).take(pa.array(keep, pa.int64())), pa.array(out, pa.binary())], ["id", "vec"])

    d = df.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v"))
    return d.mapInArrow(run, f"id {d.schema['id'].dataType.simpleString()}, vec binary")


class CoverTree:
    """Every point is one node. A node's children lie within its radius divided
    by ``BASE`` of their own centres or are further down, and siblings' centres
    are farther apart than that (the separation holds among siblings). ``radius``
    is the largest distance from a node to any point below it. Nodes are
    numbered so that a subtree is a range ``[i, end[i])``."""

    def __init__(self, points: np.ndarray):
        n = len(points)
        self.order = np.empty(n, np.int64)      # node -> row of ``points``
        self.end = np.empty(n, np.int64)
        self.radius = np.zeros(n)
        self.depth = np.empty(n, np.int64)
        exact = n and float(np.abs(points).max()) ** 2 * points.shape[1] < 2 ** 51   # sums of whole numbers
        square = (points ** 2).sum(axis=1)
        mean = points.mean(axis=0) if n else None
        root = int(((points - mean) ** 2).sum(axis=1).argmin()) if n else 0
        rest = np.delete(np.arange(n), root)
        at, stack = 0, [(root, rest, _far(points, root, rest), 0)] if n else []
        while stack:                            # depth first: a node, then its subtree
            centre, rows, dist, depth = stack.pop()
            node, at = at, at + 1
            self.order[node], self.depth[node], self.end[node] = centre, depth, node + 1 + len(rows)
            self.radius[node] = dist.max(initial=0.0)
            reach = self.radius[node] / BASE
            children, open_ = [], np.ones(len(rows), bool)
            near, size = (points[rows], square[rows]) if len(rows) else (None, None)
            while open_.any():                  # the farthest point next: a net of the rest
                c = int(np.where(open_, dist, -1.0).argmax())
                if exact:
                    d = np.sqrt(np.maximum(size + size[c] - 2 * (near @ near[c]), 0))
                else:
                    d = np.sqrt(((near - near[c]) ** 2).sum(axis=1))
                mine = open_ & (d <= reach)
                open_ &= ~mine
                open_[c] = mine[c] = False
                children.append((rows[c], rows[mine], d[mine], depth + 1))
                if 2 * open_.sum() < len(rows):
                    rows, dist, near, size = rows[open_], dist[open_], near[open_], size[open_]
                    open_ = np.ones(len(rows), bool)
            stack += children[::-1]
        self.points = points[self.order]
        self.norm = np.sqrt((self.points ** 2).sum(axis=1))

    def children(self, nodes: np.ndarray) -> np.ndarray:
        """The children of all these nodes: the first follows its parent, each
        next one follows the subtree before it."""
        out, c = [], nodes + 1
        ends = self.end[nodes]
        while True:
            go = c < ends
            c, ends = c[go], ends[go]
            if not len(c):
                return np.concatenate(out) if out else np.zeros(0, np.int64)
            out.append(c)
            c = self.end[c]


def _far(points: np.ndarray, i: int, rows: np.ndarray) -> np.ndarray:
    return np.sqrt(((points[rows] - points[i]) ** 2).sum(axis=1))


class Best:
    """The k best of every query so far: score falling, id rising (null last), row rising."""

    def __init__(self, n: int, k: int, least: np.ndarray):
        self.k, self.found = k, [[] for _ in range(n)]
        self.worst = least.astype(np.float64)   # what a candidate must reach

    def add(self, q: int, scores, ids, rows) -> None:
        new = self.found[q] + [((-s, i is None, i if i is not None else 0, r), s) for s, i, r in zip(scores, ids, rows)]
        new.sort(key=lambda x: x[0])
        self.found[q] = new[:self.k]
        if len(new) >= self.k:
            self.worst[q] = max(self.worst[q], float(self.found[q][-1][1]))


def dual_tree(queries: CoverTree, data: CoverTree, best: Best, add) -> None:
    """Depth first over query nodes, each with the data nodes that may still hold
    a result for one of its queries. For a query q within r of its node's centre c
    and a point x within s of its node's centre y, ``q x <= c y + r |y| + s |c| +
    r s``; a pair of nodes goes when that is below the worst k-th score of the
    query node's group. A data node wider than the query node is replaced by its
    own point and its children first. ``add(q, nodes)`` scores candidates."""
    stack = [(0, np.zeros(1, np.int64), np.ones(1, bool))] if len(queries.order) and len(data.order) else []
    while stack:
        q, nodes, whole = stack.pop()           # whole: the subtree; else the point alone
        stop = queries.end[q]
        if stop - q <= LEAF:
            _leaf(queries, q, stop, data, nodes, whole, best, add)
            continue
        c, r = queries.points[q], queries.radius[q]
        length = queries.norm[q]
        done = []
        while len(nodes):
            s = np.where(whole, data.radius[nodes], 0.0)
            y = data.norm[nodes]
            bound = data.points[nodes] @ c + r * y + s * length + r * s
            slack = _EPS * (length + r + 1) * (y + s + 1)
            ok = bound + slack >= best.worst[q:stop].min()
            nodes, whole, s = nodes[ok], whole[ok], s[ok]
            wide = whole & (s > r)
            done.append((nodes[~wide], whole[~wide]))
            below = data.children(nodes[wide])
            done.append((nodes[wide], np.zeros(wide.sum(), bool)))
            nodes, whole = below, data.end[below] - below > 1
        nodes, whole = np.concatenate([d[0] for d in done]), np.concatenate([d[1] for d in done])
        if not len(nodes):
            continue
        children = queries.children(np.array([q]))
        stack += [(int(i), nodes, whole) for i in children[::-1]]
        _leaf(queries, q, q + 1, data, nodes, whole, best, add)    # the node's own query


def _leaf(queries: CoverTree, q: int, stop: int, data: CoverTree, nodes, whole, best: Best, add) -> None:
    """Queries ``q..stop`` against data nodes, level by level, the most promising first."""
    own, length = queries.points[q:stop], queries.norm[q:stop]
    while len(nodes):
        s = np.where(whole, data.radius[nodes], 0.0)
        score = data.points[nodes] @ own.T
        slack = _EPS * np.outer(data.norm[nodes] + s + 1, length + 1)
        ok = score + slack >= best.worst[q:stop]
        for j in np.flatnonzero(ok.any(axis=0)):
            add(q + j, nodes[ok[:, j]], score[ok[:, j], j])
        more = whole & (score + np.outer(s, length) + slack >= best.worst[q:stop]).any(axis=1)
        nodes = data.children(nodes[more])
        whole = data.end[nodes] - nodes > 1


def search(query, data, k: int):
    """Top k of each query within one block, as (query row, id, row, score).
    ``query``: row numbers, vectors, least scores; ``data``: row numbers, ids,
    vectors. Scores are exact: sums of whole numbers below 2**53 in float64, else
    in Python integers, held to the range of a 64-bit number."""
    (qrow, qvec, least), (drow, did, dvec) = query, data
    width = max(qvec.shape[1], dvec.shape[1])
    qvec, dvec = (np.pad(v, ((0, 0), (0, width - v.shape[1]))) for v in (qvec, dvec))
    big = float(np.abs(qvec).max(initial=0)) * float(np.abs(dvec).max(initial=0)) * width >= 2 ** 53
    q, d = CoverTree(qvec), CoverTree(dvec)
    best = Best(len(qrow), k, least[q.order])

    def add(i: int, nodes: np.ndarray, scores: np.ndarray) -> None:
        rows = d.order[nodes]
        other = drow[rows] != qrow[q.order[i]]
        rows, scores, nodes = rows[other], scores[other], nodes[other]
        if big:
            mine = [int(x) for x in q.points[i]]
            exact = [sum(a * int(b) for a, b in zip(mine, d.points[n])) for n in nodes]
            scores = [min(max(x, -2 ** 63), 2 ** 63 - 1) for x in exact]
        elif len(rows) > 4 * k:                 # only what can be among the k best, ties included
            cut = np.partition(scores, len(scores) - k)[len(scores) - k]
            rows, scores = rows[scores >= cut], scores[scores >= cut]
        best.add(i, [int(x) for x in scores], [did[r] for r in rows], drow[rows].tolist())

    dual_tree(q, d, best, add)
    out = [(int(qrow[q.order[i]]), did_of, r, s) for i, f in enumerate(best.found)
           for (_, null, did_of, r), s in f for did_of in [None if null else did_of]]
    return out


def nearest(vec: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest pivot of each row, and the distance to it."""
    width = max(vec.shape[1], pivots.shape[1])
    vec, pivots = (np.pad(v, ((0, 0), (0, width - v.shape[1]))) for v in (vec, pivots))
    cell = ((pivots ** 2).sum(axis=1) - 2 * vec @ pivots.T).argmin(axis=1) if len(vec) else np.zeros(0, np.int64)
    return cell, np.sqrt(((vec - pivots[cell]) ** 2).sum(axis=1))


def choose(sample: np.ndarray, n: int) -> np.ndarray:
    """``n`` points of the sample, each the farthest from those before."""
    if not len(sample):
        return np.zeros((1, 1))
    at = [0]
    dist = _far(sample, 0, np.arange(len(sample)))
    while len(at) < n and dist.max() > 0:
        at.append(int(dist.argmax()))
        dist = np.minimum(dist, _far(sample, at[-1], np.arange(len(sample))))
    return sample[at]


def top_k(vectors: DataFrame, is_query, k: int = 5, factor: float = 256.0, id_col: str = "vec_id", vec_col: str = "embedding",
          pivots: int = PIVOTS, block: int = BLOCK, query_block: int = QUERY_BLOCK, scratch: Scratch | None = None) -> DataFrame:
    """``query_row, query_id, rank, id, score`` of the ``k`` largest inner
    products of every query row (``is_query``, an expression over ``id``) with
    every other row, vectors taken as ``floor(factor * x)``. Ties go to the
    smaller id (null last), then the earlier row; all, if there are fewer than k.

    Queries and data are indexed together: the nearest of a bounded set of
    pivots is a vector's cell, the top level of both indexes. A cell's vectors
    are dealt over blocks of bounded size (by row number, so a hot vector or
    cell is split), each with its own cover tree. Every query block first meets
    the blocks of its own cell; the k-th scores found are its thresholds. Blocks
    of another cell follow, unless the cell's radius and the query block's, about
    the same pivots, exclude every pair; the query blocks that a data block still
    has to meet come together in bundles of bounded size, as one tree. Within a
    pair of blocks both trees are traversed. All exact: nothing but bounds excludes a pair. Where bounds
    exclude little (vectors without clusters), every query block meets every
    data block; each vector then moves once per query block.

    Null vectors and ones with null or non-finite components take no part. A
    shorter vector counts as padded with zeros, an empty one as all zeros; very
    long vectors are larger rows. Repeated rows are rows of their own: each asks,
    and each is found. A row with a null id is no query. An empty table gives no
    row; other columns are not looked at. Scores beyond 64 bits are held to the
    range of a bigint.
    """
    s = scratch or Scratch(vectors.sparkSession)
    sc = vectors.sparkSession.sparkContext
    base = s.keep(scaled(vectors, id_col, vec_col, factor).withColumn("row", F.monotonically_increasing_id()), "vectors")
    kind = base.schema["id"].dataType.simpleString()
    sample = base.orderBy(F.xxhash64("row"), "row").limit(16 * pivots).select("vec").toArrow()
    centres = sc.broadcast(choose(_unpack(sample.column(0)), pivots))

    def assign(batches):
        for b in batches:
            cell, dist = nearest(_unpack(b.column(1)), centres.value)
            yield pa.record_batch([*b.columns, pa.array(cell.astype(np.int32)), pa.array(dist)], ["id", "vec", "row", "cell", "dist"])

    asks = F.coalesce(F.expr(is_query) if isinstance(is_query, str) else is_query, F.lit(False))
    placed = base.mapInArrow(assign, f"id {kind}, vec binary, row bigint, cell int, dist double").withColumn("asks", asks)
    placed = s.keep(placed, "placed")
    # at most ``pivots`` rows
    cells = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.count_if("asks").alias("nq"), F.max("dist").alias("radius")).collect()
    blocks = {c.cell: -(-c.n // block) for c in cells}
    groups = {c.cell: -(-c.nq // query_block) for c in cells}
    radius = {c.cell: c.radius for c in cells}
    part = lambda parts, salt: F.pmod(F.xxhash64("row", F.lit(salt)), _look_up(parts, "cell")).cast("int")
    data = placed.select("row", "id", "vec", "cell", part(blocks, 1).alias("part"))
    query = placed.where("asks").select("row", "id", "vec", "cell", "dist", part(groups, 2).alias("group"))

    def meet(q: DataFrame, pairs: DataFrame) -> DataFrame:
        """``q``: queries with ``least``; ``pairs(cell, group, at, bundle)``: a query
        group, the data cell it meets, and with which other groups."""
        every = F.explode(F.sequence(F.lit(0), _look_up(blocks, "at") - 1)).alias("part")
        none = lambda t, name: F.lit(None).cast(t).alias(name)
        left = (q.join(pairs, ["cell", "group"]).select("at", "bundle", every, "row", "vec", "least")
                .select("at", "bundle", "part", "row", none(kind, "id"), "vec", "least"))
        right = (data.withColumnRenamed("cell", "at").join(pairs.select("at", "bundle").distinct(), "at")
                 .select("at", "bundle", "part", "row", "id", "vec", none("double", "least")))

        def run(t):
            asks = t.column("least").is_valid().to_numpy()
            rows, vec = t.column("row").to_numpy(), _unpack(t.column("vec"))
            qs = (rows[asks], vec[asks], t.column("least").to_numpy()[asks])
            found = search(qs, (rows[~asks], t.column("id").filter(pa.array(~asks)).to_pylist(), vec[~asks]), k) if asks.any() and not asks.all() else []
            cols = list(zip(*found)) or [[]] * 4
            return pa.table([pa.array(cols[0], pa.int64()), pa.array(cols[1], t.schema.field("id").type), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64())],
                            names=["query_row", "id", "row", "score"])

        return (left.unionAll(right).groupBy("at", "part", "bundle")
                .applyInArrow(run, f"query_row bigint, id {kind}, row bigint, score bigint"))

    by_rank = Window.partitionBy("query_row").orderBy(F.desc("score"), F.col("id").isNull(), "id", "row")
    best_of = lambda found: found.withColumn("rank", F.row_number().over(by_rank)).where(F.col("rank") <= k)
    own = query.select("cell", "group").distinct().select("cell", "group", F.col("cell").alias("at"), F.col("group").cast("long").alias("bundle"))
    first = s.keep(best_of(meet(query.withColumn("least", F.lit(float("-inf"))), own)).drop("rank"), "first")
    worst = first.groupBy("query_row").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("n")).where(F.col("n") == k).drop("n")
    known = query.join(worst.withColumnRenamed("query_row", "row"), "row", "left")
    known = s.keep(known.withColumn("least", F.coalesce(F.col("least").cast("double"), F.lit(float("-inf")))), "known")

    def others(batches):
        """Cells that a query group has to meet, by the same bound, from one row a group."""
        c = centres.value
        size = np.sqrt((c ** 2).sum(axis=1))
        for b in batches:
            out = []
            for cell, group, r, least, n in zip(*map(pa.Array.to_pylist, b.columns)):
                for at in radius:
                    bound = c[cell] @ c[at] + r * size[at] + radius[at] * size[cell] + r * radius[at]
                    if at != cell and bound + _EPS * (size[cell] + r + 1) * (size[at] + radius[at] + 1) >= least:
                        out.append((cell, group, at, n))
            cols = list(zip(*out)) or [[]] * 4
            yield pa.record_batch([*[pa.array(x, pa.int32()) for x in cols[:3]], pa.array(cols[3], pa.int64())], ["cell", "group", "at", "n"])

    far = known.groupBy("cell", "group").agg(F.max("dist"), F.min("least"), F.count(F.lit(1))).mapInArrow(others, "cell int, group int, at int, n long")
    far = s.keep(far, "pairs")
    total = far.groupBy("at").agg(F.ceil(F.sum("n") / query_block).alias("bundles"))
    far = far.join(total, "at").select("cell", "group", "at", F.pmod(F.xxhash64("cell", "group"), "bundles").alias("bundle"))
    out = best_of(first.unionByName(meet(known.drop("dist"), far)))
    named = query.select(F.col("row").alias("query_row"), F.col("id").alias("query_id"))
    return out.join(named, "query_row").select("query_row", "query_id", "rank", "id", "score")


def _look_up(values: dict[int, int], col: str):
    """The value of a cell, from a literal array of at most ``pivots`` numbers (1 at least)."""
    size = max(values, default=0) + 1
    return F.get(F.array(*[F.lit(max(1, values.get(i, 1))) for i in range(size)]), F.col(col))


SQL = """
with v as (select row_number() over () rid, vec_id, [floor(256 * x::double) for x in embedding] v from embeddings
           where embedding is not null and len([x for x in embedding if x is null or not isfinite(x)]) = 0),
s as (select q.rid, q.vec_id query_id, c.vec_id, c.rid other, list_dot_product(q.v, c.v)::bigint score
      from v q, v c where q.vec_id % 50 = 0 and q.rid <> c.rid)
select query_id, (row_number() over (partition by rid order by score desc, vec_id nulls last, other))::integer rank, vec_id, score from s
qualify rank <= 5
"""


@register("op11_topk_search", SQL)
def op11_topk_search(spark, sf_dir):
    """The 5 largest inner products of every vector whose id is divisible by 50 with all others."""
    return top_k(read(spark, sf_dir, "embeddings"), "id % 50 = 0").select(
        "query_id", "rank", F.col("id").alias("vec_id"), "score")
