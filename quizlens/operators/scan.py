"""Skew-safe ordered scans: running sums, carry-forward and next-value
along an order within a key.

A plain ``Window.partitionBy(key).orderBy(o)`` sends every row of a key
to one task; if one key holds a third of the rows, that task does a third
of the work. Here the order column is cut into blocks (``o div
block_size``):

1. a partial aggregate gives one summary row per (key, block);
2. a window over those summary rows (few, small) gives each block its
   offset from the blocks before it;
3. the scan inside a block runs as a window over (key, block) - at most
   ``block_size`` distinct order values per task - and the offset is added.

The result equals the single-window scan; the biggest window partition is
bounded by the block size instead of by the hottest key.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint_dir

DEFAULT_BLOCK = 1 << 20


def _keys(keys) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys or [])


def with_block(df: DataFrame, order: str, block_size: int, name: str = "_blk") -> DataFrame:
    return df.withColumn(name, F.floor(F.col(order) / F.lit(block_size)).cast("bigint"))


def _clustered(df: DataFrame, keys: list[str], order: str, block_size: int) -> DataFrame:
    """One exchange on (keys, block), checkpointed to the shared checkpoint
    folder. Every later step - the in-block windows, the per-block summary
    and the join back - reads this partitioned copy: the input's lineage
    runs once instead of once per branch (column pruning makes the two
    branches' exchanges differ, so Spark would not reuse one), and a lost
    executor recomputes from the checkpoint, not from the sources."""
    checkpoint_dir(df.sparkSession)
    return with_block(df, order, block_size).repartition(*keys, "_blk").checkpoint(eager=True)


def running_sums(df: DataFrame, keys, order: str, values: dict[str, Column], tiebreak: tuple[str, ...] = (),
                 block_size: int = DEFAULT_BLOCK, totals: tuple[str, ...] = ()) -> DataFrame:
    """For each ``name: value``, the sum of ``value`` over rows of the key up
    to and including this one in (order, *tiebreak) order (ROWS frame); null
    while only nulls were seen, as a window SUM. ``totals`` names those whose
    sum over the whole key is added as ``name_total``. All are computed in one
    pass: one clustered copy, one summary row per block, one join."""
    keys, names = _keys(keys), list(values)
    x = _clustered(df.select("*", *[v.alias(f"_v_{n}") for n, v in values.items()]), keys, order, block_size)
    w = (Window.partitionBy(*keys, "_blk").orderBy(order, *tiebreak)
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    inb = x.select("*", *[F.sum(f"_v_{n}").over(w).alias(f"_in_{n}") for n in names])
    tot = x.groupBy(*keys, "_blk").agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in names])
    wb, wk = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*keys)
    off = tot.select(*keys, "_blk", *[F.sum(f"_t_{n}").over(wb).alias(f"_off_{n}") for n in names],
                     *[F.sum(f"_t_{n}").over(wk).alias(f"{n}_total") for n in totals])
    on = reduce(and_, (inb[k].eqNullSafe(off[k]) for k in [*keys, "_blk"]))
    out = inb.join(off, on).drop(*[off[k] for k in [*keys, "_blk"]])
    for n in names:
        out = out.withColumn(n, F.when(F.col(f"_in_{n}").isNotNull() | F.col(f"_off_{n}").isNotNull(),
                                       F.coalesce(f"_in_{n}", F.lit(0)) + F.coalesce(f"_off_{n}", F.lit(0))))
    return out.drop("_blk", *[f"_{p}_{n}" for n in names for p in ("v", "in", "off")])


def running_sum(df: DataFrame, keys, order: str, value: Column, out: str,
                tiebreak: tuple[str, ...] = (), block_size: int = DEFAULT_BLOCK) -> DataFrame:
    """``running_sums`` of one value."""
    return running_sums(df, keys, order, {out: value}, tiebreak, block_size)


def carry_forward(df: DataFrame, keys, order: str, value: Column, out: str,
                  tiebreak: tuple[str, ...] = (), block_size: int = DEFAULT_BLOCK) -> DataFrame:
    """``out`` = the last non-null ``value`` of the key up to and including
    this row (like ``last(value, ignorenulls)`` over a running frame)."""
    keys = _keys(keys)
    x = _clustered(df.withColumn("_v", value), keys, order, block_size)
    w = (Window.partitionBy(*keys, "_blk").orderBy(order, *tiebreak)
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    wall = (Window.partitionBy(*keys, "_blk").orderBy(order, *tiebreak)
            .rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    inb = (x.withColumn("_in", F.last("_v", ignorenulls=True).over(w))
            .withColumn("_bl", F.last("_v", ignorenulls=True).over(wall)))
    tot = inb.groupBy(*keys, "_blk").agg(F.first("_bl").alias("_bl"))
    wb = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    prev = tot.select(*keys, "_blk", F.last("_bl", ignorenulls=True).over(wb).alias("_prev"))
    return (inb.join(prev, keys + ["_blk"])
               .withColumn(out, F.coalesce(F.col("_in"), F.col("_prev")))
               .drop("_v", "_blk", "_prev", "_in", "_bl"))


def next_value(df: DataFrame, keys, order: str, value: str, out: str,
               tiebreak: tuple[str, ...] = (), block_size: int = DEFAULT_BLOCK) -> DataFrame:
    """``out`` = ``value`` (non-null) of the next row of the key in
    (order, *tiebreak) order, null for the last row (``lead``)."""
    keys = _keys(keys)
    x = _clustered(df, keys, order, block_size)
    w = Window.partitionBy(*keys, "_blk").orderBy(order, *tiebreak)
    wall = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    inb = x.withColumn("_ln", F.lead(value).over(w)).withColumn("_bf", F.first(value).over(wall))
    tot = inb.groupBy(*keys, "_blk").agg(F.first("_bf").alias("_bf"))
    wb = Window.partitionBy(*keys).orderBy("_blk")
    nxt = tot.select(*keys, "_blk", F.lead("_bf").over(wb).alias("_nb"))
    return (inb.join(nxt, keys + ["_blk"])
               .withColumn(out, F.coalesce(F.col("_ln"), F.col("_nb")))
               .drop("_blk", "_nb", "_ln", "_bf"))
