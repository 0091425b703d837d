"""Mixing sources to target weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, read, row_of, word_count
from .registry import register

#: Seeds tried per source for the fractional copies.
SEEDS = 32
_MAX = float(1 << 53)


def draw(key: Column, seed: Column) -> Column:
    """A number in [0, 1) that depends on key and seed alone."""
    return F.shiftrightunsigned(F.xxhash64(key, seed), 11).cast("double") / F.lit(_MAX)


def targets(sizes: DataFrame, weights: tuple[int, ...], cap: int, share: float = 1.0) -> DataFrame:
    """``sizes(source, size)``, one row per source -> plus ``source_size``,
    ``target``.

    Sources take the weights in turn, ordered by code point, null last. Each
    target is ``level * weight``, but at most ``cap`` times the source's size;
    what the caps cut off is shared again by weight among the others, so one
    level holds for all that are below their cap. With sources ordered by
    ``cap * size / weight``, it is the level at the first source that can take
    it; levels at later sources are lower. All sums are of integers, hence
    exact. The windows run over one row per source.
    """
    ordered = Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    by_cap = Window.orderBy(F.col("cap") / F.col("w"), "n")
    before, rest = by_cap.rowsBetween(Window.unboundedPreceding, -1), by_cap.rowsBetween(0, Window.unboundedFollowing)
    every = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    t = (sizes.select("source", F.col("size").alias("source_size"), F.row_number().over(ordered).alias("n"))
         .withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.col("n") - 1) % len(weights) + 1).cast("bigint"))
         .withColumn("cap", F.col("source_size") * cap)
         .withColumn("total", F.sum("source_size").over(every) * F.lit(share))
         .withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("w").over(rest))
         .withColumn("level", F.max(F.when(F.col("level") <= F.col("cap") / F.col("w"), F.col("level"))).over(every)))
    return t.select("source", "source_size",
                    F.least(F.col("cap").cast("double"), F.coalesce(F.col("level"), F.col("cap")) * F.col("w")).alias("target"))


def mix_plan(sized: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3, share: float = 1.0) -> DataFrame:
    """``sized(source, key, size)``, one row per document -> one row per source:
    ``source, source_size, target, whole, part, seed``.

    A document of the source is to appear ``whole`` times, and once more with
    probability ``part``. Any one seed gives every document that probability; of
    ``SEEDS`` seeds the one is kept whose copies come nearest to the target, so
    that a few long documents don't carry a small source off its target. With
    that choice a document's chance is near ``part``, not exactly it. The windows
    over sources see one row per source (they suit up to some 10**5 sources). Both
    passes are aggregates by source, combined before the shuffle, so a source
    with a third of all rows costs no more than others.
    """
    total = sized.groupBy("source").agg(F.sum("size").alias("size"))
    t = targets(total, weights, cap, share).withColumn(
        "rate", F.coalesce(F.try_divide(F.col("target"), F.col("source_size")), F.lit(0.0)))
    t = t.withColumn("whole", F.floor("rate")).withColumn("part", F.col("rate") - F.col("whole"))
    drawn = (sized.join(t.select(F.col("source").alias("s"), "part"), F.col("source").eqNullSafe(F.col("s")))
             .groupBy("source").agg(*[F.sum(F.when(draw(F.col("key"), F.lit(k)) < F.col("part"), F.col("size")).otherwise(0))
                                      .alias(f"k{k}") for k in range(SEEDS)]))
    off = [F.struct(F.abs(F.col("whole") * F.col("source_size") + F.col(f"k{k}") - F.col("target")).alias("off"),
                    F.lit(k).alias("seed")) for k in range(SEEDS)]
    return (t.join(drawn.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
            .withColumn("seed", F.array_min(F.array(*off))["seed"])
            .select("source", "source_size", "target", "whole", "part", "seed"))


def copies(df: DataFrame, plan: DataFrame) -> DataFrame:
    """Adds ``plan`` (the source's row) and ``copies`` to ``df(source, key, ...)``."""
    p = plan.select(F.struct(*plan.columns).alias("plan"))
    n = F.col("plan.whole") + F.when(draw(F.col("key"), F.col("plan.seed")) < F.col("plan.part"), 1).otherwise(0)
    return df.join(p, F.col("source").eqNullSafe(F.col("plan.source"))).withColumn("copies", n)


def document_key(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.col(id_col).cast("string"), F.col(text_col))


def sizes(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"),
                       document_key(id_col, text_col).alias("key"), word_count(F.col(text_col)).alias("size"))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3, share: float = 1.0,
                id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                scratch: Scratch | None = None) -> DataFrame:
    """Every row of ``docs`` as often as the mix takes it, columns unchanged.

    The draw depends on id and text, so reruns and retries agree; repeated rows
    share it. Null sources are a source of their own; a null or empty text has
    no words and weighs nothing, but is emitted at its source's rate. A source
    without words has target 0 and its rows go. An empty table stays empty; a
    very long text is a large size, and columns may have any names.
    The text is read twice (to count, to emit) and shuffled only if the table
    of sources is too large for a broadcast by measured size.
    """
    s = scratch or Scratch(docs.sparkSession)
    sized = s.keep(sizes(docs, id_col, text_col, source_col), "sized")
    plan = s.keep(mix_plan(sized, weights, cap, share), "plan")
    s.drop("sized")
    rows = docs.select(row_of(docs).alias("row"), F.col(source_col).alias("source"),
                       document_key(id_col, text_col).alias("key"))
    return (copies(rows, plan).where("copies > 0")
            .select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).select("row.*"))


@register("op2_mix_sources")
def op2_mix_sources(spark, sf_dir):
    """One row per document: its size, its source's size and target, and the
    words the mix takes of it."""
    s = Scratch(spark)
    sized = s.keep(sizes(read(spark, sf_dir, "documents"), "doc_id", "text", "source"), "sized")
    plan = s.keep(mix_plan(sized), "plan")
    return copies(sized, plan).select(
        F.col("id").alias("doc_id"), "size", F.col("plan.source_size").alias("source_size"),
        F.col("plan.target").alias("target"), (F.col("size") * F.col("copies")).alias("taken"), "copies")
