"""Helpers shared by the operators of this package."""

from __future__ import annotations

import os
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir

WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
MAX_FILTER_BITS = 1 << 28   #: of one filter, at most (32 MB); fuller ones let more keys through, never fewer
FILTER_BITS_PER_KEY = 16


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


class Scratch:
    """Tables written once under the cluster's shared checkpoint folder.

    ``keep`` cuts the lineage of a frame: it writes Parquet and reads it back,
    so later steps prune columns and a lost executor loses nothing. ``drop``
    deletes tables that no later plan reads (by Hadoop's own file system, so
    any shared store works)."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = os.path.join(checkpoint_dir(spark), f"llm-{uuid.uuid4().hex}")
        self.paths: dict[str, str] = {}

    def keep(self, df: DataFrame, name: str, by: str | None = None) -> DataFrame:
        """``by``: the column whose values get folders of their own, so that a
        filter on it reads no other."""
        path = f"{self.root}/{name}"
        (df.write.partitionBy(by) if by else df.write).parquet(path)
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        jvm = self.spark._jvm
        for n in names or tuple(self.paths):
            p = jvm.org.apache.hadoop.fs.Path(self.paths.pop(n))
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


def small(batches, rows: int = 1024):
    """Arrow batches in slices, so that a task makes its results of few rows at a time."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased, everything else unchanged (``lower`` would also change
    other scripts, and the length of some texts)."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def squeeze(c: Column) -> Column:
    """Each run of ASCII white space becomes one space. The pattern skips runs
    that already are one space."""
    return F.regexp_replace(c, r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " ")


def word_count(c: Column) -> Column:
    """Number of words; null text has none."""
    return F.coalesce(F.regexp_count(c, F.lit(WORD)), F.lit(0)).cast("bigint")


def row_of(df: DataFrame, cols: list[str] | None = None) -> Column:
    """Columns, whatever their names, as one struct."""
    return F.struct(*[F.col(f"`{c}`").alias(c) for c in (df.columns if cols is None else cols)])


class Filter:
    """Bloom filter over 64-bit phrase hashes, two bits a key."""

    def __init__(self, bits: int, words: np.ndarray):
        self.words, self.mask = words, np.uint64(bits - 1)

    def __call__(self, h: np.ndarray) -> np.ndarray:
        hit = np.ones(len(h), bool)
        for shift in (3, 34):
            at = (h >> np.uint64(shift)) & self.mask
            hit &= (self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1
        return hit


def filter_of(keys: DataFrame, n: int) -> Filter:
    """Filter of the column ``h`` of ``keys`` (``n`` rows). The words with a bit
    are put together by an aggregate; the driver gets at most 2**22 of them."""
    bits = 1 << min(MAX_FILTER_BITS.bit_length() - 1, max(16, (n * FILTER_BITS_PER_KEY).bit_length()))
    at = F.explode(F.array(*[F.shiftrightunsigned("h", s).bitwiseAND(F.lit(bits - 1)) for s in (3, 34)])).alias("at")
    words = keys.select(at).groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("v"))
    t = words.toArrow()
    out = np.zeros(bits >> 6, np.uint64)
    out[t.column("word").to_numpy()] = t.column("v").to_numpy().view(np.uint64)
    return Filter(bits, out)
