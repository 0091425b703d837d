"""Streaming sinks and the incremental result merge (ST7, ST8), plus a
helper that drives a stream to completion (``availableNow``).

``merge_sink`` is the streaming form of the reference's
read-merge-dedup-rewrite after every answer: each micro-batch is upserted (J4)
against the rows of its own keys and written as one committed version; the
table is every key's newest version. Committed files are never replaced, so a
failure or a replay can lose nothing. Every version is dealt over buckets by a
hash of the key, so a batch reads the buckets of its own keys alone, and
``compact`` writes the newest rows as one version in place of all before.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.resume import MERGE_KEYS, merge
from ..session import scratch_path
from ..sources.results import exists

BUCKETS = 64        #: folders of a version, by the hash of the key; one number for the life of a table


def run_available(stream: DataFrame, sink: str, mode: str = "append", fmt: str = "parquet",
                  checkpoint: str | None = None, max_files: int | None = None) -> str:
    """Run ``stream`` over everything available now into ``sink`` and wait."""
    spark = stream.sparkSession
    ck = checkpoint or scratch_path(spark, os.path.basename(sink.rstrip("/")) + "-ckpt")
    w = stream.writeStream.outputMode(mode).option("checkpointLocation", ck).trigger(availableNow=True)
    if mode == "complete":
        def overwrite(df, _batch_id):
            df.write.mode("overwrite").format(fmt).save(sink)
        q = w.foreachBatch(overwrite).start()
    else:
        q = w.format(fmt).option("path", sink).start()
    q.awaitTermination()
    return sink


def _versions(spark: SparkSession, table: str) -> tuple[int, list[tuple[int, str]]]:
    """The newest committed version (-1: none) and the folders that make up the
    table: those since the last compaction, itself included. One tiny row per
    marker; ``purge`` removes the markers before a compaction."""
    path = f"{table}/commits"
    if not exists(spark, path):
        return -1, []
    rows = spark.read.schema("version bigint, name string, base boolean").parquet(f"{path}/*").collect()
    base = max((int(r.version) for r in rows if r.base), default=-1)
    one = min((r.name for r in rows if r.base and r.version == base), default=None)
    live = sorted((int(r.version), r.name) for r in rows if not r.base and r.version > base)
    return max((int(r.version) for r in rows), default=-1), ([(base, one)] if one else []) + live


def _bucket(keys):
    return F.pmod(F.xxhash64(*[F.col(k) for k in keys]), F.lit(BUCKETS)).cast("int")


def _commit(spark: SparkSession, df: DataFrame, table: str, version: int, keys, base: bool) -> None:
    name = f"_folder={version:09d}-{uuid.uuid4().hex[:12]}"
    # dealt by bucket into parts of like size: few files, however many tasks made the rows
    df.withColumn("_bucket", _bucket(keys)).hint("rebalance", "_bucket").write.partitionBy("_bucket").parquet(f"{table}/data/{name}")
    marker = spark.range(1).select(F.lit(version).cast("bigint").alias("version"), F.lit(name).alias("name"), F.lit(base).alias("base"))
    marker.write.parquet(f"{table}/commits/{name}")


def merge_batch(spark: SparkSession, batch: DataFrame, table: str, batch_id: int,
                keys=MERGE_KEYS, mode: str = "all") -> None:
    """Upsert one batch into the table at ``table``, as version ``batch_id``.

    Each batch is written as a version of its own, then a commit marker; the
    version holds the merged rows of the keys that the batch has, and the table
    is the newest version of every key (``read_merged``). The batch reads the
    buckets of its keys (at most ``BUCKETS`` numbers come to the driver), in the
    versions since the last ``compact``. No committed file is ever rewritten,
    and a replayed batch finds its marker, or that of a later version, or
    writes the same rows again under a new name."""
    last, live = _versions(spark, table)
    if batch_id <= last:
        return
    cols = batch.columns
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_b_{k}"))
    touched = batch.select(*[F.col(k).alias(f"_b_{k}") for k in keys]).distinct()
    buckets = sorted(r[0] for r in batch.select(_bucket(keys)).distinct().collect())
    old = _read(spark, table, live, batch.schema, keys, buckets).join(touched, same, "left_semi").select(*cols)
    _commit(spark, merge(old, batch, keys, mode).withColumn("_version", F.lit(batch_id).cast("bigint")), table, batch_id, keys, False)


def _rows(spark: SparkSession, table: str, live, schema, keys, buckets=None) -> DataFrame:
    """Every key's newest rows, with ``_version``, of the named buckets only
    (None: all)."""
    full = T.StructType([*schema.fields, T.StructField("_version", T.LongType())])
    if not live:
        return spark.createDataFrame([], full)
    stored = T.StructType([*full.fields, T.StructField("_bucket", T.IntegerType())])
    t = spark.read.schema(stored).option("basePath", f"{table}/data").parquet(*[f"{table}/data/{n}" for _, n in live])
    if buckets is not None:
        t = t.where(F.col("_bucket").isin(buckets))
    t = t.select(*full.fieldNames())
    newest = t.groupBy(*[F.col(k).alias(f"_b_{k}") for k in keys]).agg(F.max("_version").alias("_b_version"))
    same = F.col("_version") == F.col("_b_version")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_b_{k}"))
    return t.join(newest, same).select(*full.fieldNames())


def _read(spark: SparkSession, table: str, live, schema, keys, buckets=None) -> DataFrame:
    return _rows(spark, table, live, schema, keys, buckets).select(*schema.fieldNames())


def read_merged(spark: SparkSession, table: str, schema, keys=MERGE_KEYS) -> DataFrame:
    """The merged table: the rows of every key's newest committed version."""
    return _read(spark, table, _versions(spark, table)[1], schema, keys)


def compact(spark: SparkSession, table: str, schema, keys=MERGE_KEYS) -> None:
    """Writes every key's newest rows as one version that stands for all up to
    the newest. Nothing is deleted (``purge`` does that), so readers go on, and
    a compaction that fails leaves a folder without a marker, which no one
    reads. One writer: it runs between batches."""
    last, live = _versions(spark, table)
    if len(live) > 1:
        _commit(spark, _rows(spark, table, live, schema, keys), table, last, keys, True)


def purge(spark: SparkSession, table: str) -> int:
    """Deletes the folders and markers of versions that a committed compaction
    stands for; the number deleted. Readers whose plans are older than the
    compaction must have ended."""
    _, live = _versions(spark, table)
    if not live:
        return 0
    rows = spark.read.schema("version bigint, name string, base boolean").parquet(f"{table}/commits/*").collect()
    kept = {n for _, n in live}
    gone = [r.name for r in rows if r.name not in kept]
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(table).getFileSystem(spark._jsc.hadoopConfiguration())
    for name in gone:
        fs.delete(path(f"{table}/commits/{name}"), True)  # the marker first: a folder without one is read by no one
        fs.delete(path(f"{table}/data/{name}"), True)
    return len(gone)


def merge_sink(stream: DataFrame, table: str, keys=MERGE_KEYS, mode: str = "all", checkpoint: str | None = None,
               compact_after: int | None = None) -> str:
    """ST7: drive ``stream`` (result rows with ``seq``) into ``table``; a
    table belongs to one stream and its checkpoint. ``compact_after``: compact
    whenever the table is made of more versions than that."""
    spark = stream.sparkSession
    ck = checkpoint or scratch_path(spark, os.path.basename(table.rstrip("/")) + "-ckpt")

    def each(df, batch_id):
        merge_batch(df.sparkSession, df, table, batch_id, keys, mode)
        if compact_after is not None and len(_versions(df.sparkSession, table)[1]) > compact_after:
            compact(df.sparkSession, table, df.schema, keys)

    q = (stream.writeStream.foreachBatch(each).option("checkpointLocation", ck)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return table


def live_board(scored_stream: DataFrame, by=("model", "category")) -> DataFrame:
    """ST8: the live accuracy board - success / wrong counts and accuracy
    (0 when nothing finished) per group, kept by Spark's streaming
    aggregation state (complete or update mode)."""
    g = scored_stream.groupBy(*by).agg(F.count(F.lit(1)).alias("finished"),
                                       F.sum("hit").cast("bigint").alias("success"))
    return g.select(*by, "finished", "success", (F.col("finished") - F.col("success")).alias("wrong"),
                    F.coalesce(F.try_divide(F.col("success") * 100.0, F.col("finished")), F.lit(0.0))
                    .alias("accuracy"))
