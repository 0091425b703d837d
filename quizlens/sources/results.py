"""Result files and summaries.

The reference keeps one JSON array per category (``<category>_result.json``)
and rewrites it whole after every answer. Here:

* ``read_result_files`` reads that format, several tasks a file
  (``array_files``), keeping the file's identity, the category from the
  file name and each row's position in its file (``seq``). Files that are
  not a JSON array, or do not parse, and rows that do not fit go to a
  quarantine DataFrame instead of stopping the job (the reference retries
  forever).
* ``write_results`` / ``read_results`` use the scalable form: JSON lines
  partitioned by category under a new version folder per write; readers
  take the newest version with a commit marker, so a failed write is never
  visible.
"""

from __future__ import annotations

import os
import uuid
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path
from . import array_files

RESULT_SCHEMA = T.StructType([
    T.StructField("seq", T.LongType()),
    T.StructField("question_id", T.LongType()),
    T.StructField("question", T.StringType()),
    T.StructField("options", T.ArrayType(T.StringType())),
    T.StructField("answer", T.StringType()),
    T.StructField("answer_index", T.IntegerType()),
    T.StructField("cot_content", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("src", T.StringType()),
    T.StructField("pred", T.StringType()),
    T.StructField("model_outputs", T.StringType()),
])


def read_result_files(spark: SparkSession, pattern: str, schema: T.StructType = RESULT_SCHEMA,
                      suffix: str = "_result.json"):
    """``(good, bad)`` rows of JSON-array files (see ``array_files``)."""
    return array_files.read_result_files(spark, pattern, schema, suffix)


def write_results(df: DataFrame, base: str, version: int | None = None) -> str:
    """Write ``df`` as JSON lines partitioned by category into a new
    version folder ``base/v=<n>``, then record the version under
    ``base/commits``; readers only see recorded versions, so a write that
    failed half way is never read. A version's folder carries a name of its
    own, so two writers of one number, or a retry, never touch each other's
    files; the last one to commit is read."""
    spark = df.sparkSession
    v = version if version is not None else (max(committed(spark, base), default=(0, ""))[0] + 1)
    name = f"v={v:09d}-{uuid.uuid4().hex[:12]}"
    df.withColumn("_category", F.col("category")).write.partitionBy("_category").json(os.path.join(base, "data", name))
    spark.range(1).select(F.lit(v).cast("bigint").alias("version"), F.lit(name).alias("name")) \
        .write.parquet(os.path.join(base, "commits", name))
    return os.path.join(base, "data", name)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists, by Hadoop's file system."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def committed(spark: SparkSession, base: str) -> list[tuple[int, str]]:
    """Number and folder of every version whose write finished (one tiny row
    each). Only a missing folder means none; any other error is raised."""
    path = os.path.join(base, "commits")
    if not exists(spark, path):
        return []
    return sorted((int(r.version), r.name) for r in spark.read.schema("version bigint, name string").parquet(f"{path}/*").collect())


def _newest(spark: SparkSession, base: str) -> str:
    vs = committed(spark, base)
    if not vs:
        raise FileNotFoundError(f"no committed version under {base}")
    return os.path.join(base, "data", vs[-1][1])


def read_results(spark: SparkSession, base: str, schema: T.StructType = RESULT_SCHEMA,
                 quarantine: bool = False):
    """Newest committed version of ``base``. A line that does not parse raises;
    with ``quarantine`` such lines are returned beside the good rows
    (``(good, bad)``) instead."""
    path = _newest(spark, base)
    if not quarantine:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path).drop("_category")
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file_path"))
    parsed = lines.withColumn("_r", F.from_json("value", T.StructType([*schema.fields, T.StructField("_bad", T.StringType())]), {"columnNameOfCorruptRecord": "_bad"}))
    broken = F.col("_r").isNull() | F.col("_r._bad").isNotNull()
    return (parsed.where(~broken).select(*[F.col("_r")[f.name].alias(f.name) for f in schema.fields]),
            parsed.where(broken).select("file_path", F.col("value").alias("_corrupt_record")))


def read_categories(spark: SparkSession, base: str, categories, schema: T.StructType = RESULT_SCHEMA) -> DataFrame:
    """The rows of some categories of the newest committed version; files of
    other categories are not read. ``categories`` is a list (None: rows without
    one), pruned while planning, or a DataFrame with a column ``category``,
    whose values prune the scan at run time where its join is broadcast
    (adaptive execution does so only for a side that it measured small)."""
    full = T.StructType([*schema.fields, T.StructField("_category", T.StringType())])
    t = spark.read.schema(full).option("mode", "FAILFAST").json(_newest(spark, base))
    folder = lambda c: F.nullif(c, F.lit(""))  # noqa: E731  null and empty names share the default folder
    if isinstance(categories, DataFrame):
        wanted = categories.select(F.col("category").alias("_wanted")).distinct()
        wanted = wanted.withColumn("_folder", folder(F.col("_wanted")))
        named = wanted.where(F.length("_folder") > 0)
        rows = t.join(named, (F.col("_category") == F.col("_folder")) & (F.col("category") == F.col("_wanted")), "left_semi")
        none = wanted.where("_folder is null")
        rest = t.where("_category is null").join(none, F.col("category").eqNullSafe(F.col("_wanted")), "left_semi")
        return rows.union(rest).select(*schema.fieldNames())
    names = list(dict.fromkeys(categories))
    in_folder = F.col("_category").isin([c for c in names if c])
    if any(not c for c in names):
        in_folder = in_folder | F.col("_category").isNull()
    exact = F.col("category").isin([c for c in names if c is not None])
    if None in names:
        exact = F.coalesce(exact, F.lit(False)) | F.col("category").isNull()
    return t.where(in_folder).where(exact).select(*schema.fieldNames())


def read_shards(spark: SparkSession, base: str, shards: int, schema: T.StructType = RESULT_SCHEMA) -> tuple[DataFrame, DataFrame]:
    """U4: the results of a run dealt over ``shards`` processes that each write
    (``write_results``) under ``base/shard=<i>`` and may be absent, running or
    half written. Returns the rows of every shard's newest committed version,
    with ``shard``, and a table ``(shard, state)``: ``committed``, ``started``
    (a folder without a commit) or ``absent``. One scan reads all shards; the
    driver looks at ``shards`` folders."""
    found = {}
    for i in range(shards):
        path = os.path.join(base, f"shard={i}")
        versions = committed(spark, path)
        found[i] = (os.path.join(path, "data", versions[-1][1]) if versions else None, "committed" if versions else "started" if exists(spark, path) else "absent")
    paths = [p for p, _ in found.values() if p]
    states = spark.createDataFrame([(i, s) for i, (_, s) in found.items()], "shard int, state string")
    if not paths:
        return spark.createDataFrame([], T.StructType([*schema.fields, T.StructField("shard", T.IntegerType())])), states
    rows = spark.read.schema(schema).option("mode", "FAILFAST").option("recursiveFileLookup", True).json(paths)
    shard = F.regexp_extract(F.col("_metadata.file_path"), r"/shard=(\d+)/data/", 1).cast("int")
    return rows.select(*schema.fieldNames(), shard.alias("shard")), states


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A new folder under the shared checkpoint folder."""
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex[:12]}")


def write_summary(summary_json: DataFrame, path: str) -> None:
    """One JSON summary line per model (bounded: one row per model)."""
    summary_json.select(F.concat_ws("\t", *summary_json.columns)).coalesce(1) \
        .write.mode("overwrite").text(path)


def append_history(rows: DataFrame, path: str, run_id: str | None = None) -> None:
    """Append run-history rows ``[model, CoT, subjects, time, acc]``. With
    ``run_id`` the rows go to a folder of that run, which a retry of the run
    replaces, so no run counts twice; without, they are only appended."""
    if run_id is None:
        rows.write.mode("append").csv(path)
    else:
        rows.write.mode("overwrite").csv(os.path.join(path, f"run={quote(run_id, safe='')}"))


def read_history(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """All rows of the history that ``append_history`` wrote, in columns of
    ``schema``."""
    return spark.read.schema(schema).option("recursiveFileLookup", True).csv(path)


def write_report(lines: DataFrame, path: str, by: str = "model") -> None:
    """The text report in line order (a few lines per model)."""
    lines.orderBy(by, "line_no").select("line").coalesce(1).write.mode("overwrite").text(path)


def header_template(spark: SparkSession, path: str | None = None):
    """The prompt header template as a Column - the file read whole
    (one row) and used as a scalar subquery, so no join is needed; without a
    path, the built-in template."""
    from ..operators.prompts import LOCAL_HEADER_TEMPLATE
    if path is None:
        return F.lit(LOCAL_HEADER_TEMPLATE)
    return spark.read.text(path, wholetext=True).select("value").scalar()
