"""Result files that hold one JSON array each, read and written in parts.

An array file has no line ends to split at. It is read as text cut at every
``{``, which Spark's reader does in byte ranges of any size, several tasks a
file. Whether a ``{`` opens an element depends on all that precedes it in the
file: whether it lies inside a string, and how deep. Both are prefix sums (of
quotes, and of brackets outside strings), so each byte range sums up its own
part for either state it may begin in, and one small row per range gives each
the state it does begin in. Pieces of one element then meet by its number.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path

NOT_ARRAY, MALFORMED, NO_FIT = "not a JSON array", "malformed JSON", "does not fit the schema"


def _count(text: Column, char: str) -> Column:
    """How often an ASCII character occurs, by sizes in bytes."""
    return F.octet_length(text) - F.octet_length(F.replace(text, F.lit(char), F.lit("")))


def _net(text: Column) -> Column:
    """Brackets opened less those closed, of a piece whose strings are taken out."""
    outside = F.regexp_replace(text, r'"[^"]*+("|\z)', "")
    return (_count(outside, "[") - _count(outside, "]") - _count(outside, "}")).cast("bigint")


def _written(df: DataFrame) -> DataFrame:
    """``df``, written once as Parquet to the checkpoint folder: most of the steps that
    read it need its numbers only, not the text."""
    path = scratch_path(df.sparkSession, f"array-text-{uuid.uuid4().hex[:12]}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def pieces(spark: SparkSession, pattern: str) -> DataFrame:
    """The files' text between ``{`` and ``{``, in order of (``block``, ``id``)
    within a file: ``block`` is the byte range's start. Per piece ``inside`` (odd
    number of quotes before it in its range), ``first`` (of the file), and by the
    state its range begins in - 0 outside, 1 inside a string - its change of
    depth ``d`` and the range's depth before it ``e``."""
    raw = spark.read.option("lineSep", "{").text(pattern).select(
        "value", F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_name").alias("file_name"),
        F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    # without escapes: a quote left is one that counts; a piece in a string is one with a quote before it
    plain = F.when(F.contains("value", F.lit("\\")), F.regexp_replace("value", r"(?s)\\.", "")).otherwise(F.col("value"))
    x = raw.select("*", _count(plain, '"').alias("quotes"), _net(plain).alias("n0"), _net(F.concat(F.lit('"'), plain)).alias("n1"))
    order = Window.partitionBy("file_path", "block").orderBy("id")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    x = x.select("*", (F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2).alias("inside"),
                 ((F.col("block") == 0) & (F.row_number().over(order) == 1)).alias("first"))
    opened = F.when(F.col("first"), 0).otherwise(1)
    for state in (0, 1):
        x = x.withColumn(f"d{state}", F.when((F.col("inside") + state) % 2 == 0, F.col("n0") + opened).otherwise(F.col("n1")))
    for state in (0, 1):
        x = x.withColumn(f"e{state}", F.coalesce(F.sum(f"d{state}").over(before), F.lit(0)))
    return x.drop("n0", "n1")


def elements(spark: SparkSession, pattern: str) -> tuple[DataFrame, DataFrame]:
    """``(file_path, file_name, seq, text, tail)`` per array element, where ``tail``
    is what follows its last bracket, and per file ``(file_path, n, sound)`` with
    the number of elements and whether head and brackets are those of an array
    (``is_array``: whether it begins like one).

    The text is shuffled by byte range for the prefix sums, written once (as
    Parquet) to the checkpoint folder, and shuffled by element; no task holds more than a byte
    range or an element. Ranges of a file are summed up in one window of a row
    each."""
    x = _written(pieces(spark, pattern))
    along = Window.partitionBy("file_path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("file_path").orderBy("block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    b = x.groupBy("file_path", "block").agg(F.sum("quotes").alias("quotes"), F.sum("d0").alias("d0"), F.sum("d1").alias("d1"))
    b = b.withColumn("state", F.coalesce(F.sum("quotes").over(along), F.lit(0)) % 2)
    b = b.withColumn("d", F.when(F.col("state") == 0, F.col("d0")).otherwise(F.col("d1")))
    b = b.withColumn("depth", F.coalesce(F.sum("d").over(along), F.lit(0))).withColumn("last_depth", F.sum("d").over(whole)) \
         .withColumn("last_quotes", F.sum("quotes").over(whole))
    y = x.join(b.select("file_path", "block", "state", "depth"), ["file_path", "block"])
    deep = F.col("depth") + F.when(F.col("state") == 0, F.col("e0")).otherwise(F.col("e1"))
    opens = ~F.col("first") & ((F.col("inside") + F.col("state")) % 2 == 0) & (deep == 1)
    y = y.select("file_path", "file_name", "block", "id", "value", opens.cast("bigint").alias("opens"))
    in_range = Window.partitionBy("file_path", "block").orderBy("id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    y = y.withColumn("k", F.sum("opens").over(in_range))
    n = y.groupBy("file_path", "block").agg(F.sum("opens").alias("n"))
    n = n.withColumn("earlier", F.coalesce(F.sum("n").over(along), F.lit(0)))
    z = y.join(n.select("file_path", "block", "earlier"), ["file_path", "block"])
    z = z.withColumn("seq", F.col("earlier") + F.col("k") - 1).where("seq >= 0")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "id", "value"))), lambda p: p["value"]), "{")
    e = z.groupBy("file_path", "file_name", "seq").agg(F.concat(F.lit("{"), text).alias("text"))
    e = e.withColumn("tail", F.when(F.contains("text", F.lit("}")), F.substring_index("text", "}", -1)).otherwise(""))
    e = e.withColumn("text", F.expr("substring(text, 1, length(text) - length(tail))"))

    ends = b.groupBy("file_path").agg(F.max_by("last_depth", "block").alias("depth"), F.max_by(F.col("last_quotes") % 2, "block").alias("quotes"))
    heads = x.where("first").select("file_path", F.col("value").rlike(r"^\s*\[").alias("is_array"), F.col("value").rlike(r"^\s*\[\s*\z").alias("opens"),
                                    F.col("value").rlike(r"^\s*\[\s*\]\s*\z").alias("empty"))
    files = heads.join(ends, "file_path").join(n.groupBy("file_path").agg(F.sum("n").alias("n")), "file_path")
    sound = (F.col("depth") == 0) & (F.col("quotes") == 0) & F.when(F.col("n") > 0, F.col("opens")).otherwise(F.col("empty"))
    return e, files.select("file_path", "is_array", "n", sound.alias("sound"))


def read_result_files(spark: SparkSession, pattern: str, schema: T.StructType, suffix: str = "_result.json"):
    """Read ``<category>_result.json*`` files, one JSON array of objects each.

    Returns ``(good, bad)``. ``good`` has one row per element: ``file_path``,
    ``file_category`` (file name minus suffix), ``seq`` (place in the file) and
    the fields. ``bad`` has ``file_path``, ``reason``, and for a single element
    ``seq`` and its ``value``. A file that is no JSON array of objects, or does
    not parse as a whole (cut off, say), has no good row; an element that parses
    but does not fit the schema (a text where a number should be) goes alone.
    A file without a byte is in neither: Spark's readers skip it. A duplicate name in an object that fits
    nothing else counts as malformed."""
    e, files = elements(spark, pattern)
    fields = T.StructType([*[f for f in schema.fields if f.name != "seq"], T.StructField("_bad", T.StringType())])
    e = e.withColumn("_r", F.from_json("text", fields, {"columnNameOfCorruptRecord": "_bad"}))
    misfit = F.col("_r").isNull() | F.col("_r._bad").isNotNull()
    parses = ~misfit | F.when(misfit, F.try_parse_json("text")).isNotNull()
    e = e.join(files, "file_path").withColumn("misfit", misfit)
    end = F.when(F.col("seq") < F.col("n") - 1, ",").otherwise("]")
    e = e.withColumn("broken", ~parses | (F.regexp_replace("tail", r"\s", "") != end)).drop("tail", "n", "is_array", "sound")
    e = _written(e)
    broken = e.groupBy("file_path").agg(F.max("broken").alias("broken"))
    files = files.join(broken, "file_path", "left")
    wrong = ~F.col("sound") | F.coalesce("broken", F.lit(False))
    files = files.select("file_path", wrong.alias("wrong"), F.when(F.col("is_array"), MALFORMED).otherwise(NOT_ARRAY).alias("reason"))
    kept = e.drop("broken").join(files.where("not wrong").select("file_path"), "file_path")
    good = kept.where("not misfit").select(
        "file_path", F.replace("file_name", F.lit(suffix), F.lit("")).alias("file_category"), "seq", *[F.col("_r")[f.name].alias(f.name) for f in fields.fields[:-1]])
    none = [F.lit(None).cast("bigint").alias("seq"), F.lit(None).cast("string").alias("value")]
    bad = (files.where("wrong").select("file_path", "reason", *none)
           .unionByName(kept.where("misfit").select("file_path", F.lit(NO_FIT).alias("reason"), "seq", F.col("text").alias("value"))))
    return good, bad


def write_result_files(df: DataFrame, path: str, file_no: Column, by=("model", "category"), order: str = "seq",
                       line: Column | None = None) -> None:
    """Writes ``df`` (``line``: the JSON text of a row, by default of all its columns) as array files ``<by>=.../file_no=<n>/``, each one JSON array
    in ``order``, as the reference keeps them. A file is made by one task, so
    ``file_no`` divides a category into files of bounded size."""
    by = list(by)
    if line is None:
        line = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"})
    rows = df.select(*by, file_no.alias("file_no"), F.struct(F.col(order).alias("at"), line.alias("line")).alias("r"))
    files = rows.groupBy(*by, "file_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["line"]), ", ").alias("lines"))
    files.select(*by, "file_no", F.concat(F.lit("["), "lines", F.lit("]")).alias("value")).write.partitionBy(*by, "file_no").text(path)


def file_label(path: Column, by=("model", "category")) -> Column:
    """``<by>/.../<file_no>`` of the path of a file that ``write_result_files`` made."""
    decode = lambda c: F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))
    # encoded twice: a folder's name, and the path as a URI
    return F.concat_ws("/", *[decode(F.regexp_extract(decode(path), rf"/{c}=([^/]*)/", 1)) for c in (*by, "file_no")])
