"""Readers for the input tables (one parquet dataset per table)."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def read_table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Parquet scan; naming ``columns`` makes the projection explicit, and
    Catalyst prunes the ReadSchema to them either way."""
    df = spark.read.parquet(table_path(sf_dir, name))
    return df.select(*columns) if columns else df


QUESTION_SCHEMA = T.StructType([
    T.StructField("question_id", T.LongType()),
    T.StructField("question", T.StringType()),
    T.StructField("options", T.ArrayType(T.StringType())),
    T.StructField("answer", T.StringType()),
    T.StructField("answer_index", T.IntegerType()),
    T.StructField("cot_content", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("src", T.StringType()),
])


def read_questions(spark: SparkSession, path: str, fmt: str = "parquet", split: str | None = None) -> DataFrame:
    """A benchmark split (parquet or JSON lines) with a fixed schema,
    options cleaned (P1); ``split`` adds its name as a column."""
    from ..operators.clean import clean_options
    df = clean_options(spark.read.schema(QUESTION_SCHEMA).format(fmt).load(path))
    return df if split is None else df.withColumn("split", F.lit(split))
