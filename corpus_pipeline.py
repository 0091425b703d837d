"""The corpus pipeline: documents -> packed sequences.

``STAGES`` are (name, function) in order. Each function takes ``(spark, docs,
sf_dir)``, works on all rows of ``docs`` and returns a DataFrame, which is
written as Parquet and read again as the next one's ``docs``. All but the last
return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quizlens.llm import exact_dedup as ed
from quizlens.llm import language_id as li
from quizlens.llm import mix_sources as ms
from quizlens.llm import ngram_join as nj
from quizlens.llm import packing as pk
from quizlens.llm.common import Scratch, read, row_of

SHINGLE, PERCENT = 5, 80    #: near duplicates: words of a shingle, least similarity


def language(spark: SparkSession, docs: DataFrame, sf_dir: str, scratch: Scratch | None = None) -> DataFrame:
    """Documents that look like one of the languages learned from the labelled
    rows of ``docs``; letterless, empty, null and far off texts go. A null
    language is not learned from; without any label, all rows go. Repeated rows
    share a verdict, very long texts count whole, other columns pass."""
    model = li.fit(docs)
    return li.language_id(docs, model).where("not rejected").select("row.*")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str, scratch: Scratch | None = None) -> DataFrame:
    """One row of each group of equal texts (white space squeezed; null counts as
    empty), the one with the smallest id (null last, then the first row read).
    Very long texts are longer lists of chunks; other columns pass."""
    return ed.exact_dedup(docs, carry=docs.columns, scratch=scratch).where("kept").select("row.*")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str, scratch: Scratch | None = None) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id
    (null last; of one id, the one with the smallest row key).
    Rows that share id and text are one document and go or stay together; the
    texts themselves are shuffled once, for the join. Wordless and null texts
    stay; very long ones are larger sets; other columns pass."""
    groups = nj.ngram_join(docs, SHINGLE, PERCENT, scratch=scratch)
    goes = groups.where("not kept").select(F.col("row_key").alias("k"), F.col("id").alias("i")).distinct()
    d = docs.select(row_of(docs).alias("row"), nj.row_key("doc_id", "text").alias("k"), F.col("doc_id").alias("i"))
    return d.join(goes.select(F.col("k").alias("gk"), F.col("i").alias("gi")), F.expr("k = gk and i <=> gi"), "left_anti").select("row.*")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str, scratch: Scratch | None = None) -> DataFrame:
    """Every document as often as its source's target asks for (null is a source
    of its own). Repeated rows share a draw; wordless texts weigh nothing and go
    at their source's rate; other columns pass."""
    return ms.mix_sources(docs, scratch=scratch)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str, scratch: Scratch | None = None) -> DataFrame:
    """The pieces of all documents, repeats included, with their token ids. A null
    or empty text is its end token alone; very long texts are cut into pieces."""
    return pk.pack(docs).withColumnsRenamed({"doc": "doc_id", "crc": "ids_crc32"})


STAGES = [("language_id", language), ("exact_dedup", exact), ("ngram_join", near), ("mix_sources", mix), ("packing", pack)]

#: Classifier, tokenizer and seeds have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``. A stage's own tables go when
    its result is written, and a result when the next one is."""
    s = Scratch(spark)
    docs = read(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        own = Scratch(spark)
        docs = s.keep(stage(spark, docs, sf_dir, scratch=own), f"stage-{i}-{name}")
        own.drop()
        if i:
            s.drop(f"stage-{i - 1}-{STAGES[i - 1][0]}")
    return docs
