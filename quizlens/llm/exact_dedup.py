"""Exact deduplication by content-defined chunk recipes (native)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, read, row_of, squeeze
from .registry import register

#: A chunk ends after a word whose last letters are one of a-f and one of n-s,
#: 1024 characters or more from its start, or else after 8192 characters.
CHUNK = r"(?s).{1024,8191}?(?:(?<=[a-f][n-s]\x20)|\z)|.{1,8192}"


def recipes(docs: DataFrame, id_col: str, text_col: str, carry: list[str]) -> DataFrame:
    """Per row: its number, id, the SHA-256 of the normalised text and the
    chunks as (64-bit id, SHA-256). A null text counts as empty."""
    norm = squeeze(F.coalesce(F.col(text_col), F.lit("")))
    return (docs.select(row_of(docs, carry).alias("row") if carry else F.lit(0).alias("row"),
                        F.col(id_col).alias("id"), norm.alias("norm"))
            .select(F.monotonically_increasing_id().alias("rid"), "row", "id", F.sha2("norm", 256).alias("sha"),
                    F.transform(F.regexp_extract_all("norm", F.lit(CHUNK), F.lit(0)),
                                lambda c: F.struct(F.xxhash64(c).alias("cid"), F.unhex(F.sha2(c, 256)).alias("strong")))
                    .alias("chunks")))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                carry: list[str] | None = None, scratch: Scratch | None = None) -> DataFrame:
    """Rows of equal normalised text share a group; one row of each stays.

    Returns, for every input row: ``row`` (struct of the columns named in
    ``carry``), ``id``, ``keep_id``, ``group_size``, ``kept``, ``sha``.

    Texts are cut into chunks at places that the text itself determines. The
    distinct chunks get identifiers verified by SHA-256: chunks that share the
    64-bit id but not the digest get different variants. Two texts are equal
    when their ordered identifier lists are. The text is read once; only the
    identifiers (about 1 % of it) are shuffled.

    Of a group, the row with the smallest id stays (null ids last, then the
    first read row), so exactly one of repeated rows stays. A null text counts
    as empty, all empty texts are equal. Very long texts are longer lists. An
    empty table gives an empty result; other columns are not looked at.
    """
    spark = docs.sparkSession
    s = scratch or Scratch(spark)
    d = s.keep(recipes(docs, id_col, text_col, carry or []), "recipes")

    occ = d.select("rid", F.posexplode("chunks").alias("pos", "c")).select("rid", "pos", "c.cid", "c.strong")
    # distinct chunks; the window holds the few digests of one 64-bit id
    idents = (occ.select("cid", "strong").distinct()
              .selectExpr("cid", "strong", "row_number() over (partition by cid order by strong) as variant"))
    lists = (occ.join(idents, ["cid", "strong"])
             .groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("pos", "cid", "variant"))).alias("l"))
             .select("rid", F.transform("l", lambda x: F.struct(x["cid"].alias("cid"), x["variant"].alias("variant"))).alias("list")))
    texts = d.select("rid", "id").join(lists, "rid", "left")
    # an empty text has no chunk and no list; as a key, the list is compared whole
    texts = s.keep(texts.select("rid", "id", F.coalesce(F.to_json("list"), F.lit("[]")).alias("list")), "lists")
    groups = texts.groupBy("list").agg(
        F.min(F.struct(F.col("id").isNull().alias("no"), "id", "rid")).alias("first"), F.count(F.lit(1)).alias("group_size"))
    verdict = texts.select("rid", "list").join(groups, "list").select("rid", "first", "group_size")
    return (d.select("rid", "row", "id", "sha").join(verdict, "rid")
            .select("row", "id", F.col("first.id").alias("keep_id"), "group_size",
                    (F.col("rid") == F.col("first.rid")).alias("kept"), "sha"))


SQL = r"""
with n as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as t from documents)
select doc_id, min(doc_id) over w as keep_id, count(*) over w as group_size,
       doc_id = min(doc_id) over w as kept, sha256(t) as text_sha256
from n window w as (partition by t)
"""


@register("op9_exact_dedup", SQL)
def op9_exact_dedup(spark, sf_dir):
    """One row per document: which copy stays, the size of its group, the
    SHA-256 of the normalised text."""
    return exact_dedup(read(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("sha").alias("text_sha256"))
