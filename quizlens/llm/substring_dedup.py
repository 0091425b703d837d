"""Removal of passages that occur in several places of the corpus."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, filter_of, read, row_of
from .registry import register

MIN_RUN = 30        #: words of neighbouring repeated units from which on they go; 1 removes every repeated unit
UNIT = re.compile(r"[^\n.!?,;:]*(?:[.!?,;:]+|\n|\Z)")
FLUSH = 1 << 20     #: hashes that a task holds before it combines them
PART = 512          #: texts that a task cuts at once


def units(text: str | None) -> list[tuple[int, int, int, bytes]]:
    """(start, end, words, 128-bit digest) of every unit with a word. Units end
    at a line end or after a run of ``.!?,;:``; the digest is of the words, lower-cased, one
    space between."""
    out = []
    for m in UNIT.finditer(text or ""):
        words = m.group().split()
        if words:
            out.append((m.start(), m.end(), len(words), hashlib.blake2b(" ".join(words).lower().encode("utf-8", "replace"), digest_size=16).digest()))
    return out


def short(digests: list[bytes]) -> np.ndarray:
    """The digests' first 64 bits."""
    return np.frombuffer(b"".join(d[:8] for d in digests), np.uint64)


def runs(found: list[tuple[int, int, int, bytes]], repeated: set[int], min_run: int) -> list[tuple[int, int]]:
    """(first, last + 1) of the runs of neighbouring repeated units of ``min_run`` words or more."""
    out, i = [], 0
    while i < len(found):
        j, words = i, 0
        while j < len(found) and j in repeated:
            words += found[j][2]
            j += 1
        if j > i and words >= min_run:
            out.append((i, j))
        i = max(j, i + 1)
    return out


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_run: int = MIN_RUN,
                    scratch: Scratch | None = None) -> DataFrame:
    """For every row: ``row`` (struct of all columns), new ``text``,
    ``kept_spans`` (start and end in the old text), ``n_units``, ``repeats`` (all
    repeated units: number, start, end in the old text, and the id where the
    unit stays) and ``removed`` (those of them that went).

    Units are clauses: text up to a line end or the end of a run of
    ``.!?,;:``; every one with a word counts. Of equal normalised units the
    earliest is the original: the one of the smallest id (null ids last), then
    the first in the text; all others are repeats, also within one document.
    Repeats go where neighbouring ones make up a passage of ``min_run`` words or
    more (1: each by itself), since single short clauses repeat by chance.

    A first scan finds the 64-bit hashes that occur more than once, combined in
    each task; a second one hands on only the units of these hashes (by a Bloom
    filter of bounded size, so some others too), with 128-bit digests, which an
    aggregate groups map-side and a join brings back to the occurrences, where
    adaptive execution splits a hot unit; no group is collected.

    Rows with equal id and text count as one document and get the same result.
    A null text stays null; an empty one stays empty; a very long text without
    any of the marks is one unit. An empty table gives an empty result. Columns
    of any name are carried in ``row``.
    """
    s = scratch or Scratch(docs.sparkSession)
    key = F.xxhash64(F.col(id_col).cast("string"), F.col(text_col))
    d = docs.select(row_of(docs).alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"), key.alias("key"))
    kind = d.schema["id"].dataType.simpleString()

    def hashes(batches):
        held, size = [], 0

        def combined():
            h, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.record_batch([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], ["h", "n"])

        for b in batches:
            for t in b.column(0):
                held.append(short([u[3] for u in units(t.as_py())]))
                size += len(held[-1])
                if size > FLUSH:
                    yield combined()
                    held, size = [], 0
        if held:
            yield combined()

    often = d.select("text").mapInArrow(hashes, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n")).where("n > 1").select("h")
    often = s.keep(often, "often")
    table = docs.sparkSession.sparkContext.broadcast(filter_of(often, often.count()))

    def occurrences(batches):
        for b in batches:
            take, unit, digest = [], [], []
            for i, t in enumerate(b.column(2)):
                got = [u[3] for u in units(t.as_py())]
                for j in np.flatnonzero(table.value(short(got))).tolist():
                    take.append(i)
                    unit.append(j)
                    digest.append(got[j])
            take = pa.array(take, pa.int64())
            yield pa.record_batch([b.column(0).take(take), b.column(1).take(take), pa.array(unit, pa.int32()), pa.array(digest, pa.binary())],
                                  ["id", "key", "unit", "digest"])

    found = s.keep(d.select("id", "key", "text").mapInArrow(occurrences, f"id {kind}, key bigint, unit int, digest binary"), "units")
    rank = F.struct(F.col("id").isNull().alias("no"), "id", "key", "unit")
    repeated = (found.groupBy("digest").agg(F.min(rank).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    gone = (found.join(repeated, "digest").where(~rank.eqNullSafe(F.col("first")))
            .groupBy("id", "key").agg(F.sort_array(F.collect_set(F.struct("unit", F.col("first.id").alias("stays_in")))).alias("gone")))
    marked = d.join(gone.select(F.col("id").alias("gid"), F.col("key").alias("gkey"), "gone"),
                    (F.col("key") == F.col("gkey")) & F.col("id").eqNullSafe(F.col("gid")), "left").select("row", "text", "gone")

    def cut(batches):
        for b in (whole.slice(i, PART) for whole in batches for i in range(0, whole.num_rows, PART)):
            rows = []
            for text, gone in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                got, stays = units(text), {g["unit"]: g["stays_in"] for g in gone or ()}
                away = runs(got, set(stays), min_run)
                spans, at = [], 0
                for i, j in [*away, (len(got), len(got))]:
                    start = got[i][0] if i < len(got) else len(text or "")
                    if start > at:
                        spans.append({"start": at, "end": start})
                    at = got[j - 1][1] if i < j else at
                tell = lambda k: {"unit": k, "start": got[k][0], "end": got[k][1], "stays_in": stays[k]}
                rows.append((None if text is None else "".join(text[x["start"]:x["end"]] for x in spans), spans, len(got),
                             [tell(k) for k in sorted(stays)], [tell(k) for i, j in away for k in range(i, j)]))
            cols = list(zip(*rows)) or [[]] * 5
            unit = pa.list_(pa.struct([("unit", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("stays_in", b.schema.field(2).type.value_type.field("stays_in").type)]))
            kinds = [pa.string(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), pa.int32(), unit, unit]
            yield pa.record_batch([b.column(0), *map(pa.array, cols, kinds)], ["row", "text", "kept_spans", "n_units", "repeats", "removed"])

    unit = f"array<struct<unit:int,start:int,end:int,stays_in:{kind}>>"
    rest = T.StructType.fromDDL(f"text string, kept_spans array<struct<start:int,end:int>>, n_units int, repeats {unit}, removed {unit}")
    return marked.mapInArrow(cut, T.StructType([marked.schema["row"], *rest.fields]))


@register("op1_substring_dedup")
def op1_substring_dedup(spark, sf_dir):
    """One row per document: the text without repeated passages, the spans that
    stay, the repeated units and what was removed."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup(docs).select("row.doc_id", "text", "kept_spans", "n_units", F.size("repeats").cast("bigint").alias("n_repeats"), "removed",
                                        F.size("removed").cast("bigint").alias("n_removed"))
