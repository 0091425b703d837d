"""Edit-aware token counts."""

from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import read, row_of
from .registry import register
from .tokens import default_path, encoder

PART = 512      #: rows that a worker holds results of
LEAF = 512      #: a leaf ends at the first safe place after so many characters
#: A space or line end after a word character is a token boundary whatever stands around it.
_SAFE = re.compile(r"(?<=\w)[ \n]")
#: What the query's edits replace: long numbers and hexadecimal keys.
_SECRET = re.compile(r"\b(?:[0-9a-f]{32,}|[0-9]{9,})\b")

TREE = T.StructType([T.StructField(n, T.ArrayType(T.IntegerType(), False)) for n in ("chars", "tokens")])
EDITS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()),
                                  T.StructField("replacement", T.StringType())]))


def leaves(text: str, size: int = LEAF) -> list[str]:
    """The text cut at safe places. A text without any is one leaf."""
    out, a = [], 0
    while len(text) - a > size and (m := _SAFE.search(text, a + size)):
        out.append(text[a:m.start()])
        a = m.start()
    return [*out, text[a:]]


class SegmentTree:
    """Sums over leaves, as a heap: node i has children 2i and 2i + 1, the root
    is node 1, the leaves are the second half."""

    def __init__(self, values: list[int]):
        self.half = 1 << max(0, (len(values) - 1).bit_length())
        self.sum = [0] * self.half + values + [0] * (self.half - len(values))
        for i in range(self.half - 1, 0, -1):
            self.sum[i] = self.sum[2 * i] + self.sum[2 * i + 1]

    @classmethod
    def of(cls, heap: list[int]) -> SegmentTree:
        t = cls.__new__(cls)
        t.half, t.sum = len(heap) // 2, list(heap)
        return t

    def find(self, at: int) -> tuple[int, int]:
        """The leaf that holds position ``at``, and the sum before that leaf."""
        i, before = 1, 0
        while i < self.half:
            i *= 2
            if at - before >= self.sum[i] and self.sum[i + 1]:
                before += self.sum[i]
                i += 1
        return i - self.half, before

    def put(self, leaf: int, value: int) -> None:
        i = leaf + self.half
        more = value - self.sum[i]
        while i and more:
            self.sum[i] += more
            i //= 2


def build(text: str, count) -> tuple[SegmentTree, SegmentTree]:
    """Trees of characters and of tokens over the leaves of a text."""
    parts = leaves(text)
    return SegmentTree([len(p) for p in parts]), SegmentTree([count(p) for p in parts])


def edit(text: str, chars: SegmentTree, tokens: SegmentTree, edits: list[tuple[int, int, str]], count) -> tuple[str, int, int]:
    """Apply edits (start, end, replacement) in the old text's positions; updates
    both trees and gives the new text, the number of edits applied and the
    characters encoded again.

    An edit touches the leaves from the one holding the character before it to
    the one holding the character after it, so both ends of the region keep
    their neighbours and stay token boundaries; only regions are encoded again,
    and only their paths to the root are summed again. Positions beyond the
    text mean its end; an edit that overlaps an earlier one is left out.
    """
    n, done, regions = len(text), 0, []  # regions: first leaf, last leaf, start, end, [edits]
    free = 0
    for a, b, new in sorted((min(a, n), min(b, n), new or "") for a, b, new in edits):
        if a < free or b < a:
            continue
        free, done = max(b, free), done + 1
        lo, at = chars.find(max(0, a - 1))
        hi, to = chars.find(min(n - 1, b)) if n else (0, 0)
        to += chars.sum[hi + chars.half]
        if regions and lo <= regions[-1][1]:
            regions[-1][1], regions[-1][3] = max(hi, regions[-1][1]), max(to, regions[-1][3])
            regions[-1][4].append((a, b, new))
        else:
            regions.append([lo, hi, at, to, [(a, b, new)]])
    out, last, again = [], 0, 0
    for lo, hi, at, to, own in regions:
        parts, p = [], at
        for a, b, new in own:
            parts += [text[p:a], new]
            p = b
        region = "".join([*parts, text[p:to]])
        out += [text[last:at], region]
        last, again = to, again + len(region)
        cut, slots = leaves(region), hi - lo + 1
        cut = cut[:slots - 1] + ["".join(cut[slots - 1:])] + [""] * (slots - len(cut))  # the last slot takes what is over
        for k in range(slots):
            chars.put(lo + k, len(cut[k]))
            tokens.put(lo + k, count(cut[k]))
    return "".join([*out, text[last:]]), done, again


def _counter(path: str):
    enc = encoder(path)
    return lambda text: len(enc.encode(text)) // 4


def count_trees(docs: DataFrame, text_col: str = "text", tokenizer: str | None = None, carry: list[str] | None = None) -> DataFrame:
    """``row`` (struct of ``carry``, all columns by default), ``text`` and
    ``tree`` (heaps of characters and tokens) of every row; the root, element
    1, is the document's count. Null text counts as empty: one empty leaf."""
    path = tokenizer or default_path()
    d = docs.select(row_of(docs, carry).alias("row"), F.col(text_col).alias("text"))
    schema = T.StructType([*d.schema.fields, T.StructField("tree", TREE)])

    def run(batches):
        count = _counter(path)
        for whole in batches:
            for b in (whole.slice(a, PART) for a in range(0, whole.num_rows, PART)):
                trees = [build(t.as_py() or "", count) for t in b.column(1)]
                yield pa.record_batch([b.column(0), b.column(1), pa.array(
                    [{"chars": c.sum, "tokens": t.sum} for c, t in trees],
                    pa.struct([("chars", pa.list_(pa.int32())), ("tokens", pa.list_(pa.int32()))]))], ["row", "text", "tree"])

    return d.mapInArrow(run, schema)


def apply_edits(trees: DataFrame, tokenizer: str | None = None, text_out: bool = True,
                find: Callable[[str], list[tuple[int, int, str]]] | None = None) -> DataFrame:
    """``trees(row, text, tree, edits)`` -> ``row``, new ``text`` (null unless
    ``text_out``), new ``tree``, ``n_before``, ``edits_applied`` and
    ``chars_encoded``.

    ``edits`` is an array of (start, end, replacement); null means none. With
    ``find`` the edits come from the text instead. Where ``trees`` has no
    column ``tree``, each row's tree is built first, in the same pass: one
    Python worker a task and one copy of the text, instead of one a step. Rows
    keep their partitions; nothing is shuffled. Beyond building, very long
    texts cost what their edited regions cost. Repeated rows give equal results.
    """
    path, built = tokenizer or default_path(), "tree" in trees.columns
    heaps = pa.struct([("chars", pa.list_(pa.int32())), ("tokens", pa.list_(pa.int32()))])
    schema = T.StructType([trees.schema["row"], T.StructField("text", T.StringType()), T.StructField("tree", TREE), T.StructField("n_before", T.LongType()),
                           T.StructField("edits_applied", T.IntegerType()), T.StructField("chars_encoded", T.IntegerType())])

    def one(b, i, count):
        text = b.column("text")[i].as_py() or ""
        if built:
            tree = b.column("tree")[i].as_py()
            c, t = SegmentTree.of(tree["chars"]), SegmentTree.of(tree["tokens"])
        else:
            c, t = build(text, count)
        own = find(text) if find else [(e["start"], e["end"], e["replacement"]) for e in b.column("edits")[i].as_py() or []]
        n = t.sum[1]
        new, done, again = edit(text, c, t, own, count)
        return new if text_out else None, {"chars": c.sum, "tokens": t.sum}, n, done, again

    def run(batches):
        count = _counter(path)
        for whole in batches:
            for b in (whole.slice(a, PART) for a in range(0, whole.num_rows, PART)):
                cols = list(zip(*(one(b, i, count) for i in range(b.num_rows)))) or [[]] * 5
                kinds = [pa.string(), heaps, pa.int64(), pa.int32(), pa.int32()]
                yield pa.record_batch([b.column("row"), *map(pa.array, cols, kinds)], ["row", "text", "tree", "n_before", "edits_applied", "chars_encoded"])

    return trees.select("row", "text", *["tree"] * built, *["edits"] * (find is None)).mapInArrow(run, schema)


def secret_edits(text: str | None) -> list[tuple[int, int, str]]:
    """Long numbers and hexadecimal keys become ``[removed]``."""
    return [(m.start(), m.end(), "[removed]") for m in _SECRET.finditer(text or "")]


@register("op4_token_counts")
def op4_token_counts(spark, sf_dir):
    """One row per document: tokens before and after secrets are replaced."""
    docs = read(spark, sf_dir, "documents").select(F.struct("doc_id").alias("row"), "text")
    return apply_edits(docs, text_out=False, find=secret_edits).select(
        "row.doc_id", F.col("n_before").alias("n_tokens"), F.col("tree.tokens")[1].cast("bigint").alias("n_tokens_edited"),
        F.col("tree.chars")[1].cast("bigint").alias("n_chars_edited"), F.col("edits_applied").cast("bigint").alias("n_edits"),
        F.col("chars_encoded").cast("bigint").alias("chars_encoded_again"))
