"""Bounded-space online packing of documents into token sequences."""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, read, small
from .registry import register
from .tokens import default_path, encoder

LENGTH = 1024       #: ids in a sequence
OPEN = 16           #: open windows of a task
LEAST = 8           #: a gap of fewer ids is padded, not filled by a cut
FAN_IN = 64         #: tasks whose leftovers one merge step takes
END = b"\0\0\0\0"   #: id 0 after each document

_NAMES = ["doc", "start", "length", "crc", "doc_tokens", "sequence_id", "offset", "ids"]


class Packer:
    """Open windows of one task. A piece is (document, first id, ids, ids of the
    whole document); windows hold their pieces until they are emitted."""

    def __init__(self, base: int, length: int, windows: int, least: int, with_ids: bool):
        self.base, self.length, self.windows, self.least, self.with_ids = base, length, windows, least, with_ids
        self.open: list[list] = []  # [free, pieces]
        self.n = 0
        self.rows: list[tuple] = []

    def emit(self, pieces: list) -> None:
        at = 0
        for doc, start, ids, total in pieces:
            self.rows.append((doc, start, len(ids) // 4, zlib.crc32(ids), total, self.base + self.n, at, ids if self.with_ids else None))
            at += len(ids) // 4
        self.n += 1

    def add(self, doc, start: int, ids: bytes, total: int) -> None:
        """Full sequences are emitted at once, the rest goes to the best window."""
        size, a = 4 * self.length, 0
        while len(ids) - a >= size:
            self.emit([(doc, start + a // 4, ids[a:a + size], total)])
            a += size
        while a < len(ids):
            n = (len(ids) - a) // 4
            best = min((w for w in self.open if w[0] >= n), key=lambda w: w[0], default=None)
            if best is None and len(self.open) < self.windows:
                self.open.append(best := [self.length, []])
            if best is None:  # none fits: the fullest goes, filled by a cut unless its gap is tiny
                best = min(self.open, key=lambda w: w[0])
                if (n := best[0]) < self.least:
                    self.open.remove(best)
                    self.emit(best[1])
                    continue
            best[1].append((doc, start + a // 4, ids[a:a + 4 * n], total))
            best[0] -= n
            a += 4 * n
            if best[0] == 0:
                self.open.remove(best)
                self.emit(best[1])

    def leftovers(self) -> list[tuple]:
        return [(doc, start, len(ids) // 4, zlib.crc32(ids), total, None, None, ids)
                for _, pieces in self.open for doc, start, ids, total in pieces]

    def close(self) -> None:
        """The last task's open windows: one after the other into full sequences;
        the end is cut into sequences whose lengths are powers of two."""
        rest, self.open = [p for _, pieces in self.open for p in pieces], []
        left = sum(len(p[2]) for p in rest) // 4
        while left:
            room = self.length if left >= self.length else 1 << (left.bit_length() - 1)
            left -= room
            pieces = []
            while room:
                doc, start, ids, total = rest.pop(0)
                pieces.append((doc, start, ids[:4 * room], total))
                if len(ids) > 4 * room:
                    rest.insert(0, (doc, start + room, ids[4 * room:], total))
                room -= len(pieces[-1][2]) // 4
            self.emit(pieces)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None,
         length: int = LENGTH, windows: int = OPEN, least: int = LEAST, fan_in: int = FAN_IN,
         with_ids: bool = True, scratch: Scratch | None = None) -> DataFrame:
    """Pieces of all documents: ``doc`` (the id), ``start``, ``length``, ``crc``
    (CRC-32 of the ids as little-endian 32-bit integers), ``doc_tokens``,
    ``sequence_id``, ``offset`` and ``ids`` (binary, null without ``with_ids``).

    Each task packs the documents it reads, in one pass, with ``windows`` open
    windows: nothing is shuffled but the windows still open at the end of a
    task (at most ``windows * length`` ids), which are merged by up to
    ``fan_in`` tasks at a time until one is left. Each id is in one piece. A
    null or empty text is its end id alone; a very long one fills sequences of
    its own; repeated rows are packed as often as they occur, null ids stay
    null; an empty table has no pieces. Sequence numbers are made of level,
    task and a count; a retried task makes the same ones. ``tokenizer`` is the
    path of the vocabulary on every machine.
    """
    s = scratch or Scratch(docs.sparkSession)
    path = tokenizer or default_path()
    d = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    kind = d.schema["doc"].dataType
    schema = T.StructType([T.StructField("doc", kind)] + [T.StructField(n, T.LongType()) for n in _NAMES[1:7]]
                          + [T.StructField("ids", T.BinaryType()), T.StructField("task", T.LongType())])

    def batch(rows: list[tuple], task: int, doc: pa.DataType) -> pa.RecordBatch:
        cols = list(zip(*rows)) or [[]] * len(_NAMES)
        return pa.record_batch([pa.array(cols[0], doc), *[pa.array(c, pa.int64()) for c in cols[1:7]],
                                pa.array(cols[7], pa.binary()), pa.array([task] * len(rows), pa.int64())], [*_NAMES, "task"])

    def first(batches):
        task, enc, kind = TaskContext.get().partitionId(), encoder(path), None
        p = Packer(task << 32, length, windows, least, with_ids)
        for b in small(batches):
            kind = b.schema.field(0).type
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                ids = enc.encode_once(text.as_py()) + END
                p.add(doc, 0, ids, len(ids) // 4)
            yield batch(p.rows, task, kind)
            p.rows = []
        if kind is not None:
            yield batch(p.leftovers(), task, kind)

    def merge(level: int, last: bool):
        def step(key, table):
            group = key[0].as_py()
            p = Packer(level << 56 | group << 32, length, windows, least, with_ids)
            rows = [table.column(n).to_pylist() for n in ("doc", "start", "ids", "doc_tokens")]
            # longest first; equal lengths in an order that does not depend on arrival
            for doc, start, ids, total in sorted(zip(*rows), key=lambda r: (-len(r[2]), str(r[0]), r[1], r[2])):
                p.add(doc, start, ids, total)
            if last:
                p.close()
            return pa.Table.from_batches([batch(p.rows + p.leftovers(), group, table.schema.field("doc").type)])
        return step

    got = s.keep(d.mapInArrow(first, schema), "level-0")
    out, level = got.where("sequence_id is not null"), 0
    tasks = (got.agg(F.max("task")).head()[0] or 0) + 1
    while True:
        level, tasks = level + 1, -(-tasks // fan_in)
        rest = got.where("sequence_id is null").withColumn("task", F.floor(F.col("task") / fan_in))
        got = s.keep(rest.groupBy("task").applyInArrow(merge(level, tasks == 1), schema), f"level-{level}")
        out = out.union(got.where("sequence_id is not null"))
        if tasks == 1:
            return out.drop("task")


@register("op7_packing")
def op7_packing(spark, sf_dir):
    """One row per piece of a document."""
    return pack(read(spark, sf_dir, "documents"), with_ids=False).select(
        F.col("doc").alias("doc_id"), "start", "length", F.col("crc").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
