"""Cheapest repair of damaged conversations, by an automaton of shared suffixes."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, read
from .registry import register

CHUNK = 128             #: rows of a conversation whose signature is one word of the automaton, counted from its end
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5     # fixed values: costs of the edits
ROLES = {"u": "user", "a": "assistant"}
#: Grammar of role initials (s?(ua)+)?: state -> initial -> next state. Start 0, after s 1, after u 2, after a 3.
STEP = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
#: What the end of a conversation still costs: nothing at the start or after a, else the rows that are missing.
END = ((0, ""), (2 * INSERT, "II"), (INSERT, "I"), (0, ""))


def symbol_edits(symbol: str, state: int):
    """(cost, initial of the edit, next state) of the edits of one row before
    which nothing is inserted. A symbol is a role initial (s, u, a; ? for any
    other), in capitals if the row is truncated; - if it has to go."""
    yield DELETE, "D", state
    if symbol != "-":
        more = TRUNCATED if symbol.isupper() or symbol == "!" else 0
        nxt = STEP[state].get(symbol.lower())
        if nxt is not None:
            yield KEEP + more, "K", nxt
        for initial in ROLES:
            if initial in STEP[state]:
                yield REROLE + more, "R", STEP[state][initial]


def inserted(state: int):
    """(cost, audit, state) after none, one, two or three inserted rows: the cycle of states is no longer."""
    yield 0, "", state
    for i in range(1, 4):
        state = STEP[state]["u" if "u" in STEP[state] else "a"]
        yield i * INSERT, "I" * i, state


class SuffixAutomaton:
    """Words with a common suffix share its nodes (one node per distinct suffix).
    Each node has, per grammar state before it and per state after the word's
    end, the cost to go and the least audit of that cost, computed once."""

    def __init__(self):
        self.next: dict[tuple[str, int], int] = {}
        nothing = [[None] * 4 for _ in range(4)]
        for s in range(4):
            nothing[s][s] = (0, "")
        self.table = [nothing]

    def node(self, word: str) -> int:
        at = 0
        for symbol in reversed(word):
            n = self.next.get((symbol, at))
            if n is None:
                n = self.next[symbol, at] = len(self.table)
                self.table.append(self._best(symbol, self.table[at]))
            at = n
        return at

    def _best(self, symbol: str, rest):
        direct = [[None] * 4 for _ in range(4)]
        for s in range(4):
            for cost, edit, t in symbol_edits(symbol, s):
                for out, tail in enumerate(rest[t]):
                    if tail is not None:
                        direct[s][out] = least(direct[s][out], (cost + tail[0], edit + tail[1]))
        best = [[None] * 4 for _ in range(4)]
        for s in range(4):
            for cost, audit, t in inserted(s):
                for out, tail in enumerate(direct[t]):
                    if tail is not None:
                        best[s][out] = least(best[s][out], (cost + tail[0], audit + tail[1]))
        return best


def least(a, b):
    """The cheaper, then the one that is first in ASCII. Two audits of one cost
    over the same rows never are a prefix of each other (an insert costs), so
    the choice stays right whatever follows."""
    return b if a is None or b < a else a


def to_end(table, after):
    """Cost and audit from each state: a chunk's table, then what follows it."""
    out = []
    for row in table:
        best = None
        for t, x in enumerate(row):
            if x is not None:
                best = least(best, (x[0] + after[t][0], x[1] + after[t][1]))
        out.append(best)
    return out


def exits(table, after, state: int) -> int:
    """The state in which the best way from ``state`` leaves the chunk."""
    return min((x[0] + after[t][0], x[1] + after[t][1], t) for t, x in enumerate(table[state]) if x is not None)[2]


CELL = "array<struct<cost:bigint,audit:string>>"


def damaged(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` damaged by ``crc32(conv_id:turn) % 20``: 0
    drops the row, 1 empties the text, 2 removes its ``[.!?]``, 3 repeats it, 4
    makes it the user's. Nulls (also in the key) are one space."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    r = rows.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"),
                    (F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20).alias("damage"))
    text = F.when(F.col("damage") == 1, "").when(F.col("damage") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("damage") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("damage") == 0, 0).when(F.col("damage") == 3, 2).otherwise(1)
    return (r.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.array_repeat(F.lit(0), times).alias("again"))
            .select("conv_id", "turn", "role", "text", F.explode("again").alias("again")).drop("again"))


def symbols(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows in order, with their signature: ``key`` (of the conversation), ``pos``
    (rising along it), ``fault``, ``initial``, ``symbol``, ``before`` (initial of the row before)
    and ``chunk`` (from the end). One range partitioning sorts all rows by
    conversation and place, so a long conversation lies in several tasks; what
    they have to know of each other is one number per task and conversation."""
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    cut = ~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    key = F.when(F.col("conv_id").isNull(), F.lit("n")).otherwise(F.concat(F.lit("c"), F.col("conv_id").cast("string")))
    digest = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    d = rows.select("conv_id", "turn", "role", "text", key.alias("key"), digest.alias("same"),
                    F.when(blank, "blank").when(cut, "truncated").alias("fault"), F.monotonically_increasing_id().alias("row"))
    order = [F.col("key"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"), F.col("row")]
    d = d.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("pos", F.monotonically_increasing_id())
    d = scratch.keep(d.drop("row"), "ordered")
    narrow = d.select("key", "pos", "same", "fault", F.substring("role", 1, 1).alias("initial"), F.shiftright("pos", 33).alias("part"))
    again = narrow.groupBy("key", "same").agg(F.min("pos").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    narrow = narrow.join(again, ["key", "same"], "left")
    seen = F.coalesce(F.col("pos") > F.col("first"), F.lit(False))
    fault = F.when(F.col("fault") == "blank", "blank").when(seen, "duplicate").otherwise(F.col("fault"))
    narrow = narrow.select("key", "pos", "part", "initial", fault.alias("fault"))
    known = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("?")
    symbol = (F.when(F.col("fault").isin("blank", "duplicate"), "-")
              .when(F.col("fault") == "truncated", F.when(known == "?", "!").otherwise(F.upper(known))).otherwise(known))
    here = Window.partitionBy("key", "part")
    narrow = narrow.select("*", symbol.alias("symbol"), F.row_number().over(here.orderBy(F.desc("pos"))).alias("back"),
                           F.lag("initial").over(here.orderBy("pos")).alias("before"))
    narrow = scratch.keep(narrow, "symbols")
    parts = narrow.groupBy("key", "part").agg(F.count(F.lit(1)).alias("n"), F.max_by("initial", "pos").alias("last"))
    along = Window.partitionBy("key").orderBy("part")
    parts = parts.select("key", "part", F.coalesce(F.sum("n").over(along.rowsBetween(1, Window.unboundedFollowing)), F.lit(0)).alias("later"),
                         F.lag("last").over(along).alias("last"))
    parts = parts.where("later > 0 or last is not null")    # conversations that lie in several tasks
    narrow = narrow.join(parts, ["key", "part"], "left")
    chunk = F.floor((F.col("back") - 1 + F.coalesce("later", F.lit(0))) / CHUNK).cast("bigint")
    return d, scratch.keep(narrow.select("key", "pos", "initial", "fault", "symbol", F.coalesce("before", "last").alias("before"),
                                         chunk.alias("chunk")), "signed")


def solved(words: DataFrame) -> DataFrame:
    """``word`` -> ``cells``: its 16 (cost, audit) cells by state before and
    after. The distinct words are sorted from their ends, so the words of a task
    share their suffixes; each task has the automaton of its own words, and a
    suffix is in two tasks only where a boundary divides its words."""
    def run(batches):
        automaton = SuffixAutomaton()
        for b in batches:
            cells = []
            for word in b.column(0).to_pylist():
                table = automaton.table[automaton.node(word)]
                cells.append([None if x is None else {"cost": x[0], "audit": x[1]} for row in table for x in row])
                if len(automaton.table) > 1 << 16:      # bounded: sorted words need few of the earlier nodes
                    automaton = SuffixAutomaton()
            yield pa.record_batch([b.column(0), pa.array(cells, pa.list_(pa.struct([("cost", pa.int64()), ("audit", pa.string())])))], ["word", "cells"])

    back = F.reverse("word")
    words = words.select("word").distinct().repartitionByRange(back).sortWithinPartitions(back)
    return words.mapInArrow(run, f"word string, cells {CELL}")


def _tables(cells) -> list:
    return [[None if c is None else (c["cost"], c["audit"]) for c in cells[4 * s:4 * s + 4]] for s in range(4)]


def _ways(chunks: DataFrame) -> DataFrame:
    """``chunks(key, chunk, cells)`` -> ``key, chunk, state, audit, cost``: per
    chunk the grammar state before it and its part of the best audit; the cost
    is the whole conversation's, in its first chunk's row. Chunks are folded
    from the last one on, then followed from the first; a conversation's audit
    is one value of its result, so its chunks (one row per 128 rows) meet here."""
    def fold(t):
        # pa.Table of one conversation
        t = t.sort_by([("chunk", "ascending")])
        tables = [_tables(c) for c in t.column("cells").to_pylist()]
        after = [list(END)]
        for x in tables:
            after.append(to_end(x, after[-1]))
        state, out = 0, []
        for i in range(len(tables) - 1, -1, -1):
            leave = exits(tables[i], after[i], state)
            out.append((i, state, tables[i][state][leave][1], after[-1][0][0] if i == len(tables) - 1 else None))
            state = leave
        out[-1] = (*out[-1][:2], out[-1][2] + END[state][1], out[-1][3])
        cols = list(zip(*out))
        return pa.table([pa.array([t.column("key")[0].as_py()] * len(out), pa.string()), *map(pa.array, cols, (pa.int64(), pa.int32(), pa.string(), pa.int64()))],
                        names=["key", "chunk", "state", "audit", "cost"])

    return chunks.groupBy("key").applyInArrow(fold, "key string, chunk bigint, state int, audit string, cost bigint")


def _short(chunks: DataFrame) -> DataFrame:
    """``_ways`` of conversations of one chunk, without a group: the row has all."""
    def run(batches):
        for b in batches:
            out = []
            for cells in b.column(1).to_pylist():
                table = _tables(cells)
                out.append((to_end(table, END)[0]))
            cols = list(zip(*out)) or [[], []]
            n = b.num_rows
            yield pa.record_batch([b.column(0), pa.array([0] * n, pa.int64()), pa.array([0] * n, pa.int32()), pa.array(cols[1], pa.string()), pa.array(cols[0], pa.int64())],
                                  ["key", "chunk", "state", "audit", "cost"])

    return chunks.select("key", "cells").mapInArrow(run, "key string, chunk bigint, state int, audit string, cost bigint")


def edits_of(audit: str, state: int, initials: list[str]):
    """What an audit does to rows of these initials, entered in ``state``: per
    row (edit, new role or None, roles inserted before it), and the roles
    inserted after the last."""
    rows, before, i = [], [], 0
    for edit in audit:
        role = "u" if "u" in STEP[state] else "a"
        if edit == "I":
            before.append(ROLES[role])
            state = STEP[state][role]
            continue
        rows.append((edit, ROLES[role] if edit == "R" else None, before))
        if edit != "D":
            state = STEP[state][role if edit == "R" else initials[i]]
        before, i = [], i + 1
    return rows, before


def repair(rows: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256`` of every conversation of ``rows(conv_id, turn, role,
    text)``, taken as they are (``damaged`` makes test cases of sound ones).

    Rows go by turn (nulls first), then role and text, so repeats are adjacent.
    A row's first fault counts: blank, duplicate (role and text of an earlier
    row) or truncated (the last character that is no white space is none of
    ``[.!?]``). Keeping costs 0, a new role (user or assistant) 1, deleting 2
    (blank and duplicate rows have to go), inserting an empty row of either role
    5; a truncated row that stays adds 5. ``audit`` has the initials of the
    cheapest edits in order that give role initials ``(s?(ua)+)?``, of several
    the first in ASCII; it also fixes the repaired rows.

    The signature of a conversation is cut, from its end, into words of 128
    rows. Distinct words are solved once, in an automaton of their shared
    suffixes; a word's table (cost and audit by grammar state before and after)
    composes with the next one's. A conversation of any length is so spread over
    tasks, but for three things that are one value by definition: its audit (a
    letter per row), its text's SHA-256, which is fed row by row without being
    held, and the sums.

    A null conversation id is a conversation of its own; null role or text: one
    space. A role of which the first letter is none of s, u, a (also an empty
    one) can't be kept. Repeated rows are duplicates. Long texts are hashed
    whole. An empty table gives no row; other columns are not looked at.
    """
    s = scratch or Scratch(rows.sparkSession)
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    ordered, signed = symbols(rows.select("conv_id", F.col("turn").cast("bigint").alias("turn"), space("role"), space("text")), s)
    pair = F.concat("before", "initial")
    legal = pair.isin("su", "ua", "au") & (F.length("before") > 0) & (F.length("initial") > 0)
    counts = signed.groupBy("key").agg(*[F.count_if(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")],
                                       F.count_if(F.col("before").isNotNull() & ~legal).alias("illegal"))
    turns = (ordered.groupBy("key").agg(F.first("conv_id").alias("conv_id"), F.max("turn").alias("hi"), F.min("turn").alias("lo"))
             .join(ordered.where("turn is not null").select("key", "turn").distinct().groupBy("key").agg(F.count(F.lit(1)).alias("n")), "key", "left")
             .select("key", "conv_id", F.coalesce(F.col("hi") - F.col("lo") + 1 - F.col("n"), F.lit(0)).alias("gaps")))
    word = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "symbol"))), lambda x: x["symbol"]), "")
    words = s.keep(signed.groupBy("key", "chunk").agg(word.alias("word"), F.min("pos").alias("pos")), "words")
    chunks = s.keep(words.join(solved(words), "word"), "chunks")
    long = words.where("chunk > 0").select("key").distinct()
    ways = s.keep(_short(chunks.join(long, "key", "left_anti")).unionByName(_ways(chunks.join(long, "key", "left_semi").select("key", "chunk", "cells"))), "ways")
    whole = ways.groupBy("key").agg(F.max("cost").alias("cost"), F.array_join(F.transform(F.sort_array(
        F.collect_list(F.struct((-F.col("chunk")).alias("o"), "audit"))), lambda x: x["audit"]), "").alias("audit"))

    # each row's edit, from its chunk's part of the audit
    todo = (signed.groupBy("key", "chunk").agg(F.array_sort(F.collect_list(F.struct("pos", "initial"))).alias("rows"))
            .join(ways.select("key", "chunk", "state", "audit"), ["key", "chunk"]))

    def apply(batches):
        for b in batches:
            out = []
            for rows_, state, audit, last in zip(*map(pa.Array.to_pylist, b.columns)):
                edits, end = edits_of(audit, state, [r["initial"] for r in rows_])
                for i, (r, (edit, role, before)) in enumerate(zip(rows_, edits)):
                    out.append((r["pos"], edit, role, before, end if last and i == len(edits) - 1 else []))
            cols = list(zip(*out)) or [[]] * 5
            kinds = (pa.int64(), pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string()))
            yield pa.record_batch(list(map(pa.array, cols, kinds)), ["pos", "edit", "new_role", "before", "after"])

    edits = todo.select("rows", "state", "audit", (F.col("chunk") == 0).alias("last")).mapInArrow(
        apply, "pos bigint, edit string, new_role string, before array<string>, after array<string>")
    empty = lambda c: F.transform(c, lambda r: F.concat(r, F.lit(":")))
    own = F.when(F.col("edit") == "D", F.array().cast("array<string>")).otherwise(F.array(F.concat(F.coalesce("new_role", "role"), F.lit(":"), "text")))
    lines = ordered.join(edits, "pos").select("key", "pos", F.concat(empty("before"), own, empty("after")).alias("lines"))
    lines = lines.repartition("key").sortWithinPartitions("key", "pos")

    def digest(batches):
        """Rows come sorted, so each conversation's hash is fed row by row."""
        key, h, first = None, hashlib.sha256(), True
        for b in batches:
            done = []
            for k, some in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if k != key:
                    if key is not None:
                        done.append((key, h.hexdigest()))
                    key, h, first = k, hashlib.sha256(), True
                for line in some:
                    h.update(("" if first else "\n").encode() + line.encode("utf-8", "replace"))
                    first = False
            cols = list(zip(*done)) or [[], []]
            yield pa.record_batch([pa.array(c, pa.string()) for c in cols], ["key", "repaired_sha256"])
        if key is not None:
            yield pa.record_batch([pa.array([key]), pa.array([h.hexdigest()])], ["key", "repaired_sha256"])

    sha = lines.select("key", "lines").mapInArrow(digest, "key string, repaired_sha256 string")
    return (turns.join(counts, "key").join(whole, "key").join(sha, "key")
            .select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"))


@register("op12_turn_repair")
def op12_turn_repair(spark, sf_dir):
    """Every conversation, damaged by a hash of id and turn, and its cheapest
    repair. One without a row after the damage has zeros and an empty text."""
    rows = read(spark, sf_dir, "conversations")
    fixed = repair(damaged(rows)).withColumnRenamed("conv_id", "fixed_id")
    every = rows.select("conv_id").distinct()
    out = every.join(fixed, every["conv_id"].eqNullSafe(fixed["fixed_id"]), "left")
    zero = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))
