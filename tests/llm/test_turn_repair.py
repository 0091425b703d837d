"""Conversation repair against a search over all edits, and hand-made rows."""

import hashlib
import heapq
import itertools
import random
import re
import zlib

from conftest import SF_MID, SF_SMALL
from quizlens.llm import turn_repair as tr

SPACE = "\t\n\x0b\x0c\r "
SCHEMA = "conv_id long, turn long, role string, text string"
NAME = {"u": "user", "a": "assistant"}


def damage(rows):
    """(conv_id, turn, role, text) after the damage of the query."""
    for c, t, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if kind == 1:
            text = ""
        elif kind == 2:
            text = re.sub("[.!?]", "", text)
        elif kind == 4:
            role = "user"
        yield from [(c, t, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        body = text.strip(SPACE)
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, fault):
    """Dijkstra from the front, states (row, initials accepted so far as a state
    of the pattern); of one cost the least audit, so labels are (cost, audit)."""
    after = {"": "su", "s": "u", "u": "a", "a": "u"}
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, last, made = heapq.heappop(heap)
        if i == len(rows) and last in ("", "a"):
            return cost, audit, made
        if (i, last) in done:
            continue
        done.add((i, last))
        for x in after[last].replace("s", ""):
            heapq.heappush(heap, (cost + 5, audit + "I", i, x, (*made, NAME[x] + ":")))
        if i < len(rows):
            role, text = rows[i][2:]
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, last, made))
            if fault[i] not in ("blank", "duplicate"):
                more = 5 * (fault[i] == "truncated")
                if role[:1] and role[:1] in after[last]:
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, role[0], (*made, f"{role}:{text}")))
                for x in after[last].replace("s", ""):
                    heapq.heappush(heap, (cost + 1 + more, audit + "R", i + 1, x, (*made, f"{NAME[x]}:{text}")))


def every_edit(rows, fault):
    """Without any cleverness: all edits and up to two inserts at a place, of few rows."""
    gaps = ["", "u", "a", "uu", "ua", "au", "aa"]
    best = None
    ways = [["D"] + (["K", "Ru", "Ra"] if f not in ("blank", "duplicate") else []) for f in fault]
    for ins in itertools.product(gaps, repeat=len(rows) + 1):
        for way in itertools.product(*ways):
            initials, audit, cost = "", "", 0
            for i, g in enumerate(ins):
                initials, audit, cost = initials + g, audit + "I" * len(g), cost + 5 * len(g)
                if i < len(rows):
                    w = way[i]
                    audit, cost = audit + w[0], cost + {"D": 2, "K": 0, "R": 1}[w[0]] + 5 * (w != "D" and fault[i] == "truncated")
                    initials += "" if w == "D" else (rows[i][2][:1] or "-") if w == "K" else w[1]
            if re.fullmatch("(s?(ua)+)?", initials) and (best is None or (cost, audit) < best):
                best = cost, audit
    return best


def brute(rows):
    out = {}
    groups = {}
    for r in rows:
        groups.setdefault(r[0], []).append(r)
    for c, own in groups.items():
        own.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
        fault, turns = faults(own), [r[1] for r in own if r[1] is not None]
        pairs = [(a[2][:1], b[2][:1]) for a, b in zip(own, own[1:])]
        cost, audit, made = cheapest(own, fault)
        out[c] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *[fault.count(f) for f in ("blank", "duplicate", "truncated")],
                  sum(p not in (("s", "u"), ("u", "a"), ("a", "u")) for p in pairs), cost, audit, hashlib.sha256("\n".join(made).encode()).hexdigest())
    return out


def rows_of(df):
    return {r[0]: tuple(r)[1:] for r in df.collect()}


def test_automaton_against_every_edit():
    r = random.Random(1)
    for _ in range(60):
        rows = [(0, i, r.choice(["user", "assistant", "system", "tool", ""]), r.choice(["a.", "b.", "c", ""])) for i in range(r.randrange(0, 4))]
        fault = faults(rows)
        assert cheapest(rows, fault)[:2] == every_edit(rows, fault)
        word = "".join("-" if f in ("blank", "duplicate") else (("!" if x == "?" else x.upper()) if f else x)
                       for f, x in ((f, row[2][:1] if row[2][:1] in ("s", "u", "a") else "?") for f, row in zip(fault, rows)))
        a = tr.SuffixAutomaton()
        assert tr.to_end(a.table[a.node(word)], tr.END)[0] == cheapest(rows, fault)[:2]


def test_automaton_shares_suffixes():
    a = tr.SuffixAutomaton()
    a.node("suaua"), a.node("uaua"), a.node("aua")
    assert len(a.table) == 6 and a.node("ua") == a.node("ua")


def test_query_matches_brute_force(spark):
    for sf in (SF_SMALL, SF_MID):
        rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
        want = brute(damage(rows))
        empty = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
        assert rows_of(tr.op12_turn_repair(spark, sf)) == {c: want.get(c, empty) for c, *_ in rows}


def test_long_and_odd_conversations(spark, monkeypatch):
    """Conversations of many chunks and tasks; nulls, ties, repeats, odd roles, long texts, clashing names."""
    monkeypatch.setattr(tr, "CHUNK", 5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")    # small partitions stay apart
    r = random.Random(2)
    rows = [(c, r.choice([None, *range(40)]), r.choice(["user", "assistant", "system", "tool", "", None, "User"]),
             r.choice([None, "", " ", "One.", "two", "three?  ", "vier! ", f"{r.randrange(99)}.", "x" * 50000 + "."]))
            for c in [None, 1, 2, 2, 3, 3, 3, 3, 3, 3] for _ in range(30)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as pos", "2 as `a.b`", "'k' as key").repartition(7)
    plain = [(c, t, *(" " if x is None else x for x in (a, b))) for c, t, a, b in rows]
    assert rows_of(tr.repair(df)) == brute(plain)
    assert rows_of(tr.repair(tr.damaged(df))) == brute(damage(rows))
    assert tr.repair(df.limit(0)).count() == 0
    ordered, signed = tr.symbols(spark.createDataFrame([(c, t, a or " ", b or " ") for c, t, a, b in rows], SCHEMA), tr.Scratch(spark))
    assert signed.where("key = 'c3'").selectExpr("shiftright(pos, 33) as p").distinct().count() > 1    # one conversation, several tasks
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
