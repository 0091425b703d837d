"""Collocations by dynamic itemset counting over cyclic shards of the corpus."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Filter, Scratch, filter_of, read
from .registry import register

SHARDS = 2              #: shards of a cycle; a phrase is counted in as many steps as these
SLICE = 2 << 20         #: bytes of one language that a task turns into arrays at once (a longer text is a slice of its own)
HELD = 8 << 20          #: bytes of all languages that wait in a task
RAW = 1 << 20           #: occurrences that a task holds before it combines them
FLUSH = 1 << 20         #: combined hashes that a task holds before it passes them on
ROWS_OUT = 1 << 16      #: rows of a batch that a task passes on
HELD_PHRASES = 1 << 17  #: that a task of the last scan holds before it passes them on
_ODD = np.uint64(0x9E3779B97F4A7C15)
_PIECES = bytes.maketrans(b",;:!?\n\x0b\x0c\r", b"." * 9)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Slice:
    """Words of one language, in order. ``ids`` number the distinct words
    (``words``, an Arrow array); -1 stands between pieces, and between texts."""

    def __init__(self, lang: str, texts: list[bytes]):
        text = b" . ".join(texts).translate(_PIECES).replace(b".", b" . ").lower()  # of bytes: ASCII alone
        one = pa.StringArray.from_buffers(1, pa.py_buffer(np.array([0, len(text)], np.int32)), pa.py_buffer(text))
        words = pc.ascii_split_whitespace(one).flatten().dictionary_encode()
        self.lang, self.words = lang, words.dictionary
        gap = pc.is_in(self.words, pa.array([".", ""])).to_numpy(zero_copy_only=False)
        ids = words.indices.to_numpy().astype(np.int64)
        self.ids = np.where(gap[ids], -1, ids) if len(ids) else ids
        seed = np.uint64(xxhash.xxh64_intdigest(lang.encode("utf-8", "replace"), 1))
        self.hash = _mix(np.fromiter(map(xxhash.xxh64_intdigest, self.words.to_numpy(zero_copy_only=False)), np.uint64, len(self.words)) ^ seed)

    def phrases(self, max_words: int, grows):
        """Yields ``(n, at, h, left, right)`` for n = 1, 2, ...: the places where
        a phrase of n words starts whose first and last n - 1 words both pass
        ``grows(n - 1, hashes)``, its hash (the low three bits are n) and theirs."""
        at = np.flatnonzero(self.ids >= 0)
        word = (_mix(self.hash) << np.uint64(3)) | np.uint64(1)     # of each distinct word
        h = word[self.ids[at]]
        yield 1, at, h, None, None
        go = grows(1, word)[self.ids[at]]
        for n in range(2, max_words + 1):
            if n > 2:
                go = grows(n - 1, h)
            at, h = at[go], h[go]
            raw = self.hash[self.ids[at]] if n == 2 else raw[go]
            both = np.flatnonzero(at[1:] == at[:-1] + 1)  # a piece's end leaves a gap
            left, right = h[both], h[both + 1]
            at, raw = at[both], raw[both] * _ODD + self.hash[self.ids[at[both] + n - 1]]
            h = (_mix(raw + np.uint64(n)) << np.uint64(3)) | np.uint64(n)
            yield n, at, h, left, right


def slices(batches):
    """``Slice`` objects of batches (lang, text), of bounded size unless one text is larger."""
    held: dict[str, list[bytes]] = {}
    size: dict[str, int] = {}
    for b in batches:
        for lang, text in zip(b.column(0), b.column(1)):
            k, t = lang.as_py(), text.as_py().encode("utf-8", "replace")
            held.setdefault(k, []).append(t)
            size[k] = size.get(k, 0) + len(t)
            if size[k] > SLICE:
                del size[k]
                yield Slice(k, held.pop(k))
            elif sum(size.values()) > HELD:
                yield from (Slice(k, held[k]) for k in held)
                held, size = {}, {}
    yield from (Slice(k, held[k]) for k in held)


class Active:
    """Which phrases a step counts, by filters of the phrases that have reached
    the threshold (``reached``) and of those that did so within the last cycle
    (``late``; None while that is the same). A phrase is counted when both
    subphrases have reached it, for one full cycle: that is as long as one of
    them is late. A phrase let through by a filter's error does no harm: each
    shard's count is taken once (``merged``)."""

    def __init__(self, reached: dict[int, Filter], late: dict[int, Filter] | None, words: bool):
        self.reached, self.late, self.words = reached, late, words

    def grows(self, n: int, h: np.ndarray) -> np.ndarray:
        return self.reached[n](h)

    def counted(self, n: int, h: np.ndarray, left: np.ndarray | None, right: np.ndarray | None) -> np.ndarray:
        if n == 1:
            return h if self.words else h[:0]
        return h if self.late is None else h[self.late[n - 1](left) | self.late[n - 1](right)]


class Tally:
    """Occurrences by hash. New ones wait until there are ``RAW``, distinct
    hashes with their counts until there are ``FLUSH``; what many occurrences
    share is thus combined without ever holding them all."""

    def __init__(self):
        self.raw: list[np.ndarray] = []
        self.h, self.n = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def add(self, h: np.ndarray) -> None:
        self.raw.append(h)
        if sum(map(len, self.raw)) > RAW:
            self.combine()

    def combine(self) -> None:
        h, n = np.unique(np.concatenate([*self.raw, self.h[:0]]), return_counts=True)
        self.raw.clear()
        h, n = np.concatenate([self.h, h]), np.concatenate([self.n, n])
        order = np.argsort(h, kind="stable")    # two sorted runs
        h, n = h[order], n[order]
        at = np.flatnonzero(np.diff(h, prepend=~h[:1]))
        self.h, self.n = h[at], np.add.reduceat(n, at) if len(at) else n

    def batches(self):
        """What is combined, in small batches; nothing is held afterwards."""
        out = pa.record_batch([pa.array(self.h.view(np.int64)), pa.array(self.n)], ["h", "n_found"])
        self.h, self.n = self.h[:0].copy(), self.n[:0].copy()
        for i in range(0, out.num_rows, ROWS_OUT):
            yield out.slice(i, ROWS_OUT)


def count_step(shard: DataFrame, max_words: int, active: Active) -> DataFrame:
    """``(h, n_found)``: occurrences of the active phrases of one shard, combined within each task."""
    shared = shard.sparkSession.sparkContext.broadcast(active)

    def run(batches):
        a, tally = shared.value, Tally()
        for x in slices(batches):
            for n, _, h, left, right in x.phrases(max_words, a.grows):
                tally.add(a.counted(n, h, left, right))
            if len(tally.h) > FLUSH:
                yield from tally.batches()
        tally.combine()
        yield from tally.batches()

    return shard.select("lang", "text").mapInArrow(run, "h bigint, n_found bigint")


def merged(state: DataFrame | None, found: DataFrame, step: int, shards: int, threshold: int) -> DataFrame:
    """The counters after a step: ``h``, ``total``, ``mask`` (shards it has),
    ``seen`` (last step that found it) and ``reached`` (step after which the
    total was at the threshold). A shard that a counter already has is not added
    again. A counter below the threshold goes when a full cycle ends with
    nothing new: then its own cycle is over, or has so far seen none of the
    shards that have the phrase. Words have their cycle from step 0 on."""
    bit, none = F.lit(1 << (step % shards)), lambda c: F.lit(None).cast("bigint").alias(c)
    new = found.select("h", none("total"), none("past"), "n_found")
    if state is not None:   # one number instead of three: narrower rows, and a hash aggregate
        past = F.col("mask").cast("bigint") + F.shiftleft(F.col("seen").cast("bigint"), 20) + F.shiftleft(F.coalesce(F.col("reached") + 1, F.lit(0)).cast("bigint"), 40)
        new = new.unionAll(state.select("h", "total", past.alias("past"), none("n_found")))
    g = new.groupBy("h").agg(F.sum("total").alias("total"), F.max("past").alias("past"), F.sum("n_found").alias("n_found"))
    bits = lambda shift: F.shiftright("past", shift).bitwiseAND(F.lit((1 << 20) - 1)).cast("int")
    found, mask, reached = F.coalesce("n_found", F.lit(0)), F.coalesce(bits(0), F.lit(0)), bits(40)
    total = F.coalesce("total", F.lit(0)) + F.when(mask.bitwiseAND(bit) == 0, found).otherwise(0)
    g = g.select("h", total.alias("total"), F.when(found > 0, mask.bitwiseOR(bit)).otherwise(mask).alias("mask"),
                 F.when(found > 0, step).otherwise(bits(20)).alias("seen"),
                 F.when(reached > 0, reached - 1).when(total >= threshold, step).alias("reached"))
    since = F.when(F.col("h").bitwiseAND(F.lit(7)) == 1, 0).otherwise(F.col("seen"))
    return g.where(F.col("reached").isNotNull() | (since + shards - 1 > step)).withColumn("done", F.col("reached").isNotNull())


def frequent(docs: DataFrame, max_words: int, threshold: int, scratch: Scratch, shards: int = SHARDS) -> DataFrame:
    """``docs(lang, text)``, without nulls -> ``(lang, n_words, phrase, f)`` for
    every phrase of up to ``max_words`` words with ``f >= threshold``, and one row
    of ``n_words`` 0 per language with its number of words.

    Dynamic itemset counting: the corpus is dealt over ``shards`` that are
    scanned in turn, cyclically. Words are counted from the start; a longer
    phrase from the step on at which both its subphrases have reached the
    threshold, until it has seen every shard once. Lengths thus interleave, and
    it ends when no phrase is still in its cycle. Counters have 64-bit hashes;
    a last scan counts the words and phrases themselves, of those hashes only.
    """
    number = F.pmod(F.monotonically_increasing_id(), F.lit(shards)).alias("shard")
    table = scratch.keep(docs.select("lang", "text", number), "shards", "shard")
    state, step, none = None, 0, {n: Filter(64, np.zeros(1, np.uint64)) for n in range(1, max_words + 1)}
    reached, late = dict(none), None
    while True:
        found = count_step(table.where(F.col("shard") == step % shards), max_words, Active(reached, late, step < shards))
        state = scratch.keep(merged(state, found, step, shards, threshold), f"state-{step}", "done")
        if step:
            scratch.drop(f"state-{step - 1}")
        step += 1
        n_of = F.col("h").bitwiseAND(F.lit(7))
        done = state.where("done")
        in_cycle = F.col("reached") >= step - shards
        sizes = {r.n: (r.all, r.late) for r in done.groupBy(n_of.alias("n")).agg(F.count(F.lit(1)).alias("all"), F.count_if(in_cycle).alias("late")).collect()}
        if step >= shards and not any(late for n, (_, late) in sizes.items() if n < max_words):
            break
        reached = none | {n: filter_of(done.where(n_of == n), sizes[n][0]) for n in sizes if n < max_words}
        late = None if step <= shards else none | {n: filter_of(done.where((n_of == n) & in_cycle), sizes[n][1]) for n in sizes if n < max_words}
    final = none | {n: filter_of(done.where(n_of == n), sizes[n][0]) for n in sizes}
    shared = docs.sparkSession.sparkContext.broadcast(final)

    def run(batches):
        held: list[pa.RecordBatch] = []

        def counted(x: Slice):
            of = lambda n, phrase, f: pa.record_batch([
                pa.repeat(pa.scalar(x.lang, pa.string()), len(f)), pa.repeat(pa.scalar(n, pa.int32()), len(f)), phrase, pa.array(f, pa.int64())], ["lang", "n_words", "phrase", "f"])
            names, code = x.words, x.ids.copy()     # the phrase that starts at a place, by its number in names
            yield of(0, pa.array([""]), np.array([(x.ids >= 0).sum()]))
            for n, at, h, _, _ in x.phrases(max_words, lambda n, h: shared.value[n](h)):  # subphrases of a frequent phrase are frequent
                at = at[shared.value[n](h)]
                if n > 1:
                    kinds, inverse = np.unique((code[at] << 32) | x.ids[at + n - 1], return_inverse=True)
                    names = pc.binary_join_element_wise(names.take(pa.array(kinds >> 32)), x.words.take(pa.array(kinds & 0xFFFFFFFF)), " ")
                    code[at] = inverse
                count = np.bincount(code[at], minlength=len(names))
                k = np.flatnonzero(count)
                yield of(n, names.take(pa.array(k)), count[k])

        def passed():
            t = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            return t.to_batches(max_chunksize=ROWS_OUT)

        for x in slices(batches):
            held += counted(x)
            if sum(b.num_rows for b in held) > HELD_PHRASES:
                yield from passed()
        if held:
            yield from passed()

    counts = table.select("lang", "text").mapInArrow(run, "lang string, n_words int, phrase string, f bigint")
    counts = counts.groupBy("lang", "n_words", "phrase").agg(F.sum("f").alias("f")).where((F.col("n_words") == 0) | (F.col("f") >= threshold))
    counts = scratch.keep(counts, "counts")
    scratch.drop("shards", f"state-{step - 1}")
    return counts


def _part(words: Column, a, n) -> Column:
    return F.array_join(F.slice(words, a, n), " ")


def collocations(docs: DataFrame, max_words: int = 3, threshold: int = 10, top: int | None = 2000, inside_percent: int = 50,
                 text_col: str = "text", lang_col: str = "lang", scratch: Scratch | None = None) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score`` of the phrases of 2 to
    ``max_words`` (7 at most) words that occur ``threshold`` times or more in
    their language, the best ``top`` of each language (None: all).

    Texts are lower-cased (A-Z) and cut into pieces at ``[.,;:!?\\x0A-\\x0D]``,
    pieces into words ``[^\\x20\\x09]+``; phrases lie within a piece, their
    occurrences may overlap. A phrase, cut after its first k words, has
    ``score = floor(1000000 a a / (l r))`` of the counts of whole and parts; the
    cut with the lowest score counts (ties: the smallest k). Phrases contained
    in a longer one with at least ``inside_percent`` of their count are dropped.
    The order is score, count (both falling), phrase (as UTF-8). Products are
    decimals of 38 digits: exact up to 10**16 occurrences.

    A null language is ``und``. Null, empty and wordless texts hold no phrase,
    repeated rows count each time, a very long text is a larger array. Ties are
    ordered by the phrase, so ranks are unique. An empty table gives no row;
    other columns, whatever their names, are not looked at.
    """
    s = scratch or Scratch(docs.sparkSession)
    d = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.col(text_col).alias("text")).where("text <> ''")
    counts = frequent(d, max_words, threshold, s)
    words = F.split("phrase", " ")
    phrases = counts.where("n_words > 1").select("lang", "n_words", "phrase", F.col("f").alias("a"), words.alias("w"))
    k = F.explode(F.sequence(F.lit(1), F.col("n_words") - 1)).alias("k")
    cuts = phrases.select("lang", "phrase", "a", "n_words", "w", k)
    side = lambda start, n, name: F.struct(F.lit(name).alias("side"), _part(F.col("w"), start, n).alias("part"))
    parts = cuts.select("lang", "phrase", "a", "k", F.inline(F.array(side(F.lit(1), F.col("k"), "l"), side(F.col("k") + 1, F.col("n_words") - F.col("k"), "r"))))
    found = parts.join(counts.where("n_words > 0").select("lang", F.col("phrase").alias("part"), "f"), ["lang", "part"])
    at = lambda c: F.max(F.when(F.col("side") == c, F.col("f"))).alias(c)
    scored = found.groupBy("lang", "phrase", "a", "k").agg(at("l"), at("r"))
    scored = scored.withColumn("score", F.expr("(1000000 * cast(a as decimal(19,0)) * cast(a as decimal(19,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))"))
    best = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("c"))
    inner = F.transform(F.sequence(F.lit(2), F.col("n_words") - 1), lambda m: F.transform(
        F.sequence(F.lit(1), F.col("n_words") - m + 1), lambda i: _part(F.col("w"), i, m)))
    covered = (phrases.where("n_words > 2").select("lang", F.explode(F.flatten(inner)).alias("phrase"), "a")
               .groupBy("lang", "phrase").agg(F.max("a").alias("longer")))
    best = best.join(covered, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < inside_percent * F.col("a")))
    out = best.select("lang", "phrase", "a", "c.l", "c.r", "c.score").withColumn(
        "rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")).cast("bigint"))
    out = out if top is None else out.where(F.col("rank") <= top)
    return (out.join(counts.where("n_words = 0").select("lang", F.col("f").alias("n")), "lang")
            .select("lang", "rank", "phrase", "a", "l", "r", "n", "score"))


SQL = """
with pieces as (select coalesce(lang, 'und') lang, unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[.,;:!?\\x0A-\\x0D]')) piece from documents),
w as (select lang, regexp_extract_all(piece, '[^\\x20\\x09]+') w from pieces),
grams as (select lang, unnest(w) phrase, 1 n_words from w
          union all select lang, unnest([array_to_string(w[i:i+1], ' ') for i in range(1, len(w))]), 2 from w where len(w) > 1
          union all select lang, unnest([array_to_string(w[i:i+2], ' ') for i in range(1, len(w) - 1)]), 3 from w where len(w) > 2),
f as (select lang, phrase, n_words, count(*) f from grams group by all),
n as (select lang, sum(f)::bigint n from f where n_words = 1 group by all),
c as (select *, string_split(phrase, ' ') p from f where n_words > 1 and f >= 10),
cuts as (select c.lang, c.phrase, c.n_words, c.f a, k, array_to_string(p[1:k], ' ') lp, array_to_string(p[k+1:], ' ') rp
         from c, (values (1), (2)) t(k) where k < c.n_words),
scored as (select cuts.*, x.f l, y.f r, (1000000::hugeint * a * a) // (x.f::hugeint * y.f) score
           from cuts join f x on x.lang = cuts.lang and x.phrase = lp join f y on y.lang = cuts.lang and y.phrase = rp),
best as (select * from scored qualify row_number() over (partition by lang, phrase order by score, k) = 1),
longer as (select lang, unnest([array_to_string(p[1:2], ' '), array_to_string(p[2:3], ' ')]) phrase, f from c where n_words = 3),
hidden as (select lang, phrase, max(f) f from longer group by all),
kept as (select best.* from best left join hidden h using (lang, phrase) where h.f is null or 100 * h.f < 50 * a),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) rank from kept)
select lang, rank, phrase, a, l, r, n, score::bigint score from ranked join n using (lang) where rank <= 2000
"""


@register("op13_phrase_mining", SQL)
def op13_phrase_mining(spark, sf_dir):
    """The first 2000 collocations of every language of ``documents``."""
    return collocations(read(spark, sf_dir, "documents"))
