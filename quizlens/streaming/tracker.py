"""Per-question live state over a telemetry stream (ST1-ST5).

``groupBy(question_id).applyInPandasWithState`` keeps, per question:
episode number, whether the episode is live, tokens, the samples of the last
rate window, rate, last activity, stall flag, status and retry count. The
rows of a micro-batch are taken in (ts, event_id) order and handled as
arrays, by the rules of ``operators.telemetry.tracked``, so the rows equal the
batch twin. Stalls are reported twice over: a question's row (other than a
count) that comes later than the threshold after its last sample, and an
event-time timeout when none comes before the watermark passes that moment. Rows older than the
watermark are reported as ``late`` and not applied.

State is keyed and bounded by the samples of one rate window; a finished
question keeps no samples, and its state goes ``keep_s`` of event time after
its last row (a later row starts a new state).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.telemetry import ACTIVITY, FINISHED, MIN_DT_S, RATE_WINDOW_S, STALL_S, US, epoch_us

KEEP_S = 24 * 3600
OUTPUT_SCHEMA = ("event_id long, question_id long, kind string, episode long, tokens long, "
                 "rate double, us long, status string, retries long")
STATE_SCHEMA = ("episode long, live boolean, tokens long, rate double, sample_us array<long>, sample_tokens array<long>, "
                "active_us long, active_tokens long, last_us long, stalled boolean, status string, retries long, "
                "wait_id array<long>, wait_kind array<string>, wait_delta array<long>, wait_us array<long>")
_NEW = (0, True, 0, 0.0, [], [], None, 0, 0, False, "pending", 0, [], [], [], [])


def _latest(flag: np.ndarray) -> np.ndarray:
    """For every position, the last position up to it where ``flag`` holds (-1: none)."""
    return np.maximum.accumulate(np.where(flag, np.arange(len(flag)), -1)) if len(flag) else np.zeros(0, np.int64)


def advance(state: tuple, rows: dict, win_us: int, min_dt_s: float, stall_us: int) -> tuple[tuple, dict, list]:
    """The state after ``rows`` (arrays event_id, kind, delta, us; in order), the rows
    with their results, and the stalls (episode, tokens, rate, us, status,
    retries) that they reveal."""
    ep0, live0, tok0, rate0, su0, st0, act0, act_tok0, _, stalled0, status0, retries0 = state[:12]
    kind, us, n = rows["kind"], np.asarray(rows["us"], np.int64), len(rows["us"])
    reset, done, grows = kind == "reset", np.isin(kind, FINISHED), np.isin(kind, ACTIVITY)
    start = _latest(reset)                                  # where the row's episode starts here
    here = start >= 0
    episode = ep0 + np.cumsum(reset)
    ends = np.cumsum(done)
    ends_before = ends - done
    live = np.where(here, ends_before - ends[start], ends_before + (not live0)) == 0
    sums = np.cumsum(np.where(grows, np.asarray(rows["delta"], np.int64), 0))
    tokens = np.where(live & ~reset, np.where(here, sums - sums[start], tok0 + sums), 0)

    # samples, with those of the carried window in front; the frame of each starts where
    # its window or its episode does
    take = live & (kind == "update")
    s_us = np.concatenate([np.array(su0, np.int64), us[take]])
    s_tok = np.concatenate([np.array(st0, np.int64), tokens[take]])
    s_ep = np.concatenate([np.full(len(su0), ep0, np.int64), episode[take]])
    first = np.maximum(np.searchsorted(s_us, s_us - win_us), np.searchsorted(s_ep, s_ep)).astype(np.int64)
    span, grown = (s_us - s_us[first]) / float(US), s_tok - s_tok[first]
    known = (span > min_dt_s) & (grown > 0) & (np.arange(len(s_us)) >= len(su0))
    at = _latest(known)                                     # a sample without a rate of its own keeps the last one
    raw = np.where(known, grown / np.where(known, span, 1.0), 0.0)
    kept = (at >= 0) & (s_ep[at] == s_ep) if len(at) else np.zeros(0, bool)
    s_rate = np.where(kept, raw[at] if len(at) else 0.0, np.where(s_ep == ep0, rate0, 0.0))
    seen = len(su0) + np.cumsum(take) - 1                   # last sample up to the row
    mine = (seen >= 0) & (s_ep[np.maximum(seen, 0)] == episode) if len(s_ep) else np.zeros(n, bool)
    rate = np.where(mine, s_rate[np.maximum(seen, 0)] if len(s_rate) else 0.0, np.where(episode == ep0, rate0, 0.0))
    rate = np.where(live & grows, rate, 0.0)

    says = _latest(reset | done)
    status = np.where(says >= 0, np.where(reset, "active", kind)[says], status0)
    retries = retries0 + np.maximum(episode - 1, 0) - max(ep0 - 1, 0)

    # silence ends with a sample, a reset or an end; a server's count is no sign of life
    signs = np.flatnonzero(kind != "count")
    gap = signs[:-1][take[signs[:-1]] & (us[signs[1:]] - us[signs[:-1]] > stall_us)]
    alerts = [(episode[i], tokens[i], rate[i], us[i] + stall_us, status[i], retries[i]) for i in gap]
    if len(signs) and act0 is not None and not stalled0 and us[signs[0]] - act0 > stall_us:
        alerts.insert(0, (ep0, act_tok0, rate0, act0 + stall_us, status0, retries0))
    act, act_tok, stalled = act0, act_tok0, stalled0
    if len(signs):
        act, act_tok, stalled = (int(us[signs[-1]]), int(tokens[signs[-1]]), False) if take[signs[-1]] else (None, 0, False)
    out = {"event_id": rows["event_id"], "kind": kind, "episode": episode, "tokens": tokens, "rate": rate, "us": us, "status": status, "retries": retries}
    if n:
        alive = bool(live[-1] and not done[-1])
        keep = (s_ep == episode[-1]) & (s_us >= us[-1] - win_us) & alive
        state = (int(episode[-1]), alive, int(tokens[-1]) if alive else 0, float(rate[-1]) if alive and grows[-1] else 0.0, s_us[keep].tolist(), s_tok[keep].tolist(),
                 act, act_tok, int(us[-1]), stalled, str(status[-1]), int(retries[-1]))
    return state, out, alerts


_COLS = ("event_id", "kind", "delta", "us")


def _array(column: str, values) -> np.ndarray:
    """A column of the rows that wait in the state, as it comes from pandas (a null number is NaN)."""
    values = [] if values is None else list(values)
    if column == "kind":
        return np.array(values, object)
    return np.array([np.nan if v is None else v for v in values], np.float64 if None in values else np.int64)


def _joined(value, n: int, alerts, rows: np.ndarray, dtype) -> np.ndarray:
    """``value`` for each of ``n`` late rows, then the alerts', then the rows' own."""
    return np.concatenate([np.full(n, value, dtype), np.array(alerts, dtype), rows.astype(dtype)])


def _nullable(late: np.ndarray, alerts: int, rows: np.ndarray) -> pd.arrays.IntegerArray:
    """Event ids of late rows, of alerts (none) and of rows."""
    gone = np.concatenate([np.isnan(late), np.ones(alerts, bool), np.isnan(rows)])
    ids = np.concatenate([late, np.zeros(alerts, np.int64), rows])
    return pd.arrays.IntegerArray(np.where(gone, 0, ids).astype(np.int64), gone)


def _tracker(window_s: float, min_dt_s: float, stall_s: float, keep_s: float, reorder: bool):
    win_us, stall_us, keep_us = int(window_s * US), int(stall_s * US), int(keep_s * US)

    def fn(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        old = tuple(state.get) if state.exists else _NEW
        mark = state.getCurrentWatermarkMs() * 1000
        wait = [_array(c, x) for c, x in zip(_COLS, old[12:])]
        come = [wait] if state.hasTimedOut else [wait, *([np.asarray(p[c]) for c in _COLS] for p in pdfs)]
        come = [p for p in come if len(p[0])] or [wait]
        rows = dict(zip(_COLS, come[0] if len(come) == 1 else map(np.concatenate, zip(*come))))
        us = rows["us"]
        late = us < mark if not reorder else (us < mark) & (np.arange(len(us)) >= len(wait[0]))
        ready = np.flatnonzero(~late & ((us < mark) | (not reorder)))
        ready = ready[np.lexsort((rows["event_id"][ready], us[ready]))]
        new, out, alerts = advance((*old[:4], old[4] or [], old[5] or [], *old[6:12]), {c: v[ready] for c, v in rows.items()}, win_us, min_dt_s, stall_us)
        ep, live, tokens, rate, _, _, act, act_tokens, last, stalled, status, retries = new
        due = act + stall_us if act is not None and not stalled else None
        if due is not None and due // 1000 <= state.getCurrentWatermarkMs():
            alerts.append((ep, act_tokens, rate, due, status, retries))
            new, due = (*new[:9], True, *new[10:]), None
        rest = ~late
        rest[ready] = False
        tail = us[rest]
        moments = [due] * (due is not None) + ([int(tail.min()) + 1000] if len(tail) else []) + [last + keep_us] * (status in FINISHED)
        if status in FINISHED and not len(tail) and last + keep_us <= mark:
            state.remove()
        else:
            state.update((*new, *(rows[c][rest].tolist() for c in _COLS)))
            if moments:
                state.setTimeoutTimestamp(int(max(min(moments) // 1000, state.getCurrentWatermarkMs() + 1)))
        n_late, n_told = int(late.sum()), len(alerts)
        if n_late + n_told + len(out["us"]):
            told = list(zip(*alerts)) or [()] * 6
            yield pd.DataFrame({
                "event_id": _nullable(rows["event_id"][late], n_told, out["event_id"]), "question_id": np.full(n_late + n_told + len(out["us"]), int(key[0])),
                "kind": np.concatenate([np.full(n_late, "late", object), np.full(n_told, "stalled", object), out["kind"]]),
                "episode": _joined(ep, n_late, told[0], out["episode"], np.int64), "tokens": _joined(tokens, n_late, told[1], out["tokens"], np.int64),
                "rate": _joined(rate, n_late, told[2], out["rate"], np.float64),
                "us": np.concatenate([us[late].astype(np.int64), np.array(told[3], np.int64), out["us"]]),
                "status": _joined(status, n_late, told[4], out["status"], object), "retries": _joined(retries, n_late, told[5], out["retries"], np.int64)})

    return fn


def with_event_time(stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Add ``us`` (epoch micros, time-zone free) and an event-time column
    ``et`` (TIMESTAMP from those micros) carrying the watermark."""
    s = stream.withColumn("us", epoch_us("ts")).withColumn("et", F.timestamp_micros(F.col("us")))
    return s.withWatermark("et", delay)


def track_questions(stream: DataFrame, window_s: float = RATE_WINDOW_S, min_dt_s: float = MIN_DT_S,
                    stall_s: float = STALL_S, delay: str = "1 hour", reorder: bool = False, keep_s: float = KEEP_S) -> DataFrame:
    """ST1-ST5: one output row per telemetry row (rate, tokens, episode,
    status, retries) plus ``stalled`` alert rows and ``late`` rows.

    ``reorder``: rows wait in state until the watermark passes them and are
    then applied in event-time order, so rows arriving out of order within
    the watermark delay give the same result as sorted input (output is
    delayed by the watermark delay). Off: rows are applied as they arrive,
    sorted within each micro-batch."""
    s = with_event_time(stream, delay).select("event_id", "question_id", "kind", "delta", "us", "et")
    return s.groupBy("question_id").applyInPandasWithState(
        _tracker(window_s, min_dt_s, stall_s, keep_s, reorder), OUTPUT_SCHEMA, STATE_SCHEMA, "append",
        GroupStateTimeout.EventTimeTimeout)


def sessions(stream: DataFrame, gap: str = "25 seconds", delay: str = "1 hour") -> DataFrame:
    """ST9: activity sessions per question (a gap of ``gap`` closes one)."""
    s = with_event_time(stream, delay)
    g = s.groupBy("question_id", F.session_window("et", gap).alias("w")).agg(
        F.count(F.lit(1)).alias("events"), F.sum("delta").alias("tokens"))
    return g.select("question_id", F.unix_micros(F.col("w.start")).alias("start_us"),
                    F.unix_micros(F.col("w.end")).alias("end_us"), "events", "tokens")


def throughput_windows(stream: DataFrame, size: str = "8 seconds", slide: str = "1 second",
                       delay: str = "1 hour") -> DataFrame:
    """ST9: tokens per sliding window per question."""
    s = with_event_time(stream, delay)
    g = s.groupBy("question_id", F.window("et", size, slide).alias("w")).agg(
        F.sum("delta").alias("tokens"), F.count(F.lit(1)).alias("events"))
    return g.select("question_id", F.unix_micros(F.col("w.start")).alias("start_us"), "tokens", "events")


def dedup_late(stream: DataFrame, key: str = "event_id", delay: str = "1 hour") -> DataFrame:
    """ST10: drop repeated deliveries of an event within the watermark
    delay (state per key is dropped once the watermark passes it)."""
    return with_event_time(stream, delay).dropDuplicatesWithinWatermark([key])


def latest_state(tracked: DataFrame) -> DataFrame:
    """ST1: the newest tracker row per question (alerts excluded)."""
    t = tracked.where(~F.col("kind").isin("stalled", "late"))
    g = t.groupBy("question_id").agg(F.max_by(F.struct("episode", "tokens", "rate", "status", "retries"),
                                              F.struct("us", "event_id")).alias("_s"))
    return g.select("question_id", *[F.col(f"_s.{c}").alias(c) for c in
                                     ("episode", "tokens", "rate", "status", "retries")])
