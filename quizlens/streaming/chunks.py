"""Response assembly over a chunk stream (ST6), the streaming twin of
``operators.prompts.assemble``.

State per request: the deltas so far (position, text, tokens) and the last
usage count. A request whose total passes ``max_tokens`` is emitted at once;
its state shrinks to a marker, so that chunks still under way are ignored. Any
other request is decided at its end: when no chunk has come for ``quiet`` of
event time (``ok`` with the last usage count, ``missing_usage`` without one).
Deciding late means that a chunk after a usage count still counts, and that
chunks arriving out of order are put in order. State of decided requests,
markers included, is removed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.text import MAX_TOKENS_TEXT, word_count
from ..operators.prompts import chunk_deltas

OUTPUT_SCHEMA = ("request_id long, n_chunks long, est_tokens long, status string, response string, "
                 "final_tokens long")
STATE_SCHEMA = "seqs array<long>, texts array<string>, deltas array<long>, usage_seq long, usage long, over boolean, last_ms long"
_COLS = ["request_id", "n_chunks", "est_tokens", "status", "response", "final_tokens"]


def _assembler(prompt_tokens: int, max_tokens: int, quiet_ms: int):
    def fn(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rid = int(key[0])
        seqs, texts, deltas, usage_seq, usage, over, last = state.get if state.exists else ([], [], [], None, None, False, 0)
        kept = sorted(zip(seqs or [], texts or [], deltas or []))
        out = None
        if state.hasTimedOut:
            if not over:
                total = prompt_tokens + sum(d for _, _, d in kept)
                out = (rid, len(kept), total, "missing_usage", None, None) if usage is None else \
                    (rid, len(kept), total, "ok", "".join(t for _, t, _ in kept), int(usage))
            state.remove()
        else:
            for rows in pdfs:
                last = max(last, int(rows["ms"].max()))
                told = rows[rows["usage_total_tokens"].notna()].sort_values("seq").tail(1)
                if len(told) and (usage_seq is None or told["seq"].iloc[0] > usage_seq):
                    usage_seq, usage = int(told["seq"].iloc[0]), int(told["usage_total_tokens"].iloc[0])
                if not over:
                    new = rows[rows["_nonempty"]]
                    kept = sorted([*kept, *zip(map(int, new["seq"]), new["_keep"], map(int, new["_delta"]))])
                    runs = prompt_tokens + np.cumsum([d for _, _, d in kept], dtype=np.int64)
                    cut = int(np.searchsorted(runs, max_tokens, side="right"))
                    if cut < len(kept):
                        out, over, kept = (rid, cut + 1, int(runs[cut]), "max_tokens", MAX_TOKENS_TEXT, None), True, []
            state.update(([k[0] for k in kept], [k[1] for k in kept], [k[2] for k in kept], usage_seq, usage, over, last))
            state.setTimeoutTimestamp(max(last + quiet_ms, state.getCurrentWatermarkMs() + 1))
        if out:
            yield pd.DataFrame([out], columns=_COLS).astype({"request_id": "int64", "n_chunks": "int64", "est_tokens": "int64", "final_tokens": "Int64"})

    return fn


def assemble_stream(chunks: DataFrame, prompt_tokens: int = 0, max_tokens: int = 32768, save_thinking: bool = False,
                    counter=word_count, event_time: str = "et", delay: str = "1 minute", quiet: int = 600) -> DataFrame:
    """ST6: each request's response, once. ``event_time`` is the chunks'
    arrival time (a TIMESTAMP column), ``delay`` its watermark and ``quiet``
    the seconds without a chunk after which a request has ended. A request's
    state is bounded by ``max_tokens`` of text."""
    t = chunks.withWatermark(event_time, delay).withColumn("ms", F.unix_millis(event_time))
    txt = chunk_deltas(t, save_thinking, counter, carry=("ms", event_time))
    return txt.groupBy("request_id").applyInPandasWithState(
        _assembler(prompt_tokens, max_tokens, quiet * 1000), OUTPUT_SCHEMA, STATE_SCHEMA, "append", GroupStateTimeout.EventTimeTimeout)
