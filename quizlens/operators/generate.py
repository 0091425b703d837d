"""User functions over batches (F1, F2).

``generate`` runs a user function over batches of prompts with
``mapInPandas``: rows stay in their partitions, the function is created
once per task, and every output is matched to its prompt by id (never by
position across batches). A prompt whose call fails has a null response and
an error - it leaves no answer, so the question stays pending (P12).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LETTERS = "ABCDEFGHIJ"


def stub_answerer(prompts: list[str]) -> list[str]:
    """Deterministic stand-in for a model: answers with the letter picked
    by the prompt's length."""
    return [f"The answer is ({LETTERS[len(p) % 10]})." for p in prompts]


def _call(f, prompts):
    out = list(f(prompts))
    if len(out) != len(prompts):
        raise ValueError(f"function returned {len(out)} outputs for {len(prompts)} prompts")
    return out


def _alone(f, prompt):
    try:
        return _call(f, [prompt])[0], None
    except Exception as e:
        return None, f"{type(e).__name__}: {e}"


def _answers(f, prompts):
    """Response and error of every prompt of a batch."""
    try:
        return [(r, None) for r in _call(f, prompts)]
    except Exception:
        return [_alone(f, p) for p in prompts]


def generate(df: DataFrame, fn: Callable[[list[str]], list], id_col: str = "question_id",
             prompt_col: str = "prompt", batch_size: int = 64,
             factory: Callable[[], Callable] | None = None) -> DataFrame:
    """``(id, response, error)`` for every prompt. ``factory`` (optional)
    builds the function once per task, for models or clients that are
    expensive to create; otherwise ``fn`` is used as is. Prompts of a batch
    that fails are called one by one; one that fails alone has a null response
    and the error's text. ``df`` may hold blocks of prompts that share a prefix
    (``prompts.fewshot`` with ``block_size``); the function gets them whole."""
    if "targets" in df.columns:
        return _generate_blocks(df, fn, id_col, batch_size, factory)
    id_type = df.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, id_type), T.StructField("response", T.StringType()), T.StructField("error", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f = factory() if factory is not None else fn
        for pdf in batches:
            for start in range(0, len(pdf), batch_size):
                part = pdf.iloc[start:start + batch_size]
                out = _answers(f, part[prompt_col].tolist())
                yield pd.DataFrame({id_col: part[id_col].to_numpy(), "response": [r for r, _ in out], "error": [e for _, e in out]})

    return df.select(id_col, prompt_col).mapInPandas(run, schema)


BATCH_CHARS = 1 << 25       #: characters of a batch of whole prompts, unless one alone has more


def _generate_blocks(blocks: DataFrame, fn: Callable[[list[str]], list], id_col: str, batch_size: int,
                     factory: Callable[[], Callable] | None, batch_chars: int = BATCH_CHARS) -> DataFrame:
    """``generate`` of prompts that share a prefix: it comes to a task once per
    block, and the whole prompts are put together there. A batch has at most
    ``batch_size`` prompts and about ``batch_chars`` characters."""
    id_type = blocks.schema["targets"].dataType.elementType[id_col].dataType
    schema = T.StructType([T.StructField(id_col, id_type), T.StructField("response", T.StringType()), T.StructField("error", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = factory() if factory is not None else fn
        for rb in batches:
            for prefix, targets in zip(rb.column("prefix"), rb.column("targets")):
                prefix, rows = prefix.as_py(), targets.values
                ids, texts = rows.field(id_col), rows.field("target").to_pylist()
                step = min(batch_size, max(1, batch_chars // max(1, len(prefix))))
                out = []
                for start in range(0, len(texts), step):
                    out += _answers(f, [None if t is None else prefix + t for t in texts[start:start + step]])
                yield pa.RecordBatch.from_arrays([ids, pa.array([r for r, _ in out], pa.string()), pa.array([e for _, e in out], pa.string())],
                                                 names=[id_col, "response", "error"])

    return blocks.select("prefix", "targets").mapInArrow(run, schema)


def pandas_token_counter(encode: Callable[[str], list] | None = None,
                         factory: Callable[[], Callable[[str], list]] | None = None):
    """a pluggable token counter as an Arrow-batched pandas UDF; the
    encoder is built once per task (``factory``), e.g. a BPE tokenizer.
    Use it where a native expression (``functions.text.word_count``)
    is not the counter wanted."""
    state: dict = {}

    @F.pandas_udf(T.LongType())
    def count(texts: pd.Series) -> pd.Series:
        enc = state.get("enc")
        if enc is None:
            enc = factory() if factory is not None else encode
            state["enc"] = enc
        return texts.map(lambda t: None if t is None else len(enc(t))).astype("Int64")

    return count


def token_count_udf(col: str | Column, **kw) -> Column:
    return pandas_token_counter(**kw)(F.col(col) if isinstance(col, str) else col)
