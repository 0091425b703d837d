"""Prompt construction.

Exemplar prefixes are built once per category, not once per question: the
first ``k`` exemplars of each category are chosen with ``row_number() <= k``
(Spark inserts a partial WindowGroupLimit before the shuffle, so a category
holding a third of the rows ships only k rows per map task), collected
(bounded by k), rendered, and joined to the questions; adaptive execution
broadcasts the prefix table where it measures it small, and splits a skewed
category of questions where not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import (LETTERS, MAX_TOKENS_TEXT, _c, format_block,
                              format_inline, letter_at, word_count)

# The API runners' prompt header and the batch runner's header
# template (``{$}`` is the category; one more newline is added after it).
API_HEADER = ("The following are multiple choice questions (with answers) about {}. Think step by"
              " step and then output the answer in the format of \"The answer is (X)\" at the end.\n\n")
LOCAL_HEADER_TEMPLATE = ("The following are multiple choice questions (with answers) about {$}. Think step"
                         " by step and then finish your answer with \"the answer is (X)\" where X is the"
                         " correct letter choice.\n\n\n")

# The four initial prompts of the prompt-style study
# ({subject} is the category).
STYLE_HEADERS = [
    "Please read the following multiple-choice questions and provide the most likely correct answer based on the options given.",
    "You are an expert in {subject}. Below is a series of example questions (with answers) about {subject} for demonstration. You will be given a question at the end, after the examples, for you to answer. Think it step by step, and give your answer at the end.",
    "The following are multiple choice questions (with answers) about {subject}.",
    "You are a helpful assistant. Below is a series of example questions (with answers) about {subject} for demonstration. You will be given a question at the end, after the examples, for you to answer. First give step-by-step reasoning about how to solve the question. Then output the answer.",
]

# The six example formats of the prompt-style study, as
# (question prefix, text between question and options, option marker
# "{L}" = letter, text after each option, text after the options, answer cue).
STYLE_FORMATS = [
    ("Question: ", "\nOptions:\n", "({L}) ", "\n", "\n", "Correct Answer:"),
    ("**Question**: ", "\nOptions:\n", "({L}) ", "\n", "\n", "**Correct Answer**:"),
    ("Q: ", "\nOptions:\n", "({L}) ", "\n", "\n", "The Best Choice: "),
    ("Question:\n", " ", "{L}) ", ", ", "\n", "The most likely option is "),
    ("Question: ", "\nOptions:\n", "{L}. ", "\n", "\n", "Your choice: "),
    ("**Question**: ", " ", "({L}) ", " ", "\n", "**Answer**:"),
]


def exemplar_texts(exemplars: DataFrame, k: int | None, render: Column, order: str = "question_id") -> DataFrame:
    """L2: per category, the rendered exemplars in order, as an array: the
    first ``k``, or all with ``k=None`` (they make up one prompt, which is one
    value either way). Rows of equal ``order`` follow their texts."""
    top = exemplars.select("category", order, render.alias("_txt"))
    if k is not None:
        w = Window.partitionBy("category").orderBy(order, "_txt")
        top = top.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k)
    return top.groupBy("category").agg(
        F.transform(F.array_sort(F.collect_list(F.struct(order, "_txt"))), lambda s: s["_txt"]).alias("exemplars"))


def spread(df: DataFrame) -> DataFrame:
    """The rows dealt evenly over ``spark.sql.shuffle.partitions`` tasks: a few MB
    of questions come from one or two file ranges, and each is about to become
    far more text."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _fewshot_texts(style: str, template: Column | None = None) -> tuple[Column, Column, Column]:
    """An exemplar's text, the target's, and the header."""
    name = F.coalesce("category", F.lit(""))
    if style == "api":
        return (format_inline("question", "options", "cot_content"), format_inline("question", "options"),
                F.concat(F.lit(API_HEADER.split("{}")[0]), name, F.lit(API_HEADER.split("{}")[1])))
    tpl = template if template is not None else F.lit(LOCAL_HEADER_TEMPLATE)
    return (format_block("question", "options", "cot_content", with_answer=True), format_block("question", "options", with_answer=False),
            F.concat(F.replace(tpl, F.lit("{$}"), name), F.lit("\n")))


def _blocks(targets: DataFrame, size: int) -> DataFrame:
    """``targets`` of a category gathered in blocks of about ``size`` by a hash."""
    n = targets.agg(F.ceil(F.count(F.lit(1)) / F.lit(size)).alias("n")).scalar()
    t = targets.withColumn("_block", F.pmod(F.xxhash64("question_id", "target"), F.greatest(n, F.lit(1))))
    parts = int(targets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return t.repartition(parts, "category", "_block").groupBy("category", "_block").agg(F.collect_list(F.struct("question_id", "target")).alias("targets"))


def fewshot(questions: DataFrame, exemplars: DataFrame, k: int | None = None, style: str = "api",
            strict: bool = False, template: Column | None = None, block_size: int | None = None) -> DataFrame:
    """T3 + J1: header + exemplars of the question's category (all, or the
    first ``k``) + the target question.

    style ``api``: inline format (T1) and the API header; ``local``: block
    format (T2) and the template header (``template``: e.g.
    ``sources.results.header_template(spark, path)``). A category without exemplars gets
    a zero-shot prompt (local runner); ``strict`` raises instead (API
    runners fail with KeyError). A question without a category has an empty
    name in its header and no exemplars, as in ``fit_kshot``.

    Whole prompts with all exemplars grow with the square of the questions. With
    ``block_size``, what a category's prompts share is kept once per block of
    about so many questions instead: ``(category, prefix, targets)``, where a
    question's prompt is ``prefix`` and its ``target`` (``targets``: array of
    ``question_id``, ``target``); ``generate`` takes such blocks.
    """
    name = F.coalesce("category", F.lit(""))
    render, target, header = _fewshot_texts(style, template)
    pre = exemplar_texts(exemplars, k, render)
    if block_size is not None:
        pre = pre.select("category", F.array_join("exemplars", "").alias("exemplars"))
        questions = _blocks(questions.select("question_id", "category", target.alias("target")), block_size)
    j = questions.join(pre, "category", "left")
    if strict:
        j = j.where(F.when(F.col("exemplars").isNull(),
                           F.raise_error(F.concat(F.lit("no exemplars for category "), name))).isNull())
    if block_size is not None:
        return j.select("category", F.concat(header, F.coalesce("exemplars", F.lit(""))).alias("prefix"), "targets")
    prefix = F.array_join(F.coalesce(F.col("exemplars"), F.array().cast("array<string>")), "")
    return j.select("question_id", "category",
                    F.concat(header, prefix, target).alias("prompt"),
                    F.coalesce(F.size("exemplars"), F.lit(0)).cast("bigint").alias("n_shots"))


def fit_kshot(questions: DataFrame, exemplars: DataFrame, k: int = 5, limit: int = 2048,
              counter=word_count, additive: bool | None = None, native: bool = True) -> DataFrame:
    """T4: the largest k' <= k whose whole prompt counts fewer than
    ``limit`` tokens (the batch runner starts at k and decrements). If even
    the zero-shot prompt does not fit: ``k`` null and ``overflow`` true (the
    reference would loop forever).

    ``additive`` (default for ``word_count`` alone, where it is exact: header
    and exemplar blocks end in whitespace, so no word spans two parts): each
    exemplar is counted once per category, header and target once per
    question, and a candidate's count is their sum. Otherwise every candidate prompt is counted whole, which is exact
    for any counter (real tokenizers are not additive): in the row with
    higher-order functions when ``counter`` is a native expression
    (``native``), else exploded into rows (e.g. for a pandas-UDF tokenizer)
    and picked by a ``max_by`` aggregation.
    """
    render = format_block("question", "options", "cot_content", with_answer=True)
    header_of = lambda c: F.concat(F.replace(F.lit(LOCAL_HEADER_TEMPLATE), F.lit("{$}"), F.coalesce(c, F.lit(""))), F.lit("\n"))
    target = format_block("question", "options", with_answer=False)
    if additive is None:
        additive = counter is word_count
    if additive:
        pre = exemplar_texts(exemplars, k, render)
        pre = pre.select("category", F.col("exemplars").alias("_ex"), F.transform("exemplars", counter).alias("_cnt"))
        qs = questions.select("question_id", "category", "question", "options")
        base = (qs.join(pre, "category", "left")
                .select("question_id", "category", counter(header_of(F.col("category"))).alias("_hn"), counter(target).alias("_tn"),
                        F.coalesce("_ex", F.array().cast("array<string>")).alias("_ex"),
                        F.coalesce("_cnt", F.array().cast("array<bigint>")).alias("_cnt"),
                        "question", "options"))
        top = F.least(F.lit(k), F.size("_ex"))
        total = lambda kk: F.col("_hn") + F.col("_tn") + F.aggregate(
            F.slice(F.col("_cnt"), 1, kk), F.lit(0).cast("bigint"), lambda a, x: a + x)
        cands = F.transform(F.sequence(top, F.lit(0), F.lit(-1)),
                            lambda kk: F.struct(kk.alias("k"), total(kk).alias("tokens")))
        best = F.get(F.filter(cands, lambda c: c["tokens"] < limit), 0)
        out = base.withColumn("best", best)
        prompt = F.concat(header_of(F.col("category")),
                          F.array_join(F.slice(F.col("_ex"), 1, F.col("best.k")), ""), target)
        return out.select("question_id", "category", F.col("best.k").alias("k"),
                          F.col("best.tokens").alias("tokens"),
                          F.when(F.col("best").isNotNull(), prompt).alias("prompt"),
                          F.col("best").isNull().alias("overflow"))

    pre = exemplar_texts(exemplars, k, render)
    base = questions.join(pre, "category", "left").select(
        "question_id", "category", header_of(F.col("category")).alias("_h"), target.alias("_t"),
        F.coalesce(F.col("exemplars"), F.array().cast("array<string>")).alias("_ex"))
    top = F.least(F.lit(k), F.size("_ex"))

    def prompt_for(kk):
        return F.concat(F.col("_h"), F.array_join(F.slice(F.col("_ex"), 1, kk), ""), F.col("_t"))

    if native:
        cands = F.transform(F.sequence(top, F.lit(0), F.lit(-1)),
                            lambda kk: F.struct(kk.alias("k"), counter(prompt_for(kk)).alias("tokens")))
        best = F.get(F.filter(cands, lambda c: c["tokens"] < limit), 0)
        out = base.select("question_id", "category", best.alias("best"), "_h", "_t", "_ex")
        return out.select("question_id", "category", F.col("best.k").alias("k"),
                          F.col("best.tokens").alias("tokens"),
                          F.when(F.col("best").isNotNull(), prompt_for(F.col("best.k"))).alias("prompt"),
                          F.col("best").isNull().alias("overflow"))
    cand = base.select("question_id", "category", "_h", "_t", "_ex",
                       F.explode(F.sequence(F.lit(0), top)).alias("k"))
    cand = cand.withColumn("prompt", prompt_for(F.col("k"))).withColumn("tokens", counter(F.col("prompt")))
    fits = F.col("tokens") < limit
    g = cand.groupBy("question_id", "category").agg(
        F.max_by(F.struct("k", "prompt", "tokens"), F.when(fits, F.col("k"))).alias("best"))
    return g.select("question_id", "category", F.col("best.k").alias("k"),
                    F.col("best.tokens").alias("tokens"), F.col("best.prompt").alias("prompt"),
                    F.col("best").isNull().alias("overflow"))


def _style_question(fmt, question: Column, options: Column) -> Column:
    qpre, mid, marker, after, tail, cue = fmt
    pre_l, post_l = marker.split("{L}")
    opts = F.array_join(F.transform(options, lambda o, i: F.concat(
        F.lit(pre_l), letter_at(i, LETTERS), F.lit(post_l), F.coalesce(o, F.lit("None")), F.lit(after))), "")
    return F.concat(F.lit(qpre), question, F.lit(mid), opts, F.lit(tail), F.lit(cue))


def style_grid(questions: DataFrame) -> DataFrame:
    """T5 + J6: every question rendered in the 4 x 6 prompt styles. The 24
    styles are a generator (``inline`` of a literal array), not a join; the
    questions are spread over tasks before it."""
    styles = [F.struct(F.lit(h * 6 + f + 1).alias("style_id"), F.lit(h + 1).alias("header_id"),
                       F.lit(f + 1).alias("format_id"))
              for h in range(len(STYLE_HEADERS)) for f in range(len(STYLE_FORMATS))]
    g = spread(questions.select("question_id", "category", "question", "options"))
    g = g.select("*", F.inline(F.array(*styles)))
    header = F.lit(None).cast("string")
    for i, h in enumerate(STYLE_HEADERS):
        header = F.when(F.col("header_id") == i + 1,
                        F.replace(F.lit(h), F.lit("{subject}"), F.coalesce("category", F.lit("")))).otherwise(header)
    body = F.lit(None).cast("string")
    for i, fmt in enumerate(STYLE_FORMATS):
        body = F.when(F.col("format_id") == i + 1,
                      _style_question(fmt, F.col("question"), F.col("options"))).otherwise(body)
    return g.select("question_id", "style_id", "header_id", "format_id",
                    F.concat(header, F.lit("\n\n"), body).alias("prompt"))


def chunk_deltas(chunks: DataFrame, save_thinking: bool = False, counter=word_count, carry=()) -> DataFrame:
    """Per chunk: ``_delta`` tokens (reasoning + content), ``_keep`` (the
    text kept in the response) and ``_nonempty``. A chunk with a usage count
    is only that: its text is skipped, like empty deltas."""
    txt = F.concat(F.coalesce("reasoning", F.lit("")), F.coalesce("content", F.lit("")))
    keep = txt if save_thinking else F.coalesce(F.col("content"), F.lit(""))
    return chunks.select("request_id", "seq", "usage_total_tokens", counter(txt).alias("_delta"), keep.alias("_keep"),
                         (F.col("usage_total_tokens").isNull() & (txt != "")).alias("_nonempty"), *carry)


def assemble(chunks: DataFrame, prompt_tokens=0, max_tokens: int = 32768,
             save_thinking: bool = False, counter=word_count) -> DataFrame:
    """Per request, the ordered concatenation of streamed deltas.

    Running total = prompt tokens + the tokens of each delta so far; the
    first delta that takes it past ``max_tokens`` aborts the request (status
    ``max_tokens``, the response is the sentinel, counts are those at the
    abort). Otherwise a request without a usage count fails
    (``missing_usage``) and a complete one reports the last one received.

    A request's deltas are one list, bounded by ``max_tokens`` in a live
    stream; where stored chunks go on beyond it, the texts are not gathered:
    the running total carries three numbers through the list, so the work is
    linear in the chunks, and texts are collected for complete requests only.
    """
    c = chunk_deltas(chunks, save_thinking, counter)
    pt = (F.lit(prompt_tokens) if isinstance(prompt_tokens, int) else _c(prompt_tokens)).cast("bigint")
    g = c.groupBy("request_id").agg(
        F.max_by("usage_total_tokens", F.when(F.col("usage_total_tokens").isNotNull(), F.col("seq"))).alias("usage"),
        F.array_sort(F.collect_list(F.when(F.col("_nonempty"), F.struct("seq", "_delta")))).alias("_deltas"))
    start = F.struct(pt.alias("run"), F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("cut"))
    add = lambda acc, d: F.when(acc["cut"] > 0, acc).otherwise(F.struct(
        (acc["run"] + d["_delta"]).alias("run"), (acc["n"] + 1).alias("n"),
        F.when(acc["run"] + d["_delta"] > max_tokens, acc["n"] + 1).otherwise(F.lit(0)).cast("bigint").alias("cut")))
    g = g.select("request_id", "usage", F.aggregate("_deltas", start, add).alias("_a"))
    status = (F.when(F.col("_a.cut") > 0, F.lit("max_tokens")).when(F.col("usage").isNull(), F.lit("missing_usage")).otherwise(F.lit("ok")))
    g = g.select("request_id", F.col("_a.n").alias("n_chunks"), F.col("_a.run").alias("est_tokens"), status.alias("status"), "usage")
    whole = g.where("status = 'ok'").select("request_id")
    texts = (c.where("_nonempty").join(whole, "request_id", "left_semi").groupBy("request_id")
             .agg(F.array_sort(F.collect_list(F.struct("seq", "_keep"))).alias("_parts"))
             .select("request_id", F.array_join(F.transform("_parts", lambda p: p["_keep"]), "").alias("_text")))
    ok = F.col("status") == "ok"
    return g.join(texts, "request_id", "left").select(
        "request_id", "n_chunks", "est_tokens", "status",
        F.when(F.col("status") == "max_tokens", F.lit(MAX_TOKENS_TEXT)).when(ok, F.coalesce("_text", F.lit(""))).alias("response"),
        F.when(ok, F.col("usage")).alias("final_tokens"))


__all__ = ["fewshot", "spread", "fit_kshot", "style_grid", "assemble", "chunk_deltas", "exemplar_texts"]
