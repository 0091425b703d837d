"""Evaluation-shaped inputs derived from the star-schema test tables.

The test tables carry no questions or answers, so the question, response,
saved-result, telemetry and chunk tables are derived from them by fixed
rules (see FIXTURES.md). Everything is a lazy DataFrame over the whole
tables; the work grows with ``part``, ``lineitem``, ``events`` and
``conversations``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import letter_at
from .results import fresh_dir
from .tables import read_table

ROWS_PER_TASK = 100_000     #: rows that a task of a sort, window or merge is given, about

# Option words of the derived questions, in option order.
OPTION_WORDS = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta",
                "theta", "iota", "kappa"]


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``q``: one question per part; 3-10 real options padded with ``N/A``;
    every 20th part is an exemplar (``validation`` split)."""
    p = read_table(spark, sf_dir, "part", "p_partkey", "p_name", "p_brand", "p_type", "p_size")
    k = F.col("p_partkey")
    n_opts = F.lit(3) + k % 8
    idx = (F.col("p_size") % n_opts).cast("int")
    opts = [F.concat(F.lit(w + " "), F.col("p_type")) for w in OPTION_WORDS[:3]]
    opts += [F.when(k % 8 >= i, F.concat(F.lit(w + " "), F.col("p_type"))).otherwise(F.lit("N/A"))
             for i, w in enumerate(OPTION_WORDS[3:], start=1)]
    return p.select(
        k.alias("question_id"),
        F.concat(F.lit("Which label fits the "), F.col("p_name"), F.lit(" of "),
                 F.col("p_brand"), F.lit("?")).alias("question"),
        F.split(F.concat_ws(",", *opts), ",").alias("options"),
        n_opts.alias("n_opts"),
        letter_at(idx).alias("answer"),
        idx.alias("answer_index"),
        F.when(k % 3 == 0, F.lit(""))
         .otherwise(F.concat(F.lit("A: Let's think step by step. Size "),
                             F.col("p_size").cast("string"), F.lit(" decides. The answer is ("),
                             letter_at(idx), F.lit(")."))).alias("cot_content"),
        F.col("p_type").alias("category"),
        F.col("p_brand").alias("src"),
        F.when(k % 20 == 0, F.lit("validation")).otherwise(F.lit("test")).alias("split"),
    )


_RESP_ORDER = ["l_shipdate", "l_orderkey", "l_linenumber", "l_quantity",
               "l_extendedprice", "l_suppkey", "l_linestatus"]


def responses(spark: SparkSession, sf_dir: str, q: DataFrame | None = None, gold=(), n_tasks: int | None = None) -> DataFrame:
    """``resp``: one response per lineitem; 5 models x 24 styles, attempts
    numbered per (model, style, question) and per (model, question).

    The join with the questions shuffles by ``question_id``, which also serves
    both windows and later joins with the questions: one shuffle. It is
    named: the file size of ``part`` says little of its rows with options, and
    by it the planner would send millions of them to the driver. Hashing a
    part of the questions saves the sorts of a merge join.
    ``gold``: question columns to carry along (saves a second join with the
    questions when the caller scores the responses). ``n_tasks``: number of
    tasks of that shuffle (None: as the planner sees fit).
    """
    gold = [c for c in gold if c != "answer"]
    q = q if q is not None else questions(spark, sf_dir)
    li = read_table(spark, sf_dir, "lineitem", *_RESP_ORDER, "l_partkey")
    if n_tasks:
        li, q = li.repartition(n_tasks, "l_partkey"), q.repartition(n_tasks, "question_id")
    qty = F.col("l_quantity").cast("int")
    b = (li.join(q.select("question_id", "answer", *gold).hint("shuffle_hash"), F.col("l_partkey") == F.col("question_id"))
         .select(
             F.concat(F.lit("model_"), (F.col("l_suppkey") % 5).cast("string")).alias("model"),
             (F.col("l_suppkey") % 24).alias("style_id"),
             F.when(F.col("l_linestatus") == "O", F.lit("cot")).otherwise(F.lit("direct")).alias("mode"),
             "question_id",
             (qty % 8).alias("form"),
             F.floor("l_extendedprice").cast("bigint").alias("tokens"),
             F.when(F.col("l_linenumber") <= 4, F.col("answer"))
              .otherwise(letter_at(((qty + F.col("l_linenumber")) % 10).cast("int"))).alias("letter"),
             *_RESP_ORDER, *gold,
             F.col("answer").alias("_gold_answer")))
    order = [F.col(c) for c in _RESP_ORDER]
    w_mq = Window.partitionBy("question_id", "model").orderBy(*order)
    w_st = Window.partitionBy("question_id", "model", "style_id").orderBy(*order)
    form, letter = F.col("form"), F.col("letter")
    text = (F.when(form == 0, F.concat(F.lit("The answer is ("), letter, F.lit(").")))
            .when(form == 1, F.concat(F.lit("Answer: "), letter))
            .when(form == 2, F.concat(F.lit("So the answer is "), letter))
            .when(form == 3, F.concat(F.lit("I pick "), letter, F.lit(" in the end")))
            .when(form == 4, F.concat(F.lit("**The answer is ("), letter, F.lit(")**")))
            .when(form == 5, F.lit("I have no idea"))
            .when(form == 6, F.lit("MaxTokensExceeded")))
    return (b.withColumn("attempt_mq", F.row_number().over(w_mq).cast("bigint"))
             .withColumn("attempt", F.row_number().over(w_st).cast("bigint"))
             .select("model", "style_id", "mode", "question_id", "attempt", "attempt_mq",
                     text.alias("model_outputs"), "tokens",
                     *([F.col("_gold_answer").alias("answer"), *gold] if gold else [])))


def tasks(spark: SparkSession, sf_dir: str) -> int:
    """Number of tasks over which the responses are dealt, so that a task's
    memory does not grow with the table (its rows are counted in file footers)."""
    n = read_table(spark, sf_dir, "lineitem").count()
    return max(spark.sparkContext.defaultParallelism, -(-n // ROWS_PER_TASK))


def written(df: DataFrame, name: str) -> DataFrame:
    """``df``, written once to a new folder of the shared checkpoint folder; for
    inputs that a query reads several times."""
    path = fresh_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def saved_results(spark: SparkSession, sf_dir: str, q: DataFrame | None = None,
                  resp: DataFrame | None = None) -> DataFrame:
    """``saved``: an earlier run of ``model_0`` over every third question,
    with duplicate ids (several attempts) and null predictions."""
    q = q if q is not None else questions(spark, sf_dir)
    resp = resp if resp is not None else responses(spark, sf_dir, q)
    r = resp.where((F.col("model") == "model_0") & (F.col("question_id") % 3 == 0)
                   & F.col("model_outputs").isNotNull())
    return (r.join(q.select("question_id", "question", "category", "answer").hint("shuffle_hash"), "question_id")
             .select((F.col("question_id") * 1000 + F.col("attempt_mq")).alias("seq"),
                     "question_id", "question", "category", "answer",
                     F.nullif(F.regexp_extract("model_outputs", r"answer is [(]?([A-J])", 1),
                              F.lit("")).alias("pred"),
                     "model_outputs"))


def all_saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``allsaved``: what finished runs of all models saved, over all
    questions, several attempts each; ``seq`` is the position over all files."""
    q, n = questions(spark, sf_dir), tasks(spark, sf_dir)
    r = responses(spark, sf_dir, q, n_tasks=n).where(F.col("model_outputs").isNotNull())
    no = F.substring_index("model", "_", -1).cast("bigint")
    return (r.join(q.repartition(n, "question_id").select("question_id", "question", "category", "answer").hint("shuffle_hash"), "question_id")
             .select(((no * 1_000_000_000 + F.col("question_id")) * 1000 + F.col("attempt_mq")).alias("seq"), "model",
                     "question_id", "question", "category", "answer",
                     F.nullif(F.regexp_extract("model_outputs", r"answer is [(]?([A-J])", 1), F.lit("")).alias("pred"),
                     "model_outputs"))


def result_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``res``: the runs as the result files hold them - one row per model
    and question (first saved row wins) with the question's options, answer
    index, exemplar reasoning and source. The windows' order (question, then model)
    serves the aggregate, so the saved rows are not sorted again."""
    from ..operators.resume import dedup_first
    q = questions(spark, sf_dir).repartition(tasks(spark, sf_dir), "question_id")
    s = dedup_first(all_saved(spark, sf_dir), ("question_id", "model"), "seq")
    return s.join(q.select("question_id", "options", "answer_index", "cot_content", "src").hint("shuffle_hash"), "question_id")


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``tele``: token-count samples per question from ``events``
    (gaps are hours, so windows are 8 h / 25 h in place of 8 s / 25 s);
    views are counts the server reported, clicks are samples."""
    ev = read_table(spark, sf_dir, "events", "event_id", "user_id", "ts", "event_type", "value")
    et = F.col("event_type")
    return ev.select(
        "event_id", F.col("user_id").alias("question_id"), "ts",
        F.when(et == "signup", "reset").when(et == "purchase", "success")
         .when(et == "error", "wrong").when(et == "view", "count").otherwise("update").alias("kind"),
        F.when(et == "signup", F.lit(0).cast("bigint"))
         .otherwise(F.round(F.col("value") * 100).cast("bigint")).alias("delta"))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``chunks``: streamed deltas per request from ``conversations``;
    assistant turns are content, others reasoning; the last turn carries the
    usage count except for every 7th request."""
    c = read_table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    last = F.max("turn").over(Window.partitionBy("conv_id"))
    asst = F.col("role") == "assistant"
    return c.select(
        F.col("conv_id").alias("request_id"), F.col("turn").alias("seq"),
        F.when(asst, F.lit("")).otherwise(F.col("text")).alias("reasoning"),
        F.when(asst, F.col("text")).otherwise(F.lit("")).alias("content"),
        F.when((F.col("turn") == last) & (F.col("conv_id") % 7 != 0),
               F.length("text").cast("bigint")).alias("usage_total_tokens"))


__all__ = ["questions", "responses", "saved_results", "all_saved", "result_rows", "telemetry", "chunks", "tasks", "written"]
