"""Report projections (W1, W2, R1-R4, S7, S9): the data behind the
wrong-answer browser, the live summary and the text summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import options_line, truncate
from . import scan
from .clean import fill_defaults
from .score import wrong_stats


def fixed_decimal(num, den, digits: int) -> Column:
    """``num / den`` rounded half-to-even to ``digits`` decimals, as text,
    computed in exact integer arithmetic (no float formatting, so every
    engine prints the same digits)."""
    n, d = F.col(num) if isinstance(num, str) else num, F.col(den) if isinstance(den, str) else den
    scale = 10 ** digits
    big = (n * scale).cast("bigint")
    r = big % d                                  # n, d >= 0
    q = ((big - r) / d).cast("bigint")           # exact: big - r is a multiple of d
    up = (r * 2 > d) | ((r * 2 == d) & (q % 2 == 1))
    v = q + up.cast("bigint")
    frac = F.lpad((v % scale).cast("string"), digits, "0")
    return F.concat(((v - v % scale) / scale).cast("bigint").cast("string"), F.lit("."), frac)


def running_accuracy(scored: DataFrame, keys=("model", "category"), order: str = "seq",
                     block_size: int = scan.DEFAULT_BLOCK) -> DataFrame:
    """After every answer (in ``order``), answered / correct so far and
    the running accuracy - the summary the reference rewrites per answer."""
    keys = list(keys)
    d = scan.running_sums(scored, keys, order, {"answered": F.lit(1).cast("bigint"), "correct": F.col("hit").cast("bigint")}, (), block_size)
    return d.withColumn("running_acc", F.col("correct") / F.col("answered"))


def positions(wrong: DataFrame, keys=("category",), order: str = "seq", page_size: int = 10,
              block_size: int = scan.DEFAULT_BLOCK) -> DataFrame:
    """Position ``i/n`` of each row in its list, the boundary mark
    (``[FIRST]``, ``[LAST]``, ``[ONLY ONE]``) and the page (``page_size``
    rows per page). ``keys=()`` numbers one list over everything."""
    keys = list(keys)
    d = scan.running_sums(wrong, keys, order, {"position": F.lit(1).cast("bigint")}, (), block_size, totals=("position",))
    d = d.withColumnRenamed("position_total", "n")
    pos, cnt = F.col("position"), F.col("n")
    mark = (F.when((pos == 1) & (cnt > 1), F.lit("[FIRST]"))
            .when((pos == cnt) & (cnt > 1), F.lit("[LAST]"))
            .when(cnt == 1, F.lit("[ONLY ONE]")).otherwise(F.lit("")))
    return d.withColumn("mark", mark).withColumn("page", F.floor((pos - 1) / page_size).cast("bigint"))


def error_report(results: DataFrame, width: int = 80) -> DataFrame:
    """One display row per wrong answer (after defaults)."""
    w = fill_defaults(results).where(F.col("answer") != F.col("pred"))
    return w.select(
        "category", F.coalesce(F.col("question_id").cast("string"), F.lit("Unknown")).alias("question_id"),
        "src", "answer", "pred", "answer_index", "question",
        options_line("options").alias("options_text"),
        truncate("cot_content", width).alias("cot_short"),
        truncate("model_outputs", width).alias("output_short"))


def category_menu(results: DataFrame) -> DataFrame:
    """``wrong/total wrong (x.x% accuracy)`` per category and ALL."""
    s = wrong_stats(fill_defaults(results))
    pct = fixed_decimal((F.col("total") - F.col("wrong")) * 100, F.col("total"), 1)
    label = F.concat(F.col("wrong").cast("string"), F.lit("/"), F.col("total").cast("string"),
                     F.lit(" wrong ("), F.when(F.col("total") > 0, pct).otherwise(F.lit("0.0")),
                     F.lit("% accuracy)"))
    return s.select("category", "total", "wrong", label.alias("label"))


def summary_json(summary: DataFrame, by: str = "model") -> DataFrame:
    """``{"<cat>": {"corr": n, "wrong": n, "acc": x}, "total": {...}}``
    per ``by`` value, categories in name order. The collected list holds
    one entry per category (bounded by the category count)."""
    e = F.struct(F.col("category"), F.struct("corr", "wrong", "acc").alias("v"))
    g = summary.groupBy(by).agg(F.array_sort(F.collect_list(e)).alias("_e"))
    return g.select(by, F.to_json(F.map_from_entries("_e")).alias("summary_json"))


def report_lines(summary: DataFrame, by: str = "model") -> DataFrame:
    """The text summary - one ``Average accuracy 0.xxxx - <cat>`` line
    per category in name order, then ``Average accuracy: 0.xxxx``.
    ``line_no`` orders the lines within each ``by`` value."""
    cats = summary.where(F.col("category") != "total")
    tot = summary.where(F.col("category") == "total")
    acc4 = fixed_decimal(F.col("corr"), F.col("corr") + F.col("wrong"), 4)
    a = cats.select(by, F.col("category").alias("_k"), F.lit(0).alias("_sec"),
                    F.concat(F.lit("Average accuracy "), acc4, F.lit(" - "), F.col("category")).alias("line"))
    b = tot.select(by, F.lit("").alias("_k"), F.lit(1).alias("_sec"),
                   F.concat(F.lit("Average accuracy: "), acc4).alias("line"))
    from pyspark.sql import Window
    w = Window.partitionBy(by).orderBy("_sec", "_k")     # a few lines per value
    return a.unionByName(b).select(by, F.row_number().over(w).cast("bigint").alias("line_no"), "line")
