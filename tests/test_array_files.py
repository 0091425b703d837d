"""Array files read in byte ranges, against Python's json; shard folders."""

import json
import os
import random
import tempfile
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from quizlens.operators.score import per_file_accuracy
from quizlens.sources import array_files as af
from quizlens.sources import fixtures as fx
from quizlens.sources.results import RESULT_SCHEMA, read_result_files, read_shards, write_results


@pytest.fixture(params=["64b", "1k", "1m"])
def ranges(spark, request):
    spark.conf.set("spark.sql.files.maxPartitionBytes", request.param)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield request.param
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def odd_text(r):
    return "".join(r.choice(['{', '}', '[', ']', '"', "\\", ",", "}, {", "a", "é", "日", "\n", '\\"', '{"question_id": 1}', " "]) for _ in range(r.randrange(40)))


def write(path, value, **kw):
    with open(path, "w") as f:
        f.write(value if isinstance(value, str) else json.dumps(value, **kw))


def test_any_text_in_any_ranges(spark, ranges):
    r, d, want = random.Random(5), tempfile.mkdtemp(prefix="quizlens-arrays-"), {}
    for k in range(6):
        rows = [{"question_id": i, "options": [odd_text(r) for _ in range(r.randrange(4))], "model_outputs": odd_text(r), "answer": r.choice(["A", None]),
                 "extra": {"deep": [{"x": odd_text(r)}]}} for i in range(r.choice([0, 1, 40]))]
        write(f"{d}/c{k}_result.json", rows, ensure_ascii=bool(k % 2), indent=[None, None, 4][k % 3])
        want |= {(f"c{k}", i): (x["question_id"], x["options"], x["model_outputs"], x["answer"]) for i, x in enumerate(rows)}
    good, bad = read_result_files(spark, f"{d}/*_result.json")
    assert {(x.file_category, x.seq): (x.question_id, x.options, x.model_outputs, x.answer) for x in good.collect()} == want
    assert bad.count() == 0
    if ranges == "64b":
        several = af.pieces(spark, f"{d}/*").groupBy("file_path").agg(F.countDistinct("block").alias("n"), F.countDistinct(F.shiftright("id", 33)).alias("tasks"))
        assert max(x.n for x in several.collect()) > 20 and max(x.tasks for x in several.collect()) > 3


def test_text_is_kept_in_columns(spark):
    """What is kept of a file is scanned by column: sums over pieces and elements do
    not read their text again. First saved rows are found without a sort of their own."""
    d = tempfile.mkdtemp(prefix="quizlens-arrays-")
    write(f"{d}/a_result.json", [{"question_id": i, "model_outputs": 'x } "[' * i} for i in range(5)])
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    e, files = af.elements(spark, f"{d}/*")
    good, _ = read_result_files(spark, f"{d}/*")
    for df in (e, files, good):
        assert "ExistingRDD" not in plan(df) and "Scan parquet" in plan(df).replace("FileScan", "Scan")
    assert [(x.seq, x.question_id) for x in good.orderBy("seq").collect()] == [(i, i) for i in range(5)]
    fixtures_plan = plan(fx.result_rows(spark, SF_SMALL))
    assert "SortAggregate" in fixtures_plan and sum("Sort [" in x for x in fixtures_plan.splitlines()) == 1


def test_quarantine(spark, ranges):
    d = tempfile.mkdtemp(prefix="quizlens-arrays-")
    sound = [{"question_id": i, "model_outputs": "x" * 50} for i in range(9)]
    text = json.dumps(sound)
    whole = {"cut": text[:-30], "open": text[:-1], "comma": text.replace("}, {", "} {", 1), "two": text + text, "words": text[:-1] + ", oops]",
             "numbers": "[1, 2]", "mixed": "[null, " + text[1:], "inner": text.replace('"question_id": 4', '"question_id": 4x'), "trailing": text[:-1] + ",]"}
    other = {"object": '{"question_id": 1}', "text": "hello", "blank": " \n"}
    for k, v in {**whole, **other}.items():
        write(f"{d}/{k}_result.json", v)
        with pytest.raises(ValueError):
            json.loads(v) if k not in ("numbers", "mixed", "object") else json.loads("!")
    write(f"{d}/fine_result.json", text + "\n")
    write(f"{d}/none_result.json", "[ ]")
    write(f"{d}/typed_result.json", [*sound[:3], {"question_id": "seven", "options": []}, {"question_id": 8, "options": "abc"}, *sound[5:]])
    good, bad = read_result_files(spark, f"{d}/*")
    count = {x.file_category: x["count"] for x in good.groupBy("file_category").count().collect()}
    assert count == {"fine": 9, "typed": 7}
    got = defaultdict(list)
    for x in bad.collect():
        got[os.path.basename(x.file_path)[:-len("_result.json")]].append((x.reason, x.seq))
    assert {k: sorted(v) for k, v in got.items()} == {**{k: [(af.MALFORMED, None)] for k in whole}, **{k: [(af.NOT_ARRAY, None)] for k in other},
                                                      "typed": [(af.NO_FIT, 3), (af.NO_FIT, 4)]}


def test_written_files_are_the_reference_format(spark):
    d = tempfile.mkdtemp(prefix="quizlens-arrays-")
    rows = [(i, "m/x", "com science +1" if i % 3 else "law", i, None if i % 5 else "The answer is (A)", "A", 0, ["a"]) for i in range(50)]
    df = spark.createDataFrame(rows, "seq long, model string, category string, question_id long, model_outputs string, answer string, answer_index int, options array<string>")
    af.write_result_files(df, f"{d}/out", F.floor(F.col("question_id") / 20))
    names = [os.path.join(p, f) for p, _, fs in os.walk(f"{d}/out") for f in fs if f.startswith("part-")]
    loaded = [json.load(open(n)) for n in names]
    assert len(loaded) == 6 and sorted(x["question_id"] for rows in loaded for x in rows) == list(range(50))
    assert all([x["seq"] for x in rows] == sorted(x["seq"] for x in rows) for rows in loaded)
    good, bad = read_result_files(spark, f"{d}/out")
    files = {(x.file, x.level): x.succ + x.fail for x in per_file_accuracy(good.withColumn("file", af.file_label(F.col("file_path"))), by=("file",)).collect()}
    assert bad.count() == 0 and files["m/x/law/0", "l1"] == 7 and files["m/x/com science +1/2", "l2"] == 7 and len(files) == 12


def test_shard_folders(spark):
    base = tempfile.mkdtemp(prefix="quizlens-shards-")
    df = lambda *ids: spark.createDataFrame([(i, "law") for i in ids], "question_id long, category string")
    write_results(df(0, 4), f"{base}/shard=0")
    write_results(df(0, 4, 8), f"{base}/shard=0")                   # a newer version
    df(1).write.json(f"{base}/shard=1/data/v=000000001-x")          # no commit
    write_results(df(3), f"{base}/shard=3")
    df(7).write.json(f"{base}/shard=3/data/v=000000002-x")          # a later write that failed
    rows, states = read_shards(spark, base, 5, RESULT_SCHEMA)
    assert sorted((r.shard, r.question_id, r.category) for r in rows.collect()) == [(0, 0, "law"), (0, 4, "law"), (0, 8, "law"), (3, 3, "law")]
    assert {r.shard: r.state for r in states.collect()} == {0: "committed", 1: "started", 2: "absent", 3: "committed", 4: "absent"}
    none, states = read_shards(spark, base + "/nothing", 2, RESULT_SCHEMA)
    assert none.count() == 0 and none.columns == rows.columns and {r.state for r in states.collect()} == {"absent"}
