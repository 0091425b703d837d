"""Plan checks: pushed filters and pruned reads, no Python in the flagship,
no text in the shuffle of the retry fold."""

from conftest import SF_MID
import __spark_entry__ as E


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filter_and_projection_reach_the_scan(spark):
    p = _plan(E.queries()["select_category"](spark, SF_MID))
    assert "PushedFilters: [IsNotNull(p_type), EqualTo(p_type,STANDARD)]" in p
    assert "ReadSchema: struct<p_partkey:bigint,p_type:string>" in p


def test_retry_fold_gathers_no_text(spark):
    p = _plan(E.queries()["best_of_n"](spark, SF_MID))
    gathered = [g.split("\n")[0] for g in p.split("partial_collect_list(")[1:]]
    assert len(gathered) == 2  # of blocks per key, and below it of attempts per block
    assert "struct(at" in gathered[-1] and "pred" in gathered[-1]
    assert not any("regexp" in g for g in gathered)


def test_flagship_has_no_python(spark):
    p = _plan(E.queries()["leaderboard_by_category"](spark, SF_MID))
    assert "Python" not in p


def test_questions_are_not_sent_to_the_driver(spark):
    """Rows of ``part`` with options are many times their file's size, by which a join would broadcast them."""
    from quizlens.sources import fixtures as fx
    for df in (E.queries()["policy_expected_options"](spark, SF_MID), fx.all_saved(spark, SF_MID), fx.saved_results(spark, SF_MID), fx.result_rows(spark, SF_MID)):
        p = _plan(df)
        assert "ShuffledHashJoin" in p and "BroadcastExchange" not in p
