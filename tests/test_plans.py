"""The registered queries and the plans they make."""

import __spark_entry__ as entry
from boardsight.operators import paging
from boardsight.sources.signals import time_range

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    flagship = entry.entry(spark)
    assert flagship.columns == ["event_id", "user_id", "value"] and 0 < flagship.count() <= 500


def test_range_reaches_the_scan(spark):
    df = time_range(spark.read.parquet(f"{SF}/events.parquet"), "ts", "2024-01-05", "2024-01-06").select("value")
    text = plan(df)
    assert "GreaterThanOrEqual(ts" in text and "LessThanOrEqual(ts" in text
    assert "ReadSchema: struct<ts:timestamp_ntz,value:double>" in text


def test_gap_filter_shuffles_once(spark):
    df = paging.gap_filter(spark.read.parquet(f"{SF}/events.parquet"), "ts", "event_id", 1000, ["user_id"])
    assert plan(df).count("Exchange ") == 1


def test_page_is_a_top_k(spark):
    page = paging.time_page(spark.read.parquet(f"{SF}/events.parquet"), "ts", "event_id", "2024-01-01", "2024-02-01", page=2, size=10)
    assert "TakeOrderedAndProject" in plan(page)


def test_samples_of_queries_run(spark):
    queries = entry.queries()
    for name in ("s6_decode_motion", "j16_boards_of", "u5_persistence", "d9_near_duplicates", "x12_derived_key"):
        assert queries[name](spark, SF).count() > 0
