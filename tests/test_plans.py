"""Plan shape: the plans we want at scale."""

from pyspark.sql import functions as F

from tally.operators import overview as ov
from tally.operators.profile import profile, samples
from tally.plans.registry import all_checks
from tally.sources.tables import Tables

from .conftest import SF_SMALL


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_top_k_is_take_ordered(spark):
    df = ov.top_k(Tables(spark, SF_SMALL).orders, "o_orderpriority", "o_totalprice", 5)
    assert "TakeOrderedAndProject" in _plan(df)


def test_top_per_group_uses_window_group_limit(spark):
    df = ov.rank_dimensions(Tables(spark, SF_SMALL).orders, ["o_orderstatus", "o_orderpriority"], "o_totalprice", 5)
    df.collect()
    assert "WindowGroupLimit" in df._jdf.queryExecution().executedPlan().toString() or "WindowGroupLimit" in _optimized(df)
    s = samples(Tables(spark, SF_SMALL).orders, ["o_orderkey"], 6)
    assert "WindowGroupLimit" in _optimized(s)


def test_profile_statistics_are_one_scan(spark):
    for approx in (True, False):
        df = profile(Tables(spark, SF_SMALL).lineitem, approx=approx)
        plan = _plan(df)
        assert plan.count("FileScan parquet") == 1, approx
        assert "Expand" not in plan


def test_projection_and_filters_reach_the_scan(spark):
    q1 = all_checks()["q01_filter_predicates"].build(spark, SF_SMALL)
    plan = _plan(q1)
    assert "PushedFilters: [In(l_returnflag" in plan or "In(l_returnflag" in plan
    seg = all_checks()["c04_segment_revenue"].build(spark, SF_SMALL)
    p2 = _plan(seg)
    assert "ReadSchema: struct<o_custkey:bigint,o_totalprice:double>" in p2
    assert "CartesianProduct" not in p2


def test_no_cartesian_products_in_registered_plans(spark):
    skip = {"q05_range_join_price_bands"}  # bounded literal band table, broadcast nested loop
    for name, c in all_checks().items():
        if name in skip or name.startswith(("q06", "h02", "h03", "f09", "d0", "c0", "b0", "a1")):
            continue
        df = c.build(spark, SF_SMALL)
        assert "CartesianProduct" not in _plan(df), name


def test_range_join_broadcasts_the_band_table(spark):
    df = all_checks()["q05_range_join_price_bands"].build(spark, SF_SMALL)
    plan = _plan(df)
    assert "BroadcastNestedLoopJoin" in plan and "LocalTableScan" in plan


def test_capped_ordered_query_is_take_ordered(spark):
    df = all_checks()["e03_capped_query"].build(spark, SF_SMALL)
    assert "TakeOrderedAndProject" in _plan(df)


def test_registry_names_and_oracle_columns():
    import re

    checks = all_checks()
    assert len(checks) >= 100
    for name, c in checks.items():
        assert re.fullmatch(r"[a-hq]\d\d_[a-z0-9_]+", name), name
        assert "pipeline" not in name and not re.match(r"op\d+_", name)
