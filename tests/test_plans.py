"""The plans the operators are meant to have."""

import pytest
from pyspark.sql import functions as F

from hertzflow.operators.asof import asof_join
from hertzflow.operators.layout import POS, open_rows, order_rows
from hertzflow.operators.select import day_slice, keep_first
from hertzflow.plans.features import row_features
from inventory.base import hourly, signal

SF = "/root/testdata/sf0.001"


@pytest.fixture
def plan_of(capsys):
    def show(df):
        capsys.readouterr()
        df.explain("simple")
        return capsys.readouterr().out

    return show


def exchanges(plan):
    return plan.count("Exchange hashpartitioning") + plan.count("Exchange rangepartitioning") + plan.count("Exchange SinglePartition")


@pytest.fixture(scope="module")
def rows(spark):
    return order_rows(signal(spark, SF), ["series"], ["timestamp", "event_id"])


def test_all_row_features_share_one_shuffle_and_sort(rows, plan_of):
    plan = plan_of(row_features(rows))
    assert exchanges(plan) == 1 and plan.count("Sort [") == 1
    assert "Python" not in plan


def test_unused_columns_are_not_read(rows, plan_of):
    frames = rows.framed(before=1)
    df = frames.trim(frames.rows.withColumn("p", F.lag("grid_frequency").over(frames.window))).select("event_id", "p")
    plan = plan_of(df)
    assert "probability" not in plan[plan.index("ReadSchema") :]


def test_slow_side_is_broadcast_and_fast_side_stays_put(spark, plan_of):
    plan = plan_of(asof_join(signal(spark, SF), hourly(spark, SF), "timestamp"))
    assert "BroadcastHashJoin" in plan and "LeftOuter" in plan
    fast = plan[: plan.index("BroadcastExchange")]
    assert exchanges(fast) == 0


def test_prefix_scan_reads_its_table_twice_only(rows, plan_of):
    plan = plan_of(rows.running({"s": ("sum", F.col("grid_frequency"))}))
    # The result, and the totals of the blocks; levels above work on totals.
    assert plan.count("FileScan parquet") <= 3 and "SortMergeJoin" not in plan


def test_first_per_key_is_cut_before_the_shuffle(spark, plan_of):
    plan = plan_of(keep_first(signal(spark, SF), ["series"], ["timestamp", "event_id"]))
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_day_slice_is_pushed_down(rows, plan_of):
    plan = plan_of(day_slice(rows.df.select("timestamp", "event_id"), "timestamp", "2024-01-09"))
    assert "GreaterThanOrEqual(timestamp" in plan and "LessThan(timestamp" in plan


def test_a_kept_layout_opens_without_ordering(spark, tmp_path, plan_of):
    made = order_rows(signal(spark, SF), ["series"], ["timestamp", "event_id"], path=f"{tmp_path}/layout", partitions=4)
    again = open_rows(spark, f"{tmp_path}/layout")
    assert (again.total, again.series, again.order) == (made.total, made.series, made.order)
    assert exchanges(plan_of(again.df)) == 0
    a, b = (d.df.select(POS, "event_id").orderBy(POS).collect() for d in (made, again))
    assert a == b


def test_group_tables_meet_the_rows_where_they_are(spark, plan_of):
    """Even without automatic broadcasts, rows are not shuffled on a key of few values."""
    from hertzflow.functions.metrics import normalise_by_max
    from hertzflow.models.quantile import fit_grouped_quantiles
    from hertzflow.operators.layout import series_row_number
    from hertzflow.operators.windows import every_nth

    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = signal(spark, SF)
        assert "SortMergeJoin" not in plan_of(normalise_by_max(df, ["grid_frequency"], ["series"]))
        numbered = series_row_number(order_rows(df, ["series"], ["timestamp", "event_id"]))
        assert "SortMergeJoin" not in plan_of(every_nth(numbered))
        model = fit_grouped_quantiles(df, ["series"], "grid_frequency", (0.1, 0.9), ("lower", "upper"))
        plan = plan_of(model.transform(df))
        assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_rescored_scenario_has_all_levels(spark):
    from inventory import learn

    got = learn.d10_rescored(spark, "/root/testdata/sf0.001").collect()
    levels = {}
    for r in got:
        levels.setdefault(r.series, []).append(r.mw)
    assert levels and all(sorted(x) == list(range(0, 5001, 100)) for x in levels.values())
