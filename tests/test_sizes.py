"""Queries on rows that the small tables do not hold, each beside its SQL, and operators whose share for a task must not grow with the input."""

import datetime
import re
from pathlib import Path

import pytest
from compare import differences
from pyspark.sql import functions as F

from tessera import operators
from tessera.functions import aggregates, numeric
from tessera.plans import catalog
from tessera.sources import TABLES

DATA = "/root/testdata/sf0.001"
EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def beside(tmp_path, **tables) -> str:
    """A folder of the small tables with some of them replaced."""
    for name in TABLES:
        if name in tables:
            tables[name].write.parquet(f"{tmp_path}/parts-{name}")
            [part] = Path(f"{tmp_path}/parts-{name}").glob("*.parquet")
            part.rename(tmp_path / f"{name}.parquet")
        else:
            (tmp_path / f"{name}.parquet").symlink_to(f"{DATA}/{name}.parquet")
    return str(tmp_path)


def events(spark, rows):
    """Of (event_id, user_id, event_type, value), in one file."""
    at = datetime.datetime(2024, 1, 1)
    return spark.createDataFrame([(i, at, u, e, v, "{}") for i, u, e, v in rows], EVENTS).coalesce(1)


def test_partial_update_of_a_key_without_a_group_key(spark, tmp_path):
    rows = [(1, 1, "view", 1.0), (2, 1, "click", 2.0), (7, 2, "view", 3.0), (8, 2, "click", 4.0), (14, 3, None, 5.0), (15, 3, "view", None)]
    d = beside(tmp_path, events=events(spark, rows))
    assert differences(catalog.QUERIES["merge_partial_update"](spark, d), catalog.ORACLE_SQL["merge_partial_update"], d) == []


def test_quantile_is_exact_whatever_the_groups_hold(spark):
    df = spark.range(3000).select(
        F.when(F.col("id") % 5 > 0, F.concat(F.lit("g"), F.col("id") % 5)).alias("g"),
        F.when(F.col("id") % 7 > 0, F.when(F.col("id") % 5 == 1, F.lit(2.5)).when(F.col("id") % 5 == 2, F.col("id") % 2 * 1e9).when(F.col("id") % 5 == 3, -F.pow(F.lit(1.01), F.col("id"))).otherwise(F.col("id") * 37 % 1000 / 8)).alias("x"),
    )
    df = df.unionByName(spark.createDataFrame([("one", 4.0), ("two", 1.0), ("two", 2.0), ("none", None)], "g string, x double"))
    for p in (0.0, 0.25, 0.5, 0.999, 1.0):
        want = {r["g"]: r["q"] for r in df.groupBy("g").agg(F.percentile("x", F.lit(p)).alias("q")).collect() if r["q"] is not None}
        got = {r["g"]: r["q"] for r in aggregates.quantile(df, ["g"], "x", p, "q").collect()}
        assert got.keys() == want.keys() and all(abs(got[g] - want[g]) <= 1e-12 * abs(want[g]) for g in want)


def test_sketches_are_not_kept_for_each_value(spark):
    plan = catalog.QUERIES["agg_sketches"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if "Aggregate" in line and "event_id" in line.split("functions=")[0] and "sketch" in line]


def test_sketches_with_missing_types_ids_and_values(spark, tmp_path):
    rows = [(i % 40, i % 3, "view" if i % 2 else None, None if i % 9 == 0 else i * 1.5) for i in range(200)] + [(None, 1, "click", 1.0), (None, 1, "click", 2.0), (3, 1, "click", 2.0)]
    d = beside(tmp_path, events=events(spark, rows))
    assert differences(catalog.QUERIES["agg_sketches"](spark, d), catalog.ORACLE_SQL["agg_sketches"], d) == []


def shares(spark, name: str, monkeypatch) -> list[int]:
    """Partitions that a query deals its rows over, for tasks of a million rows and of 100."""
    found = []
    for rows in (1_000_000, 100):
        monkeypatch.setattr(operators.parts, "__defaults__", (rows,))
        plan = catalog.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
        found.append(max(int(n) for n in re.findall(r"(\d+)\), REPARTITION_BY_NUM|SelectedBucketsCount: (\d+)", plan) for n in n if n))
    return found


@pytest.mark.parametrize(("name", "want"), [("streaming_aggregate", [4, 60]), ("sorted_aggregation", [4, 60]), ("partitioners", [5, 15]), ("bucketed_join", [4, 60]), ("bucket_column", [4, 15])])
def test_rows_of_a_task_do_not_grow_with_the_table(spark, monkeypatch, name, want):
    assert shares(spark, name, monkeypatch) == want


def test_distribution_functions_beyond_and_at_ties(spark, tmp_path):
    rows = [(i, 1, "view", v) for i, v in enumerate((250.0, 520.16, 560.21, 0.0, 500.0, 515.46, 515.47, 1.25))]
    d = beside(tmp_path, events=events(spark, rows))
    assert differences(catalog.QUERIES["fn_transcendental"](spark, d), catalog.ORACLE_SQL["fn_transcendental"], d) == []


def test_inverse_of_the_incomplete_beta():
    for a, b in ((2, 1), (2, 2), (0.5, 0.5), (50, 3), (0.2, 3), (1e3, 1e3)):
        assert numeric.inverse_incomplete_beta(a, b, 0.0) == 0 and numeric.inverse_incomplete_beta(a, b, 1.0) == 1
        for p in (1e-9, 0.01, 0.5, 0.99):
            assert abs(numeric.incomplete_beta(a, b, numeric.inverse_incomplete_beta(a, b, p)) - p) < 1e-10
