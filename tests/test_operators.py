import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera import operators as ops
from tessera import sources
from tessera.functions import evaluation
from tessera.plans import operator_checks


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_partial_update_takes_the_first_of_tied_group_keys(spark):
    df = spark.createDataFrame([(1, 1, 5, "a"), (1, 2, 5, "b"), (1, 3, 4, "c"), (2, 1, None, "c"), (2, 2, None, "d"), (3, 1, None, "e"), (3, 2, 1, None)], "k int, seq int, g int, v string")
    assert rows(ops.merge_partial_update(df, ["k"], "seq", ["v"], {"g": ["v"]})) == [(1, "a", 5), (2, "c", None), (3, None, 1)]


def test_partial_update_by_two_key_columns_with_an_aggregate(spark):
    df = spark.createDataFrame([(1, 1, 1, 1, 10), (1, 2, 1, None, 20), (1, 3, 1, 2, 30), (1, 4, 1, 2, 40), (1, 5, 2, None, 50)], "k int, seq int, g int, h int, v int")
    out = ops.merge_partial_update(df, ["k"], "seq", ["v"], {("g", "h"): ["v"]}, {"v": "sum"})
    assert rows(out) == [(1, 10 + 30 + 50, 2, None)]  # rows whose key is above all before them


def test_field_aggregates_of_maps_and_structs(spark):
    df = spark.sql("SELECT * FROM VALUES (1, 1, map('a', 1, 'b', 2), array(struct(1 AS x, 'p' AS y)), 'u'), (1, 2, map('b', 3), array(struct(1 AS x, 'q' AS y), struct(2 AS x, 'r' AS y)), null), (1, 3, null, null, 'w') AS t(k, s, m, n, l)")
    out = ops.merge_aggregate(df, ["k"], "s", {"m": "merge_map", "n": ops.nested_update("x"), "l": ops.listagg("; ")}).first()
    assert out["m"] == {"a": 1, "b": 3} and [tuple(x) for x in out["n"]] == [(1, "q"), (2, "r")] and out["l"] == "u; w"
    assert [tuple(x) for x in ops.merge_aggregate(df, ["k"], "s", {"n": "nested_update"}).first()["n"]] == [(1, "p"), (1, "q"), (2, "r")]


def test_index_lookup_of_repeated_keys_is_an_error(spark):
    probe = spark.range(3).withColumnRenamed("id", "p")
    lookup = spark.createDataFrame([(1, None), (1, "b")], "k long, v string")
    with pytest.raises(Exception, match="repeated"):
        ops.index_lookup_join(probe, lookup, F.col("p") == F.col("k"), unique=["k"]).collect()
    assert rows(ops.index_lookup_join(probe, lookup.limit(1), F.col("p") == F.col("k"), "left", unique=["k"])) == [(0, None, None), (1, 1, None), (2, None, None)]
    with pytest.raises(ValueError, match="inner or a left"):
        ops.index_lookup_join(probe, lookup, F.col("p") == F.col("k"), "right")


def test_row_numbers_without_an_order(spark):
    df = spark.range(0, 1000, 1, 7)
    assert sorted(r["row_number"] for r in ops.row_number(df).collect()) == list(range(1, 1001))
    assert sorted(r["row_number"] for r in ops.row_number(df, limit=5).collect()) == [1, 2, 3, 4, 5]
    assert ops.row_number(df.where("id < 0")).count() == 0


def test_null_aware_semi_project(spark):
    left = spark.createDataFrame([(1,), (None,), (3,)], "a int")
    right = lambda *x: spark.createDataFrame([(v,) for v in x], "b int")
    run = lambda *x: {r["a"]: r["matched"] for r in ops.null_aware_semi_project(left, right(*x), "a", "b").collect()}
    assert run(1) == {1: True, None: None, 3: False} and run(1, None) == {1: True, None: None, 3: None} and run() == {1: False, None: False, 3: False}


def test_salts_do_not_change_from_run_to_run(spark):
    df = spark.range(500).withColumn("k", F.col("id") % 2)
    run = lambda: rows(ops.salted_aggregate(df, ["k"], {"s": F.collect_list("id")}, {"s": F.sort_array(F.transform(F.collect_list("s"), F.size))}))
    assert run() == run()


def test_sorted_aggregation_reuses_the_partitioning_and_the_sort(spark):
    text = operator_checks.sorted_once(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange") == 1


def test_batches_for_a_consumer(spark):
    df = spark.createDataFrame([(k, f"s{k}", [k, None], {"a": k}) for k in range(25)], "k int, s string, l array<int>, m map<string,int>")
    got = list(sources.to_batches(df, 10))
    assert all(isinstance(b, pa.RecordBatch) for b in got) and [b.num_rows for b in got] == [10, 10, 5]
    assert sorted(r["k"] for b in got for r in b.to_pylist()) == list(range(25)) and list(sources.to_batches(df.limit(0))) == []


def test_connectors(spark):
    sources.register_connectors(spark)
    read = lambda table, **o: spark.read.format("tessera_generated").options(table=table, **o).load()
    assert read("nation").count() == 25 and read("customer", scale="0.01").agg(F.max("c_custkey")).first()[0] == 1500 and read("supplier", scale="0.1").count() == 1000
    assert read("nation").join(read("region"), F.col("n_regionkey") == F.col("r_regionkey")).where("r_name = 'EUROPE'").count() == 5
    spark.range(100).write.format("tessera_callback").option("callback", "gc:is_tracked").mode("append").save()
    with pytest.raises(Exception, match="no_such_module"):
        spark.range(5).write.format("tessera_callback").option("callback", "no_such_module:f").mode("append").save()


def test_try_gives_null_for_an_error(spark):
    assert spark.range(1).select(evaluation.try_(F.lit("x").cast("int")).alias("a"), evaluation.try_(F.lit(1)).alias("b")).first() == (None, 1)


def test_python_aggregate_with_nulls(spark):
    from tessera.functions.aggregates import udaf

    df = spark.createDataFrame([("a", 1.0), ("a", None), ("b", 3.0)], "k string, x double")
    assert rows(df.groupBy("k").agg(udaf(lambda x: float(x.dropna().sum()), "double")(F.col("x")).alias("s"))) == [("a", 1.0), ("b", 3.0)]


def test_weighted_reservoir_favours_weight(spark):
    from tessera.functions.aggregates import weighted_reservoir

    df = spark.range(200).withColumn("w", F.when(F.col("id") < 10, 1e6).otherwise(1.0))
    assert {r["id"] for r in weighted_reservoir(df, "w", 10, 3).collect()} == set(range(10))
