import hashlib
import hmac
import math

import pytest
from pyspark.sql import functions as F

from tessera import operators as ops
from tessera import sources, streaming
from tessera.functions import DIALECTS, call, names
from tessera.functions.presto import java_pattern


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def array(*values):
    return F.array(*(F.lit(v) for v in values))


def test_catalogue_sizes():
    assert len(names("spark")) >= 230 and len(names("presto")) >= 290 and len(names("flink")) == 14


@pytest.mark.parametrize(
    ("name", "args", "want"),
    [
        ("normal_cdf", (0.0, 1.0, 1.96), 0.9750021048517795), ("binomial_cdf", (10.0, 0.5, 3.0), 0.171875), ("poisson_cdf", (3.0, 2.0), 0.42319008112684353), ("chi_squared_cdf", (2.0, 5.991464547107979), 0.95),
        ("gamma_cdf", (2.0, 3.0, 4.0), 1 - math.exp(-4 / 3) * (1 + 4 / 3)), ("beta_cdf", (2.0, 3.0, 0.5), 0.6875), ("inverse_beta_cdf", (2.0, 3.0, 0.6875), 0.5), ("f_cdf", (2.0, 4.0, 1.0), 1 - (1 / 1.5) ** 2), ("laplace_cdf", (0.0, 1.0, 1.0), 1 - 0.5 * math.exp(-1)),
    ],
)
def test_distributions(spark, name, args, want):
    assert one(spark, call("presto", name, *args)) == pytest.approx(want, rel=1e-9)


def test_presto_edges(spark):
    p = lambda name, *a: one(spark, call("presto", name, *a))
    assert p("ngrams", array("a", "b", "c"), 2) == [["a", "b"], ["b", "c"]] and p("ngrams", array("a"), 3) == [["a"]]
    assert p("element", array(4)) == 4 and p("subscript", array(1, 2), 3) is None and p("subscript", array(1, 2), -1) is None
    with pytest.raises(Exception, match="more than one element"):
        p("element", array(4, 5))
    with pytest.raises(Exception, match="out of range"):
        p("wilson_interval_lower", 5, 3, 1.96)
    assert p("array_position", array(1, 2, 1, 1), 1, 2) == 3 and p("array_position", array(1, 2, 1, 1), 1, -1) == 4 and p("array_position", array(1), 1, 5) == 0
    assert p("array_normalize", array(3.0, 4.0), 2.0) == [0.6, 0.8] and p("array_average", array(1.0, None, 3.0)) == 2.0
    assert p("combinations", array(1, 2, 3).cast("array<bigint>"), 2) == [[1, 2], [1, 3], [2, 3]]
    assert bytes(p("hmac_sha256", F.lit(b"data"), F.lit(b"key"))) == hmac.new(b"key", b"data", hashlib.sha256).digest()
    assert p("from_ieee754_64", call("presto", "to_ieee754_64", 1.5)) == 1.5 and p("from_big_endian_64", call("presto", "to_big_endian_64", F.lit(-7).cast("bigint"))) == -7
    assert p("strpos", "abcabc", "bc", 2) == 5 and p("strrpos", "abcabc", "bc") == 5 and p("split", "a.b.c", ".", 2) == ["a", "b.c"]
    assert p("multimap_from_entries", F.array(F.struct(F.lit("a").alias("key"), F.lit(1).alias("value")), F.struct(F.lit("a").alias("key"), F.lit(2).alias("value")))) == {"a": [1, 2]}
    assert p("bit_count", 7, 2) == 2 and p("from_base64url", call("presto", "to_base64url", F.lit(b"\xfb\xff"))) == b"\xfb\xff"
    assert java_pattern("%Y-%m-%d %H:%i") == "yyyy-MM-dd HH:mm"


def test_every_function_has_a_query_or_a_reason():
    from tessera.functions import DIALECTS
    from tessera.plans import function_checks

    called = function_checks.called()
    assert [(d, n) for d, functions in DIALECTS.items() for n in functions if (d, n) not in called and n not in function_checks.WITHOUT_SQL] == []


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_dialects_do_not_follow_the_session(spark, ansi):
    """The same results and errors with ANSI on and off."""
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        s = lambda name, *a: one(spark, call("spark", name, *a))
        p = lambda name, *a: one(spark, call("presto", name, *a))
        most, least = 2**31 - 1, -(2**31)
        assert s("add", most, 1) == least and s("subtract", least, 1) == most and s("multiply", most, 2) == -2 and s("abs", least) == least and s("unaryminus", least) == least and s("negative", least) == least
        assert s("add", F.lit(2**63 - 1), F.lit(1).cast("bigint")) == -(2**63) and s("add", 1.5, 2.0) == 3.5
        assert s("element_at", array(1), 5) is None and s("element_at", array(1, 2), -1) == 2 and s("element_at", F.create_map(F.lit("a"), F.lit(1)), "b") is None
        assert s("make_date", 2024, 13, 1) is None and s("unix_timestamp", "bad", "yyyy-MM-dd") is None and s("to_unix_timestamp", "bad", "yyyy-MM-dd") is None and s("get_timestamp", "bad", "yyyy-MM-dd") is None
        assert s("conv", "9" * 40, 10, 16) == "F" * 16 and s("next_day", F.lit("2024-01-01").cast("date"), "XX") is None and s("make_timestamp", 2024, 13, 1, 0, 0, 0) is None and s("url_decode", "%zz") is None and s("parse_url", "http://a b", "HOST") is None
        assert one(spark, DIALECTS["spark"]["cast"](F.lit("abc"), "int")) is None and one(spark, DIALECTS["spark"]["cast"](F.lit(300), "tinyint")) == 44
        assert s("date2pdate", "20241341") is None and s("divide", 1, 0) is None
        for name, arguments in (("plus", (most, 1)), ("minus", (least, 1)), ("multiply", (most, 2)), ("abs", (least,)), ("negate", (least,)), ("divide", (7, 0))):
            with pytest.raises(Exception, match="(?i)overflow|division by zero"):
                p(name, *arguments)
        assert p("divide", 7, 2) == 3 and p("divide", -7, 2) == -3 and p("divide", 7.0, 2.0) == 3.5
        assert p("divide", 1.0, 0.0) == math.inf and p("divide", -1.0, 0.0) == -math.inf and p("divide", 1.0, -0.0) == -math.inf and math.isnan(p("divide", 0.0, 0.0)) and p("divide", F.lit(None).cast("double"), 0.0) is None
        assert [p(n, 0.0) for n in ("ln", "log2", "log10")] == [-math.inf] * 3 and all(math.isnan(p(n, -1.0)) for n in ("ln", "log2", "log10")) and p("ln", F.lit(None).cast("double")) is None
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)


def test_presto_division_by_type(spark):
    df = spark.createDataFrame([(7, 2, 1.0)], "a int, b bigint, c double")
    divide = DIALECTS["presto"]["divide"]
    assert df.select(divide(F.col("a"), F.col("b"), df)).first()[0] == 3 and df.select(divide(F.col("a"), F.col("c"), df)).first()[0] == 7.0


def test_presto_errors_and_types(spark):
    p = lambda name, *a: one(spark, call("presto", name, *a))
    assert p("to_base", -10, 2) == "-1010" and p("to_base", 255, 16) == "ff"
    for bad in ((float("nan"), array(1.0, 2.0)), (1.0, F.array().cast("array<double>")), (1.0, array(1.0, math.inf))):
        with pytest.raises(Exception, match="width_bucket"):
            p("width_bucket", *bad)
    assert p("width_bucket", 1.5, array(1.0, 2.0)) == 1
    assert p("trim_array", array("a", "b"), 1) == ["a"] and p("combinations", array("a", "b", "c"), 2) == [["a", "b"], ["a", "c"], ["b", "c"]]
    with pytest.raises(Exception, match="size outside"):
        p("trim_array", array("a"), 2)
    with pytest.raises(Exception, match="n is not positive"):
        p("ngrams", array("a"), 0)
    with pytest.raises(Exception, match="at most 5"):
        p("combinations", array(*range(10)), 6)
    assert p("array_frequency", array(3, None, 1, 3)) == {1: 1, 3: 2} and p("array_frequency", F.array().cast("array<int>")) == {} and p("array_duplicates", array(2, None, 1, 2, None)) == [2, None] and p("array_duplicates", array(1, None)) == []
    assert p("array_frequency", F.lit(None).cast("array<int>")) is None
    entries = F.transform(F.sequence(F.lit(0), F.lit(3999)), lambda i: F.struct((i % 7).alias("key"), i.alias("value")))
    assert p("multimap_from_entries", entries) == {k: list(range(k, 4000, 7)) for k in range(7)}
    assert p("array_frequency", F.transform(F.sequence(F.lit(0), F.lit(20_000)), lambda i: i % 5_000))[17] == 4


def test_functions_travel_to_workers(spark, tmp_path):
    """A job started elsewhere, with the package only on the driver's path."""
    import subprocess
    import sys
    from pathlib import Path

    root = str(Path(__file__).parent.parent)
    code = (
        f"import sys; sys.path.insert(0, {root!r})\n"
        "from pyspark.sql import SparkSession, functions as F\nfrom tessera.functions import call\n"
        "s = SparkSession.builder.master('local[1]').config('spark.ui.enabled', 'false').getOrCreate()\n"
        "assert s.range(3).select(call('presto', 'combinations', F.array(F.col('id'), F.lit(7).cast('bigint')), 2).alias('x')).first()['x'] == [[0, 7]]\n"
    )
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=300)


def test_downsample(spark):
    from tessera.functions.presto import downsample

    series = F.create_map(*(F.lit(x).cast("bigint") if k % 2 == 0 else F.lit(float(x)) for k, x in enumerate((1, 1, 3, 3, 25, 4))))
    assert one(spark, downsample(series, 10)) == {0: 2.0, 20: 4.0} and one(spark, downsample(series, 10, "sum", "zero")) == {0: 4.0, 10: 0.0, 20: 4.0}


def test_spark_edges(spark):
    s = lambda name, *a: one(spark, call("spark", name, *a))
    assert s("divide", 1, 0) is None and s("remainder", 7, 0) is None and s("str_to_long_arr", "1,x,-2,99999999999999999999") == [1, -2] and s("str_to_long_arr", "") is None
    assert s("array_slice_sum", array(1, 2, 3), -2) == 5 and s("array_slice_sum", array(1, 2, 3), 3) == 0 and s("array_slice_sum", F.lit(None).cast("array<int>"), 0) == 0
    assert s("bit_days_count", array(7, 3)) == 3 and s("array_sort_desc", array(1, None, 3)) == [3, 1, None] and s("date2pdate", 20240131) == "2024-01-31"
    assert s("map_update", F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(2)), F.create_map(F.lit("a"), F.lit(9))) == {"a": 9, "b": 2} and s("combine", F.lit(None).cast("array<int>"), array(1)) == [1]
    assert s("at_least_n_non_nulls", 2, F.lit(1), F.lit(None), F.lit(3)) is True


def test_flink_edges(spark):
    f = lambda name, *a: one(spark, call("flink", name, *a))
    assert f("split_index", "a,b", ",", 1) == "b" and f("split_index", "", ",", 0) is None and f("split_index", "a", ",", -1) is None and f("is_digit", F.lit(None).cast("string")) is False


def test_null_aware_anti(spark):
    left = spark.createDataFrame([(1,), (None,), (3,)], "a int")
    right = lambda *x: spark.createDataFrame([(v,) for v in x], "b int")
    run = lambda *x: sorted(str(r["a"]) for r in ops.null_aware_anti(left, right(*x), "a", "b").collect())
    assert run(1) == ["3"] and run(1, None) == [] and run() == ["1", "3", "None"]


def test_enforce_single_row(spark):
    assert ops.enforce_single_row(spark.range(0)).first()["id"] is None
    with pytest.raises(Exception, match="more than one row"):
        ops.enforce_single_row(spark.range(2)).collect()


def test_sources_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", None), (2, "b\x02c", 1.5)], "k int, s string, x double")
    sources.write_text(df, f"{tmp_path}/text")
    back = sources.read_text(spark, f"{tmp_path}/text", "k int, s string, x double")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    assert back.select(sources.parse_nested(F.col("s"), "array").alias("a")).where("size(a) = 2").count() == 1
    sources.write(df, f"{tmp_path}/orc", "orc", partition_by=["k"])
    assert sources.scan(spark, f"{tmp_path}/orc", "orc", where="k = 2", columns=["s"]).count() == 1
    assert sources.random_rows(spark, 100, {"a": "long", "b": "string", "c": "boolean"}).count() == 100
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,10.0)]" in sources.scan(spark, "/root/testdata/sf0.001/lineitem.parquet", where="l_quantity > 10", columns=["l_orderkey"])._jdf.queryExecution().toString()


def test_streaming_windows_equal_batch(spark):
    directory = "/root/testdata/sf0.001"
    batch = streaming.windowed(sources.table(spark, directory, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    stream = streaming.read_events(spark, directory).withColumn("ts", F.col("ts").cast("timestamp"))
    query = streaming.windowed(stream).writeStream.outputMode("complete").format("memory").queryName("windows").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted(map(str, spark.table("windows").collect())) == sorted(map(str, batch.collect()))


def test_hashes_equal_the_built_ins(spark):
    for v in ("", "abc", "naïve text", "x" * 37):
        assert one(spark, call("spark", "hash_with_seed", 42, v)) == one(spark, F.hash(F.lit(v))) and one(spark, call("spark", "xxhash64_with_seed", 42, v)) == one(spark, F.xxhash64(F.lit(v)))
    for v in (0, -5, 2**40):
        assert one(spark, call("spark", "hash_with_seed", 42, F.lit(v).cast("bigint"))) == one(spark, F.hash(F.lit(v).cast("bigint")))
    assert one(spark, call("spark", "hive_hash", "ab")) == 31 * 97 + 98
    from tessera.functions.numeric import bloom_filter

    kept = bloom_filter(range(500))
    assert all(r["x"] for r in spark.range(500).select(call("spark", "might_contain", F.lit(kept), F.col("id")).alias("x")).collect())
    assert sum(r["x"] for r in spark.range(1000, 3000).select(call("spark", "might_contain", F.lit(kept), F.col("id")).alias("x")).collect()) < 100


def test_spooky_hash(spark):
    """Published results."""
    known = {"": 0x232706FC6BF50919, "hello": 0x3768826AD382E6CA, "       ": 0x8A63CCE34DB3FC9E, "1234567890": 0xD9426F48C5CD219B, "more_than_12_characters_string": 0x3493AE21B95F627C}
    for text, want in known.items():
        assert bytes(one(spark, call("presto", "spooky_hash_v2_64", F.lit(text.encode())))).hex() == f"{want:016x}"
        assert bytes(one(spark, call("presto", "spooky_hash_v2_32", F.lit(text.encode())))).hex() == f"{want & 0xFFFFFFFF:08x}"
    from tessera.functions.numeric import spooky

    long = [spooky(bytes(range(256)) * 2 + b"x" * k) for k in range(100)]
    assert len(set(long)) == 100 and all(0 <= x < 2**64 for x in long)


def test_aggregates(spark):
    from tessera.functions import aggregates as A

    df = spark.createDataFrame([("a", 1, [7, 3]), ("a", 2, [5]), ("b", None, [1]), ("b", 8, [2, 9])], "k string, x long, w array<long>")
    agg = lambda name, *a: {r["k"]: r["y"] for r in df.groupBy("k").agg(A.AGGREGATES[name](*a).alias("y")).collect()}
    x = F.col("x")
    assert agg("geometric_mean", x)["a"] == pytest.approx(math.sqrt(2)) and agg("max_n", x, 1) == {"a": [2], "b": [8]} and {k: sorted(v, key=str) for k, v in agg("array_agg_nulls", x).items()}["b"] == [8, None]
    assert agg("entropy", x)["a"] == pytest.approx(math.log2(3) - 2 / 3) and agg("min_by_n", F.col("k"), x, 1)["a"] == ["a"] and agg("reduce_agg", x, F.lit(0).cast("bigint"), lambda s, v: s + v)["a"] == 3
    repeated = spark.createDataFrame([("g", "a", 1), ("g", "b", 2), ("g", "a", 3), ("g", None, 4)], "k string, x string, y int").coalesce(1)
    assert repeated.groupBy("k").agg(A.AGGREGATES["map_agg"](F.col("x"), F.col("y")).alias("m")).first()["m"] == {"a": 1, "b": 2}
    words = spark.createDataFrame([("g", [2**52 - 1]), ("g", [2**53 | 1])], "k string, w array<long>")
    assert words.groupBy("k").agg(A.AGGREGATES["bit_days_or"](F.col("w")).alias("w")).first()["w"] == [2**53 | (2**52 - 1 - 2**51)]
    assert agg("bit_days_or", F.col("w"))["a"] == [7, 5 | (3 & 1)]  # 3 loses its marker, the highest bit
    assert {r["k"]: r["w"] for r in A.merge_arrays(df, ["k"], "w").collect()} == {"a": [12, 3], "b": [3, 9]} and {r["k"]: r["w"] for r in A.merge_arrays(df, ["k"], "w", "array_count").collect()} == {"a": [2, 1], "b": [2, 1]}
    maps = df.select("k", F.create_map(F.lit("m"), F.coalesce("x", F.lit(0))).alias("m"))
    assert {r["k"]: r["m"] for r in A.merge_maps(maps, ["k"], "m", "map_union_sum").collect()} == {"a": {"m": 3}, "b": {"m": 8}}
    assert {r["k"]: r["histogram"] for r in A.histogram(df, ["k"], "x").collect()} == {"a": {1: 1, 2: 1}, "b": {8: 1}} and A.multimap(df, ["k"], "x", "w").count() == 2
    kurt = spark.createDataFrame([(float(v),) for v in (1, 2, 3, 4, 10)], "x double").agg(A.AGGREGATES["presto_kurtosis"](x).alias("y")).first()["y"]
    assert kurt == pytest.approx(3.152, abs=1e-3) and A.weighted_reservoir(df, "x", 2).count() == 2
