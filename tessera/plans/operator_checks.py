"""Operators, aggregates, windows and connectors over whole tables, each beside DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera import operators as ops
from tessera import sources
from tessera.functions import aggregates as A
from tessera.functions import evaluation
from tessera.plans.function_checks import text_of_map

Query = Callable[[SparkSession, str], DataFrame]
C, t = F.col, sources.table


def nulls(spark, d, key="user_id", every=5):
    """Events of which every fifth has no key."""
    return t(spark, d, "events").select("event_id", F.when(C("event_id") % every != 0, C(key)).alias("k"))


NULLS = "(SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN user_id END AS k FROM events)"


def null_aware_semi(spark, d):
    """Right sides with, without and of no keys."""
    left, out = nulls(spark, d), []
    orders = t(spark, d, "orders")
    for case, right in (("nulls", orders.select(F.when(C("o_orderkey") % 3 == 0, C("o_custkey")).alias("r")).where("r is null or r % 2 = 0")), ("keys", orders.where("o_custkey % 3 = 0").select(C("o_custkey").alias("r"))), ("none", orders.where("o_orderkey < 0").select(C("o_custkey").alias("r")))):
        out.append(ops.null_aware_semi_project(left, right, "k", "r").withColumn("case", F.lit(case)))
    return out[0].unionByName(out[1]).unionByName(out[2])


def null_aware_anti(spark, d):
    left, out = nulls(spark, d), []
    orders = t(spark, d, "orders")
    for case, right in (("nulls", orders.select(F.when(C("o_orderkey") % 3 == 0, C("o_custkey")).alias("r"))), ("keys", orders.where("o_custkey % 3 = 0").select(C("o_custkey").alias("r"))), ("none", orders.where("o_orderkey < 0").select(C("o_custkey").alias("r")))):
        out.append(ops.null_aware_anti(left, right, "k", "r").withColumn("case", F.lit(case)))
    return out[0].unionByName(out[1]).unionByName(out[2])


def versions(spark, d):
    """Rows of few keys with tied and missing group keys."""
    e = t(spark, d, "events")
    return e.select((C("user_id") % 60).alias("k"), C("event_id").alias("seq"), F.when(C("event_id") % 4 != 0, C("event_type")).alias("e"), F.when((C("event_id") % 7 < 5) & (C("user_id") % 60 > 5), C("event_id") % 7).alias("g"), (C("event_id") % 3).alias("h"), C("value").alias("v"))


VERSIONS = "(SELECT user_id % 60 AS k, event_id AS seq, CASE WHEN event_id % 4 <> 0 THEN event_type END AS e, CASE WHEN event_id % 7 < 5 AND user_id % 60 > 5 THEN event_id % 7 END AS g, event_id % 3 AS h, value AS v FROM events)"


def field_aggregates(spark, d):
    e = t(spark, d, "events").select(
        C("user_id").alias("k"), C("event_id").alias("seq"), F.when(C("event_id") % 4 != 0, C("event_id")).alias("s"), C("event_id").alias("lo"), C("event_id").alias("hi"), (C("event_id") % 2 + 1).cast("double").alias("p"), (C("value") > 1).alias("ba"), (C("value") > 90).alias("bo"), F.when(C("event_id") % 4 != 0, C("event_type")).alias("lv"), F.when(C("event_id") % 4 != 0, C("event_type")).alias("fv"),
        F.when(C("event_id") % 4 != 0, C("event_type")).alias("ln"), F.when(C("event_id") % 4 != 0, C("event_type")).alias("fn"), C("event_type").alias("la"), C("event_type").alias("co"), C("event_type").alias("cd"), C("user_id").alias("pk"), F.array(F.struct((C("event_id") % 3).alias("x"), C("event_id").alias("y"))).alias("nu"), F.create_map((C("event_id") % 3).cast("string"), C("event_id")).alias("mm"),
    )
    out = ops.merge_aggregate(e, ["k"], "seq", {"s": "sum", "lo": "min", "hi": "max", "p": "product", "ba": "bool_and", "bo": "bool_or", "lv": "last_value", "fv": "first_value", "ln": "last_non_null_value", "fn": "first_non_null_value", "la": ops.listagg("|"), "co": "collect", "cd": "collect_distinct", "pk": "primary_key", "nu": ops.nested_update("x"), "mm": "merge_map"})
    return out.withColumns({"co": F.array_join("co", ","), "cd": F.array_join("cd", ","), "nu": F.array_join(F.transform("nu", lambda x: x["y"].cast("string")), ","), "mm": text_of_map(C("mm"))})


def sketches(s, d):
    """Sketches beside exact figures, which are made apart: with a distinct count in one aggregation Spark keeps all sketches for each value."""
    e = t(s, d, "events")
    ids = e.select("event_type", "event_id").distinct().groupBy("event_type").agg(F.count("event_id").alias("n"))
    exact = A.quantile(e, ["event_type"], "value", 0.5, "exact")
    distinct = ("approx_distinct", "cpc", "hll", "theta")
    middle = {name: A.AGGREGATES[name](C("value"), 0.5) for name in ("kll", "quantiles", "req")} | {"approx_percentile": A.AGGREGATES["approx_percentile"](C("value"), F.lit(0.5))}
    made = e.groupBy("event_type").agg((F.max("value") - F.min("value")).alias("size"), *(A.AGGREGATES[name](C("event_id")).alias(name) for name in distinct), *(f.alias(name) for name, f in middle.items()))
    for k, more in enumerate((ids, exact)):  # a row per type
        more = more.withColumnRenamed("event_type", f"type{k}")
        made = made.join(F.broadcast(more), C("event_type").eqNullSafe(C(f"type{k}")), "left")
    near = [(F.abs(C(name) - C("n")) <= 0.08 * C("n")).alias(name) for name in distinct] + [(F.abs(C(name) - C("exact")) <= 0.05 * C("size")).alias(name) for name in middle]
    return made.select("event_type", "n", F.round("exact", 6).alias("median"), *near)


def sketch_unions(s, d):
    """Sketches of each user joined by type, and sketches of quantiles by their types."""
    e = t(s, d, "events")
    part = e.groupBy("event_type", (C("user_id") % 10).alias("u")).agg(A.AGGREGATES["hll_sketch"](C("event_id")).alias("h"), A.AGGREGATES["cpc_sketch"](C("event_id")).alias("c"), A.AGGREGATES["approx_set"](C("event_id")).alias("a"), F.count(F.lit(1)).alias("n"))
    joined = part.groupBy("event_type").agg(F.sum("n").alias("n"), *(A.AGGREGATES["cardinality"](A.AGGREGATES[f](C(x))).alias(x) for f, x in (("hll_union_sketches", "h"), ("merge", "c"), ("merge", "a"))))
    return joined.select("event_type", "n", *((F.abs(C(x) - C("n")) <= 0.08 * C("n")).alias(x) for x in "hca"))


def kll_sketches(s, d):
    g = t(s, d, "events").groupBy("event_type")
    made = {x: A.AGGREGATES[f"kll_sketch_{x}"](C("event_type") if x == "c" else C("event_id").cast({"b": "tinyint", "s": "smallint", "i": "int", "l": "bigint", "f": "float", "d": "double"}[x]) if x not in "bs" else (C("event_id") % 100).cast({"b": "tinyint", "s": "smallint"}[x])) for x in "bcsilfd"}
    count = lambda x: F.call_function("kll_sketch_get_n_double" if x in "fd" else "kll_sketch_get_n_bigint", made[x]).cast("long").alias(f"n_{x}")
    return g.agg(*(count(x) for x in "bcsilfd"))


def bloom(s, d):
    """Orders that a filter of finished orders' customers lets through hold all of those customers' orders; few others pass."""
    orders = t(s, d, "orders")
    few = orders.where("o_totalprice > 480000").select("o_custkey").distinct()
    made = few.agg(A.AGGREGATES["bloom_filter_agg"](C("o_custkey")).alias("f")).first()["f"]
    passed = orders.where(evaluation.bloom_might_contain(F.lit(bytes(made)), C("o_custkey")))
    return passed.join(few, "o_custkey", "left_semi").agg(F.count(F.lit(1)).alias("n"))


def top_k(s, d):
    return t(s, d, "events").agg(F.array_join(F.transform(A.AGGREGATES["approx_most_frequent"](5, C("event_type")), lambda x: F.concat_ws("=", x["item"], x["count"])), ",").alias("top"), F.array_join(F.transform(A.AGGREGATES["fi"](C("event_type"), 5), lambda x: F.concat_ws("=", x["item"], x["count"])), ",").alias("fi"))


def scores():
    weights = np.array([0.5, -2.0])
    return lambda x: x @ weights + 1.0


def buckets(s, d):
    from tessera.plans.catalog import folder, fresh

    name, orders = fresh("bucketed"), t(s, d, "orders")
    n = ops.parts(orders, 4)
    sources.write_bucketed(orders.select("o_orderkey", "o_custkey"), name, ["o_custkey"], n, path=f"{folder(s)}/{name}")
    rows = sources.with_bucket(s.table(name)).groupBy("o_custkey").agg(F.count_distinct("$bucket").alias("buckets"), F.count(F.lit(1)).alias("n"), F.max("$bucket").alias("b"))
    return rows.select("o_custkey", "buckets", "n", C("b").between(0, n - 1).alias("inside"))


def dynamic_overwrite(s, d):
    """A second write replaces the partitions that it holds."""
    from tessera.plans.catalog import folder, fresh

    path = f"{folder(s)}/{fresh('dynamic')}"
    orders = t(s, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    sources.write(orders, path, partition_by=["o_orderstatus"])
    sources.write(orders.where("o_orderstatus = 'P'").withColumn("o_totalprice", F.lit(0.0)), path, mode="overwrite", partition_by=["o_orderstatus"], partitionOverwriteMode="dynamic")
    return sources.scan(s, path, columns=["o_orderkey", "o_totalprice"])


def generated(table: str, scale: float) -> Query:
    def run(s, d):
        sources.register_connectors(s)
        return s.read.format("tessera_generated").options(table=table, scale=str(scale), rows="5000").load()

    return run


def arrow_table(s, d):
    return sources.from_arrow(s, t(s, d, "nation").toArrow()).select("n_nationkey", "n_name")


def sorted_once(s, d):
    """Aggregation over rows that are dealt and sorted by their key: no exchange or sort is added (tests look at the plan)."""
    lines = t(s, d, "lineitem")
    rows = ops.partition_by_hash(lines, ops.parts(lines, 4), ["l_orderkey"]).sortWithinPartitions("l_orderkey")
    return ops.streaming_aggregate(rows, ["l_orderkey"], n=F.count(F.lit(1)), first=F.min("l_linenumber"))


def histogram(s, d):
    return A.histogram(t(s, d, "events"), ["user_id"], "event_type").select("user_id", text_of_map(C("histogram")).alias("h"))


def multimap(s, d):
    out = A.multimap(t(s, d, "events"), ["event_type"], "user_id", "event_id", "m")
    return out.select("event_type", F.explode("m").alias("u", "ids")).select("event_type", "u", F.array_join(F.array_sort("ids"), ",").alias("ids"))


def maps(how: str) -> Query:
    def run(s, d):
        e = t(s, d, "events").select("event_type", F.create_map((C("user_id") % 5).cast("string"), F.when(C("event_id") % 6 != 0, C("event_id")) if how == "map_union_count" else C("user_id") % 5 if how == "map_union" else C("event_id")).alias("m"))
        out = A.merge_maps(e, ["event_type"], "m", how)
        if how == "map_union_avg":
            out = out.withColumn("m", F.transform_values("m", lambda k, v: F.round(v).cast("long")))
        return out.select("event_type", text_of_map(C("m")).alias("m"))

    return run


def map_sql(value: str) -> str:
    return f"SELECT event_type, string_agg(k || '=' || coalesce(s::VARCHAR, 'N'), ',' ORDER BY k || '=' || coalesce(s::VARCHAR, 'N')) AS m FROM (SELECT event_type, (user_id % 5)::VARCHAR AS k, {value} AS s FROM events GROUP BY 1, 2) GROUP BY 1"


def array_addition(s, d):
    e = t(s, d, "embeddings").select("label", F.transform("embedding", lambda x: F.round(x.cast("double") * 1000).cast("long")).alias("e"))
    return A.merge_arrays(e, ["label"], "e", "array_addition").select("label", F.array_join("e", ",").alias("added"))


def geometric(values) -> float:
    return float(np.exp(np.log(values).mean()))


FRAMES: dict[str, tuple[Query, str]] = {
    "join_cross": (lambda s, d: ops.nested_loop_join(t(s, d, "nation").select("n_nationkey"), t(s, d, "region").select("r_regionkey"), None, "cross"), "SELECT n_nationkey, r_regionkey FROM nation CROSS JOIN region"),
    "join_nested_inner": (lambda s, d: ops.nested_loop_join(t(s, d, "supplier").select("s_suppkey", "s_acctbal"), t(s, d, "nation").select("n_nationkey"), C("s_acctbal") < C("n_nationkey") * 300), "SELECT s_suppkey, s_acctbal, n_nationkey FROM supplier JOIN nation ON s_acctbal < n_nationkey * 300"),
    **{
        f"join_nested_{how}": (lambda s, d, how=how: ops.nested_loop_join(t(s, d, "supplier").select("s_suppkey", "s_acctbal"), t(s, d, "nation").select("n_nationkey"), (C("s_acctbal") < C("n_nationkey") * 90 - 500) & (C("s_suppkey") != C("n_nationkey")), how), f"SELECT s_suppkey, s_acctbal, n_nationkey FROM supplier {how.upper()} JOIN nation ON s_acctbal < n_nationkey * 90 - 500 AND s_suppkey <> n_nationkey")
        for how in ("left", "right", "full")
    },
    "join_nested_semi": (lambda s, d: ops.nested_loop_join(t(s, d, "supplier").select("s_suppkey", "s_acctbal"), t(s, d, "nation").select("n_nationkey"), C("s_acctbal") < C("n_nationkey") * 90 - 500, "left_semi"), "SELECT s_suppkey, s_acctbal FROM supplier WHERE EXISTS (SELECT 1 FROM nation WHERE s_acctbal < n_nationkey * 90 - 500)"),
    "join_nested_anti": (lambda s, d: ops.nested_loop_join(t(s, d, "supplier").select("s_suppkey", "s_acctbal"), t(s, d, "nation").select("n_nationkey"), C("s_acctbal") < C("n_nationkey") * 90 - 500, "left_anti"), "SELECT s_suppkey, s_acctbal FROM supplier WHERE NOT EXISTS (SELECT 1 FROM nation WHERE s_acctbal < n_nationkey * 90 - 500)"),
    "join_nested_outer_without_condition": (lambda s, d: ops.nested_loop_join(t(s, d, "nation").select("n_nationkey"), t(s, d, "region").where("r_regionkey > 99").select("r_regionkey"), None, "left"), "SELECT n_nationkey, NULL::INT AS r_regionkey FROM nation"),
    "null_aware_semi_project": (null_aware_semi, f"WITH l AS (SELECT * FROM {NULLS}), r1 AS (SELECT CASE WHEN o_orderkey % 3 = 0 THEN o_custkey END AS r FROM orders), r2 AS (SELECT o_custkey AS r FROM orders WHERE o_custkey % 3 = 0), r3 AS (SELECT o_custkey AS r FROM orders WHERE o_orderkey < 0) SELECT *, k IN (SELECT r FROM r1 WHERE r IS NULL OR r % 2 = 0) AS matched, 'nulls' AS \"case\" FROM l UNION ALL SELECT *, k IN (SELECT r FROM r2), 'keys' FROM l UNION ALL SELECT *, k IN (SELECT r FROM r3), 'none' FROM l"),
    "null_aware_anti_nulls": (null_aware_anti, f"WITH l AS (SELECT * FROM {NULLS}), r1 AS (SELECT CASE WHEN o_orderkey % 3 = 0 THEN o_custkey END AS r FROM orders), r2 AS (SELECT o_custkey AS r FROM orders WHERE o_custkey % 3 = 0), r3 AS (SELECT o_custkey AS r FROM orders WHERE o_orderkey < 0) SELECT *, 'nulls' AS \"case\" FROM l WHERE k NOT IN (SELECT r FROM r1) UNION ALL SELECT *, 'keys' FROM l WHERE k NOT IN (SELECT r FROM r2) UNION ALL SELECT *, 'none' FROM l WHERE k NOT IN (SELECT r FROM r3)"),
    "index_lookup_conditions": (lambda s, d: ops.index_lookup_join(t(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), t(s, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), C("l_orderkey") == C("o_orderkey"), "left", unique=["o_orderkey"], conditions=[C("o_totalprice").between(C("l_quantity") * 1000, F.lit(400_000.0)), C("o_orderstatus").isin("O", "P")]), "SELECT l_orderkey, l_linenumber, l_quantity, o_orderkey, o_orderstatus, o_totalprice FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey AND o_totalprice BETWEEN l_quantity * 1000 AND 400000 AND o_orderstatus IN ('O', 'P')"),
    "row_number_limit": (lambda s, d: ops.row_number(t(s, d, "orders").select("o_custkey"), ["o_custkey"], 4).groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.max("row_number").cast("long").alias("last"), F.sum("row_number").alias("total")), "SELECT o_custkey, least(count(*), 4) AS n, least(count(*), 4) AS last, least(count(*), 4) * (least(count(*), 4) + 1) // 2 AS total FROM orders GROUP BY 1"),
    "row_number_all": (lambda s, d: ops.row_number(t(s, d, "orders").select("o_custkey")).agg(F.count_distinct("row_number").alias("n"), F.min("row_number").cast("long").alias("first"), F.max("row_number").cast("long").alias("last")), "SELECT count(*) AS n, 1::BIGINT AS first, count(*) AS last FROM orders"),
    "unnest_map": (lambda s, d: ops.unnest_map(t(s, d, "events").select("event_id", F.when(C("event_id") % 3 > 0, F.create_map(F.lit("a"), C("user_id"), F.lit("b"), C("event_id"))).alias("m")), "m", "k", "v", "pos", outer=True), "SELECT event_id, CASE WHEN event_id % 3 > 0 THEN k END AS k, CASE WHEN event_id % 3 > 0 THEN CASE k WHEN 'a' THEN user_id ELSE event_id END END AS v, CASE WHEN event_id % 3 > 0 THEN p END::INT AS pos FROM events, (VALUES ('a', 1), ('b', 2)) x(k, p) WHERE event_id % 3 > 0 OR p = 1"),
    "explode_outer": (lambda s, d: ops.generate(t(s, d, "part").select("p_partkey", F.when(C("p_size") > 10, F.split("p_name", " ")).when(C("p_size") > 5, F.array().cast("array<string>")).alias("w")), "w", "word", "pos", outer=True), "SELECT p_partkey, i::INT - 1 AS pos, string_split(p_name, ' ')[i] AS word FROM (SELECT *, unnest(generate_series(1, len(string_split(p_name, ' ')))) AS i FROM part WHERE p_size > 10) UNION ALL SELECT p_partkey, NULL, NULL FROM part WHERE p_size <= 10"),
    "partitioned_output_broadcast": (lambda s, d: ops.replicate(t(s, d, "nation").select("n_nationkey"), 3), "SELECT n_nationkey, p::INT AS partition FROM nation, (VALUES (0), (1), (2)) x(p)"),
    "partitioned_output_nulls_and_any": (lambda s, d: ops.replicate_nulls_and_any(nulls(s, d), ["k"], 4).groupBy(C("k").isNull().alias("none")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("partition").alias("parts")), f"SELECT k IS NULL AS none, CASE WHEN k IS NULL THEN 4 * count(*) ELSE count(*) END AS n, 4::BIGINT AS parts FROM {NULLS} GROUP BY 1, k IS NULL"),
    "batch_inference": (lambda s, d: ops.batch_inference(t(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount"), scores, ["l_quantity", "l_discount"]).withColumn("prediction", F.round("prediction", 7)), "SELECT l_orderkey, l_linenumber, l_quantity, l_discount, round(l_quantity * 0.5 - l_discount * 2 + 1, 7) AS prediction FROM lineitem"),
    "python_aggregate": (lambda s, d: t(s, d, "events").groupBy("event_type").agg(F.round(A.udaf(geometric, "double")(C("value")), 6).alias("g")), "SELECT event_type, round(exp(avg(ln(value))), 6) AS g FROM events GROUP BY 1"),
    "python_window": (lambda s, d: t(s, d, "events").select("event_id", F.round(A.udaf(lambda v: float(v.max() - v.min()), "double")(C("value")).over(Window.partitionBy("user_id")), 6).alias("spread")), "SELECT event_id, round(max(value) OVER (PARTITION BY user_id) - min(value) OVER (PARTITION BY user_id), 6) AS spread FROM events"),
    "try_form": (lambda s, d: t(s, d, "lineitem").select("l_orderkey", "l_linenumber", evaluation.try_(F.call_function("div", C("l_orderkey"), C("l_linenumber") - 3)).alias("q"), evaluation.try_(F.concat(C("l_returnflag"), F.lit("7")).cast("int")).alias("c")), "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber <> 3 THEN l_orderkey // (l_linenumber - 3) END AS q, NULL::INT AS c FROM lineitem"),
    "merge_partial_update_groups": (lambda s, d: ops.merge_partial_update(versions(s, d), ["k"], "seq", ["v", "e", "h"], {"g": ["e"]}), f"SELECT k, arg_max(v, seq) FILTER (WHERE v IS NOT NULL) AS v, arg_max(h, seq) AS h, (list(e ORDER BY g DESC NULLS LAST, seq))[1] AS e, max(g) AS g FROM {VERSIONS} GROUP BY k"),
    "merge_partial_update_aggregate": (lambda s, d: ops.merge_partial_update(versions(s, d).withColumn("w", C("seq")), ["k"], "seq", ["e", "w"], {("h", "g"): ["e", "w"]}, {"w": "sum"}), f"WITH v AS (SELECT *, h * 100 + coalesce(g, -1) AS c FROM {VERSIONS}), r AS (SELECT *, c > coalesce(max(c) OVER (PARTITION BY k ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -99) AS above FROM v) SELECT k, (list(e ORDER BY c DESC, seq))[1] AS e, (sum(seq) FILTER (WHERE above))::BIGINT AS w, (list(h ORDER BY c DESC, seq))[1] AS h, (list(g ORDER BY c DESC, seq))[1] AS g FROM r GROUP BY k"),
    "merge_field_aggregates": (field_aggregates, """SELECT user_id AS k, (sum(event_id) FILTER (WHERE event_id % 4 <> 0))::BIGINT AS s, min(event_id) AS lo, max(event_id) AS hi, product((event_id % 2 + 1)::DOUBLE) AS p, bool_and(value > 1) AS ba, bool_or(value > 90) AS bo, (list(CASE WHEN event_id % 4 <> 0 THEN event_type END ORDER BY event_id DESC))[1] AS lv, (list(CASE WHEN event_id % 4 <> 0 THEN event_type END ORDER BY event_id))[1] AS fv,
        arg_max(event_type, event_id) FILTER (WHERE event_id % 4 <> 0) AS ln, arg_min(event_type, event_id) FILTER (WHERE event_id % 4 <> 0) AS fn, string_agg(event_type, '|' ORDER BY event_id) AS la, string_agg(event_type, ',' ORDER BY event_type) AS co, (SELECT string_agg(x, ',' ORDER BY x) FROM (SELECT DISTINCT event_type AS x FROM events y WHERE y.user_id = events.user_id)) AS cd, user_id AS pk,
        (SELECT string_agg(m, ',' ORDER BY x) FROM (SELECT event_id % 3 AS x, max(event_id) AS m FROM events y WHERE y.user_id = events.user_id GROUP BY 1)) AS nu, (SELECT string_agg(x || '=' || m, ',' ORDER BY x) FROM (SELECT event_id % 3 AS x, max(event_id) AS m FROM events y WHERE y.user_id = events.user_id GROUP BY 1)) AS mm FROM events GROUP BY user_id"""),
    "bucket_column": (buckets, "SELECT o_custkey, 1::BIGINT AS buckets, count(*) AS n, true AS inside FROM orders GROUP BY 1"),
    "dynamic_overwrite": (dynamic_overwrite, "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 0 ELSE o_totalprice END AS o_totalprice FROM orders"),
    "generated_part": (generated("part", 0.1), "SELECT p_partkey, (90000 + p_partkey // 10 % 20001 + 100 * (p_partkey % 1000)) / 100 AS p_retailprice FROM (SELECT unnest(generate_series(1, 20000)) AS p_partkey)"),
    "generated_partsupp": (generated("partsupp", 0.01), "SELECT ps_partkey, (ps_partkey + i * (100 // 4 + (ps_partkey - 1) // 100)) % 100 + 1 AS ps_suppkey FROM (SELECT unnest(generate_series(1, 2000)) AS ps_partkey), (VALUES (0), (1), (2), (3)) x(i)"),
    "generated_orders": (generated("orders", 0.01), "SELECT k // 8 * 32 + k % 8 + 1 AS o_orderkey FROM (SELECT unnest(generate_series(0, 14999)) AS k)"),
    "arrow_table": (arrow_table, "SELECT n_nationkey, n_name FROM nation"),
    "sorted_aggregation": (sorted_once, "SELECT l_orderkey, count(*) AS n, min(l_linenumber) AS first FROM lineitem GROUP BY 1"),
    "agg_histogram_map": (histogram, "SELECT user_id, string_agg(event_type || '=' || n, ',' ORDER BY event_type) AS h FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY 1"),
    "agg_multimap": (multimap, "SELECT event_type, user_id AS u, string_agg(event_id, ',' ORDER BY event_id) AS ids FROM events GROUP BY 1, 2"),
    "agg_map_union": (maps("map_union"), map_sql("max(user_id % 5)")), "agg_map_union_avg": (maps("map_union_avg"), map_sql("round(avg(event_id))::BIGINT")), "agg_map_union_count": (maps("map_union_count"), map_sql("count(CASE WHEN event_id % 6 <> 0 THEN event_id END)")), "agg_map_union_min": (maps("map_union_min"), map_sql("min(event_id)")), "agg_map_sum": (maps("aggregate_map_sum"), map_sql("sum(event_id)::BIGINT")),
    "agg_array_addition": (array_addition, "SELECT label, string_agg(s, ',' ORDER BY p) AS added FROM (SELECT label, p, sum(round(embedding[p]::DOUBLE * 1000)::BIGINT)::BIGINT AS s FROM (SELECT label, embedding, unnest(generate_series(1, len(embedding))) AS p FROM embeddings) GROUP BY label, p) t GROUP BY label"),
    "agg_array_count": (lambda s, d: A.merge_arrays(t(s, d, "embeddings").select("label", F.transform("embedding", lambda x: F.when(x > 0, x)).alias("e")), ["label"], "e", "array_count").select("label", F.array_join("e", ",").alias("e")), "SELECT label, string_agg(n, ',' ORDER BY p) AS e FROM (SELECT label, p, count(CASE WHEN embedding[p] > 0 THEN 1 END) AS n FROM (SELECT label, embedding, unnest(generate_series(1, len(embedding))) AS p FROM embeddings) GROUP BY 1, 2) GROUP BY 1"),
    "agg_entropy_geometric": (lambda s, d: t(s, d, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n")).groupBy("event_type").agg(F.round(A.AGGREGATES["entropy"](C("n")), 6).alias("entropy"), F.round(A.AGGREGATES["geometric_mean"](C("n")), 6).alias("geometric")), "SELECT event_type, round((ln(sum(n)) - sum(n * ln(n)) / sum(n)) / ln(2), 6) AS entropy, round(exp(avg(ln(n))), 6) AS geometric FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY 1"),
    "agg_sketches": (sketches, "SELECT event_type, count(DISTINCT event_id) AS n, round(quantile_cont(value, 0.5), 6) AS median, true AS approx_distinct, true AS cpc, true AS hll, true AS theta, true AS kll, true AS quantiles, true AS req, true AS approx_percentile FROM events GROUP BY 1"),
    "agg_sketch_unions": (sketch_unions, "SELECT event_type, count(*)::BIGINT AS n, true AS h, true AS c, true AS a FROM events GROUP BY 1"),
    "agg_kll_sketches": (kll_sketches, "SELECT event_type, " + ", ".join(f"count(*) AS n_{x}" for x in "bcsilfd") + " FROM events GROUP BY 1"),
    "agg_most_frequent": (top_k, "SELECT string_agg(event_type || '=' || n, ',' ORDER BY n DESC, event_type) AS top, string_agg(event_type || '=' || n, ',' ORDER BY n DESC, event_type) AS fi FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC LIMIT 5)"),
    "agg_bloom_filter": (bloom, "SELECT count(*) AS n FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 480000)"),
    "agg_map_agg": (lambda s, d: t(s, d, "events").groupBy("user_id").agg(text_of_map(A.AGGREGATES["map_agg"](C("event_type"), C("user_id"))).alias("m")), "SELECT user_id, string_agg(DISTINCT event_type || '=' || user_id, ',' ORDER BY event_type || '=' || user_id) AS m FROM events GROUP BY 1"),
    "agg_first_last": (lambda s, d: t(s, d, "events").select("user_id", F.when(C("event_id") % 3 > 0, C("user_id") + 1).alias("x")).groupBy("user_id").agg(*(A.AGGREGATES[n](C("x")).alias(n) for n in ("first_ignore_null", "last_ignore_null", "arbitrary", "any_value"))), "SELECT user_id, user_id + 1 AS first_ignore_null, user_id + 1 AS last_ignore_null, user_id + 1 AS arbitrary, user_id + 1 AS any_value FROM events GROUP BY 1"),
    "agg_first_last_one": (lambda s, d: t(s, d, "events").groupBy("event_id").agg(A.AGGREGATES["first"](C("value")).alias("f"), A.AGGREGATES["last"](C("value")).alias("l")), "SELECT event_id, value AS f, value AS l FROM events"),
    "agg_sets": (lambda s, d: t(s, d, "events").groupBy("event_type").agg(F.array_join(F.sort_array(A.AGGREGATES["set_agg"](C("user_id"))), ",").alias("s"), F.array_join(F.sort_array(A.AGGREGATES["set_union"](F.array(C("user_id") % 7, C("user_id") % 5))), ",").alias("u"), A.AGGREGATES["count_distinct"](C("user_id")).alias("n"), F.size(A.AGGREGATES["array_agg_nulls"](F.when(C("event_id") % 2 == 0, 1))).cast("long").alias("all")), "SELECT event_type, array_to_string(list_sort(list(DISTINCT user_id)), ',') AS s, array_to_string(list_sort(list_distinct(list_concat(list(user_id % 7), list(user_id % 5)))), ',') AS u, count(DISTINCT user_id) AS n, count(*) AS \"all\" FROM events GROUP BY 1"),
    "agg_bit_names": (lambda s, d: t(s, d, "events").groupBy("event_type").agg(*(A.AGGREGATES[f"bitwise_{n}_agg"](C("event_id") + 1).alias(n) for n in ("and", "or", "xor"))), "SELECT event_type, bit_and(event_id + 1) AS \"and\", bit_or(event_id + 1) AS \"or\", bit_xor(event_id + 1) AS \"xor\" FROM events GROUP BY 1"),
    "agg_moments": (lambda s, d: t(s, d, "events").groupBy("event_type").agg(F.round(A.AGGREGATES["skewness"](C("value")), 6).alias("skew"), F.round(A.AGGREGATES["kurtosis"](C("value")), 6).alias("kurt"), F.round(A.AGGREGATES["std"](C("value")), 6).alias("std"), F.round(A.AGGREGATES["variance"](C("value")), 4).alias("var"), F.round(A.AGGREGATES["regr_replacement"](C("value")), 2).alias("rr"), *(F.round(A.AGGREGATES[f"regr_{x}"](C("value"), C("user_id")), 2).alias(x) for x in ("sxx", "syy", "sxy", "avgx", "avgy"))), "SELECT event_type, round(avg(pow(value - m, 3)) / pow(avg(pow(value - m, 2)), 1.5), 6) AS skew, round(avg(pow(value - m, 4)) / pow(avg(pow(value - m, 2)), 2) - 3, 6) AS kurt, round(stddev_pop(value), 6) AS std, round(var_samp(value), 4) AS var, round(var_pop(value) * count(*), 2) AS rr, round(regr_sxx(value, user_id), 2) AS sxx, round(regr_syy(value, user_id), 2) AS syy, round(regr_sxy(value, user_id), 2) AS sxy, round(regr_avgx(value, user_id), 2) AS avgx, round(regr_avgy(value, user_id), 2) AS avgy FROM (SELECT *, avg(value) OVER (PARTITION BY event_type) AS m FROM events) GROUP BY 1"),
    "agg_decimals": (lambda s, d: t(s, d, "lineitem").groupBy("l_returnflag").agg(F.sum(C("l_extendedprice").cast("decimal(12,2)")).cast("double").alias("s"), F.array_join(A.AGGREGATES["max_n"](C("l_extendedprice").cast("decimal(12,2)"), 4), ",").alias("top"), F.array_join(A.AGGREGATES["min_n"](C("l_extendedprice").cast("decimal(12,2)"), 4), ",").alias("low")), "SELECT l_returnflag, sum(l_extendedprice::DECIMAL(12,2))::DOUBLE AS s, array_to_string(list_reverse_sort(list(l_extendedprice::DECIMAL(12,2)))[1:4], ',') AS top, array_to_string(list_sort(list(l_extendedprice::DECIMAL(12,2)))[1:4], ',') AS low FROM lineitem GROUP BY 1"),
    "agg_percentile_frequency": (lambda s, d: t(s, d, "events").groupBy("event_type").agg(F.round(F.percentile("value", F.lit(0.25), C("event_id") % 3 + 1), 6).alias("p")), "SELECT event_type, round(quantile_cont(value, 0.25), 6) AS p FROM events, (VALUES (1), (2), (3)) x(i) WHERE i <= event_id % 3 + 1 GROUP BY 1"),
    "agg_checksum": (lambda s, d: t(s, d, "orders").agg(A.AGGREGATES["checksum"](C("o_orderkey")).alias("a")).crossJoin(t(s, d, "orders").orderBy("o_totalprice").agg(A.AGGREGATES["checksum"](C("o_orderkey")).alias("b"))).select((C("a") == C("b")).alias("same"), (C("a") != 0).alias("some")), "SELECT true AS same, true AS some"),
    "agg_top_values": (lambda s, d: A.top_values(t(s, d, "events"), ["user_id"], "event_id", 3).join(A.top_values(t(s, d, "events"), ["user_id"], "event_type", 2, by="event_id", largest=False, name="low"), "user_id").select("user_id", F.array_join("top", ",").alias("top"), F.array_join("low", ",").alias("low")), "SELECT user_id, array_to_string(list_reverse_sort(list(event_id))[1:3], ',') AS top, array_to_string((list(event_type ORDER BY event_id))[1:2], ',') AS low FROM events GROUP BY 1"),
    "agg_set_union": (lambda s, d: A.set_union(t(s, d, "events").select("event_type", F.array(C("user_id") % 7, C("user_id") % 5 + 3).alias("u")), ["event_type"], "u").select("event_type", F.array_join("u", ",").alias("u")), "SELECT event_type, array_to_string(list_sort(list_distinct(list_concat(list(user_id % 7), list(user_id % 5 + 3)))), ',') AS u FROM events GROUP BY 1"),
    "agg_bit_days_words": (lambda s, d: A.merge_bit_days(t(s, d, "events").select("user_id", F.when(C("event_id") % 3 > 0, F.array(C("event_id") % 8 + 8, C("event_id") % 64 + 64)).otherwise(F.array(C("event_id") % 16 + 16)).alias("w")), ["user_id"], "w").select("user_id", F.array_join("w", ",").alias("w")), "SELECT user_id, CASE WHEN bool_or(event_id % 3 > 0) THEN (8 + (bit_or(event_id % 8) FILTER (WHERE event_id % 3 > 0))) || ',' ELSE '' END || ((CASE WHEN bool_or(event_id % 3 > 0) THEN 64 ELSE 16 END) + bit_or(CASE WHEN event_id % 3 > 0 THEN event_id % 64 ELSE event_id % 16 END)) AS w FROM events GROUP BY 1"),
    "as_of_join_buckets": (lambda s, d: ops.as_of_join(t(s, d, "events").where("event_type = 'click'").select("user_id", "event_id"), t(s, d, "events").where("event_type = 'error'").select("user_id", C("event_id").alias("error_id")), ["user_id"], "event_id", "error_id", ["error_id"], bucket=lambda x: F.floor(x / 100)), "SELECT l.user_id, l.event_id, max(r.event_id) AS error_id FROM (SELECT * FROM events WHERE event_type = 'click') l LEFT JOIN (SELECT * FROM events WHERE event_type = 'error') r ON l.user_id = r.user_id AND r.event_id <= l.event_id GROUP BY 1, 2"),
    "agg_bit_days": (lambda s, d: t(s, d, "events").groupBy("event_type").agg(F.array_join(A.AGGREGATES["bit_days_or"](F.array(C("event_id") % 64 + 64)), ",").alias("w")), "SELECT event_type, (64 + bit_or(event_id % 64))::VARCHAR AS w FROM events GROUP BY 1"),
    "agg_empty_input": (lambda s, d: t(s, d, "events").where("event_id < 0").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("s"), F.size(A.AGGREGATES["set_agg"](C("user_id"))).cast("long").alias("k"), A.AGGREGATES["entropy"](C("user_id")).alias("e")), "SELECT 0::BIGINT AS n, NULL::DOUBLE AS s, 0::BIGINT AS k, 0::DOUBLE AS e"),
}


_OPTIONAL = "(SELECT event_id, user_id, CASE WHEN event_id % 3 > 0 THEN value END AS v, CASE WHEN event_id % 5 > 0 THEN event_id % 5 END AS n FROM events)"
#: name -> (Spark text, DuckDB text)
SQL: dict[str, tuple[str, str]] = {
    "window_ignore_nulls": (
        f"SELECT event_id, lag(v) IGNORE NULLS OVER w AS lg, lead(v, 2) IGNORE NULLS OVER w AS ld, first_value(v) IGNORE NULLS OVER w AS fv, last_value(v) IGNORE NULLS OVER w AS lv, nth_value(v, 2) IGNORE NULLS OVER w AS nv FROM {_OPTIONAL} t WINDOW w AS (PARTITION BY user_id ORDER BY event_id)",
        f"SELECT event_id, lag(v IGNORE NULLS) OVER w AS lg, lead(v, 2 IGNORE NULLS) OVER w AS ld, first_value(v IGNORE NULLS) OVER w AS fv, last_value(v IGNORE NULLS) OVER w AS lv, nth_value(v, 2 IGNORE NULLS) OVER w AS nv FROM {_OPTIONAL} t WINDOW w AS (PARTITION BY user_id ORDER BY event_id)",
    ),
    "window_column_offset": (
        f"SELECT event_id, get(all_values, CAST(row_number - 1 - n AS INT)) AS lg FROM (SELECT event_id, n, row_number() OVER w AS row_number, collect_list(struct(value)) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING).value AS all_values FROM (SELECT e.*, CASE WHEN event_id % 5 > 0 THEN event_id % 5 END AS n FROM events e) t WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) u",
        f"SELECT a.event_id, b.value AS lg FROM (SELECT event_id, user_id, CASE WHEN event_id % 5 > 0 THEN event_id % 5 END AS n, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events) a LEFT JOIN (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events) b ON a.user_id = b.user_id AND b.r = a.r - a.n",
    ),
    "window_range_frames": (
        "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY event_id RANGE BETWEEN 200 PRECEDING AND 100 PRECEDING) AS a, round(sum(value) OVER (PARTITION BY user_id ORDER BY event_id RANGE BETWEEN CURRENT ROW AND 300 FOLLOWING), 4) AS b, min(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 FOLLOWING AND UNBOUNDED FOLLOWING) AS c FROM events",
    ) * 2,
    "special_forms": (
        "SELECT event_id, (value > 10 AND user_id < 50) OR event_type = 'click' AS ao, CASE WHEN event_id % 3 = 0 THEN 'three' WHEN event_id % 5 = 0 THEN 'five' END AS sw, coalesce(CASE WHEN event_id % 2 = 0 THEN value END, -1) AS co, CAST(CAST(event_id AS STRING) AS BIGINT) AS ca, TRY_CAST(event_type AS INT) AS tc FROM events",
        "SELECT event_id, (value > 10 AND user_id < 50) OR event_type = 'click' AS ao, CASE WHEN event_id % 3 = 0 THEN 'three' WHEN event_id % 5 = 0 THEN 'five' END AS sw, coalesce(CASE WHEN event_id % 2 = 0 THEN value END, -1) AS co, event_id AS ca, NULL::INT AS tc FROM events",
    ),
}
