"""Aggregates by name: ``AGGREGATES[name](*columns)`` gives an aggregate Column for agg() or over().

Aggregates of whole maps and arrays need a row per entry: ``merge_maps`` and ``merge_arrays`` are
DataFrame operators that explode, aggregate (partially, before the shuffle) and collect again.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.evaluation import bloom_filter_aggregate
from tessera.functions.spark import let


def builtin(name: str) -> Callable[..., Column]:
    return lambda *a: F.call_function(name, *a)


def keep_nulls(x: Column) -> Column:
    """All values, nulls too."""
    return F.transform(F.collect_list(F.struct(x.alias("v"))), lambda s: s["v"])


def entropy(c: Column) -> Column:
    """Of counts, in bits; 0 for none."""
    total = F.sum(c)
    return F.when(F.coalesce(total, F.lit(0)) == 0, 0.0).otherwise(F.greatest((F.ln(total) - F.sum(F.when(c > 0, c * F.ln(c)).otherwise(0.0)) / total) / F.ln(F.lit(2.0)), F.lit(0.0)))


def sample_kurtosis(x: Column) -> Column:
    """Excess kurtosis with the sample correction; null under four rows."""
    n = F.count(x)
    return F.when(n >= 4, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(x) + 6))


def first_n(x: Column, n: int, largest: bool) -> Column:
    return F.slice(F.sort_array(F.collect_list(x), asc=not largest), 1, n)


def first_n_by(x: Column, by: Column, n: int, largest: bool) -> Column:
    return F.transform(F.slice(F.sort_array(F.collect_list(F.struct(by.alias("b"), x.alias("v"))), asc=not largest), 1, n), lambda s: s["v"])


def bit_days_or(a: Column) -> Column:
    """Union of right-aligned activity words: the larger word keeps its marker, the smaller one loses it."""

    def marker(x: Column) -> Column:
        return F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("bigint"), F.length(F.bin(x)) - 1)).otherwise(F.lit(0).cast("bigint"))

    def word(x: Column, y: Column) -> Column:
        high, low = F.greatest(x, y), F.least(x, y)
        return high.bitwiseOR(low.bitwiseAND(F.bitwise_not(marker(low))))

    def merge(x: Column, y: Column) -> Column:
        both = F.reverse(F.zip_with(F.reverse(x), F.reverse(y), lambda p, q: F.when(p.isNull(), q).when(q.isNull(), p).otherwise(word(p, q))))
        return both

    return F.aggregate(F.collect_list(a), F.array().cast("array<bigint>"), merge)


def map_agg(k: Column, v: Column) -> Column:
    """Map of key to the value that came first with it; null keys are skipped."""
    rows = F.array_sort(F.transform(F.collect_list(F.when(k.isNotNull(), F.struct(k.alias("k"), v.alias("v")))), lambda e, i: F.struct(e["k"].alias("k"), i.alias("i"), e["v"].alias("v"))))
    return let(rows, lambda r: F.map_from_entries(F.transform(F.filter(r, lambda e, i: (i == 0) | (e["k"] != F.get(r, i - 1)["k"])), lambda e: F.struct(e["k"], e["v"]))))


def udaf(f: Callable, kind: str) -> Callable[..., Column]:
    """An aggregate of a Python function from pandas Series to a value; for agg() and, over bounded or unbounded windows, over()."""

    def build(*columns: Column) -> Column:
        import pandas as pd

        def run(*series: pd.Series):
            return f(*series)

        run.__annotations__ = {}
        return F.pandas_udf(run, kind, F.PandasUDFType.GROUPED_AGG)(*columns)

    return build


def quantile_sketch(x: Column, p: float) -> Column:
    """Quantile from a KLL sketch of doubles."""
    return F.call_function("kll_sketch_get_quantile_double", F.call_function("kll_sketch_agg_double", x.cast("double")), F.lit(p))


def checksum(x: Column) -> Column:
    """Independent of order and sensitive to repeats."""
    return F.sum(F.xxhash64(x).cast("decimal(38,0)"))


AGGREGATES: dict[str, Callable[..., Column]] = {
    n: builtin(n)
    for n in "avg count sum min max min_by max_by any_value bit_and bit_or bit_xor bool_and bool_or every corr covar_pop covar_samp count_if kurtosis skewness percentile percentile_approx approx_percentile regr_avgx regr_avgy regr_count regr_intercept regr_r2 regr_slope regr_sxx regr_sxy regr_syy stddev stddev_pop stddev_samp var_pop var_samp variance collect_list collect_set array_agg first last hll_sketch_agg hll_union_agg theta_sketch_agg kll_sketch_agg_bigint kll_sketch_agg_double approx_count_distinct".split()
} | {
    "approx_distinct": lambda x, e=0.023: F.approx_count_distinct(x, e), "approx_set": F.hll_sketch_agg, "merge": F.hll_union_agg, "cardinality": F.hll_sketch_estimate, "approx_most_frequent": lambda k, x: F.call_function("approx_top_k", x, F.lit(k)),
    **dict.fromkeys(("arbitrary", "any_value"), lambda x: F.any_value(x, True)), "array_agg_nulls": keep_nulls, "bitwise_and_agg": F.bit_and, "bitwise_or_agg": F.bit_or, "bitwise_xor_agg": F.bit_xor, "bit_days_or": bit_days_or, "checksum": checksum, "entropy": entropy, "geometric_mean": lambda x: F.exp(F.avg(F.ln(x))),
    "presto_kurtosis": sample_kurtosis, "std": F.stddev_pop, "max_n": lambda x, n: first_n(x, n, True), "min_n": lambda x, n: first_n(x, n, False), "max_by_n": lambda x, by, n: first_n_by(x, by, n, True), "min_by_n": lambda x, by, n: first_n_by(x, by, n, False),
    "map_agg": map_agg, "reduce_agg": lambda x, init, f, g=None: F.aggregate(F.collect_list(x), init, f) if g is None else F.aggregate(F.collect_list(x), init, f, g),
    "set_agg": F.collect_set, "set_union": lambda a: F.array_distinct(F.flatten(F.collect_list(a))), "max_data_size_for_stats": lambda x: F.max(F.octet_length(x)), "sum_data_size_for_stats": lambda x: F.sum(F.octet_length(x)),
    **dict.fromkeys(("cpc", "hll"), lambda x, k=12: F.hll_sketch_estimate(F.hll_sketch_agg(x, k))), **dict.fromkeys(("cpc_sketch", "hll_sketch"), lambda x, k=12: F.hll_sketch_agg(x, k)), "hll_union_sketches": lambda x: F.hll_union_agg(x), "theta": lambda x: F.call_function("theta_sketch_estimate", F.call_function("theta_sketch_agg", x)),
    "fi": lambda x, k=10: F.call_function("approx_top_k", x, F.lit(k)), "kll": quantile_sketch, **dict.fromkeys(("quantiles", "req"), lambda x, p, accuracy=100_000: F.percentile_approx(x, p, accuracy)),
    **{f"kll_sketch_{t}": builtin("kll_sketch_agg_bigint") for t in "bsil"}, **{f"kll_sketch_{t}": lambda x: F.call_function("kll_sketch_agg_double", x.cast("double")) for t in "fd"}, "kll_sketch_c": lambda x: F.call_function("kll_sketch_agg_bigint", F.ascii(x).cast("bigint")),
    "bloom_filter_agg": bloom_filter_aggregate,
    "first_ignore_null": lambda x: F.first(x, ignorenulls=True), "last_ignore_null": lambda x: F.last(x, ignorenulls=True), "regr_replacement": lambda x: F.var_pop(x) * F.count(x), "count_distinct": F.count_distinct,
}


def histogram(df: DataFrame, keys: Sequence[str], x: str, name: str = "histogram") -> DataFrame:
    """map(value, count) per key; counts are combined before anything is collected."""
    return df.where(F.col(x).isNotNull()).groupBy(*keys, x).agg(F.count(F.lit(1)).alias("__n")).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(x, "__n"))).alias(name))


def multimap(df: DataFrame, keys: Sequence[str], k: str, v: str, name: str = "multimap") -> DataFrame:
    return df.groupBy(*keys, k).agg(F.collect_list(v).alias("__v")).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(k, "__v"))).alias(name))


#: map_union keeps some value of a key; the others combine its values.
MAP_MERGES: dict[str, Callable[[str], Column]] = {"map_union": F.any_value, "map_union_sum": F.sum, "map_union_avg": F.avg, "map_union_count": F.count, "map_union_min": F.min, "map_union_max": F.max, "aggregate_map_sum": F.sum}


def merge_maps(df: DataFrame, keys: Sequence[str], column: str, how: str) -> DataFrame:
    entries = df.select(*keys, F.explode(column).alias("__k", "__v")).groupBy(*keys, "__k").agg(MAP_MERGES[how]("__v").alias("__v"))
    return entries.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("__k", "__v"))).alias(column))


def top_values(df: DataFrame, keys: Sequence[str], x: str, n: int, by: str | None = None, largest: bool = True, name: str = "top") -> DataFrame:
    """max_n, min_n, max_by_n and min_by_n of large groups: each task keeps n rows of a group before the shuffle."""
    order = F.col(by or x)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(order.desc() if largest else order.asc()))
    few = df.where(order.isNotNull()).select(*keys, x, rank.alias("__r")).where(F.col("__r") <= n)
    return few.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("__r", F.col(x).alias("v")))), lambda s: s["v"]).alias(name))


def quantile(df: DataFrame, keys: Sequence[str], x: str, p: float, name: str = "quantile") -> DataFrame:
    """Exact quantile of few, large groups, interpolated where it falls between two values (percentile, quantile_cont).

    A sketch brackets it, and only the values of the part of a group that holds its rank are put in order, each with its count;
    a poor bracket takes longer and changes nothing in the result. Groups without a value are left out.
    """
    same = lambda other: reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"{other}{k}")) for k in keys))
    named = lambda g, other: F.broadcast(g.select(*(F.col(k).alias(f"{other}{k}") for k in keys), *(c for c in g.columns if c not in keys)))  # noqa: E731  a row per group
    rows = df.where(F.col(x).isNotNull()).select(*keys, F.col(x).cast("double").alias("__x"))
    ends = rows.groupBy(*keys).agg(F.percentile_approx("__x", [max(p - 0.001, 0.0), min(p + 0.001, 1.0)], 10_000).alias("__ends"))
    part = F.when(F.col("__x") < F.col("__ends")[0], 0).when(F.col("__x") <= F.col("__ends")[1], 1).otherwise(2)
    placed = rows.join(named(ends, "__a"), same("__a")).select(*keys, "__x", part.alias("__part"))
    sizes = placed.groupBy(*keys).agg(F.count_if(F.col("__part") == 0).alias("__n0"), F.count_if(F.col("__part") <= 1).alias("__n1"), ((F.count(F.lit(1)) - 1) * F.lit(float(p))).alias("__at"))
    holds = lambda rank: F.when(rank < F.col("__n0"), 0).when(rank < F.col("__n1"), 1).otherwise(2)
    ranks = sizes.withColumns({"__low": F.floor("__at"), "__high": F.ceil("__at")}).withColumns({"__first": holds(F.col("__low")), "__last": holds(F.col("__high"))})
    ranks = ranks.withColumn("__before", F.when(F.col("__first") == 0, F.lit(0)).when(F.col("__first") == 1, F.col("__n0")).otherwise(F.col("__n1")))
    held = placed.join(named(ranks, "__b"), same("__b") & F.col("__part").between(F.col("__first"), F.col("__last")))
    counted = held.groupBy(*keys, "__x").agg(F.count(F.lit(1)).alias("__n"), *(F.any_value(c).alias(c) for c in ("__before", "__low", "__high", "__at")))
    passed = F.col("__before") + F.sum("__n").over(Window.partitionBy(*keys).orderBy("__x").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    around = counted.withColumn("__passed", passed).groupBy(*keys).agg(F.min(F.when(F.col("__passed") > F.col("__low"), F.col("__x"))).alias("__l"), F.min(F.when(F.col("__passed") > F.col("__high"), F.col("__x"))).alias("__h"), F.any_value(F.col("__at") - F.col("__low")).alias("__f"))
    return around.select(*keys, F.when(F.col("__l") == F.col("__h"), F.col("__l")).otherwise((1 - F.col("__f")) * F.col("__l") + F.col("__f") * F.col("__h")).alias(name))


def set_union(df: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """The different elements of a group's arrays, in order: equal ones are dropped before anything is collected."""
    return df.select(*keys, F.explode(column).alias("__e")).distinct().groupBy(*keys).agg(F.sort_array(F.collect_list("__e")).alias(column))


def merge_bit_days(df: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """bit_days_or of large groups: words are aligned at the right; of each place the largest marker and the union of the bits below the markers, both partially aggregated."""
    word = F.col("__v")
    marker = F.when(word > 0, F.call_function("shiftleft", F.lit(1).cast("bigint"), F.length(F.bin(word)) - 1)).otherwise(F.lit(0).cast("bigint"))
    places = df.select(*keys, F.posexplode(F.reverse(column)).alias("__p", "__v")).groupBy(*keys, "__p").agg(F.max(marker).bitwiseOR(F.bit_or(word.bitwiseAND(F.bitwise_not(marker)))).alias("__v"))
    return places.groupBy(*keys).agg(F.reverse(F.transform(F.array_sort(F.collect_list(F.struct("__p", "__v"))), lambda s: s["__v"])).alias(column))


def merge_arrays(df: DataFrame, keys: Sequence[str], column: str, how: str = "array_addition") -> DataFrame:
    """Element-wise sums (array_addition) or non-null counts (array_count); a position without values is null or 0."""
    value = {"array_addition": F.sum, "array_count": F.count}[how]("__v")
    places = df.select(*keys, F.posexplode(column).alias("__p", "__v")).groupBy(*keys, "__p").agg(value.alias("__v"))
    return places.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("__p", "__v"))), lambda s: s["__v"]).alias(column))


def weighted_reservoir(df: DataFrame, weight: str, k: int, seed: int = 0) -> DataFrame:
    """k rows without replacement, with chances by weight: a top-k of exponential keys."""
    return df.where(F.col(weight) > 0).withColumn("__key", -F.log(F.rand(seed)) / F.col(weight)).orderBy("__key").limit(k).drop("__key")
