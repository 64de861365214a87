"""Relational operators that are more than one DataFrame call. All take and return DataFrames lazily."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.spark import let


def group_id(df: DataFrame, sets: Sequence[Sequence[str]], keys: Sequence[str], name: str = "group_id") -> DataFrame:
    """Each row once per grouping set, with keys outside the set nulled and the set's index: one Expand, no union."""
    variants = F.array(*(F.struct(*((F.col(k) if k in s else F.lit(None).cast(df.schema[k].dataType)).alias(k) for k in keys), F.lit(i).cast("long").alias(name)) for i, s in enumerate(sets)))
    rest = [c for c in df.columns if c not in keys]
    return df.select(*rest, F.inline(variants))


def expand(df: DataFrame, projections: Sequence[Sequence[Column]], names: Sequence[str]) -> DataFrame:
    """Each row once per projection."""
    return df.select(F.inline(F.array(*(F.struct(*(c.alias(n) for c, n in zip(p, names, strict=True))) for p in projections))))


def mark_distinct(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "is_first") -> DataFrame:
    """A boolean that is true for the first row, by order, of each key combination."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) == 1)


def semi_project(left: DataFrame, right: DataFrame, on: Sequence[str], name: str = "matched") -> DataFrame:
    """All rows of left with a match flag; right may repeat keys."""
    keys = right.select(*(F.col(k).alias(f"__{k}") for k in on)).distinct().withColumn("__hit", F.lit(True))
    joined = left.join(keys, reduce(lambda a, b: a & b, (F.col(k) == F.col(f"__{k}") for k in on)), "left")
    return joined.select(*left.columns, F.coalesce("__hit", F.lit(False)).alias(name))


def null_aware_semi_project(left: DataFrame, right: DataFrame, left_key: str, right_key: str, name: str = "matched") -> DataFrame:
    """IN as a column: true for a match; null where left's key is null or right holds a null key, unless right is empty; else false."""
    state = right.agg(F.count(F.lit(1)).alias("__n"), F.count_if(F.col(right_key).isNull()).alias("__nulls"))  # one row
    keys = right.select(F.col(right_key).alias("__key")).where("__key is not null").distinct().withColumn("__hit", F.lit(True))
    joined = left.join(keys, F.col(left_key) == F.col("__key"), "left").join(F.broadcast(state))
    known = F.when(F.col("__n") == 0, F.lit(False)).when(F.col("__hit"), F.lit(True)).when(F.col(left_key).isNotNull() & (F.col("__nulls") == 0), F.lit(False))
    return joined.select(*left.columns, known.alias(name))


def nested_loop_join(left: DataFrame, right: DataFrame, on: Column | None = None, how: str = "inner", most_bytes: int = 64 << 20) -> DataFrame:
    """A join without an equality: cross, inner, left, right, full, left_semi or left_anti, with any condition or none.

    The right side is broadcast if its estimated size is at most most_bytes; a larger one is left to Spark, which
    then compares partitions pair by pair.
    """
    small = int(str(right._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= most_bytes
    right = F.broadcast(right) if small and how not in ("right", "full") else right
    if on is None:
        return left.crossJoin(right) if how in ("cross", "inner") else left.join(right, F.lit(True), how)
    return left.join(right, on, how)


def null_aware_anti(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """NOT IN: nothing if right holds a null key; left rows with a null key only if right is empty."""
    state = right.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(right_key).isNull()).alias("nulls"))  # one row
    kept = left.join(right.select(F.col(right_key).alias("__key")), F.col(left_key) == F.col("__key"), "left_anti")
    return kept.join(F.broadcast(state), (F.col("n") == 0) | ((F.col("nulls") == 0) & F.col(left_key).isNotNull()), "left_semi")


def index_lookup_join(probe: DataFrame, lookup: DataFrame, on: Column, how: str = "inner", small: bool = False, unique: Sequence[str] = (), conditions: Sequence[Column] = ()) -> DataFrame:
    """Inner or left join with a lookup table; small states that its size has been checked for broadcasting.

    unique: key columns of which a repetition is an error; conditions: further ones on the pairs (between, in a list).
    """
    if how not in ("inner", "left"):
        raise ValueError("an index lookup is an inner or a left join")
    if unique:
        rest = [c for c in lookup.columns if c not in unique]
        one = lookup.groupBy(*unique).agg(F.count(F.lit(1)).alias("__n"), F.first(F.struct(F.lit(1).alias("__one"), *rest)).alias("__row"))
        checked = F.when(F.col("__n") > 1, F.raise_error(F.lit("a key of the lookup table is repeated")).cast("boolean")).otherwise(F.lit(True))
        lookup = one.where(checked).select(*unique, *(F.col("__row")[c].alias(c) for c in rest)).select(*lookup.columns)
    return probe.join(F.broadcast(lookup) if small else lookup, reduce(lambda a, b: a & b, conditions, on), how)


def row_number(df: DataFrame, keys: Sequence[str] = (), limit: int | None = None, name: str = "row_number") -> DataFrame:
    """Rows numbered in each key in any order, at most limit of them; without keys a number over all rows, from the sizes of partitions."""
    if keys:
        out = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(F.lit(1))))
        return out if limit is None else out.where(F.col(name) <= limit)
    df = df if limit is None else df.limit(limit)
    if limit is not None:
        return df.withColumn(name, F.monotonically_increasing_id().cast("int") + 1)  # a limit leaves one partition
    placed = df.withColumns({"__part": F.spark_partition_id(), "__id": F.monotonically_increasing_id()})
    sizes = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"), F.min("__id").alias("__first"))  # a row per partition
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select(F.col("__part").alias("__p"), "__first", before.alias("__before"))
    return placed.join(F.broadcast(starts), F.col("__part") == F.col("__p")).select(*df.columns, (F.col("__before") + F.col("__id") - F.col("__first") + 1).cast("int").alias(name))


def as_of_join(left: DataFrame, right: DataFrame, by: Sequence[str], left_time: str, right_time: str, values: Sequence[str], bucket: Callable[[Column], Column] | None = None) -> DataFrame:
    """left with values of the latest row of right at or before left_time: one union and one window, no range join.

    bucket: a rising function of time (such as ``lambda t: F.floor(t / 1000)``) by which the rows of a hot key are dealt over
    tasks; each bucket also gets the last row of right before it, found among one row for each bucket of a key.
    """
    pack = F.struct(*values)
    kind = right.select(pack.alias("p")).schema["p"].dataType
    a = left.select(*by, F.col(left_time).alias("__t"), F.lit(1).alias("__side"), F.struct(*left.columns).alias("__row"), F.lit(None).cast(kind).alias("__v"))
    b = right.select(*by, F.col(right_time).alias("__t"), F.lit(0).alias("__side"), F.lit(None).cast(a.schema["__row"].dataType).alias("__row"), pack.alias("__v"))
    both, keys = a.unionByName(b), list(by)
    if bucket is not None:
        both, keys = both.withColumn("__b", bucket(F.col("__t"))), [*by, "__b"]
        last = both.groupBy(*keys).agg(F.max_by(F.struct("__t", "__v"), F.when(F.col("__side") == 0, F.struct("__t", "__v"))).alias("__l"))
        before = F.last("__l", ignorenulls=True).over(Window.partitionBy(*by).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1))
        carried = last.withColumn("__l", before).where("__l is not null").select(*by, F.col("__l.__t").alias("__t"), F.lit(0).alias("__side"), F.lit(None).cast(a.schema["__row"].dataType).alias("__row"), F.col("__l.__v").alias("__v"), "__b")
        both = both.unionByName(carried)
    w = Window.partitionBy(*keys).orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = both.withColumn("__last", F.last("__v", ignorenulls=True).over(w)).where("__side = 1")
    return out.select("__row.*", *(F.col("__last")[v].alias(v) for v in values))


def top_n_row_number(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, name: str = "row_number") -> DataFrame:
    """The first n rows of each key with their number; Catalyst limits groups before the shuffle."""
    if n <= 0:
        raise ValueError("n must be positive")
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= n)


def enforce_single_row(df: DataFrame) -> DataFrame:
    """The only row of df; a row of nulls if there is none; an error if there are more."""
    few = df.limit(2).agg(F.count(F.lit(1)).alias("__n"), *(F.first(F.col(c)).alias(c) for c in df.columns))
    return few.select(*(F.when(F.col("__n") > 1, F.raise_error(F.lit("more than one row")).cast(df.schema[c].dataType)).otherwise(F.col(c)).alias(c) for c in df.columns))


def assign_unique_id(df: DataFrame, name: str = "unique_id") -> DataFrame:
    return df.withColumn(name, F.monotonically_increasing_id())


def unnest(df: DataFrame, columns: Sequence[str], ordinality: str | None = None, base: int = 1) -> DataFrame:
    """Arrays to rows side by side, shorter ones padded with nulls; optionally their position."""
    rest = [c for c in df.columns if c not in columns]
    zipped = F.arrays_zip(*(F.coalesce(F.col(c), F.array().cast(df.schema[c].dataType)) for c in columns))
    out = df.select(*rest, F.posexplode(zipped).alias("__pos", "__e"))
    fields = out.schema["__e"].dataType.names
    pos = [(F.col("__pos") + base).alias(ordinality)] if ordinality else []
    return out.select(*rest, *(F.col("__e")[f].alias(c) for f, c in zip(fields, columns, strict=True)), *pos)


def unnest_map(df: DataFrame, column: str, key: str = "key", value: str = "value", ordinality: str | None = None, base: int = 1, outer: bool = False) -> DataFrame:
    """A map to rows of key and value; outer keeps rows whose map is null or empty."""
    rest = [c for c in df.columns if c != column]
    out = df.select(*rest, (F.posexplode_outer if outer else F.posexplode)(F.map_entries(column)).alias("__pos", "__e"))
    pos = [(F.col("__pos") + base).alias(ordinality)] if ordinality else []
    return out.select(*rest, F.col("__e")["key"].alias(key), F.col("__e")["value"].alias(value), *pos)


def generate(df: DataFrame, column: str, name: str = "col", position: str | None = None, outer: bool = False) -> DataFrame:
    """Explode an array, with positions from 0 if named; outer keeps rows whose array is null or empty."""
    rest = [c for c in df.columns if c != column]
    return df.select(*rest, (F.posexplode_outer if outer else F.posexplode)(column).alias(position or "__pos", name)).drop("__pos")


def local_shuffle(df: DataFrame, seed: int) -> DataFrame:
    return df.orderBy(F.rand(seed))


def local_merge(parts: Sequence[DataFrame], order: Sequence[Column]) -> DataFrame:
    """Ordered union: range-partitioned and sorted within partitions."""
    return reduce(DataFrame.unionByName, parts).orderBy(*order)


def salted_aggregate(df: DataFrame, keys: Sequence[str], partial: dict[str, Column], final: dict[str, Column], salts: int = 32) -> DataFrame:
    """Two-level aggregation for hot keys whose aggregates do not combine on the map side."""
    # of the row, so that a lost task computes the same salts again
    salt = F.pmod(F.xxhash64(*(F.col(f"`{c}`") for c in df.columns), F.monotonically_increasing_id()), F.lit(salts))
    first = df.withColumn("__salt", salt).groupBy(*keys, "__salt").agg(*(c.alias(n) for n, c in partial.items()))
    return first.groupBy(*keys).agg(*(c.alias(n) for n, c in final.items()))


def python_operator(df: DataFrame, function: Callable, schema: str) -> DataFrame:
    """A function from Arrow batches to Arrow batches (or of models: load once per task inside it)."""
    return df.mapInArrow(function, schema)


def batch_inference(df: DataFrame, load: Callable[[], Callable], columns: Sequence[str], name: str = "prediction", kind: str = "double") -> DataFrame:
    """df with a model's output for its columns: load() runs once a task and gives a function from a matrix of a batch to a vector."""
    import numpy as np
    import pyarrow as pa

    names = df.columns
    places = [names.index(c) for c in columns]

    def run(batches):
        predict = load()
        for b in batches:
            x = np.column_stack([b.column(k).to_numpy(zero_copy_only=False).astype(np.float64) for k in places]) if b.num_rows else np.empty((0, len(places)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(predict(x))], [*names, name])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(run, f"{schema}, `{name}` {kind}")


def replicate(df: DataFrame, n: int, partition: str = "partition") -> DataFrame:
    """Every row in each of n partitions: a broadcast output."""
    return df.withColumn(partition, F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).repartitionByRange(n, partition)


def replicate_nulls_and_any(df: DataFrame, keys: Sequence[str], n: int, partition: str = "partition") -> DataFrame:
    """Rows dealt over n partitions by keys; those with a null key, and one other row, go to all partitions, so that each can tell whether there is any and whether there is a null."""
    id_ = F.monotonically_increasing_id()
    numbered = df.withColumns({"__id": id_, "__null": reduce(lambda a, b: a | b, (F.col(k).isNull() for k in keys))})
    some = numbered.agg(F.min("__id").alias("__any"))  # one row
    everywhere = F.col("__null") | (F.col("__id") == F.col("__any"))
    targets = F.when(everywhere, F.sequence(F.lit(0), F.lit(n - 1))).otherwise(F.array(F.pmod(F.hash(*keys), F.lit(n))))
    return numbered.join(F.broadcast(some)).withColumn(partition, F.explode(targets)).drop("__id", "__null", "__any").repartitionByRange(n, partition)


#: Rows that a task gets on average where a whole table is dealt out.
ROWS = 1_000_000


def parts(df: DataFrame, least: int, rows: int = ROWS) -> int:
    """Partitions to deal df over: least, and more for a table of more than least * rows rows, so that a task's share does not grow with
    the input. Counts df's rows, which takes only the footers of a Parquet scan without filters."""
    return max(least, -(-df.count() // rows))


def partition_by_hash(df: DataFrame, n: int, keys: Sequence[str]) -> DataFrame:
    return df.repartition(n, *keys)


def partition_round_robin(df: DataFrame, n: int) -> DataFrame:
    return df.repartition(n)


def partition_by_range(df: DataFrame, n: int, keys: Sequence[str]) -> DataFrame:
    return df.repartitionByRange(n, *keys)


def gather(df: DataFrame) -> DataFrame:
    """One partition: only for results that are small by construction."""
    return df.coalesce(1)


def streaming_aggregate(df: DataFrame, keys: Sequence[str], **aggregates: Column) -> DataFrame:
    """Aggregation of input grouped by keys already: a partitioning and sort on keys are kept and not repeated."""
    return df.groupBy(*keys).agg(*(c.alias(n) for n, c in aggregates.items()))


def record(df: DataFrame, path: str) -> DataFrame:
    """df's rows written at path and read again: what an operator took in, to be replayed."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def write_with_statistics(df: DataFrame, path: str, fmt: str = "parquet", **statistics: Column) -> dict:
    """Write df and return its row count and other aggregates, gathered in the same pass."""
    from pyspark.sql import Observation

    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows"), *(c.alias(n) for n, c in statistics.items())).write.format(fmt).mode("overwrite").save(path)
    return seen.get


# --- merge on read -------------------------------------------------------------------------------
RETRACT = ("-U", "-D")


def merge_deduplicate(df: DataFrame, key: Sequence[str], sequence: str, kind: str, ignore_delete: bool = False) -> DataFrame:
    """The last row of each primary key; keys whose last row is a retraction go."""
    rows = df.where(~F.col(kind).isin(*RETRACT)) if ignore_delete else df
    last = rows.groupBy(*key).agg(F.max_by(F.struct(*[c for c in df.columns if c not in key]), F.col(sequence)).alias("__last"))
    return last.where(~F.col("__last")[kind].isin(*RETRACT)).select(*key, "__last.*")


def merge_first_row(df: DataFrame, key: Sequence[str], sequence: str) -> DataFrame:
    return df.groupBy(*key).agg(F.min_by(F.struct(*[c for c in df.columns if c not in key]), F.col(sequence)).alias("__first")).select(*key, "__first.*")


def merge_partial_update(df: DataFrame, key: Sequence[str], sequence: str, columns: Sequence[str], groups: dict[str | tuple[str, ...], Sequence[str]] | None = None, aggregates: dict[str, str] | None = None) -> DataFrame:
    """Per column the last non-null value. Columns of a sequence group (by one or more key columns) come together, nulls too, from
    the row with the largest group key, nulls lowest, of several such rows from the first.

    aggregates: columns of groups with a field aggregate over the rows whose group key is above all before them.
    """
    groups = {(g,) if isinstance(g, str) else tuple(g): list(cs) for g, cs in (groups or {}).items()}
    of = {c: g for g, cs in groups.items() for c in cs}
    above = {g: F.struct(F.struct(*g), -F.col(sequence)) for g in groups}
    aggregates = aggregates or {}
    for k, g in enumerate(groups):
        if any(of.get(c) == g for c in aggregates):
            before = F.max(F.struct(*g)).over(Window.partitionBy(*key).orderBy(sequence).rowsBetween(Window.unboundedPreceding, -1))
            df = df.withColumn(f"__above{k}", before).withColumn(f"__above{k}", F.col(f"__above{k}").isNull() | (F.struct(*g) > F.col(f"__above{k}")))

    def pick(c: str) -> Column:
        if c in aggregates:
            k = list(groups).index(of[c])
            return FIELD_AGGREGATES[aggregates[c]](F.when(F.col(f"__above{k}"), F.col(c)), F.col(sequence))
        if c in of:
            return F.max_by(F.struct(F.col(c).alias("v")), above[of[c]])["v"]
        return F.max_by(c, F.when(F.col(c).isNotNull(), F.col(sequence)))

    keys = [F.max_by(F.struct(F.col(x).alias("v")), above[g])["v"].alias(x) for g in groups for x in g if x not in columns]
    return df.groupBy(*key).agg(*(pick(c).alias(c) for c in columns), *keys)


def listagg(delimiter: str) -> Callable[[Column, Column], Column]:
    return lambda c, s: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(c.isNotNull(), F.struct(s.alias("s"), c.alias("v"))))), lambda x: x["v"]), delimiter)


def in_sequence(c: Column, s: Column) -> Column:
    """Non-null values in order of the sequence."""
    earlier = lambda a, b: F.when(a["s"] < b["s"], -1).when(a["s"] > b["s"], 1).otherwise(0)  # noqa: E731  values need no order
    return F.transform(F.array_sort(F.collect_list(F.when(c.isNotNull(), F.struct(s.alias("s"), c.alias("v")))), earlier), lambda x: x["v"])


def last_by(entries: Column, of: Callable[[Column], Column]) -> Column:
    """Of an array's elements the last of each key, in order of the keys: one sort, then the ends of runs."""
    ends = lambda rows: F.filter(rows, lambda x, i: (i == F.size(rows) - 1) | (F.get(rows, i + 1)["k"] != x["k"]))
    ordered = lambda es: F.array_sort(F.transform(es, lambda e, i: F.struct(of(e).alias("k"), i.alias("i"))))
    return let(entries, lambda es: F.transform(let(ordered(es), ends), lambda x: F.get(es, x["i"])))


def nested_update(*nested_keys: str) -> Callable[[Column, Column], Column]:
    """Arrays of structs joined in sequence; with nested keys the last struct of each key stays."""

    def build(c: Column, s: Column) -> Column:
        rows = F.flatten(in_sequence(c, s))
        return last_by(rows, lambda e: F.struct(*(e[k].alias(k) for k in nested_keys))) if nested_keys else rows

    return build


FIELD_AGGREGATES: dict[str, Callable[[Column, Column], Column]] = {
    "sum": lambda c, s: F.sum(c), "max": lambda c, s: F.max(c), "min": lambda c, s: F.min(c), "product": lambda c, s: F.product(c), "bool_and": lambda c, s: F.bool_and(c), "bool_or": lambda c, s: F.bool_or(c),
    "last_value": lambda c, s: F.max_by(F.struct(c.alias("v")), s)["v"], "first_value": lambda c, s: F.min_by(F.struct(c.alias("v")), s)["v"],
    "last_non_null_value": lambda c, s: F.max_by(c, F.when(c.isNotNull(), s)), "first_non_null_value": lambda c, s: F.min_by(c, F.when(c.isNotNull(), s)),
    "listagg": listagg(","), "collect": lambda c, s: F.sort_array(F.collect_list(c)), "collect_distinct": lambda c, s: F.sort_array(F.collect_set(c)), "primary_key": lambda c, s: F.any_value(c),
    "nested_update": nested_update(), "merge_map": lambda c, s: F.map_from_entries(last_by(F.flatten(F.transform(in_sequence(c, s), F.map_entries)), lambda e: e["key"])),
}


def merge_aggregate(df: DataFrame, key: Sequence[str], sequence: str, fields: dict[str, str | Callable[[Column, Column], Column]]) -> DataFrame:
    """Per primary key each column under its field aggregate, by name or as a function of column and sequence (listagg("|"), nested_update("k"))."""
    build = lambda how: FIELD_AGGREGATES[how] if isinstance(how, str) else how
    return df.groupBy(*key).agg(*(build(how)(F.col(c), F.col(sequence)).alias(c) for c, how in fields.items()))


def apply_deletion_vector(df: DataFrame, deleted: DataFrame, file: str = "file_path", row: str = "row_index") -> DataFrame:
    """Rows of a file scan (with _metadata) that deleted (file, row) does not name."""
    return df.withColumns({"__f": F.col("_metadata.file_path"), "__r": F.col("_metadata.row_index")}).join(deleted, (F.col("__f") == F.col(file)) & (F.col("__r") == F.col(row)), "left_anti").drop("__f", "__r")
