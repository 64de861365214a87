"""Sources and sinks: Spark's readers and writers with the dialect's defaults."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.sources.connector import GeneratedTables, register_connectors

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
#: Defaults of delimited text: fixed values.
FIELD, COLLECTION, MAP_KEY, NULL = "\x01", "\x02", "\x03", "\\N"


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def register(spark: SparkSession, directory: str, names: Sequence[str] = TABLES) -> None:
    for name in names:
        table(spark, directory, name).createOrReplaceTempView(name)


def scan(spark: SparkSession, path: str, fmt: str = "parquet", schema: StructType | str | None = None, columns: Sequence[str] | None = None, where: Column | str | None = None, **options) -> DataFrame:
    """A pruned, filtered scan; text formats need a schema. Filters and columns reach the reader."""
    reader = spark.read.format(fmt).options(**options)
    df = (reader.schema(schema) if schema is not None else reader).load(path)
    df = df if where is None else df.where(where)
    return df if columns is None else df.select(*columns)


def with_synthesized(df: DataFrame) -> DataFrame:
    """df of a file scan with its file's path, size, modification time and each row's number in it."""
    return df.select("*", F.col("_metadata.file_path").alias("$path"), F.col("_metadata.file_size").alias("$file_size"), F.col("_metadata.file_modification_time").alias("$file_modified_time"), F.col("_metadata.row_index").alias("$row_number"))


def read_text(spark: SparkSession, path: str, schema: StructType | str, delimiter: str = FIELD, skip_header: bool = False, escape: str = "\\") -> DataFrame:
    return spark.read.schema(schema).csv(path, sep=delimiter, nullValue=NULL, header=skip_header, escape=escape, quote="", enforceSchema=True)


def parse_nested(column: Column, kind: str) -> Column:
    """A delimited text field as array or map of strings."""
    if kind == "array":
        return F.split(column, COLLECTION)
    return F.str_to_map(column, F.lit(COLLECTION), F.lit(MAP_KEY))


def write_text(df: DataFrame, path: str, delimiter: str = FIELD, mode: str = "errorifexists") -> None:
    df.write.mode(mode).csv(path, sep=delimiter, nullValue=NULL, quote="", escape="\\", emptyValue="")


def write(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists", partition_by: Sequence[str] = (), **options) -> None:
    """Dynamic partitions are dealt by their columns first, so a task writes few of them; a hot one is split by Spark's rebalancing."""
    out = df.hint("rebalance", *partition_by) if partition_by else df
    out.write.format(fmt).mode(mode).options(**options).partitionBy(*partition_by).save(path)


def write_bucketed(df: DataFrame, name: str, keys: Sequence[str], buckets: int, sort_by: Sequence[str] = (), mode: str = "errorifexists", fmt: str = "parquet", path: str | None = None) -> None:
    """A catalog table, external if path is given, whose joins and aggregates on keys need no shuffle."""
    writer = df.repartition(buckets, *keys).write.format(fmt).mode(mode).bucketBy(buckets, *keys)
    writer = writer.option("path", path) if path else writer
    (writer.sortBy(*sort_by) if sort_by else writer).saveAsTable(name)


def from_arrow(spark: SparkSession, data: pa.Table) -> DataFrame:
    return spark.createDataFrame(data)


def values(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(list(rows), schema)


def random_rows(spark: SparkSession, n: int, columns: dict[str, str], nulls: float = 0.1, seed: int = 0) -> DataFrame:
    """n generated rows of the given types (long, int, double, boolean, string), made where they are needed."""
    df = spark.range(n)
    made = []
    for k, (name, kind) in enumerate(columns.items()):
        x = F.rand(seed + 2 * k)
        value = {"double": x, "boolean": x < 0.5, "string": F.substring(F.md5(x.cast("string")), 1, 8)}.get(kind, F.floor(x * 1000).cast(kind) if kind in ("int", "long") else x)
        made.append(F.when(F.rand(seed + 2 * k + 1) >= nulls, value).alias(name))
    return df.select(*made)


def to_batches(df: DataFrame, rows: int = 10_000) -> Iterator[pa.RecordBatch]:
    """Results partition by partition as record batches of at most ``rows`` rows, for a consumer's callback."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema, held = to_arrow_schema(df.schema), []
    for row in df.toLocalIterator(prefetchPartitions=True):
        held.append(row.asDict(recursive=True))
        if len(held) == rows:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def with_bucket(df: DataFrame, name: str = "$bucket") -> DataFrame:
    """df of a bucketed table with each row's bucket, from its file's name."""
    return df.withColumn(name, F.regexp_extract(F.input_file_name(), "_([0-9]{5})(?:[.]c[0-9]+)?[^/_]*$", 1).cast("int"))
