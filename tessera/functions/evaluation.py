"""Catalyst expressions whose overflow and error behaviour does not follow the session's ANSI setting."""

from __future__ import annotations

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

Value = Column | bool | str | None


def _made(name: str, *arguments) -> Column:
    """A Column of the expression class ``name``; Columns among the arguments become expressions."""
    jvm = SparkContext._active_spark_context._jvm
    to = jvm.org.apache.spark.sql.classic.ExpressionUtils
    inner = [to.expression(a._jc) if isinstance(a, Column) else a for a in arguments]
    kind = jvm.org.apache.spark.sql.catalyst.expressions
    for part in name.split("."):
        kind = getattr(kind, part)
    made = kind(*inner)
    return type(F.lit(0))(to.column(made))


def _mode(name: str):
    expressions = SparkContext._active_spark_context._jvm.org.apache.spark.sql.catalyst.expressions
    return getattr(getattr(getattr(expressions, "EvalMode$"), "MODULE$"), name)()


def arithmetic(name: str, a: Column, b: Column, ansi: bool) -> Column:
    """Add, Subtract, Multiply or Remainder; without ansi whole numbers wrap and decimals beyond their range are null."""
    context = SparkContext._active_spark_context._jvm.org.apache.spark.sql.catalyst.expressions.NumericEvalContext(_mode("ANSI" if ansi else "LEGACY"), True)
    return _made(name, a, b, context)


def checked(name: str, *arguments: Column, ansi: bool) -> Column:
    """Expressions with a flag to fail as their last argument: UnaryMinus, Abs, MakeDate, Conv, NextDay."""
    return _made(name, *arguments, ansi)


def unix_time(name: str, *arguments: Column) -> Column:
    """UnixTimestamp or ToUnixTimestamp; null for text that the pattern does not fit."""
    value, pattern = arguments if len(arguments) == 2 else (*arguments, F.lit("yyyy-MM-dd HH:mm:ss"))
    return _made(name, value, pattern, SparkContext._active_spark_context._jvm.scala.Option.empty(), False)


def legacy_cast(a: Column, kind: str | DataType) -> Column:
    """Whole numbers wrap, text that is no value is null."""
    context = SparkContext._active_spark_context._jvm
    target = context.org.apache.spark.sql.types.DataType.fromDDL(kind if isinstance(kind, str) else kind.simpleString())
    return _made("Cast", a, target, context.scala.Option.empty(), _mode("LEGACY"))


def unscaled(d: Column) -> Column:
    """The whole number that a decimal of up to 18 digits keeps its digits in."""
    return _made("UnscaledValue", d)


def try_(a: Column) -> Column:
    """a, or null where its evaluation raises an error."""
    return _made("TryEval", a)


def bloom_filter_aggregate(x: Column, expected: int = 1_000_000, bits: int = 8_388_608) -> Column:
    """A Bloom filter of the 64-bit hashes of x, partially aggregated; its size is that of its bits. Read by bloom_might_contain."""
    made = _made("aggregate.BloomFilterAggregate", F.xxhash64(x), F.lit(expected).cast("bigint"), F.lit(bits).cast("bigint"))
    jvm = SparkContext._active_spark_context._jvm
    to = jvm.org.apache.spark.sql.classic.ExpressionUtils
    aggregate = to.expression(made._jc).toAggregateExpression()
    return type(F.lit(0))(to.column(aggregate))


def bloom_might_contain(bloom: Column, x: Column) -> Column:
    """Whether a filter may hold x; bloom is a scalar subquery or a literal."""
    return _made("BloomFilterMightContain", bloom, F.xxhash64(x))
