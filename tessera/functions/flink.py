"""Functions under the Flink dialect's names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def split_index(s: Column, delimiter: Column, i: Column) -> Column:
    """0-based field; null for an empty string or an index out of range."""
    return F.when((s != "") & (i >= 0), F.get(F.split(s, F.concat(F.lit("\\Q"), delimiter, F.lit("\\E"))), i))


FLINK: dict[str, Callable[..., Column]] = {
    "flink_decimal_add": lambda a, b: a + b, "flink_decimal_subtract": lambda a, b: a - b, "flink_decimal_multiply": lambda a, b: a * b,
    "is_alpha": lambda s: F.coalesce(s.rlike("^[A-Za-z]+$"), F.lit(False)), "is_digit": lambda s: F.coalesce(s.rlike("^[0-9]+$"), F.lit(False)), "is_decimal": lambda s: F.coalesce(s.rlike("^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)$"), F.lit(False)),
    "split_index": split_index, "current_timestamp": F.current_timestamp, "now": F.now,
    "flink_unix_timestamp": lambda s, pattern=None: F.unix_timestamp(s) if pattern is None else F.call_function("unix_timestamp", s, pattern), "flink_from_unixtime": lambda x, pattern=None: F.from_unixtime(x) if pattern is None else F.call_function("from_unixtime", x, pattern),
    "rand_integer": lambda n, seed=None: F.floor((F.rand() if seed is None else F.call_function("rand", seed)) * n).cast("int"),
    "json_str_to_map": lambda s: F.from_json(s, "map<string,string>"), "json_str_to_array": lambda s: F.from_json(s, "array<string>"),
}
