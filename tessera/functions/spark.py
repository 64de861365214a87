"""Functions under the Spark dialect's names: non-ANSI results (null instead of an error, wrapping whole numbers) whatever the session's setting."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.evaluation import arithmetic, checked, legacy_cast, unix_time, unscaled
from tessera.functions.numeric import NUMERIC

Build = Callable[..., Column]


def builtin(name: str) -> Build:
    return lambda *a: F.call_function(name, *a)


BUILT_IN = """
array array_contains array_intersect array_except arrays_zip array_min array_max array_prepend array_union array_compact
sort_array array_repeat array_remove flatten get array_append array_insert shuffle hash xxhash64 md5 sha1 sha2 bit_count bit_get shiftleft shiftright
isnull isnotnull least greatest year unix_seconds unix_date from_unixtime datediff last_day add_months date_add
date_sub day dayofmonth dayofyear weekday months_between dayofweek quarter month hour minute second date_format make_ym_interval date_trunc
unix_micros timestamp_micros unix_millis timestamp_millis timestamp_seconds to_utc_timestamp from_utc_timestamp date_from_unix_date to_json
json_array_length get_json_object json_object_keys map_from_arrays map_from_entries map_concat map size rand random acos acosh asinh
atanh sec csc sinh cosh cot atan2 log1p bin hex exp expm1 power rint round unhex hypot log ln log2 log10 width_bucket isnan factorial concat_ws
input_file_name raise_error spark_partition_id regexp_extract rlike split concat lower upper str_to_map startswith endswith contains locate repeat uuid initcap
trim ltrim rtrim space translate replace find_in_set instr length substring_index left right chr ascii lpad rpad substring overlay levenshtein base64
unbase64 mask soundex bit_length url_encode""".split()


def millisecond(ts: Column) -> Column:
    return F.date_format(ts, "SSS").cast("int")


def array_slice_sum(a: Column, start: Column, length: Column | None = None) -> Column:
    """Sum of a slice from a 0-based start (negative: from the end); 0 for a null array or a start outside; a null inside raises."""
    n = F.size(a)
    begin = F.when(start < 0, start + n).otherwise(start)
    count = n - begin if length is None else F.when(length < 0, n - begin).otherwise(F.least(length, n - begin))
    part = F.slice(a, begin + 1, count)
    total = F.aggregate(part, F.lit(0).cast("double"), lambda s, x: s + F.coalesce(x.cast("double"), F.raise_error(F.lit("null element in slice")).cast("double")))
    return F.when(a.isNull() | (n <= 0) | (F.abs(start) >= n), F.lit(0.0)).otherwise(total)


def bit_days_count(a: Column, last: Column | None = None) -> Column:
    """Set bits without each word's marker bit; last: only the last words."""
    part = a if last is None else F.when((last < 1) | (last > F.size(a)), F.raise_error(F.lit("count outside the array")).cast("array<bigint>")).otherwise(F.slice(a, -last, last))
    return F.aggregate(part, F.lit(0), lambda s, x: s + F.bit_count(x) - 1)


def str_to_long_arr(s: Column) -> Column:
    parts = F.transform(F.split(s, ","), lambda x: F.when(x.rlike("^[+-]?[0-9]+$"), x.try_cast("bigint")))
    return F.when(s != "", F.array_compact(parts))


def map_update(left: Column, right: Column) -> Column:
    """left with the entries of right on top."""
    return F.map_from_entries(F.concat(F.filter(F.map_entries(left), lambda e: ~F.array_contains(F.map_keys(right), e["key"])), F.map_entries(right)))


def subscript(a: Column, i: Column) -> Column:
    """1-based; null where the index is out of range or not positive."""
    return F.when(i > 0, F.get(a, i - 1))


def parsed(text: Column, pattern: str) -> Column:
    """A date; null for text that the pattern does not fit."""
    return F.try_to_timestamp(text.cast("string"), F.lit(pattern)).cast("date")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is evaluated once, also where lambdas of body use it."""
    return F.get(F.transform(F.array(value), body), 0)


def date2pdate(d: Column) -> Column:
    return F.date_format(parsed(d, "yyyyMMdd"), "yyyy-MM-dd")


def pdate2date(d: Column) -> Column:
    return F.date_format(parsed(d, "yyyy-MM-dd"), "yyyyMMdd")


def at_least_n_non_nulls(n: Column, *columns: Column) -> Column:
    return reduce(lambda x, y: x + y, (c.isNotNull().cast("int") for c in columns)) >= n


def null_if_zero(f: Callable[[Column, Column], Column]) -> Build:
    return lambda a, b: F.when(b != 0, f(a, F.when(b != 0, b)))


def json_to_map(s: Column) -> Column:
    """map<string,string>; nested values keep their JSON text."""
    return F.from_json(s, "map<string,string>")


SPARK: dict[str, Build] = {name: builtin(name) for name in BUILT_IN} | {
    "transform": F.transform, "aggregate": F.aggregate, "filter": F.filter, "exists": F.exists, "forall": F.forall, "zip_with": F.zip_with, "map_filter": F.map_filter,
    "array_sort": lambda a, f=None: F.array_sort(a) if f is None else F.array_sort(a, f),
    "array_sort_desc": lambda a: F.concat(F.sort_array(F.array_compact(a), asc=False), F.filter(a, lambda x: x.isNull())),
    "array_slice_sum": array_slice_sum, "array_union_udf": lambda *a: reduce(F.array_union, a), "bit_days_count": bit_days_count,
    "bitwise_xor": lambda a, b: a.bitwiseXOR(b), "bitwise_not": F.bitwise_not, "bitwise_and": lambda a, b: a.bitwiseAND(b), "bitwise_or": lambda a, b: a.bitwiseOR(b),
    "not": lambda a: ~a, "equalto": lambda a, b: a == b, "lessthan": lambda a, b: a < b, "greaterthan": lambda a, b: a > b, "lessthanorequal": lambda a, b: a <= b, "greaterthanorequal": lambda a, b: a >= b,
    "equalnullsafe": lambda a, b: a.eqNullSafe(b), "between": lambda a, b, c: a.between(b, c),
    "decimal_greaterthan": lambda a, b: a > b, "decimal_greaterthanorequal": lambda a, b: a >= b, "decimal_lessthan": lambda a, b: a < b, "decimal_lessthanorequal": lambda a, b: a <= b, "decimal_equalto": lambda a, b: a == b, "decimal_notequalto": lambda a, b: a != b,
    "date2pdate": date2pdate, "pdate2date": pdate2date, "format_pdate": lambda d: F.date_format(F.coalesce(parsed(d, "yyyyMMdd"), parsed(d, "yyyy-MM-dd")), "yyyy-MM-dd"),
    "week_of_year": F.weekofyear, "get_timestamp": lambda s, *pattern: F.try_to_timestamp(s, *pattern), "long_to_timestamp": lambda x, tz=None: F.timestamp_seconds(x) if tz is None else F.from_utc_timestamp(F.timestamp_seconds(x), tz),
    "doy": F.dayofyear, "dow": F.dayofweek, "millisecond": millisecond,
    "json_split": lambda s: F.from_json(s, "array<string>"), "json_to_map": json_to_map, "json_tuple_with_codegen": lambda s, *keys: F.array(*(F.get_json_object(s, "$." + k) if isinstance(k, str) else F.call_function("get_json_object", s, F.concat(F.lit("$."), k)) for k in keys)),
    "map_update": map_update, "get_map_value": lambda m, k: F.try_element_at(m, k), "map_filter_keys": lambda m, keys: F.map_filter(m, lambda k, _: F.array_contains(keys, k)),
    "combine": lambda a, b: F.concat(F.coalesce(a, F.array()), F.coalesce(b, F.array())), "combine_maps": lambda a, b: map_update(F.coalesce(a, F.create_map().cast("map<string,string>")), F.coalesce(b, F.create_map().cast("map<string,string>"))),
    "str_to_long_arr": str_to_long_arr, "add": lambda a, b: arithmetic("Add", a, b, False), "subtract": lambda a, b: arithmetic("Subtract", a, b, False), "multiply": lambda a, b: arithmetic("Multiply", a, b, False),
    **dict.fromkeys(("unaryminus", "negative"), lambda a: checked("UnaryMinus", a, ansi=False)), "abs": lambda a: checked("Abs", a, ansi=False), "conv": lambda s, a, b: checked("Conv", s, a, b, ansi=False), "make_date": lambda y, m, d: checked("MakeDate", y, m, d, ansi=False),
    "next_day": lambda d, name: checked("NextDay", d, name, ansi=False), "unix_timestamp": lambda *a: unix_time("UnixTimestamp", *a) if a else F.unix_timestamp(), "to_unix_timestamp": lambda *a: unix_time("ToUnixTimestamp", *a), "make_timestamp": builtin("try_make_timestamp"),
    "element_at": F.try_element_at, "url_decode": builtin("try_url_decode"), "parse_url": builtin("try_parse_url"),
    "divide": null_if_zero(lambda a, b: a.cast("double") / b.cast("double")), "remainder": null_if_zero(lambda a, b: a % b), "pmod": null_if_zero(F.pmod),
    "add_deny_precision_loss": lambda a, b: arithmetic("Add", a, b, False), "subtract_deny_precision_loss": lambda a, b: arithmetic("Subtract", a, b, False), "multiply_deny_precision_loss": lambda a, b: arithmetic("Multiply", a, b, False), "divide_deny_precision_loss": null_if_zero(lambda a, b: a / b),
    "ceil": lambda a: F.ceil(a).cast("bigint"), "floor": lambda a: F.floor(a).cast("bigint"), "get_array_item": subscript,
    "unscaled_value": unscaled, "make_decimal": lambda x, p=None, s=None: x.cast("decimal(38,0)"), "decimal_round": lambda d, s: F.call_function("round", d, s),
    "icu_regexp_replace": builtin("regexp_replace"), "icu_regexp_extract": builtin("regexp_extract"), "icu_regexp_extract_all": builtin("regexp_extract_all"), "icu_regexp": builtin("rlike"), "icu_rlike": builtin("rlike"), "icu_regexp_like": builtin("regexp_like"),
    "row_constructor": lambda *a: F.struct(*a), "at_least_n_non_nulls": at_least_n_non_nulls, "cast": legacy_cast, "try_cast": lambda a, kind: a.try_cast(kind),
    "get_struct_field": lambda a, name: a.getField(name), "get_array_struct_fields": lambda a, name: a.getField(name), "from_json": F.from_json, "string_repeat": builtin("repeat"), "to_title": F.initcap, "empty2null": lambda a: F.nullif(a, F.lit("")),
    "hash_with_seed": NUMERIC["hash_with_seed"], "xxhash64_with_seed": NUMERIC["xxhash64_with_seed"], "hive_hash": NUMERIC["hive_hash"], "might_contain": NUMERIC["might_contain"],
}
