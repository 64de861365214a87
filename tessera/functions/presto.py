"""Functions under the Presto dialect's names. Errors are raised where the dialect raises."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from tessera.functions.numeric import NUMERIC
from tessera.functions.evaluation import arithmetic, checked
from tessera.functions.spark import SPARK, Build, builtin, let, millisecond, subscript

BUILT_IN = """
radians degrees round power pow exp cos cosh acos sin asin tan tanh atan atan2 sqrt cbrt sign pi e rand random pmod find_in_set translate concat array_min
array_max array_join array_union array_remove array_distinct array_intersect array_contains array_except arrays_overlap slice shuffle sequence flatten
sort_array crc32 base64 to_date to_timestamp year quarter month dayofweek hour minute second weekofyear day dayofmonth dayofyear trunc last_day datediff current_date unix_timestamp
to_unix_timestamp months_between next_day isnull isnotnull least greatest json_array_length get_json_object to_json map_entries map_from_entries
map_keys map_values map_concat chr length substr substring split_part trim ltrim rtrim lpad rpad regexp_replace lower upper replace reverse str_to_map
regexp_extract regexp_extract_all regexp_like rlike startswith substring_index space locate parse_url printf url_encode url_decode
""".split()
#: MySQL date letters and the Java letters of the same meaning: fixed values.
MYSQL_DATE = {"%Y": "yyyy", "%y": "yy", "%m": "MM", "%c": "M", "%d": "dd", "%e": "d", "%H": "HH", "%k": "H", "%h": "hh", "%I": "hh", "%i": "mm", "%s": "ss", "%S": "ss", "%f": "SSSSSS", "%p": "a", "%M": "MMMM", "%b": "MMM", "%W": "EEEE", "%a": "EEE", "%j": "DDD", "%T": "HH:mm:ss", "%%": "%"}


def java_pattern(mysql: str) -> str:
    out, i = "", 0
    while i < len(mysql):
        two = mysql[i : i + 2]
        if two in MYSQL_DATE:
            out, i = out + MYSQL_DATE[two], i + 2
        else:
            out, i = out + (f"'{mysql[i]}'" if mysql[i].isalpha() else mysql[i]), i + 1
    return out


def fail(message: str, kind: str = "string") -> Column:
    return F.raise_error(F.lit(message)).cast(kind)


def divide(a: Column, b: Column, df: DataFrame | None = None) -> Column:
    """Whole numbers are divided towards zero and a divisor of 0 raises; floating-point numbers follow IEEE 754.

    The types are those that a and b have over df, or, without it, those of literals; columns of unknown type count as floating-point.
    """
    if all(re.fullmatch("Column<'-?[0-9]+'>", str(c)) for c in (a, b)) if df is None else all(isinstance(f.dataType, IntegralType) for f in df.select(a.alias("a"), b.alias("b")).schema):
        return integer_divide(a, b)
    x, y, inf = a.cast("double"), b.cast("double"), F.lit(float("inf"))
    # a zero's sign shows in its text
    sign = F.signum(x) * F.when(y.cast("string").startswith("-"), -1.0).otherwise(1.0)
    return F.when(y != 0, x / F.nullif(y, F.lit(0.0))).when(y == 0, F.when(x.isNull(), None).when(F.isnan(x) | (x == 0), float("nan")).otherwise(sign * inf))


def logarithm(f: Callable[[Column], Column]) -> Build:
    """-Infinity for 0, NaN for less."""
    return lambda x: F.when(x > 0, f(x)).when(x == 0, F.lit(float("-inf"))).when(x < 0, F.lit(float("nan")))


def to_base(x: Column, radix: Column) -> Column:
    """Sign and digits."""
    digits = F.lower(F.call_function("conv", F.abs(x.cast("decimal(20,0)")).cast("string"), F.lit(10), radix.cast("int")))
    return F.when(x < 0, F.concat(F.lit("-"), digits)).otherwise(digits)


def raising(wrong: Column, message: str, value: Column, kind: str) -> Column:
    """value of a type, or an error."""
    return F.when(wrong, fail(message, kind)).otherwise(value)


def integer_divide(a: Column, b: Column) -> Column:
    """Integer division towards zero; a divisor of 0 raises."""
    return F.when(b == 0, fail("division by zero", "bigint")).otherwise(F.call_function("div", a, b))


def truncate(x: Column, digits: Column | None = None) -> Column:
    scale = F.lit(1.0) if digits is None else F.pow(F.lit(10.0), digits)
    return F.signum(x) * F.floor(F.abs(x) * scale) / scale


def width_bucket(x: Column, *rest: Column) -> Column:
    """(x, low, high, buckets), or (x, ascending bounds): the number of bounds not above x."""
    if len(rest) == 3:
        return F.width_bucket(x, *rest)
    bad = F.isnan(x.cast("double")) | (F.size(rest[0]) == 0) | F.exists(rest[0], lambda b: b.isNull() | F.isnan(b.cast("double")) | (F.abs(b.cast("double")) == float("inf")))
    return raising(bad, "width_bucket: operand is NaN, or bins are empty or not finite", F.size(F.filter(rest[0], lambda b: b <= x)).cast("bigint"), "bigint")


def wilson(side: int) -> Build:
    def bound(successes: Column, trials: Column, z: Column) -> Column:
        n, p = trials.cast("double"), successes.cast("double") / trials.cast("double")
        value = (p + z * z / (2 * n) + side * z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)
        wrong = (successes < 0) | (trials <= 0) | (successes > trials) | (z < 0)
        return F.when(wrong, fail("wilson interval: arguments out of range", "double")).otherwise(value)

    return bound


def cosine_similarity(a: Column, b: Column) -> Column:
    """Of two sparse vectors as maps; null for an empty or zero vector."""
    norm = lambda m: F.sqrt(F.aggregate(F.map_values(m), F.lit(0.0), lambda s, x: s + x * x))
    dot = F.aggregate(F.map_keys(a), F.lit(0.0), lambda s, k: s + F.element_at(a, k) * F.coalesce(F.try_element_at(b, k), F.lit(0.0)))
    scale = norm(a) * norm(b)
    return F.when(scale > 0, dot / scale)


def runs(a: Column) -> Column:
    """(value, n) of the runs of equal values in a sorted array without nulls."""

    def of(v: Column) -> Column:
        starts = F.filter(F.transform(v, lambda x, i: F.when((i == 0) | (x != F.get(v, i - 1)), i)), lambda i: i.isNotNull())
        return let(starts, lambda s: F.transform(s, lambda i, k: F.struct(F.get(v, i).alias("value"), (F.coalesce(F.get(s, k + 1), F.size(v)) - i).alias("n"))))

    return let(a, of)


def array_frequency(a: Column) -> Column:
    """Map of value to count; nulls are skipped. One sort, then runs."""
    return F.map_from_entries(runs(F.array_sort(F.array_compact(a))))


def array_duplicates(a: Column) -> Column:
    """Values that occur more than once, in order, null last."""
    twice = F.transform(F.filter(runs(F.array_sort(F.array_compact(a))), lambda r: r["n"] > 1), lambda r: r["value"])
    return F.when(F.size(F.filter(a, lambda x: x.isNull())) > 1, F.array_append(twice, F.get(twice, -1))).otherwise(twice)


def array_normalize(a: Column, p: Column) -> Column:
    norm = F.pow(F.aggregate(a, F.lit(0.0), lambda s, x: s + F.pow(F.abs(x), p)), 1 / p)
    return F.when(p < 0, fail("p is negative", "array<double>")).when((p == 0) | (norm == 0) | (F.size(a) == 0), a).otherwise(F.transform(a, lambda x: x / norm))


def array_average(a: Column) -> Column:
    values = F.array_compact(a)
    return F.when(F.size(values) > 0, F.aggregate(values, F.lit(0.0), lambda s, x: s + x) / F.size(values))


def array_position(a: Column, x: Column, instance: Column | None = None) -> Column:
    if instance is None:
        return F.call_function("array_position", a, x)
    places = F.filter(F.transform(a, lambda y, i: F.when(y == x, i + 1)), lambda i: i.isNotNull())
    return F.when(instance == 0, fail("instance is 0", "bigint")).otherwise(F.coalesce(F.try_element_at(places, instance.cast("int")).cast("bigint"), F.lit(0)))


def trim_array(a: Column, n: Column) -> Column:
    return F.slice(a, F.lit(1), raising((n < 0) | (n > F.size(a)), "size outside the array", F.size(a) - n, "int"))


def ngrams(a: Column, n: Column) -> Column:
    n = raising(n <= 0, "n is not positive", n.cast("int"), "int")
    return F.when(F.size(a) <= n, F.array(a)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.size(a) - n + 1, F.lit(1))), lambda i: F.slice(a, i, n)))


def combinations(a: Column, n: Column) -> Column:
    """Of an array of any type; places come from a function of its size."""
    return F.transform(NUMERIC["combinations"](F.size(a), n), lambda places: F.transform(places, lambda i: F.get(a, i)))


def element(a: Column) -> Column:
    return F.when(F.size(a) > 1, F.get(a, F.raise_error(F.lit("more than one element")).cast("int"))).otherwise(F.get(a, 0))


def multimap_from_entries(entries: Column) -> Column:
    """Values of each key in order; one sort of (key, place), then runs of keys."""
    ordered = F.array_sort(F.transform(entries, lambda e, i: F.struct(e.getField("key").alias("key"), i.alias("i"))))

    def of(rows: Column, source: Column) -> Column:
        first = lambda r, i: (i == 0) | (r["key"] != F.get(rows, i - 1)["key"])
        starts = F.filter(F.transform(rows, lambda r, i: F.when(first(r, i), i)), lambda i: i.isNotNull())
        values = lambda i, end: F.transform(F.slice(rows, i + 1, end - i), lambda r: F.get(source, r["i"]).getField("value"))
        return let(starts, lambda s: F.map_from_entries(F.transform(s, lambda i, k: F.struct(F.get(rows, i)["key"], values(i, F.coalesce(F.get(s, k + 1), F.size(rows)))))))

    return let(ordered, lambda rows: of(rows, entries))


def split(s: Column, delimiter: Column, limit: Column | None = None) -> Column:
    """By a literal delimiter."""
    quoted = F.concat(F.lit("\\Q"), delimiter, F.lit("\\E"))
    return F.call_function("split", s, quoted, *([] if limit is None else [limit]))


def strpos(s: Column, part: Column, instance: Column | None = None) -> Column:
    if instance is None:
        return F.call_function("instr", s, part)
    before = F.array_join(F.slice(split(s, part), F.lit(1), instance), "\x00")
    count = F.size(split(s, part)) - 1
    return F.when(count >= instance, F.length(before) + (instance - 1) * (F.length(part) - 1) + 1).otherwise(0)


def strrpos(s: Column, part: Column) -> Column:
    back = F.call_function("instr", F.reverse(s), F.reverse(part))
    return F.when(back > 0, F.length(s) - back - F.length(part) + 2).otherwise(0)


def json_extract_scalar(s: Column, path: Column) -> Column:
    value = F.call_function("get_json_object", s, path)
    return F.when(~value.rlike("^\\s*[\\[{]"), value)


def is_json_scalar(s: Column) -> Column:
    return s.rlike('^\\s*(null|true|false|-?[0-9]+(\\.[0-9]+)?([eE][+-]?[0-9]+)?|"([^"\\\\]|\\\\.)*")\\s*$')


def masked(x: Column, bits: Column | None) -> Column:
    return x if bits is None else F.when(bits >= 64, x).otherwise(x.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("bigint"), bits.cast("int")) - 1))


def downsample(series: Column, interval: int, how: str = "avg", fill: str = "none") -> Column:
    """map<bigint,double> to buckets of key - key % interval; fill: none, nan or zero between the first and the last bucket."""
    entries = F.map_entries(series)
    bucket = lambda e: e["key"] - F.pmod(e["key"], F.lit(interval))
    keys = F.array_sort(F.array_distinct(F.transform(entries, bucket)))
    values = lambda k: F.transform(F.filter(entries, lambda e: bucket(e) == k), lambda e: e["value"])
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x)
    of = {"sum": total, "avg": lambda v: total(v) / F.size(v), "max": F.array_max, "min": F.array_min, "count": lambda v: F.size(v).cast("double")}[how]
    if fill != "none":
        keys = F.when(F.size(keys) > 0, F.sequence(F.array_min(keys), F.array_max(keys), F.lit(interval).cast("bigint"))).otherwise(keys)
    empty = F.lit(float("nan") if fill == "nan" else 0.0)
    return F.map_from_entries(F.transform(keys, lambda k: F.struct(k, F.when(F.size(values(k)) > 0, of(values(k))).otherwise(empty))))


def unit(name: str, f: Callable[..., Column] | None = None) -> Build:
    """name(unit, ...) with a literal unit."""
    return lambda u, *a: F.call_function(name, u, *a) if f is None else f(u, *a)


def timestamp_step(u: str, n: Column, ts: Column) -> Column:
    return F.timestamp_add(u, n, ts)


PRESTO: dict[str, Build] = {name: builtin(name) for name in BUILT_IN} | {k: v for k, v in NUMERIC.items() if k not in ("hash_with_seed", "xxhash64_with_seed", "hive_hash", "might_contain")} | {
    "plus": lambda a, b: arithmetic("Add", a, b, True), "minus": lambda a, b: arithmetic("Subtract", a, b, True), "multiply": lambda a, b: arithmetic("Multiply", a, b, True), "abs": lambda a: checked("Abs", a, ansi=True), "ln": logarithm(F.ln), "log2": logarithm(F.log2), "log10": logarithm(F.log10), "divide": divide, "integer_divide": integer_divide, "mod": lambda a, b: a % b, "negate": lambda a: checked("UnaryMinus", a, ansi=True),
    "ceil": builtin("ceil"), "ceiling": builtin("ceil"), "floor": builtin("floor"), "clamp": lambda v, lo, hi: F.least(F.greatest(v, lo), hi), "log": lambda b, x: logarithm(F.ln)(x) / F.ln(b), "width_bucket": width_bucket,
    "infinity": lambda: F.lit(float("inf")), "nan": lambda: F.lit(float("nan")), "is_finite": lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")), "is_infinite": lambda x: F.abs(x) == float("inf"), "is_nan": F.isnan,
    "from_base": lambda s, r: F.call_function("conv", s, r.cast("int"), F.lit(10)).cast("bigint"), "to_base": to_base, "truncate": truncate,
    "cauchy_cdf": lambda m, s, x: 0.5 + F.atan((x - m) / s) / F.pi(), "laplace_cdf": lambda m, s, x: F.when(x < m, 0.5 * F.exp((x - m) / s)).otherwise(1 - 0.5 * F.exp(-(x - m) / s)), "weibull_cdf": lambda a, b, x: F.when(x <= 0, 0.0).otherwise(1 - F.exp(-F.pow(x / b, a))),
    "wilson_interval_lower": wilson(-1), "wilson_interval_upper": wilson(1), "cosine_similarity": cosine_similarity, "to_bigint": lambda x: x.cast("bigint"), "to_integer": lambda x: x.cast("int"), "not": lambda x: ~x,
    "combinations": combinations, "array_has_duplicates": lambda a: F.size(F.array_distinct(a)) < F.size(a), "array_frequency": array_frequency, "array_normalize": array_normalize, "trim_array": trim_array, "remove_nulls": F.array_compact,
    "array_constructor": lambda *a: F.array(*a), "all_match": F.forall, "any_match": F.exists, "none_match": lambda a, f: ~F.exists(a, f), "find_first": lambda a, f: F.get(F.filter(a, f), 0), "find_first_index": lambda a, f: F.nullif(F.array_position(F.transform(a, f), True), F.lit(0)),
    "array_duplicates": array_duplicates, "contains": builtin("array_contains"), "zip": F.arrays_zip, "zip_with": F.zip_with, "array_position": array_position, "element": element, "array_sort": SPARK["array_sort"], "array_sort_desc": SPARK["array_sort_desc"],
    "array_sum": lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0))), "repeat": builtin("array_repeat"), "array_average": array_average, "ngrams": ngrams,
    "md5": lambda x: F.unhex(F.md5(x)), "sha1": lambda x: F.unhex(F.sha1(x)), "sha256": lambda x: F.unhex(F.sha2(x, 256)), "sha512": lambda x: F.unhex(F.sha2(x, 512)), "to_hex": F.hex, "from_hex": F.unhex, "to_base64": F.base64, "from_base64": F.unbase64,
    "to_base64url": lambda x: F.translate(F.base64(x), "+/", "-_"), "from_base64url": lambda x: F.unbase64(F.translate(x, "-_", "+/")),
    "to_big_endian_32": lambda x: F.unhex(F.lpad(F.hex(x.cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")), "from_big_endian_32": lambda x: F.conv(F.hex(x), 16, 10).cast("bigint").try_cast("int"), "to_big_endian_64": lambda x: F.unhex(F.lpad(F.hex(x), 16, "0")), "from_big_endian_64": lambda x: F.conv(F.hex(x), 16, -10).cast("bigint"),
    "bitwise_and": lambda a, b: a.bitwiseAND(b), "bitwise_or": lambda a, b: a.bitwiseOR(b), "bitwise_xor": lambda a, b: a.bitwiseXOR(b), "bitwise_not": F.bitwise_not, "bit_count": lambda x, bits=None: F.bit_count(masked(x, bits)).cast("bigint"), "bit_days_count": SPARK["bit_days_count"],
    "bitwise_arithmetic_shift_right": builtin("shiftright"), "bitwise_left_shift": builtin("shiftleft"), "bitwise_right_shift": builtin("shiftrightunsigned"), "bitwise_right_shift_arithmetic": builtin("shiftright"), "bitwise_logical_shift_right": lambda x, n, bits=None: F.call_function("shiftrightunsigned", masked(x, bits), n), "bitwise_shift_left": lambda x, n, bits=None: masked(F.call_function("shiftleft", x, n), bits),
    "eq": lambda a, b: a == b, "neq": lambda a, b: a != b, "lt": lambda a, b: a < b, "gt": lambda a, b: a > b, "lte": lambda a, b: a <= b, "gte": lambda a, b: a >= b, "distinct_from": lambda a, b: ~a.eqNullSafe(b), "between": lambda a, b, c: a.between(b, c),
    "to_unixtime": lambda ts: ts.cast("timestamp").cast("double"), "from_unixtime": F.timestamp_seconds, "date": F.to_date, "timezone_hour": lambda z: F.regexp_extract(z.getField("tz"), "^([+-]?\\d+):", 1).cast("int"), "timezone_minute": lambda z: F.regexp_extract(z.getField("tz"), ":(\\d+)$", 1).cast("int"),
    "week": F.weekofyear, "week_of_year": F.weekofyear, "millisecond": millisecond, "day_of_month": F.dayofmonth, "dow": lambda d: F.weekday(d) + 1, "day_of_week": lambda d: F.weekday(d) + 1, "doy": F.dayofyear, "day_of_year": F.dayofyear,
    "yow": lambda d: F.extract(F.lit("YEAROFWEEK"), d), "year_of_week": lambda d: F.extract(F.lit("YEAROFWEEK"), d), "last_day_of_month": F.last_day, "date_trunc": builtin("date_trunc"),
    "date_add": lambda u, n, ts: timestamp_step(u, n, ts), "timestampadd": lambda u, n, ts: timestamp_step(u, n, ts), "date_diff": lambda u, a, b: F.timestamp_diff(u, a, b), "timestampdiff": lambda u, a, b: F.timestamp_diff(u, a, b),
    "date_format": lambda ts, p: F.date_format(ts, java_pattern(p)), "date_parse": lambda s, p: F.to_timestamp(s, java_pattern(p)), "format_datetime": builtin("date_format"), "parse_datetime": builtin("to_timestamp"), "date2pdate": SPARK["date2pdate"], "pdate2date": SPARK["pdate2date"],
    "in": lambda x, *a: reduce(lambda p, q: p | q, (x == y for y in a)), "row_constructor": lambda *a: F.struct(*a), "is_null": F.isnull, "is_not_null": F.isnotnull, "subscript": subscript, "element_at": lambda a, i: F.try_element_at(a, i), "transform": F.transform, "reduce": F.aggregate, "filter": F.filter,
    "cardinality": builtin("size"), "size": builtin("size"), "empty_approx_set": lambda: F.unhex(F.lit("")), "is_json_scalar": is_json_scalar, "json_extract_scalar": json_extract_scalar, "json_extract": builtin("get_json_object"), "get_json_object_detect_bad_json": lambda s, p: F.when(F.try_parse_json(s).isNotNull(), F.call_function("get_json_object", s, p)),
    "json_array_contains": lambda s, v: F.array_contains(F.from_json(s, "array<string>"), v.cast("string")), "json_size": lambda s: F.coalesce(F.json_array_length(s), F.size(F.json_object_keys(s)), F.lit(0)), "json_format": lambda s: s, "json_parse": F.parse_json, "json_to_map": SPARK["json_to_map"], "json_split": SPARK["json_split"],
    "map_filter": F.map_filter, "transform_keys": F.transform_keys, "transform_values": F.transform_values, "map": F.map_from_arrays, "map_zip_with": F.map_zip_with, "all_keys_match": lambda m, f: F.forall(F.map_keys(m), f), "any_keys_match": lambda m, f: F.exists(F.map_keys(m), f), "no_keys_match": lambda m, f: ~F.exists(F.map_keys(m), f),
    "any_values_match": lambda m, f: F.exists(F.map_values(m), f), "no_values_match": lambda m, f: ~F.exists(F.map_values(m), f), "multimap_from_entries": multimap_from_entries, "map_update": SPARK["map_update"], "map_filter_keys": SPARK["map_filter_keys"], "downsample": downsample,
    "codepoint": F.ascii, "levenshtein_distance": builtin("levenshtein"), "starts_with": builtin("startswith"), "ends_with": builtin("endswith"), "like": lambda s, p: F.like(s, p), "regexp_split": builtin("split"), "split": split, "split_to_map": lambda s, a, b: F.call_function("str_to_map", s, a, b),
    "to_utf8": lambda s: F.encode(s, "UTF-8"), "from_utf8": lambda s: F.decode(s, "UTF-8"), "strpos": strpos, "strrpos": strrpos, "concat_ws_spark": builtin("concat_ws"),
    "url_extract_host": lambda u: F.try_parse_url(u, F.lit("HOST")), "url_extract_fragment": lambda u: F.try_parse_url(u, F.lit("REF")), "url_extract_path": lambda u: F.try_parse_url(u, F.lit("PATH")), "url_extract_parameter": lambda u, k: F.try_parse_url(u, F.lit("QUERY"), k), "url_extract_protocol": lambda u: F.try_parse_url(u, F.lit("PROTOCOL")),
    "url_extract_port": lambda u: F.nullif(F.regexp_extract(F.try_parse_url(u, F.lit("AUTHORITY")), ":(\\d+)$", 1), F.lit("")).cast("bigint"), "url_extract_query": lambda u: F.try_parse_url(u, F.lit("QUERY")),
}
