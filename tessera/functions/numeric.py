"""Functions without a built-in form, as pandas UDFs over Arrow batches."""

from __future__ import annotations

import functools
import hashlib
import hmac
import itertools
import math
import struct
import sys
from collections.abc import Callable

import pandas as pd
import xxhash
from pyspark import cloudpickle
from pyspark.sql import functions as F

# workers need not have this package: its functions travel with the tasks
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def elementwise(f: Callable, kind: str) -> Callable:
    """A null-propagating pandas UDF of a scalar function, made when it is first used (that needs a session)."""

    @functools.cache
    def make() -> Callable:
        def run(*columns: pd.Series) -> pd.Series:
            return pd.Series([None if any(x is None or x is pd.NA for x in row) else f(*row) for row in zip(*columns, strict=True)], dtype="object")

        return F.pandas_udf(run, kind)

    return lambda *columns: make()(*columns)


def incomplete_gamma(a: float, x: float) -> float:
    """Regularised lower incomplete gamma: its series, or the continued fraction of its complement."""
    if x <= 0:
        return 0.0
    scale = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return total * scale
    b, c = x + 1 - a, 1e300
    d = 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return 1 - scale * h


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta by Lentz's continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    f, c, d = 1.0, 1.0, 0.0
    for i in range(10_000):
        m = i // 2
        n = 1.0 if i == 0 else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + n * d or 1e-300)
        c = 1 + n / c or 1e-300
        f *= c * d
        if abs(1 - c * d) < 1e-16:
            break
    return front * (f - 1)


def inverse_incomplete_beta(a: float, b: float, p: float) -> float:
    """Newton's steps inside a bracket; halving where one leaves it or is not half as long as the step before."""
    if not 0 < p < 1:
        return float(p >= 1)
    scale = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
    low, high, x, step = 0.0, 1.0, a / (a + b), 1.0
    for _ in range(1100):
        over = incomplete_beta(a, b, x) - p
        low, high = (x, high) if over < 0 else (low, x)
        slope = math.exp(min(scale + (a - 1) * math.log(x) + (b - 1) * math.log1p(-x), 700.0))
        new = x - over / slope if slope else high
        new = new if low < new < high and abs(new - x) <= step / 2 else (low + high) / 2
        x, step, moved = new, abs(new - x), abs(new - x) > 4e-16 * x
        if not moved or not 0 < x < 1:
            break
    return x


def _normal(m: float, s: float, x: float) -> float:
    return 0.5 * math.erfc((m - x) / (s * math.sqrt(2)))


def _binomial(n: float, p: float, k: float) -> float:
    if k < 0 or k >= n:
        return float(k >= n)
    if n <= 50 and n == math.floor(n) and 0 < p < 1:  # few terms, right to the last place
        return sum(math.comb(int(n), i) * p**i * (1 - p) ** (n - i) for i in range(math.floor(k) + 1))
    return incomplete_beta(n - math.floor(k), math.floor(k) + 1, 1 - p)


def _f(d1: float, d2: float, x: float) -> float:
    return incomplete_beta(d1 / 2, d2 / 2, d1 * x / (d1 * x + d2)) if x > 0 else 0.0


def _combinations(size: int, n: int):
    """Places of all combinations of n of size elements."""
    if n > 5 or math.comb(size, n) > 100_000:
        raise ValueError("combinations: n is at most 5, results at most 100,000")
    return [list(c) for c in itertools.combinations(range(size), n)]


def _hmac(name: str) -> Callable:
    def run(data, key):
        raw = lambda x: x.encode() if isinstance(x, str) else bytes(x)
        return hmac.new(raw(key), raw(data), getattr(hashlib, name)).digest()

    return elementwise(run, "binary")


def _bytes(x) -> bytes:
    """As Spark hashes it: text as UTF-8, whole numbers as 8 little-endian bytes."""
    return x.encode() if isinstance(x, str) else struct.pack("<q", int(x)) if not isinstance(x, bytes | bytearray | memoryview) else bytes(x)


def murmur3(data: bytes, seed: int) -> int:
    """32-bit Murmur3 as Spark computes it: whole words, then each byte left over as a signed word of its own."""
    mask = 0xFFFFFFFF
    turn = lambda x, r: (x << r | x >> 32 - r) & mask
    h = seed & mask
    whole = len(data) - len(data) % 4
    words = [*struct.unpack(f"<{whole // 4}I", data[:whole]), *((b - 256 if b > 127 else b) & mask for b in data[whole:])]
    for k in words:
        h = (turn(h ^ turn(k * 0xCC9E2D51 & mask, 15) * 0x1B873593 & mask, 13) * 5 + 0xE6546B64) & mask
    h ^= len(data)
    h = (h ^ h >> 16) * 0x85EBCA6B & mask
    h = (h ^ h >> 13) * 0xC2B2AE35 & mask
    h ^= h >> 16
    return h - 2**32 if h >= 2**31 else h


#: SpookyHash V2, a published hash: its constant and the rotations of its steps are fixed values.
SPOOKY = 0xDEADBEEFDEADBEEF
SPOOKY_SHORT = (50, 52, 30, 41, 54, 48, 38, 37, 62, 34, 5, 36)
SPOOKY_SHORT_END = (15, 52, 26, 51, 28, 9, 47, 54, 32, 25, 63)
SPOOKY_LONG = (11, 32, 43, 31, 17, 28, 39, 57, 55, 54, 22, 46)
SPOOKY_LONG_END = (44, 15, 34, 21, 38, 33, 10, 13, 38, 53, 42, 54)


def spooky(data: bytes, seed: int = 0) -> int:
    """First 64 bits of SpookyHash V2."""
    mask = 2**64 - 1
    turn = lambda x, n: (x << n | x >> 64 - n) & mask
    word = lambda at: int.from_bytes(data[at : at + 8], "little")
    if len(data) >= 192:
        h = [seed, seed, SPOOKY] * 4
        whole = len(data) // 96 * 96
        for at in range(0, whole, 96):
            for i in range(12):
                h[i] = (h[i] + word(at + 8 * i)) & mask
                h[(i + 2) % 12] ^= h[(i + 10) % 12]
                h[(i + 11) % 12] ^= h[i]
                h[i] = turn(h[i], SPOOKY_LONG[i])
                h[(i + 11) % 12] = (h[(i + 11) % 12] + h[(i + 1) % 12]) & mask
        rest = data[whole:]
        last = rest.ljust(95, b"\0") + bytes([len(rest)])
        h = [(x + int.from_bytes(last[8 * i : 8 * i + 8], "little")) & mask for i, x in enumerate(h)]
        for _ in range(3):
            for i in range(12):
                a, b, c = (i + 11) % 12, (i + 1) % 12, (i + 2) % 12
                h[a] = (h[a] + h[b]) & mask
                h[c] ^= h[a]
                h[b] = turn(h[b], SPOOKY_LONG_END[i])
        return h[0]
    v = [seed, seed, SPOOKY, SPOOKY]

    def stir() -> None:
        for i, n in enumerate(SPOOKY_SHORT):
            x, y, z = (i + 2) % 4, (i + 3) % 4, i % 4
            v[x] = (turn(v[x], n) + v[y]) & mask
            v[z] ^= v[x]

    at = 0
    while len(data) - at >= 32:
        v[2], v[3] = (v[2] + word(at)) & mask, (v[3] + word(at + 8)) & mask
        stir()
        v[0], v[1] = (v[0] + word(at + 16)) & mask, (v[1] + word(at + 24)) & mask
        at += 32
    if len(data) - at >= 16:
        v[2], v[3] = (v[2] + word(at)) & mask, (v[3] + word(at + 8)) & mask
        stir()
        at += 16
    rest = data[at:]
    v[3] = (v[3] + (len(data) << 56)) & mask
    if rest:
        v[2], v[3] = (v[2] + int.from_bytes(rest[:8], "little")) & mask, (v[3] + int.from_bytes(rest[8:], "little")) & mask
    else:
        v[2], v[3] = (v[2] + SPOOKY) & mask, (v[3] + SPOOKY) & mask
    for i, n in enumerate(SPOOKY_SHORT_END):
        x, y = (i + 3) % 4, (i + 2) % 4
        v[x] ^= v[y]
        v[y] = turn(v[y], n)
        v[x] = (v[x] + v[y]) & mask
    return v[0]


def hive_hash(x) -> int:
    """Text: 31 h + byte over its signed bytes; whole numbers: their halves combined."""
    if isinstance(x, str):
        h = 0
        for b in x.encode():
            h = (31 * h + (b - 256 if b > 127 else b)) & 0xFFFFFFFF
    else:
        x = int(x)
        h = (x ^ (x & (2**64 - 1)) >> 32) & 0xFFFFFFFF
    return h - 2**32 if h >= 2**31 else h


def _signed64(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def bloom_bits(hashed: int, bits: int, hashes: int) -> list[int]:
    """Places of a 64-bit hash in a filter."""
    low, high = hashed & 0xFFFFFFFF, hashed >> 32 & 0xFFFFFFFF
    return [(low + k * high) % bits for k in range(hashes)]


def bloom_filter(values, bits: int = 1 << 16, hashes: int = 5) -> bytes:
    """A filter of up to bits / 10 values for might_contain; its size does not depend on their number."""
    out = bytearray(bits // 8)
    for v in values:
        for b in bloom_bits(xxhash.xxh64_intdigest(_bytes(v), 42), bits, hashes):
            out[b >> 3] |= 1 << (b & 7)
    return bytes(out)


def _might_contain(filter_: bytes, x) -> bool:
    filter_ = bytes(filter_)
    return all(filter_[b >> 3] >> (b & 7) & 1 for b in bloom_bits(xxhash.xxh64_intdigest(_bytes(x), 42), 8 * len(filter_), 5))


NUMERIC = {
    "hash_with_seed": elementwise(lambda seed, x: murmur3(_bytes(x), int(seed)), "int"),
    "xxhash64_with_seed": elementwise(lambda seed, x: _signed64(xxhash.xxh64_intdigest(_bytes(x), int(seed))), "bigint"),
    "hive_hash": elementwise(hive_hash, "int"),
    "might_contain": elementwise(_might_contain, "boolean"),
    "normal_cdf": elementwise(_normal, "double"),
    "beta_cdf": elementwise(lambda a, b, x: incomplete_beta(a, b, x), "double"),
    "inverse_beta_cdf": elementwise(lambda a, b, p: inverse_incomplete_beta(a, b, p), "double"),
    "binomial_cdf": elementwise(_binomial, "double"),
    "chi_squared_cdf": elementwise(lambda k, x: incomplete_gamma(k / 2, x / 2), "double"),
    "f_cdf": elementwise(_f, "double"),
    "gamma_cdf": elementwise(lambda shape, scale, x: incomplete_gamma(shape, x / scale), "double"),
    "poisson_cdf": elementwise(lambda rate, k: 1 - incomplete_gamma(math.floor(k) + 1, rate), "double"),
    "combinations": elementwise(_combinations, "array<array<int>>"),
    "hmac_md5": _hmac("md5"),
    "hmac_sha1": _hmac("sha1"),
    "hmac_sha256": _hmac("sha256"),
    "hmac_sha512": _hmac("sha512"),
    "xxhash64": elementwise(lambda x: xxhash.xxh64_digest(bytes(x)), "binary"),
    "spooky_hash_v2_32": elementwise(lambda x: (spooky(bytes(x)) & 0xFFFFFFFF).to_bytes(4, "big"), "binary"),
    "spooky_hash_v2_64": elementwise(lambda x: spooky(bytes(x)).to_bytes(8, "big"), "binary"),
    "to_ieee754_64": elementwise(lambda x: struct.pack(">d", x), "binary"),
    "from_ieee754_64": elementwise(lambda x: struct.unpack(">d", bytes(x))[0], "double"),
    "to_ieee754_32": elementwise(lambda x: struct.pack(">f", x), "binary"),
}
