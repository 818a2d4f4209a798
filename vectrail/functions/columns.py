"""Column expressions: distances, hashes, tokens and small numeric helpers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

U32 = 0xFFFFFFFF
MURMUR_M = 0x5BD1E995

CMS_ROWS, CMS_WIDTH, CMS_PRIME = 4, 1000, 4294967311
CMS_A = (73856093, 19349663, 83492791, 15485863)
CMS_B = (83492791, 73856093, 19349663, 32452843)
FINGERPRINTS = 1000


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once."""
    return F.transform(F.array(value), use)[0]


def _zip_sum(a: Column, b: Column, term: Callable[[Column, Column], Column]) -> Column:
    pairs = F.zip_with(a, b, lambda x, y: term(x.cast("double"), y.cast("double")))
    return F.aggregate(pairs, F.lit(0.0), lambda acc, v: acc + v)


def l2(a: Column, b: Column) -> Column:
    """Squared Euclidean distance, summed in double."""
    return _zip_sum(a, b, lambda x, y: (x - y) * (x - y))


def inner_product(a: Column, b: Column) -> Column:
    return 1.0 - _zip_sum(a, b, lambda x, y: x * y)


def cosine(a: Column, b: Column) -> Column:
    """1 minus the cosine; 1 if either vector is zero."""
    dot = _zip_sum(a, b, lambda x, y: x * y)
    scale = F.sqrt(_zip_sum(a, a, lambda x, y: x * y) * _zip_sum(b, b, lambda x, y: x * y))
    return F.when(scale > 0, 1.0 - dot / scale).otherwise(1.0)


def l2_bytes(a: Column, b: Column) -> Column:
    """Squared distance of small unsigned integers in integer arithmetic."""
    pairs = F.zip_with(a, b, lambda x, y: (x.cast("bigint") - y.cast("bigint")) * (x.cast("bigint") - y.cast("bigint")))
    return F.aggregate(pairs, F.lit(0).cast("bigint"), lambda acc, v: acc + v)


METRICS: dict[str, Callable[[Column, Column], Column]] = {"l2": l2, "ip": inner_product, "cosine": cosine}


def normalised(v: Column) -> Column:
    return bind(F.struct(v.alias("v"), F.sqrt(_zip_sum(v, v, lambda x, y: x * y)).alias("n")), lambda s: F.transform(s["v"], lambda x: F.when(s["n"] > 0, x / s["n"]).otherwise(0.0)))


def djb2(s: Column) -> Column:
    """32-bit djb2 over the UTF-8 bytes, each taken as a signed char."""
    hexed = F.hex(F.encode(s, "utf-8"))
    last = F.octet_length(s).cast("int")
    numbers = F.transform(F.sequence(F.lit(0), last - 1), lambda i: F.conv(F.substr(hexed, 2 * i + 1, F.lit(2)), 16, 10).cast("bigint"))
    step = lambda h, c: (h * 33 + F.when(c > 127, c - 256).otherwise(c)).bitwiseAND(F.lit(U32).cast("bigint"))
    return F.when(last == 0, F.lit(5381).cast("bigint")).otherwise(F.aggregate(numbers, F.lit(5381).cast("bigint"), step))


def _u32(c: Column) -> Column:
    return c.bitwiseAND(F.lit(U32).cast("bigint"))


def _mul(c: Column) -> Column:
    return _u32(c * F.lit(MURMUR_M).cast("bigint"))


def _shift_xor(a: Column, b: Column, n: int) -> Column:
    return a.bitwiseXOR(F.shiftrightunsigned(b, n))


def murmur_halves(i: Column, seed: int = 42) -> Column:
    """MurmurHash64B of a 4-byte integer as struct(h1, h2): its upper and lower 32 bits."""
    k = bind(_mul(_u32(i.cast("bigint"))), lambda k: _mul(_shift_xor(k, k, 24)))
    start = F.lit(((seed ^ 4) * MURMUR_M) & U32).cast("bigint")
    h1 = start.bitwiseXOR(k)
    s1 = bind(_mul(h1), lambda a: F.struct(a.alias("a"), _mul(F.shiftrightunsigned(a, 22)).alias("b")))
    s2 = bind(s1, lambda s: F.struct(_mul(_shift_xor(s["a"], s["b"], 17)).alias("a"), s["b"].alias("b")))
    return bind(s2, lambda s: F.struct(s["a"].alias("h1"), _mul(_shift_xor(s["b"], s["a"], 19)).alias("h2")))


def fingerprint(i: Column) -> Column:
    """The upper 16 bits of the id's hash."""
    return F.shiftrightunsigned(murmur_halves(i)["h1"], 16).cast("int")


def cms_column(hash32: Column, row: int) -> Column:
    """Cell of a 32-bit hash in one row of the count-min sketch."""
    # the product of two 32-bit numbers can pass 63 bits, so it is reduced in two halves
    high = F.shiftrightunsigned(hash32, 16) * F.lit(CMS_A[row]).cast("bigint") % F.lit(CMS_PRIME).cast("bigint")
    low = hash32.bitwiseAND(F.lit(0xFFFF).cast("bigint")) * F.lit(CMS_A[row]).cast("bigint")
    rest = _u32((high * F.lit(65536).cast("bigint") + low) % F.lit(CMS_PRIME).cast("bigint"))
    return (_u32(rest + F.lit(CMS_B[row]).cast("bigint")) % F.lit(CMS_WIDTH).cast("bigint")).cast("int")


def tokens(s: Column) -> Column:
    """Comma-separated attributes: quotes dropped, trimmed, lower case, empty ones removed; null gives none."""
    parts = F.split(F.lower(F.regexp_replace(F.coalesce(s, F.lit("")), "[\"']", "")), ",")
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")


def floats(s: Column) -> Column:
    """Comma-separated numbers; what isn't a number becomes null."""
    return F.transform(F.split(s, ","), lambda x: F.trim(x).try_cast("float"))


def decile(p: Column) -> Column:
    return F.least(F.floor(p * 10).cast("int"), F.lit(10))


def clamp01(c: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))


def dynamic_threshold(ef: Column, low: Column, high: Column, most: int = 1300) -> Column:
    """Threshold that rises with the logarithm of the search width, and ``low`` where ``high`` isn't above it."""
    part = F.log1p(F.least(ef, F.lit(most)).cast("double")) / F.log1p(F.lit(float(most)))
    return F.when(high <= low, low).otherwise(low + part * (high - low))
