"""Exact URL list membership by a cascade of Bloom filters, without a join.

The complete key universe of the corpus is split into listed keys R and the
rest S. Level 1 encodes R; the members of S that it passes wrongly are encoded
in level 2, the members of R that level 2 passes wrongly in level 3, and so on
until a level passes nothing wrongly. A key of the universe is listed exactly
if the first level that doesn't hold it is even. Levels after the first have a
rate of 1/2, the first one of ``|R| * sqrt(0.5) / |S|``, so the whole cascade
takes a few bits per listed key.

Keys are spread over shards by hash; each shard builds its own cascade in one
group, so a shard's size, not the corpus's, bounds memory.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise

BLOCKED_HOST_TERMS = ("adult", "casino", "cheap-pills", "spam", "ads-track", "free-")
KEYS_PER_SHARD = 2_000_000
BROADCAST_LIMIT = 64 << 20


def canonical_key(url: Column) -> Column:
    """Host in lower case without ``www.``, then path and query without campaign parameters, fragment and final slash."""
    bare = F.regexp_replace(F.regexp_replace(url, "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(bare, "^([^/?]*)", 1)), r"^www\.", "")
    rest = F.regexp_replace(F.regexp_replace(bare, "^[^/?]*", ""), "[?&]utm_[a-z]+=[^&]*", "")
    return F.concat(host, F.regexp_replace(rest, "/$", ""))


def canonical_key_sql(url: str) -> str:
    bare = f"regexp_replace(regexp_replace({url}, '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '')"
    host = f"regexp_replace(lower(regexp_extract({bare}, '^([^/?]*)', 1)), '^www\\.', '')"
    rest = f"regexp_replace(regexp_replace({bare}, '^[^/?]*', ''), '[?&]utm_[a-z]+=[^&]*', '', 'g')"
    return f"({host} || regexp_replace({rest}, '/$', ''))"


def blocked_host(key: Column, terms: tuple[str, ...] = BLOCKED_HOST_TERMS) -> Column:
    """Whether the host holds one of ``terms``, taken literally; with no terms, none does."""
    host, found = F.regexp_extract(key, "^([^/?]*)", 1), F.lit(False)
    for t in terms:
        found = found | F.contains(host, F.lit(t))
    return found


def hashes(key: Column) -> list[Column]:
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("second"), key).alias("h2")]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _positions(h1: np.ndarray, h2: np.ndarray, level: int, bits: int, k: int) -> Iterator[np.ndarray]:
    salt = np.uint64((level * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    a, b = _mix(h1 ^ salt), _mix(h2 + salt) | np.uint64(1)
    for i in range(k):
        yield (a + np.uint64(i) * b) % np.uint64(bits)


def _holds(level: int, bits: int, k: int, field: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    found = np.ones(len(h1), bool)
    for at in _positions(h1, h2, level, bits, k):
        found &= (field[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return found


Level = tuple[int, int, np.ndarray]


def build_levels(h1: np.ndarray, h2: np.ndarray, listed: np.ndarray) -> list[Level]:
    """The levels for one universe; each is (bits, hash count, bit field)."""
    inside, outside, levels = (h1[listed], h2[listed]), (h1[~listed], h2[~listed]), []
    while len(inside[0]):
        rate = 0.5 if levels or not len(outside[0]) else min(0.5, len(inside[0]) * math.sqrt(0.5) / len(outside[0]))
        k = max(1, round(math.log2(1 / rate)))
        bits = 8 * math.ceil(max(64, len(inside[0]) * math.log2(1 / rate) / math.log(2)) / 8)
        field = np.zeros(bits // 8, np.uint8)
        for at in _positions(*inside, len(levels), bits, k):
            np.bitwise_or.at(field, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
        wrong = _holds(len(levels), bits, k, field, *outside)
        levels.append((bits, k, field))
        inside, outside = (outside[0][wrong], outside[1][wrong]), inside
    return levels


def is_listed(levels: list[Level], h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    depth, alive = np.zeros(len(h1), np.int64), np.ones(len(h1), bool)
    for i, (bits, k, field) in enumerate(levels):
        at = np.flatnonzero(alive)
        if not len(at):
            break
        found = _holds(i, bits, k, field, h1[at], h2[at])
        depth[at[found]] = i + 1
        alive[at[~found]] = False
    return depth % 2 == 1


def pack(levels: list[Level]) -> bytes:
    return b"".join(struct.pack("<qq", bits, k) + field.tobytes() for bits, k, field in levels)


def unpack(blob: bytes) -> list[Level]:
    levels, at = [], 0
    while at < len(blob):
        bits, k = struct.unpack_from("<qq", blob, at)
        levels.append((bits, k, np.frombuffer(blob, np.uint8, bits // 8, at + 16)))
        at += 16 + bits // 8
    return levels


def build_cascade(universe: DataFrame, keys_per_shard: int = KEYS_PER_SHARD) -> tuple[DataFrame, int]:
    """``universe``: (h1, h2, listed), a row per distinct key. Gives (shard, cascade) rows and the number of shards."""
    shards = max(1, math.ceil(universe.count() / keys_per_shard))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        ordered = pdf.sort_values(["h1", "h2"])
        h1, h2 = (ordered[c].to_numpy(np.int64).view(np.uint64) for c in ("h1", "h2"))
        return pd.DataFrame({"shard": [int(pdf["shard"].iloc[0])], "cascade": [pack(build_levels(h1, h2, ordered["listed"].to_numpy(bool)))]})

    sharded = universe.withColumn("shard", F.pmod("h1", F.lit(shards)).cast("int"))
    return sharded.groupBy("shard").applyInPandas(one, "shard int, cascade binary"), shards


def test_membership(keys: DataFrame, cascade: DataFrame, shards: int, broadcast_limit: int = BROADCAST_LIMIT) -> DataFrame:
    """``keys`` with columns h1, h2 (null: not listed) gets ``listed`` in place of them.

    The cascade is broadcast while it is under ``broadcast_limit`` bytes.
    Beyond, each shard's keys meet their own part of the cascade in a cogroup.
    """
    out = [F.col(f"`{c}`") for c in keys.columns if c not in ("h1", "h2")]
    total = cascade.select(F.sum(F.length("cascade"))).first()[0] or 0
    if total <= broadcast_limit:
        parts = keys.sparkSession.sparkContext.broadcast({r["shard"]: bytes(r["cascade"]) for r in cascade.collect()})

        @F.pandas_udf("boolean")
        def flag(h1: pd.Series, h2: pd.Series) -> pd.Series:
            return pd.Series(_flags(h1, h2, parts.value, shards))

        return keys.select(*out, F.coalesce(flag("h1", "h2"), F.lit(False)).alias("listed"))

    schema = ", ".join(f"`{n}` {t}" for n, t in keys.dtypes if n not in ("h1", "h2"))

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        blobs = {int(r.shard): bytes(r.cascade) for r in right.itertuples()}
        return left.drop(columns=["h1", "h2", "shard"]).assign(listed=_flags(left["h1"], left["h2"], blobs, shards))

    sharded = keys.withColumn("shard", F.coalesce(F.pmod("h1", F.lit(shards)).cast("int"), F.lit(0)))
    return sharded.groupBy("shard").cogroup(cascade.groupBy("shard")).applyInPandas(meet, f"{schema}, listed boolean")


_UNPACKED: dict[tuple[int, int], list[Level]] = {}


def _flags(h1: pd.Series, h2: pd.Series, blobs: dict[int, bytes], shards: int) -> np.ndarray:
    known = (h1.notna() & h2.notna()).to_numpy()
    a, b = (x[known].to_numpy(np.int64) for x in (h1, h2))
    found = np.zeros(len(a), bool)
    shard = a % shards
    for s in np.unique(shard):
        blob = blobs.get(int(s), b"")
        key = (int(s), hash(blob))
        if key not in _UNPACKED:
            if len(_UNPACKED) > 64:
                _UNPACKED.clear()
            _UNPACKED[key] = unpack(blob)
        at = shard == s
        found[at] = is_listed(_UNPACKED[key], a[at].view(np.uint64), b[at].view(np.uint64))
    flags = np.zeros(len(h1), bool)
    flags[known] = found
    return flags


def flag_listed(pages: DataFrame, page_id: str = "page_id", url: str = "url", terms: tuple[str, ...] = BLOCKED_HOST_TERMS, listed: DataFrame | None = None, keys_per_shard: int = KEYS_PER_SHARD, broadcast_limit: int = BROADCAST_LIMIT) -> DataFrame:
    """One row per page: ``page_id``, ``url_key`` and ``listed``.

    The list is ``listed`` (a column ``url``), or else the keys of the corpus
    whose host holds one of ``terms``, literally; without terms nothing is
    listed. Listed keys that the corpus lacks cost nothing. A null URL has a null key and is not listed; '' is a key like any
    other. Pages with equal keys get equal flags; repeated rows are all
    returned. Long URLs are hashed whole. Extra columns are not read, and an
    empty table or list works: the result is empty, or nothing is listed.
    """
    keyed = pages.select(F.col(page_id).alias("__page"), canonical_key(F.col(url)).alias("url_key"))
    hashed = keyed.select("__page", "url_key", *[F.when(F.col("url_key").isNotNull(), h).alias(n) for h, n in zip(hashes(F.col("url_key")), ("h1", "h2"))])
    here = hashed.where(F.col("h1").isNotNull())
    if listed is None:
        marks = here.select("h1", "h2", blocked_host(F.col("url_key"), terms).alias("listed"), F.lit(True).alias("here"))
    else:
        wanted = listed.select(canonical_key(F.col("url")).alias("k")).where(F.col("k").isNotNull()).select(*hashes(F.col("k")), F.lit(True).alias("listed"), F.lit(False).alias("here"))
        marks = here.select("h1", "h2", F.lit(False).alias("listed"), F.lit(True).alias("here")).unionByName(wanted)
    universe = marks.groupBy("h1", "h2").agg(F.max("listed").alias("listed"), F.max("here").alias("here")).where("here").drop("here")
    cascade, shards = build_cascade(materialise(universe, "url-universe"), keys_per_shard)
    flagged = test_membership(hashed, materialise(cascade, "url-cascade"), shards, broadcast_limit)
    return flagged.select(F.col("__page").alias(page_id), "url_key", "listed")


def flag_listed_sql(terms: tuple[str, ...] = BLOCKED_HOST_TERMS) -> str:
    """DuckDB SQL for the rows of :func:`flag_listed`."""
    key = canonical_key_sql("url")
    quoted = [t.replace("'", "''") for t in terms]
    held = " OR ".join(f"contains(regexp_extract(url_key, '^([^/?]*)', 1), '{t}')" for t in quoted) or "false"
    return f"SELECT page_id, url_key, coalesce({held}, false) AS listed FROM (SELECT page_id, {key} AS url_key FROM pages)"
