"""Scans and sinks: semicolon CSV, settings files, result files, mask caches, vector blobs."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import tokens


def rows(spark: SparkSession, path: str, columns: int) -> DataFrame:
    """Columns c0, c1, … of a semicolon file with a header line, all strings."""
    schema = ", ".join(f"c{i} string" for i in range(columns))
    return spark.read.csv(path, sep=";", header=True, schema=schema, quote="", enforceSchema=True)


def vector(text: Column) -> Column:
    """A comma list of numbers in optional brackets; elements that aren't numbers become null, '' and 'null' a null vector."""
    bare = F.trim(F.regexp_replace(text, r"[\[\]\"]", ""))
    parts = F.transform(F.split(bare, ","), lambda x: F.trim(x).try_cast("float"))
    return F.when(bare.isNull() | (bare == "") | (F.lower(bare) == "null"), None).otherwise(parts)


def fitting(df: DataFrame, dim: int, column: str = "embedding") -> DataFrame:
    """Rows whose vector has ``dim`` elements, none of them null."""
    return df.where((F.size(column) == dim) & ~F.exists(column, lambda x: x.isNull()))


def numbered(df: DataFrame, name: str = "id") -> DataFrame:
    """``df`` with the number of each line, from 0 on: its place in its split plus the lines of the splits before, which a first pass counts."""
    split = F.shiftright(F.monotonically_increasing_id(), 33)
    sizes = {r["p"]: r["count"] for r in df.select(split.alias("p")).groupBy("p").count().collect()}
    before, upto = {}, 0
    for p in sorted(sizes):
        before[p], upto = upto, upto + sizes[p]
    if not before:
        return df.select(F.lit(0).cast("bigint").alias(name), "*")
    offset = F.create_map(*[x for p, n in before.items() for x in (F.lit(p).cast("bigint"), F.lit(n).cast("bigint"))])
    at = F.monotonically_increasing_id()
    return df.select((offset[F.shiftright(at, 33)] + at.bitwiseAND(F.lit((1 << 33) - 1).cast("bigint"))).alias(name), "*")


def _named(df: DataFrame, layout: dict[str, int], id_column: int | None, **parse) -> DataFrame:
    items = [parse[n](F.col(f"c{i}")).alias(n) for n, i in layout.items()]
    if id_column is not None:
        return df.select(F.col(f"c{id_column}").cast("bigint").alias("id"), *items)
    return numbered(df).select("id", *items)


def _int_or_zero(c: Column) -> Column:
    return F.coalesce(F.trim(c).try_cast("int"), F.lit(0))


PARSERS = {"embedding": vector, "attrs": tokens, "value": _int_or_zero, "strict_value": lambda c: c.cast("int"), "lo": _int_or_zero, "hi": _int_or_zero}


def scan(spark: SparkSession, path: str, columns: int, layout: dict[str, int], dim: int | None = None, id_column: int | None = None) -> DataFrame:
    """Without ``id_column`` the number of the line is the id, so files that describe the same rows line by line join on it.

    ``layout`` names the columns: embedding, attrs, value (bad numbers 0), strict_value (bad numbers fail), lo, hi.

    With ``dim``, rows whose vector doesn't fit are dropped.
    """
    df = _named(rows(spark, path, columns), layout, id_column, **PARSERS)
    return fitting(df, dim) if dim is not None else df


LAYOUTS: dict[str, tuple[int, dict[str, int]]] = {
    "dataset": (7, {"embedding": 1, "attrs": 3}),
    "point_metadata": (1, {"attrs": 0}),
    "point_queries": (7, {"embedding": 1, "attrs": 3}),
    "cluster_metadata": (5, {"embedding": 1, "attrs": 3}),
    "range_metadata": (2, {"embedding": 0, "strict_value": 1}),
    "range_queries": (3, {"embedding": 0, "lo": 1, "hi": 2}),
    "and_metadata": (3, {"embedding": 0, "attrs": 1, "value": 2}),
    "and_queries": (4, {"embedding": 0, "attrs": 1, "lo": 2, "hi": 3}),
    "or_metadata": (7, {"embedding": 1, "attrs": 3, "value": 5}),
    "or_queries": (6, {"embedding": 1, "lo": 3, "hi": 4, "attrs": 5}),
    "creation": (3, {"attrs": 1, "embedding": 2}),
}


def scan_layout(spark: SparkSession, path: str, kind: str, dim: int | None = None) -> DataFrame:
    columns, layout = LAYOUTS[kind]
    return scan(spark, path, columns, layout, dim)


def settings(path: str) -> dict[str, str]:
    """``KEY value`` lines; ``#`` starts a comment."""
    found = {}
    for line in Path(path).read_text().splitlines():
        parts = line.split("#", 1)[0].split(None, 1)
        if len(parts) == 2:
            found[parts[0]] = parts[1].strip()
    return found


def int_list(text: str) -> list[int]:
    return [int(x) for x in text.replace("[", "").replace("]", "").split(",") if x.strip()]


def write_results(results: DataFrame, path: str, ranked: bool = True) -> None:
    """(ef, query_id, id, dist, rank) as CSV files ``ID,Distance`` in a folder per ef and query."""
    out = results.orderBy("ef", "query_id", "rank") if ranked else results
    out.select("ef", "query_id", F.col("id").alias("ID"), F.col("dist").alias("Distance")).write.mode("overwrite").partitionBy("ef", "query_id").csv(path, header=True)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    read = spark.read.csv(path, header=True, schema="ID bigint, Distance double, ef int, query_id bigint")
    return read.select("ef", "query_id", F.col("ID").alias("id"), F.col("Distance").alias("dist")).where(F.col("id") >= 0)


def with_sentinels(results: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Queries without a result get ``k`` rows of id -1 and the largest float, as old readers expect."""
    empty = queries.select("query_id").join(results.select("query_id").distinct(), "query_id", "left_anti")
    filler = empty.select("query_id", F.lit(-1).cast("bigint").alias("id"), F.lit(3.4028234663852886e38).alias("dist"), F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(k).cast("bigint"))).alias("rank"))
    return results.select("query_id", "id", "dist", "rank").unionByName(filler)


def mask_path(folder: str, queries: DataFrame, where: str) -> str:
    """Where the masks of this batch of queries are kept: a name that changes with the batch."""
    digest = queries.agg(F.sum(F.xxhash64(*queries.columns).cast("decimal(38,0)"))).first()[0]
    return f"{folder}/{where}-{hashlib.sha1(str(digest).encode()).hexdigest()[:16]}"


def save_masks(masks: DataFrame, path: str) -> None:
    masks.select("query_id", "id").write.mode("overwrite").parquet(path)


def load_masks(spark: SparkSession, path: str, queries: int | None = None) -> DataFrame:
    """Masks written before; an error if they hold more queries than expected."""
    held = spark.read.schema("query_id bigint, id bigint").parquet(path)
    if queries is not None and held.select("query_id").distinct().count() > queries:
        raise ValueError(f"{path} is of another batch of queries")
    return held


def read_blobs(spark: SparkSession, path: str, kind: str, dim: int | None = None) -> DataFrame:
    """(file, id, embedding) from binary vector files: ``bvecs``/``ivecs``/``fvecs`` prefix each row with its length, ``raw`` is float32 of ``dim``."""
    item = {"bvecs": np.uint8, "ivecs": np.int32, "fvecs": np.float32, "raw": np.float32}[kind]

    def parse(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for name, content in zip(pdf["path"], pdf["content"]):
                raw = bytes(content)
                if kind == "raw":
                    x = np.frombuffer(raw, item).reshape(-1, dim)
                else:
                    d = struct.unpack_from("<i", raw)[0] if raw else 1
                    x = np.frombuffer(raw, np.uint8).reshape(-1, 4 + d * np.dtype(item).itemsize)[:, 4:].copy().view(item)
                yield pd.DataFrame({"file": name, "id": np.arange(len(x)), "embedding": x.astype(np.float32).tolist()})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(parse, "file string, id bigint, embedding array<float>")
