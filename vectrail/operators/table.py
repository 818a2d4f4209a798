"""Maintenance of a vector table: upserts, deletions, replacement, lookup, persistence.

Tables are immutable; each call gives a new DataFrame. ``VectorTable`` wraps
one with its parameters and offers batch search over it.
"""

from __future__ import annotations

import json
import logging
from dataclasses import asdict, dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import search

LOG = logging.getLogger(__name__)


@dataclass(frozen=True)
class IndexConfig:
    """Parameters of a vector table and of the graph over it."""

    dim: int
    metric: str = "l2"
    m: int = 16
    ef_construction: int = 200
    ef: int = 10
    seed: int = 100
    shards: int = 8
    max_elements: int = 1 << 40
    allow_replace_deleted: bool = False

    def __post_init__(self) -> None:
        if self.metric not in ("l2", "ip", "cosine"):
            raise ValueError(f"unknown metric {self.metric}")
        if self.m > 10_000:
            LOG.warning("m is capped at 10000")
            object.__setattr__(self, "m", 10_000)
        if self.ef_construction < self.m:
            LOG.warning("ef_construction %d is raised to m", self.ef_construction)
            object.__setattr__(self, "ef_construction", self.m)


def upsert(table: DataFrame, changes: DataFrame) -> DataFrame:
    """``changes`` (id, embedding, version) over ``table`` (id, embedding, deleted): the last version of an id counts and revives it."""
    last = W.partitionBy("id").orderBy(F.col("version").desc())
    new = changes.withColumn("at", F.row_number().over(last)).where("at = 1").select("id", "embedding", F.lit(False).alias("deleted"))
    return table.join(new.select("id"), "id", "left_anti").select("id", "embedding", "deleted").unionByName(new)


def remove(table: DataFrame, ids: DataFrame) -> DataFrame:
    return table.join(ids.select("id").distinct(), "id", "left_anti")


def _checked(table: DataFrame, ids: DataFrame, wanted: bool) -> None:
    state = ids.select("id").distinct().join(table.select("id", "deleted"), "id", "left")
    unknown, same = state.agg(F.count(F.when(F.col("deleted").isNull(), 1)), F.count(F.when(F.col("deleted") == wanted, 1))).first()
    if unknown:
        raise KeyError(f"{unknown} ids are not in the table")
    if same:
        raise ValueError(f"{same} ids are {'already' if wanted else 'not'} deleted")


def set_deleted(table: DataFrame, ids: DataFrame, deleted: bool, check: bool = True) -> DataFrame:
    """Mark or unmark; unknown ids, and ids already in that state, are errors."""
    if check:
        _checked(table, ids, deleted)
    hit = ids.select("id").distinct().withColumn("hit", F.lit(True))
    return table.join(hit, "id", "left").select("id", "embedding", F.when(F.col("hit"), F.lit(deleted)).otherwise(F.col("deleted")).alias("deleted"))


def live(table: DataFrame) -> DataFrame:
    return table.where(~F.col("deleted"))


def replace_deleted(table: DataFrame, new: DataFrame, config: IndexConfig) -> DataFrame:
    """Deleted rows make room for ``new``; which one is replaced has no meaning here, so as many go as come, smallest ids first."""
    if not config.allow_replace_deleted:
        raise ValueError("replacement of deleted elements is disabled")
    incoming = new.count()
    gone = table.where("deleted").select("id").orderBy("id").limit(incoming)
    out = remove(table, gone.unionByName(new.select("id"))).unionByName(new.select("id", "embedding", F.lit(False).alias("deleted")))
    if out.count() > config.max_elements:
        raise ValueError("the number of elements exceeds the limit")
    return out


def fetch(table: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``ids``; one that is missing or deleted is an error when the result is evaluated."""
    got = ids.select("id").join(live(table), "id", "left")
    missing = F.raise_error(F.concat(F.lit("no element "), F.col("id").cast("string"))).cast("boolean")
    return got.where(F.when(F.col("embedding").isNull(), missing).otherwise(F.lit(True))).select("id", "embedding")


def stats(table: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    return table.agg(n.alias("elements"), F.coalesce(F.sum(F.col("deleted").cast("bigint")), F.lit(0)).cast("bigint").alias("deleted"), (n - F.coalesce(F.sum(F.col("deleted").cast("bigint")), F.lit(0))).cast("bigint").alias("alive"))


@dataclass(frozen=True)
class VectorTable:
    """A table of vectors (id, embedding, deleted) with its configuration."""

    rows: DataFrame
    config: IndexConfig

    @classmethod
    def of(cls, vectors: DataFrame, config: IndexConfig) -> VectorTable:
        """Rows whose vector is null or of another dimension are dropped."""
        fit = vectors.where((F.size("embedding") == config.dim) & ~F.exists("embedding", lambda x: x.isNull()))
        return cls(fit.select("id", "embedding", F.lit(False).alias("deleted")), config)

    def with_rows(self, rows: DataFrame) -> VectorTable:
        return replace(self, rows=rows)

    def add_items(self, changes: DataFrame) -> VectorTable:
        known = changes if "version" in changes.columns else changes.withColumn("version", F.lit(0))
        out = self.with_rows(upsert(self.rows, known))
        if out.rows.count() > self.config.max_elements:
            raise ValueError("the number of elements exceeds the limit")
        return out

    def replace_items(self, new: DataFrame) -> VectorTable:
        return self.with_rows(replace_deleted(self.rows, new, self.config))

    def mark_deleted(self, ids: DataFrame) -> VectorTable:
        return self.with_rows(set_deleted(self.rows, ids, True))

    def unmark_deleted(self, ids: DataFrame) -> VectorTable:
        return self.with_rows(set_deleted(self.rows, ids, False))

    def get_items(self, ids: DataFrame) -> DataFrame:
        return fetch(self.rows, ids)

    def ids(self) -> DataFrame:
        return live(self.rows).select("id")

    def resize(self, max_elements: int) -> VectorTable:
        if max_elements < self.rows.count():
            raise ValueError("the new limit is below the number of elements")
        return replace(self, config=replace(self.config, max_elements=max_elements))

    def set_ef(self, ef: int) -> VectorTable:
        return replace(self, config=replace(self.config, ef=ef))

    def knn_query(self, queries: DataFrame, k: int = 1, filter: str | None = None) -> DataFrame:  # noqa: A002
        """The ``k`` nearest live rows per query, among those for which the SQL condition ``filter`` on id holds."""
        base = live(self.rows)
        return search.top_k(base.where(filter) if filter else base, queries, k, self.config.metric)

    def within(self, queries: DataFrame, radius: float, most: int) -> DataFrame:
        return search.within_radius(live(self.rows), queries, radius, most, self.config.metric)

    def counts(self) -> DataFrame:
        return stats(self.rows)

    def save(self, path: str) -> None:
        spark = self.rows.sparkSession
        self.rows.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(self.config.shards)).cast("int")).write.mode("overwrite").partitionBy("shard").parquet(f"{path}/vectors")
        spark.createDataFrame([(json.dumps(asdict(self.config)),)], "config string").coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")

    @classmethod
    def load(cls, spark: SparkSession, path: str, max_elements: int | None = None) -> VectorTable:
        """Columns other than those saved are an error, as is a limit below the number of rows."""
        meta = spark.read.parquet(f"{path}/meta").first()
        if meta is None:
            raise ValueError(f"{path} has no index")
        config = IndexConfig(**json.loads(meta["config"]))
        rows = spark.read.parquet(f"{path}/vectors")
        if not {"id", "embedding", "deleted"} <= set(rows.columns):
            raise ValueError(f"{path} is not a vector table")
        table = cls(rows.select("id", "embedding", "deleted"), config)
        return table if max_elements is None else table.resize(max_elements)
