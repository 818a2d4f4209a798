"""Neighbour graphs as edge tables: build, prune, check and expand.

``edges`` is (src, dst, dist, ord): the ``ord``-th nearest neighbour of ``src``.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import materialise
from .search import top_k


def knn_graph(base: DataFrame, m: int, metric: str = "l2") -> DataFrame:
    """Exact graph of the ``m`` nearest neighbours of every row."""
    near = top_k(base, base.select(F.col("id").alias("query_id"), "embedding"), m, metric, exclude_self=True)
    return near.select(F.col("query_id").alias("src"), F.col("id").alias("dst"), "dist", F.col("rank").alias("ord"))


def symmetric(edges: DataFrame) -> DataFrame:
    """Edges in both directions, each once."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "dist")
    both = edges.select("src", "dst", "dist").unionByName(back).groupBy("src", "dst").agg(F.min("dist").alias("dist"))
    return both.withColumn("ord", F.row_number().over(W.partitionBy("src").orderBy("dist", "dst")).cast("bigint"))


def prune(edges: DataFrame, vectors: DataFrame, m: int) -> DataFrame:
    """Diversity pruning: a neighbour stays if it is no nearer to any kept one than to the source; at most ``m`` stay.

    Sources with fewer than ``m`` neighbours keep them all.
    """
    edges = materialise(edges, "wide")  # they are read for their number and again for their vectors
    held = edges.join(vectors.select(F.col("id").alias("dst"), "embedding"), "dst")
    # sources travel in batches: a group per source would cost more than its work
    sources = edges.select("src").distinct().count()
    dealt = held.withColumn("batch", F.pmod(F.xxhash64("src"), F.lit(max(1, math.ceil(sources / 512)))))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["src", "dist", "dst"]).reset_index(drop=True)
        x, d, src = np.stack(pdf["embedding"].to_numpy()).astype(np.float64), pdf["dist"].to_numpy(), pdf["src"].to_numpy()
        starts = np.append(np.flatnonzero(np.diff(src, prepend=src[0] - 1)), len(src))
        kept: list[int] = []
        rank: list[int] = []
        for a, b in zip(starts, starts[1:]):
            mine = list(range(a, b)) if b - a < m else []
            if b - a >= m:
                for i in range(a, b):
                    if len(mine) == m:
                        break
                    if not mine or (((x[mine] - x[i]) ** 2).sum(1) >= d[i]).all():
                        mine.append(i)
            kept += mine
            rank += range(1, len(mine) + 1)
        return pdf.iloc[kept][["src", "dst", "dist"]].assign(ord=rank)

    return dealt.groupBy("batch").applyInPandas(one, "src bigint, dst bigint, dist double, ord bigint")


def neighbours_of(edges: DataFrame, ids: list[int]) -> DataFrame:
    return edges.where(F.col("src").isin(ids))


def integrity(edges: DataFrame, vectors: DataFrame) -> DataFrame:
    """One row of counts: edges, self loops, repeated links, links to unknown ids, and the extremes of inbound degree."""
    inbound = vectors.select(F.col("id").alias("dst")).join(edges.groupBy("dst").agg(F.count(F.lit(1)).alias("n")), "dst", "left")
    degrees = inbound.agg(F.min(F.coalesce("n", F.lit(0))).cast("bigint").alias("min_inbound"), F.max(F.coalesce("n", F.lit(0))).cast("bigint").alias("max_inbound"))
    totals = edges.agg(F.count(F.lit(1)).alias("edges"), F.coalesce(F.sum((F.col("src") == F.col("dst")).cast("bigint")), F.lit(0)).cast("bigint").alias("self_loops"))
    repeated = edges.groupBy("src", "dst").count().where("count > 1").agg(F.count(F.lit(1)).alias("repeated"))
    unknown = edges.join(vectors.select(F.col("id").alias("dst")), "dst", "left_anti").agg(F.count(F.lit(1)).alias("unknown"))
    return totals.crossJoin(repeated).crossJoin(unknown).crossJoin(degrees)


def hops(beam: DataFrame, edges: DataFrame, n: int) -> DataFrame:
    """(query_id, id) reached from ``beam`` (query_id, id) in 1 to ``n`` steps. Nodes on the way need not match any predicate."""
    step = edges.select("src", F.col("dst").alias("to"))
    reached, at = [], beam.select("query_id", "id").distinct()
    for _ in range(n):
        at = at.join(step, F.col("id") == F.col("src")).select("query_id", F.col("to").alias("id")).distinct()
        reached.append(at)
    return reduce(DataFrame.unionByName, reached).distinct()


def expand(beam: DataFrame, edges: DataFrame, masks: DataFrame, n: int) -> DataFrame:
    """Reached ids that pass the mask; the mask is applied before any vector is fetched."""
    return hops(beam, edges, n).join(masks.select("query_id", "id"), ["query_id", "id"], "left_semi")


def level(id_column: str, m: int, seed: int = 100):
    """Layer of a node, drawn from a hash of its id: floor(-ln(u) / ln(m))."""
    u = (F.pmod(F.xxhash64(F.lit(seed), F.col(id_column)), F.lit(1 << 52)).cast("double") + 1) / float(1 << 52)
    return F.floor(-F.log(u) / math.log(m)).cast("int")
