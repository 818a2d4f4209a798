"""Recall, selectivity, throughput, and synthetic attributes for experiments."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import materialise
from . import search, sketches
from .index import GraphIndex


def recall_per_query(results: DataFrame, truth: DataFrame, k: int = 10) -> DataFrame:
    """(ef, query_id, match): distinct results among the first ``k`` true ones; queries without results count 0 for every ef."""
    efs = results.select("ef").distinct().crossJoin(truth.select("query_id").distinct())
    hits = results.select("ef", "query_id", "id").distinct().join(truth.where(F.col("rank") <= k).select("query_id", "id"), ["query_id", "id"])
    counted = hits.groupBy("ef", "query_id").agg(F.count(F.lit(1)).alias("match"))
    return efs.join(counted, ["ef", "query_id"], "left").select("ef", "query_id", F.coalesce("match", F.lit(0)).cast("bigint").alias("match"))


def recall_summary(per_query: DataFrame, k: int = 10) -> DataFrame:
    return per_query.groupBy("ef").agg(F.avg(F.col("match") / k).alias("recall"))


def selectivity(matches: DataFrame, queries: DataFrame, rows: int) -> DataFrame:
    """One row: the mean share of rows that match a query. ``matches``: (query_id, id)."""
    per = queries.select("query_id").join(matches.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")), "query_id", "left")
    return per.agg(F.avg(F.coalesce("n", F.lit(0)) / F.lit(float(rows))).alias("selectivity"))


def parse_throughput(lines: DataFrame, column: str = "line") -> DataFrame:
    """The numbers after ``QPS:`` in text lines."""
    found = lines.select(F.explode(F.regexp_extract_all(column, F.lit(r"QPS:\s*([\d.]+)"), F.lit(1))).alias("qps"))
    return found.select(F.col("qps").cast("double").alias("qps"))


def mixed(c: Column, seed: int) -> Column:
    """A reproducible shuffle key in integer arithmetic that other engines have too."""
    step = lambda x, a, b: F.pmod(x * F.lit(a).cast("bigint") + F.lit(b).cast("bigint"), F.lit(2147483647).cast("bigint"))
    return step(step(F.pmod(c.cast("bigint"), F.lit(2147483647).cast("bigint")), 48271, seed), 69621, 11)


def by_share(rows: DataFrame, shares: list[tuple[int, float]], seed: int = 1, key: str = "id") -> DataFrame:
    """Each row gets one of the values, in the given shares, by its place in a shuffle of the ids."""
    place = (F.row_number().over(W.orderBy(mixed(F.col(key), seed), key)) - 1) / F.count(F.lit(1)).over(W.partitionBy())
    value, upto = None, 0.0
    for v, share in shares:
        upto += share
        value = F.when(place < round(upto, 9), v) if value is None else value.when(place < round(upto, 9), v)
    return rows.select(key, value.otherwise(shares[-1][0]).alias("value"))


def query_lists(rows: DataFrame, queries: DataFrame, share: int = 10, seed: int = 1) -> DataFrame:
    """(id, queries): which queries each row was dealt to, one in ``share`` at random."""
    met = rows.select("id").crossJoin(queries.select("query_id")).where(F.pmod(mixed(F.col("id") * 1009 + F.col("query_id"), seed), F.lit(share)) == 0)
    return met.groupBy("id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("query_id")), lambda x: x.cast("string")), ",").alias("queries"))


def value_distribution(rows: DataFrame, value: str) -> DataFrame:
    counted = rows.groupBy(value).agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("percent", F.round(100 * F.col("n") / F.sum("n").over(W.partitionBy()), 6))


def correlation_attach(farthest: DataFrame) -> DataFrame:
    """(id, queries): for each row the queries that it is among the farthest of, as a comma list."""
    return farthest.groupBy("id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("query_id")), lambda x: x.cast("string")), ",").alias("queries"))


def sweep(index: GraphIndex, base: DataFrame, queries: DataFrame, k: int, efs: tuple[int, ...], where: str = "none", mode: str = "plain") -> list[dict[str, float]]:
    """Seconds, queries a second and recall of one batch of ``queries`` per ef, then of the exact search, which gives the truth."""
    n = queries.count()
    began = time.monotonic()
    truth = materialise(search.top_k(base, queries, k, index.config.metric, where, exclude_self=True), "truth")
    exact = time.monotonic() - began
    out = []
    for ef in efs:
        began = time.monotonic()
        found = materialise(index.search(queries, k, ef, where, mode, exclude_self=True).select(F.lit(ef).alias("ef"), "query_id", "id"), "found")
        took = time.monotonic() - began
        recall = recall_summary(recall_per_query(found, truth, k), k).first()
        out.append({"ef": ef, "seconds": round(took, 3), "qps": round(n / took, 1), "recall": round(recall["recall"], 4) if recall else 0.0})
    return [*out, {"ef": 0, "seconds": round(exact, 3), "qps": round(n / exact, 1), "recall": 1.0}]


def reaching(points: DataFrame, least: float = 0.8) -> DataFrame:
    """Of (method, ef, recall, qps) the points with at least the given recall, in the order of ef."""
    return points.where(F.col("recall") >= least).orderBy("method", "ef")


def compare_models(cdf: DataFrame, tau: float = 0.5) -> DataFrame:
    """(kind, mae, clusters): the mean over clusters of each model's mean error on a CDF: one line, three, and a quantile line."""
    lines = sketches.piecewise_model(cdf)
    probes = cdf.select("cluster_id", "value", F.col("cdf").alias("actual"))
    piecewise = sketches.predict_piecewise(probes, lines, "value").withColumn("difference", F.abs(F.col("actual") - F.col("cdf")))
    of = lambda audited, kind: sketches.mean_error(audited).select(F.lit(kind).alias("kind"), "mae", "clusters")
    linear = of(sketches.audit(cdf, sketches.linear_model(cdf)), "linear")
    quantile = of(sketches.audit(cdf, sketches.quantile_model(cdf, tau)), "quantile")
    return linear.unionByName(of(piecewise, "piecewise")).unionByName(quantile)


def curve(rows: DataFrame, kind: str, seed: int = 1, most: int = 1000, key: str = "id") -> DataFrame:
    """(id, value) along a synthetic distribution of the ids: ``uniform``, ``exponential``, ``normal`` or ``steps``."""
    u = (mixed(F.col(key), seed) + 0.5) / F.lit(2147483647.0)
    v = (mixed(F.col(key), seed + 1) + 0.5) / F.lit(2147483647.0)
    value = {
        "uniform": u * most,
        "exponential": F.least(F.lit(float(most)), -F.log(u) * most / 6),
        "normal": F.least(F.lit(float(most)), F.greatest(F.lit(0.0), most / 2 + most / 8 * F.sqrt(-2 * F.log(u)) * F.cos(2 * 3.141592653589793 * v))),
        "steps": F.floor(u * 5) * most / 5,
    }[kind]
    return rows.select(key, F.floor(value).cast("int").alias("value"))


def by_count(rows: DataFrame, counts: dict[int, int], otherwise: int = 0, seed: int = 1, key: str = "id") -> DataFrame:
    """(id, value): value v for exactly ``counts[v]`` rows, in the order of a shuffle of the ids; ``otherwise`` for the rest."""
    wanted = sum(counts.values())
    first = rows.select(key, mixed(F.col(key), seed).alias("m")).orderBy("m", key).limit(wanted)
    place = F.row_number().over(W.orderBy("m", key))
    value, upto = None, 0
    for v, n in counts.items():
        upto += n
        value = F.when(F.col("r") <= upto, v) if value is None else value.when(F.col("r") <= upto, v)
    chosen = first.withColumn("r", place).select(F.col(key).alias("c_id"), (value if value is not None else F.lit(otherwise)).alias("v"))
    return rows.join(F.broadcast(chosen) if wanted < 1_000_000 else chosen, F.col(key) == F.col("c_id"), "left").select(key, F.coalesce("v", F.lit(otherwise)).alias("value"))
