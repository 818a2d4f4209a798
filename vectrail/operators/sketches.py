"""Per-cluster sketches of attributes and values, and the selectivities read from them.

``membership`` is (id, cluster_id); an id can be in several clusters. A cluster
counts all its members, and ``total`` is their number.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.columns import CMS_ROWS, FINGERPRINTS, bind, clamp01, cms_column, decile, djb2, fingerprint, murmur_halves


def totals(membership: DataFrame) -> DataFrame:
    return membership.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("total"))


def cms_cells(attrs: DataFrame) -> DataFrame:
    """``attrs`` (…, attr) with a row per sketch row: ``row`` and ``col``."""
    cells = bind(djb2(F.col("attr")), lambda h: F.array(*[F.struct(F.lit(r).alias("row"), cms_column(h, r).alias("col")) for r in range(CMS_ROWS)]))
    return attrs.select("*", F.explode(cells).alias("cell")).select("*", "cell.row", "cell.col").drop("cell")


def cms_build(membership: DataFrame, metadata: DataFrame) -> DataFrame:
    """(cluster_id, row, col, cnt, fps): the non-zero cells, each with the smallest fingerprints of its ids."""
    attrs = membership.join(metadata.select("id", F.explode("attrs").alias("attr")), "id")
    cells = cms_cells(attrs.select("cluster_id", "id", "attr"))
    return cells.groupBy("cluster_id", "row", "col").agg(F.count(F.lit(1)).alias("cnt"), F.slice(F.array_sort(F.collect_set(fingerprint(F.col("id")))), 1, FINGERPRINTS).alias("fps"))


def cms_hits(cms: DataFrame, probes: DataFrame) -> DataFrame:
    """``probes`` (…, attr) with the clusters whose estimate isn't 0, that is, that hold all four of the attribute's cells."""
    held = cms_cells(probes).join(cms, ["row", "col"])
    found = held.groupBy(*probes.columns, "cluster_id").agg(F.count(F.lit(1)).alias("cells"), F.min("cnt").cast("bigint").alias("est"), F.min_by("fps", F.struct("cnt", "row")).alias("fps"))
    return found.where(F.col("cells") == CMS_ROWS).drop("cells")


def cms_estimate(cms: DataFrame, probes: DataFrame) -> DataFrame:
    """``probes`` (…, attr) × clusters: the least of the attribute's four cells, the first row on ties; clusters that lack one have 0 and an empty cell."""
    hits = cms_hits(cms, probes)
    every = probes.distinct().crossJoin(cms.select("cluster_id").distinct())
    keys = [*probes.columns, "cluster_id"]
    return every.join(hits, keys, "left").select(*keys, F.coalesce("est", F.lit(0)).cast("bigint").alias("est"), F.coalesce("fps", F.array().cast("array<int>")).alias("fps"))


def cms_bounds(cms: DataFrame, membership: DataFrame) -> DataFrame:
    """The least and largest share of its cluster that any non-zero cell holds."""
    share = cms.join(totals(membership), "cluster_id").select((F.col("cnt") / F.col("total")).alias("share"))
    return share.agg(F.min("share").alias("low"), F.max("share").alias("high"))


def cluster_cdf(membership: DataFrame, metadata: DataFrame) -> DataFrame:
    """(cluster_id, value, cdf) per distinct value; ids without a value are left out."""
    counted = membership.join(metadata.where(F.col("value").isNotNull()).select("id", "value"), "id").groupBy("cluster_id", "value").agg(F.count(F.lit(1)).alias("n"))
    w = W.partitionBy("cluster_id")
    return counted.select("cluster_id", "value", (F.sum("n").over(w.orderBy("value")) / F.sum("n").over(w)).alias("cdf"))


def bottom_k(membership: DataFrame, metadata: DataFrame, k: int = FINGERPRINTS) -> DataFrame:
    """(cluster_id, bucket, fps): fingerprints of the ``k`` ids of smallest 64-bit hash per decile of the cluster's values."""
    placed = membership.join(metadata.select("id", "value"), "id").join(cluster_cdf(membership, metadata), ["cluster_id", "value"])
    hashed = placed.select("cluster_id", decile(F.col("cdf")).alias("bucket"), murmur_halves(F.col("id")).alias("h"))
    rank = F.row_number().over(W.partitionBy("cluster_id", "bucket").orderBy("h.h1", "h.h2"))
    kept = hashed.withColumn("r", rank).where(F.col("r") <= k)
    return kept.groupBy("cluster_id", "bucket").agg(F.array_sort(F.collect_set(F.shiftrightunsigned("h.h1", 16).cast("int"))).alias("fps"))


def linear_model(cdf: DataFrame) -> DataFrame:
    """(cluster_id, x0, x1, slope, intercept): least squares of the CDF; a single value is a step at it."""
    many = F.count(F.lit(1)) > 1
    x = F.col("value").cast("double")
    slope, cut = F.regr_slope("cdf", x), F.regr_intercept("cdf", x)
    return cdf.groupBy("cluster_id").agg(
        F.min(x).alias("x0"), F.max(x).alias("x1"), F.when(many, slope).otherwise(0.0).alias("slope"), F.when(many, cut).otherwise(F.max("cdf")).alias("intercept")
    )


def piecewise_model(cdf: DataFrame, pieces: int = 3) -> DataFrame:
    """Least squares on each of ``pieces`` runs of neighbouring values, earlier runs longer by one where they don't divide."""
    tiled = cdf.withColumn("piece", F.ntile(pieces).over(W.partitionBy("cluster_id").orderBy("value")))
    x = F.col("value").cast("double")
    many = F.count(F.lit(1)) > 1
    return tiled.groupBy("cluster_id", "piece").agg(
        F.min(x).alias("x0"), F.max(x).alias("x1"), F.when(many, F.regr_slope("cdf", x)).otherwise(0.0).alias("slope"), F.when(many, F.regr_intercept("cdf", x)).otherwise(F.max("cdf")).alias("intercept")
    )


def quantile_model(cdf: DataFrame, tau: float = 0.5, rounds: int = 200, eps: float = 1e-6, tolerance: float = 1e-10) -> DataFrame:
    """Quantile regression of each cluster's CDF by iteratively reweighted least squares on the pinball loss."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("value")
        x, y = pdf["value"].to_numpy(float), pdf["cdf"].to_numpy(float)
        slope, cut = 0.0, float(y.max())
        if len(x) > 1:
            weight = np.ones(len(x))
            for _ in range(rounds):
                total, mx, my = weight.sum(), (weight * x).sum(), (weight * y).sum()
                spread = total * (weight * x * x).sum() - mx * mx
                if not spread:
                    break
                new = (total * (weight * x * y).sum() - mx * my) / spread
                shift = (my - new * mx) / total
                moved, slope, cut = abs(new - slope) + abs(shift - cut), new, shift
                rest = y - slope * x - cut
                weight = np.where(rest >= 0, tau, 1 - tau) / np.maximum(np.abs(rest), eps)
                if moved < tolerance:
                    break
        return pd.DataFrame({"cluster_id": pdf["cluster_id"].iloc[:1], "x0": x.min(), "x1": x.max(), "slope": slope, "intercept": cut})

    # few bytes but much work: without a number of its own Spark puts all clusters into one task
    dealt = cdf.repartition(3 * cdf.sparkSession.sparkContext.defaultParallelism, "cluster_id")
    return dealt.groupBy("cluster_id").applyInPandas(one, f"cluster_id {dict(cdf.dtypes)['cluster_id']}, x0 double, x1 double, slope double, intercept double")


def predict(x: Column, x0: Column, x1: Column, slope: Column, intercept: Column) -> Column:
    """CDF of a model clamped to [0, 1]; a model of one value is 0 before it and 1 from it on."""
    return F.when(x0 == x1, F.when(x < x0, 0.0).otherwise(clamp01(intercept))).otherwise(clamp01(slope * x + intercept))


def predict_piecewise(probes: DataFrame, model: DataFrame, x: str) -> DataFrame:
    """``probes`` (cluster_id, …) with ``cdf``: the first piece that ends at or after ``x``, the last one beyond."""
    held = probes.join(model, "cluster_id")
    after = F.struct((F.col(x) > F.col("x1")).cast("int"), F.when(F.col(x) > F.col("x1"), -F.col("piece")).otherwise(F.col("piece")))
    best = F.min_by(predict(F.col(x).cast("double"), F.col("x0"), F.col("x1"), F.col("slope"), F.col("intercept")), after)
    return held.groupBy(*probes.columns).agg(best.alias("cdf"))


def audit(cdf: DataFrame, model: DataFrame) -> DataFrame:
    """(cluster_id, value, actual, predicted, difference)."""
    predicted = predict(F.col("value").cast("double"), F.col("x0"), F.col("x1"), F.col("slope"), F.col("intercept"))
    return cdf.join(model, "cluster_id").select("cluster_id", "value", F.col("cdf").alias("actual"), predicted.alias("predicted")).withColumn("difference", F.abs(F.col("actual") - F.col("predicted")))


def mean_error(audited: DataFrame) -> DataFrame:
    """Mean over clusters of each cluster's mean absolute error."""
    return audited.groupBy("cluster_id").agg(F.avg("difference").alias("mae")).agg(F.avg("mae").alias("mae"), F.count(F.lit(1)).alias("clusters"))


def _best(rows: DataFrame, share: Column) -> DataFrame:
    return rows.groupBy("query_id").agg(F.max(share).alias("popularity"), F.max_by("cluster_id", F.struct(share, -F.col("cluster_id"))).alias("cluster_id"))


def popularity_point(queries: DataFrame, cms: DataFrame, membership: DataFrame) -> DataFrame:
    """(query_id, popularity, cluster_id): the largest estimated share of any query attribute in any cluster, smaller cluster on ties.

    Queries without attributes have popularity 0 and no cluster.
    """
    probes = queries.select("query_id", F.explode("attrs").alias("attr"))
    rows = cms_hits(cms, probes).join(totals(membership), "cluster_id")
    best = _best(rows, F.col("est") / F.col("total"))
    named = best.select("query_id", "popularity", F.when(F.col("popularity") > 0, F.col("cluster_id")).alias("cluster_id"))
    return queries.select("query_id").join(named, "query_id", "left").select("query_id", F.coalesce("popularity", F.lit(0.0)).alias("popularity"), "cluster_id")


def range_mass(queries: DataFrame, model: DataFrame) -> DataFrame:
    """(query_id, cluster_id, mass): predicted share of the cluster's values between the query's bounds; 0 if they cross."""
    at = lambda c: predict(F.col(c).cast("double"), F.col("x0"), F.col("x1"), F.col("slope"), F.col("intercept"))
    met = queries.select("query_id", "lo", "hi").crossJoin(model)
    return met.select("query_id", "cluster_id", F.when(F.col("lo") > F.col("hi"), 0.0).otherwise(F.greatest(F.lit(0.0), at("hi") - at("lo"))).alias("mass"))


def popularity_range(queries: DataFrame, model: DataFrame) -> DataFrame:
    return _best(range_mass(queries, model), F.col("mass"))


def and_overlaps(queries: DataFrame, cms: DataFrame, model: DataFrame, minhash: DataFrame) -> DataFrame:
    """(query_id, cluster_id, attr, common, size): an attribute's fingerprints in a cluster, and how many of them also occur in the deciles between the bounds."""
    at = lambda c: decile(predict(F.col(c).cast("double"), F.col("x0"), F.col("x1"), F.col("slope"), F.col("intercept")))
    attrs = cms_hits(cms, queries.select("query_id", F.explode("attrs").alias("attr")))
    # only clusters that may hold the attribute need their deciles
    bounds = attrs.select("query_id", "cluster_id").distinct().join(queries.select("query_id", "lo", "hi"), "query_id").join(model, "cluster_id").select("query_id", "cluster_id", at("lo").alias("from"), at("hi").alias("to"))
    held = bounds.join(minhash, "cluster_id").where(F.col("bucket").between(F.col("from"), F.col("to")))
    values = held.groupBy("query_id", "cluster_id").agg(F.array_distinct(F.flatten(F.collect_list("fps"))).alias("in_range"))
    none = F.array().cast("array<int>")
    return attrs.join(values, ["query_id", "cluster_id"], "left").select("query_id", "cluster_id", "attr", F.size(F.array_intersect("fps", F.coalesce("in_range", none))).cast("bigint").alias("common"), F.size("fps").cast("bigint").alias("size"))


def popularity_and(queries: DataFrame, cms: DataFrame, model: DataFrame, minhash: DataFrame) -> DataFrame:
    """Share of an attribute's ids whose fingerprints also occur in the deciles between the bounds, in the cluster with most of them.

    Where no cluster has any, the first cluster and attribute stand with 0.
    """
    probes = queries.select("query_id", F.explode("attrs").alias("attr"))
    first = cms.agg(F.min("cluster_id").alias("cluster_id"))
    zero = probes.groupBy("query_id").agg(F.min("attr").alias("attr")).crossJoin(first).select("query_id", "cluster_id", "attr", F.lit(0).cast("bigint").alias("common"), F.lit(0).cast("bigint").alias("size"))
    both = and_overlaps(queries, cms, model, minhash).unionByName(zero)
    rank = W.partitionBy("query_id").orderBy(F.desc("common"), "cluster_id", "attr", F.desc("size"))
    best = both.withColumn("r", F.row_number().over(rank)).where("r = 1")
    return best.select("query_id", "cluster_id", "common", F.when(F.col("size") > 0, F.col("common") / F.col("size")).otherwise(0.0).alias("popularity"))


def popularity_or(queries: DataFrame, cms: DataFrame, membership: DataFrame, model: DataFrame) -> DataFrame:
    """(query_id, point, mass): the best attribute share and the best range mass."""
    point = popularity_point(queries, cms, membership).select("query_id", F.col("popularity").alias("point"))
    mass = popularity_range(queries, model).select("query_id", F.col("popularity").alias("mass"))
    return point.join(mass, "query_id")


def top_clusters(queries: DataFrame, cms: DataFrame, k: int) -> DataFrame:
    """(query_id, cluster_id, est, rank): clusters by the estimated number of rows with any query attribute (the largest over attributes)."""
    est = cms_estimate(cms, queries.select("query_id", F.explode("attrs").alias("attr"))).groupBy("query_id", "cluster_id").agg(F.max("est").alias("est"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("est"), "cluster_id")).cast("bigint")
    return est.withColumn("rank", rank).where(F.col("rank") <= k)


def _gathered(src: np.ndarray, dst: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(id, cluster, is_seed) of the clusters of one shard, in arrays: some 16 bytes an edge and a member, a few times over."""
    ids = np.unique(np.concatenate([np.unique(src), np.unique(dst)]))
    src, dst = np.searchsorted(ids, src).astype(np.int32), np.searchsorted(ids, dst).astype(np.int32)
    dst = dst[np.argsort(src, kind="stable")]
    start = np.append(0, np.cumsum(np.bincount(src, minlength=len(ids)))).tolist()
    seen, last = np.zeros(len(ids), bool), np.full(len(ids), -1, np.int32)
    found: list[np.ndarray] = []
    numbers: list[int] = []
    seeds: list[int] = []
    cluster = held = 0
    for s in range(len(ids)):
        if seen[s]:
            continue
        near = dst[start[s] : start[s + 1]]
        new = np.unique(np.concatenate([[s], near, *[dst[start[d] : start[d + 1]] for d in near.tolist()]]).astype(np.int32))
        new = new[last[new] != cluster]  # last: the newest cluster that an id is in
        last[new], seen[new] = cluster, True
        found.append(new)
        numbers.append(cluster)
        seeds.append(s)
        held += len(new)
        if held >= size:
            cluster, held = cluster + 1, 0
    sizes = list(map(len, found))
    members = np.concatenate([*found, np.zeros(0, np.int32)]).astype(np.int32)
    return ids[members], np.repeat(np.array(numbers, np.int64), sizes), members == np.repeat(np.array(seeds, np.int32), sizes)


def greedy_clusters(edges: DataFrame, size: int, shard: str | None = None) -> DataFrame:
    """(id, cluster_id, is_seed) per shard of ``edges`` (src, dst[, shard]): ids ascending seed 2-hop neighbourhoods that gather until ``size``.

    Clusters overlap; with ``size`` 0 each seed makes its own cluster. What is
    left at the end is the last cluster. The scan is sequential inside a shard;
    cluster ids carry the shard in their upper bits.
    """
    sharded = edges.withColumn("shard", F.col(shard).cast("bigint") if shard else F.lit(0).cast("bigint"))

    def one(key: tuple, table: pa.Table) -> pa.Table:
        ids, numbers, seeds = _gathered(table.column("src").to_numpy(), table.column("dst").to_numpy(), size)
        return pa.table({"id": ids, "cluster_id": numbers + (key[0].as_py() << 32), "is_seed": seeds})

    return sharded.select("shard", "src", "dst").groupBy("shard").applyInArrow(one, "id bigint, cluster_id bigint, is_seed boolean")


def neighbourhood_membership(edges: DataFrame) -> DataFrame:
    """(id, cluster_id) with the least id among a node and its neighbours: a membership that SQL can state too."""
    return edges.groupBy(F.col("src").alias("id")).agg(F.least(F.min("dst"), F.min("src")).alias("cluster_id"))


