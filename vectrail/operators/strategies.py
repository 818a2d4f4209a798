"""Filtered approximate search over a stored graph index: traversal inside shards, and sketch-guided expansion around an unfiltered beam.

Two families. Traversals walk each shard's graph with the predicate in hand.
Post-filter searches take an unfiltered beam, keep what matches and widen
around each beam node by one or two hops, as the sketches of its clusters
advise; attributes are fetched for reached ids only. Queries that end up with
fewer than ``k`` results are finished by a traversal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.columns import dynamic_threshold, l2
from ..session import materialise
from . import sketches
from .graph import hops
from .index import GraphIndex
from .search import predicate, ranked

#: Share of a cluster from which on its neighbourhood is worth two hops, and the mass that does it for OR.
THRESHOLDS = {"point": 0.08, "range": 0.5, "and": 0.2, "or": 0.1}
OR_MASS = 0.336
#: A query with this many times ``k`` matches in its beam is not widened.
ENOUGH = 2
#: Value buckets that a range is cut into.
BUCKET = 64


def ann_knn(index: GraphIndex, queries: DataFrame, k: int, ef: int, **how) -> DataFrame:
    """(query_id, id, dist, rank): the ``k`` nearest that beams of ``ef`` find in each shard."""
    return index.search(queries, k, ef, exclude_self=True, **how).select("query_id", "id", "dist", "rank")


def ann_beam(index: GraphIndex, queries: DataFrame, ef: int) -> DataFrame:
    return ann_knn(index, queries, ef, ef)


def dynamic(index: GraphIndex, queries: DataFrame, k: int, ef: int, where: str, popularity: DataFrame, threshold: float) -> DataFrame:
    """Traversal that looks through nodes that don't match where ``popularity`` (query_id, popularity) is at most ``threshold``, that is for rare attributes."""
    rare = popularity.select("query_id", (F.col("popularity") <= threshold).alias("rare"))
    return ann_knn(index, queries, k, ef, where=where, mode="dynamic", rare=rare)


def threshold_for(cms: DataFrame, membership: DataFrame, ef: int) -> float:
    """The share that divides rare from popular attributes: between the least and the largest that any cell holds, rising with the logarithm of ``ef``."""
    bounds = sketches.cms_bounds(cms, membership).where("low is not null")
    row = bounds.select(dynamic_threshold(F.lit(ef), F.col("low"), F.col("high")).alias("t")).first()
    return THRESHOLDS["point"] if row is None else row["t"]


def _cluster_shares(kind: str, queries: DataFrame, membership: DataFrame, cms: DataFrame | None, model: DataFrame | None, minhash: DataFrame | None) -> DataFrame:
    """(query_id, cluster_id, share, mass): what the sketches say of each cluster."""
    if kind == "range":
        return sketches.range_mass(queries, model).select("query_id", "cluster_id", F.col("mass").alias("share"), F.lit(0.0).alias("mass"))
    if kind == "and":
        both = sketches.and_overlaps(queries, cms, model, minhash).where(F.col("size") > 0)
        return both.groupBy("query_id", "cluster_id").agg(F.max(F.col("common") / F.col("size")).alias("share")).withColumn("mass", F.lit(0.0))
    est = sketches.cms_hits(cms, queries.select("query_id", F.explode("attrs").alias("attr"))).join(sketches.totals(membership), "cluster_id")
    point = est.groupBy("query_id", "cluster_id").agg(F.max(F.col("est") / F.col("total")).alias("share"))
    if kind == "point":
        return point.withColumn("mass", F.lit(0.0))
    mass = sketches.range_mass(queries, model)
    return point.join(mass, ["query_id", "cluster_id"], "full").select("query_id", "cluster_id", F.coalesce("share", F.lit(0.0)).alias("share"), F.coalesce("mass", F.lit(0.0)).alias("mass"))


def masks(base: DataFrame, queries: DataFrame, where: str, exclude_self: bool = True) -> DataFrame:
    """(query_id, id) that match: equal attributes meet in a join, ranges by value buckets of growing width and then exactly."""
    point = base.select("id", F.explode("attrs").alias("attr")).join(queries.select("query_id", F.explode("attrs").alias("attr")), "attr").select("query_id", "id").distinct()
    place = lambda v: (F.signum(v) * F.floor(F.log2(F.abs(v.cast("double")) + 1) * BUCKET)).cast("bigint")
    asked = queries.where(F.col("lo") <= F.col("hi")).select("query_id", "lo", "hi", F.explode(F.sequence(place(F.col("lo")), place(F.col("hi")))).alias("bucket"))
    held = base.where(F.col("value").isNotNull()).select("id", "value", place(F.col("value")).alias("bucket"))
    within = held.join(asked, "bucket").where(F.col("value").between(F.col("lo"), F.col("hi"))).select("query_id", "id")
    if where == "point":
        found = point
    elif where == "range":
        found = within
    elif where == "and":
        bounds = queries.select("query_id", "lo", "hi")
        found = point.join(base.select("id", "value"), "id").join(bounds, "query_id").where(F.col("value").between(F.col("lo"), F.col("hi"))).select("query_id", "id")
    else:
        found = point.unionByName(within).distinct()
    return found.where(F.col("id") != F.col("query_id")) if exclude_self else found


def _tested(found: DataFrame, base: DataFrame, queries: DataFrame, where: str) -> DataFrame:
    """(query_id, id, dist) of the reached pairs that match; vectors and attributes are fetched for reached ids only."""
    q = queries.select("query_id", F.col("embedding").alias("q"), F.col("attrs").alias("q_attrs"), "lo", "hi")
    held = found.join(base.select("id", "embedding", "attrs", "value"), "id").join(q, "query_id")
    good = held.where(predicate(where, F.col("attrs"), F.col("value"), F.col("q_attrs"), F.col("lo"), F.col("hi")) & (F.col("id") != F.col("query_id")))
    return good.select("query_id", "id", l2(F.col("embedding"), F.col("q")).alias("dist"))


def _completed(found: DataFrame, index: GraphIndex, queries: DataFrame, where: str, k: int, ef: int) -> DataFrame:
    """The ``k`` best of ``found`` (query_id, id, dist); queries that lack some are walked with the predicate."""
    found = materialise(found, "found")
    full = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= k)
    lacking = materialise(queries.join(full, "query_id", "left_anti"), "lacking")
    if lacking.isEmpty():
        return ranked(found, k)
    more = ann_knn(index, lacking, k, ef, where=where, mode="dynamic").select("query_id", "id", "dist")
    return ranked(found.unionByName(more).dropDuplicates(["query_id", "id"]), k)


def predictive(index: GraphIndex, base: DataFrame, queries: DataFrame, edges: DataFrame, membership: DataFrame, where: str, k: int, ef: int, cms: DataFrame | None = None, model: DataFrame | None = None, minhash: DataFrame | None = None, threshold: float | None = None, always_two: bool = False) -> DataFrame:
    """Post-filter search: beam, then one hop around each beam node, or two where its cluster is promising.

    Queries with ``ENOUGH * k`` matches in their beam are done: nothing outside
    it is nearer. A node's cluster is that of its clusters with the largest
    share; for all but ``or`` only the nearest beam node of a cluster goes two
    hops. For AND the share is that of the attribute's fingerprints that also
    occur in the range's deciles.
    """
    limit = THRESHOLDS[where] if threshold is None else threshold
    beam = materialise(ann_beam(index, queries, ef).select("query_id", "id", "rank"), "beam")
    inside = materialise(_tested(beam.select("query_id", "id"), base, queries, where), "inside")
    done = inside.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= ENOUGH * k)
    todo = beam.join(done, "query_id", "left_anti")
    if always_two:
        reached = hops(todo, edges, 2)
    else:
        share = _cluster_shares(where, queries, membership, cms, model, minhash)
        best = F.row_number().over(W.partitionBy("query_id", "id").orderBy(F.desc_nulls_last("share"), F.desc_nulls_last("mass"), "cluster_id"))
        noted = todo.join(membership, "id", "left").join(share, ["query_id", "cluster_id"], "left").withColumn("b", best).where("b = 1")
        wide: Column = F.coalesce(F.col("share"), F.lit(0.0)) > limit
        if where == "or":
            wide = wide | (F.coalesce(F.col("mass"), F.lit(0.0)) > OR_MASS)
        else:
            wide = wide & (F.row_number().over(W.partitionBy("query_id", "cluster_id").orderBy("rank")) == 1)
        noted = materialise(noted.select("query_id", "id", wide.alias("wide")), "noted")
        reached = hops(noted.where("not wide"), edges, 1).unionByName(hops(noted.where("wide"), edges, 2)).distinct()
    fresh = reached.join(beam.select("query_id", "id"), ["query_id", "id"], "left_anti")
    return _completed(inside.unionByName(_tested(fresh, base, queries, where)), index, queries, where, k, ef)


def cluster_first(base: DataFrame, queries: DataFrame, edges: DataFrame, membership: DataFrame, seeds: DataFrame, cms: DataFrame, clusters: int, k: int, where: str = "point", half: bool = False) -> DataFrame:
    """For rare attributes: the clusters with most estimated matches, their seeds with all within two hops, tested and ranked.

    With ``half`` clusters are taken, in the order of their estimates, only
    while those before them hold less than half of all estimated matches.
    """
    top = sketches.top_clusters(queries, cms, clusters)
    if half:
        w = W.partitionBy("query_id").orderBy("rank")
        upto = F.sum("est").over(w.rowsBetween(W.unboundedPreceding, -1))
        top = top.withColumn("upto", F.coalesce(upto, F.lit(0))).withColumn("all", F.sum("est").over(W.partitionBy("query_id"))).where((F.col("upto") * 2 < F.col("all")) & (F.col("est") > 0))
    start = top.select("query_id", "cluster_id").join(seeds.select("cluster_id", "id"), "cluster_id").select("query_id", "id").distinct()
    reached = start.unionByName(hops(start, edges, 2)).distinct()
    return ranked(_tested(reached, base, queries, where), k)


def choose(selectivity: float, rows: int, k: int, clustered: bool = False) -> str:
    """Strategy for one predicate: exact over few rows, cluster-first for rare ones, widening or plain post-filter otherwise."""
    matches = selectivity * rows
    if matches <= max(10_000, 20 * k):
        return "exact"
    if selectivity < 0.01:
        return "cluster_first" if clustered else "dynamic"
    return "predictive" if selectivity < 0.3 else "post_filter"
