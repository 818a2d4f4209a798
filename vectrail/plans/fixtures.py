"""The engine's tables over the driver's: vectors, metadata, queries, and the same as DuckDB CTEs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph, sketches
from ..operators.index import GraphIndex
from ..operators.table import IndexConfig
from ..session import materialise

M = 8
INDEX = IndexConfig(64, m=16, ef_construction=64)
#: What is built once per application and data, as an index is: the stored graph, its clusters and their sketches.
_READY: dict[tuple[str, str, str], object] = {}


def once(spark: SparkSession, sf: str, name: str, make):
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _READY:
        _READY[key] = make()
    return _READY[key]


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def base(spark: SparkSession, sf: str) -> DataFrame:
    """(id, embedding, label, attrs, value): vectors with the metadata of the document of the same number, if any."""
    e = read(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")
    d = read(spark, sf, "documents").select(F.col("doc_id").alias("id"), "lang", "source", "n_chars")
    label = F.concat(F.lit("l"), F.col("label").cast("string"))
    attrs = F.filter(F.array("lang", "source", label), lambda x: x.isNotNull())
    return e.join(d, "id", "left").select("id", "embedding", "label", attrs.alias("attrs"), F.coalesce("n_chars", F.lit(0)).cast("int").alias("value"))


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


def queries(spark: SparkSession, sf: str) -> DataFrame:
    """The first 20 vectors as queries: their label as attribute, half to twice their value as range."""
    b = base(spark, sf).where("id < 20")
    label = F.array(F.concat(F.lit("l"), F.col("label").cast("string")))
    return b.select(F.col("id").alias("query_id"), "embedding", label.alias("attrs"), F.expr("value div 2").cast("int").alias("lo"), (F.col("value") * 2).alias("hi"))


def edges(spark: SparkSession, sf: str) -> DataFrame:
    """The graph is an index: it is written once and read by every operator that walks it."""
    return once(spark, sf, "edges", lambda: materialise(graph.knn_graph(vectors(spark, sf), M), "edges"))


def index(spark: SparkSession, sf: str) -> GraphIndex:
    return once(spark, sf, "index", lambda: GraphIndex.build(base(spark, sf), INDEX))


def links(spark: SparkSession, sf: str) -> DataFrame:
    """The links of the stored index's lowest level."""
    return once(spark, sf, "links", lambda: materialise(index(spark, sf).edges(), "links"))


def clusters(spark: SparkSession, sf: str) -> DataFrame:
    """Greedy clusters over the stored index, shard by shard."""
    return once(spark, sf, "clusters", lambda: materialise(sketches.greedy_clusters(links(spark, sf), 100, "shard"), "clusters"))


def cluster_sketches(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(count-min cells, linear CDF models, min-hashes by decile) of the greedy clusters."""

    def make() -> tuple[DataFrame, DataFrame, DataFrame]:
        m, b = clusters(spark, sf).select("id", "cluster_id"), base(spark, sf)
        return tuple(materialise(t, "sketch") for t in (sketches.cms_build(m, b), sketches.linear_model(sketches.cluster_cdf(m, b)), sketches.bottom_k(m, b)))

    return once(spark, sf, "sketches", make)


def membership(spark: SparkSession, sf: str) -> DataFrame:
    return sketches.neighbourhood_membership(edges(spark, sf))


def l2_sql(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"


BASE_SQL = """base AS (SELECT e.vec_id AS id, e.embedding::DOUBLE[] AS embedding, e.label,
  list_filter([d.lang, d.source, 'l' || e.label], lambda x: x IS NOT NULL) AS attrs, coalesce(d.n_chars, 0)::INTEGER AS value
  FROM embeddings e LEFT JOIN documents d ON e.vec_id = d.doc_id)"""
QUERIES_SQL = """q AS (SELECT id AS query_id, embedding AS q_embedding, ['l' || label] AS q_attrs, value // 2 AS lo, value * 2 AS hi FROM base WHERE id < 20)"""
EDGES_SQL = f"""pairs AS (SELECT a.id AS src, b.id AS dst, {l2_sql("a.embedding", "b.embedding")} AS dist FROM base a JOIN base b ON a.id <> b.id),
edges AS (SELECT src, dst, dist, ord FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY dist, dst) AS ord FROM pairs) WHERE ord <= {M})"""
MEMBERS_SQL = """members AS (SELECT src AS id, least(min(dst), min(src)) AS cluster_id FROM edges GROUP BY src)"""
SEED = "WITH " + BASE_SQL + ", " + QUERIES_SQL
GRAPH = SEED + ", " + EDGES_SQL
CLUSTERS = GRAPH + ", " + MEMBERS_SQL
