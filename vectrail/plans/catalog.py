"""Registered queries and the DuckDB SQL that checks them.

Ids, ranks and counts are BIGINT, distances and ratios doubles rounded to six
decimals, lists comma-joined strings, so that two engines agree to the bit.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import evaluate, graph, search, sketches, strategies, table
from ..session import materialise, scratch_path
from . import fixtures as X

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

CMS_SQL = """attr_ids AS (SELECT m.cluster_id, b.id, unnest(b.attrs) AS attr FROM members m JOIN base b USING (id)),
hashed AS (SELECT *, list_reduce(list_prepend(5381::BIGINT, list_transform(string_split(attr, ''), lambda c: ascii(c)::BIGINT)), lambda h, c: (h * 33 + c) & 4294967295) AS h FROM attr_ids),
consts(r, a, b) AS (VALUES (0, 73856093::HUGEINT, 83492791::HUGEINT), (1, 19349663::HUGEINT, 73856093::HUGEINT), (2, 83492791::HUGEINT, 19349663::HUGEINT), (3, 15485863::HUGEINT, 32452843::HUGEINT)),
cells AS (SELECT cluster_id, r AS row, ((((h::HUGEINT * a) % 4294967311) % 4294967296 + b) % 4294967296 % 1000)::BIGINT AS col, id FROM hashed CROSS JOIN consts),
cms AS (SELECT cluster_id, row, col, count(*) AS cnt FROM cells GROUP BY ALL),
totals AS (SELECT cluster_id, count(*) AS total FROM members GROUP BY ALL)"""

MURMUR_SQL = """{p}m0 AS (SELECT *, (id * 1540483477) & 4294967295 AS k0, (46::BIGINT * 1540483477) & 4294967295 AS s0 FROM {source}),
{p}m1 AS (SELECT *, (xor(k0, k0 >> 24) * 1540483477) & 4294967295 AS k1 FROM {p}m0),
{p}m2 AS (SELECT *, (xor(s0, k1) * 1540483477) & 4294967295 AS x1 FROM {p}m1),
{p}m3 AS (SELECT *, ((x1 >> 22) * 1540483477) & 4294967295 AS y1 FROM {p}m2),
{p}m4 AS (SELECT *, (xor(x1, y1 >> 17) * 1540483477) & 4294967295 AS h1 FROM {p}m3),
{p}murmur AS (SELECT *, (xor(y1, h1 >> 19) * 1540483477) & 4294967295 AS h2 FROM {p}m4)"""
PLACED_SQL = "placed AS (SELECT m.cluster_id, m.id, least(floor(c.cdf * 10)::BIGINT, 10) AS bucket FROM members m JOIN base b USING (id) JOIN cdf c ON c.cluster_id = m.cluster_id AND c.value = b.value)"

CDF_SQL = """counted AS (SELECT m.cluster_id, b.value, count(*) AS n FROM members m JOIN base b USING (id) GROUP BY ALL),
cdf AS (SELECT cluster_id, value, (sum(n) OVER (PARTITION BY cluster_id ORDER BY value))::DOUBLE / sum(n) OVER (PARTITION BY cluster_id) AS cdf FROM counted)"""
LINEAR_SQL = """model AS (SELECT cluster_id, min(value)::DOUBLE AS x0, max(value)::DOUBLE AS x1,
  CASE WHEN count(*) > 1 THEN regr_slope(cdf, value::DOUBLE) ELSE 0 END AS slope, CASE WHEN count(*) > 1 THEN regr_intercept(cdf, value::DOUBLE) ELSE max(cdf) END AS intercept FROM cdf GROUP BY cluster_id)"""
PROBE_SQL = """probe0 AS (SELECT query_id, unnest(q_attrs) AS attr FROM q),
probe AS (SELECT *, list_reduce(list_prepend(5381::BIGINT, list_transform(string_split(attr, ''), lambda c: ascii(c)::BIGINT)), lambda h, c: (h * 33 + c) & 4294967295) AS h FROM probe0),
probe_cells AS (SELECT query_id, attr, r AS row, ((((h::HUGEINT * a) % 4294967311) % 4294967296 + b) % 4294967296 % 1000)::BIGINT AS col FROM probe CROSS JOIN consts),
est AS (SELECT p.query_id, p.attr, t.cluster_id, min(coalesce(c.cnt, 0)) AS est FROM probe_cells p CROSS JOIN totals t
  LEFT JOIN cms c ON c.cluster_id = t.cluster_id AND c.row = p.row AND c.col = p.col GROUP BY ALL)"""


def predict_sql(x: str) -> str:
    return f"CASE WHEN x0 = x1 THEN CASE WHEN {x} < x0 THEN 0 ELSE least(1, greatest(0, intercept)) END ELSE least(1, greatest(0, slope * {x} + intercept)) END"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return register


def _b(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("bigint")


def _out(df: DataFrame) -> DataFrame:
    return df.select("query_id", "id", F.round("dist", 6).alias("dist"), _b("rank").alias("rank"))


def topk_sql(k: int, cond: str, dist: str, head: str = X.SEED, order: str = "dist, id") -> str:
    return f"""{head}, met AS (SELECT q.query_id, base.id, {dist} AS dist FROM base JOIN q ON {cond})
SELECT query_id, id, round(dist, 6) AS dist, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {order}) AS rank FROM met) WHERE rank <= {k}"""


L2 = X.l2_sql("base.embedding", "q.q_embedding")
DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1] * z[2]))"
IP = "1 - " + DOT.format(a="base.embedding", b="q.q_embedding")
NORM = f"sqrt({DOT.format(a='base.embedding', b='base.embedding')} * {DOT.format(a='q.q_embedding', b='q.q_embedding')})"
COSINE = f"1 - {DOT.format(a='base.embedding', b='q.q_embedding')} / {NORM}"
OTHER = "base.id <> q.query_id"
#: Squared distance within which a query has some tens of neighbours.
RADIUS = 1.5
POINT = "list_has_any(base.attrs, q.q_attrs)"
RANGE = "base.value BETWEEN q.lo AND q.hi"
CONDITIONS = {"point": POINT, "range": RANGE, "and": f"{POINT} AND {RANGE}", "or": f"({POINT} OR {RANGE})"}

# ---------------------------------------------------------------- scans and parsing


def _csv(spark: SparkSession, sf: str, name: str, lines: DataFrame) -> str:
    """A semicolon file with a header line of ``lines`` (id, value), in the order of the ids; written once."""

    def make() -> str:
        path = scratch_path(spark, name)
        head = spark.createDataFrame([(-1, "header")], "id bigint, value string")
        head.unionByName(lines.select("id", "value")).repartition(1).sortWithinPartitions("id").select("value").write.text(path)
        return path

    return X.once(spark, sf, name, make)


def _numbers(c: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: x.cast("string")), ","), F.lit("]"))


def _scanned(spark: SparkSession, sf: str, kind: str, lines: DataFrame, dim: int | None = None) -> DataFrame:
    from ..sources import files

    return files.scan_layout(spark, _csv(spark, sf, f"csv-{kind}", lines), kind, dim)


@query("scan_embeddings", "SELECT vec_id AS id, len(embedding)::BIGINT AS dim, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 5) AS total FROM embeddings")
def scan_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    """A dataset file, its ids the numbers of the lines; lines with bad elements or another number of them are dropped."""
    e = X.vectors(spark, sf).select("id", F.concat(F.lit("x;"), _numbers(F.col("embedding")), F.lit(";y;pop;z;1;w")).alias("value"))
    bad = e.where("id < 3").select((F.col("id") + 1_000_000_000).alias("id"), F.lit("x;[1,oops,3];y;;z;;w").alias("value"))
    parsed = _scanned(spark, sf, "dataset", e.unionByName(bad), 64)
    total = F.aggregate(F.transform("embedding", lambda x: x.cast("double")), F.lit(0.0), lambda a, x: a + x)
    return parsed.select("id", _b(F.size("embedding")).alias("dim"), F.round(total, 5).alias("total"))


@query("scan_attrs", X.SEED + " SELECT id, array_to_string(attrs, ',') AS attrs FROM base")
def scan_attrs(spark: SparkSession, sf: str) -> DataFrame:
    """A metadata file of one column: the attributes of line n are those of vector n."""
    text = F.concat(F.lit("'"), F.array_join(F.transform("attrs", F.upper), " ', \""), F.lit("\""))
    return _scanned(spark, sf, "point_metadata", X.base(spark, sf).select("id", text.alias("value"))).select("id", F.array_join("attrs", ",").alias("attrs"))


@query("scan_value", X.SEED + " SELECT id, value FROM base")
def scan_value(spark: SparkSession, sf: str) -> DataFrame:
    """A metadata file of vectors and whole numbers."""
    text = F.concat_ws(";", _numbers(F.slice("embedding", 1, 2)), F.col("value").cast("string"))
    return _scanned(spark, sf, "range_metadata", X.base(spark, sf).select("id", text.alias("value"))).select("id", F.col("strict_value").alias("value"))


@query("scan_hybrid", X.SEED + " SELECT id, array_to_string(attrs, ',') AS attrs, CASE WHEN id % 5 = 0 THEN 0 ELSE value END AS value FROM base")
def scan_hybrid(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors, attributes and numbers, some of which aren't any and count as 0."""
    number = F.when(F.col("id") % 5 == 0, "bad").otherwise(F.col("value").cast("string"))
    text = F.concat_ws(";", _numbers(F.slice("embedding", 1, 2)), F.array_join("attrs", ", "), number)
    return _scanned(spark, sf, "and_metadata", X.base(spark, sf).select("id", text.alias("value"))).select("id", F.array_join("attrs", ",").alias("attrs"), "value")


@query("scan_queries", X.SEED + " SELECT query_id AS id, array_to_string(q_attrs, ',') AS attrs, lo, hi FROM q")
def scan_queries(spark: SparkSession, sf: str) -> DataFrame:
    """A file of queries with attributes and bounds."""
    q = X.queries(spark, sf)
    text = F.concat_ws(";", _numbers(F.slice("embedding", 1, 2)), F.array_join("attrs", ","), F.col("lo").cast("string"), F.col("hi").cast("string"))
    return _scanned(spark, sf, "and_queries", q.select(F.col("query_id").alias("id"), text.alias("value"))).select("id", F.array_join("attrs", ",").alias("attrs"), "lo", "hi")


@query("tokenize", """SELECT page_id, array_to_string(list_filter(list_transform(string_split(lower(regexp_replace(url, '["'']', '', 'g')), '/'), lambda x: trim(x)), lambda x: x <> ''), ',') AS tokens FROM pages""")
def tokenize(spark: SparkSession, sf: str) -> DataFrame:
    return X.read(spark, sf, "pages").select("page_id", F.array_join(C.tokens(F.replace("url", F.lit("/"), F.lit(","))), ",").alias("tokens"))


# ---------------------------------------------------------------- distances


def _measured(spark: SparkSession, sf: str, dist: Callable[[Column, Column], Column]) -> DataFrame:
    met = search.pairs(X.vectors(spark, sf), X.queries(spark, sf).where("query_id < 5").select("query_id", "embedding"))
    return met.select("query_id", "id", F.round(dist(F.col("embedding"), F.col("q_embedding")), 6).alias("dist"))


def _measured_sql(dist: str) -> str:
    return f"{X.SEED} SELECT q.query_id, base.id, round({dist}, 6) AS dist FROM base JOIN q ON q.query_id < 5"


for _name, _metric, _sql in (("dist_l2", C.l2, L2), ("dist_ip", C.inner_product, IP), ("dist_cosine", C.cosine, COSINE)):
    query(_name, _measured_sql(_sql))(lambda spark, sf, m=_metric: _measured(spark, sf, m))


@query("dist_l2_u8", """WITH b AS (SELECT vec_id AS id, list_transform(embedding, lambda x: floor((x::DOUBLE + 1) * 127)::BIGINT) AS v FROM embeddings)
SELECT q.id AS query_id, b.id, list_sum(list_transform(list_zip(b.v, q.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS dist FROM b JOIN b q ON q.id < 5""")
def dist_l2_u8(spark: SparkSession, sf: str) -> DataFrame:
    b = X.vectors(spark, sf).select("id", F.transform("embedding", lambda x: F.floor((x.cast("double") + 1) * 127).cast("smallint")).alias("embedding"))
    met = search.pairs(b, b.where("id < 5").withColumnRenamed("id", "query_id"))
    return met.select("query_id", "id", C.l2_bytes(F.col("embedding"), F.col("q_embedding")).alias("dist"))


# ---------------------------------------------------------------- predicates


def _filter(where: str) -> Query:
    return lambda spark, sf: strategies.masks(X.base(spark, sf), X.queries(spark, sf), where)


for _name, _where in (("filter_point", "point"), ("filter_range", "range"), ("filter_and", "and"), ("filter_or", "or")):
    query(_name, f"{X.SEED} SELECT q.query_id, base.id FROM base JOIN q ON {OTHER} AND {CONDITIONS[_where]}")(_filter(_where))


@query("mask_count", f"{X.SEED} SELECT q.query_id, count(base.id) AS n FROM q LEFT JOIN base ON {OTHER} AND {POINT} GROUP BY q.query_id")
def mask_count(spark: SparkSession, sf: str) -> DataFrame:
    q = X.queries(spark, sf)
    counted = strategies.masks(X.base(spark, sf), q, "point").groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    return q.select("query_id").join(counted, "query_id", "left").select("query_id", F.coalesce("n", F.lit(0)).alias("n"))


# ---------------------------------------------------------------- exact search


def _knn(metric: str, where: str = "none", k: int = 10, source: str = "vectors") -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        b = X.vectors(spark, sf) if where == "none" else X.base(spark, sf)
        return _out(search.top_k(b, X.queries(spark, sf), k, metric, where, exclude_self=True))

    return run


for _name, _metric, _sql in (("knn_exact_l2", "l2", L2), ("knn_exact_ip", "ip", IP), ("knn_exact_cosine", "cosine", COSINE)):
    query(_name, topk_sql(10, OTHER, _sql))(_knn(_metric))
for _where in ("point", "range", "and", "or"):
    query(f"gt_{_where}", topk_sql(10, f"{OTHER} AND {CONDITIONS[_where]}", L2))(_knn("l2", _where))


@query("knn_scaled_ip", f"""{X.SEED}, s AS (SELECT id, list_transform(embedding, lambda x: x * (1 + id % 3)) AS embedding FROM base),
met AS (SELECT q.query_id, s.id, 1 - {DOT.format(a="s.embedding", b="q.q_embedding")} AS dist FROM s JOIN q ON s.id <> q.query_id)
SELECT query_id, id, round(dist, 6) AS dist, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, id) AS rank FROM met) WHERE rank <= 10""")
def knn_scaled_ip(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors of different lengths, where the metrics rank differently."""
    scaled = X.vectors(spark, sf).select("id", F.transform("embedding", lambda x: x.cast("double") * (1 + F.col("id") % 3)).alias("embedding"))
    return _out(search.top_k(scaled, X.queries(spark, sf), 10, "ip", exclude_self=True))


@query("knn_id_filter", topk_sql(10, f"{OTHER} AND base.id % 3 = 0", L2))
def knn_id_filter(spark: SparkSession, sf: str) -> DataFrame:
    return _out(search.top_k(X.vectors(spark, sf).where("id % 3 = 0"), X.queries(spark, sf), 10, exclude_self=True))


@query("knn_single", f"{X.SEED} SELECT base.id, round({L2}, 6) AS dist FROM base JOIN q ON q.query_id = 0 AND base.id <> 0 ORDER BY {L2}, base.id LIMIT 10")
def knn_single(spark: SparkSession, sf: str) -> DataFrame:
    """One query: TakeOrderedAndProject, no window."""
    met = search.pairs(X.vectors(spark, sf), X.queries(spark, sf).where("query_id = 0").select("query_id", "embedding"), exclude_self=True)
    near = met.select("id", C.l2(F.col("embedding"), F.col("q_embedding")).alias("dist")).orderBy("dist", "id").limit(10)
    return near.select("id", F.round("dist", 6).alias("dist"))


@query("farthest_first", topk_sql(10, OTHER, L2, order="dist DESC, id DESC"))
def farthest_first(spark: SparkSession, sf: str) -> DataFrame:
    return _out(search.top_k(X.vectors(spark, sf), X.queries(spark, sf), 10, exclude_self=True, farthest=True))


@query("epsilon_search", f"""{X.SEED}, met AS (SELECT q.query_id, base.id, {L2} AS dist FROM base JOIN q ON {OTHER})
SELECT query_id, id, round(dist, 6) AS dist, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, id) AS rank FROM met WHERE dist <= {RADIUS}) WHERE rank <= 50""")
def epsilon_search(spark: SparkSession, sf: str) -> DataFrame:
    return _out(search.within_radius(X.vectors(spark, sf), X.queries(spark, sf).select("query_id", "embedding"), RADIUS, 50, exclude_self=True))


def _multi(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return X.vectors(spark, sf).withColumn("doc_id", F.pmod("id", F.lit(50))), X.queries(spark, sf).select("query_id", "embedding")


_MULTI_SQL = f"{X.SEED}, met AS (SELECT q.query_id, base.id, base.id % 50 AS doc_id, {L2} AS dist FROM base JOIN q ON {OTHER})"


@query("multivector_docs", f"""{_MULTI_SQL}, f AS (SELECT *, (row_number() OVER (PARTITION BY query_id, doc_id ORDER BY dist, id) = 1)::INTEGER AS first FROM met),
c AS (SELECT *, sum(first) OVER (PARTITION BY query_id ORDER BY dist, id ROWS UNBOUNDED PRECEDING) AS docs FROM f)
SELECT query_id, id, doc_id, round(dist, 6) AS dist FROM c WHERE docs <= 5""")
def multivector_docs(spark: SparkSession, sf: str) -> DataFrame:
    b, q = _multi(spark, sf)
    return search.by_document(b, q, 5).select("query_id", "id", "doc_id", F.round("dist", 6).alias("dist"))


@query("multivector_min", f"""{_MULTI_SQL}, d AS (SELECT query_id, doc_id, min(dist) AS dist FROM met GROUP BY ALL)
SELECT query_id, doc_id, round(dist, 6) AS dist, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, doc_id) AS rank FROM d) WHERE rank <= 5""")
def multivector_min(spark: SparkSession, sf: str) -> DataFrame:
    b, q = _multi(spark, sf)
    return search.best_documents(b, q, 5).select("query_id", "doc_id", F.round("dist", 6).alias("dist"), "rank")


# ---------------------------------------------------------------- table maintenance


def _table(spark: SparkSession, sf: str) -> DataFrame:
    return X.vectors(spark, sf).select("id", F.transform("embedding", lambda x: x.cast("double")).alias("embedding"), F.lit(False).alias("deleted"))


def _negated(t: DataFrame) -> DataFrame:
    return t.where("id % 7 = 0").select("id", F.transform("embedding", lambda x: -x).alias("embedding"), F.lit(1).alias("version"))


def _ids(t: DataFrame, cond: str) -> DataFrame:
    return t.where(cond).select("id")


def _digest(t: DataFrame) -> DataFrame:
    return t.select("id", F.round(F.col("embedding")[0], 6).alias("first"), "deleted")


_E = "SELECT vec_id AS id, round({v}, 6) AS first, {d} AS deleted FROM embeddings"
_FIRST = "CASE WHEN vec_id % 7 = 0 THEN -embedding[1]::DOUBLE ELSE embedding[1]::DOUBLE END"


@query("upsert_latest", _E.format(v=_FIRST, d="false"))
def upsert_latest(spark: SparkSession, sf: str) -> DataFrame:
    t = _table(spark, sf)
    older = t.where("id % 14 = 0").select("id", "embedding", F.lit(0).alias("version"))
    return _digest(table.upsert(t, _negated(t).unionByName(older)))


@query("remove_anti", _E.format(v="embedding[1]::DOUBLE", d="false") + " WHERE vec_id % 5 <> 0")
def remove_anti(spark: SparkSession, sf: str) -> DataFrame:
    t = _table(spark, sf)
    return _digest(table.remove(t, _ids(t, "id % 5 = 0")))


@query("mark_delete", _E.format(v="embedding[1]::DOUBLE", d="vec_id % 5 = 0"))
def mark_delete(spark: SparkSession, sf: str) -> DataFrame:
    t = _table(spark, sf)
    return _digest(table.set_deleted(t, _ids(t, "id % 5 = 0"), True))


@query("unmark_delete", _E.format(v="embedding[1]::DOUBLE", d="vec_id % 5 = 0 AND vec_id % 10 <> 0"))
def unmark_delete(spark: SparkSession, sf: str) -> DataFrame:
    t = _table(spark, sf)
    return _digest(table.set_deleted(table.set_deleted(t, _ids(t, "id % 5 = 0"), True), _ids(t, "id % 10 = 0"), False))


@query("knn_after_delete", topk_sql(10, f"{OTHER} AND base.id % 5 <> 0", L2))
def knn_after_delete(spark: SparkSession, sf: str) -> DataFrame:
    t = _table(spark, sf)
    return _out(search.top_k(table.live(table.set_deleted(t, _ids(t, "id % 5 = 0"), True)), X.queries(spark, sf), 10, exclude_self=True))


@query("replace_deleted", """WITH gone AS (SELECT vec_id FROM embeddings WHERE vec_id % 5 = 0 ORDER BY vec_id LIMIT 10)
SELECT vec_id AS id, round(embedding[1]::DOUBLE, 6) AS first, vec_id % 5 = 0 AS deleted FROM embeddings WHERE vec_id NOT IN (SELECT vec_id FROM gone)
UNION ALL SELECT vec_id + 1000000 AS id, round(-embedding[1]::DOUBLE, 6) AS first, false AS deleted FROM embeddings WHERE vec_id < 10""")
def replace_deleted(spark: SparkSession, sf: str) -> DataFrame:
    t = _table(spark, sf)
    new = t.where("id < 10").select((F.col("id") + 1_000_000).alias("id"), F.transform("embedding", lambda x: -x).alias("embedding"))
    config = table.IndexConfig(64, allow_replace_deleted=True)
    return _digest(table.replace_deleted(table.set_deleted(t, _ids(t, "id % 5 = 0"), True), new, config))


@query("get_items", "SELECT vec_id AS id, round(embedding[1]::DOUBLE, 6) AS first FROM embeddings WHERE vec_id % 50 = 3")
def get_items(spark: SparkSession, sf: str) -> DataFrame:
    t = _table(spark, sf)
    return table.fetch(t, _ids(t, "id % 50 = 3")).select("id", F.round(F.col("embedding")[0], 6).alias("first"))


@query("index_stats", "SELECT count(*) AS elements, count(*) FILTER (vec_id % 5 = 0) AS deleted, count(*) FILTER (vec_id % 5 <> 0) AS alive FROM embeddings")
def index_stats(spark: SparkSession, sf: str) -> DataFrame:
    t = _table(spark, sf)
    return table.stats(table.set_deleted(t, _ids(t, "id % 5 = 0"), True))


@query("index_roundtrip", _E.format(v="embedding[1]::DOUBLE", d="false"))
def index_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "index")
    table.VectorTable(_table(spark, sf), table.IndexConfig(64)).save(path)
    return _digest(table.VectorTable.load(spark, path).rows)


# ---------------------------------------------------------------- graph


def _edge(df: DataFrame) -> DataFrame:
    return df.select("src", "dst", F.round("dist", 6).alias("dist"), _b("ord").alias("ord"))


@query("knn_graph", X.GRAPH + " SELECT src, dst, round(dist, 6) AS dist, ord FROM edges")
def knn_graph(spark: SparkSession, sf: str) -> DataFrame:
    return _edge(graph.knn_graph(X.vectors(spark, sf), X.M))


@query("graph_symmetric", X.GRAPH + ", u AS (SELECT src, dst, min(dist) AS dist FROM (SELECT src, dst, dist FROM edges UNION ALL SELECT dst, src, dist FROM edges) GROUP BY ALL) SELECT src, dst, round(dist, 6) AS dist, row_number() OVER (PARTITION BY src ORDER BY dist, dst) AS ord FROM u")
def graph_symmetric(spark: SparkSession, sf: str) -> DataFrame:
    return _edge(graph.symmetric(X.edges(spark, sf)))


@query("graph_prune")
def graph_prune(spark: SparkSession, sf: str) -> DataFrame:
    wide = graph.knn_graph(X.vectors(spark, sf), 2 * X.M)
    return _edge(graph.prune(wide, X.vectors(spark, sf), X.M))


@query("graph_integrity", X.GRAPH + """, i AS (SELECT base.id, count(edges.src) AS n FROM base LEFT JOIN edges ON edges.dst = base.id GROUP BY base.id)
SELECT (SELECT count(*) FROM edges) AS edges, 0::BIGINT AS self_loops, 0::BIGINT AS repeated, 0::BIGINT AS unknown, min(n) AS min_inbound, max(n) AS max_inbound FROM i""")
def graph_integrity(spark: SparkSession, sf: str) -> DataFrame:
    return graph.integrity(X.edges(spark, sf), X.vectors(spark, sf))


@query("neighbors", X.GRAPH + " SELECT src, dst, round(dist, 6) AS dist, ord FROM edges WHERE src IN (0, 7, 11)")
def neighbors(spark: SparkSession, sf: str) -> DataFrame:
    return _edge(graph.neighbours_of(X.edges(spark, sf), [0, 7, 11]))


@query("level_hist")
def level_hist(spark: SparkSession, sf: str) -> DataFrame:
    return X.vectors(spark, sf).groupBy(graph.level("id", 16).alias("level")).agg(F.count(F.lit(1)).alias("n"))


_BEAM_SQL = ", beam AS (SELECT src AS query_id, dst AS id FROM edges WHERE src < 20 AND ord <= 3)"
_MASK_SQL = f", mask AS (SELECT q.query_id, base.id FROM base JOIN q ON {OTHER} AND {POINT})"
_ONE_SQL = ", one AS (SELECT DISTINCT b.query_id, e.dst AS id FROM beam b JOIN edges e ON e.src = b.id)"
_TWO_SQL = ", two AS (SELECT query_id, id FROM one UNION SELECT o.query_id, e.dst FROM one o JOIN edges e ON e.src = o.id)"


def _expanded(n: int) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        e = X.edges(spark, sf)
        beam = e.where((F.col("src") < 20) & (F.col("ord") <= 3)).select(F.col("src").alias("query_id"), F.col("dst").alias("id"))
        return graph.expand(beam, e, strategies.masks(X.base(spark, sf), X.queries(spark, sf), "point"), n)

    return run


query("one_hop", X.GRAPH + _BEAM_SQL + _MASK_SQL + _ONE_SQL + " SELECT query_id, id FROM one SEMI JOIN mask USING (query_id, id)")(_expanded(1))
query("two_hop", X.GRAPH + _BEAM_SQL + _MASK_SQL + _ONE_SQL + _TWO_SQL + " SELECT query_id, id FROM two SEMI JOIN mask USING (query_id, id)")(_expanded(2))


@query("n_hop", X.GRAPH + ", r3 AS (SELECT src AS query_id, dst AS id FROM edges WHERE src < 5), r2 AS (SELECT query_id, id FROM r3 UNION SELECT r3.query_id, e.dst FROM r3 JOIN edges e ON e.src = r3.id), r1 AS (SELECT query_id, id FROM r2 UNION SELECT r2.query_id, e.dst FROM r2 JOIN edges e ON e.src = r2.id) SELECT DISTINCT query_id, id FROM r1")
def n_hop(spark: SparkSession, sf: str) -> DataFrame:
    start = X.queries(spark, sf).where("query_id < 5").select("query_id", F.col("query_id").alias("id"))
    return graph.hops(start, X.edges(spark, sf), 3)


# ---------------------------------------------------------------- sketches and models

@query("hash_djb2", X.CLUSTERS + ", " + CMS_SQL + " SELECT DISTINCT attr, h AS hash FROM hashed")
def hash_djb2(spark: SparkSession, sf: str) -> DataFrame:
    return X.base(spark, sf).select(F.explode("attrs").alias("attr")).distinct().select("attr", C.djb2(F.col("attr")).alias("hash"))


@query("hash_murmur", "WITH src AS (SELECT vec_id AS id FROM embeddings), " + MURMUR_SQL.format(p="", source="src") + " SELECT id, h1, h2, h1 >> 16 AS fingerprint FROM murmur")
def hash_murmur(spark: SparkSession, sf: str) -> DataFrame:
    h = X.vectors(spark, sf).select("id", C.murmur_halves(F.col("id")).alias("h"))
    return h.select("id", "h.h1", "h.h2", _b(F.shiftrightunsigned("h.h1", 16)).alias("fingerprint"))


def _sketched(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Membership and count-min cells, built once for all that read them."""
    m = X.membership(spark, sf)
    return m, materialise(sketches.cms_build(m, X.base(spark, sf)), "cms")


def _cms(spark: SparkSession, sf: str) -> DataFrame:
    return sketches.cms_build(X.membership(spark, sf), X.base(spark, sf))


@query("cms_build", X.CLUSTERS + ", " + CMS_SQL + ", " + MURMUR_SQL.format(p="", source="cells") + """ SELECT cluster_id, row, col, count(*) AS cnt,
array_to_string(list_transform(list_sort(list_distinct(list(h1 >> 16)))[1:1000], lambda x: x::VARCHAR), ',') AS fps FROM murmur GROUP BY cluster_id, row, col""")
def cms_build(spark: SparkSession, sf: str) -> DataFrame:
    return _cms(spark, sf).select("cluster_id", "row", _b("col").alias("col"), "cnt", F.array_join(F.transform("fps", lambda x: x.cast("string")), ",").alias("fps"))


@query("cms_estimate", X.CLUSTERS + ", " + CMS_SQL + ", " + PROBE_SQL + " SELECT query_id, attr, cluster_id, est FROM est")
def cms_estimate(spark: SparkSession, sf: str) -> DataFrame:
    return sketches.cms_estimate(_cms(spark, sf), X.queries(spark, sf).select("query_id", F.explode("attrs").alias("attr"))).select("query_id", "attr", "cluster_id", "est")


@query("cms_bounds", X.CLUSTERS + ", " + CMS_SQL + " SELECT round(min(cnt / total), 6) AS low, round(max(cnt / total), 6) AS high FROM cms JOIN totals USING (cluster_id)")
def cms_bounds(spark: SparkSession, sf: str) -> DataFrame:
    m, cms = _sketched(spark, sf)
    b = sketches.cms_bounds(cms, m)
    return b.select(F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@query("membership_sets", X.CLUSTERS + " SELECT id, cluster_id::VARCHAR AS clusters FROM members")
def membership_sets(spark: SparkSession, sf: str) -> DataFrame:
    m = X.membership(spark, sf)
    return m.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_set("cluster_id")), lambda x: x.cast("string")), ",").alias("clusters"))


def _cdf(spark: SparkSession, sf: str) -> DataFrame:
    return sketches.cluster_cdf(X.membership(spark, sf), X.base(spark, sf))


@query("cluster_cdf", X.CLUSTERS + ", " + CDF_SQL + " SELECT cluster_id, value, round(cdf, 6) AS cdf FROM cdf")
def cluster_cdf(spark: SparkSession, sf: str) -> DataFrame:
    return _cdf(spark, sf).select("cluster_id", "value", F.round("cdf", 6).alias("cdf"))


@query("bottom_k", X.CLUSTERS + ", " + CDF_SQL + ", " + PLACED_SQL + ", " + MURMUR_SQL.format(p="", source="placed") + """, r AS (SELECT *, row_number() OVER (PARTITION BY cluster_id, bucket ORDER BY h1, h2) AS r FROM murmur)
SELECT cluster_id, bucket, array_to_string(list_transform(list_sort(list_distinct(list(h1 >> 16))), lambda x: x::VARCHAR), ',') AS fps FROM r WHERE r <= 1000 GROUP BY ALL""")
def bottom_k(spark: SparkSession, sf: str) -> DataFrame:
    k = sketches.bottom_k(X.membership(spark, sf), X.base(spark, sf))
    return k.select("cluster_id", _b("bucket").alias("bucket"), F.array_join(F.transform("fps", lambda x: x.cast("string")), ",").alias("fps"))


_MODEL_OUT = "SELECT cluster_id, round(x0, 6) AS x0, round(x1, 6) AS x1, round(slope, 6) AS slope, round(intercept, 6) AS intercept"


def _model_out(df: DataFrame, *extra: str) -> DataFrame:
    return df.select("cluster_id", *[_b(e).alias(e) for e in extra], *[F.round(c, 6).alias(c) for c in ("x0", "x1", "slope", "intercept")])


@query("cdf_linear", X.CLUSTERS + ", " + CDF_SQL + ", " + LINEAR_SQL + f" {_MODEL_OUT} FROM model")
def cdf_linear(spark: SparkSession, sf: str) -> DataFrame:
    return _model_out(sketches.linear_model(_cdf(spark, sf)))


@query("cdf_piecewise", X.CLUSTERS + ", " + CDF_SQL + """, tiled AS (SELECT *, ntile(3) OVER (PARTITION BY cluster_id ORDER BY value) AS piece FROM cdf)
SELECT cluster_id, piece, min(value)::DOUBLE AS x0, max(value)::DOUBLE AS x1, round(CASE WHEN count(*) > 1 THEN regr_slope(cdf, value::DOUBLE) ELSE 0 END, 6) AS slope,
round(CASE WHEN count(*) > 1 THEN regr_intercept(cdf, value::DOUBLE) ELSE max(cdf) END, 6) AS intercept FROM tiled GROUP BY cluster_id, piece""")
def cdf_piecewise(spark: SparkSession, sf: str) -> DataFrame:
    return _model_out(sketches.piecewise_model(_cdf(spark, sf)), "piece")


@query("cdf_quantile")
def cdf_quantile(spark: SparkSession, sf: str) -> DataFrame:
    return _model_out(sketches.quantile_model(_cdf(spark, sf)))


@query("cdf_kll")
def cdf_kll(spark: SparkSession, sf: str) -> DataFrame:
    """A non-parametric alternative: each cluster's median by a KLL sketch."""
    m = X.membership(spark, sf).join(X.base(spark, sf).select("id", "value"), "id")
    sk = m.groupBy("cluster_id").agg(F.expr("kll_sketch_agg_bigint(cast(value as bigint))").alias("s"))
    return sk.select("cluster_id", F.expr("kll_sketch_get_quantile_bigint(s, 0.5)").alias("median"))


_AUDIT = f", audit AS (SELECT cluster_id, value, cdf AS actual, {predict_sql('value')} AS predicted FROM cdf JOIN model USING (cluster_id))"


@query("cdf_audit_linear", X.CLUSTERS + ", " + CDF_SQL + ", " + LINEAR_SQL + _AUDIT + " SELECT cluster_id, value, round(actual, 5) AS actual, round(predicted, 5) AS predicted, round(abs(actual - predicted), 5) AS difference FROM audit")
def cdf_audit_linear(spark: SparkSession, sf: str) -> DataFrame:
    cdf = _cdf(spark, sf)
    a = sketches.audit(cdf, sketches.linear_model(cdf))
    return a.select("cluster_id", "value", *[F.round(c, 5).alias(c) for c in ("actual", "predicted", "difference")])


@query("cdf_mae", X.CLUSTERS + ", " + CDF_SQL + ", " + LINEAR_SQL + _AUDIT + ", e AS (SELECT cluster_id, avg(abs(actual - predicted)) AS mae FROM audit GROUP BY ALL) SELECT round(avg(mae), 6) AS mae, count(*) AS clusters FROM e")
def cdf_mae(spark: SparkSession, sf: str) -> DataFrame:
    cdf = _cdf(spark, sf)
    return sketches.mean_error(sketches.audit(cdf, sketches.linear_model(cdf))).select(F.round("mae", 6).alias("mae"), "clusters")


_PIECES_SQL = """, tiled AS (SELECT *, ntile(3) OVER (PARTITION BY cluster_id ORDER BY value) AS piece FROM cdf),
pieces AS (SELECT cluster_id, piece, min(value)::DOUBLE AS x0, max(value)::DOUBLE AS x1, CASE WHEN count(*) > 1 THEN regr_slope(cdf, value::DOUBLE) ELSE 0 END AS slope,
CASE WHEN count(*) > 1 THEN regr_intercept(cdf, value::DOUBLE) ELSE max(cdf) END AS intercept FROM tiled GROUP BY cluster_id, piece)"""


@query("cdf_compare", X.CLUSTERS + ", " + CDF_SQL + ", " + LINEAR_SQL + _AUDIT + _PIECES_SQL + f""", e AS (SELECT 'linear' AS kind, cluster_id, abs(actual - predicted) AS d FROM audit
UNION ALL SELECT 'piecewise', t.cluster_id, abs(t.cdf - ({predict_sql('t.value')})) FROM tiled t JOIN pieces p ON p.cluster_id = t.cluster_id AND p.piece = t.piece)
SELECT kind, round(avg(mae), 5) AS mae, count(*) AS clusters FROM (SELECT kind, cluster_id, avg(d) AS mae FROM e GROUP BY ALL) GROUP BY kind""")
def cdf_compare(spark: SparkSession, sf: str) -> DataFrame:
    """Errors of one line and of three; that of the quantile line is in :func:`evaluate.compare_models`."""
    return evaluate.compare_models(_cdf(spark, sf)).where("kind <> 'quantile'").select("kind", F.round("mae", 5).alias("mae"), "clusters")


@query("date_ts", "SELECT o_orderkey, epoch(date_trunc('day', o_orderdate))::BIGINT AS seconds FROM orders WHERE o_orderkey % 100 = 1")
def date_ts(spark: SparkSession, sf: str) -> DataFrame:
    o = X.read(spark, sf, "orders").where("o_orderkey % 100 = 1")
    day = F.to_date(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return o.select("o_orderkey", (F.unix_date(day).cast("bigint") * 86400).alias("seconds"))


_POINT_POP = "pp AS (SELECT query_id, max(est / total) AS popularity, arg_max(cluster_id, (est / total, -cluster_id)) AS cluster_id FROM est JOIN totals USING (cluster_id) GROUP BY query_id)"
_MASS = f"mass AS (SELECT q.query_id, m.cluster_id, CASE WHEN q.lo > q.hi THEN 0 ELSE greatest(0, ({predict_sql('q.hi')}) - ({predict_sql('q.lo')})) END AS mass FROM q CROSS JOIN model m)"


@query("popularity_point", X.CLUSTERS + ", " + CMS_SQL + ", " + PROBE_SQL + ", " + _POINT_POP + " SELECT query_id, round(popularity, 6) AS popularity, CASE WHEN popularity > 0 THEN cluster_id END AS cluster_id FROM pp")
def popularity_point(spark: SparkSession, sf: str) -> DataFrame:
    m, cms = _sketched(spark, sf)
    p = sketches.popularity_point(X.queries(spark, sf), cms, m)
    return p.select("query_id", F.round("popularity", 6).alias("popularity"), "cluster_id")


@query("popularity_range", X.CLUSTERS + ", " + CDF_SQL + ", " + LINEAR_SQL + ", " + _MASS + " SELECT query_id, round(max(mass), 5) AS popularity FROM mass GROUP BY query_id")
def popularity_range(spark: SparkSession, sf: str) -> DataFrame:
    return sketches.popularity_range(X.queries(spark, sf), sketches.linear_model(_cdf(spark, sf))).select("query_id", F.round("popularity", 5).alias("popularity"))


_AND_SQL = (
    X.CLUSTERS + ", " + CMS_SQL + ", " + PROBE_SQL + ", " + CDF_SQL + ", " + LINEAR_SQL + ", " + PLACED_SQL + ", " + MURMUR_SQL.format(p="c", source="cells") + ", " + MURMUR_SQL.format(p="b", source="placed")
    + f""", cell_fps AS (SELECT cluster_id, row, col, count(*) AS cnt, list_sort(list_distinct(list(h1 >> 16)))[1:1000] AS fps FROM cmurmur GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY cluster_id, bucket ORDER BY h1, h2) AS r FROM bmurmur),
bounds AS (SELECT q.query_id, m.cluster_id, least(floor(({predict_sql('q.lo')}) * 10)::BIGINT, 10) AS b0, least(floor(({predict_sql('q.hi')}) * 10)::BIGINT, 10) AS b1 FROM q CROSS JOIN model m),
in_range AS (SELECT b.query_id, b.cluster_id, list_distinct(list(r.h1 >> 16)) AS fps FROM bounds b JOIN ranked r ON r.cluster_id = b.cluster_id AND r.r <= 1000 AND r.bucket BETWEEN b.b0 AND b.b1 GROUP BY ALL),
probed AS (SELECT p.query_id, p.attr, t.cluster_id, arg_min(coalesce(c.fps, []), (coalesce(c.cnt, 0), p.row)) AS fps FROM probe_cells p CROSS JOIN totals t
  LEFT JOIN cell_fps c ON c.cluster_id = t.cluster_id AND c.row = p.row AND c.col = p.col GROUP BY ALL),
both_of AS (SELECT p.query_id, p.cluster_id, p.attr, len(list_intersect(p.fps, coalesce(i.fps, []))) AS common, len(p.fps) AS size FROM probed p LEFT JOIN in_range i USING (query_id, cluster_id)),
first_of AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY common DESC, cluster_id, attr) AS r FROM both_of)
SELECT query_id, cluster_id, common::BIGINT AS common, round(CASE WHEN size > 0 THEN common / size ELSE 0 END, 6) AS popularity FROM first_of WHERE r = 1"""
)


@query("popularity_and", _AND_SQL)
def popularity_and(spark: SparkSession, sf: str) -> DataFrame:
    (m, cms), b = _sketched(spark, sf), X.base(spark, sf)
    p = sketches.popularity_and(X.queries(spark, sf), cms, sketches.linear_model(sketches.cluster_cdf(m, b)), sketches.bottom_k(m, b))
    return p.select("query_id", "cluster_id", "common", F.round("popularity", 6).alias("popularity"))


@query("popularity_or", X.CLUSTERS + ", " + CMS_SQL + ", " + PROBE_SQL + ", " + _POINT_POP + ", " + CDF_SQL + ", " + LINEAR_SQL + ", " + _MASS
       + " SELECT query_id, round(popularity, 6) AS point, round(m, 5) AS mass FROM pp JOIN (SELECT query_id, max(mass) AS m FROM mass GROUP BY query_id) USING (query_id)")
def popularity_or(spark: SparkSession, sf: str) -> DataFrame:
    m, cms = _sketched(spark, sf)
    p = sketches.popularity_or(X.queries(spark, sf), cms, m, sketches.linear_model(sketches.cluster_cdf(m, X.base(spark, sf))))
    return p.select("query_id", F.round("point", 6).alias("point"), F.round("mass", 5).alias("mass"))


@query("top_clusters", X.CLUSTERS + ", " + CMS_SQL + ", " + PROBE_SQL + " SELECT query_id, cluster_id, est, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY est DESC, cluster_id) AS rank FROM (SELECT query_id, cluster_id, max(est) AS est FROM est GROUP BY ALL)) WHERE rank <= 5")
def top_clusters(spark: SparkSession, sf: str) -> DataFrame:
    return sketches.top_clusters(X.queries(spark, sf), _cms(spark, sf), 5)


@query("dyn_threshold", "SELECT vec_id AS ef, round(0.05 + ln(1 + least(vec_id, 1300)) / ln(1301) * 0.25, 6) AS threshold FROM embeddings")
def dyn_threshold(spark: SparkSession, sf: str) -> DataFrame:
    return X.vectors(spark, sf).select(F.col("id").alias("ef"), F.round(C.dynamic_threshold(F.col("id"), F.lit(0.05), F.lit(0.3)), 6).alias("threshold"))


@query("cluster_greedy")
def cluster_greedy(spark: SparkSession, sf: str) -> DataFrame:
    return sketches.greedy_clusters(X.edges(spark, sf), 100)


@query("cluster_per_seed")
def cluster_per_seed(spark: SparkSession, sf: str) -> DataFrame:
    return sketches.greedy_clusters(X.edges(spark, sf), 0)


# ---------------------------------------------------------------- approximate and filtered search


@query("index_build")
def index_build(spark: SparkSession, sf: str) -> DataFrame:
    """Elements, levels and links of the stored graph index."""
    return X.index(spark, sf).counts()


@query("index_edges")
def index_edges(spark: SparkSession, sf: str) -> DataFrame:
    return X.links(spark, sf).select("src", "dst", F.round("dist", 6).alias("dist"), "ord")


@query("ann_knn")
def ann_knn(spark: SparkSession, sf: str) -> DataFrame:
    return _out(strategies.ann_knn(X.index(spark, sf), X.queries(spark, sf), 10, 64))


@query("ann_beam")
def ann_beam(spark: SparkSession, sf: str) -> DataFrame:
    return _out(strategies.ann_beam(X.index(spark, sf), X.queries(spark, sf), 64))


@query("ann_strict")
def ann_strict(spark: SparkSession, sf: str) -> DataFrame:
    return _out(strategies.ann_knn(X.index(spark, sf), X.queries(spark, sf), 10, 64, where="point", mode="strict"))


@query("ann_radius")
def ann_radius(spark: SparkSession, sf: str) -> DataFrame:
    return _out(X.index(spark, sf).search(X.queries(spark, sf), 50, 128, exclude_self=True, within=RADIUS))


@query("ann_after_update")
def ann_after_update(spark: SparkSession, sf: str) -> DataFrame:
    """Search after a tenth of the vectors were negated in place, some deleted and some added."""

    def make():
        b = X.base(spark, sf)
        moved = b.where("id % 10 = 7").withColumn("embedding", F.transform("embedding", lambda x: -x))
        added = b.where("id % 10 = 3").withColumn("id", F.col("id") + 1_000_000)
        copy = strategies.GraphIndex.build(b, X.INDEX)
        return copy.add_items(moved.unionByName(added)).mark_deleted(b.where("id % 10 = 5 and id >= 20").select("id"))

    return _out(strategies.ann_knn(X.once(spark, sf, "updated", make), X.queries(spark, sf), 10, 64))


@query("search_dynamic")
def search_dynamic(spark: SparkSession, sf: str) -> DataFrame:
    m, (cms, _, _) = X.clusters(spark, sf), X.cluster_sketches(spark, sf)
    popular = sketches.popularity_point(X.queries(spark, sf), cms, m)
    return _out(strategies.dynamic(X.index(spark, sf), X.queries(spark, sf), 10, 64, "point", popular, strategies.threshold_for(cms, m, 64)))


def _predictive(where: str) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        m, (cms, model, minhash) = X.clusters(spark, sf).select("id", "cluster_id"), X.cluster_sketches(spark, sf)
        limit = strategies.threshold_for(cms, m, 64) if where == "point" else None
        return _out(strategies.predictive(X.index(spark, sf), X.base(spark, sf), X.queries(spark, sf), X.links(spark, sf), m, where, 10, 64, cms, model, minhash, limit))

    return run


for _where in ("point", "range", "and", "or"):
    query(f"search_{_where}")(_predictive(_where))


@query("search_pf_two_hop")
def search_pf_two_hop(spark: SparkSession, sf: str) -> DataFrame:
    m = X.clusters(spark, sf).select("id", "cluster_id")
    return _out(strategies.predictive(X.index(spark, sf), X.base(spark, sf), X.queries(spark, sf), X.links(spark, sf), m, "point", 10, 64, always_two=True))


@query("search_cluster_greedy")
def search_cluster_greedy(spark: SparkSession, sf: str) -> DataFrame:
    """Cluster-first over the greedy clusters, their seeds and their sketches, with the exit at half of the matches."""
    m, (cms, _, _) = X.clusters(spark, sf), X.cluster_sketches(spark, sf)
    return _out(strategies.cluster_first(X.base(spark, sf), X.queries(spark, sf), X.links(spark, sf), m, m.where("is_seed"), cms, 40, 10, half=True))


_CLUSTER_FIRST_SQL = (
    X.CLUSTERS + ", " + CMS_SQL + ", " + PROBE_SQL + _MASK_SQL
    + """, tc AS (SELECT query_id, cluster_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY est DESC, cluster_id) AS rank FROM (SELECT query_id, cluster_id, max(est) AS est FROM est GROUP BY ALL)) WHERE rank <= 20),
s0 AS (SELECT DISTINCT query_id, id FROM tc JOIN members USING (cluster_id)), s1 AS (SELECT query_id, id FROM s0 UNION SELECT s0.query_id, e.dst FROM s0 JOIN edges e ON e.src = s0.id),
s2 AS (SELECT query_id, id FROM s1 UNION SELECT s1.query_id, e.dst FROM s1 JOIN edges e ON e.src = s1.id),
met AS (SELECT q.query_id, base.id, """ + L2 + """ AS dist FROM (SELECT * FROM s2 SEMI JOIN mask USING (query_id, id)) s JOIN base ON base.id = s.id JOIN q ON q.query_id = s.query_id)
SELECT query_id, id, round(dist, 6) AS dist, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, id) AS rank FROM met) WHERE rank <= 10"""
)


@query("search_cluster_first", _CLUSTER_FIRST_SQL)
def search_cluster_first(spark: SparkSession, sf: str) -> DataFrame:
    b, e = X.base(spark, sf), X.edges(spark, sf)
    m = sketches.neighbourhood_membership(e)
    return _out(strategies.cluster_first(b, X.queries(spark, sf), e, m, m, materialise(sketches.cms_build(m, b), "cms"), 20, 10))


# ---------------------------------------------------------------- evaluation and generation

_RESULTS_SQL = f"""{X.SEED}, met AS (SELECT q.query_id, base.id, {L2} AS dist FROM base JOIN q ON {OTHER} AND {POINT}),
truth AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, id) AS rank FROM met) WHERE rank <= 10),
results AS (SELECT ef, query_id, id FROM truth CROSS JOIN (VALUES (20), (40)) e(ef) WHERE (id * 7 + ef) % 4 <> 0),
per AS (SELECT e.ef, t.query_id, count(r.id) AS match FROM (VALUES (20), (40)) e(ef) CROSS JOIN (SELECT DISTINCT query_id FROM truth) t LEFT JOIN results r ON r.ef = e.ef AND r.query_id = t.query_id GROUP BY ALL)"""


def _per_query(spark: SparkSession, sf: str) -> DataFrame:
    truth = search.top_k(X.base(spark, sf), X.queries(spark, sf), 10, where="point", exclude_self=True)
    efs = spark.createDataFrame([(20,), (40,)], "ef int")
    results = truth.crossJoin(efs).where("(id * 7 + ef) % 4 <> 0").select("ef", "query_id", "id")
    return evaluate.recall_per_query(results, truth)


@query("recall_per_query", _RESULTS_SQL + " SELECT ef, query_id, match FROM per")
def recall_per_query(spark: SparkSession, sf: str) -> DataFrame:
    return _per_query(spark, sf)


@query("recall_summary", _RESULTS_SQL + " SELECT ef, round(avg(match / 10), 6) AS recall FROM per GROUP BY ef")
def recall_summary(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.recall_summary(_per_query(spark, sf)).select("ef", F.round("recall", 6).alias("recall"))


def _selectivity(where: str) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        b, q = X.base(spark, sf), X.queries(spark, sf)
        s = evaluate.selectivity(strategies.masks(b, q, where, exclude_self=False), q, b.count())
        return s.select(F.round("selectivity", 6).alias("selectivity"))

    return run


for _where in ("point", "range"):
    query(f"selectivity_{_where}", f"{X.SEED}, n AS (SELECT q.query_id, count(base.id) AS n FROM q LEFT JOIN base ON {CONDITIONS[_where]} GROUP BY q.query_id) SELECT round(avg(n / (SELECT count(*) FROM base)), 6) AS selectivity FROM n")(_selectivity(_where))


@query("qps_parse", "SELECT event_id / 4 AS qps FROM events WHERE event_id < 100")
def qps_parse(spark: SparkSession, sf: str) -> DataFrame:
    lines = X.read(spark, sf, "events").where("event_id < 100").select(F.concat(F.lit("ef 20 QPS: "), (F.col("event_id") / 4).cast("string"), F.lit(" done")).alias("line"))
    return evaluate.parse_throughput(lines)


_MIXED = "((({c} % 2147483647) * 48271 + {s}) % 2147483647 * 69621 + 11) % 2147483647"


@query("gen_attr", f"""SELECT vec_id AS id, CASE WHEN p < 0.1 THEN 1 WHEN p < 0.4 THEN 3 WHEN p < 0.9 THEN 5 ELSE -1 END AS value
FROM (SELECT vec_id, (row_number() OVER (ORDER BY {_MIXED.format(c='vec_id', s=1)}, vec_id) - 1) / count(*) OVER () AS p FROM embeddings)""")
def gen_attr(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.by_share(X.vectors(spark, sf), [(1, 0.1), (3, 0.3), (5, 0.5), (-1, 0.1)])


@query("gen_counts", f"""WITH s AS (SELECT vec_id AS id, row_number() OVER (ORDER BY {_MIXED.format(c='vec_id', s=1)}, vec_id) AS r FROM embeddings)
SELECT id, CASE WHEN r <= 1 THEN 1 WHEN r <= 3 THEN 2 WHEN r <= 6 THEN 3 WHEN r <= 10 THEN 4 ELSE 0 END AS value FROM s""")
def gen_counts(spark: SparkSession, sf: str) -> DataFrame:
    """A skewed column with fixed counts: value v for exactly v rows."""
    return evaluate.by_count(X.vectors(spark, sf), {v: v for v in range(1, 5)})


@query("gen_query_docs", f"""SELECT e.vec_id AS id, array_to_string(list_transform(list_sort(list(q.vec_id)), lambda x: x::VARCHAR), ',') AS queries
FROM embeddings e JOIN embeddings q ON q.vec_id < 20 WHERE {_MIXED.format(c='(e.vec_id * 1009 + q.vec_id)', s=1)} % 10 = 0 GROUP BY e.vec_id""")
def gen_query_docs(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.query_lists(X.vectors(spark, sf), X.queries(spark, sf))


@query("value_distribution", "SELECT p_size AS value, count(*) AS n, round(100 * count(*) / sum(count(*)) OVER (), 6) AS percent FROM part GROUP BY p_size")
def value_distribution(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.value_distribution(X.read(spark, sf, "part").select(F.col("p_size").alias("value")), "value")


@query("correlation_attach", f"""{X.SEED}, met AS (SELECT q.query_id, base.id, {L2} AS dist FROM base JOIN q ON {OTHER}),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist DESC, id DESC) AS rank FROM met) WHERE rank <= 10)
SELECT id, array_to_string(list_transform(list_sort(list(query_id)), lambda x: x::VARCHAR), ',') AS queries FROM f GROUP BY id""")
def correlation_attach(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.correlation_attach(search.top_k(X.vectors(spark, sf), X.queries(spark, sf), 10, exclude_self=True, farthest=True))


@query("change_log", "SELECT vec_id AS id, round(CASE WHEN vec_id % 7 = 0 THEN -embedding[1]::DOUBLE ELSE embedding[1]::DOUBLE END, 6) AS first, vec_id % 5 = 0 AND vec_id % 10 <> 0 AS deleted FROM embeddings")
def change_log(spark: SparkSession, sf: str) -> DataFrame:
    """Upserts, deletions and restorations out of order, as a stream would bring them."""
    from ..streaming import changes

    t = _table(spark, sf).withColumn("version", F.lit(0).cast("bigint"))
    none = F.lit(None).cast("array<double>")
    log = _negated(t).select("id", "embedding", F.lit("upsert").alias("op"), F.lit(1).cast("bigint").alias("version"))
    log = t.where("id % 10 = 0").select("id", none.alias("embedding"), F.lit("undelete").alias("op"), F.lit(3).cast("bigint").alias("version")).unionByName(log)
    log = log.unionByName(t.where("id % 5 = 0").select("id", none.alias("embedding"), F.lit("delete").alias("op"), F.lit(2).cast("bigint").alias("version")))
    return changes.apply_batch(t, log).select("id", F.round(F.col("embedding")[0], 6).alias("first"), "deleted")
