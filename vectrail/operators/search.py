"""Exact search: filtered top-k, radius, document-level and farthest-first.

The batch operator scans the vectors once. Queries travel to the data while
they are few; every Arrow batch masks, measures with one matrix product and
keeps its own best k, so the only shuffle is of k rows per query and partition.
A query side over ``QUERY_LIMIT`` bytes meets the vectors in a grid of blocks.
``MANY`` queries without a predicate do so too, one cell to a task, where single
precision rules out nearly all pairs and double precision measures the rest.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.columns import METRICS

QUERY_LIMIT = 64 << 20
#: Queries from which on all pairs are dealt to cells, and the most rows and queries of a cell.
MANY, CELL_ROWS, CELL_QUERIES = 4096, 1 << 17, 1 << 16
PREDICATES = ("none", "point", "range", "and", "or")


def predicate(kind: str, attrs: Column, value: Column, q_attrs: Column, lo: Column, hi: Column) -> Column:
    """Whether a row matches a query; null attributes or bounds match nothing."""
    point = F.coalesce(F.arrays_overlap(attrs, q_attrs), F.lit(False))
    within = F.coalesce(value.between(lo, hi), F.lit(False))
    return {"none": F.lit(True), "point": point, "range": within, "and": point & within, "or": point | within}[kind]


def ranked(pairs: DataFrame, k: int, by: str = "query_id", descending: bool = False) -> DataFrame:
    """The k best rows per query with their rank; ties by id."""
    order = [F.col("dist").desc(), F.col("id").desc()] if descending else [F.col("dist"), F.col("id")]
    return pairs.withColumn("rank", F.row_number().over(W.partitionBy(by).orderBy(*order)).cast("bigint")).where(F.col("rank") <= k)


def _kernel(metric: str, x: np.ndarray, q: np.ndarray) -> np.ndarray:
    dot = x @ q.T
    if metric == "ip":
        return 1.0 - dot
    xx, qq = (x * x).sum(1), (q * q).sum(1)
    if metric == "cosine":
        scale = np.sqrt(np.outer(xx, qq))
        return np.where(scale > 0, 1.0 - dot / np.where(scale > 0, scale, 1), 1.0)
    return xx[:, None] + qq[None, :] - 2 * dot


def _exact(metric: str, x: np.ndarray, q: np.ndarray) -> np.ndarray:
    if metric == "l2":
        return ((x - q) ** 2).sum(1)
    dot = (x * q).sum(1)
    if metric == "ip":
        return 1.0 - dot
    scale = np.sqrt((x * x).sum(1) * (q * q).sum(1))
    return np.where(scale > 0, 1.0 - dot / np.where(scale > 0, scale, 1), 1.0)


def _mask(kind: str, pdf: pd.DataFrame, attrs: list, lo: np.ndarray, hi: np.ndarray) -> np.ndarray | None:
    if kind == "none":
        return None
    n, point, within = len(pdf), None, None
    if kind != "range":
        holders: dict[str, list[int]] = {}
        for i, row in enumerate(pdf["attrs"]):
            for a in row if row is not None else ():
                holders.setdefault(a, []).append(i)
        point = np.zeros((n, len(attrs)), bool)
        for j, wanted in enumerate(attrs):
            for a in wanted if wanted is not None else ():
                point[holders.get(a, []), j] = True
    if kind != "point":
        v = pd.to_numeric(pdf["value"]).to_numpy(float)[:, None]
        within = (v >= lo) & (v <= hi)
    return point if kind == "point" else within if kind == "range" else point & within if kind == "and" else point | within


Packed = tuple[np.ndarray, np.ndarray, list, np.ndarray, np.ndarray]
_NEAR = "query_id bigint, id bigint, dist double"


def _packed(asked: pd.DataFrame) -> Packed:
    n = len(asked)
    bounds = [asked[c].to_numpy(float) if c in asked else np.zeros(n) for c in ("lo", "hi")]
    return np.stack(asked["embedding"].to_numpy()).astype(np.float64), asked["query_id"].to_numpy(), asked["attrs"].tolist() if "attrs" in asked else [], bounds[0], bounds[1]


#: Distances that one task holds at a time.
TILE = 1 << 22


def _blocks(pdf: pd.DataFrame, asked: Packed, k: int, metric: str, where: str, exclude_self: bool, farthest: bool) -> Iterator[pd.DataFrame]:
    """The k best of one block of rows for each query, with a few to spare for ties that rounding hides; queries in tiles of TILE distances."""
    q, qids, attrs, lo, hi = asked
    x, ids = np.stack(pdf["embedding"].to_numpy()).astype(np.float64), pdf["id"].to_numpy()
    step = max(1, TILE // len(x))
    for at in range(0, len(q), step):
        part = slice(at, at + step)
        d = (-1.0 if farthest else 1.0) * _kernel(metric, x, q[part])
        keep = _mask(where, pdf, attrs[part], lo[part], hi[part])
        if keep is not None:
            d[~keep] = np.inf
        if exclude_self:
            d[ids[:, None] == qids[part][None, :]] = np.inf
        spare = min(len(x), k + 8)
        take = np.argpartition(d, spare - 1, 0)[:spare]
        rows, cols = take.ravel(), np.tile(np.arange(d.shape[1]), spare)
        good = np.isfinite(d[rows, cols])
        rows, cols = rows[good], cols[good] + at
        yield pd.DataFrame({"query_id": qids[cols], "id": ids[rows], "dist": _exact(metric, x[rows], q[cols])})


def _asked(queries: DataFrame, needs: list[str]) -> tuple[DataFrame, int, int, int]:
    """The queries that have a vector, their number, bytes and dimension; vectors of differing length are an error."""
    asked = queries.select("query_id", "embedding", *(["attrs"] if "attrs" in needs else []), *(["lo", "hi"] if "value" in needs else [])).where(F.col("embedding").isNotNull())
    n, size, low, high = asked.agg(F.count(F.lit(1)), F.sum(F.size("embedding").cast("bigint") * 8), F.min(F.size("embedding")), F.max(F.size("embedding"))).first()
    if n and low != high:
        raise ValueError(f"the queries' vectors have between {low} and {high} elements")
    return asked, n, size or 0, high or 0


def top_k(base: DataFrame, queries: DataFrame, k: int, metric: str = "l2", where: str = "none", exclude_self: bool = False, farthest: bool = False, query_limit: int = QUERY_LIMIT) -> DataFrame:
    """(query_id, id, dist, rank) with the k nearest (or farthest) rows of ``base`` per query.

    ``base``: id, embedding and, for a predicate, attrs and value. ``queries``:
    query_id, embedding and, likewise, attrs, lo and hi. ``dist`` is not
    rounded. Rows whose vector is null or of another dimension than the queries'
    are left out. Queries of up to ``query_limit`` bytes are broadcast; beyond,
    rows and queries are dealt to a grid of blocks that measure each other.
    """
    needs = {"none": [], "point": ["attrs"], "range": ["value"], "and": ["attrs", "value"], "or": ["attrs", "value"]}[where]
    asked, n, size, dim = _asked(queries, needs)
    if not n:
        return base.sparkSession.createDataFrame([], f"{_NEAR}, rank bigint")
    rows = base.select("id", "embedding", *needs).where(F.size("embedding") == dim)
    if n >= MANY and where == "none" and metric in ("l2", "ip") and not farthest:
        return _cells(rows, asked, n, dim, k, metric, exclude_self)
    if size > query_limit:
        return _grid(rows, asked, n, math.ceil(size / query_limit), k, metric, where, exclude_self, farthest)
    shared = base.sparkSession.sparkContext.broadcast(_packed(asked.toPandas()))

    def scan(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            if len(pdf):
                yield from _blocks(pdf, shared.value, k, metric, where, exclude_self, farthest)

    return ranked(rows.mapInPandas(scan, _NEAR), k, descending=farthest)


#: Queries and rows that meet at a time, rows that give the first limit, and candidates that are held at most.
QUERIES_MET, ROWS_MET, SAMPLE, HELD = 256, 4096, 4096, 1 << 20


def _nearest(x: np.ndarray, ids: np.ndarray, q: np.ndarray, qids: np.ndarray, k: int, metric: str, exclude_self: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query_id, id, dist) of the k nearest rows for each query, ties by id.

    A pair's closeness, the dot product (for l2 less half the row's squared
    length), is one matrix product in single precision. The k-th closest of
    some rows spread over all is a limit that the k nearest reach, but for an
    error that is bounded by the lengths; what reaches it is measured in double.
    """
    good = np.isfinite(x).all(1)
    x, ids = x[good], ids[good]
    good = np.isfinite(q).all(1)
    q, qids = q[good], qids[good]
    if not len(x) or not len(q):
        return
    xx, qq = (np.einsum("ij,ij->i", a, a, dtype=np.float64) for a in (x, q))
    kind = np.float32 if max(xx.max(), qq.max()) < 1e30 else np.float64
    error = 2.0 * np.finfo(kind).eps * (x.shape[1] + 8) * (np.sqrt(qq) + np.sqrt(xx.max())) ** 2 + 1e-30
    l2 = metric == "l2"
    wide = np.column_stack([x, -xx / 2 if l2 else np.zeros(len(x))]).astype(kind)
    asks = np.column_stack([q, np.ones(len(q))]).astype(kind)
    some = np.arange(0, len(x), max(1, len(x) // SAMPLE))

    def best(rows: np.ndarray, cols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        d = np.concatenate([_exact(metric, x[rows[i : i + 65536]].astype(np.float64), q[cols[i : i + 65536]].astype(np.float64)) for i in range(0, len(rows), 65536)] or [np.zeros(0)])
        order = np.lexsort((ids[rows], d, cols))
        rows, cols, d = rows[order], cols[order], d[order]
        first = np.arange(len(cols)) - np.searchsorted(cols, cols) < k
        keep = first & np.isfinite(d)
        return rows[keep], cols[keep], d[keep]

    for at in range(0, len(q), QUERIES_MET):
        part = asks[at : at + QUERIES_MET]
        limit = np.full(len(part), -np.inf)
        if len(some) >= k:
            near = part @ wide[some].T
            if exclude_self:
                near[qids[at : at + len(part), None] == ids[None, some]] = -np.inf
            limit = np.partition(near, len(some) - k, 1)[:, len(some) - k] - error[at : at + len(part)]
        held: list[tuple[np.ndarray, np.ndarray]] = []
        count = 0
        for start in range(0, len(x), ROWS_MET):
            block = wide[start : start + ROWS_MET]
            cols, rows = np.divmod(np.flatnonzero(part @ block.T >= limit.astype(kind)[:, None]), len(block))
            rows, cols = rows + start, cols + at
            if exclude_self:
                other = ids[rows] != qids[cols]
                rows, cols = rows[other], cols[other]
            held.append((rows, cols))
            count += len(rows)
            if count > HELD:  # far more than k a query: the k-th of them is a better limit
                rows, cols, d = best(*(np.concatenate(h) for h in zip(*held)))
                last = np.flatnonzero(np.arange(len(cols)) - np.searchsorted(cols, cols) == k - 1)
                close = (qq[cols[last]] - d[last]) / 2 if l2 else 1.0 - d[last]
                limit[cols[last] - at] = np.maximum(limit[cols[last] - at], close - error[cols[last]])
                held, count = [(rows, cols)], len(rows)
        rows, cols, d = best(*(np.concatenate(h) for h in zip(*held)))
        yield qids[cols], ids[rows], d


def _cells(rows: DataFrame, asked: DataFrame, n: int, dim: int, k: int, metric: str, exclude_self: bool) -> DataFrame:
    """Every block of rows with every block of queries, each pair of blocks in a task of its own; blocks are bounded, and small enough to keep all cores busy."""
    enough = math.ceil(math.sqrt(3 * rows.sparkSession.sparkContext.defaultParallelism))
    many = rows.count()
    down, across = (max(1, math.ceil(size / most), min(enough, math.ceil(size / MANY))) for size, most in ((many, CELL_ROWS), (n, CELL_QUERIES)))
    at = lambda c, m: F.pmod(F.xxhash64(c), F.lit(m)).cast("int")
    spread = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    mine = rows.select("id", "embedding", F.lit(False).alias("asks"), at("id", down).alias("r"), spread(across).alias("c"))
    theirs = asked.select(F.col("query_id").alias("id"), "embedding", F.lit(True).alias("asks"), at("query_id", across).alias("c"), spread(down).alias("r"))
    dealt = mine.unionByName(theirs).select("id", "embedding", "asks", (F.col("r") * across + F.col("c")).alias("cell"))

    def meet(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bool, list[tuple[np.ndarray, np.ndarray]]] = {False: [], True: []}
        for batch in it:
            asks = batch.column("asks")
            for side in held:
                some = batch.filter(asks if side else pa.compute.invert(asks))
                x = some.column("embedding").flatten().to_numpy(zero_copy_only=False)
                held[side].append((x.reshape(len(some), dim), some.column("id").to_numpy(zero_copy_only=False)))
        if not held[False] or not held[True]:
            return
        (x, ids), (q, qids) = (tuple(np.concatenate(p) for p in zip(*held.pop(side))) for side in (False, True))
        for found in _nearest(x, ids, q, qids, k, metric, exclude_self):
            yield pa.RecordBatch.from_arrays([pa.array(found[0], pa.int64()), pa.array(found[1], pa.int64()), pa.array(found[2], pa.float64())], ["query_id", "id", "dist"])

    return ranked(dealt.repartitionById(down * across, "cell").drop("cell").mapInArrow(meet, _NEAR), k)


def _grid(rows: DataFrame, asked: DataFrame, n: int, query_blocks: int, k: int, metric: str, where: str, exclude_self: bool, farthest: bool) -> DataFrame:
    """Every block of rows with every block of queries, neither of which leaves its cell."""
    row_blocks = max(1, math.ceil(rows.count() / max(1, n) * query_blocks))
    spread = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    mine = rows.select("*", F.pmod(F.xxhash64("id"), F.lit(row_blocks)).cast("int").alias("r"), spread(query_blocks).alias("c"))
    theirs = asked.select("*", F.pmod(F.xxhash64("query_id"), F.lit(query_blocks)).cast("int").alias("c"), spread(row_blocks).alias("r"))

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_id": [], "id": [], "dist": []}).astype({"query_id": "int64", "id": "int64", "dist": "float64"})
        if not len(left) or not len(right):
            return empty
        packed = _packed(right)
        best = empty
        for at in range(0, len(left), 8192):
            # what is kept between blocks stays at k rows a query
            best = pd.concat([best, *_blocks(left.iloc[at : at + 8192], packed, k, metric, where, exclude_self, farthest)])
            best = best.sort_values(["dist", "id"], ascending=not farthest, kind="stable").groupby("query_id", sort=False).head(k)
        return best

    near = mine.groupBy("r", "c").cogroup(theirs.groupBy("r", "c")).applyInPandas(meet, _NEAR)
    return ranked(near, k, descending=farthest)


def pairs(base: DataFrame, queries: DataFrame, where: str = "none", exclude_self: bool = False) -> DataFrame:
    """Matching (row, query) pairs as a join, for conditions and measures that stay in SQL."""
    q = queries.select(*[F.col(c).alias(c if c == "query_id" else f"q_{c}") for c in queries.columns])
    col = lambda c, d: F.col(c) if c in d.columns else F.lit(None)
    cond = predicate(where, col("attrs", base), col("value", base), col("q_attrs", q), col("q_lo", q), col("q_hi", q))
    if exclude_self:
        cond = cond & (F.col("id") != F.col("query_id"))
    return base.join(q, cond)


def joined(base: DataFrame, queries: DataFrame, k: int, metric: str = "l2", where: str = "none", exclude_self: bool = False, farthest: bool = False) -> DataFrame:
    """:func:`top_k` as one join in SQL, for small inputs and for checking the kernel."""
    met = pairs(base.where(F.col("embedding").isNotNull()), queries, where, exclude_self)
    return ranked(met.select("query_id", "id", METRICS[metric](F.col("embedding"), F.col("q_embedding")).alias("dist")), k, descending=farthest)


def within_radius(base: DataFrame, queries: DataFrame, radius: float, most: int, metric: str = "l2", exclude_self: bool = False) -> DataFrame:
    """Up to ``most`` rows per query with distance at most ``radius`` (squared for l2): the nearest, cut at the radius."""
    return top_k(base, queries, most, metric, exclude_self=exclude_self).where(F.col("dist") <= radius)


def _measured(base: DataFrame, queries: DataFrame, metric: str, exclude_self: bool, keep) -> DataFrame:
    """(query_id, doc_id, id, dist) of the rows that ``keep`` (distances, document codes, query numbers) picks of each block and tile of queries."""
    asked, n, size, dim = _asked(queries, [])
    schema = "query_id bigint, doc_id bigint, id bigint, dist double"
    if not n:
        return base.sparkSession.createDataFrame([], schema)
    if size > QUERY_LIMIT:
        raise ValueError("too many queries for one pass; deal them to several")
    shared = base.sparkSession.sparkContext.broadcast(_packed(asked.toPandas()))

    def scan(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        q, qids = shared.value[:2]
        for pdf in it:
            if not len(pdf):
                continue
            x, ids, docs = np.stack(pdf["embedding"].to_numpy()).astype(np.float64), pdf["id"].to_numpy(), pdf["doc_id"].to_numpy()
            step = max(1, TILE // len(x))
            for at in range(0, len(q), step):
                d = _kernel(metric, x, q[at : at + step])
                if exclude_self:
                    d[ids[:, None] == qids[at : at + step][None, :]] = np.inf
                rows, cols = keep(d, docs, qids[at : at + step])
                yield pd.DataFrame({"query_id": qids[cols + at], "doc_id": docs[rows], "id": ids[rows], "dist": _exact(metric, x[rows], q[cols + at])})

    rows = base.select("id", F.col("doc_id").cast("bigint").alias("doc_id"), "embedding").where((F.size("embedding") == dim) & F.col("doc_id").isNotNull())
    return rows.mapInPandas(scan, schema)


def _first_hits(base: DataFrame, queries: DataFrame, metric: str, exclude_self: bool) -> DataFrame:
    """(query_id, doc_id, hit): each document's nearest vector as struct (dist, id); a block sends one row per document."""

    def keep(d: np.ndarray, docs: np.ndarray, _: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(docs, kind="stable")
        first = np.flatnonzero(np.diff(docs[order], prepend=docs[order][0] - 1))
        low = np.minimum.reduceat(d[order], first, axis=0)
        near = d[order] <= low[np.repeat(np.arange(len(first)), np.diff(np.append(first, len(docs))))] + 1e-9  # ties, to be told apart exactly
        rows, cols = np.nonzero(near & np.isfinite(d[order]))
        return order[rows], cols

    met = _measured(base, queries, metric, exclude_self, keep)
    return met.groupBy("query_id", "doc_id").agg(F.min(F.struct("dist", "id")).alias("hit"))


def by_document(base: DataFrame, queries: DataFrame, documents: int, metric: str = "l2", exclude_self: bool = True) -> DataFrame:
    """Vectors in order of distance while they come from at most ``documents`` distinct doc_ids: all that are ahead of the first vector of one more."""
    order = W.partitionBy("query_id").orderBy("hit")
    hits = _first_hits(base, queries, metric, exclude_self).withColumn("r", F.row_number().over(order)).where(F.col("r") <= documents + 1)
    ends = hits.groupBy("query_id").agg(F.max(F.when(F.col("r") == documents + 1, F.col("hit"))).alias("end"))
    limit = {r["query_id"]: float("inf") if r["end"] is None else r["end"]["dist"] for r in ends.collect()}

    def keep(d: np.ndarray, _: np.ndarray, qids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        upto = np.array([limit.get(int(i), -np.inf) for i in qids])
        return np.nonzero((d <= upto[None, :] + 1e-9) & np.isfinite(d))

    met = _measured(base, queries, metric, exclude_self, keep)
    ahead = F.col("end").isNull() | (F.struct("dist", "id") < F.col("end"))
    return met.join(F.broadcast(ends) if len(limit) < 100_000 else ends, "query_id").where(ahead).select("query_id", "id", "doc_id", "dist")


def best_documents(base: DataFrame, queries: DataFrame, documents: int, metric: str = "l2", exclude_self: bool = True) -> DataFrame:
    """(query_id, doc_id, dist, rank): documents by their nearest vector."""
    near = _first_hits(base, queries, metric, exclude_self).select("query_id", F.col("doc_id").alias("id"), F.col("hit")["dist"].alias("dist"))
    return ranked(near, documents).withColumnRenamed("id", "doc_id")
