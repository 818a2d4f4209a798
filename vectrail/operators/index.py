"""A layered neighbour graph per shard, built once, stored and searched where it lies.

A shard is one row: its vectors, flags, levels and links packed as bytes, in a
folder of its own. A search reads those rows in place; only queries travel, and
k rows per query and shard come back. Changes rewrite the shards they touch
under a new version; a manifest names the current folder of every shard.
"""

from __future__ import annotations

import heapq
import io
import json
import math
import uuid
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialise, scratch_path
from .search import _exact, _kernel, _mask, ranked
from .table import IndexConfig, _checked

ROWS_PER_SHARD = 50_000
#: Distances, and links, that a task measures at a time.
TILE, MEASURED = 1 << 21, 1 << 15
_NEAR = "query_id bigint, id bigint, dist double, hops bigint, distances bigint"


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def drawn_levels(ids: np.ndarray, m: int, seed: int) -> np.ndarray:
    """Level of each id: geometric with base ``m``, from a hash of seed and id."""
    u = ((_mix(ids.astype(np.int64).view(np.uint64) + np.uint64(seed)) >> np.uint64(11)).astype(float) + 1) / 2.0**53
    return np.floor(-np.log(u) / math.log(max(2, m))).astype(np.int16)


class _Inbound:
    """Where the links of a level come from: those it had at first, and those set since. Links that have gone are still among them."""

    def __init__(self, links: dict[int, np.ndarray]) -> None:
        held = np.fromiter(map(len, links.values()), np.int64, len(links))
        src = np.repeat(np.fromiter(links, np.int32, len(links)), held)
        dst = np.concatenate([*links.values(), np.zeros(0, np.int32)]).astype(np.int32)
        order = np.argsort(dst, kind="stable")
        self.src, self.dst, self.since = src[order], dst[order], {}

    def note(self, node: int, to: np.ndarray) -> None:
        for j in to.tolist():
            self.since.setdefault(j, set()).add(node)

    def of(self, node: int) -> list[int]:
        a, b = np.searchsorted(self.dst, [node, node + 1])
        return sorted({*self.src[a:b].tolist(), *self.since.get(node, ())})


class Graph:
    """One shard. ``links[l][i]`` are the neighbours of node i on level l; upper levels hold only the nodes drawn for them."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, m: int = 16, ef_construction: int = 64, seed: int = 100, metric: str = "l2") -> None:
        self.x, self.ids, self.m, self.ef_construction, self.seed, self.metric = np.ascontiguousarray(x, np.float32), ids.astype(np.int64), m, ef_construction, seed, metric
        self.deleted = np.zeros(len(ids), bool)
        self.level = drawn_levels(self.ids, m, seed)
        self.links: list[dict[int, np.ndarray]] = []
        self.hops = self.distances = 0
        self.inbound: list[_Inbound] | None = None
        self._place()
        for at in range(int(self.level.max(initial=0)) + 1):
            self.links.append(self._linked(np.flatnonzero(self.level >= at), self._most(at)))

    def _place(self) -> None:
        self.row = {int(i): n for n, i in enumerate(self.ids)}
        self.entry = int(self.level.argmax()) if len(self.level) else -1

    def _most(self, level: int) -> int:
        return self.m if level else 2 * self.m

    def _between(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return _kernel(self.metric, a, b)

    def _diverse(self, node: int, near: np.ndarray, dist: np.ndarray, most: int) -> np.ndarray:
        """Of ``near``, nearest first, those no nearer to a kept one than to ``node``, at most ``most``; few are all kept."""
        if len(near) <= 1 or len(near) < most:
            return near[:most]
        inner, kept = self._between(self.x[near], self.x[near]), [0]
        closest = inner[0].copy()
        for i in range(1, len(near)):
            if closest[i] >= dist[i]:
                kept.append(i)
                if len(kept) == most:
                    break
                np.minimum(closest, inner[i], out=closest)
        return near[kept]

    def _linked(self, nodes: np.ndarray, most: int) -> dict[int, np.ndarray]:
        """Links among ``nodes``: diverse ones of the nearest, in both directions, cut back to ``most``."""
        want = min(len(nodes) - 1, max(self.ef_construction, self.m))
        if want < 1:
            return {int(n): np.zeros(0, np.int32) for n in nodes}
        src: list[np.ndarray] = []
        dst: list[np.ndarray] = []
        step = max(1, TILE // len(nodes))
        for at in range(0, len(nodes), step):
            part = nodes[at : at + step]
            d = self._between(self.x[part], self.x[nodes])
            d[np.arange(len(part)), np.arange(at, at + len(part))] = np.inf
            take = np.argpartition(d, want - 1, 1)[:, :want]
            near = np.take_along_axis(d, take, 1)
            order = np.lexsort((nodes[take], near), 1)
            take, near = np.take_along_axis(take, order, 1), np.take_along_axis(near, order, 1)
            mine = [self._diverse(n, nodes[take[i]], near[i], self.m).astype(np.int32) for i, n in enumerate(part.tolist())]
            src.append(np.repeat(part.astype(np.int32), list(map(len, mine))))
            dst.append(np.concatenate(mine))
        one, two = np.concatenate(src), np.concatenate(dst)
        links = np.unique(np.concatenate([one, two]).astype(np.int64) << 32 | np.concatenate([two, one]))
        to, ends = (links & 0xFFFFFFFF).astype(np.int32), np.searchsorted(links >> 32, nodes, "right")
        return {n: self._cut(n, to[a:b], most) for n, a, b in zip(nodes.tolist(), [0, *ends.tolist()], ends.tolist())}

    def _cut(self, node: int, to: np.ndarray, most: int) -> np.ndarray:
        if len(to) <= most:
            return to.astype(np.int32)
        d = self._between(self.x[to], self.x[node : node + 1])[:, 0]
        order = np.lexsort((to, d))
        kept = self._diverse(node, to[order], d[order], most)
        return kept.astype(np.int32)

    # ------------------------------------------------------------ search

    def _to(self, q: np.ndarray, at: list[int] | np.ndarray) -> np.ndarray:
        self.distances += len(at)
        return self._between(self.x[at], q[None])[:, 0]

    def descend(self, q: np.ndarray, to: int = 0, start: int | None = None) -> int:
        """The node that greedy steps down to just above level ``to`` end at."""
        at = self.entry if start is None else start
        best = float(self._to(q, [at])[0])
        for level in range(len(self.links) - 1, to, -1):
            while True:
                near = self.links[level].get(at)
                if near is None or not len(near):
                    break
                self.hops += 1
                d = self._to(q, near)
                i = int(d.argmin())
                if d[i] >= best:
                    break
                best, at = float(d[i]), int(near[i])
        return at

    def beam(self, q: np.ndarray, ef: int, allowed: np.ndarray | None = None, widen: bool = False, level: int = 0, start: int | None = None) -> list[tuple[float, int]]:
        """The ``ef`` best nodes met from the entry on. With ``allowed`` only those are walked and returned; ``widen`` looks through the others to their neighbours."""
        links = self.links[level]
        first = self.descend(q, level) if start is None else start
        seen = {first}
        d = float(self._to(q, [first])[0])
        todo, best = [(d, first)], []
        if allowed is None or allowed[first]:
            best.append((-d, first))
        while todo:
            d, i = heapq.heappop(todo)
            if len(best) >= ef and d > -best[0][0]:
                break
            self.hops += 1
            fresh: list[int] = []
            for j in links[i].tolist():
                if j in seen:
                    continue
                seen.add(j)
                if allowed is None or allowed[j]:
                    fresh.append(j)
                elif widen:
                    for e in links[j].tolist():
                        if e not in seen and allowed[e]:
                            seen.add(e)
                            fresh.append(e)
                    if len(best) < ef:
                        fresh.append(j)
                elif len(best) < ef:
                    fresh.append(j)  # too few that match were met so far: the walk goes on through others
            if not fresh:
                continue
            for dj, j in zip(self._to(q, fresh).tolist(), fresh):
                if len(best) < ef or dj < -best[0][0]:
                    heapq.heappush(todo, (dj, j))
                    if allowed is None or allowed[j]:
                        heapq.heappush(best, (-dj, j))
                        if len(best) > ef:
                            heapq.heappop(best)
        return sorted((-d, i) for d, i in best)

    def measured(self, level: int) -> Iterator[pd.DataFrame]:
        """(src, dst, dist, ord) of a level's links, those of whole nodes, some MEASURED at a time: both ends' vectors in double take a kilobyte a link."""
        links = self.links[level] if level < len(self.links) else {}
        nodes, held = np.array(list(links), np.int64), np.array([len(v) for v in links.values()], np.int64)
        for part in np.split(nodes, np.flatnonzero(np.diff(np.cumsum(held) // MEASURED, prepend=0))):
            if not len(part):
                continue
            src = np.repeat(part, [len(links[n]) for n in part.tolist()])
            dst = np.concatenate([links[n] for n in part.tolist()]).astype(np.int64)
            d = _exact(self.metric, self.x[dst].astype(np.float64), self.x[src].astype(np.float64))
            order = np.lexsort((self.ids[dst], d, src))
            src, dst, d = src[order], dst[order], d[order]
            rank = np.arange(len(src)) - np.searchsorted(src, src) + 1
            yield pd.DataFrame({"src": self.ids[src], "dst": self.ids[dst], "dist": d, "ord": rank})

    # ------------------------------------------------------------ changes

    def _join(self, node: int) -> None:
        """Link a node whose vector is in place, from its level down."""
        top, level = len(self.links) - 1, int(self.level[node])
        if len(self.x) > 1:
            at = self.descend(self.x[node], min(level, top)) if self.entry != node else next(n for n in range(len(self.x)) if n != node)
            for up in range(min(level, top), -1, -1):
                if at not in self.links[up]:
                    at = next((n for n in self.links[up] if n != node), node)
                found = [(d, i) for d, i in self.beam(self.x[node], self.ef_construction, level=up, start=at) if i != node] if at != node else []
                near, dist = np.array([i for _, i in found], np.int32), np.array([d for d, _ in found])
                mine = self._diverse(node, near, dist, self.m).astype(np.int32)
                self._link(up, node, mine)
                for j in mine.tolist():
                    self._link(up, j, self._cut(j, np.union1d(self.links[up][j], [node]).astype(np.int32), self._most(up)))
                at = int(near[0]) if len(near) else at
        for up in range(len(self.links), level + 1):
            self.links.append({})
        for up in range(level + 1):
            self.links[up].setdefault(node, np.zeros(0, np.int32))
        if level > self.level[self.entry]:
            self.entry = node  # the first of the highest level, as it was before

    def _link(self, level: int, node: int, to: np.ndarray) -> None:
        self.links[level][node] = to
        if self.inbound is not None and level < len(self.inbound):
            self.inbound[level].note(node, to)

    def _sources(self, level: int, node: int) -> list[int]:
        """The nodes that are linked to ``node``; the index of them is made once for a series of changes."""
        if self.inbound is None:
            self.inbound = []
        for links in self.links[len(self.inbound) :]:
            self.inbound.append(_Inbound(links))
        links = self.links[level]
        return [j for j in self.inbound[level].of(node) if j in links and (links[j] == node).any()]

    def _leave(self, node: int) -> None:
        """Unlink a node and repair those it was linked from: they choose anew among their own and its neighbours."""
        for up, links in enumerate(self.links):
            mine = links.pop(node, None)
            if mine is None:
                continue
            for j in self._sources(up, node):
                self._link(up, j, self._cut(j, np.setdiff1d(np.union1d(links[j], mine), [node, j]).astype(np.int32), self._most(up)))

    def upsert(self, ids: np.ndarray, x: np.ndarray) -> None:
        """Insert new ids; known ones get their new vector, are linked anew, and live again."""
        x = x.astype(np.float32)
        n, new = len(self.ids), sum(i not in self.row for i in ids.tolist())
        room = {}  # what the arrays grow into, so that an insertion doesn't copy them
        for name, width in (("x", (x.shape[1],)), ("ids", ()), ("level", ()), ("deleted", ())):
            held = getattr(self, name)
            room[name] = np.zeros((n + new, *width), held.dtype)
            room[name][:n] = held if n else 0
            setattr(self, name, room[name][:n])
        for i, v in zip(ids.tolist(), x):
            node = self.row.get(i)
            if node is None:
                node = len(self.ids)
                room["ids"][node], room["x"][node], room["level"][node] = i, v, drawn_levels(np.array([i]), self.m, self.seed)[0]
                self.ids, self.x, self.level, self.deleted = (room[name][: node + 1] for name in ("ids", "x", "level", "deleted"))
                self.row[i] = node
                self.entry = self.entry if node else 0
            else:
                self._leave(node)
                self.x[node], self.deleted[node] = v, False
            self._join(node)

    def replace(self, node: int, new_id: int, v: np.ndarray) -> None:
        """A deleted node's place for a new element."""
        self._leave(node)
        self.row.pop(int(self.ids[node]))
        self.ids[node], self.x[node], self.deleted[node] = new_id, v, False
        self.row[new_id] = node
        self._join(node)

    # ------------------------------------------------------------ bytes

    def pack(self) -> bytes:
        parts = {"x": self.x, "ids": self.ids, "deleted": self.deleted, "level": self.level, "meta": np.frombuffer(json.dumps([self.m, self.ef_construction, self.seed, self.metric, len(self.links)]).encode(), np.uint8)}
        for at, links in enumerate(self.links):
            nodes = np.array(sorted(links), np.int32)
            parts[f"n{at}"] = nodes
            parts[f"c{at}"] = np.array([len(links[n]) for n in nodes.tolist()], np.int32)
            parts[f"l{at}"] = np.concatenate([links[n] for n in nodes.tolist()] or [np.zeros(0, np.int32)]).astype(np.int32)
        out = io.BytesIO()
        np.savez(out, **parts)
        return out.getvalue()

    @classmethod
    def unpack(cls, blob: bytes) -> Graph:
        held = np.load(io.BytesIO(blob))
        self = cls.__new__(cls)
        self.x, self.ids, self.deleted, self.level = held["x"].copy(), held["ids"].copy(), held["deleted"].copy(), held["level"].copy()
        self.m, self.ef_construction, self.seed, self.metric, layers = json.loads(held["meta"].tobytes().decode())
        self.links, self.hops, self.distances, self.inbound = [], 0, 0, None
        for at in range(layers):
            nodes, ends = held[f"n{at}"].tolist(), np.cumsum(held[f"c{at}"])[:-1]
            self.links.append(dict(zip(nodes, np.split(held[f"l{at}"], ends))) if nodes else {})
        self._place()
        return self


_KEPT: dict[tuple[str, int], Graph] = {}


def _graph(file: str, shard: int, blob: Callable[[], bytes]) -> Graph:
    """The unpacked graph of a shard, kept by the worker while its file is the current one."""
    key = (file, shard)
    if key not in _KEPT:
        if len(_KEPT) >= 4:
            _KEPT.pop(next(iter(_KEPT)))
        _KEPT[key] = Graph.unpack(blob())
    return _KEPT[key]


def _run(g: Graph, facts: str, asked: pd.DataFrame, q: np.ndarray, k: int, ef: int, where: str, mode: str, exclude_self: bool, allowed, within, metric: str) -> pd.DataFrame:
    live = ~g.deleted
    if allowed is not None:
        live = live & np.asarray(allowed(g.ids), bool)
    match = None
    if where != "none":
        held = json.loads(facts)
        rows = pd.DataFrame({"attrs": held["attrs"] or [None] * len(g.ids), "value": held["value"] or [None] * len(g.ids)})
        bounds = [asked[c].to_numpy(float) if c in asked else np.zeros(len(asked)) for c in ("lo", "hi")]
        match = _mask(where, rows, asked["attrs"].tolist() if "attrs" in asked else [], *bounds)
    out: list[tuple[np.ndarray, ...]] = []
    for j, (qid, rare) in enumerate(zip(asked["query_id"], asked["rare"])):
        g.hops = g.distances = 0
        keep = live if match is None else live & match[:, j]
        if not keep.any() or g.entry < 0:
            continue
        if mode == "plain" or match is None:  # deleted and disallowed nodes are passed through
            found = g.beam(q[j], ef + 1, None if live.all() else live, widen=True)
        else:
            found = g.beam(q[j], ef + 1, keep, widen=mode == "dynamic" and bool(rare))
        at = [i for _, i in found if keep[i] and not (exclude_self and g.ids[i] == qid)][:ef]
        if at:
            d = _exact(metric, g.x[at].astype(np.float64), np.broadcast_to(q[j].astype(np.float64), (len(at), q.shape[1])))
            good = np.ones(len(at), bool) if within is None else d <= within
            out.append((np.full(good.sum(), qid), g.ids[at][good], d[good], np.full(good.sum(), g.hops), np.full(good.sum(), g.distances)))
    columns = ["query_id", "id", "dist", "hops", "distances"]
    if not out:
        return pd.DataFrame({c: [] for c in columns}).astype({"query_id": "int64", "id": "int64", "dist": "float64", "hops": "int64", "distances": "int64"})
    return pd.DataFrame({c: np.concatenate([o[i] for o in out]) for i, c in enumerate(columns)})


@dataclass(frozen=True)
class GraphIndex:
    """A stored index: ``files`` has the folder of each shard; ``attrs`` and ``value`` are kept beside the vectors where the rows have them."""

    spark: SparkSession
    path: str
    config: IndexConfig
    files: dict[int, str] = field(default_factory=dict)
    version: int = 0

    @classmethod
    def build(cls, vectors: DataFrame, config: IndexConfig, path: str | None = None, rows_per_shard: int = ROWS_PER_SHARD) -> GraphIndex:
        """``vectors``: id, embedding and, if predicates are to be tested during traversal, attrs and value. Rows that don't fit the dimension are dropped."""
        fit = vectors.where((F.size("embedding") == config.dim) & ~F.exists("embedding", lambda x: x.isNull()))
        shards = max(1, math.ceil(fit.count() / rows_per_shard))
        index = cls(vectors.sparkSession, path or scratch_path(vectors.sparkSession, "index"), replace(config, shards=shards))
        extra = [c for c in ("attrs", "value") if c in vectors.columns]
        rows = fit.select(index._shard("id").alias("shard"), "id", "embedding", *extra)

        def one(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.drop_duplicates("id", keep="last").sort_values("id")
            g = Graph(np.stack(pdf["embedding"].to_numpy()), pdf["id"].to_numpy(), config.m, config.ef_construction, config.seed, config.metric)
            facts = json.dumps({"attrs": [None if a is None else list(a) for a in pdf["attrs"]] if "attrs" in extra else None, "value": [None if v != v else int(v) for v in pdf["value"]] if "value" in extra else None})
            return pd.DataFrame({"shard": pdf["shard"].iloc[:1], "n": len(pdf), "blob": [g.pack()], "facts": facts})

        return index._written(rows.groupBy("shard").applyInPandas(one, "shard int, n bigint, blob binary, facts string"))

    def _shard(self, column: str):
        return F.pmod(F.xxhash64(column), F.lit(self.config.shards)).cast("int")

    def _written(self, shards: DataFrame) -> GraphIndex:
        """With the shards given in place of their former ones."""
        version = self.version + 1
        folder = f"{self.path}/v{version}-{uuid.uuid4().hex[:8]}"  # two indexes may be changed from one
        shards.write.partitionBy("shard").parquet(folder)
        fs = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        names = [x.getPath().getName() for x in fs.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(fs)]
        files = {int(n[6:]): f"{folder}/{n}" for n in names if n.startswith("shard=")}
        made = replace(self, files={**self.files, **files}, version=version)
        meta = json.dumps({"config": asdict(made.config), "files": {str(k): v for k, v in made.files.items()}, "version": version})
        self.spark.createDataFrame([(meta,)], "meta string").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/meta")
        return made

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> GraphIndex:
        meta = spark.read.parquet(f"{path}/meta").first()
        if meta is None:
            raise ValueError(f"{path} has no index")
        held = json.loads(meta["meta"])
        return cls(spark, path, IndexConfig(**held["config"]), {int(k): v for k, v in held["files"].items()}, held["version"])

    def copy_to(self, path: str) -> GraphIndex:
        """The current version of every shard under another path."""
        empty = replace(self, path=path, files={}, version=0)
        return empty._written(self.shards().select(F.regexp_extract("file", r"shard=(\d+)", 1).cast("int").alias("shard"), "n", "blob", "facts")) if self.files else empty

    def set_ef(self, ef: int) -> GraphIndex:
        return replace(self, config=replace(self.config, ef=ef))

    def shards(self) -> DataFrame:
        """(n, blob, facts, file): a row per shard, read where it lies."""
        if not self.files:
            return self.spark.createDataFrame([], "n bigint, blob binary, facts string, file string")
        read = self.spark.read.schema("n bigint, blob binary, facts string").parquet(*self.files.values())
        return read.withColumn("file", F.input_file_name())

    # ------------------------------------------------------------ search

    def search(self, queries: DataFrame, k: int, ef: int | None = None, where: str = "none", mode: str = "plain", rare: DataFrame | None = None, exclude_self: bool = False, allowed: Callable[[np.ndarray], np.ndarray] | None = None, within: float | None = None) -> DataFrame:
        """(query_id, id, dist, rank, hops, distances): the ``k`` nearest live rows that the beams of ``ef`` find.

        ``mode``: ``plain`` walks all nodes and drops what doesn't match
        afterwards, ``strict`` walks matching nodes only, ``dynamic`` looks
        through others too where ``rare`` (query_id, rare) says so. ``allowed``
        maps ids to a mask of those that may be returned. ``within`` is a radius.
        The last two columns count the steps and distances in the row's shard.
        """
        ef = max(ef or self.config.ef, k)
        need = [c for c in ("attrs", "lo", "hi") if where != "none" and c in queries.columns]
        asked = queries.select("query_id", "embedding", *need)
        asked = asked.join(rare.select("query_id", "rare"), "query_id", "left") if rare is not None else asked.withColumn("rare", F.lit(True))
        asked = materialise(asked, "asked")
        size = asked.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("embedding").cast("bigint") * 8).alias("bytes")).first()
        if not size["n"]:
            return self.spark.createDataFrame([], f"{_NEAR}, rank bigint")
        if size["bytes"] > 64 << 20:  # too many to travel at once: in parts
            parts = math.ceil(size["bytes"] / (64 << 20))
            found = None
            for p in range(parts):
                some = self.search(asked.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == p), k, ef, where, mode, rare, exclude_self, allowed, within)
                found = some if found is None else found.unionByName(some)
            return found
        shared = self.spark.sparkContext.broadcast(asked.toPandas())
        metric = self.config.metric

        def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            asked = shared.value
            q = np.stack(asked["embedding"].to_numpy()).astype(np.float32)
            for pdf in it:
                for n, blob, facts, file in zip(pdf["n"], pdf["blob"], pdf["facts"], pdf["file"]):
                    g = _graph(file, int(n), lambda b=blob: b)
                    yield _run(g, facts, asked, q, k, ef, where, mode, exclude_self, allowed, within, metric)

        return ranked(self.shards().mapInPandas(run, _NEAR), k)

    # ------------------------------------------------------------ contents

    def _each(self, use: Callable[[Graph], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
        def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in it:
                for blob in pdf["blob"]:
                    yield from use(Graph.unpack(blob))

        return self.shards().mapInPandas(run, schema)

    def edges(self, level: int = 0) -> DataFrame:
        """(src, dst, dist, ord, shard) of one level, nearest first."""
        return self._each(lambda g: g.measured(level), "src bigint, dst bigint, dist double, ord bigint").withColumn("shard", self._shard("src"))

    def rows(self) -> DataFrame:
        """(id, embedding, deleted, level)."""
        return self._each(lambda g: iter([pd.DataFrame({"id": g.ids, "embedding": list(g.x), "deleted": g.deleted, "level": g.level.astype(int)})]), "id bigint, embedding array<float>, deleted boolean, level int")

    def counts(self) -> DataFrame:
        """One row: elements, deleted ones, the highest level and the number of links."""
        each = self._each(lambda g: iter([pd.DataFrame({"n": [len(g.ids)], "d": [int(g.deleted.sum())], "l": [len(g.links) - 1], "e": [sum(map(len, g.links[0].values()))]})]), "n bigint, d bigint, l int, e bigint")
        return each.agg(F.sum("n").alias("elements"), F.sum("d").alias("deleted"), F.max("l").alias("levels"), F.sum("e").alias("links"))

    # ------------------------------------------------------------ changes

    def _changed(self, changes: DataFrame, use: Callable[[Graph | None, pd.DataFrame, dict], tuple[Graph, dict]]) -> GraphIndex:
        """Rewrite the shards that ``changes`` (with id) fall into."""
        dealt = materialise(changes.withColumn("shard", self._shard("id")), "changes")
        touched = [r["shard"] for r in dealt.select("shard").distinct().collect()]
        known = {s: self.files[s] for s in touched if s in self.files}
        held = replace(self, files=known).shards().select(F.regexp_extract("file", r"shard=(\d+)", 1).cast("int").alias("shard"), "blob", "facts") if known else self.spark.createDataFrame([], "shard int, blob binary, facts string")

        def one(old: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
            facts = json.loads(old["facts"].iloc[0]) if len(old) else {"attrs": None, "value": None}
            g, facts = use(Graph.unpack(old["blob"].iloc[0]) if len(old) else None, new, facts)
            return pd.DataFrame({"shard": new["shard"].iloc[:1], "n": len(g.ids), "blob": [g.pack()], "facts": json.dumps(facts)})

        return self._written(held.groupBy("shard").cogroup(dealt.groupBy("shard")).applyInPandas(one, "shard int, n bigint, blob binary, facts string"))

    def add_items(self, vectors: DataFrame) -> GraphIndex:
        """Insert or update (id, embedding[, attrs, value]); touched shards are linked anew around the changed nodes only."""
        c = self.config
        n = vectors.select("id").distinct().count() + sum(r["n"] for r in self.shards().select("n").collect())
        if n > c.max_elements:
            raise ValueError("the number of elements exceeds the limit")

        def use(g: Graph | None, new: pd.DataFrame, facts: dict) -> tuple[Graph, dict]:
            new = new.drop_duplicates("id", keep="last").sort_values("id")
            x = np.stack(new["embedding"].to_numpy())
            if g is None:
                g, old = Graph(x, new["id"].to_numpy(), c.m, c.ef_construction, c.seed, c.metric), 0
            else:
                old = len(g.ids)
                g.upsert(new["id"].to_numpy(), x)
            for name in ("attrs", "value"):
                if name in new:
                    column = (facts[name] or [None] * old) + [None] * (len(g.ids) - len(facts[name] or [None] * old))
                    for i, v in zip(new["id"].tolist(), new[name]):
                        column[g.row[i]] = list(v) if name == "attrs" and v is not None else v if name == "attrs" else None if v != v else int(v)
                    facts[name] = column
                elif facts[name] is not None:
                    facts[name] += [None] * (len(g.ids) - len(facts[name]))
            return g, facts

        return self._changed(vectors, use)

    def _flagged(self, ids: DataFrame, deleted: bool) -> GraphIndex:
        """Unknown ids, and ids already in that state, are errors."""
        _checked(self.rows(), ids, deleted)

        def use(g: Graph | None, new: pd.DataFrame, facts: dict) -> tuple[Graph, dict]:
            g.deleted[[g.row[i] for i in new["id"].tolist()]] = deleted
            return g, facts

        return self._changed(ids.select("id"), use)

    def mark_deleted(self, ids: DataFrame) -> GraphIndex:
        return self._flagged(ids, True)

    def unmark_deleted(self, ids: DataFrame) -> GraphIndex:
        return self._flagged(ids, False)

    def replace_deleted(self, vectors: DataFrame) -> GraphIndex:
        """New elements (id, embedding) take the places of deleted ones in their shards, smallest ids first; the rest are inserted."""
        if not self.config.allow_replace_deleted:
            raise ValueError("replacement of deleted elements is disabled")
        c = self.config

        def use(g: Graph | None, new: pd.DataFrame, facts: dict) -> tuple[Graph, dict]:
            new = new.drop_duplicates("id", keep="last").sort_values("id")
            if g is None:
                return Graph(np.stack(new["embedding"].to_numpy()), new["id"].to_numpy(), c.m, c.ef_construction, c.seed, c.metric), facts
            free = sorted(np.flatnonzero(g.deleted).tolist(), key=lambda n: int(g.ids[n]))
            for i, v in zip(new["id"].tolist(), new["embedding"]):
                if i not in g.row and free:
                    node = free.pop(0)
                    g.replace(node, i, np.asarray(v, np.float32))
                    for name in ("attrs", "value"):
                        if facts[name] is not None:
                            facts[name][node] = None
                else:
                    g.upsert(np.array([i]), np.asarray(v, np.float32)[None])
            for name in ("attrs", "value"):
                if facts[name] is not None:
                    facts[name] += [None] * (len(g.ids) - len(facts[name]))
            return g, facts

        return self._changed(vectors.select("id", "embedding"), use)
