"""The stored graph index: recall, changes, persistence, filters; and exact search of many queries in little memory."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pandas as pd
import pytest

from vectrail.operators import search
from vectrail.operators.index import Graph, GraphIndex, drawn_levels
from vectrail.operators.table import IndexConfig


def _unit(n, d=24, seed=0):
    x = np.random.default_rng(seed).normal(size=(n, d)).astype(np.float32)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _recall(g, x, q, k=10, ef=60):
    d = ((q[:, None].astype(float) - x[None]) ** 2).sum(-1)
    true = np.argsort(d, 1)[:, :k]
    return np.mean([len({i for _, i in g.beam(v, ef)[:k]} & set(t.tolist())) / k for v, t in zip(q, true)])


def _sound(g):
    for level, links in enumerate(g.links):
        assert set(links) == {n for n in range(len(g.ids)) if g.level[n] >= level}
        for n, to in links.items():
            assert n not in to and len(set(to.tolist())) == len(to) <= g._most(level)
            assert all(j in links for j in to.tolist())


def test_built_graph():
    x, q = _unit(1500), _unit(60, seed=1)
    g = Graph(x, np.arange(1500), 12, 48)
    _sound(g)
    assert len(g.links) > 1 and _recall(g, x, q) > 0.95
    g.distances = g.hops = 0
    g.beam(q[0], 20)
    assert 0 < g.hops < g.distances < 1500
    inbound = np.bincount(np.concatenate(list(g.links[0].values())), minlength=1500)
    assert inbound.min() >= 1


def test_levels_are_geometric():
    level = drawn_levels(np.arange(100_000), 16, 100)
    assert abs((level >= 1).mean() - 1 / 16) < 0.005 and abs((level >= 2).mean() - 1 / 256) < 0.002


def test_inserted_updated_and_replaced():
    x, q = _unit(1200), _unit(60, seed=1)
    g = Graph(x[:600], np.arange(600), 12, 48)
    g.upsert(np.arange(600, 1200), x[600:])
    _sound(g)
    assert _recall(g, x, q) > 0.95
    for seed in (5, 6):  # every vector moves, twice
        x = _unit(1200, seed=seed)
        g.upsert(np.arange(1200), x)
    _sound(g)
    assert _recall(g, x, q) > 0.95
    g.deleted[[3, 4]] = True
    g.replace(3, 9000, q[0])
    _sound(g)
    assert g.beam(q[0], 10)[0][1] == 3 and g.ids[3] == 9000 and not g.deleted[3] and 3 not in g.row
    back = Graph.unpack(g.pack())
    assert [i for _, i in back.beam(q[5], 30)] == [i for _, i in g.beam(q[5], 30)]
    assert Graph.unpack(Graph(x[:1], np.arange(1)).pack()).beam(q[0], 5)[0][1] == 0


def test_links_are_measured_in_bounded_parts(monkeypatch):
    from vectrail.operators import index

    g, sizes, exact = Graph(_unit(900), np.arange(900) * 3, 12, 48), [], index._exact
    monkeypatch.setattr(index, "MEASURED", 1000)
    monkeypatch.setattr(index, "_exact", lambda metric, a, b: sizes.append(len(a)) or exact(metric, a, b))
    got = pd.concat(g.measured(0))
    assert len(sizes) > 3 and max(sizes) <= 1000 + 2 * 24
    assert {(s, d) for s, d in zip(got["src"], got["dst"])} == {(3 * n, 3 * j) for n, to in g.links[0].items() for j in to.tolist()} and len(got) == sum(map(len, g.links[0].values()))
    for _, mine in got.groupby("src"):
        assert mine["ord"].tolist() == list(range(1, len(mine) + 1)) and mine["dist"].is_monotonic_increasing
    assert not list(g.measured(9)) and not list(Graph(np.zeros((0, 4)), np.zeros(0)).measured(0))


class _Scanned(dict):
    scans = 0

    def items(self):
        self.scans += 1
        return super().items()


def test_a_change_does_not_scan_all_links():
    x = _unit(900)
    g = Graph(x[:600], np.arange(600), 12, 48)
    g.links[0] = _Scanned(g.links[0])
    moved, by_scan = np.arange(0, 600, 5), []
    leave = g._leave

    def checked(node):
        wanted = sorted(n for n, to in dict.items(g.links[0]) if node in to)
        by_scan.append(wanted == g._sources(0, node))
        leave(node)

    g._leave = checked
    g.upsert(np.concatenate([moved, np.arange(600, 900)]), np.concatenate([-x[moved], x[600:]]))
    assert g.links[0].scans <= 2 and len(by_scan) == len(moved) and all(by_scan)
    assert g.entry == int(g.level.argmax()) and len(g.ids) == len(g.x) == len(g.deleted) == 900
    _sound(g)


def test_few_matches_are_found_through_others():
    x, q = _unit(1500), _unit(20, seed=1)
    g = Graph(x, np.arange(1500), 12, 48)
    allowed = np.zeros(1500, bool)
    allowed[::150] = True
    for widen in (False, True):
        for v in q:
            found = [i for _, i in g.beam(v, 10, allowed, widen)]
            d = ((x[::150] - v) ** 2).sum(1)
            assert found == (np.argsort(d) * 150).tolist()


def _frame(spark, x, ids=None):
    ids = range(len(x)) if ids is None else ids
    return spark.createDataFrame(pd.DataFrame({"id": list(ids), "embedding": [v.tolist() for v in x]}), "id bigint, embedding array<float>")


def _queries(spark, q):
    return spark.createDataFrame(pd.DataFrame({"query_id": range(len(q)), "embedding": [v.tolist() for v in q]}), "query_id bigint, embedding array<float>")


def test_stored_index(spark, tmp_path):
    x, q = _unit(900), _unit(30, seed=1)
    path = str(tmp_path / "index")
    index = GraphIndex.build(_frame(spark, x), IndexConfig(24, m=12, ef_construction=48, ef=40, allow_replace_deleted=True, max_elements=1000), path, rows_per_shard=300)
    assert len(index.files) == 3 and index.counts().first().elements == 900

    def recall(index, x, ids):
        d = ((q[:, None].astype(float) - x[None]) ** 2).sum(-1)
        true = [{ids[i] for i in row[:10]} for row in np.argsort(d, 1)]
        got = [set() for _ in q]
        for r in index.search(_queries(spark, q), 10).collect():
            got[r.query_id].add(r.id)
        return np.mean([len(a & b) / 10 for a, b in zip(got, true)])

    assert recall(index, x, list(range(900))) > 0.95
    again = GraphIndex.load(spark, path)
    assert recall(again, x, list(range(900))) > 0.95 and again.config == index.config
    moved = -x[:50]
    changed = index.add_items(_frame(spark, np.concatenate([moved, _unit(20, seed=9)]), [*range(50), *range(2000, 2020)]))
    now = np.concatenate([moved, x[50:], _unit(20, seed=9)])
    ids = [*range(900), *range(2000, 2020)]
    assert recall(changed, now, ids) > 0.95 and recall(index, x, list(range(900))) > 0.95
    gone = changed.mark_deleted(_frame(spark, x[100:400], range(100, 400)).select("id"))
    keep = [i for i, n in enumerate(ids) if not 100 <= n < 400]
    assert recall(gone, now[keep], [ids[i] for i in keep]) > 0.95
    assert gone.counts().first().deleted == 300
    with pytest.raises(ValueError, match="already deleted"):
        gone.mark_deleted(_frame(spark, x[:1], [150]).select("id"))
    with pytest.raises(KeyError, match="not in the table"):
        gone.unmark_deleted(_frame(spark, x[:1], [77777]).select("id"))
    assert gone.unmark_deleted(_frame(spark, x[:300], range(100, 400)).select("id")).counts().first().deleted == 0
    filled = gone.replace_deleted(_frame(spark, _unit(100, seed=11), range(5000, 5100)))
    assert (filled.counts().first().elements, filled.counts().first().deleted) == (920, 200)
    with pytest.raises(ValueError, match="limit"):
        filled.add_items(_frame(spark, _unit(200, seed=12), range(9000, 9200)))
    odd = index.search(_queries(spark, q), 10, allowed=lambda ids: ids % 2 == 1)
    assert {r.id % 2 for r in odd.collect()} == {1} and odd.count() == 300
    near = index.search(_queries(spark, x[:3]), 10, within=1e-6).collect()
    assert {(r.query_id, r.id) for r in near} == {(0, 0), (1, 1), (2, 2)}
    assert index.search(_queries(spark, q).limit(0), 5).count() == 0
    edges = index.edges()
    assert edges.groupBy("src").count().agg({"count": "max"}).first()[0] <= 24
    assert GraphIndex.build(_frame(spark, x).limit(0), IndexConfig(24)).search(_queries(spark, q), 5).count() == 0


def test_many_queries_take_little_memory():
    """16,384 rows with 40,000 queries: never more than some tiles of distances at once."""
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"id": np.arange(8192), "embedding": list(rng.normal(size=(8192, 16)))})
    asked = (rng.normal(size=(40_000, 16)), np.arange(40_000), [], np.zeros(40_000), np.zeros(40_000))
    tracemalloc.start()
    n = sum(len(part) for part in search._blocks(pdf, asked, 3, "l2", "none", False, False))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n >= 3 * 40_000 and peak < 400 << 20


def test_dimensions(spark):
    base = spark.createDataFrame([(1, [0.0, 1.0]), (2, [1.0]), (3, None)], "id bigint, embedding array<double>")
    q = spark.createDataFrame([(0, [0.0, 0.0])], "query_id bigint, embedding array<double>")
    assert [r.id for r in search.top_k(base, q, 5).collect()] == [1]
    with pytest.raises(ValueError, match="elements"):
        search.top_k(base, q.unionByName(spark.createDataFrame([(1, [0.0])], q.schema)), 5)
