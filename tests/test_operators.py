"""Golden values, properties, edge cases, persistence and streams."""

from __future__ import annotations

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from vectrail.functions import columns as C
from vectrail.operators import evaluate, graph, search, sketches, strategies, table
from vectrail.sources import files
from vectrail.streaming import changes


def _one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_distances_by_hand(spark):
    rows = [(0, [1.0, 0.0, 0.0]), (1, [0.0, 1.0, 0.0]), (2, [0.0, 0.0, 1.0]), (3, [1.0, 0.0, 1.0]), (4, [1.0, 1.0, 1.0])]
    df = spark.createDataFrame(rows, "id bigint, v array<double>")
    q = F.array(*[F.lit(1.0)] * 3)
    got = {m: sorted(round(r[0], 3) for r in df.select(f(F.col("v"), q)).collect()) for m, f in C.METRICS.items()}
    assert got == {"l2": [0, 1, 2, 2, 2], "ip": [-2, -1, 0, 0, 0], "cosine": [0, 0.184, 0.423, 0.423, 0.423]}


def test_hashes(spark):
    df = spark.createDataFrame([("music", 0), ("games", 1), ("2", 2), ("sports", 0), ("", 0), ("é", 0)], "s string, i int")
    got = [(r.h, [r.c0, r.c1, r.c2, r.c3], r.f) for r in df.select(C.djb2(F.col("s")).alias("h"), *[C.cms_column(C.djb2(F.col("s")), j).alias(f"c{j}") for j in range(4)], C.fingerprint(F.col("i")).alias("f")).collect()]
    assert [g[0] for g in got[:4]] == [267751046, 259910130, 177623, 474599408]
    assert [g[1] for g in got[:4]] == [[673, 621, 915, 763], [237, 388, 534, 536], [936, 342, 884, 452], [712, 215, 731, 570]]
    assert [g[2] for g in got[:3]] == [50668, 48877, 42471]
    h = 5381
    for b in "é".encode():
        h = (h * 33 + (b - 256 if b > 127 else b)) & 0xFFFFFFFF
    assert [got[4][0], got[5][0]] == [5381, h]


def test_deciles_and_tokens(spark):
    assert list(_one(spark, *[C.decile(F.lit(p)).alias(str(i)) for i, p in enumerate((0.0, 0.37, 0.999, 1.0))])) == [0, 3, 9, 10]
    assert _one(spark, C.tokens(F.lit(" 'Rock', \"JAZZ\",, pop 2 ")))[0] == ["rock", "jazz", "pop 2"]
    assert _one(spark, C.tokens(F.lit(None).cast("string")))[0] == []


def _base(spark):
    rows = [(i, [float(i % 10), float(i // 10)], ["even"] if i % 2 == 0 else [], i) for i in range(100)]
    return spark.createDataFrame([*rows, (100, None, ["even"], 1), (101, [3.0, 3.0], None, None)], "id bigint, embedding array<double>, attrs array<string>, value int")


def _queries(spark):
    return spark.createDataFrame([(1000, [3.0, 3.0], ["even"], 10, 60), (1001, [0.0, 0.0], [], 50, 40), (1002, [9.0, 9.0], ["none"], 98, 99)], "query_id bigint, embedding array<double>, attrs array<string>, lo int, hi int")


@pytest.mark.parametrize("where", search.PREDICATES)
@pytest.mark.parametrize("metric", list(C.METRICS))
def test_kernel_equals_join(spark, where, metric):
    base, q = _base(spark), _queries(spark)
    key = lambda df: sorted((r.query_id, r.id, round(r.dist, 9), r["rank"]) for r in df.collect())
    assert key(search.top_k(base, q, 7, metric, where)) == key(search.joined(base, q, 7, metric, where))
    if metric == "l2":
        assert key(search.top_k(base, q, 7, metric, where, query_limit=16)) == key(search.joined(base, q, 7, metric, where))


def test_ties_small_tables_and_no_queries(spark):
    base, q = _base(spark), _queries(spark)
    first = [r.id for r in search.top_k(base, q.where("query_id = 1000"), 3).orderBy("rank").collect()]
    assert first == [33, 101, 23]
    assert search.top_k(base, q, 1000).where("query_id = 1000").count() == 101
    assert search.top_k(base, q.limit(0), 5).count() == 0
    assert search.top_k(base.limit(0), q, 5).count() == 0
    assert search.top_k(base, q, 5, where="range").where("query_id = 1001").count() == 0
    assert {r.id for r in search.top_k(base, q, 5, where="or").where("query_id = 1002").collect()} == {98, 99}


def test_radius_and_documents(spark):
    base, q = _base(spark).where("embedding is not null").withColumn("doc_id", F.col("id") % 7), _queries(spark)
    near = search.within_radius(base, q, 1.0, 50).where("query_id = 1000").collect()
    assert {r.id for r in near} == {33, 101, 23, 43, 32, 34}
    docs = search.by_document(base, q, 3, exclude_self=False).where("query_id = 1000").collect()
    assert len({r.doc_id for r in docs}) == 3
    best = search.best_documents(base, q, 3, exclude_self=False).where("query_id = 1000").orderBy("rank").collect()
    assert [r.doc_id for r in best][0] in {33 % 7, 101 % 7}


def test_graph(spark):
    base = _base(spark).where("embedding is not null")
    edges = graph.knn_graph(base, 4)
    assert edges.count() == 4 * base.count()
    state = graph.integrity(edges, base).first()
    assert (state.self_loops, state.repeated, state.unknown) == (0, 0, 0)
    broken = edges.unionByName(spark.createDataFrame([(1, 1, 0.0, 9), (2, 9999, 1.0, 9)], edges.schema))
    state = graph.integrity(broken, base).first()
    assert (state.self_loops, state.unknown) == (1, 1)
    beam = spark.createDataFrame([(1, 33)], "query_id bigint, id bigint")
    one, two = ({r.id for r in graph.hops(beam, edges, n).collect()} for n in (1, 2))
    assert one < two
    kept = graph.prune(edges, base, 2)
    assert kept.groupBy("src").count().agg(F.max("count")).first()[0] <= 2


def test_sketches(spark):
    base = _base(spark).where("id < 100")
    members = base.select("id", (F.col("id") % 3).alias("cluster_id"))
    cms = sketches.cms_build(members, base)
    probe = spark.createDataFrame([(1, "even"), (1, "odd")], "query_id bigint, attr string")
    true = {r.cluster_id: r.n for r in members.where("id % 2 = 0").groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    got = {r.cluster_id: r.est for r in sketches.cms_estimate(cms, probe).where("attr = 'even'").collect()}
    assert all(got[c] >= n for c, n in true.items())
    cdf = sketches.cluster_cdf(members, base)
    for model in (sketches.linear_model(cdf), sketches.quantile_model(cdf)):
        for r in sketches.audit(cdf, model).collect():
            assert 0 <= r.predicted <= 1
            assert r.difference < 0.1
    ends = sketches.predict_piecewise(spark.createDataFrame([(0, 0), (0, 10_000)], "cluster_id bigint, x int"), sketches.piecewise_model(cdf), "x").orderBy("x").collect()
    assert ends[0].cdf < ends[1].cdf == 1.0
    flat = sketches.linear_model(spark.createDataFrame([(1, 5, 1.0)], "cluster_id bigint, value int, cdf double")).first()
    assert (flat.slope, flat.intercept) == (0.0, 1.0)
    none = sketches.popularity_point(_queries(spark), cms, members).where("query_id = 1001").first()
    assert (none.popularity, none.cluster_id) == (0.0, None)


def test_greedy_clusters(spark):
    ring = spark.createDataFrame([(i, (i + 1) % 20) for i in range(20)], "src bigint, dst bigint")
    got = sketches.greedy_clusters(ring, 6).collect()
    assert {r.id for r in got} == set(range(20))
    assert all(any(x.is_seed for x in got if x.cluster_id == c) for c in {r.cluster_id for r in got})
    assert len({r.cluster_id for r in sketches.greedy_clusters(ring, 0).collect()}) >= len({r.cluster_id for r in got})


def test_strategy_choice():
    assert [strategies.choose(s, 10_000_000, 10) for s in (1e-5, 5e-3, 0.1, 0.9)] == ["exact", "dynamic", "predictive", "post_filter"]
    assert strategies.choose(5e-3, 10_000_000, 10, clustered=True) == "cluster_first"


def test_table_life(spark, tmp_path):
    v = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(10)] + [(10, [1.0]), (11, None)], "id bigint, embedding array<double>")
    t = table.VectorTable.of(v, table.IndexConfig(2, m=32, ef_construction=16, max_elements=12, allow_replace_deleted=True))
    assert (t.config.ef_construction, t.counts().first().elements) == (32, 10)
    some = v.where("id in (2, 3)")
    gone = t.mark_deleted(some)
    assert {r.id for r in gone.ids().collect()} == set(range(10)) - {2, 3}
    with pytest.raises(ValueError):
        gone.mark_deleted(some)
    with pytest.raises(ValueError):
        t.unmark_deleted(some)
    with pytest.raises(KeyError):
        t.mark_deleted(v.where("id = 11"))
    assert gone.unmark_deleted(some).counts().first().deleted == 0
    with pytest.raises(Exception, match="no element"):
        gone.get_items(some).collect()
    q = spark.createDataFrame([(0, [2.0, 1.0])], "query_id bigint, embedding array<double>")
    assert gone.knn_query(q, 1).first().id in (1, 4)
    assert t.knn_query(q, 2, filter="id % 2 = 1").orderBy("rank").first().id == 1
    assert gone.replace_items(spark.createDataFrame([(50, [0.0, 0.0])], v.schema)).counts().first().elements == 10
    with pytest.raises(ValueError):
        t.add_items(spark.createDataFrame([(100 + i, [0.0, 0.0]) for i in range(3)], v.schema))
    with pytest.raises(ValueError):
        t.resize(5)
    t.save(str(tmp_path / "index"))
    back = table.VectorTable.load(spark, str(tmp_path / "index"), max_elements=20)
    assert (back.config.max_elements, back.rows.count()) == (20, 10)


def test_csv_scans(spark, tmp_path):
    path = tmp_path / "data.csv"
    path.write_text("a;embedding;b;attrs;c;value;d\n1;[1,2];x;Rock, 'Pop';;7;\n2;[1,oops];x;jazz;;1;\n3;null;x;;;bad;\n4;3,4;x;;;bad;\n")
    got = [(r.embedding, r.attrs, r.value) for r in files.scan_layout(spark, str(path), "or_metadata", 2).collect()]
    assert got == [([1.0, 2.0], ["rock", "pop"], 7), ([3.0, 4.0], [], 0)]
    strict = tmp_path / "range.csv"
    strict.write_text("e;v\n1,2;x\n")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        files.scan_layout(spark, str(strict), "range_metadata").collect()
    conf = tmp_path / "conf.txt"
    conf.write_text("# head\nDIM 64  # size\nEFS [1, 2,3]\n\nEMPTY\n")
    assert files.settings(str(conf)) == {"DIM": "64", "EFS": "[1, 2,3]"}
    assert files.int_list("[1, 2,3]") == [1, 2, 3]


def test_result_files_and_masks(spark, tmp_path):
    results = spark.createDataFrame([(20, 1, 7, 0.5, 1), (20, 1, 8, 0.75, 2)], "ef int, query_id bigint, id bigint, dist double, rank bigint")
    files.write_results(results, str(tmp_path / "out"))
    assert sorted(map(tuple, files.read_results(spark, str(tmp_path / "out")).collect())) == [(20, 1, 7, 0.5), (20, 1, 8, 0.75)]
    filled = files.with_sentinels(results, spark.createDataFrame([(1,), (2,)], "query_id bigint"), 3)
    assert filled.where("query_id = 2 and id = -1").count() == 3
    masks = spark.createDataFrame([(1, 2), (2, 3)], "query_id bigint, id bigint")
    q = _queries(spark)
    path = files.mask_path(str(tmp_path), q, "point")
    assert path != files.mask_path(str(tmp_path), q.limit(1), "point")
    files.save_masks(masks, path)
    assert files.load_masks(spark, path, 2).count() == 2
    with pytest.raises(ValueError):
        files.load_masks(spark, path, 1)


def test_blobs(spark, tmp_path):
    (tmp_path / "x.bvecs").write_bytes(b"".join(struct.pack("<i3B", 3, i, i + 1, i + 2) for i in range(4)))
    (tmp_path / "x.raw").write_bytes(np.arange(6, dtype=np.float32).tobytes())
    assert [r.embedding for r in files.read_blobs(spark, str(tmp_path / "x.bvecs"), "bvecs").orderBy("id").collect()][3] == [3.0, 4.0, 5.0]
    assert [r.embedding for r in files.read_blobs(spark, str(tmp_path / "x.raw"), "raw", 3).orderBy("id").collect()] == [[0.0, 1.0, 2.0], [3.0, 4.0, 5.0]]


def test_streams(spark, tmp_path):
    log = [(1, [1.0], "upsert", 1), (2, [2.0], "upsert", 1), (1, None, "delete", 2), (2, [5.0], "upsert", 3), (3, None, "delete", 1)]
    spark.createDataFrame(log[:2], changes.CHANGES).coalesce(1).write.parquet(str(tmp_path / "in"))
    changes.follow(spark, str(tmp_path / "in"), str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination()
    spark.createDataFrame(log[2:], changes.CHANGES).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    changes.follow(spark, str(tmp_path / "in"), str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination()
    got = {(r.id, tuple(r.embedding), r.deleted) for r in spark.read.parquet(str(tmp_path / "t/v1")).collect()}
    assert got == {(1, (1.0,), True), (2, (5.0,), False)}


def test_query_stream(spark, tmp_path):
    _queries(spark).select("query_id", "embedding").write.parquet(str(tmp_path / "q"))
    stream = spark.readStream.schema("query_id bigint, embedding array<double>").parquet(str(tmp_path / "q"))
    changes.answer(stream, _base(spark).where("embedding is not null").select("id", "embedding"), 2, str(tmp_path / "a"), str(tmp_path / "c")).awaitTermination()
    assert spark.read.option("recursiveFileLookup", "true").parquet(str(tmp_path / "a")).count() == 6


def test_generators(spark):
    ids = spark.range(1000)
    got = {r.value: r.n for r in evaluate.value_distribution(evaluate.by_share(ids, [(1, 0.1), (3, 0.3), (5, 0.5), (-1, 0.1)]), "value").collect()}
    assert got == {1: 100, 3: 300, 5: 500, -1: 100}
    summary = evaluate.recall_summary(spark.createDataFrame([(20, 1, 10), (20, 2, 5)], "ef int, query_id bigint, match bigint")).first()
    assert summary.recall == 0.75


def test_curves_counts_and_points(spark):
    ids = spark.range(2000)
    for kind in ("uniform", "exponential", "normal", "steps"):
        made = evaluate.curve(ids, kind)
        low, high, n = made.agg(F.min("value"), F.max("value"), F.countDistinct("value")).first()
        assert 0 <= low <= high <= 1000 and (n == 5 if kind == "steps" else n > 200)
        cdf = sketches.cluster_cdf(ids.select("id", F.lit(0).alias("cluster_id")), made)
        errors = {r.kind: r.mae for r in evaluate.compare_models(cdf).collect()}
        assert set(errors) == {"linear", "piecewise", "quantile"} and errors["piecewise"] <= errors["linear"] + 2e-3
    counted = {r.value: r["count"] for r in evaluate.by_count(ids, {v: v for v in range(1, 13)}).groupBy("value").count().collect()}
    assert counted == {0: 2000 - 78, **{v: v for v in range(1, 13)}}
    points = spark.createDataFrame([("a", 20, 0.7, 9.0), ("a", 40, 0.9, 5.0), ("b", 20, 0.8, 7.0)], "method string, ef int, recall double, qps double")
    assert [(r.method, r.ef) for r in evaluate.reaching(points).collect()] == [("a", 40), ("b", 20)]


@pytest.mark.parametrize("metric", ["l2", "ip"])
def test_all_pairs_in_cells(spark, monkeypatch, metric):
    """Many queries meet the rows in cells: as exact as the join, with more ties than a block has to spare, ties by id."""
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(300, 8)), np.repeat(rng.normal(size=(1, 8)), 60, 0), 1e3 + rng.normal(size=(40, 8))]).astype(np.float32)
    ids = rng.permutation(len(x))
    base = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)] + [(9000, None), (9001, [1.0]), (9002, [float("nan")] * 8)], "id bigint, embedding array<float>").repartition(5)
    asked = base.where("id < 9000").withColumnRenamed("id", "query_id")
    for name, value in {"MANY": 64, "CELL_ROWS": 150, "CELL_QUERIES": 90, "SAMPLE": 32, "ROWS_MET": 50, "QUERIES_MET": 70, "HELD": 500}.items():
        monkeypatch.setattr(search, name, value)
    got = search.top_k(base, asked, 3, metric, exclude_self=True).collect()
    wanted = {}
    for n, q in enumerate(x.astype(float)):
        d = search._exact(metric, x.astype(float), q[None])
        order = [i for i in np.lexsort((ids, d)) if i != n][:3]
        wanted[int(ids[n])] = [(int(ids[i]), r + 1, float(d[i])) for r, i in enumerate(order)]
    found = {}
    for r in got:
        found.setdefault(r.query_id, []).append((r.id, r.rank, r.dist))
    assert {q: sorted(v, key=lambda t: t[1]) for q, v in found.items()} == wanted
    # the same here, where the settings of a block count too
    direct = {}
    for q, i, d in zip(*(np.concatenate(p).tolist() for p in zip(*search._nearest(x, ids, x, ids, 3, metric, True)))):
        direct.setdefault(q, []).append((i, len(direct.get(q, ())) + 1, d))
    assert direct == wanted


def test_pruning_reads_its_edges_once(spark):
    read = spark.sparkContext.accumulator(0)
    edges = graph.knn_graph(_base(spark), 4)

    def count(it):
        for pdf in it:
            read.add(len(pdf))
            yield pdf

    kept = graph.prune(edges.mapInPandas(count, edges.schema), _base(spark), 2)
    assert kept.count() > 0 and read.value == edges.count()


def test_quantile_models_are_spread(spark):
    cdf = spark.createDataFrame([(c, v, (v + 1) / 5) for c in range(200) for v in range(5)], "cluster_id bigint, value int, cdf double")
    model = sketches.quantile_model(cdf)
    assert model.count() == 200
    assert model.rdd.glom().map(len).filter(lambda n: n > 0).count() > 4


@pytest.mark.parametrize("size", [0, 6, 40])
def test_clusters_gather_in_arrays(size):
    rng = np.random.default_rng(1)
    src, dst = np.repeat(np.arange(400), 5) * 7, rng.integers(0, 430, 2000) * 7
    near, seen, members, wanted, cluster = {}, set(), {}, set(), 0
    for s, d in zip(src.tolist(), dst.tolist()):
        near.setdefault(s, []).append(d)
    for s in sorted({*src.tolist(), *dst.tolist()}):
        if s in seen:
            continue
        members[s] = True
        for d in near.get(s, ()):
            for e in (d, *near.get(d, ())):
                members.setdefault(e, False)
        seen.update(members)
        if len(members) >= size:
            wanted |= {(i, cluster, seed) for i, seed in members.items()}
            members, cluster = {}, cluster + 1
    wanted |= {(i, cluster, seed) for i, seed in members.items()}
    got = sketches._gathered(src, dst, size)
    assert len(got[0]) == len(wanted) and set(zip(*(a.tolist() for a in got))) == wanted
