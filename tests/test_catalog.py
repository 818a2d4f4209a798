"""Every registered query outside the corpus subpackage against DuckDB, or for shape where SQL can't state it."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

from vectrail.plans.catalog import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for path in Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows(spark, duck, sf, name):
    got, wanted = QUERIES[name](spark, sf).toPandas(), duck.execute(ORACLE_SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(wanted.columns)
    got, wanted = (x[columns].sort_values(columns, ignore_index=True) for x in (got, wanted))
    assert len(got) == len(wanted)
    for c in columns:
        assert ((got[c] == wanted[c]) | (got[c].isna() & wanted[c].isna())).all(), c
    assert {c: str(got[c].dtype) for c in columns} == {c: str(wanted[c].dtype) for c in columns}


@pytest.mark.parametrize("name", ["graph_prune", "level_hist", "cdf_kll", "cdf_quantile", "index_build", "index_edges", "ann_after_update", "cluster_greedy", "cluster_per_seed"])
def test_rows(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def _sets(df):
    found = {}
    for r in df.select("query_id", "id").collect():
        found.setdefault(r.query_id, set()).add(r.id)
    return found


def _recall(spark, sf, name, truth):
    got, true = _sets(QUERIES[name](spark, sf)), _sets(QUERIES[truth](spark, sf))
    return sum(len(got.get(q, set()) & ids) for q, ids in true.items()) / sum(map(len, true.values()))


@pytest.mark.parametrize("name,truth,least", [("ann_knn", "knn_exact_l2", 0.95), ("ann_strict", "gt_point", 0.95), ("search_dynamic", "gt_point", 0.95), ("search_point", "gt_point", 0.9), ("search_range", "gt_range", 0.9), ("search_and", "gt_and", 0.9), ("search_or", "gt_or", 0.9), ("search_pf_two_hop", "gt_point", 0.9), ("ann_radius", "epsilon_search", 0.95)])
def test_recall(spark, sf, name, truth, least):
    assert _recall(spark, sf, name, truth) >= least


def test_cluster_first_over_greedy_clusters(spark, sf):
    assert _recall(spark, sf, "search_cluster_greedy", "gt_point") >= 0.4  # clusters with half of the matches


@pytest.mark.parametrize("name,mask", [("search_point", "filter_point"), ("search_range", "filter_range"), ("search_and", "filter_and"), ("search_or", "filter_or"), ("search_dynamic", "filter_point"), ("ann_strict", "filter_point"), ("search_cluster_greedy", "filter_point")])
def test_results_match_their_predicate(spark, sf, name, mask):
    got, allowed = _sets(QUERIES[name](spark, sf)), _sets(QUERIES[mask](spark, sf))
    assert all(ids <= allowed.get(q, set()) for q, ids in got.items())
    assert max(map(len, got.values())) <= 10
