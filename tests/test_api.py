"""The array interface: recall against exact search, filters, deletion, replacement, pickling."""

from __future__ import annotations

import pickle

import numpy as np
import pytest

from vectrail.api import BFIndex, Index


@pytest.mark.parametrize("space", ["l2", "ip", "cosine"])
def test_index_against_exact(spark, tmp_path, space):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 16)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q = rng.normal(size=(20, 16)).astype(np.float32)
    exact, index = BFIndex(spark, space, 16), Index(spark, space, 16)
    exact.init_index(600)
    exact.add_items(x)
    index.init_index(700, M=16, ef_construction=64, allow_replace_deleted=True)
    index.add_items(x[:300])
    index.add_items(x[300:])
    index.set_ef(60)
    true, _ = exact.knn_query(q, 10)
    labels, dist = index.knn_query(q, 10)
    assert labels.shape == dist.shape == (20, 10)
    assert np.mean([len(set(a) & set(b)) / 10 for a, b in zip(labels, true)]) > 0.95
    if space != "l2":
        return
    even, _ = index.knn_query(q, 5, filter=lambda ids: ids % 2 == 0)
    assert (even % 2 == 0).all() and (even == exact.knn_query(q, 5, filter=lambda ids: ids % 2 == 0)[0]).mean() > 0.95
    index.mark_deleted(int(true[0, 0]))
    assert true[0, 0] not in index.knn_query(q[:1], 10)[0]
    index.add_items(q[:1], [5000], replace_deleted=True)
    assert index.knn_query(q[:1], 1)[0][0, 0] == 5000
    assert len(index.get_items([1, 2])) == 2 and 5000 in index.get_ids_list()
    with pytest.raises(RuntimeError):
        index.get_items([123456])
    with pytest.raises(RuntimeError):
        index.knn_query(q[:1], 10, filter=lambda ids: ids == 1)
    with pytest.raises(ValueError):
        index.resize_index(5)
    index.save_index(str(tmp_path / "saved"))
    again = Index(spark, space, 16)
    again.load_index(str(tmp_path / "saved"), max_elements=900)
    assert again.get_max_elements() == 900 and again.get_current_count() == index.get_current_count()
    same = pickle.loads(pickle.dumps(again))
    same.set_ef(60)
    assert same.knn_query(q[:1], 1)[0][0, 0] == 5000
