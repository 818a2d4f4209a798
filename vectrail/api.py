"""Array-in, array-out handles on stored indexes, for notebooks and small batches; tables go through the operators."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import search
from .operators.index import GraphIndex
from .operators.table import IndexConfig

Filter = Callable[[np.ndarray], np.ndarray]


def _rows(spark: SparkSession, key: str, ids: np.ndarray, x: np.ndarray) -> DataFrame:
    return spark.createDataFrame(pd.DataFrame({key: ids.astype(np.int64), "embedding": [v.tolist() for v in np.asarray(x, np.float32)]}), f"{key} bigint, embedding array<float>")


def _arrays(found: DataFrame, n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(labels, distances) of shape (n, k); fewer than k results for any query are an error."""
    pdf = found.select("query_id", "id", "dist", "rank").toPandas().sort_values(["query_id", "rank"])
    if len(pdf) != n * k:
        raise RuntimeError("cannot return the results in a contiguous array: some queries have fewer than k; ef or k may be ill chosen")
    return pdf["id"].to_numpy().reshape(n, k), pdf["dist"].to_numpy().reshape(n, k)


class _Handle:
    def __init__(self, spark: SparkSession, space: str, dim: int) -> None:
        self.spark, self.space, self.dim = spark, space, dim

    def _ids(self, n: int, ids: Iterable[int] | None, start: int) -> np.ndarray:
        return np.arange(start, start + n) if ids is None else np.asarray(list(ids), np.int64)

    def _checked(self, x) -> np.ndarray:
        x = np.atleast_2d(np.asarray(x, np.float32))
        if x.shape[1] != self.dim:
            raise ValueError(f"vectors have {x.shape[1]} elements instead of {self.dim}")
        return x


class Index(_Handle):
    """An approximate index of vectors; ``space`` is l2, ip or cosine."""

    def init_index(self, max_elements: int, M: int = 16, ef_construction: int = 200, random_seed: int = 100, allow_replace_deleted: bool = False, path: str | None = None) -> None:  # noqa: N803
        self.config = IndexConfig(self.dim, self.space, M, ef_construction, seed=random_seed, max_elements=max_elements, allow_replace_deleted=allow_replace_deleted)
        self.path, self.stored = path, None

    def add_items(self, data, ids: Iterable[int] | None = None, replace_deleted: bool = False) -> None:
        x = self._checked(data)
        rows = _rows(self.spark, "id", self._ids(len(x), ids, self.get_current_count()), x)
        if self.stored is None:
            if len(x) > self.config.max_elements:
                raise ValueError("the number of elements exceeds the limit")
            self.stored = GraphIndex.build(rows, self.config, self.path)
        else:
            self.stored = self.stored.replace_deleted(rows) if replace_deleted else self.stored.add_items(rows)

    def knn_query(self, data, k: int = 1, filter: Filter | None = None) -> tuple[np.ndarray, np.ndarray]:  # noqa: A002
        """(labels, distances); ``filter`` maps an array of ids to a mask."""
        x = self._checked(data)
        found = self.stored.search(_rows(self.spark, "query_id", np.arange(len(x)), x), k, self.config.ef, allowed=filter)
        return _arrays(found, len(x), k)

    def set_ef(self, ef: int) -> None:
        self.config = IndexConfig(**{**self.config.__dict__, "ef": ef})

    def set_num_threads(self, n: int) -> None:
        """Has no effect: the cluster's cores are used."""

    def mark_deleted(self, label: int) -> None:
        self.stored = self.stored.mark_deleted(self.spark.createDataFrame([(label,)], "id bigint"))

    def unmark_deleted(self, label: int) -> None:
        self.stored = self.stored.unmark_deleted(self.spark.createDataFrame([(label,)], "id bigint"))

    def resize_index(self, max_elements: int) -> None:
        if max_elements < self.get_current_count():
            raise ValueError("the new limit is below the number of elements")
        self.config = IndexConfig(**{**self.config.__dict__, "max_elements": max_elements})

    def get_items(self, ids: Iterable[int], return_type: str = "numpy"):
        wanted = list(ids)
        pdf = self.stored.rows().where(F.col("id").isin(wanted) & ~F.col("deleted")).toPandas().set_index("id")
        missing = [i for i in wanted if i not in pdf.index]
        if missing:
            raise RuntimeError(f"label not found: {missing[0]}")
        found = [pdf.loc[i, "embedding"] for i in wanted]
        if return_type not in ("numpy", "list"):
            raise ValueError("return_type must be numpy or list")
        return np.array([np.asarray(v, np.float32) for v in found]) if return_type == "numpy" else [list(map(float, v)) for v in found]

    def get_ids_list(self) -> list[int]:
        return [] if self.stored is None else sorted(r["id"] for r in self.stored.rows().select("id").collect())

    def get_current_count(self) -> int:
        return 0 if getattr(self, "stored", None) is None else self.stored.counts().first()["elements"]

    def get_max_elements(self) -> int:
        return self.config.max_elements

    def save_index(self, path: str) -> None:
        self.stored.copy_to(path)

    def load_index(self, path: str, max_elements: int = 0) -> None:
        self.stored = GraphIndex.load(self.spark, path)
        self.config = IndexConfig(**{**self.stored.config.__dict__, **({"max_elements": max_elements} if max_elements else {})})
        if self.config.dim != self.dim:
            raise ValueError("the stored index has another dimension")
        self.path = path

    def __getstate__(self) -> dict:
        """What a pickle holds: where the index is stored, not its rows."""
        return {"space": self.space, "dim": self.dim, "config": self.config.__dict__, "path": None if self.stored is None else self.stored.path}

    def __setstate__(self, state: dict) -> None:
        spark = SparkSession.getActiveSession()
        super().__init__(spark, state["space"], state["dim"])
        self.config, self.path = IndexConfig(**state["config"]), state["path"]
        self.stored = GraphIndex.load(spark, self.path) if self.path else None


class BFIndex(_Handle):
    """Exact search over vectors held as a table."""

    def init_index(self, max_elements: int) -> None:
        self.max_elements, self.ids, self.x = max_elements, np.zeros(0, np.int64), np.zeros((0, self.dim), np.float32)

    def add_items(self, data, ids: Iterable[int] | None = None) -> None:
        x = self._checked(data)
        new = self._ids(len(x), ids, len(self.ids))
        old = ~np.isin(self.ids, new)
        if old.sum() + len(new) > self.max_elements:
            raise ValueError("the number of elements exceeds the limit")
        self.ids, self.x = np.concatenate([self.ids[old], new]), np.concatenate([self.x[old], x])

    def delete_vector(self, label: int) -> None:
        keep = self.ids != label
        self.ids, self.x = self.ids[keep], self.x[keep]

    def knn_query(self, data, k: int = 1, filter: Filter | None = None) -> tuple[np.ndarray, np.ndarray]:  # noqa: A002
        x = self._checked(data)
        keep = np.ones(len(self.ids), bool) if filter is None else np.asarray(filter(self.ids), bool)
        found = search.top_k(_rows(self.spark, "id", self.ids[keep], self.x[keep]), _rows(self.spark, "query_id", np.arange(len(x)), x), k, self.space)
        return _arrays(found, len(x), k)

    def get_current_count(self) -> int:
        return len(self.ids)

    def get_max_elements(self) -> int:
        return self.max_elements
