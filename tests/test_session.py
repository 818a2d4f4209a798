"""The shared folder: what is written there, and that it goes again."""

from __future__ import annotations

from pathlib import Path

from vectrail.session import materialise, release, scratch_path, shared_dir


def test_scratch_tables_go(spark):
    table = materialise(spark.range(5), "five")
    folder = Path(shared_dir(spark).removeprefix("file://"))
    held = [p for p in folder.iterdir() if p.name.startswith("vectrail-five-")]
    assert len(held) == 1 and table.count() == 5
    release(table, spark.range(3))
    assert not held[0].exists()
    release(table)
    assert scratch_path(spark, "x") != scratch_path(spark, "x")
