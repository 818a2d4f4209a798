"""Session construction and the folder for tables that several jobs share."""

from __future__ import annotations

import atexit
import functools
import gc
import shutil
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}
_MADE: dict[str, SparkSession] = {}
#: Least time between two collections that :func:`release` asks for.
COLLECT_SECONDS = 8.0
#: Time that :func:`sweep` gives the listeners of ended jobs, twice.
SETTLE_SECONDS = 0.5
_collected = [0.0]


def local_session(cores: str | int = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A single-machine session with the settings that the tests and the benchmark use."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("vectrail")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, named by ``spark.checkpoint.dir``.

    Where the setting is absent a temporary folder is made, which only a
    ``local`` master may use; on a cluster its absence is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="vectrail-")
        spark.sparkContext.setCheckpointDir(_LOCAL[app])
    return _LOCAL[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other call gets; it is removed when the process ends."""
    path = f"{shared_dir(spark)}/vectrail-{name}-{uuid.uuid4().hex[:12]}"
    _MADE[path] = spark
    return path


def _remove(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: lineage ends here, so a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._scratch = path  # type: ignore[attr-defined]
    return table


def joined(*tables: DataFrame) -> DataFrame:
    """The rows of tables that :func:`materialise` wrote, as one that :func:`release` removes with all of them."""
    table = functools.reduce(DataFrame.unionByName, tables)
    table._scratch = [t._scratch for t in tables]  # type: ignore[attr-defined]
    return table


def sweep(spark: SparkSession) -> None:
    """Have the driver's JVM collect what ended jobs left behind: Spark removes the shuffle files of a plan only when that is gone.

    The listeners still hold the plan for a moment after a job.
    """
    for _ in range(2):
        gc.collect()
        time.sleep(SETTLE_SECONDS)
        spark._jvm.System.gc()
    _collected[0] = time.monotonic()


def release(*tables: DataFrame) -> None:
    """Remove tables that :func:`materialise` wrote, once nothing that is yet to be evaluated reads them; others are left alone.

    The driver's JVM is asked to collect what the jobs that wrote them left
    behind, unless that was done just now.
    """
    for table in tables:
        made = getattr(table, "__dict__", {}).get("_scratch")
        for path in made if isinstance(made, list) else [made]:
            if path in _MADE:
                spark = _MADE.pop(path)
                _remove(spark, path)
                if time.monotonic() - _collected[0] > COLLECT_SECONDS:
                    _collected[0] = time.monotonic()
                    spark._jvm.System.gc()


@atexit.register
def _clean() -> None:
    """Take the scratch tables along; where the context has ended before, those on a cluster's folder stay."""
    for path, spark in list(_MADE.items()):
        try:
            if spark.sparkContext._jsc is not None:
                _remove(spark, path)
        except Exception:  # noqa: BLE001, PERF203 - the process is ending, and its gateway may be gone
            break
    _MADE.clear()
    for folder in _LOCAL.values():
        shutil.rmtree(folder, ignore_errors=True)
