"""Session helpers: table access and lineage cuts that survive the loss of executors."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_FALLBACK: dict[str, str] = {}


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, app: str = "weftline") -> SparkSession:
    """A local session with the settings the tests and the bench use.

    Python workers get the package from ``PYTHONPATH``; on a cluster it is shipped with ``--py-files``.
    """
    root = str(Path(__file__).resolve().parents[1])
    known = os.environ.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [root, known]))
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` in at least as many partitions as the cluster has cores, for costly work on each row.

    Inputs with enough partitions, as all large ones have, are left where they are.
    """
    least = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= least else df.repartition(least)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share.

    A cluster names it in ``spark.checkpoint.dir``; only where that is unset (tests, local mode) a folder of
    this process is made.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if app not in _FALLBACK:
        _FALLBACK[app] = "file://" + tempfile.mkdtemp(prefix="weftline-")
    return _FALLBACK[app]


def shared_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/weftline-{what}-{uuid.uuid4().hex[:12]}"


class Cut:
    """Intermediate tables of one operator, written to the shared folder.

    ``keep(df)`` writes ``df`` as Parquet and returns the table read back: its lineage starts at the files, so a
    lost executor costs a re-read and not a recomputation. ``drop(df)`` deletes a table that nothing needs any
    more. What is left is deleted when the process ends.
    """

    def __init__(self, spark: SparkSession, what: str):
        self.spark, self.what, self.paths = spark, what, {}

    def keep(self, df: DataFrame) -> DataFrame:
        path = shared_path(self.spark, self.what)
        df.write.mode("overwrite").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (path, out)
        _PENDING.append((self.spark, path))
        return out

    def drop(self, *dfs: DataFrame) -> None:
        for df in dfs:
            entry = self.paths.pop(id(df), None)
            if entry:
                delete(self.spark, entry[0])


_PENDING: list[tuple[SparkSession, str]] = []


def delete_at_exit(spark: SparkSession, path: str) -> None:
    _PENDING.append((spark, path))


def local_file(spark: SparkSession, path: str) -> str | None:
    """The name of a path in the machines' own file system (also a shared mount), none where it lies in another one."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return p.toUri().getPath() if fs.getUri().getScheme() == "file" else None


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _clean() -> None:
    import shutil

    for spark, path in _PENDING:
        try:
            if path.startswith("file://"):
                shutil.rmtree(path[7:], ignore_errors=True)
            elif spark.sparkContext._jsc is not None:
                delete(spark, path)
        except Exception:
            pass
    for path in _FALLBACK.values():
        shutil.rmtree(path[7:], ignore_errors=True)
