"""Tables written between the jobs of an iterative or multi-pass operator.

They cut lineage and survive the loss of any executor, because they live in the folder the
cluster names in ``spark.checkpoint.dir`` (shared by driver and executors).  Only when that
setting is absent, as in unit tests on one machine, a local folder is used.
"""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
import zipfile
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_LIVE: list[str] = []
_SHIPPED: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    """The shared checkpoint folder of this session, without a trailing slash; raises on a cluster that names none."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError(f"set spark.checkpoint.dir to a folder that the driver and all executors of {master} share")
        folder = f"file://{tempfile.gettempdir()}/quillgraph-shared-{os.getuid()}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path for a scratch table; ``release`` deletes it."""
    path = f"{shared_folder(spark)}/quillgraph/{name}-{uuid.uuid4().hex}"
    _LIVE.append(path)
    return path


def materialise(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` to a scratch table and return a scan of it."""
    spark = df.sparkSession
    path = new_path(spark, name)
    writer = df.write.mode("overwrite").option("compression", "zstd")
    with small_batches(spark):
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


_BATCHES = threading.Lock()
_INSIDE: list[str | None] = []


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000):
    """Jobs run inside send Python workers so many rows at a time; the session's own setting is back once the last of concurrent users is out."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    with _BATCHES:
        _INSIDE.append(_INSIDE[0] if _INSIDE else dict(spark.conf.getAll).get(key))
        spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        with _BATCHES:
            before = _INSIDE.pop()
            if not _INSIDE:
                spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a path through Hadoop's file systems, whatever store it is in."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def path_of(df: DataFrame) -> str | None:
    """The path of the scratch table that ``df`` scans (as ``materialise`` returned it); None if it scans none that is left."""
    own = getattr(df, "_scratch_path", None)
    if own:
        return own if own in _LIVE else None
    live = {p.split("://")[-1]: p for p in _LIVE}
    for file in df.inputFiles()[:1]:
        plain = file.split("://")[-1]
        for key, path in live.items():
            if plain.lstrip("/").startswith(key.lstrip("/") + "/"):
                return path
    return None


def drop(*tables: DataFrame) -> None:
    """Delete the scratch tables that these scan."""
    for df in tables:
        path = path_of(df)
        if path:
            delete(df.sparkSession, path)
            _LIVE.remove(path)


def stacked(tables: list[DataFrame]) -> DataFrame:
    """Several scratch tables of one schema as one scan, so a plan doesn't grow with their number."""
    first = tables[0]
    return first.sparkSession.read.schema(first.schema).parquet(*[path_of(t) for t in tables])


def live() -> list[str]:
    """Paths of the scratch tables not yet deleted, oldest first."""
    return list(_LIVE)


def release(spark: SparkSession, paths: list[str]) -> None:
    """Delete scratch tables, once what reads them has run."""
    for path in paths:
        if path in _LIVE:
            delete(spark, path)
            _LIVE.remove(path)


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers once per application, as ``--py-files`` would."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="quillgraph-")) / "quillgraph_code.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, f"{root.name}/{p.relative_to(root)}")
    sc.addPyFile(str(target))
    _SHIPPED.add(sc.applicationId)
