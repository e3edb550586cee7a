"""Session helpers that every operator shares: reading tables, shared scratch space and cutting lineage."""

from __future__ import annotations

import atexit
import os
import sys
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_ROOT = Path(__file__).resolve().parent
_scratch: dict[str, str] = {}
_shipped: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The whole table ``name`` below ``sf_dir``, by any path that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers that don't share the driver's PYTHONPATH."""
    app, home = spark.sparkContext.applicationId, str(_ROOT.parent)
    if app in _shipped:
        return
    _shipped.add(app)
    paths = [os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if home in paths or "site-packages" in home or os.path.realpath(os.getcwd()) == home:
        return
    import zipfile

    target = Path(tempfile.mkdtemp(prefix="packspan-ship-")) / "packspan.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(_ROOT.rglob("*.py")):
            z.write(f, f.relative_to(_ROOT.parent))
    spark.sparkContext.addPyFile(str(target))


def shared_root(spark: SparkSession) -> str:
    """This application's folder in ``spark.checkpoint.dir``.

    The cluster names that folder. Only where it is unset, as in tests on a local master, one of our own is made.
    The folder goes when the driver's Python ends.
    """
    sc = spark.sparkContext
    if sc.applicationId in _scratch:
        return _scratch[sc.applicationId]
    base = sc.getConf().get("spark.checkpoint.dir", "")
    if not base:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = Path(tempfile.gettempdir(), "packspan-shared").as_uri()
    root = f"{base.rstrip('/')}/packspan-{sc.applicationId}"
    _scratch[sc.applicationId] = root
    atexit.register(_forget, spark, root)
    return root


def _forget(spark: SparkSession, root: str) -> None:
    if spark.sparkContext._jsc is not None:
        remove(spark, root)


def fresh_path(spark: SparkSession, what: str) -> str:
    return f"{shared_root(spark)}/{what}-{uuid.uuid4().hex[:12]}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder through Spark's own file system client."""
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception as e:  # the gateway may be down at interpreter exit; a left folder harms nothing
        print(f"packspan: {path} was not removed: {e}", file=sys.stderr)


class Cut:
    """A DataFrame written to shared storage: its lineage ends there, so lost executors cost a reread only."""

    def __init__(self, df: DataFrame, what: str, partition_by: list[str] | None = None):
        self.spark, self.path = df.sparkSession, fresh_path(df.sparkSession, what)
        w = df.write
        (w.partitionBy(*partition_by) if partition_by else w).parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        remove(self.spark, self.path)


def cut(df: DataFrame, what: str = "cut") -> DataFrame:
    return Cut(df, what).df
