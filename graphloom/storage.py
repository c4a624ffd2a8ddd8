"""Shared-folder tables: how iterative operators cut lineage.

Every intermediate table is written as Parquet under the folder the cluster names in
``spark.checkpoint.dir``, which all executors share, so the loss of an executor never loses it.
"""

from __future__ import annotations

import atexit
import contextlib
import contextvars
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_written: dict[str, SparkSession] = {}
_fallback: dict[int, str] = {}
#: tables of the innermost ``temporary`` block of this thread or task
_block: contextvars.ContextVar[set[str] | None] = contextvars.ContextVar("graphloom_tables", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder. Only a local master, whose tasks run on this machine, may leave it unset."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
    key = id(spark.sparkContext)
    if key not in _fallback:
        folder = tempfile.mkdtemp(prefix="graphloom-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _fallback[key] = f"file://{folder}"
        spark.sparkContext.setCheckpointDir(_fallback[key])
    return _fallback[key]


def materialize(df: DataFrame, label: str = "t", by: str | None = None, count: Column | str | None = None) -> DataFrame:
    """Write ``df`` once into the shared folder and return a scan of the written table.

    ``by`` names a column of few values that becomes a folder each, so that a reader of one skips the others. The rows that
    fulfil ``count`` (all, by default) are counted by the tasks that write, each of them once: see ``counted``."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/graphloom/{label}-{uuid.uuid4().hex}"
    seen = Observation()
    rows = df.observe(seen, (F.count(F.lit(1)) if count is None else F.count_if(F.expr(count) if isinstance(count, str) else count)).alias("n"))
    (rows.write.partitionBy(by) if by else rows.write).parquet(path)
    _written[path] = spark
    block = _block.get()
    if block is not None:
        block.add(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._graphloom_path, out._graphloom_count = path, seen
    return out


def counted(df: DataFrame) -> int:
    """How many rows ``materialize`` counted, without another job."""
    return df._graphloom_count.get["n"]


def release(*frames: DataFrame) -> None:
    """Delete tables written by ``materialize`` that nothing will read again."""
    for df in frames:
        path = getattr(df, "_graphloom_path", None)
        if path:
            _delete(path, _written.pop(path, None))


@contextlib.contextmanager
def temporary() -> Iterator[None]:
    """Deletes at its end the tables its own thread or task wrote inside: for callers that collect or save their
    result in it. Blocks of other threads keep theirs."""
    own: set[str] = set()
    token = _block.set(own)
    try:
        yield
    finally:
        _block.reset(token)
        for path in own:
            _delete(path, _written.pop(path, None))


def _delete(path: str, spark: SparkSession | None) -> None:
    if spark is None:
        return
    try:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may be gone; the folder's owner cleans up
        pass


@atexit.register
def _delete_all() -> None:
    for path, spark in list(_written.items()):
        if getattr(spark.sparkContext, "_jsc", None) is not None:
            _delete(path, spark)
