"""Watch mode: a clock stream whose every tick compares the source tree with its last listing.

Spark's own file source reads each name once, so it misses edits and deletions. Here a tick lists the tree on the
executors, as ``(path, size, modified)``, and joins it with the listing of the last build; any difference rebuilds. The
listing is a table beside the graph, so a restarted watch goes on where the last one ended."""

from __future__ import annotations

import os
import threading
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom import config as cfg
from graphloom.functions.paths import language
from graphloom.plans.build import Options, Result, build
from graphloom.sources import walk
from graphloom.storage import materialize, release, temporary


def changed_files(before: DataFrame | None, now: DataFrame) -> DataFrame:
    """``(path, change)`` with change 'added', 'edited' or 'removed' between two listings (path, size, modified)."""
    if before is None:
        return now.select("path", F.lit("added").alias("change"))
    old = before.select("path", F.struct("size", "modified").alias("old"))
    both = now.select("path", F.struct("size", "modified").alias("new")).join(old, "path", "full_outer")
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(~F.col("old").eqNullSafe(F.col("new")), "edited")
    return both.select("path", change.alias("change")).where(F.col("change").isNotNull())


class Watcher:
    """The state of a watch: the listing that the stored graph was built from."""

    def __init__(self, spark: SparkSession, root: str, on_build: Callable[[Result], None] | None = None, options: Options | None = None):
        self.spark, self.root, self.on_build = spark, root, on_build
        self.options = options or Options(root)
        self.results: list[Result] = []
        self.path = os.path.join(root, cfg.TOOL_DIR, "watch")

    def _before(self) -> DataFrame | None:
        filesystem, path = walk.filesystem(self.path)
        if filesystem.get_file_info(f"{path}/_SUCCESS").type.name == "NotFound":
            return None  # nothing was watched here yet
        return self.spark.read.schema("path string, size bigint, modified bigint").parquet(self.path)

    def tick(self) -> bool:
        """Rebuilds if a source file came, changed or went since the last build; tells whether it did."""
        with temporary():
            config = cfg.init(self.root)
            files = walk.list_files(self.spark, self.root, config.exclude, scope=self.options.scope)
            now = materialize(files.where(language(F.col("path")) != "").select("path", "size", "modified"), "listing")
            if changed_files(self._before(), now).isEmpty():
                return False
            _, result = build(self.spark, self.options)
            # written only after the build: a watch that fails in it tries again
            now.write.mode("overwrite").parquet(self.path)
            release(now)
        self.results.append(result)
        if self.on_build:
            self.on_build(result)
        return True


def watch(spark: SparkSession, root: str, seconds: float | None = None, on_build=None, interval: str = "2 seconds", once: bool = False) -> list[Result]:
    """Looks at the tree once an interval and rebuilds the graph where something changed, until ``seconds`` are over or
    ``on_build`` returns True. A build that has begun is ended before the stream is."""
    watcher, over, busy = Watcher(spark, root), threading.Event(), threading.Lock()
    if once:
        watcher.on_build = on_build
        watcher.tick()
        return watcher.results

    def built(result: Result) -> None:
        if on_build and on_build(result) is True:
            over.set()

    def tick(*_) -> None:
        with busy:
            if not over.is_set():
                watcher.tick()

    watcher.on_build = built
    clock = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    query = clock.writeStream.foreachBatch(tick).trigger(processingTime=interval).start()
    until = None if seconds is None else time.monotonic() + seconds
    while not over.wait(0.1) and query.isActive and (until is None or time.monotonic() < until):
        pass
    over.set()
    with busy:
        failed = query.exception()
    query.stop()
    if failed is not None:
        raise failed
    return watcher.results
