import os
import threading
import types

import pytest
from graphloom.storage import counted, materialize, release, shared_dir, temporary


def local(df):
    return df._graphloom_path.removeprefix("file://")


def test_tables_are_written_once_and_deleted(spark):
    t = materialize(spark.createDataFrame([(1, None), (2, "x")], "id bigint, `odd name` string"))
    assert sorted(tuple(r) for r in t.collect()) == [(1, None), (2, "x")] and local(t).startswith(shared_dir(spark).removeprefix("file://"))
    release(t, spark.range(1))
    assert not os.path.exists(local(t))
    release(t)


def test_temporary_tables_end_with_their_block(spark):
    kept = materialize(spark.range(3))
    with temporary():
        inner = materialize(spark.range(0))
        assert inner.count() == 0 and inner.dtypes == [("id", "bigint")] and os.path.exists(local(inner))
    assert not os.path.exists(local(inner)) and kept.count() == 3
    release(kept)


def test_counts_and_folders(spark):
    t = materialize(spark.range(10).selectExpr("id", "id % 2 = 0 as even"), by="even", count="even")
    assert counted(t) == 5 == t.where("even").count() and counted(materialize(spark.range(3))) == 3 and counted(materialize(spark.range(0))) == 0


def test_blocks_of_other_threads_keep_their_tables(spark):
    made, go, done = [], threading.Event(), threading.Event()

    def other():
        with temporary():
            made.append(materialize(spark.range(4)))
            go.set()
            done.wait(30)

    with temporary():
        t = threading.Thread(target=other)
        t.start()
        go.wait(30)
    assert made[0].count() == 4
    done.set()
    t.join()
    assert not os.path.exists(local(made[0]))


def test_a_cluster_needs_a_shared_folder():
    session = types.SimpleNamespace(conf=types.SimpleNamespace(get=lambda *_: None), sparkContext=types.SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(session)
