import datetime as dt
import random

from graphloom.operators.hot_keys import key_profile, latest_per_key

T0 = dt.datetime(2024, 3, 31, 1, 59, 59, 999999)


def frame(spark, rows, kind="timestamp_ntz"):
    return spark.createDataFrame(rows, f"id bigint, build bigint, name string, at {kind}, _rank string, row_id string")


def test_ties_nulls_and_hot_key(spark):
    rng = random.Random(1)
    rows = [(rng.randint(-50, 50), rng.choice([None, 1, 2]), rng.choice([None, "hot", "hot", "hot", *"abc"]), rng.choice([None, *(T0 + dt.timedelta(microseconds=rng.randint(-9, 9)) for _ in range(3)), dt.datetime(1969, 12, 31, 23, 59, 59)]), "x", "y") for _ in range(2000)]
    rows += rows[:100]
    want = {}
    for i, b, n, at, *_ in rows:
        if n is not None and at is not None:
            want[b, n] = max(want.get((b, n), (dt.datetime.min, 0)), (at, i))
    got = latest_per_key(frame(spark, rows), ["build", "name"], "at", "id").collect()
    assert {(r.build, r.name): r.row_id for r in got} == {k: v[1] for k, v in want.items()}
    assert len(got) == len(want)


def test_extreme_ids(spark):
    rows = [(2**63 - 1, 1, "a", T0, "", ""), (-(2**63), 1, "a", T0, "", ""), (-(2**63), 1, "b", T0, "", "")]
    got = {r.name: r.row_id for r in latest_per_key(frame(spark, rows), ["build", "name"], "at", "id").collect()}
    assert got == {"a": 2**63 - 1, "b": -(2**63)}


def test_plan_aggregates_by_hash_before_the_shuffle(spark):
    plan = latest_per_key(frame(spark, [(1, 1, "a", T0, "", "")]), ["build", "name"], "at", "id")._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and plan.count("HashAggregate") == 2 and plan.count("Exchange hashpartitioning") == 1


def test_profile(spark):
    rows = [(1, 1, "a", T0, "", ""), (2, 1, "a", None, "", ""), (3, 1, "b", T0, "", ""), (4, None, "b", T0, "", ""), (5, 1, None, T0, "", "")]
    got = {(r.build, r.name): (r.n_rows, round(r.share, 3)) for r in key_profile(frame(spark, rows), ["build", "name"], "at").collect()}
    assert got == {(1, "a"): (2, 0.667), (1, "b"): (1, 0.333), (None, "b"): (1, 1.0)}


def test_empty(spark):
    assert latest_per_key(frame(spark, []), ["build", "name"], "at", "id").count() == 0


def test_an_hour_that_clocks_repeat(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        rows = [(1, "a", "2024-10-27T00:50:00Z"), (2, "a", "2024-10-27T01:10:00Z")]  # 2:50 summer time, then 2:10 winter time
        df = spark.createDataFrame(rows, "id bigint, k string, at string").selectExpr("id", "1 as g", "k", "cast(at as timestamp) as at", "cast(cast(at as timestamp) as timestamp_ntz) as clock")
        assert latest_per_key(df, ["g", "k"], "at", "id").first().row_id == 2
        assert latest_per_key(df, ["g", "k"], "clock", "id").first().row_id == 1
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
