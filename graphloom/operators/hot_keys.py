"""Per-key results where a few keys hold most rows, by map-side combining.

Each task folds its rows into a bounded hash table of mergeable key states (Tungsten's aggregation map,
which spills when full); only those states shuffle. A key with a third of all rows then costs one state
per map task, as any other key does. Everything here is an algebraic aggregate over fixed-width
buffers, so Spark keeps it in hash aggregation and whole-stage code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SPAN = "18446744073709551616"  # 2^64, more than any id distance
_HALF = "9223372036854775808"  # 2^63, lifts ids to non-negative


def micros(ts: Column, zoned: bool = False) -> Column:
    """Microseconds since 1970: of a timestamp without zone by its own clock, whatever the session's zone; of a zoned one
    by its instant, so that an hour the clocks repeat keeps its order."""
    if zoned:
        return F.unix_micros(ts)
    day = F.datediff(ts.cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    hours, minutes = F.hour(ts).cast("long"), F.minute(ts).cast("long")
    seconds = (F.date_part(F.lit("SECOND"), ts) * 1_000_000).cast("long")
    within = hours * F.lit(3_600_000_000) + minutes * 60_000_000 + seconds
    return day * F.lit(86_400_000_000) + within


def ranked(at: Column, row_id: Column) -> Column:
    """(time, id) as one decimal that sorts as the pair does: max() of it needs no sort-based aggregation."""
    wide = lambda c: c.cast("decimal(20,0)")
    return (wide(at) * F.lit(_SPAN).cast("decimal(20,0)") + (wide(row_id) + F.lit(_HALF).cast("decimal(20,0)"))).cast("decimal(38,0)")


def ranked_id(rank: Column) -> Column:
    """The id in a ``ranked`` value."""
    return (F.pmod(rank, F.lit(_SPAN).cast("decimal(38,0)")) - F.lit(_HALF).cast("decimal(38,0)")).cast("long")


def latest_per_key(df: DataFrame, keys: list[str], at: str, row_id: str) -> DataFrame:
    """Per key the id of the row with the latest time, the greatest id among equals, as ``row_id``.

    Rows with a null time, id or last key column don't count; nulls in the other key columns are one key."""
    rows = df.where(F.col(at).isNotNull() & F.col(row_id).isNotNull() & F.col(keys[-1]).isNotNull())
    best = rows.groupBy(*keys).agg(F.max(ranked(micros(F.col(at), dict(df.dtypes)[at] == "timestamp"), F.col(row_id))).alias("_rank"))
    return best.select(*keys, ranked_id(F.col("_rank")).alias("row_id"))


def key_profile(df: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Per key the number of rows, the first and last time and the share of its group's rows.

    The share divides by the total of all keys but the last, taken from the compact per-key states."""
    states = df.where(F.col(keys[-1]).isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), F.min(at).alias("first_at"), F.max(at).alias("last_at"))
    totals = states.groupBy(*keys[:-1]).agg(F.sum("n_rows").alias("_total")).select(*[F.col(k).alias(f"_{k}") for k in keys[:-1]], "_total")
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys[:-1]]
    return states.join(totals, on).select(*keys, "n_rows", "first_at", "last_at", (F.col("n_rows") / F.col("_total")).alias("share"))
