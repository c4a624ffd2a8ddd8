"""What changed between consecutive full snapshots, by one window per key over the snapshot index.

A key's rows are numbered by the place of their snapshot among those its source delivered. The hash
of the row before shows a change, a gap before a row an addition, a gap after it a removal.

Defined results
    * several rows of a key in one snapshot: the latest ``delivered_at`` counts, the greatest
      tie-breaker among equals; a null time is the earliest.
    * rows without key take part only as proof that the snapshot was delivered; rows without
      source or snapshot number are left out.
    * the first snapshot of a source gives no rows; a snapshot a source skipped isn't one of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def snapshot_changes(
    df: DataFrame, source: str, key: str, snapshot: str, content: Column, delivered: str, tie: str
) -> DataFrame:
    """``(source, key, snapshot, change)`` with change 'added', 'removed' or 'changed'.

    One hash aggregation that combines map-side, one small join with the snapshot index (broadcast only
    if Spark has measured it small), and one window whose groups hold a key's snapshots."""
    rows = df.where(F.col(source).isNotNull() & F.col(snapshot).isNotNull()).select(
        F.col(source).alias("s"), F.col(key).alias("k"), F.col(snapshot).alias("n"), content.alias("h"), F.col(delivered).alias("at"), F.col(tie).alias("tie")
    )
    by_source = Window.partitionBy("s").orderBy("n")
    # every (source, snapshot) pair once: bounded by the deliveries, not by their records
    index = rows.groupBy("s", "n").agg(F.lit(1).alias("one")).select(
        "s", "n", F.row_number().over(by_source).alias("i"), F.lead("n").over(by_source).alias("next_n")
    )
    latest = rows.where(F.col("k").isNotNull()).groupBy("s", "k", "n").agg(F.max_by("h", F.struct("at", "tie")).alias("h"))
    placed = latest.join(index, ["s", "n"])
    by_key = Window.partitionBy("s", "k").orderBy("i")
    seen = placed.select(
        "s", "k", "n", "i", "h", "next_n",
        F.lag("i").over(by_key).alias("i0"), F.lag("h").over(by_key).alias("h0"), F.lead("i").over(by_key).alias("i1"),
    )
    fresh = F.when((F.col("i") > 1) & (F.col("i0").isNull() | (F.col("i0") < F.col("i") - 1)), F.lit("added"))
    altered = F.when((F.col("i0") == F.col("i") - 1) & ~F.col("h0").eqNullSafe(F.col("h")), F.lit("changed"))
    gone = F.when(F.col("next_n").isNotNull() & (F.col("i1").isNull() | (F.col("i1") > F.col("i") + 1)), F.lit("removed"))
    events = F.array(
        F.struct(F.col("n").alias("n"), F.coalesce(fresh, altered).alias("change")),
        F.struct(F.col("next_n").alias("n"), gone.alias("change")),
    )
    out = seen.select("s", "k", F.explode(F.filter(events, lambda e: e["change"].isNotNull())).alias("e"))
    return out.select(F.col("s").alias(source), F.col("k").alias(key), F.col("e.n").alias(snapshot), F.col("e.change").alias("change"))


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _flag(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _items(c: Column, fields: dict[str, str], nested: dict | None = None) -> Column:
    """A list with every null replaced by the empty value it equals."""

    def element(e: Column) -> Column:
        out = [(_text(e[f]) if kind == "text" else _flag(e[f])).alias(f) for f, kind in fields.items()]
        if nested:
            out.append(_items(e["expanded"], nested).alias("expanded"))
        return F.struct(*out)

    return F.transform(F.coalesce(c, F.array()), element) if nested is None else F.when(c.isNull(), F.array()).otherwise(F.transform(c, element))


_FIELD = {"name": "text", "type": "text", "nullable": "flag"}
_PARAM = {"name": "text", "type": "text", "type_expr": "text", "nullable": "flag", "variadic": "flag"}
_VALUE = {"name": "text", "type": "text", "type_expr": "text", "nullable": "flag"}


def contract_hash(parameters: Column, returns: Column) -> Column:
    """16-byte digest of parameters and returns; null, empty list, empty string and false are one, and returns
    without values equal null returns."""
    values = _items(returns["values"], _VALUE, _FIELD)
    many = F.when(F.size(values) > 0, _flag(returns["multiple"])).otherwise(F.lit(False))
    return F.unhex(F.md5(F.to_json(F.struct(_items(parameters, _PARAM, _FIELD).alias("p"), many.alias("m"), values.alias("v")))))
