"""Pages of a result in a stable total order."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

DEFAULT_LIMIT = 50


@dataclass(frozen=True)
class Options:
    limit: int = DEFAULT_LIMIT
    offset: int = 0


UNLIMITED = Options(limit=0)


@dataclass(frozen=True)
class Page:
    items: list[Row]
    total: int
    offset: int
    truncated: bool

    @property
    def returned(self) -> int:
        return len(self.items)


def page_frame(df: DataFrame, order: list, options: Options = Options()) -> DataFrame:
    """The rows of one page: a top-k plan for the first page, never a full sort kept in memory."""
    offset = max(0, options.offset)
    out = df.orderBy(*order)
    out = out.offset(offset) if offset else out
    return out.limit(options.limit) if options.limit > 0 else out


def page_after(df: DataFrame, order: list[str], last: list | None = None, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """The next page behind the row whose ``order`` columns hold ``last`` (null sorts first): a filter and a top-k.

    However far the page lies behind the first, no task keeps more than ``limit`` rows; an offset keeps all before it."""
    if last is not None:
        behind, same = F.lit(False), F.lit(True)
        for name, value in zip(order, last):
            c = F.col(name)
            behind = behind | (same & (c.isNotNull() if value is None else F.coalesce(c > F.lit(value), F.lit(False))))
            same = same & c.eqNullSafe(F.lit(value))
        df = df.where(behind)
    return df.orderBy(*order).limit(limit)


def paginate(df: DataFrame, order: list, options: Options = Options()) -> Page:
    """Rows ``[offset, offset + limit)`` with the total. A limit of 0 or less means all rows; a negative
    offset counts as 0, one beyond the end as the end."""
    total = df.count()
    offset = min(max(0, options.offset), total)
    items = page_frame(df, order, Options(options.limit, offset)).collect() if offset < total else []
    return Page(items, total, offset, offset + len(items) < total)


def with_total(df: DataFrame, order: list, options: Options = Options()) -> DataFrame:
    """A page whose rows carry ``total_count``; past the end there are no rows."""
    total = df.agg(F.count(F.lit(1)).alias("total_count")).withColumn("k", F.lit(1))
    return page_frame(df, order, options).withColumn("k", F.lit(1)).join(total, "k").drop("k")
