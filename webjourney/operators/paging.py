"""Pages at any offset without one task that sorts the listing.

The listing is dealt by ranges of its order and written once, with a count for each range. A page reads only the ranges
that hold its rows, so the hundred-thousandth page costs what the first one does.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webjourney.operators.ordered import work_table

_SLICE = "_slice"


class Listing:
    """``df`` in the total order ``by`` (columns or names, ``F.desc`` allowed)."""

    def __init__(self, df: DataFrame, by: Sequence[Column | str]) -> None:
        self.by, self.columns = list(by), df.columns
        self.rows = work_table(df.repartitionByRange(*self.by).withColumn(_SLICE, F.spark_partition_id()))
        # One small row for each range.
        counts = self.rows.groupBy(_SLICE).agg(F.count("*").alias("n")).orderBy(_SLICE).collect()
        self.slices = [(r[_SLICE], r["n"]) for r in counts]
        self.total = sum(n for _, n in self.slices)

    def ranges(self, limit: int, offset: int = 0) -> tuple[list[int], int]:
        """The ranges that hold the page, and how many of their rows come before it."""
        held, before, skip = [], 0, 0
        for number, n in self.slices:
            if before < offset + limit and before + n > offset:
                if not held:
                    skip = offset - before
                held.append(number)
            before += n
        return held, max(skip, 0)

    def page(self, limit: int, offset: int = 0) -> DataFrame:
        """Rows ``offset`` to ``offset + limit`` in order; beyond the end none."""
        if limit < 0 or offset < 0:
            raise ValueError("limit and offset must not be negative")
        held, skip = self.ranges(limit, offset)
        near = self.rows.where(F.col(_SLICE).isin(held)).orderBy(*self.by)
        return near.offset(skip).limit(limit).select(*self.columns)

    def page_info(self, limit: int, offset: int = 0) -> dict[str, int | bool]:
        return {"total_count": self.total, "has_next": offset + limit < self.total, "has_prev": offset > 0,
                "current_page": offset // limit + 1, "total_pages": -(-self.total // limit)}
