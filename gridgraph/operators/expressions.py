"""User functions as Columns: what they are given, and how merges are named."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Merges that Spark aggregates with partial sums before a shuffle.
MERGES = {
    "sum": F.sum, "min": F.min, "max": F.max, "count": F.count, "avg": F.avg, "bit_or": F.bit_or, "bit_and": F.bit_and, "bit_xor": F.bit_xor,
    "first": F.first, "any": F.any_value, "bool_or": F.bool_or, "bool_and": F.bool_and, "collect_list": F.collect_list, "collect_set": F.collect_set,
}


def merged(merge: str | Callable, column: Column) -> Column:
    """An aggregate of a name, or of a function from Column to an aggregate Column."""
    return MERGES[merge](column) if isinstance(merge, str) else merge(column)


class Triplet:
    """The columns of an edge with its ends, noting which ends an expression reads: an
    inner join that nobody reads from is still a join to Catalyst, so it is left out here."""

    def __init__(self) -> None:
        self.reads_src = self.reads_dst = False

    @property
    def src(self) -> Column:
        return F.col("src")

    @property
    def dst(self) -> Column:
        return F.col("dst")

    @property
    def attr(self) -> Column:
        return F.col("attr")

    @property
    def src_attr(self) -> Column:
        self.reads_src = True
        return F.col("src_attr")

    @property
    def dst_attr(self) -> Column:
        self.reads_dst = True
        return F.col("dst_attr")
