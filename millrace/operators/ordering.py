"""Row numbers and pages of a whole table without a global sort or a window over all rows.

Rows are dealt to ranges of the order, sorted there and written; the driver sees one count for
each range, adds these up, and a row's number is its place in the range plus what lies before.
A page is read from the ranges that hold its numbers.
"""

from __future__ import annotations

import uuid
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Ordered:
    """A table in ranges of an order, with the rows before each range.

    ``order`` must tell all rows apart where numbers are to be the same in every run; nulls come first.
    """

    def __init__(self, rows: DataFrame, order: list[str | Column]):
        from ..sources.index import shared_dir

        spark = rows.sparkSession
        path = f"{shared_dir(spark)}/millrace-order-{uuid.uuid4().hex}"
        ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
        # after the sort, the low 33 bits of the id count a partition's rows from 0
        place = ranged.withColumn("_range", F.spark_partition_id()).withColumn("_nth", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
        place.write.partitionBy("_range").parquet(path)
        fields = place.schema
        self.rows = spark.read.schema(fields).parquet(path)
        counts = {r._range: r.n for r in self.rows.groupBy("_range").agg(F.count("*").alias("n")).collect()}  # a row for each range
        self.ranges = sorted(counts)
        ends = list(accumulate(counts[r] for r in self.ranges))
        self.before = dict(zip(self.ranges, [0, *ends], strict=False))
        self.total = ends[-1] if ends else 0

    def numbered(self, name: str) -> DataFrame:
        """The rows with their number from 0 in the order."""
        if not self.ranges:
            return self.rows.select("*", F.lit(0).cast("long").alias(name)).drop("_range", "_nth")
        starts = F.array(*[F.lit(self.before.get(r, 0)).cast("long") for r in range(self.ranges[-1] + 1)])
        return self.rows.withColumn(name, F.get(starts, F.col("_range")) + F.col("_nth")).drop("_range", "_nth")

    def page(self, offset: int, limit: int) -> DataFrame:
        """The rows numbered from ``offset`` up to ``limit`` of them; only ranges that hold some are read."""
        near = [r for r in self.ranges if self.before[r] < offset + limit]
        near = [r for r, end in zip(near, [*(self.before[r] for r in near[1:]), self.total], strict=False) if end > offset]
        held = self.rows.filter(F.col("_range").isin(near) if near else F.lit(False))
        if not near:
            return held.drop("_range", "_nth")
        number = F.get(F.array(*[F.lit(self.before.get(r, 0)).cast("long") for r in range(near[-1] + 1)]), F.col("_range")) + F.col("_nth")
        return held.filter((number >= offset) & (number < offset + limit)).drop("_range", "_nth")


def after(rows: DataFrame, order: list[str], last: dict[str, object], limit: int) -> DataFrame:
    """The next ``limit`` rows after the keys ``last`` of the page before, by a filter that reaches the scan and no count of what was passed over."""
    past = F.lit(False)
    for i, name in enumerate(order):
        same = F.lit(True)
        for earlier in order[:i]:
            same = same & (F.col(earlier) == F.lit(last[earlier]))
        past = past | (same & (F.col(name) > F.lit(last[name])))
    return rows.filter(past).orderBy(*order).limit(limit)
