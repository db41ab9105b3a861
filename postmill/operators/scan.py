"""Running values by key where one key may hold most rows: a segmented prefix scan over range partitions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postmill.session import materialise


class Scan:
    """Rows dealt to ranges of (key, order) and written, so that a key of many rows lies in many ranges.

    ``running`` adds an aggregate over each row and all before it of its key: within a range by a window, and across ranges by the
    totals of the key's ranges before, its carry. At most one key runs on from one range into the next, so there are fewer carries
    than ranges, and they travel as a broadcast.

    Keys may be null (nulls are one key). Rows that are equal in key and order get their values in any order, as in a window. An
    empty table gives no rows.
    """

    def __init__(self, rows: DataFrame, key: str | list[str], order: str | list[str], ranges: int | None = None) -> None:
        self.key = [key] if isinstance(key, str) else list(key)
        self.order = [order] if isinstance(order, str) else list(order)
        # range bounds are sampled anew on every run, so values and carries must come from one written table
        ranged = rows.repartitionByRange(*([ranges] if ranges else []), *self.key, *self.order).withColumn("__range", F.spark_partition_id())
        self.rows, _ = materialise(ranged, "ranged")

    def running(self, name: str, value: Column, total: Callable[[Column], Column], merge: Callable[[Column, Column], Column]) -> Scan:
        """Add ``name``: ``total`` (an aggregate such as ``F.sum`` or ``F.max``) of ``value`` so far; ``merge`` puts a carry and a range's own value together.

        Later calls may read the columns of earlier ones.
        """
        here = Window.partitionBy(*self.key, "__range").orderBy(*self.order).rowsBetween(Window.unboundedPreceding, 0)
        local = self.rows.withColumn("__value", value)
        sums = local.groupBy(*self.key, "__range").agg(total(F.col("__value")).alias("__sum"))
        before = Window.partitionBy(*self.key).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
        carries = sums.withColumn("__carry", total(F.col("__sum")).over(before)).where("__carry is not null")
        carries = carries.select(*[F.col(c).alias(f"__{c}") for c in self.key], F.col("__range").alias("__at"), "__carry")
        same = F.col("__range") == F.col("__at")
        for c in self.key:
            same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
        own = total(F.col("__value")).over(here)
        both = local.withColumn("__own", own).join(F.broadcast(carries), same, "left")
        value_ = F.when(F.col("__carry").isNull(), F.col("__own")).when(F.col("__own").isNull(), F.col("__carry")).otherwise(merge(F.col("__carry"), F.col("__own")))
        self.rows = both.withColumn(name, value_).drop("__value", "__own", "__carry", "__at", *[f"__{c}" for c in self.key])
        return self

    def sum(self, name: str, value: Column) -> Scan:
        return self.running(name, value, F.sum, lambda a, b: a + b)

    def max(self, name: str, value: Column) -> Scan:
        return self.running(name, value, F.max, lambda a, b: F.greatest(a, b))

    def done(self) -> DataFrame:
        return self.rows.drop("__range")
