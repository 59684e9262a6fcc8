"""Running totals over ordered groups of any size."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from parapet.sources.session import cut


def running_total(df: DataFrame, keys: Sequence[str], micros: str, tie: Sequence[str], values: dict[str, Column]) -> DataFrame:
    """Adds running sums (named by ``values``) within ``keys``, ordered by ``micros`` and then ``tie``.

    One window per key would put a key that holds a third of all rows into one task. Here the rows are cut into ranges of
    (keys, time, tie) of about equal size, so a hot key, and even one timestamp of it, is spread over many ranges. The
    sums of the ranges are accumulated per key (a key has one row a range at most), and the rows are windowed within their
    range only. Keys and times must not be null; ``keys``, time and tie together name a row.
    """
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    staged = (df.withColumns({f"__v_{n}": v for n, v in values.items()})
              .repartitionByRange(ranges, *keys, micros, *tie).withColumn("__range", F.spark_partition_id()))
    staged = cut(staged)  # read twice, and the ranges must be the same both times
    own = [*keys, "__range"]
    earlier = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    before = (staged.groupBy(*own).agg(*[F.sum(f"__v_{n}").alias(f"__s_{n}") for n in values])
              .select(*own, *[F.coalesce(F.sum(f"__s_{n}").over(earlier), F.lit(0)).alias(f"__b_{n}") for n in values]))
    inside = Window.partitionBy(*own).orderBy(micros, *tie).rowsBetween(Window.unboundedPreceding, 0)
    local = staged.select("*", *[F.sum(f"__v_{n}").over(inside).alias(f"__l_{n}") for n in values])
    return local.join(before, own).select(
        *df.columns, *[(F.col(f"__l_{n}") + F.col(f"__b_{n}")).alias(n) for n in values])
