"""Numbering of rows in a total order without one task for all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from symbolary.sources.shared import cut


def numbered(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """rows and their place (from 1): rows are dealt by ranges, ranges are counted, and places added up within each."""
    keys = [f"__k{i}" for i in range(len(order))]
    ranged = cut(rows.withColumns(dict(zip(keys, order, strict=True))).repartitionByRange(*keys).withColumn("__part", F.spark_partition_id()))
    # one row for each partition
    before = ranged.groupBy("__part").agg(F.count("*").alias("n")).withColumn("__before", F.coalesce(F.sum("n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("n")
    nth = F.row_number().over(W.partitionBy("__part").orderBy(*keys))
    return ranged.join(F.broadcast(before), "__part").withColumn(name, (nth + F.col("__before")).cast("long")).drop("__part", "__before", *keys)
