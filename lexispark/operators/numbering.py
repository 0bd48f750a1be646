"""Row numbers over a whole table, without one task that sorts it all."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexispark.storage import settled


def numbered(rows: DataFrame, *order: str, name: str = "number") -> DataFrame:
    """``rows`` with ``name``, from 0, in the order of columns that have no ties. Rows are dealt into ranges; a number is the
    number of rows in the ranges before (one count for each range) and the place within the range."""
    ranges = settled(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "numbered")
    before = F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    bases = ranges.groupBy("_range").agg(F.count("*").alias("_n")).select("_range", F.coalesce(before, F.lit(0)).alias("_base"))
    within = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return ranges.withColumn("_within", within).join(F.broadcast(bases), "_range").withColumn(name, F.col("_base") + F.col("_within") - 1).drop("_range", "_within", "_base")
