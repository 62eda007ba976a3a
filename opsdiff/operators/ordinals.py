"""Running numbers of rows in a global order, without a task that sees all of them."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from opsdiff.session import broadcast_if_small, shared_dir


def with_ordinal(
    rows: DataFrame, order: list[str], out: str, within: str | None = None, path: str | None = None
) -> DataFrame:
    """Adds ``out``: 1, 2, ... in the order of the columns, over all rows or over those of each ``within``.

    The rows are sorted by range once and written with their place in the range; per range (and
    ``within``) they are counted, and a row's number is its place plus what lies in the ranges before.
    A host with a third of all rows is spread over as many ranges.  Rows equal in all of ``order``
    have some order.  The sorted rows go to ``path``, or to a new folder on shared storage.
    """
    keys = [within] if within else []
    path = path or shared_dir(rows.sparkSession, "ordered")
    place = F.monotonically_increasing_id()
    ranged = rows.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    ranged.withColumns({"_range": F.shiftright(place, 33), "_place": place}).write.parquet(path)
    spark = rows.sparkSession
    schema = StructType([*rows.schema.fields, StructField("_range", LongType()), StructField("_place", LongType())])
    kept = spark.read.schema(schema).parquet(path)
    ranges = kept.groupBy("_range", *keys).agg(F.min("_place").alias("_first"), F.count("*").alias("_n"))
    if within:
        before = Window.partitionBy(within).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
        offsets = ranges.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    else:
        # One row for each task of the sort.
        counted = sorted(tuple(r) for r in ranges.collect())
        starts = accumulate((n for _, _, n in counted), initial=0)
        offsets = spark.createDataFrame(
            [(at, first, start) for (at, first, _), start in zip(counted, starts)], "_range long, _first long, _before long"
        )
    named = offsets.withColumnsRenamed({"_range": "_at", within or "": "_of"})
    same = F.col("_range") == F.col("_at")
    if within:  # a row without it is numbered among its like
        same &= F.col(within).eqNullSafe(F.col("_of"))
    numbered = kept.join(broadcast_if_small(named), same)
    return numbered.select(*rows.columns, (F.col("_before") + F.col("_place") - F.col("_first") + 1).alias(out))
