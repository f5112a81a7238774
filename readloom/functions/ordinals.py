"""Dense row numbers and running sums over a global order without a single-task window.

Rows are cut into ranges of a bucket expression that grows with the order; each range is
numbered by itself and starts where the ranges before it end. The totals of the ranges are summed in
two levels, so that at most ``SUPER`` of them, or one in ``SUPER``, meet in one task.

Neighbours are found in the same ranges: the row at a range's edge is handed to the next range as well, so
there is one exchange and no join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from readloom.functions.storage import materialize

_BUCKET, _START = "_range", "_start"
#: Ranges whose totals are summed in one task.
SUPER = 1 << 14
#: Partitions up to which their starts are broadcast.
BROADCAST_PARTITIONS = 200_000


def range_starts(df: DataFrame, bucket: Column, amount: Column) -> DataFrame:
    """bucket value (an integer, not null) and the total amount of all ranges before it.

    Ranges are counted in stretches of SUPER bucket values; only one row a stretch meets in one task.
    """
    totals = df.groupBy(bucket.cast("bigint").alias(_BUCKET)).agg(F.sum(amount).alias("_total")).withColumn("_super", F.expr(f"{_BUCKET} div {SUPER}"))
    supers = totals.groupBy("_super").agg(F.sum("_total").alias("_all"))
    above = F.sum("_all").over(Window.orderBy("_super").rowsBetween(Window.unboundedPreceding, -1))
    supers = supers.select("_super", F.coalesce(above, F.lit(0)).alias("_above"))
    before = F.sum("_total").over(Window.partitionBy("_super").orderBy(_BUCKET).rowsBetween(Window.unboundedPreceding, -1))
    inside = totals.withColumn("_before", F.coalesce(before, F.lit(0)))
    return inside.join(supers, "_super").select(_BUCKET, (F.col("_before") + F.col("_above")).cast("bigint").alias(_START))


def with_neighbour(df: DataFrame, number: str, step: int, value: Column, name: str, keys: list[str] | None = None, width: int = 1 << 16) -> DataFrame:
    """df with name: value of the row whose number is step (1 or -1) further on, among rows of equal keys; null if there is none.

    Numbers are unique. Ranges of width numbers make the tasks; the row at the edge of a range is copied to its neighbour.
    """
    own = F.expr(f"{number} div {width}")
    other = F.expr(f"({number} - {step}) div {width}")  # the range of the row that looks for this one
    rows = df.withColumn("_value", value).withColumn("_own", own)
    rows = rows.withColumn(_BUCKET, F.explode(F.when(other == F.col("_own"), F.array("_own")).otherwise(F.array(F.col("_own"), other))))
    order = Window.partitionBy(*(keys or []), _BUCKET).orderBy(F.col(number) * step)
    near = F.lead(F.struct(F.col(number).alias("n"), F.col("_value").alias("v"))).over(order)
    rows = rows.withColumn("_near", near).where(F.col(_BUCKET) == F.col("_own"))
    return rows.withColumn(name, F.when(F.col("_near.n") == F.col(number) + step, F.col("_near.v"))).drop("_value", "_own", "_near", _BUCKET)


def with_ordinal(df: DataFrame, bucket: Column, order: list[Column], name: str, first: int = 0) -> DataFrame:
    """df with name: the position of each row in the order, counted from first.

    bucket must not decrease along the order, and rows of a range must fit one task.
    """
    starts = range_starts(df, bucket, F.lit(1))
    inside = F.row_number().over(Window.partitionBy(_BUCKET).orderBy(*order)) - 1 + first
    return df.withColumn(_BUCKET, bucket.cast("bigint")).join(starts, _BUCKET).withColumn(name, (F.col(_START) + inside).cast("bigint")).drop(_BUCKET, _START)


def with_running_sum(df: DataFrame, bucket: Column, order: list[Column], amount: Column, name: str) -> DataFrame:
    """df with name: the sum of amount over the rows up to and including this one."""
    starts = range_starts(df, bucket, amount)
    inside = F.sum(amount).over(Window.partitionBy(_BUCKET).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return df.withColumn(_BUCKET, bucket.cast("bigint")).join(starts, _BUCKET).withColumn(name, (F.col(_START) + inside).cast("bigint")).drop(_BUCKET, _START)


def sorted_by(df: DataFrame, order: list[Column]) -> DataFrame:
    """df in a global order whose keys are computed once a row, not at each comparison."""
    keys = {f"_key{i}": c for i, c in enumerate(order)}
    return df.withColumns(keys).orderBy(*keys).drop(*keys)


def number_in_place(df: DataFrame, name: str, first: int = 1) -> DataFrame:
    """df with name: each row's position in the order in which its partitions hold the rows, counted from first."""
    kept = materialize(df).withColumn("_id", F.monotonically_increasing_id())
    part = F.shiftright("_id", 33)
    starts = range_starts(kept, part, F.lit(1))
    inside = F.col("_id").bitwiseAND((1 << 33) - 1) + first
    if kept.rdd.getNumPartitions() <= BROADCAST_PARTITIONS:
        starts = F.broadcast(starts)
    return kept.withColumn(_BUCKET, part).join(starts, _BUCKET).withColumn(name, (F.col(_START) + inside).cast("bigint")).drop(_BUCKET, _START, "_id")


def number_sorted(df: DataFrame, order: list[Column], name: str, first: int = 1) -> DataFrame:
    """df in a global order with name: each row's position, counted from first.

    For orders without a bucket expression: the rows are range-partitioned and sorted by Spark, kept, and
    each partition starts where those before it end. One count per partition comes back.
    """
    return number_in_place(sorted_by(df, order), name, first)
