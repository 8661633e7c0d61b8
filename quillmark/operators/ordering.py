"""Ranks and running maxima over a whole table without gathering it in one task.

A number's slot is a fixed, growing function of it, so slots are ranges of
the order that need no look at the data. Rows are ordered inside their slots, and what
stands before a slot is counted from one row for each slot. There are at most some hundred
thousand slots, whatever the data, which bounds what is broadcast.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Slots for each doubling of a number; slots that are added up together.
PER_OCTAVE, TOGETHER = 64, 256


def slot(x: Column) -> Column:
    """A long that never falls as x grows; below about 1e-6 differences blur, which costs balance and not order."""
    return (F.signum(x) * F.floor(F.log2(F.least(F.abs(x), F.lit(1e300)) * float(1 << 20) + 1) * PER_OCTAVE)).cast("long")


def before_slots(per_slot: DataFrame, fold: Callable[[Column], Column], both: Callable[[Column, Column], Column]) -> DataFrame:
    """(slot, before): the values of all lower slots folded; per_slot: (slot, value), a row for each slot. Null where there is none."""
    s = per_slot.withColumn("top", F.floor(F.col("slot") / TOGETHER))
    inside = fold(F.col("value")).over(Window.partitionBy("top").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1))
    tops = s.groupBy("top").agg(fold(F.col("value")).alias("value"))
    lower = tops.select(F.col("top").alias("lower"), F.col("value").alias("theirs"))
    above = tops.join(F.broadcast(lower), F.col("lower") < F.col("top"), "left").groupBy("top").agg(fold(F.col("theirs")).alias("outside"))
    return s.withColumn("inside", inside).join(F.broadcast(above), "top").select("slot", both(F.col("inside"), F.col("outside")).alias("before"))


def with_row_number(rows: DataFrame, key: Column, *ties: Column | str, name: str = "rank") -> DataFrame:
    """Rows with their number from 1 by a double, ascending, and then by the ties; null keys come first."""
    r = rows.withColumn("__slot", F.coalesce(slot(key), F.lit(-(1 << 40))))
    counts = r.groupBy(F.col("__slot").alias("slot")).agg(F.count(F.lit(1)).alias("value"))
    before = before_slots(counts, F.sum, lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)))
    local = F.row_number().over(Window.partitionBy("__slot").orderBy(key, *ties))
    joined = r.withColumn("__local", local).join(F.broadcast(before.withColumnRenamed("slot", "__slot")), "__slot")
    return joined.withColumn(name, (F.col("__local") + F.col("before")).cast("int")).select(*rows.columns, name)


def with_running_max(rows: DataFrame, key: Column, value: Column, *ties: Column | str, name: str = "before_max") -> DataFrame:
    """Rows with the greatest value of all rows before them, in the order of a double and then the ties; null for the first."""
    r = rows.withColumn("__slot", F.coalesce(slot(key), F.lit(-(1 << 40)))).withColumn("__value", value)
    most = r.groupBy(F.col("__slot").alias("slot")).agg(F.max("__value").alias("value"))
    before = before_slots(most, F.max, lambda a, b: F.greatest(a, b))
    local = F.max("__value").over(Window.partitionBy("__slot").orderBy(key, *ties).rowsBetween(Window.unboundedPreceding, -1))
    joined = r.withColumn("__local", local).join(F.broadcast(before.withColumnRenamed("slot", "__slot")), "__slot")
    return joined.withColumn(name, F.greatest("__local", "before")).select(*rows.columns, name)
