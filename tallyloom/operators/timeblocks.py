"""Ordered computations over an owner's rows in two levels, so that no task holds a whole owner.

Rows are grouped by owner and block of time (a day, an hour, a month). Within a block a window
function does the work; across blocks it runs over one row per block, and what that carries
is joined to the block's rows. An owner's rows of one block are one group, so the block has to be
chosen so that it holds what a task can sort; the blocks of one owner are another. Owner and block are
never null as keys, so that window and join are partitioned alike and the rows are shuffled once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_OWNER, _BLOCK = "_owner", "_block"


def _blocked(rows: DataFrame, owner: str, at: str, unit: str) -> DataFrame:
    """rows with the owner as a struct and the block's beginning in microseconds, the least for rows without a time."""
    begin = F.unix_micros(F.date_trunc(unit, F.col(at).cast("timestamp")))
    return rows.withColumns({_OWNER: F.struct(F.col(owner).alias("id")), _BLOCK: F.coalesce(begin, F.lit(-(2**63)))})


def _within(order: list[str]):
    return Window.partitionBy(_OWNER, _BLOCK).orderBy(*order)


def _blocks_before():
    return Window.partitionBy(_OWNER).orderBy(_BLOCK).rowsBetween(Window.unboundedPreceding, -1)


def _carried(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """rows with the columns of their block's row; a null owner or time is a value like others."""
    return rows.join(blocks, [_OWNER, _BLOCK], "left")


def running_sum(rows: DataFrame, owner: str, order: list[str], value: Column, name: str, unit: str = "day") -> DataFrame:
    """rows with the sum of value over the owner's rows up to each, by order, whose first column is a time.

    The order should tell an owner's rows apart. A null value counts as nothing; before the first value the sum is null.
    """
    blocked = _blocked(rows, owner, order[0], unit).withColumn("_value", value)
    inside = F.sum("_value").over(_within(order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    sums = blocked.groupBy(_OWNER, _BLOCK).agg(F.sum("_value").alias("_sum"))
    carry = sums.select(_OWNER, _BLOCK, F.sum("_sum").over(_blocks_before()).alias("_carry"))
    total = F.coalesce(F.col("_inside") + F.col("_carry"), F.col("_inside"), F.col("_carry"))
    return _carried(blocked.withColumn("_inside", inside), carry).withColumn(name, total).drop(_OWNER, _BLOCK, "_value", "_inside", "_carry")


def previous(rows: DataFrame, owner: str, order: list[str], columns: list[str], name: str, unit: str = "day") -> DataFrame:
    """rows with a struct (name) of the columns of the owner's row before each, by order; null for the first.

    What is carried may be large, so it doesn't pass through the window over an owner's blocks: that gives each block
    the next one, and a block's last row is sent there. The first row of a block takes it up.
    """
    kept = F.struct(*columns)
    blocked = _blocked(rows, owner, order[0], unit)
    after = F.lead(_BLOCK).over(Window.partitionBy(_OWNER).orderBy(_BLOCK)).alias("_next")
    after = blocked.select(_OWNER, _BLOCK).distinct().select(_OWNER, _BLOCK, after).where("_next IS NOT NULL")
    dealt = blocked.repartition(_OWNER, _BLOCK)
    # The owner is named so that last rows and all rows want the same columns and read one shuffle.
    last = dealt.groupBy(_OWNER, _BLOCK).agg(F.max_by(F.struct(kept.alias("kept"), F.col(owner)), F.struct(*order)).alias("_last"))
    carry = last.join(after, [_OWNER, _BLOCK]).select(_OWNER, F.col("_next").alias(_BLOCK), F.col("_last.kept").alias("_carry"))
    met = _carried(dealt.withColumns({"_inside": F.lag(kept).over(_within(order)), "_n": F.row_number().over(_within(order))}), carry)
    return met.withColumn(name, F.when(F.col("_n") == 1, F.col("_carry")).otherwise(F.col("_inside"))).drop(_OWNER, _BLOCK, "_inside", "_n", "_carry")


def last_value(rows: DataFrame, settings: DataFrame, owner: str, at: str, since: str, value: str, unit: str = "day") -> DataFrame:
    """rows with the last value of settings (owner, since, value) that is not null and not after the row's time; null before the first.

    A setting counts for the rows of its own moment; of settings of one moment the greatest value counts.
    """
    kind = settings.schema[value].dataType
    given = settings.where(F.col(value).isNotNull()).groupBy(owner, since).agg(F.max(value).alias(value))
    marked = rows.withColumns({"_at": F.col(at), "_row": F.lit(1), value: F.lit(None).cast(kind)})
    both = marked.unionByName(given.select(owner, F.col(since).alias("_at"), F.lit(0).alias("_row"), value), allowMissingColumns=True)
    blocked = _blocked(both, owner, "_at", unit)
    upto = _within(["_at", "_row"]).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    blocks = blocked.groupBy(_OWNER, _BLOCK).agg(F.max_by(value, F.when(F.col("_row") == 0, F.col("_at"))).alias("_last"))
    carry = blocks.select(_OWNER, _BLOCK, F.last("_last", ignorenulls=True).over(_blocks_before()).alias("_carry"))
    inside = blocked.withColumn("_inside", F.last(value, ignorenulls=True).over(upto)).where("_row = 1")
    return _carried(inside, carry).withColumn(value, F.coalesce("_inside", "_carry")).drop(_OWNER, _BLOCK, "_at", "_row", "_inside", "_carry")
