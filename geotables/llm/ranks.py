"""Places of rows within their group, without a task that holds a whole group.

Rows are dealt by ranges of (group, order), so a group with a third of all rows lies in many partitions; each partition
is numbered by itself and a small table of (group, partition) counts turns these numbers into places in the group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geotables.llm.common import written


def numbered(df: DataFrame, group: str, ranges: list[Column], order: list[Column], keep: list[str], name: str) -> DataFrame:
    """The ``keep`` columns of every row and ``pos`` bigint, its place in its ``group`` (from 1) by ``order``; a null
    group is a group. ``group`` must be among ``keep``. Only ``keep`` is written.

    ``ranges`` are columns of bounded width that the order implies (its first columns, or prefixes of them): rows are
    dealt by them, and samples of them go to the driver. Rows that are equal in group and ``ranges`` share a task, which
    sorts them by ``order``, spilling if need be. Rows equal in ``order``, too, get adjacent places in any order."""
    first = F.col(group).asc_nulls_first()
    rows = df.repartitionByRange(first, *ranges).sortWithinPartitions(first, *order)
    rows = written(rows.select(*keep, F.monotonically_increasing_id().alias("_at")), name)
    # the upper bits of _at are the partition, the lower 33 count its rows
    spans = rows.groupBy(group, F.expr("shiftright(_at, 33)").alias("_part")).agg(
        F.min("_at").alias("_low"), F.count(F.lit(1)).alias("_rows"))
    starts = spans.selectExpr(
        f"{group} as _group", "_part", "_low",
        f"coalesce(sum(_rows) over (partition by {group} order by _part rows between unbounded preceding and 1 preceding), 0L)"
        " as _before")
    placed = rows.withColumn("_in", F.expr("shiftright(_at, 33)")).join(
        starts, F.expr(f"{group} <=> _group and _in = _part"))
    return placed.select(*keep, F.expr("_at - _low + _before + 1").alias("pos"))


def ordered_turns(rows: DataFrame, keep: dict[str, str], name: str) -> DataFrame:
    """conv_id, the columns of ``keep`` (SQL over conv_id, turn, role and text) and ``pos``, the place of the row in its
    conversation: by turn (null first), rows of one turn by role, then text. No role or text may be null."""
    rows = rows.selectExpr("conv_id", "turn", "role", "text", *[f"{sql} as {c}" for c, sql in keep.items()])
    turn = F.col("turn").asc_nulls_first()
    ranges = [turn, F.substring("role", 1, 16).asc(), F.substring("text", 1, 32).asc()]
    return numbered(rows, "conv_id", ranges, [turn, F.col("role").asc(), F.col("text").asc()], ["conv_id", *keep], name)
