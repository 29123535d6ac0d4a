"""Order-dependent columns over groups of any size.

A window over a group runs in one task. Here rows are range-partitioned by
group and order, worked on inside each partition, and shifted by what the
partitions before hold, of which a group has only a few. A hot group is so
spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize


def running_counts(rows: DataFrame, group: str, order: list[str], flags: dict[str, Column]) -> DataFrame:
    """Adds for each flag how many rows of the group hold it, up to and including the row.

    Rows are ordered by ``order``, which must be total within a group. A null
    flag counts as false; rows of a null group form one group. All columns
    travel; for wide rows use :func:`numbered`.
    """
    parts = rows.withColumns({f"_f_{k}": F.coalesce(c, F.lit(False)).cast("bigint") for k, c in flags.items()})
    parts = parts.repartitionByRange(group, *order).withColumn("_part", F.spark_partition_id())
    own = Window.partitionBy(group, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    # Written down: range bounds are sampled, so counts and shifts must come from one run.
    local = materialize(parts.withColumns({k: F.sum(f"_f_{k}").over(own) for k in flags}).drop(*[f"_f_{k}" for k in flags]))
    sums = local.groupBy(group, "_part").agg(*[F.max(k).alias(f"_all_{k}") for k in flags])
    # A row per partition that the group lies in, of which there are few.
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = sums.select(F.col(group).alias("_g"), F.col("_part").alias("_p"), *[F.coalesce(F.sum(f"_all_{k}").over(before), F.lit(0)).alias(f"_shift_{k}") for k in flags])
    # A written table of sorted keys is a hundredth of its rows' size, so its size must not choose what is broadcast.
    met = local.hint("merge").join(shift, local[group].eqNullSafe(shift["_g"]) & (local["_part"] == shift["_p"]))
    return met.withColumns({k: F.col(k) + F.col(f"_shift_{k}") for k in flags}).drop("_g", "_p", "_part", *[f"_shift_{k}" for k in flags])


def numbered(rows: DataFrame, group: str, order: list[str], flags: dict[str, Column]) -> DataFrame:
    """Only ``group``, ``order`` and the counts of :func:`running_counts`, written once.

    Flags may cost much to work out, so they are written before the range
    exchange samples them. No other column travels; join the result to what
    is needed by :func:`joined`.
    """
    narrow = materialize(rows.select(group, *order, *[F.coalesce(c, F.lit(False)).alias(k) for k, c in flags.items()]))
    keys = narrow.select(group, *order, *[F.col(k).alias(f"_in_{k}") for k in flags])
    return running_counts(keys, group, order, {k: F.col(f"_in_{k}") for k in flags}).drop(*[f"_in_{k}" for k in flags])


def joined(rows: DataFrame, numbers: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` with the columns of ``numbers``, met by group and order (which is total). Unused columns are pruned as ever."""
    own = numbers.select(*[F.col(c).alias(f"_n_{c}") for c in (group, *order)], *[c for c in numbers.columns if c not in (group, *order)])
    cond = rows[group].eqNullSafe(own[f"_n_{group}"])
    for c in order:
        cond = cond & rows[c].eqNullSafe(own[f"_n_{c}"])
    # Either side holds all rows, however small its files are.
    return rows.hint("merge").join(own, cond).drop(*[f"_n_{c}" for c in (group, *order)])


def with_neighbours(rows: DataFrame, group: str, order: list[str], before: dict[str, str] | None = None, after: dict[str, str] | None = None) -> DataFrame:
    """Adds columns of the row before (``before``: column -> new name) and after in the group.

    The rows meet by (group, place), so a hot group is spread; only what is
    asked for travels. Adds ``place`` from 1. ``order`` must be total.
    """
    needed = list(dict.fromkeys([*(before or {}), *(after or {})]))
    keys = [group, *order]
    narrow = rows.select(*keys, *[F.col(c).alias(f"_w_{c}") for c in needed])
    n = running_counts(materialize(narrow), group, order, {"place": F.lit(True)})
    out = n.select(*keys, "place")
    for names, step, tag in ((before, 1, "_b"), (after, -1, "_a")):
        if names:
            other = n.select(F.col(group).alias(f"{tag}g"), (F.col("place") + step).alias(f"{tag}p"), *[F.col(f"_w_{c}").alias(new) for c, new in names.items()])
            out = out.join(other, (F.col(group) == F.col(f"{tag}g")) & (F.col("place") == F.col(f"{tag}p")), "left").drop(f"{tag}g", f"{tag}p")
    return out if set(rows.columns) <= set(keys) else joined(rows, out, group, order)
