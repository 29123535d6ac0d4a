"""Matching records by nearest time: tick expansion.

Each right record is expanded to every tick that a left record within
tolerance can fall in. Per entity and tick only those are kept that can be
the nearest to some moment of the tick: the last one before it, the first
one after it, and one per distinct time inside it. Left records then meet
their tick by an equi-join. Entity and tick together are the key of every
shuffle, so an entity that holds a third of all rows is spread over its
ticks, and a tick keeps at most as many entries as it has distinct times.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def nearest(left: DataFrame, right: DataFrame, tolerance: int, tick: int) -> DataFrame:
    """The nearest right record of each left record.

    ``left``: ``entity, t`` and any other columns; ``right``: ``entity, t,
    rid``. Times are whole numbers of one unit, as are ``tolerance``
    (inclusive) and ``tick``. Of equally near ones the smaller ``rid``
    counts. Left rows without a match, or with a null entity or time, have
    no row. Repeated left rows each get theirs; repeated right rows count
    once. Result: the left columns, ``rid`` and ``distance``.
    """
    r = right.select(F.col("entity").alias("_e"), F.col("t").alias("_t"), F.col("rid").alias("_rid")).filter("_e is not null and _t is not null and _rid is not null")
    ticks = r.withColumn("_k", F.explode(F.sequence(F.floor((F.col("_t") - tolerance) / tick), F.floor((F.col("_t") + tolerance) / tick))))
    own = F.floor(F.col("_t") / tick)
    # -1: before the tick, 1: after it; inside, the time itself tells entries apart.
    side = F.when(own < F.col("_k"), -1).when(own > F.col("_k"), 1).otherwise(0)
    kept = (
        ticks.select("_e", "_k", "_rid", "_t", side.alias("_side"), F.when(side == 0, F.col("_t")).alias("_at"))
        .groupBy("_e", "_k", "_side", "_at")
        .agg(F.min(F.struct(F.when(F.col("_side") < 0, -F.col("_t")).otherwise(F.col("_t")).alias("o"), F.col("_rid").alias("rid"), F.col("_t").alias("t"))).alias("b"))
    )
    table = kept.groupBy("_e", "_k").agg(F.collect_list(F.struct(F.col("b.t").alias("t"), F.col("b.rid").alias("rid"))).alias("_near"))
    # The left row travels as one column, so none of its names can clash.
    l = left.filter(F.col("entity").isNotNull() & F.col("t").isNotNull()).select(F.struct(*[F.col(f"`{c}`") for c in left.columns]).alias("_l")).withColumn("_lk", F.floor(F.col("_l.t") / tick))
    best = F.expr("array_min(transform(_near, x -> struct(abs(x.t - _l.t) as distance, x.rid as rid)))")
    met = l.join(table, (F.col("_l.entity") == F.col("_e")) & (F.col("_lk") == F.col("_k"))).select("_l", best.alias("_b")).filter(F.col("_b.distance") <= tolerance)
    own = [F.col(f"_l.`{c}`").alias(f"left_{c}" if c in ("rid", "distance") else c) for c in left.columns]
    return met.select(*own, F.col("_b.rid").alias("rid"), F.col("_b.distance").alias("distance"))
