"""Parent-child links to full hierarchies.

Leaf peeling runs inside bounded blocks of rows (Arrow batches of rows that
were placed together by a hint such as the file): a leaf hands its subtree
size to its parent and is removed, the reverse order of removal then gives
each node its local root, depth and path; what can't be removed lies on a
loop. A block's result is a forest whose only open ends are the tops whose
parent lies in another block. These tops, a small share of the rows, form
the contracted forest. It is resolved by doubling the distance its links
span, so a chain over k blocks takes log2(k) rounds, not k; when a round
settles no further top, what remains hangs on a loop.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize

LOOP = "cycle"
#: Rows of one yielded batch when paths are asked for (a path may be long).
PATH_ROWS = 500


def peel(ids: list, parents: list) -> tuple[list, list, list, list]:
    """Leaf peeling of one block.

    Returns, for each position, the position of its local root (-1 on or
    below a loop), its depth, the position of its parent (-1 if none here)
    and the size of its subtree in the block.
    """
    n = len(ids)
    at = {x: i for i, x in enumerate(ids)}
    up = [-1 if p is None else at.get(p, -1) for p in parents]
    waits = [0] * n
    for p in up:
        if p >= 0:
            waits[p] += 1
    size = [1] * n
    order = [i for i in range(n) if not waits[i]]
    for i in order:  # grows while it is read
        p = up[i]
        if p >= 0:
            size[p] += size[i]
            waits[p] -= 1
            if not waits[p]:
                order.append(p)
    root, depth = [-1] * n, [-1] * n
    for i in reversed(order):
        p = up[i]
        if p < 0:
            root[i], depth[i] = i, 0
        elif root[p] >= 0:
            root[i], depth[i] = root[p], depth[p] + 1
    return root, depth, up, size


def _local(paths: bool):
    fields = [("id", pa.string()), ("top", pa.string()), ("d", pa.int64()), ("up", pa.string()), ("size", pa.int64())]
    if paths:
        fields.append(("steps", pa.list_(pa.string())))
    schema = pa.schema(fields)

    def run(batches):
        for b in batches:
            ids, parents = b.column("id").to_pylist(), b.column("parent").to_pylist()
            root, depth, up, size = peel(ids, parents)
            top = [None if r < 0 else ids[r] for r in root]
            ext = [None if r < 0 else parents[r] for r in root]
            if not paths:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(top, pa.string()), pa.array(depth, pa.int64()), pa.array(ext, pa.string()), pa.array(size, pa.int64())], schema=schema)
                continue
            for s in range(0, len(ids), PATH_ROWS):
                e = min(s + PATH_ROWS, len(ids))
                steps = []
                for i in range(s, e):
                    own = []
                    if root[i] >= 0:
                        x = i
                        while x >= 0:
                            own.append(ids[x])
                            x = up[x]
                        own.reverse()
                    steps.append(own)
                yield pa.RecordBatch.from_arrays([pa.array(ids[s:e], pa.string()), pa.array(top[s:e], pa.string()), pa.array(depth[s:e], pa.int64()), pa.array(ext[s:e], pa.string()), pa.array(size[s:e], pa.int64()), pa.array(steps, pa.list_(pa.string()))], schema=schema)

    return run


def forest(rows: DataFrame, node: str, parent: str, near: list[str], order: str, paths: bool = False, rows_together: int = 65_536) -> DataFrame:
    """Root, depth and (with ``paths``) path of each node.

    ``rows`` holds one row per node: ``node`` (text, unique, not null),
    ``parent`` (null, empty or unknown: the node is a root). ``near`` and
    ``order`` (a whole number) only say which rows to place together; a hot
    value of ``near`` is cut into runs of ``rows_together``. Other columns
    are not read.

    Result: ``id, root_id, depth``; on or below a loop ``root_id`` is
    ``'cycle'`` and ``depth`` -1. With ``paths`` also ``path`` (ids from root
    to node; empty on loops) and ``descendants`` (their number; null on
    loops). An empty table gives an empty result; rows of a null id are left
    out; for tables with repeated ids see :func:`trees`.
    """
    nodes = rows.filter(F.col(node).isNotNull()).select(
        F.col(node).cast("string").alias("id"),
        F.when(F.col(parent) != "", F.col(parent)).cast("string").alias("parent"),
        F.xxhash64(*near).alias("_near"),
        F.coalesce(F.col(order), F.lit(0)).cast("bigint").alias("_order"),
    )
    kind = "id string, top string, d bigint, up string, size bigint" + ", steps array<string>" * paths
    placed = nodes.repartition("_near", F.floor(F.col("_order") / rows_together)).sortWithinPartitions("_near", "_order")
    local = materialize(placed.select("id", "parent").mapInArrow(_local(paths), kind))

    tops = local.filter(F.col("up").isNotNull() & (F.col("id") == F.col("top"))).select("id", "up")
    held = ["steps"] if paths else []
    ports = local.select(F.col("id").alias("up"), F.col("top").alias("to"), (F.col("d") + 1).alias("hop"), F.col("up").alias("beyond"), *held)
    # An open top whose parent is nowhere is a root; so ports are looked up first.
    links = tops.join(ports, "up", "left").select(
        "id",
        F.when(F.col("hop").isNull(), F.col("id")).when(F.col("to").isNull(), F.lit(LOOP)).otherwise(F.col("to")).alias("to"),
        F.when(F.col("hop").isNull(), F.lit(0)).when(F.col("to").isNull(), F.lit(-1)).otherwise(F.col("hop")).cast("bigint").alias("hop"),
        (F.col("to").isNull() | F.col("beyond").isNull()).alias("done"),
        *([F.coalesce("steps", F.array().cast("array<string>")).alias("steps")] if paths else []),
    )
    links = materialize(links)
    left = links.filter("not done").count()
    while left:
        far = links.select(F.col("id").alias("to"), F.col("to").alias("to2"), F.col("hop").alias("hop2"), F.col("done").alias("done2"), *([F.col("steps").alias("steps2")] if paths else []))
        links = materialize(
            links.join(far, "to", "left").select(
                "id",
                F.when(F.col("done") | F.col("to2").isNull(), F.col("to")).otherwise(F.col("to2")).alias("to"),
                F.when(F.col("done") | F.col("to2").isNull(), F.col("hop")).when(F.col("hop2") < 0, F.lit(-1)).otherwise(F.col("hop") + F.col("hop2")).alias("hop"),
                (F.col("done") | F.coalesce(F.col("done2"), F.lit(True))).alias("done"),
                *([F.when(F.col("done") | F.col("to2").isNull(), F.col("steps")).when(F.col("hop2") < 0, F.array().cast("array<string>")).otherwise(F.concat("steps2", "steps")).alias("steps")] if paths else []),
            )
        )
        now = links.filter("not done").count()
        if now == left:
            break
        left = now
    links = links.select(
        F.col("id").alias("top"),
        F.when(F.col("done") & (F.col("hop") >= 0), F.col("to")).otherwise(F.lit(LOOP)).alias("to"),
        F.when(F.col("done"), F.col("hop")).otherwise(F.lit(-1)).cast("bigint").alias("hop"),
        *([F.when(F.col("done") & (F.col("hop") >= 0), F.col("steps")).otherwise(F.array().cast("array<string>")).alias("before")] if paths else []),
    )
    # Only the rows under an open top need the contracted forest.
    settled = local.filter(F.col("up").isNull()).select(
        "id",
        F.coalesce(F.col("top"), F.lit(LOOP)).alias("root_id"),
        F.col("d").alias("depth"),
        *([F.col("steps").alias("path"), "size"] if paths else []),
    )
    under = local.filter(F.col("up").isNotNull()).join(links, "top").select(
        "id",
        F.col("to").alias("root_id"),
        F.when(F.col("hop") < 0, F.lit(-1)).otherwise(F.col("hop") + F.col("d")).cast("bigint").alias("depth"),
        *([F.when(F.col("hop") < 0, F.array().cast("array<string>")).otherwise(F.concat("before", "steps")).alias("path"), "size"] if paths else []),
    )
    out = settled.unionByName(under)
    if not paths:
        return out
    # A top hands the size of its block's subtree to each node above its block.
    gains = (
        local.filter(F.col("id") == F.col("top")).select("top", "size").join(links, "top")
        .select(F.explode("before").alias("id"), "size").groupBy("id").agg(F.sum("size").alias("more"))
    )
    return out.join(gains, "id", "left").select(
        "id", "root_id", "depth", "path",
        F.when(F.col("depth") >= 0, F.col("size") - 1 + F.coalesce("more", F.lit(0))).alias("descendants"),
    )


def trees(rows: DataFrame, node: str, parent: str, near: list[str], order: str, paths: bool = False) -> DataFrame:
    """:func:`forest` over rows of which several may have one id: the one with the greatest ``order`` counts."""
    from .records import latest

    kept = rows.select(*dict.fromkeys([node, order, parent, *near]))
    return forest(latest(kept, node, order), node, parent, near, order, paths)


def closure(tree: DataFrame) -> DataFrame:
    """All pairs ``ancestor, descendant, distance`` of a forest with paths; loops have none."""
    return tree.filter("depth > 0").select(F.col("id").alias("descendant"), "depth", F.posexplode(F.expr("slice(path, 1, depth)")).alias("pos", "ancestor")).select("ancestor", "descendant", (F.col("depth") - F.col("pos")).cast("bigint").alias("distance"))
