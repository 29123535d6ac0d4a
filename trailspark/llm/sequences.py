"""Frequent subsequences (with gaps) across many sequences.

Direct sequence comparison: each sequence is sorted by its k-minimum
subsequence, the lexicographically smallest one of length k that it holds
(its (k-1)-prefix being frequent). With support ``need``, the first and the
``need``-th entry are compared: if they are equal, the pattern is frequent
and all entries that hold it move on to their next one; if not, nothing
below the ``need``-th entry can be frequent, and all entries below it skip
to the first subsequence not below it. No infrequent candidate is counted.

Groups (weeks) of any size are mined in blocks of bounded size: a pattern
that a share of all sequences holds is held by that share of at least one
block. What any block finds is then counted in all blocks.
"""

from __future__ import annotations

from bisect import bisect_left
from heapq import heapify, heappop, heappush
from math import ceil

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize

#: Sequences of one block.
BLOCK = 2_000


class Sequence:
    """Where each letter stands, and which letters stand at or after each place (as a bit mask)."""

    __slots__ = ("at", "avail")

    def __init__(self, letters: list[int]) -> None:
        self.at: dict[int, list[int]] = {}
        for i, x in enumerate(letters):
            self.at.setdefault(x, []).append(i)
        self.avail = [0] * (len(letters) + 1)
        for i in range(len(letters) - 1, -1, -1):
            self.avail[i] = self.avail[i + 1] | 1 << letters[i]

    def next(self, x: int, p: int) -> int:
        """The place after the first ``x`` at or after ``p``; it must exist."""
        places = self.at[x]
        return places[bisect_left(places, p)] + 1


def k_min(seq: Sequence, trie: dict, k: int, bound: tuple | None, strict: bool) -> tuple | None:
    """The smallest k-subsequence of different letters that is not below (strict: above) ``bound``.

    ``trie`` holds the frequent (k-1)-patterns.
    """

    def go(node: dict, depth: int, p: int, used: int, tight: bool) -> tuple | None:
        free = seq.avail[p] & ~used
        if depth == k - 1:
            low = bound[depth] + strict if tight else 0
            free = free >> low << low
            return ((free & -free).bit_length() - 1,) if free else None
        for x, child in node.items():  # in ascending order
            if tight and x < bound[depth] or not free >> x & 1:
                continue
            rest = go(child, depth + 1, seq.next(x, p), used | 1 << x, tight and x == bound[depth])
            if rest is not None:
                return (x, *rest)
        return None

    return go(trie, 0, 0, 0, bound is not None)


def trie_of(patterns) -> dict:
    root: dict = {}
    for pat in sorted(patterns):
        node = root
        for x in pat:
            node = node.setdefault(x, {})
    return root


def mine(sequences: list[list[str]], need: int, longest: int) -> dict[tuple, int]:
    """All lists of 1 to ``longest`` different names held by at least ``need`` sequences, with their support."""
    support: dict[str, int] = {}
    for s in sequences:
        for x in set(s):
            support[x] = support.get(x, 0) + 1
    names = sorted(x for x, n in support.items() if n >= need)
    code = {x: i for i, x in enumerate(names)}
    found: dict[tuple, int] = {(x,): support[x] for x in names}
    base = [Sequence([code[x] for x in s if x in code]) for s in sequences]
    level = [(i,) for i in range(len(names))]
    for k in range(2, longest + 1):
        if not level:
            break
        trie, level = trie_of(level), []
        heap = [(m, i) for i, s in enumerate(base) if (m := k_min(s, trie, k, None, False)) is not None]
        heapify(heap)
        while len(heap) >= need:
            front = [heappop(heap) for _ in range(need)]
            first, pivot = front[0][0], front[-1][0]
            if first == pivot:
                while heap and heap[0][0] == first:
                    front.append(heappop(heap))
                level.append(first)
                found[tuple(names[x] for x in first)] = len(front)
            for m, i in front:
                if first != pivot and m == pivot:
                    heappush(heap, (m, i))
                elif (n := k_min(base[i], trie, k, pivot, first == pivot)) is not None:
                    heappush(heap, (n, i))
    return found


def contained(sequence: list[str], node: dict, at: int, prefix: tuple, into: dict) -> None:
    """Adds 1 for each pattern of the trie that the sequence holds."""
    for x, child in node.items():
        if x is None:
            into[prefix] = into.get(prefix, 0) + 1
            continue
        try:
            p = sequence.index(x, at)
        except ValueError:
            continue
        contained(sequence, child, p + 1, (*prefix, x), into)


def shorten(names: list[str], longest: int) -> list[str]:
    """A list that holds the same subsequences of up to ``longest`` names.

    Kept are the places at which a leftmost match can stand: the first of
    each name, the next of each name after one of these, and so on. Their
    number doesn't grow with the length of a long sequence.
    """
    n = len(names)
    if n <= 64:
        return names
    places: dict[str, list[int]] = {}
    for i, x in enumerate(names):
        places.setdefault(x, []).append(i)
    level, kept = {0}, set()
    for _ in range(longest):
        new = set()
        for p in level:
            for at in places.values():
                j = bisect_left(at, p)
                if j < len(at):
                    new.add(at[j])
        level = {j + 1 for j in new if j not in kept}
        kept |= new
    return [names[i] for i in sorted(kept)]


def _runs(longest: int):
    kind = pa.schema([("seq_id", pa.string()), ("part", pa.int64()), ("us", pa.int64()), ("names", pa.list_(pa.string()))])

    def run(batches):
        part = TaskContext.get().partitionId()
        open_: list = []  # the sequence that the last batch ended in: id, first time, names

        def rows(done):
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*[(i, part, t, n) for i, t, n in done]), kind)], schema=kind)

        for b in batches:
            ids, us, names = (b.column(c).to_pylist() for c in ("seq_id", "us", "name"))
            done, start = [], 0
            for i in range(1, len(ids) + 1):
                if i == len(ids) or ids[i] != ids[start]:
                    if open_ and open_[0] == ids[start]:
                        # A list that was shortened is so again with what follows: it never grows with the run.
                        open_[2] = shorten(open_[2] + names[start:i], longest)
                    else:
                        if open_:
                            done.append(open_)
                        open_ = [ids[start], us[start], shorten(names[start:i], longest)]
                    start = i
            if done:
                yield rows(done)
        if open_:
            yield rows([open_])

    return run


def _merged(longest: int):
    """Shortens the joined lists of an aggregation."""

    def run(batches):
        for b in batches:
            names = [shorten(x, longest) for x in b.column("names").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in b.schema.names if c != "names"), pa.array(names, pa.list_(pa.string()))], names=[c for c in b.schema.names if c != "names"] + ["names"])

    return run


#: Parts of a sequence that are joined at once.
FAN = 64


def sequences(events: DataFrame, longest: int = 5) -> DataFrame:
    """``seq_id, us, names``: the names of each sequence in order, and its first time.

    ``events``: seq_id, us, pos, id, name; rows with a null seq_id, us or
    name are left out. Order is us, pos, id. Rows are range-partitioned, so a
    hot sequence lies in many partitions; each shortens its part to what
    matters to patterns of up to ``longest`` names, and the parts are joined
    and shortened again in a tree of ``FAN`` at a time, so no task gathers
    more than that many short lists.
    """
    rows = events.select("seq_id", "us", F.coalesce("pos", F.lit(0)).cast("bigint").alias("pos"), F.coalesce(F.col("id").cast("string"), F.lit("")).alias("id"), "name").filter("seq_id is not null and us is not null and name is not null")
    order = ("seq_id", "us", "pos", "id")
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    # Written once: partitions are told apart by their number.
    parts = materialize(placed.select("seq_id", "us", "name").mapInArrow(_runs(longest), "seq_id string, part bigint, us bigint, names array<string>"))
    joined = lambda df, *keys: df.groupBy(*keys).agg(F.min("us").alias("us"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("part", "names"))), lambda x: x["names"])).alias("names"))
    most = (parts.agg(F.max("part")).first()[0] or 0) + 1
    while most > FAN:
        up = parts.withColumn("part", F.floor(F.col("part") / FAN))
        parts = joined(up, "seq_id", "part").select("seq_id", "part", "us", "names").mapInArrow(_merged(longest), "seq_id string, part bigint, us bigint, names array<string>")
        most = -(-most // FAN)
    return joined(parts, "seq_id").select("seq_id", "us", "names")


def frequent(seqs: DataFrame, group: str, share: float = 0.2, least: int = 3, shortest: int = 3, longest: int = 5, block: int = BLOCK) -> DataFrame:
    """``group, sequence (array), support``: patterns that many sequences of a group hold.

    ``seqs``: the group column, seq_id and names. A pattern is a list of
    ``shortest`` to ``longest`` different names; it is held by at least
    ``least`` sequences and ``share`` of the group's. Null groups are left
    out; an empty table gives no row.
    """
    seqs = seqs.filter(F.col(group).isNotNull()).select(F.col(group).alias("g"), "seq_id", "names")
    sizes = seqs.groupBy("g").agg(F.count("*").alias("total")).withColumn("blocks", F.ceil(F.col("total") / block))
    table = materialize(seqs.join(sizes, "g").select("g", "total", "blocks", F.pmod(F.xxhash64("seq_id"), F.col("blocks")).alias("b"), "names"))

    def local(pdf: pd.DataFrame) -> pd.DataFrame:
        m, total, blocks = len(pdf), int(pdf.total.iloc[0]), int(pdf.blocks.iloc[0])
        need = max(1, ceil(share * m - 1e-9))
        if blocks == 1:
            need = max(need, least)
        got = mine([list(x) for x in pdf.names], need, longest)
        rows = [(pdf.g.iloc[0], list(k), n, blocks, total) for k, n in got.items() if len(k) >= shortest]
        return pd.DataFrame(rows, columns=["g", "sequence", "n", "blocks", "total"])

    kind = "g string, sequence array<string>, n bigint, blocks bigint, total bigint"
    # Blocks are few bytes but much work: a fixed number of tasks keeps them from being merged by size.
    tasks = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    table = table.repartition(tasks, "g", "b")
    mined = materialize(table.groupBy("g", "b").applyInPandas(local, kind))
    whole = mined.filter("blocks = 1").select("g", "sequence", "n", "total")
    # Groups of several blocks: every block's finds are counted in all blocks.
    cands = mined.filter("blocks > 1").select("g", "sequence").distinct()
    split = table.filter("blocks > 1")
    blocks_of = split.select(F.col("g").alias("_g"), F.col("b").alias("_b")).distinct()
    per_block = cands.join(blocks_of, F.col("g") == F.col("_g")).select(F.col("_g").alias("g2"), F.col("_b").alias("b2"), "sequence")

    def count(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"g": [], "sequence": [], "n": [], "total": []})
        trie: dict = {}
        for pat in right.sequence:
            node = trie
            for x in pat:
                node = node.setdefault(x, {})
            node[None] = {}
        into: dict[tuple, int] = {}
        for names in left.names:
            contained(list(names), trie, 0, (), into)
        return pd.DataFrame([(key[0], list(k), n, int(left.total.iloc[0])) for k, n in into.items()], columns=["g", "sequence", "n", "total"])

    counted = split.groupBy("g", "b").cogroup(per_block.groupBy("g2", "b2")).applyInPandas(count, "g string, sequence array<string>, n bigint, total bigint")
    summed = counted.groupBy("g", "sequence", "total").agg(F.sum("n").alias("n")).select("g", "sequence", "n", "total")
    ok = (F.col("n") >= least) & (F.col("n") >= F.col("total") * share - 1e-9)
    return whole.unionByName(summed).filter(ok).select(F.col("g").alias(group), "sequence", F.col("n").alias("support"))
