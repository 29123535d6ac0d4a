import random

from pyspark.sql import functions as F

from trailspark.llm import sequences as s

KIND = "seq_id string, us long, pos long, id string, name string"


def held(names, longest=5):
    out = set()

    def go(pre, p):
        if pre:
            out.add(pre)
        if len(pre) < longest:
            for x in set(names[p:]) - set(pre):
                go((*pre, x), names.index(x, p) + 1)

    go((), 0)
    return out


def test_mining_equals_counting_all(spark):
    rng = random.Random(4)
    seqs = [[rng.choice("abcdef") for _ in range(rng.choice([0, 1, 4, 9]))] for _ in range(60)]
    for need in (1, 5, 20):
        want = {}
        for q in seqs:
            for p in held(q, 4):
                want[p] = want.get(p, 0) + 1
        assert s.mine(seqs, need, 4) == {p: n for p, n in want.items() if n >= need}


def test_shortened_lists_hold_the_same(spark):
    rng = random.Random(9)
    for alphabet in ("ab", "abcdefg"):
        q = [rng.choice(alphabet) for _ in range(3000)]
        short = s.shorten(q, 4)
        assert len(short) < 400 and held(short, 4) == held(q[:400], 4)


def test_a_hot_sequence_is_joined_in_a_tree(spark, monkeypatch):
    rng = random.Random(11)
    rows = [("hot", i, 0, str(i), rng.choice("abcdefgh")) for i in range(6000)] + [(f"s{i}", j, 0, f"{i}-{j}", "abc"[j]) for i in range(5) for j in range(3)]
    monkeypatch.setattr(s, "FAN", 2)
    ev = spark.createDataFrame(rows, KIND).repartition(8)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.seq_id: r for r in s.sequences(ev, 3).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert got["hot"].us == 0 and len(got["hot"].names) < 300 and held(got["hot"].names, 3) == held([r[4] for r in rows[:6000]], 3)
    assert all(got[f"s{i}"].names == ["a", "b", "c"] for i in range(5))


def test_blocks_ties_nulls_and_order(spark):
    rows = []
    for i in range(40):
        for j, n in enumerate("abc" if i % 2 else "acb"):
            rows.append((f"s{i}", 5, j, f"{i}-{j}", n))  # equal times: pos decides
    rows += [(None, 1, 1, "x", "a"), ("s0", None, 1, "y", "zz"), ("s1", 9, None, None, None)]
    ev = spark.createDataFrame(rows, KIND).withColumn("names", F.lit("clash")).withColumn("g", F.lit("clash"))
    q = s.sequences(ev).withColumn("week", F.lit("w"))
    for block in (2000, 7):
        got = {tuple(r.sequence): r.support for r in s.frequent(q, "week", block=block).collect()}
        assert got == {("a", "b", "c"): 20, ("a", "c", "b"): 20}


def test_nothing(spark):
    q = s.sequences(spark.createDataFrame([], KIND)).withColumn("week", F.lit("w"))
    assert s.frequent(q, "week").count() == 0
