import random

from pyspark.sql import functions as F

from trailspark.llm.nearest import nearest


def test_equals_trying_all_pairs(spark):
    rng = random.Random(6)
    left = [(i, rng.choice(["hot", "hot", "b", None]), rng.randrange(-50, 400) if rng.random() < 0.95 else None) for i in range(300)]
    right = [(i, rng.choice(["hot", "b", "c", None]), rng.randrange(-50, 400)) for i in range(80)] + [(7, "hot", None)]
    right += right[:10]
    l = spark.createDataFrame(left, "rid long, entity string, t long").withColumn("_k", F.lit(1)).withColumn("distance", F.lit("x"))
    r = spark.createDataFrame(right, "rid long, entity string, t long").withColumn("extra", F.lit(1))
    for tol, tick in ((20, 5), (20, 50), (0, 3), (7, 7)):
        want = {}
        for i, e, t in left:
            c = [(abs(t - u), j) for j, f, u in right if e is not None and t is not None and u is not None and f == e and abs(t - u) <= tol]
            if c:
                want[i] = min(c)
        got = nearest(l, r, tol, tick)
        assert {x.left_rid: (x.distance, x.rid) for x in got.collect()} == want
        assert got.count() == len(want) and "left_distance" in got.columns


def test_repeated_left_rows_and_nothing(spark):
    kind = "id long, entity string, t long"
    l = spark.createDataFrame([(1, "e", 5), (1, "e", 5)], kind)
    r = spark.createDataFrame([(9, "e", 6)], "rid long, entity string, t long")
    assert nearest(l, r, 1, 1).count() == 2
    assert nearest(l, r.filter("false"), 1, 1).count() == nearest(l.filter("false"), r, 1, 1).count() == 0
