"""What must not be chosen by the size of files on disk: sorted keys pack to a hundredth of what they take in memory."""

import os
import random
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from trailspark.operators import cluster, format_a, ordered

DATA = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_counted_and_joined_rows_are_never_broadcast(spark):
    df = spark.range(2000).select(F.lit("g").alias("g"), F.col("id").alias("o"))
    n = ordered.running_counts(df, "g", ["o"], {"k": F.col("o") % 2 == 0})
    assert "Broadcast" not in plan(n) and n.agg(F.max("k")).first()[0] == 1000
    both = ordered.joined(df.withColumn("x", F.lit(1)), ordered.numbered(df, "g", ["o"], {"k": F.lit(True)}), "g", ["o"])
    assert "Broadcast" not in plan(both) and both.filter("k = o + 1").count() == 2000


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
@pytest.mark.parametrize("name", ["a_fork_at_second_step", "a_tool_calls", "a_step_usage"])
def test_no_numbered_table_is_sent_to_the_driver(spark, name):
    assert not re.search(r"BroadcastHashJoin [^\n]*_part", plan(entry.queries()[name](spark, DATA)))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
@pytest.mark.parametrize("name", ["a_tool_calls", "a_step_usage"])
def test_no_table_with_a_row_per_file_is_sent_to_the_driver_as_it_runs(spark, name):
    df = entry.queries()[name](spark, DATA)
    assert df.collect() and "isFinalPlan=true" in plan(df) and "Broadcast" not in plan(df)


def test_prompts_are_only_compared_with_leaders(spark, monkeypatch):
    rng = random.Random(3)
    base = [f"w{i}" for i in range(30)]
    sets = list({(rng.choice("qd"), frozenset(rng.sample(base, 27))) for _ in range(600)} | {("q", frozenset(rng.sample(base, rng.randrange(1, 9)))) for _ in range(300)})
    rng.shuffle(sets)
    want, led = {}, []
    for i, (k, t) in enumerate(sets, 1):
        home = next((j for j, kk, tt in led if kk == k and len(t & tt) / len(t | tt) >= 0.45), None)
        if home is None:
            led.append((i, k, t))
        want[i] = home or i
    rows = []
    write = cluster.materialize
    monkeypatch.setattr(cluster, "materialize", lambda df: (out := write(df), rows.append(out.count()))[0])
    df = spark.createDataFrame([(i, k, sorted(t)) for i, (k, t) in enumerate(sets, 1)], "rank long, kind string, tokens array<string>")
    assert {r["rank"]: r.leader for r in cluster.leaders(df).collect()} == want and sum(rows) < 3 * len(sets)
    monkeypatch.setattr(cluster, "BLOCK", 200)
    monkeypatch.setattr(cluster, "BLOCK_WORDS", 900)
    assert {r["rank"]: r.leader for r in cluster.leaders(df).collect()} == want


def test_examples_are_the_same_in_small_blocks(spark, monkeypatch):
    text = "please bake the sourdough bread with seeds number"
    rows = [(f"i{i}", f"s{i % 3}", i, 40 + i, f"{text} {'xyz'[i % 3] * 4} {i}00", False, False, "prompt") for i in range(9)]
    sig = spark.createDataFrame(rows, "id string, session_id string, us long, chars long, promptText string, is_correction boolean, is_question boolean, kind string")
    want = sorted(cluster.examples(sig).collect())
    assert [r.id for r in sorted(want, key=lambda r: r.place)] == ["i8", "i7", "i6", "i5", "i4"] and {r.leader_id for r in want} == {"i8"}
    monkeypatch.setattr(cluster, "BLOCK", 2)
    assert sorted(cluster.examples(sig).collect()) == want


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
def test_examples_shuffle_the_records_once_and_only_what_answers_need(spark):
    p = plan(entry.queries()["cluster_examples"](spark, DATA))
    assert len(re.findall(r"FileScan parquet [^\n]*claude_records", p)) == 1 and "parentUuid" not in p


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
def test_answers_are_the_responses_of_steps(spark):
    raw = spark.read.parquet(f"{DATA}/claude_records.parquet")
    rows = format_a.in_steps(format_a.lines(raw))
    met = format_a.responses(rows).join(format_a.steps(rows).select("file_path", "step_idx", "step_id"), ["file_path", "step_idx"])
    want = met.groupBy(F.lower("step_id").alias("id")).agg(F.min("response").alias("answer"))
    assert sorted(format_a.answers(raw).collect(), key=str) == sorted(want.collect(), key=str) and want.count() > 20
