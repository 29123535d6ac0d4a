"""Hierarchies, nested records and drifting schemas against plain versions."""

import json
import random

import brute
import pytest
from pyspark.sql import functions as F

from trailspark.functions import jsons
from trailspark.operators import drift, hierarchy, nested


def plain_tree(rows):
    """id -> (root, depth, path) by walking up."""
    up = {i: p for i, p, *_ in rows}
    out = {}
    for i in up:
        path, x = [], i
        while x is not None and x not in path and len(path) <= len(up):
            path.append(x)
            p = up[x]
            x = p if p in up else None
        looped = x is not None
        out[i] = ("cycle", -1, []) if looped else (path[-1], len(path) - 1, path[::-1])
    return out


def random_rows(rng, n):
    rows = []
    for i in range(n):
        kind = rng.random()
        p = None if kind < 0.05 else "" if kind < 0.08 else "gone" if kind < 0.1 else f"n{rng.randrange(n)}" if kind < 0.2 else f"n{max(0, i - rng.randrange(1, 4))}"
        rows.append((f"n{i}", p, f"f{i * 7 // n}", i))
    return rows


@pytest.mark.parametrize("batch", ["7", "10000"])
@pytest.mark.parametrize("seed", [1, 2])
def test_forest_equals_walking_up(spark, batch, seed):
    rows = random_rows(random.Random(seed), 300)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        df = spark.createDataFrame(rows, "node string, parent string, file string, line long").withColumn("id", F.lit("x")).withColumn("top", F.lit(1))
        got = {r.id: (r.root_id, r.depth, r.path, r.descendants) for r in hierarchy.forest(df, "node", "parent", ["file"], "line", paths=True).collect()}
        short = {r.id: (r.root_id, r.depth) for r in hierarchy.forest(df, "node", "parent", ["file"], "line").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = plain_tree(rows)
    below = {i: sum(i in p[2][:-1] for p in want.values()) for i in want}
    assert {k: v[:3] for k, v in got.items()} == want
    assert {k: v[3] for k, v in got.items()} == {i: (below[i] if want[i][1] >= 0 else None) for i in want}
    assert short == {i: w[:2] for i, w in want.items()}


def test_closure_lists_every_ancestor(spark):
    rows = [("a", None, "f", 1), ("b", "a", "f", 2), ("c", "b", "f", 3), ("x", "x", "f", 4)]
    tree = hierarchy.forest(spark.createDataFrame(rows, "node string, parent string, f string, l long"), "node", "parent", ["f"], "l", paths=True)
    assert {tuple(r) for r in hierarchy.closure(tree).collect()} == {("a", "b", 1), ("a", "c", 2), ("b", "c", 1)}


def test_trees_take_the_latest_of_repeated_rows_and_leave_out_nulls(spark):
    rows = [("a", None, "f", 1), ("b", "zz", "f", 2), ("b", "a", None, 5), ("b", "a", None, 5), (None, "a", "f", None)]
    got = hierarchy.trees(spark.createDataFrame(rows, "node string, parent string, f string, l long"), "node", "parent", ["f"], "l").collect()
    assert {tuple(r) for r in got} == {("a", "a", 0), ("b", "a", 1)}


def test_forest_of_nothing(spark):
    df = spark.createDataFrame([], "node string, parent string, f string, l long")
    assert hierarchy.forest(df, "node", "parent", ["f"], "l", paths=True).count() == 0


def plain_nodes(v, path="", key="content", node="", element=False):
    if isinstance(v, dict):
        if element:
            yield path, node, v["type"] if isinstance(v.get("type"), str) else key
            node = path
        for k, x in v.items():
            yield from plain_nodes(x, f"{path}.{k}" if path else k, k, node)
    elif isinstance(v, list):
        for i, x in enumerate(v):
            yield from plain_nodes(x, f"{path}.{i}" if path else str(i), key, node, True)


def random_json(rng, depth=0):
    k = rng.random()
    if depth > 4 or k < 0.3:
        return rng.choice([1, 2.5, "t", None, True, "{\"a\":[{}]}", "é"])
    if k < 0.65:
        return {rng.choice(["type", "a", "b", "items"]): random_json(rng, depth + 1) for _ in range(rng.randrange(4))}
    return [random_json(rng, depth + 1) for _ in range(rng.randrange(4))]


def test_nodes_equal_plain_recursion(spark):
    rng = random.Random(3)
    docs = [("s", str(i), "content", json.dumps(random_json(rng)), None) for i in range(300)]
    df = spark.createDataFrame(docs, "src string, row_id string, top_key string, doc string, usage string").withColumn("path", F.lit("clash")).withColumn("kind", F.lit(1))
    got = sorted((r.row_id, r.path, r.parent_path, r.kind) for r in nested.nodes(df).collect())
    assert got == sorted((d[1], *n) for d in docs for n in plain_nodes(json.loads(d[3])))


def test_nodes_of_odd_documents(spark):
    deep = "[" * 100_000 + "]" * 100_000
    docs = [("s", "1", "content", None, None), ("s", "2", "content", "", '{"input_tokens":1}'), ("s", "3", "content", '[{"a":', None), ("s", "4", "content", "NaN", None), ("s", "5", "content", deep, None), ("s", None, "content", "[{}]", None), ("s", "7", "content", '[{"type":"\\ud800"}]', None), ("s", "8", "content", "[" + ",".join(["{}"] * 50_000) + "]", None)]
    got = nested.nodes(spark.createDataFrame(docs, "src string, row_id string, top_key string, doc string, usage string"))
    n = {r.row_id: r["count"] for r in got.groupBy("row_id").count().collect()}
    assert n == {"2": 1, None: 1, "7": 1, "8": 50_000}


def test_json_of_any_depth_and_length_of_number(spark):
    deep = "[" * 50_000 + '{"a":1}' + "]" * 50_000
    long = '[{"type":"n","v":' + "7" * 5_000 + "}]"
    docs = [("s", "1", "content", deep, None), ("s", "2", "content", long, None), ("s", "3", "content", "[" * 50_000 + "{}", None), ("s", "4", "content", "[{}," + "7" * 5_000 + "x]", None)]
    got = nested.nodes(spark.createDataFrame(docs, "src string, row_id string, top_key string, doc string, usage string"), values=True).collect()
    assert {(r.row_id, r.kind, r.path.count(".")) for r in got} == {("1", "content", 49_999), ("2", "n", 0)}
    assert [r.value for r in got if r.row_id == "2"] == [long[1:-1].replace(":", ": ").replace(",", ", ")]
    rng = random.Random(6)
    for _ in range(400):
        v = random_json(rng)
        t = json.dumps(v, indent=rng.choice([None, 1]))
        assert jsons._read(t) == v and jsons.parse(jsons.dump(jsons._read(t))) == v
        broken = t[: rng.randrange(len(t))] + rng.choice(["", "}", ",", '"', "]"])
        try:
            json.loads(broken)
        except ValueError:
            with pytest.raises((ValueError, IndexError)):
                jsons._read(broken)
    big = jsons._read(long)
    assert jsons.dump([{"d": big}]).count("7") == 5_000


def test_drift_of_deep_lines_and_long_numbers(spark):
    rows = [(1, "m", 1, '{"a":' + "7" * 5_000 + ',"b":' + "[" * 50_000 + "]" * 50_000 + "}"), (2, "m", 2, '{"a":"x","b":1}')]
    got = drift.drift(spark.createDataFrame(rows, "file_id long, machine string, exported_at long, raw string")).collect()
    assert {(r.change, r.old_field) for r in got} == {("retyped", "a"), ("retyped", "b")}
    t = drift.ingest(spark.createDataFrame(rows, "file_id long, machine string, exported_at long, raw string"), "raw", ["file_id"]).collect()
    assert all(r._readable for r in t) and "7" * 5_000 in t[0]._rescued


def test_a_hot_machine_and_a_hot_file(spark):
    rows = [(f, "hot", f // 2, json.dumps({"k" if f % 2 else "K": f"v{i}", "same": i})) for f in range(60) for i in range(40 if f == 7 else 3)]
    got = [tuple(r) for r in drift.drift(spark.createDataFrame(rows, "file_id long, machine string, exported_at long, raw string")).collect()]
    assert len(got) == 59 and set(got) == brute.drift(rows)


def test_equal_shapes_share_a_state_and_variants_get_their_table(spark):
    docs = [("s", "1", "content", '[{"type":"t","input":{"x":1}},{"input":{"x":7},"type":"t"},{"type":"t","input":"x"}]', None)]
    df = spark.createDataFrame(docs, "src string, row_id string, top_key string, doc string, usage string")
    n = nested.nodes(df, values=True)
    shapes = [r.shape for r in n.orderBy("path").collect()]
    assert shapes[0] == shapes[1] != shapes[2]
    t = nested.variant_table(df, ["t"], {"input.x": "bigint", "path": "string"})
    assert [r.input_x for r in t.orderBy("row_id", "path").collect()] == [1, 7, None] and "path_" in t.columns


def test_drift_equals_plain_version_and_ignores_what_is_unreadable(spark):
    rng = random.Random(5)
    names = ["a", "sessionId", "session_id", "SessionID", "b", "msg", "new-name", "text"]
    rows = []
    for f in range(24):
        picked = rng.sample(names, 4)
        for _ in range(rng.randrange(0, 5)):
            o = {k: rng.choice([1, "u", "v", None, True, {"in": rng.choice(["p", 2])}, [1]]) for k in picked}
            rows.append((f, f"m{f % 3}", f // 3 if f % 5 else 0, json.dumps(o)))
        rows.append((f, f"m{f % 3}", f // 3 if f % 5 else 0, rng.choice([None, "", "[1]", '{"cut":'])))
    df = spark.createDataFrame(rows, "file_id long, machine string, exported_at long, raw string").withColumn("type", F.lit("clash")).withColumn("change", F.lit(1))
    got = [tuple(r) for r in drift.drift(df).select("file_id", "change", "old_field", "new_field").collect()]
    assert len(got) == len(set(got)) and set(got) == brute.drift(rows)


def test_drift_of_nothing_and_of_nulls(spark):
    kind = "file_id long, machine string, exported_at timestamp_ntz, raw string"
    assert drift.drift(spark.createDataFrame([], kind)).count() == 0
    assert drift.drift(spark.createDataFrame([(None, None, None, None), (1, "m", None, None), (2, None, None, "{}")], kind)).count() == 0


def test_rescue_keeps_every_value_and_promotion_replays_it(spark):
    rows = [(1, '{"type":"x","isMeta":"no","extra":{"k":[1]},"session_id":"s1"}'), (2, '{"type":5,"sessionId":"s2"}'), (3, "oops")]
    t = drift.ingest(spark.createDataFrame(rows, "id long, raw string"), "raw", ["id"])
    got = {r.id: r for r in drift.promote(t, {"session_id": ("sessionId", "string")}).collect()}
    assert got[1].type == "x" and got[1].isMeta is None and json.loads(got[1]._rescued) == {"isMeta": "no", "extra": {}, "extra.k": [1], "session_id": "s1"}
    assert got[1].sessionId == "s1" and got[2].sessionId == "s2" and json.loads(got[2]._rescued) == {"type": 5}
    assert not got[3]._readable and got[3]._rescued is None
    told = {r.id: r for r in drift.ingest(spark.createDataFrame(rows, "id long, raw string"), "raw", ["id"], approved=drift.APPROVED).collect()}
    assert told[1].sessionId == "s1" and json.loads(told[1]._promoted) == {"sessionId": "session_id"} and "session_id" not in json.loads(told[1]._rescued)
    assert told[2]._promoted is None
    with pytest.raises(ValueError):
        drift.ingest(spark.createDataFrame(rows, "type long, raw string"), "raw", ["type"])
