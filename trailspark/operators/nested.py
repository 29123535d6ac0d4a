"""Deeply nested JSON to flat tables of nodes.

A node is a JSON object that is an element of an array. A bottom-up tree
automaton walks each value once: the state of an object is given by its
label, its keys and the states of their values (arrays: the set of their
elements' states), so equal shapes get equal states. The label of a node is
its member ``type`` if that is a string, else the key that holds its array;
it is part of the state, so each accepting state stands for one variant, and
the state alone routes a node: to its kind, and to the typed subtype table
of that kind (:func:`variant_table`). All variants keep the same keys:
source, record, path, parent path, kind and shape.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.jsons import Number, clean, dump, parse

NODE_SCHEMA = "src string, row_id string, path string, parent_path string, kind string, shape string"
#: Rows of one yielded batch.
OUT_ROWS = 20_000
#: States that a worker remembers.
MEMO = 100_000


class Automaton:
    """Transitions seen so far; a state is a 64-bit hash, so workers agree."""

    def __init__(self) -> None:
        self.known: dict[tuple, str] = {}
        #: Accepting states: kind and members of the variant.
        self.variants: dict[str, tuple[str, tuple]] = {}

    def forget(self) -> None:
        """Between documents: what is remembered stays bounded."""
        if len(self.known) > MEMO:
            self.known.clear()
            self.variants.clear()

    def of(self, key: tuple) -> str:
        s = self.known.get(key)
        if s is None:
            s = self.known[key] = xxhash.xxh64_hexdigest(repr(key))
            if key[0] == "node":
                self.variants[s] = (key[1], key[2:])
        return s


SCALARS = {str: "s", bool: "b", int: "n", float: "n", Number: "n", type(None): "0"}


def walk(value, top_key: str, auto: Automaton, root_is_node: bool = False) -> list[tuple]:
    """``(path, parent_path, state, value)`` of each node in document order.

    Works with an own stack, so depth isn't bounded. With ``root_is_node``
    the value itself is a node too, of path and label ``top_key``.
    """
    out: list[list] = []
    results: list = [None]
    # A frame: value, path, key of the nearest array or member, enclosing node's path, slot of its state in the frame above, is a node.
    stack = [(value, top_key if root_is_node else "", top_key, "", results, 0, root_is_node)]
    done: list[tuple] = []
    while stack:
        v, path, key, node, into, slot, element = stack.pop()
        t = type(v)
        if t is dict:
            row, label, here = None, None, node
            if element:
                label = v.get("type")
                if type(label) is not str:
                    label = key
                row = [path, node, None, v]
                out.append(row)
                here = path
            subs: list = [None] * len(v)
            done.append((into, slot, tuple(v), subs, row, label))
            items = list(v.items())
            for i in range(len(items) - 1, -1, -1):
                k, x = items[i]
                tx = type(x)
                if tx is dict or tx is list:
                    stack.append((x, f"{path}.{k}" if path else k, k, here, subs, i, False))
                else:
                    subs[i] = SCALARS[tx]
        elif t is list:
            subs = [None] * len(v)
            done.append((into, slot, None, subs, None, None))
            for i in range(len(v) - 1, -1, -1):
                x = v[i]
                tx = type(x)
                if tx is dict or tx is list:
                    stack.append((x, f"{path}.{i}" if path else str(i), key, node, subs, i, True))
                else:
                    subs[i] = SCALARS[tx]
    for into, slot, keys, subs, row, label in reversed(done):  # children before parents
        if keys is None:
            state = auto.of(("array", *sorted(set(subs))))
        elif row is None:
            state = auto.of(("object", *sorted(zip(keys, subs))))
        else:
            state = row[2] = auto.of(("node", label, *sorted(zip(keys, subs))))
        into[slot] = state
    return out


def _walked(batches: Iterator[pa.RecordBatch], auto: Automaton) -> Iterator[tuple]:
    """``src, row_id`` and the walk of each document and of each usage."""
    for b in batches:
        for src, row_id, top, doc, usage in zip(*(b.column(n).to_pylist() for n in ("src", "row_id", "top_key", "doc", "usage"))):
            auto.forget()
            v = parse(doc)
            if type(v) is dict or type(v) is list:
                yield src, row_id, walk(v, top, auto)
            if usage is not None:
                yield src, row_id, walk(parse(usage) or {}, "usage", auto, True)


def _nodes(values: bool, only: frozenset | None):
    names = ["src", "row_id", "path", "parent_path", "kind", "shape"] + ["value"] * values
    schema = pa.schema([pa.field(n, pa.string()) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = Automaton()
        cols: list[list] = [[] for _ in names]
        put = [c.append for c in cols]
        for src, row_id, found in _walked(batches, auto):
            for path, parent, state, value in found:
                # The state routes the node.
                kind = auto.variants[state][0]
                if only is not None and kind not in only:
                    continue
                put[0](src), put[1](row_id), put[2](clean(path)), put[3](clean(parent)), put[4](clean(kind)), put[5](state)
                if values:
                    put[6](clean(dump(value)))
            if len(cols[0]) >= OUT_ROWS:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], schema=schema)
                for c in cols:
                    c.clear()
        if cols[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], schema=schema)

    return run


def nodes(docs: DataFrame, values: bool = False, only: list[str] | None = None) -> DataFrame:
    """Node rows of ``docs(src, row_id, top_key, doc, usage)``.

    ``doc`` is JSON text (null or unreadable: no nodes; any depth and any
    length of number is read), ``usage`` JSON text of an object that is
    itself a node (null: none), ``top_key`` the kind of untyped elements of
    the top array. One row per node; ``parent_path`` is the nearest enclosing
    node's path, ``''`` for none; ``kind`` is that of the variant its state
    stands for. Text inside strings isn't opened. With ``values`` the node's
    JSON is kept; ``only`` keeps the variants of these kinds. Rows aren't
    shuffled.
    """
    return docs.select("src", "row_id", "top_key", "doc", "usage").mapInArrow(_nodes(values, None if only is None else frozenset(only)), NODE_SCHEMA + ", value string" * values)


def variants(docs: DataFrame) -> DataFrame:
    """``src, kind, shape, members, nodes``: the accepting states of the automaton, with their members and number of nodes.

    ``members`` lists key and type (s string, n number, b boolean, 0 null,
    o object or array). Counted in the workers before the shuffle.
    """
    schema = pa.schema([("src", pa.string()), ("kind", pa.string()), ("shape", pa.string()), ("members", pa.string()), ("n", pa.int64())])

    def run(batches):
        auto = Automaton()
        n: dict[tuple, int] = {}

        def batch():
            rows = list(zip(*((clean(src or ""), clean(k), s, clean(m), c) for (src, k, s, m), c in n.items())))
            n.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, schema)], schema=schema)

        for src, _, found in _walked(batches, auto):
            for _, _, state, value in found:
                kind, members = auto.variants[state]
                key = (src, kind, state, ",".join(f"{k}:{s if len(s) == 1 else 'o'}" for k, s in members))
                n[key] = n.get(key, 0) + 1
            if len(n) >= OUT_ROWS:
                yield batch()
        if n:
            yield batch()

    seen = docs.select("src", "row_id", "top_key", "doc", "usage").mapInArrow(run, "src string, kind string, shape string, members string, n bigint")
    return seen.groupBy("src", "kind", "shape", "members").agg(F.sum("n").alias("nodes"))


def record_docs(records: DataFrame) -> DataFrame:
    """The latest version of each record as input of :func:`nodes`.

    Content that is a plain JSON string holds no node and isn't shuffled.
    """
    content = F.col("message.content")
    rows = records.select(
        F.lower("uuid").alias("uuid"), "line_no",
        F.when(F.ltrim(content).rlike(r"^\s*[\[{]"), content).alias("doc"),
        F.when(F.col("message.usage").isNotNull(), F.to_json("message.usage")).alias("usage"),
    )
    from .records import latest

    return latest(rows).filter("doc is not null or usage is not null").select(F.lit("claude").alias("src"), F.col("uuid").alias("row_id"), F.lit("content").alias("top_key"), "doc", "usage")


def line_docs(lines: DataFrame) -> DataFrame:
    """Format B lines, once per ``line_id`` (repeated rows are equal), as input of :func:`nodes`."""
    p = F.col("payload")
    rows = lines.filter(p.rlike(r"^\s*[\[{]") & F.col("line_id").isNotNull()).groupBy("line_id").agg(F.max("payload").alias("doc"))
    return rows.select(F.lit("codex").alias("src"), F.col("line_id").cast("string").alias("row_id"), F.lit("content").alias("top_key"), "doc", F.lit(None).cast("string").alias("usage"))


def variant_table(docs: DataFrame, kinds: list[str], fields: dict[str, str]) -> DataFrame:
    """The typed subtype table of the variants of some kinds: shared keys and a column per field.

    The automaton's states choose the nodes in the workers, so no other node
    leaves them. ``fields`` names a member path (``$.a.b`` without ``$.``)
    and its Spark type; a missing or uncastable member is null. Clashing
    names get a trailing underscore.
    """
    v: Column = F.try_parse_json("value")
    shared = ["src", "row_id", "path", "parent_path", "kind", "shape"]
    cols = [F.try_variant_get(v, f"$.{path}", kind).alias((n := path.replace(".", "_")) + ("_" if n in shared else "")) for path, kind in fields.items()]
    return nodes(docs, values=True, only=kinds).select(*shared, *cols)
