"""Schemas that drift between files.

Rescue-column ingestion: each line is read against a target schema; members
that fit become typed columns, all others (unknown, or of a type that can't
be cast without loss) stay as JSON in ``_rescued``, so no value is lost.
Approved fields are promoted: their rescued values are replayed into the
typed columns that they stand for, and the table keeps which field each came
from. What a file really held is so told by its typed places, by where their
values came from, and by what stays rescued; files of one machine are
compared by that, in order of export. All of it is done in the one pass that
reads the lines.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.jsons import Number, clean, dump, parse
from ..session import materialize
from .ordered import with_neighbours

#: JSON types as bits; a field's types in a file are their union.
KINDS = {str: 1, int: 2, float: 2, Number: 2, bool: 4, list: 8, dict: 16}
STRING, OBJECT = 1, 16
ARROW = {"string": pa.string(), "bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}

#: The engine's target for exported lines of either agent: dotted member path -> type. Its column has _ for each dot.
TARGET = {
    "type": "string", "uuid": "string", "parentUuid": "string", "sessionId": "string", "timestamp": "string",
    "cwd": "string", "gitBranch": "string", "version": "string", "isSidechain": "boolean", "isMeta": "boolean",
    "message.role": "string", "message.model": "string", "message.content": "string",
    "message.usage.input_tokens": "bigint", "message.usage.output_tokens": "bigint",
    "payload.type": "string", "payload.id": "string", "payload.model": "string",
}

#: Approved fields: rescued path -> the target path that its values are replayed into.
APPROVED = {"session_id": "sessionId", "parent_uuid": "parentUuid", "is_meta": "isMeta", "is_sidechain": "isSidechain", "git_branch": "gitBranch"}


def fits(v, kind: str) -> bool:
    """Whether a JSON value can stand in a column of this type without loss."""
    t = type(v)
    if kind == "string":
        return t is str
    if kind == "boolean":
        return t is bool
    if kind == "bigint":
        return t is int and -(1 << 63) <= v < 1 << 63
    return t is float


def leaves(obj: dict) -> Iterator[tuple[str, object]]:
    """All object members as ``(dotted path, value)``, objects before their members; arrays aren't entered."""
    stack = [("", obj)]
    while stack:
        base, o = stack.pop()
        for k, v in o.items():
            path = f"{base}.{k}" if base else k
            yield path, v
            if type(v) is dict:
                stack.append((path, v))


def place(obj: dict, target: dict[str, str], approved: dict[str, str]) -> tuple[dict, dict, dict]:
    """Typed values by target path, the rescued rest by path, and for promoted values the path they came from."""
    got: dict[str, object] = {}
    rest: dict[str, object] = {}
    for path, v in leaves(obj):
        if v is None:
            continue
        kind = target.get(path)
        if kind is not None and path not in got and fits(v, kind):
            got[path] = v
        elif type(v) is dict:
            rest.setdefault(path, {})  # that there is an object here; its members follow on their own
        else:
            rest[path] = v
    origin: dict[str, str] = {}
    for path in approved.keys() & rest.keys():
        to = approved[path]
        if to not in got and fits(rest[path], target[to]):
            got[to] = rest.pop(path)
            origin[to] = path
    return got, rest, origin


def _ingest(keep: list[str], raw: str, target: dict[str, str], approved: dict[str, str]):
    def run(batches):
        for b in batches:
            typed: list[list] = [[] for _ in target]
            rescued, promoted, ok = [], [], []
            for text in b.column(raw).to_pylist():
                obj = parse(text)
                good = type(obj) is dict
                ok.append(good)
                got, rest, origin = place(obj, target, approved) if good else ({}, {}, {})
                for c, path in zip(typed, target):
                    x = got.get(path)
                    c.append(clean(x) if type(x) is str else x)
                rescued.append(clean(dump(rest)) if rest else None)
                promoted.append(clean(json.dumps(dict(sorted(origin.items())))) if origin else None)
            arrays = [b.column(c) for c in keep] + [pa.array(c, ARROW[k]) for c, k in zip(typed, target.values())]
            names = keep + [column_of(p) for p in target] + ["_rescued", "_promoted", "_readable"]
            yield pa.RecordBatch.from_arrays(arrays + [pa.array(rescued, pa.string()), pa.array(promoted, pa.string()), pa.array(ok, pa.bool_())], names=names)

    return run


def column_of(path: str) -> str:
    """The column of a dotted target path."""
    return path.replace(".", "_")


def ingest(lines: DataFrame, raw: str, keep: list[str], target: dict[str, str] | None = None, approved: dict[str, str] | None = None) -> DataFrame:
    """One table for all lines: ``keep`` columns, a typed column per target path, ``_rescued``, ``_promoted``, ``_readable``.

    ``_rescued`` is a JSON object from dotted path to value of all that has
    no typed place (objects as ``{}``, their members under their own paths),
    ``_promoted`` one from target path to the ``approved`` path that its value
    was replayed from. A line that is no JSON object has ``_readable`` false
    and nulls. Columns of the input that aren't named in ``keep`` are not
    read; a kept name that clashes with a target path is refused.
    """
    target = TARGET if target is None else target
    made = [column_of(p) for p in target] + ["_rescued", "_promoted", "_readable"]
    if len(set(keep) | set(made)) < len(keep) + len(made):
        raise ValueError("column names clash")
    src = lines.select(*keep, raw)
    ddl = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[: len(keep)]] + [f"`{column_of(p)}` {k}" for p, k in target.items()] + ["_rescued string", "_promoted string", "_readable boolean"])
    return src.mapInArrow(_ingest(keep, raw, target, approved or {}), ddl)


def promote(ingested: DataFrame, fields: dict[str, tuple[str, str]]) -> DataFrame:
    """Replays rescued values of a table that stands already into typed columns.

    ``fields``: rescued path -> (column, type). A typed column that exists
    is filled where it is null; what can't be cast stays rescued.
    """
    out = ingested
    for path, (name, kind) in fields.items():
        v = F.try_variant_get(F.try_parse_json("_rescued"), f"$['{path}']", kind)
        old = F.col(name) if name in out.columns else F.lit(None)
        out = out.withColumn(name, F.coalesce(old.cast(kind), v))
    return out


def _observe(at_type: pa.DataType, target: dict[str, str], approved: dict[str, str]):
    schema = pa.schema([("file_id", pa.int64()), ("path", pa.string()), ("kinds", pa.int32()), ("strings", pa.list_(pa.int64())), ("machine", pa.string()), ("exported_at", at_type)])
    above = {p: [".".join(p.split(".")[:k]) for k in range(1, p.count(".") + 1)] for p in target}

    def run(batches):
        for b in batches:
            files: dict[int, dict[str, list]] = {}  # once per batch: the partial step before the shuffle
            head: dict[int, tuple] = {}
            for fid, machine, at, text in zip(*(b.column(n).to_pylist() for n in ("file_id", "machine", "exported_at", "raw"))):
                obj = parse(text)
                if type(obj) is not dict:
                    continue
                fields = files.get(fid)
                if fields is None:
                    fields, head[fid] = files.setdefault(fid, {}), (machine, at)
                got, rest, origin = place(obj, target, approved)
                for path, v in got.items():
                    own = origin.get(path, path)
                    f = fields.get(own) or fields.setdefault(own, [0, set()])
                    f[0] |= KINDS[type(v)]
                    if type(v) is str:
                        f[1].add(v)
                    # The objects that a typed member stands in are seen by it alone.
                    for up in above[path] if own == path else ():
                        if up not in fields:
                            fields[up] = [OBJECT, set()]
                        else:
                            fields[up][0] |= OBJECT
                for path, v in rest.items():
                    f = fields.get(path) or fields.setdefault(path, [0, set()])
                    f[0] |= KINDS[type(v)]
                    if type(v) is str:
                        f[1].add(v)
            rows = [(fid, None, 0, None, *head[fid]) for fid in files]
            for fid, fields in files.items():
                rows += [(fid, clean(p), k, [_hash(v) for v in s] if k == STRING else None, None, None) for p, (k, s) in fields.items()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return run


def _hash(v: str) -> int:
    return xxhash.xxh3_64_intdigest(v.encode("utf-8", "surrogatepass")) - (1 << 63)


def fields_seen(lines: DataFrame, target: dict[str, str] | None = None, approved: dict[str, str] | None = None) -> DataFrame:
    """``file_id, path, kinds, strings, machine, exported_at``: what each batch of lines saw of each field.

    ``kinds`` is the union of the types' bits, ``strings`` the hashes of the
    distinct values of a field that held strings only. A row with a null path
    stands for the file itself. A batch bounds every array.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    src = lines.select("file_id", "machine", "exported_at", "raw")
    at = src.schema["exported_at"].dataType
    run = _observe(to_arrow_type(at), TARGET if target is None else target, APPROVED if approved is None else approved)
    return src.mapInArrow(run, f"file_id bigint, path string, kinds int, strings array<bigint>, machine string, exported_at {at.simpleString()}")


def bare(path: Column) -> Column:
    return F.lower(F.regexp_replace(F.element_at(F.split(path, r"\."), -1), "[_-]", ""))


def above(path: Column) -> Column:
    return F.when(path.contains("."), F.regexp_replace(path, r"\.[^.]*$", "")).otherwise("")


def changes(seen: DataFrame) -> DataFrame:
    """``file_id, change, old_field, new_field`` of each file against the one before.

    ``seen``: a written result of :func:`fields_seen`. Files without a
    readable line aren't there. Ties in ``exported_at`` go by file_id. A
    machine's first file has no row. A machine may have any number of files,
    and a file any number of lines, fields and values.
    """
    files = seen.filter("path is null").groupBy("file_id").agg(F.min("machine").alias("machine"), F.min("exported_at").alias("exported_at"))
    files = with_neighbours(files, "machine", ["exported_at", "file_id"], before={"file_id": "before"}, after={"file_id": "next"}).select("file_id", "before", "next")
    fields = seen.filter("path is not null").groupBy("file_id", "path").agg(F.bit_or("kinds").alias("kinds"))
    # A field counts as new for its own file and as old for the next one; both sides meet in one aggregation.
    sides = F.array(F.struct(F.when(F.col("before").isNotNull(), F.col("file_id")).alias("at"), F.lit(True).alias("is_new")), F.struct(F.col("next").alias("at"), F.lit(False).alias("is_new")))
    both = (
        fields.join(files, "file_id").select("path", "kinds", F.col("file_id").alias("src"), F.explode(sides).alias("x")).filter("x.at is not null")
        .groupBy(F.col("x.at").alias("file_id"), "path")
        .agg(F.max(F.when(F.col("x.is_new"), F.col("kinds"))).alias("new"), F.max(F.when(~F.col("x.is_new"), F.col("kinds"))).alias("old"), F.max("src").alias("src"))
    )
    # Read by every rule below, so written once.
    both = materialize(both.filter("new is null or old is null or new != old"))
    retyped = both.filter("new != old").select("file_id", F.lit("retyped").alias("change"), F.col("path").alias("old_field"), F.col("path").alias("new_field"))
    single = both.filter("new is null or old is null").select(
        "file_id", "path", F.col("new").isNotNull().alias("is_new"), F.coalesce("new", "old").alias("kinds"), "src", above(F.col("path")).alias("parent"), bare(F.col("path")).alias("bare"),
    )
    return retyped.unionByName(_paired(single, seen))


def _paired(single: DataFrame, seen: DataFrame) -> DataFrame:
    """Renames by equal bare names, then by equal value sets, in alphabetical order; the rest is removed or added."""

    def match(df: DataFrame, keys: list[str]) -> DataFrame:
        w = Window.partitionBy("file_id", "is_new", *keys).orderBy("path")
        kept = F.struct("path", "parent", "kinds", "src")
        ranked = df.withColumn("rank", F.row_number().over(w)).groupBy("file_id", *keys, "rank")
        return ranked.agg(F.max(F.when(F.col("is_new"), kept)).alias("n"), F.max(F.when(~F.col("is_new"), kept)).alias("o")).select("file_id", "n", "o")

    def met(df: DataFrame) -> DataFrame:
        return df.filter("n is not null and o is not null").select("file_id", F.lit("renamed").alias("change"), F.col("o.path").alias("old_field"), F.col("n.path").alias("new_field"))

    def alone(df: DataFrame) -> DataFrame:
        return df.filter("n is null or o is null").select("file_id", F.coalesce("n", "o").alias("x"), F.col("n").isNotNull().alias("is_new")).select("file_id", "is_new", "x.*")

    first = materialize(match(single, ["parent", "kinds", "bare"]))
    rest = alone(first)
    # Only strings that have a counterpart under the same parent can be a rename by value.
    of_string = F.col("kinds") == STRING
    two = rest.filter(of_string).groupBy("file_id", "parent").agg(F.max("is_new").alias("a"), F.max(~F.col("is_new")).alias("b")).filter("a and b").select("file_id", "parent")
    asked = rest.filter(of_string).join(two, ["file_id", "parent"])
    values = seen.filter("path is not null").join(asked.select(F.col("src").alias("file_id"), "path").distinct(), ["file_id", "path"]).select("file_id", "path", F.explode("strings").alias("h")).distinct()
    # A value set is compared by its size and two sums of hashes; in decimal, so without overflow.
    total = lambda c: F.sum(c.cast("decimal(20,0)"))
    sets = values.groupBy("file_id", "path").agg(F.concat_ws(":", F.count("*"), total(F.col("h")), total(F.xxhash64("h"))).alias("vals")).withColumnRenamed("file_id", "src")
    second = materialize(match(asked.join(sets, ["src", "path"]), ["parent", "vals"]))
    lone = alone(second).unionByName(rest.filter(~of_string).unionByName(rest.filter(of_string).join(two, ["file_id", "parent"], "left_anti").select(*rest.columns)))
    told = lone.select(
        "file_id", F.when(F.col("is_new"), "added").otherwise("removed").alias("change"),
        F.when(F.col("is_new"), "").otherwise(F.col("path")).alias("old_field"), F.when(F.col("is_new"), F.col("path")).otherwise("").alias("new_field"),
    )
    return met(first).unionByName(met(second)).unionByName(told)


def drift(lines: DataFrame, target: dict[str, str] | None = None, approved: dict[str, str] | None = None) -> DataFrame:
    """All changes between consecutive files of each machine (see :func:`changes`).

    ``lines``: file_id, machine, exported_at, raw; other columns are not
    read. Lines whose raw text is null, empty or no JSON object count for
    nothing; a null ``machine`` or ``file_id`` is left out.
    """
    return changes(materialize(fields_seen(lines.filter("file_id is not null and machine is not null"), target, approved)))
