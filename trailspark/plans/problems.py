"""Queries of the general problems: hierarchies (p2), nested records (p5), drifting schemas (p7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import drift, hierarchy, nested
from ..sources.testdata import table


def _tree(spark: SparkSession, folder: str, paths: bool) -> DataFrame:
    rows = table(spark, folder, "claude_records").select(
        F.lower("uuid").alias("uuid"), "line_no", F.lower("parentUuid").alias("parent"), "file_path"
    )
    return hierarchy.trees(rows, "uuid", "parent", ["file_path"], "line_no", paths)


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return _tree(spark, folder, False).select(F.col("id").alias("uuid"), F.col("root_id").alias("root_uuid"), "depth")


def p2_paths(spark: SparkSession, folder: str) -> DataFrame:
    """Path, depth, root and number of descendants of each record."""
    return _tree(spark, folder, True).select(
        F.col("id").alias("uuid"), F.col("root_id").alias("root_uuid"), "depth", F.concat_ws("/", "path").alias("path"), "descendants"
    )


def p2_descendants(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each record and each of its descendants."""
    return hierarchy.closure(_tree(spark, folder, True))


def _docs(spark: SparkSession, folder: str) -> DataFrame:
    """The nested values of both sources."""
    return nested.record_docs(table(spark, folder, "claude_records")).unionByName(nested.line_docs(table(spark, folder, "codex_lines")))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return nested.nodes(_docs(spark, folder)).select("src", "row_id", "path", "parent_path", "kind")


def p5_shapes(spark: SparkSession, folder: str) -> DataFrame:
    """The variants that the automaton accepts, with their members and number of nodes."""
    return nested.variants(_docs(spark, folder))


def p5_kinds(spark: SparkSession, folder: str) -> DataFrame:
    """How many nodes and different member lists each kind has."""
    return p5_shapes(spark, folder).groupBy("src", "kind").agg(F.sum("nodes").alias("nodes"))


def p5_tool_use(spark: SparkSession, folder: str) -> DataFrame:
    """The typed table of tool calls, linked to record and parent node."""
    return nested.variant_table(_docs(spark, folder), ["tool_use"], {"id": "string", "name": "string", "input.command": "string", "input.file_path": "string"}).drop("shape", "kind")


def p5_usage(spark: SparkSession, folder: str) -> DataFrame:
    """The typed table of token usage."""
    return nested.variant_table(_docs(spark, folder), ["usage"], {"input_tokens": "bigint", "output_tokens": "bigint", "cache_creation_input_tokens": "bigint", "cache_read_input_tokens": "bigint"}).drop("shape", "kind")


def p5_changes(spark: SparkSession, folder: str) -> DataFrame:
    """The typed table of changed files, hunks and lines of patches, each linked to the node it lies in."""
    return nested.variant_table(_docs(spark, folder), ["files", "hunks", "lines"], {"path": "string", "start": "bigint", "op": "string", "s": "string"}).drop("shape")


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return drift.drift(table(spark, folder, "raw_lines"))


def p7_table(spark: SparkSession, folder: str) -> DataFrame:
    """All lines in one table, approved fields promoted; of what stays rescued, how many fields."""
    got = drift.ingest(table(spark, folder, "raw_lines"), "raw", ["file_id", "line_no"], approved=drift.APPROVED)
    left = F.coalesce(F.size(F.json_object_keys("_rescued")), F.lit(0))
    return got.withColumns({"rescued": left, "promoted": F.coalesce(F.size(F.json_object_keys("_promoted")), F.lit(0))}).drop("_rescued", "_promoted").withColumnRenamed("_readable", "readable")


QUERIES = {f.__name__: f for f in (p2_found, p2_paths, p2_descendants, p5_found, p5_shapes, p5_kinds, p5_tool_use, p5_usage, p5_changes, p7_found, p7_table)}

_RECORDS = """rec AS (SELECT lower(uuid) AS uuid, nullif(lower(parentUuid), '') AS p FROM claude_records WHERE uuid IS NOT NULL
 QUALIFY row_number() OVER (PARTITION BY lower(uuid) ORDER BY line_no DESC) = 1),
link AS (SELECT r.uuid, q.uuid AS p FROM rec r LEFT JOIN rec q ON r.p = q.uuid)"""

SQL = {
    "p2_found": f"""WITH RECURSIVE {_RECORDS},
tree AS (SELECT uuid, uuid AS root_uuid, CAST(0 AS BIGINT) AS depth FROM link WHERE p IS NULL
 UNION ALL SELECT l.uuid, t.root_uuid, t.depth + 1 FROM link l JOIN tree t ON l.p = t.uuid)
SELECT l.uuid, coalesce(t.root_uuid, 'cycle') AS root_uuid, coalesce(t.depth, -1) AS depth FROM link l LEFT JOIN tree t USING (uuid)""",
    "p2_paths": f"""WITH RECURSIVE {_RECORDS},
tree AS (SELECT uuid, uuid AS root_uuid, CAST(0 AS BIGINT) AS depth, [uuid] AS path FROM link WHERE p IS NULL
 UNION ALL SELECT l.uuid, t.root_uuid, t.depth + 1, list_append(t.path, l.uuid) FROM link l JOIN tree t ON l.p = t.uuid),
n AS (SELECT a AS uuid, count(*) - 1 AS descendants FROM (SELECT unnest(path) AS a FROM tree) GROUP BY 1)
SELECT l.uuid, coalesce(t.root_uuid, 'cycle') AS root_uuid, coalesce(t.depth, -1) AS depth, coalesce(array_to_string(t.path, '/'), '') AS path, n.descendants
FROM link l LEFT JOIN tree t USING (uuid) LEFT JOIN n USING (uuid)""",
    "p2_descendants": f"""WITH RECURSIVE {_RECORDS},
good AS (SELECT uuid, p FROM link WHERE p IS NULL UNION ALL SELECT l.uuid, l.p FROM link l JOIN good g ON l.p = g.uuid),
up AS (SELECT p AS ancestor, uuid AS descendant, CAST(1 AS BIGINT) AS distance FROM good WHERE p IS NOT NULL
 UNION ALL SELECT l.p, u.descendant, u.distance + 1 FROM up u JOIN link l ON l.uuid = u.ancestor WHERE l.p IS NOT NULL)
SELECT ancestor, descendant, distance FROM up""",
    "p5_found": """WITH rec AS (SELECT lower(uuid) AS uuid, message.content AS doc, message.usage AS usage FROM claude_records WHERE uuid IS NOT NULL
 QUALIFY row_number() OVER (PARTITION BY lower(uuid) ORDER BY line_no DESC) = 1),
docs AS (SELECT 'claude' AS src, uuid AS row_id, doc FROM rec WHERE json_valid(doc)
 UNION ALL SELECT DISTINCT 'codex', CAST(line_id AS VARCHAR), payload FROM codex_lines WHERE json_valid(payload)),
tree AS (SELECT d.src, d.row_id, t.id, t.parent, t.key, t.type, t.value FROM docs d, json_tree(d.doc) t),
link AS (SELECT a.*, b.type AS up_type, a.key AS own FROM tree a LEFT JOIN tree b ON a.src = b.src AND a.row_id = b.row_id AND a.parent = b.id),
walk AS (SELECT src, row_id, id, type, value, '' AS path, '' AS at_node, 'content' AS near, false AS is_node FROM link WHERE parent IS NULL
 UNION ALL SELECT l.src, l.row_id, l.id, l.type, l.value, CASE WHEN w.path = '' THEN l.own ELSE w.path || '.' || l.own END,
  CASE WHEN w.is_node THEN w.path ELSE w.at_node END, CASE WHEN l.up_type = 'ARRAY' THEN w.near ELSE l.own END,
  l.type = 'OBJECT' AND l.up_type = 'ARRAY' FROM walk w JOIN link l ON l.src = w.src AND l.row_id = w.row_id AND l.parent = w.id)
SELECT src, row_id, path, at_node AS parent_path, CASE WHEN json_type(value, '$.type') = 'VARCHAR' THEN value ->> '$.type' ELSE near END AS kind FROM walk WHERE is_node
UNION ALL SELECT 'claude', uuid, 'usage', '', 'usage' FROM rec WHERE usage IS NOT NULL""",
}
SQL["p5_found"] = SQL["p5_found"].replace("WITH rec", "WITH RECURSIVE rec", 1)
_WALK, _, _NODES = SQL["p5_found"].partition("\nSELECT src, row_id, path, at_node")
_NODES = "node AS (SELECT src, row_id, path, at_node" + _NODES.replace("FROM walk", ", value FROM walk").replace("'', 'usage' FROM rec", "'', 'usage', NULL FROM rec") + ")"
_STR = "CASE WHEN json_type(value, '$.{0}') = 'VARCHAR' THEN value ->> '$.{0}' WHEN json_type(value, '$.{0}') <> 'NULL' THEN CAST(json_extract(value, '$.{0}') AS VARCHAR) END"
SQL["p5_kinds"] = _WALK + ",\n" + _NODES + "\nSELECT src, kind, count(*) AS nodes FROM node GROUP BY ALL"
SQL["p5_tool_use"] = _WALK + ",\n" + _NODES + f"""\nSELECT src, row_id, path, parent_path, {_STR.format('id')} AS id, {_STR.format('name')} AS name, {_STR.format('input.command')} AS input_command, {_STR.format('input.file_path')} AS input_file_path
FROM node WHERE kind = 'tool_use'"""
SQL["p5_changes"] = _WALK + ",\n" + _NODES + f"""\nSELECT src, row_id, path, parent_path, kind, {_STR.format('path')} AS path_, try_cast(value ->> '$.start' AS BIGINT) AS start, {_STR.format('op')} AS op, {_STR.format('s')} AS s
FROM node WHERE kind IN ('files', 'hunks', 'lines')"""
SQL["p5_usage"] = """SELECT 'claude' AS src, lower(uuid) AS row_id, 'usage' AS path, '' AS parent_path, message.usage.input_tokens AS input_tokens, message.usage.output_tokens AS output_tokens,
 message.usage.cache_creation_input_tokens AS cache_creation_input_tokens, message.usage.cache_read_input_tokens AS cache_read_input_tokens
FROM (SELECT * FROM claude_records WHERE uuid IS NOT NULL QUALIFY row_number() OVER (PARTITION BY lower(uuid) ORDER BY line_no DESC) = 1) WHERE message.usage IS NOT NULL"""
_BARE = "lower(regexp_replace(regexp_replace(path, '^.*\\.', ''), '[_-]', '', 'g'))"
SQL["p7_found"] = f"""WITH RECURSIVE ok AS (SELECT DISTINCT file_id, machine, exported_at, json(raw) AS o FROM raw_lines WHERE CASE WHEN json_valid(raw) THEN json_type(raw) END = 'OBJECT'),
w AS (SELECT file_id, k AS path, json_extract(o, '$."' || k || '"') AS v FROM (SELECT file_id, o, unnest(json_keys(o)) AS k FROM ok)
 UNION SELECT file_id, path || '.' || k, json_extract(v, '$."' || k || '"') FROM (SELECT file_id, path, v, unnest(json_keys(v)) AS k FROM w WHERE json_type(v) = 'OBJECT')),
f AS (SELECT file_id, path, string_agg(DISTINCT k, ',' ORDER BY k) AS kinds, string_agg(DISTINCT CAST(v AS VARCHAR), chr(10) ORDER BY CAST(v AS VARCHAR)) AS vals FROM
 (SELECT file_id, path, v, CASE json_type(v) WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'ARRAY' THEN 'array' WHEN 'OBJECT' THEN 'object' ELSE 'number' END AS k FROM w WHERE json_type(v) <> 'NULL') GROUP BY 1, 2),
p AS (SELECT file_id, before FROM (SELECT file_id, lag(file_id) OVER (PARTITION BY machine ORDER BY exported_at, file_id) AS before FROM (SELECT DISTINCT file_id, machine, exported_at FROM ok)) WHERE before IS NOT NULL),
n AS (SELECT p.file_id, f.path, f.kinds, f.vals FROM p JOIN f USING (file_id)), o AS (SELECT p.file_id, f.path, f.kinds, f.vals FROM p JOIN f ON f.file_id = p.before),
s AS (SELECT *, regexp_replace(CASE WHEN contains(path, '.') THEN path ELSE '.' END, '\\.[^.]*$', '') AS up, {_BARE} AS bare FROM (SELECT *, true AS is_new FROM n ANTI JOIN o USING (file_id, path) UNION ALL SELECT *, false FROM o ANTI JOIN n USING (file_id, path))),
r1 AS (SELECT *, row_number() OVER (PARTITION BY file_id, is_new, up, kinds, bare ORDER BY path) AS k FROM s),
m1 AS (SELECT a.file_id, a.path AS old_field, b.path AS new_field FROM r1 a JOIN r1 b ON NOT a.is_new AND b.is_new AND a.file_id = b.file_id AND a.up = b.up AND a.kinds = b.kinds AND a.bare = b.bare AND a.k = b.k),
s2 AS (SELECT s.* FROM s LEFT JOIN m1 ON m1.file_id = s.file_id AND s.path = CASE WHEN s.is_new THEN m1.new_field ELSE m1.old_field END WHERE m1.file_id IS NULL),
r2 AS (SELECT *, row_number() OVER (PARTITION BY file_id, is_new, up, kinds, vals ORDER BY path) AS k FROM s2 WHERE kinds = 'string'),
m2 AS (SELECT a.file_id, a.path AS old_field, b.path AS new_field FROM r2 a JOIN r2 b ON NOT a.is_new AND b.is_new AND a.file_id = b.file_id AND a.up = b.up AND a.vals = b.vals AND a.k = b.k),
m AS (SELECT * FROM m1 UNION ALL SELECT * FROM m2)
SELECT n.file_id, 'retyped' AS change, n.path AS old_field, n.path AS new_field FROM n JOIN o USING (file_id, path) WHERE n.kinds <> o.kinds
UNION ALL SELECT file_id, 'renamed', old_field, new_field FROM m
UNION ALL SELECT s.file_id, 'removed', path, '' FROM s LEFT JOIN m ON m.file_id = s.file_id AND m.old_field = s.path WHERE NOT is_new AND m.file_id IS NULL
UNION ALL SELECT s.file_id, 'added', '', path FROM s LEFT JOIN m ON m.file_id = s.file_id AND m.new_field = s.path WHERE is_new AND m.file_id IS NULL"""


def _typed(path: str, kind: str) -> str:
    """SQL for the value of a target path if it is of the column's type."""
    at = "$." + ".".join(f'"{p}"' for p in path.split("."))
    if kind == "string":
        return f"CASE WHEN json_type(o, '{at}') = 'VARCHAR' THEN o ->> '{at}' END"
    if kind == "boolean":
        return f"CASE WHEN json_type(o, '{at}') = 'BOOLEAN' THEN CAST(o ->> '{at}' AS BOOLEAN) END"
    return f"CASE WHEN json_type(o, '{at}') IN ('BIGINT', 'UBIGINT') THEN CAST(o ->> '{at}' AS BIGINT) END"


_COLUMNS = {p: (drift.column_of(p), k) for p, k in drift.TARGET.items()}
_FROM = {to: old for old, to in drift.APPROVED.items()}
_HELD = " + ".join(f"CAST({c} IS NOT NULL AS INT)" for c, _ in _COLUMNS.values())
SQL["p7_table"] = (
    "WITH RECURSIVE r AS (SELECT row_number() OVER () AS n, file_id, line_no, CASE WHEN json_valid(raw) AND json_type(raw) = 'OBJECT' THEN json(raw) END AS o FROM raw_lines),\n"
    + "t AS (SELECT n, file_id, line_no, o, o IS NOT NULL AS readable, " + ", ".join(f"{_typed(p, k)} AS {c}" for p, (c, k) in _COLUMNS.items()) + ", "
    + ", ".join(f"{_typed(_FROM[p], k)} AS old_{c}" for p, (c, k) in _COLUMNS.items() if p in _FROM) + " FROM r),\n"
    + """w AS (SELECT n, k AS path, json_extract(o, '$."' || k || '"') AS v FROM (SELECT n, o, unnest(json_keys(o)) AS k FROM r WHERE o IS NOT NULL)
 UNION ALL SELECT n, path || '.' || k, json_extract(v, '$."' || k || '"') FROM (SELECT n, path, v, unnest(json_keys(v)) AS k FROM w WHERE json_type(v) = 'OBJECT')),
m AS (SELECT n, count(*) AS members FROM w WHERE json_type(v) <> 'NULL' GROUP BY 1),
u AS (SELECT n, file_id, line_no, readable, """
    + ", ".join(f"coalesce({c}, old_{c}) AS {c}" if p in _FROM else c for p, (c, _) in _COLUMNS.items())
    + ", " + " + ".join(f"CAST({c} IS NULL AND old_{c} IS NOT NULL AS INT)" for p, (c, _) in _COLUMNS.items() if p in _FROM) + " AS promoted FROM t)\n"
    + f"SELECT u.* EXCLUDE (n), CAST(coalesce(members, 0) - ({_HELD}) AS INT) AS rescued FROM u LEFT JOIN m USING (n)"
)
