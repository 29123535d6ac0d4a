"""Queries of the problems on agent logs and training text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.times import micros, week_key
from ..operators import records as rec
from ..plans.sqlparts import TEXT, TIME
from ..sources.testdata import table
from . import conversations as conv
from . import leaks
from . import nearest as near
from . import secrets
from . import sequences as seq
from . import subjects, tokens

#: Microseconds.
TOLERANCE, TICK = 20_000_000, 5_000_000


def weekly_patterns(spark: SparkSession, folder: str) -> DataFrame:
    calls = table(spark, folder, "tool_calls").select("id", "session_id", "call_pos", F.lower(rec.trim_all(F.col("name"))).alias("name"), micros(F.col("timestamp")).alias("us"))
    once = calls.filter("id is null").unionByName(rec.latest(calls.filter("id is not null"), "id", "call_pos").select(*calls.columns))
    good = once.filter("name != '' and us is not null").select(F.col("session_id").alias("seq_id"), "us", F.col("call_pos").alias("pos"), "id", "name")
    weeks = seq.sequences(good).withColumn("week_start", week_key(F.col("us")))
    return seq.frequent(weeks, "week_start")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return weekly_patterns(spark, folder).select("week_start", F.concat_ws(">", "sequence").alias("sequence"))


def p1_support(spark: SparkSession, folder: str) -> DataFrame:
    """The patterns with their support."""
    return weekly_patterns(spark, folder).select("week_start", F.concat_ws(">", "sequence").alias("sequence"), "support")


def prompt_rows(spark: SparkSession, folder: str) -> DataFrame:
    """``uuid, entity, t``: the latest version of each record that is a prompt row with session and readable time."""
    # Only user rows can be prompts, so only their content is parsed.
    rows = rec.classified(table(spark, folder, "claude_records"), F.when(F.col("type") == "user", F.col("message.content"))).select(
        F.lower("uuid").alias("uuid"), "line_no", rec.session_of().alias("entity"), micros(F.col("timestamp")).alias("t"), F.col("row_class").isin("prompt", "command").alias("is_prompt"),
    )
    return rec.latest(rows).filter("is_prompt and entity is not null and t is not null").select("uuid", "entity", "t")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "git_trace").filter("event = 'UserPromptSubmit' and head != ''").select(F.col("session_id").alias("entity"), micros(F.col("ts")).alias("t"), F.col("event_id").alias("rid"))
    return near.nearest(prompt_rows(spark, folder), events, TOLERANCE, TICK).select("uuid", F.col("rid").alias("event_id"))


def message_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Message rows of ``claude_records`` as input of :func:`conversations`.

    What the text decides is worked out before the rows are shuffled, the
    hashes of its words included, so no text travels.
    """
    no = lambda c: ~F.coalesce(F.col(c), F.lit(False))
    role = F.lower(rec.trim_all(F.col("message.role")))
    us = micros(F.col("timestamp"))
    can = F.when(F.col("row_class").isin("prompt", "command"), "user").when((F.col("type") == "assistant") & (rec.trim_all(F.col("text")) != ""), "assistant")
    rows = rec.classified(table(spark, folder, "claude_records")).withColumn("_role", can).select(
        F.lower("uuid").alias("id"), "line_no",
        (F.coalesce(F.col("type").isin("user", "assistant"), F.lit(False)) & no("isSidechain") & no("isMeta") & no("isCompactSummary")).alias("is_message"),
        rec.session_of().alias("channel"), us.alias("us"),
        F.col("_role").alias("role"), F.when(F.col("_role").isNotNull(), conv.words_of(F.col("text"))).alias("words"), F.lower("parentUuid").alias("parent"),
        (us.isNull() | ~F.col("json_ok") | F.coalesce(role != F.col("type"), F.lit(False))).alias("broken"),
    )
    return rec.latest(rows, "id").filter("is_message and channel is not null").drop("is_message")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    # Here order alone fixes an answer's turn: the latest is its only candidate, and mention and words couldn't outweigh it.
    got = conv.conversations(message_rows(spark, folder).drop("words", "parent"), reach=1)
    return got.select(F.col("channel").alias("session_id"), "turn", "role", F.col("id").alias("uuid"))


def p3_links(spark: SparkSession, folder: str) -> DataFrame:
    """The likeliest parent turn of each answer row, by time, mention and overlap."""
    rows = message_rows(spark, folder).filter("role is not null and us is not null").withColumn("is_user", F.col("role") == "user")
    got = conv.reply_links(conv.numbered(rows), conv.INTERLEAVED)
    return got.select(F.col("channel").alias("session_id"), F.col("id").alias("uuid"), "parent_id", F.round("score", 6).alias("score"))


def p6_places(spark: SparkSession, folder: str) -> DataFrame:
    """Every credential with its key and its place in bytes."""
    calls = secrets.scan(table(spark, folder, "tool_calls"), "id", ["input", "outputPreview"])
    return calls.unionByName(secrets.scan(table(spark, folder, "steps"), "id", ["promptText"])).distinct()


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return p6_places(spark, folder).select("row_id", "field", "secret").distinct()


def p6_redacted(spark: SparkSession, folder: str) -> DataFrame:
    """All three fields with their credentials replaced."""
    parts = [(table(spark, folder, "tool_calls"), ["input", "outputPreview"]), (table(spark, folder, "steps"), ["promptText"])]
    out = [secrets.redacted(t.select("id", *fields), fields).select(F.col("id").alias("row_id"), F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in fields])).alias("x")).select("row_id", "x.*") for t, fields in parts]
    return out[0].unionByName(out[1])


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.encode(table(spark, folder, "documents"), "doc_id", "text")


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return leaks.leaks(table(spark, folder, "documents"), "doc_id", "text", table(spark, folder, "eval_items"), "item_id", ["prompt", "answer"])


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    # The table of areas is a fixed list of a few rows.
    areas = table(spark, folder, "subject_areas").select("subject", F.concat_ws(". ", "title", "description").alias("about")).filter("subject is not null").orderBy("subject").collect()
    sample = subjects.labelled_sample(docs, table(spark, folder, "subject_labels"))
    model = subjects.train(sample, [r.subject for r in areas], {r.subject: r.about for r in areas})
    return subjects.assign(docs, "doc_id", "text", model)


def p10_composition(spark: SparkSession, folder: str) -> DataFrame:
    """How many documents and characters each area has."""
    found = p10_found(spark, folder).join(table(spark, folder, "documents").select("doc_id", F.length("text").alias("n")), "doc_id")
    return found.groupBy("subject").agg(F.count("*").alias("documents"), F.sum("n").alias("chars"))


QUERIES = {f.__name__: f for f in (p1_found, p1_support, p3_found, p3_links, p4_found, p6_found, p6_places, p6_redacted, p8_ids, p9_found, p10_found, p10_composition)}

_T, _TS, _TEXT = TIME.format(c="timestamp"), TIME.format(c="ts"), TEXT
_REC = f"""rec AS (SELECT lower(uuid) AS uuid, line_no, type, coalesce(sessionId, session_id) AS session_id, {_T} AS t, coalesce(isSidechain, false) OR coalesce(isMeta, false) OR coalesce(isCompactSummary, false) AS aside,
 coalesce(json_valid(message.content), false) AS ok, message.role AS role, {_TEXT} AS text, CASE WHEN json_valid(message.content) AND json_type(message.content) = 'ARRAY' THEN len(list_filter(CAST(json(message.content) AS JSON[]), lambda b: (b ->> '$.type') = 'tool_result')) > 0 ELSE false END AS result
 FROM claude_records WHERE uuid IS NOT NULL QUALIFY row_number() OVER (PARTITION BY lower(uuid) ORDER BY line_no DESC) = 1),
cls AS (SELECT *, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS tx FROM rec),
msg AS (SELECT *, type = 'user' AND NOT aside AND NOT result AND tx <> '' AND NOT starts_with(tx, '[Request interrupted') AND (regexp_matches(tx, '<command-name>\\s*([^<\\n]+?)\\s*</command-name>') OR
 NOT starts_with(tx, '<local-command-stdout>') AND NOT regexp_matches(tx, '^<(system-reminder|task-notification|background-task|tool-reminder)\\b')) AS is_prompt FROM cls)"""

_SEQ = f"""WITH once AS (SELECT session_id, call_pos, lower(trim(name)) AS name, {_T} AS t FROM (SELECT DISTINCT ON (id) * FROM tool_calls)),
good AS (SELECT * FROM once WHERE name <> '' AND t IS NOT NULL AND session_id IS NOT NULL),
wk AS (SELECT session_id, strftime(date_trunc('week', make_timestamp(min(t))), '%Y-%m-%d') AS week_start FROM good GROUP BY 1),
c AS (SELECT wk.week_start, g.session_id, g.name, row_number() OVER (PARTITION BY g.session_id ORDER BY g.t, g.call_pos) AS o FROM good g JOIN wk USING (session_id)),
tot AS (SELECT week_start, count(*) AS total FROM wk GROUP BY 1),
p1 AS (SELECT week_start, session_id, [name] AS s, min(o) AS o FROM c GROUP BY ALL),
"""
_GROW = """p{k} AS (SELECT c.week_start, c.session_id, list_append(p.s, c.name) AS s, min(c.o) AS o FROM p{j} p JOIN c ON p.session_id = c.session_id AND c.o > p.o AND NOT list_contains(p.s, c.name)
 JOIN f{j} f ON f.week_start = p.week_start AND f.s = p.s GROUP BY ALL),
"""
_FREQ = "f{k} AS (SELECT q.week_start, q.s, q.support FROM (SELECT week_start, s, count(*) AS support FROM p{k} GROUP BY ALL) q JOIN tot USING (week_start) WHERE q.support >= 3 AND q.support * 5 >= tot.total),\n"
_ALL = _SEQ + _FREQ.format(k=1) + "".join(_GROW.format(k=k, j=k - 1) + _FREQ.format(k=k) for k in range(2, 6)) + "a AS (SELECT * FROM f3 UNION ALL SELECT * FROM f4 UNION ALL SELECT * FROM f5)\n"

SQL = {
    "p1_found": _ALL + "SELECT week_start, array_to_string(s, '>') AS sequence FROM a",
    "p1_support": _ALL + "SELECT week_start, array_to_string(s, '>') AS sequence, support FROM a",
    "p4_found": f"""WITH {_REC}, ev AS (SELECT DISTINCT event_id, session_id, {_TS} AS t FROM git_trace WHERE event = 'UserPromptSubmit' AND head <> '')
SELECT m.uuid, e.event_id FROM msg m JOIN ev e ON m.session_id = e.session_id AND abs(m.t - e.t) <= 20000000 WHERE m.is_prompt
QUALIFY row_number() OVER (PARTITION BY m.uuid ORDER BY abs(m.t - e.t), e.event_id) = 1""",
    "p3_found": f"""WITH {_REC}, m AS (SELECT *, CASE WHEN is_prompt THEN 'user' WHEN type = 'assistant' AND tx <> '' THEN 'assistant' END AS r,
 t IS NULL OR NOT ok OR coalesce(lower(trim(role)) <> type, false) AS broken FROM msg WHERE type IN ('user', 'assistant') AND NOT aside AND session_id IS NOT NULL),
good AS (SELECT session_id FROM m GROUP BY 1 HAVING NOT bool_or(broken)),
talk AS (SELECT session_id, uuid, r, t, line_no, lag(r) OVER w AS p, lead(r) OVER w AS n FROM m JOIN good USING (session_id) WHERE r IS NOT NULL WINDOW w AS (PARTITION BY session_id ORDER BY t, line_no, uuid)),
sound AS (SELECT session_id FROM talk GROUP BY 1 HAVING NOT bool_or((r = 'assistant' AND p IS NULL) OR (r = 'user' AND coalesce(n, 'user') = 'user')))
SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY t, line_no, uuid) - 1 AS turn, r AS role, uuid FROM talk JOIN sound USING (session_id) WHERE r = 'user' OR p = 'user'""",
    "p3_links": f"""WITH {_REC.replace("message.role AS role,", "message.role AS role, lower(parentUuid) AS parent,")}, m AS (SELECT *, CASE WHEN is_prompt THEN 'user' WHEN type = 'assistant' AND tx <> '' THEN 'assistant' END AS r FROM msg WHERE type IN ('user', 'assistant') AND NOT aside AND session_id IS NOT NULL AND t IS NOT NULL),
n AS (SELECT session_id, uuid, r, parent, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda w: length(w) > 2)) AS words, sum(CAST(r = 'user' AS INT)) OVER (PARTITION BY session_id ORDER BY t, line_no, uuid) AS o FROM m WHERE r IS NOT NULL),
u AS (SELECT session_id, uuid, words, o FROM n WHERE r = 'user'), s AS (SELECT * FROM n WHERE r <> 'user'),
p AS (SELECT s.session_id, s.uuid, u.uuid AS parent_id, u.o, 0.25 / (s.o - u.o + 1) + CASE WHEN s.parent = u.uuid THEN 2.0 ELSE 0.0 END + len(list_intersect(s.words, u.words)) / greatest(len(s.words), 1) AS score
 FROM s JOIN u ON s.session_id = u.session_id AND u.o <= s.o AND (u.o > s.o - 3 OR u.uuid = s.parent))
SELECT s.session_id, s.uuid, b.parent_id, round(b.score, 6) AS score FROM s LEFT JOIN (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY uuid ORDER BY score DESC, o DESC) = 1) b USING (uuid)""",
}
