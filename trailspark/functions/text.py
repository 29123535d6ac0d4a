"""Functions on prompts, tool calls and names, as Column -> Column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Phrases that leave a decision open.
VAGUE = ["etc", "or something", "or whatever", "somehow", "idk", "whatever works", "and so on", "stuff like that", "something like that", "you know what i mean", "or such"]
# Patterns of prompt features.
CORRECTION = r"(?i)^(no[,.\s!]|nope\b|wait[,.\s]|actually[,.\s]|not (that|this)\b|that'?s (not|wrong)|i (meant|said)\b|undo\b|revert\b|instead[,.\s]|wrong\b|stop[,.\s!])"
QUESTION = r"(?i)^(how|why|what|which|where|when|who|can|could|should|would|is|are|do|does|did|will)\b"
PATH = r"(?:^|[\s\"'`(=])(?:~?/[\w.@-]+(?:/[\w.@-]+)+|[\w.-]+/[\w.@-]+(?:/[\w.@-]+)+|[\w-]+\.(?:ts|tsx|js|jsx|mjs|py|rs|go|rb|java|kt|swift|md|json|jsonl|yaml|yml|toml|css|scss|html|sh|sql))\b"
CODE = r"`[^`]+`|\b[a-z][a-z0-9]*[A-Z]\w*\b|\b\w+_\w+\b|--[\w-]{2,}\b"
ENUMERATION = r"(?:^|\n)\s*(?:[-*•]|\d+[.)])\s+\S"
IMPERATIVE = r"(?i)^(add|fix|make|write|run|update|refactor|implement|create|remove|delete|rename|move|change|build|test|wire|extract|convert|use|set|show|analyze|scaffold|document|ship|deploy|investigate|check|verify)\b"
# Words left out of token sets.
STOP_WORDS = "the a an and or but if then else for to of in on at with without from into is are was were be been do does did can could should would will just also this that these those it its my our your we you i me etc".split()
# Intents in order of precedence.
INTENTS = [
    ("bugfix", r"(?i)\b(fix|bug|broken|fails?|failing|error|crash|regression|debug)\b"),
    ("refactor", r"(?i)\b(refactor|clean\s?up|simplify|restructure|rename|extract|reorganize|migrate)\b"),
    ("ops", r"(?i)\b(deploy|release|publish|ci\b|pipeline|docker|infra|server|dns|domain|monitor|backup|cron)\b"),
    ("learning", r"(?i)\b(learn|explain|teach|flashcards?|anki|tutorial|study)\b"),
    ("research", r"(?i)^(how|why|what|which|where|can|could|should|is|are|do|does)\b|\b(investigate|research|compare|evaluate|brainstorm|analy[sz]e|explore)\b"),
    ("feature", r"(?i)\b(add|implement|build|create|scaffold|support|new|write|make|ship|integrate)\b"),
]
# Format B tools that are no server's.
BUILTIN_TOOLS = ["exec", "shell", "local_shell", "apply_patch", "update_plan", "view_image", "web_search", "read_file", "list_dir"]
PATCH = "*** Begin Patch"


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def utf16_length(c: Column) -> Column:
    """Length in UTF-16 code units."""
    return (F.length(F.encode(c, "UTF-16LE")) / 2).cast("bigint")


def half_up(c: Column, digits: int = 0) -> Column:
    """Rounding of halves towards plus infinity."""
    k = 10.0**digits
    return F.floor(c * k + 0.5) / k


def preview(c: Column, most: int = 64) -> Column:
    t = trimmed(F.regexp_replace(c, r"\s+", " "))
    return F.when(F.length(t) > most, F.concat(F.substring(t, 1, most - 1), F.lit("…"))).otherwise(t)


def short_id(c: Column) -> Column:
    return F.substring(c, 1, 8)


def vague_count(c: Column) -> Column:
    """How often any vague phrase stands in the text; overlapping phrases each count."""
    low = F.lower(c)
    return sum((F.regexp_count(low, F.lit(r"\b" + p.replace(" ", r"\s+") + r"\b")) for p in VAGUE), F.lit(0)).cast("bigint")


def prompt_features(c: Column) -> dict[str, Column]:
    """Column expressions of a prompt's features; null text gives nulls."""
    t = trimmed(c)
    chars = utf16_length(t)
    vague = vague_count(t)
    path, code, enum = t.rlike(PATH), t.rlike(CODE), t.rlike(ENUMERATION)
    n = lambda cond, v: F.when(cond, v).otherwise(0.0)
    raw = 5 + n(path, 1.5) + n(code, 1.5) + n(enum, 1.0) + n(t.rlike(IMPERATIVE), 1.0) + n((chars >= 80) & (chars <= 2000), 1.0) - n(chars < 20, 2.0) - F.least(F.lit(3), vague)
    return {
        "chars": chars,
        "words": F.when(t == "", 0).otherwise(F.size(F.split(t, r"\s+"))).cast("bigint"),
        "is_question": t.rlike(r"\?\s*$") | t.rlike(QUESTION),
        "is_correction": t.rlike(CORRECTION),
        "has_path": path,
        "has_code": code,
        "has_enumeration": enum,
        "vague": vague,
        "specificity": F.greatest(F.lit(0.0), F.least(F.lit(10.0), half_up(raw, 1))),
    }


def token_set(c: Column) -> Column:
    """Distinct words of more than two ASCII letters or digits, without stop words."""
    words = F.split(F.regexp_replace(F.lower(c), r"[^a-z0-9\s]", " "), r"\s+")
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(STOP_WORDS)))


def jaccard(a: Column, b: Column) -> Column:
    """Shared part of two token sets; 0 if either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), both / (F.size(a) + F.size(b) - both)).otherwise(0.0)


def question_key(c: Column) -> Column:
    """First 12 hex digits of the hash of the sorted tokens."""
    return F.substring(F.sha2(F.array_join(F.array_sort(token_set(c)), " "), 256), 1, 12)


def kind_of(correction: Column, question: Column) -> Column:
    return F.when(correction, "correction").when(question, "question").otherwise("directive")


def intent(c: Column) -> Column:
    out = F.when(c.rlike(INTENTS[0][1]), INTENTS[0][0])
    for name, pattern in INTENTS[1:]:
        out = out.when(c.rlike(pattern), name)
    return F.when(c.isNotNull(), out.otherwise("other"))


def display_model(c: Column) -> Column:
    return F.regexp_replace(c, r"-20\d{6}(?=\s|$|\()", "")


def normal_model(c: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(c, r"\s*\(.*\)$", ""), r"-\d{8}$", ""))


def command_text(c: Column) -> Column:
    """The shell command in a tool call's input: its ``command`` member, or ``cmd`` as quoted text, text or list."""
    v = F.try_parse_json(c)
    obj = F.schema_of_variant(v).startswith("OBJECT")

    def member(name: str) -> Column:
        x = F.when(obj, F.try_variant_get(v, f"$.{name}", "variant"))
        kind = F.schema_of_variant(x)
        return F.when(kind == "STRING", F.try_variant_get(x, "$", "string")).when(kind.startswith("ARRAY"), F.array_join(F.try_variant_get(x, "$", "array<string>"), " "))

    quoted = F.regexp_extract(c, r"""["']?cmd["']?\s*:\s*"((?:[^"\\]|\\.)*)\"""", 1)
    return F.coalesce(member("command"), F.when(quoted != "", F.regexp_replace(quoted, r"\\(.)", "$1")), member("cmd"))


def _stripped(c: Column) -> Column:
    """A command without leading blanks and assignments."""
    return F.regexp_replace(c, r"^\s*(?:[A-Za-z_][A-Za-z0-9_]*=\S*\s+)+|^\s+", "")


def with_labels(calls: DataFrame, name: str = "name", raw: str = "input") -> DataFrame:
    """Adds ``command``, ``verb`` and ``label`` to tool calls.

    The verb is the first word of the command without assignments, wrapper
    shells (of any depth) and folders; the label is the name with
    ``:apply_patch`` or the verb. A command is unwrapped as often as it
    holds ``-c`` or ``-lc``.
    """
    df = calls.withColumn("command", command_text(F.col(raw))).withColumn("_c", _stripped(F.col("command")))

    def unwrapped(c: Column) -> Column:
        inner = F.regexp_replace(F.regexp_replace(c, r"^\S+\s+-l?c\s*", ""), r"^['\"]", "")
        return F.when(c.rlike(r"^(?:\S*/)?(?:bash|sh|zsh)\s+-l?c(?:\s|$)"), _stripped(inner)).otherwise(c)

    depth = F.size(F.split("_c", r"\s-l?c(?:\s|$)")) - 1
    df = df.withColumn("_c", F.when(depth > 0, F.aggregate(F.sequence(F.lit(1), depth), F.col("_c"), lambda c, _: unwrapped(c))).otherwise(F.col("_c")))
    df = df.withColumn("verb", F.nullif(F.regexp_extract(F.regexp_extract("_c", r"^(\S+)", 1), r"([^/]*)$", 1), F.lit("")))
    label = F.when(F.col(raw).contains(PATCH), F.concat(name, F.lit(":apply_patch"))).when(F.col("verb").isNotNull(), F.concat(name, F.lit(":"), "verb")).otherwise(F.col(name))
    return df.withColumn("label", F.coalesce(label, F.lit("(unknown)"))).drop("_c")


def server_a(name: Column) -> Column:
    """Server of a format A tool name ``mcp__server__tool``, else null."""
    s = F.regexp_extract(name, r"^mcp__(.+?)__", 1)
    return F.when(s != "", s)


def server_b(name: Column) -> Column:
    """Server of a format B tool name: what stands before ``__`` or else ``.``, unless the tool is built in."""
    return F.when(name.isin(BUILTIN_TOOLS), None).when(name.contains("__"), F.split_part(name, F.lit("__"), F.lit(1))).when(name.contains("."), F.split_part(name, F.lit("."), F.lit(1)))


def estimated_tokens(c: Column) -> Column:
    """A rough number of tokens: a quarter of the characters (UTF-16 units)."""
    return half_up(utf16_length(c) / 4).cast("bigint")


def local_hour(us: Column, zone: str = "UTC") -> Column:
    """The hour of a time in microseconds, in a zone."""
    return F.hour(F.from_utc_timestamp(F.timestamp_micros(us), zone))


def percent(part: Column, whole: Column) -> Column:
    """A share as whole percent, such as ``37%``; of nothing ``0%``."""
    return F.concat(F.when(whole > 0, half_up(part / whole * 100)).otherwise(0).cast("bigint").cast("string"), F.lit("%"))


def quota(c: Column) -> dict[str, Column]:
    """The percentages of a usage panel's text."""
    num = lambda x, p, g: F.regexp_extract(x, p, g).try_cast("bigint")
    rest = F.regexp_replace(c, r"Current week \(all models\)[^\n]*\n?", "")
    return {
        "session_pct": num(c, r"Current session:\s*(\d+)%\s*used", 1),
        "week_pct": num(c, r"Current week \(all models\):\s*(\d+)%\s*used", 1),
        "model_pct": num(rest, r"Current week \(([^)]+)\):\s*(\d+)%\s*used", 2),
        "model_name": F.nullif(F.regexp_extract(rest, r"Current week \(([^)]+)\):\s*(\d+)%\s*used", 1), F.lit("")),
    }


def duration(ms: Column) -> Column:
    """Milliseconds as ``12s``, ``3m 4s`` or ``1h 2m``; null as a dash."""
    s = F.floor(ms / 1000 + 0.5)
    return (
        F.when(ms.isNull(), "—")
        .when(s < 60, F.concat(s.cast("string"), F.lit("s")))
        .when(s < 3600, F.concat(F.floor(s / 60).cast("string"), F.lit("m "), (s % 60).cast("string"), F.lit("s")))
        .otherwise(F.concat(F.floor(s / 3600).cast("string"), F.lit("h "), F.floor((s % 3600) / 60).cast("string"), F.lit("m")))
    )
