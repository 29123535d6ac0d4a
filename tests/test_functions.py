from pyspark.sql import functions as F

from trailspark.functions import text as tx
from trailspark.functions.times import micros, week_key


def one(spark, c, value):
    return spark.createDataFrame([(value,)], "x string").select(c(F.col("x")).alias("y")).first().y


def test_times(spark):
    base = 1_780_275_600_000_000
    for t in ("2026-06-01T01:00:00Z", "2026-06-01T03:00:00.000+02:00", "2026-06-01T03:00:00+0200", "2026-05-31T20:00:00.000000-05", "1780275600000", "2026-06-01T01:00:00", "2026-06-01 01:00Z"):
        assert one(spark, micros, t) == base, t
    for t in (None, "", "n/a", "Invalid Date", "0000-00-00T00:00:00Z", "2026-13-01T00:00:00Z", "2026-06-01", "12", "20260601"):
        assert one(spark, micros, t) is None, t
    assert one(spark, lambda c: week_key(micros(c)), "2026-06-07T23:59:59.999Z") == "2026-06-01"
    assert one(spark, lambda c: week_key(micros(c)), "1969-12-28T23:59:59Z") == "1969-12-22"


def test_prompt_features(spark):
    f = tx.prompt_features(F.col("x"))

    def get(v, name):
        return spark.createDataFrame([(v,)], "x string").select(f[name].alias("y")).first().y

    assert get("no, use src/a/b.ts instead", "is_correction") and get("no, use src/a/b.ts", "has_path")
    assert get("How does it work", "is_question") and get("is it ok?", "is_question")
    assert get("do whatever works or whatever, etc", "vague") == 3
    assert get("a😀", "chars") == 3 and get(None, "chars") is None
    assert get("fix `x`", "specificity") == 5.5 and get("", "specificity") == 3.0


def test_commands_and_labels(spark):
    shapes = [("Bash", '{"command":"A=1 B=2 /usr/bin/git status"}', "git", "Bash:git"), ("shell", '{"command":["bash","-lc","ls -la"]}', "ls", "shell:ls"), ("exec", 'tools.exec({cmd:"sh -c \'npm test\'"})', "npm", "exec:npm"), ("Edit", '{"file_path":"x"}', None, "Edit"), ("patch", "*** Begin Patch\n", None, "patch:apply_patch"), ("Bash", None, None, "Bash"), (None, "{", None, "(unknown)"), ("Bash", '{"command":"bash -lc \\"zsh -c \'X=1 make all\'\\""}', "make", "Bash:make")]
    got = tx.with_labels(spark.createDataFrame([(i, n, s) for i, (n, s, *_) in enumerate(shapes)], "i int, name string, input string")).orderBy("i").collect()
    assert [(r.verb, r.label) for r in got] == [(v, lab) for *_, v, lab in shapes]


def test_names_numbers_and_panels(spark):
    assert one(spark, tx.display_model, "m-4-20250101 (low)") == "m-4 (low)" and one(spark, tx.normal_model, "M-4-20250101") == "m-4"
    assert one(spark, tx.server_a, "mcp__a_b__c") == "a_b" and one(spark, tx.server_b, "x__y") == "x" and one(spark, tx.server_b, "exec") is None
    assert one(spark, lambda c: tx.preview(c, 5), " ab\n cdef ") == "ab c…"
    assert one(spark, lambda c: tx.duration(c.cast("long")), "3725000") == "1h 2m" and one(spark, lambda c: tx.duration(c.cast("long")), None) == "—"
    q = tx.quota(F.col("x"))
    text = "Current session: 19% used\nCurrent week (all models): 20% used\nCurrent week (Big): 33% used"
    assert tuple(spark.createDataFrame([(text,)], "x string").select(*q.values()).first()) == (19, 20, 33, "Big")
    assert one(spark, tx.question_key, "Fix the parser") == one(spark, tx.question_key, "parser: FIX!")
