import random

from trailspark.llm import leaks as k


def distance(p, t):
    prev = [0] * (len(t) + 1)
    for i, x in enumerate(p, 1):
        cur = [i]
        for j, y in enumerate(t, 1):
            cur.append(min(prev[j - 1] + (x != y), prev[j] + 1, cur[-1] + 1))
        prev = cur
    return min(prev)


def test_myers_equals_the_table():
    rng = random.Random(3)
    for _ in range(300):
        p = [rng.choice("abcd") for _ in range(rng.randrange(1, 70))]
        t = [rng.choice("abcd") for _ in range(rng.randrange(0, 90))]
        assert k.myers(p, t) == distance(p, t)


ITEM = "Every velvet barrel near valve rotates exactly 262 crooked wedge. Suppose drawer rubam drains cord dibir while ivory funnel stays loose."
SHARED = "You are working in an empty repository and may create as many files as you need."


def changed(words, rng, edits):
    w = list(words)
    for at in rng.sample(range(1, len(w) - 1), edits):
        w[at] = rng.choice([w[at] + " extra", "changed", ""])
    return " ".join(x for x in w if x)


def test_forms_edits_and_what_does_not_count(spark):
    rng = random.Random(5)
    w = ITEM.split()
    docs = [
        (1, "Before. " + ITEM + " After."), (2, ITEM.upper()), (3, "> " + "\n> ".join([" ".join(w[i : i + 4]) for i in range(0, len(w), 4)])), (4, "\n".join(f"{i}. {' '.join(w[i * 5 : i * 5 + 5])}" for i in range(5))), (5, "_".join(w).replace(".", "")),
        (6, ITEM.replace("barrel", "bar​rel").replace(" ", " ")), (7, '{"t":"' + ITEM.replace(" ", "\\n") + '"}'), (8, "<b>" + ITEM.replace("wedge", "<i>wed&shy;ge</i>")), (9, changed(w[:12], rng, 2)), (10, changed(w, rng, 3)),
        (11, "".join(x.capitalize() for x in w)), (12, ITEM.replace("rotates", "rota tes").replace("drawer", "draw-\ner")),
        (50, " ".join(w[:7])), (51, SHARED), (52, None), (53, ""), (54, "  "), (55, "nothing to see " * 20_000), (56, " ".join(sorted(w))), (57, changed(w[:12], random.Random(1), 6)), (1, "Before. " + ITEM),
    ]
    items = [(7, SHARED + " " + ITEM, None), (8, "Other words stand here to be no match at all for anything else today. " + SHARED, ""), (None, ITEM, None), (7, SHARED + " " + ITEM, None)]
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'clash' as item", "'clash' as item_id", "1 as doc")
    i = spark.createDataFrame(items, "item_id long, prompt string, answer string").selectExpr("*", "'clash' as doc_id", "1 as part")
    got = k.leaks(d, "doc_id", "text", i, "item_id", ["prompt", "answer"]).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(n, 7) for n in range(1, 13)]


def test_words_of_any_length_and_tags_of_any_length():
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(4, 30))) for _ in range(60)]
    item = " ".join(words)
    ix = k.Index([(1, item)])
    long_tag = f'<a href="x" style="{"color: red; " * 40}">'
    forms = {
        "one word of many letters": "".join(words),
        "unknown letters glued to both ends": "zzqz" + "".join(words[:14]) + "qzzq",
        "words of over 24 letters, split": " ".join(w[:3] + " " + w[3:] for w in words),
        "long tags inside": f" {long_tag}".join([" ".join(words[:5]), " ".join(words[5:9]), " ".join(words[9:14])]),
        "what only looks like a tag": "if a <b " + " ".join(words[:13]) + " > c",
        "escaped twice": "\\\\n".join(words[:14]),
        "entity of a tag": "&lt;b&gt;".join([" ".join(words[:6]), " ".join(words[6:13])]),
        "after half a million letters": "x y " * 200_000 + " ".join(words[:12]),
        "long word put in": " ".join(words[:6] + ["w" * 300] + words[6:13]),
    }
    for name, text in forms.items():
        assert ix.search(text) == {1}, name
    assert ix.search(" ".join(words[:9]) + " and then " + " ".join(words[30:38])) == set()


def test_finds_what_the_definition_says():
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(400)]
    item = [rng.choice(words) for _ in range(40)]
    ix = k.Index([(1, " ".join(item))])
    hits = 0
    for _ in range(300):
        a = rng.randrange(0, 20)
        w = item[a : a + rng.randrange(10, 20)]
        for _ in range(rng.randrange(0, 5)):
            at = rng.randrange(len(w))
            w[at : at + 1] = rng.choice([[], ["other"], [w[at], "more"]])
        text = ["some", "words", "before", *w, "and", "after", "it"]
        want = any(distance(item[s : s + m], text) <= m // 6 for m in (12, 18) for s in range(len(item) - m + 1))
        hits += want
        assert (ix.search(" ".join(text)) == {1}) == want
    assert 50 < hits < 290


def test_blocks_of_items_give_the_same(spark, monkeypatch):
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(300)]
    items = [(n, " ".join(rng.choice(words) for _ in range(30)) + ". " + SHARED) for n in range(20)]
    docs = [(n, "x " + " ".join(t.split()[5:20])) for n, t in items] + [(99, SHARED)]
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, prompt string")
    want = {(n, n) for n in range(20)}
    for size in (10**9, 1000):
        monkeypatch.setattr(k, "ITEM_BYTES", size)
        assert {tuple(r) for r in k.leaks(d, "doc_id", "text", i, "item_id", ["prompt"]).collect()} == want


def test_nothing(spark):
    d, i = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, prompt string")
    assert k.leaks(d, "doc_id", "text", i, "item_id", ["prompt"]).count() == 0
