import random

from trailspark.llm import subjects as s

WORDS = {"law": ["tort", "affidavit", "court docket", "plaintiff"], "music": ["choir", "vinyl record", "drum loop", "melody"], "sport": ["hat trick", "pole vault", "peloton", "referee"]}
SENTENCES = ["There is a wrong total under the {}.", "Rename the field so that it says {} instead of item.", "Let the search find a {} at once.", "My notes on the {}: keep them."]
NEUTRAL = ["Please answer briefly.", "Run it again and show me the output.", "That is a good match for what I asked.", "All 9 checks are green now."]


def make(rng, n, wrong=0.0):
    docs = []
    for _ in range(n):
        areas = rng.sample(list(WORDS), rng.choice([0, 1, 1, 2]))
        lines = [rng.choice(NEUTRAL) for _ in range(rng.randrange(1, 4))]
        for a in areas:
            lines += [rng.choice(SENTENCES).format(rng.choice(WORDS[a])) for _ in range(3)]
        rng.shuffle(lines)
        labels = set(areas)
        if rng.random() < wrong:
            labels = {rng.choice(list(WORDS))}
        docs.append((" ".join(lines), labels, set(areas)))
    return docs


def test_held_out_accuracy_with_wrong_labels():
    rng = random.Random(1)
    m = s.train([s.Labelled(t, {a: 1.0 for a in lab} or {"none": 1.0}) for t, lab, _ in make(rng, 400, wrong=0.1)], sorted(WORDS))
    test = make(rng, 200)
    right = sum(set(m.areas_of(t)) == truth for t, _, truth in test)
    assert right >= 0.95 * len(test)
    odd = "THERE IS A WRONG TOTAL UNDER THE poleVaultForm.\nRename the field so that it says hat trikc instead of item.\n"
    assert m.areas_of(odd) == ["sport"]
    five = " ".join(SENTENCES[0].format("tort") for _ in range(4)) + " " + SENTENCES[1].format("choir")
    assert m.areas_of(five) == ["law"]  # one sentence in five is under the share


def test_rows_of_any_kind(spark):
    rng = random.Random(2)
    docs = make(rng, 60)
    df = spark.createDataFrame([(i, t) for i, (t, *_) in enumerate(docs)] + [(900, None), (901, ""), (902, " \n"), (903, "42"), (904, SENTENCES[0].format("tort") * 3000), (904, "x")], "doc_id long, text string").selectExpr("*", "'clash' as subject", "1 as key")
    labels = spark.createDataFrame([(i, a.upper() + " ", "x") for i, (_, lab, _) in enumerate(docs) for a in (lab or {"none"})] * 2 + [(None, "law", "x"), (1, None, None)], "doc_id long, subject string, annotator string")
    sample = s.labelled_sample(df, labels)
    assert len(sample) == 60 and all(v <= 1 for x in sample for v in x.labels.values())
    got = s.assign(df, "doc_id", "text", s.train(sample, sorted(WORDS))).collect()
    assert len(got) == len({tuple(r) for r in got}) and {r.doc_id for r in got} & {900, 901, 902, 903} == set() and any(r.doc_id == 904 for r in got)
    assert s.assign(df, "doc_id", "text", s.train([], sorted(WORDS))).count() == 0
    assert s.assign(df.filter("false"), "doc_id", "text", s.train(sample, sorted(WORDS))).count() == 0
    assert s.train(sample, []).areas_of("tort") == []


def test_no_sentence_is_left_out():
    text = "if the plaintiff (see docket 4) appeals, the court hears it.\nreturn of the jury: the verdict (guilty) stands.\nconst entry = route(23);\n42\n"
    assert len(s.sentences(text)) == 3
    rng = random.Random(4)
    docs = make(rng, 300)
    coded = [(t + f"\nconst {(w := rng.choice(['entry', 'parser', 'layout']))} = route({i});\nif {w} != view: raise ValueError('{w}')", lab) for i, (t, lab, _) in enumerate(docs)]
    m = s.train([s.Labelled(t, {a: 1.0 for a in lab} or {"none": 1.0}) for t, lab in coded], sorted(WORDS))
    assert m.areas_of("const entry = route(7);\nif parser != view: raise ValueError('parser')") == []
    assert m.areas_of("if the plaintiff (see the court docket) comes, then the court docket is there.\nThere is a wrong total under the tort.") == ["law"]


def test_what_the_metadata_stands_for():
    docs = [s.Labelled("x", {"law": 1.0} if i % 10 else {"music": 1.0}, {"source": "court", "kind": None}) for i in range(40)] + [s.Labelled("x", {"law": 1.0}, {"source": "few"})] * 3
    assert s.metadata_labels(docs, ["law", "music"]) == {("source", "court"): {"law": 0.9}}
