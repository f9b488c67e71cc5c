import pytest
from pyspark.sql import functions as F

from loomwright.llm import pairs as P
from loomwright.llm.languages import language
from loomwright.llm.truncation import has_content, shape_verdict, truncated


@pytest.mark.parametrize("text,lang", [("The cat is on the mat.", "en"), ("Die Katze ist auf dem Tisch.", "de"), ("Le chat est sur la table.", "fr"), ("El gato está en la mesa.", "es"), ("猫在桌子上。", "zh"), ("猫は机の上にいます。", "ja"), ("고양이가 있습니다.", "ko"), ("Кошка на столе.", "ru"), ("बिल्ली मेज पर है।", "hi"), ("القطة على الطاولة.", "ar"), ("แมวอยู่บนโต๊ะ", "th"), ("42!", "")])
def test_language(text, lang):
    assert language(text) == lang


def test_asked_language():
    assert P.asked_language("Explain the mat. Please answer in German.") == "de"
    assert P.asked_language("Réponds en anglais.") == "en"
    assert P.asked_language("Which German cities are large?") == ""


def test_a_request_for_a_language_anywhere_in_a_long_sentence():
    long = "With the lantern, the ladder and all of the other things that were left in the shed before winter, answer in German, and do not forget the ribbons, the crates and the labels that the gardener left there."
    assert P.asked_language(long) == "de"
    assert P.asked_language("Translate from English into French, then answer in Spanish.") == "es"


def test_copies():
    p = "Explain how a kettle works to a patient student in ten minutes."
    assert P.copies_prompt(p, "You asked: " + p)
    assert P.copies_prompt(p, p.upper())
    assert not P.copies_prompt(p, "You asked: " + p + " It heats water until the water boils and then it stops.")
    assert not P.copies_prompt(p, "")


def test_content_and_shapes():
    assert not has_content("**Assistant:**\n") and not has_content("<|end|>") and not has_content(None) and has_content("x")
    assert shape_verdict("Text.\n```python\nx = 1") == "cut"
    assert shape_verdict("Text.\n```python\nx = 1\n```\n") == "whole"
    assert shape_verdict("848") == "whole" and shape_verdict("Long text here.\n\n— Anna") == "whole"


def test_truncated_and_defects(spark):
    good = "The kettle is on the table. It heats the water after lunch."
    rows = [(f"p{i}", "m", "Explain how the kettle works.", good + f" That takes {i} minutes.") for i in range(300)]
    rows += [("cut", "m", "Explain how the kettle works.", "The kettle is on the table. It heats the wat"), ("cut", "m", "Explain how the kettle works.", "The kettle is on the table. It heats the wat")]
    asked = ["What is the lantern for?", "Compare a ribbon and a wooden ladder.", "How long does bread keep in winter?", "Name three rivers of the north.", "Who wrote the oldest letter here?"]
    rows += [(f"r{i}", "m", p, "I'm sorry, but I can't help with that request. I hope you understand.") for i, p in enumerate(asked)]
    rows += [("lone", "m", "Where does the train go?", "We must decline to name a destination."), ("hedge", "m", "Where does the train go?", "I can't help with that request. " + good + " Then it goes to the coast by noon.")]
    rows += [("e1", "m", "Why is this?", None), ("e2", "m", None, "Assistant:"), ("w", "m", "Why is this so for the kettle?", "Das ist so, weil der Kessel auf dem Tisch steht. Und er ist heiß."), ("c", "m", "Why is the kettle so hot after lunch?", "Why is the kettle so hot after lunch?"), ("n", None, None, good + " That takes 7 minutes.")]
    df = spark.createDataFrame(rows, "prompt_hash string, model string, prompt string, answer string")
    df = df.withColumns({c: F.lit(1) for c in ("lang", "verdict", "lo", "ctx", "template", "rest", "n", "x", "cut")})  # names that the operators use
    got = {(r["prompt_hash"], r["defect"]) for r in P.defects(df).collect()}
    assert got == {("cut", "truncated"), ("e1", "empty"), ("e2", "empty"), ("w", "wrong_language"), ("c", "copies_prompt")} | {(f"r{i}", "refusal") for i in range(5)}
    cut = {r["prompt_hash"]: r["cut"] for r in truncated(df, ["prompt_hash", "model"], "answer").collect()}
    assert cut["cut"] and not cut["p7"] and "e1" not in cut and "e2" not in cut
    assert P.defects(df.limit(0)).count() == 0
    assert truncated(df.limit(0), ["prompt_hash"], "answer").count() == 0


@pytest.mark.parametrize("prompt,lang", [("Write about a Chinese garden in spring.", ""), ("Tell me about the French revolution and write a summary.", ""), ("Explique en anglais.", "en"), ("Bitte auf Englisch antworten.", "en"), ("用英语回答。", "en"), ("Use Chinese for the answer.", "zh"), ("Translate into Russian: The cat.", "ru"), ("Ответь по-английски.", "en")])
def test_requests_for_a_language(prompt, lang):
    assert P.asked_language(prompt) == lang


def test_copies_of_a_cut_text_are_no_evidence(spark):
    good, cut = "The kettle is on the table. It heats the water after lunch.", "The kettle is on the table.\nIt heats the wat"
    rows = [(f"p{i}", good + f" That takes {i} minutes.") for i in range(300)] + [(f"c{i}", cut) for i in range(50)]
    rows += [(f"d{i}", cut.replace("\n", "\r\n") + "\n" * i) for i in range(20)]
    got = {r["k"] for r in truncated(spark.createDataFrame(rows, "k string, t string"), ["k"], "t").where("cut").collect()}
    assert got == {f"c{i}" for i in range(50)} | {f"d{i}" for i in range(20)}


PROMPTS = ["What is the lantern for?", "Compare a ribbon and a wooden ladder.", "How long does bread keep in winter?", "Name three rivers of the north.", "Who wrote the oldest letter here?", "Draw up a plan for the orchard.", "Why do pendulums slow down?", "List six uses of vinegar."]


def refused(spark, rows):
    d = spark.createDataFrame(rows, "prompt_hash string, prompt string, answer string").selectExpr("prompt_hash", "'m' AS model", "prompt", "answer")
    return {r["prompt_hash"] for r in P.defects(d).where("defect = 'refusal'").collect()}


def test_a_template_must_recur_over_unrelated_prompts(spark):
    other = [(f"o{i}", p, f"It is the number {i}, as the third table shows.") for i, p in enumerate(PROMPTS)]
    text = "Regrettably, I cannot go into this."
    assert refused(spark, other + [("a", PROMPTS[0], text)]) == set()  # alone
    assert refused(spark, other + [(f"a{i}", f"What is the brass lantern of house {i} for?", text) for i in range(6)]) == set()  # one topic
    assert refused(spark, other + [(f"a{i}", p, text) for i, p in enumerate(PROMPTS)]) == {f"a{i}" for i in range(len(PROMPTS))}


def test_a_template_off_the_list_is_named_by_its_company(spark):
    close = " Perhaps you could raise another matter with me."
    known = [(f"k{i}", p, "I cannot go into this." + close) for i, p in enumerate(PROMPTS * 2)]
    unknown = [(f"u{i}", p, "That topic stays closed with me." + close) for i, p in enumerate(PROMPTS[5:])]
    stock = [(f"s{i}", p, "The answer is B.") for i, p in enumerate(PROMPTS)]
    assert not P.DECLINE.search(unknown[0][2])
    assert refused(spark, known + unknown + stock) == {r[0] for r in known + unknown}
    assert refused(spark, unknown + stock) == set()


def test_slots():
    p = P.Prompt("Explain the phases of the moon and a raised garden bed.")
    assert P.masked(p, "I can't write about the phases of the moon") == ({"i can t write about _", "i can t write about the phases of the moon"}, 10)
    assert "_ is a subject" in P.masked(p, "a raised garden bed is a subject")[0]
    assert "_ is a subject i have to leave" in P.masked(p, "la lettre de motivation is a subject I have to leave")[0]
    assert "i can t write about _" in P.masked(p, "but I can't write about 望远镜支架")[0]


def test_template_clusters_against_brute_force(spark):
    import random

    rng = random.Random(4)
    words = [f"w{i}" for i in range(30)]
    base = [[rng.choice(words) for _ in range(rng.choice([6, 60, 90]))] for _ in range(60)]
    texts = {" ".join(b) for b in base}
    for b in base:
        for _ in range(4):
            c = list(b)
            c[rng.randrange(len(c))] = rng.choice(words)
            texts.add(" ".join(c))
    texts |= {"one two three four five " + " ".join(rng.choice(words) for _ in range(4)) for _ in range(300)}  # alike at the start only
    texts = sorted(texts)

    def shingles(t):
        w = ["<"] * 4 + t.split() + [">"] * 4
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    got = {r["template"]: r["cluster"] for r in P.template_clusters(spark.createDataFrame([(t,) for t in texts], "template string")).collect()}
    assert set(got) == set(texts)
    sets = [shingles(t) for t in texts]
    near = [(texts[i], texts[j]) for i in range(len(texts)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    assert len(near) > 50 and sum(got[a] == got[b] for a, b in near) >= 0.95 * len(near)
    alone = {t for t, s in zip(texts, sets)} - {x for p in near for x in p}
    assert all(got[t] == t for t in alone)
