"""Queries that put every instruction rule, verifier and converter over whole tables, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.functions import checks as K
from loomwright.functions import latex as L
from loomwright.functions import verify as V
from loomwright.operators import decontam as D
from loomwright.sources.tables import table

# ---- SQL for the same words, blanks and sentences ---------------------------------------------------
_B = r"\s\x0b\x1c-\x1f\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_W = r"\p{L}\p{N}_"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{_B}]+|[{_B}]+$', '', 'g')"


def _words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '[{_B}]+'), lambda w: w <> '')"


def _tokens(x: str) -> str:
    return f"regexp_extract_all({x}, '[{_W}]+|[^{_W}{_B}]')"


def _sentences(x: str) -> str:
    return f"list_filter(list_transform(string_split(regexp_replace({x}, '([.!?])[\"”’'')\\]]*[{_B}]+', '\\1' || chr(1), 'g'), chr(1)), lambda q: {_strip('q')}), lambda q: q <> '')"


def _parts(x: str, divider: str) -> str:
    return f"regexp_split_to_array({x}, '{divider}')"


def _full_parts(x: str, divider: str, n: int) -> str:
    """Whether there are ``n`` parts, empty ones at the ends not counted and none within."""
    p = _parts(x, divider)
    return f"(len(list_filter({p}[2:-2], lambda q: {_strip('q')} = '')) = 0 AND len(list_filter({p}, lambda q: {_strip('q')} <> '')) = {n})"


def _count(x: str, pattern: str, flags: str = "") -> str:
    return f"len(regexp_extract_all({x}, '{pattern}', 0, '{flags}'))" if flags else f"len(regexp_extract_all({x}, '{pattern}'))"


def _all(items: str, condition: str) -> str:
    return f"(len(list_filter({items}, lambda x: NOT ({condition}))) = 0)"


_DIV = rf"[{_B}]?\*\*\*[{_B}]?"
_SCRIPTS = ("一-鿿", "぀-ヿ", "가-힣", "Ѐ-ӿ", "ऀ-ॿ", "؀-ۿ", "ก-๛")
_FOREIGN = "(" + " + ".join(_count("text", f"[{s}]") for s in _SCRIPTS) + ")"
_LETTERS = _count("text", r"\p{L}")
_LATIN = f"({_LETTERS} = 0 OR {_FOREIGN} * 2 < {_LETTERS})"
_E = "(length(lower(text)) - length(replace(lower(text), 'e', '')))"

#: Rule id, its arguments and the SQL that says the same.
INSTRUCTIONS: dict[str, tuple[dict, str]] = {
    "keywords:existence": ({"keywords": ["the", "table"]}, "regexp_matches(text, 'the', 'i') AND regexp_matches(text, 'table', 'i')"),
    "keywords:frequency": ({"keyword": "table", "frequency": 2, "relation": "at least"}, _count("text", "table", "i") + " >= 2"),
    "keywords:forbidden_words": ({"forbidden_words": ["filter", "note"]}, f"NOT regexp_matches(text, '(?i)(^|[^{_W}])(filter|note)($|[^{_W}])')"),
    "keywords:letter_frequency": ({"letter": "E", "let_frequency": 40, "let_relation": "less than"}, f"{_E} < 40"),
    "keywords:no_adjacent_consecutive": ({}, f"list_bool_and(list_prepend(true, list_transform(range(1, len({_words('text')})), lambda i: unicode(lower({_words('text')}[i + 1][1])) - unicode(lower({_words('text')}[i][1])) <> 1)))"),
    "keywords:word_once": ({"keyword": "label"}, _count("text", "label", "i") + " = 1"),
    "keywords:word_count_different_numbers": ({"keyword": "filter", "frequency": 2, "relation": "less than"}, _count("text", "filter", "i") + " < 2"),
    "keywords:exclude_word_harder": ({"keyword": "the"}, "NOT contains(text, ' the ')"),
    "keywords:palindrome": ({}, f"len(list_filter({_words('text')}, lambda w: list_reverse(regexp_extract_all(w, '(?s).')) = regexp_extract_all(w, '(?s).'))) > 0"),
    "keywords:keyword_specific_position": ({"keyword": "the", "n": 2, "m": 2}, f"coalesce({_tokens(_sentences('text') + '[2]')}[2] = 'the', false)"),
    "keywords:start_end": ({}, f"len({_tokens('text')}) > 1 AND lower({_tokens('text')}[1]) = lower({_tokens('text')}[-1])"),
    "language:response_language": ({"language": "zh"}, f"({_LETTERS} = 0 OR {_count('text', '[一-鿿]')} * 2 > {_LETTERS})"),
    "length_constraints:number_sentences": ({"num_sentences": 5, "relation": "at least"}, f"len({_sentences('text')}) >= 5"),
    "length_constraints:number_words": ({"num_words": 100, "relation": "at least"}, _count("text", f"[{_W}]+") + " >= 100"),
    "length_constraints:number_paragraphs": ({"num_paragraphs": 1}, _full_parts("text", _DIV, 1)),
    "length_constraints:nth_paragraph_first_word": (
        {"num_paragraphs": 2, "nth_paragraph": 1, "first_word": "User"},
        f"(len(list_filter(string_split(text, chr(10) || chr(10)), lambda q: {_strip('q')} <> '')) = 2 AND coalesce(lower(regexp_replace(ltrim({_words('string_split(text, chr(10) || chr(10))[1]')}[1], chr(39) || chr(34)), '[^{_W}].*', '')) = 'user', false))",
    ),
    "detectable_content:number_placeholders": ({"num_placeholders": 1}, _count("text", r"\[.*?\]") + " >= 1"),
    "detectable_content:postscript": ({"postscript_marker": "P.S."}, f"regexp_matches(lower(text), 'p\\.[{_B}]?s\\.')"),
    "detectable_format:number_bullet_lists": ({"num_bullets": 3}, f"{_count('text', f'(?m)^[{_B}]*[*][^*].*$')} + {_count('text', f'(?m)^[{_B}]*-.*$')} = 3"),
    "detectable_format:constrained_response": ({}, "(" + " OR ".join(f"contains(text, '{a}')" for a in K.FIXED_ANSWERS) + ")"),
    "detectable_format:number_highlighted_sections": ({"num_highlights": 1}, " + ".join(f"len(list_filter(regexp_extract_all(text, '{p}'), lambda q: {_strip(chr(116) + 'rim(q, ' + chr(39) + '*' + chr(39) + ')')} <> ''))" for p in (r"\*[^\n\*]*\*", r"\*\*[^\n\*]*\*\*")) + " >= 1"),
    "detectable_format:multiple_sections": ({"section_spliter": "step", "num_sections": 1}, _count("text", rf"[{_B}]?step[{_B}]?\p{{Nd}}+") + " >= 1"),
    "detectable_format:json_format": ({}, f"json_valid({_strip('regexp_replace(' + _strip('text') + ', ' + chr(39) + '^```(?:json|Json|JSON)?|```$' + chr(39) + ', ' + chr(39) * 2 + ', ' + chr(39) + 'g' + chr(39) + ')')})"),
    "detectable_format:title": ({}, f"len(list_filter(regexp_extract_all(text, '<<[^\\n]+>>'), lambda q: {_strip('rtrim(ltrim(q, ' + chr(39) + '<' + chr(39) + '), ' + chr(39) + '>' + chr(39) + ')')} <> '')) > 0"),
    "detectable_format:sentence_hyphens": (
        {}, f"list_bool_and(list_prepend(true, list_transform(range(1, least(len(string_split(text, '-')), len({_sentences('replace(text, ' + chr(39) + '-' + chr(39) + ', ' + chr(39) + ' ' + chr(39) + ')')})) + 1), lambda i: string_split(text, '-')[i] = {_sentences('replace(text, ' + chr(39) + '-' + chr(39) + ', ' + chr(39) + ' ' + chr(39) + ')')}[i])))"),
    "detectable_format:square_brackets": ({}, _all(_words("text"), "starts_with(x, '[') AND ends_with(x, ']')")),
    "detectable_format:bigram_wrapping": ({}, f"list_bool_and(list_prepend(true, list_transform(range(1, len({_words('text')}) // 2 + 1), lambda i: starts_with({_words('text')}[2 * i - 1], '<<') AND ends_with({_words('text')}[2 * i], '>>'))))"),
    "combination:two_responses": ({}, f"({_full_parts('text', r'[*]{6}', 2)})"),
    "startend:end_checker": ({"end_phrase": " Lighter."}, f"ends_with(lower(trim({_strip('text')}, '\"')), 'lighter.')"),
    "startend:quotation": ({}, f"length({_strip('text')}) > 1 AND starts_with({_strip('text')}, '\"') AND ends_with({_strip('text')}, '\"')"),
    "change_case:capital_word_frequency": ({"capital_frequency": 2, "capital_relation": "at least"}, f"len(list_filter({_tokens('text')}, lambda x: upper(x) = x AND lower(x) <> x)) >= 2"),
    "change_case:english_capital": ({}, f"upper(text) = text AND lower(text) <> text AND {_LATIN}"),
    "change_case:english_lowercase": ({}, f"lower(text) = text AND upper(text) <> text AND {_LATIN}"),
    "punctuation:no_comma": ({}, "NOT contains(text, ',')"),
    "punctuation:punctuation_dot": ({}, "NOT contains(text, '.')"),
    "punctuation:punctuation_exclamation": ({}, "NOT contains(text, '!')"),
    "paragraphs:paragraphs": ({}, _full_parts("text", _DIV, 2)),
    "paragraphs:paragraphs2": ({}, _full_parts("text", r"\n\n", 2)),
    "first_word:first_word_sent": ({"first_word": "The"}, _all(_sentences("text"), f"lower({_words('x')}[1]) = 'the'")),
    "first_word:first_word_answer": ({"first_word": "user:"}, f"coalesce(lower({_words('text')}[1]) = 'user:', false)"),
    "last_word:last_word_sent": ({"last_word": "lighter"}, _all(_sentences("text"), f"lower(regexp_replace({_words('x')}[-1], '[^{_W}]', '', 'g')) = 'lighter'")),
    "last_word:last_word_answer": ({"last_word": "lighter"}, f"coalesce(lower(regexp_replace({_words('text')}[-1], '[^{_W}]', '', 'g')) = 'lighter', false)"),
    "count:lowercase_counting": ({"N": 50}, f"len(list_filter(regexp_extract_all(text, '[{_W}]+'), lambda x: regexp_full_match(x, '[a-z]+'))) <= 50"),
    "count:count_unique": ({}, f"len({_tokens('text')}) = len(list_distinct({_tokens('text')}))"),
    "count:count_increment_word": ({"keyword1": "label", "keyword2": "the"}, f"{_count('text', 'label', 'i')} = 1 AND {_count('text', 'the', 'i')} = 2"),
    "letters:letter_counting": ({"N": 300, "relation": "at least"}, _count("text", "[a-zA-Z]") + " >= 300"),
    "letters:letter_counting2": ({"letter": "e", "let_frequency": 40, "let_relation": "at least"}, f"{_E} >= 40"),
}


def _given(x: str) -> str:
    """What a verifier reads of an answer: behind the thinking, without answer tags."""
    return _strip(f"replace(replace(string_split({x}, '</think>')[-1], '<answer>', ''), '</answer>', '')")


_TWICE = _given("(answer || '******' || text)")
COPIES: dict[str, tuple[str, str, str]] = {
    "copy:copy": ("answer", _given("answer"), f"lower({_given('answer')}) = lower({_strip('text')})"),
    "copy:copying_simple": ("answer", _given("answer"), f"lower({_given('answer')}) = lower({_strip('text')})"),
    "copy:copying_multiple": ("twice", _TWICE, f"len(string_split({_TWICE}, '******')) = 2 AND " + _all(f"string_split({_TWICE}, '******')", f"lower({_strip('x')}) = lower({_strip('text')})")),
    "new:copy_span_idx": ("span", _given("left(answer, 20)"), f"lower({_given('left(answer, 20)')}) = lower({_strip('left(text, 20)')})"),
    "combination:repeat_prompt": ("answer", _given("answer"), f"starts_with(lower({_given('answer')}), lower({_strip('text')}))"),
}
OLDER: dict[str, tuple[dict, str]] = {
    "verify_keywords": ({"keyword_list": ["The", "table"]}, "contains(lower(text), 'the') AND contains(lower(text), 'table')"),
    "verify_keyword_frequency": ({"word": "The", "N": 2}, f"len(list_filter(regexp_extract_all(lower(text), '[{_W}]+'), lambda x: x = 'the')) = 2"),
    "validate_forbidden_words": ({"forbidden_words": ["Filter"]}, "NOT contains(lower(text), 'filter')"),
    "verify_letter_frequency": ({"letter": "b", "N": 3}, "length(text) - length(replace(text, 'b', '')) = 3"),
    "validate_response_language": ({"language": "ru"}, f"({_LETTERS} = 0 OR {_count('text', '[Ѐ-ӿ]')} * 2 > {_LETTERS})"),
    "verify_paragraph_count": ({"N": 1}, "NOT contains(text, '* * *') AND " + _strip("text") + " <> ''"),
    "validate_word_constraint": ({"N": 60, "quantifier": "around"}, f"abs(len({_words('text')}) - 60) <= 6"),
    "validate_paragraphs": ({"N": 2, "first_word": "User", "i": 1}, f"len(string_split(text, chr(10) || chr(10))) = 2 AND starts_with({_strip('string_split(text, chr(10) || chr(10))[1]')}, 'User')"),
    "verify_postscript": ({"postscript_marker": "Tools"}, f"contains(text, 'Tools') AND length({_strip('substr(text, instr(text, ' + chr(39) + 'Tools' + chr(39) + '))')}) > 5"),
    "validate_placeholders": ({"N": 1}, _count("text", r"\[(.*?)\]") + " >= 1"),
    "verify_bullet_points": ({"N": 2}, f"len(list_filter(string_split(text, chr(10)), lambda q: starts_with({_strip('q')}, '*') OR starts_with({_strip('q')}, '-'))) = 2"),
    "validate_title": ({}, "regexp_matches(text, '<<(.*?)>>')"),
    "validate_highlighted_sections": ({"N": 1}, _count("text", r"\*(.*?)\*") + " >= 1"),
    "validate_sections": ({"N": 2, "section_splitter": "User"}, f"len(string_split(text, 'User')) - CASE WHEN {_strip('string_split(text, ' + chr(39) + 'User' + chr(39) + ')[1]')} = '' THEN 1 ELSE 0 END = 2"),
    "validate_repeat_prompt": ({"original_prompt": "User"}, "starts_with(text, 'User')"),
    "validate_two_responses": ({}, f"len(string_split(text, '******')) = 2 AND {_strip('string_split(text, ' + chr(39) + '******' + chr(39) + ')[1]')} <> {_strip('string_split(text, ' + chr(39) + '******' + chr(39) + ')[2]')}"),
    "validate_uppercase": ({}, "upper(text) = text"),
    "validate_lowercase": ({}, "lower(text) = text"),
    "validate_frequency_capital_words": ({"N": 2, "quantifier": "at least"}, f"len(list_filter(regexp_extract_all(text, '[{_W}]+'), lambda x: regexp_full_match(x, '[A-Z]+'))) >= 2"),
    "validate_end": ({"end_phrase": "."}, "ends_with(text, '.')"),
    "validate_quotation": ({}, "starts_with(text, '\"') AND ends_with(text, '\"')"),
    "validate_no_commas": ({}, "NOT contains(text, ',')"),
}


def _name(rule: str) -> str:
    return rule.replace(":", "__")


def if_rules(spark: SparkSession, d: str) -> DataFrame:
    """Every instruction rule over every document, through the rules themselves."""
    return table(spark, d, "documents").select("doc_id", *K.rule_columns("text", {_name(k): (k, a) for k, (a, _) in INSTRUCTIONS.items()}))


def if_older_rules(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", *K.rule_columns("text", {k: (k, a) for k, (a, _) in OLDER.items()}, older_set=True))


_ANSWER = "CASE WHEN doc_id % 3 = 0 THEN '  ' || upper(text) || ' ' WHEN doc_id % 3 = 1 THEN text || 'x' ELSE text END"


def if_copies(spark: SparkSession, d: str) -> DataFrame:
    """Rules whose argument is the prompt, by way of the verifier and its labels: every text beside a changed copy."""
    t = table(spark, d, "documents").where("text <> ''").selectExpr("doc_id", "text", f"{_ANSWER} AS answer")
    t = t.withColumns({"twice": F.concat("answer", F.lit("******"), "text"), "span": F.substring("answer", 1, 20)})

    def label(rule: str):
        kwargs = {"copy:copying_multiple": [("N", F.lit(2))], "new:copy_span_idx": [("n_start", F.lit(0)), ("n_end", F.lit(20))]}.get(rule, [])
        args = F.struct(F.col("text").alias("prompt_to_repeat"), *(v.alias(k) for k, v in kwargs))
        return F.to_json(F.array(F.struct(F.array(F.lit(rule)).alias("instruction_id"), F.array(args).alias("kwargs"))))

    return t.select("doc_id", *(V.score_column(F.lit("ifeval"), F.col(a), label(k)).alias(_name(k)) for k, (a, *_) in COPIES.items()))


# ---- Verifiers -----------------------------------------------------------------------------------------
def verifier_scores(spark: SparkSession, d: str) -> DataFrame:
    """Rule verifiers of name, prediction and label over derived answers of every part."""
    p = table(spark, d, "part").select("p_partkey", F.col("p_name").alias("n"), (F.col("p_partkey") % 4).alias("k"), "p_size")
    wrong = F.when(F.col("k") == 0, F.upper("n")).when(F.col("k") == 1, F.concat("n", F.lit(" extra"))).when(F.col("k") == 2, F.lit("other")).otherwise(F.concat(F.lit("The "), "n", F.lit("!")))
    finish = F.concat(F.lit("<think>so</think> <finish> "), wrong, F.lit(" </finish>"))
    labels = F.to_json(F.array("n", F.lit("nothing")))
    stated = F.concat(F.lit("So x = 3. Final Answer: The final answer is $"), F.col("p_size").cast("string"), F.lit(",000$. I hope it is correct."))
    boxed = F.concat(F.lit("Thus \\boxed{"), F.col("p_size").cast("string"), F.lit("} or so"))
    score = lambda name, a, b: V.score_column(F.lit(name), a, b).alias(name)
    thousands = F.when(F.col("k") == 0, F.col("p_size") * 1000).otherwise(F.col("p_size")).cast("string")
    return p.select(
        "p_partkey", score("re_search", finish, labels), F.round(V.score_column(F.lit("re_search_f1"), finish, labels), 6).alias("re_search_f1"), F.round(V.score_column(F.lit("string_f1"), F.concat(F.lit("a</think>"), wrong), F.col("n")), 6).alias("string_f1"),
        score("strict_math", stated, thousands), score("math", boxed, thousands), score("flan", F.concat(F.lit("The answer is: "), wrong), F.col("n")), score("string_matcher", F.concat(F.lit("<answer>"), wrong, F.lit("</answer>")), F.col("n")),
        score("puzzle", F.concat(F.lit("<think>x</think>"), wrong), F.col("n")), score("gsm8k", F.concat(F.lit("It is 12,"), F.lpad(F.col("p_size").cast("string"), 3, "0")), F.concat(F.lit("12"), F.lpad(F.col("p_size").cast("string"), 3, "0"), F.when(F.col("k") == 0, F.lit("0")).otherwise(F.lit("")))),
    )


def final_forms(spark: SparkSession, d: str) -> DataFrame:
    """Final answers in several spellings, made from the sizes of the parts, as expressions."""
    n = F.col("p_size").cast("string")
    forms = {
        "thousands": F.concat(F.lit("x = $"), n, F.lit(",000$")), "fraction": F.concat(F.lit("\\frac"), F.substring(n, 1, 1), F.lit("7")), "root": F.concat(F.lit("\\sqrt"), F.substring(n, 1, 1)),
        "units": F.concat(n, F.lit(" \\text{ square} inches")), "boxed": F.concat(F.lit("\\boxed{"), n, F.lit("}")), "text": F.concat(F.lit("\\text{"), "p_brand", F.lit("}")), "pair": F.concat(n, F.lit(", y")),
    }
    return table(spark, d, "part").select("p_partkey", *(L.final_form_column(c).alias(k) for k, c in forms.items()))


def decontam_fields(spark: SparkSession, d: str) -> DataFrame:
    """Items of two phrases, the first and the last six words of a text: both must stand in the same document."""
    w = F.expr("filter(split(lower(text), '[ ,.?!:;()\"\\\\-\\\\n\\\\\\\\]+'), x -> x <> '')")
    items = table(spark, d, "benchmark").where("text is not null").withColumn("w", w).where(F.size("w") >= 12)
    items = items.select("item_id", F.array_join(F.slice("w", 1, 6), " ").alias("head"), F.array_join(F.slice("w", -6, 6), " ").alias("tail"))
    return D.phrase_matches(table(spark, d, "documents"), items, "doc_id", "item_id", fields=["head", "tail"])


_TOK = r"""list_filter(regexp_split_to_array(lower(text), '[ ,.?!:;()"\-\n\\]+'), lambda x: x <> '')"""
_WRONG = "CASE p_partkey % 4 WHEN 0 THEN upper(p_name) WHEN 1 THEN p_name || ' extra' WHEN 2 THEN 'other' ELSE 'The ' || p_name || '!' END"
# Names of parts are plain words without articles, so of a changed one k = 0 and 3 are equal after normalising.
_SAME = "CAST(p_partkey % 4 IN (0, 3) AS DOUBLE)"
_WORDS = "len(string_split(p_name, ' '))"
_F1 = f"CASE p_partkey % 4 WHEN 1 THEN 2.0 * {_WORDS} / (2 * {_WORDS} + 1) WHEN 2 THEN 0 ELSE 1 END"

QUERIES = {
    "if_rules": (if_rules, "SELECT doc_id, " + ", ".join(f"({sql}) AS {_name(k)}" for k, (_, sql) in INSTRUCTIONS.items()) + " FROM documents"),
    "if_older_rules": (if_older_rules, "SELECT doc_id, " + ", ".join(f"({sql}) AS {k}" for k, (_, sql) in OLDER.items()) + " FROM documents"),
    "if_copies": (if_copies, f"WITH t AS (SELECT doc_id, text, {_ANSWER} AS answer FROM documents WHERE text <> '') SELECT doc_id, " + ", ".join(f"CASE WHEN {x} = '' THEN 0.0 WHEN {sql} THEN 1.0 ELSE 0.0 END AS {_name(k)}" for k, (_, x, sql) in COPIES.items()) + " FROM t"),
    "verifier_scores": (
        verifier_scores,
        f"SELECT p_partkey, {_SAME} AS re_search, round(CASE WHEN p_partkey % 4 = 2 THEN 0.1 ELSE {_F1} END, 6) AS re_search_f1, round({_F1}, 6) AS string_f1, CAST(p_partkey % 4 = 0 AS DOUBLE) AS strict_math, CAST(p_partkey % 4 <> 0 OR p_size = 0 AS DOUBLE) AS math, "
        f"{_SAME} AS flan, {_SAME} AS string_matcher, {_SAME} AS puzzle, CAST(p_partkey % 4 <> 0 AS DOUBLE) AS gsm8k FROM part",
    ),
    "final_forms": (
        final_forms,
        r"SELECT p_partkey, p_size || '000' AS thousands, '\frac{' || left(CAST(p_size AS VARCHAR), 1) || '}{7}' AS fraction, '\sqrt{' || left(CAST(p_size AS VARCHAR), 1) || '}' AS root, CAST(p_size AS VARCHAR) AS units, CAST(p_size AS VARCHAR) AS boxed, p_brand AS text, p_size || ',y' AS pair FROM part",
    ),
    "decontam_fields": (
        decontam_fields,
        f"WITH i AS (SELECT item_id, {_TOK} AS w FROM benchmark WHERE text IS NOT NULL AND len({_TOK}) >= 12), t AS (SELECT doc_id, ' ' || array_to_string({_TOK}, ' ') || ' ' AS s FROM documents) "
        "SELECT DISTINCT doc_id, item_id FROM t, i WHERE contains(s, ' ' || array_to_string(w[1:6], ' ') || ' ') AND contains(s, ' ' || array_to_string(w[-6:], ' ') || ' ')",
    ),
}
