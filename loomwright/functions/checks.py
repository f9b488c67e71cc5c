"""Checks of instructions on the form of an answer.

``REGISTRY`` holds one rule per instruction id, ``OLDER`` the rules of the older set by name.
Arguments are required: nothing is filled in by chance.  Words are runs of word characters or
single marks; sentences end at a mark followed by a blank.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwright.functions.text import col

# ---- Fixed values -------------------------------------------------------------------------
LESS = "less than"
FIXED_ANSWERS = ("My answer is yes.", "My answer is no.", "My answer is maybe.")
DIVIDER = r"\s?\*\*\*\s?"
POSTSCRIPTS = {"P.P.S": r"\s*p\.\s?p\.\s?s.*$", "P.S.": r"\s*p\.\s?s\..*$"}
# -------------------------------------------------------------------------------------------


def tokens(s: str) -> list[str]:
    return re.findall(r"\w+|[^\w\s]", s)


def sentence_list(s: str) -> list[str]:
    return [x.strip() for x in re.split(r"(?<=[.!?])[\"”’')\]]*\s+", s) if x.strip()]


def compared(n: int, wanted: int, relation: str) -> bool:
    return n < wanted if relation == LESS else n >= wanted


def parts_between(s: str, divider: str) -> list[str] | None:
    """Parts between dividers, empty ones only at the ends; None when one inside is empty."""
    parts = re.split(divider, s)
    if any(not p.strip() for p in parts[1:-1]):
        return None
    return [p for p in parts if p.strip()]


def _count(s: str, word: str) -> int:
    return len(re.findall(word, s, re.I))


def _json(s: str) -> bool:
    s = re.sub(r"^```(?:json|Json|JSON)?|```$", "", s.strip()).strip()
    try:
        json.loads(s)
        return True
    except ValueError:
        return False


def _language(s: str, code: str) -> bool:
    letters = {"zh": r"[一-鿿]", "ja": r"[぀-ヿ]", "ko": r"[가-힣]", "ru": r"[Ѐ-ӿ]", "hi": r"[ऀ-ॿ]", "ar": r"[؀-ۿ]", "th": r"[ก-๛]"}
    found = {k: len(re.findall(p, s)) for k, p in letters.items()}
    total = sum(c.isalpha() for c in s)
    if not total:
        return True
    if code in letters:
        return found[code] * 2 > total or (code == "ja" and found["ja"] > 0)
    return sum(found.values()) * 2 < total


def _nth_paragraph(s: str, num_paragraphs: int, nth_paragraph: int, first_word: str) -> bool:
    parts = re.split(r"\n\n", s)
    if sum(bool(p.strip()) for p in parts) != num_paragraphs or nth_paragraph > len(parts):
        return False
    p = parts[nth_paragraph - 1].strip()
    return bool(p) and re.sub(r"[^\w].*", "", p.split()[0].lstrip("'\"")).lower() == first_word.lower()


def _phrases(s: str, phrase: str, small_n: int) -> bool:
    ref = phrase.split()
    found = re.findall(rf"{re.escape(ref[0])} .*? {re.escape(ref[-1])}", s)
    if len(found) != small_n:
        return False
    gaps = [sum(a != b for a, b in zip(f.split(), ref)) if len(f.split()) == len(ref) else 99 for f in found]
    return all(g <= 1 for g in gaps) and bool(gaps) and gaps[-1] == 1


def _composition(s: str, n_sent: int, n_words: int) -> bool:
    parts = parts_between(s, DIVIDER)
    return parts is not None and len(parts) == 3 and all(len(x := sentence_list(p)) == n_sent and all(len(tokens(y)) == n_words for y in x) for p in parts)


def _last(word: str) -> str:
    return re.sub(r"[^\w\s]", "", word).lower()


def _hyphens(s: str) -> bool:
    """Sentences joined by hyphens, with no blanks around them."""
    got, want = s.split("-"), sentence_list(s.replace("-", " "))
    return all(a.strip() == a and a == b for a, b in zip(got, want))


def _neighbours(s: str) -> bool:
    first = [w[0].lower() for w in s.split()]
    return all(len(a) == len(b) == 1 and ord(b) - ord(a) != 1 for a, b in zip(first, first[1:]))


def _same(a: str, b: str) -> bool:
    return a.strip().lower() == b.strip().lower()


def _capitals(s: str, capital_frequency: int, capital_relation: str) -> bool:
    return compared(sum(w.isupper() for w in tokens(s)), capital_frequency, capital_relation)


Check = Callable[..., bool]
REGISTRY: dict[str, Check] = {
    "keywords:existence": lambda s, keywords: all(re.search(k, s, re.I) for k in keywords),
    "keywords:frequency": lambda s, keyword, frequency, relation: compared(_count(s, keyword), frequency, relation),
    "keywords:forbidden_words": lambda s, forbidden_words: not any(re.search(rf"\b{w}\b", s, re.I) for w in forbidden_words),
    "keywords:letter_frequency": lambda s, letter, let_frequency, let_relation: compared(s.lower().count(letter.lower()), let_frequency, let_relation),
    "keywords:no_adjacent_consecutive": _neighbours,
    "keywords:word_once": lambda s, keyword: _count(s, keyword) == 1,
    "keywords:word_count_different_numbers": lambda s, keyword, frequency, relation: compared(_count(s, keyword), frequency, relation),
    "keywords:exclude_word_harder": lambda s, keyword: f" {keyword} " not in s,
    "keywords:palindrome": lambda s: any(w == w[::-1] for w in s.split()),
    "keywords:keyword_specific_position": lambda s, keyword, n, m: len(x := sentence_list(s)) >= n and len(t := tokens(x[n - 1])) >= m and t[m - 1] == keyword,
    "keywords:start_end": lambda s: len(t := tokens(s)) > 1 and t[0].lower() == t[-1].lower(),
    "language:response_language": lambda s, language: _language(s, language),
    "length_constraints:number_sentences": lambda s, num_sentences, relation: compared(len(sentence_list(s)), num_sentences, relation),
    "length_constraints:number_words": lambda s, num_words, relation: compared(len(re.findall(r"\w+", s)), num_words, relation),
    "length_constraints:number_paragraphs": lambda s, num_paragraphs: (p := parts_between(s, DIVIDER)) is not None and len(p) == num_paragraphs,
    "length_constraints:nth_paragraph_first_word": _nth_paragraph,
    "detectable_content:number_placeholders": lambda s, num_placeholders: len(re.findall(r"\[.*?\]", s)) >= num_placeholders,
    "detectable_content:postscript": lambda s, postscript_marker: bool(re.search(POSTSCRIPTS.get(postscript_marker, r"\s*" + postscript_marker.lower() + r".*$"), s.lower(), re.M)),
    "detectable_format:number_bullet_lists": lambda s, num_bullets: len(re.findall(r"^\s*\*[^\*].*$", s, re.M)) + len(re.findall(r"^\s*-.*$", s, re.M)) == num_bullets,
    "detectable_format:constrained_response": lambda s: any(x in s.strip() for x in FIXED_ANSWERS),
    "detectable_format:number_highlighted_sections": lambda s, num_highlights: sum(bool(x.strip("*").strip()) for p in (r"\*[^\n\*]*\*", r"\*\*[^\n\*]*\*\*") for x in re.findall(p, s)) >= num_highlights,
    "detectable_format:multiple_sections": lambda s, section_spliter, num_sections: len(re.split(rf"\s?{section_spliter}\s?\d+\s?", s)) - 1 >= num_sections,
    "detectable_format:json_format": _json,
    "detectable_format:title": lambda s: any(x.lstrip("<").rstrip(">").strip() for x in re.findall(r"<<[^\n]+>>", s)),
    "detectable_format:sentence_hyphens": _hyphens,
    "detectable_format:square_brackets": lambda s: all(w.startswith("[") and w.endswith("]") for w in s.split()),
    "detectable_format:bigram_wrapping": lambda s: all(a.startswith("<<") and b.endswith(">>") for a, b in zip(s.split()[::2], s.split()[1::2])),
    "combination:two_responses": lambda s: (p := parts_between(s, r"\*\*\*\*\*\*")) is not None and len(p) == 2 and p[0].strip() != p[1].strip(),
    "combination:repeat_prompt": lambda s, prompt_to_repeat: s.strip().lower().startswith(prompt_to_repeat.strip().lower()),
    "startend:end_checker": lambda s, end_phrase: s.strip().strip('"').lower().endswith(end_phrase.strip().lower()),
    "startend:quotation": lambda s: len(x := s.strip()) > 1 and x[0] == x[-1] == '"',
    "change_case:capital_word_frequency": _capitals,
    "change_case:english_capital": lambda s: s.isupper() and _language(s, "en"),
    "change_case:english_lowercase": lambda s: s.islower() and _language(s, "en"),
    "punctuation:no_comma": lambda s: "," not in s,
    "punctuation:punctuation_dot": lambda s: "." not in s,
    "punctuation:punctuation_exclamation": lambda s: "!" not in s,
    "copy:repeat_phrase": _phrases,
    "copy:copy": lambda s, prompt_to_repeat: _same(s, prompt_to_repeat),
    "copy:copying_simple": lambda s, prompt_to_repeat: _same(s, prompt_to_repeat),
    "copy:copying_multiple": lambda s, prompt_to_repeat, N: len(p := s.split("******")) == N and all(_same(x, prompt_to_repeat) for x in p),
    "new:copy_span_idx": lambda s, prompt_to_repeat, n_start, n_end: _same(s, prompt_to_repeat[n_start:n_end]),
    "paragraphs:paragraphs": lambda s: (p := parts_between(s, DIVIDER)) is not None and len(p) == 2,
    "paragraphs:paragraphs2": lambda s: (p := parts_between(s, r"\n\n")) is not None and len(p) == 2,
    "first_word:first_word_sent": lambda s, first_word: all(x.split()[0].lower() == first_word.lower() for x in sentence_list(s)),
    "first_word:first_word_answer": lambda s, first_word: bool(s.split()) and s.split()[0].lower() == first_word.lower(),
    "last_word:last_word_sent": lambda s, last_word: all(_last(x.split()[-1]) == last_word.lower() for x in sentence_list(s)),
    "last_word:last_word_answer": lambda s, last_word: bool(s.split()) and _last(s.split()[-1]) == last_word.lower(),
    "count:lowercase_counting": lambda s, N: len(re.findall(r"\b[a-z]+\b", s)) <= N,
    "count:counting_composition": _composition,
    "count:count_unique": lambda s: len(t := tokens(s)) == len(set(t)),
    "count:count_increment_word": lambda s, keyword1, keyword2: _count(s, keyword1) == 1 and _count(s, keyword2) == 2,
    "letters:letter_counting": lambda s, N, relation: compared(len(re.findall(r"[a-zA-Z]", s)), N, relation),
    "letters:letter_counting2": lambda s, letter, let_frequency, let_relation: compared(s.lower().count(letter.lower()), let_frequency, let_relation),
}


def follows(instruction: str, answer: str, args: dict) -> bool:
    """Whether an answer follows an instruction; arguments that are null are left out, unknown ids raise."""
    given = {k: v for k, v in args.items() if v is not None}
    return bool(REGISTRY[instruction](answer, **given))


def _amount(n: int, wanted: int, quantifier: str, slack: int) -> bool:
    return {"at least": n >= wanted, "at most": n <= wanted, "around": abs(n - wanted) <= slack}.get(quantifier, False)


def _starred(s: str) -> list[str] | None:
    parts = "\n".join(x.strip() for x in s.splitlines()).strip().split("* * *")
    return parts if all(p.strip() for p in parts) else None


OLDER: dict[str, Check] = {
    "verify_keywords": lambda text, keyword_list: all(k.lower() in text.lower() for k in keyword_list),
    "verify_keyword_frequency": lambda text, word, N: re.findall(r"\b\w+\b", text.lower()).count(word.lower()) == N,
    "validate_forbidden_words": lambda text, forbidden_words: not any(w.lower() in text.lower() for w in forbidden_words),
    "verify_letter_frequency": lambda text, letter, N: text.count(letter) == N,
    "validate_response_language": lambda text, language: _language(text, language),
    "verify_paragraph_count": lambda text, N: (p := _starred(text)) is not None and len(p) == N,
    "validate_word_constraint": lambda text, N, quantifier: _amount(len(text.split()), N, quantifier, max(round(N * 0.1), 1)),
    "verify_sentence_constraint": lambda text, N, quantifier: _amount(len(re.split(r"(?<!\w\.\w.)(?<![A-Z][a-z]\.)(?<=\.|\?)\s", text)), N, quantifier, 1),
    "validate_paragraphs": lambda text, N, first_word, i: len(p := text.split("\n\n")) == N and p[i - 1].strip().startswith(first_word),
    "verify_postscript": lambda text, postscript_marker: len(text[text.find(postscript_marker) :].strip()) > len(postscript_marker) if postscript_marker in text else False,
    "validate_placeholders": lambda text, N: len(re.findall(r"\[(.*?)\]", text)) >= N,
    "verify_bullet_points": lambda text, N: sum(x.strip().startswith(("*", "-")) for x in text.split("\n")) == N,
    "validate_title": lambda text: bool(re.findall(r"<<(.*?)>>", text)),
    "validate_choice": lambda text, options: any(text in o for o in options),
    "validate_highlighted_sections": lambda text, N: len(re.findall(r"\*(.*?)\*", text)) >= N,
    "validate_sections": lambda text, N, section_splitter: len(text.split(section_splitter)) - (not text.split(section_splitter)[0].strip()) == N,
    "validate_json_format": lambda text: _json(text) and not text.strip().startswith("```"),
    "validate_repeat_prompt": lambda text, original_prompt: text.startswith(original_prompt),
    "validate_two_responses": lambda text: text.count("******") == 1 and len({x.strip() for x in text.split("******")}) == 2,
    "validate_uppercase": lambda text: text == text.upper(),
    "validate_lowercase": lambda text: text == text.lower(),
    "validate_frequency_capital_words": lambda text, N, quantifier: _amount(len(re.findall(r"\b[A-Z]+\b", text)), N, quantifier, 0),
    "validate_end": lambda text, end_phrase: text.endswith(end_phrase),
    "validate_quotation": lambda text: text.startswith('"') and text.endswith('"'),
    "validate_no_commas": lambda text: "," not in text,
}


def older(name: str, answer: str, args: dict) -> bool:
    return bool(OLDER[name](answer, **args))




def rule_columns(text: str | Column, rules: dict[str, tuple[str, dict]], older_set: bool = False) -> list[Column]:
    """A boolean column per rule, named by the keys of ``rules``; all rules read a text in one Arrow stage.

    A null text gives nulls; a rule that cannot be applied to its arguments gives false.
    """
    asked = list(rules.values())

    @F.pandas_udf(T.ArrayType(T.BooleanType()))
    def run(texts: pd.Series) -> pd.Series:
        def one(name: str, s: str, args: dict) -> bool:
            try:
                return older(name, s, args) if older_set else follows(name, s, args)
            except (ValueError, IndexError, TypeError, KeyError):
                return False

        return pd.Series([None if s is None else [one(n, s, a) for n, a in asked] for s in texts], dtype=object)

    held = run(col(text))
    return [F.get(held, F.lit(k)).alias(name) for k, name in enumerate(rules)]
