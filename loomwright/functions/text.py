"""Text rules as column expressions: they stay in the JVM and keep the semantics of Python strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_WS = r"[\s\x1c-\x1f]"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: str | Column) -> Column:
    """Unicode white space off both ends, as ``str.strip``."""
    return F.regexp_replace(col(c), rf"(?U)\A{_WS}+|{_WS}+\z", "")


def split_ws(c: str | Column) -> Column:
    """Words between white space, as ``str.split``: no empty ones."""
    return F.filter(F.split(col(c), rf"(?U){_WS}+"), lambda x: x != "")


def count_words(c: str | Column) -> Column:
    return F.size(F.regexp_extract_all(col(c), F.lit(r"(?U)(\w+)"), F.lit(1)))


def count_matches(c: str | Column, pattern: str) -> Column:
    return F.size(F.regexp_extract_all(col(c), F.lit(f"({pattern})"), F.lit(1)))


def any_word(words: list[str]) -> str:
    """Pattern of any of the words on word borders; Java quoting keeps them literal."""
    return r"(?iU)\b(" + "|".join(r"\Q" + w + r"\E" for w in words) + r")\b"


def paragraphs(c: str | Column, by: str = r"\n\n") -> Column:
    return F.filter(F.transform(F.split(col(c), by), strip), lambda x: x != "")


def sentences(c: str | Column) -> Column:
    """Pieces between runs of end marks, stripped, without empty ones."""
    return F.filter(F.transform(F.split(col(c), "[.!?]+"), strip), lambda x: x != "")


def once(expression: Column) -> Column:
    """For ``withColumn``: the value is computed once per row.

    A lambda evaluates the expressions in it for every element, and projections are merged into
    it; a generator is a border they do not cross.
    """
    return F.explode(F.array(expression))


def word_ngrams(words: Column, n: int) -> Column:
    """All runs of ``n`` words joined by a blank; none when there are fewer. ``words``: a column made by ``once``."""
    last = F.size(words) - n
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice(words, i + 1, n), " "))).otherwise(F.array().cast("array<string>"))


def without_thinking(c: str | Column) -> Column:
    """What follows the last ``</think>``, without the assistant mark and answer tags."""
    text = strip(F.replace(col(c), F.lit("<|assistant|>"), F.lit("")))
    last = F.element_at(F.split(text, "</think>"), -1)
    return strip(F.replace(F.replace(last, F.lit("<answer>"), F.lit("")), F.lit("</answer>"), F.lit("")))


def normalize_answer(c: str | Column) -> Column:
    """Lower case, no ASCII punctuation, no articles, single blanks: in this order."""
    t = F.regexp_replace(F.lower(col(c)), r"[!-/:-@\[-`{-~]", "")
    t = F.regexp_replace(t, r"(?U)\b(a|an|the)\b", " ")
    return strip(F.regexp_replace(t, rf"(?U){_WS}+", " "))


def final_answer(c: str | Column) -> Column:
    """The first ``<answer>``, else what follows the first ``</think>``, else the text without the assistant mark."""
    c = col(c)
    tagged = F.regexp_extract(c, r"(?s)<answer>(.*?)</answer>", 1)
    after = F.regexp_extract(c, r"(?s)\A.*?</think>(.*)\z", 1)
    return F.when(c.rlike(r"(?s)<answer>.*?</answer>"), strip(tagged)).when(c.contains("</think>"), strip(after)).otherwise(strip(F.replace(c, F.lit("<|assistant|>"), F.lit(""))))


def last_code_block(c: str | Column) -> Column:
    """Body of the last fenced block; the whole text when there is none."""
    found = F.regexp_extract_all(col(c), F.lit(r"(?s)```(?:python)?(.*?)```"), F.lit(1))
    return F.when(F.size(found) > 0, strip(F.element_at(found, -1))).otherwise(col(c))


def occurrences(c: str | Column, needle: str) -> Column:
    """Zero-based starts of ``needle``, overlapping ones too."""
    c, n = col(c), len(needle)
    last = F.length(c) - n
    return F.when(last >= 0, F.filter(F.sequence(F.lit(0), last), lambda i: F.substring(c, i + 1, F.lit(n)) == needle)).otherwise(F.array().cast("array<int>"))


def after_last(c: str | Column, mark: str) -> Column:
    return F.substring_index(col(c), mark, -1)


def class_ratio(c: str | Column, chars: str) -> Column:
    """Share of the characters of a class, 0 for empty texts."""
    c = col(c)
    n = F.length(c)
    return F.when(n > 0, (n - F.length(F.regexp_replace(c, f"[{chars}]", ""))) / n).otherwise(F.lit(0.0))
