"""Repeated blocks inside one text: paragraphs and sentences that come again and again."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwright.functions.text import split_ws

# ---- Fixed values -------------------------------------------------------------------------
SYMBOLS = "=+-*/^()[]{}<>|&~!@#$%\\"
CODE_STARTS = [
    r"^import\s+", r"^from\s+\w+\s+import", r"^return\s+", r"^return\s+\w+", r"^\w+\s*\+\s*=\s*\d+", r"^\w+\s*-\s*=\s*\d+",
    r"^\w+\s*\*\s*=\s*\d+", r"^\w+\s*/\s*=\s*\d+", r"^for\s+", r"^while\s+", r"^if\s+", r"^def\s+", r"^class\s+", r"^\w+\.\w+\(", r"^\w+\s*=\s*\w+\(",
]
MATH_FORMS = [
    r"math\.\w+\([^)]*\)", r"\w+\*\*[0-9]+", r"[0-9]+\s*[+\-*/]\s*[0-9]+", r"[a-zA-Z_]\w*\s*[+\-*/]\s*[a-zA-Z_]\w*", r"def\s+\w+\([^)]*\):",
    r"lambda\s+[^:]+:", r"\[[^\]]*for[^\]]*\]", r"\{[^}]*for[^}]*\}", r"\([^)]*for[^)]*\)",
]
SHORT_PHRASES = [
    "not sure", "wait no", "i think", "maybe", "probably", "yes", "no", "ok", "okay", "right", "wrong", "correct", "incorrect", "true", "false",
    "good", "bad", "nice", "great", "awesome", "terrible", "wow", "oh", "hmm", "um", "uh", "well", "so", "now", "then", "here", "there",
    "this", "that", "these", "those", "it", "is", "are", "was", "were", "have", "has", "had", "do", "does", "did", "will", "would", "could",
    "should", "can", "cannot", "cant", "dont", "doesnt", "isnt", "arent", "second < b", "we can use:", "we can use", "first < a", "third < c", "fourth < d",
    "a < b", "b < c", "c < d", "d < e", "e < f", "f < g", "g < h", "x < y", "y < z", "i < j", "j < k", "k < l", "l < m", "m < n",
    "n < o", "o < p", "p < q", "q < r", "r < s", "s < t", "t < u", "u < v", "v < w", "w < x",
    "return none", "return true", "return false", "return 0", "return 1", "return -1", "return null", "return undefined",
]
COMPARED = r"^\w+\s*[<>]\s*\w+$"
CODE_WORDS = ["import", "from", "return", "def", "class", "if", "for", "while"]
TRANSITIONS = {"alternatively,", "therefore,", "however,"}
# -------------------------------------------------------------------------------------------

_CODE = re.compile("|".join(f"(?:{p})" for p in CODE_STARTS), re.I)
_MATH = re.compile("|".join(f"(?:{p})" for p in MATH_FORMS))
_SHORT = re.compile("|".join(re.escape(p) for p in SHORT_PHRASES))
_LIST_NUMBER, _LIST_BULLET = re.compile(r"\d+\.\s"), re.compile(r"[\-\*•]\s")
_HALF_BRACKET, _WHOLE_BRACKET = re.compile(r"[\(\[\{][^\)\]\}]*$|^[^\(\[\{]*[\)\]\}]"), re.compile(r"[\(\[\{][^\(\[\{\)\]\}]*[\)\]\}]")


@dataclass(frozen=True)
class Limits:
    """How often a block may come: paragraphs, sentences anywhere, sentences in a row."""

    paragraphs: int
    sentences: int
    in_a_row: int


REPORTING, FILTERING = Limits(25, 40, 20), Limits(10, 40, 4)


def repeated(items: list[str], least: int) -> dict[str, tuple[int, int]]:
    """Items of ``least`` characters or more that come twice or more: times, and longest run of neighbours.

    In the order of their first place.
    """
    times: dict[str, int] = {}
    run: dict[str, int] = {}
    longest: dict[str, int] = {}
    before = None
    for x in items:
        if len(x) >= least:
            times[x] = times.get(x, 0) + 1
            run[x] = run[x] + 1 if x == before else 1
            longest[x] = max(longest.get(x, 1), run[x])
        before = x
    return {x: (n, longest[x]) for x, n in times.items() if n > 1}


def looks_like_code(s: str) -> bool:
    if _HALF_BRACKET.search(s) and not _WHOLE_BRACKET.search(s):
        return True
    return bool(_CODE.search(s))


def is_short_phrase(s: str) -> bool:
    """Holds one of the phrases anywhere, even inside a word, or only compares two words."""
    low = s.lower()
    if _SHORT.search(low):
        return True
    return bool(re.match(COMPARED, s)) and not any(w in low for w in CODE_WORDS)


def is_list(text: str) -> bool:
    lines = [x.strip() for x in text.split("\n")]
    return len(lines) > 1 and (sum(bool(_LIST_NUMBER.match(x)) for x in lines) >= 2 or sum(bool(_LIST_BULLET.match(x)) for x in lines) >= 2)


def _ignored(s: str) -> bool:
    return looks_like_code(s) or bool(_MATH.search(s)) or s.lower() in TRANSITIONS


def first_repetition(text: str | None, limits: Limits = FILTERING) -> tuple[str, str] | None:
    """(reason, block) of the first repetition over the limits, paragraphs before sentences."""
    if not text:
        return None
    listed = 3 if is_list(text) else 1
    symbols = set(SYMBOLS)
    for block, (n, run) in repeated([p for x in text.split("\n\n") if (p := x.strip())], 10).items():
        if (run == 1 and len(block) < 20) or _ignored(block):
            continue
        limit = limits.paragraphs * max(listed, 4 if "\n" in block else 1, 2 if symbols & set(block) else 1)
        if n >= (min(2 * limit, 30) if run == 1 else limit):
            return f"paragraph_repeated_{n}x", block
    for block, (n, run) in repeated([s for x in re.split(r"[.!?]+", text) if (s := x.strip())], 5).items():
        if len(block.split()) <= 1:
            continue
        if is_short_phrase(block):
            if run >= 2 * limits.in_a_row:
                return f"line_repeated_{n}x_consecutive_short_phrase", block
            continue
        if _ignored(block):
            continue
        factor = max(2 if symbols & set(block) else 1, listed)
        if run >= limits.in_a_row * factor:
            return f"line_repeated_{n}x_consecutive", block
        if n >= limits.sentences * factor and len(block) >= 10:
            return f"line_repeated_{n}x", block
    return None


def repetition(text: str | Column, limits: Limits = FILTERING) -> Column:
    """Struct of ``reason`` and ``block``, null without a repetition.  One Arrow stage, no shuffle."""

    @F.udf(T.StructType([T.StructField("reason", T.StringType()), T.StructField("block", T.StringType())]), useArrow=True)
    def found(t: str):
        return first_repetition(t, limits)

    return found(text)


def islands(df: DataFrame, key: str, items: Column, least: int = 5) -> DataFrame:
    """``key, item, n, longest_run, first_pos`` of items that come again in a row's list.

    Gaps and islands in relational form: equal neighbours share position minus rank.
    """
    x = df.select(key, F.posexplode(items).alias("pos", "item")).where(F.length("item") >= least)
    x = x.withColumn("island", F.col("pos") - F.row_number().over(Window.partitionBy(key, "item").orderBy("pos")))
    runs = x.groupBy(key, "item", "island").agg(F.count("*").alias("run"), F.min("pos").alias("first"))
    return runs.groupBy(key, "item").agg(F.sum("run").alias("n"), F.max("run").alias("longest_run"), F.min("first").alias("first_pos")).where("n > 1")


def repeated_ngrams(df: DataFrame, key: str, text: str, n: int = 3, least: int = 2) -> DataFrame:
    """``key, ngram, n_times`` of lower-cased word n-grams that come ``least`` times or more in a text."""
    found = df.select(key, F.explode(_counted_ngrams(split_ws(F.lower(text)), F.lit(n), F.lit(least))).alias("x"))
    return found.select(key, "x.ngram", "x.n_times")


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("ngram", T.StringType()), T.StructField("n_times", T.LongType())])))
def _counted_ngrams(words: pd.Series, n: pd.Series, least: pd.Series) -> pd.Series:
    """N-grams of each text that come often enough, counted within the text."""
    size, few = (int(n.iloc[0]), int(least.iloc[0])) if len(n) else (1, 1)
    out = []
    for w in words:
        grams = Counter(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if w is not None else {}
        out.append([(" ".join(g), k) for g, k in grams.items() if k >= few])
    return pd.Series(out, dtype=object)
