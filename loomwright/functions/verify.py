"""Verifiable rewards: what a prediction scores against a label.

Rules that built-in expressions can state are columns; the others are Python functions behind
one Arrow stage.  ``reward`` zips labels and verifier names per row, as datasets hold them.
"""

from __future__ import annotations

import ast
import json
import re
import string
from collections import Counter
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwright.functions import checks, latex
from loomwright.functions.text import after_last, col, final_answer, normalize_answer, strip, without_thinking

# ---- Columns --------------------------------------------------------------------------------


def gsm8k(prediction: str | Column, label: str | Column) -> Column:
    """The last number, thousands joined, equals the label; integers lose their sign."""
    p = F.regexp_replace(col(prediction), r"(\d),(\d)", "$1$2")
    numbers = F.regexp_extract_all(p, F.lit(r"([-+]?\d*\.\d+|\d+)"), F.lit(1))
    last = F.when(F.size(numbers) > 0, F.element_at(numbers, -1)).otherwise(p)
    return (F.lower(last) == F.lower(col(label))).cast("double")


def flan(prediction: str | Column, label: str | Column) -> Column:
    return (normalize_answer(strip(after_last(prediction, "The answer is: "))) == normalize_answer(label)).cast("double")


def string_matcher(prediction: str | Column, label: str | Column) -> Column:
    """Both answer tags are there, and what is between them is the label after normalising."""
    p = col(prediction)
    inside = F.substring_index(F.substring_index(p, "<answer>", -1), "</answer>", 1)
    return F.when(p.contains("<answer>") & p.contains("</answer>"), (normalize_answer(inside) == normalize_answer(label)).cast("double")).otherwise(F.lit(0.0))


def puzzle(prediction: str | Column, label: str | Column) -> Column:
    return (normalize_answer(without_thinking(prediction)) == normalize_answer(label)).cast("double")


@F.pandas_udf(T.DoubleType())
def token_f1_column(a: pd.Series, b: pd.Series) -> pd.Series:
    """F1 of the words of two normalised texts: words in common count as often as both have them.  Null beside null."""
    out = []
    for x, y in zip(a, b):
        if x is None or y is None:
            out.append(None)
            continue
        x, y = x.split(), y.split()
        common = sum((Counter(x) & Counter(y)).values())
        out.append(2 * common / (len(x) + len(y)) if common else 0.0)
    return pd.Series(out, dtype=float)


def string_f1(df: DataFrame, prediction: str, label: str, name: str) -> DataFrame:
    """Adds token F1 of the normalised texts, of a prediction what follows its reasoning."""
    return df.withColumn(name, token_f1_column(normalize_answer(after_last(prediction, "</think>")), normalize_answer(label)))


def search_exact(prediction: str | Column, labels: str | Column) -> Column:
    """The first ``<finish>`` answer equals one of the labels after normalising."""
    a = strip(F.regexp_extract(col(prediction), r"(?is)<finish>(.*?)</finish>", 1))
    return F.when(a == "", 0.0).otherwise(F.exists(col(labels), lambda x: normalize_answer(x) == normalize_answer(a)).cast("double"))


def max_length(n_tokens: str | Column, wanted: str | Column, longest: int) -> Column:
    """1 less the relative distance to the wanted length; may fall below 0."""
    return 1 - F.abs(col(n_tokens) - col(wanted)) / F.lit(float(longest))


def up_to_max_length(n_tokens: str | Column, wanted: str | Column, longest: int) -> Column:
    return F.when(col(n_tokens) <= col(wanted), 1.0).otherwise(1 - (col(n_tokens) - col(wanted)) / F.lit(float(longest)))


def soft_format(prediction: str | Column) -> Column:
    return col(prediction).rlike(r"(?s)\A.*?</think>\s*<answer>.*?</answer>").cast("double")


def code_score(results: str | Column, runtimes: str | Column, threshold: float, slowest: float, penalised: bool) -> Column:
    """Score from an executor's results: the pass rate, 0 under the threshold, less for slow tests."""
    passed = F.aggregate(col(results), F.lit(0.0), lambda a, x: a + x.cast("double")) / F.size(col(results))
    score = F.when(F.size(col(results)) == 0, 0.0).when(passed < threshold, 0.0).otherwise(passed)
    if not penalised:
        return score
    unused = F.aggregate(col(runtimes), F.lit(0.0), lambda a, x: a + F.greatest(F.lit(0.0), 1 - x / slowest)) / F.size(col(runtimes))
    return score * unused


def combined(verifiable: Column, fmt: Column | None, gated: bool, only_good: bool, stopped: Column | None, penalty: float | None) -> Column:
    """Format and verifiable reward together; a missing stop overwrites the score."""
    score = verifiable
    if fmt is not None:
        score = F.when(fmt == 1.0, fmt + verifiable).otherwise(fmt) if gated else fmt + verifiable
    if only_good and stopped is not None:
        score = F.when(stopped, score).otherwise(F.lit(0.0))
    if penalty is not None and stopped is not None:
        score = F.when(stopped, score).otherwise(F.lit(float(penalty)))
    return score


# ---- Python rules ---------------------------------------------------------------------------
_ARTICLES = re.compile(r"\b(a|an|the)\b")
_MINERVA = re.compile(r"Final Answer: The final answer is(.*?). I hope it is correct.")


def plain(s: str) -> str:
    s = "".join(c for c in s.lower() if c not in set(string.punctuation))
    return " ".join(_ARTICLES.sub(" ", s).split())


def token_f1(a: str, b: str) -> float:
    x, y = plain(a).split(), plain(b).split()
    common = sum((Counter(x) & Counter(y)).values())
    if not common:
        return 0.0
    p, r = common / len(x), common / len(y)
    return 2 * p * r / (p + r)


def answer_candidates(p: str, strict: bool = False) -> list[str]:
    """Answers a solution may mean: boxed, stated as final, else the last formula, else the whole text."""
    found = []
    boxed = None if strict else latex.last_boxed(p)
    if boxed is not None:
        found.append(boxed)
    m = _MINERVA.search(p + "I hope it is correct.")
    if m:
        found.append(latex.final_form(m[1]))
    if not strict and not found:
        dollars = [i for i, c in enumerate(p) if c == "$"]
        if len(dollars) > 1:
            found.append(latex.final_form(p[dollars[-2] + 1 : dollars[-1]]))
    if not found:
        found.append(latex.final_form(p))
        if not strict:
            found.append(p)
    return found


def math(p: str, label: str) -> float:
    return float(any(latex.equal(x, label) for x in answer_candidates(p)))


def strict_math(p: str, label: str) -> float:
    return float(any(latex.equal(x, label) for x in answer_candidates(p, True)))


def search_f1(p: str, label: str) -> float:
    """F1 of the last ``<finish>`` answer against the best label; 0.1 for the format alone."""
    try:
        labels = json.loads(label)
    except (json.JSONDecodeError, TypeError):
        labels = label.strip()
    if "<finish>" not in p and "</finish>" not in p:
        return 0.0
    a = p.split("<finish>")[-1].split("</finish>")[0]
    if not a:
        return 0.0
    best = max((token_f1(a, str(x)) for x in labels), default=0.0) if isinstance(labels, list) else token_f1(a, str(labels))
    return best or 0.1


def ifeval(p: str, label: str) -> float:
    """Share of the instructions followed; the label holds instruction ids and their arguments."""
    spec = ast.literal_eval(label)[0]
    if isinstance(spec, str):
        spec = json.loads(spec)
    answer = p.split("</think>")[-1].replace("<answer>", "").replace("</answer>", "").strip()
    kept = [checks.follows(i, answer, k or {}) for i, k in zip(spec["instruction_id"], spec["kwargs"])]
    return sum(kept) / len(kept) if answer and kept else 0.0


def ifeval_old(p: str, label: str) -> float:
    spec = json.loads(label)
    name = spec.pop("func_name", None)
    answer = p.split("</think>")[-1].strip()
    if name not in checks.OLDER or not answer:
        return 0.0
    return float(checks.older(name, answer, {k: v for k, v in spec.items() if v is not None}))


RULES: dict[str, Callable[[str, str], float]] = {
    "gsm8k": lambda p, y: float(str((re.findall(r"[-+]?\d*\.\d+|\d+", q := re.sub(r"(\d),(\d)", r"\1\2", p)) or [q])[-1]).lower() == y.lower()),
    "math": math,
    "strict_math": strict_math,
    "ifeval": ifeval,
    "ifeval_old": ifeval_old,
    "flan": lambda p, y: float(plain(p.split("The answer is: ")[-1].strip()) == plain(y)),
    "string_matcher": lambda p, y: float("<answer>" in p and "</answer>" in p and plain(p.split("<answer>")[-1].split("</answer>")[0]) == plain(y)),
    "string_f1": lambda p, y: token_f1(p.split("</think>")[-1], y),
    "puzzle": lambda p, y: float(plain(p.replace("<|assistant|>", "").strip().split("</think>")[-1].replace("<answer>", "").replace("</answer>", "").strip()) == plain(y)),
    "re_search_f1": search_f1,
    "re_search": lambda p, y: float(bool(m := re.search(r"<finish>(.*?)</finish>", p, re.I | re.S)) and m[1].strip() != "" and plain(m[1]) in [plain(str(x)) for x in _labels(y)]),
}
ALIASES = {"code_stdio": "code"}


def _labels(y: str) -> list:
    try:
        v = json.loads(y)
        return v if isinstance(v, list) else [v]
    except (json.JSONDecodeError, TypeError):
        return [str(y).strip()]


def score(name: str | None, prediction: str | None, label: str | None) -> float | None:
    """Score by verifier name, whatever its case; null for an unknown one, 0 for a label that cannot be read."""
    rule = RULES.get((name or "").lower())
    if rule is None or label is None:
        return None
    try:
        return rule(prediction or "", label)
    except (ValueError, SyntaxError, KeyError, IndexError, TypeError, AttributeError, RecursionError, MemoryError, re.error):
        return 0.0


@F.udf(T.DoubleType(), useArrow=True)
def score_column(name: str, prediction: str, label: str) -> float:
    return score(name, prediction, label)


def reward(df: DataFrame, key: str, prediction: str, labels: str, names: str, weights: dict[str, float] | None = None, mult: float = 1.0) -> DataFrame:
    """``key, reward, parts``: weighted sum over the zipped labels and verifiers, and each verifier's share.

    Unknown verifiers are skipped; of lists of unequal length the longer one's rest is.
    """
    w = F.create_map(*[F.lit(x) for kv in (weights or {"": 1.0}).items() for x in kv])
    z = df.select(key, F.col(prediction).alias("_p"), F.explode_outer(F.arrays_zip(F.col(labels).alias("y"), F.col(names).alias("v"))).alias("z"))
    s = z.select(key, F.lower("z.v").alias("v"), (score_column(F.col("z.v"), F.col("_p"), F.col("z.y")) * mult * F.coalesce(F.element_at(w, F.lower("z.v")), F.lit(1.0))).alias("s"))
    per = s.groupBy(key, "v").agg(F.sum("s").alias("s"))
    return per.groupBy(key).agg(F.coalesce(F.sum("s"), F.lit(0.0)).alias("reward"), F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("s").isNotNull(), F.struct("v", "s"))))).alias("parts"))


__all__ = ["final_answer", "score", "score_column", "reward", "RULES"]
