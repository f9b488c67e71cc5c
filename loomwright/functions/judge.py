"""What judges answer, turned into scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomwright.functions.text import col, strip

# ---- Fixed values: words tried in this order, so "incorrect" scores as "correct" does ---------
YES, NO = ("yes", "correct", "good", "true", "pass"), ("no", "incorrect", "bad", "false", "fail")
EXTRACTORS = {
    "quality": "json_of_10", "quality_rubric": "json", "quality_ref": "json_of_10", "safety": "json",
    "factuality": "json", "creative_writing": "json", "refusal": "json", "web_instruct_general_verifier": "decision",
}


def free_score(c: str | Column) -> Column:
    """A ratio, else a percentage, else the first number, else yes or no words, else 0."""
    c = col(c)
    low = F.lower(c)
    a, b = F.regexp_extract(c, r"(\d+)/(\d+)", 1), F.regexp_extract(c, r"(\d+)/(\d+)", 2)
    pct, num = F.regexp_extract(c, r"(\d+\.?\d*|\.\d+)%", 1), F.regexp_extract(c, r"(\d+\.?\d*|\.\d+)", 1)
    yes = F.lit(False)
    for w in YES:
        yes = yes | low.contains(w)
    n = lambda x: F.expr("null").cast("double") if x is None else x.try_cast("double")
    return (
        F.when(a != "", F.try_divide(n(a), n(b))).when(pct != "", n(pct) / 100).when(num != "", n(num))
        .when(yes, 1.0).otherwise(F.lit(0.0))
    )


def decision_score(c: str | Column) -> Column:
    return F.when(F.lower(col(c)).contains("final decision: yes"), 1.0).otherwise(F.lit(0.0))


def json_score(c: str | Column) -> Column:
    """``SCORE`` of a JSON answer, fenced or not; by pattern where the JSON is broken; else 0."""
    t = strip(c)
    t = F.regexp_replace(F.regexp_replace(t, r"\A```(?:json)?", ""), r"```\z", "")
    t = F.regexp_replace(F.regexp_replace(t, r"\r?\n", r"\\\\n"), r'\\\\(?!["\\\\/bfnrtu])', r"\\\\\\\\")
    parsed = F.get_json_object(strip(F.regexp_replace(t, r"(?:\\n)+\z|\A(?:\\n)+", "")), "$.SCORE").try_cast("double")
    found = F.regexp_extract(t, r'"SCORE"\s*:\s*"?([0-9]+(?:\.[0-9]+)?)"?', 1).try_cast("double")
    return F.coalesce(parsed, found, F.lit(0.0))


def judge_score(kind: str, c: str | Column) -> Column:
    how = EXTRACTORS[kind]
    return decision_score(c) if how == "decision" else json_score(c) / (10 if how == "json_of_10" else 1)


def aspect_answers(c: str | Column, typed: bool) -> Column:
    """Ratings and rationales of an aspect answer, one struct per paragraph of it.

    Typed answers hold a type and its rationale before the rating and its rationale; the first
    integer of a rating counts, ``1`` stands in for none, and ``N/A`` stays in untyped ones.
    """
    parts = F.filter(F.split(strip(c), r"\n\n"), lambda p: p.contains("Rating:"))

    def one(p: Column) -> Column:
        raw = F.regexp_extract(p, r"Rating:\s*([^\n]*)", 1)
        digit = F.regexp_extract(raw, r"(\d+)", 1)
        rating = F.when(digit != "", digit).when(F.lit(not typed) & raw.contains("N/A"), F.lit("N/A")).otherwise(F.lit("1"))
        tail = F.regexp_extract(p, r"(?s)Rating:[^\n]*\n\s*Rationale:\s*(.*)", 1)
        fields = [rating.alias("rating"), tail.alias("rationale")]
        if typed:
            fields.append(F.regexp_extract(p, r"Type:\s*([^\n]*)", 1).alias("type"))
        return F.struct(*fields)

    return F.transform(parts, one)
