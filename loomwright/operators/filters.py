"""Quality filters on conversations and texts.

Every filter is a boolean column: true means the row is to be removed.  They hold no state, so
any number of them runs in one scan, without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwright.functions.text import any_word, class_ratio, col, split_ws, strip

# ---- Fixed values -------------------------------------------------------------------------
KEYWORDS = [
    "OpenAI", "Open AI", "ChatGPT", "Chat GPT", "GPT-3", "GPT3", "GPT 3", "GPT-4", "GPT4", "GPT 4",
    "GPT-3.5", "GPT3.5", "GPT 3.5", "BingChat", "Bing Chat", "LAION", "Open Assistant", "OpenAssistant",
]
PROVIDERS = [
    "OpenAI", "Open AI", "Claude", "Gemini", "Qwen", "DeepSeek", "Anthropic", "Meta AI", "Meta's", "ChatGPT",
    "Cohere", "Mistral AI", "Mistral's", "xAI", "Perplexity",
]
IDENTITY_FORMS = [
    r"\bI'?m\s+({P}),?\s+an?\s+AI\s+(?:assistant|model)[^.!?]{0,100}(?:made|developed|created|trained)\s+by\s+({P})\b[^.!?]{0,100}[.!?]",
    r"\b({P})\s+is\s+an?\s+AI\s+(?:assistant|model)[^.!?]{0,100}(?:developed|created|made|trained)\s+by\s+({P})\b[^.!?]{0,100}[.!?]",
    r"\bas\s+an?\s+(?:language\s+model|AI\s+model|assistant|chatbot|model)[^.!?]{0,100}\b({P})\b[^.!?]{0,100}[.!?]",
    r"\bas\s+an\s+AI\s+(?:developed|created|made|trained)\s+by\s+({P})\b[^.!?]{0,100}[.!?]",
    r"\bI\s+am\s+(?:a\s+)?(?:language\s+model|AI\s+model|assistant|chatbot|model)[^.!?]{0,100}\b({P})\b[^.!?]{0,100}[.!?]",
    r"\bI\s+am\s+called\s+\b({P})\b[^.!?]{0,100}[.!?]",
    r"\b(?:I'?m|I\s+am)\s+\b({P})\b[^.!?]{0,100}[.!?]",
    r"\btrained\s+by\s+[^.!?]{0,100}?\b({P})\b[^.!?]{0,100}[.!?]",
    r"\bdeveloped\s+by\s+[^.!?]{0,100}?\b({P})\b[^.!?]{0,100}[.!?]",
    r"\bcreated\s+by\s+[^.!?]{0,100}?\b({P})\b[^.!?]{0,100}[.!?]",
    r"\bmade\s+by\s+[^.!?]{0,100}?\b({P})\b[^.!?]{0,100}[.!?]",
    r"\bagainst\s+({P})(?:'s|'s)?\s+(?:use-case\s+)?(?:policy|policies|guidelines|terms)[^.!?]{0,100}[.!?]",
    r"\b({P})(?:'s|'s)\s+(?:policy|policies|guidelines|terms|use-case)[^.!?]{0,100}[.!?]",
    r"[^.!?]{0,250}?\bDeepSeek\b[^.!?]{0,100}[.!?]",
    r"[^.!?]{0,250}?\bQwen\b[^.!?]{0,100}[.!?]",
    r"[^.!?]{0,250}?\bAlibaba\s+Qwen\b[^.!?]{0,100}[.!?]",
    r"[^.!?]{0,250}?\bAlibaba\s+Cloud\b[^.!?]{0,100}[.!?]",
]
CUTOFF = (
    r"(?i)(?:as\s+(?:of\s+)?(?:my\s+)?(?:last|latest)\s+(?:update|knowledge)(?:\s+was)?\s+in|knowledge\s+cutoff|last\s+updated?\s+in)"
    r"\s+(?:(?:January|February|March|April|May|June|July|August|September|October|November|December)\s+)?(\d{4})"
)
HAN = r"\x{4e00}-\x{9fff}"
SPECIAL_TOKENS = {"<think>": "\n", "</think>": "", "<answer>": "\n\n", "</answer>": ""}
# -------------------------------------------------------------------------------------------


def contents(messages: str | Column, *roles: str) -> Column:
    """Contents of the messages of these roles, of all when none is given."""
    kept = F.filter(col(messages), lambda m: m["role"].isin(*roles)) if roles else col(messages)
    return F.transform(kept, lambda m: m["content"])


def last_assistant(messages: str | Column) -> Column:
    """Content of the last assistant message, '' when there is none."""
    c = contents(messages, "assistant")
    return F.when(F.size(c) > 0, F.element_at(c, -1)).otherwise(F.lit(""))


def has_keyword(messages: str | Column, words: list[str] | None = None) -> Column:
    """Some assistant message holds one of the words, whatever its case.  Null contents hold none."""
    pattern = any_word(words or KEYWORDS)
    return F.coalesce(F.exists(contents(messages, "assistant"), lambda c: F.coalesce(c.rlike(pattern), F.lit(False))), F.lit(False))


def has_empty_message(messages: str | Column) -> Column:
    """Some content is null or blank.  A null conversation counts as empty, one without messages does not."""
    return F.coalesce(F.exists(contents(messages), lambda c: F.coalesce(strip(c) == "", F.lit(True))), F.lit(True))


def mentions_identity(messages: str | Column, user_turns: bool = False, providers: list[str] | None = None) -> Column:
    """Some assistant (or also user) turn claims a provider's identity; a null content counts as such."""
    names = "|".join(providers or PROVIDERS)
    pattern = "(?i)(?:" + "|".join(f.replace("{P}", names) for f in IDENTITY_FORMS) + ")"
    turns = contents(messages, "assistant", "user") if user_turns else contents(messages, "assistant")
    return F.coalesce(F.exists(turns, lambda c: F.coalesce(c.rlike(pattern), F.lit(True))), F.lit(False))


def script_heavy(messages: str | Column, threshold: float = 0.05, last_two: bool = False, chars: str = HAN) -> Column:
    """The last assistant turn, or the last two messages, hold the script with at least this share."""
    text = F.array_join(F.slice(contents(messages), -2, 2), " ") if last_two else last_assistant(messages)
    text = F.coalesce(text, F.lit(""))
    return text.rlike(f"[{chars}]") & (class_ratio(text, chars) >= threshold)


def cutoff_mentions(text: str | Column) -> Column:
    """Whole matches of phrases that tell a knowledge cutoff."""
    return F.regexp_extract_all(col(text), F.lit(f"({CUTOFF})"), F.lit(1))


def drop_by_cutoff(df: DataFrame, key: str, messages: str) -> DataFrame:
    """Rows whose id no row with a cutoff mention has; the ids are joined, not collected."""
    hit = df.where(F.exists(contents(messages), lambda c: F.coalesce(F.size(cutoff_mentions(c)) > 0, F.lit(False)))).select(key).distinct()
    return df.join(hit, key, "left_anti")


def is_think_answer(text: str | Column) -> Column:
    return F.coalesce(col(text).rlike(r"(?s)\A<think>.*?</think><answer>.*?</answer>\z"), F.lit(False))


def is_think(text: str | Column) -> Column:
    return F.coalesce(col(text).rlike(r"(?s)\A<think>.*?</think>.*?\z"), F.lit(False))


def add_answer_tags(text: str | Column) -> Column:
    """The answer behind the reasoning gets its tags; ones that are there stay."""
    t = col(text)
    t = F.when(t.contains("</think>\n"), t).otherwise(F.replace(t, F.lit("</think>"), F.lit("</think>\n")))
    t = F.when(t.contains("<answer>"), t).otherwise(F.replace(t, F.lit("</think>"), F.lit("</think>\n<answer>")))
    return F.when(t.endswith("</answer>"), t).otherwise(F.concat(t, F.lit("\n</answer>")))


def remove_answer_tags(text: str | Column) -> Column:
    t = strip(F.replace(F.replace(col(text), F.lit("<answer>"), F.lit("")), F.lit("</answer>"), F.lit("")))
    return F.when(t.contains("</think>\n"), t).otherwise(F.replace(t, F.lit("</think>"), F.lit("</think>\n")))


def without_special_tokens(text: str | Column, tokens: dict[str, str] | None = None) -> Column:
    out = col(text)
    for token, by in (tokens or SPECIAL_TOKENS).items():
        out = F.replace(out, F.lit(token), F.lit(by))
    return out


def messages_to_text(messages: str | Column) -> Column:
    """``Role: content`` paragraphs; messages without content are left out."""
    def line(m: Column) -> Column:
        role = F.lower(m["role"])
        name = F.when(role.isin("user", "human"), F.lit("User")).when(role.isin("assistant", "ai"), F.lit("Assistant")).otherwise(F.concat(F.upper(F.substring(role, 1, 1)), F.substring(role, 2, 1_000)))
        return F.concat(name, F.lit(": "), without_special_tokens(m["content"]))

    return F.array_join(F.transform(F.filter(col(messages), lambda m: F.coalesce(m["content"] != "", F.lit(False))), line), "\n\n")


def bad_alternation(messages: str | Column) -> Column:
    """Turns, but for a first system one, do not go user, assistant, user and so on."""
    roles = F.transform(col(messages), lambda m: m["role"])
    turns = F.when(F.try_element_at(roles, F.lit(1)) == "system", F.slice(roles, 2, 1_000_000)).otherwise(roles)
    ok = F.forall(F.transform(turns, lambda r, i: F.coalesce(r == F.when(i % 2 == 0, "user").otherwise("assistant"), F.lit(False))), lambda x: x)
    return ~F.coalesce(ok, F.lit(False))


def toxic(flag: str | Column) -> Column:
    """Only a known flag removes: null keeps."""
    return F.coalesce(col(flag).cast("boolean"), F.lit(False))


def other_language(lang: str | Column, wanted: str) -> Column:
    """Languages compare without case; an unknown language is removed."""
    return ~F.coalesce(F.lower(col(lang)) == wanted.lower(), F.lit(False))


def outside_words(text: str | Column, least: int, most: int) -> Column:
    n = F.size(split_ws(F.coalesce(col(text), F.lit(""))))
    return (n < least) | (n > most)


def first_reason(**filters: Column) -> Column:
    """Name of the first filter that removes a row, null for a row that stays."""
    reason = F.lit(None).cast("string")
    for name, removes in reversed(filters.items()):
        reason = F.when(removes, F.lit(name)).otherwise(reason)
    return reason


def carries_tag(tags: str | Column, removed: list[str], spellings: dict[str, list[str]] | None = None) -> Column:
    """Some tag is to be removed, in any of its spellings; rows without tags stay."""
    names = [s for t in removed for s in [t, *(spellings or {}).get(t, [])]]
    return F.coalesce(F.arrays_overlap(col(tags), F.array(*[F.lit(n) for n in names])), F.lit(False)) if names else F.lit(False)


def unfinished_dialogue(messages: str | Column) -> Column:
    """A turn is empty, or the last one is not the assistant's."""
    last = F.try_element_at(F.transform(col(messages), lambda m: m["role"]), F.lit(-1))
    return has_empty_message(messages) | ~F.coalesce(last == "assistant", F.lit(False))


def holds_role_marks(text: str | Column) -> Column:
    """A response that goes on to speak for others."""
    return F.coalesce(col(text).contains("Human:") | col(text).contains("Assistant:"), F.lit(True))


def passed_tests(tests: str | Column, results: str | Column, least: float = 0.85) -> Column:
    """The tests that were passed, null where fewer than the share were."""
    kept = F.transform(F.filter(F.arrays_zip(col(tests).alias("t"), col(results).alias("r")), lambda z: z["r"] == 1), lambda z: z["t"])
    return F.when(F.size(kept) >= least * F.size(col(tests)), kept)
