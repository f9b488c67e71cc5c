"""Chat templates, tokens and label masks.

A template is a value: what stands before and behind each role's content, what the last turn
and the generation prompt add.  Rendering is one fold of array functions, so it stays in the
JVM.  Tokenizers are pluggable; the default one splits on blanks and is exact in SQL.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwright.functions.text import col

# ---- Fixed values: wording that models of the published formats expect ----------------------
R1_PREAMBLE = (
    "A conversation between User and Assistant. The user asks a question, and the Assistant solves it. The assistant first thinks about the reasoning process in "
    "the mind and then provides the user with the answer. The reasoning process and answer are enclosed within <think> </think> and <answer> </answer> tags, respectively, "
    "i.e., <think> reasoning process here </think> <answer> answer here </answer>.\n\n"
)
BOXED_REQUEST = (
    "You must put your answer inside <answer> </answer> tags, i.e., <answer> answer here </answer>. And your final answer will be extracted automatically by the \\boxed{} tag. This is the problem: "
)
ANSWER_PREAMBLE = (
    "Solve the following problem step by step. The last line of your response should be the answer to the problem in form Answer: $Answer (without quotes) where $Answer is the answer to the problem.\n\n"
)
NO_FUNCTIONS = " You do not currently have access to any functions. <functions></functions>"
# ---------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Template:
    """``roles`` maps a role to (before, behind); ``*`` stands for any other, a missing role is left out.

    ``{eos}`` is the end token, ``{Role}`` the capitalised role.  ``between`` parts turns.
    ``last`` replaces what is behind the last turn if that is the assistant's.
    """

    roles: dict[str, tuple[str, str]]
    between: str = ""
    preamble: str = ""
    last: str | None = None
    close: str = ""
    generation: str = ""
    default_system: str | None = None
    drop_thinking: bool = False
    only_last_thinking: bool = False


def _tagged(generation: str = "<|assistant|>\n", **more: object) -> Template:
    roles = {"system": ("<|system|>\n", "\n"), "user": ("<|user|>\n", "\n"), "assistant": ("<|assistant|>\n", "{eos}\n")}
    return Template(roles, last="{eos}", generation=generation, **more)


def _bracketed(default_system: str | None = "You are a helpful AI assistant.", generation: str = "<|im_start|>assistant\n", **more: object) -> Template:
    roles = {
        "system": ("<|im_start|>system\n", NO_FUNCTIONS + "<|im_end|>\n"), "user": ("<|im_start|>user\n", "<|im_end|>\n"),
        "assistant": ("<|im_start|>assistant\n", "<|im_end|>\n"), "environment": ("<|im_start|>environment\n", "<|im_end|>\n"),
    }
    return Template(roles, last="{eos}", default_system=default_system, generation=generation, **more)


TEMPLATES: dict[str, Template] = {
    "simple_concat_with_space": Template({"*": ("", "")}, between=" ", close="{eos}"),
    "simple_concat_with_new_line": Template({"*": ("", "")}, between="\n", close="{eos}"),
    "simple_chat": Template({"*": ("{Role}: ", "")}, between="\n\n", close="{eos}"),
    "assistant_message_only": Template({"assistant": ("", "")}),
    "zephyr": Template({r: (f"<|{r}|>\n", "{eos}\n") for r in ("user", "system", "assistant")}, generation="<|assistant|>\n"),
    "tagged": _tagged(),
    "tagged_thinker": _tagged("<|assistant|>\n<think>"),
    "tagged_thinker_r1_style": _tagged("<|assistant|>\n<think>", preamble=R1_PREAMBLE, drop_thinking=True),
    "bracketed": _bracketed(),
    "bracketed_thinker": _bracketed(generation="<|im_start|>assistant\n<think>"),
    "bracketed_last_thinking": _bracketed(generation="<|im_start|>assistant\n<think>", only_last_thinking=True),
    "zero_answer": Template({"*": ("", "\n")}, between="\n\n", preamble=ANSWER_PREAMBLE, generation='\nRemember to put your answer on its own line after "Answer:"'),
    "r1_simple_chat": Template({"*": ("{Role}: ", "\n")}, between="\n\n", preamble=R1_PREAMBLE, generation="Assistant:"),
    "r1_simple_chat_postpend_think": Template({"*": ("{Role}: ", "\n")}, between="\n\n", preamble=R1_PREAMBLE, generation="Assistant: <think>"),
    "r1_simple_chat_boxed": Template({"*": ("{Role}: " + BOXED_REQUEST, "\n")}, between="\n\n", preamble=R1_PREAMBLE, generation="Assistant: <think>"),
}


def render(messages: str | Column, template: str | Template, eos: str = "</s>", add_generation: bool = False) -> Column:
    """The conversation as one string.  Null contents count as empty, null conversations stay null."""
    t = TEMPLATES[template] if isinstance(template, str) else template
    m, n = col(messages), F.size(col(messages))
    known = [r for r in t.roles if r != "*"]

    def one(x: Column, i: Column) -> Column:
        role, text = x["role"], F.coalesce(x["content"], F.lit(""))
        if t.drop_thinking:
            text = F.when(role == "assistant", F.element_at(F.split(text, "</think>"), -1)).otherwise(text)
        if t.only_last_thinking:
            cut = F.regexp_replace(F.element_at(F.split(text, "</think>"), -1), r"\A\n+", "")
            text = F.when((role == "assistant") & (i < n - 1) & text.contains("</think>") & text.contains("<think>"), cut).otherwise(text)
        name = F.concat(F.upper(F.substring(role, 1, 1)), F.lower(F.substring(role, 2, 1_000)))

        def around(r: str) -> Column:
            before, behind = (s.replace("{eos}", eos) for s in t.roles[r])
            head = F.concat(*[F.lit(p) if k % 2 == 0 else name for k, p in enumerate(_split(before))])
            tail = F.lit(behind)
            if r == "assistant" and t.last is not None:
                tail = F.when(i == n - 1, F.lit(t.last.replace("{eos}", eos))).otherwise(tail)
            return F.concat(head, text, tail)

        out = around("*") if "*" in t.roles else F.lit(None).cast("string")
        for r in reversed(known):
            out = F.when(role == r, around(r)).otherwise(out)
        return out

    body = F.array_join(F.filter(F.transform(m, one), lambda x: x.isNotNull()), t.between)
    if t.default_system is not None:
        head = f"<|im_start|>system\n{t.default_system}{NO_FUNCTIONS}<|im_end|>\n"
        body = F.concat(F.when(F.exists(m, lambda x: F.coalesce(x["role"] == "system", F.lit(False))), F.lit("")).otherwise(F.lit(head)), body)
    end = t.generation if add_generation else t.close.replace("{eos}", eos)
    return F.concat(F.lit(t.preamble), body, F.lit(end))


def _split(s: str) -> list[str]:
    """Literal parts around ``{Role}``: odd entries stand for the role's name."""
    out: list[str] = []
    for k, p in enumerate(s.split("{Role}")):
        out += ["", p] if k else [p]
    return out


# ---- Tokens -----------------------------------------------------------------------------------


@dataclass(frozen=True)
class Tokenizer:
    """``encode`` maps a text to ids; ``make`` builds it once per Python worker."""

    make: Callable[[], Callable[[str], list[int]]]
    name: str = "own"


def byte_tokenizer() -> Tokenizer:
    return Tokenizer(lambda: lambda s: list(s.encode()), "bytes")


def file_tokenizer(path: str) -> Tokenizer:
    """A ``tokenizers`` JSON file; marks in a text are ordinary text."""

    def make() -> Callable[[str], list[int]]:
        from tokenizers import Tokenizer as Native

        t = Native.from_file(path)
        t.encode_special_tokens = True
        return lambda s: t.encode(s, add_special_tokens=False).ids

    return Tokenizer(make, path)


@dataclass(frozen=True)
class Masking:
    """Which turns keep their labels: ``all``, ``assistant``, ``last`` or ``answer`` (all but the prompt)."""

    keep: str = "assistant"
    longest: int | None = None
    template: str = "tagged"
    eos: str = "</s>"
    more: dict = field(default_factory=dict)


def spans(messages: list[dict], render_prefix: Callable[[int, bool], str], keep: str) -> list[tuple[int, int]]:
    """Character stretches of the rendered text whose labels are kept."""
    n = len(messages)
    kept = []
    for i, m in enumerate(messages):
        if keep == "all" or (keep == "assistant" and m["role"] == "assistant") or (keep in ("last", "answer") and i == n - 1):
            start = len(render_prefix(i, m["role"] == "assistant")) if i else (len(render_prefix(0, True)) if m["role"] == "assistant" else 0)
            kept.append((start if keep != "all" else 0, len(render_prefix(i + 1, False))))
    return kept


def python_render(t: Template, messages: list[dict], upto: int, generation: bool, eos: str, whole: int) -> str:
    """The first ``upto`` turns as they stand in the rendering of ``whole`` turns."""
    parts = []
    for i, m in enumerate(messages[:upto]):
        r = m["role"] if m["role"] in t.roles else "*"
        if r not in t.roles:
            continue
        before, behind = (s.replace("{eos}", eos).replace("{Role}", m["role"].capitalize()) for s in t.roles[r])
        if r == "assistant" and t.last is not None and i == whole - 1:
            behind = t.last.replace("{eos}", eos)
        parts.append(before + (m["content"] or "") + behind)
    gap = t.between if parts and generation and upto < whole else ""
    return t.preamble + t.between.join(parts) + gap + (t.generation if generation else "")


def tokenize_masked(df: DataFrame, key: str, messages: str, tokenizer: Tokenizer, masking: Masking) -> DataFrame:
    """``key, input_ids, attention_mask, labels``: labels are -100 outside the kept turns.

    Each stretch of the text is encoded by itself, so a label never straddles a turn.  Rows are
    truncated at ``longest``.  Null or empty conversations give empty arrays.
    """
    t = TEMPLATES[masking.template]
    kind = dict(df.dtypes)[key]

    def encode(ms: list | None, enc: Callable[[str], list[int]]) -> tuple[list[int], list[int], list[int]]:
        ms = [] if ms is None else [{"role": m["role"], "content": m["content"] or ""} for m in ms]
        n = len(ms)
        text = python_render(t, ms, n, False, masking.eos, n)
        ids: list[int] = []
        labels: list[int] = []
        at = 0
        for a, b in spans(ms, lambda i, g: python_render(t, ms, i, g, masking.eos, n), masking.keep):
            a, b = max(a, at), min(b, len(text))
            for piece, kept in ((text[at:a], False), (text[a:b], True)):
                x = enc(piece) if piece else []
                ids += x
                labels += x if kept else [-100] * len(x)
            at = max(at, b)
        tail = enc(text[at:]) if text[at:] else []
        ids, labels = ids + tail, labels + [-100] * len(tail)
        cut = masking.longest or len(ids)
        return ids[:cut], [1] * len(ids[:cut]), labels[:cut]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = tokenizer.make()
        for b in batches:
            rows = [encode(m, enc) for m in b["_m"]]
            yield pd.DataFrame({key: b[key], "input_ids": [r[0] for r in rows], "attention_mask": [r[1] for r in rows], "labels": [r[2] for r in rows]})

    ids = "array<int>"
    return df.select(key, F.col(messages).alias("_m")).mapInPandas(run, f"{key} {kind}, input_ids {ids}, attention_mask {ids}, labels {ids}")


def token_count(text: str | Column, tokenizer: Tokenizer) -> Column:
    """Tokens of each text, 0 for null."""

    @F.pandas_udf(T.IntegerType())
    def n(s: pd.Series) -> pd.Series:
        enc = tokenizer.make()
        return s.map(lambda x: len(enc(x)) if x else 0)

    return n(text)


def has_labels(labels: str | Column) -> Column:
    """Some label is not ignored."""
    return F.coalesce(F.exists(col(labels), lambda x: x != -100), F.lit(False))


def fits(ids: str | Column, longest: int) -> Column:
    return F.coalesce(F.size(col(ids)) <= longest, F.lit(False))


def truncate_messages(messages: str | Column, budget: int, size: Callable[[Column], Column]) -> Column:
    """System messages first, then turns in order, while their sizes fit the budget; their order stays."""
    m = F.transform(col(messages), lambda x, i: F.struct(x["role"].alias("role"), x["content"].alias("content"), i.alias("i"), (F.coalesce(x["role"], F.lit("")) != "system").cast("int").alias("late")))
    ordered = F.array_sort(F.transform(m, lambda x: F.struct(x["late"].alias("late"), x["i"].alias("i"), x["role"].alias("role"), x["content"].alias("content"))))
    start = F.struct(F.lit(0).alias("n"), F.lit(False).alias("full"), F.array().cast("array<struct<i:int,role:string,content:string>>").alias("kept"))
    fold = F.aggregate(
        ordered, start,
        lambda a, x: F.when(a["full"] | (a["n"] + size(x["content"]) > budget), F.struct(a["n"].alias("n"), F.lit(True).alias("full"), a["kept"].alias("kept")))
        .otherwise(F.struct((a["n"] + size(x["content"])).alias("n"), a["full"].alias("full"), F.concat(a["kept"], F.array(F.struct(x["i"].alias("i"), x["role"].alias("role"), x["content"].alias("content")))).alias("kept"))),
        lambda a: a["kept"],
    )
    return F.transform(F.array_sort(fold), lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content")))


def prompt_of(messages: str | Column, system: str | None = None) -> Column:
    """The turns a model is asked with: not a last assistant turn behind others; a given system prompt replaces one."""
    m = col(messages)
    last = F.try_element_at(m, F.lit(-1))
    p = F.when((F.size(m) > 1) & (last["role"] == "assistant"), F.slice(m, F.lit(1), F.greatest(F.size(m) - 1, F.lit(0)))).otherwise(m)
    if system is None:
        return p
    rest = F.when(F.coalesce(F.try_element_at(p, F.lit(1))["role"] == "system", F.lit(False)), F.slice(p, 2, 1_000_000)).otherwise(p)
    return F.concat(F.array(F.struct(F.lit("system").alias("role"), F.lit(system).alias("content"))), rest)


def raw_prompt(messages: str | Column) -> Column:
    """``role: content`` lines."""
    return F.array_join(F.transform(col(messages), lambda m: F.concat_ws(": ", m["role"], F.coalesce(m["content"], F.lit("")))), "\n")


def encode_column(text: str | Column, tokenizer: Tokenizer, pad: int | None = None) -> Column:
    """Token ids of a text, without padding tokens; empty for null."""

    @F.udf(T.ArrayType(T.IntegerType()), useArrow=True)
    def ids(s: str) -> list[int]:
        if not s:
            return []
        enc = _made.get(tokenizer.name) or _made.setdefault(tokenizer.name, tokenizer.make())
        return [x for x in enc(s) if x != pad]

    return ids(text)


_made: dict[str, Callable] = {}


def prompt_tokens(df: DataFrame, key: str, messages: str, tokenizer: Tokenizer, template: str = "tagged_thinker", system: str | None = None, longest: int | None = None) -> DataFrame:
    """``key, input_ids_prompt, prompt``: tokens with a generation prompt, and the raw prompt; longer ones go."""
    p = df.where(F.size(messages) > 0).select(key, prompt_of(messages, system).alias("_p"))
    out = p.select(key, encode_column(render("_p", template, add_generation=True), tokenizer).alias("input_ids_prompt"), raw_prompt("_p").alias("prompt"))
    return out if longest is None else out.where(fits("input_ids_prompt", longest))


def preference_tokens(df: DataFrame, key: str, chosen: str, rejected: str, tokenizer: Tokenizer, masking: Masking) -> DataFrame:
    """Both sides tokenized and masked alike; a pair stays when both have a label left."""
    sides = []
    for name, c in (("chosen", chosen), ("rejected", rejected)):
        t = tokenize_masked(df, key, c, tokenizer, masking)
        sides.append(t.select(key, *[F.col(x).alias(f"{name}_{x}") for x in ("input_ids", "labels", "attention_mask")]))
    return sides[0].join(sides[1], key).where(has_labels("chosen_labels") & has_labels("rejected_labels"))


def last_user_query(text: str | Column) -> Column:
    """The user turn before the assistant starts to think, in tagged or bracketed chats; the whole text if there is none."""
    t = col(text)
    tagged = F.regexp_extract_all(t, F.lit(r"(?s)<\|user\|>\n((?:(?!<\|user\|>).)*?)\n<\|assistant\|>\n<think>"), F.lit(1))
    bracketed = F.regexp_extract_all(t, F.lit(r"(?s)<\|im_start\|>user\n((?:(?!<\|im_start\|>).)*?)(?:\n<functions>.*?</functions>)?<\|im_end\|>\n(?=.*?<\|im_start\|>assistant\n<think>)"), F.lit(1))
    found = F.concat(tagged, bracketed)
    return F.when(F.size(found) > 0, F.trim(F.try_element_at(found, F.lit(-1)))).otherwise(t)


def messages_of(df: DataFrame, key: str, messages: str, role: str = "user") -> DataFrame:
    """``key, pos, text``: one row per message of a role, as a text index takes them."""
    return df.select(key, F.posexplode(messages).alias("pos", "m")).where((F.col("m.role") == role) & F.col("m.content").isNotNull()).select(key, "pos", F.col("m.content").alias("text"))


def truncate_tokens(text: str | Column, tokenizer: Tokenizer, budget: int, decode: Callable[[list[int]], str]) -> Column:
    """The text of the first ``budget`` tokens; a shorter text stays as it is."""

    @F.udf(T.StringType(), useArrow=True)
    def cut(s: str) -> str:
        if not s:
            return s
        enc = _made.get(tokenizer.name) or _made.setdefault(tokenizer.name, tokenizer.make())
        ids = enc(s)
        return s if len(ids) <= budget else decode(ids[:budget])

    return cut(text)


def within_context(n_tokens: str | Column, answer_tokens: int, window: int, margin: int = 0) -> Column:
    """Whether prompt, answer and a margin fit a context window."""
    return F.coalesce(col(n_tokens) + answer_tokens + margin <= window, F.lit(False))
