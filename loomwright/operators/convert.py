"""Converters of public formats to one chat schema.  All are projections of array and struct functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwright.functions.text import after_last, col, strip

# ---- Fixed values ---------------------------------------------------------------------------
ROLES = {
    "human": "user", "user": "user", "prompter": "user", "gpt": "assistant", "assistant": "assistant", "chatgpt": "assistant",
    "bard": "assistant", "bing": "assistant", "system": "system", "tool": "tool", "observation": "tool",
}
WITH_INPUT = "Below is an instruction that describes a task, paired with an input that provides further context. Write a response that appropriately completes the request.\n\n### Instruction:\n{0}\n\n### Input:\n{1}\n\n### Response:"
WITHOUT_INPUT = "Below is an instruction that describes a task. Write a response that appropriately completes the request.\n\n### Instruction:\n{0}\n\n### Response:"
# ---------------------------------------------------------------------------------------------


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def turns(*pairs: tuple[str, str | Column]) -> Column:
    return F.array(*[message(r, col(c)) for r, c in pairs])


def _fill(form: str, *values: Column) -> Column:
    parts: list[Column] = []
    rest = form
    for k, v in enumerate(values):
        head, rest = rest.split(f"{{{k}}}")
        parts += [F.lit(head), v]
    return F.concat(*parts, F.lit(rest))


def instruction(instr: str, inp: str, out: str) -> Column:
    """Instruction with an optional input: its fixed wording depends on whether there is one."""
    i, x = col(instr), F.coalesce(col(inp), F.lit(""))
    return turns(("user", F.when(x == "", _fill(WITHOUT_INPUT, i)).otherwise(_fill(WITH_INPUT, i, x))), ("assistant", out))


def conversation(turns_column: str | Column, role: str = "from", content: str = "value") -> Column:
    """From/value turns; roles are mapped, an unknown role fails the job."""
    mapping = F.create_map(*[F.lit(x) for kv in ROLES.items() for x in kv])
    return F.transform(col(turns_column), lambda t: F.struct(F.coalesce(F.element_at(mapping, F.lower(t[role])), F.raise_error(F.concat(F.lit("unknown role "), F.coalesce(t[role], F.lit("null")))).cast("string")).alias("role"), t[content].alias("content")))


def alternating(texts: str | Column) -> Column:
    """A list of strings: the user's at even places, the assistant's at odd ones."""
    return F.transform(col(texts), lambda x, i: F.struct(F.when(i % 2 == 0, "user").otherwise("assistant").alias("role"), x.alias("content")))


#: In the order they are tried: columns that must be there, and the conversion.
DISPATCH: list[tuple[tuple[str, ...], Callable[[], Column]]] = [
    (("instruction", "input", "output"), lambda: instruction("instruction", "input", "output")),
    (("system_prompt", "question", "response"), lambda: F.filter(turns(("system", "system_prompt"), ("user", "question"), ("assistant", "response")), lambda m: ~((m["role"] == "system") & (F.coalesce(m["content"], F.lit("")) == "")))),
    (("prompt", "completion"), lambda: turns(("user", "prompt"), ("assistant", "completion"))),
    (("query", "answer"), lambda: turns(("user", "query"), ("assistant", "answer"))),
    (("query", "response"), lambda: turns(("user", "query"), ("assistant", "response"))),
    (("question", "answer"), lambda: turns(("user", "question"), ("assistant", "answer"))),
    (("inputs", "targets"), lambda: turns(("user", "inputs"), ("assistant", "targets"))),
    (("problem", "generated_solution"), lambda: turns(("user", "problem"), ("assistant", "generated_solution"))),
    (("instruction", "response"), lambda: turns(("user", "instruction"), ("assistant", "response"))),
    (("conversations",), lambda: conversation("conversations")),
    (("chosen", "rejected"), lambda: F.col("chosen")),
    (("messages",), lambda: F.col("messages")),
]


def to_messages(df: DataFrame) -> DataFrame:
    """Adds or replaces ``messages`` by the first conversion whose columns are there."""
    for needed, make in DISPATCH:
        if all(c in df.columns for c in needed):
            return df.withColumn("messages", make())
    raise ValueError(f"no conversion for columns {df.columns}")


def marked_dialogue(text: str | Column, user: str = "\n\nHuman: ", assistant: str = "\n\nAssistant: ") -> Column:
    """Turns of a text with marks; user and assistant turns are paired, a trailing unpaired one is lost."""
    parts = F.filter(F.split(F.concat(F.lit(""), col(text)), r"(?=\Q" + user + r"\E|\Q" + assistant + r"\E)"), lambda p: p.startswith(user) | p.startswith(assistant))
    us = F.transform(F.filter(parts, lambda p: p.startswith(user)), lambda p: strip(F.substring(p, len(user) + 1, 1_000_000_000)))
    bs = F.transform(F.filter(parts, lambda p: p.startswith(assistant)), lambda p: strip(F.substring(p, len(assistant) + 1, 1_000_000_000)))
    n = F.least(F.size(us), F.size(bs))
    return F.flatten(F.transform(F.slice(F.arrays_zip(us.alias("u"), bs.alias("b")), F.lit(1), n), lambda z: F.array(message("user", z["u"]), message("assistant", z["b"]))))


def hashed_answer(text: str | Column) -> Column:
    """What follows ``####``, stripped."""
    return strip(after_last(text, "####"))


def lettered(choices: str | Column, right: str | Column) -> tuple[Column, Column]:
    """Choices sorted without case as ``A. ..`` lines, and the letter of the right one."""
    ordered = F.array_sort(F.transform(col(choices), lambda x: F.struct(F.lower(x).alias("k"), x.alias("v"))))
    lines = F.array_join(F.transform(ordered, lambda x, i: F.concat(F.char(i + 65), F.lit(". "), x["v"])), "\n")
    return lines, F.char(F.array_position(F.transform(ordered, lambda x: x["v"]), col(right)).cast("int") + 64)


def chunk_dialogue(messages: str | Column, size: Callable[[Column], Column], most: int, per_turn: int = 6) -> Column:
    """Dialogues of turn pairs, filled greedily up to a size; a pair over it is skipped, an odd last turn dropped."""
    m = col(messages)
    pairs = F.when(F.size(m) >= 2, F.transform(F.sequence(F.lit(0), F.floor(F.size(m) / 2).cast("int") - 1), lambda i: F.slice(m, i * 2 + 1, 2))).otherwise(F.array().cast("array<array<struct<role:string,content:string>>>"))
    weigh = lambda p: F.aggregate(p, F.lit(0), lambda a, x: a + size(x["content"]) + per_turn)
    none = F.array().cast("array<array<struct<role:string,content:string>>>")
    start = F.struct(F.lit(0).alias("n"), F.array().cast("array<struct<role:string,content:string>>").alias("now"), none.alias("out"))

    def step(a: Column, p: Column) -> Column:
        w = weigh(p)
        same = F.struct((a["n"] + w).alias("n"), F.concat(a["now"], p).alias("now"), a["out"].alias("out"))
        fresh = F.struct(w.alias("n"), p.alias("now"), F.when(F.size(a["now"]) > 0, F.concat(a["out"], F.array(a["now"]))).otherwise(a["out"]).alias("out"))
        return F.when(w > most, F.struct(a["n"].alias("n"), a["now"].alias("now"), a["out"].alias("out"))).when(a["n"] + w <= most, same).otherwise(fresh)

    return F.aggregate(pairs, start, step, lambda a: F.when(F.size(a["now"]) > 0, F.concat(a["out"], F.array(a["now"]))).otherwise(a["out"]))


# ---- Fixed values: where public corpora keep prompt and answer -------------------------------
CORPORA = {
    "aya": ("inputs", "targets"), "flan": ("inputs", "targets"), "coconot": ("prompt", "response"), "codefeedback": ("query", "answer"),
    "evol_codealpaca": ("instruction", "response"), "metamath": ("query", "response"), "open_math_instruct": ("problem", "generated_solution"),
    "table_gpt": ("prompt", "completion"), "web_instruct": ("question", "answer"), "open_code_reasoner": ("input", "output"),
}
DIALOGUES = {"daring_anteater": "conversations", "sharegpt": "conversations", "slim_orca": "conversations", "wizardlm": "conversations"}
READY = {"lmsys_chat": "conversation", "no_robots": "messages", "numinamath": "messages", "sciriff": "messages", "wildchat": "conversation"}
# ---------------------------------------------------------------------------------------------


def corpus(df: DataFrame, name: str, source: str | None = None) -> DataFrame:
    """``id, source, messages`` of a corpus by its name; rows without prompt or answer stay, for the filters."""
    if name in CORPORA:
        m = turns(("user", CORPORA[name][0]), ("assistant", CORPORA[name][1]))
    elif name in DIALOGUES:
        m = F.filter(conversation(DIALOGUES[name]), lambda x: ~((x["role"] == "system") & (F.trim(F.coalesce(x["content"], F.lit(""))) == "")))
    elif name == "lima":
        m = alternating("conversations")
    elif name in READY:
        m = F.transform(READY[name], lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content")))
    else:
        raise ValueError(f"unknown corpus {name}")
    key = F.col("id").cast("string") if "id" in df.columns else F.md5(F.to_json(m))
    return df.select(F.concat_ws("_", F.lit(name), key).alias("id"), F.lit(source or name).alias("source"), m.alias("messages"))


def after_trajectory(trajectory: str | Column, answer: str | Column) -> Column:
    """The turns so far and an answer."""
    return F.concat(F.transform(col(trajectory), lambda t: F.struct(F.when(t["from"] == "user", "user").otherwise("assistant").alias("role"), t["value"].alias("content"))), F.array(message("assistant", col(answer))))


def numbered(quotes: str | Column) -> Column:
    """``1. ..`` paragraphs of a list of quotes, '' for none."""
    return F.coalesce(F.array_join(F.transform(col(quotes), lambda q, i: F.concat((i + 1).cast("string"), F.lit(". "), q)), "\n\n"), F.lit(""))


def few_shot(examples: list[tuple[str, str]], prompt: str | Column, question: str = "Question: ", answer: str = "Answer: ") -> Column:
    """Examples before a prompt, as plain text."""
    head = "".join(f"{question}{q}\n{answer}{a}\n\n" for q, a in examples)
    return F.concat(F.lit(head + question), col(prompt), F.lit("\n" + answer.rstrip()))
