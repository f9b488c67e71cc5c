"""What single public corpora need beside a conversion: subsets, samples, joins, questions with answers, loaders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwright.functions.text import col, strip
from loomwright.operators.convert import message
from loomwright.operators.mix import global_index, lowest, shuffle_key, stratified

# ---- Fixed values: how subsets are told, how many rows of each are taken, how questions are put ----
SUBSETS: dict[str, dict[str, str]] = {
    "wildchat": {"gpt4": "contains(model, 'gpt-4')", "gpt35": "contains(model, 'gpt-3.5')"},
    "web_instruct": {"stackexchange": "source IN ('mathstackexchange', 'stackexchange')", "socratic": "source = 'socratic'"},
    "open_math_instruct": {"gsm8k": "contains(problem_source, 'gsm8k')", "math": "contains(problem_source, 'math')"},
    "sciriff": {"science": "startswith(dataset, 'science')"},
}
#: Corpora whose subsets must hold every row between them.
EXHAUSTIVE = ("wildchat", "web_instruct")
FLAN_SIZES = {"cot_fsopt_data": 20000, "cot_zsopt_data": 20000, "niv2_fsopt_data": 20000, "niv2_zsopt_data": 20000, "flan_fsopt_data": 2000, "flan_zsopt_data": 2000, "t0_fsopt_data": 6000}
STEP_BY_STEP = " Let's think step by step and output the final answer within \\boxed{}."
#: Names of transforms, where a name stands for a later version too.
TRANSFORMS = {
    "sft_tokenize_v1": "map", "sft_tokenize_mask_out_prompt_v1": "map", "sft_filter_v1": "filter", "sft_chat_tokenize_and_truncate_v1": "map", "sft_chat_filter_v1": "filter",
    "preference_tokenize_v1": "map", "preference_filter_v1": "filter", "preference_chat_tokenize_and_truncate_v1": "map", "preference_chat_filter_v1": "filter", "rlvr_tokenize_v1": "map", "rlvr_max_length_filter_v1": "filter",
}
VERSIONS = {"preference_chat_tokenize_and_truncate_v1": "preference_chat_tokenize_and_truncate_v1_2", "rlvr_tokenize_v1": "rlvr_tokenize_v3", "rlvr_max_length_filter_v1": "rlvr_max_length_filter_v2"}
# ----------------------------------------------------------------------------------------------------


def transform_named(name: str) -> tuple[str, str]:
    """(version that runs, ``map`` or ``filter``) of a transform's name."""
    if name not in TRANSFORMS:
        raise ValueError(f"unknown transform {name}")
    return VERSIONS.get(name, name), TRANSFORMS[name]


def subset(df: DataFrame, corpus: str, name: str) -> DataFrame:
    """Rows of a subset of a corpus; null in the column that tells is in none."""
    return df.where(F.expr(SUBSETS[corpus][name]))


def with_subset(df: DataFrame, rules: dict[str, str], exhaustive: bool = False) -> DataFrame:
    """One row per row and subset it is in, named in ``subset``; where they must be exhaustive, a row in none or in two is an error."""
    named = F.filter(F.array(*[F.when(F.expr(rule), F.lit(name)) for name, rule in rules.items()]), lambda x: x.isNotNull())
    held = df.withColumn("subset", named)
    if exhaustive:
        fail = F.raise_error(F.lit("a row is in no subset, or in several")).cast("array<string>")
        held = held.withColumn("subset", F.when(F.size("subset") == 1, F.col("subset")).otherwise(fail))
    return held.withColumn("subset", F.explode("subset"))


def model_matches(df: DataFrame, pattern: str, model: str = "model") -> DataFrame:
    """Rows whose model's name holds a pattern somewhere."""
    return df.where(F.col(model).rlike(pattern))


def keep_models(df: DataFrame, include: list[str] | None = None, ignore: list[str] | None = None, model: str = "model") -> DataFrame:
    """Rows of the models named, or of all, but those to be ignored; null names stay unless models are named."""
    df = df.where(F.col(model).isin(include)) if include else df
    return df.where(F.col(model).isNull() | ~F.col(model).isin(ignore)) if ignore else df


def sampled_subsets(df: DataFrame, by: str, key: str, sizes: dict[str, int] | None = None, seed: int = 42) -> DataFrame:
    """At most so many rows of each subset, by hash; subsets without a size give none."""
    return stratified(df, by, key, sizes or FLAN_SIZES, seed)


def with_all_outputs(rows: DataFrame, data: DataFrame, key: str) -> DataFrame:
    """Every output that ``data`` holds for a row's key, and how many there are (``num_outputs``); a key repeated in ``rows`` repeats them."""
    counted = data.join(data.groupBy(key).agg(F.count("*").alias("num_outputs")), key)
    return rows.select(key).join(counted, key)


def questions(df: DataFrame, question: str, answer: str, prompt: str = "", mark: str = "", verifier: str = "re_search") -> DataFrame:
    """``messages, ground_truth, dataset`` of questions; an array of accepted answers is kept as JSON."""
    many = dict(df.dtypes)[answer].startswith("array")
    truth = F.to_json(F.col(answer)) if many else F.col(answer).cast("string")
    content = F.concat(F.lit(prompt), F.col(question), F.lit(mark))
    rest = [c for c in df.columns if c not in (question, answer)]
    return df.select(*rest, F.array(message("user", content)).alias("messages"), truth.alias("ground_truth"), F.lit(verifier).alias("dataset"))


def thinking_length(key: str | Column, longest: int, seed: int = 42, least: int = 100) -> Column:
    """A length in ``least`` to ``longest - 1``, by a hash of the key."""
    part = F.conv(F.substring(shuffle_key(seed, key), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
    return (least + F.floor(part * (longest - least))).cast("int")


def problems(df: DataFrame, key: str, problem: str, answer: str, longest: int | None = None, solve: bool = True, seed: int = 42) -> DataFrame:
    """``key, messages, ground_truth, dataset`` of mathematical problems.

    With ``longest`` the prompt asks for a number of tokens to think, and the label is that
    number: beside the answer, or alone where the answer is not to be checked.
    """
    text = F.concat(strip(problem), F.lit(STEP_BY_STEP))
    if longest is None:
        return df.select(key, F.array(message("user", text)).alias("messages"), F.array(F.col(answer).cast("string")).alias("ground_truth"), F.array(F.lit("math")).alias("dataset"))
    n = thinking_length(key, longest, seed).cast("string")
    text = F.concat(text, F.lit(" Think for "), n, F.lit(" tokens."))
    labels, names = ([F.col(answer).cast("string")], ["math"]) if solve else ([], [])
    return df.select(key, F.array(message("user", text)).alias("messages"), F.array(*labels, n).alias("ground_truth"), F.array(*map(F.lit, [*names, "max_length"])).alias("dataset"))


def thinker_messages(messages: str | Column, opens: str = "<|reserved_special_token_246|>", closes: str = "<|reserved_special_token_247|>") -> Column:
    """Messages whose marks of thinking are tags: what follows the thinking is an answer, closed at the end.  Null contents stay null."""
    def one(m: Column) -> Column:
        c = F.replace(F.replace(m["content"], F.lit(opens), F.lit("<think>")), F.lit(closes), F.lit("</think><answer>"))
        return F.struct(m["role"].alias("role"), F.when(c.contains("<answer>"), F.concat(c, F.lit("</answer>"))).otherwise(c).alias("content"))

    return F.transform(col(messages), one)


def last_answer(messages: str | Column) -> Column:
    """What the last turn says behind its thinking, without answer tags."""
    c = F.substring_index(F.try_element_at(col(messages), F.lit(-1))["content"], "</think>", -1)
    return F.replace(F.replace(c, F.lit("<answer>")), F.lit("</answer>"))


def thoughts(df: DataFrame, question: str, reasoning: str, answer: str, verifier: str = "thinker") -> DataFrame:
    """``messages, ground_truth, dataset`` of questions with reasoning and answer; rows where one is null or empty are left out."""
    rest = [c for c in df.columns if c not in (question, reasoning, answer)]
    full = df.where((F.col(question) != "") & (F.col(reasoning) != "") & (F.col(answer) != ""))
    said = F.concat(F.lit("<think>"), reasoning, F.lit("</think><answer>"), answer, F.lit("</answer>"))
    return full.select(*rest, F.array(message("user", F.col(question)), message("assistant", said)).alias("messages"), F.col(answer).alias("ground_truth"), F.lit(verifier).alias("dataset"))


def first_annotation(annotations: str | Column, name: str) -> Column:
    """A field of the first annotation of a list, null where there is none."""
    return F.try_element_at(col(annotations), F.lit(1))[name]


def with_results(rows: DataFrame, results: DataFrame, key: str, order: list[Column] | None = None) -> DataFrame:
    """One row per result of a batch: the columns of the row with its id and those of the result, which win where names clash.

    Results without a row are left out; of rows with one id the last in ``order`` is taken, or any without an order.
    """
    kept = [c for c in rows.columns if c not in results.columns or c == key]
    w = Window.partitionBy(key).orderBy(*(order or [F.lit(0)]))
    last = rows.withColumn("_rn", F.row_number().over(w)).withColumn("_n", F.count("*").over(Window.partitionBy(key))).where("_rn = _n").select(*kept)
    return last.join(results, key)


def bare_prompt(prompt: str | Column) -> Column:
    """A prompt without the speaker before it and the one behind it, stripped."""
    p = col(prompt)
    p = F.when(p.startswith("Human:"), F.substring(p, 7, 1 << 30)).otherwise(p)
    return strip(F.when(p.endswith("Assistant:"), F.left(p, F.length(p) - 10)).otherwise(p))


def lists_per_prompt(df: DataFrame, prompt: str, order: list[Column], first: list[str], lists: dict[str, str]) -> DataFrame:
    """One row per prompt: the first value of some columns, the list of others, both in the given order.

    A prompt's rows (its models) come together in one row.
    """
    packed = F.array_sort(F.collect_list(F.struct(*(c.alias(f"_o{k}") for k, c in enumerate(order)), *(F.col(c) for c in {*first, *lists}))))
    x = df.groupBy(prompt).agg(packed.alias("_x"))
    return x.select(prompt, *(F.get("_x", F.lit(0))[c].alias(c) for c in first), *(F.col("_x")[c].alias(name) for c, name in lists.items()))


def against_others(df: DataFrame, side: DataFrame, prompt: str, model: str, response: str, seed: int = 42) -> DataFrame:
    """``prompt, models, completions``: one model's responses, each against one of the others', on sides by hash."""
    w = Window.partitionBy(prompt).orderBy(shuffle_key(seed, prompt, model), model)
    other = df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").select(F.col(prompt).alias("_p"), F.col(model).alias("_m"), F.col(response).alias("_r"))
    both = side.join(other, F.col(prompt) == F.col("_p"))
    swap = F.conv(F.substring(shuffle_key(seed + 1, prompt), 1, 8), 16, 10).cast("double") < float(1 << 31)
    pair = lambda a, b: F.when(swap, F.array(F.col(b), F.col(a))).otherwise(F.array(F.col(a), F.col(b)))
    return both.select(prompt, pair(model, "_m").alias("models"), pair(response, "_r").alias("completions"))


def epoch_batches(df: DataFrame, key: str, world: int, rank: int, per_batch: int, seed: int = 42, epoch: int = 0, excluded: DataFrame | None = None) -> DataFrame:
    """``key, batch``: a rank's share of the rows in the epoch's order, in full batches.

    Rows are numbered in the order of the key and dealt round robin, so a rank keeps its rows; each
    epoch orders them anew; excluded keys and the rest under a batch are left out.
    """
    mine = global_index(df.select(key), [F.col(key)]).where(F.col("_row_idx") % world == rank).select(key)
    mine = mine.join(excluded.select(key), key, "left_anti") if excluded is not None else mine
    placed = global_index(mine, [shuffle_key(seed + epoch, key), F.col(key)])
    n = mine.count() // per_batch * per_batch
    return placed.where(F.col("_row_idx") < n).select(key, F.floor(F.col("_row_idx") / per_batch).cast("int").alias("batch"))


def first_informative(df: DataFrame, group: str, reward: str, order: str, n: int) -> DataFrame:
    """Rows of the first ``n`` groups, by their least ``order``, whose rewards differ: sampling goes on until a batch is full of them."""
    g = df.groupBy(group).agg(F.min(reward).alias("_lo"), F.max(reward).alias("_hi"), F.min(order).alias("_first")).where("_lo < _hi")
    return df.join(lowest(g.select(group, "_first"), n, F.col("_first"), F.col(group)).select(group), group, "left_semi")


def rows_at(df: DataFrame, order: list[Column], at: int | slice | list[int]) -> DataFrame:
    """Rows by number, slice or list of numbers in an order; negative ones count from the end."""
    x = global_index(df, order)
    n = x.count()
    if isinstance(at, slice):
        start, stop, step = at.indices(n)
        if step < 0:
            raise ValueError("slices go forward")
        here = (F.col("_row_idx") >= start) & (F.col("_row_idx") < stop) & ((F.col("_row_idx") - start) % step == 0)
        return x.where(here).drop("_row_idx")
    wanted = [at] if isinstance(at, int) else list(at)
    if any(not -n <= k < n for k in wanted):
        raise IndexError(f"no row {wanted} of {n}")
    return x.where(F.col("_row_idx").isin([k % n for k in wanted])).drop("_row_idx")
