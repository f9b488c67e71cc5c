"""Problem 3: texts cut off before their end.

A character n-gram model, read backwards from a position, tells how often texts end (a line
ends) behind a context and how often they go on.  Contexts of 10, 6, 3 and 1 characters
are counted at every position of every line outside code, per language, where a bit map of all texts'
final contexts says that some text may ask for them; digits count as one
character and lines are padded at their start, so that short lines are known as wholes.
Each distinct text counts once, however often it stands.
The final context of a text is judged by the longest of its contexts with enough evidence,
without the text's own end, as log-odds of ending against going on.  The threshold is found
per language from all texts: the point between the two groups of log-odds.

Shapes that no model of contexts can know are settled first: an open fenced code block is cut
off, a closed one is whole; texts without content, short answers, signatures and addresses on
a line of their own are no case.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwright.llm.boundaries import ENDS, SPEAKERS, ends_at_dot
from loomwright.llm.languages import LANGUAGES, language
from loomwright.session import cut_lineage
from loomwright.sources.tables import table

ORDERS = (10, 6, 3, 1)
#: Times a context must be seen elsewhere before it is believed.
EVIDENCE = {10: 12, 6: 25, 3: 40, 1: 1}
FLUSH_CHARS = 1 << 21
#: Log-odds are looked at between these bounds when the threshold is sought.
LOW, HIGH, STEP = -8.0, 2.0, 0.25
#: Shift of the threshold for a line without and with a mark that seems to end a sentence.
NO_END, SEEMING_END = 1.0, -2.0

#: In place of a context that may not judge; hashes are not negative.
NOT_ASKED = -1
#: Bits of the map of final contexts, as powers of two: 16 for each, 16 MB at most.
LEAST_BITS, MOST_BITS = 16, 27

_MARKS = re.compile(r"<\|[^|<>]*\|>")
_SPEAKER = re.compile(rf"^\s*[*\[]*(?:{'|'.join(map(re.escape, sorted(SPEAKERS, key=len, reverse=True)))})[*\]]*\s*[:：][*\]]*", re.I | re.M)
_FENCE = re.compile(r"^[ \t]*(```+|~~~+)", re.M)
_ARTIFACT = re.compile(r"(?:(?<!\\)\\(?:u[0-9a-fA-F]{0,3})?|&(?:#x?[0-9a-fA-F]{0,6}|am|amp|lt|gt|qu|quo|quot|nb|nbs|nbsp|ap|apo|apos)|�)\Z")
_SHORT = re.compile(r"(?:\#{1,6}\s*)?[\\$()\[\]{}\w.,:%+\-*/=^°€£~'’]{1,24}\Z")
_ADDRESS = re.compile(r"(?:[<(\[]?)(?:\w+://\S+|[\w.+-]+@[\w-]+(?:\.[\w-]+)+|[\w-]+(?:\.[\w-]+)+(?:/[^\s]*)?)[>)\]]?\Z")
_SIGNATURE = re.compile(r"(?:—|–|--?|~)\s*\S{1,24}(?:\s\S{1,24}){0,3}\Z")
_LIST_LINE = re.compile(r"(?:[-*+•‣◦▪●·]|\d{1,3}[.)])\s")
_EAST = re.compile(r"[぀-ヿ㐀-鿿가-힣]")
_P = np.uint64(0x9E3779B97F4A7C15)
_PADDING = "\x02" * max(ORDERS)


def has_content(text: str | None) -> bool:
    """Whether a letter or digit is left besides speaker labels and ``<|...|>`` marks."""
    return bool(text) and any(c.isalnum() for c in _SPEAKER.sub("", _MARKS.sub("", text)))


def _name_like(line: str) -> bool:
    words = line.split()
    if _EAST.search(line):
        return len(line) <= 8
    return len(words) <= 3 and len(line) <= 40 and all(w[0].isupper() and w[1:].isalpha() for w in words) if all(words) else False


def shape_verdict(text: str) -> str:
    """``cut``, ``whole``, ``none`` (no content), ``name`` (whole unless its line often goes on) or ``model``."""
    if not has_content(text):
        return "none"
    fence, last_fence = "", -1
    for m in _FENCE.finditer(text):
        if not fence:
            fence = m[1][0]
        elif m[1][0] == fence:
            fence = ""
        last_fence = m.end()
    if fence:
        return "cut"
    body = text.rstrip()
    if last_fence >= 0 and not body[last_fence:].strip():
        return "whole"
    if _ARTIFACT.search(body[-12:]):
        return "cut"
    lines = body.splitlines()
    last = lines[-1].strip()
    alone = not any(x.strip() for x in lines[:-1])
    if alone and _SHORT.match(last) and (len(last) <= 8 or not _EAST.search(last)):
        return "whole" if not last.isalpha() else "name"
    if not alone:
        if _ADDRESS.match(last) or (_SIGNATURE.match(last) and not re.match(r"-\s", last)):
            return "whole"
        if _name_like(last):
            return "name" if len(last) < max(ORDERS) else "whole"  # a shorter one is known from its start
    return "model"


def _bare(line: str) -> str:
    """Without blanks and marks of emphasis behind it."""
    return line.strip().rstrip("*_ ") or line.strip()


def _prose_lines(text: str) -> Iterator[str]:
    """Lines to learn from: no code, and no line that stands for itself by its shape."""
    fence = ""
    for line in text.splitlines():
        m = _FENCE.match(line)
        if m and (not fence or m[1][0] == fence):
            fence = "" if fence else m[1][0]
        elif not fence and (line := _bare(line)) and not (_name_like(line) or _ADDRESS.match(line) or _SIGNATURE.match(line)):
            yield line


def _line_language(line: str, text: str) -> int:
    """A text may change its language from line to line."""
    return LANGUAGES.index(language(line) or language(text))


def _codes(lines: list[str]) -> np.ndarray:
    a = np.frombuffer((_PADDING + _PADDING.join(lines)).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    a[(a >= 48) & (a <= 57)] = 48
    return a


def _hashes(a: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each order, the hash of the context that ends at each position; longest last."""
    acc = np.zeros(len(a), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(max(ORDERS)):
            x = (a + np.uint64(k * 0x110000)) * _P
            x ^= x >> np.uint64(29)
            x *= np.uint64(0xBF58476D1CE4E5B9)
            x ^= x >> np.uint64(32)
            acc[k:] += x[: len(a) - k] if k else x
            if k + 1 in ORDERS:
                yield k + 1, (acc + np.uint64(k + 1)) * np.uint64(0x94D049BB133111EB)


def _counted(lang: int, lines: list[str], bits: np.ndarray) -> Iterator[pd.DataFrame]:
    """Contexts of the lines of one language that the bit map knows: hash, times seen, times at the end of a line."""
    a = _codes(lines)
    real = a != 2
    end = np.zeros(len(a), dtype=bool)
    end[:-1] = real[:-1] & ~real[1:]
    end[-1] = real[-1]
    salt = np.uint64((lang + 1) * 0xD1342543DE82EF95 & 0xFFFFFFFFFFFFFFFF)
    for _, h in _hashes(a):
        key = (((h ^ salt) & ~np.uint64(1)) | end)[real]
        at = (key >> np.uint64(1)).astype(np.int64) & (len(bits) * 8 - 1)
        k, n = np.unique(key[((bits[at >> 3] >> (at & 7)) & 1).astype(bool)], return_counts=True)
        yield pd.DataFrame({"ctx": (k >> np.uint64(1)).astype(np.int64), "n": n, "e": np.where(k & np.uint64(1), n, 0)})


def _last_line(text: str) -> str:
    return _bare(text.rstrip().splitlines()[-1]) or " "


def final_contexts(langs: list[int], lines: list[str]) -> np.ndarray:
    """Hashes of the final contexts of lines, one row per line, longest order first."""
    if not lines:
        return np.zeros((0, len(ORDERS)), dtype=np.int64)
    a = _codes(lines)
    ends = np.cumsum([len(_PADDING) + len(x) for x in lines]) - 1
    with np.errstate(over="ignore"):
        salt = (np.array(langs, dtype=np.uint64) + np.uint64(1)) * np.uint64(0xD1342543DE82EF95)
    return np.stack([(((h[ends] ^ salt) & ~np.uint64(1)) >> np.uint64(1)).astype(np.int64) for _, h in _hashes(a)][::-1], axis=1)


def seems_ended(line: str) -> bool:
    """Whether the rules of sentence boundaries see the end of a sentence."""
    bare = line.rstrip("\"”»」』）)]’'“› ")
    return bool(bare) and (bare[-1] in ENDS or (bare[-1] == "." and ends_at_dot(bare + " X", 0, len(bare) - 1, len(bare))))


def asked_contexts(found: list[int], line: str, ended: bool) -> list[int]:
    """The final contexts that may judge a line; ``NOT_ASKED`` for one that may not.

    Three characters cannot tell the end of a word from an abbreviation, so behind a seeming end
    only longer contexts speak.  The last letter alone says nothing about a list item.
    """
    if ended:
        found[ORDERS.index(3)] = found[ORDERS.index(1)] = NOT_ASKED
    elif _LIST_LINE.match(line):
        found[ORDERS.index(1)] = NOT_ASKED
    return found


def _bit_map(contexts: DataFrame) -> np.ndarray:
    """A bit for each context, or-ed in eight tasks: the driver gets eight maps of 16 MB at most."""
    n = contexts.count()
    bits = 1 << min(MOST_BITS, max(LEAST_BITS, (16 * n).bit_length()))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = np.zeros(bits // 8, dtype=np.uint8)
        for b in batches:
            at = b["ctx"].to_numpy() & (bits - 1)
            np.bitwise_or.at(held, at >> 3, (1 << (at & 7)).astype(np.uint8))
        yield pd.DataFrame({"m": [held.tobytes()]})

    total = np.zeros(bits // 8, dtype=np.uint8)
    for r in contexts.coalesce(8).mapInPandas(run, "m binary").toLocalIterator():
        total |= np.frombuffer(r["m"], dtype=np.uint8)
    return total


def count_contexts(texts: DataFrame, text: str, bit_map: np.ndarray) -> DataFrame:
    """``ctx, n, e`` over all lines of all distinct texts, of the contexts the bit map knows; partly aggregated before the shuffle.

    Copies, also with other line ends or blanks around them, are no evidence for one another.
    """
    asked = texts.sparkSession.sparkContext.broadcast(bit_map.tobytes())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list[str]] = {}
        size, bits = 0, np.frombuffer(asked.value, dtype=np.uint8)

        def flush() -> Iterator[pd.DataFrame]:
            for lang, lines in held.items():
                yield from _counted(lang, lines, bits)
            held.clear()

        for b in batches:
            for t in b["t"]:
                for line in _prose_lines(t):
                    held.setdefault(_line_language(line, t), []).append(line)
                size += len(t)
                if size >= FLUSH_CHARS:
                    yield from flush()
                    size = 0
        yield from flush()

    once = texts.select(F.trim(F.regexp_replace(text, r"\r\n?", "\n"), F.lit(" \t\n")).alias("t")).where("t != ''").distinct()
    parts = once.mapInPandas(run, "ctx long, n long, e long")
    return parts.groupBy("ctx").agg(F.sum("n").alias("n"), F.sum("e").alias("e"))


def log_odds(texts: DataFrame, keys: list[str], text: str) -> DataFrame:
    """``keys, lang, verdict, lo``: log-odds of ending against going on for each text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            verdicts = [shape_verdict(t) for t in b["_t"]]
            lines = [_last_line(t) if v in ("model", "name") else "" for v, t in zip(verdicts, b["_t"])]
            langs = [_line_language(x, t) if x else -1 for x, t in zip(lines, b["_t"])]
            ends = [bool(x) and seems_ended(x) for x in lines]
            verdicts = ["ended" if v == "model" and e else v for v, e in zip(verdicts, ends)]
            out = b[keys].copy()
            out["lang"], out["verdict"] = langs, verdicts
            asked = [i for i, g in enumerate(langs) if g >= 0]
            found = final_contexts([langs[i] for i in asked], [lines[i] for i in asked]).tolist()
            ctxs: list[list[int]] = [[] for _ in langs]
            for i, f in zip(asked, found):
                ctxs[i] = asked_contexts(f, lines[i], ends[i])
            out["ctxs"] = ctxs
            yield out

    d = texts.select(*keys, F.col(text).alias("_t")).where(F.col("_t").isNotNull())
    schema = T.StructType(d.select(*keys).schema.fields + T.StructType.fromDDL("lang int, verdict string, ctxs array<bigint>").fields)
    finals = cut_lineage(d.mapInPandas(run, schema))
    asked = finals.select(*keys, "lang", "verdict", F.posexplode("ctxs").alias("o", "ctx")).where(F.col("ctx") != NOT_ASKED)
    counts = count_contexts(texts, text, _bit_map(asked.select("ctx").distinct()))
    need = F.element_at(F.array(*[F.lit(EVIDENCE[o]) for o in ORDERS]), F.col("o") + 1)
    own_n, own_e = F.col("n") - 1, F.col("e") - 1
    met = F.when((own_n >= need) | (F.col("o") == len(ORDERS) - 1), F.struct("o", F.log((own_e + 0.3) / (own_n - own_e + 0.3)).alias("lo"), own_n.alias("n")))
    judged = asked.join(counts, "ctx", "left").groupBy(*keys, "lang", "verdict").agg(F.min(met).alias("best")).select(
        *keys, "lang", "verdict", F.col("best.lo").alias("lo"), F.col("best.o").alias("o"))
    # What its shape has settled is not joined to anything.
    settled = finals.where(F.size("ctxs") == 0).select(*keys, "lang", "verdict", F.lit(None).cast("double").alias("lo"), F.lit(None).cast("int").alias("o"))
    return judged.unionByName(settled.distinct())


def thresholds(odds: DataFrame) -> dict[int, float]:
    """Per language, the point halfway between the two groups of log-odds (isodata on a histogram)."""
    clipped = F.least(F.greatest(F.col("lo"), F.lit(LOW)), F.lit(HIGH))
    rows = odds.where(F.col("verdict").isin("model", "ended") & F.col("lo").isNotNull()).groupBy("lang", F.floor((clipped - LOW) / STEP).alias("b")).count().collect()
    out: dict[int, float] = {}
    for lang in {r["lang"] for r in rows}:
        x = np.array([LOW + (r["b"] + 0.5) * STEP for r in rows if r["lang"] == lang])
        w = np.array([r["count"] for r in rows if r["lang"] == lang], dtype=float)
        t = -3.0
        for _ in range(50):
            left, right = x < t, x >= t
            if not w[left].sum() or not w[right].sum():
                break
            new = ((x[left] * w[left]).sum() / w[left].sum() + (x[right] * w[right]).sum() / w[right].sum()) / 2
            if abs(new - t) < 1e-6:
                break
            t = new
        out[lang] = float(t)
    return out


def truncated(texts: DataFrame, keys: list[str], text: str) -> DataFrame:
    """``keys, cut`` for each text with content: whether it ends before it is complete.

    Null texts and texts without content give no row.  Repeated keys give one row (the texts
    of a key are taken to be the same).  Empty tables give an empty result.  Very long texts
    cost one pass over their characters; only their last line is judged.
    """
    odds = cut_lineage(log_odds(texts, keys, text).where(F.col("verdict") != "none"))
    limits = thresholds(odds)
    limit: Column = F.lit(-3.0)
    for lang, t in limits.items():
        limit = F.when(F.col("lang") == lang, F.lit(t)).otherwise(limit)
    lo = F.coalesce(F.col("lo"), F.lit(0.0))
    name_goes_on = (F.col("verdict") == "name") & (F.col("o") == 0) & (F.col("lo") < limit)
    # A seeming end of a sentence shifts the odds one way, its absence the other.
    cut = (F.col("verdict") == "cut") | ((F.col("verdict") == "model") & (lo < limit + NO_END)) | ((F.col("verdict") == "ended") & (lo < limit + SEEMING_END)) | name_goes_on
    return odds.groupBy(*keys).agg(F.bool_or(cut).alias("cut"))


def _outputs(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "model_outputs")
    return d.select("prompt_hash", "model", "source", F.explode("outputs").alias("o")).select(
        "prompt_hash", "model", "source", F.col("o.index").alias("out_index"), F.col("o.text").alias("text"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Outputs that break off before their end."""
    keys = ["prompt_hash", "model", "out_index"]
    return truncated(_outputs(spark, folder), keys, "text").where("cut").select(*keys)


def p3_share_by_source(spark: SparkSession, folder: str) -> DataFrame:
    """For each source, its outputs, those cut off and their share; sources compare without case and outer blanks."""
    keys = ["source", "prompt_hash", "model", "out_index"]
    out = _outputs(spark, folder).withColumn("source", F.lower(F.trim("source")))
    cut = truncated(out, keys, "text")
    return (
        out.select(*keys).distinct().join(cut.where("cut").withColumnsRenamed({k: f"_{k}" for k in keys}), [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], "left")
        .groupBy("source").agg(F.count("*").alias("n_outputs"), F.count("cut").alias("n_cut"), F.round(F.count("cut") / F.count("*"), 6).alias("share_cut"))
    )


QUERIES = {"p3_found": p3_found, "p3_share_by_source": p3_share_by_source}
SQL: dict[str, str] = {}
