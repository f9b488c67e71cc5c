"""Problem 2: defective answers of prompt and response pairs.

Refusals are found by templates that recur over unrelated prompts.  The sentences an answer opens
with are cut into clauses, the prompt's own words are masked, and the clauses of all answers are
clustered by MinHash, every collision verified (shingles of five words, similarity 0.8).  A
cluster is a template when it recurs over ``LEAST_PROMPTS`` differently worded prompts of at least
``LEAST_TOPICS`` topics and is seldom followed by an answer; a topic is the least hash of a
prompt's content words, so that prompts that share most of their words count once.  Stock answers recur as well, so a template must be named: by
a list of declining phrases that most of its clauses match, or by its company, that is by
courtesies and lead-ins that hardly stand anywhere but in answers with a named template.  An
answer is a refusal when it opens with such a template and nothing is left of it but templates
and their company.  A phrase of the list in a clause that does not recur decides nothing.

The other defects are read off each pair: copied wording by runs of words shared with the
prompt, language per sentence unit against the prompt's or the one it asks for, and
truncation by the model of ``truncation``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwright.llm.boundaries import unit_ends
from loomwright.llm.components import components
from loomwright.llm.languages import _LATIN_WORD, FUNCTION_WORDS, language
from loomwright.llm.truncation import _MARKS, _SPEAKER, _name_like, has_content, truncated
from loomwright.llm.words import WordHasher, shingle_hashes, words_of
from loomwright.session import cut_lineage
from loomwright.sources.tables import table

WIDTH, SIMILARITY = 5, 0.8
BANDS, ROWS = 32, 6
#: Wordings and topics of prompts a template recurs over at least.
LEAST_PROMPTS, LEAST_TOPICS = 3, 2
#: An answer with more words than this behind its opening is taken to have been given.
LONG_REST = 40
#: Share of long answers above which an opening is a hedge, not a refusal.
MOST_ANSWERED = 0.3
#: Shares that make a name: clauses with a phrase of the list; answers in company where no phrase is known.
NAMED, IN_COMPANY = 0.5, 0.5
#: Share of a part's answers that must hold a named template for it to be company.
COMPANY = 0.8
#: Words an answer may hold besides templates and company, and words of a sentence that may be company.
LEFT_OVER, COURTESY_WORDS = 3, 24

# Phrases that decline, and names of languages by the language they stand for.
DECLINE = re.compile(
    r"\b(?:can ?not|can[’']t|won[’']t|unable|not able|declin\w+|not (?:be )?(?:appropriate|permitted|allowed|possible|comfortable|willing)|isn[’']t possible|"
    r"wouldn[’']t be appropriate|no answer|polic(?:y|ies)|rather not|stay (?:away|out)|not something i|something other than|someone (?:qualified|else)|nope|"
    r"not going to|refuse\w*|outside what i|don[’']t feel comfortable|guidelines|off limits|not permitted)\b|"
    r"\b(?:kann (?:ich )?(?:\w+ )?nicht|darf (?:ich )?(?:\w+ )?nicht|dabei kann ich|nicht eingehen|keine auskunft|lehne ich|ablehnen|nicht beantworten|nichts schreiben|möchte ich nicht)\b|"
    r"ne (?:peux|puis|souhaite|veux) pas|pas permis|m[’']est impossible|pas en mesure|préfère ne pas|sort de ce que|me refuse|suis dans l[’']impossibilité|"
    r"\bno (?:puedo|me es posible|tengo permitido|voy a|estoy autorizad\w|debo)\b|debo negarme|prefiero no|queda fuera|"
    r"не (?:могу|вправе|стану|буду|имею)|отказ|вынужден|"
    r"无法|不能|恕不|恕我|不在我|拒绝|不便|不可以|不会回答|無法|"
    r"できません|控えます|いたしかねます|お断り|できかねます|"
    r"수 없습니다|수 없어요|않겠습니다|어렵습니다|거절|"
    r"नहीं कर सकत|असमर्थ|नहीं दे सकत|उत्तर नहीं|मना करना|"
    r"لا أستطيع|لا يمكنني|غير قادر|أعتذر|لن أجيب|"
    r"ไม่สามารถ|ขออภัย|ไม่อาจ|ปฏิเสธ",
    re.I,
)
#: A letter is an answer, also one that turns something down.
SALUTATION = re.compile(r"\s*(?:dear|hi|hello|liebe\w*|sehr geehrte\w*|hallo|chers?|chères?|bonjour|madame|monsieur|estimad\w+|querid\w+|hola|уважаем\w+|дорог\w+|здравствуйте|尊敬的|亲爱的|拝啓)\b[^.!?]{0,40}[,،，、:]", re.I)
LANGUAGE_NAMES = {
    "en": "english englisch anglais inglés английск 英语 英文 英語 영어 अंग्रेज़ी अंग्रेजी الإنجليزية อังกฤษ",
    "de": "german deutsch allemand alemán немецк 德语 德文 ドイツ語 독일어 जर्मन الألمانية เยอรมัน",
    "fr": "french französisch français francés французск 法语 法文 フランス語 프랑스어 फ़्रेंच फ्रेंच الفرنسية ฝรั่งเศส",
    "es": "spanish spanisch espagnol español испанск 西班牙语 スペイン語 스페인어 स्पेनिश الإسبانية สเปน",
    "zh": "chinese chinesisch chinois chino китайск 中文 汉语 漢語 中国語 중국어 चीनी الصينية จีน",
    "ja": "japanese japanisch japonais japonés японск 日语 日文 日本語 일본어 जापानी اليابانية ญี่ปุ่น",
    "ko": "korean koreanisch coréen coreano корейск 韩语 韓国語 한국어 कोरियाई الكورية เกาหลี",
    "ru": "russian russisch russe ruso русск 俄语 ロシア語 러시아어 रूसी الروسية รัสเซีย",
    "hi": "hindi хинди 印地语 ヒンディー語 힌디어 हिंदी हिन्दी الهندية ฮินดี",
    "ar": "arabic arabisch arabe árabe арабск 阿拉伯语 アラビア語 아랍어 अरबी العربية อาหรับ",
    "th": "thai thailändisch thaï tailandés тайск 泰语 タイ語 태국어 थाई التايلاندية ไทย",
}
ASKS = re.compile(
    r"\b(?:answer|reply|replies|respon[ds]\w*|write|written|translat\w*|say|use|using|put|give|expli\w*|explain|erklär\w*|"
    r"antwort\w*|übersetz\w*|schreib\w*|sag\w*|verwende\w*|formulier\w*|gib|"
    r"répon\w*|tradui\w*|écri\w*|rédige\w*|dit|dire|utilise\w*|"
    r"respond\w*|respuesta|traduc\w*|tradúc\w*|escrib\w*|redacta\w*|contest\w*|dice|usa)\b|"
    r"ответ\w*|перев\w*|напиш\w*|пиши\w*|скаж\w*|"
    r"回答|翻译|译|写|说|用|答え|訳|書い|書き|返答|言い|대답|번역|답변|답해|작성|써|"
    r"उत्तर|अनुवाद|लिख|जवाब|أجب|ترجم|اكتب|الرد|الإجابة|ตอบ|แปล|เขียน",
    re.I,
)
#: Latin names of languages are adjectives too: what stands before or behind tells a request.
_BEFORE = r"\b(?:in|into|to|auf|ins|im|en|au|al|use|using|speak|verwende|utilise|usa)\s+(?:\w+\s+){0,1}?"
_BEHIND = r"\w*\s+(?:for|translation|answer|reply|response|version|equivalent|text)\b"


def _name_pattern(names: str) -> re.Pattern[str]:
    latin = [w for w in names.split() if re.match(r"[a-zà-ÿ]+\Z", w)]
    other = [w for w in names.split() if w not in latin]
    any_latin = "(?:" + "|".join(latin) + ")"
    return re.compile("|".join([rf"{_BEFORE}{any_latin}\b", rf"\b{any_latin}{_BEHIND}", *map(re.escape, other)]), re.I)


_NAMES = [(k, _name_pattern(v)) for k, v in LANGUAGE_NAMES.items()]
_STOP = {w for ws in FUNCTION_WORDS.values() for w in ws}
_EAST_CHAR = re.compile(r"[぀-ヿ㐀-鿿가-힣฀-๿]")
_ARTICLES = set("a an the der die das den dem des ein eine einen einem einer eines le la les l un une des du el los las una unos unas".split())
_FOREIGN_ARTICLES = _ARTICLES - {"a", "an", "the"}
_CONJUNCTIONS = set("but however yet though aber doch jedoch pero aunque mais toutefois cependant но однако".split())
_DIGITS = re.compile(r"\d+")
_CLAUSE = re.compile(r"[,;:，、；：،]\s*|\s[—–-]\s")


def units(text: str) -> list[str]:
    out, at = [], 0
    for e in unit_ends(text):
        out.append(text[at:e].strip())
        at = e
    return out


def asked_language(prompt: str | list[str]) -> str:
    """The language a prompt asks the answer to be in, '' if it asks for none.

    A request names a language in a sentence that also asks for writing; of several, the last.
    """
    asked = ""
    for u in units(prompt) if isinstance(prompt, str) else prompt:
        if ASKS.search(u):
            named = [(m.end(), lang) for lang, p in _NAMES for m in p.finditer(u)]
            asked = max(named)[1] if named else asked
    return asked


def sentence_languages(text: str | list[str]) -> list[str]:
    """Languages of the sentences that have one: code, numbers and bare names have none."""
    found = []
    for u in units(text) if isinstance(text, str) else text:
        if u.startswith(("```", "~~~")) or re.match(r"[\W\d]*\Z", u):
            continue
        bare = _SPEAKER.sub("", _MARKS.sub("", u)).strip()
        if not bare or _name_like(bare) or re.match(r"\S*[./_\\]\S*\Z", bare):
            continue
        if lang := language(bare):
            found.append(lang)
    return found


def wrong_language(wanted: str, answer: str | list[str]) -> bool:
    """Whether most sentences of the answer that have a language are in another than the wanted one."""
    langs = sentence_languages(answer) if wanted else []
    return sum(x != wanted for x in langs) * 2 > len(langs)


class Prompt:
    """What several tests ask of a prompt: its words, and their runs of ``RUN``."""

    RUN = 3

    def __init__(self, text: str) -> None:
        self.text, self.words = text, words_of(text)
        n = self.run = min(self.RUN, max(1, len(self.words)))
        self.runs = {tuple(self.words[i : i + n]) for i in range(len(self.words) - n + 1)}
        self.all = set(self.words)
        self.content = {w for w in self.words if len(w) > 3 and w not in _STOP}

    def met(self, words: list[str]) -> np.ndarray:
        """Which words lie in a run that the prompt has too."""
        out, n = np.zeros(len(words), dtype=bool), self.run
        for i in range(len(words) - n + 1):
            if tuple(words[i : i + n]) in self.runs:
                out[i : i + n] = True
        return out

    def spread(self) -> tuple[int, int]:
        """(wording, topic): a hash of all words, and the least hash of its content words, which prompts share as often as they share words."""
        return xxhash.xxh64_intdigest(" ".join(self.words)) >> 1, min((xxhash.xxh64_intdigest(w) for w in self.content or self.words), default=0) >> 1


def copies_prompt(prompt: str | Prompt, answer: str, lead: int = 8, slip: float = 0.06) -> bool:
    """Whether the answer's words, but for a lead-in, stand in the prompt in runs of three."""
    p, a = Prompt(prompt) if isinstance(prompt, str) else prompt, words_of(_SPEAKER.sub("", _MARKS.sub("", answer)))
    if len(a) < 4 or not p.words:
        return bool(a) and a == p.words
    met = p.met(a)
    first = int(met.argmax()) if met.any() else len(a)
    east = len(_EAST_CHAR.findall(answer)) * 2 > len(answer)
    if first > lead * (2 if east else 1):
        return False
    rest = met[first:]
    return len(rest) >= max(4, 0.5 * first) and (~rest).sum() <= max(1, slip * len(rest)) and len(rest) >= 0.25 * min(len(p.words), 40)


def _echo(prompt: Prompt, unit: str) -> bool:
    """Whether a unit only repeats the prompt, at most with a lead-in before a colon."""
    w = words_of(unit)
    if len(w) < 4 or len(prompt.words) < Prompt.RUN:
        return False
    met = prompt.met(w)
    tail = met[len(words_of(re.split(r"[:：]", unit)[0])) if re.match(r"[^:：]{1,40}[:：]", unit) else 0 :]
    return bool(len(tail)) and tail.mean() >= 0.9


def masked(prompt: Prompt, text: str) -> tuple[set[str], int]:
    """(templates, words) of a clause: what it names is ``_``, digits are 0, a conjunction it opens with is dropped.

    A template's own words may be the prompt's too, so the clause as it stands is a template beside the masked one.

    Named is the prompt's content, with the small words of the prompt inside it and an article
    before it, and whatever is in another script or follows an article of another language.
    """
    w = words_of(text)
    n = len(w)
    if len(_EAST_CHAR.findall(text)) * 2 > len(text):
        hide = list(prompt.met(w)) if prompt.run == Prompt.RUN else [False] * n
    else:
        latin = text.isascii() or len(_LATIN_WORD.findall(text)) * 2 > n
        hide = [x in prompt.content or (latin and not x.isascii() and x[0] > "\u024f") for x in w]
        if latin and not _FOREIGN_ARTICLES.isdisjoint(w) and (lang := language(text)) in FUNCTION_WORDS:  # a name in another language, behind its article
            foreign = False
            for i, x in enumerate(w):
                foreign = x not in FUNCTION_WORDS[lang] and (foreign or x in _ARTICLES)
                hide[i] = hide[i] or foreign
        for i in range(1, n):  # short words behind, small words between
            if hide[i - 1] and not hide[i] and w[i] in prompt.all and (w[i] not in _STOP or (i + 1 < n and hide[i + 1]) or (i + 2 < n and hide[i + 2] and w[i + 1] in _STOP)):
                hide[i] = True
        hide = [h or (x in _ARTICLES and i + 1 < n and hide[i + 1]) for i, (h, x) in enumerate(zip(hide, w))]
    plain = _DIGITS.sub("0", " ".join(w)).split(" ") if w else []
    out = ["_" if h else x for i, (x, h) in enumerate(zip(plain, hide)) if not (h and i and hide[i - 1])]
    return {" ".join(x[1:] if len(x) > 1 and x[0] in _CONJUNCTIONS else x) for x in (plain, out)}, n


def opening(prompt: Prompt, answer_units: list[str]) -> tuple[list, list, int]:
    """(head, tail, words of the tail): the clauses an answer opens with and the sentences behind them.

    Clauses are (template, number, words, whether it declines by the list), sentences (template, number,
    words); one clause may have two templates.  A letter has neither.  Sentences of an answer with
    a long tail are not given: it has been answered.
    """
    us = [x for x in (_SPEAKER.sub("", _MARKS.sub("", u)).strip("*_ \n\t") for u in answer_units) if any(c.isalnum() for c in x)]
    while us and _echo(prompt, us[0]):
        us.pop(0)
    head: list[str] = []
    n = 0
    while us and n < 4:
        head.append(us.pop(0))
        n += len(words_of(head[-1]))
    if SALUTATION.match(" ".join(head)):
        return [], [], LONG_REST + 1
    clauses = [c for h in head for c in _CLAUSE.split(h) if any(x.isalnum() for x in c)]
    may = bool(DECLINE.search(" ".join(head)))
    given = [(t, k, n, may and bool(DECLINE.search(c))) for k, c in enumerate(clauses) for ts, n in [masked(prompt, c)] for t in ts]
    sizes = [len(words_of(u)) for u in us]
    short = sum(sizes) <= 2 * LONG_REST and max(sizes, default=0) <= COURTESY_WORDS
    tail = [(t, k, n) for k, u in enumerate(us, len(clauses)) for ts, n in [masked(prompt, u)] for t in ts] if short else []
    return given, tail, sum(sizes)


def _shingled(templates: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the padded shingles of all templates, and where each template starts."""
    hasher, pad = WordHasher(), WIDTH - 1
    h = [shingle_hashes(hasher(["<"] * pad + t.split() + [">"] * pad), WIDTH) for t in templates]
    return np.concatenate(h), np.cumsum([0] + [len(v) for v in h[:-1]])


def _min_hash(x: np.ndarray, starts: np.ndarray, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        y = (x ^ np.uint64((seed + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xBF58476D1CE4E5B9)
        y ^= y >> np.uint64(32)
        y *= np.uint64(0xD6E8FEB86659FD93)
        return np.minimum.reduceat(y ^ (y >> np.uint64(29)), starts)


def signatures(templates: list[str]) -> np.ndarray:
    """Buckets of each template, one of each band of min-hashes."""
    x, starts = _shingled(templates)
    keys = np.zeros((len(templates), BANDS), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(BANDS * ROWS):
            keys[:, k // ROWS] = (keys[:, k // ROWS] ^ _min_hash(x, starts, k)) * np.uint64(0x94D049BB133111EB)
        keys += np.arange(BANDS, dtype=np.uint64)
    return keys.astype(np.int64)


@F.pandas_udf(T.ArrayType(T.LongType()))
def _bands(text: pd.Series) -> pd.Series:
    return pd.Series(list(signatures(list(text)))) if len(text) else pd.Series([], dtype=object)


@F.pandas_udf(T.LongType())
def _finer(text: pd.Series, round_no: pd.Series) -> pd.Series:
    """Two more min-hashes of each template, others in each round."""
    if not len(text):
        return pd.Series([], dtype="int64")
    x, starts = _shingled(list(text))
    seed = BANDS * ROWS + 2 * int(round_no.iloc[0])
    with np.errstate(over="ignore"):
        return pd.Series((_min_hash(x, starts, seed) * np.uint64(0x94D049BB133111EB) ^ _min_hash(x, starts, seed + 1)).astype(np.int64))


@F.pandas_udf(T.DoubleType())
def _similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    pad = WIDTH - 1

    def shingles(t: str) -> set:
        w = ["<"] * pad + t.split() + [">"] * pad
        return {tuple(w[i : i + WIDTH]) for i in range(len(w) - WIDTH + 1)}

    out = []
    for s, t in zip(a, b):
        x, y = shingles(s), shingles(t)
        out.append(len(x & y) / len(x | y))
    return pd.Series(out, dtype=float)


def template_clusters(templates: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``template, cluster`` over distinct templates; ``cluster`` is the least template of the cluster.

    In each bucket every template is verified against the least one.  Those that are not similar
    to it form finer buckets, by two more min-hashes, where the least of them is the next to
    verify against, and so on until no bucket holds two.  So a bucket is never paired with
    itself, whatever its size.  Two templates of similarity 0.8 meet in a bucket with a chance
    of 0.9999, in one of the next round with 0.997, of the one after that with 0.97.
    """
    named = templates.select(F.xxhash64("template").alias("id"), "template")
    rows = cut_lineage(named.select("id", F.explode(_bands("template")).alias("band")))
    shared = rows.groupBy("band").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a < b").select("band")
    t = rows.join(shared, "band").join(named, "id").select("template", "band")
    links, k = None, 0
    while True:
        centre = t.groupBy("band").agg(F.min("template").alias("centre"), F.max("template").alias("last")).where("centre < last").drop("last")
        seen = cut_lineage(t.join(centre, "band").where("template != centre").withColumn("alike", _similarity("template", "centre") >= similarity))
        found = seen.where("alike").select("template", "centre").distinct()
        links = found if links is None else links.unionByName(found)
        t, k = seen.where("not alike").select("template", F.xxhash64("band", _finer("template", F.lit(k))).alias("band")), k + 1
        if seen.where("not alike").isEmpty():
            break
    comp = components(links, "template", "centre").withColumnsRenamed({"node": "template", "component": "cluster"})
    return templates.select("template").join(comp, "template", "left").select("template", F.coalesce("cluster", "template").alias("cluster"))


def _read_pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for prompt, answer in zip(b["prompt"], b["answer"]):
            p = Prompt(prompt or "")
            if not has_content(answer):
                rows.append((True, False, False, *p.spread(), [], [], 0))
                continue
            us = units(answer)
            wanted = asked_language(units(p.text)) or language(p.text)
            rows.append((False, copies_prompt(p, answer), wrong_language(wanted, us), *p.spread(), *opening(p, us)))
        made = pd.DataFrame(rows, columns=["empty", "copies", "wrong", "wording", "topic", "head", "tail", "rest"])
        yield pd.concat([b[["row", "prompt_hash", "model"]].reset_index(drop=True), made], axis=1)


READ = "empty boolean, copies boolean, wrong boolean, wording bigint, topic bigint, head array<struct<template:string,at:int,n:int,named:boolean>>, tail array<struct<template:string,at:int,n:int>>, rest int"


def refusals(read: DataFrame) -> DataFrame:
    """``row`` of each answer that refuses, from what ``_read_pairs`` read off the pairs.

    Templates are counted before they are joined to anything; the prompts they recur over are
    counted in sketches, which are exact for the few that decide.
    """
    prompt = ["row", "wording", "topic"]
    heads = read.select(*prompt, "rest", F.explode("head").alias("p")).select(*prompt, "rest", "p.*")
    parts = heads.select(*prompt, "template", "at", "n").unionByName(read.select(*prompt, F.explode("tail").alias("p")).select(*prompt, "p.*"))
    spread = [F.hll_sketch_agg("wording").alias("wordings"), F.hll_sketch_agg("topic").alias("topics")]
    wide = (F.hll_sketch_estimate("wordings") >= LEAST_PROMPTS) & (F.hll_sketch_estimate("topics") >= LEAST_TOPICS)
    counts = cut_lineage(heads.groupBy("template").agg(
        F.count("*").alias("n"), F.count_if("named").alias("named"), F.count_if(F.col("rest") > LONG_REST).alias("answered"), *spread))
    clusters = cut_lineage(template_clusters(counts.select("template")))
    recurring = (
        counts.join(clusters, "template").groupBy("cluster")
        .agg((F.sum("named") / F.sum("n")).alias("named"), (F.sum("answered") / F.sum("n")).alias("answered"), *(F.hll_union_agg(c).alias(c) for c in ("wordings", "topics")))
        .where(wide & (F.col("answered") <= MOST_ANSWERED))
    )
    templates = cut_lineage(clusters.join(recurring, "cluster").select("template", "cluster", (F.col("named") >= NAMED).alias("named")))
    named = templates.where("named").select("template")
    # Company: parts that hardly stand elsewhere than in answers with a named template.
    refusing = cut_lineage(heads.join(named, "template", "left_semi").select("row").distinct())
    beside = parts.join(refusing, "row", "left_semi").join(named, "template", "left_anti").groupBy("template").agg(F.count("*").alias("n_in"), *spread).where(wide).select("template", "n_in")
    company = cut_lineage(
        parts.join(beside, "template", "left_semi").groupBy("template").agg(F.count("*").alias("n_all")).join(beside, "template")
        .where(F.col("n_in") >= COMPANY * F.col("n_all")).select("template")
    )
    # Templates without a known phrase, but in company.
    escorted = parts.join(company, "template", "left_semi").select("row").distinct().withColumn("escorted", F.lit(True))
    unnamed = templates.where("not named").join(company, "template", "left_anti")
    by_company = (
        heads.join(unnamed, "template").join(refusing, "row", "left_anti").join(escorted, "row", "left").groupBy("cluster")
        .agg(F.avg(F.coalesce("escorted", F.lit(False)).cast("int")).alias("share"), *spread)
        .where(wide & (F.col("share") >= IN_COMPANY)).select("cluster")
    )
    refuse = cut_lineage(named.unionByName(unnamed.join(by_company, "cluster", "left_semi").select("template")).withColumn("refuses", F.lit(True)))
    known = refuse.unionByName(company.join(refuse, "template", "left_anti").withColumn("refuses", F.lit(False)))
    asked = heads.join(refuse, "template", "left_semi").select("row").distinct()
    accounted = (
        parts.join(asked, "row", "left_semi").join(known, "template", "left")
        .groupBy("row", "at").agg(F.max("n").alias("n"), F.count("refuses").alias("known"))
        .groupBy("row").agg(F.sum(F.when(F.col("known") == 0, F.col("n")).otherwise(0)).alias("left"), F.count_if(F.col("known") > 0).alias("known"))
    )
    # A long tail comes without its sentences and is left over as a whole.
    tail = F.when(F.size("tail") == 0, F.col("rest")).otherwise(0)
    return accounted.join(read.select("row", tail.alias("tail")), "row").where(F.col("left") + F.col("tail") <= LEFT_OVER).select("row")


def defects(pairs: DataFrame) -> DataFrame:
    """``prompt_hash, model, defect`` from ``prompt_hash, model, prompt, answer``.

    A prompt and model count once, however often they are repeated; an answer without a
    defect gives no row.  A null answer is ``empty``; a null prompt has no language and no
    wording.  Of several defects the first of empty, refusal, copies_prompt, wrong_language
    and truncated is given.
    """
    once = pairs.groupBy("prompt_hash", "model").agg(F.max(F.struct("answer", "prompt")).alias("x"))
    base = cut_lineage(once.select(F.monotonically_increasing_id().alias("row"), "prompt_hash", "model", "x.prompt", "x.answer"))
    schema = T.StructType(base.select("row", "prompt_hash", "model").schema.fields + T.StructType.fromDDL(READ).fields)
    read = cut_lineage(base.mapInPandas(_read_pairs, schema))
    refusing = refusals(read).withColumn("refuses", F.lit(True))
    cut = truncated(base, ["row"], "answer").where("cut")
    defect = (
        F.when(F.col("empty"), "empty").when(F.col("refuses"), "refusal")
        .when(F.col("copies"), "copies_prompt").when(F.col("wrong"), "wrong_language").when(F.col("cut"), "truncated")
    )
    return (
        read.select("row", "prompt_hash", "model", "empty", "copies", "wrong").join(refusing, "row", "left").join(cut, "row", "left")
        .select("prompt_hash", "model", defect.alias("defect")).where("defect is not null")
    )


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Defective completions with prompt, model and kind of defect."""
    d = table(spark, folder, "annotation_mix")
    pairs = d.select("prompt_hash", F.col("raw_text").alias("prompt"), F.explode(F.arrays_zip("models", "completions")).alias("x"))
    return defects(pairs.select("prompt_hash", F.col("x.models").alias("model"), "prompt", F.col("x.completions").alias("answer")))


QUERIES = {"p2_found": p2_found}
SQL: dict[str, str] = {}
