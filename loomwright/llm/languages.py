"""Which language a text or a sentence is in, for the languages of the tables.

Scripts settle most languages.  Latin ones are told apart by function words and letters
(fixed values below).  A text without such evidence has no language.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache

import numpy as np

# Frequent function words, and letters found in one of the languages only.
FUNCTION_WORDS = {
    "en": "the a an of and to in is it that for with as on at by from or be this which not are was but so if you your we they he she has have had will would can could there when what how who than then only most before after into its their about each every them no do does did".split(),
    "de": "der die das den dem des ein eine einen einem einer eines und zu im ist es dass für mit als auf bei von oder wird nicht sind war aber so wenn sie wir ihr er hat haben wird kann sich auch nach noch wie was warum bis zum zur am um nur man dafür damit weil durch über unter vor ohne rund etwa".split(),
    "fr": "le la les l un une des du de d et à au aux en est que qu pour avec sur par ou ne pas ce cette ces sont il elle nous vous ils on se si plus dans sans ont été avant après comment pourquoi quand qui quoi même puis ensuite car parce afin tant presque rien chaque puisque ainsi jamais très fait être cela".split(),
    "es": "el la los las un una unos unas de del y a al en es que por para con se no su sus lo como más pero si o ya este esta qué cómo cuándo porque cuando muy sin sobre entre hasta desde antes después luego así hay son está fue le les aunque mientras casi nada cada donde pues también otro otra solo tan fin".split(),
}
ONLY_LETTERS = {"de": "äöß", "fr": "çèêëîïôœùûæ", "es": "ñ¿¡"}
SCRIPTS = (
    ("th", "ก-๛"), ("ko", "가-힣ᄀ-ᇿㄱ-ㆎ"), ("hi", "ऀ-ॿ"), ("ar", "؀-ۿݐ-ݿﭐ-﷿ﹰ-ﻼ"),
    ("ru", "Ѐ-ӿ"), ("kana", "ぁ-ゖァ-ヺーｦ-ﾟ"), ("han", "㐀-䶿一-鿿豈-龎々"), ("latin", "A-Za-zÀ-ɏ"),
)
LANGUAGES = ("en", "de", "fr", "es", "zh", "ja", "ko", "ru", "hi", "ar", "th", "")
LATIN = ("en", "de", "fr", "es")
#: Evidence by which the first language must lead: a word that two languages share tells nothing.
MARGIN = 0.3

_SCRIPT = [(name, re.compile(f"[{chars}]")) for name, chars in SCRIPTS]
_LATIN_WORD = re.compile(r"[A-Za-zÀ-ɏ]+")
_LOOKUP: dict[str, list[int]] = {}
for _k, _l in enumerate(LATIN):
    for _w in FUNCTION_WORDS[_l]:
        _LOOKUP.setdefault(_w, []).append(_k)
_MARKED = [(k, re.compile(f"[{ONLY_LETTERS[lang]}]")) for k, lang in enumerate(LATIN) if lang in ONLY_LETTERS]


@lru_cache(maxsize=1 << 16)
def _script_of(c: str) -> str:
    return next((name for name, p in _SCRIPT if p.match(c)), "")


def script_counts(text: str) -> dict[str, int]:
    if text.isascii():
        return {"latin": 1} if _LATIN_WORD.search(text) else {}
    out: dict[str, int] = {}
    for c, n in Counter(text).items():
        if name := _script_of(c):
            out[name] = out.get(name, 0) + n
    return out


def latin_votes(text: str) -> np.ndarray:
    """Weight of evidence for each Latin language from function words and letters."""
    v = [0.0] * len(LATIN)
    low = text.lower()
    for w in _LATIN_WORD.findall(low):
        if ks := _LOOKUP.get(w):
            for k in ks:
                v[k] += 1 / len(ks)
    if not low.isascii():
        for k, p in _MARKED:
            v[k] += 0.8 * min(3, len(p.findall(low)))
    return np.array(v)


def script_language(text: str) -> str:
    """The language by script, ``latin`` for Latin letters, '' without letters."""
    n = script_counts(text)
    if not n:
        return ""
    east = n.get("kana", 0) + n.get("han", 0)
    weights = {k: c for k, c in n.items() if k not in ("kana", "han")}
    if "latin" in weights:  # a Latin letter says less than a character of a syllabary
        weights["latin"] = weights["latin"] * 0.4
    if east:
        weights["ja" if n.get("kana", 0) * 8 >= east else "zh"] = east * 2
    best = max(weights, key=weights.get)
    return best if weights[best] > 0 else ""


def language(text: str) -> str:
    """One of ``LANGUAGES``; '' when nothing tells."""
    s = script_language(text)
    if s != "latin":
        return s
    v = np.sort(votes := latin_votes(text))
    return LATIN[int(votes.argmax())] if v[-1] - v[-2] >= MARGIN else ""
