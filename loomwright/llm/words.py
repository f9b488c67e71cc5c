"""Words and word shingles as several problems need them."""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import xxhash

_HAN_KANA = "々〆〇〡-〩〸-〻ぁ-ゖゝ-ゟァ-ヺー-ヿㇰ-ㇿ㐀-䶿一-鿿豈-龎\U00020000-\U0003ffff"
_WORD = re.compile(rf"[{_HAN_KANA}]|(?:(?![{_HAN_KANA}])[^\W_])+")
_CF = re.compile("[­؀-؅؜۝܏᠎​-‏‪-‮⁠-⁤⁦-⁯﻿￹-￻\U000e0001\U000e0020-\U000e007f]")


def words_of(text: str | None) -> list[str]:
    """NFKC, format characters removed, lower-cased; runs of letters and digits, each Han or kana character alone."""
    if not text:
        return []
    if not text.isascii():
        text = _CF.sub("", unicodedata.normalize("NFKC", text))
    return _WORD.findall(text.lower())


class WordHasher:
    """64-bit hashes of words, kept for words seen again; the store is emptied when large."""

    def __init__(self, most: int = 1 << 20) -> None:
        self.seen: dict[str, int] = {}
        self.most = most

    def __call__(self, words: list[str]) -> np.ndarray:
        seen = self.seen
        if len(seen) > self.most:
            seen.clear()
        out = np.empty(len(words), dtype=np.uint64)
        for i, w in enumerate(words):
            h = seen.get(w)
            if h is None:
                h = seen[w] = xxhash.xxh64_intdigest(w)
            out[i] = h
        return out


def shingle_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` consecutive word hashes."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(m, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            out = (out * np.uint64(0x9E3779B97F4A7C15)) ^ (h[k : k + m] + (out >> np.uint64(29)))
        out ^= out >> np.uint64(32)
        out *= np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(32)
    return out
