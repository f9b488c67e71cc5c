"""Sentence boundaries for many scripts (problem 7): a finite transducer over chunks of a text.

The rules are compiled into symbols and states.  Symbols are the classes of lines (blank, fence,
heading or tag, list item, speaker label, plain) and, within a paragraph, marks, openers and
closers of pairs, and blanks of Thai text; whether a mark can end a sentence is read off a
bounded context, so it belongs to the symbol.  A state is outside, in one of two kinds of code
fence, or inside a pair of one kind at some depth, in which nothing ends.

Whether an opener is closed at all is known from the right only.  So there are two passes, as in
a bimachine: one from the right hands each chunk, for each kind of pair, what closes behind it in
the paragraph; one from the left runs the states.  In both a chunk is a function of what comes
in: counters with a loss and a gain from the right, a table of states from the left.  Such
functions are composed by a parallel prefix scan, and then every chunk emits its units alone.  All
texts go this way, in chunks of ``CHUNK_CHARS``; a chunk may begin anywhere a line or a word does.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np

# ---------------------------------------------------------------------------------------
# What counts as what in the languages served.
SPEAKERS = (
    "user assistant system human ai bot tool function model prompt response question answer instruction "
    "nutzer nutzerin benutzer assistent assistentin frage antwort "
    "utilisateur utilisatrice assistante système réponse "
    "usuario usuaria asistente sistema pregunta respuesta "
    "пользователь ассистент помощник система вопрос ответ "
    "用户 助手 系统 問 答 问 ユーザー アシスタント システム 사용자 도우미 어시스턴트 시스템 "
    "उपयोगकर्ता सहायक المستخدم المساعد النظام ผู้ใช้ ผู้ช่วย ระบบ"
).split()
#: Never at the end of a sentence: titles, and words that announce something.
LEADING = set(
    "mr mrs ms mx dr prof st gen lt col sgt capt cpt cmdr rev hon gov sen rep pres messrs mt "
    "vs cf e.g i.e eg ie viz al approx ca resp bzw bspw vgl sog evtl ggf inkl zzgl z.b d.h m.e "
    "mme mlle mgr sr sra srta dra ud uds p.ej p.ex c.-à-d "
    "т.е см рис стр гл ул им тыс млн млрд проф акад гос डॉ श्री श्रीमती प्रो د أ م".split()
)
#: Only announce something when a digit follows.
NUMBERED = set("no nos nr núm num fig figs sec sect ch chap p pp pg vol art eq pág págs cap abb tab s bd kap § № n".split())
#: May end a sentence: they do unless a lower-case word follows.
EITHER = set(
    "etc inc ltd co corp llc plc jr sr p.m a.m u.s u.k b.c a.d ph.d usw u.a u.s.w i.d.r h min kg km cm mm ml ca "
    "т.д т.п др г гг в вв руб коп oz lb lbs ft in hr hrs".split()
)
MONTHS = set(
    "januar februar märz april mai juni juli august september oktober november dezember jänner "
    "jahrhundert jh klasse etage stock platz tag versuch auflage kapitel geburtstag januars quartal".split()
)
#: Words that carry a sentence on behind a closing quotation mark, in scripts without case.
CARRY_ON = (
    "と って という とい は が を の に で も "  # ja
    "是 已 的 这 這 等 之 而 就 在 也 了 "  # zh
    "하고 라고 이라고 고 라는 라며 하며 하면서 "  # ko
    "और कहा पूछा लिखा ऐसा कहकर कहते बोला बोली "  # hi
    "وغادر وقال ومضى وذهب ثم قال فقال وانصرف"  # ar
).split()
ENDS = "!?。！？｡।॥؟۔"
DOTS = ".…‥．"
CLOSERS = "\"”»」』）)\\]’'“›】〉》"
# ---------------------------------------------------------------------------------------

OUT, BACKTICKS, TILDES = 0, 1, 2
#: Pairs that nest, as openers and closers; pairs that do not: low and straight quotation marks, reversed guillemets.
NESTED = ("“”", "«»", "「」", "『』", "《》", "【】", "()", "（）")
SIMPLE = "„»\"‘'"
#: Depths told apart where a pair goes on into the next chunk.
DEPTH = 8
STATES = 3 + (len(NESTED) + len(SIMPLE)) * DEPTH * 2
#: Characters of a chunk, and of context seen around it.
CHUNK_CHARS, CONTEXT = 1 << 9, 256

_NL = r"(?>\r\n|[\n\r\x0b\x0c\x85  ])"
_H = r"[^\S\n\r\x0b\x0c\x85  ]"
_INVISIBLE = "­​‌‍‎‏⁠﻿"
_PAD = rf"(?:{_H}|[{_INVISIBLE}])*"
_LINE = re.compile(rf"([^\n\r\x0b\x0c\x85  ]*)({_NL}|\Z)")
_FENCE = re.compile(rf"{_PAD}(```+|~~~+)")
_HEAD = re.compile(rf"{_PAD}(?:\#{{1,6}}{_H}+\S|</?[A-Za-z][\w:-]*(?:{_H}[^<>]*)?/?>{_PAD}\Z|<\|[^|<>]*\|>{_PAD}\Z)")
_ITEM = re.compile(rf"{_PAD}(?:[-*+•‣◦▪●·–]|\d{{1,3}}[.)]|\(\d{{1,3}}\)|[a-zA-Z][.)](?={_H}+[a-z]))(?={_H})")
_LABEL = re.compile(
    rf"{_PAD}(?:\*\*|\[|<\|)?(?:{'|'.join(map(re.escape, sorted(SPEAKERS, key=len, reverse=True)))}){_H}?\d*(?:\*\*|\]|\|>)?{_H}*[:：](?:\*\*)?",
    re.I,
)
_THAI = "ก-๛"
_EVENT = re.compile(
    r"(?P<open>[“„«»「『《【(（]|(?<![^\W_])\"(?=\S)|(?<!\w)‘|(?<!\w)'(?=\S))"
    r"|(?P<mark>[.!?。！？｡।॥؟۔…‥．]+[\"”»」』）)\]’'“›】]*)"
    rf"|(?P<gap>(?<=[{_THAI}”»\"')\]])\s+(?=[{_THAI}“«\"'(\[])|(?<=[{_THAI}])\s+(?=\S)|(?<=\S)\s+(?=[{_THAI}]))"
)
_PAIR = re.compile(r"[“”„«»「」『』《》【】()（）\"‘’']")
_OPENS = {p[0]: k for k, p in enumerate(NESTED)}
_CLOSES = {p[1]: k for k, p in enumerate(NESTED)}
_KINDS = {c: len(NESTED) + k for k, c in enumerate(SIMPLE)}
_WITHIN = [re.compile(f"[{re.escape(p)}]") for p in NESTED] + [re.compile(p) for p in ("[“”]", "«", '"', r"’(?!\w)", r"'(?!\w)")]
_LETTER = re.compile(r"\w")
_WORD_BEFORE = re.compile(r"[^\s。！？，、：；“”„«»「」『』（）]+\Z")
_LATIN_TAIL = re.compile(r"[A-Za-zÀ-ɏ§№.'’\-" + _INVISIBLE + r"]+\Z")
_STRIP_OPEN = "\"“„«»「『（(‘'[¿¡*_" + _INVISIBLE
_SPACE = re.compile(rf"[\s{_INVISIBLE}]*")
_WORD_START = re.compile(rf"(?<=\s)(?=[^\s{_INVISIBLE}])")
_BREAKS = "\n\r\x0b\x0c\x85\u2028\u2029"
_COLON = re.compile(r"[:：]\s*\Z")
_NEXT_WORD = re.compile(r"[^\W\d_]+")
_LATIN_OR_DIGIT = re.compile(r"[\dA-Za-zÀ-ɏ]")
_SHAPE_DOTTED = re.compile(r"(?:[^\W\d_]{1,2}\.)+[^\W\d_]{1,2}\Z")


def _lower(c: str) -> bool:
    return c.islower()


def _cased_upper(c: str) -> bool:
    return c.isupper() or c.istitle()


def _is_thai(c: str) -> bool:
    return "ก" <= c <= "๛"


def _follows(s: str, at: int) -> tuple[int, str]:
    """Where the next visible character is and which, '' at the end."""
    k = _SPACE.match(s, at).end()
    return k, s[k] if k < len(s) else ""


def ends_at_dot(s: str, start: int, dot: int, after: int) -> bool:
    """Whether one full stop at ``dot`` ends a sentence; ``after`` is behind mark and closers."""
    k, n = _follows(s, after)
    if not n:
        return True
    m = _LATIN_TAIL.search(s, max(start, dot - 40), dot) or _WORD_BEFORE.search(s, max(start, dot - 40), dot)
    word = m[0] if m else ""
    bare = word.lstrip(_STRIP_OPEN)
    if any(c in _INVISIBLE for c in bare):
        bare = bare.translate({ord(c): None for c in _INVISIBLE})
    low = bare.lower()
    if k == after or (k > after and not any(c.isspace() for c in s[after:k])):  # no blank behind it
        if not n.isalpha() or not bare:
            return n in "¿¡«“„「" and len(bare) > 1
        if low in LEADING or low in EITHER:
            return False
        last = bare[-1]
        if _cased_upper(n):
            nxt = s[k + 1 : k + 2]
            if last.isdigit():
                return nxt.islower() and "." not in bare and not any(c.isalpha() for c in bare)
            return last.islower() and len(bare) > 1 and bare.replace("'", "").replace("’", "").replace("-", "").isalpha() and (nxt.islower() or nxt.isspace())
        return not _lower(n) and last.isalpha() and not (last.islower() or last.isupper()) and len(bare) > 1
    if not bare:
        return True
    if n.isdigit() and (low in NUMBERED or low.endswith("str")):  # the German street with its number
        return False
    if len(bare) == 1 and bare.isalpha():
        before = s[max(start, dot - 8) : dot - 1]
        pair = re.search(r"([^\W\d_])\.\s?\Z", before)
        if pair:
            both = f"{pair[1]}.{bare}".lower()
            if both in LEADING:
                return False
            if both in EITHER:
                return not _lower(n)
        if low in LEADING:
            return False
        if re.match(r"\S{1,3}\.", s[k : k + 4]) and not n.isdigit():  # first letter of "z. B.", of "J. K. Name"
            return False
        if bare.isupper():
            return not (_cased_upper(n) or n.islower())
        if low in EITHER:
            return not _lower(n)
        return not _lower(n)
    if len(bare) > 2 and "." in bare and _SHAPE_DOTTED.match(bare):
        if low in LEADING:
            return False
        return not _lower(n)
    pair = re.search(r"([^\W\d_]{1,2})\.\s?\Z", s[max(start, m.start() - 5) : m.start()]) if len(bare) <= 2 or low == "ej" else None
    if pair:
        both = f"{pair[1]}.{bare}".lower()
        if both in LEADING:
            return False
        if both in EITHER:
            return not _lower(n)
    if low in LEADING:
        return False
    if low in EITHER:
        return not _lower(n)
    if bare.isdigit() and len(bare) <= 2 and not _lower(n):
        w = _NEXT_WORD.match(s, k)
        if w and w[0].lower() in MONTHS:
            return False
    return True


def _ends_at_mark(s: str, start: int, a: int, mark: str, after: int) -> bool:
    core = mark.rstrip(CLOSERS.replace("\\", ""))
    k, n = _follows(s, after)
    if not n:
        return True
    blank = any(c.isspace() for c in s[after:k])
    if any(c in "。！？｡।॥؟۔" for c in core):
        return n not in ",，、;；:：)）」』”»、،؛"
    if "!" in core or "?" in core:
        if n in ",;:，":
            return False
        if n in "—–-" and blank:
            _, x = _follows(s, k + 1)
            return not (x and _lower(x))
        if blank:
            return True
        return _cased_upper(n) or (n.isalpha() and not _lower(n)) or n in "¿¡«“„「"
    if len(core) > 1 or core in "…‥":
        if core == "．":
            return True
        return blank and (_cased_upper(n) or n in "¿¡«“„\"'#*(")
    if core == "．":
        return not n.isdigit()
    return ends_at_dot(s, start, a, after)


def _ends_behind_span(s: str, a: int, b: int, announced: bool) -> bool:
    """Whether a unit ends behind a quotation or bracket ``s[a:b]`` (``a`` may lie further left): it holds an end mark just before it closes."""
    k, n = _follows(s, b)
    if not n:
        return True
    i = b - 2
    while i > a and s[i].isspace():
        i -= 1
    if i <= a or s[i] not in ENDS + DOTS:
        return False
    if n in ",;:，、；：،؛.!?。！？।؟…—–-)）]」』”»/":
        return False
    if _lower(n):
        return False
    blank = k > b
    if _cased_upper(n):
        return True
    if n.isalpha() or unicodedata.category(n) in ("Lo", "Lm"):
        rest = s[k : k + 8]
        if any(rest.startswith(w) for w in CARRY_ON):
            return False
        if "぀" <= n <= "ヿ" or "一" <= n <= "鿿":
            return announced
        return True
    return blank or n in "“«「¿¡„"


def _thai_gap(s: str, a: int, b: int) -> bool:
    """Whether the blank ``s[a:b]`` ends a unit as blanks in Thai text do."""
    before, behind = s[a - 1], s[b]
    if _LATIN_OR_DIGIT.match(before) or _LATIN_OR_DIGIT.match(behind):
        return False
    if before in CLOSERS:
        before = s[max(0, a - 8) : a].rstrip(CLOSERS)[-1:] or before
    return _is_thai(before) or _is_thai(behind)


# ---- From the right: what closes behind a place in its paragraph ------------------------------------
#: For each nested kind the closers without an opener; for each other kind 1 if the next is a closer, 2 if it is not, 0 if none comes.
Right = list[int]
NOTHING: Right = [0] * (len(NESTED) + len(SIMPLE))


def closed_openers(t: str, lo: int, hi: int, right: Right) -> tuple[set[tuple[int, int]], Right]:
    """((place, kind) of the openers in ``t[lo:hi]`` that are closed, what closes behind ``lo``) given what closes behind ``hi``."""
    r, found, n = list(right), set(), len(NESTED)
    for m in reversed([m.start() for m in _PAIR.finditer(t, lo, hi)]):
        c = t[m]
        if c in _OPENS:
            k = _OPENS[c]
            if r[k]:
                found.add((m, k))
                r[k] -= 1
        elif c in _CLOSES:
            r[_CLOSES[c]] += 1
        if c in "“”":
            r[n] = 1
        elif c == "„":
            if r[n] == 1:
                found.add((m, n))
            r[n] = 2
        elif c == "»":
            if r[n + 1] == 1:
                found.add((m, n + 1))
            r[n + 1] = 2
        elif c == "«":
            r[n + 1] = 1
        elif c == '"':
            if r[n + 2]:
                found.add((m, n + 2))
            r[n + 2] = 1
        elif c == "‘":
            if r[n + 3] == 1:
                found.add((m, n + 3))
            r[n + 3] = 2
        elif c in "’'":
            free = not _LETTER.match(t, m + 1)
            if c == "’" and free:
                r[n + 3] = 1
            elif c == "'":
                if r[n + 4] == 1:
                    found.add((m, n + 4))
                if free:
                    r[n + 4] = 1 if m and not t[m - 1].isspace() else 2
    return found, r


def right_function(t: str, lo: int, hi: int, passes: bool) -> tuple[list[int], list[int]]:
    """(loss, gain): what closes behind ``lo`` of a part of a paragraph, as a function of what closes behind ``hi``.

    Counters lose the openers without a closer and gain the closers without an opener.  A value of
    a kind that does not nest is passed (gain -1) or set.  ``passes``: the paragraph goes on.
    """
    n = len(NESTED)
    many = 1 << 30
    if not passes:
        return [many] * n, closed_openers(t, lo, hi, NOTHING)[1]
    _, gain = closed_openers(t, lo, hi, NOTHING)
    _, much = closed_openers(t, lo, hi, [many] * n + [-1] * len(SIMPLE))
    return [many - (x - g) for x, g in zip(much[:n], gain[:n])], gain[:n] + much[n:]


def compose_suffixes(functions: list[tuple[list[int], list[int]]]) -> list[Right]:
    """What closes behind the end of each chunk: the functions of all chunks behind it, composed in log steps."""
    n = len(NESTED)
    loss = np.array([f[0] for f in functions], dtype=np.int64).reshape(-1, n)
    gain = np.array([f[1] for f in functions], dtype=np.int64).reshape(-1, n + len(SIMPLE))
    step = 1
    while step < len(loss):
        l1, g1, l2, g2 = loss[:-step].copy(), gain[:-step].copy(), loss[step:].copy(), gain[step:].copy()
        loss[:-step] = np.minimum(l2 + np.maximum(l1 - g2[:, :n], 0), 1 << 30)
        gain[:-step, :n] = g1[:, :n] + np.maximum(g2[:, :n] - l1, 0)
        gain[:-step, n:] = np.where(g1[:, n:] < 0, g2[:, n:], g1[:, n:])
        step *= 2
    return [[int(max(x, 0)) for x in g] for g in gain[1:]] + [list(NOTHING)]


# ---- From the left: the units of a part of a paragraph --------------------------------------------------
def _state_of(kind: int, depth: int, announced: bool) -> int:
    return 3 + (kind * DEPTH + min(depth, DEPTH) - 1) * 2 + announced


def _state_parts(state: int) -> tuple[int, int, bool]:
    k, announced = divmod(state - 3, 2)
    return k // DEPTH, k % DEPTH + 1, bool(announced)


def part_ends(t: str, begin: int, lo: int, hi: int, state: int, right: Right, closes: bool) -> tuple[list[int], int]:
    """(ends of units, state behind) of the part ``t[begin:hi]`` of the paragraph ``t``, which opens with a marker up to ``lo``; ``closes``: the paragraph does."""
    ends: list[int] = []
    closed = closed_openers(t, lo, hi, right)[0] if _PAIR.search(t, lo, hi) else set()
    at, opened, kind, depth, announced = lo, -1, -1, 0, False
    if state >= 3:
        kind, depth, announced = _state_parts(state)
    while at < hi:
        if kind >= 0:
            nested = kind < len(NESTED)
            for m in _WITHIN[kind].finditer(t, at):
                if m.start() >= hi:
                    at = hi
                    break
                depth += (1 if m[0] == NESTED[kind][0] else -1) if nested else -1
                if depth == 0:
                    at = m.end()
                    if _ends_behind_span(t, opened, at, announced):
                        ends.append(at)
                    kind = -1
                    break
            else:
                at = hi
            continue
        m = _EVENT.search(t, at)
        if not m or m.start() >= hi:
            break
        a, at = m.span()
        if m["mark"] is not None:
            if _ends_at_mark(t, 0, a, m["mark"], at):
                ends.append(at)
        elif m["gap"] is not None:
            if a > lo and (not ends or ends[-1] < a) and _thai_gap(t, a, at):
                ends.append(a)
        else:
            for k in (_OPENS.get(m[0], -1), _KINDS.get(m[0], -1)):
                if k >= 0 and (a, k) in closed:
                    opened, kind, depth, announced = a, k, 1, bool(_COLON.search(t, max(0, a - 3), a))
                    break
    if closes:
        begin = ends[-1] if ends else begin
        tail = t[begin:hi]
        seen = tail.rstrip()
        if seen.strip().strip(_INVISIBLE + " \t\r\n"):
            ends.append(begin + len(seen))
        elif ends and seen and set(seen) <= set(_INVISIBLE):
            ends[-1] += len(seen)
        return ends, OUT
    return ends, _state_of(kind, depth, announced) if kind >= 0 else OUT


def _line_kind(line: str, state: int) -> tuple[int, str, int]:
    """Next state, class of the line and length of the marker that opens it."""
    f = _FENCE.match(line)
    if state:
        closing = f and f[1][0] == ("`" if state == BACKTICKS else "~") and not line[f.end() :].strip()
        return (OUT if closing else state), ("close" if closing else "code"), 0
    if f and "`" not in line[f.end() :]:
        return (BACKTICKS if f[1][0] == "`" else TILDES), "open", 0
    if _SPACE.fullmatch(line):
        return OUT, "blank", 0
    if _HEAD.match(line):
        return OUT, "alone", 0
    if m := _ITEM.match(line):
        m2 = _LABEL.match(line, m.end())
        return OUT, "start", (m2 or m).end()
    if m := _LABEL.match(line):
        return OUT, "start", m.end()
    return OUT, "plain", 0


class Chunk(NamedTuple):
    """A chunk of a text: its place, and what its neighbours tell."""

    start: int
    end: int
    mid: str  # class of the line it begins within, '' at the start of a line
    goes_on: bool  # its first line goes on with a paragraph, outside fences
    floor: int  # where that paragraph begins, or no later than the context reaches
    followed: bool  # the next chunk goes on with the paragraph
    cut: bool  # the next chunk goes on with the line
    last: bool


def chunks_of(text: str, size: int = CHUNK_CHARS) -> list[Chunk]:
    """Chunks of ``size`` characters and the rest of a line; within a line over twice the size, of a word."""
    cuts: list[tuple[int, str, bool, int]] = []
    at, stop = 0, len(text.rstrip())
    if len(text) > size:
        recent: list[tuple[int, int]] = []  # lines back to the context's reach

        def floor_at(place: int) -> int:
            """Where the paragraph of the lines before ``place`` begins, or no later than the context reaches."""
            floor = place
            for x, y in reversed(recent):
                what = _line_kind(text[x:y], OUT)[1]
                if what in ("plain", "start"):
                    floor = x
                if what != "plain" or place - x > CONTEXT:
                    break
            return floor

        for m in _LINE.finditer(text):
            a, b = m.span(1)
            if a >= stop:
                break
            if a - at >= size or b - at > 2 * size:
                _, kind, marker = _line_kind(m[1], OUT)
                floor = floor_at(a) if kind == "plain" else a
                if a - at >= size:
                    cuts.append((a, "", floor < a, floor))
                    at = a
                while b - at > 2 * size and kind in ("plain", "start", "alone"):
                    w = _WORD_START.search(text, max(at + size, a + marker), min(b, stop))
                    if not w or w.end() >= stop:
                        break
                    at = w.end()
                    cuts.append((at, kind, kind != "alone", floor if at - a <= CONTEXT else max(a, len(text[a : at - CONTEXT].rstrip()) + a - 1)))
            recent.append((a, b))
            if len(recent) > 8 and a - recent[4][0] > CONTEXT:
                del recent[:4]
    starts = [(0, "", False, 0), *cuts]
    ends = [c[0] for c in cuts] + [len(text)]
    behind = [*cuts, (0, "", False, 0)]
    return [Chunk(a, e, mid, on, floor, n[2], bool(n[1]), e == len(text)) for (a, mid, on, floor), e, n in zip(starts, ends, behind)]


def _parts(s: str, c: Chunk, state: int) -> Iterator[tuple[str, int, int, int]]:
    """What a chunk holds when entered in ``state``: ('part', start, stop, body) of paragraphs, ('unit', end, ..) and ('state', new, ..)."""
    start = stop = body = -1
    code_end = 0
    first = True
    if state >= 3 or (state == OUT and c.goes_on and not c.mid):
        start = body = c.start
        stop = c.start
    fence = state if state in (BACKTICKS, TILDES) else OUT
    for m in _LINE.finditer(s, c.start, c.end):
        a, b = m.span(1)
        if a == c.end:
            break
        line = m[1]
        if first and c.mid:
            kind, marker = ("code", 0) if fence else ("alone" if c.mid == "alone" else "plain", 0)
            if kind == "plain":
                start, body = a, a
        else:
            # A line that goes on in the next chunk is classed as a whole.
            fence, kind, marker = _line_kind(line if m[2] or c.last else _LINE.match(s, a)[1], fence)
        first = False
        if kind != "plain" and start >= 0:
            if stop > start:
                yield "part", start, stop, body
            start = -1
        if kind == "plain":
            if start < 0:
                start = body = a
            stop = b
        elif kind == "start":
            start, stop, body = a, b, a + marker
        elif kind in ("alone", "close"):
            if m[2] or not c.cut:
                yield "unit", a + len(line.rstrip()), 0, 0
        elif kind in ("open", "code") and line.strip():
            code_end = a + len(line.rstrip())
    if start >= 0 and stop > start:
        yield "part", start, stop, body
    if c.last and fence:
        yield "unit", code_end or len(s[: c.end].rstrip()), 0, 0
    yield "state", fence, 0, 0


def _paragraph_stop(s: str, c: Chunk) -> int:
    """End of what is seen of the paragraph that goes on behind a chunk: its lines as far as the context reaches."""
    stop = c.end
    reach = _SPACE.match(s, c.end).end() + CONTEXT
    first = True
    for m in _LINE.finditer(s, c.end):
        a, b = m.span(1)
        if a == len(s) or a > reach or (_line_kind(m[1], OUT)[1] != "plain" and not (first and a and s[a - 1] not in _BREAKS)):
            break
        stop, first = b, False
    return min(stop, max(reach, c.end))


def chunk_right(s: str, c: Chunk) -> tuple[list[int], list[int]]:
    """The chunk as a function from the right, of the paragraph it begins in."""
    if not c.goes_on:
        return right_function(s, c.start, c.start, False)
    part = next(iter(_parts(s, c, OUT)))
    if part[0] != "part" or part[1] != c.start:
        return right_function(s, c.start, c.start, False)
    stop = part[2]
    return right_function(s, c.start, stop, c.followed and stop + 2 >= c.end and not s[stop : c.end].strip())


def emit(s: str, c: Chunk, state: int, right: Right) -> tuple[list[int], int]:
    """(ends of units of the chunk, state behind it), entered in ``state``, with what closes behind it."""
    ends: list[int] = []
    parts = list(_parts(s, c, state))
    exit_state = parts.pop()[1]
    for k, (what, a, b, body) in enumerate(parts):
        if what == "unit":
            ends.append(a)
            continue
        open_end = k == len(parts) - 1 and c.followed and exit_state == OUT and not s[b : c.end].strip()
        floor = c.floor if a == c.start and c.goes_on else a
        ceiling = _paragraph_stop(s, c) if open_end else b
        t, b = s[floor:ceiling], c.end if open_end else b
        entry = state if a == c.start and c.goes_on else OUT
        found, after = part_ends(t, a - floor, body - floor, b - floor, entry, right if open_end else NOTHING, not open_end)
        ends += [floor + e for e in found]
        if open_end:
            exit_state = after
    return ends, exit_state


def transition(s: str, c: Chunk, right: Right) -> tuple[list[int], list[int]]:
    """(states behind the chunk for each state before it, ends of units where it is entered outside)."""
    ends, out = emit(s, c, OUT, right)
    table = [out] * STATES
    text = s[c.start : c.end]
    for fence in (BACKTICKS, TILDES):
        table[fence] = emit(s, c, fence, right)[1] if "```" in text or "~~~" in text else fence
    if c.goes_on and c.followed:
        parts = list(_parts(s, c, OUT))
        if len(parts) == 2 and parts[0][0] == "part":  # one part of a paragraph from end to end
            for state in range(3, STATES):
                kind, depth, _ = _state_parts(state)
                table[state] = state
                if (kind < len(NESTED) or depth == 1) and _WITHIN[kind].search(text):
                    table[state] = emit(s, c, state, right)[1]
    return table, ends


def compose_prefixes(functions: list[list[int]]) -> np.ndarray:
    """Entry state of each chunk: composed functions of all chunks before it, in log steps."""
    f = np.asarray(functions, dtype=np.int64).reshape(-1, STATES)
    step = 1
    while step < len(f):
        f[step:] = np.take_along_axis(f[step:], f[:-step].copy(), axis=1)
        step *= 2
    return np.concatenate([[OUT], f[:-1, OUT]]) if len(f) else np.zeros(0, dtype=np.int64)


def unit_ends(text: str, size: int = CHUNK_CHARS) -> list[int]:
    """Ends of the units of a text, in code points; the same for chunks of any size."""
    cs = chunks_of(text, size)
    if len(cs) == 1:
        return emit(text, cs[0], OUT, NOTHING)[0]
    rights = compose_suffixes([chunk_right(text, c) for c in cs])
    tables, outside = zip(*(transition(text, c, r) for c, r in zip(cs, rights)))
    ends: list[int] = []
    for c, r, q, e in zip(cs, rights, compose_prefixes(list(tables)), outside):
        ends += e if q == OUT else emit(text, c, int(q), r)[0]
    return ends
