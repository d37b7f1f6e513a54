"""Problem 10: text that was decoded with the wrong character encoding.

Text is cut into sentences and lines.  For each piece in which a garbled stretch
can hide, a best-first search runs over the graph of unescape steps, rereadings
as UTF-8 (any number of rounds, each only of characters that the round before
made) and, as a last step, one rereading between legacy encodings.  Visited
states are kept in a set, every step has a toll, and a character-plausibility
cost guides the search to the cheapest reachable text.  It ends when the graph
is exhausted or when the tolls alone of every open state are above the best sum
found; no number of states, no length of a path ends it.

Evidence counts by document: where pieces differ, the path that explains most of
the document is preferred, and a legacy pair is chosen by what all its pieces
gain.  A piece is garbled if the cheapest text is clearly cheaper, or if it holds
replacement characters, which nothing restores.  A restoration must give the
garbled text back when it is written and read wrongly again.  Pieces left over
are tried together under each pair of single-byte encodings: what all of a
document's odd letters and signs, judged in its language, gain is one sum.

The cost looks at classes of neighbouring characters (a capital accented letter
behind a small letter, a symbol inside a word, two scripts in one word, control
characters, ...), so it needs no dictionary and behaves alike at every size.
Ordinary notation (powers of short symbols, units, fractions, relations between
numbers, prices) costs nothing.  Costs of all pieces of a batch are first taken
together from arrays of character codes; only pieces that can gain are searched.

Defined results: null and empty texts, and ASCII without escaped characters or
NULs, are not garbled and stay as they are; texts of any length are searched
piece by piece, whole; equal pieces are searched once per task (a bounded memo).
"""

from __future__ import annotations

import heapq
import html
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from lacuna.session import spread

# ---- encodings ----

# Encodings that text is wrongly read with, and those it was written in.
READ_AS_UTF8_SOURCE = ["cp1252", "mac_roman", "cp437", "cp850", "cp1250", "cp1251", "cp1254", "iso8859_2", "iso8859_15", "koi8_r", "cp866", "gbk", "cp932", "big5", "euc_kr"]
READ_AS_PAIRS = [
    ("cp1252", "cp1250"), ("cp1252", "iso8859_2"), ("cp1252", "cp1251"), ("cp1252", "koi8_r"), ("cp1252", "cp866"),
    ("cp1252", "mac_roman"), ("cp1252", "cp437"), ("cp1252", "cp850"), ("cp1252", "cp932"), ("cp1252", "gbk"), ("cp1252", "gb18030"), ("cp1252", "euc_jp"), ("cp1252", "big5"),
    ("cp437", "cp1252"), ("cp850", "cp1252"), ("mac_roman", "cp1252"), ("cp1250", "cp1252"), ("cp1251", "cp1252"), ("iso8859_2", "cp1252"),
    ("cp1251", "koi8_r"), ("koi8_r", "cp1251"), ("cp1251", "cp866"), ("cp866", "cp1251"), ("cp866", "koi8_r"), ("koi8_r", "cp866"), ("cp1251", "iso8859_5"), ("iso8859_5", "cp1251"),
    ("cp437", "cp1251"), ("cp437", "cp866"), ("cp437", "cp1250"), ("cp1250", "iso8859_2"), ("iso8859_2", "cp1250"), ("cp1250", "cp1251"), ("mac_roman", "cp1250"), ("cp1250", "cp437"),
    ("gbk", "cp932"), ("cp932", "gbk"), ("gbk", "cp1252"), ("gbk", "cp1251"), ("cp932", "cp1252"), ("big5", "gbk"), ("gbk", "big5"), ("cp932", "euc_jp"), ("gbk", "euc_jp"),
]
_MULTIBYTE = {"gbk", "gb18030", "cp932", "big5", "euc_jp", "euc_kr"}


@lru_cache(maxsize=None)
def _byte_table(encoding: str) -> dict[str, int]:
    """Character to byte; bytes the encoding leaves open stand for the control characters of that number."""
    table: dict[str, int] = {}
    for b in range(0x80, 0x100):
        try:
            table[bytes([b]).decode(encoding)] = b
        except UnicodeDecodeError:
            table[chr(b)] = b
    if encoding == "cp1252":
        for b in range(0x80, 0xA0):
            table.setdefault(chr(b), b)
    return table


@lru_cache(maxsize=None)
def _char_table(encoding: str) -> list[str | None]:
    out: list[str | None] = []
    for b in range(0x80, 0x100):
        try:
            out.append(bytes([b]).decode(encoding))
        except UnicodeDecodeError:
            out.append(None)
    return out


@lru_cache(maxsize=None)
def _byte_class(encoding: str, low: int, high: int) -> str:
    return "[" + "".join(re.escape(c) for c, b in _byte_table(encoding).items() if low <= b <= high) + "]"


@lru_cache(maxsize=None)
def _utf8_pattern(encoding: str) -> re.Pattern:
    """Characters that, as bytes of ``encoding``, are one well-formed multi-byte sequence of UTF-8."""
    tail = _byte_class(encoding, 0x80, 0xBF)
    two, three, four = _byte_class(encoding, 0xC2, 0xDF), _byte_class(encoding, 0xE0, 0xEF), _byte_class(encoding, 0xF0, 0xF4)
    return re.compile(f"(?:{two}{tail}|{three}{tail}{tail}|{four}{tail}{tail}{tail})+")


_UNDECODED = "\U0010fffe"


@lru_cache(maxsize=None)
def _translation(wrong: str, right: str) -> dict[int, str]:
    """What each character of ``wrong`` is in ``right``; bytes that ``right`` leaves open give a mark."""
    chars = _char_table(right)
    return {ord(c): chars[b - 0x80] or _UNDECODED for c, b in _byte_table(wrong).items()}


_HIGH_RUN = re.compile("[^\x00-\x7f]+")
State = tuple[str, str | None]  # a text, and "1" for each character that the last round made ("0" for others); None: all may be reread


@lru_cache(maxsize=None)
def _one_sequence(encoding: str) -> re.Pattern:
    return re.compile(_utf8_pattern(encoding).pattern[:-1])


def _narrow(run: str, encoding: str) -> str | None:
    table = _byte_table(encoding)
    try:
        return bytes(table[c] for c in run).decode("utf-8")
    except UnicodeDecodeError:
        return None


def _wide(run: str, encoding: str) -> str | None:
    try:
        return run.encode(encoding).decode("utf-8")
    except (UnicodeEncodeError, UnicodeDecodeError):
        return None


def _from_utf8(state: State, encoding: str) -> State | None:
    """Characters that are well-formed UTF-8 as bytes of ``encoding``, decoded; None if there are none."""
    text, fresh = state
    wide = encoding in _MULTIBYTE
    parts, flags, end = [], [], 0

    def take(lo: int, hi: int) -> None:
        nonlocal end
        run = text[lo:hi]
        out = _wide(run, encoding) if wide else _narrow(run, encoding)
        if out is None or out == run:
            return
        parts.extend((text[end:lo], out))
        flags.extend(("0" * (lo - end), "1" * len(out)))
        end = hi

    for m in (_HIGH_RUN if wide else _utf8_pattern(encoding)).finditer(text):
        lo, hi = m.span()
        if fresh is None or "0" not in fresh[lo:hi]:
            take(lo, hi)
        elif not wide:
            for one in _one_sequence(encoding).finditer(text, lo, hi):
                if "0" not in fresh[one.start() : one.end()]:
                    take(*one.span())
    if not end:
        return None
    return "".join(parts) + text[end:], "".join(flags) + "0" * (len(text) - end)


def _reread(text: str, wrong: str, right: str) -> str | None:
    """Each longest stretch that ``wrong`` can encode, decoded with ``right``; None if one cannot be decoded or none changes."""
    if wrong in _MULTIBYTE:
        try:
            out = text.encode(wrong).decode(right)
        except (UnicodeEncodeError, UnicodeDecodeError):
            return None
        return out if out != text else None
    table = _byte_table(wrong)
    if right in _MULTIBYTE:
        parts, run, odd, changed = [], bytearray(), False, False
        for at, c in enumerate(text + "\U0010ffff"):
            b = ord(c) if c < "\x80" else table.get(c)
            if b is not None:
                run.append(b)
                odd = odd or b >= 0x80
                continue
            if run:
                if odd:
                    try:
                        parts.append(bytes(run).decode(right))
                        changed = True
                    except UnicodeDecodeError:  # a stretch that is not in that encoding stays
                        parts.append("".join(text[at - len(run) : at]))
                else:
                    parts.append(run.decode("ascii"))
                run, odd = bytearray(), False
            parts.append(c)
        return "".join(parts)[:-1] if changed else None
    high = set(_HIGH.findall(text))
    known, open_ = _pair_sets(wrong, right)
    if high & open_ or not high & known:
        return None
    made = text.translate(_translation(wrong, right))
    return made if made != text else None


_HIGH = re.compile("[^\x00-\x7f]")


@lru_cache(maxsize=None)
def _pair_sets(wrong: str, right: str) -> tuple[frozenset, frozenset]:
    """Characters of ``wrong``, and those of them whose bytes ``right`` leaves open."""
    table = _translation(wrong, right)
    return frozenset(map(chr, table)), frozenset(chr(o) for o, c in table.items() if c == _UNDECODED)


@lru_cache(maxsize=None)
def _read_as(encoding: str) -> dict[int, str]:
    return {b: c for c, b in reversed(_byte_table(encoding).items())} | {b: chr(b) for b in range(0x80)}


def _garbled(text: str, written: str, read: str) -> str | None:
    """A text written in one encoding and read as another; what neither knows stays."""
    try:
        if written in _MULTIBYTE:
            raw = text.encode(written)
        else:
            table = _byte_table(written)
            if any(c > "\x7f" and c not in table for c in text):
                return "".join(c if c > "\x7f" and c not in table else _garbled(c, written, read) or c for c in text)
            raw = bytes(ord(c) if c < "\x80" else table[c] for c in text)
        return raw.decode(read) if read in _MULTIBYTE else "".join(map(_read_as(read).__getitem__, raw))
    except (UnicodeEncodeError, UnicodeDecodeError):
        return None


def _raw(text: str, encoding: str) -> bytes | None:
    """The bytes of a text; a control character stands for its own byte, which some readers keep and others replace."""
    try:
        if encoding in _MULTIBYTE:
            return text.encode(encoding)
        table = _byte_table(encoding)
        return bytes(ord(c) if c < "\x80" else table[c] for c in text)
    except (UnicodeEncodeError, KeyError):
        return None


_BLANKS = re.compile("([ \t\r\n]+)")


@lru_cache(maxsize=None)
def _stretches(wrong: str) -> re.Pattern:
    """Words, cut where a character is none of the encoding."""
    if wrong in _MULTIBYTE:
        return re.compile("[^ \t\r\n]+")
    return re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f!-\x7f" + "".join(map(re.escape, _byte_table(wrong))) + "]+")


def _reread_stretches(text: str, wrong: str, right: str) -> tuple[str, bool] | None:
    """``_reread`` of the garbled stretches of a text: one that would get clearly worse was sound and stays.

    Also says whether reading the result wrongly again gives the very text; control characters may stand for bytes that
    the encoding reads as something else.  None where nothing changes, or where the bytes of a stretch written again are
    not those it was read from.
    """
    out, end, same = [], 0, True
    for m in _stretches(wrong).finditer(text):
        made = None if m[0].isascii() else _reread(m[0], wrong, right)
        if made is None or cost(made, whole=False) > cost(m[0], whole=False) + SOUND_WORD:
            continue
        if _raw(made, right) != _raw(m[0], wrong):
            return None
        same = same and _garbled(made, right, wrong) == m[0]
        out += (text[end : m.start()], made)
        end = m.end()
    joined = "".join(out) + text[end:]
    return (joined, same) if joined != text else None


#: An escaped character beyond ASCII, or an escaped ampersand that hides one.
_ESCAPED = re.compile("&(?:#[0-9]{2,7}|#[xX][0-9a-fA-F]{2,6}|[A-Za-z][A-Za-z0-9]{1,30});")


def _unescape(state: State) -> State | None:
    text = state[0]
    if "&" not in text:
        return None

    def one(m: re.Match) -> str:
        made = html.unescape(m[0])
        return made if not made.isascii() or (made == "&" and _ESCAPED.match("&" + text[m.end() : m.end() + 34])) else m[0]

    out = _ESCAPED.sub(one, text)
    return (out, None) if out != text else None


_LITTLE, _BIG = re.compile("(?:[^\x00]\x00){3,}"), re.compile("(?:\x00[^\x00]){3,}")


def _without_nuls(text: str) -> str:
    """Stretches of two-byte characters that were read byte by byte."""
    for pattern, encoding in ((_LITTLE, "utf-16-le"), (_BIG, "utf-16-be")):
        try:
            text = pattern.sub(lambda m: m[0].encode("latin-1").decode(encoding), text)
        except (UnicodeEncodeError, UnicodeDecodeError):
            continue
    return text


# ---- plausibility ----

# Letters by how usual they are in European text.
_LATIN1_SMALL = "àáâãäåæçèéêëìíîïñòóôõöøùúûüýß"
_LATIN1_CAPITAL = "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝŒŸ"
_POLISH_SMALL = "ąćęłńśźżœ"
_POLISH_CAPITAL = "ĄĆĘŁŃŚŹŻ"
_OTHER_SMALL = "čďěňřšťůžğışőűțșăđð"
_OTHER_CAPITAL = "ČĎĚŇŘŠŤŮŽİŞĞŐŰȚȘĂĐ"
_RARE_CYRILLIC = "ъщэфюцЪЩЭФЮЦ"
_SYMBOLS = "¤¦¨ª¬¯²³´¶·¸¹º¼½¾÷±¢£¥€†‡‰ˆ˜‹›ƒⁿ⌐⌠⌡Þþÿ∙˙˚˝˛ˇ˘₧"
_MATH = "√∂∞≤≥∫∑∏≈≠◊∆Ω∩≡"
_QUOTES = "“”„‚‘«»¿¡…•"
_USUAL_MARKS = "\u0300\u0301\u0302\u0303\u0304\u0306\u0307\u0308\u030a\u030b\u030c\u0327\u0328"
_USUAL_PAIRS = re.compile("[çÇ][ãõÃÕ]|éé|ïé")

# Codes of character classes.
_GROUPS = {
    "l": _LATIN1_SMALL, "L": _LATIN1_CAPITAL, "f": _POLISH_SMALL, "F": _POLISH_CAPITAL, "i": _OTHER_SMALL, "I": _OTHER_CAPITAL,
    "s": _SYMBOLS, "m": _MATH, "q": _QUOTES, "u": "µμ", "o": "°", "-": "’–—×‑‐", "t": "§©®™№", "y": "\xa0\u202f", "Y": "\xad", "r": "\ufffd",
}
_FIXED = {c: code for code, group in _GROUPS.items() for c in group}


def _class_of(c: str) -> str:
    o = ord(c)
    if o < 0x80:
        if c.isalpha():
            return "a" if c.islower() else "A"
        if c.isdigit():
            return "0"
        return " " if c in " \t\n\r" else "z" if o < 0x20 or o == 0x7F else "."
    if c in _FIXED:
        return _FIXED[c]
    if o < 0xA0:
        return "z"
    if 0x410 <= o <= 0x44F or c in "ёЁ":
        return ("d" if c in _RARE_CYRILLIC else "c") if c.islower() else ("D" if c in _RARE_CYRILLIC else "C")
    if 0x400 <= o < 0x530:
        return "k"
    if 0x370 <= o < 0x400:
        return "g" if c.islower() else "G"
    if 0x2500 <= o < 0x25A0:
        return "b"
    if 0x3040 <= o < 0x3100:
        return "j"
    if 0x4E00 <= o < 0xA000:
        return "h"
    if c in "。、，・「」『』（）：；？！％ー〜～":
        return "p"
    kind = unicodedata.category(c)
    if kind in ("Co", "Cn", "Cs"):
        return "v"
    if kind == "Cc":
        return "z"
    if kind[0] == "L":
        return "x" if o < 0x250 or 0xFF61 <= o <= 0xFF9F else "." if 0xFB00 <= o <= 0xFB06 else "w"
    if kind[0] == "M":
        return "n" if c in _USUAL_MARKS else "." if 0xFE00 <= o <= 0xFE0F else "w"
    return "e" if 0x2460 <= o < 0x2474 or 0x2600 <= o < 0x27C0 or 0x1F300 <= o < 0x1FB00 or o == 0x200D else "w"


class _Classes(dict):
    def __missing__(self, o: int) -> str:
        self[o] = found = _class_of(chr(o))
        return found


_CLASSES = _Classes()
_ONE = {"z": 3.0, "r": 5.0, "v": 5.0, "k": 1.2, "x": 1.2, "w": 1.5, "i": 0.4, "I": 0.7, "d": 0.4, "D": 0.8, "l": 0.1, "L": 0.15, "f": 0.1, "F": 0.3, "g": 0.1, "G": 0.1, "s": 0.4, "t": 0.3, "m": 0.3, "q": 0.15, "h": 0.1, "j": 0.004, "u": 0.1, "o": 0.1, "y": 0.2, "Y": 0.4, "b": 0.3, "C": 0.15, "c": 0.004, "-": 0.12, "n": 0.1, "e": 0.2, "p": 0.05}
_LATIN, _CYRILLIC = "aAlLfFiI", "cCdDk"


def _pair_costs() -> dict[str, float]:
    costs: dict[str, float] = {}

    def add(left: str, right: str, weight: float, both: bool = False) -> None:
        for x in left:
            for y in right:
                costs[x + y] = costs.get(x + y, 0.0) + weight
        if both:
            add(right, left, weight)

    add("alficd", "LFI", 2.5)  # a small letter, then a capital one with a mark
    add("cd", "CD", 2.5)
    add(_LATIN, _CYRILLIC, 3.0, both=True)  # two scripts in one word
    add(_LATIN, "g", 2.0, both=True)
    add("lLfFiI", "G", 2.0, both=True)
    add("a", "G", 1.5)
    add("A", "q", 0.3)
    add("gGcCdDk", "hj", 1.5, both=True)
    add("lLfFiI", "h", 0.6, both=True)
    add("aA", "h", 0.3, both=True)
    add("aAlLfFiI0", "w", 0.5, both=True)
    add("lLfFiI0 .-" + "hjgGcCsmqb", "n", 1.5)
    add("lLfFiI", "p", 0.3, both=True)
    add(_LATIN + _CYRILLIC + "gG", "s", 1.2, both=True)  # a symbol at a letter
    add("LFI", "o", 1.5)
    add("lfi", "o", 1.5)
    add("s", "tso", 0.8, both=True)
    add(_LATIN + _CYRILLIC + "gG0uosmq", "b", 1.8, both=True)  # frame drawing inside text
    add("b", "b", -0.28)
    add("aAlLfF", "m", 1.2)
    add("m", "lLsqtfo", 1.5)
    add("sG", "m", 1.0)
    add("lLfFiI", "t", 1.2)
    add("t", "lLfFiI", 1.0)
    add("gG", "lLsoqtiIy", 1.5)
    add("l", "lL", 0.8)
    add("L", "l", 0.5)
    add("L", "L", 0.2)  # words in capitals
    add("lLfFiIGbsmg", "y", 0.8)
    add("y", "smGgbt", 0.8)
    add("aA", "u", 0.8)
    add("u", "0", 0.8)
    add("aAlLfFcC", "Y", 0.2)
    return costs


_TWO = _pair_costs()
_THREE = [
    (re.compile("(?<=[alfic])s(?=[alfic])"), 1.5),
    (re.compile("(?<=[alfi])q(?=[alfi])|(?<=[AL])q(?=[AL])"), 1.2),
    (re.compile("(?<=0)[lLfFiIsgG](?=0)"), 1.5),
    (re.compile("(?<=[lL]{2})l|(?<=l[lL])L"), 0.8),
    (re.compile("(?<=[CD]{3})[CD]"), 0.4),
    (re.compile("(?<=[LFI])[q-](?=[lLqts])"), 1.0),
]
_EAST_ASIAN = re.compile("hhh|[jp]")
_LONE_IDEOGRAPH = re.compile("[aAlLfFiI]h|h[aAlLfFiI]")
_SAME_LETTER = re.compile(r"([^\W\d_\x00-\x7f])\1\1")
_STRANGE_ASCII = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]")


# Ordinary notation of formulas, units and prices, each sign replaced by one ASCII character before anything is judged.
_POWERS = "²³¹⁰⁴-⁹⁻⁺₀-₉ⁿ"
_NOTATION = re.compile(f"[{_POWERS}½¼¾⅓⅔⅛µμ°±×÷≥≤≈≠≡∞√∑∫Ω£€¥¢§·]+")
_LETTER = f"[^\\W\\d_{_POWERS}½¼¾⅓⅔⅛]"
_ALONE_BEFORE = f"(?<!{_LETTER})"
_ORDINARY = re.compile(
    # a power or index behind a number, a bracket or a short symbol
    rf"(?:(?<=[0-9)\]}}|])|(?<={_ALONE_BEFORE}[A-Za-zµμΩ\u0391-\u03c9])|(?<={_ALONE_BEFORE}[A-Za-zµμΩ\u0391-\u03c9][A-Za-z])|(?<={_ALONE_BEFORE}(?:chi|log|sin|cos|tan|mol|min)))[{_POWERS}]+(?!{_LETTER})"
    r"|(?<![^\s\d(±≈<>~=,;:–-])[½¼¾⅓⅔⅛](?![^\s\d.,;:)%°-])"
    rf"|{_ALONE_BEFORE}[µμ](?=(?:mol|Pa|Sv|Gy|[mglLsAVWFMCNJHT])(?!{_LETTER}))"
    r"|(?:(?<=[0-9½¼¾])|(?<=[0-9½¼¾][ \xa0]))°(?![a-z\u00df-\u00ff])"
    r"|(?<![^\s(\[])[±×÷≥≤≈≠≡∞∑∫](?=\s)|(?<![^\s\d(\[=<>~,;])[±×÷≥≤≈≠](?=\s?[0-9½¼¾])|√(?=[0-9(])|(?<=[0-9])·(?=[0-9])"
    rf"|(?:{_ALONE_BEFORE}|(?<={_ALONE_BEFORE}[kMGmµ]))Ω(?!{_LETTER})"
    rf"|{_ALONE_BEFORE}[£€¥](?=\s?[0-9])|(?:(?<=[0-9])|(?<=[0-9][ \xa0]))[€£¥¢](?!{_LETTER})"
    rf"|{_ALONE_BEFORE}§(?=\s?[0-9])"
)
_AS_ASCII = {ord(c): x for group, x in (("²³¹⁰⁴⁵⁶⁷⁸⁹⁻⁺₀₁₂₃₄₅₆₇₈₉ⁿ", "2"), ("½¼¾⅓⅔⅛", "5"), ("µμ", "u"), ("°", "o"), ("±×÷≥≤≈≠≡∞√∑∫·", "+"), ("Ω", "O"), ("£€¥¢", "E"), ("§", "S")) for c in group}


def plain_notation(text: str) -> str:
    """The text, as long as before, with signs that stand in ordinary notation as ASCII characters."""
    parts, end = [], 0
    for run in _NOTATION.finditer(text):
        at, stop = run.span()
        while at < stop:
            m = _ORDINARY.match(text, at)
            if m:
                parts += (text[end:at], m[0].translate(_AS_ASCII))
                at = end = m.end()
            else:
                at += 1
    return "".join(parts) + text[end:] if parts else text


def cost(text: str, whole: bool = True) -> float:
    """How implausible the characters of a text are beside each other; plain ASCII costs nothing.

    ``whole``: no text of an ideographic script stands around it.
    """
    if text.isascii() and not _STRANGE_ASCII.search(text):
        return 0.0
    text = plain_notation(text)
    classes = text.translate(_CLASSES)
    total = 0.0
    for code in set(classes):
        if code in _ONE:
            total += _ONE[code] * classes.count(code)
    get = _TWO.get
    for pair in map(str.__add__, classes, classes[1:]):
        weight = get(pair)
        if weight:
            total += weight
    for pattern, weight in _THREE:
        total += weight * len(pattern.findall(classes))
    if whole and "h" in classes and not _EAST_ASIAN.search(classes):
        total += 0.5 * classes.count("h") + 2.0 * len(_LONE_IDEOGRAPH.findall(classes))  # lone ideographs in text of another script
    total -= 0.8 * len(_USUAL_PAIRS.findall(text))
    total += 1.0 * len(_SAME_LETTER.findall(text))
    return max(0.0, total)


# ---- all pieces of a batch at once ----

_NARROW_SOURCES = [e for e in READ_AS_UTF8_SOURCE if e not in _MULTIBYTE]
_WIDE_BIT = 1 << len(_NARROW_SOURCES)


@lru_cache(maxsize=1)
def _tables() -> dict[str, np.ndarray]:
    """By character code: class, and for each narrow encoding a bit where the byte leads or continues a sequence of UTF-8."""
    classes = np.fromiter((ord(_class_of(chr(o))) for o in range(1 << 16)), dtype=np.uint8, count=1 << 16)
    one, two = np.zeros(128), np.zeros((128, 128))
    for c, w in _ONE.items():
        one[ord(c)] = w
    for c, w in _TWO.items():
        two[ord(c[0]), ord(c[1])] = w
    bits = {name: np.zeros(1 << 16, dtype=np.uint16) for name in ("lead2", "lead3", "lead4", "tail")}
    ranges = {"lead2": (0xC2, 0xDF), "lead3": (0xE0, 0xEF), "lead4": (0xF0, 0xF4), "tail": (0x80, 0xBF)}
    for i, encoding in enumerate(_NARROW_SOURCES):
        for c, byte in _byte_table(encoding).items():
            for name, (low, high) in ranges.items():
                if low <= byte <= high:
                    bits[name][ord(c)] |= 1 << i
    bits["wide"] = np.zeros(1 << 16, dtype=np.uint16)
    bits["wide"][0x2E80:] = _WIDE_BIT
    sets = {group: np.isin(np.arange(128), [ord(c) for c in group]) for group in ("alfi", "AL", "q", "0", "lLfFiIsgG", "LFI", "q-", "lLqts", "CD", "h", "jp", "alfic", "s", "lL", "aAlLfFiI")}
    return {"classes": classes, "one": one, "two": two, **bits, **sets}


def screen(pieces: list[str], plain: str | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For each (not empty) piece: a cost not below :func:`cost`, and the encodings (as bits) under which it holds a sequence of UTF-8.

    ``plain``: the joined pieces in plain notation, if the caller has them.
    """
    t = _tables()
    joined = "".join(pieces)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    judged = codes if plain is None or plain == joined else np.frombuffer(plain.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    lengths = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    n = len(codes)

    def ahead(x: np.ndarray, k: int) -> np.ndarray:
        return np.concatenate([x[k:], np.zeros(min(k, n), dtype=x.dtype)])[:n]

    c = t["classes"][np.minimum(judged, 0xFFFF)]
    for at in np.flatnonzero(judged > 0xFFFF):
        c[at] = ord(_CLASSES[int(judged[at])])
    same = np.ones(n, dtype=bool)  # the next character is of the same piece
    same[starts[1:] - 1] = False
    same[n - 1] = False
    two = same & ahead(same, 1)
    b, d = ahead(c, 1), ahead(c, 2)
    total = t["one"][c] + np.where(same, t["two"][c, b], 0.0)
    extra = np.zeros(n)
    for weight, left, middle, right in ((1.2, "alfi", "q", "alfi"), (1.2, "AL", "q", "AL"), (1.5, "0", "lLfFiIsgG", "0"), (1.5, "alfic", "s", "alfic"), (1.0, "LFI", "q-", "lLqts"), (0.8, "lL", "lL", "lL"), (0.4, "CD", "CD", "CD")):
        extra += weight * (t[left][c] & t[middle][b] & t[right][d])
    extra += 1.0 * ((judged > 0x7F) & (judged == ahead(judged, 1)) & (judged == ahead(judged, 2)))
    total += two * extra
    sums = np.add.reduceat(total, starts)
    east = (two & t["h"][c] & t["h"][b] & t["h"][d]) | t["jp"][c]
    letter = t["aAlLfFiI"]
    lone = 0.5 * t["h"][c] + 2.0 * (same & ((letter[c] & t["h"][b]) | (t["h"][c] & letter[b])))
    sums += np.add.reduceat(lone, starts) * (np.add.reduceat(east.astype(np.int64), starts) == 0)
    small = np.minimum(codes, 0xFFFF)
    tail = t["tail"][small]
    tail1, tail2 = ahead(tail, 1), ahead(tail, 2)
    bits = np.where(same, t["lead2"][small] & tail1, 0) | np.where(two, t["lead3"][small] & tail1 & tail2, 0)
    bits |= np.where(two & ahead(two, 1), t["lead4"][small] & tail1 & tail2 & ahead(tail, 3), 0)
    bits |= t["wide"][small]
    return sums, np.bitwise_or.reduceat(bits.astype(np.uint16), starts)


# ---- search ----

PAIR_MARGIN, PAIR_SHARE = 0.8, 0.45  # a piece reread between legacy encodings must get cheaper by this much, to this share
WIDE_MARGIN = 4.0  # a few letters in a row always make some ideographs, so these need a longer stretch
UTF8_MARGIN = 0.05  # well-formed UTF-8 is evidence in itself; the text must only get cheaper
SAME_PATH = 0.5  # a piece follows the document's path if that costs it no more than this
CONTROLS_TOLL = 0.5  # a pair that leaves control characters unexplained stands behind one that gives the very text
SOUND_WORD = 0.5  # a word that a legacy rereading makes dearer by more than this was sound
_EAST = {"gbk": False, "gb18030": False, "big5": False, "cp932": True, "euc_jp": True}
_KANA = re.compile("[\u3040-\u30ff]")
_FREQUENT = {"cp1252", "mac_roman", "cp437", "cp850", "cp1250", "cp1251", "gbk"}
_PAIR_TOLL = 0.4
# What follows from these: a piece below the first bound is no hit by itself, one below the second shares no other piece's evidence.
PAIR_ALONE, PAIR_WITH_OTHERS = PAIR_MARGIN + _PAIR_TOLL, _PAIR_TOLL / PAIR_SHARE
Path = tuple[str, ...]


def _toll(encoding: str) -> float:
    return 0.02 if encoding in _FREQUENT else 0.3


def _pair_toll(right: str, out: str) -> float:
    # Japanese has kana, Chinese has none
    return _PAIR_TOLL + (0.3 if right in _EAST and bool(_KANA.search(out)) != _EAST[right] else 0.0)


def _sources(bits: int) -> list[str]:
    return [e for e in READ_AS_UTF8_SOURCE if (bits & _WIDE_BIT if e in _MULTIBYTE else bits >> _NARROW_SOURCES.index(e) & 1)]


def _cheapest_utf8(text: str, start: float, sources: list[str]) -> tuple[float, str, Path]:
    """Cheapest text that rereadings as UTF-8 lead to, with its cost and tolls; the text itself if none is cheaper.

    ``sources``: encodings under which the text itself holds a sequence.
    """
    best, best_text, best_path = start, text, ()
    heap: list[tuple[float, int, float, State, Path]] = [(start, 0, 0.0, (text, None), ())]
    seen, order = {(text, None)}, 0
    while heap:
        _, _, tolls, state, path = heapq.heappop(heap)
        for encoding in READ_AS_UTF8_SOURCE if path else sources:
            sum_ = tolls + _toll(encoding)
            if sum_ >= best:
                continue  # costs are not negative, so nothing behind this step can be cheaper
            out = _from_utf8(state, encoding)
            if out is None or out in seen:
                continue
            seen.add(out)
            worth, way = cost(out[0]) + sum_, (*path, f"{encoding}>utf-8")
            if worth < best:
                best, best_text, best_path = worth, out[0], way
            order += 1
            heapq.heappush(heap, (worth, order, sum_, out, way))
    return best, best_text, best_path


def _along(text: str, path: Path) -> tuple[float, str] | None:
    """Where a given path leads from a text, with cost and tolls."""
    state: State = (text, None)
    tolls = 0.0
    for step in path:
        encoding = step.partition(">")[0]
        out = _unescape(state) if step == "unescape" else _from_utf8(state, encoding)
        if out is None:
            return None
        state, tolls = out, tolls + (_UNESCAPE_TOLL if step == "unescape" else _toll(encoding))
    return cost(state[0]) + tolls, state[0]


_UNESCAPE_TOLL = 0.02


def restore_piece(text: str, bits: int | None = None) -> tuple[float, float, str, Path]:
    """What the cheapest rereading as UTF-8 gains, its cost with tolls, its text and its path (empty if there is none).

    Each stage of unescaping is a root of its own: a rereading must be cheaper than the unescaped text it starts from.
    """
    found = (0.0, 0.0, text, ())
    root, unescaped = text, 0
    while True:
        if bits is None or unescaped:
            bits = int(screen([root])[1][0])
        sources = [e for e in _sources(bits) if _from_utf8((root, None), e) is not None]
        if sources:
            start = cost(root)
            worth, out, path = _cheapest_utf8(root, start, sources)
            gain = start - worth - _UNESCAPE_TOLL * unescaped
            if path and gain >= UTF8_MARGIN and gain > found[0]:
                found = (gain, worth, out, ("unescape",) * unescaped + path)
        nxt = _unescape((root, None))
        if nxt is None:
            return found
        root, unescaped = nxt[0], unescaped + 1


def pair_rereadings(text: str) -> list[tuple[str, float, float, str]]:
    """(pair, gain, cost after with toll, text) for every legacy pair under which a piece gets clearly cheaper."""
    start, out = cost(text), []
    if start < PAIR_WITH_OTHERS:
        return out
    for wrong, right in READ_AS_PAIRS:
        whole = _reread(text, wrong, right)
        better = None if whole is None else _reread_stretches(text, wrong, right)
        if better is not None:
            after = cost(better[0]) + _pair_toll(right, whole) + (0.0 if better[1] else CONTROLS_TOLL)
            if after <= PAIR_SHARE * start:  # nothing dearer is a hit or shares in one
                out.append((f"{wrong}>{right}", start - after, after, better[0]))
    return out


def _is_hit(pair: str, gain: float, after: float) -> bool:
    return gain >= (WIDE_MARGIN if pair.split(">")[1] in _MULTIBYTE else PAIR_MARGIN) and after <= PAIR_SHARE * (gain + after)


_CUT = re.compile("((?<=[.!?;:])[ ]+|\n+|(?<=[。！？]))")
_MEMO_CHARS = 400  # longer pieces hardly ever repeat and are not kept


@lru_cache(maxsize=20_000)
def _known_piece(text: str, bits: int) -> tuple[float, float, str, Path]:
    return restore_piece(text, bits)


@lru_cache(maxsize=20_000)
def _known_pairs(text: str) -> list[tuple[str, float, float, str]]:
    return pair_rereadings(text)


def _by_utf8(pieces: list[str], bits: np.ndarray) -> dict[int, tuple[str, Path, float]]:
    """Pieces that rereadings as UTF-8 restore, with the cost left; the path of most of the document is preferred."""
    own: dict[int, tuple[float, float, str, Path]] = {}
    for i, piece in enumerate(pieces):
        if bits[i] or "&" in piece:
            got = _known_piece(piece, int(bits[i])) if len(piece) <= _MEMO_CHARS else restore_piece(piece, int(bits[i]))
            if got[3]:
                own[i] = got
    votes: dict[Path, float] = {}
    for gain, _, _, path in own.values():
        votes[path] = votes.get(path, 0.0) + gain
    out = {}
    ranked = sorted(votes, key=lambda p: (-votes[p], p))
    for i, (_, worth, text, path) in own.items():
        for other in ranked[: ranked.index(path)]:
            led = _along(pieces[i], other)
            if led is not None and led[0] <= worth + SAME_PATH and len(led[1]) <= len(text):  # it leaves no more sequences
                (worth, text), path = led, other
                break
        out[i] = (_rest_of(pieces[i], text), path, worth)
    return out


def _explains_all(piece: str, path: Path) -> bool:
    """Whether the first rereading of a path takes in every character beyond ASCII."""
    out = None if path[0] == "unescape" else _from_utf8((piece, None), path[0].partition(">")[0])
    return out is not None and not any(c > "\x7f" and f == "0" for c, f in zip(*out))


def _rest_of(before: str, after: str) -> str:
    """Words of a restored piece that no step has touched and that were garbled another way are restored by themselves."""
    words, old = _BLANKS.split(after), set(_BLANKS.split(before))
    for k, word in enumerate(words):
        if not word.isascii() and word in old and _SEQUENCE.search(word):
            words[k] = restore_piece(word)[2]
    return "".join(words)


#: Two neighbouring characters that may be bytes of one sequence, or one that a wide encoding reads from two bytes.
_SEQUENCE = re.compile("[^\x00-\x7f]{2}|[\u2e80-\uffff]")


def _by_pairs(pieces: list[str], lang: str) -> dict[int, tuple[str, Path, float]]:
    """Pieces reread between legacy encodings, with the cost left: one pair at a time, that which gains most over the document."""
    offers: dict[int, dict[str, tuple[float, float, str]]] = {}
    for i, piece in enumerate(pieces):
        got = _known_pairs(piece) if len(piece) <= _MEMO_CHARS else pair_rereadings(piece)
        if got:
            offers[i] = {pair: (gain, after, text) for pair, gain, after, text in got}
    out: dict[int, tuple[str, Path, float]] = {}
    while offers:
        score: dict[str, float] = {}
        for offer in offers.values():
            for pair, (gain, after, text) in offer.items():
                if _is_hit(pair, gain, after):
                    score[pair] = score.get(pair, 0.0) + gain - 0.45 * _foreign(text, lang)
        if not score:
            break
        order = {f"{w}>{r}": k for k, (w, r) in enumerate(READ_AS_PAIRS)}
        best = max(score, key=lambda p: (score[p], -order[p]))
        for i in [i for i, offer in offers.items() if best in offer]:
            gain, after, text = offers[i][best]
            # a piece that is no hit by itself shares the evidence of the others
            if after <= PAIR_SHARE * (gain + after) or _is_hit(best, gain, after):
                out[i] = (text, (best,), after)
                del offers[i]
        offers = {i: offer for i, offer in offers.items() if i not in out and any(_is_hit(p, g, a) for p, (g, a, _) in offer.items() if p != best)}
        for offer in offers.values():
            offer.pop(best, None)
    return out


#: Replacement characters and C1 controls (other than the line mark) stand in no correct text.
_LOST = re.compile("[\ufffd\x80-\x84\x86-\x9f]")


# ---- evidence of a whole document ----

# Marked letters of languages, and their words of one such letter.
_ALPHABETS = {
    "de": "äöüß", "fr": "àâæçèéêëîïôœùûüÿ", "es": "áéíóúüñ", "pt": "àáâãçéêíóôõúü", "pl": "ąćęłńóśźż", "cs": "áčďéěíňóřšťúůýž",
    "da": "æøåé", "sv": "äöåé", "is": "áéíóúýþæöð", "hu": "áéíóöőúüű", "it": "àèéìòù", "tr": "âçğıîöşüû", "ro": "ăâîșțşţ", "en": "",
}
_ALONE = {"fr": "à", "pt": "àéáó", "es": "áóé", "it": "èàòé", "cs": "áó", "pl": "ó", "sv": "åö", "da": "åø", "hu": "ő"}
_CODES = {"pol": "pl", "deu": "de", "ger": "de", "fra": "fr", "fre": "fr", "spa": "es", "por": "pt", "eng": "en"}
_ANY_ALONE = "".join(_ALONE.values())
POOL_MARGIN, POOL_SHARE = 0.8, 0.3  # what all pieces of a document must gain under one pair, and the share of oddness that may stay
_TOKEN = re.compile(r"[^\W\d_]*[^\x00-\x7f][^\W\d_]*")


def _language(lang: str | None) -> str:
    code = re.split("[-_]", (lang or "").strip().lower())[0]
    return _CODES.get(code, code)


def _odd_word(word: str, before: str, after: str, lang: str) -> float:
    """How odd one run of letters with marked ones is where it stands."""
    low = word.lower()
    marked = [c for c in low if c > "\x7f"]
    if len(word) == 1:
        if "\u0370" <= word < "\u0400" or word in "µ":
            return 0.1
        if "\u0400" <= word < "\u0530":
            return 0.0 if low in "авикосуя" and lang not in _ALPHABETS else 1.0
        if "\u00c0" <= word < "\u0250":
            if before.isdigit() and after.isdigit():
                return 1.0
            return 0.0 if low in _ALONE.get(lang, _ANY_ALONE if lang not in _ALPHABETS else "") else 0.9
        return 0.0
    own = _ALPHABETS.get(lang)
    if low[1:] in ("m", "c", "l", "g") and not word[0].isascii() and low[0] not in (own or ""):
        return 0.0 if word[0] in "µμ" else 1.0  # a unit with something else for its first sign
    if any(not (c < "\x80" or "\u00c0" <= c < "\u0250") for c in low):
        return 0.0  # other scripts, and two in a word, are judged by the cost of neighbours
    total = 0.0
    if any(a.islower() and b.isupper() for a, b in zip(word, word[1:]) if a > "\x7f" or b > "\x7f"):
        total += 1.2
    if len(word) > 2 and word[0].isupper() and word[1].isupper() and not word[1].isascii() and word[2:].islower():
        total += 1.2  # a capital letter, a marked capital one, then small letters
    if word.islower() and own is not None and before != "-":
        total += 0.9 * sum(c not in own for c in marked)  # names may hold any letter, common words not
    elif len(set(marked)) > 1 and not any(all(c in a for c in marked) for a in _ALPHABETS.values()):
        total += 0.9  # letters that no one language has together
    return total


_INSIDE = set("°¿¡¸¯¨´¦¬³²¹ªº¾½¼¤§¶÷±√∞≈≤≥∂∫∏∑Ω◊†‡‰ˆ˜˙˚˝˛ˇ˘ﬂﬁ…“”„«»€£¥¢™®©")
_SIGNS = set("†‡™®©◊¸¯¨´¦¬³²¹ªº¶¿¡ˆ˜˙˚˝˛ˇ˘¤") | {chr(o) for o in range(0x2550, 0x25A0)}


def _odd_sign(text: str, at: int) -> float:
    """How odd a sign is where it stands."""
    c, before, after, beyond = text[at], text[max(0, at - 1) : at], text[at + 1 : at + 2], text[at + 2 : at + 3]
    if c == "°":
        return 1.0 if before.isalpha() and after.isalpha() and after.islower() else 0.0
    if after == "C" and not beyond.isalpha() and (before == " " or before.isdigit()):
        return 1.0  # a temperature without its sign
    if before.isdigit() and after.isdigit():
        return 0.0 if c in "×–—·’±" else 1.0
    if c in "–—" and before.isalpha() and after.isalpha():
        return 0.1 if text[max(0, at - 3) : at].isalpha() and text[at + 1 : at + 4].isalpha() and min(at, len(text) - at - 1) > 2 else 0.9  # words on both sides, not a letter
    if c in "–—":
        return 0.5 if before.isalpha() != after.isalpha() and (before + after).strip() != "" and (before == " ") != (after == " ") else 0.1
    if before.isalpha() and after.isalpha() and c not in "’·­":
        return 1.0
    if before == "-" and after.isalpha() and c in _INSIDE:
        return 1.0
    if before == " " and after == " " and c in _SIGNS:
        return 0.9
    return 0.05


def oddness(text: str, lang: str) -> float:
    """How odd the marked letters and signs of a text are in that language; the sum over their places."""
    text = plain_notation(text)
    total = 0.0
    at, end = 0, len(text)
    while at < end:
        m = _TOKEN.search(text, at)
        if not m:
            break
        lo, hi = m.span()
        # a run of letters around the first sign or marked letter; signs stand for themselves
        word = m[0]
        if word.isalpha():
            total += _odd_word(word, text[lo - 1] if lo else "", text[hi] if hi < end else "", lang)
            at = hi
            continue
        k = next(i for i in range(lo, hi) if text[i] > "\x7f" and not text[i].isalpha())
        head = text[lo:k]
        if head and not head.isascii():
            total += _odd_word(head, text[lo - 1] if lo else "", text[k], lang)
        total += _odd_sign(text, k)
        at = k + 1
    return total


def _foreign(text: str, lang: str) -> int:
    """Marked letters in small-letter words that the language does not write; 0 where the language is not known."""
    own = _ALPHABETS.get(lang)
    if own is None:
        return 0
    return sum(sum(c > "\x7f" and c not in own for c in word) for word in _TOKEN.findall(text) if word.islower())


_NARROW_PAIRS = [(w, r) for w, r in [*READ_AS_PAIRS, ("iso8859_2", "cp1252"), ("cp437", "iso8859_2"), ("cp850", "cp1250"), ("cp850", "cp1251"), ("cp1250", "mac_roman")] if w not in _MULTIBYTE and r not in _MULTIBYTE]
_NARROW_PAIRS = list(dict.fromkeys([("mac_roman", "cp1252"), ("cp1250", "cp1252"), ("cp437", "cp1252"), ("cp1250", "mac_roman"), *_NARROW_PAIRS]))  # the first of equals is taken


POOL_PIECE = 0.3  # pieces less odd than this are left as they are
_QUOTED = "’(?!C)|(?<![^ \\n(])“(?!C)|”(?![A-Za-z0-9])"  # marks where they usually stand, 0.05 each
_DASHED = "(?<=[A-Za-z]{3})[–—](?=[A-Za-z]{3})|×|(?<=[A-Za-z0-9.])…(?=[ \\n]|$)"  # 0.1 and less each
_RUSSIAN = "а-яёА-ЯЁ"


@lru_cache(maxsize=64)
def _quiet(lang: str) -> re.Pattern:
    """Pieces whose oddness is surely below ``POOL_PIECE``: ASCII, small letters of the language inside words, and at most five usual quotation marks or two other usual marks."""
    usual = r"[\x00-\x7f]++"
    own = _ALPHABETS.get(lang, "")
    if own:
        usual += f"|(?<=[A-Za-z{own}])[{own}](?![A-Z])|[{own}](?=[a-z{own}])"
    elif lang == "ru":
        usual += f"|(?<=[{_RUSSIAN}])[{_RUSSIAN}]|[{_RUSSIAN}](?=[{_RUSSIAN}])"
    return re.compile(f"(?:{usual})*+(?:(?:(?:{_QUOTED})(?:{usual})*+){{0,5}}|(?:(?:{_QUOTED}|{_DASHED})(?:{usual})*+){{0,2}})$")


def pooled_pair(pieces: list[str], lang: str) -> tuple[str, dict[int, str]] | None:
    """The one pair of encodings under which all changed pieces together lose their oddness, and those pieces as reread."""
    quiet = _quiet(lang)
    before = [0.0 if p.isascii() or quiet.match(plain_notation(p)) else oddness(p, lang) for p in pieces]
    if sum(b for b in before if b >= POOL_PIECE) < POOL_MARGIN:
        return None
    best, best_worth = None, 0.0
    for wrong, right in _NARROW_PAIRS:
        made, old, new = {}, 0.0, 0.0
        for i, piece in enumerate(pieces):
            if before[i] < POOL_PIECE:
                continue
            out = _reread(piece, wrong, right)
            if out is None or _STRANGE_ASCII.search(out) or _LOST.search(out):
                continue
            after, weird = oddness(out, lang), max(0.0, cost(out) - cost(piece) - 0.3)  # a sign alone costs no more
            if after + weird < before[i]:
                made[i], old, new = out, old + before[i], new + after + weird
        if old - new >= POOL_MARGIN and new <= POOL_SHARE * old and old - 2 * new > best_worth:
            best, best_worth = (f"{wrong}>{right}", made), old - 2 * new
    return best


def _is_clean(text: str | None) -> bool:
    """Nothing can be garbled in it: no text, or ASCII without escaped characters and control characters."""
    return not text or (text.isascii() and not _STRANGE_ASCII.search(text) and not _ESCAPED.search(text))


def _restore(parts: list[str], ceiling: np.ndarray, bits: np.ndarray, lang: str) -> tuple[bool, str, str]:
    """One document from its pieces, their costs at most and their possible encodings."""
    out, steps = list(parts), {}
    by_utf8 = _by_utf8(parts, bits)
    for i, (text, path, _) in by_utf8.items():
        out[i], steps[i] = text, " ".join(path)
    # sequences of UTF-8 also arise by chance, so what they leave implausible is tried as a legacy rereading as well
    dear = [i for i in range(len(parts)) if ceiling[i] >= PAIR_MARGIN and (i not in by_utf8 or by_utf8[i][2] >= PAIR_MARGIN and not _explains_all(parts[i], by_utf8[i][1]))]
    if any(ceiling[i] >= PAIR_ALONE for i in dear):
        for k, (text, path, left) in _by_pairs([parts[i] for i in dear], lang).items():
            if dear[k] not in by_utf8 or left < by_utf8[dear[k]][2]:
                out[dear[k]], steps[dear[k]] = text, " ".join(path)
    lost = {i for i in dear if i not in steps and _LOST.search(parts[i])}
    open_ = [i for i in range(len(parts)) if i not in steps and i not in lost and parts[i] and not parts[i].isascii()]
    pooled = pooled_pair([parts[i] for i in open_], lang) if open_ else None
    if pooled:
        for k, text in pooled[1].items():
            out[open_[k]], steps[open_[k]] = text, pooled[0]
    return bool(steps or lost), "".join(out), "; ".join(dict.fromkeys(steps[i] for i in sorted(steps)))


#: Characters of which the arrays of one screening hold at most so many.
SCREEN_CHARS = 1_000_000


def _portions(places: list[int], pieces: list[str]) -> Iterator[list[int]]:
    """Places in order, in portions of at most ``SCREEN_CHARS`` characters; a longer piece is a portion of its own."""
    some, size = [], 0
    for i in places:
        n = len(pieces[i])
        if some and size + n > SCREEN_CHARS:
            yield some
            some, size = [], 0
        some.append(i)
        size += n
    if some:
        yield some


def restore_texts(texts: list[str | None], langs: list[str | None]) -> list[tuple[bool, str | None, str]]:
    """For each text: whether it holds a garbled stretch, the text with all restorable stretches restored, and the steps used."""
    done: list[tuple[bool, str | None, str]] = [(False, t, "") for t in texts]
    todo, pieces = [], []
    for k, text in enumerate(texts):
        if _is_clean(text):
            continue
        if "\x00" in text:
            made = _without_nuls(text)
            if made != text:
                inner = restore_texts([made], [langs[k]])[0]
                done[k] = (True, inner[1], "; ".join(filter(None, ("latin-1>utf-16", inner[2]))))
                continue
        parts = [p for p in _CUT.split(text) if p]
        todo.append((k, len(pieces), len(pieces) + len(parts)))
        pieces += parts
    ceiling, bits = np.zeros(len(pieces)), np.zeros(len(pieces), dtype=np.uint16)
    judged = [i for i, p in enumerate(pieces) if not p.isascii() or _STRANGE_ASCII.search(p)]
    for some in _portions(judged, pieces):
        if len(pieces[some[0]]) > SCREEN_CHARS:  # longer than the arrays may be: judged by itself, under all encodings
            ceiling[some], bits[some] = cost(pieces[some[0]]), 2 * _WIDE_BIT - 1
        else:
            ceiling[some], bits[some] = screen([pieces[i] for i in some], "".join(plain_notation(pieces[i]) for i in some))
    for k, lo, hi in todo:
        done[k] = _restore(pieces[lo:hi], ceiling[lo:hi], bits[lo:hi], _language(langs[k]))
    return done


def restore_text(text: str | None, lang: str | None = None) -> tuple[bool, str | None, str]:
    """:func:`restore_texts` of one text."""
    return restore_texts([text], [lang])[0]


def restore_documents(documents: DataFrame) -> DataFrame:
    """doc_id, garbled, restored (no stretch is left), steps, text (as restored) of each document."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for at in range(0, len(frame), 256):
                part = frame.iloc[at : at + 256]
                done = restore_texts(part["text"].tolist(), part["lang"].tolist())
                yield pd.DataFrame(
                    {
                        "doc_id": part["doc_id"].to_numpy(),
                        "garbled": [x[0] for x in done],
                        "restored": [x[0] and not _LOST.search(x[1]) for x in done],
                        "steps": [x[2] for x in done],
                        "text": [x[1] for x in done],
                    }
                )

    return spread(documents.select("doc_id", "text", "lang" if "lang" in documents.columns else F.lit(None).cast("string").alias("lang"))).mapInPandas(work, "doc_id long, garbled boolean, restored boolean, steps string, text string")
