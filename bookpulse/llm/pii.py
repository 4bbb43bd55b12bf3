"""Personal data, with disguises undone by offset-preserving transducers.

Base patterns (fixed by contract) run over the text itself. Then transducers rewrite the text: look-alike characters to
the Latin letter or digit they imitate, zero-width characters to nothing, runs of spelled digits to digits, disguised
``at``, ``dot`` and ``plus`` to their signs. A second reading also takes single spelled digits and bare dots that touch
digits; it adds spans to those of the first. Each rewriting step gives, besides its output, where every output piece came
from (``Rewritten``), so a span found in the normal form maps back to source characters. A span is added only if it
touches a rewritten place and no base span; base spans stay as they are.

Offsets are code points of the source, ends exclusive. Null texts are empty; repeated rows give equal results, each its
own. Texts of any length are read whole, in time that grows with their length, blanks and digits included; texts without
any trigger of a pattern or transducer are passed over by plain searches.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bookpulse.llm.common import map_text

KINDS = ["email", "ip", "card", "phone"]

# The base patterns.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# (A match begins where a run of digits does: what fails there fails at every later digit of the run.)
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_DIGIT = re.compile("[0-9]")


class Span(NamedTuple):
    kind: str
    start: int
    end: int


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _ip(m: re.Match) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split("."))


def _card(m: re.Match) -> bool:
    digits = m[0].replace(" ", "").replace("-", "")
    return 13 <= len(digits) <= 19 and luhn(digits)


def _phone(m: re.Match) -> bool:
    return 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15


_LOCAL = re.compile("[A-Za-z0-9._%+-]")
_EMAIL_REST = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")


def _emails(text: str) -> list[Span]:
    """Leftmost matches of EMAIL, found from each @ outwards; the same spans without trying every word."""
    out, after, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > after and _LOCAL.match(text[start - 1]):
            start -= 1
        m = _EMAIL_REST.match(text, at) if start < at else None
        if m:
            out.append(Span("email", start, m.end()))
            after = m.end()
        at = text.find("@", max(at + 1, after))
    return out


def base_spans(text: str) -> list[Span]:
    """Spans of the base patterns, by kind and start: leftmost non-overlapping matches, failing ones dropped."""
    out = _emails(text) if "@" in text else []
    if _DIGIT.search(text):
        out += [Span("ip", *m.span()) for m in IP.finditer(text) if _ip(m)] if "." in text else []
        out += [Span("card", *m.span()) for m in CARD.finditer(text) if m.end() - m.start() >= 13 and _card(m)]
        out += [Span("phone", *m.span()) for m in PHONE.finditer(text) if _phone(m)] if "+" in text else []
    return out


# ---- transducers ----------------------------------------------------------------------------------------------


class Rewritten(NamedTuple):
    """A text and the places where a step changed it: (output start, output end, source start, source end), in order."""

    text: str
    edits: list[tuple[int, int, int, int]]

    def source(self, start: int, end: int) -> tuple[int, int]:
        """The source span of an output span; an edit that it touches is taken whole."""
        return self._at(start, False), self._at(end, True)

    def _at(self, i: int, is_end: bool) -> int:
        k = bisect_right(self.edits, i if not is_end else i - 1, key=lambda e: e[0]) - 1
        if k < 0:
            return i
        o1, o2, s1, s2 = self.edits[k]
        if i < o2 or is_end and i <= o2 and o2 > o1:
            return s2 if is_end else s1
        return s2 + i - o2

    def touched(self, start: int, end: int) -> bool:
        k = bisect_left(self.edits, end, key=lambda e: e[0])
        return any(e[1] > start or e[0] >= start for e in self.edits[max(0, k - 1) : k])


def rewrite(text: str, matches: Iterable[re.Match], by) -> Rewritten:
    """One transducer step: each match becomes ``by(match)``, unless that is None. Matches come in order, apart from each other."""
    parts, edits, done, length = [], [], 0, 0
    for m in matches:
        new = by(m)
        if new is None or new == m[0]:
            continue
        parts += (text[done : m.start()], new)
        length += m.start() - done
        edits.append((length, length + len(new), m.start(), m.end()))
        length += len(new)
        done = m.end()
    return Rewritten("".join(parts) + text[done:], edits) if edits else Rewritten(text, [])


# Cyrillic and Greek letters by the Latin letter that they look like.
_LOOKALIKES = {
    "a": "аɑα", "b": "Ьƅ", "c": "сϲ", "d": "ԁ", "e": "еҽ", "g": "ɡ", "h": "һ", "i": "іι", "j": "ј", "k": "κ", "l": "ӏ", "m": "ⅿ", "n": "ո", "o": "оοօ",
    "p": "рρ", "q": "ԛ", "r": "г", "s": "ѕ", "u": "υս", "v": "ѵν", "w": "ԝω", "x": "хχ", "y": "уγ", "A": "АΑ", "B": "ВΒ", "C": "СϹ", "E": "ЕΕ", "H": "НΗ",
    "I": "ІΙ", "J": "Ј", "K": "КΚ", "M": "МΜ", "N": "Ν", "O": "ОΟ", "P": "РΡ", "S": "Ѕ", "T": "ТΤ", "X": "ХΧ", "Y": "УΥ", "Z": "Ζ",
    "-": "‐‑‒–−", ".": "․。", "@": "＠﹫", "+": "＋﹢",
}
_LATIN = {look: latin for latin, looks in _LOOKALIKES.items() for look in looks}
_HIDDEN = "­​-‍⁠﻿"


def _latin(c: str) -> str | None:
    """What a character imitates: a look-alike, a compatibility form of one ASCII character, or another script's digit."""
    if c in _LATIN:
        return _LATIN[c]
    plain = unicodedata.normalize("NFKC", c)
    if len(plain) == 1 and 0x21 <= ord(plain) <= 0x7E:
        return plain
    digit = unicodedata.digit(c, None)
    return None if digit is None else str(digit)


class _Memo(dict):
    def __missing__(self, c: str):
        self[c] = found = "" if _is_hidden(c) else _latin(c)
        return found


_is_hidden = re.compile(f"[{_HIDDEN}]").match
_imitates = _Memo()
# Characters beyond Latin text (U+00B2, U+00B3 and U+00B9 are raised digits); ordinary letters with accents are not looked at.
_STRANGE = re.compile("[­²³¹ɑɡͰ-׿٠-٩۰-۹०-९​-‍‐-―․⁠⁰-₉−①-⓿。﹐-﻿＀-￯\U0001d400-\U0001d7ff]")

# Words for digits and signs, as people spell them out.
_SPELLED = {
    "zero": "0", "oh": "0", "null": "0", "cero": "0", "zéro": "0", "one": "1", "eins": "1", "uno": "1", "un": "1", "two": "2", "zwei": "2", "dos": "2", "deux": "2",
    "three": "3", "drei": "3", "tres": "3", "trois": "3", "four": "4", "vier": "4", "cuatro": "4", "quatre": "4", "five": "5", "fünf": "5", "cinco": "5", "cinq": "5",
    "six": "6", "sechs": "6", "seis": "6", "seven": "7", "sieben": "7", "siete": "7", "sept": "7", "eight": "8", "acht": "8", "ocho": "8", "huit": "8",
    "nine": "9", "neun": "9", "nueve": "9", "neuf": "9",
}
_WORD = "|".join(sorted(_SPELLED, key=len, reverse=True))
_AT, _DOT = r"(?:at|arroba|arobase)", r"(?:dot|punto|point|punkt)"
_JOIN = rf"(?:\s++{_DOT}\s++|[\x20,./-]{{0,3}})"
_ONE = rf"(?:plus\s++)?(?:(?:double|triple)\s++)?(?:{_WORD})(?!\w)(?:{_JOIN}\d(?!\w)){{0,19}}"
# Runs of at least three spelled digits, single digits in between allowed.
_RUN = re.compile(rf"(?<!\w){_ONE}(?:{_JOIN}{_ONE}){{2,}}", re.I)
_ITEM = re.compile(rf"plus|double|triple|{_DOT}|{_WORD}|\d", re.I)
_PLUS = re.compile(r"(?<!\w)[(\[]?plus[)\]]?[\x20]*(?=[0-9])", re.I)

# White space is tried from the start of its run only, and never given back: a text of blanks takes linear time.
_OPEN, _CLOSE = r"(?:(?<!\s)\s++)?[(\[{<]\s*+", r"\s*+[)\]}>]\s*+"
_AT_BRACKET = re.compile(rf"{_OPEN}(?:{_AT}|@){_CLOSE}", re.I)
_DOT_BRACKET = re.compile(rf"{_OPEN}(?:{_DOT}|\.){_CLOSE}", re.I)
# Bare words count only in the shape of an address: name at host dot ... ending, with a common ending.
# Common endings of host names.
_ENDINGS = "com org net edu gov mil int info biz name io co ai app dev me tv cc xyz online site de fr es uk us eu ch at be nl it pl pt ru jp cn in br mx ar au ca se no dk fi ie nz za example test invalid local"
_LOCAL_PART = rf"[A-Za-z0-9._%+-]+(?:\s++{_DOT}\s++[A-Za-z0-9._%+-]+)*"
_BARE = re.compile(
    rf"({_LOCAL_PART})(\s++_?{_AT}_?\s++|_{_AT}_|\s*+@\s*+)([A-Za-z0-9-]+)"
    rf"((?:(?:\s++{_DOT}\s++|_{_DOT}_|\s?\.\s?)[A-Za-z0-9-]+)*(?:\s++{_DOT}\s++|_{_DOT}_|\s?\.\s?)(?:{_ENDINGS.replace(' ', '|')})(?![\w-]))",
    re.I,
)
# Where at and dot are spelled out any ending counts. The host is no word that stands between at and dot in prose, and the
# ending none that prose goes on with. English has "at some point he" but no "at some dot he", so after at and point an
# ending that isn't listed has two letters and is no word.
# Words of prose; endings of host names among them are only in the second list.
_BEFORE = "the a an this that these those which what some any one each every no my your his her its our their der die das dem den el la los las le les un une una ein eine"
_AFTER = "the an this that these those of on or and but if he she we they was were are has had have for from with when where which who el los las y que por con para un una lo der die das den dem und oder ist sind war ein eine zu auf mit von le les des ou est sont dans sur par pour avec une aux"
_WORDS_OF_TWO = _AFTER + " ah am as by do eh go hi ha is la ma mm my oh ok pa so to up al du et je ja ne ni se si su tu va ya"
_none_of = lambda words: rf"(?!(?:{words.replace(' ', '|')})(?![\w-]))"


def _spelled_out(at: str, dot: str, ending: str) -> re.Pattern:
    spelled, label = rf"(?:\s++{dot}\s++|_{dot}_)", "[A-Za-z0-9-]+"
    return re.compile(
        rf"({_LOCAL_PART})(\s++_?{at}_?\s++|_{at}_|\s*+@\s*+)({_none_of(_BEFORE)}{label})"
        rf"((?:\.{label})*{spelled}(?:{label}(?:{spelled}|\.))*(?:{ending})(?![\w-]))",
        re.I,
    )


_ANY_ENDING = [
    _spelled_out(_AT, "(?:dot|punto|punkt)", _none_of(_AFTER) + "[a-z]{2,}"),
    _spelled_out("(?:arroba|arobase)", _DOT, _none_of(_AFTER) + "[a-z]{2,}"),
    _spelled_out(_AT, _DOT, _none_of(_WORDS_OF_TWO) + "[a-z]{2}"),
]
_BARE_DOT = re.compile(rf"(?<!\s)\s++{_DOT}\s++|_{_DOT}_", re.I)
# What can stand before an at as a whole, and whether an at follows.
_CHAIN = re.compile(rf"(?<![\w.%+-])[A-Za-z0-9._%+-]++(?:\s++{_DOT}\s++[A-Za-z0-9._%+-]++)*+", re.I)
_AT_NEXT, _AT_WITHIN = re.compile(rf"\s++_?{_AT}_?\s|\s*+@", re.I), re.compile(rf"_{_AT}_", re.I)
_SPACED_AT = re.compile(r"\s@|@\s")
_TRIGGER_DIGIT = re.compile(rf"(?<!\w)(?:{_WORD}){_JOIN}(?:(?:plus|double|triple)\s++)?(?:{_WORD}|\d)", re.I)

# The second reading: spelled digits in any number that touch digits, and a bare dot between digits.
_ONE_WORD = rf"(?:(?:double|triple)\s++)?(?:{_WORD})(?![^\W\d_])"
_NEXT = rf"(?:\s++{_DOT}\s++|_{_DOT}_|[\x20().-]{{0,3}})"
_FEW = re.compile(rf"(?<![^\W\d_]){_ONE_WORD}(?:{_NEXT}{_ONE_WORD})*", re.I)
_FEW_ITEM = re.compile(rf"(double|triple)\s+|({_WORD})|\s+{_DOT}\s+|_{_DOT}_|\x20+|.", re.I | re.S)
_DIGIT_BEFORE = re.compile(rf"(?:[0-9+]|(?<!\w)plus){_NEXT}$", re.I)
_DIGIT_AFTER = re.compile(rf"{_NEXT}[0-9]", re.I)
_DIGIT_DOT = re.compile(rf"(?<=[0-9])(?:\s++{_DOT}\s++|_{_DOT}_)(?=[0-9])", re.I)
_NUMBER = re.compile(r"\d+")
_WORD_BEFORE = re.compile(r"([^\W\d_]+)[\W_]*$")
_WORD_AFTER = re.compile(r"[\W_]{0,6}([^\W\d_]+)")
_AFTER_PLUS = re.compile(rf"(?:\+|(?<!\w)plus)[\W_]{{1,6}}(?:{_WORD})|\+(?:{_WORD})")
_NEAR_DIGITS = {*_SPELLED, "dot", "punto", "point", "punkt", "double", "triple"}


def _second(text: str) -> bool:
    """Whether a number of any script stands by a spelled digit or dot, or a spelled digit by a plus."""
    for m in _NUMBER.finditer(text):
        after = _WORD_AFTER.match(text, m.end())
        if after and after[1].lower() in _NEAR_DIGITS:
            return True
        before = _WORD_BEFORE.search(text[max(0, m.start() - 16) : m.start()])
        if before and before[1].lower() in _NEAR_DIGITS:
            return True
    return ("+" in text or "plus" in text.lower()) and bool(_AFTER_PLUS.search(text.lower()))


# Digits that are other words as well; they count between digits only.
_OTHER_WORDS = {"one", "un", "uno", "oh", "null", "dos", "sept"}


def _few(m: re.Match) -> str | None:
    left = _DIGIT_BEFORE.search(m.string[max(0, m.start() - 24) : m.start()])
    right = _DIGIT_AFTER.match(m.string[m.end() : m.end() + 24])
    if not (left or right) or not (left and right) and m[0].lower() in _OTHER_WORDS:
        return None
    out, times = "", 1
    for x in _FEW_ITEM.finditer(m[0]):
        if x[1]:
            times = 2 if x[1].lower() == "double" else 3
        elif x[2]:
            out, times = out + _SPELLED[x[2].lower()] * times, 1
        elif x[0].isspace():
            continue
        else:
            out += x[0] if len(x[0]) == 1 else "."
    return out


def _digits(m: re.Match) -> str:
    out, times = "", 1
    for x in _ITEM.findall(m[0].lower()):
        if x == "plus":
            out += "+"
        elif x in ("dot", "punto", "point", "punkt"):
            out += "."
        elif x in ("double", "triple"):
            times = 2 if x == "double" else 3
        else:
            out, times = out + _SPELLED.get(x, x) * times, 1
    return out


def _bare(m: re.Match) -> str | None:
    local, at, host, rest = m.groups()
    if not _BARE_DOT.search(rest) and (at.strip() != "@" or at == "@"):
        return None  # "look at example.com" is plain text
    plain = lambda s: re.sub(r"\s*\.\s*", ".", _BARE_DOT.sub(".", s))
    return f"{plain(local)}@{host}{plain(rest)}"


def _addresses(text: str, pattern: re.Pattern) -> Iterator[re.Match]:
    """Leftmost matches of a pattern that begins with a local part.

    It is tried only where a whole chain of words and dots begins with an at after it or inside: a match from a later word
    of the chain would be one from its first word as well. So a long chain is read once, not once from each of its words.
    """
    chain = _CHAIN.search(text)
    while chain:
        m = None
        if _AT_NEXT.match(text, chain.end()) or _AT_WITHIN.search(text, *chain.span()):
            m = pattern.match(text, chain.start())
            if m:
                yield m
        chain = _CHAIN.search(text, (m or chain).end())


def steps(text: str, wide: bool = False) -> list[Rewritten]:
    """The transducers that apply to a text, in order; each one reads the output of the one before.

    ``wide`` is the second reading; it is empty where none of its own steps applies.
    """
    out: list[Rewritten] = []

    def step(pattern: re.Pattern, by) -> None:
        nonlocal text
        r = rewrite(text, _addresses(text, pattern) if by is _bare else pattern.finditer(text), by)
        if r.edits:
            out.append(r)
            text = r.text

    if not text.isascii() and _STRANGE.search(text):
        step(_STRANGE, lambda m: _imitates[m[0]])
    if wide:
        if not _second(text):
            return []
        if any(c in text for c in "([{<"):
            step(_DOT_BRACKET, lambda m: ".")
        plain = text
        step(_FEW, _few)
        step(_DIGIT_DOT, lambda m: ".")
        if text == plain:
            return []
    lower = text.lower()
    if _TRIGGER_DIGIT.search(lower):
        step(_RUN, _digits)
    if "plus" in lower:
        step(_PLUS, lambda m: "+")
    if any(c in text for c in "([{<"):
        step(_AT_BRACKET, lambda m: "@")
        step(_DOT_BRACKET, lambda m: ".")
    if _BARE_DOT.search(text) or "@" in text and _SPACED_AT.search(text):
        for pattern in _ANY_ENDING:
            step(pattern, _bare)
        step(_BARE, _bare)
    return out


def _merged(spans: list[Span]) -> dict[str, tuple[list[int], list[int]]]:
    """Starts and ends of the stretches that spans of each kind cover, spans that touch taken together."""
    out: dict[str, tuple[list[int], list[int]]] = {k: ([], []) for k in KINDS}
    for s in sorted(spans, key=lambda s: s.start):
        starts, ends = out[s.kind]
        if ends and s.start <= ends[-1]:
            ends[-1] = max(ends[-1], s.end)
        else:
            starts.append(s.start)
            ends.append(s.end)
    return out


def _covered(s: Span, by: dict[str, tuple[list[int], list[int]]]) -> bool:
    """Whether spans of the same kind hold every character of a span."""
    starts, ends = by[s.kind]
    k = bisect_right(starts, s.start) - 1
    return k >= 0 and s.end <= ends[k]


def _widest(spans: set[Span]) -> list[Span]:
    """Without those that lie inside another one of their kind."""
    out, reach = [], dict.fromkeys(KINDS, -1)
    for s in sorted(spans, key=lambda s: (s.start, -s.end)):
        if s.end > reach[s.kind]:
            out.append(s)
            reach[s.kind] = s.end
    return out


def all_spans(text: str | None) -> tuple[list[Span], list[Span]]:
    """(base spans, base and added spans), each by kind as in KINDS, then start."""
    text = text or ""
    base = base_spans(text)
    added, known = set(), None
    for chain in (steps(text), steps(text, True)):
        for kind, start, end in base_spans(chain[-1].text) if chain else []:
            changed = False
            for r in reversed(chain):
                changed = changed or r.touched(start, end)
                start, end = r.source(start, end)
            known = known or _merged(base)
            if changed and not _covered(Span(kind, start, end), known):
                added.add(Span(kind, start, end))
    return base, sorted([*base, *_widest(added)], key=lambda s: (KINDS.index(s.kind), s.start, s.end))


_SPAN = T.StructType([T.StructField("kind", T.StringType(), False), T.StructField("start", T.LongType(), False), T.StructField("end", T.LongType(), False)])


def find(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add base_spans and pii_spans (arrays of kind, start, end); other columns pass through."""
    spans = T.ArrayType(_SPAN, False)
    kind = pa.list_(pa.struct([pa.field("kind", pa.string(), False), pa.field("start", pa.int64(), False), pa.field("end", pa.int64(), False)]))

    def make():
        def f(texts: list) -> list:
            found = [all_spans(t) for t in texts]
            return [pa.array([[s._asdict() for s in x[k]] for x in found], kind) for k in (0, 1)]

        return f

    return map_text(docs, text, T.StructType([T.StructField("base_spans", spans, False), T.StructField("pii_spans", spans, False)]), make)


def joined(spans: str) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def count(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
