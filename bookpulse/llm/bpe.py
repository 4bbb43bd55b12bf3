"""Byte-pair encoding from a tokenizer file: vocabulary, merge ranks, and the rule for valid neighbours.

Symbols are bytes, written as ``chr(byte)``; in vocabularies with an end-of-word mark the last byte of a word is
``chr(256 + byte)``. Two tokens may stand side by side exactly if undoing their merges, youngest first, never shows
an older merge across their border; then the last token of every prefix of a word is unique, which is what both the
prefix trie (``encode_words``) and the counting transducer build on.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Callable, Iterable
from functools import lru_cache

import numpy as np
import regex

_END = "</w>"


def byte_alphabet() -> dict[str, int]:
    """Printable stand-ins of byte-level vocabularies, by the published rule: shown bytes are themselves, the rest follow from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class BpeModel:
    """Tokens as strings of symbols, ids, and merges of one tokenizer file."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        model, alphabet = spec["model"], byte_alphabet()
        self.marks_end = model.get("end_of_word_suffix") == _END

        def symbols(token: str) -> str:
            ended = self.marks_end and token.endswith(_END)
            body = [alphabet[c] for c in (token[: -len(_END)] if ended else token)]
            if ended and body:
                body[-1] += 256
            return "".join(map(chr, body))

        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        vocab = {t: i for t, i in model["vocab"].items() if t not in self.special}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        made = {a + b: k for k, (a, b) in reversed(list(enumerate(merges)))}
        # Tokens are numbered by age: single symbols, then merges in their order.
        base = [t for t in vocab if t not in made]
        age = {t: n for n, t in enumerate([*base, *sorted(made, key=made.get)])}
        self.n_base, self.ids = len(base), np.array([vocab[t] for t in age], dtype=np.uint32)
        self.token = {symbols(t): n for t, n in age.items()}
        self.text = list(self.token)
        self.pair = {}
        self.left, self.right = list(range(len(age))), list(range(len(age)))
        for a, b in merges:
            n = age[a + b]
            self.pair.setdefault((age[a], age[b]), n)
            if self.left[n] == n:
                self.left[n], self.right[n] = age[a], age[b]
        self.size = list(map(len, self.text))
        self.coded = [i.astype("<u4").tobytes() for i in self.ids]
        self._valid: dict[tuple[int, int], bool] = {}
        self._whole: dict[int, bool] = {}
        #: Non-empty prefixes of tokens, the tokens included; and the tokens that end each of them, longest first.
        self.stems = {t[:i] for t in self.text for i in range(1, len(t) + 1)}
        self._ending: dict[str, tuple] = {}

    def ending(self, stem: str) -> tuple[tuple[int, int], ...]:
        """(length, token) of the tokens that are suffixes of a stem and encode as themselves, longest first."""
        known = self._ending.get(stem)
        if known is None:
            found = ((len(stem) - k, self.token.get(stem[k:])) for k in range(len(stem)))
            known = self._ending[stem] = tuple((n, t) for n, t in found if t is not None and self.whole(t))
        return known

    def neighbours(self, a: int, b: int) -> bool:
        """Whether token b can follow token a inside one word."""
        key = (a, b)
        known = self._valid.get(key)
        if known is None:
            if len(self._valid) > 1_000_000:
                self._valid.clear()
            known = self._valid[key] = self._undo(a, b)
        return known

    def _undo(self, a: int, b: int) -> bool:
        pair, left, right, base = self.pair, self.left, self.right, self.n_base
        bound = len(left)  # an across merge counts against the border only if older than this
        while True:
            across = pair.get((a, b))
            if across is not None and across < bound:
                return False
            if a < base and b < base:
                return True
            # The younger of the two was merged last; a tie is undone on the right, as merges run from the left.
            if a > b:
                a, bound = right[a], a
            else:
                b, bound = left[b], b + 1

    def whole(self, t: int) -> bool:
        """Whether the encoding of token t's own symbols is t alone."""
        known = self._whole.get(t)
        if known is None:
            known = self._whole[t] = t < self.n_base or self.merge(self.text[t]) == [t]
        return known

    def merge(self, word: str) -> list[int]:
        """Plain merging, lowest rank first: the definition, used for checks of single tokens."""
        parts = [self.token[c] for c in word]
        while len(parts) > 1:
            best, at = min((self.pair.get(p, len(self.left)), i) for i, p in enumerate(zip(parts, parts[1:])))
            if best == len(self.left):
                break
            parts[at : at + 2] = [best]
        return parts

    def word(self, text: str) -> str:
        """A pretoken's symbols."""
        s = text if text.isascii() else text.encode("utf-8", "surrogatepass").decode("latin-1")
        return s[:-1] + chr(ord(s[-1]) + 256) if self.marks_end and s else s

    def encode_words(self, words: Iterable[str]) -> dict[str, bytes]:
        """Encode distinct pretokens through their prefix trie; gives little-endian unsigned 32-bit ids of each.

        Words are visited in sorted order, which is the trie depth first: ``last`` holds the last token of every
        prefix on the path from the root and ``deep`` how long its longest suffix is that starts a token; the part
        shared with the word before is kept, so each trie node is computed once. A node's last token is the suffix
        that is a token and may follow the last token of the prefix before it.
        """
        stems, ending, known, neighbours, coded = self.stems, self._ending, self._valid, self.neighbours, self.coded
        out: dict[str, bytes] = {}
        before, last, deep, size_of = "", [-1], [0], self.size
        for symbols, text in sorted((self.word(w), w) for w in words):
            n, k = len(symbols), 0
            top = min(n, len(before))
            while k < top and symbols[k] == before[k]:
                k += 1
            del last[k + 1 :], deep[k + 1 :]
            for i in range(k + 1, n + 1):
                stem = symbols[i - 1 - deep[i - 1] : i]
                while stem not in stems:
                    stem = stem[1:]
                deep.append(len(stem))
                for size, t in ending.get(stem) or self.ending(stem):
                    if size == i or (valid := known.get((last[i - size], t))) or valid is None and neighbours(last[i - size], t):
                        last.append(t)
                        break
            found, i = [], n
            while i:
                t = last[i]
                found.append(coded[t])
                i -= size_of[t]
            found.reverse()
            out[text] = b"".join(found)
            before = symbols
        return out


@lru_cache(maxsize=4)
def load_model(path: str) -> BpeModel:
    """One model a Python worker and file."""
    return BpeModel(path)


class PieceCache:
    """Values of space-free chunks of text, computed from their pieces; both kept up to a bound.

    ``cut(chunk)`` gives pieces, ``solve(pieces)`` values of distinct unseen pieces, ``join(values)`` a chunk's value.
    A full cache keeps its entries (frequent words come early); what comes later, and chunks and pieces beyond ``LONG``
    characters, stay until the next call only. Both bounds change time, never results.
    """

    LONG = 64

    def __init__(self, cut: Callable, solve: Callable, join: Callable, bound: int = 240_000):
        self.cut, self.solve, self.join, self.bound = cut, solve, join, bound
        self.chunks: dict = {}
        self.pieces: dict = {}
        self.passing: tuple = ((), ())

    def values(self, wanted: set) -> dict:
        """A mapping that has the value of each of the distinct chunks, until the next call."""
        known, have, join = self.chunks, self.pieces, self.join
        for held, gone in zip((known, have), self.passing):
            for c in gone:
                del held[c]
        cuts = {c: self.cut(c) for c in wanted.difference(known)}
        fresh = self.solve(set().union(*cuts.values()).difference(have))
        full = len(known) >= self.bound, len(have) >= 2 * self.bound
        have.update(fresh)
        for c, ps in cuts.items():
            known[c] = have[ps[0]] if len(ps) == 1 else join([have[p] for p in ps])
        self.passing = tuple(list(new) if all_ else [c for c in new if len(c) > self.LONG] for new, all_ in zip((cuts, fresh), full))
        return known


#: Separators as tokenizers see them (Unicode White_Space); str.split() also takes the four of _ODD, which they don't.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_ODD = "\x1c", "\x1d", "\x1e", "\x1f"
_spaces = regex.compile(f"[{SPACE}]+")


def space_free(text: str) -> list[str]:
    """The parts between white space."""
    if any(c in text for c in _ODD):
        return [c for c in _spaces.split(text) if c]
    return text.split()


def special_split(special: Iterable[str]) -> regex.Pattern:
    """Splits a text at special tokens, keeping them."""
    return regex.compile("(" + "|".join(map(regex.escape, special)) + ")")


# The published pretoken pattern of the word tokenizer; inside a space-free chunk white space can't occur.
WORD_PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{L}\p{N}]+"
_word_pretoken = regex.compile(WORD_PRETOKEN).findall


def word_pieces(chunk: str) -> list[str]:
    """Pretokens of a normal space-free chunk: a word, or a word and one character after it, need no pattern."""
    if chunk.isascii() or max(chunk) < "\u0250":
        if chunk.isalpha():
            return [chunk]
        if chunk[:-1].isalpha():
            return [chunk[:-1], chunk[-1]]
    return _word_pretoken(chunk)


def word_normal(text: str) -> str:
    """NFC, then each character's own lower case (no final-sigma rule), as the word tokenizer has it."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
    return text.lower()
