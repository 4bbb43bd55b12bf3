"""Token counts by a compiled finite-state tokenizer.

The tokenizer is a deterministic transducer: a state is what the future of a pretoken can depend on, namely the
longest suffix read that starts some token, and for each position inside it the last token there and how many tokens
fewer its prefix has. A transition reads one symbol and emits by how much the token count changes. States and
transitions are compiled when first met and are dropped together beyond a bound; this changes time only.

A text is cut into blocks. White space and the borders of pretokens reset the machine, so a block of whole pretokens has
the state map {start: (start, its count)}. A pretoken longer than a block is cut into several; a later one's map has an
entry for each state in which it may begin, found by running the machine over contexts of several lengths before it, and
runs that meet go on as one. Maps compose associatively, entry by entry; a parallel prefix scan (``compose_scan``) of a
text's blocks gives its count. An entry that was not foreseen is run when a composition asks for it, so the count is exact.

Text in characters below U+0250 is normalised and cut here; with any beyond, the tokenizer file's own normaliser gives the
text and its own pretokeniser tells each new character's class, so no other Unicode version has a say.

Null and empty texts have no tokens. Repeated rows are counted each.
"""

from __future__ import annotations

import os
import re
from functools import cached_property, lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from bookpulse.llm.bpe import BpeModel, PieceCache, load_model, space_free, special_split, word_normal, word_pieces
from bookpulse.llm.common import map_text

#: Characters of a block (symbols, where a pretoken is longer than a block).
BLOCK = 1 << 14
#: Symbols before a block from which its possible first states are found.
CONTEXTS = (1, 2, 4, 8, 16, 32, 64, 128, 256)
#: States kept compiled.
STATES = 150_000


#: What the future of a pretoken depends on; START before its first symbol.
State = tuple[str, tuple[tuple[int, int], ...]]
START: State = ("", ((-1, 0),))


class Transducer:
    """Emits changes of the token count while it reads a pretoken's symbols."""

    def __init__(self, model: BpeModel):
        self.model = model
        self.reset()

    def reset(self) -> None:
        self.number = {START: 0}
        self.state = [START]
        self.next: list[dict[str, tuple[int, int]]] = [{}]

    def at(self, state: State) -> int:
        """A state's number."""
        to = self.number.get(state)
        if to is None:
            to = self.number[state] = len(self.state)
            self.state.append(state)
            self.next.append({})
        return to

    def compile(self, at: int, symbol: str) -> tuple[int, int]:
        """The transition from a state: (next state, change of the count)."""
        model, (suffix, history) = self.model, self.state[at]
        stem = suffix + symbol
        while stem not in model.stems:
            stem = stem[1:]
        for size, t in model.ending(stem):
            last, count = history[-size]
            if last < 0 or model.neighbours(last, t):
                break
        emit = count + 1
        # The position before the stem stays in the history, as a token over the whole stem begins there.
        seen = (*history, (t, emit))[-(len(stem) + 1) :]
        to = self.at((stem, tuple((a, n - emit) for a, n in seen)))
        self.next[at][symbol] = step = (to, emit)
        return step

    def count(self, symbols: str) -> int:
        """Tokens of one whole pretoken."""
        return self.run([START], symbols)[START][1]

    def run(self, entries: list[State], symbols: str) -> dict[State, tuple[State, int]]:
        """For each entry state the state after the symbols, and the tokens that they add."""
        if len(self.state) > STATES:
            self.reset()
        steps, compile_ = self.next, self.compile
        if len(entries) == 1:
            at, total = self.at(entries[0]), 0
            for symbol in symbols:
                at, emit = steps[at].get(symbol) or compile_(at, symbol)
                total += emit
            return {entries[0]: (self.state[at], total)}
        out, first = {}, []
        for entry in entries:
            at, total, path = self.at(entry), 0, []
            for i, symbol in enumerate(symbols):
                at, emit = steps[at].get(symbol) or compile_(at, symbol)
                total += emit
                if first and first[i][0] == at:  # met the first entry's way
                    at, total = first[-1][0], total + first[-1][1] - first[i][1]
                    break
                if not first:
                    path.append((at, total))
            first = first or path
            out[entry] = (self.state[at], total)
        return out


class BlockMap:
    """State map of a block, or of blocks composed: (state after it, tokens it adds) for the states it may begin in."""

    def __init__(self, moves: dict[State, tuple[State, int]], more=None):
        self.moves, self.more = moves, more

    def __call__(self, state: State) -> tuple[State, int]:
        if state not in self.moves:
            self.moves[state] = self.more(state)
        return self.moves[state]


def compose(a: BlockMap, b: BlockMap) -> BlockMap:
    """The map of a block and the one after it. Associative."""

    def both(state: State) -> tuple[State, int]:
        middle, n = a(state)
        end, m = b(middle)
        return end, n + m

    return BlockMap({s: both(s) for s in list(a.moves)}, both)


def compose_scan(maps: list[BlockMap]) -> BlockMap:
    """Compose neighbours level by level, as a parallel scan does."""
    while len(maps) > 1:
        maps = [compose(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
    return maps[0] if maps else BlockMap({START: (START, 0)})


class _Classes(dict):
    """Stands for each character in the pattern of pretokens: a letter, 0 for numbers, # for the rest; asked of the tokenizer."""

    def __init__(self, pretokens):
        super().__init__({i: chr(i) for i in (*range(ord("a"), ord("z") + 1), ord("'"))})
        self.pretokens = pretokens

    def __missing__(self, point: int) -> str:
        c = chr(point)
        kind = "a" if len(self.pretokens("a" + c)) == 1 else "0" if len(self.pretokens(c + c)) == 2 else "#"
        self[point] = kind
        return kind


# The published pretoken pattern, over what stands for the characters.
_PRETOKEN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|0|[^a-z0]+")


class Counter:
    """Counts tokens of whole texts with one tokenizer file."""

    def __init__(self, path: str):
        self.path, self.model = path, load_model(path)
        self.machine = Transducer(self.model)
        self.split = special_split(self.model.special)
        self.cache = PieceCache(self.cut, lambda words: {w: self.machine.count(self.model.word(w)) for w in words}, sum, 120_000)

    @cached_property
    def library(self):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        return Tokenizer.from_file(self.path)

    @cached_property
    def classes(self) -> _Classes:
        return _Classes(self.library.pre_tokenizer.pre_tokenize_str)

    def chunks(self, text: str) -> list[str]:
        """The parts between white space of a text as the tokenizer normalises it."""
        if text.isascii() or max(text) < "\u0250":
            return space_free(word_normal(text))
        return [c for c in self.library.normalizer.normalize_str(text).split(" ") if c]

    def cut(self, chunk: str) -> list[str]:
        """Pretokens of a chunk."""
        if chunk.isascii() or max(chunk) < "\u0250":
            return word_pieces(chunk)
        return [chunk[m.start() : m.end()] for m in _PRETOKEN.finditer(chunk.translate(self.classes))]

    def long_pretoken(self, pretoken: str) -> list[BlockMap]:
        """State maps of a pretoken's blocks; after the last one the machine is reset."""
        symbols, run = self.model.word(pretoken), self.machine.run
        out = []
        for i in range(0, len(symbols), BLOCK):
            part, last = symbols[i : i + BLOCK], i + BLOCK >= len(symbols)
            entries = [START] if not i else list(dict.fromkeys(run([START], symbols[max(0, i - n) : i])[START][0] for n in CONTEXTS))

            def move(found: dict, last: bool = last) -> dict:
                return {s: (START if last else end, n) for s, (end, n) in found.items()}

            out.append(BlockMap(move(run(entries, part)), lambda state, part=part, move=move: move(run([state], part))[state]))
        return out

    def blocks(self, chunks: list[str], value: dict) -> list[BlockMap]:
        """State maps of the blocks of a text's chunks; ``value`` has the counts of those no longer than a block."""
        out, size, n = [], 0, 0
        for c in chunks:
            if len(c) > BLOCK:
                for p in self.cut(c):
                    if len(p) > BLOCK:
                        out += self.long_pretoken(p)
                    else:
                        n += self.machine.count(self.model.word(p))
            else:
                n += value[c]
            size += len(c)
            if size >= BLOCK:
                out.append(BlockMap({START: (START, n)}))
                size = n = 0
        return [*out, BlockMap({START: (START, n)})]

    def counts(self, texts: list) -> list[int]:
        cut = []
        for t in texts:
            segments = self.split.split(t) if t and "<|" in t else [t or ""]
            cut.append((len(segments) // 2, [c for s in segments[::2] if s for c in self.chunks(s)]))
        value = self.cache.values({c for _, chunks in cut for c in chunks if len(c) <= BLOCK})
        return [marks + compose_scan(self.blocks(chunks, value))(START)[1] for marks, chunks in cut]


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def token_counts(docs: DataFrame, tokenizer: str, text: str = "text", into: str = "n_tokens") -> DataFrame:
    """Add the number of tokens of each whole text; other columns pass through."""

    def make():
        c = counter(tokenizer)
        return lambda texts: [pa.array(c.counts(texts), pa.int64())]

    return map_text(docs, text, T.StructType([T.StructField(into, T.LongType(), False)]), make)
