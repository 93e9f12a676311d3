"""Token counts by a compiled finite-state transducer.

The tokenizer is compiled into two deterministic transducers. The first runs over
character classes: six states know where a pre-token begins, contractions included, and
each transition is annotated with the pre-tokens it opens. The second reads the bytes of a
pre-token, and each transition is annotated with the number of tokens it emits. It is the
subset construction of an automaton that follows every token which may be under way; a token
ends where its string is complete and its pair with the token before it is one that the
merges leave apart. Exactly one token ends at each byte, so the count of every prefix follows
from a shorter one. An emission may be negative: a longer token can take back shorter ones.
The second transducer has too many states to be written out; each is made when first met.

A block of texts is cut into chunks of equal length that run side by side. Nobody knows
in which state a chunk begins, so each chunk first yields its state map, the end state
for every start state. A parallel prefix scan composes the maps, which gives each chunk
its true start state, and a second run collects the annotations. The second transducer
starts anew at each pre-token, so it needs no map: it runs over the distinct pre-tokens.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docstrata.llm.common import release_memory, text_of
from docstrata.llm.tokenize import Vocabulary, as_points, blocks, dictionary, shared, slices

# Symbols: classes of characters as the pattern tells them apart.
BLANK, ALPHA, DIGIT, MARK, QUOTE, STMD, RV, EE, LL, END = range(10)
# States: between pre-tokens, in a word, in a run of marks, after a lone quote, and after
# a lone quote with r or v, or with l, which may yet become a contraction.
FREE, WORD, MARKS, QUOTED, QUOTED_RV, QUOTED_L = range(6)
#: Annotations: a pre-token opens here; one has opened at the character before.
OPENS, OPENED = 1, 2
CHUNK = 256


def compile_splitter() -> tuple[np.ndarray, np.ndarray]:
    """(next state, annotation), both indexed by state * 10 + symbol."""
    step = np.zeros((6, 10), np.intp)
    note = np.zeros((6, 10), np.uint8)
    letters = (ALPHA, STMD, RV, EE, LL)
    for state in range(6):
        for symbol in (BLANK, END):
            step[state, symbol] = FREE
        for symbol in letters:
            step[state, symbol], note[state, symbol] = WORD, OPENS
        step[state, DIGIT], note[state, DIGIT] = FREE, OPENS
        step[state, MARK], note[state, MARK] = MARKS, OPENS
        step[state, QUOTE], note[state, QUOTE] = QUOTED, OPENS
    for symbol in letters:  # a word goes on
        note[WORD, symbol] = 0
    for state in (MARKS, QUOTED):  # a run of marks goes on
        for symbol in (MARK, QUOTE):
            step[state, symbol], note[state, symbol] = MARKS, 0
    step[QUOTED, STMD], note[QUOTED, STMD] = FREE, 0
    step[QUOTED, RV], note[QUOTED, RV] = QUOTED_RV, 0
    step[QUOTED, LL], note[QUOTED, LL] = QUOTED_L, 0
    for state, closing in ((QUOTED_RV, EE), (QUOTED_L, LL)):
        for symbol in range(10):  # no contraction after all: the letter before opened a word
            note[state, symbol] |= OPENED
            if symbol in letters:
                note[state, symbol] = OPENED
        step[state, closing], note[state, closing] = FREE, 0
    return step.ravel(), note.ravel()


def compose(maps: np.ndarray) -> np.ndarray:
    """Inclusive prefix scan of state maps (chunk, start state) -> end state, by doubling."""
    maps, reach = maps.copy(), 1
    while reach < len(maps):
        maps[reach:] = np.take_along_axis(maps[reach:], maps[:-reach], axis=1)
        reach *= 2
    return maps


def run_transducer(symbols: np.ndarray, step: np.ndarray, note: np.ndarray) -> np.ndarray:
    """Where pre-tokens open in a sequence of symbols that begins in state FREE."""
    n = len(symbols)
    lanes = -(-n // CHUNK)
    padded = np.full(lanes * CHUNK, END, np.intp)
    padded[:n] = symbols
    across = np.ascontiguousarray(padded.reshape(lanes, CHUNK).T)
    maps = np.tile(np.arange(6, dtype=np.intp), (lanes, 1))
    for column in across:
        maps = step[maps * 10 + column[:, None]]
    state = np.concatenate(([FREE], compose(maps)[:-1, FREE])) if lanes else np.zeros(0, np.intp)
    notes = np.empty((CHUNK, lanes), np.uint8)
    for t, column in enumerate(across):
        at = state * 10 + column
        notes[t] = note[at]
        state = step[at]
    flat = notes.T.ravel()
    opens = (flat & OPENS) > 0
    opens[:-1] |= (flat[1:] & OPENED) > 0
    return opens[:n]


class WordTransducer:
    """Tokens of a complete pre-token, from the merges of a byte-level vocabulary with end marks.

    The input symbols are the bytes, and the bytes that end a pre-token as symbols of their own.
    A state is a tuple of (place in the tree of tokens, token before it, count before it less
    the count now), one for each token that may be under way.
    """

    MOST_STATES = 300_000  # bounded memory: beyond it the states are made anew

    def __init__(self, merges: list[tuple[str, str]], end_mark: str, alphabet: dict[int, str]):
        symbols = {c: b for b, c in alphabet.items()} | {c + end_mark: 256 + b for b, c in alphabet.items()}
        # Tokens are numbered: the symbols first, then one for each merge, in their order.
        number = dict(symbols)
        self.rank, self.parts, self.merged = [-1] * 512, [(0, 0)] * 512, {}
        spelt = [(s,) for s in range(512)]
        for rank, (a, b) in enumerate(merges):
            x, y = number[a], number[b]
            self.merged[x, y] = rank
            if a + b not in number:
                number[a + b] = len(self.rank)
                self.rank.append(rank)
                self.parts.append((x, y))
                spelt.append(spelt[x] + spelt[y])
        self.child: dict[int, int] = {}
        self.token = [-1]
        for t, symbols_of in enumerate(spelt):
            node = 0
            for symbol in symbols_of:
                key = node << 9 | symbol
                if key not in self.child:
                    self.child[key] = len(self.token)
                    self.token.append(-1)
                node = self.child[key]
            self.token[node] = t
        self.inner = {key >> 9 for key in self.child}  # places from which a longer token leads on
        self.apart: dict[int, bool] = {}
        self._begin()

    def _begin(self) -> None:
        start = ((0, -1, 0),)
        self.states, self.number, self.step = [start], {start: 0}, {}

    def stay_apart(self, a: int, b: int) -> bool:
        """Whether the merges leave a and b, side by side, as they are.

        Backwards through the merges that made the two, the later first: the part of a that
        touched b, or of b that touched a, must not have merged across before.
        """
        key = a << 20 | b
        if key not in self.apart:
            x, y, limit = a, b, len(self.merged) + 1
            while self.merged.get((x, y), limit) >= limit:
                if self.rank[x] > self.rank[y]:
                    limit, x = self.rank[x], self.parts[x][1]
                elif self.rank[y] >= 0:  # of equal merges the one more to the left is made first
                    limit, y = self.rank[y] + 1, self.parts[y][0]
                else:
                    self.apart[key] = True
                    break
            else:
                self.apart[key] = False
        return self.apart[key]

    def _make(self, state: int, symbol: int) -> int:
        """The transition of a state by a symbol: next state << 20 | emission + 2 ** 19."""
        moved, last, now = [], -1, 0
        for node, before, count in self.states[state]:
            child = self.child.get(node << 9 | symbol)
            if child is None:
                continue
            if child in self.inner:
                moved.append((child, before, count))
            t = self.token[child]
            if t >= 0 and last < 0 and (before < 0 or self.stay_apart(before, t)):
                last, now = t, count + 1
        made = (*((n, b, c - now) for n, b, c in moved), (0, last, 0))
        if made not in self.number:
            self.number[made] = len(self.states)
            self.states.append(made)
        self.step[state << 9 | symbol] = out = self.number[made] << 20 | now + (1 << 19)
        return out

    def count(self, word: bytes) -> int:
        """The sum of the emissions along a pre-token."""
        if len(self.states) > self.MOST_STATES:
            self._begin()
        step, state, total = self.step, 0, 0
        for symbol in (*word[:-1], 256 + word[-1]):
            to = step.get(state << 9 | symbol)
            if to is None:
                to = self._make(state, symbol)
            total += (to & 0xFFFFF) - (1 << 19)
            state = to >> 20
        return total


class TokenCounter:
    """Token counts of whole texts by a vocabulary whose words end with a mark."""

    def __init__(self, path: str):
        self.vocab = Vocabulary(path)
        self.step, self.note = compile_splitter()
        model = json.loads(self.vocab.library.to_str())["model"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.words = WordTransducer(pairs, model["end_of_word_suffix"], self.vocab.alphabet)
        self.special = re.compile("|".join(map(re.escape, sorted(self.vocab.specials, key=len, reverse=True))) or "(?!)")
        self.symbol = np.array([BLANK, ALPHA, DIGIT, MARK], np.intp)
        self.letters = np.full(128, -1, np.intp)
        for chars, symbol in (("'", QUOTE), ("stmd", STMD), ("rv", RV), ("e", EE), ("l", LL)):
            for char in chars:
                self.letters[ord(char)] = symbol

    def _symbols(self, points: np.ndarray) -> np.ndarray:
        symbols = self.symbol[self.vocab.classify(points)]
        low = points < 128
        special = np.where(low, self.letters[np.where(low, points, 0)], -1)
        return np.where(special >= 0, special, symbols)

    def counts(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text; a special string inside it is one token and parts the text."""
        result = np.zeros(len(texts), np.int64)
        plain, owner = [], []
        for i, text in enumerate(texts):
            pieces = self.special.split(text)
            result[i] = len(pieces) - 1
            for piece in pieces:
                for part in slices(self.vocab.normal(piece)):
                    plain.append(part)
                    owner.append(i)
        for lo, hi in blocks(plain):
            np.add.at(result, owner[lo:hi], self._block(plain[lo:hi]))
        return result

    def _block(self, texts: list[str]) -> np.ndarray:
        points, bounds = as_points([t + "\n" for t in texts])
        symbols = self._symbols(points)
        symbols[bounds[1:] - 1] = END
        starts = np.flatnonzero(run_transducer(symbols, self.step, self.note))
        if not len(starts):
            return np.zeros(len(texts), np.int64)
        stops = np.flatnonzero((symbols == BLANK) | (symbols == END))
        ends = np.minimum(stops[np.searchsorted(stops, starts)], np.concatenate((starts[1:], [len(points)])))
        words, index = dictionary(points, starts, ends)
        emitted = np.fromiter(map(self.words.count, words), np.int64, len(words))
        total = np.concatenate(([0], np.cumsum(emitted[index])))
        cut = total[np.searchsorted(starts, bounds)]
        return cut[1:] - cut[:-1]


def token_counts(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) for each row of docs.

    path names the tokenizer file, which every executor must have. A null text counts as
    empty, with no tokens; a null doc_id is returned as null; repeated rows are counted
    each; a text of any length is counted whole, in slices. Other columns are not read; an empty
    table gives an empty result.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = shared(TokenCounter, path)
        for batch in batches:
            n = counter.counts(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_bytes"), pa.array(n), pa.array(n > limit)],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )
            release_memory()

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    sized = plain.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "text")
    return sized.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
