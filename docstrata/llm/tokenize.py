"""Exact tokenization over whole Arrow batches.

The texts of a batch are laid end to end as code points. A table of character classes,
filled by asking the tokenizer itself about each code point when it first occurs, and
array operations find where its pre-tokens begin. Equal pre-tokens are merged by Arrow's
dictionary encoding and the tokenizer's own merges run once for each new one, so the cost
follows the vocabulary of the text and not its length.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE, LETTER, NUMBER, OTHER, UNKNOWN = 0, 1, 2, 3, 255
_BLOCK = 3_000_000  # code points handled at once; a longer text is cut between words
MOST_PIECES = 500_000  # learnt pre-tokens that a worker holds
_CUT = re.compile("[A-Za-z0-9] [A-Za-z0-9]")  # no pre-token of either pattern crosses this blank


def byte_alphabet() -> dict[int, str]:
    """The code point that byte-level vocabularies use for each byte, by their published rule."""
    plain = [b for b in range(256) if chr(b).isprintable() and not chr(b).isspace() and b != 0xAD]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Vocabulary:
    """A tokenizer file of the tokenizers library, with what the array code needs of it."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.specials = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.alphabet = byte_alphabet()
        self.classes = np.full(0x110000, UNKNOWN, np.uint8)
        self.pieces: dict[bytes, int] = {}  # of pre-tokens met so far
        self.folds = self.library.normalizer is not None

    def normal(self, text: str) -> str:
        """What the tokenizer's normalizer makes of a text, as far as its tokens depend on it."""
        if not self.folds:
            return text
        if text.isascii():
            return text.lower()
        # Code points below U+0300 are in composed form and their lower case has no context.
        if max(text) < "̀" and "İ" not in text:
            return text.lower()
        return self.library.normalizer.normalize_str(text)

    def classify(self, points: np.ndarray) -> np.ndarray:
        found = self.classes[points]
        if (found == UNKNOWN).any():
            for point in np.unique(points[found == UNKNOWN]).tolist():
                self.classes[point] = self._ask(point)
            found = self.classes[points]
        return found

    def _ask(self, point: int) -> int:
        """The class of a code point, from which neighbours the pre-tokenizer joins it with."""
        char = chr(point)
        split = self.library.pre_tokenizer.pre_tokenize_str
        if self.folds:  # white space is dropped, a number stands alone
            if not split(char):
                return SPACE
            if len(split("a" + char)) == 1:
                return LETTER
            return OTHER if len(split("!" + char)) == 1 else NUMBER
        for probe, kind in (("a", LETTER), ("1", NUMBER), ("!", OTHER)):
            if len(split(probe + char)) == 1:
                return kind
        return SPACE

    def encode_piece(self, piece: bytes) -> list[int]:
        """The ids of one pre-token by the library's merges."""
        return [t.id for t in self.library.model.tokenize("".join(map(self.alphabet.__getitem__, piece)))]


def as_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points laid end to end, start of each text and the end of the last)."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return points, np.concatenate(([0], np.cumsum(lengths)))


def blocks(texts: list[str], limit: int = _BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about limit code points together."""
    start, held = 0, 0
    for i, text in enumerate(texts):
        if held and held + len(text) > limit:
            yield start, i
            start, held = i, 0
        held += len(text)
    if start < len(texts):
        yield start, len(texts)


def slices(text: str, limit: int = _BLOCK) -> list[str]:
    """The text in slices of about limit code points, cut where a blank parts two words."""
    out, start = [], 0
    while len(text) - start > limit and (m := _CUT.search(text, start + limit)):
        out.append(text[start : m.start() + 1])
        start = m.start() + 1
    return [*out, text[start:]]


def utf8_ends(points: np.ndarray) -> np.ndarray:
    """Byte offset in UTF-8 of each code point, and of the end."""
    widths = (points > 0x7F).view(np.int8) + (points > 0x7FF) + (points > 0xFFFF)
    ends = np.zeros(len(points) + 1, np.int32 if len(points) < 1 << 29 else np.int64)
    np.cumsum(widths, dtype=ends.dtype, out=ends[1:])
    ends += np.arange(len(ends), dtype=ends.dtype)
    return ends


def contractions(points: np.ndarray, kinds: np.ndarray, lone: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the lone apostrophes at the places lone, those that begin 's 't 'm 'd 're 've 'll, and their ends.

    last[i] is the end of the text that holds lone[i].
    """
    pad = np.concatenate((points, np.zeros(2, points.dtype)))
    one, two = pad[lone + 1], pad[lone + 2]
    letter = lambda c: ord(c)
    single = np.isin(one, [letter(c) for c in "stmd"]) & (lone + 1 < last)
    pair = (((one == letter("r")) | (one == letter("v"))) & (two == letter("e"))) | ((one == letter("l")) & (two == letter("l")))
    pair &= lone + 2 < last
    hit = single | pair
    return lone[hit], lone[hit] + np.where(single[hit], 2, 3)


def split_byte_level(vocab: Vocabulary, points: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Starts of the pre-tokens of the byte-level pattern, which covers every code point.

    The pattern: a contraction, else an optional U+0020 with a run of letters, numbers or
    others, else white space up to the last one before other text, else white space.
    """
    n = len(points)
    kinds = vocab.classify(points)
    first = np.zeros(n + 1, bool)
    first[bounds[:-1][bounds[:-1] < n]] = True
    first[n] = True
    change = first[:-1].copy()
    change[1:] |= kinds[1:] != kinds[:-1]
    space = kinds == SPACE
    before_text = np.zeros(n, bool)  # the last white space before other text
    before_text[:-1] = space[:-1] & ~space[1:] & ~first[1:-1]
    starts = change | before_text
    # A run of text begins at the U+0020 before it.
    blank = np.zeros(n, bool)
    blank[1:] = before_text[:-1] & (points[:-1] == 0x20)
    starts &= ~blank
    ends_run = np.concatenate((change[1:], [True]))
    lone = np.flatnonzero((points == 0x27) & change & ends_run & ~blank)
    if len(lone):
        text_end = bounds[np.searchsorted(bounds, lone, side="right")]
        at, end = contractions(points, kinds, lone, text_end)
        starts[at + 1] = False
        inside = end[end < n]
        starts[inside] |= kinds[inside] == LETTER
    return np.flatnonzero(starts)


def dictionary(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """(distinct pre-tokens as UTF-8, for each pre-token the index of its own)."""
    data = points.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
    if len(starts) == 0:
        return [], np.zeros(0, np.int64)
    at = utf8_ends(points)
    lo, hi = at[starts], at[ends]
    if (lo[1:] == hi[:-1]).all() and lo[0] == 0:
        offsets = np.concatenate((lo, hi[-1:]))
        values = pa.Array.from_buffers(pa.large_binary(), len(lo), [None, pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(data)])
    else:  # gaps between pre-tokens: every second slice is one
        offsets = np.empty(2 * len(lo) + 1, np.int64)
        offsets[0:-1:2], offsets[1::2], offsets[-1] = lo, hi, hi[-1]
        both = pa.Array.from_buffers(pa.large_binary(), 2 * len(lo), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data)])
        values = both.take(pa.array(np.arange(0, 2 * len(lo), 2)))
    coded = pc.dictionary_encode(values)
    return coded.dictionary.to_pylist(), np.asarray(coded.indices).astype(np.int64)


class ByteLevelIds:
    """Ids of whole texts by a byte-level vocabulary."""

    def __init__(self, path: str):
        self.vocab = Vocabulary(path)
        self.kind = "<u2" if self.vocab.library.get_vocab_size() <= 1 << 16 else "<u4"  # the least width of an id
        self.place: dict[bytes, int] = {}
        self.flat = np.zeros(0, np.int32)
        self.lo = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)

    def _learn(self, words: list[bytes]) -> np.ndarray:
        """Places in the tables of the words' ids; new words are encoded once."""
        if len(self.place) > MOST_PIECES:  # bounded memory: start over
            self._forget()
        place, new = self.place, []
        at = np.empty(len(words), np.int64)
        for i, word in enumerate(words):
            p = place.get(word)
            if p is None:
                p = place[word] = len(place)
                new.append(self.vocab.encode_piece(word))
            at[i] = p
        if new:
            sizes = np.fromiter(map(len, new), np.int64, len(new))
            begin = len(self.flat) + np.concatenate(([0], np.cumsum(sizes)[:-1]))
            self.flat = np.concatenate((self.flat, np.fromiter((x for ids in new for x in ids), np.int32)))
            self.lo, self.size = np.concatenate((self.lo, begin)), np.concatenate((self.size, sizes))
        return at

    def _forget(self) -> None:
        self.place, self.flat = {}, np.zeros(0, np.int32)
        self.lo, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, special strings inside it handled as the library does."""
        if any(len(t) > _BLOCK for t in texts):
            whole = []
            for text in texts:
                special = any(s in text for s in self.vocab.specials)
                cut = [text] if special else slices(text)
                whole.append(np.concatenate(self.encode(cut)) if len(cut) > 1 else self._encode(cut)[0])
            return whole
        return self._encode(texts)

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for lo, hi in blocks(texts):
            own = texts[lo:hi]
            odd = {i for i, t in enumerate(own) if any(s in t for s in self.vocab.specials)}
            plain = ["" if i in odd else t for i, t in enumerate(own)] if odd else own
            points, bounds = as_points(plain)
            starts = split_byte_level(self.vocab, points, bounds)
            words, index = dictionary(points, starts, np.concatenate((starts[1:], [len(points)])) if len(starts) else starts)
            at = self._learn(words)[index]
            sizes = self.size[at]
            total = np.concatenate(([0], np.cumsum(sizes)))
            take = np.repeat(self.lo[at] - total[:-1], sizes) + np.arange(total[-1])
            ids = self.flat[take]
            cut = total[np.searchsorted(starts, bounds)]
            for i in range(hi - lo):
                if i in odd:
                    out.append(np.array(self.vocab.library.encode(own[i], add_special_tokens=False).ids, np.int32))
                else:
                    out.append(ids[cut[i] : cut[i + 1]])
        return out


_SHARED: dict[tuple[type, str], object] = {}


def shared(kind: type, path: str):
    """The worker process's one encoder of this kind, which keeps what earlier tasks have learnt."""
    key = (kind, path)
    if key not in _SHARED:
        _SHARED[key] = kind(path)
    return _SHARED[key]
