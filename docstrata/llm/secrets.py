"""Secret scan: fixed shapes, and novelty against zstandard dictionaries.

Besides strings of known shape the scan reports strings that nothing around them explains.
A candidate is a long run of key characters in a sensitive context: a line that speaks of
credentials, the line after it, or a block that announces a key. Its marginal size is the
compressed size of the surroundings with it, less without it, under a zstandard dictionary of
common code, and of the parts of identifiers that the whole corpus shares. Prose, paths and
identifiers cost little there; a random key costs nearly all the bits that its alphabet can
carry, and is reported. Copies of a candidate, whole or in part, are blanked in its
surroundings first: a key does not explain itself. Nor do copies of a document: a part enters
the dictionary by the number of different identifiers that hold it.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docstrata.llm.common import text_of

# The shapes that are always reported, and the least lengths.
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "novel")

#: What a candidate looks like: key characters, points between them; and what makes its context sensitive.
LEAST = 16
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=~-]+(?:\.[A-Za-z0-9+/_=~-]+)*")
SENSITIVE = re.compile(r"(?ai)password|passwd|pwd|passphrase|secret|token|api_?-?key|credential|private|bearer|authorization|auth_|access_?-?key|signing_?-?key|encryption_?-?key")
# Without one of these, in lower case, neither SENSITIVE nor ASSIGN can match.
STEMS = ("passw", "pwd", "passphrase", "secret", "token", "api", "credential", "private", "bearer", "auth", "access", "signing", "encryption")
BLOCK = re.compile(r"-----BEGIN [A-Z0-9 ]*KEY(?: BLOCK)?-----")
BLOCK_LINE = re.compile(r"\s*(?:[A-Za-z0-9+/=]{8,}|[A-Za-z-]+: .*)?\s*")
ANNOUNCES = re.compile(r"[:=>(\[{|\\\"'-]\s*$|(?ai:key|token|secret|password|credentials?)\s*$")
DICTIONARY = (
    "import from return class function def public static void private protected const var let string int "
    "password= passwd= secret= token= api_key= apikey= access_key= client_secret= authorization: Bearer "
    "username user admin root localhost example.com https:// http:// www. .com .org .net /usr/local/bin /home/ "
    "configuration connection database host port value values index result request response default settings "
    "environment variable public_key private_key certificate BEGIN END license version build release test "
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 changeme placeholder your_api_key_here "
    "xxxxxxxxxxxxxxxx 0000000000000000 the and for with that this from have not are was but they their there "
    "tion ing ment able ness ence ance ical ously ated ating ation"
).encode()
SURROUNDINGS = 400  # code points on either side of a candidate that prime the measure
NOVELTY = 1.15  # marginal compressed bits for each bit that the candidate's alphabet can carry
PARTS, PART_SHARED = 4_000, 3  # identifier parts of the corpus in the dictionary at most; different identifiers that hold one at least
IDENTIFIER = "[A-Za-z][A-Za-z0-9]*(?:[_-][A-Za-z0-9]+)+|[a-z]+(?:[A-Z][a-z]+)+"
PART = "[A-Z]?[a-z]{2,11}|[A-Z]{3,12}"


def without_copies(text: str, piece: str) -> str:
    """text with blanks for every run of LEAST characters or more that piece holds too."""
    grams = {text[i : i + LEAST] for m in CANDIDATE.finditer(text) for i in range(m.start(), m.end() - LEAST + 1)}
    if not grams:
        return text
    held = {g for i in range(len(piece) - LEAST + 1) if (g := piece[i : i + LEAST]) in grams}
    out = list(text)
    for i in range(len(text) - LEAST + 1):
        if text[i : i + LEAST] in held:
            out[i : i + LEAST] = " " * LEAST
    return "".join(out)


def capacity(candidate: str) -> float:
    """Bytes that random text of the candidate's length and alphabet, without regard to case, carries."""
    if re.fullmatch("(?i:[0-9a-f.-]+)", candidate):
        size = 16
    else:
        size = sum(n for n, kind in ((10, "[0-9]"), (26, "[A-Za-z]")) if re.search(kind, candidate)) or 1
    return max(1.0, len(candidate) * math.log2(size) / 8)


def identifier_parts(docs: DataFrame) -> list[str]:
    """The parts of identifiers, in lower case, that most different identifiers of the corpus hold, most common last.

    Identifiers are counted over all rows of docs, each once; no more than PARTS rows of a few
    characters come to the driver.
    """
    said = docs.select(F.explode(F.regexp_extract_all("text", F.lit(IDENTIFIER), F.lit(0))).alias("name")).distinct()
    own = F.transform(F.regexp_extract_all("name", F.lit(PART), F.lit(0)), lambda x: F.lower(x))
    parts = said.select("name", F.explode(F.array_distinct(own)).alias("part"))
    counted = parts.groupBy("part").agg(F.count("*").alias("n")).where(F.col("n") >= PART_SHARED)
    top = counted.orderBy(F.desc("n"), "part").limit(PARTS).collect()
    return [r["part"] for r in reversed(top)]


class Scanner:
    def __init__(self, novelty: float = NOVELTY, parts: list[str] | None = None):
        self.novelty = novelty
        # Matches at the end of a dictionary cost least: the fixed words stand there.
        content = " ".join(parts or []).encode() + b" " + DICTIONARY
        primed = zstandard.ZstdCompressionDict(content.lower(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        how = zstandard.ZstdCompressionParameters.from_level(9, min_match=3, strategy=zstandard.STRATEGY_BTULTRA2, write_content_size=0, write_checksum=0)
        primed.precompute_compress(compression_params=how)
        self.compressor = zstandard.ZstdCompressor(dict_data=primed, compression_params=how)

    def base(self, text: str) -> list[tuple[int, int, int]]:
        """(start, end, kind) of the fixed shapes."""
        low = text.lower()
        speaks = any(stem in low for stem in STEMS)
        found = [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8] if speaks else []
        found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
        found += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
        return sorted(found, key=lambda s: (s[0], s[2]))

    def marginal(self, before: str, candidate: str, after: str) -> float:
        """Compressed bytes that the candidate adds to its surroundings, for each byte it can carry; case tells nothing."""
        size = lambda s: len(self.compressor.compress(s.lower().encode("utf-8", "surrogatepass")))
        return (size(f"{before}{after}\n{candidate}") - size(f"{before}{after}\n")) / capacity(candidate)

    def contexts(self, text: str) -> list[tuple[int, int]]:
        """The sensitive stretches of a text, in order and apart from each other."""
        low = text.lower()
        if not any(stem in low for stem in STEMS) and "-----BEGIN " not in text:
            return []
        found = []

        def line_end(at: int) -> int:
            end = text.find("\n", at)
            return len(text) if end < 0 else end

        done = -1
        for word in SENSITIVE.finditer(text):
            if word.start() < done:
                continue
            hi = done = line_end(word.end())
            lo = text.rfind("\n", 0, word.start()) + 1
            if hi < len(text) and ANNOUNCES.search(text, max(lo, hi - 80), hi):  # what is announced stands on the next line
                hi = line_end(hi + 1)
            found.append((lo, hi))
        for block in BLOCK.finditer(text):
            end = line_end(block.end())
            while end < len(text) and BLOCK_LINE.fullmatch(text, end + 1, following := line_end(end + 1)):
                end = following
            found.append((block.end(), end))
        merged: list[tuple[int, int]] = []
        for lo, hi in sorted(found):
            if merged and lo <= merged[-1][1]:
                merged[-1] = (merged[-1][0], max(hi, merged[-1][1]))
            else:
                merged.append((lo, hi))
        return merged

    def novel(self, text: str, known: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """Candidates in sensitive contexts, outside the known spans (sorted), that nothing around them explains."""
        out = []
        begins = [s for s, _, _ in known]
        reach = list(accumulate((e for _, e, _ in known), max))  # the furthest end of a span and those before it
        for lo, hi in self.contexts(text):
            for m in CANDIDATE.finditer(text, lo, hi):
                a, b = m.span()
                if b - a < LEAST or not re.search("[A-Za-z]", m[0]):  # digits alone are a number
                    continue
                upto = bisect_left(begins, b)
                if upto and reach[upto - 1] > a:
                    continue
                # A little more than is measured, so that a copy across the border is seen.
                before = without_copies(text[max(0, a - SURROUNDINGS - LEAST) : a], m[0])[-SURROUNDINGS:]
                after = without_copies(text[b : b + SURROUNDINGS + LEAST], m[0])[:SURROUNDINGS]
                if self.marginal(before, m[0], after) >= self.novelty:
                    out.append((a, b, 3))
        return out


def spell(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


def secret_spans(docs: DataFrame, novelty: float = NOVELTY) -> DataFrame:
    """doc_id, base and spans for each row of docs: arrays of (start, end, kind), in code points.

    base holds the fixed shapes, spans those and the novel strings, both by start and then
    in the order assign, access, hex, novel. Novel spans neither overlap each other nor a fixed
    shape. A null text is empty; a null doc_id is returned as null; repeated rows are scanned
    each; texts of any length are scanned whole; other columns are not read; an empty table
    gives an empty result.
    """
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    parts = identifier_parts(plain)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(novelty, parts)
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.int32())]))
        shaped = lambda spans: [{"start": a, "end": b, "kind": k} for a, b, k in spans]
        for batch in batches:
            base = [scanner.base(t) for t in batch.column("text").to_pylist()]
            every = [sorted([*b, *scanner.novel(t, b)], key=lambda s: (s[0], s[2])) for t, b in zip(batch.column("text").to_pylist(), base, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(list(map(shaped, base)), kind), pa.array(list(map(shaped, every)), kind)],
                names=["doc_id", "base", "spans"],
            )

    spans = "array<struct<start: long, end: long, kind: int>>"
    return plain.mapInArrow(scan, f"doc_id long, base {spans}, spans {spans}")
