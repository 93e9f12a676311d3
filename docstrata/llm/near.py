"""N-gram Jaccard join with Bayesian candidate pruning.

A text is the set of its word shingles. Texts with equal sets are one class, found by a
grouped aggregate, and only one member of a class, its node, is compared. A node has an id of
its own, since one doc_id may carry several texts. MinHash signatures are cut into bands;
nodes that share a band value are candidates, and connected candidates form a block. Blocks
are compared in tiles of bounded rows and bytes, so that thousands of near copies of each
other spread over many tasks and each pair is met once.

In a tile signatures are compared a few values at a time. With m of n values equal and a
uniform prior, the similarity has the Beta(m + 1, n - m + 1) distribution; a pair whose
probability of reaching the threshold is below the tolerance is dropped. The pairs that
remain are verified exactly on their shingle sets.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docstrata.llm.common import connected_components, discard, materialize, release_memory, text_of
from docstrata.llm.tiles import tile_result

BANDS, ROWS = 42, 6
HASHES = BANDS * ROWS
TILE = 1024  # nodes on one side of a tile
TILE_BYTES = 24 << 20  # of shingles on one side of a tile, unless one node has more
TOLERANCE = 1e-6
STEPS = (16, 32, 64, 128, HASHES)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit words (the finalizer of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hash_words(words: pa.Array) -> np.ndarray:
    """A 64-bit hash for each word, computed once for each distinct one."""
    import xxhash

    coded = pc.dictionary_encode(words)
    own = np.fromiter((xxhash.xxh64_intdigest(w) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    return own[np.asarray(coded.indices)]


def shingles(texts: pa.Array, width: int) -> list[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each text.

    Words are runs without white space, A-Z in lower case. A text of fewer words than
    width, but some, has the one shingle of all its words; one without words has none.
    """
    with np.errstate(over="ignore"):
        spaced = pc.ascii_trim(pc.replace_substring_regex(texts, "[\x20\x09-\x0d]+", " "), " ")
        folded = pc.ascii_lower(spaced) if pc.all(pc.string_is_ascii(spaced)).as_py() else _fold(spaced)
        parts = pc.split_pattern(folded, " ")
        flat = parts.flatten() if hasattr(parts, "flatten") else parts
        hashes = hash_words(flat)
        counts = np.asarray(pc.list_value_length(parts)).astype(np.int64)
        empty = np.asarray(pc.equal(pc.binary_length(folded), 0))
        ends = np.cumsum(counts)
        out = []
        rolled = np.zeros(max(0, len(hashes) - width + 1), np.uint64)
        for k in range(width):
            rolled = _mix(rolled * np.uint64(3) + hashes[k : k + len(rolled)] + _MIX) if len(rolled) else rolled
        for n, end, none in zip(counts.tolist(), ends.tolist(), empty.tolist(), strict=True):
            if none:
                out.append(np.zeros(0, np.uint64))
            elif n >= width:
                out.append(np.unique(rolled[end - n : end - width + 1]))
            else:
                one = np.zeros(1, np.uint64)
                for h in hashes[end - n : end]:
                    one = _mix(one * np.uint64(3) + h + _MIX)
                out.append(_mix(one + np.uint64(n)))
        return out


def _fold(texts: pa.Array) -> pa.Array:
    table = str.maketrans(_UPPER, _LOWER)
    return pa.array([t.translate(table) for t in texts.to_pylist()], texts.type)


def _seeds() -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        k = np.arange(1, HASHES + 1, dtype=np.uint64)
        return _mix(k * _MIX) | np.uint64(1), _mix(k * _MIX + np.uint64(7))


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash signatures, one row of 32-bit values for each set that is not empty."""
    out = np.empty((len(sets), HASHES), np.uint32)
    if not sets:
        return out
    mul, add = _seeds()
    with np.errstate(over="ignore"):
        lo = 0
        while lo < len(sets):  # so many sets at once that the arrays stay in cache
            hi, held = lo, 0
            while hi < len(sets) and (hi == lo or held + len(sets[hi]) <= 60_000):
                held += len(sets[hi])
                hi += 1
            flat = np.concatenate(sets[lo:hi])
            starts = np.cumsum([0, *map(len, sets[lo : hi - 1])])
            for k in range(HASHES):
                out[lo:hi, k] = np.minimum.reduceat((flat * mul[k] + add[k]) >> np.uint64(32), starts)
            lo = hi
    return out


def set_hash(s: np.ndarray) -> tuple[int, int]:
    """128 bits that identify a set."""
    import xxhash

    h = xxhash.xxh3_128_intdigest(s.tobytes())
    return (h >> 64) - (1 << 63), (h & ((1 << 64) - 1)) - (1 << 63)


@functools.cache
def least_matches(n: int, threshold: float, tolerance: float) -> int:
    """The fewest equal values of n with which P(similarity >= threshold) is at least tolerance."""
    for m in range(n + 1):
        # P(Beta(m + 1, n - m + 1) >= t) = P(Binomial(n + 1, t) <= m)
        tail = sum(math.comb(n + 1, k) * threshold**k * (1 - threshold) ** (n + 1 - k) for k in range(m + 1))
        if tail >= tolerance:
            return m
    return n


def pruned_pairs(a: np.ndarray, b: np.ndarray, same: bool, threshold: float, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of signature rows that incremental comparison does not drop; i < j where a is b."""
    first = STEPS[0]
    equal = np.zeros((len(a), len(b)), np.int16)
    for k in range(first):
        equal += a[:, k, None] == b[None, :, k]
    keep = equal >= least_matches(first, threshold, tolerance)
    i, j = np.nonzero(np.triu(keep, 1) if same else keep)
    equal = equal[i, j]
    for lo, hi in zip(STEPS, STEPS[1:], strict=False):
        if not len(i):
            break
        equal = equal + (a[i, lo:hi] == b[j, lo:hi]).sum(axis=1)
        keep = equal >= least_matches(hi, threshold, tolerance)
        i, j, equal = i[keep], j[keep], equal[keep]
    return i, j


def verified(i: np.ndarray, j: np.ndarray, left: list[np.ndarray], right: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which pairs have an exact Jaccard similarity of at least the threshold."""
    size_a, size_b = (np.fromiter(map(len, s), np.int64, len(s)) for s in (left, right))
    if len(i) <= 64:
        common = np.fromiter((len(np.intersect1d(left[x], right[y], assume_unique=True)) for x, y in zip(i.tolist(), j.tolist(), strict=True)), np.int64, len(i))
    else:  # intersections of all rows in use, by products over slices of their shingles
        ua, ub = np.unique(i), np.unique(j)
        flat_a, flat_b = np.concatenate([left[x] for x in ua]), np.concatenate([right[y] for y in ub])
        values = np.intersect1d(flat_a, flat_b)
        row_a = np.repeat(np.arange(len(ua)), size_a[ua])
        row_b = np.repeat(np.arange(len(ub)), size_b[ub])
        dense = np.zeros((len(ua), len(ub)), np.float32)
        for lo in range(0, len(values), 8192):
            own = values[lo : lo + 8192]
            dense += _incidence(flat_a, row_a, len(ua), own) @ _incidence(flat_b, row_b, len(ub), own).T
        common = dense[np.searchsorted(ua, i), np.searchsorted(ub, j)].astype(np.int64)
    union = size_a[i] + size_b[j] - common
    return common >= threshold * union - 1e-9


def _incidence(flat: np.ndarray, row: np.ndarray, n: int, values: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(values, flat), len(values) - 1)
    hit = values[at] == flat
    out = np.zeros((n, len(values)), np.float32)
    out[row[hit], at[hit]] = 1
    return out


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, text_key, h1, h2, n, sig): the identity and MinHash signature of each text's shingle set."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 512):
                batch = whole.slice(lo, 512)
                sets = shingles(batch.column("text"), width)
                full = [k for k, s in enumerate(sets) if len(s)]
                sig = signatures([sets[k] for k in full])
                hashes = [set_hash(sets[k]) for k in full]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").take(pa.array(full, pa.int64())),
                        batch.column("text_key").take(pa.array(full, pa.int64())),
                        pa.array([h for h, _ in hashes], pa.int64()),
                        pa.array([h for _, h in hashes], pa.int64()),
                        pa.array([len(sets[k]) for k in full], pa.int64()),
                        pa.array([s.tobytes() for s in sig], pa.binary()),
                    ],
                    names=["doc_id", "text_key", "h1", "h2", "n", "sig"],
                )
            release_memory()

    return docs.mapInArrow(sketch, "doc_id long, text_key long, h1 long, h2 long, n long, sig binary")


def _with_shingles(rows: DataFrame, width: int) -> DataFrame:
    """rows (block, node, size, h1, h2, sig, text) with the set instead of the text, where it is the node's."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 512):
                batch = whole.slice(lo, 512)
                sets = shingles(batch.column("text"), width)
                own = list(zip(batch.column("h1").to_pylist(), batch.column("h2").to_pylist(), strict=True))
                right = [k for k, s in enumerate(sets) if len(s) and set_hash(s) == own[k]]
                kept = batch.select(["block", "node", "size", "sig"]).take(pa.array(right, pa.int64()))
                yield kept.append_column("set", pa.array([sets[k].tobytes() for k in right], pa.binary()))
            release_memory()

    return rows.mapInArrow(add, "block long, node long, size long, sig binary, set binary")


def _compare(threshold: float, tolerance: float):
    def compare(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        block, side = np.asarray(table.column("block")), np.asarray(table.column("side"))
        node, size = np.asarray(table.column("node")), np.asarray(table.column("size"))
        sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint32).reshape(len(node), HASHES)
        sets = [np.frombuffer(x, np.uint64) for x in table.column("set").to_pylist()]
        order = np.lexsort((node, side, block))
        # A document that stands twice in the table brings its node twice.
        order = order[np.concatenate(([True], (np.diff(block[order]) != 0) | (np.diff(side[order]) != 0) | (np.diff(node[order]) != 0)))]
        cuts = np.flatnonzero(np.diff(block[order])) + 1
        out = []
        for rows in np.split(order, cuts):
            left, right = rows[side[rows] == 0], rows[side[rows] == 1]
            same = not len(right)
            right = left if same else right
            i, j = pruned_pairs(sig[left], sig[right], same, threshold, tolerance)
            if not len(i):
                continue
            ok = verified(i, j, [sets[k] for k in left], [sets[k] for k in right], threshold)
            local = {int(k): n for n, k in enumerate(rows)}
            a = np.fromiter((local[int(left[x])] for x in i[ok]), np.int64, int(ok.sum()))
            b = np.fromiter((local[int(right[y])] for y in j[ok]), np.int64, int(ok.sum()))
            out.append(tile_result(node[rows], size[rows], a, b))
        columns = [np.concatenate([o[k] for o in out]) if out else np.zeros(0, np.int64) for k in range(3)]
        del sig, sets
        release_memory()
        return pa.table(dict(zip(("node", "links", "root"), columns, strict=True)))

    return compare


def jaccard_join(docs: DataFrame, threshold: float = 0.8, width: int = 5, tolerance: float = TOLERANCE, tile: int = TILE) -> DataFrame:
    """doc_id, class_id, copy_of, n_links, text_key (xxhash64 of the text) and kept for each row of docs.

    Two rows link when the Jaccard similarity of their shingle sets (width words each, A-Z
    in lower case) is at least threshold. n_links counts the other rows that a row links
    with, copies included; copy_of is the smallest doc_id with an equal set; class_id is the
    smallest doc_id that links lead to, and kept says it is the row's own. A band value is
    shared with probability above 1 - 3e-6 at a similarity of 0.8, and a linked pair passes
    the pruning but for a chance of the order of the tolerance; no bucket, block or number
    of partners is capped.

    Rows whose text is null, empty or blank, and rows without doc_id, link with nothing:
    class_id and copy_of are their doc_id and kept is true. Texts of fewer words than width
    have one shingle; texts of any length count whole. Repeated rows link with each other and
    share their doc_id. Rows of one doc_id with different texts are further documents: each has
    the links and the class of its own text, and kept is true where that class bears the doc_id.
    Other columns are not read; an empty table gives an empty result.
    """
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_of()).alias("text_key"), text_of().alias("text"))
    sketched = materialize(sketches(plain.where(F.col("doc_id").isNotNull()), width), "sketches")
    classes = sketched.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("size"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    classes = materialize(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    values = F.transform(
        F.sequence(F.lit(0), F.lit(BANDS - 1)),
        lambda k: F.xxhash64(k, F.substring(F.col("sig"), k * (4 * ROWS) + 1, F.lit(4 * ROWS))),
    )
    banded = classes.select("node", F.explode(values).alias("band"))
    shared = materialize(banded.groupBy("band").agg(F.min("node").alias("low"), F.count("*").alias("m")).where("m > 1").select("band", "low"), "bands")
    edges = banded.join(shared, "band").where(F.col("node") != F.col("low")).select(F.col("node").alias("a"), F.col("low").alias("b"))
    members = materialize(connected_components(edges).select("node", F.col("component").alias("block")), "blocks")

    # The text of a node is that of any row of its class; the smallest doc_id finds it.
    texts = members.join(classes, "node").join(plain, F.col("rep") == F.col("doc_id"))
    sets = materialize(_with_shingles(texts.select("block", "node", "size", "h1", "h2", "sig", "text"), width), "sets")
    sizes = members.join(classes.select("node", "n"), "node").groupBy("block").agg(F.count("*").alias("m"), F.sum("n").alias("n"))
    parts = F.ceil(F.greatest(F.col("m") / tile, F.col("n") * 8 / TILE_BYTES)).cast("int")
    sizes = materialize(sizes.withColumn("parts", parts), "parts")
    bins = max(1, (sizes.agg(F.sum("n").alias("n")).first()["n"] or 0) * 8 // TILE_BYTES, (sizes.agg(F.sum("m").alias("m")).first()["m"] or 0) // tile)
    own = F.when(F.col("parts") == 1, F.pmod(F.xxhash64("block"), F.lit(bins))).otherwise(F.pmod(F.xxhash64("node"), F.col("parts")))
    sent = (
        sets.join(sizes.select("block", "parts"), "block")
        .withColumn("own", own.cast("long"))
        .withColumn("part", F.explode(F.when(F.col("parts") == 1, F.array("own")).otherwise(F.sequence(F.lit(0).cast("long"), F.col("parts").cast("long") - 1))))
        .select(
            F.when(F.col("parts") > 1, F.col("block")).alias("tile"),
            F.least("own", "part").alias("p"),
            F.greatest("own", "part").alias("q"),
            (F.col("own") > F.col("part")).cast("int").alias("side"),
            "block", "node", "size", "sig", "set",
        )
    )
    found = sent.groupBy("tile", "p", "q").applyInArrow(_compare(threshold, tolerance), "node long, links long, root long")
    found = materialize(found, "links")
    discard(shared, sets, sizes, members)
    names = classes.select("node", "h1", "h2", "rep", "size")
    comps = connected_components(found.select(F.col("node").alias("a"), F.col("root").alias("b"))).join(names.select("node", "rep"), "node")
    # A component is named by the smallest doc_id of its nodes.
    comps = materialize(comps.select("node", "component", "rep"), "components")
    named = comps.groupBy("component").agg(F.min("rep").alias("class_id"))
    linked = found.groupBy("node").agg(F.sum("links").alias("links")).join(comps.join(named, "component"), "node").select("node", "links", "class_id")
    answers = materialize(
        names.join(linked, "node", "left").select(
            "h1", "h2", F.col("rep").alias("copy_of"), (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("class_id", "rep").alias("class_id")
        ),
        "answers",
    )
    discard(classes, found, comps)
    told = sketched.select("doc_id", "text_key", "h1", "h2").join(answers, ["h1", "h2"]).select("doc_id", "class_id", "copy_of", "n_links", "text_key")
    silent = plain.where(F.col("doc_id").isNull() | ~F.col("text").rlike(r"[^\x20\x09-\x0D]")).select(
        "doc_id", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("copy_of"), F.lit(0).cast("long").alias("n_links"), "text_key"
    )
    return told.unionByName(silent).withColumn("kept", F.coalesce(F.col("class_id") == F.col("doc_id"), F.lit(True)))
