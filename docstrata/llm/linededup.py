"""Line dedup by range-partitioned hashes, streamed in order, answered as keep bitmaps.

Every line becomes a record (128-bit key hash, document, position). The records are
range-partitioned by hash and document, so that a line which a third of all documents
hold spreads over many partitions, and sorted inside each by document and position. One
pass then sees the occurrences of a key in order. A run that touches the border of its
partition is settled with a summary of at most two rows a partition. Texts never pass
the shuffle of the records: the answer is a compressed bitmap a document.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docstrata.llm.common import fingerprint, materialize, text_of

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_RUNS = "kind int, h1 long, h2 long, doc_id long, text_key long, pos int, n_docs long, part int"
_FIELDS = ["h1", "h2", "doc_id", "text_key", "pos", "n_docs", "part"]
DROP, OPEN, SUMMARY, LEAD = 0, 1, 2, 3
HELD = 100_000  # records of one open key that a task holds; more are left open and settled with the borders


def line_records(docs: DataFrame, min_chars: int) -> DataFrame:
    """(h1, h2, doc_id, text_key, pos) of every line whose key has min_chars code points or more."""
    line = F.translate(F.btrim(F.col("line"), F.lit(" \t\n\x0b\x0c\r")), UPPER, LOWER)
    h1, h2 = fingerprint(F.col("key"))
    return (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
        .select("doc_id", F.xxhash64("text").alias("text_key"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
        .select("doc_id", "text_key", "pos", line.alias("key"))
        .where(F.length("key") >= min_chars)
        .select(h1.alias("h1"), h2.alias("h2"), "doc_id", "text_key", "pos")
    )


def _stream(min_docs: int, keep_first: bool, most_held: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        key = None  # of the open run
        held: list = []  # column slices of the open run until min_docs documents are seen
        docs, last, first_run, lead = 0, None, True, True
        spilled = False  # records of the open run have been left open

        def rows(kind: int, cols: list[np.ndarray], null: np.ndarray) -> pa.RecordBatch:
            n = len(cols[0])
            arrays = [pa.array(np.full(n, kind, np.int32)), pa.array(cols[0]), pa.array(cols[1]), pa.array(cols[2], mask=null), pa.array(cols[3]), pa.array(cols[4]), pa.nulls(n, pa.int64()), pa.array(np.full(n, part, np.int32))]
            return pa.RecordBatch.from_arrays(arrays, names=["kind", *_FIELDS])

        def summary() -> pa.RecordBatch:
            one = lambda v, t: pa.array([v], t)
            arrays = [one(SUMMARY, pa.int32()), one(key[0], pa.int64()), one(key[1], pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int32()), one(docs, pa.int64()), one(part, pa.int32())]
            return pa.RecordBatch.from_arrays(arrays, names=["kind", *_FIELDS])

        def settle(border: bool) -> Iterator[pa.RecordBatch]:
            """What the run that ends here leaves open."""
            if border or spilled:
                yield summary()
                for cols, null in held:
                    yield rows(OPEN, cols, null)

        for batch in batches:
            cols = [np.asarray(batch.column(n).fill_null(0)) for n in ("h1", "h2", "doc_id", "text_key", "pos")]
            null = np.asarray(batch.column("doc_id").is_null())
            size = len(cols[0])
            if not size:
                continue
            new = np.flatnonzero((cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1])) + 1
            bounds = np.concatenate(([0], new, [size]))
            same_doc = np.concatenate(([False], (cols[2][1:] == cols[2][:-1]) & (null[1:] == null[:-1])))
            # A run inside the batch with fewer lines than min_docs stays whole: only others are visited.
            visit = np.flatnonzero(np.diff(bounds) >= min_docs)
            visit = np.unique(np.concatenate(([0], visit, [len(bounds) - 2])))
            for lo, hi in zip(bounds[visit].tolist(), bounds[visit + 1].tolist(), strict=True):
                if (here := (int(cols[0][lo]), int(cols[1][lo]))) != key:
                    if key is not None:
                        yield from settle(first_run)
                    first_run = key is None
                    key, held, docs, last, lead, spilled = here, [], 0, None, True, False
                at = slice(lo, hi)
                mine, nul = [c[at] for c in cols], null[at]
                fresh = ~same_doc[at]
                fresh[0] = last != (None if nul[0] else int(mine[2][0])) or docs == 0
                docs += int(fresh.sum())
                last = None if nul[-1] else int(mine[2][-1])
                if keep_first and lead:
                    # The leading record stays unless an earlier partition holds the key.
                    lead_cols, lead_null = [c[:1] for c in mine], nul[:1]
                    if first_run:
                        yield rows(LEAD, lead_cols, lead_null)
                    mine, nul, lead = [c[1:] for c in mine], nul[1:], False
                if docs >= min_docs:
                    for old, old_null in held:
                        yield rows(DROP, old, old_null)
                    held = []
                    if len(nul):
                        yield rows(DROP, mine, nul)
                elif len(nul):
                    held.append((mine, nul))
                    if sum(len(x) for _, x in held) > most_held:  # one document may hold a line any number of times
                        for cols_, null_ in held:
                            yield rows(OPEN, cols_, null_)
                        held, spilled = [], True
        if key is not None:
            yield from settle(True)

    return run


def line_keep_bitmaps(docs: DataFrame, min_docs: int = 2, keep: str = "first", min_chars: int = 1, most_held: int = HELD) -> DataFrame:
    """(doc_id, text_key, n_dropped, bitmap) for each document that loses a line.

    A key is a line without white space at its ends, A-Z in lower case. A key of at least
    min_chars code points that min_docs documents or more hold loses all its lines, or
    with keep="first" all but the one of the smallest document and position. bitmap is
    zlib over packed bits, one a line, 1 to keep; lines past its end are kept. text_key
    (xxhash64 of the text) tells apart rows that share a doc_id.

    A null text is one empty line, which min_chars >= 1 leaves alone. Rows with one doc_id
    are one document when documents are counted; rows without a doc_id together are one.
    Repeated rows get the same answer. Texts of any length count whole, and a line may stand in
    one any number of times; other columns are not read. An empty table gives no rows.
    """
    records = materialize(line_records(docs, min_chars), "lines")
    ordered = records.repartitionByRange("h1", "h2", "doc_id").sortWithinPartitions("h1", "h2", "doc_id", "text_key", "pos")
    runs = materialize(ordered.mapInArrow(_stream(min_docs, keep == "first", most_held), _RUNS), "runs")
    border = runs.where(F.col("kind") == SUMMARY).groupBy("h1", "h2").agg(F.sum("n_docs").alias("all_docs"), F.min("part").alias("first_part"))
    border = border.where(F.col("all_docs") >= min_docs)  # two rows a partition at most before this
    late = (F.col("kind") == OPEN) | (F.col("part") > F.col("first_part"))
    settled = runs.where(F.col("kind").isin(OPEN, LEAD)).join(border, ["h1", "h2"]).where(late)
    where = ["doc_id", "text_key", "pos"]
    dropped = runs.where(F.col("kind") == DROP).select(*where).unionByName(settled.select(*where))
    lost = dropped.groupBy("doc_id", "text_key").agg(F.collect_set("pos").alias("lost"))
    return lost.mapInArrow(_bitmaps, "doc_id long, text_key long, n_dropped long, bitmap binary")


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lost = batch.column("lost")
        maps, counts = [], []
        for item in lost:
            at = np.asarray(item.values)
            bits = np.ones(int(at.max()) // 8 * 8 + 8, np.uint8)
            bits[at] = 0
            maps.append(zlib.compress(np.packbits(bits).tobytes()))
            counts.append(len(at))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("text_key"), pa.array(counts, pa.int64()), pa.array(maps, pa.binary())],
            names=["doc_id", "text_key", "n_dropped", "bitmap"],
        )


def kept_text(text: str, bitmap: bytes | None) -> tuple[str, int, int]:
    """The text without the lines whose bit is 0, its lines before, and the number dropped."""
    lines = text.split("\n")
    if bitmap is None:
        return text, len(lines), 0
    bits = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8))[: len(lines)]
    gone = set(np.flatnonzero(bits == 0).tolist())
    return "\n".join(x for i, x in enumerate(lines) if i not in gone), len(lines), len(gone)


def with_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """docs with the columns text_key and bitmap; bitmap is null where every line stays."""
    keyed = docs.withColumn("text_key", F.xxhash64(text_of()))
    found = bitmaps.select(F.col("doc_id").alias("bitmap_doc"), F.col("text_key").alias("bitmap_text"), "bitmap")
    on = F.col("doc_id").eqNullSafe(F.col("bitmap_doc")) & (F.col("text_key") == F.col("bitmap_text"))
    return keyed.join(found, on, "left").drop("bitmap_doc", "bitmap_text")
