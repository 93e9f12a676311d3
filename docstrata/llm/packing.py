"""Packing: concatenate and cut, by two passes of prefix sums over partition totals.

The first pass tokenizes each partition once, notes how many tokens of the partition lie
before each document, and writes ids and sums to the shared folder. The totals of the
partitions, one number each, give every partition its global offset. The second pass adds
the two and cuts at multiples of the window, each document for itself: no shuffle, no
sort, and a piece that a window boundary cuts is marked so that its neighbour is known.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docstrata.llm.common import materialize, release_memory, text_of
from docstrata.llm.tokenize import ByteLevelIds, blocks, shared

PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
    "cut_before boolean, cut_after boolean"
)


def tokenized(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """(part, before, doc_id, n, ids): ids as unsigned little-endian numbers of 16 or 32 bits, end_id last."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, before = TaskContext.get().partitionId(), 0
        encoder = shared(ByteLevelIds, path)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for lo, hi in blocks(texts):
                rows = [np.append(x, end_id).astype(encoder.kind) for x in encoder.encode(texts[lo:hi])]
                sizes = np.fromiter(map(len, rows), np.int64, len(rows))
                ends = before + np.cumsum(sizes)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(rows), part, np.int32)),
                        pa.array(ends - sizes),
                        batch.column("doc_id").slice(lo, hi - lo),
                        pa.array(sizes),
                        pa.array([x.tobytes() for x in rows], pa.binary()),
                    ],
                    names=["part", "before", "doc_id", "n", "ids"],
                )
                before = int(ends[-1])
                del rows
            release_memory()

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return plain.mapInArrow(encode, "part int, before long, doc_id long, n long, ids binary")


def pack(docs: DataFrame, path: str, window: int = 1024, end_id: int = 0, ids: bool = True) -> DataFrame:
    """Pieces of the documents in sequences of exactly window ids, but for the last one.

    Every row of docs is one document, its ids those of the tokenizer file path and then
    end_id, so a null or empty text is one id. Documents follow each other in the order of
    the table's partitions; each id lies in exactly one piece and offsets have no gaps.
    A row: the document, where the piece begins in it (start) and its length, the sequence
    and the offset in it, whether a boundary cuts the piece before or after, the CRC-32 of its
    ids as unsigned little-endian 32-bit numbers and, if wanted, these ids.
    A null doc_id is kept as null; repeated rows are packed each; a document of any length
    is cut over as many sequences as it takes; other columns are not read; an empty table
    gives no pieces. One number for each partition of docs comes to the driver.
    """
    rows = materialize(tokenized(docs, path, end_id), "tokens")
    totals = sorted((r["part"], r["n"]) for r in rows.groupBy("part").agg(F.sum("n").alias("n")).collect())
    base, held = {}, 0
    for part, n in totals:
        base[part] = held
        held += n

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                n = np.asarray(batch.column("n"))
                begin = np.asarray(batch.column("before")) + np.array([base[p] for p in batch.column("part").to_pylist()], np.int64)
                first, last = begin // window, (begin + n - 1) // window
                pieces = last - first + 1
                row = np.repeat(np.arange(len(n)), pieces)
                sequence = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                lo = np.maximum(sequence * window, begin[row])
                hi = np.minimum((sequence + 1) * window, begin[row] + n[row])
                start, length = lo - begin[row], hi - lo
                held = [np.frombuffer(x, f"<u{len(x) // k}") for x, k in zip(batch.column("ids").to_pylist(), n.tolist(), strict=True)]
                own = [held[r][s : s + k].astype("<u4").tobytes() for r, s, k in zip(row.tolist(), start.tolist(), length.tolist(), strict=True)]
                columns = {
                    "doc_id": batch.column("doc_id").take(pa.array(row)),
                    "start": pa.array(start),
                    "length": pa.array(length),
                    "ids_crc32": pa.array(list(map(zlib.crc32, own)), pa.int64()),
                    "doc_tokens": pa.array(n[row]),
                    "sequence_id": pa.array(sequence),
                    "offset": pa.array(lo - sequence * window),
                    "cut_before": pa.array(start > 0),
                    "cut_after": pa.array(hi < begin[row] + n[row]),
                }
                if ids:
                    columns["ids"] = pa.array(own, pa.binary())
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return rows.mapInArrow(cut, PIECES + ", ids binary" * ids)
