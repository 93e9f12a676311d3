"""The queries of this package and, where SQL can express them, their oracles."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docstrata.llm.common import read, text_of
from docstrata.llm.oracles import ORACLE_SQL  # noqa: F401


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docstrata.llm.langid import identify

    return identify(read(spark, sf_dir, "pages"), read(spark, sf_dir, "documents"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docstrata.llm.mixing import mix

    return mix(read(spark, sf_dir, "documents"))


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docstrata.llm.vectors import embedding_near_dedup

    return embedding_near_dedup(read(spark, sf_dir, "embeddings"), threshold=0.98)


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docstrata.llm.near import jaccard_join

    return jaccard_join(read(spark, sf_dir, "documents"), threshold=0.8, width=5)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docstrata.llm.quality import quality_rules

    return quality_rules(read(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed_rules"
    )


def _kept_digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import hashlib

    from docstrata.llm.linededup import kept_text

    for batch in batches:
        made = [kept_text(t, b) for t, b in zip(batch.column("text").to_pylist(), batch.column("bitmap").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array([n for _, n, _ in made], pa.int64()),
                pa.array([d for _, _, d in made], pa.int64()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t, _, _ in made], pa.string()),
            ],
            names=["doc_id", "n_lines", "n_dropped", "kept_sha256"],
        )


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docstrata.llm.linededup import line_keep_bitmaps, with_bitmaps

    docs = read(spark, sf_dir, "documents").select("doc_id", text_of().alias("text"))
    bitmaps = line_keep_bitmaps(docs, min_docs=10, keep="none", min_chars=1)
    joined = with_bitmaps(docs, bitmaps).select("doc_id", "text", "bitmap")
    return joined.mapInArrow(_kept_digest, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docstrata.llm.packing import pack

    return pack(read(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"), window=1024, end_id=0, ids=False)


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docstrata.llm.licenses import license_scan

    return license_scan(read(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docstrata.llm.tokencount import token_counts

    return token_counts(read(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"), limit=2048)


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docstrata.llm.secrets import KINDS, secret_spans

    names = F.array(*map(F.lit, KINDS))
    spell = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return secret_spans(read(spark, sf_dir, "documents")).select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(spell("base"), 256).alias("base_sha256"), spell("spans").alias("spans"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_language_id, op2_mixing, op3_embedding_near_dedup, op4_quality_rules, op5_packing,
        op6_jaccard_join, op7_license_scan, op8_line_dedup, op9_token_counts, op10_secret_scan,
    )
}
