"""From raw documents to packed sequences: five stages, each written before the next reads it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docstrata.llm.common import WHITE, materialize, read, text_of
from docstrata.llm.linededup import kept_text, line_keep_bitmaps, with_bitmaps
from docstrata.llm.mixing import mix
from docstrata.llm.near import jaccard_join
from docstrata.llm.packing import pack
from docstrata.llm.quality import quality_rules

#: A line in this many documents or more stays in the first of them alone.
REPEATED_LINE_DOCS = 10


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality rules keep (operator 4).

    A text need not be long to be clean: only the measures of the text decide, not the 50 words
    that the operator asks for by default. A row is judged for itself: null and empty texts go, repeated rows and rows without a
    doc_id are judged by their text. An empty table stays empty. Columns of any name pass.
    """
    return quality_rules(docs, min_words=1, carry=docs.columns).where("kept").select("row_.*")


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier document holds (operator 8).

    Only lines found in REPEATED_LINE_DOCS documents or more count as repeated. n_chars, where
    there is such a column, follows the text. A document of which no word is left has nothing
    of its own and goes; one that had none before stays, a null text as null. Rows of one
    doc_id are one document, repeated rows are cut alike, rows without a doc_id are one
    document together. An empty table stays empty. Columns of any name pass.
    """

    def rewrite(batches):
        import pyarrow as pa

        for batch in batches:
            bitmaps = batch.column("bitmap").to_pylist()
            texts = [t if b is None else kept_text(t, b)[0] for t, b in zip(batch.column("text").to_pylist(), bitmaps, strict=True)]
            at = batch.schema.get_field_index("text")
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), F.struct(*(F.col(c) for c in docs.columns if c != "text")).alias("row_"))
    marked = with_bitmaps(rows, line_keep_bitmaps(docs.select("doc_id", "text"), min_docs=REPEATED_LINE_DOCS, keep="first")).drop("text_key")
    cut = marked.mapInArrow(rewrite, marked.schema)
    changed = F.col("bitmap").isNotNull()
    left = cut.where(~(changed & ~F.col("text").rlike(f"[^{WHITE}]")))
    length = F.when(changed, F.length("text").cast("long"))
    own = {c: F.col(f"row_.`{c}`") for c in docs.columns if c != "text"} | {"text": F.col("text")}
    if "n_chars" in own:
        own["n_chars"] = F.coalesce(length, own["n_chars"])
    return left.select(*(own[c].alias(c) for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, of the smallest doc_id, of each group of near duplicates (operator 6).

    Rows that repeat a document, doc_id and text, are copies too: the one whose other columns
    are least stays. Rows without a doc_id, and those without words, link with nothing and
    stay. An empty table stays empty. Columns of any name pass.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_of()).alias("text_key"), F.struct(*docs.columns).alias("row_"))
    key = ["doc_id", "text_key"]
    gone = materialize(jaccard_join(docs.select("doc_id", "text"), threshold=0.8, width=5).where(~F.col("kept")).select(*key).distinct(), "gone")
    left = rows.join(gone, key, "left_anti")
    twice = rows.where("doc_id is not null").groupBy(*key).count().where("count > 1").select(*key)
    twice = materialize(twice, "twice")
    if not twice.isEmpty():
        # map columns have no order: a row is told from its repetitions by its text as JSON
        once = left.join(twice, key, "left_semi").groupBy(*key).agg(F.min_by("row_", F.to_json("row_")).alias("row_")).select(*rows.columns)
        left = left.join(twice, key, "left_anti").unionByName(once)
    return left.select("row_.*")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents by target weight, a row for each epoch that takes them (operator 2).

    The last document of an epoch stays whole. Null names are names of their own, rows that tie
    with the last one stay too, and a document without words is taken if the order puts it
    before the last. An empty table stays empty. Columns of any name pass.
    """
    return mix(docs, keep=docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences with their ids (operator 5).

    A null or empty text is one id; each row is a document of its own, its doc_id null or
    repeated. An empty table gives no pieces. Other columns are not read.
    """
    import public_tokenizers

    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), window=1024, end_id=0)


STAGES = [
    ("quality", quality),
    ("repeated_lines", repeated_lines),
    ("near_duplicates", near_duplicates),
    ("mixing", mixing),
    ("packing", packing),
]

#: Tokenization cannot be said in SQL; tests/llm holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
