"""Rows of the document model with their defaults (survey id SC20)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Columns of the model relation that plans read, and what stands for those that are not given.
MODEL = {
    "doc_id": ("string", None), "pos": ("int", None), "block_id": ("string", None), "block_type": ("string", "unknown"), "role": ("string", None), "level": ("int", None), "list_type": ("string", None), "restart": ("boolean", None), "text": ("string", ""), "raw": ("string", None),
    "style": ("string", ""), "source_role": ("string", None), "status": ("string", None), "ilvl": ("int", None), "num_list_type": ("string", None), "unordered": ("boolean", False), "group_id": ("string", None), "family": ("string", None), "family_source": ("string", None),
    "table_type": ("string", None), "header_rows": ("int", None), "n_rows": ("int", None), "caption_type": ("string", None), "auto_generated": ("boolean", False), "original_type": ("string", None), "group_status": ("string", None), "inferred_role": ("string", None),
}


def model_rows(blocks: DataFrame) -> DataFrame:
    """blocks with every column of the model, in its type; a heading is of level 1, an item of level 0, a data table has a header."""
    defaults = {
        "block_id": F.concat(F.lit("b"), F.lpad((F.col("pos") + 1).cast("string"), 4, "0")),
        "level": F.when(F.col("block_type") == "heading", 1).when(F.col("block_type") == "list_item", 0),
        "list_type": F.when(F.col("block_type") == "list_item", "lower_letter_paren"),
        "restart": F.when(F.col("block_type") == "list_item", False),
        "role": F.when(F.col("block_type").isin("heading", "body", "list_item", "caption"), F.col("block_type")),
        "table_type": F.when(F.col("block_type") == "table", "data"),
        "header_rows": F.when(F.col("block_type") == "table", 1),
        "caption_type": F.when(F.col("block_type") == "caption", "unknown"),
    }
    given = lambda c, kind: F.col(c).cast(kind) if c != "doc_id" else F.col(c)
    made = lambda c, kind, value: F.coalesce(*([given(c, kind)] if c in blocks.columns else []), *([defaults[c].cast(kind)] if c in defaults else []), F.lit(value).cast(kind))
    return blocks.select(*((given(c, kind) if c == "doc_id" else made(c, kind, value)).alias(c) for c, (kind, value) in MODEL.items()))
