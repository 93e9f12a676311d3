"""Plans on relations of the caller's own, such as Markdown or Word files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docstrata.plans.dialect import Spark

#: Optional columns of lines and records, and what stands for them.
LINES = {"page_before": "CAST(false AS BOOLEAN)", "num_fmt": "CAST(NULL AS STRING)", "lvl_text": "CAST(NULL AS STRING)"}
RECORDS = {
    "items": "CAST(NULL AS STRING)", "style": "''", "is_centered": "false", "mostly_bold": "false", "max_size": "CAST(NULL AS DOUBLE)", "has_page_boundary": "false",
    "has_toc_field": "false", "has_pageref": "false", "num_id": "CAST(NULL AS INT)", "ilvl": "CAST(NULL AS INT)", "style_num_id": "CAST(NULL AS INT)", "left_twips": "CAST(NULL AS INT)",
}


def run_plan(name: str, **relations: DataFrame) -> DataFrame:
    """The plan's result on the relations given, by name.

    lines: (doc_id, pos, line), a document's lines in order, as sources.files.markdown_lines
    gives them with the path as doc_id. records: (doc_id, pos, kind, t), a document's paragraphs
    and tables, as docx_records gives them. Optional columns are filled in. Any table that a
    plan names (documents, definitions, decisions and so on) can be given as well.
    """
    from docstrata.plans.catalog import PLANS

    held = dict(relations)
    first = next(iter(held.values()))
    for relation, optional in (("lines", LINES), ("records", RECORDS)):
        if relation in held:
            frame = held[relation]
            held[relation] = frame.select("*", *(F.expr(x).alias(c) for c, x in optional.items() if c not in frame.columns))
    if "documents" not in held and "lines" in held:
        held["documents"] = held["lines"].select("doc_id", F.lit(None).cast("string").alias("lang")).distinct()
    views = {relation: f"{relation}_{uuid.uuid4().hex}" for relation in held}
    for relation, view in views.items():
        held[relation].createOrReplaceTempView(view)
    try:
        return first.sparkSession.sql(PLANS[name](Spark(given=views)))  # the views are resolved here
    finally:
        for view in views.values():
            first.sparkSession.catalog.dropTempView(view)
