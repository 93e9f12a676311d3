"""Operators whose next step depends on the last one, per document."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def select_disjoint_groups(groups: DataFrame) -> DataFrame:
    """Greedy choice of disjoint candidate groups in each body run.

    By confidence, then size, both falling, then position; a group is taken if it meets
    none taken before. A run belongs to one document, so a call sees few rows.
    """

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["confidence", "size", "start_i", "end_i"], ascending=[False, False, True, True], kind="stable")
        taken: list[tuple[int, int]] = []
        keep = []
        for lo, hi in zip(rows["start_i"], rows["end_i"], strict=True):
            free = all(hi <= a or lo >= b for a, b in taken)
            keep.append(free)
            if free:
                taken.append((lo, hi))
        return rows[keep].sort_values("start_i")

    return groups.groupBy("doc_id", "run").applyInPandas(choose, groups.schema)


def retyped_items(groups: DataFrame, lines: DataFrame, sure: float = 0.85) -> DataFrame:
    """(doc_id, pos, list_type, level, restart) of the lines (doc_id, run, i, pos) in sure groups (M2)."""
    chosen = groups.where(F.col("confidence") >= sure).withColumn("i", F.explode(F.sequence(F.col("start_i") + 1, F.col("end_i"))))
    unordered = (F.col("ordered") < 0.6) & (F.col("markers") >= 0.6)
    return chosen.join(lines.select("doc_id", "run", "i", "pos"), ["doc_id", "run", "i"]).select(
        "doc_id", "pos", F.when(unordered, "dash").otherwise("lower_letter_paren").alias("list_type"), F.lit(0).cast("long").alias("level"), (F.col("i") == F.col("start_i") + 1).alias("restart")
    )


def layout_levels(rows: DataFrame, gap: int = 120, deepest: int = 8) -> DataFrame:
    """(doc_id, run, left_twips, level): the indents that begin a new level (W10), by a fold over the sorted ones."""
    starts = F.aggregate(
        F.array_sort(F.collect_set("left_twips")),
        F.array().cast("array<int>"),
        lambda acc, x: F.when(F.size(acc) == 0, F.array(x)).when(x - F.element_at(acc, -1) >= gap, F.array_append(acc, x)).otherwise(acc),
    )
    return (
        rows.groupBy("doc_id", "run")
        .agg(starts.alias("starts"))
        .select("doc_id", "run", F.posexplode("starts").alias("level", "left_twips"))
        .select("doc_id", "run", "left_twips", F.least(F.col("level"), F.lit(deepest)).alias("level"))
    )


@F.pandas_udf(T.StringType())
def first_json_object(raw: pd.Series) -> pd.Series:
    """The first complete JSON object in a text, as it stands, else null (F25); braces in strings don't count."""
    decoder = json.JSONDecoder()

    def find(text: str | None) -> str | None:
        at = text.find("{") if text else -1
        if at < 0:
            return None
        try:
            _, end = decoder.raw_decode(text, at)
        except ValueError:
            return None
        return text[at:end]

    return raw.map(find)
