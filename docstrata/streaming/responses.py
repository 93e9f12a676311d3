"""Responses as a stream: an extension, the reference replays files in batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from docstrata.sources.files import RESPONSE


def response_stream(spark: SparkSession, path: str) -> DataFrame:
    """Every response that changes what is known of a request, as files arrive: the last one wins.

    Written in update mode. Later is what stands in a file of a later time, or else of a greater
    name; the state holds one time a request.
    """
    rows = spark.readStream.schema(RESPONSE).json(path).where("request_id IS NOT NULL")
    ordered = rows.selectExpr("*", "_metadata.file_modification_time AS seen_at", "_metadata.file_path AS place")

    def last(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = pd.concat(list(batches)).sort_values(["seen_at", "place"], kind="stable").iloc[-1:]
        known = state.get if state.exists else None
        newest = held["seen_at"].iloc[0]
        if known is None or pd.Timestamp(known[0]) <= newest:
            state.update((newest.isoformat(),))
            yield held[[c.split()[0] for c in RESPONSE.split(", ")]]

    return ordered.groupBy("request_id").applyInPandasWithState(last, RESPONSE, "seen_at string", "update", GroupStateTimeout.NoTimeout)
