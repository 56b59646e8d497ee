"""Structured Streaming forms of the operators. The table forms are what they are held against."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

from veilframe.operators.detect import scan_text
from veilframe.operators.dispatch import masked
from veilframe.operators.rules import default_action


def scan_stream(stream: DataFrame, text: str) -> DataFrame:
    """A row for each find in a stream's text column, with its default masking; aliases come from ``alias_stream``."""
    hit = stream.withColumn("_hit", F.explode(scan_text(F.col(text))))
    choice = default_action(F.col("_hit.detected_type"))
    out = hit.select(*stream.columns, F.col("_hit.detected_type").alias("detected_type"), F.col("_hit.value").alias("original_value"), choice["action"].alias("action"), choice["params"].alias("params"))
    return out.withColumn("redacted", masked(F.col("original_value"), F.col("action"), F.col("params"))["value"])


def letters(n: int) -> str:
    out = ""
    while n > 0:
        n, digit = divmod(n - 1, 26)
        out = chr(65 + digit) + out
    return out


def alias_stream(stream: DataFrame, value: str, prefix: str, event_time: str) -> DataFrame:
    """value, prefix, alias for each value's first occurrence in a stream, numbered by prefix in order of arrival.

    The state of a prefix is its values so far, as the table form keeps them too; prefixes are dealt among tasks.
    """

    def number(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = dict(zip(*state.get, strict=True)) if state.exists else {}
        for batch in batches:
            new = []
            for v in batch.sort_values(["t", "value"], kind="stable")["value"]:
                if v and v not in known:
                    known[v] = len(known) + 1
                    new.append((v, key[0], f"[{key[0]}{letters(known[v])}]"))
            if new:
                yield pd.DataFrame(new, columns=["value", "prefix", "alias"])
        state.update((list(known), list(known.values())))

    rows = stream.select(F.col(value).cast("string").alias("value"), F.col(prefix).alias("prefix"), F.col(event_time).alias("t"))
    return rows.groupBy("prefix").applyInPandasWithState(number, "value string, prefix string, alias string", "values array<string>, numbers array<int>", "append", "NoTimeout")


def type_counts(stream: DataFrame, text: str, event_time: str, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Finds by type in tumbling windows of event time; rows later than allowed are left out."""
    hits = stream.withWatermark(event_time, late).select(event_time, F.explode(scan_text(F.col(text))).alias("hit"))
    return hits.groupBy(F.window(event_time, window), F.col("hit.detected_type").alias("detected_type")).agg(F.count("*").alias("n"))
