"""The audit log: one JSON document for each file, its keys in a fixed order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.operators.alias import numbered

#: Entries of a piece of a log.
ENTRIES = 50
#: Sections of a log, in their order.
HEAD, CHANGES, MIDDLE, ERRORS, TAIL = range(5)


def audit_parts(files: DataFrame, done: DataFrame, operator: str, timestamp: Column) -> DataFrame:
    """file, section, part, text: a file's texts, joined in the order of section and part, are its log.

    files: file, source_path, output_file, file_hash; done: changes and errors with file and ord. A log may be larger
    than a task's memory, so its entries are numbered by distributed ranks and gathered by so many at a time.
    """
    failed = F.col("error").isNotNull()
    text = F.when(failed, F.to_json(F.struct("site_id", "error", timestamp.alias("timestamp")))).otherwise(F.to_json(F.struct("site_id", "location", "original", "redacted", "action")))
    entries = done.join(files.select("file"), "file", "left_semi")
    entries = entries.select(F.col("file").alias("group"), text.alias("value"), F.when(failed, ERRORS).otherwise(CHANGES).alias("prefix"), F.col("ord").cast("bigint").alias("ord"))
    pieces = numbered(entries).withColumn("part", F.floor((F.col("nth") - 1) / ENTRIES)).groupBy(F.col("group").alias("file"), F.col("prefix").alias("section"), "part")
    own = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("nth", "value"))), lambda x: x["value"]), ",")
    pieces = pieces.agg(own.alias("text")).withColumn("text", F.when(F.col("part") > 0, F.concat(F.lit(","), "text")).otherwise(F.col("text")))
    counts = done.groupBy("file").agg(F.count_if(~failed).alias("total_changes"), F.count_if(failed).alias("total_errors"))
    top = F.struct(
        F.regexp_extract("file", "([^/]*)$", 1).alias("file"), "source_path", "output_file", F.lit(operator).alias("operator"), timestamp.alias("timestamp"), "file_hash",
        F.coalesce("total_changes", F.lit(0)).alias("total_changes"), F.coalesce("total_errors", F.lit(0)).alias("total_errors"),
    )
    frame = F.array(*[F.struct(F.lit(k).alias("section"), t.alias("text")) for k, t in ((HEAD, F.concat(F.regexp_replace(F.to_json(top), r"\}$", ""), F.lit(',"changes":['))), (MIDDLE, F.lit('],"errors":[')), (TAIL, F.lit("]}")))])
    frames = files.join(counts, "file", "left").select("file", F.explode(frame).alias("x")).select("file", "x.section", F.lit(0).cast("bigint").alias("part"), "x.text")
    return frames.unionByName(pieces)


def location_json(place: Column) -> Column:
    """A location as JSON without its empty fields."""
    return F.to_json(place)
