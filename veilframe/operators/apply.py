"""Executing a strategy: column rules, then sites, to changes, errors and counts. Nothing is written here."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veilframe.functions.identity import coordinate
from veilframe.operators.classify import SHEET
from veilframe.operators.dispatch import numeric_write_back, redact
from veilframe.operators.scan import LOCATION, excel_place

CHANGE = ["file", "ord", "site_id", "location", "original", "redacted", "new_text", "action", "error"]


def of_column_rules(cells: DataFrame, names: DataFrame, spans: DataFrame, rules: DataFrame) -> DataFrame:
    """Requests for the cells below the header of columns whose name a rule (ord, pattern, action, params) has."""
    columns = names.join(F.broadcast(rules.select(F.col("pattern").alias("name"), F.col("ord").alias("rule_ord"), "action", "params")), "name")
    body = cells.join(spans, SHEET).filter("row > header_end").join(columns, [*SHEET, "col"]).filter(F.length(F.trim("text")) > 0)
    cell = coordinate("row", "col")
    return body.select("file", "sheet", cell.alias("cell"), F.struct(F.lit(0).alias("phase"), F.col("sheet_idx").alias("a"), F.col("rule_ord").cast("bigint").alias("b"), F.col("row").cast("bigint").alias("c")).alias("at"), F.concat_ws("_", "sheet", cell).alias("site_id"), excel_place(F.col("sheet"), cell, F.col("name")).cast(LOCATION).alias("location"), F.col("text").alias("original"), "action", "params", F.col("text").alias("cell_text"))


def of_sites(cells: DataFrame, sites: DataFrame, written: DataFrame) -> DataFrame:
    """Requests for enabled sheet sites, one for each cell (the first), where no column rule has written."""
    able = sites.filter("enabled and location.type = 'excel'").withColumn("sheet", F.col("location.sheet")).withColumn("cell", F.col("location.cell"))
    nth = F.row_number().over(Window.partitionBy("file", "sheet", "cell").orderBy("ord"))
    first = able.join(written, ["file", "sheet", "cell"], "left_anti").withColumn("_n", nth).filter("_n = 1").drop("_n")
    texts = cells.select("file", "sheet", coordinate("row", "col").alias("cell"), F.col("text").alias("cell_text"))
    return first.join(texts, ["file", "sheet", "cell"]).select("file", "sheet", "cell", F.struct(F.lit(1).alias("phase"), F.lit(0).alias("a"), F.lit(0).cast("bigint").alias("b"), F.col("ord").cast("bigint").alias("c")).alias("at"), "site_id", F.col("location").cast(LOCATION).alias("location"), F.col("original_value").alias("original"), "action", "params", "cell_text")


def of_deck_sites(texts: DataFrame, sites: DataFrame) -> DataFrame:
    """Requests for enabled deck sites whose text is still there."""
    able = sites.filter("enabled and location.type = 'ppt'").withColumn("slide", F.col("location.slide"))
    current = texts.withColumn("table_location", F.when(F.col("part") == "table", F.format_string("R%dC%d", F.col("row") + 1, F.col("col") + 1)))
    current = current.withColumn("shape", F.when(F.col("part") == "notes", F.lit("notes")).otherwise(F.col("shape_name"))).groupBy("file", "slide", "shape", "table_location").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("shape_ord", "para_idx", "text"))), lambda x: x["text"]), "\n").alias("cell_text"))
    hit = able.join(current.select(*[F.col(c).alias(f"_{c}") for c in current.columns]), (F.col("file") == F.col("_file")) & (F.col("slide") == F.col("_slide")) & (F.col("location.shape_id") == F.col("_shape")) & F.col("location.table_location").eqNullSafe(F.col("_table_location")))
    return hit.filter(F.contains(F.col("_cell_text"), F.col("original_value"))).select("file", F.lit(None).cast("string").alias("sheet"), F.lit(None).cast("string").alias("cell"), F.struct(F.lit(1).alias("phase"), F.lit(0).alias("a"), F.lit(0).cast("bigint").alias("b"), F.col("ord").cast("bigint").alias("c")).alias("at"), "site_id", F.col("location").cast(LOCATION).alias("location"), F.col("original_value").alias("original"), "action", "params", F.col("_cell_text").alias("cell_text"))


def changes(requests: DataFrame) -> DataFrame:
    """Each request's outcome: redacted and the cell's new text, or an error. Aliases are numbered file by file; ord orders a file's requests as they are executed."""
    # A request's place in its file packed into one number, which orders aliases by sheet, rule and row, then sites.
    at = F.shiftleft(F.col("at.phase").cast("bigint"), 60) + F.shiftleft(F.col("at.a").cast("bigint"), 48) + F.shiftleft(F.col("at.b"), 36) + F.col("at.c")
    done = redact(requests.withColumn("ord", at), "original", "action", "params", "ord", "file")
    value = numeric_write_back(F.col("action"), F.col("redacted"))
    whole = F.col("original") == F.col("cell_text")
    new_text = F.when(whole, value).otherwise(F.replace(F.col("cell_text"), F.col("original"), value))
    return done.withColumn("new_text", F.when(F.length("original") > 0, new_text).otherwise(F.col("cell_text"))).select(*CHANGE, "sheet", "cell")


def report(sites: DataFrame, done: DataFrame) -> DataFrame:
    """Per file: processed, errors, and enabled sites that were skipped."""
    counts = done.groupBy("file").agg(F.count_if(F.col("error").isNull()).alias("processed"), F.count_if(F.col("error").isNotNull()).alias("errors"))
    asked = sites.filter("enabled").groupBy("file").agg(F.count("*").alias("asked"))
    used = done.join(sites.select("file", "site_id", "ord").withColumnRenamed("ord", "_o").distinct(), ["file", "site_id"], "left_semi").groupBy("file").agg(F.count("*").alias("used"))
    out = counts.join(asked, "file", "full").join(used, "file", "left")
    return out.select("file", F.coalesce("processed", F.lit(0)).alias("processed"), F.greatest(F.coalesce("asked", F.lit(0)) - F.coalesce("used", F.lit(0)), F.lit(0)).alias("skipped"), F.coalesce("errors", F.lit(0)).alias("errors"))


def redact_table(df: DataFrame, ord: str, columns: dict[str, tuple[str, str | None]]) -> DataFrame:
    """A plain table with columns masked: column to (action, params JSON)."""
    out = df
    for name, (action, params) in columns.items():
        step = out.withColumn("_value", F.col(name).cast("string")).withColumn("_action", F.lit(action)).withColumn("_params", F.lit(params).cast("string"))
        step = redact(step, "_value", "_action", "_params", ord)
        out = step.withColumn(name, F.coalesce("redacted", "_value")).drop("_value", "_action", "_params", "redacted", "error")
    return out
