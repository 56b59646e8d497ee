"""Sheet classification: density and type mix of a sample decide whether a sheet is a table or a form.

Input are ``cells`` (file, sheet_idx, sheet, row, col, kind, num, text; empty cells have no row) and ``sheets`` (file,
sheet_idx, sheet, visible, first_row, first_col, end_row, end_col). All aggregates are by sheet and map-side combined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE_ROWS = 100
DENSE, MIXED = 0.46, 0.35
SHEET = ["file", "sheet_idx", "sheet"]
NUMERIC_TEXT = (r"^-?[0-9]+(\.[0-9]+)?%$", r"^-?[0-9]{1,3}(,[0-9]{3})+(\.[0-9]+)?$", r"^-?[0-9]+(\.[0-9]+)?$")


def is_numeric_text(text: Column) -> Column:
    """A percentage, a number with thousands separators, or a plain number."""
    x = F.trim(text)
    return x.rlike("|".join(f"(?:{p})" for p in NUMERIC_TEXT))


def is_numeric(kind: Column, text: Column) -> Column:
    return kind.isin("int", "float") | ((kind == "string") & is_numeric_text(text))


def is_blank(kind: Column, text: Column) -> Column:
    return (kind == "error") | ((kind == "string") & (F.length(F.trim(text)) == 0))


def visible(sheets: DataFrame) -> DataFrame:
    return sheets.filter("visible")


def sample(cells: DataFrame, sheets: DataFrame) -> DataFrame:
    """Cells of each visible sheet's first rows, with the sheet's extent."""
    extent = visible(sheets).select(*SHEET, "first_row", "first_col", "end_row", "end_col")
    return cells.join(extent, SHEET).filter((F.col("row") >= F.col("first_row")) & (F.col("row") < F.col("first_row") + SAMPLE_ROWS))


def density(cells: DataFrame, sheets: DataFrame) -> DataFrame:
    """Per visible sheet: sampled rows, columns, data cells, density, texts in the sample's first column's corners."""
    extent = visible(sheets).select(*SHEET, "first_row", "first_col", "end_row", "end_col")
    rows = F.least(F.col("end_row") - F.col("first_row") + 1, F.lit(SAMPLE_ROWS))
    corner = F.when((F.col("col") == F.col("first_col")), F.struct("row", "text"))
    found = sample(cells, sheets).groupBy(*SHEET).agg(
        F.count_if(~is_blank(F.col("kind"), F.col("text"))).alias("data_cells"),
        F.max(F.when(F.col("row") == F.col("first_row"), corner["text"])).alias("first_text"),
        F.max(F.when(F.col("row") == F.least("end_row", F.col("first_row") + SAMPLE_ROWS - 1), corner["text"])).alias("last_text"),
    )
    out = extent.join(found, SHEET, "left").withColumn("n_rows", rows).withColumn("n_cols", F.col("end_col") - F.col("first_col") + 1)
    return out.select(*SHEET, "n_rows", "n_cols", F.coalesce("data_cells", F.lit(0)).alias("data_cells"), "first_text", "last_text", F.coalesce(F.try_divide(F.col("data_cells").cast("double"), F.col("n_rows") * F.col("n_cols")), F.lit(0.0)).alias("density"))


def column_types(cells: DataFrame, sheets: DataFrame) -> DataFrame:
    """Per sheet and column of its range: how many cells have numbers and texts; columns without any are kept."""
    spine = visible(sheets).filter("end_col >= first_col").select(*SHEET, F.explode(F.sequence("first_col", "end_col")).alias("col"))
    used = sample(cells, sheets).filter(~is_blank(F.col("kind"), F.col("text")))
    found = used.groupBy(*SHEET, "col").agg(F.count_if(is_numeric(F.col("kind"), F.col("text"))).alias("numeric_count"), F.count("*").alias("total"))
    out = spine.join(found, [*SHEET, "col"], "left").select(*SHEET, "col", F.coalesce("numeric_count", F.lit(0)).alias("numeric_count"), F.coalesce("total", F.lit(0)).alias("total"))
    return out.withColumn("text_count", F.col("total") - F.col("numeric_count")).withColumn("numeric_ratio", F.coalesce(F.try_divide(F.col("numeric_count").cast("double"), F.col("total")), F.lit(0.0)))


def type_mix(types: DataFrame) -> DataFrame:
    """Per sheet the mean over its used columns of the entropy of numbers against texts, in bits."""
    p = F.col("numeric_ratio")
    part = lambda x: F.when(x > 0, -x * F.ln(x)).otherwise(0.0)
    entropy = (part(p) + part(1 - p)) / F.ln(F.lit(2.0))
    return types.groupBy(*SHEET).agg(F.coalesce(F.avg(F.when(F.col("total") > 0, entropy)), F.lit(0.0)).alias("type_mix"))


def sheet_type(density: Column, mix: Column) -> Column:
    return F.when(density == 0, "unknown").when(density > DENSE, "data").when(mix > MIXED, "data").otherwise("form")


def classify(cells: DataFrame, sheets: DataFrame) -> DataFrame:
    """Per visible sheet that has data: its type, density, type mix and the reason, in workbook order by sheet_idx."""
    found = density(cells, sheets).join(type_mix(column_types(cells, sheets)), SHEET, "left").withColumn("type_mix", F.coalesce("type_mix", F.lit(0.0)))
    found = found.filter("density > 0").withColumn("sheet_type", sheet_type(F.col("density"), F.col("type_mix")))
    return found.withColumn("reason", F.format_string("density: %.3f, data_type_mix: %.3f", "density", "type_mix"))


def with_fallback(sheets: DataFrame, classes: DataFrame) -> DataFrame:
    """Visible sheets with their type; those without a class are forms."""
    return visible(sheets).join(classes.select(*SHEET, "sheet_type"), SHEET, "left").withColumn("sheet_type", F.coalesce("sheet_type", F.lit("form")))
