"""From classified sheets, decks and tables to sites: what was found, where, and what is to be done with it.

A site: site_id, location struct<type, sheet, cell, column, slide, shape_id, table_location>, original_value,
detected_type, discovered_by, enabled, action, params, and ord, which is its place in the order of the scan.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veilframe.functions.identity import coordinate
from veilframe.operators.classify import SHEET, visible
from veilframe.operators.detect import scan_text, value_in
from veilframe.operators.rules import COLUMNS, PATTERNS, ColumnRule, PatternRule, default_action, match_header

LOCATION = "struct<type:string,sheet:string,cell:string,column:string,slide:int,shape_id:string,table_location:string>"
NOTE_LENGTH = 20


def excel_place(sheet: Column, cell: Column, column: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(F.lit("excel").alias("type"), sheet.alias("sheet"), cell.alias("cell"), (column if column is not None else none).alias("column"), F.lit(None).cast("int").alias("slide"), none.alias("shape_id"), none.alias("table_location"))


def deck_place(slide: Column, shape: Column, table: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(F.lit("ppt").alias("type"), none.alias("sheet"), none.alias("cell"), none.alias("column"), slide.cast("int").alias("slide"), shape.alias("shape_id"), (table if table is not None else none).alias("table_location"))


def location_text(place: Column) -> Column:
    """What a location reads like; equal texts are one place."""
    excel = F.concat(F.lit("[Excel] "), F.coalesce(place["sheet"], F.lit("")), F.lit("!"), F.coalesce(place["cell"], F.lit("")))
    table = F.when(place["table_location"].isNotNull(), F.concat(F.lit(" "), place["table_location"])).otherwise(F.lit(""))
    deck = F.concat(F.lit("[PPT] "), F.coalesce(place["slide"].cast("string"), F.lit("")), F.lit(" "), F.coalesce(place["shape_id"], F.lit("")), table)
    return F.when(place["type"] == "excel", excel).otherwise(deck)


def is_valid(place: Column) -> Column:
    return F.when(place["type"] == "excel", place["sheet"].isNotNull() & place["cell"].isNotNull()).when(place["type"] == "ppt", place["slide"].isNotNull() & place["shape_id"].isNotNull()).otherwise(F.lit(False))


def rule_part(ord: Column, rules: tuple[ColumnRule, ...]) -> Column:
    """struct<action, params, detected_type> of a rule's position."""
    out = F.lit(None).cast("struct<action:string,params:string,detected_type:string>")
    for i, r in enumerate(rules):
        text = json.dumps(r.params, ensure_ascii=False) if r.params else None
        out = F.when(ord == i, F.struct(F.lit(r.action).alias("action"), F.lit(text).cast("string").alias("params"), F.lit(r.detected_type).alias("detected_type"))).otherwise(out)
    return out


def found_in(df: DataFrame, text: str, rules: tuple[PatternRule, ...] = PATTERNS) -> DataFrame:
    """df with a row for each find in a text column: start, original_value, detected_type, action, params."""
    hit = df.withColumn("_hit", F.explode(scan_text(F.col(text), rules)))
    choice = default_action(F.col("_hit.detected_type"))
    return hit.select(*df.columns, F.col("_hit.ord").alias("rule_ord"), F.col("_hit.start").alias("start"), F.col("_hit.value").alias("original_value"), F.col("_hit.detected_type").alias("detected_type"), F.lit("fulltext_scan").alias("discovered_by"), choice["action"].alias("action"), choice["params"].alias("params"))


CELL = ["file", "sheet_idx", "sheet", "row", "col", "text"]
SITE = ["file", "sheet_idx", "sheet", "row", "col", "rule_ord", "start", "site_id", "location", "original_value", "detected_type", "discovered_by", "action", "params"]


def cell_sites(hits: DataFrame, column: Column | None = None) -> DataFrame:
    cell = coordinate("row", "col")
    return hits.withColumn("site_id", F.concat_ws("_", F.lit("sheet"), "sheet", cell)).withColumn("location", excel_place(F.col("sheet"), cell, column)).select(*SITE)


def sheet_rules(names: DataFrame, rules: tuple[ColumnRule, ...] = COLUMNS) -> DataFrame:
    """Exact rules for the matched columns of data sheets: sheet keys, col, name, rule_ord, action, params, detected_type."""
    hit = names.withColumn("rule_ord", match_header(F.col("name"), rules)).filter("rule_ord is not null")
    return hit.withColumn("_r", rule_part(F.col("rule_ord"), rules)).select(*SHEET, "col", F.trim("name").alias("name"), "rule_ord", "_r.action", "_r.params", "_r.detected_type")


def form_parts(cells: DataFrame, columns: tuple[ColumnRule, ...] = COLUMNS) -> tuple[DataFrame, DataFrame]:
    """Sites by the header of a form, and the cells whose text is to be scanned.

    The first header in the first five rows fixes one column, whose later cells follow its rule.
    """
    own = cells.filter(F.length(F.trim("text")) > 0).withColumn("text", F.trim("text"))
    heads = own.filter("row < 5").withColumn("rule", match_header(F.col("text"), columns)).filter("rule is not null")
    head = heads.groupBy(*SHEET).agg(F.min(F.struct("row", "col", "rule", "text")).alias("head"))
    joined = own.join(head, SHEET, "left")
    below = F.coalesce((F.col("col") == F.col("head.col")) & (F.col("row") > F.col("head.row")), F.lit(False))
    is_head = F.coalesce((F.col("col") == F.col("head.col")) & (F.col("row") == F.col("head.row")), F.lit(False))
    ruled = joined.filter(below).withColumn("_r", rule_part(F.col("head.rule"), columns))
    ruled = ruled.withColumn("rule_ord", F.col("head.rule")).withColumn("start", F.lit(0)).withColumn("original_value", F.col("text")).withColumn("detected_type", F.col("_r.detected_type")).withColumn("discovered_by", F.lit("column_rule")).withColumn("action", F.col("_r.action")).withColumn("params", F.col("_r.params")).withColumn("column_name", F.col("head.text"))
    return cell_sites(ruled, F.col("column_name")), joined.filter(~below & ~is_head).select(*CELL)


def scan_form(cells: DataFrame, columns: tuple[ColumnRule, ...] = COLUMNS, patterns: tuple[PatternRule, ...] = PATTERNS) -> DataFrame:
    """Sites of forms."""
    ruled, free = form_parts(cells, columns)
    return ruled.unionByName(cell_sites(found_in(free, "text", patterns)))


def extra_cells(cells: DataFrame, spans: DataFrame) -> DataFrame:
    """Cells of data sheets outside their columns: all above the header, and lone texts of the first column below it."""
    joined = cells.join(spans, SHEET)
    above = joined.filter("row < header_start")
    beside = cells.filter("col = 1").select(*SHEET, "row")
    lone = joined.filter("row > header_end and col = 0").join(beside, [*SHEET, "row"], "left_anti")
    return above.unionByName(lone).filter(F.length(F.trim("text")) > 0).select(*CELL)


def scan_extra(cells: DataFrame, spans: DataFrame, patterns: tuple[PatternRule, ...] = PATTERNS) -> DataFrame:
    """Sites of data sheets outside their columns."""
    return cell_sites(found_in(extra_cells(cells, spans), "text", patterns))


def scan_workbook(cells: DataFrame, sheets: DataFrame, spans: DataFrame, names: DataFrame, columns: tuple[ColumnRule, ...] = COLUMNS, patterns: tuple[PatternRule, ...] = PATTERNS) -> DataFrame:
    """Sites of all sheets (with sheet_type): data sheets that have ruled columns by scan_extra, all others as forms."""
    ruled = sheet_rules(names.join(sheets.filter("sheet_type = 'data'").select(*SHEET), SHEET, "left_semi"), columns).select(*SHEET).distinct()
    data = cells.join(ruled, SHEET, "left_semi")
    forms = cells.join(sheets.select(*SHEET), SHEET, "left_semi").join(ruled, SHEET, "left_anti")
    by_header, free = form_parts(forms, columns)
    # One scan of all texts, so that the rules are in the plan once.
    return by_header.unionByName(cell_sites(found_in(free.unionByName(extra_cells(data, spans)), "text", patterns)))


DECK_SITE = ["file", "slide", "part_ord", "shape_ord", "para_idx", "row", "col", "rule_ord", "start", "site_id", "location", "original_value", "detected_type", "discovered_by", "action", "params"]


DECK_TEXT = ["file", "slide", "part_ord", "shape_ord", "para_idx", "row", "col", "site_id", "location", "text"]


def deck_sites(hits: DataFrame) -> DataFrame:
    return hits.select(*DECK_SITE)


def by_rule(rows: DataFrame, columns: tuple[ColumnRule, ...], value) -> DataFrame:
    """Sites of rows with a rule; value(detected_type) is what is found."""
    out = rows.filter("rule is not null").withColumn("_r", rule_part(F.col("rule"), columns)).withColumn("detected_type", F.col("_r.detected_type"))
    out = out.withColumn("original_value", value(F.col("detected_type"))).withColumn("rule_ord", F.col("rule")).withColumn("start", F.lit(0)).withColumn("discovered_by", F.lit("column_rule"))
    return deck_sites(out.withColumn("action", F.col("_r.action")).withColumn("params", F.col("_r.params")))


def table_parts(cells: DataFrame, columns: tuple[ColumnRule, ...] = COLUMNS) -> tuple[DataFrame, DataFrame]:
    """Sites by the header of deck tables (their first row), and the cells whose text is to be scanned."""
    keys = ["file", "slide", "shape_ord"]
    own = cells.filter(F.length(F.trim("text")) > 0)
    heads = own.filter("row = 0").withColumn("rule", match_header(F.col("text"), columns)).filter("rule is not null").select(*keys, "col", "rule")
    place = F.format_string("R%dC%d", F.col("row") + 1, F.col("col") + 1)
    body = own.filter("row > 0").join(heads, [*keys, "col"], "left").withColumn("site_id", F.concat_ws("_", F.lit("slide"), F.col("slide").cast("string"), "shape_id", place))
    body = body.withColumn("location", deck_place(F.col("slide"), F.col("shape_name"), place)).withColumn("part_ord", F.lit(0)).withColumn("para_idx", F.lit(0))
    return by_rule(body, columns, lambda kind: F.trim("text")), body.filter("rule is null").select(*DECK_TEXT)


def scan_table(cells: DataFrame, columns: tuple[ColumnRule, ...] = COLUMNS, patterns: tuple[PatternRule, ...] = PATTERNS) -> DataFrame:
    """Sites of deck tables (file, slide, shape_ord, shape_id, shape_name, row, col, text)."""
    ruled, free = table_parts(cells, columns)
    return ruled.unionByName(deck_sites(found_in(free, "text", patterns)))


def scan_deck(texts: DataFrame, columns: tuple[ColumnRule, ...] = COLUMNS, patterns: tuple[PatternRule, ...] = PATTERNS) -> DataFrame:
    """Sites of ppt_text rows: text boxes in full, tables by header, short notes by a header rule or else in full."""
    boxes = texts.filter("part = 'textbox'").withColumn("site_id", F.concat_ws("_", F.lit("slide"), F.col("slide").cast("string"), "shape_id")).withColumn("location", deck_place(F.col("slide"), F.col("shape_name"))).withColumn("part_ord", F.lit(0))
    ruled_cells, free_cells = table_parts(texts.filter("part = 'table'"), columns)
    notes = texts.filter("part = 'notes'").withColumn("rule", F.when(F.length(F.trim("text")) <= NOTE_LENGTH, match_header(F.col("text"), columns)))
    notes = notes.withColumn("site_id", F.concat(F.lit("notes_"), F.col("slide").cast("string"))).withColumn("location", deck_place(F.col("slide"), F.lit("notes"))).withColumn("part_ord", F.lit(1))

    def value(kind: Column) -> Column:
        out = F.col("text")
        for k in ("amount", "entity", "person", "account"):
            out = F.when(kind == k, value_in(F.trim("text"), k)).otherwise(out)
        return out

    free = boxes.select(*DECK_TEXT).unionByName(free_cells).unionByName(notes.filter("rule is null").select(*DECK_TEXT))
    return ruled_cells.unionByName(by_rule(notes, columns, value)).unionByName(deck_sites(found_in(free, "text", patterns)))


def dedup_sites(sites: DataFrame, keys: list[str], ord: str = "ord") -> DataFrame:
    """One site for each key: the first, but a later rule's find of another type takes its place (and its position)."""
    fields = [c for c in sites.columns if c not in keys]
    grouped = sites.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col(ord).alias("_at"), *fields))).alias("own"))
    start = F.struct(F.element_at("own", 1).alias("cur"))

    def step(acc: Column, x: Column) -> Column:
        better = (x["detected_type"] != acc["cur"]["detected_type"]) & (x["discovered_by"] == "column_rule")
        return F.struct(F.when(better, x).otherwise(acc["cur"]).alias("cur"))

    kept = F.aggregate(F.slice("own", F.lit(2), F.size("own")), start, step, lambda acc: acc["cur"])
    out = grouped.select(*keys, F.element_at("own", 1)["_at"].alias("first_ord"), kept.alias("x"))
    return out.select(*keys, *[(F.col("first_ord") if c == ord else F.col(f"x.{c}")).alias(c) for c in fields])


def dedup_rules(rules: DataFrame, ord: str = "ord") -> DataFrame:
    """The first rule of each pattern."""
    nth = F.row_number().over(Window.partitionBy("pattern").orderBy(ord))
    return rules.withColumn("_n", nth).filter("_n = 1").drop("_n")


def mark_places(cells: DataFrame, sheets: DataFrame) -> DataFrame:
    """Per visible sheet the first cell of its first ten rows that isn't blank."""
    able = cells.filter("row < 10").filter(F.length(F.trim("text")) > 0).join(visible(sheets).select(*SHEET), SHEET)
    best = able.groupBy(*SHEET).agg(F.min(F.struct("row", "col", "text")).alias("x"))
    return best.select(*SHEET, "x.row", "x.col", "x.text")
