"""Header search: rows of a sheet are scored, the best one is extended up and down, and columns get their names.

Works on rows ``(sheet keys, row, values array<string>)`` where values are the texts of the row's cells in column
order, on a dense spine of rows. A sheet's first ``SEARCH_ROWS`` rows are all that is looked at, so the arrays that a
sheet's fold holds are bounded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veilframe.functions.amount import let
from veilframe.operators.classify import SHEET

SEARCH_ROWS, HEADER_ROWS = 20, 5
#: Rows of a sheet that the search for its header looks at.
HEAD = SEARCH_ROWS + HEADER_ROWS + 1
HAN = r"[^\x{4E00}-\x{9FFF}]"
# What a note's first text begins with.
NOTES = ("注释", "Notes", "Description", "注释：")


def share(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole), F.lit(0.0))


def han_length(text: Column) -> Column:
    return F.length(F.regexp_replace(text, HAN, ""))


def is_number_like(text: Column) -> Column:
    return text.rlike(r"^-?[0-9]+(\.[0-9]+)?\n?\z") & (F.length(F.translate(text, "-.", "")) <= 15)


def count(values: Column, test) -> Column:
    return F.size(F.filter(values, test))


def not_blank(values: Column) -> Column:
    return F.filter(F.transform(values, lambda v: F.trim(v)), lambda v: v != "")


def is_annotation(values: Column) -> Column:
    """A note: it begins with a note's word, or at least half of its texts are short and not Chinese."""
    return let(not_blank(values), annotation_of)


def annotation_of(own: Column) -> Column:
    first = F.try_element_at(own, F.lit(1))
    begins = F.lit(False)
    for word in NOTES:
        begins = begins | F.startswith(first, F.lit(word))
    short = count(own, lambda v: (han_length(v) == 0) & (F.length(v) < 5))
    return F.when(F.size(own) == 0, F.lit(False)).otherwise(begins | (share(short, F.size(own)) >= 0.5))


def is_data(values: Column) -> Column:
    """A row of data, by five tests in order; the first that says so decides."""
    joined = F.array_join(values, "")
    row = F.struct(values.alias("values"), F.size(values).alias("n"), han_length(joined).alias("han"), F.length(joined).alias("length"), count(values, is_number_like).alias("numbers"), F.size(F.array_distinct(values)).alias("different"))
    return let(row, data_of)


def data_of(row: Column) -> Column:
    values, n, han, numbers = row["values"], row["n"], row["han"], row["numbers"]
    han_share, unique, lengths = share(han, row["length"]), share(row["different"], n), share(row["length"], n)
    first = F.try_element_at(values, F.lit(1))
    codes = count(values, lambda v: v.rlike(r"^[A-Za-z0-9]+\n?\z") & ~is_number_like(v))
    return (
        F.when(n == 0, F.lit(False))
        .when(share(numbers, n) > 0.6, F.lit(True))
        .when(unique < 0.4, ~((han_share > 0.5) & (n > 10)))
        .when((n >= 3) & is_number_like(first) & F.length(first).between(1, 8), F.lit(True))
        .when((numbers > 0) & (han > 0) & (n >= 3), F.lit(True))
        .otherwise((n >= 3) & (han_share > 0) & (lengths < 15) & (unique > 0.8) & (codes > 0))
    )


def class_entropy(text: Column) -> Column:
    """Entropy of Chinese, Latin, numeric and other characters, from 0 to 1."""
    return let(text, entropy_of)


def entropy_of(text: Column) -> Column:
    total = F.length(text)
    parts = [han_length(text), F.length(F.regexp_replace(text, "[^A-Za-z]", "")), F.length(F.regexp_replace(text, r"[^\p{N}]", ""))]
    parts.append(total - parts[0] - parts[1] - parts[2])
    out = F.lit(0.0)
    for n in parts:
        p = share(n, total)
        out = out + F.when(p > 0, -p * F.ln(p)).otherwise(0.0)
    return out / F.ln(F.lit(4.0))


def scores(values: Column, following: Column) -> dict[str, Column]:
    """The parts of a row's score, by name; following: the next row's values."""
    own, n, joined = values, F.size(values), F.array_join(values, "")
    nxt = F.coalesce(following, F.array().cast("array<string>"))
    all_han = F.forall(own, lambda v: v.rlike(r"^[\x{4E00}-\x{9FFF}\s/%()（）]+$"))
    unique = share(F.size(F.array_distinct(own)), n)
    words = (1 - share(count(own, is_number_like), n)) * 1.5
    han = share(han_length(joined), F.length(joined)) * 2.0
    entropy = class_entropy(joined) * 2.0
    numbers_follow = F.when(share(count(nxt, is_number_like), F.size(nxt)) > 0.5, 1.0).otherwise(0.0)
    total = unique + words + han + entropy + numbers_follow + F.when(n >= 5, 0.5).otherwise(0.0) + F.when(n >= 10, 0.5).otherwise(0.0)
    total = total * F.when(n <= 2, 0.5).otherwise(1.0) + F.when(all_han & (share(F.length(joined), n) <= 10), 1.0).otherwise(0.0)
    return {"uniqueness": unique, "non_numeric": words, "chinese": han, "entropy": entropy, "next_numeric": numbers_follow, "score": F.when(n > 0, total).otherwise(0.0)}


def row_values(cells: DataFrame, sheets: DataFrame, rows: int | None = HEAD) -> DataFrame:
    """Per sheet and row (of its head, or all if rows is None): the texts of its cells by column, and the sheet's columns; rows without cells too."""
    last = F.col("end_row") if rows is None else F.least("end_row", F.lit(rows - 1))
    spine = sheets.filter("end_row >= 0").select(*SHEET, (F.col("end_col") + 1).alias("n_cols"), F.explode(F.sequence(F.lit(0), last)).alias("row"))
    found = (cells if rows is None else cells.filter(F.col("row") < rows)).groupBy(*SHEET, "row").agg(F.sort_array(F.collect_list(F.struct("col", "text"))).alias("own"))
    values = F.transform(F.coalesce("own", F.array().cast("array<struct<col:int,text:string>>")), lambda x: x["text"])
    return spine.join(found, [*SHEET, "row"], "left").select(*SHEET, "row", "n_cols", values.alias("values"))


def row_scores(rows: DataFrame) -> DataFrame:
    """rows with the parts of their score, is_data, is_annotation and the number of texts that aren't blank."""
    order = Window.partitionBy(*SHEET).orderBy("row")
    out = rows.withColumn("following", F.lead("values").over(order))
    parts = scores(F.col("values"), F.col("following"))
    out = out.select(*SHEET, "row", "n_cols", "values", *[c.alias(n) for n, c in parts.items()], is_data(F.col("values")).alias("is_data"), is_annotation(F.col("values")).alias("is_annotation"), F.size(not_blank(F.col("values"))).alias("n_texts"))
    return out


def best_rows(scored: DataFrame) -> DataFrame:
    """Per sheet its best header row: the highest score, then most texts, then the first; notes don't count."""
    able = scored.filter((F.col("row") < SEARCH_ROWS) & (F.col("score") > 0) & ~F.col("is_annotation"))
    best = F.max_by(F.struct("row", "score", "n_texts"), F.struct("score", "n_texts", -F.col("row")))
    return able.groupBy(*SHEET).agg(best.alias("best")).select(*SHEET, F.col("best.row").alias("best_row"), F.col("best.score").alias("score"), F.col("best.n_texts").alias("n_texts"))


def header_spans(scored: DataFrame) -> DataFrame:
    """Per sheet header_start and header_end: the best row extended up, then down from the new start."""
    own = F.struct("row", "n_texts", F.size("values").alias("n_cells"), "n_cols", "is_data")
    grouped = scored.groupBy(*SHEET).agg(F.sort_array(F.collect_list(own)).alias("rows")).join(best_rows(scored), SHEET)
    rows, best, most = F.col("rows"), F.col("best_row"), F.col("n_texts")
    at = lambda i: F.try_element_at(rows, (i + 1).cast("int"))
    start = F.struct(best.alias("at"), F.lit(False).alias("stop"))

    def up(acc: Column, k: Column) -> Column:
        r = at(best - k)
        good = (best - k >= 0) & (r["n_cells"] > 0) & ~r["is_data"] & (r["n_texts"] >= F.greatest(F.lit(3.0), most * 0.3))
        ok = ~acc["stop"] & F.coalesce(good, F.lit(False))
        return F.struct(F.when(ok, best - k).otherwise(acc["at"]).alias("at"), (~ok).alias("stop"))

    first = F.aggregate(F.sequence(F.lit(1), F.lit(HEADER_ROWS - 1)), start, up, lambda acc: acc["at"])
    out = grouped.withColumn("header_start", first)
    top = F.col("header_start")
    begin = F.struct(top.alias("at"), F.lit(False).alias("stop"))

    def down(acc: Column, k: Column) -> Column:
        r = at(top + k)
        sparse = ((r["n_cols"] - r["n_texts"]) / r["n_cols"] > 0.8) & (r["n_texts"] < 5)
        ok = ~acc["stop"] & F.coalesce(~sparse & ~r["is_data"], F.lit(False))
        return F.struct(F.when(ok, top + k).otherwise(acc["at"]).alias("at"), (~ok).alias("stop"))

    last = F.aggregate(F.sequence(F.lit(1), F.lit(HEADER_ROWS - 1)), begin, down, lambda acc: acc["at"])
    return out.select(*SHEET, "header_start", last.alias("header_end"))


def merged_lookup(cells: DataFrame, places: DataFrame, merges: DataFrame) -> DataFrame:
    """places (sheet keys, row, col) with text: the cell's own, else that of the first merged range over it.

    Merged ranges are few for a sheet, so they are joined by sheet and compared there.
    """
    own = cells.select(*SHEET, "row", "col", "text")
    found = places.join(own, [*SHEET, "row", "col"], "left")
    over = places.join(merges, SHEET).filter("row between r0 and r1 and col between c0 and c1")
    over = over.groupBy(*SHEET, "row", "col").agg(F.min(F.struct("rect_idx", "r0", "c0")).alias("m"))
    master = over.select(*SHEET, "row", "col", F.col("m.r0").alias("r0"), F.col("m.c0").alias("c0"))
    master = master.join(own.select(*SHEET, F.col("row").alias("r0"), F.col("col").alias("c0"), F.col("text").alias("master_text")), [*SHEET, "r0", "c0"]).select(*SHEET, "row", "col", "master_text")
    return found.join(master, [*SHEET, "row", "col"], "left").select(*SHEET, "row", "col", F.coalesce("text", "master_text").alias("text"))


def clean_name(text: Column) -> Column:
    return F.regexp_replace(F.trim(text), r"[\n\s/]+", "_")


def header_names(cells: DataFrame, spans: DataFrame, sheets: DataFrame, merges: DataFrame) -> DataFrame:
    """Per sheet and column: the texts of the header rows joined by an underscore."""
    spine = spans.join(sheets.select(*SHEET, "end_col"), SHEET).select(*SHEET, F.explode(F.sequence("header_start", "header_end")).alias("row"), "end_col")
    places = spine.select(*SHEET, "row", F.explode(F.sequence(F.lit(0), F.col("end_col"))).alias("col"))
    texts = merged_lookup(cells, places, merges)
    parts = F.filter(F.transform(F.sort_array(F.collect_list(F.struct("row", F.coalesce("text", F.lit("")).alias("text")))), lambda x: clean_name(x["text"])), lambda t: t != "")
    return texts.groupBy(*SHEET, "col").agg(F.array_join(parts, "_").alias("name"))


def unique_names(names: DataFrame) -> DataFrame:
    """Scan-time names: the k-th repetition of a name, blank ones too, gets the suffix _k."""
    nth = F.row_number().over(Window.partitionBy(*SHEET, "name").orderBy("col")) - 1
    return names.withColumn("nth", nth).select(*SHEET, "col", F.when(F.col("nth") == 0, F.col("name")).otherwise(F.concat("name", F.lit("_"), F.col("nth").cast("string"))).alias("name"))


def probed_names(names: DataFrame) -> DataFrame:
    """Execution-time names: blank ones are left out, a repeated one gets the first suffix from _1 that isn't in use."""
    grouped = names.filter(F.length(F.trim("name")) > 0).groupBy(*SHEET).agg(F.sort_array(F.collect_list(F.struct("col", "name"))).alias("own"))
    start = F.array().cast("array<struct<col:int,name:string>>")

    def step(acc: Column, x: Column) -> Column:
        used = F.transform(acc, lambda y: y["name"])
        tries = F.transform(F.sequence(F.lit(1), F.size(acc) + 1), lambda k: F.concat(x["name"], F.lit("_"), k.cast("string")))
        free = F.element_at(F.filter(tries, lambda t: ~F.array_contains(used, t)), 1)
        name = F.when(F.array_contains(used, x["name"]), free).otherwise(x["name"])
        return F.concat(acc, F.array(F.struct(x["col"].cast("int").alias("col"), name.alias("name"))))

    return grouped.select(*SHEET, F.explode(F.aggregate("own", start, step)).alias("x")).select(*SHEET, "x.col", "x.name")
