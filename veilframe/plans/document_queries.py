"""Queries over workbooks and decks: written from the tables to the shared folder, then scanned, masked and read back.

A workbook holds 50 customers, a deck 20 suppliers, so the number of files grows with the tables and their size doesn't.
"""

from __future__ import annotations

from datetime import date, timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.functions.identity import ONE, ZERO, decode_mark
from veilframe.plans.catalogue import ORACLES, QUERIES, table
from veilframe.plans.pipeline import Options, generate, redact
from veilframe.plans.work import Work
from veilframe.sources import pptx, strategy, xlsx
from veilframe.sources.files import documents, write_file

ROWS, SLIDES = 50, 20
OPTIONS = Options(operator="op", timestamp="2024-01-01T00:00:00")


def write_books(rows: DataFrame, folder: str) -> None:
    """A workbook for each file of rows (file, key, name, city): a data sheet, a form, an empty and a hidden sheet."""

    def one(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("key")
        file = int(own["file"].iloc[0])
        data, hidden = [["客户名称", "账号", "数量", "单价"]], [["城市", "签约日"]]
        for key, name, city in zip(own["key"].tolist(), own["name"], own["city"], strict=True):
            data.append([name, f"6222{key:012d}", key + 7, key + 0.25])
            hidden.append([city, date(2023, 3, 15) + timedelta(days=key % 1000)])
        sheets = [("客户", True, data, []), ("说明", True, [["备注", None], [f"付款 {12_000_000 + file * 10_000} 元"], [None, file + 0.5, True]], ["A1:B1"]), ("空", True, [], []), ("藏", False, hidden, [])]
        write_file(f"{folder}/book_{file}.xlsx", xlsx.build(sheets))
        return pd.DataFrame({"file": [file]})

    rows.groupBy("file").applyInPandas(one, "file long").count()


def write_decks(rows: DataFrame, folder: str) -> None:
    """A deck for each file of rows (file, key, name): a slide for each row, its title in two runs, a table, and notes."""

    def one(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("key")
        file = int(own["file"].iloc[0])
        slides = []
        for key, name in zip(own["key"].tolist(), own["name"], strict=True):
            value = str(12_000_000 + key * 10_000)
            slides.append((["合同 " + value[:3], value[3:] + " 元"], [["联系人", "账号", "说明"], [name, f"6222{key:012d}", "无"]], f"备注 {key % 7}" if key % 2 else None))
        write_file(f"{folder}/deck_{file}.pptx", pptx.build(slides))
        return pd.DataFrame({"file": [file]})

    rows.groupBy("file").applyInPandas(one, "file long").count()


def books(spark: SparkSession, sf_dir: str) -> tuple[Work, str]:
    work = Work(spark, "books")
    rows = table(spark, sf_dir, "customer").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    write_books(rows.select(F.floor(F.col("c_custkey") / ROWS).alias("file"), F.col("c_custkey").cast("long").alias("key"), F.concat(F.lit("客户 "), "c_name").alias("name"), F.col("n_name").alias("city")), f"{work.root}/in")
    return work, f"{work.root}/in"


def decks(spark: SparkSession, sf_dir: str) -> tuple[Work, str]:
    work = Work(spark, "decks")
    rows = table(spark, sf_dir, "supplier")
    write_decks(rows.select(F.floor(F.col("s_suppkey") / SLIDES).alias("file"), F.col("s_suppkey").cast("long").alias("key"), F.col("s_name").alias("name")), f"{work.root}/in")
    return work, f"{work.root}/in"


def short(file: str = "file"):
    return F.regexp_extract(file, r"([^/]*)$", 1)


def cells_of(spark: SparkSession, folder: str, work: Work) -> DataFrame:
    read = work.keep(xlsx.read(documents(spark, folder)), "read")
    return xlsx.tables(read)[0].select(short().alias("file"), "sheet", "row", "col", "kind", "text")


def texts_of(spark: SparkSession, folder: str, work: Work) -> DataFrame:
    read = work.keep(pptx.read(documents(spark, folder)), "read")
    return pptx.texts(read).select(short().alias("file"), "slide", "part", "para_idx", "row", "col", "text")


def unmarked(df: DataFrame) -> DataFrame:
    """text without invisible characters, and what they say but for the file's hash."""
    said = F.substring_index(decode_mark("text"), "|", 2)
    return df.withColumn("mark", said).withColumn("text", F.regexp_replace("text", f"[{ZERO}{ONE}]", ""))


def xlsx_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every cell of every workbook."""
    work, folder = books(spark, sf_dir)
    return cells_of(spark, folder, work)


def xlsx_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sheet, with its used range and number of merged ranges."""
    work, folder = books(spark, sf_dir)
    _, sheets, merges = xlsx.tables(work.keep(xlsx.read(documents(spark, folder)), "read"))
    merged = merges.groupBy("file", "sheet_idx").agg(F.count("*").alias("n_merges"), F.max("c1").alias("last_merged"))
    return sheets.join(merged, ["file", "sheet_idx"], "left").na.fill(0, ["n_merges"]).select(short().alias("file"), "sheet_idx", "sheet", "visible", "end_row", "end_col", "n_merges", "last_merged")


def pptx_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of every deck."""
    work, folder = decks(spark, sf_dir)
    return texts_of(spark, folder, work)


def generate_xlsx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A strategy's sites, after its YAML text was written and read."""
    _, folder = books(spark, sf_dir)
    made = strategy.load(strategy.dump(generate(spark, folder, OPTIONS)))
    sites = strategy.sites_frame(spark, made, None)
    rules = ",".join(sorted(r.pattern for r in made.column_rules))
    return sites.select(short().alias("file"), "site_id", "location.sheet", "location.cell", "original_value", "detected_type", "action", "enabled", F.lit(rules).alias("rules"))


def redact_xlsx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every cell of the masked workbooks, and the mark that it carries."""
    work, folder = books(spark, sf_dir)
    redact(spark, folder, f"{work.root}/out", None, OPTIONS).count()
    return unmarked(cells_of(spark, f"{work.root}/out", work))


def redact_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a dry run says of each workbook, which writes nothing, and a run after it."""
    work, folder = books(spark, sf_dir)
    dry = redact(spark, folder, f"{work.root}/out", None, Options(operator="op", timestamp="2024-01-01T00:00:00", dry_run=True))
    dry = work.keep(dry.select(short().alias("file"), "status", "processed", "skipped", "errors", "output"), "dry")
    done = redact(spark, folder, f"{work.root}/out", None, OPTIONS)
    return dry.unionByName(done.select(short().alias("file"), "status", "processed", "skipped", "errors", short("output").alias("output")))


def redact_pptx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of the masked decks, and the mark that it carries."""
    work, folder = decks(spark, sf_dir)
    redact(spark, folder, f"{work.root}/out", None, OPTIONS).count()
    return unmarked(texts_of(spark, f"{work.root}/out", work))


C = "c AS (SELECT c_custkey AS k, CAST(c_custkey // 50 AS BIGINT) AS f, c_name, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey), n AS (SELECT *, CAST(row_number() OVER (PARTITION BY f ORDER BY k) AS INT) AS r FROM c), b AS (SELECT f, CAST(count(*) AS INT) AS m FROM c GROUP BY f)"
DAY = "strftime(DATE '2023-03-15' + CAST(k % 1000 AS INT), '%Y-%m-%d 00:00:00')"


def book_cells(name: str, account: str, paid: str, file: str) -> str:
    """All cells of the workbooks as SQL."""
    heads = [("客户", 0, "客户名称"), ("客户", 1, "账号"), ("客户", 2, "数量"), ("客户", 3, "单价"), ("说明", 0, "备注"), ("藏", 0, "城市"), ("藏", 1, "签约日")]
    columns = [("客户", 0, "string", name), ("客户", 1, "string", account), ("客户", 2, "int", "CAST(k + 7 AS VARCHAR)"), ("客户", 3, "float", "concat(k, '.25')"), ("藏", 0, "string", "n_name"), ("藏", 1, "datetime", DAY)]
    one = [("说明", 1, 0, "string", paid), ("说明", 2, 1, "float", "concat(f, '.5')"), ("说明", 2, 2, "bool", "'True'")]
    parts = [f"""SELECT {file} AS file, s AS sheet, CAST(0 AS INT) AS "row", CAST(i AS INT) AS col, 'string' AS kind, h AS text FROM b, (VALUES {", ".join(map(str, heads))}) AS t(s, i, h)"""]
    parts += [f"SELECT {file}, '{s}', r, {i}, '{kind}', {v} FROM n" for s, i, kind, v in columns]
    parts += [f"SELECT {file}, '{s}', {r}, {i}, '{kind}', {v} FROM b" for s, r, i, kind, v in one]
    return " UNION ALL ".join(parts)


NAME = "concat('客户 ', c_name)"
ACCOUNT = "concat('6222', lpad(CAST(k AS VARCHAR), 12, '0'))"
MASKED = f"concat('622', repeat('*', 9), right({ACCOUNT}, 4))"
LETTERS = "concat('[客户', CASE WHEN r <= 26 THEN chr(64 + r) ELSE chr(64 + (r - 1) // 26) || chr(65 + (r - 1) % 26) END, ']')"
VALUE = "CAST(12000000 + f * 10000 AS VARCHAR)"
BOOK, MASKED_BOOK = "concat('book_', f, '.xlsx')", "concat('book_', f, '_脱敏.xlsx')"

QUERIES["xlsx_scan"] = xlsx_scan
ORACLES["xlsx_scan"] = f"WITH {C} {book_cells(NAME, ACCOUNT, f'concat({chr(39)}付款 {chr(39)}, {VALUE}, {chr(39)} 元{chr(39)})', BOOK)}"

QUERIES["xlsx_sheets"] = xlsx_sheets
ORACLES["xlsx_sheets"] = f"""WITH {C} SELECT {BOOK} AS file, CAST(i AS INT) AS sheet_idx, s AS sheet, i < 3 AS visible, CAST(CASE i WHEN 1 THEN 2 WHEN 2 THEN -1 ELSE m END AS INT) AS end_row,
    CAST(CASE i WHEN 0 THEN 3 WHEN 1 THEN 2 WHEN 2 THEN -1 ELSE 1 END AS INT) AS end_col, CAST(i = 1 AS BIGINT) AS n_merges, CAST(CASE WHEN i = 1 THEN 1 END AS INT) AS last_merged FROM b, (VALUES (0, '客户'), (1, '说明'), (2, '空'), (3, '藏')) AS t(i, s)"""

QUERIES["generate_xlsx"] = generate_xlsx
ORACLES["generate_xlsx"] = f"""WITH {C} SELECT {BOOK} AS file, 'sheet_说明_A2' AS site_id, '说明' AS sheet, 'A2' AS cell, {VALUE} AS original_value, 'amount' AS detected_type, 'precision' AS action, true AS enabled, '客户名称,账号' AS rules FROM b"""

QUERIES["redact_xlsx"] = redact_xlsx
ORACLES["redact_xlsx"] = f"""WITH {C}, x AS ({book_cells(LETTERS, MASKED, "concat('付款 ', rtrim(rtrim(printf('%.2f', 12 + f / 100.0), '0'), '.'), ' 元')", MASKED_BOOK)})
    SELECT *, CASE WHEN "row" = 0 AND col = 0 AND sheet <> '藏' THEN 'op|2024-01-01T00:00:00' END AS mark FROM x"""

QUERIES["redact_report"] = redact_report
ORACLES["redact_report"] = f"""WITH {C} SELECT {BOOK} AS file, status, CAST(2 * m + 1 AS BIGINT) AS processed, CAST(0 AS BIGINT) AS skipped, CAST(0 AS BIGINT) AS errors, CASE WHEN status = 'ok' THEN {MASKED_BOOK} END AS output FROM b, (VALUES ('dry_run'), ('ok')) AS t(status)"""

S = "s AS (SELECT s_suppkey AS k, CAST(s_suppkey // 20 AS BIGINT) AS f, s_name FROM supplier), n AS (SELECT *, CAST(row_number() OVER (PARTITION BY f ORDER BY k) AS INT) AS r FROM s)"


def deck_texts(title: str, name: str, account: str, file: str) -> str:
    """All texts of the decks as SQL."""
    cells = [(0, 0, "'联系人'"), (0, 1, "'账号'"), (0, 2, "'说明'"), (1, 0, name), (1, 1, account), (1, 2, "'无'")]
    rows = " ".join(f"""UNION ALL SELECT {file}, r, 'table', 0, {i}, {j}, {v} FROM n""" for i, j, v in cells)
    return f"""SELECT {file} AS file, r AS slide, 'textbox' AS part, CAST(0 AS INT) AS para_idx, CAST(NULL AS INT) AS "row", CAST(NULL AS INT) AS col, {title} AS text FROM n {rows}
        UNION ALL SELECT {file}, r, 'notes', 0, NULL, NULL, concat('备注 ', k % 7) FROM n WHERE k % 2 = 1"""


DECK, MASKED_DECK = "concat('deck_', f, '.pptx')", "concat('deck_', f, '_脱敏.pptx')"
QUERIES["pptx_scan"] = pptx_scan
ORACLES["pptx_scan"] = f"WITH {S} {deck_texts(f'concat({chr(39)}合同 {chr(39)}, 12000000 + k * 10000, {chr(39)} 元{chr(39)})', 's_name', ACCOUNT, DECK)}"

QUERIES["redact_pptx"] = redact_pptx
ORACLES["redact_pptx"] = f"""WITH {S}, x AS ({deck_texts("concat('合同 ', printf('%.2f', 12 + k / 100.0), '百万元 元')", "concat(left(s_name, 1), repeat('*', length(s_name) - 1))", MASKED, MASKED_DECK)})
    SELECT *, CASE WHEN slide = 1 AND part = 'textbox' THEN 'op|2024-01-01T00:00:00' END AS mark FROM x"""
