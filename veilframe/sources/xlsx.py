"""Workbooks as long tables of cells, and edits of single cells that leave every other part as it is."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from datetime import date, datetime, timedelta
from decimal import Decimal
from posixpath import join, normpath
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.sources.files import entries, zipped

MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
# Built-in number formats that show dates and times.
DATE_FORMATS = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}
SCHEMA = (
    "file string, error string, sheets array<struct<sheet_idx:int,sheet:string,visible:boolean,first_row:int,first_col:int,end_row:int,end_col:int>>, "
    "merges array<struct<sheet_idx:int,sheet:string,rect_idx:int,r0:int,c0:int,r1:int,c1:int>>, "
    "cells array<struct<sheet_idx:int,sheet:string,row:int,col:int,kind:string,num:double,text:string>>"
)


def float_text(x: float) -> str:
    """The shortest decimal that is the number, never with an exponent; whole numbers as integers."""
    if math.isfinite(x) and x == int(x) and abs(x) < 1e16:
        return str(int(x))
    return format(Decimal(repr(x)), "f") if math.isfinite(x) else str(x)


def serial_text(serial: float) -> str:
    """A date serial as text; below 1 a time only. Serial 60 is the day that 1900 didn't have."""
    days, micros = divmod(round(serial * 86_400_000) * 1000, 86_400_000_000)
    clock = (datetime(2000, 1, 1) + timedelta(microseconds=micros)).strftime("%H:%M:%S")
    if micros % 1_000_000:
        clock += f".{micros % 1_000_000:06d}"
    if 0 <= serial < 1:
        return clock
    if days == 60:
        return f"1900-02-29 {clock}"
    day = datetime(1899, 12, 31 if days < 60 else 30) + timedelta(days=days)
    return f"{day:%Y-%m-%d} {clock}"


def place_of(ref: str) -> tuple[int, int]:
    found = re.fullmatch(r"\$?([A-Z]+)\$?([0-9]+)", ref)
    if not found:
        raise ValueError(f"not a cell reference: {ref}")
    column = 0
    for c in found[1]:
        column = column * 26 + ord(c) - 64
    return int(found[2]) - 1, column - 1


def sheet_paths(parts: dict[str, bytes]) -> list[tuple[str, bool, str]]:
    """(name, visible, entry) of every sheet in workbook order; targets may be relative or absolute."""
    book = ElementTree.fromstring(parts["xl/workbook.xml"])
    targets = {r.get("Id"): r.get("Target", "") for r in ElementTree.fromstring(parts["xl/_rels/workbook.xml.rels"])}
    out = []
    for s in book.iter(f"{MAIN}sheet"):
        target = targets.get(s.get(f"{REL}id"), "")
        path = target.lstrip("/") if target.startswith("/") else normpath(join("xl", target))
        out.append((s.get("name", ""), s.get("state", "visible") == "visible", path))
    return out


def run_text(node: ElementTree.Element) -> str:
    """All runs' text, without phonetic hints."""
    return "".join(t.text or "" for r in [node, *node.findall(f"{MAIN}r")] for t in r.findall(f"{MAIN}t"))


def shared_strings(parts: dict[str, bytes]) -> list[str]:
    return [run_text(x) for x in ElementTree.fromstring(parts["xl/sharedStrings.xml"]).findall(f"{MAIN}si")] if "xl/sharedStrings.xml" in parts else []


def date_styles(parts: dict[str, bytes]) -> set[int]:
    if "xl/styles.xml" not in parts:
        return set()
    root = ElementTree.fromstring(parts["xl/styles.xml"])
    own = {int(f.get("numFmtId", 0)) for f in root.iter(f"{MAIN}numFmt") if re.search("[dmyhs]", re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", f.get("formatCode", "").lower()).replace("general", ""))}
    formats = root.find(f"{MAIN}cellXfs")
    return {i for i, x in enumerate(formats if formats is not None else []) if int(x.get("numFmtId", 0)) in DATE_FORMATS | own}


def cell_value(c: ElementTree.Element, strings: list[str], dates: set[int]) -> tuple[str, float | None, str] | None:
    """(kind, number, text), or None if the cell is empty."""
    kind, value = c.get("t", "n"), c.findtext(f"{MAIN}v")
    if kind == "inlineStr":
        node = c.find(f"{MAIN}is")
        return ("string", None, run_text(node)) if node is not None else None
    if value is None:
        return None
    if kind == "s":
        return "string", None, strings[int(value)]
    if kind == "str":
        return "string", None, value
    if kind == "b":
        return "bool", None, "True" if value.strip() in ("1", "true") else "False"
    if kind == "e":
        return "error", None, value
    if kind == "d":
        return "iso", None, value
    x = float(value)
    if int(c.get("s", 0)) in dates:
        return "datetime", x, serial_text(x)
    return ("int" if re.fullmatch(r"-?\d+", value.strip()) else "float"), x, float_text(x)


def parse(content: bytes) -> tuple[list[dict], list[dict], list[dict]]:
    """Sheets, merged ranges and cells of a workbook."""
    parts = entries(content)
    strings, dates = shared_strings(parts), date_styles(parts)
    sheets, merges, cells = [], [], []
    for i, (name, visible, path) in enumerate(sheet_paths(parts)):
        root = ElementTree.fromstring(parts[path])
        own, row, col = [], -1, -1
        for r in root.iter(f"{MAIN}row"):
            row, col = int(r.get("r", row + 2)) - 1, -1
            for c in r.findall(f"{MAIN}c"):
                row, col = place_of(c.get("r")) if c.get("r") else (row, col + 1)
                if (value := cell_value(c, strings, dates)) is not None:
                    own.append({"sheet_idx": i, "sheet": name, "row": row, "col": col, "kind": value[0], "num": value[1], "text": value[2]})
        rows, cols = [c["row"] for c in own], [c["col"] for c in own]
        sheets.append({"sheet_idx": i, "sheet": name, "visible": visible, "first_row": min(rows, default=0), "first_col": min(cols, default=0), "end_row": max(rows, default=-1), "end_col": max(cols, default=-1)})
        for k, m in enumerate(root.iter(f"{MAIN}mergeCell")):
            if ":" in m.get("ref", ""):
                (r0, c0), (r1, c1) = map(place_of, m.get("ref").split(":"))
                merges.append({"sheet_idx": i, "sheet": name, "rect_idx": k, "r0": r0, "c0": c0, "r1": r1, "c1": c1})
        cells += own
    return sheets, merges, cells


def read(files: DataFrame) -> DataFrame:
    """A row for each workbook of ``documents``: its sheets, merges and cells, or the error."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    sheets, merges, cells = parse(content)
                    out = {"file": path, "error": None, "sheets": sheets, "merges": merges, "cells": cells}
                except Exception as e:  # noqa: BLE001  a broken document is a row with an error, not a failed job
                    out = {"file": path, "error": f"{type(e).__name__}: {e}", "sheets": [], "merges": [], "cells": []}
                yield pd.DataFrame([out])

    return files.select("path", "content").mapInPandas(rows, SCHEMA)


def tables(workbooks: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """cells, sheets and merges of read workbooks, in long form."""
    return tuple(workbooks.select("file", F.explode(c).alias("x")).select("file", "x.*") for c in ("cells", "sheets", "merges"))


def cell_xml(old: str, text: str) -> str:
    """A cell element with another value; its place and style stay."""
    head = re.match(r"<(?:\w+:)?c\b[^>]*?/?>", old)[0]
    prefix = re.match(r"<((?:\w+:)?)c\b", head)[1]
    attributes = re.sub(r'\st="[^"]*"', "", head.rstrip("/>").removeprefix(f"<{prefix}c"))
    is_text = re.search(r'\st="(s|inlineStr|str)"', head)
    if not is_text and re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", text):
        return f"<{prefix}c{attributes}><{prefix}v>{text}</{prefix}v></{prefix}c>"
    return f'<{prefix}c{attributes} t="inlineStr"><{prefix}is><{prefix}t xml:space="preserve">{escape(text)}</{prefix}t></{prefix}is></{prefix}c>'


CELL = re.compile(r"<((?:\w+:)?)c\b(?:[^>]*?/>|[^>]*?>.*?</\1c>)", re.S)


def edit(content: bytes, edits: dict[tuple[str, str], str]) -> bytes:
    """The workbook with new texts for (sheet, cell); one pass over each sheet that has any."""
    parts = entries(content)
    for name, _, path in sheet_paths(parts):
        own = {cell: text for (sheet, cell), text in edits.items() if sheet == name}
        if own:

            def swap(found: re.Match, own: dict[str, str] = own) -> str:
                ref = re.search(r'\sr="([A-Z]+[0-9]+)"', found[0])
                return cell_xml(found[0], own[ref[1]]) if ref and ref[1] in own else found[0]

            parts[path] = CELL.sub(swap, parts[path].decode("utf-8")).encode("utf-8")
    return zipped(parts)


def build(sheets: list[tuple[str, bool, list[list], list[str]]]) -> bytes:
    """A workbook of (name, visible, rows of values, merged ranges): texts are shared strings, days are styled numbers."""
    shared: dict[str, int] = {}

    def cell(ref: str, v) -> str:
        if v is None:
            return ""
        if isinstance(v, str):
            return f'<c r="{ref}" t="s"><v>{shared.setdefault(v, len(shared))}</v></c>'
        if isinstance(v, bool):
            return f'<c r="{ref}" t="b"><v>{int(v)}</v></c>'
        if isinstance(v, date):
            return f'<c r="{ref}" s="1"><v>{(v - date(1899, 12, 30)).days}</v></c>'
        return f'<c r="{ref}"><v>{v!r}</v></c>'

    spaces = f'xmlns="{MAIN[1:-1]}" xmlns:r="{REL[1:-1]}"'
    parts, names, targets = {}, "", ""
    for i, (name, shown, rows, merges) in enumerate(sheets, 1):
        body = "".join(f'<row r="{r}">' + "".join(cell(f"{column_name(c)}{r}", v) for c, v in enumerate(row)) + "</row>" for r, row in enumerate(rows, 1))
        ranges = "".join(f'<mergeCell ref="{m}"/>' for m in merges)
        parts[f"xl/worksheets/sheet{i}.xml"] = f"<worksheet {spaces}><sheetData>{body}</sheetData>" + (f"<mergeCells>{ranges}</mergeCells>" if ranges else "") + "</worksheet>"
        names += f'<sheet name="{escape(name)}" sheetId="{i}" r:id="rId{i}"' + ("/>" if shown else ' state="hidden"/>')
        targets += f'<Relationship Id="rId{i}" Target="worksheets/sheet{i}.xml"/>'
    parts["xl/workbook.xml"] = f"<workbook {spaces}><sheets>{names}</sheets></workbook>"
    parts["xl/_rels/workbook.xml.rels"] = f"<Relationships>{targets}</Relationships>"
    parts["xl/styles.xml"] = f'<styleSheet {spaces}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>'
    parts["xl/sharedStrings.xml"] = f"<sst {spaces}>" + "".join(f'<si><t xml:space="preserve">{escape(x)}</t></si>' for x in shared) + "</sst>"
    return zipped({k: v.encode("utf-8") for k, v in parts.items()})


def column_name(i: int) -> str:
    out, i = "", i + 1
    while i:
        i, last = divmod(i - 1, 26)
        out = chr(65 + last) + out
    return out


def text_in(content: bytes, sheet: str, cell: str) -> str | None:
    """One cell's text."""
    row, col = place_of(cell)
    return next((c["text"] for c in parse(content)[2] if (c["sheet"], c["row"], c["col"]) == (sheet, row, col)), None)


__all__ = ["build", "cell_xml", "edit", "float_text", "parse", "read", "serial_text", "tables", "text_in"]
