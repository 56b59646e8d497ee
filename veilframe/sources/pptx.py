"""Decks as long tables of texts, and replacement of texts across runs."""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape, unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.sources.files import entries, zipped

A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
SCHEMA = "file string, error string, texts array<struct<slide:int,shape_ord:int,shape_id:string,shape_name:string,part:string,para_idx:int,row:int,col:int,text:string>>"
SLIDE = re.compile(r"ppt/slides/slide(\d+)\.xml")
RUN = re.compile(r"(<a:t(?:\s[^>]*)?>)(.*?)(</a:t>)", re.S)
PARAGRAPH = re.compile(r"<a:p(?:\s[^>]*)?>.*?</a:p>", re.S)
SHAPE = re.compile(r"<p:(sp|graphicFrame)(?:\s[^>]*)?>.*?</p:\1>", re.S)
NAME = re.compile(r"""<p:cNvPr\s(?:[^>]*?\s)?name=("|')(.*?)\1""", re.S)
ROW, CELL = (re.compile(rf"<a:{tag}(?:\s[^>]*?)?(?:/>|>.*?</a:{tag}>)", re.S) for tag in ("tr", "tc"))


def runs(node: ElementTree.Element) -> str:
    return "".join(t.text or "" for t in node.iter(f"{A}t"))


def slide_texts(n: int, xml: bytes) -> list[dict]:
    """Text boxes by paragraph, tables by cell; a table cell is all its runs."""
    out, ord_ = [], 0
    for shape in ElementTree.fromstring(xml).iter():
        if shape.tag not in (f"{P}sp", f"{P}graphicFrame"):
            continue
        names = shape.find(f"./{P}nvSpPr/{P}cNvPr") if shape.tag == f"{P}sp" else shape.find(f"./{P}nvGraphicFramePr/{P}cNvPr")
        own = {"slide": n, "shape_ord": ord_, "shape_id": names.get("id", "") if names is not None else "", "shape_name": names.get("name", "") if names is not None else ""}
        ord_ += 1
        if shape.tag == f"{P}sp":
            out += [own | {"part": "textbox", "para_idx": k, "row": None, "col": None, "text": runs(p)} for k, p in enumerate(shape.iter(f"{A}p"))]
        else:
            for r, row in enumerate(shape.iter(f"{A}tr")):
                out += [own | {"part": "table", "para_idx": 0, "row": r, "col": c, "text": runs(cell)} for c, cell in enumerate(row.findall(f"{A}tc"))]
    return out


def parse(content: bytes) -> list[dict]:
    """All texts of a deck: slides by number, notes of the same number after each slide."""
    parts, out = entries(content), []
    for n in sorted(int(m[1]) for name in parts if (m := SLIDE.fullmatch(name))):
        out += slide_texts(n, parts[f"ppt/slides/slide{n}.xml"])
        if (notes := f"ppt/notesSlides/notesSlide{n}.xml") in parts:
            texts = [runs(p) for p in ElementTree.fromstring(parts[notes]).iter(f"{A}p")]
            out += [{"slide": n, "shape_ord": 1_000_000, "shape_id": "", "shape_name": "notes", "part": "notes", "para_idx": k, "row": None, "col": None, "text": t} for k, t in enumerate(texts)]
    return out


def read(files: DataFrame) -> DataFrame:
    """A row for each deck of ``documents``: its texts, or the error."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    out = {"file": path, "error": None, "texts": parse(content)}
                except Exception as e:  # noqa: BLE001  a broken document is a row with an error, not a failed job
                    out = {"file": path, "error": f"{type(e).__name__}: {e}", "texts": []}
                yield pd.DataFrame([out])

    return files.select("path", "content").mapInPandas(rows, SCHEMA)


def texts(decks: DataFrame) -> DataFrame:
    return decks.select("file", F.explode("texts").alias("x")).select("file", "x.*")


def replace_in(xml: str, old: str, new: str) -> str:
    """Replace within runs; if no run holds the text, at its first place across the runs of a paragraph."""
    hit = False

    def in_run(m: re.Match) -> str:
        nonlocal hit
        text = unescape(m[2])
        hit |= old in text
        return m[1] + (escape(text.replace(old, new)) if old in text else m[2]) + m[3]

    out = RUN.sub(in_run, xml)
    if hit or not old:
        return out
    done = False

    def in_paragraph(m: re.Match) -> str:
        nonlocal done
        own = [unescape(r[2]) for r in RUN.finditer(m[0])]
        first = -1 if done else "".join(own).find(old)
        if first < 0:
            return m[0]
        done, last, at, k = True, first + len(old), 0, -1

        def spread(r: re.Match) -> str:
            nonlocal at, k
            k += 1
            begin, end = at, at + len(own[k])
            at = end
            keep_left, keep_right = own[k][: max(0, first - begin)], own[k][max(0, min(len(own[k]), last - begin)) :]
            if end <= first or begin >= last:
                return r[0]
            return r[1] + escape(keep_left + (new if begin <= first < end else "") + keep_right) + r[3]

        return RUN.sub(spread, m[0])

    return PARAGRAPH.sub(in_paragraph, xml)


def nth(pattern: re.Pattern, xml: str, n: int, change: Callable[[str], str]) -> str:
    """xml with its nth match, from 1, changed."""
    for k, m in enumerate(pattern.finditer(xml), 1):
        if k == n:
            return xml[: m.start()] + change(m[0]) + xml[m.end() :]
    return xml


def replace_at(xml: str, shape: str, place: str | None, old: str, new: str) -> str:
    """Replace in the slide's shapes of a name alone, or in a cell of theirs (R1C1)."""
    row, cell = map(int, place[1:].split("C")) if place else (0, 0)

    def in_shape(m: re.Match) -> str:
        name = NAME.search(m[0])
        if html.unescape(name[2]) != shape if name else shape != "":
            return m[0]
        if not place:
            return replace_in(m[0], old, new)
        return nth(ROW, m[0], row, lambda r: nth(CELL, r, cell, lambda c: replace_in(c, old, new)))

    return SHAPE.sub(in_shape, xml)


def edit(content: bytes, edits: list[tuple], mark: str = "") -> bytes:
    """The deck with edits in order, and a mark behind its first text.

    An edit is (slide, old, new), for a slide and its notes, or (slide, old, new, shape, place), for a shape or a cell of
    a table alone, as another text may hold what was found; the shape ``notes`` is the slide's notes.
    """
    parts = entries(content)
    for slide, old, new, *at in edits:
        name, notes = f"ppt/slides/slide{slide}.xml", f"ppt/notesSlides/notesSlide{slide}.xml"
        if name in parts:
            xml = parts[name].decode("utf-8")
            parts[name] = (replace_at(xml, *at, old, new) if at else replace_in(xml, old, new)).encode("utf-8")
        if notes in parts and (not at or at[0] == "notes"):
            parts[notes] = replace_in(parts[notes].decode("utf-8"), old, new).encode("utf-8")
    for name in [n for n in parts if SLIDE.fullmatch(n)] if mark else []:
        xml = parts[name].decode("utf-8")
        if (found := RUN.search(xml)) and found[2]:
            parts[name] = (xml[: found.end(2)] + escape(mark) + xml[found.end(2) :]).encode("utf-8")
            break
    return zipped(parts)


def build(slides: list[tuple[list[str], list[list[str]], str | None]]) -> bytes:
    """A deck of (runs of the title, rows of a table, notes), one for each slide."""
    spaces, parts = f'xmlns:a="{A[1:-1]}" xmlns:p="{P[1:-1]}"', {}
    run = lambda t: f"<a:r><a:t>{escape(t)}</a:t></a:r>"
    for n, (title, rows, notes) in enumerate(slides, 1):
        table = "".join("<a:tr>" + "".join(f"<a:tc><a:txBody><a:p>{run(v)}</a:p></a:txBody></a:tc>" for v in row) + "</a:tr>" for row in rows)
        box = f'<p:sp><p:nvSpPr><p:cNvPr id="2" name="Title"/></p:nvSpPr><p:txBody><a:p>{"".join(map(run, title))}</a:p></p:txBody></p:sp>'
        frame = f'<p:graphicFrame><p:nvGraphicFramePr><p:cNvPr id="3" name="Table"/></p:nvGraphicFramePr><a:tbl>{table}</a:tbl></p:graphicFrame>'
        parts[f"ppt/slides/slide{n}.xml"] = f"<p:sld {spaces}>{box}{frame if rows else ''}</p:sld>"
        if notes is not None:
            parts[f"ppt/notesSlides/notesSlide{n}.xml"] = f"<p:notes {spaces}><p:sp><p:txBody><a:p>{run(notes)}</a:p></p:txBody></p:sp></p:notes>"
    return zipped({k: v.encode("utf-8") for k, v in parts.items()})
