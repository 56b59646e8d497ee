import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from veilframe import cli
from veilframe.operators.rules import RuleError
from veilframe.plans.pipeline import Options, generate, redact
from veilframe.sources import audit, files, pptx, strategy, xlsx

NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def zipped(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def workbook(sheets, hidden=()):
    """sheets: name to rows of cells; numbers stay numbers, texts are shared strings."""
    strings, parts, names, rels = [], {}, "", ""
    for i, (name, rows) in enumerate(sheets.items(), 1):
        body = ""
        for r, row in enumerate(rows, 1):
            body += f'<row r="{r}">'
            for c, v in enumerate(row):
                if v is None:
                    continue
                ref = f"{chr(65 + c)}{r}"
                if isinstance(v, str):
                    strings.append(v)
                    body += f'<c r="{ref}" s="0" t="s"><v>{len(strings) - 1}</v></c>'
                else:
                    body += f'<c r="{ref}"><v>{v}</v></c>'
            body += "</row>"
        parts[f"xl/worksheets/sheet{i}.xml"] = f'<worksheet {NS}><sheetData>{body}</sheetData><mergeCells><mergeCell ref="A1:B1"/></mergeCells></worksheet>'
        names += f'<sheet name="{name}" sheetId="{i}" r:id="rId{i}"{" state=" + chr(34) + "hidden" + chr(34) if name in hidden else ""}/>'
        rels += f'<Relationship Id="rId{i}" Target="{"/xl/" if i % 2 else ""}worksheets/sheet{i}.xml"/>'
    parts["xl/workbook.xml"] = f"<workbook {NS}><sheets>{names}</sheets></workbook>"
    parts["xl/_rels/workbook.xml.rels"] = f"<Relationships>{rels}</Relationships>"
    parts["xl/sharedStrings.xml"] = f"<sst {NS}>" + "".join(f"<si><r><t>{s[:1]}</t></r><r><t>{s[1:]}</t></r></si>" for s in strings) + "</sst>"
    parts["docProps/core.xml"] = "<x> keep &amp; me </x>"
    return zipped(parts)


def deck(slides, notes):
    parts, ns = {}, 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main"'
    for n, (runs, table) in slides.items():
        text = "".join(f"<a:r><a:rPr b='1'/><a:t>{t}</a:t></a:r>" for t in runs)
        rows = "".join("<a:tr>" + "".join(f"<a:tc><a:txBody><a:p><a:r><a:t>{c}</a:t></a:r></a:p></a:txBody></a:tc>" for c in row) + "</a:tr>" for row in table)
        parts[f"ppt/slides/slide{n}.xml"] = f"<p:sld {ns}><p:sp><p:nvSpPr><p:cNvPr id='2' name='Title'/></p:nvSpPr><p:txBody><a:p>{text}</a:p></p:txBody></p:sp><p:graphicFrame><p:nvGraphicFramePr><p:cNvPr id='3' name='Table'/></p:nvGraphicFramePr><a:tbl>{rows}</a:tbl></p:graphicFrame></p:sld>"
    for n, text in notes.items():
        parts[f"ppt/notesSlides/notesSlide{n}.xml"] = f"<p:notes {ns}><p:sp><p:txBody><a:p><a:r><a:t>{text}</a:t></a:r></a:p></p:txBody></p:sp></p:notes>"
    return zipped(parts)


BOOK = workbook({"表": [["客户名称", "账号", "合同金额"], *[[f"客户{i}", f"62220212345678{i:02d}", 10000.5 + i] for i in range(30)]], "说明": [["备注"], ["付款 1,234,567.89 元"]], "藏": [["客户名称"], ["x"]]}, hidden=("藏",))
DECK = deck({2: (["天齐", "锂业股份"], [["联系人", "账号"], ["张三", "6222021234567890"]]), 10: (["合同 88888 元"], [])}, {2: "总额 1,234,567.89"})


def test_cell_texts():
    assert [xlsx.float_text(x) for x in (1.0, -0.0, 1e20, 0.1, 1e-7, 123456.789)] == ["1", "0", "100000000000000000000", "0.1", "0.0000001", "123456.789"]
    assert [xlsx.serial_text(x) for x in (46076, 0, 0.5, 60, 61, 25569)] == ["2026-02-23 00:00:00", "00:00:00", "12:00:00", "1900-02-29 00:00:00", "1900-03-01 00:00:00", "1970-01-01 00:00:00"]


def test_workbook_parts_and_edits():
    sheets, merges, cells = xlsx.parse(BOOK)
    assert [(s["sheet"], s["visible"], s["end_row"]) for s in sheets] == [("表", True, 30), ("说明", True, 1), ("藏", False, 1)]
    assert len(merges) == 3 and xlsx.text_in(BOOK, "表", "A2") == "客户0" and xlsx.text_in(BOOK, "表", "C2") == "10000.5"
    out = xlsx.edit(BOOK, {("表", "A2"): "<新> & ", ("表", "C3"): "12.5", ("表", "C4"): "多"})
    assert [xlsx.text_in(out, "表", c) for c in ("A2", "C3", "C4", "B2")] == ["<新> & ", "12.5", "多", "6222021234567800"]
    before, after = files.entries(BOOK), files.entries(out)
    assert list(before) == list(after) and all(before[n] == after[n] for n in before if "sheet1" not in n)


def test_deck_parts_and_edits():
    texts = pptx.parse(DECK)
    assert [(t["slide"], t["part"], t["text"]) for t in texts][0] == (2, "textbox", "天齐锂业股份") and texts[-1]["slide"] == 10
    out = pptx.edit(DECK, [(2, "天齐锂业", "[公司A]"), (2, "1,234,567.89", "1百万元 & 更多")], "​‌")
    got = {(t["slide"], t["part"], t["row"], t["col"]): t["text"] for t in pptx.parse(out)}
    assert got[(2, "textbox", None, None)].replace("​‌", "") == "[公司A]股份" and got[(2, "notes", None, None)] == "总额 1百万元 & 更多"
    assert "b='1'" in files.entries(out)["ppt/slides/slide2.xml"].decode()


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    out = tmp_path_factory.mktemp("documents")
    (out / "sub").mkdir()
    (out / "book.xlsx").write_bytes(BOOK)
    (out / "sub" / "deck.PPTX").write_bytes(DECK)
    (out / "broken.xlsx").write_bytes(b"no zip")
    (out / "other.txt").write_text("x")
    return out


def test_generate_and_redact(spark, folder, tmp_path):
    options = Options(operator="me", timestamp="2024-01-01T00:00:00")
    made = generate(spark, str(folder), options)
    assert {r.pattern for r in made.column_rules} == {"客户名称", "账号", "合同金额"}
    values = {s["original_value"] for s in made.sites}
    assert {"1,234,567.89", "天齐锂业", "张三", "6222021234567890", "88888"} <= values
    text = strategy.dump(made)
    again = strategy.load(text)
    assert [s["site_id"] for s in again.sites] == [s["site_id"] for s in made.sites] and len(again.column_rules) == 3
    assert strategy.dump(again) == text
    dry = {r.file.rpartition("/")[2]: r for r in redact(spark, str(folder), str(tmp_path), again, Options(dry_run=True)).collect()}
    assert dry["book.xlsx"].status == "dry_run" and dry["book.xlsx"].processed > 60 and not list(tmp_path.iterdir())
    for plan in (again,):
        rows = {r.file.rpartition("/")[2]: r for r in redact(spark, str(folder), str(tmp_path), plan, Options(operator="me", force=True, timestamp="2024-01-01T00:00:00")).collect()}
        assert [rows[n].status for n in ("book.xlsx", "deck.PPTX", "broken.xlsx")] == ["ok", "ok", "failed"]
        out = (tmp_path / "book_脱敏.xlsx").read_bytes()
        assert xlsx.text_in(out, "表", "A2") == "[客户A]" and xlsx.text_in(out, "表", "A31") == "[客户AD]" and xlsx.text_in(out, "表", "B2") == "622*********7800"
        assert xlsx.text_in(out, "说明", "A2") == "付款 1.23 元"
        assert xlsx.text_in(out, "表", "A1").startswith("客户名称​") or xlsx.text_in(out, "表", "A1").startswith("客户名称‌")
        texts = "".join(t["text"] for t in pptx.parse((tmp_path / "deck_脱敏.PPTX").read_bytes()))
        assert "天齐锂业" not in texts and "张三" not in texts and "88888" not in texts
        log = json.loads((tmp_path / "book_日志.json").read_text())
        assert list(log) == ["file", "source_path", "output_file", "operator", "timestamp", "file_hash", "total_changes", "total_errors", "changes", "errors"]
        assert log["total_changes"] == len(log["changes"]) == rows["book.xlsx"].processed and list(log["changes"][0]) == ["site_id", "location", "original", "redacted", "action"]
    rows = redact(spark, str(folder), str(tmp_path), None, Options()).collect()
    assert sorted(r.status for r in rows) == ["failed", "skipped_exists", "skipped_exists"]


def test_several_files(spark, tmp_path):
    """Equal stems get outputs of their own; a site that names no file is one of every file that has its place."""
    for name, value in (("a/x.xlsx", "甲 31 号"), ("b/x.xlsx", "乙 31 号"), ("b/y.xlsx", "丙 32 号")):
        (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / name).write_bytes(xlsx.build([("S", True, [[value]], [])]))
    plan = strategy.load("sites: [{site_id: s, location: {sheet: S, cell: A1}, original_value: '31', action: mask_account, params: {keep_prefix: 0, keep_suffix: 0}}]")
    rows = redact(spark, str(tmp_path / "in"), str(tmp_path / "out"), plan, Options(operator="me", timestamp="2024-01-01T00:00:00")).collect()
    assert [r.status for r in rows] == ["ok"] * 3 and len({r.output for r in rows}) == 3
    texts = {r.file.rpartition("/in/")[2]: xlsx.text_in(open(r.output, "rb").read(), "S", "A1").rstrip("\u200b\u200c") for r in rows}
    assert texts == {"a/x.xlsx": "甲 ** 号", "b/x.xlsx": "乙 ** 号", "b/y.xlsx": "丙 32 号"}
    assert (tmp_path / "out" / "x_脱敏.xlsx").exists() and len(list((tmp_path / "out").glob("*_日志.json"))) == 3


def test_built_files():
    book = xlsx.build([("<S>", True, [["a & b", 1, 2.5, True, None], [xlsx.date(2024, 2, 29)]], ["A1:B1"]), ("T", False, [], [])])
    sheets, merges, cells = xlsx.parse(book)
    assert [(s["sheet"], s["visible"]) for s in sheets] == [("<S>", True), ("T", False)] and len(merges) == 1
    assert [(c["kind"], c["text"]) for c in cells] == [("string", "a & b"), ("int", "1"), ("float", "2.5"), ("bool", "True"), ("datetime", "2024-02-29 00:00:00")]
    assert [xlsx.column_name(i) for i in (0, 25, 26, 701, 702)] == ["A", "Z", "AA", "ZZ", "AAA"]
    assert [t["text"] for t in pptx.parse(pptx.build([(["a", "<b>"], [], None), (["c"], [["d"]], "e")]))] == ["a<b>", "c", "d", "e"]


def test_command_line(spark, folder, tmp_path, capsys):
    assert cli.main([]) == 0
    assert cli.main(["generate", "-i", str(folder / "book.xlsx"), "-o", str(tmp_path / "s.yaml")]) == 0
    assert cli.main(["redact", "-i", str(folder / "book.xlsx"), "-s", str(tmp_path / "s.yaml"), "-o", str(tmp_path / "out")]) == 0
    assert (tmp_path / "out" / "book_脱敏.xlsx").exists()
    assert cli.main(["redact", "-i", str(folder / "book.xlsx"), "-s", str(tmp_path / "none.yaml"), "-o", str(tmp_path)]) == 1


def test_strategies_are_checked():
    with pytest.raises(RuleError):
        strategy.load("sites: [{site_id: a, location: {type: excel, sheet: s}}]")
    with pytest.raises(RuleError):
        strategy.load("sites: [{site_id: a, location: {type: ppt, slide: 1, shape_id: x}, action: burn}]")
    made = strategy.load("sites: [{site_id: a, location: {sheet: s, cell: A1}, original_value: '5'}]")
    assert made.sites[0]["enabled"] and made.sites[0]["action"] == "mask" and made.version == "1.0"


def test_deck_edits_stay_at_their_places(spark, tmp_path):
    """The title's amount is part of the account in the table, which is masked as a whole."""
    (tmp_path / "in").mkdir()
    slides = [(["合同 200", "00000 元"], [["联系人", "账号", "说明"], ["李四", "6222000000000800", "20000000"]], "备注 20000000")]
    (tmp_path / "in" / "d.pptx").write_bytes(pptx.build(slides))
    redact(spark, str(tmp_path / "in"), str(tmp_path / "out"), None, Options(operator="me", timestamp="2024-01-01T00:00:00")).collect()
    texts = [t["text"].replace("\u200b", "").replace("\u200c", "") for t in pptx.parse((tmp_path / "out" / "d_脱敏.pptx").read_bytes())]
    assert texts == ["合同 20.00百万元 元", "联系人", "账号", "说明", "李*", "622*********0800", "20.00百万元", "备注 20.00百万元"]


def test_deck_edits_of_one_place():
    xml = "<p:sp><p:nvSpPr><p:cNvPr id='1' name='a &amp; &#x4E00;'/></p:nvSpPr><a:p><a:r><a:t>1 2</a:t></a:r></a:p></p:sp><p:graphicFrame><p:cNvPr descr='d' name=\"b\"/><a:tr h='1'><a:tc/><a:tc><a:tcPr/><a:t>1</a:t></a:tc></a:tr><a:tr><a:tc><a:t>1</a:t></a:tc></a:tr></p:graphicFrame>"
    assert pptx.replace_at(xml, "a & 一", None, "1", "x") == xml.replace("1 2", "x 2")
    assert pptx.replace_at(xml, "b", "R1C2", "1", "x") == xml.replace("<a:tcPr/><a:t>1", "<a:tcPr/><a:t>x")
    assert pptx.replace_at(xml, "b", "R2C1", "1", "x") == xml.replace("<a:tc><a:t>1", "<a:tc><a:t>x")
    assert pptx.replace_at(xml, "c", None, "1", "x") == xml == pptx.replace_at(xml, "b", "R3C1", "1", "x")


def test_audit_logs_in_pieces(spark):
    n = 2 * audit.ENTRIES + 3
    rows = [(f"/in/{k}.xlsx", i, f"s{i}", {"type": "excel", "sheet": "S", "cell": "A1"}, 'a "b"', None if i % 5 == 0 else "*", "mask", "bad" if i % 5 == 0 else None) for k in "ab" for i in range(n)]
    done = spark.createDataFrame(rows, "file string, ord long, site_id string, location struct<type:string,sheet:string,cell:string,column:string>, original string, redacted string, action string, error string")
    logs = spark.createDataFrame([(f"/in/{k}.xlsx", "p", "o", "00") for k in "ac"], "file string, source_path string, output_file string, file_hash string")
    parts = audit.audit_parts(logs, done, "op", F.lit("t")).collect()
    texts = {f: json.loads("".join(r.text for r in sorted(parts, key=lambda r: (r.section, r.part)) if r.file == f)) for f in {r.file for r in parts}}
    assert set(texts) == {"/in/a.xlsx", "/in/c.xlsx"} and max(r.text.count("site_id") for r in parts) == audit.ENTRIES
    log = texts["/in/a.xlsx"]
    assert list(log) == ["file", "source_path", "output_file", "operator", "timestamp", "file_hash", "total_changes", "total_errors", "changes", "errors"]
    assert [x["site_id"] for x in log["changes"]] == [f"s{i}" for i in range(n) if i % 5] and log["total_changes"] == len(log["changes"])
    assert [x["site_id"] for x in log["errors"]] == [f"s{i}" for i in range(0, n, 5)] and log["total_errors"] == len(log["errors"])
    assert log["changes"][0] == {"site_id": "s1", "location": {"type": "excel", "sheet": "S", "cell": "A1"}, "original": 'a "b"', "redacted": "*", "action": "mask"}
    assert texts["/in/c.xlsx"]["total_changes"] == 0 and texts["/in/c.xlsx"]["changes"] == texts["/in/c.xlsx"]["errors"] == []
