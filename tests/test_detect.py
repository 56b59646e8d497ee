import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veilframe.operators import classify, detect, headers, rules, scan
from veilframe.plans import catalogue


def scanned(spark, texts, **more):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [[(h.rule, h.start, h.value) for h in r.h] for r in df.select("i", detect.scan_text(F.col("t"), **more).alias("h")).orderBy("i").collect()]


def model(text):
    """The scan by plain Python."""
    out = []
    for i, r in sorted(enumerate(rules.PATTERNS), key=lambda x: x[1].priority):
        if r.pattern is None:
            spans = detect.Words(r.words).spans(text)
        else:
            spans = [(m.start(), m.end(), m[0]) for m in re.finditer(r.pattern, text)]
        for a, b, v in spans:
            if r.detected_type == "amount" and re.fullmatch(r"[\d,.\-]+", v) and len(re.sub("[,-]", "", v)) < 4:
                continue
            if r.priority and any(a < e and b > s for _, s, e, _ in out):
                continue
            out.append((r.name, a, b, v))
    return [(n, a, v) for n, a, _, v in out]


KNOWN = {
    "本项目总投资 1,234,567.89 元": [("amount_with_commas", 7, "1,234,567.89")],
    "客户：天齐锂业股份有限公司；账号 6222 0202 0000 1234 567": [("entity_dict", 3, "天齐锂业"), ("bank_account", 17, "6222 0202 0000 1234")],
    "增长率 12,345.00% 完成": [],
    "6222021234567890": [("amount_no_commas_int", 0, "6222021234567890")],
    "HT-2024-001234": [("amount_no_commas_int", 7, "-001234")],
    "四川措拉": [("entity_dict", 0, "四川措拉")],
    "合同 5000万元": [("amount_with_unit", 4, "000万元")],
    "": [],
}


def test_known_texts(spark):
    assert scanned(spark, list(KNOWN)) == list(KNOWN.values())
    assert [model(t) for t in KNOWN] == list(KNOWN.values())


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text("0123,.-% 万元亿公司集团AHT四川措拉\n", max_size=30), min_size=1, max_size=8))
def test_scan_is_the_model(spark, texts):
    assert scanned(spark, texts) == [model(t) for t in texts]
    assert scanned(spark, texts, prefilter=False) == [model(t) for t in texts]


@settings(max_examples=25, deadline=None)
@given(st.text("ab", max_size=12), st.lists(st.text("ab", min_size=1, max_size=4), min_size=1, max_size=4))
def test_dictionaries_agree(spark, text, words):
    df = spark.createDataFrame([(text,)], "t string")
    native, automaton = df.select(detect.dictionary_spans(F.col("t"), tuple(words)), detect.dictionary_column(tuple(words))(F.col("t"))).first()
    want = detect.Words(tuple(words)).spans(text)
    assert [tuple(x) for x in native] == [tuple(x) for x in automaton] == want


def test_rule_files(tmp_path):
    assert [r.name for r in rules.load_patterns()] == [r.name for r in rules.PATTERNS] and len(rules.load_columns()) == 21
    with pytest.raises(rules.RuleError):
        rules.load_patterns(tmp_path / "none.json")
    (tmp_path / "bad.json").write_text("{")
    with pytest.raises(rules.RuleError):
        rules.load_columns(tmp_path / "bad.json")
    (tmp_path / "p.json").write_text('{"rules": {"person": [{"name": "d", "dict_path": "d.txt"}], "amount": [{"name": "a", "pattern": "x"}]}}')
    (tmp_path / "d.txt").write_text("\n")
    with pytest.raises(rules.RuleError):
        rules.load_patterns(tmp_path / "p.json")
    assert rules.save_dictionary(tmp_path / "d.txt", " b \na\n\nb\n") == ["b", "a"]
    assert [(r.name, r.words) for r in rules.load_patterns(tmp_path / "p.json")] == [("a", ()), ("d", ("b", "a"))]


def test_header_rules(spark):
    names = ["营业收入", " 账号 ", "其他收入", "", "2024年上半年", "合同金额", "xx金额", None]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string")
    assert [r.m for r in df.select("i", rules.match_header(F.col("n")).alias("m")).orderBy("i").collect()] == [1, 14, 17, None, 0, 8, 16, None]
    order = (rules.ColumnRule("regex", "a.*", "mask", {}, "amount", 2), rules.ColumnRule("regex", "ab", "mask", {}, "amount", 1), rules.ColumnRule("position", "0", "mask", {}))
    assert spark.range(1).select(rules.match_header(F.lit("ab"), order)).first()[0] == 1


GRIDS = {
    "single": (["项目,本期金额,上期金额,同比变动", "营业收入,12345678.9,11111111.11,11.1%", "营业成本,8765432.1,7777777.77,12.7%"], (0, 0)),
    "double": (["单据信息,_,产品详情,_,入库详情,_", "单据编号,单据日期,产品名称,产品规格,本次入库,补充说明", "CK-A001,2026-04-01,纸箱,50*40cm,120,日常补货"], (0, 1)),
    "titled": (["", "仓库入库单", "", "", "", "登记日期：,2026-04-23", "", "单据信息,_,产品详情,_,入库详情,_", "单据编号,单据日期,产品名称,产品规格,本次入库,补充说明", "CK-A001,2026-04-01,纸箱,50*40cm,120,日常补货"], (7, 8)),
}


def grid(spark, rows, name="s"):
    cells = [("f", 0, name, r, c, "string", None, t) for r, line in enumerate(rows) for c, t in enumerate(line.split(",")) if line and t != "_"]
    width = max(len(line.split(",")) for line in rows)
    sheets = [("f", 0, name, True, 0, 0, len(rows) - 1, width - 1)]
    return spark.createDataFrame(cells, "file string, sheet_idx int, sheet string, row int, col int, kind string, num double, text string"), spark.createDataFrame(sheets, "file string, sheet_idx int, sheet string, visible boolean, first_row int, first_col int, end_row int, end_col int")


@pytest.mark.parametrize("name", GRIDS)
def test_header_spans(spark, name):
    rows, want = GRIDS[name]
    found = headers.header_spans(headers.row_scores(headers.row_values(*grid(spark, rows)))).collect()
    assert [(r.header_start, r.header_end) for r in found] == [want]


def test_names(spark):
    cells, sheets = grid(spark, ["本期 金额/占比,编号,编号,编号_1,_"])
    merges = spark.createDataFrame([], "file string, sheet_idx int, sheet string, rect_idx int, r0 int, c0 int, r1 int, c1 int")
    spans = sheets.selectExpr("file", "sheet_idx", "sheet", "0 AS header_start", "0 AS header_end")
    names = headers.header_names(cells, spans, sheets, merges)
    assert [r.name for r in headers.unique_names(names).orderBy("col").collect()] == ["本期_金额_占比", "编号", "编号_1", "编号_1", ""]
    assert [r.name for r in headers.probed_names(names).orderBy("col").collect()] == ["本期_金额_占比", "编号", "编号_1", "编号_1_1"]


def test_numeric_text(spark):
    df = spark.createDataFrame([(v,) for v in ("123", "-45", "3.14", "1,234.56", "50%", "-25.5%", "text", "12.34.56", "abc123")], "v string")
    assert [r[0] for r in df.select(classify.is_numeric_text(F.col("v"))).collect()] == [True] * 6 + [False] * 3


def test_forms(spark):
    simple = spark.createDataFrame([("f", 0, "s", 0, 0, "公司名称"), ("f", 0, "s", 1, 0, "阿里巴巴集团"), ("f", 0, "s", 0, 1, "备注"), ("f", 0, "s", 1, 1, "1,234,567.89 元")], "file string, sheet_idx int, sheet string, row int, col int, text string")
    got = {(r.location.cell, r.detected_type, r.discovered_by) for r in scan.scan_form(simple).collect()}
    assert ("B2", "amount", "fulltext_scan") in got
    own = (rules.ColumnRule("exact", "公司名称", "alias", {}, "entity"),)
    assert ("A2", "entity", "column_rule") in {(r.location.cell, r.detected_type, r.discovered_by) for r in scan.scan_form(simple, own).collect()}


def test_sites_are_ordered_beyond_the_first_100_000_characters(spark, monkeypatch):
    hits = spark.createDataFrame([(3, 2, 250_000, "c", "account"), (3, 2, 150_000, "a", "account"), (3, 2, 200_000, "b", "account"), (3, 1, 900_000, "z", "amount"), (4, 0, 5, "d", "amount")], "doc_id long, ord int, start int, value string, detected_type string")
    monkeypatch.setattr(catalogue.detect, "scan_table", lambda *_: hits)
    sites = catalogue.document_sites(hits).orderBy("ord").collect()
    assert len({s.ord for s in sites}) == len(sites)
    assert [s.original_value for s in sites] == ["z", "a", "b", "c", "d"]
