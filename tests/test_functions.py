import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veilframe.functions import amount, identity, register
from veilframe.operators import alias, dispatch


def run(spark, values, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.x for r in df.select("i", expression.alias("x")).orderBy("i").collect()]


def table(spark, pairs, expression):
    assert run(spark, [a for a, _ in pairs], expression) == [b for _, b in pairs]


def test_parse_number(spark):
    table(spark, [("1.5亿元", 1.5e8), ("2.3万亿元", 2.3e12), ("500千元", 5e5), ("1,234,567.89", 1234567.89), ("", None), ("3千万", None), ("1d", None), ("-5", -5.0), (".5", 0.5), ("5.", 5.0), ("1e3", 1000.0), (" 7 元元", 7.0), ("abc", None), (None, None)], amount.parse_number("v"))


def test_extract_unit(spark):
    table(spark, [("22.12亿元", ("22.12", "亿元")), ("100元", ("100", "元")), ("100万", ("100", "万")), ("1234.56", ("1234.56", "")), ("", ("", ""))], amount.extract_unit("v"))


def test_precision(spark):
    table(spark, [("22.12亿元", "22亿元"), ("22.55亿元", "23亿元"), ("-3.14亿元", "-3亿元"), ("12345678.9", "12.35百万元"), ("0", "0.00百万元"), ("x", None), (None, None)], amount.precision("v"))
    table(spark, [("5", None), ("0", "0.00元")], amount.precision("v", "trillion"))
    table(spark, [("0", "0.千元"), ("1500", "2千元")], amount.precision("v", "thousand", 0))


def test_perturb(spark):
    table(spark, [("1000000", "1,000,000.00")], amount.perturb("v", 0))
    table(spark, [("1000000", None)], amount.perturb("v", 200))
    got = run(spark, ["1000000", "1.5亿元"], amount.unit_random(amount.fnv1a("v")))
    assert got == [0.46326762450135917, 0.8986630927037076]


def test_mask(spark):
    table(spark, [("12,345,678.90", "1*,***,***.**"), ("123", "1**"), ("-1234.5", "-1,***.**"), ("", ""), ("9999", "9,***")], amount.mask("v"))


def test_rounding(spark):
    df = spark.createDataFrame([(1.005, 2), (2.5, 0), (-2.5, 0), (0.0, 2)], "x double, n int")
    assert [r.y for r in df.select(amount.round_half_up(F.col("x"), F.col("n")).alias("y")).collect()] == [1.0, 3.0, -3.0, 0.0]


def test_to_numeric(spark):
    table(spark, [("22亿元", "22"), ("12.35百万元", "12.35"), ("1**", "1**"), ("1,000.50", "1000.5"), ("5万", "5万")], amount.to_numeric_text("v"))


def test_names_and_accounts(spark):
    table(spark, [("张三", "张*"), ("欧阳修", "欧**"), ("John Smith", "J* *"), ("张", "张"), ("Madonna", "M******"), ("", "")], identity.mask_name("v"))
    table(spark, [("6222021234567890123", "622************0123"), ("12345", "12345"), ("", ""), ("HT-2024-001234", "HT-2***-**1234"), ("6222021234567890", "622*********7890")], identity.mask_account("v"))


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(st.characters(codec="utf-8", exclude_characters="​‌\x00"), max_size=30), min_size=1, max_size=5))
def test_marks_round_trip(spark, texts):
    assert run(spark, texts, identity.decode_mark(F.concat(F.lit("a"), identity.encode_mark("v")))) == [t or None for t in texts]
    marked = run(spark, texts, identity.embed_mark("v", F.lit("p")))
    assert all((m == t) == (len(t.encode()) < 20) for m, t in zip(marked, texts, strict=True))


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text("0123456789AB -/", max_size=24), min_size=1, max_size=6))
def test_accounts_keep_their_shape(spark, texts):
    for t, m in zip(texts, run(spark, texts, identity.mask_account("v")), strict=True):
        t = t.strip()
        assert len(m) == len(t) and all((a in " -/") == (b in " -/") for a, b in zip(t, m, strict=True))


def test_marks(spark):
    assert [len(x) for x in run(spark, ["A", "é"], identity.encode_mark("v"))] == [8, 16]
    assert run(spark, ["​‌​‌", "none"], identity.decode_mark("v")) == [None, None]


def test_references(spark):
    df = spark.createDataFrame([(0, 0), (4, 1), (0, 26), (9, 701), (9, 702), (1, 16383)], "r int, c int")
    assert [r.x for r in df.select(identity.coordinate("r", "c").alias("x")).collect()] == ["A1", "B5", "AA1", "ZZ10", "AAA10", "XFD2"]
    table(spark, [("A1:B2", (0, 0, 1, 1)), ("A1", None), ("AA10:AB11", (9, 26, 10, 27)), ("x:y", None)], identity.range_of("v"))
    table(spark, [("R2C3", (2, 3)), ("RC", None)], identity.table_place("v"))
    table(spark, [("ppt/slides/slide12.xml", 12), ("ppt/slides/slide.xml", None)], identity.slide_number("v"))


def test_aliases(spark):
    rows = [(i, v) for i, v in enumerate(["first", "second", "first", "", None] + [f"v{k}" for k in range(30)])]
    df = spark.createDataFrame(rows, "ord int, v string")
    got = {(r.v, r.alias) for r in alias.with_alias(df, "v", "ord").collect()}
    assert {("first", "[公司A]"), ("second", "[公司B]"), ("", ""), (None, None), ("v23", "[公司Z]"), ("v24", "[公司AA]")} <= got
    assert len({a for v, a in got if v}) == 32


def test_shift_and_scale(spark):
    df = spark.createDataFrame([(10.0,), (25.0,), (70.0,)], "x double")
    a = [r.shifted for r in amount.differential_shift(df, "x", 3).collect()]
    assert [round(y - x, 9) for x, y in zip(a, a[1:], strict=False)] == [15.0, 45.0]
    b = [r.scaled for r in amount.proportional_scale(df, "x", 3).collect()]
    assert b[1] / b[0] == pytest.approx(2.5) and 0.9 <= b[0] / 10 < 1.1
    assert amount.differential_shift(df.limit(0), "x", 3).count() == 0


def test_dispatch_defaults_and_errors(spark):
    rows = [(1, "12345678", "precision", None), (2, "x", "precision", None), (3, "5", "nothing", None), (4, "Acme", "alias", '{"prefix":"客户"}'), (5, "Acme", "alias", None), (6, "王小明", "mask_name", '{"keep_first":2}'), (7, "1234567890", "mask_account", '{"keep_prefix":"a","char":"#"}'), (8, None, "mask", None), (9, "5", "precision", '{"unit":"trillion"}'), (10, "", "alias", None)]
    got = {r.ord: (r.redacted, r.error) for r in dispatch.redact(spark.createDataFrame(rows, "ord long, value string, action string, params string")).collect()}
    assert got[1][0] == "12.35百万元" and got[4][0] == got[5][0] == "[客户A]" and got[6][0] == "王小*" and got[7][0] == "123###7890" and got[10] == ("", None)
    assert "not an amount" in got[2][1] and "unknown action" in got[3][1] and "unknown unit" in got[9][1]


def test_functions_by_name(spark):
    df = spark.createDataFrame([("张三", "1,234")], "n string, a string")
    register.view(df, "people", masked=("mask_name", "n"), amount=("parse_amount", "a"))
    assert spark.sql("SELECT masked, amount FROM people").first() == ("张*", 1234.0)


def test_large_amounts_keep_their_digits(spark):
    """A double near 9.1e14 is written as it is, by eighths, not by its shortest text."""
    table(spark, [("909955422195631329054", "909955422195631.38百万元"), ("-909955422195631329054", "-909955422195631.38百万元"), ("12345678", "12.35百万元")], amount.precision("v"))
    table(spark, [("9007199254740993", "9,007,199,254,740,992.00"), ("99999999999999.99", "99,999,999,999,999.98")], amount.perturb("v", 0))
