"""Names, accounts, cell references and invisible marks. All are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilframe.functions.amount import col

CJK = r"[\x{4E00}-\x{9FFF}]"
# The two characters of an invisible mark, for bits 0 and 1.
ZERO, ONE = "​", "‌"
EMBED_BYTES = 20


def stars(n: Column) -> Column:
    return F.repeat(F.lit("*"), F.greatest(n, F.lit(0)))


def mask_name(value: Column | str, keep_first: int | Column = 1) -> Column:
    """Han names keep their first characters, several words an initial and a star each, one word its first letters."""
    name, keep_first = F.trim(col(value)), keep_first if isinstance(keep_first, Column) else F.lit(keep_first)
    head, n = F.left(name, keep_first), F.length(name)
    first = F.substring_index(name, " ", 1)
    more = F.size(F.filter(F.split(name, r"\s+"), lambda w: w != "")) - 1
    words = F.concat(F.left(first, keep_first), F.lit("*"), F.repeat(F.lit(" *"), more))
    return F.when(n <= keep_first, name).when(name.rlike("^" + CJK), F.concat(head, stars(n - keep_first))).when(F.contains(name, F.lit(" ")), words).otherwise(F.concat(head, stars(n - keep_first)))


def mask_account(value: Column | str, keep_prefix: int = 3, keep_suffix: int = 4, char: str = "*") -> Column:
    """Characters that aren't separators are masked but for some at both ends; separators stay where they are."""
    text = F.trim(col(value))
    clean = F.length(F.translate(text, " -/", ""))
    parts = F.filter(F.split(text, ""), lambda x: x != "")
    start = F.struct(F.lit(0).alias("k"), F.lit("").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        separator = x.isin(" ", "-", "/")
        shown = F.when(separator | (acc["k"] < keep_prefix) | (acc["k"] >= clean - keep_suffix), x).otherwise(F.lit(char))
        return F.struct((acc["k"] + F.when(separator, 0).otherwise(1)).alias("k"), F.concat(acc["out"], shown).alias("out"))

    return F.when(clean <= keep_prefix + keep_suffix, text).otherwise(F.aggregate(parts, start, step, lambda acc: acc["out"]))


def alias_letters(n: Column) -> Column:
    """1 is A, 26 is Z, 27 is AA: letters without a zero."""
    start = F.struct(n.cast("bigint").alias("rest"), F.lit("").alias("out"))

    def step(acc: Column, _: Column) -> Column:
        rest = acc["rest"]
        letter = F.concat(F.chr(F.pmod(rest - 1, F.lit(26)) + 65), acc["out"])
        return F.struct(F.when(rest > 0, F.floor((rest - 1) / 26)).otherwise(rest).alias("rest"), F.when(rest > 0, letter).otherwise(acc["out"]).alias("out"))

    # Fourteen letters are more than a long has.
    return F.aggregate(F.sequence(F.lit(1), F.lit(14)), start, step, lambda acc: acc["out"])


def column_letters(index: Column | str) -> Column:
    """A column's letters from its index: 0 is A."""
    return alias_letters(col(index) + 1)


def coordinate(row: Column | str, column: Column | str) -> Column:
    return F.concat(column_letters(column), (col(row) + 1).cast("string"))


def column_index(letters: Column) -> Column:
    codes = F.transform(F.filter(F.split(letters, ""), lambda x: x != ""), lambda x: F.ascii(x) - 64)
    return F.aggregate(codes, F.lit(0), lambda acc, x: acc * 26 + x) - 1


def cell_of(ref: Column) -> Column:
    """struct<row, column>, from 0; null if it isn't a cell reference."""
    good = ref.rlike(r"^\$?[A-Z]{1,3}\$?[1-9][0-9]{0,6}$")
    letters, digits = F.regexp_extract(ref, "([A-Z]+)", 1), F.regexp_extract(ref, "([0-9]+)$", 1)
    return F.when(good, F.struct((digits.try_cast("int") - 1).alias("row"), column_index(letters).alias("column")))


def range_of(ref: Column | str) -> Column:
    """struct<r0, c0, r1, c1> of a range such as A1:B2; null without a colon."""
    text = col(ref)
    a, b = cell_of(F.substring_index(text, ":", 1)), cell_of(F.substring_index(text, ":", -1))
    return F.when(F.contains(text, F.lit(":")) & a.isNotNull() & b.isNotNull(), F.struct(a["row"].alias("r0"), a["column"].alias("c0"), b["row"].alias("r1"), b["column"].alias("c1")))


def table_place(text: Column | str) -> Column:
    """struct<row, column> of R2C3, from 1, else null."""
    x = col(text)
    return F.when(x.rlike("^R[0-9]+C[0-9]+$"), F.struct(F.regexp_extract(x, "^R([0-9]+)", 1).try_cast("int").alias("row"), F.regexp_extract(x, "C([0-9]+)$", 1).try_cast("int").alias("column")))


def slide_number(path: Column | str) -> Column:
    return F.nullif(F.regexp_extract(col(path), r"^ppt/slides/slide([0-9]+)\.xml$", 1), F.lit("")).try_cast("int")


def encode_mark(text: Column | str) -> Column:
    """The text's bytes as invisible characters, the highest bit first."""
    raw = F.hex(F.encode(col(text), "UTF-8"))
    nibbles = F.filter(F.split(raw, ""), lambda x: x != "")
    bits = F.array_join(F.transform(nibbles, lambda x: F.lpad(F.conv(x, 16, 2), 4, "0")), "")
    return F.translate(bits, "01", ZERO + ONE)


def decode_mark(text: Column | str) -> Column:
    """What the text's invisible characters say, whole bytes only; null if there are none or it isn't UTF-8."""
    marks = F.translate(F.regexp_replace(col(text), f"[^{ZERO}{ONE}]", ""), ZERO + ONE, "01")
    whole = F.floor(F.length(marks) / 8).cast("int")
    octets = F.transform(F.when(whole > 0, F.sequence(F.lit(0), whole - 1)).otherwise(F.array().cast("array<int>")), lambda i: F.lpad(F.conv(F.substr(marks, i * 8 + 1, F.lit(8)), 2, 16), 2, "0"))
    return F.when(whole > 0, F.try_validate_utf8(F.unhex(F.array_join(octets, "")).cast("string")))


def embed_mark(text: Column | str, payload: Column | str) -> Column:
    """The text with the mark behind it; texts of fewer than 20 bytes stay as they are."""
    return F.when(F.octet_length(col(text)) < EMBED_BYTES, col(text)).otherwise(F.concat(col(text), encode_mark(payload)))


def mark_payload(operator: Column, timestamp: Column, file_hash: Column) -> Column:
    return F.concat_ws("|", operator, timestamp, F.left(file_hash, F.lit(16)))
