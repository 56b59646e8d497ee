"""Amounts: parsing, rounding, formatting, and the masking functions on them. All are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Unit words in the order in which they are looked for, and their factors.
UNITS = {"万亿": 1e12, "亿": 1e8, "百万": 1e6, "万": 1e4, "千": 1e3}
# Target units of precision(), their factors and labels.
TARGETS = {"thousand": (1e3, "千"), "million": (1e6, "百万"), "billion": (1e9, "亿")}
YUAN = "元"
FNV_BASIS = 0xCBF29CE484222325
LOW = 0xFFFFFFFF
NUMBER = r"^[+-]?((?i:inf|infinity|nan)|[0-9]+\.?[0-9]*([eE][+-]?[0-9]+)?|\.[0-9]+([eE][+-]?[0-9]+)?)$"


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(x: Column, f) -> Column:
    """f(x) with x evaluated once, however often f names it: keeps nested expressions from growing."""
    return F.element_at(F.transform(F.array(x), f), 1)


def strict_double(text: Column) -> Column:
    """The number that a text is, else null; no suffixes and no blanks, unlike a cast."""
    return F.nullif(F.regexp_extract(text, NUMBER, 0), F.lit("")).try_cast("double")


def plain(value: Column | str) -> Column:
    """Trimmed, without thousands separators and spaces."""
    return F.replace(F.replace(F.trim(col(value)), F.lit(","), F.lit("")), F.lit(" "), F.lit(""))


def before(text: Column, word: str) -> Column:
    return F.substring_index(text, word, 1)


def first_unit(clean: Column, of_unit, otherwise: Column) -> Column:
    """of_unit(word) for the first unit word in the text."""
    out = otherwise
    for word in reversed(UNITS):
        out = F.when(F.contains(clean, F.lit(word)), of_unit(word)).otherwise(out)
    return out


def parse_number(value: Column | str) -> Column:
    """Text to double, with unit words and a trailing currency word; null if it isn't an amount."""

    def of(clean: Column) -> Column:
        factor = first_unit(clean, lambda w: F.lit(UNITS[w]), F.lit(1.0))
        number = first_unit(clean, lambda w: before(clean, w), clean)
        return strict_double(F.regexp_replace(number, f"{YUAN}+$", "")) * factor

    return let(plain(value), of)


def extract_unit(value: Column | str) -> Column:
    """struct<number string, unit string>."""

    def pair(number: Column, unit: Column) -> Column:
        return F.struct(number.alias("number"), unit.alias("unit"))

    def of(clean: Column) -> Column:
        def of_unit(word: str) -> Column:
            follows = F.startswith(F.substr(clean, F.locate(word, clean) + len(word)), F.lit(YUAN))
            return pair(before(clean, word), F.when(follows, F.lit(word + YUAN)).otherwise(F.lit(word)))

        tail = F.when(F.endswith(clean, F.lit(YUAN)), pair(F.substr(clean, F.lit(1), F.length(clean) - 1), F.lit(YUAN))).otherwise(pair(clean, F.lit("")))
        return first_unit(clean, of_unit, tail)

    return let(plain(value), of)


def round_half_up(x: Column, places: int | Column) -> Column:
    """Halves away from zero, on the double times a power of ten."""
    f = F.pow(F.lit(10.0), places) if isinstance(places, Column) else F.lit(float(10**places))
    y = x * f
    return F.when(F.abs(y) < 9e18, F.when(y >= 0, F.floor(y + 0.5)).otherwise(F.ceil(y - 0.5)).cast("double") / f).otherwise(x)


def format_amount(x: Column, places: int | Column = 2) -> Column:
    """With thousands separators; minus zero as zero."""
    n = places if isinstance(places, Column) else F.lit(places)
    x = round_half_up(x, places) + F.lit(0.0)
    short = F.call_function("format_number", x, n)
    # Large doubles have more digits than their shortest text: whole and fraction are written apart, as they are.
    size, f = F.abs(x), F.pow(F.lit(10.0), n)
    whole = F.when((size * f >= 2.0**52) & (size < 9e18) & (n <= 15), F.floor(size))
    part = F.rint((size - whole) * f).cast("bigint")
    carry = part >= f
    digits = F.lpad(F.when(carry, F.lit(0)).otherwise(part).cast("string"), n, "0")
    exact = F.concat(F.when(x < 0, F.lit("-")).otherwise(F.lit("")), F.call_function("format_number", whole + carry.cast("bigint"), F.lit(0)), F.when(n > 0, F.concat(F.lit("."), digits)).otherwise(F.lit("")))
    return F.coalesce(exact, short)


def precision(value: Column | str, unit: str | Column = "million", places: int | Column = 2) -> Column:
    """A rounder amount: whole numbers of its own unit, else decimals of the target unit; null if it can't be."""
    unit, places = unit if isinstance(unit, Column) else F.lit(unit), places if isinstance(places, Column) else F.lit(places)
    label, factor = F.lit(""), F.lit(None).cast("double")
    for name, (f, text) in TARGETS.items():
        label, factor = F.when(unit == name, text).otherwise(label), F.when(unit == name, F.lit(f)).otherwise(factor)

    def of(row: Column) -> Column:
        own, x = row["own"], row["x"]
        in_unit = F.concat(round_half_up(strict_double(own["number"]), 0).cast("bigint").cast("string"), own["unit"])
        zero = F.concat(F.lit("0."), F.repeat(F.lit("0"), places), label, F.lit(YUAN))
        scaled = F.concat(F.replace(format_amount(x / factor, places), F.lit(","), F.lit("")), label, F.lit(YUAN))
        return F.when(own["unit"] != "", in_unit).otherwise(F.when(x == 0, zero).otherwise(scaled))

    return let(F.struct(extract_unit(value).alias("own"), parse_number(value).alias("x")), of)


def fnv1a(text: Column | str) -> Column:
    """64-bit hash of the UTF-8 bytes as a long's bits, in 32-bit halves so that nothing overflows."""
    raw = F.encode(col(text), "UTF-8")
    codes = F.when(F.octet_length(raw) > 0, F.sequence(F.lit(1), F.octet_length(raw))).otherwise(F.array().cast("array<int>"))
    start = F.struct(F.lit(FNV_BASIS >> 32).alias("hi"), F.lit(FNV_BASIS & LOW).alias("lo"))

    def step(acc: Column, i: Column) -> Column:
        low = acc["lo"].bitwiseXOR(F.conv(F.hex(F.substring(raw, i, F.lit(1))), 16, 10).cast("bigint"))
        # The prime is 2 ** 40 + 435.
        t = low * 435
        high = (acc["hi"] * 435 + F.shiftrightunsigned(t, 32) + F.shiftleft(low, 8).bitwiseAND(F.lit(LOW))).bitwiseAND(F.lit(LOW))
        return F.struct(high.alias("hi"), t.bitwiseAND(F.lit(LOW)).alias("lo"))

    return F.aggregate(codes, start, step, lambda acc: F.shiftleft(acc["hi"], 32).bitwiseOR(acc["lo"]))


def unit_random(seed: Column) -> Column:
    """One step of the generator from a seed's bits: a double from 0 to 1."""
    # seed + 1 by halves, as the largest long has no successor; zero isn't a state.
    nxt = F.when(seed == F.lit(2**63 - 1), F.lit(-(2**63))).otherwise(seed + 1)
    first = F.when(nxt == 0, F.lit(1).cast("bigint")).otherwise(nxt)
    second = let(first, lambda s: s.bitwiseXOR(F.shiftleft(s, 13)))
    third = let(second, lambda s: s.bitwiseXOR(F.shiftrightunsigned(s, 7)))
    last = let(third, lambda s: s.bitwiseXOR(F.shiftleft(s, 17)))
    return F.shiftrightunsigned(last, 11).cast("double") / F.lit(float(2**53))


def perturb(value: Column | str, percentage: float | Column = 5.0) -> Column:
    """The amount changed by at most the percentage, the same way each time; null if it can't be."""
    p = percentage if isinstance(percentage, Column) else F.lit(float(percentage))
    row = F.struct(parse_number(value).alias("x"), let(fnv1a(value), unit_random).alias("u"), p.alias("p"))
    return let(row, lambda r: F.when(r["p"].between(0, 100), format_amount(r["x"] + r["x"] * (r["p"] / 100.0) * (r["u"] * 2 - 1), 2)))


def grouped(digits: Column) -> Column:
    """A comma before each three characters from the right."""
    return F.reverse(F.regexp_replace(F.reverse(digits), "(?s)(.{3})(?=.)", "$1,"))


def mask(value: Column | str) -> Column:
    """Sign, first digit and separators stay, all else is starred."""
    text = F.trim(col(value))
    minus = F.startswith(text, F.lit("-"))
    clean = F.replace(F.when(minus, F.substr(text, F.lit(2))).otherwise(text), F.lit(","), F.lit(""))
    whole = F.substring_index(clean, ".", 1)
    starred = F.concat(F.left(whole, F.lit(1)), F.repeat(F.lit("*"), F.greatest(F.length(whole) - 1, F.lit(0))))
    starred = F.when(F.octet_length(starred) > 3, grouped(starred)).otherwise(starred)
    return F.concat(F.when(minus, F.lit("-")).otherwise(F.lit("")), starred, F.when(F.contains(clean, F.lit(".")), F.lit(".**")).otherwise(F.lit("")))


def to_numeric_text(value: Column | str) -> Column:
    """The number in a masked amount as plain text (its unit isn't applied), else the text as it is."""

    def of(row: Column) -> Column:
        n = row["n"]
        whole = (n == F.floor(n)) & (F.abs(n) < 9e15)
        text = F.when(whole, n.cast("bigint").cast("string")).otherwise(F.regexp_replace(F.regexp_replace(n.cast("decimal(38,12)").cast("string"), "0+$", ""), r"\.$", ""))
        return F.coalesce(text, row["v"])

    def with_number(v: Column) -> Column:
        x = v
        for word in (",", YUAN, "百万", "亿", "千", " "):
            x = F.replace(x, F.lit(word), F.lit(""))
        return let(F.struct(v.alias("v"), strict_double(x).alias("n")), of)

    return let(col(value), with_number)


def seeded_unit(seed: int) -> float:
    """unit_random() of a seed, on the driver."""
    bits = (1 << 64) - 1
    s = max(1, (seed + 1) & bits)
    for left, n in ((True, 13), (False, 7), (True, 17)):
        s ^= (s << n & bits) if left else s >> n
    return (s >> 11) / 2.0**53


def differential_shift(df: DataFrame, value: str, seed: int, out: str = "shifted") -> DataFrame:
    """All values plus one offset, so that differences stay; no value changes its sign by it."""
    most = df.agg(F.least(F.avg(F.abs(value)) * 0.1, F.min(value) * 0.9).alias("_most"))
    return df.crossJoin(F.broadcast(most)).withColumn(out, F.col(value) + F.col("_most") * F.lit(2 * seeded_unit(seed) - 1)).drop("_most")


def proportional_scale(df: DataFrame, value: str, seed: int, out: str = "scaled") -> DataFrame:
    """All values times one factor from 0.9 to 1.1, so that ratios stay."""
    return df.withColumn(out, F.col(value) * F.lit(0.9 + 0.2 * seeded_unit(seed)))
