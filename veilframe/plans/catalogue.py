"""Registered queries and their SQL oracles.

Inputs that the tables don't hold (amounts with units, headers, grids) are derived from them by SQL that both engines
run, so the operators see whole tables.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veilframe.functions import amount, identity
from veilframe.operators import alias, apply, classify, detect, dispatch, headers, rules, scan

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def given(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """SQL over the tables, without registering views."""
    used = {t for t in TABLES if re.search(rf"\b(?:FROM|JOIN) {t}\b", sql)}
    text = sql.replace("{", "{{").replace("}", "}}")
    text = re.sub(r"\b(FROM|JOIN) (\w+)\b", lambda m: f"{m[1]} {{{m[2]}}}" if m[2] in used else m[0], text)
    return spark.sql(text, **{t: table(spark, sf_dir, t) for t in used})


def query(name: str, source: str, oracle: str | None = None):
    """Registers a function of the derived input; in the oracle, ``input`` is that input."""

    def add(f: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: f(given(spark, sf_dir, source))
        if oracle is not None:
            ORACLES[name] = f"WITH input AS ({source}) {oracle}" if not oracle.lstrip().upper().startswith("WITH") else f"WITH input AS ({source}), {oracle.lstrip()[4:]}"
        return f

    return add


# ---------------------------------------------------------------- text scan

DOCS = "SELECT doc_id, text FROM documents"
INT_HITS = r"list_filter(list_transform(regexp_extract_all(text, '-?\d{5,}%?'), lambda v: CASE WHEN v LIKE '%\%' ESCAPE '\' THEN left(v, length(v) - 2) ELSE v END), lambda v: length(ltrim(v, '-')) >= 5)"
ACCOUNT, CONTRACT = r"\d{4}[\s-]?\d{4}[\s-]?\d{4}[\s-]?\d{4,}", r"[A-Za-z]{2,4}[-/]?\d{4}[-/]?\d{4,}"


def values_of(df: DataFrame, spans) -> DataFrame:
    return df.withColumn("h", spans).filter(F.size("h") > 0).select("doc_id", F.size("h").alias("n"), F.array_join(F.transform("h", lambda x: x["value"]), ";").alias("found"))


@query("scan_int_amounts", DOCS, f"SELECT doc_id, CAST(len(h) AS INT) AS n, array_to_string(h, ';') AS found FROM (SELECT doc_id, {INT_HITS} AS h FROM input) WHERE len(h) > 0")
def _(df):
    return values_of(df, detect.regex_spans(F.col("text"), rules.PATTERNS[4].pattern))


for _name, _i, _p in (("scan_accounts", 8, ACCOUNT), ("scan_contracts", 9, CONTRACT)):

    @query(_name, DOCS, f"SELECT doc_id, CAST(len(h) AS INT) AS n, array_to_string(h, ';') AS found FROM (SELECT doc_id, regexp_extract_all(text, '{_p}') AS h FROM input) WHERE len(h) > 0")
    def _(df, i=_i):
        return values_of(df, detect.regex_spans(F.col("text"), rules.PATTERNS[i].pattern))


DEC = "CAST(CAST({} AS DECIMAL(18,2)) AS STRING)"
PRICE = DEC.format("o_totalprice")
UNIT_TEXT = f"SELECT o_orderkey AS doc_id, concat('合同 ', {PRICE}, '万元，共 ', CAST(o_custkey % 900 AS STRING), ' 千') AS text FROM orders"


@query("scan_unit_amounts", UNIT_TEXT, r"SELECT doc_id, CAST(len(h) AS INT) AS n, array_to_string(h, ';') AS found FROM (SELECT doc_id, regexp_extract_all(text, '-?\d{1,3}(?:,\d{3})*(?:\.\d+)?\s*(?:万亿|亿|百万|万|千)元?') AS h FROM input) WHERE len(h) > 0")
def _(df):
    return values_of(df, detect.regex_spans(F.col("text"), rules.PATTERNS[0].pattern))


@query("scan_places", UNIT_TEXT, "SELECT doc_id, CAST(strpos(text, '共') + 1 AS INT) AS start, CAST(length(text) AS INT) AS stop, substring(text, strpos(text, '共') + 2) AS value FROM input")
def _(df):
    last = F.element_at(detect.regex_spans(F.col("text"), rules.PATTERNS[0].pattern), -1)
    return df.select("doc_id", last["start"].alias("start"), last["end"].alias("stop"), last["value"].alias("value"))


MIXED = f"SELECT o_orderkey AS doc_id, concat('客户 ', CASE WHEN o_orderkey % 3 = 0 THEN '四川措拉' ELSE '奎纳' END, ' 付 ', CAST(10000 + o_custkey AS STRING), '，账号 6222 0202 0000 1234 ', CASE WHEN o_orderkey % 2 = 0 THEN '，编号 HT20240001' ELSE '' END) AS text FROM orders"


@query(
    "scan_suppressed", MIXED,
    """SELECT doc_id, concat_ws(';', concat('entity_dict:', CASE WHEN text LIKE '%四川措拉%' THEN '四川措拉' ELSE '奎纳' END), concat('amount_no_commas_int:', regexp_extract(text, '付 (\\d+)', 1)),
       CASE WHEN text LIKE '%HT20240001%' THEN 'amount_no_commas_int:20240001' END, 'bank_account:6222 0202 0000 1234') AS found FROM input""",
)
def _(df):
    hits = detect.scan_text(F.col("text"))
    return df.select("doc_id", F.array_join(F.transform(hits, lambda x: F.concat(x["rule"], F.lit(":"), x["value"])), ";").alias("found"))


@query("dict_hits", "SELECT c_custkey, c_mktsegment FROM customer", """SELECT c_custkey, CAST(strpos(c_mktsegment, w) - 1 AS INT) AS start, w AS value FROM input, (VALUES ('BUILD'), ('HOUSE'), ('MACHINE')) AS t(w) WHERE strpos(c_mktsegment, w) > 0""")
def _(df):
    # MACHINE ends before MACHINERY does, so it shadows the longer word and what overlaps it.
    hits = detect.dictionary_spans(F.col("c_mktsegment"), ("BUILD", "HOUSE", "MACHINE", "MACHINERY", "CHINERY"))
    return df.select("c_custkey", F.explode(hits).alias("h")).select("c_custkey", "h.start", "h.value")


@query("dict_hits_large", "SELECT c_custkey, c_name FROM customer", "SELECT c_custkey, CAST(8 AS INT) AS start, substring(c_name, 9) AS value FROM input WHERE c_custkey % 3 = 0 AND c_custkey < 3000")
def _(df):
    words = tuple(f"#{i:09d}" for i in range(0, 3000, 3))
    hits = detect.dictionary_column(words)(F.col("c_name"))
    return df.select("c_custkey", F.explode(hits).alias("h")).select("c_custkey", "h.start", "h.value")


@query("short_number_guard", f"SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_custkey AS STRING) WHEN o_orderkey % 3 = 1 THEN '1,2' ELSE {PRICE} END AS v FROM orders", r"SELECT o_orderkey, regexp_full_match(v, '[\d,.\-]+') AND length(replace(replace(v, ',', ''), '-', '')) < 4 AS is_short FROM input")
def _(df):
    return df.select("o_orderkey", detect.is_short_number(F.col("v")).alias("is_short"))


@query("value_extraction", "SELECT o_orderkey, concat('金额 ', CAST(20000 + o_orderkey AS STRING), ' 已付') AS v FROM orders", r"SELECT o_orderkey, regexp_extract(v, '\d+') AS amount_value, v AS person_value FROM input")
def _(df):
    return df.select("o_orderkey", detect.value_in(F.col("v"), "amount").alias("amount_value"), detect.value_in(F.col("v"), "person").alias("person_value"))


@query("strategy_search", DOCS, "SELECT doc_id FROM input WHERE contains(lower(text), 'pass')")
def _(df):
    return df.filter(F.contains(F.lower("text"), F.lower(F.lit("PASS")))).select("doc_id")


# ---------------------------------------------------------------- headers and actions

HEADERS = "SELECT n_nationkey, CASE n_nationkey % 9 WHEN 0 THEN '营业收入' WHEN 1 THEN ' 账号 ' WHEN 2 THEN '2024年上半年' WHEN 3 THEN '本期金额' WHEN 4 THEN '其他收入' WHEN 5 THEN n_name WHEN 6 THEN '' WHEN 7 THEN '合同金额' ELSE '净利润率' END AS h FROM nation"


def header_case() -> str:
    """The rule chain as SQL."""
    out = []
    for kind in ("exact", "regex"):
        for i, r in rules.in_order(rules.COLUMNS):
            if r.match_type == kind:
                test = f"trim(h) = '{r.pattern}'" if kind == "exact" else f"regexp_matches(trim(h), '{r.pattern}')"
                out.append(f"WHEN {test} THEN {i}")
    return f"CASE WHEN trim(h) = '' THEN NULL {' '.join(out)} END"


@query("header_match", HEADERS, f"SELECT n_nationkey, CAST({header_case()} AS INT) AS rule FROM input")
def _(df):
    return df.select("n_nationkey", rules.match_header(F.col("h")).alias("rule"))


KINDS = "SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 'amount' WHEN 1 THEN 'entity' WHEN 2 THEN 'person' WHEN 3 THEN 'account' ELSE 'other' END AS kind FROM part"


@query("default_action", KINDS, """SELECT p_partkey, CASE kind WHEN 'amount' THEN 'precision' WHEN 'entity' THEN 'alias' WHEN 'person' THEN 'mask_name' WHEN 'account' THEN 'mask_account' END AS action,
    CASE kind WHEN 'amount' THEN '{"unit": "million", "decimal_places": 2}' WHEN 'entity' THEN '{"prefix": "公司"}' WHEN 'account' THEN '{"keep_prefix": 3, "keep_suffix": 4}' END AS params FROM input""")
def _(df):
    return df.withColumn("a", rules.default_action(F.col("kind"))).select("p_partkey", "a.action", "a.params")


@query("allowed_actions", KINDS, "SELECT p_partkey, kind = 'amount' AS may_perturb, kind IN ('entity', 'person') AS may_alias FROM input")
def _(df):
    ok = lambda action: F.coalesce(F.array_contains(F.create_map(*[x for k, v in rules.ALLOWED.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])[F.col("kind")], action), F.lit(False))
    return df.select("p_partkey", ok("perturb").alias("may_perturb"), ok("alias").alias("may_alias"))


QUERIES["column_rules"] = lambda spark, sf_dir: rules.column_rules_df(spark).groupBy("match_type", "action").agg(F.count("*").alias("n"))
ORACLES["column_rules"] = "SELECT * FROM (VALUES " + ", ".join(f"('{m}', '{a}', {sum((r.match_type, r.action) == (m, a) for r in rules.COLUMNS)})" for m, a in sorted({(r.match_type, r.action) for r in rules.COLUMNS})) + ") AS t(match_type, action, n)"


@query("dictionary_normal", "SELECT doc_id, source FROM documents", "SELECT trim(source) AS word, min(doc_id) AS first_ord FROM input WHERE trim(source) <> '' GROUP BY 1")
def _(df):
    return df.select(F.trim("source").alias("word"), "doc_id").filter("word <> ''").groupBy("word").agg(F.min("doc_id").alias("first_ord"))


# ---------------------------------------------------------------- amounts

AMOUNTS = f"""SELECT o_orderkey AS k, CASE o_orderkey % 9 WHEN 0 THEN {PRICE} WHEN 1 THEN concat({PRICE}, '亿元') WHEN 2 THEN concat('-', {PRICE}, ' 万亿') WHEN 3 THEN concat({PRICE}, '百万元')
  WHEN 4 THEN concat({PRICE}, '千') WHEN 5 THEN concat({PRICE}, '元') WHEN 6 THEN '3千万' WHEN 7 THEN '1d' ELSE '0' END AS v FROM orders"""
NUM = "try_cast(regexp_extract(replace(replace(v, ',', ''), ' ', ''), '^-?[0-9.]+') AS DOUBLE)"
PARSED = f"CASE k % 9 WHEN 0 THEN {NUM} WHEN 1 THEN {NUM} * 1e8 WHEN 2 THEN {NUM} * 1e12 WHEN 3 THEN {NUM} * 1e6 WHEN 4 THEN {NUM} * 1e3 WHEN 5 THEN {NUM} WHEN 8 THEN 0.0 END"
UNITS = "CASE k % 9 WHEN 1 THEN '亿元' WHEN 2 THEN '万亿' WHEN 3 THEN '百万元' WHEN 4 THEN '千' WHEN 5 THEN '元' WHEN 6 THEN '万' ELSE '' END"
HALF_UP = "CASE WHEN {0} >= 0 THEN floor({0} + 0.5) ELSE ceil({0} - 0.5) END"


@query("parse_number", AMOUNTS, f"SELECT k, {PARSED} AS x FROM input")
def _(df):
    return df.select("k", amount.parse_number("v").alias("x"))


@query("extract_unit", AMOUNTS, f"SELECT k, CASE WHEN k % 9 = 6 THEN '3千' WHEN k % 9 = 7 THEN '1d' ELSE regexp_extract(replace(v, ' ', ''), '^-?[0-9.]+') END AS number, {UNITS} AS unit FROM input")
def _(df):
    return df.withColumn("u", amount.extract_unit("v")).select("k", "u.number", "u.unit")


PRECISION = f"""CASE WHEN k % 9 IN (6, 7) THEN NULL WHEN k % 9 = 8 THEN '0.00百万元' WHEN k % 9 = 0 THEN concat(format('{{:.2f}}', {HALF_UP.format(f'({NUM} / 1e6 * 100.0)')} / 100.0), '百万元')
  ELSE concat(CAST(CAST({HALF_UP.format(f'({NUM})')} AS BIGINT) AS VARCHAR), {UNITS}) END"""


@query("precision", AMOUNTS, f"SELECT k, {PRECISION} AS redacted FROM input")
def _(df):
    return df.select("k", amount.precision("v").alias("redacted"))


@query("precision_units", f"SELECT o_orderkey AS k, {PRICE} AS v FROM orders", "SELECT k, concat(format('{:.1f}', floor(CAST(v AS DOUBLE) / 1e3 * 10.0 + 0.5) / 10.0), '千元') AS thousand, concat(format('{:.3f}', floor(CAST(v AS DOUBLE) / 1e9 * 1000.0 + 0.5) / 1000.0), '亿元') AS billion, CAST(NULL AS VARCHAR) AS unknown FROM input")
def _(df):
    return df.select("k", amount.precision("v", "thousand", 1).alias("thousand"), amount.precision("v", "billion", 3).alias("billion"), amount.precision("v", "trillion", 2).alias("unknown"))


@query("round_and_format", "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS x FROM lineitem", "SELECT l_orderkey, l_linenumber, floor(x * 10.0 + 0.5) / 10.0 AS rounded, format('{:,.2f}', floor(x * 100.0 + 0.5) / 100.0) AS formatted FROM input")
def _(df):
    return df.select("l_orderkey", "l_linenumber", amount.round_half_up(F.col("x"), 1).alias("rounded"), amount.format_amount(F.col("x"), 2).alias("formatted"))


PARTS = f"SELECT p_partkey AS k, {DEC.format('p_retailprice')} AS v FROM part"
TWO64 = "CAST(18446744073709551616 AS UHUGEINT)"
HASHED = f"SELECT k, v, list_reduce(list_prepend(CAST(14695981039346656037 AS UHUGEINT), list_transform(range(1, length(v) + 1), lambda i: CAST(ascii(substring(v, i, 1)) AS UHUGEINT))), lambda a, b: (xor(a, b) * CAST(1099511628211 AS UHUGEINT)) % {TWO64}) AS h FROM input"


@query("perturb", PARTS, f"""WITH a AS ({HASHED}), b AS (SELECT k, v, (h + 1) % {TWO64} AS s FROM a), c AS (SELECT k, v, xor(s, (s * 8192) % {TWO64}) AS s FROM b), d AS (SELECT k, v, xor(s, s // 128) AS s FROM c),
  e AS (SELECT k, v, xor(s, (s * 131072) % {TWO64}) AS s FROM d), f AS (SELECT k, CAST(v AS DOUBLE) AS x, CAST(s // 2048 AS DOUBLE) / 9007199254740992.0 AS u FROM e)
  SELECT k, format('{{:,.2f}}', floor((x + x * 0.05 * (u * 2.0 - 1.0)) * 100.0 + 0.5) / 100.0) AS redacted FROM f""")
def _(df):
    return df.select("k", amount.perturb("v", 5).alias("redacted"))


@query("fnv1a", PARTS, f"SELECT k, CAST(h AS VARCHAR) AS h FROM ({HASHED})")
def _(df):
    h = amount.fnv1a("v").cast("decimal(20,0)")
    return df.select("k", F.when(h < 0, h + F.lit(str(2**64)).cast("decimal(20,0)")).otherwise(h).cast("decimal(20,0)").cast("string").alias("h"))


@query("mask_amount", f"SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN {DEC.format('l_extendedprice')} ELSE concat('-', CAST(CAST(floor(l_extendedprice) AS BIGINT) AS STRING)) END AS v FROM lineitem", r"""SELECT l_orderkey, l_linenumber,
   concat(CASE WHEN v LIKE '-%' THEN '-' ELSE '' END, reverse(regexp_replace(reverse(concat(left(w, 1), repeat('*', length(w) - 1))), '(.{3})', '\1,', 'g')).ltrim(','), CASE WHEN v LIKE '%.%' THEN '.**' ELSE '' END) AS redacted
   FROM (SELECT *, split_part(ltrim(v, '-'), '.', 1) AS w FROM input)""")
def _(df):
    return df.select("l_orderkey", "l_linenumber", amount.mask("v").alias("redacted"))


@query("to_numeric", AMOUNTS, f"SELECT k, CASE WHEN k % 9 = 0 THEN CAST(CAST(floor({NUM} / 1e6 * 100.0 + 0.5) / 100.0 AS DECIMAL(18,2)) AS DOUBLE) WHEN k % 9 IN (1, 3, 4, 5) THEN {HALF_UP.format(f'({NUM})')} WHEN k % 9 = 8 THEN 0.0 END AS x FROM input")
def _(df):
    return df.select("k", amount.strict_double(amount.to_numeric_text(amount.precision("v"))).alias("x"))


ORDERS = "SELECT o_orderkey, o_totalprice FROM orders"


@query("differential_shift", ORDERS, f"SELECT o_orderkey, round(o_totalprice + (SELECT least(avg(abs(o_totalprice)) * 0.1, min(o_totalprice) * 0.9) FROM input) * {2 * amount.seeded_unit(7) - 1!r}, 2) AS shifted FROM input")
def _(df):
    return amount.differential_shift(df, "o_totalprice", 7).select("o_orderkey", F.round("shifted", 2).alias("shifted"))


@query("proportional_scale", ORDERS, f"SELECT o_orderkey, round(o_totalprice * {0.9 + 0.2 * amount.seeded_unit(7)!r}, 2) AS scaled FROM input")
def _(df):
    return amount.proportional_scale(df, "o_totalprice", 7).select("o_orderkey", F.round("scaled", 2).alias("scaled"))


# ---------------------------------------------------------------- names, accounts, references, marks


@query("mask_name", "SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN c_name WHEN 1 THEN concat('张', c_mktsegment) WHEN 2 THEN concat('John ', c_mktsegment, ' Smith') ELSE ' 王 ' END AS v FROM customer", """SELECT c_custkey, CASE c_custkey % 4 WHEN 2 THEN 'J* * *' WHEN 3 THEN '王' ELSE concat(left(v, 1), repeat('*', length(v) - 1)) END AS redacted FROM input""")
def _(df):
    return df.select("c_custkey", identity.mask_name("v").alias("redacted"))


ACCOUNTS = "SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN concat('6222', lpad(CAST(c_custkey AS STRING), 12, '0')) WHEN 1 THEN concat('HT-2024-', lpad(CAST(c_custkey AS STRING), 6, '0')) ELSE CAST(c_custkey AS STRING) END AS v FROM customer"
MASKED_ACCOUNT = "CASE c_custkey % 3 WHEN 0 THEN concat('622*********', right(v, 4)) WHEN 1 THEN concat('HT-2***-**', right(v, 4)) ELSE v END"


@query("mask_account", ACCOUNTS, f"SELECT c_custkey, {MASKED_ACCOUNT} AS redacted FROM input")
def _(df):
    return df.select("c_custkey", identity.mask_account("v").alias("redacted"))


LETTERS = "CASE WHEN {0} <= 26 THEN chr(64 + {0}) WHEN {0} <= 702 THEN concat(chr(64 + ({0} - 1) // 26), chr(65 + ({0} - 1) % 26)) ELSE concat(chr(65 + ({0} - 703) // 676), chr(65 + (({0} - 703) // 26) % 26), chr(65 + ({0} - 703) % 26)) END"


@query("alias_first_seen", "SELECT o_orderkey AS ord, o_orderpriority AS v FROM orders", "SELECT v, concat('[公司', chr(64 + CAST(row_number() OVER (ORDER BY o) AS INT)), ']') AS alias FROM (SELECT v, min(ord) AS o FROM input GROUP BY v)")
def _(df):
    return alias.aliases(df, "v", "ord").select(F.col("value").alias("v"), "alias")


@query("alias_rows", "SELECT c_custkey AS ord, c_name AS v, CASE WHEN c_nationkey < 10 THEN '客户' ELSE '公司' END AS p FROM customer", f"SELECT ord, concat('[', p, {LETTERS.format('n')}, ']') AS alias FROM (SELECT ord, p, CAST(row_number() OVER (PARTITION BY p ORDER BY ord) AS INT) AS n FROM input)")
def _(df):
    return alias.with_alias(df, "v", "ord", "p").select("ord", "alias")


@query("a1_ref", "SELECT o_orderkey AS r, o_custkey % 16384 AS c FROM orders", f"SELECT r, concat({LETTERS.format('n')}, CAST(r + 1 AS VARCHAR)) AS cell FROM (SELECT r, CAST(c + 1 AS INT) AS n FROM input)")
def _(df):
    return df.select("r", identity.coordinate("r", "c").alias("cell"))


@query("range_parse", "SELECT s_suppkey AS k, s_nationkey AS n FROM supplier", "SELECT k, CAST(k AS INT) AS r0, CAST(0 AS INT) AS c0, CAST(k + 1 AS INT) AS r1, CAST(26 + n % 26 AS INT) AS c1, CAST(k + 1 AS INT) AS table_row FROM input")
def _(df):
    ref = F.concat(F.lit("A"), (F.col("k") + 1).cast("string"), F.lit(":A"), F.chr(65 + F.pmod("n", F.lit(26))), (F.col("k") + 2).cast("string"))
    place = identity.table_place(F.concat(F.lit("R"), (F.col("k") + 1).cast("string"), F.lit("C2")))
    return df.withColumn("x", identity.range_of(ref)).select("k", "x.r0", "x.c0", "x.r1", "x.c1", place["row"].alias("table_row"))


BITS = "translate(list_aggregate(list_transform(range(1, length({0}) + 1), lambda i: lpad(bin(ascii(substring({0}, i, 1))), 8, '0')), 'string_agg', ''), '01', concat(chr(8203), chr(8204)))"


@query("watermark_encode", "SELECT doc_id, source AS v FROM documents", f"SELECT doc_id, {BITS.format('v')} AS mark FROM input")
def _(df):
    return df.select("doc_id", identity.encode_mark("v").alias("mark"))


@query("watermark_decode", "SELECT doc_id, concat(source, 'é', lang) AS v FROM documents", "SELECT doc_id, v AS decoded FROM input")
def _(df):
    return df.select("doc_id", identity.decode_mark(F.concat(F.lit("x"), identity.encode_mark("v"), F.lit("y"))).alias("decoded"))


@query("watermark_embed", "SELECT c_custkey AS k, CASE WHEN c_custkey % 2 = 0 THEN concat(c_name, 'é') ELSE c_name END AS v FROM customer", f"SELECT k, CASE WHEN octet_length(encode(v)) < 20 THEN v ELSE concat(v, {BITS.format(chr(39) + 'op|t' + chr(39))}) END AS marked FROM input")
def _(df):
    return df.select("k", identity.embed_mark("v", F.lit("op|t")).alias("marked"))


@query("watermark_payload", "SELECT doc_id, text FROM documents", "SELECT doc_id, concat_ws('|', 'op', '2024-01-01T00:00:00', left(sha256(text), 16)) AS payload FROM input")
def _(df):
    return df.select("doc_id", identity.mark_payload(F.lit("op"), F.lit("2024-01-01T00:00:00"), F.sha2("text", 256)).alias("payload"))


@query("sha256_text", "SELECT doc_id, text FROM documents", "SELECT doc_id, sha256(text) AS digest FROM input")
def _(df):
    return df.select("doc_id", F.sha2("text", 256).alias("digest"))


# ---------------------------------------------------------------- dispatch and execution

REQUESTS = f"""SELECT o_orderkey AS ord, {PRICE} AS value, CASE o_orderkey % 8 WHEN 0 THEN 'precision' WHEN 1 THEN 'perturb' WHEN 2 THEN 'mask' WHEN 3 THEN 'alias' WHEN 4 THEN 'mask_name' WHEN 5 THEN 'mask_account' WHEN 6 THEN 'differential_shift' ELSE 'precision' END AS action,
  CASE o_orderkey % 8 WHEN 7 THEN '{{"unit":"trillion"}}' WHEN 1 THEN CASE WHEN o_orderkey % 3 = 0 THEN '{{"percentage":200}}' ELSE '{{"percentage":0}}' END WHEN 5 THEN '{{"keep_prefix":1,"keep_suffix":"x"}}' END AS params FROM orders"""


@query(
    "dispatch_all", REQUESTS,
    """WITH n AS (SELECT value, concat('[公司', """ + LETTERS.format("i") + """, ']') AS a FROM (SELECT value, CAST(row_number() OVER (ORDER BY min(ord)) AS INT) AS i FROM input WHERE action = 'alias' GROUP BY value))
    SELECT ord, CASE ord % 8 WHEN 0 THEN concat(format('{:.2f}', floor(CAST(value AS DOUBLE) / 1e6 * 100.0 + 0.5) / 100.0), '百万元')
      WHEN 1 THEN CASE WHEN ord % 3 <> 0 THEN format('{:,.2f}', CAST(value AS DOUBLE)) END
      WHEN 2 THEN concat(reverse(regexp_replace(reverse(concat(left(value, 1), repeat('*', length(value) - 4))), '(.{3})', '\\1,', 'g')).ltrim(','), '.**')
      WHEN 3 THEN a WHEN 4 THEN concat(left(value, 1), repeat('*', length(value) - 1))
      WHEN 5 THEN CASE WHEN length(value) <= 5 THEN value ELSE concat(left(value, 1), repeat('*', length(value) - 5), right(value, 4)) END END AS redacted,
      ord % 8 IN (6, 7) OR (ord % 8 = 1 AND ord % 3 = 0) AS failed
    FROM input LEFT JOIN n USING (value)""",
)
def _(df):
    return dispatch.redact(df).select("ord", "redacted", F.col("error").isNotNull().alias("failed"))


CUSTOMERS = "SELECT c_custkey, c_name, c_mktsegment, c_acctbal FROM customer"
ONE_SHEET = "struct<file:string,sheet_idx:int,sheet:string>"


def long_cells(df: DataFrame, row, columns: list, sheet=None, sheet_idx=None) -> DataFrame:
    """A wide table as cells: columns are (kind, number, text) of each column; a null text is an empty cell."""
    parts = F.array(*[F.struct(F.lit(i).alias("col"), F.lit(k).alias("kind"), (n if n is not None else F.lit(None)).cast("double").alias("num"), t.cast("string").alias("text")) for i, (k, n, t) in enumerate(columns)])
    own = df.select(F.lit("book").alias("file"), (sheet_idx if sheet_idx is not None else F.lit(0)).cast("int").alias("sheet_idx"), (sheet if sheet is not None else F.lit("Sheet1")).alias("sheet"), row.cast("int").alias("row"), F.explode(parts).alias("x"))
    return own.select("file", "sheet_idx", "sheet", "row", "x.*").filter("text is not null")


def customer_sheet(df: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """cells, names and spans of the customers as a sheet: row 0 is the header."""
    account = F.concat(F.lit("6222"), F.lpad(F.col("c_custkey").cast("string"), 12, "0"))
    cells = long_cells(df, F.col("c_custkey") + 1, [("string", None, F.col("c_name")), ("string", None, account), ("string", None, F.col("c_mktsegment"))])
    spark = df.sparkSession
    names = spark.createDataFrame([("book", 0, "Sheet1", i, n) for i, n in enumerate(("客户名称", "账号", "备注"))], "file string, sheet_idx int, sheet string, col int, name string")
    spans = spark.createDataFrame([("book", 0, "Sheet1", 0, 0)], "file string, sheet_idx int, sheet string, header_start int, header_end int")
    return cells, names, spans


@query(
    "apply_column_rules", CUSTOMERS,
    f"""SELECT concat('A', CAST(c_custkey + 2 AS VARCHAR)) AS cell, c_name AS original, concat('[客户', {LETTERS.format('n')}, ']') AS redacted FROM (SELECT *, CAST(row_number() OVER (ORDER BY c_custkey) AS INT) AS n FROM input)
    UNION ALL SELECT concat('B', CAST(c_custkey + 2 AS VARCHAR)), concat('6222', lpad(CAST(c_custkey AS VARCHAR), 12, '0')), concat('622*********', right(lpad(CAST(c_custkey AS VARCHAR), 12, '0'), 4)) FROM input""",
)
def _(df):
    cells, names, spans = customer_sheet(df)
    asked = apply.of_column_rules(cells, names, spans, rules.column_rules_df(df.sparkSession))
    return apply.changes(asked).select("cell", "original", "redacted")


def document_sites(df: DataFrame) -> DataFrame:
    hits = detect.scan_table(df, ["doc_id"], ["text"])
    choice = rules.default_action(F.col("detected_type"))
    # By rule, then place, however long the text: fewer than 2^29 finds fit into one.
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("ord", "start", "value"))
    ord_ = F.shiftleft(F.col("doc_id").cast("bigint"), 29) + nth
    place = scan.excel_place(F.lit("docs"), F.concat(F.lit("A"), (F.col("doc_id") + 1).cast("string")))
    return hits.select(F.lit("book").alias("file"), "doc_id", ord_.alias("ord"), F.concat(F.lit("sheet_docs_A"), (F.col("doc_id") + 1).cast("string")).alias("site_id"), place.alias("location"), F.col("value").alias("original_value"), "detected_type", F.lit("fulltext_scan").alias("discovered_by"), F.lit(True).alias("enabled"), choice["action"].alias("action"), choice["params"].alias("params"))


@query(
    "apply_sites_first_per_cell", DOCS,
    rf"""SELECT concat('A', CAST(doc_id + 1 AS VARCHAR)) AS cell, v AS original, CASE WHEN is_int THEN concat(format('{{:.2f}}', {HALF_UP.format("(CAST(v AS DOUBLE) / 1e6 * 100.0)")} / 100.0), '百万元') END AS amount_redacted
    FROM (SELECT doc_id, len(h) > 0 AS is_int, CASE WHEN len(h) > 0 THEN h[1] WHEN len(a) > 0 THEN a[1] ELSE c[1] END AS v
          FROM (SELECT doc_id, {INT_HITS} AS h, regexp_extract_all(text, '{ACCOUNT}') AS a, regexp_extract_all(text, '{CONTRACT}') AS c FROM input)) WHERE v IS NOT NULL""",
)
def _(df):
    cells = df.select(F.lit("book").alias("file"), F.lit(0).alias("sheet_idx"), F.lit("docs").alias("sheet"), F.col("doc_id").cast("int").alias("row"), F.lit(0).alias("col"), "text")
    none = df.sparkSession.createDataFrame([], "file string, sheet string, cell string")
    done = apply.changes(apply.of_sites(cells, document_sites(df), none))
    return done.select("cell", "original", F.when(F.col("action") == "precision", F.col("redacted")).alias("amount_redacted"))


@query("report_counts", REQUESTS, "SELECT 'f' || CAST(ord % 3 AS VARCHAR) AS file, count(*) FILTER (NOT (ord % 8 IN (6, 7) OR (ord % 8 = 1 AND ord % 3 = 0))) AS processed, count(*) FILTER (ord % 8 IN (6, 7) OR (ord % 8 = 1 AND ord % 3 = 0)) AS errors, count(*) AS skipped FROM input GROUP BY 1")
def _(df):
    done = dispatch.redact(df).withColumn("file", F.concat(F.lit("f"), (F.col("ord") % 3).cast("string"))).withColumn("site_id", F.concat(F.lit("s"), F.col("ord").cast("string")))
    more = done.select("file", "ord", F.concat(F.lit("t"), F.col("ord").cast("string")).alias("site_id"), F.lit(True).alias("enabled"))
    return apply.report(done.select("file", "ord", "site_id", F.lit(True).alias("enabled")).unionByName(more), done).select("file", "processed", "errors", "skipped")


@query("location_validate", "SELECT event_id, event_type, user_id FROM events", "SELECT event_id, event_id % 4 IN (0, 3) AS is_valid FROM input")
def _(df):
    k = F.pmod("event_id", F.lit(4))
    sheet = scan.excel_place(F.when(k == 0, F.lit("s")), F.lit("A1"))
    deck = scan.deck_place(F.when(k == 3, F.col("user_id")).cast("int"), F.lit("box"))
    return df.select("event_id", F.when(k < 2, scan.is_valid(sheet)).otherwise(scan.is_valid(deck)).alias("is_valid"))


@query("location_json", "SELECT n_nationkey, n_name FROM nation", """SELECT n_nationkey, concat('{"type":"excel","sheet":"', n_name, '","cell":"A1"}') AS json FROM input""")
def _(df):
    return df.select("n_nationkey", F.to_json(scan.excel_place(F.col("n_name"), F.lit("A1"))).alias("json"))


EVENTS = "SELECT event_id AS ord, user_id AS k, event_type AS detected_type, CASE WHEN event_id % 3 = 0 THEN 'column_rule' ELSE 'fulltext_scan' END AS discovered_by FROM events"


@query("dedup_sites", EVENTS, """SELECT k, x.o AS first_ord, x.t AS detected_type FROM (SELECT k, list_reduce(list({'o': ord, 't': detected_type, 'd': discovered_by} ORDER BY ord), lambda a, b: CASE WHEN b.t <> a.t AND b.d = 'column_rule' THEN {'o': a.o, 't': b.t, 'd': b.d} ELSE a END) AS x FROM input GROUP BY k)""")
def _(df):
    return scan.dedup_sites(df, ["k"]).select("k", F.col("ord").alias("first_ord"), "detected_type")


@query("dedup_rules", "SELECT p_partkey AS ord, p_brand AS pattern, p_type AS action FROM part", "SELECT pattern, min(ord) AS ord FROM input GROUP BY pattern")
def _(df):
    return scan.dedup_rules(df).select("pattern", "ord")


# ---------------------------------------------------------------- sheets: classes and headers

SEGMENTS = """SELECT c_custkey, c_name, c_mktsegment, c_acctbal, c_nationkey, CAST(row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS INT) - 1 AS r,
  CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 0 WHEN 'BUILDING' THEN 1 WHEN 'FURNITURE' THEN 2 WHEN 'HOUSEHOLD' THEN 3 ELSE 4 END AS idx FROM customer"""
SEGMENT_CELLS = """cells AS (SELECT idx, c_mktsegment AS sheet, r, 0 AS col, c_name AS text, FALSE AS num FROM input UNION ALL SELECT idx, c_mktsegment, r, 1, 'x', TRUE FROM input WHERE c_custkey % 2 = 0 UNION ALL SELECT idx, c_mktsegment, r, 2, CAST(c_nationkey AS VARCHAR) || '%', TRUE FROM input WHERE idx % 2 = 0
  UNION ALL SELECT idx, c_mktsegment, r, 3, ' ', FALSE FROM input UNION ALL SELECT idx, c_mktsegment, r, 4, CASE WHEN c_custkey % 4 = 0 THEN '1,234.5' ELSE 'text' END, c_custkey % 4 = 0 FROM input WHERE c_custkey % 5 = 0)"""


def segment_sheets(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each market segment as a sheet of five columns: names, balances, percentages, blanks, mixed."""
    cells = long_cells(df, F.col("r"), [
        ("string", None, F.col("c_name")), ("float", F.col("c_acctbal"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_acctbal"))),
        ("string", None, F.when(F.col("idx") % 2 == 0, F.concat(F.col("c_nationkey").cast("string"), F.lit("%")))), ("string", None, F.lit(" ")),
        ("string", None, F.when(F.col("c_custkey") % 5 == 0, F.when(F.col("c_custkey") % 4 == 0, F.lit("1,234.5")).otherwise(F.lit("text")))),
    ], F.col("c_mktsegment"), F.col("idx"))
    sheets = df.groupBy("idx", "c_mktsegment").agg(F.max("r").alias("end_row")).select(F.lit("book").alias("file"), F.col("idx").cast("int").alias("sheet_idx"), F.col("c_mktsegment").alias("sheet"), (F.col("idx") != 4).alias("visible"), F.lit(0).alias("first_row"), F.lit(0).alias("first_col"), "end_row", F.lit(5).alias("end_col"))
    return cells, sheets


SAMPLED = SEGMENT_CELLS + ", s AS (SELECT * FROM cells WHERE r < 100 AND idx <> 4 AND trim(text) <> ''), n AS (SELECT idx, c_mktsegment AS sheet, least(max(r) + 1, 100) AS n_rows FROM input WHERE idx <> 4 GROUP BY 1, 2)"
DENSITY = "SELECT sheet, n_rows, count(text) AS data_cells, round(count(text) / (n_rows * 6.0), 6) AS density FROM n LEFT JOIN s USING (idx, sheet) GROUP BY 1, 2"
COLUMN_TYPES = "SELECT n.sheet, CAST(g.col AS INT) AS col, count(*) FILTER (s.num) AS numeric_count, count(s.text) AS total FROM n CROSS JOIN range(6) AS g(col) LEFT JOIN s ON s.idx = n.idx AND s.col = g.col GROUP BY 1, 2"
MIX = f"SELECT sheet, coalesce(avg(CASE WHEN total > 0 THEN CASE WHEN numeric_count = 0 OR numeric_count = total THEN 0.0 ELSE -(numeric_count / total * ln(numeric_count / total) + (1 - numeric_count / total) * ln(1 - numeric_count / total)) / ln(2.0) END END), 0.0) AS type_mix FROM ({COLUMN_TYPES}) GROUP BY 1"


@query("sheet_density", SEGMENTS, f"WITH {SAMPLED} {DENSITY}")
def _(df):
    return classify.density(*segment_sheets(df)).select("sheet", "n_rows", "data_cells", F.round("density", 6).alias("density"))


@query("column_types", SEGMENTS, f"WITH {SAMPLED} {COLUMN_TYPES}")
def _(df):
    return classify.column_types(*segment_sheets(df)).select("sheet", "col", "numeric_count", "total")


@query("type_mix", SEGMENTS, f"WITH {SAMPLED} SELECT sheet, round(type_mix, 6) AS type_mix FROM ({MIX})")
def _(df):
    return classify.type_mix(classify.column_types(*segment_sheets(df))).select("sheet", F.round("type_mix", 6).alias("type_mix"))


@query("classify_sheets", SEGMENTS, f"WITH {SAMPLED} SELECT sheet, CASE WHEN density > 0.46 THEN 'data' WHEN type_mix > 0.35 THEN 'data' ELSE 'form' END AS sheet_type, format('density: {{:.3f}}, data_type_mix: {{:.3f}}', density, type_mix) AS reason FROM ({DENSITY}) JOIN ({MIX}) USING (sheet) WHERE density > 0")
def _(df):
    return classify.classify(*segment_sheets(df)).select("sheet", "sheet_type", "reason")


@query("classify_fallback", SEGMENTS, f"WITH {SAMPLED} SELECT DISTINCT c_mktsegment AS sheet, 'form' AS sheet_type FROM input WHERE idx <> 4")
def _(df):
    cells, sheets = segment_sheets(df)
    return classify.with_fallback(sheets, classify.classify(cells.filter("false"), sheets)).select("sheet", "sheet_type")


@query("numeric_text", f"SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN {PRICE} WHEN 1 THEN '1,234.56' WHEN 2 THEN ' -25.5% ' WHEN 3 THEN '12.34.56' WHEN 4 THEN o_orderstatus ELSE CAST(o_orderkey AS STRING) END AS v FROM orders", "SELECT o_orderkey, o_orderkey % 6 NOT IN (3, 4) AS is_numeric, o_orderkey % 6 IN (0, 5) AS is_number_like FROM input")
def _(df):
    return df.select("o_orderkey", classify.is_numeric_text(F.col("v")).alias("is_numeric"), headers.is_number_like(F.col("v")).alias("is_number_like"))


GRID = "SELECT doc_id, text FROM documents"
WORDS = r"SELECT doc_id, CAST(i - 1 AS INT) AS r, list_filter(string_split(lines[i], ' '), lambda w: w <> '') AS words FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM input))"
NUMBER_LIKE = r"(regexp_full_match(w, '-?[0-9]+(\.[0-9]+)?') AND length(replace(replace(w, '-', ''), '.', '')) <= 15)"


def document_grid(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each document as a sheet: lines are rows, words are cells."""
    lines = df.select("doc_id", F.split("text", "\n").alias("lines"))
    word = F.posexplode(F.filter(F.split("line", " "), lambda w: w != ""))
    cells = lines.select("doc_id", F.posexplode("lines").alias("row", "line")).select(F.lit("book").alias("file"), F.col("doc_id").cast("int").alias("sheet_idx"), F.col("doc_id").cast("string").alias("sheet"), "row", word.alias("col", "text"))
    width = F.array_max(F.transform("lines", lambda x: F.size(F.filter(F.split(x, " "), lambda w: w != ""))))
    sheets = lines.select(F.lit("book").alias("file"), F.col("doc_id").cast("int").alias("sheet_idx"), F.col("doc_id").cast("string").alias("sheet"), F.lit(True).alias("visible"), F.lit(0).alias("first_row"), F.lit(0).alias("first_col"), (F.size("lines") - 1).alias("end_row"), (width - 1).alias("end_col"))
    return cells, sheets


def document_scores(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Scores of all lines, or of the first ones only."""
    return headers.row_scores(headers.row_values(*document_grid(df), rows))


@query("row_scores", GRID, rf"""WITH g AS ({WORDS}), s AS (SELECT *, list_filter(words, lambda w: {NUMBER_LIKE}) AS nums, array_to_string(words, '') AS j FROM g), nx AS (SELECT *, lead(len(nums)) OVER p AS nn, lead(len(words)) OVER p AS nw FROM s WINDOW p AS (PARTITION BY doc_id ORDER BY r))
  SELECT doc_id, r AS row, round(CASE WHEN len(words) = 0 THEN 0.0 ELSE len(list_distinct(words)) / len(words) END, 6) AS uniqueness, round(CASE WHEN len(words) = 0 THEN 1.5 ELSE (1 - len(nums) / len(words)) * 1.5 END, 6) AS non_numeric, CASE WHEN coalesce(nw, 0) > 0 AND nn / nw > 0.5 THEN 1.0 ELSE 0.0 END AS next_numeric FROM nx""")
def _(df):
    return document_scores(df).select(F.col("sheet").cast("long").alias("doc_id"), "row", F.round("uniqueness", 6).alias("uniqueness"), F.round("non_numeric", 6).alias("non_numeric"), "next_numeric")


@query("annotation_rows", GRID, f"""WITH g AS ({WORDS}), t AS (SELECT doc_id, r, list_filter(list_transform(words, lambda w: trim(w)), lambda w: w <> '') AS words FROM g) SELECT doc_id, r AS row, CASE WHEN len(words) = 0 THEN FALSE ELSE starts_with(words[1], 'Notes') OR starts_with(words[1], 'Description') OR len(list_filter(words, lambda w: length(w) < 5)) / len(words) >= 0.5 END AS is_annotation FROM t""")
def _(df):
    return document_scores(df).select(F.col("sheet").cast("long").alias("doc_id"), "row", "is_annotation")


@query("data_rows", GRID, f"""WITH g AS ({WORDS}), s AS (SELECT *, list_filter(words, lambda w: {NUMBER_LIKE}) AS nums FROM g)
  SELECT doc_id, r AS row, CASE WHEN len(words) = 0 THEN FALSE WHEN len(nums) / len(words) > 0.6 THEN TRUE WHEN len(list_distinct(words)) / len(words) < 0.4 THEN TRUE WHEN len(words) >= 3 AND list_contains(nums, words[1]) AND length(words[1]) BETWEEN 1 AND 8 THEN TRUE ELSE FALSE END AS is_data FROM s""")
def _(df):
    return document_scores(df).select(F.col("sheet").cast("long").alias("doc_id"), "row", "is_data")


@query("header_span", GRID)
def _(df):
    return headers.header_spans(document_scores(df, headers.HEAD)).select(F.col("sheet").cast("long").alias("doc_id"), "header_start", "header_end")


@query("best_header", GRID)
def _(df):
    return headers.best_rows(document_scores(df, headers.HEAD)).select(F.col("sheet").cast("long").alias("doc_id"), "best_row", F.round("score", 6).alias("score"))


NATIONS = "SELECT n_nationkey, n_name, n_regionkey FROM nation"


def nation_sheets(df: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Each nation as a sheet with two header rows, the first one's cells merged: cells, sheets, merges, spans."""
    key = dict(sheet=F.col("n_name"), sheet_idx=F.col("n_nationkey"))
    name = lambda *texts: [("string", None, t) for t in texts]
    cells = long_cells(df, F.lit(0), name(F.concat(F.lit(" 产品/"), "n_name"), F.lit(None), F.lit("金额"), F.lit(None)), **key)
    cells = cells.unionByName(long_cells(df, F.lit(1), name(F.lit("名称"), F.when(F.col("n_nationkey") % 2 == 0, F.lit("名称")), F.lit("本期\n金额"), F.lit("本期\n金额")), **key))
    keys = [F.lit("book").alias("file"), F.col("n_nationkey").cast("int").alias("sheet_idx"), F.col("n_name").alias("sheet")]
    sheets = df.select(*keys, F.lit(True).alias("visible"), F.lit(0).alias("first_row"), F.lit(0).alias("first_col"), F.lit(1).alias("end_row"), F.lit(3).alias("end_col"))
    rect = F.explode(F.array(*[F.struct(F.lit(i).alias("rect_idx"), *[F.lit(v).alias(n) for n, v in zip(("r0", "c0", "r1", "c1"), r, strict=True)]) for i, r in enumerate([(0, 0, 0, 1), (0, 2, 0, 3)])]))
    merges = df.select(*keys, rect.alias("x")).select("file", "sheet_idx", "sheet", "x.*")
    return cells, sheets, merges, df.select(*keys, F.lit(0).alias("header_start"), F.lit(1).alias("header_end"))


@query("merged_lookup", NATIONS, "SELECT n_name AS sheet, CAST(c AS INT) AS col, CASE WHEN c < 2 THEN ' 产品/' || n_name ELSE '金额' END AS text FROM input, range(4) AS g(c)")
def _(df):
    cells, sheets, merges, _ = nation_sheets(df)
    places = sheets.select("file", "sheet_idx", "sheet", F.lit(0).alias("row"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("col"))
    return headers.merged_lookup(cells, places, merges).select("sheet", "col", "text")


NATION_NAMES = "(SELECT n_name AS sheet, n_nationkey AS k, CAST(c AS INT) AS col, CASE c WHEN 0 THEN '产品_' || replace(n_name, ' ', '_') || '_名称' WHEN 1 THEN '产品_' || replace(n_name, ' ', '_') || CASE WHEN n_nationkey % 2 = 0 THEN '_名称' ELSE '' END ELSE '金额_本期_金额' END AS name FROM input, range(4) AS g(c))"


@query("header_names", NATIONS, f"SELECT sheet, col, name FROM {NATION_NAMES}")
def _(df):
    cells, sheets, merges, spans = nation_sheets(df)
    return headers.header_names(cells, spans, sheets, merges).select("sheet", "col", "name")


NUMBERED_NAMES = f"SELECT sheet, col, CASE WHEN row_number() OVER w = 1 THEN name ELSE name || '_' || CAST(row_number() OVER w - 1 AS VARCHAR) END AS name FROM {NATION_NAMES} WINDOW w AS (PARTITION BY sheet, name ORDER BY col)"
for _key, _f in (("dedup_names", headers.unique_names), ("probe_names", headers.probed_names)):

    @query(_key, NATIONS, NUMBERED_NAMES)
    def _(df, f=_f):
        cells, sheets, merges, spans = nation_sheets(df)
        return f(headers.header_names(cells, spans, sheets, merges)).select("sheet", "col", "name")


@query("sheet_rules", NATIONS, f"SELECT sheet, col, 'precision' AS action FROM ({NUMBERED_NAMES}) WHERE name LIKE '%金额%'")
def _(df):
    cells, sheets, merges, spans = nation_sheets(df)
    return scan.sheet_rules(headers.unique_names(headers.header_names(cells, spans, sheets, merges))).select("sheet", "col", "action")


FORMS = "SELECT c_custkey, c_name, c_nationkey, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS INT) AS r FROM customer"


def form_sheets(df: DataFrame) -> DataFrame:
    """Each nation's customers as a form: a header with one rule, names below it, amounts beside."""
    key = dict(sheet=F.col("c_nationkey").cast("string"), sheet_idx=F.col("c_nationkey"))
    head = long_cells(df.filter("r = 1"), F.lit(0), [("string", None, F.lit("客户名称")), ("string", None, F.lit("说明"))], **key)
    return head.unionByName(long_cells(df, F.col("r"), [("string", None, F.col("c_name")), ("string", None, F.concat(F.lit("共 "), (F.col("c_custkey") + 10000).cast("string"), F.lit(" 元")))], **key))


@query("form_scan", FORMS, "SELECT concat('sheet_', CAST(c_nationkey AS VARCHAR), '_A', CAST(r + 1 AS VARCHAR)) AS site_id, c_name AS original_value, 'column_rule' AS discovered_by, 'alias' AS action FROM input UNION ALL SELECT concat('sheet_', CAST(c_nationkey AS VARCHAR), '_B', CAST(r + 1 AS VARCHAR)), CAST(c_custkey + 10000 AS VARCHAR), 'fulltext_scan', 'precision' FROM input")
def _(df):
    return scan.scan_form(form_sheets(df)).select("site_id", "original_value", "discovered_by", "action")


@query("extra_text", FORMS, "SELECT concat('sheet_', CAST(c_nationkey AS VARCHAR), '_A', CAST(r + 1 AS VARCHAR)) AS site_id, CAST(c_custkey + 10000 AS VARCHAR) AS original_value FROM input WHERE r = 1 OR (r > 2 AND c_custkey % 2 = 0)")
def _(df):
    key = dict(sheet=F.col("c_nationkey").cast("string"), sheet_idx=F.col("c_nationkey"))
    cells = long_cells(df, F.col("r"), [("string", None, F.concat(F.lit("共 "), (F.col("c_custkey") + 10000).cast("string"), F.lit(" 元"))), ("string", None, F.when((F.col("c_custkey") % 2 != 0) | (F.col("r") <= 2), F.lit("x")))], **key)
    spans = df.select(F.lit("book").alias("file"), F.col("c_nationkey").cast("int").alias("sheet_idx"), F.col("c_nationkey").cast("string").alias("sheet")).distinct().withColumn("header_start", F.lit(2)).withColumn("header_end", F.lit(2))
    return scan.scan_extra(cells, spans).select("site_id", "original_value")


@query("workbook_scan", FORMS, "SELECT discovered_by, count(*) AS n FROM (SELECT 'column_rule' AS discovered_by FROM input UNION ALL SELECT 'fulltext_scan' FROM input) GROUP BY 1")
def _(df):
    cells = form_sheets(df)
    sheets = cells.select("file", "sheet_idx", "sheet").distinct().withColumn("sheet_type", F.lit("form"))
    none = df.sparkSession
    spans = none.createDataFrame([], "file string, sheet_idx int, sheet string, header_start int, header_end int")
    names = none.createDataFrame([], "file string, sheet_idx int, sheet string, col int, name string")
    return scan.scan_workbook(cells, sheets, spans, names).groupBy("discovered_by").agg(F.count("*").alias("n"))


@query("table_scan", FORMS, "SELECT concat('slide_', CAST(c_nationkey AS VARCHAR), '_7_R', CAST(r + 1 AS VARCHAR), 'C1') AS site_id, c_name AS original_value FROM input UNION ALL SELECT concat('slide_', CAST(c_nationkey AS VARCHAR), '_7_R', CAST(r + 1 AS VARCHAR), 'C2'), CAST(c_custkey + 10000 AS VARCHAR) FROM input")
def _(df):
    deck = form_sheets(df).select("file", F.col("sheet_idx").alias("slide"), F.lit(0).alias("shape_ord"), F.lit("7").alias("shape_id"), F.lit("Table").alias("shape_name"), "row", "col", "text")
    return scan.scan_table(deck).select("site_id", "original_value")


TALK = "SELECT conv_id, turn, role, text FROM conversations"


def talk_deck(df: DataFrame) -> DataFrame:
    note = (F.col("turn") % 2 == 1) & (F.length("text") > 0)
    return df.select(F.lit("deck").alias("file"), F.col("conv_id").cast("int").alias("slide"), F.col("turn").cast("int").alias("shape_ord"), F.col("turn").cast("string").alias("shape_id"), F.col("role").alias("shape_name"), F.when(note, F.lit("notes")).otherwise(F.lit("textbox")).alias("part"), F.lit(0).alias("para_idx"), F.lit(None).cast("int").alias("row"), F.lit(None).cast("int").alias("col"), F.concat_ws(" ", "text", (F.col("conv_id") + 10000).cast("string")).alias("text"))


@query("deck_scan", TALK, rf"SELECT CAST(conv_id AS INT) AS slide, count(*) AS n FROM (SELECT conv_id, unnest({INT_HITS}) FROM (SELECT conv_id, concat_ws(' ', text, CAST(conv_id + 10000 AS VARCHAR)) AS text FROM input)) GROUP BY 1")
def _(df):
    return scan.scan_deck(talk_deck(df)).filter("action = 'precision' AND rule_ord = 4").groupBy("slide").agg(F.count("*").alias("n"))


@query("deck_sites", TALK, "SELECT CAST(conv_id AS INT) AS slide, count(DISTINCT role) AS n FROM input WHERE turn % 2 = 0 GROUP BY 1")
def _(df):
    texts = talk_deck(df).filter("part = 'textbox'")
    sites = texts.select("file", "slide", "shape_name").distinct().select("file", (F.col("slide") * 100 + F.length("shape_name")).cast("long").alias("ord"), F.concat_ws("_", F.lit("slide"), F.col("slide").cast("string"), "shape_name").alias("site_id"), scan.deck_place(F.col("slide"), F.col("shape_name")).alias("location"), (F.col("slide") + 10000).cast("string").alias("original_value"), F.lit(True).alias("enabled"), F.lit("mask").alias("action"), F.lit(None).cast("string").alias("params"))
    gone = sites.withColumn("original_value", F.lit("not there"))
    return apply.changes(apply.of_deck_sites(texts, sites.unionByName(gone))).groupBy(F.col("location.slide").alias("slide")).agg(F.count("*").alias("n"))


@query("watermark_place", SEGMENTS, f"WITH {SEGMENT_CELLS} SELECT sheet, arg_min(text, r * 10 + col) AS text FROM cells WHERE r < 10 AND idx <> 4 AND trim(text) <> '' AND col <> 1 GROUP BY sheet")
def _(df):
    cells, sheets = segment_sheets(df)
    return scan.mark_places(cells, sheets).select("sheet", "text")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scan all documents, choose default actions, mask, and count by rule and action."""
    sites = document_sites(table(spark, sf_dir, "documents").select("doc_id", "text"))
    asked = sites.select("doc_id", "ord", "detected_type", F.col("original_value").alias("value"), "action", "params")
    done = dispatch.redact(asked)
    return done.groupBy("detected_type", "action").agg(F.count("*").alias("n_sites"), F.count_distinct("doc_id").alias("n_docs"), F.count("redacted").alias("n_redacted"), F.count("error").alias("n_errors"))


QUERIES["flagship"] = flagship


def audit_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilframe.plans.work import Work
    from veilframe.sources import audit

    asked = given(spark, sf_dir, REQUESTS).withColumn("file", F.concat(F.lit("/in/f"), (F.col("ord") % 3).cast("string"), F.lit(".xlsx")))
    done = dispatch.redact(asked).withColumn("site_id", F.concat(F.lit("s"), F.col("ord").cast("string"))).withColumn("location", scan.excel_place(F.lit("S"), F.lit("A1"))).withColumn("original", F.col("value"))
    done = Work(spark, "audit").keep(done.select("file", "ord", "site_id", "location", "original", "redacted", "action", "error"), "done")
    files = done.select("file").distinct().select("file", F.col("file").alias("source_path"), F.lit("/out/x.xlsx").alias("output_file"), F.lit("00").alias("file_hash"))
    parts = audit.audit_parts(files, done, "op", F.lit("2024-01-01T00:00:00"))
    # What a log says of itself, where its entries, read back piece by piece, agree.
    entries = F.json_array_length(F.concat(F.lit("["), F.regexp_replace("text", "^,", ""), F.lit("]"))).cast("long")
    read = lambda k: F.coalesce(F.sum(F.when(F.col("section") == k, entries)), F.lit(0))
    rows = parts.groupBy("file").agg(F.max(F.when(F.col("section") == audit.HEAD, F.concat("text", F.lit("]}")))).alias("json"), read(audit.CHANGES).alias("c"), read(audit.ERRORS).alias("e"))
    said = lambda name: F.get_json_object("json", f"$.{name}").cast("long")
    return rows.select("file", F.when(said("total_changes") == F.col("c"), F.col("c")).alias("total_changes"), F.when(said("total_errors") == F.col("e"), F.col("e")).alias("total_errors"), F.get_json_object("json", "$.operator").alias("operator"), F.substr("json", F.lit(1), F.lit(17)).alias("head"))


QUERIES["audit_json"] = audit_json
ORACLES["audit_json"] = f"""WITH input AS ({REQUESTS}) SELECT '/in/f' || CAST(ord % 3 AS VARCHAR) || '.xlsx' AS file, count(*) FILTER (NOT (ord % 8 IN (6, 7) OR (ord % 8 = 1 AND ord % 3 = 0))) AS total_changes, count(*) FILTER (ord % 8 IN (6, 7) OR (ord % 8 = 1 AND ord % 3 = 0)) AS total_errors, 'op' AS operator, '{{"file":"f' || CAST(ord % 3 AS VARCHAR) || '.xlsx"' AS head FROM input GROUP BY 1, 4, 5"""
