"""Licence detection by ordered signature rules, in one narrow projection of built-in functions.

A text becomes lower-case words with one space between them. Texts without any rule's stem are done after one
regular expression; of the others, the rules whose keyword occurs are matched. Detections are word intervals. In
order of start, longest first, a detection is dropped if an interval of equal or higher priority holds it (sweep with
the largest end seen at each priority). Base phrases are never dropped.

Defined cases: a null text counts as empty (no words, no detections, score 0); repeated rows and null ids give a row
each; texts of any length are read whole; an empty table gives no rows; other columns of the input are carried by ``scan``
as they are: where one has the name of a column that ``scan`` adds, the added one gets underscores in front.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.llm.license_rules import RULES, STEMS, STEMS_WEAK, Rule
from veilframe.llm.shared import text_of

#: What separates words, before A-Z become lower case.
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
LEVELS = 4
SPAN = "struct<first:int,back:int,priority:int,rule:int,label:string,confidence:double,base:boolean>"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def spaced(text: Column) -> Column:
    """The words with one space before, between and after them; a space for a text without words."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(text, GAP, " ")), F.lit(" "))


def spaces(x: Column) -> Column:
    return F.octet_length(x) - F.octet_length(F.replace(x, F.lit(" "), F.lit("")))


def stem_pattern() -> str:
    return "(?i) (?:" + "|".join(STEMS_WEAK.get(s, s) for s in STEMS) + ")"


def rule_array(rules: list[Rule]) -> Column:
    """The rules as one constant array."""
    rows = [{"no": i, "label": r.label, "keyword": r.keyword, "pattern": f"(?<= )(?:{r.pattern})(?= )", "priority": r.priority, "confidence": r.confidence, "base": r.base} for i, r in enumerate(rules)]
    return F.from_json(F.lit(json.dumps(rows)), "array<struct<no:int,label:string,keyword:string,pattern:string,priority:int,confidence:double,base:boolean>>")


def matches(words: Column, rule: Column) -> Column:
    """The word intervals (first, -end) of a rule, from left to right."""
    found, between = F.regexp_extract_all(words, rule["pattern"], F.lit(0)), F.split(words, rule["pattern"], -1)
    pairs = F.arrays_zip(F.transform(F.slice(between, F.lit(1), F.size(found)), spaces).alias("gap"), F.transform(found, spaces).alias("own"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        first = acc["at"] + x["gap"] - 1
        span = F.struct(first.alias("first"), (-(first + x["own"] + 1)).alias("back"), rule["priority"].alias("priority"), rule["no"].alias("rule"), rule["label"].alias("label"), rule["confidence"].alias("confidence"), rule["base"].alias("base"))
        return F.struct((acc["at"] + x["gap"] + x["own"]).cast("int").alias("at"), F.concat(acc["out"], F.array(span.cast(SPAN))).alias("out"))

    return F.aggregate(pairs, start.cast(f"struct<at:int,out:array<{SPAN}>>"), step, lambda acc: acc["out"])


def sweep(spans: Column) -> Column:
    """The spans that no span of equal or higher priority holds, and all base ones."""
    state = "struct<" + ",".join(f"e{p}:int" for p in range(LEVELS)) + f",out:array<{SPAN}>>"
    start = F.struct(*[F.lit(-1).alias(f"e{p}") for p in range(LEVELS)], F.array().cast(f"array<{SPAN}>").alias("out")).cast(state)

    def step(acc: Column, x: Column) -> Column:
        end, held = -x["back"], F.lit(False)
        for p in range(LEVELS):
            held = held | ((x["priority"] == p) & (acc[f"e{p}"] >= end))
        ends = [F.when(x["priority"] <= p, F.greatest(acc[f"e{p}"], end)).otherwise(acc[f"e{p}"]).alias(f"e{p}") for p in range(LEVELS)]
        return F.struct(*ends, F.when(held & ~x["base"], acc["out"]).otherwise(F.concat(acc["out"], F.array(x))).alias("out"))

    return F.aggregate(F.sort_array(spans), start, step, lambda acc: acc["out"])


def free(name: str, taken: list[str]) -> str:
    """The name, with underscores in front until no column has it."""
    while name.lower() in {c.lower() for c in taken}:
        name = "_" + name
    return name


def scan(docs: DataFrame, rules: list[Rule] = RULES, text: str = "text") -> DataFrame:
    """docs with n_words int and spans array<struct<first, end, priority, rule, label, confidence, base>> added."""
    own, spans_name = free("n_words", docs.columns), free("spans", docs.columns)
    row = free("_row", docs.columns)
    given = docs.columns
    docs = docs.select(F.struct(*[F.col(f"`{c}`") for c in given]).alias(row), F.col(f"`{text}`").alias("_text"))
    text = "_text"
    words = spaced(text_of(text))
    docs = docs.withColumn("_words", words).drop("_text").withColumn("n_words", F.when(F.length("_words") > 2, spaces(F.col("_words")) - 1).otherwise(0))
    lower = F.translate("_words", UPPER, LOWER)
    due = F.when(F.col("_words").rlike(stem_pattern()), lower)
    docs = docs.withColumn("_lower", due).drop("_words")
    table = rule_array(rules)
    low = F.col("_lower")
    raw = F.flatten(F.transform(F.filter(table, lambda r: F.contains(low, r["keyword"])), lambda r: matches(low, r)))
    none = F.array().cast(f"array<{SPAN}>")
    docs = docs.withColumn("_raw", F.when(low.isNotNull(), raw).otherwise(none))
    kept = F.when(F.size("_raw") > 0, sweep(F.col("_raw"))).otherwise(none)
    view = F.transform(kept, lambda x: F.struct(x["first"].alias("first"), (-x["back"]).alias("end"), x["priority"].alias("priority"), x["rule"].alias("rule"), x["label"].alias("label"), x["confidence"].alias("confidence"), x["base"].alias("base")))
    return docs.select(f"{row}.*", F.col("n_words").alias(own), view.alias(spans_name))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: per document counts, places of base phrases, labels and a score."""
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    base = F.filter("spans", lambda x: x["base"])
    labels = lambda xs: F.array_join(F.array_sort(F.array_distinct(F.transform(xs, lambda x: x["label"]))), ",")
    return found.select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda x: x["first"])).cast("long").alias("first_word"),
        F.array_max(F.transform(base, lambda x: x["first"])).cast("long").alias("last_word"),
        labels(base).alias("base_labels"),
        labels(F.col("spans")).alias("labels"),
        F.coalesce(F.array_max(F.transform("spans", lambda x: x["confidence"])), F.lit(0.0)).alias("score"),
    )


def brute_force(text: str | None, rules: list[Rule] = RULES) -> dict:
    """The same row by plain Python, for tests."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(str.maketrans(UPPER, LOWER)))
    line, spans = " " + " ".join(words) + " ", []
    for i, r in enumerate(rules):
        for m in re.finditer(f"(?<= )(?:{r.pattern})(?= )", line, re.ASCII) if r.keyword in line else ():
            first = line[: m.start()].count(" ") - 1
            spans.append((first, first + m[0].count(" ") + 1, r.priority, i))
    kept = [s for s in spans if rules[s[3]].base or not any(t != s and t[0] <= s[0] and t[1] >= s[1] and t[2] <= s[2] and ((t[0], t[1]) != (s[0], s[1]) or t[2:] < s[2:]) for t in spans)]
    base = [s for s in kept if rules[s[3]].base]
    join = lambda xs: ",".join(sorted({rules[s[3]].label for s in xs}))
    return {"n_words": len(words), "n_base": len(base), "first_word": min((s[0] for s in base), default=None), "last_word": max((s[0] for s in base), default=None), "base_labels": join(base), "labels": join(kept), "score": max((rules[s[3]].confidence for s in kept), default=0.0)}
