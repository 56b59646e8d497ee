"""Finding sensitive values in text: several rules at once, with priorities and overlap suppression.

Everything is a built-in expression, but the matcher for large dictionaries, which is an Arrow-batched function over
an automaton. Offsets are in characters, from 0.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.operators.rules import PATTERNS, PatternRule, java_pattern

SPAN = "struct<start:int,end:int,value:string>"
HIT = "struct<ord:int,rule:string,detected_type:string,start:int,end:int,value:string>"
#: Dictionaries of more words than this are matched by the automaton.
NATIVE_WORDS = 64
#: What any built-in rule's text contains; a text without it isn't scanned further.
PREFILTER = r"(?Ud)[\d,.]{4}|\d{4}|\d\s*[万亿百千]|公司|集团|银行|证券|基金"


def none_of(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def regex_spans(text: Column, pattern: str) -> Column:
    """All matches from left to right, with their places. Lengths of what lies between matches give the places."""
    p = F.lit(java_pattern(pattern))
    found, between = F.regexp_extract_all(text, p, F.lit(0)), F.split(text, java_pattern(pattern), -1)
    pairs = F.arrays_zip(F.slice(between, F.lit(1), F.size(found)).alias("gap"), found.alias("own"))
    start = F.struct(F.lit(0).alias("at"), none_of(SPAN).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        first = acc["at"] + F.length(x["gap"])
        end = first + F.length(x["own"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(first.alias("start"), end.alias("end"), x["own"].alias("value")).cast(SPAN))).alias("out"))

    # One cheap look before the two passes that get texts and gaps.
    return F.when(text.rlike(java_pattern(pattern)), F.aggregate(pairs, start, step, lambda acc: acc["out"])).otherwise(none_of(SPAN))


def word_places(text: Column, word: str) -> Column:
    """All occurrences of a word, overlapping ones too."""
    parts = F.split(text, "(?=" + re.escape(word) + ")", -1)
    start = F.struct(F.lit(0).alias("at"), none_of(SPAN).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        own = F.array(F.struct(acc["at"].alias("start"), (acc["at"] + len(word)).alias("end"), F.lit(word).alias("value")).cast(SPAN))
        return F.struct((acc["at"] + F.length(x)).alias("at"), F.when(F.substr(text, acc["at"] + 1, F.lit(len(word))) == word, F.concat(acc["out"], own)).otherwise(acc["out"]).alias("out"))

    return F.when(F.contains(text, F.lit(word)), F.aggregate(parts, start, step, lambda acc: acc["out"])).otherwise(none_of(SPAN))


def dictionary_spans(text: Column, words: tuple[str, ...]) -> Column:
    """Matches without overlap: the one that ends first, the longest of those that end there, then on from its end."""
    every = F.flatten(F.array(*[word_places(text, w) for w in dict.fromkeys(words)]))
    keyed = F.sort_array(F.transform(every, lambda x: F.struct(x["end"].alias("e"), x["start"].alias("s"), x["value"].alias("v"))))
    start = F.struct(F.lit(0).alias("at"), none_of(SPAN).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        own = F.array(F.struct(x["s"].alias("start"), x["e"].alias("end"), x["v"].alias("value")).cast(SPAN))
        ok = x["s"] >= acc["at"]
        return F.struct(F.when(ok, x["e"]).otherwise(acc["at"]).alias("at"), F.when(ok, F.concat(acc["out"], own)).otherwise(acc["out"]).alias("out"))

    return F.aggregate(keyed, start, step, lambda acc: acc["out"])


class Words:
    """An automaton over words: by the optional native library, else by a regular expression per word."""

    def __init__(self, words: tuple[str, ...]):
        try:
            import ahocorasick
        except ImportError:
            ahocorasick = None
        self.words = tuple(dict.fromkeys(words))
        self.automaton = None
        if ahocorasick and self.words:
            self.automaton = ahocorasick.Automaton()
            for w in self.words:
                self.automaton.add_word(w, w)
            self.automaton.make_automaton()

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        if self.automaton is not None:
            every = ((end + 1, end + 1 - len(w), w) for end, w in self.automaton.iter(text))
        else:
            every = ((m.start() + len(w), m.start(), w) for w in self.words for m in re.finditer(f"(?={re.escape(w)})", text))
        at, out = 0, []
        for end, start, w in sorted(every):
            if start >= at:
                out.append((start, end, w))
                at = end
        return out


def dictionary_column(words: tuple[str, ...]):
    """A function of a text column that gives its dictionary spans, in Arrow batches; for large dictionaries."""

    @F.arrow_udf(f"array<{SPAN}>")
    def match(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = Words(words)
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("value", pa.string())]))
        for batch in batches:
            yield pa.array([[{"start": a, "end": b, "value": w} for a, b, w in own.spans(x.as_py() or "")] for x in batch], kind)

    return match


def is_short_number(value: Column) -> Column:
    """Digits and separators only, fewer than four of them: too short to be an amount."""
    bare = F.translate(value, ",-", "")
    return value.rlike(r"^(?U)[\d,.\-]+$") & (F.length(bare) < 4)


def suppress(hits: Column) -> Column:
    """Drops each hit of a regular expression that overlaps an earlier kept hit; dictionary hits always stay."""

    def step(acc: Column, x: Column) -> Column:
        clash = F.exists(acc, lambda y: (x["start"] < y["end"]) & (x["end"] > y["start"]))
        return F.when((x["priority"] > 0) & clash, acc).otherwise(F.concat(acc, F.array(x)))

    return F.aggregate(hits, none_of(RANKED), step)


RANKED = "struct<priority:int,ord:int,rule:string,detected_type:string,start:int,end:int,value:string>"


def hit_of(i: int, r: PatternRule):
    """A function from a rule's span to a hit."""

    def hit(x: Column) -> Column:
        return F.struct(F.lit(r.priority).alias("priority"), F.lit(i).alias("ord"), F.lit(r.name).alias("rule"), F.lit(r.detected_type).alias("detected_type"), x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value")).cast(RANKED)

    return hit


def scan_text(text: Column, rules: tuple[PatternRule, ...] = PATTERNS, prefilter: bool = True) -> Column:
    """array<struct<ord, rule, detected_type, start, end, value>>: what the rules find, in rule order, then by place."""
    groups = []
    for i, r in sorted(enumerate(rules), key=lambda x: x[1].priority):
        if r.pattern is None:
            spans = dictionary_spans(text, r.words) if len(r.words) <= NATIVE_WORDS else dictionary_column(r.words)(text)
        else:
            spans = regex_spans(text, r.pattern)
        if r.detected_type == "amount":
            spans = F.filter(spans, lambda x: ~is_short_number(x["value"]))
        groups.append(F.transform(spans, hit_of(i, r)))
    found = F.transform(suppress(F.flatten(F.array(*groups))), lambda x: F.struct(*[x[c].alias(c) for c in ("ord", "rule", "detected_type", "start", "end", "value")]).cast(HIT))
    if prefilter and rules == PATTERNS:
        words = "|".join(re.escape(w) for r in rules for w in r.words)
        return F.when(text.rlike(PREFILTER + "|" + words), found).otherwise(none_of(HIT))
    return F.coalesce(found, none_of(HIT))


def scan_table(df: DataFrame, keys: list[str], columns: list[str], rules: tuple[PatternRule, ...] = PATTERNS) -> DataFrame:
    """A row for each find in the given text columns: keys, column, ord, rule, detected_type, start, end, value."""
    parts = []
    for c in columns:
        hits = df.select(*keys, F.lit(c).alias("column"), F.explode(scan_text(F.col(c).cast("string"), rules)).alias("hit"))
        parts.append(hits.select(*keys, "column", "hit.*"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def value_in(text: Column, detected_type: str) -> Column:
    """The sensitive part of a short text by its type, else the whole text."""
    patterns = [r.pattern for r in PATTERNS if r.detected_type == detected_type and r.pattern]
    first = [F.nullif(F.regexp_extract(text, java_pattern(p), 0), F.lit("")) for p in patterns]
    return F.coalesce(*first, text) if first else text
