"""Rules: what text is looked for, which headers choose an action, and where rules are read from."""

from __future__ import annotations

import json
from pathlib import Path
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ACTIONS = ("precision", "perturb", "mask", "alias", "mask_name", "mask_account", "differential_shift", "proportional_scale")
TYPES = ("amount", "entity", "person", "account")
MATCHES = ("exact", "regex", "position")
# Which actions suit a detected type.
ALLOWED = {"amount": ("precision", "perturb", "mask", "differential_shift", "proportional_scale"), "entity": ("alias",), "person": ("mask_name", "alias"), "account": ("mask_account",)}


class RuleError(ValueError):
    """A rule file or rule that can't be used; the message names its origin."""


class PatternRule(NamedTuple):
    name: str
    detected_type: str
    pattern: str | None = None
    words: tuple[str, ...] = ()
    description: str = ""

    @property
    def priority(self) -> int:
        return 0 if self.pattern is None else 1


class ColumnRule(NamedTuple):
    match_type: str
    pattern: str
    action: str
    params: dict
    detected_type: str = "amount"
    priority: int = 1


_ORG = "(公司|集团|银行|证券|基金|有限公司)"
# The built-in text rules, in load order, and the built-in dictionary.
DICTIONARY = ("天齐锂业", "格林布什", "措拉", "奎纳", "四川措拉")
PATTERNS = (
    PatternRule("amount_with_unit", "amount", r"-?\d{1,3}(?:,\d{3})*(?:\.\d+)?\s*(?:万亿|亿|百万|万|千)元?"),
    PatternRule("amount_with_commas", "amount", r"-?\d{1,3}(,\d{3})+\.\d{2}(?!%)"),
    PatternRule("amount_with_commas_int", "amount", r"-?\d{1,3}(,\d{3})+(?![.\d]*%)"),
    PatternRule("amount_no_commas", "amount", r"-?\d{4,}\.\d{2}(?!%)"),
    PatternRule("amount_no_commas_int", "amount", r"-?\d{5,}(?!%)"),
    PatternRule("entity_chinese", "entity", ".+" + _ORG),
    PatternRule("entity_dict", "entity", None, DICTIONARY),
    PatternRule("entity_english", "entity", "[A-Z][A-Za-z0-9]{1,14}" + _ORG),
    PatternRule("bank_account", "account", r"\d{4}[\s-]?\d{4}[\s-]?\d{4}[\s-]?\d{4,}"),
    PatternRule("contract_no", "account", r"[A-Za-z]{2,4}[-/]?\d{4}[-/]?\d{4,}"),
)
_MILLION, _BILLION = {"unit": "million", "decimal_places": 2}, {"unit": "billion", "decimal_places": 2}
_ACCOUNT = {"keep_prefix": 3, "keep_suffix": 4}
# The built-in header rules, in load order.
COLUMNS = (
    ColumnRule("regex", ".+年(上|下)半年", "perturb", {"percentage": 10}),
    ColumnRule("exact", "营业收入", "precision", _MILLION),
    ColumnRule("exact", "营业总收入", "precision", _MILLION),
    ColumnRule("exact", "净利润", "precision", _MILLION),
    ColumnRule("exact", "归母净利润", "precision", _MILLION),
    ColumnRule("exact", "总资产", "precision", _BILLION),
    ColumnRule("exact", "总负债", "precision", _BILLION),
    ColumnRule("exact", "净资产", "precision", _BILLION),
    ColumnRule("exact", "合同金额", "perturb", {"percentage": 5}),
    ColumnRule("exact", "合同总额", "perturb", {"percentage": 5}),
    ColumnRule("exact", "现金流", "precision", _MILLION),
    ColumnRule("exact", "毛利率", "mask", {}),
    ColumnRule("exact", "客户名称", "alias", {"prefix": "客户"}, "entity"),
    ColumnRule("exact", "联系人", "mask_name", {}, "person"),
    ColumnRule("exact", "账号", "mask_account", _ACCOUNT, "account"),
    ColumnRule("exact", "合同编号", "mask_account", _ACCOUNT, "account"),
    ColumnRule("regex", ".*金额.*", "precision", _MILLION, "amount", 2),
    ColumnRule("regex", ".*收入.*", "precision", _MILLION, "amount", 2),
    ColumnRule("regex", ".*利润.*", "precision", _MILLION, "amount", 2),
    ColumnRule("regex", ".*单据编号.*", "mask_account", _ACCOUNT, "account", 2),
    ColumnRule("regex", ".*本次入库.*", "precision", {"unit": "thousand", "decimal_places": 0}, "amount", 2),
)


def read_json(path: str | Path) -> dict:
    try:
        return json.loads(Path(path).read_text(encoding="utf-8"))
    except FileNotFoundError as e:
        raise RuleError(f"{path}: no such rule file") from e
    except ValueError as e:
        raise RuleError(f"{path}: not JSON: {e}") from e


def normal_words(text: str) -> list[str]:
    """Trimmed lines without blanks and repetitions, in their order."""
    return list(dict.fromkeys(w for w in (line.strip() for line in text.splitlines()) if w))


def load_dictionary(path: str | Path) -> tuple[str, ...]:
    try:
        words = [w for w in (line.strip() for line in Path(path).read_text(encoding="utf-8").splitlines()) if w]
    except FileNotFoundError as e:
        raise RuleError(f"{path}: no such dictionary") from e
    if not words:
        raise RuleError(f"{path}: the dictionary is empty")
    return tuple(words)


def save_dictionary(path: str | Path, text: str) -> list[str]:
    words = normal_words(text)
    if not words:
        raise RuleError("an empty dictionary isn't saved")
    Path(path).write_text("\n".join(words) + "\n", encoding="utf-8")
    return words


def load_patterns(path: str | Path | None = None) -> tuple[PatternRule, ...]:
    """Text rules of a file by type, amounts first; the built-in ones without a path."""
    if path is None:
        return PATTERNS
    groups, out = read_json(path).get("rules", {}), []
    for kind in TYPES:
        for x in groups.get(kind, []):
            if "dict_path" in x:
                out.append(PatternRule(x["name"], kind, None, load_dictionary(Path(path).parent / x["dict_path"]), x.get("description", "")))
            elif "pattern" in x:
                out.append(PatternRule(x["name"], kind, x["pattern"], (), x.get("description", "")))
            else:
                raise RuleError(f"{path}: rule {x.get('name')} has neither a pattern nor a dictionary")
    return tuple(out)


def load_columns(path: str | Path | None = None) -> tuple[ColumnRule, ...]:
    if path is None:
        return COLUMNS
    out = []
    for x in read_json(path).get("rules", []):
        rule = ColumnRule(x.get("match_type", "exact"), x["pattern"], x.get("action", "mask"), x.get("params") or {}, x.get("detected_type", "amount"), int(x.get("priority", 1)))
        if rule.match_type not in MATCHES or rule.action not in ACTIONS or rule.detected_type not in TYPES:
            raise RuleError(f"{path}: rule {rule.pattern} has an unknown match type, action or type")
        out.append(rule)
    return tuple(out)


def in_order(rules: tuple[ColumnRule, ...]) -> list[tuple[int, ColumnRule]]:
    """(position as given, rule) by priority, stable."""
    return sorted(enumerate(rules), key=lambda x: x[1].priority)


def java_pattern(pattern: str) -> str:
    """The pattern with Unicode classes, and with only a line feed ending a line."""
    return "(?Ud)" + pattern


def match_header(name: Column, rules: tuple[ColumnRule, ...] = COLUMNS) -> Column:
    """The position of the rule that a header matches: exact rules before regular expressions, each by priority."""
    text, chain = F.trim(name), F.lit(None).cast("int")
    ordered = in_order(rules)
    for kind in ("regex", "exact"):
        for i, r in reversed([x for x in ordered if x[1].match_type == kind]):
            hit = text == r.pattern if kind == "exact" else text.rlike(java_pattern(r.pattern))
            chain = F.when(hit, F.lit(i)).otherwise(chain)
    return F.when(F.length(text) > 0, chain)


def column_rules_df(spark: SparkSession, rules: tuple[ColumnRule, ...] = COLUMNS) -> DataFrame:
    rows = [(i, r.match_type, r.pattern, r.action, json.dumps(r.params, ensure_ascii=False), r.detected_type, r.priority) for i, r in enumerate(rules)]
    return spark.createDataFrame(rows, "ord int, match_type string, pattern string, action string, params string, detected_type string, priority int")


def pattern_rules_df(spark: SparkSession, rules: tuple[PatternRule, ...] = PATTERNS) -> DataFrame:
    rows = [(i, r.name, r.detected_type, "dict" if r.pattern is None else "regex", r.priority, r.pattern, list(r.words), r.description) for i, r in enumerate(rules)]
    return spark.createDataFrame(rows, "ord int, name string, detected_type string, kind string, priority int, pattern string, words array<string>, description string")


# The action and its parameters for a find of the full-text scan.
DEFAULTS = {"amount": ("precision", {"unit": "million", "decimal_places": 2}), "entity": ("alias", {"prefix": "公司"}), "person": ("mask_name", {}), "account": ("mask_account", {"keep_prefix": 3, "keep_suffix": 4})}


def default_action(detected_type: Column) -> Column:
    """struct<action, params> for a type; params is JSON."""
    out = F.lit(None).cast("struct<action:string,params:string>")
    for kind, (action, params) in DEFAULTS.items():
        out = F.when(detected_type == kind, F.struct(F.lit(action).alias("action"), F.lit(json.dumps(params, ensure_ascii=False) if params else None).cast("string").alias("params"))).otherwise(out)
    return out
