"""Strategies: what a review reads and edits. YAML on the driver, DataFrames for execution."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

import yaml
from pyspark.sql import DataFrame, SparkSession

from veilframe.operators.rules import ACTIONS, MATCHES, TYPES, ColumnRule, RuleError
from veilframe.operators.scan import LOCATION

VERSION = "1.0"
COMMENT_LENGTH = 30
SITES = f"file string, ord long, site_id string, location {LOCATION}, original_value string, detected_type string, discovered_by string, enabled boolean, action string, params string, redacted_value string"
PLACE = ("type", "sheet", "cell", "column", "slide", "shape_id", "table_location")


@dataclass
class Strategy:
    source_file: str = ""
    source_hash: str = ""
    generated_at: str = ""
    version: str = VERSION
    column_rules: list[ColumnRule] = field(default_factory=list)
    sites: list[dict] = field(default_factory=list)


def valid(site: dict) -> None:
    place = site["location"]
    need = ("sheet", "cell") if place["type"] == "excel" else ("slide", "shape_id")
    if place["type"] not in ("excel", "ppt") or any(place.get(k) is None for k in need):
        raise RuleError(f"site {site['site_id']}: a location in {place['type']} needs {' and '.join(need)}")
    for key, allowed in (("action", ACTIONS), ("detected_type", TYPES), ("discovered_by", ("column_rule", "fulltext_scan"))):
        if site[key] not in allowed:
            raise RuleError(f"site {site['site_id']}: unknown {key} {site[key]}")


def load(text: str) -> Strategy:
    """A strategy of YAML text, with defaults for what is left out; each site's location is checked."""
    raw = yaml.safe_load(text) or {}
    meta = raw.get("metadata") or {}
    rules = []
    for x in raw.get("column_rules") or []:
        if x.get("match_type", "exact") not in MATCHES:
            raise RuleError(f"column rule {x.get('pattern')}: unknown match type {x['match_type']}")
        rules.append(ColumnRule(x.get("match_type", "exact"), str(x["pattern"]), x.get("action", "mask"), x.get("params") or {}, x.get("detected_type", "amount"), int(x.get("priority", 1))))
    sites = []
    for x in raw.get("sites") or []:
        place = {k: None for k in PLACE} | {"type": "excel"} | (x.get("location") or {})
        site = {"site_id": str(x["site_id"]), "location": place, "original_value": str(x.get("original_value", "")), "detected_type": x.get("detected_type", "amount"), "discovered_by": x.get("discovered_by", "fulltext_scan"), "enabled": bool(x.get("enabled", True)), "action": x.get("action", "mask"), "params": x.get("params") or {}, "redacted_value": x.get("redacted_value"), "file": x.get("file")}
        valid(site)
        sites.append(site)
    return Strategy(meta.get("source_file", ""), meta.get("source_hash", ""), str(meta.get("generated_at", "")), str(meta.get("version", VERSION)), rules, sites)


def dump(strategy: Strategy) -> str:
    """YAML text: metadata, column rules, sites; what is empty is left out, and each value's line says what it is."""
    meta = {"version": strategy.version, "source_file": strategy.source_file, "source_hash": strategy.source_hash, "generated_at": strategy.generated_at, "total_sites": len(strategy.sites)}
    rules = [{"match_type": r.match_type, "pattern": r.pattern, "action": r.action} | ({"params": r.params} if r.params else {}) | {"detected_type": r.detected_type} for r in strategy.column_rules]
    sites = []
    for s in strategy.sites:
        out = {"site_id": s["site_id"], "location": {k: v for k, v in s["location"].items() if v}, "original_value": s["original_value"], "detected_type": s["detected_type"], "discovered_by": s["discovered_by"], "enabled": s["enabled"], "action": s["action"]}
        sites.append(out | {k: s[k] for k in ("params", "redacted_value", "file") if s.get(k)})
    text = yaml.safe_dump({"metadata": meta, "column_rules": rules, "sites": sites}, allow_unicode=True, sort_keys=False, width=10**6)
    lines, kinds = [], iter(sites)
    for line in text.splitlines():
        if line.startswith("  original_value:"):
            s = next(kinds)
            short = " ".join(s["original_value"].split())[:COMMENT_LENGTH]
            # A block scalar's own line can't hold a comment that YAML would take for text.
            line += f"  # {s['detected_type']}: {short}" if not line.rstrip().endswith(("|-", "|", ">-", ">", "|+")) and line.count('"') % 2 == 0 and line.count("'") % 2 == 0 else ""
        lines.append(line)
    return "\n".join(lines) + "\n"


def sites_frame(spark: SparkSession, strategy: Strategy, file: str | None) -> DataFrame:
    """The sites as a DataFrame; those that don't name a file are the given file's (None: of no file)."""
    rows = [(s.get("file") or file, i, s["site_id"], tuple(s["location"].get(k) for k in PLACE), s["original_value"], s["detected_type"], s["discovered_by"], s["enabled"], s["action"], json.dumps(s["params"], ensure_ascii=False) if s["params"] else None, s.get("redacted_value")) for i, s in enumerate(strategy.sites)]
    return spark.createDataFrame(rows, SITES)


def site_dicts(sites: DataFrame) -> list[dict]:
    """Sites in their order, for a strategy. A review reads them all, so they are meant to be collected."""
    out = []
    for r in sites.orderBy("ord").collect():
        row = r.asDict(recursive=True)
        out.append({"site_id": row["site_id"], "location": row["location"], "original_value": row["original_value"], "detected_type": row["detected_type"], "discovered_by": row["discovered_by"], "enabled": row.get("enabled", True), "action": row["action"], "params": json.loads(row["params"]) if row["params"] else {}, "redacted_value": None, "file": row.get("file")})
    return out
