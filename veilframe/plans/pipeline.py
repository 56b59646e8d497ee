"""Generating a strategy from documents, and executing strategies to masked documents with marks and audit logs."""

from __future__ import annotations

import getpass
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.functions.identity import encode_mark, mark_payload
from veilframe.operators import apply, classify, headers, scan
from veilframe.operators.rules import COLUMNS, PATTERNS, ColumnRule, PatternRule, column_rules_df
from veilframe.plans.work import Work
from veilframe.sources import audit, pptx, strategy, xlsx
from veilframe.sources.files import documents, exists, log_name, output_name, target_names, write_file, write_pieces


@dataclass
class Options:
    operator: str = ""
    force: bool = False
    dry_run: bool = False
    columns: tuple[ColumnRule, ...] = COLUMNS
    patterns: tuple[PatternRule, ...] = PATTERNS
    timestamp: str = ""

    def __post_init__(self):
        self.operator = self.operator or user()
        self.timestamp = self.timestamp or datetime.now().strftime("%Y-%m-%dT%H:%M:%S")


def user() -> str:
    try:
        return getpass.getuser()
    except (KeyError, OSError):
        return "unknown"


@dataclass
class Scan:
    """Documents read once, with what was found in them."""

    files: DataFrame
    cells: DataFrame
    sheets: DataFrame
    spans: DataFrame
    names: DataFrame
    texts: DataFrame
    sites: DataFrame
    rules: DataFrame
    errors: DataFrame


def scan_documents(spark: SparkSession, path: str, options: Options) -> Scan:
    files, work = documents(spark, path), Work(spark, "scan")
    books = work.keep(xlsx.read(files.filter("extension = 'xlsx'")), "books")
    decks = work.keep(pptx.read(files.filter("extension = 'pptx'")), "decks")
    cells, sheets, merges = xlsx.tables(books)
    texts = pptx.texts(decks)
    # Each step is written once: the later plans use it several times.
    typed = work.keep(classify.with_fallback(sheets, classify.classify(cells, sheets)), "types")
    visible = cells.join(typed.select(*classify.SHEET), classify.SHEET, "left_semi")
    data = typed.filter("sheet_type = 'data'")
    scored = headers.row_scores(headers.row_values(visible.join(data.select(*classify.SHEET), classify.SHEET, "left_semi"), data))
    spans = work.keep(headers.header_spans(work.keep(scored, "scores")), "spans")
    names = work.keep(headers.unique_names(headers.header_names(visible, spans, data, merges)), "names")
    found = work.keep(scan.scan_workbook(visible, typed, spans, names, options.columns, options.patterns), "found")
    common = ["file", "site_id", "location", "original_value", "detected_type", "discovered_by", "action", "params", "order"]
    on_sheets = found.withColumn("order", F.array(F.col("sheet_idx").cast("int"), "row", "col", "rule_ord", "start")).select(*common)
    on_slides = work.keep(scan.scan_deck(texts, options.columns, options.patterns), "found-in-decks").withColumn("order", F.array("slide", F.col("part_ord"), "shape_ord", F.coalesce("row", F.col("para_idx")), F.coalesce("col", F.lit(0)), "rule_ord", "start")).select(*common)
    both = on_sheets.unionByName(on_slides)
    # The order of the scan as one number: a dense rank within the file, made global by the file's own rank.
    ranked = both.sort("file", "order").withColumn("ord", F.monotonically_increasing_id()).withColumn("enabled", F.lit(True)).drop("order")
    sites = scan.dedup_sites(ranked.withColumn("place", scan.location_text(F.col("location"))), ["file", "place", "original_value"]).drop("place")
    sites = work.keep(sites, "sites")
    rules = scan.sheet_rules(names, options.columns)
    errors = books.select("file", "error").unionByName(decks.select("file", "error")).filter("error is not null")
    return Scan(files, visible, typed, spans, names, texts, sites, rules, errors)


def exact_rules(found: Scan) -> list[ColumnRule]:
    """The column rules of a strategy: exact names, the first of each, in sheet order."""
    import json

    first = found.rules.groupBy("name").agg(F.min(F.struct("file", "sheet_idx", "col", "action", "params", "detected_type")).alias("x"))
    rows = first.orderBy("x").collect()  # at most one for each header name, for a review to read
    return [ColumnRule("exact", r["name"], r["x"]["action"], json.loads(r["x"]["params"]) if r["x"]["params"] else {}, r["x"]["detected_type"]) for r in rows]


def generate(spark: SparkSession, path: str, options: Options | None = None) -> strategy.Strategy:
    """A strategy for all documents of a path; the hash of several files is that of their sorted hashes."""
    options = options or Options()
    found = scan_documents(spark, path, options)
    digests = [r["sha256"] for r in found.files.select("sha256").collect()]
    digest = digests[0] if len(digests) == 1 else spark.range(1).select(F.sha2(F.lit("".join(sorted(digests))), 256)).first()[0] if digests else ""
    return strategy.Strategy(path, digest, options.timestamp, column_rules=exact_rules(found), sites=strategy.site_dicts(found.sites))


def changes_of(spark: SparkSession, found: Scan, plan: strategy.Strategy | None, options: Options) -> tuple[DataFrame, DataFrame]:
    """(sites, changes) of a strategy, or of the default one made from the scan."""
    if plan is None:
        sites, rules = found.sites, column_rules_df(spark, tuple(exact_rules(found)))
    else:
        named = strategy.sites_frame(spark, plan, None)
        # A site that names no file is one of every file. A strategy is what a person reviews, so it is the small side.
        everywhere = found.files.select(F.col("path").alias("file")).join(F.broadcast(named.filter("file is null").drop("file")))
        sites = named.filter("file is not null").unionByName(everywhere)
        rules = column_rules_df(spark, tuple(plan.column_rules))
    by_rule = apply.of_column_rules(found.cells, found.names, found.spans, rules)
    work = Work(spark, "requests")
    by_rule = work.keep(by_rule, "by-rule")
    written = by_rule.select("file", "sheet", "cell").distinct()
    requests = by_rule.unionByName(apply.of_sites(found.cells, sites, written)).unionByName(apply.of_deck_sites(found.texts, sites))
    return sites, apply.changes(work.keep(requests, "requests"))


def redact(spark: SparkSession, path: str, folder: str, plan: strategy.Strategy | None = None, options: Options | None = None) -> DataFrame:
    """Masks all documents of a path into a folder: file, status (ok, skipped_exists, failed, dry_run), counts, output.

    Each document is rewritten by one task, once, with all its edits and its mark.
    """
    options = options or Options()
    found = scan_documents(spark, path, options)
    sites, done = changes_of(spark, found, plan, options)
    work = Work(spark, "redact")
    done = work.keep(done, "changes")
    report = apply.report(sites, done)
    names = found.files.select(F.col("path").alias("file"), "extension", "sha256")
    counts = names.join(report, "file", "left").join(found.errors, "file", "left").na.fill(0, ["processed", "skipped", "errors"])
    if options.dry_run:
        return counts.select("file", F.when(F.col("error").isNotNull(), F.lit("failed")).otherwise(F.lit("dry_run")).alias("status"), "processed", "skipped", "errors", F.lit(None).cast("string").alias("output"), "error")
    edit = F.struct("ord", "sheet", "cell", F.col("location.slide").alias("slide"), "original", "new_text", "redacted", F.col("location.shape_id").alias("shape"), F.col("location.table_location").alias("place"))
    edits = done.filter("error is null").groupBy("file").agg(F.sort_array(F.collect_list(edit)).alias("edits"))
    marks = scan.mark_places(found.cells, found.sheets).select("file", "sheet", scan.coordinate("row", "col").alias("cell"), "text")
    marks = marks.groupBy("file").agg(F.collect_list(F.struct("sheet", "cell", "text")).alias("marks"))
    mark = encode_mark(mark_payload(F.lit(options.operator), F.lit(options.timestamp), F.col("sha256")))
    targets = target_names(found.files)
    rows = found.files.withColumnRenamed("path", "file").join(targets, "file").withColumn("mark", mark).join(edits, "file", "left").join(marks, "file", "left").join(found.errors, "file", "left")
    out = work.keep(rows.mapInPandas(writer(folder, options.force), "file string, status string, output string, error string"), "written")
    logs = audit.audit_parts(names.join(out, "file").select("file", F.col("file").alias("source_path"), F.col("output").alias("output_file"), F.col("sha256").alias("file_hash"), "status").filter("status = 'ok'").drop("status"), done, options.operator, F.lit(options.timestamp))
    logs.join(targets, "file").repartition("file").sortWithinPartitions("file", "section", "part").select("file", "target", "text").mapInPandas(log_writer(folder), "file string").count()
    return counts.drop("error").join(out, "file").select("file", "status", "processed", "skipped", "errors", "output", "error")


def writer(folder: str, force: bool):
    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.to_dict("records"):
                target, status, error = output_name(r["target"], r["file"].rpartition(".")[2], folder), "ok", r["error"]
                try:
                    if error is not None:
                        status = "failed"
                    elif exists(target) and not force:
                        status = "skipped_exists"
                    else:
                        edits = r["edits"] if r["edits"] is not None else []
                        write_file(target, rewritten(r, edits))
                except Exception as e:  # noqa: BLE001  one document's failure is its row's status
                    status, error = "failed", f"{type(e).__name__}: {e}"
                yield pd.DataFrame([{"file": r["file"], "status": status, "output": target if status == "ok" else None, "error": error}])

    return write


def rewritten(r: dict, edits: list) -> bytes:
    """A document with its edits and its mark."""
    if r["extension"] == "pptx":
        return pptx.edit(r["content"], [(int(e["slide"]), e["original"], e["redacted"], e["shape"], e["place"]) for e in edits], r["mark"])
    if r["extension"] != "xlsx":
        raise ValueError(f"not a workbook or deck: {r['file']}")
    cells = {(e["sheet"], e["cell"]): e["new_text"] for e in edits}
    for m in r["marks"] if r["marks"] is not None else []:
        key = (m["sheet"], m["cell"])
        cells[key] = cells.get(key, m["text"]) + r["mark"]
    return xlsx.edit(r["content"], cells)


def log_writer(folder: str):
    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces = (x for batch in batches for x in zip(batch["file"], batch["target"], batch["text"], strict=True))
        for (file, target), own in groupby(pieces, lambda x: x[:2]):
            write_pieces(log_name(target, folder), (text.encode("utf-8") for *_, text in own))
            yield pd.DataFrame({"file": [file]})

    return write
