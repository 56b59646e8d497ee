"""Mixing sources to target weights by hierarchical budgets.

Documents are leaves' members in a tree domain > language > source. From the root down, a node's budget of tokens is
shared among its children by weight; a child gets no more than its whole subtree can supply in ``max_epochs`` epochs,
and what it can't take goes to its siblings by weight, before anything is left for other branches. A leaf's budget
fills whole epochs first, then a prefix of one more: its documents in the order of a seeded hash that differs by epoch,
up to and with the one that reaches the budget. So a leaf exceeds its budget by less than one document.

The shares are closed-form window sums over the few rows of the tree. The prefix needs no sort of a leaf: token sums by
ranges of the hash show in which range the cut lies, and only that range of the leaf is sorted.

Defined cases: null domain, language and source count as the name ``?``; a null text has no words, and each document
counts one token besides its words; nodes without a given weight have weight 1, those of weight 0 get nothing; documents
with equal id in one leaf and epoch are taken together; an empty table gives no rows. ``mix`` returns its input's
columns whatever their names, as they travel in one struct.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veilframe.llm.shared import Workspace, text_of

LEVELS = ("domain", "language", "source")
RANGE_BITS = 12
#: Leaves up to which the plan of leaves is broadcast (about 100 bytes each); beyond, it is joined by shuffle.
BROADCAST_LEAVES = 100_000


class Targets(NamedTuple):
    """Weights of nodes by path, such as ("web",), ("web", "en") and ("web", "en", "news"); others weigh 1."""

    weights: dict[tuple[str, ...], float]
    budget_share: float = 0.8
    max_epochs: int = 2
    seed: int = 17


def word_tokens(text: Column) -> Column:
    """A document's tokens: its words and one separator."""
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long") + 1


def turn_of(doc_id: Column, epoch: Column, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), epoch, doc_id)


def range_of(turn: Column) -> Column:
    return F.shiftright(turn, 64 - RANGE_BITS)


def weight_of(targets: Targets, depth: int) -> Column:
    """The weight of a row's node at a depth, from 1."""
    out = F.lit(1.0)
    for path, w in targets.weights.items():
        if len(path) == depth:
            same = F.lit(True)
            for level, name in zip(LEVELS, path, strict=False):
                same = same & (F.col(level) == name)
            out = F.when(same, F.lit(float(w))).otherwise(out)
    return out


def share_out(nodes: DataFrame, parent: list[str]) -> DataFrame:
    """nodes (…, weight, capacity, parent_budget) with budget: each parent's budget by weight, up to the capacities."""
    usable = F.when(F.col("weight") > 0, F.col("capacity")).otherwise(0.0)
    nodes = nodes.withColumn("usable", usable).withColumn("ratio", F.when(F.col("weight") > 0, F.col("usable") / F.col("weight")).otherwise(0.0))
    order = Window.partitionBy(*[F.col(c) for c in parent]).orderBy("ratio", *LEVELS[: len(parent)])
    upward = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(0, Window.unboundedFollowing)
    level = F.when(F.col("rest_weight") > 0, (F.col("parent_budget") - F.col("taken")) / F.col("rest_weight")).otherwise(0.0)
    nodes = nodes.withColumn("taken", F.coalesce(F.sum("usable").over(upward), F.lit(0.0))).withColumn("rest_weight", F.sum("weight").over(onward)).withColumn("level", level)
    nodes = nodes.withColumn("full", F.col("ratio") <= F.col("level"))
    everyone = Window.partitionBy(*[F.col(c) for c in parent])
    common = F.min(F.when(~F.col("full"), F.struct("ratio", "level"))).over(everyone)["level"]
    budget = F.when(F.col("full"), F.col("usable")).otherwise(F.least(F.col("usable"), F.greatest(F.lit(0.0), common * F.col("weight"))))
    return nodes.withColumn("budget", budget).drop("usable", "ratio", "taken", "rest_weight", "level", "full")


def budgets(leaves: DataFrame, targets: Targets) -> DataFrame:
    """leaves (domain, language, source, supply) with the budget of each."""
    tree = leaves.withColumn("capacity", F.col("supply").cast("double") * targets.max_epochs)
    one = F.lit(0).alias("root")
    total = tree.groupBy(one).agg((F.sum(F.col("supply").cast("double")) * targets.budget_share).alias("parent_budget"))
    above = total
    for depth in (1, 2, 3):
        keys = list(LEVELS[:depth])
        nodes = tree.groupBy(one, *keys).agg(F.sum("capacity").alias("capacity")).withColumn("weight", weight_of(targets, depth))
        nodes = nodes.join(F.broadcast(above) if depth == 1 else above, ["root", *keys[:-1]])
        above = share_out(nodes, ["root", *keys[:-1]]).select("root", *keys, F.col("budget").alias("parent_budget"))
    return leaves.join(above.withColumnRenamed("parent_budget", "budget").drop("root"), list(LEVELS))


def leaf_columns(domain: Column, language: Column, source: Column) -> list[Column]:
    return [F.coalesce(c.cast("string"), F.lit("?")).alias(n) for n, c in zip(LEVELS, (domain, language, source), strict=True)]


class Plan(NamedTuple):
    """leaves: domain, language, source, supply, budget, whole (epochs), rest (tokens), cut_turn, cut_id."""

    leaves: DataFrame
    broadcast: bool


def plan(members: DataFrame, targets: Targets, work: Workspace) -> Plan:
    """How much each leaf gives, and where the prefix of its last epoch ends. members: leaf columns, doc_id, tokens."""
    leaves = members.groupBy(*LEVELS).agg(F.sum("tokens").alias("supply"))
    leaves = work.keep(leaves, "leaves")
    small = leaves.count() <= BROADCAST_LEAVES
    shared = budgets(leaves, targets).withColumn("whole", F.floor(F.col("budget") / F.col("supply")).cast("int"))
    shared = shared.withColumn("rest", F.floor(F.col("budget") - F.col("whole") * F.col("supply")).cast("long"))
    shared = work.keep(shared, "shares")
    ends = shared.filter("rest > 0").select(*LEVELS, "whole", "rest")
    row = members.join(F.broadcast(ends) if small else ends, list(LEVELS)).withColumn("turn", turn_of(F.col("doc_id"), F.col("whole"), targets.seed)).withColumn("range", range_of(F.col("turn")))
    sums = row.groupBy(*LEVELS, "range", "rest").agg(F.sum("tokens").alias("tokens"))
    before = F.sum("tokens").over(Window.partitionBy(*LEVELS).orderBy("range")) - F.col("tokens")
    cut = sums.withColumn("before", before).filter("before < rest and before + tokens >= rest").select(*LEVELS, F.col("range").alias("cut_range"), "before")
    cut = work.keep(cut, "cuts")
    inside = row.join(F.broadcast(cut) if small else cut, list(LEVELS)).filter("range = cut_range")
    inside = inside.groupBy(*LEVELS, "turn", "doc_id", "rest", "before").agg(F.sum("tokens").alias("tokens"))
    order = Window.partitionBy(*LEVELS).orderBy("turn", F.col("doc_id").asc_nulls_first())
    inside = inside.withColumn("ahead", F.col("before") + F.sum("tokens").over(order) - F.col("tokens")).filter("ahead < rest")
    last = inside.groupBy(*LEVELS).agg(F.max(F.struct("turn", F.coalesce("doc_id", F.lit(-(2**63))).alias("id"))).alias("last"))
    leaves = shared.join(last, list(LEVELS), "left").select(*LEVELS, "supply", "budget", "whole", "rest", F.col("last.turn").alias("cut_turn"), F.col("last.id").alias("cut_id"))
    return Plan(work.keep(leaves, "plan"), small)


def select(members: DataFrame, chosen: Plan, targets: Targets) -> DataFrame:
    """members once for each epoch that takes them, with epoch and turn (the order within leaf and epoch)."""
    leaves = F.broadcast(chosen.leaves) if chosen.broadcast else chosen.leaves
    row = members.join(leaves.select(*LEVELS, "whole", "rest", "cut_turn", "cut_id"), list(LEVELS))
    turn = turn_of(F.col("doc_id"), F.col("whole"), targets.seed)
    own = F.coalesce(F.col("doc_id"), F.lit(-(2**63)))
    inside = (F.col("rest") > 0) & ((turn < F.col("cut_turn")) | ((turn == F.col("cut_turn")) & (own <= F.col("cut_id"))))
    epochs = F.col("whole") + F.when(inside, 1).otherwise(0)
    row = row.filter(epochs > 0).withColumn("epoch", F.explode(F.sequence(F.lit(0), epochs - 1)))
    return row.withColumn("turn", turn_of(F.col("doc_id"), F.col("epoch"), targets.seed)).drop("whole", "rest", "cut_turn", "cut_id")


#: Domains of the synthetic sources: four groups by their number.
def domain_of(source: Column) -> Column:
    number = F.try_to_number(F.regexp_extract(F.coalesce(source, F.lit("")), r"(\d{1,9})\D*$", 1), F.lit("999999999"))
    return F.concat(F.lit("group"), F.coalesce(F.pmod(number.cast("int"), F.lit(4)), F.lit(0)).cast("string"))


PRODUCTION = Targets(
    weights={
        ("group0",): 4.0, ("group1",): 3.0, ("group2",): 2.0, ("group3",): 1.0,
        **{(g, lang): w for g in ("group0", "group1", "group2", "group3") for lang, w in (("en", 5.0), ("de", 2.0), ("fr", 2.0), ("es", 2.0))},
        ("group0", "en", "src0"): 2.0,
    }
)


def members_of(docs: DataFrame) -> DataFrame:
    return docs.select(*leaf_columns(domain_of(F.col("source")), F.col("lang"), F.col("source")), F.col("doc_id").cast("long").alias("doc_id"), word_tokens(text_of()).alias("tokens"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: the documents of the mixture, a row for each epoch that takes one."""
    work = Workspace(spark, "op4")
    members = work.keep(members_of(spark.read.parquet(f"{sf_dir}/documents.parquet")), "members")
    out = select(members, plan(members, PRODUCTION, work), PRODUCTION)
    return out.select("doc_id", *LEVELS, "tokens", "epoch", "turn")


def mix(docs: DataFrame, targets: Targets = PRODUCTION) -> DataFrame:
    """The rows of docs as often as the mixture takes them, with docs' own columns."""
    work = Workspace(docs.sparkSession, "mix")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    chosen = plan(work.keep(members_of(docs), "members"), targets, work)
    whole = docs.select(row, *leaf_columns(domain_of(F.col("source")), F.col("lang"), F.col("source")), F.col("doc_id").cast("long").alias("doc_id"))
    return select(whole, chosen, targets).select("row.*")
