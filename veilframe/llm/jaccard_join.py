"""Exact Jaccard self-join of documents on word shingles, by prefixes of token combinations.

1. Documents with equal sets are one class. A class's *sample* is the first part of its set in hash order, long enough
   that two sets that link share at least ``need`` tokens of their samples; classes that share fewer with all others
   are done.
2. For the classes left, a token's frequency is the number of their sets that hold it. Tokens that only one set holds
   match nothing, so the rest of a set bounds every overlap; classes whose bound is too low are done.
3. Sets are ordered by frequency. Of its prefix, a class is indexed under each token of a rare class, and under each
   pair of tokens of the frequent class, from a prefix longer by one (two sets that link, and whose first common token is
   frequent, share two such). Long prefixes use single tokens instead; sizes near the border are indexed both ways.
4. In each list one member is the pivot: the one whose set is shared most, with most copies. All others are verified
   against it, so a group of n near copies costs n verifications. Then members outside the pivot's component are
   compared with the members of other components, as far as sizes, bounds, places in the prefixes and the overlaps with
   the pivot allow a link.
   So no link between two components is lost, and members of one component are not paired.
5. Components by distributed union-find.

Defined cases: null, empty and white-space texts have an empty set and link with nothing; fewer words than a shingle's
are one shingle; a null id never names a component that has another id; repeated rows give a row each; an empty table
gives no rows. Only doc_id and text are read, so other columns' names can't clash; ``keep_one`` returns all columns of
its input.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.llm.components import components
from veilframe.llm.shared import Workspace, give_back, join_heavy_apart
from veilframe.llm.shingles import WordHasher, shingle_set

#: A token that at most so many sets hold is of the rare class.
RARE = 16
#: Prefixes longer than this use single tokens of the frequent class: so pairs are at most 12.5 times as many keys.
PAIR_PREFIX = 24
#: Ids up to which a selection of documents is broadcast (at most 60 bytes each); beyond, it is joined by shuffle.
BROADCAST_IDS = 500_000


class Measure:
    """The arithmetic of a Jaccard threshold in percent; Python ints, numpy arrays and Columns alike."""

    def __init__(self, percent: int):
        if not 51 <= percent <= 100:
            raise ValueError("the threshold is from 51 to 100 percent")  # so that sets that link share two tokens at least
        self.percent = percent

    def overlap(self, n):
        """Least overlap of a set of n with any set that it links with."""
        return (n * self.percent + 99) // 100

    def prefix(self, n):
        return n - self.overlap(n) + 1

    def need(self, n):
        """Tokens of their samples that two sets share if the smaller one has n; it never falls with n."""
        return np.maximum(1, n // 10)

    def sample(self, n):
        return self.prefix(n) + self.need(n) - 1

    def need_of_partner(self, n):
        """What need() gives for the smallest set that a set of n links with."""
        return self.need((n * self.percent + 99) // 100)

    def pair_overlap(self, n: Column, m: Column) -> Column:
        """Whether an overlap suffices is overlap * (100 + percent) >= this."""
        return (n + m) * self.percent

    def links(self, overlap: Column, n: Column, m: Column) -> Column:
        return overlap * (100 + self.percent) >= self.pair_overlap(n, m)


def sets_of(docs: DataFrame, words: int, measure: Measure | None) -> DataFrame:
    """doc_id, n, digest and tokens (the sample under a measure, else all) of every document."""
    schema = "doc_id long, n long, digest binary, need long, tokens array<long>"

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                sizes, digests, needs, tokens = [], [], [], []
                for own in hasher.documents([x.as_py() or "" for x in part["text"]]):
                    found = shingle_set(own, words)
                    n = len(found)
                    sizes.append(n)
                    digests.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest() if n else None)
                    needs.append(int(measure.need_of_partner(n)) if measure else 0)
                    tokens.append(found[: int(measure.sample(n))] if measure else found)
                offsets = np.concatenate([[0], np.cumsum([len(t) for t in tokens])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(tokens) if tokens else np.empty(0, np.int64)))
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(needs, pa.int64()), lists], names=["doc_id", "n", "digest", "need", "tokens"])
        del hasher
        give_back()

    wanted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return wanted.mapInArrow(rows, schema)


def candidates_by_sample(classes: DataFrame, work: Workspace) -> DataFrame:
    """The nodes that share enough of their sample with others."""
    tokens = classes.select("node", F.explode("tokens").alias("token"))
    shared = tokens.groupBy("token").agg(F.count("*").alias("sets")).filter("sets > 1").select("token")
    shared = work.keep(shared, "shared")
    found = tokens.join(shared, "token").groupBy("node").agg(F.count("*").alias("found"))
    enough = found.join(classes.select("node", "need"), "node").filter("found >= need").select("node")
    return work.keep(enough, "enough")


def full_sets(docs: DataFrame, chosen: DataFrame, words: int, work: Workspace) -> DataFrame:
    """node, n, copies and all tokens of the chosen classes (node, digest, keep_id, copies)."""
    ids = chosen.select(F.col("keep_id").alias("id"))
    total = chosen.count()
    few = total <= BROADCAST_IDS
    ids = F.broadcast(ids) if few else ids
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    own = own.join(ids, F.col("doc_id").eqNullSafe(F.col("id")), "left_semi")
    found = sets_of(own, words, None).filter("n > 0").select("digest", "n", "tokens")
    known = chosen.select("digest", "node", "copies")
    found = work.keep(found.join(F.broadcast(known) if few else known, "digest").select("node", "n", "copies", "tokens"), "found-sets")
    if found.count() == total:
        return found
    # Rows that are repeated, or share an id, gave a set more than once.
    return work.keep(found.groupBy("node").agg(F.first("n").alias("n"), F.first("copies").alias("copies"), F.first("tokens").alias("tokens")), "sets")


def ordered_sets(sets: DataFrame, measure: Measure, work: Workspace) -> DataFrame:
    """node, n, copies, useful (tokens that other sets hold too), tokens (those, by frequency) where a link is possible."""
    tokens = sets.select("node", F.explode("tokens").alias("token"))
    common = work.keep(tokens.groupBy("token").agg(F.count("*").alias("sets")).filter("sets > 1"), "frequencies")
    useful = tokens.join(common, "token").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("sets", "token"))).alias("useful_tokens"))
    out = sets.select("node", "n", "copies").join(useful, "node").withColumn("useful", F.size("useful_tokens").cast("long"))
    return work.keep(out.filter(F.col("useful") * 100 >= F.col("n") * measure.percent), "ordered")


def index_keys(ordered: DataFrame, measure: Measure, work: Workspace) -> DataFrame:
    """(key, node) of every class: rare tokens, pairs of frequent tokens, frequent tokens of long prefixes.

    room: the most that two sets can share if the key is the first that they have in common, by what follows it.
    """
    least = F.floor((F.col("n") * measure.percent + 99) / 100)
    prefix = F.greatest(F.lit(1), F.col("useful") - least + 1).cast("int")
    border = 0
    while measure.prefix(border) <= PAIR_PREFIX:
        border += 1  # sets of this size on have longer prefixes
    kind = "struct<key:bigint,room:bigint>"
    rows = ordered.withColumn("prefix", prefix)
    placed = F.transform(F.slice("useful_tokens", F.lit(1), F.col("prefix") + 1), lambda x, i: F.struct(x["sets"].alias("sets"), x["token"].alias("token"), i.alias("at")))
    key = lambda room, *xs: F.struct(F.xxhash64(*[x["token"] for x in xs]).alias("key"), room.alias("room")).cast(kind)
    one = lambda x: key(F.col("useful") - x["at"], x)
    rare = F.transform(F.filter(placed, lambda x: (x["at"] < F.col("prefix")) & (x["sets"] <= RARE)), one)
    often = F.filter(placed, lambda x: x["sets"] > RARE)
    singles = F.transform(F.filter(often, lambda x: x["at"] < F.col("prefix")), one)
    pairs = F.flatten(F.transform(often, lambda x, i: F.transform(F.slice(often, i + 2, F.size(often)), lambda y: key(F.col("useful") - y["at"] + 1, x, y))))
    none = F.array().cast(f"array<{kind}>")
    pairs = F.when((F.col("n") < border) & (F.size(often) > 1), pairs).otherwise(none)
    singles = F.when(F.col("n") * 100 >= border * measure.percent, singles).otherwise(none)
    keys = rows.select("node", "n", "copies", "useful", F.explode(F.array_distinct(F.concat(rare, pairs, singles))).alias("k"))
    return work.keep(keys.select("node", "n", "copies", "useful", "k.key", "k.room"), "keys")


def verify(pairs: DataFrame, sets: DataFrame, measure: Measure, work: Workspace, label: str, tokens: Callable[[Column], Column]) -> DataFrame:
    """(a, b) with their overlap and whether they link. sets: node, n and body, from which tokens() gives the set."""
    a, b = (sets.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("body").alias(f"body_{x}")) for x in "ab")
    both = pairs.join(a, "a").join(b, "b")
    overlap = F.size(F.array_intersect(tokens(F.col("body_a")), tokens(F.col("body_b")))).cast("long")
    out = both.select("a", "b", "n_a", "n_b", overlap.alias("overlap"))
    return work.keep(out.select("a", "b", "overlap", measure.links(F.col("overlap"), F.col("n_a"), F.col("n_b")).alias("linked")), label)


def possible(measure: Measure, x: str, y: str) -> Column:
    """Whether sizes and bounds of two rows let them link."""
    need = measure.pair_overlap(F.col(f"{x}.n"), F.col(f"{y}.n"))
    scale = 100 + measure.percent
    return (F.least(f"{x}.useful", f"{y}.useful") * scale >= need) & (F.least(f"{x}.n", f"{y}.n") * scale >= need)


def linked_classes(keys: DataFrame, sets: DataFrame, measure: Measure, work: Workspace, tokens: Callable[[Column], Column] = lambda body: body, indexed: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(node, root) of every class that links with another of a list.

    keys: key, node, n, copies, useful (the tokens of a set that others of its lists may hold; n is always right), and
    room where it is known (the most that a set can share with one whose first common key this is).
    sets: node, n, body. indexed, where keys alone don't tell enough of a pair: (a, b) of all that may link of different
    roots, from the members (key, node, n, root, outside: of another component than the pivot's, least_n: no partner is
    smaller) of the lists that hold several components.
    """
    best = F.max(F.struct((F.col("useful") / F.col("n")).alias("share"), "copies", "n", "useful", "node"))
    lists = keys.groupBy("key").agg(F.count("*").alias("members"), best.alias("pivot")).filter("members > 1")
    lists = work.keep(lists.select("key", F.col("pivot.node").alias("pivot"), F.col("pivot.n").alias("pivot_n"), F.col("pivot.useful").alias("pivot_useful"), "members"), "lists")
    member = work.keep(keys.join(lists, "key"), "members")
    work.drop("lists")
    work.release()
    scale = 100 + measure.percent
    need = (F.col("n") + F.col("pivot_n")) * measure.percent
    fits = (F.least("useful", "pivot_useful", "n", "pivot_n") * scale >= need) & (F.col("node") != F.col("pivot"))
    spokes = member.filter(fits).select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct()
    spokes = work.keep(spokes, "spoke-pairs")
    work.release()
    first = verify(spokes, sets, measure, work, "spokes", tokens)
    work.drop("spoke-pairs")
    work.release()
    roots = components(first.filter("linked").select("a", "b"), work, "roots")
    roots = work.keep(roots, "first-roots")

    # Members outside the pivot's component, with the others of their list. Overlaps with the pivot bound those of pairs.
    known = first.select("a", "b", "overlap")
    known = work.keep(known.unionByName(known.select(F.col("b").alias("a"), F.col("a").alias("b"), "overlap")), "overlaps")
    of = roots.select(F.col("node").alias("other"), "root")
    # A list of two is its pivot and one other, so it has no further pair.
    room = ["room"] if "room" in keys.columns else []
    row = member.filter("members > 2").select("key", "node", "n", "useful", "pivot", *room)
    row = row.join(of, F.col("node") == F.col("other"), "left").withColumn("root", F.coalesce("root", "node")).drop("other")
    pivots = of.select(F.col("other").alias("p"), F.col("root").alias("pivot_root"))
    row = row.join(pivots, F.col("pivot") == F.col("p"), "left").withColumn("pivot_root", F.coalesce("pivot_root", "pivot")).drop("p")
    row = row.withColumn("outside", F.col("root") != F.col("pivot_root"))
    mixed = row.groupBy("key").agg(F.count_if("outside").alias("strays"), F.min("n").alias("least_n")).filter("strays > 0").select("key", "least_n")
    # A stray links with nothing of its list if even the smallest member is too large for its bound.
    row = work.keep(row.join(mixed, "key").filter((F.col("node") != F.col("pivot")) & (F.col("useful") * scale >= (F.col("n") + F.col("least_n")) * measure.percent)), "mixed")
    work.drop("members")
    work.release()
    if indexed is not None:
        pairs = indexed(row)
    else:
        seen = known.select(F.col("a").alias("node"), F.col("b").alias("pivot"), "overlap")
        row = work.keep(row.join(seen, ["node", "pivot"], "left"), "bounded")
        x, y = row.filter("outside").alias("x"), row.alias("y")
        both_known = F.col("x.overlap").isNotNull() & F.col("y.overlap").isNotNull()
        within = F.least("x.overlap", "y.overlap")
        beyond = F.least(F.col("x.useful") - F.col("x.overlap"), F.col("y.useful") - F.col("y.overlap"))
        bound = ~both_known | ((within + beyond) * scale >= measure.pair_overlap(F.col("x.n"), F.col("y.n")))
        if room:
            # Sets that link pass this at their first common key, though not at each later one.
            bound = bound & (F.least("x.room", "y.room") * scale >= measure.pair_overlap(F.col("x.n"), F.col("y.n")))
        once = ~F.col("y.outside") | (F.col("x.node") < F.col("y.node"))
        pairs = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.root") != F.col("y.root")) & once & possible(measure, "x", "y") & bound)
        pairs = pairs.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()
    pairs = work.keep(pairs.join(first.select("a", "b"), ["a", "b"], "left_anti"), "pairs")
    work.release()
    second = verify(pairs, sets, measure, work, "checked", tokens)
    if second.filter("linked").isEmpty():
        return roots
    return components(first.filter("linked").select("a", "b").unionByName(second.filter("linked").select("a", "b")), work, "final")


def join(docs: DataFrame, words: int, percent: int, work: Workspace) -> DataFrame:
    """doc_id, n_shingles, component_id, copies of every document; digest is its set's."""
    measure = Measure(percent)
    rows = work.keep(sets_of(docs, words, measure), "rows")
    classes = rows.filter("n > 0").groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("need").alias("need"), F.first("tokens").alias("tokens"))
    classes = work.keep(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    rows = work.keep(rows.select("doc_id", "n", "digest"), "ids")
    work.drop("rows")
    work.release()
    narrow = work.keep(classes.select("node", "digest", "keep_id", "copies", "n"), "narrow")
    chosen = work.keep(narrow.join(candidates_by_sample(classes, work), "node"), "chosen")
    for done in ("classes", "shared", "enough"):
        work.drop(done)
    work.release()
    sets = full_sets(docs, chosen, words, work)
    ordered = ordered_sets(sets, measure, work)
    work.release()
    bodies = sets.select("node", "n", F.col("tokens").alias("body"))
    roots = work.keep(linked_classes(index_keys(ordered, measure, work), bodies, measure, work), "linked")
    # A component's name is the smallest id of its documents.
    groups = roots.join(narrow.select("node", "keep_id"), "node").groupBy("root").agg(F.min("keep_id").alias("component_id"))
    named = roots.join(groups, "root").select("node", "component_id", F.lit(True).alias("is_linked"))
    names = narrow.join(named, "node", "left").select("digest", "copies", F.when(F.col("is_linked"), F.col("component_id")).otherwise(F.col("keep_id")).alias("component_id"))
    names = work.keep(names, "names")
    full = join_heavy_apart(rows.filter("n > 0").select("doc_id", F.col("n").alias("n_shingles"), "digest"), names, "digest", "copies", rows.count())
    empty = rows.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), "digest", F.lit(1).cast("long").alias("copies"), F.col("doc_id").alias("component_id"))
    return full.select("doc_id", "n_shingles", "digest", "copies", "component_id").unionByName(empty)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: near-duplicate components at three words and 90 percent."""
    out = join(spark.read.parquet(f"{sf_dir}/documents.parquet"), 3, 90, Workspace(spark, "op5"))
    return out.select("doc_id", "n_shingles", "component_id")


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """docs without the documents of a component other than its smallest id; documents without words stay.

    Rows that share an id (or have none) stay or go together: they stay if one of them does.
    """
    work = Workspace(docs.sparkSession, "near")
    found = join(docs, words, percent, work)
    stays = (F.col("n_shingles") == 0) | F.col("doc_id").eqNullSafe(F.col("component_id"))
    drop = work.keep(found.groupBy("doc_id").agg(F.max(stays).alias("stays")).filter("not stays").select(F.col("doc_id").alias("id")), "dropped")
    drop = F.broadcast(drop) if drop.count() <= BROADCAST_IDS else drop
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("k"))
    return row.join(drop, F.col("k").eqNullSafe(F.col("id")), "left_anti").select("row.*")
