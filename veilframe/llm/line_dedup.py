"""Fuzzy line deduplication by MinHash, with built-in functions alone.

Lines (trimmed, in lower case) that are equal are one class; ``k1`` and ``k2`` are two 64-bit hashes that stand for a
line. A class's set are its line's windows of ``WIDTH`` characters, all of them. Its signature has, for each of
``MINIMA`` fixed numbers, the smallest of the windows' hashes xor that number: as hashes are random, two sets agree there
with the probability of their Jaccard similarity, whatever the number. A band is three of the minima; no two bands have
two minima in common. Classes that agree in a band are candidates: at similarity 0.8, 99.8 of 100 pairs. The sets of
candidates are compared exactly: of each list, all with its pivot, as in ``jaccard_join``, so that no group of near copies
is paired with itself; then members of lists that still hold several components, where prefixes of their sets, rarest
windows first, share a window (an exact filter, which also spares lines that have only a common passage in common).
Distributed union-find gives the components; of each, the line at the smallest (doc_id, line number) stays.

Texts are read where they are: windows are hashed and reduced to minima before anything is shuffled, and only lines
that are candidates are fetched once more.

Defined cases: null text counts as empty; blank lines are compared with nothing and stay; lines shorter than a window
match equal lines only; lines of any length are signed whole; a null id comes before all others; equal places (a
repeated row) are one place; an empty table gives no rows. Only doc_id and text are read, so other columns' names can't
clash.
"""

from __future__ import annotations

import random
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.llm.jaccard_join import Measure, linked_classes
from veilframe.llm.shared import Workspace, join_heavy_apart, text_of

WIDTH, PERCENT = 9, 80
MINIMA = 12
#: The triples {i, i + 1, i + 4} and {i, i + 2, i + 7} modulo 13, of which any two share one number, without those of 12.
BANDS = [b for i in range(MINIMA + 1) for b in (sorted((i + s) % (MINIMA + 1) for s in t) for t in ((0, 1, 4), (0, 2, 7))) if MINIMA not in b]
#: Bands whose keys are shuffled in one pass; a matter of disk alone.
BANDS_AT_ONCE = 5
#: Shares of the sets whose windows are shuffled one after the other; a matter of disk alone.
SHARES = 4
#: Windows that are hashed in one row; a matter of time alone.
BLOCK = 4
#: Bits of the map of a set's windows, by which pairs of a list are told apart; a matter of time alone.
MAP_BITS = 2048
#: A list of at most so many pairs of members is paired with itself; longer ones go by prefixes, which loses no link either.
PAIRED = 2_500
#: Spread evenly over 64 bits, so that they meet different hashes also of small sets.
NUMBERS = [((i << 64) // MINIMA + random.Random(20 + i).getrandbits(58)) - (1 << 63) for i in range(MINIMA)]
#: Lines up to which a selection of them is broadcast (at most 80 bytes each); beyond, it is joined by shuffle.
BROADCAST_LINES = 500_000


def windows(line: Column) -> Column:
    """The hashes of all windows of WIDTH characters, from left to right; for lines that have one."""
    wide = 4 * WIDTH  # characters of four bytes each, so that a window is found by its place
    # An array of one, as a lambda's variable is evaluated once and not for each window.
    code = F.array(F.encode(line, "UTF-32"))
    at = lambda c: F.sequence(F.lit(1), F.octet_length(c) - (wide - 1), F.lit(4))
    return F.element_at(F.transform(code, lambda c: F.transform(at(c), lambda i: F.xxhash64(F.substring(c, i, F.lit(wide))))), 1)


def as_compared(raw: str) -> Column:
    return F.lower(F.btrim(raw, F.lit(" \t\r")))


def lines_of(docs: DataFrame) -> DataFrame:
    """doc_id, line_no, line (as compared), k1, k2 of every line."""
    lines = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.posexplode(F.split(text_of(), "\n")).alias("line_no", "raw"))
    lines = lines.select("doc_id", "line_no", as_compared("raw").alias("line"))
    return lines.withColumn("k1", F.xxhash64("line")).withColumn("k2", F.xxhash64(F.lit(1), "line"))


def hashed_windows(lines: DataFrame, *columns: str) -> DataFrame:
    """The columns and, for every BLOCK windows of the column line, their hashes h0, h1, ...; the last ones may repeat."""
    wide = 4 * WIDTH  # characters of four bytes each, so that a window is found by its place
    coded = lines.filter(F.length("line") >= WIDTH).select(*columns, F.encode("line", "UTF-32").alias("code")).withColumn("last", F.octet_length("code") - (wide - 1))
    blocks = coded.select(*columns, "code", "last", F.explode(F.sequence(F.lit(1), F.col("last"), F.lit(4 * BLOCK))).alias("at"))
    place = lambda j: F.least(F.col("at") + 4 * j, F.col("last"))
    return blocks.select(*columns, *[F.xxhash64(F.substring(F.col("code"), place(j), F.lit(wide))).alias(f"h{j}") for j in range(BLOCK)])


def signatures(docs: DataFrame) -> DataFrame:
    """k1, k2 and the minima of every line that has at least a window."""
    hashed = hashed_windows(lines_of(docs), "k1", "k2")
    least = lambda c: F.least(*[F.col(f"h{j}").bitwiseXOR(F.lit(c)) for j in range(BLOCK)])
    return hashed.groupBy("k1", "k2").agg(*[F.min(least(c)).alias(f"m{i}") for i, c in enumerate(NUMBERS)])


def band_keys(classes: DataFrame, work: Workspace) -> DataFrame:
    """(key, node) of the classes that aren't alone under a key; a few bands at a time, so that shuffles stay small.

    Two classes that are alone together under several keys are one list.
    """
    signed, numbered, parts, pairs = classes.filter("m0 is not null"), list(enumerate(BANDS)), [], []
    for i in range(0, len(BANDS), BANDS_AT_ONCE):
        bands = F.array(*[F.xxhash64(F.lit(b), *[F.col(f"m{k}") for k in band]) for b, band in numbered[i : i + BANDS_AT_ONCE]])
        keys = signed.select("node", F.explode(bands).alias("key"))
        lists = keys.groupBy("key").agg(F.count("*").alias("members"), F.min("node").alias("a"), F.max("node").alias("b")).filter("members > 1")
        lists = work.keep(lists, f"band-lists-{i}")
        work.release()
        pairs.append(lists.filter("members = 2").select("a", "b"))
        more = keys.join(small(lists.filter("members > 2").select("key")), "key", "left_semi")
        parts.append(work.keep(more, f"band-keys-{i}"))
        work.release()
    two = reduce(DataFrame.unionByName, pairs).distinct().select(F.xxhash64(F.lit(len(BANDS)), "a", "b").alias("key"), F.explode(F.array("a", "b")).alias("node"))
    parts.append(work.keep(two, "band-pairs"))
    for i in range(0, len(BANDS), BANDS_AT_ONCE):
        work.drop(f"band-lists-{i}")
    work.release()
    return reduce(DataFrame.unionByName, parts)


def small(df: DataFrame) -> DataFrame:
    """df (a written table), to be broadcast if it has few rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_LINES else df


def bodies(docs: DataFrame, chosen: DataFrame, work: Workspace) -> DataFrame:
    """node, n, copies, body (its line) of the chosen classes."""
    total = chosen.count()
    own = chosen.select("k1", "k2", F.col("place.doc_id").alias("at_doc"), F.col("place.line_no").alias("at_line"), "node", "copies")
    own = F.broadcast(own) if total <= BROADCAST_LINES else own
    at = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.posexplode(F.split(text_of(), "\n")).alias("line_no", "raw"))
    at = at.join(own, (at["line_no"] == own["at_line"]) & at["doc_id"].eqNullSafe(own["at_doc"])).withColumn("line", as_compared("raw"))
    # Rows may share an id: the line must be the one whose hashes are k1 and k2.
    lines = at.filter((F.xxhash64("line") == F.col("k1")) & (F.xxhash64(F.lit(1), "line") == F.col("k2")))
    found = lines.select("node", "copies", F.size(F.array_distinct(windows(F.col("line")))).cast("long").alias("n"), F.col("line").alias("body"))
    found = work.keep(found, "found-sets")
    # Rows that are repeated, or share an id, may give a line more than once.
    return found if found.count() == total else work.keep(found.dropDuplicates(["node"]), "sets")


def prefix_pairs(few: DataFrame, sets: DataFrame, work: Workspace) -> DataFrame:
    """(a, b) of all nodes of different roots that may link: they share a window of their prefixes.

    Windows are ordered by the number of these sets that hold them; those of one set match nothing. Two sets that link
    have their first common window in both prefixes, and no more in common than what follows it.
    """
    measure, scale = Measure(PERCENT), 100 + PERCENT
    few = work.keep(few, "few")
    work.release()
    own = sets.join(few.select("node"), "node", "left_semi").select("node", F.explode(F.array_distinct(windows(F.col("body")))).alias("token"))
    common = work.keep(own.groupBy("token").agg(F.count("*").alias("sets")).filter("sets > 1"), "common")
    work.release()
    least = F.floor((F.col("n") * PERCENT + 99) / 100)
    parts = []
    for i in range(SHARES):
        share = F.pmod("node", F.lit(SHARES)) == i
        ordered = own.filter(share).join(common, "token").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("sets", "token"))).alias("tokens"))
        ordered = ordered.join(few.filter(share), "node").withColumn("useful", F.size("tokens").cast("long"))
        ordered = ordered.filter(F.col("useful") * scale >= (F.col("n") + F.greatest("least_n", F.col("n") * PERCENT / 100)) * PERCENT)
        prefix = F.slice("tokens", F.lit(1), F.greatest(F.lit(0), F.col("useful") - least + 1).cast("int"))
        placed = ordered.select("node", "n", "root", "useful", F.posexplode(F.transform(prefix, lambda x: x["token"])).alias("at", "token"))
        parts.append(work.keep(placed.select("node", "n", "root", "token", (F.col("useful") - F.col("at")).alias("room")), f"prefixes-{i}"))
        work.release()
    work.drop("common")
    placed = reduce(DataFrame.unionByName, parts)
    x, y = placed.alias("x"), placed.alias("y")
    need = measure.pair_overlap(F.col("x.n"), F.col("y.n"))
    fits = F.least("x.room", "y.room", "x.n", "y.n") * scale >= need
    pairs = x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.node") < F.col("y.node")) & (F.col("x.root") != F.col("y.root")) & fits)
    return pairs.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()


def window_maps(sets: DataFrame) -> DataFrame:
    """node and the words b0, b1, ... of its map: the bits that its windows' hashes name."""
    hashed = hashed_windows(sets.select("node", F.col("body").alias("line")), "node")
    single = hashed.select("node", F.explode(F.array(*[f"h{j}" for j in range(BLOCK)])).alias("h"))
    word, bit = F.pmod(F.shiftright("h", 6), F.lit(MAP_BITS // 64)).cast("int"), F.expr("shiftleft(1L, cast(h & 63 as int))")
    words = single.select("node", word.alias("word"), bit.alias("bit")).groupBy("node", "word").agg(F.bit_or("bit").alias("bits"))
    return words.groupBy("node").agg(*[F.coalesce(F.max(F.when(F.col("word") == w, F.col("bits"))), F.lit(0).cast("long")).alias(f"b{w}") for w in range(MAP_BITS // 64)])


def may_link(x: str, y: str) -> Column:
    """Whether sizes and maps let two rows link: maps differ in no more bits than the sets in windows."""
    differ = reduce(Column.__add__, [F.bit_count(F.col(f"{x}.b{w}").bitwiseXOR(F.col(f"{y}.b{w}"))) for w in range(MAP_BITS // 64)])
    n, m = F.col(f"{x}.n"), F.col(f"{y}.n")
    return (F.least(n, m) * 100 >= F.greatest(n, m) * PERCENT) & (differ * (100 + PERCENT) <= (n + m) * (100 - PERCENT))


def list_pairs(row: DataFrame, sets: DataFrame, work: Workspace) -> DataFrame:
    """(a, b) of all members (key, node, n, root, outside, least_n) of a list that may link and have different roots.

    A short list's are paired where their maps allow a link, which loses none; those of longer lists go by prefixes.
    """
    sizes = row.groupBy("key").agg((F.count_if("outside") * F.count("*") > PAIRED).alias("long"))
    row = row.join(sizes, "key")
    few = row.filter("long").groupBy("node").agg(F.first("n").alias("n"), F.first("root").alias("root"), F.min("least_n").alias("least_n"))
    short = work.keep(row.filter("not long").select("key", "node", "n", "root", "outside"), "short-lists")
    few = work.keep(few, "long-lists")
    maps = work.keep(window_maps(sets.join(short.select("node").distinct(), "node", "left_semi")), "maps")
    mapped = work.keep(short.join(maps, "node"), "mapped")
    work.drop("short-lists")
    work.drop("maps")
    work.release()
    x, y = mapped.filter("outside").alias("x"), mapped.alias("y")
    once = ~F.col("y.outside") | (F.col("x.node") < F.col("y.node"))
    pairs = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.root") != F.col("y.root")) & once & may_link("x", "y"))
    pairs = pairs.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()
    if few.isEmpty():
        return pairs
    pairs = work.keep(pairs, "short-pairs")
    work.drop("mapped")
    work.release()
    return pairs.unionByName(prefix_pairs(few, sets, work)).distinct()


def dedup(docs: DataFrame, work: Workspace) -> DataFrame:
    """doc_id, line_no, keep_doc_id, keep_line_no, group_size, kept of every line."""
    blank = F.col("line") == ""
    rows = lines_of(docs).select("doc_id", "line_no", F.when(~blank, F.struct("k1", "k2")).alias("k"))
    rows = work.keep(rows, "rows")
    place = F.struct(F.col("doc_id").alias("doc_id"), F.col("line_no").alias("line_no"))
    distinct = rows.filter("k is not null").groupBy(F.col("k.k1").alias("k1"), F.col("k.k2").alias("k2")).agg(F.min(place).alias("place"), F.count("*").alias("copies"))
    classes = distinct.join(signatures(docs), ["k1", "k2"], "left").withColumn("node", F.monotonically_increasing_id())
    classes = work.keep(classes, "classes")
    work.release()
    nodes = classes.select("k1", "k2", "node", "place", "copies")
    keys = band_keys(classes, work)
    alike = work.keep(keys.select("node").distinct(), "alike")
    chosen = work.keep(nodes.join(small(alike), "node", "left_semi"), "chosen")
    work.drop("alike")
    work.release()
    sets = bodies(docs, chosen, work)
    keys = work.keep(keys.join(sets.select("node", "n", "copies", F.col("n").alias("useful")), "node"), "keys")
    for done in (*(f"band-keys-{i}" for i in range(0, len(BANDS), BANDS_AT_ONCE)), "band-pairs", "chosen"):
        work.drop(done)
    work.release()

    def indexed(row: DataFrame) -> DataFrame:
        return list_pairs(row, sets, work)

    roots = work.keep(linked_classes(keys, sets, Measure(PERCENT), work, windows, indexed), "linked")
    groups = roots.join(nodes, "node").groupBy("root").agg(F.min("place").alias("keep"), F.sum("copies").alias("group_size"))
    named = work.keep(roots.join(groups, "root").select("node", "keep", "group_size"), "named")
    names = nodes.join(small(named), "node", "left").select(F.struct("k1", "k2").alias("k"), "copies", F.coalesce("keep", "place").alias("keep"), F.coalesce("group_size", "copies").alias("group_size"))
    names = work.keep(names, "names")
    for done in ("classes", "found-sets", "sets", "keys"):
        work.drop(done)
    work.release()
    out = join_heavy_apart(rows.filter("k is not null"), names, "k", "copies", rows.count())
    same = F.col("doc_id").eqNullSafe(F.col("keep.doc_id")) & (F.col("line_no") == F.col("keep.line_no"))
    out = out.select("doc_id", "line_no", F.col("keep.doc_id").alias("keep_doc_id"), F.col("keep.line_no").alias("keep_line_no"), "group_size", same.alias("kept"))
    alone = rows.filter("k is null").select("doc_id", "line_no", F.col("doc_id").alias("keep_doc_id"), F.col("line_no").alias("keep_line_no"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"))
    return out.unionByName(alone)


def kept_texts(docs: DataFrame, work: Workspace) -> DataFrame:
    """doc_id and the text of the lines that stay, for every document that has an id and keeps a line."""
    stay = dedup(docs, work).filter("kept and doc_id is not null").select("doc_id", "line_no")
    raw = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.posexplode(F.split(text_of(), "\n")).alias("line_no", "raw"))
    whole = raw.dropDuplicates(["doc_id", "line_no"]).join(stay.distinct(), ["doc_id", "line_no"]).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("line_no", "raw"))).alias("lines"))
    return whole.select("doc_id", F.array_join(F.transform("lines", lambda x: x["raw"]), "\n").alias("text"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: every line's component and whether it stays."""
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), Workspace(spark, "op1"))
