"""Exact deduplication against a persistent digest index.

The index is a table bucketed and sorted by digest: (digest binary, keep_id long). A batch's digests are
pre-aggregated, anti-joined with the index by sort-merge (the index side needs no shuffle) and appended.

Defined cases
- null text counts as empty; all empty and all white-space texts of equal normal form are one group.
- null ids: never kept where the group has another id; a group of null ids only has a null keep_id, and one row stays.
- the same id more than once with equal text: one of the rows stays; group_size counts them all.
- empty table: no rows. Columns of the input other than id and text are carried through by ``dedup`` whatever
  their names are, as the digests travel in a struct of a name that the input hasn't.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veilframe.llm.shared import Workspace, join_heavy_apart, partitions, text_of

SPACE = r"[\x20\x09-\x0D]+"


def digest_of(text: Column) -> Column:
    """SHA-256 of the text with each run of white space replaced by one space."""
    return F.unhex(F.sha2(F.regexp_replace(text, SPACE, " ").cast("binary"), 256))


class DigestIndex:
    """A persistent table of the digests seen so far, bucketed and sorted by digest."""

    def __init__(self, spark: SparkSession, location: str, name: str, buckets: int | None = None):
        """location: a shared folder; name: the table's name in the session's catalogue; buckets: fixed when the index is made.

        The number of buckets is kept in a table beside the index, as files don't tell it; another one is refused.
        """
        self.spark, self.name, self.location = spark, name, location
        beside = f"{location.rstrip('/')}-buckets"
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{beside}/_SUCCESS")
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            n = spark.read.schema("buckets int").parquet(beside).first()["buckets"]
            if buckets not in (None, n):
                raise ValueError(f"the index at {location} has {n} buckets, not {buckets}")
        else:
            n = buckets or partitions(spark)
            spark.range(1).select(F.lit(n).alias("buckets")).write.mode("overwrite").parquet(beside)
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS `{name}` (digest BINARY, keep_id BIGINT) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {n} BUCKETS LOCATION '{location}'"
        )
        self.buckets = n

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def append(self, groups: DataFrame) -> None:
        """Add the groups (digest, keep_id) whose digest isn't there yet."""
        new = groups.hint("merge").join(self.table().select("digest"), "digest", "left_anti")
        out = new.select("digest", "keep_id").repartition(self.buckets, "digest")
        out.write.mode("append").format("parquet").bucketBy(self.buckets, "digest").sortBy("digest").option("path", self.location).saveAsTable(self.name)
        self.spark.catalog.refreshTable(self.name)


def assign(docs: DataFrame, index: DigestIndex, work: Workspace, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, digest, keep_id, group_size (in this batch), kept. Digests that are new get into the index."""
    rows = work.keep(docs.select(F.col(doc_id).cast("long").alias("doc_id"), digest_of(text_of(text)).alias("digest")), "digests")
    # A hot digest is one row for each task already before the shuffle.
    same = rows.groupBy("digest", "doc_id").agg(F.count("*").alias("n"))
    groups = same.groupBy("digest").agg(
        F.min("doc_id").alias("batch_id"), F.sum("n").alias("group_size"), F.min_by("n", F.coalesce("doc_id", F.lit(2**63 - 1))).alias("repeats")
    )
    groups = work.keep(groups, "groups")
    index.append(groups.select("digest", F.col("batch_id").alias("keep_id")))
    known = groups.hint("merge").join(index.table(), "digest")
    total = rows.count()
    out = join_heavy_apart(rows, known, "digest", "group_size", total)
    # Only ids that occur more than once in a group need an order among equals.
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & F.col("batch_id").eqNullSafe(F.col("keep_id"))
    one = out.filter(~(kept & (F.col("repeats") > 1))).withColumn("kept", kept)
    many = out.filter(kept & (F.col("repeats") > 1))
    nth = F.row_number().over(Window.partitionBy("digest").orderBy(F.monotonically_increasing_id()))
    many = many.withColumn("kept", nth == 1)
    return one.unionByName(many).select("doc_id", "digest", "keep_id", "group_size", "kept")


def open_index(spark: SparkSession, work: Workspace) -> DigestIndex:
    """A new index in the workspace."""
    return DigestIndex(spark, work.path("index"), f"digest_index_{work.root.rsplit('-', 1)[1]}")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: one row per document, dropped ones too."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    work = Workspace(spark, "op7")
    found = assign(docs, open_index(spark, work), work)
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def dedup(docs: DataFrame, spark: SparkSession) -> DataFrame:
    """The rows of docs that stay, with docs' own columns, whatever they are called."""
    work = Workspace(spark, "exact")
    found = assign(docs, open_index(spark, work), work)
    keep = work.keep(found.filter("kept").select(F.col("doc_id").alias("k"), F.col("digest").alias("d")), "kept")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(row.alias("row"), F.col("doc_id").cast("long").alias("doc_id"), digest_of(text_of()).alias("digest"))
    same = F.col("doc_id").eqNullSafe(F.col("k")) & (F.col("digest") == F.col("d"))
    stay = rows.join(keep, same, "left_semi")
    digests = spark.read.parquet(work.path("digests"))
    repeated = digests.groupBy("doc_id", "digest").agg(F.count("*").alias("n")).filter("n > 1")
    repeated = work.keep(repeated.select(F.col("doc_id").alias("k"), F.col("digest").alias("d")), "repeated")
    if repeated.isEmpty():
        return stay.select("row.*")
    nth = F.row_number().over(Window.partitionBy("doc_id", "digest").orderBy(F.monotonically_increasing_id()))
    first = stay.join(repeated, same, "left_semi").withColumn("nth", nth).filter("nth = 1")
    return stay.join(repeated, same, "left_anti").select("row.*").unionByName(first.select("row.*"))
