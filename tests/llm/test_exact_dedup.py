import pytest
from pyspark.sql import functions as F

from veilframe.llm import exact_dedup
from veilframe.llm.shared import Workspace

ROWS = [(5, "a  b"), (3, "a\tb"), (9, "a b"), (7, None), (8, ""), (None, "a b"), (None, "z"), (None, "z"), (4, " "), (6, "dup"), (6, "dup"), (1, "a b")]


def docs(spark):
    return spark.createDataFrame([(*r, f"{i}", "k") for i, r in enumerate(ROWS)], "doc_id long, text string, digest string, keep_id string")


def test_groups_and_ties(spark):
    work = Workspace(spark, "t")
    got = exact_dedup.assign(docs(spark), exact_dedup.open_index(spark, work), work).collect()
    seen = sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept) for r in got)
    assert seen == sorted([("5", "3", 4, False), ("3", "3", 4, True), ("9", "3", 4, False), ("None", "3", 4, False), ("7", "7", 2, True), ("8", "7", 2, False), ("None", "None", 2, True), ("None", "None", 2, False), ("4", "4", 1, True), ("6", "6", 2, True), ("6", "6", 2, False), ("1", "1", 1, True)])


def test_dedup_keeps_columns_with_clashing_names(spark):
    got = exact_dedup.dedup(docs(spark), spark)
    assert got.columns == ["doc_id", "text", "digest", "keep_id"]
    assert sorted(str(r.doc_id) for r in got.collect()) == sorted(["3", "7", "None", "4", "6", "1"])


def test_index_persists_and_grows(spark):
    work = Workspace(spark, "t")
    index = exact_dedup.open_index(spark, work)
    first = spark.createDataFrame([(10, "x"), (11, "y")], "doc_id long, text string")
    exact_dedup.assign(first, index, work).count()
    again = exact_dedup.DigestIndex(spark, index.location, index.name)
    got = exact_dedup.assign(spark.createDataFrame([(1, "x"), (2, "z")], "doc_id long, text string"), again, Workspace(spark, "t")).collect()
    assert {(r.doc_id, r.keep_id, r.kept) for r in got} == {(1, 10, False), (2, 2, True)}
    assert again.table().count() == 3


def test_empty(spark):
    work = Workspace(spark, "t")
    assert exact_dedup.assign(docs(spark).limit(0), exact_dedup.open_index(spark, work), work).count() == 0


def test_reopened_with_other_partitions(spark, tmp_path):
    """An index of 4 buckets, opened by another name in a session of 7 partitions: nothing that is known is new."""
    docs = spark.createDataFrame([(i, f"text number {i}") for i in range(100)], "doc_id long, text string")
    place = f"file://{tmp_path}/index"
    exact_dedup.assign(docs, exact_dedup.DigestIndex(spark, place, "reopened_a", 4), Workspace(spark, "t")).count()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        index = exact_dedup.DigestIndex(spark, place, "reopened_b")
        again = docs.withColumn("doc_id", F.col("doc_id") + 1000)
        assert index.buckets == 4
        assert exact_dedup.assign(again, index, Workspace(spark, "t")).filter("kept or keep_id >= 1000").count() == 0
        assert index.table().count() == 100
        with pytest.raises(ValueError):
            exact_dedup.DigestIndex(spark, place, "reopened_c", 8)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
