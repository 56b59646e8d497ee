import importlib.util
import re

import corpus_pipeline
from veilframe.llm import mixing, packing, toxicity
from tests.llm.test_jaccard_join import brute
from tests.llm.test_mixing import reference_selection
from tests.llm.test_packing import check
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, seen[-1], SF).write.parquet(f"{tmp_path}/{name}")
        seen.append(spark.read.parquet(f"{tmp_path}/{name}"))
    rows = [sorted(map(tuple, d.collect())) for d in seen[:4]]
    assert all(d.columns == docs.columns for d in seen[:5])
    scores = {r.doc_id: r.score for r in toxicity.score(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    assert rows[1] == [r for r in rows[0] if scores[r[0]] < 0.5]
    first = {}
    for r in rows[1]:
        first.setdefault(re.sub(r"[\x20\x09-\x0d]+", " ", r[1] or ""), r)
    assert rows[2] == sorted(first.values())
    component = brute([(r[0], r[1]) for r in rows[2]], 5, 80)
    assert rows[3] == [r for r in rows[2] if component[r[0]][1] == r[0]]
    members = mixing.members_of(seen[3]).select("*", *[mixing.turn_of(F.col("doc_id"), F.lit(e), mixing.PRODUCTION.seed).alias(f"t{e}") for e in range(3)]).collect()
    chosen = reference_selection([((r.domain, r.language, r.source), r.doc_id, r.tokens, [r.t0, r.t1, r.t2]) for r in members], mixing.PRODUCTION)
    mixed = [(r.doc_id, r.text) for r in seen[4].collect()]
    assert sorted(i for i, _ in mixed) == sorted(i for i, _ in chosen)
    check(mixed, seen[5].collect(), packing.LENGTH)


def test_run_and_empty(spark, tmp_path):
    assert corpus_pipeline.run(spark, SF).count() > 0
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0).withColumn("row", F.lit(1)).withColumn("digest", F.lit("x"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() == 0
        if name != "best_fit_packing":
            assert out.columns == docs.columns


def test_entry_lists_all():
    spec = importlib.util.spec_from_file_location("entry", "__spark_entry__.py")
    entry = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(entry)
    names = entry.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names
