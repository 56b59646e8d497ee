import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veilframe.llm import mixing
from veilframe.llm.shared import Workspace


def fill(budget, children):
    """Share a budget among (weight, capacity) by steps: whoever is full leaves, the rest is shared again."""
    got, open_ = [0.0] * len(children), [i for i, (w, c) in enumerate(children) if w > 0]
    left = budget
    while open_ and left > 1e-12:
        total = sum(children[i][0] for i in open_)
        full = [i for i in open_ if left * children[i][0] / total >= children[i][1] - got[i]]
        if not full:
            for i in open_:
                got[i] += left * children[i][0] / total
            break
        for i in full:
            left -= children[i][1] - got[i]
            got[i] = children[i][1]
        open_ = [i for i in open_ if i not in full]
    return got


def reference_budgets(leaves, targets):
    """By recursion over the tree."""
    out = {}

    def go(path, budget):
        depth = len(path)
        if depth == 3:
            out[path] = budget
            return
        names = sorted({p[: depth + 1] for p in leaves if p[:depth] == path})
        children = [(targets.weights.get(n, 1.0), targets.max_epochs * sum(v for p, v in leaves.items() if p[: depth + 1] == n)) for n in names]
        for n, b in zip(names, fill(budget, children), strict=True):
            go(n, b)

    go((), targets.budget_share * sum(leaves.values()))
    return out


def compare_budgets(spark, leaves, targets):
    df = spark.createDataFrame([(*p, v) for p, v in leaves.items()], "domain string, language string, source string, supply long")
    got = {(r.domain, r.language, r.source): r.budget for r in mixing.budgets(df, targets).collect()}
    want = reference_budgets(leaves, targets)
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == pytest.approx(want[k], rel=1e-9, abs=1e-6), k


def test_shortage_goes_to_siblings_first(spark):
    leaves = {("a", "en", "s1"): 10, ("a", "en", "s2"): 1000, ("a", "de", "s3"): 1000, ("b", "en", "s4"): 1000}
    targets = mixing.Targets({}, budget_share=0.2, max_epochs=1)
    compare_budgets(spark, leaves, targets)
    got = reference_budgets(leaves, targets)
    assert got[("a", "en", "s1")] == 10 and got[("a", "en", "s2")] + 10 == pytest.approx(got[("a", "de", "s3")])


@settings(max_examples=8, deadline=None)
@given(st.dictionaries(st.tuples(st.sampled_from("ab"), st.sampled_from("xyz"), st.sampled_from("pqrs")), st.integers(1, 500), min_size=1), st.floats(0.1, 3), st.dictionaries(st.sampled_from([("a",), ("b",), ("a", "x"), ("a", "x", "p"), ("b", "y")]), st.sampled_from([0.0, 0.5, 3.0])))
def test_budgets(spark, leaves, share, weights):
    compare_budgets(spark, leaves, mixing.Targets(weights, share, 2))


def reference_selection(rows, targets):
    """rows (leaf, doc_id, tokens, {epoch: turn}) to a sorted list of (doc_id, epoch)."""
    leaves = {}
    for leaf, _, tokens, _ in rows:
        leaves[leaf] = leaves.get(leaf, 0) + tokens
    out = []
    for leaf, budget in reference_budgets(leaves, targets).items():
        own = [r for r in rows if r[0] == leaf]
        whole = int(budget // leaves[leaf] + 1e-9)
        rest = int(budget - whole * leaves[leaf] + 1e-6)
        for e in range(whole):
            out += [(r[1], e) for r in own]
        ahead = 0
        for r in sorted(own, key=lambda r: (r[3][whole], r[1])):
            if ahead < rest:
                out.append((r[1], whole))
            ahead += r[2]
    return sorted(out)


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    members = mixing.members_of(docs).select("*", *[mixing.turn_of(F.col("doc_id"), F.lit(e), mixing.PRODUCTION.seed).alias(f"t{e}") for e in range(3)]).collect()
    rows = [((r.domain, r.language, r.source), r.doc_id, r.tokens, [r.t0, r.t1, r.t2]) for r in members]
    got = sorted((r.doc_id, r.epoch) for r in mixing.query(spark, sf).collect())
    assert got == reference_selection(rows, mixing.PRODUCTION)
    assert {e for _, e in got} == {0, 1}


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, None, None, "a"), (None, "b c", "en", "src1", "b"), (1, "x", "en", "src1", "c"), (1, "x", "en", "src1", "c")], "doc_id long, text string, lang string, source string, whole string")
    got = mixing.mix(docs, mixing.Targets({}, 10.0, 2))
    assert got.columns == docs.columns and got.count() == 8
    assert mixing.mix(docs.limit(0)).count() == 0
    work = Workspace(spark, "t")
    assert mixing.plan(work.keep(mixing.members_of(docs), "m"), mixing.Targets({}, 0.0, 2), work).leaves.filter("whole > 0 or rest > 0").count() == 0
