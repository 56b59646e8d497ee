import random
import re

import numpy as np
import pytest

from veilframe.llm import jaccard_join
from veilframe.llm.components import components
from veilframe.llm.shared import Workspace
from veilframe.llm.shingles import WordHasher, shingle_set


def shingles(text, size):
    words = re.findall(r"[^\x20\x09-\x0d]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def brute(rows, size, percent):
    """doc_id to (number of shingles, component) by all pairs."""
    sets = [shingles(t, size) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    best = {}
    for i, (doc_id, _) in enumerate(rows):
        best[find(i)] = min(best.get(find(i), doc_id), doc_id)
    return {doc_id: (len(sets[i]), best[find(i)]) for i, (doc_id, _) in enumerate(rows)}


def made_up(seed, n):
    """Copies, near copies of a text at many distances, chains, short texts, shared passages."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 4)))
    passage = [word() for _ in range(40)]
    bases = [[word() for _ in range(rng.choice([5, 12, 14, 40, 150, 300]))] for _ in range(6)]
    texts = []
    for _ in range(n):
        kind = rng.random()
        if kind < 0.65:
            words = list(rng.choice(bases))
            for _ in range(rng.randint(0, max(1, len(words) // rng.choice([8, 15, 30, 60])))):
                words[rng.randrange(len(words))] = rng.choice([word(), "the", "of"])
            words = words[: len(words) - rng.choice([0, 0, 0, 1, 2])]
        elif kind < 0.8:
            words = passage + [word() for _ in range(rng.randint(0, 6))]
        elif kind < 0.9:
            words = [word() for _ in range(rng.randint(0, 3))]
        else:
            words = [word() for _ in range(rng.randint(5, 60))]
        texts.append((" \n".join(words)).upper() if rng.random() < 0.1 else " ".join(words))
    ids = list(range(10, 10 + n))
    rng.shuffle(ids)
    return list(zip(ids, texts, strict=True)) + [(5, None), (6, "  "), (7, "")]


@pytest.mark.parametrize(("seed", "size", "percent"), [(1, 3, 90), (2, 5, 80), (3, 1, 60)])
def test_against_all_pairs(spark, seed, size, percent, monkeypatch):
    monkeypatch.setattr(jaccard_join, "RARE", 4 if seed != 3 else 16)
    monkeypatch.setattr(jaccard_join, "PAIR_PREFIX", 8 if seed == 2 else 24)
    rows = made_up(seed, 400)
    docs = spark.createDataFrame([(*r, 0, b"") for r in rows], "doc_id long, text string, n int, digest binary")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.join(docs, size, percent, Workspace(spark, "t")).collect()}
    want = brute(rows, size, percent)
    assert {k: v for k, v in got.items() if v != want[k]} == {}
    assert len({v[1] for v in want.values()}) < len(rows) - 100


def test_on_a_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()], 3, 90)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.query(spark, "/root/testdata/sf0.001").collect()}
    assert got == want


def test_odd_rows(spark):
    docs = spark.createDataFrame([(None, "a b c d", "x"), (4, "A b c d", "y"), (4, "a b c d", "z"), (9, "q", "w"), (None, None, "n"), (3, "", "e")], "doc_id long, text string, component_id string")
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in jaccard_join.join(docs, 3, 90, Workspace(spark, "t")).collect())
    assert got == [("3", 0, "3"), ("4", 2, "4"), ("4", 2, "4"), ("9", 1, "9"), ("None", 0, "None"), ("None", 2, "4")]
    assert sorted(r.component_id for r in jaccard_join.keep_one(docs).collect()) == ["e", "n", "w", "x", "y", "z"]
    near = spark.createDataFrame([(2, "a b c d e f"), (1, "a b c d e f"), (3, "zz")], "doc_id long, text string")
    assert sorted(r.doc_id for r in jaccard_join.keep_one(near).collect()) == [1, 3]
    assert jaccard_join.keep_one(docs.limit(0)).count() == 0


def test_shingles_do_not_depend_on_blocks(monkeypatch):
    rng = random.Random(0)
    texts = ["", " ", "one", "É é  x\ty", " ".join(str(rng.randrange(50)) for _ in range(500)), "A\x00B c\x0bd\x1ce"]
    plain = [shingle_set(WordHasher().words(t.encode())[0], 3) for t in texts]
    assert [len(p) for p in plain] == [len(shingles(t, 3)) for t in texts]
    for block in (1, 16, 700):
        monkeypatch.setattr("veilframe.llm.shingles.BLOCK", block)
        assert all(np.array_equal(a, shingle_set(b, 3)) for a, b in zip(plain, WordHasher().documents(texts), strict=True))


def test_components(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 40)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)] + [(7, 7), (3, 2)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long"), Workspace(spark, "t")).collect()}
    root = {x: x for e in edges for x in e if e[0] != e[1]}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            if a != b and root[a] != root[b]:
                root[a] = root[b] = min(root[a], root[b])
                changed = True
    assert got == root
