import random

from pyspark.sql import functions as F

from veilframe.llm import line_dedup
from veilframe.llm.shared import Workspace


def windows(line):
    return {line[i : i + line_dedup.WIDTH] for i in range(len(line) - line_dedup.WIDTH + 1)}


def brute(places):
    """(doc_id, line_no) to the kept place, by all pairs of lines."""
    first, parent = {}, {}
    for p, line in sorted(places.items()):
        first.setdefault(line, p)
        parent.setdefault(line, line)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = {line: windows(line) for line in parent}
    lines = sorted(parent, key=first.get)
    for i, a in enumerate(lines):
        for b in lines[:i]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= line_dedup.PERCENT * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y, key=first.get)] = min(x, y, key=first.get)
    return {p: first[find(line)] for p, line in places.items()}


def made_up(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghijk") for _ in range(rng.randint(2, 8)))
    bases = [[word() for _ in range(rng.choice([2, 8, 30, 60]))] for _ in range(8)]
    docs = []
    for i in range(60):
        lines = []
        for _ in range(rng.randint(0, 8)):
            words = list(rng.choice(bases)) if rng.random() < 0.7 else [word() for _ in range(rng.randint(1, 30))]
            for _ in range(rng.choice([0, 0, 0, 1, 2, 4])):
                words[rng.randrange(len(words))] = word()
            lines.append(" ".join(words) if rng.random() < 0.9 else "  ")
        docs.append((i, "\n".join(lines)))
    return docs


def test_against_all_pairs(spark):
    docs = made_up(4)
    places = {(i, k): line.strip().lower() for i, t in docs for k, line in enumerate(t.split("\n"))}
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, line string")
    got = {(r.doc_id, r.line_no): (r.keep_doc_id, r.keep_line_no, r.kept) for r in line_dedup.dedup(df, Workspace(spark, "t")).collect()}
    assert got.keys() == places.keys()
    want = brute({p: x for p, x in places.items() if x})
    right = 0
    for p, x in places.items():
        right += got[p] == (*(want[p] if x else p), (want[p] if x else p) == p)
        assert not x or want[got[p][:2]] == want[p], p  # never joins what isn't linked
    assert right >= 0.98 * len(places), (right, len(places))
    assert sum(not g[2] for g in got.values()) > 50


def test_odd_rows_and_texts(spark):
    rows = [(None, "Same line of text\n"), (3, "same line of text \nab\n\nab"), (4, None), (5, "ab"), (5, "ab")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r.doc_id), r.line_no, str(r.keep_doc_id), r.keep_line_no, r.group_size, r.kept) for r in line_dedup.dedup(df, Workspace(spark, "t")).collect())
    assert got == sorted([("None", 0, "None", 0, 2, True), ("None", 1, "None", 1, 1, True), ("3", 0, "None", 0, 2, False), ("3", 1, "3", 1, 4, True), ("3", 2, "3", 2, 1, True), ("3", 3, "3", 1, 4, False), ("4", 0, "4", 0, 1, True), ("5", 0, "3", 1, 4, False), ("5", 0, "3", 1, 4, False)])
    texts = {r.doc_id: r.text for r in line_dedup.kept_texts(df, Workspace(spark, "t")).collect()}
    assert texts == {3: "ab\n", 4: ""}
    assert line_dedup.dedup(df.limit(0), Workspace(spark, "t")).count() == 0


def test_every_window_is_signed(spark):
    rng = random.Random(6)
    pairs = [("=" * 12, "=" * 20), ("-" * 9, "-" * 40), ("_" * 12, "_" * 13), ("#" * 10, "#" * 30), ("message 123456", "message 1234567")]
    for n in (12, 13, 14):
        for _ in range(100):
            line = "".join(rng.choice("acegikmoqsuwy13579bdfh") for _ in range(n))
            pairs.append((line, line + "c"))
    df = spark.createDataFrame([(i, "\n".join(p)) for i, p in enumerate(pairs)], "doc_id long, text string")
    got = {r.doc_id: (r.keep_line_no, r.group_size, r.kept) for r in line_dedup.dedup(df, Workspace(spark, "t")).collect() if r.line_no == 1}
    assert {i: got[i] for i in range(5)} == {i: (0, 2, False) for i in range(5)}
    assert sum(g == (0, 2, False) for g in got.values()) >= 0.99 * len(pairs)


def test_chain_past_the_pivot(spark, monkeypatch):
    """The pivot p (most copies) links with y, y with x, and p with x does not: x is still compared with y."""
    monkeypatch.setattr(line_dedup, "band_keys", lambda classes, work: classes.select(F.lit(1).cast("long").alias("key"), "node"))
    rng = random.Random(8)
    y = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(108))
    p, x = y[:30] + "0" + y[31:], y[:70] + "0" + y[71:]
    assert [len(windows(a) & windows(b)) for a, b in ((x, y), (p, y), (p, x))] == [91, 91, 82]
    df = spark.createDataFrame([(0, x), (1, y), (2, p), (3, p), (4, p)], "doc_id long, text string")
    got = {r.doc_id: (r.keep_doc_id, r.group_size, r.kept) for r in line_dedup.dedup(df, Workspace(spark, "t")).collect()}
    assert got == {i: (0, 5, i == 0) for i in range(5)}


def test_prefix_pairs_lose_no_link(spark):
    rng = random.Random(9)
    common = "".join(rng.choice("abcdefgh ") for _ in range(60))  # a passage that all lines hold
    lines = []
    for _ in range(12):
        own = "".join(rng.choice("abcdefgh ") for _ in range(rng.choice([10, 40, 200])))
        for _ in range(4):
            at = rng.randrange(len(own))
            lines.append(common + own[:at] + rng.choice("xyz") + own[at + rng.choice([0, 1, 1, 3]) :])
    lines = sorted(set(lines))
    sets = [windows(x) for x in lines]
    work = Workspace(spark, "prefix-test")
    bodies = spark.createDataFrame([(i, len(sets[i]), x) for i, x in enumerate(lines)], "node long, n long, body string")
    few = spark.createDataFrame([(i, len(s), i, min(map(len, sets))) for i, s in enumerate(sets)], "node long, n long, root long, least_n long")
    found = {(r.a, r.b) for r in line_dedup.prefix_pairs(few, bodies, work).collect()}
    pairs = [(i, j) for j in range(len(lines)) for i in range(j)]
    links = {(i, j) for i, j in pairs if 100 * len(sets[i] & sets[j]) >= line_dedup.PERCENT * len(sets[i] | sets[j])}
    assert links and links <= found
    assert len(found) < len(pairs) / 2  # the common passage alone proposes nothing
    work.drop()


def test_prefixes_are_built_in_shares(spark, monkeypatch):
    """No shuffle holds the windows of more than a share of the sets, and each share's shuffles are let go of."""
    work, steps = Workspace(spark, "shares-test"), []
    keep, release = work.keep, work.release
    monkeypatch.setattr(work, "keep", lambda df, label, **o: steps.append(label) or keep(df, label, **o))
    monkeypatch.setattr(work, "release", lambda: steps.append("release") or release())
    lines = [f"{i // 2:05d} the same words in each {'x' * (i % 2)} {i // 2:05d}" for i in range(40)]
    bodies = spark.createDataFrame([(i, len(windows(x)), x) for i, x in enumerate(lines)], "node long, n long, body string")
    few = spark.createDataFrame([(i, len(windows(x)), i, 1) for i, x in enumerate(lines)], "node long, n long, root long, least_n long")
    line_dedup.prefix_pairs(few, bodies, work).collect()
    shares = [f"prefixes-{i}" for i in range(line_dedup.SHARES)]
    assert steps[-2 * len(shares) :] == [x for label in shares for x in (label, "release")]
    own = [{r.node for r in spark.read.parquet(work.path(label)).select("node").collect()} for label in shares]
    assert all(own) and sum(map(len, own)) == len(set().union(*own)) and max(map(len, own)) <= len(lines) / line_dedup.SHARES
    work.drop()


def test_pairs_of_lists_need_no_prefixes(spark, monkeypatch):
    """Members of short lists are paired by their maps, with no link lost; only those of longer lists go by prefixes."""
    rng = random.Random(10)
    common = "".join(rng.choice("abcdefgh ") for _ in range(60))  # a passage that all lines hold
    lines = ["=" * 12, "=" * 40, "\u00e9" * 30, "\u00e9" * 90]
    for _ in range(10):
        own = "".join(rng.choice("abcdefgh \u00e9\u4e2d") for _ in range(rng.choice([40, 200, 3000])))
        for _ in range(4):
            at = rng.randrange(len(own))
            lines.append(common + own[:at] + rng.choice("xyz") + own[at + rng.choice([0, 1, 1, 3]) :])
    lines = sorted(set(lines))
    sets = [windows(x) for x in lines]
    work = Workspace(spark, "lists-test")
    bodies = spark.createDataFrame([(i, len(sets[i]), x) for i, x in enumerate(lines)], "node long, n long, body string")
    row = spark.createDataFrame([(k, i, len(s), i, k == 1, 1) for k in (1, 2) for i, s in enumerate(sets)], "key long, node long, n long, root long, outside boolean, least_n long")
    pairs = [(i, j) for j in range(len(lines)) for i in range(j)]
    links = {(i, j) for i, j in pairs if 100 * len(sets[i] & sets[j]) >= line_dedup.PERCENT * len(sets[i] | sets[j])}
    asked = []
    by_prefix = line_dedup.prefix_pairs
    monkeypatch.setattr(line_dedup, "prefix_pairs", lambda few, *rest: asked.append(few.count()) or by_prefix(few, *rest))
    for limit, want in ((line_dedup.PAIRED, []), (0, [len(lines)])):
        monkeypatch.setattr(line_dedup, "PAIRED", limit)
        found = {(r.a, r.b) for r in line_dedup.list_pairs(row, bodies, work).collect()}
        assert links and links <= found
        assert len(found) < len(pairs) / 2
        assert asked == want
    work.drop()
