"""Toxicity: gradient-boosted trees over dense text features, with isotonic calibration.

Features (``describe``): densities and counts of lexicon entries, how many of them stand near a second-person word,
shares of capitals, of shouted words, of punctuation and of obfuscated words, repeated letters, lengths. The lexicon is
a short list written by hand plus word beginnings that the labelled training texts show to be typical.

Training reads a bounded sample: of the labelled documents that aren't held out, the ``FIT_ROWS`` of each class with
the smallest hash of their id; a row's weight makes up for the classes' different shares. Every text is scored whole.

Defined cases: null text counts as empty; without labels of both classes every score is the share of label 1 (0 without
labels); null labels and labels of unknown documents aren't used; repeated rows and null ids give a row each. Only
doc_id and text are read of the documents, so other columns' names can't clash in ``score``; ``keep_clean`` returns
all columns of its input, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.llm.shared import give_back, held_out

#: Labelled rows of each class that the model is fitted on, at most.
FIT_ROWS = 3000
#: Learned lexicon entries, at most; how many documents must hold one; how much likelier label 1 must make it.
LEXICON_SIZE, LEXICON_LEAST, LEXICON_RATIO = 400, 3, 6.0
STEM_LENGTHS = (4, 5, 6)
SEEDS = ["idiot", "moron", "stupid", "dumb", "loser", "scum", "trash", "garbage", "pathetic", "worthless", "disgusting", "clown", "imbecile", "vermin", "filth", "hate you", "shut up", "kill yourself", "dummkopf", "abschaum", "arschloch", "connard", "imbécile", "ordure", "imbécil", "basura", "estúpid"]
SECOND = re.compile(r"\b(?:you|your|yours|yourself|u|du|dich|dir|dein\w*|ihr|euch|tu|te|toi|ton|ta|tes|vous|votre|vos|tú|ti|tus|usted\w*|vosotros|eres)\b")
NEAR = 40
WORD = re.compile(r"\w+")
SHOUT = re.compile(r"\b[A-ZÀ-ÖØ-Þ]{3,}\b")
OBFUSCATED = re.compile(r"[A-Za-z][0-9@$!*+#|][A-Za-z*]")
REPEATED = re.compile(r"([^\W\d_])\1\1")
LEET = str.maketrans("013457@$!|", "oieastasii")
TREES, DEPTH, BINS, RATE, L2 = 60, 3, 32, 0.2, 1.0


class Lexicon(NamedTuple):
    """Entries by kind: seeds are matched at a word's beginning, as learned stems and words are."""

    seeds: list[str]
    stems: list[str]
    words: list[str]

    def matcher(self) -> ahocorasick.Automaton:
        found = ahocorasick.Automaton()
        entries = {w: (len(w), 0) for w in self.seeds} | {}
        for kind, group in ((1, self.stems), (2, self.words)):
            for w in group:
                entries.setdefault(w, (len(w), kind))
        for w, x in entries.items():
            found.add_word(w, (*x, w))
        if len(found):
            found.make_automaton()
        return found


FEATURES = ["seed_density", "lexicon_density", "lexicon_count", "lexicon_distinct", "near_second", "second_density", "capitals", "shouts", "punctuation", "exclamations", "obfuscated", "deobfuscated", "repeated", "digits", "words", "word_length"]


def hits_in(text: str, matcher: ahocorasick.Automaton) -> list[tuple[int, int, str]]:
    """(end, kind, entry) of each entry at a word's beginning; whole words only for kind 2."""
    out = []
    for end, (n, kind, entry) in matcher.iter(text) if len(matcher) else ():
        before = text[end - n : end - n + 1] if end >= n else ""
        after = text[end + 1 : end + 2]
        if not before.isalnum() and (kind != 2 or not after.isalnum()):
            out.append((end, kind, entry))
    return out


def describe(text: str, matcher: ahocorasick.Automaton) -> list[float]:
    """A text's features, in the order of FEATURES."""
    lower = text.lower()
    raw = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), np.uint8), minlength=256)
    words = max(1, int(raw[32] + raw[9] + raw[10]) + 1)
    capitals, small = int(raw[65:91].sum()), int(raw[97:123].sum())
    letters = max(1, capitals + small)
    size = max(1, len(text))
    punctuation = int(raw[33:48].sum() + raw[58:65].sum() + raw[91:97].sum() + raw[123:127].sum())
    found = hits_in(lower, matcher)
    near = sum(1 for end, _, entry in found if SECOND.search(lower, max(0, end - len(entry) - NEAR), end + NEAR))
    obfuscated = OBFUSCATED.findall(text)
    plain = len(hits_in(lower.translate(LEET).replace("*", ""), matcher)) - len(found) if obfuscated else 0
    second = sum(lower.count(w) for w in (" you ", " your ", " du ", " dich ", " tu ", " vous ", " te ", " tú "))
    return [
        sum(kind == 0 for _, kind, _ in found) / words, len(found) / words, math.log1p(len(found)), math.log1p(len({x[2] for x in found})), math.log1p(near), second / words,
        capitals / letters, len(SHOUT.findall(text)) / words, punctuation / size, int(raw[33]) / words, len(obfuscated) / words, math.log1p(max(0, plain)),
        len(REPEATED.findall(text)) / words, int(raw[48:58].sum()) / size, math.log1p(words), (capitals + small) / words,
    ]


def learn_lexicon(texts: list[str], toxic: np.ndarray, weights: np.ndarray) -> Lexicon:
    """Words and word beginnings that weighted document counts show to be typical of label 1."""
    counts = [Counter(), Counter()]
    docs = [float((weights * (toxic == y)).sum()) for y in (0, 1)]
    plain = Counter()
    for text, y, w in zip(texts, toxic.tolist(), weights.tolist(), strict=True):
        own = set()
        for word in set(WORD.findall(text.lower())):
            own.add((word, 2))
            for n in STEM_LENGTHS:
                if len(word) > n:
                    own.add((word[:n], 1))
        for x in own:
            counts[y][x] += w
        if y:
            plain.update(own)
    scored = []
    for x, n in plain.items():
        if n >= LEXICON_LEAST and len(x[0]) >= 3:
            ratio = (counts[1][x] + 0.5) / docs[1] / ((counts[0][x] + 0.5) / docs[0])
            if ratio >= LEXICON_RATIO:
                scored.append((math.log(ratio) * math.sqrt(n), x))
    scored.sort(key=lambda s: (-s[0], s[1]))
    best = [x for _, x in scored[:LEXICON_SIZE]]
    return Lexicon(SEEDS, [w for w, kind in best if kind == 1], [w for w, kind in best if kind == 2])


class Tree(NamedTuple):
    """A complete tree: feature and threshold of each inner node, value of each leaf."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray


class Model(NamedTuple):
    lexicon: Lexicon
    start: float
    trees: list[Tree]
    knots: np.ndarray
    levels: np.ndarray


def leaf_of(x: np.ndarray, tree: Tree) -> np.ndarray:
    node = np.zeros(len(x), np.int64)
    for _ in range(int(math.log2(len(tree.value)))):
        node = 2 * node + 1 + (x[np.arange(len(x)), tree.feature[node]] > tree.threshold[node])
    return node - len(tree.feature)


def margin(x: np.ndarray, start: float, trees: list[Tree]) -> np.ndarray:
    return start + sum((t.value[leaf_of(x, t)] for t in trees), np.zeros(len(x)))


def boost(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, list[Tree]]:
    """Trees of logistic loss, split by histograms."""
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)], axis=1)
    share = min(max(float((w * y).sum() / w.sum()), 1e-3), 1 - 1e-3)
    start = math.log(share / (1 - share))
    f, trees, inner = np.full(len(y), start), [], 2**DEPTH - 1
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-f))
        g, h = w * (y - p), w * p * (1 - p)
        feature, threshold, node = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(len(y), np.int64)
        for level in range(DEPTH):
            first, nodes = 2**level - 1, 2**level
            local = node - first
            gain, at = np.full(nodes, 1e-9), [None] * nodes
            for j, e in enumerate(edges):
                key, size = local * (BINS + 1) + binned[:, j], nodes * (BINS + 1)
                gs, hs = (np.bincount(key, v, size).reshape(nodes, -1).cumsum(1) for v in (g, h))
                gt, ht = gs[:, -1:], hs[:, -1:]
                score = gs**2 / (hs + L2) + (gt - gs) ** 2 / (ht - hs + L2) - gt**2 / (ht + L2)
                for k in range(nodes):
                    b = int(score[k, : len(e)].argmax()) if len(e) else 0
                    if len(e) and score[k, b] > gain[k]:
                        gain[k], at[k] = score[k, b], (j, e[b])
            for k, s in enumerate(at):
                if s:
                    feature[first + k], threshold[first + k] = s
            node = 2 * node + 1 + (x[np.arange(len(x)), feature[node]] > threshold[node])
        leaf = node - inner
        value = RATE * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + L2)
        trees.append(Tree(feature, threshold, value))
        f = f + value[leaf]
    return start, trees


def isotonic(score: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots and the rising levels at them."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []  # weight, weighted sum, first score, last score
    for s, t, v in zip(score[order].tolist(), y[order].tolist(), w[order].tolist(), strict=True):
        if blocks and blocks[-1][3] == s:
            blocks[-1][0] += v
            blocks[-1][1] += v * t
        else:
            blocks.append([v, v * t, s, s])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            v2, t2, _, last = blocks.pop()
            blocks[-1] = [blocks[-1][0] + v2, blocks[-1][1] + t2, blocks[-1][2], last]
    knots = np.array([x for b in blocks for x in (b[2], b[3])])
    levels = np.array([x for b in blocks for x in (b[1] / b[0],) * 2])
    return knots, levels


def fit(texts: list[str], toxic: np.ndarray, weights: np.ndarray) -> Model:
    """The lexicon and trees from four fifths of the rows, the calibration from the others."""
    own = np.arange(len(texts)) % 5 != 4
    if not all(((toxic == y) & part).any() for y in (0, 1) for part in (own, ~own)):
        own = np.ones(len(texts), bool)
    lexicon = learn_lexicon([t for t, k in zip(texts, own, strict=True) if k], toxic[own], weights[own])
    matcher = lexicon.matcher()
    x = np.array([describe(t, matcher) for t in texts])
    start, trees = boost(x[own], toxic[own], weights[own])
    rest = ~own if (~own).any() else own
    knots, levels = isotonic(margin(x[rest], start, trees), toxic[rest], weights[rest])
    return Model(lexicon, start, trees, knots, levels)


def calibrated(model: Model, x: np.ndarray) -> np.ndarray:
    """Rising in the margin within levels as well, so that equal levels still rank; at most 0.01 from the level."""
    m = margin(x, model.start, model.trees)
    level = np.interp(m, model.knots, model.levels)
    return np.clip(0.98 * level + 0.02 / (1 + np.exp(-m)), 0.0, 1.0)


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Texts, labels and weights of the bounded sample."""
    used = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
    totals = {r["toxic"]: r["n"] for r in used.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    order = (F.xxhash64("doc_id", F.lit("fit")), "doc_id")
    # At most 2 * rows ids, so the broadcast is bounded.
    picked = used.filter("toxic = 0").orderBy(*order).limit(rows).unionByName(used.filter("toxic = 1").orderBy(*order).limit(rows))
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(picked.dropDuplicates(["doc_id"])), "doc_id")
    got = found.orderBy(*order, F.xxhash64("text")).limit(2 * rows).collect()
    toxic = np.array([r["toxic"] for r in got], np.int64)
    weights = np.array([totals[r["toxic"]] / max(1, int((toxic == r["toxic"]).sum())) for r in got])
    return [r["text"] or "" for r in got], toxic, weights / (weights.mean() if len(weights) else 1)


def scorer(docs: DataFrame, labels: DataFrame) -> Callable[[list[str]], np.ndarray]:
    """What gives texts their scores; plain data and functions, so it can travel to executors."""
    texts, toxic, weights = training_rows(docs, labels)
    if len(set(toxic.tolist())) < 2:
        constant = float(toxic.mean()) if len(toxic) else 0.0
        return lambda texts: np.full(len(texts), constant)
    model, made = fit(texts, toxic, weights), []

    def scores(texts: list[str]) -> np.ndarray:
        if not made:
            made.append(model.lexicon.matcher())
        return calibrated(model, np.array([describe(t, made[0]) for t in texts]))

    return scores


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id and score of every document."""
    scores = scorer(docs, labels)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                got = np.concatenate([scores([x.as_py() or "" for x in batch["text"][k : k + 256]]) for k in range(0, batch.num_rows, 256)])
                yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(got, pa.float64())], names=["doc_id", "score"])
        give_back()

    wanted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return wanted.mapInArrow(rate, "doc_id long, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: every document's toxicity."""
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return score(docs, labels).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that score below 0.5, with all their columns."""
    scores, names = scorer(docs, labels), docs.columns
    place = names.index("text")

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                got = np.concatenate([scores([x.as_py() or "" for x in batch.column(place)[k : k + 256]]) for k in range(0, batch.num_rows, 256)])
                yield batch.filter(pa.array(got < 0.5))
        give_back()

    return docs.mapInArrow(clean, docs.schema)
