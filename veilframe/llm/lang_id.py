"""Language identification by a bidirectional gated recurrent network over bytes.

Each direction reads a window of bytes and keeps a hidden state; both states at a byte label that byte, and a
document's probabilities are the mean of its bytes' over all windows. The network is trained here with numpy by
backpropagation through time (``train``). Gates are piecewise linear, the candidate state is a hyperbolic tangent.

Training reads a bounded sample of each language: ``FIT_ROWS`` by the number of languages, at least ``LANG_ROWS``, of the
documents with the smallest hash of their id among those that aren't held out and have that language; a language that has
fewer than ``LEAST_ROWS`` in all isn't learned if others have more.
Every text is labelled whole, in windows of ``WINDOW`` bytes.

Defined cases: null text or a text without a letter is ``und`` with score 0; without any training row every text is
``und``; repeated rows and null ids give a row each. Only doc_id, text and lang are read, so other columns' names can't
clash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veilframe.llm.shared import held_out

FIT_ROWS, LANG_ROWS, LEAST_ROWS = 4000, 50, 5
HIDDEN, WINDOW, WINDOWS = 12, 128, 2048
STEPS, BATCH, TRAIN_WINDOW, STEP_SIZE = 400, 128, 48, 0.02
UNKNOWN = "und"
LETTER = re.compile(r"[^\W\d_]")


class Direction(NamedTuple):
    """Input weights by byte (update, reset, candidate), recurrent weights for the gates and for the candidate."""

    byte: np.ndarray
    gates: np.ndarray
    candidate: np.ndarray


class Network(NamedTuple):
    forward: Direction
    backward: Direction
    out: np.ndarray
    bias: np.ndarray
    langs: list[str]


def gate(x: np.ndarray) -> np.ndarray:
    x *= 0.25
    x += 0.5
    return np.clip(x, 0, 1, out=x)


def states(d: Direction, data: np.ndarray, reverse: bool, tape: list | None = None) -> np.ndarray:
    """The hidden state after each byte: data is (time, batch), the result (time, batch, hidden)."""
    n = d.candidate.shape[0]
    h = np.zeros((data.shape[1], n), np.float32)
    out = np.empty((*data.shape, n), np.float32)
    for t in range(len(data) - 1, -1, -1) if reverse else range(len(data)):
        x = d.byte[data[t]]
        g = h @ d.gates
        g += x[:, : 2 * n]
        g = gate(g)
        z, r = g[:, :n], g[:, n:]
        a = r * h
        c = np.tanh(a @ d.candidate + x[:, 2 * n :])
        if tape is not None:
            tape.append((t, h, z, r, a, c))
        h = c + z * (h - c)
        out[t] = h
    return out


def through_time(d: Direction, data: np.ndarray, tape: list, grad_out: np.ndarray) -> Direction:
    """The gradient of a direction's weights, from the gradient of its states."""
    n = d.candidate.shape[0]
    grads = Direction(*(np.zeros_like(w) for w in d))
    carry = np.zeros(grad_out.shape[1:], np.float32)
    for t, h, z, r, a, c in reversed(tape):
        dh = grad_out[t] + carry
        dc = dh * (1 - z) * (1 - c * c)
        dz = dh * (h - c)
        da = dc @ d.candidate.T
        dr = da * h
        dg = np.concatenate([dz * ((z > 0) & (z < 1)), dr * ((r > 0) & (r < 1))], axis=1) * 0.25
        grads.candidate[:] += a.T @ dc
        grads.gates[:] += h.T @ dg
        np.add.at(grads.byte, data[t], np.concatenate([dg, dc], axis=1))
        carry = dh * z + da * r + dg @ d.gates.T
    assert n == carry.shape[1]
    return grads


def softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=-1, keepdims=True))
    x /= x.sum(axis=-1, keepdims=True)
    return x


def start(langs: list[str], seed: int = 7) -> Network:
    rng = np.random.default_rng(seed)

    def normal(*shape: int, scale: float) -> np.ndarray:
        return (rng.standard_normal(shape) * scale).astype(np.float32)

    def direction() -> Direction:
        return Direction(normal(256, 3 * HIDDEN, scale=0.5), normal(HIDDEN, 2 * HIDDEN, scale=0.3), normal(HIDDEN, HIDDEN, scale=0.3))

    return Network(direction(), direction(), normal(2 * HIDDEN, len(langs), scale=0.3), np.zeros(len(langs), np.float32), langs)


def loss_and_gradients(net: Network, data: np.ndarray, target: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """The mean loss over every byte of the windows (time, batch), and the gradient of all weights."""
    tapes: list[list] = [[], []]
    h = np.concatenate([states(net.forward, data, False, tapes[0]), states(net.backward, data, True, tapes[1])], axis=2)
    p = softmax(h @ net.out + net.bias)
    at = np.arange(data.shape[1])
    loss = -float(np.log(p[:, at, target] + 1e-12).mean())
    p[:, at, target] -= 1
    p /= data.size
    grad_h = p @ net.out.T
    both = [through_time(d, data, tape, np.ascontiguousarray(g)) for d, tape, g in zip((net.forward, net.backward), tapes, (grad_h[..., :HIDDEN], grad_h[..., HIDDEN:]), strict=True)]
    return loss, [*both[0], *both[1], np.einsum("tbh,tbl->hl", h, p), p.sum(axis=(0, 1))]


def train(texts: list[str], langs: list[str], steps: int = STEPS, seed: int = 7) -> Network:
    """Adam on windows of every language alike, drawn from all places of the texts."""
    names, rng = sorted(set(langs)), np.random.default_rng(seed)
    pools = []
    for name in names:
        raw = [np.frombuffer(t.encode("utf-8", "replace"), np.uint8) for t, x in zip(texts, langs, strict=True) if x == name]
        # Each text counts with at most the mean length, so that none prevails; where it is read is drawn anew each time.
        size = np.minimum([len(x) for x in raw], np.mean([len(x) for x in raw]))
        pools.append((raw, size / size.sum()))
    net = start(names, seed)
    weights = [*net.forward, *net.backward, net.out, net.bias]
    m, v = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    for step in range(1, steps + 1):
        target = rng.integers(len(names), size=BATCH)
        data = np.full((TRAIN_WINDOW, BATCH), 32, np.uint8)
        for k, y in enumerate(target):
            raw, share = pools[y]
            text = raw[rng.choice(len(raw), p=share)]
            at = rng.integers(max(1, len(text) - TRAIN_WINDOW + 1))
            part = text[at : at + TRAIN_WINDOW]
            data[: len(part), k] = part
        _, grads = loss_and_gradients(net, data, target)
        size = np.sqrt(sum(float((g * g).sum()) for g in grads))
        pace = STEP_SIZE * min(1.0, 2 * (1 - step / (steps + 1)))
        for w, g, a, b in zip(weights, grads, m, v, strict=True):
            g = g * min(1.0, 1.0 / (size + 1e-9))
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            w -= (pace * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def position_probabilities(net: Network, data: np.ndarray) -> np.ndarray:
    """(time, batch, language) for windows (time, batch)."""
    h = states(net.forward, data, False) @ net.out[:HIDDEN]
    h += states(net.backward, data, True) @ net.out[HIDDEN:]
    h += net.bias
    return softmax(h)


def document_probabilities(net: Network, texts: list[bytes]) -> np.ndarray:
    """The mean of all bytes' probabilities of each text that has any bytes."""
    total = np.zeros((len(texts), len(net.langs)))
    owner, windows, size = [], [], []

    def flush() -> None:
        if windows:
            data = np.full((WINDOW, len(windows)), 32, np.uint8)  # always whole windows, so that results depend on the text alone
            for k, x in enumerate(windows):
                data[: len(x), k] = x
            p = position_probabilities(net, data)
            p *= (np.arange(len(data))[:, None] < np.array(size))[..., None]
            np.add.at(total, owner, p.sum(axis=0, dtype=np.float64))
            owner.clear()
            windows.clear()
            size.clear()

    for i, raw in enumerate(texts):
        data = np.frombuffer(raw, np.uint8)
        for k in range(0, len(data), WINDOW):
            owner.append(i)
            windows.append(data[k : k + WINDOW])
            size.append(len(windows[-1]))
            if len(windows) == WINDOWS:
                flush()
    flush()
    return total / np.maximum(1, np.array([len(x) for x in texts]))[:, None]


def training_rows(docs: DataFrame, rows: int = FIT_ROWS) -> tuple[list[str], list[str]]:
    """Texts and languages of the bounded sample."""
    used = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    used = used.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & (F.length("text") > 0) & ~held_out())
    counts = {r["lang"]: r["count"] for r in used.groupBy("lang").count().collect()}
    least = min(LEAST_ROWS, max(counts.values(), default=0))
    counts = {lang: n for lang, n in counts.items() if n >= least}
    if not counts:
        return [], []
    each = max(LANG_ROWS, rows // len(counts))
    # The smallest hashes: about twice as many rows as are wanted pass cut, so that a large language isn't sorted whole.
    cuts = [(lang, int(min(1.0, (2 * each + 100) / n) * (2**64 - 2**12)) - 2**63) for lang, n in counts.items()]
    cuts = F.broadcast(docs.sparkSession.createDataFrame(cuts, "lang string, cut long"))
    of_id = F.xxhash64("doc_id", F.lit("lang"))
    whole = F.col("cut") >= 2**63 - 2**13
    near = used.join(cuts, "lang").filter(whole | (of_id <= F.col("cut"))).drop("cut")
    order = (of_id, "doc_id")

    def first(found: DataFrame, *by) -> DataFrame:
        nth = F.row_number().over(Window.partitionBy("lang").orderBy(*by))
        return found.withColumn("nth", nth).filter(F.col("nth") <= each).drop("nth")

    # First the ids alone, so that texts aren't sorted; at most each of a language, so the broadcast is bounded.
    ids = first(near.select("lang", "doc_id"), *order)
    got = used.join(F.broadcast(ids.distinct()), ["lang", "doc_id"], "left_semi")
    got = first(got, *order, F.xxhash64("text", "lang")).orderBy(*order, F.xxhash64("text", "lang")).collect()
    return [r["text"] for r in got], [r["lang"] for r in got]


def predict(docs: DataFrame, net: Network | None) -> DataFrame:
    """doc_id, lang_pred and score of every document."""

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                texts = [x.as_py() or "" for x in part["text"]]
                known = [bool(LETTER.search(t)) and net is not None for t in texts]
                names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
                if any(known):
                    p = document_probabilities(net, [t.encode("utf-8", "replace") if ok else b"" for t, ok in zip(texts, known, strict=True)])
                    for i, ok in enumerate(known):
                        if ok:
                            best = int(p[i].argmax())
                            names[i], scores[i] = net.langs[best], min(1.0, float(p[i, best]))
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(names), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    wanted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return wanted.mapInArrow(label, "doc_id long, lang_pred string, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: every document's language."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts, langs = training_rows(docs)
    net = train(texts, langs) if texts else None
    return predict(docs, net).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
