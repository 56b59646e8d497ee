import zlib

import numpy as np

from veilframe.llm import lang_id

SF = "/root/testdata/sf0.01"


def test_gradients_against_differences():
    rng = np.random.default_rng(3)
    net = lang_id.start(["a", "b", "c"])
    as_double = lambda d: lang_id.Direction(*(w.astype(np.float64) for w in d))
    net = net._replace(forward=as_double(net.forward), backward=as_double(net.backward), out=net.out.astype(np.float64), bias=net.bias.astype(np.float64))
    data, target = rng.integers(0, 256, (6, 4)).astype(np.uint8), rng.integers(0, 3, 4)
    _, grads = lang_id.loss_and_gradients(net, data, target)
    weights = [*net.forward, *net.backward, net.out, net.bias]
    for w, g in zip(weights, grads, strict=True):
        for _ in range(4):
            at = tuple(rng.integers(s) for s in w.shape)
            if w.shape[0] == 256:
                at = (int(data[rng.integers(6), rng.integers(4)]), *at[1:])
            old, e = w[at], 1e-3
            w[at] = old + e
            up, _ = lang_id.loss_and_gradients(net, data, target)
            w[at] = old - e
            down, _ = lang_id.loss_and_gradients(net, data, target)
            w[at] = old
            assert abs((up - down) / (2 * e) - g[at]) < 2e-3 + 0.05 * abs(g[at])


def test_windows_do_not_change_pooling():
    net = lang_id.start(["a", "b"])
    texts = [b"abc" * 100, b"x", b"", bytes(range(256))]
    alone = [lang_id.document_probabilities(net, [t])[0] for t in texts]
    assert np.allclose(lang_id.document_probabilities(net, texts), alone, atol=1e-5)
    assert abs(alone[0].sum() - 1) < 1e-5 and alone[2].sum() == 0


def test_held_out_accuracy(spark):
    want = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    rows = lang_id.query(spark, SF).collect()
    assert len(rows) == len(want)
    assert all(0 <= r.score <= 1 for r in rows)
    held = [r.lang_pred == want[r.doc_id] for r in rows if r.held_out and r.lang_pred != "und"]
    assert np.mean(held) > 0.95


def test_odd_rows(spark):
    rows = [(1, None, "en", 0.5), (2, "12 34", None, 0.5), (None, "hello there", "en", 0.5), (3, "", "en", 0.5), (5, "bonjour à tous", "fr", 0.5), (5, "bonjour à tous", "fr", 0.5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    got = lang_id.predict(docs, lang_id.start(["en", "fr"])).collect()
    assert [r.lang_pred for r in got if r.doc_id in (1, 2, 3)] == ["und"] * 3
    assert {r.lang_pred for r in got if r.doc_id in (None, 5)} <= {"en", "fr"}
    assert {r.lang_pred for r in lang_id.predict(docs, None).collect()} == {"und"}
    assert lang_id.training_rows(docs.limit(0)) == ([], [])


def test_a_rare_language_is_sampled(spark):
    rows = [(i, f"text {i}", "rare" if i % 500 == 7 else "fr" if i % 2 else "en") for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    texts, langs = lang_id.training_rows(docs, 300)
    want = {t for i, t, x in rows if x == "rare" and zlib.crc32(str(i).encode()) % 5}
    assert {t for t, x in zip(texts, langs, strict=True) if x == "rare"} == want and len(want) >= lang_id.LEAST_ROWS
    assert langs.count("en") == langs.count("fr") == 100
