import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from veilframe.llm import packing

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def expected(rows, length):
    """(doc_id, piece, start, length, crc) by the tokenizer alone."""
    tokenizer, out = Tokenizer.from_file(VOCABULARY), []
    for doc_id, text in rows:
        ids = np.asarray(tokenizer.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        for k in range(0, len(ids), length):
            part = ids[k : k + length]
            out.append((doc_id, k // length, k, len(part), zlib.crc32(part.tobytes())))
    return sorted(out, key=str)


def check(rows, got, length):
    assert sorted([(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got], key=str) == expected(rows, length)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        end = 0
        for offset, n in sorted(places):
            assert offset == end
            end += n
        assert end <= length
    return len(by)


def test_cases(spark):
    texts = [None, "", "a", "It's the words' ends; 12 x 3.5é Été", "中文 mix́ed   space\x1funit", "word " * 900, "x" * 5000, "<|endoftext|> a<|endoftext|>b <|ENDOFTEXT|>", "<|EndOfText|>", "İstanbul ß ²"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "null id"), (2, "a"), (2, "a")]
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "doc_id long, text string, sequence_id string, offset int")
    check(rows, packing.pack(docs, VOCABULARY, length=64).collect(), 64)
    assert packing.pack(docs.limit(0), VOCABULARY).count() == 0


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = packing.query(spark, "/root/testdata/sf0.001").collect()
    used = check(rows, got, packing.LENGTH)
    assert used <= 1.02 * -(-sum(r.length for r in got) // packing.LENGTH) + 1


def brute(lengths, capacity):
    """The rule by trying every gap and summing all squares."""
    gaps, counts = [], {}
    for s in lengths:
        best = None
        for g in sorted({g for g in gaps if g >= s}) + [capacity]:
            c = dict(counts)
            if g != capacity:
                c[g] -= 1
            if g > s:
                c[g - s] = c.get(g - s, 0) + 1
            key = sum(x * x for x in c.values())
            if best is None or key < best[0]:
                best = (key, g, c)
        _, g, counts = best
        if g == capacity:
            gaps.append(capacity - s)
        else:
            gaps[gaps.index(g)] = g - s
    return sorted(gaps)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 19), max_size=40))
def test_rule(lengths):
    bins, offsets, gaps = packing.sum_of_squares(np.asarray(lengths, np.int64), 20)
    assert sorted(gaps.tolist()) == brute(lengths, 20)


@pytest.mark.parametrize("block", [1, 7, 64, 1 << 20])
@pytest.mark.parametrize("entries", [1, 400_000])
def test_blocks(block, entries, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK", block)
    monkeypatch.setattr(packing, "ENTRIES", entries)
    texts = ["One two, three's  four\n\nfive-six 78 nine. " * 5, "", "a., b. c_. d_, 5, 6. (x). y", "Été, ça. ²³ ª,º µ. x", "中, 文. x", "it's, we'll. I'd 'tis", "end.\nnext,\n"]
    tokenizer = Tokenizer.from_file(VOCABULARY)
    want = [np.asarray(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert list(packing.WordEncoder(VOCABULARY).many(texts)) == want


TOKENIZER, ENCODER = Tokenizer.from_file(VOCABULARY), packing.WordEncoder(VOCABULARY)
LETTERS = "ab eZÉ .,'!?0123²½ªº_-\t\nß·×ǅĲſ" + "".join(chr(i) for i in range(0xA1, 0x250)) + "’…漢é́ \x1c\x85"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from(LETTERS), max_size=90), max_size=8))
def test_texts(texts):
    want = [np.asarray(TOKENIZER.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert list(ENCODER.many(texts)) == want


def test_another_vocabulary():
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer, texts = Tokenizer.from_file(path), ["Hello World", "a  b", "", "It's 12\n\nÉté " * 30]
    want = [np.asarray(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    encoder = packing.WordEncoder(path)
    assert not encoder.by_words and list(encoder.many(texts)) == want
