"""Packing documents into sequences of a fixed number of tokens by the sum-of-squares rule.

A document's tokens are its tokenizer ids followed by one separator id. Only documents longer than a sequence are cut,
into pieces of that length; whole pieces are sequences of their own. All others are dealt to shards of about
``shard_items`` pieces, each packed by itself: a piece goes where the sum over all gaps of (number of open bins with
that gap) squared becomes smallest, the smaller gap among equals. Bins that stay looser than ``slack`` are opened
again and their pieces packed once more, all shards' together in as few new shards, longest first.

Defined cases: a null text is empty, so it is the separator alone; repeated rows are packed as often as they occur;
a null id stays null; an empty table gives no rows. Other columns aren't read, so their names can't clash.
Texts of any length are handled in blocks that end at white space.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from collections.abc import Iterable, Iterator
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.llm.shared import Workspace, give_back
from veilframe.llm.shingles import BASES, mix, powers

LENGTH = 2048
SHARD_ITEMS = 32_000
#: Words that a task remembers, at about 50 bytes each.
ENTRIES = 400_000
#: Bytes of texts that are handled at a time.
BLOCK = 1 << 20
#: Bytes of a word from which on it has a digest for a hash.
LONG = 64
#: How a vocabulary that is handled by words has to split them.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: What isn't certain to be tokenized alike in parts that are cut at white space, and in lower case.
UNSURE = re.compile(r"[^\t-\r\x20-\x7e\xa1-\u012f\u0131-\u024f]")
BREAK = re.compile(rb"[\t-\r\x20]")
#: Kinds of bytes of what UNSURE lets through, in lower case: white space, letters, digits, marks.
SPACE, LETTER, DIGIT, MARK = range(4)
KIND = np.full(256, MARK, np.uint8)
KIND[[9, 10, 11, 12, 13, 32]] = SPACE
KIND[97:123] = KIND[128:] = LETTER
KIND[48:58] = DIGIT
#: Kinds by the second byte of two-byte characters that aren't all letters: U+00AA, U+00B5, U+00BA; U+00D7, U+00F7.
KINDS_AFTER = {0xC2: np.full(256, MARK, np.uint8), 0xC3: np.full(256, LETTER, np.uint8)}
KINDS_AFTER[0xC2][[0xAA, 0xB5, 0xBA]] = LETTER
KINDS_AFTER[0xC2][[0xB2, 0xB3, 0xB9, 0xBC, 0xBD, 0xBE]] = DIGIT
KINDS_AFTER[0xC3][[0x97, 0xB7]] = MARK


class WordEncoder:
    """Encodes texts as little-endian unsigned 32-bit ids, a block of texts at a time by numpy.

    A block's words are told apart by two 64-bit hashes (words of over LONG bytes by a digest). What words encode to is
    kept in arrays ordered by hash, of ENTRIES words at most: beyond, the half that was used last stays. Only
    vocabularies that split words as SPLIT says, in lower case, with marked word ends, are handled so; for all others,
    and for texts with other characters or with added tokens, the tokenizer gets whole texts.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.path = path
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        normal = [x["type"] for x in (made.get("normalizer") or {}).get("normalizers", [])]
        split = [x.get("pattern") for x in (made.get("pre_tokenizer") or {}).get("pretokenizers", [])]
        model = made["model"]
        self.by_words = normal == ["NFC", "Replace", "Lowercase"] and split == [{"Regex": SPLIT}, None] and model.get("type") == "BPE" and model.get("end_of_word_suffix") == "</w>" and not model.get("dropout")
        self.added = [x["content"] for x in made.get("added_tokens") or []]
        if self.by_words:
            # Words as SPLIT gives them, in lower case, need neither normalising nor splitting by a regular expression.
            byte_level = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
            self.plain_words = Tokenizer.from_str(json.dumps(made | {"normalizer": None, "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, byte_level]}}))
            self.ends = np.zeros(max(model["vocab"].values()) + 1, bool)
            self.ends[[i for name, i in model["vocab"].items() if name.endswith("</w>")]] = True
        self.tables = [powers(base, LONG) for base in BASES]
        self.keys, self.checks = np.empty(0, np.uint64), np.empty(0, np.uint64)
        self.first, self.count, self.used = (np.empty(0, np.int64) for _ in range(3))
        self.ids, self.blocks = np.empty(0, "<u4"), 0

    def many(self, texts: Iterable[str]) -> Iterator[bytes]:
        """The ids of each text."""
        held: list[bytes] = []
        size = 0
        for text in texts:
            if not self.by_words or UNSURE.search(text) or any(x in text for x in self.added):
                yield from self.block(held)
                held, size = [], 0
                yield self.plain(text)
                continue
            raw = text.lower().encode()
            if size + len(raw) > BLOCK:
                yield from self.block(held)
                held, size = [], 0
            if len(raw) > BLOCK:
                yield b"".join(self.block([part])[0] if len(part) <= 2 * BLOCK else self.plain(part.decode()) for part in self.cut(raw))
            else:
                held.append(raw)
                size += len(raw) + 1
        yield from self.block(held)

    @staticmethod
    def cut(raw: bytes) -> Iterator[bytes]:
        """A long text's parts of BLOCK bytes up to the next white space."""
        at = 0
        while at < len(raw):
            found = BREAK.search(raw, at + BLOCK)
            end = found.start() if found else len(raw)
            yield raw[at:end]
            at = end

    @cached_property
    def tokenizer(self):
        """For whole texts; only loaded where there are such."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def plain(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def block(self, raws: list[bytes]) -> list[bytes]:
        """The ids of the texts of a block."""
        if not raws:
            return []
        data = b"\n".join(raws) + b"\n"
        first, size, hashes, checks = self.words_of(data)
        if not len(first):
            return [b""] * len(raws)
        keys, at, word = np.unique(hashes, return_index=True, return_inverse=True)
        own = checks[at]
        place = np.searchsorted(self.keys, keys)
        near = np.minimum(place, max(0, len(self.keys) - 1))
        known = self.keys[near] == keys if len(self.keys) else np.zeros(len(keys), bool)
        if (checks != own[word]).any() or (self.checks[near[known]] != own[known]).any():
            return [self.plain(raw.decode()) for raw in raws]  # two words of one hash
        self.blocks += 1
        self.used[near[known]] = self.blocks
        if not known.all():
            begin = first[at[~known]]
            self.learn(keys[~known], own[~known], [data[i:j].decode() for i, j in zip(begin.tolist(), (begin + size[at[~known]]).tolist(), strict=True)])
            place = np.searchsorted(self.keys, keys)
        count = self.count[place][word]
        stop = np.cumsum(count)
        ids = self.ids[np.repeat(self.first[place][word] - (stop - count), count) + np.arange(stop[-1])]
        ends = np.searchsorted(first, np.cumsum([len(raw) + 1 for raw in raws]))
        bounds = np.concatenate([[0], np.concatenate([[0], stop])[ends]]).tolist()
        return [ids[i:j].tobytes() for i, j in zip(bounds, bounds[1:], strict=False)]

    def words_of(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Where each word begins, its bytes, and its two hashes. A chunk with an apostrophe is one word."""
        raw = np.frombuffer(data, np.uint8)
        kind = KIND[raw]
        for lead, kinds in KINDS_AFTER.items():
            two = np.flatnonzero(raw == lead)
            if len(two):
                kind[two] = kind[two + 1] = kinds[raw[two + 1]]
        begin = kind != 0
        solid = begin.copy()
        begin[1:] &= (kind[1:] != kind[:-1]) | ((kind[1:] == DIGIT) & ((raw[1:] & 0xC0) != 0x80))
        if b"'" in data:
            chunk = solid.copy()
            chunk[1:] &= ~solid[:-1]
            number = np.cumsum(chunk)
            whole = np.zeros(number[-1] + 1, bool)
            whole[number[raw == 39]] = True
            begin &= chunk | ~whole[number]
        first = np.flatnonzero(begin)
        if not len(first):
            return first, first, np.empty(0, np.uint64), np.empty(0, np.uint64)
        size = np.add.reduceat(solid, first, dtype=np.int64)
        at = np.minimum(np.arange(first[0], len(raw)) - np.repeat(first, np.diff(np.append(first, len(raw)))), LONG - 1)
        codes = (raw.astype(np.uint64) + np.uint64(1)) * solid
        out = [mix(np.add.reduceat(codes[first[0] :] * table[at], first - first[0])) for table in self.tables]
        for i in np.flatnonzero(size > LONG).tolist():
            digest = hashlib.blake2b(data[first[i] : first[i] + size[i]], digest_size=16).digest()
            out[0][i], out[1][i] = np.frombuffer(digest, np.uint64)
        return first, size, out[0], out[1]

    def learn(self, keys: np.ndarray, checks: np.ndarray, words: list[str]) -> None:
        """Keep what these words, in order of their hashes, encode to."""
        odd = {i: self.plain(w) for i, w in enumerate(words) if "'" in w}
        # A word's last id is one that ends a word, and no other: so words are encoded as one text.
        ids = np.asarray(self.plain_words.encode_batch_fast([" ".join(w for w in words if "'" not in w)], add_special_tokens=False)[0].ids, "<u4")
        last = np.flatnonzero(self.ends[ids]) + 1
        if len(last) + len(odd) != len(words) or (len(last) and last[-1] != len(ids)):
            raise RuntimeError("the vocabulary has words without an end")
        count, first = np.empty(len(words), np.int64), np.empty(len(words), np.int64)
        even = np.ones(len(words), bool)
        even[list(odd)] = False
        count[even] = np.diff(last, prepend=0)
        first[even] = last - count[even]
        at = len(ids)
        for i, found in odd.items():
            first[i], count[i] = at, len(found) // 4
            at += count[i]
        ids = np.concatenate([ids, *(np.frombuffer(x, "<u4") for x in odd.values())])
        if len(self.keys) + len(keys) > ENTRIES:
            self.forget()
        first += len(self.ids)
        self.ids = np.concatenate([self.ids, ids])
        order = np.argsort(np.concatenate([self.keys, keys]), kind="stable")
        join = lambda a, b: np.concatenate([a, b])[order]
        self.keys, self.checks, self.first, self.count = join(self.keys, keys), join(self.checks, checks), join(self.first, first), join(self.count, count)
        self.used = join(self.used, np.full(len(keys), self.blocks))

    def forget(self) -> None:
        """Drop the words that were used longest ago, but none of this block."""
        stay = (self.used > np.median(self.used)) | (self.used == self.blocks)
        count = self.count[stay]
        stop = np.cumsum(count)
        self.ids = self.ids[np.repeat(self.first[stay] - (stop - count), count) + np.arange(stop[-1] if len(stop) else 0)]
        self.keys, self.checks, self.first, self.count, self.used = self.keys[stay], self.checks[stay], stop - count, count, self.used[stay]


def pieces(docs: DataFrame, vocabulary: str, length: int = LENGTH, separator: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder, end = WordEncoder(vocabulary), int(separator).to_bytes(4, "little")
        for batch in batches:
            rows = []
            for doc_id, found in zip(batch["doc_id"].to_pylist(), encoder.many(x.as_py() or "" for x in batch["text"]), strict=True):
                ids, step = found + end, 4 * length
                for k in range(0, len(ids), step):
                    part = ids[k : k + step]
                    rows.append((doc_id, k // step, k // 4, len(part) // 4, zlib.crc32(part)))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])
        del encoder
        give_back()

    wanted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return wanted.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For lengths below the capacity, in this order: each one's bin, its offset there, and the bins' final gaps."""
    counts = np.zeros(capacity + 1, np.int64)  # open bins by gap; at 0 and at the capacity always none
    at: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets, gaps = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), []
    for i, s in enumerate(lengths.tolist()):
        # From gap g to g - s, the sum of squares changes by 2 * (counts[g - s] - counts[g]) + 2, less at the ends.
        change = 2 * (counts[: capacity + 1 - s] - counts[s:]) + 2
        change[counts[s:] == 0] = np.iinfo(np.int64).max
        if counts[s]:
            change[0] = 1 - 2 * counts[s]
        change[-1] = 2 * counts[capacity - s] + 1
        gap = int(change.argmin()) + s
        if gap == capacity:
            own = len(gaps)
            gaps.append(0)
        else:
            own = at[gap].pop()
            counts[gap] -= 1
        bins[i], offsets[i], gaps[own] = own, capacity - gap, gap - s
        if gap > s:
            counts[gap - s] += 1
            at[gap - s].append(own)
    return bins, offsets, np.asarray(gaps, np.int64)


SEQUENCE = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, gap long"


def pack_shards(items: DataFrame, shards: int, level: int, length: int, longest_first: bool) -> DataFrame:
    """Pack the items of each shard; gap is what stays free in the sequence that an item is in."""

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        order = ["length", "doc_id", "piece", "ids_crc32"] if longest_first else ["turn", "doc_id", "piece", "ids_crc32"]
        rows = rows.sort_values(order, ascending=[not longest_first, True, True, True], kind="stable")
        bins, offsets, gaps = sum_of_squares(rows["length"].to_numpy(), length)
        shard = int(rows["shard"].iloc[0])
        return rows[["doc_id", "piece", "start", "length", "ids_crc32"]].assign(sequence_id=(level << 60) + (shard << 32) + bins, offset=offsets, gap=gaps[bins])

    turn = F.xxhash64("doc_id", "piece", "ids_crc32", F.lit(level))
    dealt = items.withColumn("turn", turn).withColumn("shard", F.pmod(F.xxhash64("turn", F.lit("shard")), F.lit(shards)).cast("int"))
    return dealt.groupBy("shard").applyInPandas(one, SEQUENCE)


def pack(docs: DataFrame, vocabulary: str, length: int = LENGTH, separator: int = 0, shard_items: int = SHARD_ITEMS, slack: int = 0, name: str = "pack") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    work = Workspace(docs.sparkSession, name)
    cut = work.keep(pieces(docs, vocabulary, length, separator), "pieces")
    whole = cut.filter(F.col("length") == length).withColumn("sequence_id", F.lit(3 << 60) + F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    part = cut.filter(F.col("length") < length)
    first = work.keep(pack_shards(part, max(1, -(-part.count() // shard_items)), 0, length, False), "first")
    loose = first.filter(F.col("gap") > slack).select("doc_id", "piece", "start", "length", "ids_crc32")
    again = work.keep(pack_shards(loose, max(1, -(-loose.count() // shard_items)), 1, length, True), "again")
    return whole.unionByName(first.filter(F.col("gap") <= slack).drop("gap")).unionByName(again.drop("gap"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: all documents in sequences of at most 2048 tokens."""
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"), name="op2")
