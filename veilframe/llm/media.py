"""Media columns: payloads of 8-bit samples in MPEG transport streams.

``mux`` cuts a payload into access units, wraps each as an elementary packet with a presentation time, and deals it to
188-byte packets; every ``RAP_UNITS``-th unit is a random-access point, and the program tables are repeated before it.
``demux`` reads the tables, checks the continuity counters, drops repeated packets, reassembles the elementary packets
and returns the payload with the index of its units: time, byte offset, packet number, random access.

Defined cases: a null text is empty, so 64 zero bytes are stored; repeated rows and null ids give a row each; an empty
table gives no rows. Only doc_id and text are read, so other columns' names can't clash.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.llm.shared import Workspace

PACKET, SYNC = 188, 0x47
PAT_PID, PMT_PID, DATA_PID, PROGRAM = 0x0000, 0x1000, 0x0100, 1
#: Private data in elementary packets.
STREAM_TYPE, STREAM_ID = 0x06, 0xBD
UNIT = 16_384
RAP_UNITS = 8
#: Samples a second, and ticks a second of presentation times.
RATE, CLOCK = 8_000, 90_000
BLOCK = 64
#: Bytes of media after which a batch is handed on.
BATCH_BYTES = 1 << 24


class Unit(NamedTuple):
    pts: int
    offset: int
    packet: int
    random_access: bool


class Stream(NamedTuple):
    payload: bytes
    units: list[Unit]
    packets: int
    discontinuities: int
    program: int
    stream_type: int


class TransportError(ValueError):
    """The bytes aren't a transport stream that can be read."""


def crc32_mpeg(data: bytes) -> int:
    """The checksum of program tables: polynomial 04C11DB7, most significant bit first, no final inversion."""
    crc = 0xFFFFFFFF
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = ((crc << 1) ^ (0x04C11DB7 if crc & 0x80000000 else 0)) & 0xFFFFFFFF
    return crc


def section(table_id: int, extension: int, body: bytes) -> bytes:
    head = bytes([table_id]) + (0xB000 | (len(body) + 9)).to_bytes(2, "big") + extension.to_bytes(2, "big") + b"\xc1\x00\x00"
    return head + body + crc32_mpeg(head + body).to_bytes(4, "big")


PAT = section(0, 1, PROGRAM.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))
PMT = section(2, PROGRAM, (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([STREAM_TYPE]) + (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00")


def time_bytes(pts: int) -> bytes:
    """A presentation time's five bytes with their marker bits."""
    return bytes([0x21 | (pts >> 29) & 0x0E, (pts >> 22) & 0xFF, 0x01 | (pts >> 14) & 0xFE, (pts >> 7) & 0xFF, 0x01 | (pts << 1) & 0xFE])


def pts_of(offset: int) -> int:
    return offset * CLOCK // RATE & (1 << 33) - 1


def mux(payload: bytes) -> bytes:
    out: list[bytes] = []
    counters = {PAT_PID: 0, PMT_PID: 0, DATA_PID: 0}

    def put(pid: int, data: bytes, start: bool, field: bytes | None = None) -> None:
        """One packet; field: the adaptation field's bytes after its length, which is stuffed as needed."""
        room = PACKET - 4 - len(data)
        if field is not None or room:
            field = (field or b"")[: max(0, room - 1)]
            if not field and room > 1:
                field = b"\x00"
            field = bytes([room - 1]) + field + b"\xff" * (room - 1 - len(field))
        head = bytes([SYNC, (0x40 if start else 0) | pid >> 8, pid & 0xFF, (0x30 if field else 0x10) | counters[pid]])
        counters[pid] = (counters[pid] + 1) & 15
        out.append(head + (field or b"") + data)

    for i, offset in enumerate(range(0, len(payload), UNIT)):
        rap, data = i % RAP_UNITS == 0, payload[offset : offset + UNIT]
        if rap:
            for pid, table in ((PAT_PID, PAT), (PMT_PID, PMT)):
                put(pid, (b"\x00" + table).ljust(PACKET - 4, b"\xff"), True)
        pes = b"\x00\x00\x01" + bytes([STREAM_ID]) + (len(data) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + time_bytes(pts_of(offset)) + data
        first = PACKET - 6
        put(DATA_PID, pes[:first], True, b"\x40" if rap else b"\x00")
        for k in range(first, len(pes), PACKET - 4):
            put(DATA_PID, pes[k : k + PACKET - 4], False)
    return b"".join(out)


def table_of(data: bytes, table_id: int) -> bytes:
    """A section's body, after its checks."""
    at = 1 + data[0]
    length = int.from_bytes(data[at + 1 : at + 3], "big") & 0xFFF
    whole = data[at : at + 3 + length]
    if whole[:1] != bytes([table_id]) or len(whole) < 12 or crc32_mpeg(whole):
        raise TransportError(f"program table {table_id} is damaged")
    return whole[8:-4]


def demux(media: bytes) -> Stream:
    if len(media) % PACKET:
        raise TransportError("not a whole number of packets")
    pmt_pid = data_pid = program = kind = None
    last: dict[int, tuple[int, bytes]] = {}
    units: list[Unit] = []
    parts: list[bytes] = []
    held: list[bytes] = []
    want = offset = breaks = 0
    seen: set[bytes] = set()
    for n in range(len(media) // PACKET):
        packet = media[n * PACKET : (n + 1) * PACKET]
        if packet[0] != SYNC:
            raise TransportError(f"packet {n} doesn't begin with the sync byte")
        pid, start, control, counter = (packet[1] & 0x1F) << 8 | packet[2], packet[1] & 0x40, packet[3] >> 4 & 3, packet[3] & 15
        at, random_access, announced = 4, False, False
        if control & 2:
            if packet[4]:
                random_access, announced = bool(packet[5] & 0x40), bool(packet[5] & 0x80)
            at = 5 + packet[4]
        if not control & 1:
            continue
        if pid in last:
            before, same = last[pid]
            if counter == before and packet == same:
                continue
            if counter != (before + 1) & 15 and not announced:
                breaks += 1
        last[pid] = counter, packet
        data = packet[at:]
        if pid == PAT_PID or pid == pmt_pid:
            if data not in seen:
                body = table_of(data, 0 if pid == PAT_PID else 2)
                if pid == PAT_PID:
                    program, pmt_pid = int.from_bytes(body[:2], "big"), int.from_bytes(body[2:4], "big") & 0x1FFF
                else:
                    at = 4 + (int.from_bytes(body[2:4], "big") & 0xFFF)
                    kind, data_pid = body[at], int.from_bytes(body[at + 1 : at + 3], "big") & 0x1FFF
                seen.add(data)
        elif pid == data_pid:
            if start:
                if want:
                    raise TransportError(f"the elementary packet before packet {n} isn't complete")
                if data[:3] != b"\x00\x00\x01":
                    raise TransportError(f"packet {n} doesn't begin an elementary packet")
                skip, t = 9 + data[8], data[9:14]
                pts = (t[0] >> 1 & 7) << 30 | t[1] << 22 | (t[2] >> 1) << 15 | t[3] << 7 | t[4] >> 1
                want = int.from_bytes(data[4:6], "big") - (skip - 6)
                units.append(Unit(pts, offset, n, random_access))
                data = data[skip:]
            held.append(data[:want])
            want -= len(held[-1])
            if not want:
                parts.append(b"".join(held))
                offset, held = offset + len(parts[-1]), []
    if want:
        raise TransportError("the last elementary packet isn't complete")
    return Stream(b"".join(parts), units, len(media) // PACKET, breaks, program or 0, kind or 0)


def padded(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode("utf-8")
    return len(raw), raw.ljust(max(BLOCK, -(-len(raw) // BLOCK) * BLOCK), b"\0")


UNITS = "array<struct<pts:long,offset:long,packet:long,random_access:boolean>>"
UNITS_ARROW = pa.list_(pa.struct([("pts", pa.int64()), ("offset", pa.int64()), ("packet", pa.int64()), ("random_access", pa.bool_())]))


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media and its units (times and random-access points) of every text."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                n, payload = padded(text.as_py())
                media = mux(payload)
                rows.append((doc_id.as_py(), n, media, [x._asdict() for x in demux(media).units]))
                held += len(media)
                if held > BATCH_BYTES:
                    yield table(rows)
                    rows, held = [], 0
            if rows:
                yield table(rows)

    def table(rows: list[tuple]) -> pa.RecordBatch:
        types = (pa.int64(), pa.int64(), pa.binary(), UNITS_ARROW)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["doc_id", "n_bytes", "media", "units"])

    wanted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return wanted.mapInArrow(write, f"doc_id long, n_bytes long, media binary, units {UNITS}")


def features(stream: Stream) -> str:
    """Counts and sample statistics of a stream, as text."""
    samples = np.frombuffer(stream.payload, np.uint8)
    counts = np.bincount(samples, minlength=256)
    share = counts[counts > 0] / len(samples)
    return ";".join(
        f"{k}={v}"
        for k, v in {
            "program": stream.program, "type": stream.stream_type, "packets": stream.packets, "breaks": stream.discontinuities, "units": len(stream.units),
            "random": sum(x.random_access for x in stream.units), "last_pts": stream.units[-1].pts, "mean": f"{samples.mean(dtype=np.float64):.4f}",
            "entropy": f"{float(-(share * np.log2(share)).sum()):.4f}", "distinct": len(share),
        }.items()
    )


def load(media: DataFrame) -> DataFrame:
    """What the stored bytes hold, read back; the stored index has to agree with the stream's."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, n, media, units in zip(*(batch[c] for c in ("doc_id", "n_bytes", "media", "units")), strict=True):
                data = media.as_py()
                stream = demux(data)
                if [x._asdict() for x in stream.units] != units.as_py():
                    raise TransportError("the stored index isn't the stream's")
                payload = stream.payload
                out.append((doc_id.as_py(), n.as_py(), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-BLOCK:]), len(data), hashlib.sha256(data).hexdigest(), features(stream)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    return media.mapInArrow(rows, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: store every text as a transport stream, read it back, describe it."""
    work = Workspace(spark, "op8")
    return load(work.keep(store(spark.read.parquet(f"{sf_dir}/documents.parquet")), "media"))
