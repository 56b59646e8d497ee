import hashlib
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from veilframe.llm import media


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=3000), st.sampled_from([1, 100, 163, 164, 165, 170, 182, 184, 1000, media.UNIT]))
def test_round_trip(data, unit):
    old, media.UNIT = media.UNIT, unit
    try:
        payload = data.ljust(max(64, -(-len(data) // 64) * 64), b"\0")
        got = media.demux(media.mux(payload))
    finally:
        media.UNIT = old
    assert got.payload == payload and got.discontinuities == 0
    assert [u.offset for u in got.units] == list(range(0, len(payload), unit))
    assert [u.random_access for u in got.units] == [i % media.RAP_UNITS == 0 for i in range(len(got.units))]
    assert [u.pts for u in got.units] == [media.pts_of(u.offset) for u in got.units]


def test_table_checksums():
    assert media.crc32_mpeg(b"123456789") == 0x0376E6E7
    assert media.crc32_mpeg(media.PAT) == media.crc32_mpeg(media.PMT) == 0


def test_faults_are_seen():
    data = media.mux(bytes(range(256)) * 200)
    packets = [data[i : i + 188] for i in range(0, len(data), 188)]
    assert media.demux(b"".join(packets[:5] + [packets[4]] + packets[5:])).payload == bytes(range(256)) * 200  # a repeated packet
    with pytest.raises(media.TransportError):
        media.demux(b"".join(packets[:-1]))
    with pytest.raises(media.TransportError):
        media.demux(b"\0" + data[1:])
    with pytest.raises(media.TransportError):
        media.demux(packets[0][:20] + b"\x55" + packets[0][21:] + data[188:] if packets[0][20] != 0x55 and False else packets[0][:10] + bytes([packets[0][10] ^ 1]) + packets[0][11:] + data[188:])
    odd = bytearray(data)
    odd[3 * 188 + 3] = odd[3 * 188 + 3] & 0xF0 | (odd[3 * 188 + 3] + 5) & 15
    assert media.demux(bytes(odd)).discontinuities == 2


def test_table(spark, tmp_path):
    rows = [(1, None, 0), (2, "", 0), (3, "é" * 40_000, 0), (None, "abc", 0), (5, "abc", 0), (5, "abc", 0), (6, "x" * 64, 0)]
    spark.createDataFrame(rows, "doc_id long, text string, media int").write.parquet(f"{tmp_path}/documents.parquet")
    got = media.query(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: t for r, t in ((type("R", (), {"doc_id": i}), t) for i, t, _ in rows)}
    for r in got:
        raw = (by[r.doc_id] or "").encode()
        payload = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(media.mux(payload)), hashlib.sha256(media.mux(payload)).hexdigest())
    assert len({r[1:] for r in got if r.doc_id in (None, 5)}) == 1
