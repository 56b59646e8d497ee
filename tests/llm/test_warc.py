import gzip
import io

import pytest

from veilframe.llm import warc
from veilframe.llm.shared import Workspace


def whole(records):
    return gzip.compress(b"".join(records))


def test_normalise_gives_a_member_for_each_record():
    payloads = [b"", b"a" * 200_000, "hé\r\n\r\nWARC/1.1".encode(), b"x"]
    records = [warc.record(i, "http://a/ b\r\nc", p, None) for i, p in enumerate(payloads)]
    for source in (whole(records), whole(records[:2]) + whole(records[2:])):
        out = io.BytesIO()
        index = list(warc.normalise(io.BytesIO(source), out))
        data = out.getvalue()
        assert [gzip.decompress(data[x.offset : x.offset + x.length]) for x in index] == records
        assert sum(x.length for x in index) == len(data)
        assert [warc.page_of(x.record_id) for x in index] == [0, 1, 2, 3]


@pytest.mark.parametrize("cut", [1, 30, 300])
def test_broken_streams_are_errors(cut):
    data = b"".join([warc.record(1, None, b"y" * 500, None)])
    with pytest.raises(ValueError):
        list(warc.normalise(io.BytesIO(gzip.compress(data[: len(data) - cut - 4])), io.BytesIO()))


def test_round_trip_of_odd_rows(spark):
    big, same = "b" * 1500, "é" * 500
    rows = [(1, "u", big), (2, None, big), (3, "\x00\n", same), (None, "n", same), (4, "u", None), (5, "u", ""), (6, "u", "s" * 999), (7, "u", "s" * 999), (9, "u", big), (9, "u", big)]
    pages = spark.createDataFrame([(*r, "x", 0) for r in rows], "page_id long, url string, html string, digest string, refers_to int")
    got = warc.round_trip(pages, Workspace(spark, "warc")).collect()
    assert len(got) == len(rows)
    seen = sorted((str(r.page_id), r.payload_bytes, r.record_type, r.refers_to) for r in got)
    assert seen == sorted([("1", 1500, "revisit", 9), ("2", 1500, "revisit", 9), ("3", 1000, "response", None), ("None", 1000, "revisit", 3), ("4", 0, "response", None), ("5", 0, "response", None), ("6", 999, "response", None), ("7", 999, "response", None), ("9", 1500, "response", None), ("9", 1500, "response", None)], key=lambda x: x)
    assert all(r.html is None or r.html == {i: h or "" for i, _, h in rows}[r.page_id] for r in got if r.page_id is not None)
    assert warc.round_trip(pages.limit(0), Workspace(spark, "warc")).count() == 0
