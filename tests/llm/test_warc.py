"""Archives: exact round trip of payloads, segments, chunked framing and revisits."""

import gzip
import io

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tabloom.llm import warc as W

SCHEMA = "page_id long, url string, html string, digest string"


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=400), st.integers(1, 50))
def test_chunked_framing_round_trip(payload, size):
    assert W.dechunked(W.chunked(payload, size)) == payload


@pytest.mark.parametrize("body", [b"", b"5\r\nabc\r\n0\r\n\r\n", b"zz\r\n", b"3\r\nabcd\r\n0\r\n\r\n"])
def test_broken_framing_raises(body):
    with pytest.raises(ValueError):
        W.dechunked(body)


def test_records_are_gzip_members():
    data = b"".join(W.page_records("7:0.0", "http://a b/", b"x" * 100, None, 64))
    text = gzip.decompress(data).decode()
    assert text.count("WARC/1.1") == 4 and "WARC-Segment-Total-Length: 198" in text and "http://a%20b/" in text
    assert [f["warc-type"] for f, _ in W.read_records(io.BytesIO(data))] == ["response"] + ["continuation"] * 3
    with pytest.raises(ValueError):
        list(W.read_records(io.BytesIO(data[:-5])))


def rows():
    out = [(3, "u3", "same", "x"), (1, "u1", "same", None), (2, None, "same", "x"), (4, "u4", None, "x"), (5, "", "", "x"), (None, "n", "same", "x"),
           (6, "long", "é<p>" * 50_000, "x"), (7, "long", "é<p>" * 50_000, "x"), (8, "r", "repeated", "x"), (8, "r", "repeated", "x"), (9, "r", "repeated", "x"), (None, "only", "alone", "x")]
    return out + [(100 + i, f"u{i}", f"page {i % 40} " * (i % 40), "x") for i in range(200)]


def want(data):
    least = {}
    for p, _, h, _ in data:
        if p is not None:
            least[h or ""] = min(p, least.get(h or "", p))
    out = []
    for p, _, h, _ in data:
        body, first = (h or "").encode(), least.get(h or "")
        revisit = first is not None and p != first
        out.append((p, len(body), W.sha1_base32(body), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=str)


def test_round_trip(spark):
    data = rows()
    archives = W.write_archives(spark.createDataFrame(data, SCHEMA), segment=1000)
    assert sum(r["records"] for r in archives.collect()) == len(data)
    assert sorted(map(tuple, W.read_archives(archives).collect()), key=str) == want(data)


def test_small_payloads_are_all_responses(spark):
    data = rows()
    got = W.read_archives(W.write_archives(spark.createDataFrame(data, SCHEMA), min_revisit_bytes=6)).collect()
    assert {r["record_type"] for r in got if r["payload_bytes"] < 6} == {"response"}
    assert sum(r["record_type"] == "revisit" for r in got) == sum(w[3] == "revisit" for w in want(data) if w[1] >= 6)


def test_empty_table(spark):
    assert W.read_archives(W.write_archives(spark.createDataFrame([], SCHEMA))).count() == 0
