import base64
import hashlib

import pytest

from riskweave.llm import warc as W

PLAIN = "page_id long, url string, html string"


def expected(rows, least=0):
    size = lambda h: len((h or "").encode())
    last = {}
    for page, _, html in rows:
        last[html or ""] = max(last.get(html or "", page), page)
    out = []
    for page, _, html in rows:
        first = last[html or ""] if size(html) >= least else page
        digest = base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()
        out.append((page, size(html), digest, "response" if first == page else "revisit", None if first == page else first))
    return sorted(out)


ROWS = [(1, "http://a/", "é" * 2500), (2, "u\r\nWARC-Type: x", None), (3, None, ""), (4, "x", "same"), (9, "x", "same"), (5, "x", "same"),
        (6, "y", "\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n" * 200), (7, "z", "é" * 2500), (8, "z", "x" * 1000)]


@pytest.mark.parametrize("chunk", [1 << 16, 1000, 7])
def test_round_trip(spark, chunk):
    got = W.round_trip(spark, spark.createDataFrame(ROWS, PLAIN), chunk=chunk)
    assert sorted(tuple(r) for r in got.collect()) == expected(ROWS)


def test_small_payloads_are_all_responses(spark):
    got = W.round_trip(spark, spark.createDataFrame(ROWS, PLAIN), min_revisit_bytes=100)
    assert sorted(tuple(r) for r in got.collect()) == expected(ROWS, 100)


def test_many_archives_are_well_formed(spark, tmp_path):
    made = W.records(spark.createDataFrame(ROWS, PLAIN))
    W.write(made, str(tmp_path / "w"), chunk=500, max_records=2)
    files = [p.read_bytes() for p in (tmp_path / "w").glob("part-*")]
    assert len(files) > 3
    kinds = [f["warc-type"] for data in files for f, _ in W.parsed(data)]
    assert kinds.count("response") + kinds.count("revisit") == len(ROWS) and "continuation" in kinds


def test_null_id_repeats_clashing_columns_and_empty(spark):
    df = spark.createDataFrame([(None, "u", "a", 1), (3, "u", "a", 1), (3, "u", "a", 1)], PLAIN + ", refers_to int")
    got = sorted([tuple(r)[0:2] + tuple(r)[3:] for r in W.round_trip(spark, df).collect()], key=str)
    assert got == [(3, 1, "response", None), (3, 1, "response", None), (None, 1, "revisit", 3)]
    assert W.round_trip(spark, spark.createDataFrame([], PLAIN)).collect() == []
