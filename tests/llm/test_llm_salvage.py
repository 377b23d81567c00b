"""The salvage reader on false headers, on long headers, and on damaged archives."""

import io

import duckdb
import pytest
from pyspark.sql import functions as F

from heronkb.llm import queries, warc


@pytest.mark.parametrize("false", [b"WARC/1.1\r\nContent-Length: 900000\r\n\r\n" + b"x" * 500, b"WARC/1.1\r\nno end, "])
def test_false_headers_cost_no_more_than_themselves(monkeypatch, false):
    sound = warc.page_record(1, "http://x/1", b"page", "0" * 40, None)
    copied = []
    get = warc.Ahead.get
    monkeypatch.setattr(warc.Ahead, "get", lambda self, a, b: copied.append(len(out := get(self, a, b))) or out)
    # The blank line before the sound record ends the last false header.
    blob = false * 300 + b"\r\n\r\n" + sound
    found = list(warc.salvage(io.BytesIO(blob)))
    assert [x.headers is not None for x in found] == [False, True] and found[-1].end == len(blob)
    assert sum(copied) < 5 * len(blob)


def test_blank_lines_are_found_once():
    data = warc.Ahead(io.BytesIO(b"a" * 700_000 + b"\r\n\r\n" + b"b" * 10 + b"\r\n\r\n"))
    assert data.blank_line(0, 100) == -1 and data.blank_line(5, 1 << 20) == 700_000
    assert data.blank_line(699_990, 10) == 700_000 and data.blank_line(699_990, 9) == -1
    assert data.blank_line(700_001, 100) == 700_014 and data.blank_line(700_015, 100) == -1 and data.blank_line(3, 1 << 20) == 700_000


def test_header_of_more_than_a_mebibyte():
    blob = warc.member(warc.page_record(1, "data:," + "x" * (3 << 20), b"page", "0" * 40, None))
    assert [x.headers["x-page-id"] for x in warc.salvage(io.BytesIO(blob))] == ["1"]


@pytest.mark.parametrize("name", ["op6_warc", "warc_salvage"])
def test_damaged_archives(spark, small, name):
    with duckdb.connect() as c:
        c.sql(f"CREATE VIEW pages AS SELECT * FROM '{small}/pages.parquet'")
        want = c.sql(f"SELECT page_id, payload_bytes, payload_digest, record_type, refers_to FROM ({queries.SQL[name]})").fetchall()
    assert sorted(map(tuple, queries.QUERIES[name](spark, small).collect()), key=str) == sorted(want, key=str)


def test_a_gap_in_its_own_archive_fails_the_query(spark, small, monkeypatch):
    write = warc.write_archives
    monkeypatch.setattr(warc, "write_archives", lambda pages, folder: write(pages, folder, harm=warc.harmed))
    with pytest.raises(Exception, match="gap in"):
        queries.op6_warc(spark, small).collect()


def test_salvage_of_no_pages(spark, small):
    none = spark.read.parquet(f"{small}/pages.parquet").limit(0)
    assert [tuple(r) for r in warc.salvage_digest(none).collect()] == [(None, 0, None, "gap", None)]
    odd = spark.createDataFrame([(None, None, None), (1, "u", ""), (1, "u", "")], "page_id bigint, url string, html string")
    assert warc.salvage_digest(odd).agg(F.count("*")).first()[0] == 4
