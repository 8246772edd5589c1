"""WARC: round trips over any split, revisits, planted magic bytes and broken members."""

import base64
import hashlib
import os

import duckdb

from uqframe.llm import queries, warc

ROWS = [(i, f"http://h/{i}", html) for i, html in enumerate(["<p>one</p>", None, "", "<p>one</p>", "x" * 300_000, "ß" * 5000, "\x1f\u008b\x08 magic", "<p>two\r\n\r\n</p>", "<p>one</p>"])]
SCHEMA = "page_id bigint, url string, html string"


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def want(rows):
    last = {}
    for k, _, html in rows:
        last[html or ""] = max(k, last.get(html or "", k))
    return sorted((str(k), len((h or "").encode()), digest(h), "response" if k == last[h or ""] else "revisit", None if k == last[h or ""] else str(last[h or ""])) for k, _, h in rows)


def test_round_trip_over_any_split(spark, tmp_path):
    folder = f"file://{tmp_path}/warc"
    df = spark.createDataFrame([(*r, "x") for r in ROWS], SCHEMA + ", kind string").repartition(3)
    files = warc.write(warc.with_kinds(df), folder, rows_per_file=2)
    for split in (37, 1000, warc.SPLIT):
        got = sorted((r.rid, r.payload_bytes, r.payload_digest, r.kind, r.refers_to) for r in warc.read(spark, folder, files, split).collect())
        assert got == want(ROWS)
    assert warc.read(spark, folder).count() == len(ROWS)


def test_leftovers_of_lost_attempts_are_not_read(spark, tmp_path):
    folder = f"file://{tmp_path}/warc"
    files = warc.write(warc.with_kinds(spark.createDataFrame(ROWS, SCHEMA)), folder)
    with open(tmp_path / "warc" / "lost.warc.gz", "wb") as f:
        f.write(warc.record("response", "u", "99", b"lost"))
    assert warc.read(spark, folder, files).count() == len(ROWS)


def test_false_magic_and_cut_off_members_are_skipped(spark, tmp_path):
    a, b = warc.record("response", "u", "1", b"a" * 100), warc.record("response", "u", "2", b"b" * 100)
    with open(tmp_path / "x.warc.gz", "wb") as f:
        f.write(warc.MAGIC + b"junk" + a + warc.MAGIC + b + warc.record("response", "u", "3", os.urandom(500))[:-40])
    assert sorted(r.rid for r in warc.read(spark, f"file://{tmp_path}", split=50).collect()) == ["1", "2"]


def test_empty_table_nulls_and_repeated_rows(spark, tmp_path):
    none = warc.write(warc.with_kinds(spark.createDataFrame([], SCHEMA)), f"file://{tmp_path}/none")
    assert warc.read(spark, f"file://{tmp_path}/none", none).count() == 0
    rows = [(None, None, None), (None, None, None), (5, None, "t"), (5, "u\r\nX: y", "t"), (4, "u", "t")]
    files = warc.write(warc.with_kinds(spark.createDataFrame(rows, SCHEMA)), f"file://{tmp_path}/some")
    got = sorted((r.rid, r.kind, r.refers_to) for r in warc.read(spark, f"file://{tmp_path}/some", files).collect())
    assert got == [("", "response", None), ("", "response", None), ("4", "revisit", "5"), ("5", "response", None), ("5", "response", None)]


def test_query_equals_sql(spark, sf_dir):
    pages = f"(SELECT * FROM '{sf_dir}/pages.parquet')"
    want_ = duckdb.sql(queries.OP6_SQL.replace("FROM pages", f"FROM {pages}")).fetchall()
    got = queries.op6_warc(spark, sf_dir).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(tuple, got)) == sorted(want_)


def test_headers_of_any_length_come_back(spark, tmp_path):
    rows = [(1, "http://h/" + "a" * 2_000_000, "long url"), (2, "http://h/2", "long url"), (3, "u", "x")]
    files = warc.write(warc.with_kinds(spark.createDataFrame(rows, SCHEMA)), f"file://{tmp_path}/long")
    got = sorted((r.rid, len(r.uri), r.kind) for r in warc.read(spark, f"file://{tmp_path}/long", files, split=700).collect())
    assert got == [("1", 2_000_009, "revisit"), ("2", 10, "response"), ("3", 1, "response")]


def test_one_range_is_handed_on_in_several_batches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "BATCH", 10)
    rows = [(i, f"u{i}", f"text {i} " * 5) for i in range(9)]
    files = warc.write(warc.with_kinds(spark.createDataFrame(rows, SCHEMA).coalesce(1)), f"file://{tmp_path}/many")
    assert sorted(r.rid for r in warc.read(spark, f"file://{tmp_path}/many", files).collect()) == sorted(str(i) for i in range(9))
