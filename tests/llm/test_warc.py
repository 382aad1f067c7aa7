"""Archives: round trips of awkward payloads, revisits, the parser, and assembly."""

import gzip
import hashlib

import pytest

from graphloom.llm import common
from graphloom.llm import warc as A

BIG = "x" * 150
PAYLOADS = [None, "", "a", "\r\n", "\r\n\r\n", "a\r\n\r\n\r\nb\r\n", "\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n", "é日\U0001f600" * 40, BIG, BIG, "\r\n" * 80, "\r\n" * 80, "s" * 99, "s" * 99, "t" * 100, "t" * 100, "end\r", "\n" + BIG, "y" * 300_000, BIG]


def pages():
    rows = [(k, f"http://h{k}.org/p?q={k}", p) for k, p in enumerate(PAYLOADS)]
    return [*rows, (40, None, "no url"), (41, "http://x\r\nInjected: yes", "line"), (None, "http://none.org/", "without id" * 20), (2, "http://again.org/", "a"), (70, "u", BIG * 9), (70, "u", BIG * 9)]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(pages(), "page_id long, url string, html string").selectExpr("*", "1 as digest", "2 as bytes", "3 as n", "4 as payload").repartition(3)


def test_query(spark, table, tmp_path):
    table.write.parquet(str(tmp_path / "pages.parquet"))
    found = [tuple(r) for r in A.op4_warc(spark, str(tmp_path)).collect()]
    least = {}
    for k, _, html in pages():
        if len((html or "").encode()) >= 100 and k is not None:
            least[html] = min(k, least.get(html, k))
    expected, seen = [], set()
    for k, _, html in pages():
        raw = (html or "").encode()
        revisit = html in least and (least[html] != k or (k, html) in seen)
        seen.add((k, html))
        expected.append((k, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if revisit else "response", least[html] if revisit else None))
    assert sorted(found, key=str) == sorted(expected, key=str)
    assert sum(r[3] == "revisit" for r in found) == 5


@pytest.mark.parametrize(("words", "share"), [(1, 10**9), (common.FILTER_WORDS, common.HOT_SHARE), (1, 1)])
def test_captures(spark, table, tmp_path, monkeypatch, words, share):
    monkeypatch.setattr(common, "FILTER_WORDS", words)
    monkeypatch.setattr(common, "HOT_SHARE", share)
    A.write_archives(table, str(tmp_path / "w"))
    records = A.read_archives(spark, str(tmp_path / "w"))
    assert records.count() == 3 * len(pages()) and records.where("not intact").isEmpty()
    captures = {}
    for r in A.assemble(records).collect():
        assert r["request"]["type"] == "request" and r["metadata"]["type"] == "metadata"
        captures.setdefault(r["metadata"]["fields"].get("page-id"), []).append(r)
    assert captures["6"][0]["response"]["payload"] == PAYLOADS[6].encode()
    assert captures["9"][0]["response"]["payload"] == b"" and captures["9"][0]["response"]["payload_bytes"] == 150
    assert captures["9"][0]["response"]["refers_to"] == captures["8"][0]["record_id"]
    assert captures["40"][0]["target_uri"] is None and "Injected" not in str(captures["41"][0]["response"]["fields"])
    assert len(captures["2"]) == 2 and len({r["record_id"] for r in captures["2"]}) == 2
    files = list((tmp_path / "w").glob("*.gz"))
    assert files and all(gzip.decompress(f.read_bytes()).endswith(b"\r\n\r\n") for f in files)


def test_capture_without_request(spark, table, tmp_path):
    A.write_archives(table, str(tmp_path / "w"))
    records = A.read_archives(spark, str(tmp_path / "w"), with_payload=False).where("type <> 'request'")
    rows = A.assemble(records).collect()
    assert len(rows) == len(pages()) and all(r["request"] is None and r["metadata"] is not None for r in rows)


def test_stream_in_pieces():
    one = b"WARC/1.1\r\nWARC-Type: resource\r\nContent-Length: 5\r\n\r\n\r\nx\r\n\r\n\r\n"
    for size in (1, 2, 7, 1000):
        stream, got = A.Stream(), []
        for k in range(0, 2 * len(one), size):
            got += list(stream.feed((one + one)[k : k + size]))
        assert [(h["warc-type"], b) for h, b in got] == [("resource", b"\r\nx\r\n")] * 2


def record(body, length=None):
    return b"WARC/1.1\r\nWARC-Type: resource\r\nContent-Length: %d\r\n\r\n%b\r\n\r\n" % (len(body) if length is None else length, body)


@pytest.mark.parametrize(
    "damage",
    [b"<html>\r\n\r\n", b"WARC/1.1\r\nWARC-Type: resource\r\n\r\nbody\r\n\r\n", b"WARC/1.1\r\nContent-Length: -3\r\n\r\n", record(b"body", 7), record(b"body", 10**15), record(b"long body", 2), b"rubbish\r\n\r\n" * 5],
)
def test_damage_is_counted_and_passed_over(damage):
    for size in (3, 10_000):
        stream, got, data = A.Stream(), [], record(b"one") + damage + record(b"two")
        for k in range(0, len(data), size):
            got += list(stream.feed(data[k : k + size]))
        got += list(stream.finish())
        assert [b for h, b in got if h is not None] == [b"one", b"two"]
        assert 0 < sum(b for h, b in got if h is None) <= len(damage)


def test_truncated_archives(spark, tmp_path):
    whole = b"".join(record(b"%d" % k * 50) for k in range(200))
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(whole[:5_000]))  # ends within a record
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(whole))
    found = A.read_archives(spark, str(tmp_path)).groupBy("type").count().collect()
    assert {r["type"]: r["count"] for r in found} == {"resource": 200 + whole[:5_000].count(b"WARC/") - 1, "damaged": 1}
    (tmp_path / "c.warc.gz").write_bytes(gzip.compress(whole)[:-30])  # its compression is cut
    assert A.read_archives(spark, str(tmp_path), tolerant=True).where("type = 'resource'").count() >= 200
    with pytest.raises(Exception, match="(?i)eof|unexpected end|corrupt"):
        A.read_archives(spark, str(tmp_path)).collect()


def test_equal_rows_beyond_a_chunk(spark, tmp_path):
    rows = [(None, "u", BIG)] * 2_300 + [(3, "u", BIG)] * 3 + [(9, None, "short")] * 1_001
    spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3).write.parquet(str(tmp_path / "pages.parquet"))
    found = A.op4_warc(spark, str(tmp_path)).groupBy("page_id", "record_type", "refers_to").count().collect()
    assert sorted(map(tuple, found), key=str) == sorted([(None, "revisit", 3, 2_300), (3, "response", None, 1), (3, "revisit", 3, 2), (9, "response", None, 1_001)], key=str)


def test_empty(spark, table, tmp_path):
    table.limit(0).write.parquet(str(tmp_path / "pages.parquet"))
    assert A.op4_warc(spark, str(tmp_path)).count() == 0
