"""WARC archives against plain Python: what is read back, the framing of members, broken files."""

import base64
import glob
import gzip
import hashlib
import io
import zlib

import duckdb
import pytest

from tidewatch.llm import warc
from tidewatch.llm.queries import QUERIES, SQL, importable
from tidewatch.session import scratch_path

COLUMNS = "page_id long, url string, html string, digest string, holder long, payload string"


def odd_pages():
    html = ["<p>one</p>", "", None, "<p>é\U0001f600</p>\r\n\r\nWARC/1.1\r\n", "x" * 300_000, "<p>one</p>\n", "\x00\x01"]
    urls = ["http://a.example/x y", None, "", "http://b.example/é\r\nWARC-Type: bad", "http://c.example/?q=a&b=%20#f"]
    rows = [(i, urls[i % 5], html[i % 7]) for i in range(60)]
    rows += [(1000 + i, "http://d.example", f"<p>{i}</p>" * 50) for i in range(40)]
    rows += [(None, "http://e.example", "<p>one</p>"), (-5, None, "<p>own</p>"), rows[3], rows[45]]
    return rows


def brute(rows, min_bytes=0):
    known = [(i, (h or "").encode()) for i, _, h in rows if i is not None]
    newest = {}
    for i, payload in known:
        newest[payload] = max(newest.get(payload, i), i)
    out = []
    for i, payload in known:
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        refers = newest[payload] if newest[payload] != i and len(payload) >= min_bytes else None
        out.append((i, len(payload), digest, "response" if refers is None else "revisit", refers))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def pages(spark):
    rows = odd_pages()
    return rows, importable(spark).createDataFrame([(*r, "d", 4, "p") for r in rows], COLUMNS).repartition(4)


def figures(df):
    return sorted([tuple(r) for r in df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()], key=str)


@pytest.mark.parametrize("broadcast", [100_000, 0])
@pytest.mark.parametrize("min_bytes", [0, 5])
def test_round_trip(spark, pages, monkeypatch, broadcast, min_bytes):
    rows, table = pages
    monkeypatch.setattr(warc, "MAX_BROADCAST", broadcast)
    monkeypatch.setattr(warc, "FILE_BYTES", 200_000)
    folder = scratch_path(spark, "test-archives")
    found = warc.read_archives(warc.archive(table, folder, min_bytes), f"{folder}/members", with_payloads=True)
    assert figures(found) == brute(rows, min_bytes)
    texts = {i: (h or "").encode() for i, _, h in rows if i is not None}
    responses = [r for r in found.collect() if r["record_type"] == "response"]
    assert responses and all(bytes(r["payload"]) == texts[r["page_id"]] for r in responses)


def test_members_stand_alone(spark, pages):
    rows, table = pages
    folder = scratch_path(spark, "test-archives")
    warc.archive(table, folder)
    place = folder.removeprefix("file:")
    assert not glob.glob(f"{place}/monolithic")
    seen = 0
    for path in glob.glob(f"{place}/members/*.warc.gz"):
        raw, at = open(path, "rb").read(), 0
        for line in open(f"{path}.idx"):
            offset, length, kind, name = line.rstrip("\n").split(" ", 3)
            assert int(offset) == at
            text = gzip.decompress(raw[at : at + int(length)])
            assert text.startswith(b"WARC/1.1\r\nWARC-Type: " + kind.encode() + b"\r\n") and text.endswith(b"\r\n\r\n")
            assert text.count(b"\r\nWARC-Record-ID: " + name.encode()) == 1
            at, seen = at + int(length), seen + 1
        assert at == len(raw)
    assert seen == sum(r[0] is not None for r in rows)


def test_one_record_by_its_id(spark, pages):
    _, table = pages
    folder = scratch_path(spark, "test-archives")
    names = [r["file"] for r in warc.archive(table, folder).select("file").distinct().collect()]
    found = []
    for name in names:
        try:
            found.append(warc.read_record(f"{folder}/members", name, warc.record_id(-5)))
        except KeyError:
            pass
    (fields, payload), = found
    assert payload == b"<p>own</p>" and fields["warc-target-uri"] == "urn:page:-5"


def stream(parts, members=1):
    """Some records as one gzip member, or as many."""
    whole = b"".join(parts)
    cuts = [len(whole) * k // members for k in range(members + 1)]
    return b"".join(gzip.compress(whole[a:b]) for a, b in zip(cuts, cuts[1:]))


@pytest.mark.parametrize("members", [1, 2, 7])
def test_normaliser_reads_any_framing(members, monkeypatch):
    monkeypatch.setattr(warc, "PIECE", 64)
    records = [b"".join(warc.record(k, b"http://x", b"z" * (k * 37), "D", None)) for k in range(20)]
    got = [zlib.decompress(b"".join(parts), warc.GZIP) for _, parts in warc.members(io.BytesIO(stream(records, members)))]
    assert got == records


def test_broken_archives_are_reported():
    records = [b"".join(warc.record(k, None, b"z" * 900, "D", None)) for k in range(3)]
    whole = stream(records)
    for broken in (whole[: len(whole) // 2], stream([b"".join(records)[:-500]]), stream([b"".join(records) + b"WARC/1.1\r\n"])):
        with pytest.raises(EOFError):
            for _, parts in warc.members(io.BytesIO(broken)):
                b"".join(parts)


def test_empty_table(spark):
    empty = importable(spark).createDataFrame([], COLUMNS)
    folder = scratch_path(spark, "test-archives")
    assert warc.read_archives(warc.archive(empty, folder), f"{folder}/members").collect() == []


def test_query_and_twin(spark, tmp_path):
    rows = odd_pages()
    path = str(tmp_path / "pages.parquet")
    importable(spark).createDataFrame(rows, "page_id long, url string, html string").coalesce(2).write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{path}/*.parquet'")
    found, expected = QUERIES["op12_page_archives"](spark, str(tmp_path)), con.sql(SQL["op12_page_archives"])
    assert found.columns == expected.columns
    assert figures(found) == brute(rows) == sorted(expected.fetchall(), key=str)
