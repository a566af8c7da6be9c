import hashlib
import random

import pytest

from mediaquarry.llm import warc


def page_rows(spark, rows):
    from pyspark.sql import functions as F

    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    return table.withColumns({c: F.lit(1) for c in ("digest", "path", "records", "refers_to", "first_id", "name", "content", "origin")})


def brute(rows):
    first = {}
    for i, _, html in rows:
        p = (html or "").encode()
        if len(p) >= 100 and i is not None:
            first[p] = min(i, first.get(p, i))
    counts = {}
    for _, _, html in rows:
        counts[html or ""] = counts.get(html or "", 0) + 1
    out = []
    for i, _, html in rows:
        p = (html or "").encode()
        f = first.get(p) if counts[html or ""] > 1 else None
        again = f is not None and f != i
        out.append((i, len(p), hashlib.sha256(p).hexdigest(), "revisit" if again else "response", f if again else None))
    return sorted(out, key=str)


ROWS = [
    (1, "http://a/1", "x" * 99), (2, "http://a/2", "x" * 99), (3, "http://a/3", "y" * 100), (4, "http://a/4", "y" * 100), (5, None, "y" * 100), (6, "http://a/ü\r\nz", None),
    (7, "", ""), (8, "http://b", "é\r\n0\r\n\r\n" * 5000), (8, "http://b", "é\r\n0\r\n\r\n" * 5000), (None, "n", "z" * 200), (10, "n", "z" * 200), (11, "q", "WARC/1.1\r\n\r\n"), (12, "big", "long " * 40_000),
]


def run(table, **options):
    return sorted((tuple(r) for r in warc.warc_round_trip(table, **options).collect()), key=str)


def test_round_trip(spark):
    assert run(page_rows(spark, ROWS)) == brute(ROWS)
    assert run(page_rows(spark, ROWS), chunk_bytes=7, segment_bytes=150, file_bytes=500) == brute(ROWS)


def test_empty_table(spark):
    assert run(page_rows(spark, [])) == []


def test_payloads_come_back(spark):
    files = warc.write_archives(page_rows(spark, ROWS[7:8]), segment_bytes=1000)
    assert bytes(warc.read_archives(spark, files, with_payload=True).first().payload).decode() == ROWS[7][2]


def test_chunks_and_segments_of_random_sizes():
    r = random.Random(1)
    for _ in range(200):
        data = r.randbytes(r.randint(0, 300))
        assert warc.dechunked(warc.chunked(data, r.randint(1, 50))) == data
        block, size = data or b"x", r.randint(1, 60)
        cut = [block[i : i + size] for i in range(0, len(block), size)]
        parts = [(n, len(block) if n == len(cut) else None, p) for n, p in enumerate(cut, 1)]
        r.shuffle(parts)
        assert warc.reassembled(parts) == block
        if len(parts) > 1:
            with pytest.raises(warc.BrokenRecord):
                warc.reassembled(parts[1:])
    assert warc.dechunked(b"3;ext=1\r\nabc\r\n0\r\nTrailer: x\r\n\r\n") == b"abc"
    for bad in (b"", b"zz\r\n", b"5\r\nab\r\n0\r\n\r\n"):
        with pytest.raises(warc.BrokenRecord):
            warc.dechunked(bad)
    with pytest.raises(warc.BrokenRecord):
        warc.reassembled([(1, None, b"ab"), (2, 5, b"c")])


def test_broken_archives_are_reported(spark):
    import zlib

    def packed(data):
        c = zlib.compressobj(1, zlib.DEFLATED, 31)
        return c.compress(data) + c.flush()

    with pytest.raises(warc.BrokenRecord):
        list(warc.members(packed(b"abc")[:-4]))
    assert list(warc.members(packed(b"a") + packed(b"b"))) == [b"a", b"b"]


def test_foreign_and_cut_off_archives_are_rows_with_an_error(spark, tmp_path):
    import gzip

    def packed(*records):
        return b"".join(gzip.compress(r) for r in records)

    shared = {"WARC-Record-ID": "<a>", "X-Page-Id": 1}
    http = b"HTTP/1.1 200 OK\r\n\r\n"
    whole = packed(warc.record("response", shared, http + b"one"), warc.record("response", shared | {"WARC-Record-ID": "<b>", "X-Page-Id": 2}, http + b"two"))
    archives = {
        "whole": whole, "cut": whole[:-9], "text": b"no archive at all", "empty": b"", "odd": packed(b"GET / HTTP/1.1\r\n\r\n"),
        "number": packed(warc.record("response", {"WARC-Record-ID": "<c>", "X-Page-Id": "x"}, b"")), "length": packed(b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: many\r\n\r\n"),
        "nameless": packed(warc.record("response", {"X-Page-Id": 3}, b"")), "bytes": packed(b"WARC/1.1\r\nWARC-Type: \xff\r\nContent-Length: 0\r\n\r\n"),
        "missing": packed(warc.record("continuation", {"WARC-Record-ID": "<d>", "WARC-Segment-Origin-ID": "<e>", "WARC-Segment-Number": 2, "WARC-Segment-Total-Length": 9}, b"x")),
    }
    want = {
        "whole": [(1, None, 3), (2, None, 3)], "cut": [(None, "an archive is cut off", None), (1, None, 3)], "text": [(None, "not an archive of gzip members", None)], "empty": [],
        "odd": [(None, "not a WARC record", None)], "number": [(None, "a number in a record's head is none", None)], "length": [(None, "a record has no length", None)],
        "nameless": [(None, "a record has no id", None)], "bytes": [],
    }
    for name, data in archives.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / f"{name}.warc.gz").write_bytes(data)
        files = spark.createDataFrame([(f"file://{tmp_path}/{name}/{name}.warc.gz",)], "path string")
        got = sorted(((r.page_id, r.error, r.payload_bytes) for r in warc.read_archives(spark, files).collect()), key=str)
        if name == "missing":
            assert len(got) == 1 and got[0][1] and got[0][2] is None
        else:
            assert got == sorted(want[name], key=str), name
