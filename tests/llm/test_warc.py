import base64
import gzip
import hashlib

import pytest

from cohortwise.llm import warc


def expected(rows, least=0):
    first = {}
    for page, _, html in rows:
        body = (html or "").encode()
        if page is not None and len(body) >= least:
            first[body] = min(first.get(body, page), page)
    out = []
    for page, _, html in rows:
        body = (html or "").encode()
        at = first.get(body)
        again = at is not None and page != at
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        out.append((page, len(body), digest, "revisit" if again else "response", at if again else None))
    return sorted(out, key=str)


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, payload string")


def read(df):
    return sorted(
        ((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()), key=str
    )


ROWS = [
    (5, "http://a/é?x=%20\r\nWARC-Type: bad", "<p>ünï</p>"),
    (3, None, "<p>ünï</p>"),
    (9, "u", None),
    (2, "u", ""),
    (None, "u", ""),
    (None, "v", "alone"),
    (7, "w", "\r\n\r\n" * 9),
    (8, "w", "WARC/1.1\r\n\r\n\x00\x00"),
    (8, "w", "WARC/1.1\r\n\r\n\x00\x00"),
    (11, "long", "ab\x00" * 7_000_000),
]


def test_round_trip(spark):
    df = warc.round_trip(pages(spark, ROWS))
    assert read(df) == expected(ROWS)
    got = {(r.page_id, r.url): r for r in df.collect()}
    assert got[5, ROWS[0][1]].record_type == "revisit" and got[5, ROWS[0][1]].payload is None
    assert bytes(got[11, "long"].payload) == ROWS[-1][2].encode()
    assert got[3, None].payload.decode() == "<p>ünï</p>"


def test_least_payload(spark):
    assert read(warc.round_trip(pages(spark, ROWS), least_payload=1)) == expected(ROWS, 1)


def test_no_pages(spark):
    assert read(warc.round_trip(pages(spark, []))) == []


def test_whole_table(spark, small_dir):
    df = spark.read.parquet(f"{small_dir}/pages.parquet")
    rows = [(r.page_id, r.url, r.html) for r in df.collect()]
    assert read(warc.round_trip(df)) == expected(rows)


def test_archives_are_plain_gzip(spark, tmp_path):
    path = str(tmp_path / "archives")
    warc.write_archives(pages(spark, ROWS[:4]).coalesce(1), path)
    (file,) = [p for p in (tmp_path / "archives").iterdir() if p.name.startswith("part-")]
    plain = gzip.decompress(file.read_bytes())
    assert plain.count(b"WARC/1.1\r\n") == 4 and plain.endswith(b"\r\n\r\n")


def test_damage_is_found():
    good = warc.member(1, "u", b"payload", None, False)
    assert [r.payload for r in warc.records(good + good)] == [b"payload"] * 2
    plain = gzip.decompress(good)
    for bad in (
        good[:-9],
        gzip.compress(plain.replace(b"payload\r", b"pay1oad\r")),
        gzip.compress(plain + b"x"),
        gzip.compress(plain[:-4]),
        gzip.compress(b"hello\r\n\r\n"),
        good + b"garbage",
    ):
        with pytest.raises(warc.ArchiveError):
            list(warc.records(bad))
