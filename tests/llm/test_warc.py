import hashlib

import pytest

from tallowick.llm import warc
from tallowick.llm.workspace import new_path

FAKE = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:777>\r\nContent-Length: {}\r\n\r\n{}\r\n\r\n"


def rows():
    whole = FAKE.format(5, "hello")
    long = "<p>" + "x" * 300
    return [
        (1, "http://a/1", "short"), (2, "http://a/2", "short"), (3, None, None), (4, "http://a/ b\n", ""), (5, "u", long), (6, "u", long), (7, "u", long),
        (8, "u", whole), (9, "u", "before " + whole + whole + " after"), (10, "u", "WARC/1.0 and WARC/1.1\r\n\r\n" * 9), (11, "u", FAKE.format(4000, "runs on")),
        (12, "u", "é" * 200), (13, "u", "\r\n\r\n" + whole[:-4]), (14, "u", "y" * 5000), (14, "u", "y" * 5000), (None, "u", "z" * 120), (15, "u", "z" * 120),
        (16, "u", "first " * 30), (16, "u", "second one " * 40), (17, "u", "first " * 30), (18, "u", "second one " * 40), (19, "u", "long page " * 120_000), (20, "u", "long page " * 120_000),
    ]


def expected(data):
    first = {}
    for i, _, p in data:
        if i is not None and len((p or "").encode()) >= 100:
            first[p] = min(first.get(p, i), i)
    out = []
    for i, _, p in data:
        b = (p or "").encode()
        n = sum(1 for x in data if x[2] == p)
        again = p in first and n > 1 and first[p] != i
        out.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first[p] if again else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [128 << 20, 3000])
def test_round_trip_rejects_magic_in_payloads(spark, block):
    data = rows() * 1 + [(100 + i, "u", f"page {i} " * (i % 50)) for i in range(200)]
    path = new_path(spark, "warc")
    pages = spark.createDataFrame([(*r, "clash") for r in data], "page_id long, url string, html string, digest string").coalesce(2)
    warc.write_archives(pages, path)
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(block))
    try:
        got = warc.page_records(warc.read_archives(spark, path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted((tuple(r) for r in got), key=str) == expected(data)


def test_empty_table(spark):
    path = new_path(spark, "warc")
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.page_records(warc.read_archives(spark, path)).count() == 0


def test_a_file_cut_short_keeps_what_the_chain_reaches(spark, tmp_path):
    record = FAKE.format(5, "hello")
    (tmp_path / "a.warc").write_bytes((record * 3 + record[:-9]).encode())
    assert warc.read_archives(spark, f"file://{tmp_path}").filter("digest is not null").count() == 3
