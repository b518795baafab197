"""Scans in constant memory, files written by many tasks, snapshots."""

import gzip
import random
import threading
import time
import tracemalloc

import pytest
from pyspark.sql import functions as F

from tallowick.sources import contents, files, guide, playlist, saved


def guide_text(channels, programmes):
    yield '<?xml version="1.0"?><tv>'
    for c in range(channels):
        yield f'<channel id="c{c}"><display-name>Chan {c}</display-name><icon src="i{c}"/><icon src="x"/></channel>'
    for c in range(channels):
        for p in range(programmes):
            yield f'<programme channel="c{c}" start="202601{p // 24 + 1:02d}{p % 24:02d}0000 +0000"><title>Prog {p}</title><desc>{"x" * 200}</desc><category>a<b>c</b></category></programme>'
    yield "</tv>"


def peak_of(work):
    tracemalloc.start()
    try:
        work()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


@pytest.mark.parametrize("packed", [False, True])
def test_a_guide_is_parsed_in_constant_memory(tmp_path, packed):
    path = tmp_path / "big.xml"
    data = "".join(guide_text(200, 150)).encode()
    path.write_bytes(gzip.compress(data) if packed else data)
    seen = {"channel": 0, "programme": 0}

    def work():
        for row in guide.elements("big", contents.unpacked(contents._raw(f"file:{path}"))):
            seen[row["kind"]] += 1

    # Not a third of the file, and no more for a guide four times as long.
    peak = peak_of(work)
    assert seen == {"channel": 200, "programme": 30_000} and peak < len(data) / 3
    data = "".join(guide_text(400, 300)).encode()
    path.write_bytes(gzip.compress(data) if packed else data)
    assert peak_of(work) < 1.5 * peak + 500_000


def test_a_playlist_is_parsed_in_constant_memory():
    def parts(n):
        yield b"\xef\xbb\xbf#EXTM3U\r\n"
        for i in range(n):
            yield f'#EXTINF:-1 tvg-id="{i}",Name {i}\r\nhttp://h/{i}\r'.encode() + b"\n"

    count = []
    small, large = (peak_of(lambda n=n: count.append(sum(1 for _ in playlist.entries(contents.lines(parts(n)))))) for n in (2000, 60_000))
    assert count == [2000, 60_000] and large < 1.5 * small + 200_000


def test_lines_are_those_of_the_whole_text():
    text = "﻿a\r\nb\rc\x0bd e\n\nf\xff"
    data = text.encode()[:-2] + b"\xff\xc3"
    for size in (1, 2, 3, 1000):
        got = list(contents.lines(data[i : i + size] for i in range(0, len(data), size)))
        assert got == data.decode("utf-8-sig", "replace").splitlines()


@pytest.mark.parametrize("size", [1, 7, 1 << 20])
def test_unpacking_in_parts(size):
    cut = lambda data: b"".join(contents.unpacked(data[i : i + size] for i in range(0, len(data), size)))
    one, two = gzip.compress(b"a" * 5000), gzip.compress(b"b" * 3000)
    assert cut(one + two) == b"a" * 5000 + b"b" * 3000
    assert cut(b"plain") == b"plain" and cut(b"p") == b"p" and cut(b"") == b""
    noise = random.Random(1).randbytes(9000)
    packed = gzip.compress(noise)
    assert noise.startswith(cut(packed[:-200])) and len(cut(packed[:-200])) > 1000
    assert cut(one + b"\0\0rest") == b"a" * 5000


def test_guides_cut_short_or_wrong(spark, tmp_path):
    (tmp_path / "cut.xml").write_text('<tv><channel id="a"><display-name> A </display-name><display-name/></channel><programme channel="a" start="20260101000000"><title>x</ti')
    assert [tuple(r) for r in guide.scan(spark, f"file://{tmp_path}/cut.xml").select("kind", "guide_id", "name").collect()] == [("channel", "a", "A")]
    for name, text in (("page", "<html><p>a</html>"), ("words", "nothing"), ("half", "<tv><channel id='a'></tv>")):
        (tmp_path / name).write_text(text)
        with pytest.raises(Exception, match="is no guide"):
            guide.scan(spark, f"file://{tmp_path}/{name}").collect()


def test_one_file_of_many_tasks(spark, tmp_path):
    rows = spark.range(0, 5000, 1, 7).select(F.xxhash64("id").alias("k"), F.format_string("line %d é", "id").alias("value"))
    ordered = rows.orderBy("k")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert ordered.select("value").rdd.getNumPartitions() > 1
        for how, opened in ((None, open), ("gzip", gzip.open)):
            path = f"{tmp_path}/out/all.txt"
            files.one_file(ordered.select("value"), f"file://{path}", how)
            with opened(path, "rb") as f:
                assert f.read().decode() == "".join(r.value + "\n" for r in ordered.collect())
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    broken = rows.select(F.when(F.col("k") % 97 == 0, F.raise_error(F.lit("torn"))).otherwise(F.col("value")).alias("value"))
    with pytest.raises(Exception, match="torn"):
        files.one_file(broken, f"file://{tmp_path}/none/all.txt")
    assert not (tmp_path / "none").exists() or not list((tmp_path / "none").iterdir())


@pytest.mark.parametrize("size", [-1, 0, 1, 2 * contents.CHUNK])
def test_members_that_unpack_to_more_than_a_part_at_a_time(size):
    bodies = [b" ".join(b"%d" % i for i in range(n))[:n] for n in (contents.CHUNK + size, 1000)]
    packed = b"".join(gzip.compress(b) for b in bodies)
    for step in (len(packed), 1000):
        assert b"".join(contents.unpacked(packed[i : i + step] for i in range(0, len(packed), step))) == b"".join(bodies)


def test_named_files(spark, tmp_path):
    rows = spark.createDataFrame([("b", 2, "y"), ("a", 1, "x"), ("b", 1, "z")], "name string, at int, value string")
    files.named_files(rows, f"file://{tmp_path}/made", "list-@.txt")
    assert {p.name: p.read_text() for p in (tmp_path / "made").glob("*.txt")} == {"list-a.txt": "x\n", "list-b.txt": "z\ny\n"}


class Fetch:
    def __init__(self, spark, pause=0.0):
        self.spark, self.pause, self.made = spark, pause, []

    def __call__(self, value="x"):
        self.made.append(threading.get_ident())
        time.sleep(self.pause)
        return self.spark.createDataFrame([(value,)], "v string")


def test_concurrent_readers_make_one_fetch(spark, tmp_path):
    kept, fetch, got = saved.Snapshots(spark, f"file://{tmp_path}"), Fetch(spark, 1.0), []
    readers = [threading.Thread(target=lambda: got.append(kept.read("http://a", 60, fetch).first().v)) for _ in range(4)]
    for t in readers:
        t.start()
    for t in readers:
        t.join()
    assert got == ["x"] * 4 and len(fetch.made) == 1
    kept.read("http://b", 60, fetch)
    assert len(fetch.made) == 2  # another address is another table


def test_stale_reads_while_another_refreshes(spark, tmp_path):
    kept = saved.Snapshots(spark, f"file://{tmp_path}")
    kept.read("a", 60, lambda: Fetch(spark)("old"))
    slow = Fetch(spark, 1.5)
    other = threading.Thread(target=lambda: kept.read("a", 0, lambda: slow("new"), now=4e9))
    other.start()
    while not slow.made:
        time.sleep(0.05)
    assert kept.read("a", 0, lambda: Fetch(spark)("third"), now=4e9).first().v == "old"
    other.join()
    assert kept.read("a", 60, slow).first().v == "new"


def test_a_bad_answer_keeps_the_old_one(spark, tmp_path):
    kept = saved.Snapshots(spark, f"file://{tmp_path}")
    good = lambda rows: not rows.isEmpty()

    def fails():
        raise OSError("no answer")

    with pytest.raises(OSError, match="no answer"):
        kept.read("a", 0, fails)
    with pytest.raises(ValueError, match="no good"):
        kept.read("a", 0, lambda: Fetch(spark)().limit(0), good)
    assert kept.read("a", 0, Fetch(spark), good).first().v == "x"
    for make in (fails, lambda: Fetch(spark)("y").limit(0)):
        assert kept.read("a", 0, make, good, now=4e9).first().v == "x"
    assert kept.read("a", 0, lambda: Fetch(spark)("z"), good, now=4e9).first().v == "z"
    for i in range(3):
        kept.read("a", 0, lambda i=i: Fetch(spark)(str(i)), now=4e9)
    assert len([n for n in kept.store.names(kept.folder("a")) if n.startswith("v-")]) == 2


def test_a_refresh_given_up_is_taken_over(spark, tmp_path):
    kept = saved.Snapshots(spark, f"file://{tmp_path}", patience=0.5)
    assert kept._locked("a") and not kept._locked("a")
    time.sleep(1.6)
    assert kept.read("a", 60, Fetch(spark)).first().v == "x"
