"""Pages and events of a remote system, served by a server of the test's own."""

import json
import threading
import time

import pytest

from tallowick.plans.served import serving
from tallowick.sources import api, http
from tallowick.sources.contents import contents


class Listing:
    """Rows in pages; some pages fail so many times first."""

    def __init__(self, rows, counted=False, bare=False, fails=None, most=7):
        self.rows, self.counted, self.bare, self.fails, self.most, self.asked, self.lock = rows, counted, bare, dict(fails or {}), most, [], threading.Lock()

    def __call__(self, asked):
        page, size = int(asked["page"]), min(self.most, int(asked["page_size"]))
        with self.lock:
            self.asked.append(page)
            if self.fails.get(page):
                self.fails[page] -= 1
                return None
        if self.bare:
            return json.dumps(self.rows).encode()
        own = self.rows[(page - 1) * size : page * size]
        return json.dumps({"results": own, "next": "x" if page * size < len(self.rows) else None} | ({"count": len(self.rows)} if self.counted else {})).encode()


def pages(spark, url, **options):
    reader = api.register(spark).read.format("tallowick_pages").schema("id long, name string, ok boolean").option("url", url).option("pause", 0.01)
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load()


ROWS = [{"id": i, "name": None if i % 5 == 0 else f"n{i}", "ok": i % 2 == 0, "other": [1]} for i in range(61)]


@pytest.mark.parametrize(("counted", "tasks"), [(True, 9), (False, 1)])
def test_pages_are_dealt_out_or_followed(spark, counted, tasks):
    listing = Listing(ROWS, counted, fails={1: 1, 3: 2, 9: 1})
    with serving(listing) as url:
        rows = pages(spark, url, pageSize=7)
        assert rows.rdd.getNumPartitions() == tasks
        assert sorted((r.id, r.name, r.ok) for r in rows.collect()) == [(r["id"], r["name"], r["ok"]) for r in ROWS]
    assert max(listing.asked) == 9  # none beyond the last one


def test_servers_may_give_fewer_rows_a_page_than_asked_for(spark):
    with serving(Listing(ROWS, counted=True, most=4)) as url:
        assert pages(spark, url, pageSize=1000, partitions=3).count() == len(ROWS)


def test_bare_lists_and_empty_answers(spark):
    with serving(Listing(ROWS, bare=True)) as url:
        assert pages(spark, url).count() == len(ROWS)
    with serving(Listing([])) as url:
        assert pages(spark, url).count() == 0
    with serving(lambda asked: b"") as url:
        assert pages(spark, url).count() == 0


def test_values_of_other_types_are_fitted_or_null(spark):
    rows = [{"id": "7", "name": 5, "ok": "yes"}, {"id": "x", "name": True}]
    with serving(Listing(rows)) as url:
        assert [tuple(r) for r in pages(spark, url).collect()] == [(7, "5", None), (None, "true", None)]


def test_a_page_that_goes_on_failing_is_told(spark):
    with serving(Listing(ROWS, fails={2: 99})) as url, pytest.raises(Exception, match="the server failed \\(503\\), 2 times"):
        pages(spark, f"{url}?token=abc", pageSize=7, attempts=2).collect()


def test_fetch_waits_as_told_limits_sizes_and_hides_logins():
    import urllib.error
    from email.message import Message
    from io import BytesIO

    def refused(header, body):
        headers = Message()
        if header:
            headers["Retry-After"] = header
        return urllib.error.HTTPError("http://h", 429, "", headers, BytesIO(body))

    assert http._wait(refused("7", b""), 1.0) == 7.0
    assert http._wait(refused(None, b'{"detail": "Expected available in 18 seconds."}'), 1.0) == 19.0
    assert http._wait(refused(None, b"?"), 2.5) == 2.5
    waits = []
    with serving(lambda asked: None) as url, pytest.raises(http.FetchError, match="the server failed"):
        http.fetch(url, attempts=3, sleep=waits.append)
    assert waits == [1.0, 2.0]
    with serving(lambda asked: b"x" * 100) as url:
        with pytest.raises(http.FetchError, match="over 99 bytes"):
            http.fetch(url, most=99)
        assert http.fetch(url, most=100) == b"x" * 100
    with pytest.raises(http.FetchError) as error:
        http.fetch("http://user:secret@127.0.0.1:1/list?password=secret", attempts=1)
    assert "secret" not in str(error.value) and "127.0.0.1:1/list" in str(error.value)
    with serving(lambda asked: b"<html>") as url, pytest.raises(http.FetchError, match="no JSON"):
        http.fetch_json(url)


def test_contents_over_http_are_limited_and_tried_again(spark):
    answers = [None, b"#EXTM3U"]
    with serving(lambda asked: answers.pop(0)) as url:
        assert bytes(contents(spark, url).first().content) == b"#EXTM3U"


def poll(spark, url, folder, since):
    stream = api.register(spark).readStream.format("tallowick_events").schema("id long, type string").option("url", url).option("since", since).option("limit", 10).option("mark", 3).load()

    def add(batch, number):
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", f"{folder}/state").trigger(processingTime="0 seconds").start()


def mark_of(folder):
    names = sorted(int(p.name) for p in (folder / "state" / "commits").glob("[0-9]*"))
    return json.loads((folder / "state" / "offsets" / str(names[-1])).read_text().splitlines()[-1])["mark"] if names else 3


def wait_for(run, folder, mark):
    until = time.time() + 120
    while mark_of(folder) < mark:
        assert time.time() < until and not run.exception(), (mark_of(folder), run.exception())
        time.sleep(0.1)


@pytest.mark.parametrize("since", ["true", "false"])
def test_events_are_polled_once_each_over_restarts(spark, tmp_path, since):
    log = [{"id": i, "type": "channel_error" if i % 3 else "other"} for i in range(1, 24)]

    def answer(asked):
        rows = [e for e in log if e["id"] > int(asked["since"])][: int(asked["limit"])] if since == "true" else log[-int(asked["limit"]) :]
        return json.dumps({"events": rows}).encode()

    with serving(answer) as url:
        run = poll(spark, url, tmp_path, since)
        wait_for(run, tmp_path, 23)
        run.stop()
        log.extend({"id": i, "type": "other"} for i in range(24, 30))  # nothing that counts, yet the mark moves on
        run = poll(spark, url, tmp_path, since)
        wait_for(run, tmp_path, 29)
        log.append({"id": 35, "type": "channel_error"})
        wait_for(run, tmp_path, 35)
        run.stop()
    got = sorted(r.id for r in spark.read.schema("id long, type string").parquet(f"{tmp_path}/out/batch=*").collect())
    first = 4 if since == "true" else 14  # a log that gives its newest ten has lost the rest
    assert got == [*range(first, 30), 35]


@pytest.mark.parametrize("copies", [3, 25])
def test_events_of_one_id_are_all_polled(spark, tmp_path, copies):
    log = [{"id": i, "type": str(n)} for i in range(1, 8) for n in range(copies)]

    def answer(asked):
        return json.dumps({"events": [e for e in log if e["id"] > int(asked["since"])][: int(asked["limit"])]}).encode()

    with serving(answer) as url:
        run = poll(spark, url, tmp_path, "true")
        wait_for(run, tmp_path, 7)
        run.stop()
    got = sorted((r.id, r.type) for r in spark.read.schema("id long, type string").parquet(f"{tmp_path}/out/batch=*").collect())
    assert got == sorted((i, str(n)) for i in range(4, 8) for n in range(copies))


def test_the_listing_s_files_hold_many_pages(spark, tmp_path, monkeypatch):
    from tallowick.plans import sources

    opened, real = [], sources.written_file
    monkeypatch.setattr(sources, "written_file", lambda *a: opened.append(a) or real(*a))
    spark.range(2950).selectExpr("id as c_custkey", "concat('a\t', id) as c_name").write.parquet(f"{tmp_path}/customer.parquet")
    rows = sorted((r.how, r.id, r.name) for r in sources.paged_scan(spark, str(tmp_path)).collect())
    assert rows == sorted((how, i, f"a\t{i}") for how in ("counted", "linked") for i in range(2950))
    assert len(opened) < 30  # of thirty pages, each asked for twice
