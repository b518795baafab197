"""Queries of the watch list over a remote system's log whose answers lie in files: no server is started."""

import json
import re
from contextlib import contextmanager

import duckdb
import pytest
from pyspark.sql.types import StructType

from tallowick.plans import registry, served, watching
from tallowick.sources import api


@pytest.fixture
def polled(spark, tmp_path, monkeypatch):
    """``event_poll`` over rows of id and type, and its SQL."""

    def run(rows):
        spark.createDataFrame(rows, "event_id long, event_type string").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
        log = [{"id": i, "type": kind} for i, kind in rows if i is not None]
        for after in {700, *(e["id"] for e in log)}:
            (tmp_path / f"log?limit=20000&since={after}").write_text(json.dumps({"events": [e for e in log if e["id"] > after]}))

        @contextmanager
        def files(answer, host):
            yield f"file://{tmp_path}/log"

        monkeypatch.setattr(watching, "serving", files)
        got = sorted(map(tuple, watching.event_poll(spark, str(tmp_path)).collect()))
        sql = registry.ORACLES["event_poll"].replace("FROM events", f"FROM '{tmp_path}/events.parquet/*.parquet'")
        return got, sorted(duckdb.sql(sql).fetchall())

    return run


@pytest.mark.parametrize("last", ["error", "click", None])
def test_the_mark_of_polled_events_is_that_of_those_that_count(polled, last):
    got, wanted = polled([(i, ("error", "view", "click")[i % 3]) for i in range(690, 720)] + [(725, last), (None, "error")])
    assert got == wanted and len(got) > 10


@pytest.mark.parametrize("rows", [[], [(5, "error"), (700, "view")], [(-9, "error")], [(701, "click"), (702, None)]])
def test_a_log_without_events_that_count_gives_no_rows(polled, rows):
    assert polled(rows) == ([], [])


LOG = [{"id": i, "type": str(n)} for i in range(1, 200) for n in range(1 + 30 * (i == 77))]


def reader_of(monkeypatch, asked, **options):
    def fetched(url, **how):
        after, limit = (int(re.search(rf"{name}=(-?\d+)", url)[1]) for name in ("since", "limit"))
        asked.append(after)
        return {"events": [e for e in LOG if e["id"] > after][:limit]}

    monkeypatch.setattr(api, "fetch_json", fetched)
    return api.EventReader(StructType().add("id", "long").add("type", "string"), {"url": "http://h/", "since": "true", "limit": "10", "mark": "3"} | options)


def test_a_batch_of_events_has_many_answers_with_a_task_for_each(monkeypatch):
    asked = []
    reader, start, got, sizes = reader_of(monkeypatch, asked, partitions="8"), {"mark": 3}, [], []
    while (end := reader.latestOffset()) != start:
        ranges = reader.partitions(start, end)
        restarted = reader_of(monkeypatch, asked).partitions(start, end)
        for parts in (ranges, restarted):
            rows = [row for part in parts for batch in reader.read(part) for row in batch.to_pylist()]
            assert [r for r in LOG if start["mark"] < r["id"] <= end["mark"]] == rows
        got, sizes, start = got + rows, [*sizes, len(ranges)], end
    assert got == [e for e in LOG if e["id"] > 3]
    assert sizes[0] == 8 and len(sizes) < 5


def test_answers_of_a_log_open_no_file_that_they_have_no_events_of(spark, tmp_path, monkeypatch):
    opened, real = [], served.written_file
    monkeypatch.setattr(served, "written_file", lambda *a: opened.append(a) or real(*a))
    ids = [*range(-5, 40), *[40] * 25, *range(10**12, 10**12 + 50)]
    rows = [(i, None if i == 7 else f"é\n{n}") for n, i in enumerate(ids)] + [(None, "error")]
    log = served.ServedLog(spark.createDataFrame(rows, "id long, type string").repartition(3), f"file://{tmp_path}/log", each=10)
    whole = sorted(({"id": i} | ({"type": kind} if kind else {}) for i, kind in rows if i is not None), key=lambda e: (e["id"], e.get("type", "")))

    def answer(after, limit):
        return json.loads(log({"since": str(after), "limit": str(limit)}))["events"]

    for log.until in (20, 10**12 + 7, 10**13):
        shown = [e for e in whole if e["id"] <= log.until]
        for after in (-9, 3, 20, 39, 40, 41, 10**12 + 7, 10**13):
            for limit in (1, 12, 1000):
                wanted = [e for e in shown if e["id"] > after][:limit]
                got = answer(after, limit)
                assert [e["id"] for e in got] == [e["id"] for e in wanted]
            assert sorted(map(str, got)) == sorted(map(str, wanted))  # not cut
    log.until = 20
    opened.clear()
    assert answer(20, 10) == [] and len(opened) <= 1
    log.until = 10**13
    assert answer(10**13, 10) == [] and len(opened) <= 1
    assert len(log.parts) > 5
