"""Data sources over the JSON interface of a remote system: pages of a listing, and its log of events as a stream.

``register`` makes them formats of a session: ``tallowick_pages`` and ``tallowick_events``.
Both need a schema, whose fields are taken from the answers' objects; others are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from datetime import datetime, timezone
from typing import Any

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import BooleanType, DataType, FractionalType, IntegralType, StringType, StructType, TimestampType

from tallowick.sources.http import ATTEMPTS, MOST_BYTES, PAUSE, fetch_json


def register(spark: SparkSession) -> SparkSession:
    spark.dataSource.register(Pages)
    spark.dataSource.register(Events)
    return spark


def _value(value: Any, kind: DataType) -> Any:
    """A JSON value as its field's type has it; null where it is none of that type."""
    try:
        if value is None:
            return None
        if isinstance(kind, StringType):
            return value if isinstance(value, str) else str(value).lower() if isinstance(value, bool) else str(value)
        if isinstance(kind, BooleanType):
            return value if isinstance(value, bool) else None
        if isinstance(kind, IntegralType):
            return int(value)
        if isinstance(kind, FractionalType):
            return float(value)
        if isinstance(kind, TimestampType):
            at = datetime.fromisoformat(value)
            return at if at.tzinfo else at.replace(tzinfo=timezone.utc)
        return value
    except (TypeError, ValueError):
        return None


def _batch(rows: list[dict], schema: StructType) -> pa.RecordBatch:
    from pyspark.sql.pandas.types import to_arrow_schema

    kinds = to_arrow_schema(schema)
    columns = [pa.array([_value(r.get(f.name), f.dataType) for r in rows], kinds.field(i).type) for i, f in enumerate(schema.fields)]
    return pa.RecordBatch.from_arrays(columns, schema=kinds)


def _how(options: dict[str, str]) -> dict[str, Any]:
    how: dict[str, Any] = {"timeout": float(options.get("timeout", 60)), "attempts": int(options.get("attempts", ATTEMPTS)), "pause": float(options.get("pause", PAUSE)), "most": int(options.get("mostBytes", MOST_BYTES))}
    if options.get("authorization"):
        how["headers"] = {"Authorization": options["authorization"]}
    return how


def _with(url: str, **values: Any) -> str:
    return url + ("&" if "?" in url else "?") + "&".join(f"{k}={v}" for k, v in values.items())


@dataclass
class PageRange(InputPartition):
    """Pages from ``first`` on: up to ``last``, or as long as the answers name a next one."""

    first: int
    last: int | None = None


class Pages(DataSource):
    """A listing in pages (``url``): objects with ``results`` and ``next``, or a bare list, which is all there is.

    Where the first answer has the ``count`` of all rows, pages are dealt out to at most
    ``partitions`` tasks; else one task goes from page to page and asks for the next
    one while it hands out the last (``pageSize`` rows each).  A page that fails is tried again.
    """

    @classmethod
    def name(cls) -> str:
        return "tallowick_pages"

    def reader(self, schema: StructType) -> DataSourceReader:
        return PageReader(schema, dict(self.options))


class PageReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]):
        self.schema, self.options = schema, options
        self.url, self.size = options["url"], int(options.get("pagesize") or options.get("pageSize") or 1000)

    def _page(self, number: int) -> tuple[list[dict], bool, int | None]:
        """Rows, whether there is a next page, and the number of all rows if the answer has it."""
        answer = fetch_json(_with(self.url, page_size=self.size, page=number), **_how(self.options))
        if isinstance(answer, dict):
            count = answer.get("count")
            return answer.get("results") or [], bool(answer.get("next")), count if isinstance(count, int) else None
        return answer or [], False, None

    def partitions(self) -> list[InputPartition]:
        rows, more, count = self._page(1)
        if not more or not rows or count is None:
            return [PageRange(1, None if more else 1)]
        # Servers may give fewer rows a page than asked for.
        pages = math.ceil(count / len(rows))
        each = math.ceil(pages / max(1, int(self.options.get("partitions", 64))))
        return [PageRange(i, min(pages, i + each - 1)) for i in range(1, pages + 1, each)]

    def read(self, partition: PageRange) -> Iterator[pa.RecordBatch]:
        with ThreadPoolExecutor(1) as ahead:
            number, coming = partition.first, ahead.submit(self._page, partition.first)
            while coming:
                rows, more, _ = coming.result()
                going = rows and (number < partition.last if partition.last else more)
                number += 1
                coming = ahead.submit(self._page, number) if going else None
                if rows:
                    yield _batch(rows, self.schema)


@dataclass
class EventRange(InputPartition):
    """Events with an id over ``after``, up to ``until``."""

    after: int
    until: int


class Events(DataSource):
    """A log of events (``url``, answers with ``events`` or a bare list, each with an ``id``) as a stream.

    The offset is the largest id seen, and moves on whatever the events are.  It lives in the
    checkpoint of the stream's query, so a restart neither loses nor repeats events that the
    log still has.  ``mark`` is the id to begin after.  A log that takes ``since`` (option
    ``since=true``) is asked for what came after an id, ``limit`` events at a time, oldest
    first; other logs give their newest ``limit`` events.  Several events may have one id:
    where an answer is full, its last id waits for the next one, which has all of them.
    A batch has up to ``partitions`` answers, each read by a task of its own.
    """

    @classmethod
    def name(cls) -> str:
        return "tallowick_events"

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return EventReader(schema, dict(self.options))


class EventReader(DataSourceStreamReader):
    def __init__(self, schema: StructType, options: dict[str, str]):
        self.schema, self.options = schema, options
        self.url, self.limit = options["url"], int(options.get("limit", 1000))
        self.since = str(options.get("since", "")).lower() == "true"
        self.most = max(1, int(options.get("partitions", 64)))
        self.mark: int | None = None
        self.cuts: list[int] = []

    def _answer(self, after: int, limit: int) -> list[dict]:
        answer = fetch_json(_with(self.url, limit=limit, **({"since": after} if self.since else {})), **_how(self.options))
        return (answer or {}).get("events") or [] if isinstance(answer, dict) else answer or []

    def _events(self, after: int) -> tuple[list[dict], bool]:
        """The next events, and whether the log has more of them."""
        limit = self.limit
        while True:
            found = self._answer(after, limit)
            full = self.since and len(found) >= limit
            found = sorted((e for e in found if (e.get("id") or 0) > after), key=lambda e: e["id"])
            whole = [e for e in found if e["id"] < found[-1]["id"]] if full else found
            if whole or not found:
                return whole, full and bool(whole)
            limit *= 2

    def initialOffset(self) -> dict:
        return {"mark": int(self.options.get("mark", 0))}

    def latestOffset(self) -> dict:
        """The newest event's id; of a log that is asked by ``since``, the last one of the next answers."""
        self.cuts, more = [self.initialOffset()["mark"] if self.mark is None else self.mark], True
        while more and len(self.cuts) <= self.most:
            events, more = self._events(self.cuts[-1])
            self.cuts += [e["id"] for e in events[-1:]]
        self.mark = self.cuts[-1]
        return {"mark": self.mark}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        """A range for each answer; after a restart, where they aren't known, one for all."""
        self.mark = max(self.mark or 0, end["mark"])
        ends = [*(x for x in self.cuts if start["mark"] < x < end["mark"]), end["mark"]]
        return [EventRange(*x) for x in zip([start["mark"], *ends], ends)]

    def read(self, partition: EventRange) -> Iterator[pa.RecordBatch]:
        after = partition.after
        while after < partition.until:
            events = [e for e in self._events(after)[0] if e["id"] <= partition.until]
            if events:
                yield _batch(events, self.schema)
            if not self.since or not events:
                break
            after = events[-1]["id"]

    def commit(self, end: dict) -> None:
        """Nothing is kept here: the query's checkpoint has the mark."""
