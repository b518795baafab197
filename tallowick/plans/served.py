"""A small server of the driver for queries over remote systems: it gives out files that Spark has written."""

from __future__ import annotations

import threading
from array import array
from bisect import bisect_right
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import lru_cache
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from itertools import accumulate
from urllib.parse import parse_qs, urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@contextmanager
def serving(answer: Callable[[dict[str, str]], bytes | None], host: str = "127.0.0.1") -> Iterator[str]:
    """The address of a server that answers with ``answer`` of the query's values; None is an error of the server."""

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self) -> None:
            body = answer({k: v[-1] for k, v in parse_qs(urlsplit(self.path).query).items()})
            self.send_response(503 if body is None else 200)
            self.end_headers()
            self.wfile.write(body or b"")

        def log_message(self, *args: object) -> None:
            pass

    class Server(ThreadingHTTPServer):
        def handle_error(self, *args: object) -> None:
            """Readers may go before their answer is out."""

    server = Server((host, 0), Handler)
    thread = threading.Thread(target=server.serve_forever, daemon=True)
    thread.start()
    try:
        yield f"http://{host}:{server.server_address[1]}/"
    finally:
        server.shutdown()
        server.server_close()


def driver_host(spark: SparkSession) -> str:
    """Where tasks reach the driver."""
    return spark.conf.get("spark.driver.host", "127.0.0.1") or "127.0.0.1"


def written_file(spark: SparkSession, folder: str) -> bytes:
    """What Spark has written as the only text file of a folder, or nothing."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return b""
    out = b""
    for status in fs.listStatus(at):
        if status.getPath().getName().startswith("part-"):
            stream = fs.open(status.getPath())
            try:
                out += bytes(stream.readAllBytes())
            finally:
                stream.close()
    return out


class ServedLog:
    """A log of events (with an ``id``) in files by ranges of ids; answers with those after an id, oldest first.

    Events over ``until`` aren't there yet.  An answer opens the files that have its events, and none
    for an id at the end, whatever the log's length and the gaps between ids.
    """

    def __init__(self, events: DataFrame, folder: str, each: int = 50_000):
        spark, rows = events.sparkSession, events.filter("id is not null")
        self.until, self.parts, count = 0, [], rows.count()
        lines = F.concat_ws("\t", F.col("id").cast("string"), F.to_json(F.struct(*rows.columns)))
        parts = rows.repartitionByRange(count // each + 1, "id").select(lines.alias("value"), F.spark_partition_id().alias("part"))
        parts.write.partitionBy("part").text(folder)
        if count:
            ids = spark.read.schema("value string, part int").text(folder).select("part", F.substring_index("value", "\t", 1).cast("long").alias("id"))
            self.parts = sorted(map(tuple, ids.groupBy("part").agg(F.min("id").alias("first"), F.max("id").alias("last")).select("first", "last", "part").collect()))

        @lru_cache(maxsize=32)
        def opened(part: int) -> tuple[array, array, bytes]:
            """Ids in order, where the event of each begins, and the events, each with a comma."""
            pairs = sorted((int(i), value) for i, value in (line.split(b"\t", 1) for line in written_file(spark, f"{folder}/part={part}").split(b"\n") if line))
            return array("q", (i for i, _ in pairs)), array("q", accumulate((len(value) + 1 for _, value in pairs), initial=0)), b"".join(value + b"," for _, value in pairs)

        self.opened = opened

    def __call__(self, asked: dict[str, str]) -> bytes:
        after, left, found = int(asked["since"]), int(asked["limit"]), []
        for first, _, part in self.parts[bisect_right(self.parts, after, key=lambda x: x[1]) :]:
            if left <= 0 or first > self.until:
                break
            ids, begins, events = self.opened(part)
            at = bisect_right(ids, after)
            end = min(bisect_right(ids, self.until), at + left)
            found.append(events[begins[at] : begins[max(at, end)]])
            left -= max(0, end - at)
        return b'{"events": [' + b"".join(found)[:-1] + b"]}"
