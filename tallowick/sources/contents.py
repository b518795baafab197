"""Files and answers over HTTP as streams of bytes inside tasks, unpacked where their first bytes say gzip."""

from __future__ import annotations

import io
import urllib.request
import zlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.utils import AnalysisException

from tallowick.sources.http import fetch

GZIP = b"\x1f\x8b"
CHUNK = 1 << 18
#: stores that tasks read piece by piece; of others Spark hands over whole files
STREAMED = ("file", "hdfs", "s3", "s3a", "gs")


def _raw(address: str) -> Iterator[bytes]:
    scheme = address.split(":", 1)[0]
    if scheme == "file":
        opened = open(urllib.request.url2pathname(address.removeprefix("file:").removeprefix("//") or "/"), "rb")  # noqa: SIM115
    else:
        from pyarrow.fs import FileSystem

        store, path = FileSystem.from_uri(address.replace("s3a:", "s3:", 1))
        opened = store.open_input_stream(path)
    with opened:
        while part := opened.read(CHUNK):
            yield part


def unpacked(parts: Iterable[bytes]) -> Iterator[bytes]:
    """The parts of a file, or what is packed in its gzip members; a file cut short gives what there is."""
    member, plain, head = None, None, b""  # plain: None until the first two bytes are there
    for part in parts:
        while part or head:
            if member is None and not plain:
                head, part = head + part, b""
                if len(head) < 2:
                    break
                if head[:2] != GZIP and plain is False:
                    return  # behind the last member
                plain = head[:2] != GZIP
                member = None if plain else zlib.decompressobj(31)
                head, part = b"", head
            if plain:
                yield part
                break
            out = None
            # Behind a member's end its unconsumed tail is the next member's, and mustn't be given to it again.
            while not member.eof and (out is None or part or len(out) == CHUNK):
                out = member.decompress(part, CHUNK)
                part = member.unconsumed_tail
                if out:
                    yield out
            part = member.unused_data if member.eof else b""
            member = None if member.eof else member
    if head and plain is None:
        yield head


def _cut(content: bytes) -> Iterator[bytes]:
    view = memoryview(content)
    for i in range(0, len(view), CHUNK):
        yield bytes(view[i : i + CHUNK])


def lines(parts: Iterable[bytes]) -> Iterator[str]:
    """The lines of a text in UTF-8, whatever ends them; undecodable bytes are replaced."""

    class Parts(io.RawIOBase):
        def __init__(self) -> None:
            self.rest, self.more = b"", iter(parts)

        def readable(self) -> bool:
            return True

        def readinto(self, into: memoryview) -> int:
            self.rest = self.rest or next(self.more, b"")
            n = min(len(into), len(self.rest))
            into[:n], self.rest = self.rest[:n], self.rest[n:]
            return n

    for line in io.TextIOWrapper(io.BufferedReader(Parts()), encoding="utf-8-sig", errors="replace", newline=None):
        yield from line.splitlines()


def over_files(spark: SparkSession, path: str, read: Callable[[str, Iterator[bytes]], Iterator[pa.RecordBatch]], schema: str, timeout: int = 60) -> DataFrame:
    """The batches that ``read`` makes of the address and the unpacked parts of each file at ``path``, or of the answer to an HTTP address.

    A file is one task's work, and what the task holds is ``read``'s matter: its parts come in pieces of
    at most a few hundred kilobytes.  Answers are limited in size and asked for again (``http.fetch``).
    """
    if path.startswith(("http://", "https://")):
        files = spark.createDataFrame([(path, None)], "path string, content binary")
    else:
        try:
            found = spark.read.format("binaryFile").load(path)
            first = found.select("path").first()
        except AnalysisException as e:
            raise ValueError(f"can't read {path}: no such file or folder") from e
        whole = first is not None and first[0].split(":", 1)[0] not in STREAMED
        files = found.selectExpr("path", "content" if whole else "cast(null as binary) as content")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                name, content = batch.column("path")[i].as_py(), batch.column("content")[i].as_py()
                if name.startswith(("http://", "https://")):
                    content = fetch(name, timeout=timeout)
                yield from read(name, unpacked(_raw(name) if content is None else _cut(content)))

    return files.mapInArrow(each, schema)


def contents(spark: SparkSession, path: str, timeout: int = 60) -> DataFrame:
    """``path, content``: whole files, for answers of a moderate size."""

    def whole(name: str, parts: Iterator[bytes]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([b"".join(parts)], pa.binary())], ["path", "content"])

    return over_files(spark, path, whole, "path string, content binary", timeout)
