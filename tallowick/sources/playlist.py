"""Playlists: reading ``#EXTM3U`` files and writing them.

A file is one task's work, read line by line: entries depend on the lines before them, back to
the last entry.  What a task holds doesn't grow with the file.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallowick.sources.contents import lines, over_files

SCHEMA = "file string, src_pos long, id string, name string, url string, group string, logo string, tvg_id string, attrs map<string,string>"
# How an attribute and an address are written in playlists.
_ATTRIBUTE = re.compile(r"""([A-Za-z0-9_-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s,]+))""")
_URL = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*://|/")


def looks_like_playlist(text: str) -> bool:
    return text[:4096].lstrip("﻿ \t\r\n").upper().startswith("#EXTM3U")


def entries(lines: Iterable[str]) -> Iterator[dict]:
    """The streams of a playlist's lines in order.

    The title follows the first comma of an ``#EXTINF`` line, even one within quotes; a
    line that is no URL drops what the lines before it announced.
    """
    title, attrs, group = "", {}, ""
    for line in (x.strip().lstrip("\ufeff") for x in lines):
        if not line:
            continue
        if line.startswith("#"):
            what, _, rest = line.partition(":")
            if what.upper() == "#EXTINF":
                head, _, title = rest.partition(",")
                title = title.strip()
                attrs = {m[1].lower(): next(v for v in (m[2], m[3], m[4], "") if v is not None).strip("\"'") for m in _ATTRIBUTE.finditer(head)}
            elif what.upper() == "#EXTGRP":
                group = rest.strip()
            continue
        if _URL.match(line) and "<" not in line and ">" not in line:
            yield {
                "id": "m3u:" + hashlib.sha1(line.encode()).hexdigest()[:16], "name": title or attrs.get("tvg-name") or line, "url": line,
                "group": attrs.get("group-title") or group, "logo": attrs.get("tvg-logo", ""), "tvg_id": attrs.get("tvg-id", ""), "attrs": attrs,
            }
        title, attrs, group = "", {}, ""


def _rows(file: str, parts: Iterator[bytes]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    kinds = {"src_pos": pa.int64(), "attrs": pa.map_(pa.string(), pa.string())}
    streams = ({"file": file, "src_pos": i} | e for i, e in enumerate(entries(lines(parts))))
    while rows := list(itertools.islice(streams, 4096)):
        yield pa.RecordBatch.from_arrays([pa.array([list(r[c].items()) if c == "attrs" else r[c] for r in rows], kinds.get(c, pa.string())) for c in names], names)


def _heads(file: str, parts: Iterator[bytes]) -> Iterator[pa.RecordBatch]:
    if looks_like_playlist(next(parts, b"")[:4096].decode("utf-8", "replace")):
        yield pa.RecordBatch.from_arrays([pa.array([file])], ["file"])


def read_playlists(spark: SparkSession, path: str) -> DataFrame:
    """The streams of all files below ``path``, packed by gzip or not; an error if there are none and no file is a playlist."""
    rows = over_files(spark, path, _rows, SCHEMA)
    if rows.isEmpty() and over_files(spark, path, _heads, "file string").isEmpty():
        raise ValueError(f"no playlist at {path}")
    return rows


def with_defaults(channels: DataFrame, prefix: str = "tallowick.") -> DataFrame:
    """``channels`` (``key, group, tvg_id``) as an export needs them: a group, and a guide id made from the key where there is none."""
    blank = lambda c: F.nullif(F.col(c), F.lit(""))
    return channels.withColumns({"group": F.coalesce(blank("group"), F.lit("Uncategorised")), "tvg_id": F.coalesce(blank("tvg_id"), F.concat(F.lit(prefix), F.lower("key")))})


def written(streams: DataFrame, order: str = "src_pos") -> DataFrame:
    """``pos, value``: the lines of a playlist; attributes without a value are left out."""
    attribute = lambda name, c: F.when(F.col(c).isNotNull() & (F.col(c).cast("string") != ""), F.concat(F.lit(f' {name}="'), F.col(c).cast("string"), F.lit('"')))
    have = [(n, c) for n, c in (("tvg-id", "tvg_id"), ("tvg-chno", "number"), ("tvg-logo", "logo")) if c in streams.columns]
    head = F.concat(F.lit("#EXTINF:-1"), *(F.coalesce(attribute(n, c), F.lit("")) for n, c in have), F.lit(' group-title="'), F.coalesce(F.nullif("group", F.lit("")), F.lit("Uncategorised")), F.lit('",'), F.col("name"))
    rows = streams.select(F.col(order).alias("pos"), F.concat(head, F.lit("\n"), F.col("url")).alias("value"))
    first = streams.sparkSession.createDataFrame([(-1, "#EXTM3U")], "pos long, value string")
    return first.union(rows).orderBy("pos")
