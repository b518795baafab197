"""Programme guides in XMLTV, plain or compressed: reading and writing."""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallowick.sources.contents import over_files
from tallowick.sources.http import shown


def time_of(text: Column) -> Column:
    """``yyyyMMddHHmm[ss] [+zzzz]`` as a timestamp; UTC without an offset; null if it isn't one."""
    digits, zone = F.regexp_extract(text, r"^\s*(\d{12,14})", 1), F.regexp_extract(text, r"([+-]\d{4})\s*$", 1)
    full = F.concat(F.rpad(digits, 14, "0"), F.lit(" "), F.when(zone == "", "+0000").otherwise(zone))
    return F.when(digits != "", F.try_to_timestamp(full, F.lit("yyyyMMddHHmmss Z")))


#: rows handed over at a time
_ROWS = 4096
SCHEMA = "file string, kind string, pos long, guide_id string, name string, icon string, start string, stop string, title string, desc string"
_FIELDS = [c.split()[0] for c in SCHEMA.split(", ")]


class _Elements:
    """Channels and programmes of a document in order, with nothing kept of what is done."""

    def __init__(self) -> None:
        self.parser = expat.ParserCreate()
        self.parser.buffer_text = True
        self.parser.StartElementHandler, self.parser.EndElementHandler, self.parser.CharacterDataHandler = self._start, self._end, self._text
        self.open: dict | None = None
        self.said: list[str] | None = None
        self.begun, self.depth, self.rows = False, 0, []

    def _start(self, tag: str, values: dict[str, str]) -> None:
        self.begun = True
        tag = tag.lower()
        if self.open is None:
            if tag in ("channel", "programme"):
                self.open, self.depth = {"kind": tag, "names": [], "values": values}, 0
            return
        self.depth += 1
        if self.depth == 1:
            if tag == "icon":
                self.open.setdefault("icon", (values.get("src") or "").strip())
            elif tag in ("display-name", "title", "desc"):
                self.said = []

    def _text(self, text: str) -> None:
        if self.said is not None and self.depth == 1:
            self.said.append(text)

    def _end(self, tag: str) -> None:
        tag = tag.lower()
        if self.open is None:
            return
        if self.depth == 0:
            self._done(self.open)
            self.open = None
            return
        if self.depth == 1 and self.said is not None:
            text = "".join(self.said).strip()
            if tag == "display-name":
                self.open["names"] += [text] if text else []
            else:
                self.open.setdefault(tag, text)
            self.said = None
        self.depth -= 1

    def _done(self, made: dict) -> None:
        values = made["values"]
        if made["kind"] == "programme" and values.get("channel") is not None:
            self.rows.append({"kind": "programme", "guide_id": values["channel"], "start": values.get("start"), "stop": values.get("stop"), "title": made.get("title", ""), "desc": made.get("desc", "")})
        elif made["kind"] == "channel" and values.get("id"):
            self.rows += [{"kind": "channel", "guide_id": values["id"], "name": n, "icon": made.get("icon") or None} for n in made["names"]]


def elements(file: str, parts: Iterable[bytes]) -> Iterator[dict]:
    """``kind, guide_id`` and the fields of the channels' names and the programmes of a document.

    A document cut short gives what there is; one that is no XML, or goes wrong on its way, is an error.
    """
    found = _Elements()
    at = 0
    ends = (expat.errors.codes[expat.errors.XML_ERROR_NO_ELEMENTS], expat.errors.codes[expat.errors.XML_ERROR_UNCLOSED_TOKEN], expat.errors.codes[expat.errors.XML_ERROR_PARTIAL_CHAR])
    for part in itertools.chain(parts, [None]):
        try:
            found.parser.Parse(b"" if part is None else part.lstrip() if not found.begun and at == 0 else part, part is None)
        except expat.ExpatError as e:
            if not (part is None and found.begun and e.code in ends):
                raise ValueError(f"{shown(file)} is no guide: {expat.ErrorString(e.code)}") from e
        at += len(part or b"")
        yield from found.rows
        found.rows.clear()


def _batches(file: str, parts: Iterator[bytes]) -> Iterator[pa.RecordBatch]:
    kinds = {"pos": pa.int64()}
    rows = ({"file": file, "pos": i} | r for i, r in enumerate(elements(file, parts)))
    while some := list(itertools.islice(rows, _ROWS)):
        yield pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in some], kinds.get(c, pa.string())) for c in _FIELDS], _FIELDS)


def scan(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the guides at ``path`` in one pass: channels' names and programmes, told apart by ``kind``, with their place in the file.

    Plain or packed by gzip, whatever the name; over HTTP too.  What a task holds doesn't grow with the file.
    """
    return over_files(spark, path, _batches, SCHEMA)


def channels(rows: DataFrame) -> DataFrame:
    """``file, guide_id, name, icon, chan_pos`` of what ``scan`` returns: a row for each name that is not blank; the first icon counts."""
    return rows.filter("kind = 'channel'").select("file", "guide_id", "name", "icon", F.col("pos").alias("chan_pos"))


def programmes(rows: DataFrame) -> DataFrame:
    """``file, guide_id, start, stop, title, desc, prog_pos`` of what ``scan`` returns; programmes without a start go."""
    own = rows.filter("kind = 'programme'").select("file", "guide_id", time_of(F.col("start")).alias("start"), time_of(F.col("stop")).alias("stop"), "title", "desc", F.col("pos").alias("prog_pos"))
    return own.filter("start is not null")


def joined_names(rows: DataFrame) -> DataFrame:
    """``guide_id, names, icon``: a channel that a guide lists again adds to its names; the first icon that is there counts.

    ``rows`` is what ``channels`` returns.
    """
    each = F.array_sort(F.collect_list(F.struct("chan_pos", "name")))
    return rows.groupBy("guide_id").agg(F.transform(each, lambda x: x["name"]).alias("names"), F.min_by("icon", F.when(F.col("icon").isNotNull(), F.col("chan_pos"))).alias("icon"))


def read_channels(spark: SparkSession, path: str) -> DataFrame:
    return channels(scan(spark, path))


def read_programmes(spark: SparkSession, path: str) -> DataFrame:
    return programmes(scan(spark, path))


def _escaped(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def written(channels: DataFrame, programmes: DataFrame) -> DataFrame:
    """``section, pos, value``: a document's lines, all channels, then their programmes; without an end no ``stop`` is written."""
    stamp = lambda c: F.date_format(c, "yyyyMMddHHmmss +0000")
    heads = channels.select(F.lit(1).alias("section"), F.col("chan_pos").alias("pos"), F.concat(F.lit('<channel id="'), _escaped(F.col("guide_id")), F.lit('"><display-name>'), _escaped(F.col("name")), F.lit("</display-name></channel>")).alias("value"))
    stop = F.coalesce(F.concat(F.lit(' stop="'), stamp("stop"), F.lit('"')), F.lit(""))
    body = programmes.join(channels.select("guide_id").distinct(), "guide_id", "left_semi").select(F.lit(2).alias("section"), F.col("prog_pos").alias("pos"), F.concat(F.lit('<programme channel="'), _escaped(F.col("guide_id")), F.lit('" start="'), stamp("start"), F.lit('"'), stop, F.lit("><title>"), _escaped(F.col("title")), F.lit("</title></programme>")).alias("value"))
    frame = channels.sparkSession.createDataFrame([(0, 0, '<?xml version="1.0" encoding="UTF-8"?>\n<tv>'), (3, 0, "</tv>")], "section int, pos long, value string")
    return frame.unionByName(heads).unionByName(body).orderBy("section", "pos")
