"""Streams from a specification: an address whose scheme names the kind of source."""

from __future__ import annotations

import re
from collections.abc import Callable
from urllib.parse import quote, unquote, urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallowick.sources import playlist, remote
from tallowick.sources.contents import contents

LOADERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def loader(*schemes: str):
    """Register a function of ``(spark, spec)`` for the schemes."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        LOADERS.update(dict.fromkeys(schemes, f))
        return f

    return add


def scheme_of(spec: str) -> str:
    found = re.match(r"([A-Za-z][A-Za-z0-9+.-]*)://", spec.strip())
    return found[1].lower() if found else ""


def load(spark: SparkSession, spec: str) -> DataFrame:
    """The streams of ``spec``; an unknown scheme is an error."""
    scheme = scheme_of(spec)
    if scheme not in LOADERS:
        raise ValueError(f"no source for {scheme}:// - known: {', '.join(sorted(s for s in LOADERS if s))}")
    return LOADERS[scheme](spark, spec)


@loader("", "http", "https", "file")
def _playlist(spark: SparkSession, spec: str) -> DataFrame:
    return playlist.read_playlists(spark, spec)


@loader("xtream", "xtreams")
def _panel(spark: SparkSession, spec: str) -> DataFrame:
    at = urlsplit(spec)
    user, password = unquote(at.username or ""), unquote(at.password or "")
    base = ("https" if at.scheme == "xtreams" else "http") + f"://{at.hostname}" + (f":{at.port}" if at.port else "")

    def answer(action: str, fields: str) -> DataFrame:
        url = f"{base}/player_api.php?username={quote(user)}&password={quote(password)}&action={action}"
        return contents(spark, url).select(F.explode(F.from_json(F.decode("content", "UTF-8"), f"array<struct<{fields}>>")).alias("x")).select("x.*")

    categories = answer("get_live_categories", "category_id:string,category_name:string")
    streams = answer("get_live_streams", "stream_id:string,name:string,category_id:string,stream_icon:string,epg_channel_id:string")
    return remote.panel_streams(categories, streams, base, user, password)
