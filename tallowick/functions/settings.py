"""Settings as they arrive, as text, made to fit: numbers within bounds, words out of a list, switches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _within(value: Column, low: float, high: float, default: float) -> Column:
    return F.when(value.isNull(), default).otherwise(F.greatest(F.lit(low), F.least(F.lit(high), value)))


def whole(text: Column, low: int, high: int, default: int) -> Column:
    """A whole number, drawn to the nearer bound if it is outside; the default where there is none."""
    return _within(F.trim(text).try_cast("int"), low, high, default)


def real(text: Column, low: float, high: float, default: float) -> Column:
    return _within(F.trim(text).try_cast("double"), low, high, default)


def one_of(text: Column, words: Sequence[str], default: str) -> Column:
    return F.when(text.isin(*words), text).otherwise(default)


def switch(text: Column, default: bool) -> Column:
    """Off for what says no in words; on for any other text."""
    return F.coalesce(~F.lower(text).isin("false", "0", "no", ""), F.lit(default))


def ceiling(n: Column, least: int) -> Column:
    """A ceiling that is none, 0, or at least ``least``."""
    return F.when((n > 0) & (n < least), least).otherwise(n)
