"""Answers over HTTP: tried again where that may help, limited in size, and failures told in words without passwords."""

from __future__ import annotations

import http.client
import json
import re
import time
import urllib.error
import urllib.request
from collections.abc import Callable
from typing import Any
from urllib.parse import urlsplit

ATTEMPTS, PAUSE, MOST_BYTES = 4, 1.0, 256 << 20


class FetchError(OSError):
    """An answer that didn't come, with the reason for a reader."""


def shown(url: str) -> str:
    """An address without user, password and query."""
    at = urlsplit(url)
    return f"{at.scheme}://{at.hostname or ''}{f':{at.port}' if at.port else ''}{at.path}"


def _wait(error: urllib.error.HTTPError, pause: float) -> float:
    """How long a server asks to wait: by its header, by the words of its body, else ``pause``."""
    asked = error.headers.get("Retry-After", "") if error.headers else ""
    if asked.isdigit():
        return float(asked)
    told = re.search(r"available in (\d+(?:\.\d+)?)\s*second", error.read(4096).decode("utf-8", "replace"))
    return float(told[1]) + 1 if told else pause


def _reason(status: int) -> str:
    return {401: "the login was refused", 403: "the login was refused", 404: "there is no such address", 429: "too many requests"}.get(status, "the server failed" if status >= 500 else "the request was refused")


def fetch(url: str, timeout: float = 60, attempts: int = ATTEMPTS, pause: float = PAUSE, most: int = MOST_BYTES, headers: dict[str, str] | None = None, sleep: Callable[[float], None] = time.sleep) -> bytes:
    """The whole answer of ``url``.

    Throttling (429), errors of the server and broken connections are tried again, after
    pauses that double unless the server names one; what is left raises ``FetchError``, as do
    other refusals at once and answers of more than ``most`` bytes.
    """
    for attempt in range(1, attempts + 1):
        delay = pause * 2 ** (attempt - 1)
        try:
            with urllib.request.urlopen(urllib.request.Request(url, headers=headers or {}), timeout=timeout) as answer:
                body = answer.read(most + 1)
            if len(body) > most:
                raise FetchError(f"{shown(url)}: the answer has over {most} bytes")
            return body
        except urllib.error.HTTPError as e:
            why, again = f"{_reason(e.code)} ({e.code})", e.code == 429 or e.code >= 500
            delay = _wait(e, delay) if e.code == 429 else delay
        except (urllib.error.URLError, http.client.HTTPException, TimeoutError, ConnectionError) as e:
            why, again = f"no answer: {getattr(e, 'reason', None) or e or type(e).__name__}", True
        if not again or attempt == attempts:
            raise FetchError(f"{shown(url)}: {why}" + (f", {attempts} times" if again else ""))
        sleep(delay)
    raise FetchError(f"{shown(url)}: never asked")


def fetch_json(url: str, **how: Any) -> Any:
    body = fetch(url, **how)
    try:
        return json.loads(body) if body.strip() else None
    except ValueError as e:
        raise FetchError(f"{shown(url)}: the answer is no JSON") from e
