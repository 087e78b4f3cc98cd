"""A polite fetcher over HTTP: conditional requests, capped bodies, spaced requests, a few at a time."""

import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestead.operators.site import AGENT, MAX_BYTES

#: Requests at a time, seconds between two of one task, seconds that a request may take.
CONCURRENCY, SPACING, TIMEOUT = 2, 0.15, 15.0

SCHEMA = "url string, status int, html string, not_modified boolean, etag string, last_modified string, fetched_at bigint, reason string"
_KINDS = (pa.string(), pa.int32(), pa.string(), pa.bool_(), pa.string(), pa.string(), pa.int64(), pa.string())
_HTML = ("text/html", "application/xhtml")


def fetch_one(url: str, etag: str | None, modified: str | None, open_url: Callable[..., Any] = urllib.request.urlopen, most: int = MAX_BYTES, timeout: float = TIMEOUT) -> tuple:
    """(url, status, html, not_modified, etag, last_modified, fetched_at, reason) of a page.

    reason says why there is no html though the server answered: not-html or too-large; or error, where it didn't. A
    declared length above the cap ends a request before its body is read, a longer body once the cap is reached.
    """
    headers = {"User-Agent": AGENT} | ({"If-None-Match": etag} if etag else {}) | ({"If-Modified-Since": modified} if modified else {})
    now = int(time.time() * 1000)
    try:
        with open_url(urllib.request.Request(url, headers=headers), timeout=timeout) as answer:
            found = answer.headers
            kind, declared = (found.get("Content-Type") or "").lower(), found.get("Content-Length") or "0"
            html, reason = None, None
            if kind and not any(k in kind for k in _HTML):
                reason = "not-html"
            elif declared.isdigit() and int(declared) > most:
                reason = "too-large"
            else:
                body = answer.read(most + 1)
                reason = "too-large" if len(body) > most else None
                html = None if reason else body.decode(found.get_content_charset() or "utf-8", "replace")
            return url, answer.status, html, False, found.get("ETag"), found.get("Last-Modified"), now, reason
    except urllib.error.HTTPError as e:
        return (url, 304, None, True, etag, modified, now, None) if e.code == 304 else (url, e.code, None, False, None, None, now, None)
    except (OSError, ValueError, LookupError):
        return url, None, None, False, None, None, now, "error"


def http_fetcher(open_url: Callable[..., Any] = urllib.request.urlopen, concurrency: int = CONCURRENCY, spacing: float = SPACING, most: int = MAX_BYTES, timeout: float = TIMEOUT):
    """A fetcher for the engine: urls(url, etag, last_modified) to rows of SCHEMA, one per distinct url.

    The urls are split over `concurrency` tasks, each of which waits between its requests. Robots rules are the
    caller's: the engine asks only for what they allow.
    """

    def fetch(urls: DataFrame) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            last = 0.0
            for batch in batches:
                rows = []
                for url, etag, modified in zip(*(c.to_pylist() for c in batch.columns)):
                    time.sleep(max(0.0, last + spacing - time.monotonic()))
                    last = time.monotonic()
                    rows.append(fetch_one(url, etag, modified, open_url, most, timeout))
                cols = list(zip(*rows)) or [()] * len(_KINDS)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, _KINDS)], names=[f.split(" ")[0] for f in SCHEMA.split(", ")])

        asked = urls.where("url is not null").select("url", *(F.col(c) if c in urls.columns else F.lit(None).cast("string").alias(c) for c in ("etag", "last_modified")))
        return asked.dropDuplicates(["url"]).repartition(concurrency, "url").mapInArrow(run, SCHEMA)

    return fetch


def fetch_text(url: str, open_url: Callable[..., Any] = urllib.request.urlopen, timeout: float = TIMEOUT) -> str | None:
    """The text of a small file such as robots.txt or a sitemap; None whatever goes wrong."""
    try:
        with open_url(urllib.request.Request(url, headers={"User-Agent": AGENT}), timeout=timeout) as answer:
            body = answer.read(MAX_BYTES + 1)
            return body.decode("utf-8", "replace") if len(body) <= MAX_BYTES else None
    except (OSError, ValueError):
        return None
