"""URL functions: native expressions, and one Arrow function where URLs must be resolved."""

from urllib.parse import quote, urljoin, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestead.functions.text import capitalised_words, col

_DEFAULT_PORTS = {"http": 80, "https": 443}


def normal_url(url: str, base: str | None = None) -> str | None:
    """An absolute http(s) URL in normal form (lower-case scheme and host, no default port, a path), or None."""
    try:
        parts = urlsplit(urljoin(base, url.strip()) if base else url.strip())
        if parts.scheme.lower() not in _DEFAULT_PORTS or not parts.hostname:
            return None
        scheme, host = parts.scheme.lower(), parts.hostname.encode("idna").decode() if not parts.hostname.isascii() else parts.hostname
        if parts.port and parts.port != _DEFAULT_PORTS[scheme]:
            host += f":{parts.port}"
        safe = "/%:@!$&'()*+,;=~-._[]|"
        path, steps = parts.path or "/", []
        for s in path.split("/")[1:]:
            if s == "..":
                steps = steps[:-1]
            elif s != ".":
                steps.append(s)
        if path.endswith(("/.", "/..")):
            steps.append("")
        return urlunsplit((scheme, host, quote("/" + "/".join(steps), safe=safe), quote(parts.query, safe=safe + "?"), quote(parts.fragment, safe=safe + "?")))
    except (ValueError, UnicodeError):
        return None


def origin_of_url(url: str) -> str | None:
    normal = normal_url(url)
    return "/".join(normal.split("/", 3)[:3]) if normal else None


def canonical(href: str | None, declared: str | None = None) -> str | None:
    """The URL to index a page under: a same-origin declared one, else href without its fragment; unparsable as it is."""
    if href is None:
        return None
    resolved = normal_url(declared, href) if declared else None
    if resolved and origin_of_url(resolved) != origin_of_url(href):
        resolved = None
    normal = resolved or normal_url(href)
    return normal.split("#", 1)[0] if normal else href


@F.pandas_udf(T.StringType())
def canonical_url(href: pd.Series, declared: pd.Series) -> pd.Series:
    return pd.Series([canonical(h, d) for h, d in zip(href, declared)])


@F.pandas_udf(T.StringType())
def absolute_url(url: pd.Series, base: pd.Series) -> pd.Series:
    return pd.Series([normal_url(u, b) if u is not None else None for u, b in zip(url, base)])


def url_origin(c: Column | str) -> Column:
    """scheme://host[:port] in lower case without a default port; null if there is none."""
    found = F.regexp_extract(F.lower(col(c)), r"^\s*(https?://[^/?#]+)", 1)
    plain = F.regexp_replace(F.regexp_replace(found, r"^(http://.*):80$", "$1"), r"^(https://.*):443$", "$1")
    return F.when(plain != "", plain)


def url_path(c: Column | str) -> Column:
    """The path, from the first slash behind the host to a query or fragment; the whole string if it is no URL."""
    found = F.regexp_extract(col(c), r"^\s*[a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*([^?#]*)", 1)
    return F.when(col(c).rlike(r"^\s*[a-zA-Z][a-zA-Z0-9+.\-]*://"), F.when(found == "", F.lit("/")).otherwise(found)).otherwise(col(c))


def url_path_query(c: Column | str) -> Column:
    query = F.regexp_extract(col(c), r"(\?[^#]*)", 1)
    return F.concat(url_path(c), query)


def path_parts(c: Column | str) -> Column:
    return F.filter(F.split(url_path(c), "/"), lambda p: p != "")


def _stem(parts: Column) -> Column:
    return F.regexp_replace(F.coalesce(F.get(parts, F.size(parts) - 1), F.lit("")), r"(?i)\.[a-z0-9]+$", "")


def slug_title(c: Column | str) -> Column:
    """A readable title from a URL: its last part, or the directory above an index page, or Home."""
    parts = path_parts(c)
    stem = _stem(parts)
    index = (stem == "") | (F.lower(stem) == "index")
    source = F.when(index, F.coalesce(F.get(parts, F.size(parts) - 2), F.lit("Home"))).otherwise(stem)
    return capitalised_words(F.regexp_replace(source, r"(?i)\.[a-z0-9]+$", ""), "Home")


def url_segments(c: Column | str) -> Column:
    """The directories of a URL: all path parts but the last."""
    parts = path_parts(c)
    return F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))


def is_index_url(c: Column | str) -> Column:
    path = url_path(c)
    return F.coalesce(col(c).rlike(r"^\s*[a-zA-Z][a-zA-Z0-9+.\-]*://") & (F.endswith(path, F.lit("/")) | path.rlike(r"(?i)/index\.[a-z0-9]+$")), F.lit(False))
