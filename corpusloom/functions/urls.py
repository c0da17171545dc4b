"""Addresses: canonical form, origin, links worth following."""

from __future__ import annotations

import re
from urllib.parse import parse_qsl, quote_plus, urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Query parameters that only track visitors (fixed values).
TRACKING = "utm_source utm_medium utm_campaign utm_term utm_content utm_id gclid fbclid mc_cid mc_eid".split()
#: File endings of things that are no pages (fixed values).
BINARY = "pdf png jpg jpeg gif webp svg ico zip rar 7z gz tgz mp4 mov avi mp3 wav m4a woff woff2 ttf eot".split()
NOT_FOLLOWED = ("#", "mailto:", "tel:", "javascript:")
_PORTS = {"http": 80, "https": 443}
_KEEP = re.compile(r"[^!-~]|[\"<>`{}]")


def _escape(text: str, extra: str = "") -> str:
    """Percent-encode what may not stand in a path or query as it is."""
    return "".join("".join(f"%{b:02X}" for b in c.encode()) if _KEEP.match(c) or c in extra else c for c in text)


def _dots(path: str) -> str:
    out: list[str] = []
    parts = path.split("/")
    for i, p in enumerate(parts):
        last = i == len(parts) - 1
        if p.lower() in (".", "%2e"):
            if last:
                out.append("")
        elif p.lower() in ("..", ".%2e", "%2e.", "%2e%2e"):
            if len(out) > 1:
                out.pop()
            if last:
                out.append("")
        else:
            out.append(p)
    return "/".join(out) or "/"


def canonical(raw: str | None, base: str | None = None) -> str | None:
    """The address in canonical form, without fragment and tracking parameters; None if it is no web address.

    Scheme and host in lower case, international hosts in ASCII form, default ports dropped, dot segments resolved, other
    signs percent-encoded. The query is only rewritten where a tracking parameter was removed from it.
    """
    if raw is None:
        return None
    text = re.sub(r"[\t\r\n]", "", raw.strip(" \x00\x1f\t\r\n\f\v"))
    try:
        if base is not None:
            text = urljoin(base, text)
        parts = urlsplit(text.replace("\\", "/"))
        scheme = parts.scheme.lower()
        if scheme not in _PORTS or not parts.hostname:
            return None
        host = parts.hostname.lower()
        if not host.isascii():
            host = host.encode("idna").decode()
        if re.search(r"[\s<>^|%#\\]", host):
            return None
        port = parts.port
    except (ValueError, UnicodeError):
        return None
    if ":" in host:
        host = f"[{host}]"
    user = parts.netloc.rpartition("@")[0]
    query = parts.query
    if query:
        pairs = parse_qsl(query, keep_blank_values=True)
        kept = [(k, v) for k, v in pairs if k.lower() not in TRACKING]
        if len(kept) < len(pairs):
            query = "&".join(f"{quote_plus(k, safe='*-._')}={quote_plus(v, safe='*-._')}" for k, v in kept)
        else:
            query = _escape(query, "'")
    address = f"{scheme}://{user + '@' if user else ''}{host}"
    if port is not None and port != _PORTS[scheme]:
        address += f":{port}"
    return address + _escape(_dots(parts.path or "/"), "^") + (f"?{query}" if query else "")


@F.pandas_udf(T.StringType())
def canonical_url(url: pd.Series) -> pd.Series:
    """``canonical`` of a column."""
    return url.map(canonical, na_action="ignore")


@F.pandas_udf(T.StringType())
def resolve_url(href: pd.Series, base: pd.Series) -> pd.Series:
    """``href`` as seen from the page ``base``, in canonical form."""
    return pd.Series([None if h is None or b is None else canonical(h, b) for h, b in zip(href, base)], dtype=object)


def plain_canonical(url: Column) -> Column:
    """The canonical form of ordinary addresses by built-in functions alone, for plans that stay in the JVM.

    It equals ``canonical`` for absolute addresses of ASCII signs without dot segments, user names or repeated separators;
    NULL for anything that is no web address.
    """
    u = F.regexp_replace(F.trim(url), r"#.*$", "")
    origin = F.lower(F.regexp_extract(u, r"^(?i)(https?://[^/?#]+)", 1))
    origin = F.regexp_replace(F.regexp_replace(origin, r"^(http://.*):80$", "$1"), r"^(https://.*):443$", "$1")
    rest = F.regexp_replace(u, r"^(?i)https?://[^/?#]+", "")
    rest = F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest))
    tracking = "(?i)(?:" + "|".join(TRACKING) + r")=[^&]*"
    rest = F.regexp_replace(rest, rf"([?&]){tracking}", "$1")
    rest = F.regexp_replace(F.regexp_replace(F.regexp_replace(rest, r"&{2,}", "&"), r"\?&", "?"), r"[?&]+$", "")
    return F.when(origin != "", F.concat(origin, rest))


def origin(url: Column) -> Column:
    """Scheme, host and port of a canonical address."""
    return F.regexp_extract(url, r"^(https?://[^/?#]+)", 1)


def crawlable(href: Column) -> Column:
    """Whether a link leads to something that may be a page."""
    t = F.trim(href)
    barred = F.lit(False)
    for prefix in NOT_FOLLOWED:
        barred = barred | t.startswith(prefix)
    return (t != "") & ~barred & ~t.rlike(r"(?i)\.(" + "|".join(BINARY) + r")(\?|#|$)")


def administrative(url: Column) -> Column:
    """Whether an address belongs to the machinery of a site."""
    return url.rlike(r"(?i)/(cdn-cgi|wp-admin|wp-login)(?![A-Za-z0-9_])")


def likely_url(value: Column) -> Column:
    return F.trim(value).rlike("(?i)^https?://")
