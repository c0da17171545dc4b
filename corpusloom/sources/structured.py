"""Text in structured data: linked-data nodes and embedded application data."""

from __future__ import annotations

import json
import re

_BLANK = re.compile(r"[\t\n\v\f\r \xa0\U00001680\U00002000-\U0000200a\U00002028\U00002029\U0000202f\U0000205f\U00003000\U0000feff]+")
_URL = re.compile(r"^https?://", re.I)

#: Fields whose text is taken as it stands, in order (fixed values).
DIRECT = """name description text headline articleBody author email telephone url image givenName familyName jobTitle foundingDate numberOfEmployees streetAddress addressLocality addressRegion postalCode addressCountry
priceCurrency price offers availability sku ratingValue reviewBody aggregateRating bestRating worstRating datePublished startDate endDate eventDate dateModified publisher about areaServed serviceArea knowsLanguage
wordCount timeRequired inLanguage""".split()
#: Fields whose lists of texts are taken, in order (fixed values).
LISTS = """knowsAbout skills languages award sameAs offers benefits features tags keywords articleSection keywords reviews aggregateRating serviceType areaServed audience""".split()
#: Parts of an address, fields that name organisations, and social links, in order (fixed values).
ADDRESS = "streetAddress addressLocality addressRegion postalCode addressCountry".split()
ORGANISATIONS = "alumniOf workLocation employer organization publisher".split()
SOCIAL = "facebookUrl twitterUrl instagramUrl linkedinUrl youtubeUrl blogUrl".split()
#: Keys of embedded data that hold no text (fixed values).
SKIPPED = frozenset("href src icon logo image images thumbnail url urls path slug id".split())

#: Bounds on embedded data (fixed values).
MAX_RAW, MAX_DEPTH, MAX_VALUES, MIN_VALUE, VALUE_CHARS, KEY_CHARS = 3_000_000, 7, 240, 30, 600, 160


def _squeeze(text: str) -> str:
    return _BLANK.sub(" ", text).strip(" ")


def _load(raw: str):
    def refuse(name):
        raise ValueError(name)

    return json.loads(raw, parse_constant=refuse)


def _text(value) -> str:
    return value if isinstance(value, str) else ""


def _field(value, name):
    return value.get(name) if isinstance(value, dict) else None


def _name_list(items) -> list[str]:
    return [n for n in (_text(_field(x, "name")).strip() for x in items) if n]


def _dated(text: str, item) -> str:
    dates = [f"{word} {_field(item, key)}" for word, key in (("from", "startDate"), ("to", "endDate")) if isinstance(_field(item, key), str)]
    return text + (f" ({' '.join(dates)})" if dates else "")


def _placed(title, org) -> str:
    if not isinstance(title, str):
        return ""
    return f"{title} at {org}" if isinstance(org, str) and org else title


def _organisation(value):
    return value if isinstance(value, str) else _field(value, "name")


def _experience(item) -> str:
    return _dated(_placed(_field(item, "jobTitle"), _field(_field(item, "organization"), "name")), item)


def _work(item) -> str:
    return _dated(_placed(_field(item, "jobTitle") or _field(item, "position"), _organisation(_field(item, "organization") or _field(_field(item, "employer"), "name"))), item)


def _review(item) -> str:
    rating = _field(item, "ratingValue")
    body = _text(_field(item, "reviewBody"))
    rated = isinstance(rating, (str, int, float)) and not isinstance(rating, bool)
    if isinstance(rating, float) and rating.is_integer():
        rating = int(rating)
    return f"{body} (Rating: {rating})".strip() if rated else body


def _listed(label: str, parts: list[str], separator: str = ", ") -> str:
    return f"{label}: {separator.join(parts)}" if parts else ""


def node_strings(node) -> list[str]:
    """The texts of one linked-data node, in a fixed order of kinds; a graph's nodes one after another.

    The labels below and the sentence on former organisations are fixed values.
    """
    if not isinstance(node, dict):
        return []
    if isinstance(node.get("@graph"), list):
        return [t for x in node["@graph"] for t in node_strings(x)]
    if not node.get("@type"):
        return []
    out: list[str] = []

    def add(text: str, least: int) -> None:
        t = _squeeze(text)
        if t and len(t) >= least:
            out.append(t)

    items = lambda key: node[key] if isinstance(node.get(key), list) else []
    for f in DIRECT:
        add(_text(node.get(f)), 2)
    for f in LISTS:
        add(_listed(f, [s for s in (x.strip() for x in items(f) if isinstance(x, str)) if s and not _URL.match(s)]), 5)
    add(_listed("Profiles", [x for x in items("sameAs") if isinstance(x, str) and _URL.match(x.strip())][:5]), 10)
    add(_listed("Address", [v for v in (_text(_field(node.get("address"), k)).strip() for k in ADDRESS) if v]), 5)
    add(_listed("Certifications", [n for n in (_text(_field(x, "name")) for x in items("hasCredential")) if n]), 10)
    for f in ORGANISATIONS:
        names = _name_list(items(f))
        if f == "alumniOf" and names:
            trail = f"(listed in order: {' → '.join(names)})" if len(names) > 1 else f"({names[0]})"
            add(f"Past Company Affiliations: {', '.join(names)} {trail}. Based on the site, the person has worked at these companies.", 5)
        else:
            add(_listed(f, names), 5)
    add(_listed("Education", _name_list(items("educationRequirements"))), 5)
    add(_listed("Employment History", [t for t in map(_experience, items("experience")) if t], "; "), 5)
    add(_listed("Work History", [t for t in map(_work, items("workHistory")) if t], "; "), 5)
    current = node.get("currentPosition")
    place = _placed(_field(current, "jobTitle") or _field(current, "title"), _organisation(_field(current, "organization") or _field(current, "company")))
    add(_listed("Current Position", [place] if place else []), 5)
    add(_listed("Reviews", [t for t in map(_review, items("review")) if t][:3], "; "), 10)
    add(_listed("Social", [v for v in (_text(node.get(k)) for k in SOCIAL) if _URL.match(v.strip())]), 10)
    return out


def json_ld_strings(raw: str | None) -> list[str]:
    """The texts of a linked-data script; none if it is no JSON or its top is a list."""
    if not raw:
        return []
    try:
        return node_strings(_load(raw))
    except ValueError:
        return []


def _members(value: dict) -> list[tuple[str, object]]:
    """Members in a browser's order: whole numbers first, ascending, the rest as written."""
    numbers = sorted((k for k in value if re.fullmatch(r"0|[1-9]\d{0,9}", k) and int(k) < 2**32 - 1), key=int)
    return [(k, value[k]) for k in [*numbers, *(k for k in value if k not in set(numbers))]]


def embedded_strings(scripts: list[str]) -> list[str]:
    """Long texts in embedded application data, depth first with the last member of an object first, across all scripts of a page."""
    out: list[str] = []
    seen: set[str] = set()
    for raw in scripts:
        if not raw or len(raw) > MAX_RAW:
            continue
        try:
            stack = [(_load(raw), 0)]
        except ValueError:
            continue
        while stack and len(out) < MAX_VALUES:
            value, depth = stack.pop()
            if depth > MAX_DEPTH:
                continue
            if isinstance(value, str):
                t = _squeeze(value)
                key = t[:KEY_CHARS].lower()
                if len(t) >= MIN_VALUE and not _URL.match(t) and key not in seen:
                    seen.add(key)
                    out.append(t if len(t) <= VALUE_CHARS else t[:VALUE_CHARS] + "...")
            elif isinstance(value, list):
                stack.extend((x, depth + 1) for x in reversed(value))
            elif isinstance(value, dict):
                stack.extend((v, depth + 1) for k, v in _members(value) if k.lower() not in SKIPPED)
    return out
