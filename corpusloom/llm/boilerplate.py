"""Problem 1: the frame around a page's own words, by block features and a decision tree.

A line is a block. Flat texts hold no anchors, so link density is read off the crawl: a part of a line (between separators,
colons and sentence ends) counts as anchor text where it recurs on the page's host, or where the pages that hold it are mostly
pages of hosts on which it recurs. Two parts are one if their words agree after lower-casing, numbers ignored and the site's own
name taken as one word. A part recurs on a host with at least ``MIN_PAGES`` pages and ``MIN_SHARE`` of the host's pages. No
list of phrases is used anywhere; a site whose words stand in no table is judged by its own pages.

1. One pass over the pages turns each into its parts (hash, line, words) and a few numbers for each line.
2. Parts are counted by host, map-side first; what recurs somewhere is joined back to the pages' parts. Keys of a hot host
   spread over its parts, and adaptive execution splits a hot part.
3. A decision tree, grown on the labelled table beside this file (``frame_lines.npz``: at most ``LABELLED`` lines, as features
   and labels), judges each line by its own values and those of its neighbours: words, density, recurrence, form and place.

Defined results: NULL and empty texts have no lines of either kind; blank lines belong to neither; NULL or empty titles, links
and addresses only leave their features at 0 (pages without a host recur nowhere). Repeated rows are judged alike. Extra columns
are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import residue
from corpusloom.plans.lineage import cut

MIN_PAGES = 5
MIN_SHARE = 0.2
LABELLED = 30_000
#: Pages whose parts are worked out together.
GROUP = 128

#: Signs between the parts of a menu, a crumb trail or a labelled line (fixed values).
SEPARATORS = "| || · » > › • / :: : – —".split()

FEATURES = (
    "words", "density", "words_before", "density_before", "words_after", "density_after", "ended", "ended_before", "ended_after", "capitals", "parts", "digits", "at_sign",
    "own_title", "linked", "from_start", "from_end", "share", "share_before", "share_after", "evidence", "hosts", "since_dense", "words_of_dense",
)

_SITE = re.compile(r"^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", re.I)
_DIGITS = np.array(sorted({residue._IDS[x] for x in [*residue._STATUS, "0", "00", "000", "0000"]}), np.uint64)
_SEPARATOR_IDS = np.array(sorted(residue._IDS[x] for x in SEPARATORS), np.uint64)
_AT = np.uint64(residue._IDS["@"])
_ENDS = np.array(sorted(residue._IDS[x + y] for x in (".", "!", "?", "…", "...", "?!") for y in ("", '"', "”", "’", ")", ".")), np.uint64)
_SITE_WORD = np.uint64(residue._id("<site>", 1))
_STEP = np.uint64(0x9E3779B97F4A7C15)
_LINE = np.uint64(residue._LINE)
_WORD_SPLIT = re.compile(r"[^\W\d_]+")


class _Capitals(dict):
    """Whether a token begins with a capital, filled as they come up."""

    def __missing__(self, token: str) -> int:
        if len(self) > residue._Tokens.limit:
            self.clear()
        self[token] = value = int(token[0].isupper())
        return value


_CAPITALS = _Capitals()


def host_and_site(url: str | None) -> tuple[str, str]:
    """The host of an address as ``common.host_of`` reads it, and the label that names the site."""
    m = _SITE.match(url or "")
    host = re.sub(r"^www\.", "", m.group(1).lower()) if m else ""
    labels = host.split(".")
    return host, labels[-2] if len(labels) > 1 else ""


def _sequence(words: list[str]) -> int:
    """The hash of a sequence of words, as prefixes of lines are hashed."""
    ids = np.fromiter((residue._IDS[w] for w in words), np.uint64, len(words))
    with np.errstate(over="ignore"):
        return int(residue._mix(ids + np.arange(len(ids), dtype=np.uint64) * _STEP).sum(dtype=np.uint64))


def _slug(address: str | None) -> tuple[int, int] | None:
    """Number and hash of the words of an address's last step; the last word is left out, as long slugs are cut inside it."""
    words = _WORD_SPLIT.findall((address or "").split("?")[0].rstrip("/").rsplit("/", 1)[-1].lower())
    return (len(words) - 1, _sequence(words[:-1])) if len(words) > 2 else None


LINE_TYPE = np.dtype([("words", "<u4"), ("flags", "u1"), ("capitals", "u1"), ("digits", "u1"), ("parts", "u1")])
PART_TYPE = np.dtype([("line", "<u4"), ("words", "<u4")])
_FULL, _ENDED, _AT_SIGN, _OWN, _LINKED = 1, 2, 4, 8, 16


def described(urls: list, titles: list, tokens: list[tuple[list, list]], links: list) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of pages with ``(title tokens, text tokens)``: ``(key of each part, PART_TYPE rows, LINE_TYPE rows)``."""
    sizes = np.array([len(own) + 1 for _, own in tokens])
    ids = np.empty(int(sizes.sum()), np.uint64)
    capital = np.zeros(len(ids), np.int64)
    sites = np.zeros(len(tokens), np.uint64)
    at = 0
    for k, (_, own) in enumerate(tokens):
        ids[at : at + len(own)] = np.fromiter(map(residue._IDS.__getitem__, own), np.uint64, len(own))
        capital[at : at + len(own)] = np.fromiter(map(_CAPITALS.__getitem__, own), np.int64, len(own))
        at += len(own) + 1
        ids[at - 1] = _LINE
        site = host_and_site(urls[k])[1]
        sites[k] = residue._IDS[site] if site.isalpha() else 0
    kind = ids >> np.uint64(62)
    digit = np.isin(ids, _DIGITS)
    word = (kind == 1) | (kind == 3)
    letters = word & ~digit
    named = np.where(ids == np.repeat(sites, sizes), _SITE_WORD, ids)
    line_end = ids == _LINE
    breaks = line_end | (ids == np.uint64(residue._SENTENCE)) | np.isin(ids, _SEPARATOR_IDS)

    def starts(ends: np.ndarray) -> np.ndarray:
        return np.concatenate([[0], np.flatnonzero(ends)[:-1] + 1]) if len(ends) else np.zeros(0, np.int64)

    line_start, part_start = starts(line_end), starts(breaks)
    line_stop, part_stop = np.flatnonzero(line_end), np.flatnonzero(breaks)
    count = lambda flags, a, b: np.concatenate([[0], np.cumsum(flags)])[np.stack([a, b])]
    n_letters = np.cumsum(letters) - letters
    with np.errstate(over="ignore"):

        def hashed(begin: np.ndarray, stop: np.ndarray, values: np.ndarray) -> np.ndarray:
            """Each word mixed with its place among the words since ``begin``; 0 elsewhere."""
            place = n_letters - np.repeat(n_letters[begin], stop - begin + 1)
            return np.where(letters, residue._mix(values + place.astype(np.uint64) * _STEP), np.uint64(0))

        parts_sum = np.concatenate([[np.uint64(0)], np.cumsum(hashed(part_start, part_stop, named), dtype=np.uint64)])
        keys = parts_sum[part_stop] - parts_sum[part_start]
        prefix = np.concatenate([[np.uint64(0)], np.cumsum(hashed(line_start, line_stop, ids), dtype=np.uint64)])
        a, b = count(word, part_start, part_stop)
        part_words = b - a
        part_line = np.searchsorted(line_stop, part_start)
        a, b = count(word, line_start, line_stop)
        words = b - a
        a, b = count(digit, line_start, line_stop)
        digits = b - a
        a, b = count(capital, line_start, line_stop)
        capitals = b - a
        a, b = count(ids == _AT, line_start, line_stop)
        signs = b - a
        full = line_stop > line_start
        last = ids[np.maximum(line_stop - 1, 0)]
        ended = full & (np.isin(last, _ENDS) | (last == np.uint64(residue._SENTENCE)))
        text_words = np.maximum(words - digits, 1)
        lines = np.zeros(len(line_stop), LINE_TYPE)
        lines["words"], lines["capitals"], lines["digits"] = words, np.minimum(255, 255 * capitals // text_words), 255 * digits // np.maximum(words, 1)
        lines["parts"] = np.minimum(255, np.bincount(part_line[part_words > 0], minlength=len(lines)))
        lines["flags"] = full * _FULL + ended * _ENDED + (signs > 0) * _AT_SIGN
        rows = np.stack([part_line, part_words], 1)[part_words > 0]
        keys = keys[part_words > 0]
        page_lines = np.searchsorted(line_stop, np.concatenate([[0], np.cumsum(sizes)]))
        page_parts = np.searchsorted(rows[:, 0], page_lines)
        letters_before = np.concatenate([n_letters, [0]])
        places = np.flatnonzero(letters)
        out = []
        for k, (head, _) in enumerate(tokens):
            first, stop = page_lines[k], page_lines[k + 1]
            own = lines[first:stop]
            begin = line_start[first:stop]
            marks = {_OWN: {_slug(urls[k])}, _LINKED: {_slug(x) for x in links[k] or ()}}
            title = [t.lower() for t in (head[: head.index("\n")] if "\n" in head else head) if t[0].isalpha()]
            if title:
                marks[_OWN].add((len(title), _sequence(title)))
            for flag, wanted in marks.items():
                for n in {w[0] for w in wanted if w}:
                    # The hash of the first n words of every line that has so many.
                    before = letters_before[begin]
                    long = np.flatnonzero(letters_before[line_stop[first:stop]] - before >= n)
                    end = places[before[long] + n - 1] + 1
                    same = np.isin(prefix[end] - prefix[begin[long]], np.array([w[1] for w in wanted if w and w[0] == n], np.uint64))
                    own["flags"][long[same]] |= flag
            parts = np.zeros(page_parts[k + 1] - page_parts[k], PART_TYPE)
            parts["line"], parts["words"] = (rows[page_parts[k] : page_parts[k + 1]] - [[first, 0]]).T
            out.append((keys[page_parts[k] : page_parts[k + 1]].view(np.int64), parts, own))
    return out


#: What is known of a part that recurs somewhere, on a page's host: its share of the host's pages, its evidence, its number of
#: hosts, and whether it recurs here.
FACTS = ("share", "evidence", "hosts", "here")


def features(keys: np.ndarray, parts: np.ndarray, lines: np.ndarray, known: dict[int, tuple]) -> tuple[np.ndarray, np.ndarray]:
    """Features of the lines of one page that have anything but blanks, and their numbers. ``known`` gives ``FACTS`` by key."""
    facts = np.array([known[k] for k in known], np.float64).reshape(len(known), len(FACTS))
    one = lambda x: np.array([len(x)])
    x, number, _ = features_of_pages(keys, one(keys), parts, lines, one(lines), np.array(list(known), np.int64), one(facts), facts)
    return x, number


def features_of_pages(
    keys: np.ndarray, n_parts: np.ndarray, parts: np.ndarray, lines: np.ndarray, n_lines: np.ndarray, known: np.ndarray, n_known: np.ndarray, facts: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of pages laid end to end: features of the lines that have anything but blanks, their numbers, and the page of each."""
    c = {name: k for k, name in enumerate(FEATURES)}
    first = np.cumsum(n_lines) - n_lines
    page_of_line = np.repeat(np.arange(len(n_lines)), n_lines)
    full = (lines["flags"] & _FULL) > 0
    own, page = lines[full], page_of_line[full]
    number = np.flatnonzero(full) - first[page]
    n = len(own)
    x = np.zeros((n, len(FEATURES)), np.float32)
    if not n:
        return x, number, page
    x[:, c["words"]] = own["words"]
    for name, flag in (("ended", _ENDED), ("at_sign", _AT_SIGN), ("own_title", _OWN), ("linked", _LINKED)):
        x[:, c[name]] = (own["flags"] & flag) > 0
    x[:, c["capitals"]], x[:, c["digits"]], x[:, c["parts"]] = own["capitals"] / 255, own["digits"] / 255, own["parts"]
    rows = np.arange(n)
    begins = np.concatenate([[True], page[1:] != page[:-1]])
    begin = np.flatnonzero(begins)
    size = np.diff(np.concatenate([begin, [n]]))
    x[:, c["from_start"]] = rows - np.repeat(begin, size)
    x[:, c["from_end"]] = np.repeat(begin + size, size) - 1 - rows
    if len(known):
        # A part is looked up with its page: key and page mixed into one number.
        mixed = lambda key, of: residue._mix(key.view(np.uint64) ^ residue._mix(of.astype(np.uint64) * _STEP + np.uint64(1)))
        page_of_part = np.repeat(np.arange(len(n_parts)), n_parts)
        table = mixed(known, np.repeat(np.arange(len(n_known)), n_known))
        order = np.argsort(table)
        asked = mixed(np.ascontiguousarray(keys), page_of_part)
        at = np.minimum(np.searchsorted(table[order], asked), len(table) - 1)
        found = table[order][at] == asked
        hit = np.where(found[:, None], facts[order[at]], 0.0)
        row_of_line = np.cumsum(full) - 1
        place = row_of_line[first[page_of_part] + parts["line"]]
        weight = parts["words"].astype(np.float64)
        total = np.maximum(np.bincount(place, weight, n), 1)
        anchor = (hit[:, 3] > 0) | (hit[:, 1] >= 0.5)
        for name, values in (("density", anchor), ("share", hit[:, 0]), ("evidence", hit[:, 1]), ("hosts", np.minimum(hit[:, 2], 20))):
            x[:, c[name]] = np.bincount(place, weight * values, n) / total
    dense, ended = x[:, c["density"]] >= 0.5, x[:, c["ended"]] > 0
    # The last dense line, and the last line that ends a run, of the page before each line.
    before = lambda flags: np.concatenate([[-1], np.maximum.accumulate(np.where(flags, rows, -1))[:-1]])
    start = np.repeat(begin, size)
    last_dense, last_end = before(dense), before(ended & ~dense)
    known_dense = last_dense >= start
    runs = known_dense & (last_end < last_dense)
    x[:, c["since_dense"]] = np.where(runs, np.minimum(20, rows - last_dense - 1), 20)
    x[:, c["words_of_dense"]] = np.where(known_dense, x[np.maximum(last_dense, 0), c["words"]], 0)
    inner, outer = ~begins[1:], slice(1, None)
    for name in ("words", "density", "ended", "share"):
        x[outer, c[f"{name}_before"]] = np.where(inner, x[:-1, c[name]], 0)
        x[:-1, c[f"{name}_after"]] = np.where(inner, x[outer, c[name]], 0)
    return x, number, page


class Tree:
    """A binary decision tree grown by Gini impurity; leaves hold the share of frame lines."""

    def __init__(self, depth: int = 9, least: int = 5):
        self.depth, self.least = depth, least
        self.nodes: list[tuple[int, float, int, int, float]] = []

    def grow(self, x: np.ndarray, y: np.ndarray) -> Tree:
        self._node(x, y.astype(np.float64), 0)
        self.arrays = tuple(np.array(c) for c in zip(*self.nodes))
        return self

    def _node(self, x: np.ndarray, y: np.ndarray, level: int) -> int:
        me = len(self.nodes)
        self.nodes.append((-1, 0.0, -1, -1, float(y.mean())))
        n, p = len(y), y.mean()
        if level == self.depth or p in (0.0, 1.0) or n < 2 * self.least:
            return me
        best = (n * p * (1 - p) - 1e-9, -1, 0.0)
        for f in range(x.shape[1]):
            order = np.argsort(x[:, f], kind="stable")
            v, t = x[order, f], np.cumsum(y[order])
            left = np.arange(1, n)
            a = t[:-1]
            cost = a * (1 - a / left) + (t[-1] - a) * (1 - (t[-1] - a) / (n - left))
            cost[(v[1:] == v[:-1]) | (left < self.least) | (n - left < self.least)] = np.inf
            i = int(cost.argmin())
            if cost[i] < best[0]:
                best = (cost[i], f, (v[i] + v[i + 1]) / 2)
        _, f, at = best
        if f < 0:
            return me
        low = x[:, f] <= at
        self.nodes[me] = (f, at, self._node(x[low], y[low], level + 1), self._node(x[~low], y[~low], level + 1), float(p))
        return me

    def predict(self, x: np.ndarray) -> np.ndarray:
        feature, at, low, high, value = self.arrays
        node = np.zeros(len(x), np.int64)
        rows = np.arange(len(x))
        while True:
            f = feature[node]
            inner = f >= 0
            if not inner.any():
                return value[node]
            go = x[rows, np.maximum(f, 0)] <= at[node]
            node = np.where(inner, np.where(go, low[node], high[node]), node)


@lru_cache(maxsize=1)
def trained_tree() -> Tree:
    """The tree of the labelled table."""
    with np.load(Path(__file__).with_name("frame_lines.npz")) as table:
        return Tree().grow(table["x"].astype(np.float32), table["y"])


_BLOCKS = "page_id bigint, host bigint, keys array<bigint>, parts binary, lines binary"


def blocks(pages: DataFrame, skip=None) -> DataFrame:
    """One row for each page: its host's hash (NULL where it has none), the keys of its parts, and the parts and lines packed.

    ``skip(tokens, texts, links)`` says of the pages of a group which are left out before their lines are looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, GROUP):
                ids, urls, titles, texts, links = (c.to_pylist() for c in batch.slice(begin, GROUP).columns)
                tokens = [residue.page_tokens(t, x) for t, x in zip(titles, texts)]
                kept = range(len(ids)) if skip is None else np.flatnonzero(~np.asarray(skip(tokens, texts, links), bool)).tolist()
                pick = lambda column: [column[k] for k in kept]
                if not len(kept):
                    continue
                found = described(pick(urls), pick(titles), pick(tokens), pick(links))
                hosts = [host_and_site(u)[0] for u in pick(urls)]
                hashes = [residue.xxhash.xxh3_64_intdigest(h) - (1 << 63) if h else None for h in hosts]
                offsets = np.concatenate([[0], np.cumsum([len(k) for k, _, _ in found])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(pick(ids), pa.int64()),
                        pa.array(hashes, pa.int64()),
                        pa.ListArray.from_arrays(offsets, np.concatenate([k for k, _, _ in found])),
                        pa.array([p.tobytes() for _, p, _ in found], pa.binary()),
                        pa.array([x.tobytes() for _, _, x in found], pa.binary()),
                    ],
                    names=["page_id", "host", "keys", "parts", "lines"],
                )

    source = pages.select("page_id", "url", "title", "text", "links").where("text is not null and text != ''")
    return source.mapInArrow(run, _BLOCKS).withColumn("row", F.monotonically_increasing_id())


def recurring(rows: DataFrame) -> DataFrame:
    """``host, key, share, evidence, hosts, here`` of the parts that recur on some host, on every host that has them.

    ``evidence`` is the share of the pages with the part that are pages of hosts where it recurs; ``here`` says whether this one is.
    """
    placed = rows.select("host", F.explode(F.array_distinct("keys")).alias("key")).where("host is not null and key != 0")
    counts = placed.groupBy("host", "key").agg(F.count("*").alias("pages"))
    sizes = rows.where("host is not null").groupBy("host").agg(F.count("*").alias("host_pages"))
    share = F.col("pages") / F.col("host_pages")
    seen = counts.join(sizes, "host").select("host", "key", "pages", share.alias("share"), ((F.col("pages") >= MIN_PAGES) & (share >= MIN_SHARE)).alias("here"))
    anywhere = seen.where("here").select("key").distinct()
    used = cut(seen.join(anywhere, "key", "left_semi"))
    by_key = used.groupBy("key").agg((F.sum(F.when(F.col("here"), F.col("pages")).otherwise(0)) / F.sum("pages")).alias("evidence"), F.count("*").alias("hosts"))
    return used.join(by_key, "key").select("host", "key", "share", "evidence", "hosts", "here")


def with_evidence(rows: DataFrame) -> DataFrame:
    """``rows`` with ``known``: what is known of the page's parts that recur somewhere. Only these travel by page."""
    placed = rows.select("row", "host", F.explode(F.array_distinct("keys")).alias("key")).where("host is not null and key != 0")
    facts = placed.join(recurring(rows), ["host", "key"]).groupBy("row").agg(F.collect_list(F.struct("key", "share", "evidence", "hosts", "here")).alias("known"))
    return rows.join(facts, "row", "left")


def page_features(rows: DataFrame, finish, schema: str) -> DataFrame:
    """``finish(page ids, features, line numbers, page of each line)`` over batches of ``with_evidence``; it returns columns by name."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys, parts, lines, known = batch.columns
            lengths = lambda column: np.array(pc.fill_null(pc.list_value_length(column), 0), np.int64)
            packed = lambda column, kind: (np.frombuffer(b"".join(column.to_pylist()), kind), np.array(pc.binary_length(column), np.int64) // kind.itemsize)
            facts = known.flatten()
            table = np.stack([facts.field(name).to_numpy(zero_copy_only=False).astype(np.float64) for name in FACTS], 1) if len(facts) else np.zeros((0, len(FACTS)))
            (own_parts, n_parts), (own_lines, n_lines) = packed(parts, PART_TYPE), packed(lines, LINE_TYPE)
            own_keys = keys.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            own_known = facts.field("key").to_numpy(zero_copy_only=False).astype(np.int64)
            x, number, page = features_of_pages(own_keys, n_parts, own_parts, own_lines, n_lines, own_known, lengths(known), table)
            out = finish(ids.to_numpy(zero_copy_only=False), x, number, page)
            yield pa.RecordBatch.from_arrays([pa.array(out[n]) for n in names], names=names)

    return rows.select("page_id", "keys", "parts", "lines", "known").mapInArrow(run, schema)


def frame_lines(pages: DataFrame, skip=None) -> DataFrame:
    """``page_id, line_no`` of the frame lines of pages with ``page_id, url, title, text, links``; see ``blocks`` for ``skip``."""
    shared = pages.sparkSession.sparkContext.broadcast(trained_tree())

    def finish(ids: np.ndarray, x: np.ndarray, number: np.ndarray, page: np.ndarray) -> dict[str, np.ndarray]:
        hit = shared.value.predict(x) > 0.5
        return {"page_id": ids[page[hit]].astype(np.int64), "line_no": number[hit].astype(np.int32)}

    return page_features(with_evidence(cut(blocks(pages, skip))), finish, "page_id bigint, line_no int")


def main_text(pages: DataFrame) -> DataFrame:
    """``page_id, main_text``: each page's own lines, in order; empty where there are none, NULL for a NULL text.

    Page ids must be unique. Blank lines are left out. Only line numbers travel to the page; its text is moved once, by its id.
    """
    drop = frame_lines(pages).groupBy("page_id").agg(F.collect_set("line_no").alias("drop_lines"))
    joined = pages.select("page_id", "text").join(drop, "page_id", "left")
    dropped = F.coalesce("drop_lines", F.array().cast("array<int>"))
    kept = F.filter(F.split("text", "\n", -1), lambda line, i: ~F.array_contains(dropped, i) & line.rlike(r"[^\s\x{a0}\x{2000}-\x{200a}\x{202f}\x{3000}]"))
    return joined.select("page_id", F.array_join(kept, "\n").alias("main_text"))
