"""Problem 2: template residue, filler and error-page text, by a linear classifier on hashed n-grams.

A page is a row of spots: windows of up to ``WINDOW`` tokens of its title and of the sentences of its lines. A spot's
features are the hashed 1-, 2- and 3-grams that begin in it (of words, digit groups, marks, and one token for anything in
template brackets, by bracket and letter case), with tokens for the edges of the sentence, for being in the title, for the
sentence's length and for the size of the page. A page is flagged when its best spot scores above ``ABOVE``.

The weights, ``2**BITS`` numbers whatever the input, are fitted once by ``residue_train`` (L2-regularised logistic regression on
weak labels from response statuses and phrases, checked on unseen hosts) and kept in ``residue_weights.npz``. Everything is judged by
them; no phrase list is applied to the pages, and nothing is fitted while a query runs.

Defined results: NULL and empty texts and titles hold no spot; repeated rows are judged alike; extra columns are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

import re
from functools import lru_cache
from pathlib import Path

import numpy as np
import xxhash
from pyspark.sql import DataFrame

from corpusloom.llm.common import map_columns

BITS = 18
WINDOW = 6
ABOVE = 0.0

_OPEN = r"\{\{[#/]?|\{%|\[%|<%=?|\$\{|#\{|\(\(|\[\[|%%|@@|__|\{|<"
_CLOSE = r"\}\}|%\}|%\]|%>|\}|\)\)|\]\]|%%|@@|__|>"
_PLAIN_MARK = r"%[A-Z][A-Z_]+%|\[(?:insert[^\S\n][^\]\n]{1,40}|object Object|[A-Z]\w*(?: [A-Z]\w*)*)\]|&nbsp;|Invalid Date"
#: Words come first: most positions start one, and the other forms start with signs.
_TOKEN = re.compile(rf"Invalid Date|[^\W\d_]+|\n|\d+|(?<!\b[A-Z])[.!?…]+[^\S\n]|(?:{_OPEN})[^\S\n]*[A-Za-z][\w .\-]{{0,40}}?[^\S\n]*(?:{_CLOSE})|{_PLAIN_MARK}|[^\w\s]+|_+")
_MARKED = re.compile(rf"(?:{_OPEN})\s*\w.*(?:{_CLOSE})$|{_PLAIN_MARK}", re.S)
_LEAKED = frozenset("undefined null nan xxxx".split())
_STATUS = frozenset("400 401 403 404 429 500 502 503 504".split())


#: The two upper bits of a token's identifier tell edges, words, other signs and marks (anything in template brackets).
_EDGE_KIND, _WORD_KIND, _SIGN_KIND, _MARK_KIND = range(4)


def _id(token: str, kind: int) -> int:
    return kind << 62 | xxhash.xxh3_64_intdigest(token) >> 2


_LINE, _SENTENCE, _TITLE = (_id(x, _EDGE_KIND) for x in ("\n", ".", "<title>"))
_ANY_WORD, _ANY_MARK = np.uint64(_id("word", _WORD_KIND)), np.uint64(_id("mark", _MARK_KIND))


class _Tokens(dict):
    """Identifiers of tokens, filled as they come up; every end of a sentence has one."""

    limit = 500_000

    def __missing__(self, token: str) -> int:
        if len(self) > self.limit:
            self.clear()
        if token == "\n":
            value = _LINE
        elif token[0].isdigit():
            value = _id(token if token in _STATUS else "0" * min(len(token), 4), _WORD_KIND)
        elif token[0] in ".!?…" and token[-1].isspace():
            value = _SENTENCE
        elif _MARKED.match(token):
            value = int(_ANY_MARK)
        else:
            value = _id(token.lower(), _WORD_KIND if token[0].isalpha() and token.lower() not in _LEAKED else _MARK_KIND if token[0].isalpha() else _SIGN_KIND)
        self[token] = value
        return value


_IDS = _Tokens()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def _parted(title: str | None) -> str:
    """The title with the site's name, or what else a separator cuts off, on a line of its own."""
    return re.sub(r"\s+(?:-|–|\||::)\s+", "\n", title or "")


_NOTHING = np.zeros(0, np.int64)
_HEAD, _TAIL = np.array([_TITLE], np.uint64), np.array([_LINE], np.uint64)


def page_tokens(title: str | None, text: str | None) -> tuple[list[str], list[str]]:
    """The tokens of a page's title and of its text, line ends among them."""
    return _TOKEN.findall(_parted(title)) if title else [], _TOKEN.findall(text or "")


def _page_ids(head: list[str], own: list[str]) -> np.ndarray:
    """The token identifiers of a page: title, line end, text, line end."""
    get = _IDS.__getitem__
    return np.concatenate([_HEAD, np.fromiter(map(get, head), np.uint64, len(head)), _TAIL, np.fromiter(map(get, own), np.uint64, len(own)), _TAIL])


def _grams(pages: list[tuple[list[str], list[str]]]) -> tuple[tuple[np.ndarray, ...], np.ndarray, tuple[np.ndarray, ...], np.ndarray, np.ndarray]:
    """Of the ``page_tokens`` of pages laid end to end: the 1-, 2- and 3-gram of every token, where each spot starts, the three
    other features of every spot, the page of every spot, and where each page starts."""
    each = [_page_ids(head, own) for head, own in pages]
    offsets = np.cumsum([0, *map(len, each)])
    ids = np.concatenate(each)
    sizes = np.array([min(10, len(own).bit_length()) for _, own in pages], np.uint64)
    kind = ids >> np.uint64(62)
    edge, mark = kind == _EDGE_KIND, kind == _MARK_KIND
    # Around a mark every word counts as any word and the mark as any mark, so that what is learnt holds in other sentences.
    beside = mark.copy()
    beside[1:] |= mark[:-1]
    beside[:-1] |= mark[1:]
    context = np.where(mark, _ANY_MARK, np.where(beside & (kind == _WORD_KIND), _ANY_WORD, ids))
    # An n-gram belongs to the spot of its first token; one that would go beyond an edge or the page is its shorter self.
    one, base = _mix(ids), _mix(context)
    last = offsets[1:] - 1
    two = base.copy()
    two[:-1] = _mix(base[:-1] * np.uint64(3) + context[1:])
    two[last] = base[last]
    three = two.copy()
    three[:-2] = np.where(edge[1:-1], two[:-2], _mix(two[:-2] * np.uint64(5) + context[2:]))
    three[last], three[last - 1] = two[last], two[last - 1]
    first = np.flatnonzero(edge[:-1] & ~edge[1:])
    if not len(first):
        return (_NOTHING,) * 3, _NOTHING, (_NOTHING,) * 3, _NOTHING, offsets[:-1]
    stop = np.flatnonzero(edge)
    length = stop[np.searchsorted(stop, first, side="right")] - first - 1
    windows = -(-length // WINDOW)
    nth = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
    start = np.repeat(first, windows) + nth * WINDOW + (nth > 0)
    owner = np.searchsorted(offsets, start, side="right") - 1
    bucket = np.repeat(np.minimum(length, 9), windows).astype(np.uint64)
    titled = np.repeat(ids[first] == np.uint64(_TITLE), windows)
    # Long sentences are judged by their words alone: their length would outweigh a single mark.
    long = bucket > 8
    none = np.uint64(2**BITS - 1)
    number = lambda x: (x & none).astype(np.int64)
    others = (
        number(np.where(long, none, _mix(np.uint64(7) + bucket * np.uint64(64)))),
        number(np.where(long, none, _mix(np.uint64(11) + sizes[owner] * np.uint64(64)))),
        number(_mix(np.where(titled, np.uint64(13), np.uint64(17)))),
    )
    return (number(one), number(two), number(three)), start, others, owner, offsets[:-1]


def features(title: str | None, text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """``(feature numbers, first position of each spot)`` of a page, the title's spots first."""
    grams, start, others, _, _ = _grams([page_tokens(title, text)])
    if not len(start):
        return _NOTHING, _NOTHING
    at = start * 3
    joined = np.insert(np.stack(grams, 1).ravel(), np.repeat(at, 3), np.stack(others, 1).ravel())
    begin = at + 3 * np.arange(len(at))
    return joined[begin[0] :], begin - begin[0]


def _sentences(title: str | None, text: str | None) -> list[tuple[str, list[int]]]:
    """Each sentence that has tokens, with the offsets where its windows begin, in the order of ``features``."""
    found = []
    for body in (_parted(title), text or ""):
        held = []
        for m in [*_TOKEN.finditer(body), None]:
            if m is not None and _IDS[m.group()] not in (_LINE, _SENTENCE):
                held.append(m)
            elif held:
                base = held[0].start()
                found.append((body[base : (m or held[-1]).end()].rstrip("\n"), [x.start() - base for x in held[::WINDOW]]))
                held = []
    return found


def spots(title: str | None, text: str | None) -> list[str]:
    """The spots as strings, in the order of ``features``."""
    return [s[i:j] for s, at in _sentences(title, text) for i, j in zip(at, [*at[1:], len(s)])]


def _spot_scores(weights: np.ndarray, pages: list[tuple[list[str], list[str]]]) -> tuple[np.ndarray, np.ndarray]:
    """The score of every spot of the pages, and its page."""
    (one, two, three), start, others, owner, offsets = _grams(pages)
    if not len(start):
        return np.zeros(0), _NOTHING
    # A spot ends where the next one or the next page starts.
    bounds = np.union1d(start, offsets)
    sums = np.add.reduceat(weights[one] + weights[two] + weights[three], bounds)[np.searchsorted(bounds, start)]
    return sums + weights[others[0]] + weights[others[1]] + weights[others[2]] + weights[-1], owner


def scores(weights: np.ndarray, title: str | None, text: str | None) -> np.ndarray:
    """The score of every spot of a page."""
    return _spot_scores(weights, [page_tokens(title, text)])[0]


#: Pages that are scored together.
GROUP = 128


def token_scores(weights: np.ndarray, pages: list[tuple[list[str], list[str]]]) -> np.ndarray:
    """The best score of every page, from its ``page_tokens``; minus infinity for a page without spots."""
    best = np.full(len(pages), -np.inf)
    s, owner = _spot_scores(weights, pages)
    np.maximum.at(best, owner, s)
    return best


def page_scores(weights: np.ndarray, titles: list, texts: list) -> np.ndarray:
    groups = (range(k, min(k + GROUP, len(texts))) for k in range(0, len(texts), GROUP))
    return np.concatenate([np.zeros(0), *(token_scores(weights, [page_tokens(titles[i], texts[i]) for i in own]) for own in groups)])


@lru_cache(maxsize=1)
def weights() -> np.ndarray:
    """The fitted weights; the last one is the intercept."""
    with np.load(Path(__file__).with_name("residue_weights.npz")) as table:
        out = np.zeros(2**BITS + 1, np.float32)
        out[table["used"]] = table["value"]
    return out


def is_residue(weights: np.ndarray, title: str | None, text: str | None) -> bool:
    return bool(page_scores(weights, [title], [text])[0] > ABOVE)


def residue_pages(pages: DataFrame, fitted: np.ndarray | None = None) -> DataFrame:
    """``page_id, score`` of the flagged pages."""
    shared = pages.sparkSession.sparkContext.broadcast(weights() if fitted is None else fitted)

    def run(ids: list, titles: list, texts: list) -> dict[str, list]:
        best = page_scores(shared.value, titles, texts)
        hit = best > ABOVE
        return {"page_id": [i for i, h in zip(ids, hit) if h], "score": best[hit].astype(float)}

    return map_columns(pages.select("page_id", "title", "text"), run, "page_id bigint, score double")
