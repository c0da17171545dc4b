"""Problem 3: cutting oversized texts by agglomerative merging of atomic segments.

A text starts as its smallest natural segments: sentences within lines, words where a sentence is too large, hard cuts
where a word is. Every boundary between neighbours has a strength (hard cut 0, word 1, sentence 2, line 3, paragraph 4).
A heap holds the boundaries; the weakest is merged first, among equals the one with the smaller sum, as long as the sum
and the overlap fit the limit. A piece then reaches back over the last ``overlap`` characters before it, or over fewer
down to the nearest word start.

Defined results: NULL texts and texts within the limit give no pieces here; pieces concatenated without their overlaps
give the text back exactly; lengths are code points. Exact copies of an item come out once. Extra columns are ignored.
"""

from __future__ import annotations

import heapq
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import collapsed, map_columns

LIMIT = 1400
OVERLAP = 200
PAGE_ABOVE = 5000
CHUNK_ABOVE = 1400

_END = re.compile(r"\n\s*\n\s*|\n\s*|(?<=[.!?…])[\"'”’)\]]*\s+")
_WORD = re.compile(r"\s+")


def _cuts(text: str, largest: int) -> tuple[list[int], list[int]]:
    """Ends of the atomic segments, and the strength of the boundary at each end."""
    ends, strength = [], []

    def add(end: int, level: int) -> None:
        if end > (ends[-1] if ends else 0):
            ends.append(end)
            strength.append(level)

    def add_span(start: int, end: int, level: int) -> None:
        if end - start > largest:
            for m in _WORD.finditer(text, start, end):
                if m.end() < end:
                    add_word(start_of(start), m.end(), 1)
            add_word(start_of(start), end, level)
        else:
            add(end, level)

    def start_of(start: int) -> int:
        return max(start, ends[-1] if ends else 0)

    def add_word(start: int, end: int, level: int) -> None:
        for cut in range(start + largest, end, largest):
            add(cut, 0)
        add(end, level)

    start = 0
    for m in _END.finditer(text):
        gap = m.group()
        add_span(start, m.end(), 4 if gap.count("\n") > 1 else 3 if "\n" in gap else 2)
        start = m.end()
    if start < len(text):
        add_span(start, len(text), 4)
    return ends, strength


def cores(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """The spans of the pieces without overlap: they cover the text, in order."""
    if overlap < 0 or overlap >= limit:
        raise ValueError("the overlap must be at least 0 and below the limit")
    if len(text) <= limit:
        return [(0, len(text))] if text else []
    room = limit - overlap
    ends, strength = _cuts(text, room)
    n = len(ends)
    start = [0, *ends[:-1]]
    end = list(ends)
    left, right = list(range(-1, n - 1)), list(range(1, n + 1))
    version, alive = [0] * n, [True] * n
    heap = [(strength[i], end[i + 1] - start[i], i, 0, 0) for i in range(n - 1)]
    heapq.heapify(heap)
    while heap:
        _, size, i, vi, vj = heapq.heappop(heap)
        j = right[i]
        if not alive[i] or j >= n or version[i] != vi or version[j] != vj or size > room:
            continue
        end[i] = end[j]
        strength[i] = strength[j]
        alive[j] = False
        right[i] = right[j]
        version[i] += 1
        if right[i] < n:
            left[right[i]] = i
            k = right[i]
            heapq.heappush(heap, (strength[i], end[k] - start[i], i, version[i], version[k]))
        if left[i] >= 0:
            k = left[i]
            heapq.heappush(heap, (strength[k], end[i] - start[k], k, version[k], version[i]))
    return [(start[i], end[i]) for i in range(n) if alive[i]]


def overlap_start(text: str, start: int, overlap: int) -> int:
    """Where the piece whose core begins at ``start`` begins with its overlap."""
    least = max(0, start - overlap)
    if least == 0 or overlap == 0 or text[least - 1].isspace() and not text[least].isspace():
        return least
    m = re.compile(r"\s(?=\S)").search(text, least, start)
    return m.end() if m else least


def pieces(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int]]:
    """``(start, core start, end)`` of each piece."""
    return [(overlap_start(text, a, overlap), a, b) for a, b in cores(text, limit, overlap)]


def split_oversized(
    items: DataFrame, text_col: str, above: int, limit: int = LIMIT, overlap: int = OVERLAP, id_col: str = "item_id"
) -> DataFrame:
    """Pieces of the items whose text is longer than ``above`` after white space is collapsed.

    ``item_kind, item_id, piece_no, n_pieces, start, core_start, piece``. The length test runs in the JVM and lets only
    oversized texts through to Python; no text is shuffled except those.
    """
    big = (
        items.select("item_kind", F.col(id_col).alias("item_id"), F.col(text_col).alias("body"))
        .where(F.length("body") > above)
        .where(F.length(collapsed(F.col("body"))) > above)
    )

    def cut(kinds: list, ids: list, bodies: list) -> dict[str, list]:
        out: dict[str, list] = {k: [] for k in ("item_kind", "item_id", "piece_no", "n_pieces", "start", "core_start", "piece")}
        for kind, item, body in zip(kinds, ids, bodies):
            found = pieces(body, limit, overlap)
            for no, (begin, core, end) in enumerate(found):
                for k, v in zip(out, (kind, item, no, len(found), begin, core, body[begin:end])):
                    out[k].append(v)
        return out

    return map_columns(
        big,
        cut,
        "item_kind string, item_id bigint, piece_no int, n_pieces int, start int, core_start int, piece string",
    )
