"""Problem 4: personal information by a character-level bidirectional LSTM with CRF transitions, in numpy.

1. Every text is cut into sentences (``SPLIT``); nothing is left out. A sentence that stands in many texts, as those of chunks
   and of the page they were cut from do, is read once: distinct sentences are the rows the network sees.
2. Each sentence is read, two characters a step, in windows of ``WINDOW`` characters that overlap by ``OVERLAP``. Where windows overlap their
   emissions are averaged, and one Viterbi pass over the whole sentence decides all its labels together.
3. An exact check sets each span to the bounds of its token, address or number, and drops spans without the form of their
   type. Capitals of any script count in names, and so do particles between the parts and initials.

Sentences with items are joined back to the texts by a 128-bit hash. A sentence that stands in a third of all texts is one row
of the network and, in the join, a key that adaptive execution splits. Weights are those of ``pii_weights.npz``, made by
``pii_train`` (numpy, from labelled spans).

Defined results: NULL and empty texts hold nothing and come out as they are; repeated rows are judged alike; extra columns
are ignored; placeholders are ``[EMAIL] [PHONE] [ID_NUMBER] [ADDRESS] [NAME]``. A sentence longer than ``LONG`` characters is
decoded in parts that share ``SHARED`` characters; an item within the shared part comes out once.
"""

from __future__ import annotations

import ctypes
import re
import sys
from functools import lru_cache
from pathlib import Path

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import map_columns

TYPES = ("email", "phone", "id_number", "address", "name")
TAGS = 1 + 2 * len(TYPES)  # none, then begin and inside of each type
WINDOW = 160
OVERLAP = 48
HIDDEN = 24
EMBEDDING = 10
ROWS = 512  # windows read together
CELLS = 1 << 18  # characters decoded at once, which bounds memory
LONG, SHARED = 2048, 256

#: A sentence ends at a line end, or at the blank after a mark that follows four letters (so not after initials and most abbreviations).
SPLIT = r"[ \t](?<=[a-zäöüßáéíóúñ]{4}[.!?][ \t])|\n"
_CUT = re.compile(SPLIT)

_COMMON = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0 \n.,;:!?'\"()[]{}@/\\-–_+*#%&=<>|·º°áéíóúñäöüßÁÉÍÓÚÑÄÖÜåøæëèêç¿¡“”„’…"
CHARS = {c: i + 4 for i, c in enumerate(_COMMON)}
VOCABULARY = len(CHARS) + 4


def _rare(c: str) -> int:
    """Digits are one character; others by kind."""
    return CHARS["0"] if c.isdigit() else CHARS.get(c) or (1 if c.isspace() else 2 if c.isupper() or c.istitle() else 3 if c.isalpha() else 0)


@lru_cache(maxsize=1)
def _codes() -> np.ndarray:
    """The number of every character of the first plane."""
    return np.array([_rare(chr(c)) for c in range(1 << 16)], np.uint8)


def encode(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(points) and points.max() >= 1 << 16:
        out = _codes()[np.minimum(points, 0xFFFF)]
        for k in np.flatnonzero(points >= 1 << 16).tolist():
            out[k] = _rare(text[k])
        return out
    return _codes()[points]


_CAP = "A-ZÀ-ÖØ-Þ"
_S = r"[^\S\n]+"
# Capitals of every script, as a character class.
_ANY_CAP = "".join(c for c in map(chr, range(sys.maxunicode + 1)) if c.isupper() or c.istitle())

_DOT = r"(?:\.|\s?(?:\(dot\)|\[dot\]|\{dot\})\s?|\sdot\s)"
EMAIL = re.compile(rf"[\w.+\-]+\s?(?:@|\(at\)|\[at\]|\{{at\}})\s?[\w\-]+(?:{_DOT}[A-Za-z][\w\-]*)+|[\w.+\-]+\sat\s[\w\-]+(?:\sdot\s[A-Za-z][\w\-]*)+", re.I)
PHONE = re.compile(r"(?<![\w/.,-])(?:\+\s?)?\(?\d[\d ./()\-]{5,}\d(?![\w])")
ID_NUMBER = re.compile(r"(?<![\w/-])(?:[A-Z]{2}(?:\s?\d{2}){3}\s?[A-Z]|[A-Z]{0,2}-?\d[A-Z\d]*(?:[/\-][A-Z\d]+)*)(?![\w/-])")
PLACEHOLDER = {t: f"[{t.upper()}]" for t in TYPES}


@lru_cache(maxsize=1)
def _one_thread() -> None:
    """Products of small matrices gain nothing from threads that wait for each other."""
    for library in (Path(np.__file__).parent.parent / "numpy.libs").glob("*openblas*"):
        handle = ctypes.CDLL(str(library))
        for name in ("scipy_openblas_set_num_threads64_", "openblas_set_num_threads64_", "openblas_set_num_threads"):
            if hasattr(handle, name):
                getattr(handle, name)(1)


class Model:
    """Weights of both directions. A step of the recurrence takes two characters, embedded apart, and gives the emissions of both:
    half the steps of one character each. ``gates`` maps state, embeddings and 1 to the gates; the rows of the three sigmoid gates
    are stored halved, as sigmoid(2z) = (1 + tanh(z)) / 2, and the state is kept doubled, which ``gates`` and ``out`` undo."""

    def __init__(self, arrays: dict[str, np.ndarray]):
        p = {k: np.asarray(v, np.float32) for k, v in arrays.items()}
        self.h = p["u"].shape[1]
        self.gates = [np.ascontiguousarray(np.concatenate([p["u"][d] / 2, *p["wx"][d], p["base"][d][None]]).T) for d in (0, 1)]
        self.table = np.ascontiguousarray(p["emb"].T)
        self.out, self.bias, self.trans = np.ascontiguousarray(p["out"].transpose(0, 2, 1)) / 2, p["bias"], p["trans"]
        _one_thread()

    def emissions(self, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """``[length, tags, windows]`` for character numbers ``[length, windows]``, 0 beyond each window's length."""
        if len(ids) % 2:
            ids = np.concatenate([ids, np.zeros((1, ids.shape[1]), ids.dtype)])
        t, b = len(ids) // 2, ids.shape[1]
        h, d2 = self.h, len(self.table)
        both = np.empty((t, 2 * h, b), np.float32)
        z, kept = np.empty((4 * h, b), np.float32), np.empty((h, b), np.float32)
        i, f, o, g, sigmoid = z[:h], z[h : 2 * h], z[2 * h : 3 * h], z[3 * h :], z[: 3 * h]
        ends = (lengths[None, :] + 1) // 2 <= np.arange(t)[:, None]
        ragged = ends.any(1)
        half = np.float32(0.5)
        for d in (0, 1):
            x = np.ones((h + 2 * d2 + 1, b), np.float32)
            x[:h] = 0
            state, cell = x[:h], np.zeros((h, b), np.float32)
            for k in range(t) if d == 0 else range(t - 1, -1, -1):
                np.take(self.table, ids[2 * k], axis=1, out=x[h : h + d2], mode="clip")
                np.take(self.table, ids[2 * k + 1], axis=1, out=x[h + d2 : -1], mode="clip")
                np.matmul(self.gates[d], x, out=z)
                np.tanh(z, out=z)
                sigmoid += 1
                np.multiply(i, g, out=kept)
                cell *= f
                cell += kept
                cell *= half
                np.tanh(cell, out=kept)
                np.multiply(o, kept, out=state)
                if d and ragged[k]:
                    # The backward direction starts at each window's own end.
                    state[:, ends[k]] = 0
                    cell[:, ends[k]] = 0
                both[k, d * h : (d + 1) * h] = state
        e = np.matmul(self.out[None], both[:, None])
        e += self.bias[:, None]
        return e.reshape(2 * t, TAGS, b)

    def viterbi(self, e: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The sequences whose best path has an item, and the tags ``[length, those]``, of emissions ``[length, tags, sequences]``.

        The inside of an item follows its own begin or inside only. The path without items is scored by the same sums, so
        that it is known exactly where it wins; only the other sequences are traced back.
        """
        trans, first = self.trans[:TAGS], self.trans[TAGS]
        free = np.ascontiguousarray(trans[:, [0, *range(1, TAGS, 2)]].T)[:, :, None]
        kinds = np.arange(1, TAGS, 2)
        from_begin, from_inside = trans[kinds, kinds + 1][:, None], trans[kinds + 1, kinds + 1][:, None]
        v = np.empty_like(e)
        np.add(e[0], first[:, None], out=v[0])
        v[0, 2::2] = -1e9
        none = v[0, 0].copy()
        sums = np.empty((free.shape[0], TAGS, e.shape[2]), np.float32)
        best, grown = np.empty((free.shape[0], e.shape[2]), np.float32), np.empty((2, len(TYPES), e.shape[2]), np.float32)
        plain = np.zeros(len(lengths), bool)
        stops = set((lengths - 1).tolist())
        for k in range(len(e)):
            if k:
                p = v[k - 1]
                np.add(p[None], free, out=sums)
                np.max(sums, 1, out=best)
                np.add(best[0], e[k, 0], out=v[k, 0])
                np.add(best[1:], e[k, 1::2], out=v[k, 1::2])
                np.add(p[1::2], from_begin, out=grown[0])
                np.add(p[2::2], from_inside, out=grown[1])
                np.maximum(grown[0], grown[1], out=grown[0])
                np.add(grown[0], e[k, 2::2], out=v[k, 2::2])
                none += trans[0, 0]
                none += e[k, 0]
            if k in stops:
                last = lengths == k + 1
                plain[last] = v[k][:, last].max(0) <= none[last]
        other = np.flatnonzero((lengths > 0) & ~plain)
        v, ends = np.ascontiguousarray(v[:, :, other]), lengths[other]
        allowed = trans.copy()
        allowed[:, 2::2] = -1e9
        allowed[kinds, kinds + 1], allowed[kinds + 1, kinds + 1] = trans[kinds, kinds + 1], trans[kinds + 1, kinds + 1]
        tags = np.zeros((len(e), len(other)), np.int8)
        stops = set((ends - 1).tolist())
        now = np.zeros(len(other), np.int64)
        for k in range(int(ends.max(initial=0)) - 1, -1, -1):
            before = (v[k] + allowed[:, now]).argmax(0)
            if k in stops:
                before = np.where(ends == k + 1, v[k].argmax(0), np.where(ends > k + 1, before, 0))
            now = before
            tags[k] = now
        tags[np.arange(len(e))[:, None] >= ends[None, :]] = 0
        return other, tags


@lru_cache(maxsize=1)
def model() -> Model:
    with np.load(Path(__file__).with_name("pii_weights.npz")) as arrays:
        return Model(dict(arrays))


def tag(pieces: list[str], net: Model | None = None) -> list[np.ndarray]:
    """The tags of each piece; an empty array where there is no item."""
    net = net or model()
    tags = [np.zeros(0, np.int8)] * len(pieces)
    lengths = np.array([len(p) for p in pieces], np.int64)
    codes = encode("".join(pieces))
    base = np.cumsum(lengths) - lengths
    # Every window: its piece, where it begins there, and its size.
    many = np.maximum(1, -(-(lengths - OVERLAP) // (WINDOW - OVERLAP)))
    owner = np.repeat(np.arange(len(pieces)), many)
    at = (np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)) * (WINDOW - OVERLAP)
    size = np.minimum(WINDOW, lengths[owner] - at)
    whole = many[owner] == 1
    total: dict[int, np.ndarray] = {}
    seen: dict[int, np.ndarray] = {}

    def decode(e: np.ndarray, own: np.ndarray, which: list[int]) -> None:
        for j, path in zip(*(lambda hit, paths: (hit.tolist(), paths.T))(*net.viterbi(e, own))):
            tags[which[j]] = path[: own[j]]

    for group in (True, False):
        order = np.flatnonzero((whole == group) & (size > 0))
        order = order[np.argsort(size[order], kind="stable")]
        for q in range(0, len(order), ROWS):
            part = order[q : q + ROWS]
            own = size[part]
            e = net.emissions(_windows(codes, base[owner[part]] + at[part], own), own)
            if group:
                decode(e, own, owner[part].tolist())
                continue
            for j, (k, a, m) in enumerate(zip(owner[part].tolist(), at[part].tolist(), own.tolist())):
                if k not in seen:
                    total[k], seen[k] = np.zeros((lengths[k], TAGS), np.float32), np.zeros((lengths[k], 1), np.float32)
                total[k][a : a + m] += e[:m, :, j]
                seen[k][a : a + m] += 1
    long = sorted(seen, key=lambda k: -lengths[k])
    while long:
        part = long[: max(1, min(ROWS, CELLS // int(lengths[long[0]])))]
        long = long[len(part) :]
        e = np.zeros((int(lengths[part[0]]), TAGS, len(part)), np.float32)
        for j, k in enumerate(part):
            e[: lengths[k], :, j] = total.pop(k) / seen.pop(k)
        decode(e, lengths[part], part)
    return tags


def _windows(codes: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """``[length, windows]`` of the codes from ``begin`` on, 0 beyond a window's size."""
    place = np.arange(int(size.max(initial=1)))[:, None]
    return np.where(place < size[None, :], codes[np.minimum(begin[None, :] + place, len(codes) - 1)], np.uint8(0))


def tag_spans(tags: np.ndarray) -> list[tuple[int, int, str]]:
    spans: list[tuple[int, int, str]] = []
    i, n = 0, len(tags)
    for i in np.flatnonzero(tags).tolist():
        kind = TYPES[(int(tags[i]) - 1) // 2]
        begins = tags[i] % 2 == 1
        if spans and not begins and spans[-1][1] == i and spans[-1][2] == kind:
            spans[-1] = (spans[-1][0], i + 1, kind)
        else:
            spans.append((i, i + 1, kind))
    return spans


def _overlapping(pattern: re.Pattern, text: str, a: int, b: int) -> tuple[int, int] | None:
    for m in pattern.finditer(text, max(0, a - 64), min(len(text), b + 64)):
        if m.start() < b and a < m.end():
            return m.span()
    return None


_DATE = re.compile(r"\d{1,2}([./-])\d{1,2}\1\d{4}|\d{4}-\d\d-\d\d")
_ADDRESS_FORM = re.compile(rf"(?:\d+[A-Za-z]?(?:-\d+)?|[{_CAP}][\w]+(?:{_S}\w+){{0,3}},?{_S}\d{{1,3}}[A-Za-z]?),?{_S}\S.*[{_CAP}\d].*", re.S)
_POSTCODE_END = re.compile(r"\s\d[A-Z]{2}\b")
_LEAD = re.compile(r"(?:By|Posted by|Written by|Text:|Von|Verfasst von|Por|Escrito por|Texto:)\s+")
_WORD_SIGN = re.compile(r"[\w'’\-]")
# Parts with a capital, apart by blanks and up to three short words (de la, van der); one part at least is no initial.
_PART = rf"(?:[^\W\d_]{{1,3}}['’])?[{_ANY_CAP}][\w'’\-]*"
_NAME_FORM = re.compile(rf"(?=(?s:.*)[{_ANY_CAP}][\w'’\-]){_PART}(?:[.,]{{0,2}}\s+(?:[^\W\d_]{{1,5}}\s+){{0,3}}{_PART})+\.?")


def checked(text: str, a: int, b: int, kind: str) -> tuple[int, int] | None:
    """The bounds of the whole item around a predicted span, or None if it lacks the form of its type."""
    if kind == "email":
        return _overlapping(EMAIL, text, a, b)
    if kind == "phone":
        span = _overlapping(PHONE, text, a, b)
        if span and _DATE.fullmatch(text[slice(*span)]):
            return None
        return span if span and 7 <= sum(map(str.isdigit, text[slice(*span)])) <= 15 else None
    if kind == "id_number":
        span = _overlapping(ID_NUMBER, text, a, b)
        if span and _DATE.fullmatch(text[slice(*span)]):
            return None
        return span if span and sum(map(str.isdigit, text[slice(*span)])) >= 5 else None
    while a > 0 and _WORD_SIGN.match(text[a]) and _WORD_SIGN.match(text[a - 1]):
        a -= 1
    while b < len(text) and _WORD_SIGN.match(text[b - 1]) and _WORD_SIGN.match(text[b]):
        b += 1
    while a < b and not text[a].isalnum():
        a += 1
    while b > a and not text[b - 1].isalnum():
        b -= 1
    if kind == "name" and (m := _LEAD.match(text, a, b)):
        a = m.end()
    if kind == "address":
        if m := _POSTCODE_END.match(text, b):
            b = m.end()
        inner = text[a:b]
        return (a, b) if _ADDRESS_FORM.fullmatch(inner) and any(map(str.isdigit, inner)) and len(re.findall(r"[^\W\d_]{2,}", inner)) >= 2 and "," in inner else None
    return (a, b) if _NAME_FORM.fullmatch(text[a:b]) else None


def find_in(sentences: list[str]) -> list[list[tuple[int, int, str]]]:
    """``(start, end, type)`` of the items in each sentence, in order and apart from each other."""
    pieces, owners = [], []
    for k, sentence in enumerate(sentences):
        at = 0
        while True:
            pieces.append(sentence[at : at + LONG])
            owners.append((k, at))
            if at + LONG >= len(sentence):
                break
            at += LONG - SHARED
    found: list[dict] = [{} for _ in sentences]
    k = 0
    while k < len(pieces):
        stop, size = k, 0
        while stop < len(pieces) and (stop == k or size + len(pieces[stop]) <= 8 * CELLS):
            size += len(pieces[stop])
            stop += 1
        for (owner, at), tags in zip(owners[k:stop], tag(pieces[k:stop])):
            for i, j, kind in tag_spans(tags):
                span = checked(sentences[owner], at + i, at + j, kind)
                if span:
                    found[owner].setdefault(span, kind)
        k = stop
    out = []
    for items in found:
        kept: list[tuple[int, int, str]] = []
        for (i, j), kind in sorted(items.items(), key=lambda x: (x[0][0], -x[0][1])):
            if not kept or i >= kept[-1][1]:
                kept.append((i, j, kind))
        out.append(kept)
    return out


def find(texts: list[str | None]) -> list[list[tuple[int, int, str]]]:
    """The items of whole texts, which are cut into sentences as the queries do; equal sentences are read once."""
    cuts = [_CUT.split(text or "") for text in texts]
    distinct = [s for s in dict.fromkeys(s for own in cuts for s in own) if s]
    found = dict(zip(distinct, find_in(distinct)))
    out = []
    for own in cuts:
        items: list[tuple[int, int, str]] = []
        at = 0
        for sentence in own:
            items += [(at + i, at + j, kind) for i, j, kind in found.get(sentence, ())]
            at += len(sentence) + 1
        out.append(items)
    return out


def _sentences(body: Column) -> Column:
    return F.array_distinct(F.split(body, SPLIT, -1))


def _key() -> tuple[Column, Column]:
    """Two 64-bit hashes of a sentence, as one hash alone would meet its like in a collection of 10^10 sentences."""
    return F.xxhash64("sentence").alias("h"), F.xxhash64("sentence", F.lit(1)).alias("h2")


def _marked(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``placed(item_kind, item_id, h, h2)``, the sentences of each item, and ``found(h, h2, sentence, items)`` of the distinct
    sentences that hold something, with ``items(pii_type, pii_value, begin, end)``."""
    sentences = items.where("body is not null and body != ''").select("item_kind", "item_id", F.explode(_sentences("body")).alias("sentence")).where("sentence != ''")
    schema = "sentence string, items array<struct<pii_type: string, pii_value: string, begin: int, end: int>>"

    def run(texts: list) -> dict[str, list]:
        hits = [(t, own) for t, own in zip(texts, find_in(texts)) if own]
        return {
            "sentence": [t for t, _ in hits],
            "items": [[{"pii_type": kind, "pii_value": t[a:b], "begin": a, "end": b} for a, b, kind in own] for t, own in hits],
        }

    found = map_columns(sentences.select("sentence").distinct(), run, schema)
    return sentences.select("item_kind", "item_id", *_key()), found.select(*_key(), "sentence", "items")


def personal_items(items: DataFrame) -> DataFrame:
    """``item_kind, item_id, pii_type, pii_value`` for items ``item_kind, item_id, body``; an item's values once."""
    placed, found = _marked(items)
    values = found.select("h", "h2", F.transform("items", lambda x: F.struct(x.pii_type, x.pii_value)).alias("items"))
    return placed.join(values, ["h", "h2"]).select("item_kind", "item_id", F.inline("items")).distinct()


def masked(text: str, found: list[tuple[int, int, str]]) -> str:
    out, at = [], 0
    for a, b, kind in found:
        out += [text[at:a], PLACEHOLDER[kind]]
        at = b
    return "".join([*out, text[at:]])


def masked_items(items: DataFrame) -> DataFrame:
    """``item_kind, item_id, masked`` of every item; a text that stands twice under one id is one item's text twice.

    The changed sentences of an item come to its rows as a map, no larger than its texts, and are put in their places there.
    """
    placed, found = _marked(items)
    own = (
        placed.join(found.select("h", "h2", "sentence", "items"), ["h", "h2"])
        .groupBy("item_kind", "item_id")
        .agg(F.collect_set(F.struct("sentence", "items")).alias("changes"))
    )

    def run(kinds: list, ids: list, bodies: list, changes: list) -> dict[str, list]:
        out = []
        for body, own in zip(bodies, changes):
            if own:
                new = {c["sentence"]: masked(c["sentence"], [(x["begin"], x["end"], x["pii_type"]) for x in c["items"]]) for c in own}
                cuts = [(0, 0), *(m.span() for m in _CUT.finditer(body)), (len(body), len(body))]
                parts = []
                for (_, a), (b, c) in zip(cuts, cuts[1:]):
                    parts += [new.get(body[a:b], body[a:b]), body[b:c]]
                body = "".join(parts)
            out.append(body)
        return {"item_kind": kinds, "item_id": ids, "masked": out}

    joined = items.select("item_kind", "item_id", "body").join(own, ["item_kind", "item_id"], "left")
    return map_columns(joined.select("item_kind", "item_id", "body", "changes"), run, "item_kind string, item_id bigint, masked string")
