"""Problem 5: pages made of keywords, tags, product codes or links instead of sentences.

Each line is cut at sentence ends and every part is reduced to a shape: bucketed word count, how its words are
capitalised, its separators, whether it is or holds a link, whether words repeat, and how it ends. Parts of one shape are
grouped within the page. A shape is a sentence shape if it ends like a sentence, is long enough, keeps most of its words
distinct and is no list. A page is flagged when sentence shapes hold at most one part and a small share of its words, and
the few largest non-sentence shapes dominate the rest. A page of few words counts too if it holds enough items: links,
keywords set apart, or the words of a part that repeats its words. So does a page of at most one sentence whose ``links`` are
many (``MIN_LINKS``) and at least as many as its words. No word list is used: words that join others are told by their length.

All counts are taken over the whole text of a page, inside its row: nothing is shuffled.

Defined results: NULL and empty texts are not flagged, whatever their links; NULL and empty links are no links, and equal links
count once. Repeated rows are judged alike. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import map_columns

#: At least so many words outside sentences or so many items, at most so many sentences, and their share of words.
MIN_WORDS = 40
MIN_ITEMS = 10
MIN_LINKS = 100
MAX_SENTENCES = 1
MAX_SENTENCE_SHARE = 0.4
#: So many shapes are "few", and hold so much of the words outside sentences.
FEW_SHAPES = 6
DOMINANT = 0.6

_PART = re.compile(r"(?<=[.!])[\"'”’)]*\s+(?=[A-ZÀ-Þ¿¡0-9\"“(])")
_WORD = re.compile(r"[^\W_]+(?:['’-][^\W_]+)*")
_URL = re.compile(r"(?:https?://|www\.)\S+", re.I)
_APART = re.compile(r"[|,;/·•»>#–—]|\s-\s")
_ITEM = re.compile(r"[^\W_]+(?:[ '’&+.-]+[^\W_]+){0,5}")
_SEPARATORS = re.compile(r"[|,;/·•»>#_–—]|\s-\s")
#: Words that join others into sentences (articles, prepositions, pronouns) are short in the languages at hand, and not the same again and again.
_JOINING = 3


def shape(part: str) -> tuple[tuple, int, bool]:
    """``(shape, words, is a sentence)`` of one part of a line."""
    links = len(_URL.findall(part))
    bare = _URL.sub(" ", part)
    words = _WORD.findall(bare)
    n = len(words)
    if n == 0:
        return (("link" if links else "none",), links, False)
    lower = [w.lower() for w in words]
    capital = sum(w[0].isupper() for w in words)
    separators = Counter(m.group().strip() for m in _SEPARATORS.finditer(bare))
    listed = sum(separators.values())
    pairs = list(zip(lower, lower[1:]))
    repeats = len(pairs) - len(set(pairs))
    repeated = repeats >= 2 and repeats >= (0.1 if n <= 60 else 0.45) * len(pairs)
    short = [w for w in words if len(w) <= _JOINING and w.islower()]
    end = bare.rstrip(" \"'”’)»")[-1:]
    ended = end in ".!?…" and not bare.rstrip().endswith(" …")
    digits = sum(any(c.isdigit() for c in w) for w in words)
    plain = ended and n >= 4 and 1 <= capital <= max(3, 0.6 * n) and listed - separators[","] <= 0.2 * n and separators[","] <= 0.3 * n
    running = n >= 10 and len(short) >= 0.22 * n and len(set(short)) >= min(6, 0.22 * n) and listed <= 0.15 * n
    sentence = (plain or running) and not (n >= 10 and repeated) and links == 0
    size = n if n < 6 else 6 + n // 4 if n < 30 else 14
    kind = separators.most_common(1)[0][0] if listed >= 2 else ""
    caps = 0 if capital == 0 else 1 if capital == 1 else 3 if capital >= 0.7 * n else 2
    return (
        (min(size, 14), caps, kind, min(links, 1), repeated, min(digits, 3), end if ended else ""),
        n,
        sentence,
    )


def measure(text: str, stop_above: float = float("inf")) -> tuple[int, int, int, float] | None:
    """``(sentences, words in sentences, words outside, share of the largest few shapes in the words outside)``.

    None as soon as there are more than ``stop_above`` sentences: the rest of the text can't change the answer then.
    """
    sentences = inside = outside = 0
    groups: Counter = Counter()
    loose: Counter = Counter()
    for line in text.split("\n"):
        for part in _PART.split(line):
            part = part.strip()
            if not part:
                continue
            form, n, is_sentence = shape(part)
            if is_sentence:
                sentences += max(1, n // 30)
                inside += n
                if sentences > stop_above:
                    return None
            else:
                outside += n
                groups[form] += n
                loose[form[2:4]] += n
    top = max(sum(n for _, n in groups.most_common(FEW_SHAPES)), sum(n for _, n in loose.most_common(2)))
    return sentences, inside, outside, top / outside if outside else 0.0


def items(text: str) -> int:
    """Links, keywords set apart and words of repeating parts, outside sentences; placeholders and code are none."""
    count = 0
    for line in text.split("\n"):
        for part in _PART.split(line):
            form, n, is_sentence = shape(part.strip())
            if is_sentence:
                continue
            count += len(_URL.findall(part))
            if len(form) > 4 and form[4]:
                count += n
            else:
                count += sum(bool(_ITEM.fullmatch(x.strip(" .!?"))) for x in _APART.split(_URL.sub(",", part)))
    return count


def is_keyword_page(text: str | None, links: list | None = None) -> bool:
    if not text:
        return False
    found = measure(text, MAX_SENTENCES)
    if found is None:
        return False
    sentences, inside, outside, dominant = found
    own_links = len({x for x in links or () if x})
    if own_links >= max(MIN_LINKS, inside + outside):
        return True
    return (
        sentences <= MAX_SENTENCES
        and inside <= MAX_SENTENCE_SHARE * (inside + outside)
        and dominant >= DOMINANT
        and (outside >= MIN_WORDS or items(text) >= MIN_ITEMS)
    )


def keyword_pages(pages: DataFrame, text_col: str = "text", id_col: str = "page_id", links_col: str = "links") -> DataFrame:
    """The pages that are flagged: ``id``, ``sentences``, ``words_outside``, ``dominant``."""

    def run(ids: list, texts: list, links: list) -> dict[str, list]:
        out: dict[str, list] = {"id": [], "sentences": [], "words_outside": [], "dominant": []}
        for i, text, own in zip(ids, texts, links):
            if is_keyword_page(text, own):
                sentences, _, outside, dominant = measure(text)
                for k, v in zip(out, (i, sentences, outside, dominant)):
                    out[k].append(v)
        return out

    source = pages.select(F.col(id_col).alias("id"), F.col(text_col).alias("body"), F.col(links_col).alias("links")).where("body is not null and body != ''")
    found = map_columns(source, run, "id bigint, sentences int, words_outside int, dominant double")
    return found.withColumnRenamed("id", id_col)
