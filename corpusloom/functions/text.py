"""Column builders for text: white space, truncation, tokens, sentences, windows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as a browser's script engine understands it: ASCII blanks, no-break and other Unicode spaces, BOM.
SPACE = r"[\s\x{0b}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"

#: Words that carry no meaning of their own (fixed values).
STOPWORDS = (
    "a an and are as at be but by for from has have how i in is it of on or that the this to was we what when where which who why with you your"
).split()

CHUNK_SIZE, CHUNK_OVERLAP = 1400, 200
MIN_SENTENCE = 30


def collapse(text: Column) -> Column:
    """Every run of white space as one space, the ends trimmed."""
    return F.trim(F.regexp_replace(text, SPACE + "+", " "))


def truncate(text: Column, size: int = 4000) -> Column:
    """Collapsed text cut to ``size`` characters, with three dots if something was cut."""
    t = collapse(text)
    return F.when(F.length(t) <= size, t).otherwise(F.concat(F.substring(t, 1, size), F.lit("...")))


def meaningful(text: Column, least: int = 10) -> Column:
    """Collapsed text, or NULL if it is shorter than ``least``."""
    t = collapse(text)
    return F.when(F.length(t) >= F.greatest(F.lit(1), F.lit(least)), t)


def tokens(text: Column) -> Column:
    """Lower-cased runs of ASCII letters and digits of at least two characters, without stopwords; NULL text has none."""
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+")
    return F.filter(words, lambda w: (F.length(w) >= 2) & ~w.isin(STOPWORDS))


def sentences(text: Column, least: int = MIN_SENTENCE) -> Column:
    """Sentences of the collapsed text, cut after ``.!?``, of at least ``least`` characters."""
    parts = F.split(collapse(F.coalesce(text, F.lit(""))), r"(?<=[.!?])\s+")
    return F.filter(F.transform(parts, lambda s: F.trim(s)), lambda s: F.length(s) >= least)


def windows(text: Column, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> Column:
    """Overlapping character windows of the collapsed text, each trimmed; none for an empty text."""
    if not 0 <= overlap < size:
        raise ValueError("the overlap must be at least 0 and below the window size")
    step = size - overlap

    def cut(t: Column) -> Column:
        last = F.greatest(F.lit(0), F.ceil((F.length(t) - size) / F.lit(float(step)))).cast("int")
        found = F.transform(F.sequence(F.lit(0), last), lambda i: F.trim(F.substring(t, i * step + 1, F.lit(size))))
        return F.when(F.length(t) > 0, found).otherwise(F.array().cast("array<string>"))

    # Bound to a variable, so that the text is collapsed once and not for every window.
    return F.transform(F.array(collapse(text)), cut)[0]


def page_base(title: Column, url: Column, text: Column) -> Column:
    """What is cut into chunks: title line if there is a title, address, text."""
    head = F.when(F.coalesce(F.length(title), F.lit(0)) > 0, F.concat(F.lit("Title: "), title, F.lit("\n"))).otherwise(F.lit(""))
    return F.concat(head, F.lit("URL: "), url, F.lit("\n\n"), F.coalesce(text, F.lit("")))
