"""Problem 10: text statistics of every document by mergeable partial counts, and the rules that tell prose from the rest.

Documents are cut into chunks of ``CHUNK`` characters wherever the cut falls. The state of a chunk is its counts over whole
blank-separated tokens and whole lines, plus what the cuts left open: the token fragment at either end, and the last sign
of the line fragment at either end. Two neighbouring states merge to the state of their joined text, in any grouping, so
the chunks of a document merge as a tree of ``FAN`` states a step.

Statistics: ``words`` (runs of letters or digits), ``mean_word_length``, ``sign_share`` (neither blank, letter nor digit, of
the characters that are not blank), ``punctuated_lines`` (share of the lines with text that end in ``.!?…``),
``common_share`` (words in the given list) and ``ends_per_word`` (tokens that end like a sentence).

Defined results: for NULL and blank texts counts are 0, shares NULL and no rule applies. Rows of one id, or of none, are
counted apart. Extra columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import map_columns
from corpusloom.plans.lineage import cut

CHUNK = 16_384
FAN = 16

#: Rules: a document that breaks one is not natural prose.
MAX_SIGN_SHARE = 0.2
MIN_COMMON_SHARE = 0.1
MIN_ENDS_PER_WORD = 0.03

COUNTS = ("chars", "solid", "alnum", "words", "common", "ends", "lines", "closed_lines")
_WORD = re.compile(r"[^\W_]+")
_END = re.compile(r"(?:[^\W\d_]|%)[\"'”’)\]]*[.!?…]+[\"'”’)\]»]*(?!\S)")
_CLOSING = ".!?…"
_QUOTES = "\"'”’)]»"

#: (counts, head fragment, tail fragment or None if no blank was seen, newline seen, last sign of the head and tail line)
State = tuple[list, str, "str | None", bool, str, str]


def _line_end(line: str) -> str:
    """The sign that a line ends in, closing quotes aside; '' for a blank line, '"' for quotes alone."""
    bare = line.rstrip()
    return bare.rstrip(_QUOTES)[-1:] or bare[-1:]


def _of_tokens(text: str, common: frozenset) -> list:
    words = _WORD.findall(text)
    return [
        0, 0, sum(map(len, words)), len(words), sum(w in common for w in map(str.lower, words)), len(_END.findall(text)), 0, 0,
    ]


def state_of(text: str, common: frozenset) -> State:
    """The state of a piece of text whose neighbours are unknown."""
    tokens = text.split()
    counts = [len(text), sum(map(len, tokens)), 0, 0, 0, 0, 0, 0]
    lines = text.split("\n")
    newline = len(lines) > 1
    for line in lines[1:-1]:
        end = _line_end(line)
        counts[6] += end != ""
        counts[7] += end != "" and end in _CLOSING
    first, last = _line_end(lines[0]), _line_end(lines[-1])
    if not tokens:
        return counts, "", ("" if text else None), newline, first, last
    if len(tokens) == 1 and len(tokens[0]) == len(text):
        return counts, text, None, newline, first, last
    head = "" if text[0].isspace() else tokens[0]
    tail = "" if text[-1].isspace() else tokens[-1]
    inner = text[len(head) : len(text) - len(tail)]
    return [a + b for a, b in zip(counts, _of_tokens(inner, common))], head, tail, newline, first, last


def merge(a: State, b: State, common: frozenset) -> State:
    """The state of the text of ``a`` followed by that of ``b``."""
    counts = [x + y for x, y in zip(a[0], b[0])]
    if a[2] is None and b[2] is None:
        head, tail = a[1] + b[1], None
    elif a[2] is None:
        head, tail = a[1] + b[1], b[2]
    elif b[2] is None:
        head, tail = a[1], a[2] + b[1]
    else:
        counts = [x + y for x, y in zip(counts, _of_tokens(a[2] + b[1], common))]
        head, tail = a[1], b[2]
    joined = b[4] or a[5]
    if a[3] and b[3]:
        counts[6] += joined != ""
        counts[7] += joined != "" and joined in _CLOSING
    first = a[4] if a[3] else joined
    last = b[5] if b[3] else joined
    return counts, head, tail, a[3] or b[3], first, last


def closed(s: State, common: frozenset) -> list:
    """The counts of a whole document."""
    counts = [x + y for x, y in zip(s[0], _of_tokens(s[1], common))]
    if s[2]:
        counts = [x + y for x, y in zip(counts, _of_tokens(s[2], common))]
    for end in (s[4], s[5]) if s[3] else (s[5],):
        counts[6] += end != ""
        counts[7] += end != "" and end in _CLOSING
    return counts


_STATE = "counts array<bigint>, head string, tail string, newline boolean, first string, last string"


def _names(s: State) -> dict:
    return dict(zip(("counts", "head", "tail", "newline", "first", "last"), s))


def document_counts(docs: DataFrame, common_words: frozenset, text_col: str = "text", id_col: str = "doc_id", chunk: int = CHUNK) -> DataFrame:
    """``id`` and the counts of every document.

    Documents are cut in one pass in the scan, whatever their size, and those of one chunk are finished there; the states of the
    others travel, never their texts.
    """
    source = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("body"))

    def states(rows: list, ids: list, bodies: list) -> dict[str, list]:
        out: dict[str, list] = {"row": [], "id": [], "no": [], "n": [], "state": [], "total": []}
        for row, i, body in zip(rows, ids, bodies):
            n = max(1, -(-len(body) // chunk))
            for no in range(n):
                s = state_of(body[no * chunk : (no + 1) * chunk], common_words)
                for name, x in zip(out, (row, i, no, n, None if n == 1 else _names(s), closed(s, common_words) if n == 1 else None)):
                    out[name].append(x)
        return out

    drawn = cut(map_columns(source, states, f"row bigint, id bigint, no int, n int, state struct<{_struct()}>, total array<bigint>"))
    done = drawn.where("n = 1").select("id", "total")
    rest = drawn.where("n > 1").select("row", "id", "no", "state")
    most = rest.agg(F.max("no")).first()[0]
    while most is not None and most > 0:
        most //= FAN
        grouped = rest.groupBy("row", "id", F.expr(f"int(no div {FAN})").alias("no")).agg(F.array_sort(F.collect_list(F.struct("no", "state"))).alias("parts"))

        def together(rows: list, ids: list, nos: list, lists: list) -> dict[str, list]:
            out: dict[str, list] = {"row": rows, "id": ids, "no": nos, "state": []}
            for parts in lists:
                s = None
                for part in parts:
                    x = part["state"]
                    x = (x["counts"], x["head"], x["tail"], x["newline"], x["first"], x["last"])
                    s = x if s is None else merge(s, x, common_words)
                out["state"].append(_names(s))
            return out

        rest = map_columns(grouped.select("row", "id", "no", "parts"), together, f"row bigint, id bigint, no int, state struct<{_struct()}>")

    def finish(ids: list, found: list) -> dict[str, list]:
        return {
            "id": ids,
            "total": [closed(tuple(x[k] for k in ("counts", "head", "tail", "newline", "first", "last")), common_words) for x in found],
        }

    merged = map_columns(rest.select("id", "state"), finish, "id bigint, total array<bigint>")
    return done.unionByName(merged).select("id", *(F.col("total")[i].alias(name) for i, name in enumerate(COUNTS)))


def _struct() -> str:
    return ", ".join(f"{n}: {t}" for n, t in (x.split(" ", 1) for x in _STATE.split(", ")))


def text_quality(docs: DataFrame, common_words: frozenset, text_col: str = "text", id_col: str = "doc_id", chunk: int = CHUNK) -> DataFrame:
    """Statistics, rule outcomes and ``natural_prose`` of every document."""
    c = document_counts(docs, common_words, text_col, id_col, chunk)
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    stats = c.select(
        F.col("id").alias(id_col),
        "chars", "words",
        share("alnum", "words").alias("mean_word_length"),
        F.when(F.col("solid") > 0, (F.col("solid") - F.col("alnum")) / F.col("solid")).alias("sign_share"),
        share("closed_lines", "lines").alias("punctuated_lines"),
        share("common", "words").alias("common_share"),
        share("ends", "words").alias("ends_per_word"),
        (F.col("solid") > 0).alias("has_text"),
    )
    rules = stats.withColumns(
        {
            "too_many_signs": F.coalesce(F.col("sign_share") > MAX_SIGN_SHARE, F.lit(False)),
            "too_few_common": F.col("has_text") & (F.coalesce("common_share", F.lit(0.0)) < MIN_COMMON_SHARE),
            "too_few_ends": F.col("has_text") & (F.coalesce("ends_per_word", F.lit(0.0)) < MIN_ENDS_PER_WORD),
        }
    )
    prose = ~(F.col("too_many_signs") | F.col("too_few_common") | F.col("too_few_ends"))
    return rules.withColumn("natural_prose", F.when(F.col("has_text"), prose)).drop("has_text")
