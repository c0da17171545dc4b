"""Problem 7: lines repeated across one host's pages, found by PrefixSpan over line identifiers.

The sequence database of a host holds one sequence of line identifiers per page. Level 1 counts, per host, the pages a
line occurs in. Longer patterns grow from every frequent line: a prefix is projected on what follows its first occurrence
in each page and extended by every later frequent line there, next to it or not, until no pattern is frequent; there is no
greatest length. Support is the number of distinct pages, and a pattern is frequent from ``min_pages`` pages and
``min_share`` of the host's pages on. Of the longer patterns the closed ones are listed, those that no longer pattern
holds with the same support: a frame of 26 lines has 67 million sub-patterns, and each has the support of the best closed
pattern that holds it.

Defined results: two lines are one line if their letters agree after lower-casing; lines without letters and NULL or empty
texts have no identifier and never count. A page whose host is NULL or cannot be read belongs to no source and has no
repeated lines, though it comes out of ``without_repeated_lines`` unchanged. Repeated rows count as pages of their own, but
ids should be unique: lines and texts are brought together by id. Extra
columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import host_of
from corpusloom.plans.lineage import cut

MIN_PAGES = 5
MIN_SHARE = 0.2


def line_sequences(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", text_col: str = "text") -> DataFrame:
    """One row per page: its id, ``host`` and ``keys``, the identifier of each line (NULL for a line without letters)."""
    letters = F.transform(
        F.split(F.col(text_col), "\n", -1),
        lambda line: F.regexp_replace(F.lower(line), r"[^\p{L}]+", ""),
    )
    keys = F.transform(letters, lambda key: F.when(key != "", F.xxhash64(key)))
    return pages.select(F.col(id_col), host_of(F.col(url_col)).alias("host"), keys.alias("keys")).where("host != ''")


def frequent_lines(sequences: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """Level 1: ``host, key, pages`` of the lines with enough distinct pages.

    A page counts a line once through ``array_distinct`` before anything is shuffled, so the counts combine map-side and a
    hot host spreads over its lines.
    """
    sizes = sequences.groupBy("host").agg(F.count("*").alias("host_pages"))
    counts = (
        sequences.select("host", F.explode(F.array_distinct("keys")).alias("key"))
        .where("key is not null")
        .groupBy("host", "key")
        .agg(F.count("*").alias("pages"))
        .where(F.col("pages") >= min_pages)
    )
    return counts.join(sizes, "host").where(F.col("pages") >= min_share * F.col("host_pages"))


def closed_patterns(sequences: list[tuple[tuple, int]], first, least: float) -> list[tuple[tuple, int]]:
    """The closed patterns of two or more items that begin with ``first``, with their support, from ``(sequence, weight)``
    of all sequences that hold ``first``.

    PrefixSpan with the tests of BIDE. Where an item can be put into a gap of the pattern in every sequence, the pattern is
    not closed; where that holds within the first occurrence in every sequence, nothing that grows from it is.
    """
    found: list[tuple[tuple, int]] = []

    def inserted(prefix: tuple, rows: list[tuple[int, list[int]]], within_first: bool) -> bool:
        """Whether one item fits into the same gap of ``prefix`` in all rows."""
        n = len(prefix)
        common: list[set | None] = [None] * n
        for k, ends in rows:
            items = sequences[k][0]
            stop = ends[-1] if within_first else len(items)
            for i in range(n - 1, -1, -1):
                stop -= 1
                while items[stop] != prefix[i]:
                    stop -= 1
                if common[i] is None or common[i]:
                    gap = items[ends[i - 1] if i else 0 : stop]
                    common[i] = set(gap) if common[i] is None else common[i].intersection(gap)
            if not any(common):
                return False
        return True

    stack = [((first,), [(k, [items.index(first) + 1]) for k, (items, _) in enumerate(sequences)])]
    while stack:
        prefix, rows = stack.pop()
        if inserted(prefix, rows, True):
            continue
        support = sum(sequences[k][1] for k, _ in rows)
        later: dict = {}
        for k, ends in rows:
            items, weight = sequences[k]
            for item in set(items[ends[-1] :]):
                later[item] = later.get(item, 0) + weight
        if len(prefix) > 1 and support not in later.values() and not inserted(prefix, rows, False):
            found.append((prefix, support))
        for item, pages in later.items():
            if pages >= least:
                grown = []
                for k, ends in rows:
                    try:
                        grown.append((k, [*ends, sequences[k][0].index(item, ends[-1]) + 1]))
                    except ValueError:
                        continue
                stack.append(((*prefix, item), grown))
    return found


def frequent_sequences(
    pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, id_col: str = "page_id"
) -> DataFrame:
    """``host, pattern`` (array of identifiers), ``length, pages``: every frequent line and every closed frequent pattern of
    two or more.

    Infrequent lines are left out first, as no frequent pattern can hold them, and equal sequences of a host are counted
    into one. A host is dealt out by the first line of the patterns, so a hot host spreads over its lines.
    """
    sequences = cut(line_sequences(pages, id_col))
    first = cut(frequent_lines(sequences, min_pages, min_share))
    lines = first.groupBy("host", "host_pages").agg(F.collect_list("key").alias("frequent"))
    kept = F.filter("keys", lambda key: F.array_contains("frequent", key))
    weighted = (
        sequences.join(lines, "host")
        .select("host", "host_pages", kept.alias("items"))
        .where(F.size("items") > 1)
        .groupBy("host", "host_pages", "items")
        .agg(F.count("*").alias("weight"))
    )

    def mine(key: tuple, part: pa.Table) -> pa.Table:
        host, host_pages, item = (x.as_py() for x in key)
        rows = [(tuple(items), n) for items, n in zip(part["items"].to_pylist(), part["weight"].to_pylist())]
        found = closed_patterns(rows, item, max(min_pages, min_share * host_pages))
        return pa.table(
            {
                "host": pa.array([host] * len(found), pa.string()),
                "pattern": pa.array([list(p) for p, _ in found], pa.list_(pa.int64())),
                "length": pa.array([len(p) for p, _ in found], pa.int32()),
                "pages": pa.array([n for _, n in found], pa.int64()),
            }
        )

    longer = (
        weighted.withColumn("item", F.explode(F.array_distinct("items")))
        .groupBy("host", "host_pages", "item")
        .applyInArrow(mine, "host string, pattern array<bigint>, length int, pages bigint")
    )
    return first.select("host", F.array("key").alias("pattern"), F.lit(1).alias("length"), "pages").unionByName(longer)


def _placed(sequences: DataFrame, frequent: DataFrame, id_col: str) -> DataFrame:
    """Every occurrence of a frequent line: ``id, host, line_no, key, pages, host_pages``."""
    lines = sequences.select(id_col, "host", F.posexplode("keys").alias("line_no", "key")).where("key is not null")
    return lines.join(frequent, ["host", "key"])


def repeated_lines(
    pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, id_col: str = "page_id"
) -> DataFrame:
    """``id, line_no`` of the lines covered by occurrences of frequent patterns of any length.

    This is level 1 alone, a count of single lines; no prefix is projected here. Support never grows with length, so each
    line of a frequent pattern is a frequent pattern itself and level 1 covers them all; longer patterns are listed by
    ``frequent_sequences``.
    """
    sequences = cut(line_sequences(pages, id_col))
    return _placed(sequences, frequent_lines(sequences, min_pages, min_share), id_col).select(
        id_col, F.col("line_no").cast("int").alias("line_no")
    )


def without_repeated_lines(
    pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, id_col: str = "page_id", text_col: str = "text"
) -> DataFrame:
    """Each page once with ``kept_text`` (its other lines, in order) and ``removed`` (the number of deleted lines).

    Only line numbers travel to the page; its text is moved once, by its id.
    """
    drop = repeated_lines(pages, min_pages, min_share, id_col).groupBy(id_col).agg(F.collect_set("line_no").alias("drop_lines"))
    joined = pages.select(id_col, text_col).join(drop, id_col, "left")
    kept = F.filter(F.split(text_col, "\n", -1), lambda line, i: ~F.array_contains("drop_lines", i))
    return joined.select(
        id_col,
        F.when(F.col("drop_lines").isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n")).alias("kept_text"),
        F.coalesce(F.size("drop_lines"), F.lit(0)).alias("removed"),
    )
