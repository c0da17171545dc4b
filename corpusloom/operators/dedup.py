"""Blocks of a page with a common beginning: the longest stays, at the place of the first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import collapse

PREFIX = 260


def prefix_dedup(blocks: DataFrame, id_col: str = "page_id", prefix: int = PREFIX) -> DataFrame:
    """``id, pos, block`` of ``id, pos, block``: one row for each distinct beginning, empty blocks dropped."""
    t = blocks.select(id_col, "pos", collapse(F.col("block")).alias("block")).where("block != ''")
    key = F.lower(F.substring("block", 1, prefix))
    longest = F.max_by("block", F.struct(F.length("block"), -F.col("pos")))
    return t.groupBy(id_col, key.alias("beginning")).agg(F.min("pos").alias("pos"), longest.alias("block")).select(id_col, "pos", "block")


def joined_blocks(blocks: DataFrame, id_col: str = "page_id") -> DataFrame:
    """``id, text``: the blocks of each page, one a line, in order."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", "block")))
    return blocks.groupBy(id_col).agg(F.array_join(F.transform(ordered, lambda x: x["block"]), "\n").alias("text"))
