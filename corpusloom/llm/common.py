"""Shared helpers of the text operators."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Unicode white space as a Java and DuckDB character class: ASCII blanks, no-break, Ogham, en/em family, separators, ideographic, BOM.
SPACE_CLASS = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"


def host_of(url: Column) -> Column:
    """Host of ``url``: lower-cased, without port and leading ``www.``; NULL for NULL, '' where there is none."""
    host = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.regexp_replace(host, r"^www\.", "")


def collapsed(text: Column) -> Column:
    """``text`` with every run of Unicode white space as one space and the ends trimmed."""
    return F.trim(F.regexp_replace(text, SPACE_CLASS + "+", " "))


def map_columns(df: DataFrame, func: Callable[..., dict[str, list]], schema: T.StructType | str) -> DataFrame:
    """Run ``func`` over Arrow batches of ``df`` in Python: it gets one list per column and returns lists by name.

    ``func`` may return any number of rows. No shuffle; batches keep the order of the partition.
    """
    if isinstance(schema, str):
        schema = T._parse_datatype_string(schema)
    names = schema.fieldNames()
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = func(*(c.to_pylist() for c in batch.columns))
                yield pa.RecordBatch.from_arrays([pa.array(out[n], type=arrow.field(n).type) for n in names], schema=arrow)

    return df.mapInArrow(run, schema)
