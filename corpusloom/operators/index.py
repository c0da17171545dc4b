"""The lexical index: postings, lengths, document frequencies and corpus statistics as tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import page_base, tokens, windows
from corpusloom.plans.lineage import cut

K1, B = 1.2, 0.75


@dataclass
class Index:
    """``postings(doc_id, term, tf, dl)``, ``terms(term, df)``, ``stats(n, avgdl)``; ``dl`` rides on the postings."""

    postings: DataFrame
    lengths: DataFrame
    terms: DataFrame
    stats: DataFrame

    def write(self, folder: str) -> None:
        """Keep the index as Parquet tables, postings clustered by term so that a question reads few row groups."""
        self.postings.repartitionByRange("term").sortWithinPartitions("term", "doc_id").write.mode("overwrite").parquet(f"{folder}/postings")
        for name in ("lengths", "terms", "stats"):
            getattr(self, name).write.mode("overwrite").parquet(f"{folder}/{name}")

    @staticmethod
    def read(spark, folder: str) -> Index:
        return Index(*(spark.read.parquet(f"{folder}/{name}") for name in ("postings", "lengths", "terms", "stats")))


def tokenized(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), tokens(F.col(text_col)).alias("tokens"))


def term_frequencies(docs: DataFrame) -> DataFrame:
    """``doc_id, term, tf`` of tokenised documents; counts combine before the shuffle."""
    return docs.select("doc_id", F.explode("tokens").alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("tf"))


def document_lengths(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.size("tokens").cast("bigint").alias("dl"))


def document_frequencies(tf: DataFrame) -> DataFrame:
    return tf.groupBy("term").agg(F.count("*").alias("df"))


def corpus_statistics(lengths: DataFrame) -> DataFrame:
    return lengths.agg(F.count("*").alias("n"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avgdl"))


def build_index(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", keep: bool = True) -> Index:
    """The index of ``docs``; with ``keep`` its postings are computed once, for any number of questions."""
    t = tokenized(docs, text_col, id_col)
    if keep:
        t = cut(t)
    postings = t.select("doc_id", F.size("tokens").cast("bigint").alias("dl"), F.explode("tokens").alias("term")).groupBy("doc_id", "dl", "term").agg(F.count("*").alias("tf"))
    if keep:
        postings = cut(postings)
    lengths = document_lengths(t)
    return Index(postings, lengths, document_frequencies(postings), corpus_statistics(lengths))


def chunk_pages(pages: DataFrame) -> DataFrame:
    """``page_id, chunk_pos, content, source, title`` of pages, in windows over title, address and text."""
    base = page_base(F.col("title"), F.col("url"), F.col("text"))
    return pages.select("page_id", F.posexplode(windows(base)).alias("chunk_pos", "content"), F.col("url").alias("source"), "title")


def ordinals(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with ``ordinal``, their place from 0 on in the given order, which must be one of all rows.

    Rows are sorted by range; the number of rows of each part, one row a part, says where the next begins.
    """
    placed = cut(rows.orderBy(*order).withColumn("at", F.monotonically_increasing_id()))
    part, within = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = placed.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    begins = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("begin"))
    return placed.withColumn("part", part).join(F.broadcast(begins), "part").withColumn("ordinal", F.col("begin") + within).drop("part", "begin", "at")
