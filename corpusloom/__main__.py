"""``python -m corpusloom``: ask a crawled site questions, or check what a snapshot holds."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import crawl, index, retrieval, summaries

DEFAULT_ADDRESS = "https://example.com"


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="corpusloom", description=__doc__)
    parser.add_argument("address", nargs="?", default=DEFAULT_ADDRESS, help="where the crawl begins")
    parser.add_argument("--snapshot", required=True, help="Parquet files of the site: url, kind, status, content_type, body")
    parser.add_argument("--question", action="append", default=[], help="a question to answer; may be repeated")
    return parser.parse_args(argv)


def main(argv: list[str] | None = None) -> int:
    """Crawl the snapshot, print its pages and the answers; 1 if no page was found."""
    chosen = arguments(argv)
    spark = SparkSession.builder.getOrCreate()
    pages = crawl.crawl(spark.read.parquet(chosen.snapshot), chosen.address)
    n = pages.count()
    print(f"{n} pages from {chosen.address}")
    pages.select("page_ord", "depth", "url", "title", F.length("text").alias("chars")).orderBy("page_ord").show(truncate=80)
    if chosen.question and n:
        windows = index.chunk_pages(pages.select(F.col("page_ord").cast("bigint").alias("page_id"), "url", "title", "text"))
        docs = index.ordinals(windows, "page_id", "chunk_pos").select(F.col("ordinal").alias("doc_id"), F.col("content").alias("text"), "source")
        questions = spark.createDataFrame(list(enumerate(chosen.question)), "qid bigint, question string")
        found = retrieval.retrieve_documents(docs, questions).join(docs, "doc_id").join(questions, "qid").select("qid", "question", "rank", F.col("text").alias("content"), "source")
        for row in summaries.LocalExtractive().answers(found, questions).orderBy("qid").collect():
            print(f"{chosen.question[row['qid']]}\n{row['answer']}\n{' '.join(row['sources'])}")
    return 0 if n else 1


if __name__ == "__main__":
    raise SystemExit(main())
