"""Ranked retrieval over the index: Okapi BM25 by joins, top lists, and the fall-back list."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import STOPWORDS, tokens
from corpusloom.operators.index import K1, B, Index
from corpusloom.plans.lineage import cut

#: Pairs of question and term that are sent to every task at once; more questions take more passes over the documents.
ASKED_PAIRS = 200_000
#: Documents whose scores for all questions are held at once.
DOC_BLOCK = 128

SCORED, USED, FALLBACK = 10, 8, 5

_WORD = re.compile("[a-z0-9]{2,}")
_STOPPED = frozenset(STOPWORDS)


def question_terms(questions: DataFrame) -> DataFrame:
    """``qid, term``: each question's distinct terms."""
    return questions.select("qid", F.explode(F.array_distinct(tokens(F.col("question")))).alias("term"))


def bm25(index: Index, terms: DataFrame) -> DataFrame:
    """``qid, doc_id, score`` of every document that shares a term with a question.

    The terms' document frequencies join first, so only postings of asked terms take part; the sum combines before the
    shuffle.
    """
    asked = terms.join(index.terms, "term")
    n, avgdl = F.col("n"), F.when(F.col("avgdl") == 0, 1.0).otherwise(F.col("avgdl"))
    dl = F.when(F.col("dl") == 0, 1).otherwise(F.col("dl"))
    idf = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * dl / avgdl))
    weighted = asked.join(F.broadcast(index.stats))
    return index.postings.join(weighted, "term").select("qid", "doc_id", part.alias("part")).groupBy("qid", "doc_id").agg(F.sum("part").alias("score"))


def scan(docs: DataFrame, question: str, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``doc_id, score`` (the id of any type that has an order) for one question without an index: equal to ``bm25``, by two passes and no shuffle of postings.

    Each row counts the question's terms in its own tokens; one row of corpus statistics goes to every task.
    """
    terms = list(dict.fromkeys(plain_tokens(question)))

    def counted(words: Column) -> Column:
        # One walk over the tokens for each term of the question, which are few.
        count = lambda term: F.size(F.filter(words, lambda w: w == F.lit(term))).cast("bigint")
        hits = F.array(*map(count, terms)).cast("array<bigint>")
        return F.struct(F.size(words).cast("bigint").alias("dl"), hits.alias("hits"))

    row = F.transform(F.array(tokens(F.col(text_col))), counted)[0]
    rows = docs.select(F.col(id_col).alias("doc_id"), row.alias("c")).select("doc_id", "c.dl", "c.hits")
    frequencies = [F.count_if(F.col("hits")[i] > 0).alias(f"df{i}") for i in range(len(terms))]
    stats = rows.agg(F.count("*").alias("n"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avgdl"), *frequencies)
    avgdl = F.when(F.col("avgdl") == 0, 1.0).otherwise(F.col("avgdl"))
    dl = F.greatest(F.col("dl"), F.lit(1))
    score = F.lit(0.0)
    for i in range(len(terms)):
        df, tf = F.col(f"df{i}"), F.col("hits")[i]
        idf = F.log(1 + (F.col("n") - df + 0.5) / (df + 0.5))
        score = score + F.when(tf > 0, idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))).otherwise(0.0)
    return rows.join(F.broadcast(stats)).select("doc_id", score.alias("score")).where("score > 0")


def plain_tokens(text: str) -> list[str]:
    """``tokens`` of a text at hand."""
    return [w for w in _WORD.findall(text.lower()) if w not in _STOPPED]


def best(scores: DataFrame, k: int = USED) -> DataFrame:
    """The ``k`` best documents of every question with their ``rank``; equal scores in order of id."""
    order = Window.partitionBy("qid").orderBy(F.desc(F.round("score", 9)), "doc_id")
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def best_of_one(scores: DataFrame, k: int = USED) -> DataFrame:
    """The ``k`` best documents of a single question: a top-k of every task, merged."""
    return scores.orderBy(F.desc(F.round("score", 9)), "doc_id").limit(k)


def _blocks(terms: DataFrame) -> Iterator[list[tuple]]:
    """The asked pairs ``(qid, term)`` in blocks of bounded size, each with all terms of its questions."""
    first = terms.select("qid", "term").limit(ASKED_PAIRS + 1).collect()
    if len(first) <= ASKED_PAIRS:
        if first:
            yield [(r[0], r[1]) for r in first]
        return
    n = -(-terms.count() // ASKED_PAIRS)
    for i in range(n):
        part = terms.where(F.pmod(F.xxhash64("qid"), F.lit(n)) == i)
        yield [(r[0], r[1]) for r in part.select("qid", "term").collect()]


def _measured(docs: DataFrame, asked: set[str]) -> tuple[int, float, dict[str, int]]:
    """Number and mean length of the documents, and in how many each asked term occurs: sums in the tasks, one row a term after."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, n, total = Counter(), 0, 0
        for batch in batches:
            for text in batch.column(1).to_pylist():
                words = plain_tokens(text or "")
                n, total = n + 1, total + len(words)
                found.update(asked.intersection(words))
        yield pa.RecordBatch.from_pydict({"term": [None, "", *found], "n": pa.array([n, total, *found.values()], pa.int64())}, schema=pa.schema([("term", pa.string()), ("n", pa.int64())]))

    rows = {r[0]: r[1] for r in docs.mapInArrow(run, "term string, n bigint").groupBy("term").agg(F.sum("n")).collect()}
    n, total = rows.pop(None, 0), rows.pop("", 0)
    return n, total / n if n else 0.0, rows


def _best_of_tasks(docs: DataFrame, block: list[tuple], measured: tuple[int, float, dict[str, int]], k: int) -> DataFrame:
    """``qid, doc_id, score``: each task's own ``k`` best documents of every question of the block."""
    n, avgdl, frequency = measured
    questions = sorted({q for q, _ in block})
    number = {q: i for i, q in enumerate(questions)}
    asked: dict[str, list[int]] = {}
    for q, term in block:
        if term in frequency:
            asked.setdefault(term, []).append(number[q])
    weights = {t: (float(np.log(1 + (n - frequency[t] + 0.5) / (frequency[t] + 0.5))), np.array(qs)) for t, qs in asked.items()}
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = np.zeros((0, len(questions)))
        owner = np.zeros((0, len(questions)), np.int64)
        terms = shared.value
        for batch in batches:
            names, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for begin in range(0, len(names), DOC_BLOCK):
                part = texts[begin : begin + DOC_BLOCK]
                scores = np.zeros((len(part), len(questions)))
                for row, text in zip(scores, part):
                    words = plain_tokens(text or "")
                    norm = K1 * (1 - B + B * max(1, len(words)) / (avgdl or 1.0))
                    for term, tf in Counter(w for w in words if w in terms).items():
                        idf, qs = terms[term]
                        row[qs] += idf * tf * (K1 + 1) / (tf + norm)
                ids = np.array(names[begin : begin + DOC_BLOCK], np.int64)
                everything = np.concatenate([top, scores])
                whose = np.concatenate([owner, np.repeat(ids[:, None], len(questions), 1)])
                order = np.lexsort((whose, -np.round(everything, 9)), axis=0)[:k]
                top, owner = np.take_along_axis(everything, order, 0), np.take_along_axis(whose, order, 0)
        place, q = np.nonzero(top > 0)
        yield pa.RecordBatch.from_pydict({"q": pa.array(q, pa.int32()), "doc_id": pa.array(owner[place, q], pa.int64()), "score": pa.array(top[place, q], pa.float64())})

    found = docs.mapInArrow(run, "q int, doc_id bigint, score double")
    names = docs.sparkSession.createDataFrame(list(enumerate(questions)), "q int, qid bigint") if questions else None
    return found.join(F.broadcast(names), "q").select("qid", "doc_id", "score") if questions else found.select(F.col("q").cast("bigint").alias("qid"), "doc_id", "score")


def top_documents(docs: DataFrame, questions: DataFrame, k: int = USED) -> DataFrame:
    """``qid, doc_id, score, rank``: the ``k`` best of ``docs(doc_id, text)`` for every question, by two passes over the texts.

    Every document is scored against all questions where it lies, and a task hands on only its ``k`` best of each question, so
    that a term which occurs everywhere costs additions and no shuffle. Equal to ``best(bm25(...))``.
    """
    source = docs.select("doc_id", "text")
    blocks = list(_blocks(question_terms(questions.select("qid", "question")).distinct()))
    measured = _measured(source, {t for block in blocks for _, t in block}) if blocks else (0, 0.0, {})
    parts = [_best_of_tasks(source, block, measured, k) for block in blocks or [[]]]
    return best(reduce(DataFrame.unionByName, parts), k)


def retrieve_documents(docs: DataFrame, questions: DataFrame, k: int = USED, fallback: int = FALLBACK) -> DataFrame:
    """``retrieve`` without an index."""
    return _with_fallback(top_documents(docs, questions, k), docs, questions, fallback)


def retrieve(index: Index, questions: DataFrame, k: int = USED, fallback: int = FALLBACK) -> DataFrame:
    """``qid, doc_id, rank, score`` for every question; where nothing matches, the first documents with score 0."""
    return _with_fallback(best(bm25(index, question_terms(questions)), k), index.lengths, questions, fallback)


def _with_fallback(hits: DataFrame, docs: DataFrame, questions: DataFrame, fallback: int) -> DataFrame:
    hits = cut(hits)
    unanswered = questions.select("qid").distinct().join(hits.select("qid").distinct(), "qid", "left_anti")
    first = docs.select("doc_id").orderBy("doc_id").limit(fallback)
    order = Window.partitionBy("qid").orderBy("doc_id")
    rest = unanswered.join(F.broadcast(first)).select("qid", "doc_id", F.lit(0.0).alias("score"))
    return hits.select("qid", "doc_id", "score", "rank").unionByName(rest.withColumn("rank", F.row_number().over(order)))
