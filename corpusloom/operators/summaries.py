"""Extractive answers: sentences of the retrieved texts, ranked by the words they share with the question."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import sentences, tokens

SENTENCES, SENTENCES_FALLBACK, SOURCES = 3, 2, 6

#: Frame of the answers (fixed values).
ANSWER_LEAD = "External AI providers are temporarily unavailable, so this answer is generated from the crawled website context only.\n\n"
EVIDENCE_LEAD, FOLLOW_UP_LEAD = "The site points to ", "To make this specific, "
NOTHING_FOUND = "I could not find enough relevant information in the crawled website content to answer that confidently."


def overlap(sentence_tokens: Column, question_tokens: Column) -> Column:
    """How many tokens of the sentence occur in the question, each time it occurs counted."""
    return F.size(F.filter(sentence_tokens, lambda w: F.array_contains(question_tokens, w))).cast("bigint")


def scored_sentences(retrieved: DataFrame) -> DataFrame:
    """``qid, sentence, score, ordinal`` of ``qid, question, rank, content``: equal sentences once, at their first place."""
    parts = retrieved.select("qid", "rank", tokens(F.col("question")).alias("q"), F.posexplode(sentences(F.col("content"))).alias("pos", "sentence"))
    scored = parts.select("qid", "sentence", overlap(tokens(F.col("sentence")), F.col("q")).alias("score"), F.struct("rank", "pos").alias("ordinal"))
    return scored.groupBy("qid", "sentence").agg(F.max("score").alias("score"), F.min("ordinal").alias("ordinal"))


def summary_sentences(retrieved: DataFrame) -> DataFrame:
    """``qid, rank, sentence``: the best three with a score, or else the first two."""
    s = scored_sentences(retrieved)
    by_score = Window.partitionBy("qid").orderBy(F.desc("score"), F.desc(F.length("sentence")), "ordinal")
    by_place = Window.partitionBy("qid").orderBy("ordinal")
    ranked = s.withColumns({"best": F.max("score").over(Window.partitionBy("qid")), "a": F.row_number().over(by_score), "b": F.row_number().over(by_place)})
    hit = (F.col("best") > 0) & (F.col("score") > 0) & (F.col("a") <= SENTENCES)
    miss = (F.col("best") == 0) & (F.col("b") <= SENTENCES_FALLBACK)
    return ranked.where(hit | miss).select("qid", F.when(F.col("best") > 0, F.col("a")).otherwise(F.col("b")).alias("rank"), "sentence")


def source_lists(retrieved: DataFrame, k: int = SOURCES) -> DataFrame:
    """``qid, sources``: the first ``k`` distinct addresses, best first."""
    ordered = F.array_sort(F.collect_list(F.struct("rank", "source")))
    known = retrieved.where("source is not null and source != ''")
    return known.groupBy("qid").agg(F.slice(F.array_distinct(F.transform(ordered, lambda x: x["source"])), 1, k).alias("sources"))


def local_answers(retrieved: DataFrame, questions: DataFrame) -> DataFrame:
    """``qid, answer, sources`` for every question, from the texts alone."""
    found = summary_sentences(retrieved).groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "sentence"))).alias("s"))
    text = F.concat(F.lit(ANSWER_LEAD), F.array_join(F.transform("s", lambda x: x["sentence"]), " "))
    return (
        questions.select("qid")
        .join(found, "qid", "left")
        .join(source_lists(retrieved), "qid", "left")
        .select("qid", F.when(F.col("s").isNull(), NOTHING_FOUND).otherwise(text).alias("answer"), F.coalesce("sources", F.array().cast("array<string>")).alias("sources"))
    )


def context_blocks(retrieved: DataFrame) -> DataFrame:
    """``qid, context``: the retrieved texts of each question, best first, each with its address and number."""
    source = F.when(F.coalesce("source", F.lit("")) != "", F.concat(F.lit("Source: "), "source")).otherwise("")
    block = F.concat(F.lit("---\n"), source, F.lit("\nChunk "), F.col("rank").cast("string"), F.lit(":\n"), "content")
    rows = retrieved.select("qid", "rank", block.alias("block")).groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "block"))).alias("b"))
    return rows.select("qid", F.array_join(F.transform("b", lambda x: x["block"]), "\n\n").alias("context"))


def follow_up_answers(retrieved: DataFrame, questions: DataFrame, follow_up) -> DataFrame:
    """``qid, answer`` of the questions that ask for a decision without naming what it hangs on: one observation, one question.

    ``follow_up`` gives the question to ask back of a column of questions, NULL for none.
    """
    first = summary_sentences(retrieved).where("rank = 1").select("qid", "sentence")
    asked = questions.select("qid", follow_up(F.col("question")).alias("f")).where("f is not null").distinct()
    lead = F.when(F.col("sentence").isNotNull(), F.concat(F.lit(EVIDENCE_LEAD), F.regexp_replace("sentence", r"\.$", ""), F.lit(". "))).otherwise("")
    return asked.join(first, "qid", "left").select("qid", F.concat(lead, F.lit(FOLLOW_UP_LEAD), "f").alias("answer"))


def prompts(retrieved: DataFrame, questions: DataFrame, now: Column | None = None) -> DataFrame:
    """``qid, system, user``: what a chat model is asked; the system text names the moment, the user text holds context and question."""
    moment = F.date_format(now if now is not None else F.current_timestamp(), "EEEE, MMMM d, yyyy 'at' hh:mm:ss a")
    system = F.concat(
        F.lit("You explain web sites. Answer from the context below, which outranks what you know, and say plainly what it states: names, dates, numbers. Where it is silent, say what it has instead. "
              "If you are asked for a judgement without a measure, give one observation and ask one question. It is "), moment, F.lit("."))  # fmt: skip
    user = F.concat(F.lit("Context of the site:\n"), F.coalesce("context", F.lit("")), F.lit("\n\nQuestion:\n"), F.coalesce("question", F.lit("")))
    return questions.join(context_blocks(retrieved), "qid", "left").select("qid", system.alias("system"), user.alias("user"))


class Answerer(Protocol):
    """What turns prompts into answers: ``answers(retrieved, questions)`` gives ``qid, answer, sources``."""

    name: str

    def answers(self, retrieved: DataFrame, questions: DataFrame) -> DataFrame: ...


class LocalExtractive:
    """The answerer that needs no network: sentences of the site itself."""

    name = "local"

    def answers(self, retrieved: DataFrame, questions: DataFrame) -> DataFrame:
        return local_answers(retrieved, questions)


def answerer(name: str, registered: dict[str, Answerer] | None = None) -> Answerer:
    """The answerer of a provider: those that need a network are registered by the caller, the local one is always there."""
    known = {LocalExtractive.name: LocalExtractive(), **(registered or {})}
    if name not in known:
        raise ValueError(f"no answerer for {name!r}; known are {sorted(known)}")
    return known[name]
