"""Rule tables over sites and questions: names, suggestions, decision questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAGES, TEXT_CHARS, SUGGESTIONS = 6, 1800, 3

#: Patterns and the question each group suggests, in order (fixed values).
SUGGESTION_RULES = [
    ("pricing plan plans subscription package packages fee fees".split(), "What are the pricing plans on %s?"),
    ("service services solution solutions agency consulting".split(), "What services or solutions does %s offer?"),
    ("product products shop store cart buy order checkout".split(), "What products are featured on %s?"),
    (["portfolio", "project", "projects", "case study", "case studies", "work"], "What projects or work samples does %s showcase?"),
    (["docs", "documentation", "api", "guide", "tutorial", "getting started"], "How do I get started with %s?"),
    ("blog article articles news newsletter".split(), "What topics does %s cover?"),
    ("contact book booking appointment demo consult call".split(), "How can someone contact or book with %s?"),
    (["team", "founder", "about us", "mission", "who we are"], "Who is behind %s?"),
    ("event events schedule calendar register".split(), "What events or sessions does %s list?"),
    ("testimonial testimonials review reviews".split(), "What do clients or users say about %s?"),
]
SUGGESTION_FALLBACKS = ["What is the main purpose of %s?", "What should I know before using %s?", "What details stand out most on %s?"]

#: Words that show what a decision is about (fixed values).
CRITERIA = [
    "role", "job", "position", "task", "tasks", "workflow", "use case", "usecase", "project", "team", "budget", "timeline", "deadline", "cost", "price", "priority", "priorities",
    "requirements", "criteria", "goal", "goals", "need", "needs", "want", "wants",
]
#: Decision questions and the question that comes back, in order (fixed values).
FOLLOW_UPS = [
    ("why should i hire (him|her|them|this person)", "What role or kind of work are you hiring for?"),
    ("should i hire (him|her|them|this person)", "What role or kind of work are you hiring for?"),
    ("why should i use this website", "What day-to-day task do you want this website to help with?"),
    ("should i use this website", "What day-to-day task do you want this website to help with?"),
    ("would this work for me", "What outcome are you trying to get from it?"),
    ("is this (good|useful|worth it|right) for me", "What matters most to you here: speed, cost, ease of use, or a specific outcome?"),
    ("is he a good fit", "What role or kind of work are you evaluating him for?"),
    ("is she a good fit", "What role or kind of work are you evaluating her for?"),
    ("is it a good fit", "What role, task, or outcome are you comparing it against?"),
    ("why should i choose", "What matters most to you when choosing?"),
]


def _criteria_pattern() -> str:
    return "(?i)(?<![A-Za-z0-9_])(" + "|".join(CRITERIA) + ")(?![A-Za-z0-9_])"


def has_criteria(question: Column) -> Column:
    return question.rlike(_criteria_pattern())


def follow_up(question: Column) -> Column:
    """The question that asks for what a decision question leaves open; NULL where there is nothing to ask."""
    q = F.lower(F.trim(question))
    answer = F.lit(None).cast("string")
    for pattern, text in reversed(FOLLOW_UPS):
        answer = F.when(q.rlike(pattern), text).otherwise(answer)
    return F.when(~has_criteria(q), answer)


def name_of_host(host: Column) -> Column:
    """A site's name from its host: without ``www.`` and the last label, words with a capital."""
    bare = F.regexp_replace(F.regexp_replace(host, r"^(?i)www\.", ""), r"(?i)\.[a-z]{2,}$", "")
    words = F.trim(F.regexp_replace(bare, "[-_]+", " "))
    parts = F.split(words, r"(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])")
    raised = F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 1_000_000))), "")
    return F.when(words == "", "this site").otherwise(raised)


def site_names(pages: DataFrame) -> DataFrame:
    """``site, site_name`` of pages ``site, host, title, ord``: the first telling title's first part, else the host's name."""
    title = F.trim(F.coalesce("title", F.lit("")))
    telling = (F.length(title) >= 3) & ~F.lower(title).isin("home", "homepage", "index")
    first = F.min_by(title, F.when(telling, F.col("ord")))
    head = F.trim(F.split(F.col("first"), r"\s*[-|:]\s*")[0])
    found = pages.groupBy("site").agg(first.alias("first"), F.count_if(telling).alias("n"), F.min("host").alias("host"))
    return found.select("site", F.when((F.col("n") > 0) & (head != ""), head).otherwise(name_of_host(F.col("host"))).alias("site_name"))


def site_corpora(pages: DataFrame) -> DataFrame:
    """``site, corpus``: the beginnings of each site's first pages in lower case, with their links.

    Six rows a site at most are kept before anything is gathered.
    """
    order = Window.partitionBy("site").orderBy("ord")
    kept = pages.withColumn("n", F.row_number().over(order)).where(F.col("n") <= PAGES)
    text = F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.substring("text", 1, TEXT_CHARS), F.lit(" "), F.array_join(F.coalesce("links", F.array().cast("array<string>")), " "))
    rows = kept.select("site", "n", text.alias("t")).groupBy("site").agg(F.array_sort(F.collect_list(F.struct("n", "t"))).alias("rows"))
    return rows.select("site", F.lower(F.array_join(F.transform("rows", lambda r: r["t"]), " ")).alias("corpus"))


def suggestion_scores(corpora: DataFrame) -> DataFrame:
    """``site, rule, score``: how many of a rule's patterns the corpus holds."""
    scores = F.array(*[sum(F.contains("corpus", F.lit(p)).cast("bigint") for p in patterns) for patterns, _ in SUGGESTION_RULES])
    return corpora.select("site", F.posexplode(scores).alias("rule", "score"))


def suggestions(corpora: DataFrame, names: DataFrame) -> DataFrame:
    """``site, suggestions``: the questions of the best rules, filled up with general ones."""
    scored = suggestion_scores(corpora).where("score > 0")
    ranked = scored.groupBy("site").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "rule"))).alias("r"))
    texts = F.array(*[F.lit(t) for _, t in SUGGESTION_RULES])
    chosen = F.transform(F.coalesce("r", F.array().cast("array<struct<s:bigint,rule:int>>")), lambda x: F.element_at(texts, x["rule"] + 1))
    full = F.concat(chosen, F.array(*[F.lit(t) for t in SUGGESTION_FALLBACKS]))
    named = F.transform(full, lambda t: F.replace(t, F.lit("%s"), F.col("site_name")))
    return corpora.select("site").join(ranked, "site", "left").join(names, "site").select("site", F.slice(F.array_distinct(named), 1, SUGGESTIONS).alias("suggestions"))
