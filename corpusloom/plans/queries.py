"""Queries of the core operators, by name: each takes a session and a data folder and reads whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.functions import urls
from corpusloom.operators import crawl, dedup, index, providers, retrieval, rules, summaries
from corpusloom.plans.lineage import cut
from corpusloom.sources import snapshot
from corpusloom.sources.html import extract_page
from corpusloom.sources.tables import table
from corpusloom.streaming import sessions

QUESTION = "How long does it take to repair the array and the panel in the workshop?"


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "text")


def _chunk_rows(spark: SparkSession, d: str) -> DataFrame:
    """Delivered chunks once: of rows with one id the first by content and source."""
    rows = table(spark, d, "chunks").groupBy("chunk_id").agg(F.min(F.struct("content", "source")).alias("c"))
    return rows.select(F.col("chunk_id").alias("doc_id"), F.col("c.content").alias("text"), F.col("c.source").alias("source"))


def _canonical_pages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "crawled_pages").withColumn("canonical", urls.plain_canonical(F.col("url")))


def tokenize_docs(spark, d):
    t = index.tokenized(_documents(spark, d))
    return t.select("doc_id", F.array_join("tokens", " ").alias("tokens"))


def term_freq(spark, d):
    return index.term_frequencies(index.tokenized(_documents(spark, d)))


def doc_length(spark, d):
    return index.document_lengths(index.tokenized(_documents(spark, d)))


def doc_freq(spark, d):
    return index.document_frequencies(index.term_frequencies(index.tokenized(_documents(spark, d))))


def corpus_stats(spark, d):
    s = index.corpus_statistics(index.document_lengths(index.tokenized(_documents(spark, d))))
    return s.select("n", F.round("avgdl", 6).alias("avgdl"))


def bm25_scores(spark, d):
    return retrieval.scan(_documents(spark, d), QUESTION).select("doc_id", F.round("score", 6).alias("score"))


def bm25_topk(spark, d):
    best = retrieval.best_of_one(retrieval.scan(_documents(spark, d), QUESTION))
    return best.select("doc_id", F.round("score", 6).alias("score"))


def _questions(spark, d):
    return table(spark, d, "questions").select("qid", "question")


def bm25_topk_batch(spark, d):
    """Every question against every document."""
    hits = retrieval.top_documents(_documents(spark, d), _questions(spark, d))
    return hits.select("qid", "rank", "doc_id", F.round("score", 6).alias("score"))


def retrieve_with_fallback(spark, d):
    found = retrieval.retrieve_documents(_documents(spark, d), _questions(spark, d))
    return found.select("qid", "rank", "doc_id", F.round("score", 6).alias("score"))


def chunk_text(spark, d):
    chunks = index.chunk_pages(table(spark, d, "crawled_pages"))
    return chunks.select("page_id", "chunk_pos", "content")


def chunk_counts(spark, d):
    return index.chunk_pages(table(spark, d, "crawled_pages")).groupBy("page_id").agg(F.count("*").alias("n_chunks"), F.sum(F.length("content")).alias("n_chars"))


def chunk_bm25_topk(spark, d):
    """The question against windows of all pages; a window is known by its page and place."""
    chunks = index.chunk_pages(table(spark, d, "crawled_pages")).select(F.struct("page_id", "chunk_pos").alias("doc_id"), F.col("content").alias("text"))
    best = retrieval.best_of_one(retrieval.scan(chunks, QUESTION))
    return best.select("doc_id.page_id", F.col("doc_id.chunk_pos").cast("bigint").alias("chunk_pos"), F.round("score", 6).alias("score"))


def split_sentences(spark, d):
    s = tx.sentences(F.col("text"))
    return _documents(spark, d).select("doc_id", F.posexplode(s).alias("pos", "sentence"))


def sentence_overlap(spark, d):
    """How many of a sentence's words the question has, for every sentence."""
    q = F.array(*[F.lit(w) for w in QUESTION_WORDS])
    s = _documents(spark, d).select("doc_id", F.posexplode(tx.sentences(F.col("text"))).alias("pos", "sentence"))
    return s.select("doc_id", "pos", summaries.overlap(tx.tokens(F.col("sentence")), q).alias("score"))


QUESTION_WORDS = "long does take repair array panel workshop".split()


def _retrieved(spark, d):
    """Retrieved chunk texts of every question."""
    chunks = cut(_chunk_rows(spark, d))
    found = retrieval.retrieve_documents(chunks, _questions(spark, d))
    return found.join(chunks, "doc_id").join(F.broadcast(_questions(spark, d)), "qid").select("qid", "question", "rank", "doc_id", F.col("text").alias("content"), "source")


def local_summary(spark, d):
    return summaries.summary_sentences(_retrieved(spark, d))


def source_list(spark, d):
    return summaries.source_lists(_retrieved(spark, d)).select("qid", F.array_join("sources", " ").alias("sources"))


def local_answer(spark, d):
    a = summaries.local_answers(_retrieved(spark, d), _questions(spark, d))
    return a.select("qid", "answer", F.array_join("sources", " ").alias("sources"))


def context_block(spark, d):
    return summaries.context_blocks(_retrieved(spark, d))


def follow_up_answer(spark, d):
    return summaries.follow_up_answers(_retrieved(spark, d), _questions(spark, d), rules.follow_up)


def chat_prompts(spark, d):
    """What a chat model would be asked, at a fixed moment."""
    found, now = _retrieved(spark, d), F.to_timestamp(F.lit("2024-05-01 12:00:00"))
    return summaries.prompts(found, _questions(spark, d), now).select("qid", "system", "user")


def document_ordinals(spark, d):
    """The place of every window of every page."""
    chunks = index.chunk_pages(table(spark, d, "crawled_pages")).select("page_id", "chunk_pos")
    return index.ordinals(chunks, "page_id", "chunk_pos")


def crawl_log(spark, d):
    return crawl.crawl_log(table(spark, d, "site_snapshot"), text=False)


def crawl_outcomes(spark, d):
    return crawl.crawl_log(table(spark, d, "site_snapshot"))


def crawl_site(spark, d):
    """A crawl of the first site by address, over its snapshot."""
    pages = table(spark, d, "site_snapshot")
    first = pages.where("kind = 'html' and status = 200").agg(F.min("url")).first()[0]
    found = crawl.crawl(pages, first)
    return found.select("url", "title", "depth", "page_ord", F.size("links").alias("n_links"))


def parsed_frames(spark, d):
    """Messages read back from their frames, and raw texts read as frames, most of which they aren't."""
    m = table(spark, d, "client_messages")
    wire = m.where("text is not null").select("session_id", "ts", F.col("text").alias("value")).unionByName(m.select("session_id", "ts", F.to_json(F.struct("type", "text")).alias("value")))
    return sessions.parsed_frames(wire)


def error_messages(spark, d):
    return table(spark, d, "provider_outcomes").where("not ok").select("outcome_id", providers.error_message(F.col("message")).alias("error"))


def failure_report(spark, d):
    return providers.failure_report(table(spark, d, "provider_outcomes"))


def resting_providers(spark, d):
    """The providers that still rest at each session's last attempt."""
    o = table(spark, d, "provider_outcomes")
    now = o.groupBy("session_id").agg(F.max("ts").alias("now"))
    ends = providers.cooldowns(o).groupBy("session_id").agg(F.map_from_entries(F.collect_list(F.struct("provider", "until"))).alias("ends"))
    resting = ends.join(now, "session_id").select("session_id", providers.active(F.col("ends"), F.col("now")).alias("r"))
    return resting.where(F.size("r") > 0).select("session_id", F.array_join("r", " ").alias("resting"))


def normalize_url(spark, d):
    return table(spark, d, "crawled_pages").select("page_id", urls.canonical_url("url").alias("canonical"))


def strip_tracking(spark, d):
    return _canonical_pages(spark, d).select("page_id", "canonical")


def url_origin(spark, d):
    return _canonical_pages(spark, d).select("page_id", urls.origin(F.col("canonical")).alias("origin"))


def _page_links(spark, d):
    p = _canonical_pages(spark, d).select("page_id", "canonical", F.posexplode("links").alias("pos", "href"))
    return p.where("href is not null")


def same_origin_links(spark, d):
    p = _page_links(spark, d)
    same = urls.origin(F.col("canonical")) == urls.origin(urls.plain_canonical(F.col("href")))
    return p.select("page_id", "pos", same.alias("same_origin"))


def crawlable_links(spark, d):
    p = _page_links(spark, d)
    return p.where(urls.crawlable(F.col("href")) & ~urls.administrative(F.col("href"))).groupBy("page_id").agg(F.count("*").alias("n_links"))


def link_targets(spark, d):
    """Pages by how many other pages link to them."""
    p = _page_links(spark, d).select("page_id", urls.plain_canonical(F.col("href")).alias("target")).where("target is not null").distinct()
    return p.groupBy("target").agg(F.count("*").alias("n_pages"))


def fetch_join(spark, d):
    """Links whose target is a crawled page."""
    targets = _canonical_pages(spark, d).groupBy("canonical").agg(F.min("page_id").alias("target_page"))
    p = _page_links(spark, d).select("page_id", "pos", urls.plain_canonical(F.col("href")).alias("canonical"))
    return p.join(targets, "canonical").select("page_id", "pos", "target_page")


def frontier_anti_visited(spark, d):
    """Link targets that no crawled page has."""
    targets = _page_links(spark, d).select(urls.plain_canonical(F.col("href")).alias("url")).where("url is not null").distinct()
    return targets.join(_canonical_pages(spark, d).select(F.col("canonical").alias("url")), "url", "left_anti")


def bfs_reach(spark, d):
    """Least depth of what is within three links of the pages of depth 0."""
    pages = _canonical_pages(spark, d)
    edges = _page_links(spark, d).select(F.col("canonical").alias("src"), urls.plain_canonical(F.col("href")).alias("dst")).where("dst is not null and src is not null")
    seeds = pages.where("depth = 0 and canonical is not null").select(F.col("canonical").alias("url"))
    return crawl.reach(edges, seeds, 3)


def collapse_ws(spark, d):
    return _documents(spark, d).select("doc_id", tx.collapse(F.col("text")).alias("text"))


def truncate_text(spark, d):
    return _documents(spark, d).select("doc_id", tx.truncate(F.col("text"), 4000).alias("text"))


def meaningful_text(spark, d):
    lines = _documents(spark, d).select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return lines.select("doc_id", "pos", tx.meaningful(F.col("line")).alias("line")).where("line is not null")


def prefix_dedup(spark, d):
    """Every page's lines with repeated beginnings taken out, joined again."""
    lines = table(spark, d, "crawled_pages").select("page_id", F.posexplode(F.split("text", "\n")).alias("pos", "block"))
    return dedup.joined_blocks(dedup.prefix_dedup(lines))


def _sites(spark, d):
    p = _canonical_pages(spark, d).where("canonical is not null")
    host = F.regexp_extract("canonical", r"^https?://([^/:?#]+)", 1)
    return p.select(urls.origin(F.col("canonical")).alias("site"), host.alias("host"), "title", "text", "links", F.col("page_id").alias("ord"))


def site_corpus(spark, d):
    return rules.site_corpora(_sites(spark, d)).select("site", F.md5("corpus").alias("corpus_md5"), F.length("corpus").cast("bigint").alias("n_chars"))


def suggestion_scores(spark, d):
    return rules.suggestion_scores(rules.site_corpora(_sites(spark, d)))


def site_name(spark, d):
    return rules.site_names(_sites(spark, d))


def site_suggestions(spark, d):
    s = _sites(spark, d)
    return rules.suggestions(rules.site_corpora(s), rules.site_names(s)).select("site", F.array_join("suggestions", " | ").alias("suggestions"))


def decision_criteria(spark, d):
    q = table(spark, d, "questions").where("question is not null")
    return q.select("qid", rules.has_criteria(F.col("question")).alias("has_criteria"))


def decision_followup(spark, d):
    """Follow-ups to every message."""
    m = table(spark, d, "client_messages").where("text is not null").select("text").distinct()
    return m.select("text", rules.follow_up(F.col("text")).alias("follow_up"))


def fetched_pages(spark, d):
    f = snapshot.fetched(table(spark, d, "site_snapshot"))
    return f.select("url", F.length("body").cast("bigint").alias("n_chars"))


def _home_pages(spark, d):
    f = snapshot.fetched(table(spark, d, "site_snapshot"))
    return f.select("url", extract_page("body", "url").alias("page"))


def page_title(spark, d):
    return _home_pages(spark, d).select("url", "page.title")


def page_links(spark, d):
    return _home_pages(spark, d).select("url", F.posexplode("page.links").alias("pos", "link"))


def html_text_blocks(spark, d):
    return _home_pages(spark, d).select("url", F.posexplode("page.blocks").alias("pos", "b")).select("url", "pos", "b.phase", "b.text")


def html_page_text(spark, d):
    return _home_pages(spark, d).select("url", "page.text")


def sitemap_locs(spark, d):
    f = snapshot.fetched(table(spark, d, "site_snapshot"), "text")
    return f.select("url", F.posexplode(snapshot.sitemap_locs(F.col("body"))).alias("pos", "loc"))


def robots_sitemaps(spark, d):
    f = snapshot.fetched(table(spark, d, "site_snapshot"), "text").where(F.col("url").endswith("/robots.txt"))
    return f.select("url", F.explode(snapshot.robots_sitemaps(F.col("body"))).alias("sitemap"))


def safe_json(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


def session_replay(spark, d):
    return sessions.replay(table(spark, d, "client_messages"))


def provider_failover(spark, d):
    return providers.failover(table(spark, d, "provider_outcomes"))


def provider_cooldowns(spark, d):
    return providers.cooldowns(table(spark, d, "provider_outcomes"))


def provider_rotation(spark, d):
    """Where each session's next attempt begins: one further with every success."""
    names = F.array(*[F.lit(p) for p in ("google", "groq", "ollama", "openrouter")])
    o = table(spark, d, "provider_outcomes").groupBy("session_id").agg(F.count_if("ok").alias("n"))
    return o.select("session_id", F.array_join(providers.rotated(names, F.col("n").cast("int")), " ").alias("attempts"))


QUERIES = {
    f.__name__: f
    for f in (
        tokenize_docs, term_freq, doc_length, doc_freq, corpus_stats, bm25_scores, bm25_topk, bm25_topk_batch, retrieve_with_fallback, chunk_text, chunk_counts, chunk_bm25_topk, split_sentences,
        sentence_overlap, local_summary, source_list, local_answer, context_block, follow_up_answer, chat_prompts, document_ordinals, crawl_log, crawl_outcomes, crawl_site, parsed_frames,
        error_messages, failure_report, resting_providers, normalize_url, strip_tracking, url_origin, same_origin_links, crawlable_links, link_targets, fetch_join, frontier_anti_visited,
        bfs_reach, collapse_ws, truncate_text, meaningful_text, prefix_dedup, site_corpus, suggestion_scores, site_name, site_suggestions, decision_criteria, decision_followup, fetched_pages,
        page_title, page_links, html_text_blocks, html_page_text, sitemap_locs, robots_sitemaps, safe_json, session_replay, provider_failover, provider_cooldowns, provider_rotation,
    )
}
