"""Queries of the text operators and the SQL that states the same result, by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import boilerplate, keyword_pages, mixing, near_duplicates, packing, pii, repeated_lines, residue, splitting, text_quality
from corpusloom.sources.tables import table


def _pages(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return table(spark, d, "crawled_pages").select(*columns)


def _items(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Pages and chunks as ``item_kind, item_id, body``."""
    pages = table(spark, d, "crawled_pages").select(F.lit("page").alias("item_kind"), F.col("page_id").alias("item_id"), F.col("text").alias("body"))
    chunks = table(spark, d, "chunks").select(F.lit("chunk").alias("item_kind"), F.col("chunk_id").alias("item_id"), F.col("content").alias("body"))
    return pages, chunks


def _split(spark: SparkSession, d: str) -> DataFrame:
    pages, chunks = _items(spark, d)
    return splitting.split_oversized(pages, "body", splitting.PAGE_ABOVE).unionByName(
        splitting.split_oversized(chunks, "body", splitting.CHUNK_ABOVE)
    )


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Frame lines of the pages that are cases of neither problem 2 nor problem 5, which are judged on the way."""
    pages = _pages(spark, d, "page_id", "url", "title", "text", "links")
    weights = spark.sparkContext.broadcast(residue.weights())

    def excluded(tokens: list, texts: list, links: list) -> list[bool]:
        scores = residue.token_scores(weights.value, tokens)
        return [s > residue.ABOVE or keyword_pages.is_keyword_page(t, own) for s, t, own in zip(scores, texts, links)]

    return boilerplate.frame_lines(pages, excluded)


def p1_main(spark: SparkSession, d: str) -> DataFrame:
    """Each page's own words."""
    return boilerplate.main_text(_pages(spark, d, "page_id", "url", "title", "text", "links"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.residue_pages(_pages(spark, d, "page_id", "title", "text")).select("page_id")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Items that had to be cut; a chunk delivered twice is one item."""
    return _split(spark, d).where("piece_no = 0 and n_pieces > 1").select("item_kind", "item_id").distinct()


def p3_pieces(spark: SparkSession, d: str) -> DataFrame:
    """The pieces themselves; those of exact copies once."""
    return _split(spark, d).dropDuplicates(["item_kind", "item_id", "piece_no", "start", "piece"])


def p3_cover(spark: SparkSession, d: str) -> DataFrame:
    """Whether the pieces of every item that was cut make up its text: their own characters, and pieces beyond the limits."""
    own = F.col("start") + F.length("piece") - F.col("core_start")
    cut_up = p3_pieces(spark, d).where("n_pieces > 1")
    return cut_up.groupBy("item_kind", "item_id").agg(
        F.sum(own).cast("bigint").alias("n_chars"), F.count_if(F.length("piece") > splitting.LIMIT).alias("too_long"), F.count_if(F.col("core_start") - F.col("start") > splitting.OVERLAP).alias("too_much_shared")
    )


def _personal(spark: SparkSession, d: str) -> DataFrame:
    pages, chunks = _items(spark, d)
    return pages.unionByName(chunks)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Distinct values of every item; a chunk delivered twice is one item."""
    return pii.personal_items(_personal(spark, d))


def p4_masked(spark: SparkSession, d: str) -> DataFrame:
    """The texts with placeholders, a row for each row of the tables."""
    return pii.masked_items(_personal(spark, d))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return keyword_pages.keyword_pages(_pages(spark, d, "page_id", "text", "links")).select("page_id")


P6 = {"shingle": 3, "similarity": 0.7, "min_tokens": 50}


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = near_duplicates.similar_pairs(_pages(spark, d, "page_id", "text"), "text", "page_id", **P6)
    return pairs.select(F.col("id_a").alias("page_id_a"), F.col("id_b").alias("page_id_b"))


def p6_groups(spark: SparkSession, d: str) -> DataFrame:
    """Class, group and number of links of every page."""
    return near_duplicates.groups(_pages(spark, d, "page_id", "text"), "text", "page_id", **P6).withColumnRenamed("id", "page_id")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return repeated_lines.repeated_lines(_pages(spark, d, "page_id", "url", "text"))


def p7_pages(spark: SparkSession, d: str) -> DataFrame:
    return repeated_lines.without_repeated_lines(_pages(spark, d, "page_id", "url", "text"))


def p7_sequences(spark: SparkSession, d: str) -> DataFrame:
    return repeated_lines.frequent_sequences(_pages(spark, d, "page_id", "url", "text"))


def p8_packing(spark: SparkSession, d: str) -> DataFrame:
    """The container of every document under every capacity."""
    return packing.packed(table(spark, d, "documents"), table(spark, d, "container_specs"))


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    """What every container holds."""
    return packing.container_fill(p8_packing(spark, d), table(spark, d, "container_specs"))


def p8_check(spark: SparkSession, d: str) -> DataFrame:
    """For every capacity: documents that came out, pieces beyond those that the capacity forces, containers above it."""
    specs = table(spark, d, "container_specs").select("spec_id", "capacity_tokens")
    rows = p8_packing(spark, d)
    by_document = rows.groupBy("spec_id", "doc_id").agg(F.count("*").alias("n"), F.sum("piece_tokens").alias("tokens")).join(F.broadcast(specs), "spec_id")
    split = (F.col("n") > 1) & (F.col("n") > F.ceil(F.col("tokens") / F.col("capacity_tokens")))
    documents = by_document.groupBy("spec_id").agg(F.count("*").alias("documents"), F.count_if(split).alias("split_without_need"))
    full = packing.container_fill(rows, specs).groupBy("spec_id").agg(F.count_if(F.col("tokens") > F.col("capacity_tokens")).alias("overfull"))
    return specs.select("spec_id").join(documents, "spec_id").join(full, "spec_id")


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    """The chosen documents with their repeats, in shuffled order."""
    return mixing.mixed(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """The share every source reaches."""
    return mixing.mixed(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


def p9_check(spark: SparkSession, d: str) -> DataFrame:
    """For every target: its documents that have a text, and uses of documents of other sources or beyond the cap."""
    targets = table(spark, d, "mix_targets").select("source", "max_repeats")
    mix = p9_mix(spark, d).join(table(spark, d, "documents").select("doc_id", F.col("source").alias("true_source")), "doc_id")
    wrong = mix.groupBy("source").agg(F.max("repeat_no").alias("most"), F.count_if(F.col("source") != F.col("true_source")).alias("wrong"))
    rows = p9_shares(spark, d).select("source", "documents").join(wrong, "source", "left").join(F.broadcast(targets), "source")
    return rows.select("source", "documents", F.coalesce("wrong", F.lit(0)).alias("of_other_sources"), (F.coalesce("most", F.lit(0)) > F.col("max_repeats")).alias("beyond_cap"))


#: The list of common words is small by definition; a larger one is refused rather than sent to every task.
MAX_COMMON_WORDS = 100_000


def _common_words(spark: SparkSession, d: str) -> frozenset:
    words = [r[0] for r in table(spark, d, "common_words").where("word is not null").select(F.lower("word")).distinct().limit(MAX_COMMON_WORDS + 1).collect()]
    if len(words) > MAX_COMMON_WORDS:
        raise ValueError(f"common_words holds more than {MAX_COMMON_WORDS} words")
    return frozenset(words)


def p10_stats(spark: SparkSession, d: str) -> DataFrame:
    """All documents with their statistics and rule outcomes."""
    return text_quality.text_quality(table(spark, d, "documents"), _common_words(spark, d))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return p10_stats(spark, d).where("natural_prose = false").select("doc_id")


QUERIES = {f.__name__: f for f in (p1_found, p1_main, p2_found, p3_found, p3_pieces, p3_cover, p4_found, p4_masked, p5_found, p6_found, p6_groups, p7_found, p7_pages, p7_sequences, p8_packing, p8_fill, p8_check, p9_mix, p9_shares, p9_check, p10_found, p10_stats)}

_SPACE = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]+"

_HOST = r"regexp_replace(regexp_extract(lower(url), '^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1), '^www\.', '')"

#: Counts of every document; blanks are those of ``_SPACE``, letters and digits the Unicode classes L and N.
_P10 = rf"""
    with base as (
        select doc_id, coalesce(text, '') as t from documents
    ), parts as (
        select doc_id, t, regexp_extract_all(t, '[\p{{L}}\p{{N}}]+') as w, list_filter(string_split_regex(t, '{_SPACE}'), lambda x: x <> '') as tokens,
               list_filter(list_transform(string_split(t, chr(10)), lambda x: regexp_replace(x, '{_SPACE}$', '')), lambda x: regexp_matches(x, '[^\s\x{{a0}}\x{{3000}}]')) as full_lines
        from base
    ), stats as (
        select doc_id, length(t) as chars, len(w) as words, cast(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) as bigint) as alnum,
               cast(coalesce(list_sum(list_transform(tokens, lambda x: length(x))), 0) as bigint) as solid,
               solid - alnum as signs,
               len(list_filter(w, lambda x: list_contains(cw, lower(x)))) as common,
               len(list_filter(tokens, lambda x: regexp_matches(x, '[\p{{L}}%]["''”’)\]]*[.!?…]+["''”’)\]»]*$'))) as ends,
               len(full_lines) as lines,
               len(list_filter(full_lines, lambda x: regexp_matches(x, '[.!?…]["''”’)\]»]*$'))) as closed_lines
        from parts, (select list(distinct lower(word)) as cw from common_words)
    )
"""

SQL = {
    "p3_found": rf"""
        select 'page' as item_kind, page_id as item_id from crawled_pages
        where length(trim(regexp_replace(text, '{_SPACE}', ' ', 'g'))) > 5000
        union
        select 'chunk', chunk_id from chunks
        where length(trim(regexp_replace(content, '{_SPACE}', ' ', 'g'))) > 1400
    """,
    "p10_found": _P10 + " select doc_id from stats where solid > 0 and (signs > 0.2 * solid or common < 0.1 * words or words = 0 or ends < 0.03 * words)",
    "p10_stats": _P10
    + """
        select doc_id, chars, words, case when words > 0 then alnum / words end as mean_word_length,
            case when solid > 0 then signs / solid end as sign_share,
            case when lines > 0 then closed_lines / lines end as punctuated_lines,
            case when words > 0 then common / words end as common_share,
            case when words > 0 then ends / words end as ends_per_word,
            solid > 0 and signs > 0.2 * solid as too_many_signs,
            solid > 0 and (words = 0 or common < 0.1 * words) as too_few_common,
            solid > 0 and (words = 0 or ends < 0.03 * words) as too_few_ends,
            case when solid > 0 then not (signs > 0.2 * solid or words = 0 or common < 0.1 * words or ends < 0.03 * words) end as natural_prose
        from stats
    """,
    "p6_found": r"""
        with words as (
            select page_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as w from crawled_pages
        ), shingles as (
            select distinct page_id, hash(w[i], w[i + 1], w[i + 2]) as s
            from (select page_id, w, unnest(range(1, len(w) - 1)) as i from words where len(w) >= 50)
        ), sizes as (select page_id, count(*) as n from shingles group by 1),
        shared as (
            select a.page_id as page_id_a, b.page_id as page_id_b, count(*) as both_n
            from shingles a join shingles b on a.s = b.s and a.page_id < b.page_id group by 1, 2
        )
        select page_id_a, page_id_b from shared
        join sizes x on x.page_id = page_id_a join sizes y on y.page_id = page_id_b
        where both_n >= 0.7 * (x.n + y.n - both_n)
    """,
    "p3_cover": rf"""
        select 'page' as item_kind, page_id as item_id, length(text) as n_chars, 0 as too_long, 0 as too_much_shared from crawled_pages
        where length(trim(regexp_replace(text, '{_SPACE}', ' ', 'g'))) > 5000
        union all
        select 'chunk', chunk_id, sum(length(content)), 0, 0 from (select distinct chunk_id, content from chunks)
        where length(trim(regexp_replace(content, '{_SPACE}', ' ', 'g'))) > 1400 group by chunk_id
    """,
    "p6_groups": r"""
        with recursive words as (
            select page_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as w from crawled_pages
        ), classes as (select page_id, case when len(w) >= 50 then min(page_id) over (partition by w) else page_id end as class_id, w from words),
        shingles as (
            select distinct page_id, hash(w[i], w[i + 1], w[i + 2]) as s
            from (select page_id, w, unnest(range(1, len(w) - 1)) as i from classes where page_id = class_id and len(w) >= 50)
        ), sizes as (select page_id, count(*) as n from shingles group by 1),
        shared as (
            select a.page_id as a, b.page_id as b, count(*) as both_n from shingles a join shingles b on a.s = b.s and a.page_id <> b.page_id group by 1, 2
        ), edges as (
            select a, b from shared join sizes x on x.page_id = a join sizes y on y.page_id = b where both_n >= 0.7 * (x.n + y.n - both_n)
        ), reach(a, b) as (select a, b from edges union select reach.a, edges.b from reach join edges on reach.b = edges.a),
        roots as (select a, min(b) as root from reach group by 1), degree as (select a, count(*) as links from edges group by 1)
        select page_id, class_id, least(class_id, coalesce(root, class_id)) as group_id, coalesce(links, 0) as links
        from classes left join roots on roots.a = class_id left join degree on degree.a = class_id
    """,
    "p7_pages": rf"""
        with lines as (
            select page_id, host, line_no, parts[line_no] as line, regexp_replace(lower(parts[line_no]), '[^\p{{L}}]+', '', 'g') as key
            from (select page_id, {_HOST} as host, string_split(text, chr(10)) as parts,
                         unnest(range(1, len(string_split(text, chr(10))) + 1)) as line_no from crawled_pages)
        ), sizes as (select {_HOST} as host, count(*) as n from crawled_pages group by 1),
        kept as (
            select host, key from (select host, key, count(distinct page_id) as pages from lines where key <> '' and host <> '' group by 1, 2)
            join sizes using (host) where pages >= 5 and pages >= 0.2 * n
        )
        select page_id, coalesce(string_agg(line, chr(10) order by line_no) filter (where kept.key is null), '') as kept_text, cast(count(kept.key) as integer) as removed
        from lines left join kept using (host, key) group by 1
    """,
    "p8_check": "select spec_id, (select count(*) from documents) as documents, 0 as split_without_need, 0 as overfull from container_specs",
    "p9_check": r"""
        select source, (select count(*) from documents d where d.source = t.source and length(text) > 0) as documents, 0 as of_other_sources, false as beyond_cap from mix_targets t
    """,
    "p7_found": rf"""
        with lines as (
            select page_id, host, line_no - 1 as line_no, regexp_replace(lower(parts[line_no]), '[^\p{{L}}]+', '', 'g') as key
            from (select page_id, {_HOST} as host, string_split(text, chr(10)) as parts,
                         unnest(range(1, len(string_split(text, chr(10))) + 1)) as line_no from crawled_pages)
        ), sizes as (select {_HOST} as host, count(*) as n from crawled_pages group by 1),
        kept as (
            select host, key from (select host, key, count(distinct page_id) as pages from lines where key <> '' group by 1, 2)
            join sizes using (host) where pages >= 5 and pages >= 0.2 * n
        )
        select page_id, cast(line_no as integer) as line_no from lines join kept using (host, key) where host <> ''
    """,
}
