"""The core queries as SQL, written apart from the plans they check."""

from __future__ import annotations

from corpusloom.functions.text import STOPWORDS
from corpusloom.functions.urls import BINARY, TRACKING
from corpusloom.operators.rules import CRITERIA, FOLLOW_UPS, SUGGESTION_FALLBACKS, SUGGESTION_RULES
from corpusloom.operators.summaries import ANSWER_LEAD, NOTHING_FOUND
from corpusloom.plans.queries import QUESTION, QUESTION_WORDS

S = r"[\s\x{0b}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '{S}+', ' ', 'g'))"


def tokens(x: str) -> str:
    stop = ", ".join(map(q, STOPWORDS))
    return f"list_filter(string_split_regex(lower(coalesce({x}, '')), '[^a-z0-9]+'), lambda w: length(w) >= 2 and w not in ({stop}))"


def sentences(x: str) -> str:
    marked = rf"regexp_replace({collapse(f'coalesce({x}, {q('')})')}, '([.!?])\s+', '\1' || chr(1), 'g')"
    return f"list_filter(list_transform(string_split({marked}, chr(1)), lambda s: trim(s)), lambda s: length(s) >= 30)"


def windows(x: str) -> str:
    return f"list_transform(range(0, cast(greatest(0, ceil((length({x}) - 1400) / 1200.0)) as bigint) + 1), lambda i: trim(substring({x}, i * 1200 + 1, 1400)))"


DOCS = "select doc_id, text from documents"
CHUNKS = "select chunk_id as doc_id, arg_min(content, (content, source)) as text, arg_min(source, (content, source)) as source from chunks group by 1"
_BASE = f"""select page_id, url, title, {collapse("case when coalesce(length(title), 0) > 0 then 'Title: ' || title || chr(10) else '' end || 'URL: ' || url || chr(10) || chr(10) || coalesce(text, '')")} as t from crawled_pages"""
WINDOWS = f"""select page_id, pos - 1 as chunk_pos, w[pos] as content from (select page_id, w, unnest(range(1, len(w) + 1)) as pos from (select page_id, case when length(t) > 0 then {windows('t')} else [] end as w from ({_BASE})))"""


def index(docs: str, questions: str) -> str:
    """Tables of an index over ``docs`` and the scores of ``questions``, as a WITH list."""
    return f"""
        with docs as ({docs}), tok as (select doc_id, {tokens('text')} as tokens from docs),
        dl as (select doc_id, len(tokens) as dl from tok),
        tf as (select doc_id, term, count(*) as tf from (select doc_id, unnest(tokens) as term from tok) group by 1, 2),
        df as (select term, count(*) as df from tf group by 1),
        st as (select count(*) as n, coalesce(avg(dl), 0) as avgdl from dl),
        qs as ({questions}), qt as (select distinct qid, unnest({tokens('question')}) as term from qs),
        scores as (
            select qid, doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * greatest(dl, 1) / case when avgdl = 0 then 1 else avgdl end))) as score
            from qt join df using (term) join tf using (term) join dl using (doc_id), st group by 1, 2
        ), ranked as (select qid, doc_id, score, row_number() over (partition by qid order by round(score, 9) desc, doc_id) as rank from scores),
        hits as (
            select qid, rank, doc_id, score from ranked where rank <= 8
            union all
            select qid, row_number() over (partition by qid order by doc_id), doc_id, 0.0
            from (select distinct qid from qs where qid not in (select qid from ranked)), (select doc_id from dl order by doc_id limit 5)
        )"""


ONE = f"select 0 as qid, {q(QUESTION)} as question"
ALL = "select qid, question from questions"
RETRIEVED = index(CHUNKS, ALL) + f""",
        got as (select h.qid, q.question, h.rank, d.text as content, d.source from hits h join docs d using (doc_id) join qs q on q.qid = h.qid),
        sent as (select qid, question, rank, pos, s[pos] as sentence from (select *, unnest(range(1, len(s) + 1)) as pos from (select *, {sentences('content')} as s from got))),
        scored as (
            select qid, sentence, max(len(list_filter({tokens('sentence')}, lambda w: list_contains({tokens('question')}, w)))) as score, min(rank * 1000000 + pos) as ordinal from sent group by 1, 2
        ), placed as (
            select *, max(score) over (partition by qid) as best, row_number() over (partition by qid order by score desc, length(sentence) desc, ordinal) as a,
                   row_number() over (partition by qid order by ordinal) as b from scored
        ), summary as (
            select qid, cast(case when best > 0 then a else b end as integer) as rank, sentence from placed where (best > 0 and score > 0 and a <= 3) or (best = 0 and b <= 2)
        ), sources as (
            select qid, string_agg(source, ' ' order by r) as sources
            from (select qid, source, r, row_number() over (partition by qid order by r) as n from (select qid, source, min(rank) as r from got where source <> '' group by 1, 2))
            where n <= 6 group by 1
        )"""


def canonical(url: str) -> str:
    """The plain canonical form."""
    u = f"regexp_replace(trim({url}), '#.*$', '')"
    origin = f"regexp_replace(regexp_replace(lower(regexp_extract({u}, '^(?i)(https?://[^/?#]+)', 1)), '^(http://.*):80$', '\\1'), '^(https://.*):443$', '\\1')"
    rest = f"regexp_replace({u}, '^(?i)https?://[^/?#]+', '')"
    rest = f"case when starts_with({rest}, '/') then {rest} else '/' || {rest} end"
    names = "|".join(TRACKING)
    rest = f"regexp_replace({rest}, '([?&])(?i:{names})=[^&]*', '\\1', 'g')"
    rest = f"regexp_replace(regexp_replace(regexp_replace({rest}, '&{{2,}}', '&', 'g'), '\\?&', '?', 'g'), '[?&]+$', '')"
    return f"case when {origin} <> '' then {origin} || {rest} end"


def origin(url: str) -> str:
    return f"regexp_extract({url}, '^(https?://[^/?#]+)', 1)"


LINKS = f"""select page_id, {canonical('url')} as canonical, pos - 1 as pos, links[pos] as href from (select page_id, url, links, unnest(range(1, len(links) + 1)) as pos from crawled_pages) where links[pos] is not null"""


def crawlable(h: str) -> str:
    return (
        f"(trim({h}) <> '' and not starts_with(trim({h}), '#') and not starts_with(trim({h}), 'mailto:') and not starts_with(trim({h}), 'tel:') and not starts_with(trim({h}), 'javascript:') "
        f"and not regexp_matches(trim({h}), '(?i)\\.({'|'.join(BINARY)})(\\?|#|$)'))"
    )


ADMIN = "(?i)/(cdn-cgi|wp-admin|wp-login)([^A-Za-z0-9_]|$)"
_CRITERIA = "|".join(CRITERIA)
HAS_CRITERIA = f"'(?i)(^|[^A-Za-z0-9_])({_CRITERIA})([^A-Za-z0-9_]|$)'"
_CASES = " ".join(f"when regexp_matches(lower(trim(text)), {q(p)}) then {q(t)}" for p, t in FOLLOW_UPS)

SITES = f"""select {origin('c')} as site, regexp_extract(c, '^https?://([^/:?#]+)', 1) as host, title, text, links, page_id as ord from (select *, {canonical('url')} as c from crawled_pages) where c is not null"""
CORPORA = f"""
    sites as ({SITES}), first_pages as (select *, row_number() over (partition by site order by ord) as n from sites),
    corpora as (
        select site, lower(string_agg(coalesce(title, '') || ' ' || substring(text, 1, 1800) || ' ' || coalesce(list_aggregate(links, 'string_agg', ' '), ''), ' ' order by n)) as corpus
        from first_pages where n <= 6 group by 1
    ), rules(rule, patterns, question) as (values {", ".join(f"({i}, [{', '.join(map(q, ps))}], {q(t)})" for i, (ps, t) in enumerate(SUGGESTION_RULES))}),
    scored as (select site, rule, question, cast(list_sum(list_transform(patterns, lambda p: cast(contains(corpus, p) as integer))) as bigint) as score from corpora, rules)"""
_BARE = r"trim(regexp_replace(regexp_replace(regexp_replace(host, '^(?i)www\.', ''), '(?i)\.[a-z]{2,}$', ''), '[-_]+', ' ', 'g'))"
NAMES = rf"""
    named as (
        select site, min(host) as host, arg_min(trim(coalesce(title, '')), ord) filter (where length(trim(coalesce(title, ''))) >= 3 and lower(trim(title)) not in ('home', 'homepage', 'index')) as first
        from ({SITES}) group by 1
    ), names as (
        select site, case when coalesce(trim(regexp_replace(first, '\s*[-|:].*$', '')), '') <> '' then trim(regexp_replace(first, '\s*[-|:].*$', ''))
            when {_BARE} = '' then 'this site'
            else array_to_string(list_transform(regexp_extract_all({_BARE}, '[A-Za-z0-9_]+|[^A-Za-z0-9_]+'), lambda w: upper(substring(w, 1, 1)) || substring(w, 2)), '') end as site_name
        from named
    )"""
HTML = "select url, body from site_snapshot where kind = 'html' and status between 200 and 299 and body is not null and (content_type is null or content_type = '' or contains(lower(content_type), 'html'))"
TEXTS = "select url, body from site_snapshot where kind = 'text' and status between 200 and 299 and body is not null"
RATE = "(coalesce(status = 429, false) or coalesce(regexp_matches(message, '(?i)rate limit|too many requests|429'), false))"
_SETUP = "coalesce(regexp_matches(message, '(?i)quota|credit balance|billing|model .*not found|api key|invalid_request_error'), false)"

SQL = {
    "tokenize_docs": f"select doc_id, array_to_string({tokens('text')}, ' ') as tokens from documents",
    "term_freq": f"select doc_id, term, count(*) as tf from (select doc_id, unnest({tokens('text')}) as term from documents) group by 1, 2",
    "doc_length": f"select doc_id, len({tokens('text')}) as dl from documents",
    "doc_freq": f"select term, count(*) as df from (select distinct doc_id, unnest({tokens('text')}) as term from documents) group by 1",
    "corpus_stats": f"select count(*) as n, round(coalesce(avg(len({tokens('text')})), 0), 6) as avgdl from documents",
    "bm25_scores": index(DOCS, ONE) + " select doc_id, round(score, 6) as score from scores",
    "bm25_topk": index(DOCS, ONE) + " select doc_id, round(score, 6) as score from ranked where rank <= 8",
    "bm25_topk_batch": index(DOCS, ALL) + " select qid, cast(rank as integer) as rank, doc_id, round(score, 6) as score from ranked where rank <= 8",
    "retrieve_with_fallback": index(DOCS, ALL) + " select qid, cast(rank as integer) as rank, doc_id, round(score, 6) as score from hits",
    "chunk_text": f"select page_id, cast(chunk_pos as integer) as chunk_pos, content from ({WINDOWS})",
    "chunk_counts": f"select page_id, count(*) as n_chunks, cast(sum(length(content)) as bigint) as n_chars from ({WINDOWS}) group by 1",
    "chunk_bm25_topk": index(f"select page_id * 100000 + chunk_pos as doc_id, content as text from ({WINDOWS})", ONE)
    + " select doc_id // 100000 as page_id, doc_id % 100000 as chunk_pos, round(score, 6) as score from ranked where rank <= 8",
    "split_sentences": f"select doc_id, cast(pos - 1 as integer) as pos, s[pos] as sentence from (select doc_id, s, unnest(range(1, len(s) + 1)) as pos from (select doc_id, {sentences('text')} as s from documents))",
    "sentence_overlap": f"""
        select doc_id, cast(pos - 1 as integer) as pos, len(list_filter({tokens('s[pos]')}, lambda w: w in ({', '.join(map(q, QUESTION_WORDS))}))) as score
        from (select doc_id, s, unnest(range(1, len(s) + 1)) as pos from (select doc_id, {sentences('text')} as s from documents))""",
    "local_summary": RETRIEVED + " select qid, rank, sentence from summary",
    "source_list": RETRIEVED + " select qid, sources from sources",
    "context_block": RETRIEVED
    + """ select qid, string_agg('---' || chr(10) || case when source <> '' then 'Source: ' || source else '' end || chr(10) || 'Chunk ' || rank || ':' || chr(10) || content, chr(10) || chr(10) order by rank) as context
          from got group by 1""",
    "follow_up_answer": RETRIEVED
    + f""" select qid, case when t is not null then 'The site points to ' || regexp_replace(t, '\\.$', '') || '. ' else '' end || 'To make this specific, ' || follow_up as answer
          from (select distinct qid, case when regexp_matches(lower(trim(question)), {HAS_CRITERIA}) then null {_CASES.replace("trim(text)", "trim(question)")} end as follow_up from qs)
          left join (select qid, sentence as t from summary where rank = 1) using (qid) where follow_up is not null""",
    "local_answer": RETRIEVED
    + f""" select qid, coalesce({q(ANSWER_LEAD)} || t, {q(NOTHING_FOUND)}) as answer, coalesce(sources, '') as sources
          from (select distinct qid from qs) left join (select qid, string_agg(sentence, ' ' order by rank) as t from summary group by 1) using (qid) left join sources using (qid)""",
    "normalize_url": f"select page_id, {canonical('url')} as canonical from crawled_pages",
    "strip_tracking": f"select page_id, {canonical('url')} as canonical from crawled_pages",
    "url_origin": f"select page_id, {origin(canonical('url'))} as origin from crawled_pages",
    "same_origin_links": f"select page_id, cast(pos as integer) as pos, {origin('canonical')} = {origin(canonical('href'))} as same_origin from ({LINKS})",
    "crawlable_links": f"select page_id, count(*) as n_links from ({LINKS}) where {crawlable('href')} and not regexp_matches(href, '{ADMIN}') group by 1",
    "link_targets": f"select target, count(*) as n_pages from (select distinct page_id, {canonical('href')} as target from ({LINKS})) where target is not null group by 1",
    "fetch_join": f"""
        select page_id, cast(pos as integer) as pos, target_page from (select page_id, pos, {canonical('href')} as c from ({LINKS}))
        join (select {canonical('url')} as c, min(page_id) as target_page from crawled_pages group by 1) using (c)""",
    "frontier_anti_visited": f"select distinct url from (select {canonical('href')} as url from ({LINKS})) where url is not null and url not in (select {canonical('url')} from crawled_pages)",
    "bfs_reach": f"""
        with recursive edges as (select distinct canonical as src, {canonical('href')} as dst from ({LINKS})),
        r(url, depth) as (
            select {canonical('url')}, 0 from crawled_pages where depth = 0 union select dst, r.depth + 1 from r join edges on src = url where r.depth < 3 and dst is not null
        ) select url, cast(min(depth) as integer) as depth from r where url is not null group by 1""",
    "collapse_ws": f"select doc_id, {collapse('text')} as text from documents",
    "truncate_text": f"select doc_id, case when length(t) <= 4000 then t else substring(t, 1, 4000) || '...' end as text from (select doc_id, {collapse('text')} as t from documents)",
    "meaningful_text": f"""
        select doc_id, cast(pos - 1 as integer) as pos, line from (
            select doc_id, pos, {collapse('l[pos]')} as line from (select doc_id, l, unnest(range(1, len(l) + 1)) as pos from (select doc_id, string_split(text, chr(10)) as l from documents)))
        where length(line) >= 10""",
    "prefix_dedup": f"""
        with lines as (
            select page_id, pos, {collapse('l[pos]')} as block from (select page_id, l, unnest(range(1, len(l) + 1)) as pos from (select page_id, string_split(text, chr(10)) as l from crawled_pages))
        ), kept as (
            select page_id, lower(substring(block, 1, 260)) as k, min(pos) as p, first(block order by length(block) desc, pos) as block from lines where block <> '' group by 1, 2
        ) select page_id, string_agg(block, chr(10) order by p) as text from kept group by 1""",
    "site_corpus": f"with {CORPORA} select site, md5(corpus) as corpus_md5, length(corpus) as n_chars from corpora",
    "suggestion_scores": f"with {CORPORA} select site, rule, score from scored",
    "site_name": f"with {NAMES} select site, site_name from names",
    "site_suggestions": f"""
        with {CORPORA}, {NAMES}, wanted as (
            select site, question, -score as s, rule as r from scored where score > 0
            union all select site, f, 1, n from corpora, (values {", ".join(f"({q(t)}, {i})" for i, t in enumerate(SUGGESTION_FALLBACKS))}) as x(f, n)
        ), picked as (select *, row_number() over (partition by site order by s, r) as k from wanted)
        select site, string_agg(replace(question, '%s', site_name), ' | ' order by k) as suggestions from picked join names using (site) where k <= 3 group by 1""",
    "decision_criteria": f"select qid, regexp_matches(question, {HAS_CRITERIA}) as has_criteria from questions where question is not null",
    "decision_followup": f"select text, case when regexp_matches(lower(trim(text)), {HAS_CRITERIA}) then null {_CASES} end as follow_up from (select distinct text from client_messages where text is not null)",
    "fetched_pages": f"select url, length(body) as n_chars from ({HTML})",
    "page_title": rf"select url, nullif({collapse("replace(regexp_extract(body, '(?is)<title[^>]*>(.*?)</title>', 1), '&amp;', '&')")}, '') as title from ({HTML})",
    "page_links": rf"""
        with hrefs as (select url, h, pos from (select url, x[pos] as h, pos from (select url, x, unnest(range(1, len(x) + 1)) as pos from (
            select url, regexp_extract_all(body, '<a [^>]*href="([^"]*)"', 1) as x from ({HTML})))) where {crawlable('h')}
        ), full_links as (
            select url, pos, regexp_replace(case when regexp_matches(h, '^(?i)https?://') then h when starts_with(h, '/') then {origin(canonical('url'))} || h else {origin(canonical('url'))} || '/' || h end, '#.*$', '') as l from hrefs
        ), clean as (select url, pos, {origin(canonical('l'))} || regexp_replace(l, '^(?i)https?://[^/?#]+', '') as link from full_links),
        once as (select url, link, min(pos) as p from clean group by 1, 2)
        select url, cast(row_number() over (partition by url order by p) - 1 as integer) as pos, link from once""",
    "sitemap_locs": rf"""
        select url, cast(pos - 1 as integer) as pos, x[pos] as loc from (select url, x, unnest(range(1, least(len(x), 1200) + 1)) as pos from (
            select url, regexp_extract_all(body, '(?i)<loc>\s*([^<\s]+)\s*</loc>', 1) as x from ({TEXTS})))""",
    "robots_sitemaps": rf"select url, unnest(regexp_extract_all(body, '(?im)^sitemap:[ \t]*(\S+)[ \t]*\r?$', 1)) as sitemap from ({TEXTS}) where ends_with(url, '/robots.txt')",
    "parsed_frames": """
        select session_id, ts, case when json_valid(value) then json_extract_string(value, '$.type') end as type, case when json_valid(value) then json_extract_string(value, '$.text') end as text, json_valid(value) as valid
        from (select session_id, ts, text as value from client_messages where text is not null
              union all select session_id, ts, cast(to_json({'type': type, 'text': text}) as varchar) from client_messages)""",
    "error_messages": """
        select outcome_id, case when trim(coalesce(message, '')) = '' then 'Empty error response'
            when json_valid(message) and json_type(message, '$.error') = 'VARCHAR' then json_extract_string(message, '$.error')
            when json_valid(message) and json_type(message, '$.error.message') = 'VARCHAR' then json_extract_string(message, '$.error.message')
            when json_valid(message) and json_type(message, '$.message') = 'VARCHAR' then json_extract_string(message, '$.message')
            when length(trim(message)) > 240 then substring(trim(message), 1, 240) || '...' else trim(message) end as error
        from provider_outcomes where not ok""",
    "failure_report": "select provider, count(*) as checks, count(*) filter (where not ok) as failures, cast(case when count(*) filter (where not ok) > 0 then 1 else 0 end as integer) as exit_code from provider_outcomes group by 1",
    "resting_providers": f"""
        select session_id, string_agg(provider, ' ' order by provider) as resting from (
            select session_id, provider, last(ts + to_seconds(case when {RATE} then 600 when {_SETUP} then 900 else 120 end) order by ts, outcome_id) as until from provider_outcomes where not ok group by 1, 2
        ) join (select session_id, max(ts) as now from provider_outcomes group by 1) using (session_id) where until > now group by 1""",
    "document_ordinals": f"select page_id, cast(chunk_pos as integer) as chunk_pos, row_number() over (order by page_id, chunk_pos) - 1 as ordinal from ({WINDOWS})",
    "crawl_log": f"""
        select url, case when url in (select url from ({HTML})) then 'fetched' else 'fetch_failed' end as event from site_snapshot where kind = 'html'""",
    "safe_json": "select event_id, case when json_valid(props) then try_cast(json_extract_string(props, '$.k') as bigint) end as k from events",
    "session_replay": """
        with m as (select distinct session_id, ts, type, text from client_messages),
        n as (
            select *, trim(coalesce(text, '')) as t, row_number() over w as seq, count(*) filter (where type = 'reset') over w as era
            from m window w as (partition by session_id order by ts, type, coalesce(text, '') rows between unbounded preceding and current row)
        ), a as (
            select *, min(case when type = 'user_message' and regexp_matches(t, '(?i)^https?://') then seq end) over (partition by session_id, era order by seq) as first_seq from n
        ), u as (select a.*, b.t as seed_url from a left join n b on b.session_id = a.session_id and b.seq = a.first_seq)
        select session_id, seq, case when first_seq is null then 'awaiting_url' else 'ready' end as stage,
            case when type = 'reset' then 'reset' when type <> 'user_message' or t = '' then 'ignored' when first_seq is null then 'ask_url' when first_seq = seq then 'crawl' else 'answer' end as action, seed_url
        from u""",
    "provider_failover": f"""
        with r as (
            select *, coalesce(sum(cast(ok as integer)) over (partition by session_id order by ts, outcome_id rows between unbounded preceding and 1 preceding), 0) as run,
                   case when {RATE} then 'rate_limit' else 'error' end as kind from provider_outcomes
        )
        select session_id, cast(run as bigint) as run, max(provider) filter (where ok) as provider, count(*) filter (where not ok) > 0 as had_to_fallback,
            last(kind order by ts, outcome_id) filter (where not ok) as fallback_reason,
            coalesce(string_agg(provider || ': ' || coalesce(message, ''), ' | ' order by ts, outcome_id) filter (where not ok), '') as failures
        from r group by 1, 2""",
    "provider_cooldowns": f"""
        select session_id, provider, last(ts + to_seconds(case when {RATE} then 600 when {_SETUP} then 900 else 120 end) order by ts, outcome_id) as until
        from provider_outcomes where not ok group by 1, 2""",
    "provider_rotation": """
        select session_id, array_to_string(list_concat(p[n % 4 + 1 :], p[: n % 4]), ' ') as attempts
        from (select session_id, count(*) filter (where ok) as n, ['google', 'groq', 'ollama', 'openrouter'] as p from provider_outcomes group by 1)""",
}
