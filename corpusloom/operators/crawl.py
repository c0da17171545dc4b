"""Breadth-first traversal of a snapshot or of a link table: one round, one plan.

Rounds run on the driver, their rows never: each round anti-joins the frontier with what was visited, joins what is left to
the pages, and writes both to the checkpoint folder, so lineage stays short and a lost executor costs a read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions.urls import administrative, canonical, canonical_url, origin
from corpusloom.plans.lineage import cut
from corpusloom.sources.html import extract_page
from corpusloom.sources.snapshot import INDEX_CHILDREN, SITEMAP_CANDIDATES, SITEMAP_FILE_STOP, SITEMAP_STOP, fetched, is_sitemap_index, robots_sitemaps, sitemap_locs

#: Paths that sites often have (fixed values).
COMMON_PATHS = "/about /about-us /contact /pricing /services /products /blog /docs".split()
AFTER_SEEDS = 1 << 40
QUEUE_FACTOR, SITEMAP_SEEDS, SITEMAP_SEED_FACTOR = 20, 200, 4


def reach(edges: DataFrame, seeds: DataFrame, max_depth: int) -> DataFrame:
    """``url, depth``: the least number of links from a seed, up to ``max_depth``, over ``edges(src, dst)``.

    The frontier of a round is what the last one reached for the first time; all seeds advance together.
    """
    frontier = cut(seeds.select("url", F.lit(0).alias("depth")).distinct())
    # Each round writes its own frontier only; what was visited is the union of the rounds, of which there are few.
    visited = frontier
    links = cut(edges.select("src", "dst").distinct()) if max_depth > 1 else edges.select("src", "dst").distinct()
    for depth in range(1, max_depth + 1):
        found = frontier.join(links, frontier["url"] == links["src"]).select(F.col("dst").alias("url")).distinct()
        frontier = cut(found.join(visited, "url", "left_anti").select("url", F.lit(depth).alias("depth")))
        if frontier.isEmpty():
            break
        visited = visited.unionByName(frontier)
    return visited


def discover_sitemaps(snapshot: DataFrame, seed: str, most: int = SITEMAP_STOP) -> list[str]:
    """Addresses of the seed's site from its sitemaps; the number of files and addresses read is bounded."""
    site = origin_of(seed)
    texts = fetched(snapshot, "text").withColumn("key", canonical_url("url"))
    files: dict[str, tuple | None] = {}

    def fetch(addresses: list[str]) -> None:
        """Read the files of one level, few by the bounds on candidates and children, in one scan."""
        wanted = [k for k in dict.fromkeys(map(canonical, addresses)) if k and k not in files]
        files.update(dict.fromkeys(wanted))
        if wanted:
            parts = texts.where(F.col("key").isin(wanted)).select("key", sitemap_locs(F.col("body")).alias("locs"), is_sitemap_index(F.col("body")).alias("index"))
            files.update({r["key"]: (r["locs"], r["index"]) for r in parts.collect()})

    candidates = [f"{site}/sitemap.xml", f"{site}/sitemap_index.xml"]
    robots = texts.where(F.col("key") == f"{site}/robots.txt").select(F.explode(robots_sitemaps(F.col("body"))).alias("u")).limit(SITEMAP_CANDIDATES).collect()
    for row in robots:
        if len(candidates) < SITEMAP_CANDIDATES and row["u"] not in candidates:
            candidates.append(row["u"])
    seen: set[str] = set()
    urls: dict[str, None] = {}

    def read(address: str) -> None:
        key = canonical(address)
        if key is None or key in seen:
            return
        seen.add(key)
        fetch([address])
        if files[key] is None:
            return
        locs, is_index = files[key]
        if is_index:
            fetch(locs[:INDEX_CHILDREN])
            for child in locs[:INDEX_CHILDREN]:
                read(child)
            return
        for loc in locs:
            page = canonical(loc)
            if page and origin_of(page) == site:
                urls[page] = None
            if len(urls) >= SITEMAP_FILE_STOP:
                break

    fetch(candidates)
    for candidate in candidates:
        read(candidate)
        if len(urls) >= most:
            break
    return list(urls)


def origin_of(url: str) -> str:
    return "/".join(url.split("/", 3)[:3])


def seed_frontier(spark: SparkSession, seed: str, max_pages: int, sitemap: list[str] = ()) -> DataFrame:
    """``url, depth, ord``: the seed, common paths and the first addresses of its sitemaps; ``ord`` is a path of places."""
    site = origin_of(seed)
    extra = list(sitemap)[: min(SITEMAP_SEEDS, SITEMAP_SEED_FACTOR * max_pages)]
    rows = [(seed, 0)] + [(site + p, 1) for p in COMMON_PATHS] + [(u, 1) for u in extra]
    return spark.createDataFrame([(u, d, [i]) for i, (u, d) in enumerate(rows)], "url string, depth int, ord array<bigint>")


def crawl(snapshot: DataFrame, seed: str, max_depth: int = 3, max_pages: int = 100, use_sitemaps: bool = True) -> DataFrame:
    """``url, title, text, links, depth, page_ord`` of the pages reached from ``seed`` within its site.

    Addresses count as visited before they are read; pages without text are dropped; pages at ``max_depth`` are kept and
    not followed; order is depth, parent, place among the parent's links; at most ``max_pages`` pages come out.
    """
    spark = snapshot.sparkSession
    start = canonical(seed)
    if start is None:
        raise ValueError("the seed is no web address")
    site = origin_of(start)
    pages = fetched(snapshot).withColumn("key", canonical_url("url")).dropDuplicates(["key"]).select(F.col("key").alias("url"), "body")
    sitemap = discover_sitemaps(snapshot, start) if use_sitemaps else []
    waiting = seed_frontier(spark, start, max_pages, sitemap)
    visited = spark.createDataFrame([], "url string")
    result = None
    kept = 0
    for depth in range(max_depth + 1):
        own = waiting.where(F.col("depth") == depth).withColumn("url", canonical_url("url")).where(origin(F.col("url")) == site)
        fresh = own.groupBy("url").agg(F.min("ord").alias("ord")).join(visited, "url", "left_anti")
        frontier = cut(fresh.orderBy("ord").limit(QUEUE_FACTOR * max_pages))
        if frontier.isEmpty() and depth:
            break
        visited = cut(visited.unionByName(frontier.select("url")))
        read = frontier.join(pages, "url").withColumn("page", extract_page("body", "url"))
        good = read.where("page.text != ''").orderBy("ord").limit(max_pages - kept)
        found = cut(good.select("url", "page.title", "page.text", "page.links", F.lit(depth).alias("depth"), "ord"))
        kept += found.count()
        result = found if result is None else result.unionByName(found)
        if kept >= max_pages:
            break
        if depth < max_depth:
            out = found.select("ord", F.posexplode("links").alias("pos", "url")).where(~administrative(F.col("url")))
            # What is found goes after the seeds: a parent's place, then the place among its links.
            following = out.select("url", F.lit(depth + 1).alias("depth"), F.concat(F.array(F.lit(AFTER_SEEDS)), "ord", F.array(F.col("pos").cast("bigint"))).alias("ord"))
            waiting = cut(waiting.where(F.col("depth") > depth).unionByName(following))
    # At most ``max_pages`` rows.
    return result.withColumn("page_ord", F.row_number().over(Window.orderBy("depth", "ord")) - 1).drop("ord")


def crawl_log(snapshot: DataFrame, text: bool = True) -> DataFrame:
    """``url, event`` of every page of a snapshot: ``fetch_failed``, and with ``text`` ``dropped_empty`` or ``accepted``, else ``fetched``."""
    pages = snapshot.where("kind = 'html'").select("url").distinct()
    read = fetched(snapshot).select("url", F.coalesce(extract_page("body", "url")["text"] == "", F.lit(True)).alias("empty") if text else F.lit(None).cast("boolean").alias("empty"))
    rows = pages.join(read.groupBy("url").agg(F.lit(True).alias("read"), F.min("empty").alias("empty")), "url", "left")
    kept = F.when(F.col("empty"), "dropped_empty").otherwise("accepted") if text else F.lit("fetched")
    return rows.select("url", F.when(F.col("read").isNull(), "fetch_failed").otherwise(kept).alias("event"))
