"""Problem 9: a mix in which every source has its target share of the tokens, by Poisson replication.

Each document gets a uniform number from a hash of its id; its count is the inverse of a Poisson distribution at that
number, cut at the source's ``max_repeats``. The Poisson mean of a source is the one whose total comes nearest its target:
it starts from the mean rate and is narrowed by measuring totals on a grid of means, all sources and documents at once.

The mix is as large as the named sources are (``total_tokens`` sets another size). A source that can't fill its share even
with every document at its most repeats is taken whole; the others keep their proportions to each other.

Defined results: documents without tokens, with a NULL source or of an unnamed source stay out; named sources without
documents have a total of 0; targets with a NULL or negative share or a cap below 1 are refused; repeated names too.
Extra columns are ignored. An empty table gives an empty mix.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import map_columns
from corpusloom.llm.tokenizing import encoding, vocabulary_path
from corpusloom.plans.lineage import cut

MAX_SOURCES = 10_000
SEED = 20_240_501
GRID = 33
ROUNDS = 3


def thresholds(mean: float, cap: int) -> np.ndarray:
    """Poisson distribution function at ``0 .. cap - 1``, as far as it is below 1: a document's count is how many of them its
    number reaches, and no number reaches 1. The length grows with the mean, never with the cap."""
    k = np.arange(min(cap, math.ceil(mean + 12 * math.sqrt(mean)) + 50))
    logs = -mean + k * math.log(mean) - np.concatenate([[0.0], np.cumsum(np.log(k[1:]))]) if mean > 0 else np.where(k == 0, 0.0, -np.inf)
    below = np.minimum(np.cumsum(np.exp(logs)), 1.0)
    return below[below < 1.0]


def counts(mean: float, cap: int, u: np.ndarray) -> np.ndarray:
    """How often documents with these numbers are used."""
    return np.full(len(u), cap) if mean == math.inf else np.searchsorted(_thresholds(mean, cap), u, side="right")


#: A task goes through few sources at a time; the arrays are made where they are used and never sent.
_thresholds = lru_cache(maxsize=64)(thresholds)


def expected_count(mean: float, cap: int) -> float:
    return float(cap) if mean == math.inf else float((1 - thresholds(mean, cap)).sum())


def mean_for(rate: float, cap: int) -> float:
    """The Poisson mean whose count, cut at ``cap``, is ``rate`` on average."""
    if rate >= cap:
        return math.inf
    low, high = 0.0, 1.0
    while expected_count(high, cap) < rate and high < 1e6:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if expected_count(mid, cap) < rate else (low, mid)
    return high


def sized(docs: DataFrame, targets: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """``doc_id, source, n_tokens, u`` of the documents of named sources that have tokens."""
    path = vocabulary or vocabulary_path()
    named = docs.select("doc_id", "source", "text").where("text is not null").join(F.broadcast(targets.select("source").distinct()), "source", "left_semi")

    def run(ids: list, sources: list, texts: list) -> dict[str, list]:
        enc = encoding(path)
        return {"doc_id": ids, "source": sources, "n_tokens": [len(enc.encode_ordinary(t)) for t in texts]}

    counted = map_columns(named.select("doc_id", "source", "text"), run, "doc_id bigint, source string, n_tokens bigint")
    u = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(SEED)), 11) / F.lit(float(2**53))
    return counted.where("n_tokens > 0").withColumn("u", u)


def _targets(targets: DataFrame) -> dict[str, tuple[float, int]]:
    rows = targets.select("source", "target_share", "max_repeats").limit(MAX_SOURCES + 1).collect()
    found = {r[0]: (r[1], r[2]) for r in rows}
    if len(rows) > MAX_SOURCES or len(found) < len(rows) or any(s is None or a is None or a < 0 or c is None or c < 1 for s, (a, c) in found.items()):
        raise ValueError(f"at most {MAX_SOURCES} named sources, each once, with a share of at least 0 and a cap of at least 1")
    return found


def _by_source(sources: list):
    """``(source, places)`` of the sources of a batch, found in one sort."""
    names, code = np.unique(np.array(sources, object), return_inverse=True)
    order = np.argsort(code, kind="stable")
    return zip(names.tolist(), np.split(order, np.cumsum(np.bincount(code))[:-1]))


def _totals(docs: DataFrame, grids: dict[str, tuple[list[float], int]]) -> dict[str, np.ndarray]:
    """Tokens of each source's mix under each mean of its grid: sums within batches, then over batches. Means and caps are sent."""

    def run(sources: list, sizes: list, us: list) -> dict[str, list]:
        n, u = np.array(sizes, np.float64), np.array(us)
        out: dict[str, list] = {"source": [], "totals": []}
        for s, own in _by_source(sources):
            means, cap = grids[s]
            out["source"].append(s)
            out["totals"].append([float((n[own] * counts(m, cap, u[own])).sum()) for m in means])
        return out

    parts = map_columns(docs.where(F.col("source").isin(list(grids))).select("source", "n_tokens", "u"), run, "source string, totals array<double>")
    rows = parts.select("source", F.posexplode("totals").alias("k", "t")).groupBy("source", "k").agg(F.sum("t").alias("t")).collect()
    found = {s: np.zeros(len(means)) for s, (means, _) in grids.items()}
    for r in rows:
        found[r["source"]][r["k"]] = r["t"]
    return found


def fitted_means(docs: DataFrame, targets: dict[str, tuple[float, int]], total_tokens: float | None = None) -> dict[str, float]:
    """The Poisson mean of every source."""
    held = {r[0]: r[1] for r in docs.groupBy("source").agg(F.sum("n_tokens")).collect()}
    total = total_tokens or float(sum(held.values()))
    means = {s: mean_for(share * total / held[s], cap) if held.get(s) else 0.0 for s, (share, cap) in targets.items()}
    free = [s for s, m in means.items() if 0 < m < math.inf]
    low, high = {s: means[s] * 0.5 for s in free}, {s: means[s] * 1.6 + 0.1 for s in free}
    for _ in range(ROUNDS if free else 0):
        grids = {s: np.linspace(low[s], high[s], GRID) for s in free}
        found = _totals(docs, {s: (grids[s].tolist(), targets[s][1]) for s in free})
        for s in free:
            k = int(np.abs(found[s] - targets[s][0] * total).argmin())
            means[s] = float(grids[s][k])
            low[s], high[s] = float(grids[s][max(0, k - 1)]), float(grids[s][min(GRID - 1, k + 1)])
    return means


def mixed(docs: DataFrame, targets: DataFrame, total_tokens: float | None = None, vocabulary: str | None = None) -> tuple[DataFrame, DataFrame]:
    """``(mix, shares)``: the chosen documents ``doc_id, source, repeat_no, n_tokens, mix_key`` in shuffled order, and per
    source ``target_share, max_repeats, documents, mixed_documents, most_repeats, mixed_tokens, reached_share``."""
    wanted = _targets(targets)
    known = cut(sized(docs, targets, vocabulary))
    means = fitted_means(known, wanted, total_tokens)
    plan = {s: (means[s], cap) for s, (_, cap) in wanted.items()}

    def draw(ids: list, sources: list, sizes: list, us: list) -> dict[str, list]:
        u, n = np.array(us), np.zeros(len(us), np.int64)
        for s, own in _by_source(sources):
            n[own] = counts(*plan[s], u[own])
        return {"doc_id": ids, "source": sources, "n_tokens": sizes, "n": n}

    counted = map_columns(known.select("doc_id", "source", "n_tokens", "u"), draw, "doc_id bigint, source string, n_tokens bigint, n int")
    mix = (
        counted.where("n > 0")
        .select("doc_id", "source", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("repeat_no"), "n_tokens")
        .withColumn("mix_key", F.xxhash64("doc_id", "repeat_no", F.lit(SEED + 1)))
        .orderBy("mix_key", "doc_id", "repeat_no")
    )
    sums = counted.groupBy("source").agg(
        F.count("*").alias("documents"), F.count_if(F.col("n") > 0).alias("mixed_documents"), F.max("n").alias("most_repeats"), F.sum(F.col("n") * F.col("n_tokens")).alias("mixed_tokens")
    )
    goal = targets.select("source", "target_share", "max_repeats")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    everything = sums.agg(F.sum("mixed_tokens").alias("everything"))
    shares = (
        goal.join(sums, "source", "left")
        .join(F.broadcast(everything))
        .select("source", "target_share", "max_repeats", zero("documents"), zero("mixed_documents"), zero("most_repeats"), zero("mixed_tokens"), (F.coalesce("mixed_tokens", F.lit(0)) / F.col("everything")).alias("reached_share"))
    )
    return mix, shares
