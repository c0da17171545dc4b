"""Problem 6: near-duplicate texts by bottom-k sketches from one hash function.

1. Texts with the same token sequence form a class and only its smallest id goes on.
2. The sketch of a class is the k smallest hashes of its shingles, in order. Inverted lists are kept for runs of
   ``RUN`` neighbouring retained values (of ``SHORT_RUN`` where a text has fewer than k shingles): single values of common
   phrases have lists that grow with the collection, while unrelated sketches hardly ever agree on a whole run.
3. Classes in one list are candidates. The bottom-k of the union of their sketches estimates the similarity; pairs within
   ``ERRORS`` standard errors of the limit are compared by their whole shingle sets.

A shared value stays next to the following shared value unless a value of one text alone falls between them, so a pair of
similarity s keeps a run of r with the chance that k draws of probability s hold r successes in a row: for k = 64, r = 4
all but 4 in 10,000 pairs at 0.7 itself, all but 3 in 100,000 at 0.75, all but 1 in a million at 0.8.
Whole sketches miss none at 0.7 or above: in a union of u < k values more than two thirds are shared, so from u = 21 on
some three of them are neighbours, and two texts of a smaller union share single values.

Lists and classes of any length are worked on in blocks (``_pairs``), so a text that a third of all pages repeat is spread.

Defined results: NULL texts and texts with fewer than ``min_tokens`` tokens take no part in pairs; in the groups each is
its own class. Ids must be unique; of repeated ids one row is used. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import map_columns
from corpusloom.plans.lineage import cut

SHINGLE = 5
SIMILARITY = 0.8
MIN_TOKENS = 1
SKETCH = 64
RUN = 4
SHORT_RUN = 3
#: Texts of so few shingles are listed under single values: 14 shared values of 20 can lie without a run of three.
SINGLES = 20
ERRORS = 4.0
#: A list of more members is cut into blocks of about so many, and every pair of blocks is worked on by itself.
LIST = 1_000
#: Up to so many ids are sent to every executor (8 bytes each); more are joined by a shuffle.
BROADCAST_IDS = 1_000_000

_TOKEN = re.compile(r"[^\W_]+")


class _Words(dict):
    """Hashes of words, filled as they come up."""

    limit = 500_000

    def __missing__(self, word: str) -> int:
        if len(self) > self.limit:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


_WORDS = _Words()


def tokens(text: str) -> list[str]:
    """The longest runs of Unicode letters or digits, lower-cased."""
    return _TOKEN.findall(text.lower())


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(words: list[str]) -> np.ndarray:
    return np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))


def shingle_hashes(ids: np.ndarray, size: int) -> np.ndarray:
    """Distinct 64-bit hashes of the sequences of ``size`` consecutive words, ascending; one for a shorter text."""
    n = max(1, len(ids) - size + 1)
    h = np.zeros(n, np.uint64)
    for i in range(min(size, len(ids))):
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + ids[i : i + n]
    return np.unique(_mix(h))


def runs(sketch: np.ndarray, length: int) -> np.ndarray:
    """A hash of each run of ``length`` neighbouring values."""
    n = len(sketch) - length + 1
    if n < 1:
        return _mix(sketch.sum(keepdims=True))
    h = np.full(n, np.uint64(length))
    for i in range(length):
        h = _mix(h) + sketch[i : i + n]
    return h


def sketches(docs: DataFrame, text_col: str, id_col: str, shingle: int, min_tokens: int, k: int) -> DataFrame:
    """``id, twin`` (hash of the token sequence), ``n_shingles, sketch`` (8 bytes a value) of the texts that are long enough."""

    def run(ids: list, texts: list) -> dict[str, list]:
        out: dict[str, list] = {"id": [], "twin": [], "n_shingles": [], "sketch": []}
        for i, text in zip(ids, texts):
            words = word_hashes(tokens(text))
            if len(words) < max(1, min_tokens):
                continue
            h = shingle_hashes(words, shingle)
            out["id"].append(i)
            out["twin"].append(xxhash.xxh3_128_digest(words.tobytes()))
            out["n_shingles"].append(len(h))
            out["sketch"].append(h[:k].tobytes())
        return out

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("body")).where("id is not null and body is not null")
    return map_columns(source, run, "id bigint, twin binary, n_shingles int, sketch binary")


def _postings(heads: DataFrame, k: int) -> DataFrame:
    """``key, id, n``: the class under each of its runs."""

    def run(ids: list, sizes: list, drawn: list) -> dict[str, list]:
        keys, owners, n = [], [], []
        for i, size, raw in zip(ids, sizes, drawn):
            sketch = np.frombuffer(raw, np.uint64)
            own = runs(sketch, RUN) if len(sketch) > max(k // 4, SINGLES) else runs(sketch, 1)
            if len(sketch) < k:
                own = np.concatenate([own, runs(sketch, SHORT_RUN)])
            own = np.unique(own)
            keys.append(own.view(np.int64))
            owners.append(np.full(len(own), i))
            n.append(np.full(len(own), size))
        return {"key": np.concatenate(keys), "id": np.concatenate(owners), "n": np.concatenate(n)}

    return map_columns(heads.select("id", "n_shingles", "sketch"), run, "key bigint, id bigint, n int")


def estimate(a: np.ndarray, b: np.ndarray, k: int) -> tuple[float, int]:
    """Share of the bottom-k of the union that both sketches hold, and the size of that bottom-k."""
    union = np.union1d(a, b)[:k]
    return np.isin(np.intersect1d(a, b, assume_unique=True), union, assume_unique=True).sum() / len(union), len(union)


def linked_classes(
    docs: DataFrame,
    text_col: str = "text",
    id_col: str = "doc_id",
    shingle: int = SHINGLE,
    similarity: float = SIMILARITY,
    min_tokens: int = MIN_TOKENS,
    k: int = SKETCH,
) -> tuple[DataFrame, DataFrame]:
    """``members(id, class_id)`` of equal token sequences and ``links(a, b, similarity)`` between classes, a < b."""
    drawn = cut(sketches(docs, text_col, id_col, shingle, min_tokens, k))
    classes = drawn.groupBy("twin").agg(F.min("id").alias("class_id"))
    members = cut(drawn.select("id", "twin").join(classes, "twin").select("id", "class_id").distinct())
    heads = drawn.join(members.where("id = class_id").select("id"), "id", "left_semi").dropDuplicates(["id"])
    candidates = cut(_pairs(_postings(heads, k), similarity))
    side = _only(heads.select("id", "sketch"), candidates)
    drawn_pairs = candidates.join(side.select(F.col("id").alias("a"), F.col("sketch").alias("x")), "a").join(
        side.select(F.col("id").alias("b"), F.col("sketch").alias("y")), "b"
    )

    def near_enough(a: list, b: list, xs: list, ys: list) -> dict[str, list]:
        out: dict[str, list] = {"a": [], "b": []}
        for i, j, x, y in zip(a, b, xs, ys):
            guess, size = estimate(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), k)
            if guess >= similarity - ERRORS * (similarity * (1 - similarity) / size) ** 0.5:
                out["a"].append(i)
                out["b"].append(j)
        return out

    near = cut(map_columns(drawn_pairs.select("a", "b", "x", "y"), near_enough, "a bigint, b bigint"))
    return members, _verified(docs, near, text_col, id_col, shingle, similarity)


def _pairs(lists: DataFrame, similarity: float = 0.0) -> DataFrame:
    """Distinct ``a, b`` with a < b of the members ``key, id, n`` of one list whose sizes ``n`` allow the similarity.

    Lists are shuffled once, sorted and paired as they pass, most of them having one member. A list of more than ``LIST``
    members is handed on instead: it is cut into blocks by a hash of the id, and each pair of its blocks is a key of its own,
    so that no task works on all pairs of a long list.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 3
        long_key = None

        def flush(parts: list[np.ndarray], whole: bool) -> tuple[list, list[np.ndarray]]:
            """The pairs and long members of all lists, and what is kept: the last list, unless it can't go on."""
            nonlocal long_key
            key, ids, n = parts
            if not len(key):
                return [], parts
            begin = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1])
            size = np.diff(np.concatenate([begin, [len(key)]]))
            if not whole and not (size[-1] > LIST or key[-1] == long_key):
                kept, begin, size = [x[begin[-1] :] for x in parts], begin[:-1], size[:-1]
            else:
                kept = [x[:0] for x in parts]
            out = []
            for at, m in zip(begin[size > 1].tolist(), size[size > 1].tolist()):
                if m <= LIST and key[at] != long_key:
                    i, j = _corners(m)
                    first, second = at + i, at + j
                    fits = (np.minimum(n[first], n[second]) >= similarity * np.maximum(n[first], n[second])) & (ids[first] != ids[second])
                    x, y = ids[first[fits]], ids[second[fits]]
                    out.append((np.minimum(x, y), np.maximum(x, y), None))
                else:
                    out.append((ids[at : at + m], n[at : at + m], key[at]))
                    long_key = key[at]
            for at in begin[size == 1].tolist() if long_key is not None else ():
                if key[at] == long_key:
                    out.append((ids[at : at + 1], n[at : at + 1], key[at]))
            return out, kept

        def batch(out: list) -> Iterator[pa.RecordBatch]:
            if out:
                keys = np.concatenate([np.full(len(x), 0 if k is None else k) for x, _, k in out])
                paired = np.concatenate([np.full(len(x), k is None) for x, _, k in out])
                second = np.concatenate([y for _, y, _ in out]).astype(np.int64)
                columns = [np.concatenate([x for x, _, _ in out]), (second, ~paired), (second, paired), (keys, paired)]
                yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64(), mask=c[1]) if isinstance(c, tuple) else pa.array(c, pa.int64()) for c in columns], names=["a", "b", "n", "key"])

        for part in batches:
            own = [part.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3)]
            out, held = flush([np.concatenate(x) for x in zip(held, own)], False)
            yield from batch(out)
        yield from batch(flush(held, True)[0])

    placed = lists.select("key", "id", F.col("n").cast("bigint")).repartition("key").sortWithinPartitions("key")
    found = cut(placed.mapInArrow(run, "a bigint, b bigint, n bigint, key bigint").distinct())
    members = found.where("b is null").select("key", F.col("a").alias("id"), "n")
    sizes = members.groupBy("key").agg(F.ceil(F.count("*") / F.lit(LIST)).cast("int").alias("parts"))
    blocks = members.join(sizes, "key").withColumn("own", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    left = blocks.select("key", F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("own").alias("i"), every.alias("j"))
    right = blocks.select("key", F.col("id").alias("b"), F.col("n").alias("n_b"), every.alias("i"), F.col("own").alias("j"))
    fits = (F.col("a") < F.col("b")) & (F.least("n_a", "n_b") >= F.lit(similarity) * F.greatest("n_a", "n_b"))
    across = left.join(right, ["key", "i", "j"]).where(fits).select("a", "b")
    return found.where("b is not null").select("a", "b").unionByName(across).distinct()


@lru_cache(maxsize=16)
def _corners(m: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of places of a short list."""
    return np.triu_indices(m, 1)


def _only(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """The ``rows`` whose ``id`` is in a pair; ``pairs`` must be cheap to read again."""
    wanted = cut(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    return rows.join(F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted, "id", "left_semi")


def _verified(docs: DataFrame, near: DataFrame, text_col: str, id_col: str, shingle: int, similarity: float) -> DataFrame:
    """Exact similarity of the candidate pairs; only the texts of candidates travel."""
    texts = _only(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("body")).where("body is not null"), near).dropDuplicates(["id"])
    pairs = near.join(texts.select(F.col("id").alias("a"), F.col("body").alias("x")), "a").join(
        texts.select(F.col("id").alias("b"), F.col("body").alias("y")), "b"
    )

    def compare(a: list, b: list, xs: list, ys: list) -> dict[str, list]:
        sets: dict[int, np.ndarray] = {}
        for i, text in [*zip(a, xs), *zip(b, ys)]:
            if i not in sets:
                sets[i] = shingle_hashes(word_hashes(tokens(text)), shingle)
        value = []
        for i, j in zip(a, b):
            both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            value.append(both / (len(sets[i]) + len(sets[j]) - both))
        return {"a": a, "b": b, "similarity": value}

    return map_columns(pairs.select("a", "b", "x", "y"), compare, "a bigint, b bigint, similarity double").where(
        F.col("similarity") >= similarity
    )


def similar_pairs(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", **parameters) -> DataFrame:
    """Pairs ``id_a < id_b`` of similar documents, equal texts included."""
    members, links = linked_classes(docs, text_col, id_col, **parameters)
    left = members.select(F.col("id").alias("x"), F.col("class_id").alias("a"))
    right = members.select(F.col("id").alias("y"), F.col("class_id").alias("b"))
    equal = _pairs(members.select(F.col("class_id").alias("key"), "id", F.lit(1).alias("n"))).select(F.col("a").alias("id_a"), F.col("b").alias("id_b"))
    across = links.select("a", "b").join(left, "a").join(right, "b")
    return equal.unionByName(across.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")))


def groups(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", max_rounds: int = 50, **parameters) -> DataFrame:
    """One row per document: ``id, class_id`` (equal texts), ``group_id`` (connected through links), ``links`` of its class.

    Connected components by alternating large-star and small-star rounds over the links between classes, which never leave
    the executors; the rounds needed grow with the logarithm of the longest chain.
    """
    members, found = linked_classes(docs, text_col, id_col, **parameters)
    links = cut(found.select("a", "b"))
    labels = components(links, max_rounds)
    degree = links.select(F.explode(F.array("a", "b")).alias("class_id")).groupBy("class_id").agg(F.count("*").alias("links"))
    everyone = docs.select(F.col(id_col).alias("id")).where("id is not null").distinct()
    return (
        everyone.join(members, "id", "left")
        .withColumn("class_id", F.coalesce("class_id", "id"))
        .join(labels, "class_id", "left")
        .join(degree, "class_id", "left")
        .select("id", "class_id", F.coalesce("group_id", "class_id").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"))
    )


def components(links: DataFrame, max_rounds: int = 50) -> DataFrame:
    """``class_id, group_id``: the smallest id reachable over ``links(a, b)``."""
    edges = links.select(F.least("a", "b").alias("v"), F.greatest("a", "b").alias("u")).where("u != v").distinct()
    before = None
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u != v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select("v", "m", "u")
        edges = cut(
            small.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(small.select("u", F.col("m").alias("v")))
            .where("u != v")
            .distinct()
        )
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("the components did not settle; raise max_rounds")
    return edges.select(F.col("u").alias("class_id"), F.col("v").alias("group_id")).groupBy("class_id").agg(F.min("group_id").alias("group_id"))
