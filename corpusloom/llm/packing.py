"""Problem 8: filling containers of fixed capacity with whole documents, along a space-filling curve.

1. Each document's tokens are counted and hashed into a vector, projected to ``DIMENSIONS`` dimensions; its place on a
   Hilbert curve through their grid is its key.
2. For every capacity, documents larger than it are cut into full pieces, which fill containers of their own, and a rest.
3. Items are range-sorted by capacity, key and id; each partition is a stretch of the curve. In it, windows of neighbours
   are packed largest first, each into the fullest open container that has room; containers that are full enough close, and
   only ``OPEN`` stay open for the next window. A partition leaves at most ``OPEN`` containers short, so the unused
   space is bounded by the number of partitions, not of documents.

Rows of one key or one source are ordinary neighbours: range bounds fall between ids, so no group lands in one task.

Defined results: documents without tokens (NULL or empty text) come out with a NULL container, rows without an id not at
all; repeated ids are packed as rows of their own; a specification named twice counts once with its last capacity, and
specifications with a NULL or non-positive capacity are refused. Extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import map_columns
from corpusloom.llm.tokenizing import encoding, vocabulary_path
from corpusloom.plans.lineage import cut

DIMENSIONS = 3
GRID_BITS = 10
WINDOW = 2048
OPEN = 128
FULL = 0.995
MAX_SPECS = 1000

_PROJECTION = np.random.default_rng(17).normal(0, 1, (4096, DIMENSIONS)).astype(np.float32)


def hilbert(points: np.ndarray, bits: int = GRID_BITS) -> np.ndarray:
    """Hilbert keys of integer points ``[n, dims]`` with ``bits`` bits a coordinate."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where(x[n - 1] & q, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | (x[i] >> b & 1)
    return key


def curve_points(tokens: np.ndarray) -> np.ndarray:
    """The grid cell of a document: its hashed token vector, projected, scaled by its length and squashed."""
    v = _PROJECTION[tokens % len(_PROJECTION)].sum(0) / max(1.0, len(tokens)) ** 0.5
    return np.minimum((0.5 + 0.5 * np.tanh(v / 4)) * (1 << GRID_BITS), (1 << GRID_BITS) - 1).astype(np.int64)


def sized(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", vocabulary: str | None = None) -> DataFrame:
    """``id, n_tokens, curve`` of every document."""
    path = vocabulary or vocabulary_path()

    def run(ids: list, texts: list) -> dict[str, list]:
        enc = encoding(path)
        counts, cells = [], []
        for text in texts:
            found = np.array(enc.encode_ordinary(text or ""), np.int64)
            counts.append(len(found))
            cells.append(curve_points(found))
        return {"id": ids, "n_tokens": counts, "curve": hilbert(np.array(cells).reshape(len(cells), DIMENSIONS))}

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("body")).where("id is not null")
    return map_columns(source, run, "id bigint, n_tokens int, curve bigint")


class Packer:
    """Best fit with a bounded number of open containers."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.rooms: list[tuple[int, int]] = []  # free space and number of each open container, ascending
        self.held: dict[int, list] = {}
        self.made = 0

    def put(self, size: int, item) -> tuple[int, list] | None:
        """Place an item; the container and its items if that closes it."""
        at = bisect_left(self.rooms, (size, -1))
        if at < len(self.rooms):
            room, box = self.rooms.pop(at)
        else:
            room, box = self.capacity, self.made
            self.made += 1
            self.held[box] = []
        self.held[box].append(item)
        room -= size
        if room <= (1 - FULL) * self.capacity:
            return box, self.held.pop(box)
        insort(self.rooms, (room, box))
        return None

    def close(self, keep: int) -> list[tuple[int, list]]:
        """Close the fullest containers until ``keep`` are open."""
        n = max(0, len(self.rooms) - keep)
        done, self.rooms = self.rooms[:n], self.rooms[n:]
        return [(box, self.held.pop(box)) for _, box in done]


_OUT = "spec_id int, doc_id bigint, piece_no int, piece_tokens int, container_id bigint, container_tokens int"


def packed(docs: DataFrame, specs: DataFrame, text_col: str = "text", id_col: str = "doc_id", vocabulary: str | None = None) -> DataFrame:
    """``spec_id, doc_id, piece_no, piece_tokens, container_id, container_tokens`` for every capacity and document."""
    capacities = {r[0]: r[1] for r in specs.select("spec_id", "capacity_tokens").limit(MAX_SPECS + 1).collect()}
    if len(capacities) > MAX_SPECS or any(c is None or c < 1 for c in capacities.values()):
        raise ValueError(f"at most {MAX_SPECS} container specifications, each of at least one token")
    spark = docs.sparkSession
    size = cut(sized(docs, text_col, id_col, vocabulary))
    numbered = [(s, capacities[s], i) for i, s in enumerate(sorted(capacities))]
    spec = spark.createDataFrame(numbered, "spec_id int, capacity int, spec_no int")
    each = size.where("n_tokens > 0").join(F.broadcast(spec))
    full = F.when(F.col("n_tokens") > F.col("capacity"), F.floor(F.col("n_tokens") / F.col("capacity"))).otherwise(F.lit(0)).cast("int")
    each = each.withColumn("full", full).withColumn("rest", F.col("n_tokens") - F.col("full") * F.col("capacity"))
    items = each.where("rest > 0").select("spec_id", "spec_no", "capacity", "curve", "id", F.col("full").alias("piece_no"), F.col("rest").cast("int").alias("size"))
    tasks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = items.repartitionByRange(tasks, "spec_id", "curve", "id").sortWithinPartitions("spec_id", "curve", "id")

    def run(batches):
        task = TaskContext.get().partitionId()
        packers: dict[int, Packer] = {}
        window: list[tuple] = []

        def rows(spec_id: int, boxes: list) -> list[tuple]:
            out = []
            spec_no = next(n for s, _, n in numbered if s == spec_id)
            for box, held in boxes:
                total = sum(s for _, _, s in held)
                out += [(spec_id, i, no, s, task << 40 | spec_no << 30 | box, total) for i, no, s in held]
            return out

        def flush(last: bool) -> list[tuple]:
            out = []
            window.sort(key=lambda w: -w[4])
            for spec_id, capacity, i, no, s in window:
                p = packers.setdefault(spec_id, Packer(capacity))
                done = p.put(s, (i, no, s))
                if done:
                    out += rows(spec_id, [done])
            window.clear()
            for spec_id, p in packers.items():
                out += rows(spec_id, p.close(0 if last else OPEN))
            return out

        def batch(found: list[tuple]):
            columns = list(zip(*found)) or [()] * 6
            types = (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=[x.split()[0] for x in _OUT.split(", ")])

        for b in batches:
            for spec_id, capacity, i, no, s in zip(*(b.column(c).to_pylist() for c in ("spec_id", "capacity", "id", "piece_no", "size"))):
                if window and (len(window) >= WINDOW or window[-1][0] != spec_id):
                    other = window[-1][0]
                    yield batch(flush(last=other != spec_id))
                    if other != spec_id:
                        packers.clear()
                window.append((spec_id, capacity, i, no, s))
        yield batch(flush(last=True))

    rest = ordered.mapInArrow(run, _OUT)
    whole = each.where("full > 0").select(
        "spec_id", F.col("id").alias("doc_id"), F.explode(F.sequence(F.lit(0), F.col("full") - 1)).alias("piece_no"), F.col("capacity").alias("piece_tokens"),
        F.col("capacity").alias("container_tokens"),
    )
    own = -1 - F.shiftrightunsigned(F.xxhash64("spec_id", "doc_id", "piece_no"), 1)
    whole = whole.select("spec_id", "doc_id", "piece_no", "piece_tokens", own.alias("container_id"), "container_tokens")
    none = size.where("n_tokens = 0").join(F.broadcast(spec)).select(
        "spec_id", F.col("id").alias("doc_id"), F.lit(0).alias("piece_no"), F.lit(0).alias("piece_tokens"), F.lit(None).cast("bigint").alias("container_id"), F.lit(None).cast("int").alias("container_tokens")
    )
    return rest.unionByName(whole).unionByName(none)


def container_fill(assigned: DataFrame, specs: DataFrame) -> DataFrame:
    """``spec_id, container_id, items, tokens, capacity_tokens, fill`` of every container."""
    each = assigned.where("container_id is not null").groupBy("spec_id", "container_id").agg(F.count("*").alias("items"), F.sum("piece_tokens").alias("tokens"))
    return each.join(F.broadcast(specs.select("spec_id", "capacity_tokens").limit(MAX_SPECS)), "spec_id").withColumn("fill", F.col("tokens") / F.col("capacity_tokens"))
