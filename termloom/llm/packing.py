"""Filling fixed-capacity containers with documents along a space-filling curve (problem 7)."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.llm.encode import DEFAULT_PATH, PieceIds, blocks
from termloom.runtime import cut, spread

#: Dimensions of the projection and bits of each coordinate on the curve.
DIMENSIONS, BITS = 3, 10
#: Neighbours along the curve that are packed together, and how many blocks a container may stay open: what lies in one container was at most so far apart.
BLOCK, OPEN_BLOCKS = 256, 64
#: A task packs at least so many containers of the largest capacity, so that its last, half-empty ones weigh little.
TASK_CONTAINERS = 256


class PieceVectors(PieceIds):
    """Also keeps, for each piece of text, its hashed coordinates: the rows of a random projection that its hash picks. Pieces of
    fewer than four characters say nothing about the content and have none."""

    _loaded: dict[str, PieceIds] = {}

    def _clear(self) -> None:
        super()._clear()
        self.at_hash = np.zeros((1 << 14, DIMENSIONS), np.float32)

    def learn(self, later: list[str], first: list[str]) -> None:
        n = self.known
        super().learn(later, first)
        while self.known > len(self.at_hash):
            self.at_hash = np.concatenate([self.at_hash, np.zeros_like(self.at_hash)])
        marks = np.fromiter((xxhash.xxh64_intdigest(p.lower()) if len(p) > 3 else 0 for p in [*later, *first]), np.uint64, self.known - n)
        for d in range(DIMENSIONS):
            u = ((marks >> np.uint64(21 * d)) & np.uint64((1 << 21) - 1)).astype(np.float64) / (1 << 21)
            self.at_hash[n : self.known, d] = np.where(marks == 0, 0.0, (u - 0.5) * np.sqrt(12.0))


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Index along the Hilbert curve of integer points (rows) with coordinates of ``bits`` bits: neighbours on the curve are
    neighbours in space. The transposed index is reached by undoing the rotations of each level, from the highest bit down."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            swap = (x[i] & q) == 0
            t = np.where(swap, (x[0] ^ x[i]) & p, 0)
            x[0] ^= np.where(swap, t, p)
            if i:
                x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[n - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= t
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


def _normal_share(z: np.ndarray) -> np.ndarray:
    """Share of a normal distribution below z, near enough to spread coordinates evenly."""
    return 1.0 / (1.0 + np.exp(-1.702 * np.clip(z, -12, 12)))


def sizes(docs: DataFrame, path: str = DEFAULT_PATH, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, tokens, place: the size of each document in tokens and its place on the curve. Null and empty texts have 0 tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = PieceVectors.load(path)
        for b in blocks(batches):
            numbers, counts = pieces.pieces([t or "" for t in b.column(1).to_pylist()])
            ends = np.cumsum(counts)
            lengths = np.concatenate([[0], np.cumsum(pieces.length[numbers])])
            tokens = lengths[ends] - lengths[ends - counts]
            vectors = np.zeros((len(counts), DIMENSIONS))
            for k, (a, z) in enumerate(zip(ends - counts, ends)):
                which, often = np.unique(numbers[a:z], return_counts=True)
                rows, weight = pieces.at_hash[which], np.log1p(often)
                norm = np.sqrt((weight**2 * (rows != 0).any(axis=1)).sum())
                if norm:
                    vectors[k] = weight @ rows / norm
            grid = np.minimum((_normal_share(vectors) * (1 << BITS)).astype(np.int64), (1 << BITS) - 1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(tokens, pa.int64()), pa.array(hilbert(grid), pa.int64())], names=[key, "tokens", "place"])

    kind = docs.schema[key].dataType.simpleString()
    return spread(docs.select(key, text)).mapInArrow(run, f"{key} {kind}, tokens long, place long")


class Packer:
    """Best fit into the open containers of one capacity, block after block along the curve; items of a block come largest first."""

    def __init__(self, name: str, capacity: int, first: int):
        self.name, self.capacity, self.next, self.blocks = name, capacity, first, 0
        self.open: list[tuple[int, int, int]] = []  # (space left, container, block that opened it), ascending

    def _new(self) -> int:
        self.next += 1
        return self.next - 1

    def block(self, items: list[tuple]) -> Iterator[tuple]:
        """items: (key, tokens, place). Yields (name, container, key, piece, first_token, tokens, place)."""
        rest, cap = [], self.capacity
        for key, tokens, place in items:
            full = tokens // cap if tokens > cap else 0
            for k in range(full):
                yield self.name, self._new(), key, k, k * cap, cap, place
            if tokens > full * cap or not full:
                rest.append((tokens - full * cap, full, key, place))
        rest.sort(key=lambda r: -r[0])
        for size, piece, key, place in rest:
            i = bisect_left(self.open, (size, -1, -1))
            if i < len(self.open):
                left, container, since = self.open.pop(i)
            else:
                left, container, since = cap, self._new(), self.blocks
            if left > size or size == 0:
                insort(self.open, (left - size, container, since))
            yield self.name, container, key, piece, piece * cap, size, place
        self.blocks += 1
        self.open = [o for o in self.open if o[2] > self.blocks - OPEN_BLOCKS]  # what lies far back on the curve is closed


def pack(sized: DataFrame, capacities: list[tuple[str, int]], key: str = "doc_id", block: int = BLOCK) -> DataFrame:
    """container_name, container_id, key, piece, first_token, tokens, place: where each document goes, for each capacity, and its place on the curve.

    Documents are range-sorted by their place on the curve, and each task packs its stretch of it: block after block of neighbours, by best fit into containers that one of
    the last blocks has opened. A document is split only where it is larger than the capacity: into full containers and one rest. Documents without tokens take
    no space and lie in some container. A container holds documents of one task only; there are as many tasks as leave each enough to fill."""
    kind = sized.schema[key].dataType.simpleString()
    total = sized.agg(F.sum("tokens")).first()[0] or 0
    most = max((c for _, c in capacities), default=1)
    parts = max(1, min(sized.sparkSession.sparkContext.defaultParallelism * 4 + total // (4_096 * most), total // (TASK_CONTAINERS * most)))
    ordered = sized.repartitionByRange(int(parts), "place", key).sortWithinPartitions("place", key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        first = (task.partitionId() if task else 0) << 36
        packers = [Packer(n, c, first) for n, c in capacities]

        def flush(items: list[tuple]) -> Iterator[pa.RecordBatch]:
            rows = [r for p in packers for r in p.block(items)]
            if rows:
                kinds = (pa.string(), pa.int64(), key_type, pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["container_name", "container_id", key, "piece", "first_token", "tokens", "place"])

        held: list[tuple] = []
        key_type = None
        for b in batches:
            key_type = b.column(0).type
            held += zip(*(c.to_pylist() for c in b.columns))
            while len(held) >= block:
                yield from flush(held[:block])
                held = held[block:]
        if held:
            yield from flush(held)

    return ordered.select(key, "tokens", "place").mapInArrow(run, f"container_name string, container_id long, {key} {kind}, piece int, first_token long, tokens long, place long")


def capacities_of(containers: DataFrame) -> list[tuple[str, int]]:
    """The container sizes, a table of a few rows; more than 100 are refused, rows without a name or a positive capacity are left out."""
    rows = [(r[0], int(r[1])) for r in containers.select("container_name", "capacity_tokens").limit(101).collect() if r[0] is not None and r[1] is not None and r[1] > 0]
    if len(rows) > 100:
        raise ValueError("too many container sizes")
    return sorted(set(rows))


def fill_containers(docs: DataFrame, containers: DataFrame, path: str = DEFAULT_PATH) -> DataFrame:
    """Problem 7: every document in containers of every size."""
    sized = cut(sizes(docs.filter("doc_id is not null"), path))
    return pack(sized, capacities_of(containers))


def fill_report(packed: DataFrame, containers: DataFrame) -> DataFrame:
    """container_name, containers, documents, tokens, unused_share, least (the containers that any packing needs), and curve_spread: how far apart on the curve the
    documents of a container lie, as the root of the mean variance of their places within containers over that of all; 1 for a random order, 0 for equal places."""
    per = packed.groupBy("container_name", "container_id").agg(F.sum("tokens").alias("t"), F.count_if(F.col("piece") == 0).alias("d"), F.var_pop("place").alias("v"), F.count(F.lit(1)).alias("n"))
    within = F.sum(F.when(F.col("n") > 1, F.col("v") * F.col("n"))) / F.sum(F.when(F.col("n") > 1, F.col("n")))
    total = per.groupBy("container_name").agg(F.count(F.lit(1)).alias("containers"), F.sum("d").alias("documents"), F.sum("t").alias("tokens"), within.alias("within"))
    whole = packed.groupBy("container_name").agg(F.var_pop("place").alias("whole"))
    cap = containers.groupBy("container_name").agg(F.max("capacity_tokens").alias("cap"))
    out = total.join(cap, "container_name").join(whole, "container_name")
    return out.select(
        "container_name", "containers", "documents", "tokens", (1 - F.col("tokens") / (F.col("containers") * F.col("cap"))).alias("unused_share"), F.ceil(F.col("tokens") / F.col("cap")).alias("least"),
        F.sqrt(F.try_divide(F.col("within"), F.col("whole"))).alias("curve_spread"),
    )
