"""Top N items within every group by mergeable bounded heaps (problem 3)."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

#: A task hands its heaps on and starts anew when they hold so many entries together; the merge after the shuffle makes up for it.
HELD_ENTRIES = 400_000


class _Worst:
    """Heap entry; the smallest is the one to give up first: lowest score, then greatest identifier."""

    __slots__ = ("score", "iri")

    def __init__(self, score: float, iri: str):
        self.score, self.iri = score, iri

    def __lt__(self, other: _Worst) -> bool:
        return self.score < other.score or (self.score == other.score and self.iri > other.iri)


class BoundedHeap:
    """Keeps the N best (score, identifier) pairs of a group with different identifiers. Merging is adding."""

    __slots__ = ("n", "best", "heap")

    def __init__(self, n: int):
        self.n, self.best, self.heap = n, {}, []

    def add(self, score: float, iri: str) -> int:
        """Returns by how much the number of kept identifiers grew."""
        best = self.best
        if (had := best.get(iri)) is not None:
            if score > had:
                best[iri] = score
                heapq.heappush(self.heap, _Worst(score, iri))  # the older entry is stale now
                if len(self.heap) > 4 * self.n + 8:
                    self.heap = [_Worst(s, i) for i, s in best.items()]
                    heapq.heapify(self.heap)
            return 0
        if len(best) < self.n:
            best[iri] = score
            heapq.heappush(self.heap, _Worst(score, iri))
            return 1
        while best.get((worst := self.heap[0]).iri) != worst.score:
            heapq.heappop(self.heap)
        if score > worst.score or (score == worst.score and iri < worst.iri):
            heapq.heappop(self.heap)
            del best[worst.iri]
            best[iri] = score
            heapq.heappush(self.heap, _Worst(score, iri))
        return 0


def _partial(held: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps: dict[tuple, BoundedHeap] = {}
        kept = 0

        def out() -> Iterator[pa.RecordBatch]:
            cols: list[list] = [[], [], [], [], []]
            for (a, b), h in heaps.items():
                for iri, score in h.best.items():
                    for c, v in zip(cols, (a, b, h.n, score, iri)):
                        c.append(v)
                if len(cols[0]) >= 50_000:
                    yield batch(cols)
                    cols = [[], [], [], [], []]
            if cols[0]:
                yield batch(cols)

        def batch(cols: list[list]) -> pa.RecordBatch:
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["g1", "g2", "n", "score", "iri"])

        for b in batches:
            for g1, g2, n, score, iri in zip(*(c.to_pylist() for c in b.columns)):
                if (h := heaps.get((g1, g2))) is None:
                    h = heaps[g1, g2] = BoundedHeap(n)
                kept += h.add(score, iri)
            if kept > held:
                yield from out()
                heaps.clear()
                kept = 0
        yield from out()

    return run


def top_n(rows: DataFrame, group: tuple[str, str], score: str, ident: str, n: Column, held: int = HELD_ENTRIES) -> DataFrame:
    """The ``n`` best identifiers of every group with their place from 1: score descending, then identifier ascending by
    code points; an identifier counts once, with its highest score. Groups with fewer identifiers give what they have.

    Rows with a null in the group, the identifier or ``n``, a null or NaN score, or n < 1 don't count. Each task feeds its rows to one bounded
    heap per group before the shuffle, so that a group with a third of all rows sends at most n rows per task (and per
    hand-over of a full task); after the one shuffle on the group the heaps of all tasks are merged."""
    g1, g2 = group
    clean = rows.select(F.col(g1).cast("string").alias("g1"), F.col(g2).cast("int").alias("g2"), n.cast("int").alias("n"), F.col(score).cast("double").alias("score"), F.col(ident).alias("iri"))
    clean = clean.filter("g1 is not null and g2 is not null and iri is not null and n >= 1 and score is not null and not isnan(score)")
    parts = clean.mapInArrow(_partial(held), "g1 string, g2 int, n int, score double, iri string")
    merged = parts.repartition("g1", "g2").groupBy("g1", "g2", "iri").agg(F.max("score").alias("score"), F.max("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("g1", "g2").orderBy(F.col("score").desc(), F.col("iri")))
    return merged.withColumn("place", place).filter("place <= n").select(F.col("g1").alias(g1), F.col("g2").alias(g2), "place", F.col("iri").alias(ident), F.col("score").alias(score))


def ranked_top(candidates: DataFrame, rules: DataFrame) -> DataFrame:
    """Problem 3: the first top_k candidates of each (item_id, config_version). Configurations without a rule give none."""
    k = rules.filter("config_version is not null").groupBy("config_version").agg(F.max("top_k").alias("_top_k"))
    rows = candidates.select("item_id", "config_version", "iri", "score").join(k, "config_version")
    return top_n(rows, ("item_id", "config_version"), "score", "iri", F.col("_top_k"))
