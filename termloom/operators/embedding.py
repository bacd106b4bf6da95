"""Vectors: hashed embeddings and nearest neighbours."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termloom.functions.text import tokenize

#: Query vectors that one scan of the table answers; more come in further scans.
QUERY_BLOCK = 20_000


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of equal length, summed from the left; 0 for a zero vector."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(F.lit(0.0))


def hashing_buckets(rows: DataFrame, key: str, text: Column) -> DataFrame:
    """key, bucket, weight: tokens counted by the last byte of their md5 (256 buckets), to unit length."""
    t = rows.select(key, F.explode(tokenize(text)).alias("w"))
    n = t.groupBy(key, F.conv(F.right(F.md5("w"), F.lit(2)), 16, 10).cast("int").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    norm = n.groupBy(key).agg(F.sqrt(F.sum(F.col("n") * F.col("n")).cast("double")).alias("norm"))
    return n.join(norm, key).select(key, "bucket", (F.col("n") / F.col("norm")).alias("weight"))


def nearest(queries: DataFrame, vectors: DataFrame, k: int = 20, block: int = QUERY_BLOCK, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """query_id, key, place, cosine: the k nearest rows of every query row, exactly. Queries are taken in blocks of bounded size; each task
    multiplies its stretch of the table with the block and keeps k per query, and the tasks' winners are merged. Null vectors have no place."""
    total = queries.count()
    parts = max(1, -(-total // block))
    out = None
    for p in range(parts):
        q = queries if parts == 1 else queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == p)
        rows = [r for r in q.select("query_id", column).limit(2 * block + 65).collect() if r[1] is not None]
        if len(rows) > 2 * block + 64:
            raise ValueError("a block of queries is too large")
        if not rows:
            continue
        ids = [r[0] for r in rows]
        m = np.array([r[1] for r in rows], np.float64)
        norm = np.linalg.norm(m, axis=1, keepdims=True)
        m = np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)
        part = vectors.filter(F.col(column).isNotNull()).select(key, column).mapInArrow(_scan(ids, m, k, key), f"query_id {queries.schema['query_id'].dataType.simpleString()}, {key} {vectors.schema[key].dataType.simpleString()}, cosine double")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return queries.sparkSession.createDataFrame([], f"query_id long, {key} long, place int, cosine double")
    w = Window.partitionBy("query_id").orderBy(F.col("cosine").desc(), key)
    return out.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k).select("query_id", key, "place", "cosine")


def score_candidates(asked: DataFrame, vectors: DataFrame, key: str) -> DataFrame:
    """query_id, key, cosine of given candidates: asked has query_id, embedding and key, vectors has key and vector. Unknown candidates have no row."""
    j = asked.join(vectors, key).filter(F.col("embedding").isNotNull() & F.col("vector").isNotNull())
    return j.select("query_id", key, cosine(F.col("embedding"), F.col("vector")).alias("cosine"))


def similarity(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """pairs with cosine: that of the hashed embeddings of two texts (columns a and b), 0 where one has no token."""
    texts = pairs.select(F.col(a).alias("_t")).unionByName(pairs.select(F.col(b).alias("_t"))).filter("_t is not null").distinct()
    h = hashing_buckets(texts, "_t", F.col("_t"))
    keyed = pairs.select(a, b).distinct()
    left = keyed.join(h.select(F.col("_t").alias(a), "bucket", F.col("weight").alias("_x")), a)
    right = left.join(h.select(F.col("_t").alias(b), "bucket", F.col("weight").alias("_y")), [b, "bucket"])
    sums = right.groupBy(a, b).agg(F.sum(F.col("_x") * F.col("_y")).alias("cosine"))
    return pairs.join(sums, [a, b], "left").withColumn("cosine", F.coalesce("cosine", F.lit(0.0)))


def _scan(ids: list, m: np.ndarray, k: int, key: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = np.array(b.column(1).to_pylist(), np.float64)
            norm = np.linalg.norm(v, axis=1, keepdims=True)
            v = np.divide(v, norm, out=np.zeros_like(v), where=norm > 0)
            names = np.array(b.column(0).to_pylist())
            for at in range(0, len(m), 2000):
                c = np.round(m[at : at + 2000] @ v.T, 9)
                order = np.lexsort((np.broadcast_to(names, c.shape), -c), axis=1)[:, :k]
                rows = np.repeat(np.arange(len(c)), order.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array([ids[at + r] for r in rows]), pa.array(names[order.ravel()]), pa.array(np.take_along_axis(c, order, 1).ravel())], names=["query_id", key, "cosine"])

    return run
