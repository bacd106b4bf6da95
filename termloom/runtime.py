"""Session, table loading, lineage cuts and skew handling shared by all operators."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings concepts taxonomy_nodes "
    "gold_rows gold_values label_proposals ranked_candidates answer_rules split_shares container_sizes"
).split()


def local_session(name: str = "termloom", cores: str = "*", partitions: int = 8) -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Keep the shared folder the cluster names in spark.checkpoint.dir; only where none is set, as in tests, use a
    temporary one, which needs a master that runs on this machine alone."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = os.path.join(tempfile.gettempdir(), f"termloom-checkpoints-{os.getuid()}")
    sc.setCheckpointDir(named)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it from there: ends the lineage, survives lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` over at least as many partitions as there are cores, for stages whose work is heavy for their bytes. A table that
    has that many already isn't shuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, *keys) if keys else df.repartition(cores)


def hot_keys(counts: DataFrame, key: str, n: str, share: int = 64, least: int = 100_000) -> list:
    """Keys that hold more than 1/share of all rows, from a table with one row and its count ``n`` for each key; by that
    definition fewer than ``share`` of them. Keys under ``least`` rows are left out: a task holds those easily."""
    total = counts.agg(F.sum(n)).first()[0] or 0
    bound = max(least, total // share)
    return [r[0] for r in counts.filter(F.col(n) > bound).select(key).limit(share).collect()]


def salted_join(big: DataFrame, small: DataFrame, key: str, hot: list, spread: Column, how: str = "inner", salts: int = 16) -> DataFrame:
    """Equi-join on ``key`` where the rows of ``big`` with a hot key are spread over ``salts`` tasks by ``spread`` and the
    hot rows of ``small`` (unique or few per key) are repeated. Without hot keys it is the plain join."""
    if not hot:
        return big.join(small, key, how)
    is_hot = F.col(key).isin(hot)
    left = big.withColumn("_salt", F.when(is_hot, F.pmod(F.xxhash64(spread), F.lit(salts))).otherwise(F.lit(0)).cast("int"))
    all_salts = F.array(*[F.lit(i) for i in range(salts)])
    right = small.withColumn("_salt", F.explode(F.when(is_hot, all_salts).otherwise(F.array(F.lit(0)))))
    return left.join(right, [key, "_salt"], how).drop("_salt")
