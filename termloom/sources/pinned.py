"""Sources and sinks whose content is pinned by a hash."""

from __future__ import annotations

import hashlib
import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from termloom.sources import files


def content_hash(df: DataFrame) -> str:
    """Hash of a table's rows whatever their order, the number of partitions and files: sha256 per row, and the sums of its parts over all rows."""
    row = F.sha2(F.to_json(F.struct(*sorted(df.columns))), 256)
    part = lambda i: F.sum(F.conv(F.substring(row, 1 + 8 * i, 8), 16, 10).cast("decimal(38,0)")).cast("string")
    sums = df.agg(F.count(F.lit(1)).cast("string"), *[part(i) for i in range(8)]).first()
    return hashlib.sha256("|".join(str(x) for x in sums).encode()).hexdigest()


def header_signature(header: list[str | None]) -> str:
    return hashlib.sha256("\t".join("" if h is None else h for h in header).encode()).hexdigest()


def read_json_lines(spark: SparkSession, path: str, schema: str, pin: str | None = None, unique: str | None = None) -> DataFrame:
    """JSON lines with a fixed schema. A content hash that differs from the pin or a repeated key raises; a missing path is an empty table only without a pin."""
    if pin is None and not files.exists(spark, path):
        return spark.createDataFrame([], schema)
    df = spark.read.schema(schema).json(path)
    if pin is not None and (got := content_hash(df)) != pin:
        raise ValueError(f"content of {path} has hash {got}, expected {pin}")
    if unique is not None and df.groupBy(unique).count().filter("count > 1").limit(1).count():
        raise ValueError(f"{unique} is not unique in {path}")
    return df


def write_version(df: DataFrame, folder: str, name: str, version: int) -> dict:
    """Writes a new version as JSON lines and returns its manifest; an existing version is never overwritten."""
    path = f"{folder}/{name}-v{version}"
    df.write.mode("errorifexists").json(path)
    return {"name": name, "version": version, "path": path, "rows": df.count(), "content_sha256": content_hash(df)}


def latest_version(folder: str, name: str) -> str | None:
    """Path of the version with the greatest number."""
    spark = SparkSession.getActiveSession()
    found = [(int(m.group(1)), n) for n in files.names(spark, folder) if (m := re.fullmatch(rf"{re.escape(name)}-v(\d+)", n))]
    return f"{folder}/{max(found)[1]}" if found else None


def canonical_json(payload: dict) -> str:
    return json.dumps(payload, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def write_summary(payload: dict, path: str) -> str:
    """Canonical JSON of an aggregate; returns its sha256."""
    text = canonical_json(payload)
    files.write_text(SparkSession.getActiveSession(), path, text + "\n")
    return hashlib.sha256(text.encode()).hexdigest()


def write_item_csv(scores: DataFrame, path: str) -> None:
    """Per-item report in item order; lists are written with blanks between."""
    flat = [F.array_join(c, " ").alias(c) if isinstance(scores.schema[c].dataType, T.ArrayType) else F.col(c) for c in scores.columns]
    scores.select(*flat).repartitionByRange("item_id").sortWithinPartitions("item_id").write.mode("overwrite").option("header", True).csv(path)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """item_id, answers of such a report."""
    return spark.read.option("header", True).csv(path).select("item_id", F.filter(F.split(F.coalesce("answers", F.lit("")), r"\s+"), lambda x: x != "").alias("answers"))


def read_blocklist(spark: SparkSession, path: str) -> DataFrame:
    """surface_term, blocked_iri, domain, reason from {"blocked_aliases": [...]}; of equal keys the last holds."""
    rows = spark.read.schema("blocked_aliases array<struct<surface_term:string,blocked_iri:string,domain:string,reason:string>>").option("multiLine", True).json(path)
    r = rows.select(F.posexplode("blocked_aliases").alias("i", "x")).select("i", "x.*")
    key = [F.lower("surface_term").alias("k"), "blocked_iri", F.lower(F.coalesce("domain", F.lit(""))).alias("d")]
    return r.groupBy(*key).agg(F.max_by(F.struct("surface_term", "domain", "reason"), "i").alias("x")).select("x.surface_term", "blocked_iri", "x.domain", "x.reason")


def read_outcomes(spark: SparkSession, path: str) -> DataFrame:
    """test, outcome of a JUnit XML report."""
    t = spark.read.format("xml").option("rowTag", "testcase").schema("_classname string, _name string, failure string, error string, skipped string").load(path)
    return t.select(F.concat_ws("::", "_classname", "_name").alias("test"), F.when(F.col("failure").isNotNull(), "failed").when(F.col("error").isNotNull(), "error").when(F.col("skipped").isNotNull(), "skipped").otherwise("passed").alias("outcome"))


def file_hashes(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path, sha256 of whole files."""
    return spark.read.format("binaryFile").load(paths).select("path", F.sha2("content", 256).alias("sha256"))
