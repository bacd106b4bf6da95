"""Feedback entries as an append-only store; the last row of an id holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.sources import files

SCHEMA = "id string, job_id string, annotation_id string, rating string, stage string, iri string, label string, comment string, created_at string, seq long, deleted boolean"


class FeedbackStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _log(self) -> DataFrame:
        return self.spark.read.schema(SCHEMA).parquet(self.path) if files.exists(self.spark, self.path) else self.spark.createDataFrame([], SCHEMA)

    def save(self, entries: DataFrame) -> None:
        """Appends entries; ids must be plain names."""
        if entries.filter(~F.rlike("id", F.lit(r"^[A-Za-z0-9._-]+$"))).limit(1).count():
            raise ValueError("an id isn't a plain name")
        seq = self._log().agg(F.coalesce(F.max("seq"), F.lit(0)) + 1).first()[0]
        whole = self.spark.createDataFrame([], SCHEMA).unionByName(entries, allowMissingColumns=True)
        whole.withColumn("seq", F.lit(seq)).withColumn("deleted", F.coalesce("deleted", F.lit(False))).write.mode("append").parquet(self.path)

    def all(self) -> DataFrame:
        """One row per id, without deleted ones."""
        last = self._log().groupBy("id").agg(F.max_by(F.struct("*"), "seq").alias("r")).select("r.*")
        return last.filter("not deleted").drop("seq", "deleted")

    def delete(self, ident: str) -> bool:
        there = self.all().filter(F.col("id") == ident)
        if not there.limit(1).count():
            return False
        self.save(there.withColumn("deleted", F.lit(True)))
        return True

    def of_annotation(self, job: str, annotation: str) -> DataFrame:
        """The first entry (by id) of an annotation of a job."""
        return self.all().filter((F.col("job_id") == job) & (F.col("annotation_id") == annotation)).orderBy("id").limit(1)
