"""Annotations and feedback: insights, display segments, lifecycle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RATINGS = ("up", "down", "dismissed")


def feedback_counts(feedback: DataFrame) -> DataFrame:
    """stage, up, down, dismissed, total: per stage ('overall' for null), and over all stages as stage null."""
    f = feedback.withColumn("stage", F.coalesce("stage", F.lit("overall")))
    return f.rollup("stage").agg(*[F.count_if(F.col("rating") == r).alias(r) for r in RATINGS], F.count(F.lit(1)).alias("total"))


def top_concepts(feedback: DataFrame, rating: str, k: int = 10) -> DataFrame:
    """iri, label, count, place of the concepts most often rated so; label of the last such feedback; ties by which came first (id)."""
    g = feedback.filter((F.col("rating") == rating) & F.col("iri").isNotNull()).groupBy("iri").agg(F.count(F.lit(1)).alias("count"), F.max_by("label", "id").alias("label"), F.min("id").alias("_first"))
    w = Window.orderBy(F.col("count").desc(), "_first")
    return g.orderBy(F.col("count").desc(), "_first").limit(k).withColumn("place", F.row_number().over(w)).drop("_first")


def recent(feedback: DataFrame, k: int = 20) -> DataFrame:
    return feedback.orderBy(F.col("created_at").desc(), "id").limit(k)


def segments(docs: DataFrame, spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, start, end, ids: stretches of text between neighbouring span borders, each with the annotations that cover it, the surest per concept, best first.
    docs: key, n (length); spans: key, id, start, end, iri, confidence. Texts without length have none."""
    d = docs.filter("n > 0")
    s = spans.join(d, key).select(key, "id", "start", "end", "iri", "confidence", "n")
    points = s.select(key, F.explode(F.array(F.greatest(F.lit(0), F.least("start", "n")), F.greatest(F.lit(0), F.least("end", "n")))).alias("p")).unionByName(d.select(key, F.explode(F.array(F.lit(0), F.col("n").cast("int"))).alias("p"))).distinct()
    w = Window.partitionBy(key).orderBy("p")
    cuts = points.withColumn("e", F.lead("p").over(w)).filter("e is not null").select(key, F.col("p").alias("s"), "e")
    cover = cuts.join(s, [key]).filter("start <= s and end >= e")
    best = cover.groupBy(key, "s", "e", F.coalesce("iri", F.concat(F.lit("#"), F.col("id"))).alias("c")).agg(F.min_by(F.struct("confidence", "id"), F.struct(-F.col("confidence"), F.col("id"))).alias("b"))
    ranked = best.groupBy(key, "s", "e").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("b.confidence")).alias("o"), F.col("b.id").alias("id")))), lambda x: x["id"]).alias("ids"))
    return cuts.join(ranked, [key, "s", "e"], "left").select(key, F.col("s").alias("start"), F.col("e").alias("end"), F.coalesce("ids", F.array().cast("array<string>")).alias("ids"))


def _event(kind: str, note: Column, at: Column) -> Column:
    return F.struct(F.lit(kind).alias("stage"), note.alias("detail"), at.alias("at"))


def reject(annotations: DataFrame, which: Column, note: str = "", at: Column | None = None) -> DataFrame:
    """Sets state, dismissed_at and a lineage entry where ``which`` holds."""
    at = at if at is not None else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return annotations.withColumns({"state": F.when(which, "rejected").otherwise(F.col("state")), "dismissed_at": F.when(which, at).otherwise(F.col("dismissed_at")), "lineage": F.when(which, F.array_append("lineage", _event("rejected", F.lit(note), at))).otherwise(F.col("lineage"))})


def restore(annotations: DataFrame, which: Column, at: Column) -> DataFrame:
    return annotations.withColumns({"state": F.when(which, "confirmed").otherwise(F.col("state")), "dismissed_at": F.when(which, F.lit(None).cast("string")).otherwise(F.col("dismissed_at")), "lineage": F.when(which, F.array_append("lineage", _event("restored", F.lit(""), at))).otherwise(F.col("lineage"))})


def promote(concepts: Column, i: Column) -> Column:
    """The concept list with entry i (from 0) first. An index out of range raises."""
    n = F.size(concepts)
    rest = F.filter(concepts, lambda c, k: k != i)
    return F.when((i >= 0) & (i < n), F.concat(F.array(F.get(concepts, i)), rest)).otherwise(F.raise_error(F.lit("concept index out of range")).cast("void"))


def cascade_promote(annotations: DataFrame, old: str, new: str) -> DataFrame:
    """Where ``old`` comes first and ``new`` is present, ``new`` comes first."""
    primary = F.get("concepts", F.lit(0))["iri"] == old
    there = F.exists("concepts", lambda c: c["iri"] == new)
    front = F.concat(F.filter("concepts", lambda c: c["iri"] == new), F.filter("concepts", lambda c: c["iri"] != new))
    return annotations.withColumn("concepts", F.when(primary & there, front).otherwise(F.col("concepts")))
