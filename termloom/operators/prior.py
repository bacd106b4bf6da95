"""Subject tags of corpora: suggested, validated, added or ruled out by an action log, and what the judge is told of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ACTIVE = ("validated", "added")
_STATUS = {"suggest": "suggested", "validate": "validated", "invalidate": "invalidated", "add": "added", "manifest": "added"}


def fold_tags(actions: DataFrame) -> DataFrame:
    """corpus, iri, label, confidence, status, source, first: one row per tag from a log (corpus, seq, action, iri, label, confidence).

    'add' (a person) and 'manifest' make a tag or set it to added; 'suggest' makes one only where there is none; 'validate' and 'invalidate' change a tag that is there and do
    nothing else. The tag keeps the label and confidence of the row that made it; ``first`` is that row's seq. The state of a tag depends on its last action that counts, so
    the log is folded by two aggregates, not replayed. Unknown actions and rows without corpus or iri don't count."""
    a = actions.filter(F.col("corpus").isNotNull() & F.col("iri").isNotNull() & F.col("action").isin(*_STATUS))
    made = F.col("action").isin("suggest", "add", "manifest")
    start = a.groupBy("corpus", "iri").agg(F.min_by(F.struct("label", "confidence", "action"), F.when(made, F.col("seq"))).alias("m"), F.min(F.when(made, F.col("seq"))).alias("first")).filter("first is not null")
    later = a.join(start.select("corpus", "iri", "first"), ["corpus", "iri"]).filter((F.col("seq") >= F.col("first")) & ((F.col("action") != "suggest") | (F.col("seq") == F.col("first"))))
    status = F.lit(None).cast("string")
    for k, v in _STATUS.items():
        status = F.when(F.col("last") == k, v).otherwise(status)
    set_by = F.when(F.col("action").isin("add", "manifest"), F.col("seq"))
    state = later.groupBy("corpus", "iri").agg(F.max_by("action", "seq").alias("last"), F.max_by("action", set_by).alias("added"))
    source = F.when(F.col("added") == "add", "human").when(F.col("added") == "manifest", "manifest").otherwise("suggester")
    return start.join(state, ["corpus", "iri"]).select("corpus", "iri", "m.label", F.coalesce("m.confidence", F.lit(1.0)).alias("confidence"), status.alias("status"), source.alias("source"), "first")


def active_tags(tags: DataFrame) -> DataFrame:
    return tags.filter(F.col("status").isin(*ACTIVE))


def judge_context(tags: DataFrame) -> DataFrame:
    """corpus, context: the labels of a corpus's active tags in the order in which they came, as one text."""
    g = active_tags(tags).groupBy("corpus").agg(F.array_sort(F.collect_list(F.struct("first", "label"))).alias("t"))
    return g.select("corpus", F.array_join(F.transform("t", lambda x: x["label"]), " / ").alias("context"))


def merge_suggestions(tags: DataFrame, suggestions: DataFrame) -> DataFrame:
    """The tags with suggestions (corpus, iri, label, confidence) added where a corpus doesn't have them; nothing is overwritten."""
    w = Window.partitionBy("corpus", "iri").orderBy(F.col("confidence").desc(), "label")
    new = suggestions.withColumn("_n", F.row_number().over(w)).filter("_n = 1").join(tags.select("corpus", "iri"), ["corpus", "iri"], "left_anti")
    return tags.unionByName(new.select("corpus", "iri", "label", "confidence", F.lit("suggested").alias("status"), F.lit("suggester").alias("source"), F.lit(None).cast(tags.schema["first"].dataType).alias("first")))
