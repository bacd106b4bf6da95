"""Reconciling what two taggers found, by text and concept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A concept only the dictionary found needs this confidence; similarity above which a conflict resolves itself.
DICTIONARY_ALONE = 0.60
AUTO_RESOLVE = 0.85
# Words that don't count when a definition is compared.
OVERLAP_STOPWORDS = "the a an of to in for and or is on at by with".split()


def boosted(a: Column, b: Column, most: float = 0.05) -> Column:
    base = F.greatest(a, b)
    return F.least(F.lit(1.0), base + F.lit(most) * (F.lit(1.0) - base))


def definition_overlap(context: Column, definition: Column) -> Column:
    stop = F.array(*[F.lit(w) for w in OVERLAP_STOPWORDS])
    words = lambda c: F.filter(F.array_distinct(F.array_except(F.split(F.trim(F.lower(F.coalesce(c, F.lit("")))), r"(?U)\s+"), stop)), lambda w: w != "")
    a, b = words(context), words(definition)
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)).cast("double") / F.greatest(F.size(a), F.size(b))).otherwise(F.lit(0.0))


def _side(df: DataFrame, scope: list[str], name: str) -> DataFrame:
    """One row per text and concept: the last one (by ord) holds; pos keeps where the key first stood."""
    k = [*scope, "key", "iri0"]
    rows = df.withColumn("key", F.lower("text")).withColumn("iri0", F.coalesce("iri", F.lit("")))
    one = rows.groupBy(*k).agg(F.max_by(F.struct("text", "iri", "label", "definition", "confidence"), "ord").alias(name), F.min("ord").alias(f"{name}_pos"))
    return one


def reconcile(dictionary: DataFrame, model: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """category, key, iri, confidence, source of what two sides (text, iri, label, definition, confidence, ord) agree on or found alone, per scope.

    Same text and concept: both agree, with a boosted confidence. A row without concept joins the other side's first open row of its text, the
    dictionary's first. What is left stands alone: the dictionary's from a confidence of 0.6, the model's always. Each text has
    at most one row without concept on each side, so first matches are windows, not loops."""
    s = scope or []
    d, m = _side(dictionary, s, "d"), _side(model, s, "m")
    k = [*s, "key", "iri0"]
    full = d.join(m, k, "full_outer")
    both = full.filter("d is not null and m is not null")
    only_d, only_m = full.filter("m is null").select(*k, "d", "d_pos"), full.filter("d is null").select(*k, "m", "m_pos")
    t = [*s, "key"]
    first_m = only_m.withColumn("_n", F.row_number().over(Window.partitionBy(*t).orderBy("m_pos"))).filter("_n = 1")
    bound_d = only_d.filter("iri0 = ''").select(*t, "d").join(first_m.select(*t, "m", F.col("iri0").alias("m_iri")), t)
    left_m = only_m.join(bound_d.select(*t, F.col("m_iri").alias("iri0")), k, "left_anti")
    left_d = only_d.join(bound_d.select(*t, F.lit("").alias("iri0")), k, "left_anti")
    first_d = left_d.withColumn("_n", F.row_number().over(Window.partitionBy(*t).orderBy("d_pos"))).filter("_n = 1")
    bound_m = left_m.filter("iri0 = ''").select(*t, "m").join(first_d.select(*t, "d", F.col("iri0").alias("d_iri")), t)
    alone_d = left_d.join(bound_m.select(*t, F.col("d_iri").alias("iri0")), k, "left_anti").filter(F.col("d.confidence") >= DICTIONARY_ALONE)
    alone_m = left_m.join(bound_m.select(*t, F.lit("").alias("iri0")), k, "left_anti")

    def out(df: DataFrame, category: str, row: str, confidence: Column, source: str) -> DataFrame:
        return df.select(*s, F.lit(category).alias("category"), "key", F.coalesce(F.col(f"{row}.iri"), F.lit("")).alias("iri"), confidence.alias("confidence"), F.lit(source).alias("source"))

    agreed = boosted(F.col("d.confidence"), F.col("m.confidence"))
    return (
        out(both, "both_agree", "m", agreed, "reconciled")
        .unionByName(out(bound_d, "both_agree", "m", agreed, "reconciled"))
        .unionByName(out(bound_m, "both_agree", "d", agreed, "reconciled"))
        .unionByName(out(alone_d, "dictionary_only", "d", F.col("d.confidence"), "dictionary"))
        .unionByName(out(alone_m, "model_only", "m", F.col("m.confidence"), "model"))
    )


def reconcile_with_triage(dictionary: DataFrame, model: DataFrame, similarity, scope: list[str] | None = None) -> DataFrame:
    """As reconcile, but two rows of one text with different concepts are a conflict that similarity decides (settle_conflicts). ``similarity`` takes a table and the names of two text
    columns and adds cosine.

    What isn't the same on both sides is paired text by text in order: the first open row of one side with the first of the other, and so on, as a serial matcher would.
    A pair with a concept on one side only agrees; one with two concepts is a conflict."""
    s = scope or []
    d, m = _side(dictionary, s, "d"), _side(model, s, "m")
    k, t = [*s, "key", "iri0"], [*s, "key"]
    full = d.join(m, k, "full_outer")
    both = full.filter("d is not null and m is not null").select(*t, "d", "m")
    place = lambda pos: F.row_number().over(Window.partitionBy(*t).orderBy(pos, "iri0"))
    left = full.filter("m is null").select(*t, "iri0", "d", "d_pos").withColumn("_n", place("d_pos")).drop("iri0")
    right = full.filter("d is null").select(*t, "iri0", "m", "m_pos").withColumn("_n", place("m_pos")).drop("iri0")
    paired = left.join(right, [*t, "_n"], "full_outer")
    open_ = lambda side: F.coalesce(F.col(f"{side}.iri"), F.lit("")) == ""
    met = paired.filter("d is not null and m is not null")
    agreed = boosted(F.col("d.confidence"), F.col("m.confidence"))
    col = lambda row: F.coalesce(F.col(f"{row}.iri"), F.lit(""))
    shape = lambda df, category, iri, confidence, source: df.select(*s, F.lit(category).alias("category"), "key", iri.alias("iri"), confidence.alias("confidence"), F.lit(source).alias("source"))
    alike = met.filter(open_("d") | open_("m"))
    clash = met.filter(~open_("d") & ~open_("m"))
    name = lambda row: F.coalesce(F.nullif(F.col(f"{row}.label"), F.lit("")), F.col(f"{row}.text"))
    near = similarity(clash.withColumns({"_dl": name("d"), "_ml": name("m")}), "key", "_dl").withColumnRenamed("cosine", "d_similarity")
    near = similarity(near, "key", "_ml").withColumnRenamed("cosine", "m_similarity")
    return (
        shape(both, "both_agree", col("m"), agreed, "reconciled")
        .unionByName(shape(alike, "both_agree", F.when(open_("d"), col("m")).otherwise(col("d")), agreed, "reconciled"))
        .unionByName(shape(paired.filter((F.col("m").isNull()) & (F.col("d.confidence") >= DICTIONARY_ALONE)), "dictionary_only", col("d"), F.col("d.confidence"), "dictionary"))
        .unionByName(shape(paired.filter(F.col("d").isNull()), "model_only", col("m"), F.col("m.confidence"), "model"))
        .unionByName(shape(settle_conflicts(near, s), "conflict_resolved", F.col("iri"), F.col("confidence"), "reconciled"))
    )


def settle_conflicts(pairs: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """Rows of pairs whose sides name different concepts for one text (key, d and m structs, d_similarity, m_similarity): the more similar side wins
    above 0.85 (the dictionary on a tie) and takes the similarity as confidence if larger; else the larger definition overlap; else both stay."""
    dov, mov = definition_overlap(F.col("key"), F.col("d.definition")), definition_overlap(F.col("key"), F.col("m.definition"))
    ds, ms = F.col("d_similarity"), F.col("m_similarity")
    sure = F.greatest(ds, ms) > AUTO_RESOLVE
    keep_d = F.when(sure, ds >= ms).when(dov > mov, True).when(mov > dov, False).otherwise(True)
    keep_m = F.when(sure, ds < ms).when(dov > mov, False).when(mov > dov, True).otherwise(True)
    side = lambda n, sim: F.struct(F.col(f"{n}.iri").alias("iri"), F.when(sure, F.greatest(F.col(f"{n}.confidence"), sim)).otherwise(F.col(f"{n}.confidence")).alias("confidence"))
    rows = F.filter(F.array(F.when(keep_d, side("d", ds)), F.when(keep_m, side("m", ms))), lambda x: x.isNotNull())
    s = scope or []
    return pairs.select(*s, "key", F.explode(rows).alias("r")).select(*s, "key", "r.iri", "r.confidence", F.lit("conflict_resolved").alias("category"))
