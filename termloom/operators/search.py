"""Label, prefix and definition search: similarity joins of terms with the concept catalog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termloom.functions.scoring import relevance, with_words
from termloom.functions.text import content_words, strip
from termloom.operators.relevance import best_concepts


def _grams(text: Column, n: int) -> Column:
    """Distinct substrings of n characters."""
    s = F.lower(F.coalesce(text, F.lit("")))
    return F.when(F.length(s) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(s) - n + 1), lambda i: F.substring(s, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))


def _starts(words: Column) -> Column:
    return F.array_distinct(F.transform(words, lambda w: F.substring(w, 1, 3)))


def _concept_keys(concepts: DataFrame) -> DataFrame:
    names = F.concat(F.array("label", "preferred_label", "definition"), F.coalesce("alternative_labels", F.array().cast("array<string>")))
    words = F.array_distinct(F.flatten(F.transform(names, lambda s: content_words(s))))
    tag = lambda p, a: F.transform(a, lambda x: F.concat(F.lit(p), x))
    holds = F.array_distinct(F.concat(_grams(F.col("label"), 4), _grams(F.col("preferred_label"), 4), _grams(F.col("definition"), 4)))
    short = F.array_distinct(F.concat(*[_grams(F.col("definition"), n) for n in (1, 2, 3)]))
    whole = F.array(F.concat(F.lit("="), F.lower("label")), F.concat(F.lit("="), F.lower("preferred_label")))
    inside = F.when(F.length("label") >= 4, F.array(F.concat(F.lit("<"), F.substring(F.lower("label"), 1, 4)))).otherwise(F.array().cast("array<string>"))
    keys = F.array_distinct(F.array_compact(F.concat(tag("w", _starts(words)), tag(">", holds), tag("s", short), whole, inside)))
    return concepts.select("iri", F.explode(keys).alias("key"))


def _term_keys(terms: DataFrame) -> DataFrame:
    q = strip(F.lower("term"))
    tag = lambda p, a: F.transform(a, lambda x: F.concat(F.lit(p), x))
    none = F.array().cast("array<string>")
    long = F.when(F.length(q) >= 4, F.array(F.concat(F.lit(">"), F.substring(q, 1, 4)))).otherwise(none)
    short = F.when(F.length(q).between(1, 3), F.array(F.concat(F.lit("s"), q))).otherwise(none)
    keys = F.array_distinct(F.concat(tag("w", _starts(content_words(F.col("term")))), long, short, F.array(F.concat(F.lit("="), q)), tag("<", _grams(q, 4))))
    return terms.select("term", F.explode(keys).alias("key"))


def candidate_pairs(terms: DataFrame, concepts: DataFrame) -> DataFrame:
    """Distinct (term, iri) that can score above 0: a word pair with equal first three letters (every word credit implies
    that), one text inside the other, or equality. No pair that scores is lost, and no cross join is needed."""
    return _term_keys(terms).join(_concept_keys(concepts), "key").select("term", "iri").distinct()


def scored_pairs(terms: DataFrame, concepts: DataFrame, penalty: float = 1.0) -> DataFrame:
    """term, iri, label, branch, score > 0. Each distinct term is scored once; blank and null terms find nothing."""
    t = terms.select("term").filter(strip(F.col("term")) != "").distinct()
    ready, words = with_words(concepts)
    asked = t.withColumn("_qw", content_words(F.col("term")))
    pairs = candidate_pairs(t, concepts).join(ready, "iri").join(asked, "term")
    score = relevance(F.col("term"), F.col("label"), F.col("definition"), F.col("alternative_labels"), F.col("preferred_label"), F.col("_qw"), penalty, words)
    return pairs.select("term", "iri", "label", "branch", score.alias("score")).filter("score > 0")


def top_k(scored: DataFrame, by: str, k: int, order: list[Column] | None = None) -> DataFrame:
    w = Window.partitionBy(by).orderBy(*(order or [F.col("score").desc(), F.col("iri")]))
    return scored.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)


def label_search(terms: DataFrame, concepts: DataFrame, k: int = 20) -> DataFrame:
    """The k best concepts of each term: score descending, then iri."""
    return best_concepts(terms, concepts, k)


def definition_search(terms: DataFrame, concepts: DataFrame, k: int = 20) -> DataFrame:
    """As label_search, over definitions scored as if they were labels."""
    as_labels = concepts.filter("definition is not null").select("iri", F.col("definition").alias("label"), F.lit(None).cast("string").alias("definition"), F.array().cast("array<string>").alias("alternative_labels"), F.lit(None).cast("string").alias("preferred_label"), "branch")
    return best_concepts(terms, as_labels, k)


def prefix_search(terms: DataFrame, concepts: DataFrame, k: int = 50) -> DataFrame:
    """term, iri, place: concepts any label of which begins with the term, by iri. Blank terms find nothing.

    The join is on the first characters: up to eight of the term, with the same number of the label."""
    names = F.array_distinct(F.array_compact(F.concat(F.array("label", "preferred_label"), F.coalesce("alternative_labels", F.array().cast("array<string>")))))
    labels = concepts.select("iri", F.explode(names).alias("name")).select("iri", F.lower("name").alias("name"))
    heads = labels.select("iri", "name", F.explode(F.transform(F.sequence(F.lit(1), F.least(F.length("name"), F.lit(8))), lambda n: F.substring("name", F.lit(1), n))).alias("head")).filter("length(name) > 0")
    t = terms.select("term").filter(strip(F.col("term")) != "").distinct().withColumn("q", strip(F.lower("term"))).withColumn("head", F.substring("q", 1, 8))
    hits = t.join(heads, "head").filter(F.startswith("name", F.col("q"))).select("term", "iri").distinct()
    return top_k(hits, "term", k, [F.col("iri")])
