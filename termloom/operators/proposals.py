"""Proposals for labels that name no concept: containment, search and phrases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termloom.functions.normalize import label_key, normal_label, plural_variants
from termloom.functions.text import ANALYSIS_STOPWORDS, decompose, jaccard, key_tokens, strip, words_lit
from termloom.operators.relevance import best_concepts

NONE = "array<string>"


def query_variants(leaf: Column) -> Column:
    """The texts that are searched for a leaf: itself, its normal form, and its parts; each once, without blank ones."""
    every = F.concat(F.array(leaf, normal_label(leaf)), F.slice(decompose(leaf), F.lit(2), F.size(decompose(leaf))))
    return F.array_distinct(F.filter(F.transform(every, lambda t: strip(t)), lambda t: F.length(t) > 0))


def noun_phrases(text: Column) -> Column:
    """Phrases of a cell: bracketed remarks dropped, cut at separators; each chunk of several words, its pairs of neighbours with a word that counts, and its
    words of three letters or more that count; each once, in order."""
    chunks = F.split(F.regexp_replace(normal_label(text), r"\([^)]*\)", " "), r"[/,;:|]+")
    stop = words_lit(ANALYSIS_STOPWORDS)
    counts = lambda w: ~F.array_contains(stop, F.lower(w))

    def of(chunk: Column) -> Column:
        words = F.regexp_extract_all(chunk, F.lit(r"[A-Za-z][A-Za-z'&.\-]*"), F.lit(0))
        n = F.size(words)
        whole = F.when(n > 1, F.array(F.array_join(words, " "))).otherwise(F.array().cast(NONE))
        at = F.when(n > 1, F.sequence(F.lit(1), n - 1)).otherwise(F.array().cast("array<int>"))
        pairs = F.transform(F.filter(at, lambda i: counts(F.element_at(words, i)) | counts(F.element_at(words, i + 1))), lambda i: F.array_join(F.slice(words, i, 2), " "))
        return F.concat(whole, pairs, F.filter(words, lambda w: counts(w) & (F.length(w) > 2)))

    return F.array_distinct(F.flatten(F.transform(chunks, of)))


def plausible(label: Column, candidate: Column) -> Column:
    """Whether two labels share a word that counts."""
    return F.arrays_overlap(key_tokens(label_key(label)), key_tokens(label_key(candidate)))


def heads_or_tails(query: Column, label: Column, longest: int = 4) -> Column:
    """Whether the words of a query open or close a label of at most ``longest`` words."""
    words = lambda t: F.transform(F.regexp_extract_all(t, F.lit(r"[A-Za-z][A-Za-z'&.\-]*"), F.lit(0)), lambda w: F.lower(w))
    q, x = words(query), words(label)
    n, m = F.size(q), F.size(x)
    fits = (n > 0) & (m > 0) & (m <= longest) & (n <= m)
    return F.when(fits, (F.slice(x, F.lit(1), F.greatest(n, F.lit(1))) == q) | (F.slice(x, F.greatest(m - n + 1, F.lit(1)), F.greatest(n, F.lit(1))) == q)).otherwise(F.lit(False))


def containment(labels: DataFrame, concepts: DataFrame, k: int = 5) -> DataFrame:
    """label, iri, score, place: concepts one of whose normal names contains the label's normal form (or one of its plural forms), or is contained in it, at word
    borders; score is 100 times the shorter length over the longer; an equal name is no proposal. Labels: a column ``label``.

    Containment at word borders implies that the first word of the shorter is a word of the longer, so both sides meet on that word: names and needles send their first
    word and all their words, and no pair is lost."""
    t = labels.select("label").filter(strip(F.col("label")) != "").distinct()
    needles = F.transform(plural_variants(F.col("label")), lambda x: F.lower(x))
    n = t.select("label", F.explode(F.array_union(F.array(label_key(F.col("label"))), needles)).alias("needle")).filter("needle <> ''").distinct()
    names = F.array_compact(F.concat(F.array("preferred_label", "label"), F.coalesce("alternative_labels", F.array().cast(NONE))))
    keys = concepts.select("iri", F.explode(F.array_distinct(names)).alias("name")).select("iri", label_key(F.col("name")).alias("key")).filter("key <> ''").distinct()
    first = lambda c: F.element_at(F.split(F.col(c), " "), 1)
    every = lambda c: F.explode(F.array_distinct(F.split(F.col(c), " ")))
    padded = lambda outer, inner: F.contains(F.concat(F.lit(" "), F.col(outer), F.lit(" ")), F.concat(F.lit(" "), F.col(inner), F.lit(" ")))
    distinct = keys.select("key").distinct()
    a = n.withColumn("w", first("needle")).join(distinct.select("key", every("key").alias("w")), "w").filter(padded("key", "needle"))
    b = n.select("label", "needle", every("needle").alias("w")).join(distinct.withColumn("w", first("key")), "w").filter(padded("needle", "key"))
    pairs = a.select("label", "needle", "key").unionByName(b.select("label", "needle", "key")).filter("needle <> key").distinct()
    ratio = F.least(F.length("needle"), F.length("key")).cast("double") / F.greatest(F.length("needle"), F.length("key"))
    best = pairs.select("label", "key", ratio.alias("r")).groupBy("label", "key").agg(F.max("r").alias("r")).join(keys, "key").groupBy("label", "iri").agg(F.max("r").alias("r"))
    w = Window.partitionBy("label").orderBy(F.col("score").desc(), "iri")
    return best.select("label", "iri", F.round(F.col("r") * 100, 3).alias("score")).withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)


def searched(labels: DataFrame, concepts: DataFrame, k: int = 5, hits: int = 20) -> DataFrame:
    """label, iri, score, overlap, place: the search hits of a label that share a word with it, by share of words, then score, then iri."""
    found = best_concepts(labels.select(F.col("label").alias("term")), concepts, hits)
    j = found.select(F.col("term").alias("query"), "iri", "label", "score").filter(plausible(F.col("query"), F.col("label")))
    j = j.select(F.col("query").alias("label"), "iri", "score", jaccard(key_tokens(label_key(F.col("query"))), key_tokens(label_key(F.col("label")))).alias("overlap"))
    w = Window.partitionBy("label").orderBy(F.col("overlap").desc(), F.col("score").desc(), "iri")
    return j.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)


def proposed(labels: DataFrame, concepts: DataFrame, k: int = 5, hits: int = 20) -> DataFrame:
    """label, iri, score, method, place: proposals by containment first, then by search, each concept once."""
    a = containment(labels, concepts, k).select("label", "iri", "score", F.lit("containment").alias("method"), F.lit(0).alias("rung"), "place")
    b = searched(labels, concepts, k, hits).select("label", "iri", "score", F.lit("search").alias("method"), F.lit(1).alias("rung"), "place")
    first = Window.partitionBy("label", "iri").orderBy("rung", "place")
    one = a.unionByName(b).withColumn("_n", F.row_number().over(first)).filter("_n = 1")
    w = Window.partitionBy("label").orderBy("rung", "place")
    return one.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k).select("label", "iri", "score", "method", "place")
