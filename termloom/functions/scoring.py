"""Relevance of concepts for query terms as Column expressions: no UDF, so Catalyst sees through them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.functions.text import content_words, strip

#: Share of its score that a concept loses when its label consists of extra words only.
SPECIFICITY = 0.4


def word_credit(a: Column, b: Column) -> Column:
    """1 for equal words, 0.8 where one begins the other, 0.7 for a long common beginning, else 0."""
    la, lb = F.length(a), F.length(b)
    k = F.greatest(F.lit(4), F.floor((F.least(la, lb) * 7 + 9) / 10).cast("int"))
    return (
        F.when(a == b, F.lit(1.0))
        .when((la >= 3) & (lb >= 3) & (F.startswith(a, b) | F.startswith(b, a)), F.lit(0.8))
        .when((la >= 5) & (lb >= 5) & (F.substring(a, F.lit(1), k) == F.substring(b, F.lit(1), k)), F.lit(0.7))
        .otherwise(F.lit(0.0))
    )


def _one_way(source: Column, target: Column) -> Column:
    total = F.aggregate(F.array_sort(source), F.lit(0.0), lambda acc, w: acc + F.coalesce(F.array_max(F.transform(target, lambda d: word_credit(w, d))), F.lit(0.0)))
    return total / F.size(source)


def word_overlap(query: Column, target: Column) -> Column:
    """How well two sets of words meet: the mean best credit of the query's words, or three quarters of that of the target's
    where it has two words or more. Sums run over sorted words, since float addition depends on the order."""
    back = F.when(F.size(target) >= 2, _one_way(target, query) * 0.75).otherwise(F.lit(0.0))
    return F.when((F.size(query) > 0) & (F.size(target) > 0), F.greatest(_one_way(query, target), back)).otherwise(F.lit(0.0))


def rounded(x: Column) -> Column:
    """One decimal, half up: the same floating-point steps in every engine."""
    return F.floor(x * 10 + 0.5) / 10.0


def relevance_raw(query: Column, label: Column, definition: Column, synonyms: Column, preferred: Column, content: Column | None = None, penalty: float = 1.0, words: dict[str, Column] | None = None) -> Column:
    """Score 0 to 99 of a concept for a query, unrounded: 99 for the label itself, 92 and 88 for one containing the other, else by
    overlapping words; preferred label, synonyms and definition count less. Labels with more content than the query lose up to 40 %.
    A null or empty label scores 0; a null query is an empty one; other nulls are absent. ``words`` may bring the content words of label,
    definition, preferred and synonyms (a list of lists) as columns, so that each concept is tokenised once and not per pair."""
    w = words or {}
    q = strip(F.lower(F.coalesce(query, F.lit(""))))
    qc = content_words(query) if content is None else content
    low = F.lower(label)
    lc = w.get("label", content_words(label))
    n = F.length(q)
    inside = F.when((n >= 4) & F.contains(low, q), F.lit(92.0)).when((F.length(low) >= 4) & F.contains(q, low) & (F.length(low).cast("double") / F.nullif(n, F.lit(0)) > 0.3), F.lit(88.0)).otherwise(F.lit(0.0))
    by_label = F.greatest(inside, word_overlap(qc, lc) * 88.0)
    plow = F.lower(preferred)
    by_preferred = (
        F.when(F.coalesce(F.length(preferred), F.lit(0)) == 0, F.lit(0.0)).when(q == plow, F.lit(90.0)).when((n >= 4) & F.contains(plow, q), F.lit(84.0)).otherwise(word_overlap(qc, w.get("preferred", content_words(preferred))) * 86.0)
    )
    names = w.get("synonyms", synonym_words(synonyms))
    by_synonym = F.coalesce(F.array_max(F.transform(names, lambda s: word_overlap(qc, s) * 82.0)), F.lit(0.0))
    dlow = F.lower(definition)
    by_definition = F.when(F.coalesce(F.length(definition), F.lit(0)) == 0, F.lit(0.0)).otherwise(F.greatest(F.when(F.contains(dlow, q), F.lit(60.0)).otherwise(F.lit(0.0)), word_overlap(qc, w.get("definition", content_words(definition))) * 55.0))
    primary = F.greatest(by_label, by_preferred, by_synonym)
    final = F.when(primary > 0, primary + F.least(by_definition * 0.12, F.lit(8.0))).otherwise(by_definition)
    extra = F.size(F.array_except(lc, qc)).cast("double")
    cut = F.when((F.size(lc) > 0) & (F.size(qc) > 0) & (final > 0) & (extra > 0) & (F.size(lc) > F.size(qc)), F.lit(1.0) - F.least(F.greatest(extra / F.size(lc) * (SPECIFICITY * penalty), F.lit(0.0)), F.lit(1.0))).otherwise(F.lit(1.0))
    return F.when(F.coalesce(F.length(label), F.lit(0)) == 0, F.lit(0.0)).when(q == low, F.lit(99.0)).otherwise(F.least(final * cut, F.lit(99.0)))


def synonym_words(synonyms: Column) -> Column:
    names = F.filter(F.coalesce(synonyms, F.array().cast("array<string>")), lambda s: s.isNotNull())
    return F.transform(names, lambda s: content_words(s))


def relevance(query: Column, label: Column, definition: Column, synonyms: Column, preferred: Column, content: Column | None = None, penalty: float = 1.0, words: dict[str, Column] | None = None) -> Column:
    return rounded(relevance_raw(query, label, definition, synonyms, preferred, content, penalty, words))


def with_words(concepts: DataFrame) -> tuple[DataFrame, dict[str, Column]]:
    """Concepts with their content words as columns, and those columns for ``relevance``."""
    out = concepts.withColumns({"_lw": content_words(F.col("label")), "_dw": content_words(F.col("definition")), "_pw": content_words(F.col("preferred_label")), "_sw": synonym_words(F.col("alternative_labels"))})
    return out, {"label": F.col("_lw"), "definition": F.col("_dw"), "preferred": F.col("_pw"), "synonyms": F.col("_sw")}


# -- the same in the SQL of the oracle -------------------------------------------------------------------------------------


def sql_strip(text: str) -> str:
    return rf"regexp_replace({text}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"


def sql_content(text: str) -> str:
    from termloom.functions.text import STOPWORDS

    stop = ", ".join(f"'{w}'" for w in STOPWORDS)
    return f"list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(coalesce({text}, ''), '[a-zA-Z]+'), lambda w: lower(w)), lambda w: length(w) >= 2 AND NOT list_contains([{stop}], w))))"


def _sql_one_way(a: str, b: str) -> str:
    credit = (
        "CASE WHEN w = d THEN 1.0::DOUBLE WHEN length(w) >= 3 AND length(d) >= 3 AND (starts_with(w, d) OR starts_with(d, w)) THEN 0.8::DOUBLE WHEN length(w) >= 5 AND length(d) >= 5 "
        "AND left(w, greatest(4, (least(length(w), length(d)) * 7 + 9) // 10)) = left(d, greatest(4, (least(length(w), length(d)) * 7 + 9) // 10)) THEN 0.7::DOUBLE ELSE 0.0::DOUBLE END"
    )
    return f"(list_reduce(list_transform(list_sort({a}), lambda w: coalesce(list_max(list_transform({b}, lambda d: {credit})), 0.0::DOUBLE)), lambda x, y: x + y, 0.0::DOUBLE) / len({a}))"


def sql_overlap(a: str, b: str) -> str:
    return f"(CASE WHEN len({a}) > 0 AND len({b}) > 0 THEN greatest({_sql_one_way(a, b)}, CASE WHEN len({b}) >= 2 THEN {_sql_one_way(b, a)} * 0.75::DOUBLE ELSE 0.0::DOUBLE END) ELSE 0.0::DOUBLE END)"


def sql_relevance(q: str, qc: str, label: str, lc: str, definition: str, dc: str, syn: str, preferred: str, pc: str) -> str:
    """q is the trimmed lower-case query; qc, lc, dc, pc are lists of content words and syn a list of such lists."""
    inside = f"(CASE WHEN length({q}) >= 4 AND contains(lower({label}), {q}) THEN 92.0::DOUBLE WHEN length({label}) >= 4 AND contains({q}, lower({label})) AND length({label})::DOUBLE / nullif(length({q}), 0) > 0.3 THEN 88.0::DOUBLE ELSE 0.0::DOUBLE END)"
    by_label = f"greatest({inside}, {sql_overlap(qc, lc)} * 88.0::DOUBLE)"
    by_pref = f"(CASE WHEN coalesce({preferred}, '') = '' THEN 0.0::DOUBLE WHEN {q} = lower({preferred}) THEN 90.0::DOUBLE WHEN length({q}) >= 4 AND contains(lower({preferred}), {q}) THEN 84.0::DOUBLE ELSE {sql_overlap(qc, pc)} * 86.0::DOUBLE END)"
    by_syn = f"coalesce(list_max(list_transform({syn}, lambda s: {sql_overlap(qc, 's')} * 82.0::DOUBLE)), 0.0::DOUBLE)"
    by_def = f"(CASE WHEN coalesce({definition}, '') = '' THEN 0.0::DOUBLE ELSE greatest(CASE WHEN contains(lower({definition}), {q}) THEN 60.0::DOUBLE ELSE 0.0::DOUBLE END, {sql_overlap(qc, dc)} * 55.0::DOUBLE) END)"
    return f"{by_label} AS by_label, {by_pref} AS by_pref, {by_syn} AS by_syn, {by_def} AS by_def"


SQL_FINAL = """floor(CASE WHEN coalesce(label, '') = '' THEN 0.0::DOUBLE WHEN q = lower(label) THEN 99.0::DOUBLE ELSE least((CASE WHEN greatest(by_label, by_pref, by_syn) > 0 THEN greatest(by_label, by_pref, by_syn) + least(by_def * 0.12::DOUBLE, 8.0::DOUBLE) ELSE by_def END)
 * (CASE WHEN len(lc) > 0 AND len(qc) > 0 AND len(lc) > len(qc) AND len(list_filter(lc, lambda w: NOT list_contains(qc, w))) > 0 THEN 1.0::DOUBLE - len(list_filter(lc, lambda w: NOT list_contains(qc, w)))::DOUBLE / len(lc) * 0.4::DOUBLE ELSE 1.0::DOUBLE END), 99.0::DOUBLE) END * 10 + 0.5) / 10.0::DOUBLE"""
