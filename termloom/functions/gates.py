"""Gates that veto or demote candidates, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from termloom.functions.text import content_words

# What marks a branch or a label as a place.
PLACE_BRANCHES = "location geograph country jurisdiction place governmental agency".split()
PLACE_NAMES = "slovenia portugal spain reunion puerto rico mariana islands guam samoa chad mali togo fiji oman qatar peru cuba chile kenya ghana nepal".split()
# Section labels that are no body text, in the order in which they are tried.
METADATA = ("metadata", "document properties", "publisher", "cataloging")
FRONT = (
    "title page", "copyright", "colophon", "isbn", "table of contents", "toc", "dedication", "acknowledgments", "acknowledgements", "preface", "foreword",
    "about the author", "frontispiece", "half title",
)
BACK = ("index", "bibliography", "appendix", "glossary", "colophon", "errata")
ISBN = r"\b(?:97[89][- ]?)?(?:\d[- ]?){9}[\dxX]\b"
#: Score to which gated candidates fall.
DEMOTED = 40.0


def _holds(text: Column, parts) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | F.contains(text, F.lit(p.lower()))
    return out


def is_place(label: Column, branch: Column, names=(), phrases=(), branches=()) -> Column:
    low, b = F.lower(F.coalesce(label, F.lit(""))), F.lower(F.coalesce(branch, F.lit("")))
    extra = [n.strip().lower() for n in names if n and n.strip()]
    words = F.split(F.trim(low), r"(?U)\s+")
    return _holds(b, [*PLACE_BRANCHES, *branches]) | F.arrays_overlap(words, F.array(*[F.lit(w) for w in [*PLACE_NAMES, *extra]])) | (F.trim(low).isin(extra) if extra else F.lit(False)) | _holds(F.trim(low), phrases)


def _same(a: Column, b: Column) -> Column:
    return F.lower(F.trim(a)) == F.lower(F.trim(b))


def place_gate(query: Column, label: Column, branch: Column, score: Column, in_heading: Column | None = None, signals: int = 1, least: int = 2, demoted: float = DEMOTED, **extra) -> Column:
    """struct(score, demoted, reason): a place is kept where it is named exactly or enough signals speak for it."""
    count = F.lit(signals) + (F.when(F.coalesce(in_heading, F.lit(False)), 1).otherwise(0) if in_heading is not None else F.lit(0))
    keep = lambda why: F.struct(score.cast("double").alias("score"), F.lit(False).alias("demoted"), F.lit(why).alias("reason"))
    down = F.struct(F.least(score.cast("double"), F.lit(demoted)).alias("score"), F.lit(True).alias("demoted"), F.concat(F.lit("place-name demoted (signals="), count.cast("string"), F.lit(f" < {least})")).alias("reason"))
    return F.when(~is_place(label, branch, **extra), keep("not-a-place")).when(_same(query, label), keep("exact-place-name")).when(count >= least, keep("corroborated-place")).otherwise(down)


def short_gate(query: Column, label: Column, score: Column, least: int = 4, near: float = 95.0, demoted: float = DEMOTED) -> Column:
    """struct(score, demoted, reason): labels that are very short or have one content word need a near-exact hit."""
    short = (F.length(F.trim(label)) < least) | (F.size(content_words(label)) <= 1)
    keep = lambda why: F.struct(score.cast("double").alias("score"), F.lit(False).alias("demoted"), F.lit(why).alias("reason"))
    down = F.struct(F.least(score.cast("double"), F.lit(demoted)).alias("score"), F.lit(True).alias("demoted"), F.lit("short-label demoted (fuzzy match below near-exact)").alias("reason"))
    return F.when(~short, keep("not-short")).when((score >= near) | _same(query, label), keep("near-exact-short-label")).otherwise(down)


def source_kind(section: Column, text: Column | None = None) -> Column:
    """metadata, front_matter, back_matter or body, from a section label and an ISBN in a short text."""
    s = F.lower(F.trim(F.coalesce(section, F.lit(""))))
    out = F.when(_holds(s, METADATA), "metadata").when(_holds(s, FRONT), "front_matter").when(_holds(s, BACK), "back_matter")
    if text is not None:
        out = out.when((F.length(text) > 0) & (F.length(text) < 200) & F.rlike(text, F.lit(ISBN)), "metadata")
    return out.otherwise("body")


def is_taggable(section: Column, text: Column | None = None, kinds=("body", "heading")) -> Column:
    return source_kind(section, text).isin(*kinds)


def excludes_label(label: Column, prefixes=(), substrings=()) -> Column:
    """Whether a catalog's rules leave a label out, whatever its letter case."""
    up = F.upper(label)
    out = F.lit(False)
    for p in prefixes:
        out = out | F.startswith(up, F.lit(p.upper()))
    for p in substrings:
        out = out | F.contains(up, F.lit(p.upper()))
    return out


def enforce_verdict(original: Column, adjusted: Column, verdict: Column) -> Column:
    """rejected gives 0, confirmed stays within 5 of the original, boosted gains 25 at most, penalized is taken as it is."""
    return F.when(verdict == "rejected", F.lit(0.0)).when(verdict == "confirmed", F.greatest(original - 5, F.least(original + 5, adjusted))).when(verdict == "boosted", F.least(adjusted, original + 25)).otherwise(adjusted)


def band(probability: Column, weak: float = 0.5, strong: float = 0.8) -> Column:
    return F.when(probability < weak, "wrong").when(probability < strong, "weak").otherwise("strong")


def miss_cluster(in_ranked: Column, reachable: Column, exact: Column, homonym: Column, neighbor: Column, jaccard: Column) -> Column:
    """One of seven reasons why a concept was missed; reachability comes first."""
    return (
        F.when(in_ranked, "ranked_below_cutoff").when(reachable, "candidate_gap_truncated").when(exact, "normalization").when(homonym, "homonym_or_wrong_sense")
        .when(neighbor, "hierarchy_near_miss").when(jaccard <= 0, "synonymy").otherwise("candidate_gap_unreachable")
    )


def reachability(cluster: Column) -> Column:
    return F.when(cluster.isin("ranked_below_cutoff", "candidate_gap_truncated"), cluster).otherwise("candidate_gap_unreachable")


def false_positive_cluster(bucket: Column) -> Column:
    return F.when(bucket.isin("parent_1hop", "child_1hop"), "fp_near_miss").otherwise("fp_unrelated")
