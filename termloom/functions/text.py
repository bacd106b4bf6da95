"""Tokens, phrases and decomposition of headings as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words too common to search or score by.
STOPWORDS = (
    "a an the of and or in for to with by on at is are was were be been being not no has have had do does did this that it its their other such than "
    "your yours own my mine our ours her hers him his whom whose self law legal type types general"
).split()

# What a content word is also searched with.
EXPANSIONS = {
    "litigation": "practice service", "transactional": "practice service", "transaction": "practice service", "transactions": "practice service",
    "regulatory": "practice compliance", "compliance": "practice service", "advisory": "practice service", "dispute": "service resolution",
    "disputes": "service resolution", "mediation": "service", "arbitration": "service", "negotiation": "service", "settlement": "service practice",
    "appellate": "practice service", "trial": "practice service", "appeals": "practice service", "prosecution": "service", "enforcement": "service action",
    "investigation": "service", "error": "malpractice negligence", "fault": "negligence liability", "harm": "liability injury", "injury": "liability claim",
    "negligence": "claim liability", "malpractice": "claim liability", "contract": "law claim claims", "breach": "claim claims",
    "corporate": "practice service law", "employment": "practice service law", "intellectual": "property practice", "bankruptcy": "practice service law",
    "family": "practice law", "immigration": "practice service law", "environmental": "practice law compliance", "antitrust": "practice law compliance",
    "tax": "practice service law", "real": "estate property", "estate": "planning practice law", "counsel": "service practice",
    "counseling": "service practice", "consulting": "service practice", "collection": "service practice", "recovery": "service practice",
    "foreclosure": "service practice", "discovery": "service practice", "diligence": "service practice", "audit": "service practice",
    "drafting": "service practice", "documentation": "service practice", "filing": "service practice", "strategy": "service practice",
    "planning": "service practice", "risk": "service management", "structuring": "service practice",
}

# What joins the parts of a heading, longest first; words shared by all parts at the front and at the end.
CONJUNCTIONS = (" and/or ", ", and ", " and ", ", or ", " or ", "; ")
SHARED_HEADS = "proposed draft amended supplemental joint stipulated preliminary final".split()
SHARED_TAILS = "agreement law claims claim act clause clauses provisions rights".split()


def strip(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def words_lit(words) -> Column:
    return F.array(*[F.lit(w) for w in words])


def tokenize(text: Column) -> Column:
    """Runs of Latin letters in lower case, two letters or more; [] for null."""
    runs = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("[a-zA-Z]+"), F.lit(0))
    return F.filter(F.transform(runs, F.lower), lambda w: F.length(w) >= 2)


def content_words(text: Column) -> Column:
    """Distinct tokens that aren't stopwords, sorted."""
    return F.array_sort(F.array_except(tokenize(text), words_lit(STOPWORDS)))


def _first_of_each(items: Column) -> Column:
    """Without later items that equal an earlier one but for letter case."""
    return F.aggregate(items, F.array().cast("array<string>"), lambda kept, t: F.when(F.exists(kept, lambda k: F.lower(k) == F.lower(t)), kept).otherwise(F.array_append(kept, t)))


def search_terms(term: Column) -> Column:
    """The term, its shorter phrases with content, its content words from the longest, and each with its expansions."""
    words, content = tokenize(term), content_words(term)
    n = F.size(words)
    sizes = F.when(n >= 3, F.sequence(n - 1, F.lit(2), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    phrases = F.flatten(F.transform(sizes, lambda k: F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.array_join(F.slice(words, i, k), " "))))
    phrases = F.filter(phrases, lambda p: F.size(content_words(p)) > 0)
    longest = F.array_sort(F.filter(content, lambda w: F.length(w) >= 3), lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0))
    table = F.create_map(*[x for k, v in EXPANSIONS.items() for x in (F.lit(k), words_lit(v.split()))])
    more = F.flatten(F.transform(content, lambda w: F.transform(F.coalesce(F.try_element_at(table, w), F.array().cast("array<string>")), lambda s: F.concat(w, F.lit(" "), s))))
    return _first_of_each(F.concat(F.array(term), phrases, longest, more))


def conjuncts(text: Column) -> Column:
    """The parts between conjunctions, trimmed, without empty ones. Letter case of the conjunctions counts."""
    pattern = "|".join(CONJUNCTIONS)
    return F.filter(F.transform(F.split(text, pattern), lambda p: strip(p)), lambda p: F.length(p) > 0)


def decompose(text: Column) -> Column:
    """A heading and the parts it joins, each with the head ('Proposed X and Y') or tail ('X and Y Agreement') that all share.
    The heading itself comes first; one without conjunctions stands alone. Null gives null."""
    whole = strip(text)
    parts = conjuncts(whole)
    first, last = F.element_at(F.split(F.element_at(parts, 1), r"\s+"), 1), F.element_at(F.split(F.element_at(parts, -1), r"\s+"), -1)
    head = F.when(F.lower(first).isin(SHARED_HEADS), first)
    tail = F.when(head.isNull() & F.lower(last).isin(SHARED_TAILS), last)
    n = F.size(parts)

    def restore(part: Column, i: Column) -> Column:
        headed = F.when(head.isNotNull() & (i > 0) & ~F.startswith(F.lower(part), F.lower(head)), F.concat(head, F.lit(" "), part)).otherwise(part)
        return F.when(tail.isNotNull() & (i < n - 1) & ~F.endswith(F.lower(headed), F.lower(tail)), F.concat(headed, F.lit(" "), tail)).otherwise(headed)

    return F.when(n < 2, F.array(whole)).otherwise(F.array_distinct(F.concat(F.array(whole), F.transform(parts, restore))))


def phrase_windows(text: Column, longest: int = 5) -> Column:
    """Distinct windows of one to ``longest`` words that hold a content word, sorted; words are runs of letters, digits, ' and -."""
    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("[A-Za-z0-9][A-Za-z0-9'-]*"), F.lit(0))
    n = F.size(words)
    sizes = F.sequence(F.lit(1), F.greatest(F.least(n, F.lit(longest)), F.lit(1)))
    windows = F.flatten(F.transform(sizes, lambda k: F.transform(F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1))), lambda i: F.array_join(F.slice(words, i, k), " "))))
    return F.when(n > 0, F.array_sort(F.array_distinct(F.filter(windows, lambda p: F.size(content_words(p)) > 0)))).otherwise(F.array().cast("array<string>"))


def snippet(text: Column, words: int = 25) -> Column:
    """The first words of a text, with an ellipsis where more follow; empty for null."""
    w = F.filter(F.split(strip(F.coalesce(text, F.lit(""))), r"[\s\p{Z}]+"), lambda x: x != "")
    return F.concat(F.array_join(F.slice(w, 1, words), " "), F.when(F.size(w) > words, F.lit("…")).otherwise(F.lit("")))


def strip_fences(text: Column) -> Column:
    """Text without a leading fence of three or more backticks (with 'json' or no word behind it) and a trailing one."""
    return strip(F.regexp_replace(F.regexp_replace(strip(text), r"^`{3,}\s*(?:json)?\s*", ""), r"\s*`{3,}\s*$", ""))


# Words that tell miss analysis nothing.
ANALYSIS_STOPWORDS = "a an and for in of on or the to with by at".split()


def key_tokens(key: Column) -> Column:
    """Distinct runs of digits and Latin letters of a normalised label, without the commonest words, sorted."""
    runs = F.filter(F.split(F.lower(key), "[^0-9a-z]+"), lambda w: F.length(w) > 0)
    return F.array_sort(F.array_except(F.array_distinct(runs), words_lit(ANALYSIS_STOPWORDS)))


def jaccard(a: Column, b: Column) -> Column:
    """Shared part of two sets; 0 where either is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)).cast("double") / F.size(F.array_union(a, b))).otherwise(F.lit(0.0))
