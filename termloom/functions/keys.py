"""Identifier and heading normalisation as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What may stand around or inside an IRI without being part of it.
_AROUND = r"""[\s\p{Z}\p{Cf}\p{Cc}<>\[\](){}"']"""
_DASHES = r"[\p{Pd}\u2212\u00ad]"
_SPACES = r"[\s\p{Z}\p{Cc}\u200b\u200c\u200d\u2060\ufeff]+"


def iri_key(iri: Column) -> Column:
    """The part after the last slash or colon, without brackets, blanks and closing slashes; null for null and blank."""
    bare = F.regexp_replace(F.regexp_replace(iri, _AROUND, ""), "[/:]+$", "")
    return F.nullif(F.regexp_extract(bare, "([^/:]*)$", 1), F.lit(""))


def loose_heading(text: Column) -> Column:
    """A heading without letter case, dashes and white space; null for null and for what is empty then."""
    return F.nullif(F.lower(F.regexp_replace(text, r"[\p{Pd}\u2212\p{Z}\p{Cf}\p{Cc}\s]", "")), F.lit(""))


def simple_heading(text: Column) -> Column:
    """A heading in lower case with one kind of dash and single blanks; null becomes ''. Compatibility forms stay."""
    dashed = F.regexp_replace(F.coalesce(text, F.lit("")), _DASHES, "-")
    return F.trim(F.lower(F.regexp_replace(dashed, _SPACES, " ")))
