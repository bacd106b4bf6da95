"""Normal forms of labels, cells and IRIs as Column expressions; Python only where a text isn't ASCII."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from termloom.functions.text import strip

# Dash and space characters that are folded; cells that name no concept.
DASHES = "‐‑‒–—―−﹘﹣－"
SPACES = "           \t\r\n"
NON_REFERENTIAL = "other|others|miscellaneous|misc|misc.|n/a|na|none|various|varies|tbd|unknown".split("|")


def fold_dashes(text: Column) -> Column:
    return F.translate(text, DASHES, "-" * len(DASHES))


def fold_spaces(text: Column) -> Column:
    """Folds exotic blanks, collapses runs, trims."""
    return F.trim(F.regexp_replace(F.translate(text, SPACES, " " * len(SPACES)), r"(?U)\s+", " "))


def _normal(text: str) -> str:
    s = unicodedata.normalize("NFKC", text).translate({ord(c): "-" for c in DASHES}).translate({ord(c): " " for c in SPACES})
    return re.sub(r"\s+", " ", s).strip()


@F.pandas_udf(T.StringType())
def _normal_udf(text: pd.Series) -> pd.Series:
    return text.map(lambda s: None if s is None else _normal(s))


@F.pandas_udf(T.StringType())
def _key_udf(text: pd.Series) -> pd.Series:
    return text.map(lambda s: None if s is None else _normal(s).casefold())


def _ascii(text: Column) -> Column:
    return ~F.rlike(text, F.lit(r"[^\x00-\x7F]"))


def normal_label(text: Column) -> Column:
    """NFKC, dashes and blanks folded, trimmed; letter case stays. Null stays null."""
    return F.when(_ascii(text), F.trim(F.regexp_replace(text, r"[\s\x0B\x1C-\x1F]+", " "))).otherwise(_normal_udf(F.when(~_ascii(text), text)))


def label_key(text: Column) -> Column:
    """The case-insensitive key of a normal label: with casefold, so that sharp s and final sigma agree."""
    return F.when(_ascii(text), F.lower(F.trim(F.regexp_replace(text, r"[\s\x0B\x1C-\x1F]+", " ")))).otherwise(_key_udf(F.when(~_ascii(text), text)))


def is_non_referential(text: Column) -> Column:
    return label_key(text).isin(NON_REFERENTIAL)


_CAMEL = r"^[\p{Ll}]\p{L}*$"


def _predicate(text: Column, prefixes: list[str]) -> Column:
    return F.rlike(text, F.lit(f"^(?:{'|'.join(prefixes)}):[A-Za-z_][A-Za-z0-9_]*$")) & F.rlike(F.substring_index(text, ":", -1), F.lit(_CAMEL))


def is_iri_like(text: Column, base: str, legacy: list[str], prefixes: list[str]) -> Column:
    """Whether a cell holds an IRI: the base namespace, or a legacy prefix with an opaque key behind it that isn't a relation."""
    s = fold_spaces(text)
    old = F.lit(False)
    for p in legacy:
        old = old | (F.startswith(s, F.lit(p)) & F.rlike(F.substring(s, F.lit(len(p) + 1), F.length(s)), F.lit(r"^[A-Za-z0-9_.\-]+$")) & ~_predicate(s, prefixes))
    return F.startswith(s, F.lit(base)) | old


def normal_iri(text: Column, base: str, legacy: list[str], prefixes: list[str]) -> Column:
    """The IRI in the base namespace; null where the cell holds none."""
    s = fold_spaces(text)
    out = F.when(F.startswith(s, F.lit(base)), s)
    for p in legacy:
        out = out.when(F.startswith(s, F.lit(p)), F.concat(F.lit(base), F.substring(s, F.lit(len(p) + 1), F.length(s))))
    return F.when(is_iri_like(text, base, legacy, prefixes), out)


def is_relational(text: Column, base: str, legacy: list[str], prefixes: list[str]) -> Column:
    """Whether a cell states a relation: an arrow, or prefix:camelPredicate."""
    s = fold_spaces(text)
    return ~is_iri_like(text, base, legacy, prefixes) & (F.rlike(s, F.lit("->|-->|=>|→|⟶")) | _predicate(s, prefixes))


def suspect(text: Column) -> Column:
    """struct(text, marked): without a trailing question mark, where there is one; unmarked text stays as typed."""
    marked = F.rlike(text, F.lit(r"(?U)\?\s*$"))
    return F.struct(F.when(marked, F.regexp_replace(text, r"(?U)\s*\?\s*$", "")).otherwise(text).alias("text"), marked.alias("marked"))


def pipe_values(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"\|"), lambda p: strip(p)), lambda p: F.length(p) > 0)


def compound(text: Column) -> Column:
    """struct(bucket, right) of 'Bucket: Concept': what follows the last and the first colon; null and [] without a colon."""
    s = fold_spaces(text)
    bucket = F.nullif(F.trim(F.substring_index(s, ":", 1)), F.lit(""))
    last, first = F.trim(F.substring_index(s, ":", -1)), F.trim(F.regexp_replace(s, "^[^:]*:", ""))
    right = F.filter(F.array_distinct(F.array(last, first)), lambda p: F.length(p) > 0)
    has = F.contains(s, F.lit(":"))
    return F.struct(F.when(has, bucket).alias("bucket"), F.when(has, right).otherwise(F.array().cast("array<string>")).alias("right"))


def plural_variants(text: Column) -> Column:
    """Singular and plural forms of a label's last word, in a fixed order, without the label itself."""
    s = normal_label(text)
    last = F.regexp_extract(s, r"([^ ]*)$", 1)
    head = F.regexp_extract(s, r"^(.*?)[^ ]*$", 1)
    low, n = F.lower(last), F.length(last)
    drop = lambda k, add="": F.concat(head, F.substring(last, F.lit(1), F.greatest(n - k, F.lit(0))), F.lit(add))
    forms = [
        F.when(F.endswith(low, F.lit("ies")) & (n > 3), drop(3, "y")),
        F.when(F.endswith(low, F.lit("es")) & (n > 2), drop(2)),
        F.when(F.endswith(low, F.lit("s")) & ~F.endswith(low, F.lit("ss")) & (n > 1), drop(1)),
        F.when(F.endswith(low, F.lit("y")) & (n > 1) & ~F.substring(low, -2, 1).isin(*"aeiou"), drop(1, "ies")),
        F.when(F.rlike(low, F.lit("(?:s|x|z|ch|sh)$")), F.concat(head, last, F.lit("es"))),
        F.concat(head, last, F.lit("s")),
    ]
    return F.when(F.length(s) > 0, F.array_except(F.array_compact(F.array(*forms)), F.array(s))).otherwise(F.array().cast("array<string>"))
