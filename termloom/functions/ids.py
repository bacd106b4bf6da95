"""Stable identifiers of items, cells, strata and families: hashes of canonical JSON, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from termloom.functions.normalize import label_key

#: Name of the derivation in the key of cells.
CELL_DERIVATION = "v2-cell"


def json_text(text: Column) -> Column:
    """A text as a JSON string; null is the empty text."""
    one = F.to_json(F.array(F.coalesce(text, F.lit(""))))
    return F.substring(one, F.lit(2), F.length(one) - 2)


def json_list(texts: Column) -> Column:
    """A list of texts as JSON with a blank after each comma; null is the empty list."""
    return F.concat(F.lit("["), F.array_join(F.transform(F.coalesce(texts, F.array().cast("array<string>")), json_text), ", "), F.lit("]"))


def _hash(parts: list[Column], digits: int) -> Column:
    return F.left(F.sha2(F.concat(F.lit("["), F.concat_ws(", ", *parts), F.lit("]")), 256), F.lit(digits))


def item_id(firm: Column, stratum: Column, path: Column, leaf: Column) -> Column:
    return _hash([json_text(firm), json_text(stratum), json_list(path), json_text(leaf)], 16)


def cell_id(firm: Column, text: Column) -> Column:
    """The key of a cell: the firm and the normal text, whatever the level."""
    return _hash([json_text(firm), json_text(F.lit(CELL_DERIVATION)), json_text(label_key(text))], 16)


def family_id(firm: Column, path: Column) -> Column:
    return _hash([json_text(firm), json_list(path)], 12)


def stratum_id(firm: Column, stratum: Column) -> Column:
    return F.left(F.sha2(F.concat(F.coalesce(firm, F.lit("")), F.lit("|"), F.coalesce(stratum, F.lit(""))), 256), F.lit(12))


def group_id(family: Column, firm: Column, stratum: Column, path: Column) -> Column:
    """The unit that a split assigns: the family where one is given, else a hash of where the item hangs."""
    return F.coalesce(F.nullif(family, F.lit("")), _hash([json_text(firm), json_text(stratum), json_list(path)], 12))


def input_text(path: Column, leaf: Column) -> Column:
    return F.array_join(F.concat(F.coalesce(path, F.array().cast("array<string>")), F.array(F.coalesce(leaf, F.lit("")))), " > ")


def rejection_key(item: Column, iris: Column) -> Column:
    """Under which a rejected proposal is remembered: the item and the exact set proposed."""
    return F.concat(item, F.lit("|"), F.array_join(F.array_sort(iris), "|"))


def digest(*parts: Column) -> Column:
    """Eight digits that stand for a few parts in a report."""
    return F.left(F.sha2(F.concat_ws("␟", *parts), 256), F.lit(8))
