"""From curators' sheets to gold items: forward fill, pairing of cells, the resolution ladder, merging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termloom.functions.normalize import compound, fold_spaces, is_non_referential, is_relational, label_key, normal_iri, plural_variants, suspect


def forward_fill(rows: DataFrame, sheet: str, order: str, level1: str, level2: str, leaf: str) -> DataFrame:
    """Adds head1 and head2, the headings that hold for a row: the last level-1 and level-2 cell above or on it. A level-1 cell without a level-2 cell opens
    a new part and clears level 2. role: level1, level2 (heading only), item, continuation (no heading, no leaf)."""
    full = lambda c: F.nullif(F.trim(F.coalesce(F.col(c), F.lit(""))), F.lit(""))
    l1, l2, l3 = full(level1), full(level2), full(leaf)
    opens = l1.isNotNull() & l2.isNull()
    w = Window.partitionBy(sheet).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    parted = rows.withColumn("_opens", opens).withColumn("_part", F.sum(F.when(opens, 1).otherwise(0)).over(w)).withColumn("head1", F.last(F.when(opens, l1), ignorenulls=True).over(w))
    w2 = Window.partitionBy(sheet, "_part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    role = F.when(F.col("_opens"), "level1").when(l3.isNotNull(), "item").when(l2.isNotNull(), "level2").otherwise("continuation")
    return parted.withColumn("head2", F.last(l2, ignorenulls=True).over(w2)).withColumn("role", role).drop("_opens", "_part")


def pair_blocks(inputs: Column, blocks: Column) -> Column:
    """struct(reading, ambiguous): which output blocks (arrays) belong to which input cell. One input takes all; equal numbers go by
    position; else the first block goes to the first input and the rest to the last, marked ambiguous."""
    n, m = F.size(inputs), F.size(blocks)
    none = F.array().cast("array<string>")
    flat = lambda b: F.flatten(b)
    at = lambda i: F.when(i == 0, F.coalesce(F.get(blocks, F.lit(0)), none)).when(i == n - 1, flat(F.slice(blocks, F.lit(2), F.greatest(m - 1, F.lit(0))))).otherwise(none)
    spread = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), at)
    reading = F.when(n == 1, F.array(flat(blocks))).when(n == m, blocks).otherwise(spread)
    return F.struct(reading.alias("reading"), ((n != 1) & (n != m)).alias("ambiguous"))


def pairing_violations(reading: Column) -> Column:
    """What is wrong with a reading: 'empty_input' and 'duplicate_value'."""
    return F.array_compact(F.array(F.when(F.exists(reading, lambda r: F.size(r) == 0), F.lit("empty_input")), F.when(F.exists(reading, lambda r: F.size(r) != F.size(F.array_distinct(r))), F.lit("duplicate_value"))))


def label_rungs(concepts: DataFrame) -> DataFrame:
    """rung, name, iri, hits: names of the catalog by exact and by normal form, preferred before alternative; the smallest iri of those
    that share one."""
    first = concepts.select("iri", F.explode(F.array_distinct(F.array_compact(F.array("preferred_label", "label")))).alias("name"), F.lit("preferred").alias("tier"))
    rest = concepts.select("iri", F.explode("alternative_labels").alias("name"), F.lit("alternative").alias("tier"))
    names = first.unionByName(rest).filter(F.trim("name") != "")
    exact = names.select(F.concat(F.lit("exact_"), "tier").alias("rung"), F.lower("name").alias("name"), "iri")
    normal = names.select(F.concat(F.lit("normalized_"), "tier").alias("rung"), label_key(F.col("name")).alias("name"), "iri")
    return exact.unionByName(normal).groupBy("rung", "name").agg(F.min("iri").alias("iri"), F.count_distinct("iri").alias("hits"))


RUNGS = ("exact_preferred", "exact_alternative", "normalized_preferred", "normalized_alternative")


def resolve_values(values: DataFrame, concepts: DataFrame, with_compounds: bool = False) -> DataFrame:
    """value, iri, rung, ambiguous, parse: the first rung of the ladder that names a concept: exact preferred, exact alternative, their normal forms, then
    singular and plural variants of the last word. With compounds the part after the last colon is tried first, that after the first, the whole, the
    bucket. iri is null and rung 'unresolved' where none does."""
    v = values.select("value").filter("value is not null").distinct()
    if with_compounds:
        c = compound(F.col("value"))
        tries = F.when(F.size(c["right"]) > 0, F.array_compact(F.array(F.struct(F.lit(0).alias("p"), F.lit("rhs_last").alias("parse"), F.get(c["right"], F.lit(0)).alias("t")), F.when(F.size(c["right"]) > 1, F.struct(F.lit(1).alias("p"), F.lit("rhs_first").alias("parse"), F.get(c["right"], F.lit(1)).alias("t"))), F.struct(F.lit(2).alias("p"), F.lit("whole").alias("parse"), F.col("value").alias("t")), F.struct(F.lit(3).alias("p"), F.lit("bucket").alias("parse"), c["bucket"].alias("t")))))
        tries = F.coalesce(tries, F.array(F.struct(F.lit(0).alias("p"), F.lit("plain").alias("parse"), F.col("value").alias("t"))))
        t = v.select("value", F.explode(tries).alias("x")).select("value", "x.p", "x.parse", F.col("x.t").alias("text")).filter("text is not null")
    else:
        t = v.select("value", F.lit(0).alias("p"), F.lit("plain").alias("parse"), F.col("value").alias("text"))
    t = t.withColumn("_k", label_key(F.col("text"))).withColumn("_v", plural_variants(F.col("text")))
    asks = F.concat(
        F.array(*[F.struct(F.lit(i).alias("o"), F.lit(r).alias("rung"), (F.lower("text") if r.startswith("exact") else F.col("_k")).alias("name")) for i, r in enumerate(RUNGS)]),
        F.flatten(F.transform("_v", lambda x, i: F.array(F.struct((i * 2 + 4).alias("o"), F.lit("normalized_preferred").alias("rung"), F.lower(x).alias("name")), F.struct((i * 2 + 5).alias("o"), F.lit("normalized_alternative").alias("rung"), F.lower(x).alias("name"))))),
    )
    asked = t.select("value", "p", "parse", F.explode(asks).alias("a")).select("value", "p", "parse", "a.o", "a.rung", "a.name")
    hits = asked.join(label_rungs(concepts), ["rung", "name"])
    best = hits.groupBy("value").agg(F.min_by(F.struct("iri", F.when(F.col("o") >= 4, "lemma_variant").otherwise(F.col("rung")).alias("rung"), (F.col("hits") > 1).alias("ambiguous"), "parse"), F.struct("p", "o")).alias("r"))
    j = v.join(best, "value", "left")
    return j.select("value", "r.iri", F.coalesce("r.rung", F.lit("unresolved")).alias("rung"), F.coalesce("r.ambiguous", F.lit(False)).alias("ambiguous"), F.coalesce("r.parse", F.lit("unresolved")).alias("parse"))


def resolve_cells(values: DataFrame, concepts: DataFrame, base: str, legacy: list[str], prefixes: list[str], with_compounds: bool = True) -> DataFrame:
    """value, iri, rung, parse, ambiguous, suspect of every distinct cell value: relations and placeholders are left out (the rung says so), a trailing question mark is taken off
    and noted, an IRI is brought into the base namespace and looked up ('iri_exact' or 'legacy_iri', 'unresolved' where the catalog doesn't have it), and anything else goes down the
    ladder of resolve_values."""
    v = values.select("value").filter("value is not null").distinct()
    x = F.col("value")
    out = F.when(is_relational(x, base, legacy, prefixes), "excluded_relational").when(is_non_referential(x), "excluded_non_referential_value")
    s = v.select("value", out.alias("out"), suspect(x).alias("s")).select("value", "out", "s.text", "s.marked")
    s = s.withColumn("full", F.when(F.col("out").isNull(), normal_iri(F.col("text"), base, legacy, prefixes))).withColumn("own", F.startswith(fold_spaces(F.col("text")), F.lit(base)))
    known = concepts.select(F.col("iri").alias("full"), F.lit(True).alias("known")).distinct()
    ladder = resolve_values(s.filter("out is null and full is null").select(F.col("text").alias("value")), concepts, with_compounds).withColumnsRenamed({"value": "text", "rung": "_rung", "parse": "_parse", "ambiguous": "_amb", "iri": "_iri"})
    j = s.join(known, "full", "left").join(ladder, "text", "left")
    is_iri = F.col("full").isNotNull()
    rung = F.when(F.col("out").isNotNull(), F.col("out")).when(is_iri & F.col("known").isNull(), "unresolved").when(is_iri & F.col("own"), "iri_exact").when(is_iri, "legacy_iri").otherwise(F.col("_rung"))
    open_ = F.col("out").isNull()
    return j.select(
        "value", F.when(open_ & is_iri & F.col("known").isNotNull(), F.col("full")).when(open_ & ~is_iri, F.col("_iri")).alias("iri"), rung.alias("rung"), F.when(open_, F.when(is_iri, "iri").otherwise(F.col("_parse"))).alias("parse"),
        (open_ & ~is_iri & F.coalesce("_amb", F.lit(False))).alias("ambiguous"), (open_ & F.col("marked")).alias("suspect"),
    )


def resolve_items(values: DataFrame, cells: DataFrame) -> DataFrame:
    """item_id, iris, rules, blank: the concepts of all cells of an item (values: item_id, value; cells as resolve_cells gives them), and what was noted on the way: cells left
    out, unresolved, ambiguous or suspect. An item without concepts is blank."""
    x = values.join(cells, "value", "left")
    rules = F.array_compact(F.array(F.when(F.col("rung").startswith("excluded") | (F.col("rung") == "unresolved"), F.col("rung")), F.when(F.col("ambiguous"), F.lit("ambiguous_label")), F.when(F.col("suspect"), F.lit("suspect_question_mark"))))
    none = F.array().cast("array<string>")
    g = x.groupBy("item_id").agg(F.array_sort(F.collect_set("iri")).alias("iris"), F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.coalesce(rules, none))))).alias("rules"))
    return g.withColumn("blank", F.size("iris") == 0)


def split_summary(items: DataFrame, splits: DataFrame) -> DataFrame:
    """stratum_id, items, tune, frozen, excluded, signal, frozen_share: counts of a split by stratum, safe to publish."""
    j = splits.join(items.select("item_id", "stratum_id"), "item_id")
    n = {s: F.count_if(F.col("slice") == s) for s in ("tune", "frozen", "excluded", "signal")}
    share = F.round(F.coalesce(F.try_divide(F.col("frozen").cast("double"), F.col("items") - F.col("signal")), F.lit(0.0)), 4)
    return j.groupBy("stratum_id").agg(F.count(F.lit(1)).alias("items"), *[c.alias(s) for s, c in n.items()]).withColumn("frozen_share", share)


def merge_cells(cells: DataFrame) -> DataFrame:
    """firm, key, text, answers, flags, cells, inconsistent: cells (firm, text, answers, flags, ord) with the same normal text become one item: all answers
    and flags, the first text; inconsistent where two cells give different non-empty answers. Cells that name nothing are left out."""
    c = cells.filter(F.col("text").isNotNull() & ~is_non_referential(F.col("text"))).withColumn("key", label_key(F.col("text")))
    sets = F.array_sort(F.array_distinct(F.coalesce("answers", F.array().cast("array<string>"))))
    given = F.collect_set(F.when(F.size(sets) > 0, F.array_join(sets, "|")))
    g = c.groupBy("firm", "key").agg(F.min_by("text", "ord").alias("text"), F.array_sort(F.array_distinct(F.flatten(F.collect_set(sets)))).alias("answers"), F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.coalesce("flags", F.array().cast("array<string>")))))).alias("flags"), F.count(F.lit(1)).alias("cells"), given.alias("_given"))
    return g.withColumn("inconsistent", F.size("_given") > 1).drop("_given")


#: Flags that keep an item out of the frozen slice.
FROZEN_EXCLUDED = ("notes_flagged", "suspect_question_mark", "ambiguous_label", "term_deprecated", "pairing_ambiguous", "gold_inconsistent")


def evaluation_splits(items: DataFrame, seed: str = "1", fraction: float = 0.2, least: int = 15, firm: str = "firm1", signal: str = "firm2") -> DataFrame:
    """item_id, slice: whole groups of each stratum go to 'frozen' in a hashed order while they fit its share; flagged groups, small strata and frozen items whose surface
    also stands in 'tune' stay out ('excluded'); the signal firm is a slice of its own. Columns: item_id, firm, stratum_id, group_id, surface, flags."""
    own = items.filter(F.col("firm") == firm)
    ok = ~F.arrays_overlap(F.coalesce("flags", F.array().cast("array<string>")), F.array(*[F.lit(f) for f in FROZEN_EXCLUDED]))
    groups = own.groupBy("stratum_id", "group_id").agg(F.count(F.lit(1)).alias("size"), F.bool_and(ok).alias("eligible"))
    strata = groups.groupBy("stratum_id").agg(F.sum("size").alias("total")).withColumn("target", F.when(F.col("total") >= least, F.floor(F.col("total") * fraction + 0.5)).otherwise(0))
    w = Window.partitionBy("stratum_id").orderBy(F.md5(F.concat_ws("|", F.lit(seed), "stratum_id", "group_id")), "group_id").rowsBetween(Window.unboundedPreceding, 0)
    drawn = groups.filter("eligible").withColumn("run", F.sum("size").over(w)).join(strata, "stratum_id").filter("run <= target").select("stratum_id", "group_id", F.lit(True).alias("frozen"))
    marked = own.join(drawn, ["stratum_id", "group_id"], "left").withColumn("frozen", F.coalesce("frozen", F.lit(False)))
    tune_surfaces = marked.filter("not frozen").select("surface").distinct().withColumn("in_tune", F.lit(True))
    out = marked.join(tune_surfaces, "surface", "left").select("item_id", F.when(~F.col("frozen"), "tune").when(F.coalesce("in_tune", F.lit(False)), "excluded").otherwise("frozen").alias("slice"))
    return out.unionByName(items.filter(F.col("firm") == signal).select("item_id", F.lit("signal").alias("slice")))


def split_violations(items: DataFrame, splits: DataFrame) -> DataFrame:
    """rule, n: items in two slices, surfaces in both tune and frozen, groups that straddle them. All zero for a sound split."""
    j = splits.join(items, "item_id")
    two = splits.groupBy("item_id").agg(F.count_distinct("slice").alias("k")).filter("k > 1").agg(F.count(F.lit(1)).alias("n"))
    both = lambda c: j.filter(F.col("slice").isin("tune", "frozen")).groupBy(*c).agg(F.count_distinct("slice").alias("k")).filter("k > 1").agg(F.count(F.lit(1)).alias("n"))
    out = two.select(F.lit("two_slices").alias("rule"), "n")
    return out.unionByName(both(["surface"]).select(F.lit("shared_surface").alias("rule"), "n")).unionByName(both(["stratum_id", "group_id"]).select(F.lit("straddling_group").alias("rule"), "n"))
