"""Audit folds: gold variants, votes, claims, decisions, quotas, run logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termloom.functions.ids import rejection_key

NONE = "array<string>"


def variant_sets(values: DataFrame) -> DataFrame:
    """item_id, variant, iris: the gold set as it is, from own cells only, and without what a shared row hands down (origin 'inherited_level2').
    values: item_id, iri, origin."""
    v = values.filter("item_id is not null and iri is not null")
    keep = F.array(F.struct(F.lit("as_is").alias("variant"), F.lit(True).alias("k")), F.struct(F.lit("own_only").alias("variant"), (F.col("origin") == "own").alias("k")), F.struct(F.lit("no_level2").alias("variant"), (F.col("origin") != "inherited_level2").alias("k")))
    rows = v.select("item_id", "iri", F.explode(keep).alias("x"))
    return rows.groupBy("item_id", "x.variant").agg(F.array_sort(F.collect_set(F.when(F.coalesce(F.col("x.k"), F.lit(False)), F.col("iri")))).alias("iris"))


def variant_stats(sets: DataFrame) -> DataFrame:
    """variant, items, scored, blank, iris, distinct_iris, mean_size, dropped (against as_is)."""
    base = sets.groupBy("variant").agg(F.count(F.lit(1)).alias("items"), F.count_if(F.size("iris") > 0).alias("scored"), F.sum(F.size("iris")).alias("iris"))
    distinct = sets.select("variant", F.explode("iris").alias("iri")).groupBy("variant").agg(F.count_distinct("iri").alias("distinct_iris"))
    whole = base.filter("variant = 'as_is'").select(F.col("iris").alias("_all"))
    j = base.join(distinct, "variant", "left").join(whole, how="cross")
    return j.select("variant", "items", "scored", (F.col("items") - F.col("scored")).alias("blank"), "iris", F.coalesce("distinct_iris", F.lit(0)).alias("distinct_iris"), F.coalesce(F.try_divide(F.col("iris").cast("double"), F.col("scored").cast("double")), F.lit(0.0)).alias("mean_size"), (F.col("_all") - F.col("iris")).alias("dropped"))


def fold_votes(votes: DataFrame, floor: float) -> DataFrame:
    """item_id, agreed, singletons, status: concepts that at least two of exactly three graders of two model families give with the floor's
    confidence or more; others queue. votes: item_id, grader_id, family, iri (null: no concept), confidence."""
    g = votes.groupBy("item_id").agg(F.count_distinct("grader_id").alias("graders"), F.count_distinct("family").alias("families"))
    per = votes.filter(F.col("iri").isNotNull() & (F.col("confidence") >= floor)).groupBy("item_id", "iri").agg(F.count_distinct("grader_id").alias("n"))
    lists = per.groupBy("item_id").agg(F.array_sort(F.collect_list(F.when(F.col("n") >= 2, F.col("iri")))).alias("agreed"), F.array_sort(F.collect_list(F.when(F.col("n") == 1, F.col("iri")))).alias("singletons"))
    j = g.join(lists, "item_id", "left").withColumns({"agreed": F.coalesce("agreed", F.array().cast(NONE)), "singletons": F.coalesce("singletons", F.array().cast(NONE))})
    whole = (F.col("graders") == 3) & (F.col("families") >= 2)
    return j.select("item_id", F.when(whole, F.col("agreed")).otherwise(F.array().cast(NONE)).alias("agreed"), "singletons", F.when(whole & (F.size("agreed") > 0), "deterministic").when(whole, "needs_review").otherwise("incomplete").alias("status"))


def best_floor(sample: DataFrame, default: float = 0.7) -> DataFrame:
    """floor, agreement: the confidence from which on accepting agrees most with the rulings (confidence, accepted); ties to the lower one; an
    empty sample gives ``default``, a confidence beyond 0..1 raises. Running sums over
    the distinct confidences take the place of comparing every row with every threshold."""
    if sample.filter("confidence < 0 or confidence > 1").limit(1).count():
        raise ValueError("a confidence is outside 0..1")
    g = sample.filter("confidence is not null").groupBy("confidence").agg(F.count_if("accepted").alias("yes"), F.count_if(~F.col("accepted")).alias("no"))
    ends = g.sparkSession.createDataFrame([(0.0, 0, 0), (1.0, 0, 0)], "confidence double, yes long, no long")
    g = g.unionByName(ends).groupBy("confidence").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"))
    w = Window.orderBy("confidence")
    above = w.rowsBetween(0, Window.unboundedFollowing)
    below = w.rowsBetween(Window.unboundedPreceding, -1)
    s = g.withColumn("agreement", F.sum("yes").over(above) + F.coalesce(F.sum("no").over(below), F.lit(0)))
    seen = F.sum(F.col("yes") + F.col("no")).over(Window.partitionBy(F.lit(0)))
    return s.withColumn("_seen", seen).orderBy(F.col("agreement").desc(), "confidence").limit(1).select(F.when(F.col("_seen") == 0, F.lit(default)).otherwise(F.col("confidence")).alias("floor"), "agreement")


def consolidate(claims: DataFrame) -> DataFrame:
    """row_id, field, status, values: claims (row_id, field, value, sitting) agree or collide."""
    return claims.groupBy("row_id", "field").agg(F.array_sort(F.collect_set("value")).alias("values"), F.count_distinct("sitting").alias("sittings")).select("row_id", "field", F.when(F.size("values") > 1, "collision").otherwise("agreement").alias("status"), "values", "sittings")


def fold_decisions(gold: DataFrame, verdicts: DataFrame) -> DataFrame:
    """item_id, before, after, changed: (gold - removed) + added, sorted, from the latest verdict per item and concept (verdicts: item_id, iri,
    verdict 'gold' or 'not_gold', seq). Concepts no verdict mentions stay."""
    last = verdicts.groupBy("item_id", "iri").agg(F.max_by("verdict", "seq").alias("v"))
    sets = last.groupBy("item_id").agg(F.collect_list(F.when(F.col("v") == "gold", F.col("iri"))).alias("plus"), F.collect_list(F.when(F.col("v") == "not_gold", F.col("iri"))).alias("minus"))
    none = F.array().cast(NONE)
    j = gold.select("item_id", F.array_sort(F.array_distinct(F.coalesce("gold", none))).alias("before")).join(sets, "item_id", "left")
    after = F.array_sort(F.array_union(F.array_except("before", F.coalesce("minus", none)), F.coalesce("plus", none)))
    return j.select("item_id", "before", after.alias("after")).withColumn("changed", F.col("before") != F.col("after"))


def snapshot_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """key, missing, added, blocking: what a key's set (key, iri) lost and gained between two snapshots; losses block."""
    b, a = (x.groupBy("key").agg(F.collect_set("iri").alias(n)) for x, n in ((before, "b"), (after, "a")))
    none = F.array().cast(NONE)
    j = b.join(a, "key", "full_outer").withColumns({"b": F.coalesce("b", none), "a": F.coalesce("a", none)})
    return j.select("key", F.array_sort(F.array_except("b", "a")).alias("missing"), F.array_sort(F.array_except("a", "b")).alias("added")).withColumn("blocking", F.size("missing") > 0)


def quota_fill(quotas: DataFrame, items: DataFrame, by: str) -> DataFrame:
    """by, target, got, share: how far each quota is filled; an empty quota is full, one for nothing beyond."""
    n = items.groupBy(by).agg(F.count(F.lit(1)).alias("got"))
    j = quotas.join(n, by, "left").withColumn("got", F.coalesce("got", F.lit(0)))
    share = F.when(F.col("target") > 0, F.col("got").cast("double") / F.when(F.col("target") > 0, F.col("target"))).when(F.col("got") == 0, F.lit(1.0)).otherwise(F.lit(float("inf")))
    return j.select(by, "target", "got", share.alias("share"))


def window_of(log: DataFrame, boundary: Column, order: str = "seq", part: list[str] | None = None) -> DataFrame:
    """Adds window: how many boundaries stand before or at a log row. Attempts since the last boundary are those of the largest window. ``part`` splits the log."""
    w = (Window.partitionBy(*part) if part else Window.partitionBy(F.lit(0))).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return log.withColumn("window", F.sum(F.when(boundary, 1).otherwise(0)).over(w))


def run_status(log: DataFrame, part: list[str]) -> DataFrame:
    """part, attempts, keep, revert, park, check_in: tallies since the last boundary; a check-in is due after every third attempt."""
    marked = window_of(log, F.col("record_type") == "boundary", "seq", part)
    last = marked.withColumn("_max", F.max("window").over(Window.partitionBy(*part))).filter("window = _max and record_type = 'attempt'")
    return last.groupBy(*part).agg(F.count(F.lit(1)).alias("attempts"), *[F.count_if(F.col("decision") == d).alias(d) for d in ("keep", "revert", "park")]).withColumn("check_in", F.col("attempts") % 3 == 0)


def rejection_memory(decisions: DataFrame, catalog_hash: str) -> DataFrame:
    """rejection_key of proposals that were rejected under this state of the catalog: decisions (item_id, action, iris, catalog_hash). Another catalog releases them all."""
    d = decisions.filter((F.col("action") == "reject") & (F.size("iris") > 0) & (F.col("catalog_hash") == catalog_hash))
    return d.select(rejection_key(F.col("item_id"), F.col("iris")).alias("rejection_key")).distinct()


def suppress(rows: DataFrame, memory: DataFrame) -> DataFrame:
    """Rows (item_id, iris) without those whose very proposal was rejected; rows that propose nothing stay."""
    key = F.when(F.size("iris") > 0, rejection_key(F.col("item_id"), F.col("iris")))
    return rows.withColumn("_k", key).join(memory.select(F.col("rejection_key").alias("_k")), "_k", "left_anti").drop("_k")


def outcome_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """test, before, after, blocking: tests whose outcome changed between two runs (test, outcome); what passed and no longer does blocks, anything else is advice."""
    b, a = before.select("test", F.col("outcome").alias("before")), after.select("test", F.col("outcome").alias("after"))
    j = b.join(a, "test", "full_outer").filter(~F.col("before").eqNullSafe(F.col("after")))
    return j.withColumn("blocking", F.coalesce((F.col("before") == "passed") & F.col("after").isNotNull() & (F.col("after") != "passed"), F.lit(False)))


def vote_reasons(votes: DataFrame, floor: float) -> DataFrame:
    """item_id, reason: why the graders of an item don't agree, the first that applies: fewer than three graders, an ambiguous label, an unresolved one, no proposal at all, a concept of
    two graders whose confidence stays below the floor, or different sets. votes: item_id, grader_id, iri (null where a label names none), issue, confidence."""
    v = votes.groupBy("item_id", "grader_id", "iri").agg(F.max("confidence").alias("c"), F.max(F.col("issue") == "ambiguous_label").alias("a"), F.max(F.col("issue") == "unresolved_label").alias("u"))
    per = v.filter("iri is not null").groupBy("item_id", "iri").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("c") >= floor).alias("above"))
    low = per.groupBy("item_id").agg(F.max((F.col("n") >= 2) & (F.col("above") < 2)).alias("low"))
    g = v.groupBy("item_id").agg(F.count_distinct("grader_id").alias("graders"), F.max("a").alias("a"), F.max("u").alias("u"), F.count("iri").alias("iris")).join(low, "item_id", "left")
    no = F.lit(False)
    reason = (
        F.when(F.col("graders") < 3, "missing_votes").when(F.coalesce("a", no), "ambiguous_label").when(F.coalesce("u", no), "unresolved_label").when(F.col("iris") == 0, "empty_proposal").when(F.coalesce("low", no), "sub_floor_confidence").otherwise("set_mismatch")
    )
    return g.select("item_id", reason.alias("reason"))


def sample_for_audit(agreed: DataFrame, size: int = 25, seed: str = "1") -> DataFrame:
    """item_id: a fixed sample of the machine-agreed items, in hashed order."""
    if size < 0:
        raise ValueError("a sample has no negative size")
    return agreed.select("item_id").distinct().withColumn("_h", F.md5(F.concat_ws("|", F.lit(seed), F.col("item_id").cast("string")))).orderBy("_h", "item_id").limit(size).drop("_h")


def stack_scores(items: DataFrame, predictions: DataFrame) -> DataFrame:
    """One row of strict set measures of a foreign system: items (item_id, gold; an empty gold means that nothing is to be found), predictions (item_id, iris). An item without a
    prediction row raises: silence isn't an empty answer."""
    none = F.array().cast(NONE)
    j = items.select("item_id", F.array_distinct(F.coalesce("gold", none)).alias("g")).join(predictions.select("item_id", F.array_distinct(F.coalesce("iris", none)).alias("p"), F.lit(True).alias("_there")), "item_id", "left")
    if j.filter("_there is null").limit(1).count():
        raise ValueError("the predictions leave out items")
    some = F.size("g") > 0
    tp = F.size(F.array_intersect("g", "p"))
    total = j.agg(
        F.count_if(some).alias("items"), F.sum(F.when(some, tp)).alias("tp"), F.sum(F.when(some, F.size("p") - tp)).alias("fp"), F.sum(F.when(some, F.size("g") - tp)).alias("fn"), F.count_if(some & (tp == F.size("g")) & (tp == F.size("p"))).alias("exact_items"),
        F.count_if(some & (F.size("p") == 0)).alias("empty_items"), F.count_if(~some).alias("nomatch_items"), F.count_if(~some & (F.size("p") > 0)).alias("nomatch_false"),
    )
    return total.withColumn("nomatch_share", F.round(F.coalesce(F.try_divide(F.col("nomatch_false").cast("double"), F.col("nomatch_items")), F.lit(0.0)), 6))


def batches(rows: DataFrame, order: list[Column], size: int = 25, part: list[str] | None = None) -> DataFrame:
    """Adds batch: rows in sittings of ``size``, from 0."""
    w = (Window.partitionBy(*part) if part else Window.partitionBy(F.lit(0))).orderBy(*order)
    return rows.withColumn("batch", F.floor((F.row_number().over(w) - 1) / size).cast("int"))
