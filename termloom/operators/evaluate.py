"""Answers from ranked candidates and what they are worth: micro counts, recall at k, near misses, calibration, grids, bootstrap."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termloom.functions.gates import false_positive_cluster, miss_cluster, reachability

THRESHOLDS = tuple(round(i * 0.05, 2) for i in range(1, 20))
KS = tuple(range(1, 11))


def probability_of(score: Column, steps: list[tuple[float, float]]) -> Column:
    """The last step at or below the score, the first one below all; without steps score / 100 within 0..1."""
    if not steps:
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score / 100.0))
    out = F.lit(float(steps[0][1]))
    for x, p in steps:
        out = F.when(score >= float(x), F.lit(float(p))).otherwise(out)
    return out


def rank_candidates(cands: DataFrame, steps: list[tuple[float, float]] | None = None, group: str = "item_id") -> DataFrame:
    """group, iri, score, rank, probability: the best score per concept, ranked by score, then iri. Null and NaN scores don't count."""
    best = cands.filter(F.col(group).isNotNull() & F.col("iri").isNotNull() & F.col("score").isNotNull() & ~F.isnan("score")).groupBy(group, "iri").agg(F.max("score").alias("score"))
    w = Window.partitionBy(group).orderBy(F.col("score").desc(), "iri")
    return best.withColumn("rank", F.row_number().over(w)).withColumn("probability", probability_of(F.col("score"), steps or []))


def commit(ranked: DataFrame, threshold: float, k: int, group: str = "item_id") -> DataFrame:
    """The first k of those with at least the threshold. Probability never falls with the score, so their rank is that of the whole list."""
    return ranked.filter((F.col("probability") >= threshold) & (F.col("rank") <= k))


def gold_sets(rows: DataFrame) -> DataFrame:
    """item_id, firm, stratum_id and the sorted set of gold concepts, from the latest row of each scored item: neither blank nor empty."""
    r = rows.filter("item_id is not null and not coalesce(blank, false) and size(gold_iris) > 0")
    one = r.groupBy("item_id").agg(F.max_by(F.struct("firm", "stratum_id", "gold_iris", "leaf"), F.struct("loaded_at", F.array_join("gold_iris", "|"), F.coalesce("stratum_id", F.lit("")))).alias("r"))
    return one.select("item_id", "r.firm", F.upper(F.trim("r.stratum_id")).alias("stratum_id"), F.array_sort(F.array_distinct("r.gold_iris")).alias("gold"), "r.leaf")


def item_scores(gold: DataFrame, ranked: DataFrame, threshold: float, k: int) -> DataFrame:
    """Per item: committed answers, tp, fp, fn, exact, and gold concepts among the first 1, 3, 5 and 10 candidates."""
    hit = F.when((F.col("probability") >= threshold) & (F.col("rank") <= k), F.col("iri"))
    lists = ranked.filter(F.col("rank") <= max(k, 10)).groupBy("item_id").agg(F.array_sort(F.collect_list(hit)).alias("answers"), *[F.collect_list(F.when(F.col("rank") <= n, F.col("iri"))).alias(f"_top{n}") for n in (1, 3, 5, 10)])
    none = F.array().cast("array<string>")
    j = gold.join(lists, "item_id", "left").withColumn("answers", F.coalesce("answers", none))
    tp = F.size(F.array_intersect("answers", "gold"))
    return j.select(
        "item_id", "firm", "stratum_id", "gold", "answers", tp.alias("tp"), (F.size("answers") - tp).alias("fp"), (F.size("gold") - tp).alias("fn"), (F.col("answers") == F.col("gold")).alias("exact"),
        *[F.size(F.array_intersect(F.coalesce(f"_top{n}", none), F.col("gold"))).alias(f"hits_{n}") for n in (1, 3, 5, 10)],
    )


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def micro_counts(scores: DataFrame) -> DataFrame:
    """Micro counts over all items, by firm and by stratum in one pass: precision, recall, F1 and recall at k; 0 where undefined."""
    total = scores.groupingSets([[], ["firm"], ["stratum_id"]], "firm", "stratum_id").agg(
        F.grouping_id().alias("level"), F.count(F.lit(1)).alias("items"), F.sum(F.size("gold")).alias("gold"), F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"),
        F.count_if("exact").alias("exact_items"), F.count_if(F.size("answers") == 0).alias("empty_items"), *[F.sum(f"hits_{n}").alias(f"_h{n}") for n in (1, 3, 5, 10)],
    )
    p, r = _ratio(F.col("tp"), F.col("tp") + F.col("fp")), _ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    out = total.withColumns({"precision": p, "recall": r}).withColumn("f1", _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    scope = F.when(F.col("level") == 3, "all").when(F.col("level") == 1, "firm").otherwise("stratum")
    return out.select(scope.alias("scope"), "firm", "stratum_id", "items", "gold", "tp", "fp", "fn", "exact_items", "empty_items", "precision", "recall", "f1", *[_ratio(F.col(f"_h{n}"), F.col("gold")).alias(f"recall_at_{n}") for n in (1, 3, 5, 10)])


#: Nearness of a wrong answer to the gold concepts, the nearest first: the relation of the answer's kin that is gold.
BUCKETS = (("child", "parent_1hop"), ("parent", "child_1hop"), ("grandchild", "ancestor_2hop"), ("grandparent", "descendant_2hop"), ("sibling", "sibling"))


def near_misses(scores: DataFrame, hops: DataFrame) -> DataFrame:
    """item_id, iri, bucket, cluster of every false answer."""
    wrong = scores.select("item_id", "gold", F.explode(F.array_except("answers", "gold")).alias("iri"))
    order = F.create_map(*[x for i, (rel, _) in enumerate(BUCKETS) for x in (F.lit(rel), F.lit(i))])
    pairs = wrong.select("item_id", "iri", F.explode("gold").alias("other")).join(hops.withColumnRenamed("node", "iri"), ["iri", "other"])
    nearest = pairs.groupBy("item_id", "iri").agg(F.min(order[F.col("relation")]).alias("o"))
    bucket = F.coalesce(F.try_element_at(F.array(*[F.lit(b) for _, b in BUCKETS]), F.col("o") + 1), F.lit("unrelated"))
    return wrong.select("item_id", "iri").join(nearest, ["item_id", "iri"], "left").select("item_id", "iri", bucket.alias("bucket")).withColumn("cluster", false_positive_cluster(F.col("bucket")))


def miss_clusters(scores: DataFrame, ranked: DataFrame, signals: DataFrame, hops: DataFrame) -> DataFrame:
    """item_id, iri, cluster, reachability, gold_rank of every gold concept without answer. ``signals``: item_id, iri, reachable, exact, homonym,
    jaccard; absent ones are false and 0."""
    missing = scores.select("item_id", F.explode(F.array_except("gold", "answers")).alias("iri"))
    kin = hops.filter(F.col("relation").isin("parent", "child")).select(F.col("node").alias("iri"), F.col("other"))
    seen = ranked.select("item_id", F.col("iri").alias("other"))
    near = missing.join(kin, "iri").join(seen, ["item_id", "other"]).select("item_id", "iri").distinct().withColumn("neighbor", F.lit(True))
    j = missing.join(ranked.select("item_id", "iri", "rank"), ["item_id", "iri"], "left").join(near, ["item_id", "iri"], "left").join(signals, ["item_id", "iri"], "left")
    no = F.lit(False)
    cluster = miss_cluster(F.col("rank").isNotNull(), F.coalesce("reachable", no), F.coalesce("exact", no), F.coalesce("homonym", no), F.coalesce("neighbor", no), F.coalesce("jaccard", F.lit(0.0)))
    return j.select("item_id", "iri", cluster.alias("cluster"), F.coalesce("rank", F.lit(0)).alias("gold_rank")).withColumn("reachability", reachability(F.col("cluster")))


def calibration_samples(ranked: DataFrame, gold: DataFrame) -> DataFrame:
    """score, samples, correct: candidates of scored items per score. Equal scores are pooled here, so what is fitted is as small as the
    number of different scores."""
    g = gold.select("item_id", F.explode("gold").alias("iri"), F.lit(1).alias("hit"))
    return ranked.join(gold.select("item_id"), "item_id").join(g, ["item_id", "iri"], "left").groupBy("score").agg(F.count(F.lit(1)).alias("samples"), F.sum(F.coalesce("hit", F.lit(0))).alias("correct"))


def _pava(points: list[tuple[float, float, float]]) -> list[tuple[float, float]]:
    """Isotonic means of (x, sum, weight) in ascending x: (right edge, mean) of each pool; neighbours are pooled only where the left mean is larger."""
    pools: list[list[float]] = []
    for x, total, weight in points:
        pools.append([x, total, weight])
        while len(pools) > 1 and pools[-2][1] / pools[-2][2] > pools[-1][1] / pools[-1][2]:
            right = pools.pop()
            pools[-1] = [right[0], pools[-1][1] + right[1], pools[-1][2] + right[2]]
    return [(x, t / w) for x, t, w in pools]


def _pools(points: list[tuple[float, float, float]]) -> list[tuple[float, float, float]]:
    """As _pava, with (right edge, sum, weight) of each pool."""
    pools: list[list[float]] = []
    for x, total, weight in points:
        pools.append([x, total, weight])
        while len(pools) > 1 and pools[-2][1] / pools[-2][2] > pools[-1][1] / pools[-1][2]:
            right = pools.pop()
            pools[-1] = [right[0], pools[-1][1] + right[1], pools[-1][2] + right[2]]
    return [tuple(p) for p in pools]


def fit_steps(samples: DataFrame, digits: int = 6) -> DataFrame:
    """x, p: the isotonic step function of calibration_samples, compressed to the steps where p changes.

    The scores are cut into ranges, each range is pooled by itself, and the pools are pooled again: pooling neighbours that violate the order gives the same in any order, so no score
    is rounded and only the pools, which are far fewer, meet in one task."""

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        points: list[tuple[float, float, float]] = []
        for b in batches:
            points = _pools([*points, *zip(b["score"], b["correct"].astype(float), b["samples"].astype(float))])
        if points:
            yield pd.DataFrame(points, columns=["score", "correct", "samples"])

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("score")
        out: list[tuple[float, float]] = []
        for x, p in _pava(list(zip(pdf["score"], pdf["correct"], pdf["samples"]))):
            p = round(p, digits)
            if not out or out[-1][1] != p:
                out.append((float(x), p))
        return pd.DataFrame(out, columns=["x", "p"])

    ranges = samples.filter("score is not null").select("score", "correct", "samples").repartitionByRange("score").sortWithinPartitions("score")
    pools = ranges.mapInPandas(local, "score double, correct double, samples double")
    return pools.withColumn("_g", F.lit(0)).groupBy("_g").applyInPandas(lambda pdf: fit(pdf), "x double, p double")


def weak_band(steps: list[tuple[float, float]], weak: float = 0.5, strong: float = 0.8) -> tuple[float, float]:
    """The scores from which the probability reaches ``weak`` and ``strong``; the top of the fit where it never does; without steps the shares themselves."""
    if not steps:
        return weak * 100.0, strong * 100.0
    top = steps[-1][0]
    low, high = (next((x for x, p in steps if p >= bound), top) for bound in (weak, strong))
    return low, max(low, high)


def frontier(points: DataFrame, chosen: DataFrame, thresholds=THRESHOLDS) -> DataFrame:
    """The grid points next to the chosen one (a table of one row): at most one step of threshold and of k away."""
    c = chosen.select(F.col("threshold").alias("_t"), F.col("k").alias("_k")).limit(1)
    at = lambda x: F.array_position(F.array(*[F.lit(float(t)) for t in thresholds]), x)
    return points.join(F.broadcast(c), how="cross").filter((F.abs(at(F.col("threshold")) - at(F.col("_t"))) <= 1) & (F.abs(F.col("k") - F.col("_k")) <= 1)).drop("_t", "_k")


def replay(answers: DataFrame, gold: DataFrame, by: list[str]) -> DataFrame:
    """by, items, gold, predicted, tp, fp, fn, exact_items, empty_items: committed answers (item_id, answers) counted again against other gold sets (by, item_id, iris);
    items without gold leave the count, and their answers with them."""
    none = F.array().cast("array<string>")
    clean = lambda c: F.array_distinct(F.filter(F.coalesce(c, none), lambda x: x.isNotNull() & (x != "")))
    j = gold.withColumn("_g", clean(F.col("iris"))).filter(F.size("_g") > 0).join(answers.select("item_id", F.col("answers").alias("_a")), "item_id", "left").withColumn("_a", clean(F.col("_a")))
    tp = F.size(F.array_intersect("_a", "_g"))
    return j.groupBy(*by).agg(
        F.count(F.lit(1)).alias("items"), F.sum(F.size("_g")).alias("gold"), F.sum(F.size("_a")).alias("predicted"), F.sum(tp).alias("tp"), F.sum(F.size("_a") - tp).alias("fp"), F.sum(F.size("_g") - tp).alias("fn"),
        F.count_if((tp == F.size("_g")) & (tp == F.size("_a"))).alias("exact_items"), F.count_if(F.size("_a") == 0).alias("empty_items"),
    )


def grid(ranked: DataFrame, gold: DataFrame, thresholds=THRESHOLDS, ks=KS) -> DataFrame:
    """threshold, k, tp, fp, fn, f1 of every point. Each candidate is counted once in the cell where it enters (smallest k, largest
    threshold), and the cells are added up: no product of candidates and grid points."""
    g = gold.select("item_id", F.explode("gold").alias("iri"), F.lit(1).alias("hit"))
    total = gold.agg(F.sum(F.size("gold")).alias("gold"))
    level = F.size(F.filter(F.array(*[F.lit(float(t)) for t in thresholds]), lambda t: t <= F.col("probability")))
    cells = ranked.join(gold.select("item_id"), "item_id").filter(F.col("rank") <= max(ks)).join(g, ["item_id", "iri"], "left").groupBy("rank", level.alias("level")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("hit", F.lit(0))).alias("hits"))
    spark = ranked.sparkSession
    points = spark.createDataFrame([(float(t), i + 1, k) for i, t in enumerate(thresholds) for k in ks], "threshold double, need int, k int")
    sums = points.join(cells, (F.col("rank") <= F.col("k")) & (F.col("level") >= F.col("need")), "left").groupBy("threshold", "k").agg(F.sum(F.coalesce("n", F.lit(0))).alias("n"), F.sum(F.coalesce("hits", F.lit(0))).alias("tp"))
    tp, n = F.col("tp"), F.col("n")
    return sums.join(total, how="cross").select("threshold", "k", tp.alias("tp"), (n - tp).alias("fp"), (F.col("gold") - tp).alias("fn"), _ratio(2 * tp, n + F.col("gold")).alias("f1"))


def best_point(points: DataFrame) -> DataFrame:
    """Highest F1, then the smaller k, then the higher threshold."""
    return points.orderBy(F.col("f1").desc(), "k", F.col("threshold").desc()).limit(1)


def paired_units(before: DataFrame, after: DataFrame) -> DataFrame:
    """item_id with the counts of two runs and the change of exactness (+1, 0, -1)."""
    a = before.select("item_id", *[F.col(c).alias(f"{c}_a") for c in ("tp", "fp", "fn")], F.col("exact").cast("int").alias("exact_a"))
    b = after.select("item_id", *[F.col(c).alias(f"{c}_b") for c in ("tp", "fp", "fn")], F.col("exact").cast("int").alias("exact_b"))
    return a.join(b, "item_id").withColumn("change", F.col("exact_b") - F.col("exact_a"))


def _mixed(x: np.ndarray) -> np.ndarray:
    """A well mixed 64-bit number for each number."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def bootstrap_f1_delta(units: DataFrame, resamples: int = 2000, seed: int = 20260727, alpha: float = 0.05) -> dict:
    """Percentile bootstrap of the F1 difference between two runs: point, low, high, n_units.

    Items are resampled in the cluster: each item has in each resample a Poisson(1) weight that depends on its id, the resample and the seed alone, the usual stand-in for drawing n of
    n with replacement where n is large. Each task adds its items up to one row per resample, so the driver reads ``resamples`` rows however many items there are, and
    the result doesn't depend on how the items are spread."""
    names = ["tp_a", "fp_a", "fn_a", "tp_b", "fp_b", "fn_b"]
    below = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(16)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((resamples, len(names)))
        draws = _mixed(np.arange(resamples, dtype=np.uint64) + np.uint64(seed))
        for b in batches:
            marks = b["mark"].to_numpy(np.int64).astype(np.uint64)
            counts = b[names].to_numpy(float)
            for a in range(0, len(marks), 500):
                u = (_mixed(marks[a : a + 500, None] ^ draws[None, :]) >> np.uint64(11)).astype(float) / float(1 << 53)
                sums += np.searchsorted(below, u).T @ counts[a : a + 500]
        yield pd.DataFrame({"draw": range(resamples), **{n: sums[:, i] for i, n in enumerate(names)}})

    def f1(t, p, n):
        return 2 * t / (2 * t + p + n) if t else 0.0

    whole = units.agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in names]).first()
    if not whole["n"]:
        return {"point": 0.0, "low": 0.0, "high": 0.0, "n_units": 0}
    parts = units.select(F.xxhash64("item_id").alias("mark"), *names).mapInPandas(run, "draw int, " + ", ".join(f"{n} double" for n in names))
    rows = parts.groupBy("draw").agg(*[F.sum(n).alias(n) for n in names]).collect()
    draws = sorted(f1(r["tp_b"], r["fp_b"], r["fn_b"]) - f1(r["tp_a"], r["fp_a"], r["fn_a"]) for r in rows)
    at = lambda f: draws[round(f * (len(draws) - 1))]
    point = f1(whole["tp_b"], whole["fp_b"], whole["fn_b"]) - f1(whole["tp_a"], whole["fp_a"], whole["fn_a"])
    return {"point": point, "low": at(alpha / 2), "high": at(1 - alpha / 2), "n_units": whole["n"]}


def verdict(ci: dict) -> str:
    return "win" if ci["low"] > 0 else "loss" if ci["high"] < 0 else "hold"
