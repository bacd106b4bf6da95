import math
import random

from pyspark.sql import functions as F

from termloom.llm.topk import ranked_top, top_n

SCHEMA = "cand_id long, item_id string, config_version int, iri string, score double, rank int, _salt string"


def brute(rows, k):
    best = {}
    for _, item, cfg, iri, score, *_ in rows:
        if item is not None and cfg in k and k[cfg] and iri is not None and score is not None and not math.isnan(score):
            g = best.setdefault((item, cfg), {})
            g[iri] = max(g.get(iri, score), score)
    return {(i, c, p + 1, iri) for (i, c), g in best.items() for p, (iri, _) in enumerate(sorted(g.items(), key=lambda x: (-x[1], x[0]))[: k[c]])}


def test_against_brute_force_with_hot_item_ties_and_hand_over(spark):
    rng = random.Random(1)
    rows = []
    for n in range(4000):
        item = "hot" if rng.random() < 0.4 else rng.choice([None, *[f"i{x}" for x in range(60)]])
        rows.append((n, item, rng.choice([1, 2, 3, None]), rng.choice([None, *[f"c{x}" for x in range(40)]]), rng.choice([None, float("nan"), float(rng.randrange(30)), 5.0]), None, "x"))
    rows += rows[:50]
    rules = [(1, 3), (2, 1), (3, None), (None, 4)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    want = brute(rows, {1: 3, 2: 1})
    got = {(r.item_id, r.config_version, r.place, r.iri) for r in ranked_top(df, spark.createDataFrame(rules, "config_version int, top_k int")).collect()}
    assert got == want
    small = top_n(df.withColumn("k", F.when(F.col("config_version") == 1, 3).when(F.col("config_version") == 2, 1)), ("item_id", "config_version"), "score", "iri", F.col("k"), held=20)
    assert {(r.item_id, r.config_version, r.place, r.iri) for r in small.collect()} == want


def test_empty_and_code_point_order(spark):
    rules = spark.createDataFrame([(1, 2)], "config_version int, top_k int")
    assert ranked_top(spark.createDataFrame([], SCHEMA), rules).count() == 0
    rows = [(1, "a", 1, "é", 1.0, 0, ""), (2, "a", 1, "z", 1.0, 0, ""), (3, "a", 1, "Z", 1.0, 0, "")]
    assert [r.iri for r in ranked_top(spark.createDataFrame(rows, SCHEMA), rules).orderBy("place").collect()] == ["Z", "z"]
