"""Queries of the evaluation analytics: answers, scores, calibration, gold construction, audit folds, vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.functions import normalize
from termloom.functions.gates import enforce_verdict
from termloom.functions.scoring import sql_content
from termloom.functions.text import content_words, jaccard
from termloom.operators import annotate, audit, embedding, evaluate, gold, reconcile
from termloom.operators.catalog import ConceptCatalog
from termloom.plans import pipeline
from termloom.plans.resolution_queries import _SPANS
from termloom.runtime import table

THRESHOLD, K = 0.55, 4


def _ranked(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.rank_candidates(table(spark, d, "ranked_candidates"))


def _gold(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.gold_sets(table(spark, d, "gold_rows"))


def _scores(spark, d):
    return evaluate.item_scores(_gold(spark, d), _ranked(spark, d), THRESHOLD, K)


def answer_ranking(spark, d):
    return _ranked(spark, d).select("item_id", "iri", "score", "rank", "probability")


def answer_commit(spark, d):
    return evaluate.commit(_ranked(spark, d), THRESHOLD, K).select("item_id", "iri", "rank")


def micro_scores(spark, d):
    return evaluate.micro_counts(_scores(spark, d))


def near_misses(spark, d):
    n = evaluate.near_misses(_scores(spark, d), ConceptCatalog(table(spark, d, "concepts")).hops())
    return n.groupBy("bucket", "cluster").agg(F.count(F.lit(1)).alias("answers"))


def _misses(spark, d):
    s, r = _scores(spark, d), _ranked(spark, d)
    c = table(spark, d, "concepts")
    missing = _gold(spark, d).select("item_id", "leaf", F.explode("gold").alias("iri")).join(c.select("iri", "label"), "iri")
    signals = missing.select("item_id", "iri", F.lit(False).alias("reachable"), (F.lower("leaf") == F.lower("label")).alias("exact"), F.lit(False).alias("homonym"), jaccard(content_words(F.col("leaf")), content_words(F.col("label"))).alias("jaccard"))
    return evaluate.miss_clusters(s, r, signals, ConceptCatalog(c).hops())


def miss_clusters(spark, d):
    m = _misses(spark, d)
    return m.groupBy("cluster", "reachability").agg(F.count(F.lit(1)).alias("misses"))


def calibration_samples(spark, d):
    return evaluate.calibration_samples(_ranked(spark, d), _gold(spark, d))


def calibration_fit(spark, d):
    return evaluate.fit_steps(calibration_samples(spark, d))


def grid_search(spark, d):
    return evaluate.grid(_ranked(spark, d), _gold(spark, d))


def grid_choice(spark, d):
    return evaluate.best_point(grid_search(spark, d))


def run_comparison(spark, d):
    g = _gold(spark, d)
    c = table(spark, d, "ranked_candidates")
    a, b = (evaluate.item_scores(g, evaluate.rank_candidates(c.filter(F.col("config_version") == v)), THRESHOLD, K) for v in (1, 2))
    ci = evaluate.bootstrap_f1_delta(evaluate.paired_units(a, b))
    return spark.createDataFrame([(ci["point"], ci["low"], ci["high"], ci["n_units"], evaluate.verdict(ci))], "point double, low double, high double, n_units long, verdict string")


def changed_items(spark, d):
    g = _gold(spark, d)
    c = table(spark, d, "ranked_candidates")
    a, b = (evaluate.item_scores(g, evaluate.rank_candidates(c.filter(F.col("config_version") == v)), THRESHOLD, K) for v in (1, 2))
    return evaluate.paired_units(a, b).agg(F.count_if(F.expr("change > 0")).alias("improved"), F.count_if(F.expr("change < 0")).alias("regressed"), F.count_if(F.expr("change = 0")).alias("unchanged"))


def reconcile_sides(spark, d):
    v = table(spark, d, "gold_values").filter("raw is not null and trim(raw) <> ''").select(F.col("raw").alias("text"), "iri", F.col("raw").alias("label"), F.lit(None).cast("string").alias("definition"), F.when(F.col("suspect"), 0.55).otherwise(0.72).alias("confidence"), F.col("value_id").alias("ord"))
    p = table(spark, d, "label_proposals").filter("label is not null and trim(label) <> ''").select(F.col("label").alias("text"), "iri", "label", F.lit(None).cast("string").alias("definition"), (F.coalesce("score", F.lit(50.0)) / 100.0).alias("confidence"), F.col("proposal_id").alias("ord"))
    return reconcile.reconcile(v, p)


def judge_enforcement(spark, d):
    p = table(spark, d, "label_proposals").filter("score is not null")
    verdict = F.when(F.col("method") == "search", "confirmed").when(F.col("method") == "reviewer", "boosted").when(F.col("iri").isNull(), "rejected").otherwise("penalized")
    return p.select("proposal_id", enforce_verdict(F.lit(60.0), F.col("score"), verdict).alias("adjusted"))


def judge_answers(spark, d):
    ranked = table(spark, d, "label_proposals").filter("iri is not null and score is not null").groupBy(F.col("value_id").cast("string").alias("query_id"), "iri").agg(F.max("score").alias("score"))
    row = F.struct(F.col("iri").alias("iri_hash"), (F.col("score") + 3).alias("adjusted_score"), F.lit("confirmed").alias("verdict"), F.lit("ok").alias("reasoning"))
    answers = ranked.groupBy("query_id").agg(F.concat(F.lit("```json\n"), F.to_json(F.struct(F.array_sort(F.collect_list(row)).alias("judged"))), F.lit("\n```")).alias("answer"))
    return pipeline.parse_judgements(answers, ranked)


def _feedback(spark, d):
    rating = F.when(F.col("event_type").isin("signup", "purchase"), "up").when(F.col("event_type") == "error", "down").when(F.col("event_type") == "view", "dismissed").otherwise("other")
    stage = F.nullif((F.col("user_id") % 5).cast("string"), F.lit("0"))
    return table(spark, d, "events").select(F.col("event_id").alias("id"), rating.alias("rating"), stage.alias("stage"), F.get_json_object("props", "$.k").alias("iri"), F.concat(F.lit("L"), F.get_json_object("props", "$.k")).alias("label"), F.col("ts").alias("created_at"))


def feedback_insights(spark, d):
    return annotate.feedback_counts(_feedback(spark, d))


def top_downvoted(spark, d):
    return annotate.top_concepts(_feedback(spark, d), "down")


def recent_feedback(spark, d):
    return annotate.recent(_feedback(spark, d)).select("id", "rating")


def display_segments(spark, d):
    from termloom.operators import scan

    docs = table(spark, d, "documents")
    spans = scan.scan(docs, ConceptCatalog(table(spark, d, "concepts")).labels.select(F.col("label_key").alias("pattern"), "iri", "kind"))
    s = spans.select("doc_id", F.concat_ws(":", "start", "end", "iri").alias("id"), "start", "end", "iri", F.when(F.col("kind") == "preferred", 0.72).otherwise(0.55).alias("confidence"))
    return annotate.segments(docs.select("doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("n")), s).select("doc_id", "start", "end", F.array_join("ids", "|").alias("ids"))


def forward_fill(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority")).alias("l1"), F.when(F.col("o_totalprice") > 200000, F.concat(F.lit("P"), F.col("o_orderpriority"))).alias("l2"), F.when(F.col("o_orderstatus") != "F", F.col("o_orderkey").cast("string")).alias("l3"))
    return gold.forward_fill(o, "o_custkey", "o_orderkey", "l1", "l2", "l3").select("o_orderkey", "head1", "head2", "role")


def pair_blocks(spark, d):
    g = table(spark, d, "gold_rows").filter("size(ancestor_path) > 0 and size(gold_iris) > 0")
    p = gold.pair_blocks(F.col("ancestor_path"), F.transform("gold_iris", lambda x: F.array(x)))
    r = g.select("item_id", p.alias("p")).select("item_id", "p.ambiguous", F.array_join(F.transform("p.reading", lambda x: F.array_join(x, ",")), "|").alias("reading"), F.array_join(gold.pairing_violations(F.col("p.reading")), ",").alias("violations"))
    return r.distinct()


def label_ladder(spark, d):
    return gold.resolve_values(table(spark, d, "gold_values").select(F.col("raw").alias("value")), table(spark, d, "concepts"), with_compounds=True)


def merge_cells(spark, d):
    v = table(spark, d, "gold_values")
    cells = v.select(F.lit("firm").alias("firm"), F.col("raw").alias("text"), F.when(F.col("iri").isNotNull(), F.array("iri")).alias("answers"), F.when(F.col("suspect"), F.array(F.lit("suspect"))).alias("flags"), F.col("value_id").alias("ord"))
    return gold.merge_cells(cells).select("key", "cells", "inconsistent", F.array_join("answers", "|").alias("answers"), F.array_join("flags", "|").alias("flags"))


def _split_items(spark, d):
    g = table(spark, d, "gold_rows").filter("not blank")
    one = g.groupBy("item_id").agg(F.max_by(F.struct("firm", "stratum_id", "ancestor_path", "leaf", "flags"), F.struct("loaded_at", F.coalesce(F.array_join("ancestor_path", "|"), F.lit("")), F.coalesce("stratum_id", F.lit("")))).alias("r"))
    return one.select("item_id", "r.firm", F.upper(F.trim(F.coalesce("r.stratum_id", F.lit("")))).alias("stratum_id"), F.lower(F.coalesce(F.try_element_at("r.ancestor_path", F.lit(2)), F.lit(""))).alias("group_id"), F.lower(F.coalesce("r.leaf", F.lit(""))).alias("surface"), "r.flags")


def split_frozen_tune(spark, d):
    return gold.evaluation_splits(_split_items(spark, d))


def split_checks(spark, d):
    items = _split_items(spark, d)
    return gold.split_violations(items, gold.evaluation_splits(items))


def variant_stats(spark, d):
    v = table(spark, d, "gold_values").filter("item_id is not null")
    return audit.variant_stats(audit.variant_sets(v))


def vote_fold(spark, d):
    e = table(spark, d, "events").filter("event_type in ('view', 'click', 'error')")
    votes = e.select(F.col("user_id").alias("item_id"), F.col("event_type").alias("grader_id"), F.when(F.col("event_type") == "view", "a").otherwise("b").alias("family"), F.get_json_object("props", "$.k").alias("iri"), (F.col("event_id") % 10 / 10.0).alias("confidence"))
    f = audit.fold_votes(votes, 0.5)
    return f.select("item_id", F.array_join("agreed", ",").alias("agreed"), F.array_join("singletons", ",").alias("singletons"), "status")


def vote_floor(spark, d):
    p = table(spark, d, "label_proposals").filter("score is not null")
    return audit.best_floor(p.select((F.col("score") / 100).alias("confidence"), F.coalesce(F.col("iri").isNotNull(), F.lit(False)).alias("accepted")))


def consolidate_claims(spark, d):
    v = table(spark, d, "gold_values").filter("item_id is not null and iri is not null")
    c = audit.consolidate(v.select(F.col("item_id").alias("row_id"), F.col("sheet_column").alias("field"), F.col("iri").alias("value"), F.col("origin").alias("sitting")))
    return c.select("row_id", "field", "status", F.size("values").alias("n_values"), "sittings")


def decision_fold(spark, d):
    g = _gold(spark, d)
    v = table(spark, d, "gold_values").filter("item_id is not null").select("value_id", "item_id").distinct()
    p = table(spark, d, "label_proposals").filter("iri is not null").join(v, "value_id")
    verdicts = p.select("item_id", "iri", F.when(F.coalesce("score", F.lit(0.0)) >= 75, "gold").otherwise("not_gold").alias("verdict"), F.col("proposal_id").alias("seq"))
    f = audit.fold_decisions(g, verdicts)
    return f.select("item_id", F.size("before").alias("n_before"), F.size("after").alias("n_after"), "changed")


def snapshot_diff(spark, d):
    c = table(spark, d, "ranked_candidates").filter("item_id is not null and iri is not null")
    a, b = (c.filter(F.col("config_version") == v).select(F.col("item_id").alias("key"), "iri") for v in (1, 2))
    f = audit.snapshot_diff(a, b)
    return f.select("key", F.size("missing").alias("n_missing"), F.size("added").alias("n_added"), "blocking")


def quota_fill(spark, d):
    docs = table(spark, d, "documents").filter("doc_type is not null")
    quotas = docs.select("doc_type").distinct().withColumn("target", F.lit(100))
    return audit.quota_fill(quotas, docs, "doc_type")


def run_status(spark, d):
    e = table(spark, d, "events")
    decision = F.when(F.col("event_type") == "purchase", "keep").when(F.col("event_type") == "error", "revert").otherwise("park")
    return audit.run_status(e.select("user_id", F.col("event_id").alias("seq"), F.when(F.col("event_type") == "signup", "boundary").otherwise("attempt").alias("record_type"), decision.alias("decision")), ["user_id"])


def sittings(spark, d):
    p = table(spark, d, "label_proposals")
    return audit.batches(p, [F.coalesce("score", F.lit(0.0)).desc(), F.col("proposal_id")], part=["method"]).select("proposal_id", "batch")


def semantic_topk(spark, d):
    e = table(spark, d, "embeddings")
    q = e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return embedding.nearest(q, e, 10).select("query_id", "vec_id", "place", F.round("cosine", 5).alias("cosine"))


def hashing_embedding(spark, d):
    c = table(spark, d, "concepts")
    return embedding.hashing_buckets(c, "iri", F.concat_ws(": ", "label", "definition")).select("iri", "bucket", F.round("weight", 9).alias("weight"))


# -- SQL --------------------------------------------------------------------------------------------------------------------

_RANKED = """best AS (SELECT item_id, iri, max(score) AS score FROM ranked_candidates WHERE item_id IS NOT NULL AND iri IS NOT NULL AND score IS NOT NULL AND NOT isnan(score) GROUP BY ALL),
ranked AS (SELECT item_id, iri, score, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, iri) AS INTEGER) AS rank, greatest(0.0::DOUBLE, least(1.0::DOUBLE, score / 100.0::DOUBLE)) AS probability FROM best)"""
_GOLD = """latest AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY loaded_at DESC, array_to_string(gold_iris, '|') DESC, coalesce(stratum_id, '') DESC) AS n FROM gold_rows WHERE item_id IS NOT NULL AND NOT coalesce(blank, false) AND len(gold_iris) > 0),
gold AS (SELECT item_id, firm, upper(trim(stratum_id)) AS stratum_id, list_sort(list_distinct(gold_iris)) AS gold FROM latest WHERE n = 1)"""
_SCORES = f"""{_RANKED}, {_GOLD}, lists AS (SELECT item_id, list_sort(coalesce(list(iri) FILTER (probability >= {THRESHOLD} AND rank <= {K}), [])) AS answers, {", ".join(f"coalesce(list(iri) FILTER (rank <= {n}), []) AS top{n}" for n in (1, 3, 5, 10))} FROM ranked GROUP BY item_id),
scores AS (SELECT g.item_id, firm, stratum_id, gold, coalesce(answers, []) AS answers, len(list_intersect(gold, coalesce(answers, []))) AS tp, {", ".join(f"len(list_intersect(gold, coalesce(top{n}, []))) AS h{n}" for n in (1, 3, 5, 10))} FROM gold g LEFT JOIN lists USING (item_id))"""
_FEEDBACK = "f AS (SELECT event_id AS id, CASE WHEN event_type IN ('signup', 'purchase') THEN 'up' WHEN event_type = 'error' THEN 'down' WHEN event_type = 'view' THEN 'dismissed' ELSE 'other' END AS rating, coalesce(nullif(CAST(user_id % 5 AS VARCHAR), '0'), 'overall') AS stage, json_extract_string(props, '$.k') AS iri FROM events)"
_POINTS = "(VALUES " + ", ".join(f"({t}::DOUBLE)" for t in evaluate.THRESHOLDS) + ") AS t(threshold), (VALUES " + ", ".join(f"({k})" for k in evaluate.KS) + ") AS u(k)"

_BLANKS = r"trim(regexp_replace({x}, '[\s\p{{Z}}]+', ' ', 'g'))"
# compatibility forms of single Latin-1 characters, which NFC leaves alone
_COMPATIBLE = {"\u00a0": " ", "\u00a8": " \u0308", "\u00aa": "a", "\u00af": " \u0304", "\u00b2": "2", "\u00b3": "3", "\u00b4": " \u0301", "\u00b5": "\u03bc", "\u00b8": " \u0327", "\u00b9": "1", "\u00ba": "o", "\u00bc": "1\u20444", "\u00bd": "1\u20442", "\u00be": "3\u20444", "\u02dc": " \u0303", "\u2017": " \u0333", "\u2026": "...", "\u2122": "TM"}
_NFKC = "nfc_normalize({x})"
for _from, _to in _COMPATIBLE.items():
    _NFKC = f"replace({_NFKC}, '{_from}', '{_to}')"
_NORMAL = r"trim(regexp_replace(regexp_replace(" + _NFKC + r", '[\x{{2010}}-\x{{2015}}\x{{2212}}\x{{FE58}}\x{{FE63}}\x{{FF0D}}]', '-', 'g'), '[\s\p{{Z}}\x{{0B}}\x{{1C}}-\x{{1F}}]+', ' ', 'g'))"
_KEY = f"lower({_NORMAL})"
# singular and plural forms of the last word of nt, in the order of the rule
_LAST = "regexp_extract(nt, '([^ ]*)$', 1)"
_PLURALS = f"""list_filter([CASE WHEN lower({_LAST}) LIKE '%ies' AND length({_LAST}) > 3 THEN left(nt, length(nt) - 3) || 'y' END, CASE WHEN lower({_LAST}) LIKE '%es' AND length({_LAST}) > 2 THEN left(nt, length(nt) - 2) END,
  CASE WHEN lower({_LAST}) LIKE '%s' AND lower({_LAST}) NOT LIKE '%ss' AND length({_LAST}) > 1 THEN left(nt, length(nt) - 1) END, CASE WHEN lower({_LAST}) LIKE '%y' AND length({_LAST}) > 1 AND lower({_LAST})[-2] NOT IN ('a', 'e', 'i', 'o', 'u') THEN left(nt, length(nt) - 1) || 'ies' END,
  CASE WHEN regexp_matches(lower({_LAST}), '(s|x|z|ch|sh)$') THEN nt || 'es' END, CASE WHEN nt <> '' THEN nt || 's' END], lambda m: m IS NOT NULL)"""

SQL = {
    "answer_ranking": f"WITH {_RANKED} SELECT item_id, iri, score, rank, probability FROM ranked",
    "answer_commit": f"WITH {_RANKED} SELECT item_id, iri, rank FROM ranked WHERE probability >= {THRESHOLD} AND rank <= {K}",
    "micro_scores": f"""WITH {_SCORES}, t AS (SELECT grouping(firm, stratum_id) AS level, firm, stratum_id, count(*) AS items, sum(len(gold)) AS gold, sum(tp) AS tp, sum(len(answers) - tp) AS fp, sum(len(gold) - tp) AS fn, count_if(answers = gold) AS exact_items, count_if(len(answers) = 0) AS empty_items, {", ".join(f"sum(h{n}) AS h{n}" for n in (1, 3, 5, 10))} FROM scores GROUP BY GROUPING SETS ((), (firm), (stratum_id))),
r AS (SELECT *, coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0) AS p, coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0) AS rc FROM t)
SELECT CASE level WHEN 3 THEN 'all' WHEN 1 THEN 'firm' ELSE 'stratum' END AS scope, firm, stratum_id, items, gold, tp, fp, fn, exact_items, empty_items, p AS precision, rc AS recall, coalesce(2 * p * rc / nullif(p + rc, 0), 0) AS f1, {", ".join(f"coalesce(h{n}::DOUBLE / nullif(gold, 0), 0) AS recall_at_{n}" for n in (1, 3, 5, 10))} FROM r""",
    "near_misses": f"""WITH {_SCORES}, e AS (SELECT DISTINCT iri AS c, unnest(parent_iris) AS p FROM concepts), two AS (SELECT DISTINCT a.c, b.p FROM e a JOIN e b ON a.p = b.c), sib AS (SELECT DISTINCT a.c, b.c AS o FROM e a JOIN e b ON a.p = b.p WHERE a.c <> b.c),
h AS (SELECT p AS node, c AS other, 0 AS o FROM e UNION ALL SELECT c, p, 1 FROM e UNION ALL SELECT p, c, 2 FROM two UNION ALL SELECT c, p, 3 FROM two UNION ALL SELECT c, o, 4 FROM sib),
w AS (SELECT item_id, gold, unnest(list_filter(answers, lambda x: NOT list_contains(gold, x))) AS iri FROM scores), g AS (SELECT item_id, iri, unnest(gold) AS other FROM w),
m AS (SELECT w.item_id, w.iri, (SELECT min(h.o) FROM g JOIN h ON h.node = g.iri AND h.other = g.other WHERE g.item_id = w.item_id AND g.iri = w.iri) AS o FROM w)
SELECT bucket, CASE WHEN bucket IN ('parent_1hop', 'child_1hop') THEN 'fp_near_miss' ELSE 'fp_unrelated' END AS cluster, count(*) AS answers FROM (SELECT CASE o WHEN 0 THEN 'parent_1hop' WHEN 1 THEN 'child_1hop' WHEN 2 THEN 'ancestor_2hop' WHEN 3 THEN 'descendant_2hop' WHEN 4 THEN 'sibling' ELSE 'unrelated' END AS bucket FROM m) GROUP BY bucket""",
    "calibration_samples": f"WITH {_RANKED}, {_GOLD} SELECT score, count(*) AS samples, sum(CASE WHEN list_contains(gold, iri) THEN 1 ELSE 0 END) AS correct FROM ranked JOIN gold USING (item_id) GROUP BY score",
    "grid_search": f"""WITH {_RANKED}, {_GOLD}, c AS (SELECT rank, probability, list_contains(gold, iri) AS hit FROM ranked JOIN gold USING (item_id) WHERE rank <= 10), n AS (SELECT sum(len(gold)) AS total FROM gold), pts AS (SELECT threshold, k FROM {_POINTS}),
s AS (SELECT threshold, k, count(rank) AS n, coalesce(sum(CASE WHEN hit THEN 1 ELSE 0 END), 0) AS tp FROM pts LEFT JOIN c ON rank <= k AND probability >= threshold GROUP BY ALL)
SELECT threshold, k, tp, n - tp AS fp, total - tp AS fn, coalesce((2 * tp)::DOUBLE / nullif(s.n + total, 0), 0) AS f1 FROM s, n""",
    "changed_items": f"""WITH {_GOLD}, b AS (SELECT config_version AS v, item_id, iri, max(score) AS score FROM ranked_candidates WHERE item_id IS NOT NULL AND score IS NOT NULL AND NOT isnan(score) AND config_version IN (1, 2) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY v, item_id ORDER BY score DESC, iri) AS rank FROM b), a AS (SELECT v, item_id, list_sort(list(iri)) AS answers FROM r WHERE rank <= {K} AND least(1, score / 100) >= {THRESHOLD} GROUP BY ALL),
x AS (SELECT g.item_id, coalesce(a1.answers = gold, false)::INT AS e1, coalesce(a2.answers = gold, false)::INT AS e2 FROM gold g LEFT JOIN a a1 ON a1.item_id = g.item_id AND a1.v = 1 LEFT JOIN a a2 ON a2.item_id = g.item_id AND a2.v = 2)
SELECT count_if(e2 > e1) AS improved, count_if(e2 < e1) AS regressed, count_if(e1 = e2) AS unchanged FROM x""",
    "judge_enforcement": "SELECT proposal_id, CASE WHEN method = 'search' THEN greatest(55.0::DOUBLE, least(65.0::DOUBLE, score)) WHEN method = 'reviewer' THEN least(score, 85.0::DOUBLE) WHEN iri IS NULL THEN 0.0::DOUBLE ELSE score END AS adjusted FROM label_proposals WHERE score IS NOT NULL",
    "feedback_insights": f"WITH {_FEEDBACK} SELECT stage, count_if(rating = 'up') AS up, count_if(rating = 'down') AS down, count_if(rating = 'dismissed') AS dismissed, count(*) AS total FROM f GROUP BY ROLLUP (stage)",
    "top_downvoted": f"WITH {_FEEDBACK} SELECT iri, n AS count, 'L' || iri AS label, CAST(row_number() OVER (ORDER BY n DESC, first) AS INTEGER) AS place FROM (SELECT iri, count(*) AS n, min(id) AS first FROM f WHERE rating = 'down' AND iri IS NOT NULL GROUP BY iri) ORDER BY n DESC, first LIMIT 10",
    "recent_feedback": f"WITH {_FEEDBACK} SELECT f.id, f.rating FROM f JOIN events e ON e.event_id = f.id ORDER BY e.ts DESC, f.id LIMIT 20",
    "judge_answers": """WITH r AS (SELECT CAST(value_id AS VARCHAR) AS query_id, iri, max(score) AS score FROM label_proposals WHERE iri IS NOT NULL AND score IS NOT NULL GROUP BY ALL)
SELECT query_id, iri, greatest(0.0::DOUBLE, least(100.0::DOUBLE, greatest(score - 5, least(score + 5, least(100.0::DOUBLE, greatest(0.0::DOUBLE, score + 3)))))) AS score, 'confirmed' AS verdict, 'ok' AS reasoning FROM r""",
    "pair_blocks": """WITH g AS (SELECT DISTINCT item_id, ancestor_path AS i, gold_iris AS b FROM gold_rows WHERE len(ancestor_path) > 0 AND len(gold_iris) > 0),
r AS (SELECT item_id, len(i) <> 1 AND len(i) <> len(b) AS ambiguous, CASE WHEN len(i) = 1 THEN [b] WHEN len(i) = len(b) THEN list_transform(b, lambda x: [x])
  ELSE list_transform(range(1, len(i) + 1), lambda k: CASE WHEN k = 1 THEN b[1:1] WHEN k = len(i) THEN b[2:] ELSE b[1:0] END) END AS reading FROM g)
SELECT DISTINCT item_id, ambiguous, array_to_string(list_transform(reading, lambda x: array_to_string(x, ',')), '|') AS reading,
  concat_ws(',', CASE WHEN len(list_filter(reading, lambda x: len(x) = 0)) > 0 THEN 'empty_input' END, CASE WHEN len(list_filter(reading, lambda x: len(x) <> len(list_distinct(x)))) > 0 THEN 'duplicate_value' END) AS violations FROM r""",
    "reconcile_sides": """WITH dr AS (SELECT lower(raw) AS key, coalesce(iri, '') AS iri, CASE WHEN suspect THEN 0.55 ELSE 0.72 END AS c, value_id AS ord FROM gold_values WHERE raw IS NOT NULL AND trim(raw) <> ''),
mr AS (SELECT lower(label) AS key, coalesce(iri, '') AS iri, coalesce(score, 50.0) / 100.0 AS c, proposal_id AS ord FROM label_proposals WHERE label IS NOT NULL AND trim(label) <> ''),
d AS (SELECT key, iri, arg_max(c, ord) AS c, min(ord) AS pos FROM dr GROUP BY ALL), m AS (SELECT key, iri, arg_max(c, ord) AS c, min(ord) AS pos FROM mr GROUP BY ALL),
b AS (SELECT d.key, d.iri, d.c AS dc, m.c AS mc FROM d JOIN m USING (key, iri)), od AS (SELECT * FROM d ANTI JOIN m USING (key, iri)), om AS (SELECT * FROM m ANTI JOIN d USING (key, iri)),
bd AS (SELECT od.key, od.c AS dc, f.c AS mc, f.iri FROM od JOIN (SELECT key, arg_min(iri, pos) AS iri, arg_min(c, pos) AS c FROM om GROUP BY key) f USING (key) WHERE od.iri = ''),
lm AS (SELECT * FROM om ANTI JOIN bd USING (key, iri)), ld AS (SELECT * FROM od WHERE NOT (iri = '' AND key IN (SELECT key FROM bd))),
bm AS (SELECT lm.key, lm.c AS mc, f.c AS dc, f.iri FROM lm JOIN (SELECT key, arg_min(iri, pos) AS iri, arg_min(c, pos) AS c FROM ld GROUP BY key) f USING (key) WHERE lm.iri = ''),
x AS (SELECT key, iri, dc, mc FROM b UNION ALL SELECT key, iri, dc, mc FROM bd UNION ALL SELECT key, iri, dc, mc FROM bm)
SELECT 'both_agree' AS category, key, iri, least(1.0::DOUBLE, greatest(dc, mc)::DOUBLE + 0.05::DOUBLE * (1.0::DOUBLE - greatest(dc, mc)::DOUBLE)) AS confidence, 'reconciled' AS source FROM x
UNION ALL SELECT 'dictionary_only', key, iri, c::DOUBLE, 'dictionary' FROM (SELECT * FROM ld ANTI JOIN bm USING (key, iri)) WHERE c >= 0.6
UNION ALL SELECT 'model_only', key, iri, c::DOUBLE, 'model' FROM lm WHERE NOT (iri = '' AND key IN (SELECT key FROM bm))""",
    "miss_clusters": f"""WITH {_SCORES}, lf AS (SELECT item_id, leaf FROM latest WHERE n = 1), miss AS (SELECT item_id, unnest(list_filter(gold, lambda g: NOT list_contains(answers, g))) AS iri FROM scores),
e AS (SELECT DISTINCT iri AS c, unnest(parent_iris) AS p FROM concepts), kin AS (SELECT c AS iri, p AS other FROM e UNION SELECT p, c FROM e),
near AS (SELECT DISTINCT m.item_id, m.iri FROM miss m JOIN kin USING (iri) JOIN ranked r ON r.item_id = m.item_id AND r.iri = kin.other),
s AS (SELECT m.item_id, m.iri, r.rank, n.iri IS NOT NULL AS neighbor, c.iri IS NOT NULL AND lower(l.leaf) = lower(c.label) AS exact, CASE WHEN c.iri IS NULL THEN 0 ELSE len(list_intersect({sql_content('l.leaf')}, {sql_content('c.label')})) END AS shared
  FROM miss m JOIN lf l USING (item_id) LEFT JOIN ranked r ON r.item_id = m.item_id AND r.iri = m.iri LEFT JOIN near n ON n.item_id = m.item_id AND n.iri = m.iri LEFT JOIN concepts c ON c.iri = m.iri),
k AS (SELECT CASE WHEN rank IS NOT NULL THEN 'ranked_below_cutoff' WHEN coalesce(exact, false) THEN 'normalization' WHEN neighbor THEN 'hierarchy_near_miss' WHEN shared = 0 THEN 'synonymy' ELSE 'candidate_gap_unreachable' END AS cluster FROM s)
SELECT cluster, CASE WHEN cluster = 'ranked_below_cutoff' THEN cluster ELSE 'candidate_gap_unreachable' END AS reachability, count(*) AS misses FROM k GROUP BY cluster""",
    "merge_cells": f"""WITH c AS (SELECT {_KEY.format(x='raw')} AS key, iri, suspect FROM gold_values WHERE raw IS NOT NULL)
SELECT key, count(*) AS cells, count(DISTINCT iri) > 1 AS inconsistent, coalesce(string_agg(DISTINCT iri, '|' ORDER BY iri), '') AS answers, CASE WHEN bool_or(coalesce(suspect, false)) THEN 'suspect' ELSE '' END AS flags
FROM c WHERE key NOT IN ({", ".join(f"'{w}'" for w in normalize.NON_REFERENTIAL)}) GROUP BY key""",
    "display_segments": f"""WITH {_SPANS}, d AS (SELECT doc_id, length(text) AS n FROM documents WHERE length(text) > 0),
s AS (SELECT doc_id, start || ':' || "end" || ':' || iri AS id, start, "end" AS e, iri, CASE WHEN kind = 'preferred' THEN 0.72 ELSE 0.55 END AS c FROM spans),
p AS (SELECT doc_id, 0 AS p FROM d UNION SELECT doc_id, n FROM d UNION SELECT doc_id, start FROM s UNION SELECT doc_id, e FROM s), cuts AS (SELECT doc_id, p AS a, lead(p) OVER (PARTITION BY doc_id ORDER BY p) AS z FROM p),
best AS (SELECT cuts.doc_id, a, z, s.iri, min({{'c': -s.c, 'id': s.id}}) AS b FROM cuts JOIN s ON s.doc_id = cuts.doc_id AND s.start <= a AND s.e >= z WHERE z IS NOT NULL GROUP BY ALL),
ids AS (SELECT doc_id, a, z, string_agg(b.id, '|' ORDER BY b) AS ids FROM best GROUP BY ALL)
SELECT doc_id, CAST(a AS INTEGER) AS start, CAST(z AS INTEGER) AS "end", coalesce(ids, '') AS ids FROM cuts LEFT JOIN ids USING (doc_id, a, z) WHERE z IS NOT NULL""",
    "label_ladder": f"""WITH v AS (SELECT DISTINCT raw AS value FROM gold_values WHERE raw IS NOT NULL), f AS (SELECT value, {_BLANKS.format(x='value')} AS s FROM v),
c AS (SELECT value, contains(s, ':') AS has, trim(regexp_extract(s, '([^:]*)$', 1)) AS last, trim(regexp_replace(s, '^[^:]*:', '')) AS first, nullif(trim(split_part(s, ':', 1)), '') AS bucket FROM f),
t AS (SELECT value, 0 AS p, 'plain' AS parse, value AS t FROM c WHERE NOT has OR (last = '' AND first = '') UNION ALL SELECT value, 0, 'rhs_last', CASE WHEN last <> '' THEN last ELSE first END FROM c WHERE has AND (last <> '' OR first <> '')
  UNION ALL SELECT value, 1, 'rhs_first', first FROM c WHERE has AND last <> '' AND first <> '' AND first <> last UNION ALL SELECT value, 2, 'whole', value FROM c WHERE has AND (last <> '' OR first <> '') UNION ALL SELECT value, 3, 'bucket', bucket FROM c WHERE has AND bucket IS NOT NULL AND (last <> '' OR first <> '')),
n AS (SELECT value, p, parse, lower(t) AS low, {_KEY.format(x='t')} AS key, {_PLURALS} AS more FROM (SELECT *, {_NORMAL.format(x='t')} AS nt FROM t)),
asks AS (SELECT value, p, parse, unnest([0, 1, 2, 3]) AS o, unnest(['exact_preferred', 'exact_alternative', 'normalized_preferred', 'normalized_alternative']) AS rung, unnest([low, low, key, key]) AS name FROM n
  UNION ALL SELECT value, p, parse, 2 + 2 * i + x, CASE x WHEN 0 THEN 'normalized_preferred' ELSE 'normalized_alternative' END, lower(m) FROM (SELECT value, p, parse, unnest(more) AS m, generate_subscripts(more, 1) AS i FROM n), (SELECT unnest([0, 1]) AS x)),
names AS (SELECT iri, 'preferred' AS tier, preferred_label AS name FROM concepts UNION SELECT iri, 'preferred', label FROM concepts UNION SELECT iri, 'alternative', unnest(alternative_labels) FROM concepts),
rungs AS (SELECT rung, name, min(iri) AS iri, count(DISTINCT iri) AS hits FROM (SELECT 'exact_' || tier AS rung, lower(name) AS name, iri FROM names WHERE trim(name) <> '' UNION ALL SELECT 'normalized_' || tier, {_KEY.format(x='name')}, iri FROM names WHERE trim(name) <> '') GROUP BY ALL),
hit AS (SELECT a.*, r.iri, r.hits FROM asks a JOIN rungs r USING (rung, name)), best AS (SELECT * FROM hit QUALIFY row_number() OVER (PARTITION BY value ORDER BY p, o) = 1)
SELECT value, iri, CASE WHEN iri IS NULL THEN 'unresolved' WHEN o >= 4 THEN 'lemma_variant' ELSE rung END AS rung, coalesce(hits > 1, false) AS ambiguous, coalesce(parse, 'unresolved') AS parse FROM v LEFT JOIN best USING (value)""",
    "forward_fill": """WITH o AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END AS l1, CASE WHEN o_totalprice > 200000 THEN 'P' || o_orderpriority END AS l2, CASE WHEN o_orderstatus <> 'F' THEN CAST(o_orderkey AS VARCHAR) END AS l3 FROM orders),
p AS (SELECT *, l1 IS NOT NULL AND l2 IS NULL AS opens FROM o), q AS (SELECT *, sum(opens::INT) OVER w AS part, last_value(CASE WHEN opens THEN l1 END IGNORE NULLS) OVER w AS head1 FROM p WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING))
SELECT o_orderkey, head1, last_value(l2 IGNORE NULLS) OVER (PARTITION BY o_custkey, part ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS head2, CASE WHEN opens THEN 'level1' WHEN l3 IS NOT NULL THEN 'item' WHEN l2 IS NOT NULL THEN 'level2' ELSE 'continuation' END AS role FROM q""",
    "split_frozen_tune": f"""WITH l AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY loaded_at DESC, coalesce(array_to_string(ancestor_path, '|'), '') DESC, coalesce(stratum_id, '') DESC) AS n FROM gold_rows WHERE NOT blank),
i AS (SELECT item_id, firm, upper(trim(coalesce(stratum_id, ''))) AS stratum_id, lower(coalesce(ancestor_path[2], '')) AS group_id, lower(coalesce(leaf, '')) AS surface, flags FROM l WHERE n = 1),
own AS (SELECT * FROM i WHERE firm = 'firm1'), g AS (SELECT stratum_id, group_id, count(*) AS size, bool_and(NOT list_has_any(coalesce(flags, []), {list(gold.FROZEN_EXCLUDED)!r})) AS ok FROM own GROUP BY ALL),
s AS (SELECT stratum_id, sum(size) AS total, CASE WHEN sum(size) >= 15 THEN floor(sum(size) * 0.2 + 0.5) ELSE 0 END AS target FROM g GROUP BY stratum_id),
r AS (SELECT stratum_id, group_id, sum(size) OVER (PARTITION BY stratum_id ORDER BY md5('1|' || stratum_id || '|' || group_id), group_id ROWS UNBOUNDED PRECEDING) AS run FROM g WHERE ok),
d AS (SELECT stratum_id, group_id FROM r JOIN s USING (stratum_id) WHERE run <= target), m AS (SELECT own.*, d.group_id IS NOT NULL AS frozen FROM own LEFT JOIN d USING (stratum_id, group_id)),
t AS (SELECT DISTINCT surface FROM m WHERE NOT frozen)
SELECT item_id, CASE WHEN NOT frozen THEN 'tune' WHEN surface IN (SELECT surface FROM t) THEN 'excluded' ELSE 'frozen' END AS slice FROM m UNION ALL SELECT item_id, 'signal' FROM i WHERE firm = 'firm2'""",
    "variant_stats": """WITH v AS (SELECT item_id, iri, origin FROM gold_values WHERE item_id IS NOT NULL AND iri IS NOT NULL), x AS (SELECT item_id, iri, 'as_is' AS variant, true AS k FROM v UNION ALL SELECT item_id, iri, 'own_only', coalesce(origin = 'own', false) FROM v UNION ALL SELECT item_id, iri, 'no_level2', coalesce(origin <> 'inherited_level2', false) FROM v),
s AS (SELECT item_id, variant, count(DISTINCT iri) FILTER (k) AS n FROM x GROUP BY ALL), b AS (SELECT variant, count(*) AS items, count_if(n > 0) AS scored, sum(n) AS iris FROM s GROUP BY variant), u AS (SELECT variant, count(DISTINCT iri) AS distinct_iris FROM x WHERE k GROUP BY variant)
SELECT variant, items, scored, items - scored AS blank, iris, coalesce(distinct_iris, 0) AS distinct_iris, coalesce(iris::DOUBLE / nullif(scored, 0), 0) AS mean_size, (SELECT iris FROM b WHERE variant = 'as_is') - iris AS dropped FROM b LEFT JOIN u USING (variant)""",
    "vote_fold": """WITH v AS (SELECT user_id AS item_id, event_type AS g, CASE WHEN event_type = 'view' THEN 'a' ELSE 'b' END AS fam, json_extract_string(props, '$.k') AS iri, event_id % 10 / 10.0 AS conf FROM events WHERE event_type IN ('view', 'click', 'error')),
c AS (SELECT item_id, count(DISTINCT g) AS graders, count(DISTINCT fam) AS fams FROM v GROUP BY item_id), p AS (SELECT item_id, iri, count(DISTINCT g) AS n FROM v WHERE iri IS NOT NULL AND conf >= 0.5 GROUP BY ALL),
l AS (SELECT item_id, coalesce(string_agg(iri, ',' ORDER BY iri) FILTER (n >= 2), '') AS agreed, coalesce(string_agg(iri, ',' ORDER BY iri) FILTER (n = 1), '') AS singletons FROM p GROUP BY item_id)
SELECT item_id, CASE WHEN graders = 3 AND fams >= 2 THEN coalesce(agreed, '') ELSE '' END AS agreed, coalesce(singletons, '') AS singletons, CASE WHEN graders = 3 AND fams >= 2 AND coalesce(agreed, '') <> '' THEN 'deterministic' WHEN graders = 3 AND fams >= 2 THEN 'needs_review' ELSE 'incomplete' END AS status FROM c LEFT JOIN l USING (item_id)""",
    "vote_floor": """WITH p AS (SELECT score / 100 AS c, iri IS NOT NULL AS a FROM label_proposals WHERE score IS NOT NULL), t AS (SELECT DISTINCT c AS floor FROM p UNION SELECT 0.0 UNION SELECT 1.0)
SELECT floor, agreement FROM (SELECT floor, count_if((c >= floor) = a) AS agreement FROM t, p GROUP BY floor) ORDER BY agreement DESC, floor LIMIT 1""",
    "consolidate_claims": "SELECT item_id AS row_id, sheet_column AS field, CASE WHEN count(DISTINCT iri) > 1 THEN 'collision' ELSE 'agreement' END AS status, CAST(count(DISTINCT iri) AS INTEGER) AS n_values, count(DISTINCT origin) AS sittings FROM gold_values WHERE item_id IS NOT NULL AND iri IS NOT NULL GROUP BY ALL",
    "decision_fold": f"""WITH {_GOLD}, v AS (SELECT DISTINCT value_id, item_id FROM gold_values WHERE item_id IS NOT NULL), p AS (SELECT item_id, iri, arg_max(CASE WHEN coalesce(score, 0) >= 75 THEN 'gold' ELSE 'not_gold' END, proposal_id) AS x FROM label_proposals JOIN v USING (value_id) WHERE iri IS NOT NULL GROUP BY ALL),
s AS (SELECT item_id, coalesce(list(iri) FILTER (x = 'gold'), []) AS plus, coalesce(list(iri) FILTER (x <> 'gold'), []) AS minus FROM p GROUP BY item_id),
f AS (SELECT item_id, gold, list_sort(list_distinct(list_concat(list_filter(gold, lambda g: NOT list_contains(coalesce(minus, []), g)), coalesce(plus, [])))) AS after FROM gold LEFT JOIN s USING (item_id))
SELECT item_id, CAST(len(gold) AS INTEGER) AS n_before, CAST(len(after) AS INTEGER) AS n_after, gold <> after AS changed FROM f""",
    "snapshot_diff": """WITH c AS (SELECT DISTINCT item_id, iri, config_version AS v FROM ranked_candidates WHERE item_id IS NOT NULL AND iri IS NOT NULL AND config_version IN (1, 2)), x AS (SELECT item_id, iri, bool_or(v = 1) AS a, bool_or(v = 2) AS b FROM c GROUP BY ALL)
SELECT item_id AS key, CAST(count_if(a AND NOT b) AS INTEGER) AS n_missing, CAST(count_if(b AND NOT a) AS INTEGER) AS n_added, count_if(a AND NOT b) > 0 AS blocking FROM x GROUP BY item_id""",
    "quota_fill": "SELECT doc_type, 100 AS target, count(*) AS got, count(*) / 100.0::DOUBLE AS share FROM documents WHERE doc_type IS NOT NULL GROUP BY doc_type",
    "run_status": """WITH l AS (SELECT user_id, event_id, event_type, sum((event_type = 'signup')::INT) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS w FROM events), m AS (SELECT *, max(w) OVER (PARTITION BY user_id) AS mx FROM l)
SELECT user_id, count(*) AS attempts, count_if(event_type = 'purchase') AS keep, count_if(event_type = 'error') AS revert, count_if(event_type NOT IN ('purchase', 'error')) AS park, count(*) % 3 = 0 AS check_in FROM m WHERE w = mx AND event_type <> 'signup' GROUP BY user_id""",
    "sittings": "SELECT proposal_id, CAST((row_number() OVER (PARTITION BY method ORDER BY coalesce(score, 0) DESC, proposal_id) - 1) // 25 AS INTEGER) AS batch FROM label_proposals",
    "semantic_topk": """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), s AS (SELECT q.vec_id AS query_id, e.vec_id, round(list_cosine_similarity(q.v, e.v), 9) AS c FROM e q JOIN e ON true WHERE q.vec_id % 20 = 0)
SELECT query_id, vec_id, CAST(place AS INTEGER) AS place, round(c, 5) AS cosine FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, vec_id) AS place FROM s) WHERE place <= 10""",
    "hashing_embedding": """WITH t AS (SELECT iri, unnest(list_filter(list_transform(regexp_extract_all(concat_ws(': ', label, definition), '[a-zA-Z]+'), lambda w: lower(w)), lambda w: length(w) >= 2)) AS w FROM concepts),
n AS (SELECT iri, CAST('0x' || right(md5(w), 2) AS INTEGER) AS bucket, count(*) AS n FROM t GROUP BY ALL), m AS (SELECT iri, sqrt(sum(n * n)) AS norm FROM n GROUP BY iri) SELECT iri, bucket, round(n / norm, 9) AS weight FROM n JOIN m USING (iri)""",
}

SQL["grid_choice"] = f"SELECT * FROM ({SQL['grid_search']}) ORDER BY f1 DESC, k, threshold DESC LIMIT 1"
SQL["split_checks"] = f"""WITH sp AS (SELECT * FROM ({SQL['split_frozen_tune']})), l AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY loaded_at DESC, coalesce(array_to_string(ancestor_path, '|'), '') DESC, coalesce(stratum_id, '') DESC) AS n FROM gold_rows WHERE NOT blank),
i AS (SELECT item_id, upper(trim(coalesce(stratum_id, ''))) AS stratum_id, lower(coalesce(ancestor_path[2], '')) AS group_id, lower(coalesce(leaf, '')) AS surface FROM l WHERE n = 1), j AS (SELECT * FROM sp JOIN i USING (item_id) WHERE slice IN ('tune', 'frozen'))
SELECT 'two_slices' AS rule, count(*) AS n FROM (SELECT item_id FROM sp GROUP BY item_id HAVING count(DISTINCT slice) > 1) UNION ALL SELECT 'shared_surface', count(*) FROM (SELECT surface FROM j GROUP BY surface HAVING count(DISTINCT slice) > 1)
UNION ALL SELECT 'straddling_group', count(*) FROM (SELECT stratum_id, group_id FROM j GROUP BY ALL HAVING count(DISTINCT slice) > 1)"""

QUERIES = {
    f.__name__: f
    for f in (
        answer_ranking, answer_commit, micro_scores, near_misses, miss_clusters, calibration_samples, calibration_fit, grid_search, grid_choice, run_comparison, changed_items, reconcile_sides,
        judge_enforcement, judge_answers, feedback_insights, top_downvoted, recent_feedback, display_segments, forward_fill, pair_blocks, label_ladder, merge_cells, split_frozen_tune, split_checks,
        variant_stats, vote_fold, vote_floor, consolidate_claims, decision_fold, snapshot_diff, quota_fill, run_status, sittings, semantic_topk, hashing_embedding,
    )
}
