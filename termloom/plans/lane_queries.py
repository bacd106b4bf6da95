"""Queries of gold resolution, identifiers, proposals, subject tags, the document lane, prompts and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.functions import ids
from termloom.operators import audit, documents, evaluate, gold, prior, proposals
from termloom.operators.catalog import ConceptCatalog
from termloom.plans import evaluation_queries as E
from termloom.plans import pipeline
from termloom.functions.scoring import sql_strip
from termloom.functions.text import ANALYSIS_STOPWORDS as text_stop
from termloom.plans.resolution_queries import _LABELS, _RULER_STOP, _SPANS, _decompose_sql, _place, _short
from termloom.runtime import table

BASE, LEGACY, PREFIXES = "https://vocab.lexifold.example/", ["http://vocab.lexifold.example/", "http://old.lexifold.example/", "lxf:"], ["lxf", "rel"]


def _rows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "gold_rows").filter("item_id is not null")


def gold_ids(spark, d):
    r = _rows(spark, d).select("item_id", "firm", "stratum", "ancestor_path", "leaf").distinct()
    c = F.col
    return r.select(
        "item_id", ids.item_id(c("firm"), c("stratum"), c("ancestor_path"), c("leaf")).alias("key"), ids.stratum_id(c("firm"), c("stratum")).alias("stratum_key"), ids.family_id(c("firm"), F.slice("ancestor_path", 1, 2)).alias("family_key"),
        ids.group_id(F.lit(None).cast("string"), c("firm"), c("stratum"), c("ancestor_path")).alias("group_key"), ids.input_text(c("ancestor_path"), c("leaf")).alias("input"), ids.digest(c("item_id"), F.coalesce("leaf", F.lit(""))).alias("short"),
    ).distinct()


def rejection_keys(spark, d):
    r = _rows(spark, d).filter("size(gold_iris) > 0")
    return r.select(ids.rejection_key(F.col("item_id"), F.col("gold_iris")).alias("rejection_key")).distinct()


def resolved_cells(spark, d):
    v = table(spark, d, "gold_values").select(F.col("raw").alias("value"))
    return gold.resolve_cells(v, table(spark, d, "concepts"), BASE, LEGACY, PREFIXES)


def resolved_items(spark, d):
    cells = gold.resolve_cells(table(spark, d, "gold_values").select(F.col("raw").alias("value")), table(spark, d, "concepts"), BASE, LEGACY, PREFIXES)
    v = table(spark, d, "gold_values").filter("item_id is not null").select("item_id", F.col("raw").alias("value"))
    return gold.resolve_items(v, cells).select("item_id", F.size("iris").alias("n_iris"), F.array_join("iris", "|").alias("iris"), F.array_join("rules", "|").alias("rules"), "blank")


def query_variants(spark, d):
    t = table(spark, d, "gold_rows").filter("leaf is not null").select("leaf").distinct()
    return t.select("leaf", F.posexplode(proposals.query_variants(F.col("leaf"))).alias("pos", "variant"))


def noun_phrases(spark, d):
    t = table(spark, d, "gold_rows").filter("leaf is not null").select("leaf").distinct()
    return t.select("leaf", F.posexplode(proposals.noun_phrases(F.col("leaf"))).alias("pos", "phrase"))


def _open_labels(spark, d):
    return table(spark, d, "label_proposals").filter("iri is null and label is not null").select("label").distinct()


def containment_proposals(spark, d):
    return proposals.containment(_open_labels(spark, d), table(spark, d, "concepts"))


def concept_proposals(spark, d):
    return proposals.proposed(_open_labels(spark, d), table(spark, d, "concepts"))


def _tag_log(spark, d):
    e = table(spark, d, "events")
    action = F.when(F.col("event_type") == "view", "suggest").when(F.col("event_type") == "click", "validate").when(F.col("event_type") == "error", "invalidate").when(F.col("event_type") == "signup", "add").otherwise("manifest")
    k = F.get_json_object("props", "$.k")
    return e.select((F.col("user_id") % 7).alias("corpus"), F.col("event_id").alias("seq"), action.alias("action"), k.alias("iri"), F.concat(F.lit("L"), k).alias("label"), F.col("value").alias("confidence"))


def subject_tags(spark, d):
    return prior.fold_tags(_tag_log(spark, d)).select("corpus", "iri", "label", "confidence", "status", "source")


def judge_context(spark, d):
    return prior.judge_context(prior.fold_tags(_tag_log(spark, d)))


def document_adapter(spark, d):
    c = table(spark, d, "concepts")
    block = c.filter("branch = 'Forum'").select(F.lower("label").alias("surface_term"), F.col("iri").alias("blocked_iri"), F.lit(None).cast("string").alias("domain"))
    return documents.adapt(table(spark, d, "documents"), ConceptCatalog(c), blocklist=block, phrases=False).select("doc_id", "iri", "score", "surface", "outcome")


def document_suppression(spark, d):
    c = table(spark, d, "concepts")
    return documents.suppression(documents.adapt(table(spark, d, "documents"), ConceptCatalog(c), phrases=False))


def surface_hits(spark, d):
    return documents.surfaces_in(table(spark, d, "documents"), table(spark, d, "concepts").select(F.col("label").alias("surface")))


def scan_recall(spark, d):
    labels = ConceptCatalog(table(spark, d, "concepts")).labels
    return documents.scan_recall(documents.label_samples(labels, {"preferred": 300, "alternative": 200, "punctuated": 150}), labels)


def variant_replay(spark, d):
    answers = evaluate.item_scores(E._gold(spark, d), E._ranked(spark, d), E.THRESHOLD, E.K).select("item_id", "answers")
    sets = audit.variant_sets(table(spark, d, "gold_values").filter("item_id is not null"))
    return evaluate.replay(answers, sets, ["variant"])


def grid_frontier(spark, d):
    g = E.grid_search(spark, d)
    return evaluate.frontier(g, evaluate.best_point(g))


def misses_by_firm(spark, d):
    m = E._misses(spark, d).join(E._gold(spark, d).select("item_id", "firm"), "item_id")
    return m.groupBy("firm", "cluster").agg(F.count(F.lit(1)).alias("misses"))


def judge_prompts(spark, d):
    ranked = E._ranked(spark, d).filter("rank <= 5").join(table(spark, d, "concepts").select("iri", "label"), "iri").select(F.col("item_id").alias("query_id"), F.col("rank").alias("place"), "iri", "label", "score")
    t = E._gold(spark, d).select(F.col("item_id").alias("query_id"), F.col("leaf").alias("text"), F.col("firm").alias("document_type"))
    p = pipeline.judge_prompts(ranked, t)
    return p.select("query_id", F.sha2("system", 256).alias("system"), "user")


def rerank_prompts(spark, d):
    c = table(spark, d, "concepts")
    ranked = E._ranked(spark, d).filter("rank <= 5").join(c.select("iri", "label"), "iri").select(F.col("item_id").alias("query_id"), F.col("rank").alias("place"), "iri", "label", "score")
    t = E._gold(spark, d).select(F.col("item_id").alias("query_id"), F.col("leaf").alias("text"))
    return pipeline.rerank_prompts(ranked, t, c)


def concept_parents(spark, d):
    c = ConceptCatalog(table(spark, d, "concepts"))
    return c.parents_of(table(spark, d, "ranked_candidates").select("iri").distinct())


def concept_lookup(spark, d):
    c = ConceptCatalog(table(spark, d, "concepts"))
    return c.get(table(spark, d, "gold_values").select("iri")).select("iri", "label", "branch")


def candidate_similarity(spark, d):
    from termloom.operators.embedding import score_candidates

    e = table(spark, d, "embeddings")
    asked = e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding", F.explode(F.sequence(F.col("vec_id"), F.col("vec_id") + 30)).alias("candidate"))
    s = score_candidates(asked, e.select(F.col("vec_id").alias("candidate"), F.col("embedding").alias("vector")), "candidate")
    return s.select("query_id", "candidate", F.round("cosine", 6).alias("cosine"))


def split_summary(spark, d):
    items = E._split_items(spark, d)
    return gold.split_summary(items, gold.evaluation_splits(items))


def label_frequency(spark, d):
    from termloom.functions.normalize import label_key

    return _rows(spark, d).filter("leaf is not null").select("item_id", label_key(F.col("leaf")).alias("key")).distinct().groupBy("key").agg(F.count(F.lit(1)).alias("items"))


def strata_with_gold(spark, d):
    return _rows(spark, d).filter("not coalesce(blank, false) and size(gold_iris) > 0").select("stratum_id").distinct()


def suppressed_proposals(spark, d):
    """Proposals of concepts per value; those that score below 50 count as rejected, and values that propose just the same set again are held back."""
    p = table(spark, d, "label_proposals").filter("iri is not null and value_id is not null")
    sets = p.groupBy(F.col("value_id").cast("string").alias("item_id"), "method").agg(F.array_sort(F.collect_set("iri")).alias("iris"), F.max(F.coalesce("score", F.lit(0.0))).alias("score"))
    decisions = sets.filter("score < 50").select("item_id", F.lit("reject").alias("action"), "iris", F.lit("h").alias("catalog_hash"))
    return audit.suppress(sets.select("item_id", "method", "iris"), audit.rejection_memory(decisions, "h")).select("item_id", "method", F.array_join("iris", "|").alias("iris"))


def outcome_diff(spark, d):
    e = table(spark, d, "events")
    run = lambda odd: e.filter(F.col("event_id") % 2 == odd).groupBy(F.col("user_id").cast("string").alias("test")).agg(F.max_by("event_type", "event_id").alias("t")).select("test", F.when(F.col("t").isin("view", "click"), "passed").when(F.col("t") == "error", "error").otherwise("failed").alias("outcome"))
    return audit.outcome_diff(run(0), run(1))


def vote_reasons(spark, d):
    e = table(spark, d, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    v = e.select((F.col("user_id") % 50).alias("item_id"), F.col("event_type").alias("grader_id"), F.when(k > 10, k.cast("string")).alias("iri"), F.when(k == 1, "ambiguous_label").when(k == 2, "unresolved_label").alias("issue"), (F.col("event_id") % 10 / 10.0).alias("confidence"))
    return audit.vote_reasons(v.filter(F.col("item_id") * 7 % 5 + F.length("grader_id") < 10), 0.5)


def audit_sample(spark, d):
    return audit.sample_for_audit(E._gold(spark, d).select("item_id"), 25, "7")


def stack_scores(spark, d):
    answers = evaluate.item_scores(E._gold(spark, d), E._ranked(spark, d), E.THRESHOLD, E.K)
    blank = table(spark, d, "gold_rows").filter("blank and item_id is not null").select("item_id").distinct().join(answers.select("item_id"), "item_id", "left_anti").select("item_id", F.array().cast("array<string>").alias("gold"))
    top = E._ranked(spark, d).filter("rank <= 1").select("item_id", F.array("iri").alias("iris"))
    items = answers.select("item_id", "gold").unionByName(blank)
    return audit.stack_scores(items, items.select("item_id").join(top, "item_id", "left"))


def label_lemmas(spark, d):
    lemma = lambda w: F.when(F.endswith(w, F.lit("ies")), F.concat(F.expr("left(label_key, length(label_key) - 3)"), F.lit("y"))).when(F.endswith(w, F.lit("s")) & ~F.endswith(w, F.lit("ss")), F.expr("left(label_key, length(label_key) - 1)")).otherwise(w)
    words = table(spark, d, "concepts").select("iri", F.element_at(F.split("label", " "), -1).alias("label"), F.lit(None).cast("string").alias("definition"), F.array().cast("array<string>").alias("alternative_labels"), F.lit(None).cast("string").alias("preferred_label"), "branch", "parent_iris")
    return ConceptCatalog(words).lemmas(lemma, ["claims", "notice"])


def exact_case_scan(spark, d):
    from termloom.operators import scan

    docs = table(spark, d, "documents")
    spans = scan.scan(docs, table(spark, d, "concepts").select(F.col("label").alias("pattern"), "iri"))
    return scan.same_case(spans, docs).select("doc_id", "start", "end", scan.pattern_id(F.col("iri"), F.lit("preferred")).alias("pattern_id"))


def nonlexical_share(spark, d):
    """How many gold concepts of the catalog an item's text doesn't name."""
    g = table(spark, d, "gold_rows").filter("item_id is not null and input_text is not null").select("item_id", "input_text", F.explode("gold_iris").alias("iri")).distinct().join(table(spark, d, "concepts").select("iri", "label"), "iri")
    return g.agg(F.count(F.lit(1)).alias("concepts"), F.count_if(~F.contains("input_text", F.col("label"))).alias("not_named"))


def reconcile_triage(spark, d):
    from termloom.operators import embedding, reconcile

    v = table(spark, d, "gold_values").filter("raw is not null and trim(raw) <> ''").join(table(spark, d, "concepts").select("iri", "label", "definition"), "iri", "left")
    v = v.select(F.col("raw").alias("text"), "iri", "label", "definition", F.when(F.col("suspect"), 0.55).otherwise(0.72).alias("confidence"), F.col("value_id").alias("ord"))
    p = table(spark, d, "label_proposals").filter("label is not null and trim(label) <> ''").withColumnRenamed("label", "raw").join(table(spark, d, "concepts").select("iri", "label", "definition"), "iri", "left")
    p = p.select(F.col("raw").alias("text"), "iri", "label", "definition", (F.coalesce("score", F.lit(50.0)) / 100.0).alias("confidence"), F.col("proposal_id").alias("ord"))
    return reconcile.reconcile_with_triage(v, p, embedding.similarity)


def match_full(spark, d):
    """The whole pipeline over every typed label: dictionary spans, label search, recall, parts of compound terms, section gate, blocklist, gates, floor."""
    c = table(spark, d, "concepts")
    q = table(spark, d, "label_proposals").filter(F.regexp_replace("label", r"[\s\p{Z}]", "") != "").groupBy(F.col("label").alias("term")).agg(F.min("method").alias("section")).withColumn("query_id", F.col("term"))
    block = c.filter("branch = 'Forum'").select(F.lower("label").alias("surface_term"), F.col("iri").alias("blocked_iri"), F.lit(None).cast("string").alias("domain"))
    return pipeline.match(q, ConceptCatalog(c), blocklist=block, with_recall=True).select("query_id", "place", "iri", "score", "path", "gated")


# -- SQL --------------------------------------------------------------------------------------------------------------------

_JL = "'[' || array_to_string(list_transform(coalesce({x}, []), lambda p: to_json(coalesce(p, ''))), ', ') || ']'"
_J = "to_json(coalesce({x}, ''))"


def _sha(parts: str, n: int) -> str:
    return f"left(sha256('[' || {parts} || ']'), {n})"


_IRI_LIKE = "(starts_with(s, '" + BASE + "') OR " + " OR ".join(f"(starts_with(s, '{p}') AND regexp_matches(substr(s, {len(p) + 1}), '^[A-Za-z0-9_.\\-]+$') AND NOT pred)" for p in LEGACY) + ")"
_CELLS = f"""raws AS (SELECT DISTINCT raw AS value FROM gold_values WHERE raw IS NOT NULL),
forms AS (SELECT value, {E._BLANKS.format(x='value')} AS s FROM raws), kinds AS (SELECT *, regexp_matches(s, '^(?:lxf|rel):[A-Za-z_][A-Za-z0-9_]*$') AND regexp_matches(regexp_extract(s, '([^:]*)$', 1), '^\\p{{Ll}}\\p{{L}}*$') AS pred FROM forms),
marked AS (SELECT *, {_IRI_LIKE} AS iri_like, regexp_matches(value, '\\?[\\s\\p{{Z}}]*$') AS suspect, regexp_replace(value, '[\\s\\p{{Z}}]*\\?[\\s\\p{{Z}}]*$', '') AS bare FROM kinds),
ruled AS (SELECT *, CASE WHEN NOT iri_like AND (regexp_matches(s, '->|-->|=>|→|⟶') OR pred) THEN 'excluded_relational' WHEN {E._KEY.format(x='value')} IN ({", ".join(f"'{w}'" for w in E.normalize.NON_REFERENTIAL)}) THEN 'excluded_non_referential_value' END AS out,
  CASE WHEN suspect THEN bare ELSE value END AS text FROM marked)"""
_LADDER = E.SQL["label_ladder"]
_CELLS_SQL = f"""{_CELLS}, asked AS (SELECT value, out, suspect, text, {E._BLANKS.format(x='text')} AS s, regexp_matches({E._BLANKS.format(x='text')}, '^(?:lxf|rel):[A-Za-z_][A-Za-z0-9_]*$') AND regexp_matches(regexp_extract({E._BLANKS.format(x='text')}, '([^:]*)$', 1), '^\\p{{Ll}}\\p{{L}}*$') AS pred FROM ruled),
typed AS (SELECT *, {_IRI_LIKE} AS is_iri FROM asked),
full_iri AS (SELECT value, CASE WHEN starts_with(s, '{BASE}') THEN s {" ".join(f"WHEN starts_with(s, '{p}') THEN '{BASE}' || substr(s, {len(p) + 1})" for p in LEGACY)} END AS f, starts_with(s, '{BASE}') AS own FROM typed WHERE is_iri AND out IS NULL),
lad AS ({_LADDER.replace("SELECT DISTINCT raw AS value FROM gold_values WHERE raw IS NOT NULL", "SELECT DISTINCT text AS value FROM typed WHERE out IS NULL AND NOT is_iri")}),
cells AS (SELECT t.value, CASE WHEN t.out IS NOT NULL THEN NULL WHEN t.is_iri THEN c.iri ELSE l.iri END AS iri, CASE WHEN t.out IS NOT NULL THEN t.out WHEN t.is_iri THEN CASE WHEN c.iri IS NULL THEN 'unresolved' WHEN f.own THEN 'iri_exact' ELSE 'legacy_iri' END ELSE l.rung END AS rung,
  CASE WHEN t.out IS NOT NULL THEN NULL WHEN t.is_iri THEN 'iri' ELSE l.parse END AS parse, t.out IS NULL AND NOT t.is_iri AND l.ambiguous AS ambiguous, t.out IS NULL AND t.suspect AS suspect
  FROM typed t LEFT JOIN full_iri f USING (value) LEFT JOIN concepts c ON c.iri = f.f LEFT JOIN lad l ON l.value = t.text AND t.out IS NULL AND NOT t.is_iri)"""

_TAGS = """log AS (SELECT user_id % 7 AS corpus, event_id AS seq, CASE event_type WHEN 'view' THEN 'suggest' WHEN 'click' THEN 'validate' WHEN 'error' THEN 'invalidate' WHEN 'signup' THEN 'add' ELSE 'manifest' END AS action, json_extract_string(props, '$.k') AS iri, value AS confidence FROM events),
made AS (SELECT corpus, iri, min(seq) AS first, arg_min(confidence, seq) AS confidence FROM log WHERE action IN ('suggest', 'add', 'manifest') GROUP BY ALL),
later AS (SELECT l.*, m.first FROM log l JOIN made m USING (corpus, iri) WHERE l.seq >= m.first AND (l.action <> 'suggest' OR l.seq = m.first)),
tags AS (SELECT m.corpus, m.iri, 'L' || m.iri AS label, m.confidence, m.first, CASE arg_max(action, seq) WHEN 'suggest' THEN 'suggested' WHEN 'validate' THEN 'validated' WHEN 'invalidate' THEN 'invalidated' ELSE 'added' END AS status,
  CASE arg_max(action, seq) FILTER (action IN ('add', 'manifest')) WHEN 'add' THEN 'human' WHEN 'manifest' THEN 'manifest' ELSE 'suggester' END AS source FROM made m JOIN later l USING (corpus, iri) GROUP BY ALL)"""

_P, _S = _place("label", "surface", "100.0::DOUBLE"), _short("label", "surface", "ps")


def _adapter(blocked: str) -> str:
    return f"""WITH {_SPANS}, c AS (SELECT DISTINCT s.doc_id, s.iri, min(s.label_key) AS surface FROM spans s WHERE length(s.label_key) >= 3 GROUP BY ALL), j AS (SELECT c.*, k.label, k.branch, {blocked} AS blocked FROM c JOIN concepts k USING (iri)),
p AS (SELECT *, {_P[0]} AS ps, {_P[1]} AS pd FROM j), s AS (SELECT *, {_S[0]} AS fs, {_S[1]} AS sd FROM p),
o AS (SELECT doc_id, iri, surface, CASE WHEN blocked THEN 'blocklist' WHEN pd AND ps < 45 THEN 'place_gate' WHEN sd AND fs < 45 THEN 'short_label_gate' WHEN fs < 45 THEN 'score_floor' ELSE 'kept' END AS outcome, fs FROM s)"""


_PROMPTS = f"""WITH {E._RANKED}, {E._GOLD}, lf AS (SELECT item_id, leaf, firm FROM latest WHERE n = 1), r AS (SELECT item_id, rank, ranked.iri, label, definition, score FROM ranked JOIN concepts c ON c.iri = ranked.iri WHERE rank <= 5)"""

SQL = {
    "gold_ids": f"""SELECT DISTINCT item_id, {_sha(f"{_J.format(x='firm')} || ', ' || {_J.format(x='stratum')} || ', ' || {_JL.format(x='ancestor_path')} || ', ' || {_J.format(x='leaf')}", 16)} AS key, left(sha256(coalesce(firm, '') || '|' || coalesce(stratum, '')), 12) AS stratum_key,
  {_sha(f"{_J.format(x='firm')} || ', ' || {_JL.format(x='ancestor_path[1:2]')}", 12)} AS family_key, {_sha(f"{_J.format(x='firm')} || ', ' || {_J.format(x='stratum')} || ', ' || {_JL.format(x='ancestor_path')}", 12)} AS group_key,
  array_to_string(list_append(coalesce(ancestor_path, []), coalesce(leaf, '')), ' > ') AS input, left(sha256(item_id || '␟' || coalesce(leaf, '')), 8) AS short FROM gold_rows WHERE item_id IS NOT NULL""",
    "rejection_keys": "SELECT DISTINCT item_id || '|' || array_to_string(list_sort(gold_iris), '|') AS rejection_key FROM gold_rows WHERE item_id IS NOT NULL AND len(gold_iris) > 0",
    "resolved_cells": f"WITH {_CELLS_SQL} SELECT value, iri, rung, parse, ambiguous, suspect FROM cells",
    "resolved_items": f"""WITH {_CELLS_SQL}, x AS (SELECT item_id, raw AS value, c.iri, c.rung, c.ambiguous, c.suspect FROM gold_values v JOIN cells c ON c.value = v.raw WHERE item_id IS NOT NULL),
items AS (SELECT DISTINCT item_id FROM gold_values WHERE item_id IS NOT NULL), r AS (SELECT item_id, rung AS rule FROM x WHERE rung LIKE 'excluded%' OR rung = 'unresolved' UNION SELECT item_id, 'ambiguous_label' FROM x WHERE ambiguous UNION SELECT item_id, 'suspect_question_mark' FROM x WHERE suspect),
i AS (SELECT item_id, CAST(count(DISTINCT iri) AS INTEGER) AS n_iris, coalesce(string_agg(DISTINCT iri, '|' ORDER BY iri), '') AS iris FROM x GROUP BY item_id), rr AS (SELECT item_id, string_agg(rule, '|' ORDER BY rule) AS rules FROM r GROUP BY item_id)
SELECT item_id, coalesce(n_iris, 0) AS n_iris, coalesce(iris, '') AS iris, coalesce(rules, '') AS rules, coalesce(n_iris, 0) = 0 AS blank FROM items LEFT JOIN i USING (item_id) LEFT JOIN rr USING (item_id)""",
    "containment_proposals": f"""WITH t AS (SELECT DISTINCT label, {E._NORMAL.format(x='label')} AS nt FROM label_proposals WHERE iri IS NULL AND label IS NOT NULL AND regexp_replace(label, '[\\s\\p{{Z}}]', '', 'g') <> ''),
n AS (SELECT DISTINCT label, lower(unnest(list_concat([nt], {E._PLURALS}))) AS needle FROM t), names AS (SELECT iri, preferred_label AS name FROM concepts UNION SELECT iri, label FROM concepts UNION SELECT iri, unnest(alternative_labels) FROM concepts),
keys AS (SELECT DISTINCT iri, {E._KEY.format(x='name')} AS key FROM names WHERE name IS NOT NULL), dk AS (SELECT DISTINCT key FROM keys WHERE key <> ''),
pr AS (SELECT label, key, max(least(length(needle), length(key))::DOUBLE / greatest(length(needle), length(key))) AS r FROM n JOIN dk ON needle <> key AND needle <> '' AND (contains(' ' || key || ' ', ' ' || needle || ' ') OR contains(' ' || needle || ' ', ' ' || key || ' ')) GROUP BY ALL),
b AS (SELECT label, iri, round(max(r) * 100, 3) AS score FROM pr JOIN keys USING (key) GROUP BY ALL)
SELECT label, iri, score, CAST(row_number() OVER (PARTITION BY label ORDER BY score DESC, iri) AS INTEGER) AS place FROM b QUALIFY place <= 5""",
    "subject_tags": f"WITH {_TAGS} SELECT corpus, iri, label, confidence, status, source FROM tags",
    "judge_context": f"WITH {_TAGS} SELECT corpus, string_agg(label, ' / ' ORDER BY first) AS context FROM tags WHERE status IN ('validated', 'added') GROUP BY corpus",
    "document_adapter": _adapter("k.branch = 'Forum' AND surface = lower(k.label)") + " SELECT doc_id, iri, CASE WHEN outcome = 'kept' THEN fs ELSE 100.0 END AS score, surface, outcome FROM o",
    "document_suppression": _adapter("false") + " SELECT outcome, count(*) AS candidates FROM o GROUP BY outcome",
    "surface_hits": "SELECT doc_id, surface FROM documents JOIN (SELECT DISTINCT label AS surface FROM concepts WHERE label <> '') ON contains(text, surface)",
    "scan_recall": f"""WITH {_LABELS}, able AS (SELECT label_key, kind AS stratum FROM labels WHERE length(label_key) >= 3 AND label_key NOT IN ({_RULER_STOP})),
m AS (SELECT * FROM able UNION ALL SELECT label_key, 'punctuated' FROM able WHERE contains(label_key, ' ') AND regexp_matches(label_key, '[^\\p{{L}}\\p{{N}}_\\s]')),
n AS (SELECT stratum, least(count(*), CASE stratum WHEN 'preferred' THEN 300 WHEN 'alternative' THEN 200 ELSE 150 END) AS samples FROM m GROUP BY stratum) SELECT stratum, samples, samples AS hits FROM n""",
    "variant_replay": f"""WITH {E._SCORES}, v AS (SELECT item_id, iri, origin FROM gold_values WHERE item_id IS NOT NULL AND iri IS NOT NULL),
x AS (SELECT item_id, iri, 'as_is' AS variant FROM v UNION SELECT item_id, iri, 'own_only' FROM v WHERE origin = 'own' UNION SELECT item_id, iri, 'no_level2' FROM v WHERE origin <> 'inherited_level2'),
g AS (SELECT item_id, variant, list(DISTINCT iri) AS g FROM x GROUP BY ALL), j AS (SELECT variant, g, coalesce(answers, []) AS a FROM g LEFT JOIN scores USING (item_id)), t AS (SELECT variant, len(g) AS ng, len(a) AS na, len(list_intersect(g, a)) AS tp FROM j)
SELECT variant, count(*) AS items, sum(ng) AS gold, sum(na) AS predicted, sum(tp) AS tp, sum(na - tp) AS fp, sum(ng - tp) AS fn, count_if(tp = ng AND tp = na) AS exact_items, count_if(na = 0) AS empty_items FROM t GROUP BY variant""",
    "grid_frontier": f"WITH g AS ({E.SQL['grid_search']}), c AS (SELECT threshold AS t, k AS kk FROM g ORDER BY f1 DESC, k, threshold DESC LIMIT 1) SELECT threshold, k, tp, fp, fn, f1 FROM g, c WHERE abs(round(threshold * 20) - round(t * 20)) <= 1 AND abs(k - kk) <= 1",
    "misses_by_firm": E.SQL["miss_clusters"].replace("k AS (SELECT CASE", "k AS (SELECT g.firm, CASE").replace("AS cluster FROM s)", "AS cluster FROM s JOIN gold g USING (item_id))").rsplit("SELECT cluster,", 1)[0] + "SELECT firm, cluster, count(*) AS misses FROM k GROUP BY ALL",
    "judge_prompts": f"""{_PROMPTS}, c AS (SELECT item_id, '[' || string_agg('{{"iri_hash":' || to_json(iri) || ',"label":' || to_json(label) || ',"score":' || CAST(score AS VARCHAR) || '}}', ',' ORDER BY rank) || ']' AS js FROM r GROUP BY item_id)
SELECT item_id AS query_id, sha256('{pipeline.JUDGE_SYSTEM}') AS system, CASE WHEN coalesce(firm, '') = '' THEN '' ELSE chr(10) || '## Document type' || chr(10) || 'This document is: ' || firm || chr(10) END || 'Input text: <user_input>' || translate(left(coalesce(leaf, ''), 10000), '<>', '  ') || '</user_input>' || chr(10) || chr(10) || 'Candidates to validate:' || chr(10) || js AS "user"
FROM c JOIN lf USING (item_id)""",
    "rerank_prompts": f"""{_PROMPTS}, c AS (SELECT item_id, '[' || string_agg('{{"iri":' || to_json(iri) || ',"label":' || to_json(label) || ',"definition":' || to_json(left(coalesce(definition, ''), 200)) || '}}', ',' ORDER BY rank) || ']' AS js FROM r GROUP BY item_id)
SELECT item_id AS query_id, '{pipeline.RERANK_SYSTEM.replace("'", "''")}' || chr(10) || 'Excerpt:' || chr(10) || left(coalesce(leaf, ''), 3000) || chr(10) || chr(10) || 'Concepts:' || chr(10) || js AS prompt FROM c JOIN lf USING (item_id)""",
    "concept_parents": "WITH e AS (SELECT DISTINCT iri AS c, unnest(parent_iris) AS p FROM concepts) SELECT c AS iri, p AS parent, k.label, CAST(row_number() OVER (PARTITION BY c ORDER BY p) AS INTEGER) AS place FROM e JOIN concepts k ON k.iri = p WHERE c IN (SELECT iri FROM ranked_candidates)",
    "concept_lookup": "SELECT iri, label, branch FROM concepts WHERE iri IN (SELECT iri FROM gold_values)",
    "candidate_similarity": "WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) SELECT q.vec_id AS query_id, e.vec_id AS candidate, round(list_cosine_similarity(q.v, e.v), 6) AS cosine FROM e q JOIN e ON e.vec_id BETWEEN q.vec_id AND q.vec_id + 30 WHERE q.vec_id % 20 = 0",
    "split_summary": f"""WITH sp AS (SELECT * FROM ({E.SQL['split_frozen_tune']})), l AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY loaded_at DESC, coalesce(array_to_string(ancestor_path, '|'), '') DESC, coalesce(stratum_id, '') DESC) AS n FROM gold_rows WHERE NOT blank),
i AS (SELECT item_id, upper(trim(coalesce(stratum_id, ''))) AS stratum_id FROM l WHERE n = 1)
SELECT stratum_id, count(*) AS items, count_if(slice = 'tune') AS tune, count_if(slice = 'frozen') AS frozen, count_if(slice = 'excluded') AS excluded, count_if(slice = 'signal') AS signal, round(coalesce(count_if(slice = 'frozen')::DOUBLE / nullif(count_if(slice <> 'signal'), 0), 0), 4) AS frozen_share FROM sp JOIN i USING (item_id) GROUP BY stratum_id""",
    "query_variants": f"""WITH leaves AS (SELECT DISTINCT leaf AS term FROM gold_rows WHERE leaf IS NOT NULL), {_decompose_sql('leaves')},
x AS (SELECT term, -2 AS o, term AS v FROM leaves UNION ALL SELECT term, -1, {E._NORMAL.format(x='term')} FROM leaves UNION ALL SELECT term, pos, part FROM split WHERE pos > 0),
y AS (SELECT term, {sql_strip('v')} AS v, min(o) AS o FROM x WHERE {sql_strip('v')} <> '' GROUP BY ALL) SELECT term AS leaf, CAST(row_number() OVER (PARTITION BY term ORDER BY o) - 1 AS INTEGER) AS pos, v AS variant FROM y""",
    "noun_phrases": f"""WITH l AS (SELECT DISTINCT leaf FROM gold_rows WHERE leaf IS NOT NULL), ch AS (SELECT leaf, unnest(cs) AS chunk, generate_subscripts(cs, 1) AS c FROM (SELECT leaf, regexp_split_to_array(regexp_replace({E._NORMAL.format(x='leaf')}, '\([^)]*\)', ' ', 'g'), '[/,;:|]+') AS cs FROM l)),
w AS (SELECT leaf, c, regexp_extract_all(chunk, '[A-Za-z][A-Za-z''&.\-]*') AS w FROM ch), stop AS (SELECT {text_stop!r} AS s),
x AS (SELECT leaf, c, 0 AS a, 0 AS i, array_to_string(w, ' ') AS phrase FROM w WHERE len(w) > 1
  UNION ALL SELECT leaf, c, 1, i, w[i] || ' ' || w[i + 1] FROM (SELECT leaf, c, w, unnest(range(1, len(w))) AS i FROM w), stop WHERE NOT list_contains(s, lower(w[i])) OR NOT list_contains(s, lower(w[i + 1]))
  UNION ALL SELECT leaf, c, 2, i, w[i] FROM (SELECT leaf, c, w, unnest(range(1, len(w) + 1)) AS i FROM w), stop WHERE NOT list_contains(s, lower(w[i])) AND length(w[i]) > 2),
y AS (SELECT leaf, phrase, min((c, a, i)) AS o FROM x GROUP BY ALL) SELECT leaf, CAST(row_number() OVER (PARTITION BY leaf ORDER BY o) - 1 AS INTEGER) AS pos, phrase FROM y""",
    "normal_forms": f"""WITH {_CELLS}, n AS (SELECT *, {E._NORMAL.format(x='value')} AS nt FROM marked), p AS (SELECT *, list_filter({E._PLURALS}, lambda m: m <> nt) AS pl FROM n)
SELECT value AS raw, translate(value, '{E.normalize.DASHES}', '{"-" * len(E.normalize.DASHES)}') AS dashes, array_to_string(list_filter(list_transform(string_split(value, '|'), lambda x: {sql_strip('x')}), lambda x: x <> ''), '|') AS pipes,
  CASE WHEN contains(s, ':') THEN nullif(trim(split_part(s, ':', 1)), '') END AS bucket, suspect AS marked, iri_like, NOT iri_like AND (regexp_matches(s, '->|-->|=>|→|⟶') OR pred) AS relational, CASE WHEN nt = '' THEN '' ELSE array_to_string(pl, '|') END AS plurals, lower(nt) AS label_key FROM p""",
    "exact_case_scan": r"""WITH hit AS (SELECT doc_id, label, iri, string_split(text, label) AS ps FROM documents JOIN concepts ON contains(text, label)), pos AS (SELECT *, unnest(range(1, len(ps))) AS k FROM hit),
spot AS (SELECT doc_id, label, iri, ps[k] AS pre, ps[k + 1] AS post, k, CAST(list_sum(list_transform(ps[1:k], lambda p: length(p))) + (k - 1) * length(label) AS INTEGER) AS start FROM pos)
SELECT doc_id, start, CAST(start + length(label) AS INTEGER) AS "end", iri || '|preferred' AS pattern_id FROM spot
WHERE NOT regexp_matches(CASE WHEN pre = '' AND k > 1 THEN right(label, 1) ELSE right(pre, 1) END, '[\p{L}\p{N}_]') AND NOT regexp_matches(left(post, 1), '[\p{L}\p{N}_]')""",
    "suppressed_proposals": """WITH s AS (SELECT CAST(value_id AS VARCHAR) AS item_id, method, list_sort(list(DISTINCT iri)) AS iris, max(coalesce(score, 0)) AS score FROM label_proposals WHERE iri IS NOT NULL AND value_id IS NOT NULL GROUP BY ALL)
SELECT item_id, method, array_to_string(iris, '|') AS iris FROM s WHERE NOT EXISTS (SELECT 1 FROM s r WHERE r.score < 50 AND r.item_id = s.item_id AND r.iris = s.iris)""",
    "outcome_diff": """WITH l AS (SELECT CAST(user_id AS VARCHAR) AS test, event_id % 2 AS odd, arg_max(event_type, event_id) AS t FROM events GROUP BY ALL), o AS (SELECT test, odd, CASE WHEN t IN ('view', 'click') THEN 'passed' WHEN t = 'error' THEN 'error' ELSE 'failed' END AS x FROM l),
j AS (SELECT coalesce(b.test, a.test) AS test, b.x AS before, a.x AS after FROM (SELECT * FROM o WHERE odd = 0) b FULL JOIN (SELECT * FROM o WHERE odd = 1) a ON a.test = b.test) SELECT test, before, after, coalesce(before = 'passed' AND after IS NOT NULL AND after <> 'passed', false) AS blocking FROM j WHERE before IS DISTINCT FROM after""",
    "vote_reasons": """WITH v AS (SELECT user_id % 50 AS item_id, event_type AS g, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, event_id % 10 / 10.0 AS conf FROM events), f AS (SELECT item_id, g, CASE WHEN k > 10 THEN k END AS iri, k, conf FROM v WHERE item_id * 7 % 5 + length(g) < 10),
c AS (SELECT item_id, g, iri, max(conf) AS conf FROM f WHERE iri IS NOT NULL GROUP BY ALL), l AS (SELECT item_id, bool_or(n >= 2 AND above < 2) AS low FROM (SELECT item_id, iri, count(*) AS n, count_if(conf >= 0.5) AS above FROM c GROUP BY ALL) GROUP BY item_id),
t AS (SELECT item_id, count(DISTINCT g) AS graders, bool_or(k = 1) AS a, bool_or(k = 2) AS u, count(iri) AS iris FROM f GROUP BY item_id)
SELECT item_id, CASE WHEN graders < 3 THEN 'missing_votes' WHEN a THEN 'ambiguous_label' WHEN u THEN 'unresolved_label' WHEN iris = 0 THEN 'empty_proposal' WHEN low THEN 'sub_floor_confidence' ELSE 'set_mismatch' END AS reason FROM t LEFT JOIN l USING (item_id)""",
    "audit_sample": f"WITH {E._GOLD} SELECT item_id FROM gold ORDER BY md5('7|' || item_id), item_id LIMIT 25",
    "stack_scores": f"""WITH {E._RANKED}, {E._GOLD}, i AS (SELECT item_id, gold AS g FROM gold UNION ALL SELECT DISTINCT item_id, CAST([] AS VARCHAR[]) FROM gold_rows WHERE blank AND item_id IS NOT NULL AND item_id NOT IN (SELECT item_id FROM gold)),
j AS (SELECT g, CASE WHEN r.iri IS NULL THEN [] ELSE [r.iri] END AS p FROM i LEFT JOIN ranked r ON r.item_id = i.item_id AND r.rank = 1), t AS (SELECT len(g) AS ng, len(p) AS np, len(list_intersect(g, p)) AS tp FROM j)
SELECT count_if(ng > 0) AS items, sum(tp) FILTER (ng > 0) AS tp, sum(np - tp) FILTER (ng > 0) AS fp, sum(ng - tp) FILTER (ng > 0) AS fn, count_if(ng > 0 AND tp = ng AND tp = np) AS exact_items, count_if(ng > 0 AND np = 0) AS empty_items,
  count_if(ng = 0) AS nomatch_items, count_if(ng = 0 AND np > 0) AS nomatch_false, round(coalesce(count_if(ng = 0 AND np > 0)::DOUBLE / nullif(count_if(ng = 0), 0), 0), 6) AS nomatch_share FROM t""",
    "label_lemmas": """WITH k AS (SELECT DISTINCT lower(regexp_extract(label, '([^ ]*)$', 1)) AS label_key FROM concepts), l AS (SELECT label_key, CASE WHEN label_key LIKE '%ies' THEN left(label_key, length(label_key) - 3) || 'y' WHEN label_key LIKE '%s' AND label_key NOT LIKE '%ss' THEN left(label_key, length(label_key) - 1) ELSE label_key END AS lemma FROM k WHERE length(label_key) > 3)
SELECT label_key, lemma FROM l WHERE lemma <> label_key AND length(lemma) > 2 AND label_key NOT IN ('claims', 'notice') AND lemma NOT IN ('claims', 'notice')""",
    "nonlexical_share": "WITH g AS (SELECT DISTINCT item_id, input_text, unnest(gold_iris) AS iri FROM gold_rows WHERE item_id IS NOT NULL AND input_text IS NOT NULL) SELECT count(*) AS concepts, count_if(NOT contains(input_text, label)) AS not_named FROM g JOIN concepts USING (iri)",
    "label_frequency": f"SELECT key, count(*) AS items FROM (SELECT DISTINCT item_id, {E._KEY.format(x='leaf')} AS key FROM gold_rows WHERE item_id IS NOT NULL AND leaf IS NOT NULL) GROUP BY key",
    "strata_with_gold": "SELECT DISTINCT stratum_id FROM gold_rows WHERE item_id IS NOT NULL AND NOT coalesce(blank, false) AND len(gold_iris) > 0",
}

QUERIES = {
    f.__name__: f
    for f in (
        gold_ids, rejection_keys, resolved_cells, resolved_items, query_variants, noun_phrases, containment_proposals, concept_proposals, subject_tags, judge_context, document_adapter, document_suppression, surface_hits, scan_recall,
        variant_replay, grid_frontier, misses_by_firm, judge_prompts, rerank_prompts, concept_parents, concept_lookup, candidate_similarity, split_summary, label_frequency, strata_with_gold,
        suppressed_proposals, outcome_diff, vote_reasons, audit_sample, stack_scores, label_lemmas, exact_case_scan, nonlexical_share, reconcile_triage, match_full,
    )
}
