"""Queries of the resolution core: text functions, searches, gates, scans, the pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.functions import gates, normalize, text
from termloom.functions.scoring import SQL_FINAL, relevance, sql_content, sql_overlap, sql_relevance, sql_strip, word_overlap
from termloom.operators import scan, search
from termloom.operators.catalog import ConceptCatalog
from termloom.plans import pipeline
from termloom.runtime import table


def _catalog(spark: SparkSession, d: str) -> ConceptCatalog:
    return ConceptCatalog(table(spark, d, "concepts"))


def _terms(spark: SparkSession, d: str) -> DataFrame:
    """Every distinct label that reviewers typed."""
    return table(spark, d, "label_proposals").filter(text.strip(F.col("label")) != "").select(F.col("label").alias("term")).distinct()


def tokenize_documents(spark, d):
    t = text.tokenize(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.size(t).alias("tokens"), F.size(F.array_distinct(t)).alias("distinct_tokens"), F.size(text.content_words(F.col("text"))).alias("content_words"))


def content_word_counts(spark, d):
    return table(spark, d, "documents").select(F.explode(text.content_words(F.col("text"))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("documents"))


def search_terms_expand(spark, d):
    return _terms(spark, d).select("term", F.posexplode(text.search_terms(F.col("term"))).alias("pos", "search_term"))


def decompose_terms(spark, d):
    t = table(spark, d, "gold_rows").filter("leaf is not null").select(F.col("leaf").alias("term")).distinct()
    return t.select("term", F.posexplode(text.decompose(F.col("term"))).alias("pos", "part"))


def phrase_windows(spark, d):
    t = table(spark, d, "gold_rows").filter("leaf is not null").select(F.col("leaf").alias("term")).distinct()
    return t.select("term", F.explode(text.phrase_windows(F.col("term"))).alias("phrase"))


def _value_pairs(spark, d):
    v = table(spark, d, "gold_values").filter("raw is not null").select("raw", "iri").distinct()
    return v.join(table(spark, d, "concepts"), "iri")


def word_overlap_pairs(spark, d):
    p = _value_pairs(spark, d)
    return p.select("raw", "iri", word_overlap(text.content_words(F.col("raw")), text.content_words(F.col("label"))).alias("overlap"))


def relevance_scores(spark, d):
    p = _value_pairs(spark, d)
    return p.select("raw", "iri", relevance(F.col("raw"), F.col("label"), F.col("definition"), F.col("alternative_labels"), F.col("preferred_label")).alias("score"))


def label_search_topk(spark, d):
    return search.label_search(_terms(spark, d), table(spark, d, "concepts"), 10).select("term", "place", "iri", "score")


def definition_search_topk(spark, d):
    return search.definition_search(_terms(spark, d), table(spark, d, "concepts"), 10).select("term", "place", "iri", "score")


def _stems(spark, d):
    c = table(spark, d, "concepts")
    return c.select(F.substring("label", F.lit(1), F.lit(5)).alias("term")).distinct()


def prefix_search(spark, d):
    return search.prefix_search(_stems(spark, d), table(spark, d, "concepts"), 50).select("term", "place", "iri")


def _gated(spark, d):
    c = table(spark, d, "concepts").select("iri", "label", "branch", F.explode("alternative_labels").alias("query"))
    n = table(spark, d, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey")).alias("iri"), F.col("n_name").alias("label"), F.lit("Location").alias("branch"), F.when(F.col("n_nationkey") % 3 == 0, F.col("n_name")).otherwise("elsewhere").alias("query"))
    both = c.unionByName(n)
    return both.withColumn("score", F.length("query") * 3.0)


def place_gate(spark, d):
    return _gated(spark, d).select("iri", "query", gates.place_gate(F.col("query"), F.col("label"), F.col("branch"), F.col("score")).alias("g")).select("iri", "query", "g.*")


def short_label_gate(spark, d):
    return _gated(spark, d).select("iri", "query", gates.short_gate(F.col("query"), F.col("label"), F.col("score")).alias("g")).select("iri", "query", "g.*")


def source_filter(spark, d):
    return table(spark, d, "documents").select("doc_id", gates.source_kind(F.col("source"), F.col("text")).alias("kind"), gates.is_taggable(F.col("source"), F.col("text")).alias("taggable"))


def alias_blocklist(spark, d):
    r = table(spark, d, "ranked_candidates").select(F.lower("label").alias("surface"), "iri", "cand_id")
    block = table(spark, d, "concepts").filter("branch = 'Forum'").select(F.col("label").alias("surface_term"), F.col("iri").alias("blocked_iri"), F.lit(None).cast("string").alias("domain"))
    return pipeline.not_blocked(r, block).groupBy("iri").agg(F.count(F.lit(1)).alias("kept"))


def dictionary_scan(spark, d):
    c = _catalog(spark, d)
    return scan.scan(table(spark, d, "documents"), c.labels.select(F.col("label_key").alias("pattern"), "iri", "kind")).select("doc_id", "start", "end", "iri", "kind")


def entity_ruler(spark, d):
    return scan.entity_ruler(table(spark, d, "documents"), _catalog(spark, d).labels).select("doc_id", "start", "end", "iri", "kind", "confidence")


def leak_scan_ngrams(spark, d):
    surfaces = table(spark, d, "concepts").select(F.col("label").alias("surface"))
    return scan.leak_scan(table(spark, d, "documents"), scan.surface_digests(surfaces, "salt"), "salt")


def match_pipeline(spark, d):
    q = _terms(spark, d).withColumn("query_id", F.col("term"))
    return pipeline.match(q, _catalog(spark, d), ruler=False).select("query_id", "place", "iri", "score", "path", "gated", "gate_reason")


def match_with_ruler(spark, d):
    q = _terms(spark, d).withColumn("query_id", F.col("term"))
    return pipeline.match(q, _catalog(spark, d)).select("query_id", "place", "iri", "score", "path")


def recall_multi_strategy(spark, d):
    return pipeline.recall(_terms(spark, d), _catalog(spark, d))


def label_resolver(spark, d):
    return pipeline.resolve_terms(_terms(spark, d), _catalog(spark, d)).select("term", "iri", "score", "surface")


def subject_suggestions(spark, d):
    g = table(spark, d, "gold_rows").filter("item_id is not null").groupBy(F.col("item_id").alias("key")).agg(F.max_by(F.struct(F.coalesce("leaf", F.lit("")).alias("title"), F.col("ancestor_path").alias("headings")), F.struct("loaded_at", F.coalesce("leaf", F.lit("")))).alias("r"))
    return pipeline.suggest_subjects(g.select("key", "r.title", "r.headings"), _catalog(spark, d)).select("key", "place", "iri", "confidence")


def label_index(spark, d):
    return _catalog(spark, d).labels


def hierarchy_hops(spark, d):
    return _catalog(spark, d).hops().groupBy("node", "relation").agg(F.count(F.lit(1)).alias("others"))


def branch_roots(spark, d):
    return _catalog(spark, d).branch_roots()


def normal_forms(spark, d):
    v = table(spark, d, "gold_values").filter("raw is not null").select("raw").distinct()
    base, legacy, prefixes = "https://vocab.lexifold.example/", ["http://vocab.lexifold.example/", "http://old.lexifold.example/", "lxf:"], ["lxf", "rel"]
    return v.select(
        "raw", normalize.fold_dashes(F.col("raw")).alias("dashes"), F.array_join(normalize.pipe_values(F.col("raw")), "|").alias("pipes"), normalize.compound(F.col("raw"))["bucket"].alias("bucket"),
        normalize.suspect(F.col("raw"))["marked"].alias("marked"), normalize.is_iri_like(F.col("raw"), base, legacy, prefixes).alias("iri_like"), normalize.is_relational(F.col("raw"), base, legacy, prefixes).alias("relational"),
        F.array_join(normalize.plural_variants(F.col("raw")), "|").alias("plurals"), normalize.label_key(F.col("raw")).alias("label_key"),
    )


# -- SQL --------------------------------------------------------------------------------------------------------------------

_TOK = "list_filter(list_transform(regexp_extract_all(coalesce({x}, ''), '[a-zA-Z]+'), lambda w: lower(w)), lambda w: length(w) >= 2)"
_TERMS = r"terms AS (SELECT DISTINCT label AS term FROM label_proposals WHERE regexp_replace(label, '[\s\p{Z}]', '', 'g') <> '')"
_EXPANSION_ROWS = "expansions(word, n, more) AS (VALUES " + ", ".join(f"('{w}', {n}, '{m}')" for w, v in text.EXPANSIONS.items() for n, m in enumerate(v.split())) + ")"
_CONCEPTS = f"""con AS (SELECT iri, label, definition, branch, preferred_label, {sql_content('label')} AS lc, {sql_content('definition')} AS dc, {sql_content('preferred_label')} AS pc, list_transform(coalesce(alternative_labels, []), lambda s: {sql_content('s')}) AS sc FROM concepts)"""


def _score_sql(terms: str, concepts: str = "con") -> str:
    return f"""qs AS (SELECT term, {sql_strip('lower(term)')} AS q, {sql_content('term')} AS qc FROM {terms}),
raw AS (SELECT term, q, qc, iri, label, branch, lc, {sql_relevance('q', 'qc', 'label', 'lc', 'definition', 'dc', 'sc', 'preferred_label', 'pc')} FROM qs, {concepts}),
scored AS (SELECT term, iri, label, branch, {SQL_FINAL} AS score FROM raw)"""


_SEARCH = f"""WITH {_TERMS}, {_CONCEPTS}, {_score_sql('terms')}
SELECT term, place, iri, score FROM (SELECT term, iri, score, CAST(row_number() OVER (PARTITION BY term ORDER BY score DESC, iri) AS INTEGER) AS place FROM scored WHERE score > 0) WHERE place <= 10"""

_DEFS = f"""defs AS (SELECT iri, definition AS label, CAST(NULL AS VARCHAR) AS definition, branch, CAST(NULL AS VARCHAR) AS preferred_label, {sql_content('definition')} AS lc, CAST([] AS VARCHAR[]) AS dc, CAST([] AS VARCHAR[]) AS pc, CAST([] AS VARCHAR[][]) AS sc FROM concepts WHERE definition IS NOT NULL)"""
_DEFINITION = f"""WITH {_TERMS}, {_DEFS}, {_score_sql('terms', 'defs')}
SELECT term, place, iri, score FROM (SELECT term, iri, score, CAST(row_number() OVER (PARTITION BY term ORDER BY score DESC, iri) AS INTEGER) AS place FROM scored WHERE score > 0) WHERE place <= 10"""

_HEADS = "[" + ", ".join(f"'{h}'" for h in text.SHARED_HEADS) + "]"
_TAILS = "[" + ", ".join(f"'{h}'" for h in text.SHARED_TAILS) + "]"


def _decompose_sql(source: str) -> str:
    return f"""cut AS (SELECT term, {sql_strip('term')} AS whole, list_filter(list_transform(regexp_split_to_array({sql_strip('term')}, '{'|'.join(text.CONJUNCTIONS)}'), lambda p: {sql_strip('p')}), lambda p: length(p) > 0) AS parts FROM {source}),
ends AS (SELECT *, CASE WHEN list_contains({_HEADS}, lower(regexp_extract(parts[1], '^\\S+'))) THEN regexp_extract(parts[1], '^\\S+') END AS head, regexp_extract(parts[-1], '\\S+$') AS last FROM cut),
tails AS (SELECT *, CASE WHEN head IS NULL AND list_contains({_TAILS}, lower(last)) THEN last END AS tail FROM ends),
pieces AS (SELECT term, 0 AS i, whole AS part FROM tails UNION ALL
  SELECT term, i, CASE WHEN tail IS NOT NULL AND i < len(parts) AND NOT ends_with(lower(h), lower(tail)) THEN h || ' ' || tail ELSE h END FROM (
    SELECT term, tail, parts, i, CASE WHEN head IS NOT NULL AND i > 1 AND NOT starts_with(lower(parts[i]), lower(head)) THEN head || ' ' || parts[i] ELSE parts[i] END AS h
    FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM tails WHERE len(parts) >= 2))),
firsts AS (SELECT term, part, min(i) AS i FROM pieces GROUP BY term, part),
split AS (SELECT term, CAST(row_number() OVER (PARTITION BY term ORDER BY i) - 1 AS INTEGER) AS pos, part FROM firsts)"""


_LABELS = """labels AS (SELECT label_key, coalesce(max(CASE WHEN kind = 'preferred' THEN iri END), min(CASE WHEN kind = 'alternative' THEN iri END)) AS iri, CASE WHEN bool_or(kind = 'preferred') THEN 'preferred' ELSE 'alternative' END AS kind FROM (
  SELECT lower(coalesce(nullif(trim(preferred_label), ''), label)) AS label_key, iri, 'preferred' AS kind FROM concepts UNION ALL SELECT lower(unnest(alternative_labels)), iri, 'alternative' FROM concepts) WHERE trim(label_key) <> '' GROUP BY label_key)"""
_SPANS = f"""{_LABELS}, docs AS (SELECT doc_id, lower(text) AS t FROM documents WHERE text IS NOT NULL),
hit AS (SELECT doc_id, t, label_key, iri, kind, string_split(t, label_key) AS ps FROM docs JOIN labels ON contains(t, label_key)),
pos AS (SELECT doc_id, label_key, iri, kind, ps, unnest(range(1, len(ps))) AS k FROM hit),
spot AS (SELECT doc_id, label_key, iri, kind, ps[k] AS pre_part, ps[k + 1] AS post_part, k, CAST(list_sum(list_transform(ps[1:k], lambda p: length(p))) + (k - 1) * length(label_key) AS INTEGER) AS start FROM pos),
spans AS (SELECT doc_id, start, CAST(start + length(label_key) AS INTEGER) AS "end", label_key, iri, kind FROM spot
  WHERE NOT regexp_matches(CASE WHEN pre_part = '' AND k > 1 THEN right(label_key, 1) ELSE right(pre_part, 1) END, '[\\p{{L}}\\p{{N}}_]') AND NOT regexp_matches(left(post_part, 1), '[\\p{{L}}\\p{{N}}_]'))"""

_RULER_STOP = ", ".join(f"'{w}'" for w in scan.RULER_STOPWORDS)
_PLACE_BRANCH = " OR ".join(f"contains(lower(branch), '{b}')" for b in gates.PLACE_BRANCHES)
_PLACE_NAMES = "[" + ", ".join(f"'{n}'" for n in gates.PLACE_NAMES) + "]"


def _is_place(label: str) -> str:
    return f"(({_PLACE_BRANCH}) OR list_has_any(string_split_regex(trim(lower({label})), '\\s+'), {_PLACE_NAMES}))"


_GATED = """gated AS (SELECT iri, label, branch, unnest(alternative_labels) AS query FROM concepts UNION ALL SELECT 'n' || n_nationkey, n_name, 'Location', CASE WHEN n_nationkey % 3 = 0 THEN n_name ELSE 'elsewhere' END FROM nation),
g AS (SELECT *, length(query) * 3.0::DOUBLE AS score FROM gated)"""
_SAME = "lower(trim({a})) = lower(trim({b}))"


def _short(label: str, query: str, score: str) -> tuple[str, str, str]:
    short = f"(length(trim({label})) < 4 OR len({sql_content(label)}) <= 1)"
    ok = f"({score} >= 95 OR {_SAME.format(a=query, b=label)})"
    return (
        f"CASE WHEN {short} AND NOT {ok} THEN least({score}, 40.0::DOUBLE) ELSE {score} END",
        f"({short} AND NOT {ok})",
        f"CASE WHEN NOT {short} THEN 'not-short' WHEN {ok} THEN 'near-exact-short-label' ELSE 'short-label demoted (fuzzy match below near-exact)' END",
    )


def _place(label: str, query: str, score: str) -> tuple[str, str, str]:
    down = f"({_is_place(label)} AND NOT {_SAME.format(a=query, b=label)})"
    return (
        f"CASE WHEN {down} THEN least({score}, 40.0::DOUBLE) ELSE {score} END",
        down,
        f"CASE WHEN NOT {_is_place(label)} THEN 'not-a-place' WHEN NOT {down} THEN 'exact-place-name' ELSE 'place-name demoted (signals=1 < 2)' END",
    )


_P, _S = _place("label", "query", "score"), _short("label", "query", "score")
_PIPE_P = _place("label", "surface", "score")
_PIPE_S = _short("label", "surface", "ps")

_MATCH = f"""WITH {_TERMS}, {_CONCEPTS}, {_decompose_sql('terms')},
parts AS (SELECT term AS query_id, part AS term, pos FROM split WHERE pos > 0), all_terms AS (SELECT term FROM terms UNION SELECT term FROM parts), {_score_sql('all_terms')},
best AS (SELECT *, row_number() OVER (PARTITION BY term ORDER BY score DESC, iri) AS place FROM scored WHERE score > 0),
cands AS (SELECT t.term AS query_id, iri, label, branch, score, 'label_search' AS path, t.term AS surface, 2 AS stage, place AS pos FROM terms t JOIN best b ON b.term = t.term AND place <= 10
  UNION ALL SELECT p.query_id, iri, label, branch, score, 'decomposition', p.term, 4, p.pos * 100 + place FROM parts p JOIN best b ON b.term = p.term AND place <= 3),
placed AS (SELECT *, {_PIPE_P[0]} AS ps, {_PIPE_P[1]} AS pd, {_PIPE_P[2]} AS pr FROM cands),
shorted AS (SELECT *, {_PIPE_S[0]} AS fs, {_PIPE_S[1]} AS sd, {_PIPE_S[2]} AS sr FROM placed),
kept AS (SELECT * FROM shorted WHERE fs >= 45),
one AS (SELECT *, row_number() OVER (PARTITION BY query_id, iri ORDER BY fs DESC, stage, pos) AS n, min(stage * 1000000 + pos) OVER (PARTITION BY query_id, iri) AS f FROM kept)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY fs DESC, f, iri) AS INTEGER) AS place, iri, fs AS score, path, (pd OR sd) AS gated, pr || '; ' || sr AS gate_reason FROM one WHERE n = 1"""


SQL = {
    "tokenize_documents": f"SELECT doc_id, CAST(len({_TOK.format(x='text')}) AS INTEGER) AS tokens, CAST(len(list_distinct({_TOK.format(x='text')})) AS INTEGER) AS distinct_tokens, CAST(len({sql_content('text')}) AS INTEGER) AS content_words FROM documents",
    "content_word_counts": f"SELECT word, count(*) AS documents FROM (SELECT unnest({sql_content('text')}) AS word FROM documents) GROUP BY word",
    "decompose_terms": f"WITH leaves AS (SELECT DISTINCT leaf AS term FROM gold_rows WHERE leaf IS NOT NULL), {_decompose_sql('leaves')} SELECT term, pos, part FROM split",
    "phrase_windows": f"""WITH w AS (SELECT DISTINCT leaf AS term, regexp_extract_all(leaf, '[A-Za-z0-9][A-Za-z0-9''-]*') AS w FROM gold_rows WHERE leaf IS NOT NULL),
p AS (SELECT term, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM (SELECT term, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (SELECT unnest(range(1, 6)) AS k)))
SELECT DISTINCT term, phrase FROM p WHERE len({sql_content('phrase')}) > 0""",
    "search_terms_expand": f"""WITH {_TERMS}, {_EXPANSION_ROWS}, t AS (SELECT term, {_TOK.format(x='term')} AS w, {sql_content('term')} AS c FROM terms),
raw AS (SELECT term, 0 AS a, 0 AS b, 0 AS d, term AS s FROM t
  UNION ALL SELECT term, 1, -k, i, array_to_string(w[i:i + k - 1], ' ') FROM (SELECT term, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM (SELECT term, w, unnest(range(2, len(w))) AS k FROM t WHERE len(w) >= 3)) WHERE len({sql_content("array_to_string(w[i:i + k - 1], ' ')")}) > 0
  UNION ALL SELECT term, 2, -length(x), 0, x FROM (SELECT term, unnest(c) AS x FROM t) WHERE length(x) >= 3
  UNION ALL SELECT term, 3, i, n, x || ' ' || more FROM (SELECT term, unnest(c) AS x, generate_subscripts(c, 1) AS i FROM t) JOIN expansions ON word = x),
ord AS (SELECT term, s, row_number() OVER (PARTITION BY term ORDER BY a, b, d, CASE WHEN a = 2 THEN s END) AS n FROM raw),
one AS (SELECT term, arg_min(s, n) AS s, min(n) AS n FROM ord GROUP BY term, lower(s))
SELECT term, CAST(row_number() OVER (PARTITION BY term ORDER BY n) - 1 AS INTEGER) AS pos, s AS search_term FROM one""",
    "word_overlap_pairs": f"WITH v AS (SELECT DISTINCT raw, iri FROM gold_values WHERE raw IS NOT NULL), p AS (SELECT raw, iri, {sql_content('raw')} AS a, {sql_content('label')} AS b FROM v JOIN concepts USING (iri)) SELECT raw, iri, {sql_overlap('a', 'b')} AS overlap FROM p",
    "relevance_scores": f"WITH v AS (SELECT DISTINCT raw AS term, iri FROM gold_values WHERE raw IS NOT NULL), {_CONCEPTS}, raw AS (SELECT term, {sql_strip('lower(term)')} AS q, {sql_content('term')} AS qc, iri, label, lc, {sql_relevance(sql_strip('lower(term)'), sql_content('term'), 'label', 'lc', 'definition', 'dc', 'sc', 'preferred_label', 'pc')} FROM v JOIN con USING (iri)) SELECT term AS raw, iri, {SQL_FINAL} AS score FROM raw",
    "label_search_topk": _SEARCH,
    "definition_search_topk": _DEFINITION,
    "prefix_search": """WITH t AS (SELECT DISTINCT left(label, 5) AS term FROM concepts), n AS (SELECT iri, lower(label) AS name FROM concepts UNION ALL SELECT iri, lower(preferred_label) FROM concepts UNION ALL SELECT iri, lower(unnest(alternative_labels)) FROM concepts),
h AS (SELECT DISTINCT term, iri FROM t JOIN n ON starts_with(name, lower(trim(term))) WHERE trim(term) <> '') SELECT term, CAST(place AS INTEGER) AS place, iri FROM (SELECT term, iri, row_number() OVER (PARTITION BY term ORDER BY iri) AS place FROM h) WHERE place <= 50""",
    "place_gate": f"WITH {_GATED} SELECT iri, query, {_P[0]} AS score, {_P[1]} AS demoted, {_P[2]} AS reason FROM g",
    "short_label_gate": f"WITH {_GATED} SELECT iri, query, {_S[0]} AS score, {_S[1]} AS demoted, {_S[2]} AS reason FROM g",
    "source_filter": "WITH k AS (SELECT doc_id, CASE " + " ".join(
        f"WHEN {' OR '.join(f'contains(lower(trim(source)), {chr(39)}{m}{chr(39)})' for m in ms)} THEN '{kind}'" for kind, ms in (("metadata", gates.METADATA), ("front_matter", gates.FRONT), ("back_matter", gates.BACK))
    ) + r" WHEN length(text) > 0 AND length(text) < 200 AND regexp_matches(text, '\b(?:97[89][- ]?)?(?:\d[- ]?){9}[\dxX]\b') THEN 'metadata' ELSE 'body' END AS kind FROM documents) SELECT doc_id, kind, kind = 'body' AS taggable FROM k",
    "alias_blocklist": "SELECT r.iri, count(*) AS kept FROM ranked_candidates r WHERE r.iri IS NOT NULL AND NOT EXISTS (SELECT 1 FROM concepts c WHERE c.branch = 'Forum' AND lower(c.label) = lower(r.label) AND c.iri = r.iri) GROUP BY r.iri",
    "dictionary_scan": f'WITH {_SPANS} SELECT doc_id, start, "end", iri, kind FROM spans',
    "entity_ruler": f"""WITH RECURSIVE {_SPANS},
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start, "end" DESC) AS n FROM spans WHERE length(label_key) >= 3 AND label_key NOT IN ({_RULER_STOP})),
fold AS (SELECT DISTINCT doc_id, 0 AS n, CAST([] AS STRUCT(s INTEGER, e INTEGER, k VARCHAR, iri VARCHAR, kind VARCHAR)[]) AS kept FROM r
  UNION ALL SELECT doc_id, n, CASE WHEN c IS NULL THEN list_append(kept, x) WHEN x.e - x.s > kept[c].e - kept[c].s THEN list_concat(kept[1:c - 1], [x], kept[c + 1:]) ELSE kept END FROM (
    SELECT f.doc_id, r.n, f.kept, {{'s': r.start, 'e': r."end", 'k': r.label_key, 'iri': r.iri, 'kind': r.kind}} AS x,
      list_filter(range(1, len(f.kept) + 1), lambda i: f.kept[i].e > r.start AND f.kept[i].s < r."end" AND ((f.kept[i].s = r.start AND f.kept[i].e = r."end") OR NOT ((f.kept[i].s <= r.start AND r."end" <= f.kept[i].e) OR (r.start <= f.kept[i].s AND f.kept[i].e <= r."end"))))[1] AS c
    FROM fold f JOIN r ON r.doc_id = f.doc_id AND r.n = f.n + 1)),
fin AS (SELECT doc_id, unnest(arg_max(kept, n)) AS k FROM fold GROUP BY doc_id)
SELECT doc_id, k.s AS start, k.e AS "end", k.iri AS iri, k.kind AS kind, CASE WHEN k.kind IN ('preferred', 'lemma_preferred') THEN 0.72 ELSE 0.55 END AS confidence FROM fin""",
    "leak_scan_ngrams": r"""WITH s AS (SELECT DISTINCT array_to_string(t, ' ') AS g FROM (SELECT list_filter(string_split_regex(regexp_replace(lower(label), '[^\p{L}\p{N}\s]', ' ', 'g'), '\s+'), lambda w: w <> '') AS t FROM concepts) WHERE len(t) >= 2),
n AS (SELECT DISTINCT len(string_split(g, ' ')) AS k FROM s), d AS (SELECT doc_id, list_filter(string_split_regex(regexp_replace(lower(text), '[^\p{L}\p{N}\s]', ' ', 'g'), '\s+'), lambda w: w <> '') AS t FROM documents WHERE text IS NOT NULL),
gr AS (SELECT DISTINCT doc_id, array_to_string(t[i:i + k - 1], ' ') AS g FROM (SELECT doc_id, t, k, unnest(range(1, len(t) - k + 2)) AS i FROM d, n))
SELECT doc_id, count(*) AS hits FROM gr JOIN s USING (g) GROUP BY doc_id""",
    "match_pipeline": _MATCH,
    "label_resolver": f"""WITH {_TERMS}, {_CONCEPTS}, {_decompose_sql('terms')}, every AS (SELECT DISTINCT part AS term FROM split WHERE trim(part) <> ''), {_score_sql('every')},
top AS (SELECT term AS surface, iri, score FROM (SELECT *, row_number() OVER (PARTITION BY term ORDER BY score DESC, iri) AS n FROM scored WHERE score > 0) WHERE n = 1 AND score >= 92),
f AS (SELECT term, pos, surface, iri, score, bool_or(pos > 0) OVER (PARTITION BY term) AS parts FROM split JOIN top ON part = surface)
SELECT term, iri, score, surface FROM (SELECT *, row_number() OVER (PARTITION BY term, iri ORDER BY pos) AS n FROM f WHERE (pos > 0) = parts) WHERE n = 1""",
    "label_index": f"WITH {_LABELS} SELECT label_key, iri, kind FROM labels",
    "hierarchy_hops": """WITH e AS (SELECT DISTINCT iri AS c, unnest(parent_iris) AS p FROM concepts), two AS (SELECT DISTINCT a.c, b.p FROM e a JOIN e b ON a.p = b.c), sib AS (SELECT DISTINCT a.c, b.c AS o FROM e a JOIN e b ON a.p = b.p WHERE a.c <> b.c),
h AS (SELECT c AS node, 'parent' AS relation FROM e UNION ALL SELECT p, 'child' FROM e UNION ALL SELECT c, 'grandparent' FROM two UNION ALL SELECT p, 'grandchild' FROM two UNION ALL SELECT c, 'sibling' FROM sib) SELECT node, relation, count(*) AS others FROM h GROUP BY ALL""",
    "branch_roots": """WITH RECURSIVE e AS (SELECT DISTINCT iri AS c, unnest(parent_iris) AS p FROM concepts), up AS (SELECT c AS here, min(p) AS nxt FROM e JOIN concepts k ON k.iri = p GROUP BY c),
w AS (SELECT iri, iri AS here, [iri] AS seen, false AS done FROM concepts UNION ALL SELECT w.iri, nxt, list_append(seen, nxt), list_contains(seen, nxt) FROM w JOIN up USING (here) WHERE NOT done),
f AS (SELECT iri, arg_max(here, len(seen)) AS here FROM w GROUP BY iri) SELECT f.iri, coalesce(c.label, '') AS branch FROM f LEFT JOIN concepts c ON c.iri = f.here""",
}

QUERIES = {
    f.__name__: f
    for f in (
        tokenize_documents, content_word_counts, search_terms_expand, decompose_terms, phrase_windows, word_overlap_pairs, relevance_scores, label_search_topk, definition_search_topk, prefix_search,
        place_gate, short_label_gate, source_filter, alias_blocklist, dictionary_scan, entity_ruler, leak_scan_ngrams, match_pipeline, match_with_ruler, recall_multi_strategy, label_resolver,
        subject_suggestions, label_index, hierarchy_hops, branch_roots, normal_forms,
    )
}
