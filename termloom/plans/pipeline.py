"""The match pipeline: filter, expand, gate and rank, then judge, for all terms in one job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termloom.functions.gates import enforce_verdict, is_taggable, place_gate, short_gate
from termloom.functions.scoring import rounded
from termloom.functions.text import EXPANSIONS, content_words, decompose, search_terms, strip, strip_fences, tokenize, words_lit
from termloom.operators.catalog import ConceptCatalog
from termloom.operators.relevance import score_lists
from termloom.operators.scan import entity_ruler
from termloom.operators.search import definition_search, label_search, prefix_search
from termloom.runtime import cut

CANDIDATE = ["query_id", "iri", "label", "branch", "score", "path", "surface", "stage", "pos"]


def not_blocked(candidates: DataFrame, blocklist: DataFrame | None, domains: Column | None = None) -> DataFrame:
    """Candidates without those whose (surface, iri) is blocked everywhere or in one of the row's active domains. ``blocklist``:
    surface_term, blocked_iri, domain; letter case of terms and domains doesn't count."""
    if blocklist is None:
        return candidates
    b = blocklist.select(F.lower("surface_term").alias("_t"), F.col("blocked_iri").alias("_i"), F.lower(F.coalesce("domain", F.lit(""))).alias("_d")).distinct()
    active = F.transform(domains, F.lower) if domains is not None else F.array().cast("array<string>")
    on = (F.lower("surface") == F.col("_t")) & (F.col("iri") == F.col("_i")) & ((F.col("_d") == "") | F.array_contains(active, F.col("_d")))
    return candidates.join(b, on, "left_anti")


def recall(terms: DataFrame, catalog: ConceptCatalog, threshold: float = 30.0, top: int = 10, depth: int = 3, decay: float = 0.85) -> DataFrame:
    """term, iri, score, place: candidates from label, prefix and definition searches over the term's search terms, scored against the term
    and its expansions (the best counts), and their ancestors up to ``depth`` hops at a decayed score."""
    c = catalog.concepts
    t = terms.select("term").filter(strip(F.col("term")) != "").distinct()
    t = t.withColumn("content", F.when(F.size(content_words(F.col("term"))) > 0, content_words(F.col("term"))).otherwise(F.array_sort(F.array_distinct(tokenize(F.col("term")))))).filter(F.size("content") > 0)
    subs = t.select("term", F.explode(search_terms(F.col("term"))).alias("sub"))
    label_hits = label_search(subs.select(F.col("sub").alias("term")), c, 25).select(F.col("term").alias("sub"), "iri")
    stems = t.select("term", F.explode(F.transform(F.filter("content", lambda w: F.length(w) >= 6), lambda w: F.substring(w, F.lit(1), F.length(w) - 2))).alias("sub"))
    by_prefix = subs.filter(F.length("sub") >= 3).unionByName(stems)
    prefix_hits = prefix_search(by_prefix.select(F.col("sub").alias("term")), c, 50).select(F.col("term").alias("sub"), "iri")
    phrase = F.array_join("content", " ")
    defs = t.select("term", F.explode(F.array_distinct(F.array(F.col("term"), phrase))).alias("sub")).filter(F.length("sub") >= 3)
    def_hits = definition_search(defs.select(F.col("sub").alias("term")), c, 20).select(F.col("term").alias("sub"), "iri")
    raw = subs.join(label_hits, "sub").unionByName(by_prefix.join(prefix_hits, "sub")).unionByName(defs.join(def_hits, "sub")).select("term", "iri").distinct()
    table = F.create_map(*[x for k, v in EXPANSIONS.items() for x in (F.lit(k), words_lit(v.split()))])
    expanded = F.flatten(F.transform("content", lambda w: F.transform(F.coalesce(F.try_element_at(table, w), F.array().cast("array<string>")), lambda s: F.concat(w, F.lit(" "), s))))
    queries = t.select("term", "content", F.col("term").alias("q")).unionByName(t.select("term", F.explode(expanded).alias("q")).select("term", content_words(F.col("q")).alias("content"), "q"))
    asked = queries.groupBy("term").agg(F.collect_set(F.struct("q", "content")).alias("queries")).join(raw.groupBy("term").agg(F.collect_set("iri").alias("iris")), "term")
    direct = cut(score_lists(asked, c).filter(F.col("score") >= threshold))  # read by every hop below
    out = direct
    known = c.select(F.col("iri").alias("parent"))
    edges = catalog.edges.join(known, "parent", "left_semi")
    seen = direct.filter("score >= 50").select("term", F.col("iri").alias("root"), "iri", "score")
    reached = seen
    for d in range(1, depth + 1):
        step = seen.join(edges, F.col("iri") == F.col("child")).select("term", "root", F.col("parent").alias("iri"), "score").distinct()
        seen = cut(step.join(reached.select("term", "root", "iri"), ["term", "root", "iri"], "left_anti"))
        reached = reached.unionByName(seen)
        out = out.unionByName(seen.select("term", "iri", rounded(F.col("score") * (decay**d)).alias("score")).filter(F.col("score") >= threshold))
    best = out.groupBy("term", "iri").agg(F.max("score").alias("score"))
    w = Window.partitionBy("term").orderBy(F.col("score").desc(), "iri")
    return best.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= top)


def candidates(queries: DataFrame, catalog: ConceptCatalog, ruler: bool = True, with_recall: bool = False, semantic: DataFrame | None = None, limit: int = 10) -> DataFrame:
    """All candidates of each query (query_id, term): ruler spans, label search, recall, the parts of a compound term, and given
    semantic neighbours (term, iri, cosine). stage and pos keep the order in which a serial matcher would meet them."""
    c = catalog.concepts.select("iri", "label", "branch")
    q = queries.select("query_id", "term").filter("term is not null")
    parts = []
    if ruler:
        spans = entity_ruler(q.select(F.col("query_id").alias("doc_id"), F.col("term").alias("text")), catalog.labels)
        spans = spans.join(q, F.col("doc_id") == F.col("query_id")).join(c, "iri", "left")
        label = F.coalesce("label", F.substring("term", F.col("start") + 1, F.col("end") - F.col("start")))
        parts.append(spans.select("query_id", "iri", label.alias("label"), F.coalesce("branch", F.lit("")).alias("branch"), (F.col("confidence") * 100.0).alias("score"), F.lit("entity_ruler").alias("path"), F.col("term").alias("surface"), F.lit(1).alias("stage"), (F.col("start") * 1000 - F.col("end")).alias("pos")))
    found = label_search(q, catalog.concepts, limit)
    parts.append(q.join(found, "term").select("query_id", "iri", "label", "branch", "score", F.lit("label_search").alias("path"), F.col("term").alias("surface"), F.lit(2).alias("stage"), F.col("place").alias("pos")))
    if with_recall:
        r = recall(q, catalog).join(c, "iri")
        parts.append(q.join(r, "term").select("query_id", "iri", "label", "branch", "score", F.lit("multi_strategy_recall").alias("path"), F.col("term").alias("surface"), F.lit(3).alias("stage"), F.col("place").alias("pos")))
    split = q.select("query_id", F.posexplode(decompose(F.col("term"))).alias("i", "part")).filter("i > 0")
    halves = label_search(split.select(F.col("part").alias("term")), catalog.concepts, 3).withColumnRenamed("term", "part")
    parts.append(split.join(halves, "part").select("query_id", "iri", "label", "branch", "score", F.lit("decomposition").alias("path"), F.col("part").alias("surface"), F.lit(4).alias("stage"), (F.col("i") * 100 + F.col("place")).alias("pos")))
    if semantic is not None:
        near = semantic.join(c, "iri")
        w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "iri")
        s = q.join(near, "term").select("query_id", "iri", "label", "branch", rounded(F.col("cosine") * 100.0).alias("score"), F.lit("semantic").alias("path"), F.col("term").alias("surface"), F.lit(5).alias("stage"))
        parts.append(s.withColumn("pos", F.row_number().over(w)))
    out = parts[0].select(*CANDIDATE)
    for p in parts[1:]:
        out = out.unionByName(p.select(*CANDIDATE))
    return out


def rank(cands: DataFrame, floor: float = 45.0, blocklist: DataFrame | None = None) -> DataFrame:
    """Blocklist, place gate, short-label gate, floor, then the best candidate per concept (the earliest of equals); order by score, ties by when the
    concept first survived. Optional columns of ``cands``: heading_terms and domains (arrays)."""
    domains = F.col("domains") if "domains" in cands.columns else None
    in_heading = F.array_contains(F.transform("heading_terms", F.lower), F.lower("label")) if "heading_terms" in cands.columns else None
    kept = not_blocked(cands, blocklist, domains)
    kept = kept.withColumn("_p", place_gate(F.col("surface"), F.col("label"), F.col("branch"), F.col("score"), in_heading))
    kept = kept.withColumn("_s", short_gate(F.col("surface"), F.col("label"), F.col("_p.score")))
    kept = kept.select("query_id", "iri", "label", "branch", F.col("_s.score").alias("score"), "path", "surface", "stage", "pos", (F.col("_p.demoted") | F.col("_s.demoted")).alias("gated"), F.concat_ws("; ", "_p.reason", "_s.reason").alias("gate_reason")).filter(F.col("score") >= floor)
    row = F.struct("label", "branch", "score", "path", "surface", "gated", "gate_reason")
    best = kept.groupBy("query_id", "iri").agg(F.max_by(row, F.struct("score", -F.col("stage"), -F.col("pos"))).alias("r"), F.min(F.struct("stage", "pos")).alias("first"))
    w = Window.partitionBy("query_id").orderBy(F.col("r.score").desc(), "first", "iri")
    return best.withColumn("place", F.row_number().over(w)).select("query_id", "place", "iri", "r.*")


def match(queries: DataFrame, catalog: ConceptCatalog, blocklist: DataFrame | None = None, floor: float = 45.0, **kwargs) -> DataFrame:
    """Ranked concepts for every query: query_id, term, and optionally section (front matter and metadata match nothing),
    heading_terms and domains."""
    q = queries
    if "section" in q.columns:
        q = q.filter((F.coalesce(F.trim("section"), F.lit("")) == "") | is_taggable(F.col("section"), F.col("term")))
    cands = candidates(q, catalog, **kwargs)
    context = [c for c in ("heading_terms", "domains") if c in q.columns]
    if context:
        cands = cands.join(q.select("query_id", *context), "query_id")
    return rank(cands, floor, blocklist)


def resolve_terms(terms: DataFrame, catalog: ConceptCatalog, least: float = 92.0) -> DataFrame:
    """term, iri, label, score, surface: a compound term by the best hit of each of its parts at ``least`` or more; without such a part,
    or undivided, the whole term. One row per concept and term."""
    t = terms.select("term").filter(strip(F.col("term")) != "").distinct()
    parts = t.select("term", F.posexplode(decompose(F.col("term"))).alias("i", "surface"))
    hits = label_search(parts.select(F.col("surface").alias("term")), catalog.concepts, 1).select(F.col("term").alias("surface"), "iri", "label", "score").filter(F.col("score") >= least)
    found = parts.join(hits, "surface").withColumn("part", F.col("i") > 0)
    any_part = F.bool_or("part").over(Window.partitionBy("term"))
    first = Window.partitionBy("term", "iri").orderBy("i")
    return found.withColumn("_any", any_part).filter(F.col("part") == F.col("_any")).withColumn("_n", F.row_number().over(first)).filter("_n = 1").select("term", "iri", "label", "score", "surface")


def suggest_subjects(docs: DataFrame, catalog: ConceptCatalog, least: float = 70.0, top: int = 5) -> DataFrame:
    """key, iri, label, confidence, place: subjects suggested by a document's title and headings (columns key, title, headings): title, headings,
    pairs of neighbouring title words and title words of five letters or more are searched; the best hit per concept counts."""
    words = F.filter(F.split(F.trim("title"), r"\s+"), lambda w: F.size(content_words(w)) > 0)
    pairs = F.transform(F.when(F.size(words) >= 2, F.sequence(F.lit(1), F.size(words) - 1)).otherwise(F.array().cast("array<int>")), lambda i: F.array_join(F.slice(words, i, F.lit(2)), " "))
    phrases = F.concat(F.array("title"), F.coalesce("headings", F.array().cast("array<string>")), pairs, F.filter(words, lambda w: F.length(w) >= 5))
    p = docs.select("key", F.explode(F.array_distinct(F.array_compact(phrases))).alias("term")).filter(strip(F.col("term")) != "")
    hits = label_search(p, catalog.concepts, 3).filter(F.col("score") >= least)
    best = p.join(hits, "term").groupBy("key", "iri", "label").agg((F.floor(F.max("score") * 10 + 0.5) / 1000.0).alias("confidence"))
    w = Window.partitionBy("key").orderBy(F.col("confidence").desc(), "iri")
    return best.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= top)


# -- judge ------------------------------------------------------------------------------------------------------------------

JUDGE_SYSTEM = "You check candidate concepts for a text and answer with JSON only: {\"judged\": [{\"iri_hash\", \"adjusted_score\", \"verdict\", \"reasoning\"}]}. Verdicts: confirmed, boosted, penalized, rejected."
RERANK_SYSTEM = "Say how well each concept fits the excerpt, from 0.20 (the label matches, the meaning doesn't) over 0.40 (a stretch), 0.60 (secondary) and 0.80 (applies) to 0.95 (central). Answer with JSON: {\"scores\": [{\"iri\", \"contextual_score\", \"reasoning\"}]}."
#: So much of a text, and of a definition, goes into a prompt: a judge reads no more.
JUDGE_CHARS, EXCERPT_CHARS, DEFINITION_CHARS = 10_000, 3_000, 200


def document_type_section(kind: Column) -> Column:
    """A heading that names the document's type; empty where none is known."""
    return F.when(F.coalesce(kind, F.lit("")) == "", F.lit("")).otherwise(F.concat(F.lit("\n## Document type\nThis document is: "), kind, F.lit("\n")))


def judge_prompts(ranked: DataFrame, texts: DataFrame) -> DataFrame:
    """query_id, system, user: for each query the instructions, and its text (angle brackets blanked, so that it can't close its own frame) with the candidates as
    JSON, best first. ``texts``: query_id, text, and optionally document_type."""
    c = ranked.groupBy("query_id").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("place", "iri", "label", "score"))), lambda x: F.struct(x["iri"].alias("iri_hash"), x["label"].alias("label"), x["score"].alias("score")))).alias("candidates"))
    kind = F.col("document_type") if "document_type" in texts.columns else F.lit(None).cast("string")
    body = F.translate(F.left(F.coalesce("text", F.lit("")), F.lit(JUDGE_CHARS)), "<>", "  ")
    t = texts.select("query_id", F.concat(document_type_section(kind), F.lit("Input text: <user_input>"), body, F.lit("</user_input>\n\nCandidates to validate:\n")).alias("_u"))
    return c.join(t, "query_id").select("query_id", F.lit(JUDGE_SYSTEM).alias("system"), F.concat("_u", "candidates").alias("user"))


def rerank_prompts(ranked: DataFrame, texts: DataFrame, concepts: DataFrame) -> DataFrame:
    """query_id, prompt: an excerpt of the text and the concepts with the beginning of their definitions, for a score by context."""
    d = ranked.select("query_id", "place", "iri", "label").join(concepts.select("iri", "definition"), "iri", "left")
    one = F.struct("place", F.col("iri").alias("iri"), F.col("label"), F.left(F.coalesce("definition", F.lit("")), F.lit(DEFINITION_CHARS)).alias("definition"))
    c = d.groupBy("query_id").agg(F.to_json(F.transform(F.array_sort(F.collect_list(one)), lambda x: F.struct(x["iri"].alias("iri"), x["label"].alias("label"), x["definition"].alias("definition")))).alias("concepts"))
    kind = F.col("document_type") if "document_type" in texts.columns else F.lit(None).cast("string")
    t = texts.select("query_id", F.concat(F.lit(RERANK_SYSTEM), document_type_section(kind), F.lit("\nExcerpt:\n"), F.left(F.coalesce("text", F.lit("")), F.lit(EXCERPT_CHARS)), F.lit("\n\nConcepts:\n")).alias("_u"))
    return c.join(t, "query_id").select("query_id", F.concat("_u", "concepts").alias("prompt"))


def parse_judgements(answers: DataFrame, ranked: DataFrame) -> DataFrame:
    """query_id, iri, score, verdict, reasoning from answers (query_id, answer): only known concepts (named by iri_hash or else iri) with a true number as score, or none,
    which keeps the original one; an unknown verdict confirms; scores are clamped to 0..100 and then held to the verdict. What isn't JSON of that shape gives no rows and
    never fails."""
    v = answers.select("query_id", F.try_parse_json(strip_fences(F.col("answer"))).alias("v"))
    rows = v.select("query_id", F.explode(F.coalesce(F.try_variant_get("v", "$.judged", "array<variant>"), F.array().cast("array<variant>"))).alias("j"))
    given = F.try_variant_get("j", "$.adjusted_score", "variant")
    number = F.rlike(F.schema_of_variant(given), F.lit("^(?:BIGINT|DOUBLE|FLOAT|DECIMAL.*|INT|SMALLINT|TINYINT)$"))
    text = lambda path: F.when(F.schema_of_variant(F.try_variant_get("j", path, "variant")) == "STRING", F.try_variant_get("j", path, "string"))
    typed = rows.filter(given.isNull() | number).select(
        "query_id", F.coalesce(F.nullif(text("$.iri_hash"), F.lit("")), text("$.iri")).alias("iri"), F.try_variant_get("j", "$.adjusted_score", "double").alias("adjusted"), text("$.verdict").alias("verdict"), F.coalesce(text("$.reasoning"), F.lit("")).alias("reasoning")
    )
    known = typed.join(ranked.select("query_id", "iri", "score"), ["query_id", "iri"])
    verdict = F.when(F.col("verdict").isin("confirmed", "boosted", "penalized", "rejected"), F.col("verdict")).otherwise("confirmed")
    clamped = F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.coalesce("adjusted", "score")))
    return known.select("query_id", "iri", enforce_verdict(F.col("score"), clamped, verdict).alias("score"), verdict.alias("verdict"), "reasoning")


def judged(ranked: DataFrame, answers: DataFrame) -> DataFrame:
    """ranked with the scores of the judge; concepts it rejected or didn't mention go."""
    j = parse_judgements(answers, ranked).filter("score > 0").select("query_id", "iri", F.col("score").alias("_score"))
    out = ranked.join(j, ["query_id", "iri"]).withColumn("score", F.col("_score")).drop("_score", "place")
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "iri")
    return out.withColumn("place", F.row_number().over(w))
