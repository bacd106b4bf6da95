import json
import random

import pytest
from pyspark.sql import functions as F

from termloom.functions import ids, text
from termloom.operators import documents, evaluate, gold, prior, proposals
from termloom.operators.catalog import ConceptCatalog
from termloom.plans import pipeline
from termloom.sources import manifests

SCHEMA = "iri string, label string, definition string, alternative_labels array<string>, preferred_label string, branch string, parent_iris array<string>"
CONCEPTS = [
    ("https://v/A", "Lease of Land", None, ["Ground Lease"], "Lease of Land", "Doc", ["https://v/C", "nowhere"]), ("https://v/B", "Leases", None, None, None, "Doc", ["https://v/A"]), ("https://v/C", "Contracts", None, [], None, "Doc", []),
    ("https://v/D", "Ring One", None, [], None, "X", ["https://v/E"]), ("https://v/E", "Ring Two", None, [], None, "X", ["https://v/D"]), ("https://v/F", "Tail", None, [], None, "X", ["https://v/E"]), ("https://v/G", "Kenya", None, [], None, "Location", None),
]


@pytest.fixture(scope="module")
def concepts(spark):
    return spark.createDataFrame(CONCEPTS, SCHEMA)


def test_ids(spark):
    import hashlib

    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    path, leaf = ['A "q"', "b\\c\n"], "é / x"
    df = spark.createDataFrame([("f", "s", path, leaf), (None, None, None, None)], "firm string, stratum string, path array<string>, leaf string")
    c = F.col
    a, b = df.select(ids.item_id(c("firm"), c("stratum"), c("path"), c("leaf")).alias("i"), ids.family_id(c("firm"), c("path")).alias("f"), ids.stratum_id(c("firm"), c("stratum")).alias("s"), ids.cell_id(c("firm"), c("leaf")).alias("c"), ids.input_text(c("path"), c("leaf")).alias("t")).collect()
    assert a.i == sha(json.dumps(["f", "s", path, leaf], ensure_ascii=False))[:16] and a.f == sha(json.dumps(["f", path], ensure_ascii=False))[:12] and a.s == sha("f|s")[:12]
    assert a.c == sha(json.dumps(["f", ids.CELL_DERIVATION, "é / x"], ensure_ascii=False))[:16] and a.t == " > ".join([*path, leaf])
    assert b.i == sha(json.dumps(["", "", [], ""]))[:16] and b.t == ""


def test_branch_roots(spark, concepts):
    got = {r.iri[-1]: r.branch for r in ConceptCatalog(concepts).branch_roots().collect()}
    assert got == {"A": "Contracts", "B": "Contracts", "C": "Contracts", "D": "Ring One", "E": "Ring Two", "F": "Ring Two", "G": "Kenya"}
    chain = spark.createDataFrame([(f"n{i:03d}", f"L{i}", None, [], None, "", [f"n{i - 1:03d}"] if i else []) for i in range(300)], SCHEMA)
    assert {r.branch for r in ConceptCatalog(chain).branch_roots().collect()} == {"L0"}
    p = ConceptCatalog(concepts).parents_of(concepts.select("iri")).collect()
    assert ("https://v/A", "https://v/C", 1) in {(r.iri, r.parent, r.place) for r in p} and all(r.parent != "nowhere" for r in p)


def test_cells_and_items(spark, concepts):
    values = ["https://v/A", "http://old/B", "http://old/nope", "rel:suedBy", "N/A", "lease of land ?", "Docs: Ground Lease", "nothing", None]
    cells = gold.resolve_cells(spark.createDataFrame([(v,) for v in values], "value string"), concepts, "https://v/", ["http://old/"], ["rel"])
    got = {r.value: (r.iri and r.iri[-1], r.rung, r.parse, r.suspect) for r in cells.collect()}
    assert got == {
        "https://v/A": ("A", "iri_exact", "iri", False), "http://old/B": ("B", "legacy_iri", "iri", False), "http://old/nope": (None, "unresolved", "iri", False), "rel:suedBy": (None, "excluded_relational", None, False), "N/A": (None, "excluded_non_referential_value", None, False),
        "lease of land ?": ("A", "exact_preferred", "plain", True), "Docs: Ground Lease": ("A", "exact_alternative", "rhs_last", False), "nothing": (None, "unresolved", "unresolved", False),
    }
    rows = spark.createDataFrame([("i", "https://v/A"), ("i", "nothing"), ("i", "http://old/B"), ("j", "N/A"), ("k", None)], "item_id string, value string")
    items = {r.item_id: ([x[-1] for x in r.iris], r.rules, r.blank) for r in gold.resolve_items(rows, cells).collect()}
    assert items == {"i": (["A", "B"], ["unresolved"], False), "j": ([], ["excluded_non_referential_value"], True), "k": ([], [], True)}


def test_proposals(spark, concepts):
    labels = spark.createDataFrame([("Lease",), ("a big lease of land",), ("Landlord",), ("",), (None,)], "label string")
    got = {(r.label, r.iri[-1]): r.score for r in proposals.containment(labels, concepts).collect()}
    assert got == {("Lease", "A"): round(500 / 12, 3), ("a big lease of land", "A"): round(1300 / 19, 3)}
    every = {(r.label, r.place): (r.iri[-1], r.method) for r in proposals.proposed(labels, concepts).collect()}
    assert every["Lease", 1] == ("A", "containment") and ("Landlord", 1) not in every
    one = lambda x, f: spark.createDataFrame([(x,)], "x string").select(f(F.col("x")).alias("y")).first().y
    assert one("Sale and Lease (old) / a Ship, X", proposals.noun_phrases) == ["Sale and Lease", "Sale and", "and Lease", "Sale", "Lease", "a Ship", "Ship"]
    assert one(" A–x and  B", proposals.query_variants) == ["A–x and  B", "A-x and B", "A–x", "B"]
    h = lambda q, x: spark.range(1).select(proposals.heads_or_tails(F.lit(q), F.lit(x)).alias("h")).first().h
    assert h("Bank", "Bank Account") and h("account", "Bank Account") and not h("x", "Bank Account") and not h("Bank", "Bank of the Old North West") and not h("", "Bank")


def test_subject_tags(spark):
    log = [(1, 1, "suggest", "a"), (1, 2, "validate", "a"), (1, 3, "suggest", "a"), (1, 4, "validate", "b"), (1, 5, "add", "c"), (1, 6, "invalidate", "c"), (2, 7, "manifest", "a"), (1, 8, "suggest", "d"), (1, 9, "add", "a"), (None, 10, "add", "z")]
    df = spark.createDataFrame([(c, s, a, i, "L" + i, None) for c, s, a, i in log], "corpus long, seq long, action string, iri string, label string, confidence double")
    tags = prior.fold_tags(df)
    assert {(r.corpus, r.iri): (r.status, r.source, r.confidence) for r in tags.collect()} == {(1, "a"): ("added", "human", 1.0), (1, "c"): ("invalidated", "human", 1.0), (2, "a"): ("added", "manifest", 1.0), (1, "d"): ("suggested", "suggester", 1.0)}
    assert {r.corpus: r.context for r in prior.judge_context(tags).collect()} == {1: "La", 2: "La"}
    more = prior.merge_suggestions(tags, spark.createDataFrame([(1, "c", "no", 0.9), (2, "n", "Ln", 0.8), (2, "n", "Lm", 0.7)], "corpus long, iri string, label string, confidence double"))
    assert more.count() == 5 and more.filter("iri = 'n'").first().label == "Ln"


def test_document_lane(spark, concepts):
    docs = spark.createDataFrame([(1, "A Lease of Land in Kenya, and contracts."), (2, None), (3, "")], "doc_id long, text string")
    block = spark.createDataFrame([("lease of land", "https://v/A", None)], "surface_term string, blocked_iri string, domain string")
    got = {r.iri[-1]: r.outcome for r in documents.adapt(docs, ConceptCatalog(concepts), blocklist=block, phrases=False).collect()}
    assert got == {"A": "blocklist", "G": "kept", "C": "kept"}
    wide = {r.iri[-1]: (r.path, r.score) for r in documents.adapt(docs, ConceptCatalog(concepts)).collect()}
    assert wide["A"] == ("aho_corasick", 100.0) and set(wide) >= {"A", "B", "C", "G"}
    rng = random.Random(1)
    texts = [(n, "".join(rng.choice("ab c") for _ in range(rng.randrange(0, 30)))) for n in range(60)]
    surfaces = sorted({"".join(rng.choice("ab c") for _ in range(rng.randrange(1, 6))) for _ in range(40)})
    s = spark.createDataFrame([(x,) for x in [*surfaces, "", None]], "surface string")
    found = {(r.doc_id, r.surface) for r in documents.surfaces_in(spark.createDataFrame([*texts, (99, None)], "doc_id long, text string"), s).collect()}
    assert found == {(n, x) for n, t in texts for x in surfaces if x in t}
    with pytest.raises(ValueError):
        documents.assert_no_surfaces(docs, spark.createDataFrame([("Land",)], "surface string"))


def test_judge(spark, concepts):
    ranked = spark.createDataFrame([("q", 1, "a", "L", 60.0), ("q", 2, "b", "M", 50.0)], "query_id string, place int, iri string, label string, score double")
    rows = [{"iri": "a"}, {"iri_hash": "", "iri": "b", "adjusted_score": 99, "verdict": "boosted", "reasoning": 5}, {"iri_hash": "b", "adjusted_score": "high"}, {"iri_hash": "b", "adjusted_score": True}, {"iri_hash": 7}]
    answer = "`````json\n" + json.dumps({"judged": rows}) + "\n`````"
    got = pipeline.parse_judgements(spark.createDataFrame([("q", answer), ("q", "[]"), ("q", '{"judged": 3}'), ("q", None)], "query_id string, answer string"), ranked).collect()
    assert {(r.iri, r.score, r.verdict, r.reasoning) for r in got} == {("a", 60.0, "confirmed", ""), ("b", 75.0, "boosted", "")}
    p = pipeline.judge_prompts(ranked, spark.createDataFrame([("q", "a <b> c", "memo")], "query_id string, text string, document_type string")).first()
    assert "<user_input>a  b  c</user_input>" in p.user and "This document is: memo" in p.user and '"iri_hash":"a"' in p.user
    d = lambda x: spark.createDataFrame([(x,)], "x string").select(text.snippet(F.col("x"), 3).alias("y")).first().y
    assert d(" a b  c ") == "a b c" and d("a b c d") == "a b c…" and d(None) == ""


def test_fit_bootstrap_frontier(spark):
    rng = random.Random(9)
    points = [(x / 7, rng.randrange(1, 4)) for x in range(400)]
    samples = [(x, n, sum(rng.random() < x / 70 for _ in range(n))) for x, n in points]
    df = spark.createDataFrame(samples, "score double, samples long, correct long")
    want: list = []
    for x, p in evaluate._pava([(x, float(c), float(n)) for x, n, c in samples]):
        if not want or want[-1][1] != round(p, 6):
            want.append((x, round(p, 6)))
    for parts in (1, 7):
        assert [tuple(r) for r in evaluate.fit_steps(df.repartition(parts)).orderBy("x").collect()] == want
    assert evaluate.weak_band([(10.0, 0.2), (50.0, 0.6), (70.0, 0.9)]) == (50.0, 70.0) and evaluate.weak_band([(10.0, 0.2)]) == (10.0, 10.0) and evaluate.weak_band([]) == (50.0, 80.0)
    units = spark.createDataFrame([(f"i{n}", 1, 1, n % 3, 2, 0, n % 3) for n in range(900)], "item_id string, tp_a long, fp_a long, fn_a long, tp_b long, fp_b long, fn_b long")
    a, b = evaluate.bootstrap_f1_delta(units, 400), evaluate.bootstrap_f1_delta(units.repartition(5), 400)
    assert a == b and a["low"] < a["point"] < a["high"] and a["n_units"] == 900 and a["high"] - a["low"] < 0.05 and evaluate.verdict(a) == "win"
    assert evaluate.bootstrap_f1_delta(units.filter("false"))["n_units"] == 0


def test_manifests(spark, tmp_path):
    books = [manifests.Workbook("f", "p", "s", (manifests.Sheet("n", 3, "h", "c"),)), manifests.Workbook("g", "q", "t")]
    path = str(tmp_path / "m.md")
    manifests.write_manifest(spark, path, books)
    assert manifests.read_manifest(spark, path) == books and manifests.read_manifest(spark, str(tmp_path / "no")) == []
    with pytest.raises(ValueError):
        manifests.parse_manifest("## f\n")
    rule = manifests.AnswerRule(0.4, 3, True, ((1.0, 0.5),))
    sha = manifests.write_config(spark, rule, str(tmp_path / "r.json"))
    assert manifests.load_config(spark, str(tmp_path / "r.json")) == rule and sha == rule.sha256()
    with pytest.raises(ValueError):
        manifests.AnswerRule(threshold=2)
    s = spark.createDataFrame([("a", "tune"), ("b", "frozen")], "item_id string, slice string")
    m = manifests.split_manifest(s, "g", "1")
    manifests.check_split_manifest(m, s.repartition(3), "g")
    for bad in (m | {"seed": "2"}, m):
        with pytest.raises(ValueError):
            manifests.check_split_manifest(bad, s.filter("item_id = 'a'"), "g")
    (tmp_path / "v.json").write_text(json.dumps({"version": 1, "grader_id": "g1", "model_family": "m", "votes": [{"item_id": "i", "generator_id_claimed": "x", "concepts": {"Tax  Law": 0.5}}]}))
    items, names = spark.createDataFrame([("i", "x")], "item_id string, generator_id string"), spark.createDataFrame([("tax law",)], "label string")
    assert manifests.load_votes(spark, str(tmp_path / "v.json"), items, names).first().confidence == 0.5
    for wrong in (items.withColumn("generator_id", F.lit("g1")), items.filter("false")):
        with pytest.raises(ValueError):
            manifests.load_votes(spark, str(tmp_path / "v.json"), wrong, names)
    b = spark.createDataFrame([("T", "i", None, "old")], "surface_term string, blocked_iri string, domain string, reason string")
    got = manifests.add_blocked(b, spark.createDataFrame([("t", "i", "", "new"), ("u", "i", "d", None)], b.schema))
    assert {(r.surface_term, r.reason) for r in got.collect()} == {("t", "new"), ("u", None)}
    manifests.save_blocklist(spark, got, str(tmp_path / "b.json"))
    from termloom.sources.pinned import read_blocklist

    assert read_blocklist(spark, str(tmp_path / "b.json")).count() == 2
    assert manifests.load_lemmas(spark, str(tmp_path), "h") is None
    manifests.save_lemmas(spark.createDataFrame([("laws", "law")], "label_key string, lemma string"), str(tmp_path), "h")
    assert manifests.load_lemmas(spark, str(tmp_path), "h").first().lemma == "law"


def test_triage(spark):
    from termloom.operators import embedding, reconcile

    s = "text string, iri string, label string, definition string, confidence double, ord long"
    d = [("Tax", "t1", "tax", None, 0.7, 1), ("Law", "l1", "law", None, 0.7, 2), ("Fee", None, "", None, 0.5, 3), ("Sale of land", "s1", "x", "what is sold is land", 0.7, 4), ("alone", "q", "", None, 0.4, 5)]
    m = [("tax", "t2", "gift", None, 0.9, 1), ("law", "l1", "law", None, 0.5, 2), ("fee", "f1", "fee", None, 0.6, 3), ("sale of land", "s2", "y", "a boat", 0.8, 4), ("other", "o", "", None, 0.1, 5)]
    got = {(r.category, r.key, r.iri): round(r.confidence, 4) for r in reconcile.reconcile_with_triage(spark.createDataFrame(d, s), spark.createDataFrame(m, s), embedding.similarity).collect()}
    assert got == {("conflict_resolved", "tax", "t1"): 1.0, ("both_agree", "law", "l1"): 0.715, ("both_agree", "fee", "f1"): 0.62, ("conflict_resolved", "sale of land", "s1"): 0.7, ("model_only", "other", "o"): 0.1}


def test_folds(spark):
    from termloom.operators import audit, scan

    items = spark.createDataFrame([("a", ["x", "y"]), ("b", ["z"]), ("n", [])], "item_id string, gold array<string>")
    said = spark.createDataFrame([("a", ["x", "q"]), ("b", ["z"]), ("n", ["w"])], "item_id string, iris array<string>")
    r = audit.stack_scores(items, said).first()
    assert (r.items, r.tp, r.fp, r.fn, r.exact_items, r.empty_items, r.nomatch_items, r.nomatch_false, r.nomatch_share) == (2, 2, 1, 1, 1, 0, 1, 1, 1.0)
    with pytest.raises(ValueError):
        audit.stack_scores(items, said.filter("item_id <> 'b'"))
    decisions = spark.createDataFrame([("a", "reject", ["y", "x"], "h"), ("b", "reject", ["z"], "old"), ("n", "accept", ["w"], "h")], "item_id string, action string, iris array<string>, catalog_hash string")
    left = audit.suppress(spark.createDataFrame([("a", ["x", "y"]), ("a", ["x"]), ("b", ["z"]), ("n", [])], "item_id string, iris array<string>"), audit.rejection_memory(decisions, "h"))
    assert sorted((r.item_id, tuple(r.iris)) for r in left.collect()) == [("a", ("x",)), ("b", ("z",)), ("n", ())]
    t = "test string, outcome string"
    diff = audit.outcome_diff(spark.createDataFrame([("a", "passed"), ("b", "passed"), ("c", "failed"), ("d", "passed")], t), spark.createDataFrame([("a", "failed"), ("b", "passed"), ("c", "passed"), ("e", "passed")], t))
    assert {r.test: r.blocking for r in diff.collect()} == {"a": True, "c": False, "d": False, "e": False}
    floor = "confidence double, accepted boolean"
    assert audit.best_floor(spark.createDataFrame([(0.2, False), (0.6, True), (0.8, True)], floor)).first().floor == 0.6 and audit.best_floor(spark.createDataFrame([], floor)).first().floor == 0.7
    with pytest.raises(ValueError):
        audit.best_floor(spark.createDataFrame([(1.5, True)], floor))
    docs = spark.createDataFrame([(1, "Tax tax TAX")], "doc_id long, text string")
    spans = scan.scan(docs, spark.createDataFrame([("Tax",)], "pattern string"))
    assert spans.count() == 3 and [(r.start, r.end) for r in scan.same_case(spans, docs).collect()] == [(0, 3)]
    p = spark.range(1).select(scan.pattern_parts(scan.pattern_id(F.lit("a|b"), F.lit("preferred"))).alias("p"), scan.pattern_parts(F.lit("x")).alias("q")).first()
    assert tuple(p.p) == ("a|b", "preferred") and tuple(p.q) == ("x", "unknown")
