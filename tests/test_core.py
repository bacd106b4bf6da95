import json
import random
import re

import pytest
from pyspark.sql import functions as F

from termloom.functions import gates, normalize, scoring, text
from termloom.operators import annotate, audit, embedding, evaluate, gold, reconcile, scan, search
from termloom.operators.catalog import ConceptCatalog
from termloom.plans import pipeline

CONCEPTS = [
    ("c1", "Proposed Findings of Fact", "Facts that a party proposes.", [], "Proposed Findings of Fact", "Document", ["c9"]), ("c2", "Proposed Conclusions of Law", None, ["Draft Conclusions"], None, "Document", ["c9"]),
    ("c3", "Breach of Warranty Claim", "A claim for breach of a warranty.", ["Warranty Breach"], "Breach of Warranty Claim", "Objectives", ["c8"]), ("c4", "Slovenia", None, [], "Slovenia", "Location", []),
    ("c5", "Auction", "A sale by auction.", [], None, "Event", []), ("c6", "Arbitration Practice", None, ["ADR"], "Arbitration Practice", "Service", ["c8"]), ("c7", "Mediation", None, None, None, "Service", ["c8", "c9"]),
    ("c8", "Disputes", None, [], None, "Service", ["c10"]), ("c9", "Documents", None, [], None, "Document", ["c10"]), ("c10", "Root", None, [], None, "Root", None),
]
SCHEMA = "iri string, label string, definition string, alternative_labels array<string>, preferred_label string, branch string, parent_iris array<string>"


@pytest.fixture(scope="module")
def concepts(spark):
    return spark.createDataFrame(CONCEPTS, SCHEMA)


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first().y


def test_text(spark):
    assert one(spark, "The Law of É-Commerce, a b2b 2nd", text.tokenize) == ["the", "law", "of", "commerce", "nd"]
    assert one(spark, None, text.tokenize) == [] and one(spark, "The Law of Torts and torts", text.content_words) == ["torts"]
    assert one(spark, "Proposed Findings of Fact and Conclusions of Law", text.decompose) == ["Proposed Findings of Fact and Conclusions of Law", "Proposed Findings of Fact", "Proposed Conclusions of Law"]
    assert one(spark, "License and Lease Agreement", text.decompose) == ["License and Lease Agreement", "License Agreement", "Lease Agreement"]
    assert one(spark, " Mediation ", text.decompose) == ["Mediation"] and one(spark, "A and/or B; C", text.decompose) == ["A and/or B; C", "A", "B", "C"]
    assert one(spark, "Commercial Litigation", text.search_terms) == ["Commercial Litigation", "commercial", "litigation", "litigation practice", "litigation service"]
    assert one(spark, "big red dog", text.search_terms) == ["big red dog", "big red", "red dog", "big", "dog", "red"]
    assert one(spark, "a big b2", text.phrase_windows) == ["a big", "a big b2", "big", "big b2"] and one(spark, "", text.phrase_windows) == []


def test_scores(spark, concepts):
    score = lambda q, iri: concepts.filter(F.col("iri") == iri).select(scoring.relevance(F.lit(q), F.col("label"), F.col("definition"), F.col("alternative_labels"), F.col("preferred_label")).alias("s")).first().s
    assert score("auction", "c5") == 99.0 and score("zebra", "c5") == 0.0 and score("  AUCTION ", "c5") == 99.0
    assert score("warranty breach", "c3") == pytest.approx((88 + 55 * 0.12) * (1 - 0.4 / 3), abs=0.06)
    assert score("mediation and arbitration", "c7") == 88.0 * 1.0
    ov = lambda a, b: spark.range(1).select(scoring.word_overlap(F.array(*map(F.lit, a)), F.array(*map(F.lit, b))).alias("o")).first().o
    assert ov(["arbitrate"], ["arbitration"]) == 0.7 and ov(["rule"], ["rules"]) == 0.8 and ov(["a1"], ["a1", "zz"]) == 1.0 and ov(["xx", "yy"], ["xx"]) == 0.5


def test_gates(spark):
    g = lambda q, x, b, s, **k: spark.range(1).select(gates.place_gate(F.lit(q), F.lit(x), F.lit(b), F.lit(s), **k).alias("g")).first().g
    assert tuple(g("sale", "Slovenia", "", 90.0)) == (40.0, True, "place-name demoted (signals=1 < 2)") and g("slovenia", "Slovenia", "", 90.0).reason == "exact-place-name"
    assert g("x", "Other", "Event", 90.0).reason == "not-a-place" and g("x", "Other", "Location", 90.0, signals=2).reason == "corroborated-place" and g("x", "City of Y", "", 90.0, phrases=["city of"]).demoted
    s = lambda q, x, v: spark.range(1).select(gates.short_gate(F.lit(q), F.lit(x), F.lit(v)).alias("g")).first().g
    assert s("action", "Auction", 92.0).demoted and not s("action", "Auction", 95.0).demoted and s("x", "Two Words", 50.0).reason == "not-short"
    k = lambda a, b=None: spark.createDataFrame([(a, b)], "a string, b string").select(gates.source_kind(F.col("a"), F.col("b")).alias("k")).first().k
    assert [k("Title Page"), k("Colophon"), k("Subject Index"), k("Chapter 1", "ISBN 978-0-306-40615-7"), k("Chapter", "The 2024 amendments"), k(None)] == ["front_matter", "front_matter", "back_matter", "metadata", "body", "body"]
    e = lambda v, a: spark.range(1).select(gates.enforce_verdict(F.lit(60.0), F.lit(a), F.lit(v)).alias("e")).first().e
    assert [e("rejected", 80.0), e("confirmed", 80.0), e("boosted", 99.0), e("penalized", 10.0)] == [0.0, 65.0, 85.0, 10.0]


def test_normal_forms(spark):
    assert one(spark, " Größe – ﬁne x ", normalize.label_key) == "grösse - fine x" and one(spark, "A  B", normalize.normal_label) == "A B" and one(spark, None, normalize.label_key) is None
    assert one(spark, "Agreement", normalize.plural_variants) == ["Agreements"] and one(spark, "Tax Policies", normalize.plural_variants)[:2] == ["Tax Policy", "Tax Polici"]
    assert tuple(one(spark, "Bucket: A: B", normalize.compound)) == ("Bucket", ["B", "A: B"]) and one(spark, "a | |b", normalize.pipe_values) == ["a", "b"]
    assert tuple(one(spark, "maybe ? ", normalize.suspect)) == ("maybe", True) and one(spark, "N/A", normalize.is_non_referential)
    base, old, pre = "https://v.example/", ["http://old.example/", "lxf:"], ["lxf", "rel"]
    assert [one(spark, x, lambda c: normalize.normal_iri(c, base, old, pre)) for x in ("lxf:R1x2 ", "lxf:actsFor", "https://v.example/Q ", "plain")] == ["https://v.example/R1x2", None, "https://v.example/Q", None]
    assert one(spark, "rel:suedBy", lambda c: normalize.is_relational(c, base, old, pre)) and one(spark, "a -> b", lambda c: normalize.is_relational(c, base, old, pre))


def test_scan_against_brute_force(spark):
    rng = random.Random(4)
    words = ["Tax", "tax law", "a.b", "É", "law", "b (c)", "(c) x", "x_y"]
    docs = [(n, "".join(rng.choice([*words, " ", " ", ".", "_", "taxes", "\n"]) for _ in range(30))) for n in range(40)] + [(98, None), (99, ""), (100, "tax law " * 2000)]
    pats = spark.createDataFrame([(w, "k") for w in words] + [("--", "none"), (None, "null")], "pattern string, kind string")
    got = sorted((r.doc_id, r.start, r.end, r.pattern) for r in scan.scan(spark.createDataFrame(docs, "doc_id long, text string"), pats).collect())
    word = re.compile(r"\w")
    want = []
    for d, t in docs:
        for w in words:
            for m in re.finditer(f"(?={re.escape(w.lower())})", (t or "").lower()):
                a, b = m.start(), m.start() + len(w)
                if not (a and word.match(t[a - 1])) and not (b < len(t) and word.match(t[b])):
                    want.append((d, a, b, w))
    assert got == sorted(want)


def plain_overlaps(spans):
    """The overlap rule, each span against all kept ones."""
    kept = []
    for s, e in sorted(spans, key=lambda x: (x[0], -x[1])):
        for at, (a, b) in enumerate(kept):
            if (a, b) == (s, e):
                break
            if a < e and s < b and not (a <= s and e <= b) and not (s <= a and b <= e):
                if e - s > b - a:
                    kept[at] = (s, e)
                break
        else:
            kept.append((s, e))
    return sorted(kept)


def test_overlap_rules(spark):
    rng = random.Random(7)
    cases = {n: [(s := rng.randrange(30), s + rng.randrange(1, 12)) for _ in range(rng.randrange(1, 12))] for n in range(10_000)}
    cases[-1] = [(0, 5), (3, 10), (0, 5), (4, 6), (20, 22)]
    df = spark.createDataFrame([(n, s, e, "t") for n, v in cases.items() for s, e in v], "doc_id long, start int, end int, tag string")
    got = {}
    for r in scan.without_overlaps(df).collect():
        got.setdefault(r.doc_id, []).append((r.start, r.end))
    assert {n: sorted(v) for n, v in got.items()} == {n: plain_overlaps(v) for n, v in cases.items()}
    assert plain_overlaps(cases[-1]) == [(3, 10), (4, 6), (20, 22)] and scan.without_overlaps(df.filter("false")).count() == 0


def test_search_loses_no_pair(spark, concepts):
    terms = spark.createDataFrame([(t,) for t in ("Warranty", "law", "a", "sale by", "breach of warranty claims", "findings of fact and x", "medi", "ADR", "Slovenia", "", None, "proposes", "zzz")], "term string")
    got = {(r.term, r.iri): r.score for r in search.scored_pairs(terms, concepts).collect()}
    every = terms.filter("trim(term) <> ''").crossJoin(concepts).select("term", "iri", scoring.relevance(F.col("term"), F.col("label"), F.col("definition"), F.col("alternative_labels"), F.col("preferred_label")).alias("s")).filter("s > 0")
    assert got == {(r.term, r.iri): r.s for r in every.collect()}
    assert [(r.term, r.iri) for r in search.prefix_search(spark.createDataFrame([("pro",), ("WARR",)], "term string"), concepts).orderBy("term", "place").collect()] == [("WARR", "c3"), ("pro", "c1"), ("pro", "c2")]


def test_block_scores_are_those_of_the_expression(spark, concepts):
    from termloom.operators import relevance

    rng = random.Random(6)
    words = "breach warranty claim claims law auction sale mediate arbitration practice proposed fact findings tax lawful warranties draft rule ruling be a of".split()
    more = [(f"x{n:03d}", " ".join(rng.choices(words, k=rng.randrange(0, 5))), rng.choice([None, "", " ".join(rng.choices(words, k=9)) + "."]), [" ".join(rng.choices(words, k=3)), None][: rng.randrange(0, 3)], rng.choice([None, " ".join(rng.choices(words, k=2))]), "B", []) for n in range(150)]
    every = concepts.unionByName(spark.createDataFrame(more, SCHEMA))
    asked = ["Warranty", "law", "a", "sale by", "breach of warranty claims", "findings of fact and x", "medi", "ADR", "Slovenia", "rule", "zzz", " Auction ", *(" ".join(rng.choices(words, k=rng.randrange(1, 5))) for _ in range(40))]
    terms = spark.createDataFrame([(t,) for t in [*asked, "", None, "\u00a0"]], "term string")
    want = terms.filter("trim(term) <> ''").distinct().crossJoin(every).select("term", "iri", scoring.relevance(F.col("term"), F.col("label"), F.col("definition"), F.col("alternative_labels"), F.col("preferred_label")).alias("s")).filter("s > 0")
    ranked = {}
    for r in want.collect():
        ranked.setdefault(r.term, []).append((-r.s, r.iri))
    want = {(t, place): (iri, -s) for t, v in ranked.items() if t.strip() for place, (s, iri) in enumerate(sorted(v)[:7], 1)}
    for most in (1000, 60):
        got = {(r.term, r.place): (r.iri, r.score) for r in relevance.best_concepts(terms, every, 7, most=most).collect()}
        assert got == want


def test_pipeline(spark, concepts):
    q = spark.createDataFrame([("q1", "Proposed Findings of Fact and Conclusions of Law", ""), ("q2", "Action", ""), ("q3", "breach of warranty", "Title Page"), ("q4", "Mediation", None)], "query_id string, term string, section string")
    block = spark.createDataFrame([("mediation", "c7", None)], "surface_term string, blocked_iri string, domain string")
    rows = pipeline.match(q, ConceptCatalog(concepts)).collect()
    by = {}
    for r in sorted(rows, key=lambda r: r.place):
        by.setdefault(r.query_id, []).append(r.iri)
    assert set(by["q1"][:2]) == {"c1", "c2"} and "q2" not in by and "q3" not in by and by["q4"] == ["c7"]
    assert all(r.iri != "c7" for r in pipeline.match(q, ConceptCatalog(concepts), blocklist=block).filter("query_id = 'q4'").collect())
    ranked = spark.createDataFrame([("q", "a", 60.0), ("q", "b", 50.0)], "query_id string, iri string, score double")
    answer = "```json\n" + json.dumps({"judged": [{"iri_hash": "a", "adjusted_score": 99, "verdict": "confirmed"}, {"iri_hash": "b", "adjusted_score": "12"}, {"iri_hash": "b", "adjusted_score": True}, {"iri_hash": "zz", "adjusted_score": 5}, 7]}) + "\n```"
    got = pipeline.parse_judgements(spark.createDataFrame([("q", answer), ("q", "no json")], "query_id string, answer string"), ranked).collect()
    assert [(r.iri, r.score, r.verdict) for r in got] == [("a", 65.0, "confirmed")]


def test_reconcile(spark):
    s = "text string, iri string, label string, definition string, confidence double, ord long"
    d = [("Tax", "t1", "", None, 0.5, 1), ("Law", None, "", None, 0.7, 2), ("Lone", "x", "", None, 0.59, 3), ("Kept", "y", "", None, 0.6, 4), ("Both", "p", "", None, 0.9, 5)]
    m = [("tax", "t1", "", None, 0.8, 1), ("LAW", "l1", "", None, 0.4, 2), ("new", "n", "", None, 0.1, 3), ("both", None, "", None, 0.2, 4)]
    got = {(r.category, r.key, r.iri): round(r.confidence, 6) for r in reconcile.reconcile(spark.createDataFrame(d, s), spark.createDataFrame(m, s)).collect()}
    assert got == {("both_agree", "tax", "t1"): 0.81, ("both_agree", "law", "l1"): 0.715, ("both_agree", "both", "p"): 0.905, ("dictionary_only", "kept", "y"): 0.6, ("model_only", "new", "n"): 0.1}


def test_calibration_and_vectors(spark):
    assert evaluate._pava([(10, 1.0, 1.0), (90, 0.0, 1.0)]) == [(90, 0.5)] and evaluate._pava([(1, 0, 1), (2, 1, 1)]) == [(1, 0.0), (2, 1.0)]
    p = lambda x: spark.range(1).select(evaluate.probability_of(F.lit(x), [(10.0, 0.2), (50.0, 0.7)]).alias("p")).first().p
    assert [p(5.0), p(10.0), p(49.9), p(80.0)] == [0.2, 0.2, 0.2, 0.7]
    steps = evaluate.fit_steps(spark.createDataFrame([(10.0, 2, 0), (20.0, 2, 1), (30.0, 2, 0), (40.0, 1, 1)], "score double, samples long, correct long")).orderBy("x").collect()
    assert [tuple(r) for r in steps] == [(10.0, 0.0), (30.0, 0.25), (40.0, 1.0)]
    v = spark.createDataFrame([(n, [float(n % 3), 1.0]) for n in range(9)] + [(99, None)], "vec_id long, embedding array<float>")
    got = embedding.nearest(v.filter("vec_id = 1").select(F.col("vec_id").alias("query_id"), "embedding"), v, 3).orderBy("place").collect()
    assert [r.vec_id for r in got] == [1, 4, 7] and got[0].cosine == 1.0


def test_gold_and_audit(spark, concepts):
    r = spark.range(1).select(gold.pair_blocks(F.array(F.lit("a"), F.lit("b"), F.lit("c")), F.array(*[F.array(F.lit(x)) for x in "wxyz"])).alias("p")).first().p
    assert r.reading == [["w"], [], ["x", "y", "z"]] and r.ambiguous
    v = spark.createDataFrame([(x,) for x in ("mediation", "Draft  Conclusions", "Disputes: Mediations", "Dispute", "nothing", None)], "value string")
    got = {x.value: (x.iri, x.rung, x.parse) for x in gold.resolve_values(v, concepts, with_compounds=True).collect()}
    assert got == {"mediation": ("c7", "exact_preferred", "plain"), "Draft  Conclusions": ("c2", "normalized_alternative", "plain"), "Disputes: Mediations": ("c7", "lemma_variant", "rhs_last"), "Dispute": ("c8", "lemma_variant", "plain"), "nothing": (None, "unresolved", "unresolved")}
    cells = spark.createDataFrame([("f", "Tax Law", ["b"], None, 1), ("f", "tax  law", ["a"], ["x"], 2), ("f", "Other", ["a"], None, 3), ("f", None, None, None, 4)], "firm string, text string, answers array<string>, flags array<string>, ord long")
    assert [tuple(x) for x in gold.merge_cells(cells).collect()] == [("f", "tax law", "Tax Law", ["a", "b"], ["x"], 2, True)]
    d = audit.fold_decisions(spark.createDataFrame([("i", ["a", "b"]), ("j", None)], "item_id string, gold array<string>"), spark.createDataFrame([("i", "a", "not_gold", 1), ("i", "c", "not_gold", 1), ("i", "c", "gold", 2)], "item_id string, iri string, verdict string, seq long"))
    assert {(x.item_id, tuple(x.after), x.changed) for x in d.collect()} == {("i", ("b", "c"), True), ("j", (), False)}
    spans = spark.createDataFrame([("d", "a", 2, 6, "p", 0.5), ("d", "b", 4, 8, "p", 0.9), ("d", "c", 4, 99, None, 0.7)], "doc_id string, id string, start int, end int, iri string, confidence double")
    seg = annotate.segments(spark.createDataFrame([("d", 10), ("e", 0)], "doc_id string, n int"), spans.filter("id <> 'c'")).orderBy("start").collect()
    assert [(x.start, x.end, x.ids) for x in seg] == [(0, 2, []), (2, 4, ["a"]), (4, 6, ["b"]), (6, 8, ["b"]), (8, 10, [])]


def test_sources_and_streams(spark, tmp_path):
    from termloom.sources import catalog_source, feedback, pinned
    from termloom.streaming import insights

    df = spark.createDataFrame([("a", 1), ("b", 2)], "id string, n long")
    m = pinned.write_version(df, str(tmp_path), "gold", 2)
    assert pinned.latest_version(str(tmp_path), "gold") == m["path"] and pinned.content_hash(df.repartition(3)) == m["content_sha256"]
    assert pinned.read_json_lines(spark, m["path"], "id string, n long", pin=m["content_sha256"], unique="id").count() == 2
    with pytest.raises(ValueError):
        pinned.read_json_lines(spark, m["path"], "id string, n long", pin="0")
    with pytest.raises(Exception):
        pinned.write_version(df, str(tmp_path), "gold", 2)
    assert pinned.read_json_lines(spark, str(tmp_path / "none"), "id string").count() == 0
    store = feedback.FeedbackStore(spark, str(tmp_path / "fb"))
    entry = "id string, job_id string, annotation_id string, rating string"
    store.save(spark.createDataFrame([("e1", "j", "a", "up"), ("e2", "j", "a", "down")], entry))
    store.save(spark.createDataFrame([("e1", "j", "a", "down")], entry))
    assert {r.id: r.rating for r in store.all().collect()} == {"e1": "down", "e2": "down"} and store.delete("e2") and not store.delete("e2")
    assert store.of_annotation("j", "a").first().id == "e1"
    (tmp_path / "c.jsonl").write_text(json.dumps({"iri": "x:1", "preferred_label": "P", "label": 5}) + "\n" + json.dumps({"iri": "y:2", "label": "Q"}) + "\n")
    spark.dataSource.register(catalog_source.ConceptsJson)
    assert [(r.iri, r.label) for r in spark.read.format("concepts_json").option("root", "x:").load(str(tmp_path / "c.jsonl")).collect()] == [("x:1", "P")]
    src = tmp_path / "in"
    spark.createDataFrame([("2024-01-01 10:00:00", "s", "up"), ("2024-01-01 11:00:00", "s", "down"), ("2024-01-09 11:00:00", None, "up")], "ts string, stage string, rating string").selectExpr("cast(ts as timestamp) ts", "stage", "rating").coalesce(1).write.parquet(str(src))
    stream = spark.readStream.schema("ts timestamp, stage string, rating string").parquet(str(src))
    q = insights.windowed_feedback(stream).writeStream.outputMode("complete").format("memory").queryName("fb").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted((r.stage, r.up, r.down) for r in spark.table("fb").collect()) == [("overall", 1, 0), ("s", 1, 1)]
