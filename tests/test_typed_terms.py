"""The term queries run over what was typed, not over words of the catalog."""

import pytest
from pyspark.sql import functions as F

from termloom.functions.scoring import relevance
from termloom.plans import resolution_queries as Q

CONCEPT = "iri string, label string, definition string, alternative_labels array<string>, preferred_label string, branch string, parent_iris array<string>"
CONCEPTS = [
    ("x:R1", "Commercial Litigation", "disputes between merchants", ["COMLIT"], None, "Area", []),
    ("x:R2", "Maritime Notice", "notice about a vessel", [], "Maritime Notice", "Document", ["x:R1"]),
    ("x:R3", "Élan Charter", None, ["charter of élan"], None, "Document", ["x:R2"]),
    ("x:R4", "Water Permit", "permit to draw water", [], None, "Document", []),
]
TYPED = ["Comercial Litigation", "maritime not.", "** Water Permit (copy) **", "Élan Charter", "Elan Charter", "Water Permit and Maritime Notice", "a very long text that somebody typed about the water permit of a vessel", "Permit"]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("typed"))
    spark.createDataFrame(CONCEPTS, CONCEPT).write.parquet(f"{d}/concepts.parquet")
    labels = [(x,) for x in [*TYPED, TYPED[0], None, "", "  ", "\t"]]
    spark.createDataFrame(labels, "label string").write.parquet(f"{d}/label_proposals.parquet")
    return d


def test_every_typed_label_is_a_term(spark, tables):
    assert sorted(r.term for r in Q._terms(spark, tables).collect()) == sorted(TYPED)
    assert {r.term for r in Q.search_terms_expand(spark, tables).select("term").collect()} == set(TYPED)


def _brute(spark, tables):
    """Every term scored against every concept, without blocking."""
    c = spark.read.parquet(f"{tables}/concepts.parquet")
    t = spark.createDataFrame([(x,) for x in TYPED], "term string")
    score = relevance(F.col("term"), F.col("label"), F.col("definition"), F.col("alternative_labels"), F.col("preferred_label"))
    rows = t.crossJoin(c).select("term", "iri", score.alias("score")).filter("score > 0").collect()
    out = {}
    for r in sorted(rows, key=lambda r: (-r.score, r.iri)):
        out.setdefault(r.term, []).append((r.iri, r.score))
    return out


def test_search_and_resolver_against_brute_force(spark, tables):
    want = _brute(spark, tables)
    got = {}
    for r in sorted(Q.label_search_topk(spark, tables).collect(), key=lambda r: r.place):
        got.setdefault(r.term, []).append((r.iri, r.score))
    assert got == want
    resolved = {(r.term, r.iri): r.score for r in Q.label_resolver(spark, tables).collect()}
    assert all(s >= 92 for s in resolved.values())
    whole = {(t, hits[0][0]) for t, hits in want.items() if hits[0][1] >= 92 and " and " not in t}
    assert whole == {k for k in resolved if " and " not in k[0]}
    assert {i for t, i in resolved if " and " in t} == {"x:R2", "x:R4"}
