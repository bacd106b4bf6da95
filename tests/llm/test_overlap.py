import random

import pytest

from termloom.llm import overlap as O

SCHEMA = "item_id string, leaf string, slice string, blank boolean, workbook string, id string"


def brute(rows):
    sides = {(i, s == "tune", tuple(O.canonical_words(x))) for i, x, s, b, *_ in rows if not b and s in ("tune", "frozen", "firm2") and i is not None and O.canonical_words(x)}
    train, evaluation = [r for r in sides if r[1]], [r for r in sides if not r[1]]
    return {(min(a, b), max(a, b)) for a, _, x in train for b, _, y in evaluation if a == b or O.nearly_same(list(x), list(y))}


def test_near_rules():
    w = O.canonical_words
    same = lambda a, b: O.nearly_same(w(a), w(b))
    base = "Ronkemgim and Rontelbir Farfar Visa Assessments Section 12"
    for other in ("visa assessment of RONKEMGIM & Rontélbir Farfar, Section 12", "Ronkemgim and Rontelbir Farfra Visa Asessments Section 12", "Ronkem gim and Rontelbir Farfar Visa Assessments Section 12", "Farfar Visa Assessments Section12 Ronkemgim Rontelbir"):
        assert same(base, other), other
    for other in ("Ronkemgim and Rontelbir Farfar Visa Assessments Section 13", "Ronkemgim and Rontelbir Farfar Visa Hearings Section 12", "Ronkemgim and Rontelbir Farfar Visa Assessments", "Rnkemgim and Rontlbir Frfar Visa Assessments Section 12"):
        assert not same(base, other), other
    assert all(w(x) == [] for x in (None, "", " ", "Other", "N/A", "TBD", "none", "the of", "-"))


@pytest.mark.parametrize("pairs", [2_500, 0])
def test_pairs_against_all_pairs(spark, pairs, monkeypatch):
    monkeypatch.setattr(O, "BUCKET_PAIRS", pairs)
    rng = random.Random(9)
    names = ["".join(rng.choice(["kat", "mul", "nav", "rep", "dot"]) for _ in range(3)) for _ in range(8)]

    def leaf():
        t = f"{rng.choice(names)} and {rng.choice(names)} {rng.choice(['Visa', 'Tariff'])} {rng.choice(['Claims', 'Audits'])} {rng.choice(['', 'Lot 3', 'Lot 4'])}"
        for _ in range(rng.choice([0, 0, 1, 2, 3])):
            k = rng.randrange(len(t) - 1)
            t = rng.choice([t[:k] + t[k + 1 :], t[:k] + "x" + t[k:], t[:k] + t[k + 1] + t[k] + t[k + 2 :]])
        return t

    rows = [(f"i{rng.randrange(130):03d}", rng.choice([leaf(), leaf(), leaf(), "Other", None]), rng.choice(["tune", "frozen", "firm2", None]), rng.random() < 0.05, f"w{n % 3}", "c") for n in range(160)]
    rows += [(None, "a b c", "tune", False, "w", ""), ("long", "word " * 4000, "tune", None, "w", "")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert {tuple(r) for r in O.found_pairs(df).collect()} == brute(rows)
    if pairs:
        rep = O.report(df).collect()
        assert sum(r["items"] for r in rep) == len({(i, s, w) for i, _, s, b, w, _ in rows if not b and s in ("frozen", "firm2") and i})
        assert all(r.same + r.nearly <= r["items"] for r in rep)


def test_empty(spark):
    assert O.found_pairs(spark.createDataFrame([], SCHEMA)).count() == 0
