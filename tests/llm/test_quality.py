import math
import random

from termloom.llm import quality as Q

PROSE = [
    "The receiver has not yet been served. It was the auditor who first told our client about the side letter, even though she had warned them.\n\nNo one was present when they signed it, and that is not how the guardian remembers it.",
    "THE RECEIVER HAS NOT YET BEEN SERVED. IT WAS THE AUDITOR WHO FIRST TOLD OUR CLIENT, AND THAT IS NOT HOW SHE REMEMBERS IT.",
    "Le dossier n'a pas été remis. Il n'est pas établi que la commission l'a communiqué, et notre cliente ne savait rien de tel.",
    "Der Beklagte hat das nie gesehen. Außerdem war niemand anwesend, als der Termin begann, und es wäre besser, sich zu einigen.",
    "No consta que el arrendador lo supiera. Sería mejor llegar a un acuerdo que discutir, y nadie estuvo presente.",
    "1. He said that it could wait until Monday. They had not checked it.\n2. We have been asked whether it would apply, and it was clear that no one had.",
]
JUNK = [
    '"Date","Subject","Party"\n' + "\n".join(f'"2020-01-{d:02d}","Levy","because it was never clear"' for d in range(1, 20)), "\n".join(f"{n}. Orchard Visa Renewals" for n in range(30)), "39897 3 0 3 22222018 93153 " * 30,
    "zxcvbn qwrtp lkjhg fdsmn bvcxz " * 20, "END OF DOCUMENT\n" * 12, "He said that it was not so.\n" * 20, "\n".join(f"the side letter, Gimder.\nthe board minutes within {n} days." for n in range(15)),
    "\n\n".join(f"Date: 2020-01-0{n}\nSubject: Levy\nAmount: 3{n}.5" for n in range(1, 9)), "the of and to no in that it was for not the of was and an is of the to it on the in a by of he that the and of not is to was the a of " * 3, "A" * 4000, "□■?�" * 50,
]


def test_profiles():
    for t in PROSE:
        assert Q.statistics(t)["profile"] == "prose", t
    for t in JUNK:
        assert Q.statistics(t)["profile"] != "prose", t[:60]


def test_divergence():
    assert Q.divergence([1, 0], [0, 1]) == 1.0 and Q.divergence([2, 2], [1, 1]) == 0.0
    p, q = [0.2, 0.3, 0.5], [0.5, 0.25, 0.25]
    m = [(a + b) / 2 for a, b in zip(p, q)]
    want = sum(a * math.log2(a / c) + b * math.log2(b / c) for a, b, c in zip(p, q, m)) / 2
    assert abs(Q.divergence(p, q) - want) < 1e-12


def test_rows(spark):
    rows = [(1, PROSE[0], "c"), (2, JUNK[1], "c"), (3, None, "c"), (4, "", "c"), (5, " \n\t​ ", "c"), (6, "word " * 60_000, "c"), (6, "word " * 60_000, "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, words string")
    got = {r.doc_id: r for r in Q.text_statistics(df).collect()}
    assert len(got) == 6 and got[3].profile is None and got[5]["words"] == 0 and got[4].lines == 0
    assert got[1].ended_lines == 1.0 and got[1].language == "en" and got[2].ended_lines == 0.0 and got[6]["words"] == 60_000
    assert sorted(r.doc_id for r in Q.not_prose(df).collect()) == [2, 6, 6]
    assert Q.not_prose(df.filter("false")).count() == 0


def test_long_sentences_are_prose():
    clause = "the seller must give the buyer a list of the goods that have not been delivered, and the buyer may ask for a lower price if any of them were damaged on the way"
    for n in (1, 2, 4, 12):
        assert Q.statistics("; and ".join([clause] * n).capitalize() + ".")["profile"] == "prose"


def test_divergences_agree_with_one_by_one():
    import numpy as np

    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 5, (6, 7)).astype(float), rng.random((4, 7))
    a[0] = 0
    got = Q.divergences(a, b)
    for i in range(1, 6):
        for j in range(4):
            p, q = a[i] / a[i].sum(), b[j] / b[j].sum()
            want = sum((x * math.log2(2 * x / (x + y)) if x else 0) + (y * math.log2(2 * y / (x + y)) if y else 0) for x, y in zip(p, q)) / 2
            assert abs(got[i, j] - want) < 1e-9


def test_every_language_has_its_own_profile():
    for g, text in Q.PROSE.items():
        got = Q.statistics(text)
        assert got["language"] == g and got["profile"] == "prose"
    own = [Q.divergence(Q.WORD_PROFILES[i], Q.WORD_PROFILES[j]) for i in range(4) for j in range(i)]
    assert min(own) > 0.005
    for g, text in Q.ENTRIES.items():
        assert Q.statistics(text)["profile"] == "list"
    words = [w for w in Q.PROSE["en"].replace(".", " ").replace(",", " ").lower().split()]
    random.Random(1).shuffle(words)
    assert Q.statistics(" ".join(words))["profile"] != "prose"
