import itertools
import random

from termloom.llm.canonical import Reference, entry_names, found, resolve
import numpy as np

from termloom.llm.words import BKTree, EntryTree, Spellings, StringTree, edits, pairing, slips, _hungarian

CONCEPTS = [
    ("https://v.example/R1", "Contested Tariff Agreements", ["Contested Tariff Contracts", "KX-1207"]), ("https://v.example/R2", "Břesnov Merger Investigations", []),
    ("https://v.example/R3", "Merger Valuations", None), ("https://v.example/R4", "Library Penalties", ["Library Fines"]), ("https://v.example/R5", "Cross-Border Trespass Renewals", ["LV-9"]),
]
CASES = {
    "Contested Tariff Agreements": 1, " contested  TARIFF agreement ": 1, "Agreements, Conntested Tatriff": 1, "Cntstd trff agrmnts": 1, "Contes. Tariff Agmts": 1, "Event: Tariff Agreements (Contested)": 1, "kx 1207": 1, "KX1207": 1, "12. Contested Tariff Agreements [old term]": 1,
    "ContestedTariffAgreements": 1, "contestedtariffagreements": 1, "<https://v.example/R1/>": 1, "lxf:R1": 1, "BÅ™esnov Merger Investigation": 2, "investigation of bresnov merger": 2, "Merger Valutaions": 3, "library penalty": 4, "Fines - Library": 4, "cross border trespass renewals": 5,
    "Contested Tariff Valuations": None, "Merger Agreements": None, "KX-1208": None, "https://v.example/R99": None, "rel:suedBy": None, "?": None, "see notes": None, "Carpet calendar": None, "Tariff Agreements": None, "Contested Merger Agreements": None, "qwertyuiopasdfgh": None,
}


def concepts(spark):
    return spark.createDataFrame([(i, x, x, a) for i, x, a in CONCEPTS], "iri string, label string, preferred_label string, alternative_labels array<string>")


def test_cases(spark):
    ref = Reference([(i, [x, *(a or [])]) for i, x, a in CONCEPTS])
    got = {t: (r[1][-1] if (r := ref.resolve(t)) else None) for t in CASES}
    assert got == {t: (str(n) if n else None) for t, n in CASES.items()}


def test_shards_agree_and_rows_stay(spark):
    rows = [(n, t, "x") for n, t in enumerate([*CASES, None, "", "  ", "word " * 3000])] * 2
    df = spark.createDataFrame(rows, "id long, text string, cost string").select("id", "text")
    one = sorted(map(tuple, resolve(df.distinct(), entry_names(concepts(spark))).collect()))
    many = sorted(map(tuple, resolve(df.distinct(), entry_names(concepts(spark)), most=2 * 2).collect()))
    assert one == many and len(one) == len(CASES) + 4


def test_found_rows(spark):
    values = [(1, "Merger Valuations", None, None), (1, "Merger Valuations", None, None), (2, " ", None, None), (3, None, None, None), (4, "Library Fines", "https://v.example/R4", None), (None, "Library Fines", None, None), (5, "nothing here", None, None)]
    proposals = [(1, "Library Fines", None, None), (2, None, None, None), (3, "x", "y", None)]
    got = {tuple(r) for r in found(spark.createDataFrame(values, "value_id long, raw string, iri string, loaded_at timestamp"), spark.createDataFrame(proposals, "proposal_id long, label string, iri string, proposed_at timestamp"), concepts(spark)).collect()}
    assert got == {("value", 1, "https://v.example/R3"), ("value", 5, "none"), ("proposal", 1, "https://v.example/R4")}


def test_bk_tree_finds_all_within_radius():
    rng = random.Random(5)
    words = {"".join(rng.choice("abc") for _ in range(rng.randrange(1, 8))) for _ in range(200)}
    tree = BKTree(sorted(words))
    for _ in range(60):
        q = "".join(rng.choice("abcd") for _ in range(rng.randrange(0, 8)))
        for r in (0, 1, 2):
            assert {w for _, w in tree.within(q, r)} == {w for w in words if plain(q, w) <= r}
            assert all(edits(q, w) == plain(q, w) for w in words)


def plain(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_slips_count_swaps_once():
    assert slips("tariff", "tairff") == 1 and slips("tariff", "tariff") == 0 and slips("abc", "xyz") == 3 and slips("a", "abcdef") == 3


def test_answers_do_not_depend_on_shards(spark):
    entries = [("x:1", ["Patent Filing"]), ("x:2", ["Foreign Filling"]), ("x:3", ["Widow Agreements"]), ("x:4", ["Overland Terminations"]), ("x:5", ["Orchard Transfers"])]
    ref = spark.createDataFrame(entries, "iri string, names array<string>")
    texts = ["foreign filing", "patent filling", "Patent Filnig", "Forign Filling", "Widow Agreements [old term]", "agmts, widow", "Orchard Trnasfesr", "Overland Termiantions (?)", None]
    df = spark.createDataFrame([(n, t, "kept") for n, t in enumerate(texts)], "id long, text string, iri string")
    want = {0: "none", 1: "none", 2: "x:1", 3: "x:2", 4: "x:3", 5: "x:3", 6: "x:5", 7: "x:4", 8: "none"}
    for most in (100, 4, 2):
        assert {r.id: r.iri for r in resolve(df, ref, most=most).collect()} == want


def test_spellings_measure_all_words_at_once():
    rng = random.Random(7)
    words = sorted({"".join(rng.choice("abcd") for _ in range(rng.randrange(1, 12))) for _ in range(150)} | {"ab" * 50, "b" * 63})
    s = Spellings(words)
    for q in ["", "abab", "ab" * 49 + "c", *("".join(rng.choice("abcde") for _ in range(rng.randrange(1, 14))) for _ in range(40))]:
        assert s.row(q).tolist() == [plain(q, w) for w in words]


def test_entry_tree_finds_every_entry_within_the_threshold():
    rng = random.Random(3)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randrange(2, 6))) for _ in range(40)})
    s = Spellings(words)
    for n in (1, 2, 3):
        entries = np.array(sorted({tuple(sorted(rng.randrange(len(words)) for _ in range(n))) for _ in range(150)}), np.int32)
        tree = EntryTree(entries, s)
        low = np.stack([s.row("".join(rng.choice("abc") for _ in range(4))) for _ in range(20)])
        high = low.copy()
        low[:5] = np.minimum(low[:5], s.row("ab"))
        high[:5] = np.maximum(high[:5], s.row("ab"))
        queries = np.array([[rng.randrange(20) for _ in range(n)] for _ in range(60)], np.int32)
        radius = np.array([rng.randrange(4) for _ in queries], np.int32)
        got = sorted(tree.within(low, high, queries, radius))
        want = sorted((q, e) for q, t in enumerate(queries) for e, w in enumerate(entries) if min(sum(low[a, b] for a, b in zip(t, p)) for p in itertools.permutations(w)) <= radius[q])
        assert got == want


def test_pairing():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 5):
        cost = rng.integers(0, 20, (30, n, n))
        want = [min(sum(c[i][j] for i, j in enumerate(p)) for p in itertools.permutations(range(n))) for c in cost]
        assert pairing(cost).tolist() == want == [_hungarian(c.tolist()) for c in cost]


def test_string_tree_finds_every_string_within_the_radius():
    rng = random.Random(11)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randrange(1, 10))) for _ in range(200)} | {"ab" * 50, "b" * 63, "b" * 64})
    tree = StringTree(words)
    asked = ["ab" * 49 + "c", "b" * 65, "", *("".join(rng.choice("abcd") for _ in range(rng.randrange(1, 11))) for _ in range(50))]
    asked = sorted(set(asked))
    for r in (0, 2, 4):
        assert sorted(tree.within(asked, r)) == sorted((q, w) for q in asked for w in words if plain(q, w) <= r)
    assert list(StringTree([]).within(["a"], 2)) == []
