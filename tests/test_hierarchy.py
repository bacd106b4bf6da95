import random
from datetime import datetime

import pytest

from termloom.operators import hierarchy as H

NODES = "key string, label string, parent string"


def brute(rows):
    parent, label = {k: p for k, _, p in rows}, {k: x for k, x, _ in rows}
    out = {}
    for k in parent:
        path, at, seen, status = [], parent[k], {k}, "root"
        while at is not None:
            if at in seen:
                status = "cycle"
                break
            if at not in parent:
                status = "orphan"
                break
            path.append(at)
            seen.add(at)
            at = parent[at]
        path = path[::-1]
        out[k] = (status, (path or [k])[0], len(path), path, [label[p] for p in path]) if status == "root" else (status, None, None, None, None)
    return out


@pytest.mark.parametrize("tail", [0, 6, 10_000])
def test_expand_against_brute_force(spark, tail):
    rng = random.Random(tail)
    rows = [(f"n{i}", f"L{i % 7}", None if i % 11 == 0 else f"n{rng.randrange(i)}" if i > 3 else None) for i in range(60)]
    rows += [(f"c{i}", "c", f"c{(i + 1) % 3}") for i in range(3)] + [("self", "s", "self"), ("under", "u", "c1"), ("under2", "u", "under"), ("o1", "o", "gone"), ("o2", "o", "o1")]
    rows += [(f"d{i}", f"d{i}", f"d{i - 1}" if i else None) for i in range(6)]
    got = {r.key: (r.status, r.root, r.depth, r.path_keys, r.path_labels) for r in H.expand(spark.createDataFrame(rows, NODES), tail_nodes=tail).collect()}
    assert got == brute(rows)
    if tail == 0:
        return
    pairs = {(r.ancestor, r.key, r.distance) for r in H.descendants(H.expand(spark.createDataFrame(rows, NODES), tail_nodes=tail)).collect()}
    want = {(a, k, len(v[3]) - i) for k, v in brute(rows).items() if v[0] == "root" for i, a in enumerate(v[3])}
    assert pairs == want


def test_subtree_sizes(spark):
    rows = [("a", "a", None), ("b", "b", "a"), ("c", "c", "a"), ("d", "d", "b")]
    for tail in (0, 100):
        got = {r.key: r["size"] for r in H.expand(spark.createDataFrame(rows, NODES), tail_nodes=tail).collect()}
        assert got == {"a": 4, "b": 2, "c": 1, "d": 1}


def test_latest_row_and_spellings(spark):
    t = lambda d: datetime(2024, 1, d)
    rows = [
        ("https://v.example/R1", "old", None, "", t(1)), (" <http://www.old.example/R1/> ", "new", None, "lxf:R2", t(2)), ("LXF:R2", "two", None, " ", None),
        (None, "x", None, None, t(1)), ("  ", "x", None, None, t(1)), ("lxf:R1 ", "older", None, None, None),
    ]
    got = sorted((r.key, r.label, r.parent) for r in H.latest_nodes(spark.createDataFrame(rows, "iri string, label string, definition string, parent_iri string, loaded_at timestamp")).collect())
    assert got == [("R1", "new", "R2"), ("R2", "two", None)]


def test_empty(spark):
    assert H.expand(spark.createDataFrame([], NODES)).count() == 0
    assert H.descendants(H.expand(spark.createDataFrame([], NODES))).count() == 0


def test_paths_compare_loosely(spark):
    taxonomy = [("x:R1", "Tax – Customs", None, None, None), ("x:R2", "Großer ﬁling", None, "x:R1", None), ("x:R3", "leaf", None, "x:R2", None), ("x:A", "a", None, "x:B", None), ("x:B", "b", None, "x:A", None), ("x:O", "o", None, "x:none", None)]
    items = [
        ("ok", ["TAX -  customs ", "grosser filing"], ["x:R3"]), ("bad", ["Tax - Customs"], ["x:R3"]), ("empty", [], ["x:R3"]), ("nullpath", None, ["x:R3"]), ("nogold", ["q"], []), ("nullgold", ["q"], None),
        ("nul", [None, "b"], ["x:R3"]), ("cyc", ["q"], ["x:A"]), (None, ["q"], ["x:R3"]),
    ]
    tax = spark.createDataFrame(taxonomy, "iri string, label string, definition string, parent_iri string, loaded_at timestamp")
    gold = spark.createDataFrame(items, "item_id string, ancestor_path array<string>, gold_iris array<string>").withColumnRenamed("x", "x")
    got = {(r.kind, r.record_key) for r in H.found_cases(tax, gold).collect()}
    v = "https://vocab.lexifold.example/"
    assert got == {("cycle", v + "A"), ("cycle", v + "B"), ("orphan", v + "O"), ("path", "bad"), ("path", "nul")}
