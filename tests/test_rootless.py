"""Descendants and subtree sizes of nodes that have no root above them."""

import pytest

from termloom.operators import hierarchy as H
from termloom.plans import hierarchy_queries as Q

ROWS = "iri string, label string, definition string, parent_iri string, loaded_at timestamp"
PARENTS = {"r": None, "r1": "r", "r2": "r1", "o": "gone", "o1": "o", "o2": "o1", "o3": "o1", "self": "self", "s1": "self", "s2": "s1"}
PARENTS |= {f"c{i}": f"c{(i + 1) % 5}" for i in range(5)} | {"u": "c1", "u1": "u", "u2": "u1", "u3": "u"} | {f"d{i}": f"d{i - 1}" if i else "lost" for i in range(7)}


def brute():
    out = {}
    for k in PARENTS:
        at, n, seen = PARENTS[k], 1, {k}
        while at in PARENTS and at not in seen:
            out[(at, k)] = n
            seen.add(at)
            at, n = PARENTS[at], n + 1
    return out


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("nodes"))
    spark.createDataFrame([(f"x:{k}", k, None, p and f"x:{p}", None) for k, p in PARENTS.items()], ROWS).write.parquet(f"{d}/taxonomy_nodes.parquet")
    return d


def test_all_nodes_below_each_node(spark, tables):
    rows = Q.p1_descendants(spark, tables).collect()
    assert {(r.ancestor, r.key): r.distance for r in rows} == brute()
    assert len(rows) == len(brute())


def test_subtree_sizes_without_root(spark, tables):
    got = {r.key: r.subtree_size for r in Q.p1_hierarchy(spark, tables).collect()}
    assert got == {k: 1 + sum(a == k for a, _ in brute()) for k in PARENTS}


def test_no_rootless_nodes(spark):
    tree = H.expand(spark.createDataFrame([("a", "a", None), ("b", "b", "a")], "key string, label string, parent string"))
    assert H.rootless_descendants(tree).count() == 0
