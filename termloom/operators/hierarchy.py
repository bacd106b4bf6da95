"""Parent-child rows to full hierarchies by leaf peeling (problem 1)."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from termloom.functions.keys import iri_key, simple_heading
from termloom.runtime import cut, hot_keys, salted_join

#: Where at most so many nodes are left unpeeled, one task finishes them; above that, rounds go on as shuffles.
TAIL_NODES = 50_000

ASSIGNED = "key string, status string, root string, depth int, path_keys array<string>, path_labels array<string>"


def latest_nodes(rows: DataFrame, time: str | None = "loaded_at") -> DataFrame:
    """One row per node: key, label, parent. Of several rows of a node the one with the latest ``time`` holds (a null time
    is earliest; equal times: the greatest parent, then label). Rows whose IRI is null or blank name no node."""
    parsed = rows.select(iri_key(F.col("iri")).alias("key"), F.col("label").alias("label"), iri_key(F.col("parent_iri")).alias("parent"), (F.col(time) if time else F.lit(0)).alias("at"))
    order = F.struct(F.col("at"), F.coalesce("parent", F.lit("")), F.coalesce("label", F.lit("")))
    return parsed.filter(F.col("key").isNotNull()).groupBy("key").agg(F.max_by(F.struct("label", "parent"), order).alias("n")).select("key", "n.label", "n.parent")


def _finish_tail(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Peels what is left in one task. Gets whole upper parts of the trees: with a node all its ancestors are here."""
    frames = [b for b in batches if len(b)]
    if not frames:
        return
    rows = pd.concat(frames, ignore_index=True)
    parent = dict(zip(rows["key"], rows["parent"]))
    label = dict(zip(rows["key"], rows["label"]))
    pending = {k: int(n) for k, n in zip(rows["key"], rows["pending"])}
    size = {k: int(n) for k, n in zip(rows["key"], rows["size"])}
    ready, order = [k for k, n in pending.items() if n == 0], []
    while ready:
        later = []
        for k in ready:
            order.append(k)
            up = parent[k]
            if up in pending:
                size[up] += size[k]
                pending[up] -= 1
                if pending[up] == 0:
                    later.append(up)
        ready = later
    columns = ["key", "size", "status", "root", "depth", "path_keys", "path_labels"]
    peeled = set(order)
    above: dict[str, tuple] = {k: ("cycle", None, None) for k in parent if k not in peeled}  # status, root, depth
    out = [(k, size[k], "cycle", None, None, None, None) for k in above]
    held = len(out)
    for k in reversed(order):
        up = parent[k]
        if up is None:
            got = ("root", k, 0)
        elif up not in parent:
            got = ("orphan", None, None)
        else:
            s, root, depth = above[up]
            got = ("root", root, depth + 1) if s == "root" else (s, None, None)
        above[k] = got
        keys: list[str] | None = None
        if got[0] == "root":  # paths are written as they are met, never kept
            keys = []
            while up is not None:
                keys.append(up)
                up = parent[up]
            keys.reverse()
        out.append((k, size[k], *got, keys, None if keys is None else [label[x] for x in keys]))
        held += 1 + len(keys or ())
        if held >= 200_000:
            yield _frame(out, columns)
            out, held = [], 0
    if out:
        yield _frame(out, columns)


def _frame(rows: list[tuple], columns: list[str]) -> pd.DataFrame:
    pdf = pd.DataFrame(rows, columns=columns)
    pdf["depth"] = pdf["depth"].astype("Int32")
    return pdf


def expand(nodes: DataFrame, tail_nodes: int = TAIL_NODES, with_keys: bool = True) -> DataFrame:
    """Full hierarchy of ``nodes`` (key, label, parent; unique keys).

    Returns key, label, parent, status, root, depth, path_keys, path_labels, size. status: 'root' (a root is above it or it
    is one), 'orphan' (the way up ends at a parent that isn't in the table), 'cycle' (the way up never ends). Only 'root'
    rows have root, depth (0 for a root) and the paths from the root down to the parent. size counts the node and the nodes
    below it that were peeled; a node on a cycle counts those hanging off it. Without ``with_keys`` path_keys is null and
    nothing carries it.

    Each round peels the nodes without unpeeled children, sends their subtree sizes to their parents (counts and sums are
    combined before the shuffle, so a parent with millions of children is no hot spot) and keeps the shrinking rest. In
    reverse order each peeled level then takes path, depth and root from its parents. What peeling leaves over lies on a
    cycle. An empty table gives an empty result; a node that is its own parent is a cycle."""
    spark = nodes.sparkSession
    base = cut(nodes.select("key", "label", "parent"))  # read by the counts, the join and the rounds
    known = base.select(F.col("key").alias("parent"), F.lit(True).alias("has_parent"))
    children = (base.filter("parent is not null").groupBy(F.col("parent").alias("key")).agg(F.count(F.lit(1)).alias("pending")))
    hot = hot_keys(children, "key", "pending")
    counted = base.join(children, "key", "left").select("key", "label", "parent", F.coalesce("pending", F.lit(0)).cast("long").alias("pending"), F.lit(1).cast("long").alias("size"))
    # roots have no parent to look for; children of a parent with a large share of all nodes are spread
    below = salted_join(counted.filter("parent is not null"), known, "parent", hot, F.col("key"), "left").withColumn("has_parent", F.coalesce("has_parent", F.lit(False)))
    live = below.unionByName(counted.filter("parent is null").withColumn("has_parent", F.lit(False)))
    live = cut(live)
    levels: list[DataFrame] = []
    while True:
        left, ready = live.agg(F.count(F.lit(1)), F.count_if(F.col("pending") == 0)).first()
        if left <= tail_nodes or ready == 0:
            break
        peeled = live.filter("pending = 0")
        levels.append(peeled)
        sent = peeled.filter("has_parent").groupBy(F.col("parent").alias("key")).agg(F.count(F.lit(1)).alias("_n"), F.sum("size").alias("_s"))
        live = cut(
            live.filter("pending > 0")
            .join(sent, "key", "left")
            .select("key", "label", "parent", (F.col("pending") - F.coalesce("_n", F.lit(0))).alias("pending"), (F.col("size") + F.coalesce("_s", F.lit(0))).alias("size"), "has_parent")
        )
    if left <= tail_nodes:
        top = live.select("key", "label", "parent", "pending", "size").coalesce(1).mapInPandas(_finish_tail, "key string, size long, status string, root string, depth int, path_keys array<string>, path_labels array<string>")
    else:
        top = live.select("key", "size", F.lit("cycle").alias("status"), F.lit(None).cast("string").alias("root"), F.lit(None).cast("int").alias("depth"), F.lit(None).cast("array<string>").alias("path_keys"), F.lit(None).cast("array<string>").alias("path_labels"))
    if not with_keys:
        top = top.withColumn("path_keys", F.lit(None).cast("array<string>"))
    top = top.join(live.select("key", "label", "parent"), "key")
    columns = ["key", "label", "parent", "status", "root", "depth", "path_keys", "path_labels", "size"]
    if not levels:
        return top.select(*columns)
    parts = [cut(top.select(*columns))]
    for level in reversed(levels):
        above = parts[0]
        for p in parts[1:]:
            above = above.unionByName(p)
        up = above.select(F.col("key").alias("parent"), F.col("status").alias("_st"), F.col("root").alias("_r"), F.col("depth").alias("_d"), F.col("path_keys").alias("_pk"), F.col("path_labels").alias("_pl"), F.col("label").alias("_l"))
        got = salted_join(level.filter("has_parent"), up, "parent", hot, F.col("key"))
        rooted = F.col("_st") == "root"
        below = got.select(
            "key", "label", "parent", F.col("_st").alias("status"), F.when(rooted, F.col("_r")).alias("root"), F.when(rooted, F.col("_d") + 1).alias("depth"),
            (F.when(rooted, F.concat("_pk", F.array("parent"))) if with_keys else F.lit(None).cast("array<string>")).alias("path_keys"), F.when(rooted, F.concat("_pl", F.array("_l"))).alias("path_labels"), "size",
        )
        is_root = F.col("parent").isNull()
        empty = F.array().cast("array<string>")
        ends = level.filter("not has_parent").select(
            "key", "label", "parent", F.when(is_root, "root").otherwise("orphan").alias("status"), F.when(is_root, F.col("key")).alias("root"), F.when(is_root, F.lit(0)).alias("depth"),
            (F.when(is_root, empty) if with_keys else F.lit(None).cast("array<string>")).alias("path_keys"), F.when(is_root, empty).alias("path_labels"), "size",
        )
        parts.append(cut(below.unionByName(ends)) if level is not levels[0] else below.unionByName(ends))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(*columns)


def descendants(expanded: DataFrame) -> DataFrame:
    """All pairs (ancestor, key, distance) of a tree: the descendant list of every node, as rows, so that a root with
    millions of nodes below it never becomes one array."""
    return expanded.filter("status = 'root' and depth > 0").select("key", "depth", F.posexplode("path_keys").alias("_i", "ancestor")).select("ancestor", "key", (F.col("depth") - F.col("_i")).cast("int").alias("distance"))


def rootless_descendants(expanded: DataFrame) -> DataFrame:
    """The pairs (ancestor, key, distance) that ``descendants`` leaves out: those of nodes with no root above them. On and below a cycle the
    distance is the smallest number of steps; a node on a cycle is no descendant of itself, but all others on the cycle are.

    Rounds double the reach: each has every node's ancestors up to 2^k steps and joins them with those of the farthest one, so a chain of n
    nodes takes log2 n rounds and a cycle stops once its nodes meet again."""
    rest = cut(expanded.filter("status <> 'root'").select("key", "parent"))
    up = rest.filter("parent is not null and parent <> key").join(rest.select(F.col("key").alias("parent")), "parent", "left_semi")
    reach = cut(up.select(F.col("parent").alias("ancestor"), "key", F.lit(1).alias("distance")))
    pairs, far = reach.count(), 1
    while True:
        last = reach.filter(F.col("distance") == far).select("key", F.col("ancestor").alias("via"))
        more = last.join(reach.select(F.col("key").alias("via"), "ancestor", "distance"), "via").select("ancestor", "key", (F.col("distance") + far).alias("distance"))
        longer = cut(reach.unionByName(more.filter("ancestor <> key")).groupBy("ancestor", "key").agg(F.min("distance").alias("distance")))
        n = longer.count()
        if n == pairs:
            return longer.select("ancestor", "key", F.col("distance").cast("int").alias("distance"))
        reach, pairs, far = longer, n, far * 2


_DASH = re.compile(r"[‐-―\u2212\u00ad֊⁃﹘﹣－⸺⸻]")
_ZERO = re.compile(r"[\u200b\u200c\u200d\u2060\ufeff]")


def compare_heading(text: str | None) -> str:
    """A heading as problem 1 compares it: without letter case, compatibility forms, kind of dash and white space."""
    s = _ZERO.sub("", unicodedata.normalize("NFKC", _DASH.sub("-", text or "")))
    return " ".join(_DASH.sub("-", s).split()).casefold()


@F.pandas_udf(T.BooleanType())
def _paths_differ(found: pd.Series, real: pd.Series) -> pd.Series:
    cache: dict = {}

    def norm(s):
        if s not in cache:
            if len(cache) > 200_000:
                cache.clear()
            cache[s] = compare_heading(s)
        return cache[s]

    return pd.Series([[norm(x) for x in a] != [norm(x) for x in b] for a, b in zip(found, real)], dtype=bool)


def contradicting_paths(items: DataFrame, expanded: DataFrame) -> DataFrame:
    """item_id of rows whose non-empty ancestor_path isn't the path of the node their first gold_iris entry names. Rows
    without gold_iris are no cases, nor are rows whose node isn't in the table or has no root: nothing is contradicted."""
    rows = items.filter("item_id is not null and size(gold_iris) > 0 and size(ancestor_path) > 0").select("item_id", "ancestor_path", iri_key(F.element_at("gold_iris", 1)).alias("key"))
    real = expanded.filter("status = 'root'").select("key", "path_labels")
    joined = rows.join(real, "key")
    fold = lambda a: F.transform(a, simple_heading)
    suspects = joined.filter(fold(F.col("ancestor_path")) != fold(F.col("path_labels")))  # only these need NFKC
    return suspects.filter(_paths_differ("ancestor_path", "path_labels")).select("item_id").distinct()


def found_cases(taxonomy: DataFrame, items: DataFrame, base: str = "https://vocab.lexifold.example/") -> DataFrame:
    """kind, record_key: nodes on or below a cycle, nodes whose way up leaves the table, items with a wrong path."""
    tree = cut(expand(latest_nodes(taxonomy), with_keys=False).select("key", "status", "path_labels"))
    lost = tree.filter("status <> 'root'").select(F.col("status").alias("kind"), F.concat(F.lit(base), F.col("key")).alias("record_key"))
    wrong = contradicting_paths(items, tree).select(F.lit("path").alias("kind"), F.col("item_id").alias("record_key"))
    return lost.unionByName(wrong)
