"""Splits that keep related records together: hash-to-min components and weighted rendezvous hashing (problem 5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.functions.keys import loose_heading
from termloom.runtime import cut, hot_keys, salted_join

#: Marks that name a matter: the word, perhaps 'no.' and the letter M, then the number; zeros in front don't count.
MATTER = r"(?i)^\W*(?:see\W+)?(?:matter|mtr)\W*(?:no\W*|nr\W*|num\W*|number\W*|id\W*)?m?\W*0*([1-9][0-9]*)\W*$"


def matter_number(flag: Column) -> Column:
    """The number of the matter that a mark names, without leading zeros; null for unknown, zero, empty and other marks."""
    return F.nullif(F.regexp_extract(flag, MATTER, 1), F.lit(""))


def item_tokens(items: DataFrame) -> DataFrame:
    """Distinct (item_id, token): what relates the item to others. A token names a stratum_id with a second heading or a
    matter. A null or empty path, a blank stratum_id or heading relates nothing. Rows without item_id are left out."""
    stratum, heading = loose_heading(F.col("stratum_id")), loose_heading(F.try_element_at("ancestor_path", F.lit(2)))
    by_path = F.when(stratum.isNotNull() & heading.isNotNull(), F.concat(F.lit("S|"), stratum, F.lit("|"), heading))
    matters = F.transform(F.coalesce("flags", F.array().cast("array<string>")), lambda f: F.concat(F.lit("M|"), matter_number(f)))
    tokens = F.array_distinct(F.array_compact(F.concat(F.array(by_path), matters)))
    return items.filter("item_id is not null").select("item_id", F.explode(tokens).alias("token")).distinct()


def hash_to_min(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Component of each node of an undirected graph with edges (a, b): node, component (its smallest node).

    Hash-to-min on rows (node, member): in each round a node sends its members to the smallest of them and that smallest one
    to every member. The clusters stay rows, never arrays; the minimum is combined before the shuffle, and the join that
    brings it back is salted where a node holds a large share of the rows. Ends when every cluster but the minima's is its
    minimum alone, which takes a number of rounds logarithmic in the diameter."""
    pairs = edges.select(F.col("a").alias("node"), F.col("b").alias("member"))
    pairs = pairs.unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("member")))
    pairs = pairs.unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("member"))).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("member")))
    pairs = cut(pairs.distinct())
    least = cut(pairs.groupBy("node").agg(F.min("member").alias("low"), F.count(F.lit(1)).alias("n")))
    for _ in range(rounds):
        hot = hot_keys(least, "node", "n")
        with_low = salted_join(pairs, least.select("node", "low"), "node", hot, F.col("member"))
        sent = with_low.select(F.explode(F.array(F.struct(F.col("low").alias("node"), "member"), F.struct(F.col("member").alias("node"), F.col("low").alias("member")))).alias("m")).select("m.node", "m.member")
        pairs = cut(sent.distinct())
        least = cut(pairs.groupBy("node").agg(F.min("member").alias("low"), F.count(F.lit(1)).alias("n")))  # of this round, and where the next begins
        # stable: every node that isn't a minimum holds just one member, which is a minimum itself
        if not least.filter("low <> node and n > 1").limit(1).count() and not _moved(least):
            break
    else:
        raise RuntimeError("hash_to_min: not stable after the rounds allowed")
    return least.select("node", F.col("low").alias("component"))


def _moved(state: DataFrame) -> bool:
    """Whether some node's minimum is not yet a minimum of its own."""
    lows = state.filter("low <> node").select(F.col("low").alias("node")).distinct()
    return lows.join(state.filter("low <> node").select("node"), "node").limit(1).count() > 0


def related_groups(items: DataFrame) -> DataFrame:
    """item_id, group_id: the smallest item_id among all items related to it, itself included. One row per item_id.

    Items only meet through tokens, so the graph is that of the tokens: one edge from an item's first token to each other
    one of its tokens. A token held by a third of all rows is one node."""
    pairs = cut(item_tokens(items))
    first = F.min("token").alias("a")
    stars = pairs.groupBy("item_id").agg(first, F.collect_set("token").alias("all")).select("a", F.explode("all").alias("b")).filter("a <> b").distinct()
    tokens = cut(pairs.groupBy("token").agg(F.min("item_id").alias("first_item"), F.count(F.lit(1)).alias("n")))
    comp = hash_to_min(stars)
    named = tokens.join(comp.withColumnRenamed("node", "token"), "token", "left").withColumn("component", F.coalesce("component", "token"))
    named = cut(named)
    lowest = named.groupBy("component").agg(F.min("first_item").alias("group_id"), F.count(F.lit(1)).alias("tokens"))
    by_token = salted_join(named.select("token", "component", "n"), lowest.select("component", "group_id"), "component", hot_keys(lowest, "component", "tokens"), F.col("token"))
    by_token = cut(by_token.select("token", "group_id", "n"))
    one = pairs.groupBy("item_id").agg(F.min("token").alias("token"))
    grouped = salted_join(one, by_token.select("token", "group_id"), "token", hot_keys(by_token, "token", "n"), F.col("item_id")).select("item_id", "group_id")
    every = items.filter("item_id is not null").select("item_id").distinct()
    return every.join(grouped, "item_id", "left").select("item_id", F.coalesce("group_id", "item_id").alias("group_id"))


def rendezvous(key: Column, shares: list[tuple[str, float]], salt: str = "splits-1") -> Column:
    """The name that wins for ``key``: weighted rendezvous hashing, -share / ln(u) with u from a hash of key and name. Changing
    one share moves only keys to or from that name. Shares that are null or not positive win nothing."""
    usable = sorted((str(n), float(p)) for n, p in shares if n is not None and p is not None and p > 0)
    if not usable:
        return F.lit(None).cast("string")

    def score(name: str, p: float) -> Column:
        bits = F.shiftrightunsigned(F.xxhash64(F.lit(salt), F.lit(name), key), 11).cast("double")
        return F.lit(-p) / F.ln((bits + F.lit(0.5)) / F.lit(float(2**53)))

    scored = [F.struct(score(n, p).alias("s"), F.lit(n).alias("name")) for n, p in usable]
    return F.array_max(F.array(*scored))["name"]


def assign_splits(items: DataFrame, shares: DataFrame) -> DataFrame:
    """item_id, group_id, split for every item: related items share a split. ``shares`` (slice_name, proportion) is a table
    of a few rows and is read by the driver; more than 1,000 rows are refused."""
    rows = [(r[0], r[1]) for r in shares.select("slice_name", "proportion").limit(1001).collect()]
    if len(rows) > 1000:
        raise ValueError("too many splits")
    groups = related_groups(items)
    return groups.withColumn("split", rendezvous(F.col("group_id"), rows))
