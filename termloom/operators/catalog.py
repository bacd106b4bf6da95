"""The concept catalog: concepts, label index and hierarchy as DataFrames."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termloom.runtime import cut

#: Label kinds from the most to the least trusted.
LABEL_KINDS = ("preferred", "alternative", "lemma_preferred", "lemma_alternative", "hidden", "translation")


def kind_rank(kind: Column) -> Column:
    out = F.lit(99)
    for i, k in enumerate(LABEL_KINDS):
        out = F.when(kind == k, i).otherwise(out)
    return out


class ConceptCatalog:
    """Views over a table (iri, label, definition, alternative_labels, preferred_label, branch, parent_iris). Duplicate iris: the
    row with the greatest label holds. Rows without an iri are left out."""

    def __init__(self, concepts: DataFrame):
        self.concepts = concepts.filter("iri is not null")

    @cached_property
    def labels(self) -> DataFrame:
        """label_key, iri, kind: one row per key. A preferred (or else plain) label outdoes alternative ones; of several preferred
        ones the greatest iri holds, of several alternative ones the least. Blank labels are left out."""
        c = self.concepts
        first = c.select(F.coalesce(F.nullif(F.trim("preferred_label"), F.lit("")), "label").alias("text"), "iri", F.lit("preferred").alias("kind"))
        rest = c.select(F.explode("alternative_labels").alias("text"), "iri", F.lit("alternative").alias("kind"))
        every = first.unionByName(rest).filter(F.trim("text") != "").withColumn("label_key", F.lower("text"))
        best = every.groupBy("label_key").agg(F.max(F.when(F.col("kind") == "preferred", F.col("iri"))).alias("p"), F.min(F.when(F.col("kind") == "alternative", F.col("iri"))).alias("a"))
        return best.select("label_key", F.coalesce("p", "a").alias("iri"), F.when(F.col("p").isNotNull(), "preferred").otherwise("alternative").alias("kind"))

    @cached_property
    def edges(self) -> DataFrame:
        """child, parent: distinct."""
        return self.concepts.select(F.col("iri").alias("child"), F.explode("parent_iris").alias("parent")).filter("parent is not null").distinct()

    def hops(self) -> DataFrame:
        """node, other, relation: parents, children, grandparents, grandchildren and siblings of every node."""
        e = self.edges
        up = e.select(F.col("child").alias("node"), F.col("parent").alias("other"))
        down = up.select(F.col("other").alias("node"), F.col("node").alias("other"))
        two_up = e.alias("a").join(e.alias("b"), F.col("a.parent") == F.col("b.child")).select(F.col("a.child").alias("node"), F.col("b.parent").alias("other")).distinct()
        two_down = two_up.select(F.col("other").alias("node"), F.col("node").alias("other"))
        sib = e.alias("a").join(e.alias("b"), "parent").filter("a.child <> b.child").select(F.col("a.child").alias("node"), F.col("b.child").alias("other")).distinct()
        out = None
        for name, df in (("parent", up), ("child", down), ("grandparent", two_up), ("grandchild", two_down), ("sibling", sib)):
            df = df.withColumn("relation", F.lit(name))
            out = df if out is None else out.unionByName(df)
        return out

    def lemmas(self, lemmatize, denied: list[str] = ()) -> DataFrame:
        """label_key, lemma of labels of one word with more than three letters: kept where the lemma differs, has more than two letters, and neither is denied. ``lemmatize`` is a
        function from a Column to a Column."""
        k = self.labels.filter(F.col("kind").isin("preferred", "alternative") & ~F.contains("label_key", F.lit(" ")) & (F.length("label_key") > 3)).select("label_key", lemmatize(F.col("label_key")).alias("lemma"))
        kept = k.filter(F.col("lemma").isNotNull() & (F.col("lemma") != F.col("label_key")) & (F.length("lemma") > 2))
        return kept.filter(~F.col("label_key").isin(*denied) & ~F.col("lemma").isin(*denied)) if denied else kept

    def with_lemmas(self, lemmas: DataFrame) -> DataFrame:
        """The label index with lemma keys (label_key, lemma) added; an equal or better key is never overwritten."""
        old = self.labels.withColumn("rank", kind_rank(F.col("kind")))
        new = old.join(lemmas, "label_key").select(F.col("lemma").alias("label_key"), "iri", F.concat(F.lit("lemma_"), "kind").alias("kind")).withColumn("rank", kind_rank(F.col("kind")))
        w = Window.partitionBy("label_key").orderBy("rank", "iri")
        return old.unionByName(new).withColumn("_n", F.row_number().over(w)).filter("_n = 1").select("label_key", "iri", "kind")

    def get(self, iris: DataFrame) -> DataFrame:
        """The concepts that ``iris`` (a column iri) names; unknown ones find nothing."""
        return iris.select("iri").distinct().join(self.concepts, "iri")

    def parents_of(self, iris: DataFrame) -> DataFrame:
        """iri, parent, label, place: the known parents of each concept in order of their iris."""
        p = iris.select(F.col("iri").alias("child")).distinct().join(self.edges, "child").join(self.concepts.select(F.col("iri").alias("parent"), "label"), "parent")
        return p.select(F.col("child").alias("iri"), "parent", "label", F.row_number().over(Window.partitionBy("child").orderBy("parent")).cast("int").alias("place"))

    def branch_roots(self) -> DataFrame:
        """iri, branch: label of the concept where the way up ends that always takes the smallest known parent. Where the way runs into a circle it ends where it
        would meet a concept again: there the walk stands on the one that it met first.

        Pointers double each round (the concept 2^k steps up), so a way of any length takes a logarithmic number of rounds. Those that never meet a root are few; their circles
        are walked from the point of entry."""
        known = self.concepts.select(F.col("iri").alias("parent")).distinct()
        up = self.edges.join(known, "parent").groupBy(F.col("child").alias("iri")).agg(F.min("parent").alias("up"))
        one = self.concepts.select("iri").distinct().join(up, "iri", "left").select("iri", F.col("up"))
        jump = cut(one.select("iri", F.coalesce("up", "iri").alias("at"), F.col("up").isNull().alias("ended")))
        n, steps = jump.count(), 1
        while steps < n:
            nxt = jump.select(F.col("iri").alias("at"), F.col("at").alias("_at"), F.col("ended").alias("_e"))
            jump = cut(jump.join(nxt, "at").select("iri", F.col("_at").alias("at"), "_e").withColumnRenamed("_e", "ended"))
            steps *= 2
            if jump.filter("not ended").limit(1).count() == 0:
                break
        # after that many steps what hasn't ended stands on its circle
        rings = jump.filter("not ended").select("at").distinct()
        lost = jump.filter("not ended").select("iri")
        entry = None
        if rings.limit(1).count():
            circle = cut(rings.select(F.col("at").alias("iri")))
            while True:  # all concepts of the circles
                more = cut(circle.join(up, "iri").select(F.col("up").alias("iri")).unionByName(circle).distinct())
                if more.count() == circle.count():
                    break
                circle = more
            entry = cut(circle.select("iri", F.col("iri").alias("branch_iri")))
            while True:  # whoever leads into the circle takes its point of entry
                new = lost.join(entry, "iri", "left_anti").join(up, "iri").join(entry.select(F.col("iri").alias("up"), "branch_iri"), "up").select("iri", "branch_iri")
                grown = cut(entry.unionByName(new))
                if grown.count() == entry.count():
                    break
                entry = grown
        ends = jump.filter("ended").select("iri", F.col("at").alias("branch_iri"))
        if entry is not None:
            ends = ends.unionByName(entry.join(lost, "iri"))
        return ends.join(self.concepts.groupBy(F.col("iri").alias("branch_iri")).agg(F.max("label").alias("branch")), "branch_iri", "left").select("iri", F.coalesce("branch", F.lit("")).alias("branch"))
