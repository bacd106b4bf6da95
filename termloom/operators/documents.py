"""The document lane: concepts of whole passages, with counters of what the gates held back; surface scans; measures of a scan's quality."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termloom.functions.gates import place_gate, short_gate
from termloom.functions.text import phrase_windows
from termloom.operators.catalog import ConceptCatalog
from termloom.operators.scan import ruler_patterns, scan
from termloom.plans.pipeline import not_blocked, recall
from termloom.runtime import spread

#: Beginnings of surfaces up to this number are shipped to the tasks to sift windows before the join.
SHIPPED_HEADS = 100_000


def adapt(docs: DataFrame, catalog: ConceptCatalog, blocklist: DataFrame | None = None, floor: float = 45.0, phrases: bool = True, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, iri, label, score, path, surface, outcome: the best candidate of each concept in a passage and what became of it: 'kept', or held back by 'blocklist',
    'place_gate', 'short_label_gate' or 'score_floor', the first that applies. Candidates are the labels found in the passage (score 100, overlapping ones too) and, with
    ``phrases``, what recall finds for its windows of one to five words. Of several candidates the highest score counts, then the path, then the surface."""
    d = docs.select(F.col(key), F.col(text).alias("_t"))
    c = catalog.concepts.select("iri", "label", "branch")
    spans = scan(d, catalog.labels.filter(F.length("label_key") >= 3).select(F.col("label_key").alias("pattern"), "iri", "kind"), key, "_t")
    cands = spans.select(key, "iri", F.lit(100.0).alias("score"), F.lit("aho_corasick").alias("path"), F.col("pattern").alias("surface"))
    if phrases:
        p = d.select(key, F.explode(phrase_windows(F.col("_t"))).alias("term"))
        cands = cands.unionByName(p.join(recall(p, catalog), "term").select(key, "iri", "score", F.lit("multi_strategy_recall").alias("path"), F.col("term").alias("surface")))
    best = cands.groupBy(key, "iri").agg(F.min(F.struct((-F.col("score")).alias("o"), "path", "surface")).alias("b")).select(key, "iri", (-F.col("b.o")).alias("score"), "b.path", "b.surface").join(c, "iri")
    free = best.join(not_blocked(best, blocklist).select(key, "iri", F.lit(True).alias("_free")), [key, "iri"], "left") if blocklist is not None else best.withColumn("_free", F.lit(True))
    g = free.withColumn("_p", place_gate(F.col("surface"), F.col("label"), F.col("branch"), F.col("score"))).withColumn("_s", short_gate(F.col("surface"), F.col("label"), F.col("_p.score")))
    outcome = (
        F.when(F.col("_free").isNull(), "blocklist").when(F.col("_p.demoted") & (F.col("_p.score") < floor), "place_gate").when(F.col("_s.demoted") & (F.col("_s.score") < floor), "short_label_gate")
        .when(F.col("_s.score") < floor, "score_floor").otherwise("kept")
    )
    return g.select(key, "iri", "label", F.when(outcome == "kept", F.col("_s.score")).otherwise(F.col("score")).alias("score"), "path", "surface", outcome.alias("outcome"))


def suppression(adapted: DataFrame) -> DataFrame:
    """outcome, candidates: how many candidates the gates let through and held back."""
    return adapted.groupBy("outcome").agg(F.count(F.lit(1)).alias("candidates"))


def surfaces_in(docs: DataFrame, surfaces: DataFrame, key: str = "doc_id", text: str = "text", surface: str = "surface") -> DataFrame:
    """key, surface: every surface that stands literally in a text, once. Letter case counts, word borders don't.

    Texts and surfaces meet on the surface's first three characters (or all of a shorter one): a task sends, for each text, those of its windows that begin a surface, and what
    meets is compared in full. Blank surfaces and nulls find nothing."""
    s = surfaces.select(F.col(surface).alias("surface")).filter(F.length("surface") > 0).distinct().withColumn("_h", F.left("surface", F.lit(3)))
    t = spread(docs.select(F.col(key), F.col(text).alias("_t")).filter(F.length("_t") > 0))
    listed = [r[0] for r in s.select("_h").distinct().limit(SHIPPED_HEADS + 1).collect()]
    heads = frozenset(listed) if len(listed) <= SHIPPED_HEADS else None  # with more, all windows are sent
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[int] = []
            found: list[str] = []
            for i, x in enumerate(b.column(1).to_pylist()):
                windows = {x[a : a + n] for n in (1, 2, 3) for a in range(len(x))}
                windows = windows if heads is None else windows & heads
                rows += [i] * len(windows)
                found += windows
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), pa.array(found, pa.string())], names=[key, "_h"])

    met = t.mapInArrow(run, f"{key} {kind}, _h string")
    return met.join(s, "_h").select(key, "surface").join(t, key).filter(F.contains("_t", F.col("surface"))).select(key, "surface")


def assert_no_surfaces(docs: DataFrame, surfaces: DataFrame, what: str = "output", **columns) -> int:
    """Raises where any surface stands in any text; else the number of surfaces looked for."""
    hits = surfaces_in(docs, surfaces, **columns).limit(1).count()
    if hits:
        raise ValueError(f"{what} holds surfaces that must not leave")
    return surfaces.distinct().count()


def label_samples(labels: DataFrame, sizes: dict[str, int], seed: str = "1") -> DataFrame:
    """label_key, iri, kind, stratum: for each label kind a fixed sample in hashed order, and of labels of several words with punctuation ('punctuated')."""
    able = ruler_patterns(labels).withColumnRenamed("pattern", "label_key")
    marked = able.select("*", F.col("kind").alias("stratum")).unionByName(able.filter(F.contains("label_key", F.lit(" ")) & F.rlike("label_key", F.lit(r"[^\p{L}\p{N}_\s]"))).withColumn("stratum", F.lit("punctuated")))
    w = Window.partitionBy("stratum").orderBy(F.md5(F.concat_ws("|", F.lit(seed), "stratum", "label_key")), "label_key")
    size: Column = F.lit(0)
    for name, k in sizes.items():
        size = F.when(F.col("stratum") == name, k).otherwise(size)
    return marked.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= size).drop("_n")


def scan_recall(samples: DataFrame, labels: DataFrame, before: str = "The filing addresses ", after: str = " in this matter.") -> DataFrame:
    """stratum, samples, hits: how many sampled labels the scan finds in a sentence made with each."""
    texts = samples.select(F.concat_ws("|", "stratum", "label_key").alias("doc_id"), F.concat(F.lit(before), F.col("label_key"), F.lit(after)).alias("text"), "stratum", "label_key", "iri")
    found = scan(texts, ruler_patterns(labels)).select("doc_id", F.lower("pattern").alias("label_key"), "iri", F.lit(1).alias("hit")).distinct()
    return texts.join(found, ["doc_id", "label_key", "iri"], "left").groupBy("stratum").agg(F.count(F.lit(1)).alias("samples"), F.count("hit").alias("hits"))
