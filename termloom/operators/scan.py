"""Dictionary scan: all occurrences of many patterns in many documents, and what is done with the spans."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from termloom.runtime import spread

# Short words that would hit everywhere; the least length of a pattern; confidence of the two tiers.
RULER_STOPWORDS = (
    "a an the to of in on at by for or and is it be as do no so up if my me he we am us go re al de la le mr ms dr st vs id ie eg etc per via "
    "not but has had was are its may can did she his her him our who how all any new one two out own set use way day get see "
    "now old end put run let say too yet off try ask got met cut pay due add"
).split()
LEAST_PATTERN = 3
PREFERRED_CONFIDENCE, OTHER_CONFIDENCE = 0.72, 0.55

#: Anchors up to this number are shipped to the tasks to sift tokens before the join; with more, every token is joined.
SHIPPED_ANCHORS = 100_000
_RUN = re.compile(r"\w+")


def _lower(text: str) -> str:
    """Lower case that keeps the length, so that offsets hold for the original."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c if len(x := c.lower()) != 1 else x for c in text)


@F.pandas_udf(T.StructType([T.StructField("anchor", T.StringType()), T.StructField("offset", T.IntegerType()), T.StructField("low", T.StringType())]))
def _anchor(pattern: pd.Series) -> pd.DataFrame:
    low = pattern.map(_lower)
    found = low.map(_RUN.search)
    return pd.DataFrame({"anchor": found.map(lambda m: m.group() if m else None), "offset": found.map(lambda m: m.start() if m else 0), "low": low})


def scan(docs: DataFrame, patterns: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, start, end, pattern, and the other columns of ``patterns``: every occurrence of a pattern with no word character on either
    side, whatever the letter case. Offsets count code points from 0; end is exclusive. Null texts have none; patterns
    without any word character name nothing and are left out.

    A pattern is found by its anchor, its first run of word characters: since its edges touch no word character, the anchor is a
    whole token of the text. Tokens that are anchors, each with the stretch of text around it, are joined with the patterns by
    anchor and compared there."""
    extra = [c for c in patterns.columns if c != "pattern"]
    pats = patterns.filter("pattern is not null").withColumn("_a", _anchor("pattern")).filter("_a.anchor is not null").select("pattern", *extra, F.col("_a.anchor").alias("_anchor"), F.col("_a.offset").alias("_off"), F.col("_a.low").alias("_low"))
    n, most, before = pats.agg(F.count_distinct("_anchor"), F.max(F.length("_low")), F.max("_off")).first()
    anchors = frozenset(r[0] for r in pats.select("_anchor").distinct().collect()) if n <= SHIPPED_ANCHORS else None
    most, before = most or 0, before or 0
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(cols):
            return pa.RecordBatch.from_arrays([pa.array(cols[0], key_type), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.string()), pa.array(cols[4], pa.int32())], names=[key, "_at", "_anchor", "_near", "_base"])

        for b in batches:
            key_type = b.column(0).type
            cols: list[list] = [[], [], [], [], []]
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if not t:
                    continue
                low = _lower(t)
                for m in _RUN.finditer(low):
                    if anchors is None or m.group() in anchors:
                        base = max(0, m.start() - before - 1)
                        for c, v in zip(cols, (k, m.start(), m.group(), low[base : m.start() + most + 1], base)):
                            c.append(v)
                if len(cols[0]) > 50_000:
                    yield flush(cols)
                    cols = [[], [], [], [], []]
            if cols[0]:
                yield flush(cols)

    tokens = spread(docs.select(key, text)).mapInArrow(run, f"{key} {kind}, _at int, _anchor string, _near string, _base int")
    hits = tokens.join(pats, "_anchor")
    start = F.col("_at") - F.col("_off")
    rel = start - F.col("_base") + 1  # position in the stretch, from 1
    size = F.length("_low")
    same = F.substring("_near", rel, size) == F.col("_low")
    edge = lambda pos: ~F.rlike(F.substring("_near", pos, F.lit(1)), F.lit(r"^[\p{L}\p{N}_]"))
    left = (start == 0) | edge(F.greatest(rel - 1, F.lit(1)))
    return hits.filter((start >= 0) & same & left & edge(rel + size)).select(key, start.alias("start"), (start + size).alias("end"), "pattern", *extra)


def _fold(kept: Column, x: Column) -> Column:
    """One step of the overlap rule: the kept spans after x."""
    clash = F.array_position(F.transform(kept, lambda k: (k["end"] > x["start"]) & (((k["start"] == x["start"]) & (k["end"] == x["end"])) | ((k["start"] < x["start"]) & (k["end"] < x["end"])))), F.lit(True)).cast("int")
    other = F.get(kept, clash - 1)
    longer = (x["end"] - x["start"]) > (other["end"] - other["start"])
    return F.when(clash == 0, F.concat(kept, F.array(x))).when(longer, F.concat(F.slice(kept, F.lit(1), clash - 1), F.array(x), F.slice(kept, clash + 1, F.size(kept)))).otherwise(kept)


def without_overlaps(spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """The spans of each document that the overlap rule leaves. Spans are taken by start, the longer first (then by their other columns). A span equal to one that is
    kept goes; one that overlaps a kept span in part, the first such, takes its place if it is longer and goes otherwise; one inside another stays. The rule is
    greedy: what takes a place isn't compared with the others again.

    Only spans that touch each other, directly or through others, can decide about one another, so a window cuts each document into such islands and each island is
    folded alone, in the engine: no array holds the spans of a whole document. Spans that stand alone skip the fold."""
    rest = [c for c in spans.columns if c not in (key, "start", "end")]
    order = Window.partitionBy(key).orderBy("start", F.col("end").desc())
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    begun = F.when(F.col("start") < reach, 0).otherwise(1)
    islands = spans.withColumn("_b", begun).withColumn("_island", F.sum("_b").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_b")
    grouped = islands.groupBy(key, "_island").agg(F.array_sort(F.collect_list(F.struct("start", (-F.col("end")).alias("_o"), "end", *rest))).alias("_s"))
    none = F.filter("_s", lambda x: F.lit(False))
    kept = F.when(F.size("_s") == 1, F.col("_s")).otherwise(F.aggregate("_s", none, _fold))
    return grouped.select(key, F.explode(kept).alias("_x")).select(key, "_x.start", "_x.end", *[f"_x.{c}" for c in rest])


def same_case(spans: DataFrame, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The spans of a scan whose stretch of the text is the pattern letter by letter, capitals included."""
    there = F.substring(F.col("_t"), F.col("start") + 1, F.col("end") - F.col("start")) == F.col("pattern")
    return spans.join(docs.select(key, F.col(text).alias("_t")), key).filter(there).drop("_t")


def pattern_id(iri: Column, kind: Column) -> Column:
    return F.concat_ws("|", iri, kind)


def pattern_parts(ident: Column) -> Column:
    """struct(iri, kind) of a pattern id; 'unknown' where it names no kind."""
    has = F.contains(ident, F.lit("|"))
    return F.struct(F.when(has, F.regexp_extract(ident, r"^(.*)\|[^|]*$", 1)).otherwise(ident).alias("iri"), F.when(has, F.substring_index(ident, "|", -1)).otherwise("unknown").alias("kind"))


def ruler_patterns(labels: DataFrame) -> DataFrame:
    """Patterns of a label index: keys of three characters or more that aren't stopwords."""
    return labels.filter((F.length("label_key") >= LEAST_PATTERN) & ~F.lower("label_key").isin(RULER_STOPWORDS)).select(F.col("label_key").alias("pattern"), "iri", "kind")


def entity_ruler(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, start, end, pattern, iri, kind, confidence: labels found in the documents, overlaps resolved."""
    spans = without_overlaps(scan(docs, ruler_patterns(labels), key, text), key)
    sure = F.col("kind").isin("preferred", "lemma_preferred")
    return spans.withColumn("confidence", F.when(sure, PREFERRED_CONFIDENCE).otherwise(OTHER_CONFIDENCE))


# -- leak scan: n-grams of surfaces that must not appear -------------------------------------------------------------------


def leak_tokens(text: Column) -> Column:
    """Letters and digits of a text in lower case, other characters as blanks, split."""
    return F.filter(F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}\s]", " "), r"\s+"), lambda w: F.length(w) > 0)


def surface_digests(surfaces: DataFrame, salt: str, column: str = "surface", least: int = 2) -> DataFrame:
    """digest, n: salted digests of the surfaces' token sequences, of at least ``least`` tokens. IRIs and blanks are left out."""
    s = surfaces.filter(F.col(column).isNotNull() & ~F.rlike(F.col(column), F.lit(r"^\s*(?:[a-z][a-z0-9+.-]*://|urn:)"))).select(leak_tokens(F.col(column)).alias("t"))
    return s.filter(F.size("t") >= least).select(F.sha2(F.concat(F.lit(salt), F.lit("|"), F.array_join("t", " ")), 256).alias("digest"), F.size("t").alias("n")).distinct()


def leak_scan(docs: DataFrame, digests: DataFrame, salt: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, hits: documents with the number of distinct token n-grams whose digest is listed. Lengths come from the list, which the
    driver reads as at most a few numbers."""
    sizes = sorted(r[0] for r in digests.select("n").distinct().limit(65).collect())
    if len(sizes) > 64:
        raise ValueError("too many n-gram lengths")
    tokens = docs.select(key, leak_tokens(F.col(text)).alias("t"))
    n = F.size("t")

    def windows(k: int) -> Column:
        return F.when(n >= k, F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.array_join(F.slice("t", i, k), " "))).otherwise(F.array().cast("array<string>"))

    grams = F.flatten(F.array(*[windows(k) for k in sizes])) if sizes else F.array().cast("array<string>")
    rows = tokens.select(key, F.explode(F.array_distinct(grams)).alias("g"))
    marked = rows.select(key, F.sha2(F.concat(F.lit(salt), F.lit("|"), F.col("g")), 256).alias("digest"))
    return marked.join(digests.select("digest"), "digest", "left_semi").groupBy(key).agg(F.count_distinct("digest").alias("hits"))


def scrypt_digest(salt: bytes, n: int = 1 << 12, r: int = 8, p: int = 1):
    """A pandas UDF with the memory-hard digest, for manifests that leave the house."""

    @F.pandas_udf(T.StringType())
    def digest(text: pd.Series) -> pd.Series:
        return text.map(lambda s: None if s is None else hashlib.scrypt(s.encode(), salt=salt, n=n, r=r, p=p, dklen=32).hex())

    return digest
