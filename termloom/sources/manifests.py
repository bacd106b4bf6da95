"""Manifests, configurations and other small pinned records: validated on reading, canonical on writing."""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.functions.normalize import label_key
from termloom.operators.documents import assert_no_surfaces
from termloom.sources import files
from termloom.sources.pinned import canonical_json, content_hash


@dataclass(frozen=True)
class AnswerRule:
    """What turns a ranked list into answers."""

    threshold: float = 0.5
    top_k: int = 4
    calibrated: bool = False
    steps: tuple[tuple[float, float], ...] = ()
    rationale: str = ""
    version: int = 1

    def __post_init__(self):
        if not 0.0 <= self.threshold <= 1.0:
            raise ValueError("the threshold is a probability")
        if self.top_k < 1:
            raise ValueError("top_k is 1 at least")

    def payload(self) -> dict:
        return {"calibrated": self.calibrated, "rationale": self.rationale, "steps": [list(s) for s in self.steps], "threshold": self.threshold, "top_k": self.top_k, "version": self.version}

    def sha256(self) -> str:
        return hashlib.sha256(canonical_json(self.payload()).encode()).hexdigest()


def write_config(spark: SparkSession, rule: AnswerRule, path: str) -> str:
    files.write_text(spark, path, canonical_json(rule.payload()) + "\n")
    return rule.sha256()


def load_config(spark: SparkSession, path: str) -> AnswerRule:
    p = _object(spark, path)
    steps = p.get("steps") or []
    if not isinstance(steps, list) or any(not isinstance(s, list) or len(s) != 2 for s in steps):
        raise ValueError("steps are pairs of score and probability")
    return AnswerRule(float(p.get("threshold", 0.5)), int(p.get("top_k", 4)), bool(p.get("calibrated", False)), tuple((float(x), float(y)) for x, y in steps), str(p.get("rationale", "")), int(p.get("version", 1)))


def _object(spark: SparkSession, path: str) -> dict:
    p = json.loads(files.read_text(spark, path))
    if not isinstance(p, dict):
        raise ValueError(f"{path} holds no JSON object")
    return p


@dataclass(frozen=True)
class Sheet:
    name_hash: str
    rows: int
    header: str
    content: str


@dataclass(frozen=True)
class Workbook:
    firm: str
    path: str
    sha256: str
    sheets: tuple[Sheet, ...] = field(default=())


def format_manifest(books: list[Workbook]) -> str:
    """Workbooks and their sheets as a Markdown text of hashes and counts."""
    out = ["# Sheets", ""]
    for b in books:
        out += [f"## {b.firm}", "", f"- path: `{b.path}`", f"- sha256: `{b.sha256}`", "", "| sheet | rows | header | content |", "|---|---|---|---|"]
        out += [f"| `{s.name_hash}` | {s.rows} | `{s.header}` | `{s.content}` |" for s in b.sheets] + [""]
    return "\n".join(out).rstrip() + "\n"


def parse_manifest(text: str) -> list[Workbook]:
    """What format_manifest wrote; a section without path or hash raises."""
    books = []
    for part in re.split(r"(?m)^## ", text)[1:]:
        firm = part.splitlines()[0].strip()
        path, sha = re.search(r"(?m)^- path: `(.*)`$", part), re.search(r"(?m)^- sha256: `(.*)`$", part)
        if not path or not sha:
            raise ValueError(f"the section of {firm} has no path or hash")
        sheets = tuple(Sheet(a, int(n), h, c) for a, n, h, c in re.findall(r"(?m)^\| `([^`]*)` \| (\d+) \| `([^`]*)` \| `([^`]*)` \|$", part))
        books.append(Workbook(firm, path.group(1), sha.group(1), sheets))
    return books


def write_manifest(spark: SparkSession, path: str, books: list[Workbook]) -> None:
    files.write_text(spark, path, format_manifest(books))


def read_manifest(spark: SparkSession, path: str) -> list[Workbook]:
    return parse_manifest(files.read_text(spark, path)) if files.exists(spark, path) else []


def gold_manifest(gold: DataFrame, catalog_hash: str, parent: str = "") -> dict:
    """Counts and hashes of a gold table (item_id, gold) that pin what a version holds."""
    n = gold.agg(F.count(F.lit(1)).alias("items"), F.count_if(F.size("gold") == 0).alias("blank"), F.sum(F.size("gold")).alias("iris")).first()
    return {"items": n.items, "blank": n.blank, "iris": n.iris or 0, "content_sha256": content_hash(gold), "catalog_sha256": catalog_hash, "parent": parent}


def split_manifest(splits: DataFrame, gold_hash: str, seed: str) -> dict:
    """Sizes of the slices and hashes that pin a split (item_id, slice) to its gold version; the manifest hashes itself too."""
    sizes = {r[0]: r[1] for r in splits.groupBy("slice").count().limit(100).collect()}
    body = {"gold_sha256": gold_hash, "seed": seed, "sizes": sizes, "content_sha256": content_hash(splits.select("item_id", "slice"))}
    return body | {"sha256": hashlib.sha256(canonical_json(body).encode()).hexdigest()}


def check_split_manifest(manifest: dict, splits: DataFrame, gold_hash: str) -> None:
    """Raises where a manifest isn't its own, of another gold version, or of other splits."""
    body = {k: v for k, v in manifest.items() if k != "sha256"}
    if hashlib.sha256(canonical_json(body).encode()).hexdigest() != manifest.get("sha256"):
        raise ValueError("the split manifest was changed")
    if manifest["gold_sha256"] != gold_hash:
        raise ValueError("the split belongs to another gold version")
    if manifest["content_sha256"] != content_hash(splits.select("item_id", "slice")):
        raise ValueError("the split's content differs from its manifest")


def assert_current(pinned: dict, versions: list[dict], allow_stale: bool = False) -> None:
    """Raises unless the newest version is the one that a manifest was made for."""
    newest = max(versions, key=lambda v: v["version"], default=None)
    if newest is not None and not allow_stale and (newest["version"], newest["content_sha256"]) != (pinned["version"], pinned["content_sha256"]):
        raise ValueError("the manifest is older than the newest version")


def load_quotas(spark: SparkSession, path: str) -> DataFrame:
    """doc_type, jurisdictions, scoreable, no_match of a validated quota table."""
    p = _object(spark, path)
    rows = p.get("doc_types")
    if p.get("version") != 1 or not isinstance(rows, list):
        raise ValueError("a quota table has version 1 and doc_types")
    out, seen = [], set()
    for r in rows:
        name, places = str(r.get("doc_type", "")).strip(), [str(x).strip() for x in r.get("jurisdictions") or []]
        numbers = [r.get("scoreable"), r.get("no_match")]
        if not name or name in seen or not places or not all(places) or any(isinstance(x, bool) or not isinstance(x, int) or x < 0 for x in numbers):
            raise ValueError(f"invalid quota {name!r}")
        seen.add(name)
        out.append((name, places, *numbers))
    return spark.createDataFrame(out, "doc_type string, jurisdictions array<string>, scoreable int, no_match int")


def load_votes(spark: SparkSession, path: str, items: DataFrame, names: DataFrame) -> DataFrame:
    """item_id, grader_id, family, label, confidence of one grader's vote file. Items: item_id, generator_id; names: label. Unknown or repeated items, a wrong claim of who
    made the item, a grader of its own item, labels beyond the dictionary and confidences beyond 0..1 raise."""
    p = _object(spark, path)
    grader, family, votes = p.get("grader_id"), p.get("model_family"), p.get("votes")
    if p.get("version") != 1 or not isinstance(grader, str) or not grader or not isinstance(family, str) or not family or not isinstance(votes, list):
        raise ValueError("a vote file has version 1, a grader, a family and votes")
    rows = []
    for v in votes:
        if not isinstance(v, dict) or not isinstance(v.get("concepts"), dict) or not isinstance(v.get("item_id"), str):
            raise ValueError("malformed vote")
        for label, c in v["concepts"].items() or [(None, None)]:
            if label is not None and (isinstance(c, bool) or not isinstance(c, (int, float)) or not 0 <= c <= 1):
                raise ValueError(f"confidence of {v['item_id']!r} is outside 0..1")
            rows.append((v["item_id"], v.get("generator_id_claimed"), label, None if c is None else float(c)))
    if len({r[0] for r in rows}) != len(votes):
        raise ValueError("an item is voted on twice")
    df = spark.createDataFrame(rows, "item_id string, claimed string, label string, confidence double")
    j = df.join(items.select("item_id", "generator_id"), "item_id", "left")
    if j.filter(F.col("generator_id").isNull() | F.col("claimed").isNull() | (F.col("claimed") != F.col("generator_id")) | (F.col("generator_id") == grader)).limit(1).count():
        raise ValueError("a vote names an unknown item, another maker, or its own grader")
    known = names.select(label_key(F.col("label")).alias("_k")).distinct()
    if df.filter("label is not null").withColumn("_k", label_key(F.col("label"))).join(known, "_k", "left_anti").limit(1).count():
        raise ValueError("a vote names a label beyond the dictionary")
    return df.select("item_id", F.lit(grader).alias("grader_id"), F.lit(family).alias("family"), "label", "confidence")


def append_records(records: DataFrame, path: str, surfaces: DataFrame | None = None, text: list[str] | None = None) -> None:
    """Appends JSON lines after a look for surfaces that must not leave; without surfaces nothing is looked for and the caller answers for it."""
    if surfaces is not None:
        columns = text or [f.name for f in records.schema if f.dataType.simpleString() == "string"]
        assert_no_surfaces(records.select(F.monotonically_increasing_id().alias("doc_id"), F.concat_ws("\n", *columns).alias("text")), surfaces, "the record")
    records.write.mode("append").json(path)


def save_lemmas(lemmas: DataFrame, folder: str, catalog_hash: str) -> None:
    lemmas.select("label_key", "lemma").write.mode("overwrite").parquet(f"{folder}/lemmas-{catalog_hash}")


def load_lemmas(spark: SparkSession, folder: str, catalog_hash: str) -> DataFrame | None:
    """The lemmas kept for a catalog; None where there are none or they can't be read."""
    path = f"{folder}/lemmas-{catalog_hash}"
    if not files.exists(spark, path):
        return None
    try:
        return spark.read.parquet(path).select("label_key", "lemma")
    except Exception:  # noqa: BLE001
        return None


def save_blocklist(spark: SparkSession, blocked: DataFrame, path: str) -> None:
    """The blocklist, a table of few rows (more than 100,000 are refused), as JSON."""
    rows = blocked.select("surface_term", "blocked_iri", "domain", "reason").limit(100_001).collect()
    if len(rows) > 100_000:
        raise ValueError("the blocklist is too large for one file")
    files.write_text(spark, path, canonical_json({"version": 1, "blocked_aliases": [r.asDict() for r in sorted(rows, key=str)]}) + "\n")


def add_blocked(blocked: DataFrame, more: DataFrame) -> DataFrame:
    """The blocklist with entries added; of equal keys (term and domain whatever their case, iri) the added one holds."""
    every = blocked.withColumn("_n", F.lit(0)).unionByName(more.withColumn("_n", F.lit(1)))
    key = [F.lower("surface_term").alias("_k"), "blocked_iri", F.lower(F.coalesce("domain", F.lit(""))).alias("_d")]
    g = every.groupBy(*key).agg(F.max_by(F.struct("surface_term", "domain", "reason"), F.struct("_n", F.coalesce("reason", F.lit("")))).alias("r"))
    return g.select("r.surface_term", "blocked_iri", "r.domain", "r.reason")
