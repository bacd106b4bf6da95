"""Queries of problems 2 to 8 and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from termloom.llm import canonical, encode, overlap, packing, quality, splits, topk
from termloom.runtime import table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.found_pairs(table(spark, sf_dir, "gold_rows"))


def p2_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.report(table(spark, sf_dir, "gold_rows"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.ranked_top(table(spark, sf_dir, "ranked_candidates"), table(spark, sf_dir, "answer_rules")).select("item_id", "config_version", "place", "iri")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical.found(table(spark, sf_dir, "gold_values"), table(spark, sf_dir, "label_proposals"), table(spark, sf_dir, "concepts"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.related_groups(table(spark, sf_dir, "gold_rows"))


def p5_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.assign_splits(table(spark, sf_dir, "gold_rows"), table(spark, sf_dir, "split_shares"))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode.encode_corpus(table(spark, sf_dir, "documents"))


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.fill_containers(table(spark, sf_dir, "documents"), table(spark, sf_dir, "container_sizes"))


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = table(spark, sf_dir, "container_sizes")
    return packing.fill_report(packing.fill_containers(table(spark, sf_dir, "documents"), sizes), sizes)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.not_prose(table(spark, sf_dir, "documents"))


def p8_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.text_statistics(table(spark, sf_dir, "documents"))


_P3 = """SELECT item_id, config_version, CAST(place AS INTEGER) AS place, iri FROM (
  SELECT g.item_id, g.config_version, g.iri, r.top_k, row_number() OVER (PARTITION BY g.item_id, g.config_version ORDER BY g.score DESC, g.iri COLLATE "C") AS place
  FROM (SELECT item_id, config_version, iri, max(score) AS score FROM ranked_candidates WHERE item_id IS NOT NULL AND score IS NOT NULL AND NOT isnan(score) AND iri IS NOT NULL GROUP BY ALL) g
  JOIN answer_rules r USING (config_version)) WHERE place <= top_k"""

_P5 = r"""WITH RECURSIVE base AS (SELECT item_id,
  nullif(lower(regexp_replace(stratum_id, '[\p{Pd}\x{2212}\p{Z}\p{Cf}\p{Cc}\s]', '', 'g')), '') AS s, nullif(lower(regexp_replace(ancestor_path[2], '[\p{Pd}\x{2212}\p{Z}\p{Cf}\p{Cc}\s]', '', 'g')), '') AS h, flags FROM gold_rows),
tok AS (SELECT DISTINCT item_id, 'S|' || s || '|' || h AS token FROM base WHERE s IS NOT NULL AND h IS NOT NULL
  UNION SELECT DISTINCT item_id, 'M|' || m FROM (SELECT item_id, nullif(regexp_extract(f, '(?i)^\W*(?:see\W+)?(?:matter|mtr)\W*(?:no\W*|nr\W*|num\W*|number\W*|id\W*)?m?\W*0*([1-9][0-9]*)\W*$', 1), '') AS m FROM (SELECT item_id, unnest(flags) AS f FROM base)) WHERE m IS NOT NULL),
edge AS (SELECT DISTINCT a.token AS a, b.token AS b FROM tok a JOIN tok b USING (item_id) WHERE a.token <> b.token),
reach AS (SELECT token AS a, token AS b FROM (SELECT DISTINCT token FROM tok) UNION SELECT r.a, e.b FROM reach r JOIN edge e ON e.a = r.b),
grp AS (SELECT r.a AS token, min(t.item_id) AS g FROM reach r JOIN tok t ON t.token = r.b GROUP BY r.a)
SELECT i.item_id, coalesce(min(grp.g), i.item_id) AS group_id FROM (SELECT DISTINCT item_id FROM gold_rows WHERE item_id IS NOT NULL) i LEFT JOIN tok USING (item_id) LEFT JOIN grp USING (token) GROUP BY i.item_id"""


def queries() -> dict:
    return {"p2_found": p2_found, "p2_report": p2_report, "p3_found": p3_found, "p4_found": p4_found, "p5_found": p5_found, "p5_splits": p5_splits, "p6_ids": p6_ids, "p7_containers": p7_containers, "p7_report": p7_report, "p8_found": p8_found, "p8_statistics": p8_statistics}


def oracle_sql() -> dict[str, str]:
    return {"p3_found": _P3, "p5_found": _P5}
