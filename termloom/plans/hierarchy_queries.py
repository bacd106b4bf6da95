"""Queries of problem 1."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.operators import hierarchy as H
from termloom.runtime import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.found_cases(table(spark, sf_dir, "taxonomy_nodes"), table(spark, sf_dir, "gold_rows"))


def p1_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = H.expand(H.latest_nodes(table(spark, sf_dir, "taxonomy_nodes")))
    on_cycle = tree.filter("status = 'cycle'").select("key")
    below = H.rootless_descendants(tree).groupBy(F.col("ancestor").alias("key")).agg(F.count(F.lit(1)).alias("_below"))
    tree = tree.join(on_cycle.join(below, "key", "left").select("key", (F.coalesce("_below", F.lit(0)) + 1).alias("_whole")), "key", "left")
    return tree.select("key", "label", "status", "root", "depth", F.array_join("path_keys", " > ").alias("key_path"), F.array_join(F.transform("path_labels", lambda x: F.coalesce(x, F.lit(""))), " > ").alias("label_path"), F.coalesce("_whole", "size").alias("subtree_size"))


def p1_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = H.expand(H.latest_nodes(table(spark, sf_dir, "taxonomy_nodes")))
    return H.descendants(tree).unionByName(H.rootless_descendants(tree))


_NODES = r"""
keyed AS (SELECT nullif(regexp_extract(regexp_replace(regexp_replace(iri, '[\s\p{Z}\p{Cf}\p{Cc}<>\[\](){}"'']', '', 'g'), '[/:]+$', ''), '([^/:]*)$', 1), '') AS key, label,
  nullif(regexp_extract(regexp_replace(regexp_replace(parent_iri, '[\s\p{Z}\p{Cf}\p{Cc}<>\[\](){}"'']', '', 'g'), '[/:]+$', ''), '([^/:]*)$', 1), '') AS parent, loaded_at FROM taxonomy_nodes),
nodes AS (SELECT key, label, parent FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY loaded_at DESC, coalesce(parent, '') DESC, coalesce(label, '') DESC) AS rn FROM keyed WHERE key IS NOT NULL) WHERE rn = 1),
down AS (SELECT key, label, 'root' AS status, key AS root, 0 AS depth, CAST([] AS VARCHAR[]) AS ks, CAST([] AS VARCHAR[]) AS ls FROM nodes WHERE parent IS NULL
  UNION ALL SELECT n.key, n.label, 'root', d.root, d.depth + 1, list_append(d.ks, d.key), list_append(d.ls, coalesce(d.label, '')) FROM down d JOIN nodes n ON n.parent = d.key),
lost AS (SELECT key, label FROM nodes n WHERE parent IS NOT NULL AND NOT EXISTS (SELECT 1 FROM nodes p WHERE p.key = n.parent)
  UNION ALL SELECT n.key, n.label FROM lost d JOIN nodes n ON n.parent = d.key)"""

# letter case, compatibility forms, kinds of dashes and white space don't count
_FOLD = r"""lower(trim(regexp_replace(regexp_replace(nfc_normalize(coalesce(x, '')), '[\p{Pd}\x{2212}\x{00AD}\x{2043}]', '-', 'g'), '[\s\p{Z}\p{Cf}]+', ' ', 'g')))"""

# every node's way up, until it ends or comes to a node it has passed
_UP = """up AS (SELECT n.key, n.parent AS anc, 1 AS d, [n.key] AS seen FROM nodes n JOIN nodes p ON p.key = n.parent WHERE n.parent <> n.key
  UNION ALL SELECT u.key, n.parent, u.d + 1, list_append(u.seen, u.anc) FROM up u JOIN nodes n ON n.key = u.anc JOIN nodes p ON p.key = n.parent
  WHERE n.parent <> u.anc AND NOT list_contains(u.seen, n.parent))"""

SQL = {
    "p1_found": rf"""WITH RECURSIVE {_NODES},
rows_ AS (SELECT item_id, ancestor_path, nullif(regexp_extract(regexp_replace(regexp_replace(gold_iris[1], '[\s\p{{Z}}\p{{Cf}}\p{{Cc}}<>\[\](){{}}"'']', '', 'g'), '[/:]+$', ''), '([^/:]*)$', 1), '') AS key
  FROM gold_rows WHERE item_id IS NOT NULL AND len(gold_iris) > 0 AND len(ancestor_path) > 0)
SELECT 'orphan' AS kind, 'https://vocab.lexifold.example/' || key AS record_key FROM lost
UNION ALL SELECT 'cycle', 'https://vocab.lexifold.example/' || key FROM nodes WHERE key NOT IN (SELECT key FROM down) AND key NOT IN (SELECT key FROM lost)
UNION ALL SELECT DISTINCT 'path', item_id FROM rows_ JOIN down USING (key) WHERE list_transform(ancestor_path, lambda x: {_FOLD}) <> list_transform(ls, lambda x: {_FOLD})""",
    "p1_hierarchy": f"""WITH RECURSIVE {_NODES}, {_UP}, sizes AS (SELECT anc AS key, count(*) AS below FROM up GROUP BY anc)
SELECT x.*, coalesce(s.below, 0) + 1 AS subtree_size FROM (SELECT key, label, status, root, depth, array_to_string(ks, ' > ') AS key_path, array_to_string(ls, ' > ') AS label_path FROM down
UNION ALL SELECT key, label, 'orphan', NULL, NULL, NULL, NULL FROM lost
UNION ALL SELECT key, label, 'cycle', NULL, NULL, NULL, NULL FROM nodes WHERE key NOT IN (SELECT key FROM down) AND key NOT IN (SELECT key FROM lost)) x LEFT JOIN sizes s USING (key)""",
    "p1_descendants": f"WITH RECURSIVE {_NODES}, {_UP} SELECT anc AS ancestor, key, CAST(d AS INTEGER) AS distance FROM up",
}
QUERIES = {"p1_found": p1_found, "p1_hierarchy": p1_hierarchy, "p1_descendants": p1_descendants}
