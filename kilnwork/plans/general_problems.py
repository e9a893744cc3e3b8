"""Queries of the general training-data operators (hierarchies, units)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kilnwork.operators import forest, units
from kilnwork.runtime import table


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return forest.hierarchy(table(spark, d, "wiki_categories"))


def p4_paths(spark: SparkSession, d: str) -> DataFrame:
    return forest.hierarchy(table(spark, d, "wiki_categories"), paths=True).select("category_id", "root_id", "depth", F.array_join("path", "/").alias("path"))


def p4_descendants(spark: SparkSession, d: str) -> DataFrame:
    return forest.descendants(table(spark, d, "wiki_categories"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    all_ = units.to_common_units(table(spark, d, "data_points"), table(spark, d, "property_registry"))
    return all_.where(F.col("evidence").isin(*units.PRINTED, "reversed") & (F.col("value_type") == "scalar") & F.col("mantissa").isNotNull()).select("claim_id", "mantissa", "exponent").distinct()


def p7_values(spark: SparkSession, d: str) -> DataFrame:
    return units.to_common_units(table(spark, d, "data_points"), table(spark, d, "property_registry"))


_UP = """
    WITH RECURSIVE one AS (
        SELECT category_id, min(nullif(parent_id, '')) AS up FROM wiki_categories WHERE category_id IS NOT NULL GROUP BY 1),
    v AS (SELECT a.category_id, b.category_id AS up FROM one a LEFT JOIN one b ON a.up = b.category_id),
    anc AS (SELECT category_id, up AS a FROM v WHERE up IS NOT NULL
            UNION SELECT anc.category_id, v.up FROM anc JOIN v ON anc.a = v.category_id WHERE v.up IS NOT NULL),
    onloop AS (SELECT category_id FROM anc WHERE a = category_id),
    looped AS (SELECT anc.category_id, min(a) AS root_id FROM anc JOIN onloop o ON o.category_id = anc.a GROUP BY 1),
    n AS (SELECT v.category_id, count(anc.a) AS depth FROM v LEFT JOIN anc ON anc.category_id = v.category_id GROUP BY 1),
    tops AS (SELECT category_id FROM v WHERE up IS NULL),
    tree AS (SELECT n.category_id, coalesce(t.category_id, n.category_id) AS root_id, n.depth
             FROM n LEFT JOIN (SELECT anc.category_id AS c, t.category_id FROM anc JOIN tops t ON t.category_id = anc.a) t ON t.c = n.category_id
             WHERE n.category_id NOT IN (SELECT category_id FROM looped))"""

QUERIES = {f.__name__: f for f in (p4_found, p4_paths, p4_descendants, p7_found, p7_values)}
SQL = {
    "p4_found": _UP + """
    SELECT category_id, root_id, depth::INT AS depth FROM tree
    UNION ALL SELECT category_id, root_id, -1 FROM looped""",
    "p4_paths": _UP + """
    SELECT t.category_id, t.root_id, t.depth::INT AS depth,
           coalesce((SELECT string_agg(m.category_id, '/' ORDER BY m.depth) FROM anc JOIN tree m ON m.category_id = anc.a
                     WHERE anc.category_id = t.category_id) || '/', '') || t.category_id AS path FROM tree t
    UNION ALL SELECT category_id, root_id, -1, NULL FROM looped""",
    "p4_descendants": _UP + """
    SELECT anc.a AS ancestor, t.category_id AS descendant, (t.depth - m.depth)::INT AS distance
    FROM tree t JOIN anc ON anc.category_id = t.category_id JOIN tree m ON m.category_id = anc.a""",
}
