"""Queries of the general data-preparation operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import hierarchy, nested, packed, timestamps
from ..tables import table

_ISO = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z$"


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    sites = table(spark, sf_dir, "sites").select("site_id", "tz_name", "date_order")
    works = table(spark, sf_dir, "works").select(F.lit("works").alias("src"), F.col("work_key").alias("row_id"), F.col("retrieved_at").alias("raw"), "site_id")
    notes = (
        table(spark, sf_dir, "annotations")
        .select(F.lit("annotations").alias("src"), F.col("annotation_id").alias("row_id"), F.col("annotated_at").alias("raw"), "reviewer_id")
        .join(table(spark, sf_dir, "reviewers").select("reviewer_id", "site_id"), "reviewer_id", "left")
        .select("src", "row_id", "raw", "site_id")
    )
    moments = timestamps.normal_moments(works.unionByName(notes).where(f"raw is not null and not raw rlike '{_ISO.replace(chr(92), chr(92) * 2)}'").join(sites, "site_id", "left"), "raw", "tz_name", "date_order")
    days = (
        table(spark, sf_dir, "llm_tasks")
        .select(F.lit("llm_tasks").alias("src"), F.col("task_id").alias("row_id"), F.posexplode("source.date_last_evaluated").alias("pos", "raw"))
        .where(r"raw is not null and not raw rlike '^\\d{4}-\\d{2}-\\d{2}$'")
    )
    days = timestamps.normal_days(days, "raw")
    cols = ("src", "row_id", "pos", "normal_form")
    return moments.withColumn("pos", F.lit(0)).select(*cols).unionByName(days.select(*cols)).where("normal_form is not null and row_id is not null").distinct()


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.episode_fields(table(spark, sf_dir, "episodes"))


def p3_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flat citation table, of attempts and of episodes without: one row per place, with its episode, attempt (pos_0,
    null without attempts) and place (pos_1)."""
    return nested.episode_table(table(spark, sf_dir, "episodes"), nested.CITATIONS).withColumnsRenamed({"attempt": "pos_0", "place": "pos_1"})


def p3_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flat table of codes, as p3_citations."""
    return nested.episode_table(table(spark, sf_dir, "episodes"), nested.CODES).withColumnsRenamed({"attempt": "pos_0", "place": "pos_1"})


def p3_pooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pooled figures: one row per episode, and one per bound (place) of each interval."""
    return nested.episode_table(table(spark, sf_dir, "episodes"), nested.POOLED).drop("attempt")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = packed.packed_rows(table(spark, sf_dir, "evidence_items"), "id", packed.locator_values(F.col("locator")), "evidence_items")
    genes = packed.packed_rows(table(spark, sf_dir, "genes"), "hgnc_id", packed.symbol_values(F.col("prev_symbol")), "genes")
    notes = packed.packed_rows(table(spark, sf_dir, "annotations"), "annotation_id", packed.reference_values(F.col("evidence_refs_json")), "annotations")
    return items.unionByName(genes).unionByName(notes)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.standings(table(spark, sf_dir, "terms"))


def p4_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.descendants(table(spark, sf_dir, "terms"))


def p4_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.profiles(table(spark, sf_dir, "terms"))


_EDGES = r"""
WITH RECURSIVE n AS (SELECT DISTINCT id, upper(regexp_extract(id, '^\s*([A-Za-z]+)\s*[:_]\s*0*(\d+)', 1)) || ':' || regexp_extract(id, '^\s*([A-Za-z]+)\s*[:_]\s*0*(\d+)', 2) AS k FROM terms WHERE id IS NOT NULL),
u AS (SELECT DISTINCT id AS child, unnest(parents) AS p FROM terms),
e AS (SELECT DISTINCT u.child, n.id AS parent FROM u JOIN n ON n.k = upper(regexp_extract(u.p, '^\s*([A-Za-z]+)\s*[:_]\s*0*(\d+)', 1)) || ':' || regexp_extract(u.p, '^\s*([A-Za-z]+)\s*[:_]\s*0*(\d+)', 2)),
r(node, origin, steps) AS (SELECT id, id, 0 FROM n UNION SELECT e.child, r.origin, r.steps + 1 FROM r JOIN e ON e.parent = r.node WHERE r.steps < 200),
a AS (SELECT node, origin, min(steps) AS steps FROM r GROUP BY ALL),
c AS (SELECT DISTINCT r.node FROM r WHERE r.node = r.origin AND r.steps > 0),
t AS (SELECT a.* FROM a WHERE a.origin NOT IN (SELECT child FROM e))"""

ORACLES = {
    "p4_found": _EDGES + """
SELECT node AS term_id, 'rooted' AS standing, origin AS root_id, CAST(steps AS INTEGER) AS n_steps FROM t WHERE node NOT IN (SELECT node FROM c)
UNION ALL SELECT node, 'cycle', '', -1 FROM c
UNION ALL SELECT id, 'stray', '', -1 FROM n WHERE id NOT IN (SELECT node FROM t) AND id NOT IN (SELECT node FROM c)""",
    "p4_descendants": _EDGES + " SELECT origin AS ancestor, node AS descendant, CAST(steps AS INTEGER) AS n_steps FROM a",
}

QUERIES = {f.__name__: f for f in (p1_found, p3_found, p3_citations, p3_codes, p3_pooled, p4_found, p4_descendants, p4_profiles, p5_found)}
