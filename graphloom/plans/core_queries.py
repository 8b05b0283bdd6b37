"""Queries of the general problems (2, 4, 5) over whole tables, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from graphloom.operators import hierarchy, references, skew
from graphloom.plans.tables import table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return skew.hot_ids(table(spark, d, "edges")).select("id")


def p2_degrees(spark: SparkSession, d: str) -> DataFrame:
    return skew.degrees(table(spark, d, "edges")).select("id", "degree")


def p2_hub_drift(spark: SparkSession, d: str) -> DataFrame:
    """Per reported hub: its true degree over all members beside the largest reported one.

    Joins every endpoint with the hub list, fragment-replicated, then counts per hub.
    """
    ends = skew.endpoints(table(spark, d, "edges"))
    hubs = table(spark, d, "hubs").where("id is not null and id <> ''").groupBy("id").agg(F.max("degree").alias("reported"), F.countDistinct("repo").alias("members"))
    plan = skew.plan_fragments(ends, "id")
    joined = skew.fragment_join(ends, hubs, "id", F.struct("edge_id", "side"), plan)
    kept = joined.groupBy("id", "edge_id", "side").agg(F.max("reported").alias("reported"), F.max("members").alias("members"))
    return kept.groupBy("id").agg(F.count("*").alias("degree"), F.max("reported").cast("long").alias("reported"), F.max("members").alias("members"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.rootless(table(spark, d, "spans"))


def p4_tree(spark: SparkSession, d: str) -> DataFrame:
    tree = hierarchy.forest(table(spark, d, "spans"), paths=True)
    return tree.select("trace_file", "span_id", "parent_id", "root", F.col("depth").cast("long").alias("depth"), "descendants", "path")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).select("source_table", "edge_id", "side")


def p5_by_period(spark: SparkSession, d: str) -> DataFrame:
    return references.orphans_by_period(_orphans(spark, d))


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    return references.orphan_references(table(spark, d, "edges"), table(spark, d, "overlay_edges"), table(spark, d, "nodes"))


QUERIES = {f.__name__: f for f in (p2_found, p2_degrees, p2_hub_drift, p4_found, p4_tree, p5_found, p5_by_period)}

_DEGREE = """
d AS (SELECT id, count(*) AS degree FROM (
  SELECT DISTINCT src_id AS id, 0 AS s, edge_id FROM edges UNION ALL SELECT DISTINCT dst_id, 1, edge_id FROM edges)
  WHERE id IS NOT NULL AND id <> '' GROUP BY id)
"""

_SPANS = r"""
c AS (SELECT trace_file, name, received_at,
    CASE WHEN regexp_matches(s, '^0*$') THEN NULL ELSE s END AS sid,
    CASE WHEN regexp_matches(a, '^0*$') THEN NULL ELSE a END AS p1,
    CASE WHEN regexp_matches(b, '^0*$') THEN NULL ELSE b END AS p2,
    nullif(trim(parent, E' \t\r\n'), '') AS pname
  FROM (SELECT *, lower(trim(span_id, E' \t\r\n')) AS s, lower(trim(parent_span_id, E' \t\r\n')) AS a, lower(trim(parent, E' \t\r\n')) AS b FROM spans)),
t AS (SELECT * FROM (SELECT *, trim(name, E' \t\r\n') AS nm, row_number() OVER (PARTITION BY trace_file, sid ORDER BY received_at DESC NULLS LAST) AS rn
  FROM c WHERE sid IS NOT NULL) WHERE rn = 1),
u AS (SELECT trace_file, nm, min(sid) AS sid FROM t WHERE nm IS NOT NULL GROUP BY ALL HAVING count(*) = 1),
par AS (SELECT t.trace_file, t.sid, coalesce(x.sid, y.sid, u.sid) AS parent_id FROM t
  LEFT JOIN t x ON x.trace_file = t.trace_file AND x.sid = t.p1
  LEFT JOIN t y ON y.trace_file = t.trace_file AND y.sid = t.p2
  LEFT JOIN u ON u.trace_file = t.trace_file AND u.nm = t.pname),
tree AS (SELECT trace_file, sid, sid AS root, 0 AS depth, '/' || sid AS path FROM par WHERE parent_id IS NULL
  UNION ALL SELECT p.trace_file, p.sid, tree.root, tree.depth + 1, tree.path || '/' || p.sid FROM par p JOIN tree ON tree.trace_file = p.trace_file AND tree.sid = p.parent_id)
"""

_ORPHANS = """
r AS (SELECT 'edges' AS source_table, edge_id, side, edge_type, written_at, repo, k FROM (
    SELECT edge_id, edge_type, written_at, 'src' AS side, src_repo AS repo, src_id AS k FROM edges
    UNION ALL SELECT edge_id, edge_type, written_at, 'dst', dst_repo, dst_id FROM edges) WHERE coalesce(k, '') <> ''),
o AS (SELECT 'overlay_edges' AS source_table, edge_id, side, edge_type, written_at, url_decode(replace(trim(k), '+', '%2B')) AS k FROM (
    SELECT edge_id, edge_type, written_at, 'src' AS side, src_uri AS k FROM overlay_edges
    UNION ALL SELECT edge_id, edge_type, written_at, 'dst', dst_uri FROM overlay_edges) WHERE coalesce(trim(k), '') <> ''),
n AS (SELECT url_decode(replace(trim(props['repo_uri']), '+', '%2B')) AS k, indexed_at, deleted_at FROM nodes),
f AS (SELECT source_table, edge_id, side, min(edge_type) AS edge_type, min(written_at) AS written_at FROM (
  SELECT source_table, edge_id, side, edge_type, written_at FROM r WHERE NOT EXISTS (SELECT 1 FROM nodes x WHERE x.repo = r.repo AND x.id = r.k
    AND x.indexed_at <= r.written_at AND (x.deleted_at IS NULL OR r.written_at < x.deleted_at))
  UNION ALL SELECT source_table, edge_id, side, edge_type, written_at FROM o WHERE NOT EXISTS (SELECT 1 FROM n x WHERE x.k = o.k
    AND x.indexed_at <= o.written_at AND (x.deleted_at IS NULL OR o.written_at < x.deleted_at))) GROUP BY source_table, edge_id, side)
"""

SQL = {
    "p2_found": f"WITH {_DEGREE} SELECT id FROM d WHERE degree >= 0.01 * (SELECT count(DISTINCT edge_id) FROM edges)",
    "p2_degrees": f"WITH {_DEGREE} SELECT id, degree FROM d",
    "p2_hub_drift": f"""WITH {_DEGREE}, h AS (SELECT id, max(degree) AS reported, count(DISTINCT repo) AS members FROM hubs WHERE id <> '' GROUP BY id)
SELECT d.id, d.degree, CAST(h.reported AS BIGINT) AS reported, h.members FROM d JOIN h ON d.id = h.id""",
    "p4_found": f"WITH RECURSIVE {_SPANS} SELECT trace_file, sid AS span_id FROM par WHERE NOT EXISTS (SELECT 1 FROM tree WHERE tree.trace_file = par.trace_file AND tree.sid = par.sid)",
    "p4_tree": f"""WITH RECURSIVE {_SPANS}, sub AS (SELECT a.trace_file, a.sid, count(*) - 1 AS descendants FROM tree a JOIN tree b ON a.trace_file = b.trace_file AND (b.path = a.path OR starts_with(b.path, a.path || '/')) GROUP BY ALL)
SELECT p.trace_file, p.sid AS span_id, p.parent_id, t.root, CAST(t.depth AS BIGINT) AS depth, s.descendants, t.path FROM par p
LEFT JOIN tree t ON t.trace_file = p.trace_file AND t.sid = p.sid LEFT JOIN sub s ON s.trace_file = p.trace_file AND s.sid = p.sid""",
    "p5_found": f"WITH {_ORPHANS} SELECT source_table, edge_id, side FROM f",
    "p5_by_period": f"""WITH {_ORPHANS} SELECT source_table, edge_type, strftime(written_at, '%Y-%m') AS month, count(*) AS orphans,
count(*) FILTER (side = 'src') AS src_orphans, count(*) FILTER (side = 'dst') AS dst_orphans FROM f GROUP BY ALL""",
}
