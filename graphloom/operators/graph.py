"""The typed property graph: live nodes and edges, adjacency, search, seeds, federation.

``live_nodes`` keeps the latest life of each (repo, id) and drops the dead; ``live_edges``
keeps one row per (source, type, target), with the greatest signal values of its
deliveries. Null and empty endpoints are no endpoints.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from graphloom.functions.text import prop_double, prop_int
from graphloom.operators.references import canonical_uri

EDGE = ["src_repo", "src_id", "edge_type", "dst_repo", "dst_id"]
CODE_KINDS = ("function", "method", "type", "module", "file")


def live_nodes(nodes: DataFrame) -> DataFrame:
    """(repo, id, kind, name, path, start_line, end_line, uri); empty strings stand for nulls."""
    text = lambda c: F.coalesce(c, F.lit(""))
    row = F.struct(
        F.coalesce(F.col("indexed_at"), F.lit("0001-01-01").cast("timestamp_ntz")).alias("t"),
        F.col("deleted_at").isNull().cast("int").alias("alive"),
        text(F.col("kind")).alias("kind"),
        text(F.col("name")).alias("name"),
        text(F.col("path")).alias("path"),
        prop_int("start_line").alias("start_line"),
        prop_int("end_line").alias("end_line"),
        text(F.col("props")["repo_uri"]).alias("uri"),
    )
    last = nodes.where("repo is not null and id is not null").groupBy("repo", "id").agg(F.max(row).alias("n"))
    return last.where("n.alive = 1").select("repo", "id", "n.kind", "n.name", "n.path", "n.start_line", "n.end_line", "n.uri")


def live_edges(edges: DataFrame) -> DataFrame:
    """EDGE columns, weight (null if none), support, calls (0 if none)."""
    there = F.coalesce(F.col("src_id"), F.lit("")) != ""
    there = there & (F.coalesce(F.col("dst_id"), F.lit("")) != "") & F.col("src_repo").isNotNull() & F.col("dst_repo").isNotNull() & F.col("edge_type").isNotNull()
    return edges.where(there).groupBy(*EDGE).agg(F.max(prop_double("weight")).alias("weight"), F.max(prop_int("support")).alias("support"), F.max(prop_int("count")).alias("calls"))


def resolve_overlay(overlay: DataFrame, nodes: DataFrame) -> DataFrame:
    """Overlay edges with both URIs looked up: EDGE columns (null where no live node has the URI) and match."""
    uris = nodes.where("uri <> ''").select(canonical_uri(F.col("uri")).alias("uri"), "repo", "id").groupBy("uri").agg(F.min(F.struct("repo", "id")).alias("n"))
    rows = overlay.select(canonical_uri(F.col("src_uri")).alias("su"), canonical_uri(F.col("dst_uri")).alias("du"), "edge_type", F.col("props")["match"].alias("match")).where("su <> '' and du <> ''").distinct()
    for side, key in (("src", "su"), ("dst", "du")):
        rows = rows.join(uris.select(F.col("uri").alias(key), F.col("n.repo").alias(f"{side}_repo"), F.col("n.id").alias(f"{side}_id")), key, "left")
    return rows.select(*EDGE, "match", F.col("su").alias("src_uri"), F.col("du").alias("dst_uri"))


def federated_edges(edges: DataFrame, overlay: DataFrame, nodes: DataFrame) -> DataFrame:
    """Member edges and resolved overlay edges in one table, each side with its member."""
    crossing = resolve_overlay(overlay, nodes).where("src_id is not null and dst_id is not null").groupBy(*EDGE).agg(F.lit(None).cast("double").alias("weight"), F.lit(0).alias("support"), F.lit(0).alias("calls"))
    return live_edges(edges).unionByName(crossing)


def between_live(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose two ends are live nodes."""
    keys = nodes.select("repo", "id")
    out = edges.join(keys.toDF("src_repo", "src_id"), ["src_repo", "src_id"], "left_semi")
    return out.join(keys.toDF("dst_repo", "dst_id"), ["dst_repo", "dst_id"], "left_semi")


def adjacent(edges: DataFrame, seeds: DataFrame, direction: str = "both", edge_type: str | None = None) -> DataFrame:
    """(seed_repo, seed_id, dir, edge_type, repo, id) around ``seeds`` (repo, id)."""
    if edge_type:
        edges = edges.where(F.col("edge_type") == edge_type)
    ways = []
    for way, near, far in (("out", "src", "dst"), ("in", "dst", "src")):
        if direction in (way, "both"):
            here = edges.join(seeds.select(F.col("repo").alias(f"{near}_repo"), F.col("id").alias(f"{near}_id")).distinct(), [f"{near}_repo", f"{near}_id"])
            ways.append(here.select(F.col(f"{near}_repo").alias("seed_repo"), F.col(f"{near}_id").alias("seed_id"), F.lit(way).alias("dir"), "edge_type", F.col(f"{far}_repo").alias("repo"), F.col(f"{far}_id").alias("id")))
    return ways[0] if len(ways) == 1 else ways[0].unionByName(ways[1])


def search(nodes: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """Nodes whose id or name contains the query (case counts), by id; an empty query matches all."""
    return nodes.where(F.col("id").contains(query) | F.col("name").contains(query)).orderBy("id", "repo").limit(limit)


def unique_or_drop(rows: DataFrame, keys: list[str], tier: Column) -> DataFrame:
    """Of each key's rows those of the best (lowest) tier, if there is exactly one."""
    ranked = rows.withColumn("_tier", tier).where("_tier is not null")
    best = ranked.groupBy(*keys).agg(F.min(F.struct("_tier", *[c for c in rows.columns if c not in keys])).alias("_best"), F.min("_tier").alias("_low"))
    counts = ranked.groupBy(*keys, "_tier").count().withColumnRenamed("_tier", "_low")
    kept = best.join(counts, [*keys, "_low"]).where("count = 1")
    return kept.select(*keys, *[F.col(f"_best.{c}").alias(c) for c in rows.columns if c not in keys])


def resolve_seeds(nodes: DataFrame, queries: DataFrame) -> DataFrame:
    """(query, repo, id, tier) for each query that names one node: by URI (0), id (1), then name.

    By name: the only node that is no placeholder (2); of several the only function, method,
    type, operation or schema (3); or the only type, if all others are files, modules and packages
    (4); if there are none, the only symbol or import (5). An ambiguous name resolves to nothing.
    """
    q = queries.select("query").distinct()
    direct = q.join(nodes, F.col("query") == F.col("uri")).select("query", "repo", "id", F.lit(0).alias("tier"))
    direct = direct.unionByName(q.join(nodes, F.col("query") == F.col("id")).select("query", "repo", "id", F.lit(1).alias("tier")))
    direct = unique_or_drop(direct.distinct(), ["query"], F.col("tier"))
    node = F.struct("repo", "id")
    kind = {"any": ~F.col("kind").isin("symbol", "import"), "code": F.col("kind").isin("function", "method", "type", "operation", "schema"), "type": F.col("kind") == "type", "box": F.col("kind").isin("file", "module", "package"), "loose": F.col("kind").isin("symbol", "import")}
    # one row per name, reduced on the map side: a name that very many nodes have is no hot group
    by_name = nodes.where("name <> ''").groupBy(F.col("name").alias("query")).agg(*[F.count_if(c).alias(f"n_{k}") for k, c in kind.items()], *[F.min(F.when(c, node)).alias(k) for k, c in kind.items() if k != "box"])
    pick = (
        F.when(F.col("n_any") == 1, F.struct(F.lit(2).alias("tier"), F.col("any").alias("n")))
        .when(F.col("n_code") == 1, F.struct(F.lit(3).alias("tier"), F.col("code").alias("n")))
        .when((F.col("n_type") == 1) & (F.col("n_type") + F.col("n_box") == F.col("n_any")), F.struct(F.lit(4).alias("tier"), F.col("type").alias("n")))
        .when((F.col("n_any") == 0) & (F.col("n_loose") == 1), F.struct(F.lit(5).alias("tier"), F.col("loose").alias("n")))
    )
    seen = nodes.select(F.explode(F.array("uri", "id")).alias("query")).where("query <> ''").distinct()
    named = by_name.join(q, "query", "left_semi").join(seen, "query", "left_anti").select("query", pick.alias("p")).where("p is not null")
    return direct.unionByName(named.select("query", "p.n.repo", "p.n.id", "p.tier"))


def references_to(edges: DataFrame, nodes: DataFrame, names: DataFrame) -> DataFrame:
    """(repo, id, from_repo, from_id): callers of each unique ``name``, else callers of its symbol placeholder."""
    unique = nodes.where("kind in ('function', 'method')").join(names, "name", "left_semi").groupBy("name").agg(F.min("repo").alias("repo"), F.min("id").alias("id"), F.count("*").alias("c")).where("c = 1")
    calls = edges.where("edge_type = 'calls'").select(F.col("dst_repo").alias("repo"), F.col("dst_id").alias("id"), F.col("src_repo").alias("from_repo"), F.col("src_id").alias("from_id"))
    direct = calls.join(unique, ["repo", "id"]).select("name", "from_repo", "from_id")
    lost = unique.join(direct, "name", "left_anti")
    symbol = calls.withColumn("name", F.regexp_extract("id", "^symbol:(.*)$", 1)).where("name <> ''")
    return direct.unionByName(symbol.join(lost.select("name"), "name").select("name", "from_repo", "from_id")).distinct()


def with_uris(nodes: DataFrame) -> DataFrame:
    """Live nodes, those without a URI given the canonical one (rows stored before URIs existed)."""
    from graphloom.functions.paths import assigned_uri

    return nodes.withColumn("uri", F.when(F.col("uri") != "", F.col("uri")).otherwise(assigned_uri(F.col("repo"), F.col("id"), F.col("kind"))))


def edge_changes(existing: DataFrame, desired: DataFrame) -> DataFrame:
    """(EDGE, action): what turns the existing edges into the desired ones, ``delete`` or ``upsert``; edges in both stay."""
    old, new = existing.select(*EDGE).distinct(), desired.select(*EDGE).distinct()
    return old.join(new, EDGE, "left_anti").withColumn("action", F.lit("delete")).unionByName(new.join(old, EDGE, "left_anti").withColumn("action", F.lit("upsert")))


def replace_family(edges: DataFrame, types: tuple[str, ...], new: DataFrame) -> DataFrame:
    """The edges without those of a derived family, and the family computed again."""
    return edges.where(~F.col("edge_type").isin(*types)).unionByName(new.where(F.col("edge_type").isin(*types)), allowMissingColumns=True)


def owners(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, repo, members): the member that has each of the ``ids`` (id); null where several have it, which is a conflict."""
    held = ids.select("id").distinct().join(nodes.select("id", "repo"), "id").groupBy("id").agg(F.count_distinct("repo").alias("members"), F.min("repo").alias("repo"))
    return held.select("id", F.when(F.col("members") == 1, F.col("repo")).alias("repo"), "members")


def missing_members(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """(member): listed members of which there is no node; a workspace opens without them, with a warning."""
    return members.select("member").where("member is not null").distinct().join(nodes.select(F.col("repo").alias("member")).distinct(), "member", "left_anti")
