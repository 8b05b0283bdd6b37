"""The graph on disk: versioned Parquet tables in buckets of members, replaced file by file.

Readers see one version or the next (``plans.versions``). An update reads and writes only the
buckets of members whose files it replaces, and of members with edges into what goes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from graphloom.plans.iterate import cut
from graphloom.plans.versions import Versions

KEY = ["repo", "id"]
ENDS = (("src_repo", "src_id"), ("dst_repo", "dst_id"))
BUCKETS, FILES = 64, 8  # buckets of members; tasks that write one bucket


def _store(spark: SparkSession, root: str, nodes: DataFrame | None = None, edges: DataFrame | None = None) -> Versions:
    store = Versions(spark, root, {}, {"nodes": ["repo"], "edges": ["src_repo"]})
    if nodes is not None:
        store.schemas = {name: ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) for name, df in (("nodes", nodes), ("edges", edges))}
    else:
        store.schemas = store.manifest()["schemas"]
    return store


def _spread() -> dict:
    return {"nodes": F.pmod(F.xxhash64("id"), F.lit(FILES)), "edges": F.pmod(F.xxhash64("src_id"), F.lit(FILES))}


def exists(spark: SparkSession, root: str) -> bool:
    return bool(Versions(spark, root, {}, {}).versions())


def read_graph(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    store = _store(spark, root)
    now = store.manifest()
    return store.read("nodes", manifest=now), store.read("edges", manifest=now)


def write_graph(nodes: DataFrame, edges: DataFrame, root: str) -> int:
    """Write all of a graph as the next version; gives its number."""
    store = _store(nodes.sparkSession, root, nodes, edges)
    old = store.manifest()
    new = {"version": old["version"] + 1, "schemas": store.schemas, "tables": {}}
    folder = store.folder(new["version"])
    for name, df in (("nodes", nodes), ("edges", edges)):
        store.write(old, new, folder, name, df, BUCKETS, set(range(BUCKETS)), _spread()[name])
    store.commit(new)
    return new["version"]


def replace_in_store(spark: SparkSession, root: str, files: DataFrame, new_nodes: DataFrame, new_edges: DataFrame) -> int:
    """``replace_files`` on a stored graph; only the buckets it changes are written."""
    store = _store(spark, root)
    old = store.manifest()
    new = {"version": old["version"] + 1, "schemas": store.schemas, "tables": {}}
    folder = store.folder(new["version"])
    at = store.touched("nodes", BUCKETS, files.select("repo").union(new_nodes.select("repo")))
    nodes = store.read("nodes", at, old)
    went = cut(nodes.where("kind <> 'symbol'").join(files.select("repo", "path").distinct(), ["repo", "path"], "left_semi").select(*KEY).join(new_nodes.select(*KEY), KEY, "left_anti"))
    into = store.read("edges", manifest=old).select("src_repo", *ENDS[1]).join(went.toDF(*ENDS[1]), list(ENDS[1]), "left_semi")
    at_edges = at | store.touched("edges", BUCKETS, into) | store.touched("edges", BUCKETS, new_edges)
    targets = store.read("nodes", manifest=old).select(*KEY)  # ends may lie in members that don't change
    kept, both = replace_files(nodes, store.read("edges", at_edges, old), files, new_nodes, new_edges, targets.join(went, KEY, "left_anti"))
    store.write(old, new, folder, "nodes", kept, BUCKETS, at, _spread()["nodes"])
    store.write(old, new, folder, "edges", both, BUCKETS, at_edges, _spread()["edges"])
    store.commit(new)
    return new["version"]


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new``, and those of ``old`` whose key ``new`` doesn't have."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new.dropDuplicates(keys))


def delete_nodes(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Without the nodes ``gone`` (repo, id) and without every edge that touches one."""
    gone = gone.select(*KEY).distinct()
    for pair in ENDS:
        edges = edges.join(gone.toDF(*pair), list(pair), "left_anti")
    return nodes.join(gone, KEY, "left_anti"), edges


def replace_files(nodes: DataFrame, edges: DataFrame, files: DataFrame, new_nodes: DataFrame, new_edges: DataFrame, others: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The graph after ``files`` (repo, path) were parsed again: what they owned goes, the new rows come.

    Symbols belong to no file. An edge into a replaced file stays if its target exists again.
    ``others`` (repo, id) are further nodes at which edges may end.
    """
    owned = nodes.where("kind <> 'symbol'").join(files.select("repo", "path").distinct(), ["repo", "path"], "left_semi").select(*KEY)
    out_edges = edges.join(owned.toDF(*ENDS[0]), list(ENDS[0]), "left_anti")
    kept = nodes.join(owned, KEY, "left_anti").join(new_nodes.select(*KEY), KEY, "left_anti").unionByName(new_nodes.dropDuplicates(KEY))
    both = out_edges.unionByName(new_edges).dropDuplicates(["src_repo", "src_id", "edge_type", "dst_repo", "dst_id"])
    live = kept.select(*KEY) if others is None else kept.select(*KEY).unionByName(others)
    for pair in ENDS:
        both = both.join(live.toDF(*pair), list(pair), "left_semi")
    return kept, both


def prune_placeholders(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Without ``symbol`` nodes that no edge touches."""
    used = edges.select(F.col("src_repo").alias("repo"), F.col("src_id").alias("id")).union(edges.select("dst_repo", "dst_id")).distinct()
    return nodes.where("kind <> 'symbol'").unionByName(nodes.where("kind = 'symbol'").join(used, KEY, "left_semi"))
