"""Graph snapshots: newline-delimited JSON with a header, nodes and edges."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F

from graphloom.operators.references import canonical_uri

FORMAT, VERSION = "graphloom-snapshot", 1
LINE = "type string, format string, version int, repo string, id string, kind string, name string, path string, from string, to string, edge_type string, rel string, props map<string,string>"


def export_snapshot(nodes: DataFrame, edges: DataFrame, path: str, repo: str) -> None:
    """Write one member: a header file, then node and edge part files; read in name order header, nodes, edges."""
    spark = nodes.sparkSession
    head = json.dumps({"type": "header", "format": FORMAT, "version": VERSION, "repo": repo})
    spark.createDataFrame([(head,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/0-header")
    n = nodes.where(F.col("repo") == repo).select(F.to_json(F.struct(F.lit("node").alias("type"), "id", "kind", "name", "path", "props")).alias("value"))
    n.write.mode("overwrite").text(f"{path}/1-nodes")
    e = edges.where(F.col("src_repo") == repo).select(F.to_json(F.struct(F.lit("edge").alias("type"), F.col("src_id").alias("from"), F.col("dst_id").alias("to"), "edge_type", "props")).alias("value"))
    e.write.mode("overwrite").text(f"{path}/2-edges")


def peek_header(spark: SparkSession, path: str) -> dict:
    """The header; a snapshot of another format or version is refused."""
    first = spark.read.text(f"{path}/0-header").first()
    head = json.loads(first[0]) if first else {}
    if head.get("type") != "header" or head.get("format") != FORMAT or head.get("version") != VERSION:
        raise ValueError(f"{path} is no {FORMAT} of version {VERSION}")
    return head


def import_snapshot(spark: SparkSession, path: str, repo: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a snapshot; ``repo`` renames the member, in URIs too. ``rel`` is read as an older ``edge_type``."""
    old = peek_header(spark, path)["repo"]
    new = repo or old
    rows = spark.read.text([f"{path}/1-nodes", f"{path}/2-edges"]).select(F.from_json("value", LINE).alias("x")).select("x.*")
    rename = lambda v: F.regexp_replace(v, F.lit(f"^repo://{old}/"), F.lit(f"repo://{new}/"))
    props = F.transform_values("props", lambda k, v: F.when(k == "repo_uri", rename(v)).otherwise(v))
    nodes = rows.where("type = 'node'").select(F.lit(new).alias("repo"), "id", "kind", "name", "path", props.alias("props"))
    edges = rows.where("type = 'edge'").select(F.lit(new).alias("src_repo"), F.col("from").alias("src_id"), F.lit(new).alias("dst_repo"), F.col("to").alias("dst_id"), F.coalesce("edge_type", "rel").alias("edge_type"), "props")
    return nodes, edges


def uri_conflicts(nodes: DataFrame) -> DataFrame:
    """(uri, nodes): URIs that more than one node claims."""
    return nodes.where("uri <> ''").groupBy(canonical_uri(F.col("uri")).alias("uri")).agg(F.countDistinct("repo", "id").alias("nodes")).where("nodes > 1")
