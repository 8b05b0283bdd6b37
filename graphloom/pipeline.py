"""From source trees to a stored graph, step by step and only for what changed.

``index`` scans a tree, compares fingerprints with those stored in file nodes, parses new and
changed files and replaces what they owned; vanished files go. The store keeps what texts
say: calls lead to names (``symbol:NAME``), so a later file can settle an earlier call.
``resolved`` gives the graph with calls, relative imports and type names led to their nodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from graphloom.functions.paths import assigned_uri, id_path
from graphloom.operators import resolution, tracing
from graphloom.operators.graph import EDGE
from graphloom.plans.iterate import written
from graphloom.sources import documents, extract, files, store

NODE = "repo string, id string, kind string, name string, path string, start_line int, end_line int, uri string, sha256 string"
SIGNALS = {"weight": "double", "support": "int", "calls": "int"}


def graph_of(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (``NODE``) and edges (EDGE and signals) of source files and Markdown texts (repo, path, text, sha256)."""
    parsed = written(extract.parse_files(texts))
    nodes = parsed.select("repo", "path", F.inline("nodes"))
    edges = parsed.select("repo", F.inline("edges"))
    headings = documents.markdown_headings(texts.where(F.col("path").rlike(r"(?i)\.(md|mdx)$")))
    docs = texts.where(F.col("path").rlike(r"(?i)\.(md|mdx)$")).select("repo", "path")
    base = F.regexp_extract("path", r"([^/]*?)(?:\.[^./]*)?$", 1)
    doc_id = F.concat(F.lit("doc:"), "path", F.lit("#"), base)
    line = F.lit(None).cast("int")
    nodes = nodes.select("repo", "id", "kind", "name", "path", "start_line", "end_line")
    nodes = nodes.unionByName(docs.select("repo", F.concat(F.lit("file:"), "path").alias("id"), F.lit("file").alias("kind"), F.col("path").alias("name"), "path", line.alias("start_line"), line.alias("end_line")))
    nodes = nodes.unionByName(docs.select("repo", doc_id.alias("id"), F.lit("doc").alias("kind"), base.alias("name"), "path", line.alias("start_line"), line.alias("end_line")))
    nodes = nodes.unionByName(headings.select("repo", "id", F.lit("heading").alias("kind"), F.col("title").alias("name"), "path", F.col("line").cast("int").alias("start_line"), F.col("line").cast("int").alias("end_line")))
    edges = edges.unionByName(docs.select("repo", F.concat(F.lit("file:"), "path").alias("src"), doc_id.alias("dst"), F.lit("contains").alias("type")))
    edges = edges.unionByName(headings.select("repo", doc_id.alias("src"), F.col("id").alias("dst"), F.lit("contains").alias("type")))
    symbols = edges.where(F.col("dst").startswith("symbol:")).select("repo", F.col("dst").alias("id")).distinct()
    nodes = nodes.unionByName(symbols.select("repo", "id", F.lit("symbol").alias("kind"), F.expr("substr(id, 8)").alias("name"), F.lit("").alias("path"), line.alias("start_line"), line.alias("end_line")))
    prints = texts.select("repo", F.concat(F.lit("file:"), "path").alias("id"), "sha256")
    nodes = nodes.dropDuplicates(["repo", "id"]).withColumn("uri", assigned_uri(F.col("repo"), F.col("id"), F.col("kind"))).join(prints, ["repo", "id"], "left")
    whole = nodes.select("repo", "id", "kind", "name", "path", F.coalesce("start_line", F.lit(0)).alias("start_line"), F.coalesce("end_line", F.lit(0)).alias("end_line"), "uri", "sha256")
    none = [F.lit(0 if t == "int" else None).cast(t).alias(c) for c, t in SIGNALS.items()]
    links = edges.select(F.col("repo").alias("src_repo"), F.col("src").alias("src_id"), F.col("type").alias("edge_type"), F.col("repo").alias("dst_repo"), F.col("dst").alias("dst_id"), *none).dropDuplicates(EDGE)
    return whole, links


def index(spark: SparkSession, root: str, target: str, repo: str, **scan) -> dict[str, int]:
    """Bring the store ``target`` up to date with the tree ``root`` as member ``repo``; counts of files per action."""
    tree = files.scan_tree(spark, root, **scan)
    known = files.extension(F.col("path")).isin(*files.LANGUAGES, "mdx") & ~files.extension(F.col("path")).isin("yaml", "yml", "json")
    found = written(tree.where(known).select(F.lit(repo).alias("repo"), "path", F.decode("content", "utf-8").alias("text"), F.sha2("content", 256).alias("sha256")))
    there = store.exists(spark, target)
    if there:
        held = store.read_graph(spark, target)[0].where((F.col("repo") == repo) & (F.col("kind") == "file")).select("repo", F.expr("substr(id, 6)").alias("path"), "sha256")
    else:
        held = spark.createDataFrame([], "repo string, path string, sha256 string")
    changes = written(resolution.scan_changes(held, found.select("repo", "path", "sha256")))
    counts = {r["action"]: r["n"] for r in changes.groupBy("action").agg(F.count("*").alias("n")).collect()}
    if set(counts) - {"skip"}:
        new = found.join(changes.where("action in ('add', 'replace')").select("repo", "path"), ["repo", "path"], "left_semi")
        nodes, edges = (written(x) for x in graph_of(new))
        if there:
            store.replace_in_store(spark, target, changes.where("action <> 'skip'").select("repo", "path"), nodes, edges)
        else:
            store.write_graph(nodes, edges, target)
    return counts


def resolved(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The edges with calls, relative imports and type names of each member led to their nodes; what can't be stays as it is."""
    calls = edges.where("edge_type = 'calls' and src_repo = dst_repo").where(F.col("dst_id").startswith("symbol:"))
    callees = resolution.resolve_callees(calls.select(F.col("src_repo").alias("repo"), "src_id", F.expr("substr(dst_id, 8)").alias("callee")), nodes)
    callees = callees.select(F.col("repo").alias("src_repo"), "src_id", F.lit("calls").alias("edge_type"), F.concat(F.lit("symbol:"), "callee").alias("dst_id"), F.col("id").alias("to"))
    imports = edges.where("edge_type = 'imports'").where(F.col("dst_id").rlike(r"^import:[^#]*#\."))
    specs = imports.select(F.col("src_repo").alias("repo"), id_path(F.col("src_id")).alias("path"), F.regexp_extract("dst_id", "#(.*)$", 1).alias("spec"))
    modules = nodes.where("kind = 'module'").select("repo", F.regexp_extract("id", "^module:(.*)$", 1).alias("path"))
    hit = resolution.resolve_imports(specs, modules)
    hit = hit.select(F.col("repo").alias("src_repo"), F.lit("imports").alias("edge_type"), F.concat(F.lit("import:"), "path", F.lit("#"), "spec").alias("dst_id"), F.concat(F.lit("module:"), "target").alias("to")).distinct()
    uses = edges.where("edge_type in ('inherits', 'references')").where(F.col("dst_id").startswith("symbol:"))
    types = resolution.resolve_types(uses.select(F.col("src_repo").alias("repo"), "src_id", F.substring_index("dst_id", ":", -1).alias("type_name")), nodes)
    types = types.select(F.col("repo").alias("src_repo"), "src_id", F.concat(F.lit("symbol:"), "type_name").alias("dst_id"), F.col("id").alias("to")).distinct()
    step = edges.join(callees, ["src_repo", "src_id", "edge_type", "dst_id"], "left").withColumn("dst_id", F.coalesce("to", "dst_id")).drop("to")
    step = step.join(hit, ["src_repo", "edge_type", "dst_id"], "left").withColumn("dst_id", F.coalesce("to", "dst_id")).drop("to")
    step = step.join(types, ["src_repo", "src_id", "dst_id"], "left").withColumn("dst_id", F.when(F.col("edge_type").isin("inherits", "references"), F.coalesce("to", "dst_id")).otherwise(F.col("dst_id"))).drop("to")
    return step.select(edges.columns).dropDuplicates(EDGE)


def ingest_traces(spark: SparkSession, target: str, spans: DataFrame) -> int:
    """Add the observed calls of spans (as the table ``spans``) to a store; counts of earlier imports add up. Gives the number of edges."""
    nodes, edges = store.read_graph(spark, target)
    edges = written(edges)
    seen = tracing.observed_calls(spans, nodes)
    old = edges.where("edge_type = 'observed_calls'").select("src_repo", "src_id", "dst_repo", "dst_id", F.col("calls").cast("long").alias("calls"), F.lit(None).cast("timestamp_ntz").alias("last_seen"))
    total = written(tracing.add_counts(old, seen))
    new = total.select("src_repo", "src_id", F.lit("observed_calls").alias("edge_type"), "dst_repo", "dst_id", F.lit(None).cast("double").alias("weight"), F.lit(0).alias("support"), F.col("calls").cast("int").alias("calls"))
    store.write_graph(written(nodes), edges.where("edge_type <> 'observed_calls'").unionByName(new.select(edges.columns)), target)
    return total.count()
