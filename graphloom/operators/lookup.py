"""Answers around single symbols: snippets, documentation, members, questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from graphloom.functions.text import symbol_label

KEY = ["repo", "id"]


def snippets(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """(repo, id, snippet): the node's lines in its file, else the first line with its name.

    ``texts`` (repo, path, text) has one row per file.
    """
    rows = nodes.where("path <> ''").select(*KEY, "name", "path", "start_line", "end_line").join(texts.select("repo", "path", F.split("text", "\r?\n").alias("lines")), ["repo", "path"])
    n = F.col("end_line") - F.col("start_line") + 1
    spanned = (F.col("start_line") >= 1) & (F.col("end_line") >= F.col("start_line")) & (F.col("start_line") <= F.size("lines"))
    named = F.filter("lines", lambda x: x.contains(F.col("name")))
    own = F.array_join(F.slice("lines", F.greatest(F.col("start_line"), F.lit(1)), F.greatest(n, F.lit(1))), "\n")
    return rows.select(*KEY, F.when(spanned, own).when((F.col("name") != "") & (F.size(named) > 0), named[0]).alias("snippet")).where("snippet is not null")


def docs_for_symbols(edges: DataFrame, nodes: DataFrame, texts: DataFrame, limit: int = 20) -> DataFrame:
    """(repo, id, doc_repo, doc_id, line): what documents each node, and the first line there that mentions its name.

    Without a mention the first line that isn't blank stands for it.
    """
    links = edges.where("edge_type = 'documents'").select(F.col("dst_repo").alias("repo"), F.col("dst_id").alias("id"), F.col("src_repo").alias("doc_repo"), F.col("src_id").alias("doc_id")).distinct()
    links = links.join(nodes.select(*KEY, "name"), KEY)
    order = Window.partitionBy(*KEY).orderBy("doc_id", "doc_repo")
    links = links.withColumn("position", F.row_number().over(order)).where(F.col("position") <= limit)
    path = F.regexp_extract("doc_id", "^(?:doc|heading|file):([^#]*)", 1)
    body = texts.select(F.col("repo").alias("doc_repo"), F.col("path").alias("doc_path"), F.split("text", "\r?\n").alias("lines"))
    both = links.withColumn("doc_path", path).join(body, ["doc_repo", "doc_path"], "left")
    said = F.filter("lines", lambda x: (F.col("name") != "") & x.contains(F.col("name")))
    full = F.filter("lines", lambda x: F.trim(x) != "")
    line = F.when(F.size(said) > 0, said[0]).when(F.size(full) > 0, full[0])
    return both.select(*KEY, "doc_repo", "doc_id", line.alias("line"))


def with_members(nodes: DataFrame, seeds: DataFrame) -> DataFrame:
    """(seed_repo, seed_id, repo, id): each type seed with its methods, in extensions too if only one type has the name.

    Methods carry their receiver in the id (``method:PATH#RECEIVER.NAME``).
    """
    types = nodes.where("kind = 'type' and name <> ''")
    single = types.groupBy("repo", "name").agg(F.count("*").alias("n"))
    named = types.join(seeds.select(*KEY).distinct(), KEY, "left_semi").join(single, ["repo", "name"])
    methods = nodes.where("kind = 'method'").select("repo", F.col("id").alias("mid"), F.regexp_extract("id", r"#([^.(]+)\.", 1).alias("name"), F.regexp_extract("id", "^method:([^#]*)", 1).alias("mpath"))
    hit = named.withColumn("tpath", F.regexp_extract("id", "^type:([^#]*)", 1)).join(methods, ["repo", "name"]).where("n = 1 or tpath = mpath")
    own = seeds.select(F.col("repo").alias("seed_repo"), F.col("id").alias("seed_id"), *KEY)
    return own.unionByName(hit.select(F.col("repo").alias("seed_repo"), F.col("id").alias("seed_id"), "repo", F.col("mid").alias("id"))).distinct()


def symbol(nodes: DataFrame, edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(repo, id, kind, label, path, start_line, out_edges, in_edges) of each seed."""
    out = edges.groupBy(F.col("src_repo").alias("repo"), F.col("src_id").alias("id")).agg(F.count("*").alias("out_edges"))
    into = edges.groupBy(F.col("dst_repo").alias("repo"), F.col("dst_id").alias("id")).agg(F.count("*").alias("in_edges"))
    rows = nodes.join(seeds.select(*KEY).distinct(), KEY, "left_semi").withColumn("label", symbol_label(F.col("id"), F.col("kind"), F.col("name")))
    rows = rows.join(out, KEY, "left").join(into, KEY, "left")
    return rows.select(*KEY, "kind", "label", "path", "start_line", F.coalesce("out_edges", F.lit(0)).alias("out_edges"), F.coalesce("in_edges", F.lit(0)).alias("in_edges"))


def questions(hubs: DataFrame, cycles: DataFrame, gaps: DataFrame) -> DataFrame:
    """(kind, question): what the measures suggest to ask: about the largest hub, a cycle, and the loose ends."""
    hub = hubs.orderBy(F.desc("degree"), "id", "repo").limit(1).select(F.lit("hub").alias("kind"), F.format_string("Why do %d edges meet at %s?", F.col("degree"), F.col("id")).alias("question"))
    ring = cycles.groupBy("component").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "component").limit(1)
    ring = ring.select(F.lit("cycle").alias("kind"), F.format_string("Can the circle of %d around %s be opened?", F.col("n"), F.col("component")).alias("question"))
    loose = gaps.agg(F.count("*").alias("n")).where("n > 0").select(F.lit("gap").alias("kind"), F.format_string("Are %d nodes with at most one edge still used?", F.col("n")).alias("question"))
    return hub.unionByName(ring).unionByName(loose)


def index_stats(changes: DataFrame) -> DataFrame:
    """(repo, processed, skipped, deleted) of ``resolution.scan_changes``."""
    is_ = lambda *a: F.count_if(F.col("action").isin(*a))
    return changes.groupBy("repo").agg(is_("add", "replace").alias("processed"), is_("skip").alias("skipped"), is_("delete").alias("deleted"))


def line_owners(nodes: DataFrame, places: DataFrame) -> DataFrame:
    """(repo, path, line, id): the innermost function or method around each line; ``places`` (repo, path, line).

    The shortest span that holds the line wins, ties by id; a line outside all has no row.
    """
    code = nodes.where("kind in ('function', 'method') and path <> '' and start_line >= 1").select("repo", "path", "id", "start_line", "end_line")
    hit = places.select("repo", "path", "line").distinct().join(code, ["repo", "path"]).where("line between start_line and end_line")
    return hit.groupBy("repo", "path", "line").agg(F.min(F.struct((F.col("end_line") - F.col("start_line")).alias("size"), "id")).alias("b")).select("repo", "path", "line", "b.id")
