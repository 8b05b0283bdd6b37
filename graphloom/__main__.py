"""Command line.

``python -m graphloom FOLDER QUESTION [NAME...] [--depth N] [--limit N] [--repo R] [--json]`` asks a
folder of tables; ``python -m graphloom FOLDER index TREE --repo R`` brings the stored graph in FOLDER
up to date with a source tree; ``ingest TRACES`` adds observed calls of a folder of trace files
(JSON, one document a file); ``export PATH --repo R`` and ``import PATH`` write and read snapshots.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession, functions as F

from graphloom import __version__, pipeline
from graphloom.api import Graph
from graphloom.operators.graph import EDGE
from graphloom.plans.iterate import written
from graphloom.sources import documents, report, snapshot, store

QUESTIONS = {
    "search": "search_graph", "symbol": "get_symbol", "references": "find_references", "neighborhood": "neighborhood", "co-changes": "co_changes", "hot-paths": "hot_paths", "docs": "docs_for_symbol", "affected": "affected",
    "dependencies": "dependencies", "path": "shortest_path", "services": "services", "api": "resolve_api", "providers": "list_providers", "consumers": "list_consumers",
}
DEPTHS, LIMITS = ("neighborhood", "affected", "dependencies"), ("search", "co-changes", "hot-paths", "docs", "affected", "dependencies")


def ask(g: Graph, question: str, names: list[str], depth: int | None = None, limit: int | None = None) -> DataFrame:
    options = {k: v for k, v, ok in (("depth", depth, question in DEPTHS), ("limit", limit, question in LIMITS)) if ok and v is not None}
    return getattr(g, QUESTIONS[question])(*names, **options)


def work(spark: SparkSession, folder: str, what: str, path: str, repo: str | None) -> str:
    """The commands that change or move a stored graph."""
    none = F.lit(None)
    if what == "index":
        done = pipeline.index(spark, path, folder, repo or path.rstrip("/").rpartition("/")[2])
        return ", ".join(f"{k} {v}" for k, v in sorted(done.items())) or "nothing there"
    if what == "ingest":
        texts = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias("text"))
        spans = documents.parse_spans(texts).withColumnRenamed("doc_id", "trace_file").withColumns({"service": F.coalesce("service", F.lit(repo)), "started_at": none.cast("timestamp_ntz"), "received_at": none.cast("timestamp_ntz")})
        return f"{pipeline.ingest_traces(spark, folder, written(spans))} observed calls"
    if what == "export":
        nodes, edges = store.read_graph(spark, folder)
        props = lambda *c: F.create_map(*[x for k in c for x in (F.lit(k), F.col(k).cast("string"))])
        nodes = nodes.withColumn("props", props("start_line", "end_line", "sha256")).withColumn("props", F.map_concat("props", F.create_map(F.lit("repo_uri"), F.col("uri"))))
        snapshot.export_snapshot(nodes, edges.withColumn("props", props("support", "calls")), path, repo)
        return path
    nodes, edges = snapshot.import_snapshot(spark, path, repo)
    at = lambda name, kind: F.col("props")[name].cast(kind).alias(name)
    nodes = nodes.select("repo", "id", "kind", "name", "path", at("start_line", "int"), at("end_line", "int"), F.col("props")["repo_uri"].alias("uri"), at("sha256", "string"))
    edges = edges.select(*EDGE, none.cast("double").alias("weight"), at("support", "int"), at("calls", "int"))
    return f"version {store.write_graph(nodes, edges, folder)}"


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="graphloom", description=__doc__)
    p.add_argument("--version", action="version", version=__version__)
    p.add_argument("folder")
    p.add_argument("question", choices=[*QUESTIONS, "report", "index", "ingest", "export", "import"])
    p.add_argument("names", nargs="*")
    p.add_argument("--depth", type=int)
    p.add_argument("--limit", type=int)
    p.add_argument("--repo")
    p.add_argument("--json", action="store_true")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("graphloom").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if a.question in ("index", "ingest", "export", "import"):
        print(work(spark, a.folder, a.question, a.names[0], a.repo))
        return
    g = Graph(spark, a.folder, a.repo)
    if a.question == "report":
        data, run = report.collect_sections(g.report(a.limit or 10)), report.run_id()
        print(report.as_json(data, run) if a.json else report.as_markdown(data, f"Report {run}"))
        return
    rows = ask(g, a.question, a.names, a.depth, a.limit)
    if a.json:
        for line in rows.toJSON().toLocalIterator():
            print(line)
    else:
        rows.show(a.limit or 100, truncate=False)


if __name__ == "__main__":
    main()
