"""One object per graph with a method per question, for notebooks and the command line."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from graphloom.operators import analysis, contracts, graph, history, impact, lookup, ranking, tracing
from graphloom.plans.tables import table
from graphloom.sources import snapshot


class Graph:
    """The live graph of a data folder (tables nodes, edges, overlay_edges, commits, spans, documents).

    Symbols are named by URI, id or unique name; an ambiguous or unknown name has no rows.
    ``limit`` of None means all rows.
    """

    def __init__(self, spark: SparkSession, folder: str, repo: str | None = None):
        self.spark, self.folder, self.repo = spark, folder, repo

    def _table(self, name: str) -> DataFrame:
        return table(self.spark, self.folder, name)

    @cached_property
    def nodes(self) -> DataFrame:
        rows = graph.live_nodes(self._table("nodes"))
        return rows.where(F.col("repo") == self.repo) if self.repo else rows

    @cached_property
    def edges(self) -> DataFrame:
        if self.repo:
            return graph.live_edges(self._table("edges")).where((F.col("src_repo") == self.repo) & (F.col("dst_repo") == self.repo))
        return graph.federated_edges(self._table("edges"), self._table("overlay_edges"), self.nodes)

    def seed(self, *names: str) -> DataFrame:
        """(query, repo, id, tier) of the names that resolve."""
        return graph.resolve_seeds(self.nodes, self.spark.createDataFrame([(n,) for n in names], "query string"))

    def search_graph(self, query: str, limit: int = 20) -> DataFrame:
        return graph.search(self.nodes, query, limit)

    def get_symbol(self, *names: str) -> DataFrame:
        return lookup.symbol(self.nodes, self.edges, self.seed(*names))

    def find_references(self, *names: str) -> DataFrame:
        return graph.references_to(self.edges, self.nodes, self.spark.createDataFrame([(n,) for n in names], "name string"))

    def neighborhood(self, *names: str, depth: int = 2, max_nodes: int = 32, budget: int = 0, families: dict[str, float] | None = None) -> DataFrame:
        weights = ranking.family_weights(families) if families else None
        hits = ranking.neighborhood(self.edges, self.nodes, self.seed(*names), depth, max_nodes, weights)
        return ranking.pack_budget(hits, budget, "id", "name", "kind") if budget > 0 else hits

    def co_changes(self, *names: str, limit: int = 20) -> DataFrame:
        return history.top_partners(self.edges, self.seed(*names), limit)

    def hot_paths(self, limit: int = 20) -> DataFrame:
        return tracing.hot_paths(self.edges, limit)

    def docs_for_symbol(self, *names: str, limit: int = 20) -> DataFrame:
        texts = self._table("documents").where("path is not null and text is not null")
        return lookup.docs_for_symbols(self.edges, self.nodes.join(self.seed(*names), ["repo", "id"], "left_semi"), texts, limit)

    def _own(self, *names: str) -> DataFrame:
        seeds = lookup.with_members(self.nodes, self.seed(*names)).select("repo", "id")
        return impact.closure(self.edges, seeds)

    def affected(self, *names: str, depth: int = 1, limit: int | None = 100) -> DataFrame:
        return impact.by_file(impact.walk(self.edges, self._own(*names), depth), self.nodes, limit)

    def dependencies(self, *names: str, depth: int = 1, limit: int | None = 100) -> DataFrame:
        return impact.by_file(impact.walk(self.edges, self._own(*names), depth, reverse=False), self.nodes, limit)

    def shortest_path(self, start: str, goal: str, max_hops: int = 8) -> DataFrame:
        return impact.shortest_paths(self.edges, self.seed(start), self.seed(goal), max_hops)

    def resolve_api(self, *queries: str) -> DataFrame:
        """(query, repo, id, name) of operations by id, name, path or ``METHOD path``; ambiguous queries have none."""
        ops = self.nodes.where("kind = 'operation'").select("repo", "id", "name", "uri", F.regexp_extract("id", "^operation:(.*)$", 1).alias("full"))
        q = self.spark.createDataFrame([(x,) for x in queries], "query string")
        keys = F.array("id", "name", "uri", "full", F.regexp_extract("full", " (.*)$", 1), F.regexp_extract("full", "^([A-Z]+) ", 1))
        hits = ops.select("repo", "id", "name", F.explode(F.array_distinct(keys)).alias("query")).join(q.distinct(), "query")
        return graph.unique_or_drop(hits, ["query"], F.lit(0))

    def list_providers(self) -> DataFrame:
        return impact.providers(self.edges, self.nodes, "implements")

    def list_consumers(self) -> DataFrame:
        return impact.providers(self.edges, self.nodes, "consumes")

    def services(self) -> DataFrame:
        return contracts.service_calls(graph.resolve_overlay(self._table("overlay_edges"), graph.live_nodes(self._table("nodes"))))

    def report(self, limit: int = 10) -> dict[str, DataFrame]:
        """The sections of a report."""
        view = analysis.dependency_view(self.edges, self.nodes)
        hubs = analysis.hubs(self.edges, self.nodes, None, ("function", "method", "type", "file", "module"))
        top = lambda df, by: df.orderBy(F.desc(by), *[c for c in df.columns if c != by]).limit(limit)
        labels = analysis.communities(view)
        rings, gaps = analysis.strong_components(view), analysis.knowledge_gaps(self.edges, self.nodes)
        pairs = self.edges.where("edge_type = 'co_committed'").select("src_repo", "src_id", "dst_repo", "dst_id", "weight", "support")
        return {
            "Coverage": analysis.coverage(self.edges).orderBy("repo"),
            "Languages": top(analysis.language_mix(self.nodes), "files"),
            "Hubs": top(hubs, "degree"),
            "Important symbols": top(analysis.hubs(self.edges, self.nodes, analysis.SYMBOLIC, analysis.DEFINITIONS), "degree"),
            "Important files": top(analysis.important_files(self.edges, self.nodes), "score"),
            "Top imports": top(analysis.top_imports(self.edges), "files"),
            "Central nodes": top(analysis.pagerank(view), "rank"),
            "Communities": top(analysis.cohesion(view, labels).join(analysis.numbered_communities(labels).drop("members"), "label"), "members"),
            "Cycles": analysis.cycle_list(analysis.file_cycles(view, rings)).orderBy("position").limit(limit),
            "Indirect traces": analysis.indirect_traces(self.edges).orderBy(F.desc("hops"), "repo", "source", "target_repo", "target").limit(limit),
            "Co-changes": top(pairs, "weight"),
            "Hot paths": tracing.hot_paths(self.edges, limit),
            "Services": self.services().orderBy(F.desc("calls"), "from_repo", "to_repo").limit(limit),
            "Knowledge gaps": gaps.orderBy("degree", "repo", "id").limit(limit),
            "Questions": lookup.questions(hubs, rings, gaps),
        }

    def export(self, path: str, repo: str) -> None:
        snapshot.export_snapshot(self._table("nodes").where("deleted_at is null").dropDuplicates(["repo", "id"]), self._table("edges").dropDuplicates(["edge_id"]), path, repo)
