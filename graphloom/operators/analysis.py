"""Whole-graph metrics over live nodes and edges, federated by (repo, id).

The iterative ones (ranks, communities, strong components, betweenness) number the nodes in
the order of their names and work on links of integers. A graph of at most ``LOCAL_LINKS``
links, some 16 MB, is solved by array operations in one task (betweenness: by all tasks, each
with the graph and its share of the sources), since a round of joins costs more there than
the whole solution; larger graphs are solved by rounds of joins, with the same result. Strong
components trim and colour a larger graph only until the rest is that small.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, functions as F

from graphloom.functions.paths import id_path, language
from graphloom.operators.impact import shortest_paths
from graphloom.operators.resolution import fold_dots, resolve_imports
from graphloom.operators.skew import fragment_join, plan_fragments
from graphloom.plans.iterate import discard, row_numbers, written
from graphloom.plans.ship import ship

LOCAL_LINKS = 1_000_000
KEY = ["repo", "id"]
SYMBOLIC = ("calls", "implements", "consumes", "inherits", "references")
DEFINITIONS = ("function", "method", "type", "operation")


def ends(edges: DataFrame) -> DataFrame:
    """Each edge once per end: (repo, id, edge_type)."""
    both = F.array(F.struct(F.col("src_repo").alias("repo"), F.col("src_id").alias("id")), F.struct(F.col("dst_repo").alias("repo"), F.col("dst_id").alias("id")))
    return edges.select("edge_type", F.inline(both))


def hubs(edges: DataFrame, nodes: DataFrame, types: tuple[str, ...] | None = None, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """(repo, id, kind, name, degree): undirected degree over edges of some types."""
    rows = ends(edges if types is None else edges.where(F.col("edge_type").isin(*types))).groupBy(*KEY).agg(F.count("*").alias("degree"))
    found = rows.join(nodes.select(*KEY, "kind", "name"), KEY)
    return found if kinds is None else found.where(F.col("kind").isin(*kinds))


def important_files(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(repo, path, score): imports and calls rolled up to files; the far side only if it is another file's definition."""
    rows = edges.where("edge_type in ('imports', 'calls')").withColumn("from_path", id_path(F.col("src_id"))).withColumn("to_path", id_path(F.col("dst_id")))
    sources = rows.where("from_path is not null").select(F.col("src_repo").alias("repo"), F.col("from_path").alias("path"))
    defined = ~F.col("dst_id").rlike("^(symbol|import):")
    other = (F.col("to_path") != F.coalesce(F.col("from_path"), F.lit(""))) | (F.col("src_repo") != F.col("dst_repo"))
    targets = rows.where(F.col("to_path").isNotNull() & defined & other).select(F.col("dst_repo").alias("repo"), F.col("to_path").alias("path"))
    return sources.unionByName(targets).groupBy("repo", "path").agg(F.count("*").alias("score"))


def import_target(path: Column, spec: Column) -> Column:
    """What an import of the file ``path`` counts for: relative specs as paths, packages without the part inside them in JavaScript and TypeScript."""
    bare = F.regexp_replace(F.trim(spec), "^[\"']+|[\"']+$", "")
    web = language(path).isin("javascript", "typescript")
    package = F.regexp_extract(bare, "^(@[^/]*/[^/]*|[^@/][^/]*)", 1)
    return F.when(bare.startswith("."), F.coalesce(fold_dots(F.concat(F.regexp_replace(path, "[^/]*$", ""), bare)), bare)).when(web & ~bare.startswith("/") & (package != ""), package).otherwise(bare)


def top_imports(edges: DataFrame) -> DataFrame:
    """(spec, files): distinct importing files of each import target (the part after ``#``, by language; else the module's path)."""
    rows = edges.where("edge_type = 'imports'").withColumn("p", id_path(F.col("src_id")))
    spec = F.when(F.col("dst_id").startswith("import:"), import_target(F.col("p"), F.regexp_extract("dst_id", "#(.*)$", 1))).otherwise(id_path(F.col("dst_id")))
    rows = rows.select(spec.alias("spec"), F.struct("src_repo", "p").alias("f")).where("spec <> '' and f.p is not null")
    return rows.groupBy("spec").agg(F.countDistinct("f").alias("files"))


def language_mix(nodes: DataFrame) -> DataFrame:
    return nodes.where("kind = 'file'").groupBy("repo", language(F.regexp_extract("id", "^file:(.*)$", 1)).alias("language")).agg(F.count("*").alias("files"))


def coverage(edges: DataFrame) -> DataFrame:
    """Per repository: import and call edges, and how many lead to a real node."""
    made = lambda t: (F.col("edge_type") == t)
    real = ~F.col("dst_id").rlike("^(symbol|import):")
    return edges.groupBy(F.col("src_repo").alias("repo")).agg(
        F.count_if(made("imports")).alias("imports"), F.count_if(made("imports") & real).alias("imports_resolved"), F.count_if(made("calls")).alias("calls"), F.count_if(made("calls") & real).alias("calls_resolved")
    )


def knowledge_gaps(edges: DataFrame, nodes: DataFrame, most: int = 1) -> DataFrame:
    """(repo, id, degree): nodes but symbols with degree at most ``most``, contains not counted."""
    degree = ends(edges.where("edge_type <> 'contains'")).groupBy(*KEY).agg(F.count("*").alias("degree"))
    out = nodes.where("kind <> 'symbol'").select(*KEY).join(degree, KEY, "left")
    return out.select(*KEY, F.coalesce("degree", F.lit(0)).alias("degree")).where(F.col("degree") <= most)


def relative_imports(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Import edges to placeholders of relative specs, as edges to the files these stand for."""
    rows = edges.where("edge_type = 'imports'").where(F.col("dst_id").startswith("import:"))
    specs = rows.select(F.col("src_repo").alias("repo"), id_path(F.col("src_id")).alias("path"), F.regexp_extract("dst_id", "#(.*)$", 1).alias("spec"))
    files = nodes.where("kind in ('file', 'module')").select("repo", F.regexp_extract("id", "^(?:file|module):(.*)$", 1).alias("path")).where("path <> ''")
    file = lambda p: F.concat(F.lit("file:"), p)
    hit = resolve_imports(specs, files)
    return hit.select(F.col("repo").alias("a_repo"), file(F.col("path")).alias("a"), F.col("repo").alias("b_repo"), file(F.col("target")).alias("b"), F.lit("imports").alias("edge_type"))


def dependency_view(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a_repo, a, b_repo, b, edge_type): resolved calls between definitions and between files, and file imports, relative ones resolved.

    Files appear by path as ``file:PATH``; self edges are left out; distinct.
    """
    src, dst = id_path(F.col("src_id")), id_path(F.col("dst_id"))
    rows = edges.where("edge_type in ('calls', 'imports')").where(~F.col("dst_id").rlike("^(symbol|import):"))
    files = rows.where(src.isNotNull() & dst.isNotNull()).select(F.col("src_repo").alias("a_repo"), F.concat(F.lit("file:"), src).alias("a"), F.col("dst_repo").alias("b_repo"), F.concat(F.lit("file:"), dst).alias("b"), "edge_type")
    calls = rows.where("edge_type = 'calls'").select(F.col("src_repo").alias("a_repo"), F.col("src_id").alias("a"), F.col("dst_repo").alias("b_repo"), F.col("dst_id").alias("b"), "edge_type")
    return files.unionByName(calls).unionByName(relative_imports(edges, nodes)).where("a_repo <> b_repo or a <> b").distinct()


def view_paths(view: DataFrame, seeds: DataFrame, targets: DataFrame) -> DataFrame:
    """(seed_repo, seed_id, repo, id, hops, path): ``shortest_paths`` over the dependency view, however long."""
    edges = view.select(F.col("a_repo").alias("src_repo"), F.col("a").alias("src_id"), "edge_type", F.col("b_repo").alias("dst_repo"), F.col("b").alias("dst_id"))
    return shortest_paths(edges, seeds, targets, max_hops=None)


def numbered(view: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(i, k): the nodes as ``repo|id`` with numbers in the order of their names; and (u, v), the links of numbers."""
    pairs = view.select(F.concat_ws("|", "a_repo", "a").alias("ku"), F.concat_ws("|", "b_repo", "b").alias("kv"))
    names = pairs.select(F.col("ku").alias("k")).union(pairs.select("kv")).distinct().orderBy("k")
    names = written(names.select(F.monotonically_increasing_id().alias("i"), "k"))
    links = pairs.join(names.select(F.col("k").alias("ku"), F.col("i").alias("u")), "ku").join(names.select(F.col("k").alias("kv"), F.col("i").alias("v")), "kv")
    return names, written(links.select("u", "v"))


def in_one_task(links: DataFrame, solve: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, ...]], schema: str) -> DataFrame:
    """``solve(u, v)`` of all links at once; it gives the columns of ``schema``."""
    ship(links.sparkSession)
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if held and (rows := pa.Table.from_batches(held)).num_rows:
            yield from pa.table(dict(zip(names, solve(*(rows.column(c).to_numpy() for c in ("u", "v"))), strict=True))).to_batches(max_chunksize=50_000)

    return links.select("u", "v").repartition(1).mapInArrow(run, schema)


def dense(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The numbers that occur, and both ends as positions in them."""
    ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    return ids, at[: len(u)], at[len(u) :]


def fan(u: np.ndarray, v: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and targets of each position's links."""
    order = np.argsort(u, kind="stable")
    return np.searchsorted(u[order], np.arange(n + 1)), v[order]


def rank_locally(u: np.ndarray, v: np.ndarray, damping: float, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    ids, u, v = dense(u, v)
    n, out = len(ids), np.bincount(u, minlength=len(ids))
    rank, loose = np.full(n, 1.0 / n), out == 0
    share = 1.0 / np.maximum(out, 1)
    for _ in range(rounds):
        rank = (1 - damping) / n + damping * rank[loose].sum() / n + damping * np.bincount(v, weights=(rank * share)[u], minlength=n)
    return ids, rank


def pagerank(view: DataFrame, damping: float = 0.85, rounds: int = 20) -> DataFrame:
    """(repo, id, rank) over the view's nodes; parallel edges count, dangling mass is spread evenly. Fixed rounds.

    By joins: links stay rows with their source's share (no list of targets is built); a hub's
    links are split over tasks by a plan made once, and sums combine on the map side.
    """
    names, links = numbered(view)
    if links.count() <= LOCAL_LINKS:
        ranks = in_one_task(links, lambda u, v: rank_locally(u, v, damping, rounds), "i long, rank double")
    else:
        ranks = rank_by_joins(names, links, damping, rounds)
    return ranks.join(names, "i").select(F.split("k", r"\|", 2)[0].alias("repo"), F.split("k", r"\|", 2)[1].alias("id"), "rank")


def rank_by_joins(names: DataFrame, links: DataFrame, damping: float, rounds: int) -> DataFrame:
    out = links.groupBy("u").agg(F.count("*").alias("out"))
    plan = plan_fragments(out, "u", weight="out")
    links = written(fragment_join(links, out, "u", F.col("v"), plan).select(F.col("u").alias("i"), "v", (F.lit(1.0) / F.col("out")).alias("share")))
    nodes = written(names.select("i").join(out.withColumnRenamed("u", "i"), "i", "left").select("i", F.col("out").isNull().alias("loose")))
    n, loose = nodes.agg(F.count("*"), F.count_if("loose")).first()
    ranks, loose = written(nodes.withColumn("rank", F.lit(1.0 / n))), loose / n
    for _ in range(rounds):
        # the next round's dangling mass is observed while this round is written
        mass = Observation()
        sent = fragment_join(links, ranks.select("i", "rank"), "i", F.col("v"), plan).select(F.col("v").alias("i"), (F.col("rank") * F.col("share")).alias("got"), F.lit(False).alias("loose"))
        step = sent.unionByName(nodes.select("i", F.lit(0.0).alias("got"), "loose")).groupBy("i").agg(F.max("loose").alias("loose"), F.sum("got").alias("got"))
        step = step.select("i", "loose", (F.lit((1 - damping) / n + damping * loose / n) + damping * F.col("got")).alias("rank"))
        ranks, old = written(step.observe(mass, F.sum(F.when(F.col("loose"), F.col("rank"))).alias("loose"))), ranks
        discard(old)
        loose = mass.get["loose"] or 0.0
    return ranks.select("i", "rank")


def label_locally(u: np.ndarray, v: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    ids, u, v = dense(u, v)
    u, v = np.unique(np.stack([np.concatenate([u, v]), np.concatenate([v, u])]), axis=1)
    n = len(ids)
    label = np.arange(n)
    for _ in range(rounds):
        votes, count = np.unique(u * n + label[v], return_counts=True)
        node, said = votes // n, votes % n
        own = (said == label[node]).astype(np.int64)
        best = np.lexsort((said, -own, -count, node))
        first = best[np.append(True, node[best][1:] != node[best][:-1])]
        new = label.copy()
        new[node[first]] = said[first]
        if (new == label).all():
            break
        label = new
    return ids, ids[label]


def communities(edges: DataFrame, rounds: int = 15) -> DataFrame:
    """(repo, id, label): synchronous label propagation on the undirected view.

    A node takes the most frequent label around it, the smallest on ties, but keeps its own
    if that is among the most frequent. Labels are ids of members.
    """
    names, links = numbered(edges)
    if links.count() <= LOCAL_LINKS:
        labels = in_one_task(links, lambda u, v: label_locally(u, v, rounds), "i long, label long")
    else:
        labels = label_by_joins(links, rounds)
    out = labels.join(names, "i").join(names.select(F.col("i").alias("label"), F.col("k").alias("name")), "label")
    return out.select(F.split("k", r"\|", 2)[0].alias("repo"), F.split("k", r"\|", 2)[1].alias("id"), F.col("name").alias("label"))


def label_by_joins(links: DataFrame, rounds: int) -> DataFrame:
    both = written(links.union(links.select("v", "u")).distinct())
    plan = plan_fragments(both, "v")  # a hub's votes are cast in many tasks
    labels = written(both.select("u").distinct().select(F.col("u").alias("i"), F.col("u").alias("label"), F.col("u").alias("was")))
    for _ in range(rounds):
        votes = fragment_join(both, labels.select(F.col("i").alias("v"), "label"), "v", F.col("u"), plan).groupBy("u", "label").agg(F.count("*").alias("n"))
        own = labels.select(F.col("i").alias("u"), F.col("label").alias("own"))
        best = votes.join(own, "u").groupBy("u").agg(F.max(F.struct("n", (F.col("label") == F.col("own")).alias("keep"), (-F.col("label")).alias("m"))).alias("b"), F.max("own").alias("was"))
        labels, old = written(best.select(F.col("u").alias("i"), (-F.col("b.m")).alias("label"), "was")), labels
        discard(old)
        if labels.where("label <> was").isEmpty():
            break
    return labels.select("i", "label")


def numbered_communities(labels: DataFrame) -> DataFrame:
    """(label, number, members): communities numbered from 0 by size, the largest first, ties by label."""
    sizes = labels.groupBy("label").agg(F.count("*").alias("members"))
    return row_numbers(sizes, "number", F.desc("members"), F.col("label"), start=0).select("label", "number", "members")


def small_communities(labels: DataFrame, below: int = 3) -> DataFrame:
    """(label, members) of communities with fewer than ``below`` members."""
    return labels.groupBy("label").agg(F.count("*").alias("members")).where(F.col("members") < below)


def cycle_list(components: DataFrame) -> DataFrame:
    """(component, length, files_only, position): cycles of files and modules only come first, then long ones, then by name."""
    each = components.groupBy("component").agg(F.count("*").alias("length"), F.min(F.col("u").rlike(r"\|(file|module):")).alias("files_only"))
    return row_numbers(each, "position", F.desc("files_only"), F.desc("length"), F.col("component"))


def cohesion(view: DataFrame, labels: DataFrame) -> DataFrame:
    """(label, members, cohesion, name): connected member pairs over possible ones; named by the best-linked member."""
    key = lambda r, i: F.concat_ws("|", r, i)
    of = labels.select(key("repo", "id").alias("k"), "label")
    pairs = view.select(F.least(key("a_repo", "a"), key("b_repo", "b")).alias("u"), F.greatest(key("a_repo", "a"), key("b_repo", "b")).alias("v")).distinct()
    inside = pairs.join(of.toDF("u", "lu"), "u").join(of.toDF("v", "lv"), "v").where("lu = lv")
    linked = inside.groupBy(F.col("lu").alias("label")).agg(F.count("*").alias("pairs"))
    degree = pairs.select(F.explode(F.array("u", "v")).alias("k")).groupBy("k").agg(F.count("*").alias("d"))
    best = of.join(degree, "k", "left").withColumn("score", F.coalesce("d", F.lit(0)) + F.when(F.col("k").rlike(r"\|(file|module):"), 100).otherwise(0))
    sizes = best.groupBy("label").agg(F.count("*").alias("members"), F.min(F.struct((-F.col("score")).alias("s"), "k")).alias("b"))
    n = F.col("members")
    return sizes.join(linked, "label", "left").select("label", "members", F.when(n <= 1, 1.0).otherwise(F.coalesce("pairs", F.lit(0)) / (n * (n - 1) / 2)).alias("cohesion"), F.col("b.k").alias("name"))


def components_locally(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least member) of the strong components of two and more nodes, by a depth-first walk."""
    ids, u, v = dense(u, v)
    n = len(ids)
    at, to = (x.tolist() for x in fan(u, v, n))
    seen, low, of, stack, count = [-1] * n, [0] * n, [-1] * n, [], 0
    for start in range(n):
        if seen[start] >= 0:
            continue
        seen[start] = low[start] = count
        count += 1
        stack.append(start)
        path = [(start, at[start])]
        while path:
            x, k = path[-1]
            if k < at[x + 1]:
                path[-1] = (x, k + 1)
                y = to[k]
                if seen[y] < 0:
                    seen[y] = low[y] = count
                    count += 1
                    stack.append(y)
                    path.append((y, at[y]))
                elif of[y] < 0:
                    low[x] = min(low[x], seen[y])
                continue
            path.pop()
            if path:
                low[path[-1][0]] = min(low[path[-1][0]], low[x])
            if low[x] == seen[x]:
                part = []
                while not part or part[-1] != x:
                    part.append(stack.pop())
                least = min(part)
                for y in part:
                    of[y] = least if len(part) > 1 else n  # n: on its own
    found = np.array(of, np.int64)
    inside = np.flatnonzero(found < n)
    return ids[inside], ids[found[inside]]


def strong_components(view: DataFrame, local_links: int = LOCAL_LINKS) -> DataFrame:
    """(u, component): strongly connected components of two and more nodes, named by their least member.

    While more than ``local_links`` links are left: trimming removes nodes without an edge in
    or out; then the least number that reaches each node is spread along the edges, and the
    nodes that reach their namesake back form its component. No reachability table is made.
    """
    names, links = numbered(view)
    links, old = written(links.where("u <> v").distinct()), links
    discard(old)
    found = None
    while (left := links.count()) > local_links:
        trimmed = links.join(links.select(F.col("v").alias("u")).distinct(), "u", "left_semi").join(links.select(F.col("u").alias("v")).distinct(), "v", "left_semi")
        links, old = written(trimmed.select("u", "v")), links
        discard(old)
        if links.count() < left:
            continue
        color = written(links.select("u").distinct().select("u", F.col("u").alias("c"), F.col("u").alias("was")))
        while True:  # the least number that reaches each node
            pulled = links.join(color.select("u", "c"), "u").groupBy(F.col("v").alias("u")).agg(F.min("c").alias("p"))
            color, old = written(color.join(pulled, "u", "left").select("u", F.least("c", F.coalesce("p", "c")).alias("c"), F.col("c").alias("was"))), color
            discard(old)
            if color.where("c <> was").isEmpty():
                break
        # nodes of a color that reach its root
        inside = written(links.join(color.select("u", "c"), "u").join(color.select(F.col("u").alias("v"), F.col("c").alias("d")), "v").where("c = d").select("u", "v", "c"))
        reach = frontier = written(color.where("u = c").select("u", "c"))
        while True:
            frontier = written(inside.join(frontier.select(F.col("u").alias("v"), F.col("c").alias("fc")), "v").where("c = fc").select("u", "c").distinct().join(reach, ["u", "c"], "left_anti"))
            if frontier.isEmpty():
                break
            reach = written(reach.unionByName(frontier))
        found = reach if found is None else found.unionByName(reach)
        links = written(links.join(reach.select("u"), "u", "left_anti").join(reach.select(F.col("u").alias("v")), "v", "left_anti").select("u", "v"))
    parts = in_one_task(links, components_locally, "u long, c long")
    if found is not None:
        sizes = found.groupBy("c").count().where("count > 1").drop("count")
        parts = parts.unionByName(found.join(sizes, "c", "left_semi").select("u", "c"))
    out = parts.join(names.select(F.col("i").alias("u"), F.col("k").alias("name")), "u").join(names.select(F.col("i").alias("c"), "k"), "c")
    return out.select(F.col("name").alias("u"), F.col("k").alias("component"))


def file_cycles(view: DataFrame, components: DataFrame) -> DataFrame:
    """``components`` (u, component), where a circle still runs through a component's files and modules reduced to those."""
    files = components.where(F.col("u").rlike(r"\|(file|module):"))
    ends = view.select(F.concat_ws("|", "a_repo", "a").alias("u"), F.concat_ws("|", "b_repo", "b").alias("v"), "a_repo", "a", "b_repo", "b", "edge_type")
    inner = ends.join(files, "u").join(files.select(F.col("u").alias("v"), F.col("component").alias("other")), "v").where("component = other")
    rings = strong_components(inner.select("a_repo", "a", "b_repo", "b", "edge_type")).select("u").join(files, "u").select("component").distinct()
    return components.join(rings, "component", "left_anti").select("u", "component").unionByName(files.join(rings, "component", "left_semi").select("u", "component"))


def indirect_traces(edges: DataFrame, hops: int = 4) -> DataFrame:
    """(repo, source, target_repo, target, hops, path): definitions two to ``hops`` calls away in another file, first reach counts.

    ``path`` has the ids from source to target, of the shortest walks the least.
    """
    calls = edges.where("edge_type = 'calls'").where(~F.col("dst_id").startswith("symbol:")).select("src_repo", "src_id", "dst_repo", "dst_id").distinct()
    key = ["repo", "source", "target_repo", "target"]
    level = calls.select(F.col("src_repo").alias("repo"), F.col("src_id").alias("source"), F.col("dst_repo").alias("target_repo"), F.col("dst_id").alias("target"), F.array("src_id", "dst_id").alias("path")).where("repo <> target_repo or source <> target")
    seen, out = level.select(*key), None
    for d in range(2, hops + 1):
        step = level.join(calls, (F.col("target_repo") == F.col("src_repo")) & (F.col("target") == F.col("src_id")))
        step = step.select("repo", "source", F.col("dst_repo").alias("target_repo"), F.col("dst_id").alias("target"), F.concat("path", F.array("dst_id")).alias("path")).where("repo <> target_repo or source <> target")
        level = written(step.groupBy(*key).agg(F.min("path").alias("path")).join(seen, key, "left_anti"))
        seen = seen.unionByName(level.select(*key))
        part = level.select(*key, F.lit(d).alias("hops"), "path")
        out = part if out is None else out.unionByName(part)
    return out.where((F.col("repo") != F.col("target_repo")) | (F.coalesce(id_path(F.col("source")), F.lit("")) != F.coalesce(id_path(F.col("target")), F.lit(""))))


def between_locally(sources: list[int], at: list[int], to: list[int], n: int) -> np.ndarray:
    """What the shortest paths from the sources (positions) add to each position."""
    score = np.zeros(n)
    for s in sources:
        if at[s] == at[s + 1]:
            continue
        far, paths, order, k = {s: 0}, {s: 1.0}, [s], 0
        while k < len(order):
            x = order[k]
            k += 1
            d, p = far[x] + 1, paths[x]
            for y in to[at[x] : at[x + 1]]:
                if y not in far:
                    far[y], paths[y] = d, p
                    order.append(y)
                elif far[y] == d:
                    paths[y] += p
        gain = dict.fromkeys(order, 0.0)
        for x in reversed(order):
            d, p, g = far[x] + 1, paths[x], 0.0
            for y in to[at[x] : at[x + 1]]:
                if far[y] == d:
                    g += p / paths[y] * (1 + gain[y])
            gain[x] = g
            if x != s and g:
                score[x] += g
    return score


def betweenness(view: DataFrame, max_levels: int | None = None, block: int | None = None, local_links: int = LOCAL_LINKS) -> DataFrame:
    """(u, score): directed, unnormalised betweenness with parallel edges as separate paths.

    Up to ``local_links`` links each task has the graph (a broadcast of that bound) and a share
    of the sources, and only sums leave it. Beyond, or with ``max_levels``: breadth-first levels of
    many sources at once by joins, with path counts, then dependencies pushed back level by
    level; state is one row per reachable (source, node), of about ``block`` sources at a time.
    The work grows with sources times what they reach, either way.
    """
    names, links = numbered(view)
    links, old = written(links.where("u <> v")), links
    discard(old)
    spark = view.sparkSession
    if max_levels is None and links.count() <= local_links:
        ship(spark)
        rows = links.toArrow()
        ids, u, v = dense(rows.column("u").to_numpy(), rows.column("v").to_numpy())
        held = spark.sparkContext.broadcast((ids, *fan(u, v, len(ids))))  # at most local_links links

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, at, to = held.value
            mine = [x for b in batches for x in b.column(0).to_pylist()]
            if mine:
                total = between_locally(mine, at.tolist(), to.tolist(), len(ids))
                hit = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(ids[hit]), pa.array(total[hit])], names=["i", "score"])

        ends = spark.range(0, len(ids)).repartition(4 * spark.sparkContext.defaultParallelism)
        got = ends.mapInArrow(run, "i long, score double").unionByName(names.select("i", F.lit(0.0).alias("score")))
        linked = links.select(F.col("u").alias("i")).union(links.select("v")).distinct()
        return got.groupBy("i").agg(F.sum("score").alias("score")).join(linked, "i", "left_semi").join(names, "i").select(F.col("k").alias("u"), "score")
    sources = links.select("u").distinct()
    blocks = 1 if block is None else max(1, -(-sources.count() // block))
    scores = links.select("u").union(links.select("v")).distinct().withColumn("score", F.lit(0.0))
    for k in range(blocks):
        part = _dependencies(links, sources.where(F.pmod(F.xxhash64("u"), F.lit(blocks)) == k), max_levels)
        scores = written(scores.unionByName(part).groupBy("u").agg(F.sum("score").alias("score")))
    return scores.join(names.withColumnRenamed("i", "u"), "u").select(F.col("k").alias("u"), "score")


def _dependencies(links: DataFrame, sources: DataFrame, max_levels: int | None) -> DataFrame:
    """(u, score): what the shortest paths from the sources (u) over links (u, v) add, a row per level."""
    level = written(sources.select(F.col("u").alias("s"), "u", F.lit(1.0).alias("paths")))
    seen, levels = level.select("s", "u"), [level]
    while max_levels is None or len(levels) <= max_levels:
        step = levels[-1].join(links, "u").groupBy("s", F.col("v").alias("u")).agg(F.sum("paths").alias("paths"))
        level = written(step.join(seen, ["s", "u"], "left_anti"))
        if level.isEmpty():
            break
        seen = seen.unionByName(level.select("s", "u"))
        levels.append(level)
    total, below = None, None
    for level in reversed(levels):
        here = level.withColumn("delta", F.lit(0.0))
        if below is not None:
            back = below.select("s", F.col("u").alias("v"), ((1 + F.col("delta")) / F.col("paths")).alias("share"))
            gained = level.join(links, "u").join(back, ["s", "v"]).groupBy("s", "u").agg(F.sum(F.col("paths") * F.col("share")).alias("delta"))
            here = level.join(gained, ["s", "u"], "left").select("s", "u", "paths", F.coalesce("delta", F.lit(0.0)).alias("delta"))
        below = here = written(here)
        part = here.where("s <> u").groupBy("u").agg(F.sum("delta").alias("score"))
        total = part if total is None else total.unionByName(part)
    return total
