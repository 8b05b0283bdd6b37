"""Impact and dependency walks, grouped by file, and shortest dependency paths.

Walks go level by level from all seeds at once; a node belongs to the level that first
reaches it. If several edges reach it there, the strongest edge type labels it, then the
smallest source. The contains family expands what a seed stands for: a type stands for
its members, a file or module for everything in it, a function for functions inside it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from graphloom.operators.lookup import with_members
from graphloom.plans.iterate import written

#: Edge types that carry impact, strongest first.
DEPENDENCY = ("inherits", "implements", "consumes", "calls", "observed_calls", "references", "imports")
KEY = ["repo", "id"]


def strength(edge_type: Column) -> Column:
    out = None
    for i, t in enumerate(DEPENDENCY):
        out = (F.when if out is None else out.when)(edge_type == t, i)
    return out


def closure(edges: DataFrame, seeds: DataFrame, edge_type: str = "contains", up: bool = False, max_levels: int | None = None) -> DataFrame:
    """(repo, id): the seeds and all that edges of one type lead to, downward or ``up``.

    Ends when a level adds nothing, so circles are safe.
    """
    near, far = ("dst", "src") if up else ("src", "dst")
    step = edges.where(F.col("edge_type") == edge_type).select(F.col(f"{near}_repo").alias("repo"), F.col(f"{near}_id").alias("id"), F.col(f"{far}_repo").alias("r2"), F.col(f"{far}_id").alias("i2")).distinct()
    reached = frontier = written(seeds.select(*KEY).distinct())
    level = 0
    while max_levels is None or level < max_levels:
        level += 1
        frontier = written(frontier.join(step, KEY).select(F.col("r2").alias("repo"), F.col("i2").alias("id")).distinct().join(reached, KEY, "left_anti"))
        if frontier.isEmpty():
            break
        reached = reached.unionByName(frontier)
    return reached


def walk(edges: DataFrame, seeds: DataFrame, depth: int = 1, reverse: bool = True) -> DataFrame:
    """(repo, id, depth, edge, from_repo, from_id): nodes reached from the seeds (repo, id) over dependency edges.

    ``reverse`` follows edges backwards (what is affected); otherwise forward (what it needs).
    """
    near, far = ("dst", "src") if reverse else ("src", "dst")
    hops = edges.where(F.col("edge_type").isin(*DEPENDENCY)).select(
        F.col(f"{near}_repo").alias("from_repo"), F.col(f"{near}_id").alias("from_id"), F.col(f"{far}_repo").alias("repo"), F.col(f"{far}_id").alias("id"), F.col("edge_type").alias("edge"), strength(F.col("edge_type")).alias("s")
    )
    seen = seeds.select(*KEY).distinct()
    frontier, out = seen, None
    for d in range(1, depth + 1):
        reach = hops.join(frontier.toDF("from_repo", "from_id"), ["from_repo", "from_id"]).join(seen, KEY, "left_anti")
        level = reach.groupBy(*KEY).agg(F.min(F.struct("s", "from_repo", "from_id", "edge")).alias("b")).select(*KEY, F.lit(d).alias("depth"), "b.edge", "b.from_repo", "b.from_id")
        if d < depth:
            level = written(level)
        out = level if out is None else out.unionByName(level)
        frontier = level.select(*KEY)
        seen = seen.unionByName(frontier)
    return out


def whole_walk(edges: DataFrame, nodes: DataFrame, seeds: DataFrame, depth: int = 1, reverse: bool = True) -> DataFrame:
    """(repo, id, depth, edge, from_repo, from_id): ``walk`` with what a node stands for and with contract hops.

    Types stand for their members, seeds that are files or modules for all in them, functions
    forwards for those inside them; backwards a use inside a function is one by the functions
    around it. ``calls_api`` leads from a handler to its operations' clients, ``handled_by``
    from a client to the handlers. Placeholders, stand-ins and nodes without a path are not reached.
    """
    near, far = ("dst", "src") if reverse else ("src", "dst")
    ends = lambda a, b: [F.col(f"{a}_repo").alias("from_repo"), F.col(f"{a}_id").alias("from_id"), F.col(f"{b}_repo").alias("repo"), F.col(f"{b}_id").alias("id")]
    hops = edges.where(F.col("edge_type").isin(*DEPENDENCY)).select(*ends(near, far), F.col("edge_type").alias("edge"), strength(F.col("edge_type")).alias("s"))
    over = contract_hops(edges).select(*ends(*(("handler", "client") if reverse else ("client", "handler"))), F.lit("calls_api" if reverse else "handled_by").alias("edge"), F.lit(len(DEPENDENCY)).alias("s"))
    hops, over = written(hops), written(over.distinct())
    shown = nodes.where("kind not in ('symbol', 'import', 'service') and path <> ''").select(*KEY)
    kinds = nodes.select(*KEY, "kind")
    functions = kinds.where("kind in ('function', 'method')").select(*KEY)
    inside = edges.where("edge_type = 'contains'").select("edge_type", "src_repo", "src_id", "dst_repo", "dst_id").distinct()
    nested = written(inside.join(functions.toDF("src_repo", "src_id"), ["src_repo", "src_id"], "left_semi").join(functions.toDF("dst_repo", "dst_id"), ["dst_repo", "dst_id"], "left_semi"))
    row = [*KEY, "from_repo", "from_id", "edge", "s"]

    def stands_for(level: DataFrame, first: bool) -> DataFrame:
        of = written(level.join(kinds, KEY))
        types = of.where("kind = 'type'").select(*KEY)
        out = of.select(*KEY).unionByName(with_members(nodes, types).select(*KEY)).unionByName(closure(edges, types, max_levels=1))
        if first:
            out = out.unionByName(closure(edges, of.where("kind in ('file', 'module')")))
        out = out.distinct()
        return written(out if reverse else out.unionByName(closure(nested, out.join(functions, KEY, "left_semi"))).distinct())

    def with_outer(found: DataFrame) -> DataFrame:
        found = step = written(found.select(*row).distinct())
        while not step.isEmpty():
            up = step.join(nested, (F.col("repo") == F.col("dst_repo")) & (F.col("id") == F.col("dst_id")))
            step = written(up.select(F.col("src_repo").alias("repo"), F.col("src_id").alias("id"), *row[2:]).distinct().join(found, row, "left_anti"))
            found = found.unionByName(step)
        return found

    frontier, seen, out = seeds.select(*KEY).distinct(), None, None
    for d in range(1, depth + 1):
        # a function's nested ones, forwards, are read but can still be reached
        source = stands_for(frontier, d == 1).toDF("from_repo", "from_id")
        if seen is None:
            types = frontier.join(kinds.where("kind = 'type'"), KEY, "left_semi")
            held = closure(edges, frontier.join(kinds.where("kind in ('file', 'module')"), KEY, "left_semi"))
            seen = written(frontier.unionByName(held).unionByName(with_members(nodes, types).select(*KEY)).unionByName(closure(edges, types, max_levels=1)).distinct())
        reach = hops.join(source, ["from_repo", "from_id"]).select(*row)
        reach = (with_outer(reach) if reverse else reach).unionByName(over.join(source, ["from_repo", "from_id"]).select(*row))
        reach = reach.join(seen, KEY, "left_anti").join(shown, KEY, "left_semi")
        level = written(reach.groupBy(*KEY).agg(F.min(F.struct("s", "from_repo", "from_id", "edge")).alias("b")).select(*KEY, F.lit(d).alias("depth"), "b.edge", "b.from_repo", "b.from_id"))
        out = level if out is None else out.unionByName(level)
        frontier = level.select(*KEY)
        seen = seen.unionByName(frontier)
    return out


def by_file(reached: DataFrame, nodes: DataFrame, limit: int | None = 100) -> DataFrame:
    """(repo, path, depth, symbols, names): reached symbols per file, nearest files first."""
    named = reached.join(nodes.select(*KEY, "name", "path", "start_line"), KEY).where("path <> ''")
    files = named.groupBy("repo", "path").agg(F.min("depth").alias("depth"), F.count("*").alias("symbols"), F.sort_array(F.collect_list(F.struct("depth", "start_line", "id"))).alias("ordered"))
    files = files.select("repo", "path", "depth", "symbols", F.transform("ordered", lambda s: s["id"]).alias("ids"))
    return files.orderBy("depth", "repo", "path").limit(limit) if limit else files


def shortest_paths(edges: DataFrame, seeds: DataFrame, targets: DataFrame, max_hops: int | None = 8) -> DataFrame:
    """(seed_repo, seed_id, repo, id, hops, path): fewest hops from each seed to each target it reaches.

    Equally short paths are decided by the smallest (edge type, node) at each step back.
    Without ``max_hops`` it ends when a level adds nothing. Nodes are numbered in the order of
    (repo, id), and a level keeps three numbers a row: seed, node, and where that was reached
    from. Only the targets' paths are put together, step by step back.
    """
    kinds = sorted((*DEPENDENCY, "contains"))
    rows = edges.where(F.col("edge_type").isin(*kinds)).groupBy("src_repo", "src_id", "dst_repo", "dst_id").agg(F.min(F.array_position(F.array(*[F.lit(k) for k in kinds]), F.col("edge_type"))).cast("byte").alias("edge"))
    ends = [rows.select(F.col(f"{e}_repo").alias("repo"), F.col(f"{e}_id").alias("id")) for e in ("src", "dst")]
    every = ends[0].union(ends[1]).union(seeds.select(*KEY)).union(targets.select(*KEY)).where("repo is not null and id is not null").distinct()
    names = written(every.orderBy(*KEY).select(F.monotonically_increasing_id().alias("i"), *KEY))
    number = lambda e, name: names.select(F.col("repo").alias(f"{e}_repo"), F.col("id").alias(f"{e}_id"), F.col("i").alias(name))
    hops = written(rows.join(number("src", "i"), ["src_repo", "src_id"]).join(number("dst", "to"), ["dst_repo", "dst_id"]).select("i", "to", "edge"))
    goals = written(targets.select(*KEY).distinct().join(names, KEY).select("i"))
    level = written(seeds.select(*KEY).distinct().join(names, KEY).select(F.col("i").alias("s"), "i", F.lit(None).cast("long").alias("up")))
    levels, seen = [level], level.select("s", "i")
    while max_hops is None or len(levels) <= max_hops:
        step = level.select("s", "i").join(hops, "i").groupBy("s", F.col("to")).agg(F.min(F.struct("edge", "i")).alias("b"))
        step = step.select("s", F.col("to").alias("i"), F.col("b.i").alias("up"))
        level = written(step.join(seen, ["s", "i"], "left_anti"))
        if level.isEmpty():
            break
        levels.append(level)
        seen = seen.unionByName(level.select("s", "i"))
    found = None  # paths that lead on to a target, from node ``i``
    for d in range(len(levels) - 1, -1, -1):
        here = levels[d].join(goals, "i", "left_semi").select("s", F.col("i").alias("end"), F.lit(d).alias("hops"), F.array("i").alias("path"), "i")
        found = here if found is None else here.unionByName(found)
        if d:
            found = written(found.join(levels[d], ["s", "i"]).select("s", "end", "hops", F.concat(F.array("up"), "path").alias("path"), F.col("up").alias("i")))
    # numbers to ids
    steps = found.select("s", "end", "hops", F.posexplode("path").alias("at", "i")).join(names.select("i", "id"), "i")
    paths = steps.groupBy("s", "end", "hops").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "id"))), lambda x: x["id"]).alias("path"))  # at most hops + 1 each
    paths = paths.join(names.select(F.col("i").alias("s"), F.col("repo").alias("seed_repo"), F.col("id").alias("seed_id")), "s").join(names.withColumnRenamed("i", "end"), "end")
    return paths.select("seed_repo", "seed_id", *KEY, "hops", "path")


def contract_hops(edges: DataFrame) -> DataFrame:
    """(client_repo, client_id, op_repo, op_id, handler_repo, handler_id): clients and handlers of one operation."""
    op = [F.col("dst_repo").alias("op_repo"), F.col("dst_id").alias("op_id")]
    uses = edges.where("edge_type = 'consumes'").select(F.col("src_repo").alias("client_repo"), F.col("src_id").alias("client_id"), *op)
    serves = edges.where("edge_type = 'implements'").select(F.col("src_repo").alias("handler_repo"), F.col("src_id").alias("handler_id"), *op)
    return uses.join(serves, ["op_repo", "op_id"]).distinct()


def providers(edges: DataFrame, nodes: DataFrame, role: str = "implements") -> DataFrame:
    """(op_repo, op_id, op_name, repo, id, name, kind) of every operation's implementers or consumers."""
    ops = nodes.where("kind = 'operation'").select(F.col("repo").alias("op_repo"), F.col("id").alias("op_id"), F.col("name").alias("op_name"))
    hits = edges.where(F.col("edge_type") == role).select(F.col("dst_repo").alias("op_repo"), F.col("dst_id").alias("op_id"), F.col("src_repo").alias("repo"), F.col("src_id").alias("id")).distinct()
    return hits.join(ops, ["op_repo", "op_id"]).join(nodes.select(*KEY, "name", "kind"), KEY)
