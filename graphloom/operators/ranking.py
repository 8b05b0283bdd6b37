"""Ranked neighborhoods: best product of edge weights over walks of bounded length.

All seeds are ranked in one job. Level d holds, per (seed, node), the best walk of exactly
d hops; levels are joins of the frontier with the adjacency, and the best over all levels
wins, the smaller depth on ties. Equal walks are decided by the edge reason. Weights are kept
to 9 places and scores to 12, so that what should be equal is not told apart by a last bit.

Two bounds keep hubs from multiplying, without changing the result. Of a node's neighbors only
the ``max_nodes`` best live ones count (and placeholders better than the last of those): to any
seed the others come after that many nodes, and what lies behind them does too, since no
weight is above 1. And a walk that is worse than the ``max_nodes``-th node its seed has so far
is not continued.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from graphloom.plans.iterate import cut

#: The weight of an edge by its type, its family, and that of unknown types.
WEIGHTS = {
    "contains": 0.65, "calls": 0.8, "implements": 0.9, "inherits": 0.85, "references": 0.6,
    "consumes": 0.9, "imports": 0.5, "co_committed": 0.7, "observed_calls": 0.85, "documents": 0.6,
}
FAMILY = {"co_committed": "git", "observed_calls": "runtime", "documents": "doc"}
UNKNOWN = 0.3


def family_weights(multipliers: dict[str, float] | None = None) -> dict[str, float]:
    """Weights by type, scaled by the multiplier of each type's family (static, git, runtime, doc)."""
    m = multipliers or {}
    return {t: w * m.get(FAMILY.get(t, "static"), 1.0) for t, w in WEIGHTS.items()}


def places(c: Column, n: int = 12) -> Column:
    """Rounded to ``n`` places."""
    return F.floor(c * 10.0**n + 0.5) / 10.0**n


def signal_multiplier(weight: Column, count: Column, support: Column) -> Column:
    """1 + 0.08 log2(signal) within 0.80 to 1.40; the signal is the weight boosted by its counts, else a count."""
    most = F.greatest(count, support)
    boosted = weight * (1 + 0.1 * F.log2(F.greatest(most, F.lit(1)).cast("double")))
    signal = F.when(weight > 0, boosted).when(count > 0, count.cast("double")).when(support > 0, support.cast("double")).otherwise(F.lit(1.0))
    return F.when(signal == 1.0, 1.0).otherwise(F.least(F.lit(1.40), F.greatest(F.lit(0.80), 1 + 0.08 * F.log2(signal))))


def edge_weight(edge_type: Column, weight: Column, count: Column, support: Column, weights: dict[str, float] | None = None) -> Column:
    """Base weight times signal; capped at 0.99 unless the base itself is above."""
    base = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in (weights or WEIGHTS).items() for x in kv]), edge_type), F.lit(0.0))
    base = F.when(base == 0, UNKNOWN).otherwise(base)
    w = base * signal_multiplier(F.coalesce(weight, F.lit(0.0)), count, support)
    return places(F.when(base <= 0.99, F.least(w, F.lit(0.99))).otherwise(w), 9)


def adjacency(edges: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """(from_repo, from_id, to_repo, to_id, w, reason): the best edge of each direction between two nodes."""
    scored = edges.withColumn("w", edge_weight(F.col("edge_type"), F.col("weight"), F.col("calls"), F.col("support"), weights))
    out = scored.select(F.col("src_repo").alias("from_repo"), F.col("src_id").alias("from_id"), F.col("dst_repo").alias("to_repo"), F.col("dst_id").alias("to_id"), "w", F.concat(F.lit("out:"), "edge_type").alias("reason"))
    back = scored.select(F.col("dst_repo").alias("from_repo"), F.col("dst_id").alias("from_id"), F.col("src_repo").alias("to_repo"), F.col("src_id").alias("to_id"), "w", F.concat(F.lit("in:"), "edge_type").alias("reason"))
    both = out.unionByName(back)
    return both.groupBy("from_repo", "from_id", "to_repo", "to_id").agg(F.max(F.struct("w", "reason")).alias("b")).select("from_repo", "from_id", "to_repo", "to_id", "b.*")


def best_neighbors(near: DataFrame, nodes: DataFrame, most: int) -> DataFrame:
    """``adjacency`` rows that can matter to a result of ``most`` nodes, with ``live`` and ``mark`` (a symbol or import)."""
    shown = nodes.select(F.col("repo").alias("to_repo"), F.col("id").alias("to_id"), F.lit(True).alias("live"), F.col("kind").isin("symbol", "import").alias("mark"))
    near = near.join(shown, ["to_repo", "to_id"], "left").withColumn("live", F.coalesce("live", F.lit(False)))
    order = Window.partitionBy("from_repo", "from_id").orderBy(F.desc("w"), "mark", "to_id", "to_repo")
    live = near.where("live").withColumn("k", F.row_number().over(order)).where(F.col("k") <= most)
    full = live.where(F.col("k") == most).select("from_repo", "from_id", F.col("w").alias("least"))
    other = near.where("not live").join(full, ["from_repo", "from_id"], "left").where("least is null or w > least").drop("least")
    return live.drop("k").unionByName(other)


def neighborhood(edges: DataFrame, nodes: DataFrame, seeds: DataFrame, depth: int = 2, max_nodes: int = 32, weights: dict[str, float] | None = None, explain: bool = False) -> DataFrame:
    """(seed_repo, seed_id, repo, id, kind, name, score, depth, reason, position) for every seed (repo, id).

    ``edges`` as ``live_edges``; nodes that are not live are left out of the result, but walks
    may pass them. At most ``max_nodes`` rows per seed, best score first, then depth, real
    nodes before symbols and imports, id, repo. With ``explain`` a column ``walk`` lists
    (family, edge_type, dir, weight) of each hop of the winning walk.
    """
    near = adjacency(edges, weights)
    bounded = max((weights or WEIGHTS).values()) <= 0.99  # else a walk may gain on the way
    near = best_neighbors(near, nodes, max_nodes) if bounded else near.withColumn("live", F.lit(True))
    near = near.withColumnRenamed("live", "to_live")
    if explain:
        kind = F.substring_index("reason", ":", -1)
        fam = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in FAMILY.items() for x in kv]), kind), F.lit("static"))
        near = near.withColumn("hop", F.struct(fam.alias("family"), kind.alias("edge_type"), F.substring_index("reason", ":", 1).alias("dir"), F.col("w").alias("weight")))
    key, more = ["seed_repo", "seed_id", "repo", "id"], (["walk"] if explain else [])
    level = seeds.select(F.col("repo").alias("seed_repo"), F.col("id").alias("seed_id"), "repo", "id", F.lit(1.0).alias("score"), F.lit("seed").alias("reason"), F.lit(True).alias("live")).distinct()
    if explain:
        level = level.withColumn("walk", F.array().cast("array<struct<family:string,edge_type:string,dir:string,weight:double>>"))
    if depth > 2:
        near = cut(near)
    reached = level.withColumn("depth", F.lit(0))
    for d in range(1, depth + 1):
        if bounded and d > 2:
            # nothing behind a walk can pass the last of enough nodes that its seed has
            best = reached.where("live").groupBy(*key).agg(F.max("score").alias("score"))
            last = best.withColumn("k", F.row_number().over(Window.partitionBy("seed_repo", "seed_id").orderBy(F.desc("score")))).where(F.col("k") == max_nodes)
            last = last.select("seed_repo", "seed_id", F.col("score").alias("least"))
            level = level.join(last, ["seed_repo", "seed_id"], "left").where("least is null or score > least").drop("least")
        step = level.drop("reason", "live").join(near, (F.col("repo") == F.col("from_repo")) & (F.col("id") == F.col("from_id")))
        walk = [F.concat("walk", F.array("hop")).alias("walk")] if explain else []
        step = step.select("seed_repo", "seed_id", F.col("to_repo").alias("repo"), F.col("to_id").alias("id"), places(F.col("score") * F.col("w")).alias("score"), "reason", F.col("to_live").alias("live"), *walk)
        level = step.groupBy(*key).agg(F.max(F.struct("score", "reason", *more)).alias("b"), F.max("live").alias("live")).select(*key, "b.*", "live")
        if d < depth and depth > 2:
            level = cut(level)
        reached = reached.unionByName(level.withColumn("depth", F.lit(d)))
    best = reached.groupBy(*key).agg(F.max(F.struct("score", (-F.col("depth")).alias("nd"), "reason", *more)).alias("b"))
    hits = best.select(*key, "b.score", (-F.col("b.nd")).alias("depth"), "b.reason", *[F.col(f"b.{m}") for m in more]).join(nodes.select("repo", "id", "kind", "name"), ["repo", "id"])
    order = Window.partitionBy("seed_repo", "seed_id").orderBy(F.desc("score"), "depth", F.col("kind").isin("symbol", "import"), "id", "repo")
    return hits.withColumn("position", F.row_number().over(order)).where(F.col("position") <= max_nodes)


def pack_budget(hits: DataFrame, budget: int, *texts: str) -> DataFrame:
    """Hits that fit a budget of bytes in order of position; the first is always kept."""
    from graphloom.functions.text import estimate_chars

    order = Window.partitionBy("seed_repo", "seed_id").orderBy("position").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return hits.withColumn("cost", estimate_chars(*[F.col(t) for t in texts])).withColumn("used", F.sum("cost").over(order)).where((F.col("position") == 1) | (F.col("used") <= budget))
