"""Per-key work over heavily skewed keys: fragment-replicate by estimated load.

A handful of keys may hold most rows. ``plan_fragments`` hashes keys to a fixed number
of buckets, measures each bucket's load with one map-side-combined count, splits the
buckets that are too large for one task into proportionate shards, and bin-packs all
shards onto tasks, largest first. The plan has one row per bucket whatever the input
size, so it may be broadcast. ``route`` sends each row straight to its task (the task
number is the shuffle partition, no second hash), and ``fragment_join`` replicates the
matching side only to the tasks that hold shards of its bucket.

Edge cases: rows with a null key are left out by ``route`` (they have no per-key
result); an empty input gives a plan of one task per bucket and empty results; repeated
rows, ties and extra columns pass through unchanged. Columns the operators add start
with ``_frag_`` and are dropped again.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass
from fractions import Fraction

from pyspark.sql import Column, DataFrame, functions as F, types as T

from graphloom.plans.tables import tasks_of

BUCKETS = 4096
ROWS_PER_TASK = 4_000_000  # more tasks than the session plans for, if the input needs them


@dataclass(frozen=True)
class FragmentPlan:
    """Tasks that serve each bucket; ``placement[b]`` has one entry per shard of bucket b."""

    tasks: int
    buckets: int
    placement: tuple[tuple[int, ...], ...]
    loads: tuple[float, ...]  # estimated rows per task, for tests and reports


def pack(loads: dict[int, int], tasks: int, buckets: int = BUCKETS, fill: float = 0.5) -> FragmentPlan:
    """Bin-pack bucket loads onto ``tasks``; a shard holds at most ``fill`` of a task's fair share."""
    total = sum(loads.values())
    most = max(1.0, fill * total / tasks)
    shards = []
    for bucket, load in loads.items():
        parts = min(tasks, max(1, -(-load // int(most)) if load > most else 1))
        shards += [(load / parts, bucket, part) for part in range(parts)]
    shards.sort(key=lambda s: (-s[0], s[1], s[2]))
    heap = [(0.0, t) for t in range(tasks)]
    placed: dict[int, list[int]] = {}
    at = [0.0] * tasks
    for load, bucket, _ in shards:
        held, task = heapq.heappop(heap)
        at[task] = held + load
        heapq.heappush(heap, (at[task], task))
        placed.setdefault(bucket, []).append(task)
    return FragmentPlan(tasks, buckets, tuple(tuple(placed.get(b, [b % tasks])) for b in range(buckets)), tuple(at))


Keys = str | list[str]  # a key column, or several


def _columns(key: Keys) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def bucket_of(key: Keys, buckets: int) -> Column:
    return F.pmod(F.xxhash64(*_columns(key)), F.lit(buckets)).cast("int")


def _keyed(df: DataFrame, key: Keys) -> DataFrame:
    for k in _columns(key):
        df = df.where(F.col(k).isNotNull())
    return df


def plan_fragments(keys: DataFrame, key: Keys, tasks: int | None = None, buckets: int = BUCKETS, weight: str | None = None) -> FragmentPlan:
    """Measure the buckets' loads and pack them. At most ``buckets`` rows reach the driver.

    ``keys`` has a row per row of the big side, or per key with the number of its rows in the column ``weight``.
    """
    counted = _keyed(keys, key).groupBy(bucket_of(key, buckets).alias("b")).agg((F.sum(weight) if weight else F.count("*")).alias("n"))
    loads = {r["b"]: r["n"] for r in counted.collect()}
    return pack(loads, tasks or max(tasks_of(keys.sparkSession), -(-sum(loads.values()) // ROWS_PER_TASK)), buckets)


def _placement(df: DataFrame, plan: FragmentPlan) -> DataFrame:
    rows = [(b, list(tasks)) for b, tasks in enumerate(plan.placement)]
    schema = T.StructType([T.StructField("_frag_bucket", T.IntegerType()), T.StructField("_frag_tasks", T.ArrayType(T.IntegerType()))])
    # one row per bucket, a fixed number: safe to broadcast
    return F.broadcast(df.sparkSession.createDataFrame(rows, schema))


def route(df: DataFrame, key: Keys, spread: Column, plan: FragmentPlan) -> DataFrame:
    """Rows moved to their task, numbered in ``_frag_task``; ``spread`` decides the shard of a split bucket."""
    placed = _keyed(df, key).withColumn("_frag_bucket", bucket_of(key, plan.buckets)).join(_placement(df, plan), "_frag_bucket")
    shard = F.pmod(F.xxhash64(spread), F.size("_frag_tasks")).cast("int")
    task = F.element_at("_frag_tasks", shard + 1)
    return placed.withColumn("_frag_task", task).drop("_frag_bucket", "_frag_tasks").repartitionById(plan.tasks, F.col("_frag_task"))


def replicate(df: DataFrame, key: Keys, plan: FragmentPlan) -> DataFrame:
    """The matching side: each row once per task that holds a shard of its key's bucket."""
    placed = _keyed(df, key).withColumn("_frag_bucket", bucket_of(key, plan.buckets)).join(_placement(df, plan), "_frag_bucket")
    return placed.withColumn("_frag_task", F.explode(F.array_distinct("_frag_tasks"))).drop("_frag_bucket", "_frag_tasks").repartitionById(plan.tasks, F.col("_frag_task"))


def fragment_join(left: DataFrame, right: DataFrame, key: Keys, spread: Column, plan: FragmentPlan, how: str = "inner") -> DataFrame:
    """Join on ``key`` with the big side routed and the other replicated to its shards.

    ``how`` may be inner, left, left_semi or left_anti: each left row lives in exactly one
    task, so these need no correction. Columns are those of ``left`` then ``right``'s others.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"fragment_join can't do a {how} join")
    out = route(left, key, spread, plan).join(replicate(right, key, plan), ["_frag_task", *_columns(key)], how)
    return out.drop("_frag_task")


def count_distinct_per_key(df: DataFrame, key: str, units: list[str], plan: FragmentPlan, name: str = "n") -> DataFrame:
    """``count(distinct units)`` per key, without a straggler.

    A unit always lands in the same shard of its key, so the shards' distinct counts add up.
    """
    routed = route(df.select(key, *units), key, F.struct(*units), plan)
    shards = routed.groupBy("_frag_task", key, *units).agg(F.lit(1).alias("_frag_one")).groupBy("_frag_task", key).agg(F.count("*").alias("_frag_n"))
    return shards.groupBy(key).agg(F.sum("_frag_n").alias(name))


def endpoints(edges: DataFrame) -> DataFrame:
    """One row (id, side, edge_id) per non-empty endpoint of each edge row."""
    both = F.array(F.struct(F.col("src_id").alias("id"), F.lit(0).alias("side")), F.struct(F.col("dst_id").alias("id"), F.lit(1).alias("side")))
    return edges.where("edge_id is not null").select("edge_id", F.inline(both)).where("id is not null and id <> ''")


def degrees(edges: DataFrame, tasks: int | None = None) -> DataFrame:
    """Degree of every id over all members: distinct edges out plus distinct edges in.

    Null and empty ids are no ids, a row without edge_id is no edge. Repeated deliveries of
    an edge count once.
    """
    ends = endpoints(edges)
    return count_distinct_per_key(ends, "id", ["edge_id", "side"], plan_fragments(ends, "id", tasks), "degree")


def hot_ids(edges: DataFrame, share: float = 0.01, tasks: int | None = None) -> DataFrame:
    """Ids whose degree is at least ``share`` of the number of distinct edges, compared in whole numbers."""
    total, part = edges.agg(F.countDistinct("edge_id")).first()[0], Fraction(str(share))
    return degrees(edges, tasks).where(F.col("degree") * F.lit(part.denominator) >= F.lit(total * part.numerator))
