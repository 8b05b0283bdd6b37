import random
from collections import defaultdict

from pyspark.sql import functions as F

from graphloom.operators import skew

EDGE = "edge_id long, src_id string, dst_id string, extra string"


def brute(rows):
    seen = defaultdict(set)
    for e, s, d, _ in rows:
        for side, i in ((0, s), (1, d)):
            if i:
                seen[i].add((e, side))
    return {k: len(v) for k, v in seen.items()}


def make(n=3000, seed=1):
    rng = random.Random(seed)
    ids = ["hot"] * 300 + [f"n{i}" for i in range(400)] + [None, ""]
    rows = [(rng.randrange(n // 2), rng.choice(ids), rng.choice(ids), "x") for _ in range(n)]
    return rows + rows[:200]


def test_degrees_match_brute_force(spark):
    rows = make()
    got = {r["id"]: r["degree"] for r in skew.degrees(spark.createDataFrame(rows, EDGE), tasks=7).collect()}
    assert got == brute(rows)


def test_hot_ids(spark):
    rows = make()
    total = len({r[0] for r in rows})
    want = {k for k, n in brute(rows).items() if n >= 0.01 * total}
    assert {r["id"] for r in skew.hot_ids(spark.createDataFrame(rows, EDGE), 0.01).collect()} == want


def test_share_is_exact(spark):
    rows = [(i, "a" if i < 29 else f"x{i}", None, "") for i in range(2900)]
    assert {r["id"] for r in skew.hot_ids(spark.createDataFrame(rows, EDGE), 0.01).collect()} == {"a"}
    assert skew.hot_ids(spark.createDataFrame(rows + [(2900, "y", None, "")], EDGE), 0.01).count() == 0


def test_empty_and_null(spark):
    assert skew.degrees(spark.createDataFrame([], EDGE)).count() == 0
    assert skew.degrees(spark.createDataFrame([(1, None, "", "x"), (None, "a", "b", "x")], EDGE)).count() == 0


def test_plan_is_balanced():
    loads = {0: 100_000} | {b: 50 for b in range(1, 2000)}
    plan = skew.pack(loads, tasks=10)
    assert max(plan.loads) <= 1.1 * sum(plan.loads) / 10
    assert len(plan.placement[0]) >= 5 and all(len(plan.placement[b]) == 1 for b in range(1, 2000))


def test_fragment_join_equals_join(spark):
    left = spark.createDataFrame([(("hot" if i % 3 else f"k{i % 50}"), i) for i in range(2000)] + [(None, -1)], "k string, v long")
    right = spark.createDataFrame([("hot", 1), ("hot", 2), ("k3", 3), ("zzz", 4), (None, 5)], "k string, w long")
    plan = skew.plan_fragments(left, "k", tasks=5, buckets=64)
    for how in ("inner", "left_semi", "left_anti"):
        got = skew.fragment_join(left, right, "k", F.col("v"), plan, how)
        want = left.where("k is not null").join(right, "k", how)
        assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_hot_key_is_spread(spark):
    left = spark.range(4000).select(F.lit("hot").alias("k"), "id")
    plan = skew.plan_fragments(left, "k", tasks=8)
    sizes = [r["count"] for r in skew.route(left, "k", F.col("id"), plan).groupBy("_frag_task").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * min(sizes)
