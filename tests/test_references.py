import datetime as dt

from graphloom.operators import references

D = dt.datetime
NODES = "repo string, id string, props map<string,string>, indexed_at timestamp_ntz, deleted_at timestamp_ntz, extra string"
EDGES = "edge_id long, src_repo string, src_id string, dst_repo string, dst_id string, edge_type string, written_at timestamp_ntz, loaded_at timestamp_ntz"
OVER = "edge_id long, src_uri string, dst_uri string, edge_type string, written_at timestamp_ntz"


def node(repo, id, born, died=None, uri=None):
    return (repo, id, {"repo_uri": uri} if uri else {}, born, died, "x")


def run(spark, nodes, edges, over=()):
    out = references.orphan_references(spark.createDataFrame(list(edges), EDGES), spark.createDataFrame(list(over), OVER), spark.createDataFrame(list(nodes), NODES), ranges=5)
    return {(r["source_table"], r["edge_id"], r["side"]) for r in out.collect()}


def edge(i, a, b, at, ra="r", rb="r"):
    return (i, ra, a, rb, b, "calls", at, at)


def test_life_spans(spark):
    nodes = [node("r", "a", D(2024, 1, 10)), node("r", "b", D(2024, 2, 10), D(2024, 4, 20)), node("r", "b", D(2024, 6, 1)), node("r", "late", D(2025, 1, 1)), node("r", "never", None)]
    edges = [
        edge(1, "a", "b", D(2024, 3, 1)),  # both live
        edge(2, "a", "b", D(2024, 4, 20)),  # b dies at that moment
        edge(3, "a", "b", D(2024, 6, 1)),  # b is born at that moment
        edge(4, "a", "late", D(2024, 12, 31)),
        edge(5, "a", "never", D(2024, 12, 31)),
        edge(6, "a", "gone", D(2024, 12, 31)),
        edge(7, "a", "a", D(2024, 1, 9)),
        edge(8, None, "", D(2024, 3, 1)),
        edge(9, "a", "b", None),
        edge(10, "a", "b", D(2024, 3, 1), None, "other"),
        edge(6, "a", "gone", D(2024, 12, 31)),  # delivered again
    ]
    want = {(2, "dst"), (4, "dst"), (5, "dst"), (6, "dst"), (7, "src"), (7, "dst"), (9, "src"), (9, "dst"), (10, "src"), (10, "dst")}
    assert run(spark, nodes, edges) == {("edges", *w) for w in want}


def test_uri_spellings(spark):
    nodes = [node("r", "x", D(2024, 1, 1), None, "repo://r/a%20b.go#file"), node("r", "y", D(2024, 1, 1), None, "repo://r/100%.go#file")]
    over = [(1, " repo://r/a b.go#file", "repo://r/%61%20b.go#file ", "calls", D(2024, 5, 5)), (2, "repo://r/100%.go#file", "repo://r/a+b.go#file", "calls", D(2024, 5, 5)), (3, None, "  ", "calls", D(2024, 5, 5))]
    assert run(spark, nodes, [], over) == {("overlay_edges", 2, "dst")}


def test_empty_tables(spark):
    assert run(spark, [], []) == set()
    assert run(spark, [], [edge(1, "a", "b", D(2024, 1, 1))]) == {("edges", 1, "src"), ("edges", 1, "dst")}


def test_periods(spark):
    out = references.orphan_references(spark.createDataFrame([edge(1, "a", "b", D(2024, 1, 1)), edge(2, "a", "", None)], EDGES), spark.createDataFrame([], OVER), spark.createDataFrame([], NODES), ranges=2)
    got = {tuple(r) for r in references.orphans_by_period(out).collect()}
    assert got == {("edges", "calls", "2024-01", 2, 1, 1), ("edges", "calls", None, 1, 1, 0)}


def test_one_null_or_outlying_date_costs_no_more():
    import time

    import numpy as np
    import pyarrow as pa

    n = 250_000
    keys = pa.array([f"k{i}" for i in range(n)])
    periods = np.full(n, 24_290, np.int32)
    periods[0], periods[1] = 12, 119_999  # the years 1 and 9999
    refs = pa.table({"key": keys, "period": periods})
    time_of = lambda y, m: np.datetime64(f"{y:04d}-{m:02d}-01", "us")
    lives = pa.table({"key": keys[: n // 2], "born": np.full(n // 2, time_of(2020, 1)), "died": pa.nulls(n // 2, pa.timestamp("us")), "born_month": np.full(n // 2, 24_240, np.int32), "died_month": pa.nulls(n // 2, pa.int32())})
    began = time.time()
    out = references._andnot_range(refs, lives)
    assert time.time() - began < 1
    assert out.num_rows == n // 2 + 1 and set(out.column("key").to_pylist()[:1]) == {"k0"}


def test_bitmaps_equal_sets():
    import numpy as np

    rng = np.random.default_rng(0)
    for n, share in ((10, 0.5), (200_000, 0.5), (200_000, 0.01), (70_000, 1.0)):
        a, b = (np.flatnonzero(rng.random(n) < share) for _ in range(2))
        bits = np.zeros(-(-n // references.BLOCK) * references.BLOCK, bool)
        bits[b] = True
        assert references.and_not(references.compress(a), np.packbits(bits)).tolist() == sorted(set(a.tolist()) - set(b.tolist()))


def test_matches_brute_force(spark):
    import random

    rng = random.Random(3)
    day = lambda: D(2023, 11, 1) + dt.timedelta(hours=rng.randrange(24 * 500))
    nodes = []
    for _ in range(150):
        born = day()
        nodes.append(node(rng.choice("rs"), f"n{rng.randrange(40)}", born, rng.choice([None, born + dt.timedelta(days=rng.randrange(1, 200)), born])))
    edges = [edge(i, f"n{rng.randrange(45)}", rng.choice(["HOT", f"n{rng.randrange(45)}", None, ""]), rng.choice([day(), day(), day(), None, D(1, 2, 3), D(9999, 5, 6)]), rng.choice("rs"), rng.choice("rs")) for i in range(800)]
    want = set()
    for i, ra, a, rb, b, _, at, _ in edges:
        for side, repo, key in (("src", ra, a), ("dst", rb, b)):
            if key and not (at and any(x[0] == repo and x[1] == key and x[3] <= at and (x[4] is None or at < x[4]) for x in nodes)):
                want.add(("edges", i, side))
    assert run(spark, nodes, edges) == want
