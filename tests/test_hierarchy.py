import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from graphloom.operators import hierarchy

SCHEMA = "trace_file string, span_id string, parent_span_id string, name string, parent string, received_at timestamp_ntz, extra string"
T0 = dt.datetime(2025, 1, 1)


def row(f, s, p=None, name=None, parent=None, at=0):
    return (f, s, p, name, parent, T0 + dt.timedelta(seconds=at), "x")


def clean(x):
    x = (x or "").strip().lower()
    return None if not x or set(x) == {"0"} else x


def brute(rows):
    last = {}
    for r in rows:
        s = clean(r[1])
        if s and ((r[0], s) not in last or last[r[0], s][5] < r[5]):
            last[r[0], s] = r
    names = {}
    for (f, s), r in last.items():
        names.setdefault((f, (r[3] or "").strip() if r[3] is not None else None), []).append(s)
    parent = {}
    for (f, s), r in last.items():
        p1, p2 = clean(r[2]), clean(r[4])
        if p1 and (f, p1) in last:
            parent[f, s] = p1
        elif p2 and (f, p2) in last:
            parent[f, s] = p2
        else:
            who = names.get((f, (r[4] or "").strip()), []) if (r[4] or "").strip() else []
            parent[f, s] = who[0] if len(who) == 1 else None
    out = {}
    for f, s in last:
        path, at = [s], s
        while parent[f, at] is not None and len(path) <= len(last):
            at = parent[f, at]
            path.append(at)
        lost = parent[f, at] is not None
        out[f, s] = (parent[f, s], None if lost else at, None if lost else len(path) - 1, None if lost else "/" + "/".join(reversed(path)))
    return out


def cases(seed=0):
    rng = random.Random(seed)
    rows = []
    for f in ("a", "b", None):
        for i in range(30):
            p = rng.choice([None, "", "0000", f" S{rng.randrange(30)} ", f"s{rng.randrange(30)}", "gone"])
            rows.append(row(f, rng.choice([f"s{i}", f" S{i}"]), p, rng.choice(["n1", "n2", None, f"u{i}"]), rng.choice([None, "u3", " u5", "n1", "s4"]), rng.randrange(100) * 100 + i))
    rows += [row("a", None), row("a", "0"), row("loop", "x", "x"), row("loop", "y", "z"), row("loop", "z", "y"), row("loop", "w", "z"), row("loop", "r")]
    rows += [row("a", "s1", "s2", "n1", None, 99999), row("a", "s1", "s2", "n1", None, 99999)]
    rows += [row("deep", f"d{i}", f"d{i - 1}" if i else None) for i in range(6)]
    return rows


@pytest.mark.parametrize("limit", [1_000_000, 0])
def test_forest_matches_brute_force(spark, limit):
    rows = cases()
    if not limit:  # the distributed way
        rows = rows + [row("flat", f"f{i}", "f0" if i else None) for i in range(20)]
    want = brute(rows)
    got = hierarchy.forest(spark.createDataFrame(rows, SCHEMA), paths=True, max_file_rows=limit).collect()
    assert {(r["trace_file"], r["span_id"]): (r["parent_id"], r["root"], r["depth"], r["path"]) for r in got} == want
    rooted = {(r["trace_file"], r["span_id"]): r for r in got if not r["rootless"]}
    assert set(rooted) == {k for k, v in want.items() if v[1]}
    for (f, s), r in rooted.items():
        below = {k for k in rooted if k[0] == f and want[k][3].startswith(want[f, s][3] + "/")}
        assert r["descendants"] == len(below)
        inside = {k for k, x in rooted.items() if k[0] == f and x["root"] == r["root"] and r["pre"] < x["pre"] <= r["pre"] + r["descendants"]}
        assert inside == below


def test_both_ways_agree(spark):
    rows = [row("t", f"s{i}", f"s{(i * 7) // 10 - 1}" if i > 3 else None) for i in range(25)] + [row("t", "c", "c")]
    df = spark.createDataFrame(rows, SCHEMA)
    a, b = (sorted(map(tuple, hierarchy.forest(df, max_file_rows=m).collect()), key=str) for m in (1000, 0))
    assert a == b


def test_a_long_chain_of_a_large_file(spark):
    n = 3000
    rows = spark.range(n).selectExpr("'t' as trace_file", "concat('s', id) as span_id", "case when id > 0 then concat('s', id - 1) end as parent_span_id", "'n' as name", "cast(null as string) as parent", "timestamp_ntz '2025-01-01' as received_at")
    got = hierarchy.forest(rows, max_file_rows=100).selectExpr("count(*)", "max(depth)", "max(descendants)", "count_if(pre = depth and root = 's0' and depth + descendants = 2999)").first()
    assert tuple(got) == (n, n - 1, n - 1, n)


def test_small_files_beside_a_large_one(spark):
    rows = [row("big", f"s{i}", f"s{i // 3}" if i else None) for i in range(40)] + [row("small", "a"), row("small", "b", "a"), row(None, "c", "c")]
    a, b = (sorted(map(tuple, hierarchy.forest(spark.createDataFrame(rows, SCHEMA), max_file_rows=m).collect()), key=str) for m in (1000, 10))
    assert a == b and len(a) == 43


def test_rootless_and_descendants(spark):
    df = spark.createDataFrame(cases(), SCHEMA)
    lost = {tuple(r) for r in hierarchy.rootless(df).collect() if r[0] == "loop"}
    assert lost == {("loop", s) for s in "xyzw"}
    tree = hierarchy.forest(df)
    of = spark.createDataFrame([("deep", "d2")], "trace_file string, span_id string")
    assert {r["span_id"] for r in hierarchy.descendants(tree, of).collect()} == {"d3", "d4", "d5"}


def test_empty(spark):
    assert hierarchy.forest(spark.createDataFrame([], SCHEMA)).count() == 0
    assert hierarchy.forest(spark.createDataFrame([row("a", None)], SCHEMA)).where(F.col("rootless")).count() == 0
