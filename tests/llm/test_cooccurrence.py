import datetime as dt
import random
from collections import Counter
from itertools import combinations

import pytest

from graphloom.llm import cooccurrence as C

SCHEMA = "repo string, commit_hash string, committed_at timestamp_ntz, paths array<string>, support string"
END = dt.datetime(2025, 12, 31)


def clean(p):
    p = (p or "").strip(" ")
    return (p[2:] if p.startswith("./") else p) or None


def brute(rows, most=100):
    sets, when = {}, {}
    for r, h, t, ps, _ in rows:
        if r is None or h is None:
            continue
        found = {clean(p) for p in ps or []} - {None}
        sets.setdefault((r, h), set()).update(found)
        if found and t is not None:
            when[r, h] = max(when.get((r, h), t), t)
    pairs, weight, items, totals = Counter(), Counter(), Counter(), Counter()
    for (r, h), s in sets.items():
        if 2 <= len(s) <= most:
            totals[r] += 1
            items.update((r, p) for p in s)
            for a, b in combinations(sorted(s), 2):
                pairs[r, a, b] += 1
                weight[r, a, b] += 0.5 ** (max(0, (END - when[r, h]).total_seconds()) / 86400 / 90)
    return {k: (n, round(weight[k], 6), round(n * totals[k[0]] / (items[k[0], k[1]] * items[k[0], k[2]]), 6)) for k, n in pairs.items()}


def data(seed=0, n=200):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        r, h = rng.choice("rs"), f"h{rng.randrange(120)}"
        ps = [rng.choice([f"p{rng.randrange(12)}", "HOT", "./HOT", " p1 ", None, "", "  "]) for _ in range(rng.randrange(0, 7))]
        rows.append((r, h, END - dt.timedelta(days=rng.randrange(-5, 400)), ps, "x"))
    rows += [("r", "bulk", END, [f"b{i}" for i in range(101)], "x"), ("r", "full", END, [f"b{i}" for i in range(100)], "x"), (None, "h", END, ["a", "b"], "x"), ("r", None, END, ["a", "b"], "x"), ("r", "none", END, None, "x")]
    return rows + rows[:20]


@pytest.fixture
def store(spark, tmp_path):
    made = []

    def make(**k):
        made.append(C.PairStore(spark, str(tmp_path / f"s{len(made)}"), **k))
        return made[-1]

    return make


def scores(s):
    return {(r["repo"], r["path_a"], r["path_b"]): (r["support"], round(r["weight"], 6), round(r["lift"], 6)) for r in s.scores().collect()}


def take(s, *deliveries):
    for rows in deliveries:
        s.update(s.spark.createDataFrame(list(rows), SCHEMA))
    return s


def test_one_delivery_matches_brute_force(store):
    rows = data()
    assert scores(take(store(), rows)) == brute(rows)


def test_deliveries_equal_a_full_run(store):
    rows = data(1)
    s = store(buckets=3)
    for upto in (120, len(rows)):
        take(s, rows[50:] if upto > 120 else rows[:upto])  # with some delivered again
        assert scores(s) == brute(rows[:upto])
    again = s.update(s.spark.createDataFrame(rows[::-1], SCHEMA))
    assert again == 3 and scores(s) == brute(rows)  # nothing counts twice


def test_a_basket_that_grows_too_large_leaves_nothing(store):
    small, more = [("r", "1", END, ["a", "b"], ""), ("r", "2", END, ["a", "c"], "")], [("r", "1", END, [f"x{i}" for i in range(99)], "")]
    s = take(store(), small, more)
    assert scores(s) == brute(small + more) == {("r", "a", "c"): (1, 1.0, 1.0)}
    assert s.read("pairs").count() == 1 and s.read("items").count() == 2
    take(s, more)  # still too large
    assert scores(s) == brute(small + more)


def test_only_touched_buckets_are_written_again(store):
    rows = [(r, f"{r}{i}", END, [f"a{i}", f"b{i}"], "") for r in "rstu" for i in range(20)]
    s = take(store(buckets=16), rows)
    first = s.manifest()
    take(s, [("r", "new", END, ["a0", "b0"], "")])
    second = s.manifest()
    for table, most in (("baskets", 1), ("pairs", 1), ("items", 2), ("totals", 1), ("scores", 1)):
        before, now = (m["tables"][table]["parts"] for m in (first, second))
        assert before.keys() == now.keys() and 1 <= sum(before[b] != now[b] for b in now) <= most
    assert scores(s) == brute([*rows, ("r", "new", END, ["a0", "b0"], "")])


def test_an_update_that_dies_leaves_the_old_state(store, monkeypatch):
    rows = data(3)
    s = take(store(), rows[:100])
    monkeypatch.setattr(C.PairStore, "commit", lambda *_: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        take(s, rows[100:])
    monkeypatch.undo()
    assert scores(s) == brute(rows[:100])
    assert scores(take(s, rows[100:])) == brute(rows)
    with pytest.raises(RuntimeError):
        s.commit({"version": 2, "tables": {}})


def test_old_files_go(store):
    s = take(store(), *(data(4, 30) for _ in range(1)), *([("r", f"k{i}", END, ["a", "b"], "")] for i in range(3)))
    assert s.versions() == [3, 4]
    named = {(t, b, f) for v in s.versions() for t, x in s.manifest(v)["tables"].items() for b, f in x["parts"].items()}
    for f in s.files(""):
        for t in s.files(f) if f.startswith("v") else ():
            assert all((t, b.split("=")[1], f) in named for b in s.files(f"{f}/{t}") if b.startswith("bucket="))


def test_buckets_grow(store, monkeypatch):
    monkeypatch.setattr(C, "ROWS_PER_BUCKET", 5)
    rows = data(5, 60)
    s = take(store(), rows[:20])
    few = s.manifest()["tables"]["pairs"]["buckets"]
    assert scores(take(s, rows[20:])) == brute(rows)
    assert s.manifest()["tables"]["pairs"]["buckets"] > few


def test_least_support_and_fall_below_it(store):
    rows = [("r", "1", END, ["a", "b"], ""), ("r", "2", END, ["a", "b"], ""), ("r", "3", END, ["a", "c"], "")]
    s = take(store(min_support=2), rows)
    assert set(scores(s)) == {("r", "a", "b")}
    take(s, [("r", "2", END, [f"x{i}" for i in range(100)], "")])
    assert scores(s) == {}


def test_empty(store):
    s = store()
    assert scores(s) == {}
    assert scores(take(s, [], [(None, None, None, None, None)])) == {}
    assert scores(take(s, [("r", "1", None, ["a", "b"], "")])) == {("r", "a", "b"): (1, 0.0, 1.0)}
