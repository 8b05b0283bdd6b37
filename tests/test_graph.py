import pytest
from pyspark.sql import functions as F

from graphloom.functions import paths as P, text as T
from graphloom.operators import analysis, contracts, graph, history, impact, ranking, resolution, tracing

NODE = "repo string, id string, kind string, name string, path string, start_line int, end_line int, uri string"
EDGE = "src_repo string, src_id string, edge_type string, dst_repo string, dst_id string, weight double, support int, calls int"


def nodes(spark, rows):
    return spark.createDataFrame([(r, i, k, n, p, 0, 0, "") for r, i, k, n, p in rows], NODE)


def edges(spark, rows):
    return spark.createDataFrame([("r", a, t, "r", b, None, 0, 0) for a, t, b in rows], EDGE)


def test_neighborhood_scores(spark):
    e = edges(spark, [("func:a#f", "calls", "symbol:g"), ("file:a", "contains", "func:a#f"), ("file:a", "contains", "func:a#h")])
    n = nodes(spark, [("r", "func:a#f", "function", "f", "a"), ("r", "symbol:g", "symbol", "g", ""), ("r", "file:a", "file", "a", "a"), ("r", "func:a#h", "function", "h", "a")])
    hits = ranking.neighborhood(e, n, n.where("id = 'func:a#f'")).orderBy("position").collect()
    assert [(h["id"], round(h["score"], 4), h["depth"], h["reason"]) for h in hits] == [("func:a#f", 1.0, 0, "seed"), ("symbol:g", 0.8, 1, "out:calls"), ("file:a", 0.65, 1, "in:contains"), ("func:a#h", 0.4225, 2, "out:contains")]
    packed = ranking.pack_budget(ranking.neighborhood(e, n, n.where("id = 'func:a#f'")), 60, "id").collect()
    assert [h["position"] for h in packed] == [1]


def test_signal_multiplier(spark):
    rows = [(None, 0, 0), (1.0, 0, 0), (4.0, 0, 0), (0.01, 0, 0), (None, 8, 0), (None, 0, 2), (2.0, 4, 1)]
    df = spark.createDataFrame(rows, "w double, c int, s int").select(ranking.signal_multiplier(F.coalesce("w", F.lit(0.0)), F.col("c"), F.col("s")).alias("m"))
    got = [round(r["m"], 6) for r in df.collect()]
    assert got == [1.0, 1.0, 1.16, 0.8, 1.24, 1.08, round(1 + 0.08 * 1.2630344058, 6)]


def test_seeds_prefer_definitions_and_drop_ambiguous(spark):
    n = nodes(spark, [("r", "func:a#x", "function", "x", "a"), ("r", "symbol:x", "symbol", "x", ""), ("r", "func:a#y", "function", "y", "a"), ("r", "func:b#y", "function", "y", "b")])
    q = spark.createDataFrame([("x",), ("y",), ("func:b#y",), ("nope",)], "query string")
    assert {(r["query"], r["id"]) for r in graph.resolve_seeds(n, q).collect()} == {("x", "func:a#x"), ("func:b#y", "func:b#y")}


def test_seed_tiers(spark):
    rows = [("func:a#f", "function", "f"), ("type:a#F", "type", "Foo"), ("module:Foo", "module", "Foo"), ("file:Foo", "file", "Foo"), ("type:b#G", "type", "G"), ("func:b#G", "function", "G"), ("symbol:only", "symbol", "only"), ("symbol:f", "symbol", "f"), ("heading:x", "heading", "mix"), ("type:c#mix", "type", "mix"), ("type:d#two", "type", "two"), ("type:e#two", "type", "two"), ("module:m", "module", "m"), ("file:m", "file", "m")]
    n = nodes(spark, [("r", i, k, name, "p") for i, k, name in rows])
    q = spark.createDataFrame([(x,) for x in ("f", "Foo", "G", "only", "mix", "two", "m", "func:a#f", "nobody", None)], "query string")
    assert {(r["query"], r["id"], r["tier"]) for r in graph.resolve_seeds(n, q).collect()} == {("f", "func:a#f", 2), ("Foo", "type:a#F", 3), ("only", "symbol:only", 5), ("mix", "type:c#mix", 3), ("func:a#f", "func:a#f", 1)}


def test_walk_labels_strongest(spark):
    e = edges(spark, [("b", "references", "a"), ("b", "inherits", "a"), ("c", "calls", "b"), ("a", "calls", "c")])
    seed = spark.createDataFrame([("r", "a")], "repo string, id string")
    got = {(x["id"], x["depth"], x["edge"]) for x in impact.walk(e, seed, 3).collect()}
    assert got == {("b", 1, "inherits"), ("c", 2, "calls")}
    assert {(x["id"], x["depth"]) for x in impact.walk(e, seed, 2, reverse=False).collect()} == {("c", 1), ("b", 2)}


def test_whole_walk(spark):
    kinds = {"op": "operation", "h": "function", "c": "function", "T": "type", "T.m": "method", "in": "function", "x": "function", "y": "function", "s": "symbol"}
    n = nodes(spark, [("r", i, k, i, "p") for i, k in kinds.items()])
    e = edges(spark, [("h", "implements", "op"), ("c", "consumes", "op"), ("c", "contains", "in"), ("in", "calls", "x"), ("T", "contains", "T.m"), ("T.m", "calls", "y"), ("x", "references", "T"), ("x", "calls", "s")])
    got = lambda i, d, r: {(x["id"], x["depth"], x["edge"]) for x in impact.whole_walk(e, n, spark.createDataFrame([("r", i)], "repo string, id string"), d, r).collect()}
    assert got("h", 1, True) == {("c", 1, "calls_api")}
    assert got("c", 3, False) == {("op", 1, "consumes"), ("h", 1, "handled_by"), ("x", 1, "calls"), ("T", 2, "references"), ("y", 3, "calls")}
    assert got("x", 1, True) == {("in", 1, "calls"), ("c", 1, "calls")}


def test_closure_survives_circles(spark):
    e = edges(spark, [("a", "contains", "b"), ("b", "contains", "c"), ("c", "contains", "a"), ("x", "contains", "y")])
    seed = spark.createDataFrame([("r", "a")], "repo string, id string")
    assert {r["id"] for r in impact.closure(e, seed).collect()} == {"a", "b", "c"}
    assert {r["id"] for r in impact.closure(e, seed, up=True, max_levels=1).collect()} == {"a", "c"}


def test_shortest_path(spark):
    e = edges(spark, [("a", "calls", "b"), ("b", "calls", "t"), ("a", "imports", "c"), ("c", "calls", "d"), ("d", "calls", "t")])
    key = "repo string, id string"
    got = impact.shortest_paths(e, spark.createDataFrame([("r", "a")], key), spark.createDataFrame([("r", "t"), ("r", "zz")], key)).collect()
    assert [(r["id"], r["hops"], r["path"]) for r in got] == [("t", 2, ["a", "b", "t"])]


def test_long_shortest_paths(spark):
    from graphloom.plans import graph_queries as Q

    chain = [f"n{i:02}" for i in range(13)]
    e = edges(spark, [(a, "calls", b) for a, b in zip(chain, chain[1:], strict=False)])
    key = "repo string, id string"
    seed, targets = spark.createDataFrame([("r", "n00")], key), spark.createDataFrame([("r", "n06"), ("r", "n12")], key)
    assert [(r["id"], r["hops"]) for r in impact.shortest_paths(e, seed, targets).collect()] == [("n06", 6)]
    got = analysis.view_paths(view(spark, list(zip(chain, chain[1:], strict=False))), seed, targets).collect()
    assert {(r["id"], r["hops"]) for r in got} == {("n06", 6), ("n12", 12)} and max(len(r["path"]) for r in got) == 13
    assert {r["hops"] for r in Q.QUERIES["impact_shortest_path"](spark, "/root/testdata/sf0.01").collect()} == {2, 3, 4, 6}


def test_view_resolves_relative_imports(spark):
    e = edges(spark, [("module:src/a.ts", "imports", "import:src/a.ts#./b"), ("module:src/a.ts", "imports", "import:src/a.ts#react"), ("func:src/a.ts#f", "calls", "func:src/c.ts#g")])
    n = nodes(spark, [("r", f"file:{p}", "file", p, p) for p in ("src/a.ts", "src/b.ts", "src/c.ts")])
    got = {(x["a"], x["b"], x["edge_type"]) for x in analysis.dependency_view(e, n).collect()}
    assert got == {("file:src/a.ts", "file:src/b.ts", "imports"), ("file:src/a.ts", "file:src/c.ts", "calls"), ("func:src/a.ts#f", "func:src/c.ts#g", "calls")}


def view(spark, pairs):
    return spark.createDataFrame([("r", a, "r", b, "calls") for a, b in pairs], "a_repo string, a string, b_repo string, b string, edge_type string")


def test_strong_components(spark):
    v = view(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "d"), ("x", "y")])
    got = {(r["u"], r["component"]) for r in analysis.strong_components(v).collect()}
    assert got == {("r|a", "r|a"), ("r|b", "r|a"), ("r|c", "r|a"), ("r|d", "r|d"), ("r|e", "r|d")}
    assert analysis.strong_components(view(spark, [("x", "y")])).count() == 0


def test_pagerank_sums_to_one(spark):
    got = {r["id"]: r["rank"] for r in analysis.pagerank(view(spark, [("a", "b"), ("b", "c"), ("a", "c"), ("c", "d")])).collect()}
    assert sum(got.values()) == pytest.approx(1.0) and got["d"] > got["c"] > got["b"] > got["a"]


def test_betweenness(spark):
    got = {r["u"]: r["score"] for r in analysis.betweenness(view(spark, [("a", "b"), ("b", "c"), ("c", "d"), ("a", "e"), ("e", "c")])).collect()}
    assert {k: v for k, v in got.items() if v} == {"r|b": 1.0, "r|e": 1.0, "r|c": 3.0}


def test_betweenness_of_the_whole_view(spark):
    from graphloom.plans import graph_queries as Q

    v = view(spark, [("a", "b"), ("b", "c"), ("c", "d"), ("a", "e"), ("e", "c")])
    whole, blocks = ({r["u"]: r["score"] for r in analysis.betweenness(v, **b).collect()} for b in ({}, {"block": 2, "local_links": 0}))
    assert whole == blocks
    d = "/root/testdata/sf0.001"
    ends = Q._view(spark, d).where("edge_type = 'calls'").select(F.concat_ws("|", "b_repo", "b").alias("u")).distinct()
    assert ends.join(Q.QUERIES["graph_betweenness"](spark, d), "u", "left_anti").count() == 0


def test_both_ways_agree(spark, monkeypatch):
    import random

    rng = random.Random(7)
    links = [(f"n{rng.randrange(30)}", f"n{rng.randrange(30)}") for _ in range(70)] + [("hub", f"n{i}") for i in range(20)] + [("n3", "hub")]
    v = view(spark, sorted({(a, b) for a, b in links if a != b}))
    one = [sorted(map(tuple, f(v).collect())) for f in (analysis.communities, analysis.strong_components)]
    ranks = {r["id"]: r["rank"] for r in analysis.pagerank(v).collect()}
    monkeypatch.setattr(analysis, "LOCAL_LINKS", 0)
    assert [sorted(map(tuple, f(v).collect())) for f in (analysis.communities, lambda x: analysis.strong_components(x, 0))] == one and one[1]
    assert {r["id"]: r["rank"] for r in analysis.pagerank(v).collect()} == pytest.approx(ranks)


def test_components_of_a_long_chain(spark):
    import numpy as np

    n = 200_000
    u, v = np.append(np.arange(n), 5), np.append(np.arange(1, n + 1), 2)
    assert [x.tolist() for x in analysis.components_locally(u, v)] == [[2, 3, 4, 5], [2] * 4]


def test_file_cycles(spark):
    pairs = [("file:a", "file:b"), ("file:b", "file:a"), ("file:a", "func:x"), ("func:x", "file:b"), ("func:p", "func:q"), ("func:q", "func:p"), ("file:c", "func:r"), ("func:r", "file:d"), ("file:d", "func:s"), ("func:s", "file:c")]
    v = view(spark, pairs)
    got = {(r["u"], r["component"]) for r in analysis.file_cycles(v, analysis.strong_components(v)).collect()}
    assert got == {("r|file:a", "r|file:a"), ("r|file:b", "r|file:a"), ("r|func:p", "r|func:p"), ("r|func:q", "r|func:p")} | {(f"r|{x}", "r|file:c") for x in ("file:c", "file:d", "func:r", "func:s")}


def test_communities(spark):
    v = view(spark, [("a", "b"), ("b", "c"), ("a", "c"), ("x", "y"), ("y", "z"), ("x", "z")])
    labels = {r["id"]: r["label"] for r in analysis.communities(v).collect()}
    assert len({labels[k] for k in "abc"}) == 1 and len({labels[k] for k in "xyz"}) == 1 and labels["a"] != labels["x"]


def test_route_match(spark):
    routes = spark.createDataFrame([("s1", "GET", "/api/v1/users/:id"), ("s1", "POST", "/api/v1/users"), ("s2", "GET", "/orders/{id}/items"), ("s3", "GET", "/carts/{id}/items"), ("s4", "GET", "/carts/<x>/items")], "member string, method string, path string")
    calls = spark.createDataFrame([("c1", "GET", "/users/{}"), ("c2", "GET", "/orders/7/items?x=1"), ("c3", "GET", "/carts/9/items"), ("c4", "DELETE", "/users/1"), ("c5", "ANY", "/v1/users/{}")], "call_id string, method string, path string")
    got = {r["call_id"]: r["member"] for r in contracts.match_routes(calls, routes, min_specific=1).collect()}
    assert got == {"c1": "s1", "c2": "s2", "c5": "s1"}


def test_paths_and_names(spark):
    df = spark.createDataFrame([("/users/:id/[x]/<int:y>?q=1",), ("a//b/",), ("",)], "p string").select(P.http_path(F.col("p")).alias("h"))
    assert [r["h"] for r in df.collect()] == ["/users/{}/{}/{}", "/a/b", "/"]
    df = spark.createDataFrame([("repo://r-1/a%20b.go#func:X.y",), ("nonsense",), (None,)], "u string").select(P.parse_uri(F.col("u")).alias("x"))
    got = [r["x"] for r in df.collect()]
    assert tuple(got[0]) == ("r-1", "a b.go", "func", "X.y") and got[1] is None and got[2] is None
    df = spark.createDataFrame([("Get_User-Name2",)], "n string")
    assert df.select(T.fold_name(F.col("n"))).first()[0] == "getusername2"
    assert df.select(P.build_uri(F.lit("r"), F.lit("a b/c.go"), F.lit("func"), F.lit("x#y"))).first()[0] == "repo://r/a%20b/c.go#func:x%23y"
    assert spark.range(1).select(resolution.fold_dots(F.lit("a/./b/../c")), resolution.fold_dots(F.lit("../x"))).first()[:] == ("a/c", None)


def test_imports_and_callees(spark):
    files = spark.createDataFrame([("r", "src/a.ts"), ("r", "src/lib/index.ts"), ("r", "src/b.js")], "repo string, path string")
    imports = spark.createDataFrame([("r", "src/main.ts", "./a"), ("r", "src/main.ts", "./lib"), ("r", "src/x/y.ts", "../b"), ("r", "src/main.ts", "react"), ("r", "src/main.ts", "./none")], "repo string, path string, spec string")
    assert {(r["spec"], r["target"]) for r in resolution.resolve_imports(imports, files).collect()} == {("./a", "src/a.ts"), ("./lib", "src/lib/index.ts"), ("../b", "src/b.js")}


def test_callee_tiers(spark):
    names = [
        "func:p/a.go#run", "func:p/b.go#run", "func:q/c.go#stop", "func:q/d.go#twin", "func:z/d.go#twin", "method:q/V.java#V.go(int)", "method:q/W.java#V.near(int)", "method:q/X.java#X.near", "func:lib/util/u.go#help", "func:w/x.go#help",
        "func:src/m.ts#boot", "func:other/m.ts#boot", "method:s/S.kt#Store.load", "method:t/T.kt#Tank.load", "func:k/l.go#len", "func:f/f.go#dup", "method:f/f.go#A.dup", "method:f/f.go#B.dup",
    ]
    n = nodes(spark, [("r", i, "method" if i[0] == "m" else "function", i.split("#")[1].split("(")[0].split(".")[-1], i.split(":")[1].split("#")[0]) for i in names] + [("r", "import:y/y.go#corp/lib/util", "import", "corp/lib/util", "y/y.go"), ("r", "import:y/n.ts#../src/m", "import", "../src/m", "y/n.ts")])
    asked = {
        ("func:p/a.go#main", "run"): ("func:p/a.go#run", "1"),
        ("func:p/z.go#main", "run"): None,  # two in the folder
        ("func:z/z.go#main", "stop"): ("func:q/c.go#stop", "4"),
        ("func:z/z.go#main", "twin"): ("func:z/d.go#twin", "2"),
        ("func:m/z.go#main", "twin"): None,
        ("method:v/V.java#V.x(int)", "near"): ("method:q/W.java#V.near(int)", "1b"),
        ("func:y/y.go#main", "help"): ("func:lib/util/u.go#help", "3"),
        ("func:y/y.go#main", "util.help"): ("func:lib/util/u.go#help", "3"),
        ("func:y/y.go#main", "nope.help"): None,
        ("func:y/n.ts#main", "m.boot"): ("func:src/m.ts#boot", "3"),
        ("func:y/y.go#main", "x.Store.load"): ("method:s/S.kt#Store.load", "3b"),
        ("method:s/S.kt#Store.init", "self.load"): ("method:s/S.kt#Store.load", "3b"),
        ("method:s/S.kt#Store.init", "Self::load"): ("method:s/S.kt#Store.load", "3b"),
        ("method:s/S.kt#Store.init", "self.tank.load"): None,
        ("func:y/y.go#main", "len"): None,  # a built-in
        ("func:y/y.go#main", "x.run"): None,
        ("func:f/f.go#main", "dup"): ("func:f/f.go#dup", "1"),  # the only function among three
        ("func:q/c.go#stop", "stop"): None,  # itself
        ("func:y/y.go#main", "unknown"): None,
    }
    calls = spark.createDataFrame([("r", a, b) for a, b in asked] + [(None, "func:a#b", "run"), ("r", None, "run"), ("r", "func:a#b", None)], "repo string, src_id string, callee string")
    got = {(r["src_id"], r["callee"]): (r["id"], r["tier"]) for r in resolution.resolve_callees(calls, n).collect()}
    assert got == {k: v for k, v in asked.items() if v}


def test_doc_links(spark):
    text = "# Top\nsee ` Run ` and `func:a.go#go`\r\n(lib/b.ts) URLStore, API, Store\n`lib/b.ts` adr-12 docs/x.md `nope`\n"
    docs = spark.createDataFrame([("r", "docs/x.md", text), ("r", "docs/e.md", ""), ("r", "docs/n.md", None)], "repo string, path string, text string")
    n = nodes(spark, [("r", "func:a.go#Run", "function", "Run", "a.go"), ("r", "func:a.go#go", "function", "go", "a.go"), ("r", "file:lib/b.ts", "file", "b.ts", "lib/b.ts"), ("r", "type:c.go#URLStore", "type", "URLStore", "c.go"), ("r", "type:c.go#Store", "type", "Store", "c.go"), ("r", "file:docs/adr/12.md", "file", "12.md", "docs/adr/12.md"), ("r", "file:docs/x.md", "file", "x.md", "docs/x.md"), ("s", "func:a.go#nope", "function", "nope", "a.go")])
    got = {(r["path"], r["id"], r["line"]) for r in resolution.link_docs(resolution.doc_mentions(docs), n).collect()}
    assert got == {("docs/x.md", "func:a.go#Run", 2), ("docs/x.md", "func:a.go#go", 2), ("docs/x.md", "file:lib/b.ts", 3), ("docs/x.md", "type:c.go#URLStore", 3), ("docs/x.md", "file:docs/adr/12.md", 4)}


def test_span_resolution(spark):
    n = nodes(
        spark,
        [("r", "func:a/x.go#Run", "function", "Run", "a/x.go"), ("r", "func:b/a/x.go#Run", "function", "Run", "b/a/x.go"), ("r", "method:c.kt#Repo.save", "method", "save", "c.kt"), ("r", "type:d.go#Load", "type", "Load", "d.go"), ("r", "func:d.go#Load", "function", "Load", "d.go"), ("r", "file:e/f.py", "file", "f.py", "e/f.py"), ("r", "type:g.go#Two", "type", "Two", "g.go"), ("r", "type:h.go#Two", "type", "Two", "h.go")],
    )
    asked = [
        ("1", "x", {"code.function": "Run", "code.filepath": "/srv/b/a/x.go"}, "func:b/a/x.go#Run"),  # the longer path
        ("2", "x", {"code.function": "Run"}, None),
        ("3", "Repo.save", None, "method:c.kt#Repo.save"),
        ("4", "save", {}, "method:c.kt#Repo.save"),
        ("5", "Load", None, "func:d.go#Load"),  # functions before types
        ("6", "e/f.py", None, "file:e/f.py"),
        ("7", "func:d.go#Load", None, "func:d.go#Load"),
        ("8", "Two", None, None),
        ("9", "x", {"rpc.method": "save"}, "method:c.kt#Repo.save"),
        ("10", None, None, None),
    ]
    rows = [("t", i, None, name, "r", None, a, None, None) for i, name, a, _ in asked] + [("t", "1", None, "x", None, None, None, None, None)]
    spans = spark.createDataFrame(rows, "trace_file string, span_id string, parent_span_id string, name string, service string, parent string, attributes map<string,string>, started_at timestamp_ntz, received_at timestamp_ntz")
    got = {r["span_id"]: r["id"] for r in tracing.resolve_spans(spans, n).collect()}
    assert got == {i: want for i, _, _, want in asked if want}


def test_route_match_keys(spark):
    from graphloom.functions.text import verb_hint

    routes = spark.createDataFrame([("a", "GET", "/users/:id/orders"), ("b", "POST", "/users/{x}"), ("b", "ANY", "/v1/items/<n>"), ("c", "GET", "/api/{}"), ("d", "GET", "/users/{y}/orders")], "member string, method string, path string")
    calls = spark.createDataFrame([("1", "get", "/users/7/orders"), ("2", "POST", "/users/{}?q=1"), ("3", "DELETE", "/items/3"), ("4", "GET", "/api/x"), ("5", "ANY", "")], "call_id string, method string, path string")
    assert {tuple(r) for r in contracts.match_routes(calls, routes, 1).collect()} == {("2", "b", "/users/{}"), ("3", "b", "/v1/items/{}")}
    assert {tuple(r) for r in contracts.match_routes(calls.withColumn("within", F.lit("a")), routes, 1).collect()} == {("1", "a", "/users/{}/orders")}
    names = spark.createDataFrame([("apiGet", "GET"), ("http.getJson", "GET"), ("_post", "POST"), ("apiget", "GET"), ("deletePost", "DELETE"), ("fetch", "ANY"), ("head", "ANY")], "n string, want string")
    assert all(r[0] == r[1] for r in names.select(verb_hint(F.col("n")), "want").collect())


def test_co_changes(spark):
    import datetime as dt

    rows = [("r", h, dt.datetime(2025, 12, 31) - dt.timedelta(days=90 * k), p) for k, (h, p) in enumerate([("1", ["a", "b", None, "b"]), ("2", ["b", "a"]), ("3", ["a", "c"]), ("4", ["a"])])]
    files = history.commit_files(spark.createDataFrame(rows, "repo string, commit_hash string, committed_at timestamp_ntz, paths array<string>"))
    got = history.co_changes(files, "2025-12-31 00:00:00").collect()
    assert [(r["a"], r["b"], r["support"], r["weight"], r["last_hash"]) for r in got] == [("a", "b", 2, 1.5, "1")]


def test_bind_operation_ids(spark):
    ops = spark.createDataFrame([("api", "op1", "getUser")], "repo string, id string, operation_id string")
    fns = spark.createDataFrame([("api", "f1", "GetUser"), ("web", "f2", "get_user"), ("web", "f3", "other")], "repo string, id string, name string")
    assert {(r["id"], r["edge_type"]) for r in contracts.bind_operation_ids(ops, fns).collect()} == {("f1", "implements"), ("f2", "consumes")}


def test_consumers_of_all_members(spark):
    from graphloom.plans import graph_queries as Q

    calls = spark.createDataFrame([("b", "a"), ("c", "b"), ("d", "c"), ("c", "a"), ("a", "b")], "from_repo string, to_repo string")
    members = calls.select(F.col("to_repo").alias("member"))
    got = {tuple(r) for r in contracts.service_consumers(calls, members, 2).collect()}
    assert got == {("a", "b", 1, "a"), ("a", "c", 1, "a"), ("a", "d", 2, "c"), ("b", "a", 1, "b"), ("b", "c", 1, "b"), ("b", "d", 2, "c"), ("c", "d", 1, "c")}
    d = "/root/testdata/sf0.01"
    got = Q.QUERIES["join_service_consumers"](spark, d)
    assert got.select("member").distinct().count() == contracts.service_calls(Q._overlay(spark, d)).select("to_repo").distinct().count() > 1


def test_scan_changes(spark):
    old = spark.createDataFrame([("r", "a", "1"), ("r", "b", "1"), ("r", "c", "1")], "repo string, path string, sha256 string")
    new = spark.createDataFrame([("r", "a", "1"), ("r", "b", "2"), ("r", "d", "1")], "repo string, path string, sha256 string")
    assert {(r["path"], r["action"]) for r in resolution.scan_changes(old, new).collect()} == {("a", "skip"), ("b", "replace"), ("c", "delete"), ("d", "add")}


def test_explained_walk(spark):
    e = edges(spark, [("func:a#f", "calls", "func:b#g"), ("func:b#g", "co_committed", "func:c#h")])
    n = nodes(spark, [("r", i, "function", i, "p") for i in ("func:a#f", "func:b#g", "func:c#h")])
    hits = {h["id"]: h for h in ranking.neighborhood(e, n, n.where("id = 'func:a#f'"), explain=True).collect()}
    assert [(x["family"], x["edge_type"], x["dir"], x["weight"]) for x in hits["func:c#h"]["walk"]] == [("static", "calls", "out", 0.8), ("git", "co_committed", "out", 0.7)]
    assert hits["func:a#f"]["walk"] == []


def test_uris_and_services(spark):
    n = nodes(spark, [("r", "func:a/b c.go#f", "function", "f", "a"), ("r", "file:a.go", "file", "a", "a"), ("r", "module:a.go", "module", "a", "a"), ("r", "symbol:x.y", "symbol", "x.y", ""), ("r", "operation:GET /a/{}", "operation", "o", "")])
    got = {r["id"]: r["uri"] for r in graph.with_uris(n).collect()}
    assert got["func:a/b c.go#f"] == "repo://r/a/b%20c.go#func:f" and got["file:a.go"] == "repo://r/a.go#file" and got["module:a.go"] == "repo://r/a.go#module:a.go" and got["symbol:x.y"] == "repo://r/symbols#symbol:x.y"
    m = spark.createDataFrame([("a", ["X"]), ("b", [])], "member string, base_env array<string>")
    assert [r["id"] for r in contracts.service_nodes(m).collect()] == ["service:a"]
    assert spark.range(1).select(P.relative_id(F.lit("func:/x/y/a.go#f"), "/x/y")).first()[0] == "func:a.go#f"


def test_row_numbers(spark):
    from graphloom.plans.iterate import row_numbers

    df = spark.range(5000).selectExpr("id", "id % 7 as k").repartition(6)
    got = row_numbers(df, "n", F.desc("k"), F.col("id")).collect()
    assert [(r["k"], r["id"]) for r in sorted(got, key=lambda r: r["n"])] == sorted(((i % 7, i) for i in range(5000)), key=lambda x: (-x[0], x[1])) and sorted(r["n"] for r in got) == list(range(1, 5001))
    assert row_numbers(df.limit(0), "n", F.col("id")).count() == 0


def test_lines_families_and_members(spark):
    from graphloom.operators import lookup

    n = spark.createDataFrame([("r", "func:p#a", "function", "a", "p", 1, 20, ""), ("r", "func:p#b", "function", "b", "p", 5, 9, ""), ("r", "func:p#c", "method", "c", "p", 5, 9, ""), ("s", "func:p#a", "function", "a", "p", 0, 0, "")], NODE)
    places = spark.createDataFrame([("r", "p", 7), ("r", "p", 15), ("r", "p", 30), ("s", "p", 1), ("r", None, 1)], "repo string, path string, line int")
    assert {(r["line"], r["id"]) for r in lookup.line_owners(n, places).collect()} == {(7, "func:p#b"), (15, "func:p#a")}
    old, new = edges(spark, [("a", "x", "b"), ("b", "x", "c"), ("a", "calls", "b")]), edges(spark, [("a", "x", "b"), ("c", "x", "d")])
    assert {(r["src_id"], r["action"]) for r in graph.edge_changes(old.where("edge_type = 'x'"), new).collect()} == {("b", "delete"), ("c", "upsert")}
    assert {(r["src_id"], r["edge_type"]) for r in graph.replace_family(old, ("x",), new).collect()} == {("a", "calls"), ("a", "x"), ("c", "x")}
    assert {tuple(r) for r in graph.owners(n, n).collect()} == {("func:p#a", None, 2), ("func:p#b", "r", 1), ("func:p#c", "r", 1)}
    assert [r[0] for r in graph.missing_members(spark.createDataFrame([("r",), ("gone",), (None,)], "member string"), n).collect()] == ["gone"]


def test_owner_up_the_chain(spark):
    n = nodes(spark, [("r", "x1", "thing", "x", ""), ("r", "x2", "thing", "x", ""), ("r", "x3", "thing", "x", ""), ("r", "c1", "thing", "x", ""), ("r", "c2", "thing", "x", ""), ("r", "func:a.go#f", "function", "f", "")])
    e = edges(spark, [("x2", "contains", "x1"), ("x3", "contains", "x2"), ("file:z.go", "contains", "x3"), ("file:b.go", "contains", "x3"), ("c1", "contains", "c2"), ("c2", "contains", "c1")])
    assert {(r["id"], r["owner"]) for r in resolution.file_owner(n, e).collect()} == {("x1", "b.go"), ("x2", "b.go"), ("x3", "b.go"), ("c1", None), ("c2", None), ("func:a.go#f", "a.go")}


def test_import_targets(spark):
    rows = [("a/b.ts", "lodash/fp", "lodash"), ("a/b.ts", "@org/pkg/x", "@org/pkg"), ("a/b.js", "./c", "a/c"), ("a/b.go", "net/http", "net/http"), ("a/b.py", "os.path", "os.path"), ("a/b.py", "'x'", "x"), ("a/b.js", "/abs/x", "/abs/x")]
    df = spark.createDataFrame(rows, "p string, s string, want string")
    assert all(r[0] == r[1] for r in df.select(analysis.import_target(F.col("p"), F.col("s")), "want").collect())
