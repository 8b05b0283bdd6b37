import json
import subprocess
import textwrap

import pytest
from pyspark.sql import functions as F

from graphloom.sources import documents, extract, files, report, snapshot, store, workspace
from graphloom.streaming import ingest

DOC = "repo string, path string, text string"


def test_ignore_rules():
    rules = {"": ["*.log", "!keep.log", "/out/", "docs/*.md", "# note"], "sub": ["x.go"]}
    hit = {p for p in ("a.log", "keep.log", "out/a.go", "b/out/a.go", "docs/a.md", "b/docs/a.md", "sub/x.go", "x.go") if files.is_ignored(rules, p)}
    assert hit == {"a.log", "out/a.go", "docs/a.md", "sub/x.go"}


def test_scan_tree(spark, tmp_path):
    for name in ("a.go", "sub/b.py", "node_modules/c.js", "sub/d.log", "sub/e.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(name)
    got = files.scan_tree(spark, str(tmp_path), ignore_rules={"": ["*.log"]})
    assert {r["path"] for r in got.collect()} == {"a.go", "sub/b.py", "sub/e.txt"}
    assert {r["path"] for r in files.source_files(got).collect()} == {"a.go", "sub/b.py"}
    assert all(len(r["sha256"]) == 64 for r in files.fingerprints(got).collect())


def test_sniffers(spark):
    rows = [('openapi: 3.1.0\n',), ('{"openapi": "3.0.1"}',), ('openapi: 2.0\n',), ('type Query {\n a: Int\n}',), ('syntax = "proto3";',), (None,)]
    df = spark.createDataFrame(rows, "t string")
    got = [tuple(r) for r in df.select(*[files.looks_like(k, F.col("t")) for k in ("openapi", "graphql", "proto")]).collect()]
    assert got == [(True, False, False), (True, False, False), (False, False, False), (False, True, False), (False, False, True), (False, False, False)]


def test_sniffers_read_whole_texts(spark):
    head = "# licence\n" * 900
    rows = [(head + "openapi: 3.1.0\n",), ('{"openapi": "3.0.1"}',), ("\ufeffopenapi: 3.0.0",), (head + "type Query {",), (head + 'syntax = "proto3";',), (None,)]
    df = spark.createDataFrame(rows, "t string")
    got = [tuple(r) for r in df.select(*[files.is_contract(k, F.col("t")) for k in ("openapi", "graphql", "proto")]).collect()]
    assert got == [(True, False, False)] * 3 + [(False, True, False), (False, False, True), (False, False, False)]


def test_markdown(spark):
    text = "# A\n\n```\n# no\n```\n## B ##\n# A\ntext # x\n"
    got = documents.markdown_headings(spark.createDataFrame([("r", "p.md", text)], DOC)).orderBy("line").collect()
    assert [(r["line"], r["level"], r["id"]) for r in got] == [(1, 1, "heading:p.md#A"), (6, 2, "heading:p.md#B"), (7, 1, "heading:p.md#A~2")]


def test_spans(spark):
    simple = json.dumps({"spans": [{"spanId": "a", "name": "x", "attributes": {"k": "v"}}, {"span_id": "b", "parent_span_id": "a", "name": "y", "service": "s"}]})
    otlp = json.dumps({"resourceSpans": [{"resource": {"attributes": [{"key": "service.name", "value": {"stringValue": "svc"}}]}, "scopeSpans": [{"spans": [{"spanId": "c", "parentSpanId": "", "name": "z", "attributes": [{"key": "n", "value": {"intValue": "3"}}]}]}]}]})
    got = {r["span_id"]: r for r in documents.parse_spans(spark.createDataFrame([(1, simple), (2, otlp), (3, "nope"), (4, None)], "doc_id long, text string")).collect()}
    assert set(got) == {"a", "b", "c"} and got["b"]["parent_span_id"] == "a" and got["a"]["attributes"] == {"k": "v"}
    assert got["c"]["service"] == "svc" and got["c"]["attributes"] == {"n": "3"} and got["c"]["parent_span_id"] is None


def test_contracts(spark):
    api = "openapi: 3.0.0\npaths:\n  /a/{id}:\n    get:\n      operationId: getA\n    post: {}\n"
    got = documents.openapi_operations(spark.createDataFrame([("r", "a.yaml", api), ("r", "b.yaml", "::"), ("r", "c.yaml", None)], DOC)).collect()
    assert {(r["op_path"], r["method"], r["operation_id"]) for r in got} == {("/a/{id}", "GET", "getA"), ("/a/{id}", "POST", None)}
    sdl = '"""doc { """\ntype Query {\n  user(id: ID!): User # c\n  all: [User]\n}\nextend type User { name: String }\n'
    got = documents.graphql_fields(spark.createDataFrame([("r", "a.graphql", sdl)], DOC)).collect()
    assert {(r["type_name"], r["field"], r["role"]) for r in got} == {("Query", "user", "operation"), ("Query", "all", "operation"), ("User", "name", "field")}
    api = "openapi: 3.0.0\ncomponents:\n  schemas:\n    A: {}\n    B: {type: object}\n"
    assert [r["schema"] for r in documents.openapi_schemas(spark.createDataFrame([("r", "a.yaml", api), ("r", "b", "x: 1"), ("r", "c", None)], DOC)).collect()] == ["A", "B"]
    proto = """syntax = "proto3";
    package a.b; // x
    import "y.proto";
    service S { rpc Get (Req) returns (stream Res) {} rpc Put (Req) returns (Res); }
    message Req {
      string name = 1 [deprecated = true]; /* int32 no = 9; */
      repeated int64 ids = 2;
      map<string, Inner> m = 3;
      message Inner { bool ok = 1; }
      enum Kind { NONE = 0; }
      oneof pick { string s = 4; a.b.Req r = 5; }
      reserved 6, 7;
    }"""
    got = documents.proto_items(spark.createDataFrame([("r", "a.proto", proto), ("r", "b", None), ("r", "c", "message Cut { string x = 1; int32"), ("r", "d", "}}} = ; message")], DOC)).collect()
    assert {(r["kind"], r["owner"], r["name"], r["type"], r["number"]) for r in got if r["path"] == "a.proto"} == {
        ("service", "", "S", "", None), ("rpc", "S", "Get", "/a.b.S/Get", None), ("rpc", "S", "Put", "/a.b.S/Put", None), ("message", "", "Req", "", None), ("field", "Req", "name", "string", 1),
        ("field", "Req", "ids", "repeated int64", 2), ("field", "Req", "m", "map<string,Inner>", 3), ("message", "Req", "Req.Inner", "", None), ("field", "Req.Inner", "ok", "bool", 1),
        ("enum", "Req", "Req.Kind", "", None), ("field", "Req", "s", "string", 4), ("field", "Req", "r", "a.b.Req", 5),
    }
    assert {(r["path"], r["name"]) for r in got if r["path"] != "a.proto"} == {("c", "Cut"), ("c", "x")}


def test_python_extractor():
    code = textwrap.dedent(
        """
        import os
        from .x import y
        class A(Base):
            def m(self):
                self.go()
        def f():
            def g():
                return os.path.join()
            g()
        """
    )
    nodes, edges = extract.extract("p/a.py", code)
    ids = {n[0] for n in nodes}
    assert {"file:p/a.py", "module:p/a.py", "import:p/a.py#os", "import:p/a.py#.x", "type:p/a.py#A", "method:p/a.py#A.m", "func:p/a.py#f", "func:p/a.py#g"} == ids
    assert {("type:p/a.py#A", "symbol:Base", "inherits"), ("method:p/a.py#A.m", "symbol:self.go", "calls"), ("func:p/a.py#f", "func:p/a.py#g", "contains"), ("func:p/a.py#g", "symbol:os.path.join", "calls"), ("func:p/a.py#f", "symbol:g", "calls")} <= set(edges)
    assert extract.extract("a.py", "def broken(:")[0] and extract.extract("a.unknown", "x") == ([], [])


LANGUAGES = {
    "p/a.go": (
        'package main\n\nimport (\n\t"fmt"\n\tx "corp/lib"\n)\n\ntype (\n\tID int\n\tBox struct {\n\t\tn int\n\t}\n)\n\nfunc (b *Box) Size() int {\n\tif b.n > 0 {\n\t\treturn x.Len(b.n)\n\t}\n\treturn len("}")\n}\n\nfunc run() {\n\tgo func() { work() }()\n\tfmt.Println(`{`) // no()\n}\n',
        {"import:p/a.go#fmt 4-4", "import:p/a.go#corp/lib 5-5", "package:p/a.go#main 1-1", "type:p/a.go#ID 9-9", "type:p/a.go#Box 10-12", "method:p/a.go#Box.Size 15-20", "func:p/a.go#run 22-25"},
        {"method:p/a.go#Box.Size calls x.Len", "method:p/a.go#Box.Size calls len", "func:p/a.go#run calls work", "func:p/a.go#run calls fmt.Println"},
    ),
    "p/a.ts": (
        "import { x,\n  y } from './x'\nconst z = require('zed')\nexport type Pair = {\n  a: number\n}\nexport interface Shape { area(): number }\nexport async function load<T>(u: string): Promise<T> {\n  const r = /[}{]/.test(u)\n  return x.y(`${u}`)\n}\nexport const half = (n: number) => div(n, 2)\nconst twice = async n => {\n  await n.go()\n}\nclass Store extends Base {\n  constructor(private db: Db) { super(); this.open() }\n  get size(): number { return count(this) }\n  find = (id: string) => {\n    return this.db.get(id)\n  }\n}\n",
        {"import:p/a.ts#./x 1-1", "import:p/a.ts#zed 3-3", "type:p/a.ts#Pair 4-6", "type:p/a.ts#Shape 7-7", "func:p/a.ts#load 8-11", "func:p/a.ts#half 12-12", "func:p/a.ts#twice 13-15", "type:p/a.ts#Store 16-22", "method:p/a.ts#Store.constructor 17-17", "method:p/a.ts#Store.size 18-18", "method:p/a.ts#Store.find 19-21"},
        {"func:p/a.ts#load calls x.y", "func:p/a.ts#load calls _.test", "func:p/a.ts#half calls div", "func:p/a.ts#twice calls n.go", "method:p/a.ts#Store.constructor calls this.open", "method:p/a.ts#Store.size calls count", "method:p/a.ts#Store.find calls this.db.get"},
    ),
    "p/A.java": (
        "package p.q;\nimport static a.b.C.d;\n@Anno(x = {1})\npublic final class A<T> {\n  private int n = f(1);\n  public A(int n) { this.n = n; }\n  @Override\n  public <U> List<U> map(final Map<String, U> m, int... k)\n  {\n    for (U u : m.values()) { log.info(u); }\n    return new ArrayList<U>(n);\n  }\n  interface In { void go(String s); }\n  enum E { X, Y }\n}\n",
        {"package:p/A.java#p.q 1-1", "import:p/A.java#a.b.C.d 2-2", "type:p/A.java#A 4-15", "method:p/A.java#A.A(int) 6-6", "method:p/A.java#A.map(Map<String,U>,int...) 8-12", "type:p/A.java#In 13-13", "method:p/A.java#In.go(String) 13-13", "type:p/A.java#E 14-14"},
        {"method:p/A.java#A.map(Map<String,U>,int...) calls m.values", "method:p/A.java#A.map(Map<String,U>,int...) calls log.info", "method:p/A.java#A.map(Map<String,U>,int...) calls ArrayList"},
    ),
    "p/a.kt": (
        "package p\nimport a.b.C\nobject One {\n  fun two(x: Int): Int = three(x)\n}\ndata class D(val n: Int) {\n  constructor(s: String) : this(s.length)\n  companion object { fun of() = D(1) }\n}\nfun <T> List<T>.ext(f: (T) -> Unit) {\n  forEach { f(it) }\n}\n",
        {"package:p/a.kt#p 1-1", "import:p/a.kt#a.b.C 2-2", "type:p/a.kt#One 3-5", "method:p/a.kt#One.two(Int) 4-4", "type:p/a.kt#D 6-9", "method:p/a.kt#D.constructor(String) 7-7", "func:p/a.kt#ext((T)->Unit) 10-12"},
        {"method:p/a.kt#One.two(Int) calls three", "func:p/a.kt#ext((T)->Unit) calls f"},
    ),
    "p/a.cs": ("using System.Text;\nnamespace N.M;\n[Serializable]\npublic record R(int A);\nclass B : Base {\n  [Test(1)] public async Task<int> Go(List<string> a, int b = 2) => await c.D(a);\n  int P { get { return q(); } }\n  void X() { if (y()) { using (var z = Open()) { } } }\n}\n", {"import:p/a.cs#System.Text 1-1", "package:p/a.cs#N.M 2-2", "type:p/a.cs#B 5-9", "method:p/a.cs#B.Go(List<string>,int) 6-6", "method:p/a.cs#B.X() 8-8"}, {"method:p/a.cs#B.X() calls y", "method:p/a.cs#B.X() calls Open", "method:p/a.cs#B.Go(List<string>,int) calls c.D"}),
    "p/a.swift": ("import UIKit\nextension View {\n  @objc func show(_ a: Int) -> Bool {\n    return model.load(a)\n  }\n}\nprotocol P { func need(x: Int) }\nstruct S {\n  init(n: Int) { self.n = n }\n}\n", {"import:p/a.swift#UIKit 1-1", "type:p/a.swift#View 2-6", "method:p/a.swift#View.show 3-5", "type:p/a.swift#P 7-7", "method:p/a.swift#P.need 7-7", "type:p/a.swift#S 8-10", "method:p/a.swift#S.init 9-9"}, {"method:p/a.swift#View.show calls model.load"}),
    "p/a.php": ("<?php\nnamespace A\\B;\nuse C\\D as E;\nabstract class F extends G {\n  abstract protected function h(int $a): string;\n  public static function i() { return self::j($k['(']); }\n}\nfunction l() { # m()\n  n();\n}\n", {"package:p/a.php#A\\B 2-2", "import:p/a.php#C\\D 3-3", "type:p/a.php#F 4-7", "method:p/a.php#F.h 5-5", "method:p/a.php#F.i 6-6", "func:p/a.php#l 8-10"}, {"func:p/a.php#l calls n", "method:p/a.php#F.i calls self.j"}),
    "p/a.cpp": ('#include <vector>\n#define X(a) { a(\nnamespace n {\ntemplate <class T> class V {\n public:\n  explicit V(int k) : k_(k) { init(); }\n  int get() const;\n};\nint V::get() const { return at(k_); }\n}\nstatic int g(const char *s, struct Q q) {\n  return p->f(s);\n}\nint later(void);\n', {"import:p/a.cpp#vector 1-1", "package:p/a.cpp#n 3-10", "type:p/a.cpp#V 4-8", "method:p/a.cpp#V.V 6-6", "method:p/a.cpp#V.get 9-9", "func:p/a.cpp#g 11-13"}, {"method:p/a.cpp#V.V calls init", "method:p/a.cpp#V.get calls at", "func:p/a.cpp#g calls p.f"}),
    "p/a.rb": ("require 'json'\nmodule M\n  class C < B\n    def self.make(x)\n      items.each do |i|\n        log i if i.ok?\n      end\n      new(x)\n    end\n    def short = go(1)\n  end\nend\ndef top\n  a.b(1) # c(2)\nend\n", {"import:p/a.rb#json 1-1", "type:p/a.rb#M 2-12", "type:p/a.rb#C 3-11", "method:p/a.rb#C.make 4-9", "method:p/a.rb#C.short 10-10", "func:p/a.rb#top 13-15"}, {"func:p/a.rb#top calls a.b", "method:p/a.rb#C.make calls new"}),
}


@pytest.mark.parametrize("path", LANGUAGES)
def test_languages(path):
    text, want, calls = LANGUAGES[path]
    nodes, edges = extract.extract(path, text)
    got = {f"{n[0]} {n[3]}-{n[4]}" for n in nodes if n[1] not in ("file", "module")}
    missing, more = want - got, {x for x in got - want if not x.startswith("type:p/a.kt#Companion") and "Companion" not in x and not x.startswith("type:p/a.cs#R")}
    assert not missing and not more, (missing, more)
    said = {f"{a} {t} {b.removeprefix('symbol:')}" for a, b, t in edges if t == "calls"}
    assert calls <= said, calls - said
    for k in range(len(text)):  # cut anywhere, it ends
        extract.extract(path, text[:k])


def test_parse_files(spark):
    df = spark.createDataFrame([("r", "a.py", "def f():\n  g()\n"), ("r", "b.txt", "x"), ("r", "c.py", None), ("r", None, "x")], DOC)
    got = extract.parse_files(df).collect()
    assert [r["path"] for r in got] == ["a.py"] and any(e["dst"] == "symbol:g" for e in got[0]["edges"])


def test_a_registered_extractor_reaches_the_workers(spark):
    mine = lambda path, text: ([(f"file:{path}", "file", text, 1, 1)], [])
    extract.register("zz")(mine)
    try:
        got = extract.parse_files(spark.createDataFrame([("r", "a.zz", "hello")], DOC)).collect()
        assert [n["name"] for n in got[0]["nodes"]] == ["hello"]
    finally:
        del extract.REGISTRY["zz"]


def test_span_counts_in_batches(spark, tmp_path):
    import datetime as dt

    row = lambda i, h, s="a": (f"t{i}", f"s{i}", s, dt.datetime(2025, 1, 1, h, 5))
    schema = "trace_file string, span_id string, service string, started_at timestamp_ntz"
    inbox, out = str(tmp_path / "in"), str(tmp_path / "out")
    for k, rows in enumerate(([row(1, 1), row(2, 1), row(2, 1)], [row(3, 1), row(1, 1), row(4, 2, None)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(inbox)
        stream = ingest.new_spans(spark.readStream.schema(schema).parquet(inbox)).writeStream.option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True)
        stream.foreachBatch(ingest.counts_on_arrival(out)).start().awaitTermination()
    got = {(r["service"], r["window"]["start"].hour, r["spans"]) for r in ingest.kept_counts(spark.read.parquet(out)).collect()}
    assert got == {("a", 1, 3), (None, 2, 1)}


NODE = "repo string, id string, kind string, name string, path string, props map<string,string>"
EDGE = "src_repo string, src_id string, dst_repo string, dst_id string, edge_type string, props map<string,string>"


def graph(spark):
    n = [("r", "a", "function", "a", "p", {"repo_uri": "repo://r/p#func:a"}), ("r", "b", "function", "b", "q", {}), ("r", "symbol:s", "symbol", "s", "", {})]
    e = [("r", "a", "r", "b", "calls", {"line": "1"}), ("r", "b", "r", "symbol:s", "calls", {}), ("r", "b", "r", "a", "calls", {})]
    return spark.createDataFrame(n, NODE), spark.createDataFrame(e, EDGE)


def test_snapshot_round_trip(spark, tmp_path):
    nodes, edges = graph(spark)
    path = str(tmp_path / "snap")
    snapshot.export_snapshot(nodes, edges, path, "r")
    n, e = snapshot.import_snapshot(spark, path)
    key = lambda df: sorted(map(str, df.collect()))
    assert key(n.select(*nodes.columns)) == key(nodes) and key(e.select(*edges.columns)) == key(edges)
    n, _ = snapshot.import_snapshot(spark, path, repo="new")
    assert n.where("id = 'a'").first()["props"]["repo_uri"] == "repo://new/p#func:a"
    spark.createDataFrame([("{}",)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/0-header")
    with pytest.raises(ValueError):
        snapshot.import_snapshot(spark, path)


def test_only_touched_members_are_written(spark, tmp_path):
    from graphloom.plans.versions import Versions

    n = [(m, f"{m}{i}", "function", "f", f"p{i}", {}) for m in "abcdefgh" for i in range(3)]
    e = [(m, f"{m}0", m, f"{m}1", "calls", {}) for m in "abcdefgh"] + [("b", "b0", "a", "a1", "calls", {}), ("c", "c0", "a", "a2", "calls", {})]
    root = str(tmp_path / "store")
    store.write_graph(spark.createDataFrame(n, NODE), spark.createDataFrame(e, EDGE), root)
    v = Versions(spark, root, {}, {})
    first = v.manifest()
    store.replace_in_store(spark, root, spark.createDataFrame([("a", "p1")], "repo string, path string"), spark.createDataFrame([("a", "new", "function", "f", "p1", {})], NODE), spark.createDataFrame([("a", "new", "b", "b2", "calls", {})], EDGE))
    second, (nodes, edges) = v.manifest(), store.read_graph(spark, root)
    changed = {t: sum(first["tables"][t]["parts"].get(b) != f for b, f in second["tables"][t]["parts"].items()) for t in ("nodes", "edges")}
    assert changed["nodes"] == 1 and 1 <= changed["edges"] <= 2
    assert {r["id"] for r in nodes.collect()} == {x[1] for x in n if x[1] != "a1"} | {"new"}
    assert {(r["src_id"], r["dst_id"]) for r in edges.collect()} == {(x[1], x[3]) for x in e if x[3] != "a1"} | {("new", "b2")}


def test_store(spark, tmp_path):
    nodes, edges = graph(spark)
    root = str(tmp_path / "store")
    store.write_graph(nodes, edges, root)
    n, e = store.read_graph(spark, root)
    assert n.count() == 3 and e.count() == 3
    n, e = store.delete_nodes(nodes, edges, nodes.where("id = 'a'"))
    assert {r["id"] for r in n.collect()} == {"b", "symbol:s"} and e.count() == 1
    assert {r["id"] for r in store.prune_placeholders(nodes, edges.where("dst_id <> 'symbol:s'")).collect()} == {"a", "b"}
    new = spark.createDataFrame([("r", "a", "function", "A2", "p", {})], NODE)
    got = store.upsert(nodes, new, ["repo", "id"])
    assert {(r["id"], r["name"]) for r in got.collect()} == {("a", "A2"), ("b", "b"), ("symbol:s", "s")}
    n, e = store.replace_files(nodes, edges, spark.createDataFrame([("r", "p")], "repo string, path string"), spark.createDataFrame([("r", "a2", "function", "a2", "p", {})], NODE), spark.createDataFrame([("r", "a2", "r", "b", "calls", {})], EDGE))
    assert {r["id"] for r in n.collect()} == {"a2", "b", "symbol:s"}
    assert {(r["src_id"], r["dst_id"]) for r in e.collect()} == {("a2", "b"), ("b", "symbol:s")}


def test_stream_replaces_files(spark, tmp_path):
    nodes, edges = graph(spark)
    root, inbox = str(tmp_path / "store"), str(tmp_path / "in")
    store.write_graph(nodes, edges, root)
    spark.createDataFrame([("r", "p", "new text")], DOC).write.parquet(inbox)

    def parse(batch):
        n = batch.select("repo", F.lit("a3").alias("id"), F.lit("function").alias("kind"), F.lit("a3").alias("name"), "path", F.create_map().cast("map<string,string>").alias("props"))
        return n, spark.createDataFrame([], EDGE)

    run = spark.readStream.schema(DOC).parquet(inbox).writeStream.option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).foreachBatch(ingest.replace_on_arrival(root, parse)).start()
    run.awaitTermination()
    assert {r["id"] for r in store.read_graph(spark, root)[0].collect()} == {"a3", "b", "symbol:s"}


def test_report():
    data = {"Hubs": [{"id": "a|b", "degree": 3}], "None": []}
    assert "| a\\|b | 3 |" in report.as_markdown(data, "T")
    page = report.as_html({"x": [{"a": "</script><b>"}]}, "T", report.run_id())
    assert "</script><b>" not in page.split("<script", 1)[1].rsplit("</script>", 1)[0]
    assert json.loads(report.as_json(data, "r"))["version"] == 1


def test_workspace_and_git(spark, tmp_path):
    repo = tmp_path / "m"
    repo.mkdir()
    git = lambda *a: subprocess.run(["git", "-C", str(repo), "-c", "user.name=x", "-c", "user.email=x@y", *a], check=True, capture_output=True)
    git("init", "-q")
    for k in range(2):
        (repo / f"f{k}").write_text("x")
        (repo / "g").write_text(str(k))
        git("add", "-A")
        git("commit", "-qm", f"c{k}")
    (tmp_path / "ws.yaml").write_text("version: 1\nrepos:\n  - {name: m, path: m}\n")
    members = workspace.load_workspace(str(tmp_path / "ws.yaml"))
    got = workspace.commits_table(spark, [{"name": "m", "path": str(repo)}]).collect()
    assert members[0]["name"] == "m" and sorted(r["paths"] for r in got) == [["f0", "g"], ["f1", "g"]]
    (tmp_path / "bad.yaml").write_text("version: 1\nrepos:\n  - {name: m, path: nowhere}\n")
    with pytest.raises(ValueError):
        workspace.load_workspace(str(tmp_path / "bad.yaml"))


def test_doc_comments_and_signatures():
    assert extract.doc_comments("a.go", "package a\n\n// Run runs.\n// Twice.\nfunc Run() {}\n\nfunc Bare() {}\n") == {"func:a.go#Run": "Run runs.\nTwice."}
    assert extract.doc_comments("A.java", "class A {\n/**\n * Gets it.\n */\n@Override\npublic int get(int x) {\n}\n}\n") == {"method:A.java#A.get(int)": "Gets it."}
    assert extract.doc_comments("a.py", "# above\ndef f():\n    '''inside'''\n") == {"func:a.py#f": "inside"}
    assert extract.param_signature("final int a, Map<String, List<X>> b, @A(\"x\") String... c") == "(int,Map<String,List<X>>,String...)"
    assert extract.param_signature("a: Int = 3, vararg b: List<String>") == "(Int,List<String>)" and extract.param_signature("") == "()"
