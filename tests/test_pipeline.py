import json

from graphloom import pipeline
from graphloom.__main__ import work
from graphloom.sources import store


def tree(root, files):
    for path, text in files.items():
        at = root / path
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(text)


def test_index_resolve_ingest_and_move(spark, tmp_path):
    src, target = tmp_path / "src", str(tmp_path / "store")
    tree(src, {"a/x.go": "package a\nfunc Run() {\n\thelp()\n\tlater()\n}\n", "a/y.go": "package a\nfunc help() {}\n", "web/m.ts": "import { t } from './n'\nexport function go() { t() }\n", "web/n.ts": "export function t() {}\n", "docs/d.md": "# Top\n\n## Sub\n", "vendor/z.go": "package z\nfunc Z() {}\n", "out/gen.go": "package o\n", ".gitignore": "out/\n", "c.json": "{}"})
    assert pipeline.index(spark, str(src), target, "r") == {"add": 5}
    nodes, edges = store.read_graph(spark, target)
    ids = {r["id"] for r in nodes.collect()}
    assert {"func:a/x.go#Run", "func:a/y.go#help", "symbol:later", "doc:docs/d.md#d", "heading:docs/d.md#Sub", "func:web/n.ts#t"} <= ids and not any("vendor" in i or "out/" in i for i in ids)
    got = lambda: {(r["src_id"], r["edge_type"], r["dst_id"]) for r in pipeline.resolved(*store.read_graph(spark, target)).where("edge_type in ('calls', 'imports')").collect()}
    assert got() == {("func:a/x.go#Run", "calls", "func:a/y.go#help"), ("func:a/x.go#Run", "calls", "symbol:later"), ("func:web/m.ts#go", "calls", "func:web/n.ts#t"), ("module:web/m.ts", "imports", "module:web/n.ts")}
    assert pipeline.index(spark, str(src), target, "r") == {"skip": 5}
    # a later file settles an earlier call; a vanished one goes
    tree(src, {"a/w.go": "package a\nfunc later() {}\n", "a/y.go": "package a\nfunc help() { later() }\n"})
    (src / "web/m.ts").unlink()
    assert pipeline.index(spark, str(src), target, "r") == {"skip": 3, "add": 1, "replace": 1, "delete": 1}
    assert got() == {("func:a/x.go#Run", "calls", "func:a/y.go#help"), ("func:a/x.go#Run", "calls", "func:a/w.go#later"), ("func:a/y.go#help", "calls", "func:a/w.go#later")}
    tree(tmp_path / "traces", {"t.json": json.dumps({"spans": [{"spanId": "1", "name": "Run", "service": "r"}, {"spanId": "2", "parentSpanId": "1", "name": "help"}]})})
    for n in (1, 2):
        assert work(spark, target, "ingest", str(tmp_path / "traces"), "r") == "1 observed calls"
        assert [(r["src_id"], r["dst_id"], r["calls"]) for r in store.read_graph(spark, target)[1].where("edge_type = 'observed_calls'").collect()] == [("func:a/x.go#Run", "func:a/y.go#help", n)]
    before = [{tuple(r) for r in df.drop("weight").collect()} for df in store.read_graph(spark, target)]
    work(spark, target, "export", str(tmp_path / "snap"), "r")
    assert work(spark, str(tmp_path / "other"), "import", str(tmp_path / "snap"), None) == "version 1"
    assert [{tuple(r) for r in df.drop("weight").collect()} for df in store.read_graph(spark, str(tmp_path / "other"))] == before


def test_an_empty_tree(spark, tmp_path):
    (tmp_path / "e").mkdir()
    (tmp_path / "e" / "x.bin").write_text("x")
    assert work(spark, str(tmp_path / "s"), "index", str(tmp_path / "e"), None) == "nothing there"
