import datetime as dt

import pytest
from pyspark.sql import functions as F

from graphloom.llm import sourcefilter as S

NODES = "repo string, id string, kind string, name string, path string, indexed_at timestamp_ntz, content string"
DOCS = "doc_id long, repo string, path string, text string, source string"
CODE = "package a\n\nfunc Run(ctx Context) error {\n\t// Generated files are read by the loader.\n\tvalue := load(ctx, 12)\n\treturn nil\n}\n" * 2


CASES = ["a/vendor/x/y.go", "web/node_modules/p/i.js", "ios/Pods/q/A.c", "env/lib/site-packages/q/z.py", "src/external/lib@v1.2.3/a.ts", "deps/lib-1.2.3/a.py", "public/js/lib-1.2.3.js", "lib/_vendor/q/a.c", "a/x.pb.go", "a/x_pb2.py", "a/x_pb2_grpc.py", "a/B.Designer.cs", "a/b.g.cs", "a/zz_generated.b.go", "a/b_gen.go", "a/mock_b_autogen.go", "a/bindata_b.go", "a/__generated__/b/c.ts", "target/generated-sources/a/B.java", "a/b.min.js", "a/b-min.js", "www/b.MIN.js", "a/b.bundle.js", "dist/b.umd.js", "web/build/static/chunk-0a1b2c3d.js", "a/b.wasm.js", "a/b_base64_blob.py", "a/b_table_dump.ts"]
TRAPS = ["lib/generator/a.go", "a/vendorapi/b.go", "a/builder/b.py", "src/distance/b.js", "a/windowadmin.js", "a/minify_b.go", "a/bundle_loader_b.js", "a/b_generate_report.go", "a/third_party_login_b.go", "a/vendor_b_form.py", "a/codegen_options_b.cs", "tools/a/autogen_rules_b.js", "src/index.ts"]


def test_paths(spark):
    rows = spark.createDataFrame([(p,) for p in CASES + TRAPS], "p string").select("p", S.path_reason(F.col("p")).alias("r")).collect()
    assert {r["p"] for r in rows if r["r"]} == set(CASES)
    assert found(spark, [file("r", p) for p in CASES[:2] + TRAPS[:2]]) == {("r", f"file:{p}") for p in CASES[:2]}


def file(repo, path, name="n", **_):
    return (repo, f"file:{path}", "file", name, path, dt.datetime(2024, 1, 1), "x")


def found(spark, nodes, docs=()):
    out = S.not_hand_written(spark.createDataFrame(list(nodes), NODES), spark.createDataFrame([(i, *d) for i, d in enumerate(docs)], DOCS))
    return {(r["repo"], r["id"]) for r in out.collect()}


HEADS = ["// Code generated by x-c v0.3. DO NOT EDIT.", "# @generated by x from y.schema", "// AUTO-GENERATED by x -- edit the y template instead", "// This file was produced automatically from x.idl; manual changes will be lost.", "// <auto-generated>", "# machine generated (x), checksum 00; do not modify by hand", "// Automatisch erzeugt aus x.xml, bitte nicht ändern.", "// Vendored from lib@1.2.3. Send fixes upstream.", "// Imported third-party code: lib (1.2.3), refresh with sync-lib", "/*! lib v1.2.3 | part of the lib distribution */", "# copied verbatim out of the lib project, release 1.2.3", "// lib 1.2.3 - upstream copy, local patches: none"]


@pytest.mark.parametrize("head", HEADS)
def test_heads(head):
    assert S.head_reason(head + "\n" + CODE)
    assert S.head_reason("﻿// note\r\n\r\n" + head + "\r\n" + CODE)
    assert not S.head_reason(CODE + head)  # not at the head


def test_code_about_generating_is_no_case():
    assert not S.head_reason("import x\n\nout += 'Code generated by ' + name\nout += 'do not edit ' + y\n")
    assert not S.head_reason("// Keep this layout with every copy of x.\n/* Do not edit the token before y is closed. */\n" + CODE)
    assert not S.head_reason("#include \"generated by.h\"\nint x;")
    assert not S.layout_reason(CODE) and not S.layout_reason("") and not S.layout_reason("x")


def test_layouts():
    assert S.layout_reason('!function(a){b.c=d||4}(e);for(f=0;g<9;h++)i+=j;' * 20) == "minified"
    assert S.layout_reason("x = [\n" + "  0x0f, 0x92, 0x10, 0xe3,\n" * 40 + "]") == "data"
    assert S.layout_reason('const x = "' + "aB3/" * 200 + '"\n') == "data"


def test_names_texts_and_nulls(spark):
    names = [("r", f"func:m.js#{c}", "function", c, None, None, None) for c in "abcde"]
    nodes = [file("r", "m.js"), ("r", "file:q.go", "file", None, None, None, None), ("r", "file:q.go", "file", "q.go", "./q.go", None, None), file("r", "ok.go"), file("r", "bad.go"), ("r", "module:vendor/x.go", "module", "x", "vendor/x.go", None, None), (None, None, "file", None, None, None, None), *names]
    docs = [("r", "q.go", HEADS[0] + "\n" + CODE, "code"), ("r", "bad.go", None, "code"), ("r", "ok.go", HEADS[0], "docs"), (None, None, "x", "code")]
    assert found(spark, nodes, docs) == {("r", "file:m.js"), ("r", "file:q.go")}


def test_shared_subtrees(spark):
    body = "func Alpha() { return beta + gamma }\n" * 8
    mine = "func Other() { return delta * epsilon }\n" * 8
    nodes = [file("r", "lib/x/a.go"), file("r", "lib/x/b.go"), file("r", "main.go"), file("s", "copy/x/a.go"), file("s", "copy/x/b.go"), file("s", "own.go"), file("t", "tiny.go"), file("u", "tiny.go")]
    docs = [("r", "lib/x/a.go", body, "code"), ("r", "lib/x/b.go", body + "x", "code"), ("r", "main.go", mine, "code"), ("s", "copy/x/a.go", body, "code"), ("s", "copy/x/b.go", body + "x", "code"), ("s", "own.go", mine + "z", "code"), ("t", "tiny.go", "x", "code"), ("u", "tiny.go", "x", "code")]
    assert found(spark, nodes, docs) == {("r", "file:lib/x/a.go"), ("r", "file:lib/x/b.go"), ("s", "file:copy/x/a.go"), ("s", "file:copy/x/b.go")}


def test_a_vendored_tree_under_a_neutral_path(spark):
    """Copies in unrelated repositories: by text here, by declared names there, one file without either."""
    body = lambda k: f"func Alpha{k}() {{ return beta + gamma{k} }}\n" * 8
    nodes, docs = [], []
    for repo, root in (("r", "src/core/net"), ("s", "lib/net"), ("t", "net")):
        nodes += [file(repo, f"{root}/{x}.go") for x in "abc"] + [file(repo, f"own{repo}.go")]
        docs.append((repo, f"own{repo}.go", body(f"own{repo}"), "code"))
        for x in "ab":
            if repo != "t":
                docs.append((repo, f"{root}/{x}.go", body(x), "code"))
            nodes += [(repo, f"func:{root}/{x}.go#F{x}{k}", "function", f"Walk{x}{k}", None, None, None) for k in range(5)]
    want = {(repo, f"file:{root}/{x}.go") for repo, root in (("r", "src/core/net"), ("s", "lib/net"), ("t", "net")) for x in "abc"}
    assert found(spark, nodes, docs) == want
    assert found(spark, [n for n in nodes if n[0] == "r"], [d for d in docs if d[0] == "r"]) == set()


def test_a_content_of_many_repositories(spark):
    body = "func Alpha() { return beta + gamma }\n" * 8
    nodes = [file(f"r{i}", f"p{i}/x.go") for i in range(60)] + [file(f"r{i}", f"own{i}.go") for i in range(60)]
    docs = [(f"r{i}", f"p{i}/x.go", body, "code") for i in range(60)] + [(f"r{i}", f"own{i}.go", body + str(i), "code") for i in range(60)]
    assert found(spark, nodes, docs) == {(f"r{i}", f"file:p{i}/x.go") for i in range(60)}


def test_forks_are_related(spark):
    body = "func Alpha() { return beta + gamma }\n" * 8
    nodes = [file("r", "a/b.go"), file("fork", "a/b.go")]
    docs = [("r", "a/b.go", body, "code"), ("fork", "a/b.go", body, "code")]
    assert found(spark, nodes, docs) == set()


def test_empty_tables(spark):
    assert found(spark, []) == set()
