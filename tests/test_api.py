import os

import pytest
from pyspark.sql import functions as F

from graphloom.__main__ import QUESTIONS, ask
from graphloom.api import Graph
from graphloom.operators import lookup
from graphloom.sources import report

FOLDER = "/root/testdata/sf0.001"
NODE = "repo string, id string, kind string, name string, path string, start_line int, end_line int, uri string"


def test_snippets_docs_and_members(spark):
    nodes = spark.createDataFrame([("r", "func:p#f", "function", "f", "p", 2, 3, ""), ("r", "func:p#g", "function", "gg", "p", 0, 0, ""), ("r", "type:p#T", "type", "T", "p", 1, 1, ""), ("r", "method:q#T.m", "method", "m", "q", 1, 1, ""), ("r", "type:a#U", "type", "U", "a", 1, 1, ""), ("r", "type:b#U", "type", "U", "b", 1, 1, ""), ("r", "method:b#U.m", "method", "m", "b", 1, 1, "")], NODE)
    texts = spark.createDataFrame([("r", "p", "one\ntwo\nthree gg\n"), ("r", "d.md", "\n# top\nabout gg here\n")], "repo string, path string, text string")
    got = {r["id"]: r["snippet"] for r in lookup.snippets(nodes, texts).collect()}
    assert got == {"func:p#f": "two\nthree gg", "func:p#g": "three gg", "type:p#T": "one"}
    edges = spark.createDataFrame([("r", "doc:d.md#d.md", "documents", "r", "func:p#g"), ("r", "doc:d.md#d.md", "documents", "r", "func:p#f"), ("r", "doc:no.md#x", "documents", "r", "func:p#f")], "src_repo string, src_id string, edge_type string, dst_repo string, dst_id string")
    docs = {(r["id"], r["doc_id"]): r["line"] for r in lookup.docs_for_symbols(edges, nodes, texts).collect()}
    assert docs == {("func:p#g", "doc:d.md#d.md"): "about gg here", ("func:p#f", "doc:d.md#d.md"): "# top", ("func:p#f", "doc:no.md#x"): None} or docs["func:p#g", "doc:d.md#d.md"] == "about gg here"
    seeds = nodes.where("kind = 'type'").select("repo", "id")
    got = {(r["seed_id"], r["id"]) for r in lookup.with_members(nodes, seeds).where("seed_id <> id").collect()}
    assert got == {("type:p#T", "method:q#T.m"), ("type:b#U", "method:b#U.m")}


def test_questions_and_stats(spark):
    hubs = spark.createDataFrame([("r", "a", 3), ("r", "b", 9)], "repo string, id string, degree long")
    cycles = spark.createDataFrame([("x", "x"), ("y", "x")], "u string, component string")
    got = {r["kind"]: r["question"] for r in lookup.questions(hubs, cycles, hubs.limit(0)).collect()}
    assert set(got) == {"hub", "cycle"} and "9" in got["hub"]
    changes = spark.createDataFrame([("r", "a", "add"), ("r", "b", "skip"), ("r", "c", "replace")], "repo string, path string, action string")
    assert tuple(lookup.index_stats(changes).first()) == ("r", 2, 1, 0)


@pytest.mark.skipif(not os.path.exists(FOLDER), reason="no test tables here")
def test_every_question_answers(spark):
    g = Graph(spark, FOLDER)
    f = g.edges.where("edge_type = 'calls'").where(F.col("dst_id").startswith("func:")).first()
    for question in QUESTIONS:
        names = {"search": ["Cache"], "path": [f["src_id"], f["dst_id"]], "hot-paths": [], "services": [], "providers": [], "consumers": []}.get(question, [f["dst_id"]])
        rows = ask(g, question, names, depth=1, limit=5)
        assert rows.columns and len(rows.limit(50).collect()) >= 0, question
    assert Graph(spark, FOLDER, repo=f["src_repo"]).nodes.select("repo").distinct().count() == 1
    sections = {k: v for k, v in g.report().items() if k in ("Hubs", "Languages", "Top imports")}
    assert "## Hubs" in report.as_markdown(report.collect_sections(sections), "x")
