"""Source texts to nodes and edges, one extractor per extension behind a registry.

Python is read with the standard library's syntax tree, other languages from tokens and
scopes (``sources.syntax``). ``register`` adds or replaces an extractor: ``f(path, text) -> (nodes, edges)`` with nodes
(id, kind, name, start_line, end_line) and edges (src, dst, type).
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from graphloom.plans.ship import ship
from graphloom.sources import syntax

Result = tuple[list[tuple[str, str, str, int, int]], list[tuple[str, str, str]]]
REGISTRY: dict[str, Callable[[str, str], Result]] = {}


def register(*extensions: str):
    def add(f):
        for e in extensions:
            REGISTRY[e.lower()] = f
        return f

    return add


def _frame(path: str, text: str) -> Result:
    lines = text.count("\n") + 1
    name = path.rsplit("/", 1)[-1]
    return [(f"file:{path}", "file", path, 1, lines), (f"module:{path}", "module", name.rsplit(".", 1)[0] or name, 1, lines)], [(f"file:{path}", f"module:{path}", "contains")]


@register("py")
def extract_python(path: str, text: str) -> Result:
    nodes, edges = _frame(path, text)
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError):
        return nodes, edges

    def callee(f: ast.expr) -> str | None:
        if isinstance(f, ast.Name):
            return f.id
        if isinstance(f, ast.Attribute):
            left = callee(f.value)
            return f"{left or '_'}.{f.attr}"
        return None

    def visit(node: ast.AST, owner: str, cls: str | None) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, ast.FunctionDef | ast.AsyncFunctionDef):
                me = f"method:{path}#{cls}.{child.name}" if cls else f"func:{path}#{child.name}"
                nodes.append((me, "method" if cls else "function", child.name, child.lineno, child.end_lineno or child.lineno))
                edges.append((owner, me, "contains"))
                for d in child.decorator_list:
                    visit(ast.Expr(d), me, None)
                visit(ast.Module(child.body, []), me, None)
            elif isinstance(child, ast.ClassDef):
                me = f"type:{path}#{child.name}"
                nodes.append((me, "type", child.name, child.lineno, child.end_lineno or child.lineno))
                edges.append((owner, me, "contains"))
                edges.extend((me, f"symbol:{callee(b)}", "inherits") for b in child.bases if callee(b))
                visit(ast.Module(child.body, []), me, child.name)
            elif isinstance(child, ast.Import | ast.ImportFrom):
                specs = [a.name for a in child.names] if isinstance(child, ast.Import) else ["." * child.level + (child.module or "")]
                for s in specs:
                    nodes.append((f"import:{path}#{s}", "import", s, child.lineno, child.lineno))
                    edges.append((f"module:{path}", f"import:{path}#{s}", "imports"))
            else:
                if isinstance(child, ast.Call) and (name := callee(child.func)):
                    edges.append((owner, f"symbol:{name}", "calls"))
                visit(child, owner, cls if isinstance(child, ast.If | ast.Try | ast.With) else None)

    visit(tree, f"module:{path}", None)
    return nodes, edges


#: The language of each extension that ``syntax`` reads.
READERS = {"go": "go", "js jsx mjs cjs": "js", "ts tsx mts cts": "ts", "java": "java", "cs": "cs", "kt kts": "kt", "swift": "swift", "php": "php", "c h cc cpp cxx hpp hh hxx": "c"}
for _extensions, _language in READERS.items():
    register(*_extensions.split())(syntax.reader(_language))
register("rb")(syntax.read_ruby)


def doc_comment(lines: list[str], at: int) -> str:
    """The comment directly above line ``at`` (counted from 1), without markers; decorators between are skipped."""
    i, out = at - 2, []
    while i >= 0 and re.match(r"\s*[@\[]", lines[i]) and not lines[i].strip().startswith("*"):
        i -= 1
    if i >= 0 and lines[i].strip().endswith("*/"):
        while i >= 0:
            out.append(lines[i])
            if lines[i].lstrip().startswith("/*"):
                break
            i -= 1
    else:
        while i >= 0 and re.match(r"\s*(//|#(?!\s*(include|define|if|pragma)\b))", lines[i]):
            out.append(lines[i])
            i -= 1
    clean = (re.sub(r"^\s*(/\*+!?|\*+/|\*|//+[/!]?|#+)\s?|\s*\*+/\s*$", "", x).strip() for x in reversed(out))
    return "\n".join(x for x in clean if x and not x.startswith("MARK:"))


def doc_comments(path: str, text: str) -> dict[str, str]:
    """Documentation of each declaration of a file: docstrings in Python, comments above elsewhere."""
    nodes, _ = extract(path, text)
    lines = text.split("\n")
    out = {n[0]: doc_comment(lines, n[3]) for n in nodes if n[1] in ("function", "method", "type")}
    if path.endswith(".py"):
        try:
            for n in ast.walk(ast.parse(text)):
                if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef) and (d := ast.get_docstring(n)):
                    out |= {k[0]: d for k in nodes if k[3] == n.lineno and k[2] == n.name}
        except (SyntaxError, ValueError):
            pass
    return {k: v for k, v in out.items() if v}


def param_signature(params: str) -> str:
    """Normalised parameter types of a JVM or C# parameter list: ``(int,List<String>,String...)``."""
    params = params.replace("->", "\u2192")  # no closing bracket
    parts, level, at = [], 0, 0
    for i, c in enumerate(params + ","):
        level += (c in "<([") - (c in ">)]")
        if c == "," and level == 0:
            parts.append(params[at:i])
            at = i + 1
    types = []
    for p in parts:
        p = re.sub(r"@\w+(\([^)]*\))?|\b(final|ref|out|in|this|params|vararg|val|var|crossinline|noinline)\b", " ", p.split("=")[0]).strip()
        if not p:
            continue
        kind = p.split(":", 1)[1] if re.match(r"^\w+\s*:", p) else re.sub(r"\s*\b\w+\s*((?:\[\])*)$", r"\1", p)
        types.append(re.sub(r"\s+", "", kind).replace("\u2192", "->"))
    return f"({','.join(types)})"


def extract(path: str, text: str, registry: dict[str, Callable[[str, str], Result]] | None = None) -> Result:
    """Nodes and edges of one file, sorted and without repeats; an unknown extension has none."""
    f = (REGISTRY if registry is None else registry).get(path.rsplit(".", 1)[-1].lower()) if "." in path else None
    if f is None or text is None:
        return [], []
    nodes, edges = f(path, text)
    return sorted({n[0]: n for n in reversed(nodes)}.values()), sorted(set(edges))


OUT = "repo string, path string, nodes array<struct<id:string,kind:string,name:string,start_line:int,end_line:int>>, edges array<struct<src:string,dst:string,type:string>>"


def parse_files(files: DataFrame) -> DataFrame:
    """``OUT`` of source files (repo, path, text); files without an extractor have no row."""
    ship(files.sparkSession)
    node = pa.list_(pa.struct([("id", pa.string()), ("kind", pa.string()), ("name", pa.string()), ("start_line", pa.int32()), ("end_line", pa.int32())]))
    edge = pa.list_(pa.struct([("src", pa.string()), ("dst", pa.string()), ("type", pa.string())]))

    registry = dict(REGISTRY)  # as it is here: extractors registered in the driver go to the workers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, ns, es = [], [], []
            for i, (path, text) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                if path is None or text is None:
                    continue
                nodes, edges = extract(path, text, registry)
                if nodes:
                    keep.append(i)
                    ns.append([dict(zip(("id", "kind", "name", "start_line", "end_line"), n, strict=True)) for n in nodes])
                    es.append([dict(zip(("src", "dst", "type"), e, strict=True)) for e in edges])
            pick = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pick), batch.column(1).take(pick), pa.array(ns, node), pa.array(es, edge)], names=["repo", "path", "nodes", "edges"])

    return files.select("repo", "path", "text").mapInArrow(run, OUT)
