"""The HTTP surface of source files: routes, router mounts, client calls and environment reads.

Strings are evaluated symbolically: an expression becomes pieces, literal text or a
dynamic part with the names it mentions. A client's URL splits into base tokens (names in
the dynamic parts before the first path) and a path, dynamic parts inside it written
``{}``. Python is read from its syntax tree, JavaScript and TypeScript by a small scanner of calls.
Constants of the same file are looked up, at most ``DEPTH`` deep. A function that passes
a parameter on as (part of) a URL is a wrapper; calls with a path argument are kept, so
that wrappers can be expanded where they are called (``operators.http.expand_wrappers``).
"""

from __future__ import annotations

import ast
import re
from collections import Counter
from collections.abc import Iterator
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import DataFrame

from graphloom.plans.ship import ship

DEPTH = 6
VERBS = ("get", "post", "put", "patch", "delete", "head", "options")
CLIENTS = ("requests", "httpx", "axios", "client", "session", "http", "api", "ky", "got", "superagent")
Piece = tuple[str | None, tuple[str, ...]]  # (literal, ()) or (None, names)
Row = tuple[str, str, str, str, list[str], str, int]  # kind, name, method, value, tokens, target, line
OUT = "repo string, path string, kind string, name string, method string, value string, tokens array<string>, target string, line int"


def url_of(pieces: list[Piece]) -> tuple[list[str], str]:
    """Base tokens and normalisable path of a URL's pieces."""
    tokens, path = [], ""
    for literal, names in pieces:
        if literal is None:
            if path:
                path += "{}"
            else:
                tokens += names
        elif not path and "://" in literal:
            rest = literal.split("://", 1)[1]
            path += rest[rest.index("/") :] if "/" in rest else ""
        elif not path:
            at = literal.find("/")
            path += literal[at:] if at >= 0 else ""
        else:
            path += literal
    return sorted({t.upper() for t in tokens}), re.split(r"[?#]", path)[0]


# -- Python -----------------------------------------------------------------------------
def _names(node: ast.AST) -> tuple[str, ...]:
    found = [n.value for n in ast.walk(node) if isinstance(n, ast.Constant) and isinstance(n.value, str)]
    found += [n.id for n in ast.walk(node) if isinstance(n, ast.Name)] + [n.attr for n in ast.walk(node) if isinstance(n, ast.Attribute)]
    return tuple(x for x in found if re.fullmatch(r"[A-Za-z_]\w*", x))


def py_value(node: ast.AST | None, known: dict[str, ast.AST], depth: int = DEPTH) -> list[Piece]:
    if node is None or depth == 0:
        return [(None, ())]
    if isinstance(node, ast.Constant) and isinstance(node.value, str):
        return [(node.value, ())]
    if isinstance(node, ast.JoinedStr):
        return [p for v in node.values for p in py_value(v.value if isinstance(v, ast.FormattedValue) else v, known, depth - 1)]
    if isinstance(node, ast.BinOp) and isinstance(node.op, ast.Add):
        return py_value(node.left, known, depth - 1) + py_value(node.right, known, depth - 1)
    if isinstance(node, ast.BoolOp):
        return [(None, _names(node))]
    if isinstance(node, ast.Name) and node.id in known:
        return py_value(known[node.id], known, depth - 1)
    return [(None, _names(node))]


def _dotted(node: ast.AST) -> list[str]:
    if isinstance(node, ast.Name):
        return [node.id]
    return [*_dotted(node.value), node.attr] if isinstance(node, ast.Attribute) else ["_"]


def python_surface(text: str) -> list[Row]:
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError):
        return []
    known = {t.id: n.value for n in tree.body if isinstance(n, ast.Assign) for t in n.targets if isinstance(t, ast.Name)}
    rows: list[Row] = []

    def kwarg(call: ast.Call, *names: str) -> ast.AST | None:
        return next((k.value for k in call.keywords if k.arg in names), None)

    for name, value in known.items():
        if isinstance(value, ast.Call) and _dotted(value.func)[-1] in ("APIRouter", "Blueprint", "FastAPI", "Flask"):
            prefix = kwarg(value, "prefix", "url_prefix")
            rows.append(("router", name, "", url_of(py_value(prefix, known))[1] if prefix else "", [], "app" if _dotted(value.func)[-1] in ("FastAPI", "Flask") else "", value.lineno))

    def visit(node: ast.AST, owner: str, params: tuple[str, ...] = ()) -> None:
        for child in ast.iter_child_nodes(node):
            inner, within = owner, params
            if isinstance(child, ast.FunctionDef | ast.AsyncFunctionDef):
                inner, within = child.name, tuple(a.arg for a in child.args.args if a.arg not in ("self", "cls"))
                for d in child.decorator_list:
                    if isinstance(d, ast.Call) and isinstance(d.func, ast.Attribute) and (d.func.attr in VERBS or d.func.attr == "route") and d.args:
                        given = kwarg(d, "methods")
                        verbs = [e.value for e in given.elts if isinstance(e, ast.Constant)] if isinstance(given, ast.List | ast.Tuple) else [d.func.attr if d.func.attr in VERBS else "get"]
                        path = "".join("{}" if lit is None else lit for lit, _ in py_value(d.args[0], known))
                        rows.extend(("route", ".".join(_dotted(d.func.value)), v.upper(), path, [], child.name, child.lineno) for v in verbs)
            elif isinstance(child, ast.Call) and isinstance(child.func, ast.Attribute):
                left, verb = _dotted(child.func)[:-1], child.func.attr
                if verb in ("include_router", "register_blueprint") and child.args:
                    prefix = kwarg(child, "prefix", "url_prefix")
                    rows.append(("mount", ".".join(left), "", url_of(py_value(prefix, known))[1] if prefix else "", [], ".".join(_dotted(child.args[0])), child.lineno))
                elif verb in VERBS and left[-1].lower().lstrip("_") in CLIENTS and child.args:
                    pieces = py_value(child.args[0], known)
                    tokens, path = url_of(pieces)
                    if wrapped := wrapper_of(pieces, params, owner):
                        rows.append(("wrapper", wrapped[0], verb.upper(), wrapped[2], wrapped[1], "", child.lineno))
                    elif path or tokens:
                        rows.append(("client", owner, verb.upper(), path, tokens, "", child.lineno))
                elif (left[-1:] == ["environ"] and verb == "get" or verb == "getenv") and child.args and isinstance(child.args[0], ast.Constant):
                    rows.append(("env", owner, "", str(child.args[0].value), [], "", child.lineno))
            elif isinstance(child, ast.Subscript) and _dotted(child.value)[-1] == "environ" and isinstance(child.slice, ast.Constant):
                rows.append(("env", owner, "", str(child.slice.value), [], "", child.lineno))
            if isinstance(child, ast.Call) and not (isinstance(child.func, ast.Attribute) and child.func.attr in (*VERBS, "include_router", "register_blueprint")):
                rows.extend(wrapper_calls(_dotted(child.func)[-1], [py_value(a, known) for a in child.args], params, owner, child.lineno))
            visit(child, inner, within)

    visit(tree, "")
    return rows


# -- wrappers ---------------------------------------------------------------------------
def wrapper_of(pieces: list[Piece], params: tuple[str, ...], owner: str) -> tuple[str, list[str], str] | None:
    """(``owner/position``, tokens, path before the parameter) if the URL ends with a parameter of the function."""
    if not owner or not pieces or pieces[-1][0] is not None or len(pieces[-1][1]) != 1 or pieces[-1][1][0] not in params:
        return None
    tokens, path = url_of(pieces[:-1])
    if path and len(pieces) > 1 and path.endswith("/") and pieces[-2][0] is not None:
        return None  # one segment is passed, not a path
    return f"{owner}/{params.index(pieces[-1][1][0])}", tokens, path


def wrapper_calls(callee: str, arguments: list[list[Piece]], params: tuple[str, ...], owner: str, line: int) -> Iterator[Row]:
    """Arguments that look like paths, and parameters passed on, of a call that may be to a wrapper."""
    for k, pieces in enumerate(arguments):
        literal = pieces[0][0] if pieces else None
        if literal and literal.startswith("/"):
            if wrapped := wrapper_of(pieces, params, owner):
                yield "wrapper", wrapped[0], "", wrapped[2], [], f"{callee}/{k}", line
            else:
                yield "wcall", owner, "", url_of(pieces)[1], [], f"{callee}/{k}", line
        elif wrapped := wrapper_of(pieces, params, owner):
            if len(pieces) == 1:
                yield "wrapper", wrapped[0], "", "", [], f"{callee}/{k}", line


# -- JavaScript and TypeScript ----------------------------------------------------------
JS_CALL = re.compile(r"([A-Za-z_$][\w$]*(?:\.[A-Za-z_$][\w$]*)*)\s*(?:<[^<>()]*>)?\(")
JS_CONST = re.compile(r"(?m)^\s*(?:export\s+)?(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*(?::[^=\n]+)?=\s*([^\n;]+)")
JS_FUNC = re.compile(r"(?m)^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?(?:function\s*\*?\s*([A-Za-z_$][\w$]*)\s*(?:<[^<>()]*>)?\(([^()]*)\)|const\s+([A-Za-z_$][\w$]*)\s*=\s*(?:async\s*)?\(([^()]*)\))")
JS_ENV = re.compile(r"(?:process\.env|import\.meta\.env)(?:\.([A-Za-z_]\w*)|\[\s*[\"'](\w+)[\"']\s*\])")
JS_NAME = re.compile(r"[A-Za-z_$][\w$]*")


JS_TOKEN = re.compile(r"""(?<!:)//[^\n]*|/\*|["'`/()\[\]{},+]""")
JS_TEMPLATE = re.compile(r"\\.|`|\$\{", re.S)
JS_STRING = {q: re.compile(rf"{q}(?:[^{q}\\\n]|\\.)*{q}?", re.S) for q in "\"'"}
JS_REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")
JS_KEYWORD = re.compile(r"(?<![\w$.])(?:return|typeof|case|in|of|do|else|void|delete|throw|new|instanceof|await|yield|default)$")
CLOSES = {")": "(", "]": "[", "}": "{"}


def js_arguments(text: str) -> dict[int, list[list[int]]]:
    """The top-level arguments of every parenthesis in code, by the position just after it.

    An argument is its start, its top-level plus signs and its end. One pass with a stack of
    open brackets; comments, strings and regular expressions are stepped over, the code in
    templates is read. A text that ends inside a parenthesis ends its last argument.
    """
    out: dict[int, list[list[int]]] = {}
    stack: list[tuple[str, int, list[list[int]]]] = []  # bracket, position after it, arguments
    opened = [Counter()]  # of the stack's brackets by template
    at, templates = 0, True

    def push(bracket: str, start: int) -> None:
        stack.append((bracket, start, [[start]]))
        opened[-1][bracket] += 1

    def close(end: int) -> None:
        bracket, start, args = stack.pop()
        opened[-1][bracket] -= 1
        if bracket == "(":
            args[-1].append(end)
            out[start] = args if text[args[-1][0] : end].strip() else args[:-1]  # a comma at the end starts none

    while True:
        inside = bool(stack) and stack[-1][0] == "`"
        if not (m := (JS_TEMPLATE if inside else JS_TOKEN).search(text, at)):
            lone = next((k for k, f in enumerate(stack) if f[0] == "`"), None)
            if lone is None:
                break
            at, templates = stack[lone][1], False  # a backtick that nothing closes opens no template
            del stack[lone:]
            opened = [Counter(f[0] for f in stack)]
            continue
        c, i, at = m[0], m.start(), m.end()
        if inside:
            if c == "`":
                stack.pop()
                opened.pop()
            elif c == "${":
                push("{", at)
        elif c == "/*":
            at = end + 2 if (end := text.find("*/", at)) >= 0 else at
        elif c in JS_STRING:
            if not (i and (text[i - 1].isalnum() or text[i - 1] in "_$")) or JS_KEYWORD.search(text[max(0, i - 12) : i]):  # else an apostrophe
                at = JS_STRING[c].match(text, i).end()
        elif c == "/":
            k = i - 1
            while k >= 0 and text[k].isspace():
                k -= 1
            if k < 0 or text[k] in "(,=:[!&|?{;+-*%~^" or text[max(0, k - 1) : k + 1] == "=>" or JS_KEYWORD.search(text[max(0, k - 11) : k + 1]):
                at = r.end() if (r := JS_REGEX.match(text, i)) else at
        elif c == "`":
            if templates:
                stack.append((c, at, []))
                opened.append(Counter())
        elif c in "([{":
            push(c, at)
        elif c in ")]}":
            if opened[-1][CLOSES[c]]:
                while stack[-1][0] != CLOSES[c]:
                    close(i)
                close(i)
        elif stack and stack[-1][0] == "(":
            if c == "+":
                stack[-1][2][-1].append(i)
            elif c == ",":
                stack[-1][2][-1].append(i)
                stack[-1][2].append([at])
    while stack:  # templates are all closed here
        close(len(text))
    return out


def js_split(expr: str) -> list[str]:
    """The parts of a top-level concatenation."""
    parts, at, level, quote = [], 0, 0, ""
    for i, c in enumerate(expr):
        if quote:
            quote = "" if c == quote and expr[i - 1] != "\\" else quote
        elif c in "\"'`":
            quote = c
        elif c in "([{":
            level += 1
        elif c in ")]}":
            level -= 1
        elif c == "+" and level == 0:
            parts.append(expr[at:i])
            at = i + 1
    return [*parts, expr[at:]]


def js_value(expr: str, known: dict[str, str], depth: int = DEPTH) -> list[Piece]:
    return js_sum(js_split(expr.strip()), known, depth)


def js_sum(parts: list[str], known: dict[str, str], depth: int = DEPTH) -> list[Piece]:
    """Pieces of the parts of a concatenation."""
    if len(parts) > 1 and depth:
        return [p for x in parts for p in js_sum([x], known, depth - 1)]
    expr = parts[0].strip()
    if depth == 0 or not expr:
        return [(None, ())]
    if len(expr) > 1 and expr[0] in "\"'" and expr[-1] == expr[0]:
        return [(expr[1:-1], ())]
    if len(expr) > 1 and expr[0] == "`" and expr[-1] == "`":
        out: list[Piece] = []
        for k, x in enumerate(re.split(r"\$\{([^{}]*)\}", expr[1:-1])):
            out += js_value(x, known, depth - 1) if k % 2 else ([(x, ())] if x else [])
        return out
    if JS_NAME.fullmatch(expr) and expr in known:
        return js_value(known[expr], known, depth - 1)
    return [(None, tuple(JS_NAME.findall(expr)))]


def js_surface(text: str) -> list[Row]:
    known = {m[1]: m[2] for m in JS_CONST.finditer(text)}
    first_name = lambda p: (JS_NAME.findall(p) or [""])[0]
    owners = [(m.start(), m[1] or m[3], tuple(map(first_name, (m[2] or m[4] or "").split(",")))) for m in JS_FUNC.finditer(text)]
    place = lambda i: next(((n, p) for s, n, p in reversed(owners) if s <= i), ("", ()))
    owner_at = lambda i: place(i)[0]
    declared = {m.end(1) for m in JS_FUNC.finditer(text) if m[1]}
    line_at = lambda i: text.count("\n", 0, i) + 1
    spans = js_arguments(text)
    rows: list[Row] = []
    for name, value in known.items():
        if re.match(r"(express|express\.Router|Router|new Router|fastify|new Hono)\s*\(", value):
            rows.append(("router", name, "", "", [], "app" if value.startswith(("express(", "fastify", "new Hono")) else "", 0))
    routers = {r[1] for r in rows}
    for m in JS_CALL.finditer(text):
        chain, cuts = m[1].split("."), spans.get(m.end(), [])
        args = [text[c[0] : c[-1]].strip() for c in cuts]
        value = lambda k: js_sum([text[x + (n > 0) : y] for n, (x, y) in enumerate(pairwise(cuts[k]))], known)  # noqa: E731, B023
        left, verb = chain[:-1], chain[-1]
        if not args or not args[0]:
            continue
        if left and left[-1] in routers and verb in VERBS and len(args) > 1 and args[0][0] in "\"'`":
            path = "".join("{}" if lit is None else lit for lit, _ in value(0))
            handler = args[-1] if JS_NAME.fullmatch(args[-1].split(".")[-1]) else ""
            rows.append(("route", left[-1], verb.upper(), path, [], handler, line_at(m.start())))
        elif left and left[-1] in routers and verb == "use":
            prefix = "".join(lit or "" for lit, _ in value(0)) if args[0][0] in "\"'`" else ""
            if JS_NAME.fullmatch(args[-1]):
                rows.append(("mount", left[-1], "", prefix, [], args[-1], line_at(m.start())))
        elif chain == ["fetch"] or (left and left[-1].lower() in CLIENTS and verb in VERBS):
            pieces = value(0)
            tokens, path = url_of(pieces)
            owner, params = place(m.start())
            given = re.search(r"method\s*:\s*[\"'](\w+)[\"']", args[1]) if len(args) > 1 else None
            method = verb.upper() if verb in VERBS else (given[1].upper() if given else "GET")
            if wrapped := wrapper_of(pieces, params, owner):
                rows.append(("wrapper", wrapped[0], method if given or verb in VERBS else "", wrapped[2], wrapped[1], "", line_at(m.start())))
            elif path or tokens:
                rows.append(("client", owner, method, path, tokens, "", line_at(m.start())))
        elif m.end(1) not in declared and not (left and verb in VERBS):
            owner, params = place(m.start())
            rows.extend(wrapper_calls(verb, [value(k) for k in range(len(args))], params, owner, line_at(m.start())))
    for m in JS_ENV.finditer(text):
        rows.append(("env", owner_at(m.start()), "", m[1] or m[2], [], "", line_at(m.start())))
    return rows


def next_route(path: str) -> str | None:
    """The URL of a file-routed API handler (``app/.../route.ts``, ``pages/api/...``)."""
    if m := re.search(r"(?:^|/)app/(?:(.*)/)?route\.[jt]sx?$", path):
        parts = [p for p in (m[1] or "").split("/") if p and not re.fullmatch(r"\(.*\)|@.*", p)]
    elif m := re.search(r"(?:^|/)pages/(api(?:/.*)?)\.[jt]sx?$", path):
        parts = [p for p in m[1].split("/") if p != "index"]
    else:
        return None
    return "/" + "/".join("{}" if p.startswith("[") else p for p in parts)


def surface(path: str, text: str) -> list[Row]:
    end = path.rsplit(".", 1)[-1].lower()
    if end == "py":
        return python_surface(text)
    if end not in ("js", "jsx", "mjs", "cjs", "ts", "tsx"):
        return []
    rows = js_surface(text)
    if url := next_route(path):
        for m in re.finditer(r"(?m)^export\s+(?:async\s+)?(?:function|const)\s+(GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS)\b", text):
            rows.append(("route", "app", m[1], url, [], m[1], text.count("\n", 0, m.start()) + 1))
    return rows


def http_surface(docs: DataFrame) -> DataFrame:
    """``OUT`` of source files (repo, path, text): rows of kind router, route, mount, client, env, wrapper and wcall.

    route: name = router, target = handler. mount: name = outer router, value = prefix,
    target = inner router. client: name = calling function, tokens = base names. env: value = variable.
    wrapper: name = function/position, value = path before the parameter, target = the wrapper it
    calls. wcall: target = function/position called, value = path.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string()] * 6 + [pa.list_(pa.string()), pa.string(), pa.int32()]
        for batch in batches:
            rows = [(r, p, *x) for r, p, t in zip(*(c.to_pylist() for c in batch.columns), strict=True) if p and t for x in surface(p, t)]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 9
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in OUT.split(", ")])

    return docs.select("repo", "path", "text").mapInArrow(run, OUT)
