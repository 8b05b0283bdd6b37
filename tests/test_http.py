from pyspark.sql import functions as F

from graphloom.operators import http as H
from graphloom.sources import http as S

API = """
const express = require('express');
const app = express();
const users = express.Router();
const lost = express.Router();
users.get('/:id', getUser);
users.post('/', (req, res) => { res.send(1); });
lost.get('/nowhere', x);
app.use('/api/v1/users', users);
app.get('/health', health);
"""
SCORES = """
from fastapi import APIRouter, FastAPI
app = FastAPI()
router = APIRouter(prefix="/scores")
PATH = "/top"
@router.get(PATH + "/{n}")
def top(n): ...
@app.route("/legacy", methods=["POST", "PUT"])
def legacy(): ...
app.include_router(router, prefix="/api")
"""
WEB = """
const BASE = process.env.API_URL;
export async function load(id) {
  return fetch(`${BASE}/api/v1/users/${id}?x=1`, { method: 'GET' });
}
export const scores = (n) => axios.get('/api/scores/top/' + n);
"""
WORKER = """
import os, httpx
URL = os.environ["SCORES_URL"]
def run(n):
    return httpx.get(f"{URL}/scores/top/{n}")
def bad():
    return requests.get("https://example.org/else/where/now")
"""


def test_python_surface():
    rows = S.python_surface(SCORES)
    assert any(r[:4] == ("route", "router", "GET", "/top/{n}") and r[5] == "top" for r in rows)
    assert {(r[2], r[3]) for r in rows if r[0] == "route"} == {("GET", "/top/{n}"), ("POST", "/legacy"), ("PUT", "/legacy")}
    got = [r for r in S.python_surface(WORKER) if r[0] == "client"]
    assert [(r[1], r[2], r[3], r[4]) for r in got] == [("run", "GET", "/scores/top/{}", ["ENVIRON", "OS", "SCORES_URL"]), ("bad", "GET", "/else/where/now", [])]


def test_js_surface():
    rows = S.js_surface(API)
    assert {(r[1], r[2], r[3], r[5]) for r in rows if r[0] == "route"} == {("users", "GET", "/:id", "getUser"), ("users", "POST", "/", ""), ("lost", "GET", "/nowhere", "x"), ("app", "GET", "/health", "health")}
    got = [r for r in S.js_surface(WEB) if r[0] == "client"]
    assert [(r[1], r[2], r[3]) for r in got] == [("load", "GET", "/api/v1/users/{}"), ("scores", "GET", "/api/scores/top/{}")] and "API_URL" in got[0][4]
    assert S.next_route("src/app/(x)/users/[id]/route.ts") == "/users/{}" and S.next_route("pages/api/a/index.ts") == "/api/a" and S.next_route("a.ts") is None


def test_bind(spark):
    docs = [("api", "a.js", API), ("scores", "s.py", SCORES), ("web", "w.ts", WEB), ("worker", "k.py", WORKER), ("x", "n.txt", "fetch('/a')"), ("x", None, "x"), ("x", "e.py", None)]
    surface = S.http_surface(spark.createDataFrame(docs, "repo string, path string, text string"))
    routes = H.compose_routes(surface)
    got = {(r["repo"], r["method"], r["route"], r["mounted"]) for r in routes.collect()}
    assert got == {
        ("api", "GET", "/api/v1/users/{}", True), ("api", "POST", "/api/v1/users", True), ("api", "GET", "/health", True), ("api", "GET", "/nowhere", False),
        ("scores", "GET", "/api/scores/top/{}", True), ("scores", "POST", "/legacy", True), ("scores", "PUT", "/legacy", True),
    }
    members = spark.createDataFrame([("api", ["API_URL"]), ("scores", ["scores_url"]), ("web", [])], "member string, base_env array<string>")
    bound = H.bind_http(surface, routes, members)
    assert {(r["repo"], r["owner"], r["member"], r["how"]) for r in bound.collect()} == {("web", "load", "api", "declared"), ("web", "scores", "scores", "inferred"), ("worker", "run", "scores", "declared")}
    assert H.http_stats(surface, routes, bound, members).first().asDict() == {"routes": 6, "clients": 4, "declared": 2, "inferred": 1, "ambiguous": 0, "unmatched": 1, "service_edges": 2, "env_clashes": 0}
    assert {tuple(r) for r in H.service_env_reads(surface, members).collect()} == {("web", "w.ts", "api"), ("worker", "k.py", "scores")}
    assert {(r["member"], r["prefix"]) for r in H.route_prefixes(routes).where(F.col("member") == "api").collect()} >= {("api", "/api"), ("api", "/api/v1")}


def test_inference_gateway_and_ambiguity(spark):
    OUT = "repo string, path string, kind string, name string, method string, value string, tokens array<string>, target string, line int"
    client = lambda repo, value, line, *tokens: (repo, "p.js", "client", "f", "GET", value, list(tokens), "", line)
    surface = spark.createDataFrame(
        [
            client("web", "/teams/{}/athletes", 1),  # one other member has it
            client("web", "/athletes/all", 2),  # /api/v1 is a common prefix
            client("web", "/late/list", 3),  # what is left out is no common prefix
            client("own", "/teams/1/athletes", 4, "OTHER"),  # its own member has it too
            client("web", "/gw/x", 5, "A_URL"),  # behind the gateway
            client("web", "/x", 6, "A_URL", "B_URL"),  # two members
            client("web", "/both/here", 7),
        ],
        OUT,
    )
    route = lambda m, path, key=None: (m, "r.js", "GET", path, "h", True, key or f"{m}{path}")
    routes = spark.createDataFrame(
        [route("a", "/api/v1/teams/{}/athletes"), route("a", "/api/v1/athletes/all"), route("a", "/x"), route("a", "/one/deep/late/list"), route("own", "/teams/{}/athletes"), route("b", "/x"), route("a", "/both/here", "k"), route("a", "/api/both/here", "k")],
        "repo string, path string, method string, route string, handler string, mounted boolean, key string",
    )
    members = spark.createDataFrame([("a", ["A_URL", "SAME"], "/gw"), ("b", ["B_URL", "same"], None), ("own", [], None), ("web", [], None)], "member string, base_env array<string>, gateway_prefix string")
    bound = H.bind_http(surface, routes, members)
    assert {(r["line"], r["member"], r["route"], r["how"]) for r in bound.collect()} == {(2, "a", "/api/v1/athletes/all", "inferred"), (5, "a", "/x", "declared"), (7, "a", "/both/here", "inferred")}
    assert H.http_stats(surface, routes, bound, members).first().asDict() == {"routes": 8, "clients": 7, "declared": 1, "inferred": 2, "ambiguous": 1, "unmatched": 3, "service_edges": 0, "env_clashes": 1}


WRAPPED = """
const BASE = process.env.API_URL;
async function apiGet(path, opts) {
  return fetch(`${BASE}/api/v1${path}`);
}
const userGet = (p) => apiGet('/users' + p);
export function show(id) {
  return userGet(`/${id}`);
}
export function list() { return apiGet('/users'); }
"""
PY_WRAPPED = """
import os, requests
BASE = os.environ["SCORES_URL"]
def get_json(path):
    return requests.get(BASE + path).json()
def top(n):
    return get_json(f"/scores/top/{n}")
def one(n):
    return requests.get(f"{BASE}/scores/{n}")
"""


def test_wrappers(spark):
    docs = [("web", "w.ts", WRAPPED), ("worker", "k.py", PY_WRAPPED)]
    surface = S.http_surface(spark.createDataFrame(docs, "repo string, path string, text string"))
    got = {(r["repo"], r["name"], r["method"], r["value"], "|".join(r["tokens"])) for r in H.expand_wrappers(surface).where("kind = 'client'").collect()}
    assert {x[:4] for x in got} == {("web", "show", "GET", "/api/v1/users/{}"), ("web", "list", "GET", "/api/v1/users"), ("worker", "top", "GET", "/scores/top/{}"), ("worker", "one", "GET", "/scores/{}")}
    assert all("URL" in x[4] for x in got)


LONG = """
const express = require('express');
const app = express();
const users = express.Router();
users.get('/x', async (req, res) => {
%s  res.send(1);
});
users.post('/y', (req, res) => {
  // don't stop, at (any
  if (/['"`(]/.test(req.url)) res.send(`a ${req.map((x) => `<${x})`)} (`);
%s}, done);
app.use('/api', (req, res, next) => {
%s  next();
}, users,);
function save(id) {
  return fetch('/store/' + id, { body: {
%s  }, method: 'POST' });
}
"""


def test_long_arguments():
    filler = "  step('one', 2);\n" * 400
    body = "    key: 'value',\n" * 400
    rows = S.js_surface(LONG % (filler, filler, filler, body))
    assert [(r[1], r[2], r[3], r[5]) for r in rows if r[0] == "route"] == [("users", "GET", "/x", ""), ("users", "POST", "/y", "done")]
    assert [(r[1], r[3], r[5]) for r in rows if r[0] == "mount"] == [("app", "/api", "users")]
    assert [(r[1], r[2], r[3]) for r in rows if r[0] == "client"] == [("save", "POST", "/store/{}")]
    assert [(r[1], r[3]) for r in S.js_surface("const app = express();\napp.get('/a', <p>Don't</p>);\napp.get('/b', `x);\napp.get('/c', (q) => {") if r[0] == "route"] == [("app", "/a"), ("app", "/b"), ("app", "/c")]


def test_aliases_and_path_literals(spark):
    from graphloom.operators import contracts

    calls = spark.createDataFrame([("r", ["BASE", "X"], 1), ("r", [], 2), ("s", ["BASE"], 3), (None, ["BASE"], 4)], "repo string, tokens array<string>, line int")
    aliases = spark.createDataFrame([("r", "BASE", "A_URL"), ("r", "BASE", "B_URL"), ("r", "OTHER", "C")], "repo string, token string, name string")
    assert {r["line"]: sorted(r["tokens"]) for r in contracts.expand_aliases(calls, aliases).collect()} == {1: ["A_URL", "BASE", "B_URL", "X"], 2: [], 3: ["BASE"], 4: ["BASE"]}
    texts = spark.createDataFrame([("r", "p", "x = get('/a/{id}?q=1')\ny(\"b/c\")\n`/none`")], "repo string, path string, text string")
    ops = spark.createDataFrame([("api", "o1", "/a/{id}"), ("api", "o2", "/b/c")], "repo string, id string, path string")
    fns = spark.createDataFrame([("r", "p", "f", 1, 1), ("r", "p", "g", 2, 3), ("r", "p", "whole", 0, 0)], "repo string, path string, id string, start_line int, end_line int")
    assert {(r["id"], r["op_id"]) for r in contracts.bind_path_literals(contracts.path_literals(texts), ops, fns).collect()} == {("f", "o1"), ("g", "o2"), ("whole", "o1"), ("whole", "o2")}
