"""Queries over the property graph, each beside its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from graphloom.functions import paths as P, text as T
from graphloom.operators import analysis, contracts, graph, history, impact, lookup, ranking, resolution, tracing
from graphloom.operators.references import canonical_uri
from graphloom.plans.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}

LN = """ln AS (SELECT repo, id, kind, name, path, start_line, end_line, uri FROM (
  SELECT *, row_number() OVER (PARTITION BY repo, id ORDER BY t DESC, alive DESC, kind DESC, name DESC, path DESC, start_line DESC, end_line DESC, uri DESC) AS rn FROM (
  SELECT repo, id, coalesce(kind, '') AS kind, coalesce(name, '') AS name, coalesce(path, '') AS path, coalesce(indexed_at, TIMESTAMP '0001-01-01') AS t,
    CASE WHEN deleted_at IS NULL THEN 1 ELSE 0 END AS alive, coalesce(try_cast(props['start_line'] AS INT), 0) AS start_line,
    coalesce(try_cast(props['end_line'] AS INT), 0) AS end_line, coalesce(props['repo_uri'], '') AS uri FROM nodes WHERE repo IS NOT NULL AND id IS NOT NULL)) WHERE rn = 1 AND alive = 1)"""
LE = """le AS (SELECT src_repo, src_id, edge_type, dst_repo, dst_id, max(try_cast(props['weight'] AS DOUBLE)) AS weight, max(coalesce(try_cast(props['support'] AS INT), 0)) AS support,
  max(coalesce(try_cast(props['count'] AS INT), 0)) AS calls FROM edges WHERE coalesce(src_id, '') <> '' AND coalesce(dst_id, '') <> '' AND src_repo IS NOT NULL AND dst_repo IS NOT NULL AND edge_type IS NOT NULL
  GROUP BY src_repo, src_id, edge_type, dst_repo, dst_id)"""
OV = """nu AS (SELECT uri, repo, id FROM (SELECT url_decode(replace(trim(uri), '+', '%2B')) AS uri, repo, id, row_number() OVER (PARTITION BY url_decode(replace(trim(uri), '+', '%2B')) ORDER BY repo, id) AS k FROM ln WHERE uri <> '') WHERE k = 1),
ou AS (SELECT DISTINCT url_decode(replace(trim(src_uri), '+', '%2B')) AS su, url_decode(replace(trim(dst_uri), '+', '%2B')) AS du, edge_type, props['match'] AS match FROM overlay_edges),
ov AS (SELECT a.repo AS src_repo, a.id AS src_id, ou.edge_type, b.repo AS dst_repo, b.id AS dst_id, match, su AS src_uri, du AS dst_uri FROM ou LEFT JOIN nu a ON a.uri = su LEFT JOIN nu b ON b.uri = du WHERE su <> '' AND du <> '')"""
IDPATH = "nullif(regexp_extract({0}, '^(?:file|module|package|func|method|type|import|doc|heading|operation):([^#]*)', 1), '')"
VIEW = f"""ve AS (SELECT src_repo, src_id, dst_repo, dst_id, edge_type, {IDPATH.format('src_id')} AS sp, {IDPATH.format('dst_id')} AS dp FROM le WHERE edge_type IN ('calls', 'imports') AND NOT regexp_matches(dst_id, '^(symbol|import):')),
vw AS (SELECT DISTINCT * FROM (SELECT src_repo AS a_repo, 'file:' || sp AS a, dst_repo AS b_repo, 'file:' || dp AS b, edge_type FROM ve WHERE sp IS NOT NULL AND dp IS NOT NULL
  UNION ALL SELECT src_repo, src_id, dst_repo, dst_id, edge_type FROM ve WHERE edge_type = 'calls') WHERE a_repo <> b_repo OR a <> b)"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _nodes(s: SparkSession, d: str) -> DataFrame:
    return graph.live_nodes(table(s, d, "nodes"))


def _edges(s: SparkSession, d: str) -> DataFrame:
    return graph.live_edges(table(s, d, "edges"))


def _kind(s: SparkSession, d: str, *kinds: str) -> DataFrame:
    return _nodes(s, d).where(F.col("kind").isin(*kinds))


def _overlay(s: SparkSession, d: str) -> DataFrame:
    return graph.resolve_overlay(table(s, d, "overlay_edges"), _nodes(s, d))


def _view(s: SparkSession, d: str) -> DataFrame:
    return analysis.dependency_view(_edges(s, d), _nodes(s, d))


def _long(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("long") for c in columns})


# -- scans ------------------------------------------------------------------------------
@query(f"WITH {LN} SELECT * FROM ln")
def scan_nodes(s, d):
    return _nodes(s, d)


@query(f"WITH {LE} SELECT * FROM le")
def scan_edges(s, d):
    return _edges(s, d)


@query(f"WITH {LN}, {LE} SELECT le.* FROM le WHERE EXISTS (SELECT 1 FROM ln WHERE ln.repo = src_repo AND ln.id = src_id) AND EXISTS (SELECT 1 FROM ln WHERE ln.repo = dst_repo AND ln.id = dst_id)")
def scan_edges_between_live(s, d):
    return graph.between_live(_edges(s, d), _nodes(s, d))


@query(f"WITH {LN}, {LE}, {OV} SELECT src_repo, src_id, edge_type, dst_repo, dst_id FROM le UNION ALL SELECT DISTINCT src_repo, src_id, edge_type, dst_repo, dst_id FROM ov WHERE src_id IS NOT NULL AND dst_id IS NOT NULL")
def scan_federated(s, d):
    return graph.federated_edges(table(s, d, "edges"), table(s, d, "overlay_edges"), _nodes(s, d)).select(*graph.EDGE)


@query(f"WITH {LN}, {OV} SELECT edge_type, src_uri, dst_uri, src_id IS NULL AS lost_src, dst_id IS NULL AS lost_dst FROM ov WHERE src_id IS NULL OR dst_id IS NULL")
def scan_overlay_warnings(s, d):
    return _overlay(s, d).where("src_id is null or dst_id is null").select("edge_type", "src_uri", "dst_uri", F.col("src_id").isNull().alias("lost_src"), F.col("dst_id").isNull().alias("lost_dst"))


@query(
    f"""WITH {LN}, {LE}, s AS (SELECT repo, id FROM ln WHERE kind = 'operation')
SELECT src_repo AS seed_repo, src_id AS seed_id, 'out' AS dir, edge_type, dst_repo AS repo, dst_id AS id FROM le JOIN s ON s.repo = src_repo AND s.id = src_id
UNION ALL SELECT dst_repo, dst_id, 'in', edge_type, src_repo, src_id FROM le JOIN s ON s.repo = dst_repo AND s.id = dst_id"""
)
def scan_adjacent(s, d):
    return graph.adjacent(_edges(s, d), _kind(s, d, "operation"))


# -- filters ----------------------------------------------------------------------------
@query(f"WITH {LN} SELECT repo, id, kind, name FROM ln WHERE contains(id, 'Cache') OR contains(name, 'Cache') ORDER BY id, repo LIMIT 20")
def filter_search(s, d):
    return graph.search(_nodes(s, d), "Cache").select("repo", "id", "kind", "name")


@query(
    f"""WITH {LN}, q AS (SELECT name AS query FROM ln WHERE name <> '' UNION SELECT id FROM ln WHERE kind IN ('file', 'symbol') UNION SELECT uri FROM ln WHERE uri <> '' AND kind = 'type'),
u AS (SELECT query, min(repo) AS repo, min(id) AS id, 0 AS tier, count(*) AS c FROM q JOIN ln ON query = uri GROUP BY query),
i AS (SELECT query, min(repo) AS repo, min(id) AS id, 1 AS tier, count(*) AS c FROM q JOIN ln ON query = id WHERE query NOT IN (SELECT query FROM u) GROUP BY query),
m AS (SELECT query, repo, id, kind IN ('symbol', 'import') AS loose, kind IN ('function', 'method', 'type', 'operation', 'schema') AS code, kind = 'type' AS typ, kind IN ('file', 'module', 'package') AS box FROM q JOIN ln ON query = name WHERE query NOT IN (SELECT query FROM u) AND query NOT IN (SELECT query FROM i)),
g AS (SELECT query, count(*) FILTER (NOT loose) AS n, count(*) FILTER (code) AS nc, count(*) FILTER (typ) AS nt, count(*) FILTER (box) AS nb, count(*) FILTER (loose) AS nl FROM m GROUP BY query),
t AS (SELECT query, CASE WHEN n = 1 THEN 2 WHEN nc = 1 THEN 3 WHEN nt = 1 AND nt + nb = n THEN 4 WHEN n = 0 AND nl = 1 THEN 5 END AS tier FROM g)
SELECT query, repo, id, tier FROM u WHERE c = 1 UNION ALL SELECT query, repo, id, tier FROM i WHERE c = 1
UNION ALL SELECT query, repo, id, tier FROM t JOIN m USING (query) WHERE (tier = 2 AND NOT loose) OR (tier = 3 AND code) OR (tier = 4 AND typ) OR (tier = 5 AND loose)"""
)
def filter_seeds(s, d):
    nodes = _nodes(s, d)
    asked = nodes.where("name <> ''").select(F.col("name").alias("query")).union(nodes.where("kind in ('file', 'symbol')").select("id")).union(nodes.where("uri <> '' and kind = 'type'").select("uri"))
    return graph.resolve_seeds(nodes, asked)


@query(f"WITH {LN} SELECT repo, id, CASE WHEN kind = 'method' AND regexp_extract(id, '#([^(]*)', 1) <> '' THEN regexp_extract(id, '#([^(]*)', 1) ELSE name END AS label, lower(regexp_replace(name, '[^\\p{{L}}\\p{{Nd}}]', '', 'g')) AS folded FROM ln WHERE kind IN ('function', 'method')")
def filter_symbol_labels(s, d):
    return _kind(s, d, "function", "method").select("repo", "id", T.symbol_label(F.col("id"), F.col("kind"), F.col("name")).alias("label"), T.fold_name(F.col("name")).alias("folded"))


@query(f"WITH {LN}, {LE}, u AS (SELECT name, min(repo) AS repo, min(id) AS id FROM ln WHERE kind IN ('function', 'method') AND name <> '' GROUP BY name HAVING count(*) = 1), c AS (SELECT * FROM le WHERE edge_type = 'calls'),\na AS (SELECT DISTINCT u.name, src_repo AS from_repo, src_id AS from_id FROM c JOIN u ON u.repo = dst_repo AND u.id = dst_id)\nSELECT * FROM a UNION SELECT DISTINCT u.name, src_repo, src_id FROM c JOIN u ON dst_id = 'symbol:' || u.name WHERE u.name NOT IN (SELECT name FROM a)")
def filter_references(s, d):
    nodes = _nodes(s, d)
    return graph.references_to(_edges(s, d), nodes, nodes.where("kind in ('function', 'method') and name <> ''").select("name").distinct())


# -- contracts --------------------------------------------------------------------------
@query(f"WITH {LN}, {LE}, {OV}, fe AS (SELECT src_repo, src_id, edge_type, dst_repo, dst_id FROM le UNION SELECT src_repo, src_id, edge_type, dst_repo, dst_id FROM ov WHERE src_id IS NOT NULL AND dst_id IS NOT NULL) SELECT DISTINCT c.src_repo AS client_repo, c.src_id AS client_id, c.dst_repo AS op_repo, c.dst_id AS op_id, h.src_repo AS handler_repo, h.src_id AS handler_id FROM fe c JOIN fe h ON h.dst_repo = c.dst_repo AND h.dst_id = c.dst_id WHERE c.edge_type = 'consumes' AND h.edge_type = 'implements'")
def join_contract_hops(s, d):
    return impact.contract_hops(_federated(s, d))


def _roles(role: str):
    return f"""WITH {LN}, {LE}, {OV}, fe AS (SELECT src_repo, src_id, edge_type, dst_repo, dst_id FROM le UNION SELECT src_repo, src_id, edge_type, dst_repo, dst_id FROM ov WHERE src_id IS NOT NULL AND dst_id IS NOT NULL)
SELECT DISTINCT dst_repo AS op_repo, dst_id AS op_id, o.name AS op_name, n.repo, n.id, n.name, n.kind FROM fe JOIN ln o ON o.repo = dst_repo AND o.id = dst_id AND o.kind = 'operation' JOIN ln n ON n.repo = src_repo AND n.id = src_id WHERE edge_type = '{role}'"""


def _federated(s, d):
    return graph.federated_edges(table(s, d, "edges"), table(s, d, "overlay_edges"), _nodes(s, d))


@query(_roles("implements"))
def join_providers(s, d):
    return impact.providers(_federated(s, d), _nodes(s, d), "implements")


@query(_roles("consumes"))
def join_consumers(s, d):
    return impact.providers(_federated(s, d), _nodes(s, d), "consumes")


@query(f"WITH {LN}, {OV} SELECT src_repo AS from_repo, dst_repo AS to_repo, count(*) FILTER (edge_type = 'consumes') AS calls, count(*) FILTER (match = 'env_read') AS env_reads, count(DISTINCT src_id) AS sites FROM ov WHERE src_repo <> dst_repo GROUP BY ALL")
def join_service_calls(s, d):
    return contracts.service_calls(_overlay(s, d))


@query(
    f"""WITH {LN}, {OV}, h AS (SELECT DISTINCT src_repo AS f, dst_repo AS t FROM ov WHERE src_repo <> dst_repo),
a AS (SELECT t AS member, f AS repo, 1 AS depth, t AS via FROM h),
b AS (SELECT a.member, h.f AS repo, 2 AS depth, min(h.t) AS via FROM a JOIN h ON h.t = a.repo WHERE h.f <> a.member AND NOT EXISTS (SELECT 1 FROM a x WHERE x.member = a.member AND x.repo = h.f) GROUP BY ALL)
SELECT * FROM a UNION ALL SELECT * FROM b"""
)
def join_service_consumers(s, d):
    from graphloom.plans.iterate import cut

    calls = cut(contracts.service_calls(_overlay(s, d)))
    return contracts.service_consumers(calls, calls.select(F.col("to_repo").alias("member")), 2)


_HTTP = "'/' || array_to_string(list_transform(list_filter(string_split(regexp_extract({0}, '^[^?#]*'), '/'), lambda x: x <> ''), lambda x: CASE WHEN starts_with(x, ':') OR regexp_matches(x, '^\\{{.*\\}}$|^\\[.*\\]$|^<.*>$') OR contains(x, '{{}}') THEN '{{}}' ELSE x END), '/')"


_OP = "^operation:[^#]*#([A-Z]+) (/.*)$"
_OPS = f"op AS (SELECT repo, id, path, regexp_extract(id, '{_OP}', 1) AS m, regexp_extract(id, '{_OP}', 2) AS p FROM ln WHERE regexp_matches(id, '{_OP}'))"
_GENERIC = "('api', 'health', 'healthz', 'docs', 'status', 'openapi.json', 'metrics', 'ready', 'live')"


def _operations(s, d):
    """(repo, id, path, method, route) of the operations with a verb and a route."""
    part = lambda k: F.regexp_extract("id", _OP, k)
    return _nodes(s, d).where(F.col("id").rlike(_OP)).select("repo", "id", "path", part(1).alias("method"), part(2).alias("route"))


@query(
    f"""WITH {LN}, {_OPS}, u AS (SELECT DISTINCT url_decode(replace(trim(dst_uri), '+', '%2B')) AS u FROM overlay_edges WHERE edge_type = 'consumes'),
c AS (SELECT u AS call_id, regexp_extract(u, '#operation:([A-Z]+) (/.*)$', 1) AS m, {_HTTP.format("regexp_extract(u, '#operation:([A-Z]+) (/.*)$', 2)")} AS p FROM u WHERE regexp_matches(u, '#operation:[A-Z]+ /')
  UNION ALL SELECT u || '~', 'ANY', {_HTTP.format("regexp_extract(u, '#operation:[A-Z]+ /[^/]*(/.*)$', 1)")} FROM u WHERE regexp_matches(u, '#operation:[A-Z]+ /[^/]*/')),
cs AS (SELECT call_id, m, list_filter(string_split(p, '/'), lambda x: x <> '') AS s FROM c),
r AS (SELECT DISTINCT repo AS member, m, {_HTTP.format('p')} AS route FROM op),
rs AS (SELECT *, list_filter(string_split(route, '/'), lambda x: x <> '') AS s FROM r),
j AS (SELECT call_id, member, route, len(rs.s) - len(cs.s) AS off, list_zip(cs.s, rs.s[len(rs.s) - len(cs.s) + 1:]) AS z FROM cs JOIN rs ON len(rs.s) >= len(cs.s) AND len(cs.s) > 0 AND (cs.m = rs.m OR cs.m = 'ANY' OR rs.m = 'ANY')),
k AS (SELECT *, len(list_filter(z, lambda x: x[1] = x[2] AND x[1] <> '{{}}')) AS lit, len(list_filter(z, lambda x: x[1] = x[2] AND x[1] <> '{{}}' AND NOT (x[1] IN {_GENERIC} OR regexp_matches(x[1], '^v[0-9]+$')))) AS spec FROM j WHERE len(list_filter(z, lambda x: x[1] <> x[2] AND x[1] <> '{{}}' AND x[2] <> '{{}}')) = 0),
t AS (SELECT *, rank() OVER (PARTITION BY call_id ORDER BY lit DESC, off) AS q FROM k WHERE spec >= 1)
SELECT call_id, min(member) AS member, min(route) AS route FROM t WHERE q = 1 GROUP BY call_id HAVING count(DISTINCT (member, route)) = 1"""
)
def join_route_match(s, d):
    """Calls: what edges across members consume, with the verb; and without it and the first segment (named with ``~``)."""
    uris = table(s, d, "overlay_edges").where("edge_type = 'consumes'").select(canonical_uri(F.col("dst_uri")).alias("u")).distinct()
    part = lambda pattern, k: F.regexp_extract("u", pattern, k)
    whole = uris.where(F.col("u").rlike("#operation:[A-Z]+ /")).select(F.col("u").alias("call_id"), part("#operation:([A-Z]+) (/.*)$", 1).alias("method"), part("#operation:([A-Z]+) (/.*)$", 2).alias("path"))
    short = uris.where(F.col("u").rlike("#operation:[A-Z]+ /[^/]*/")).select(F.concat("u", F.lit("~")).alias("call_id"), F.lit("ANY").alias("method"), part("#operation:[A-Z]+ /[^/]*(/.*)$", 1).alias("path"))
    routes = _operations(s, d).select(F.col("repo").alias("member"), "method", F.col("route").alias("path"))
    return contracts.match_routes(whole.unionByName(short), routes, min_specific=1)


@query(
    f"""WITH {LN}, {_OPS}, r AS (SELECT DISTINCT repo AS member, list_filter(string_split({_HTTP.format("'/' || split_part(path, '/', 1) || p")}, '/'), lambda x: x <> '') AS s FROM op),
n AS (SELECT member, count(*) AS n FROM r GROUP BY member), p AS (SELECT member, s[:k] AS p FROM r, (SELECT unnest([1, 2, 3]) AS k) WHERE k < len(s)),
g AS (SELECT member, p, count(*) AS routes FROM p GROUP BY ALL)
SELECT member, '/' || array_to_string(p, '/') AS prefix, routes FROM g JOIN n USING (member) WHERE len(list_filter(p, lambda x: NOT (x IN {_GENERIC} OR regexp_matches(x, '^v[0-9]+$')))) = 0 OR routes >= greatest(2, n // 5)"""
)
def agg_common_prefixes(s, d):
    """Routes as served below the folder of their contract."""
    return contracts.common_prefixes(_operations(s, d).select(F.col("repo").alias("member"), F.concat(F.lit("/"), F.split_part("path", F.lit("/"), F.lit(1)), "route").alias("path")))


_FOLD = "lower(regexp_replace({0}, '[^\\p{{L}}\\p{{Nd}}]', '', 'g'))"


@query(
    f"""WITH {LN}, {LE}, o AS (SELECT dst_repo AS repo, dst_id AS id, min(n.name) AS o FROM le JOIN ln n ON n.repo = src_repo AND n.id = src_id AND n.kind = 'function' AND n.name <> '' WHERE edge_type = 'implements' AND starts_with(dst_id, 'operation:') GROUP BY ALL),
x AS (SELECT DISTINCT repo, id, o, unnest([{_FOLD.format('o')}, 'resolve' || {_FOLD.format('o')}, 'get' || {_FOLD.format('o')}, {_FOLD.format("split_part(o, '_', -1)")}]) AS f FROM o)
SELECT DISTINCT n.repo, n.id, x.repo AS op_repo, x.id AS op_id, CASE WHEN n.repo = x.repo THEN 'implements' ELSE 'consumes' END AS edge_type FROM ln n JOIN x ON {_FOLD.format('n.name')} = x.f WHERE n.kind = 'function' AND x.f <> ''"""
)
def join_bind_operation_ids(s, d):
    """Operations named like the least function that implements them."""
    functions = _kind(s, d, "function")
    served = _edges(s, d).where("edge_type = 'implements'").where(F.col("dst_id").startswith("operation:"))
    named = served.join(functions.where("name <> ''").select(F.col("repo").alias("src_repo"), F.col("id").alias("src_id"), "name"), ["src_repo", "src_id"])
    ops = named.groupBy(F.col("dst_repo").alias("repo"), F.col("dst_id").alias("id")).agg(F.min("name").alias("operation_id"))
    return contracts.bind_operation_ids(ops, functions)


@query(
    f"""WITH {LN}, {LE}, {_OPS}, w AS (SELECT DISTINCT n.repo, n.path, n.start_line AS line, op.p FROM le JOIN ln n ON n.repo = src_repo AND n.id = src_id AND n.kind IN ('function', 'method') AND n.path <> '' AND n.start_line >= 1 JOIN op ON op.repo = dst_repo AND op.id = dst_id WHERE edge_type = 'implements'),
o AS (SELECT repo, id, regexp_extract(p, '^[^?#]*') AS route FROM op)
SELECT DISTINCT n.repo, n.id, o.repo AS op_repo, o.id AS op_id FROM w JOIN o ON o.route = regexp_extract(w.p, '^[^?#]*') JOIN ln n ON n.repo = w.repo AND n.path = w.path AND n.kind IN ('function', 'method') AND (n.start_line = 0 OR n.end_line = 0 OR w.line BETWEEN n.start_line AND n.end_line)"""
)
def join_bind_path_literals(s, d):
    """Texts that quote, in the first line of each implementing function, the route it implements, without its slash and with a query."""
    functions, ops = _kind(s, d, "function", "method"), _operations(s, d)
    served = _edges(s, d).where("edge_type = 'implements'").join(ops.select(F.col("repo").alias("dst_repo"), F.col("id").alias("dst_id"), "route"), ["dst_repo", "dst_id"])
    places = served.join(functions.where("path <> '' and start_line >= 1").select(F.col("repo").alias("src_repo"), F.col("id").alias("src_id"), "path", "start_line"), ["src_repo", "src_id"])
    texts = places.select(F.col("src_repo").alias("repo"), "path", F.concat(F.expr("repeat('\\n', start_line - 1)"), F.lit('get("'), F.expr("substr(route, 2)"), F.lit('?a=1", handle)')).alias("text"))
    return contracts.bind_path_literals(contracts.path_literals(texts), ops.select("repo", "id", F.col("route").alias("path")), functions)


# -- history and traces -----------------------------------------------------------------
_COMMITS = """cf AS (SELECT repo, commit_hash, max(committed_at) AS t, list_distinct(flatten(list(list_filter(paths, lambda p: p IS NOT NULL AND p <> '')))) AS paths FROM commits WHERE repo IS NOT NULL AND commit_hash IS NOT NULL GROUP BY ALL),
cx AS (SELECT repo, commit_hash, t, unnest(paths) AS p FROM cf WHERE len(paths) BETWEEN 2 AND 100),
cc AS (SELECT x.repo, x.p AS a, y.p AS b, count(*) AS support, sum(pow(0.5, greatest(0, epoch_us(TIMESTAMP '2025-12-31') - epoch_us(x.t)) / 86400000000.0 / 90)) AS weight, max((x.t, x.commit_hash)) AS l FROM cx x JOIN cx y ON x.repo = y.repo AND x.commit_hash = y.commit_hash AND x.p < y.p GROUP BY ALL HAVING count(*) >= 2)"""


def _cochange(s, d):
    return history.co_changes(history.commit_files(table(s, d, "commits")), "2025-12-31 00:00:00")


@query(f"WITH {_COMMITS} SELECT repo, a, b, support, round(weight, 6) AS weight, l[2] AS last_hash FROM cc")
def agg_cochange(s, d):
    return _cochange(s, d).withColumn("weight", F.round("weight", 6))


@query(f"WITH {LN}, {_COMMITS}, f AS (SELECT repo, substr(id, 6) AS p FROM ln WHERE kind = 'file' AND id LIKE 'file:%') SELECT repo, 'file:' || a AS src_id, 'file:' || b AS dst_id, 'co_committed' AS edge_type, CAST(support AS VARCHAR) AS support FROM cc WHERE (repo, a) IN (SELECT repo, p FROM f) AND (repo, b) IN (SELECT repo, p FROM f)")
def agg_cochange_edges(s, d):
    return history.co_change_edges(_cochange(s, d), _nodes(s, d)).drop("weight")


@query(f"WITH {LE}, b AS (SELECT src_repo AS repo, src_id AS id, dst_id AS partner, weight, support FROM le WHERE edge_type = 'co_committed' AND src_repo = dst_repo UNION ALL SELECT src_repo, dst_id, src_id, weight, support FROM le WHERE edge_type = 'co_committed' AND src_repo = dst_repo), g AS (SELECT repo, id, partner, max(weight) AS weight, max(support) AS support FROM b GROUP BY ALL)\nSELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo, id ORDER BY weight DESC NULLS LAST, partner) AS position FROM g) WHERE position <= 20")
def top_cochange_partners(s, d):
    e = _edges(s, d)
    ends = e.where("edge_type = 'co_committed'").select(F.col("src_repo").alias("repo"), F.explode(F.array("src_id", "dst_id")).alias("id"))
    return _long(history.top_partners(e, ends), "position")


@query(
    """WITH o AS (SELECT repo, commit_hash, max(committed_at) AS t, list_distinct(flatten(list(list_filter(paths, lambda p: p IS NOT NULL AND p <> '')))) AS paths FROM commits WHERE repo IS NOT NULL AND commit_hash IS NOT NULL GROUP BY ALL),
s AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY t DESC, commit_hash) AS n FROM o), k AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY t DESC, commit_hash) AS m FROM s WHERE n <= 2000 AND len(paths) BETWEEN 2 AND 100)
SELECT repo, commit_hash, len(paths) AS files FROM k WHERE m <= 500"""
)
def source_git_walk(s, d):
    return history.commit_files(table(s, d, "commits"), keep=500, scan=2000).select("repo", "commit_hash", F.size("paths").cast("long").alias("files"))


_SAID = "(n.name = {0} OR ends_with(n.id, '#' || {0}) OR (n.kind = 'method' AND (ends_with(n.name, '.' || {0}) OR ends_with(n.id, '.' || {0}))))"
_FITS = "(n.path <> '' AND (n.path = file OR ends_with(n.path, '/' || file) OR (starts_with(file, '/') AND ends_with(file, '/' || n.path))))"
_RESOLVED = f"""oc AS (SELECT *, src_repo || '|' || src_id || '|' || dst_repo || '|' || dst_id AS f, length(src_id) % 4 AS v FROM le WHERE edge_type = 'observed_calls'),
oe AS (SELECT f, 'a' AS sid, NULL AS pid, src_repo AS repo, src_id AS id, v FROM oc UNION ALL SELECT f, 'b', 'a', dst_repo, dst_id, v FROM oc),
xs AS (SELECT trace_file, span_id, parent_span_id, name, service, parent, trim(attributes['code.function']) AS fn, trim(attributes['code.filepath']) AS file, attributes['rpc.method'] AS rpc, received_at FROM spans
  UNION ALL SELECT f, sid, pid, CASE v WHEN 2 THEN regexp_extract(id, '([^.#]*)$', 1) WHEN 3 THEN id ELSE 'run' END, repo, NULL, CASE WHEN v < 2 THEN regexp_extract(id, '#(.*)$', 1) END, CASE WHEN v = 0 THEN '/srv/' || {IDPATH.format('id')} END, NULL, NULL FROM oe),
sp AS (SELECT * FROM (SELECT trace_file, lower(trim(span_id)) AS sid, service AS repo, coalesce(name, '') AS name, coalesce(fn, '') AS fn, coalesce(file, '') AS file, coalesce(rpc, '') AS rpc,
    row_number() OVER (PARTITION BY trace_file, lower(trim(span_id)) ORDER BY received_at DESC NULLS LAST, name DESC) AS k FROM xs WHERE span_id IS NOT NULL AND service IS NOT NULL) WHERE k = 1),
q AS MATERIALIZED (SELECT DISTINCT repo, name, fn, file, rpc FROM sp),
x0 AS (SELECT q.*, n.id, rank() OVER (PARTITION BY q.repo, q.name, fn, file, rpc ORDER BY length(n.path) DESC) AS k FROM q JOIN ln n ON n.repo = q.repo AND n.kind IN ('function', 'method') AND fn <> '' AND file <> '' AND {_FITS} AND {_SAID.format('fn')}),
ex AS (SELECT repo, name, fn, file, rpc, min(id) AS id FROM x0 WHERE k = 1 GROUP BY ALL HAVING count(*) = 1),
w AS (SELECT q.*, o, CASE o WHEN 1 THEN fn WHEN 2 THEN file WHEN 3 THEN rpc ELSE name END AS c FROM q, (SELECT unnest([1, 2, 3, 4]) AS o) WHERE NOT EXISTS (SELECT 1 FROM ex WHERE (ex.repo, ex.name, ex.fn, ex.file, ex.rpc) = (q.repo, q.name, q.fn, q.file, q.rpc))),
di AS (SELECT w.repo, w.name, fn, file, rpc, o, min([CASE WHEN n.uri = c THEN '0' WHEN n.id = c THEN '1' ELSE '2' END, n.id]) AS b FROM w JOIN ln n ON n.repo = w.repo AND c <> '' AND (n.uri = c OR n.id = c OR (n.id = 'file:' || c AND (contains(c, '/') OR contains(c, '.')))) GROUP BY ALL),
sy AS (SELECT w.repo, w.name, fn, file, rpc, o, n.id, n.kind IN ('function', 'method') AS code, n.path, file <> '' AND {_FITS} AS fits FROM w JOIN ln n ON n.repo = w.repo AND c <> '' AND {_SAID.format('c')} AND (file = '' OR n.path = '' OR {_FITS})),
sg AS (SELECT repo, name, fn, file, rpc, o, count(*) AS n, min(id) AS one, count(*) FILTER (code) AS nc, min(id) FILTER (code) AS ic, max(length(path)) FILTER (code AND fits) AS deep FROM sy GROUP BY ALL),
sb AS (SELECT sg.repo, sg.name, sg.fn, sg.file, sg.rpc, sg.o, count(*) AS n, min(sy.id) AS id FROM sg JOIN sy ON (sy.repo, sy.name, sy.fn, sy.file, sy.rpc, sy.o) = (sg.repo, sg.name, sg.fn, sg.file, sg.rpc, sg.o) AND sy.code AND sy.fits AND length(sy.path) = deep WHERE nc > 1 GROUP BY ALL),
al AS (SELECT repo, name, fn, file, rpc, o, 0 AS way, b[2] AS id FROM di UNION ALL SELECT repo, name, fn, file, rpc, o, 1, CASE WHEN n = 1 THEN one WHEN nc = 1 THEN ic END FROM sg UNION ALL SELECT repo, name, fn, file, rpc, o, 1, id FROM sb WHERE n = 1),
ot AS (SELECT repo, name, fn, file, rpc, id FROM (SELECT *, row_number() OVER (PARTITION BY repo, name, fn, file, rpc ORDER BY o, way) AS k FROM al WHERE id IS NOT NULL) WHERE k = 1),
rv AS (SELECT sp.trace_file, sp.sid, sp.repo, z.id FROM sp JOIN (SELECT * FROM ex UNION ALL SELECT * FROM ot) z ON (z.repo, z.name, z.fn, z.file, z.rpc) = (sp.repo, sp.name, sp.fn, sp.file, sp.rpc))"""


def _spans_and_observed(s, d):
    """The stored spans, and two spans for each observed call: its ends by file and function, by function, by name, or by id."""
    calls = _edges(s, d).where("edge_type = 'observed_calls'").withColumn("f", F.concat_ws("|", "src_repo", "src_id", "dst_repo", "dst_id")).withColumn("v", F.length("src_id") % 4)
    none = F.lit(None).cast("string")
    both = F.array(*[F.struct(F.lit(sid).alias("span_id"), up.alias("parent_span_id"), F.col(f"{e}_repo").alias("service"), F.col(f"{e}_id").alias("id")) for sid, up, e in (("a", none, "src"), ("b", F.lit("a"), "dst"))])
    rows = calls.select(F.col("f").alias("trace_file"), "v", F.inline(both))
    name = F.when(F.col("v") == 2, F.regexp_extract("id", "([^.#]*)$", 1)).when(F.col("v") == 3, F.col("id")).otherwise("run")
    attributes = F.create_map(F.lit("code.function"), F.when(F.col("v") < 2, F.regexp_extract("id", "#(.*)$", 1)), F.lit("code.filepath"), F.when(F.col("v") == 0, F.concat(F.lit("/srv/"), P.id_path(F.col("id")))))
    time = F.lit(None).cast("timestamp_ntz")
    made = rows.select("trace_file", "span_id", "parent_span_id", name.alias("name"), "service", none.alias("parent"), attributes.alias("attributes"), time.alias("started_at"), time.alias("received_at"))
    return table(s, d, "spans").select(made.columns).unionByName(made)


@query(f"WITH {LN}, {LE}, {_RESOLVED} SELECT trace_file, sid AS span_id, repo, id FROM rv")
def join_span_nodes(s, d):
    return tracing.resolve_spans(_spans_and_observed(s, d), _nodes(s, d))


def _observed_sql() -> str:
    from graphloom.plans.core_queries import _SPANS

    parents = _SPANS[: _SPANS.index("tree AS")].rstrip().rstrip(",").replace("FROM spans)", "FROM xs)").replace("\nt AS", "\ntt AS").replace("FROM t ", "FROM tt t ").replace("FROM t\n", "FROM tt t\n").replace("JOIN t ", "JOIN tt ")
    return f"""WITH {LN}, {LE}, {_RESOLVED}, {parents}
SELECT a.repo AS src_repo, a.id AS src_id, b.repo AS dst_repo, b.id AS dst_id, count(*) AS calls FROM par JOIN rv b ON b.trace_file = par.trace_file AND b.sid = par.sid JOIN rv a ON a.trace_file = par.trace_file AND a.sid = par.parent_id
WHERE a.repo <> b.repo OR a.id <> b.id GROUP BY ALL"""


@query(_observed_sql())
def agg_observed_calls(s, d):
    return tracing.observed_calls(_spans_and_observed(s, d), _nodes(s, d)).drop("last_seen")


@query(f"WITH {LE} SELECT src_repo, src_id, dst_repo, dst_id, calls FROM le WHERE edge_type = 'observed_calls' ORDER BY calls DESC, src_repo, src_id, dst_repo, dst_id LIMIT 20")
def top_hot_paths(s, d):
    return tracing.hot_paths(_edges(s, d))


# -- whole-graph measures ---------------------------------------------------------------
_ENDS = "en AS (SELECT src_repo AS repo, src_id AS id, edge_type FROM le UNION ALL SELECT dst_repo, dst_id, edge_type FROM le)"


@query(f"WITH {LN}, {LE}, {_ENDS} SELECT n.repo, n.id, n.kind, n.name, g.degree FROM (SELECT repo, id, count(*) AS degree FROM en GROUP BY ALL) g JOIN ln n ON n.repo = g.repo AND n.id = g.id")
def agg_hubs(s, d):
    return analysis.hubs(_edges(s, d), _nodes(s, d))


@query(f"WITH {LN}, {LE}, {_ENDS} SELECT n.repo, n.id, n.kind, n.name, g.degree FROM (SELECT repo, id, count(*) AS degree FROM en WHERE edge_type IN ('calls', 'implements', 'consumes', 'inherits', 'references') GROUP BY ALL) g JOIN ln n ON n.repo = g.repo AND n.id = g.id WHERE n.kind IN ('function', 'method', 'type', 'operation')")
def agg_important_symbols(s, d):
    return analysis.hubs(_edges(s, d), _nodes(s, d), analysis.SYMBOLIC, analysis.DEFINITIONS)


@query(
    f"""WITH {LE}, x AS (SELECT src_repo, dst_repo, dst_id, {IDPATH.format('src_id')} AS fp, {IDPATH.format('dst_id')} AS tp FROM le WHERE edge_type IN ('imports', 'calls'))
SELECT repo, path, count(*) AS score FROM (SELECT src_repo AS repo, fp AS path FROM x WHERE fp IS NOT NULL UNION ALL
SELECT dst_repo, tp FROM x WHERE tp IS NOT NULL AND NOT regexp_matches(dst_id, '^(symbol|import):') AND (tp <> coalesce(fp, '') OR src_repo <> dst_repo)) GROUP BY ALL"""
)
def agg_important_files(s, d):
    return analysis.important_files(_edges(s, d), _nodes(s, d))


@query(
    f"""WITH {LE}, y AS (SELECT src_repo, {IDPATH.format('src_id')} AS p, dst_id, trim(trim(regexp_extract(dst_id, '#(.*)$', 1)), chr(34) || chr(39)) AS b FROM le WHERE edge_type = 'imports'),
x AS (SELECT src_repo, p, CASE WHEN NOT starts_with(dst_id, 'import:') THEN {IDPATH.format('dst_id')} WHEN starts_with(b, './') THEN regexp_replace(p, '[^/]*$', '') || substr(b, 3)
  WHEN regexp_matches(p, '\\.(js|jsx|mjs|cjs|ts|tsx|mts|cts)$') AND starts_with(b, '@') AND contains(b, '/') THEN split_part(b, '/', 1) || '/' || split_part(b, '/', 2)
  WHEN regexp_matches(p, '\\.(js|jsx|mjs|cjs|ts|tsx|mts|cts)$') AND NOT starts_with(b, '@') AND NOT starts_with(b, '/') THEN split_part(b, '/', 1) ELSE b END AS spec FROM y WHERE p IS NOT NULL)
SELECT spec, count(DISTINCT (src_repo, p)) AS files FROM x WHERE spec <> '' GROUP BY spec"""
)
def agg_top_imports(s, d):
    return analysis.top_imports(_edges(s, d))


_LANGS = "go:go py:python js:javascript jsx:javascript mjs:javascript cjs:javascript ts:typescript tsx:typescript mts:typescript cts:typescript java:java kt:kotlin kts:kotlin rb:ruby php:php c:c h:c cc:cpp cpp:cpp cxx:cpp hpp:cpp hh:cpp hxx:cpp cs:csharp swift:swift proto:proto graphql:graphql yaml:yaml yml:yaml json:json md:markdown"
_LANG = "coalesce(CASE lower(regexp_extract(p, '\\.([A-Za-z0-9]+)$', 1)) " + " ".join("WHEN '{}' THEN '{}'".format(*x.split(":")) for x in _LANGS.split()) + " END, 'other')"


@query(f"WITH {LN} SELECT repo, {_LANG} AS language, count(*) AS files FROM (SELECT repo, regexp_extract(id, '^file:(.*)$', 1) AS p FROM ln WHERE kind = 'file') GROUP BY ALL")
def agg_language_mix(s, d):
    return analysis.language_mix(_nodes(s, d))


@query(f"WITH {LE} SELECT src_repo AS repo, count(*) FILTER (edge_type = 'imports') AS imports, count(*) FILTER (edge_type = 'imports' AND r) AS imports_resolved, count(*) FILTER (edge_type = 'calls') AS calls, count(*) FILTER (edge_type = 'calls' AND r) AS calls_resolved FROM (SELECT *, NOT regexp_matches(dst_id, '^(symbol|import):') AS r FROM le) GROUP BY ALL")
def agg_coverage(s, d):
    return analysis.coverage(_edges(s, d))


@query(f"WITH {LN}, {LE}, {_ENDS}, g AS (SELECT repo, id, count(*) AS degree FROM en WHERE edge_type <> 'contains' GROUP BY ALL) SELECT n.repo, n.id, coalesce(degree, 0) AS degree FROM ln n LEFT JOIN g ON g.repo = n.repo AND g.id = n.id WHERE n.kind <> 'symbol' AND coalesce(degree, 0) <= 1")
def agg_knowledge_gaps(s, d):
    return analysis.knowledge_gaps(_edges(s, d), _nodes(s, d))


@query(f"WITH {LE}, {VIEW} SELECT * FROM vw")
def graph_dependency_view(s, d):
    return _view(s, d)


def _pagerank_sql(rounds: int = 20) -> str:
    steps = [f"WITH {LE}, {VIEW}, k AS MATERIALIZED (SELECT a_repo || '|' || a AS x, b_repo || '|' || b AS y FROM vw), ns AS MATERIALIZED (SELECT x FROM k UNION SELECT y FROM k), o AS MATERIALIZED (SELECT x, count(*) AS c FROM k GROUP BY x), n AS MATERIALIZED (SELECT count(*) AS n FROM ns), r0 AS MATERIALIZED (SELECT x, 1.0::DOUBLE / n AS r FROM ns, n)"]
    for i in range(rounds):
        steps.append(
            f"r{i + 1} AS MATERIALIZED (SELECT ns.x, 0.15 / n + 0.85 * (SELECT coalesce(sum(r), 0) FROM r{i} WHERE x NOT IN (SELECT x FROM o)) / n + 0.85 * coalesce(g, 0) AS r FROM ns CROSS JOIN n LEFT JOIN (SELECT k.y, sum(r / c) AS g FROM k JOIN r{i} ON r{i}.x = k.x JOIN o ON o.x = k.x GROUP BY k.y) q ON q.y = ns.x)"
        )
    return ",\n".join(steps) + f"\nSELECT split_part(x, '|', 1) AS repo, substr(x, strpos(x, '|') + 1) AS id, round(r * 1000000, 4) AS rank FROM r{rounds}"


@query(_pagerank_sql())
def graph_pagerank(s, d):
    return analysis.pagerank(_view(s, d)).select("repo", "id", F.round(F.col("rank") * 1_000_000, 4).alias("rank"))


def _communities_sql(rounds: int = 15) -> str:
    steps = [f"WITH {LE}, {VIEW}, k AS MATERIALIZED (SELECT DISTINCT u, v FROM (SELECT a_repo || '|' || a AS u, b_repo || '|' || b AS v FROM vw UNION ALL SELECT b_repo || '|' || b, a_repo || '|' || a FROM vw)), l0 AS MATERIALIZED (SELECT DISTINCT u, u AS label FROM k)"]
    for i in range(rounds):
        steps.append(f"l{i + 1} AS MATERIALIZED (SELECT u, label FROM (SELECT t.u, t.label, row_number() OVER (PARTITION BY t.u ORDER BY c DESC, (t.label = o.label) DESC, t.label) AS q FROM (SELECT k.u, l.label, count(*) AS c FROM k JOIN l{i} l ON l.u = k.v GROUP BY ALL) t JOIN l{i} o ON o.u = t.u) WHERE q = 1)")
    return ",\n".join(steps) + f",\nlb AS (SELECT u, label FROM l{rounds})\n"


@query(_communities_sql() + "SELECT split_part(u, '|', 1) AS repo, substr(u, strpos(u, '|') + 1) AS id, label FROM lb")
def graph_communities(s, d):
    return analysis.communities(_view(s, d))


@query(
    _communities_sql()
    + """, pr AS (SELECT DISTINCT least(u, v) AS u, greatest(u, v) AS v FROM k), ii AS (SELECT x.label, count(*) AS pairs FROM pr JOIN lb x ON x.u = pr.u JOIN lb y ON y.u = pr.v WHERE x.label = y.label GROUP BY x.label),
dg AS (SELECT u, count(*) AS d FROM (SELECT u FROM pr UNION ALL SELECT v FROM pr) GROUP BY u),
bs AS (SELECT lb.u, label, coalesce(d, 0) + CASE WHEN regexp_matches(lb.u, '\\|(file|module):') THEN 100 ELSE 0 END AS score FROM lb LEFT JOIN dg ON dg.u = lb.u),
sz AS (SELECT label, count(*) AS members, min([lpad(CAST(1000000000 - score AS VARCHAR), 12, '0'), u])[2] AS name FROM bs GROUP BY label)
SELECT label, members, round(CASE WHEN members <= 1 THEN 1.0 ELSE coalesce(pairs, 0) / (members * (members - 1) / 2) END, 6) AS cohesion, name FROM sz LEFT JOIN ii USING (label)"""
)
def graph_cohesion(s, d):
    view = _view(s, d)
    return analysis.cohesion(view, analysis.communities(view)).withColumn("cohesion", F.round("cohesion", 6))


@query(
    f"""WITH RECURSIVE {LE}, {VIEW}, k AS MATERIALIZED (SELECT DISTINCT a_repo || '|' || a AS u, b_repo || '|' || b AS v FROM vw), rc AS (SELECT u, v FROM k UNION SELECT rc.u, k.v FROM rc JOIN k ON k.u = rc.v)
SELECT x.u, min(x.v) AS component FROM rc x JOIN rc y ON y.u = x.v AND y.v = x.u GROUP BY x.u HAVING min(x.v) <> max(x.v)"""
)
def graph_cycles(s, d):
    return analysis.strong_components(_view(s, d))


@query(
    f"""WITH RECURSIVE {LE}, {VIEW}, k AS MATERIALIZED (SELECT DISTINCT a_repo || '|' || a AS u, b_repo || '|' || b AS v FROM vw), rc AS (SELECT u, v FROM k UNION SELECT rc.u, k.v FROM rc JOIN k ON k.u = rc.v),
co AS MATERIALIZED (SELECT x.u, min(x.v) AS component FROM rc x JOIN rc y ON y.u = x.v AND y.v = x.u GROUP BY x.u HAVING min(x.v) <> max(x.v)),
fm AS (SELECT * FROM co WHERE regexp_matches(u, '\\|(file|module):')), k2 AS MATERIALIZED (SELECT k.u, k.v, x.component FROM k JOIN fm x ON x.u = k.u JOIN fm y ON y.u = k.v AND y.component = x.component WHERE k.u <> k.v),
r2 AS (SELECT u, v, component FROM k2 UNION SELECT r2.u, k2.v, r2.component FROM r2 JOIN k2 ON k2.u = r2.v), rg AS (SELECT DISTINCT component FROM r2 WHERE u = v)
SELECT u, component FROM co WHERE component NOT IN (SELECT component FROM rg) OR u IN (SELECT u FROM fm)"""
)
def graph_file_cycles(s, d):
    view = _view(s, d)
    return analysis.file_cycles(view, analysis.strong_components(view))


@query(
    f"""WITH RECURSIVE {LE}, c AS MATERIALIZED (SELECT DISTINCT src_repo || '|' || src_id AS u, dst_repo || '|' || dst_id AS v FROM le WHERE edge_type = 'calls' AND NOT starts_with(dst_id, 'symbol:')),
t AS (SELECT u, v, 1 AS d, [substr(u, strpos(u, '|') + 1), substr(v, strpos(v, '|') + 1)] AS path FROM c WHERE u <> v UNION SELECT t.u, c.v, d + 1, list_append(path, substr(c.v, strpos(c.v, '|') + 1)) FROM t JOIN c ON c.u = t.v WHERE d < 4 AND c.v <> t.u),
m AS (SELECT u, v, d AS hops, min(path) AS path FROM t GROUP BY u, v, d QUALIFY row_number() OVER (PARTITION BY u, v ORDER BY d) = 1),
z AS (SELECT split_part(u, '|', 1) AS repo, substr(u, strpos(u, '|') + 1) AS source, split_part(v, '|', 1) AS target_repo, substr(v, strpos(v, '|') + 1) AS target, hops, array_to_string(path, ' ') AS path FROM m WHERE hops >= 2)
SELECT * FROM z WHERE repo <> target_repo OR coalesce({IDPATH.format('source')}, '') <> coalesce({IDPATH.format('target')}, '')"""
)
def graph_indirect_traces(s, d):
    return analysis.indirect_traces(_edges(s, d)).withColumn("path", F.array_join("path", " "))


@query(_communities_sql() + "SELECT label, row_number() OVER (ORDER BY members DESC, label) - 1 AS number, members FROM (SELECT label, count(*) AS members FROM lb GROUP BY label)")
def graph_community_numbers(s, d):
    return _long(analysis.numbered_communities(analysis.communities(_view(s, d))), "number")


@query(_communities_sql() + "SELECT label, count(*) AS members FROM lb GROUP BY label HAVING count(*) < 4")
def agg_small_communities(s, d):
    return analysis.small_communities(analysis.communities(_view(s, d)), below=4)


@query(
    f"""WITH RECURSIVE {LE}, {VIEW}, k AS MATERIALIZED (SELECT DISTINCT a_repo || '|' || a AS u, b_repo || '|' || b AS v FROM vw), rc AS (SELECT u, v FROM k UNION SELECT rc.u, k.v FROM rc JOIN k ON k.u = rc.v),
co AS (SELECT x.u, min(x.v) AS component FROM rc x JOIN rc y ON y.u = x.v AND y.v = x.u GROUP BY x.u HAVING min(x.v) <> max(x.v)),
g AS (SELECT component, count(*) AS length, min(CASE WHEN regexp_matches(u, '\\|(file|module):') THEN 1 ELSE 0 END) = 1 AS files_only FROM co GROUP BY component)
SELECT *, row_number() OVER (ORDER BY files_only DESC, length DESC, component) AS position FROM g"""
)
def graph_cycle_list(s, d):
    return _long(analysis.cycle_list(analysis.strong_components(_view(s, d))), "position")


@query()
def graph_betweenness(s, d):
    return analysis.betweenness(_view(s, d)).withColumn("score", F.round("score", 6))


# -- ranking ----------------------------------------------------------------------------
_MULT = "CASE WHEN sig = 1 THEN 1.0 ELSE least(1.40, greatest(0.80, 1 + 0.08 * log2(sig))) END"
_BASES = {"contains": "0.65", "calls": "0.8", "implements": "0.9", "inherits": "0.85", "references": "0.6", "consumes": "0.9", "imports": "0.5", "co_committed": "0.7", "observed_calls": "0.85", "documents": "0.6"}
_12 = "floor(({0}) * 1e12 + 0.5) / 1e12"


def _weighted(bases: dict[str, str]) -> str:
    return f"""bw AS (SELECT *, CASE edge_type {' '.join(f"WHEN '{t}' THEN {w}" for t, w in bases.items())} ELSE 0.3 END::DOUBLE AS base,
  CASE WHEN weight > 0 THEN weight * (1 + 0.1 * log2(greatest(calls, support, 1))) WHEN calls > 0 THEN calls WHEN support > 0 THEN support ELSE 1.0 END::DOUBLE AS sig FROM le),
sw AS (SELECT *, floor((CASE WHEN base <= 0.99 THEN least(base * {_MULT}, 0.99) ELSE base * {_MULT} END) * 1e9 + 0.5) / 1e9 AS w FROM bw),
ad AS MATERIALIZED (SELECT fr, fi, tr, ti, w, reason FROM (SELECT *, row_number() OVER (PARTITION BY fr, fi, tr, ti ORDER BY w DESC, reason DESC) AS q FROM (
  SELECT src_repo AS fr, src_id AS fi, dst_repo AS tr, dst_id AS ti, w, 'out:' || edge_type AS reason FROM sw UNION ALL SELECT dst_repo, dst_id, src_repo, src_id, w, 'in:' || edge_type FROM sw)) WHERE q = 1)"""


_WEIGHTED = _weighted(_BASES)
_STEP = f"SELECT sr, si, repo, id, score, reason FROM (SELECT sr, si, tr AS repo, ti AS id, {_12.format('score * w')} AS score, ad.reason, row_number() OVER (PARTITION BY sr, si, tr, ti ORDER BY {_12.format('score * w')} DESC, ad.reason DESC) AS q FROM {{0}} JOIN ad ON fr = repo AND fi = id) WHERE q = 1"
_NEIGHBORS = f"""l0 AS MATERIALIZED (SELECT repo AS sr, id AS si, repo, id, 1.0::DOUBLE AS score, 'seed' AS reason FROM ln WHERE kind = 'operation'),
l1 AS MATERIALIZED ({_STEP.format('l0')}), l2 AS MATERIALIZED ({_STEP.format('l1')}), l3 AS MATERIALIZED ({_STEP.format('l2')}),
al AS (SELECT *, row_number() OVER (PARTITION BY sr, si, repo, id ORDER BY score DESC, depth, reason DESC) AS q FROM (SELECT *, 0 AS depth FROM l0 UNION ALL SELECT *, 1 FROM l1 UNION ALL SELECT *, 2 FROM l2 UNION ALL SELECT *, 3 FROM l3)),
hn AS (SELECT sr AS seed_repo, si AS seed_id, n.repo, n.id, n.kind, n.name, score, depth, al.reason, row_number() OVER (PARTITION BY sr, si ORDER BY score DESC, depth, n.kind IN ('symbol', 'import'), n.id, n.repo) AS position FROM al JOIN ln n ON n.repo = al.repo AND n.id = al.id WHERE q = 1)"""


@query(f"WITH {LN}, {LE}, {_WEIGHTED} SELECT src_repo, src_id, edge_type, dst_repo, dst_id, round(w, 9) AS w FROM sw")
def rank_signals(s, d):
    w = ranking.edge_weight(F.col("edge_type"), F.col("weight"), F.col("calls"), F.col("support"))
    return _edges(s, d).select(*graph.EDGE, F.round(w, 9).alias("w"))


def _hits(s, d):
    return ranking.neighborhood(_edges(s, d), _nodes(s, d), _kind(s, d, "operation"), depth=3)


@query(f"WITH {LN}, {LE}, {_WEIGHTED}, {_NEIGHBORS} SELECT seed_repo, seed_id, repo, id, kind, name, position, round(score, 9) AS score, depth, reason FROM hn WHERE position <= 32")
def rank_neighborhood(s, d):
    return _long(_hits(s, d).withColumn("score", F.round("score", 9)), "position", "depth")


@query(
    f"""WITH {LN}, {LE}, {_WEIGHTED}, {_NEIGHBORS}, bu AS (SELECT *, sum(48 + octet_length(encode(id)) + octet_length(encode(name)) + octet_length(encode(kind))) OVER (PARTITION BY seed_repo, seed_id ORDER BY position) AS used FROM hn WHERE position <= 32)
SELECT seed_repo, seed_id, repo, id, position, CAST(used AS BIGINT) AS used FROM bu WHERE position = 1 OR used <= 1500"""
)
def rank_budget(s, d):
    return _long(ranking.pack_budget(_hits(s, d), 1500, "id", "name", "kind").select("seed_repo", "seed_id", "repo", "id", "position", "used"), "position", "used")


@query(f"WITH {LN}, {LE}, {_weighted(_BASES | {'co_committed': '0.7::DOUBLE * 0.5', 'observed_calls': '0.85::DOUBLE * 1.2', 'documents': '0.6::DOUBLE * 0.25'})}, {_NEIGHBORS} SELECT seed_repo, seed_id, repo, id, kind, name, position, round(score, 9) AS score, depth, reason FROM hn WHERE position <= 32")
def rank_families(s, d):
    weights = ranking.family_weights({"git": 0.5, "runtime": 1.2, "doc": 0.25})
    return _long(ranking.neighborhood(_edges(s, d), _nodes(s, d), _kind(s, d, "operation"), depth=3, weights=weights).withColumn("score", F.round("score", 9)), "position", "depth")


# -- impact -----------------------------------------------------------------------------
def _walk_sql(near: str, far: str, kind: str) -> str:
    kinds = ("inherits", "implements", "consumes", "calls", "observed_calls", "references", "imports")
    order = "CASE edge_type " + " ".join(f"WHEN '{t}' THEN {i}" for i, t in enumerate(kinds)) + " END"
    hop = f"hp AS MATERIALIZED (SELECT {near}_repo AS fr, {near}_id AS fi, {far}_repo AS repo, {far}_id AS id, edge_type, {order} AS o FROM le WHERE edge_type IN {kinds})"
    level = "SELECT repo, id, {d} AS depth, edge, from_repo, from_id FROM (SELECT h.repo, h.id, h.edge_type AS edge, fr AS from_repo, fi AS from_id, row_number() OVER (PARTITION BY h.repo, h.id ORDER BY o, fr, fi, h.edge_type) AS q FROM hp h JOIN {f} f ON f.repo = fr AND f.id = fi WHERE {seen}) WHERE q = 1"
    no = lambda t: f"NOT EXISTS (SELECT 1 FROM {t} s WHERE s.repo = h.repo AND s.id = h.id)"
    return f"WITH {LN}, {LE}, {hop}, s0 AS MATERIALIZED (SELECT repo, id FROM ln WHERE kind = '{kind}'), w1 AS MATERIALIZED ({level.format(d=1, f='s0', seen=no('s0'))}), w2 AS MATERIALIZED ({level.format(d=2, f='w1', seen=no('s0') + ' AND ' + no('w1'))}), wk AS (SELECT * FROM w1 UNION ALL SELECT * FROM w2)"


@query(_walk_sql("dst", "src", "operation") + " SELECT * FROM wk")
def impact_affected(s, d):
    return impact.walk(_edges(s, d), _kind(s, d, "operation"), 2)


@query(_walk_sql("src", "dst", "module") + " SELECT * FROM wk")
def impact_dependencies(s, d):
    return impact.walk(_edges(s, d), _kind(s, d, "module"), 2, reverse=False)


@query()
def impact_affected_whole(s, d):
    # with contract hops and what nodes stand for; impact_affected has edges only, as its SQL does
    return impact.whole_walk(_edges(s, d), _nodes(s, d), _kind(s, d, "operation"), 2)


@query()
def impact_dependencies_whole(s, d):
    return impact.whole_walk(_edges(s, d), _nodes(s, d), _kind(s, d, "module"), 2, reverse=False)


@query(_walk_sql("dst", "src", "operation") + " SELECT n.repo, n.path, min(depth) AS depth, count(*) AS symbols, string_agg(n.id, ' ' ORDER BY depth, n.start_line, n.id) AS ids FROM wk JOIN ln n ON n.repo = wk.repo AND n.id = wk.id WHERE n.path <> '' GROUP BY ALL")
def agg_impact_files(s, d):
    return impact.by_file(impact.walk(_edges(s, d), _kind(s, d, "operation"), 2), _nodes(s, d), limit=None).withColumn("ids", F.array_join("ids", " "))


@query(f"WITH RECURSIVE {LN}, {LE}, c AS MATERIALIZED (SELECT DISTINCT src_repo, src_id, dst_repo, dst_id FROM le WHERE edge_type = 'contains'), r AS (SELECT repo, id FROM ln WHERE kind = 'package' UNION SELECT dst_repo, dst_id FROM r JOIN c ON c.src_repo = r.repo AND c.src_id = r.id) SELECT * FROM r")
def impact_closure(s, d):
    return impact.closure(_edges(s, d), _kind(s, d, "package"))


@query(
    f"""WITH RECURSIVE {LN}, {LE}, h AS MATERIALIZED (SELECT DISTINCT src_repo, src_id, dst_repo, dst_id FROM le WHERE edge_type IN ('inherits', 'implements', 'consumes', 'calls', 'observed_calls', 'references', 'imports', 'contains')),
b AS (SELECT repo AS seed_repo, id AS seed_id, repo, id, 0 AS hops FROM ln WHERE kind = 'package' UNION SELECT seed_repo, seed_id, dst_repo, dst_id, hops + 1 FROM b JOIN h ON h.src_repo = b.repo AND h.src_id = b.id WHERE hops < 8)
SELECT seed_repo, seed_id, b.repo, b.id, min(hops) AS hops FROM b JOIN ln o ON o.repo = b.repo AND o.id = b.id AND o.kind = 'operation' GROUP BY ALL"""
)
def impact_shortest_path(s, d):
    return impact.shortest_paths(_edges(s, d), _kind(s, d, "package"), _kind(s, d, "operation")).drop("path")


# -- resolution -------------------------------------------------------------------------
_SUFFIXES = ["", ".js", ".jsx", ".ts", ".tsx", ".mjs", ".cjs", "/index.js", "/index.jsx", "/index.ts", "/index.tsx", ".go"]


@query(
    f"""WITH {LN}, {LE}, i AS (SELECT DISTINCT src_repo AS repo, {IDPATH.format('src_id')} AS path, regexp_replace({IDPATH.format('dst_id')}, '\\.[^./]*$', '') AS base FROM le WHERE edge_type = 'imports' AND src_repo = dst_repo AND NOT regexp_matches(dst_id, '^(symbol|import):')),
c AS (SELECT repo, path, repeat('../', len(string_split(path, '/')) - 1) || './' || base AS spec, base || sfx AS target, o FROM i, (SELECT unnest({_SUFFIXES}) AS sfx, unnest(generate_series(1, {len(_SUFFIXES)})) AS o) WHERE path IS NOT NULL AND base IS NOT NULL),
f AS (SELECT DISTINCT repo, regexp_replace(id, '^(file|module):', '') AS target FROM ln WHERE kind IN ('file', 'module') AND regexp_matches(id, '^(file|module):'))
SELECT repo, path, CASE WHEN starts_with(spec, '../') THEN replace(spec, '/./', '/') ELSE spec END AS spec, min_by(target, o) AS target FROM c JOIN f USING (repo, target) GROUP BY ALL"""
)
def resolve_imports(s, d):
    """Resolved imports inside members, written as relative specs without the extension."""
    rows = _edges(s, d).where("edge_type = 'imports' and src_repo = dst_repo").where(~F.col("dst_id").rlike("^(symbol|import):"))
    up = F.expr("repeat('../', size(split(path, '/')) - 1)")
    base = F.regexp_replace(P.id_path(F.col("dst_id")), r"\.[^./]*$", "")
    imports = rows.select(F.col("src_repo").alias("repo"), P.id_path(F.col("src_id")).alias("path"), base.alias("base")).where("path is not null and base is not null")
    imports = imports.select("repo", "path", F.concat(F.when(up == "", "./").otherwise(up), "base").alias("spec"))
    files = _kind(s, d, "file", "module").where(F.col("id").rlike("^(file|module):")).select("repo", F.regexp_replace("id", "^(file|module):", "").alias("path"))
    return resolution.resolve_imports(imports, files)


_FAM = "coalesce(CASE " + _LANG.replace("(p,", "({0},") + " " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in (("javascript", "web"), ("typescript", "web"), ("java", "jvm"), ("kotlin", "jvm"), ("c", "c"), ("cpp", "c"))) + " END, " + _LANG.replace("(p,", "({0},") + ")"
_RECV = r"regexp_extract({0}, '^method:.*#([^#(]+)\.[^.#(]*(?:\(.*)?$', 1)"
_DIR = "regexp_replace({0}, '/?[^/]*$', '')"


@query(
    f"""WITH {LN}, {LE}, c0 AS (SELECT DISTINCT src_repo AS repo, src_id, CASE WHEN starts_with(dst_id, 'symbol:') THEN substr(dst_id, 8) ELSE regexp_extract(dst_id, '#([^(]*)', 1) END AS callee FROM le WHERE edge_type = 'calls' AND src_repo = dst_repo),
c1 AS (SELECT *, regexp_extract(callee, '^(.*)\\.[^.]*$', 1) AS qual, regexp_extract(callee, '([^.]*)$', 1) AS name, coalesce({IDPATH.format('src_id')}, '') AS p, {_RECV.format('src_id')} AS own FROM c0),
c AS (SELECT *, CASE WHEN lower(regexp_extract(p, '\\.([A-Za-z0-9]+)$', 1)) IN ('swift', 'kt', 'kts', 'java', 'cs', 'rb', 'cc', 'cpp', 'cxx', 'hpp', 'hh', 'hxx') THEN own ELSE '' END AS self FROM c1),
f AS (SELECT repo, name, id, kind, coalesce({IDPATH.format('id')}, '') AS q, {_RECV.format('id')} AS recv FROM ln WHERE kind IN ('function', 'method') AND name <> ''),
im AS (SELECT DISTINCT repo, coalesce({IDPATH.format('id')}, path) AS p, name AS imp FROM ln WHERE kind = 'import' AND name <> ''),
im2 AS (SELECT repo, p, CASE WHEN starts_with(imp, './') THEN {_DIR.format('p')} || substr(imp, 2) END AS near, CASE WHEN NOT starts_with(imp, '.') THEN imp END AS far, replace(imp, '.', '/') AS slashed FROM im),
j AS (SELECT c.*, f.id, f.kind, f.q, f.recv, replace(qual, '.', '/') AS sq, {_DIR.format('f.q')} AS qdir FROM c JOIN f ON f.repo = c.repo AND f.name = c.name),
im3 AS (SELECT DISTINCT j.repo, j.src_id, j.callee, j.id FROM j JOIN im2 ON im2.repo = j.repo AND im2.p = j.p WHERE
  (near IS NOT NULL AND near IN (qdir, regexp_replace(q, '\\.[^./]*$', ''), q) AND (sq = '' OR near = sq OR ends_with(near, '/' || sq)))
  OR (far IS NOT NULL AND qdir <> '' AND (far = qdir OR ends_with(far, '/' || qdir) OR slashed = qdir OR ends_with(slashed, '/' || qdir)) AND (sq = '' OR qdir = sq OR ends_with(qdir, '/' || sq)))),
k AS (SELECT j.*, q = p AS same_file, self <> '' AND recv = self AS same_type, qdir = {_DIR.format('p')} AS same_dir, im3.id IS NOT NULL AS imported,
  kind = 'method' AND recv <> '' AND CASE WHEN qual IN ('self', 'this', 'Self') THEN recv = own ELSE recv IN (SELECT unnest(list_filter(string_split(qual, '.'), lambda x: x NOT IN ('self', 'this', 'Self', '')))) OR (split_part(qual, '.', 1) = 'Self' AND recv = own) END AS typed
  FROM j LEFT JOIN im3 ON im3.repo = j.repo AND im3.src_id = j.src_id AND im3.callee = j.callee AND im3.id = j.id),
g AS (SELECT repo, src_id, callee, any_value(qual) = '' AS bare,
  count(*) FILTER (same_file) AS n1, min(id) FILTER (same_file) AS i1, count(*) FILTER (same_file AND same_type) AS t1, min(id) FILTER (same_file AND same_type) AS it1, count(*) FILTER (same_file AND kind = 'function') AS f1, min(id) FILTER (same_file AND kind = 'function') AS if1,
  count(*) FILTER (same_type) AS nb, min(id) FILTER (same_type) AS ib,
  count(*) FILTER (same_dir) AS n2, min(id) FILTER (same_dir) AS i2, count(*) FILTER (same_dir AND same_type) AS t2, min(id) FILTER (same_dir AND same_type) AS it2, count(*) FILTER (same_dir AND kind = 'function') AS f2, min(id) FILTER (same_dir AND kind = 'function') AS if2,
  count(*) FILTER (imported) AS n3, min(id) FILTER (imported) AS i3, count(*) FILTER (imported AND same_type) AS t3, min(id) FILTER (imported AND same_type) AS it3, count(*) FILTER (imported AND kind = 'function') AS f3, min(id) FILTER (imported AND kind = 'function') AS if3,
  count(*) FILTER (typed) AS nq, min(id) FILTER (typed) AS iq, count(*) AS n4, min(id) AS i4, min(kind) AS k4 FROM k GROUP BY repo, src_id, callee),
r AS (SELECT repo, src_id, callee, CASE
  WHEN bare AND n1 > 0 THEN [CASE WHEN n1 = 1 THEN i1 WHEN t1 = 1 THEN it1 WHEN f1 = 1 THEN if1 END, '1']
  WHEN bare AND nb > 0 THEN [CASE WHEN nb = 1 THEN ib END, '1b']
  WHEN bare AND n2 > 0 THEN [CASE WHEN n2 = 1 THEN i2 WHEN t2 = 1 THEN it2 WHEN f2 = 1 THEN if2 END, '2']
  WHEN n3 > 0 THEN [CASE WHEN n3 = 1 THEN i3 WHEN t3 = 1 THEN it3 WHEN f3 = 1 THEN if3 END, '3']
  WHEN NOT bare THEN [CASE WHEN nq = 1 THEN iq END, '3b']
  WHEN n4 = 1 AND k4 = 'function' AND callee NOT IN ('append', 'cap', 'clear', 'close', 'complex', 'copy', 'delete', 'error', 'imag', 'len', 'log', 'make', 'max', 'min', 'new', 'panic', 'print', 'printf', 'println', 'real', 'recover', 'require') THEN [i4, '4'] END AS x FROM g)
SELECT repo, src_id, callee, x[1] AS id, x[2] AS tier, CASE WHEN x[2] = '1' THEN 'EXTRACTED' ELSE 'INFERRED' END AS provenance FROM r WHERE x[1] IS NOT NULL AND x[1] <> src_id"""
)
def resolve_callees(s, d):
    """All calls inside members, resolved or not, from their callees' names."""
    calls = _edges(s, d).where("edge_type = 'calls' and src_repo = dst_repo")
    callee = F.when(F.col("dst_id").startswith("symbol:"), F.expr("substr(dst_id, 8)")).otherwise(F.regexp_extract("dst_id", r"#([^(]*)", 1))
    return resolution.resolve_callees(calls.select(F.col("src_repo").alias("repo"), "src_id", callee.alias("callee")), _nodes(s, d))


@query(
    f"""WITH {LN}, {LE}, u AS (SELECT DISTINCT src_repo AS repo, src_id, regexp_extract(dst_id, '#(.*)$', 1) AS type_name, {_FAM.format(IDPATH.format('src_id'))} AS fam FROM le WHERE edge_type IN ('references', 'inherits') AND starts_with(dst_id, 'type:')),
o AS (SELECT repo, name AS type_name, {_FAM.format(IDPATH.format('id'))} AS fam, min(id) AS id FROM ln WHERE kind = 'type' AND name <> '' GROUP BY ALL HAVING count(*) = 1)
SELECT repo, src_id, type_name, id, CASE WHEN {IDPATH.format('src_id')} = {IDPATH.format('id')} THEN 'EXTRACTED' ELSE 'INFERRED' END AS provenance FROM u JOIN o USING (repo, type_name, fam)"""
)
def resolve_types(s, d):
    uses = _edges(s, d).where("edge_type in ('references', 'inherits')").where(F.col("dst_id").startswith("type:"))
    return resolution.resolve_types(uses.select(F.col("src_repo").alias("repo"), "src_id", F.regexp_extract("dst_id", "#(.*)$", 1).alias("type_name")), _nodes(s, d))


def _markdown(s, d):
    return table(s, d, "documents").where("lang = 'markdown' and source = 'docs' and text is not null and repo is not null and path is not null")


@query(
    f"""WITH {LN}, {LE}, w AS (SELECT DISTINCT src_repo AS repo, {IDPATH.format('src_id')} AS path, n.id, n.kind, n.name FROM le JOIN ln n ON n.repo = dst_repo AND n.id = dst_id WHERE edge_type = 'documents' AND src_repo = dst_repo AND {IDPATH.format('src_id')} IS NOT NULL),
m AS (SELECT repo, path, 'code' AS how, id AS mention, 2 AS line FROM w WHERE kind = 'operation' UNION SELECT repo, path, 'code', name, 3 FROM w WHERE kind <> 'operation' AND name <> ''
  UNION SELECT repo, path, 'type', name, 4 FROM w WHERE regexp_matches(name, '^[A-Z][A-Za-z0-9]+$') AND regexp_matches(name, '[A-Z].*[A-Z]') AND regexp_matches(name, '[a-z]')
  UNION SELECT repo, path, 'path', {IDPATH.format('id')}, 5 FROM w WHERE regexp_matches({IDPATH.format('id')}, '^[A-Za-z0-9_./-]+\\.(go|ts|tsx|mts|cts|js|jsx|mjs|cjs|py|swift|md)$')
  UNION SELECT repo, path, 'code', {IDPATH.format('id')}, 6 FROM w WHERE {IDPATH.format('id')} IS NOT NULL),
ons AS (SELECT repo, name AS mention, min(id) AS id FROM ln WHERE kind NOT IN ('symbol', 'import', 'doc', 'heading') AND name <> '' GROUP BY ALL HAVING count(*) = 1),
ont AS (SELECT repo, name AS mention, min(id) AS id FROM ln WHERE kind = 'type' AND name <> '' GROUP BY ALL HAVING count(*) = 1),
fl AS (SELECT repo, substr(id, 6) AS mention, id FROM ln WHERE starts_with(id, 'file:')),
h AS (SELECT m.repo, m.path, ln.id, line FROM m JOIN ln ON ln.repo = m.repo AND ln.id = mention WHERE how = 'code'
  UNION ALL SELECT m.repo, m.path, fl.id, line FROM m JOIN fl USING (repo, mention) WHERE how = 'path' OR (how = 'code' AND contains(mention, '/'))
  UNION ALL SELECT m.repo, m.path, ons.id, line FROM m JOIN ons USING (repo, mention) WHERE how = 'code' AND NOT EXISTS (SELECT 1 FROM ln x WHERE x.repo = m.repo AND x.id = m.mention) AND NOT (contains(mention, '/') AND EXISTS (SELECT 1 FROM fl x WHERE x.repo = m.repo AND x.mention = m.mention))
  UNION ALL SELECT m.repo, m.path, ont.id, line FROM m JOIN ont USING (repo, mention) WHERE how = 'type')
SELECT repo, path, id, min(line) AS line FROM h WHERE id <> 'file:' || path GROUP BY ALL"""
)
def resolve_doc_links(s, d):
    """Texts that mention what edges say they document: by id, name, bare type name, path and quoted path, a line each."""
    edges = _edges(s, d).where("edge_type = 'documents' and src_repo = dst_repo").withColumn("path", P.id_path(F.col("src_id"))).where("path is not null")
    what = edges.select(F.col("src_repo").alias("repo"), "path", F.col("dst_id").alias("id")).join(_nodes(s, d).select("repo", "id", "kind", "name"), ["repo", "id"])
    own, quoted = P.id_path(F.col("id")), lambda c: F.concat(F.lit("`"), c, F.lit("`"))
    lines = F.concat_ws(
        "\n",
        F.lit("# All of it"),
        F.when(F.col("kind") == "operation", quoted(F.col("id"))).otherwise(""),
        F.when((F.col("kind") != "operation") & (F.col("name") != ""), quoted(F.col("name"))).otherwise(""),
        F.when(F.col("name").rlike("^[A-Za-z0-9]+$"), F.col("name")).otherwise(""),
        F.coalesce(own, F.lit("")),
        F.coalesce(quoted(own), F.lit("")),
    )
    texts = what.select("repo", "path", lines.alias("text"))
    return resolution.link_docs(resolution.doc_mentions(texts), _nodes(s, d))


@query(
    """WITH w AS (SELECT repo, path, unnest(regexp_extract_all(text, '\\b([A-Z][A-Za-z0-9]+)\\b', 1)) AS word FROM documents WHERE lang = 'markdown' AND source = 'docs' AND text IS NOT NULL AND repo IS NOT NULL AND path IS NOT NULL)
SELECT repo, path, word, count(*) AS n FROM w WHERE regexp_matches(word, '[A-Z].*[A-Z]') AND regexp_matches(word, '[a-z]') GROUP BY ALL"""
)
def resolve_camel_mentions(s, d):
    return resolution.camel_mentions(_markdown(s, d))


@query(
    f"""WITH RECURSIVE {LN}, {LE}, n AS (SELECT repo, id, {IDPATH.format('id')} AS own FROM ln WHERE kind NOT IN ('symbol', 'import')), c AS MATERIALIZED (SELECT DISTINCT src_repo, src_id, dst_repo, dst_id FROM le WHERE edge_type = 'contains'),
w AS (SELECT repo, id, repo AS r, id AS i, 0 AS d FROM n WHERE own IS NULL UNION SELECT w.repo, w.id, src_repo, src_id, d + 1 FROM w JOIN c ON dst_repo = r AND dst_id = i WHERE {IDPATH.format('i')} IS NULL AND d < 50),
o AS (SELECT repo, id, min([lpad(CAST(d AS VARCHAR), 3, '0'), {IDPATH.format('i')}])[2] AS owner FROM w WHERE {IDPATH.format('i')} IS NOT NULL GROUP BY ALL)
SELECT n.repo, n.id, coalesce(own, owner) AS owner FROM n LEFT JOIN o ON o.repo = n.repo AND o.id = n.id"""
)
def resolve_file_owner(s, d):
    return resolution.file_owner(_nodes(s, d), _edges(s, d))


_FILES = "SELECT repo, path, max(CASE WHEN text IS NULL THEN '' ELSE text END) AS text FROM documents WHERE repo IS NOT NULL AND path IS NOT NULL {0} GROUP BY repo, path"


@query(f"WITH o AS (SELECT repo, path, sha256(text) AS h FROM ({_FILES.format(chr(65) + 'ND added_at < TIMESTAMP ' + chr(39) + '2025-01-01' + chr(39))})), n AS (SELECT repo, path, sha256(text) AS h FROM ({_FILES.format('')})) SELECT repo, path, CASE WHEN o.h IS NULL THEN 'add' WHEN n.h IS NULL THEN 'delete' WHEN o.h = n.h THEN 'skip' ELSE 'replace' END AS action FROM o FULL JOIN n USING (repo, path)")
def source_scan_changes(s, d):
    docs = table(s, d, "documents").where("repo is not null and path is not null")
    prints = lambda df: df.groupBy("repo", "path").agg(F.max(F.coalesce("text", F.lit(""))).alias("t")).select("repo", "path", F.sha2(F.encode("t", "utf-8"), 256).alias("sha256"))
    return resolution.scan_changes(prints(docs.where(F.col("added_at") < F.lit("2025-01-01").cast("timestamp_ntz"))), prints(docs))


# -- derived families, members, lines ---------------------------------------------------
_DERIVED = f"""{_COMMITS}, f AS (SELECT repo, substr(id, 6) AS p FROM ln WHERE kind = 'file' AND id LIKE 'file:%'),
ce AS (SELECT repo AS src_repo, 'file:' || a AS src_id, 'co_committed' AS edge_type, repo AS dst_repo, 'file:' || b AS dst_id FROM cc WHERE (repo, a) IN (SELECT repo, p FROM f) AND (repo, b) IN (SELECT repo, p FROM f)),
ol AS (SELECT src_repo, src_id, edge_type, dst_repo, dst_id FROM le WHERE edge_type = 'co_committed')"""


def _co_change_family(s, d):
    pairs = history.co_change_edges(_cochange(s, d), _nodes(s, d))
    return pairs.select(F.col("repo").alias("src_repo"), "src_id", "edge_type", F.col("repo").alias("dst_repo"), "dst_id")


@query(f"WITH {LN}, {LE}, {_DERIVED} SELECT *, 'delete' AS action FROM (SELECT * FROM ol EXCEPT SELECT * FROM ce) UNION ALL SELECT *, 'upsert' FROM (SELECT * FROM ce EXCEPT SELECT * FROM ol)")
def agg_edge_changes(s, d):
    return graph.edge_changes(_edges(s, d).where("edge_type = 'co_committed'"), _co_change_family(s, d))


@query(f"WITH {LN}, {LE}, {_DERIVED} SELECT src_repo, src_id, edge_type, dst_repo, dst_id FROM le WHERE edge_type <> 'co_committed' UNION ALL SELECT * FROM ce")
def sink_replace_family(s, d):
    return graph.replace_family(_edges(s, d).select(*graph.EDGE), ("co_committed",), _co_change_family(s, d))


@query(f"WITH {LN} SELECT id, CASE WHEN count(DISTINCT repo) = 1 THEN min(repo) END AS repo, count(DISTINCT repo) AS members FROM ln WHERE kind IN ('file', 'module', 'symbol') GROUP BY id")
def filter_owners(s, d):
    nodes = _nodes(s, d)
    return graph.owners(nodes, nodes.where("kind in ('file', 'module', 'symbol')"))


@query(f"WITH {LN}, m AS (SELECT service AS member FROM spans UNION SELECT repo FROM hubs UNION SELECT dst_repo FROM edges UNION SELECT repo || '-old' FROM commits) SELECT member FROM m WHERE member IS NOT NULL AND member NOT IN (SELECT repo FROM ln)")
def scan_missing_members(s, d):
    """Members that spans, hubs, edges or (renamed) commits speak of, without a node."""
    said = table(s, d, "spans").select(F.col("service").alias("member")).union(table(s, d, "hubs").select("repo")).union(table(s, d, "edges").select("dst_repo")).union(table(s, d, "commits").select(F.concat("repo", F.lit("-old"))))
    return graph.missing_members(said, _nodes(s, d))


@query(
    f"""WITH {LN}, p AS (SELECT DISTINCT src_repo AS repo, {IDPATH.format('src_id')} AS path, try_cast(props['line'] AS INT) AS line FROM edges WHERE edge_type = 'calls' AND src_repo IS NOT NULL),
h AS (SELECT p.repo, p.path, line, n.id, row_number() OVER (PARTITION BY p.repo, p.path, line ORDER BY end_line - start_line, n.id) AS k FROM p JOIN ln n ON n.repo = p.repo AND n.path = p.path AND n.kind IN ('function', 'method') AND n.start_line >= 1 AND line BETWEEN n.start_line AND n.end_line WHERE p.path IS NOT NULL AND p.path <> '')
SELECT repo, path, line, id FROM h WHERE k = 1"""
)
def join_line_owners(s, d):
    """The functions around the lines of all calls."""
    calls = table(s, d, "edges").where("edge_type = 'calls' and src_repo is not null")
    places = calls.select(F.col("src_repo").alias("repo"), P.id_path(F.col("src_id")).alias("path"), F.expr("try_cast(props['line'] as int)").alias("line")).where("path is not null and line is not null")
    return lookup.line_owners(_nodes(s, d), places)
