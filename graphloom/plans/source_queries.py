"""Queries over sources, sinks and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from graphloom.functions import paths as P
from graphloom.operators import analysis, graph, http, lookup
from graphloom.plans.graph_queries import _ENDS, LE, LN, VIEW
from graphloom.plans.iterate import cut, ensure_checkpoint_dir, written
from graphloom.plans.tables import table
from graphloom.sources import documents, extract, files, snapshot, store
from graphloom.sources import http as http_source
from graphloom.streaming import ingest

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _docs(s: SparkSession, d: str, where: str) -> DataFrame:
    return table(s, d, "documents").where("text is not null and repo is not null and path is not null").where(where)


@query(
    r"""SELECT doc_id, regexp_matches(h, '(?m)^[\s{]*["'']?openapi["'']?\s*:\s*["'']?3\.') AS openapi, regexp_matches(h, '(?m)^\s*(type|schema|extend|interface|enum|input|union|scalar|directive)\b') AS graphql,
regexp_matches(h, '(?m)^\s*(syntax\s*=|package\s+\w[\w.]*\s*;|import\s+"|service\s+\w|message\s+\w|enum\s+\w)') AS proto FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '^\x{FEFF}', '') AS h FROM documents)"""
)
def source_sniff(s, d):
    return table(s, d, "documents").select("doc_id", *[files.is_contract(k, F.col("text")).alias(k) for k in ("openapi", "graphql", "proto")])


@query(
    r"""WITH t AS (SELECT doc_id, repo, path, string_split_regex(text, '\r?\n') AS ls FROM documents WHERE text IS NOT NULL AND repo IS NOT NULL AND path IS NOT NULL AND lang = 'markdown'),
l AS (SELECT repo, path, doc_id, unnest(ls) AS t, unnest(generate_series(1, len(ls))) AS line FROM t),
f AS (SELECT *, count(*) FILTER (starts_with(t, '```')) OVER (PARTITION BY repo, path ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) % 2 = 1 AS fenced FROM l),
h AS (SELECT repo, path, line, length(regexp_extract(t, '^(#+)', 1)) AS level, trim(regexp_extract(t, '^#+\s+(.*?)\s*#*\s*$', 1)) AS title FROM f WHERE NOT fenced AND regexp_matches(t, '^#{1,6}\s+\S')),
n AS (SELECT *, row_number() OVER (PARTITION BY repo, path, title ORDER BY line) AS n FROM h)
SELECT repo, path, line, level, title, 'heading:' || path || '#' || title || CASE WHEN n > 1 THEN '~' || n ELSE '' END AS id FROM n"""
)
def source_markdown(s, d):
    return documents.markdown_headings(_docs(s, d, "lang = 'markdown'")).withColumn("line", F.col("line").cast("long")).withColumn("level", F.col("level").cast("long"))


@query(
    """WITH j AS (SELECT doc_id, unnest(CAST(json_extract(text, '$.spans') AS JSON[])) AS s FROM documents WHERE source = 'trace' AND json_valid(text))
SELECT doc_id, coalesce(s->>'$.spanId', s->>'$.span_id') AS span_id, coalesce(s->>'$.parentSpanId', s->>'$.parent_span_id') AS parent_span_id, s->>'$.name' AS name, s->>'$.service' AS service, s->>'$.parent' AS parent FROM j"""
)
def source_spans(s, d):
    docs = table(s, d, "documents").where("source = 'trace' and text is not null")
    # the JSON reader stops after one value: texts cut short, or with prose behind, are no trace files
    whole = docs.where(F.try_parse_json("text").isNotNull() & F.btrim("text", F.lit(" \t\r\n")).endswith("}"))
    return documents.parse_spans(whole).drop("attributes")


@query(
    r"""WITH t AS (SELECT repo, path, regexp_replace(regexp_replace(text, '(?s)\"\"\".*?\"\"\"', '', 'g'), '#[^\n]*', '', 'g') AS b FROM documents WHERE text IS NOT NULL AND repo IS NOT NULL AND path IS NOT NULL AND lang = 'graphql'),
k AS (SELECT repo, path, unnest(regexp_extract_all(b, '((?:extend\s+)?(?:type|interface|input|enum)\s+\w+[^{]*\{[^}]*\})', 1)) AS b FROM t),
r AS (SELECT repo, path, regexp_extract(b, '(?:type|interface|input|enum)\s+(\w+)', 1) AS type_name, regexp_extract(b, '(type|interface|input|enum)\s', 1) AS gql_kind, unnest(regexp_extract_all(regexp_extract(b, '(?s)\{(.*)\}', 1), '(?m)^\s*(\w+)', 1)) AS field FROM k)
SELECT DISTINCT *, CASE WHEN type_name IN ('Query', 'Mutation', 'Subscription') THEN 'operation' ELSE 'field' END AS role FROM r""".replace('\\"', '"')
)
def source_graphql(s, d):
    return documents.graphql_fields(_docs(s, d, "lang = 'graphql'"))


@query()
def source_proto(s, d):
    return documents.proto_items(_docs(s, d, "lang = 'proto'"))


@query()
def source_openapi(s, d):
    return documents.openapi_operations(_docs(s, d, "lang in ('yaml', 'json') and source = 'contract'"))


@query()
def source_extract(s, d):
    parsed = extract.parse_files(_docs(s, d, "source = 'code'"))
    return parsed.select("repo", "path", F.inline("nodes"))


@query(f"WITH {LN} SELECT repo, id, regexp_extract(uri, '^repo://([A-Za-z0-9._-]+)/([^#]*)#([a-z]+)(?::(.*))?$', 1) AS uri_repo, url_decode(replace(regexp_extract(uri, '^repo://([A-Za-z0-9._-]+)/([^#]*)#([a-z]+)(?::(.*))?$', 2), '+', '%2B')) AS uri_path, regexp_extract(uri, '^repo://([A-Za-z0-9._-]+)/([^#]*)#([a-z]+)(?::(.*))?$', 3) AS uri_kind FROM ln WHERE regexp_matches(uri, '^repo://([A-Za-z0-9._-]+)/([^#]*)#([a-z]+)(?::(.*))?$')")
def expr_parse_uri(s, d):
    nodes = graph.live_nodes(table(s, d, "nodes")).withColumn("u", P.parse_uri(F.col("uri"))).where("u is not null")
    return nodes.select("repo", "id", F.col("u.repo").alias("uri_repo"), F.col("u.path").alias("uri_path"), F.col("u.kind").alias("uri_kind"))


@query(f"WITH {LN} SELECT regexp_replace(url_decode(replace(trim(uri), '+', '%2B')), '^repo://[^/]*/', 'repo://one/') AS uri, count(DISTINCT (repo, id)) AS nodes FROM ln WHERE uri <> '' GROUP BY 1 HAVING count(DISTINCT (repo, id)) > 1")
def source_uri_conflicts(s, d):
    """Conflicts if all members' snapshots were imported under one name."""
    nodes = graph.live_nodes(table(s, d, "nodes"))
    return snapshot.uri_conflicts(nodes.withColumn("uri", F.regexp_replace("uri", "^(\\s*)repo://[^/]*/", "repo://one/")))


def _graph(s, d):
    nodes = graph.live_nodes(table(s, d, "nodes"))
    edges = graph.between_live(graph.live_edges(table(s, d, "edges")), nodes)
    return nodes, edges


_LEL = """lel AS (SELECT DISTINCT src_repo, src_id, edge_type, dst_repo, dst_id FROM edges WHERE coalesce(src_id, '') <> '' AND coalesce(dst_id, '') <> '' AND edge_type IS NOT NULL
  AND (src_repo, src_id) IN (SELECT repo, id FROM ln) AND (dst_repo, dst_id) IN (SELECT repo, id FROM ln))"""


@query(f"WITH {LN}, {_LEL} SELECT * FROM lel WHERE (src_repo, src_id) NOT IN (SELECT repo, id FROM ln WHERE kind = 'import') AND (dst_repo, dst_id) NOT IN (SELECT repo, id FROM ln WHERE kind = 'import')")
def sink_delete_nodes(s, d):
    nodes, edges = _graph(s, d)
    return store.delete_nodes(nodes, edges, nodes.where("kind = 'import'"))[1].select(*graph.EDGE)


@query(f"WITH {LN}, {_LEL}, u AS (SELECT src_repo AS repo, src_id AS id FROM lel UNION SELECT dst_repo, dst_id FROM lel) SELECT repo, id, kind FROM ln WHERE kind <> 'symbol' OR (repo, id) IN (SELECT repo, id FROM u)")
def sink_prune_placeholders(s, d):
    return store.prune_placeholders(*_graph(s, d)).select("repo", "id", "kind")


@query()
def sink_replace_files(s, d):
    """The stored graph after all code documents were parsed again."""
    nodes, edges = _graph(s, d)
    code = _docs(s, d, "source = 'code'")
    parsed = written(extract.parse_files(code))  # the texts are parsed once
    new_nodes = parsed.select("repo", F.inline("nodes"), "path").withColumn("uri", F.lit("")).select(*nodes.columns)
    new_edges = parsed.select("repo", F.inline("edges")).select(F.col("repo").alias("src_repo"), F.col("src").alias("src_id"), F.col("type").alias("edge_type"), F.col("repo").alias("dst_repo"), F.col("dst").alias("dst_id"), F.lit(None).cast("double").alias("weight"), F.lit(0).alias("support"), F.lit(0).alias("calls")).select(*edges.columns)
    return store.replace_files(nodes, edges, code, new_nodes, new_edges)[1].select(*graph.EDGE)


@query("SELECT service, date_trunc('hour', started_at) AS hour, count(DISTINCT (coalesce(trace_file, '?'), span_id, started_at)) AS spans FROM spans WHERE span_id IS NOT NULL AND started_at IS NOT NULL GROUP BY ALL")
def stream_span_counts(s, d):
    """Counts of a finished stream over the span files, kept in the shared folder."""
    base = f"{ensure_checkpoint_dir(s)}/stream-{uuid.uuid4().hex[:8]}"
    rows = s.readStream.schema(table(s, d, "spans").schema).parquet(f"{d}/spans.parquet*")
    stream = ingest.new_spans(rows).writeStream.option("checkpointLocation", f"{base}/log").trigger(availableNow=True)
    stream.foreachBatch(ingest.counts_on_arrival(f"{base}/out")).start().awaitTermination()
    kept = ingest.kept_counts(s.read.parquet(f"{base}/out"))
    return kept.select("service", F.col("window.start").cast("timestamp_ntz").alias("hour"), "spans")


@query(
    """WITH o AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS n FROM events WHERE ts IS NOT NULL AND user_id IS NOT NULL),
g AS (SELECT user_id, ts, sum(n) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM o) SELECT user_id, min(ts) AS started, count(*) AS events FROM g GROUP BY user_id, k"""
)
def stream_sessions(s, d):
    got = ingest.sessions(table(s, d, "events").where("ts is not null and user_id is not null"))
    return got.select("user_id", F.col("session.start").cast("timestamp_ntz").alias("started"), "events")


# -- HTTP surface and lookups -----------------------------------------------------------
@query()
def source_http_surface(s, d):
    return http_source.http_surface(_docs(s, d, "source = 'code'")).withColumn("tokens", F.array_join("tokens", ","))


_SERVED = r"""op AS (SELECT DISTINCT repo, path, regexp_extract(id, '^operation:[^#]*#([A-Z]+) (/.*)$', 1) AS m, regexp_extract(id, '^operation:[^#]*#([A-Z]+) (/.*)$', 2) AS p FROM ln WHERE regexp_matches(id, '^operation:[^#]*#(GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS) (/.*)$') AND path <> '')"""


def _served(s, d):
    """A router text (repo, path, text) for each operation, mounted under ``/v1``."""
    part = lambda k: F.regexp_extract("id", "^operation:[^#]*#(GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS) (/.*)$", k)
    ops = graph.live_nodes(table(s, d, "nodes")).where("path <> ''").select("repo", "path", part(1).alias("m"), part(2).alias("p")).where("m <> ''").distinct()
    lines = F.concat(F.lit("const app = express()\nconst api = express.Router()\napp.use('/v1', api)\napi."), F.lower("m"), F.lit("('"), F.regexp_replace("p", r"\{\}", ":id"), F.lit("', auth({ a: [1] }), serve)\n"))
    return ops.select("repo", F.concat("path", F.lit(".js")).alias("path"), lines.alias("text"))


@query(
    f"""WITH {LN}, {_SERVED} SELECT repo, path || '.js' AS path, unnest(['router', 'router', 'mount', 'route']) AS kind, unnest(['app', 'api', 'app', 'api']) AS name, unnest(['', '', '', m]) AS method, unnest(['', '', '/v1', replace(p, '{{}}', ':id')]) AS value,
'' AS tokens, unnest(['app', '', 'api', 'serve']) AS target, unnest([0, 0, 3, 4]) AS line FROM op"""
)
def source_http_operations(s, d):
    got = http_source.http_surface(_served(s, d))
    return got.withColumn("tokens", F.array_join("tokens", ","))


@query(f"WITH {LN}, {_SERVED} SELECT repo, path || '.js' AS path, m AS method, '/v1' || p AS route, 'serve' AS handler, true AS mounted FROM op")
def source_http_routes(s, d):
    """Routes of all code texts (those of the tables declare none), and of the texts written for operations."""
    texts = _docs(s, d, "source = 'code'").select("repo", "path", "text").unionByName(_served(s, d))
    # the texts are read once, not for every use of their rows
    return http.compose_routes(cut(http_source.http_surface(texts))).drop("key")


@query(
    f"""WITH {LN}, t AS (SELECT repo, path, string_split_regex(max(text), '\\r?\\n') AS ls FROM documents WHERE source = 'code' AND text IS NOT NULL AND repo IS NOT NULL AND path IS NOT NULL GROUP BY repo, path),
j AS (SELECT n.repo, n.id, n.name, n.start_line AS a, n.end_line AS b, ls FROM ln n JOIN t ON t.repo = n.repo AND t.path = n.path WHERE n.path <> ''),
k AS (SELECT repo, id, CASE WHEN a >= 1 AND b >= a AND a <= len(ls) THEN array_to_string(ls[a:b], chr(10)) WHEN name <> '' THEN list_filter(ls, lambda x: contains(x, name))[1] END AS snippet FROM j)
SELECT repo, id, snippet FROM k WHERE snippet IS NOT NULL"""
)
def join_snippets(s, d):
    texts = _docs(s, d, "source = 'code'").groupBy("repo", "path").agg(F.max("text").alias("text"))
    return lookup.snippets(graph.live_nodes(table(s, d, "nodes")), texts)


@query(
    f"""WITH {LN}, t AS (SELECT repo, path, string_split_regex(max(text), '\\r?\\n') AS ls FROM documents WHERE text IS NOT NULL AND repo IS NOT NULL AND path IS NOT NULL GROUP BY repo, path),
l AS (SELECT DISTINCT n.repo, n.id, n.name, src_repo AS doc_repo, src_id AS doc_id FROM edges JOIN ln n ON n.repo = dst_repo AND n.id = dst_id WHERE edge_type = 'documents' AND coalesce(src_id, '') <> '' AND src_repo IS NOT NULL),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo, id ORDER BY doc_id, doc_repo) AS q FROM l) WHERE q <= 20)
SELECT p.repo, p.id, doc_repo, doc_id, CASE WHEN len(list_filter(ls, lambda x: p.name <> '' AND contains(x, p.name))) > 0 THEN list_filter(ls, lambda x: p.name <> '' AND contains(x, p.name))[1] ELSE list_filter(ls, lambda x: trim(x) <> '')[1] END AS line
FROM p LEFT JOIN t ON t.repo = doc_repo AND t.path = regexp_extract(doc_id, '^(?:doc|heading|file):([^#]*)', 1)"""
)
def join_docs_for_symbols(s, d):
    texts = _docs(s, d, "true").groupBy("repo", "path").agg(F.max("text").alias("text"))
    return lookup.docs_for_symbols(graph.live_edges(table(s, d, "edges")), graph.live_nodes(table(s, d, "nodes")), texts)


@query(
    f"""WITH {LN}, t AS (SELECT repo, id, name, regexp_extract(id, '^type:([^#]*)', 1) AS tp, count(*) OVER (PARTITION BY repo, name) AS n FROM ln WHERE kind = 'type' AND name <> ''),
m AS (SELECT repo, id AS mid, regexp_extract(id, '#([^.(]+)\\.', 1) AS name, regexp_extract(id, '^method:([^#]*)', 1) AS mp FROM ln WHERE kind = 'method')
SELECT repo AS seed_repo, id AS seed_id, repo, id FROM ln WHERE kind = 'type' UNION SELECT t.repo, t.id, m.repo, mid FROM t JOIN m ON m.repo = t.repo AND m.name = t.name WHERE n = 1 OR tp = mp"""
)
def join_type_members(s, d):
    nodes = graph.live_nodes(table(s, d, "nodes"))
    return lookup.with_members(nodes, nodes.where("kind = 'type'"))


@query(
    f"""WITH {LN}, e AS (SELECT DISTINCT src_repo, src_id, edge_type, dst_repo, dst_id FROM edges WHERE coalesce(src_id, '') <> '' AND coalesce(dst_id, '') <> '' AND src_repo IS NOT NULL AND dst_repo IS NOT NULL AND edge_type IS NOT NULL),
o AS (SELECT src_repo AS repo, src_id AS id, count(*) AS c FROM e GROUP BY ALL), i AS (SELECT dst_repo AS repo, dst_id AS id, count(*) AS c FROM e GROUP BY ALL)
SELECT n.repo, n.id, n.kind, CASE WHEN n.kind = 'method' AND regexp_extract(n.id, '#([^(]*)', 1) <> '' THEN regexp_extract(n.id, '#([^(]*)', 1) ELSE n.name END AS label, n.path, n.start_line, coalesce(o.c, 0) AS out_edges, coalesce(i.c, 0) AS in_edges
FROM ln n LEFT JOIN o ON o.repo = n.repo AND o.id = n.id LEFT JOIN i ON i.repo = n.repo AND i.id = n.id"""
)
def scan_symbols(s, d):
    nodes = graph.live_nodes(table(s, d, "nodes"))
    return lookup.symbol(nodes, graph.live_edges(table(s, d, "edges")), nodes)


@query(
    f"""WITH RECURSIVE {LN}, {LE}, {VIEW}, {_ENDS}, hb AS (SELECT n.repo, n.id, count(*) AS degree FROM en JOIN ln n ON n.repo = en.repo AND n.id = en.id GROUP BY ALL ORDER BY degree DESC, n.id, n.repo LIMIT 1),
k AS MATERIALIZED (SELECT DISTINCT a_repo || '|' || a AS u, b_repo || '|' || b AS v FROM vw), rc AS (SELECT u, v FROM k UNION SELECT rc.u, k.v FROM rc JOIN k ON k.u = rc.v),
sc AS (SELECT x.u, min(x.v) AS component FROM rc x JOIN rc y ON y.u = x.v AND y.v = x.u GROUP BY x.u HAVING min(x.v) <> max(x.v)),
rg AS (SELECT component, count(*) AS n FROM sc GROUP BY component ORDER BY n DESC, component LIMIT 1),
gd AS (SELECT repo, id, count(*) AS degree FROM en WHERE edge_type <> 'contains' GROUP BY ALL), gp AS (SELECT count(*) AS n FROM ln n LEFT JOIN gd ON gd.repo = n.repo AND gd.id = n.id WHERE n.kind <> 'symbol' AND coalesce(degree, 0) <= 1)
SELECT 'hub' AS kind, 'Why do ' || degree || ' edges meet at ' || id || '?' AS question FROM hb UNION ALL SELECT 'cycle', 'Can the circle of ' || n || ' around ' || component || ' be opened?' FROM rg
UNION ALL SELECT 'gap', 'Are ' || n || ' nodes with at most one edge still used?' FROM gp WHERE n > 0"""
)
def graph_questions(s, d):
    nodes, edges = graph.live_nodes(table(s, d, "nodes")), graph.live_edges(table(s, d, "edges"))
    return lookup.questions(analysis.hubs(edges, nodes), analysis.strong_components(analysis.dependency_view(edges, nodes)), analysis.knowledge_gaps(edges, nodes))


@query(
    """WITH n AS (SELECT repo, path, max(coalesce(text, '')) AS t FROM documents WHERE repo IS NOT NULL AND path IS NOT NULL GROUP BY ALL),
o AS (SELECT repo, path, max(coalesce(text, '')) AS t FROM documents WHERE repo IS NOT NULL AND path IS NOT NULL AND added_at < TIMESTAMP '2025-01-01' GROUP BY ALL)
SELECT repo, count(*) FILTER (o.t IS NULL OR o.t <> n.t) AS processed, count(*) FILTER (o.t = n.t) AS skipped, 0::BIGINT AS deleted FROM n LEFT JOIN o USING (repo, path) GROUP BY repo"""
)
def agg_index_stats(s, d):
    from graphloom.plans.graph_queries import source_scan_changes

    return lookup.index_stats(source_scan_changes(s, d))
