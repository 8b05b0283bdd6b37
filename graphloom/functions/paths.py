"""Paths, HTTP routes and ``repo://`` URIs as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: File extension to language, and language to family.
LANGUAGES = {
    "go": "go", "py": "python", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "ts": "typescript", "tsx": "typescript", "mts": "typescript", "cts": "typescript",
    "java": "java", "kt": "kotlin", "kts": "kotlin", "rb": "ruby", "php": "php", "c": "c", "h": "c", "cc": "cpp", "cpp": "cpp", "cxx": "cpp", "hpp": "cpp", "hh": "cpp", "hxx": "cpp", "cs": "csharp", "swift": "swift",
    "proto": "proto", "graphql": "graphql", "yaml": "yaml", "yml": "yaml", "json": "json", "md": "markdown",
}
FAMILIES = {"javascript": "web", "typescript": "web", "java": "jvm", "kotlin": "jvm", "c": "c", "cpp": "c"}
#: Path segments that tell nothing about a service.
GENERIC = ("api", "health", "healthz", "docs", "status", "openapi.json", "metrics", "ready", "live")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def _map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def language(path: Column) -> Column:
    return F.coalesce(F.element_at(_map(LANGUAGES), extension(path)), F.lit("other"))


def family(path: Column) -> Column:
    lang = language(path)
    return F.coalesce(F.element_at(_map(FAMILIES), lang), lang)


def id_path(node_id: Column) -> Column:
    """The path inside a local id (``kind:PATH#NAME``); null for ids without one."""
    return F.nullif(F.regexp_extract(node_id, "^(?:file|module|package|func|method|type|import|doc|heading|operation):([^#]*)", 1), F.lit(""))


def http_path(path: Column) -> Column:
    """Query and fragment cut, parameters written ``{}``, one slash between segments."""
    bare = F.regexp_extract(path, "^[^?#]*", 0)
    segments = F.filter(F.split(bare, "/"), lambda s: s != "")
    param = lambda s: s.startswith(":") | s.rlike(r"^\{.*\}$|^\[.*\]$|^<.*>$") | s.contains("{}")
    return F.concat(F.lit("/"), F.array_join(F.transform(segments, lambda s: F.when(param(s), F.lit("{}")).otherwise(s)), "/"))


def api_path(path: Column) -> Column:
    """Only query and fragment cut."""
    return F.regexp_extract(path, "^[^?#]*", 0)


def segments(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda s: s != "")


def generic_segment(s: Column) -> Column:
    return s.isin(*GENERIC) | s.rlike("^v[0-9]+$")


def parse_uri(uri: Column) -> Column:
    """Struct (repo, path, kind, symbol) of ``repo://REPO/PATH#KIND[:SYMBOL]``; null where it is none."""
    whole = r"^repo://([A-Za-z0-9._-]+)/([^#]*)#([a-z]+)(?::(.*))?$"
    part = lambda k: F.regexp_extract(uri, whole, k)
    decode = lambda c: F.coalesce(F.try_url_decode(F.regexp_replace(c, r"\+", "%2B")), c)
    return F.when(uri.rlike(whole), F.struct(part(1).alias("repo"), decode(part(2)).alias("path"), part(3).alias("kind"), F.nullif(decode(part(4)), F.lit("")).alias("symbol")))


def build_uri(repo: Column, path: Column, kind: Column, symbol: Column) -> Column:
    """The canonical URI; path segments are percent-escaped, the symbol only where it must be."""
    escaped = F.array_join(F.transform(F.split(path, "/"), lambda s: F.regexp_replace(F.url_encode(s), r"\+", "%20")), "/")
    tail = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(symbol, "%", "%25"), "#", "%23"), r"\?", "%3F"), " ", "%20")
    return F.concat(F.lit("repo://"), repo, F.lit("/"), escaped, F.lit("#"), kind, F.when(tail.isNotNull() & (tail != ""), F.concat(F.lit(":"), tail)).otherwise(""))


def relative_id(node_id: Column, root: str) -> Column:
    """An id with absolute paths below ``root`` made relative."""
    return F.replace(node_id, F.lit(root.rstrip("/") + "/"), F.lit(""))


#: Node kind to the kind token of its URI.
TOKENS = {"function": "func"}


def assigned_uri(repo: Column, node_id: Column, kind: Column) -> Column:
    """The canonical URI of a node from its local id; placeholders live under the path ``symbols``."""
    token = F.coalesce(F.element_at(_map(TOKENS), kind), kind)
    path = F.coalesce(id_path(node_id), F.lit("symbols"))
    symbol = F.when(kind == "file", F.lit(None)).when(kind == "symbol", F.regexp_extract(node_id, "^symbol:(.*)$", 1)).otherwise(F.nullif(F.regexp_extract(node_id, "#(.*)$", 1), F.lit("")))
    symbol = F.when(kind == "module", F.coalesce(symbol, F.regexp_extract(path, "[^/]*$", 0))).otherwise(symbol)
    return build_uri(repo, path, token, symbol)
