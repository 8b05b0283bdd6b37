"""Markdown, trace and contract texts taken apart with column expressions."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from graphloom.plans.ship import ship


def markdown_headings(docs: DataFrame) -> DataFrame:
    """(repo, path, line, level, title, id): headings outside code fences; a repeated title gets ``~n``.

    ``docs`` has (repo, path, text).
    """
    lines = docs.select("repo", "path", F.posexplode(F.split("text", "\r?\n")).alias("i", "t"))
    of_doc = Window.partitionBy("repo", "path").orderBy("i")  # the lines of one text
    fence = F.count_if(F.col("t").startswith("```")).over(of_doc.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    lines = lines.withColumn("fenced", fence % 2 == 1).where(F.col("t").rlike(r"^#{1,6}\s+\S") & ~F.col("fenced"))
    rows = lines.select("repo", "path", (F.col("i") + 1).alias("line"), F.length(F.regexp_extract("t", "^(#+)", 1)).alias("level"), F.trim(F.regexp_extract("t", r"^#+\s+(.*?)\s*#*\s*$", 1)).alias("title"))
    n = F.row_number().over(Window.partitionBy("repo", "path", "title").orderBy("line"))
    tail = F.when(n > 1, F.concat(F.lit("~"), n.cast("string"))).otherwise("")
    return rows.withColumn("id", F.concat(F.lit("heading:"), "path", F.lit("#"), "title", tail))


SPAN = "array<struct<spanId:string,span_id:string,parentSpanId:string,parent_span_id:string,name:string,service:string,parent:string,attributes:map<string,string>>>"
ANY = "struct<stringValue:string,intValue:string,doubleValue:string,boolValue:string>"
OTLP = f"array<struct<resource:struct<attributes:array<struct<key:string,value:{ANY}>>>,scopeSpans:array<struct<spans:array<struct<spanId:string,parentSpanId:string,name:string,attributes:array<struct<key:string,value:{ANY}>>>>>>>>"


def parse_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, span_id, parent_span_id, name, service, parent, attributes) of simple and OTLP trace texts (doc_id, text)."""
    text = F.col("text")
    simple = docs.select("doc_id", F.explode(F.from_json(text, f"struct<spans:{SPAN}>")["spans"]).alias("s"))
    simple = simple.select("doc_id", F.coalesce("s.spanId", "s.span_id").alias("span_id"), F.coalesce("s.parentSpanId", "s.parent_span_id").alias("parent_span_id"), "s.name", "s.service", "s.parent", "s.attributes")
    value = lambda v: F.coalesce(v["stringValue"], v["intValue"], v["doubleValue"], v["boolValue"])
    as_map = lambda a: F.map_from_entries(F.transform(F.coalesce(a, F.array()), lambda kv: F.struct(kv["key"], value(kv["value"]))))
    res = docs.select("doc_id", F.explode(F.from_json(text, f"struct<resourceSpans:{OTLP}>")["resourceSpans"]).alias("r"))
    otlp = res.select("doc_id", F.filter("r.resource.attributes", lambda kv: kv["key"] == "service.name")[0]["value"].alias("sv"), F.explode("r.scopeSpans").alias("sc")).select("doc_id", "sv", F.explode("sc.spans").alias("s"))
    otlp = otlp.select("doc_id", F.col("s.spanId").alias("span_id"), F.nullif("s.parentSpanId", F.lit("")).alias("parent_span_id"), "s.name", value(F.col("sv")).alias("service"), F.lit(None).cast("string").alias("parent"), as_map(F.col("s.attributes")).alias("attributes"))
    return simple.unionByName(otlp)


def graphql_fields(docs: DataFrame) -> DataFrame:
    """(repo, path, type_name, gql_kind, field, role): fields of SDL types; those of root types are operations."""
    bare = F.regexp_replace(F.regexp_replace("text", '(?s)""".*?"""', ""), "#[^\n]*", "")
    blocks = F.regexp_extract_all(bare, F.lit(r"((?:extend\s+)?(?:type|interface|input|enum)\s+\w+[^{]*\{[^}]*\})"), F.lit(1))
    rows = docs.select("repo", "path", F.explode(blocks).alias("b"))
    rows = rows.select("repo", "path", F.regexp_extract("b", r"(?:type|interface|input|enum)\s+(\w+)", 1).alias("type_name"), F.regexp_extract("b", r"(type|interface|input|enum)\s", 1).alias("gql_kind"), F.regexp_extract("b", r"(?s)\{(.*)\}", 1).alias("body"))
    fields = rows.select("repo", "path", "type_name", "gql_kind", F.explode(F.regexp_extract_all("body", F.lit(r"(?m)^\s*(\w+)"), F.lit(1))).alias("field"))
    return fields.distinct().withColumn("role", F.when(F.col("type_name").isin("Query", "Mutation", "Subscription"), "operation").otherwise("field"))


PROTO = "array<struct<kind:string,owner:string,name:string,type:string,number:bigint>>"
PROTO_TOKEN = re.compile(r"""//[^\n]*|/\*.*?\*/|"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*'|[\w.]+|[{}()<>\[\];=,]""", re.S)


def read_proto(text: str | None) -> list[tuple[str, str, str, str, int | None]]:
    """(kind, owner, name, type, number) of a proto text: messages (nested ones as ``A.B``), enums, services, fields and rpcs.

    An rpc's type is its call path. Broken or cut texts give what was read.
    """
    words = [t for t in PROTO_TOKEN.findall(text or "") if not t.startswith(("//", "/*"))]
    out: list[tuple[str, str, str, str, int | None]] = []
    package, scopes, i = "", [], 0  # scopes: (kind, name) of the open braces
    at = lambda k: words[k] if k < len(words) else ""
    while i < len(words):
        w = words[i]
        owner = ".".join(n for k, n in scopes if k in ("message", "service"))
        inside = scopes[-1][0] if scopes else ""
        if w == "package" and not scopes:
            package, i = at(i + 1), i + 3
        elif w in ("message", "enum", "service") and at(i + 2) == "{" and inside in ("", "message"):
            name = ".".join(x for x in (owner, at(i + 1)) if x)
            out.append((w, owner, name, "", None))
            scopes.append((w, at(i + 1)))
            i += 3
        elif w == "oneof" and at(i + 2) == "{":
            scopes.append(("oneof", ""))
            i += 3
        elif w == "rpc" and inside == "service":
            full = ".".join(x for x in (package, owner) if x)
            out.append(("rpc", owner, at(i + 1), f"/{full}/{at(i + 1)}", None))
            while i < len(words) and words[i] not in (";", "{"):
                i += 1
            if at(i) == "{":
                scopes.append(("options", ""))
            i += 1
        elif w == "{":
            scopes.append(("options", ""))
            i += 1
        elif w == "}":
            scopes[-1:] = []
            i += 1
        elif inside in ("message", "oneof") and w not in ("option", "reserved", "extensions", "extend"):
            end = i
            while end < len(words) and words[end] not in (";", "{", "}"):
                end += 1
            line = words[i:end]
            if "=" in line and (k := line.index("=")) >= 2 and k + 1 < len(line) and line[k + 1].isdigit():
                kind = "".join(x if x in "<>," else f" {x}" for x in line[: k - 1]).strip().replace("< ", "<").replace(", ", ",")
                out.append(("field", owner, line[k - 1], kind, int(line[k + 1])))
            i = end + (at(end) == ";")
            if i == end and at(end) not in ("{", "}"):
                i += 1
        else:
            while i < len(words) and words[i] not in (";", "{", "}"):
                i += 1
            if at(i) == ";":
                i += 1
    return out


def proto_items(docs: DataFrame) -> DataFrame:
    """(repo, path, kind, owner, name, type, number) of proto texts (repo, path, text), see ``read_proto``."""
    ship(docs.sparkSession)

    @F.pandas_udf(PROTO)
    def parse(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [dict(zip(("kind", "owner", "name", "type", "number"), x, strict=True)) for x in read_proto(t)])

    return docs.select("repo", "path", F.inline(parse("text")))


METHODS = ("get", "put", "post", "delete", "options", "head", "patch", "trace")
OPENAPI = "array<struct<op_path:string,method:string,operation_id:string>>"


def read_openapi(text: str | None) -> list[tuple[str, str, str | None]]:
    """(path, METHOD, operationId) of an OpenAPI 3 text in YAML or JSON; unreadable texts have none."""
    import yaml

    try:
        doc = json.loads(text) if (text or "").lstrip().startswith("{") else yaml.load(text or "", getattr(yaml, "CSafeLoader", yaml.SafeLoader))
        paths = doc["paths"].items() if str(doc["openapi"]).startswith("3.") else ()
        return [(str(p), m.upper(), (item[m] or {}).get("operationId")) for p, item in paths for m in METHODS if isinstance(item, dict) and m in item]
    except Exception:  # noqa: BLE001 - any text may come in
        return []


def read_schemas(text: str | None) -> list[str]:
    """Names under components.schemas of an OpenAPI 3 text."""
    import yaml

    try:
        doc = json.loads(text) if (text or "").lstrip().startswith("{") else yaml.load(text or "", getattr(yaml, "CSafeLoader", yaml.SafeLoader))
        return [str(x) for x in doc["components"]["schemas"]] if str(doc["openapi"]).startswith("3.") else []
    except Exception:  # noqa: BLE001 - any text may come in
        return []


def openapi_schemas(docs: DataFrame) -> DataFrame:
    """(repo, path, schema) of OpenAPI documents (repo, path, text)."""
    ship(docs.sparkSession)

    @F.pandas_udf("array<string>")
    def parse(texts: pd.Series) -> pd.Series:
        return texts.map(read_schemas)

    return docs.select("repo", "path", F.explode(parse("text")).alias("schema"))


def openapi_operations(docs: DataFrame) -> DataFrame:
    """(repo, path, op_path, method, operation_id) of OpenAPI documents (repo, path, text)."""
    ship(docs.sparkSession)

    @F.pandas_udf(OPENAPI)
    def parse(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [dict(zip(("op_path", "method", "operation_id"), x, strict=True)) for x in read_openapi(t)])

    return docs.select("repo", "path", F.inline(parse("text")))
