"""API contracts: binding code to operations and client calls to routes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from graphloom.functions.paths import api_path, generic_segment, http_path, segments
from graphloom.functions.text import fold_name, operation_folds
from graphloom.plans.iterate import cut


def match_routes(calls: DataFrame, routes: DataFrame, min_specific: int = 2, common: DataFrame | None = None) -> DataFrame:
    """(call_id, member, route): the route whose trailing segments fit the call.

    ``calls`` (call_id, method, path) and ``routes`` (member, method, path) have raw paths;
    ``ANY`` fits every method. A route's suffix, no longer than the call, must fit it segment
    by segment, ``{}`` fitting anything. Most literal segments win, then the longest
    suffix; a tie matches nothing, unless all tied are one declared route mounted at several
    places (a column ``key`` of ``routes``, if there is one, names it). At least
    ``min_specific`` (one or more) literal segments must not be generic. A column ``within`` of
    ``calls``, if there is one, names the only member whose routes may fit. With ``common``
    (member, prefix), as ``common_prefixes`` gives it, what stands before the suffix must be
    such a prefix, and each member's best route is told. The equi-join key is a literal
    segment that is not generic, and its place from the end: every fit has one, so parameters
    and generic segments bring nothing together.
    """
    if min_specific < 1:
        raise ValueError("a route needs a segment that is not generic")
    within = F.col("within") if "within" in calls.columns else F.lit(None).cast("string")
    key = F.col("key") if "key" in routes.columns else F.concat_ws(" ", "member", http_path(F.col("path")))
    c = calls.select("call_id", within.alias("within"), F.upper("method").alias("cm"), segments(http_path(F.col("path"))).alias("cs"))
    r = routes.select("member", F.upper("method").alias("rm"), http_path(F.col("path")).alias("route"), key.alias("key")).distinct().withColumn("rs", segments(F.col("route")))
    specific = lambda s: (s != "{}") & ~generic_segment(s)
    marks = lambda c: F.filter(F.transform(F.reverse(c), lambda s, i: F.struct(i.alias("place"), s.alias("mark"))), lambda x: specific(x["mark"]))
    both = c.select("*", F.inline(marks("cs"))).join(r.select("*", F.inline(marks("rs"))), ["place", "mark"])
    both = both.where(F.col("within").isNull() | (F.col("within") == F.col("member"))).where((F.size("rs") >= F.size("cs")) & ((F.col("cm") == F.col("rm")) | (F.col("cm") == "ANY") | (F.col("rm") == "ANY")))
    off = F.size("rs") - F.size("cs")
    tail = F.slice("rs", off + 1, F.size("cs"))
    fit = F.forall(F.zip_with("cs", tail, lambda a, b: (a == b) | (a == "{}") | (b == "{}")), lambda x: x)
    both = both.withColumn("tail", tail).where(fit)
    literal = F.filter(F.zip_with("cs", "tail", lambda a, b: F.when((a == b) & (a != "{}"), a)), lambda x: x.isNotNull())
    both = both.select("call_id", "member", "route", "key", F.size(literal).alias("lit"), F.size(F.filter(literal, specific)).alias("specific"), off.alias("off"), F.concat(F.lit("/"), F.array_join(F.slice("rs", 1, off), "/")).alias("prefix")).distinct()
    both = both.where(F.col("specific") >= min_specific)
    if common is not None:
        known = common.select("member", "prefix").distinct()
        both = both.where("off = 0").unionByName(both.where("off > 0").join(known, ["member", "prefix"], "left_semi").select(both.columns))
    per = ["call_id"] if common is None else ["call_id", "member"]
    top = both.withColumn("k", F.rank().over(Window.partitionBy(*per).orderBy(F.desc("lit"), "off"))).where("k = 1")
    one = top.groupBy(*per).agg(F.min("key").alias("k0"), F.max("key").alias("k1")).where("k0 = k1").select(*per)
    return top.join(one, per, "left_semi").select("call_id", "member", "route").distinct()


def strip_gateway(path: Column, prefix: Column) -> Column:
    """A call's path without the gateway's prefix, which the member behind it doesn't see."""
    own, front = http_path(path), http_path(prefix)
    return F.when(F.coalesce(prefix, F.lit("")) == "", path).when(own == front, "/").when(own.startswith(F.concat(front, F.lit("/"))), F.substring(own, F.length(front) + 1, F.length(own))).otherwise(path)


def common_prefixes(routes: DataFrame, longest: int = 3) -> DataFrame:
    """(member, prefix, routes): leading segments that are all generic, or shared by max(2, a fifth) of the member's routes."""
    r = routes.select("member", http_path(F.col("path")).alias("route")).distinct().withColumn("s", segments(F.col("route")))
    n = r.groupBy("member").agg(F.count("*").alias("n"))
    p = r.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(longest)))).where(F.col("k") < F.size("s")).withColumn("p", F.slice("s", 1, F.col("k")))
    p = p.groupBy("member", F.array_join("p", "/").alias("prefix")).agg(F.count("*").alias("routes"), F.min(F.forall("p", generic_segment)).alias("generic"))
    return p.join(n, "member").where(F.col("generic") | (F.col("routes") >= F.greatest(F.lit(2), F.floor(F.col("n") / 5)))).select("member", F.concat(F.lit("/"), "prefix").alias("prefix"), "routes")


def bind_operation_ids(operations: DataFrame, functions: DataFrame) -> DataFrame:
    """(repo, id, op_repo, op_id, edge_type): functions whose folded name fits an operation id.

    ``operations`` (repo, id, operation_id), ``functions`` (repo, id, name). Same member:
    implements; another member: consumes. All fold-equal functions are linked.
    """
    ops = operations.select(F.col("repo").alias("op_repo"), F.col("id").alias("op_id"), F.explode(operation_folds(F.col("operation_id"))).alias("fold")).where("fold <> ''")
    fns = functions.select("repo", "id", fold_name(F.col("name")).alias("fold")).where("fold <> ''")
    return fns.join(ops, "fold").select("repo", "id", "op_repo", "op_id", F.when(F.col("repo") == F.col("op_repo"), "implements").otherwise("consumes").alias("edge_type")).distinct()


def path_literals(texts: DataFrame) -> DataFrame:
    """(repo, path, line, literal): quoted strings of source lines that may be paths, query and fragment cut; ``texts`` (repo, path, text)."""
    lines = texts.select("repo", "path", F.posexplode(F.split("text", "\n")).alias("i", "line_text")).where(F.col("line_text").rlike("[\"'`]"))
    hits = lines.select("repo", "path", (F.col("i") + 1).alias("line"), F.explode(F.regexp_extract_all("line_text", F.lit(r"[\"'`]((?:[^\"'`\\]|\\.)*)[\"'`]"), F.lit(1))).alias("p"))
    return hits.select("repo", "path", "line", api_path(F.col("p")).alias("literal")).where("literal <> ''")


def bind_path_literals(literals: DataFrame, operations: DataFrame, functions: DataFrame) -> DataFrame:
    """(repo, id, op_repo, op_id): functions whose lines hold the path of an operation, with or without the slash in front.

    ``operations`` (repo, id, path); ``functions`` (repo, id, path, start_line, end_line), where
    one without lines stands for its whole file.
    """
    ops = operations.select(F.col("repo").alias("op_repo"), F.col("id").alias("op_id"), api_path(F.col("path")).alias("literal")).where("literal <> ''")
    plain = literals.join(ops, "literal")
    slashed = literals.where(~F.col("literal").startswith("/")).join(ops.select(F.col("literal").alias("same")).distinct(), F.col("literal") == F.col("same"), "left_anti").withColumn("literal", F.concat(F.lit("/"), "literal")).join(ops, "literal")
    hit = plain.unionByName(slashed)
    inside = hit.join(functions.select("repo", "path", "id", "start_line", "end_line"), ["repo", "path"]).where("start_line = 0 or end_line = 0 or line between start_line and end_line")
    return inside.select("repo", "id", "op_repo", "op_id").distinct()


def expand_aliases(calls: DataFrame, aliases: DataFrame) -> DataFrame:
    """``calls`` (repo, tokens, ...) with the names that a member's settings give its tokens; ``aliases`` (repo, token, name)."""
    named = calls.select("repo", F.explode("tokens").alias("token")).distinct().join(aliases.select("repo", "token", "name").distinct(), ["repo", "token"])
    known = named.groupBy("repo", "token").agg(F.collect_set("name").alias("names")).groupBy("repo").agg(F.map_from_entries(F.collect_list(F.struct("token", "names"))).alias("_known"))
    more = F.flatten(F.transform("tokens", lambda t: F.coalesce(F.try_element_at("_known", t), F.array().cast("array<string>"))))
    return calls.join(known, "repo", "left").withColumn("tokens", F.when(F.col("_known").isNull(), F.col("tokens")).otherwise(F.array_distinct(F.concat("tokens", more)))).drop("_known")


def env_owners(members: DataFrame) -> DataFrame:
    """(token, member): environment names declared by exactly one member; ``members`` (member, base_env array)."""
    rows = members.select("member", F.explode("base_env").alias("token")).select("member", F.upper("token").alias("token")).distinct()
    return rows.groupBy("token").agg(F.count("*").alias("n"), F.min("member").alias("member")).where("n = 1").drop("n")


def env_reads(reads: DataFrame, owners: DataFrame) -> DataFrame:
    """(member, reader, owner): members reading another member's variable, and by which module; ``reads`` (member, reader, tokens)."""
    rows = reads.select(F.col("member").alias("from_member"), "reader", F.explode("tokens").alias("token")).withColumn("token", F.upper("token"))
    hit = rows.join(owners, "token").groupBy("from_member", "reader").agg(F.countDistinct("member").alias("n"), F.min("member").alias("owner"))
    return hit.where("n = 1 and owner <> from_member").select(F.col("from_member").alias("member"), "reader", "owner")


def service_calls(overlay: DataFrame) -> DataFrame:
    """(from_repo, to_repo, calls, env_reads, sites): what each member calls, from resolved overlay edges."""
    rows = overlay.where("src_repo is not null and dst_repo is not null and src_repo <> dst_repo")
    return rows.groupBy(F.col("src_repo").alias("from_repo"), F.col("dst_repo").alias("to_repo")).agg(
        F.count_if(F.col("edge_type") == "consumes").alias("calls"), F.count_if(F.col("match") == "env_read").alias("env_reads"), F.countDistinct("src_id").alias("sites")
    )


def service_consumers(services: DataFrame, members: DataFrame, depth: int = 1) -> DataFrame:
    """(member, repo, depth, via): callers of each of the ``members`` (member), callers of callers up to ``depth``, nearest first."""
    key = ["member", "repo"]
    hops = services.select("from_repo", "to_repo").distinct()
    level = members.select("member").distinct().select("member", F.col("member").alias("repo"))
    seen, out = level, None
    for d in range(1, depth + 1):
        step = level.select("member", F.col("repo").alias("via")).join(hops, F.col("via") == F.col("to_repo")).select("member", F.col("from_repo").alias("repo"), "via")
        found = cut(step.join(seen, key, "left_anti").groupBy(*key).agg(F.min("via").alias("via")).select(*key, F.lit(d).alias("depth"), "via"))
        level = found.select(*key)
        seen = seen.unionByName(level)
        out = found if out is None else out.unionByName(found)
    return out


def service_nodes(members: DataFrame) -> DataFrame:
    """One stand-in node per member that declares base variables; ``members`` (member, base_env)."""
    return members.where(F.size("base_env") > 0).select(F.col("member").alias("repo"), F.concat(F.lit("service:"), "member").alias("id"), F.lit("service").alias("kind"), F.col("member").alias("name"))
