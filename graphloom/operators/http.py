"""HTTP routes composed over mounts, and client calls bound to the members that serve them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from graphloom.functions.paths import http_path
from graphloom.functions.text import verb_hint
from graphloom.operators.contracts import common_prefixes, env_owners, env_reads, expand_aliases, match_routes, strip_gateway
from graphloom.plans.iterate import cut

MOUNT_LEVELS = 4
WRAPPER_ROUNDS = 5


def compose_routes(surface: DataFrame) -> DataFrame:
    """(repo, path, method, route, handler, mounted, key): full paths from router prefixes and mounts; ``key`` is the declared route.

    Routers are known by name within a member (the last part of a dotted name). A router that is
    no app and that nothing mounts is kept with ``mounted`` false.
    """
    last = lambda c: F.regexp_extract(c, r"([^.]*)$", 1)
    routers = surface.where("kind = 'router'").groupBy("repo", F.col("name").alias("router")).agg(F.max("value").alias("own"), F.max(F.col("target") == "app").alias("app"))
    routes = surface.where("kind = 'route'").select("repo", "path", "method", last("name").alias("router"), F.col("value").alias("route"), F.col("target").alias("handler"))
    routes = routes.withColumn("key", F.concat_ws("|", "repo", "path", "method", "router", "route"))
    routes = routes.join(routers, ["repo", "router"], "left").withColumn("route", F.concat(F.coalesce("own", F.lit("")), F.lit("/"), "route")).withColumn("mounted", F.coalesce("app", F.lit(True)))
    mounts = surface.where("kind = 'mount'").select("repo", last("target").alias("router"), F.col("value").alias("prefix"), last("name").alias("outer")).distinct()
    mounts = cut(mounts.join(routers.select("repo", F.col("router").alias("outer"), F.col("own").alias("outer_own"), F.col("app").alias("outer_app")), ["repo", "outer"], "left"))
    level, out = routes.select("repo", "path", "method", "router", "route", "handler", "mounted", "key"), None
    for _ in range(MOUNT_LEVELS):
        done = level.join(mounts, ["repo", "router"], "left_anti")
        out = done if out is None else out.unionByName(done)
        up = level.join(mounts, ["repo", "router"])
        level = up.select("repo", "path", "method", F.col("outer").alias("router"), F.concat(F.coalesce("outer_own", F.lit("")), F.lit("/"), "prefix", F.lit("/"), "route").alias("route"), "handler", F.coalesce("outer_app", F.lit(True)).alias("mounted"), "key")
    out = out.unionByName(level)
    return out.select("repo", "path", "method", http_path(F.col("route")).alias("route"), "handler", "mounted", "key").distinct()


def expand_wrappers(surface: DataFrame, rounds: int = WRAPPER_ROUNDS) -> DataFrame:
    """``surface`` with a client row for each call of a wrapper, wrappers of wrappers included.

    Wrappers are known by name and position within a member; a name with two definitions is
    left alone. The method is the wrapper's, or a guess from its name.
    """
    all_ = surface.where("kind = 'wrapper'").select("repo", F.col("name").alias("fn"), "method", F.col("value").alias("prefix"), "tokens", "target").distinct()
    single = all_.groupBy("repo", "fn").agg(F.count("*").alias("n")).where("n = 1").drop("n")
    all_ = cut(all_.join(single, ["repo", "fn"], "left_semi"))
    known = all_.where("target = ''").drop("target")
    for _ in range(rounds):
        up = all_.where("target <> ''").select("repo", "fn", F.col("prefix").alias("own"), F.col("target").alias("callee")).join(known.select("repo", F.col("fn").alias("callee"), "method", "prefix", "tokens"), ["repo", "callee"])
        new = cut(up.select("repo", "fn", "method", F.concat("prefix", "own").alias("prefix"), "tokens").join(known, ["repo", "fn"], "left_anti"))
        if new.isEmpty():
            break
        known = known.unionByName(new)
    calls = surface.where("kind = 'wcall'").select("repo", "path", "name", F.col("target").alias("fn"), "value", "line")
    hit = calls.join(known, ["repo", "fn"])
    method = F.when(F.col("method") != "", F.col("method")).otherwise(verb_hint(F.substring_index("fn", "/", 1)))
    clients = hit.select("repo", "path", F.lit("client").alias("kind"), "name", method.alias("method"), F.concat("prefix", "value").alias("value"), "tokens", F.lit("").alias("target"), "line")
    return surface.unionByName(clients.select(*surface.columns))


def bind_http(surface: DataFrame, routes: DataFrame, members: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """(repo, path, owner, line, method, call, member, route, how): client calls bound to one member's route.

    ``members`` (member, base_env, and gateway_prefix if there is one) declares which variables
    hold a member's base URL. A call whose tokens name exactly one member is matched against its
    routes (``declared``), without the gateway's prefix; two members make it ambiguous. Others are
    bound (``inferred``) if exactly one member has a fitting route, and that is not their own:
    two literal segments must not be generic, and what the call leaves out at the front must be
    a prefix common in that member. Unmounted routes are never matched. ``aliases`` (repo, token,
    name) are further names of tokens, from a member's settings.
    """
    if aliases is not None:
        surface = expand_aliases(surface, aliases)
    calls, aimed = _aimed(surface, members)
    serve = routes.where("mounted").select(F.col("repo").alias("member"), "method", F.col("route").alias("path"), *[c for c in ("key",) if c in routes.columns])
    gateway = members.select(F.col("member").alias("within"), (F.col("gateway_prefix") if "gateway_prefix" in members.columns else F.lit("")).alias("gateway")).distinct()
    declared = aimed.where("n = 1").join(gateway, "within", "left").select("call_id", "method", strip_gateway(F.col("value"), F.col("gateway")).alias("path"), "within")
    fit_declared = match_routes(declared, serve, min_specific=1).withColumn("how", F.lit("declared"))
    free = aimed.where("n is null").select("call_id", "method", F.col("value").alias("path"), "repo")
    common = common_prefixes(serve.select("member", "path").distinct())
    fit = match_routes(free, serve, common=common)
    only = fit.groupBy("call_id").agg(F.count_distinct("member").alias("n"), F.min("member").alias("m")).where("n = 1").join(free.select("call_id", "repo"), "call_id").where("m <> repo")
    inferred = fit.join(only.select("call_id"), "call_id", "left_semi").withColumn("how", F.lit("inferred"))
    hit = fit_declared.unionByName(inferred)
    return calls.join(hit, "call_id").select("repo", "path", F.col("name").alias("owner"), "line", "method", F.col("value").alias("call"), "member", "route", "how")


def _aimed(surface: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Client calls with a ``call_id``; and one row per id with the number ``n`` of members its tokens name, ``within`` the least."""
    calls = surface.where("kind = 'client' and value <> ''").withColumn("call_id", F.concat_ws("|", "repo", "path", "line", "method", "value"))
    named = calls.select("call_id", F.explode("tokens").alias("token")).join(env_owners(members), "token").groupBy("call_id").agg(F.countDistinct("member").alias("n"), F.min("member").alias("within"))
    calls = cut(calls)
    return calls, calls.select("call_id", "repo", "method", "value").distinct().join(named, "call_id", "left")


def http_stats(surface: DataFrame, routes: DataFrame, bound: DataFrame, members: DataFrame) -> DataFrame:
    """One row: routes, clients, declared, inferred, ambiguous, unmatched, service_edges, env_clashes."""
    calls, aimed = _aimed(surface, members)
    call = ["repo", "path", "line", "method", "call"]
    told = bound.select(*call, "how").distinct()
    parts = [
        routes.where("mounted").select("repo", "method", "route").distinct().agg(F.count("*").alias("routes")),
        surface.agg(F.count_if(F.col("kind") == "client").alias("clients")),
        told.agg(F.count_if(F.col("how") == "declared").alias("declared"), F.count_if(F.col("how") == "inferred").alias("inferred")),
        calls.join(aimed.where("n > 1").select("call_id"), "call_id", "left_semi").agg(F.count("*").alias("ambiguous")),
        service_env_reads(surface, members).agg(F.count("*").alias("service_edges")),
        members.select("member", F.explode("base_env").alias("t")).select("member", F.upper("t").alias("t")).distinct().groupBy("t").count().agg(F.count_if(F.col("count") > 1).alias("env_clashes")),
    ]
    one = parts[0].withColumn("_k", F.lit(1))
    for part in parts[1:]:  # a row each
        one = one.join(part.withColumn("_k", F.lit(1)), "_k")
    names = ["routes", "clients", "declared", "inferred", "ambiguous"]
    return one.select(*names, (F.col("clients") - F.col("declared") - F.col("inferred") - F.col("ambiguous")).alias("unmatched"), "service_edges", "env_clashes")


def service_env_reads(surface: DataFrame, members: DataFrame) -> DataFrame:
    """(member, reader, owner): modules that read another member's declared variable."""
    reads = surface.where("kind = 'env'").select(F.col("repo").alias("member"), F.col("path").alias("reader"), F.array("value").alias("tokens"))
    return env_reads(reads, env_owners(members))


def route_prefixes(routes: DataFrame) -> DataFrame:
    return common_prefixes(routes.where("mounted").select(F.col("repo").alias("member"), F.col("route").alias("path")))
