"""Runtime traces: spans resolved to code nodes, observed calls counted."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from graphloom.operators.hierarchy import forest


def resolve_spans(spans: DataFrame, nodes: DataFrame) -> DataFrame:
    """(trace_file, span_id, repo, id): the node a span ran.

    ``service`` names the member. First a function or method called ``code.function`` in the
    file ``code.filepath``, the longest path if only one has it. Else the first of
    ``code.function``, ``code.filepath``, ``rpc.method`` and the span's name that gives one node: as
    a URI, as an id, as the path of a file, or as a name (in that file, if the span has one),
    where functions and methods come before other nodes and the longest path decides.

    A name is a node's if it equals the name or what follows the ``#`` of the id, for a method
    also if it ends the name or the id after a dot: nodes are listed under all these, so names
    meet by an equi-join. Equal spans are resolved once.
    """
    file = F.trim(F.col("attributes")["code.filepath"])
    rows = spans.where("span_id is not null and service is not null").select(
        "trace_file", F.lower(F.trim("span_id")).alias("span_id"), F.col("service").alias("repo"), F.coalesce("name", F.lit("")).alias("name"),
        F.coalesce(F.trim(F.col("attributes")["code.function"]), F.lit("")).alias("fn"), F.coalesce(file, F.lit("")).alias("file"), F.coalesce(F.col("attributes")["rpc.method"], F.lit("")).alias("rpc"), "received_at",
    )
    what = ["repo", "name", "fn", "file", "rpc"]
    last = rows.groupBy("trace_file", "span_id").agg(F.max_by(F.struct(*what), F.struct("received_at", "name")).alias("r")).select("trace_file", "span_id", "r.*")
    key = F.md5(F.concat_ws("\x01", *what))
    asked = last.select(*what).distinct().withColumn("k", key)

    code = F.col("kind").isin("function", "method")
    after = lambda c, sep: F.transform(F.sequence(F.lit(1), F.size(F.split(c, sep))), lambda i: F.array_join(F.slice(F.split(c, sep), i + 1, F.size(F.split(c, sep))), sep.replace("\\", "")))
    plain = F.array("name", F.regexp_extract("id", "#(.*)$", 1))
    dotted = F.when(F.col("kind") == "method", F.concat(after(F.col("name"), r"\."), after(F.col("id"), r"\."))).otherwise(F.array().cast("array<string>"))
    listed = nodes.select("repo", "id", "kind", "path", "uri", F.explode(F.array_distinct(F.concat(plain, dotted))).alias("said")).where("said <> ''")
    listed = listed.select("repo", "id", code.alias("code"), "path", "said")
    fits = (F.col("path") != "") & ((F.col("path") == F.col("file")) | F.col("path").endswith(F.concat(F.lit("/"), "file")) | (F.col("file").startswith("/") & F.col("file").endswith(F.concat(F.lit("/"), "path"))))

    def longest(found: DataFrame, keys: list[str]) -> DataFrame:
        """The node with the longest path, if only one has it; ``found`` with keys, id, path."""
        top = found.groupBy(*keys, F.length("path").alias("len")).agg(F.count_distinct("id").alias("n"), F.min("id").alias("id"))
        return top.groupBy(*keys).agg(F.max_by(F.struct("n", "id"), "len").alias("b")).where("b.n = 1").select(*keys, "b.id")

    whole = asked.where("fn <> '' and file <> ''").join(listed.where("code"), (listed["repo"] == asked["repo"]) & (F.col("said") == F.col("fn"))).where(fits)
    exact = longest(whole.select(asked["repo"], "k", "id", "path"), ["repo", "k"])
    rest = asked.join(exact.select("k"), "k", "left_anti")
    words = F.array(*[F.struct(F.lit(o).alias("o"), F.col(c).alias("said")) for o, c in enumerate(("fn", "file", "rpc", "name"))])
    word = rest.select("repo", "k", "file", F.inline(words)).where("said <> ''")
    keys = ["repo", "k", "o"]
    by_key = nodes.select("repo", F.explode(F.array(F.struct(F.lit(0).alias("way"), F.nullif("uri", F.lit("")).alias("said")), F.struct(F.lit(1).alias("way"), F.col("id").alias("said")), F.struct(F.lit(2).alias("way"), F.when(F.col("id").startswith("file:"), F.expr("substr(id, 6)")).alias("said")))).alias("x"), "id").select("repo", "x.*", "id").where("said is not null")
    direct = word.join(by_key, ["repo", "said"]).where("way < 2 or said like '%/%' or said like '%.%'").groupBy(*keys).agg(F.min(F.struct("way", "id")).alias("b")).select(*keys, F.lit(0).alias("way"), "b.id")
    named = word.join(listed, ["repo", "said"]).where((F.col("file") == "") | (F.col("path") == "") | fits).select(*keys, "file", "id", "code", "path", fits.alias("fits")).distinct()
    count = named.groupBy(*keys).agg(F.count("*").alias("n"), F.min("id").alias("one"), F.count_if("code").alias("nc"), F.min(F.when(F.col("code"), F.col("id"))).alias("c"))
    settled = count.select(*keys, F.when(F.col("n") == 1, F.col("one")).when(F.col("nc") == 1, F.col("c")).alias("id"), (F.col("nc") > 1).alias("many"))
    best = longest(named.where("code and fits and file <> ''").join(settled.where("id is null and many").select(*keys), keys, "left_semi"), keys)
    by_name = settled.where("id is not null").select(*keys, "id").unionByName(best).select(*keys, F.lit(1).alias("way"), "id")
    other = direct.unionByName(by_name).groupBy("repo", "k").agg(F.min(F.struct("o", "way", "id")).alias("b")).select("repo", "k", "b.id")
    found = exact.unionByName(other)
    return last.withColumn("k", key).join(found, ["repo", "k"]).select("trace_file", "span_id", "repo", "id")


def observed_calls(spans: DataFrame, nodes: DataFrame) -> DataFrame:
    """(src_repo, src_id, dst_repo, dst_id, calls, last_seen): parent-to-child calls between resolved spans; self calls are skipped."""
    tree = forest(spans).where("parent_id is not null").select("trace_file", "span_id", "parent_id")
    who = resolve_spans(spans, nodes)
    times = spans.where("span_id is not null").groupBy("trace_file", F.lower(F.trim("span_id")).alias("span_id")).agg(F.max("started_at").alias("seen"))
    child = tree.join(who.select("trace_file", "span_id", F.col("repo").alias("dst_repo"), F.col("id").alias("dst_id")), ["trace_file", "span_id"])
    both = child.join(who.select("trace_file", F.col("span_id").alias("parent_id"), F.col("repo").alias("src_repo"), F.col("id").alias("src_id")), ["trace_file", "parent_id"])
    both = both.where("src_repo <> dst_repo or src_id <> dst_id").join(times, ["trace_file", "span_id"], "left")
    return both.groupBy("src_repo", "src_id", "dst_repo", "dst_id").agg(F.count("*").alias("calls"), F.max("seen").alias("last_seen"))


def add_counts(old: DataFrame, new: DataFrame) -> DataFrame:
    """Stored counts plus those of another import; the later time holds."""
    return old.unionByName(new).groupBy("src_repo", "src_id", "dst_repo", "dst_id").agg(F.sum("calls").alias("calls"), F.max("last_seen").alias("last_seen"))


def hot_paths(edges: DataFrame, limit: int = 20) -> DataFrame:
    """The most observed calls over all members, ties by ids."""
    return edges.where("edge_type = 'observed_calls'").orderBy(F.desc("calls"), "src_repo", "src_id", "dst_repo", "dst_id").limit(limit).select("src_repo", "src_id", "dst_repo", "dst_id", "calls")
