"""Git history: counted commits and file pairs that change together."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def commit_files(commits: DataFrame, least: int = 2, most: int = 100, since: str | None = None, keep: int | None = None, scan: int | None = None) -> DataFrame:
    """(repo, commit_hash, committed_at, paths): one row per commit, distinct non-empty paths, ``least`` to ``most`` files.

    ``keep`` and ``scan`` bound, per repository and newest first, how many counted commits
    are kept and how many commits are looked at.
    """
    rows = commits.where("repo is not null and commit_hash is not null").select("repo", "commit_hash", "committed_at", F.explode_outer("paths").alias("p"))
    rows = rows.groupBy("repo", "commit_hash", F.nullif("p", F.lit("")).alias("p")).agg(F.max("committed_at").alias("committed_at"))
    one = rows.groupBy("repo", "commit_hash").agg(F.max("committed_at").alias("committed_at"), F.count("p").alias("n"))
    if since:
        one = one.where(F.col("committed_at") >= F.lit(since).cast("timestamp_ntz"))
    newest = Window.partitionBy("repo").orderBy(F.desc("committed_at"), "commit_hash")
    if scan:
        one = one.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= scan).drop("_n")
    one = one.where(F.col("n").between(least, most)).drop("n")
    if keep:
        one = one.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= keep).drop("_n")
    # lists are built of counted commits only, so none is longer than ``most``
    kept = rows.where("p is not null").drop("committed_at").join(one, ["repo", "commit_hash"])
    return kept.groupBy("repo", "commit_hash", "committed_at").agg(F.array_sort(F.collect_list("p")).alias("paths"))


def co_changes(files: DataFrame, as_of: str, half_life_days: float = 90.0, min_support: int = 2) -> DataFrame:
    """(repo, a, b, support, weight, last_hash): pairs of one commit, decayed by age; pairs come from inside the commit's list."""
    age = F.greatest((F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros(F.col("committed_at").cast("timestamp"))) / F.lit(86_400_000_000.0), F.lit(0.0))
    pairs = F.expr("flatten(transform(paths, (a, i) -> transform(slice(paths, i + 2, size(paths)), b -> struct(a as a, b as b))))")
    rows = files.select("repo", "commit_hash", "committed_at", F.pow(F.lit(0.5), age / F.lit(half_life_days)).alias("w"), F.inline(pairs))
    out = rows.groupBy("repo", "a", "b").agg(F.count("*").alias("support"), F.sum("w").alias("weight"), F.max(F.struct("committed_at", "commit_hash")).alias("last"))
    return out.where(F.col("support") >= min_support).select("repo", "a", "b", "support", "weight", F.col("last.commit_hash").alias("last_hash"))


def co_change_edges(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs whose files are live, as co_committed edges with their properties as strings."""
    files = nodes.where("kind = 'file'").select("repo", F.regexp_extract("id", "^file:(.*)$", 1).alias("p"))
    kept = pairs.join(files.toDF("repo", "a"), ["repo", "a"], "left_semi").join(files.toDF("repo", "b"), ["repo", "b"], "left_semi")
    return kept.select("repo", F.concat(F.lit("file:"), "a").alias("src_id"), F.concat(F.lit("file:"), "b").alias("dst_id"), F.lit("co_committed").alias("edge_type"), F.col("support").cast("string").alias("support"), F.format_string("%.4f", "weight").alias("weight"))


def top_partners(edges: DataFrame, files: DataFrame, limit: int = 20) -> DataFrame:
    """(repo, id, partner, weight, support, position): each file's strongest co-change partners, both directions."""
    rows = edges.where("edge_type = 'co_committed' and src_repo = dst_repo")
    both = rows.select(F.col("src_repo").alias("repo"), F.col("src_id").alias("id"), F.col("dst_id").alias("partner"), "weight", "support")
    both = both.unionByName(rows.select(F.col("src_repo").alias("repo"), F.col("dst_id").alias("id"), F.col("src_id").alias("partner"), "weight", "support"))
    both = both.join(files.select("repo", "id").distinct(), ["repo", "id"], "left_semi").groupBy("repo", "id", "partner").agg(F.max("weight").alias("weight"), F.max("support").alias("support"))
    order = Window.partitionBy("repo", "id").orderBy(F.desc_nulls_last("weight"), "partner")
    return both.withColumn("position", F.row_number().over(order)).where(F.col("position") <= limit)
