"""Items that appear together: an incremental pair table.

A basket is the set of distinct items of one key; only baskets with ``least`` to ``most``
items count. The state (``PairStore``) is a folder with the baskets' contents, pair counts
(support and decayed weight), item counts, basket counts and association scores, each split
into hash buckets. A delivery is joined with the stored contents of its baskets; the changed
ones give signed deltas (minus the old basket's pairs and items, plus the new one's), deltas
are merged into the buckets they touch, and the buckets that hold a changed pair or a pair
with an item of a changed basket get their scores computed again. The number of baskets of a repository, which changes all its
lifts at once, is kept apart and joined where scores are read.

An update is one new version of the folder (``plans.versions``): a driver that dies in it
leaves the old state whole, and a delivery may be repeated, for contents that are already
there change nothing. A table gets twice the buckets when they hold more than
``ROWS_PER_BUCKET`` rows each.

Pairs are made inside a basket (at most ``most`` squared), never by joining rows, and are
summed on the map side first; item counts and basket counts reach the pairs by
fragment-replicate joins, so an item that is in most baskets, or a repository with most of
them, is no hot group. Weights are summed as decimals with 12 places: what is taken out
again leaves nothing behind.

Baskets: items are trimmed of spaces and lose one leading ``./``; nulls and empty items are
dropped; rows of one key are one basket with the union of their items and the latest time. Null
keys are no basket. Empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from graphloom.operators.skew import fragment_join, plan_fragments
from graphloom.plans.iterate import cut, written
from graphloom.plans.tables import tasks_of
from graphloom.plans.versions import Versions

BASKET = ["repo", "commit_hash"]
PAIR = ["repo", "path_a", "path_b"]
WEIGHT = "decimal(28,12)"
ROWS_PER_BUCKET = 1_000_000
KEYS = {"baskets": BASKET, "pairs": PAIR, "scores": PAIR, "items": ["repo", "path"], "totals": ["repo"]}
SCHEMAS = {
    "baskets": "repo string, commit_hash string, committed_at timestamp_ntz, paths array<string>",
    "pairs": f"repo string, path_a string, path_b string, support long, weight {WEIGHT}",
    "scores": f"repo string, path_a string, path_b string, support long, weight {WEIGHT}, n_a long, n_b long",
    "items": "repo string, path string, n long",
    "totals": "repo string, baskets long",
}


def clean_path(path: Column) -> Column:
    """Trimmed of spaces, one leading ``./`` removed; null where nothing is left."""
    return F.nullif(F.regexp_replace(F.trim(path), r"^\./", ""), F.lit(""))


def contents(commits: DataFrame, most: int = 100) -> DataFrame:
    """(repo, commit_hash, committed_at, paths): sorted distinct paths of each commit, null if more than ``most``.

    Rows are cleaned where they are read; one with too many paths moves without them. Most
    commits are delivered with one content only, which the least and the greatest of their
    lists show without collecting any; only the others are taken apart path by path.
    """
    clean = F.array_sort(F.array_distinct(F.filter(F.transform("paths", clean_path), lambda p: p.isNotNull())))
    rows = commits.where("repo is not null and commit_hash is not null").select(*BASKET, F.col("committed_at").cast("timestamp_ntz").alias("committed_at"), clean.alias("paths")).where("size(paths) > 0")
    large = F.size("paths") > most
    rows = written(rows.select(*BASKET, "committed_at", large.alias("large"), F.when(~large, F.col("paths")).alias("paths")))  # cleaned once
    one = rows.groupBy(*BASKET).agg(F.max("committed_at").alias("committed_at"), F.max("large").alias("large"), F.min("paths").alias("paths"), F.max("paths").alias("_other"))
    plain = one.where(F.col("large") | (F.col("paths") == F.col("_other"))).select(*BASKET, "committed_at", F.when(~F.col("large"), F.col("paths")).alias("paths"))
    mixed = one.where(~F.col("large") & (F.col("paths") != F.col("_other"))).select(*BASKET, "committed_at")
    parts = rows.drop("committed_at", "large").join(mixed.select(*BASKET), BASKET, "left_semi").select(*BASKET, F.explode("paths").alias("p")).distinct()
    # sizes first: a bulk commit never becomes one large array
    sizes = parts.groupBy(*BASKET).count().where(F.col("count") <= most).drop("count")
    lists = parts.join(sizes, BASKET, "left_semi").groupBy(*BASKET).agg(F.array_sort(F.collect_list("p")).alias("paths"))
    return plain.unionByName(mixed.join(lists, BASKET, "left"))


def decay(committed_at: Column, as_of: str, half_life_days: float) -> Column:
    """0.5 ** (age in days / half life); a commit after ``as_of`` has age 0, one without time weight 0."""
    age = (F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros(committed_at.cast("timestamp"))) / F.lit(86_400_000_000.0)
    return F.when(age.isNull(), 0.0).otherwise(F.pow(F.lit(0.5), F.greatest(age, F.lit(0.0)) / F.lit(half_life_days)))


def signed(changed: DataFrame, least: int) -> DataFrame:
    """The counted contents of changed baskets: new ones with sign 1, replaced ones (t0, p0) with sign -1."""
    sides = F.array(
        F.struct(F.col("committed_at").alias("committed_at"), F.col("paths").alias("paths"), F.lit(1).alias("sign")),
        F.struct(F.col("t0").alias("committed_at"), F.col("p0").alias("paths"), F.lit(-1).alias("sign")),
    )
    return changed.select("repo", F.inline(sides)).where(F.size("paths") >= least)


def pair_rows(changes: DataFrame, as_of: str, half_life_days: float) -> DataFrame:
    """PAIR, support (1 or -1), weight: the signed pairs of changed baskets."""
    pairs = F.expr("flatten(transform(paths, (a, i) -> transform(slice(paths, i + 2, size(paths)), b -> struct(a as path_a, b as path_b))))")
    weight = (F.col("sign") * decay(F.col("committed_at"), as_of, half_life_days)).cast("decimal(13,12)")
    return changes.select("repo", F.col("sign").cast("long").alias("support"), weight.cast(WEIGHT).alias("weight"), F.inline(pairs)).select(*PAIR, "support", "weight")


def item_rows(changes: DataFrame) -> DataFrame:
    return changes.select("repo", F.explode("paths").alias("path"), F.col("sign").cast("long").alias("n"))


def basket_rows(changes: DataFrame) -> DataFrame:
    return changes.select("repo", F.col("sign").cast("long").alias("baskets"))


def merge(state: DataFrame, deltas: DataFrame, keys: list[str], count: str) -> DataFrame:
    """State plus signed deltas, summed on the map side first; rows whose count falls to 0 are gone."""
    sums = [F.sum(c).cast(dict(state.dtypes)[c]).alias(c) for c in state.columns if c not in keys]
    return state.unionByName(deltas).groupBy(*keys).agg(*sums).where(F.col(count) != 0)


class PairStore(Versions):
    """The state in folder ``root``; pairs below ``min_support`` get no score.

    ``as_of`` is fixed for a state: at a later time all weights have fallen by one common factor.
    """

    def __init__(self, spark: SparkSession, root: str, as_of: str = "2025-12-31 00:00:00", half_life_days: float = 90.0, least: int = 2, most: int = 100, min_support: int = 1, buckets: int | None = None):
        super().__init__(spark, root, SCHEMAS, KEYS)
        self.as_of, self.half_life_days = as_of, half_life_days
        self.least, self.most, self.min_support, self.buckets = least, most, min_support, buckets

    # -- updates --------------------------------------------------------------------------
    def _layout(self, old: dict, table: str, expected: int) -> int:
        """The number of buckets: doubled when they would hold more than ``ROWS_PER_BUCKET`` rows each."""
        was = old["tables"][table]
        n = was["buckets"] or self.buckets or tasks_of(self.spark)
        held = self.read(table, manifest=old).count() if was["parts"] else 0  # from the files' footers
        while self.buckets is None and held + expected > n * ROWS_PER_BUCKET:
            n *= 2
        return n

    def _replace(self, old: dict, new: dict, folder: str, table: str, n: int, at: set[int], rows) -> None:
        """Write the buckets ``at`` of ``table``, of ``n``; ``rows(state)`` gives their new rows from their old ones."""
        state = self.read(table, at if n == old["tables"][table]["buckets"] else None, old)
        self.write(old, new, folder, table, rows(state), n, at)

    def update(self, commits: DataFrame) -> int:
        """Take in a delivery of commits (repo, commit_hash, committed_at, paths); gives the new version's number."""
        old = self.manifest()
        new = {"version": old["version"] + 1, "tables": {}}
        folder = self.folder(new["version"])
        # contents that were stored before meet the delivered ones
        held = old["tables"]["baskets"]["buckets"]
        before = self.read("baskets", self.touched("baskets", held, commits) if held else set(), old)
        before = before.select(*BASKET, F.col("committed_at").alias("t0"), F.col("paths").alias("p0"), F.lit(True).alias("was"))
        both = contents(commits, self.most).join(before, BASKET, "left")
        paths = F.when(F.col("was").isNull(), F.col("paths")).when(F.col("p0").isNotNull() & F.col("paths").isNotNull(), F.array_sort(F.array_union("p0", "paths")))
        both = both.select(*BASKET, F.greatest("t0", "committed_at").alias("committed_at"), F.when(F.size(paths) <= self.most, paths).alias("paths"), "t0", "p0", "was")
        same = F.col("was").isNotNull() & F.col("p0").eqNullSafe(F.col("paths")) & F.col("t0").eqNullSafe(F.col("committed_at"))
        merged = cut(both.where(~same))
        changed = merged.select(*BASKET, "committed_at", "paths")
        changes = signed(merged, self.least)
        size = F.size("paths").cast("long")
        most_pairs, most_items, repos = (int(x or 0) for x in changes.agg(F.sum(size * (size - 1) / 2), F.sum(size), F.approx_count_distinct("repo")).first())
        pairs, items, totals = pair_rows(changes, self.as_of, self.half_life_days), item_rows(changes), basket_rows(changes)
        at: dict[str, set[int]] = {}

        def replace(table: str, rows: DataFrame, expected: int, new_rows) -> None:
            n = self._layout(old, table, expected)
            at[table] = self.touched(table, n, rows)
            self._replace(old, new, folder, table, n, at[table], new_rows)

        # four independent tables, written side by side
        with ThreadPoolExecutor(4) as side:
            jobs = [side.submit(replace, "baskets", changed, changed.count(), lambda state: state.join(changed.select(*BASKET), BASKET, "left_anti").unionByName(changed))]
            for table, rows, expected, count in (("pairs", pairs, most_pairs, "support"), ("items", items, most_items, "n"), ("totals", totals, repos, "baskets")):
                jobs.append(side.submit(replace, table, rows, expected, lambda state, r=rows, t=table, c=count: merge(state, r, KEYS[t], c)))
            for job in jobs:
                job.result()

        # scores: of the buckets that hold a changed pair, or a pair with an item of a changed basket
        touched = items.select("repo", "path", F.lit(True).alias("t")).distinct()
        counts = self.read("items", manifest=new).join(touched, ["repo", "path"], "left")
        scored = cut(self._counted(self.read("pairs", manifest=new).where(F.col("support") >= self.min_support), counts))
        n = new["tables"]["pairs"]["buckets"]
        rescored = at["pairs"] | self.touched("scores", n, scored.where("t"))
        self._replace(old, new, folder, "scores", n, rescored, lambda _: scored.where(self.bucket("scores", n).isin(*rescored)))
        self.commit(new)
        return new["version"]

    @staticmethod
    def _counted(pairs: DataFrame, counts: DataFrame) -> DataFrame:
        """``pairs`` with n_a and n_b, and ``t`` where an item is marked in ``counts`` (repo, path, n, t)."""
        key = lambda side: F.struct("repo", F.col(f"path_{side}").alias("path")).alias(f"k_{side}")
        pairs = pairs.select("*", key("a"), key("b"))
        plans = {side: plan_fragments(pairs, f"k_{side}") for side in "ab"}
        out = pairs
        for side, plan in plans.items():
            of = counts.select(F.struct("repo", "path").alias(f"k_{side}"), F.col("n").alias(f"n_{side}"), F.col("t").alias(f"t_{side}"))
            out = fragment_join(out, of, f"k_{side}", F.struct(*PAIR), plan)
        return out.select(*PAIR, "support", "weight", "n_a", "n_b", F.coalesce("t_a", "t_b", F.lit(False)).alias("t"))

    def scores(self) -> DataFrame:
        """PAIR, support, weight, n_a, n_b, baskets, lift of the newest version."""
        now = self.manifest()
        scored = self.read("scores", manifest=now)
        scored = fragment_join(scored, self.read("totals", manifest=now), "repo", F.struct(*PAIR), plan_fragments(scored, "repo"))
        lift = F.col("support") * F.col("baskets") / (F.col("n_a") * F.col("n_b"))
        return scored.select(*PAIR, "support", F.col("weight").cast("double").alias("weight"), "n_a", "n_b", "baskets", lift.alias("lift"))
