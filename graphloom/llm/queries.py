"""Queries of the problems tagged llm over whole tables, with their SQL twins where SQL can say them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from graphloom.llm import cooccurrence, leakage, sourcefilter, spans, tokenizer
from graphloom.plans.iterate import ensure_checkpoint_dir
from graphloom.plans.tables import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return sourcefilter.not_hand_written(table(spark, d, "nodes"), table(spark, d, "documents")).select("repo", "id")


def p1_by_reason(spark: SparkSession, d: str) -> DataFrame:
    found = sourcefilter.not_hand_written(table(spark, d, "nodes"), table(spark, d, "documents"))
    return found.select("repo", F.explode("reasons").alias("reason")).groupBy("repo", "reason").agg(F.count("*").alias("files"))


def _pairs(spark: SparkSession, d: str, cuts: tuple[str, ...], min_support: int = 1) -> cooccurrence.PairStore:
    """A pair state in the shared folder after one delivery of commits per span of ``loaded_at`` between the cuts."""
    ensure_checkpoint_dir(spark)
    store = cooccurrence.PairStore(spark, f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pairs-{uuid.uuid4().hex[:12]}", min_support=min_support)
    commits, at = table(spark, d, "commits"), F.col("loaded_at")
    days = [F.lit(c).cast("timestamp_ntz") for c in cuts]
    for low, high in zip([None, *days], [*days, None], strict=True):
        after = at.isNull() if high is None else F.lit(False)  # rows without a time come last
        inside = (F.lit(True) if low is None else at >= low) & (F.lit(True) if high is None else at < high)
        store.update(commits.where(F.coalesce(inside, after)))
    return store


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    scored = _pairs(spark, d, ("2025-07-01",), min_support=5).scores()
    return scored.where("support * baskets >= 4 * n_a * n_b").select("repo", "path_a", "path_b")


def _all_scores(store: cooccurrence.PairStore) -> DataFrame:
    return store.scores().select("repo", "path_a", "path_b", "support", F.round("weight", 6).alias("weight"), F.round("lift", 6).alias("lift"))


def p3_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _all_scores(_pairs(spark, d, ("2025-07-01",)))


def p3_incremental(spark: SparkSession, d: str) -> DataFrame:
    """The same pairs in four deliveries, the last of which holds everything again."""
    store = _pairs(spark, d, ("2024-07-01", "2025-03-01"))
    store.update(table(spark, d, "commits"))
    return _all_scores(store)


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenizer.encode_documents(table(spark, d, "documents"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p7_passages(spark: SparkSession, d: str) -> DataFrame:
    return leakage.passages(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return spans.sharing_documents(table(spark, d, "documents")).select(F.col("doc").alias("doc_id"))


def p8_coverage(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared_coverage(table(spark, d, "documents")).withColumnRenamed("doc", "doc_id")


def p8_deduplicated(spark: SparkSession, d: str) -> DataFrame:
    kept = spans.deduplicated(table(spark, d, "documents"))
    return kept.select(F.col("doc").alias("doc_id"), F.length("text").cast("long").alias("kept_chars"))


QUERIES = {f.__name__: f for f in (p1_found, p1_by_reason, p3_found, p3_pairs, p3_incremental, p6_ids, p7_found, p7_passages, p8_found, p8_coverage, p8_deduplicated)}

_PAIRS = r"""
c AS (SELECT repo, commit_hash, max(committed_at) AS t, list_distinct(list(p)) AS paths FROM (
  SELECT repo, commit_hash, committed_at, nullif(regexp_replace(trim(u), '^\./', ''), '') AS p FROM (SELECT repo, commit_hash, committed_at, unnest(paths) AS u FROM commits))
  WHERE p IS NOT NULL AND repo IS NOT NULL AND commit_hash IS NOT NULL GROUP BY ALL),
b AS (SELECT repo, commit_hash, max(t) AS t, list_distinct(flatten(list(paths))) AS paths FROM c GROUP BY ALL),
k AS (SELECT * FROM b WHERE len(paths) BETWEEN 2 AND 100),
x AS (SELECT repo, commit_hash, t, unnest(paths) AS p FROM k),
n AS (SELECT repo, p, count(*) AS n FROM x GROUP BY ALL),
m AS (SELECT repo, count(*) AS baskets FROM k GROUP BY ALL),
s AS (SELECT a.repo, a.p AS path_a, b.p AS path_b, count(*) AS support,
  sum(pow(0.5, greatest(0, epoch_us(TIMESTAMP '2025-12-31') - epoch_us(a.t)) / 86400000000.0 / 90)) AS weight
  FROM x a JOIN x b ON a.repo = b.repo AND a.commit_hash = b.commit_hash AND a.p < b.p GROUP BY ALL),
r AS (SELECT s.*, na.n AS n_a, nb.n AS n_b, m.baskets FROM s JOIN n na ON na.repo = s.repo AND na.p = path_a JOIN n nb ON nb.repo = s.repo AND nb.p = path_b JOIN m ON m.repo = s.repo)
"""
_ALL_PAIRS = f"WITH {_PAIRS} SELECT repo, path_a, path_b, support, round(weight, 6) AS weight, round(support * baskets / (n_a * n_b), 6) AS lift FROM r"

_WINDOWS = """
w AS (SELECT doc_id, unnest(generate_series(1, length(text) - 199)) AS s, text FROM documents WHERE length(text) >= 200),
h AS (SELECT doc_id, s, substring(text, s, 200) AS k FROM w),
g AS (SELECT k, min(doc_id) AS f FROM h GROUP BY k HAVING min(doc_id) < max(doc_id))
"""

SQL = {
    "p3_found": f"WITH {_PAIRS} SELECT repo, path_a, path_b FROM r WHERE support >= 5 AND support * baskets >= 4 * n_a * n_b",
    "p3_pairs": _ALL_PAIRS,
    "p3_incremental": _ALL_PAIRS,
    "p7_found": r"""WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text <> ''),
i AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM eval_items WHERE text <> ''),
j AS (SELECT item_id, least(13, len(w)) AS k, unnest(generate_series(1, len(w) - least(13, len(w)) + 1)) AS s, w FROM i WHERE len(w) > 0),
n AS (SELECT DISTINCT item_id, k, array_to_string(w[s:s + k - 1], ' ') AS g FROM j),
e AS (SELECT doc_id, k, unnest(generate_series(1, len(w) - k + 1)) AS s, w FROM d, (SELECT DISTINCT k FROM n) WHERE len(w) >= k)
SELECT DISTINCT doc_id, item_id FROM (SELECT doc_id, k, array_to_string(w[s:s + k - 1], ' ') AS g FROM e) JOIN n USING (k, g)""",
    # words with the gap before them, so that lengths give the offsets; windows that overlap are one passage
    "p7_passages": r"""WITH p AS (SELECT doc_id, regexp_extract_all(text, '[^\p{L}\p{N}]*[\p{L}\p{N}]+') AS g FROM documents WHERE text <> ''),
d AS (SELECT doc_id, list_transform(g, lambda x: lower(regexp_extract(x, '[\p{L}\p{N}]+$'))) AS w, list_transform(g, lambda x: length(x)) AS l FROM p),
i AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM eval_items WHERE text <> ''),
n AS (SELECT DISTINCT item_id, k, array_to_string(w[s:s + k - 1], ' ') AS g FROM (SELECT item_id, least(13, len(w)) AS k, unnest(generate_series(1, len(w) - least(13, len(w)) + 1)) AS s, w FROM i WHERE len(w) > 0)),
e AS (SELECT doc_id, k, unnest(generate_series(1, len(w) - k + 1)) AS s, w FROM d, (SELECT DISTINCT k FROM n) WHERE len(w) >= k),
h AS (SELECT DISTINCT doc_id, item_id, k, s FROM (SELECT doc_id, k, s, array_to_string(w[s:s + k - 1], ' ') AS g FROM e) JOIN n USING (k, g)),
o AS (SELECT *, sum(b) OVER (PARTITION BY doc_id, item_id ORDER BY s) AS run FROM (SELECT *, CASE WHEN s - lag(s) OVER (PARTITION BY doc_id, item_id ORDER BY s) < k THEN 0 ELSE 1 END AS b FROM h)),
r AS (SELECT doc_id, item_id, min(s) AS a, max(s + k) - 1 AS z FROM o GROUP BY doc_id, item_id, run)
SELECT doc_id, item_id, CAST(list_sum(l[:a]) - length(w[a]) AS INTEGER) AS start, CAST(list_sum(l[:z]) AS INTEGER) AS "end", CAST(z - a + 1 AS INTEGER) AS words FROM r JOIN d USING (doc_id)""",
    "p8_found": f"WITH {_WINDOWS} SELECT DISTINCT doc_id FROM h JOIN g USING (k)",
    "p8_coverage": f"""WITH {_WINDOWS},
p AS (SELECT doc_id, s, f <> doc_id AS later FROM h JOIN g USING (k)),
o AS (SELECT *, lag(s) OVER (PARTITION BY doc_id ORDER BY s) AS b, max(CASE WHEN later THEN s END) OVER (PARTITION BY doc_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS bl FROM p)
SELECT o.doc_id, any_value(length(d.text)) AS n_chars, count(*) FILTER (b IS NULL OR s - b > 200) AS spans,
CAST(sum(least(200, coalesce(s - b, 200))) AS BIGINT) AS shared_chars, CAST(coalesce(sum(least(200, coalesce(s - bl, 200))) FILTER (later), 0) AS BIGINT) AS removable_chars
FROM o JOIN documents d USING (doc_id) GROUP BY o.doc_id""",
    "p8_deduplicated": f"""WITH {_WINDOWS},
p AS (SELECT doc_id, s FROM h JOIN g USING (k) WHERE f <> doc_id),
o AS (SELECT doc_id, sum(least(200, coalesce(s - b, 200))) AS gone FROM (SELECT *, lag(s) OVER (PARTITION BY doc_id ORDER BY s) AS b FROM p) GROUP BY doc_id)
SELECT doc_id, CAST(length(text) - coalesce(gone, 0) AS BIGINT) AS kept_chars FROM documents LEFT JOIN o USING (doc_id) WHERE text IS NOT NULL""",
}
