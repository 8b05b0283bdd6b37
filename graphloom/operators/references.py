"""References to records that do not exist (yet, or any more).

Each non-empty endpoint of an edge refers to a node key that must live at the time the
edge was written. Keys are hashed to key ranges; inside a range they are dictionary-
encoded to dense integers, and for every period (month) that occurs two bitmaps over these
integers are compared: keys referred to, in blocks of 65,536 that are lists of 16-bit
integers where sparse and packed bits where dense; and keys that live through the whole
period, kept as one bitmap and, from each period to the next, the bits that flip.
``referred AND NOT parent`` leaves the few (key, period) bits that may be orphans; the
surviving bits are decoded to keys with the lives that begin or end in those periods, and
the edges of just these keys are checked against the exact life spans.

References are reduced to distinct (key, period) pairs on the map side, so a key that
holds a third of all edges is one row per period here. The way back to the edges is a
fragment-replicate join by measured load (``operators.skew``): a hot key's edges are split
over tasks, and the decoded key goes to just those.

Edge cases: a null repository or a null node key matches nothing; a null ``written_at``
lies in no life, so each non-empty endpoint of such an edge is an orphan (period null),
found without bitmaps; a time far from all others is one more period and costs no more; a
null ``indexed_at`` is no life; null and empty endpoints refer to nothing; repeated
deliveries give one row. Empty tables give empty results (or, without nodes, all
references). Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from graphloom.operators.skew import fragment_join, plan_fragments
from graphloom.plans.ship import ship
from graphloom.plans.tables import tasks_of

ROWS_PER_RANGE = 250_000
BLOCK = 1 << 16
SPARSE = BLOCK // 16  # up to so many values a block is a list of 16-bit integers
SURVIVORS = pa.schema([("key", pa.string()), ("periods", pa.list_(pa.int32())), ("born", pa.list_(pa.timestamp("us"))), ("died", pa.list_(pa.timestamp("us")))])


def month_number(ts: Column) -> Column:
    return (F.year(ts) * 12 + F.month(ts) - 1).cast("int")


def canonical_uri(uri: Column) -> Column:
    """Trimmed and percent-decoded; a ``%`` that starts no escape stays as it is."""
    safe = F.regexp_replace(F.regexp_replace(F.trim(uri), r"\+", "%2B"), r"%(?![0-9A-Fa-f]{2})", "%25")
    return F.coalesce(F.try_url_decode(safe), F.trim(uri))


def local_key(repo: Column, node_id: Column) -> Column:
    """(repo, id) as one string; a null repo has no key."""
    return F.concat(F.lit("l"), F.length(repo).cast("string"), F.lit(":"), repo, F.lit("/"), node_id)


def node_lives(nodes: DataFrame) -> DataFrame:
    """(key, born, died): a row per life, once under the local key and once under the URI."""
    uri = F.concat(F.lit("u"), canonical_uri(F.col("props")["repo_uri"]))
    keys = F.array(local_key(F.col("repo"), F.col("id")), uri)
    return (
        nodes.where("indexed_at is not null")
        .select(F.explode(keys).alias("key"), F.col("indexed_at").alias("born"), F.col("deleted_at").alias("died"))
        .where("key is not null")
        .distinct()
    )


def edge_references(edges: DataFrame, overlay: DataFrame) -> DataFrame:
    """(source_table, edge_id, side, edge_type, written_at, key) of every non-empty endpoint."""

    def side(name: str, empty: Column, key: Column) -> Column:
        return F.struct(F.lit(name).alias("side"), F.when(empty, None).otherwise(F.coalesce(key, F.lit("?"))).alias("key"))

    def ends(df: DataFrame, table: str, sides: list[Column]) -> DataFrame:
        return df.select(F.lit(table).alias("source_table"), "edge_id", "edge_type", "written_at", F.inline(F.array(*sides))).where("key is not null")

    local = ends(
        edges,
        "edges",
        [side(s, F.coalesce(F.col(f"{s}_id"), F.lit("")) == "", local_key(F.col(f"{s}_repo"), F.col(f"{s}_id"))) for s in ("src", "dst")],
    )
    global_ = ends(
        overlay,
        "overlay_edges",
        [side(s, F.coalesce(F.trim(f"{s}_uri"), F.lit("")) == "", F.concat(F.lit("u"), canonical_uri(F.col(f"{s}_uri")))) for s in ("src", "dst")],
    )
    return local.unionByName(global_)


def compress(codes: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """A bitmap of sorted distinct integers: (block number, 16-bit integers or packed bits) of each block."""
    blocks = []
    for part in np.split(codes, np.flatnonzero(np.diff(codes >> 16)) + 1) if len(codes) else []:
        low = (part & (BLOCK - 1)).astype(np.uint16)
        if len(low) > SPARSE:
            bits = np.zeros(BLOCK, bool)
            bits[low] = True
            low = np.packbits(bits)
        blocks.append((int(part[0]) >> 16, low))
    return blocks


def and_not(blocks: list[tuple[int, np.ndarray]], bits: np.ndarray) -> np.ndarray:
    """The integers of a bitmap whose bit in ``bits`` (packed) is not set."""
    left = []
    for at, block in blocks:
        other = bits[at * (BLOCK // 8) : (at + 1) * (BLOCK // 8)]
        if block.dtype == np.uint16:
            left.append(block[other[block >> 3] >> (7 - (block & 7)) & 1 == 0].astype(np.int64) + (at << 16))
        else:
            left.append(np.flatnonzero(np.unpackbits(block & ~other)) + (at << 16))
    return np.concatenate(left) if left else np.zeros(0, np.int64)


class Living:
    """The parents' bitmap of one period after another: only the bits of keys born or dead in between change."""

    def __init__(self, n: int, code: np.ndarray, first: np.ndarray, last: np.ndarray):
        """Keys 0 to n - 1; each life makes its key (``code``) live from period ``first`` to ``last``."""
        lived = first <= last
        code = np.concatenate([code[lived], code[lived]])
        at = np.concatenate([first[lived], last[lived] + 1])
        step = np.repeat(np.array([1, -1], np.int32), lived.sum())
        order = np.argsort(at, kind="stable")
        self.code, self.at, self.step = code[order], at[order], step[order]
        self.count = np.zeros(n, np.int32)
        self.bits = np.zeros(-(-n // BLOCK) * (BLOCK // 8), np.uint8)
        self.done = 0

    def move(self, period: int) -> np.ndarray:
        """Packed bits of the keys that live through the period (not before the last one asked for)."""
        end = np.searchsorted(self.at, period, side="right")
        if end > self.done:
            code = self.code[self.done : end]
            np.add.at(self.count, code, self.step[self.done : end])
            code = np.unique(code)
            mask = (128 >> (code & 7)).astype(np.uint8)
            alive = self.count[code] > 0
            np.bitwise_or.at(self.bits, code[alive] >> 3, mask[alive])
            np.bitwise_and.at(self.bits, code[~alive] >> 3, ~mask[~alive])
            self.done = end
        return self.bits


def _andnot_range(refs: pa.Table, lives: pa.Table) -> pa.Table:
    """Keys of one range with surviving bits: the periods, and the lives that begin or end in them."""
    if refs.num_rows == 0:
        return SURVIVORS.empty_table()
    encoded = refs.column("key").combine_chunks().dictionary_encode()
    words, codes = encoded.dictionary, encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    n = len(words)
    periods, at = np.unique(refs.column("period").to_numpy(), return_inverse=True)

    code_of = pa.compute.index_in(lives.column("key"), value_set=words).combine_chunks()
    lives = lives.filter(code_of.is_valid())
    of = code_of.drop_null().to_numpy(zero_copy_only=False).astype(np.int64)
    born = lives.column("born_month").to_numpy()
    died = lives.column("died_month").fill_null(np.iinfo(np.int32).max).to_numpy()
    # the first period after birth up to the last one before death are lived through
    living = Living(n, of, np.searchsorted(periods, born, side="right"), np.searchsorted(periods, died, side="left") - 1)

    order = np.lexsort((codes, at))
    codes, cuts = codes[order], np.searchsorted(at[order], np.arange(len(periods) + 1))
    left = [and_not(compress(codes[cuts[p] : cuts[p + 1]]), living.move(p)) for p in range(len(periods))]
    when = np.repeat(np.arange(len(periods)), [len(x) for x in left])
    code = np.concatenate(left)

    order = np.lexsort((when, code))
    code, when = code[order], when[order]
    keys, start = np.unique(code, return_index=True)
    # lives that begin or end in a surviving period of their key
    bits = code * len(periods) + when
    touch = np.zeros(len(of), bool)
    for month in (born, died):
        p = np.minimum(np.searchsorted(periods, month), len(periods) - 1)
        spot = np.minimum(np.searchsorted(bits, of * len(periods) + p), max(0, len(bits) - 1))
        touch |= (periods[p] == month) & (bits[spot] == of * len(periods) + p) if len(bits) else False
    pick = np.flatnonzero(touch)
    pick = pick[np.argsort(of[pick], kind="stable")]
    ends = np.searchsorted(of[pick], np.append(keys, n)).astype(np.int32)
    spans = [pa.ListArray.from_arrays(pa.array(ends), lives.column(c).combine_chunks().cast(pa.timestamp("us")).take(pa.array(pick))) for c in ("born", "died")]
    months = pa.ListArray.from_arrays(pa.array(np.append(start, len(code)).astype(np.int32)), pa.array(periods[when].astype(np.int32)))
    return pa.Table.from_arrays([words.take(pa.array(keys)), months, *spans], schema=SURVIVORS)


def orphan_references(edges: DataFrame, overlay: DataFrame, nodes: DataFrame, ranges: int | None = None) -> DataFrame:
    """(source_table, edge_id, side, edge_type, period): one row per edge and side without a living target.

    ``period`` is the month of ``written_at`` as year * 12 + month - 1, null for a null time.
    ``ranges`` is the number of key ranges; by default 64 a reduce task (so tasks are even), or as many as hold
    ``ROWS_PER_RANGE`` rows each (row counts come from the files' footers).
    """
    ship(edges.sparkSession)
    ranges = ranges or max(64 * tasks_of(edges.sparkSession), -(-(nodes.count() + 2 * edges.count() + 2 * overlay.count()) // ROWS_PER_RANGE))
    in_range = F.pmod(F.xxhash64("key"), F.lit(ranges)).cast("int").alias("r")
    refs = edge_references(edges, overlay).withColumn("period", month_number(F.col("written_at")))
    dated, undated = refs.where("period is not null"), refs.where("period is null")
    # distinct bits; map-side combine folds a hot key to one row per period
    bits = dated.groupBy("key", "period").agg(F.lit(1).alias("_")).select(in_range, "key", "period")
    lives = node_lives(nodes).select(in_range, "key", "born", "died", month_number(F.col("born")).alias("born_month"), month_number(F.col("died")).alias("died_month"))
    schema = "key string, periods array<int>, born array<timestamp_ntz>, died array<timestamp_ntz>"
    left = bits.groupBy("r").cogroup(lives.groupBy("r")).applyInArrow(_andnot_range, schema)
    # exact check of the surviving bits only; a hot key's edges are split over tasks
    lived = F.exists(
        F.arrays_zip("born", "died"),
        lambda x: (x["born"] <= F.col("written_at")) & (x["died"].isNull() | (F.col("written_at") < x["died"])),
    )
    suspect = fragment_join(dated, left, "key", F.struct("source_table", "edge_id", "side"), plan_fragments(dated, "key"))
    suspect = suspect.where(F.array_contains("periods", F.col("period")) & ~F.coalesce(lived, F.lit(False))).select(undated.columns)
    return suspect.unionByName(undated).groupBy("source_table", "edge_id", "side").agg(F.min("edge_type").alias("edge_type"), F.min("period").alias("period"))


def orphans_by_period(orphans: DataFrame) -> DataFrame:
    """Orphans counted per table, edge type and month (``yyyy-mm``, null where unknown)."""
    month = F.format_string("%04d-%02d", F.floor(F.col("period") / 12).cast("int"), (F.col("period") % 12 + 1).cast("int"))
    return (
        orphans.withColumn("month", F.when(F.col("period").isNotNull(), month))
        .groupBy("source_table", "edge_type", "month")
        .agg(F.count("*").alias("orphans"), F.count_if(F.col("side") == "src").alias("src_orphans"), F.count_if(F.col("side") == "dst").alias("dst_orphans"))
    )
