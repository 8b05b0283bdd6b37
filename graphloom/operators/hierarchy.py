"""Parent-child rows to full hierarchies, per trace file.

Every span gets its parent, root, depth, path, number of descendants and a nested-set
range (``pre`` to ``pre + descendants``): subtree sizes are summed upward, sibling ranges
are allocated downward by prefix sums, and spans that no root reaches are on a circle of
parents or below one. ``a`` is an ancestor of ``b`` in a file exactly if
``a.pre < b.pre <= a.pre + a.descendants``.

Files are moved whole to tasks by one shuffle and solved there with array operations, all
files of a task at once, level by level. A file with more than ``max_file_rows`` rows does
not fit one task's memory; such files are solved by distributed joins with the same result.
There the walk around the forest (into each span, through its children in order, out again)
is a linked list of two places per span, whose prefix sums by pointer doubling give
preorder, depth, subtree size and root at once: a join of all places per doubling, so the
rounds grow with the logarithm of the file's size, not with its depth. Places that never
find the list's start are on a circle or below one.

Rules. Ids are trimmed and lower-cased; null, empty and all-zero ids mean none; rows
without a span id are left out. Of several rows of a span the latest ``received_at``
holds (null is oldest; equal times are decided by the larger content hash). The parent is the span of the
same file with the id ``parent_span_id``, else the one with the id ``parent``, else the
only one whose trimmed name equals the trimmed ``parent``, else none. A null
``trace_file`` is a file of its own. Siblings are ordered by hash and id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from graphloom.operators.skew import fragment_join, plan_fragments
from graphloom.plans.iterate import cut, discard, written
from graphloom.plans.ship import ship
from graphloom.plans.tables import tasks_of

BLANK = " \t\r\n"
CHUNKS = 256
ROWS_PER_TASK = 250_000
SIEVE_WORDS = 1 << 18
TREE = "trace_file string, span_id string, parent_id string, root string, depth int, pre long, descendants long, rootless boolean"
PATHS = TREE + ", path string"


def clean_id(c: Column) -> Column:
    out = F.lower(F.btrim(c, F.lit(BLANK)))
    return F.when((out != "") & ~out.rlike("^0+$"), out)


def prepare(spans: DataFrame) -> DataFrame:
    """The columns the forest needs, ids cleaned; rows without a span id are gone."""
    text = lambda c: F.btrim(F.col(c), F.lit(BLANK))
    return spans.select(
        "trace_file",
        clean_id(F.col("span_id")).alias("sid"),
        clean_id(F.col("parent_span_id")).alias("p1"),
        clean_id(F.col("parent")).alias("p2"),
        text("name").alias("name"),
        F.when(text("parent") != "", text("parent")).alias("pname"),
        F.coalesce(F.unix_micros(F.col("received_at").cast("timestamp")), F.lit(-(1 << 62))).alias("recv"),
        F.xxhash64("parent_span_id", "parent", "name").alias("tie"),
    ).where("sid is not null").withColumn("chunk", F.pmod(F.xxhash64("sid"), F.lit(CHUNKS)).cast("int"))


def _codes(column: pa.ChunkedArray, words: pa.Array | None = None) -> tuple[np.ndarray, pa.Array]:
    """Integers for the column's values, -1 for null or for values not in ``words``."""
    if words is None:
        column = column.combine_chunks().dictionary_encode()
        column, words = column.indices, column.dictionary
    else:
        column = pc.index_in(column, value_set=words)
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64), words


def _lookup(keys: np.ndarray, want: np.ndarray, ok: np.ndarray) -> np.ndarray:
    """Position of each wanted key in the sorted ``keys``, -1 where absent or not ok."""
    at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
    return np.where(ok & (keys[at] == want), at, -1)


def solve(rows: pa.Table, paths: bool = False) -> pa.Table:
    """The forest of all files in ``rows`` (as ``prepare`` makes them)."""
    if rows.num_rows == 0:
        return pa.table({})
    file, files = _codes(rows.column("trace_file"))
    sid, sids = _codes(rows.column("sid"))
    wide = len(sids) + 1
    key = (file + 1) * wide + sid
    order = np.lexsort((rows.column("tie").to_numpy(), rows.column("recv").to_numpy(), key))
    last = order[np.append(key[order][1:] != key[order][:-1], True)]
    rows, file, sid, key = rows.take(pa.array(last)), file[last], sid[last], key[last]
    n = len(key)

    p1, _ = _codes(rows.column("p1"), sids)
    p2, _ = _codes(rows.column("p2"), sids)
    base = (file + 1) * wide
    par = _lookup(key, base + p1, p1 >= 0)
    par = np.where(par >= 0, par, _lookup(key, base + p2, p2 >= 0))
    name, names = _codes(rows.column("name"))
    pname, _ = _codes(rows.column("pname"), names)
    nkey = (file + 1) * (len(names) + 1) + name
    by_name = np.argsort(nkey, kind="stable")
    uniq, first, count = np.unique(nkey[by_name], return_index=True, return_counts=True)
    at = _lookup(uniq, (file + 1) * (len(names) + 1) + pname, pname >= 0)
    named = np.where((at >= 0) & (count[at] == 1), by_name[first[at]], -1)
    par = np.where(par >= 0, par, named)

    # children in sibling order, as ranges of ``kids``
    sid_rank = np.empty(len(sids), np.int64)
    sid_rank[pc.array_sort_indices(sids).to_numpy()] = np.arange(len(sids))
    chunk = rows.column("chunk").to_numpy()
    kids = np.lexsort((sid_rank[sid], chunk, par))
    kids = kids[par[kids] >= 0]
    lo = np.searchsorted(par[kids], np.arange(n))
    hi = np.searchsorted(par[kids], np.arange(n) + 1)

    # upward: sizes, peeling leaves
    size = np.ones(n, np.int64)
    open_kids = hi - lo
    leaves = np.nonzero(open_kids == 0)[0]
    while len(leaves):
        up = leaves[par[leaves] >= 0]
        np.add.at(size, par[up], size[up])
        np.subtract.at(open_kids, par[up], 1)
        touched = np.unique(par[up])
        leaves = touched[open_kids[touched] == 0]

    # downward: ranges by prefix sums over siblings
    depth = np.full(n, -1, np.int64)
    pre = np.full(n, -1, np.int64)
    root = np.full(n, -1, np.int64)
    text: list[str | None] = [None] * (n if paths else 0)
    names_of = rows.column("sid").to_pylist() if paths else []
    level = np.nonzero(par < 0)[0]
    # roots of a file one after another
    level = level[np.lexsort((sid_rank[sid[level]], chunk[level], file[level]))]
    ahead = np.cumsum(size[level]) - size[level]
    new_file = np.append(True, file[level][1:] != file[level][:-1]) if len(level) else np.zeros(0, bool)
    base_of = np.maximum.accumulate(np.where(new_file, ahead, 0)) if len(level) else ahead
    pre[level], depth[level], root[level] = ahead - base_of, 0, level
    for i in level if paths else ():
        text[i] = "/" + names_of[i]
    d = 0
    while len(level):
        widths = (hi - lo)[level]
        total = int(widths.sum())
        if not total:
            break
        offsets = np.cumsum(widths) - widths
        nxt = kids[np.repeat(lo[level] - offsets, widths) + np.arange(total)]
        run = np.cumsum(size[nxt]) - size[nxt]
        heads = np.repeat(run[np.minimum(offsets, total - 1)], widths)
        d += 1
        pre[nxt] = pre[par[nxt]] + 1 + run - heads
        depth[nxt], root[nxt] = d, root[par[nxt]]
        for i in nxt if paths else ():
            text[i] = f"{text[par[i]]}/{names_of[i]}"
        level = nxt

    lost = depth < 0
    ids = rows.column("sid").combine_chunks()
    pick = lambda at, no: ids.take(pa.array(np.where(no, 0, at), mask=no))
    out = {
        "trace_file": rows.column("trace_file"),
        "span_id": ids,
        "parent_id": pick(par, par < 0),
        "root": pick(root, lost),
        "depth": pa.array(depth.astype(np.int32), mask=lost),
        "pre": pa.array(pre, mask=lost),
        "descendants": pa.array(size - 1, mask=lost),
        "rootless": pa.array(lost),
    }
    return pa.table(out | ({"path": pa.array(text, pa.string())} if paths else {}))


def _solver(paths: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if held:
            yield from solve(pa.Table.from_batches(held), paths).to_batches(max_chunksize=20_000)

    return run


def forest(spans: DataFrame, paths: bool = False, max_file_rows: int = 1_000_000, parts: int | None = None) -> DataFrame:
    """One row per span: ``TREE`` (and ``path`` if wanted, ids from the root joined by ``/``).

    ``max_file_rows`` bounds what one task must hold of a single file; larger files are
    solved by distributed joins, with the same result. The two are told apart by a bitmap of
    hashed file names of fixed size; a small file that shares a larger one's bit goes its way.
    """
    ship(spans.sparkSession)
    rows = prepare(spans)
    sizes = rows.groupBy("trace_file").count()
    total, large = sizes.agg(F.sum("count"), F.count_if(F.col("count") > max_file_rows)).first()
    # a task holds its share of the rows in memory: as many tasks as that takes
    parts = parts or max(tasks_of(spans.sparkSession), -(-(total or 0) // ROWS_PER_TASK))
    solve_whole = lambda df: df.repartition(parts, "trace_file").mapInArrow(_solver(paths), PATHS if paths else TREE)
    if not large:
        return solve_whole(rows)
    place = f"pmod(xxhash64(trace_file), {64 * SIEVE_WORDS}L)"
    word, bit = F.expr(f"shiftright({place}, 6)"), F.expr(f"shiftleft(1L, cast({place} % 64 as int))")
    marks = sizes.where(F.col("count") > max_file_rows).select(word.alias("_word"), bit.alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    marked = rows.withColumn("_word", word).join(F.broadcast(marks), "_word", "left")  # at most SIEVE_WORDS rows
    is_large = F.coalesce(F.col("_bits").bitwiseAND(bit) != 0, F.lit(False))
    return solve_whole(marked.where(~is_large).select(rows.columns)).unionByName(forest_by_joins(marked.where(is_large).select(rows.columns), paths))


def resolve_parents(rows: DataFrame) -> DataFrame:
    """(f, sid, parent_id, chunk) with the parent rules, by joins; ``f`` is the file as a key that is never null."""
    f = F.coalesce(F.concat(F.lit("="), "trace_file"), F.lit("")).alias("f")
    latest = rows.groupBy(f, "sid", "chunk").agg(F.max_by(F.struct("p1", "p2", "name", "pname"), F.struct("recv", "tie")).alias("r")).select("f", "sid", "chunk", "r.*")
    latest = cut(latest)
    ids = latest.select("f", F.col("sid").alias("i"))
    named = latest.where("name is not null").groupBy("f", F.col("name").alias("pname")).agg(F.count("*").alias("c"), F.min("sid").alias("by_name")).where("c = 1").drop("c")
    # many spans may give one parent: the known parents are replicated to where those are spread
    out = latest.select("f", "sid", "chunk", "p1", "p2", "pname")
    for key, of, found in (("p1", ids, "by_p1"), ("p2", ids, "by_p2"), ("pname", named, "by_name")):
        of = of.withColumn(found, F.col("i")).withColumnRenamed("i", key) if of is ids else of
        keyed = fragment_join(out, of, ["f", key], F.col("sid"), plan_fragments(latest, ["f", key]), "left")
        out = keyed.unionByName(out.where(F.col(key).isNull()).withColumn(found, F.lit(None).cast("string")))
    return out.select("f", "sid", "chunk", F.coalesce("by_p1", "by_p2", "by_name").alias("parent_id"))


def _walk(tree: DataFrame) -> DataFrame:
    """(f, at, jump, s, d, r): the places of the walk around each file's forest, each with the one before it.

    ``at`` is ``<ID`` into a span and ``>ID`` out of it; ``s`` and ``d`` count what the place
    before adds to preorder and depth, ``r`` is the root entered at the place itself.
    """
    up = F.coalesce("parent_id", F.lit("")).alias("up")  # roots are siblings below the empty id
    kin = tree.select("f", "sid", "chunk", up)
    # siblings in the order of (chunk, sid): links inside chunks, then from chunk to chunk
    inner = Window.partitionBy("f", "up", "chunk").orderBy("sid")
    kin = kin.withColumn("left", F.lag("sid").over(inner))
    chunks = kin.groupBy("f", "up", "chunk").agg(F.min("sid").alias("sid"), F.max("sid").alias("tail"))
    outer = Window.partitionBy("f", "up").orderBy("chunk")  # at most CHUNKS rows
    heads = chunks.select("f", "up", "sid", F.lag("tail").over(outer).alias("across"))
    last = chunks.groupBy("f", F.col("up").alias("sid")).agg(F.max_by("tail", "chunk").alias("child"))
    kin = kin.join(heads, ["f", "up", "sid"], "left").join(last, ["f", "sid"], "left")
    left, root = F.coalesce("left", "across"), F.col("up") == ""
    enters = kin.select("f", F.concat(F.lit("<"), "sid").alias("at"), F.when(left.isNotNull(), F.concat(F.lit(">"), left)).when(~root, F.concat(F.lit("<"), "up")).alias("jump"), F.when(root, F.col("sid")).alias("r"))
    leaves = kin.select("f", F.concat(F.lit(">"), "sid").alias("at"), F.coalesce(F.concat(F.lit(">"), "child"), F.concat(F.lit("<"), "sid")).alias("jump"), F.lit(None).cast("string").alias("r"))
    into = F.col("jump").startswith("<")
    return enters.unionByName(leaves).select("f", "at", "jump", F.when(into, 1).otherwise(0).cast("long").alias("s"), F.when(F.col("jump").isNull(), 0).when(into, 1).otherwise(-1).cast("long").alias("d"), "r")


def forest_by_joins(rows: DataFrame, paths: bool = False) -> DataFrame:
    """``forest`` for files of any size and depth; ``rows`` as ``prepare`` makes them."""
    tree = written(resolve_parents(rows))
    state, known = written(_walk(tree)), -1
    # after k rounds the first 2^k places of each list know their sums; circles never do
    while (now := state.where("jump is null").count()) > known:
        known = now
        to = state.select("f", F.col("at").alias("jump"), F.col("jump").alias("j2"), F.col("s").alias("s2"), F.col("d").alias("d2"), F.col("r").alias("r2"))
        moved = state.where("jump is not null").join(to, ["f", "jump"])
        moved = moved.select("f", "at", F.col("j2").alias("jump"), (F.col("s") + F.col("s2")).alias("s"), (F.col("d") + F.col("d2")).alias("d"), F.coalesce("r", "r2").alias("r"))
        state, old = written(state.where("jump is null").unionByName(moved)), state
        discard(old)
    way = F.col("at").startswith("<")
    spans = state.where("jump is null").groupBy("f", F.expr("substr(at, 2)").alias("sid")).agg(
        F.max(F.when(way, F.col("s"))).alias("pre"), F.max(F.when(~way, F.col("s"))).alias("end"), F.max(F.when(way, F.col("d"))).cast("int").alias("depth"), F.max(F.when(way, F.col("r"))).alias("root")
    )
    out = tree.join(spans, ["f", "sid"], "left")
    shape = [F.when(F.col("f") != "", F.expr("substr(f, 2)")).alias("trace_file"), F.col("sid").alias("span_id"), "parent_id", "root", "depth", "pre", (F.col("end") - F.col("pre") - 1).alias("descendants"), F.col("pre").isNull().alias("rootless")]
    if not paths:
        return out.select(*shape)
    # paths by doubling: 2^k ids after k rounds
    own = F.concat(F.lit("/"), "sid")
    line = written(out.where("pre is not null").select("f", "sid", F.col("parent_id").alias("jump"), own.alias("path")))
    while not line.where("jump is not null").isEmpty():
        to = line.select("f", F.col("sid").alias("jump"), F.col("jump").alias("j2"), F.col("path").alias("p2"))
        moved = line.where("jump is not null").join(to, ["f", "jump"]).select("f", "sid", F.col("j2").alias("jump"), F.concat("p2", "path").alias("path"))
        line, old = written(line.where("jump is null").unionByName(moved)), line
        discard(old)
    return out.join(line.select("f", "sid", "path"), ["f", "sid"], "left").select(*shape, "path")


def rootless(spans: DataFrame, max_file_rows: int = 1_000_000) -> DataFrame:
    """Spans on a circle of parents, or below one."""
    return forest(spans, max_file_rows=max_file_rows).where("rootless").select("trace_file", "span_id")


def descendants(tree: DataFrame, of: DataFrame) -> DataFrame:
    """(trace_file, ancestor, span_id) for the spans in ``of`` (trace_file, span_id), by nested-set ranges."""
    top = tree.join(of.select("trace_file", "span_id").distinct(), ["trace_file", "span_id"], "left_semi").where("not rootless")
    top = top.select("trace_file", F.col("span_id").alias("ancestor"), F.col("pre").alias("lo"), (F.col("pre") + F.col("descendants")).alias("hi"))
    return tree.where("not rootless").join(top, "trace_file").where("pre > lo and pre <= hi").select("trace_file", "ancestor", "span_id")
