"""Long exact spans shared between records.

A span is shared if at least ``min_chars`` (200) code points stand exactly alike in two
different documents. Texts are cut into short "sentences" whose borders depend on the
content alone: a position is a border if the hash of the 8 characters there is the least
of some window of ``WINDOW`` positions (the last one on ties). Punctuation would not do,
since a shared span need not hold a whole sentence of prose; by these borders every span of
200 characters holds a run of two or more consecutive sentences and of at least ``RUN``
characters, cut alike in both documents.

1. From every border the run of sentences that reaches ``RUN`` characters is hashed and
   joined globally, and so is a quarter (chosen by hash) of the long runs that reach
   ``min_chars``.
2. A long run found in two documents proves both of them.
3. Of short runs found in two documents, those with a document not yet proven are checked
   window by window: a window of ``min_chars`` characters can only be shared if all runs that
   its characters alone decide are; such windows get a 128-bit hash, and windows found in two
   documents prove the rest. Equal hashes stand for equal texts; no texts are compared.

Groups are reduced to their least and greatest document id and their size, with map-side
combine, never collected; no pairs are made. The rows of a shared run or window are found
again by fragment-replicate joins by measured load, so a span that a third of all documents
hold is split over tasks.

``shared_coverage`` runs step 3 for all places, and merges the shared windows of each
document to spans; the part covered by windows whose first holder (least document id) is
another document is what deduplication would remove. Null, empty and short texts
share nothing; a span repeated within one document only doesn't count; ids are unique.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from graphloom.operators.skew import fragment_join, plan_fragments
from graphloom.plans.iterate import cut
from graphloom.plans.ship import ship

GRAM = 8
WINDOW = 64
RUN = WINDOW + 2  # more than one sentence, which has at most WINDOW characters
SEGMENT = 1 << 22
SIEVE_WORDS = 1 << 18  # words of 64 bits in the sieve of document ids
#: Odd multipliers of the rolling hashes; any odd numbers would do.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    return x ^ (x >> np.uint64(29))


class Texts:
    """The texts of one batch laid end to end, with hashes of any stretch."""

    def __init__(self, texts: list[str]):
        raw = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
        self.sizes = np.array([len(r) for r in raw], np.int64)
        self.ends = np.cumsum(self.sizes)
        self.starts = self.ends - self.sizes
        self.codes = np.concatenate(raw) if raw else np.zeros(0, np.uint32)
        self._sums: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def stretch(self, which: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """64-bit hashes of codes[a:b], by hash function 0 or 1."""
        if which not in self._sums:
            n = len(self.codes)
            base = np.uint64(BASES[which])
            back = np.uint64(pow(BASES[which], -1, 1 << 64))
            power = np.full(n + 1, base, np.uint64)
            inverse = np.full(n + 1, back, np.uint64)
            power[0] = inverse[0] = 1
            power, inverse = np.multiply.accumulate(power), np.multiply.accumulate(inverse)
            values = _mix(self.codes.astype(np.uint64) + np.uint64(which * 0x1F123BB5 + 1))
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(values * power[:-1], out=sums[1:])
            self._sums[which] = sums, inverse
        sums, inverse = self._sums[which]
        return _mix((sums[b] - sums[a]) * inverse[a])

    def borders(self) -> tuple[np.ndarray, np.ndarray]:
        """Border positions in rising order, and the text of each."""
        n = len(self.codes)
        grams = n - GRAM + 1
        if grams < WINDOW:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        low = self.codes.astype(np.uint64)
        value = low[: grams].copy()
        for k in range(1, GRAM):
            value *= np.uint64(0x100000001B3)
            value += low[k : k + grams]
        value = _mix(value)
        least, mask = np.empty(grams - WINDOW + 1, np.int64), np.uint64((1 << 23) - 1)
        for at in range(0, len(least), SEGMENT):
            part = value[at : at + SEGMENT + WINDOW - 1]
            # hash above, position below and reversed: the minimum is the last of the least
            key = (part & ~mask) | (mask - np.arange(len(part), dtype=np.uint64))
            size = 1
            while size * 2 <= WINDOW:
                key = np.minimum(key[: len(key) - size], key[size:])
                size *= 2
            least[at : at + len(key)] = (mask - (key & mask)).astype(np.int64) + at
        # windows that run over the end of a text decide nothing
        text = np.repeat(np.arange(len(self.ends)), self.sizes)[: len(least)]
        inside = np.arange(len(least)) + WINDOW + GRAM - 1 <= self.ends[text]
        self.least = np.where(inside, least, -1)
        at = self.least[inside]
        at = np.unique(at)
        return at, np.searchsorted(self.ends, at, side="right")

    def open_windows(self, at: np.ndarray, shared: np.ndarray, wanted: np.ndarray, min_chars: int) -> np.ndarray:
        """Starts of the windows whose own runs are all ``shared``, one of them ``wanted``.

        ``at`` are the borders; a run goes from each to the first border ``RUN`` characters on.
        The borders that the characters of a window alone decide lie between the least
        positions of its first and of its last ``WINDOW``.
        """
        far = min_chars - GRAM - WINDOW + 1
        start = np.arange(max(0, len(self.least) - far))
        first, last = self.least[start], self.least[start + far]
        text = np.repeat(np.arange(len(self.ends)), self.sizes)[: len(start)]
        good = (first >= 0) & (last >= 0) & (start + min_chars <= self.ends[text])
        start, first, last = start[good], first[good], last[good]
        number = np.full(len(self.codes) + 1, -1, np.int64)
        number[at] = np.arange(len(at))
        run_end = np.searchsorted(at, at + RUN)
        ok, want = (np.concatenate([[0], np.cumsum(x)]) for x in (shared, wanted))
        lo, hi = number[first], np.searchsorted(run_end, number[last], side="right")  # runs lo .. hi - 1
        hi = np.maximum(hi, lo)
        keep = (hi > lo) & (ok[hi] - ok[lo] == hi - lo) & (want[hi] > want[lo])
        return start[keep]


def _text_batches(batch: pa.RecordBatch, min_chars: int, chars: int = 1 << 21) -> Iterator[tuple[list[int], list[str], list[int]]]:
    """Ids, texts and row numbers, some two million characters at a time; short texts are left out."""
    ids, texts, rows, size = [], [], [], 0
    for row, (doc, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
        if text is None or len(text) < min_chars:
            continue
        ids.append(doc)
        texts.append(text)
        rows.append(row)
        size += len(text)
        if size >= chars:
            yield ids, texts, rows
            ids, texts, rows, size = [], [], [], 0
    if ids:
        yield ids, texts, rows


def _runs(at: np.ndarray, of: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Runs as (first, last) border: from each border to the first one ``reach`` characters on in its text."""
    j = np.searchsorted(at, at + reach)
    i = np.nonzero(j < len(at))[0]
    i = i[of[i] == of[j[i]]]
    return i, j[i]


def run_hashes(docs: DataFrame, min_chars: int) -> DataFrame:
    """(h, h2, doc), once a document: even ``h`` for a short run (h2 = 0), odd for a long one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, bodies, _ in _text_batches(batch, min_chars):
                texts, who = Texts(bodies), np.array(ids, np.int64)
                at, of = texts.borders()
                (i, j), (k, m) = _runs(at, of, RUN), _runs(at, of, min_chars)
                short = texts.stretch(0, at[i], at[j]) & ~np.uint64(1)
                long_ = texts.stretch(0, at[k], at[m]) | np.uint64(1)
                pick = (long_ >> np.uint64(33)) & np.uint64(3) == 0
                k, m, long_ = k[pick], m[pick], long_[pick]
                h2 = texts.stretch(1, at[k], at[m])
                h = np.concatenate([short, long_]).view(np.int64)
                out = [h, np.concatenate([np.zeros(len(short), np.int64), h2.view(np.int64)]), np.concatenate([who[of[i]], who[of[k]]])]
                order = np.lexsort(out)
                out = [x[order] for x in out]
                first = np.ones(len(h), bool)
                first[1:] = np.any([x[1:] != x[:-1] for x in out], axis=0)
                out = [x[first] for x in out]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], names=["h", "h2", "doc"])

    return docs.mapInArrow(run, "h long, h2 long, doc long")


def window_hashes(docs: DataFrame, min_chars: int) -> DataFrame:
    """(w1, w2, doc, start): the windows of ``min_chars`` that may be shared.

    ``docs`` has (doc, text, shared, wanted): hashes of the document's shared short runs,
    and of those among them that are to be checked.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [batch.column(k) for k in (2, 3)]
            for ids, bodies, rows in _text_batches(batch, min_chars):
                texts, who = Texts(bodies), np.array(ids, np.int64)
                at, of = texts.borders()
                i, j = _runs(at, of, RUN)
                hashes = (texts.stretch(0, at[i], at[j]) & ~np.uint64(1)).view(np.int64)
                flags = [np.zeros(len(at), bool), np.zeros(len(at), bool)]
                for t, row in enumerate(rows):
                    lo, hi = np.searchsorted(of[i], [t, t + 1])
                    for flag, values in zip(flags, lists, strict=True):
                        flag[i[lo:hi]] = np.isin(hashes[lo:hi], values[row].values.to_numpy())
                start = texts.open_windows(at, *flags, min_chars) if len(at) else np.zeros(0, np.int64)
                of = np.searchsorted(texts.ends, start, side="right")
                for k in range(0, len(start), 200_000):
                    p, o = start[k : k + 200_000], of[k : k + 200_000]
                    out = [texts.stretch(0, p, p + min_chars).view(np.int64), texts.stretch(1, p, p + min_chars).view(np.int64), who[o], (p - texts.starts[o]).astype(np.int32)]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], names=["w1", "w2", "doc", "start"])

    return docs.mapInArrow(run, "w1 long, w2 long, doc long, start int")


def _in_two(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that two documents have, with the first document and the number ``n`` of rows."""
    return rows.groupBy(*keys).agg(F.min("doc").alias("first"), F.max("doc").alias("_last"), F.count("*").alias("n")).where("first < _last").drop("_last")


def _members(docs: DataFrame, min_chars: int) -> tuple[DataFrame, DataFrame]:
    """(h, h2, doc), the runs that two documents share with all their documents; and (h, h2, n), those runs."""
    runs, keys = run_hashes(docs, min_chars), ["h", "h2"]
    shared = cut(_in_two(runs, keys).drop("first"))
    # only a shared run can be in many documents: its count is the load of its key
    members = fragment_join(runs, shared.select(*keys), keys, F.col("doc"), plan_fragments(shared, keys, weight="n"))
    return cut(members), shared


def _kept(docs: DataFrame, key: str, text: str) -> DataFrame:
    ship(docs.sparkSession)
    return docs.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text")).where("doc is not null and text is not null")


def _sieved(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """``rows`` without most of those whose ``doc`` is not in ``ids``, by a bitmap of hashed ids.

    The bitmap has at most ``SIEVE_WORDS`` words whatever the number of ids; the fuller, the more rows stay.
    """
    place = f"pmod(xxhash64(doc), {64 * SIEVE_WORDS}L)"
    word, bit = F.expr(f"shiftright({place}, 6)"), F.expr(f"shiftleft(1L, cast({place} % 64 as int))")
    words = ids.select(word.alias("_word"), bit.alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    held = rows.withColumn("_word", word).join(F.broadcast(words), "_word").where(F.col("_bits").bitwiseAND(bit) != 0)
    return held.drop("_word", "_bits")


def _with_texts(kept: DataFrame, need: DataFrame) -> DataFrame:
    """(doc, text, shared, wanted) of the documents in ``need``; most other texts don't move."""
    need = cut(need)
    return _sieved(kept, need.select("doc")).join(need, "doc").select("doc", "text", "shared", "wanted")


def sharing_documents(docs: DataFrame, min_chars: int = 200, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc): documents that share a span of at least ``min_chars`` with another one."""
    _check(min_chars)
    kept = _kept(docs, key, text).where(F.length("text") >= min_chars)
    members, runs = _members(kept, min_chars)
    proven = members.where("h % 2 <> 0").select("doc").distinct()
    short = members.where("h % 2 = 0").select("h", "doc")
    open_runs = short.join(proven, "doc", "left_anti").groupBy("h").agg(F.lit(True).alias("open"))
    marked = fragment_join(short, open_runs, "h", F.col("doc"), plan_fragments(runs.where("h % 2 = 0"), "h", weight="n"), "left")
    need = marked.groupBy("doc").agg(F.collect_set("h").alias("shared"), F.collect_set(F.when(F.col("open"), F.col("h"))).alias("wanted"))  # at most a document's runs
    windows = cut(window_hashes(_with_texts(kept, need.where("size(wanted) > 0")), min_chars).select("w1", "w2", "doc"))
    same = ["w1", "w2"]
    rest = fragment_join(windows, _in_two(windows, same).select(*same), same, F.col("doc"), plan_fragments(windows, same), "left_semi").select("doc")
    return proven.unionByName(rest).distinct()


def _places(kept: DataFrame, min_chars: int) -> DataFrame:
    """(doc, start, later): every shared window, and whether its first holder is another document."""
    members, _ = _members(kept, min_chars)
    need = members.where("h % 2 = 0").groupBy("doc").agg(F.collect_set("h").alias("shared"))
    windows, same = window_hashes(_with_texts(kept, need.withColumn("wanted", F.col("shared"))), min_chars), ["w1", "w2"]
    shared = cut(_in_two(windows, same))
    found = fragment_join(windows, shared.drop("n"), same, F.struct("doc", "start"), plan_fragments(shared, same, weight="n"))
    return found.select("doc", "start", (F.col("first") != F.col("doc")).alias("later"))


def shared_coverage(docs: DataFrame, min_chars: int = 200, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, n_chars, spans, shared_chars, removable_chars), a row per document that shares a span."""
    from pyspark.sql import Window

    _check(min_chars)
    kept = _kept(docs, key, text).where(F.length("text") >= min_chars)
    places = _places(kept, min_chars)
    # windows of one document in order: each adds what the one before doesn't cover
    order = Window.partitionBy("doc").orderBy("start")
    ahead = lambda only: F.max(F.when(only, F.col("start"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    places = places.withColumn("before", ahead(F.lit(True))).withColumn("before_later", ahead(F.col("later")))
    added = lambda before: F.least(F.lit(min_chars), F.coalesce(F.col("start") - F.col(before), F.lit(min_chars)))
    out = places.groupBy("doc").agg(
        F.count_if(F.col("before").isNull() | (F.col("start") - F.col("before") > min_chars)).alias("spans"),
        F.sum(added("before")).alias("shared_chars"),
        F.coalesce(F.sum(F.when(F.col("later"), added("before_later"))), F.lit(0)).alias("removable_chars"),
    )
    sizes = kept.select("doc", F.length("text").cast("long").alias("n_chars"))
    return out.join(sizes, "doc").select("doc", "n_chars", "spans", "shared_chars", "removable_chars")


def deduplicated(docs: DataFrame, min_chars: int = 200, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, text): all documents, without the stretches that a document with a smaller id holds first."""
    _check(min_chars)
    kept = _kept(docs, key, text)
    later = _places(kept.where(F.length("text") >= min_chars), min_chars).where("later")
    starts = later.groupBy("doc").agg(F.array_sort(F.collect_list("start")).alias("starts"))  # at most a document's length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for body, cuts in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                parts, at = [], 0
                for s in cuts.as_py() or ():
                    parts.append(body[at:s])
                    at = max(at, s + min_chars)
                out.append("".join(parts) + body[at:])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["doc", "text"])

    return kept.join(starts, "doc", "left").select("doc", "text", "starts").mapInArrow(run, "doc long, text string")


def _check(min_chars: int) -> None:
    if min_chars < 3 * WINDOW + GRAM:
        raise ValueError(f"min_chars must be at least {3 * WINDOW + GRAM}: shorter spans need not hold a run of two sentences")
