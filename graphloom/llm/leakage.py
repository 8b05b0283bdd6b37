"""Evaluation texts that stand in training texts.

The words of a text are its maximal runs of letters or digits after lower-casing. An item
leaks into a document if at least ``words`` (13) consecutive words of the item occur
consecutively there; a shorter item must occur whole.

The items become one Aho-Corasick automaton over their normalised texts. It does not hold
every window of 13 words, most of which overlap, but of each window one stretch of
``ANCHOR`` words, chosen so that neighbouring windows share it (the rarest among the items,
then the least by hash); a document that has the window has the stretch. Each document is
normalised and scanned once; where a stretch is found, the words to its left and right are
compared with the item's own, so the result is exact and has the passages' ends, which are
mapped back to character offsets of the original text. Items shorter than ``words`` are
patterns as a whole.

The items are a stated set against all documents. They are read to the driver in blocks of
at most ``block_windows`` windows, one automaton and one scan of the corpus per block:
at most 400,000 by default, which take some 330 MB in each Python worker (measured: 82 MB for
100,000), so one scan serves about 10,000 items of 50 words. Memory stays bounded whatever
their number.

Null and empty texts, and items without a word, have no hits. Repeated documents or items
are separate rows with their own hits; a repeated (document, item) hit is one row.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from graphloom.plans.ship import ship

WORDS = 13
ANCHOR = 6
GAP = re.compile(r"[\W_]+")
WORD = re.compile(r"[^\W_]+")


def normalise(text: str) -> str:
    """Words joined by single spaces, with one space before and after."""
    inner = GAP.sub(" ", text.lower()).strip()
    return f" {inner} " if inner else ""


def word_list(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def word_offsets(text: str) -> list[tuple[int, int]]:
    """Where each normalised word stands in the original text."""
    low = text.lower()
    spans = [m.span() for m in WORD.finditer(low)]
    if len(low) == len(text):
        return spans
    at, back = 0, []  # some characters grow when lower-cased
    for i, c in enumerate(text):
        back += [i] * len(c.lower())
        at += 1
    back += [at] * (len(low) - len(back) + 1)
    return [(back[a], back[b - 1] + 1) for a, b in spans]


class Items:
    """The automaton of a block of items (id, text)."""

    def __init__(self, items: tuple[tuple[int, str], ...], words: int = WORDS):
        self.words, self.anchor = words, min(ANCHOR, words)
        self.ids = [i for i, _ in items]
        self.texts = [word_list(t) for _, t in items]
        often = Counter(hash(g) for w in self.texts if len(w) >= words for g in self._stretches(w))
        places: dict[str, list[tuple[int, int]]] = {}
        for k, w in enumerate(self.texts):
            if 0 < len(w) < words:
                places.setdefault(f" {' '.join(w)} ", []).append((k, 0))
            elif w:
                grams = self._stretches(w)
                rank = [(often[hash(g)], hashlib.blake2b(g.encode(), digest_size=8).digest()) for g in grams]
                wide = words - self.anchor + 1  # stretches in a window
                for at in sorted({min(range(s, s + wide), key=rank.__getitem__) for s in range(len(grams) - wide + 1)}):
                    places.setdefault(grams[at], []).append((k, at))
        self.machine = ahocorasick.Automaton()
        for pattern, where in places.items():
            self.machine.add_word(pattern, (pattern.count(" ") - 1, tuple(where)))
        self.machine.make_automaton()

    def _stretches(self, w: list[str]) -> list[str]:
        return [f" {' '.join(w[i : i + self.anchor])} " for i in range(len(w) - self.anchor + 1)]

    def passages(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """(item, start, end, words) of the maximal leaked passages, in characters of the original.

        Passages of one item that overlap are one.
        """
        norm = normalise(text) if text and len(self.machine) else ""
        found: dict[int, list[tuple[int, int]]] = {}  # by item: first word, word after the last
        seen = counted = 0
        body: list[str] = []
        reached: dict[tuple[int, int], int] = {}  # by item and diagonal: the end of its last run
        for end, (size, where) in self.machine.iter(norm) if norm else ():
            counted += norm.count(" ", seen, end + 1)
            seen = end + 1
            at = counted - 1 - size  # the stretch's first word in the document
            body = body or norm.split()
            for k, own in where:
                item = self.texts[k]
                if len(item) < self.words:
                    found.setdefault(k, []).append((at, at + size))
                    continue
                if at < reached.get((k, at - own), -1):
                    continue
                a, b, i, j = at, at + size, own, own + size
                while a and i and body[a - 1] == item[i - 1]:
                    a, i = a - 1, i - 1
                while b < len(body) and j < len(item) and body[b] == item[j]:
                    b, j = b + 1, j + 1
                reached[k, at - own] = b
                if b - a >= self.words:
                    found.setdefault(k, []).append((a, b))
        if not found:
            return []
        offsets, out = word_offsets(text), []
        for k, runs in found.items():
            joined: list[list[int]] = []
            for a, b in sorted(runs):
                if joined and a < joined[-1][1]:
                    joined[-1][1] = max(b, joined[-1][1])
                else:
                    joined.append([a, b])
            out += [(self.ids[k], offsets[a][0], offsets[b - 1][1], b - a) for a, b in joined]
        return out


@lru_cache(maxsize=2)
def automaton(items: tuple[tuple[int, str], ...], words: int) -> Items:
    return Items(items, words)


def blocks(items: DataFrame, key: str, text: str, words: int, block_windows: int) -> Iterator[tuple[tuple[int, str], ...]]:
    block, size = [], 0
    for row in items.select(key, text).where(F.col(text).isNotNull()).orderBy(key).toLocalIterator():
        n = len(word_list(row[1]))
        n = n and max(1, n - words + 1)
        if block and size + n > block_windows:
            yield tuple(block)
            block, size = [], 0
        if n:
            block.append((row[0], row[1]))
            size += n
    if block:
        yield tuple(block)


def passages(docs: DataFrame, items: DataFrame, words: int = WORDS, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", block_windows: int = 400_000) -> DataFrame:
    """(doc_id, item_id, start, end, words) of each leaked passage, in characters of the document's text."""
    spark = docs.sparkSession
    ship(spark)
    kept = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).where("text is not null and text <> ''")
    schema = "doc_id long, item_id long, start int, end int, words int"

    def scan(block: tuple[tuple[int, str], ...]) -> DataFrame:
        held = spark.sparkContext.broadcast(block)  # at most block_windows windows

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            machine = automaton(held.value, words)
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
            for batch in batches:
                rows = [(doc, *hit) for doc, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for hit in machine.passages(body)]
                if rows:
                    columns = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in schema.split(", ")])

        return kept.mapInArrow(run, schema)

    out = None
    for block in blocks(items, item_key, item_text, words, block_windows):
        found = scan(block)
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], schema) if out is None else out.distinct()


def leaks(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """(doc_id, item_id): the documents and the items that leak into them; options as in ``passages``."""
    return passages(docs, items, **options).select("doc_id", "item_id").distinct()
