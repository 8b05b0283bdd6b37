"""Byte-level BPE as a lazily determinised finite-state transducer.

``Bpe`` compiles a rank table (the ``.tiktoken`` form of a public vocabulary) to a trie of
the token bytes. The automaton over it reads one byte at a time; its state is the longest
suffix of the input that some vocabulary entry starts with. Trie nodes are its states,
and transitions that leave the trie are determinised over failure links when first
needed, and kept. With each state go the tokens that end there, longest first; the first
one compatible with the last token before it is the last token of the prefix read so far.
No later token can begin before the state's own start, so what all of those starts agree
on is certain and is emitted: lookahead is bounded by the longest vocabulary entry.
Whether two tokens may stand side by side is decided once by walking the pieces at their
common border, and kept as well.

Decoding feeds token bytes to an incremental UTF-8 machine (``Utf8Stream``).

Null and empty texts have the empty list of ids. Special-token strings in a text are
ordinary text. The vocabulary file's path is a parameter.
"""

from __future__ import annotations

import base64
import codecs
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from graphloom.plans.ship import ship

#: The published pre-tokenisation pattern of the byte_bpe_50k vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Memory bounds of one Python worker; the tables are cleared and refilled beyond them.
MAX_WORDS = 400_000
MAX_PAIRS = 500_000
EMIT_AFTER = 4096  # bytes of one piece after which certain tokens are emitted


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class Bpe:
    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        self.ranks = ranks
        self.bytes_of = {r: t for t, r in ranks.items()}
        self.split = regex.compile(pattern).findall
        # trie of the vocabulary: node -> {byte: node}, and the token a node ends
        self.next: list[dict[int, int]] = [{}]
        self.ends: list[int] = [-1]
        for token, rank in ranks.items():
            node = 0
            for b in token:
                to = self.next[node].get(b)
                if to is None:
                    to = len(self.next)
                    self.next[node][b] = to
                    self.next.append({})
                    self.ends.append(-1)
                node = to
            self.ends[node] = rank
        self.size = {r: len(t) for r, t in self.bytes_of.items()}
        self.depth = [0] * len(self.next)
        self.up: list[tuple[int, int]] = [(0, 0)] * len(self.next)  # parent and byte
        for node, kids in enumerate(self.next):
            for b, to in kids.items():
                self.depth[to], self.up[to] = self.depth[node] + 1, (node, b)
        self.fail: list[int] = [-1] * len(self.next)
        self.fail[0] = 0
        self.moves: list[dict[int, int] | None] = [None] * len(self.next)
        self.tails: list[tuple[int, ...] | None] = [None] * len(self.next)
        self.pairs: dict[int, bool] = {}
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.edges: tuple[dict, dict] = ({}, {})
        self.words: dict[str, bytes] = {}

    # -- compatibility -----------------------------------------------------------------
    def merge(self, data: bytes) -> list[int]:
        """The vocabulary's merges applied lowest rank first: the definition of the encoding."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best, at = min(((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1)))
            if best == 1 << 60:
                break
            joined = parts[at] + parts[at + 1]
            out, i = [], 0
            while i < len(parts):
                if i + 1 < len(parts) and parts[i] + parts[i + 1] == joined:
                    out.append(joined)
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return [self.ranks[p] for p in parts]

    def _halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None for a single byte."""
        known = self.halves.get(token, 0)
        if known == 0:
            data = self.bytes_of[token]
            if len(data) == 1:
                known = None
            else:
                # the last merge joins the only cut whose sides are whole tokens standing side by side
                cuts = ((self.ranks.get(data[:i]), self.ranks.get(data[i:])) for i in range(1, len(data)))
                whole = [(a, b) for a, b in cuts if a is not None and b is not None and a < token and b < token]
                known = whole[0] if len(whole) == 1 else next((c for c in whole if self._beside(*c, token)), None)
            self.halves[token] = known
        return known

    def _edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """Pieces at one edge of the token over time, each with the rank at which it is merged away."""
        known = self.edges[side].get(token)
        if known is None:
            known, until, piece = [], 1 << 60, token
            while True:
                known.append((piece, until))
                halves = self._halves(piece)
                if halves is None:
                    break
                until, piece = piece, halves[side]
            self.edges[side][token] = known
        return known

    def _beside(self, a: int, b: int, limit: int) -> bool:
        """No merge of rank below ``limit`` ever crosses the border between a and b.

        Ranks only rise while merging, so a border pair merges exactly if its rank comes
        while both of its pieces exist. On equal ranks the left merge goes first.
        """
        rank_of, bytes_of = self.ranks.get, self.bytes_of
        for x, x_until in self._edge(a, 1):
            left = bytes_of[x]
            for y, y_until in self._edge(b, 0):
                rank = rank_of(left + bytes_of[y])
                if rank is not None and rank < limit and rank < x_until and rank <= y_until:
                    return False
        return True

    def adjacent(self, a: int, b: int) -> bool:
        """May token b follow token a: does their text encode to exactly these two?"""
        known = self.pairs.get(a << 32 | b)
        if known is None:
            if len(self.pairs) >= MAX_PAIRS:
                self.pairs.clear()
            known = self.pairs[a << 32 | b] = self._beside(a, b, 1 << 60)
        return known

    # -- the transducer ----------------------------------------------------------------
    def _failure(self, node: int) -> int:
        """The longest proper suffix of the node's bytes that is in the trie."""
        if self.fail[node] < 0:
            above, byte = self.up[node]
            self.fail[node] = 0 if above == 0 else self._step(self._failure(above), byte)
        return self.fail[node]

    def _step(self, node: int, byte: int) -> int:
        """One transition, determinised when first taken."""
        moves = self.moves[node]
        if moves is None:
            moves = self.moves[node] = dict(self.next[node])
        to = moves.get(byte)
        if to is None:
            to = moves[byte] = 0 if node == 0 else self._step(self._failure(node), byte)
        return to

    def _tails(self, node: int) -> tuple[int, ...]:
        """Tokens that end at this state, longest first."""
        known = self.tails[node]
        if known is None:
            own = (self.ends[node],) if self.ends[node] >= 0 else ()
            known = self.tails[node] = own + (self._tails(self._failure(node)) if node else ())
        return known

    def word(self, data: bytes) -> tuple[int, ...]:
        """Ids of one piece of bytes."""
        moves, tails, size, pairs = self.moves, self.tails, self.size, self.pairs
        last: list[int] = [-1]  # last[i]: the last token of the first i bytes since the cut
        out: list[int] = []
        node = at = 0
        for byte in data:
            table = moves[node]
            to = table.get(byte) if table is not None else None
            node = self._step(node, byte) if to is None else to
            at += 1
            for token in tails[node] or self._tails(node):
                before = last[at - size[token]]
                if before < 0:
                    break
                fits = pairs.get(before << 32 | token)
                if fits or (fits is None and self.adjacent(before, token)):
                    break
            last.append(token)
            if at >= EMIT_AFTER:
                keep = self._certain(last, at, at - self.depth[node])
                if keep > 0:
                    # the token that ends at the cut stays as left context
                    out += self._chain(last, keep)
                    last = last[keep:]
                    at -= keep
        ids = self._chain(last, at)
        return (*out, *ids)

    def _chain(self, last: list[int], at: int) -> list[int]:
        """Tokens that end at ``at``, back to the cut."""
        ids = []
        while at > 0:
            ids.append(last[at])
            at -= self.size[last[at]]
        ids.reverse()
        return ids

    def _certain(self, last: list[int], at: int, first: int) -> int:
        """The latest cut on which all positions a later token may start from agree."""
        walk, common = [first], first
        while walk[-1] > 0:
            walk.append(walk[-1] - self.size[last[walk[-1]]])
        met = set(walk)
        for start in range(first + 1, at + 1):
            while start not in met:
                start -= self.size[last[start]]
            common = min(common, start)
        return common

    def packed(self, text: str | None) -> bytes:
        """Ids of a text as 32-bit integers end to end; pieces seen before are copied."""
        if not text:
            return b""
        words = self.words
        if len(words) > MAX_WORDS:
            words.clear()
        pieces = self.split(text)
        chunks = list(map(words.get, pieces))
        if None in chunks:
            for i, chunk in enumerate(chunks):
                if chunk is None:
                    piece = pieces[i]
                    chunk = words.get(piece)
                    if chunk is None:
                        ids = self.word(piece.encode("utf-8", "surrogatepass"))
                        chunk = array("i", ids).tobytes()
                        if len(piece) <= 64:
                            words[piece] = chunk
                    chunks[i] = chunk
        return b"".join(chunks)

    def encode(self, text: str | None) -> list[int]:
        return list(array("i", self.packed(text)))

    def decode(self, ids: Iterable[int]) -> str:
        stream = Utf8Stream()
        return "".join(stream.feed(self.bytes_of[i]) for i in ids) + stream.end()


class Utf8Stream:
    """Bytes in, text out; a character split over tokens waits for its last byte."""

    def __init__(self) -> None:
        self._machine = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, data: bytes) -> str:
        return self._machine.decode(data)

    def end(self) -> str:
        return self._machine.decode(b"", True)


@lru_cache(maxsize=2)
def tokenizer(path: str) -> Bpe:
    """One compiled tokenizer per Python worker and vocabulary."""
    return Bpe(load_ranks(path))


def encode_column(texts: pa.Array, bpe: Bpe) -> pa.ListArray:
    """Ids of every text; null and empty texts have none."""
    parts = [bpe.packed(text) for text in texts.to_pylist()]
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) >> 2 for p in parts], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(parts), np.int32)))


def encode_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(key, ids): token ids of each row's text, rows independent of each other, no shuffle."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(vocabulary)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                yield pa.RecordBatch.from_arrays([part.column(0), encode_column(part.column(1), bpe)], names=[key, "ids"])

    kept = docs.select(key, text)
    kind = kept.schema[key].dataType.simpleString()
    return kept.mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def decode_documents(encoded: DataFrame, key: str = "doc_id", ids: str = "ids", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(key, text): the texts again; null ids give null."""
    ship(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(vocabulary)
        for batch in batches:
            texts = [None if x is None else bpe.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    kept = encoded.select(key, ids)
    kind = kept.schema[key].dataType.simpleString()
    return kept.mapInArrow(run, f"`{key}` {kind}, text string")
