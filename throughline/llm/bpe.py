"""Byte-level BPE by longest match and backtracking.

A sequence of tokens is the result of the merges exactly if each two neighbours are: merging the
bytes of both alone gives the two again. (While no merge crosses a border, the merges on either
side of it run as they would in the pair; so the first one to cross it would do so in the pair,
too.) Every text has one such sequence. It is found from left to right: take the longest token
that starts here and fits its left neighbour, else a shorter one, else step back and leave this
place out for good. No place is left twice, so the time is linear in the length of a piece, also
for a piece of many megabytes.

Bytes are mapped to Latin-1 characters, as pyahocorasick works on str. The automaton holds the
reversed tokens and runs over the reversed piece; its first hit at a place is then the longest
token that starts there.
"""

from __future__ import annotations

import base64
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from throughline.llm.frames import append, lists, ship, texts

#: Entries a memo may hold before it is begun anew; bounds a worker's memory, not the result.
MEMO = 150_000
#: Characters of texts that are cut into pieces together; a text above this length is cut lazily.
GROUP = 1 << 20
#: What an id outside of the vocabulary decodes to.
UNKNOWN = "�".encode()


def load_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a token in base64 and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def merged(piece: bytes, ranks: dict[bytes, int], until: int = 1) -> list[bytes]:
    """The merges by the book: the pair of least rank first, the leftmost among equals; down to `until` parts."""
    parts = [piece[i:i + 1] for i in range(len(piece))]
    while len(parts) > until:
        best, at = None, -1
        for i in range(len(parts) - 1):
            rank = ranks.get(parts[i] + parts[i + 1])
            if rank is not None and (best is None or rank < best):
                best, at = rank, i
        if best is None:
            break
        parts[at:at + 2] = [parts[at] + parts[at + 1]]
    return parts


class Memo(dict):
    """A dict that fills itself by a function. When it is full, it is begun anew beside what it held so far."""

    def __init__(self, make):
        super().__init__()
        self.make, self.before = make, {}

    def __missing__(self, key):
        if len(self) >= MEMO:
            self.before = dict(self)
            self.clear()
        value = self.before.get(key)
        value = self[key] = self.make(key) if value is None else value
        return value


class Encoder:
    """Encodes pieces and texts by the ranks of a vocabulary that holds every single byte."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.split = ranks, regex.compile(pattern)
        self.token = {rank: token for token, rank in ranks.items()}
        halves = {t: merged(t, ranks, 2) for t in ranks if len(t) > 1}
        self.halves = {t: h for t, h in halves.items() if len(h) == 2 and b"".join(h) in ranks}
        reached = {t: r for t, r in ranks.items() if len(t) == 1 or t in self.halves}
        #: Every token comes after both of its halves: then the parts at a border appear in the order of their ranks.
        self.ordered = all(max(ranks[a], ranks[b]) < ranks[t] for t, (a, b) in self.halves.items())
        self.longest = ahocorasick.Automaton()
        for token, rank in reached.items():
            self.longest.add_word(token[::-1].decode("latin-1"), rank)
        self.longest.make_automaton()
        self.shorter = {r: next((reached[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in reached), None)
                        for t, r in reached.items()}
        self.edges = ({}, {})
        self.base = max(ranks.values()) + 1
        self.sizes = {r: len(t) for t, r in ranks.items()}
        self.fits = Memo(lambda pair: self.compatible(divmod(pair, self.base)))
        self.pieces = Memo(self.piece)

    def edge(self, rank: int, side: int) -> list[tuple[bytes, float]]:
        """The parts that a token has at its right (side 1) or left (0) end while it is merged, and the rank of the merge that ends each."""
        if rank not in self.edges[side]:
            token, until, out = self.token[rank], float("inf"), []
            while True:
                out.append((token, until))
                if len(token) == 1:
                    break
                until, token = self.ranks[token], self.halves[token][side]
            self.edges[side][rank] = out
        return self.edges[side][rank]

    def compatible(self, pair: tuple[int, int]) -> bool:
        """Whether two tokens stay as they are next to each other: no merge across the border comes before the
        merges that end its two parts. Of equal ranks the leftmost is first."""
        if not self.ordered:
            return merged(self.token[pair[0]] + self.token[pair[1]], self.ranks) == [self.token[i] for i in pair]
        right, ranks = self.edge(pair[1], 0), self.ranks
        for a, a_until in self.edge(pair[0], 1):
            for b, b_until in right:
                rank = ranks.get(a + b)
                if rank is not None and rank < a_until and rank <= b_until:
                    return False
        return True

    def piece(self, piece: str) -> tuple[int, ...]:
        """The ids of one match of the pattern."""
        raw = piece.encode()
        whole = self.ranks.get(raw)
        return (whole,) if whole is not None else tuple(self.backtrack(raw))

    def backtrack(self, raw: bytes) -> list[int]:
        n = len(raw)
        first, last = [-1] * n, n - 1
        for end, rank in self.longest.iter(raw[::-1].decode("latin-1")):
            if first[last - end] < 0:
                first[last - end] = rank
        sizes, shorter, fits, base = self.sizes, self.shorter, self.fits, self.base
        out, dead, at, before = [], bytearray(n + 1), 0, -1
        candidate = first[0]
        while at < n:
            end = at + sizes[candidate]
            if not dead[end] and (before < 0 or fits[before * base + candidate]):
                out.append(candidate)
                before, at = candidate, end
                candidate = first[at] if at < n else None
                continue
            candidate = shorter[candidate]
            while candidate is None:
                dead[at] = 1
                gone = out.pop()
                at -= sizes[gone]
                candidate = shorter[gone]
                before = out[-1] if out else -1
        return out

    def encode_all(self, texts_: list[str]) -> list[np.ndarray]:
        """The ids of whole texts. Pieces that are not in the memo are encoded in sorted order: neighbours
        share beginnings, so the automaton and the pairs they need are at hand."""
        out, at = [], 0
        while at < len(texts_):
            stop, chars = at, 0
            while stop < len(texts_) and (stop == at or chars + len(texts_[stop]) <= GROUP):
                chars += len(texts_[stop])
                stop += 1
            if stop == at + 1 and chars > GROUP:
                out.append(self.encode(texts_[at]))
            else:
                found = [self.split.findall(t) for t in texts_[at:stop]]
                look = self.pieces.__getitem__
                for piece in sorted(set(chain.from_iterable(found)).difference(self.pieces)):
                    look(piece)
                out += [np.fromiter(chain.from_iterable(map(look, pieces)), np.int32) for pieces in found]
            at = stop
        return out

    def encode(self, text: str) -> np.ndarray:
        """The ids of one text, cut lazily if it is long."""
        found = self.split.findall(text) if len(text) < GROUP else (m.group() for m in self.split.finditer(text))
        return np.fromiter(chain.from_iterable(map(self.pieces.__getitem__, found)), np.int32)


_BUILT: dict[tuple, object] = {}


def _everywhere(df: DataFrame, path: str, name: tuple, build):
    """What `build` makes of the ranks, once in a worker. The driver reads the rank file, of fixed size, and sends it."""
    ship(df.sparkSession)
    ranks = df.sparkSession.sparkContext.broadcast(load_ranks(path))

    def get():
        key = (path, *name)
        if key not in _BUILT:
            _BUILT[key] = build(ranks.value)
        return _BUILT[key]
    return get


class Decoder:
    """The bytes of each id."""

    def __init__(self, ranks: dict[bytes, int]):
        self.size = max(ranks.values()) + 1
        token = {rank: t for t, rank in ranks.items()}
        #: One more at the end, for ids that are null or outside of the vocabulary.
        self.table = pa.array([token.get(i, UNKNOWN) for i in range(self.size)] + [UNKNOWN], pa.binary())

    def __getitem__(self, rank: int) -> bytes:
        return self.table[rank if 0 <= rank < self.size else self.size].as_py()

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> pa.Array:
        """The bytes of lists of ids that lie one after another, from ends[0] on."""
        ids = np.where((ids < 0) | (ids >= self.size), self.size, ids)
        if not len(ids):
            return pa.array([b""] * (len(ends) - 1), pa.binary())
        _, offsets, data = self.table.take(pa.array(ids)).buffers()
        return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(np.frombuffer(offsets, np.int32)[ends]), data])


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", out: str = "ids",
           keep: list[str] | None = None) -> DataFrame:
    """`df` with the ids of each whole text as array<int>.

    Null and empty texts give an empty list. Repeated rows stay as they are. A column that has
    the name of the new one is replaced. Control strings are ordinary text.
    """
    get = _everywhere(df, path, ("encode", pattern), lambda ranks: Encoder(ranks, pattern))

    def start():
        enc = get()

        def step(part: pa.RecordBatch) -> list[pa.Array]:
            ids = enc.encode_all(texts(part, text))
            return [lists(np.concatenate(ids), map(len, ids), pa.int32())]
        return step

    return append(df, f"`{out}` array<int>", start, keep)


def decode(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded", keep: list[str] | None = None) -> DataFrame:
    """`df` with the bytes that each list of ids stands for.

    Null lists give no bytes; an id that is null or outside of the vocabulary gives U+FFFD.
    """
    get = _everywhere(df, path, ("decode",), Decoder)

    def start():
        enc = get()

        def step(part: pa.RecordBatch) -> list[pa.Array]:
            column = part.column(ids)
            flat = pc.fill_null(column.flatten(), -1).to_numpy(zero_copy_only=False)
            sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
            return [enc.decode(flat, np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]))]
        return step

    return append(df, f"`{out}` binary", start, keep)
