"""SentencePiece BPE by a table of last tokens.

A sequence of tokens is the result of the merges exactly if each two neighbours stay as they are
next to each other, and every text has one such sequence. So has every prefix of it, and the
sequence of a prefix that ends in token t is the sequence of what comes before t, and t. The table
therefore holds one token for each prefix: of the tokens that end there (an automaton gives them),
the one that fits the last token of the prefix it starts after. The ids are then read off
backwards. Each place of a text is visited once for each token that ends there, so the time is
linear in the text, also for a single word of many megabytes.

If no piece of the model has a space after another character, no merge crosses the border before
a space, and a text is encoded word by word with a memo; other models take it as a whole.
"""

from __future__ import annotations

import codecs
import re
import struct
from array import array
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from throughline.llm.frames import THIN, append, ship, texts

#: Kinds of a piece in a model file (fixed values of the format).
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Fields of a model file (fixed values of the format).
PIECES, TRAINER, NORMALIZER = 1, 2, 3
MODEL_TYPE, BYTE_FALLBACK, SUFFIX_SPACE, UNK_SURFACE = 3, 35, 24, 44
CHARSMAP, DUMMY_PREFIX, EXTRA_SPACES, ESCAPE_SPACES = 2, 3, 4, 5
BPE = 2
SPACE = "▁"
#: Entries a memo may hold before it is begun anew; bounds a worker's memory, not the result.
WORDS, PAIRS = 400_000, 400_000
#: Characters of texts that are cut into words together, one text at least.
GROUP = 2 << 20
WORD = re.compile(" *[^ ]+| +")

codecs.register_error("each-byte", lambda e: ("�", e.start + 1))


def _fields(raw: bytes) -> Iterator[tuple[int, object]]:
    """The fields (number, value) of a message: varints as int, all else as bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(raw):
        number, wire = divmod(varint(), 8)
        if wire == 0:
            yield number, varint()
            continue
        size = {1: 8, 5: 4}.get(wire) or varint()
        yield number, raw[at:at + size]
        at += size


def load_model(path: str) -> dict:
    """The pieces (text, score, kind) and settings of a model file; ValueError for what is not built here."""
    with open(path, "rb") as f:
        parts = list(_fields(f.read()))
    pieces = []
    for number, value in parts:
        if number == PIECES:
            piece = dict(_fields(value))
            pieces.append((piece[1].decode(), struct.unpack("<f", piece.get(2, b"\0\0\0\0"))[0], piece.get(3, NORMAL)))
    trainer = dict(_fields(b"".join(v for n, v in parts if n == TRAINER)))
    rules = dict(_fields(b"".join(v for n, v in parts if n == NORMALIZER)))
    kinds = {kind for *_, kind in pieces}
    if trainer.get(MODEL_TYPE, 1) != BPE or rules.get(CHARSMAP) or trainer.get(SUFFIX_SPACE) or rules.get(EXTRA_SPACES, 1) \
            or not rules.get(ESCAPE_SPACES, 1) or kinds & {USER_DEFINED, UNUSED}:
        raise ValueError("only BPE models without a character map, own or unused pieces, with every space kept")
    return {"pieces": pieces, "prefix": bool(rules.get(DUMMY_PREFIX, 1)), "fallback": bool(trainer.get(BYTE_FALLBACK, 0)),
            "unknown": trainer.get(UNK_SURFACE, " ⁇ ".encode()).decode()}


def merged(text: str, score: dict[str, float], until: int = 1) -> list[str]:
    """The merges by the book: the pair of the highest score first, the leftmost among equals; down to `until` parts."""
    parts = list(text)
    while len(parts) > until:
        found = [(-score[p], i) for i in range(len(parts) - 1) if (p := parts[i] + parts[i + 1]) in score]
        if not found:
            break
        at = min(found)[1]
        parts[at:at + 2] = [parts[at] + parts[at + 1]]
    return parts


class Memo(dict):
    """A dict that fills itself by a function. When it is full, it is begun anew beside what it held so far."""

    def __init__(self, make, size: int):
        super().__init__()
        self.make, self.size, self.before = make, size, {}

    def __missing__(self, key):
        if len(self) >= self.size:
            self.before = dict(self)
            self.clear()
        value = self.before.get(key)
        value = self[key] = self.make(key) if value is None else value
        return value


class Encoder:
    """Encodes texts by a model. Inside, the space mark is a plain space."""

    def __init__(self, model: dict):
        self.prefix = " " if model["prefix"] else ""
        texts_ = [p.replace(SPACE, " ") for p, *_ in model["pieces"]]
        kinds = [k for *_, k in model["pieces"]]
        self.score = {t: s for t, (_, s, k) in zip(texts_, model["pieces"], strict=True) if k == NORMAL}
        self.ids = {t: i for i, t in enumerate(texts_) if kinds[i] == NORMAL}
        special = {p: i for i, (p, _, k) in enumerate(model["pieces"]) if k in (CONTROL, UNKNOWN, BYTE)}
        self.bos, self.eos, self.unk = special.get("<s>"), special.get("</s>"), kinds.index(UNKNOWN)
        self.bytes = [special.get(f"<0x{b:02X}>") for b in range(256)] if model["fallback"] else None

        letters = set().union(*self.ids)
        #: Letters of pieces that are no piece themselves: they merge, but are unknown on their own.
        self.loose = {len(texts_) + i: c for i, c in enumerate(sorted(letters - set(self.ids)))}
        self.whole = {**self.ids, **{c: i for i, c in self.loose.items()}}
        self.text = {i: t for t, i in self.whole.items()}
        self.mark = next(c for c in map(chr, range(0x10FFFF)) if c not in letters)  # stands between texts
        self.base, self.plain = len(texts_) + len(self.loose), len(texts_)
        self.sizes = [len(t) for t in texts_]

        halves = {t: merged(t, self.score, 2) for t in self.score if len(t) > 1}
        self.halves = {t: tuple(h) for t, h in halves.items() if len(h) == 2}
        self.apart = any(" " in t.lstrip(" ") for t in self.halves)  # a piece goes on over a border between words
        often: dict[float, int] = {}
        for t in self.halves:
            often[self.score[t]] = often.get(self.score[t], 0) + 1
        #: Tokens with a merge of a score that is not its own, or not below those of its halves: their order in
        #: time is not the order of the scores, so their pairs are merged by the book.
        self.odd: set[str] = set()
        for t in sorted(self.halves, key=len):
            a, b = self.halves[t]
            if often[self.score[t]] > 1 or a in self.odd or b in self.odd or any(len(h) > 1 and self.score[h] <= self.score[t] for h in (a, b)):
                self.odd.add(t)
        self.ends = ahocorasick.Automaton()
        for t, i in self.whole.items():
            if len(t) == 1 or t in self.halves:
                self.ends.add_word(t, (i, len(t)))
        self.ends.make_automaton()
        self.edges: tuple[dict, dict] = ({}, {})
        self.fits = Memo(self.compatible, PAIRS)
        self.spell = Memo(self.spelt, PAIRS)
        self.words: dict[str, bytes] = {}

    def edge(self, i: int, side: int) -> list[tuple[str, float]]:
        """The parts that a token has at its right (side 1) or left (0) end while it is merged, and the score of the merge that ends each."""
        if i not in self.edges[side]:
            t, until, out = self.text[i], float("-inf"), []
            while True:
                out.append((t, until))
                if len(t) == 1:
                    break
                until, t = self.score[t], self.halves[t][side]
            self.edges[side][i] = out
        return self.edges[side][i]

    def compatible(self, pair: int) -> bool:
        """Whether two tokens (left * base + right) stay as they are next to each other: no merge across the border
        comes before the merges that end its two parts. Of equal scores the leftmost is first."""
        a, b = divmod(pair, self.base)
        left, right = self.text[a], self.text[b]
        if left in self.odd or right in self.odd:
            return merged(left + right, self.score) == [left, right]
        score, ends = self.score, self.edge(b, 0)
        for x, x_until in self.edge(a, 1):
            for y, y_until in ends:
                s = score.get(x + y)
                if s is not None and s > x_until and s >= y_until:
                    return False
        return True

    def tables(self, words: list[str]) -> Iterator[bytes]:
        """The ids of each text as little-endian 32-bit integers; the automaton runs once over all of them.

        A place without a token is one after a letter that occurs in no piece, or a text's start: no merge
        crosses it, so any token may begin there.
        """
        joined = self.mark.join(words)
        last, fits, base = array("i", [-1]) * (len(joined) + 1), self.fits, self.base
        for end, (i, size) in self.ends.iter(joined):
            if last[end + 1] < 0:
                before = last[end + 1 - size]
                if before < 0 or fits[before * base + i]:
                    last[end + 1] = i
        sizes, spell, start = self.sizes, self.spell, 0
        for word in words:
            at = start + len(word)
            ids, stop = [], at + 1
            while at > start:
                i = last[at]
                if 0 <= i < self.plain:
                    ids.append(i)
                    at -= sizes[i]
                else:
                    ids += spell[joined[at - 1]]
                    at -= 1
            start = stop
            ids.reverse()
            yield array("i", ids).tobytes()

    def spelt(self, letter: str) -> list[int]:
        """The ids of a letter that is no piece, last one first: those of its bytes, or the unknown id."""
        return [self.bytes[b] for b in reversed(letter.encode())] if self.bytes else [self.unk]

    def learn(self, words: set[str]) -> None:
        """Put words into the memo, as they are if they begin with a space, else with the space before them."""
        new = sorted(words.difference(self.words))  # neighbours share beginnings: fewer misses of the processor's cache
        self.words.update(zip(new, self.tables([w if w[:1] == " " else " " + w for w in new]), strict=True))

    def cut(self, text: str) -> list[str]:
        """The words of a text: without their one space, or a run that begins with more than one, or is nothing but spaces."""
        s = self.prefix + text.replace(SPACE, " ")
        if s[0] == " " and s[-1] != " " and "  " not in s:
            return s[1:].split(" ")
        found = WORD.findall(s)
        return [w[1:] if w[0] == " " and w[1:2] not in ("", " ") else w for w in found]

    def encode(self, texts_: list[str]) -> list[bytes]:
        """The ids of whole texts as little-endian 32-bit integers."""
        if self.apart or not self.prefix:
            return [b"".join(self.tables([self.prefix + t.replace(SPACE, " ")])) if t else b"" for t in texts_]
        out: list[bytes] = []
        at = 0
        while at < len(texts_):
            stop, chars = at, 0
            while stop < len(texts_) and (stop == at or chars + len(texts_[stop]) <= GROUP):
                chars += len(texts_[stop])
                stop += 1
            if len(self.words) > WORDS:
                self.words.clear()
            cut = [self.cut(t) if t else [] for t in texts_[at:stop]]
            self.learn(set(chain.from_iterable(cut)))
            out += [b"".join(map(self.words.__getitem__, words)) for words in cut]
            at = stop
        return out


class Decoder:
    """The text of ids, as the library gives it."""

    def __init__(self, model: dict):
        kinds = [k for *_, k in model["pieces"]]
        self.size, self.prefix = len(kinds), model["prefix"]
        made = {UNKNOWN: lambda p: model["unknown"].encode(), CONTROL: lambda p: b"", BYTE: lambda p: bytes([int(p[1:-1], 16)]),
                NORMAL: lambda p: p.replace(SPACE, " ").encode()}
        #: One more at the end, for ids that are null or outside of the model.
        table = [made[k](p) for p, _, k in model["pieces"]] + ["�".encode()]
        self.table = pa.array(table, pa.large_binary())
        self.silent = np.array([k == CONTROL for k in kinds] + [False])
        self.spaced = np.array([k == NORMAL and t[:1] == b" " for k, t in zip(kinds, table)] + [False])

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> list[str]:
        """The texts of lists of ids that lie one after another; the first one begins at ends[0]."""
        ids = np.where((ids < 0) | (ids >= self.size), self.size, ids)
        if not len(ids):
            return [""] * (len(ends) - 1)
        _, offsets, data = self.table.take(pa.array(ids)).buffers()
        at, raw = np.frombuffer(offsets, np.int64), memoryview(data if data is not None else b"")
        heard = np.append(np.flatnonzero(~self.silent[ids]), len(ids))
        first = heard[np.searchsorted(heard, ends[:-1])]
        strip = (first < ends[1:]) & self.spaced[ids[np.minimum(first, len(ids) - 1)]] & self.prefix
        # A run of bytes ends at a control id, so the few lists with one inside are read in parts.
        quiet = np.concatenate([[0], np.cumsum(self.silent[ids])])
        last = np.maximum(heard[np.searchsorted(heard, ends[1:]) - 1], first)
        inside = (first < ends[1:]) & (quiet[np.minimum(last, len(ids))] > quiet[first])
        out = [codecs.decode(raw[a:b], "utf-8", "each-byte") for a, b in zip((at[ends[:-1]] + strip).tolist(), at[ends[1:]].tolist(), strict=True)]
        for row in np.flatnonzero(inside).tolist():
            cuts = [ends[row], *(np.flatnonzero(self.silent[ids[ends[row]:ends[row + 1]]]) + ends[row]), ends[row + 1]]
            text = "".join(codecs.decode(raw[at[a]:at[b]], "utf-8", "each-byte") for a, b in zip(cuts, cuts[1:]))
            out[row] = text[1:] if strip[row] else text
        return out


_BUILT: dict[tuple, object] = {}


def _everywhere(df: DataFrame, path: str, kind):
    """`kind` of the model, once in a worker. The driver reads the model file, of fixed size, and sends it."""
    ship(df.sparkSession)
    model = df.sparkSession.sparkContext.broadcast(load_model(path))

    def get():
        if (path, kind.__name__) not in _BUILT:
            _BUILT[path, kind.__name__] = kind(model.value)
        return _BUILT[path, kind.__name__]
    return get


def encode(df: DataFrame, path: str, text: str = "text", out: str = "ids", bos: bool = True, eos: bool = True,
           packed: bool = False, keep: list[str] | None = None) -> DataFrame:
    """`df` with the ids of each whole text as array<int>; `packed`: as binary, little-endian 32-bit.

    Null and empty texts give the begin and end ids alone, as far as they are asked for. Repeated
    rows stay as they are. A column with the name of the new one is replaced. Strings such as
    `<s>` or `<0x0A>` in a text are ordinary text, and the space mark itself counts as a space.
    """
    get = _everywhere(df, path, Encoder)

    def start():
        enc = get()
        first = struct.pack("<i", enc.bos) if bos else b""
        last = struct.pack("<i", enc.eos) if eos else b""

        def step(part: pa.RecordBatch) -> list[pa.Array]:
            coded = [first + c + last for c in enc.encode(texts(part, text))]
            if packed:
                return [pa.array(coded, pa.binary())]
            ends = np.cumsum([0, *(len(c) // 4 for c in coded)]).astype(np.int32)
            flat = np.frombuffer(b"".join(coded), "<i4").astype(np.int32)
            return [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))]
        return step

    return append(df, f"`{out}` {'binary' if packed else 'array<int>'}", start, keep, THIN)


def decode(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded", keep: list[str] | None = None) -> DataFrame:
    """`df` with the text that each list of ids (array<int>, or packed binary) stands for.

    A null list gives the empty text; an id that is null or outside of the model gives U+FFFD, as
    does each byte that is part of no character.
    """
    get = _everywhere(df, path, Decoder)

    def start():
        dec = get()

        def step(part: pa.RecordBatch) -> list[pa.Array]:
            column = part.column(ids)
            if pa.types.is_binary(column.type):
                cells = [c or b"" for c in column.to_pylist()]
                flat, sizes = np.frombuffer(b"".join(cells), "<i4"), [len(c) // 4 for c in cells]
            else:
                flat = pc.fill_null(column.flatten(), -1).to_numpy(zero_copy_only=False)
                sizes = pc.fill_null(pc.list_value_length(column), 0).to_pylist()
            return [pa.array(dec.decode(flat, np.cumsum([0, *sizes])), pa.string())]
        return step

    return append(df, f"`{out}` string", start, keep, THIN)
