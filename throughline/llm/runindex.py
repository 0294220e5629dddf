"""Removal of long repeats by a run-compressed index.

Which bytes lie in a string of `length` bytes that also starts elsewhere? Strings that are equal
have to meet in one task, so every window of that length is dealt out by its anchor: the place
in it where the hash of `ANCHOR` bytes is least (the leftmost, if several are). Consecutive
windows mostly share their anchor; the bytes that they cover are the anchor's region, cut once.
Anchors whose hash occurs once in the corpus are dropped, and regions that are equal are one row
with a count.

The regions of an anchor hash are indexed together. Their symbols are tagged with the hash and
the place relative to the anchor, so that a match is one of windows at equal places (others have
anchors of their own) and never one of a window with itself. Of the Burrows-Wheeler transform
only the ends of its runs are kept: the text position there, and how far it matches the
neighbour beyond. Within a run, a suffix's match is one longer than that of the suffix after it in
the text, so the matching statistics of all positions stream from these samples in one pass:
the larger of the one above and the one below. Windows with statistics of `length` or more repeat.

An anchor hash with more than `CROWD` different regions (the border of a passage that very many
texts hold) is not put into one task: its windows are counted by hash in two steps, first what
the windows of a block have in common, then the windows of the blocks that are left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from throughline.llm.frames import append, arrow_map, lists, ship, stage, texts

ANCHOR, CROWD, INDEX, CUT, STEP = 96, 256, 1 << 20, 1 << 19, 16

_B = 0x9E3779B97F4A7C15 | 1
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of the base and of its inverse modulo 2**64."""
    size = 1 << max(12, int(n).bit_length())
    if size not in _POWERS:
        up = np.full(size, _B, np.uint64)
        up[0] = 1
        down = np.full(size, pow(_B, -1, 1 << 64), np.uint64)
        down[0] = 1
        _POWERS[size] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _POWERS[size]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return h ^ (h >> np.uint64(32))


class Hashes:
    """Polynomial hashes of all substrings of some bytes."""

    def __init__(self, data: np.ndarray):
        self.up, down = _powers(len(data) + 1)
        self.sums = np.empty(len(data) + 1, np.uint64)
        self.sums[0] = 0
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * down[:len(data)], out=self.sums[1:])

    def of(self, start, end) -> np.ndarray:
        return _mixed((self.sums[end] - self.sums[start]) * self.up[start])

    def rolling(self, size: int) -> np.ndarray:
        n = len(self.sums) - size
        return _mixed((self.sums[size:] - self.sums[:n]) * self.up[:n])


def least_in_windows(h: np.ndarray, width: int) -> np.ndarray:
    """For each window of `width` hashes the place of the least, the leftmost if several are."""
    n = len(h) - width + 1
    packed = (h & ~np.uint64((1 << 20) - 1)) | np.arange(len(h), dtype=np.uint64)
    rows = -(-len(h) // width)
    full = np.full(rows * width, np.iinfo(np.uint64).max, np.uint64)
    full[:len(h)] = packed
    full = full.reshape(rows, width)
    after = np.minimum.accumulate(full, axis=1).ravel()
    before = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(before[:n], after[width - 1:width - 1 + n]) & np.uint64((1 << 20) - 1)).astype(np.int64)


def regions(data: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(anchor's hash, region's hash, region's start, anchor in it, number of windows) of all windows of some bytes."""
    for at in range(0, max(0, len(data) - length + 1), CUT):
        part = data[at:at + CUT + length - 1]
        hashes = Hashes(part)
        grams = hashes.rolling(ANCHOR)
        anchor = least_in_windows(grams, length - ANCHOR + 1)
        first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        n = np.diff(np.append(first, len(anchor)))
        place = anchor[first] - first
        region = hashes.of(first, first + n - 1 + length)
        region = _mixed(region + place.astype(np.uint64) * np.uint64(0x8CB92BA72F3D8DD7) + n.astype(np.uint64) * np.uint64(0xE7037ED1A0B428DB))
        yield grams[anchor[first]].view(np.int64), region.view(np.int64), first + at, place, n


class Index:
    """The run-compressed transform of tagged regions."""

    def __init__(self, group: np.ndarray, place: np.ndarray, parts: list[bytes]):
        sizes = np.array([len(p) for p in parts])
        data = np.frombuffer(b"".join(parts), np.uint8).astype(np.int64)
        total = len(data)
        region = np.repeat(np.arange(len(parts)), sizes)
        start = np.repeat(np.cumsum(sizes) - sizes, sizes)
        self.end = np.repeat(np.cumsum(sizes), sizes)
        inner = np.arange(total) - start
        tag = (group[region] << 11) | (inner - place[region] + 1024)
        key = tag
        for i in range(4):  # a symbol is 0 after the region's end
            at = np.arange(total) + i
            key = (key << 9) | np.where(at < self.end, data[np.minimum(at, total - 1)] + 1, 0)
        order, self.levels, self.data = np.argsort(key, kind="stable"), [], data
        rank = np.empty(total, np.int64)
        fresh = np.concatenate([[True], key[order][1:] != key[order][:-1]])
        rank[order] = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
        self.levels.append((4, rank.astype(np.int32)))
        size = 4
        while size < sizes.max():
            alone = fresh & np.append(fresh[1:], True)
            open_at = np.flatnonzero(~alone)
            if not len(open_at):
                break
            sub = order[open_at]
            ahead = sub + size
            then = np.where(ahead < self.end[sub], rank[np.minimum(ahead, total - 1)], total + region[sub])
            joint = rank[sub] * (total + len(parts) + 1) + then
            by = np.argsort(joint, kind="stable")
            order[open_at] = sub[by]
            joint = joint[by]
            new = np.concatenate([[True], joint[1:] != joint[:-1]])
            fresh[open_at] = new
            rank[order[open_at]] = open_at[np.flatnonzero(new)[np.cumsum(new) - 1]]
            size *= 2
            self.levels.append((size, rank.astype(np.int32)))
        before = np.where(inner > 0, data[np.arange(total) - 1], -1)[order]
        same_tag = tag[order][1:] == tag[order][:-1]
        cut = np.concatenate([[True], (before[1:] != before[:-1]) | (before[1:] < 0) | ~same_tag, [True]])
        heads, tails = np.flatnonzero(cut[:-1]), np.flatnonzero(cut[1:])
        heads, tails = heads[heads > 0], tails[tails < total - 1]
        self.heads, self.above = order[heads], self.common(order[heads], order[heads - 1], same_tag[heads - 1])
        self.tails, self.below = order[tails], self.common(order[tails], order[tails + 1], same_tag[tails])
        self.runs = int(cut[:-1].sum())

    def common(self, a: np.ndarray, b: np.ndarray, tagged: np.ndarray) -> np.ndarray:
        """How many symbols the suffixes at a and b share."""
        out, most = np.zeros(len(a), np.int64), np.where(tagged, np.minimum(self.end[a] - a, self.end[b] - b), 0)
        last = len(self.data) - 1
        for size, rank in reversed(self.levels):
            equal = (out + size <= most) & (rank[np.minimum(a + out, last)] == rank[np.minimum(b + out, last)])
            out += size * equal
        for _ in range(3):
            out += (out < most) & (self.data[np.minimum(a + out, last)] == self.data[np.minimum(b + out, last)])
        return out

    def statistics(self) -> np.ndarray:
        """For each position the longest match with another region, at the same tags."""
        at, longest = np.arange(len(self.data)), None
        for sampled, reach in ((self.heads, self.above), (self.tails, self.below)):
            ends = np.zeros(len(self.data), np.int64)
            ends[sampled] = sampled + reach
            streamed = np.maximum.accumulate(ends) - at
            longest = streamed if longest is None else np.maximum(longest, streamed)
        return np.maximum(longest, 0)


def runs_of(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true flags."""
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


REGION = "h long, region long, place int, n int"


def _cut(keyed: DataFrame, length: int) -> DataFrame:
    """Regions of all texts that hold a window: the row's key and where."""
    def start():
        def step(part: pa.RecordBatch):
            found, rows = [], []
            for i, t in enumerate(texts(part, "text")):
                for some in regions(np.frombuffer(t.encode(), np.uint8), length):
                    found.append(some)
                    rows.append(np.full(len(some[0]), i))
            if rows:
                h, region, at, place, n = map(np.concatenate, zip(*found, strict=True))
                row = pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id").take(row), part.column("digest").take(row), pa.array(h), pa.array(region),
                    pa.array(at, pa.int64()), pa.array(place, pa.int32()), pa.array(n, pa.int32())],
                    names=["doc_id", "digest", "h", "region", "at", "place", "n"])
        return step

    return arrow_map(keyed.select("doc_id", "digest", "text"), "doc_id long, digest long, h long, region long, at long, place int, n int", start)


def _fetched(keyed: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The bytes of regions, cut from one text that holds each."""
    by_row = wanted.select(F.col("one.doc_id").alias("doc_id"), F.col("one.digest").alias("digest"), F.struct(
        "h", "region", "place", "n", "times", "crowd", F.col("one.at").alias("at")).alias("w")).groupBy("doc_id", "digest").agg(F.collect_list("w").alias("wanted"))
    both = keyed.select(F.col("doc_id").alias("d"), F.col("digest").alias("g"), "text").join(
        by_row, F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("g") == F.col("digest"))).select("text", "wanted")
    fields = "h region place n times crowd".split()

    def start():
        def step(part: pa.RecordBatch):
            rows, data = [], []
            for t, wanted in zip(texts(part, "text"), part.column("wanted").to_pylist(), strict=True):
                raw = t.encode()
                for w in wanted:
                    rows.append([w[f] for f in fields])
                    data.append(raw[w["at"]:w["at"] + w["n"] - 1 + length])
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.bool_())
                yield pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)), pa.array(data, pa.binary())],
                                                 names=[*fields, "bytes"])
        return step

    return arrow_map(both, f"{REGION}, times long, crowd boolean, bytes binary", start)


def _indexed(rows: DataFrame, length: int) -> DataFrame:
    """(region's key, first, last): runs of windows that another region of the same anchor hash holds."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ship(rows.sparkSession)
    fields = ["h", "region", "place", "n"]

    def searched(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        if not held:
            return
        _, group = np.unique(np.array([r[0] for r in held]), return_inverse=True)
        index = Index(group, np.array([r[2] for r in held]), [r[4] for r in held])
        long, at, out = index.statistics() >= length, 0, []
        for r in held:
            for a, z in zip(*runs_of(long[at:at + r[3]]), strict=True):
                out.append((*r[:4], int(a), int(z)))
            at += len(r[4])
        if out:
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=[*fields, "first", "last"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in (*fields, "bytes")), strict=True):
                if held and row[:4] == held[-1][:4]:
                    continue  # cut from a repeated row of the input, too
                if size >= INDEX and row[0] != held[-1][0]:
                    yield from searched(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[4])
        yield from searched(held)

    return (rows.select(*fields, "bytes").repartition(parts, "h").sortWithinPartitions(*fields)
            .mapInArrow(run, f"{REGION}, first int, last int"))


def _counted(rows: DataFrame, length: int) -> DataFrame:
    """The same for crowded anchor hashes, by counts of hashes."""
    fields = ["h", "region", "place", "n"]

    def pieces(single: bool):
        def start():
            def step(part: pa.RecordBatch):
                columns = {c: part.column(c).to_pylist() for c in (*fields, "times", "bytes", *(["blocks"] if single else []))}
                out = [[] for _ in range(8)]
                for h, region, place, n, times, raw, *only in zip(*columns.values(), strict=True):
                    hashes, window = Hashes(np.frombuffer(raw, np.uint8)), np.arange(n)
                    rel = window - place
                    block = rel // STEP
                    if single:
                        window = window[np.isin(block, only[0])]
                        a, z, where = window, window + length, window - place
                    else:
                        where = np.unique(block)
                        a, z = where * STEP + STEP - 1 + place, where * STEP + length + place
                        window = where
                    size = len(a)
                    for o, v in zip(out, (np.full(size, h), np.full(size, region), np.full(size, place), np.full(size, n), np.full(size, times),
                                          where, hashes.of(a, z).view(np.int64), window), strict=True):
                        o.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(o), k) for o, k in zip(out, (
                    pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32()), strict=True)],
                    names=[*fields, "times", "where", "hash", "first"])
            return step
        return start

    schema = f"{REGION}, times long, where int, hash long, first int"

    def repeated(made: DataFrame) -> DataFrame:
        several = made.groupBy("h", "where", "hash").agg(F.sum("times").alias("all")).filter("all > 1").select("h", "where", "hash")
        return made.join(several, ["h", "where", "hash"])

    kept = repeated(arrow_map(rows, schema, pieces(False)))
    blocks = kept.groupBy(*fields).agg(F.collect_list("where").alias("blocks"))
    windows = arrow_map(rows.join(blocks, fields), schema, pieces(True))
    return repeated(windows).select(*fields, "first", (F.col("first") + 1).alias("last"))


def repeats(df: DataFrame, length: int = 400, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, digest, spans): for each text with a repeat, the byte ranges [first, last) that lie in one, merged.

    `digest` is xxhash64 of the text. A null text is empty. Rows that repeat an id and a text are
    copies of each other and have one row here; so do null ids with equal texts.
    """
    keyed = df.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("digest", F.xxhash64("text"))
    cut = stage(_cut(keyed, length), "regions")
    several = cut.groupBy("h").count().filter("count > 1").select("h")
    cut = stage(cut.join(several, "h", "left_semi"), "shared-regions")
    key = ["h", "region", "place", "n"]
    distinct = stage(cut.groupBy(*key).agg(F.count(F.lit(1)).alias("times"), F.min(F.struct("doc_id", "digest", "at")).alias("one")), "distinct-regions")
    variants = distinct.groupBy("h").agg(F.count(F.lit(1)).alias("variants")).filter("variants > 1")
    wanted = distinct.join(variants.select("h", (F.col("variants") > CROWD).alias("crowd")), "h")
    got = stage(_fetched(keyed, wanted, length), "region-bytes")
    whole = distinct.filter("times > 1").select(*key, F.lit(0).alias("first"), F.col("n").alias("last"))
    part = _indexed(got.filter("not crowd"), length).unionByName(_counted(got.filter("crowd").dropDuplicates(key), length))
    found = whole.unionByName(part).groupBy(*key).agg(F.collect_list(F.struct("first", "last")).alias("windows"))
    spans = cut.join(found, key).select("doc_id", "digest", F.explode(F.transform("windows", lambda w: F.struct(
        (F.col("at") + w["first"]).alias("first"), (F.col("at") + w["last"] - 1 + length).alias("last")))).alias("span"))
    return spans.groupBy("doc_id", "digest").agg(F.array_sort(F.collect_set("span")).alias("spans"))


def remove(df: DataFrame, length: int = 400, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, removed, kept): the ranges taken out of each text, and the bytes left.

    `removed` is flat: first and end of the first range, of the second, and so on. A text's bytes are its UTF-8. Whether a string repeats is decided on the input alone. Null
    texts count as empty; texts shorter than `length` stay whole. Other columns aren't read.
    """
    keyed = df.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("digest", F.xxhash64("text"))
    spans = stage(repeats(df, length, doc_id, text), "spans").select(F.col("doc_id").alias("d"), F.col("digest").alias("g"), "spans")
    both = keyed.join(spans, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("digest") == F.col("g")), "left").select("doc_id", "text", "spans")

    def start():
        def step(part: pa.RecordBatch) -> list[pa.Array]:
            sizes, taken, kept = [], [], []
            for t, spans in zip(texts(part, "text"), part.column("spans").to_pylist(), strict=True):
                raw, merged, left, at = t.encode(), [], [], 0
                for s in spans or ():
                    if merged and s["first"] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], s["last"])
                    else:
                        merged.append([s["first"], s["last"]])
                for a, z in merged:
                    left.append(raw[at:a])
                    at = z
                left.append(raw[at:])
                sizes.append(len(raw))
                taken.append(np.array(merged, np.int64).ravel())
                kept.append(b"".join(left))
            pairs = lists(np.concatenate(taken), [len(x) for x in taken], pa.int64())
            return [pa.array(sizes, pa.int64()), pairs, pa.array(kept, pa.binary())]
        return step

    return append(both, "n_bytes long, removed array<long>, kept binary", start, keep=["doc_id"])
