"""Embedding near-duplicates by spherical-cap filters from a structured random product code.

A filter is a direction; a vector passes it if their inner product reaches the vector's bound.
Directions are not listed but composed: each of four blocks of the (randomly rotated) space has
`t` random unit codewords, and every combination of four codewords is a direction. The bound of
a vector is the one that a given number of directions reach. (A bound common to all would leave
many vectors, those with uneven blocks, without a filter.) All directions above it are decoded, from
the sums of two pairs of blocks: the best directions are sums of the best of either pair, so the work
is about the square root of the number of directions. Vectors are joined on filters and verified by
their cosine in double precision.

Both numbers follow from the number n of distinct vectors of a dimension (`plan`): directions, so that
a filter is passed by about `LOAD` vectors at every n; filters of a vector, so that of random pairs
whose cosine is just the threshold a share of `RECALL` pass one together, whatever n is.

Equal vectors are one row with a count. A filter that many vectors pass is cut into blocks and
pairs of blocks, each a task of bounded size; a link is counted under the first filter that its
vectors share. Pairs are never written: a block gives sums of links and local components.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from throughline.llm.components import components
from throughline.llm.frames import arrow_map, lists, ship, stage

LOAD, LEAST, BLOCKS, SEED = 512, 32, 4, 42
#: Share of pairs at the threshold to be found, and the pairs drawn to measure it.
RECALL, DRAWS = 0.99, 2000
#: Rows of a filter's block, and scores held at once while lists are decoded.
BLOCK, SCORES = 1024, 1 << 21


class Code:
    """The product code for n vectors of a dimension, each of which passes `width` filters."""

    def __init__(self, n: int, dim: int, width: int):
        draw = np.random.default_rng([SEED, dim])
        self.width = width
        self.t = max(3, math.ceil((width * n / LOAD) ** (1 / BLOCKS)))
        self.rotation = np.linalg.qr(draw.normal(size=(dim, dim)))[0]
        self.parts = np.array_split(np.arange(dim), BLOCKS)
        self.words = []
        for part in self.parts:
            w = draw.normal(size=(self.t, max(1, len(part))))[:, :len(part)]
            self.words.append(w / np.maximum(np.linalg.norm(w, axis=1, keepdims=True), 1e-300) * math.sqrt(len(part) / dim))
        # of two falling lists, the sum of the i-th and the j-th (from 1) has i*j - 1 sums that are no smaller
        i, j = np.ogrid[:min(width, self.t ** 2), :min(width, self.t ** 2)]
        self.pairs = np.nonzero((i + 1) * (j + 1) <= width)

    def passed(self, unit: np.ndarray) -> np.ndarray:
        """The sorted numbers of the filters that each row of unit vectors passes: row by filter."""
        some = max(1, SCORES // max(self.t ** 2, len(self.pairs[0])))
        return np.concatenate([self._passed(unit[at:at + some]) for at in range(0, len(unit), some)])

    def _passed(self, unit: np.ndarray) -> np.ndarray:
        turned, t = unit @ self.rotation, self.t
        scores = [turned[:, p] @ w.T for p, w in zip(self.parts, self.words, strict=True)]
        halves = [(x[:, :, None] + y[:, None, :]).reshape(len(unit), t * t) for x, y in (scores[:2], scores[2:])]
        best, high = [], []
        for half in halves:
            top = np.argpartition(-half, min(self.width, t * t) - 1, axis=1)[:, :self.width]
            value = np.take_along_axis(half, top, axis=1)
            order = np.argsort(-value, axis=1, kind="stable")
            best.append(np.take_along_axis(top, order, axis=1))
            high.append(np.take_along_axis(value, order, axis=1))
        first, second = self.pairs
        sums = high[0][:, first] + high[1][:, second]
        top = np.argpartition(-sums, min(self.width, sums.shape[1]) - 1, axis=1)[:, :self.width]
        return np.sort(np.take_along_axis(best[0], first[top], axis=1) * (t * t) + np.take_along_axis(best[1], second[top], axis=1), axis=1)


def recall(code: Code, dim: int, cosine: float, draws: int = DRAWS, seed: int = SEED) -> float:
    """The share of random pairs of that cosine that pass a filter together."""
    draw = np.random.default_rng([seed, dim, 1])
    x, y = unit(draw.normal(size=(draws, dim))), draw.normal(size=(draws, dim))
    y = unit(y - (x * y).sum(1, keepdims=True) * x)
    both = np.concatenate([code.passed(x), code.passed(cosine * x + math.sqrt(1 - cosine ** 2) * y)], axis=1)
    both.sort(axis=1)
    return float((both[:, 1:] == both[:, :-1]).any(1).mean())


def plan(n: int, dim: int, threshold: float) -> int:
    """How many filters each of n vectors passes: the least of 32, 40, 50, ... that reaches `RECALL`.

    Pairs of one component are parallel or opposite, so they share all filters or need none.
    """
    width = LEAST
    while 1 < dim and 0 < threshold < 1:
        code = Code(n, dim, width)
        if len(code.pairs[0]) >= code.t ** BLOCKS or recall(code, dim, threshold) >= RECALL:
            break
        width = math.ceil(1.25 * width)
    return width


def _filters(reps: DataFrame, sizes: dict[int, tuple[int, int]]) -> DataFrame:
    """A row (filter, rep, mult, vec, earlier) for each filter that a distinct vector passes; `earlier` lists the lower ones.

    `sizes` gives the number of vectors and of filters a vector for each dimension.
    """
    def start():
        codes: dict[int, Code] = {}

        def step(part: pa.RecordBatch):
            rows: list[tuple] = []
            for rep, mult, vec in zip(*(part.column(c).to_pylist() for c in ("rep", "mult", "embedding")), strict=True):
                rows.append((rep, mult, np.array(vec, float)))
            for dim in sorted({len(r[2]) for r in rows}):
                own = [r for r in rows if len(r[2]) == dim]
                x = np.array([r[2] for r in own])
                code = codes.get(dim) or Code(sizes[dim][0], dim, sizes[dim][1])
                codes[dim] = code
                for at in range(0, len(own), 256):
                    some = own[at:at + 256]
                    found = code.passed(unit(x[at:at + 256]))
                    width = found.shape[1]
                    index = np.repeat(np.arange(len(some)), width)
                    lower = np.tril(np.ones((width, width), bool), -1)
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.full(len(index), dim), pa.int32()), pa.array(found.ravel(), pa.int64()),
                        pa.array(np.array([r[0] for r in some])[index], pa.int64()), pa.array(np.array([r[1] for r in some])[index], pa.int64()),
                        pa.array([r[2].astype(np.float32).tobytes() for r in some], pa.binary()).take(pa.array(index)),
                        lists(np.concatenate([np.broadcast_to(f, lower.shape)[lower] for f in found]), list(range(width)) * len(some), pa.int64())],
                        names=["dim", "filter", "rep", "mult", "vec", "earlier"])
        return step

    return arrow_map(reps.select("rep", "mult", "embedding"), "dim int, filter long, rep long, mult long, vec binary, earlier array<long>", start)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled by their largest component first, so that squares neither overflow nor vanish."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def local_components(near: np.ndarray) -> np.ndarray:
    """The least row that each row reaches in a symmetric matrix of links."""
    label = np.arange(len(near))
    while True:
        new = np.minimum(label, np.where(near, label[None, :], len(near)).min(1))
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


class _Task:
    """The rows of one filter, of one block or a pair of blocks of it."""

    def __init__(self, key: tuple, threshold: float):
        self.key, self.threshold, self.rows = key, threshold, []

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """(rep, links counted here, least rep linked here)."""
        _, _, low, high = self.key
        if len(self.rows) < 2:
            return None
        rep = np.array([r[0] for r in self.rows])
        mult = np.array([r[1] for r in self.rows])
        block = np.array([r[2] for r in self.rows])
        x = unit(np.frombuffer(b"".join(r[3] for r in self.rows), np.float32).reshape(len(rep), -1).astype(float))
        near = x @ x.T >= self.threshold
        if low != high:
            near &= block[:, None] != block[None, :]
        np.fill_diagonal(near, False)
        near |= near.T
        if not near.any():
            return None
        i, j = np.nonzero(np.triu(near))
        width = max(1, *(len(r[4]) for r in self.rows))
        earlier = np.full((len(rep), width), -1)
        for k, r in enumerate(self.rows):
            earlier[k, :len(r[4])] = r[4]
        first = np.ones(len(i), bool)
        some = max(1, (1 << 20) // width ** 2)
        for at in range(0, len(i), some):
            a, b = earlier[i[at:at + some]], earlier[j[at:at + some]]
            first[at:at + some] = ~((a[:, :, None] == b[:, None, :]) & (a >= 0)[:, :, None]).any((1, 2))
        added = np.bincount(i[first], mult[j[first]], len(rep)) + np.bincount(j[first], mult[i[first]], len(rep))
        some = np.flatnonzero(near.any(1))
        order = np.argsort(rep)
        least = np.empty(len(rep), np.int64)
        least[order] = rep[order][local_components(near[np.ix_(order, order)])]
        return rep[some], added[some].astype(np.int64), least[some]


def near_duplicates(df: DataFrame, threshold: float = 0.9, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row.

    A vector that is null, empty or zero or holds a null or non-finite component links with
    nothing, and neither does a row without an id; vectors of different dimensions don't link.
    Rows that repeat an id are vectors of their own: each is counted as a link of the others.
    Other columns aren't read, whatever their names.
    """
    ship(df.sparkSession)
    rows = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<float>").alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = (F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0)
              & finite & F.exists("embedding", lambda x: x != 0))
    rows = rows.withColumn("usable", F.coalesce(usable, F.lit(False)))
    valid = rows.filter("usable")
    reps = stage(valid.groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("mult")), "vectors")
    counts = {r.dim: r["count"] for r in reps.groupBy(F.size("embedding").alias("dim")).count().collect()}     # a row per dimension
    spread = stage(_filters(reps, {d: (n, plan(n, d, threshold)) for d, n in counts.items()}), "filters")
    sizes = spread.groupBy("dim", "filter").count().filter("count > 1")
    blocks = F.ceil(F.col("count") / BLOCK).cast("int")
    cut_up = (spread.join(sizes, ["dim", "filter"]).withColumn("blocks", blocks)
              .withColumn("block", F.pmod(F.xxhash64("rep"), "blocks").cast("int"))
              .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
              .select("dim", "filter", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"),
                      "block", "rep", "mult", "vec", "earlier"))
    key = ["dim", "filter", "low", "high"]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(task: _Task) -> Iterator[pa.RecordBatch]:
            if found := task.links():
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in found], names=["rep", "links", "least"])

        task = None
        for batch in batches:
            columns = {c: batch.column(c).to_pylist() for c in (*key, "rep", "mult", "block", "vec", "earlier")}
            for *k, rep, mult, block, vec, earlier in zip(*columns.values(), strict=True):
                if task is None or task.key != tuple(k):
                    if task:
                        yield from told(task)
                    task = _Task(tuple(k), threshold)
                task.rows.append((rep, mult, block, vec, earlier))
        if task:
            yield from told(task)

    found = stage(cut_up.repartition(parts, *key).sortWithinPartitions(*key, "rep")
                  .mapInArrow(verified, "rep long, links long, least long"), "links")
    linked = found.groupBy("rep").agg(F.sum("links").alias("links"))
    joined = components(found.select(F.col("rep").alias("u"), F.col("least").alias("v"))).withColumnRenamed("node", "rep")
    named = (reps.join(linked, "rep", "left").join(joined, "rep", "left")
             .select("embedding", (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links"),
                     F.coalesce("component", "rep").alias("component_id")))
    good = valid.join(named, "embedding").select("vec_id", "n_links", "component_id")
    bad = rows.filter("not usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return good.unionByName(bad).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
