"""SimHash fingerprints, linked within a Hamming distance by pigeonring filtering.

The 64 bits are cut into a ring of m segments. If two fingerprints differ in at most r bits, then
there is a segment from which on every chain of l consecutive segments has at most l*r/m
differing bits. While l*r/m is below one, the budget is zero: so the first segments of the chain
are equal, and their bits are a join key. The rest of the chain's budgets is checked in the join,
before the full distance.

Fingerprints that are equal are one row throughout. A key shared by more than `CROWD`
fingerprints isn't joined with itself: the fingerprints under it are linked through the balls of
radius one instead, which is exact for r = 2. Two of them differ in at most two bits exactly if
they have a neighbour within one bit in common, and at most 65 fingerprints lie around one.

Other radii leave no key that parts the fingerprints well, so they are compared block by block.

`copies` links texts by the exact Jaccard similarity of their shingle sets. Fingerprints of 128 bits
choose the pairs to verify, but only of sets that pigeonring filtering of the sets themselves leaves:
the similarity bounds the shingles in which two sets of like size differ by some d; their shingles
are dealt over a ring of more than d segments, and the segments that are empty in both left out.
Then there is a segment from which on every chain of l of the r others holds at most l*d/r differing
ones; the first is equal and not empty, so its shingles are a join key, and a digit of each following
segment rides along for the budgets of the chain.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from throughline.llm.components import components
from throughline.llm.frames import THIN, append, arrow_map, ship, stage, texts
from throughline.session import small_side

BITS, CROWD, SEED = 64, 64, 42
#: Shingles whose bits are counted at a time.
RUN = 1 << 16
#: Fingerprints on either side of a block of comparisons, and rows compared at a time.
BLOCK, ROWS = 8192, 128
#: Segments after a chain's first whose digits ride along, and the base of a digit, of which zero is an empty segment.
AHEAD, DIGITS = 12, 31
#: Standard deviations by which the wide fingerprints' radius exceeds the mean distance at the threshold.
SPREAD = 4.5


def fingerprint(text: str, words: int) -> int:
    """The fingerprint of a text's word shingles, repeats included; zero without words. As a signed 64-bit integer."""
    found = text.encode().lower().split()
    if not found:
        return 0
    line = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    ends = ends.tolist()[words - 1:] if len(found) >= words else [len(line)]
    digest, ones, n = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64), len(ends)
    for at in range(0, n, RUN):
        part = np.array([digest(line[a:z], SEED) for a, z in zip(starts[at:at + RUN], ends[at:at + RUN], strict=False)], ">u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n).view(">i8")[0])


def fingerprints(df: DataFrame, words: int = 3, text: str = "text", out: str = "fp", keep: list[str] | None = None) -> DataFrame:
    """`df` with the fingerprint of each whole text as a signed long; null counts as empty."""
    def start():
        return lambda part: [pa.array([fingerprint(t, words) for t in texts(part, text)], pa.int64())]

    return append(df, f"`{out}` long", start, keep)


def ring(radius: int) -> list[tuple[int, int]]:
    """(first bit, size) of the segments: an odd number of them, three for each bit of the radius and one."""
    m = 3 * radius + 1
    ends = [BITS * i // m for i in range(m + 1)]
    return [(a, z - a) for a, z in zip(ends, ends[1:], strict=False)]


def chain_masks(radius: int, length: int) -> list[int]:
    """For each start, the bits of `length` consecutive segments, as a signed long."""
    segments, out = ring(radius), []
    for s in range(len(segments)):
        mask = 0
        for i in range(length):
            a, n = segments[(s + i) % len(segments)]
            mask |= ((1 << n) - 1) << a
        out.append(mask - (1 << 64) if mask >> 63 else mask)
    return out


def _at_start(masks: list[int]) -> Column:
    return F.array(*[F.lit(m).cast("long") for m in masks])[F.col("start")]


def links(fps: DataFrame, radius: int = 2) -> DataFrame:
    """Edges (u, v) that connect the distinct fingerprints `fp` just as all pairs within the radius would."""
    if radius != 2:  # the balls that crowded keys need are exact for radius 2
        items = fps.select(F.col("fp").alias("sid"), F.col("fp").alias("hi"), F.lit(0).cast("long").alias("lo"), F.lit(0).alias("bucket"), F.col("fp").alias("label"))
        return _near(items, radius, every=True)
    m = len(ring(radius))
    exact = -(-m // radius) - 1
    keyed = (fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias("start"))
             .withColumn("key", F.col("fp").bitwiseAND(_at_start(chain_masks(radius, exact)))))
    sizes = keyed.groupBy("start", "key").count().filter("count > 1")
    keyed = stage(keyed.join(sizes, ["start", "key"]), "ring")

    sparse = keyed.filter(F.col("count") <= CROWD)
    left, right = sparse.select("start", "key", F.col("fp").alias("u")), sparse.select("start", "key", F.col("fp").alias("v"))
    apart = F.col("u").bitwiseXOR(F.col("v"))
    near = F.col("u") < F.col("v")
    for length in range(exact + 1, m + 1):
        budget = length * radius // m
        if length == m or (length + 1) * radius // m > budget:
            near = near & (F.bit_count(apart.bitwiseAND(_at_start(chain_masks(radius, length)))) <= budget)
    pairs = left.join(right, ["start", "key"]).filter(near).select("u", "v")

    crowd = keyed.filter(F.col("count") > CROWD).select("fp").distinct()
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << b if b < 63 else -(1 << 63)).cast("long") for b in range(BITS)])
    balls = (crowd.select("fp", F.explode(F.transform(flips, lambda f: F.col("fp").bitwiseXOR(f))).alias("centre"))
             .groupBy("centre").agg(F.collect_list("fp").alias("around")).filter(F.size("around") > 1))
    stars = balls.select(F.explode("around").alias("u"), F.array_min("around").alias("v")).filter("u != v")
    return pairs.unionByName(stars).distinct()


def groups(df: DataFrame, words: int = 3, radius: int = 2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) for each row: the least id that is reachable over links within the radius.

    Texts without words (null ones too) have fingerprint zero and are linked like any other. Rows
    with a null id belong to a component but never name it. Repeated rows stay. Other columns
    aren't read, whatever their names.
    """
    rows = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    own = stage(fingerprints(rows, words, keep=["doc_id"]), "fingerprints")
    fps = stage(own.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct-fingerprints")
    found = components(links(fps.select("fp"), radius)).withColumnRenamed("node", "fp")
    held = fps.join(found, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    names = held.groupBy("component").agg(F.min("first").alias("component_id"))
    return own.join(held.join(names, "component").select("fp", "component_id"), "fp")


def shingle_set(text: str, words: int) -> np.ndarray:
    """The sorted 64-bit hashes of a text's different word shingles; of fewer words, of the whole."""
    found = text.encode().lower().split()
    if not found:
        return np.empty(0, np.uint64)
    line = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    ends = ends.tolist()[words - 1:] if len(found) >= words else [len(line)]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(line[a:z], SEED) for a, z in zip(starts, ends, strict=False)), np.uint64, len(ends)))


def wide_fingerprint(hashes: np.ndarray) -> tuple[int, int]:
    """128 bits for a set of hashes, as two signed longs: the majority of the hashes and that of the same hashes mixed."""
    ones, n = np.zeros(2 * BITS, np.int64), len(hashes)
    for at in range(0, n, RUN):
        h = hashes[at:at + RUN]
        mixed = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        mixed = (mixed ^ (mixed >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        both = np.stack([h, mixed ^ (mixed >> np.uint64(31))], axis=1).astype(">u8")
        ones += np.unpackbits(both.view(np.uint8).reshape(len(h), -1), axis=1).sum(0, dtype=np.int64)
    hi, lo = np.packbits(2 * ones > n).view(">i8").tolist()
    return hi, lo


def wide_radius(similarity: float) -> int:
    """Bits in which nearly all sets of that similarity differ at most: at 0.8 their mean is 19 of 128, the radius 38."""
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return math.ceil(2 * BITS * p + SPREAD * math.sqrt(2 * BITS * p * (1 - p)))


def _near(items: DataFrame, radius: int, every: bool) -> DataFrame:
    """The pairs (u, v) of `items` (sid, hi, lo, bucket, label) within the radius, in the same bucket or neighbouring ones.

    Only pairs with different labels count. Unless `every` of them is wanted, each item brings its nearest and its
    least one within a block.
    """
    spark = items.sparkSession
    ship(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sizes = items.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    placed = items.join(sizes, "bucket").withColumn("block", F.pmod(F.xxhash64("sid", F.lit(SEED)), "blocks").cast("int")).drop("blocks")
    unit = sizes.select("bucket", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    low, high = unit.toDF("b", "i"), unit.toDF("c", "j")
    tasks = (low.join(high, F.col("c") == F.col("b")).filter("i <= j")
             .unionByName(low.join(high, F.col("c") == F.col("b") + 1)))
    key = ["b", "i", "c", "j"]
    left = tasks.withColumn("bucket", F.col("b")).withColumn("block", F.col("i")).withColumn("right", F.lit(False))
    right = tasks.filter("b != c or i != j").withColumn("bucket", F.col("c")).withColumn("block", F.col("j")).withColumn("right", F.lit(True))
    rows = placed.join(left.unionByName(right), ["bucket", "block"]).select(*key, "right", "sid", "hi", "lo", "label")

    def compare(block: list[tuple]) -> pa.RecordBatch:
        side, sid, hi, lo, label = (np.concatenate(c) for c in zip(*block, strict=True)) if block else np.empty((5, 0), np.int64)
        cut = int((side == 0).sum())
        hi, lo = hi.view(np.uint64), lo.view(np.uint64)     # of a negative number, bitwise_count() takes the absolute value
        alone, us, vs = cut == len(side), [], []
        to = slice(0, cut) if alone else slice(cut, None)
        for at in range(0, cut, ROWS):
            own = slice(at, min(at + ROWS, cut))
            apart = np.bitwise_count(hi[own, None] ^ hi[None, to]) + np.bitwise_count(lo[own, None] ^ lo[None, to])
            near = apart <= radius
            if not near.any():
                continue
            near &= label[own, None] != label[None, to]
            if every:
                i, j = np.nonzero(near)
            else:
                apart[~near] = 255
                r, c = np.flatnonzero(near.any(1)), np.flatnonzero(near.any(0))
                i = np.concatenate([r, r, apart[:, c].argmin(0), near[:, c].argmax(0)])
                j = np.concatenate([apart[r].argmin(1), near[r].argmax(1), c, c])
            a, b = sid[own][i], sid[to][j]
            us.append(np.minimum(a, b))
            vs.append(np.maximum(a, b))
        u, v = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (us, vs))
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, block = None, []
        for batch in batches:
            keys = np.stack([batch.column(k).to_numpy() for k in key], axis=1)
            columns = [np.asarray(batch.column("right").to_pylist(), np.int64), *(batch.column(c).to_numpy() for c in ("sid", "hi", "lo", "label"))]
            ends = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
            for a, z in zip(ends, ends[1:], strict=False):
                if a == z:
                    continue
                if (k := tuple(keys[a].tolist())) != now:
                    yield compare(block)
                    now, block = k, []
                block.append(tuple(c[a:z] for c in columns))
        yield compare(block)

    return (rows.repartition(parts, *key).sortWithinPartitions(*key, "right", "sid")
            .mapInArrow(run, "u long, v long").distinct())


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return h ^ (h >> np.uint64(32))


def bucket_width(similarity: float) -> float:
    """Buckets of sizes on a log scale: sets that are similar enough lie in the same or in neighbouring ones."""
    return math.log(1 / similarity) + 1e-9


def chains(sid: np.ndarray, bucket: np.ndarray, sets: list[np.ndarray], similarity: float) -> tuple[np.ndarray, ...]:
    """(key, sid, chain, filled, apart): a row for each segment of a set that isn't empty, on its bucket's ring and the one below.

    `apart` is the number of shingles in which similar sets of a ring differ at most, `filled` the number of segments
    that aren't empty; `chain` has the digits of the following segments, and whether the set is of the upper bucket.
    Sets that don't fill more segments than `apart` share one more key, under which all of them meet.
    """
    sizes, made = np.array([len(s) for s in sets], np.int64), []
    for upper in (0, 1):
        own = np.flatnonzero((sizes > 0) & (bucket >= upper))
        if not len(own):
            continue
        ring, n = bucket[own].astype(np.int64) - upper, sizes[own]
        apart = np.floor((1 / similarity - 1) * np.exp((ring + 1) * bucket_width(similarity)) + 1e-6).astype(np.int64)
        m = np.where(apart > 0, apart + apart // 4 + 3, 1)
        first, total = np.cumsum(m) - m, int(m.sum())
        h, of = _mixed(np.concatenate([sets[i] for i in own])), np.repeat(np.arange(len(own)), n)
        at = first[of] + (((h >> np.uint64(32)) * m[of].astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
        h = _mixed(h)
        filled = np.bincount(at, minlength=total) > 0
        low, high = (np.bincount(at, part.astype(float), total).astype(np.uint64) for part in (h & np.uint64(0xFFFFFFFF), h >> np.uint64(32)))
        value = _mixed(_mixed(low) + high)      # sums of up to 2^21 halves are exact in a double
        digit = np.where(filled, 1 + value % np.uint64(DIGITS), 0).astype(np.int64)
        owner = np.repeat(np.arange(len(own)), m)
        inner, size = np.arange(total) - first[owner], m[owner]
        chain = np.full(total, upper << 60, np.int64)
        for i in range(AHEAD):
            chain |= np.where(i + 1 < size, digit[first[owner] + (inner + i + 1) % size], 0) << (5 * i)
        full = np.bincount(owner, filled, len(own)).astype(np.int64)
        key = _mixed(value + _mixed((ring[owner] << 32 | inner).astype(np.uint64))).view(np.int64)
        there = np.flatnonzero(filled)
        made.append((key[there], sid[own][owner[there]], chain[there], full[owner[there]], apart[owner[there]]))
        thin = np.flatnonzero(full <= apart)
        made.append((_mixed(ring[thin].astype(np.uint64) + np.uint64(1 << 62)).view(np.int64), sid[own][thin],
                     np.full(len(thin), upper << 60, np.int64), np.zeros(len(thin), np.int64), apart[thin]))
    return tuple(np.concatenate(c) for c in zip(*made, strict=True)) if made else tuple(np.empty((5, 0), np.int64))


def within_budgets(a: np.ndarray, b: np.ndarray, filled: np.ndarray, apart: np.ndarray) -> np.ndarray:
    """Whether the chains a and b, whose first segments are equal, keep each length's budget and can be of a similar pair."""
    good, length, differ = (a >> 60) + (b >> 60) < 2, np.ones(len(a), np.int64), np.zeros(len(a), np.int64)
    for i in range(AHEAD):
        x, y = a >> (5 * i) & 31, b >> (5 * i) & 31
        length += (x | y) > 0
        differ += x != y
        good &= differ * filled <= length * apart
    return good


def _meeting(rows: DataFrame) -> DataFrame:
    """(key, u, v, crowd): pairs of sets under a key that keep the budgets; of a crowded key its sets, each with itself."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ship(rows.sparkSession)
    names = ["key", "sid", "chain", "filled", "apart"]

    def table(key, u, v, crowd: bool) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(u), pa.array(v), pa.array(np.full(len(key), crowd))], names=["key", "u", "v", "crowd"])

    def meet(held: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Of whole keys."""
        key, sid, chain, filled, apart = held
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        sizes = np.repeat(np.diff(np.append(start, len(key))), np.diff(np.append(start, len(key))))
        crowd = sizes > CROWD
        if crowd.any():
            yield table(key[crowd], sid[crowd], sid[crowd], True)
        some = np.flatnonzero((sizes > 1) & ~crowd)
        key, sid, chain, filled, apart = (c[some] for c in (key, sid, chain, filled, apart))
        for gap in range(1, CROWD):
            i = np.flatnonzero(key[gap:] == key[:-gap])
            if not len(i):
                break
            i = i[within_budgets(chain[i], chain[i + gap], np.maximum(filled[i], filled[i + gap]), apart[i])]
            yield table(key[i], sid[i], sid[i + gap], False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, crowded = np.empty((5, 0), np.int64), None
        for batch in batches:
            new = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in names])
            held = np.concatenate([held, new], axis=1)
            held = held[:, np.concatenate([[True], (held[:2, 1:] != held[:2, :-1]).any(0)])] if held.shape[1] else held
            if crowded is not None:     # the rest of a key that was found crowded in an earlier batch
                cut = int(np.searchsorted(held[0], crowded, "right"))
                yield table(held[0, :cut], held[1, :cut], held[1, :cut], True)
                held, crowded = held[:, cut:], crowded if cut == held.shape[1] else None
            if not held.shape[1]:
                continue
            cut = int(np.searchsorted(held[0], held[0, -1], "left"))
            if cut:
                yield from meet(held[:, :cut])
            held = held[:, cut:]
            if held.shape[1] > CROWD:
                crowded = int(held[0, 0])
                yield table(held[0], held[1], held[1], True)
                held = held[:, :0]
        if held.shape[1]:
            yield from meet(held)

    return (rows.repartition(parts, "key").sortWithinPartitions("key", "sid").select(*names)
            .mapInArrow(run, "key long, u long, v long, crowd boolean"))


def _close(pairs: DataFrame, marks: DataFrame, radius: int) -> DataFrame:
    """The different pairs (u, v) whose wide fingerprints lie within the radius."""
    u, v = marks.select(F.col("sid").alias("u"), F.col("hi").alias("a"), F.col("lo").alias("b")), marks.select(F.col("sid").alias("v"), F.col("hi").alias("c"), F.col("lo").alias("d"))
    apart = F.bit_count(F.col("a").bitwiseXOR(F.col("c"))) + F.bit_count(F.col("b").bitwiseXOR(F.col("d")))
    return pairs.select("u", "v").distinct().join(u, "u").join(v, "v").filter(apart <= radius).select("u", "v")


def _labelled(members: DataFrame, edges: DataFrame) -> DataFrame:
    """`members` (key, sid) of the keys that several components share, with their component as label."""
    found = components(edges).withColumnRenamed("node", "sid")
    held = members.join(found, "sid", "left").withColumn("label", F.coalesce("component", "sid")).drop("component")
    open_keys = held.groupBy("key").agg(F.min("label").alias("least"), F.max("label").alias("most")).filter("least != most").select("key")
    return held.join(open_keys, "key", "left_semi")


def _crowds(members: DataFrame, own: DataFrame, marks: DataFrame, edges: DataFrame, radius: int, similarity: float) -> DataFrame:
    """`edges` and those of the pairs under crowded keys (key, sid): first each set with the least of its key, then with its
    nearest ones, then all that are still in different components."""
    least = members.groupBy("key").agg(F.min("sid").alias("v"))
    stars = members.join(least, "key").select(F.col("v").alias("u"), F.col("sid").alias("v")).filter("u != v")
    pairs = stage(_close(stars, marks, radius), "star-pairs")
    edges = stage(edges.unionByName(_alike(pairs, _sets_of(own, pairs), similarity)), "star-copies")
    for every in (False, True):
        left = stage(_labelled(members, edges), "open-keys")
        if left.isEmpty():
            break
        items = left.join(marks.select("sid", "hi", "lo"), "sid").withColumnRenamed("key", "bucket")
        pairs = stage(_near(items, radius, every), "crowd-pairs")
        edges = stage(edges.unionByName(_alike(pairs, _sets_of(own, pairs), similarity)), "crowd-copies")
    return edges


def _alike(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (u, v) whose sets have at least the Jaccard similarity."""
    both = (pairs.join(sets.select(F.col("sid").alias("u"), F.col("hashes").alias("a")), "u")
            .join(sets.select(F.col("sid").alias("v"), F.col("hashes").alias("b")), "v"))

    def start():
        def step(part: pa.RecordBatch):
            good = []
            for a, b in zip(part.column("a").to_pylist(), part.column("b").to_pylist(), strict=True):
                a, b = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                common = len(np.intersect1d(a, b, assume_unique=True))
                good.append(common >= similarity * (len(a) + len(b) - common) - 1e-9)
            yield part.select(["u", "v"]).filter(pa.array(good, pa.bool_()))
        return step

    return arrow_map(both.select("u", "v", "a", "b"), "u long, v long", start, THIN)


def _sets_of(own: DataFrame, pairs: DataFrame) -> DataFrame:
    """The shingle sets (sid, hashes) that the pairs need, each once; no other one is moved."""
    wanted = small_side(pairs.select(F.explode(F.array("u", "v")).alias("sid")).distinct())
    return own.select("sid", "hashes").join(wanted, "sid", "left_semi").dropDuplicates(["sid"])


def copies(df: DataFrame, words: int = 5, similarity: float = 0.8, doc_id: str = "doc_id", text: str = "text",
           keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, component_id, and the columns `keep`) for each row: the least id reachable over texts whose sets of shingles have the Jaccard similarity.

    Sets that differ in size by more than the similarity allows are not compared, nor those without
    a chain in common. Of the others, all within `wide_radius` are; under a key of more than `CROWD`
    sets those in different components. Texts without words are copies of each other. Nulls, ids
    and repeats are as in `groups`.
    """
    step = bucket_width(similarity)
    rows = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), *keep)

    def start():
        def each(part: pa.RecordBatch) -> list[pa.Array]:
            sets = [shingle_set(t, words) for t in texts(part, "text")]
            wide = [wide_fingerprint(s) for s in sets]
            return [pa.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) - (1 << 63) for s in sets], pa.int64()),
                    pa.array([w[0] for w in wide], pa.int64()), pa.array([w[1] for w in wide], pa.int64()),
                    pa.array([int(math.log(len(s) or 0.5) / step // 1) for s in sets], pa.int32()),
                    pa.array([s.tobytes() for s in sets], pa.binary())]
        return each

    own = stage(append(rows, "sid long, hi long, lo long, bucket int, hashes binary", start, keep=["doc_id", *keep], limit=THIN), "shingle-sets")
    items = stage(own.groupBy("sid").agg(F.min("doc_id").alias("first"), *[F.first(c).alias(c) for c in ("hi", "lo", "bucket")]), "distinct-sets")
    radius, marks = wide_radius(similarity), items.select("sid", "hi", "lo")

    def ringed():
        def step(part: pa.RecordBatch):
            sets = [np.frombuffer(b, np.uint64) for b in part.column("hashes").to_pylist()]
            rows = chains(part.column("sid").to_numpy(), part.column("bucket").to_numpy(), sets, similarity)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], names=["key", "sid", "chain", "filled", "apart"])
        return step

    rows = arrow_map(own.select("sid", "bucket", "hashes"), "key long, sid long, chain long, filled int, apart int", ringed, THIN)
    met = stage(_meeting(rows), "meeting-sets")
    pairs = stage(_close(met.filter("not crowd"), marks, radius), "near-pairs")
    edges = stage(_alike(pairs, _sets_of(own, pairs), similarity), "near-copies")
    crowd = met.filter("crowd").select("key", F.col("u").alias("sid"))
    if not crowd.isEmpty():
        edges = _crowds(crowd, own, marks, edges, radius, similarity)
    found = components(edges).withColumnRenamed("node", "sid")
    held = items.join(found, "sid", "left").withColumn("component", F.coalesce("component", "sid"))
    names = held.groupBy("component").agg(F.min("first").alias("component_id"))
    return own.select("doc_id", "sid", *keep).join(held.join(names, "component").select("sid", "component_id"), "sid").select("doc_id", "component_id", *keep)
