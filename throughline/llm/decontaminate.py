"""Benchmark decontamination by BM25 retrieval of test items for every training passage.

The test items are the indexed side. A passage of a training text is a query, and an item's score
for it is divided by the item's score for itself, so that one threshold fits all items. Postings
are in order of the items' own scores, which puts items of like size into a block: a block's
maximal weights then are tight. A passage is two neighbouring runs of words, each as long as the
longest item, so an item that was copied lies within some passage whole.

For every passage, the block maxima of its words bound the scores in each block; blocks that
can't reach the threshold are skipped for good. In the others, WAND moves a pivot over the
postings: items before the place where the terms' maxima could reach the threshold are never
scored. All items at or above the threshold are retrieved and then verified: enough of the word
shingles of the question (the first two thirds of the item) have to occur in the passage, or
enough of the whole item's words, in pairs of neighbours at least. So an item that was cut short
or had some words changed is found, a short one too, while its words in another order are not.
The overlap of the answer (the last third) is reported, but decides nothing.

The index is sent to the executors; its size is checked, and items beyond `SHARD` bytes of text go
into further shards, each with its own pass over the texts. Term statistics cover all items.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from throughline.llm.frames import append, ship, stage, texts

K1, B, BLOCK, SHARD = 1.2, 0.75, 4, 32 << 20
SHINGLE, SHORTEST_RUN, PAIR = 5, 32, 2

_FOLD = bytes(c if chr(c).isalnum() or c > 127 else 32 for c in range(256))


def words(text: str) -> list[bytes]:
    """Lower-case words; ASCII punctuation parts them."""
    return text.lower().encode().translate(_FOLD).split()


def shingles(tokens: list[bytes], size: int = SHINGLE) -> set[tuple[bytes, ...]]:
    """Runs of `size` words; of fewer, the whole."""
    return {tuple(tokens[i:i + size]) for i in range(max(1, len(tokens) - size + 1))} if tokens else set()


def overlap_with(wanted: set[tuple[bytes, ...]], tokens: list[bytes], held: dict[int, set]) -> float:
    """The share of `wanted` that occurs in a passage; a short question or answer is one run of its own length.
    `held` keeps the passage's runs by length."""
    if not wanted:
        return 1.0
    size = len(next(iter(wanted)))
    if size not in held:
        held[size] = shingles(tokens, size)
    return len(wanted & held[size]) / len(wanted)


def covered(item: list[bytes], tokens: list[bytes], held: dict[int, set]) -> float:
    """The share of an item's words that lie in runs of `PAIR` words or more which occur in a passage."""
    size = min(PAIR, len(item))
    if size not in held:
        held[size] = shingles(tokens, size)
    inside = [False] * len(item)
    for i in range(len(item) - size + 1):
        if tuple(item[i:i + size]) in held[size]:
            inside[i:i + size] = [True] * size
    return sum(inside) / len(item)


class Index:
    """Postings of a shard of items with their block maxima.

    `items`: (item_id, words). `frequency`: in how many of all items each word occurs.
    """

    def __init__(self, items: list[tuple[int, list[bytes]]], frequency: dict[bytes, int], n_items: int, mean_words: float):
        def weights(tokens: list[bytes]) -> dict[bytes, float]:
            norm, out = K1 * (1 - B + B * len(tokens) / mean_words), {}
            for w in set(tokens):
                tf, df = tokens.count(w), frequency[w]
                out[w] = math.log(1 + (n_items - df + 0.5) / (df + 0.5)) * tf * (K1 + 1) / (tf + norm)
            return out

        scored = sorted(((sum((v := weights(t)).values()), i, t, v) for i, t in items if t), key=lambda x: x[:2])
        self.ids = [i for _, i, _, _ in scored]
        self.vocabulary: dict[bytes, int] = {}
        self.blocks = -(-len(scored) // BLOCK)
        #: Of each block, the postings (item, weight) of every word that occurs in it.
        self.postings: list[dict[int, list[tuple[int, float]]]] = [defaultdict(list) for _ in range(self.blocks)]
        for at, (own, _, _, v) in enumerate(scored):
            for w, x in v.items():
                self.postings[at // BLOCK][self.vocabulary.setdefault(w, len(self.vocabulary))].append((at, x / own))
        self.maxima = np.zeros((len(self.vocabulary) + 1, self.blocks), np.float32)     # the last row: unknown words
        for b, block in enumerate(self.postings):
            for i, posting in block.items():
                self.maxima[i, b] = np.nextafter(np.float32(max(x for _, x in posting)), np.float32(2))
        self.run = max([SHORTEST_RUN, *(len(t) for *_, t, _ in scored)])
        cut = [-(-2 * len(t) // 3) for *_, t, _ in scored]
        self.items = [t for *_, t, _ in scored]
        self.questions = [shingles(t[:c]) for c, (*_, t, _) in zip(cut, scored, strict=True)]
        self.answers = [shingles(t[c:]) for c, (*_, t, _) in zip(cut, scored, strict=True)]

    def retrieve(self, terms: list[int], block: int, threshold: float) -> list[tuple[int, float]]:
        """All items of a block with a score of at least the threshold, by WAND over the terms' postings."""
        high, inside, most = (block + 1) * BLOCK, self.postings[block], self.maxima[:, block]
        cursors, out = [[inside[t][0][0], 0, inside[t], float(most[t])] for t in terms if t in inside], []
        while cursors:
            cursors.sort(key=lambda c: c[0])
            bound, pivot = 0.0, None
            for i, c in enumerate(cursors):
                bound += c[3]
                if bound >= threshold:
                    pivot = i
                    break
            if pivot is None:
                break
            item = cursors[pivot][0]
            if cursors[0][0] == item:
                score = 0.0
                for c in cursors:
                    if c[0] == item:
                        score += c[2][c[1]][1]
                        c[1] += 1
                if score >= threshold:
                    out.append((item, score))
            else:
                for c in cursors[:pivot]:
                    c[1] = bisect_left(c[2], (item,), c[1])
            for c in cursors:
                c[0] = c[2][c[1]][0] if c[1] < len(c[2]) else high
            cursors = [c for c in cursors if c[0] < high]
        return out

    def search(self, text: str, threshold: float, overlap: float) -> list[tuple[int, float, float, float]]:
        """(item, score, question overlap, answer overlap) of the verified items of a text, the best passage for each."""
        tokens, best, get = words(text), {}, self.vocabulary.get
        none = len(self.vocabulary)
        ids = np.array([get(w, none) for w in tokens], np.int64)
        known = np.flatnonzero(ids < none)
        if not len(known):
            return []
        halves = -(-len(tokens) // self.run)
        pairs = np.unique((known // self.run) * none + ids[known])
        half, word = pairs // none, pairs % none
        sums = np.zeros((halves + 1, self.blocks), np.float32)
        first = np.flatnonzero(np.concatenate([[True], half[1:] != half[:-1]]))
        sums[half[first]] = np.add.reduceat(self.maxima[word], first, axis=0)
        bounds = sums[:-1] + sums[1:]
        last, terms = -1, ids[:0]
        for at, block in np.argwhere(bounds >= threshold * (1 - 1e-5)):
            span = slice(at * self.run, (at + 2) * self.run)
            if at != last:
                last, terms = at, np.unique(ids[span])
            if self.maxima[terms, block].sum() < threshold * (1 - 1e-5):
                continue
            found = self.retrieve(terms.tolist(), int(block), threshold)
            if not found:
                continue
            held: dict[int, set] = {}
            for item, score in found:
                q, a = (overlap_with(s, tokens[span], held) for s in (self.questions[item], self.answers[item]))
                if (q >= overlap or covered(self.items[item], tokens[span], held) >= overlap) and score > best.get(item, (0.0,))[0]:
                    best[item] = (score, q, a)
        return sorted((self.ids[i], *b) for i, b in best.items())


def indexes(items: DataFrame, item_id: str, text: str) -> list[Index]:
    """The shards of the items' index. Each is built from at most about `SHARD` bytes that reach the driver."""
    rows = items.select(F.col(item_id).alias("item_id"), F.col(text).alias("text")).filter("item_id is not null and text is not null")
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    ship(items.sparkSession)

    def start():
        return lambda part: [pa.array([words(t) for t in texts(part, "text")], pa.list_(pa.binary()))]

    split = stage(append(rows, "words array<binary>", start, keep=["item_id"]), "items").filter(F.size("words") > 0)
    n, mean = split.agg(F.count(F.lit(1)), F.avg(F.size("words"))).first()
    shards = max(1, math.ceil(size / SHARD))
    split = split.withColumn("shard", F.pmod(F.xxhash64("item_id"), F.lit(shards)))
    frequency = split.select(F.explode(F.array_distinct("words")).alias("w")).groupBy("w").count()
    out = []
    for s in range(shards if n else 0):
        own = split.filter(F.col("shard") == s)
        held = [(r.item_id, [bytes(w) for w in r.words]) for r in own.select("item_id", "words").collect()]
        seen = own.select(F.explode("words").alias("w")).distinct().join(frequency, "w").collect()
        out.append(Index(held, {bytes(r.w): r["count"] for r in seen}, n, mean))
    return out


LEAK = "array<struct<item_id: bigint, score: double, question: double, answer: double>>"


def find_leaks(df: DataFrame, items: DataFrame, threshold: float = 0.5, overlap: float = 0.6, text: str = "text",
               item_id: str = "item_id", item_text: str = "text", out: str = "leaks") -> DataFrame:
    """`df` with the items that each whole text holds, with their scores and overlaps; an empty list for most.

    A null text holds nothing. Items without words are ignored; items that repeat an id are found
    separately. Repeated rows of `df` stay. A column with the new name is replaced.
    """
    found = df.drop(out).withColumn(out, F.array().cast(LEAK))
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("score", pa.float64()), ("question", pa.float64()), ("answer", pa.float64())]))
    for index in indexes(items, item_id, item_text):
        sent = df.sparkSession.sparkContext.broadcast(index)

        def start(sent=sent):
            index = sent.value

            def step(part: pa.RecordBatch) -> list[pa.Array]:
                before = part.column(out).to_pylist()
                return [pa.array([old + [dict(zip(("item_id", "score", "question", "answer"), x, strict=True)) for x in index.search(t, threshold, overlap)]
                                  for old, t in zip(before, texts(part, text), strict=True)], kind)]
            return step

        found = append(found, f"`{out}` {LEAK}", start)
    return found
