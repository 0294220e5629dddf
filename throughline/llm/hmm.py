"""A hidden Markov language model over word classes.

The most frequent training words are classes of their own; the other words share classes by
their last bytes, and so does every word that training never saw. A text's probability is that
of its class sequence under a hidden Markov model, times that of each word within its class,
(c+1) / (N+V+1) with the class's own tokens N and types V, one type being left for unseen words.

* Word counts cover all training texts: counted inside a task, then summed over a shuffle.
* Baum-Welch: every pass reads all training tokens. A task returns its expected counts, which
  are summed in chunks by other tasks; the driver gets the sums, whose size depends only on
  the number of states and classes. Long texts are cut into runs of `RUN` tokens, which go in step;
  what enters a run from before and what follows it come from the runs' transfer matrices, so the
  counts are those of whole texts, whatever the length of a run.
* Scoring runs the scaled forward recursion over each whole text: its likelihood is exact.
* Counts of rarer words reach the texts by a join on the word, so the vocabulary may be of any
  size; frequent words, which would make that join uneven, never enter it.

Texts of a batch are processed in step, sorted by length, a row of the state matrix for each.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from throughline.llm.frames import append, arrow_map, lists, ship, slices, stage, texts

STATES, HEAD, TAIL, PASSES = 8, 16384, 4096, 5
#: Tokens of a run. Longer head words than this many bytes are left to the tail.
RUN, LONGEST = 512, 64
#: Weight, in tokens, of the corpus's class shares in each state's emissions, and of even transitions.
PRIOR, EVEN = 50.0, 1.0
CHUNKS = 16


def words(text: str) -> list[bytes]:
    """Runs of bytes other than the ASCII white space 20, 09-0D; A-Z in lower case."""
    return text.encode().lower().split()


def tail_class(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % TAIL


@dataclass
class Lexicon:
    """What counting gives: of bounded size whatever the corpus."""

    head: dict[bytes, int]      # word: its class, from 1; class 0 is the end of a text
    counts: np.ndarray          # training tokens of each class
    types: np.ndarray           # training types of each class
    tokens: int                 # N
    vocabulary: int             # V

    @property
    def classes(self) -> int:
        return len(self.counts)


def count_words(train: DataFrame, text: str = "text") -> DataFrame:
    """(word, cls, n): how often each word occurs in all of `train`, and its tail class."""
    def start():
        def step(part: pa.RecordBatch):
            seen: Counter = Counter()
            for t in texts(part, text):
                seen.update(words(t))
            yield pa.RecordBatch.from_arrays([
                pa.array(seen.keys(), pa.binary()), pa.array(map(tail_class, seen), pa.int32()),
                pa.array(seen.values(), pa.int64())], names=["word", "cls", "n"])
        return step

    rows = arrow_map(train.select(text), "word binary, cls int, n long", start)
    return rows.groupBy("word", "cls").agg(F.sum("n").alias("n"))


def lexicon(counts: DataFrame, n_texts: int) -> Lexicon:
    top = (counts.filter(F.length("word") <= LONGEST).orderBy(F.desc("n"), "word").limit(HEAD).collect())
    by_class = counts.groupBy("cls").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect()
    tokens, types = np.zeros(1 + len(top) + TAIL), np.zeros(1 + len(top) + TAIL)
    tokens[0], types[0] = n_texts, n_texts > 0
    for r in by_class:
        tokens[1 + len(top) + r.cls], types[1 + len(top) + r.cls] = r.n, r.v
    for i, r in enumerate(top):
        tokens[1 + i], types[1 + i] = r.n, 1
        tokens[1 + len(top) + r.cls] -= r.n
        types[1 + len(top) + r.cls] -= 1
    return Lexicon({bytes(r.word): 1 + i for i, r in enumerate(top)}, tokens, types, int(tokens.sum()), int(types.sum()))


def classify(df: DataFrame, lex: Lexicon, text: str) -> DataFrame:
    """Adds seq (classes of the tokens, the end included), tail (rarer words) and times, and the sums that
    need no join: known and log_head (of log10(c+1)) over frequent words and the end, log_class (of
    -log10(N+V+1) in the class) over rarer words."""
    ship(df.sparkSession)
    sent = df.sparkSession.sparkContext.broadcast(lex)

    def start():
        lex = sent.value
        head, first = lex.head, 1 + len(lex.head)
        log_count = np.log10(lex.counts[:first] + 1)
        log_class = -np.log10(lex.counts[first:] + lex.types[first:] + 1)

        def step(part: pa.RecordBatch) -> list[pa.Array]:
            seqs, tails, times, known, log_head, log_tail = [], [], [], [], [], []
            for t in texts(part, text):
                tokens = words(t)
                seq = np.zeros(len(tokens) + 1, np.int32)       # class 0: a rarer word so far, and the end
                seq[:-1] = np.fromiter(map(head.get, tokens, repeat(0)), np.int32, len(tokens))
                at = np.flatnonzero(seq[:-1] == 0)
                others = [tokens[i] for i in at.tolist()]
                seq[at] = np.fromiter(map(tail_class, others), np.int32, len(at)) + np.int32(first)
                rare, common = Counter(others), seq[seq < first]
                seqs.append(seq)
                tails.append(list(rare))
                times.append(list(rare.values()))
                known.append(int((lex.counts[common] > 0).sum()))
                log_head.append(float(log_count[common].sum()))
                log_tail.append(float(log_class[seq[seq >= first] - first].sum()))
            return [lists(np.concatenate(seqs), map(len, seqs), pa.int32()), pa.array(tails, pa.list_(pa.binary())),
                    pa.array(times, pa.list_(pa.int32())), pa.array(known, pa.int64()), pa.array(log_head), pa.array(log_tail)]
        return step

    new = "seq array<int>, tail array<binary>, times array<int>, known long, log_head double, log_class double"
    return append(df, new, start)


class Steps:
    """Sequences of a batch, laid out step by step; row i of step t belongs to the i-th longest."""

    def __init__(self, seqs: list[np.ndarray]):
        self.order = sorted(range(len(seqs)), key=lambda i: -len(seqs[i]))
        sizes = np.array([len(seqs[i]) for i in self.order])
        flat = np.concatenate([seqs[i] for i in self.order])
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        self.active = np.searchsorted(-sizes, -np.arange(sizes[0]), side="left")
        self.at = np.concatenate([[0], np.cumsum(self.active)])
        self.cls = np.concatenate([flat[starts[:n] + t] for t, n in enumerate(self.active)])

    def forward(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray, keep: bool):
        """Log10 likelihood of each sequence in `order`, or with `keep` the scaled forward rows and the scales.

        `start` is one distribution, or a row for each sequence in `order`. With `keep`, the likelihoods are left out.
        """
        logs, ones = np.zeros(len(self.order)), np.ones(len(move))
        rows = np.empty((len(self.cls), len(move)), np.float32) if keep else None
        scales = np.empty(len(self.cls), np.float32) if keep else None
        now = np.broadcast_to(start, (len(self.order), len(move)))
        for t, n in enumerate(self.active):
            a, z = self.at[t], self.at[t + 1]
            now = (now[:n] @ move if t else now[:n]) * emit.take(self.cls[a:z], axis=0)
            scale = now @ ones      # faster than a sum over so few columns
            now /= scale[:, None]
            if keep:
                rows[a:z], scales[a:z] = now, scale
            else:
                logs[:n] += np.log10(scale)
        return logs, rows, scales


@dataclass
class Model:
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray            # class by state

    @classmethod
    def first(cls, lex: Lexicon) -> Model:
        """Sticky states whose emissions are the corpus's, tilted by fixed draws."""
        share = (lex.counts + 1) / (lex.counts + 1).sum()
        tilt = np.random.default_rng(42).gamma(2.0, 0.5, (lex.classes, STATES)) + 0.1
        emit = share[:, None] * tilt
        move = np.full((STATES, STATES), 0.1 / max(1, STATES - 1))
        np.fill_diagonal(move, 0.9)
        return cls(np.full(STATES, 1 / STATES), move, emit / emit.sum(0))

    @classmethod
    def next(cls, flat: np.ndarray, lex: Lexicon) -> Model:
        k = STATES
        start, move, emit = flat[:k] + EVEN, flat[k:k + k * k].reshape(k, k) + EVEN, flat[k + k * k:].reshape(-1, k)
        share = (lex.counts + 1) / (lex.counts + 1).sum()
        emit = emit + PRIOR * share[:, None]
        return cls(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))

    def bounds(self, runs: list[np.ndarray], first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each run of a text: the forward row before it, the distribution it is entered with, and how
        likely, up to a factor, the rest of the text is after each of its last states."""
        k, n = len(self.start), len(runs)
        before, enter, after = np.zeros((n, k)), np.tile(self.start, (n, 1)), np.ones((n, k))
        last = np.append(first[1:], True)
        cut = np.flatnonzero(~(first & last))
        if not len(cut):
            return before, enter, after
        steps = Steps([runs[i] for i in cut])
        now = np.where(first[cut][steps.order][:, None, None], np.eye(k), self.move)
        for t, m in enumerate(steps.active):
            if t:
                now[:m] = (now[:m].reshape(-1, k) @ self.move).reshape(m, k, k)
            now[:m] *= self.emit[steps.cls[steps.at[t]:steps.at[t + 1]]][:, None, :]
            if t % 16 == 15:        # far from what a double can't hold
                now[:m] /= now[:m].sum((1, 2), keepdims=True)
        now /= now.sum((1, 2), keepdims=True)
        through = np.empty_like(now)
        through[steps.order] = now
        for i, move in zip(cut, through, strict=True):
            if not first[i]:
                before[i], enter[i] = row, row @ self.move
            row = (self.start if first[i] else row) @ move
            row = row / row.sum()
        for i, move in zip(cut[::-1], through[::-1], strict=True):
            after[i] = 1 / k if last[i] else rest
            rest = move @ after[i]
            rest = rest / rest.sum()
        return before, enter, after

    def expect(self, seqs: list[np.ndarray], run: int = RUN) -> np.ndarray:
        """Expected counts (starts, transitions, emissions) of the sequences, as one flat array."""
        runs = [s[i:i + run] for s in seqs for i in range(0, len(s), run)]
        first = np.array([i == 0 for s in seqs for i in range(0, len(s), run)])
        k, steps = len(self.start), Steps(runs)
        before, enter, after = (x[steps.order] for x in self.bounds(runs, first))
        _, rows, scales = steps.forward(enter, self.move, self.emit, keep=True)
        moves = np.zeros((k, k))
        for t in range(len(steps.active) - 1, -1, -1):
            a, z, n = steps.at[t], steps.at[t + 1], steps.active[t]
            going = steps.active[t + 1] if t + 1 < len(steps.active) else 0
            later = np.empty((n, k), np.float32)
            if going:
                ahead = self.emit.take(steps.cls[z:z + going], axis=0)
                ahead *= back
                ahead /= scales[z:z + going, None]
                moves += rows[a:a + going].T @ ahead
                later[:going] = ahead @ self.move.T
            if going < n:
                later[going:] = after[going:n] / (rows[a + going:z] * after[going:n]).sum(1, keepdims=True)
            back = later
            rows[a:z] *= back
        opening = first[steps.order]
        if not opening.all():
            n = steps.at[1]
            moves += before.T @ (self.emit[steps.cls[:n]] * back / scales[:n, None])
        emits = np.empty((len(self.emit), k))
        for s in range(k):
            emits[:, s] = np.bincount(steps.cls, rows[:, s], len(self.emit))
        return np.concatenate([rows[:steps.at[1]][opening].sum(0, dtype=float), (moves * self.move).ravel(), emits.ravel()])


def _sequences(part: pa.RecordBatch) -> list[np.ndarray]:
    column = part.column("seq")
    flat, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return [flat[a:z] for a, z in zip(ends[:-1], ends[1:], strict=True)]


def baum_welch(train: DataFrame, lex: Lexicon, passes: int = PASSES) -> Model:
    """Train on the class sequences `seq` of all rows. One Spark job a pass."""
    spark, model = train.sparkSession, Model.first(lex)
    ship(spark)

    for _ in range(passes):
        sent = spark.sparkContext.broadcast(model)

        def expected(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                for part in slices(batch):
                    if seqs := _sequences(part):
                        counts = sent.value.expect(seqs)
                        total = counts if total is None else total + counts
            if total is not None:
                yield pa.RecordBatch.from_arrays([
                    pa.array(range(CHUNKS), pa.int32()),
                    pa.array([c.tobytes() for c in np.array_split(total, CHUNKS)], pa.binary())], names=["chunk", "sums"])

        def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[int, np.ndarray] = {}
            for batch in batches:
                for chunk, sums in zip(batch.column("chunk").to_pylist(), batch.column("sums").to_pylist(), strict=True):
                    total[chunk] = total.get(chunk, 0) + np.frombuffer(sums)
            yield pa.RecordBatch.from_arrays([
                pa.array(total.keys(), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], names=["chunk", "sums"])

        schema = "chunk int, sums binary"
        rows = (train.select("seq").mapInArrow(expected, schema).repartition(CHUNKS, "chunk")
                .mapInArrow(summed, schema).collect())
        if not rows:
            break
        model = Model.next(np.concatenate([np.frombuffer(r.sums) for r in sorted(rows, key=lambda r: r.chunk)]), lex)
    return model


def score_sequences(df: DataFrame, model: Model, out: str) -> DataFrame:
    """Adds the exact log10 likelihood of each whole class sequence."""
    sent = df.sparkSession.sparkContext.broadcast(model)

    def start():
        model = sent.value

        def step(part: pa.RecordBatch) -> list[pa.Array]:
            steps, logs = Steps(_sequences(part)), np.empty(part.num_rows)
            logs[steps.order] = steps.forward(model.start, model.move, model.emit, keep=False)[0]
            return [pa.array(logs)]
        return step

    return append(df, f"`{out}` double", start)


def score(df: DataFrame, train: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Learn from the rows where `train` holds and score all rows: (doc_id, held_out, n_tokens,
    n_known, train_tokens, base_score, score), logarithms to base 10.

    A null text counts as empty and has the end token alone. Repeated rows are scored (and
    learnt from) once each; ids may repeat or be null. With nothing to learn from, the base is
    (0+1)/(0+1) for each token and the model stays at its first, even draw. Other columns are
    not read, whatever their names.
    """
    rows = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), (~F.coalesce(train, F.lit(False))).alias("held_out"))
    learn = rows.filter(~F.col("held_out"))
    counts = stage(count_words(learn), "lm-counts")
    lex = lexicon(counts, learn.count())
    seen = classify(rows, lex, "text").drop("text").withColumn("row", F.monotonically_increasing_id())
    seen = stage(seen, "lm-classes")
    model = baum_welch(seen.filter(~F.col("held_out")), lex)
    scored = score_sequences(seen.select("row", "doc_id", "held_out", "known", "log_head", "log_class", "seq"), model, "hmm") \
        .withColumn("n_tokens", F.size("seq").cast("long")).drop("seq")

    tail = seen.select("row", F.inline(F.arrays_zip(F.col("tail").alias("word"), "times")))
    summed = (tail.join(counts.select("word", "n"), "word", "inner").groupBy("row")
              .agg(F.sum("times").alias("known_tail"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("log_tail")))
    both = scored.join(summed, "row", "left").na.fill(0, ["known_tail", "log_tail"])
    log_count = F.col("log_head") + F.col("log_tail")
    base = math.log10(lex.tokens + lex.vocabulary + 1)
    return both.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.col("known_tail")).cast("long").alias("n_known"),
        F.lit(lex.tokens).cast("long").alias("train_tokens"),
        (log_count - F.col("n_tokens") * base).alias("base_score"),
        (F.col("hmm") + F.col("log_tail") + F.col("log_class")).alias("score"))
