"""Language identification by sparse multinomial logistic regression on TF-IDF character n-grams.

Texts are lower-cased, every run of characters that are no letters becomes one space, and the
n-grams of 1 to 3 characters are hashed to `DIMS` features. Document frequencies cover all
labelled rows. The classifier is fitted on a bounded sample of them: at most `SAMPLE` rows in
expectation, drawn by a hash of the id with an equal share for every language, each with its
whole text. It is trained by follow-the-regularised-leader with L1 and L2 penalties in one task,
and a part of the sample that training leaves out sets the temperature of its probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from throughline.llm.frames import append, arrow_map, ship, texts

DIMS, SAMPLE, EPOCHS = 1 << 15, 4000, 3
#: The regulariser's step size, its offset, and the two penalties.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.02
#: Of the sample, this share sets the temperature.
CALIBRATE = 0.2
UNKNOWN = "und"

_FOLD: list[np.ndarray] = []


def _fold() -> np.ndarray:
    """For each code point its lower case if it is a letter or a mark of one, else a space."""
    if not _FOLD:
        table = np.full(0x110000, 32, np.uint32)
        for cp in range(0x110000):
            c = chr(cp)
            if c.isalpha():
                table[cp] = ord(c.lower()[0])
        _FOLD.append(table)
    return _FOLD[0]


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(feature, count) of the n-grams of a text; nothing if it has no letter."""
    cps = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    folded = _fold()[cps]
    letters = folded != 32
    if not letters.any():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    folded = folded[letters | np.concatenate([[True], letters[:-1]])]
    one = np.concatenate([[32], folded, [32]]).astype(np.uint32)
    grams = [one * np.uint32(2654435761)]
    two = one[:-1] * np.uint32(40503) + one[1:] * np.uint32(2246822519)
    grams.append(two ^ (two >> np.uint32(13)))
    three = (two[:-1] ^ np.uint32(0x9E3779B9)) * np.uint32(668265263) + one[2:] * np.uint32(374761393)
    grams.append(three ^ (three >> np.uint32(15)))
    hashed = np.concatenate(grams)
    slots = ((hashed * np.uint32(2654435769)) >> np.uint32(32 - 15)).astype(np.int64)
    counts = np.bincount(slots, minlength=DIMS)
    at = np.flatnonzero(counts)
    return at, counts[at]


def weighted(at: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF with damped counts, of length one."""
    v = (1 + np.log(counts)) * idf[at]
    norm = np.sqrt(v @ v)
    return v / norm if norm > 0 else v


def document_frequencies(train: DataFrame, text: str) -> tuple[np.ndarray, int]:
    """In how many of all rows each feature occurs, and the number of rows. The result has DIMS entries."""
    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros(DIMS, np.int64), 0
        for batch in batches:
            for t in texts(batch, text):
                seen[features(t)[0]] += 1
                n += 1
        if n:
            at = np.flatnonzero(seen)
            yield pa.RecordBatch.from_arrays([pa.array([*at, -1], pa.int32()), pa.array([*seen[at], n], pa.int64())], names=["slot", "n"])

    ship(train.sparkSession)
    rows = train.select(text).mapInArrow(frequencies, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect()
    out, n = np.zeros(DIMS, np.int64), 0
    for r in rows:
        if r.slot < 0:
            n = r.n
        else:
            out[r.slot] = r.n
    return out, n


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def follow_the_leader(rows: list[tuple[np.ndarray, np.ndarray, int]], n_classes: int, epochs: int = EPOCHS) -> np.ndarray:
    """FTRL-proximal weights, class by feature with the bias last: zero until the gradient's sum exceeds L1."""
    z, n = np.zeros((n_classes, DIMS + 1)), np.zeros((n_classes, DIMS + 1))

    def weights(zi: np.ndarray, ni: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zi) <= L1, 0.0, (np.sign(zi) * L1 - zi) / ((BETA + np.sqrt(ni)) / ALPHA + L2))

    for _ in range(epochs):
        for at, value, label in rows:
            at, value = np.append(at, DIMS), np.append(value, 1.0)
            zi, ni = z[:, at], n[:, at]
            w = weights(zi, ni)
            error = softmax(w @ value)
            error[label] -= 1
            g = error[:, None] * value
            more = ni + g * g
            z[:, at] = zi + g - (np.sqrt(more) - np.sqrt(ni)) / ALPHA * w
            n[:, at] = more
    return weights(z, n)


def logits(w: np.ndarray, at: np.ndarray, value: np.ndarray) -> np.ndarray:
    return w[:, at] @ value + w[:, -1]


def temperature(scores: np.ndarray, labels: np.ndarray) -> float:
    """The divisor of the logits with the least log loss, from a fixed grid."""
    if not len(labels):
        return 1.0
    grid = np.geomspace(0.1, 10.0, 80)
    loss = [-np.log(softmax(scores / t)[np.arange(len(labels)), labels] + 1e-300).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])


def fit(train: DataFrame, text: str, label: str, key: str) -> dict | None:
    """The model, or None if no row has a label. Of the data the driver sees counts by language and by
    feature, and the weights."""
    spark = train.sparkSession
    sizes = sorted((r.label, r["count"]) for r in train.groupBy(F.col(label).alias("label")).count().collect())
    if not sizes:
        return None
    df, n = document_frequencies(train, text)
    idf = np.log((1 + n) / (1 + df)) + 1
    classes = [c for c, _ in sizes]
    share = F.element_at(F.create_map(*[F.lit(x) for c, k in sizes for x in (c, min(1.0, SAMPLE / len(sizes) / k))]), F.col(label))
    draw = F.pmod(F.xxhash64(F.lit("langid"), F.col(key)), F.lit(1 << 30)) / float(1 << 30)
    sample = train.filter(draw < share).select(F.col(text).alias("text"), F.col(label).alias("label"), draw.alias("draw"))

    def start():
        def step(part: pa.RecordBatch):
            at, counts = zip(*(features(t) for t in texts(part, "text")), strict=True)
            yield pa.RecordBatch.from_arrays([
                part.column("label"), part.column("draw"), pa.array(at, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32()))],
                names=["label", "draw", "at", "counts"])
        return step

    def train_one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            for label, at, counts in zip(*(batch.column(c).to_pylist() for c in ("label", "at", "counts")), strict=True):
                at = np.array(at, np.int64)
                rows.append((at, weighted(at, np.array(counts, np.int64), idf), classes.index(label)))
        if rows:
            every = round(1 / CALIBRATE)
            learn = [r for i, r in enumerate(rows) if i % every or len(rows) < 2 * every]
            check = [r for i, r in enumerate(rows) if i % every == 0 and len(rows) >= 2 * every]
            w = follow_the_leader(learn, len(classes))
            t = temperature(np.array([logits(w, a, v) for a, v, _ in check]), np.array([c for *_, c in check], int))
            yield pa.RecordBatch.from_arrays([pa.array([w.tobytes()], pa.binary()), pa.array([t])], names=["w", "t"])

    ship(spark)
    got = (arrow_map(sample, "label string, draw double, at array<int>, counts array<int>", start)
           .repartition(1).sortWithinPartitions("draw", "label").mapInArrow(train_one, "w binary, t double").collect())
    if not got:
        return None
    return {"classes": classes, "idf": idf, "w": np.frombuffer(got[0].w).reshape(len(classes), DIMS + 1), "t": got[0].t}


def predict(df: DataFrame, model: dict | None, text: str = "text", pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """Adds the most probable language of each whole text and its calibrated probability.

    `und` and 0 for a text that is null or has no letter, and for all texts without a model.
    Ties go to the first language in alphabetical order. Columns with the new names are replaced.
    """
    ship(df.sparkSession)
    sent = df.sparkSession.sparkContext.broadcast(model)

    def start():
        m = sent.value

        def step(part: pa.RecordBatch) -> list[pa.Array]:
            names, scores = [], []
            for t in texts(part, text):
                at, counts = features(t) if m else ((), ())
                if not len(at):
                    names.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                p = softmax(logits(m["w"], at, weighted(at, counts, m["idf"])) / m["t"])
                names.append(m["classes"][int(p.argmax())])
                scores.append(float(p.max()))
            return [pa.array(names, pa.string()), pa.array(scores, pa.float64())]
        return step

    return append(df, f"`{pred}` string, `{score}` double", start)


def identify(df: DataFrame, train: Column, text: str = "text", label: str = "lang", key: str = "doc_id") -> DataFrame:
    """`df` with lang_pred and score, learnt from the rows where `train` holds and text and label are set."""
    learn = df.filter(train & F.col(text).isNotNull() & F.col(label).isNotNull())
    return predict(df, fit(learn, text, label, key), text)
