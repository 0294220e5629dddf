"""Severity of toxic language by cumulative-link ordinal regression.

P(grade > j) = sigmoid(w.x - c_j) with one weight vector w for all the ordered cut points c_j; x
marks which words, and which beginnings of words, a text holds. Weights are trained online with an L1 penalty, which leaves only
telling words: the model is a small table. Expected severity is the sum of P(grade > j).

The model is fitted in one task on a bounded sample: at most `SAMPLE` labelled rows in
expectation, drawn by a hash of the id, each with its whole text, and reduced to its different
words before it is sent. Prediction covers every row.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from throughline.llm.frames import append, arrow_map, ship, texts

SAMPLE, EPOCHS, RARE = 6000, 6, 3
#: Step size and penalties of the weights, step size of the cut points.
ALPHA, L1, L2, RATE = 1.0, 12.0, 0.01, 0.3

#: ASCII letters in lower case; other ASCII characters part words.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32 for c in range(256))


#: Beginnings of words, by bytes, that are features beside the words: they hold what inflected forms share.
STEMS = (4, 5, 6)


def words(text: str) -> set[bytes]:
    return set(text.lower().encode().translate(_FOLD).split())


def features(text: str) -> set[bytes]:
    """The different words of a text, and their beginnings, marked by a hyphen."""
    found = words(text)
    out = set(found)
    for n in STEMS:
        out.update([w[:n] + b"-" for w in found if len(w) >= n])
    return out


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def grade_probabilities(z: float, cuts: np.ndarray) -> np.ndarray:
    """P(grade > j) for each cut point."""
    return sigmoid(z - cuts)


def train(rows: list[tuple[list[int], int]], n_words: int, levels: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights, by follow-the-regularised-leader with an L1 penalty, and increasing cut points, by AdaGrad.

    The cut points are c_0 and positive gaps exp(g_j), so they stay ordered.
    """
    z, n = np.zeros(n_words), np.zeros(n_words)
    shape = np.array([1.0] + [0.0] * (levels - 2))
    shape_seen = np.full(levels - 1, 1e-6)

    def weights(zi: np.ndarray, ni: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zi) <= L1, 0.0, (np.sign(zi) * L1 - zi) / ((1 + np.sqrt(ni)) / ALPHA + L2))

    for _ in range(EPOCHS):
        for at, grade in rows:
            gaps = np.exp(shape[1:])
            cuts = shape[0] + np.concatenate([[0.0], np.cumsum(gaps)])
            zi, ni = z[at], n[at]
            w = weights(zi, ni)
            above = grade_probabilities(w.sum(), cuts)
            # P(grade) is a difference of neighbours in 1, above[0], ..., above[-1], 0
            high = 1.0 if grade == 0 else above[grade - 1]
            low = 0.0 if grade == levels - 1 else above[grade]
            p = max(high - low, 1e-12)
            up = np.zeros(levels - 1)           # the log likelihood's derivative by each cut point
            if grade > 0:
                up[grade - 1] -= high * (1 - high) / p
            if grade < levels - 1:
                up[grade] += low * (1 - low) / p
            g = up.sum()                        # and the loss's by every word's weight
            more = ni + g * g
            z[at] = zi + g - (np.sqrt(more) - np.sqrt(ni)) / ALPHA * w
            n[at] = more
            d_shape = np.concatenate([[g], [up[j + 1:].sum() * gaps[j] for j in range(levels - 2)]])
            shape_seen += d_shape * d_shape
            shape += RATE / np.sqrt(shape_seen) * d_shape
    return weights(z, n), shape[0] + np.concatenate([[0.0], np.cumsum(np.exp(shape[1:]))])


def fit(labelled: DataFrame, text: str = "text", grade: str = "grade", key: str = "doc_id") -> dict | None:
    """The model of rows with a text and a grade (0, 1, ...), or None if only one grade occurs.

    Grades that don't occur are closed up. The driver sees the number of rows of each grade and
    the model.
    """
    rows = labelled.filter(F.col(text).isNotNull() & F.col(grade).isNotNull())
    sizes = sorted((r.grade, r["count"]) for r in rows.groupBy(F.col(grade).cast("int").alias("grade")).count().collect())
    if len(sizes) < 2:
        return None
    levels = [g for g, _ in sizes]
    draw = F.pmod(F.xxhash64(F.lit("toxicity"), F.col(key)), F.lit(1 << 30)) / float(1 << 30)
    share = min(1.0, SAMPLE / sum(n for _, n in sizes))
    sample = rows.filter(draw < share).select(F.col(text).alias("text"), F.col(grade).cast("int").alias("grade"), draw.alias("draw"))

    def start():
        def step(part: pa.RecordBatch):
            yield pa.RecordBatch.from_arrays([part.column("grade"), part.column("draw"), pa.array([sorted(features(t)) for t in texts(part, "text")], pa.list_(pa.binary()))],
                                             names=["grade", "draw", "words"])
        return step

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in zip(b.column("words").to_pylist(), b.column("grade").to_pylist(), strict=True)]
        counts = Counter(w for ws, _ in rows for w in ws)
        index = {w: i for i, w in enumerate(sorted(w for w, n in counts.items() if n >= RARE))}
        if rows:
            w, cuts = train([([index[x] for x in ws if x in index], levels.index(g)) for ws, g in rows], len(index), len(levels))
            told = [(x, w[i]) for x, i in index.items() if w[i] != 0]
            yield pa.RecordBatch.from_arrays([pa.array([[x for x, _ in told]], pa.list_(pa.binary())), pa.array([[v for _, v in told]], pa.list_(pa.float64())),
                                              pa.array([cuts.tolist()], pa.list_(pa.float64()))], names=["words", "weights", "cuts"])

    ship(labelled.sparkSession)
    got = (arrow_map(sample, "grade int, draw double, words array<binary>", start).repartition(1).sortWithinPartitions("draw", "grade")
           .mapInArrow(fitted, "words array<binary>, weights array<double>, cuts array<double>").collect())
    if not got:
        return None
    return {"levels": levels, "cuts": np.array(got[0].cuts), "weights": {bytes(x): v for x, v in zip(got[0].words, got[0].weights, strict=True)}}


def predict(df: DataFrame, model: dict | None, text: str = "text") -> DataFrame:
    """`df` with severity (the expected grade), p_toxic (of a grade above the least) and grade (the most probable).

    Without a model, or if the text is null or has no words, all three are those of the least
    grade. Columns with the new names are replaced.
    """
    ship(df.sparkSession)
    sent = df.sparkSession.sparkContext.broadcast(model)

    def start():
        m = sent.value
        base = m["levels"][0] if m else 0
        steps = np.diff(m["levels"]) if m else None
        telling = m["weights"].keys() if m else ()

        def step(part: pa.RecordBatch) -> list[pa.Array]:
            severity, toxic, grade = [], [], []
            for t in texts(part, text):
                found = features(t) if m else ()
                if not found:
                    severity.append(float(base))
                    toxic.append(0.0)
                    grade.append(base)
                    continue
                above = grade_probabilities(math.fsum(m["weights"][w] for w in found & telling), m["cuts"])
                severity.append(float(base + above @ steps))
                toxic.append(float(above[0]))
                grade.append(int(m["levels"][int(np.argmax(-np.diff([1.0, *above, 0.0])))]))
            return [pa.array(severity, pa.float64()), pa.array(toxic, pa.float64()), pa.array(grade, pa.int32())]
        return step

    return append(df, "severity double, p_toxic double, grade int", start)


def severity_grades(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Labelled documents with a grade: 0 not toxic, 1 toxic, 2 toxic and of low quality.

    A document with several labels has the gravest. Labels without a document, or without a
    value for toxic, don't count; a null quality counts as good.
    """
    graded = (labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id")
              .agg(F.max(F.when(F.col("toxic") == 0, 0).when(F.col("quality") == 0, 2).otherwise(1)).alias("grade")))
    return docs.select("doc_id", "text").join(graded, "doc_id")
