"""Quality classifier: a linear support vector machine on naive-Bayes-scaled n-gram indicators.

Wang and Manning (2012): every n-gram indicator is scaled by the log ratio of
its smoothed frequencies in the two classes; Hsieh et al. (2008): the hinge
loss is minimised by dual coordinate descent. Features are hashed byte 4-grams
of the whole text and 4-grams over the relation "equals the word before".

A model is fitted on a bounded number of labelled rows (`max_rows`). They are
dealt over shards; every shard runs dual coordinate descent on its rows and the
weights are averaged. A part of the sample is kept out of the fit and turns
margins into probabilities.
"""

import operator
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickwatch.llm.common import remainder, texts
from tickwatch.session import ship_package, stage

BITS = 18
DIM = 1 << BITS
MAX_ROWS = 20_000
SHARDS = 8
THRESHOLD = 0.3
_EQUAL = [bytes(f"{i:04b}", "ascii").translate(bytes.maketrans(b"01", b"\0\1")) for i in range(16)]


def features(text: str | None) -> np.ndarray:
    """The sorted distinct feature numbers of a text; the last one is the bias."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    found = [DIM - 1]
    words = raw.split()
    equal = bytes(map(operator.eq, words[1:], words))
    found += [DIM - 2 - i for i, gram in enumerate(_EQUAL) if gram in equal]
    if len(raw) < 4:
        return np.array(sorted(found), dtype=np.int32)
    b = np.frombuffer(raw, dtype=np.uint8).astype(np.uint32)
    grams = b[:-3] | b[1:-2] << 8 | b[2:-1] << 16 | b[3:] << 24
    slots = np.unique((grams * np.uint32(2654435761)) >> np.uint32(32 - BITS))
    return np.union1d(slots[slots < DIM - 17], found).astype(np.int32)


def descend(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, cost: float = 1.0,
            epochs: int = 12, seed: int = 7) -> np.ndarray:
    """Weights of min |w|^2/2 + cost * sum of hinge losses, by dual coordinate descent."""
    w, alpha = np.zeros(len(ratio)), np.zeros(len(rows))
    scaled = [ratio[i] for i in rows]
    norm = np.array([float(x @ x) for x in scaled])
    random = np.random.default_rng(seed)
    for _ in range(epochs):
        largest = 0.0
        for k in random.permutation(len(rows)):
            if norm[k] == 0:
                continue
            slope = y[k] * float(w[rows[k]] @ scaled[k]) - 1.0
            new = min(max(alpha[k] - slope / norm[k], 0.0), cost)
            step = new - alpha[k]
            if step:
                w[rows[k]] += step * y[k] * scaled[k]
                alpha[k] = new
                largest = max(largest, abs(step) * norm[k])
        if largest < 1e-3:
            break
    return w


def platt(margin: np.ndarray, y01: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve through held-back margins (Newton, softened targets)."""
    pos, neg = float(y01.sum()), float(len(y01) - y01.sum())
    target = np.where(y01 > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    scale = float(np.std(margin)) or 1.0
    x, a, b = margin / scale, 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g = np.array([((p - target) * x).sum() + 1e-3 * a, (p - target).sum()])
        v = p * (1 - p) + 1e-9
        h = np.array([[(v * x * x).sum() + 1e-3, (v * x).sum()], [(v * x).sum(), v.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        size = max(1.0, float(np.abs(step).max()))
        a, b = a - step[0] / size, b - step[1] / size
        if np.abs(step).max() < 1e-6:
            break
    return max(a, 1e-3) / scale, b


@dataclass
class QualityModel:
    """weights: per feature, ratio included, or None if the labels had fewer than two classes."""

    weights: np.ndarray | None
    slope: float
    offset: float

    def scores(self, batch: pd.Series) -> pd.Series:
        if self.weights is None:
            return pd.Series(np.full(len(batch), self.offset))
        margin = np.array([float(self.weights[features(t)].sum()) for t in batch])
        return pd.Series(1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -30, 30))))


def _counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    count = np.zeros((2, DIM), dtype=np.int64)
    for pdf in batches:
        for label, x in zip(pdf["label"], pdf["x"]):
            count[int(label), x] += 1
    slot = np.flatnonzero(count.sum(axis=0))
    yield pd.DataFrame({"slot": slot.astype(np.int32), "neg": count[0, slot], "pos": count[1, slot]})


def labelled(docs: DataFrame, labels: DataFrame, label_col: str, max_rows: int) -> DataFrame:
    """doc_id, label, text of about `max_rows` labelled rows whose crc32 remainder by 5 is not 0.

    The sample is drawn by a hash of the id, so it does not depend on the order
    of rows. Several labels of an id are averaged; null ids and labels are left out.
    """
    ids = (labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels[label_col].cast("double").alias("y"))
           .filter(F.col("doc_id").isNotNull() & F.col("y").isNotNull() & (remainder("doc_id", 5) != 0))
           .groupBy("doc_id").agg((F.avg("y") >= 0.5).cast("int").alias("label")))
    share = min(1.0, max_rows / max(1, ids.count()))
    ids = ids.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.lit(int(share * (1 << 20))))
    # At most about max_rows rows of two numbers: safe to broadcast.
    return texts(docs).join(F.broadcast(ids), "doc_id")


def fit_quality(docs: DataFrame, labels: DataFrame, label_col: str = "quality", max_rows: int = MAX_ROWS,
                shards: int = SHARDS, mix: float = 0.25) -> QualityModel:
    """Fit on labelled rows outside the held-out fold (crc32 remainder by 5 is 0).

    No labelled rows: every score is 0.5. One class only: every score is 1 or 0.
    Repeated rows count as often as they occur; null texts count as empty.
    """
    spark = docs.sparkSession
    ship_package(spark)

    @F.pandas_udf("array<int>")
    def featurize(text: pd.Series) -> pd.Series:
        return text.map(features)

    rows = labelled(docs, labels, label_col, max_rows).select(
        "doc_id", "label", (F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(5)) == 0).alias("calibrate"),
        featurize("text").alias("x"))
    rows = stage(rows, "quality-sample")
    fit = rows.filter(~F.col("calibrate"))
    classes = {r["label"]: r["n"] for r in fit.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(classes) < 2:
        return QualityModel(None, 0.0, float(next(iter(classes), 0.5)))
    counts = (fit.select("label", "x").mapInPandas(_counts, "slot int, neg long, pos long")
              .groupBy("slot").agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos"))).toPandas()
    p, q = np.ones(DIM), np.ones(DIM)
    p[counts["slot"]] += counts["pos"]
    q[counts["slot"]] += counts["neg"]
    ratio = np.log((p / p.sum()) / (q / q.sum()))
    seen = np.zeros(DIM, dtype=bool)
    seen[counts["slot"]] = True
    ratio[~seen] = 0.0
    ratio[DIM - 1] = 1.0

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        x, y = [], []
        for pdf in batches:
            x += list(pdf["x"])
            y += list(pdf["label"])
        if x:
            w = descend(x, np.array(y) * 2.0 - 1.0, ratio)
            slot = np.flatnonzero(w)
            yield pd.DataFrame({"slot": slot.astype(np.int32), "w": w[slot], "shard": 1})

    # The labels are dealt evenly: a shard with one class only would learn nothing.
    dealt = fit.repartition(shards, F.xxhash64("doc_id", F.lit(5)))
    solved = dealt.select("label", "x").mapInPandas(solve, "slot int, w double, shard int")
    # One row per hashed feature: DIM rows at most.
    weights = solved.groupBy("slot").agg(F.sum("w").alias("w"), F.count("shard").alias("n")).toPandas()
    w = np.zeros(DIM)
    w[weights["slot"]] = weights["w"] / max(1, int(weights["n"].max()))
    w = ((1 - mix) * np.abs(w).mean() + mix * w) * ratio

    model = QualityModel(w, 1.0, 0.0)

    @F.pandas_udf("double")
    def margin(x: pd.Series) -> pd.Series:
        return pd.Series([float(w[i].sum()) for i in x])

    # A fifth of the bounded sample, two numbers a row.
    back = rows.filter("calibrate").select("label", margin("x").alias("m")).toPandas()
    if back["label"].nunique() == 2:
        model.slope, model.offset = platt(back["m"].to_numpy(), back["label"].to_numpy(float))
    return model


def score_column(model: QualityModel, text: Column) -> Column:
    """The probability of label 1 of a text column; defined for empty and null texts too."""

    @F.pandas_udf("double")
    def score(batch: pd.Series) -> pd.Series:
        return model.scores(batch)

    return score(text)


def score_quality(docs: DataFrame, model: QualityModel, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs; an empty table gives no rows."""
    ship_package(docs.sparkSession)
    scored = texts(docs).select("doc_id", score_column(model, F.col("text")).alias("score"))
    return scored.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))
