"""Quality classifier: Naive Bayes support vectors.

A text's features are indicators of its n-grams: trigrams of bytes, and one to three words in a row by their shape
(capitals, digits, signs, length, whether a word repeats the one before), hashed into 2^18 places.  Each indicator
is scaled by the log of the ratio of its smoothed counts in the two classes, texts are scaled to unit length, and a
linear model with hinge loss is fitted by dual coordinate descent, classes weighted to balance.  A logistic curve
fitted to the margins turns them into scores.

The model is fitted on a bounded sample of the labelled rows, at most about ``MOST_ROWS`` of each class, in one task.
Everything else is by partition; scoring shuffles nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gristmill.llm.shingles import mix, text_chunks, word_hashes
from gristmill.session import ship

PLACES = 1 << 18
#: Labelled rows of each class that the fit uses at most, about: rows are taken by a hash of their id.
MOST_ROWS = 3000
SMOOTHING, COST, EPOCHS = 1.0, 1.0, 12
THRESHOLD = 0.3
_HALF = np.uint64(PLACES // 2 - 1)


def _counts(mask: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])


def features(data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """The distinct places of each text's n-grams."""
    n = len(data)
    b = data.astype(np.uint64)
    tri = mix((b[:-2] << np.uint64(16)) | (b[1:-1] << np.uint64(8)) | b[2:]) & _HALF if n > 2 else np.empty(0, np.uint64)
    words, first, starts, ends = word_hashes(data, offsets)
    upper = (data >= 65) & (data <= 90)
    upper[1:] |= (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[:-1] == 0xC3)
    digit = (data >= 48) & (data <= 57)
    lower = ((data >= 97) & (data <= 122)) | (data >= 0x80)
    sign = ~(upper | digit | lower)

    def within(mask: np.ndarray) -> np.ndarray:
        c = _counts(mask)
        return c[ends] - c[starts]

    size, ups, nums, signs = ends - starts, within(upper), within(digit), within(sign)
    shape = np.minimum(3, size // 4) | (np.minimum(ups, 2) << 2) | ((nums > 0) << 4) | (np.minimum(signs, 3) << 5) | ((signs == size) << 7)
    inner = np.ones(len(words), bool)
    inner[first[:-1][first[:-1] < len(words)]] = False
    same = np.zeros(len(words), np.int64)
    same[1:] = (words[1:] == words[:-1]) & inner[1:]
    shape = (shape | (same << 8)).astype(np.uint64) + np.uint64(1)
    two, three = shape.copy(), shape.copy()
    two[1:] = np.where(inner[1:], (shape[:-1] << np.uint64(10)) | shape[1:], shape[1:])
    three[2:] = np.where(inner[2:] & inner[1:-1], (shape[:-2] << np.uint64(20)) | (shape[1:-1] << np.uint64(10)) | shape[2:], shape[2:])
    grams = [(mix(g + np.uint64(7)) & _HALF) + _HALF + np.uint64(1) for g in (shape, two, three)]
    stamp = np.empty(PLACES, np.int64)
    for k in range(len(offsets) - 1):
        at, end = int(offsets[k]), int(offsets[k + 1])
        w, v = int(first[k]), int(first[k + 1])
        found = np.concatenate([tri[at : max(at, end - 2)], *(g[w:v] for g in grams)]).astype(np.int64)
        order = np.arange(len(found))
        stamp[found] = order
        yield found[stamp[found] == order]


def fit(rows: list[np.ndarray], labels: np.ndarray, smoothing: float = SMOOTHING, cost: float = COST, epochs: int = EPOCHS, seed: int = 5) -> np.ndarray:
    """Weights: for each place the squared log-count ratio and the weight, then bias, slope and offset of the curve."""
    ratio, weight = np.zeros(PLACES), np.zeros(PLACES)
    bias, slope, shift = 0.0, 0.0, 0.0
    y = np.where(labels > 0, 1.0, -1.0)
    if (y > 0).any() and (y < 0).any():
        counts = {s: np.full(PLACES, smoothing) for s in (1.0, -1.0)}
        for x, s in zip(rows, y, strict=True):
            counts[s][x] += 1
        ratio = np.log(counts[1.0] / counts[1.0].sum()) - np.log(counts[-1.0] / counts[-1.0].sum())
        ratio -= np.median(ratio[(counts[1.0] + counts[-1.0]) > 2 * smoothing])
        scaled = [ratio[x] / max(1e-12, np.sqrt((ratio[x] ** 2).sum())) for x in rows]
        limit = {s: cost * len(y) / (2 * (y == s).sum()) for s in (1.0, -1.0)}
        dual = np.zeros(len(y))
        rng = np.random.default_rng(seed)
        for _ in range(epochs):
            for i in rng.permutation(len(y)):
                x, v, s = rows[i], scaled[i], y[i]
                if not len(x):
                    continue
                gradient = s * (weight[x] @ v + bias) - 1
                new = min(max(dual[i] - gradient / 2, 0.0), limit[s])  # unit length and the bias: the diagonal is 2
                step, dual[i] = (new - dual[i]) * s, new
                weight[x] += step * v
                bias += step
        margin = np.array([weight[x] @ v + bias for x, v in zip(rows, scaled, strict=True)])
        weight *= ratio
        # logistic curve through the margins, by Newton's method, with a little shrinkage
        target, design, beta = (y > 0).astype(float), np.stack([margin, np.ones_like(margin)], 1), np.array([2.0, 0.0])
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
            hessian = design.T @ (design * (p * (1 - p))[:, None]) + np.diag([0.1, 0.01])
            beta -= np.linalg.solve(hessian, design.T @ (p - target) + np.array([0.1 * (beta[0] - 2), 0.01 * beta[1]]))
        slope, shift = beta
    return np.concatenate([ratio**2, weight, [bias, slope, shift]]).astype(np.float32)


def score(places: np.ndarray, model: np.ndarray) -> float:
    """0 to 1, higher: the label 1 is likelier.  A text without n-grams has the score of the bias alone."""
    bias, slope, shift = model[-3:]
    length = np.sqrt(model[:PLACES][places].sum(dtype=np.float64))
    margin = bias + (model[PLACES : 2 * PLACES][places].sum(dtype=np.float64) / length if length else 0.0)
    return float(1 / (1 + np.exp(-np.clip(slope * margin + shift, -30, 30))))


def held_out(name: str = "doc_id"):
    """Whether crc32 of the id as text leaves 0 modulo 5; a null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(name).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", most_rows: int = MOST_ROWS) -> np.ndarray:
    """Fit on labelled rows that aren't held out: about ``most_rows`` ids of each class, and twice that many rows at most.

    Equal rows of one id count once.  Texts are looked at whole.
    """
    spark = docs.sparkSession
    ship(spark)
    usable = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max(label).alias("label"))
    sizes = {r["label"]: r["count"] for r in usable.groupBy("label").count().collect()}
    share = F.lit(0.0)
    for value, n in sizes.items():
        share = F.when(F.col("label") == value, min(1.0, most_rows / n)).otherwise(share)
    some = usable.filter(F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(1 << 30)) < share * (1 << 30))
    # about 2 * most_rows ids are broadcast
    texts = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").select("label", F.xxhash64("doc_id", "text").alias("key"), "text")

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, end, data, offsets in text_chunks(batch.column("text")):
                lists = [x.astype(np.int32) for x in features(data, offsets)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(at, end - at) for c in ("label", "key")), pa.array(lists, pa.list_(pa.int32()))], names=["label", "key", "places"])

    def model(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("key", kind="stable")  # rows arrive in any order
        rows = [np.asarray(x) for x in frame["places"]]
        return pd.DataFrame({"model": [fit(rows, frame["label"].to_numpy()).tobytes()]})

    schema = T.StructType().add("label", some.schema["label"].dataType).add("key", "long").add("places", T.ArrayType(T.IntegerType()))
    # rows of one id may be many: those of least hash are kept
    bounded = texts.mapInArrow(grams, schema).dropDuplicates(["key"]).orderBy("key").limit(2 * most_rows)
    found = bounded.groupBy().applyInPandas(model, "model binary").collect()
    return np.frombuffer(found[0]["model"], np.float32) if found else fit([], np.empty(0))


def classify(docs: DataFrame, model: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score and predicted (score >= threshold) of each row of ``docs``; only texts are looked at.

    Null texts count as empty; they and empty texts have the score of the bias.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = shared.value
        for batch in batches:
            for at, end, data, offsets in text_chunks(batch.column("text")):
                scores = np.array([score(x, weights) for x in features(data, offsets)])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, end - at), pa.array(scores, pa.float64()), pa.array((scores >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return docs.select("doc_id", "text").mapInArrow(run, T.StructType([docs.schema["doc_id"]]).add("score", "double").add("predicted", "integer"))


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every document, by a model of the rows that aren't held out.

    Without labels of both classes every score is 0.5.  Null and empty texts are scored like others, whole texts are
    read however long, rows of equal or null id are rows of their own.  Labels without a document, repeated labels (the higher one
    counts) and null labels are no error.
    """
    return classify(docs, train(docs, labels)).select("doc_id", held_out().alias("held_out"), "score", "predicted")
