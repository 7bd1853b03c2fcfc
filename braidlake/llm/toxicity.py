"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier over hashed words and byte 5-grams is trained with numpy from confirmed toxic texts (P)
and unlabelled ones (U). With pi the class prior, the risk is COST pi R_P(+) + max(0, R_U(-) - pi R_P(-)): U's
loss as negatives, less what the positives in it add; where that falls below 0, which only overfitting
can cause, the step goes the other way along it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from braidlake.llm.common import release, schema_of, stage, table
from braidlake.llm.slots import counted
from braidlake.llm.words import LOWER, blocks, mix64, text_bytes, word_hashes

#: Confirmed texts, and unlabelled ones, both of labelled rows, that are fitted at most: those with the lowest hash of their id.
SAMPLE, UNLABELLED = 1500, 6000
#: What a toxic text that is missed costs, against 1 for a false alarm.
COST = 2.0
BITS = 20
#: Features that are kept, by how far they set P apart from U.
FEATURES = 1000
GRAM = 5


def hashed(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(feature of each word and each 5-gram of bytes, the text it is from), in lower case."""
    data = LOWER[data]
    words, bounds, _ = word_hashes(_letters(data), offsets)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(bounds))
    n = max(0, len(data) - GRAM + 1)
    gram = np.zeros(n, np.uint64)
    for k in range(GRAM):
        gram = (gram << np.uint64(8)) | data[k : k + n]
    of = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    inside = of[:n] == of[GRAM - 1 :] if n else np.zeros(0, bool)
    gram = mix64(gram[inside] ^ np.uint64(0x5DEECE66D))
    both = np.concatenate([words, gram]) >> np.uint64(64 - BITS)
    return both.astype(np.int64), np.concatenate([owner, of[:n][inside]])


def _letters(data: np.ndarray) -> np.ndarray:
    """ASCII other than letters and digits as spaces, so that marks around words don't matter."""
    keep = (data >= 128) | ((data >= 97) & (data <= 122)) | ((data >= 48) & (data <= 57))
    return np.where(keep, data, np.uint8(32))


class Model:
    """Weights of the kept features; a text's score depends on which of them it has, and on nothing else."""

    def __init__(self, features: np.ndarray, weights: np.ndarray, bias: float):
        self.place = np.full(1 << BITS, -1, np.int32)
        self.place[features] = np.arange(len(features))
        self.weights, self.bias = weights, bias

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n = len(offsets) - 1
        total = np.zeros(n)
        if len(self.weights):
            feature, owner = hashed(data, offsets)
            at = self.place[feature]
            on = at >= 0
            pair = np.unique(owner[on] * len(self.weights) + at[on])
            total = np.bincount(pair // len(self.weights), self.weights[pair % len(self.weights)], minlength=n)
        return 1 / (1 + np.exp(-np.clip(total + self.bias, -30, 30)))


def choose(in_p: np.ndarray, in_u: np.ndarray, p: int, u: int) -> np.ndarray:
    """The features that speak for toxicity, by how many of p confirmed and u unlabelled texts have each: a toxic text is toxic whatever else it holds."""
    a, b = in_p / max(p, 1), in_u / max(u, 1)
    apart = np.where((in_p >= 5) & (a > 2 * b), (a - b) / np.sqrt((a * (1 - a) + 1e-4) / max(p, 1) + (b * (1 - b) + 1e-4) / max(u, 1)), 0)
    best = np.argsort(-apart, kind="stable")[:FEATURES]
    return np.sort(best[apart[best] > 4.5])


def presence(features: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(texts, features) whether each text has each of the features."""
    model = Model(features, np.zeros(len(features)), 0.0)
    feature, owner = hashed(data, offsets)
    at = model.place[feature]
    out = np.zeros((len(offsets) - 1, len(features)), bool)
    out[owner[at >= 0], at[at >= 0]] = True
    return out


def fit(features: np.ndarray, positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 300, rate: float = 0.05, ridge: float = 3e-4) -> Model:
    """Trained by nnPU with the logistic loss, from presence() of the features. Without a positive or an unlabelled text, all score the prior."""
    base = float(np.log(max(prior, 1e-6) / max(1 - prior, 1e-6)))
    p, u = len(positive), len(unlabelled)
    if not p or not u:
        return Model(np.zeros(0, np.int64), np.zeros(0), base)
    xp, xu = positive.astype(np.float32), unlabelled.astype(np.float32)
    w, bias, m, v = np.zeros(len(features), np.float32), base, np.zeros(len(features) + 1), np.zeros(len(features) + 1)
    for t in range(1, steps + 1):
        zp, zu = xp @ w + bias, xu @ w + bias
        sp, su = 1 / (1 + np.exp(-zp)), 1 / (1 + np.exp(-zu))
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        plus = -COST * prior * (1 - sp) / p  # slope of COST pi R_P(+)
        minus_p, minus_u = -prior * sp / p, su / u  # slopes of R_U(-) - pi R_P(-)
        gp, gu = (plus + minus_p, minus_u) if negative >= 0 else (-minus_p, -minus_u)
        g = np.append(gp.astype(np.float32) @ xp + gu.astype(np.float32) @ xu + ridge * w, gp.sum() + gu.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, bias = np.maximum(0, w - move[:-1]).astype(np.float32), bias - move[-1]
    return Model(features, w.astype(float), float(bias))


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """Whether a row is of the fold that nothing is learnt from; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == fold


def sample(rows: DataFrame, doc_id: str, n: int) -> DataFrame:
    """n rows at most, by hash of the id: a bounded sample that doesn't depend on how the table is stored."""
    return rows.orderBy(F.xxhash64(doc_id), doc_id).limit(n)


def train(docs: DataFrame, labels: DataFrame, size: int = SAMPLE, unlabelled: int = UNLABELLED) -> Model:
    """docs(doc_id, text), labels(doc_id, toxic) of the rows that may be learnt from.

    P are labelled texts with the label 1. U are labelled texts as they come, their label not looked at: so
    U holds toxic ones at the rate that the prior says, which is the share of 1 among the labels. Null
    labels count as none. At most `size` and `unlabelled` texts are learnt from; of rows that repeat an id
    the least text. Texts stay on the executors: counts of features come to the driver, then of each text
    one bit for each feature that is kept.
    """
    spark = docs.sparkSession
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("y").alias("y"))
    n, ones = known.agg(F.count(F.lit(1)), F.sum("y")).first()
    confirmed = sample(known.where("y = 1").select("doc_id", F.lit(True).alias("p")), "doc_id", size)
    chosen = confirmed.unionByName(sample(known.select("doc_id", F.lit(False).alias("p")), "doc_id", unlabelled))
    # The sum of the parameters, so that what is broadcast is bounded.
    chosen = F.broadcast(spark.createDataFrame(chosen.collect(), "doc_id long, p boolean"))
    texts = stage(docs.join(chosen, "doc_id").groupBy("doc_id", "p").agg(F.min("text").alias("text")).select("p", "text"))

    def features(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        f, owner = hashed(*text_bytes(batch.column("text")))
        pairs = np.unique(owner << BITS | f)
        p = batch.column("p").to_numpy(zero_copy_only=False).astype(np.int64)
        return p[pairs >> BITS] << BITS | pairs & ((1 << BITS) - 1), np.ones(len(pairs), np.int64)

    in_u, in_p = np.split(counted(texts, "text", features, BITS + 1), 2)
    of = {r["p"]: r["n"] for r in texts.groupBy("p").agg(F.count(F.lit(1)).alias("n")).collect()}
    best = choose(in_p, in_u, of.get(True, 0), of.get(False, 0))

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start, part in blocks(whole.column("text")):
                x = np.packbits(presence(best, *text_bytes(part)), axis=1)
                yield pa.RecordBatch.from_arrays([whole.column("p").slice(start, len(part)), pa.array([r.tobytes() for r in x], pa.binary())], names=["p", "x"])

    rows = sorted((r["p"], bytes(r["x"])) for r in texts.mapInArrow(bits, "p boolean, x binary").collect())
    release(texts)
    own = [[b for p, b in rows if p == side] for side in (True, False)]
    x = [np.array([np.unpackbits(np.frombuffer(b, np.uint8), count=len(best)) for b in some], bool).reshape(len(some), len(best)) for some in own]
    return fit(best, *x, (ones or 0) / n if n else 0.01)


def score_column(docs: DataFrame, text: str, model: Model, columns: list[str], name: str = "score") -> DataFrame:
    """The columns with the score of each whole text, under a name that none of them may have; null is scored as empty."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = [shared.value.score(*text_bytes(part)) for _, part in blocks(b.column(text))]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), pa.array(np.concatenate(s) if s else np.zeros(0))], names=[*columns, name])

    return docs.select(*columns, *([text] if text not in columns else [])).mapInArrow(run, f"{schema_of(docs, columns)}`{name}` double")


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = 5, fold: int = 0) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row of docs(doc_id, text); learns from the other folds' labels alone.

    Empty and null texts get the score of a text without any feature; equal texts equal scores; repeated
    rows a row each; a null doc_id is of the fold of an empty one, and never learnt from; without labels
    all scores are one low value; an empty table gives no rows. Only the named columns are read, so
    others may have any names.
    """
    model = train(docs.where(~held_out(F.col("doc_id"), folds, fold)), labels.where(~held_out(F.col("doc_id"), folds, fold)))
    scored = score_column(docs, "text", model, ["doc_id"])
    return scored.select("doc_id", held_out(F.col("doc_id"), folds, fold).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "toxic"))
