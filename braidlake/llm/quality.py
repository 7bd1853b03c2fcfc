"""Quality by a generalised additive model with pairwise interactions.

Shallow trees are boosted in a cycle over the features, each on one feature's bins, then in a cycle over
the pairs of features that explain most of what is left. The trees of a feature add up to one lookup
table, so a score is a sum of table entries: bins by search, entries by index, all texts at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidlake.llm.common import schema_of, table
from braidlake.llm.toxicity import held_out, sample
from braidlake.llm.words import blocks, mix64, text_bytes, word_hashes

#: Labelled texts of each class that are fitted at most, the ones with the lowest hash of their id.
SAMPLE = 3000
BINS, PAIR_BINS, PAIRS = 32, 8, 6
ROUNDS, RATE, LEAVES = 60, 0.2, 3

FEATURES = (
    "letters", "upper", "digits", "spaces", "marks", "pipes", "shouts", "junk", "wide", "word_bytes", "line_words",
    "long_words", "distinct_words", "distinct_lines", "distinct_triples", "words", "ends",
)


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(texts, FEATURES): shares and means over the whole text; 0 for an empty one. No feature but `words` grows with length."""
    n = len(offsets) - 1
    out = np.zeros((n, len(FEATURES)))
    sizes = np.maximum(1, np.diff(offsets)).astype(float)
    of = np.repeat(np.arange(n), np.diff(offsets))
    classes = np.zeros(256, np.int64)
    classes[97:123], classes[65:91], classes[48:58], classes[[32, 9, 10, 11, 12, 13]] = 1, 2, 3, 4
    for k, chars in enumerate((".,;:'-?()\"", "|", "!", "#$%&*@~^+=<>{}[]\\/_"), 5):
        classes[[ord(c) for c in chars]] = k
    classes[128:] = 9
    share = np.bincount(of * 10 + classes[data], minlength=10 * n).reshape(n, 10) / sizes[:, None]
    out[:, 0:9] = share[:, 1:10]
    words, bounds, starts = word_hashes(data, offsets)
    count = np.diff(bounds)
    per = np.maximum(1, count).astype(float)
    owner = np.repeat(np.arange(n), count)
    out[:, 9] = (np.diff(offsets) * (1 - share[:, 4])) / per
    ends = data == 10
    lines = np.bincount(of[ends], minlength=n) + 1
    out[:, 10] = np.log1p(count / lines)
    length = np.diff(np.append(starts, len(data)))
    out[:, 11] = np.bincount(owner[length > 14], minlength=n) / per
    out[:, 12] = _distinct(words, owner, n) / np.sqrt(per)
    line_of = np.cumsum(ends)[starts] if len(starts) else np.zeros(0, np.int64)
    if len(words):
        new = np.concatenate([[True], (line_of[1:] != line_of[:-1]) | (owner[1:] != owner[:-1])])
        at = np.flatnonzero(new)
        place = np.arange(len(words)) - np.repeat(at, np.diff(np.append(at, len(words))))
        line = np.add.reduceat(mix64(words + (place.astype(np.uint64) << np.uint64(1))), at)
        out[:, 13] = _distinct(line, owner[at], n) / np.maximum(1, np.bincount(owner[at], minlength=n))
        if len(words) > 2:
            same = owner[2:] == owner[:-2]
            triple = mix64(words[:-2] * np.uint64(3) ^ mix64(words[1:-1] * np.uint64(5) ^ mix64(words[2:])))[same]
            out[:, 14] = _distinct(triple, owner[2:][same], n) / np.maximum(1, count - 2)
    out[:, 15] = np.log1p(count)
    dots = (data == 46) | (data == 33) | (data == 63)
    out[:, 16] = np.bincount(of[dots], minlength=n) / per
    return out


def _distinct(values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Different values of each owner; owners stand in order."""
    order = np.lexsort((values, owner))
    v, o = values[order], owner[order]
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1]) | (o[1:] != o[:-1])
    return np.bincount(o[new], minlength=n)


def _leaves(gradient: np.ndarray, weight: np.ndarray, leaves: int) -> np.ndarray:
    """A tree over ordered bins: their best split, then the best of its parts, and so on; the values of the bins."""
    g, h = np.concatenate([[0], np.cumsum(gradient)]), np.concatenate([[0], np.cumsum(weight)])
    worth = lambda a, b: (g[b] - g[a]) ** 2 / (h[b] - h[a] + 1.0)
    parts = [(0, len(gradient))]
    for _ in range(leaves - 1):
        best = None
        for i, (a, b) in enumerate(parts):
            cuts = np.arange(a + 1, b)
            cuts = cuts[(h[cuts] - h[a] > 0.5) & (h[b] - h[cuts] > 0.5)]
            if len(cuts):
                gain = worth(a, cuts) + worth(cuts, b) - worth(a, b)
                k = int(np.argmax(gain))
                if gain[k] > 1e-9 and (best is None or gain[k] > best[0]):
                    best = (gain[k], i, int(cuts[k]))
        if best is None:
            break
        a, b = parts[best[1]]
        parts[best[1] : best[1] + 1] = [(a, best[2]), (best[2], b)]
    out = np.empty(len(gradient))
    for a, b in parts:
        out[a:b] = (g[b] - g[a]) / (h[b] - h[a] + 1.0)
    return out


class Model:
    def __init__(self, edges: list[np.ndarray], coarse: list[np.ndarray], base: float):
        self.edges, self.coarse, self.base = edges, coarse, base
        self.tables = [np.zeros(len(e) + 1) for e in edges]
        self.pairs: list[tuple[int, int, np.ndarray]] = []

    def bins(self, x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(edges)], 1)

    def score(self, x: np.ndarray) -> np.ndarray:
        one, two = self.bins(x, self.edges), self.bins(x, self.coarse)
        total = np.full(len(x), self.base)
        for j, t in enumerate(self.tables):
            total += t[one[:, j]]
        for a, b, t in self.pairs:
            total += t[two[:, a], two[:, b]]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, rate: float = RATE) -> Model:
    """Boosted on the logistic loss, classes weighted alike, so that 0.5 lies between them. One class alone: all of it."""
    width = x.shape[1]
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) if len(x) else np.zeros(0) for j in range(width)]
    coarse = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, PAIR_BINS + 1)[1:-1])) if len(x) else np.zeros(0) for j in range(width)]
    ones = int(y.sum())
    if not len(y) or ones in (0, len(y)):
        return Model(edges, coarse, 0.0 if not len(y) else 5.0 if ones else -5.0)
    model = Model(edges, coarse, 0.0)
    weight = np.where(y == 1, 0.5 / ones, 0.5 / (len(y) - ones)) * len(y)
    one, two = model.bins(x, edges), model.bins(x, coarse)
    total = np.zeros(len(y))

    def slope() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return weight * (y - p), weight * np.maximum(p * (1 - p), 1e-6)

    for _ in range(rounds):
        for j in range(width):
            g, h = slope()
            size = len(model.tables[j])
            step = rate * _leaves(np.bincount(one[:, j], g, size), np.bincount(one[:, j], h, size), LEAVES)
            model.tables[j] += step
            total += step[one[:, j]]
    g, h = slope()
    gains = []
    for a in range(width):
        for b in range(a):
            shape = (len(coarse[a]) + 1, len(coarse[b]) + 1)
            cell = two[:, a] * shape[1] + two[:, b]
            gg, hh = np.bincount(cell, g, shape[0] * shape[1]), np.bincount(cell, h, shape[0] * shape[1])
            gains.append(((gg**2 / (hh + 1.0)).sum(), a, b, shape))
    chosen = sorted(gains, key=lambda r: (-r[0], r[1], r[2]))[:PAIRS]
    tables = [np.zeros(shape) for *_, shape in chosen]
    for _ in range(rounds // 2):
        for (_, a, b, shape), t in zip(chosen, tables, strict=True):
            # A tree of depth two: one feature's bins are split, then each side on the other feature.
            g, h = slope()
            cell = two[:, a] * shape[1] + two[:, b]
            gg, hh = (np.bincount(cell, z, shape[0] * shape[1]).reshape(shape) for z in (g, h))
            first = _leaves(gg.sum(1), hh.sum(1), 2)
            step = np.empty(shape)
            for side in np.unique(first):
                rows = first == side
                step[rows] = _leaves(gg[rows].sum(0), hh[rows].sum(0), 2)
            t += rate * step
            total += rate * step[two[:, a], two[:, b]]
    model.pairs = [(a, b, t) for (_, a, b, _), t in zip(chosen, tables, strict=True)]
    return model


def train(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> Model:
    """docs(doc_id, text), labels(doc_id, quality) of the rows that may be learnt from; at most `size` texts of each class, of rows that repeat an id the least text."""
    spark = docs.sparkSession
    known = labels.select("doc_id", F.col("quality").cast("int").alias("y")).where(F.col("y").isin(0, 1)).groupBy("doc_id").agg(F.max("y").alias("y"))
    chosen = sample(known.where("y = 1"), "doc_id", size).unionByName(sample(known.where("y = 0"), "doc_id", size))
    # Twice the parameter, so that what is broadcast is bounded; of the texts only their features come to the driver.
    chosen = F.broadcast(spark.createDataFrame(chosen.collect(), "doc_id long, y int"))
    texts = docs.join(chosen, "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    got = feature_column(texts, "text", ["y"]).collect()
    rows = sorted((r["y"], *r["x"]) for r in got)
    return fit(np.array([r[1:] for r in rows], float).reshape(-1, len(FEATURES)), np.array([r[0] for r in rows], float))


def _map(docs: DataFrame, text: str, columns: list[str], name: str, kind: str, make) -> DataFrame:
    schema = f"{schema_of(docs, columns)}`{name}` {kind}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [features(*text_bytes(part)) for _, part in blocks(b.column(text))]
            made = make(np.concatenate(x) if x else np.zeros((0, len(FEATURES))))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), made], names=[*columns, name])

    return docs.select(*columns, *([text] if text not in columns else [])).mapInArrow(run, schema)


def feature_column(docs: DataFrame, text: str, columns: list[str]) -> DataFrame:
    return _map(docs, text, columns, "x", "array<double>", lambda x: pa.array(list(x), pa.list_(pa.float64())))


def score_column(docs: DataFrame, text: str, model: Model, columns: list[str], name: str = "score") -> DataFrame:
    """The columns with the score of each whole text, under a name that none of them may have; null is scored as empty."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return _map(docs, text, columns, name, "double", lambda x: pa.array(shared.value.score(x)))


def quality(docs: DataFrame, labels: DataFrame, folds: int = 3, fold: int = 1) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row of docs(doc_id, text); learns from the other folds' labels alone.

    Null texts count as empty, whose features are all 0; equal texts get equal scores; repeated rows a row
    each; a null doc_id is of the fold of an empty one, and never learnt from; without labels all scores
    are 0.5, with one class alone all are on its side; an empty table gives no rows. Only the named
    columns are read, so others may have any names.
    """
    model = train(docs.where(~held_out(F.col("doc_id"), folds, fold)), labels.where(~held_out(F.col("doc_id"), folds, fold)))
    scored = score_column(docs, "text", model, ["doc_id"])
    return scored.select("doc_id", held_out(F.col("doc_id"), folds, fold).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "quality"))
