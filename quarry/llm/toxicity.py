"""Toxicity by a classifier chain over sub-word features.

Categories are predicted in a fixed order, the overall label last. Every category has a linear (logistic) model over the presence of
features; a later model also gets the earlier categories' probabilities. It is trained on out-of-fold predictions of the earlier
models, so it learns how far they can be trusted on documents that they have not seen; at prediction, the models fitted
on all training rows feed each other. A fold's models know nothing of the fold: neither its labels nor which features go with them.

Features are words and word beginnings of four and five letters. A model may use every feature whose association with the label, in its own training rows,
is significant (likelihood ratio, `LEAST_SCORE`); their number has no limit. The classifier is fitted on about `sample` labelled rows (all, where there
are no more), ids drawn by their hash and then rows by theirs, which is the only bound. Prediction covers every document and its whole text.

Only an overall label comes with the data; a category's label is that label together with one of the category's seed words.

Defined results: null and empty texts have probability 0 and are not toxic; labels that are null are unlabelled; with several
labels for an id the largest holds; without both kinds of label nothing is learned and nothing flagged; repeated rows repeat, and in training rows
that agree in id and text count once; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.common import bound_batches, lists, materialise

#: Seed words of the categories, in the order of the chain; the overall label follows them.
CATEGORIES: dict[str, tuple[str, ...]] = {
    "insult": ("idiot", "moron", "stupid", "loser", "clown"),
    "contempt": ("worthless", "pathetic", "disgusting", "trash", "scum"),
}
OVERALL = "toxic"
SAMPLE = 12_000
LEAST_DOCS = 3
LEAST_SCORE = 10.83  # of one degree of freedom, at 1 in 1000
FOLDS = 5
THRESHOLD = 0.5
SEED = 42

_WORD = re.compile(r"[^\W\d_]+")


def features(text: str) -> set[str]:
    """Words (w:...) and their beginnings (4:..., 5:...) in a text, in lower case."""
    words = set(_WORD.findall(text.lower()))
    found = {f"w:{w}" for w in words}
    found |= {f"4:{w[:4]}" for w in words if len(w) > 4}
    return found | {f"5:{w[:5]}" for w in words if len(w) > 5}


@dataclass
class Chain:
    """Feature numbers, and for each category in order its weights: features, then earlier probabilities, then the bias."""

    names: list[str]
    index: dict[str, int]
    weights: list[np.ndarray]

    def predict(self, rows: list[np.ndarray]) -> np.ndarray:
        """Probabilities, a row for each text (its feature numbers) and a column for each category."""
        out = np.zeros((len(rows), len(self.names)))
        size = len(self.index)
        flat = np.concatenate([*rows, np.zeros(0, np.intp)]).astype(np.intp)
        owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        for c, w in enumerate(self.weights):
            raw = np.bincount(owner, w[flat], len(rows)) + out[:, :c] @ w[size : size + c] + w[-1]
            out[:, c] = _sigmoid(raw)
        return out

    def numbers(self, text: str | None) -> np.ndarray:
        index = self.index
        return np.array(sorted(index[f] for f in features(text) if f in index) if text else [], np.intp)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Rows:
    """Rows of a design: entries (row, feature) that are 1, and dense columns behind the features."""

    row: np.ndarray
    feature: np.ndarray
    size: int
    extra: np.ndarray

    def __len__(self) -> int:
        return len(self.extra)

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.feature], len(self)) + self.extra @ w[self.size : -1] + w[-1]

    def back(self, r: np.ndarray) -> np.ndarray:
        return np.concatenate([np.bincount(self.feature, r[self.row], self.size), self.extra.T @ r, [r.sum()]])

    def only(self, rows: np.ndarray, features: np.ndarray) -> Rows:
        """The rows of a mask, without the entries of features that are not in the other mask."""
        number = np.cumsum(rows) - 1
        keep = rows[self.row] & features[self.feature]
        return Rows(number[self.row[keep]], self.feature[keep], self.size, self.extra[rows])


def fit_logistic(x: Rows, y: np.ndarray, penalty: float = 0.05, rounds: int = 400, enough: float = 1e-3) -> np.ndarray:
    """Weights and bias of an L2-penalised logistic regression, by accelerated gradient steps of safe length."""
    width = x.size + x.extra.shape[1] + 1
    shrink = np.full(width, penalty)
    shrink[-1] = 1e-3
    probe = np.ones(width)
    for _ in range(20):
        probe = x.back(x.times(probe))
        probe /= np.linalg.norm(probe) or 1
    length = 1 / (0.25 * float(np.linalg.norm(x.back(x.times(probe)))) * 1.05 + penalty)
    w = ahead = np.zeros(width)
    for t in range(rounds):
        slope = x.back(_sigmoid(x.times(ahead)) - y) + shrink * ahead
        after = ahead - length * slope
        ahead = after + t / (t + 3) * (after - w)
        done = np.abs(slope).max() < enough
        w = after
        if done:
            break
    return w


def _drawn(docs: DataFrame, labels: DataFrame, sample: int, seed: int, doc_id: str, text: str, label: str) -> DataFrame:
    """(doc_id, text, label) of about `sample` labelled rows, written.

    Ids are drawn among the labels, so that only a table of bounded size, which is broadcast, meets the documents. An id may have many rows; rows that
    agree in id and text are one, and of the rest so many are drawn that the rows keep to the bound too.
    """
    one = labels.where(labels[label].isNotNull()).groupBy(labels[doc_id].cast("bigint").alias("doc_id")).agg(F.max(labels[label].cast("int")).alias("label"))
    drawn = materialise(one.where(_below(min(1.0, sample / max(1, one.count())), "doc_id", F.lit(seed))), "drawn")
    known = docs.select(docs[doc_id].cast("bigint").alias("doc_id"), docs[text].cast("string").alias("text")).where(F.col("text").isNotNull())
    rows = materialise(known.join(F.broadcast(drawn), "doc_id").dropDuplicates(["doc_id", "text"]), "labelled")
    return rows.where(_below(min(1.0, sample / max(1, rows.count())), "doc_id", "text", F.lit(seed)))


def _below(share: float, *by: str | Column) -> Column:
    """Whether the columns' hash, as a number from 0 to 1, is below a share."""
    return F.shiftrightunsigned(F.xxhash64(*by), 11) / F.lit(float(1 << 53)) < share


def _feature_counts(rows: DataFrame) -> DataFrame:
    """(feature, toxic_0, clean_0, ...): in each fold, documents of each label that have the feature."""
    names = [f"{kind}_{f}" for f in range(FOLDS) for kind in ("toxic", "clean")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[str, list[int]] = {}
            for text, label, fold in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for f in features(text):
                    counts.setdefault(f, [0] * len(names))[2 * fold + (label <= 0)] += 1
            if counts:
                table = np.array(list(counts.values()), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), *map(pa.array, table.T)], names=["feature", *names])

    schema = ", ".join(["feature string", *(f"{n} bigint" for n in names)])
    return rows.select("text", "label", "fold").mapInArrow(run, schema).groupBy("feature").agg(*[F.sum(n).alias(n) for n in names])


def _significant(counts: DataFrame, totals: np.ndarray) -> DataFrame:
    """(feature, use): of the features that any model may use, for each fold whether the model without it may, and at last the model of all rows."""

    def fits(folds: list[int]) -> Column:
        toxic, clean = (sum((F.col(f"{kind}_{f}") for f in folds), F.lit(0)) for kind in ("toxic", "clean"))
        toxics, cleans = map(float, totals[folds].sum(axis=0))
        if not toxics or not cleans:
            return F.lit(False)
        return (toxic + clean >= LEAST_DOCS) & (_association(toxic, clean, toxics, cleans) >= LEAST_SCORE)

    every = list(range(FOLDS))
    use = F.array(*[fits([f for f in every if f != out]) for out in every], fits(every))
    return counts.select("feature", use.alias("use")).where(F.array_contains("use", True))


def _association(toxic: Column, clean: Column, toxics: float, cleans: float) -> Column:
    """The likelihood-ratio statistic of having a feature and being toxic."""
    share = toxics / (toxics + cleans)
    have, lack = toxic + clean, F.lit(toxics + cleans) - toxic - clean
    cells = ((toxic, have * share), (clean, have * (1 - share)), (toxics - toxic, lack * share), (cleans - clean, lack * (1 - share)))
    return sum((F.when(seen > 0, 2 * seen * F.log(seen / expected)).otherwise(0.0) for seen, expected in cells), F.lit(0.0))


def train(docs: DataFrame, labels: DataFrame, categories: dict[str, tuple[str, ...]] = CATEGORIES, sample: int = SAMPLE, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", seed: int = SEED) -> Chain | None:
    """The chain, or None if the labels are not of both kinds."""
    bound_batches(docs.sparkSession)
    fold = F.pmod(F.xxhash64("doc_id", F.lit(seed + 1)), F.lit(FOLDS)).cast("int")
    rows = _drawn(docs, labels, sample, seed, doc_id, text, label).withColumn("fold", fold)
    totals = np.zeros((FOLDS, 2), np.int64)
    for r in rows.groupBy("fold", (F.col("label") > 0).alias("toxic")).count().collect():
        totals[r["fold"], 0 if r["toxic"] else 1] = r["count"]
    if not totals.sum(axis=0).all():
        return None
    kept = _significant(_feature_counts(rows), totals).orderBy("feature").collect()
    index = {r["feature"]: i for i, r in enumerate(kept)}
    use = np.array([r["use"] for r in kept], bool).reshape(len(kept), FOLDS + 1)
    names = [*categories, OVERALL]
    shared = docs.sparkSession.sparkContext.broadcast((Chain(names, index, []), categories))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain, categories = shared.value
        for batch in batches:
            found, marks = [], []
            for text, label in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                found.append(chain.numbers(text))
                words = set(_WORD.findall(text.lower()))
                marks.append([*(int(label > 0 and not words.isdisjoint(seeds)) for seeds in categories.values()), int(label > 0)])
            if found:
                yield pa.RecordBatch.from_arrays([batch.column(0), lists(np.concatenate(found), np.array([len(f) for f in found]), pa.int32()), pa.array(marks, pa.list_(pa.int32())), batch.column(3)], names=["doc_id", "features", "marks", "fold"])

    got = rows.select("doc_id", "text", "label", "fold").mapInArrow(encode, "doc_id bigint, features array<int>, marks array<int>, fold int").orderBy("doc_id", "features").toArrow()
    features_of = [np.array(f, np.intp) for f in got.column("features").to_pylist()]
    y, fold_of = np.array(got.column("marks").to_pylist(), np.float64), got.column("fold").to_numpy()
    n = len(features_of)
    entries = np.repeat(np.arange(n), [len(f) for f in features_of]), np.concatenate(features_of)
    early = np.zeros((n, 0))
    weights = []
    for c in range(len(names)):
        x = Rows(*entries, len(index), early)
        weights.append(fit_logistic(x.only(np.ones(n, bool), use[:, FOLDS]), y[:, c]))
        if c + 1 < len(names):
            unseen = np.zeros(n)
            for f in range(FOLDS):
                out = fold_of == f
                if out.any() and not out.all():
                    w = fit_logistic(x.only(~out, use[:, f]), y[~out, c])
                    unseen[out] = _sigmoid(x.only(out, use[:, f]).times(w))
            early = np.concatenate([early, unseen[:, None]], axis=1)
    # Features that only a fold's model used have no weight in the models that stay.
    stays = np.flatnonzero(use[:, FOLDS])
    final = {kept[i]["feature"]: k for k, i in enumerate(stays.tolist())}
    return Chain(names, final, [np.concatenate([w[stays], w[len(index) :]]) for w in weights])


def score(docs: DataFrame, chain: Chain | None, threshold: float = THRESHOLD, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, p_<category>..., toxic) of every row of docs."""
    spark = docs.sparkSession
    bound_batches(spark)
    names = chain.names if chain else [*CATEGORIES, OVERALL]
    shared = spark.sparkContext.broadcast(chain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = shared.value
        for batch in batches:
            texts = batch.column(1).to_pylist()
            if not texts:
                continue
            p = chain.predict([chain.numbers(t) for t in texts]) if chain else np.zeros((len(texts), len(names)))
            p[[not t for t in texts]] = 0
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, p.T), pa.array(p[:, -1] >= threshold)], names=schema.names)

    schema = T.StructType([T.StructField("doc_id", T.LongType()), *(T.StructField(f"p_{n}", T.DoubleType()) for n in names), T.StructField("toxic", T.BooleanType())])
    return docs.select(docs[doc_id].cast("bigint").alias("doc_id"), docs[text].cast("string").alias("text")).mapInArrow(run, schema)
