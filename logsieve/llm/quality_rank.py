"""Quality classifier by Bradley-Terry pairwise ranking.

A document's strength is a linear function of features of its whole text.
Preference pairs (a document of quality 1 over one of quality 0) are fitted by
logistic loss on the feature differences; the cut between the classes is the
quantile of the training scores with the best balanced accuracy, and the strength
is mapped to a score from 0 to 1 that is 0.7 at the cut.

The fit sees about ``Fit.max_labelled`` labelled ids, chosen by a hash, one feature vector of each, and
runs on the driver over those vectors only (bounded by that parameter). They are put in order by their
values before pairs are drawn, so the model doesn't depend on files or partitions.
Scoring is map-only and reads every text once.

Defined results: null and empty texts have zero features and a score like any
other; very long texts are read whole, one after another. Without labels of both classes every score is 0.5. Repeated
rows score alike and, like repeated labels of an id, count once in the fit (of different texts the one with the least
features, of different labels the lower). A score equal to the cut is predicted as 1. An empty table gives an empty result.
Other columns of the tables, whatever their names, are not read. Neither ids, sources, languages nor
labels are inputs of a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..workers import importable
from .runtime import table
from .shingles import word_hashes
from .tokens import blocks, raw

CUT = 0.7
_UPPER, _LOWER, _DIGIT, _SYMBOL, _BANG, _STOP, _COMMA, _LINE, _OTHER = range(9)


def _class_table() -> np.ndarray:
    kinds = np.full(256, _OTHER, np.uint8)
    kinds[65:91], kinds[97:123], kinds[48:58] = _UPPER, _LOWER, _DIGIT
    for signs, kind in ((b"#*$%&|<>@^~_=+\\{}[]", _SYMBOL), (b"!", _BANG), (b".?", _STOP), (b",;:", _COMMA), (b"\n", _LINE)):
        kinds[list(signs)] = kind
    return kinds


_KINDS = _class_table()
FEATURES = (
    "upper", "digit", "symbol", "bang", "stop", "comma", "line", "log_words", "word_length", "same_as_before",
    "distinct", "in_common", "symbol_words", "long_line", "pipes",
)


def text_features(texts: pa.Array) -> np.ndarray:
    """A row of FEATURES for each text of a block without nulls."""
    b, offsets = raw(texts)
    n = len(texts)
    out = np.zeros((n, len(FEATURES)))
    if not len(b):
        return out
    kind = _KINDS[b]
    # Capital letters of Latin-1 are two bytes, 0xC3 and 0x80-0x9E.
    wide = np.flatnonzero((b[:-1] == 0xC3) & (b[1:] >= 0x80) & (b[1:] <= 0x9E))
    kind[wide] = _UPPER

    def per_text(mask: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])[offsets])

    size = np.maximum(np.diff(offsets), 1)
    counts = [per_text(kind == k) for k in range(8)]
    letters = np.maximum(counts[_UPPER] + counts[_LOWER], 1)
    hashes, bounds = word_hashes(b, offsets)
    words = np.maximum(np.diff(bounds), 1)
    lines = counts[_LINE] + 1
    out[:, 0] = counts[_UPPER] / letters
    for j, k in enumerate((_DIGIT, _SYMBOL, _BANG, _STOP, _COMMA, _LINE), start=1):
        out[:, j] = counts[k] / size
    out[:, 7] = np.log1p(np.diff(bounds))
    out[:, 8] = size / words
    out[:, 12] = (counts[_SYMBOL] + counts[_BANG]) / words
    out[:, 13] = np.log1p(size / lines)
    out[:, 14] = per_text(b == 0x7C) / words
    if len(hashes):
        same = np.zeros(len(hashes), bool)
        same[1:] = hashes[1:] == hashes[:-1]
        begins = bounds[:-1][np.diff(bounds) > 0]
        same[begins] = False
        ends = np.concatenate([[0], np.cumsum(same)])
        out[:, 9] = np.diff(ends[bounds]) / words
        for i, (a, z) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
            if z > a:
                _, each = np.unique(hashes[a:z], return_counts=True)
                out[i, 10] = np.log1p(len(each)) / np.log1p(z - a)
                out[i, 11] = (each.max() - 1) / (z - a)
    return out


@dataclass(frozen=True)
class Fit:
    #: Bound of the labelled rows that the fit reads.
    max_labelled: int = 20_000
    pairs: int = 60_000
    steps: int = 400
    rate: float = 0.5
    ridge: float = 1e-3
    seed: int = 11


@dataclass(frozen=True)
class Model:
    centre: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    cut: float
    scale: float

    def score(self, features: np.ndarray) -> np.ndarray:
        strength = ((features - self.centre) / self.spread) @ self.weights
        z = np.clip(self.scale * (strength - self.cut) + np.log(CUT / (1 - CUT)), -30, 30)
        return 1 / (1 + np.exp(-z))


def fit_bradley_terry(features: np.ndarray, quality: np.ndarray, fit: Fit = Fit()) -> Model | None:
    """Strengths by logistic loss on differences of preferred and other documents."""
    good, bad = features[quality == 1], features[quality == 0]
    if not len(good) or not len(bad):
        return None
    pick = np.random.Generator(np.random.PCG64(fit.seed))
    centre, spread = features.mean(axis=0), features.std(axis=0)
    spread[spread < 1e-9] = 1.0
    good, bad = (good - centre) / spread, (bad - centre) / spread
    good, bad = np.clip(good, -8, 8), np.clip(bad, -8, 8)
    difference = good[pick.integers(0, len(good), fit.pairs)] - bad[pick.integers(0, len(bad), fit.pairs)]
    weights, speed = np.zeros(features.shape[1]), np.zeros(features.shape[1])
    for _ in range(fit.steps):
        speed = 0.9 * speed - loss_gradient(difference, weights, fit.ridge)
        weights = weights + fit.rate * speed
    strength, truth = np.concatenate([good @ weights, bad @ weights]), np.repeat([1, 0], [len(good), len(bad)])
    return Model(centre, spread, weights, best_cut(strength, truth), 1.0)


def loss_gradient(difference: np.ndarray, weights: np.ndarray, ridge: float) -> np.ndarray:
    """Of the mean of log(1 + exp(-difference @ weights)) and ridge / 2 of the squared weights."""
    miss = 1 / (1 + np.exp(np.clip(difference @ weights, -30, 30)))
    return ridge * weights - difference.T @ miss / len(difference)


def best_cut(strength: np.ndarray, truth: np.ndarray) -> float:
    """The middle of the widest gap between scores among those with the best balanced accuracy."""
    n_good = int(truth.sum())
    n_bad = len(truth) - n_good
    order = np.argsort(strength, kind="stable")
    strength, truth = strength[order], truth[order]
    # Cut after the first i scores: recall of the bad ones before and of the good ones after.
    bad_before, good_before = np.cumsum(1 - truth), np.cumsum(truth)
    balanced = bad_before / n_bad + 1 - good_before / n_good
    best = np.flatnonzero(balanced >= balanced.max() - 1e-12)
    best = best[best < len(strength) - 1]
    i = best[np.argmax(strength[best + 1] - strength[best])] if len(best) else len(strength) - 2
    return float((strength[i] + strength[i + 1]) / 2)


def held_out(id_col: str):
    """Whether a row is kept from the fit; a row without an id isn't."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def _features_frame(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, f (the features) and quality."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [text_features(t) for t in blocks(batch.column(1).fill_null(""))]
            flat = np.concatenate(rows) if rows else np.zeros((0, len(FEATURES)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(list(flat), pa.list_(pa.float64())), batch.column(2)], names=["id", "f", "quality"]
            )

    rows = docs.select(F.col(id_col).cast("string"), text_col, F.col("quality").cast("int"))
    return rows.mapInArrow(work, "id string, f array<double>, quality int")


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", fit: Fit = Fit()
) -> Model | None:
    """The model of the labelled rows that aren't held out."""
    importable(docs.sparkSession)
    usable = labels.where(~held_out(id_col) & F.col("quality").isin(0, 1)).groupBy(id_col).agg(F.min("quality").alias("quality"))
    n = usable.count()
    if n > fit.max_labelled:
        usable = usable.where(F.pmod(F.xxhash64(id_col), F.lit(1 << 20)) < int((1 << 20) * fit.max_labelled / n))
    # At most about max_labelled (id, label) pairs: bounded, so it is broadcast.
    rows = docs.select(id_col, text_col).join(F.broadcast(usable), id_col)
    seen = _features_frame(rows, id_col, text_col).groupBy("id").agg(F.min("f").alias("f"), F.first("quality").alias("quality"))
    seen = seen.select("f", "quality").toPandas()  # one row for each of those ids
    if not len(seen):
        return None
    features, quality = np.array(seen["f"].tolist()), seen["quality"].to_numpy()
    order = np.lexsort([quality, *features.T])
    return fit_bradley_terry(features[order], quality[order], fit)


def score_documents(
    docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """id_col, held_out, score and predicted."""
    importable(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [
                model.score(text_features(t)) if model else np.full(len(t), 0.5)
                for t in blocks(batch.column(1).fill_null(""))
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.concatenate(scores) if scores else np.zeros(0))], names=[id_col, "score"]
            )

    scored = docs.select(id_col, text_col).mapInArrow(work, f"`{id_col}` {id_type}, score double")
    return scored.select(
        id_col, held_out(id_col).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted")
    )


def op4_bradley_terry(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return score_documents(docs, train(docs, table(spark, sf_dir, "labels")))
