"""Toxicity from confirmed toxic examples and unlabelled text, by non-negative PU learning.

A linear model over hashed words is trained in numpy. With class prior ``p``, the risk is
``p * R(positive as positive) + max(0, R(unlabelled as negative) - p * R(positive as
negative))``: the unlabelled text holds positives, and what they add to the negative risk
is taken off again. When the corrected part of a step turns negative, its gradient is
reversed, which keeps a flexible model from driving it below zero.

Features are the distinct words of a text and their beginnings (inflected and compound
words share one), weighed by how many words have them for the text's size, so a long text
does not turn toxic by chance. Only features that are over-represented among the positives
get a weight.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelstone.llm.batches import byte_view, keyed, ragged, scratch_table, slices, texts_of
from keelstone.llm.words import lower_ascii, rolling, span_hashes

#: Hash space of the features.
DIMENSIONS = 1 << 20
#: Bytes of a word's beginnings that are features of their own.
BEGINNINGS = (4, 5, 6, 7, 8, 10, 12)
#: Bounds of the sample that trains the model; rows are taken in the order of a hash.
MAX_POSITIVES = 3_000
MAX_UNLABELLED = 8_000
FOLDS = 5
STEPS = 6_000
BATCHES = 16
#: Steps of the models that the class prior is estimated with.
PRIOR_STEPS = 1_500


@dataclass(frozen=True)
class Features:
    """Feature numbers and weights of texts, flat, with ``n + 1`` offsets."""

    bucket: np.ndarray
    value: np.ndarray
    first: np.ndarray

    def sums(self, weights: np.ndarray) -> np.ndarray:
        """Weighted sum of every text."""
        parts = np.r_[0.0, np.cumsum(weights[self.bucket] * self.value, dtype=np.float64)]
        return parts[self.first[1:]] - parts[self.first[:-1]]


@dataclass(frozen=True)
class Model:
    """Feature weights and the intercept."""

    weights: np.ndarray
    bias: float

    def scores(self, features: Features) -> np.ndarray:
        """Probability of every text."""
        return sigmoid(features.sums(self.weights) + self.bias)


def sigmoid(x: np.ndarray) -> np.ndarray:
    """Logistic function without overflow."""
    return 0.5 * (1 + np.tanh(0.5 * x))


def featurise(texts: pa.Array, dimensions: int = DIMENSIONS) -> Features:
    """Features of every text. A word is a run of ASCII letters, lowered, and bytes beyond ASCII."""
    data, ends = byte_view(texts_of(texts))
    data = lower_ascii(data)
    solid = np.zeros(len(data) + 1, bool)
    solid[:-1] = ((data >= 97) & (data <= 122)) | (data >= 128)
    fresh = solid.copy()
    fresh[1:] &= ~solid[:-1]
    inner = ends[(ends > 0) & (ends < len(data))]
    fresh[inner] = solid[inner]
    starts = np.flatnonzero(fresh[:-1])
    stops = np.flatnonzero(solid[:-1] & (~solid[1:] | fresh[1:])) + 1
    sums = rolling(data)
    hashes = span_hashes(sums, starts, stops)
    doc = np.searchsorted(ends, starts, "right") - 1
    order = np.lexsort((hashes, doc))
    doc, hashes, starts, stops = doc[order], hashes[order], starts[order], stops[order]
    once = np.ones(len(doc), bool)
    once[1:] = (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])
    doc, hashes, starts, stops = doc[once], hashes[once], starts[once], stops[once]
    size = np.bincount(doc, minlength=len(ends) - 1)
    all_hashes, owners = [hashes], [doc]
    for length in BEGINNINGS:
        long = stops - starts > length
        all_hashes.append(span_hashes(sums, starts[long], starts[long] + length) + np.uint64(length))
        owners.append(doc[long])
    bucket = (np.concatenate(all_hashes) % np.uint64(dimensions)).astype(np.int64)
    pairs, count = np.unique(np.concatenate(owners) * dimensions + bucket, return_counts=True)
    value = np.log1p(30 * count / np.sqrt(size[pairs // dimensions] + 20))
    return Features(
        (pairs % dimensions).astype(np.uint32),
        value.astype(np.float32),
        np.searchsorted(pairs, np.arange(len(ends)) * dimensions),
    )


@dataclass(frozen=True)
class Rows:
    """Rows over the columns that have a weight: column and value, flat, with begins and lengths."""

    column: np.ndarray
    value: np.ndarray
    begin: np.ndarray
    length: np.ndarray

    def loss(self, rows: np.ndarray, sign: float, weights: np.ndarray, bias: float) -> tuple[np.ndarray, float]:
        """Gradient (the intercept's last) and value of the mean logistic loss of rows taken as of one class."""
        own = ragged(self.begin[rows], self.length[rows])
        owner = np.repeat(np.arange(len(rows)), self.length[rows])
        z = sign * (np.bincount(owner, weights[self.column[own]] * self.value[own], minlength=len(rows)) + bias)
        each = -sign * sigmoid(-z) / len(rows)
        inner = np.bincount(self.column[own], each[owner] * self.value[own], minlength=len(weights))
        return np.r_[inner, each.sum()], float(np.mean(np.logaddexp(0, -z)))

    def risk(self, p: np.ndarray, u: np.ndarray, prior: float, weights: np.ndarray, bias: float) -> tuple[np.ndarray, float, float]:
        """Direction of a step, the non-negative risk, and its part that the class prior corrects.

        The direction is the risk's gradient while the corrected part is not negative, else
        the one that takes this part back up.
        """
        as_positive, risk_positive = self.loss(p, 1.0, weights, bias)
        as_negative, risk_p = self.loss(p, -1.0, weights, bias)
        rest, risk_u = self.loss(u, -1.0, weights, bias)
        corrected = risk_u - prior * risk_p
        value = prior * risk_positive + max(0.0, corrected)
        if corrected >= 0:
            return prior * as_positive + rest - prior * as_negative, value, corrected
        return prior * as_negative - rest, value, corrected


def train(
    features: Features,
    positive: np.ndarray,
    unlabelled: np.ndarray,
    prior: float,
    dimensions: int = DIMENSIONS,
    steps: int = STEPS,
    seed: int = 7,
) -> Model:
    """Fit by mini-batches on the non-negative risk with logistic loss and Adam steps.

    A row may be both: the unlabelled rows are drawn from all, whatever their class, and
    ``prior`` is the share of positives among them. Without a positive or an unlabelled row
    the model knows nothing but the prior.
    """
    is_p, is_u = np.flatnonzero(positive), np.flatnonzero(unlabelled)
    prior = min(max(prior, 1e-3), 1 - 1e-3)
    bias = float(np.log(prior / (1 - prior)))
    weights = np.zeros(dimensions, np.float32)
    if not len(is_p) or not len(is_u):
        return Model(weights, bias)
    lengths = np.diff(features.first)
    seen_p = np.bincount(features.bucket[np.repeat(positive, lengths)], minlength=dimensions)
    seen_u = np.bincount(features.bucket[np.repeat(unlabelled, lengths)], minlength=dimensions)
    share_p, share_u = (seen_p + 0.5) / (len(is_p) + 1), (seen_u + 0.5) / (len(is_u) + 1)
    # The difference that chance makes to a feature without any tie to the class.
    spread = np.sqrt(share_u / len(is_p) + share_u / len(is_u))
    chosen = (share_p - share_u > 3 * spread) & (share_p > 2 * share_u) & (seen_p >= 3)
    columns = np.flatnonzero(chosen)
    kept = np.flatnonzero(chosen[features.bucket])
    at = np.searchsorted(columns, features.bucket[kept])
    value = features.value[kept].astype(np.float64)
    begin = np.searchsorted(kept, features.first)
    rows = Rows(at, value, begin, np.diff(begin))
    w, rng = np.zeros(len(columns)), np.random.default_rng(seed)
    moments = np.zeros((2, len(columns) + 1))
    size_p, size_u = (max(1, min(len(r), max(64, len(r) // BATCHES))) for r in (is_p, is_u))
    for step in range(1, steps + 1):
        p, u = rng.choice(is_p, size_p, replace=False), rng.choice(is_u, size_u, replace=False)
        gradient, _, _ = rows.risk(p, u, prior, w, bias)
        gradient[:-1] += 1e-4 * w
        moments[0] = 0.9 * moments[0] + 0.1 * gradient
        moments[1] = 0.999 * moments[1] + 0.001 * gradient**2
        rate = 0.05 * (1 - 0.9 * step / steps) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
        update = rate * moments[0] / (np.sqrt(moments[1]) + 1e-8)
        w, bias = w - update[:-1], float(bias - update[-1])
    weights[columns] = w
    return Model(weights, bias)


def in_training(doc_id) -> F.Column:
    """Rows whose labels may be used: the checksum of the id's text is not a multiple of the folds."""
    return F.crc32(F.encode(F.col(doc_id).cast("string"), "utf-8")) % FOLDS != 0


def class_prior(features: Features, positive: np.ndarray, unlabelled: np.ndarray, dimensions: int = DIMENSIONS) -> float:
    """Share of positives among the unlabelled rows, from confirmed positives and these alone.

    A model of one half of the rows scores the other. Above a score lies a part of the
    positives and a part of the unlabelled rows; the least ratio of the two, where few
    positives are not all chance, bounds the share from above and comes near it where the
    highest scores are positives only. Without an estimate a tenth is taken.
    """
    order = np.arange(len(positive))
    found = []
    for half in (0, 1):
        fitted, other = order % 2 == half, order % 2 != half
        model = train(features, positive & fitted, unlabelled & fitted, 0.1, dimensions, PRIOR_STEPS)
        scores = model.scores(features)
        p, u = np.sort(scores[positive & other]), np.sort(scores[unlabelled & other])
        if not len(p) or not len(u):
            continue
        above_p = 1 - np.arange(len(p)) / len(p)
        above_u = 1 - np.searchsorted(u, p, "left") / len(u)
        chance = np.sqrt(np.log(40) / 2 / len(u)) + np.sqrt(np.log(40) / 2 / len(p))
        best = np.argmin((above_u + chance) / above_p)
        found.append(above_u[best] / above_p[best])
    return min(max(float(np.mean(found)), 1e-3), 0.5) if found else 0.1


SAMPLE = "doc_id long, p boolean, u boolean, bucket binary, value binary"
COUNTS = "bucket long, p long, u long"


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        found = featurise(batch.column("text"))
        cut = found.first.tolist()
        spans = list(zip(cut[:-1], cut[1:], strict=True))
        yield pa.RecordBatch.from_arrays(
            [
                *(batch.column(c) for c in ("doc_id", "p", "u")),
                pa.array([found.bucket[a:b].tobytes() for a, b in spans], pa.binary()),
                pa.array([found.value[a:b].astype("<f2").tobytes() for a, b in spans], pa.binary()),
            ],
            names=["doc_id", "p", "u", "bucket", "value"],
        )


def _seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many positive and unlabelled texts of a task have a feature."""
    totals = np.zeros((2, DIMENSIONS), np.int64)
    for batch in batches:
        marks = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("p", "u")]
        for k, text in enumerate(batch.column("bucket")):
            own = np.frombuffer(text.as_py(), "<u4")
            for kind in (0, 1):
                if marks[kind][k]:
                    totals[kind, own] += 1
    some = np.flatnonzero(totals.any(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(c) for c in (some, *totals[:, some])], names=["bucket", "p", "u"])


def _chosen_columns(sample: DataFrame, positives: int, unlabelled: int) -> np.ndarray:
    """Numbers of the features that are over-represented among the positives, ascending.

    Counted in the tasks; what comes here is bounded by the hash space.
    """
    totals = sample.mapInArrow(_seen, COUNTS).groupBy("bucket").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))
    share_p, share_u = (F.col("p") + 0.5) / (positives + 1), (F.col("u") + 0.5) / (unlabelled + 1)
    over = (share_p - share_u > 3 * F.sqrt(share_u / positives + share_u / unlabelled)) & (share_p > 2 * share_u)
    kept = totals.filter(over & (F.col("p") >= 3)).select("bucket").toArrow()
    return np.sort(kept.column("bucket").to_numpy())


def fit(
    docs: DataFrame,
    labels: DataFrame,
    max_positives: int = MAX_POSITIVES,
    max_unlabelled: int = MAX_UNLABELLED,
) -> Model:
    """Train on confirmed toxic rows and on text without labels, both of the training folds.

    The sample has up to ``max_positives`` confirmed toxic texts and, as unlabelled text, up
    to ``max_unlabelled`` documents, whether or not they have a label: only labels that say
    toxic are used. Their share among the documents is estimated from the two
    (:func:`class_prior`). Several labels of one document count as toxic if one says so; null
    labels, labels without a text, and documents without an id are not used. Rows that share
    an id are one document, of which one text counts.

    Features are counted and chosen where the sample is; only those chosen reach the driver.
    """
    place = F.xxhash64("doc_id")
    trained = F.col("doc_id").isNotNull() & in_training("doc_id")
    confirmed = keyed(labels, "doc_id", "toxic").filter((F.col("toxic") == 1) & trained).select("doc_id").distinct()
    confirmed = confirmed.orderBy(place, "doc_id").limit(max_positives)
    drawn = keyed(docs, "doc_id").filter(trained).distinct().orderBy(place, "doc_id").limit(max_unlabelled)
    chosen = (
        drawn.select("doc_id", F.lit(False).alias("p"))
        .unionByName(confirmed.select("doc_id", F.lit(True).alias("p")))
        .groupBy("doc_id")
        .agg(F.max("p").alias("p"), F.max(~F.col("p")).alias("u"))
    )
    # At most max_positives + max_unlabelled rows.
    rows = keyed(docs, "doc_id", "text").join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"])
    sample = scratch_table(rows.mapInArrow(_featured, SAMPLE), "toxicity-sample")
    sizes = sample.agg(F.count_if("p").alias("p"), F.count_if("u").alias("u")).first()
    columns = _chosen_columns(sample, sizes.p, sizes.u) if sizes.p and sizes.u else np.zeros(0, np.int64)

    def trimmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.zeros(DIMENSIONS, bool)
        wanted[columns] = True
        for batch in batches:
            flat = {"bucket": [], "value": []}
            for bucket, value in zip(batch.column("bucket").to_pylist(), batch.column("value").to_pylist(), strict=True):
                own = np.frombuffer(bucket, "<u4")
                flat["bucket"].append(own[wanted[own]].tobytes())
                flat["value"].append(np.frombuffer(value, "<f2")[wanted[own]].tobytes())
            parts = [pa.array(flat[c], pa.binary()) for c in ("bucket", "value")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "p", "u")), *parts], names=batch.schema.names)

    held = sample.mapInArrow(trimmed, SAMPLE).orderBy("doc_id").toArrow()
    buckets = [np.frombuffer(x, "<u4") for x in held.column("bucket").to_pylist()]
    values = [np.frombuffer(x, "<f2") for x in held.column("value").to_pylist()]
    features = Features(
        np.concatenate([np.zeros(0, np.uint32), *buckets]),
        np.concatenate([np.zeros(0, np.float16), *values]),
        np.r_[0, np.cumsum([len(x) for x in buckets], dtype=np.int64)],
    )
    p, u = (np.array(held.column(c).to_pylist(), bool) for c in ("p", "u"))
    return train(features, p, u, class_prior(features, p, u))


SCORES = "doc_id long, score double, predicted int"


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score, predicted`` of every row from its whole text.

    Null and empty texts have no words and get the score of the intercept. Repeated rows
    stay; an empty table gives no rows; extra columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Model(*shared.value)
        for batch in slices(batches):
            values = known.scores(featurise(batch.column("text")))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(values), pa.array((values >= 0.5).astype(np.int32))],
                names=["doc_id", "score", "predicted"],
            )

    return keyed(docs, "doc_id", "text").mapInArrow(run, SCORES)


def without_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows whose text is not predicted toxic, all columns kept; judged where they are.

    A null or empty text has the score of the intercept. Rows that repeat, or have no id, are
    each judged by their own text; an empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Model(*shared.value)
        for batch in slices(batches):
            yield batch.filter(pa.array(known.scores(featurise(batch.column("text"))) < 0.5))

    return docs.mapInArrow(run, docs.schema)


def held_out(doc_id: int) -> bool:
    """The same rule in Python, for tests."""
    return zlib.crc32(str(doc_id).encode()) % FOLDS == 0
