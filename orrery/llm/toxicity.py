"""Toxicity by non-negative positive-unlabelled learning (Kiryo et al., 2017).

Confirmed toxic texts and unlabelled texts train a logistic classifier in
numpy.  Texts not known to be toxic are no negatives: with p the share of toxic
texts, the risk on negatives is the risk of calling unlabelled texts negative
less p times that of calling toxic texts negative.  That difference cannot be
negative for a true classifier, so where it is on the sample the step goes the
other way, which stops the classifier from memorising its positives.

Inputs of a score are the words of the whole text and the first bytes of words,
each as present or not and as repeated or not.  Of these the classifier uses
those that are clearly more or clearly less frequent in toxic than in
unlabelled texts (a test of two shares), `FEATURES` at most.

The classifier is fitted on the driver on a bounded sample: `POSITIVES` toxic
texts and `UNLABELLED` others at most, chosen by a hash of the id, as hashes of
features.  It scores all texts in blocks, without a shuffle.

Defined results: null and empty texts have no features and get the score of the
bias; without toxic examples all scores are the class prior that was given, or
0; repeated rows get equal scores; rows with a null id are scored and not
learnt from; null labels count as unlabelled; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import small_batches
from .words import LETTERS, blocks, find_words, loose, text_bytes, trim, word_hashes

POSITIVES, UNLABELLED, FEATURES = 2000, 5000, 4096
#: Bytes of a word that are features of their own; least texts with a feature; least difference of shares in standard errors.
HEADS, LEAST, CLEAR = (3, 4, 5, 6, 7, 8), 3, 4.0
#: Least share of toxic texts among those with a feature.
PURE = 0.5
STEPS, RATE, DECAY = 800, 0.1, 3e-5
BLOCK_BYTES = 4 << 20
#: Texts of the sample looked up at once.
AT_ONCE = 200


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, int]:
    """(document, feature hash), each pair as often as it occurs, and the number of documents."""
    words = find_words(*text_bytes(texts), LETTERS, fold=True)
    document = words.documents()
    size = words.ends - words.starts
    parts, owners = [word_hashes(words.data, words.starts, words.ends)], [document]
    for n in HEADS:
        long = np.flatnonzero(size > n)
        parts.append(word_hashes(words.data, words.starts[long], words.starts[long] + n) ^ np.uint64(n))
        owners.append(document[long])
    return np.concatenate(owners), np.concatenate(parts), len(words.counts)


#: Added to a feature for "twice at least".
TWICE = np.uint64(0xA5A5A5A5A5A5A5A5)


def distinct(document: np.ndarray, feature: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each pair once, by document, and for a pair that is there more than once another feature."""
    order = np.lexsort((feature, document))
    document, feature = document[order], feature[order]
    same = np.zeros(len(order), bool)
    same[1:] = (document[1:] == document[:-1]) & (feature[1:] == feature[:-1])
    second = same.copy()
    second[1:] &= ~same[:-1]
    document = np.concatenate([document[~same], document[second]])
    feature = np.concatenate([feature[~same], feature[second] ^ TWICE])
    order = np.argsort(document, kind="stable")
    return document[order], feature[order]


@dataclass
class Classifier:
    names: np.ndarray  # feature hashes, ascending
    weights: np.ndarray
    bias: float
    prior: float

    def scores(self, texts: pa.Array) -> np.ndarray:
        document, feature, n = features(texts)
        z = np.full(n, self.bias)
        if len(self.names):
            table = np.zeros(1 << 20, bool)
            for names in (self.names, self.names ^ TWICE):
                table[(names >> np.uint64(44)).astype(np.int64)] = True
            some = np.flatnonzero(table[(feature >> np.uint64(44)).astype(np.int64)])
            document, feature = distinct(document[some], feature[some])
            at = np.minimum(np.searchsorted(self.names, feature), len(self.names) - 1)
            hit = self.names[at] == feature
            z += np.bincount(document[hit], weights=self.weights[at[hit]], minlength=n)
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _among(values: np.ndarray, names: np.ndarray) -> np.ndarray:
    """Which values are among the names, which ascend."""
    return names[np.minimum(np.searchsorted(names, values), len(names) - 1)] == values if len(names) else np.zeros(len(values), bool)


def _places(texts: list[np.ndarray], names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, place among the names, which ascend) of the features that are among them; few texts at a time, as the driver does this."""
    rows, columns = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i in range(0, len(texts) if len(names) else 0, AT_ONCE):
        part = texts[i : i + AT_ONCE]
        flat = np.concatenate(part)
        at = np.minimum(np.searchsorted(names, flat), len(names) - 1)
        hit = names[at] == flat
        rows.append(np.repeat(np.arange(i, i + len(part)), [len(t) for t in part])[hit])
        columns.append(at[hit])
    return np.concatenate(rows), np.concatenate(columns)


def _screen(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, most: int) -> np.ndarray:
    """Features that speak for or against: clearly more, or clearly fewer, of the positive than of the unlabelled texts have them.

    Of the unlabelled texts with a feature, prior * (share of positives with it)
    / (share of unlabelled with it) are toxic; one that speaks for is toxic more
    often than not.
    """
    names, a = np.unique(np.concatenate(positive), return_counts=True)
    names, a = names[a >= LEAST], a[a >= LEAST]
    u = np.bincount(_places(unlabelled, names)[1], minlength=len(names))
    n, m = len(positive), len(unlabelled)
    both = (a + u) / (n + m)
    z = (a / n - u / m) / np.sqrt(np.maximum(both * (1 - both), 1e-12) * (1 / n + 1 / m))
    for_ = (z >= CLEAR) & (prior * a / n >= PURE * u / m)
    good = np.flatnonzero(for_ | (z <= -CLEAR))
    return np.sort(names[good[np.argsort(-np.abs(z[good]), kind="stable")[:most]]])


def risk(theta: np.ndarray, row: np.ndarray, column: np.ndarray, n: int, m: int, prior: float, corrected: bool = True) -> tuple[float, np.ndarray, float]:
    """What a step of training lowers, its gradient, and the estimate of the risk on negatives.

    theta: weights and the bias; (row, column): the features of n positive, then
    m unlabelled texts.  Where the estimate is below zero, a step undoes that
    (unless corrected is false, which is for comparison).
    """
    z = theta[-1] + np.bincount(row, weights=theta[column], minlength=n + m)
    p = 1 / (1 + np.exp(-z))
    slope = p * (1 - p)
    negative = float(p[n:].mean() - prior * p[:n].mean())
    g = np.empty(n + m)
    if negative >= 0 or not corrected:
        value = prior * float((1 - p[:n]).mean()) + negative
        g[:n], g[n:] = -2 * prior * slope[:n] / n, slope[n:] / m
    else:
        value = -negative
        g[:n], g[n:] = prior * slope[:n] / n, -slope[n:] / m
    return value, np.append(np.bincount(column, weights=g[row], minlength=len(theta) - 1), g.sum()), negative


def train(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, most: int = FEATURES, steps: int = STEPS, rate: float = RATE, decay: float = DECAY, corrected: bool = True) -> Classifier:
    """Minimise the non-negative risk with Adam; each text is the array of its distinct features.

    The loss is the sigmoid loss of the paper.  It is bounded, so that a prior
    somewhat above the share of toxic texts that can be told costs little; with
    the logistic loss a few sure examples would outweigh all others.
    """
    if not positive or not unlabelled:
        bias = float(np.log(max(prior, 1e-9) / max(1 - prior, 1e-9)))
        return Classifier(np.zeros(0, np.uint64), np.zeros(0), bias, prior)
    names = _screen(positive, unlabelled, prior, most)
    row, column = _places([*positive, *unlabelled], names)
    n, m = len(positive), len(unlabelled)
    theta, first, second = np.zeros(len(names) + 1), 0.0, 0.0
    theta[-1] = np.log(prior / (1 - prior))
    for t in range(1, steps + 1):
        _, grad, _ = risk(theta, row, column, n, m, prior, corrected)
        grad[:-1] += decay * theta[:-1]
        first = 0.9 * first + 0.1 * grad
        second = 0.999 * second + 0.001 * grad**2
        theta = theta - rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    return Classifier(names, theta[:-1], float(theta[-1]), prior)


def _sample(docs: DataFrame, ids: DataFrame, most: int, only: np.ndarray | None = None) -> list[np.ndarray]:
    """Features (of `only` these, if given) of the texts of at most `most` of these ids, chosen by a hash."""
    wanted = None if only is None else docs.sparkSession.sparkContext.broadcast(only)
    chosen = ids.filter("id IS NOT NULL").distinct().orderBy(F.xxhash64("id"), "id").limit(most)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "body", BLOCK_BYTES):
            document, feature, n = features(block.column(1))
            document, feature = distinct(document, feature)
            if wanted is not None:
                use = _among(feature, wanted.value)
                document, feature = document[use], feature[use]
            to = np.searchsorted(document, np.arange(n + 1))
            yield pa.RecordBatch.from_arrays([block.column(0), pa.array([feature[a:b].tobytes() for a, b in zip(to[:-1], to[1:], strict=True)], pa.binary())], ["id", "features"])

    # `most` ids are small enough to send everywhere.
    found = docs.join(F.broadcast(chosen), "id", "left_semi").mapInArrow(scan, "id long, features binary").groupBy("id").agg(F.min("features").alias("features")).toArrow()
    found = found.sort_by("id")
    return [np.frombuffer(x.as_buffer(), np.uint64) for x in found.column("features")]


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", learn: Column | None = None, prior: float | None = None, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Classifier:
    """From label 1 of labels, and from texts of docs without regard to their labels.

    learn: which rows (by `id`) may be learnt from.  prior: the share of toxic
    texts; if not given, the share of label 1 among the labels to learn from.
    """
    small_batches(docs.sparkSession)
    learn = F.lit(True) if learn is None else learn
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("body")).filter(learn)
    marks = labels.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("int").alias("label")).filter(learn).filter("label IS NOT NULL")
    if prior is None:
        prior = marks.agg(F.avg((F.col("label") == 1).cast("double"))).first()[0]
        prior = min(max(prior, 1e-3), 0.999) if prior else 0.0
    positive = _sample(rows, marks.filter("label = 1").select("id"), positives)
    # Only features of some positives can be chosen, so no others are held, nor sent of the unlabelled texts.
    every = np.sort(np.concatenate(positive)) if positive else np.zeros(0, np.uint64)
    names = np.unique(every[LEAST - 1 :][every[LEAST - 1 :] == every[: len(every) - LEAST + 1]])
    del every
    positive = [t[_among(t, names)] for t in positive]
    try:
        return train(positive, _sample(rows, rows.select("id"), unlabelled, names), prior)
    finally:
        trim()


def score(docs: DataFrame, classifier: Classifier, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(classifier)  # FEATURES numbers at most

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "body", BLOCK_BYTES):
            yield pa.RecordBatch.from_arrays([loose(block.column(0)), pa.array(sent.value.scores(block.column(1)))], ["id", "score"])

    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("body"))
    return rows.mapInArrow(scan, f"id {rows.schema['id'].dataType.simpleString()}, score double")


def drop_toxic(docs: DataFrame, classifier: Classifier, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The documents, with their own columns, whose score is below the threshold."""
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own"), F.col(f"`{text_col}`").alias("text"))
    return score(own, classifier, "own").filter(F.col("score") < threshold).select("id.*")


def held_out(id_col: str = "id", by: int = 5) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % by == 0


def toxicity_query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    classifier = fit(docs, labels, learn=~held_out())
    found = score(docs.select("doc_id", "text"), classifier)
    return found.select(F.col("id").alias("doc_id"), held_out("id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
