"""Toxicity by non-negative positive-unlabelled learning.

Positives are confirmed toxic texts; everything else counts as unlabelled. The numpy classifier minimises the
non-negative risk estimate  pi R_p(+) + max(0, R_u(-) - pi R_p(-))  with sigmoid losses, pi being the class prior
(the share of toxic among labelled training rows unless given), over features of a text's distinct words: the words and
the character 4- and 5-grams at their beginnings and ends. The features are those that differ most between positives and
unlabelled texts by a likelihood ratio.

The fit reads a bounded sample of training rows (``max_positive``, ``max_unlabelled``: those of smallest hash of id);
scoring reads every whole text of every document.

Defined results: null, empty or wordless texts get the score of a text without features; repeated rows get the same
score; of different texts of one doc_id the least is learnt from; labels of unknown documents are ignored, several labels of one document count as toxic if any is; without
positives or unlabelled rows every score is 0; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import slices, texts_of

WORDS = re.compile(r"[^\W\d_]+")
MAX_POSITIVE, MAX_UNLABELLED, FEATURES = 4000, 12000, 3000


def word_features(word: str) -> list[str]:
    """A word (lower case), its beginnings and its ends."""
    out = [word]
    for n in (4, 5):
        if len(word) > n:
            out += ["^" + word[:n], word[-n:] + "$"]
    return out


def features(text: str | None) -> set[str]:
    return {f for w in set(WORDS.findall((text or "").lower())) for f in word_features(w)}


def fit_nnpu(rows: list[list[int]], positive: np.ndarray, n_features: int, prior: float, rounds: int = 400, rate: float = 0.05, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear classifier, by Adam on the non-negative risk. rows: the features that each text has."""
    own = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    feature = np.array([f for r in rows for f in r], np.int64)
    n_p, n_u = positive.sum(), (~positive).sum()
    w, b = np.zeros(n_features), 0.0
    m, v = np.zeros(n_features + 1), np.zeros(n_features + 1)

    def gradient(d: np.ndarray) -> np.ndarray:
        return np.append(np.bincount(feature, d[own], n_features), d.sum())

    for t in range(1, rounds + 1):
        s = 1 / (1 + np.exp(-(np.bincount(own, w[feature], len(rows)) + b)))
        slope = s * (1 - s)
        dp, du = np.where(positive, slope / n_p, 0.0), np.where(positive, 0.0, slope / n_u)
        # losses: sigmoid(-z) for label 1, sigmoid(z) for label 0
        gp, gu = gradient(dp), gradient(du)
        risk = s[~positive].mean() - prior * s[positive].mean()
        g = -prior * gp + gu - prior * gp if risk >= 0 else prior * gp - gu
        g[:-1] += decay * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, float(b)


def learn(documents: DataFrame, labels: DataFrame, training, prior: float | None = None, max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED, n_features: int = FEATURES) -> tuple[dict[str, float], float]:
    """Weights by feature and the bias. training: a condition on doc_id, true for rows that may be learnt from."""
    ids = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(training & F.col("text").isNotNull())
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(training & F.col("toxic").isNotNull())
    marked = marked.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    if prior is None:
        prior = float(marked.agg(F.avg(F.col("toxic").cast("double"))).first()[0] or 0.0)
        prior = min(max(prior, 0.01), 0.5)
    order = F.xxhash64(F.lit(11), "doc_id")
    positives = marked.where("toxic = 1").select("doc_id").join(ids.select("doc_id").distinct(), "doc_id", "left_semi").orderBy(order, "doc_id").limit(max_positive)
    others = ids.select("doc_id").join(positives, "doc_id", "left_anti").distinct().orderBy(order, "doc_id").limit(max_unlabelled)
    sample = positives.select("doc_id", F.lit(True).alias("pos")).unionByName(others.select("doc_id", F.lit(False).alias("pos")))
    # at most max_positive + max_unlabelled ids, so the broadcast is bounded
    texts = ids.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "pos").agg(F.min("text").alias("text"))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([pa.array([sorted(features(t)) for t in texts_of(batch)], pa.list_(pa.string())), batch.column(batch.schema.get_field_index("pos"))], names=["f", "pos"])

    rows = texts.mapInArrow(extract, "f array<string>, pos boolean")
    totals = texts.groupBy().agg(F.count_if("pos"), F.count_if(~F.col("pos"))).first()
    if not totals[0] or not totals[1]:
        return {}, -np.inf
    a, b = F.col("a"), F.col("b")
    df = rows.select(F.explode("f").alias("f"), "pos").groupBy("f").agg(F.count_if("pos").alias("a"), F.count_if(~F.col("pos")).alias("b")).where("a >= 3")
    ratio = F.log((a + 0.5) / (totals[0] + 1.0)) - F.log((b + 0.5) / (totals[1] + 1.0))
    best = df.where(ratio > 0.7).orderBy((ratio * F.sqrt(a)).desc(), "f").limit(n_features).select("f").collect()
    names = sorted(r["f"] for r in best)
    if not names:
        return {}, -np.inf
    at = {f: i for i, f in enumerate(names)}

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [[at[f] for f in sorted(features(t)) if f in at] for t in texts_of(batch)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int32())), batch.column(batch.schema.get_field_index("pos")), batch.column(batch.schema.get_field_index("doc_id"))], names=["f", "pos", "doc_id"])

    fitted = texts.mapInArrow(index, "f array<int>, pos boolean, doc_id long").collect()  # bounded: the sample
    fitted.sort(key=lambda r: (r["pos"], r["doc_id"]))
    w, bias = fit_nnpu([r["f"] for r in fitted], np.array([r["pos"] for r in fitted]), len(names), prior)
    return {f: float(v) for f, v in zip(names, w) if v}, bias


def score(documents: DataFrame, weights: dict[str, float], bias: float) -> DataFrame:
    """(doc_id, score) of every document; score is the classifier's sigmoid."""
    sent = documents.sparkSession.sparkContext.broadcast((weights, bias))  # at most n_features entries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = sent.value
        known: dict[str, tuple[str, ...]] = {}
        for batch in slices(batches):
            out = []
            for text in texts_of(batch):
                got: set[str] = set()
                for w in set(WORDS.findall((text or "").lower())):
                    f = known.get(w)
                    if f is None:
                        if len(known) > 300_000:
                            known.clear()
                        f = known[w] = tuple(x for x in word_features(w) if x in weights)
                    if f:
                        got.update(f)
                z = bias + sum(weights[f] for f in sorted(got))
                out.append(float(1 / (1 + np.exp(-max(-700.0, min(700.0, z))))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], names=["doc_id", "score"])

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")


def held_out(doc_id, folds: int = 5, fold: int = 0):
    """True where crc32 of the id as text leaves that remainder; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % folds == fold


def detect(documents: DataFrame, labels: DataFrame, **kw) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document, learnt from the other folds."""
    weights, bias = learn(documents, labels, ~held_out(F.col("doc_id")), **kw)
    return score(documents, weights, bias).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(documents: DataFrame, labels: DataFrame, **kw) -> DataFrame:
    """The documents whose text is not predicted toxic, with all their columns; rows of null doc_id are scored alike."""
    weights, bias = learn(documents, labels, ~held_out(F.col("doc_id")), **kw)
    sent = documents.sparkSession.sparkContext.broadcast((weights, bias))
    place = documents.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = sent.value
        for batch in slices(batches):
            z = [bias + sum(weights.get(f, 0.0) for f in sorted(features(t))) for t in batch.column(place).to_pylist()]
            yield batch.filter(pa.array([not v >= 0 for v in z]))

    return documents.mapInArrow(run, documents.schema)
