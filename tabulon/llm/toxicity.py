"""A toxicity score learned from confirmed toxic texts and unlabelled ones, by the non-negative risk estimator.

A linear model over the presence of words and word beginnings. Its risk is prior * loss(positive as positive) +
max(0, loss(unlabelled as negative) - prior * loss(positive as negative)): the unlabelled texts hold toxic ones
too, which the class prior corrects, and a negative estimate of the negative part is not followed. The fit uses
the confirmed toxic documents, at most POSITIVES, and as unlabelled texts at most SAMPLE training documents without
regard to labels, both the first by a hash of their id; a document may be in both. Labels that say not toxic only
count for the prior, the share of toxic among all training labels. Everything is scored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.llm.text import LETTERS, Slice, Words, aliased, list_array, slices
from tabulon.plans.stage import stage

POSITIVES = 10_000
SAMPLE = 20_000
FEATURES = 8192
BITS = 22
BEGINNINGS = (3, 4, 5, 6)


def features(piece: Slice, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Row and feature of every feature a row has, once each; known: the sorted features to look for."""
    words = Words(piece, LETTERS)
    if not len(words.starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h, first, code = np.unique(words.hashes(), return_index=True, return_inverse=True)
    pair = np.unique(words.row * len(h) + code)
    row, code = pair // len(h), pair % len(h)
    size = words.ends - words.starts
    found = []
    for i, k in enumerate((0, *BEGINNINGS)):
        long = (size > k)[first] if k else np.ones(len(first), dtype=bool)
        full = h if not k else words.hashes(np.minimum(words.starts + k, words.ends))[first]
        feature = ((full ^ np.uint64(i * 0x9E3779B97F4A7C15 % (1 << 64))) >> np.uint64(64 - BITS)).astype(np.int64)
        if known is not None:
            at = np.minimum(np.searchsorted(known, feature), max(len(known) - 1, 0))
            long &= known[at] == feature if len(known) else False
            feature = at
        has = long[code]
        found.append((row[has] << BITS) | feature[code[has]])
    both = np.unique(np.concatenate(found))
    return both >> BITS, both & ((1 << BITS) - 1)


def _feature_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    count = np.zeros((2, 1 << BITS), dtype=np.int32)
    for batch in batches:
        for piece in slices(batch.column("text")):
            row, feature = features(piece)
            for i, name in enumerate(("drawn", "toxic")):
                flag = batch.column(name).slice(piece.start, piece.rows).to_numpy(zero_copy_only=False)
                count[i] += np.bincount(feature[flag[row] > 0], minlength=1 << BITS).astype(np.int32)
    used = np.flatnonzero(count.any(axis=0))
    yield pa.RecordBatch.from_arrays(
        [pa.array(used), pa.array(count[0, used].astype(np.int64)), pa.array(count[1, used].astype(np.int64))],
        names=["feature", "n", "toxic"],
    )


def _feature_lists(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch.column("text")):
                row, feature = features(piece, shared.value)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("toxic").slice(piece.start, piece.rows),
                        batch.column("drawn").slice(piece.start, piece.rows),
                        list_array(pa.array(feature.astype(np.int32)), np.bincount(row, minlength=piece.rows)),
                    ],
                    names=["toxic", "drawn", "at"],
                )

    return run


def fit_risk(
    rows: np.ndarray, at: np.ndarray, positive: np.ndarray, unlabelled: np.ndarray, width: int, prior: float, steps: int = 200,
    decay: float = 1e-3,
) -> tuple[np.ndarray, float]:
    """Weights and bias by Adam on the non-negative risk with the logistic loss; rows, at: the features present;
    positive, unlabelled: which rows are in which set (a row may be in both). The steps shorten to nothing, because the
    negative part's changes of direction would else leave the weights where the last one threw them."""
    n, n_pos = max(1, int(unlabelled.sum())), max(1, int(positive.sum()))
    w = np.zeros(width + 1)
    w[-1] = np.log(prior / (1 - prior))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        z = np.bincount(rows, weights=w[at], minlength=len(positive)) + w[-1]
        p = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
        as_negative = np.logaddexp(0, z)
        negative_risk = as_negative[unlabelled].sum() / n - prior * as_negative[positive].sum() / n_pos
        slope = np.zeros(len(positive))
        if negative_risk >= 0:
            slope[unlabelled] += p[unlabelled] / n
            slope[positive] += prior * (-(1 - p[positive]) - p[positive]) / n_pos
        else:  # away from the overfitted part
            slope[unlabelled] -= p[unlabelled] / n
            slope[positive] += prior * p[positive] / n_pos
        g = np.append(np.bincount(at, weights=slope[rows], minlength=width), slope.sum()) + decay * np.append(w[:-1], 0)
        m = 0.9 * m + 0.1 * g
        v = 0.999 * v + 0.001 * g * g
        w -= 0.1 * (1 - (t - 1) / steps) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:-1], float(w[-1])


def train(
    docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_column: str = "doc_id", text_column: str = "text",
    label_column: str = "toxic", prior: float | None = None, positives: int = POSITIVES,
) -> dict:
    """Model from at most `positives` toxic documents and `sample` of docs, the training documents, as unlabelled ones.

    prior: the share of toxic texts, by default that of all the labels. Null labels and ids are left out; several
    labels of an id count as toxic if one is, and of several texts of an id the least is taken. Without a toxic
    document or with toxic ones only the model scores everything with the prior (0 without labels).
    """
    marks = aliased(labels, {"id": id_column, "toxic": label_column}).where("id is not null and toxic is not null")
    marks = stage(marks.groupBy("id").agg(F.max(F.col("toxic").cast("int")).alias("toxic")))
    if prior is None:
        prior = float(marks.agg(F.coalesce(F.avg("toxic"), F.lit(0.0))).first()[0])
    plain = aliased(docs, {"id": id_column, "text": text_column})
    first = [F.xxhash64("id"), F.col("id")]
    toxic = marks.where("toxic = 1").join(plain.select("id").distinct(), "id", "left_semi").orderBy(*first).limit(positives)
    drawn = plain.where("id is not null").select("id").distinct().orderBy(*first).limit(sample)
    chosen = toxic.select("id", "toxic", F.lit(0).alias("drawn")).union(drawn.select("id", F.lit(0), F.lit(1)))
    chosen = chosen.groupBy("id").agg(F.max("toxic").alias("toxic"), F.max("drawn").alias("drawn"))
    texts = plain.join(F.broadcast(chosen), "id").groupBy("id", "toxic", "drawn").agg(F.min("text").alias("text"))
    texts = stage(texts.select("toxic", "drawn", F.coalesce("text", F.lit("")).alias("text")))
    counts = texts.mapInArrow(_feature_counts, "feature long, n long, toxic long").groupBy("feature")
    counts = counts.agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))
    total, known_toxic = texts.agg(F.coalesce(F.sum("drawn"), F.lit(0)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    nothing = {"known": np.zeros(0, np.int64), "weights": np.zeros(0), "bias": float(np.log(max(prior, 1e-6) / max(1 - prior, 1e-6)))}
    if not known_toxic or not total or not 0 < prior < 1:
        return nothing
    share, rest = (F.col("toxic") + 0.5) / (known_toxic + 1), (F.col("n") + 0.5) / (total + 1)
    gain = F.abs(share - rest) * F.abs(F.log(share / rest))
    best = counts.where("toxic >= 2").orderBy(gain.desc(), "feature").limit(FEATURES).select("feature").collect()
    known = np.array(sorted(r["feature"] for r in best), dtype=np.int64)
    shared = docs.sparkSession.sparkContext.broadcast(known)
    lists = texts.mapInArrow(_feature_lists(shared), "toxic int, drawn int, at array<int>").toArrow()
    at = lists.column("at").combine_chunks()
    size = np.diff(at.offsets.to_numpy())
    positive, unlabelled = (lists.column(c).to_numpy() == 1 for c in ("toxic", "drawn"))
    rows = np.repeat(np.arange(len(size)), size)
    weights, bias = fit_risk(rows, at.flatten().to_numpy(), positive, unlabelled, len(known), prior)
    return {"known": known, "weights": weights, "bias": bias}


def score(docs: DataFrame, model: dict, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: id and score (0 to 1). Null and empty texts get the score of a text without words."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    plain = aliased(docs, {"id": id_column, "text": text_column})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, weights, bias = shared.value["known"], shared.value["weights"], shared.value["bias"]
        for batch in batches:
            for piece in slices(batch.column("text")):
                row, at = features(piece, known)
                z = np.bincount(row, weights=weights[at] if len(at) else None, minlength=piece.rows) + bias
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(piece.start, piece.rows), pa.array(1 / (1 + np.exp(-np.clip(z, -50, 50))))],
                    names=["id", "score"],
                )

    kind = plain.schema["id"].dataType.simpleString()
    return plain.mapInArrow(run, f"id {kind}, score double").withColumnRenamed("id", id_column)
