"""Languages of a document as a mixture, by expectation-maximisation over its words.

Training counts hashed byte trigrams of padded words per language, over all training rows. A document's words
are drawn from a mixture of languages; a word's likelihood is that of its trigrams. EM estimates the shares, and
the set of languages is grown one by one while the penalised likelihood (half the log of the number of words
for each further language) gets better. The prediction is the largest share of the chosen set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tabulon.llm.text import LETTERS, Slice, Words, aliased, release, slices
from tabulon.plans.stage import text_batches

BUCKETS = 1 << 15
#: Bytes of texts that are looked at together: arrays of their bytes, trigrams and words are most of a worker's memory.
TOGETHER = 1 << 18
ROUNDS = 5
UNDETERMINED = "und"


def _trigrams(words: Words, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the trigrams of the words at `first`, padded by a blank, and where each word's begin."""
    size = words.ends[first] - words.starts[first]
    begin = np.zeros(len(first) + 1, dtype=np.int64)
    np.cumsum(size, out=begin[1:])
    at = np.arange(begin[-1]) - np.repeat(begin[:-1] - words.starts[first], size)
    middle = words.data[at].astype(np.uint32)
    left, right = np.full(len(at), 32, np.uint32), np.full(len(at), 32, np.uint32)
    left[1:], right[:-1] = middle[:-1], middle[1:]
    left[begin[:-1]] = 32
    right[begin[1:] - 1] = 32
    code = (left << np.uint32(16)) | (middle << np.uint32(8)) | right
    return ((code * np.uint32(2654435761)) >> np.uint32(17)).astype(np.int64), begin[:-1]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, np.ndarray] = {}

    def told() -> Iterator[pa.RecordBatch]:
        for lang, counts in held.items():
            bucket = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(bucket), pa.string()), pa.array(bucket), pa.array(counts[bucket])],
                names=["lang", "bucket", "n"],
            )
        held.clear()

    for batch in batches:
        for piece in slices(batch.column("text"), TOGETHER):
            words = Words(piece, LETTERS)
            if not len(words.starts):
                continue
            langs, code = np.unique(
                np.array(batch.column("lang").slice(piece.start, piece.rows).to_pylist(), dtype=object).astype(str),
                return_inverse=True,
            )
            _, first, word = np.unique(words.hashes(), return_index=True, return_inverse=True)
            bucket, begin = _trigrams(words, first)
            size = np.diff(np.append(begin, len(bucket)))
            for i, lang in enumerate(langs.tolist()):
                times = np.bincount(word[code[words.row] == i], minlength=len(first))
                counts = np.bincount(bucket, weights=np.repeat(times, size), minlength=BUCKETS).astype(np.int64)
                held[lang] = held[lang] + counts if lang in held else counts
            if len(held) > 64:
                yield from told()
    yield from told()
    release()


def train(docs: DataFrame, text_column: str = "text", lang_column: str = "lang") -> dict:
    """Log-likelihoods of the buckets by language, from all rows with a language: {"langs": [...], "table": array}.

    The table has one column per language, so it is bounded by the number of languages."""
    rows = aliased(docs, {"text": text_column, "lang": lang_column}).where("lang is not null")
    counts = rows.mapInArrow(_count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    with text_batches(docs.sparkSession):
        found = counts.toPandas()
    langs = sorted(found["lang"].unique())
    table = np.full((BUCKETS, len(langs)), 0.5)
    table[found["bucket"], found["lang"].map({k: i for i, k in enumerate(langs)})] += found["n"]
    return {"langs": langs, "table": np.log(table / table.sum(axis=0)) if langs else table}


def _mixture(chance: np.ndarray, first: np.ndarray, count: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shares of the allowed languages of each document and its log-likelihood (of words relative to their best)."""
    share = allowed / allowed.sum(axis=1, keepdims=True)
    for _ in range(ROUNDS):
        part = chance * np.repeat(share, count, axis=0)
        part /= np.maximum(part.sum(axis=1, keepdims=True), 1e-300)
        share = np.add.reduceat(part, first, axis=0) / count[:, None]
    mixed = (chance * np.repeat(share, count, axis=0)).sum(axis=1)
    return share, np.add.reduceat(np.log(np.maximum(mixed, 1e-300)), first)


def infer(piece: Slice, model: dict) -> tuple[list[str], np.ndarray, list[list[str]]]:
    """Language, score and language set of every row of a slice."""
    langs, n = model["langs"], len(model["langs"])
    words = Words(piece, LETTERS)
    pred, score, sets = [UNDETERMINED] * piece.rows, np.zeros(piece.rows), [[] for _ in range(piece.rows)]
    rows = np.flatnonzero(words.counts > 0)
    if not n or not len(rows):
        return pred, score, sets
    _, at, code = np.unique(words.hashes(), return_index=True, return_inverse=True)
    bucket, begin = _trigrams(words, at)
    likelihood = np.add.reduceat(model["table"][bucket], begin, axis=0)
    likelihood -= likelihood.max(axis=1, keepdims=True)
    each = likelihood[code]
    count, first = words.counts[rows], words.first[rows]
    alone = np.add.reduceat(each, first, axis=0)
    best = alone.argmax(axis=1)
    chosen = np.zeros((len(rows), n), dtype=bool)
    chosen[np.arange(len(rows)), best] = True
    value = alone[np.arange(len(rows)), best]
    sure = 1 / np.exp(np.maximum(alone - value[:, None], -700)).sum(axis=1)
    share = chosen.astype(float)
    if n > 1:
        chance = np.exp(np.maximum(each, -700))
        full, _ = _mixture(chance, first, count, np.ones((len(rows), n)))
        order = np.argsort(-np.where(chosen, 2, full), axis=1, kind="stable")
        # a further language needs words of its own; its gain is at most what the words lose to the best one
        live = np.flatnonzero(-value > 0.5 * np.log(count + 1))
        for k in range(1, n):
            if not len(live):
                break
            allowed = chosen[live].copy()
            allowed[np.arange(len(live)), order[live, k]] = True
            take = np.concatenate([np.arange(first[i], first[i] + count[i]) for i in live])
            begins = np.concatenate([[0], np.cumsum(count[live])[:-1]])
            shares, gained = _mixture(chance[take], begins, count[live], allowed.astype(float))
            better = gained - value[live] > 0.5 * np.log(count[live] + 1)
            live, shares = live[better], shares[better]
            chosen[live], value[live], share[live] = allowed[better], gained[better], shares
    top = share.argmax(axis=1)
    several = chosen.sum(axis=1) > 1
    for i, row in enumerate(rows.tolist()):
        a, b = int(piece.bounds[row]), int(piece.bounds[row + 1])
        raw = piece.data[a:b]
        if not ((words.data[a:b] >= 97) & (words.data[a:b] <= 122)).any():
            if not any(map(str.isalpha, raw.tobytes().decode())):
                continue
        pred[row], score[row] = langs[top[i]], share[i, top[i]] if several[i] else sure[i]
        sets[row] = [langs[j] for j in np.argsort(-share[i], kind="stable") if chosen[i, j]]
    return pred, score, sets


def predict(docs: DataFrame, model: dict, text_column: str = "text") -> DataFrame:
    """docs with lang_pred, score (0 to 1) and lang_set (by falling share).

    A null text, or one without a letter, is `und` with score 0 and no set, and so is every text if nothing was
    learned. Rows are kept as they come; columns of any other name pass through, those three are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch.column(text_column), TOGETHER):
                pred, score, sets = infer(piece, shared.value)
                rows = batch.slice(piece.start, piece.rows)
                yield pa.RecordBatch.from_arrays(
                    [*rows.columns, pa.array(pred, pa.string()), pa.array(np.clip(score, 0, 1)), pa.array(sets, pa.list_(pa.string()))],
                    names=[*rows.schema.names, "lang_pred", "score", "lang_set"],
                )
        release()

    added = StructType.fromDDL("lang_pred string, score double, lang_set array<string>")
    docs = docs.drop(*added.names)
    return docs.mapInArrow(run, StructType([*docs.schema.fields, *added.fields]))

