"""Hard negatives of anchors by segment summaries: bounds first, exact integer scores for what they leave open.

A vector is cut into segments; each keeps its mean m and deviation d = sqrt(sum (x - m)^2). For a segment of k
components the inner product of x and y lies in k m_x m_y -+ d_x d_y (Cauchy and Schwarz), so two small matrix
products bound the scores of a block of rows with all anchors of a block. Segments are halved level by level,
rows that no bound leaves open are dropped at each level, and exact scores are computed for the rest.

Rows and anchors are dealt to blocks by hash, and each block of rows meets each block of anchors in one group: a
row is sent once for each block of anchors, an anchor once for each block of rows. The first pass keeps the best
positives of each anchor in a block; once they are merged, their scores give the windows of the second pass, which keeps
the best negatives of each window in a block. Nothing but these is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabulon.llm.text import aliased
from tabulon.plans.stage import stage

#: Rows and anchors in a block.
ROW_BLOCK, ANCHOR_BLOCK = 16_384, 2_048
#: Components of a segment, level by level; then exact scores.
LEVELS = (64, 16, 4)
#: Sums up to here are exact in doubles.
_EXACT = 2.0**53


def summaries(vectors: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Means times the root of the segment's length, and deviations, of segments of `width` components."""
    rows, size = vectors.shape
    starts = np.arange(0, max(size, 1), width)
    if not size:
        return np.zeros((rows, 1)), np.zeros((rows, 1))
    length = np.diff(np.append(starts, size)).astype(np.float64)
    mean = np.add.reduceat(vectors, starts, axis=1) / length
    spread = vectors - np.repeat(mean, length.astype(int), axis=1)
    return mean * np.sqrt(length), np.sqrt(np.add.reduceat(spread * spread, starts, axis=1))


def bounds(left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest score of every pair of rows of the two sides, with room for rounding."""
    middle, reach = left[0] @ right[0].T, left[1] @ right[1].T
    room = 1e-9 * (np.abs(middle) + reach) + 1e-6
    return middle - reach - room, middle + reach + room


def scores(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Exact inner products of integer vectors held as doubles; Python integers where doubles could round."""
    if not left.size or not right.size:
        return np.zeros((len(left), len(right)), dtype=np.int64)
    most = float(np.abs(left).max()) * float(np.abs(right).max()) * left.shape[1]
    if most < _EXACT:
        return (left @ right.T).astype(np.int64)
    whole = [[[int(v) for v in row] for row in side] for side in (left, right)]
    return np.array([[sum(a * b for a, b in zip(x, y, strict=True)) for y in whole[1]] for x in whole[0]], dtype=np.int64)


def _matrix(column: pa.ChunkedArray, size: int) -> np.ndarray:
    """Rows of doubles, zeros behind shorter vectors."""
    lists = column.combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    n = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(n), size))
    row = np.repeat(np.arange(len(n)), n)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


class _Block:
    """Rows of a block: lines, ids, labels, vectors, and summaries of each level."""

    def __init__(self, table: pa.Table, size: int):
        self.line = table["line"].to_numpy().astype(np.int64)
        self.id = table["id"].to_numpy().astype(np.int64)
        self.label = table["label"].to_numpy().astype(np.int64)
        self.vector = _matrix(table["vector"], size)
        self.level = [summaries(self.vector, width) for width in LEVELS]

    def bounded(self, level: int, rows: np.ndarray, other: _Block, at: int) -> tuple[np.ndarray, np.ndarray]:
        mine, theirs = self.level[level], other.level[level]
        low, high = bounds((mine[0][rows], mine[1][rows]), (theirs[0][at : at + 1], theirs[1][at : at + 1]))
        return low[:, 0], high[:, 0]


def _size(*tables: pa.Table) -> int:
    return max([0, *(int(np.diff(t["vector"].combine_chunks().offsets.to_numpy()).max()) for t in tables if t.num_rows)])


def _positives(k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        out = {"anchor": [], "line": [], "id": [], "score": []}
        if rows.num_rows and anchors.num_rows:
            size = _size(rows, anchors)
            block, queries = _Block(rows, size), _Block(anchors, size)
            by_label = {label: np.flatnonzero(block.label == label) for label in np.unique(queries.label)}
            for q, (anchor, label) in enumerate(zip(queries.line.tolist(), queries.label.tolist(), strict=True)):
                open_ = by_label[label]
                open_ = open_[block.line[open_] != anchor]
                for level in range(len(LEVELS)):
                    if len(open_) <= 4 * k:
                        break
                    low, high = block.bounded(level, open_, queries, q)
                    open_ = open_[high >= np.partition(low, -k)[-k]]
                score = scores(block.vector[open_], queries.vector[q : q + 1])[:, 0]
                best = np.lexsort((block.line[open_], block.id[open_], -score))[:k]
                out["anchor"] += [anchor] * len(best)
                out["line"] += block.line[open_][best].tolist()
                out["id"] += block.id[open_][best].tolist()
                out["score"] += score[best].tolist()
        return pa.table({name: pa.array(values, pa.int64()) for name, values in out.items()})

    return run


def _negatives(k: int, low_pct: int, high_pct: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        out = {name: [] for name in ("anchor", "place", "line", "id", "score")}
        if rows.num_rows and anchors.num_rows:
            size = _size(rows, anchors)
            block, queries = _Block(rows, size), _Block(anchors, size)
            other = {label: np.flatnonzero(block.label != label) for label in np.unique(queries.label)}
            for q, found in enumerate(anchors["positive_scores"].to_pylist()):
                # scores are whole, so a window's ends are too
                windows = [(-(-low_pct * s // 100), high_pct * s // 100) for s in found]
                windows_open = [w for w in windows if w[0] <= w[1]]
                if not windows_open:
                    continue
                open_ = other[int(queries.label[q])]
                least, most = min(w[0] for w in windows_open), max(w[1] for w in windows_open)
                for level in range(len(LEVELS)):
                    if len(open_) <= 4 * k:
                        break
                    low, high = block.bounded(level, open_, queries, q)
                    possible = (high >= least) & (low <= most)
                    # k rows that are surely in a window, and above its lower end, leave out what is surely below them
                    needed = []
                    for a, b in windows_open:
                        sure = low[(low >= a) & (high <= b)]
                        needed.append(np.partition(sure, -k)[-k] if len(sure) >= k else a)
                    open_ = open_[possible & (high >= min(needed))]
                score = scores(block.vector[open_], queries.vector[q : q + 1])[:, 0]
                order = np.lexsort((block.line[open_], block.id[open_], -score))
                score, id_, line = score[order], block.id[open_][order], block.line[open_][order]
                for place, (a, b) in enumerate(windows):
                    start = int(np.searchsorted(-score, -b, side="left"))
                    stop = min(start + k, int(np.searchsorted(-score, -a, side="right")))
                    if start < stop:
                        out["anchor"] += [int(queries.line[q])] * (stop - start)
                        out["place"] += [place] * (stop - start)
                        out["line"] += line[start:stop].tolist()
                        out["id"] += id_[start:stop].tolist()
                        out["score"] += score[start:stop].tolist()
        kinds = {"place": pa.int32()}
        return pa.table({name: pa.array(values, kinds.get(name, pa.int64())) for name, values in out.items()})

    return run


def hard_negatives(
    rows: DataFrame, is_anchor: Column, id_column: str = "vec_id", vector_column: str = "embedding", label: Column | None = None,
    scale: int = 256, positives: int = 5, negatives: int = 3, low_percent: int = 50, high_percent: int = 95,
) -> DataFrame:
    """Per anchor and positive, ranked: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Components are floor(scale * x), scores inner products of them, which must fit in a long; higher ones come first, ties
    by the smaller id. An anchor's positives are its first other rows of its label; a positive's negatives the first rows
    of another label with low_percent * positive_score <= 100 * score <= high_percent * positive_score. label: an
    expression over rows, by default the column `label`. Rows with a null id, label, vector or component, or a component
    that isn't finite, take no part. A shorter vector scores as if zeros followed, an empty one 0. A repeated row or id
    counts as often as it comes, as an anchor too; other columns are ignored. is_anchor: null counts as false.
    """
    spark = rows.sparkSession
    label = F.col("label") if label is None else label
    marked = rows.select("*", label.cast("long").alias("__label"), F.coalesce(is_anchor, F.lit(False)).alias("__anchor"))
    plain = aliased(marked, {"id": id_column, "vector": vector_column, "label": "__label", "anchor": "__anchor"})
    whole = F.transform("vector", lambda x: F.floor(x.cast("double") * scale).cast("double"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    plain = plain.where("id is not null and label is not null and vector is not null").where(finite)
    plain = stage(plain.select(F.monotonically_increasing_id().alias("line"), "id", "label", "anchor", whole.alias("vector")))
    total, asked = plain.agg(F.count("*"), F.count_if("anchor")).first()
    blocks = max(3 * spark.sparkContext.defaultParallelism, -(-total // ROW_BLOCK))
    groups = max(1, -(-asked // ANCHOR_BLOCK))

    def dealt(salt: str, n: int) -> Column:
        return F.pmod(F.xxhash64("line", F.lit(salt)), F.lit(n)).cast("int")

    def every(name: str, n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)

    def met(asking: DataFrame, work: Callable, schema: str) -> DataFrame:
        sent = plain.select("line", "id", "label", "vector", dealt("row", blocks).alias("block"), every("part", groups))
        asking = asking.select("*", dealt("anchor", groups).alias("part"), every("block", blocks))
        return sent.groupBy("block", "part").cogroup(asking.groupBy("block", "part")).applyInArrow(work, schema)

    def first(found: DataFrame, keys: list[str], k: int) -> DataFrame:
        order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), "id", "line")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    anchors = plain.where("anchor").select("line", "id", "label", "vector")
    found = met(anchors, _positives(positives), "anchor long, line long, id long, score long")
    held = first(found, ["anchor"], positives).groupBy("anchor")
    held = held.agg(F.sort_array(F.collect_list(F.struct("rank", "id", "score"))).alias("held"))
    asking = stage(
        anchors.join(held, anchors["line"] == held["anchor"]).select(
            "line", "id", "label", "vector", F.col("held.id").alias("positives"), F.col("held.score").alias("positive_scores")
        )
    )
    work = _negatives(negatives, low_percent, high_percent)
    best = met(asking.drop("positives"), work, "anchor long, place int, line long, id long, score long")
    best = first(best, ["anchor", "place"], negatives).select("anchor", "place", "rank", F.col("id").alias("negative"), "score")
    named = asking.select(F.col("line").alias("anchor"), "id", "positives", "positive_scores")
    return best.join(named, "anchor").select(
        F.col("id").alias("anchor_id"),
        F.expr("positives[place]").alias("positive_id"),
        "rank",
        F.col("negative").alias("negative_id"),
        F.expr("positive_scores[place]").alias("positive_score"),
        F.col("score").alias("negative_score"),
    )
