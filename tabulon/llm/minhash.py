"""Near-duplicate groups by fast similarity sketches, banding and exact verification.

A sketch has BANDS x ROWS coordinates. In round i every shingle falls into a random bin with a random
value of [i, i + 1), and a bin keeps its least value, so bins that an earlier round filled stay as they
are; in round COORDINATES + j all shingles fall into bin j, so that after twice as many rounds no bin is
empty. Coordinates of two sets agree with a chance of their Jaccard similarity. Documents whose
ROWS coordinates of a band agree share a bucket: at a similarity of 0.85 all 36 bands miss with a chance
of 1e-6, at 0.9 of 1e-10. Pairs are confirmed on the full shingle sets.

Documents of one shingle set are one class from the start. Members of small buckets are compared pair by pair, those of
large ones with a hub first, and again only where a link can still be missed (see overlap.py): all links between
members of a bucket are joined, with no cap on buckets and without forming all pairs of a large one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.llm.overlap import digests, grouped, least_size, parities, shingles
from tabulon.llm.text import SPACED, Words, aliased, list_array, mix, slices
from tabulon.plans.stage import stage

BANDS, ROWS = 36, 7
COORDINATES = BANDS * ROWS
WIDTH = 5
_EMPTY = np.uint64((1 << 64) - 1)
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def sketches(row: np.ndarray, value: np.ndarray, rows: int) -> np.ndarray:
    """(rows, COORDINATES) sketch of each row's set; rows without a shingle stay empty."""
    table = np.full(rows * COORDINATES, _EMPTY, dtype=np.uint64)
    for i in range(2 * COORDINATES):
        if not len(row):
            break
        x = mix(value + np.uint64((i + 1) * int(_GOLDEN) % (1 << 64)))
        if i < COORDINATES:
            at = row * COORDINATES + (((x >> np.uint64(32)) * np.uint64(COORDINATES)) >> np.uint64(32)).astype(np.int64)
        else:
            at = row * COORDINATES + (i - COORDINATES)
        np.minimum.at(table, at, (np.uint64(i) << np.uint64(48)) | (mix(x) >> np.uint64(16)))
        open_rows = (table.reshape(rows, COORDINATES) == _EMPTY).any(axis=1)
        still = open_rows[row]
        if not still.all():
            row, value = row[still], value[still]
    return table.reshape(rows, COORDINATES)


def _band_hashes(table: np.ndarray) -> np.ndarray:
    parts = table.reshape(len(table), BANDS, ROWS)
    out = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(table), BANDS))
    for j in range(ROWS):
        out = mix(out * _GOLDEN + parts[:, :, j])
    return out


def _sketch_batches(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column("text")):
                row, value = shingles(Words(part, SPACED), WIDTH)
                n, d1, d2 = digests(row, value, part.rows)
                wide = n >= least
                place = np.cumsum(wide) - 1
                used = wide[row]
                bands = _band_hashes(sketches(place[row[used]], value[used], int(wide.sum())))
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(k).slice(part.start, part.rows) for k in ("line", "id")),
                        pa.array(n),
                        pa.array(d1),
                        pa.array(d2),
                        parities(row, value, part.rows),
                        list_array(pa.array(bands.reshape(-1).view(np.int64)), np.where(wide, BANDS, 0)),
                    ],
                    names=["line", "id", "n", "d1", "d2", "parity", "bands"],
                )

    return run


def _groups(lined: DataFrame, similarity: float) -> DataFrame:
    """line, id, n, component and first of rows (line, id, text)."""
    if similarity < 0.8:
        raise ValueError("the bands are laid out for similarities of 0.8 or more")
    permille = round(1000 * similarity)
    kind = lined.schema["id"].dataType.simpleString()
    shape = f"line long, id {kind}, n long, d1 long, d2 long, parity array<long>, bands array<long>"
    sketched = stage(lined.mapInArrow(_sketch_batches(least_size(permille)), shape))

    def members(leaders: DataFrame) -> DataFrame:
        return leaders.select(F.explode("bands").alias("bucket"), "node", "n", F.col("n").alias("rest"), F.lit(BANDS).cast("long").alias("given"))

    return grouped(lined.select("id", "text"), sketched, "bands", members, WIDTH, permille)


def near_duplicates(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", similarity: float = 0.85
) -> DataFrame:
    """Per row: id, n_shingles (distinct), component_id (least id reachable over links) and kept.

    Words are runs of non-white-space of the text with A-Z lower-cased. Null, empty and blank texts have no
    shingle and link with nothing. Rows come out as they come in, repeated rows and ids too, each by its own text; kept
    says that the row's id is its group's. A null id takes part, and names a group only where no row of it has
    another id; such rows are kept. Other columns are ignored. similarity: 0.8 or more.
    """
    plain = aliased(docs, {"id": id_column, "text": text_column})
    found = _groups(plain.select(F.monotonically_increasing_id().alias("line"), "id", "text"), similarity)
    return found.select(
        F.col("id").alias(id_column),
        F.col("n").alias("n_shingles"),
        F.col("component").alias("component_id"),
        F.col("id").eqNullSafe(F.col("component")).alias("kept"),
    )


def representatives(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", similarity: float = 0.85
) -> DataFrame:
    """The rows of docs that stay, with all columns: one of every group, that with the least id (ids before nulls).

    Of a repeated row one stays. Rows without words are no copies of one another and stay all.
    """
    rows = stage(docs.withColumn("__line", F.monotonically_increasing_id()))
    lined = aliased(rows, {"line": "__line", "id": id_column, "text": text_column})
    go = stage(_groups(lined, similarity).where("line <> first").select(F.col("line").alias("__line")))
    return rows.join(go, "__line", "left_anti").select(*docs.columns)
