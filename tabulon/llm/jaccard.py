"""N-gram Jaccard join: all links between documents, by a blocked sparse product of document by n-gram incidence.

The n-grams of a document are its rows' columns in one order for all documents: rare ones first, by the
logarithm of a count over SLOTS hashed slots, then by hash. The order decides only how much work there is. Of a row of
size n only the first n - ceil(s n) + SHARED columns are multiplied at first: two rows that overlap enough share SHARED of them
(or all that they overlap in, if that is less). A pair that shares fewer is discarded, and so is one whose sizes differ too much;
a shared column doesn't count if what both rows have from it on, and SHARED - 1 before, is less than the overlap that
their sizes ask for. What is left is multiplied whole, block by block, and
columns of many rows are multiplied with one of their rows first (see overlap.py), so frequent n-grams and large groups of
near copies make no square of pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.llm.overlap import digests, frequencies, grouped, least_size, parities, shingles
from tabulon.llm.text import SPACED, Words, aliased, list_array, slices
from tabulon.plans.stage import stage

#: Columns that the first ones of two linked rows have in common: one shared rare n-gram is often a chance.
SHARED = 3


def _prefix_batches(width: int, permille: int, level):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = least_size(permille)
        for batch in batches:
            for part in slices(batch.column("text")):
                row, value = shingles(Words(part, SPACED), width)
                n, d1, d2 = digests(row, value, part.rows)
                value = value[np.lexsort((value, level(value), row))]
                length = np.where(n >= least, np.minimum(n, n - -(-permille * n // 1000) + SHARED), 0)
                place = np.arange(len(row)) - (np.cumsum(n) - n)[row]
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(k).slice(part.start, part.rows) for k in ("line", "id")),
                        pa.array(n), pa.array(d1), pa.array(d2), parities(row, value, part.rows),
                        list_array(pa.array(value[place < length[row]].view(np.int64)), length),
                    ],
                    names=["line", "id", "n", "d1", "d2", "parity", "prefix"],
                )

    return run


def ngram_join(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = 3, similarity: float = 0.9
) -> DataFrame:
    """Per row: id, n_shingles (distinct) and component_id, the least id reachable over links.

    Words are runs of non-white-space of the text with A-Z lower-cased; a set is the distinct runs of `width` words, or
    the whole sequence if it has fewer. Two documents link if their sets' Jaccard similarity is at least `similarity`,
    (0.5 or more, in thousandths). Null, empty and blank texts have no n-gram and link with nothing. Rows come out as they
    come in, repeated rows and ids too; a null id takes part, and is a group's id only where no row of it has another.
    Other columns are ignored.
    """
    permille = round(1000 * similarity)
    if not 500 <= permille <= 1000:
        raise ValueError("similarities from 0.5 to 1 make sense here")
    plain = aliased(docs, {"id": id_column, "text": text_column})
    kind = plain.schema["id"].dataType.simpleString()
    level = frequencies(plain.select("text"), width)
    lined = plain.select(F.monotonically_increasing_id().alias("line"), "id", "text")
    sketched = stage(
        lined.mapInArrow(
            _prefix_batches(width, permille, level), f"line long, id {kind}, n long, d1 long, d2 long, parity array<long>, prefix array<long>"
        )
    )

    def members(leaders: DataFrame) -> DataFrame:
        given = F.size("prefix").cast("long").alias("given")
        return leaders.select("node", "n", given, F.posexplode("prefix").alias("place", "bucket")).select(
            "bucket", "node", "n", (F.col("n") - F.col("place") + (SHARED - 1)).alias("rest"), "given"
        )

    found = grouped(plain, sketched, "prefix", members, width, permille, SHARED)
    return found.select(F.col("id").alias(id_column), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))
