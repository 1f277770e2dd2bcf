"""Row counts per slot for many columns in one hash aggregate.

One conditional count per column and slot makes the generated method too long for the JVM to
compile. Here the slots of up to four columns form one group key, so the aggregate stays small: it
has at most slots^4 groups per chunk of columns, whatever the row count.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Mapping
from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WIDTH = 4


def joint_counts(df: DataFrame, slots: Mapping[str, Column]) -> dict[str, dict[int, int]]:
    """{name: {slot: rows}}; a null slot is not counted. Slot expressions must take few values."""
    names = list(slots)
    chunks = [names[i : i + WIDTH] for i in range(0, len(names), WIDTH)]
    counts: dict[str, dict[int, int]] = {name: defaultdict(int) for name in names}
    if len(chunks) == 1:
        rows = df.select(*[slots[n].cast("int").alias(f"s{i}") for i, n in enumerate(names)])
        keys = [f"s{i}" for i in range(len(names))]
    else:
        cells = []
        for k, chunk in enumerate(chunks):
            padded = [slots[n].cast("int") for n in chunk] + [F.lit(None).cast("int")] * (WIDTH - len(chunk))
            cells.append(F.struct(F.lit(k).alias("k"), *[c.alias(f"s{i}") for i, c in enumerate(padded)]))
        rows = df.select(F.explode(F.array(*cells)).alias("c")).select("c.*")
        keys = ["k", *[f"s{i}" for i in range(WIDTH)]]
    for row in rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).collect():
        chunk = chunks[row["k"]] if len(chunks) > 1 else names
        for i, name in enumerate(chunk):
            slot = row[f"s{i}"]
            if slot is not None:
                counts[name][slot] += row["n"]
    return {name: dict(c) for name, c in counts.items()}


def position(value: Column, edges: list) -> Column:
    """Number of ascending edges at or below the value."""
    return reduce(lambda a, b: a + b, [(value >= F.lit(e)).cast("int") for e in edges], F.lit(0))


def _as_doubles(edges: list) -> bool:
    return all(abs(e) < 2**53 if isinstance(e, int) else math.isfinite(e) for e in edges)


def edge_counts(df: DataFrame, edges: Mapping[str, list], points: bool = False) -> dict[str, dict[int, int]]:
    """{column: {slot: rows}} where the slot is the number of ascending edges at or below the value.

    With points, an edge value has a slot of its own: odd slots are the edges, even ones the open
    ranges between them. Null and NaN are not counted.
    """
    slots, names, splits = {}, [], []
    for name, at in edges.items():
        if not _as_doubles(at):
            value = F.col(f"`{name}`")
            slot = position(value, at)
            if points:
                slot = slot + reduce(lambda a, b: a + b, [(value > F.lit(e)).cast("int") for e in at])
            slots[name] = F.when(value.isNotNull(), slot)
            continue
        cuts = [c for e in map(float, at) for c in ((e, math.nextafter(e, math.inf)) if points else (e,))]
        names.append(name)
        splits.append([-math.inf, *cuts, math.inf])
    if names:
        inputs = [f"_in{i}" for i in range(len(names))]
        outputs = [f"_slot{i}" for i in range(len(names))]
        values = df.select("*", *[F.col(f"`{n}`").cast("double").alias(c) for n, c in zip(names, inputs)])
        buckets = Bucketizer(inputCols=inputs, outputCols=outputs, splitsArray=splits, handleInvalid="keep")
        df = buckets.transform(values)
        for name, c, cuts in zip(names, outputs, splits):
            slots[name] = F.when(F.col(c) < len(cuts) - 1, F.col(c))
    return joint_counts(df, slots) if slots else {}
