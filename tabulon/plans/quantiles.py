"""Exact order statistics of whole columns without a sort and without one big buffer.

`percentile` keeps every distinct value of a column in one aggregation buffer, which does not
hold for a continuous measure at scale. Here a first pass takes a mergeable quantile sketch whose
only use is to guess a narrow bracket around each wanted rank. A second pass counts the rows below
and inside each bracket, which proves the guess or sends that rank back to the full value range.
Brackets with few rows are then listed; larger ones are narrowed by histogram, one bin per pass.
Every pass is combined map-side; the driver sees bin counts and at most a few thousand values,
whatever the row count, and the result never depends on the sketch.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, StringType

from tabulon.plans.slots import edge_counts

BINS = 1024
LISTED = 10_000
SKETCH_K = 4096
MARGIN = 0.003  # rank share on each side of a guess; about twice the sketch error at this size
LONG_SPAN = 2**62


@dataclass
class Ranked:
    """Row count of a column (nulls and NaN left out), the values found at 0-based ranks, how many
    rows are smaller than or equal to each of them, and further aggregates of the first pass."""

    n: int
    at: dict[int, object]
    below: dict[int, int]
    equal: dict[int, int]
    low: object = None
    high: object = None
    extra: dict[str, object] = field(default_factory=dict)

    def quantile(self, prob: float) -> float | None:
        if self.n == 0:
            return None
        low, high, place = _positions(prob, self.n)
        a, b = float(self.at[low]), float(self.at[high])
        return a if low == high else (high - place) * a + (place - low) * b


@dataclass
class _Bracket:
    name: str
    low: object
    high: object
    below: int
    count: int
    ranks: list[int]


def numeric(df: DataFrame, name: str) -> Column:
    """The column as an ordered number: NaN becomes null, decimals become double."""
    kind = df.schema[name].dataType
    column = F.col(f"`{name}`")
    if isinstance(kind, (DoubleType, FloatType)):
        value = column.cast("double")
        return F.when(~F.isnan(value), value)
    if kind.typeName() in ("long", "integer", "short", "byte"):
        return column.cast("long")
    return column.cast("double")


def order_statistics(
    df: DataFrame,
    values: Mapping[str, Column],
    ranks: Mapping[str, Callable[[int], Iterable[int]]],
    hints: Mapping[str, Iterable[float]],
    bins: int = BINS,
    listed: int = LISTED,
    extras: Mapping[str, Callable[[Column], Column]] | None = None,
) -> dict[str, Ranked]:
    """Values at the given ranks of each expression.

    ranks are asked for once the row count is known; hints say at which shares they lie. extras are
    aggregates that the first pass takes along.
    """
    names = list(values)
    wide = df.select(*[values[name].alias(f"v{i}") for i, name in enumerate(names)])
    edges = {name: [(p - MARGIN, p + MARGIN) for p in sorted(set(hints[name]))] for name in names}
    found = _head(wide, names, dict(extras or {}))
    wanted = {name: sorted({r for r in ranks[name](found[name].n) if 0 <= r < found[name].n}) for name in names}
    sketched = _sketch(wide, names, edges, [n for n in names if wanted[n] and found[n].n > listed])
    todo: list[_Bracket] = []
    guesses: list[_Bracket] = []
    for name in names:
        r = found[name]
        for rank in wanted[name]:
            share = rank / max(1, r.n - 1)
            near = [j for j, (a, b) in enumerate(edges[name]) if a <= share <= b]
            if name not in sketched or not near:
                _add(todo, _Bracket(name, r.low, r.high, 0, r.n, [rank]))
                continue
            a, b = edges[name][near[0]]
            lo, hi = sketched[name][2 * near[0] : 2 * near[0] + 2]
            if isinstance(r.low, int):
                lo, hi = math.floor(lo), math.ceil(hi)
            lo = r.low if a <= 0 else max(r.low, lo)
            hi = r.high if b >= 1 else min(r.high, hi)
            _add(guesses, _Bracket(name, lo, hi, 0, r.n, [rank]))
    todo += _prove(wide, names, guesses, found)
    while todo:
        todo = _settle(todo, found)
        if not todo:
            break
        if all(b.count <= listed for b in todo):
            _list(wide, names, todo, found)
            break
        todo = _narrow(wide, names, todo, bins, listed)
    return found


def _add(brackets: list[_Bracket], new: _Bracket) -> None:
    for b in brackets:
        if (b.name, b.low, b.high) == (new.name, new.low, new.high):
            b.ranks += new.ranks
            return
    brackets.append(new)


def _head(wide, names, extras) -> dict[str, Ranked]:
    """Counts, extremes and further aggregates in one code-generated pass."""
    row = wide.agg(
        *[
            F.struct(
                F.count(f"v{i}").alias("n"),
                F.min(f"v{i}").alias("lo"),
                F.max(f"v{i}").alias("hi"),
                *[make(F.col(f"v{i}")).alias(f"x_{label}") for label, make in extras.items()],
            ).alias(f"v{i}")
            for i in range(len(names))
        ]
    ).first()
    return {
        name: Ranked(c["n"], {}, {}, {}, c["lo"], c["hi"], {label: c[f"x_{label}"] for label in extras})
        for name, c in zip(names, row)
    }


def _sketch(wide, names, edges, large) -> dict[str, list[float]]:
    """Guessed values at the bracket shares of the large columns.

    Sketches are object aggregates, which run uncompiled, so they have a pass of their own.
    """
    if not large:
        return {}
    index = {name: names.index(name) for name in large}
    sketched = wide.agg(
        *[F.kll_sketch_agg_double(F.col(f"v{i}").cast("double"), F.lit(SKETCH_K)).alias(f"s{i}") for i in index.values()]
    )
    cells = []
    for name, i in index.items():
        shares = F.array(*[F.lit(min(1.0, max(0.0, p))) for pair in edges[name] for p in pair])
        cells.append(F.kll_sketch_get_quantile_double(f"s{i}", shares).alias(f"q{i}"))
    return {name: list(q) for name, q in zip(large, sketched.select(*cells).first())}


def _prove(wide, names, guesses, found):
    """Count rows around the bracket edges; ranks on an edge value are done, strays get the full range."""
    if not guesses:
        return []
    edges = {n: sorted({e for b in guesses if b.name == n for e in (b.low, b.high)}) for n in names}
    found_slots = edge_counts(wide, {f"v{i}": edges[n] for i, n in enumerate(names) if edges[n]}, points=True)
    counts = {n: found_slots.get(f"v{i}", {}) for i, n in enumerate(names)}
    proven: list[_Bracket] = []
    for b in guesses:
        seen = 0
        spans = []
        for slot in range(2 * len(edges[b.name]) + 1):
            n = counts[b.name].get(slot, 0)
            spans.append((seen, n))
            seen += n
        first = 2 * edges[b.name].index(b.low) + 1
        last = 2 * edges[b.name].index(b.high) + 1
        start, end = spans[first][0], sum(spans[last])
        for rank in b.ranks:
            edge = next((k for k in range(1, len(spans), 2) if spans[k][0] <= rank < sum(spans[k])), None)
            if edge is not None:
                _note(found, b.name, rank, edges[b.name][edge // 2], *spans[edge])
            elif start <= rank < end:
                _add(proven, _Bracket(b.name, b.low, b.high, start, end - start, [rank]))
            else:
                r = found[b.name]
                _add(proven, _Bracket(b.name, r.low, r.high, 0, r.n, [rank]))
    return proven


def _note(found, name, rank, value, below, equal):
    r = found[name]
    r.at[rank], r.below[rank], r.equal[rank] = value, below, equal


def _settle(todo, found):
    """Drop brackets that hold a single value."""
    rest = []
    for b in todo:
        if b.low == b.high:
            for rank in b.ranks:
                _note(found, b.name, rank, b.low, b.below, b.count)
        else:
            rest.append(b)
    return rest


def _inside(names, b: _Bracket) -> tuple[Column, Column]:
    value = F.col(f"v{names.index(b.name)}")
    return value, (value >= F.lit(b.low)) & (value <= F.lit(b.high))


def _kind(b: _Bracket) -> str:
    return "double" if isinstance(b.low, float) else "long"


def _rows(wide, pieces):
    """One output row per (row, bracket) hit; rows outside every bracket are dropped first."""
    hits = [inside for inside, _ in pieces]
    cells = [F.when(inside, cell) for inside, cell in pieces]
    kept = wide.filter(reduce(lambda a, b: a | b, hits))
    return kept.select(F.explode(F.array_compact(F.array(*cells))).alias("p")).select("p.*")


def _narrow(wide, names, todo, bins, listed):
    kinds: dict[str, list] = {}
    for i, b in enumerate(todo):
        if b.count <= listed:
            continue
        value, inside = _inside(names, b)
        if isinstance(b.low, int) and b.high - b.low >= LONG_SPAN:
            offset, span = value.cast("double") - F.lit(float(b.low)), float(b.high) - float(b.low)
        else:
            offset, span = (value - F.lit(b.low)).cast("double"), float(b.high - b.low)
        slot = F.least(F.floor(offset / F.lit(span) * F.lit(float(bins))).cast("int"), F.lit(bins - 1))
        cell = F.struct(F.lit(i).alias("b"), slot.alias("slot"), value.alias("x"))
        kinds.setdefault(_kind(b), []).append((inside, cell))
    slots: dict[int, list] = {}
    for pieces in kinds.values():
        counted = (
            _rows(wide, pieces)
            .groupBy("b", "slot")
            .agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
        )
        for row in counted.collect():
            slots.setdefault(row["b"], []).append(row)
    narrowed = []
    for i, b in enumerate(todo):
        if i not in slots:
            narrowed.append(b)
            continue
        seen = b.below
        for row in sorted(slots[i], key=lambda r: r["slot"]):
            hit = [r for r in b.ranks if seen <= r < seen + row["n"]]
            if hit:
                narrowed.append(_Bracket(b.name, row["lo"], row["hi"], seen, row["n"], hit))
            seen += row["n"]
    return narrowed


def _list(wide, names, todo, found):
    kinds: dict[str, list] = {}
    for i, b in enumerate(todo):
        value, inside = _inside(names, b)
        cell = F.struct(F.lit(i).alias("b"), value.alias("x"))
        kinds.setdefault(_kind(b), []).append((inside, cell))
    values: dict[int, list] = {}
    for pieces in kinds.values():
        for row in _rows(wide, pieces).groupBy("b", "x").count().collect():
            values.setdefault(row["b"], []).append((row["x"], row["count"]))
    for i, b in enumerate(todo):
        seen = b.below
        for value, count in sorted(values[i]):
            for rank in b.ranks:
                if seen <= rank < seen + count:
                    _note(found, b.name, rank, value, seen, count)
            seen += count


def _positions(prob: float, n: int) -> tuple[int, int, float]:
    position = (n - 1) * prob
    return math.floor(position), math.ceil(position), position


def quantile_exprs(
    df: DataFrame, values: Mapping[str, Column], probs: Iterable[float], **limits
) -> dict[str, list[float | None]]:
    """Linear-interpolated quantiles of each expression."""
    probs = list(probs)

    def ranks(n):
        return [r for p in probs for r in _positions(p, n)[:2]]

    ranked = order_statistics(
        df, values, {name: ranks for name in values}, {name: probs for name in values}, **limits
    )
    return {name: [r.quantile(p) for p in probs] for name, r in ranked.items()}


def column_summaries(df: DataFrame, columns: Iterable[str], probs: Iterable[float], extras, **limits):
    """{column: Ranked} with quantile ranks and further aggregates from the same first pass."""
    probs = list(probs)

    def ranks(n):
        return [r for p in probs for r in _positions(p, n)[:2]]

    columns = list(columns)
    return order_statistics(
        df,
        {c: numeric(df, c) for c in columns},
        {c: ranks for c in columns},
        {c: probs for c in columns},
        extras=extras,
        **limits,
    )


def exact_quantiles(df: DataFrame, columns: Iterable[str], probs: Iterable[float], **limits):
    """{column: [quantile, ...]} over the whole table."""
    return quantile_exprs(df, {c: numeric(df, c) for c in columns}, probs, **limits)


def string_at_rank(df: DataFrame, column: str, rank: int, step: int = 1) -> str:
    """The string at a 0-based rank, found by extending a prefix a few characters per pass."""
    prefix, below = "", 0
    text = F.col(f"`{column}`")
    while True:
        size = len(prefix)
        counts = (
            df.filter(text.startswith(prefix))
            .groupBy(F.substring(text, size + 1, step).alias("part"))
            .agg(F.count(F.lit(1)).alias("n"), F.min(text).alias("lo"), F.max(text).alias("hi"))
            .collect()
        )
        for row in sorted(counts, key=lambda r: r["part"]):
            if rank < below + row["n"]:
                if row["lo"] == row["hi"]:
                    return row["lo"]
                prefix += row["part"]
                break
            below += row["n"]
        else:
            raise IndexError(f"rank {rank} is beyond the column")


def is_string(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, StringType)
