"""Quartile scores by rank and by value edges, without a global sort.

A rank quartile needs only the three rows that stand at the cut ranks. Each is found as an order
statistic of the metric and, among rows tied on the metric, of the key; every row then compares
itself with three constants.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.plans.quantiles import (
    exact_quantiles,
    is_string,
    numeric,
    order_statistics,
    string_at_rank,
)

CUTS = (0.25, 0.5, 0.75)


def _cut_ranks(n: int) -> list[int]:
    """0-based rank of the last row at or below each cut of 1 + (n - 1) q."""
    return [math.floor(1 + (n - 1) * q) - 1 for q in CUTS]


def rank_quartiles(df: DataFrame, metrics: list[str], key: str, **limits) -> dict[str, Column]:
    """Quartile 1..4 of the (metric, key) order for each metric; key must be unique."""
    values = {m: numeric(df, m) for m in metrics}
    cuts = order_statistics(
        df, values, {m: _cut_ranks for m in metrics}, {m: CUTS for m in metrics}, **limits
    )
    tied = sorted({(m, v) for m in metrics for v in cuts[m].at.values()})
    if not tied:
        return {m: F.lit(None).cast("int") for m in metrics}
    wanted = {
        (m, v): sorted({r - cuts[m].below[r] for r, at in cuts[m].at.items() if at == v}) for m, v in tied
    }
    ties = {(m, v): cuts[m].equal[r] for m in metrics for r, v in cuts[m].at.items()}
    keys = {}
    if is_string(df, key):
        for m, v in tied:
            same = df.filter(values[m] == F.lit(v))
            for r in wanted[(m, v)]:
                keys[(m, v, r)] = string_at_rank(same, key, r)
    else:
        key_value = numeric(df, key)
        exprs = {f"t{i}": F.when(values[m] == F.lit(v), key_value) for i, (m, v) in enumerate(tied)}
        ranked = order_statistics(
            df.filter(reduce(lambda a, b: a | b, [values[m] == F.lit(v) for m, v in tied])),
            exprs,
            {f"t{i}": (lambda n, w=wanted[t]: w) for i, t in enumerate(tied)},
            {f"t{i}": [r / max(1, ties[t] - 1) for r in wanted[t]] for i, t in enumerate(tied)},
            **limits,
        )
        for i, (m, v) in enumerate(tied):
            for r in wanted[(m, v)]:
                keys[(m, v, r)] = ranked[f"t{i}"].at[r]
    scores = {}
    for m in metrics:
        score = F.lit(1)
        for r in _cut_ranks(cuts[m].n):
            v = cuts[m].at[r]
            k = keys[(m, v, r - cuts[m].below[r])]
            after = (values[m] > F.lit(v)) | ((values[m] == F.lit(v)) & (F.col(f"`{key}`") > F.lit(k)))
            score = score + after.cast("int")
        scores[m] = score
    return scores


def edge_quartiles(df: DataFrame, metrics: list[str], quartiles: int = 4, **limits) -> dict[str, Column]:
    """Bin 1.. by value edges at equal quantiles; repeated edges are merged, lowest edge included."""
    probs = [i / quartiles for i in range(quartiles + 1)]
    edges = exact_quantiles(df, metrics, probs, **limits)
    scores = {}
    for m in metrics:
        inner = sorted({e for e in edges[m] if e is not None})[1:-1]
        score = F.lit(1)
        for edge in inner:
            score = score + (F.col(f"`{m}`") > F.lit(edge)).cast("int")
        scores[m] = F.when(F.col(f"`{m}`").isNotNull(), score)
    return scores
