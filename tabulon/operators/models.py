"""Shared preparation of model inputs: training medians, training scale, repeatable split."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.errors import InsufficientDataError
from tabulon.plans.longform import ref
from tabulon.plans.quantiles import column_summaries


@dataclass
class Preparation:
    """Medians, means and population spreads taken from the training rows."""

    features: list[str]
    medians: list[float]
    means: list[float]
    spreads: list[float]

    def scaled(self) -> list[Column]:
        return [
            (F.coalesce(ref(c).cast("double"), F.lit(med)) - F.lit(m)) / F.lit(s)
            for c, med, m, s in zip(self.features, self.medians, self.means, self.spreads)
        ]

    def vector(self) -> Column:
        return array_to_vector(F.array(*self.scaled()))


def prepare(train: DataFrame, features: list[str]) -> Preparation:
    values = [ref(c).cast("double") for c in features]
    row = train.agg(
        *[
            F.struct(
                F.avg(x).alias("m"), F.stddev_pop(x).alias("s"), F.count_if(x.isNull() | F.isnan(x)).alias("gaps")
            ).alias(f"c{i}")
            for i, x in enumerate(values)
        ],
        F.count(F.lit(1)).alias("rows"),
    ).first()
    if row["rows"] and not any(r["gaps"] for r in row[:-1]):  # no cell needs a median
        return Preparation(features, [0.0] * len(features), [r["m"] for r in row[:-1]], [r["s"] or 1.0 for r in row[:-1]])
    found = column_summaries(train, features, (0.5,), {"m": F.avg, "s": F.stddev_pop, "nulls": _nulls})
    medians = [found[c].quantile(0.5) or 0.0 for c in features]
    if all(found[c].n == 0 for c in features):
        raise InsufficientDataError("training rows", 1, 0)
    moments = [(found[c].extra["m"], found[c].extra["s"]) for c in features]
    if any(found[c].extra["nulls"] for c in features):
        filled = [F.coalesce(ref(c).cast("double"), F.lit(m)) for c, m in zip(features, medians)]
        row = train.agg(
            *[F.struct(F.avg(x).alias("m"), F.stddev_pop(x).alias("s")).alias(f"c{i}") for i, x in enumerate(filled)]
        ).first()
        moments = [(r["m"], r["s"]) for r in row]
    return Preparation(features, medians, [m for m, _ in moments], [s or 1.0 for _, s in moments])


def unscaled(features: list[str]) -> Preparation:
    """The columns as they are; for complete columns."""
    n = len(features)
    return Preparation(features, [0.0] * n, [0.0] * n, [1.0] * n)


def _nulls(c: Column) -> Column:
    return F.count_if(c.isNull())


def hash_flag(key: list[str], train_pct: int = 80, seed: int = 42) -> Column:
    """True on the training rows; depends on the key only, so every pass splits alike."""
    return F.pmod(F.xxhash64(*[ref(k) for k in key], F.lit(seed)), F.lit(100)) < train_pct
