"""Recency, frequency and monetary scoring of customers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabulon.plans.longform import ref
from tabulon.plans.quartiles import edge_quartiles, rank_quartiles
from tabulon.plans.stage import stage

DAY_MICROS = 86_400_000_000


def whole_days(later, earlier):
    """Whole 24-hour days between two timestamps, floored."""
    return F.floor((F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(DAY_MICROS)).cast("long")


def _customer_metrics(df: DataFrame, customer: str, date: str, amount: str, plus_days: int, reference=None):
    """One row per customer, staged; the snapshot date comes from these rows, not a second scan."""
    at = F.unix_micros(ref(date).cast("timestamp"))
    rows = df.select(ref(customer), at.alias("_at"), ref(amount).alias("_amount"))
    totals = stage(
        rows.groupBy(ref(customer)).agg(
            F.max("_at").alias("_last"),
            F.count("_at").alias("frequency"),
            F.round(F.sum("_amount"), 2).alias("monetary"),
        )
    )
    if reference is None:
        snapshot = F.lit(totals.agg(F.max("_last").alias("m")).first()["m"])
    else:
        snapshot = F.unix_micros(F.lit(reference).cast("timestamp"))
    recency = F.floor((snapshot + F.lit(plus_days * DAY_MICROS) - F.col("_last")) / F.lit(DAY_MICROS))
    return totals.select(ref(customer), recency.cast("long").alias("recency"), "frequency", "monetary")


def rfm_rank(df: DataFrame, customer: str, date: str, amount: str) -> DataFrame:
    """Scores from rank quartiles (ties by customer key); recency is reversed."""
    complete = df.select(customer, date, amount).na.drop()
    metrics = _customer_metrics(complete, customer, date, amount, plus_days=1)
    q = rank_quartiles(metrics, ["recency", "frequency", "monetary"], customer)
    scored = metrics.select(
        "*",
        (F.lit(5) - q["recency"]).alias("r_score"),
        q["frequency"].alias("f_score"),
        q["monetary"].alias("m_score"),
    )
    r, f, m = F.col("r_score"), F.col("f_score"), F.col("m_score")
    return scored.withColumn(
        "segment",
        F.when((r >= 4) & (f >= 4) & (m >= 4), "champions")
        .when((r >= 3) & (f >= 3), "loyal")
        .when((r == 4) & (f <= 2), "new_customers")
        .when((r <= 2) & (f >= 3), "at_risk")
        .otherwise("potential_loyalists"),
    )


def rfm_edges(
    df: DataFrame, customer: str, date: str, amount: str, quartiles: int = 4, reference=None
) -> DataFrame:
    """Scores from value edges, recency reversed, with the concatenated score and a segment."""
    metrics = _customer_metrics(df, customer, date, amount, plus_days=0, reference=reference)
    e = edge_quartiles(metrics, ["recency", "frequency", "monetary"], quartiles)
    scored = metrics.select(
        "*",
        (F.lit(quartiles + 1) - e["recency"]).alias("r_score"),
        e["frequency"].alias("f_score"),
        e["monetary"].alias("m_score"),
    )
    r, f, m = F.col("r_score"), F.col("f_score"), F.col("m_score")
    return scored.select(
        "*",
        F.concat(r.cast("string"), f.cast("string"), m.cast("string")).alias("rfm_score"),
        F.when((r >= 3) & (f >= 3) & (m >= 3), "Champions")
        .when((f >= 3) & (m >= 2), "Loyal")
        .when((r < 2) & (f >= 2) & (m >= 2), "At Risk")
        .when((r >= 2) & (f <= 2) & (m <= 2), "Need Attention")
        .otherwise("Lost")
        .alias("segment"),
    )


def segment_summary(scored: DataFrame) -> DataFrame:
    """Customers, mean and total value, and shares per segment, from rfm_rank or rfm_edges output.

    At most five segments exist, so the shares are taken over the grouped rows.
    """
    everything = Window.partitionBy(F.lit(1))
    grouped = scored.groupBy("segment").agg(
        F.count(F.lit(1)).alias("customers"),
        F.avg("monetary").alias("avg_monetary"),
        F.avg("frequency").alias("avg_frequency"),
        F.sum("monetary").alias("total_revenue"),
    )
    return grouped.select(
        "segment",
        "customers",
        F.round("avg_monetary", 2).alias("avg_monetary"),
        F.round("avg_frequency", 4).alias("avg_frequency"),
        F.round("total_revenue", 2).alias("total_revenue"),
        F.round(F.col("customers") * 100.0 / F.sum("customers").over(everything), 4).alias("customer_pct"),
        F.round(F.col("total_revenue") * 100.0 / F.sum("total_revenue").over(everything), 4).alias("revenue_pct"),
    )
