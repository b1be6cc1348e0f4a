"""Campaign measures, costs, estimates and robust statistics."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What reading from and writing to a prompt cache costs of the input price; the discount of batches; fallbacks of estimates.
CACHE_READ, CACHE_WRITE, BATCH = 0.10, 1.25, 0.5
TOKENS_PER_PAGE = (6300, 350)
SECONDS_PER_PAGE = 8.0


def cost(usage: DataFrame, prices: DataFrame, key: str, batch: bool = False) -> DataFrame:
    """``usage`` (input, output, cache_read, cache_write tokens) with its cost by ``prices`` (key, price_in, price_out per million, cache_read_share). Prices are one row per model."""
    priced = usage.join(F.broadcast(prices), key)
    read = F.coalesce("cache_read_share", F.lit(CACHE_READ))
    usd = ((F.col("input") + F.col("cache_write") * CACHE_WRITE + F.col("cache_read") * read) * F.col("price_in") + F.col("output") * F.col("price_out")) / 1e6
    return priced.withColumn("cost", usd * (BATCH if batch else 1.0)).drop("price_in", "price_out", "cache_read_share")


def campaign(passes: DataFrame, by: list[str], value: str, usd: str) -> DataFrame:
    """Per group and in total (grouping sets): passes, mean, spread and sum of ``value``, mean cost. ``is_total`` marks the grand total."""
    sets = [[F.col(c) for c in by], []]
    return passes.groupingSets(sets, *[F.col(c) for c in by]).agg(F.count("*").alias("passes"), F.avg(value).alias("mean_value"), (F.max(value) - F.min(value)).alias("spread"), F.sum(value).alias("sum_value"), F.avg(usd).alias("mean_cost"), (F.grouping(by[0]) == 1).alias("is_total"))


def under_budget(passes: DataFrame, group: list[str], order: list[str], usd: str, budget: float) -> DataFrame:
    """Passes that start while what was spent before them is under the budget."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return passes.withColumn("spent_before", F.coalesce(F.sum(usd).over(w), F.lit(0.0))).where(F.col("spent_before") < budget)


def estimate(pages: DataFrame, doc: str, nature: str, read: list[str], tokens: tuple[int, int] = TOKENS_PER_PAGE, seconds: float = SECONDS_PER_PAGE) -> DataFrame:
    """Per document: pages, pages to read (of the natures ``read``), tokens and seconds that takes."""
    n = F.sum(F.col(nature).isin(*read).cast("int"))
    return pages.groupBy(doc).agg(F.count("*").alias("pages"), n.alias("to_read"), (n * tokens[0]).alias("input_tokens"), (n * tokens[1]).alias("output_tokens"), (n * seconds).alias("seconds"))


def natures(pages: DataFrame, doc: str, nature: str, kinds: list[str]) -> DataFrame:
    """Per document, how many pages are of each kind."""
    return pages.groupBy(doc).agg(*[F.count(F.when(F.col(nature) == k, 1)).alias(k) for k in kinds])


def fallback_mean(*tables: tuple[DataFrame, str]) -> Column:
    """The mean of the first table that has any rows, as a chain of scalar subqueries would give: each is one aggregated row."""
    means = [df.agg(F.avg(c)).first()[0] for df, c in tables]  # one row each
    return F.lit(next((m for m in means if m is not None), SECONDS_PER_PAGE))


def theil_sen(rows: DataFrame, group: list[str], rank: str, y: str, least: int = 3) -> DataFrame:
    """Median of the slopes between the medians of ranks that hold ``least`` rows or more. Ranks of a group are lines of a page: few, and self-joined within it only."""
    mid = rows.groupBy(*group, rank).agg(F.median(y).alias("_m"), F.count("*").alias("_n")).where(F.col("_n") >= least)
    a, b = mid.select(*group, F.col(rank).alias("_a"), F.col("_m").alias("_ma")), mid.select(*group, F.col(rank).alias("_b"), F.col("_m").alias("_mb"))
    return a.join(b, group).where("_a < _b").groupBy(*group).agg(F.median((F.col("_mb") - F.col("_ma")) / (F.col("_b") - F.col("_a"))).alias("slope"))


def best_period(rows: DataFrame, group: list[str], x: str, periods: list[float]) -> DataFrame:
    """The period whose resultant |sum of e^(2 pi i x / p)| is longest; the smaller of equals. Candidates are a short list, applied as columns and not as a join."""
    out = rows.select(*group, F.col(x).alias("_x"), F.explode(F.array(*[F.lit(float(p)) for p in periods])).alias("period"))
    angle = 2 * math.pi * F.col("_x") / F.col("period")
    length = F.sqrt(F.pow(F.sum(F.cos(angle)), 2) + F.pow(F.sum(F.sin(angle)), 2))
    scored = out.groupBy(*group, "period").agg(length.alias("length"), F.count("*").alias("n"))
    return scored.groupBy(*group).agg(F.max(F.struct(F.round("length", 6).alias("length"), (-F.col("period")).alias("p"))).alias("b")).select(*group, (-F.col("b.p")).alias("period"), F.col("b.length").alias("length"))


def variation(rows: DataFrame, group: list[str], order: str) -> DataFrame:
    """Population coefficient of variation of the gaps between ordered values: what tells a dash pattern."""
    gap = F.col(order) - F.lag(order).over(Window.partitionBy(*group).orderBy(order))
    return rows.withColumn("_g", gap).where("_g IS NOT NULL").groupBy(*group).agg((F.stddev_pop("_g") / F.avg("_g")).alias("variation"), F.count("*").alias("gaps"))


def common_gap(rows: DataFrame, group: list[str], order: str) -> DataFrame:
    """The most frequent gap between ordered values, the first seen of equals."""
    w = Window.partitionBy(*group).orderBy(order)
    some = rows.withColumn("_g", F.col(order) - F.lag(order).over(w)).withColumn("_i", F.row_number().over(w)).where("_g IS NOT NULL")
    counts = some.groupBy(*group, F.col("_g").alias("gap")).agg(F.count("*").alias("n"), F.min("_i").alias("_f"))
    return counts.withColumn("_p", F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("n"), "_f"))).where("_p = 1").select(*group, "gap", "n")


def fill_rate(cells: DataFrame, by: list[str]) -> DataFrame:
    return cells.groupBy(*by).agg(F.avg((F.trim(F.coalesce("value", F.lit(""))) != "").cast("double")).alias("fill_rate"), F.count("*").alias("cells"))


def sample_indices(n: int, k: int) -> list[int]:
    """Up to ``k`` distinct evenly spaced places of ``n``."""
    return list(range(n)) if n <= k else sorted({round(i * (n - 1) / (k - 1)) for i in range(k)}) if k > 1 else [0]


def sweep(alerts: DataFrame, score: str, truth: str, thresholds: list[float]) -> DataFrame:
    """For each threshold, true and false alerts at or above it and misses below: thresholds are a short list applied as an array."""
    some = alerts.select(F.col(score).alias("_s"), F.col(truth).alias("_t"), F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("threshold"))
    n = lambda c: F.sum(c.cast("int"))
    return some.groupBy("threshold").agg(n((F.col("_s") >= F.col("threshold")) & F.col("_t")).alias("true_alerts"), n((F.col("_s") >= F.col("threshold")) & ~F.col("_t")).alias("false_alerts"), n((F.col("_s") < F.col("threshold")) & F.col("_t")).alias("missed"))
