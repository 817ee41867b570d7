"""Summaries of runs: rates, scaling, and time left."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def steady(log: DataFrame, run: str, order: list[str], skip: int = 1) -> DataFrame:
    """log without the first rows of each run, unless that leaves none."""
    by_run = Window.partitionBy(run)
    rows = log.withColumns({"__n": F.row_number().over(by_run.orderBy(*order)), "__all": F.count("*").over(by_run)})
    return rows.filter((F.col("__n") > skip) | (F.col("__all") <= skip)).drop("__n", "__all")


def run_summary(log: DataFrame, run: str, rate: str, order: list[str], skip: int = 1) -> DataFrame:
    """Rows, steady rows, and the median and mean rate of each run."""
    every = log.groupBy(run).agg(F.count("*").alias("logs"))
    rates = steady(log, run, order, skip).groupBy(run).agg(F.count("*").alias("steady_logs"), F.median(rate).alias("median_rate"), F.avg(rate).alias("mean_rate"))
    return every.join(rates, run)


def scaling_summary(runs: DataFrame, devices: str = "devices", rate: str = "median_rate") -> DataFrame:
    """runs with speed-up, efficiency and increments over the run of fewest devices and over the one before.

    runs has one row a device count.
    """
    order = Window.orderBy(devices)
    base_rate, base_devices = F.first(rate).over(order), F.first(devices).over(order)
    each = base_rate / base_devices
    before, fewer = F.lag(rate).over(order), F.lag(devices).over(order)
    least = F.lit(1e-9)
    return runs.withColumns(
        {
            "speedup": F.round(F.col(rate) / F.greatest(base_rate, least), 3),
            "efficiency_percent": F.round(100 * F.col(rate) / F.greatest(each * F.col(devices), least), 1),
            "incremental_rate": F.coalesce(F.round(F.col(rate) - before, 2), F.lit(0.0)),
            "incremental_percent": F.round(100 * (F.col(rate) - before) / F.greatest(each * (F.col(devices) - fewer), least), 1),
        }
    )


def weighted_eta(counts: DataFrame, rates: DataFrame, bucket: str = "bucket") -> DataFrame:
    """Hours for counts (bucket, n) at rates (bucket, rate); none while a bucket has no rate."""
    rows = counts.join(rates, bucket, "left")
    seconds = F.sum(F.col("n") / F.greatest(F.col("rate"), F.lit(1e-9)))
    missing = F.count_if(F.col("rate").isNull())
    return rows.agg(
        F.when((missing == 0) & (seconds > 0), F.round(seconds / 3600, 3)).alias("hours"),
        F.when((missing == 0) & (seconds > 0), F.round(F.sum("n") / seconds, 2)).alias("examples_per_s"),
        missing.alias("missing_buckets"),
    )


def eta_hours(examples: Column, rate: Column) -> Column:
    return F.when(rate > 0, F.round(examples / rate / 3600, 3))


def key_rollup(rows: DataFrame, json: str) -> DataFrame:
    """Sums of the whole numbers in JSON objects by key."""
    pairs = rows.select(F.explode(F.from_json(json, "map<string,string>")).alias("key", "value"))
    number = F.col("value").try_cast("long")
    return pairs.filter(number.isNotNull()).groupBy("key").agg(F.sum(number).alias("total"), F.count("*").alias("values"))


def seq_len_summary(log: DataFrame, run: str, order: list[str], skip: int = 1) -> DataFrame:
    """Steady logs and median rates of each run by sequence length."""
    rows = steady(log.filter("event = 'train'"), run, order, skip)
    step = F.coalesce("step_s", "batch_s", F.lit(0.0))
    return rows.groupBy(run, "seq_len").agg(
        F.count("*").alias("logs"),
        *(F.median(c).alias(f"median_{c}") for c in ("examples_per_s", "tokens_per_s", "batch_s")),
        F.median(F.coalesce("loader_s", F.lit(0.0))).alias("median_loader_s"),
        F.median(step).alias("median_step_s"),
    )


def markdown(table: DataFrame, order: str) -> str:
    """A small summary as a Markdown table."""
    rows = [[*table.columns], ["-"] * len(table.columns), *(["" if v is None else str(v) for v in r] for r in table.orderBy(order).toLocalIterator())]
    return "\n".join(f"| {' | '.join(r)} |" for r in rows) + "\n"
