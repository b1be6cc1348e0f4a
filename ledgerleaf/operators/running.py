"""Running totals over a whole table without one task that reads all of it, and folds in order over many groups."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def running_total(rows: DataFrame, order: str, value: str, name: str, tie: tuple[str, ...] = (), parts: int | None = None) -> DataFrame:
    """``rows`` with ``name``: the sum of ``value`` up to and with the row, in order of a numeric column and its ties.

    The order is cut at approximate quantiles (a number for each part), totals run within each part, and what the
    parts before add up to (a row for each part) is joined by broadcast. Wherever the cuts fall, the sums are the same.
    """
    n = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = sorted(set(rows.approxQuantile(order, [k / n for k in range(1, n)], 0.5 / n))) if n > 1 else []
    part = F.size(F.filter(F.array(*[F.lit(float(c)) for c in cuts]), lambda c: c < F.col(order).cast("double"))) if cuts else F.lit(0)
    keyed = rows.withColumn("_part", part)
    earlier = F.coalesce(F.sum("_sum").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before = keyed.groupBy("_part").agg(F.sum(value).alias("_sum")).select("_part", earlier.alias("_before"))
    w = Window.partitionBy("_part").orderBy(order, *tie).rowsBetween(Window.unboundedPreceding, 0)
    return keyed.join(F.broadcast(before), "_part").withColumn(name, F.sum(value).over(w) + F.col("_before")).drop("_part", "_before")


def folded(rows: DataFrame, group: list[str], order: list[str], values: list[str], start: Callable[[], Callable[..., int]], name: str) -> DataFrame:
    """``rows`` with ``name`` (int): what a fold gives for each row, per group and in order (nulls last). ``start`` makes the fold of a group, which gets the row's ``values`` as doubles (null: NaN).

    The window leaves the rows of a task sorted, so all its groups pass one after the other through one function, and
    a group costs no call of its own, nor memory but what its fold keeps.
    """
    n = len(rows.columns)
    w = Window.partitionBy(*group).orderBy(*[F.col(c).asc_nulls_last() for c in order])
    sent = rows.select("*", *[F.col(v).cast("double").alias(f"_fold_{k}") for k, v in enumerate(values)], (F.row_number().over(w) == 1).alias("_fold_opens"))
    names = [*rows.columns, name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = None
        for batch in batches:
            out = []
            for opens, *now in zip(batch.column(n + len(values)).to_pylist(), *[batch.column(n + k).to_numpy(zero_copy_only=False).tolist() for k in range(len(values))]):
                if opens:
                    step = start()
                out.append(step(*now))
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(out, pa.int32())], names)

    return sent.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + f", `{name}` int")
