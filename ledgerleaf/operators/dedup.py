"""Deduplication and sets: by key, by tolerance, by size, and of bags of words."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .running import folded

FEW = 16  # kept points of a group that are looked at one after the other


def within_tolerance(rows: DataFrame, group: list[str], order: str, x: str, y: str, tolerance: float) -> DataFrame:
    """Greedy and in order: a row goes if a row kept before it (same group) lies within ``tolerance`` in x and y. Compared with kept rows only, so it is not transitive. The group is a text on a page."""
    width = max(tolerance, 1e-9)

    def start() -> Callable[[float, float], int]:
        kept: list[tuple[float, float]] = []
        cells: dict[tuple[float, float], list[tuple[float, float]]] = {}

        def keep(a: float, b: float) -> int:
            if not (math.isfinite(a) and math.isfinite(b)):
                return 1  # near nothing
            near: Iterable[tuple[float, float]] = kept
            if cells:
                gx, gy = a // width, b // width
                near = (p for i in (-1, 0, 1) for j in (-1, 0, 1) for p in cells.get((gx + i, gy + j), ()))
            for p, q in near:
                if abs(a - p) <= tolerance and abs(b - q) <= tolerance:
                    return 0
            kept.append((a, b))
            if len(kept) > FEW:  # from here on by cells as wide as the tolerance
                for p, q in kept if not cells else kept[-1:]:
                    cells.setdefault((p // width, q // width), []).append((p, q))
            return 1

        return keep

    return folded(rows, group, [order], [x, y], start, "_kept").where("_kept = 1").drop("_kept")


def first_of_each(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """Stable distinct: of equal keys the first row in order."""
    names = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.min_by(F.struct(*names), F.col(order)).alias("_r")).select(*key, "_r.*")


def bag(words: Column) -> Column:
    """array<struct<word, n>> of an array of words, sorted."""
    return F.transform(F.array_sort(F.array_distinct(words)), lambda w: F.struct(w.alias("word"), F.size(F.filter(words, lambda v: v == w)).alias("n")))


def bag_minus(a: Column, b: Column) -> Column:
    """Bag difference of two arrays of words: words of ``a`` beyond their count in ``b``, sorted, each as often as it is left."""
    return F.flatten(F.transform(F.array_sort(F.array_distinct(a)), lambda w: F.array_repeat(w, F.greatest(F.size(F.filter(a, lambda v: v == w)) - F.size(F.filter(b, lambda v: v == w)), F.lit(0)))))


def unseen(rows: DataFrame, cache: DataFrame, key: Column) -> DataFrame:
    """Rows whose content key (column key of ``cache``) is not cached yet."""
    return rows.withColumn("key", key).join(cache.select("key").distinct(), "key", "left_anti")


def same_signature(types: DataFrame, name: str, words: str) -> DataFrame:
    """Types whose sets of words equal another's: name, the first name of its class, and how many the class has. Classes, not pairs: they grow with the types only."""
    from pyspark.sql import Window

    w = Window.partitionBy("_s")
    s = types.select(F.col(name).alias("name"), F.sort_array(F.array_distinct(words)).alias("_s"))
    return s.withColumn("first", F.min("name").over(w)).withColumn("n", F.count("*").over(w)).where("n > 1").drop("_s")


def pack_in_order(rows: DataFrame, group: list[str], order: str, size: str, most: float) -> DataFrame:
    """Next-fit batches: a batch closes when it holds something and the next would exceed ``most``; an oversize item travels alone. A fold in order, per group."""
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        out, batch, held, n = [], 0, 0.0, 0
        for s in pdf[size]:
            if n and held + s > most:
                batch, held, n = batch + 1, 0.0, 0
            held, n = held + s, n + 1
            out.append(batch)
        return pdf.assign(batch=pd.Series(out, index=pdf.index, dtype="int32"))

    return rows.groupBy(*group).applyInPandas(run, kinds + ", batch int")


# Changes of keyed sets: each gives the new table, to be written over the old.


def add_values(known: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    return known.select(*key).unionByName(new.select(*key)).distinct()


def remove_values(known: DataFrame, gone: DataFrame, key: list[str]) -> DataFrame:
    return known.join(gone.select(*key).distinct(), key, "left_anti")


def accept_values(pending: DataFrame, known: DataFrame, chosen: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What is known now, what stays pending, and what is newly known."""
    moved = pending.join(chosen.select(*key).distinct(), key, "left_semi").select(*key).distinct()
    return add_values(known, moved, key), remove_values(pending, moved, key), remove_values(moved, known, key)


def upsert(table: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    return table.join(rows.select(*key).distinct(), key, "left_anti").unionByName(rows, allowMissingColumns=True)
