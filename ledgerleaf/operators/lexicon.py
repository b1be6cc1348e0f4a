"""Lexicons and dictionaries that grow: what a workbook or source brings, templates that ship, states of batches. Each change gives the new table, to be written over the old."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import filled
from .reading import may_be_pending

# What names a header row, columns that a dictionary has, and words of rows that hold no values.
HEADER = ("BORNE", "SIGNAL")
KNOWN_COLUMNS = ("BORNE", "COULEUR", "SIGNAL", "JARRETIERES", "TENANT", "JAR", "ABOUTISSANT")
SPECIAL = ("NOM DU CABLE", "NO PLAN", "P.E.T", "M  T  I", "INDICE", "PAGE :", "BORNIER :")


def sheet_values(rows: DataFrame, sheet: list[str], header: tuple[str, ...] = HEADER, columns: tuple[str, ...] = KNOWN_COLUMNS) -> DataFrame:
    """sheet, row_idx, column, value of sheet rows (sheet, row_idx, cells) under the header last seen above them; special rows hold none."""
    cells = F.transform("cells", lambda c: F.trim(filled(c)))
    named = F.transform(cells, lambda c: F.upper(c))
    joined = F.upper(F.array_join(cells, " "))
    is_head = F.forall(F.array(*map(F.lit, header)), lambda h: F.array_contains(named, h))
    special = F.exists(F.array(*map(F.lit, SPECIAL)), lambda k: F.contains(joined, k))
    w = Window.partitionBy(*sheet).orderBy("row_idx").rowsBetween(Window.unboundedPreceding, 0)
    under = rows.withColumn("_head", is_head).withColumn("_names", F.last(F.when(is_head, named), ignorenulls=True).over(w)).withColumn("_cells", cells).where(~F.col("_head") & F.col("_names").isNotNull() & ~special)
    each = under.select(*sheet, "row_idx", F.explode(F.arrays_zip(F.col("_names").alias("column"), F.col("_cells").alias("value"))).alias("c")).select(*sheet, "row_idx", "c.*")
    return each.where(F.col("column").isin(*columns) & (F.coalesce("value", F.lit("")) != ""))


def new_values(rows: DataFrame, sheet: list[str], pending: DataFrame) -> DataFrame:
    """Values (column, value) that sheets bring and that neither wait for review yet nor are noise."""
    found = sheet_values(rows, sheet).where(may_be_pending(F.col("value"))).select("column", "value").distinct()
    return found.join(pending.select(F.upper("column").alias("column"), F.trim("value").alias("value")).distinct(), ["column", "value"], "left_anti")


def counts_per_column(values: DataFrame) -> DataFrame:
    """How many values each column has."""
    return values.groupBy("column").agg(F.countDistinct("value").alias("n"))


def without_named(templates: DataFrame, names: DataFrame, key: str = "name") -> DataFrame:
    """Templates but for the named ones; those that ship (shipped) cannot be deleted."""
    gone = names.select(F.col(key)).distinct().withColumn("_gone", F.lit(True))
    return templates.join(gone, key, "left").where(F.col("_gone").isNull() | F.col("shipped")).drop("_gone")


def put_named(templates: DataFrame, rows: DataFrame, key: str = "name") -> DataFrame:
    """Templates with ``rows`` in place of those of the same name; a shipped name stays a shipped one."""
    ships = templates.where("shipped").select(key).distinct().withColumn("_ships", F.lit(True))
    new = rows.join(ships, key, "left").withColumn("shipped", F.coalesce("_ships", F.lit(False))).drop("_ships")
    return templates.join(rows.select(key).distinct(), key, "left_anti").unionByName(new.select(*templates.columns))


def saved(templates: DataFrame) -> DataFrame:
    """What is written into the user's folder: nothing that ships."""
    return templates.where(~F.col("shipped"))


def added_sources(lexicon: DataFrame, incoming: DataFrame, replace: bool = False) -> DataFrame:
    """Per source of ``incoming`` (source, form): state (added, replaced or refused), how many forms it has, and how many of them the other sources lack."""
    there = lexicon.select("source").distinct().withColumn("_there", F.lit(True))
    forms = incoming.select("source", "form").distinct()
    held = lexicon.groupBy("form").agg(F.min("source").alias("_low"), F.max("source").alias("_high"))  # of another source than one's own, if any
    judged = forms.join(held, "form", "left").withColumn("_new", F.col("_low").isNull() | ((F.col("_low") == F.col("source")) & (F.col("_high") == F.col("source"))))
    out = judged.groupBy("source").agg(F.count("*").alias("forms"), F.sum(F.col("_new").cast("int")).alias("added")).join(there, "source", "left")
    return out.select("source", F.when(F.col("_there").isNull(), "added").when(F.lit(replace), "replaced").otherwise("refused").alias("state"), "forms", "added")


def compiled(sources: DataFrame, forms: Column, content: Column) -> DataFrame:
    """Per source its content's fingerprint and its forms, distinct and sorted."""
    return sources.select("source", F.sha2(content.cast("binary"), 256).alias("fingerprint"), F.sort_array(F.array_distinct(forms)).alias("forms"))


def record_states(states: DataFrame, rows: DataFrame, key: str = "batch") -> DataFrame:
    """States of batches (key, state, at) after ``rows``: the latest of each, but what was done once stays done."""
    every = states.select(key, "state", "at").unionByName(rows.select(key, "state", "at"))
    return every.groupBy(key).agg(F.max_by(F.struct("state", "at"), F.struct((F.col("state") == "done"), "at")).alias("s")).select(key, "s.*")


def to_resume(states: DataFrame, key: str = "batch") -> DataFrame:
    """Batches that are not done."""
    return states.where("state <> 'done'").select(key)
