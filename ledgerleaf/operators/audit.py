"""Audits of delivered blocks, footers of pages, and logs: duplicates, majorities, fills and replays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import compact, filled
from .running import running_total

# Marks that stand for "no signal"; the longest colour code.
NO_SIGNAL = ("-", "NC", "N/C", "N.C.")
LONGEST_COLOUR = 8


def duplicates(rows: DataFrame, block: list[str], value: str, row: str, ignore: tuple[str, ...] = ()) -> DataFrame:
    """Values that repeat within a block, with their rows in order; ``ignore`` (NO_SIGNAL for signals) does not count."""
    some = rows.where(F.trim(filled(F.col(value).cast("string"))) != "")
    if ignore:
        some = some.where(~F.upper(F.trim(F.col(value).cast("string"))).isin(*ignore))
    return some.groupBy(*block, value).agg(F.count("*").alias("n"), F.sort_array(F.collect_list(row)).alias("rows")).where("n > 1")


def pages_in_blocks(blocks: DataFrame, page: str, block: str) -> DataFrame:
    """Blocks without a page number, and page numbers that several blocks carry."""
    blank = F.trim(filled(F.col(page).cast("string"))) == ""
    missing = blocks.where(blank).select(F.lit("missing").alias("alert"), F.lit("").alias("page"), F.array(F.col(block)).alias("blocks"))
    several = blocks.where(~blank).groupBy(F.col(page).cast("string").alias("page")).agg(F.sort_array(F.collect_set(block)).alias("blocks")).where(F.size("blocks") > 1)
    return missing.unionByName(several.select(F.lit("several").alias("alert"), "page", "blocks"))


def bad_colours(cells: DataFrame, colours: DataFrame) -> DataFrame:
    """Colour cells longer than a code that the list (colour) lacks."""
    return cells.where(F.length(F.trim("value")) > LONGEST_COLOUR).join(colours.select(F.upper("colour").alias("_c")).distinct(), F.upper(F.trim("value")) == F.col("_c"), "left_anti")


def first_bad_word(value: Column, pattern: str) -> Column:
    """The first word of a cell that does not match; null if all do."""
    return F.get(F.filter(F.split(F.trim(filled(value)), r"\s+"), lambda w: (w != "") & ~F.rlike(w, F.lit(f"^(?:{pattern})$"))), F.lit(0))


def majority(rows: DataFrame, group: list[str], value: str, order: str) -> DataFrame:
    """The most frequent non-blank compacted value of a group; of equally frequent ones, the one seen first. group, majority, n."""
    counts = rows.where(compact(F.col(value).cast("string")) != "").groupBy(*group, compact(F.col(value).cast("string")).alias("majority")).agg(F.count("*").alias("n"), F.min(order).alias("_first"))
    w = Window.partitionBy(*group).orderBy(F.desc("n"), "_first", "majority")
    return counts.withColumn("_place", F.row_number().over(w)).where("_place = 1").select(*group, "majority", "n")


def minority(rows: DataFrame, group: list[str], value: str, order: str) -> DataFrame:
    """Rows whose non-blank value is not the majority's."""
    own = compact(F.col(value).cast("string"))
    return rows.join(majority(rows, group, value, order), group).where((own != "") & (own != F.col("majority")))


def fill_unanimous(rows: DataFrame, group: list[str], value: str, order: str) -> DataFrame:
    """Blank values of a group whose other values all agree (compacted) are filled with the first of them; filled says where. A single dissenter among two values or more is marked outlier."""
    w = Window.partitionBy(*group)
    own = compact(F.col(value))
    given = F.when(own != "", own)
    kinds = F.size(F.collect_set(given).over(w))
    first = F.first(F.when(own != "", F.col(value)), ignorenulls=True).over(w.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    n, mine = F.count(given).over(w), F.count(given).over(Window.partitionBy(*group, own))
    return (
        rows.withColumn("_kinds", kinds).withColumn("_first", first).withColumn("_n", n).withColumn("_mine", mine).withColumn("filled", (own == "") & (F.col("_kinds") == 1))
        .withColumn("outlier", (own != "") & (F.col("_kinds") == 2) & (F.col("_mine") == 1) & (F.col("_n") > 2))
        .withColumn(value, F.when(F.col("filled"), F.col("_first")).otherwise(F.col(value)))
        .drop("_kinds", "_first", "_n", "_mine")
    )


def number_if_none(rows: DataFrame, group: list[str], label: str, order: str) -> DataFrame:
    """Groups in which no row has a label are numbered from 1 in order."""
    w = Window.partitionBy(*group)
    none = F.max(F.when(F.trim(filled(F.col(label).cast("string"))) != "", 1)).over(w).isNull()
    return rows.withColumn("_none", none).withColumn("_n", F.row_number().over(w.orderBy(order))).withColumn(label, F.when(F.col("_none"), F.col("_n").cast("string")).otherwise(F.col(label))).drop("_none", "_n")


def replay(log: DataFrame, key: str, success: str, order: str) -> DataFrame:
    """For each key the last success, else the last failure, in the order of first appearance; entries without a key each stand alone."""
    alone = F.when(F.col(key).isNull(), F.col(order).cast("string"))
    w = Window.partitionBy(key, alone)
    return log.withColumn("first_seen", F.min(order).over(w)).withColumn("_place", F.row_number().over(w.orderBy(F.col(success).desc(), F.col(order).desc()))).where("_place = 1").drop("_place")


def gaps(log: DataFrame, group: list[str], ts: str, most: float = 600.0) -> DataFrame:
    """Seconds between consecutive rows, of which only those between 0 and ``most`` (both excluded) count."""
    before = F.lag(ts).over(Window.partitionBy(*group).orderBy(ts))
    s = F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(before.cast("timestamp"))
    return log.withColumn("gap", s / 1e6).where((F.col("gap") > 0) & (F.col("gap") < most))


def first_time(log: DataFrame, group: list[str], met: Column, ts: str) -> DataFrame:
    """When a milestone was first met; null for groups that never met it."""
    return log.groupBy(*group).agg(F.min(F.when(met, F.col(ts))).alias("first"))


def evict(cache: DataFrame, age: str, size: str, oldest: float, most: float, tie: str) -> DataFrame:
    """What a cache keeps: nothing older than ``oldest``, then the newest while their sizes add up to ``most`` at most."""
    return running_total(cache.where(F.col(age) <= oldest), age, size, "held", (tie,)).where(F.col("held") <= most)


def reused_ids(log: DataFrame, seen: DataFrame, ident: str) -> DataFrame:
    """Ids that an earlier run already gave, or that repeat within this one."""
    n = log.groupBy(ident).agg(F.count("*").alias("n"))
    return n.join(seen.select(F.col(ident)).distinct().withColumn("earlier", F.lit(True)), ident, "left").where((F.col("n") > 1) | F.col("earlier")).select(ident, "n", F.coalesce("earlier", F.lit(False)).alias("earlier"))
