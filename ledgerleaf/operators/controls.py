"""Controls of delivered pages: conservation of words, votes and scores of readings, corrections, review points, revisions, glyphs, and joins by nearness."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.similarity import blocks, ratio
from ..functions.text import compact, filled, light_fold, page_key, plain, squeeze, words

# Share of mismatched words from which a page is degraded; confidence from which a word or line counts; gain from which a word moves to another column, or is only flagged; weights of the score.
DEGRADED = 0.10
SURE_WORD = 60
MOVE, FLAG = 0.25, 0.05
EDGE = 0.10
WEIGHTS = {"visual": 0.40, "format": 0.25, "dictionary": 0.15, "coherence": 0.10, "length": 0.05}


def conservation(matches: DataFrame, page: list[str]) -> DataFrame:
    """Per page, of matched word pairs (word, read, conf; read null where nothing answers): divergence, whether it is degraded, and omitted words sure enough to count."""
    both = F.col("read").isNotNull()
    wrong = F.sum((both & (compact(F.col("word")) != compact(F.col("read")))).cast("int"))
    n = F.sum(both.cast("int"))
    omitted = F.sum((~both & (F.col("conf") >= SURE_WORD)).cast("int"))
    out = matches.groupBy(*page).agg(n.alias("matched"), wrong.alias("wrong"), omitted.alias("omitted"), F.min("conf").alias("least_conf"))
    rate = F.coalesce(F.col("wrong") / F.nullif(F.col("matched"), F.lit(0)), F.lit(0.0))
    return out.withColumn("divergence", rate).withColumn("degraded", rate > DEGRADED)


def degraded_summary(pages: DataFrame, doc: list[str], order: str) -> DataFrame:
    """One row per degraded page, or one per document when over half its pages are: from, to, pages."""
    w = Window.partitionBy(*doc)
    some = pages.withColumn("_share", F.avg(F.col("degraded").cast("double")).over(w)).where("degraded")
    few = some.where("_share <= 0.5").select(*doc, F.col("divergence").alias("lowest"), F.col("divergence").alias("highest"), F.array(order).alias("pages"))
    most = some.where("_share > 0.5").groupBy(*doc).agg(F.min("divergence").alias("lowest"), F.max("divergence").alias("highest"), F.sort_array(F.collect_list(order)).alias("pages"))
    return few.unionByName(most)


def missing_lines(lines: DataFrame, page: list[str], y: str) -> DataFrame:
    """Sure lines without a match that stand between two matched ones, with the matched rank before and after: nearest neighbours by windows over y."""
    w = Window.partitionBy(*page).orderBy(y)
    before = F.last("matched_rank", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first("matched_rank", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    return lines.withColumn("before", before).withColumn("after", after).where(F.col("matched_rank").isNull() & (F.col("conf") >= SURE_WORD) & F.col("before").isNotNull() & F.col("after").isNotNull())


def vote(candidates: DataFrame, cell: list[str], patterns: DataFrame | None = None) -> DataFrame:
    """Of several readings (value, confidence, col_name) of a cell, the surest that fits its column's pattern, else the surest; blanks do not vote."""
    some = candidates.where(F.trim(filled(F.col("value"))) != "")
    fits = F.lit(True)
    if patterns is not None:
        some = some.join(F.broadcast(patterns), "col_name", "left")  # a row per column of a format
        fits = F.coalesce(F.expr("rlike(trim(value), concat('^(?:', pattern, ')$'))"), F.lit(True))
    return some.groupBy(*cell).agg(F.max(F.struct(fits.alias("fits"), F.col("confidence").alias("confidence"), F.col("value").alias("value"))).alias("b")).select(*cell, "b.value", "b.confidence", "b.fits")


def score(**parts: Column) -> Column:
    """Weighted score of a word in a column from parts between 0 and 1."""
    out = F.lit(0.0)
    for name, weight in WEIGHTS.items():
        if name in parts:
            out = out + weight * F.coalesce(parts[name], F.lit(0.0))
    return out


def coherence_with_above(rows: DataFrame, page: list[str], order: str, value: str) -> Column:
    """Share of the three rows above whose value has the same shape (digits as 9, letters as A)."""
    shape = lambda c: F.regexp_replace(F.regexp_replace(F.upper(c), "[0-9]", "9"), "[A-Z]", "A")
    above = F.collect_list(shape(F.col(value))).over(Window.partitionBy(*page).orderBy(order).rowsBetween(-3, -1))
    return F.when(F.size(above) > 0, F.size(F.filter(above, lambda s: s == shape(F.col(value)))) / F.size(above)).otherwise(0.0)


def rebalance(options: DataFrame, word: list[str]) -> DataFrame:
    """``options`` (col_idx, current, score, split, edge_share) of words near a column's edge: the column each goes to. It moves for a gain over MOVE to an unsplit neighbour; a gain over FLAG only flags it."""
    here = F.max(F.when(F.col("current"), F.struct("col_idx", "score")))
    best = F.max(F.when(~F.col("current") & ~F.col("split") & (F.col("edge_share") <= EDGE), F.struct("score", (-F.col("col_idx")).alias("o"), "col_idx")))
    out = options.groupBy(*word).agg(here.alias("h"), best.alias("b")).withColumn("gain", F.coalesce(F.col("b.score") - F.col("h.score"), F.lit(0.0)))
    return out.select(*word, F.when(F.col("gain") > MOVE, F.col("b.col_idx")).otherwise(F.col("h.col_idx")).alias("col_idx"), ((F.col("gain") > FLAG) & (F.col("gain") <= MOVE)).alias("flagged"), "gain")


def certainty(flagged_columns: Column) -> Column:
    """How sure a line is by its number of flagged columns."""
    return F.when(flagged_columns == 0, "high").when(flagged_columns == 1, "medium").otherwise("low")


def letter_o(value: Column) -> tuple[Column, Column]:
    """A cell of exactly two words whose second is O and one or two digits (and a letter): its O is a zero. The corrected value, and whether it was."""
    hit = F.rlike(filled(value), F.lit(r"^\S+\s+O\d{1,2}[A-Z]?$"))
    return F.when(hit, F.regexp_replace(value, r"(\s)O(\d{1,2}[A-Z]?)$", "$10$2")).otherwise(value), hit


def revisions_listed(pages: DataFrame, cover: DataFrame, doc: list[str]) -> DataFrame:
    """Documents whose pages carry an index that the cover does not list: the indices missing."""
    return pages.where(F.trim(filled(F.col("index"))) != "").join(cover.select(*doc, "index").distinct(), [*doc, "index"], "left_anti").groupBy(*doc).agg(F.sort_array(F.collect_set("index")).alias("missing"))


def review_points(alerts: DataFrame, zones: DataFrame, starts: DataFrame, page: list[str]) -> DataFrame:
    """Alerts with the zone on the page (page keys, row_idx, col_idx, box) and the sheet cell they stand for, as JSON."""
    where = alerts.join(zones, [*page, "row_idx", "col_idx"], "left").join(starts, page, "left")
    sheet = F.concat(F.char(F.col("col_idx") + 65), (F.col("start") + F.col("row_idx")).cast("string"))
    return where.withColumn("sheet_cell", sheet).withColumn("point", F.to_json(F.struct("rule", "message", "proposal", "sheet_cell", "box")))


def glyph_table(seen: DataFrame) -> DataFrame:
    """A shape stands for a letter when the readable text shows exactly one letter for it (shape, letter)."""
    return seen.groupBy("shape").agg(F.min("letter").alias("letter"), F.countDistinct("letter").alias("n")).where("n = 1").drop("n")


def decode(glyphs: DataFrame, known: DataFrame, line: list[str], order: str) -> DataFrame:
    """Lines of shapes as text; shapes without a letter as U+FFFD, and whether any is left to be read again."""
    some = glyphs.join(known, "shape", "left").withColumn("sign", F.coalesce("letter", F.lit("�")))
    out = some.groupBy(*line).agg(F.array_sort(F.collect_list(F.struct(order, "sign"))).alias("g"))
    text = F.array_join(F.transform("g", lambda g: g["sign"]), "")
    return out.select(*line, text.alias("text"), F.contains(text, F.lit("�")).alias("unread"))


def alerts_met(expected: DataFrame, emitted: DataFrame, doc: list[str]) -> DataFrame:
    """Expected alerts and the emitted message that holds each, every message used once, in order: per document, whose alerts are few."""
    kinds = {f.name: f.dataType.simpleString() for f in expected.schema.fields}

    def run(k: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        left = list(b.sort_values("rank")["message"]) if len(b) else []
        out = []
        for e in a.sort_values("rank")["expected"] if len(a) else []:
            hit = next((m for m in left if e.lower() in m.lower()), None)
            if hit is not None:
                left.remove(hit)
            out.append((*k, e, hit))
        return pd.DataFrame(out, columns=[*doc, "expected", "message"])

    emitted = emitted.select(*[F.col(c).alias(c) for c in emitted.columns])
    return expected.groupBy(*doc).cogroup(emitted.groupBy(*doc)).applyInPandas(run, ", ".join(f"{c} {kinds[c]}" for c in doc) + ", expected string, message string")


def reconcile(wanted: DataFrame, done: DataFrame, since: Column) -> DataFrame:
    """What was read already: by content hash, else by name, of records not older than ``since``."""
    recent = done.where(F.col("at") >= since)
    by_hash = wanted.join(recent.select(F.col("hash"), F.lit("hash").alias("by")).distinct(), "hash", "left")
    names = recent.select("name", F.lit(True).alias("_named")).distinct()
    return by_hash.join(names, "name", "left").withColumn("by", F.coalesce("by", F.when(F.col("_named"), "name"))).drop("_named")


def twins(read: list[tuple[str, float]], seen: list[tuple[str, float]]) -> list[tuple[int, int | None, str]]:
    """For each word of a cell its twin in the other reading: equal when folded (by blocks), else by rank if both have as many words, else none."""
    out: dict[int, tuple[int, str]] = {}
    for op, i1, i2, j1, _ in blocks([w for w, _ in read], [w for w, _ in seen]):
        if op == "equal":
            out |= {i: (j1 + i - i1, "exact") for i in range(i1, i2)}
    if len(read) == len(seen):
        out = {i: out.get(i, (i, "rank")) for i in range(len(read))}
    return [(i, *(out.get(i, (None, "none")))) for i in range(len(read))]


def place_words(read: DataFrame, seen: DataFrame, cell: list[str]) -> DataFrame:
    """Positions of words (rank, word) taken from their twins (rank, word, x): cell, rank, x, source. Both readings meet cell by cell."""
    kinds = {f.name: f.dataType.simpleString() for f in read.schema.fields}
    a = read.groupBy(*cell).agg(F.array_sort(F.collect_list(F.struct("rank", light_fold(F.col("word")).alias("w")))).alias("a"))
    b = seen.groupBy(*cell).agg(F.array_sort(F.collect_list(F.struct("rank", light_fold(F.col("word")).alias("w"), "x"))).alias("b"))

    @F.pandas_udf("array<int>")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        # only the words go to Python and one number for each comes back: twice the twin's place, and one more if it is exact
        code = lambda j, s: -1 if j is None else 2 * j + (s == "exact")
        return pd.Series([[code(j, s) for _, j, s in twins([(w, 0.0) for w in p], [(w, 0.0) for w in ([] if q is None else q)])] for p, q in zip(x, y)])

    def placed(p: Column, i: Column) -> Column:
        n = F.get("_c", i)
        x = F.when(n >= 0, F.get("b", F.floor(n / 2).cast("int"))["x"].cast("double"))
        return F.struct(p["rank"].cast("int").alias("rank"), x.alias("x"), F.when(n < 0, "none").when(n % 2 == 1, "exact").otherwise("rank").alias("source"))

    assert all(c in kinds for c in cell)
    own = lambda c: F.transform(c, lambda r: r["w"])
    both = a.join(b, cell, "left").withColumn("_c", run(own("a"), own("b")))
    return both.select(*cell, F.explode(F.transform("a", placed)).alias("w")).select(*cell, "w.*")


def overlaps(boxes: DataFrame, line: list[str], least: float = 0.5) -> DataFrame:
    """Pairs of boxes of a line (id, x0, x1, h) that overlap by over ``least`` of the height: an interval join within buckets as wide as the widest box, so that each pair of a line is met in few buckets."""
    wide = boxes.withColumn("_w", F.greatest(F.max(F.col("x1") - F.col("x0")).over(Window.partitionBy(*line)), F.lit(1e-6)))
    left = wide.select(*line, F.col("id").alias("a"), F.col("x0").alias("a0"), F.col("x1").alias("a1"), F.col("h").alias("ah"), F.floor(F.col("x0") / F.col("_w")).alias("_b"))
    right = wide.select(*line, F.col("id").alias("b"), F.col("x0").alias("b0"), F.col("x1").alias("b1"), F.explode(F.array(*[F.floor(F.col("x0") / F.col("_w")) + k for k in (-1, 0, 1)])).alias("_b"))
    both = left.join(right, [*line, "_b"]).where("a < b")
    return both.withColumn("overlap", F.least("a1", "b1") - F.greatest("a0", "b0")).where(F.col("overlap") > least * F.col("ah")).select(*line, "a", "b", "overlap")


def near_pairs(points: DataFrame, group: list[str], reach: float) -> DataFrame:
    """Pairs of points (id, x, y) of a group within ``reach`` in x and y: a join on grid cells and their neighbours, then the exact test."""
    cell = lambda c: F.floor(F.col(c) / reach)
    a = points.select(*group, F.col("id").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"), cell("x").alias("_x"), cell("y").alias("_y"))
    around = F.array(*[F.struct((cell("x") + i).alias("x"), (cell("y") + j).alias("y")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    b = points.select(*group, F.col("id").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"), F.explode(around).alias("_c")).select(*group, "b", "bx", "by", F.col("_c.x").alias("_x"), F.col("_c.y").alias("_y"))
    hit = (F.abs(F.col("ax") - F.col("bx")) <= reach) & (F.abs(F.col("ay") - F.col("by")) <= reach)
    return a.join(b, [*group, "_x", "_y"]).where(F.col("a") < F.col("b")).where(hit).select(*group, "a", "b")


def word_offsets(cells: Column) -> Column:
    """Where each text of a row starts in their concatenation."""
    return F.transform(cells, lambda c, i: F.aggregate(F.slice(cells, F.lit(1), i), F.lit(0), lambda a, x: a + F.length(x)))


def delivered_numbers(pages: DataFrame, doc: list[str], plan: str, label: str, order: str) -> DataFrame:
    """Plan numbers that differ only in spacing are written without it; pages are numbered when none has a number."""
    from .audit import number_if_none

    w = Window.partitionBy(*doc, compact(F.col(plan)))
    spaced = F.size(F.collect_set(squeeze(F.col(plan))).over(w)) > 1
    return number_if_none(pages.withColumn(plan, F.when(spaced, compact(F.col(plan))).otherwise(F.col(plan))), doc, label, order)


def label_key(label: Column) -> Column:
    """What a footer label is looked up by: plain capitals and digits."""
    return F.regexp_replace(plain(label), "[^A-Z0-9]", "")


def mapped_row(parts: Column, mapping: list[list[int]]) -> Column:
    """Cells from segments by a given mapping (segment numbers of each column)."""
    return F.array(*[F.array_join(F.filter(F.array(*[F.get(parts, F.lit(i)) for i in ids]) if ids else F.array().cast("array<string>"), lambda c: c.isNotNull()), " ") for ids in mapping])


def type_scores(docs: DataFrame, types: DataFrame, text: str = "text") -> DataFrame:
    """Documents by types (type, word, part: column or footer): the type with most column hits, then most footer hits, then first by name; ties lower the certainty. Words are met by an equi-join."""
    have = docs.select("doc_id", F.explode(F.array_distinct(F.transform(words(F.upper(F.col(text))), lambda w: F.regexp_replace(w, "[^A-Z0-9]", "")))).alias("word"))
    n = lambda p: F.sum((F.col("part") == p).cast("int"))
    hits = have.join(types, "word").groupBy("doc_id", "type").agg(n("column").alias("columns"), n("footer").alias("footers"))
    w = Window.partitionBy("doc_id")
    tied = F.count("*").over(Window.partitionBy("doc_id", "columns", "footers")) > 1
    return hits.withColumn("_t", tied).withColumn("_p", F.row_number().over(w.orderBy(F.desc("columns"), F.desc("footers"), "type"))).where("_p = 1").select("doc_id", "type", "columns", "footers", F.when(F.col("_t"), 0.5).otherwise(1.0).alias("certainty"))


def page_order(label: Column) -> Column:
    """Natural order of page labels: number, then suffix; unreadable ones last."""
    key = page_key(label)
    return F.struct(key.isNull().alias("none"), key.alias("key"))


def closest_values(values: DataFrame, known: DataFrame, cutoff: float = 0.82) -> DataFrame:
    """For each value (col_name, value) the known value most like it by difflib, at ``cutoff`` or more.

    Only pairs that can reach the cutoff meet. With s signs in both, m of them matched and s - 2m not, there are at
    most s - 2m + 1 runs of matched signs once both have a mark at either end, so they share 3m - s + 1 pairs of
    neighbours at least; a ratio of c makes that t = (1.5c - 1)s + 1, which is one or more for any c over 2/3. Two values that
    share t of their pairs share one among the rarest, all but t - 1 of either; so values meet by an equi-join on rare
    pairs, and the common ones, which most values hold, join nothing. At lower cutoffs all values of a column meet.
    """
    some = cutoff > 2 / 3

    def pairs_of(f: DataFrame, name: str) -> DataFrame:
        """Each value with its pairs of neighbours, those that stand in it again numbered."""
        f = f.select("col_name", "value", F.upper("value").alias(name)).distinct().where(F.col(name).isNotNull())
        marked = F.concat(F.lit("\x02"), name, F.lit("\x03"))
        own = F.transform(F.sequence(F.lit(1), F.length(name) + 1), lambda i: F.substring(marked, i, F.lit(2)))
        numbered = F.transform(own, lambda g, i: F.concat(g, F.size(F.filter(F.slice(own, F.lit(1), i), lambda h: h == g)).cast("string")))
        return f.withColumn(f"_{name}", numbered if some else F.array(F.lit("")))

    a, b = pairs_of(values, "own"), pairs_of(known.select("col_name", F.upper("value").alias("value")), "known").drop("value")
    common = b.select("col_name", F.explode("_known").alias("_k")).groupBy("col_name", "_k").agg(F.count("*").alias("_n"))

    def rarest(f: DataFrame, name: str) -> DataFrame:
        n = F.length(name)
        least = F.ceil((1.5 * cutoff - 1) * (n + F.ceil(n * cutoff / (2 - cutoff) - 1e-6)) + 1 - 1e-6) if some else F.lit(1)
        each = f.select(*f.columns, F.explode(f"_{name}").alias("_k")).join(common, ["col_name", "_k"], "left")
        w = Window.partitionBy("col_name", *(["value"] if name == "own" else []), name).orderBy(F.coalesce("_n", F.lit(0)), "_k")
        return each.withColumn("_p", F.row_number().over(w)).where(F.col("_p") <= F.size(f"_{name}") - least + 1).drop("_n", "_p")

    @F.pandas_udf("double")
    def alike(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([ratio(p, q) for p, q in zip(y, x)])

    signs = F.length("own") + F.length("known")
    lengths = 2 * F.least(F.length("own"), F.length("known")) >= cutoff * signs - 1e-6
    met = rarest(a, "own").join(rarest(b, "known"), ["col_name", "_k"]).where(lengths).drop("_k").distinct()
    near = met.where(F.size(F.array_intersect("_own", "_known")) >= (1.5 * cutoff - 1) * signs + 1 - 1e-6) if some else met
    scored = near.withColumn("ratio", alike("own", "known")).where(F.col("ratio") >= cutoff)
    return scored.groupBy("col_name", "value").agg(F.max(F.struct("ratio", "known")).alias("b")).select("col_name", "value", "b.known", "b.ratio")
