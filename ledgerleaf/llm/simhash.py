"""SimHash near-duplicates: pigeonhole blocks, joins on blocks, exact verification, components.

A fingerprint has 64 bits in four blocks. Two fingerprints that differ in at most two bits agree in two
blocks at least, so each distinct fingerprint is dealt out under the six pairs of its blocks and
only fingerprints under the same pair of block values meet. From MANY fingerprints on, when pairs of
values begin to coincide by chance, there are five blocks and the ten sets of three. Copies never
meet: equal fingerprints are folded into one node first, with their smallest doc_id.

A bucket of at most PAIRS nodes compares its nodes with each other. A fuller bucket deals its
nodes out once more: two nodes of a bucket differ in at most two of the other bits exactly when
some value lies within one bit of both, so each node goes to the values within one of those bits of
its own, nodes that meet at a value link to the smallest node there, and the work stays in
proportion to the bucket's size. Every link found is verified by its Hamming distance, or, between
nodes that meet at a value, holds by construction through links of distance two at most.

Components come from alternating large-star and small-star rounds over the links, each a
join with a table of neighbourhood minima, cut off by a written table in the shared folder.

Words: A-Z lower-cased, split at ASCII white space; shingles of three words, repeats included.

Defined results: a text of one or two words has one shingle; a null or wordless text has
fingerprint zero and links like any other; rows with equal ids each give a row; a null doc_id
never names a component but links like any other; an empty table gives no rows; other columns
are not read. ``keep_one`` keeps rows without an id, and of each component one other row: that of its smallest
id; among texts of the component under that one id that of the smallest hash, and among rows that are
equal in both the one of the smallest hash of all columns.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, fresh, id_text, map_arrow, scratch, table_once

SHINGLE = 3
SEED = 42
DISTANCE = 2
PAIRS = 12
MANY = 1 << 28
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
CHUNK = 1 << 15


def fingerprint(text: str) -> int:
    """The 64-bit fingerprint of a text, as a signed integer."""
    from xxhash import xxh64_intdigest

    words = text.encode().translate(LOWER).split()
    if not words:
        return 0
    row = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    size = min(SHINGLE, len(words))
    starts = np.concatenate([[0], ends[:-size]]).tolist()
    stops = (ends[size - 1 :] - 1).tolist()
    hashes = iter([xxh64_intdigest(row[s:e], SEED) for s, e in zip(starts, stops)])
    ones = np.zeros(64, np.int64)
    while some := list(islice(hashes, CHUNK)):
        bits = np.unpackbits(np.array(some, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(starts), bitorder="little").view("<i8")[0])


def _with_fingerprints(rows: DataFrame) -> DataFrame:
    """``rows`` with fp (signed 64-bit) in place of their last column, text."""
    kept = rows.schema.fields[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([fingerprint(t) for t in batch.columns[-1].to_pylist()], pa.int64())], [*(f.name for f in kept), "fp"])

    return map_arrow(rows, run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept) + ", fp long")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp (signed 64-bit) of each row of ``docs``."""
    return _with_fingerprints(id_text(docs, id_col, text_col))


def layout(blocks: int) -> list[tuple[int, int]]:
    """First bit and width of each block."""
    cuts = [64 * k // blocks for k in range(blocks + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def links(nodes: DataFrame, blocks: int | None = None) -> DataFrame:
    """a < b: pairs of distinct fingerprints (column fp of ``nodes``, no copies) at DISTANCE bits or fewer; full buckets give only links that keep their components together."""
    places = layout(blocks or (4 if nodes.count() < MANY else 5))
    sets = list(combinations(places, len(places) - DISTANCE))

    def key(some: tuple[tuple[int, int], ...]) -> F.Column:
        out = F.lit(0).cast("bigint")
        for at, width in some:
            out = F.shiftleft(out, width).bitwiseOR(F.shiftright("fp", at).bitwiseAND(F.lit((1 << width) - 1)))
        return out

    dealt = nodes.select("fp", F.posexplode(F.array(*[key(x) for x in sets])).alias("pair", "key"))
    sizes = dealt.groupBy("pair", "key").agg(F.count("*").alias("n")).where("n > 1")
    met = table_once(dealt.join(sizes, ["pair", "key"]))
    small = met.where(F.col("n") <= PAIRS).select("pair", "key", "fp")
    near = small.select("pair", "key", F.col("fp").alias("a")).join(small.select("pair", "key", F.col("fp").alias("b")), ["pair", "key"])
    near = near.where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= DISTANCE)).select("a", "b")
    within = F.lit(None).cast("array<bigint>")
    for k, some in enumerate(sets):
        others = [i for at, width in places if (at, width) not in some for i in range(at, at + width)]
        ball = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit((1 << i) if i < 63 else -(1 << 63)).cast("bigint")) for i in others])
        within = F.when(F.col("pair") == k, ball).otherwise(within)
    balls = met.where(F.col("n") > PAIRS).select("pair", "fp", F.explode(within).alias("value"))
    # a value lies within one of the other bits of 33 fingerprints of a bucket at most, which bounds these lists
    meet = balls.groupBy("pair", "value").agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)
    hubs = meet.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where("a <> b")
    hubs = hubs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= DISTANCE)
    return near.unionByName(hubs).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root for each node of ``edges`` (a, b) that is not the smallest of its component: a table of ``table_once``."""
    edges = table_once(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())

    before = state(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")))).alias("e")).select("e.u", "e.v")
        older, edges = edges, table_once(small.where("u <> v").distinct())
        now = state(edges)
        forget(older)
        if now == before:
            break
        before = now
    out = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    out._table = edges._table
    return out


def rooted(nodes: DataFrame) -> DataFrame:
    """The rows of ``nodes`` (fp, no copies, and others) with the root of each one's component."""
    keep: list[DataFrame] = []
    with scratch(keep=keep):
        roots = components(links(nodes))
        keep.append(roots)
    return nodes.join(roots, F.col("fp") == F.col("node"), "left").withColumn("root", F.coalesce("root", "fp")).drop("node")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable over links)."""
    found = table_once(fingerprints(docs, id_col, text_col))
    placed = rooted(table_once(found.groupBy("fp").agg(F.min("doc_id").alias("low"))))
    lowest = placed.groupBy("root").agg(F.min("low").alias("component_id"))
    named = placed.join(lowest, "root").select(F.col("fp").alias("of"), "component_id")
    return found.join(named, F.col("fp") == F.col("of")).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` for each component, with all its columns, and the rows without an id; see above for which one."""
    from pyspark.sql import Window

    mark = F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    rows = id_text(docs, id_col, text_col).select("doc_id", F.xxhash64("text").alias("mark"), "text")
    low = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "mark")))
    keep: list[DataFrame] = []
    with scratch(keep=keep):
        nodes = table_once(_with_fingerprints(rows).groupBy("fp").agg(low.alias("low")))
        first = table_once(rooted(nodes).groupBy("root").agg(F.min("low").alias("low")).where("low IS NOT NULL").select("low.*"))
        keep.append(first)
    own_id, own_mark = fresh(docs.columns, "_own_id"), fresh(docs.columns, "_own_mark")
    one_id, one_mark, place = fresh(docs.columns, "_one_id"), fresh(docs.columns, "_one_mark"), fresh(docs.columns, "_place")
    marked = docs.withColumns({own_id: F.col(id_col).cast("long"), own_mark: mark})
    some = marked.join(first.toDF(one_id, one_mark), (F.col(own_id) == F.col(one_id)) & (F.col(own_mark) == F.col(one_mark)), "left_semi")
    hashed = [F.col(f"`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    one = some.withColumn(place, F.row_number().over(Window.partitionBy(own_id, own_mark).orderBy(F.xxhash64(*hashed)))).where(F.col(place) == 1).select(*[F.col(f"`{c}`") for c in docs.columns])
    return one.unionByName(docs.where(F.col(id_col).isNull()))
