"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..cluster import ship

#: Bytes and rows of text that an operator works on at once (a longer single text stands alone).
BATCH_BYTES = 8 << 20
BATCH_ROWS = 2_000


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch as Spark sends it, in slices of at most BATCH_ROWS rows and BATCH_BYTES bytes (a longer single row is a slice of its own). Session settings stay as they are."""
    sizes = np.zeros(len(batch), np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_binary(column.type) or pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
            sizes += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    at = 0
    while at < len(batch):
        before = int(ends[at - 1]) if at else 0
        n = max(1, min(BATCH_ROWS, int(np.searchsorted(ends, before + BATCH_BYTES, side="right")) - at))
        yield batch.slice(at, n)
        at += n


#: What modules keep in a worker between tasks, by module: how to drop it.
CACHES: dict[str, Callable[[], None]] = {}


def drop_caches(but: str = "") -> None:
    """Workers are used again by later operators: free what operators other than ``but`` have left in this one."""
    for name, drop in CACHES.items():
        if name != but:
            drop()


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType, keeps: str = "") -> DataFrame:
    """``mapInArrow`` over byte-bounded batches; ``keeps`` names the cache that ``fn`` uses."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_caches(keeps)
        yield from fn(piece for batch in batches for piece in pieces(batch))

    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def fresh(columns: list[str], name: str) -> str:
    """``name``, or something longer that no column is called."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share; a cluster names it in spark.checkpoint.dir."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        import tempfile

        at = "file://" + tempfile.mkdtemp(prefix="shared-")  # one machine: its own folder is shared
        spark.conf.set("spark.checkpoint.dir", at)
    return at


#: Tables made in each open ``scratch``, the innermost last.
_SCOPES: list[list[DataFrame]] = []


def table_once(df: DataFrame) -> DataFrame:
    """Write ``df`` into the shared folder and read it back: its lineage ends there and a lost executor costs nothing. The table goes with its ``scratch``, or else with the application."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._table = path
    at, files = _place(out)
    files.deleteOnExit(at)
    if _SCOPES:
        _SCOPES[-1].append(out)
    return out


def _place(table: DataFrame) -> tuple:
    spark = table.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(table._table)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def forget(table: DataFrame) -> None:
    """Delete a table of ``table_once`` that nothing will read again."""
    path, files = _place(table)
    files.delete(path, True)
    files.cancelDeleteOnExit(path)


@contextmanager
def scratch(*, keep: list[DataFrame] | None = None) -> Iterator[None]:
    """Tables made inside are deleted at the end, but for those that were put into ``keep``, which the next outer ``scratch`` takes over."""
    _SCOPES.append([])
    try:
        yield
    finally:
        made = _SCOPES.pop()
        stay = {t._table for t in keep or []}
        for t in made:
            if t._table not in stay:
                forget(t)
            elif _SCOPES:
                _SCOPES[-1].append(t)


def id_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator reads, under its own names, so that no other column can clash; a null text is empty."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def filter_rows(docs: DataFrame, keep: Callable[[list[str]], list[bool]], text_col: str = "text", keeps: str = "") -> DataFrame:
    """The rows of ``docs`` whose text ``keep`` accepts, with all their columns; a null text is judged as empty. No shuffle, no key needed."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(keep([t or "" for t in batch.column(at).to_pylist()]), pa.bool_()))

    return map_arrow(docs, run, docs.schema, keeps)
