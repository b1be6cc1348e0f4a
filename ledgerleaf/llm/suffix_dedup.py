"""Suffix-array deduplication by external induced sorting.

Suffixes are the places of the anchors of ``repeats``: every string of 50 bytes starts at most 34
bytes before one. As in induced sorting, only these sampled suffixes are sorted by comparison: their
tuples (the 50 bytes that follow, the 34 before, document and number) go through a priority queue whose sorted
runs lie on disk once they outgrow RUN_BYTES, and come out in order, block by block, each with the length of the
prefix it has in common with the one before. The order of all other suffixes is induced: the tuples pass in
order, each is dealt to the queue of the byte before it, and carries along the least common length since the last
tuple that went there, and one. Read byte by byte these queues are the order one byte further left; 34 such
rounds reach every string. Suffixes whose common length reaches 50 form one repeated string, and all but
those of the smallest document are covered.

Nothing but blocks, the queues' ends and a mark of eight bytes for each suffix is held in memory: tuples, queues and
what came in lie on disk where a group outgrows RUN_BYTES.

Defined results: a null or empty text has no bytes; fewer than 50 bytes cannot repeat; a null doc_id is
left whole and removes nothing; equal ids do not remove from each other; an empty table gives no rows;
other columns are not read.
"""

from __future__ import annotations

import heapq
import tempfile
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

from .repeats import Entries, Kind, Spool, remove_repeats, summary, unpack

KIND = Kind(words=False, window=50, gram=16)
TOP = KIND.window - KIND.gram
RUN_BYTES = 48 << 20
BLOCK = 1 << 15
TOGETHER = 1 << 20  # bytes of messages that are read together
#: right: the bytes from the anchor on, left: those before it, nearest first (each plus one; zero: beyond the stretch); lefts, rights: how many there are.
TUPLE = np.dtype([("right", f"S{KIND.window}"), ("left", np.uint8, TOP), ("lefts", np.uint8), ("rights", np.uint8), ("doc", np.int64), ("number", np.int64)])
#: What goes on once tuples are sorted; common: with the one before.
SORTED = np.dtype([("left", np.uint8, TOP), ("lefts", np.uint8), ("rights", np.uint8), ("common", np.uint8), ("doc", np.int64), ("number", np.int64)])


class DiskQueue:
    """A priority queue of tuples with a key of bytes: filled in bulk, then emptied in order, block by block.

    What is put in is held until it fills ``run_bytes``, then sorted and written out as a run. Emptying keeps one block of each run in
    memory and takes, each time, everything up to the least of the blocks' last keys.
    """

    def __init__(self, kind: np.dtype, key: str, run_bytes: int = RUN_BYTES, block: int = BLOCK):
        self.kind, self.key = kind, key
        self.run_bytes, self.block = run_bytes, block
        self.held: list[np.ndarray] = []
        self.bytes = 0
        self.runs: list[np.memmap] = []
        self.files: list = []

    def put(self, some: np.ndarray) -> None:
        self.held.append(some)
        self.bytes += some.nbytes
        if self.bytes > self.run_bytes:
            self._spill()

    def _sorted(self) -> np.ndarray:
        some = np.concatenate(self.held) if self.held else np.empty(0, self.kind)
        self.held, self.bytes = [], 0
        return some[np.argsort(some[self.key], kind="stable")]

    def _spill(self) -> None:
        run = self._sorted()
        f = tempfile.TemporaryFile()  # gone with the task, whatever happens to it
        f.write(run.tobytes())
        f.flush()
        self.files.append(f)
        self.runs.append(np.memmap(f, self.kind, "r", shape=run.shape))

    def take(self) -> Iterator[np.ndarray]:
        """All tuples in order of their keys."""
        if not self.runs:
            last = self._sorted()
            if len(last):
                yield last
            return
        if self.held:
            self._spill()
        runs = self.runs
        at = [0] * len(runs)
        heads = [(bytes(r[min(self.block, len(r)) - 1][self.key]), k) for k, r in enumerate(runs)]
        heapq.heapify(heads)
        while heads:
            least, k = heads[0]
            out = []
            for j, r in enumerate(runs):  # whatever a run has up to that key lies in its next block, or the run has a smaller head
                own = np.array(r[at[j] : at[j] + self.block])
                n = int(np.searchsorted(own[self.key], least, side="right"))
                out.append(own[:n])
                at[j] += n
            heads = [(bytes(r[min(at[j] + self.block, len(r)) - 1][self.key]), j) for j, r in enumerate(runs) if at[j] < len(r)]
            heapq.heapify(heads)
            block = np.concatenate(out)
            yield block[np.argsort(block[self.key], kind="stable")]
        for f in self.files:
            f.close()


class ByteQueues:
    """A first-in, first-out queue for each byte, emptied byte by byte: in memory up to ``run_bytes``, beyond that on disk."""

    def __init__(self, kind: np.dtype, run_bytes: int, block: int):
        self.kind, self.run_bytes, self.block = kind, run_bytes, block
        self.only: np.ndarray | None = None  # all there is, while it came in one piece
        self.held: list[list[np.ndarray]] = [[] for _ in range(256)]
        self.bytes = 0
        self.files: dict[int, object] = {}

    def put(self, some: np.ndarray, bounds: np.ndarray) -> None:
        """``some`` by byte, those of byte b at bounds[b] to bounds[b + 1]."""
        self.only = None if self.bytes or self.files else some
        for b in np.flatnonzero(np.diff(bounds)).tolist():
            self.held[b].append(some[bounds[b] : bounds[b + 1]])
        self.bytes += some.nbytes
        if self.bytes > self.run_bytes:
            for b, own in enumerate(self.held):
                if own:
                    f = self.files[b] = self.files.get(b) or tempfile.TemporaryFile()
                    for x in own:
                        f.write(x.tobytes())
            self.held, self.bytes, self.only = [[] for _ in range(256)], 0, None

    def take(self) -> Iterator[np.ndarray]:
        if not self.files:
            own = [self.only] if self.only is not None else [x for b in self.held for x in b]
            self.held, self.only = [], None
            if own and len(some := own[0] if len(own) == 1 else np.concatenate(own)):
                yield some
            return
        for b in range(256):
            if f := self.files.pop(b, None):
                f.seek(0)
                while raw := f.read(self.block * self.kind.itemsize):
                    yield np.frombuffer(raw, self.kind)
                f.close()
            yield from self.held[b]


def lowest(table: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least value at places a..b (both included) of the array whose table of minima over powers of two is given."""
    level = np.frexp((b - a + 1).astype(np.float64))[1] - 1
    out = np.empty(len(a), table[0].dtype)
    for k in np.unique(level):
        at = level == k
        out[at] = np.minimum(table[k][a[at]], table[k][b[at] - (1 << k) + 1])
    return out


def minima(v: np.ndarray) -> list[np.ndarray]:
    table = [v]
    while (n := 1 << (len(table) - 1)) * 2 <= len(v):
        table.append(np.minimum(table[-1][:-n], table[-1][n:]))
    return table


def tuples(e: Entries, first: int) -> np.ndarray:
    """The tuples of entries, numbered from ``first`` on."""
    out = np.empty(len(e.doc), TUPLE)
    at = e.offset[:, None] + np.arange(-TOP, KIND.window)
    ok = (at >= 0) & (at < e.size[:, None])
    around = np.where(ok, e.flat[np.where(ok, e.start[:, None] + at, 0)], 0).astype(np.uint8)
    out["right"] = np.ascontiguousarray(around[:, TOP:]).view(f"S{KIND.window}").ravel()
    out["left"] = around[:, TOP - 1 :: -1] if TOP else 0
    out["lefts"] = np.minimum(e.offset, TOP)
    out["rights"] = np.minimum(e.size - e.offset, KIND.window)
    out["doc"] = e.doc
    out["number"] = first + np.arange(len(e.doc))
    return out


def with_common(blocks: Iterator[np.ndarray]) -> Iterator[np.ndarray]:
    """Sorted tuples, each with the length of the prefix it has in common with the one before."""
    before = np.zeros((1, KIND.window), np.uint8)
    some = False
    for block in blocks:
        rows = np.frombuffer(np.ascontiguousarray(block["right"]).tobytes(), np.uint8).reshape(-1, KIND.window)
        same = rows == np.concatenate([before, rows[:-1]])
        out = np.empty(len(block), SORTED)
        for name in ("left", "lefts", "rights", "doc", "number"):
            out[name] = block[name]
        out["common"] = np.where(same.all(axis=1), KIND.window, same.argmin(axis=1))
        if not some:
            out["common"][0] = 0
        before, some = rows[-1:].copy(), True
        yield out


def induced(blocks: Iterator[np.ndarray], o: int, queues: ByteQueues) -> Iterator[np.ndarray]:
    """The order of the suffixes ``o`` bytes before their anchors, from that of those one byte further right."""
    least = np.full(256, 255, np.uint8)  # common length with the last tuple of each byte
    seen = np.zeros(256, bool)
    for block in blocks:
        byte, common = block["left"][:, o - 1], block["common"]
        order = np.argsort(byte, kind="stable")
        byte = byte[order]
        bounds = np.searchsorted(byte, np.arange(257))
        own = np.flatnonzero(np.diff(bounds))
        now = np.empty(len(block), np.uint8)
        equal = 1 + np.flatnonzero(byte[1:] == byte[:-1])
        now[equal] = lowest(minima(common), order[equal - 1] + 1, order[equal])
        heads = order[bounds[own]]
        now[bounds[own]] = np.minimum(least[own], np.minimum.accumulate(common)[heads])
        out = block[order]
        out["common"] = np.minimum(now, KIND.window - 1) + 1
        fresh = own[~seen[own]]
        out["common"][bounds[fresh]] = 0
        # from the last tuple of each byte to the end of the block
        after = np.append(np.minimum.accumulate(common[::-1])[::-1], np.uint8(255))
        least = np.minimum(least, common.min())
        least[own] = after[order[bounds[own + 1] - 1] + 1]
        seen[own] = True
        queues.put(out[bounds[1] :], np.maximum(bounds - bounds[1], 0))  # the others start further right
    yield from queues.take()


def mark(blocks: Iterator[np.ndarray], o: int, marks: np.ndarray) -> Iterator[np.ndarray]:
    """Pass the order on, and mark every string of it (TOP - o is its bit) that a smaller document holds too."""
    bit = np.uint64(1 << (TOP - o))
    low, waiting, reach = 0, np.zeros(0, np.int64), 0  # of the last run: its smallest document, the numbers that stand in it, the common length since
    for block in blocks:
        ok = np.flatnonzero((block["lefts"] >= o) & (block["rights"] >= KIND.window - o))
        if len(ok):
            short = np.cumsum(block["common"] < KIND.window)
            run = short[ok]
            doc, number = block["doc"][ok], block["number"][ok]
            starts = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
            lows = np.minimum.reduceat(doc, starts)
            ends = np.append(starts[1:], len(ok))
            if len(waiting) and reach >= KIND.window and run[0] == 0:  # the first run goes on from the block before
                if lows[0] < low:
                    marks[waiting] |= bit
                else:
                    lows[0] = low
                    held = waiting
            else:
                held = waiting[:0]
            later = doc > np.repeat(lows, ends - starts)
            marks[number[later]] |= bit
            last = slice(starts[-1], ends[-1])
            smallest = number[last][doc[last] == lows[-1]]
            waiting = np.concatenate([held, smallest]) if len(starts) == 1 and len(waiting) and reach >= KIND.window and run[0] == 0 and lows[0] == low else smallest
            low = int(lows[-1])
            reach = KIND.window if short[-1] == run[-1] else 0
        elif len(block) and block["common"].min() < KIND.window:
            reach = 0
        yield block


class SuffixOrder:
    """One group of anchors, sorted and induced in bounded memory."""

    def __init__(self, run_bytes: int | None = None, block: int | None = None):
        self.run_bytes, self.block = run_bytes or RUN_BYTES, block or BLOCK
        self.queue = DiskQueue(TUPLE, "right", self.run_bytes, self.block)
        self.entries = Spool(self.run_bytes)
        self.payloads: list[list] = []
        self.bytes = self.n = 0

    def add(self, blob: bytes) -> None:
        some = unpack(blob)
        self.payloads.append(some)
        self.bytes += len(some[7])
        if self.bytes > TOGETHER:
            self._read()

    def _read(self) -> None:
        e = Entries(KIND, self.payloads)
        self.payloads, self.bytes = [], 0
        if len(e.doc):
            self.queue.put(tuples(e, self.n))
            self.n += len(e.doc)
            e.flat = None  # only places are needed again
            self.entries.put(e, 64 * len(e.doc) + 16 * len(e.idx))

    def marks(self) -> np.ndarray:
        """For each suffix a bit for each window around its anchor that a smaller document holds."""
        if self.payloads:
            self._read()
        if 8 * self.n > self.run_bytes:
            f = tempfile.TemporaryFile()
            f.truncate(8 * self.n)
            marks = np.memmap(f, np.uint64, "r+", shape=self.n)
        else:
            marks = np.zeros(self.n, np.uint64)
        blocks = mark(with_common(self.queue.take()), 0, marks)
        for o in range(1, TOP + 1):
            blocks = mark(induced(blocks, o, ByteQueues(SORTED, self.run_bytes, self.block)), o, marks)
        for _ in blocks:
            pass
        return marks

    def removals(self) -> Iterator[list[tuple[int, int, bytes]]]:
        marks = self.marks()
        at = 0
        for e in self.entries:
            own = np.array(marks[at : at + len(e.doc)])
            at += len(e.doc)
            flags = (own[:, None] >> np.arange(TOP + 1, dtype=np.uint64)) & np.uint64(1) > 0
            e.lo, e.hi = e.first[:-1], e.first[1:]
            if some := e.removals((e, flags)):
                yield some
        self.entries.close()


def remove_covered(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, n (bytes), runs of removed bytes, kept (the other bytes)."""
    return remove_repeats(KIND, SuffixOrder, docs, id_col, text_col, hot)


def report(found: DataFrame) -> DataFrame:
    return summary(found, "n_bytes")


#: Bytes as pairs of hexadecimal digits, since a string of 50 bytes may cut a character; windows by a 64-bit hash, to spare memory.
ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
win AS (SELECT r, doc_id, unnest(range(0, CAST(len(h) / 2 AS BIGINT) - 49)) AS p, unnest(list_transform(range(0, CAST(len(h) / 2 AS BIGINT) - 49), lambda p: hash(substr(h, 2 * p + 1, 100)))) AS s FROM d WHERE len(h) >= 100),
low AS (SELECT s, min(doc_id) AS low FROM win GROUP BY s HAVING count(*) > 1),
hit AS (SELECT r, p FROM win JOIN low USING (s) WHERE win.doc_id > low.low),
mark AS (SELECT r, p, p > 50 + lag(p) OVER (PARTITION BY r ORDER BY p) OR lag(p) OVER (PARTITION BY r ORDER BY p) IS NULL AS new FROM hit),
run AS (SELECT r, min(p) AS s, max(p) + 50 AS e FROM (SELECT r, p, sum(CASE WHEN new THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY p) AS g FROM mark) GROUP BY r, g),
gap AS (SELECT r, s, e, coalesce(lag(e) OVER (PARTITION BY r ORDER BY s), 0) AS f FROM run),
kept AS (SELECT r, string_agg(substr(h, CAST(2 * f + 1 AS BIGINT), CAST(2 * (s - f) AS BIGINT)), '' ORDER BY s) || substr(any_value(h), CAST(2 * max(e) + 1 AS BIGINT)) AS k, sum(e - s) AS n_removed, count(*) AS n_spans FROM gap JOIN d USING (r) GROUP BY r)
SELECT d.doc_id, CAST(len(h) / 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(k, h))) AS kept_sha256 FROM d LEFT JOIN kept USING (r)
"""
