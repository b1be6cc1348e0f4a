"""Distribution for the operators that remove what an earlier document already holds.

A text is a row of symbols (bytes or words). A window is a fixed number of symbols; a window is repeated
where its symbols also start in a document with a smaller id. Every window has an anchor: the
gram (a few symbols) inside it with the least hash, the leftmost of equals. Equal windows have equal anchors
at equal places, so only windows with equal anchors need to meet. Windows in a row with one anchor form
a stretch, which travels as one entry.

1. Documents travel to buckets of bounded size, compressed. Beside that, each batch of documents asks
   for every anchor hash whether other documents hold it too. A hash found in several documents of
   the batch needs no answer and is only reported, so a passage that everybody holds costs one
   record for each batch.
2. Each bucket learns which of its anchors are shared. It cuts the stretches of those, folds equal
   stretches into the one of the smallest document (the others are repeated, whatever else there is) and
   deals the rest out by anchor.
3. Each group of anchors is solved by the operator's own method: which windows of a stretch have a
   smaller document?
4. Each bucket removes what it was told and gives the results.

The prefix that an entry travels under is as long as its group needs. Anchors whose stretches would outgrow a
group are found on a bounded sample of documents (it balances load and changes no result). A stretch at such an
anchor is cut in two: its windows that reach half a window's rest beyond the anchor travel under the anchor
and what follows it, the others under the anchor and what stands before it. Where even these longer prefixes
are too common, windows travel one by one under their own hash.

Rows with a null id are left whole and remove nothing. Equal ids do not remove from each other. Equal rows (in id
and text) are worked on once in each bucket, however often they are repeated, and give as many rows.
"""

from __future__ import annotations

import math
import pickle
import tempfile
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

CHUNK = 1 << 17  # symbols that are hashed together
BUCKET_BYTES = 6 << 20  # text of a bucket
GROUP_BYTES, LARGEST_GROUP, GROUPS = 2 << 20, 32 << 20, 1 << 12  # text for each group of anchors: least, most, and from how many groups on they grow
SHORT = 512  # bytes of a message that is not worth compressing
SAMPLE_DOCS, SAMPLE_BYTES, SAMPLE_LEAST = 1 << 20, 2 << 30, 64  # documents and text of the sample at most, and one document of how many at most
HOT, LEAST_HOT = 512, 4  # documents of the sample that make an anchor hot: at most, at least
MOST_HOT = 1 << 20  # hot anchors that tasks are told of, those of most documents; it balances load and changes no result
GOLD = 0x9E3779B97F4A7C15
PLACE = np.uint64((1 << 20) - 1)
MESSAGE = "to int, bucket int, blob binary"
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
LONG_WORD = 256


class Words:
    """The words of a text as places in its bytes: no object for each word."""

    __slots__ = ("raw", "s", "e")

    def __init__(self, raw: bytes, s: np.ndarray | None = None, e: np.ndarray | None = None):
        if s is None:
            turn = np.diff(_SPACE[np.frombuffer(raw, np.uint8)].view(np.int8), prepend=1, append=1)
            s, e = np.flatnonzero(turn == -1), np.flatnonzero(turn == 1)
        self.raw, self.s, self.e = raw, s, e

    def __len__(self) -> int:
        return len(self.s)

    def __getitem__(self, some: slice) -> "Words":
        s, e = self.s[some], self.e[some]
        return Words(self.raw[s[0] : e[-1]], s - s[0], e - s[0]) if len(s) else Words(b"")

    def cut(self, a: int, b: int) -> bytes:
        return b" ".join(self.raw[self.s[a] : self.e[b - 1]].split()) if b > a else b""


def word_values(texts: list[Words]) -> np.ndarray:
    """Hashes of all words, eight bytes at a time."""
    from xxhash import xxh64_intdigest

    raw = b"".join(t.raw for t in texts)
    at = np.cumsum([0] + [len(t.raw) for t in texts[:-1]])
    s, e = (np.concatenate([x + p for x, p in zip(xs, at)]) for xs in ([t.s for t in texts], [t.e for t in texts]))
    n = e - s
    eight = np.ndarray((len(raw) + 1,), "<u8", raw + bytes(8), strides=(1,))
    h = mix((eight[s] & _MASKS[np.minimum(n, 8)]) + n.astype(np.uint64))
    done, rest = 8, np.flatnonzero((n > 8) & (n <= LONG_WORD))
    while len(rest):
        h[rest] = mix(h[rest] * np.uint64(GOLD) + (eight[s[rest] + done] & _MASKS[np.minimum(n[rest] - done, 8)]))
        done += 8
        rest = rest[n[rest] > done]
    for k in np.flatnonzero(n > LONG_WORD).tolist():
        h[k] = xxh64_intdigest(raw[s[k] : e[k]])
    return h


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


@dataclass(frozen=True)
class Kind:
    """What a symbol is, symbols of a window and of a gram (a power of two)."""

    words: bool
    window: int
    gram: int

    def symbols(self, text: str) -> bytes | Words:
        return Words(text.encode()) if self.words else text.encode()

    def values(self, some: list[bytes] | list[Words]) -> np.ndarray:
        """A number for each symbol of all texts, in a row."""
        return word_values(some) if self.words else np.frombuffer(b"".join(some), np.uint8).astype(np.uint64)

    def cut(self, some: bytes | Words, s: int, e: int) -> bytes:
        return some.cut(s, e) if self.words else some[s:e]


def roll(v: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` (a power of two) values, by doubling, then mixed."""
    h, n, m = v + np.uint64(1), 1, GOLD
    while n < size:
        h = h[:-n] * np.uint64(m) + h[n:]
        n, m = 2 * n, m * m % (1 << 64)
    return mix(h)


def least(v: np.ndarray, width: int) -> np.ndarray:
    """The least value of each run of ``width`` values."""
    n = 1
    while 2 * n <= width:
        v, n = np.minimum(v[:-n], v[n:]), 2 * n
    rest = width - n
    return np.minimum(v[: len(v) - rest], v[rest:]) if rest else v


def stretches(kind: Kind, texts: list[bytes | Words]) -> Iterator[tuple[np.ndarray, ...]]:
    """For chunks of texts: text number, first and last window start, anchor place (in symbols of the text) and anchor hash of each stretch."""
    w = kind.window
    pending: list[tuple[int, int, bytes | Words]] = []
    size = 0

    def work() -> tuple[np.ndarray, ...] | None:
        lens = np.array([len(p[2]) for p in pending])
        first = np.concatenate([[0], np.cumsum(lens)])
        g = roll(kind.values([p[2] for p in pending]), kind.gram)
        at = least((g & ~PLACE) | np.arange(len(g), dtype=np.uint64), w - kind.gram + 1) & PLACE
        edge = np.zeros(first[-1] + 1, np.int32)
        edge[first[:-1]] += 1
        edge[first[:-1] + lens - w + 1] -= 1
        ok = np.flatnonzero(np.cumsum(edge[: len(at)]) > 0)
        a = at[ok].astype(np.int64)
        new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (ok[1:] != ok[:-1] + 1)]))
        i0, a = ok[new], a[new]
        i1 = ok[np.concatenate([new[1:] - 1, [len(ok) - 1]])]
        piece = np.searchsorted(first, i0, side="right") - 1
        back = np.array([p[1] for p in pending])[piece] - first[piece]
        return np.array([p[0] for p in pending])[piece], i0 + back, i1 + back, a + back, g[a]

    for k, text in enumerate(texts):
        for base in range(0, max(0, len(text) - w + 1), CHUNK):
            piece = text[base : base + CHUNK + w - 1]
            pending.append((k, base, piece))
            size += len(piece)
            if size >= CHUNK:
                yield work()
                pending, size = [], 0
    if pending:
        yield work()


def _gather(kind: Kind, texts: list[bytes | Words]) -> list[np.ndarray]:
    parts = list(stretches(kind, texts))
    return [np.concatenate(c) for c in zip(*parts)] if parts else [np.zeros(0, np.int64)] * 4 + [np.zeros(0, np.uint64)]


def pack(*things: object) -> bytes:
    """A message. Arrays cost their bytes and little more, and short messages are not compressed: in a large corpus a message may hold one anchor."""
    import zstandard

    raw = pickle.dumps([(t.dtype.char, t.tobytes()) if isinstance(t, np.ndarray) else t for t in things], 5)
    return b"-" + raw if len(raw) < SHORT else b"z" + zstandard.ZstdCompressor(level=1).compress(raw)


def unpack(blob: bytes) -> list:
    import zstandard

    raw = blob[1:] if blob[:1] == b"-" else zstandard.ZstdDecompressor().decompress(blob[1:])
    return [np.frombuffer(t[1], t[0]) if isinstance(t, tuple) else t for t in pickle.loads(raw)]


def _message(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], ["to", "bucket", "blob"])


def _groups(keys: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each value with the places that hold it, in order."""
    if len(keys):
        order = np.argsort(keys, kind="stable")
        cuts = np.flatnonzero(np.diff(keys[order])) + 1
        for some in np.split(order, cuts):
            yield int(keys[some[0]]), some


def _among(known: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Which of ``some`` are in the sorted ``known``."""
    return known[np.minimum(np.searchsorted(known, some), len(known) - 1)] == some if len(known) else np.zeros(len(some), bool)


def _narrow(t: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of each value."""
    return np.ascontiguousarray(t.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def _widen(raw: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(raw) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8).reshape(-1, width)
    return out.view("<u8").ravel()


@dataclass(frozen=True)
class Sizes:
    buckets: int
    groups: int
    width: int  # bytes of an anchor hash that a question carries
    hot: frozenset[int]  # anchors whose stretches travel under longer prefixes
    hotter: frozenset[int] = frozenset()  # longer prefixes whose windows travel one by one

    def short(self, keys: np.ndarray) -> np.ndarray:
        return keys >> np.uint64(64 - 8 * self.width)


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def measure(kind: Kind, rows: DataFrame, hot: int | None) -> Sizes:
    """Numbers of buckets and groups from the table's bytes, and the anchors of a bounded sample whose stretches would outgrow a group.

    Every anchor of the sample is counted, whatever batch or partition it stands in. ``hot`` sets from how many
    documents of the sample on an anchor counts as one that outgrows its group; by default it follows from the sizes.
    """
    n, total = rows.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    total = total or 0
    share = max(SAMPLE_LEAST, math.ceil(n / SAMPLE_DOCS), math.ceil(total / SAMPLE_BYTES)) if hot is None else 1
    group = min(max(GROUP_BYTES, total // GROUPS), max(GROUP_BYTES, LARGEST_GROUP))
    least_docs = max(LEAST_HOT, min(HOT, LARGEST_GROUP // (share * 2 * kind.window * (8 if kind.words else 1)))) if hot is None else hot
    some = rows.where("doc_id IS NOT NULL").where(F.pmod(F.xxhash64("doc_id"), F.lit(share)) == 0)

    def common(keys_of: Callable[[list[bytes] | list[Words]], tuple[np.ndarray, np.ndarray]]) -> frozenset[int]:
        """The keys that ``least_docs`` documents of the sample hold, whatever batches and partitions they stand in."""

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                doc, key = keys_of([kind.symbols(t) for t in batch.column(0).to_pylist()])
                pair = np.unique(np.stack([key, doc.astype(np.uint64)]), axis=1)[0]
                keys, times = np.unique(pair, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(times, pa.int64())], ["key", "n"])

        counts = map_arrow(some.select("text"), count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= least_docs)
        return frozenset(r["key"] % (1 << 64) for r in counts.orderBy(F.desc("n"), "key").limit(MOST_HOT).select("key").collect())

    def anchors(texts: list[bytes] | list[Words]) -> tuple[np.ndarray, np.ndarray]:
        doc, _, _, _, key = _gather(kind, texts)
        return doc, key

    found = common(anchors)
    known = np.array(sorted(found), np.uint64)

    def longer(texts: list[bytes] | list[Words]) -> tuple[np.ndarray, np.ndarray]:
        doc, i0, i1, a, key = _gather(kind, texts)
        take = _among(known, key)
        keys = [(k, x) for k, s, t, p in zip(doc[take].tolist(), i0[take].tolist(), i1[take].tolist(), a[take].tolist()) for x, _, _ in halves(kind, texts[k], s, t, p)]
        return np.array([k for k, _ in keys], np.int64), np.array([x for _, x in keys], np.uint64)

    return Sizes(max(1, math.ceil(total / BUCKET_BYTES)), max(1, math.ceil(total / group)), min(8, max(4, math.ceil((math.log2(total + 2) + 6) / 8))), found, common(longer) if found else found)


def halves(kind: Kind, some: bytes | Words, s: int, t: int, p: int) -> Iterator[tuple[int, int, int]]:
    """Of the windows that start at s..t around the anchor at p: hash of a longer prefix, first and last window of each half that is not empty."""
    from xxhash import xxh64_intdigest

    top = kind.window - kind.gram
    half = top // 2
    if (x := max(s, p - half)) <= t:  # all reach at least top - half symbols beyond the anchor
        yield xxh64_intdigest(kind.cut(some, p, p + kind.gram + top - half), 1), x, t
    if s <= (x := min(t, p - half - 1)):  # all begin at least half + 1 symbols before it
        yield xxh64_intdigest(kind.cut(some, p - half - 1, p + kind.gram), 2), s, x


def remove_repeats(kind: Kind, solver: Callable[[], "Solver"], docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, n (symbols), runs (removed symbols as start, end, start, end...), kept (what is left, as bytes; words joined by one space)."""
    rows = _rows(docs, id_col, text_col)
    sizes = measure(kind, rows, hot)
    addressed = rows.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(sizes.buckets)).cast("int").alias("bucket"), "doc_id", "text")

    def carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for b, at in _groups(batch.column(0).to_numpy()):
                own = Counter(zip(batch.column(1).take(pa.array(at)).to_pylist(), batch.column(2).take(pa.array(at)).to_pylist()))
                out.append((b, pack([i for i, _ in own], [t for _, t in own], list(own.values()))))
            yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in out], pa.int32()), pa.array([x for _, x in out], pa.binary())], ["bucket", "docs"])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bucket, known = batch.column(0).to_numpy(), batch.column(1).is_valid()
            doc, _, _, _, key = _gather(kind, [kind.symbols(t) if k else kind.symbols("") for t, k in zip(batch.column(2).to_pylist(), known.to_pylist())])
            t = sizes.short(key)
            order = np.lexsort((doc, t))
            t, doc = t[order], doc[order]
            new = np.ones(len(t), bool)
            new[1:] = (t[1:] != t[:-1]) | (doc[1:] != doc[:-1])
            t, doc = t[new], doc[new]
            _, place, times = np.unique(t, return_inverse=True, return_counts=True)
            many = times[place] > 1
            out = []
            single, at, reported = t[~many], bucket[doc[~many]], np.unique(t[many])
            told: dict[int, np.ndarray] = {g: reported[some] for g, some in _groups((reported % np.uint64(sizes.groups)).astype(np.int64))}
            asked = dict(_groups((single % np.uint64(sizes.groups)).astype(np.int64)))
            for g in told.keys() | asked.keys():
                some = asked.get(g, np.zeros(0, np.int64))
                some = some[np.argsort(at[some], kind="stable")]
                out.append((g, -1, pack(np.diff(at[some], prepend=0).astype(np.int32), _narrow(single[some], sizes.width), _narrow(told.get(g, reported[:0]), sizes.width))))
            for b, some in _groups(bucket[doc[many]]):
                out.append((b % sizes.groups, b, pack(_narrow(np.unique(t[many][some]), sizes.width))))
            yield _message(out)

    def answer(table: pa.Table) -> pa.Table:
        out, at, single, told = [], [], [], []
        for b, blob in zip(table["bucket"].to_pylist(), table["blob"].to_pylist()):
            if b >= 0:
                out.append((0, b, blob))
            else:
                where, s, m = unpack(blob)
                at.append(np.cumsum(where))
                single.append(_widen(s, sizes.width))
                told.append(_widen(m, sizes.width))
        if single:
            at, t, told = np.concatenate(at), np.concatenate(single), np.unique(np.concatenate(told))
            _, place, times = np.unique(t, return_inverse=True, return_counts=True)
            shared = (times[place] > 1) | np.isin(t, told)
            out += [(0, b, pack(_narrow(np.unique(t[shared][some]), sizes.width))) for b, some in _groups(at[shared])]
        return pa.Table.from_batches([_message(out)])

    def deal(docs_of: pa.Table, told: pa.Table) -> pa.Table:
        ids, texts, _ = bucket_rows(docs_of)
        shared = [_widen(unpack(x)[0], sizes.width) for x in told["blob"].to_pylist()]
        if not shared or not ids:
            return pa.Table.from_batches([_message([])])
        bucket = docs_of["bucket"][0].as_py()
        return pa.Table.from_batches([_message(cut_entries(kind, sizes, bucket, ids, texts, np.unique(np.concatenate(shared))))])

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = solver()
        for batch in batches:
            passed = []
            for b, blob in zip(batch["bucket"].to_pylist(), batch["blob"].to_pylist()):
                if b >= 0:
                    passed.append((0, b, blob))
                else:
                    group.add(blob)
            yield _message(passed)
        for some in group.removals():
            yield _message(some)

    def finish(docs_of: pa.Table, told: pa.Table) -> pa.Table:
        ids, texts, copies = bucket_rows(docs_of)
        cut = [unpack(x) for x in told["blob"].to_pylist()]
        idx, s, e = (np.concatenate([c[k] for c in cut]) if cut else np.zeros(0, np.int64) for k in range(3))
        order = np.lexsort((s, idx))
        idx, s, e = idx[order], s[order], e[order]
        bounds = np.searchsorted(idx, np.arange(len(ids) + 1))
        n, runs, kept = [], [], []
        for k, text in enumerate(texts):
            some = kind.symbols(text)
            a, b = s[bounds[k] : bounds[k + 1]], e[bounds[k] : bounds[k + 1]]
            if len(a):
                far = np.maximum.accumulate(b)
                new = np.concatenate([[True], a[1:] > far[:-1]])
                a, b = a[new], far[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(far) - 1]])]
            flat = np.stack([a, b], axis=1).ravel().tolist()
            edges = [0, *flat, len(some)]
            left = [kind.cut(some, x, y) for x, y in zip(edges[::2], edges[1::2]) if y > x]
            n.append(len(some))
            runs.append(flat)
            kept.append((b" " if kind.words else b"").join(left))
        return pa.table([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(runs, pa.list_(pa.int64())), pa.array(kept, pa.binary()), pa.array(copies, pa.int32())], names=["doc_id", "n", "runs", "kept", "copies"])

    carried = map_arrow(addressed, carry, "bucket int, docs binary")
    answered = map_arrow(addressed, ask, MESSAGE).groupBy("to").applyInArrow(answer, MESSAGE)
    dealt = carried.groupBy("bucket").cogroup(answered.groupBy("bucket")).applyInArrow(deal, MESSAGE)
    settled = dealt.groupBy("to").applyInArrow(settle, MESSAGE)
    done = carried.groupBy("bucket").cogroup(settled.groupBy("bucket")).applyInArrow(finish, "doc_id long, n long, runs array<long>, kept binary, copies int")
    return done.select("doc_id", "n", "runs", "kept", F.explode(F.array_repeat(F.lit(True), F.col("copies"))).alias("one")).drop("one")


def bucket_rows(table: pa.Table) -> tuple[list[int | None], list[str], list[int]]:
    """Ids and texts of a bucket, each with its number of copies, in an order that does not depend on how they arrived."""
    rows: Counter[tuple[int | None, str]] = Counter()
    for blob in table["docs"].to_pylist():
        for i, t, n in zip(*unpack(blob)):
            rows[i, t] += n
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    return [i for i, _ in order], [t for _, t in order], [rows[r] for r in order]


def cut_entries(kind: Kind, sizes: Sizes, bucket: int, ids: list[int | None], texts: list[str], shared: np.ndarray) -> list[tuple[int, int, bytes]]:
    """Messages of a bucket: what is repeated within it, and the stretches (folded, smallest document) for the groups."""
    symbols = [kind.symbols(t) if i is not None else kind.symbols("") for i, t in zip(ids, texts)]
    from xxhash import xxh64_intdigest

    hot = np.array(sorted(sizes.hot), np.uint64)
    repeated: list[tuple[int, int, int]] = []
    best: dict[tuple[int, int, bytes], list[tuple[int, int]]] = {}

    def offer(key: int, offset: int, k: int, s: int, e: int) -> None:
        name = (key, offset, kind.cut(symbols[k], s, e))
        held = best.get(name)
        if held is None:
            best[name] = [(k, s)]
        elif ids[held[0][0]] == ids[k]:
            held.append((k, s))
        elif ids[held[0][0]] < ids[k]:
            repeated.append((k, s, e))
        else:
            repeated.extend((x, p, p + e - s) for x, p in held)
            best[name] = [(k, s)]

    for doc, i0, i1, a, key in stretches(kind, symbols):
        take = _among(shared, sizes.short(key))
        for k, s, t, p, h, many in zip(doc[take].tolist(), i0[take].tolist(), i1[take].tolist(), a[take].tolist(), key[take].tolist(), _among(hot, key[take]).tolist()):
            for prefix, x0, x1 in halves(kind, symbols[k], s, t, p) if many else ((h, s, t),):
                if prefix in sizes.hotter:
                    for x in range(x0, x1 + 1):
                        offer(xxh64_intdigest(kind.cut(symbols[k], x, x + kind.window)), 0, k, x, x + kind.window)
                else:
                    offer(prefix, p - x0, k, x0, x1 + kind.window)
    out = []
    if repeated:
        idx, s, e = (np.array(c, np.int64) for c in zip(*repeated))
        out.append((bucket % sizes.groups, bucket, pack(idx, s, e)))
    names = list(best)
    group = np.array([n[0] % sizes.groups for n in names], np.int64)
    for g, some in _groups(group):
        mine = [names[i] for i in some.tolist()]
        places = [best[n] for n in mine]
        out.append(
            (
                g,
                -1,
                pack(
                    bucket,
                    np.diff(np.array([ids[p[0][0]] for p in places], np.int64), prepend=0),
                    np.array([n[1] for n in mine], np.int16),
                    np.array([len(n[2]) for n in mine], np.int32),
                    np.array([len(p) for p in places], np.int32),
                    np.array([x[0] for p in places for x in p], np.int32),
                    np.array([x[1] for p in places for x in p], np.int64),
                    (b" " if kind.words else b"").join(n[2] for n in mine),
                ),
            )
        )
    return out


class Solver(Protocol):
    """Takes the entries of one group, message by message, and tells which windows of them an earlier document holds."""

    def add(self, blob: bytes) -> None: ...

    def removals(self) -> Iterator[list[tuple[int, int, bytes]]]: ...


class Spool:
    """Things kept in order: in memory up to ``most`` bytes, beyond that in a file that goes with the task."""

    def __init__(self, most: int):
        self.most, self.bytes, self.held, self.file = most, 0, [], None

    def put(self, thing: object, size: int) -> None:
        self.held.append(thing)
        self.bytes += size
        if self.bytes > self.most:
            self.file = self.file or tempfile.TemporaryFile()
            for x in self.held:
                pickle.dump(x, self.file, 5)
            self.held, self.bytes = [], 0

    def __iter__(self) -> Iterator:
        if self.file:
            end = self.file.tell()
            self.file.seek(0)
            while self.file.tell() < end:
                yield pickle.load(self.file)
            self.file.seek(end)
        yield from self.held

    def close(self) -> None:
        if self.file:
            self.file.close()
        self.held = []


class Entries:
    """Stretches of one group of anchors, of some or all buckets."""

    def __init__(self, kind: Kind, payloads: list[tuple]):
        self.kind = kind
        self.bucket = np.repeat([p[0] for p in payloads], [len(p[1]) for p in payloads])
        self.doc = np.concatenate([np.cumsum(p[1]) for p in payloads])
        self.offset = np.concatenate([p[2] for p in payloads]).astype(np.int64)  # of the anchor from the stretch's start
        copies = np.concatenate([p[4] for p in payloads])
        self.idx, self.at = (np.concatenate([p[k] for p in payloads]) for k in (5, 6))
        self.first = np.concatenate([[0], np.cumsum(copies)])
        if kind.words:
            numbers: dict[bytes, int] = {}
            flat = [numbers.setdefault(w, len(numbers) + 1) for p in payloads for w in p[7].split()]
            self.flat = np.array(flat, np.int32)
            # words of an entry: its bytes hold one space fewer
            self.size = np.concatenate([_word_counts(p[3], p[7]) for p in payloads])
        else:
            self.flat = np.frombuffer(b"".join(p[7] for p in payloads), np.uint8) + np.uint8(1)  # UTF-8 has no byte 255
            self.size = np.concatenate([p[3] for p in payloads]).astype(np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.size)[:-1]])

    def keep(self, some: np.ndarray) -> "Entries":
        """The same with fewer entries; symbols and places stay where they are."""
        out = object.__new__(Entries)
        out.kind, out.flat, out.idx, out.at = self.kind, self.flat, self.idx, self.at
        for name in ("bucket", "doc", "offset", "size", "start"):
            setattr(out, name, getattr(self, name)[some])
        out.lo, out.hi = (self.lo[some], self.hi[some]) if hasattr(self, "lo") else (self.first[:-1][some], self.first[1:][some])
        return out

    def column(self, d: int) -> np.ndarray:
        """The symbol at distance ``d`` from the anchor's start (0: outside the stretch)."""
        at = self.offset + d
        ok = (at >= 0) & (at < self.size)
        return np.where(ok, self.flat[np.where(ok, self.start + at, 0)], 0)

    def holds(self, o: int) -> np.ndarray:
        """Whether the window that starts ``o`` symbols before the anchor lies in the stretch."""
        return (o <= self.offset) & (self.offset - o + self.kind.window <= self.size)

    def removals(self, found: tuple["Entries", np.ndarray]) -> list[tuple[int, int, bytes]]:
        """Messages with the runs of windows that ``found`` marks: entries, and for each a row of flags by offset of the window before the anchor, largest first."""
        e, flags = found
        some = np.flatnonzero(flags.any(axis=1))
        if not len(some):
            return []
        turn = np.diff(np.pad(flags[some].astype(np.int8), ((0, 0), (1, 1))), axis=1)
        row, a = np.nonzero(turn == 1)
        b = np.nonzero(turn == -1)[1]
        top = flags.shape[1] - 1
        entry = some[row]
        s = e.offset[entry] - (top - a)  # window starts, from the stretch's start
        t = e.offset[entry] - (top - (b - 1)) + self.kind.window
        n = e.hi[entry] - e.lo[entry]
        place = np.repeat(e.lo[entry], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        bucket, idx = np.repeat(e.bucket[entry], n), e.idx[place].astype(np.int64)
        s, t = np.repeat(s, n) + e.at[place], np.repeat(t, n) + e.at[place]
        return [(0, b, pack(idx[x], s[x], t[x])) for b, x in _groups(bucket)]


def _word_counts(sizes: np.ndarray, content: bytes) -> np.ndarray:
    spaces = np.concatenate([[0], np.cumsum(np.frombuffer(content, np.uint8) == 32)])
    ends = np.cumsum(sizes + 1) - 1
    return (spaces[ends] - spaces[ends - sizes] + 1).astype(np.int64)


def later(identity: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Whether a smaller document stands under the same identity."""
    if not len(doc):
        return np.zeros(0, bool)
    order = np.argsort(identity, kind="stable")
    same = identity[order]
    first = np.flatnonzero(np.concatenate([[True], same[1:] != same[:-1]]))
    low = np.minimum.reduceat(doc[order], first)
    out = np.empty(len(doc), bool)
    out[order] = doc[order] > np.repeat(low, np.diff(np.append(first, len(doc))))
    return out


def renumber(*columns: np.ndarray) -> np.ndarray:
    """Numbers that are equal where all columns are."""
    out = columns[0].astype(np.int64)
    for c in columns[1:]:
        c = c.astype(np.int64)
        width = int(c.max()) + 1 if len(c) else 1
        _, out = np.unique(out * width + c, return_inverse=True)
    return out


def summary(found: DataFrame, n: str) -> DataFrame:
    """doc_id, the count of symbols under the name ``n``, n_removed, n_spans and kept_sha256."""
    removed = F.aggregate(F.transform("runs", lambda x, i: F.when(i % 2 == 1, x).otherwise(-x)), F.lit(0).cast("long"), lambda a, x: a + x)
    return found.select("doc_id", F.col("n").alias(n), removed.alias("n_removed"), F.floor(F.size("runs") / 2).cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
