"""Benchmark decontamination over a stored, distributed positional inverted index.

The training documents are indexed shard by shard: each slice of documents becomes one row of a stored table with the
posting list (sorted positions) of every term in it. Everything after that reads the index, not
the texts. First the lists' lengths give how often each benchmark term occurs in the whole corpus. Then each window of a
benchmark item starts from the posting list of its rarest term, shifted by that term's offset,
and is intersected with the shifted lists of its other terms, rarer ones first. What is left
are exact phrase matches; ``find_near`` finds all terms of a window close to each other, in any order. Since shards are
split by document, no posting is shuffled and a passage that a third of all documents hold costs no more than its own
occurrences.

The benchmark is the stated query set. It is cut into blocks of bounded size, whose number follows from its measured
size, and every shard meets every block in one pass; Spark chooses by their stored size how the blocks reach the shards.

Words: A-Z lower-cased, then runs of digits, a-z and characters from U+0080 on. A term is known by a 64-bit hash of the
word.

Defined results: a null or empty document has no words and no hits; a null or wordless item has no
window; a null item_id is named by the empty string; items with equal ids count once; repeated
documents each give a row, equal matches of ``find_near`` in one document one row; spans of equal length go to the
leftmost; empty tables give no rows or no hits; other columns are not read (``drop_contaminated`` keeps them).
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, id_text, map_arrow, scratch, table_once
from .repeats import Words, pack, unpack, word_values

WINDOW = 10
BLOCK_BYTES = 4 << 20
EXPAND = 1 << 18  # occurrences that are worked on at once
SHARD_WORDS = 1 << 20  # words of a shard (a longer document stands alone)
SPAN = 1 << 40  # beyond any position of a shard
#: A-Z to a-z; every ASCII byte that is no digit or letter to a blank.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: str) -> Words:
    return Words(text.encode().translate(WORD_BYTES))


def terms_of(texts: list[Words]) -> list[np.ndarray]:
    """The terms of each text."""
    n = np.cumsum([len(w) for w in texts])
    return np.split(word_values(texts), n[:-1]) if n.size and n[-1] else [np.zeros(0, np.uint64) for _ in texts]


class Postings:
    """Posting lists of a slice of documents: ``terms`` in order, how many ``counts`` places each has, and the places, one list after the other.

    Documents follow each other with one place left free after each, so that no phrase crosses from one into the next;
    ``first`` are their first places, and the end.
    """

    def __init__(self, first: np.ndarray, terms: np.ndarray, counts: np.ndarray, places: np.ndarray):
        self.first, self.terms, self.counts, self.places = first, terms, counts, places
        self.at = np.concatenate([[0], np.cumsum(counts)])

    @classmethod
    def of(cls, texts: list[str] | list[Words]) -> "Postings":
        words = [words_of(t) if isinstance(t, str) else t for t in texts]
        n = np.array([len(w) for w in words], np.int64)
        first = np.concatenate([[0], np.cumsum(n + 1)])
        found = np.concatenate([np.zeros(0, np.uint64), *terms_of(words)])
        where = np.arange(n.sum()) + np.repeat(np.arange(len(n)), n)
        order = np.argsort(found, kind="stable")
        found = found[order]
        heads = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]])) if len(found) else np.zeros(0, np.int64)
        return cls(first, found[heads], np.diff(np.append(heads, len(found))), where[order])

    def packed(self) -> tuple[bytes, bytes]:
        """The terms with the lengths of their lists, and the lists: each place by its distance from the one before."""
        steps = np.diff(self.places, prepend=0)
        steps[self.at[:-1]] = self.places[self.at[:-1]]
        return pack(self.terms, self.counts.astype(np.uint32)), pack(self.first, steps.astype(np.uint32))

    @classmethod
    def unpacked(cls, terms: bytes, lists: bytes) -> "Postings":
        (terms, counts), (first, steps) = unpack(terms), unpack(lists)
        counts = counts.astype(np.int64)
        sums = np.cumsum(steps, dtype=np.int64)
        heads = np.cumsum(counts) - counts
        return cls(first, terms, counts, sums - np.repeat(sums[heads] - steps[heads], counts))

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """The number of each wanted term's list, -1 where no document holds it."""
        if not len(self.terms):
            return np.full(len(wanted), -1)
        at = np.minimum(np.searchsorted(self.terms, wanted), len(self.terms) - 1)
        return np.where(self.terms[at] == wanted, at, -1)


class Queries:
    """The windows of a block of benchmark items, with terms numbered by the order of their hashes."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        hashes = terms_of([words_of(t) for _, t in items]) if items else []
        self.vocab = np.unique(np.concatenate([np.zeros(0, np.uint64), *hashes]))
        found: dict[tuple[int, ...], set[str]] = {}
        for (name, _), own in zip(items, hashes):
            ids = np.searchsorted(self.vocab, own).tolist()
            for at in range(max(1, len(ids) - window + 1) if ids else 0):
                found.setdefault(tuple(ids[at : at + window]), set()).add(name)
        self.names = sorted({n for names in found.values() for n in names})
        number = {n: i for i, n in enumerate(self.names)}
        self.groups = []  # one for each window length: length, terms, places of the names, names
        for size in sorted({len(w) for w in found}):
            some = [(w, sorted(number[n] for n in names)) for w, names in found.items() if len(w) == size]
            self.groups.append((size, np.array([w for w, _ in some], np.int64), np.cumsum([0] + [len(n) for _, n in some]), np.array(list(chain.from_iterable(n for _, n in some)), np.int64)))

    def rank(self, frequency: np.ndarray) -> None:
        """Order each window's offsets from its rarest term on."""
        self.orders = [np.argsort(frequency[terms], axis=1, kind="stable") for _, terms, _, _ in self.groups]

    def packed(self) -> bytes:
        return pack(self.vocab, self.names, [(size, terms, at, names, order) for (size, terms, at, names), order in zip(self.groups, self.orders)])

    @classmethod
    def unpacked(cls, blob: bytes) -> "Queries":
        out = object.__new__(cls)
        out.vocab, out.names, some = unpack(blob)
        out.groups, out.orders = [g[:4] for g in some], [g[4] for g in some]
        return out


def _spread(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for each c of counts, in a row."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


def _bounded(counts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Lists of these lengths one after the other, EXPAND entries at a time: numbers of the lists, how many entries of each come before, and how many now."""
    ends = np.cumsum(counts)
    begins = ends - counts
    for lo in range(0, int(ends[-1]) if len(ends) else 0, EXPAND):
        some = np.arange(np.searchsorted(ends, lo, side="right"), np.searchsorted(begins, lo + EXPAND))
        skip = np.maximum(lo - begins[some], 0)
        yield some, skip, np.minimum(counts[some], lo + EXPAND - begins[some]) - skip


class Shard:
    """A block of queries over the posting lists of one slice of documents."""

    def __init__(self, queries: Queries, index: Postings | list[str]):
        p = index if isinstance(index, Postings) else Postings.of(index)
        self.q, self.first = queries, p.first
        lists = p.find(queries.vocab)
        held = lists >= 0
        counts = np.where(held, p.counts[lists] if len(p.counts) else 0, 0)
        self.postings = p.places[np.repeat(p.at[lists[held]], counts[held]) + _spread(counts[held])] if held.any() else np.zeros(0, np.int64)
        self.at = np.concatenate([[0], np.cumsum(counts)])
        self.keyed = self.postings + SPAN * np.repeat(np.arange(len(counts)), counts)  # all lists as one, in order

    def among(self, term: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Whether each place stands in the list of its term."""
        if not len(self.keyed):
            return np.zeros(len(term), bool)
        wanted = place + SPAN * term
        return self.keyed[np.minimum(np.searchsorted(self.keyed, wanted), len(self.keyed) - 1)] == wanted

    def phrases(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Number of the group, window and start of each exact occurrence, for each group in turn."""
        held = np.diff(self.at) > 0
        for g, ((size, terms, _, _), order) in enumerate(zip(self.q.groups, self.q.orders)):
            rows = np.flatnonzero(held[terms].all(axis=1))  # an empty list leaves nothing to intersect
            if not len(rows):
                continue
            rarest = terms[rows, order[rows, 0]]
            for some, skip, n in _bounded(self.at[rarest + 1] - self.at[rarest]):
                row = np.repeat(rows[some], n)
                start = self.postings[np.repeat(self.at[rarest[some]] + skip, n) + _spread(n)] - order[row, 0]
                for j in range(1, size):  # what the next list, shifted, holds too
                    offset = order[row, j]
                    ok = self.among(terms[row, offset], start + offset)
                    row, start = row[ok], start[ok]
                if len(row):
                    yield g, row, start

    def match(self) -> list[tuple[int, list[int], list[str]]]:
        """For each text its number of words, the runs of hit words as [start, end, start, end...] and the items found."""
        edge = np.zeros(int(self.first[-1]) + 1, np.int32)
        some, pairs = [], np.zeros(0, np.int64)  # a document and an item each; ``pairs`` once
        for g, row, start in self.phrases():
            size, _, names_at, names = self.q.groups[g]
            np.add.at(edge, start, 1)
            np.add.at(edge, start + size, -1)
            doc, row = np.divmod(np.unique((np.searchsorted(self.first, start, side="right") - 1) * len(names_at) + row), len(names_at))  # once for each document, before all items of a window come in
            for part, skip, n in _bounded(names_at[row + 1] - names_at[row]):
                some.append(np.unique(np.repeat(doc[part], n) * len(self.q.names) + names[np.repeat(names_at[row[part]] + skip, n) + _spread(n)]))
                if sum(map(len, some)) > EXPAND + len(pairs):
                    some, pairs = [], np.unique(np.concatenate([pairs, *some]))
        n_docs = len(self.first) - 1
        runs: list[list[int]] = [[] for _ in range(n_docs)]
        items: list[list[str]] = [[] for _ in range(n_docs)]
        if edge.any():
            hit = np.cumsum(edge[:-1]) > 0
            turns = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]]))).reshape(-1, 2)
            for (s, e), d in zip(turns.tolist(), (np.searchsorted(self.first, turns[:, 0], side="right") - 1).tolist()):
                runs[d] += [s - int(self.first[d]), e - int(self.first[d])]
            for p in np.unique(np.concatenate([pairs, *some])).tolist():
                items[p // len(self.q.names)].append(self.q.names[p % len(self.q.names)])
        return [(int(n), r, i) for n, r, i in zip(np.diff(self.first) - 1, runs, items)]

    def near(self, slop: int) -> list[tuple[int, str, int, int]]:
        """Text number, item, start and end of the shortest span around each posting of a window's rarest term that holds all its terms, in any order, within its length plus ``slop``."""
        out = set()
        for (size, terms, names_at, names), order in zip(self.q.groups, self.q.orders):
            for row in range(len(terms)):
                wanted = list(dict.fromkeys(terms[row, order[row]].tolist()))
                lists = [self.postings[self.at[t] : self.at[t + 1]] for t in wanted]
                if not all(map(len, lists)):
                    continue
                for p in lists[0].tolist():
                    d = int(np.searchsorted(self.first, p, side="right")) - 1
                    lo, hi = max(p - size - slop + 1, int(self.first[d])), min(p + size + slop, int(self.first[d + 1]) - 1)
                    inside = [x[np.searchsorted(x, lo) : np.searchsorted(x, hi)] for x in lists[1:]]
                    if all(len(x) for x in inside):
                        best = None
                        for s in sorted({p, *(int(v) for x in inside for v in x if v < p)}):  # the span starts at one of the postings
                            ends = [p] + [int(x[np.searchsorted(x, s)]) if np.searchsorted(x, s) < len(x) else hi for x in inside]
                            if max(ends) < hi and max(ends) - s < size + slop and (best is None or max(ends) - s < best[1] - best[0]):
                                best = (s, max(ends))
                        if best:
                            out |= {(d, self.q.names[i], best[0] - int(self.first[d]), best[1] + 1 - int(self.first[d])) for i in names[names_at[row] : names_at[row + 1]]}
        return sorted(out)


def index_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The stored index of ``docs``: shard, and of its documents in order ids, marks (what a text is known by), terms (with the lengths of their lists) and lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [words_of(t) for t in batch.column(3).to_pylist()]
            for at, end in _shards([len(w) for w in words]):
                terms, lists = Postings.of(words[at:end]).packed()
                known = [pa.array([batch.column(k).slice(at, end - at).to_pylist()], pa.list_(pa.int64())) for k in range(3)]
                yield pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().hex]), *known, pa.array([terms], pa.binary()), pa.array([lists], pa.binary())], ["shard", "ids", "marks", "checks", "terms", "lists"])

    rows = id_text(docs, id_col, text_col).select("doc_id", *marks_of(F.col("text")), "text")
    return table_once(map_arrow(rows, run, "shard string, ids array<long>, marks array<long>, checks array<long>, terms binary, lists binary"))


def _shards(n_words: list[int]) -> Iterator[tuple[int, int]]:
    """Slices of documents that have SHARD_WORDS words at most."""
    at = total = 0
    for k, n in enumerate(n_words):
        if k > at and total + n > SHARD_WORDS:
            yield at, k
            at, total = k, 0
        total += n
    if n_words:
        yield at, len(n_words)


def marks_of(text: F.Column) -> tuple[F.Column, F.Column]:
    """What a text is known by: two independent hashes, 96 bits and its length together."""
    return F.xxhash64(text).alias("mark"), (F.hash(text).cast("long") * F.lit(1 << 31) + F.octet_length(text)).alias("check")


def query_blocks(benchmark: DataFrame, window: int, id_col: str, text_col: str) -> DataFrame:
    """The benchmark in blocks of bounded size, one for each row: block, vocab, queries; their number follows from its measured size."""
    items = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("name"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    total = items.agg(F.sum(F.octet_length("text") + F.lit(64))).first()[0] or 0
    blocks = max(1, math.ceil(2 * total / BLOCK_BYTES)) if total > BLOCK_BYTES else 1

    def make(table: pa.Table) -> pa.Table:
        q = Queries(list(zip(table["name"].to_pylist(), table["text"].to_pylist())), window)
        q.rank(np.zeros(len(q.vocab), np.int64))
        return pa.table({"block": table["block"][:1], "vocab": pa.array([pack(q.vocab)], pa.binary()), "queries": pa.array([q.packed()], pa.binary())})

    if not total:
        return table_once(benchmark.sparkSession.createDataFrame([(0, pack(Queries([]).vocab), _empty())], "block int, vocab binary, queries binary"))
    dealt = items.withColumn("block", F.pmod(F.xxhash64("name", "text"), F.lit(blocks)).cast("int"))
    return table_once(dealt.groupBy("block").applyInArrow(make, "block int, vocab binary, queries binary"))


def _empty() -> bytes:
    q = Queries([])
    q.rank(np.zeros(0, np.int64))
    return q.packed()


def ranked(blocks: DataFrame, index: DataFrame) -> DataFrame:
    """``blocks`` (block, queries) with the windows' terms in the order of their frequency in the whole corpus, which the lengths of the posting lists give."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, vocab, terms in zip(*(c.to_pylist() for c in batch.columns)):
                wanted, (known, counts) = unpack(vocab)[0], unpack(terms)
                at = Postings(np.zeros(1, np.int64), known, counts, known[:0]).find(wanted)
                n = np.where(at >= 0, counts[at] if len(counts) else 0, 0).astype(np.int64)
                sums[block] = sums[block] + n if block in sums else n
        for block, n in sums.items():
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), block), pa.int32()), pa.array(some, pa.int64()), pa.array(n[some], pa.int64())], ["block", "term", "n"])

    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for blob, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                q = Queries.unpacked(blob)
                frequency = np.zeros(len(q.vocab), np.int64)
                for r in found or []:
                    frequency[r["term"]] = r["n"]
                q.rank(frequency)
                out.append(q.packed())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["block", "queries"])

    met = blocks.select("block", "vocab").crossJoin(index.select("terms"))
    counts = map_arrow(met, count, "block int, term long, n long").groupBy("block", "term").agg(F.sum("n").alias("n"))
    found = counts.groupBy("block").agg(F.collect_list(F.struct("term", "n")).alias("found"))  # at most a block's terms
    return table_once(map_arrow(blocks.select("block", "queries").join(found, "block", "left"), order, "block int, queries binary"))


def _each(of: Callable[[Shard, dict], pa.RecordBatch]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function over rows of the index, each beside a block of queries: ``of`` gets the shard under these queries, and the row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: tuple[bytes, Queries] | None = None
        for batch in batches:
            for k in range(len(batch)):
                r = batch.slice(k, 1).to_pylist()[0]
                if known is None or known[0] != r["queries"]:
                    known = (r["queries"], Queries.unpacked(r["queries"]))
                yield of(Shard(known[1], Postings.unpacked(r["terms"], r["lists"])), r)

    return run


RUNS = pa.list_(pa.int32())
ITEMS = pa.list_(pa.string())


def _hits(index: DataFrame, queries: DataFrame, all_rows: bool) -> DataFrame:
    """shard, place, doc_id, mark, check, n_words, runs, items of the documents with a hit, or of all."""

    def rows(shard: Shard, r: dict) -> pa.RecordBatch:
        got = shard.match()
        some = [k for k, (_, runs, _) in enumerate(got) if runs or all_rows]
        take = lambda c, kind: pa.array([r[c][k] for k in some], kind)
        return pa.RecordBatch.from_arrays([pa.array([r["shard"]] * len(some), pa.string()), pa.array(some, pa.int32()), take("ids", pa.int64()), take("marks", pa.int64()), take("checks", pa.int64()), pa.array([got[k][0] for k in some], pa.int64()), pa.array([got[k][1] for k in some], RUNS), pa.array([got[k][2] for k in some], ITEMS)], ["shard", "place", "doc_id", "mark", "check", "n_words", "runs", "items"])

    return map_arrow(index.crossJoin(queries.select("queries")), _each(rows), "shard string, place int, doc_id long, mark long, check long, n_words long, runs array<int>, items array<string>")


def _joined(pieces: list[list[int]]) -> list[int]:
    out: list[int] = []
    for s, e in sorted((s, e) for some in pieces for s, e in zip(some[::2], some[1::2])):
        if out and s <= out[-1]:
            out[-1] = max(out[-1], e)
        else:
            out += [s, e]
    return out


def find_phrases(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, runs (word offsets start, end, start, end... of what benchmark windows cover), items (ids of the items found, sorted as strings)."""
    index = index_of(docs, id_col, text_col)
    blocks = query_blocks(benchmark, window, item_id, item_text)
    queries = ranked(blocks, index)
    if queries.count() == 1:
        return _hits(index, queries, True).select("doc_id", "n_words", "runs", "items")
    empty = table_once(docs.sparkSession.createDataFrame([(0, _empty())], "block int, queries binary"))
    found = _hits(index, empty, True).unionByName(_hits(index, queries, False))
    each = found.groupBy("shard", "place").agg(F.first("doc_id", ignorenulls=True).alias("doc_id"), F.max("n_words").alias("n_words"), F.collect_list("runs").alias("pieces"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([_joined(p) for p in batch.column(2).to_pylist()], RUNS), batch.column(3)], ["doc_id", "n_words", "runs", "items"])

    return map_arrow(each.select("doc_id", "n_words", "pieces", "items"), join, "doc_id long, n_words long, runs array<int>, items array<string>")


def find_near(docs: DataFrame, benchmark: DataFrame, slop: int, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Proximity matches: doc_id, item, start, end (word offsets) of spans that hold all words of a window, in any order, within its length plus ``slop``."""
    index = index_of(docs, id_col, text_col)
    queries = ranked(query_blocks(benchmark, window, item_id, item_text), index)
    schema = pa.schema([("shard", pa.string()), ("place", pa.int32()), ("doc_id", pa.int64()), ("item", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def rows(shard: Shard, r: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{"shard": r["shard"], "place": d, "doc_id": r["ids"][d], "item": i, "start": s, "end": e} for d, i, s, e in shard.near(slop)], schema)

    found = map_arrow(index.crossJoin(queries.select("queries")), _each(rows), "shard string, place int, doc_id long, item string, start long, end long")
    return found.distinct().select("doc_id", "item", "start", "end")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs`` in which no benchmark window occurs, with all their columns. What occurs depends on the text alone, so rows go by what their text is known by."""
    keep: list[DataFrame] = []
    with scratch(keep=keep):
        index = index_of(docs.select(F.lit(None).cast("long").alias("doc_id"), F.col(text_col).alias("text")))
        hit = table_once(_hits(index, ranked(query_blocks(benchmark, window, item_id, item_text), index), False).select("mark", "check").distinct())
        keep.append(hit)
    a, b = fresh(docs.columns, "_mark"), fresh(docs.columns, "_check")
    mark, check = marks_of(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    marked = docs.withColumns({a: mark, b: check})
    gone = hit.toDF(fresh(marked.columns, "_hit_mark"), fresh(marked.columns, "_hit_check"))
    return marked.join(gone, (F.col(a) == F.col(gone.columns[0])) & (F.col(b) == F.col(gone.columns[1])), "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def report(matches: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of what ``find_phrases`` returns."""
    n_hit = F.aggregate(F.transform("runs", lambda x, i: F.when(i % 2 == 1, x).otherwise(-x)), F.lit(0).cast("long"), lambda a, x: a + x)
    return matches.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("runs") > 0).alias("contaminated"),
    )


#: The same rows in DuckDB's SQL, by comparing every window as text.
ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item, least(len(w), 10) AS k, array_to_string(w[p : p + least(len(w), 10) - 1], ' ') AS s FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS t(p) WHERE len(w) > 0),
k AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT r, p, k, array_to_string(w[p : p + k - 1], ' ') AS s FROM d, k, unnest(range(1, len(w) - k + 2)) AS t(p)),
m AS (SELECT dw.r, dw.p, dw.k, bw.item FROM dw JOIN bw ON bw.k = dw.k AND bw.s = dw.s),
h AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT DISTINCT r, p, k FROM m) x, unnest(range(p, p + k)) AS t(q) GROUP BY r),
i AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM m) GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN i USING (r)
"""
