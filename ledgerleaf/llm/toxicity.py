"""Toxicity: Levenshtein automata run along a lexicon trie, and context windows that tell quotation from abuse.

The lexicon is learned: over a bounded sample of labelled rows, words and word beginnings are
counted in toxic and in clean documents; those that stand out (log-likelihood ratio) and are
several times likelier in toxic ones, in different surroundings, become entries, with that odds' logarithm as weight. The
words among them form a trie. A word of the text is
looked up as it stands (word or beginning) and else by walking the trie together with the
Levenshtein automaton of the word, which visits only nodes that can still end within the allowed
distance: so misspelled terms are caught. Misspellings are sought of every entry that a share of the toxic documents holds;
entries whose near words turn up in clean training
documents are not used for near matches.

Each hit is read in its window of the text around it: a hit between an opening and the closing quotation mark, both
within the window and on one line, counts as quotation (an apostrophe within a word is no mark), others
as abuse, and hits close to each other raise the density. A logistic model over these counts,
fitted on the same sample with a prior that fixes its shape where data are few, gives the score.
The lexicon has as many entries as pass these tests: fewer than the bounded sample has terms.

Labels are learned only from rows whose crc32(doc_id as text) mod 4 is not 2. The sample holds
SAMPLE labelled rows at most, chosen by a hash of the id; everything else covers all rows.

Defined results: a null or empty text scores as one without hits; a null doc_id is not held out
and never learned from; repeated documents each give a row; several labels of one document count
as toxic if one is; without labels the prior alone scores; other columns are not read.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CACHES, filter_rows, id_text, map_arrow, table_once

SAMPLE = 20_000
THRESHOLD = 0.3
WINDOW = 48  # characters on each side of a hit
LEAST_GAIN = 11.0  # log-likelihood ratio of a lexicon entry
LEAST_ODDS = 1.1  # natural logarithm of how many times likelier an entry is in toxic documents
LONGEST_START = 8
LEAST_CONTEXTS, AROUND = 3, 16  # different surroundings in toxic documents that an entry needs, so that copies of one document make none, and characters of them on each side
NEAR_SHARE = 0.02  # of the toxic documents, that an entry needs for its misspellings to be sought
KNOWN_WORDS = 1 << 17
KNOWN_STATES = 1 << 15
WORD = re.compile(r"[^\W\d_]+")
#: Marks of quotation, none of them between letters; a line's end closes nothing but ends all that is open.
MARK = re.compile(r"[\"“”„«»‹›]|(?<!\w)[‘’]|’(?!\w)|\n")
#: What closes a mark that opens.
CLOSES = {'"': '"', "“": "”", "„": "“”", "”": "”", "«": "»", "»": "«", "‹": "›", "›": "‹", "‘": "’", "’": "’"}
#: Weights before data of: constant, abuse (summed), abuse (strongest), hits, near, quoted, density.
PRIOR = np.array([-5.0, 1.5, 0.4, 1.0, 2.0, 0.3, 0.3])
PRIOR_STRENGTH = np.array([0.1, 0.1, 0.3, 0.3, 1.0, 1.0, 3.0])


def terms_of(text: str) -> set[str]:
    """Words and word beginnings (marked by a final *) of a text."""
    out = set()
    for w in set(WORD.findall(text.lower())):
        if len(w) >= 4:
            out.add(w)
        for k in range(3, LONGEST_START + 1):
            if len(w) >= k:
                out.add(w[:k] + "*")
    return out


def gain(a: int, b: int, n_a: int, n_b: int) -> float:
    """Log-likelihood ratio of a term in ``a`` of ``n_a`` toxic and ``b`` of ``n_b`` clean documents."""
    n, seen = n_a + n_b, a + b
    cells = ((a, n_a * seen / n), (b, n_b * seen / n), (n_a - a, n_a * (n - seen) / n), (n_b - b, n_b * (n - seen) / n))
    return 2 * sum(o * math.log(o / e) for o, e in cells if o > 0 and e > 0)


def edits(word: str) -> int:
    """How many edits may lie between a word and an entry, by the length of either."""
    return 0 if len(word) < 5 else 1 if len(word) < 9 else 2


class NearWords:
    """A trie of entries, walked by the Levenshtein automata of their words.

    A state holds the trie nodes that the letters read so far can have led to, each with the fewest edits spent;
    nodes on which more was spent than any entry below allows are left out. States and their steps are
    built when first needed and kept, so that reading a word is one step for each letter until it fails.
    """

    def __init__(self, words: list[str]):
        self.children: list[dict[str, int]] = [{}]
        self.entry: list[str | None] = [None]
        self.most = [0]
        for w in words:
            node = 0
            for c in w:
                self.most[node] = max(self.most[node], edits(w))
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.entry.append(None)
                    self.most.append(0)
                node = self.children[node][c]
            self.most[node] = max(self.most[node], edits(w))
            self.entry[node] = w
        self.forget()

    def forget(self) -> None:
        self.states: list[tuple[tuple[int, int], ...]] = []
        self.steps: list[dict[str, int]] = []
        self.numbers: dict[tuple[tuple[int, int], ...], int] = {}
        self.number({0: 0})

    def number(self, spent: dict[int, int]) -> int:
        """Close a state under letters of entries that the word lacks, and number it."""
        todo = list(spent)
        while todo:
            node = todo.pop()
            for child in self.children[node].values():
                if (e := spent[node] + 1) <= self.most[child] and e < spent.get(child, 9):
                    spent[child] = e
                    todo.append(child)
        key = tuple(sorted(spent.items()))
        if key not in self.numbers:
            self.numbers[key] = len(self.states)
            self.states.append(key)
            self.steps.append({})
        return self.numbers[key]

    def step(self, state: int, letter: str) -> int:
        spent: dict[int, int] = {}
        for node, e in self.states[state]:
            if e + 1 <= self.most[node]:
                spent[node] = min(spent.get(node, 9), e + 1)  # a letter too many
            for c, child in self.children[node].items():
                if (cost := e + (c != letter)) <= self.most[child]:
                    spent[child] = min(spent.get(child, 9), cost)
        self.steps[state][letter] = number = self.number(spent) if spent else -1
        return number

    def find(self, word: str) -> str | None:
        """The nearest entry within the allowed distance, the alphabetically first of equally near ones."""
        if not edits(word) or not self.children[0]:
            return None
        if len(self.states) > KNOWN_STATES:
            self.forget()
        state = 0
        for c in word:
            state = self.steps[state][c] if c in self.steps[state] else self.step(state, c)
            if state < 0:
                return None
        found = [(e, self.entry[node]) for node, e in self.states[state] if self.entry[node] and e <= min(edits(word), edits(self.entry[node]))]
        return min(found)[1] if found else None


def quotations(text: str) -> list[tuple[int, int]]:
    """Start and end of what stands between an opening mark and the mark that closes it, on one line, in order of the ends."""
    out, open_marks = [], []
    for m in MARK.finditer(text):
        if m[0] == "\n":
            open_marks.clear()
            continue
        at = next((k for k in range(len(open_marks) - 1, -1, -1) if m[0] in CLOSES[open_marks[k][0]]), None)
        if at is None:
            if not m.start() or not (text[m.start() - 1].isalnum() or text[m.start() - 1] == "_"):  # after a letter a mark only closes
                open_marks.append((m[0], m.end()))
        else:
            out.append((open_marks[at][1], m.start()))
            del open_marks[at:]
    return out


class Lexicon:
    """Entries with their weights, ready to be looked up."""

    def __init__(self, weights: dict[str, float], near: list[str]):
        self.weights = weights
        self.near = near
        self.trie = NearWords(near)
        self.known: dict[str, tuple[str, str] | None] = {}

    def __reduce__(self):
        return _lexicon, (tuple(self.weights.items()), tuple(self.near))  # a worker keeps what it has looked up for later tasks

    def look_up(self, word: str) -> tuple[str, str] | None:
        """('exact' or 'near', the most specific entry) or None."""
        if word in self.weights:
            return "exact", word
        for k in range(min(len(word), LONGEST_START), 2, -1):
            if word[:k] + "*" in self.weights:
                return "exact", word[:k] + "*"
        entry = self.trie.find(word)
        return ("near", entry) if entry else None

    def hits(self, text: str) -> tuple[int, list[tuple[str, str, int, int]]]:
        """Number of words, and kind, entry, start and end of each hit. ``text`` is in lower case."""
        words = WORD.findall(text)
        if len(self.known) > KNOWN_WORDS:
            self.known.clear()
        for w in set(words).difference(self.known):
            self.known[w] = self.look_up(w)
        if not any(map(self.known.get, words)):
            return len(words), []
        return len(words), [(*found, m.start(), m.end()) for m in WORD.finditer(text) if (found := self.known[m[0]])]

    def features(self, text: str) -> np.ndarray:
        text = text.lower()
        n, found = self.hits(text)
        abuse = strongest = near = quoted = 0.0
        plain = close = 0
        before = -WINDOW - 1
        once = set()
        quotes = quotations(text) if found else []
        ends = [b for _, b in quotes]
        for kind, entry, s, e in found:
            w = self.weights[entry]
            close += s - before <= WINDOW
            before = e
            if text[s:e] in once:  # a word counts once, however often it is repeated
                continue
            once.add(text[s:e])
            if any(s - WINDOW <= a <= s for a, _ in quotes[bisect_left(ends, e) : bisect_right(ends, e + WINDOW)]):
                quoted += w
            elif kind == "near":
                near += w
            else:
                abuse += w
                strongest = max(strongest, w)
                plain += 1
        return np.round([1.0, math.log1p(abuse), strongest, math.log1p(plain), math.log1p(near), math.log1p(quoted), min(3.0, math.log1p(close) + 20.0 * len(once) / max(20, n))], 3)


@lru_cache(maxsize=1)
def _lexicon(weights: tuple[tuple[str, float], ...], near: tuple[str, ...]) -> Lexicon:
    return Lexicon(dict(weights), list(near))


CACHES["toxicity"] = _lexicon.cache_clear


def fit_weights(x: np.ndarray, toxic: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Logistic weights with a normal prior around PRIOR, by Newton's method; row i of ``x`` stands for n[i] documents, toxic[i] of them toxic. A step is halved until it lowers the cost enough."""

    def cost(w: np.ndarray) -> float:
        z = x @ w
        return float(np.sum(n * np.logaddexp(0, z) - toxic * z) + 0.5 * np.sum(PRIOR_STRENGTH * (w - PRIOR) ** 2))

    w = PRIOR.copy()
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (toxic - n * p) - PRIOR_STRENGTH * (w - PRIOR)
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + np.diag(PRIOR_STRENGTH), slope)
        now, share = cost(w), 1.0
        while share > 1e-6 and cost(w + share * step) > now - 1e-4 * share * float(slope @ step):
            share /= 2
        w = w + share * step
        if np.abs(share * step).max() < 1e-6:
            break
    return w


class Model:
    def __init__(self, lexicon: Lexicon, weights: np.ndarray):
        self.lexicon, self.weights = lexicon, weights

    def score(self, text: str) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.lexicon.features(text) @ self.weights, -30, 30))))


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, sample: int, id_col: str, text_col: str) -> DataFrame:
    """text and toxic of at most ``sample`` labelled rows that are not held out (ids are sampled by hash; their rows are joined by a broadcast of that bounded list)."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out(F.col("doc_id")))
    some = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    return id_text(docs, id_col, text_col).join(F.broadcast(some), "doc_id").select("text", "toxic")


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Model:
    rows = table_once(training_rows(docs, labels, sample, id_col, text_col))  # bounded by the sample; read three times

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                seen[toxic > 0].update(terms_of(text) | {""})
        terms = list(seen[0].keys() | seen[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), *(pa.array([seen[k][t] for t in terms], pa.int64()) for k in (1, 0))], ["term", "toxic", "clean"])

    counts = map_arrow(rows, count, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    # only terms that can pass come to the driver: fewer than the bounded sample's distinct terms
    total = {r["term"]: r for r in counts.where("term = '' OR (toxic >= 3 AND toxic * 4 >= clean)").collect()}
    everything = total.pop("", None)
    n_a, n_b = (everything["toxic"], everything["clean"]) if everything else (0, 0)
    gains, odds = {}, {}
    for t, r in total.items() if n_a and n_b else ():
        w = math.log((r["toxic"] + 0.5) / (n_a + 1)) - math.log((r["clean"] + 0.5) / (n_b + 1))
        if w >= LEAST_ODDS and (g := gain(r["toxic"], r["clean"], n_a, n_b)) >= LEAST_GAIN:
            gains[t], odds[t] = g, w
    ranked = sorted(gains, key=lambda t: (-gains[t], t))
    # of entries that begin alike and say as much, the longest stays
    vague = {b + "*" for t in ranked for k in range(3, len(t.rstrip("*")) + 1) if (b := t[:k].rstrip("*")) + "*" != t and gains[t] >= 0.97 * gains.get(b + "*", math.inf)}
    weights = {t: odds[t] for t in ranked if t not in vague}
    # misspellings are sought of words that say as much as their own beginnings do and stand in a share of the toxic documents
    whole = [t for t in ranked if t[-1] != "*" and edits(t) and total[t]["toxic"] >= NEAR_SHARE * n_a and gains[t] >= 0.8 * max([gains.get(t[:k] + "*", 0) for k in range(3, LONGEST_START + 1)])]
    lexicon = Lexicon(weights, whole)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near, seen = [], []
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                text = text.lower()
                found = lexicon.hits(text)[1]
                near.append(sorted({e for kind, e, _, _ in found if kind == "near"}))
                seen.append(sorted({(entry, text[max(0, s - AROUND) : e + AROUND]) for kind, entry, s, e in found if toxic and kind == "exact"}))
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(near, pa.list_(pa.string())), pa.array([[e for e, _ in x] for x in seen], pa.list_(pa.string())), pa.array([[c for _, c in x] for x in seen], pa.list_(pa.string()))], ["toxic", "near", "entry", "context"])

    read = table_once(map_arrow(rows, describe, "toxic int, near array<string>, entry array<string>, context array<string>", "toxicity"))
    clean = read.select(F.explode("near").alias("entry"), "toxic").groupBy("entry").agg(F.sum(F.when(F.col("toxic") > 0, 0).otherwise(1)).alias("clean"))
    loose = {r["entry"] for r in clean.where("clean > 0").collect()}  # at most one row for each entry
    contexts = read.select(F.explode(F.arrays_zip("entry", "context")).alias("e")).groupBy("e.entry").agg(F.countDistinct(F.xxhash64("e.context")).alias("n"))
    known = {r["entry"] for r in contexts.where(F.col("n") >= LEAST_CONTEXTS).collect()}
    lexicon = Lexicon({t: w for t, w in weights.items() if t in known}, [t for t in whole if t in known and t not in loose])

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [lexicon.features(t).tolist() for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(x, pa.list_(pa.float64()))], ["toxic", "x"])

    # equal feature rows are added up by Spark before the fit sees them
    table = map_arrow(rows, features, "toxic int, x array<double>", "toxicity").groupBy("x").agg(F.sum(F.when(F.col("toxic") > 0, 1).otherwise(0)).alias("a"), F.count("*").alias("n")).collect()
    x = np.array([r["x"] for r in table]).reshape(-1, len(PRIOR))
    order = np.lexsort(x.T)
    a, n = (np.array([r[k] for r in table], float) for k in ("a", "n"))
    return Model(lexicon, fit_weights(x[order], a[order], n[order]))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([model.score(t) for t in batch.column(1).to_pylist()], pa.float64())], ["doc_id", "score"])

    scored = map_arrow(id_text(docs, id_col, text_col), run, "doc_id long, score double", "toxicity")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` scored under THRESHOLD, with all their columns."""
    return filter_rows(docs, lambda texts: [model.score(t) < THRESHOLD for t in texts], text_col, "toxicity")
