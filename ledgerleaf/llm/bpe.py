"""BPE encoding and decoding with forced-boundary splitting.

A merge can only join two symbols whose meeting bytes stand side by side inside some token of the
vocabulary. A byte pair that occurs inside no token is therefore a certain cut: no merge ever
crosses it, whatever stands around it. Each pre-token is cut at all such pairs, its fragments
are encoded independently of each other, and the ids are concatenated. Only the last fragment
of a pre-token carries the end-of-word mark.

Text is read as the tokenizer file says: its special strings first, then its normaliser, then its
pre-tokeniser. Texts in Latin letters are lower-cased and cut by a pattern equal to the file's whose classes are
spelled out; others go through the library's own normaliser and pre-tokeniser.

Decoding joins the token strings as the library does for a file without a decoder: by one space.

Defined results: a null or empty text has no ids and decodes to the empty string; repeated rows
each give a row; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CACHES, id_text, map_arrow

#: Pre-tokens whose encoding a worker remembers.
CACHE_WORDS = 1 << 17
SCHEMA = "doc_id long, ids array<int>, decoded string"


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in set(shown) else chr(next(spare)) for b in range(256)]


def _latin(kind: str) -> str:
    return "".join(re.escape(chr(c)) for c in range(0x250) if unicodedata.category(chr(c))[0] == kind)


class Codec:
    """One tokenizer file, ready to encode and decode."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.models import BPE

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        library, model = Tokenizer.from_file(path), spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        vocab: dict[str, int] = model["vocab"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.whole = BPE(vocab, merges, end_of_word_suffix=self.suffix) if self.suffix else BPE(vocab, merges)
        self.inner = BPE(vocab, merges)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_re = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.normalizer, self.pre_tokenizer = library.normalizer, library.pre_tokenizer
        self.names = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.letters = byte_letters()
        self.to_letters = {b: c for b, c in enumerate(self.letters)}
        bare = (t.removesuffix(self.suffix) if self.suffix else t for t in vocab)
        #: Pairs of neighbours inside some token; every other pair is a certain cut.
        self.inside = {t[i : i + 2] for t in bare for i in range(len(t) - 1)}
        letters, numbers = _latin("L"), _latin("N")
        # below U+0250 composing changes nothing, white space only separates, and both lower-casings agree
        self.odd = re.compile("[^\x00-ɏ]")
        self.latin_words = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^\\t-\\r \x85\xa0{letters}{numbers}]+").findall
        self.seen_ids: dict[str | tuple[str], bytes] = {}
        self.seen_names: dict[str | tuple[str], str] = {}
        self.old_ids, self.old_names = dict(self.seen_ids), dict(self.seen_names)

    def fragments(self, word: str) -> list[str]:
        """A byte-level pre-token cut at every pair that no token holds."""
        out, at = [], 0
        for i in range(1, len(word)):
            if word[i - 1 : i + 1] not in self.inside:
                out.append(word[at:i])
                at = i
        out.append(word[at:])
        return out

    def encode_word(self, word: str) -> list[int]:
        """Ids of a pre-token in byte-level letters."""
        *first, last = self.fragments(word)
        return [t.id for f in first for t in self.inner.tokenize(f)] + [t.id for t in self.whole.tokenize(last)]

    def words(self, text: str) -> list[str | tuple[str]]:
        """Pre-tokens of a text without special strings: Latin ones as they stand, others in byte-level letters inside a 1-tuple."""
        low = text.lower()
        if self.odd.search(text) or self.odd.search(low):
            return [(w,) for w, _ in self.pre_tokenizer.pre_tokenize_str(self.normalizer.normalize_str(text))]
        return self.latin_words(low)

    def learn(self, words: list[str | tuple[str]]) -> None:
        """Encode the words not seen yet; ids are kept as the bytes of 32-bit numbers, so that those of a text are joined at once. A full cache becomes the old one, from which words still in use come back."""
        new = set(words).difference(self.seen_ids)
        if len(self.seen_ids) + len(new) > CACHE_WORDS:
            self.old_ids, self.old_names = self.seen_ids, self.seen_names
            self.seen_ids, self.seen_names = {}, {}
            new = set(words)
        for w in new:
            ids = self.old_ids.get(w)
            if ids is None:
                got = self.encode_word(w[0] if isinstance(w, tuple) else w.encode().decode("latin-1").translate(self.to_letters))
                self.seen_ids[w] = array("i", got).tobytes()
                self.seen_names[w] = " ".join([self.names[i] for i in got])
            else:
                self.seen_ids[w], self.seen_names[w] = ids, self.old_names[w]

    def encode(self, text: str) -> tuple[bytes, str]:
        """Ids of a whole text, as bytes of 32-bit numbers, and its decoding."""
        parts = self.special_re.split(text) if self.special_re else [text]
        ids: list[bytes] = []
        names: list[str] = []
        for k, part in enumerate(parts):
            if k % 2:
                ids.append(array("i", [self.special[part]]).tobytes())
                names.append(part)
            elif part:
                words = self.words(part)
                for at in range(0, len(words), CACHE_WORDS // 2):  # so that what one call needs always fits the cache
                    some = words[at : at + CACHE_WORDS // 2]
                    self.learn(some)
                    ids += map(self.seen_ids.__getitem__, some)
                    names += filter(None, map(self.seen_names.__getitem__, some))
        return b"".join(ids), " ".join(names)

    def decode(self, ids: list[int]) -> str:
        """As the library decodes with skip_special_tokens=False and no decoder in the file."""
        return " ".join(self.names[i] for i in ids if i in self.names)


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


CACHES["bpe"] = codec.cache_clear


def encode_decode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, ids (array<int>), decoded (the text those ids decode to)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(tokenizer_path)
        for batch in batches:
            got = [c.encode(t) for t in batch.column(1).to_pylist()]
            ends = np.zeros(len(got) + 1, np.int32)
            np.cumsum([len(ids) // 4 for ids, _ in got], out=ends[1:])
            flat = np.frombuffer(b"".join(ids for ids, _ in got), np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array([d for _, d in got], pa.string())], ["doc_id", "ids", "decoded"])

    return map_arrow(id_text(docs, id_col, text_col), run, SCHEMA, "bpe")


def digests(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of what ``encode_decode`` returns."""
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
