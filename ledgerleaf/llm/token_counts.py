"""Token counts: batch encoding in Arrow functions that return lengths only.

Texts are gathered into batches balanced by bytes, and a long text is split where the
tokenizer's own pre-splitting is certain to cut: before white space that follows something
else. There the piece before ends (no pre-token holds white space after another character) and
the piece after begins anew (the pattern never looks back), so the counts of the pieces add up.
Such a place is searched from a fixed number of bytes on; a text without any stays whole.

Defined results: a null or empty text has 0 bytes and 0 tokens; repeated rows each give a row;
an empty table gives no rows; other columns are not read. Special strings inside a text are
found by the library, as it does by default.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import CACHES, id_text, map_arrow

PIECE_BYTES = 1 << 14
GATHERED_BYTES = 1 << 19
#: A character that no Unicode version calls white space, before one that all do.
SAFE_CUT = re.compile("[^\\s\x00-\x20\x7f-\xa0\u1680\u180e\u200b\ufeff](?=[ \\t\\n\\r])")
SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


@lru_cache(maxsize=4)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # each Spark task has one core
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


CACHES["token_counts"] = _tokenizer.cache_clear


def pieces(text: str, size: int) -> Iterator[str]:
    """Split at safe boundaries into pieces of about ``size`` characters; their concatenation is the text."""
    at, n = 0, len(text)
    while n - at > size:
        m = SAFE_CUT.search(text, at + size)
        if not m:
            break
        yield text[at : m.end()]
        at = m.end()
    yield text[at:]


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = _tokenizer(tokenizer_path)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            counts, sizes = [0] * len(texts), [0] * len(texts)
            held: list[str] = []
            owner: list[int] = []
            gathered = 0

            def flush() -> None:
                for k, e in zip(owner, tok.encode_batch_fast(held, add_special_tokens=False)):
                    counts[k] += len(e)

            for k, text in enumerate(texts):
                sizes[k] = len(text.encode())
                if gathered + min(sizes[k], PIECE_BYTES) > GATHERED_BYTES:
                    flush()
                    held, owner, gathered = [], [], 0
                if sizes[k] <= PIECE_BYTES:
                    held.append(text)
                    owner.append(k)
                    gathered += sizes[k]
                    continue
                for piece in pieces(text, max(1, PIECE_BYTES * len(text) // sizes[k])):  # so many characters of this text take PIECE_BYTES
                    held.append(piece)
                    owner.append(k)
                    gathered += len(piece.encode())
                    if gathered >= GATHERED_BYTES:
                        flush()
                        held, owner, gathered = [], [], 0
            flush()
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array([c > limit for c in counts], pa.bool_())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return map_arrow(id_text(docs, id_col, text_col), run, SCHEMA, "token_counts")
