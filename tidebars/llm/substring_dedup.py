"""Substring deduplication on words: windows of 20 words that also start earlier are found by super-k-mers."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import lean
from .superkmers import Space, bucket_count, covered, hashed_groups, ids_repeat, keyed, packed_blocks, settled_spans, spans_of, with_spans, word_values

BUCKET_BYTES = 32_000_000


def split_words(texts: list[str | bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """Word codes of all texts, a hash for each, the number of words of each text, and the words by code."""
    lists = [(t if isinstance(t, bytes) else t.encode()).split() for t in texts]  # bytes.split() cuts at x20 and x09-x0D, as words are defined
    words = sorted(set(chain.from_iterable(lists)))  # in order, so that packed lists of words compress
    code = {w: i for i, w in enumerate(words)}
    n = sum(map(len, lists))
    codes = np.fromiter(map(code.__getitem__, chain.from_iterable(lists)), np.int32, n)
    return codes, word_values(words)[codes], np.array([len(ws) for ws in lists], np.int64), words


def word_space(window: int, minimiser: int) -> Space:
    return Space(window, minimiser, False, split_words, hashed_groups(window), 8_000_000)


def substring_dedup(docs: DataFrame, window: int = 20, minimiser: int = 3, keep_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and kept, if asked for) of every row of docs.

    A word is removed if a window of ``window`` consecutive words covers it whose word sequence starts earlier:
    in a row of smaller doc_id, or in the same row before. Null text has no words; shorter texts have no
    windows. Null doc_ids go first; rows of one doc_id and different texts go in order of a text hash; rows
    that repeat doc_id and text count once and share the result. Long texts are processed whole, an empty
    table gives an empty result. Only doc_id and text are read.
    """
    rows, space = keyed(docs, ids_repeat(docs)), word_space(window, minimiser)
    blocks = packed_blocks(rows.select("key", "row_hash", "text"), space, bucket_count(docs, BUCKET_BYTES))

    @lean
    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, removed, sha, kept = [], [], [], []
            for text, (starts, counts) in zip(batch.column(1), spans_of(batch.column(2))):
                words = text.as_py().encode().split()
                gone = covered(len(words), starts, counts, window) if len(starts) else None
                left = b" ".join(words if gone is None else [w for w, g in zip(words, gone.tolist()) if not g])
                total.append(len(words))
                removed.append(0 if gone is None else int(gone.sum()))
                sha.append(hashlib.sha256(left).hexdigest())
                kept.append(left)
            out = [batch.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha, pa.string())]
            yield pa.RecordBatch.from_arrays(out + [pa.array(kept, pa.binary()).cast(pa.string())] * keep_text, ["doc_id", "n_words", "n_removed", "kept_sha256"] + ["kept"] * keep_text)

    found = with_spans(rows, settled_spans(blocks, space))
    return found.mapInArrow(remove, "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * keep_text)
