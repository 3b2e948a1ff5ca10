"""Suffix-array deduplication on bytes: 50-byte strings that start in an earlier document.

Suffixes that share their first 50 bytes share a minimiser, so they are dealt to buckets as packed runs and
each bucket orders its own part of the suffix array by the difference-cover method: suffixes at two of three
positions are named by sorted triples of 8-byte letters, names are sorted again by triples of names until
they tell 50 bytes apart, the third suffixes are sorted by a letter and the next name and merged in, and
neighbours in the order are compared byte by byte. Windows whose hash slot no other window shares are left
out of the sort, as nothing can equal them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import lean
from .superkmers import Space, bucket_count, byte_values, covered, ids_repeat, keyed, packed_blocks, settled_spans, spans_of, with_spans

BUCKET_BYTES = 20_000_000


def _ranks(key: np.ndarray) -> np.ndarray:
    """Dense ranks from 1."""
    order = np.argsort(key)
    new = np.ones(len(order), np.int64)
    new[1:] = key[order[1:]] != key[order[:-1]]
    ranks = np.empty(len(order), np.int64)
    ranks[order] = np.cumsum(new)
    return ranks


def _triple_names(names: np.ndarray, at: np.ndarray, step: int) -> np.ndarray:
    """Ranks of the triples of names at ``at``, one and two steps on; names beyond the end are 0."""
    first, second, third = (names[np.minimum(at + i * step, len(names) - 1)] for i in range(3))
    bits = int(names.max()).bit_length()
    if 3 * bits <= 63:
        return _ranks(first << 2 * bits | second << bits | third)
    return _ranks(_ranks(first << 31 | second) << 31 | third)


def _letters(text: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position on as one big-endian number; shorter than text by 7."""
    n = len(text) - 7
    out = text[:n].astype(np.uint64)
    for j in range(1, 8):
        out <<= np.uint64(8)
        out |= text[j : j + n]
    return out


def sampled_names(letters: np.ndarray, sample: np.ndarray, depth: int) -> np.ndarray:
    """Ranks, by position, of the marked suffixes in order of at least ``depth`` bytes; 0 elsewhere."""
    marked, steps, span = sample.copy(), [], 24
    while span < depth:
        steps.append(span)
        span *= 3
    for s in reversed(steps):  # triples of names need names further on
        before = np.flatnonzero(marked)
        for p in (before + s, before + 2 * s):
            marked[p[p < len(marked)]] = True
    need = np.flatnonzero(marked)
    for p in (need + 8, need + 16):
        marked[p[p < len(marked)]] = True
    named = np.flatnonzero(marked)
    names = np.zeros(len(marked), np.int64)
    names[named] = _ranks(letters[named])
    triples = _triple_names(names, need, 8)
    names[:] = 0
    names[need] = triples
    for s in steps:
        names[need] = _triple_names(names, need, s)
    return names


def suffix_order(text: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """Order of the suffixes at the sorted positions ``at`` by at least their first ``depth`` bytes (difference cover modulo 3)."""
    text = np.concatenate([text, np.zeros(depth + 32, np.uint8)])
    third, mine = at[at % 3 == 0], at[at % 3 != 0]
    sample = np.zeros(len(text) - 7, bool)
    for p in (third + 1, third + 2, mine, mine + mine % 3):
        sample[p] = True
    rank = sampled_names(_letters(text), sample, depth)
    mine = mine[np.argsort(rank[mine])]
    wide = len(rank).bit_length() + 1
    one = lambda p: text[p].astype(np.int64) << wide | rank[p + 1]
    two = lambda p: (text[p].astype(np.int64) << 8 | text[p + 1]) << wide | rank[p + 2]
    third = third[np.argsort(one(third))]
    # merge: a third suffix meets those at 1 mod 3 one letter on, those at 2 mod 3 two letters on
    ones, twos = mine % 3 == 1, mine % 3 == 2
    before = np.zeros(len(mine), np.int64)
    before[ones] = np.searchsorted(one(third), one(mine[ones]))
    before[twos] = np.searchsorted(two(third), two(mine[twos]))
    before = np.maximum.accumulate(before)  # equal names may stand in any order
    out = np.empty(len(at), np.int64)
    out[np.arange(len(mine)) + before] = mine
    out[np.arange(len(third)) + np.searchsorted(before, np.arange(len(third)), side="right")] = third
    return out


def difference_cover_groups(k: int):
    """Groups of equal windows in suffix order, split where neighbours differ in their first k bytes (k of 8 or more)."""

    def group(tokens: np.ndarray, at: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order, letters = suffix_order(tokens, at, k), _letters(tokens)
        new = np.zeros(len(order), bool)
        new[0] = True
        for j in {*range(0, k - 7, 8), k - 8}:
            here = letters[order + j]
            new[1:] |= here[1:] != here[:-1]
        place = np.empty(len(tokens), np.int64)
        place[at] = np.arange(len(at))
        return place[order], new

    return group


def split_bytes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, None]:
    data = [t.encode() for t in texts]
    codes = np.frombuffer(b"".join(data), np.uint8)
    return codes, byte_values()[codes], np.array([len(d) for d in data], np.int64), None


def byte_space(length: int, minimiser: int) -> Space:
    return Space(length, minimiser, True, split_bytes, difference_cover_groups(length), 2_000_000)


def suffix_dedup(docs: DataFrame, length: int = 50, minimiser: int = 12, keep_bytes: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept, if asked for) of every row of docs.

    A byte is removed if a string of ``length`` bytes covers it that also starts in a row of smaller doc_id.
    Null text is empty. A null doc_id is the smallest; rows of one doc_id do not count against each other,
    repeated ones included. Long texts are processed whole, an empty table gives an empty result. Only doc_id
    and text are read.
    """
    rows, space = keyed(docs, ids_repeat(docs)), byte_space(length, minimiser)
    blocks = packed_blocks(rows.select("key", "row_hash", "text"), space, bucket_count(docs, BUCKET_BYTES))

    @lean
    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, removed, runs, sha, kept = [], [], [], [], []
            for text, (starts, counts) in zip(batch.column(1), spans_of(batch.column(2))):
                data = text.as_py().encode()
                total.append(len(data))
                if len(starts):
                    gone = covered(len(data), starts, counts, length)
                    removed.append(int(gone.sum()))
                    runs.append(int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()))
                    data = np.frombuffer(data, np.uint8)[~gone].tobytes()
                else:
                    removed.append(0)
                    runs.append(0)
                sha.append(hashlib.sha256(data).hexdigest())
                kept.append(data)
            out = [batch.column(0), *(pa.array(x, pa.int64()) for x in (total, removed, runs)), pa.array(sha, pa.string())]
            yield pa.RecordBatch.from_arrays(out + [pa.array(kept, pa.binary())] * keep_bytes, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * keep_bytes)

    found = with_spans(rows, settled_spans(blocks, space))
    return found.mapInArrow(remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_bytes)
