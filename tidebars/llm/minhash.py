"""Near-duplicate detection by min-max hashing.

A set's signature keeps the least and the greatest value under each permutation, so half the hash evaluations
give as many values as plain MinHash; the two of a permutation are negatively correlated, which lowers the
variance. ``rows`` values make a band; bands are made of least values or of greatest ones, and sets that agree on
a band are compared exactly. The number of bands follows from the threshold and from ``LOSS``, the chance that a
pair just at the threshold agrees on none.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame

from .jaccard import LOSS, jaccard_rows, one_of_each_component
from .superkmers import mix

_U = np.uint64
ROWS, PIECE = 6, 512


def min_max(elements: np.ndarray, factors: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest value of a set of well-mixed 64-bit elements under each of the permutations x -> factor * x + term."""
    least, most = np.full(len(factors), ~_U(0)), np.zeros(len(factors), _U)
    with np.errstate(over="ignore"):
        for i in range(0, len(elements), PIECE):
            h = factors[:, None] * elements[None, i : i + PIECE]
            h += terms[:, None]
            np.minimum(least, h.min(1), out=least)
            np.maximum(most, h.max(1), out=most)
    return least, most


def band_signer(percent: int, rows: int = ROWS) -> Callable[[np.ndarray], np.ndarray]:
    """A function from a set to its band signatures; two sets of that similarity share none with a chance of ``LOSS``."""
    bands = math.ceil(math.log(LOSS) / math.log1p(-((percent / 100) ** rows)))
    half = -(-bands // 2)
    seeds = mix(np.arange(1, 2 * half * rows + 2 * half + 1, dtype=_U))
    factors, terms, labels = seeds[: half * rows] | _U(1), seeds[half * rows : 2 * half * rows], seeds[2 * half * rows :]

    def sign(elements: np.ndarray) -> np.ndarray:
        values = np.concatenate(min_max(elements, factors, terms)).reshape(2 * half, rows)
        with np.errstate(over="ignore"):
            held = mix((mix(values.ravel()).reshape(values.shape) * (np.arange(rows, dtype=_U) * _U(2) + _U(1))).sum(1) + labels)
        return held

    return sign


def minhash_rows(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, identity, n_shingles, component_id, n_links, kept of every row of docs, as ``jaccard_rows`` says, by min-max bands."""
    return jaccard_rows(docs, n, percent, band_signer(percent))


def minhash_dedup(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of docs.

    A row's set holds the distinct n-word shingles of its text (words: runs without x20 and x09-x0D, A-Z folded);
    shorter texts have one shingle, the whole sequence. Rows link when 100 * common >= percent * union, counted on the
    whole sets. component_id: the least doc_id reachable by links; kept: the row that stays of a component, that of least doc_id.
    Null or empty text has an empty set, links with nothing and is kept. Of rows that repeat doc_id and text all say
    kept. A null doc_id is component_id only where no other id is reachable. Long texts are processed whole, an empty
    table gives an empty result. Only doc_id and text are read.
    """
    return minhash_rows(docs, n, percent).select("doc_id", "n_shingles", "component_id", "kept")


def without_minhash_copies(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """Rows of docs, all columns: of each component one; rows without words all stay."""
    return one_of_each_component(docs, minhash_rows(docs, n, percent))
