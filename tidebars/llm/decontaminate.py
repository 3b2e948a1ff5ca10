"""Benchmark decontamination by latent semantic retrieval, with subsequence and answer checks.

Passages are windows of 32 words, 16 apart. Words of the benchmark are the features, weighted by their inverse
document frequency over all documents. A randomised SVD of the TF-IDF passage matrix (benchmark items and all
passages of all documents), computed by distributed products with the matrix, gives the latent
space of ``RANK`` dimensions, however many items there are. Every passage of every document is searched: those whose cosine with an item, or with a passage of a long
item, reaches the threshold become candidates, and a candidate counts if the longest common subsequence of words
covers most of the item and, unless nearly all of it, also most of the item's answer, its last sentence.

The cosine is taken in the latent space, so words outside the benchmark are left out of a passage's norm: their
weight would grow with the corpus, while that of the items does not. Passages that share ``GRAM`` consecutive words with an item (all words of a shorter
one) are candidates whatever their cosine. An item of which at most one word in ten is changed or left out
always shares so many, so verbatim items are found at every size of the corpus.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, pairwise, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import in_groups
from .common import bounded_batches, lean
from .superkmers import mix, window_hash

BLOCK, COSINE, RANK, EXTRA, ROUNDS, ITEM_WEIGHT = 16, 0.6, 256, 8, 2, 4.0
#: Blocks and items that are worked on at a time, which bounds the memory of a task and changes no result.
STEP, ITEMS_AT_ONCE = 512, 1024
#: Tasks for each core that sum the passages up for the SVD, however many parts the documents have, and bands that A'A is cut into.
TASKS_A_CORE, BANDS = 4, 8
#: Words of the benchmark up to which a task holds A'A (144 MB), and passages that all those of the documents weigh as much as.
PAIR_WORDS, CORPUS_WEIGHT = 6_000, 20_000
VERBATIM, PARAPHRASE, ANSWER, SHORT = 0.9, 0.6, 0.6, 8
#: Words in a row that make a candidate by themselves; items of more than PASSAGE words are searched for by passages.
GRAM, PASSAGE = 5, 4 * BLOCK
#: Bytes of items that are broadcast at once; more are searched in turns, in one and the same space.
ITEM_BYTES = 64_000_000
_TABLE = bytes(c if chr(c).isalnum() or c > 127 else 32 for c in range(256))


def words_of(text: str) -> list[bytes]:
    """Lower-case words; ASCII punctuation separates them."""
    return text.lower().encode().translate(_TABLE).split()


def coded(texts: list[str], vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Places in the vocabulary of the words of all texts, as ``words_of`` cuts them (its length: not there), and how many words each text has."""
    parts = [t.lower().encode() for t in texts]
    letters = np.frombuffer(b" ".join([*parts, b""]).translate(_TABLE), np.uint8)
    inside = letters != 32
    # each text ends with a separator, so begins and ends of words alternate
    edges = np.flatnonzero(np.diff(inside, prepend=False))
    begins, offsets = edges[::2], np.zeros(len(edges) // 2 + 1, np.int64)
    np.cumsum(edges[1::2] - begins, out=offsets[1:])
    words = pa.Array.from_buffers(pa.large_binary(), len(begins), [None, pa.py_buffer(offsets), pa.py_buffer(letters[inside])])
    codes = pc.index_in(words, value_set=vocabulary).fill_null(len(vocabulary)).to_numpy()
    ends = np.cumsum([len(p) + 1 for p in parts])
    return codes, np.diff(np.searchsorted(begins, ends), prepend=0)


def common_length(masks: dict, n: int, words: list) -> int:
    """Length of the longest common subsequence with an item of n words, given the bit mask of each of its words."""
    full = state = (1 << n) - 1
    for w in words:
        m = masks.get(w)
        if m:
            u = state & m
            state = (state + u | state - u) & full
    return n - state.bit_count()


def passages_of(words: list[bytes]) -> list[list[bytes]]:
    """The item itself, or, of more than ``PASSAGE`` words, its passages, each half over the one before."""
    return [words[i : i + PASSAGE] for i in range(0, max(1, len(words) - PASSAGE // 2), PASSAGE // 2)]


def masks_of(words: list) -> dict:
    out: dict = {}
    for i, w in enumerate(words):
        out[w] = out.get(w, 0) | 1 << i
    return out


@dataclass
class Index:
    """Items with their words, word weights, and the latent space."""

    ids: list[int]
    items: list[list[bytes]]
    answers: list[list[bytes]]
    code: dict[bytes, int]
    idf: np.ndarray
    basis: np.ndarray

    def __post_init__(self) -> None:
        self.vocabulary = pa.array(list(self.code), pa.large_binary())
        # the last row stands for words outside the benchmark
        self.vectors = np.concatenate([self.idf[:, None] * self.basis, np.zeros((1, self.basis.shape[1]))]).astype(np.float32)
        passages = [passages_of(i) for i in self.items]
        self.item_of = np.repeat(np.arange(len(self.items)), [len(p) for p in passages])
        q = np.array([self.vectors[[self.code[w] for w in p]].sum(0) for p in chain.from_iterable(passages)], np.float32)
        self.queries = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-9)
        # by length of the gram: sorted hashes, and the item of each
        self.grams: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for size in {min(GRAM, len(i)) for i in self.items}:
            own = [(i, np.unique(self.gram_hashes(np.array([self.code[w] for w in x]), size))) for i, x in enumerate(self.items) if min(GRAM, len(x)) == size]
            hashes, items = np.concatenate([h for _, h in own]), np.repeat([i for i, _ in own], [len(h) for _, h in own])
            order = np.argsort(hashes, kind="stable")
            self.grams[size] = hashes[order], items[order]
        self.known: dict[int, tuple[list[int], dict[int, int], dict[int, int], Counter]] = {}

    def compared(self, i: int) -> tuple[list[int], dict[int, int], dict[int, int], Counter]:
        """Codes of the words of item i, bit masks of them and of those of its answer, and their counts; remembered for items met."""
        if i not in self.known:
            if len(self.known) > 4096:
                self.known.clear()
            item, answer = ([self.code[w] for w in x] for x in (self.items[i], self.answers[i]))
            self.known[i] = item, masks_of(item), masks_of(answer), Counter(item)
        return self.known[i]

    @staticmethod
    def gram_hashes(codes: np.ndarray, size: int) -> np.ndarray:
        """Hash of each ``size`` consecutive words."""
        return mix(window_hash(mix((codes + 1).astype(np.uint64)), size))

    def shared_grams(self, codes: np.ndarray, left: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(positions, items) of the grams that stand in the text; ``left``: words of the document from each position on."""
        for size, (hashes, items) in self.grams.items():
            if len(codes) < size:
                continue
            found = self.gram_hashes(codes, size)  # words outside the benchmark have a code of their own, which no item holds
            slots = np.zeros(1 << 20, bool)
            slots[hashes >> np.uint64(44)] = True
            at = np.flatnonzero(slots[found >> np.uint64(44)] & (left[: len(found)] >= size))
            first, end = np.searchsorted(hashes, found[at]), np.searchsorted(hashes, found[at], "right")
            times = end - first
            yield np.repeat(at, times), items[np.repeat(first - (np.cumsum(times) - times), times) + np.arange(int(times.sum()))]

    def block_sums(self, words: np.ndarray, filled: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sums of the vectors of each block's words, blocks of many words first, and the row of each block there; ``room``: two arrays to work in."""
        order = np.argsort(-filled, kind="stable")
        words, sums = words[order], room[0, : len(words)]
        np.take(self.vectors, words[:, 0], axis=0, out=sums, mode="clip")
        for j, n in enumerate(len(filled) - np.searchsorted(np.sort(filled), np.arange(1, filled.max()), "right"), 1):
            sums[:n] += np.take(self.vectors, words[:n, j], axis=0, out=room[1, :n], mode="clip")
        row = np.empty_like(order)
        row[order] = np.arange(len(order))
        return sums, row

    def candidates(self, codes: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[int, int, int, float]]:
        """(document, first block, item, cosine) of all passages that reach the threshold or share a gram; the same ones may come twice."""
        n, none = len(codes), len(self.code)
        blocks = -(-lengths // BLOCK)
        base = np.cumsum(blocks) - blocks
        place = np.arange(n) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        block = np.repeat(base, lengths) + place // BLOCK
        total, owner = int(blocks.sum()), np.repeat(np.arange(len(lengths)), blocks)
        # words outside the benchmark have no weight, so a block's row holds the others, one after another
        some = np.flatnonzero(codes != none)
        filled = np.bincount(block[some], minlength=total + 1)
        words = np.full((total + 1, BLOCK), none, np.int32)
        words[block[some], np.arange(len(some)) - np.repeat(np.cumsum(filled) - filled, filled)] = codes[some]
        room = np.empty((2, min(total, STEP) + 1, self.vectors.shape[1]), np.float32)
        products = np.empty(min(total, STEP) * min(len(self.queries), ITEMS_AT_ONCE), np.float32)
        after = np.append(owner[1:] == owner[:-1], False)
        # a last block alone lies in the passage before it
        last = np.append(owner[:-1] == owner[1:], False)
        alone = ~last & np.append(False, owner[1:] == owner[:-1])
        found = [np.column_stack([block[at] - alone[block[at]], item]) for at, item in self.shared_grams(codes, np.repeat(lengths, lengths) - place)]
        shared = np.unique(np.concatenate([np.zeros((0, 2), np.int64), *found]), axis=0)
        for begin in range(0, total, STEP):
            end = min(total, begin + STEP)
            mine = filled[begin : end + 1]
            live = np.flatnonzero((mine[:-1] > 0) & ~alone[begin:end] | (mine[1:] > 0) & after[begin:end])
            if not len(live):
                continue
            sums, row = self.block_sums(words[begin : end + 1], mine, room)
            z, follows = sums[row[live]], np.flatnonzero(after[begin + live])
            z[follows] += sums[row[live[follows] + 1]]
            norms = np.maximum(np.sqrt(np.einsum("ij,ij->i", z, z)), 1e-9)
            for first in range(0, len(self.queries), ITEMS_AT_ONCE):
                queries = self.queries[first : first + ITEMS_AT_ONCE]
                product = np.matmul(z, queries.T, out=products[: len(z) * len(queries)].reshape(len(z), -1))
                for at in np.flatnonzero(product >= COSINE * norms[:, None]).tolist():
                    p, i = divmod(at, len(queries))
                    d = int(owner[begin + live[p]])
                    yield d, int(begin + live[p] - base[d]), int(self.item_of[first + i]), float(product[p, i] / norms[p])
            here = shared[slice(*np.searchsorted(shared[:, 0], [begin, end]))]
            for p, (b, i) in zip(np.searchsorted(live, here[:, 0] - begin).tolist(), here.tolist()):
                d = int(owner[b])
                yield d, int(b - base[d]), i, float((self.queries[self.item_of == i] @ z[p]).max() / norms[p])

    def hits(self, texts: list[str]) -> Iterator[tuple[int, int, float, float, float]]:
        """(text, item, cosine, share of the item, share of the answer) of contaminated texts, the best place of each item."""
        codes, lengths = coded(texts, self.vocabulary)
        ends = np.cumsum(lengths)
        places: dict[tuple[int, int], list[tuple[int, float]]] = {}
        for d, b, i, c in self.candidates(codes, lengths):
            places.setdefault((d, i), []).append((b, c))
        for (d, i), found in places.items():
            n, best, doc = len(self.items[i]), (0.0, 0.0), codes[ends[d] - lengths[d] : ends[d]]
            item, masks, answer_masks, counts = self.compared(i)
            regions: list[list[int]] = []
            for b, _ in sorted(found):
                begin, end = max(0, b * BLOCK - n), (b + 2) * BLOCK + n
                if regions and begin <= regions[-1][1]:
                    regions[-1][1] = end
                else:
                    regions.append([begin, end])
            for begin, end in regions:
                words = doc[begin:end].tolist()
                # no subsequence is longer than the number of the item's words that are there
                if sum(map(counts.__getitem__, counts.keys() & set(words))) < PARAPHRASE * n:
                    continue
                for at in range(0, max(1, len(words) - n), max(1, n // 2)):
                    part = words[at : at + 2 * n]
                    if n < SHORT:
                        share = float(any(part[k : k + n] == item for k in range(len(part) - n + 1)))
                    else:
                        share = common_length(masks, n, part) / n
                    if share > best[0]:
                        answer = common_length(answer_masks, len(self.answers[i]), part) / max(1, len(self.answers[i]))
                        best = (share, answer)
            if best[0] >= VERBATIM or best[0] >= PARAPHRASE and best[1] >= ANSWER:
                yield d, i, max(c for _, c in found), *best


def answer_of(text: str) -> list[bytes]:
    """The words of the last sentence; of the last third where there is only one."""
    sentences = [w for s in re.split(r"[.!?]+\s", text.strip()) if (w := words_of(s))]
    if len(sentences) > 1:
        return sentences[-1]
    return sentences[0][-max(1, len(sentences[0]) // 3) :] if sentences else []


def _frequencies(docs: DataFrame, code: dict[bytes, int]) -> tuple[np.ndarray, int]:
    """In how many of all documents each word stands, and the number of documents. Partial sums are one row for each task and word."""
    shared, size = docs.sparkSession.sparkContext.broadcast(pa.array(list(code), pa.large_binary())), len(code)

    @lean
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, rows = shared.value, 0
        sums = np.zeros(size, np.int64)
        for batch in batches:
            texts = [t or "" for t in batch.column(0).to_pylist()]
            for s in in_groups(texts):
                codes, lengths = coded(texts[s], vocabulary)
                # each word once for a document
                pairs = np.sort((np.repeat(np.arange(len(lengths)) * size, lengths) + codes)[codes < size])
                sums += np.bincount(pairs[np.diff(pairs, prepend=-1) > 0] % size, minlength=size)
            rows += batch.num_rows
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1), pa.int64()), pa.array(np.append(sums[some], rows), pa.int64())], ["word", "n"])

    got = docs.select("text").mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(len(code) + 1, np.int64)
    df[got["word"].to_numpy()] = got["n"].to_numpy()
    return df[:-1], int(df[-1])


def add_pairs(sums: np.ndarray, codes: np.ndarray, lengths: np.ndarray, squares: np.ndarray) -> None:
    """Add, for all passages of some texts, each two words of a passage to ``sums``, row after row of a lower triangle, over the passage's squared norm.

    ``squares``: squared weights of the words, the last of those outside the benchmark. Half of a word's product with itself is added, so
    that the sums and their transpose make A'A up, but for the weights of the words.
    """
    blocks = -(-lengths // BLOCK)
    owner = np.repeat(np.arange(len(lengths)), blocks)
    if not len(owner):
        return
    place = np.arange(len(codes)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    block = np.repeat(np.cumsum(blocks) - blocks, lengths) + place // BLOCK
    after = np.append(owner[1:] == owner[:-1], False)
    # a last block alone lies in the passage before it
    alone = ~after & np.append(False, owner[1:] == owner[:-1])
    norms = np.bincount(block, squares[codes], len(owner))
    norms[:-1] += norms[1:] * after[:-1]
    across = np.where(alone, 0.0, 1 / norms)
    within = across.copy()
    within[1:] += across[:-1] * after[:-1]
    known = np.flatnonzero(codes < len(squares) - 1)
    c, b = codes[known].astype(np.int64), block[known]
    np.add.at(sums, c * (c + 3) // 2, within[b] / 2)
    at = np.arange(len(c))
    for step in range(1, 2 * BLOCK):
        at = at[: np.searchsorted(at, len(c) - step)]
        apart = b[at + step] - b[at]
        near = (apart == 0) | (apart == 1) & after[b[at]]
        at, apart = at[near], apart[near]
        x, y = c[at], c[at + step]
        high = np.maximum(x, y)
        np.add.at(sums, high * (high + 1) // 2 + np.minimum(x, y), np.where(apart == 0, within[b[at]], across[b[at]]))


def _pair_sums(docs: DataFrame, code: dict[bytes, int], squares: np.ndarray, bounds: np.ndarray) -> DataFrame:
    """(band, cells): what ``add_pairs`` gives for all documents, in bands of rows of the triangle, which begin at ``bounds``.

    The documents are read once. Each of a fixed number of tasks sends its sums on, so these do not grow with the documents.
    """
    context, ends = docs.sparkSession.sparkContext, (bounds * (bounds + 1) // 2).tolist()
    shared = context.broadcast((pa.array(list(code), pa.large_binary()), squares))

    @lean
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, squares = shared.value
        sums = np.zeros(ends[-1])
        for batch in batches:
            texts = [t or "" for t in batch.column(0).to_pylist()]
            for s in in_groups(texts):
                add_pairs(sums, *coded(texts[s], vocabulary), squares)
        for band, (begin, end) in enumerate(pairwise(ends)):
            part = sums[begin:end].astype(np.float32)
            at = np.flatnonzero(part)
            if len(at):
                yield pa.RecordBatch.from_pydict({"band": pa.array([band], pa.int32()), "places": [at.astype(np.uint32).tobytes()], "cells": [part[at].tobytes()]})

    @lean
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole: dict[int, np.ndarray] = {}
        for batch in batches:
            for band, places, cells in zip(*(c.to_pylist() for c in batch.columns)):
                if band not in whole:
                    whole[band] = np.zeros(ends[band + 1] - ends[band])
                whole[band][np.frombuffer(places, np.uint32)] += np.frombuffer(cells, np.float32)
        for band, cells in whole.items():
            yield pa.RecordBatch.from_pydict({"band": pa.array([band], pa.int32()), "cells": [cells.astype(np.float32).tobytes()]})

    parts = docs.select("text").coalesce(TASKS_A_CORE * context.defaultParallelism).mapInArrow(count, "band int, places binary, cells binary")
    return parts.repartition(len(bounds) - 1, "band").mapInArrow(add, "band int, cells binary")


def _latent_basis(docs: DataFrame, items: list[list[bytes]], code: dict[bytes, int], idf: np.ndarray, weight: float, n_docs: int) -> np.ndarray:
    """Leading right singular vectors of the TF-IDF passages, those of all documents and of all items: randomised range finder with power rounds.

    A'A is words x words: it is summed up over all passages in one pass, lies distributed in bands, and a round sends a words x rank
    matrix out and sums A'(A Q) up. A vocabulary of more than ``PAIR_WORDS`` is too large for A'A in a task; then each round reads
    all passages and sums A'(A Q) up by itself. Rows have unit length, words unknown to the benchmark included. Passages of items
    count ``ITEM_WEIGHT`` times, and all those of the documents, however many, as much as ``weight`` passages (taken as 16 apart a
    document), else the items would weigh the less the more documents there are.
    """
    parts_of_items = [p for i in items for p in passages_of(i)]
    d, kept, context = len(code), min(len(code), RANK), docs.sparkSession.sparkContext
    rank, unknown = min(d, kept + EXTRA), idf.max() ** 2
    # each word stands in two passages
    scale, by_pairs = min(1.0, weight / 16 / max(1, n_docs)) / 2, d <= PAIR_WORDS
    bounds = np.round(d * np.sqrt(np.arange(BANDS + 1) / BANDS)).astype(np.int64)
    rows = _pair_sums(docs, code, np.append(idf**2, unknown), bounds).cache() if by_pairs else docs.select("text").coalesce(TASKS_A_CORE * context.defaultParallelism)
    shared = context.broadcast(None if by_pairs else code)

    def product(rows: list[np.ndarray], q: np.ndarray, weight: float = 1.0) -> np.ndarray:
        out = np.zeros_like(q)
        for r in rows:
            words, times = np.unique(r[r >= 0], return_counts=True)
            a = times * idf[words]
            a *= weight / np.sqrt((idf[r[r >= 0]] ** 2).sum() + unknown * (r < 0).sum())
            out[words] += np.outer(a, a @ q[words])
        return out

    def gram(q: np.ndarray) -> np.ndarray:
        sent, shape = context.broadcast(q.astype(np.float32)), q.shape

        @lean
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            code, q = shared.value, sent.value
            out = np.zeros_like(q)
            for b in batches:
                for text in b["text"]:
                    codes = np.fromiter(map(code.get, words_of(text or ""), repeat(-1)), np.int64)
                    passages = [codes[i : i + 2 * BLOCK] for i in range(0, max(1, len(codes) - BLOCK), BLOCK)]
                    out += product([c for c in passages if (c >= 0).any()], q)
            if out.any():
                yield pd.DataFrame({"part": [0], "sums": [out.tobytes()]})

        @lean
        def multiply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            q = sent.value * idf[:, None].astype(np.float32)
            out = np.zeros_like(q)
            for b in batches:
                for band, cells in zip(b["band"], b["cells"]):
                    low, high = bounds[band : band + 2].tolist()
                    part, cells = np.zeros((high - low, d), np.float32), np.frombuffer(cells, np.float32)
                    for r in range(low, high):
                        begin = (r * (r + 1) - low * (low + 1)) // 2
                        part[r - low, : r + 1] = cells[begin : begin + r + 1]
                    out[low:high] += part @ q
                    out += part.T @ q[low:high]
            if out.any():
                out *= idf[:, None].astype(np.float32)
                yield pd.DataFrame({"part": [0], "sums": [out.tobytes()]})

        @lean
        def add(frame: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"part": [0], "sums": [sum(np.frombuffer(s, np.float32) for s in frame["sums"]).tobytes()]})

        # summed up before, so that one matrix comes to the driver
        whole = rows.mapInPandas(multiply if by_pairs else run, "part int, sums binary").groupBy("part").applyInPandas(add, "part int, sums binary")
        total = product([np.array([code[w] for w in p]) for p in parts_of_items], q, ITEM_WEIGHT)
        for row in whole.collect():
            total += scale * np.frombuffer(row["sums"], np.float32).reshape(shape)
        sent.destroy()
        return total

    q = np.linalg.qr(gram(np.random.default_rng(0).standard_normal((d, rank))))[0]
    for _ in range(ROUNDS - 1):
        q = np.linalg.qr(gram(q))[0]
    values, turn = np.linalg.eigh(q.T @ gram(q))
    rows.unpersist()
    return q @ turn[:, np.argsort(-values)[:kept]]


def build_indexes(docs: DataFrame, benchmark: DataFrame, weight: float = CORPUS_WEIGHT) -> Iterator[Index]:
    """The index of all benchmark items (null or wordless ones are left out), in parts of ``ITEM_BYTES`` of items.

    Vocabulary, weights and latent space are those of the whole benchmark: parts bound what is broadcast and change no result.
    """
    bounded_batches(docs.sparkSession)
    rows = benchmark.where(F.col("text").isNotNull()).select("item_id", "text").orderBy("item_id", "text").collect()
    rows = [(r["item_id"], w, answer_of(r["text"])) for r in rows if (w := words_of(r["text"]))]
    if not rows:
        return
    code = {w: i for i, w in enumerate(sorted({w for r in rows for w in r[1]}))}
    df, n_docs = _frequencies(docs, code)
    idf = np.log(1 + (n_docs + 1) / (df + 1))
    basis = _latent_basis(docs, [r[1] for r in rows], code, idf, weight, n_docs)
    turns = -(-sum(len(w) for r in rows for w in r[1]) // ITEM_BYTES)
    for turn in range(turns):
        yield Index(*map(list, zip(*rows[turn::turns])), code, idf, basis)


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, cosine, item_share, answer_share: each document that holds an item, the best place of each.

    Null or empty texts and items give no rows; rows that repeat a doc_id give one row for an item. Long texts
    are searched whole, and ties of place go to the first. Without documents or items the result is empty.
    Only doc_id, item_id and text are read.
    """
    schema, out = "doc_id long, item_id long, cosine double, item_share double, answer_share double", None
    for index in build_indexes(docs, benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        @lean
        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                ids, texts = batch.column(0), [t or "" for t in batch.column(1).to_pylist()]
                rows = [(ids[s.start + d].as_py(), index.ids[i], *x) for s in in_groups(texts) for d, i, *x in index.hits(texts[s])]
                columns = list(zip(*rows)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 2 + [pa.float64()] * 3)], ["doc_id", "item_id", "cosine", "item_share", "answer_share"])

        found = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(search, schema)
        out = found if out is None else out.unionByName(found)
    if out is None:
        return docs.sparkSession.createDataFrame([], schema)
    best = F.max(F.struct("item_share", "answer_share", "cosine")).alias("b")
    return out.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "b.cosine", "b.item_share", "b.answer_share")


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, all columns kept, that hold no benchmark item: filtered in place, without a shuffle."""
    out, names = docs, docs.columns
    for index in build_indexes(docs, benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        @lean
        def keep(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index, at = shared.value, names.index("text")
            for batch in batches:
                texts = [t or "" for t in batch.column(at).to_pylist()]
                clean = np.ones(len(texts), bool)
                for s in in_groups(texts):
                    for d, *_ in index.hits(texts[s]):
                        clean[s.start + d] = False
                yield batch.filter(pa.array(clean))

        out = out.mapInArrow(keep, out.schema)
    return out
