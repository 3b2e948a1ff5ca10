"""Token counts at every prefix, and BPE encoding and decoding, of whole texts."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Vocabulary, chunks, in_groups, vocabulary
from .common import bounded_batches, lean


KIB = 1024


def _raw(docs: DataFrame, tokenizer_path: str):
    """The tokenizer file, read on the driver and broadcast: its size is that of a vocabulary."""
    bounded_batches(docs.sparkSession)
    with open(tokenizer_path, encoding="utf-8") as f:
        return docs.sparkSession.sparkContext.broadcast(f.read())


def text_prefix_counts(v: Vocabulary, text: str) -> np.ndarray:
    """Token count of every prefix of the text in UTF-8 bytes, from the empty one to the whole.

    At every character boundary it is the count of the prefix as a text of its own.
    """
    if not text:
        return np.zeros(1, np.int64)
    first, *later = chunks(text)
    v.words.trim()
    v.later.trim()
    known = v.later
    found = [v.prefix_counts(first)]
    for c in later:
        got = known.get(c)
        if got is None:
            got = v.prefix_counts(" " + c)
            known.keep(c, got)
        found.append(got)
    local = np.frombuffer(b"".join([f[0] for f in found]), np.int32)
    totals = np.array([f[1] for f in found], np.int64)
    lengths = np.array([len(f[0]) >> 2 for f in found], np.int64)
    return np.concatenate(([0], local + np.repeat(np.cumsum(totals) - totals, lengths)))


def prefix_token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 512, keep_counts: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, bytes_within_limit, tokens_by_kib and, if asked for, prefix_counts (array<int>).

    ``prefix_counts[i]`` is the exact token count of the first i bytes, encoded as a text of their own, wherever they end
    with a whole character, so truncation and budget questions need no further encoding; ``bytes_within_limit`` is
    the longest prefix of whole characters with at most ``limit`` tokens, and ``tokens_by_kib`` holds the counts of the first
    1,024, 2,048, ... bytes, each cut back to a whole character.
    Null and empty text: 0 tokens. Long texts are processed whole, repeated rows each on their own; an
    empty table gives an empty result. Special strings in a text count as the library's default has it,
    as one token. Only doc_id and text are read.
    """
    raw = _raw(docs, tokenizer_path)
    schema = "doc_id long, n_bytes long, n_tokens long, over_limit boolean, bytes_within_limit long, tokens_by_kib array<int>" + ", prefix_counts array<int>" * keep_counts

    @lean
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(raw.value, "counts")
        for batch in batches:
            ids, texts, rows, kept = batch.column(0), batch.column(1), [], []
            for t in texts:
                text = t.as_py() or ""
                c = text_prefix_counts(v, text)
                ends = np.arange(len(c)) if len(c) == len(text) + 1 else np.flatnonzero(np.append((np.frombuffer(text.encode(), np.uint8) & 0xC0) != 0x80, True))
                within = c[ends] <= limit
                marks = ends[np.searchsorted(ends, np.arange(KIB, len(c), KIB), "right") - 1]
                rows.append((len(c) - 1, int(c[-1]), bool(c[-1] > limit), int(ends[len(ends) - 1 - np.argmax(within[::-1])]), c[marks].astype(np.int32)))
                if keep_counts:
                    kept.append(c.astype(np.int32))
            columns = list(zip(*rows)) or [[]] * 5
            out = [ids, pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.bool_()), pa.array(columns[3], pa.int64()), pa.array(columns[4], pa.list_(pa.int32()))]
            names = ["doc_id", "n_bytes", "n_tokens", "over_limit", "bytes_within_limit", "tokens_by_kib"]
            yield pa.RecordBatch.from_arrays(out + [pa.array(kept, pa.list_(pa.int32()))] * keep_counts, names + ["prefix_counts"] * keep_counts)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(count, schema)


def bpe_encode(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id and ids (array<int>): the encoding of each whole text, each new word by a depth-first search over the vocabulary's trie.

    Null and empty text: no ids. Repeated rows are encoded each; an empty table gives an empty result.
    """
    raw = _raw(docs, tokenizer_path)

    @lean
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(raw.value, "ids")
        for batch in batches:
            texts = batch.column(1)
            for s in in_groups(_lengths(texts)):
                ids = [pa.array(x, pa.int32()) for x in v.encode_all([t.as_py() or "" for t in texts[s]])]
                offsets = np.concatenate(([0], np.cumsum([len(x) for x in ids])))
                yield pa.RecordBatch.from_arrays([batch.column(0)[s], pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.concat_arrays(ids))], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(encode, "doc_id long, ids array<int>")


class _Sized:
    """A length, for in_groups."""

    def __init__(self, n: int):
        self.n = n

    def __len__(self) -> int:
        return self.n


def _lengths(texts: pa.Array) -> list[_Sized]:
    import pyarrow.compute as pc

    return [_Sized(n) for n in pc.fill_null(pc.binary_length(texts), 0).to_pylist()]


def decode_ids(v: Vocabulary, ids: list[int]) -> str:
    """The text of ids, special ones included; bytes that are no UTF-8 become U+FFFD."""
    return b"".join(map(v.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


def bpe_round_trip(docs: DataFrame, tokenizer_path: str, keep_text: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 (and decoded, if asked for) of each text, encoded and decoded again.

    Edge cases as in ``bpe_encode``; null text decodes to the empty string.
    """
    raw = _raw(docs, tokenizer_path)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(raw.value, "ids")
        names = {i: str(i) for i in v.bytes_of}
        for batch in batches:
            texts = batch.column(1)
            for s in in_groups(_lengths(texts)):
                n, ids_sha, text_sha, decoded = [], [], [], []
                for ids in v.encode_all([t.as_py() or "" for t in texts[s]]):
                    text = decode_ids(v, ids)
                    n.append(len(ids))
                    ids_sha.append(hashlib.sha256(",".join(map(names.__getitem__, ids)).encode()).hexdigest())
                    text_sha.append(hashlib.sha256(text.encode()).hexdigest())
                    if keep_text:
                        decoded.append(text)
                yield pa.RecordBatch.from_arrays([batch.column(0)[s], pa.array(n, pa.int64()), pa.array(ids_sha), pa.array(text_sha)] + [pa.array(decoded, pa.string())] * keep_text, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["decoded"] * keep_text)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", decoded string" * keep_text)
