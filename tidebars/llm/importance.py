"""Importance resampling towards a target distribution, on hashed n-grams of integer words.

Each block of texts has its distinct words numbered, its texts as sequences of those numbers, and its distinct
n-grams as tuples of them. Only the words of each block meet the dictionary of all distinct words, which gives
their ids; n-grams are tuples of ids from then on. Each distinct tuple of the whole corpus is spelled out and
hashed once, and its bucket joined back to counts and to blocks. So what is shuffled grows with distinct words
of blocks, not with words, and no word or tuple is in a shuffle more often than there are blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bpe import in_groups
from .common import bounded_batches, lean, shuffle_cleanup, stored

#: A block is closed at so many words (or n-grams) or characters; texts are taken in by groups of so many characters, or one longer text.
BLOCK_WORDS, BLOCK_CHARS, GROUP_CHARS = 250_000, 48_000_000, 2_000_000
_BLOCK = "block long, docs array<struct<doc_id:long, n_words:long, n_features:long>>, codes binary, words array<string>, tuples array<array<int>>, counts array<long>"
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 32
_KEEP = np.zeros(256, bool)
_KEEP[0x30:0x3A] = _KEEP[0x61:0x7B] = _KEEP[0x80:] = True


def words_of(texts: list[str]) -> tuple[pa.Array, np.ndarray]:
    """Words of all texts in order (letters a-z, digits and what is beyond ASCII, A-Z folded) and the number of each text's."""
    parts = [t.encode() for t in texts]
    data = _FOLD[np.frombuffer(b"\n".join(parts), np.uint8)]
    inside = _KEEP[data]
    edge = np.diff(np.concatenate(([False], inside, [False])).astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    offsets = np.concatenate(([0], np.cumsum(ends - starts))).astype(np.int32)
    begins = np.concatenate(([0], np.cumsum([len(p) + 1 for p in parts])))
    return pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[inside])]), np.diff(np.searchsorted(starts, begins))


def feature_codes(codes: np.ndarray, lengths: np.ndarray, most: int) -> tuple[list[list[int]], np.ndarray, np.ndarray, np.ndarray]:
    """Distinct runs of 1 to ``most`` consecutive codes of one text, their counts, the run numbers of all texts in order, how many each has."""
    tuples, counts, numbers, owners = [], [], [], []
    owner = np.repeat(np.arange(len(lengths)), lengths)
    for n in range(1, most + 1):
        runs = np.lib.stride_tricks.sliding_window_view(codes, n) if len(codes) >= n else np.zeros((0, n), codes.dtype)
        within = owner[: len(runs)] == owner[n - 1 :] if len(runs) else np.zeros(0, bool)
        found, at, count = np.unique(runs[within], axis=0, return_inverse=True, return_counts=True)
        numbers.append(at.ravel().astype(np.int32) + len(tuples))
        owners.append(owner[: len(runs)][within])
        tuples += found.tolist()
        counts.append(count)
    numbers, owners = np.concatenate(numbers), np.concatenate(owners)
    return tuples, np.concatenate(counts), numbers[np.argsort(owners, kind="stable")], np.bincount(owners, minlength=len(lengths))


class Block:
    """Texts of one task with a dictionary of their own: each new word and n-gram gets the next number."""

    def __init__(self, most: int):
        self.most, self.chars = most, 0
        self.words: dict[str, int] = {}
        self.tuples: dict[tuple[int, ...], int] = {}
        self.docs: list[pa.Array] = []
        self.numbers: list[np.ndarray] = []

    def add(self, ids: pa.Array, texts: list[str]) -> None:
        words, lengths = words_of(texts)
        coded = words.dictionary_encode()
        own = coded.dictionary.to_pylist()
        known = self.words
        codes = np.fromiter((known.setdefault(w, len(known)) for w in own), np.int32, len(own))[coded.indices.to_numpy(zero_copy_only=False)]
        features = lengths
        if self.most > 1:
            tuples, _, codes, features = feature_codes(codes, lengths, self.most)
            codes = np.fromiter((self.tuples.setdefault(tuple(t), len(self.tuples)) for t in tuples), np.int32, len(tuples))[codes]
        self.docs.append(pa.StructArray.from_arrays([ids, pa.array(lengths, pa.int64()), pa.array(features, pa.int64())], ["doc_id", "n_words", "n_features"]))
        self.numbers.append(codes)
        self.chars += sum(map(len, texts))

    def full(self) -> bool:
        return max(len(self.words), len(self.tuples)) >= BLOCK_WORDS or self.chars >= BLOCK_CHARS

    def row(self, at: int) -> pa.RecordBatch:
        """The block's only row. One word is its own 1-tuple."""
        one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
        numbers = np.concatenate(self.numbers).astype(np.int32)
        if self.most > 1:
            tuples = pa.array(map(list, self.tuples), pa.list_(pa.int32()))
        else:
            tuples = pa.ListArray.from_arrays(pa.array(np.arange(len(self.words) + 1), pa.int32()), pa.array(np.arange(len(self.words)), pa.int32()))
        counts = pa.array(np.bincount(numbers, minlength=len(tuples)), pa.int64())
        packed = zstandard.ZstdCompressor(1).compress(numbers.tobytes())
        columns = [pa.array([at], pa.int64()), one(pa.concat_arrays(self.docs)), pa.array([packed], pa.binary()), one(pa.array(self.words, pa.string())), one(tuples), one(counts)]
        return pa.RecordBatch.from_arrays(columns, ["block", "docs", "codes", "words", "tuples", "counts"])


def feature_blocks(texts: DataFrame, most: int, side: int) -> DataFrame:
    """Blocks of texts (doc_id, text): words and n-grams by number, and each text's n-grams as compressed 4-byte numbers."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, block = TaskContext.get().partitionId() << 32 | side << 62, Block(most)
        for batch in batches:
            ids, whole = batch.column(0), batch.column(1).to_pylist()
            for s in in_groups(whole, GROUP_CHARS):
                block.add(ids[s.start : s.stop], whole[s])
                if block.full():
                    yield block.row(at)
                    at, block = at + 1, Block(most)
        if block.docs:
            yield block.row(at)

    bounded_batches(texts.sparkSession)
    return texts.mapInArrow(run, _BLOCK)


def numbered_tuples(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The dictionary (id, word) of all distinct words, and (block, place, tuple, n), a row for each n-gram of a block as a tuple of ids."""
    words = blocks.select("block", F.posexplode("words").alias("place", "word"))
    dictionary = stored(words.select("word").distinct().select(F.monotonically_increasing_id().alias("id"), "word"), "importance-words")
    # a word is in a block's rows once; AQE splits the join where it is in very many blocks
    known = words.join(dictionary, "word").groupBy("block").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "id"))), lambda x: x["id"]).alias("ids"))
    named = F.transform("tuples", lambda t: F.transform(t, lambda w: F.get("ids", w)))
    tuples = blocks.select("block", "tuples", "counts").join(known, "block").select("block", F.posexplode(F.arrays_zip(named.alias("tuple"), F.col("counts").alias("n"))).alias("place", "x"))
    return dictionary, stored(tuples.select("block", "place", F.col("x.tuple").alias("tuple"), F.col("x.n").alias("n")), "importance-tuples")


def tuple_buckets(tuples: DataFrame, dictionary: DataFrame, most: int, buckets: int) -> DataFrame:
    """(tuple, bucket, s, t): every distinct tuple, spelled out and hashed once, with its counts in corpus and target."""
    target = F.shiftright("block", 62) == 1
    rows = tuples.groupBy("tuple").agg(F.sum(F.when(target, 0).otherwise(F.col("n"))).alias("s"), F.sum(F.when(target, F.col("n")).otherwise(0)).alias("t"))
    for i in range(most):  # the word at each place; a shorter tuple has none there
        word = dictionary.select(F.col("id").alias(f"id_{i}"), F.col("word").alias(f"word_{i}"))
        rows = rows.withColumn(f"id_{i}", F.get("tuple", F.lit(i))).join(word, f"id_{i}", "left" if i else "inner").drop(f"id_{i}")
    feature = F.concat_ws(" ", *[f"word_{i}" for i in range(most)])
    return stored(rows.select("tuple", (F.crc32(feature) % buckets).alias("bucket"), "s", "t"), "importance-buckets")


def bucket_gains(tuples: DataFrame, buckets: int) -> DataFrame:
    """(bucket, gain) of the buckets that any feature falls into; at most ``buckets`` rows."""
    each = tuples.groupBy("bucket").agg(F.sum("s").cast("double").alias("s"), F.sum("t").cast("double").alias("t"))
    whole = each.agg(F.coalesce(F.sum("s"), F.lit(0.0)).alias("all_s"), F.coalesce(F.sum("t"), F.lit(0.0)).alias("all_t"))
    ratio = (F.col("t") + 1) * (F.col("all_s") + buckets) / ((F.col("s") + 1) * (F.col("all_t") + buckets))
    return each.crossJoin(F.broadcast(whole)).select("bucket", F.floor(1000 * F.log(ratio)).alias("gain"))  # the right side is one row


def text_weights(blocks: DataFrame, tuples: DataFrame, gains: DataFrame) -> DataFrame:
    """doc_id, n_words, n_features, weight of the texts of ``blocks``, from (tuple, gain)."""
    own = tuples.join(gains, "tuple").groupBy("block").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "gain"))), lambda x: x["gain"]).alias("gains"))

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for docs, packed, gains in zip(*(batch.column(i) for i in range(3))):
                docs = docs.values
                values = np.array(gains.values.to_numpy(zero_copy_only=False) if gains.is_valid else [], np.int64)
                each = values[np.frombuffer(zstandard.ZstdDecompressor().decompress(packed.as_py()), np.int32)]
                ends = np.cumsum(docs.field("n_features").to_numpy())
                sums = np.concatenate(([0], np.cumsum(each)))
                weights = sums[ends] - sums[np.concatenate(([0], ends[:-1]))] if len(ends) else ends
                yield pa.RecordBatch.from_arrays([docs.field(0), docs.field(1), docs.field(2), pa.array(weights, pa.int64())], ["doc_id", "n_words", "n_features", "weight"])

    rows = blocks.select("block", "docs", "codes").join(own, "block", "left").select("docs", "codes", "gains")
    return rows.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def ranked(rows: DataFrame, order: list[Column], name: str = "rank", label: str = "ranks") -> DataFrame:
    """Rows with their place from 1 in an order over all rows: a range sort, and the sizes of its ranges added up."""
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("*", F.spark_partition_id().alias("_range"), F.monotonically_increasing_id().alias("_at"))
    placed = stored(placed, label)
    sizes = placed.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))  # a row for each range
    before = sizes.select("_range", (F.sum("_n").over(W.orderBy("_range")) - F.col("_n")).alias("_before"))
    return placed.join(before, "_range").withColumn(name, F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1).drop("_range", "_at", "_before")


def resampled(docs: DataFrame, target: DataFrame, most: int = 1, buckets: int = 10_000, percent: int = 10, least_words: int = 20, seed: int = 2024) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every row of docs: drawn so that their features are spread as the target's.

    Words are runs of a-z, 0-9 and characters beyond ASCII (A-Z folded); features are all runs of 1 to ``most`` words of
    a text, joined by a space, repeats counted. A feature's bucket is its crc32 modulo ``buckets``. A bucket's gain is
    floor(1000 * ln((t + 1)(S + buckets) / ((s + 1)(T + buckets)))) of the counts s of docs and t of the target and
    their totals S and T; weight sums the gains of a text's features. The score adds Gumbel noise drawn from
    sha256 of seed and doc_id, so the highest scores are a draw without replacement by weight. Of the N texts with
    ``least_words`` words or more, floor(percent * N / 100) are drawn: rank is their place from 1, null for all others; ties go to the
    smaller doc_id, a null one first, then to fewer features.

    Null and empty texts have no features and weight 0. Rows that repeat a doc_id are rows of their own, with equal noise; the noise of
    a null doc_id is that of an empty id. Texts are processed whole; empty tables give an empty result, an empty target gains from what is
    rare. Only doc_id and text are read, and the target's text.
    """
    with shuffle_cleanup(docs.sparkSession):  # each table is written once: what its job has shuffled goes at once
        scored, drawn = _scored(docs, target, most, buckets, percent, least_words, seed)
    enough = F.col("n_words") >= least_words
    names = ["doc_id", "n_features", "weight", "score"]
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_first(), F.col("n_features").asc()]
    placed = ranked(scored.where(enough).select(*names), order, "rank", "importance-ranks")
    placed = placed.select(*names, F.when(F.col("rank") <= drawn, F.col("rank")).alias("rank"))
    return placed.unionByName(scored.where(~enough).select(*names, F.lit(None).cast("long").alias("rank")))


def _scored(docs: DataFrame, target: DataFrame, most: int, buckets: int, percent: int, least_words: int, seed: int) -> tuple[DataFrame, int]:
    """doc_id, n_words, n_features, weight, score of all rows, and how many are drawn."""
    empty = F.coalesce(F.col("text"), F.lit("")).alias("text")
    corpus = stored(feature_blocks(docs.select(F.col("doc_id").cast("long").alias("doc_id"), empty), most, 0), "importance-corpus")
    wanted = stored(feature_blocks(target.select(F.lit(None).cast("long").alias("doc_id"), empty), most, 1), "importance-target")
    dictionary, tuples = numbered_tuples(corpus.union(wanted))
    known = tuple_buckets(tuples, dictionary, most, buckets)
    gains = known.select("tuple", "bucket").join(F.broadcast(bucket_gains(known, buckets)), "bucket").select("tuple", "gain")  # at most ``buckets`` rows
    weights = text_weights(corpus, tuples.where(F.shiftright("block", 62) == 0), gains)
    draw = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((draw + 0.5) / float(1 << 32))))
    scored = stored(weights.withColumn("score", F.col("weight") + noise), "importance-scores")
    return scored, percent * scored.where(F.col("n_words") >= least_words).count() // 100


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, **options) -> DataFrame:
    """Rows of docs, all columns, whose doc_id is drawn; ids are taken to be unique."""
    drawn = resampled(docs, target, percent=percent, **options).where("rank IS NOT NULL").select("doc_id").distinct()
    return docs.join(drawn, "doc_id", "left_semi")
