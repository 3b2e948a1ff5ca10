"""Token ids on storage, with a minimal perfect hash index from document keys to places in the payload.

Payload: blocks of raw little-endian unsigned 32-bit ids, in ascending doc_id order, each document followed by
an end id. A block row also lists its documents and their lengths. Index: document keys are dealt to
shards by hash; a shard holds a minimal perfect hash (levels of bit sets, with the number of bits before each
64-bit word), and for each slot a stored 32-bit fingerprint and the document's block, offset, length and start in the
whole id sequence. A key costs a few hashes, one word and one slot of its shard. Shards are directories of
the index and parts of the payload are buckets of its table, so a few keys cost a few files, of bounded size,
whatever the size of the store.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .bpe import SPLIT_TEXT, Vocabulary
from .common import lean, shared_path
from .tokens import _raw

#: Up to FEW shards or blocks are named in the filter of a scan; beyond, all are read, with the same result.
BLOCK_TOKENS, KEYS_PER_SHARD, FEW = 1 << 18, 200_000, 64
_U = np.uint64


def key_hash(doc: np.ndarray, copy: np.ndarray, seed: int) -> np.ndarray:
    """64-bit hashes of (doc key, copy number), independent for each seed."""
    with np.errstate(over="ignore"):
        x = doc.astype(np.int64).view(_U) * _U(0x9E3779B97F4A7C15) + _U((2 * seed + 1) * 0xD1B54A32D192ED03 & (1 << 64) - 1)
        for mult in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
            x = (x ^ (x >> _U(29))) * _U(mult)
            x = (x ^ (x >> _U(32))) + copy.astype(np.int64).view(_U) * _U(0xC2B2AE3D27D4EB4F)
        return x ^ (x >> _U(31))


def build_index(doc: np.ndarray, copy: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray, np.ndarray]:
    """Level sizes, level bits as 64-bit words, bits set before each word, and the slot of each key. Keys must be distinct."""
    left, slot, sizes, words, used = np.arange(len(doc)), np.zeros(len(doc), np.int64), [], [], 0
    while len(left):
        if len(sizes) > 64:
            raise ValueError("keys are not distinct")
        size = -(-2 * len(left) // 64) * 64
        at = (key_hash(doc[left], copy[left], len(sizes)) % _U(size)).astype(np.int64)
        alone = np.bincount(at, minlength=size) == 1
        rank = np.cumsum(alone) - 1 + used
        placed = alone[at]
        slot[left[placed]] = rank[at[placed]]
        used += int(alone.sum())
        sizes.append(size)
        words.append(np.packbits(alone, bitorder="little").view("<u8"))
        left = left[~placed]
    bits = np.concatenate([np.zeros(0, "<u8"), *words])
    counts = np.bitwise_count(bits).astype(np.int64)
    return sizes, bits, np.cumsum(counts) - counts, slot


def find_slots(doc: np.ndarray, copy: np.ndarray, sizes: list[int], bits: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Slot of each key; -1 if no level holds it. Unknown keys may get a slot: fingerprints tell."""
    slot, left, base = np.full(len(doc), -1, np.int64), np.arange(len(doc)), 0
    for level, size in enumerate(sizes):
        pos = key_hash(doc[left], copy[left], level) % _U(size)
        word, bit = (pos >> _U(6)).astype(np.int64) + base, pos & _U(63)
        hit = (bits[word] >> bit & _U(1)).astype(bool)
        word, bit = word[hit], bit[hit]
        slot[left[hit]] = before[word] + np.bitwise_count(bits[word] & ((_U(1) << bit) - _U(1)))
        base, left = base + size // 64, left[~hit]
    return slot


def text_encoder(raw: str):
    """A function text -> ids as 4-byte integers, equal to those of the tokenizers library for this file.

    The vocabulary runs in tiktoken, whose byte-level BPE gives the same ids several times faster; texts that
    hold a special string go to the tokenizers library itself.
    """
    import tiktoken
    from tokenizers import Tokenizer

    v = Vocabulary(raw)
    fast = tiktoken.Encoding("own", pat_str=SPLIT_TEXT, mergeable_ranks=v.ids, special_tokens={}).encode_ordinary
    library, special = Tokenizer.from_str(raw), list(v.special)

    def ids_of(text: str) -> bytes:
        if any(s in text for s in special):
            return array("I", library.encode(text, add_special_tokens=False).ids).tobytes()
        return array("I", fast(text)).tobytes()

    return ids_of


def _print_of(doc: np.ndarray, copy: np.ndarray) -> np.ndarray:
    return (key_hash(doc, copy, 1000) >> _U(32)).astype(np.uint32)


@dataclass
class TokenStore:
    """Names where a store lies: a bucketed table of blocks and a Parquet index with a directory for each shard."""

    spark: SparkSession
    blocks_table: str
    index_path: str
    n_shards: int

    def drop(self) -> None:
        """Remove the store from the catalog and its files."""
        paths = [self.spark.sql(f"DESCRIBE EXTENDED {self.blocks_table}").where("col_name = 'Location'").first()["data_type"], self.index_path]
        self.spark.sql(f"DROP TABLE {self.blocks_table}")
        jvm = self.spark.sparkContext._jvm
        for p in paths:
            path = jvm.org.apache.hadoop.fs.Path(p)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def index(self, asked: DataFrame | None = None) -> DataFrame:
        """The shards of the index; of those that ``asked`` names, only they where they are few."""
        whole = self.spark.read.schema(INDEX_SCHEMA).parquet(self.index_path)
        if asked is None:
            return whole
        some = [r["shard"] for r in asked.select("shard").distinct().limit(FEW + 1).collect()]
        return whole.where(F.col("shard").isin(some)) if len(some) <= FEW else whole

    def lookup(self, keys: DataFrame, prune: bool = True) -> DataFrame:
        """Places of the keys (doc_id, copy): key, copy, block, offset, length, start. Unknown keys give no row.

        ``prune``: ask first which shards are needed, and read no others where they are few.
        """

        def find(key: tuple, asked: pd.DataFrame, shard: pd.DataFrame) -> pd.DataFrame:
            empty = pd.DataFrame({"key": [], "copy": [], "block": [], "offset": [], "length": [], "start": []}).astype("int64")
            if not len(asked) or not len(shard):
                return empty
            row = shard.iloc[0]
            doc, copy = asked["key"].to_numpy(), asked["copy"].to_numpy()
            slot = find_slots(doc, copy, list(row["sizes"]), np.frombuffer(row["bits"], "<u8"), np.frombuffer(row["before"], "<i8"))
            known = (slot >= 0) & (np.frombuffer(row["prints"], "<u4")[np.maximum(slot, 0)] == _print_of(doc, copy))
            places = {n: np.frombuffer(row[n], "<i8")[slot[known]] for n in ("block", "offset", "length", "start")}
            return pd.DataFrame({"key": doc[known], "copy": copy[known]} | places)

        asked = keys.select(_key("doc_id").alias("key"), F.col("copy").cast("long").alias("copy")).withColumn("shard", _shard(self.n_shards))
        return asked.groupBy("shard").cogroup(self.index(asked if prune else None).groupBy("shard")).applyInPandas(find, "key long, copy long, block long, offset long, length long, start long")

    def checksums(self, keys: DataFrame) -> DataFrame:
        """doc key, copy, start, n_tokens and ids_crc32 of the stored ids of many keys, read through the index.

        Places meet the payload by its buckets, without moving it, and ids are cut out of a block in the JVM.
        """
        places = self.lookup(keys, prune=False).groupBy("block").agg(F.collect_list(F.struct("key", "copy", "offset", "length", "start")).alias("places"))
        by_part = places.groupBy(_part("block").alias("part")).agg(F.map_from_entries(F.collect_list(F.struct("block", "places"))).alias("held"))
        payload = self.spark.table(self.blocks_table).select("part", "block", "payload")

        def cut(block, p):
            return F.struct(p["key"].alias("key"), p["copy"].alias("copy"), p["start"].alias("start"), p["length"].alias("n_tokens"), F.crc32(F.substring(block, (p["offset"] * 4 + 1).cast("int"), (p["length"] * 4).cast("int"))).alias("ids_crc32"))

        # through a lambda variable a block is taken out of its row once, not once for each document
        crc = F.flatten(F.transform(F.array("payload"), lambda block: F.transform("places", lambda p: cut(block, p))))
        met = payload.join(by_part.hint("shuffle_hash"), "part").select("payload", F.try_element_at("held", "block").alias("places"))
        return met.where("places IS NOT NULL").select(F.explode(crc).alias("d")).select("d.*")

    def read(self, keys: DataFrame) -> DataFrame:
        """doc key, copy and ids (binary, 4 bytes each) of the keys. A few keys cost a few shards and buckets."""
        places = self.lookup(keys).withColumn("part", _part("block"))
        payload = self.spark.table(self.blocks_table).select("part", "block", "payload")
        some = places.select("part", "block").distinct().limit(FEW + 1).collect()
        if len(some) <= FEW:
            payload = payload.where(F.col("part").isin([r["part"] for r in some]) & F.col("block").isin([r["block"] for r in some]))
        return payload.join(places, ["part", "block"]).select("key", "copy", F.substring("payload", (F.col("offset") * 4 + 1).cast("int"), (F.col("length") * 4).cast("int")).alias("ids"))


INDEX_SCHEMA = "n_keys long, sizes array<long>, bits binary, before binary, prints binary, block binary, offset binary, length binary, start binary, shard int"
#: A null doc_id is stored under this key, ahead of all others as nulls sort.
NULL_KEY = -(1 << 63)


def _key(name: str):
    return F.coalesce(F.col(name).cast("long"), F.lit(NULL_KEY))


def _part(block: str):
    return F.shiftright(block, 32).cast("int")


def _shard(n: int):
    return F.pmod(F.xxhash64("key", "copy"), F.lit(n)).cast("int")


def write_store(docs: DataFrame, tokenizer_path: str, end_id: int = 0) -> TokenStore:
    """Encode every whole text, write blocks in ascending doc_id order, then the index.

    Null or empty text: only the end id. Rows that repeat a doc_id are copies 0, 1, ... in order of text; a
    null doc_id comes first. A document is never split between blocks; a long one has a block of its own.
    An empty table gives an empty store. Only doc_id and text are read.
    """
    spark, raw = docs.sparkSession, _raw(docs, tokenizer_path)

    @lean
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        ids_of = text_encoder(raw.value)
        end, part = array("I", [end_id]).tobytes(), TaskContext.get().partitionId()
        keys, copies, lengths, offsets, held, n, block, start = [], [], [], [], [], 0, 0, 0

        def row() -> pa.RecordBatch:
            columns = [pa.array([part << 32 | block], pa.int64()), pa.array([part], pa.int32()), pa.array([start], pa.int64()), pa.array([keys], pa.list_(pa.int64())), pa.array([copies], pa.list_(pa.int32())), pa.array([lengths], pa.list_(pa.int64())), pa.array([offsets], pa.list_(pa.int64())), pa.array([b"".join(held)], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["block", "part", "part_start", "keys", "copies", "lengths", "offsets", "payload"])

        before, copy = None, 0
        for batch in batches:
            for key, text in zip(batch.column(0), batch.column(1)):
                key, data = key.as_py(), ids_of(text.as_py()) + end
                copy = copy + 1 if key == before else 0
                before = key
                if n and n + len(data) // 4 > BLOCK_TOKENS:
                    yield row()
                    start, block = start + n, block + 1
                    keys, copies, lengths, offsets, held, n = [], [], [], [], [], 0
                keys.append(key)
                copies.append(copy)
                lengths.append(len(data) // 4)
                offsets.append(n)
                held.append(data)
                n += len(data) // 4
        if n:
            yield row()

    ordered = docs.select(_key("doc_id").alias("key"), F.coalesce("text", F.lit("")).alias("text")).repartitionByRange("key").sortWithinPartitions("key", "text")
    blocks = ordered.mapInArrow(encode, "block long, part int, part_start long, keys array<long>, copies array<int>, lengths array<long>, offsets array<long>, payload binary")
    name = "token_blocks_" + shared_path(spark, "x").rsplit("-", 1)[1]
    buckets = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # a task writes one part, so there are as many files as tasks
    blocks.write.bucketBy(buckets, "part").option("path", shared_path(spark, "token-blocks")).option("compression", "zstd").option("parquet.enable.dictionary", "false").saveAsTable(name)
    written = spark.table(name)
    # totals of the parts: as many rows as the writing job had tasks
    parts = written.groupBy("part").agg(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n"), F.sum(F.size("keys")).alias("docs"))
    bases = parts.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("base"))
    n_shards = max(16, (parts.agg(F.sum("docs")).first()[0] or 0) // KEYS_PER_SHARD)
    zipped = F.explode(F.arrays_zip("keys", "copies", "lengths", "offsets")).alias("e")
    entries = (
        written.join(bases, "part")
        .select("block", (F.col("base") + F.col("part_start")).alias("block_start"), zipped)
        .select(F.col("e.keys").alias("key"), F.col("e.copies").cast("long").alias("copy"), "block", F.col("e.offsets").alias("offset"), F.col("e.lengths").alias("length"), (F.col("block_start") + F.col("e.offsets")).alias("start"))
    )

    def build(key: tuple, keys: pd.DataFrame) -> pd.DataFrame:
        doc, copy = keys["key"].to_numpy(), keys["copy"].to_numpy()
        sizes, bits, before, slot = build_index(doc, copy)
        order = np.argsort(slot)
        filled = {n: keys[n].to_numpy("<i8")[order].tobytes() for n in ("block", "offset", "length", "start")}
        return pd.DataFrame([{"n_keys": len(doc), "sizes": sizes, "bits": bits.tobytes(), "before": before.astype("<i8").tobytes(), "prints": _print_of(doc, copy)[order].astype("<u4").tobytes()} | filled | {"shard": key[0]}])

    index_path = shared_path(spark, "token-index")
    entries.withColumn("shard", _shard(n_shards)).groupBy("shard").applyInPandas(build, INDEX_SCHEMA).write.partitionBy("shard").parquet(index_path)
    return TokenStore(spark, name, index_path, n_shards)


def store_and_read(docs: DataFrame, tokenizer_path: str, end_id: int = 0) -> DataFrame:
    """Write the store, then read every document of docs back through the index: doc_id, start, n_tokens, ids_crc32.

    Edge cases as in ``write_store``: one row for each row of docs.
    """
    store = write_store(docs, tokenizer_path, end_id)
    counts = docs.groupBy(F.col("doc_id").cast("long").alias("doc_id")).count()
    keys = counts.select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("count") - 1)).alias("copy"))
    return store.checksums(keys).select(F.nullif("key", F.lit(NULL_KEY)).alias("doc_id"), "start", "n_tokens", "ids_crc32")
