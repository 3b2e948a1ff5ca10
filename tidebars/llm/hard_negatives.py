"""Hard-negative mining: a two-dimensional block product of anchors and rows, in the manner of SUMMA.

Rows and anchors are packed into blocks, and each block is cut into chunks of dimensions. Blocks are dealt to a
grid: an anchor block travels once to each column of the grid, a row block once to each line, and within a cell
every pair of a chunk gives a partial tile of 64-bit integer scores. Partial tiles are added up after a shuffle by
tile, and only the best entries of a tile for each anchor (and window) go on to the next shuffle.

There are two passes. The first one meets blocks that share a label and finds the positives; the second meets
blocks that differ in a label, with the windows of scores that the positives open. Blocks are cut where the label
changes, so nearly every tile is needed in one of the passes only and no score is computed or stored twice.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import bounded_batches, lean, stored

#: Rows that are packed by one task, rows of a block, anchors of a block, and blocks along a side of a grid cell.
PACK_ROWS, BLOCK_ROWS, BLOCK_ANCHORS, CELL = 16_384, 4_096, 256, 8
#: A block that has this share of its rows is closed where the label changes.
CLOSE = 8
#: Stands for a null id, after all others in order.
NO_ID = (1 << 63) - 1

_BLOCK = "block long, chunk int, low int, high int, n int, most long, rows binary, ids binary, labels binary, data binary"
_TILE = "left long, right long, chunk int, rows binary, ids binary, labels binary, anchor_rows binary, anchor_ids binary, anchor_labels binary, windows array<struct<place int, positive int, positive_id long, positive_score long>>, scores binary"
_POSITIVE = "block long, place int, anchor_id long, positive_id long, score long, row long"
_NEGATIVE = "anchor_row long, anchor_id long, positive int, positive_id long, positive_score long, negative_id long, negative_score long, row long"


def usable(embeddings: DataFrame, relabel: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """id, label, embedding of the rows that take part: none of label, vector and components is null, all components are finite."""
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    label = F.col("label").cast("int")
    rows = embeddings.where(F.col("label").isNotNull() & F.col("embedding").isNotNull()).where(F.coalesce(sound, F.lit(False)))
    return rows.select(F.coalesce(F.col("vec_id").cast("long"), F.lit(NO_ID)).alias("id"), (relabel(F.col("vec_id"), label) if relabel else label).alias("label"), "embedding")


def packed(rows: DataFrame, count: int, dims: int, scale: float, most: int) -> DataFrame:
    """Blocks of up to ``most`` rows, a row for each chunk of dimensions. Rows are dealt evenly, whatever their labels and ids."""
    width = max(32, -(-dims // 4))
    bound = min((1 << 31) - 1, math.isqrt(((1 << 63) - 1) // max(1, dims)))

    def block(at: int, part: pa.Table) -> Iterator[pa.RecordBatch]:
        vectors, n = part.column("embedding").combine_chunks(), part.num_rows
        lengths = np.diff(vectors.offsets.to_numpy())
        values = np.floor(vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale)
        whole = np.zeros((n, dims), np.int32)
        whole[np.arange(dims) < lengths[:, None]] = np.clip(values, -bound, bound)
        own, ids, labels = (part.column(c).to_numpy() for c in ("row", "id", "label"))
        for chunk in range(max(1, -(-dims // width))):
            piece = np.ascontiguousarray(whole[:, chunk * width : (chunk + 1) * width])
            heads = [x.tobytes() if chunk == 0 else b"" for x in (own.astype(np.int64), ids.astype(np.int64), labels.astype(np.int32))]
            columns = [at, chunk, int(labels.min()), int(labels.max()), n, int(np.abs(piece.astype(np.int64)).max(initial=0)), *heads, piece.tobytes()]
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(columns, kinds)], [f.split()[0] for f in _BLOCK.split(", ")])

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            labels = batch.column(batch.schema.names.index("label")).to_numpy()
            cuts = [*(np.flatnonzero(np.diff(labels)) + 1).tolist(), len(labels)]
            begin = 0
            for cut in cuts:
                while begin < cut:
                    take = min(cut - begin, most - size)
                    held.append(batch.slice(begin, take))
                    begin, size = begin + take, size + take
                    if size == most:
                        yield from block(at, pa.Table.from_batches(held))
                        at, held, size = at + 1, [], 0
                if size >= most // CLOSE and cut < len(labels):
                    yield from block(at, pa.Table.from_batches(held))
                    at, held, size = at + 1, [], 0
        if held:
            yield from block(at, pa.Table.from_batches(held))

    dealt = rows.repartition(max(1, -(-count // PACK_ROWS))).sortWithinPartitions("label", "id")
    return dealt.mapInArrow(run, _BLOCK)


def products(anchors: DataFrame, rows: DataFrame, meet: Column) -> DataFrame:
    """Partial tiles of all pairs of blocks that ``meet``, of anchor columns ``a_*`` and row columns, a row for each chunk."""
    shards = [max(1, -(-df.where("chunk = 0").count() // CELL)) for df in (anchors, rows)]
    over = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = anchors.select(*[F.col(c).alias(f"a_{c}") for c in anchors.columns], F.col("chunk"), F.pmod(F.xxhash64("block"), F.lit(shards[0])).cast("int").alias("line"), over(shards[1]).alias("place"))
    right = rows.select("*", F.pmod(F.xxhash64("block"), F.lit(shards[1])).cast("int").alias("place"), over(shards[0]).alias("line"))
    pairs = left.hint("merge").join(right, ["line", "place", "chunk"]).where(meet)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                r = {k: batch.column(j)[i].as_py() for j, k in enumerate(batch.schema.names)}
                a, b = (np.frombuffer(r[d], np.int32).reshape(r[n], -1) for d, n in (("a_data", "a_n"), ("data", "n")))
                # sums of whole numbers below 2^53 are exact in doubles, for which products are fast
                kind = np.float64 if r["a_most"] * r["most"] * a.shape[1] < 1 << 53 else np.int64
                tile = (a.astype(kind) @ b.astype(kind).T).astype(np.int64)
                out = [r["a_block"], r["block"], r["chunk"], r["rows"], r["ids"], r["labels"], r["a_rows"], r["a_ids"], r["a_labels"], r["a_windows"] if r["chunk"] == 0 else [], tile.tobytes()]
                yield pa.RecordBatch.from_pylist([dict(zip(TILE_SCHEMA.names, out))], TILE_SCHEMA)

    wanted = ["a_block", "block", "chunk", "rows", "ids", "labels", "a_rows", "a_ids", "a_labels", "a_windows", "a_n", "n", "a_most", "most", "a_data", "data"]
    return pairs.select(*wanted).mapInArrow(run, _TILE)


_WINDOW = pa.struct([("place", pa.int32()), ("positive", pa.int32()), ("positive_id", pa.int64()), ("positive_score", pa.int64())])
TILE_SCHEMA = pa.schema([("left", pa.int64()), ("right", pa.int64()), ("chunk", pa.int32()), *[(c, pa.binary()) for c in ("rows", "ids", "labels", "anchor_rows", "anchor_ids", "anchor_labels")], ("windows", pa.list_(_WINDOW)), ("scores", pa.binary())])


class Tile:
    """A tile of whole scores: partial ones added up, its columns in order of id and row."""

    def __init__(self, table: pa.Table):
        scores = table.column("scores").to_pylist()
        first = table.column("chunk").to_pylist().index(0)
        of = lambda c, kind: np.frombuffer(table.column(c)[first].as_py(), kind)
        self.block = table.column("left")[first].as_py()
        self.anchor_rows, self.anchor_ids, self.anchor_labels = of("anchor_rows", np.int64), of("anchor_ids", np.int64), of("anchor_labels", np.int32)
        self.windows = table.column("windows")[first].as_py() or []
        rows, ids, labels = of("rows", np.int64), of("ids", np.int64), of("labels", np.int32)
        whole = np.zeros((len(self.anchor_rows), len(rows)), np.int64)
        for s in scores:
            whole += np.frombuffer(s, np.int64).reshape(whole.shape)
        order = np.lexsort((rows, ids))
        self.rows, self.ids, self.labels, self.scores = rows[order], ids[order], labels[order], whole[:, order]


def _arrow(found: list[tuple], schema: str) -> pa.Table:
    names, kinds = zip(*(f.split() for f in schema.split(", ")))
    columns = list(zip(*found)) or [()] * len(names)
    return pa.table([pa.array(c, pa.int32() if k == "int" else pa.int64()) for c, k in zip(columns, kinds)], names=list(names))


def best_positives(tiles: DataFrame, positives: int) -> DataFrame:
    """Of each tile and anchor the best rows of the same label, itself apart."""

    @lean
    def run(table: pa.Table) -> pa.Table:
        t, found = Tile(table), []
        for i in range(len(t.anchor_rows)):
            same = np.flatnonzero((t.labels == t.anchor_labels[i]) & (t.rows != t.anchor_rows[i]))
            s = t.scores[i, same]
            if len(s) > positives:  # all that reach the last of the best, then in order
                near = s >= np.partition(s, len(s) - positives)[len(s) - positives]
                same, s = same[near], s[near]
            for j in np.argsort(~s, kind="stable")[:positives].tolist():  # ~x falls as x rises and never overflows
                found.append((t.block, i, int(t.anchor_ids[i]), int(t.ids[same[j]]), int(s[j]), int(t.rows[same[j]])))
        return _arrow(found, _POSITIVE)

    return tiles.groupBy("left", "right").applyInArrow(run, _POSITIVE)


def best_negatives(tiles: DataFrame, low: int, high: int, negatives: int) -> DataFrame:
    """Of each tile and window the best rows of another label whose score lies between ``low`` and ``high`` hundredths of the positive's."""

    @lean
    def run(table: pa.Table) -> pa.Table:
        t, found = Tile(table), []
        windows: dict[int, list] = {}
        for w in t.windows:
            if (top := high * w["positive_score"] // 100) >= (bottom := -(-low * w["positive_score"] // 100)):
                windows.setdefault(w["place"], []).append((bottom, top, w))
        for i, ws in windows.items():
            s = t.scores[i]
            there = np.flatnonzero((s >= min(w[0] for w in ws)) & (s <= max(w[1] for w in ws)) & (t.labels != t.anchor_labels[i]))
            order = there[np.argsort(~s[there], kind="stable")]
            falling = ~s[order]
            for bottom, top, w in ws:
                begin, end = np.searchsorted(falling, ~top, "left"), np.searchsorted(falling, ~bottom, "right")
                for j in order[begin : min(end, begin + negatives)].tolist():
                    found.append((int(t.anchor_rows[i]), int(t.anchor_ids[i]), w["positive"], w["positive_id"], w["positive_score"], int(t.ids[j]), int(s[j]), int(t.rows[j])))
        return _arrow(found, _NEGATIVE)

    return tiles.groupBy("left", "right").applyInArrow(run, _NEGATIVE)


def hard_negatives(embeddings: DataFrame, anchor: Column | None = None, relabel: Callable[[Column, Column], Column] | None = None, scale: float = 256.0, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each anchor and each of its positives the best negatives.

    Scores are inner products of the components floor(scale * x). Higher ones come first, ties by smaller vec_id. An
    anchor's positives are the best ``positives`` other rows of its label; its negatives for a positive are the best
    ``negatives`` rows of other labels with low * positive_score <= 100 * score <= high * positive_score, which no row
    meets where positive_score < 0. ``anchor`` says which rows are anchors (by ``vec_id``), ``relabel`` gives a row's label from vec_id
    and label.

    Rows with a null label, a null vector, or a null or non-finite component take no part. A null vec_id is no
    anchor and comes after all others in order. Rows that repeat a vec_id are rows of their own, as anchors too. A shorter vector, or an
    empty one, counts as ended by zeros. Scores are exact 64-bit integers; components are held within
    sqrt(2^63 / dimensions), beyond which one could overflow (over a million before scaling, at 64 dimensions). An
    anchor without positives or negatives has no rows, an empty table gives none. Other columns are not read.
    """
    spark = embeddings.sparkSession
    bounded_batches(spark)
    chosen = F.col("vec_id") % 100 == 0 if anchor is None else anchor
    rows = usable(embeddings, relabel).withColumn("row", F.monotonically_increasing_id())
    rows = stored(rows.withColumnRenamed("id", "vec_id").withColumn("anchor", F.coalesce(chosen & (F.col("vec_id") != NO_ID), F.lit(False))).withColumnRenamed("vec_id", "id"), "negatives-rows")
    count, chosen_count, dims = rows.agg(F.count(F.lit(1)), F.count_if("anchor"), F.max(F.size("embedding"))).first()
    blocks = stored(packed(rows.drop("anchor"), count, dims or 0, scale, BLOCK_ROWS), "negatives-blocks")
    heads = stored(packed(rows.where("anchor").drop("anchor"), chosen_count, dims or 0, scale, BLOCK_ANCHORS), "negatives-anchors")

    none = F.array().cast("array<struct<place: int, positive: int, positive_id: long, positive_score: long>>")
    tiles = products(heads.withColumn("windows", none), blocks, (F.col("a_low") <= F.col("high")) & (F.col("low") <= F.col("a_high")))
    order = [F.col("score").desc(), F.col("positive_id"), F.col("row")]
    ranked = best_positives(tiles, positives).withColumn("positive", F.row_number().over(W.partitionBy("block", "place").orderBy(*order))).where(F.col("positive") <= positives)
    windows = ranked.groupBy("block").agg(F.collect_list(F.struct("place", "positive", "positive_id", F.col("score").alias("positive_score"))).alias("windows"))
    opened = stored(heads.join(windows, "block"), "negatives-windows")  # at most anchors of a block x positives for each block

    one_label = (F.col("a_low") == F.col("a_high")) & (F.col("low") == F.col("high")) & (F.col("low") == F.col("a_low"))
    found = best_negatives(products(opened, blocks, ~one_label), low, high, negatives)
    order = [F.col("negative_score").desc(), F.col("negative_id"), F.col("row")]
    found = found.withColumn("rank", F.row_number().over(W.partitionBy("anchor_row", "positive").orderBy(*order))).where(F.col("rank") <= negatives)
    name = lambda c: F.nullif(c, F.lit(NO_ID)).alias(c)
    return found.select("anchor_id", name("positive_id"), F.col("rank").cast("int").alias("rank"), name("negative_id"), "positive_score", "negative_score")


def shifted_labels(vec_id: Column, label: Column) -> Column:
    """Every seventh row gets the next of ten labels: mislabelled rows, which mining meets in practice."""
    return F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label)
