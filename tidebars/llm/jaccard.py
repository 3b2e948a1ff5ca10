"""N-gram Jaccard join by PartEnum signatures.

Sets are put into bands of nearly equal size; two sets that link lie in one band or in neighbouring ones, so
each set takes part in the instances of its band and the next. Within an instance linked sets differ in at
most k elements. The feature domain is cut into n1 parts of n2 cells each, and a signature is the projection
of the set on one part without k2 of its cells, for every choice of them. As n1 * (k2 + 1) > k, linked sets
agree on at least one signature. Sets that share a signature form chains, chains form clusters of candidates,
and each cluster is then compared exactly; a large cluster is compared by pairs of blocks of sets of like
size in separate tasks.

Shingles and sets are told apart by 64-bit hashes. A projection of no element or of one ties unrelated sets together, and
as the table grows these ties grow with its square, until most sets are one cluster. In large sets projections of few elements
are left out: linked ones agree on about half of their many parts, and all of these are so poor for both with a chance of less
than ``LOSS``. In smaller sets, at 80 % up to about 230, they are made up by the set's first elements, as many as leave two linked
sets enough in common, so that a signature always stands for two elements; elements that many sets hold are left out of their
projections and come last among the first ones. No link is lost there. Sets without a common shingle never meet.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bpe import in_groups
from .common import components, drawn, lean, one_row_each, shuffle_cleanup, spread_join, stored
from .substring_dedup import split_words
from .superkmers import NULL_KEY, _mix, keyed, mix, rows_of_runs, window_hash

_U, _SEED = np.uint64, 0x9E3779B97F4A7C15
GROUP_CHARS, BLOCK_ELEMENTS, TASK_ELEMENTS, KNOWN_SETS, LOSS, FEW = 1_500_000, 500_000, 2_000_000, 100_000, 1e-8, 4
#: Sets that are drawn to learn which shingles are common, in how many of these one is, and how many are sent out at most. No result depends on them.
DRAWN, OFTEN, MOST_COMMON = 20_000, 4, 100_000


@lru_cache(1 << 16)
def band(size: int, percent: int) -> int:
    """Number of the size band: bands run from l to floor(100 l / percent), the next begins one above."""
    i, low = 0, 1
    while size > low * 100 // percent:
        low, i = low * 100 // percent + 1, i + 1
    return i


@lru_cache(1 << 12)
def instance(i: int, percent: int) -> tuple[int, int, np.ndarray, np.ndarray, int, int]:
    """n1, n2, the cell choices of instance i, for sets of bands i - 1 and i, a label for each part and choice, ``fewest`` and ``shared``.

    ``shared``: elements that two sets have in common at least if a signature says that they may be linked, two wherever all linked sets have as many.
    ``fewest``: projections of fewer elements, up to ``FEW``, are left out, as linked sets agree on so many parts that all of these are so poor with
    a chance of less than ``LOSS``.
    """
    before = low = 1
    for _ in range(i):
        before, low = low, low * 100 // percent + 1
    k = 2 * (low * 100 // percent) * (100 - percent) // (100 + percent)
    n1, k2, n2 = (1, 0, 1) if k == 0 else (1, k, k + 3) if k <= 3 else (-(-(k + 1) // 2), 1, 3)
    choices = np.array(list(combinations(range(n2), n2 - k2)))
    place = np.arange(n1 * len(choices), dtype=_U) + (_U(i) << _U(40))
    fewest = 0
    if n1 >= 3:
        # a part is agreed on if all that is apart lies in one cell; then the other two cells hold elements in common only
        agreed = sum(_chance(k, 1 / n1, j) * 3.0 ** min(0, 1 - j) for j in range(min(k, 40) + 1))
        while fewest < FEW:
            poor = sum(_chance(before, 2 / (3 * n1), j) for j in range(fewest + 1))
            # at least one part is agreed on, and each that is has a poor projection: (1 - agreed + agreed * poor) ** n1 - (1 - agreed) ** n1
            all_poor = n1 * math.log1p(agreed * (poor - 1))
            if all_poor + math.log(-math.expm1(n1 * math.log1p(-agreed) - all_poor)) > math.log(LOSS):
                break
            fewest += 1
    return n1, n2, choices, mix(place).reshape(n1, len(choices)), fewest, min(2, -(-percent * before // 100))


def _chance(n: int, p: float, j: int) -> float:
    """Of j hits in n trials."""
    return math.exp(math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) + j * math.log(p) + (n - j) * math.log1p(-p)) if j <= n else 0.0


def signatures(elements: np.ndarray, percent: int, common: np.ndarray | None = None) -> np.ndarray:
    """Signatures of a set of ascending 64-bit elements, for both of its instances.

    Elements in ``common`` (ascending) are left out of projections where poor ones may not be: what two sets differ in grows no larger, so they
    agree on as many parts. A projection of fewer elements than ``shared`` that may not be left out is made up by the set's first elements, each
    or each two of them, those in ``common`` last: linked sets that both have it share one of these, as each has few elements beyond those shared.
    """
    out, own, size = [], band(len(elements), percent), len(elements)
    spare, rare = size - -(-percent * size // 100), np.ones(size, bool)
    if common is not None and len(common) and not (instance(own, percent)[4] and instance(own + 1, percent)[4]):
        rare = common[np.minimum(np.searchsorted(common, elements), len(common) - 1)] != elements
    with np.errstate(over="ignore"):
        mixed = mix(elements + _U(0x632BE59BD9B4E019))
        ordered = np.concatenate([mixed[rare], mixed[~rare]])
        for i in (own, own + 1):
            n1, n2, choices, labels, fewest, shared = instance(i, percent)
            cells, used = n1 * n2, slice(None) if fewest else rare
            cell = (elements[used] % _U(cells)).astype(np.int64)
            sums, counts = np.zeros(cells, _U), np.bincount(cell, minlength=cells).reshape(n1, n2)
            np.add.at(sums, cell, mixed[used])
            sums, filled = sums.reshape(n1, n2)[:, choices].sum(2), counts[:, choices].sum(2)
            found = _mix(sums + labels)
            out.append(found[filled >= max(fewest, shared)])
            # of the first ``spare`` + x elements of each of two linked sets, the x first ones in common are among both
            first = (mixed if fewest else ordered)[: spare + shared]
            if fewest <= 1 < shared and (at := filled == 1).any():
                # another one in common, besides that of the projection
                out.append(_mix((_mix(first)[:, None] ^ found[at]) * _U(_SEED))[first[:, None] != sums[at]])
            if fewest == 0 and not filled.all():
                x, y = np.triu_indices(len(first), 1) if shared == 2 else (np.arange(len(first)),) * 2
                out.append(_mix((_mix(first[x] + _mix(first[y])) ^ labels[0, 0]) * _U(_SEED)))
    return np.concatenate(out)


def shingle_sets(texts: list[str], n: int) -> Iterator[np.ndarray]:
    """The distinct n-word shingles of each text as sorted hashes; A-Z fold to lower case."""
    lists = [t.encode().lower() for t in texts]
    _, values, lengths, _ = split_words(lists)
    all_shingles = mix(window_hash(values, n))
    end = 0
    for length in lengths.tolist():
        begin, end = end, end + length
        if length >= n:
            yield np.unique(all_shingles[begin : end - n + 1])
        elif length:
            yield mix(window_hash(values[begin:end], length) + _U(length))
        else:
            yield np.zeros(0, _U)


def set_id(elements: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        return int(mix(mix(elements).sum(keepdims=True) + _U(len(elements)))[0].astype(np.int64)) if len(elements) else 0


def set_table(rows: DataFrame, n: int) -> DataFrame:
    """doc_id, key, row_hash, n_shingles, set_id for every row of ``keyed``."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, ids, texts = [], [], batch.column(3).to_pylist()
            for s in in_groups(texts, GROUP_CHARS):
                for elements in shingle_sets(texts[s], n):
                    sizes.append(len(elements))
                    ids.append(set_id(elements))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sizes, pa.int64()), pa.array(ids, pa.int64())], ["doc_id", "key", "row_hash", "n_shingles", "set_id"])

    return rows.mapInArrow(run, "doc_id long, key long, row_hash long, n_shingles long, set_id long")


def signature_table(rows: DataFrame, n: int, sign: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """(signature, set_id) of every distinct set; a task gives those of equal sets that it meets close together once."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for s in in_groups(texts, GROUP_CHARS):
                ids, found = [], []
                if len(done) > KNOWN_SETS:
                    done.clear()
                for elements in shingle_sets(texts[s], n):
                    if len(elements) and (own := set_id(elements)) not in done:
                        done.add(own)
                        ids.append(own)
                        found.append(sign(elements))
                if ids:
                    ends = np.concatenate(([0], np.cumsum([len(f) for f in found])))
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(found).view(np.int64)))], ["set_id", "signatures"])

    return rows.select("text").mapInArrow(run, "set_id long, signatures array<long>").select(F.explode("signatures").alias("signature"), "set_id")


def common_shingles(rows: DataFrame, n: int, percent: int, n_rows: int) -> np.ndarray:
    """Shingles, ascending, in at least ``OFTEN`` of about ``DRAWN`` sets drawn by hash, of the sizes for which ``signatures`` asks.

    They say where unrelated sets would meet, as in lines that many texts share. Whatever is in it, no link is lost.
    """

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for s in in_groups(texts, GROUP_CHARS):
                small = [x for x in shingle_sets(texts[s], n) if len(x) and not instance(band(len(x), percent), percent)[4]]
                if small:
                    ids = np.repeat([set_id(x) for x in small], [len(x) for x in small])
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(small).view(np.int64)), pa.array(ids, pa.int64())], ["shingle", "set_id"])

    some = rows.where(drawn(min(1.0, DRAWN / max(1, n_rows)), "row_hash")).select("text").mapInArrow(run, "shingle long, set_id long").distinct()
    often = some.groupBy("shingle").count().where(F.col("count") >= OFTEN).orderBy(F.desc("count"), "shingle").limit(MOST_COMMON)
    return np.sort(often.toPandas()["shingle"].to_numpy(np.int64).view(_U))


def compare_group(sets: list[np.ndarray], side: list[int], percent: int, across: bool) -> Iterator[tuple[int, int]]:
    """All linked pairs of positions, or only those of different sides."""
    n, sizes = len(sets), np.array([len(s) for s in sets])
    elements = np.concatenate(sets)
    owner = np.repeat(np.arange(n), sizes)
    order = np.argsort(elements, kind="stable")
    new = np.ones(len(order), bool)
    new[1:] = elements[order[1:]] != elements[order[:-1]]
    first = np.flatnonzero(new)
    counts = np.diff(np.append(first, len(order)))
    name = np.empty(len(order), np.int64)
    name[order] = np.cumsum(new) - 1
    posting, ends, sides = owner[order], np.cumsum(sizes), np.array(side)
    for i in range(n):
        mine = name[ends[i] - sizes[i] : ends[i]]
        mine = mine[counts[mine] > 1]
        if len(mine):
            common = np.bincount(posting[rows_of_runs(first[mine], counts[mine])], minlength=n)
            linked = 100 * common >= percent * (sizes + sizes[i] - common)
            if across:
                linked &= sides != sides[i]
            linked[: i + 1] = False
            yield from ((i, int(j)) for j in np.flatnonzero(linked))


def placed_members(members: DataFrame, percent: int) -> DataFrame:
    """Members (cluster, set_id, size, ...) with ``units``, the comparisons that each takes part in, and ``share`` = size * number of units.

    A cluster of up to ``BLOCK_ELEMENTS`` is one unit. In a larger one, linked sets lie in one band of sizes or in neighbouring ones,
    so only blocks of these are compared: a unit is (band, block a, step, block b), step 1 for pairs across to the next band.
    """
    width = F.lit(math.log(100 / percent) * (1 + 1e-9))
    whole = members.groupBy("cluster").agg((F.sum("size") > BLOCK_ELEMENTS).alias("large"))
    banded = spread_join(members, whole, "cluster", "set_id").withColumn("band", F.when(F.col("large"), F.floor(F.log(F.col("size").cast("double")) / width)).otherwise(0).cast("int"))
    order = W.partitionBy("cluster").orderBy("band")  # a row for each band of sizes, of which there are few
    counts = banded.groupBy("cluster", "band").agg(F.ceil(F.sum("size") / BLOCK_ELEMENTS).cast("int").alias("n"))
    near = lambda f, d: F.when(f("band").over(order) == F.col("band") + d, f("n").over(order)).otherwise(0)
    counts = counts.select("cluster", "band", "n", near(F.lag, -1).alias("down"), near(F.lead, 1).alias("up"))
    out = spread_join(banded, counts, ["cluster", "band"], "set_id").withColumn("block", F.pmod(F.xxhash64("set_id"), F.col("n")).cast("int"))
    block, band = F.col("block"), F.col("band")
    unit = lambda g, x, step, y, side: F.struct(g.alias("g"), x.alias("a"), F.lit(step).alias("step"), y.alias("b"), side.alias("side"))
    some = lambda n, f: F.transform(F.when(F.col(n) > 0, F.sequence(F.lit(0), F.col(n) - 1)).otherwise(F.array().cast("array<int>")), f)
    units = F.concat(
        some("n", lambda j: unit(band, F.least(block, j), 0, F.greatest(block, j), (block > j).cast("int"))),
        some("up", lambda j: unit(band, block, 1, j, F.lit(0))),
        some("down", lambda j: unit(band - 1, j, 1, block, F.lit(1))),
    )
    return out.withColumn("units", units).withColumn("share", F.col("size") * F.size("units")).drop("large", "band", "n", "down", "up", "block")


def cluster_links(members: DataFrame, n: int, percent: int, tasks: int) -> DataFrame:
    """(u, v, links) of members (cluster, set_id, text, copies, units): pairs that join parts, and counts at u = v.

    Only pairs that join parts not yet joined within the task come out; ``links`` sums up the copies behind all linked sets.
    """
    key = ["cluster", "g", "a", "step", "b"]
    pairs = members.select("cluster", "set_id", "copies", "text", F.explode("units").alias("unit")).select("cluster", "set_id", "copies", "text", "unit.*")
    pairs = pairs.withColumn("task", F.pmod(F.xxhash64(*key), F.lit(tasks)).cast("int"))

    @lean
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([(k, "ascending") for k in (*key, "set_id")])
        c = {k: table.column(k).to_pylist() for k in (*key, "side", "set_id", "copies", "text")}
        keys = list(zip(*(c[k] for k in key)))
        edges, begin = [], 0
        while begin < len(keys):
            end = begin
            while end < len(keys) and keys[end] == keys[begin]:
                end += 1
            s = slice(begin, end)
            begin = end
            ids, copies, parent = c["set_id"][s], c["copies"][s], list(range(end - s.start))
            if len(ids) < 2:
                continue

            def root(x: int) -> int:
                while parent[x] != x:
                    parent[x] = x = parent[parent[x]]
                return x

            links = [0] * len(ids)
            texts = c["text"][s]
            sets = [x for part in in_groups(texts, GROUP_CHARS) for x in shingle_sets(texts[part], n)]
            _, _, a, step, b = keys[s.start]
            for i, j in compare_group(sets, c["side"][s], percent, step == 1 or a != b):
                links[i] += copies[j]
                links[j] += copies[i]
                if (x := root(i)) != (y := root(j)):
                    parent[max(x, y)] = min(x, y)
                    edges.append((ids[i], ids[j], 0))
            edges += [(x, x, k) for x, k in zip(ids, links) if k]
        columns = list(zip(*edges)) or [[], [], []]
        return pa.table([pa.array(x, pa.int64()) for x in columns], names=["u", "v", "links"])

    return pairs.groupBy("task").applyInArrow(run, "u long, v long, links long")


def jaccard_rows(docs: DataFrame, n: int = 5, percent: int = 80, sign: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """doc_id, identity, n_shingles, component_id, n_links, kept of every row of docs.

    ``sign``: gives the signatures of a set, of which linked sets share at least one; PartEnum's if not given.

    ``identity``: a hash of the text, which tells rows of one doc_id apart; ``kept``: true for one row of a
    component, that of least doc_id and then least identity (rows that repeat doc_id and text share it), and for
    every row with an empty set. The rest is as ``jaccard_components`` says.
    """
    rows = keyed(docs)
    sets = stored(set_table(rows, n), "jaccard-sets")
    if sign is None:
        common = docs.sparkSession.sparkContext.broadcast(common_shingles(rows, n, percent, sets.count()))
        sign = lambda elements: signatures(elements, percent, common.value)
    # equal signatures: a chain through the sets that share one, in order of set_id, streaming within the sort
    chain = signature_table(rows, n, sign).select("set_id", F.lag("set_id").over(W.partitionBy("signature").orderBy("set_id")).alias("before")).where("before <> set_id")
    with shuffle_cleanup(docs.sparkSession):
        pairs = stored(chain.select(F.col("before").alias("u"), F.col("set_id").alias("v")).distinct(), "jaccard-chains")
    clusters = components(pairs, "jaccard-candidates")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_hash")).alias("first")
    classes = sets.where("n_shingles > 0").groupBy("set_id").agg(first, F.max("n_shingles").alias("size"), F.count(F.lit(1)).alias("copies"))
    members = stored(classes.join(clusters.select(F.col("node").alias("set_id"), F.col("component").alias("cluster")), "set_id").select("set_id", "cluster", "size", "copies", F.coalesce("first.doc_id", F.lit(NULL_KEY)).alias("key"), "first.row_hash"), "jaccard-members")
    placed = placed_members(members, percent)
    # a member is sent once for each of its comparisons
    tasks = max(16, int((placed.agg(F.sum("share")).first()[0] or 0) / TASK_ELEMENTS))
    # one plan at every size: the members grow with the input, so they are never broadcast
    texts = rows.select("key", "row_hash", "text").join(placed.hint("merge"), ["key", "row_hash"]).dropDuplicates(["set_id"])
    links = stored(cluster_links(texts.select("cluster", "set_id", "text", "copies", "units"), n, percent, tasks), "jaccard-links")
    found = components(links.where("u <> v").select("u", "v"), "jaccard-components")
    counts = links.where("u = v").groupBy(F.col("u").alias("set_id")).agg(F.sum("links").alias("links"))
    known = classes.select("set_id", "copies", "first").join(found.select(F.col("node").alias("set_id"), "component"), "set_id", "left").join(counts, "set_id", "left")
    known = known.select("set_id", F.coalesce("component", "set_id").alias("component"), "first", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    names = spread_join(known.drop("first"), known.groupBy("component").agg(F.min("first").alias("first")), "component", "set_id").drop("component")
    # rows of many copies are spread before they meet what is known of their set
    out = spread_join(sets.where("n_shingles > 0").withColumn("spread", F.xxhash64("key", "row_hash")), names, "set_id", "spread")
    kept = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("row_hash") == F.col("first.row_hash"))
    out = out.select("doc_id", F.col("row_hash").alias("identity"), "n_shingles", F.col("first.doc_id").alias("component_id"), "n_links", kept.alias("kept"))
    empty = sets.where("n_shingles = 0").select("doc_id", F.col("row_hash").alias("identity"), "n_shingles", F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links"), F.lit(True).alias("kept"))
    return out.unionByName(empty)


def jaccard_components(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links of every row of docs.

    A row's set holds the distinct n-word shingles of its text (words: runs without x20 and x09-x0D, A-Z folded);
    shorter texts have one shingle, the whole sequence. Rows link when 100 * common >= percent * union.
    component_id: the least doc_id reachable by links; n_links: the number of other rows linked with. Null or
    empty text has an empty set and links with nothing. Rows that repeat are linked with each other, as equal
    texts are. Null doc_ids take part; they are component_id only where no other id is reachable. Long texts
    are processed whole, an empty table gives an empty result. Only doc_id and text are read.
    """
    return jaccard_rows(docs, n, percent).select("doc_id", "n_shingles", "component_id", "n_links")


def without_near_copies(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """Rows of docs, all columns: of each component the one of least doc_id; rows without words all stay.

    Of rows that repeat doc_id and text one stays; rows of one doc_id with other texts are rows of their own.
    """
    return one_of_each_component(docs, jaccard_rows(docs, n, percent))


def one_of_each_component(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Rows of docs that ``found``, of ``jaccard_rows``, keeps."""
    words = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    kept = found.where("kept AND n_shingles > 0")
    return one_row_each(docs.where(words), kept, F.xxhash64("text")).unionByName(docs.where(~words))
