"""Super-k-mers: consecutive windows of k tokens that share a minimiser, packed and dealt to buckets by it.

Equal windows have equal minimisers, so they meet in one bucket whatever document they stand in. Inside a
task, runs that the task itself has seen earlier are settled at once and not sent: groups of copies and lines of
many documents shrink to one packed string for each task before the shuffle. The text operators on words and on bytes both use it.

Periodic text has one minimiser throughout. A window that holds its minimiser more than once is therefore a run
of its own, dealt by the hash of the whole window, and a run ends where the minimiser is found at another
place: no run is longer than the grams of a window, so all can be settled before they are sent.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, lean, shuffle_cleanup, stored

_U = np.uint64
_P = 0x9E3779B97F4A7C15 | 1
#: A null doc_id goes ahead of all others.
NULL_KEY = -(1 << 63)
#: A bucket's windows are settled in this many sections, one after the other, to bound the memory of a task.
SECTIONS = 16
#: Text of frequent runs that a task remembers.
SENT_BYTES = 8_000_000
BLOCK_SCHEMA = "bucket int, block binary"
SPAN_SCHEMA = "key long, row_hash long, start long, count long"


#: Long arrays are worked on in pieces of this length, which stay in a core's cache.
PIECE = 1 << 15


def in_pieces(f: Callable[[np.ndarray], np.ndarray], x: np.ndarray, k: int = 1) -> np.ndarray:
    """f(x), of which each value depends on k consecutive ones of x."""
    if len(x) <= PIECE + k:
        return f(x)
    out = np.empty(len(x) - k + 1, x.dtype)
    for i in range(0, len(out), PIECE):
        out[i : i + PIECE] = f(x[i : i + PIECE + k - 1])
    return out


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


def mix(x: np.ndarray) -> np.ndarray:
    return in_pieces(_mix, x) if x.ndim == 1 else _mix(x)


def _window_hash(h: np.ndarray, k: int) -> np.ndarray:
    out, have, power, size = None, 0, h, 1
    with np.errstate(over="ignore"):
        while True:
            if k & size:
                if out is None:
                    out, have = power, size
                else:
                    n = len(h) - have - size + 1
                    out = out[:n] + _U(pow(_P, have, 1 << 64)) * power[have : have + n]
                    have += size
            if have == k:
                return out
            n = len(power) - size
            power = power[:n] + _U(pow(_P, size, 1 << 64)) * power[size:]
            size *= 2


def window_hash(h: np.ndarray, k: int) -> np.ndarray:
    """Polynomial hash of each k consecutive values, by doubling; shorter by k - 1."""
    return in_pieces(lambda x: _window_hash(x, k), h, k) if len(h) >= k else h[:0]


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    size = 1
    while size * 2 <= w:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (w - size)], x[w - size :]) if w > size else x


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Least of each w consecutive values; shorter by w - 1."""
    return in_pieces(lambda y: _sliding_min(y, w), x, w)


def repeated_minimisers(grams: np.ndarray, least: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window of w grams: does it hold its least one twice or more; is that at another place than in the window before.

    Places where a gram is the least of some window come first. Two equal ones in a window are neighbours among
    those: a window with one between them would hold either of them. The second answer is given only where a
    place is followed by an equal one exactly w on, as the windows around others differ in the first.
    """
    edge = np.zeros(w - 1, _U)
    place = np.flatnonzero(~sliding_min(~np.concatenate([edge, least, edge]), w) == grams)
    pair = np.flatnonzero((grams[place[1:]] == grams[place[:-1]]) & (np.diff(place) <= w))
    p, q = place[pair], place[pair + 1]
    again, moved = np.zeros(len(least), bool), np.zeros(len(least), bool)
    begin = np.maximum(q - w + 1, 0)
    count = np.maximum(np.minimum(p, len(least) - 1) - begin + 1, 0)
    windows = rows_of_runs(begin, count)
    again[windows[least[windows] == np.repeat(grams[p], count)]] = True
    step = p[(q - p == w) & (p + 1 < len(least))] + 1
    moved[step] = True
    return again, moved


def rows_of_runs(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0]+1, ... (counts[0] of them), then those of the next run, and so on."""
    ends = np.cumsum(counts)
    return np.repeat(starts - (ends - counts), counts) + np.arange(int(ends[-1]) if len(ends) else 0)


def runs_of_flags(flag: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of each run of true flags; a run also ends where ``breaks`` is true (a new run starts there)."""
    at = np.flatnonzero(flag)
    if not len(at):
        return at, at
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(at) != 1) | breaks[at[1:]]
    first = np.flatnonzero(new)
    return at[first], np.diff(np.append(first, len(at)))


def repeated(hashes: np.ndarray) -> np.ndarray:
    """Indices of values that may occur twice: those whose slot in a table is taken by another index too."""
    bits = min(24, max(10, int(len(hashes) * 4).bit_length()))
    slot = (hashes >> _U(64 - bits)).astype(np.int32)
    index, last = np.arange(len(hashes), dtype=np.int32), np.empty(1 << bits, np.int32)
    last[slot] = index
    twice = np.zeros(1 << bits, bool)
    twice[slot[last[slot] != index]] = True
    return np.flatnonzero(twice[slot])


def not_alone(values: np.ndarray) -> np.ndarray:
    """Indices, in order, of the values that occur more than once."""
    by = np.argsort(values)
    alone = np.ones(len(by) + 1, bool)
    alone[1:-1] = values[by[1:]] != values[by[:-1]]
    return np.sort(by[~(alone[1:] & alone[:-1])])


def _small(x: np.ndarray) -> np.ndarray:
    """The array in the narrowest integer type that holds it."""
    return x.astype(np.min_scalar_type(-int(max(abs(int(x.min())), abs(int(x.max())))) - 1)) if len(x) else x.astype(np.int8)


@dataclass
class Space:
    """What differs between kinds of tokens. ``group``: (tokens, offsets) of equal windows to exact groups."""

    k: int
    m: int
    by_document: bool  # only windows of earlier documents count, not earlier ones of the same document
    split: Callable[[list[str]], tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes] | None]]
    group: Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]
    group_tokens: int


def later_windows(space: Space, tokens: np.ndarray, hashes: np.ndarray, at: np.ndarray, rank: np.ndarray, start: np.ndarray) -> np.ndarray:
    """True for each window at tokens[at] that has an equal one of lesser rank (or of equal rank and lesser start)."""
    late = np.zeros(len(at), bool)
    maybe = repeated(hashes)
    maybe = maybe[not_alone(hashes[maybe])]
    if not len(maybe):
        return late
    # only the tokens of these windows are ordered
    edge = np.zeros(len(tokens) + 1, np.int8)
    edge[at[maybe]] = 1
    edge[at[maybe] + space.k] -= 1
    inside = np.cumsum(edge[:-1], dtype=np.int32) > 0
    place = np.cumsum(inside, dtype=np.int64) - 1
    order, new = space.group(tokens[inside], place[at[maybe]], hashes[maybe])
    order, first = maybe[order], np.flatnonzero(new)
    code = rank if space.by_document else rank << np.int64(36) | start
    least = np.minimum.reduceat(code[order], first)
    late[order] = code[order] > np.repeat(least, np.diff(np.append(first, len(order))))
    return late


def run_keys(hashes: np.ndarray, at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A hash of each run of n windows, of its first and last one."""
    with np.errstate(over="ignore"):
        return mix(hashes[at] ^ mix(hashes[at + n - 1] + n.astype(_U)))


class Sent:
    """Runs that a task has sent and met again, by run key: the least (doc_id, text hash, start) they were sent for, and their tokens.

    What is remembered is bounded by ``SENT_BYTES``; a run that is not remembered is sent again, with the same result.
    """

    def __init__(self, by_document: bool):
        self.by_document, self.runs, self.size = by_document, {}, 0

    def settle(self, keys: np.ndarray, late: np.ndarray, owner: Callable[[int], tuple[int, int, int]], content: Callable[[int], bytes]) -> None:
        """Mark runs late that equal a remembered run of an earlier place, and remember those that others of this batch repeat."""
        if self.runs:
            for i in np.flatnonzero(~late & np.isin(keys, np.fromiter(self.runs, _U, len(self.runs)))).tolist():
                place, tokens = self.runs[int(keys[i])]
                if tokens == content(i):
                    own = owner(i)
                    if (own[0] > place[0]) if self.by_document else own > place:
                        late[i] = True
                    elif own < place:
                        self.runs[int(keys[i])] = own, tokens
        if self.size < SENT_BYTES and late.any():
            for i in np.flatnonzero(~late & np.isin(keys, keys[late])).tolist():
                if int(keys[i]) not in self.runs:
                    tokens = content(i)
                    self.runs[int(keys[i])] = owner(i), tokens
                    self.size += len(tokens) + 200


def later_runs(space: Space, tokens: np.ndarray, hashes: np.ndarray, at: np.ndarray, n: np.ndarray, rank: np.ndarray, start: np.ndarray) -> np.ndarray:
    """True for each run of n windows at tokens[at] that equals, token by token, a run of lesser rank (or start).

    ``hashes``: of the window at each token. Runs are looked up by their first and last window, which cover a run
    of at most k windows; longer runs are left.
    """
    late = np.zeros(len(at), bool)
    key = run_keys(hashes, at, n)
    code = rank if space.by_document else rank << np.int64(36) | start
    order = np.lexsort([code, key])
    new = np.ones(len(order), bool)
    new[1:] = key[order[1:]] != key[order[:-1]]
    head = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
    some = np.flatnonzero((code[order] > code[head]) & (n[order] <= space.k) & (n[order] == n[head]))
    if len(some):
        mine, theirs, size = order[some], head[some], n[order[some]] + space.k - 1
        equal = tokens[rows_of_runs(at[mine], size)] == tokens[rows_of_runs(at[theirs], size)]
        late[mine] = np.logical_and.reduceat(equal, np.cumsum(size) - size)
    return late


def hashed_groups(k: int) -> Callable:
    """Exact groups of equal windows: sort by hash, then compare every window with the first of its run."""

    def group(tokens: np.ndarray, at: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(hashes, kind="stable")
        new = np.ones(len(order), bool)
        new[1:] = hashes[order[1:]] != hashes[order[:-1]]
        head = at[order[np.flatnonzero(new)[np.cumsum(new) - 1]]]
        own, differs = at[order], np.zeros(len(order), bool)
        for j in range(k):
            differs |= tokens[own + j] != tokens[head + j]
        if differs.any():  # two contents with one hash: sort the rows of those runs by content
            run = np.cumsum(new) - 1
            bad = np.isin(run, run[differs])
            where = np.flatnonzero(bad)
            content = tokens[own[where][:, None] + np.arange(k)]
            keys = np.lexsort([*content.T[::-1], run[where]])
            order[where] = order[where][keys]
            content, runs = content[keys], run[where][keys]
            new[where[1:]] = (content[1:] != content[:-1]).any(1) | (runs[1:] != runs[:-1])
        return order, new

    return group


def packed_blocks(docs: DataFrame, space: Space, n_buckets: int) -> DataFrame:
    """Blocks (bucket, block) of docs (key, row_hash, text): packed super-k-mers and the spans settled already."""

    def flush(keys: list[int], hashes: list[int], texts: list[str], sent: Sent) -> Iterator[tuple[int, bytes]]:
        order = sorted({(k, h): i for i, (k, h) in enumerate(zip(keys, hashes))}.items())
        doc_keys = np.array([k for (k, _), _ in order], np.int64)
        doc_hashes = np.array([h for (_, h), _ in order], np.int64)
        codes, values, lengths, words = space.split([texts[i] for _, i in order])
        ends = np.cumsum(lengths)
        if len(codes) < space.k:
            return
        grams, windows = mix(window_hash(values, space.m)), window_hash(values, space.k)
        least = sliding_min(grams, space.k - space.m + 1)
        again, moved = repeated_minimisers(grams, least, space.k - space.m + 1)
        doc = np.repeat(np.arange(len(lengths)), lengths)[: len(least)]
        start = np.arange(len(least)) - (ends - lengths)[doc]
        breaks = np.ones(len(least), bool)
        breaks[1:] = (doc[1:] != doc[:-1]) | (least[1:] != least[:-1]) | again[1:] | again[:-1] | moved[1:]
        run_at, run_n = runs_of_flags(np.arange(len(least)) + space.k <= ends[doc], breaks)
        if not len(run_at):
            return
        rank = np.unique(doc_keys, return_inverse=True)[1] if space.by_document else np.arange(len(doc_keys))
        late = later_runs(space, codes, windows, run_at, run_n, rank[doc[run_at]], start[run_at])
        tokens_of = lambda i: codes[run_at[i] : run_at[i] + run_n[i] + space.k - 1]
        content = lambda i: tokens_of(i).tobytes() if words is None else b" ".join([words[c] for c in tokens_of(i)])
        owner = lambda i: (int(doc_keys[d := doc[run_at[i]]]), int(doc_hashes[d]), int(start[run_at[i]]))
        sent.settle(run_keys(windows, run_at, run_n), late, owner, content)
        span_at, span_n, run_at, run_n = run_at[late], run_n[late], run_at[~late], run_n[~late]
        if len(span_at):  # spans that follow one another are one
            first = np.flatnonzero(np.append(True, (span_at[1:] != span_at[:-1] + span_n[:-1]) | (doc[span_at[1:]] != doc[span_at[:-1]])))
            span_at, span_n = span_at[first], np.add.reduceat(span_n, first)
        bucket = (mix(np.where(again[run_at], windows[run_at], least[run_at])) % _U(n_buckets * SECTIONS)).astype(np.int64)
        by = np.argsort(bucket, kind="stable")
        run_at, run_n, bucket = run_at[by], run_n[by], bucket[by]
        edges = np.searchsorted(bucket, np.arange(n_buckets * SECTIONS + 1))
        span_bucket = doc[span_at] % n_buckets
        press = zstandard.ZstdCompressor(level=2)
        lut = np.zeros(len(words), np.int32) if words is not None else None
        for b in np.union1d(np.unique(bucket // SECTIONS), np.unique(span_bucket)):
            whole, names = slice(edges[b * SECTIONS], edges[(b + 1) * SECTIONS]), None
            packed = codes[rows_of_runs(run_at[whole], run_n[whole] + space.k - 1)]
            if words is not None:
                seen = np.zeros(len(words), bool)
                seen[packed] = True
                used = np.flatnonzero(seen)
                lut[used] = np.arange(len(used))
                packed = lut[packed].astype(np.uint16 if len(used) <= 1 << 16 else np.uint32)
                names = b" ".join([words[i] for i in used])
            s, sections = span_bucket == b, np.diff(edges[b * SECTIONS : (b + 1) * SECTIONS + 1])
            seen_docs, local = np.unique(np.concatenate([doc[run_at[whole]], doc[span_at[s]]]), return_inverse=True)
            n = whole.stop - whole.start
            fields = (_small(np.diff(doc_keys[seen_docs], prepend=0)), doc_hashes[seen_docs], _small(local[:n]), _small(start[run_at[whole]]), _small(run_n[whole]), _small(sections), packed, names, _small(local[n:]), _small(start[span_at[s]]), _small(span_n[s]))
            yield int(b), press.compress(pickle.dumps(fields, 5))

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, hashes, texts, size, sent = [], [], [], 0, Sent(space.by_document)

        def out() -> pa.RecordBatch:
            rows = list(flush(keys, hashes, texts, sent))
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["bucket", "block"])

        for batch in batches:
            for key, row_hash, text in zip(*(batch.column(i) for i in range(3))):
                keys.append(key.as_py())
                hashes.append(row_hash.as_py())
                texts.append(text.as_py())
                size += len(texts[-1])
                if size >= space.group_tokens:
                    yield out()
                    keys, hashes, texts, size = [], [], [], 0
        if texts:
            yield out()

    return docs.mapInArrow(run, BLOCK_SCHEMA)


def spans_of_blocks(blocks: DataFrame, space: Space) -> DataFrame:
    """Spans (key, row_hash, start, count) of later windows: ``count`` consecutive ones from window ``start`` on."""

    @lean
    def settle(table: pa.Table) -> pa.Table:
        press = zstandard.ZstdDecompressor()
        ids: dict[bytes, int] = {}
        keys, row_hashes, docs, starts, counts, splits, cuts, packed, n_docs = [], [], [], [], [], [], [], [], 0
        found: list[tuple[np.ndarray, ...]] = []
        for b in table.column("block"):
            key_steps, hashes, doc, start, count, sections, tokens, names, span_doc, span_at, span_n = pickle.loads(press.decompress(b.as_py()))
            keys.append(np.cumsum(key_steps.astype(np.int64)))
            row_hashes.append(hashes.astype(np.int64))
            found.append((keys[-1][span_doc], row_hashes[-1][span_doc], span_at.astype(np.int64), span_n.astype(np.int64)))
            docs.append(doc.astype(np.int64) + n_docs)
            n_docs += len(hashes)
            starts.append(start.astype(np.int64))
            counts.append(count.astype(np.int64))
            splits.append(np.concatenate(([0], np.cumsum(sections, dtype=np.int64))))
            cuts.append(np.concatenate(([0], np.cumsum(counts[-1] + space.k - 1)))[splits[-1]])
            if names is not None and len(tokens):
                tokens = np.array([ids.setdefault(w, len(ids)) for w in names.split(b" ")], np.int32)[tokens]
            packed.append(tokens)
        values = word_values(ids) if ids else byte_values()  # those that the minimisers were found with
        keys, row_hashes = np.concatenate(keys), np.concatenate(row_hashes)
        order = np.lexsort([row_hashes, keys])
        new = np.ones(len(order), bool)
        new[1:] = keys[order[1:]] != keys[order[:-1]]
        if not space.by_document:
            new[1:] |= row_hashes[order[1:]] != row_hashes[order[:-1]]
        rank = np.empty(len(order), np.int64)
        rank[order] = np.cumsum(new)
        for i in range(SECTIONS):
            part = [slice(s[i], s[i + 1]) for s in splits]
            count = np.concatenate([c[r] for c, r in zip(counts, part)])
            if not len(count):
                continue
            tokens = np.concatenate([p[c[i] : c[i + 1]] for p, c in zip(packed, cuts)])
            doc = np.concatenate([d[r] for d, r in zip(docs, part)])
            start = np.concatenate([s[r] for s, r in zip(starts, part)])
            # a run whose minimiser no other run has, and which has it once, holds nothing that repeats
            size = count + space.k - 1
            run_at = np.cumsum(size) - size
            grams = mix(window_hash(values[tokens], space.m))
            least = np.minimum.reduceat(np.append(grams, _U(0)), np.column_stack([run_at, run_at + size - space.m + 1]).ravel())[::2]
            kept = not_alone(least)
            if not space.by_document:
                padded = np.append(grams, np.zeros(len(tokens) - len(grams), _U))
                twice = np.add.reduceat((padded == np.repeat(least, size)).astype(np.int64), run_at) > 1
                kept = np.union1d(kept, np.flatnonzero(twice))
            if not len(kept):
                continue
            tokens = tokens[rows_of_runs(run_at[kept], size[kept])]
            doc, start, count, size = doc[kept], start[kept], count[kept], size[kept]
            run_at, windows = np.cumsum(size) - size, window_hash(values[tokens], space.k)
            # whole runs that equal an earlier one first, then the windows of the others
            late = later_runs(space, tokens, windows, run_at, count, rank[doc], start)
            found.append((keys[doc[late]], row_hashes[doc[late]], start[late], count[late]))
            doc, start, count, run_at = doc[~late], start[~late], count[~late], run_at[~late]
            at = rows_of_runs(run_at, count)
            begin = rows_of_runs(start, count)
            late = later_windows(space, tokens, mix(windows[at]), at, np.repeat(rank[doc], count), begin)
            head = np.zeros(len(at), bool)
            head[np.cumsum(count) - count] = True
            span_at, span_n = runs_of_flags(late, head)
            owner = np.repeat(doc, count)[span_at]
            found.append((keys[owner], row_hashes[owner], begin[span_at], span_n))
        return pa.table([pa.array(np.concatenate([f[i] for f in found]).astype(np.int64)) for i in range(4)], names=["key", "row_hash", "start", "count"])

    return blocks.groupBy("bucket").applyInArrow(settle, SPAN_SCHEMA)


def settled_spans(blocks: DataFrame, space: Space) -> DataFrame:
    """``spans_of_blocks``, written to the shared folder; the packed text on the executors' disks goes before more is moved."""
    with shuffle_cleanup(blocks.sparkSession):
        return stored(spans_of_blocks(blocks, space), "spans")


_BYTES: list[np.ndarray] = []


def word_values(words: Iterable[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), _U)


def byte_values() -> np.ndarray:
    if not _BYTES:
        _BYTES.append(mix(np.arange(1, 257, dtype=_U) * _U(_P)))
    return _BYTES[0]


def ids_repeat(docs: DataFrame) -> bool:
    """Does any doc_id, null included, stand in two rows. Only doc_id is read."""
    return not docs.groupBy("doc_id").count().where("count > 1").isEmpty()


def keyed(docs: DataFrame, hashed: bool = True) -> DataFrame:
    """doc_id, key, row_hash, text: null doc_id as the least key, null text as empty.

    Rows are told apart by key and a 64-bit hash of the text; where no id repeats, the hash may be left out (0), as it would only be moved.
    """
    bounded_batches(docs.sparkSession)
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_KEY)).alias("key"), (F.xxhash64(text) if hashed else F.lit(0).cast("long")).alias("row_hash"), text.alias("text"))


def bucket_count(docs: DataFrame, bytes_a_bucket: int, growth: float = 3.3) -> int:
    """As many buckets as keep the packed text of one near ``bytes_a_bucket``; growth: packed bytes for a byte of text."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(16, int(total * growth / bytes_a_bucket))


def with_spans(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """Rows of ``keyed`` with ``spans``, the array of (start, count) found for each, null if none."""
    own = spans.distinct().groupBy("key", "row_hash").agg(F.collect_list(F.struct("start", "count")).alias("spans"))
    return rows.join(own, ["key", "row_hash"], "left").select("doc_id", "text", "spans")


def spans_of(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Starts and counts of each row's spans; none for null."""
    offsets, flat = column.offsets.to_numpy(), column.values
    starts, counts = (flat.field(n).to_numpy() for n in ("start", "count"))
    for begin, end in zip(offsets[:-1], offsets[1:]):
        yield starts[begin:end], counts[begin:end]


def covered(n: int, starts: np.ndarray, counts: np.ndarray, k: int) -> np.ndarray:
    """Which of n tokens lie in a window of a span."""
    change = np.bincount(starts, minlength=n + 1) - np.bincount(np.minimum(n, starts + counts + k - 1), minlength=n + 1)
    return np.cumsum(change[:n]) > 0
