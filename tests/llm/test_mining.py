"""Hard negatives, importance resampling and min-max near-dedup: edge cases and larger random cases against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from tidebars.llm import bpe, hard_negatives, importance, jaccard, minhash, queries, tokens
from tidebars.llm.common import draw_bound, drawn

CLASH = ("block", "row", "rank", "score", "chunk", "anchor", "bucket", "place", "id", "tuple", "weight")
EMBEDDINGS = "vec_id long, embedding array<float>, label int"


def clashing(df):
    """With columns whose names the operators use inside."""
    return df.withColumns({c: F.lit(c) for c in CLASH})


def plain_negatives(rows, positives=5, negatives=10, low=30, high=90):
    sound = [(i, [math.floor(256 * float(np.float32(x))) for x in e], g) for i, e, g in rows if g is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)]
    last = lambda i: (i is None, i or 0)
    out = []
    for a, (ai, ae, ag) in enumerate(sound):
        if ai is None or ai % 100:
            continue
        scored = sorted(((-sum(x * y for x, y in zip(ae, e)), last(i), i, g, k) for k, (i, e, g) in enumerate(sound)), key=lambda t: t[:2])
        for s, _, p, _, _ in [t for t in scored if t[3] == ag and t[4] != a][:positives]:
            inside = [t for t in scored if t[3] != ag and low * -s <= 100 * -t[0] <= high * -s][:negatives]
            out += [(ai, p, r, t[2], -s, -t[0]) for r, t in enumerate(inside, 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("labels,dims", [(3, 7), (400, 40)])
def test_hard_negatives_against_plain_version(spark, monkeypatch, labels, dims):
    r = random.Random(labels)
    monkeypatch.setattr(hard_negatives, "BLOCK_ROWS", 64)
    monkeypatch.setattr(hard_negatives, "BLOCK_ANCHORS", 3)
    monkeypatch.setattr(hard_negatives, "PACK_ROWS", 200)
    vector = lambda: [r.choice([-0.5, 0.25, 0.5, 1.0, r.random()]) for _ in range(dims)]
    rows = [(i * 20, vector(), r.randrange(labels)) for i in range(300)] + [(i, [1.0] * dims, r.randrange(labels)) for i in range(100, 900, 50)]
    rows += [(100, vector(), 0), (100, vector(), 1), (None, vector(), 1), (None, [1.0] * dims, 0), (1, None, 1), (2, vector(), None), (3, [None] * dims, 1), (4, [float("nan")] * dims, 1)]
    rows += [(5, [float("inf")] * dims, 1), (6, [], 1), (200, [1.0], 2), (300, [], 0)]
    df = clashing(spark.createDataFrame(rows, EMBEDDINGS)).repartition(5)
    found = hard_negatives.hard_negatives(df)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, found.collect()), key=str) == plain_negatives(rows)


def test_large_components_stay_exact(spark):
    rows = [(0, [4000.0, -0.001], 1), (1, [4000.0, 0.5], 1), (2, [2000.0, 1.0], 2), (3, [3.0e38, -3.0e38], 2), (7, [0.0, 0.0], 1)]
    found = hard_negatives.hard_negatives(spark.createDataFrame(rows[:3], EMBEDDINGS)).collect()
    assert sorted(map(tuple, found), key=str) == plain_negatives(rows[:3])
    assert hard_negatives.hard_negatives(spark.createDataFrame(rows, EMBEDDINGS)).count() == 1  # beyond the bound, held at it
    assert hard_negatives.hard_negatives(spark.createDataFrame([], EMBEDDINGS)).collect() == []


def plain_resample(docs, target, most, buckets, percent):
    low = lambda t: "".join(c.lower() if c.isascii() else c for c in t or "")
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
    features = lambda w: [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, most + 1) for i in range(len(w) - n + 1)]
    own, s, t = [(i, words(x), features(words(x))) for i, x in docs], Counter(), Counter()
    for _, _, f in own:
        s.update(f)
    for x in target:
        t.update(features(words(x)))
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (sum(s.values()) + buckets) / ((s[b] + 1) * (sum(t.values()) + buckets)))) for b in s}
    out = []
    for i, w, f in own:
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(w)])
    enough = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is not None, r[0] or 0, r[1]))
    for k, r in enumerate(enough[: percent * len(enough) // 100], 1):
        r[4] = k
    return sorted((tuple(r[:5]) for r in out), key=str)


@pytest.mark.parametrize("most", [1, 3])
def test_resampling_against_plain_version(spark, monkeypatch, most):
    monkeypatch.setattr(importance, "GROUP_CHARS", 700)
    monkeypatch.setattr(importance, "BLOCK_CHARS", 2_000)
    r = random.Random(most)
    vocabulary = [f"w{i}" for i in range(60)] + ["Über", "naïve", "日本", "A1b2"]
    text = lambda n: r.choice([" ", ", ", "-"]).join(r.choice(vocabulary) for _ in range(n))
    docs = [(i, text(r.randrange(60))) for i in range(150)]
    docs += [(500, None), (501, ""), (502, " ,.;"), (503, "same " * 40), (503, "same " * 40), (504, "same " * 40), (None, text(50)), (None, None), (505, text(20_000)), (3, text(30))]
    target = [text(30), None, "", "w1 w2 w3 über"]
    df = clashing(spark.createDataFrame(docs, "doc_id long, text string")).repartition(4)
    wanted = clashing(spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id int, text string"))
    found = importance.resampled(df, wanted, most, 1_000, 30)
    assert found.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, found.collect()), key=str) == plain_resample(docs, target, most, 1_000, 30)


def test_resampling_of_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b c " * 10), (2, None)], "doc_id long, text string")
    assert importance.resampled(none, some).collect() == []
    assert sorted(map(tuple, importance.resampled(some, none, 1, 100, 100).collect())) == plain_resample([(1, "a b c " * 10), (2, None)], [], 1, 100, 100)
    assert importance.resample(clashing(some), some, 100).columns == [*some.columns, *CLASH]
    assert importance.resampled(none, none).collect() == []


def test_ranks_run_over_all_ranges(spark):
    rows = spark.range(1_000).select(F.pmod(F.xxhash64("id"), F.lit(50)).alias("v"), "id").repartition(7)
    found = importance.ranked(rows, [F.col("v").desc(), F.col("id")]).collect()
    assert [r["rank"] for r in sorted(found, key=lambda r: (-r["v"], r["id"]))] == list(range(1, 1_001))


def near_copies(r, sizes, changes):
    """Texts with copies of which each differs in a few words."""
    out = []
    for size in sizes:
        base = [f"v{r.randrange(5_000)}" for _ in range(size)]
        for _ in range(6):
            w = list(base)
            for _ in range(r.randrange(changes + 1)):
                w[r.randrange(size)] = f"x{r.randrange(50)}"
            out.append(" ".join(w))
    return out


@pytest.mark.parametrize("n", [2, 5])
def test_near_copies_against_plain_version(spark, n):
    r = random.Random(n)
    texts = near_copies(r, [2, 3, 5, 8, 12, 20, 30, 50, 80, 200, 400], 6) + ["", "  ", "word", "Word", "word word", LONG := "a b c d " * 5_000, LONG.upper(), "hot line of words " * 3] + ["hot line of words " * 3] * 40
    rows = list(enumerate(texts))
    df = clashing(spark.createDataFrame(rows, "doc_id long, text string")).repartition(5)
    found = {x["doc_id"]: (x["n_shingles"], x["component_id"], x["kept"]) for x in minhash.minhash_dedup(df, n, 80).collect()}
    assert found == {i: (size, root, root == i) for i, (size, root, _) in brute.jaccard(rows, n, 80).items()}
    kept = minhash.without_minhash_copies(df, n, 80)
    assert kept.columns == df.columns and {x["doc_id"] for x in kept.collect()} == {i for i, v in found.items() if v[2]}


def test_nulls_and_repeated_ids_near_copies(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (1, "other words of one id"), (None, "a b c d e f"), (None, "no id has these"), (2, None), (None, None)]
    found = sorted(map(tuple, minhash.minhash_dedup(spark.createDataFrame(rows, "doc_id long, text string"), 2, 80).collect()), key=str)
    assert found == sorted([(1, 5, 1, True), (1, 5, 1, True), (1, 4, 1, True), (None, 5, 1, False), (None, 3, None, True), (2, 0, 2, True), (None, 0, None, True)], key=str)
    assert minhash.minhash_dedup(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_bands_find_borderline_pairs_and_values_estimate_similarity():
    r, sign = np.random.default_rng(1), minhash.band_signer(80)
    missed, agree = 0, []
    seeds = jaccard.mix(np.arange(1, 401, dtype=np.uint64))
    for _ in range(300):
        common, own = r.integers(0, 1 << 63, 40, dtype=np.uint64), r.integers(0, 1 << 63, 10, dtype=np.uint64)
        a, b = jaccard.mix(np.concatenate([common, own[:5]])), jaccard.mix(np.concatenate([common, own[5:]]))
        missed += not len(np.intersect1d(sign(a), sign(b)))
        x, y = (np.concatenate(minhash.min_max(s, seeds[:200] | np.uint64(1), seeds[200:])) for s in (a, b))
        agree.append((x == y).mean())
    assert missed == 0
    assert abs(np.mean(agree) - 0.8) < 0.01 and np.std(agree) < 1.1 * math.sqrt(0.8 * 0.2 / 400)


@pytest.fixture(scope="module")
def raw_tokenizer():
    with open(queries.tokenizer_path(), encoding="utf-8") as f:
        return f.read()


def test_caches_are_bounded_in_bytes_and_change_no_ids(raw_tokenizer):
    from tokenizers import Tokenizer

    library, v, r = Tokenizer.from_str(raw_tokenizer), bpe.Vocabulary(raw_tokenizer), random.Random(3)
    for known, most in ((v.words, 40_000), (v.first, 10_000), (v.later, 40_000)):
        known.most = most
    unspaced = lambda: "".join(chr(0x4E00 + r.randrange(900)) for _ in range(400))
    coded = lambda: "".join(r.choice("ABCDEFabcdef0123456789+/") for _ in range(500))
    spaced = lambda: " ".join(f"w{r.randrange(10**6)}x" for _ in range(40))
    held = []
    for _ in range(12):
        texts = [f() for _ in range(4) for f in (unspaced, coded, spaced)]
        assert list(v.encode_all(texts)) == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
        for t in texts[:3]:
            assert tokens.text_prefix_counts(v, t)[-1] == len(library.encode(t, add_special_tokens=False).ids)
        known = [k for c in (v.words, v.first, v.later) for k in c]
        assert max(map(len, known)) <= bpe.LONG and not any(c.passing for c in (v.words, v.first, v.later))
        held.append(sum(200 + 8 * len(k) for k in known))
    assert max(held) < 300_000 and max(held[6:]) < 1.5 * max(held[:6])


def test_shares_of_any_size_are_drawn(spark):
    rows = spark.range(200_000)
    assert common_drawn(rows, 1.0) == 200_000 and common_drawn(rows, 7.0) == 200_000 and common_drawn(rows, 0.0) == 0
    assert abs(common_drawn(rows, 0.01) - 2_000) < 200
    # far below a millionth, the bound still lies at that share of all hashes
    for share in (1e-7, 1e-10, 1e-13):
        assert abs((draw_bound(share) + 2**63) / 2**64 - share) < 1e-3 * share


def common_drawn(rows, share):
    return rows.where(drawn(share, "id")).count()


@pytest.mark.parametrize("percent", [80, 90])
def test_linked_sets_always_share_a_partenum_signature(percent):
    r = np.random.default_rng(percent)
    tried = 0
    for _ in range(6_000):
        union = r.integers(0, 1 << 63, int(r.integers(1, 70)), dtype=np.uint64)
        extra = int(r.integers(0, len(union) * (100 - percent) // 100 + 1))  # as many apart as a link allows
        first = int(r.integers(0, extra + 1))
        a, b = np.unique(union[extra - first :]) if first < extra else np.unique(union), np.unique(np.concatenate([union[:extra - first], union[extra:]]))
        common = len(np.intersect1d(a, b))
        if not common or 100 * common < percent * (len(a) + len(b) - common):
            continue
        tried += 1
        assert len(np.intersect1d(jaccard.signatures(a, percent), jaccard.signatures(b, percent)))
    assert tried > 4_000


@pytest.mark.parametrize("percent", [50, 80, 90])
def test_linked_sets_share_a_signature_whatever_is_common(percent):
    r = np.random.default_rng(percent)
    for size in (2, 4, 9, 20, 60, 140, 170, 260, 330, 700):
        for share in (0.0, 0.3, 0.9, 1.0):
            for _ in range(25):
                union = r.integers(0, 1 << 63, size, dtype=np.uint64)
                common = np.sort(union[r.random(size) < share])
                extra = size * (100 - percent) // 100  # as many apart as a link allows
                first = int(r.integers(0, extra + 1))
                a, b = np.unique(union[first:]), np.unique(np.concatenate([union[:first], union[extra:]]))
                assert len(np.intersect1d(jaccard.signatures(a, percent, common), jaccard.signatures(b, percent, common)))


def test_unrelated_texts_with_a_line_in_common_are_no_candidates(spark, monkeypatch):
    r, met, components = np.random.default_rng(8), {}, jaccard.components
    line = " ".join(f"licence{i}" for i in range(12))
    rows = [(i, " ".join([line, *(f"w{x}" for x in r.integers(0, 1 << 40, 20 + i % 50))])) for i in range(600)]
    rows.append((1_000, rows[40][1] + " end"))

    def seen(edges, label):
        met[label] = edges.count()
        return components(edges, label)

    monkeypatch.setattr(jaccard, "components", seen)
    found = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {i: i if i < 1_000 else 40 for i, _ in rows}
    assert met["jaccard-candidates"] == 1


def test_unrelated_small_sets_share_no_signature():
    r = np.random.default_rng(5)
    for size in (1, 2, 3, 4, 6, 8, 15):
        sets = [np.unique(r.integers(0, 1 << 63, size, dtype=np.uint64)) for _ in range(3_000)]
        found = np.concatenate([np.unique(jaccard.signatures(s, 80)) for s in sets])
        assert len(np.unique(found)) == len(found)
