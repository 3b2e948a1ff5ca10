"""The text operators against brute force, the tokenizers library, round trips and held-out rows."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from tidebars.llm import bpe, decontaminate, jaccard, queries, substring_dedup, suffix_dedup, superkmers, token_store, tokens, toxicity, url_filter
from tidebars.llm.common import components, spread_join, with_group_totals
from tidebars.llm.exact_dedup import chunks, exact_dedup

PATH = queries.tokenizer_path()
LONG = " ".join(f"w{i % 701}" for i in range(30_000))
EDGE = [(1, None), (2, ""), (3, "  "), (4, "a b c"), (5, "A  b C"), (6, LONG), (7, LONG.upper()), (8, "é É ß 日本語。テキスト <|endoftext|> x"), (9, "word " * 60), (10, "x" * 5_000)]


def frame(spark, rows):
    """Rows with columns whose names the operators use inside."""
    df = spark.createDataFrame(rows, "doc_id long, text string")
    clash = {c: F.lit(c) for c in ("key", "row_hash", "spans", "recipe", "set_id", "component", "block", "score", "_salt", "signature")}
    return df.withColumns(clash | {"value": F.lit(1)})


def documents(spark, path):
    df = spark.read.parquet(f"{path}/documents.parquet")
    return df, [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def got(df):
    return {r[0]: tuple(r[1:]) for r in df.collect()}


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module", params=["tiny", "edge"])
def data(request, spark, tiny):
    if request.param == "tiny":
        return documents(spark, tiny)
    return frame(spark, EDGE), EDGE


def test_token_counts_and_prefixes(data, library):
    df, rows = data
    want = {i: len(library.encode(t or "", add_special_tokens=False).ids) for i, t in rows}
    found = {r["doc_id"]: r for r in tokens.prefix_token_counts(df, PATH, keep_counts=True).collect()}
    for i, t in rows:
        r, size = found[i], len((t or "").encode())
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (size, want[i], want[i] > 512)
        assert len(r["prefix_counts"]) == size + 1 and r["prefix_counts"][-1] == want[i]
        assert r["prefix_counts"][r["bytes_within_limit"]] <= 512
        data = (t or "").encode()
        cut = [len(data[:k].decode("utf-8", "ignore").encode()) for k in range(1024, size + 1, 1024)]
        assert list(r["tokens_by_kib"]) == [r["prefix_counts"][k] for k in cut]


def test_prefix_counts_of_one_word_equal_encodings_of_its_prefixes(library):
    with open(PATH, encoding="utf-8") as f:
        v = bpe.Vocabulary(f.read())
    for word in (" understandable", "thereupon", " tionshing", "Übergrößen"):
        counts = tokens.text_prefix_counts(v, word)
        for n in range(1, len(word) + 1):
            assert counts[len(word[:n].encode())] == len(library.encode(word[:n], add_special_tokens=False).ids)


def test_every_prefix_counts_as_a_text_of_its_own(library, tiny):
    import pyarrow.parquet as pq

    with open(PATH, encoding="utf-8") as f:
        v = bpe.Vocabulary(f.read())
    texts = [t for t in pq.read_table(f"{tiny}/documents.parquet", columns=["text"]).column(0).to_pylist() if t]
    texts = ["a\n\n\n\nb  c", "  x   y\t\t z  ", "we're they've it'll'llx 're", "end<|endoftext|>!<|endoftext|><|endo", "é  日本\u3000\u3000語 ß'veü", "\n\n", " " * 40 + "q", *[t[:700] for t in texts[:12]], *[t[-300:] for t in texts[12:20]]]
    for text in texts:
        counts, at = tokens.text_prefix_counts(v, text), 0
        for n in range(len(text) + 1):
            at = len(text[:n].encode())
            assert counts[at] == len(library.encode(text[:n], add_special_tokens=False).ids), (text[:n], n)


def test_encoding_and_decoding(data, library):
    df, rows = data
    found = {r["doc_id"]: list(r["ids"]) for r in tokens.bpe_encode(df, PATH).collect()}
    trips = {r["doc_id"]: r for r in tokens.bpe_round_trip(df, PATH, keep_text=True).collect()}
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert found[i] == ids
        text = library.decode(ids, skip_special_tokens=False)
        assert (trips[i]["n_tokens"], trips[i]["decoded"]) == (len(ids), text)
        assert trips[i]["ids_sha256"] == brute.sha(",".join(map(str, ids))) and trips[i]["decoded_sha256"] == brute.sha(text)


def test_token_store(data, library):
    df, rows = data
    found, start = got(token_store.store_and_read(df, PATH)), 0
    for i, t in sorted(rows):
        ids = library.encode(t or "", add_special_tokens=False).ids + [0]
        assert found[i] == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_perfect_hash_is_minimal_and_rejects_strangers():
    doc, copy = np.arange(5_000) * 7 - 900, np.zeros(5_000, np.int64)
    sizes, bits, before, slot = token_store.build_index(doc, copy)
    assert sorted(slot) == list(range(5_000)) and (token_store.find_slots(doc, copy, sizes, bits, before) == slot).all()
    prints = token_store._print_of(doc, copy)[np.argsort(slot)]
    at = token_store.find_slots(doc, copy + 1, sizes, bits, before)
    assert ((at < 0) | (prints[np.maximum(at, 0)] != token_store._print_of(doc, copy + 1))).all()
    with pytest.raises(ValueError):
        token_store.build_index(np.zeros(2, np.int64), np.zeros(2, np.int64))


def test_stored_ids_are_read_by_key(spark):
    rows = EDGE + [(i, f"text number {i}") for i in range(100, 400)]
    store = token_store.write_store(frame(spark, rows).repartition(6), PATH)
    few = store.read(spark.createDataFrame([(4, 0), (99, 0), (250, 0)], "doc_id long, copy long"))
    assert sorted((r["key"], np.frombuffer(r["ids"], "<u4")[-1]) for r in few.collect()) == [(4, 0), (250, 0)]
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(shard" in plan or "PartitionFilters: [shard" in plan  # one directory for each shard that is asked for
    assert any("payload" in scan and "part" in scan and "block" in scan for scan in plan.split("PushedFilters: ")[1:])  # and of the payload its buckets and blocks
    many = store.read(spark.createDataFrame([(i, 0) for i, _ in rows], "doc_id long, copy long"))
    assert many.count() == len(rows)
    index = store.index().count()
    store.drop()
    assert index >= 1 and not spark.catalog.tableExists(store.blocks_table)


def test_substring_dedup(data):
    df, rows = data
    assert got(substring_dedup.substring_dedup(df)) == brute.substring(rows)


def test_suffix_dedup(data):
    df, rows = data
    assert got(suffix_dedup.suffix_dedup(df)) == brute.suffix(rows)


def periodic_rows():
    rng, rows = np.random.default_rng(6), []
    for i in range(60):
        unit = ["-", "=-", "ab c", "word ", "".join(map(chr, 97 + rng.integers(0, 26, 39))) if i % 2 else "the period is as long as a window. it is."][i % 5]
        rows.append((i, f"start{i} " + unit * int(rng.integers(20, 90)) + f" end{i} " + "dull " * int(rng.integers(10, 70))))
    return rows


def test_periodic_text_is_deduplicated(spark):
    rows = periodic_rows()
    assert got(suffix_dedup.suffix_dedup(frame(spark, rows))) == brute.suffix(rows)
    assert got(substring_dedup.substring_dedup(frame(spark, rows))) == brute.substring(rows)


@pytest.mark.parametrize("space,line", [(suffix_dedup.byte_space(50, 12), "-" * 200), (substring_dedup.word_space(20, 3), "dull " * 70)])
def test_copies_of_a_periodic_line_are_settled_before_the_shuffle(spark, space, line, monkeypatch):
    import pickle

    import zstandard

    def sent(n):
        rows = [(i, i, line) for i in range(n)]
        blocks = superkmers.packed_blocks(spark.createDataFrame(rows, "key long, row_hash long, text string").coalesce(1), space, 16).collect()
        return sum(int(pickle.loads(zstandard.ZstdDecompressor().decompress(bytes(b["block"])))[4].sum()) for b in blocks)

    assert 0 < sent(1) and sent(200) == sent(1)
    monkeypatch.setattr(space, "group_tokens", 300)  # many batches in one task
    assert sent(200) <= 3 * sent(1)


def test_runs_met_in_other_batches_are_settled_rightly(spark):
    rng = np.random.default_rng(3)
    lines = [" ".join(f"w{x}" for x in rng.integers(0, 300, 40)) for _ in range(6)]
    rows = [(int(i), " ".join(str(rng.choice(lines)) if rng.random() < 0.6 else f"own{i} text{j} " * 4 for j in range(5))) for i in rng.permutation(150)]
    rows += [(None, lines[0]), (None, lines[0] + " x"), (7, lines[1])]
    for space, op, plain in ((suffix_dedup.byte_space(50, 12), suffix_dedup, brute.suffix), (substring_dedup.word_space(20, 3), substring_dedup, brute.substring)):
        known = [r for r in rows if r[0] is not None][:150]
        name = "byte_space" if op is suffix_dedup else "word_space"
        make, space.group_tokens = getattr(op, name), 2_000
        setattr(op, name, lambda *_: space)
        try:
            run = op.suffix_dedup if op is suffix_dedup else op.substring_dedup
            assert got(run(frame(spark, known).coalesce(2))) == plain(known)
            assert run(frame(spark, rows).coalesce(2)).count() == len(rows)
        finally:
            setattr(op, name, make)


def test_windows_with_a_repeated_minimiser():
    rng = np.random.default_rng(8)
    for w in (2, 5, 9):
        for size in (2, 3, 30):
            grams = rng.integers(1, size + 1, 300).astype(np.uint64)
            least = superkmers.sliding_min(grams, w)
            again, moved = superkmers.repeated_minimisers(grams, least, w)
            places = [np.flatnonzero(grams[s : s + w] == least[s]) + s for s in range(len(least))]
            assert again.tolist() == [len(p) > 1 for p in places]
            for s in range(1, len(least)):
                if len(places[s]) == len(places[s - 1]) == 1 and least[s] == least[s - 1]:
                    assert moved[s] == (places[s][0] != places[s - 1][0])


def test_suffix_order_is_lexicographic():
    rng = np.random.default_rng(5)
    for n in (60, 200, 900):
        text = rng.integers(0, 2, n).astype(np.uint8)
        at = np.sort(rng.choice(n - 50, (n - 50) // 2, replace=False))
        order = suffix_dedup.suffix_order(text, at, 50)
        strings = [text[p : p + 50].tobytes() for p in order]
        assert strings == sorted(strings) and sorted(order) == list(at)


def test_equal_hashes_of_different_windows_are_told_apart():
    text = np.array([0, 1, 2, 0, 1, 3, 0, 1, 2, 9, 9, 9], np.int32)
    order, new = superkmers.hashed_groups(3)(text, np.array([0, 3, 6]), np.zeros(3, np.uint64))
    groups = np.cumsum(new)
    assert {frozenset(order[groups == g].tolist()) for g in set(groups)} == {frozenset({0, 2}), frozenset({1})}


def test_exact_dedup(data):
    df, rows = data
    assert {i: v[:4] for i, v in got(exact_dedup(df)).items()} == brute.copies(rows)


def test_chunks_concatenate_to_the_text(data):
    df, _ = data
    assert df.where(F.concat_ws("", chunks(F.col("text"))) != F.col("text")).count() == 0


@pytest.mark.parametrize("n,percent", [(3, 90), (5, 80)])
def test_jaccard_components(data, n, percent):
    df, rows = data
    assert got(jaccard.jaccard_components(df, n, percent)) == brute.jaccard(rows, n, percent)


def test_jaccard_of_a_large_cluster_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(3)
    base = [f"t{i}" for i in range(120)]
    rows = []
    for i in range(80):
        words = list(base)
        for p in rng.choice(120, rng.integers(0, 9), replace=False):
            words[p] = f"z{rng.integers(0, 40)}"
        rows.append((i, " ".join(words[: 120 - i % 40])))  # sizes over several bands
    want = brute.jaccard(rows, 3, 90)
    df = frame(spark, rows)
    assert got(jaccard.jaccard_components(df, 3, 90)) == want
    for most in (2_000, 300):
        monkeypatch.setattr(jaccard, "BLOCK_ELEMENTS", most)
        assert got(jaccard.jaccard_components(df, 3, 90)) == want


def test_signatures_meet_for_every_linked_pair():
    rng = np.random.default_rng(7)
    for percent in (80, 90):
        for size in (1, 5, 12, 18, 30, 90, 400, 20_000):
            for _ in range(20 if size < 1_000 else 1):
                a = np.unique(superkmers.mix(rng.integers(0, 1 << 60, size).astype(np.uint64)))
                drop = rng.integers(0, max(1, size * (100 - percent) // 100 + 1))
                b = np.unique(a[drop:])
                if 100 * len(b) >= percent * len(a):
                    assert np.intersect1d(jaccard.signatures(a, percent), jaccard.signatures(b, percent)).size


def test_decontamination_finds_leaks_and_paraphrases(spark, tiny):
    docs, rows = documents(spark, tiny)
    benchmark = spark.read.parquet(f"{tiny}/benchmark.parquet")
    items = [(r["item_id"], r["text"]) for r in benchmark.collect()]
    want = {(d, i) for d, t in rows for i, x in items if f" {' '.join(w.decode() for w in decontaminate.words_of(x))} " in f" {' '.join(w.decode() for w in decontaminate.words_of(t))} "}
    long = [x for x in items if len(x[1].split()) > 25][0]
    words = long[1].split()
    words[5:6] = ["entirely", "different"]
    planted = frame(spark, [(10**6, "some words before. " * 9 + " ".join(words) + " and after" * 9), (10**6 + 1, None), (10**6 + 2, "")])
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs.select("doc_id", "text").unionByName(planted.select("doc_id", "text")), benchmark).collect()}
    assert found == want | {(10**6, long[0])}
    kept = decontaminate.without_contaminated(docs, benchmark)
    assert kept.columns == docs.columns and kept.count() == len(rows) - len({d for d, _ in want})


def test_verbatim_items_of_any_length_are_found_in_a_large_corpus(spark, monkeypatch):
    rng, counted = np.random.default_rng(4), decontaminate._frequencies
    # as if every document stood there a million times
    monkeypatch.setattr(decontaminate, "_frequencies", lambda docs, code: tuple(x * 10**6 for x in counted(docs, code)))
    common, words = [f"c{i}" for i in range(40)], lambda k, stem: [f"{stem}{i}" for i in rng.integers(0, 5_000, k)]
    items = [(0, " ".join(words(300, "rare")))] + [(n, " ".join(rng.choice(common, n, replace=False))) for n in (2, 4, 7, 8, 9, 12, 16, 24)] + [(99, "never seen anywhere")]
    filler = [(i, " ".join([*rng.choice(common, 30), *words(60, "x")])) for i in range(100)]
    planted = [(1_000 + i, " ".join([*words(37, "y"), x, *words(41, "y")])) for i, x in items[:-1]]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(frame(spark, filler + planted), benchmark).collect()}
    assert {(1_000 + i, i) for i, _ in items[:-1]} <= found
    kept = {r["doc_id"] for r in decontaminate.without_contaminated(frame(spark, planted), benchmark).collect()}
    assert not kept


def test_decontamination_without_items_or_documents(spark):
    docs, none = frame(spark, EDGE), spark.createDataFrame([(1, None)], "item_id long, text string")
    assert decontaminate.contaminated(docs, none).count() == 0 and decontaminate.without_contaminated(docs, none).count() == len(EDGE)
    assert decontaminate.contaminated(docs.limit(0), spark.createDataFrame([(1, "a b c")], "item_id long, text string")).count() == 0


def test_common_length():
    def plain(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    rng = np.random.default_rng(2)
    for _ in range(50):
        a, b = ([bytes([x]) for x in rng.integers(97, 102, rng.integers(1, 40))] for _ in range(2))
        assert decontaminate.common_length(decontaminate.masks_of(a), len(a), b) == plain(a, b)


def test_toxicity_on_held_out_rows(spark, small):
    docs, labels = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet")
    rows = toxicity.toxicity(docs, labels)
    assert rows.where("score < 0 OR score > 1 OR score IS NULL").count() == 0 and rows.count() == docs.count()
    judged = rows.where("held_out").join(labels, "doc_id").collect()
    right = sum(r["predicted"] == r["toxic"] for r in judged)
    assert right >= 0.9 * len(judged)
    lexicon = toxicity.learn(docs, labels)
    score = toxicity.scorer(lexicon)
    planted = spark.createDataFrame([("You are an 1d!0t and a m0rоn",), ("a worthless loser, truly",), ("the sun is warm and the path is long",), (None,)], "text string")
    assert [r[0] >= 0.5 for r in planted.select(score(F.col("text"))).collect()] == [True, True, False, False]


def test_toxicity_without_labels_and_edges(spark):
    labels = spark.createDataFrame([(1, None), (2, 1)], "doc_id long, toxic int")
    rows = toxicity.toxicity(frame(spark, EDGE + [(None, "x"), (4, "a b c")]), labels.limit(0)).collect()
    assert len(rows) == len(EDGE) + 2 and all(r["predicted"] == 0 for r in rows)


def test_scores_equal_a_plain_count_of_terms(spark, small):
    docs, rows = documents(spark, small)
    labels = spark.read.parquet(f"{small}/labels.parquet")
    lexicon = toxicity.learn(docs, labels)
    assert lexicon.weights
    c, a, b = lexicon.curve
    found = {r["doc_id"]: r for r in toxicity.toxicity(docs, labels).collect()}
    for i, text in rows:
        folded = toxicity.fold(text or "")
        if len(folded) > 3_000:
            continue
        total = max(0.0, sum(w * sum(folded.startswith(term, at) for at in range(len(folded))) for term, w in lexicon.weights.items() if term in folded))
        score = 1 / (1 + np.exp(-np.clip(c + a * np.log1p(total) + b * np.log1p(100 * total / max(1, folded.count(" ") - 1)), -30, 30)))
        assert abs(found[i]["score"] - score) < 1e-9 and found[i]["predicted"] == int(score >= 0.5)
        assert found[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)


def test_lexicon_weights_are_log_odds_of_the_training_rows(spark, small):
    docs, rows = documents(spark, small)
    labels = spark.read.parquet(f"{small}/labels.parquet")
    toxic = {r["doc_id"]: r["toxic"] for r in labels.collect() if r["toxic"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5}
    terms = {i: toxicity._terms(toxicity.fold(t or "")) for i, t in rows if i in toxic}
    n = [sum(toxic[i] == y for i in terms) for y in (0, 1)]
    weights = toxicity.learn(docs, labels).weights
    words = [t for t in weights if " " not in t.strip()]
    assert words
    for term in words:
        k = [sum(term in ts for i, ts in terms.items() if toxic[i] == y) for y in (0, 1)]
        assert k[1] >= toxicity.MIN_DOCS and abs(weights[term] - (np.log((k[1] + 0.5) / (n[1] + 1)) - np.log((k[0] + 0.5) / (n[0] + 1)))) < 1e-9


def test_exception_phrases_take_weight_back():
    lexicon = toxicity.Lexicon({" idiot ": 5.0, " such idiot ": -5.0}, (-2.0, 2.0, 0.0))
    m = lexicon.matcher()
    assert lexicon.features(toxicity.fold("such idiot"), m)[0] == 0 and lexicon.features(toxicity.fold("an idiot"), m)[0] > 0


def test_url_parts_rules_and_purity(spark):
    urls = [None, "nohost", "HTTP://A.Example.NET/en/x?y", "http://x.net", "http://x.net?a://b/c", "x://Ünet/é#f", "x://y.org/fr/", "x://y.org/fr/", "http://q.example.com/de/1"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumns({c: F.lit("z") for c in ("host", "path", "rule", "template", "salt")})
    rows = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.url_verdicts(df).collect()}
    assert rows == {
        0: ("", "", None, "allow"), 1: ("", "", None, "allow"), 2: ("a.example.net", "/en/x", "example.net/en/", "allow"), 3: ("x.net", "", None, "allow"), 4: ("x.net", "", None, "allow"),
        5: ("Ünet", "/é", None, "allow"), 6: ("y.org", "/fr/", "org/fr/", "allow"), 7: ("y.org", "/fr/", "org/fr/", "allow"), 8: ("q.example.com", "/de/1", "example.com/de/", "block"),
    }
    assert url_filter.url_verdicts(df.limit(0)).count() == 0


def test_pages_against_plain_rules(spark, small):
    pages = spark.read.parquet(f"{small}/pages.parquet")
    found = {r["page_id"]: r for r in url_filter.url_verdicts(pages).collect()}
    for r in pages.select("page_id", "url").collect():
        rest = r["url"].split("://", 1)[1]
        host = rest.split("/")[0].split("?")[0].split("#")[0].lower()
        path = rest[len(host) :].split("?")[0].split("#")[0]
        fits = [(len(h + p), h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule, verdict = max(fits)[1:] if fits else (None, None)
        f = found[r["page_id"]]
        assert (f["host"], f["path"], f["rule"]) == (host, path, rule)
        # without a rule the tree decides, by labels of the host's own pages: none are blocked where rules block none
        assert f["verdict"] == (verdict or ("block" if f["purity"] >= url_filter.PURITY else "allow"))
        assert verdict or f["verdict"] == "allow" or host.endswith("example.com")


def planted_urls():
    """(url, should the tree block it) of a host with spam templates, of which the rules know one in five, and of ordinary pages beside them."""
    rng = np.random.default_rng(9)
    word = lambda: "".join(map(chr, 97 + rng.integers(0, 26, 9)))
    rows = [(f"http://shop.test/win/{word()}/deal-{i}", i % 5 != 0) for i in range(200)]  # open segment, then a number
    rows += [(f"http://shop.test/about/{w}", False) for w in ("us", "press", "jobs") for _ in range(30)]
    rows += [(f"http://other.test/win/{word()}/deal-{i}", False) for i in range(50)]  # no labels in this host
    return rows, [("block", "shop.test", f"/win/{u.split('/')[4]}") for u, tree in rows if "shop" in u and "win" in u and not tree]


def test_unruled_pages_of_spam_templates_are_blocked(spark):
    rows, rules = planted_urls()
    df = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(rows)], "page_id long, url string")
    found = {r["page_id"]: r for r in url_filter.url_verdicts(df, rules).collect()}
    for i, (u, tree) in enumerate(rows):
        ruled = "shop" in u and "win" in u and not tree
        assert (found[i]["rule"] is not None) == ruled and found[i]["verdict"] == ("block" if tree or ruled else "allow")
    assert len({tuple(found[i]["template"]) for i, (u, _) in enumerate(rows) if "shop.test/win" in u}) == 1


def test_branches_that_differ_in_labels_or_shape_stay_apart(spark):
    urls = [f"http://h.test/a/{i}" for i in range(40)] + [f"http://h.test/b/{i}" for i in range(40)] + [f"http://h.test/c/{i}/deep/er" for i in range(40)]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rules = [("block", "h.test", "/a/"), ("allow", "h.test", "/b/")]
    found = [r["verdict"] for r in url_filter.url_verdicts(df, rules).orderBy("page_id").collect()]
    assert found == ["block"] * 40 + ["allow"] * 80
    one = [r["verdict"] for r in url_filter.url_verdicts(df.where("page_id < 80"), rules[:1]).orderBy("page_id").collect()]
    assert one == ["block"] * 80  # alike in shape, and no label says otherwise


@pytest.mark.parametrize("f", [lambda d: exact_dedup(d), lambda d: substring_dedup.substring_dedup(d), lambda d: suffix_dedup.suffix_dedup(d), lambda d: jaccard.jaccard_components(d), lambda d: tokens.prefix_token_counts(d, PATH), lambda d: tokens.bpe_round_trip(d, PATH), lambda d: token_store.store_and_read(d, PATH)])
def test_empty_tables_null_ids_and_repeated_rows(spark, f):
    assert f(frame(spark, [(1, "x")]).limit(0)).count() == 0
    rows = f(frame(spark, [(None, "some text"), (None, "some text"), (3, "other"), (3, "other"), (3, None), (None, None)])).collect()
    assert sorted(str(r["doc_id"]) for r in rows) == ["3", "3", "3", "None", "None", "None"]


def test_components_and_spreading(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (105, 101), (7, 7)]
    found = dict(map(tuple, components(spark.createDataFrame(edges, "u long, v long"), "test").collect()))
    assert found == {i: 0 for i in range(31)} | {100: 100, 101: 100, 105: 100}
    rng = np.random.default_rng(2)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))]
    parent = list(range(300))
    for _ in range(300):  # labels sink along edges until nothing changes
        for a, b in pairs:
            parent[a] = parent[b] = min(parent[a], parent[b])
    nodes = {x for p in pairs if p[0] != p[1] for x in p}
    assert dict(map(tuple, components(spark.createDataFrame(pairs, "u long, v long"), "test").collect())) == {x: parent[x] for x in nodes}
    assert components(spark.createDataFrame([(7, 7)], "u long, v long"), "test").count() == 0
    rows = spark.createDataFrame([(i, i % 2) for i in range(100)], "id long, k long")
    total = with_group_totals(rows, "k", "id", {"n": (F.count(F.lit(1)), F.sum("n"))}, 8)
    assert total.count() == 100 and {r["n"] for r in total.collect()} == {50}
    assert spread_join(rows, rows.groupBy("k").agg(F.max("id").alias("m")), "k", "id", 8).count() == 100


def brute_contaminated(texts, items):
    """All (document, item) pairs by the stated criteria, every window of every text compared with every item."""
    found = set()
    for d, t in texts:
        words = decontaminate.words_of(t)
        for i, x in items:
            item, answer = decontaminate.words_of(x), decontaminate.answer_of(x)
            n, masks, masks_a = len(item), decontaminate.masks_of(item), decontaminate.masks_of(answer)
            for at in range(max(1, len(words) - n + 1)):
                part = words[at : at + 2 * n]
                share = float(part[:n] == item) if n < decontaminate.SHORT else decontaminate.common_length(masks, n, part) / n
                if share >= decontaminate.VERBATIM or share >= decontaminate.PARAPHRASE and decontaminate.common_length(masks_a, len(answer), part) >= decontaminate.ANSWER * len(answer):
                    found.add((d, i))
                    break
    return found


@pytest.fixture(scope="module")
def leaks(spark, tiny):
    """Documents that hold items of many lengths, verbatim and with words replaced."""
    rng, (docs, rows) = np.random.default_rng(12), documents(spark, tiny)
    filler = [w for _, t in rows for w in (t or "").split()][:20_000]
    some = lambda k: [filler[i] for i in rng.integers(0, len(filler), k)]
    items = [(n * 100 + j, " ".join(some(n - n // 3)) + ". " * (n > 3) + " ".join(some(n // 3))) for n in (2, 4, 6, 8, 12, 24, 40, 90) for j in range(6)]
    texts = []
    for i, x in items:
        for share in (0.0, 0.1, 0.2, 0.3):
            words = [w if rng.random() >= share else str(some(1)[0]) for w in x.split()]
            texts.append((len(texts), " ".join(some(int(rng.integers(0, 60))) + words + some(int(rng.integers(0, 90))))))
    texts += [(len(texts) + 1, None), (len(texts) + 2, ""), (len(texts) + 3, "one"), (0, texts[5][1]), (len(texts) + 4, " ".join(some(20_000)) + " " + items[30][1])]
    return items, texts


def test_recall_of_leaks_against_brute_force(spark, leaks):
    items, texts = leaks
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(frame(spark, texts), benchmark).collect()}
    want = brute_contaminated([(d, t or "") for d, t in texts], items)
    assert found <= want and len(found) >= 0.97 * len(want)
    verbatim = {(4 * k, i) for k, (i, _) in enumerate(items)}
    assert verbatim <= found and (len(texts) - 1, items[30][0]) in found


def test_parts_of_items_and_blocks_change_no_result(spark, leaks, monkeypatch):
    items, texts = leaks
    benchmark, df = spark.createDataFrame(items, "item_id long, text string"), frame(spark, texts)
    whole = sorted(map(str, decontaminate.contaminated(df, benchmark).select("doc_id", "item_id", "item_share", "answer_share").collect()))
    monkeypatch.setattr(decontaminate, "ITEM_BYTES", 2_000)
    monkeypatch.setattr(decontaminate, "ITEMS_AT_ONCE", 7)
    assert len(list(decontaminate.build_indexes(df, benchmark))) > 2
    assert sorted(map(str, decontaminate.contaminated(df, benchmark).select("doc_id", "item_id", "item_share", "answer_share").collect())) == whole


def test_words_of_many_texts_are_coded_together_as_they_are_cut_one_by_one():
    texts = ["", " ", ".", "One two,ONE\tthree-two", "\u0391\u03a3", "\u03a3.\u0391\u03a3 \u0391\u03a3", "\u0130x \u00dcBER\u00a0\u4e2d\u6587", "a\x00b\x1fc_d", "no", "one" * 30, "  x\n", "one"]
    code = {w: i for i, w in enumerate(sorted({w for t in texts[::2] for w in decontaminate.words_of(t)} | {b"one", b"on", b"tw"}))}
    docs = [decontaminate.words_of(t) for t in texts]
    for begin in range(len(texts)):
        codes, lengths = decontaminate.coded(texts[begin:], pa.array(list(code), pa.large_binary()))
        assert codes.tolist() == [code.get(w, len(code)) for d in docs[begin:] for w in d] and lengths.tolist() == [len(d) for d in docs[begin:]]
    codes, lengths = decontaminate.coded(["one", "two"], pa.array([], pa.large_binary()))
    assert codes.tolist() == [0, 0] and lengths.tolist() == [1, 1]


def test_rounds_of_the_latent_space_take_no_more_tasks_for_more_documents(spark, leaks):
    items, texts = leaks
    words, context = [decontaminate.words_of(x) for _, x in items], spark.sparkContext
    code = {w: i for i, w in enumerate(sorted({w for x in words for w in x}))}
    took, spaces = [], []
    for parts in (10, 40):
        context.setJobGroup(f"latent-{parts}", "test")
        docs = frame(spark, context.parallelize(texts, parts))
        spaces.append(decontaminate._latent_basis(docs, words, code, np.ones(len(code)), 10**6, len(texts)))
        jobs = [context.statusTracker().getJobInfo(j) for j in context.statusTracker().getJobIdsForGroup(f"latent-{parts}")]
        stages = [context.statusTracker().getStageInfo(s) for s in {s for j in jobs for s in j.stageIds}]
        took.append(sum(s.numCompletedTasks for s in stages if s))
    context.setLocalProperty("spark.jobGroup.id", None)
    assert np.allclose(*(x[:, :8] @ x[:, :8].T for x in spaces), atol=1e-3)
    # all documents are read once, to draw the sample; the rounds then see the sample only
    assert 0 < took[1] - took[0] <= 30, took


def test_latent_space_is_that_of_all_passages_of_all_documents(spark, leaks, monkeypatch):
    items, texts = leaks
    words, frame_of = [decontaminate.words_of(x) for _, x in items], frame(spark, texts)
    code = {w: i for i, w in enumerate(sorted({w for x in words for w in x}))}
    d, idf, weight = len(code), np.random.default_rng(6).uniform(0.5, 3, len(code)), 160.0
    rows = [(p, decontaminate.ITEM_WEIGHT**2) for x in words for p in decontaminate.passages_of(x)]
    for _, t in texts:
        doc = decontaminate.words_of(t or "")
        # a document of one block is a passage; else each block but the last begins one
        rows += [(doc[i : i + 32], weight / 16 / len(texts) / 2) for i in range(0, max(1, len(doc) - 16), 16)]
    whole = np.zeros((d, d))
    for passage, times in rows:
        a, norm = np.zeros(d), 0.0
        for w in passage:
            norm += idf[code[w]] ** 2 if w in code else idf.max() ** 2
            if w in code:
                a[code[w]] += idf[code[w]]
        if norm:
            whole += times * np.outer(a, a) / norm
    best = np.sort(np.linalg.eigvalsh(whole))[::-1]
    for most in (decontaminate.PAIR_WORDS, 10):
        monkeypatch.setattr(decontaminate, "PAIR_WORDS", most)
        basis = decontaminate._latent_basis(frame_of, words, code, idf, weight, len(texts))
        assert np.allclose(basis.T @ basis, np.eye(basis.shape[1]), atol=1e-4)
        # the leading directions are those of the whole matrix
        assert np.allclose(np.diag(basis.T @ whole @ basis)[:8], best[:8], rtol=1e-3)


def test_names_of_sampled_suffixes_are_lexicographic(spark):
    from tidebars.llm.suffix_names import sampled_suffix_names

    rng = np.random.default_rng(4)
    rows = [(i, "".join(rng.choice(list("ab"), int(rng.integers(0, 90))))) for i in range(12)] + [(50, "-" * 100), (51, None), (52, "x"), (50, "-" * 100)]
    found = sampled_suffix_names(frame(spark, rows)).collect()
    texts = {(r[0]): (r[1] or "").encode() for r in rows}
    suffixes = {(r["key"], r["at"]): texts[r["key"]][r["at"] : r["at"] + 72] for r in found}
    assert len(found) == sum(sum(p % 3 != 0 for p in range(len(t))) for t in texts.values())
    order = {s: i for i, s in enumerate(sorted(set(suffixes.values())), 1)}
    assert {(r["key"], r["at"]): r["name"] for r in found} == {k: order[s] for k, s in suffixes.items()}


def test_new_words_are_merged_together_and_searched_as_the_library_encodes_them(monkeypatch):
    from tokenizers import Tokenizer

    path, rng = queries.tokenizer_path(), np.random.default_rng(3)
    with open(path) as f:
        v, library = bpe.Vocabulary(f.read()), Tokenizer.from_file(path)
    own = list(v.ids)
    words = [b"".join(own[i] for i in rng.integers(256, len(own), 1 + n % 3)).decode("utf-8", "ignore").strip() for n in range(600)]
    words = [w for w in {*words, "a", "aaaaaaa", "\u00fcber", "\u4e2d\u6587", "abab" * 40} if w and v.pieces(w) == [w]]
    want = [tuple(e.ids) for e in library.encode_batch(words, add_special_tokens=False)]
    assert len(words) > 100 and v.merged_together(words) == want and [v.searched(w.encode()) for w in words] == want
    # pairs of tokens are told apart by their last merges; none is merged anew from its bytes
    pairs = list(v._fits.items())
    assert all(ok == (v.merged(v.bytes_of[k >> 20] + v.bytes_of[k & (1 << 20) - 1]) == [k >> 20, k & (1 << 20) - 1]) for k, ok in pairs) and len({ok for _, ok in pairs}) == 2
    assert v.merged_together([]) == []
