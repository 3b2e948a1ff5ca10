"""The pipeline's stages, each against a plain version on its own input."""

import corpus_pipeline
from tests.llm import brute
from tidebars.llm import decontaminate, queries, toxicity
from tidebars.llm.common import stored


def test_stages(spark, tiny):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    columns, library = docs.columns, Tokenizer.from_file(queries.tokenizer_path())
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        out = stored(stage(spark, docs, tiny), "test")
        rows, items = list(before.items()), spark.read.parquet(f"{tiny}/benchmark.parquet").collect()
        if name == "toxicity":
            labels = spark.read.parquet(f"{tiny}/labels.parquet")
            lexicon = toxicity.learn(docs, labels)
            m = lexicon.matcher()
            c, a, b = lexicon.curve
            want = {i for i, t in rows if c + sum(w * x for w, x in zip((a, b), lexicon.features(toxicity.fold(t), m))) < 0}
        elif name == "exact dedup":
            want = {i for i, v in brute.copies(rows).items() if v[2]}
        elif name == "n-gram Jaccard join":
            want = {i for i, v in brute.jaccard(rows, 5, 80).items() if v[1] == i}
        elif name == "benchmark decontamination":
            plain = lambda t: f" {' '.join(w.decode() for w in decontaminate.words_of(t))} "
            want = {i for i, t in rows if not any(plain(x["text"]) in plain(t) for x in items)}
        else:
            want = set(before)
            for r in out.collect():
                ids = library.encode(before[r["doc_id"]], add_special_tokens=False).ids
                assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), brute.sha(",".join(map(str, ids))))
        assert {r["doc_id"] for r in out.select("doc_id").collect()} == want, name
        assert name.startswith("BPE") or out.columns == columns
        docs = out
    whole = corpus_pipeline.run(spark, tiny)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, docs.collect()))


def test_repeated_and_null_rows_pass_the_filters(spark, tiny):
    rows = [(1, "same words here", "en", "a", 1), (1, "same words here", "en", "a", 1), (None, "nobody", "en", "a", 1), (3, None, "en", "a", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, tiny), "test")
    assert sorted(str(r["doc_id"]) for r in docs.collect()) == ["1", "3", "None"]


def test_repeated_ids_with_other_texts_lose_no_row(spark, tiny):
    words = " ".join(f"w{i}" for i in range(60))
    rows = [(1, "alpha beta gamma"), (1, "a unique text of row one"), (2, "ALPHA beta gamma"), (2, "alpha beta gamma"), (None, "nobody has this"), (None, "nobody has THIS"), (None, words), (5, words + " end"), (5, "entirely other words here"), (4, words), (4, words), (None, "")]
    docs = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    kept = lambda f: sorted(((r["doc_id"], r["text"]) for r in stored(f(spark, docs, tiny), "test").collect()), key=str)
    # equal texts: the largest doc_id stays, once; a null id stays only where no other has the text
    assert kept(corpus_pipeline.drop_copies) == sorted([(1, "a unique text of row one"), (2, "ALPHA beta gamma"), (None, "nobody has THIS"), (4, words), (5, words + " end"), (5, "entirely other words here"), (None, "")], key=str)
    # near copies: the least doc_id stays, once; rows without words stay
    found = kept(corpus_pipeline.drop_near_copies)
    assert [r for r in found if r[0] is not None] == sorted([(1, "a unique text of row one"), (1, "alpha beta gamma"), (4, words), (5, "entirely other words here")], key=str)
    assert [r[1].lower() for r in found if r[0] is None] == ["", "nobody has this"]
    for stage in (corpus_pipeline.drop_toxic, corpus_pipeline.drop_leaks):
        assert kept(stage) == sorted(rows, key=str)
