"""Toxicity by a weighted lexicon, matched by Aho-Corasick on folded text.

Folding lower-cases, drops accents, and maps homoglyphs, digit and sign substitutions to one letter each, so
disguised words meet their plain forms. The lexicon (whole words and word beginnings) and its weights are
log odds learned from labelled rows; phrases in which a lexicon word is mostly harmless become exceptions
that take its weight back. Weights are summed, also per hundred words, and a logistic curve fitted to the
labelled rows turns both into a score.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import in_groups
from .common import bounded_batches, drawn, lean, stored

#: Letters of other alphabets that look like Latin ones, and signs used in their place.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ѵ": "v", "ԝ": "w",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w", "ı": "i", "ɡ": "g", "ł": "l", "ø": "o", "ß": "s",
}
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "i", "l": "i"}
#: Training rows are bounded by this many, drawn by hash. Terms and phrases are all those that pass the tests below.
SAMPLE, GROUP_CHARS = 20_000, 500_000
MIN_DOCS, MIN_WEIGHT, MIN_RATIO, STEMS = 5, 1.5, 24.0, (4, 5, 6, 7)

_SPACED = {c: " " for c in range(128) if not chr(c).isalnum()}
_PLAIN = _SPACED | {ord(a): b for a, b in HOMOGLYPHS.items()} | {ord(a): b.replace("l", "i") for a, b in SUBSTITUTES.items() if a.isalnum()} | {ord("ł"): "i"}
_SIGNS = {ord(a): b for a, b in SUBSTITUTES.items() if not a.isalnum()}
_MARKS = dict.fromkeys(range(0x300, 0x370))


def fold(text: str) -> str:
    """Folded words, with a space before and after each. Signs stand for letters only ahead of a letter."""
    text = text.lower()
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text).translate(_MARKS)
    for sign, letter in _SIGNS.items():
        if (s := chr(sign)) in text:
            parts = text.split(s)
            text = parts[0] + "".join((letter if p[:1].isalnum() else " ") + p for p in parts[1:])
    return f" {text.translate(_PLAIN)} "


@dataclass
class Lexicon:
    """Terms with weights (" word " or " beginning"), phrases taken back, and the score curve."""

    weights: dict[str, float] = field(default_factory=dict)
    curve: tuple[float, float, float] = (-20.0, 0.0, 0.0)

    def matcher(self):
        import ahocorasick

        a = ahocorasick.Automaton()
        for term, w in self.weights.items():
            a.add_word(term, w)
        if self.weights:
            a.make_automaton()
        return a

    def features(self, folded: str, matcher) -> tuple[float, float]:
        total = max(0.0, sum(w for _, w in matcher.iter(folded))) if self.weights else 0.0
        return float(np.log1p(total)), float(np.log1p(100 * total / max(1, folded.count(" ") - 1)))


def _terms(folded: str) -> set[str]:
    words = set(folded.split())
    return {f" {w} " for w in words} | {f" {w[:n]}" for w in words for n in STEMS if len(w) > n}


def _weights(counts: pd.DataFrame, n_pos: int, n_neg: int) -> dict[str, float]:
    """Weights of the significant terms, each as specific as its evidence allows.

    A beginning gives way to a longer beginning or word that holds four fifths of its toxic rows; a term is
    left out if a shorter one that stays does as well.
    """
    pos = dict(zip(counts["term"], counts["pos"]))
    weight = np.log((counts["pos"] + 0.5) / (n_pos + 1)) - np.log((counts["neg"] + 0.5) / (n_neg + 1))
    found = dict(zip(counts["term"], map(float, weight)))
    best_longer: dict[str, int] = {}
    for term in found:
        for n in range(2, len(term.rstrip()) + (term[-1] == " ")):
            best_longer[term[:n]] = max(best_longer.get(term[:n], 0), pos[term])
    kept: dict[str, float] = {}
    for term in sorted(found, key=lambda t: (len(t.rstrip()), t)):
        if term[-1] != " " and best_longer.get(term, 0) >= 0.8 * pos[term]:
            continue
        shorter = [kept[term[:n]] for n in range(2, len(term)) if term[:n] in kept]
        if not shorter or found[term] > max(shorter) + 0.7:
            kept[term] = found[term]
    return kept


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(text, toxic) of labelled rows outside the held-out fifth, at most about ``sample``, drawn by hash of the key.

    Labels are collected by key first (the larger counts if a key has several; null labels count as none), so
    the broadcast side is bounded by the sample.
    """
    one = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = min(1.0, sample / max(1, one.count()))
    rows = one.where(drawn(share, "doc_id"))
    return docs.select("doc_id", "text").join(F.broadcast(rows.withColumnRenamed("doc_id", "label_id")), F.col("doc_id") == F.col("label_id")).select(F.coalesce("text", F.lit("")).alias("text"), "toxic")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Lexicon:
    """Fit lexicon, exceptions and curve on the training rows. No toxic or no other rows: an empty lexicon."""
    bounded_batches(docs.sparkSession)
    train = stored(training_rows(docs, labels, sample), "toxicity-training")

    @lean
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts, toxic = b["text"].tolist(), b["toxic"].tolist()
            for s in in_groups(texts, GROUP_CHARS):
                sums = {0: Counter(), 1: Counter()}
                for text, y in zip(texts[s], toxic[s]):
                    sums[int(y > 0)].update(_terms(fold(text)) | {""})
                yield pd.DataFrame([(t, sums[1][t], sums[0][t]) for t in sums[0].keys() | sums[1].keys()], columns=["term", "pos", "neg"])

    counts = train.mapInPandas(count, "term string, pos long, neg long").groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    p, n = F.col("pos") + 0.5, F.col("neg") + 0.5
    totals = counts.where("term = ''").first()
    n_pos, n_neg = (totals["pos"], totals["neg"]) if totals else (0, 0)
    if not n_pos or not n_neg:
        return Lexicon()
    weight = F.log(p / (n_pos + 1)) - F.log(n / (n_neg + 1))
    expected = (F.col("pos") + F.col("neg")) * (n_pos / (n_pos + n_neg))
    ratio = 2 * (F.col("pos") * F.log(F.col("pos") / expected) + F.coalesce(F.col("neg") * F.log(F.nullif(F.col("neg"), F.lit(0)) / (F.col("pos") + F.col("neg") - expected)), F.lit(0.0)))
    strong = counts.where((F.col("term") != "") & (F.col("pos") >= MIN_DOCS) & (weight >= MIN_WEIGHT) & (ratio >= MIN_RATIO))
    lexicon = Lexicon(_weights(strong.orderBy("term").toPandas(), n_pos, n_neg))
    words = lexicon.weights

    @lean
    def phrases(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = Counter()
            for text, toxic in zip(b["text"], b["toxic"]):
                split = fold(text).split()
                near = {(f" {a} {t} ", term) for a, t in zip(split, split[1:]) for term in (f" {t} ", *(f" {t[:k]}" for k in STEMS)) if term in words}
                near |= {(f" {t} {c} ", term) for t, c in zip(split, split[1:]) for term in (f" {t} ", *(f" {t[:k]}" for k in STEMS)) if term in words}
                rows.update((p, t, int(toxic > 0)) for p, t in near)
            yield pd.DataFrame([(*k, v) for k, v in rows.items()], columns=["phrase", "term", "toxic", "n"])

    seen = train.mapInPandas(phrases, "phrase string, term string, toxic int, n long").groupBy("phrase", "term").agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("pos"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("neg"))
    harmless = seen.where((F.col("neg") >= MIN_DOCS) & (F.col("pos") * n_neg < F.col("neg") * n_pos)).orderBy("phrase", "term").collect()
    for r in harmless:
        words[r["phrase"]] = words.get(r["phrase"], 0.0) - words[r["term"]]

    @lean
    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matcher = lexicon.matcher()
        for b in batches:
            x = [lexicon.features(fold(t), matcher) for t in b["text"]]
            yield pd.DataFrame({"a": [r[0] for r in x], "b": [r[1] for r in x], "y": (b["toxic"] > 0).astype(float)})

    got = train.mapInPandas(features, "a double, b double, y double").groupBy("a", "b", "y").count().toPandas()
    lexicon.curve = _logistic(got[["a", "b"]].to_numpy(), got["y"].to_numpy(), got["count"].to_numpy(float))
    return lexicon


def _logistic(x: np.ndarray, y: np.ndarray, times: np.ndarray) -> tuple[float, float, float]:
    """Ridge logistic regression by Newton steps; a feature whose slope turns out negative is left out."""
    used = [0, 1]
    while True:
        z = np.column_stack([np.ones(len(x)), x[:, used]])
        beta, ridge = np.zeros(z.shape[1]), 0.1 * np.diag([0.0] + [1.0] * len(used))
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
            step = np.linalg.solve((z * (times * (p * (1 - p) + 1e-9))[:, None]).T @ z + ridge, z.T @ (times * (y - p)) - ridge @ beta)
            beta += np.clip(step, -2, 2)
            if np.abs(step).max() < 1e-8:
                break
        bad = [k for k, b in zip(used, beta[1:]) if b < 0]
        if not bad:
            slopes = dict(zip(used, beta[1:]))
            return float(beta[0]), float(slopes.get(0, 0.0)), float(slopes.get(1, 0.0))
        used.remove(bad[-1])


def scorer(lexicon: Lexicon):
    """A column function text -> score from 0 to 1, in Arrow batches."""
    state: dict = {}

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        matcher = state.setdefault("m", None) or state.update(m=lexicon.matcher()) or state["m"]
        c, a, b = lexicon.curve
        x = np.array([lexicon.features(fold(t), matcher) for t in texts]).reshape(-1, 2)
        return pd.Series(1 / (1 + np.exp(-np.clip(c + x @ np.array([a, b]), -30, 30))))

    return lambda text: score(F.coalesce(text, F.lit("")))


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs.

    Null text counts as empty and takes the curve's base score. Long texts are read whole. Repeated rows are
    scored alike; a null doc_id is not held out and never labelled. Without labels of both kinds all
    scores are near 0. An empty table gives an empty result. Only doc_id and text are read.
    """
    score = scorer(learn(docs, labels, sample))
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score(F.col("text")).alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))
