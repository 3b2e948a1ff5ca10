"""Exact deduplication by content-defined chunk recipes, in DataFrame functions only.

A text is cut where its own content says so: after the first sentence or line end that lies at least
``MIN_CHARS`` after the last cut, or at ``MAX_CHARS``. Equal passages hence give equal chunks wherever they
stand. Every distinct chunk text is moved once, to verify that its 64-bit identifier stands for one chunk
only. A document is then its recipe, the ordered list of identifiers, and only recipes are grouped: long
texts are not moved again. Documents holding an identifier that verification found ambiguous are grouped
by recipe and SHA-256 of the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, one_row_each, with_group_totals

MIN_CHARS, MAX_CHARS, SALTS = 512, 4096, 16


def chunks(text: Column) -> Column:
    """Array of the text's chunks; they concatenate to the text. Empty text: no chunks."""
    cut = rf"(?s).{{{MIN_CHARS},{MAX_CHARS}}}?(?:(?<=[.!?\n。！？])|\z)|.{{1,{MAX_CHARS}}}"
    return F.regexp_extract_all(text, F.lit(cut), F.lit(0))


def chunk_table(normalised: DataFrame) -> DataFrame:
    """Distinct (chunk_id, chunk) of a table with a column ``norm``; equal chunks meet before the shuffle."""
    return normalised.select(F.explode(chunks(F.col("norm"))).alias("chunk")).select(F.xxhash64("chunk").alias("chunk_id"), "chunk").distinct()


def exact_dedup(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256, n_chunks.

    Texts are equal when identical after lower-casing A-Z. Null text counts as empty; empty texts form one
    group with an empty recipe. Of a group the largest doc_id stays (a null doc_id only if all are null, and
    then it counts as kept). Rows repeating doc_id and text are each counted in group_size and share their
    result. An empty table gives an empty result. Only doc_id and text are read, so other columns may clash.
    """
    norm = docs.select("doc_id", ascii_lower(F.coalesce("text", F.lit(""))).alias("norm"))
    ambiguous = chunk_table(norm).groupBy("chunk_id").count().where("count > 1").select("chunk_id")
    recipes = norm.select("doc_id", F.sha2("norm", 256).alias("text_sha256"), F.transform(chunks(F.col("norm")), lambda c: F.xxhash64(c)).alias("recipe"))
    # the ambiguous are few, if any: each is repeated for every salt, so that a chunk of many documents goes to many tasks
    salted = ambiguous.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    own = recipes.select("doc_id", F.pmod(F.xxhash64("text_sha256"), F.lit(SALTS)).cast("int").alias("salt"), F.explode("recipe").alias("chunk_id"))
    doubtful = own.join(salted, ["chunk_id", "salt"], "left_semi").select(F.col("doc_id").alias("doubt_id")).distinct().withColumn("doubt", F.lit(True))
    keyed = recipes.join(doubtful, F.col("doc_id").eqNullSafe(F.col("doubt_id")), "left").select(
        "doc_id", "text_sha256", F.size("recipe").alias("n_chunks"), F.struct("recipe", F.when(F.col("doubt"), F.col("text_sha256")).alias("sha")).alias("group_key")
    )
    keyed = keyed.withColumn("spread", F.coalesce("doc_id", F.lit(0)))
    whole = with_group_totals(keyed, "group_key", "spread", {"keep_id": (F.max("doc_id"), F.max("keep_id")), "group_size": (F.count(F.lit(1)), F.sum("group_size"))})
    return whole.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256", "n_chunks")


def without_copies(docs: DataFrame) -> DataFrame:
    """Rows of docs, all columns: of equal texts the row of largest doc_id, and one only where rows repeat its doc_id too."""
    same = F.sha2(ascii_lower(F.coalesce("text", F.lit(""))), 256)
    return one_row_each(docs, exact_dedup(docs).where("kept").select("doc_id", F.col("text_sha256").alias("identity")), same)
