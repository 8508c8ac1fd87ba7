"""The stages of the corpus pipeline.

Each takes ``(spark, docs, sf_dir)`` and works on all its predecessor kept. All but
the last return the columns of ``docs``. Null texts leave in the first stage (they have
no language); a document is its id together with its text, so different texts under one
id (or without one) are different documents, and ids may be of any orderable type; columns
beside ``doc_id`` and ``text`` may have any name; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from souk.llm import decontaminate, langid, pieces, repeats, simhash
from souk.llm.common import table

MIN_LANGUAGE_SCORE = 0.5
#: Finished words a worker keeps: few, as the stages share their workers and executors.
STAGE_CACHE = 60_000


def neutral(docs: DataFrame) -> DataFrame:
    """``docs`` with its other columns named by position, so that no name can meet a helper
    column of an operator; ``toDF(*docs.columns)`` names them back."""
    return docs.toDF(*[c if c in ("doc_id", "text") else f"c{k}" for k, c in enumerate(docs.columns)])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter and those whose best language has a
    posterior below ``MIN_LANGUAGE_SCORE``."""
    model = langid.fit(docs, pieces.default_model())
    if not model.languages:                      # nothing labelled: only the first rule can decide
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    guess = langid.language_of(model, spark, STAGE_CACHE)
    plain = neutral(docs)
    marked = plain.withColumn("guess", guess("text"))
    kept = marked.filter((F.col("guess.lang_pred") != langid.UNDETERMINED) & (F.col("guess.score") >= MIN_LANGUAGE_SCORE))
    return kept.select(*plain.columns).toDF(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents whose fingerprints are linked the one with the least id
    stays (null ids come last; then the least hash of the text). Rows that are one document
    (equal id and text) leave one: the least of their other columns, written as JSON."""
    plain = neutral(docs)
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"),
                   F.xxhash64("text").alias("h1"), F.xxhash64("text", F.lit(1)).alias("h2"))
    named = plain.withColumn("key", key)
    groups = simhash.simhash_groups(named.select(F.col("key").alias("doc_id"), "text"))
    stay = groups.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("key")).distinct()
    rest = [c for c in plain.columns if c not in ("doc_id", "text")]
    row = F.struct(*plain.columns)
    first = F.min_by(row, F.to_json(F.struct(*rest))) if rest else F.first(row)
    kept = named.join(stay, "key", "left_semi").groupBy("key").agg(first.alias("row"))
    return kept.select(*[F.col(f"row.{c}") for c in plain.columns]).toDF(*docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes repeated 200-byte strings out of the texts; documents with nothing left go."""
    plain = neutral(docs)
    out = (repeats.remove_repeats(plain).filter(F.col("text").isNull() | (F.trim("text") != ""))
           .select(*plain.columns).toDF(*docs.columns))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return decontaminate.clean_documents(neutral(docs), table(spark, sf_dir, "benchmark")).toDF(*docs.columns)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and digests of every document that is left."""
    return pieces.encode_documents(docs, pieces.default_model(), with_ids=True, cache_entries=STAGE_CACHE).select(
        "doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [
    ("language ID", language),
    ("SimHash near-dedup", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("benchmark decontamination", benchmark_leaks),
    ("SentencePiece encoding", encoding),
]
