"""Named queries opN_<name>: each operator over its whole intended table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from souk.llm import byte_pairs, collocations, decontaminate, embed_graph, gru_lm, langid, licenses, pieces, repeats, sharding, simhash
from souk.llm import toxicity, word_runs
from souk.llm.common import crc_of_id, documents, table

SHARDS = 40


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every text, learned from rows whose crc32 remainder by 4 is not 2."""
    docs = documents(spark, sf_dir)
    model = langid.fit(docs, pieces.default_model(), ~langid.held_out())
    out = langid.identify(docs, model)
    return out.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op2_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every text without the 200-byte strings that repeat anywhere."""
    return repeats.repeat_report(documents(spark, sf_dir))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items that each document contains, up to a fifth of their words edited."""
    return decontaminate.contaminated(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents into 40 shards by the permutation of global row numbers."""
    out = sharding.shard_documents(documents(spark, sf_dir), SHARDS)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"), "row_no")


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence paragraphs of every document, native operations only."""
    return licenses.licence_report(documents(spark, sf_dir))


def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded and decoded with the public 32k merge vocabulary."""
    return pieces.encode_documents(documents(spark, sf_dir), pieces.default_model())


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Category probabilities of every document from the chain trained on ``labels``."""
    docs = documents(spark, sf_dir)
    return toxicity.score_documents(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and their components at 3 bits or fewer."""
    out = simhash.simhash_groups(documents(spark, sf_dir))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                      "component_id", "n_links")


def op9_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors with equal labels and cosine >= 0.93."""
    return embed_graph.embedding_groups(table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding"))


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log10 probability of every text, learned from rows whose crc32 remainder by 7 is not 2."""
    docs = documents(spark, sf_dir)
    out = gru_lm.score_corpus(docs, ~gru_lm.held_out())
    return out.select("doc_id", gru_lm.held_out().alias("held_out"), "n_tokens", "n_known", "train_tokens",
                      "base_score", "score")


def op11_byte_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded and decoded with the public 50k byte-level vocabulary."""
    return byte_pairs.encode_documents(documents(spark, sf_dir), byte_pairs.default_vocabulary())


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 strongest phrases of two to five words of every language."""
    return collocations.collocations(documents(spark, sf_dir), max_words=5, min_count=100, top=2000, closed_percent=100)


def with_planted_periods(docs: DataFrame) -> DataFrame:
    """doc_id and text, where the words behind a place that the crc32 of the id gives are
    replaced by repetitions of the words at that place (a tenth of the documents)."""
    h, g = crc_of_id(), F.floor(crc_of_id() / 10).cast("bigint")
    words = F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit("([^\\x20\\x09-\\x0D]+)"), F.lit(1)))
    d = docs.select("doc_id", "text", words.alias("words"), g.alias("g"))
    n = F.size("words").cast("bigint")
    d = d.withColumn("a", F.when(n > 0, F.col("g") % n))
    left = n - F.col("a")
    d = d.withColumn("p", F.floor(left / (3 + F.col("g") % 8)).cast("bigint") + 1)
    again = F.array_repeat(F.slice("words", F.col("a") + 1, F.col("p")), F.ceil(left / F.col("p")).cast("int"))
    tail = F.slice(F.flatten(again), F.lit(1), left)
    made = F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a")), tail), " ")
    return d.select("doc_id", F.when(F.col("a").isNotNull(), made).otherwise(F.col("text")).alias("text"))


def op13_word_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of at least four repetitions in every text (with planted ones), and the rest."""
    found = word_runs.periodic_runs(with_planted_periods(documents(spark, sf_dir)), 6, 4)
    best = F.array_max(F.transform("runs", lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("back"), (-r["period"]).alias("short"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(
        F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    d = found.select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), best.alias("best"),
                     F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    length, period = F.col("best.length"), -F.col("best.short")
    return d.select("doc_id", "n_runs", (-F.col("best.back")).alias("start"), length.alias("length"), period.alias("period"),
                    F.expr("1000 * best.length div -best.short").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


QUERIES = {
    "op1_langid": op1_langid,
    "op2_repeats": op2_repeats,
    "op3_decontaminate": op3_decontaminate,
    "op4_sharding": op4_sharding,
    "op5_licenses": op5_licenses,
    "op6_pieces": op6_pieces,
    "op7_toxicity": op7_toxicity,
    "op8_simhash": op8_simhash,
    "op9_embeddings": op9_embeddings,
    "op10_lm_score": op10_lm_score,
    "op11_byte_pairs": op11_byte_pairs,
    "op12_collocations": op12_collocations,
    "op13_word_runs": op13_word_runs,
}

#: DuckDB SQL of the queries that SQL can express.
ORACLE: dict[str, str] = {"op12_collocations": collocations.SQL}
