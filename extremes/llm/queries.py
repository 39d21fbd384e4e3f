"""Queries opN_<name>, one for each training-data operator, over the whole of its table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, jaccard, langid, licenses, merkle, packing, quality, spelling, token_counts, token_matrix, whitening
from .common import table
from .line_store import LineStore
from .sql import ORACLE_SQL  # noqa: F401


def _each(found: DataFrame, hits: str) -> DataFrame:
    """A row for each hit. ``explode`` alone would have the planner add a filter on the array, and so find all hits twice."""
    return found.select("doc_id", F.explode_outer(hits).alias("hit")).where("hit IS NOT NULL").select("doc_id", "hit.*")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"), quality.good())
    scored = quality.score(docs.select("doc_id", "text", "source", "lang", "n_chars"), model)
    return scored.select("doc_id", "judged.*", (F.col("judged.p_quality") >= 0.5).alias("keep"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = decontaminate.build(table(spark, sf_dir, "benchmark"))
    found = decontaminate.find_leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), shards)
    return _each(found, "leaks")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), packing.words())


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "'</s>[INST] ok [/INST]'"
    extra = turns.sparkSession.sql(f"SELECT -7L AS conv_id, 0L AS turn, 'user' AS role, {said} AS text UNION ALL SELECT -7L, 1L, 'assistant', {said}")
    chats = chat.format_chats(turns.unionByName(extra).withColumn("parts", chat.text_part(F.coalesce("text", F.lit("")))))
    read = chats.withColumn("turns", chat.read_turns(F.col("formatted"))).withColumn("learnt", F.array_join(chat.read_loss(F.col("formatted"), F.col("loss")), ""))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"),
        F.length("learnt").cast("long").alias("loss_chars"), F.sha2("learnt", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"), F.size("attachments").cast("long").alias("n_attachments"), "n_tokens",
    )


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.train_on_documents(docs)
    return langid.identify(docs.select("doc_id", "text"), model).select("doc_id", langid.held_out().alias("held_out"), "lang_id.*")


def op6_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.fingerprints_with_edits(table(spark, sf_dir, "documents"))


def op7_token_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_matrix.pack_tokens(table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    automaton = token_counts.Automaton(*token_counts.read_vocabulary())
    return token_counts.with_token_counts(table(spark, sf_dir, "documents").select("doc_id", "text"), automaton).select("doc_id", "counted.*")


def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return _each(found, "licenses")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(spelling.count_words(table(spark, sf_dir, "documents"), edit=spelling.drop_every_97th))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened_vectors(table(spark, sf_dir, "embeddings"))


def op13_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents enter the store in two increments, those of the lower half of the ids first, as a corpus that grows."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ends = docs.agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).first()
    middle = ((ends["low"] or 0) + (ends["high"] or 0)) // 2
    store = LineStore.empty(spark).insert(docs.where(F.col("doc_id") <= middle)).insert(docs.where(F.col("doc_id") > middle))
    return store.clean(docs).select("doc_id", "cleaned.n_lines", "cleaned.n_dropped", F.sha2("cleaned.kept", 256).alias("kept_sha256"))


QUERIES = {f.__name__: f for f in (
    op1_quality, op2_decontaminate, op3_packing, op4_chat, op5_langid, op6_fingerprint, op7_token_matrix, op8_token_counts, op9_jaccard, op10_licenses, op11_spelling, op12_whitening, op13_lines,
)}
