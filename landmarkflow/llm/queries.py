"""One query per operator, over whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landmarkflow.llm import alignment, chat, periodic, secrets, url_rules
from landmarkflow.llm.decontaminate import digest, matches
from landmarkflow.llm.fingerprints import edited_report
from landmarkflow.llm.jaccard_join import join_documents
from landmarkflow.llm.line_dedup import dedup_lines
from landmarkflow.llm.oracles import ORACLES  # noqa: F401
from landmarkflow.llm.packing import PackParams, pack
from landmarkflow.llm.quality_classifier import fit_quality, held_out, score_statistics
from landmarkflow.llm.quality_rules import judge
from landmarkflow.llm.statistics import text_statistics
from landmarkflow.llm.suffix_index import remove_repeats
from landmarkflow.sources.tables import materialize, run_folder


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(_table(spark, sf_dir, "documents")).drop("removed")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(_table(spark, sf_dir, "documents"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, params = _table(spark, sf_dir, "documents"), secrets.SecretParams()
    folder = run_folder(spark)
    found = materialize(secrets.describe(secrets.candidates(docs, params),
                                         secrets.dictionary(docs, params)), "findings", folder)
    forest = secrets.fit_forest(secrets.seed_labels(found), params)
    return secrets.score(found, forest, params).select(
        "doc_id", "start", F.length("candidate").cast("long").alias("length"),
        F.sha2("candidate", 256).alias("candidate_sha256"), "score", "is_secret")


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_documents(_table(spark, sf_dir, "documents"))


#: Conversation that quotes the template's own control strings.
QUOTING = r"\### Assistant: </turn> ok"


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    params = chat.ChatParams(public_tokenizers.path("byte_bpe_50k.tiktoken"),
                             public_tokenizers.PATTERN)
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", QUOTING), (-7, 1, "assistant", QUOTING)],
                                  rows.schema)
    return chat.digest(chat.format_chats(rows.unionByName(extra), params), params)


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(matches(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")))


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels reach pages by number: a page is bad if its label says low quality or toxic."""
    pages, labels = _table(spark, sf_dir, "pages"), _table(spark, sf_dir, "labels")
    bad = (F.col("quality") == 0) | (F.col("toxic") == 1)
    labelled = pages.join(labels.select(F.col("doc_id").alias("page_id"), bad.alias("block")),
                          "page_id").select("url", "block")
    return url_rules.judge_urls(pages, labelled).drop("mined")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(_table(spark, sf_dir, "documents"),
                PackParams(public_tokenizers.path("word_bpe_49k.json")))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    folder = run_folder(spark)
    stats = materialize(text_statistics(docs), "statistics", folder)
    model = fit_quality(stats, labels, folder=folder)
    return score_statistics(stats, model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept")


def op11_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts, with their likeness."""
    return edited_report(_table(spark, sf_dir, "documents"))


def align_params(**changes) -> alignment.AlignParams:
    import public_tokenizers

    return alignment.AlignParams(public_tokenizers.path("byte_bpe_50k.json"),
                                 public_tokenizers.path("piece_bpe_32k.model"),
                                 public_tokenizers.PATTERN, **changes)


def op12_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of all documents, with counts of id pairs over the corpus."""
    report = alignment.link_report(_table(spark, sf_dir, "documents"), align_params())
    return report.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum",
                         "groups_sha256", "n_overlaps")


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of all documents, one in ten of which :func:`periodic.loop_words` edits first."""
    edited = periodic.loop_words(_table(spark, sf_dir, "documents"))
    return periodic.digest(periodic.periodic_runs(edited))


QUERIES = {f.__name__: f for f in (
    op1_suffix_dedup, op2_line_dedup, op3_secret_scan, op4_ngram_jaccard_join,
    op5_chat_formatting, op6_benchmark_decontamination, op7_url_filters, op8_packing,
    op9_quality_classifier, op10_quality_rules,
    op11_document_fingerprints, op12_cross_tokenizer_alignment, op13_periodic_runs)}

