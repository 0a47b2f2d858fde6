"""The registered queries of the training-data operators, and their reference SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, common, decontaminate, fingerprint, html_extract, language_id, lm_score, near_dedup, packing, secrets, warc


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes over distinct 3-word shingles at a similarity of 0.85 or more."""
    return near_dedup.near_duplicates(common.table(spark, sf_dir, "documents"), width=3, percent=85)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, and whether it is kept."""
    return language_id.of_documents(common.table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op2_language_id_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every web page, with markup, address and host as evidence beside the text."""
    return language_id.of_pages(common.table(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and backoff-automaton scores of all documents."""
    return lm_score.score(common.table(spark, sf_dir, "documents"))


def op4_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html_extract.extract(common.table(spark, sf_dir, "pages"))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -7, whose texts hold control strings, formatted and read back."""
    rows = common.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = r"\### Assistant: </turn> ok"
    return chat.digests(chat.format_conversations(rows.union(spark.createDataFrame([(-7, 0, "user", tricky), (-7, 1, "assistant", tricky)], rows.schema))))


def op6_packing(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """Documents packed into sequences of 2048 tokens; ``tokenizer`` is the path of the vocabulary file."""
    return packing.pack(common.table(spark, sf_dir, "documents"), tokenizer or word_bpe())


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items that documents contain to 0.8 or more."""
    return decontaminate.contained(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC archives and read back."""
    return warc.write_and_read(common.table(spark, sf_dir, "pages"))


def op9_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    return fingerprint.edit_likeness(common.table(spark, sf_dir, "documents"))


def op10_secret_scan(spark: SparkSession, sf_dir: str, words: str | None = None) -> DataFrame:
    """Secrets in every document; ``words`` is the path of the vocabulary whose words are ranked."""
    return secrets.find_secrets(common.table(spark, sf_dir, "documents"), words or word_bpe())


def word_bpe() -> str:
    """The production tokenizer's vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Query name to callable of (spark, sf_dir)."""
    return {f.__name__: f for f in (op1_near_dedup, op2_language_id, op2_language_id_pages, op3_lm_score, op4_html_extract, op5_chat_format, op6_packing, op7_decontaminate, op8_warc, op9_fingerprint, op10_secret_scan)}


def oracle_sql() -> dict[str, str]:
    """Query name to the DuckDB SQL that gives the same rows."""
    return {"op7_decontaminate": decontaminate.ORACLE, "op8_warc": warc.ORACLE}
