"""The queries of the corpus operators, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import chat_format, html_extract, line_dedup, ngram_join, packing, phrase_mining, quality_rules, secret_scan, source_mix, token_counts, topk_search, turn_repair, warc
from quern.llm.common import scratch_path, word_count, written


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals for every context limit over documents, and the share of documents within it, from which quantiles are read."""
    totals = token_counts.context_totals(written(token_counts.length_histogram(_table(spark, sf_dir, "documents")), "lengths"))
    return totals.withColumn("share_within", (F.col("docs_total") - F.col("docs_longer")) / F.col("docs_total"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every document."""
    scored = quality_rules.score(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return scored.select("row.doc_id", "quality.n_words", "quality.word_chars", "quality.n_symbols", "quality.n_dup_lines", "quality.n_repeat_words", "quality.base_failed", "quality.kept", "quality.covered_words")


def op3_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of every vec_id divisible by 50."""
    return topk_search.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix of sources takes of every document, in words."""
    sized = _table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("size"))
    return source_mix.mix(written(sized, "sizes"), F.col("size")).select("row.doc_id", "size", "source_size", "target", "taken")


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, and one of control strings, read back from its formatted text."""
    said = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    return chat_format.read_back(chat_format.format_trees(chat_format.conversation_trees(rows), null_tree=True))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 4096 ids."""
    return packing.pack(_table(spark, sf_dir, "documents"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The secrets of every document; the models learn ordinary words from documents labelled as good."""
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = secret_scan.train(secret_scan.random_samples(spark), secret_scan.ordinary_samples(docs, labels.where("quality = 1")))
    return secret_scan.digest(secret_scan.scan(docs.select("doc_id", "text"), model))


def op8_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    found = html_extract.extract(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("row.page_id", "row.url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"), "n_shared", "n_furniture", "n_differenced")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the runs of lines that an earlier place holds."""
    found = line_dedup.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("row.doc_id", "clean_text", "n_lines", "n_deleted")


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class and number of links of every document."""
    return ngram_join.near_classes(_table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "n_shingles")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and the cheapest repair of every conversation, damaged for trial."""
    return turn_repair.repair(turn_repair.damaged(_table(spark, sf_dir, "conversations")))


def op12_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as its record in an archive says it."""
    path = scratch_path(spark, "archives")
    warc.write_archives(warc.page_records(_table(spark, sf_dir, "pages").select("page_id", "url", "html")), path)
    found = warc.read_records(spark, path)
    return found.select(warc.page_of(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", warc.page_of(F.col("refers_to")).alias("refers_to"))


def op13_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 best collocations of every language."""
    return phrase_mining.collocations(_table(spark, sf_dir, "documents").select("text", "lang"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_quality_rules": op2_quality_rules,
    "op3_topk_search": op3_topk_search,
    "op4_source_mix": op4_source_mix,
    "op5_chat_format": op5_chat_format,
    "op6_packing": op6_packing,
    "op7_secret_scan": op7_secret_scan,
    "op8_html_extract": op8_html_extract,
    "op9_line_dedup": op9_line_dedup,
    "op10_ngram_join": op10_ngram_join,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_warc_archives": op12_warc_archives,
    "op13_phrase_mining": op13_phrase_mining,
}

ORACLE: dict[str, str] = {
    "op2_quality_rules": quality_rules.SQL,
    "op10_ngram_join": ngram_join.SQL,
    "op3_topk_search": topk_search.SQL,
    "op5_chat_format": chat_format.SQL,
    "op4_source_mix": source_mix.SQL,
    "op9_line_dedup": line_dedup.SQL,
    "op11_conversation_repair": turn_repair.SQL,
    "op12_warc_archives": warc.SQL,
    "op13_phrase_mining": phrase_mining.SQL,
}
