"""Registered queries: each applies one operator, with its production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairgram.functions.safe import r6
from pairgram.llm import chat, decontaminate, hnsw, mixing, quality, resample, sharding, simhash, suffixes, tokens, toxicity, trie, warc
from pairgram.sources.tables import read_table


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, shard (bits of the bucket), depth, shard_bytes, shard_rows."""
    return sharding.shard_rows(read_table(spark, sf_dir, "documents", ["doc_id", "text"])).drop("text")


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint, component_id."""
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents", ["doc_id", "text"]))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, copies, taken."""
    return mixing.mix_plan(read_table(spark, sf_dir, "documents", ["doc_id", "source", "text"]))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    return toxicity.score_documents(read_table(spark, sf_dir, "documents", ["doc_id", "text"]),
                                    read_table(spark, sf_dir, "labels", ["doc_id", "toxic"]))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, class_distance, word_distance, base_failed, kept."""
    judged = quality.judge(read_table(spark, sf_dir, "documents", ["doc_id", "lang", "text"]))
    return judged.withColumns({c: r6(F.col(c)) for c in ("class_distance", "word_distance")})


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    left = suffixes.remove_duplicates(read_table(spark, sf_dir, "documents", ["doc_id", "text"]))
    return left.withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, decoded from the archives written."""
    index = warc.write_archives(read_table(spark, sf_dir, "pages", ["page_id", "url", "html"]))
    return warc.read_records(index, with_payload=False).drop("url")


OWN_CONVERSATION = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, roundtrip_ok, read from the formatted strings."""
    rows = read_table(spark, sf_dir, "conversations", ["conv_id", "turn", "role", "text"])
    own = spark.createDataFrame(OWN_CONVERSATION, "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.format_conversations(rows.unionByName(own)))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens."""
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "text"])
    return tokens.count_tokens(docs, *tokens.load_vocabulary()).drop("text")


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = decontaminate.report(read_table(spark, sf_dir, "documents", ["doc_id", "text"]),
                                 read_table(spark, sf_dir, "benchmark", ["item_id", "text"]))
    return found.select("doc_id", "n_words", "n_hit", "n_items",
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256: one row per node."""
    nodes = trie.prefix_trie(read_table(spark, sf_dir, "conversations", ["conv_id", "turn", "role", "text"]))
    return nodes.drop("r1", "r2", "seed")


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_features, weight, score, rank."""
    drawn = resample.resample(read_table(spark, sf_dir, "documents", ["doc_id", "text"]), read_table(spark, sf_dir, "benchmark", ["text"]), with_text=False)
    return drawn.drop("n_words")


def op13_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id, score: the 20 nearest found of every row whose vec_id is divisible by 20."""
    rows = read_table(spark, sf_dir, "embeddings", ["vec_id", "embedding"])
    return hnsw.search(hnsw.build_index(rows), rows.filter("vec_id % 20 = 0"))


QUERIES = {f.__name__: f for f in (op1_sharding, op2_simhash_near_dedup, op3_mixing, op4_toxicity, op5_quality_rules, op6_suffix_array_dedup, op7_warc, op8_chat_formatting, op9_token_counts,
                                   op10_benchmark_decontamination, op11_prefix_trie, op12_importance_resampling, op13_nearest_neighbours)}
