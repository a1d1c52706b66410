"""One query for each operator, over its whole table. ``SQL`` has what DuckDB can say of the same results."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from pairwise.llm import (
    byte_bpe,
    chat_masks,
    host_rules,
    line_dedup,
    minhash_bayes,
    phrase_mining,
    prefix_trie,
    quality_classifier,
    secret_scan,
    simhash_dedup,
    substring_dedup,
    suffix_arrays,
    token_counts,
)
from pairwise.llm.oracle import SQL


__all__ = ["QUERIES", "SQL"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = host_rules.host_rules(table(spark, sf_dir, "documents"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op2_chat_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame(
        [(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string"
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat_masks.digests(chat_masks.format_chats(rows)).drop("n_tokens")


def op3_suffix_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = suffix_arrays.find_contamination(docs, table(spark, sf_dir, "benchmark"), keep_text=False)
    ids = F.array_join(F.array_sort(F.col("items").cast("array<string>")), ",")
    spans = F.sequence(F.lit(0), F.greatest(F.size("hits") - 2, F.lit(0)), F.lit(2))
    n_hit = F.aggregate(
        spans, F.lit(0), lambda n, k: n + F.coalesce(F.get("hits", k + 1) - F.get("hits", k), F.lit(0))
    )
    return found.select(
        "doc_id",
        "n_words",
        n_hit.cast("bigint").alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(ids, 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.token_counts(table(spark, sf_dir, "documents"))
    sections = F.array_join(F.col("section_tokens").cast("array<string>"), ",")
    return counted.select(
        "doc_id",
        "n_tokens",
        *[F.get("field_tokens", k).alias(f"{name}_tokens") for k, name in enumerate(("lang", "source", "text"))],
        "separator_tokens",
        F.col("n_crossing"),
        F.size("section_tokens").cast("bigint").alias("n_sections"),
        F.sha2(sections, 256).alias("sections_sha256"),
    )


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_classifier.train(docs, table(spark, sf_dir, "labels"))
    return quality_classifier.score(docs, model).select(
        "doc_id",
        quality_classifier.held_out().alias("held_out"),
        "score",
        (F.col("score") >= quality_classifier.THRESHOLD).cast("int").alias("predicted"),
    )


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    removed = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    n = F.aggregate("removed", F.lit(0), lambda n, x: n + x["end"] - x["start"])
    return removed.select(
        "doc_id", "n_words", n.cast("bigint").alias("n_removed"), F.sha2("kept_text", 256).alias("kept_sha256")
    )


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan_secrets(table(spark, sf_dir, "documents"))

    def joined(spans):
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")

    def number(kind: str):
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *[number(kind) for kind in secret_scan.KINDS],
        F.sha2(joined(F.filter("spans", lambda x: x["kind"] != "random")), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )


def op8_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = byte_bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"))
    digested = encoded.select(
        "doc_id",
        "token_ids",
        F.expr("octet_length(token_ids) div 4").cast("bigint").alias("n_tokens"),
        F.sha2("token_ids", 256).alias("ids_sha256"),
    )
    decoded = byte_bpe.decode(digested)
    return decoded.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


def op11_minhash_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return minhash_bayes.near_duplicates(docs).select("doc_id", "n_shingles", "component_id", "kept")


def op12_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("lang", "text")
    return phrase_mining.collocations(docs).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    chats = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return prefix_trie.trie(chats)


QUERIES = {
    q.__name__: q
    for q in (
        op1_host_rules,
        op2_chat_masks,
        op3_suffix_arrays,
        op4_token_counts,
        op5_quality_classifier,
        op6_substring_dedup,
        op7_secret_scan,
        op8_simhash_dedup,
        op9_line_dedup,
        op10_byte_bpe,
        op11_minhash_bayes,
        op12_phrase_mining,
        op13_prefix_trie,
    )
}
