"""The registered queries of this subpackage, each over its whole table."""

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickwatch.llm import (
    golay, hard_negatives, host_lines, line_runs, nb_svm, periodic_runs, pitman_yor, secret_forest, sharding,
    spaced_seeds, suffix_dedup, surrogates, tree_bpe)
from tickwatch.llm.common import let, table, words_of

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def query(f):
    QUERIES[f.__name__] = f
    return f


def sha256(text):
    return F.sha2(text.cast("binary"), 256)


@query
def op1_surrogates(spark, sf_dir):
    # The key of a registered query is no secret; a user passes their own.
    return surrogates.surrogate_texts(table(spark, sf_dir, "documents"), key="registered query")


@query
def op2_host_lines(spark, sf_dir):
    return host_lines.line_rules(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "n_removed_lines", "n_removed_words")


@query
def op3_simhash_components(spark, sf_dir):
    rows = golay.simhash_components(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query
def op4_pitman_yor(spark, sf_dir):
    return pitman_yor.score_texts(table(spark, sf_dir, "documents"))


@query
def op5_secret_forest(spark, sf_dir):
    return secret_forest.scan(table(spark, sf_dir, "documents"))


@query
def op6_spaced_seeds(spark, sf_dir):
    return spaced_seeds.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op7_line_runs(spark, sf_dir):
    rows = line_runs.dedup_lines(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_lines", "n_dropped", sha256(F.col("kept")).alias("kept_sha256"))


def encode_digests(docs: DataFrame) -> DataFrame:
    ranks = tree_bpe.load_ranks(public_tokenizers.path(VOCABULARY))
    rows = tree_bpe.encode_decode(docs, ranks, public_tokenizers.PATTERN)
    return rows.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        sha256(F.array_join(F.col("ids").cast("array<string>"), ",")).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))


@query
def op8_tree_bpe(spark, sf_dir):
    return encode_digests(table(spark, sf_dir, "documents"))


@query
def op9_suffix_dedup(spark, sf_dir):
    rows = suffix_dedup.dedup_substrings(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"),
                       F.sha2("kept", 256).alias("kept_sha256"))


@query
def op10_nb_svm(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return nb_svm.score_quality(docs, nb_svm.fit_quality(docs, table(spark, sf_dir, "labels")))


@query
def op11_hard_negatives(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(vectors, anchor=F.col("id") % 100 == 0, label=label)


def planted_text(docs: DataFrame):
    """The text with a periodic tail where crc32 of the id is divisible by ten; as it is for a null id."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10).cast("bigint")

    def repeated(words):
        n = F.size(words).cast("bigint")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8)).cast("bigint")
        word = F.transform(F.sequence(F.lit(0).cast("bigint"), n - 1), lambda i: F.get(
            words, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int")))
        return F.when(n > 0, F.array_join(word, " ")).otherwise(docs["text"])

    return F.when(h % 10 == 0, let(words_of(docs["text"]), repeated)).otherwise(docs["text"])


@query
def op12_periodic_runs(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = periodic_runs.periodic_runs(docs.select("doc_id", planted_text(docs).alias("text")))
    lines = F.transform("runs", lambda r: F.format_string("%d,%d,%d\n", r["start"], r["length"], r["period"]))
    return rows.withColumn("best", periodic_runs.strongest(F.col("runs"))).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        sha256(F.array_join(lines, "")).alias("runs_sha256"), sha256(F.col("collapsed")).alias("collapsed_sha256"))


@query
def op13_feistel_shards(spark, sf_dir):
    return sharding.document_places(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "row_number")
