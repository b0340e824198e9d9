"""One registered query per training-data operator, over its whole table, and their SQL oracles."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newswatch.llm import chat_tree, decontaminate, html_extract, license_scan, merkle_manifest, ngram_join, packing, quality_rules, run_detection, suffix_dedup, token_output, warc, winnowing
from newswatch.llm.common import table
from newswatch.llm.oracles import ORACLES

BYTE_TOKENIZER = "byte_bpe_50k.json"
WORD_TOKENIZER = "word_bpe_49k.json"
WORD_VOCABULARY = 49_408
END = 2  # the id appended to each document, as the contract fixes it


def op1_chat_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, and one made of control strings, emitted as prefix trees and read back."""
    rows = [F.struct(F.lit(-7).cast("long").alias("conv_id"), F.lit(k).cast("long").alias("turn"), F.lit(r).alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text")) for k, r in enumerate(("user", "assistant"))]
    made = spark.range(1).select(F.explode(F.array(*rows)).alias("t")).select("t.*")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(made)
    tokenizer = public_tokenizers.path(BYTE_TOKENIZER)
    return chat_tree.read_conversations(chat_tree.format_conversations(turns, tokenizer), tokenizer)


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingle set size and component of every document."""
    return ngram_join.classes(ngram_join.join(table(spark, sf_dir, "documents")))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and test item it holds, by BM25 retrieval and verified overlap."""
    return decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record per page, written to archives and read back with segments joined."""
    path = warc.write_archives(table(spark, sf_dir, "pages"))
    return warc.captures(warc.whole_records(warc.read_segments(spark, path)))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence notices of every document by a classifier trained on the spot."""
    docs = table(spark, sf_dir, "documents")
    return license_scan.summary(license_scan.scan(docs, license_scan.train(docs)))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts and the verdict of every document, cutoffs chosen on the labels."""
    judged = quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return judged.select("doc_id", *counts, "base_failed", "kept")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Power-of-two pieces of every document, one per sequence."""
    sequences = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_TOKENIZER), END)
    return packing.digests(sequences)


def op8_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What 400-byte strings met twice or more cover in every document."""
    return suffix_dedup.report(table(spark, sf_dir, "documents"))


def op10_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bit-packed ids of every document in ascending order, read back from the files."""
    docs = table(spark, sf_dir, "documents")
    files = token_output.write(docs, public_tokenizers.path(WORD_TOKENIZER), WORD_VOCABULARY, END)
    return token_output.read_documents(files)


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id and text; a tenth of the texts (by crc32 of the id) repeat a stretch of their words, as the contract says."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)

    def planted(words):
        n = F.size(words)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        return F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(words, F.when(i < a, i).otherwise(a + (i - a) % p))), " ")

    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    rewritten = merkle_manifest.let(words, lambda w: F.when(F.size(w) > 0, planted(w)))
    return docs.select("doc_id", F.when(h % 10 == 0, rewritten).otherwise(F.col("text")).alias("text"))


def op11_run_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words of every document, the strongest one, and digests of all and of the collapsed text."""
    found = run_detection.find_runs(with_planted_runs(table(spark, sf_dir, "documents")))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.withColumn("best", run_detection.strongest(F.col("runs"))).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, proof and verification of every document; every seventh id (by crc32) claims one character more."""
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    tampered = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    claimed = {"n_chars": F.when(tampered, F.col("n_chars") + 1).otherwise(F.col("n_chars"))}
    proved = merkle_manifest.manifest(table(spark, sf_dir, "documents"), fields, "lang", "doc_id", claimed)
    proved = proved.withColumn("folded_root", merkle_manifest.folded("claimed_leaf", "path"))
    return proved.select(
        "doc_id", "leaf", "subroot", "root", merkle_manifest.proof_digest("path").alias("proof_sha256"),
        "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def op13_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and how like they are."""
    found = winnowing.compare_neighbours(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), winnowing.written_out("fingerprint").alias("fingerprint"),
        winnowing.written_out("edited_fingerprint").alias("edited_fingerprint"), "near_edited", "near_next",
    )


def queries() -> dict:
    return {
        "op1_chat_tree": op1_chat_tree,
        "op2_ngram_join": op2_ngram_join,
        "op3_decontaminate": op3_decontaminate,
        "op4_warc": op4_warc,
        "op5_license_scan": op5_license_scan,
        "op6_quality_rules": op6_quality_rules,
        "op7_packing": op7_packing,
        "op8_html_extract": op8_html_extract,
        "op9_suffix_dedup": op9_suffix_dedup,
        "op10_token_output": op10_token_output,
        "op11_run_detection": op11_run_detection,
        "op12_merkle_manifest": op12_merkle_manifest,
        "op13_winnowing": op13_winnowing,
    }


def oracle() -> dict[str, str]:
    return ORACLES
