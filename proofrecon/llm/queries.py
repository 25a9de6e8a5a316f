"""The registered queries of this subpackage, op1 to op13, and the SQL of those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofrecon.llm import language_id, line_crf, merkle
from proofrecon.llm.collocations import collocations
from proofrecon.llm.common import scratch, table
from proofrecon.llm.minhash_dedup import near_duplicates
from proofrecon.llm.mixing import mix_sources
from proofrecon.llm.oracles import ORACLES
from proofrecon.llm.packing import pack
from proofrecon.llm.repeated_passages import remove_repeats
from proofrecon.llm.secret_scan import BASE_RULES, find_secrets, listed, of_kind
from proofrecon.llm.token_files import read_token_files, write_token_files
from proofrecon.llm.vantage_point import nearest
from proofrecon.llm.warc_archive import read_records, write_archive
from proofrecon.llm.winnowing import decontaminate


__all__ = ["ORACLES", "QUERIES"]


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents on two-word shingles at a Jaccard index of 0.8."""
    return near_duplicates(table(spark, sf_dir, "documents"), words=2, percent=80)


def op2_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as records of a content-addressed archive and read back."""
    path = scratch(spark)
    write_archive(table(spark, sf_dir, "pages"), path, least=0)
    return read_records(spark, path)


def op3_simple8b_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as token files, read back."""
    path = scratch(spark)
    write_token_files(table(spark, sf_dir, "documents"), path, tokenizer=public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    return read_token_files(spark, path)


def op4_rank_order_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents by profiles of those that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    profiles = language_id.learn(docs.where(~held_out))
    return language_id.identify(docs.select("doc_id", "text", held_out.alias("held_out")), profiles).drop("text")


def op5_hilbert_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens along the curve."""
    return pack(table(spark, sf_dir, "documents"), tokenizer=public_tokenizers.path("word_bpe_49k.json"), end_id=1, length=2048).drop("ids")


def op6_radix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the bytes of 400-byte strings that occur elsewhere."""
    cleaned = remove_repeats(table(spark, sf_dir, "documents"), length=400)
    return cleaned.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", (F.col("n_removed") > 0).alias("has_repeats"))


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to target weights 1, 2, 3 with at most three repeats."""
    mixed = mix_sources(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), texts=False)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all documents."""
    found = find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = of_kind(F.col("secrets"), *(r.kind for r in BASE_RULES))
    counts = [F.size(of_kind(F.col("secrets"), kind)).cast("long").alias(f"n_{kind}") for kind in ("assign", "access", "hex")]
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("secrets")).alias("spans"))


def op9_line_crf_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality verdicts on all documents by a field fitted to labelled ones."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    field = line_crf.train(docs, table(spark, sf_dir, "labels"))
    return line_crf.quality(docs, field).drop("text")


def op10_vantage_point_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of every vector whose id is divisible by 50."""
    return nearest(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 50 == 0, k=5)


def op11_winnowing_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten-word windows of all benchmark items in all documents."""
    found = decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), length=10)
    n_items, items = F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", n_items, items, "contaminated")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a leaf of its language's tree, and the check of its proof after some leaves were tampered with."""
    docs = table(spark, sf_dir, "documents")
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    tampered = merkle.leaf_digest(*fields[:3], F.col("n_chars") + 1, fields[4])
    touched = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    leaves = docs.select("doc_id", "lang", merkle.leaf_digest(*fields).alias("leaf"), F.when(touched, tampered).alias("tampered"))
    proved = merkle.manifest(leaves, tree="lang", order="doc_id")
    proved = proved.withColumn("folded_root", merkle.folded(F.coalesce("tampered", "leaf"), F.col("proof")))
    return proved.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("proof")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op13_suffix_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 strongest phrases of 2 to 5 words of each language."""
    found = collocations(table(spark, sf_dir, "documents").select("lang", "text"), least=100, longest=5, best=2000)
    return found.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


QUERIES = {
    f.__name__: f
    for f in (
        op1_minhash_dedup,
        op2_warc_archive,
        op3_simple8b_tokens,
        op4_rank_order_language,
        op5_hilbert_packing,
        op6_radix_dedup,
        op7_source_mixing,
        op8_secret_scan,
        op9_line_crf_quality,
        op10_vantage_point_search,
        op11_winnowing_decontamination,
        op12_merkle_manifest,
        op13_suffix_collocations,
    )
}
