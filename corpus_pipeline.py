"""The corpus pipeline: quality rules, near-dedup, secret scans, source mixing, packing.

Each stage works on all rows its predecessor kept and is written and read again before the next. All but the last
return the columns of documents: doc_id, text, lang, source, n_chars.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofrecon.llm import line_crf
from proofrecon.llm.common import cut, table
from proofrecon.llm.minhash_dedup import near_duplicates
from proofrecon.llm.mixing import mix_sources
from proofrecon.llm.packing import pack
from proofrecon.llm.secret_scan import find_secrets, redacted

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep what passes the base rules and whose lines the fitted field marks as content. Null or blank texts go."""
    docs = docs.select(*COLUMNS)
    field = line_crf.train(docs, table(spark, sf_dir, "labels"))
    return line_crf.quality(docs, field).where("kept").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest doc_id of each class of near-duplicates (five-word shingles, similarity 0.8 or more).

    Rows that repeat a doc_id are one document: that whose text has the lowest hash stays. Rows without doc_id stay.
    """
    docs = docs.select(*COLUMNS)
    kept = near_duplicates(docs, words=5, percent=80).where("kept and doc_id is not null").select("doc_id").distinct()
    rest = F.struct(F.xxhash64("text").alias("_hash"), *COLUMNS[1:])
    named = docs.join(kept, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(rest).alias("_first")).select("doc_id", "_first.*")
    return named.select(*COLUMNS).unionByName(docs.where("doc_id is null"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace each secret by a mark; n_chars follows the text. No document goes."""
    found = find_secrets(docs.select(*COLUMNS))
    text = F.when(F.col("text").isNotNull(), redacted(F.col("text"), F.col("secrets")))
    chars = F.when(F.size("secrets") > 0, F.char_length(text).cast("long")).otherwise(F.col("n_chars"))
    return found.select("doc_id", text.alias("text"), "lang", "source", chars.alias("n_chars"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or leave out documents so that sources come to weights 1, 2, 3; a repeated document is repeated rows."""
    mixed = mix_sources(docs.select(*COLUMNS)).where("copies > 0")
    return mixed.select(*COLUMNS, F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("_copy")).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 2048 ids along the curve; every row is packed, repeated rows each."""
    return pack(docs, tokenizer=public_tokenizers.path("word_bpe_49k.json"), end_id=1, length=2048)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("secret_scan", secret_scan),
    ("source_mixing", source_mixing),
    ("packing", packing),
]
#: The fitted field and the token ids can't be expressed in SQL; tests/llm run the stages and ask run() for rows only.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        docs = cut(docs) if k < len(STAGES) else docs
    return docs
