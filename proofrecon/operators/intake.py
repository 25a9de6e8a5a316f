"""Mail and chat intake: screening policy, attachment classes, caps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Labels that block a message, and the score from which on it is held.
BLOCKING = ("blocked", "malicious", "phishing")
HOLD = 0.5


def policy_reasons() -> Column:
    """Why a message isn't let through, in order: over label, injection, phishing, held, hidden_text, analysis."""
    told = (
        ("label", F.col("label").isin(*BLOCKING)),
        ("injection", F.col("injection") >= HOLD),
        ("phishing", F.col("phishing") >= HOLD),
        ("held", F.col("held")),
        ("hidden_text", F.col("hidden_text")),
        ("sender", F.col("label") == "spf_fail"),
        ("analysis", F.col("analysis") != "complete"),
    )
    return F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), n) for n, c in told)))


def policy(messages: DataFrame) -> DataFrame:
    """decision (block, hold, accept), severity and reasons of each message."""
    why = policy_reasons()
    hard = F.array_intersect("reasons", F.array(*map(F.lit, ("label", "injection", "phishing", "hidden_text"))))
    out = messages.withColumn("reasons", why)
    decision = F.when(F.size(hard) > 0, "block").when(F.size("reasons") > 0, "hold").otherwise("accept")
    return out.withColumn("decision", decision).withColumn("severity", F.when(decision == "block", "high").when(decision == "hold", "medium").otherwise("none"))


def attachment_class(name: Column, inline: Column) -> Column:
    ext = F.regexp_extract(F.lower(name), r"(\.[^.]+)$", 1)
    picture = ext.isin(".png", ".jpg", ".jpeg", ".webp")
    return F.when(ext.isin(".csv", ".xlsx", ".xls", ".pdf", ".txt"), "statement").when(picture & inline, "skip").when(picture, "screenshot").otherwise("other")


def capped_images(images: DataFrame, *, most: int = 25, most_bytes: int = 150 * 1024 * 1024) -> DataFrame:
    """Images of each archive in order, up to a count and a sum of bytes: a feature's limits. Over-count images are
    skipped, the first one over the bytes ends the archive."""
    w = Window.partitionBy("archive").orderBy("pos")
    taken = images.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)
    return taken.withColumn("total", F.sum("size").over(w)).where(F.col("total") <= most_bytes)


def chat_sender(line: Column) -> Column:
    """Who sent the attachment that a chat line names."""
    return F.nullif(F.regexp_extract(line, r"^\[?[0-9/.:, ]+(?:[AaPp][Mm])?\]?\s*(?:-\s*)?([^:]+):", 1), F.lit(""))
