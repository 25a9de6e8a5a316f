"""Mix sources to target weights by systematic sampling.

Within a source every document is expected target / source size times. The expectations are prefix-summed in the order
of sizes (equal ones by a hash of doc_id), one random offset is added, and a document is emitted once for each integer
boundary that its step crosses. At every place of that order the copies so far differ from their expectation by less
than one, so a source's taken words miss its target by less than the size of its largest document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofrecon.llm.common import cut, ranked

def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in a text; 0 for null."""
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", -1), "")).cast("long")


def source_targets(sizes: DataFrame, *, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """Per source of ``sizes`` (source, size): source, source_size, target double.

    Sources in code point order, null last, weigh ``weights`` in turn and share the total size. A target above ``most``
    times its source's size stops there; the excess is shared by weight among the others until none is above.
    """
    totals = cut(sizes.groupBy("source").agg(F.sum("size").alias("source_size")))
    order = ranked(totals.withColumn("_all", F.lit(0)).withColumn("_null", F.col("source").isNull()), "_all", ["_null", "source"])
    weigh = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    weighed = cut(order.select("source", "source_size", weigh.cast("long").alias("weight")))
    cap = F.col("source_size") * most
    total = weighed.agg(F.sum("source_size")).first()[0] or 0
    level, full = 0.0, -1
    while True:
        above = cap < F.lit(level) * F.col("weight") if full >= 0 else F.lit(False)
        row = weighed.agg(F.sum(F.when(above, cap).otherwise(0)), F.sum(F.when(above, 0).otherwise(F.col("weight"))), F.count_if(above)).first()
        if row[2] == full:
            break
        full, level = row[2], (total - (row[0] or 0)) / row[1] if row[1] else 0.0
    share = F.lit(level) * F.col("weight")
    return weighed.select("source", "source_size", F.when(cap < share, cap.cast("double")).otherwise(share).alias("target"))


def mix_sources(docs: DataFrame, *, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: int = 20_011, texts: bool = True) -> DataFrame:
    """``docs`` (doc_id, text, source and more) with size, source_size, target double, copies and taken (= copies * size).

    A size is the number of words. The order is size, md5(doc_id), doc_id and, with ``texts``, the text's hash, so reruns
    agree; a source's offset is drawn by a hash of ``seed`` and its name. Rows that repeat a doc_id count as documents of
    their own. A null or blank text has size 0 and takes part without weight; an empty
    source has target 0. copies is at most ``most``. Without ``texts``
    the text column is left out, so that only sizes are sorted. Input columns named like the results are replaced.
    """
    made = ("size", "source_size", "target", "copies", "taken", "rank")
    sized = docs.drop(*made).withColumn("size", word_count(F.col("text"))).withColumn("_key", F.md5(F.col("doc_id").cast("string")))
    sized = sized.withColumn("_text", F.xxhash64("text")) if texts else sized.drop("text")
    rows = ranked(sized, "source", ["size", "_key", "doc_id", *(["_text"] if texts else [])])
    targets = cut(source_targets(rows.select("source", "size"), weights=weights, most=most).withColumnRenamed("source", "_source"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rows = rows.join(targets, rows["source"].eqNullSafe(targets["_source"])).withColumn("_rate", rate)

    drawn = F.substring(F.md5(F.concat_ws(":", F.lit(seed), "source")), 1, 8)
    offset = F.conv(drawn, 16, 10).cast("double") / 2**32
    crossed = F.floor(F.col("rank") * F.col("_rate") + offset) - F.floor((F.col("rank") - 1) * F.col("_rate") + offset)
    out = rows.withColumn("copies", crossed.cast("long"))
    return out.withColumn("taken", F.col("copies") * F.col("size")).drop("_source", "_rate", "rank", "_key", "_text")
