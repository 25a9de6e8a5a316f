"""From raw cells to typed rows: delimiter, header, column statistics and roles, row parsing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from proofrecon.functions.amounts import is_amount_like, marker_from_word, parse_amount
from proofrecon.functions.dates import date_and_time_like, is_date_like
from proofrecon.functions.text import clean_cell, header_tokens
from proofrecon.storage import settle

#: Delimiters in order of preference.
DELIMITERS = (",", ";", "\t", "|")


def delimiter_votes(lines: DataFrame) -> DataFrame:
    """Per file the delimiter with the best count * (width - 1) over its row widths; earlier candidates win ties.

    ``lines``: file, line. Candidates are exploded beside each line, so any number of files is judged in one pass.
    """
    cells = lines.select("file", F.posexplode(F.array(*map(F.lit, DELIMITERS))).alias("rank", "delimiter"), "line")
    widths = cells.select("file", "rank", "delimiter", (F.char_length("line") - F.char_length(F.replace("line", "delimiter", F.lit(""))) + 1).alias("width"))
    score = widths.groupBy("file", "rank", "delimiter", "width").count().select("file", "rank", "delimiter", F.when(F.col("width") >= 2, F.col("count") * (F.col("width") - 1)).otherwise(0).alias("score"))
    best = score.groupBy("file", "rank", "delimiter").agg(F.max("score").alias("score"))
    return best.groupBy("file").agg(F.max_by("delimiter", F.struct("score", -F.col("rank"))).alias("delimiter"), F.max("score").alias("score"))


#: Words of a header line.
HEADER_WORDS = (
    "amount", "amt", "bal", "balance", "cheque", "chq", "cr", "credit", "date", "debit", "deposit", "deposits", "description", "details",
    "dr", "dt", "memo", "mode", "narration", "narrative", "particulars", "payee", "ref", "reference", "remarks", "rrn", "time",
    "timestamp", "tran", "transaction", "txn", "type", "utr", "value", "withdrawal", "withdrawals",
)
#: Lines in which a header may stand, and lines below it that are looked at.
HEADER_LINES, FOLLOW = 80, 8


def _dataish(filled: Column) -> Column:
    """Whether a line has a date and an amount."""
    return F.exists(filled, is_date_like) & F.exists(filled, is_amount_like)


def find_header(cells: DataFrame) -> DataFrame:
    """file, header_line, data_from, names, synthesized, score of each file with a header or a line of data.

    A candidate is one of the first 80 lines with 3 filled cells, no date and at most 30 % amounts. It scores 3 per cell
    with a header word, 5 times the share of data among the next 8 lines, 1 for 4 cells. Of candidates with as many words
    as the best the first that data follows is taken, as headers are repeated on later pages. It needs two words, or one
    and data in 40 % of the next lines, or data in 60 %; else there is none: data begin with the first line that has a
    date and an amount, and columns are named by number. Files without such a line are left out.
    """
    rows = cells.where(F.exists("cells", lambda c: clean_cell(c) != ""))
    order = Window.partitionBy("file").orderBy("line")
    top = rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= HEADER_LINES + FOLLOW)
    vocabulary = F.array(*map(F.lit, HEADER_WORDS))
    top = top.select("file", "line", "place", "cells", F.size(F.filter("cells", lambda c: clean_cell(c) != "")).alias("n"), F.exists("cells", is_date_like).alias("dated"))
    may = (F.col("place") <= HEADER_LINES) & (F.col("n") >= 3) & ~F.col("dated")
    hits, money = F.size(F.filter("cells", lambda c: F.arrays_overlap(header_tokens(c), vocabulary))), F.size(F.filter("cells", is_amount_like))
    top = top.withColumns({"hits": F.when(may, hits), "money": F.when(may, money), "data": F.col("dated") & F.exists("cells", is_amount_like)})
    data = F.col("data")
    top = top.withColumn("follow", F.coalesce(F.avg(data.cast("double")).over(order.rowsBetween(1, FOLLOW)), F.lit(0.0)))
    fits = may & (F.col("money") <= 0.3 * F.col("n"))
    score = 3 * F.col("hits") + 5 * F.col("follow") + (F.col("n") >= 4).cast("int")
    candidate = F.struct((-F.col("place")).alias("at"), "line", "hits", "follow", score.alias("score"), "cells")
    found = top.groupBy("file").agg(F.collect_list(F.when(fits, candidate)).alias("c"), F.min(F.when(data, F.col("line"))).alias("_data"))
    found = found.withColumn("best", F.array_max(F.transform("c", lambda x: F.struct(x["score"], x["at"], x["hits"], x["follow"]))))
    like = F.filter("c", lambda x: (x["hits"] >= F.col("best.hits")) & ((x["follow"] > 0) | (F.col("best.follow") == 0) & (x["at"] == F.col("best.at"))))
    found = found.withColumn("h", F.array_min(F.transform(like, lambda x: F.struct((-x["at"]).alias("at"), x["line"].alias("line"), x["hits"].alias("hits"), x["follow"].alias("follow"), x["score"].alias("score"), x["cells"].alias("cells")))))
    sure = (F.col("h.hits") >= 2) | ((F.col("h.hits") >= 1) & (F.col("h.follow") >= 0.4)) | (F.col("h.follow") >= 0.6)
    found = settle(found.withColumn("sure", F.coalesce(sure, F.lit(False))).drop("c", "best"))
    width = rows.groupBy("file").agg(F.max(F.size("cells")).alias("width"))
    late = F.broadcast(found.where("not sure and _data is null").select("file", "sure"))  # a row per file at most
    deep = rows.join(late, "file").where(F.when(~F.col("sure"), _dataish(F.col("cells")))).groupBy("file").agg(F.min("line").alias("_deep"))  # parsed after the join only, as the test names sure
    out = found.join(width, "file").join(deep, "file", "left").withColumn("data_from", F.when(F.col("sure"), F.col("h.line") + 1).otherwise(F.coalesce("_data", "_deep")))
    places = F.sequence(F.lit(0), F.col("width") - 1)
    names = F.transform(places, lambda j: F.coalesce(F.when(F.col("sure"), F.nullif(clean_cell(F.get("h.cells", j)), F.lit(""))), F.concat(F.lit("col_"), (j + 1).cast("string"))))
    shown = lambda c: F.when(F.col("sure"), F.col(c))
    return out.where("data_from is not null").select("file", shown("h.line").alias("header_line"), "data_from", names.alias("names"), (~F.col("sure")).alias("synthesized"), shown("h.score").alias("score"))


def spacer_columns(cells: DataFrame) -> DataFrame:
    """Columns that are empty in all rows of a file: file, col."""
    each = cells.select("file", F.posexplode("cells").alias("col", "cell"))
    return each.groupBy("file", "col").agg(F.max(clean_cell(F.col("cell")) != "").alias("used")).where(~F.col("used")).select("file", "col")


def column_stats(cells: DataFrame, most: int = 60) -> DataFrame:
    """n and the shares of dates, times, amounts, marked amounts, Dr/Cr words, letters and 12 digits in the first ``most`` rows of each column (a feature's limit)."""
    place = F.row_number().over(Window.partitionBy("file").orderBy("line"))
    each = cells.withColumn("_p", place).where(F.col("_p") <= most).select("file", F.posexplode("cells").alias("col", "cell")).where(clean_cell(F.col("cell")) != "")
    share = lambda c: F.round(F.avg(c.cast("double")), 4)
    each = each.withColumns({"told": parse_amount(F.col("cell")), "like": date_and_time_like(F.col("cell"))})
    c, told = F.col("cell"), F.col("told")
    return each.groupBy("file", "col").agg(
        F.count("*").alias("n"), share(F.col("like.date")).alias("dates"), share(F.col("like.time")).alias("times"), share(is_amount_like(c)).alias("amounts"),
        share(told["marker"].isNotNull() & told["value"].isNotNull()).alias("suffixes"), share(marker_from_word(c).isNotNull()).alias("markers"),
        share(c.rlike("[A-Za-z]{2,}")).alias("letters"), share(c.rlike(r"^\d{12}$")).alias("references"), F.round(F.avg(F.char_length(c)), 4).alias("width"),
    )


def header_role(name: Column) -> Column:
    """The role that a header's words give a column, the most special first; null without one. The words are fixed values."""
    tokens = header_tokens(name)
    has = lambda *words: F.arrays_overlap(tokens, F.array(*map(F.lit, words)))
    day, money = has("date", "dt"), has("amount", "amt")
    rules = (
        ("value_date", has("value", "val") & day),
        ("direction", (has("debit") & has("credit")) | (has("dr") & has("cr"))),
        ("direction", has("type", "indicator", "drcr", "crdr") & ~has("date") & ~money),
        ("debit", has("debit", "debits", "withdrawal", "withdrawals", "withdrawn", "dr", "paidout")),
        ("credit", has("credit", "credits", "deposit", "deposits", "cr", "paidin")),
        ("balance", has("balance", "bal")),
        ("narration", has("narration", "description", "particulars", "details", "remarks", "memo", "narrative", "payee", "merchant")),
        ("reference", has("ref", "reference", "utr", "rrn", "refno") | (has("txn", "transaction", "tran") & has("id", "no", "number"))),
        ("date", day | has("timestamp", "datetime")),
        ("time", has("time")),
        ("amount", money),
    )
    return F.coalesce(*(F.when(fits, role) for role, fits in rules))


def even_sample(cells: DataFrame, most: int = 6, window: int = 60) -> DataFrame:
    """Evenly spaced rows of the first ``window`` with three filled cells (a feature's limit)."""
    good = cells.where(F.size(F.filter("cells", lambda c: clean_cell(c) != "")) >= 3)
    w = Window.partitionBy("file")
    good = good.withColumn("_p", F.row_number().over(w.orderBy("line"))).where(F.col("_p") <= window).withColumn("_n", F.count("*").over(w))
    picks = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.floor(i * F.col("_n") / most) + 1)
    return good.where(F.array_contains(picks, F.col("_p").cast("long"))).drop("_p", "_n")


def direction(amount: Column, marker: Column) -> Column:
    """struct(debit, credit) of one amount: the marker decides, else the sign."""
    out = F.when(marker.isNotNull(), marker == "dr").otherwise(amount < 0)
    value = F.abs(amount)
    return F.struct(F.when(out, value).alias("debit"), F.when(~out, value).alias("credit"))


def joined_pieces(pieces: Column) -> Column:
    """Wrapped text in one line: no space where a digit meets a digit."""
    return F.aggregate(
        F.filter(pieces, lambda p: p != ""), F.lit(""), lambda s, p: F.when(s == "", p).when(s.rlike(r"\d$") & p.rlike(r"^\d"), F.concat(s, p)).otherwise(F.concat(s, F.lit(" "), p))
    )


def stitched(lines: DataFrame) -> DataFrame:
    """Rows without a date continue the dated row above: file, line, narration. Lines before the first date are dropped."""
    w = Window.partitionBy("file").orderBy("line")
    groups = lines.withColumn("_g", F.count_if(F.col("date").isNotNull()).over(w)).where("_g > 0")
    texts = groups.groupBy("file", "_g").agg(F.min("line").alias("line"), F.array_sort(F.collect_list(F.struct("line", "text"))).alias("p"))
    return texts.select("file", "line", joined_pieces(F.transform("p", lambda x: x["text"])).alias("narration"))


def opening_balance(rows: DataFrame) -> DataFrame:
    """Per file the first row that is labelled an opening balance and has no amount."""
    label = F.lower(clean_cell(F.col("narration"))).rlike(r"^(opening|brought forward|b/?f|balance b/?f)")
    some = rows.where(label & F.col("balance").isNotNull() & F.col("debit").isNull() & F.col("credit").isNull())
    return some.groupBy("file").agg(F.min_by("balance", "line").alias("opening"))
