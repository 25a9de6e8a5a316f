"""Statement tables from positioned words (such as a PDF reader gives): lines, header, columns and cells by windows.

``words`` has file, page, text, x0, x1, top. A page's words are bounded by a sheet of paper; every window is keyed by file
and page, and only a header's few words pass from one page to the next.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from proofrecon.storage import settle

#: Words of a table's header by role, and of marks that belong to the amount before them.
HEADS = {
    "date": ("date", "dt"),
    "narration": ("narration", "particulars", "description", "details", "remarks"),
    "debit": ("debit", "withdrawal", "withdrawals", "dr"),
    "credit": ("credit", "deposit", "deposits", "cr"),
    "balance": ("balance", "bal"),
}
MARKS = ("cr", "dr", "cr.", "dr.")
AMOUNT = r"^[(+-]?(?:₹|rs\.?)?\d[\d,]*(?:\.\d{1,2})?\)?-?$"
DATE = r"^\d{1,2}[-/.](?:\d{1,2}|[A-Za-z]{3})[-/.]\d{2,4}$|^\d{4}-\d\d-\d\d$"
#: Fixed values, in points: words of one line, of one money column, the left edge of money, and spread of a date column.
SAME_LINE, SAME_COLUMN, LEFT_OF_MONEY, DATE_SPREAD = 3.0, 2.0, 15.0, 30.0
_PAGE = ["file", "page"]


def lined(words: DataFrame) -> DataFrame:
    """``words`` with line: a word more than 3 points below the one above it opens a new line of its page."""
    order = Window.partitionBy(*_PAGE).orderBy("top", "x0", "text")
    opened = (F.col("top") - F.lag("top").over(order) > SAME_LINE).cast("int")
    return words.withColumn("_o", F.coalesce(opened, F.lit(0))).withColumn("line", F.sum("_o").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_o")


def page_anchors(lines: DataFrame) -> DataFrame:
    """Per page the header that holds for it: its line (null where the header is of an earlier page) and its columns.

    A header has a date, a narration, a balance and a debit or a credit. A page without one takes the last header before
    it; pages before the first header of a file have none and are left out. columns: array of (role, text, x0, center).
    """
    token = F.regexp_replace(F.lower("text"), "[^a-z]", "")
    role = F.coalesce(*(F.when(token.isin(*names), name) for name, names in HEADS.items()))
    told = lines.withColumn("role", role).where("role is not null").groupBy(*_PAGE, "line", "role").agg(F.min(F.struct("x0", "x1", "text")).alias("w"))
    column = F.struct("role", F.col("w.text").alias("text"), F.col("w.x0").alias("x0"), ((F.col("w.x0") + F.col("w.x1")) / 2).alias("center"))
    whole = told.groupBy(*_PAGE, "line").agg(F.array_sort(F.collect_list(column)).alias("columns"))
    has = lambda r: F.exists("columns", lambda c: c["role"] == r)
    heads = whole.where(has("date") & has("narration") & has("balance") & (has("debit") | has("credit")))
    first = heads.groupBy(*_PAGE).agg(F.min(F.struct("line", "columns")).alias("h"))
    pages = lines.select(*_PAGE).distinct().join(first, _PAGE, "left")
    carried = F.last("h.columns", True).over(Window.partitionBy("file").orderBy("page").rowsBetween(Window.unboundedPreceding, 0))
    return pages.withColumn("columns", carried).where("columns is not null").select(*_PAGE, F.col("h.line").alias("header_line"), "columns")


def table_cells(words: DataFrame) -> DataFrame:
    """file, page, line, cells of every table line: date, narration, then the money columns in the header's order.

    Below the header, the date column ends where the dates that stand in one column end. Amounts right of the money edge
    are merged into columns by their overlapping spans; a column belongs to the header word whose centre is nearest, and a
    mark after an amount joins it. All else is narration. A header line is a row of its own; a page without dates has none
    besides it. Null or blank words are left out.
    """
    lines = settle(lined(words.where("trim(text) <> ''")))
    anchors = settle(page_anchors(lines))
    at = lambda r: F.filter("columns", lambda c: c["role"] == r)
    money = F.array_sort(F.transform(F.filter("columns", lambda c: c["role"].isin("debit", "credit", "balance")), lambda c: F.struct(c["x0"], c["role"], c["center"], c["text"])))
    marked = anchors.withColumns({"money": money, "narration_x0": F.get(at("narration"), F.lit(0))["x0"]})
    marked = marked.withColumn("money_x0", F.get("money", F.lit(0))["x0"] - LEFT_OF_MONEY)
    body = lines.join(marked, _PAGE).where(F.col("header_line").isNull() | (F.col("line") > F.col("header_line")))

    first = F.row_number().over(Window.partitionBy(*_PAGE, "line").orderBy("x0", "text")) == 1
    dates = body.withColumn("_f", first).where(F.col("_f") & F.col("text").rlike(DATE) & (F.col("x0") < F.col("narration_x0"))).select(*_PAGE, "x0", "x1")
    middle = dates.groupBy(*_PAGE).agg(F.element_at(F.array_sort(F.collect_list("x0")), (F.floor(F.count("*") / 2) + 1).cast("int")).alias("_m"))
    right = dates.join(middle, _PAGE).where(F.abs(F.col("x0") - F.col("_m")) <= DATE_SPREAD).groupBy(*_PAGE).agg(F.max("x1").alias("date_x1"))
    body = body.join(right, _PAGE)

    amount = (F.col("x0") >= F.col("money_x0")) & F.lower("text").rlike(AMOUNT)
    across = Window.partitionBy(*_PAGE).orderBy("x0", "x1", "top")
    spans = body.where(amount).select(*_PAGE, "x0", "x1", "top")
    reach = F.max("x1").over(across.rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumn("_n", F.when(F.col("x0") > reach + SAME_COLUMN, 1).otherwise(0)).withColumn("span", F.sum("_n").over(across.rowsBetween(Window.unboundedPreceding, 0)))
    merged = spans.groupBy(*_PAGE, "span").agg(F.min("x0").alias("a"), F.max("x1").alias("b"))
    merged = merged.groupBy(*_PAGE).agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("spans"))
    body = body.join(merged, _PAGE, "left")
    inside = F.get(F.filter("spans", lambda s: (s["a"] <= F.col("x0")) & (F.col("x1") <= s["b"])), F.lit(0))
    centre = F.coalesce((inside["a"] + inside["b"]) / 2, (F.col("x0") + F.col("x1")) / 2)
    nearest = F.array_min(F.transform("money", lambda m, k: F.struct(F.abs(m["center"] - centre).alias("d"), k.alias("k"))))["k"]

    dated = (F.col("x1") <= F.col("date_x1") + SAME_COLUMN) & (F.col("x0") < F.col("narration_x0"))
    cell = F.when(dated, 0).when(amount, nearest + 2)
    along = Window.partitionBy(*_PAGE, "line").orderBy("x0", "text").rowsBetween(Window.unboundedPreceding, -1)
    mark = F.col("x0") >= F.col("money_x0")
    body = body.withColumn("_c", cell).withColumn("_p", F.last(F.when(F.col("_c") > 1, F.col("_c")), True).over(along))
    body = body.withColumn("cell", F.coalesce("_c", F.when(mark & F.lower("text").isin(*MARKS), F.col("_p")), F.lit(1)))
    texts = body.groupBy(*_PAGE, "line", "cell").agg(F.array_sort(F.collect_list(F.struct("x0", "text"))).alias("w"), F.first("money").alias("money"))
    joined = texts.select(*_PAGE, "line", "money", F.struct("cell", F.array_join(F.transform("w", lambda x: x["text"]), " ").alias("t")).alias("c"))
    rows = joined.groupBy(*_PAGE, "line").agg(F.collect_list("c").alias("cs"), F.size(F.first("money")).alias("n"))
    filled: Column = F.transform(F.sequence(F.lit(0), F.col("n") + 1), lambda k: F.coalesce(F.get(F.filter("cs", lambda c: c["cell"] == k), F.lit(0))["t"], F.lit("")))
    names = F.concat(F.array(F.get(at("date"), F.lit(0))["text"], F.get(at("narration"), F.lit(0))["text"]), F.transform("money", lambda m: m["text"]))
    head = marked.where("header_line is not null").select(*_PAGE, F.col("header_line").alias("line"), names.alias("cells"))
    return rows.select(*_PAGE, "line", filled.alias("cells")).unionByName(head)
