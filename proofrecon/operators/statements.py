"""From cells of statement files to typed rows, their proof and their meta data, for any number of files in one plan.

Header, column roles, row kinds, candidates and proofs are windows and aggregates keyed by file; a statement file is
bounded by what its reader takes. Nothing is collected, and no file needs a Python worker.

1. The header among junk lines, or none: then columns are told by their contents.
2. Roles of columns, from header words and the shares of dates, times, amounts and marks in each column.
3. Rows, by a scan that looks back and ahead: text above or below a dated row belongs to it, footers stay closed until
   the next transaction, repeated headers and opening balances are told apart, what can't be read is counted as lost.
4. Each candidate (the roles above, given ones, and either with debit and credit exchanged) is judged by its balance
   chain in both reading orders. The arithmetic chooses.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from proofrecon.functions.amounts import marker_from_word, parse_amount, signed_balance
from proofrecon.functions.dates import date_order, date_order_votes, parse_datetime, parse_time
from proofrecon.functions.references import extract_reference, name_hint
from proofrecon.functions.text import clean_cell, header_tokens
from proofrecon.operators.ledger import parse_confidence
from proofrecon.operators.tables import column_stats, direction, find_header, header_role, joined_pieces
from proofrecon.storage import settle

#: Roles that one column takes; narration may take several.
ROLES = ("date", "time", "reference", "debit", "credit", "amount", "direction", "balance")
MONEY = ("debit", "credit", "amount")

#: What marks an opening balance, totals, page text, and the first and last line of a transaction's text.
OPENING = r"(?i)\b(?:opening\s+balance|brought\s+forward|balance\s+(?:b/?f|forward)|b/f)\b"
TOTALS = r"(?i)\b(?:(?:grand\s+)?total|closing\s+balance|carried\s+forward|c/f|end\s+of\s+statement|statement\s+summary)\b|\*{3,}"
PAGE_TEXT = (
    r"(?i)computer\s+generated|generated\s+on|page\s+\d+\s+(?:of|/)\s+\d+|this\s+is\s+a\s+system|registered\s+office|customer\s+care|toll\s+free|disclaimer|please\s+examine"
)
STARTS = r"(?i)^(?:ach|atm|ecs|ift|imps|inf|mmt|nach|neft|pos|rtgs|upi)\s*[/-]"
ENDS = r"(?i)^chq\.?\s*(?:no\.?)?\s*:"
#: Order of chain results, worst first.
CHAIN = ("fail", "unavailable", "partial", "pass")


@dataclass(frozen=True)
class Statements:
    """rows: file, statement_row, line, dt, has_time, narration, debit, credit, balance, ref, ref_confidence, name_hint.
    meta: one row per file. attempts: every candidate with its proof. errors: file, error."""

    rows: DataFrame
    meta: DataFrame
    attempts: DataFrame
    errors: DataFrame


#: Where a role is looked for: by header or contents, the share that must be reached, and conditions on other shares.
_SEARCH = (
    ("date", "date", "dates", 0.5, None),
    ("date", "value_date", "dates", 0.5, None),
    ("date", None, "dates", 0.6, None),
    ("time", "time", "times", 0.5, None),
    ("time", None, "times", 0.8, lambda c: c["dates"] < 0.5),
    ("direction", "direction", "markers", 0.7, None),
    ("direction", None, "markers", 0.9, lambda c: c["n"] >= 3),
    ("debit", "debit", "amounts", 0.6, None),
    ("credit", "credit", "amounts", 0.6, None),
    ("amount", "amount", "amounts", 0.6, None),
    ("balance", "balance", "amounts", 0.6, None),
)


def roles_of(columns: list[dict]) -> dict:
    """Role by role the column that has most of what the role needs, the first of equals; each column serves once.

    ``columns`` have col, role (of the header), n and shares of their cells. A money column without any cell passes on its
    header. Where no header tells money, numeric columns do: the last of several is the balance, two before it debit and
    credit, one the amount. Narration is every column so named, else that with the longest words.
    """
    out: dict = {}
    notes: list[str] = []
    taken: set[int] = set()

    def take(role: str, fits, key: str) -> None:
        found = [c for c in columns if c["col"] not in taken and fits(c)]
        if role not in out and found:
            out[role] = max(found, key=lambda c: (c[key], -c["col"]))["col"]
            taken.add(out[role])

    for role, header, share, least, also in _SEARCH:
        if role == "amount" and {"debit", "credit"} & set(out):
            continue
        before = role in out
        blank = role in (*MONEY, "balance")
        take(role, lambda c: (header is None or c["role"] == header) and (c[share] >= least or blank and c["n"] == 0) and (also is None or also(c)), share)
        if role == "date" and not before and role in out and header != "date":
            notes.append("value_date_used" if header else "date_by_contents")
    if not set(MONEY) & set(out):
        numbers = [c["col"] for c in columns if c["col"] not in taken and c["amounts"] >= 0.7 and c["references"] < 0.5 and c["dates"] < 0.5]
        if "balance" not in out and len(numbers) > 1:
            out["balance"] = numbers.pop()
        out |= dict(zip(("debit", "credit"), numbers, strict=False)) if len(numbers) > 1 else dict(zip(("amount",), numbers, strict=True))
        notes += ["money_by_contents"] * bool(numbers)
        taken |= {out[r] for r in (*MONEY, "balance") if r in out}
    told = [c["col"] for c in columns if c["role"] == "narration" and c["n"] and c["col"] not in taken]
    taken |= set(told)
    if not told:
        take("text", lambda c: c["letters"] >= 0.5 and c["dates"] < 0.5, "width")
        told = [out.pop("text")] if "text" in out else []
        notes += ["narration_by_contents"] * bool(told)
    take("reference", lambda c: c["role"] == "reference" and c["n"] > 0, "n")
    if "amount" in out and "direction" not in out and next(c["suffixes"] for c in columns if c["col"] == out["amount"]) < 0.5:
        notes.append("direction_by_sign")
    return {r: out.get(r) for r in ROLES} | {"narration": told, "notes": notes}


def column_roles(cells: DataFrame, headers: DataFrame) -> DataFrame:
    """``headers`` with a column per role (a column's number or null), narration (numbers) and notes (codes), by ``roles_of``.

    Header words count only where the cells bear them out. ``cells`` has file, line, cells.
    """
    below = cells.join(headers.select("file", "data_from", F.array_join(F.transform("names", _tokens), "|").alias("_head")), "file")
    data = below.where((F.col("line") >= F.col("data_from")) & ~(_begins() & (F.array_join(F.transform("cells", _tokens), "|") == F.col("_head"))))
    stats = column_stats(data.select("file", "line", "cells"))
    named = headers.select("file", F.posexplode("names").alias("col", "name")).withColumn("role", header_role(F.col("name")))
    shares = ["n", "dates", "times", "amounts", "suffixes", "markers", "letters", "references", "width"]
    each = named.join(stats, ["file", "col"], "left").fillna(0, shares)
    facts = each.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("col", "role", *shares))).alias("cols"))
    told = F.udf(lambda cols: roles_of([c.asDict() for c in cols]), "struct<" + ", ".join(f"{r}: int" for r in ROLES) + ", narration: array<int>, notes: array<string>>")
    out = facts.withColumn("r", told("cols")).select("file", "r.*")
    return headers.join(out, "file")


def _tokens(cell: Column) -> Column:
    return F.array_join(header_tokens(cell), " ")


def _begins() -> Column:
    """Whether the first cell is the first of _head, which spares most lines the comparison of all cells."""
    return _tokens(F.get("cells", F.lit(0))) == F.substring_index("_head", "|", 1)


def completeness() -> Column:
    """How many of date, time, narration, reference, money and balance have a column."""
    given = [F.col(r).isNotNull() for r in ("date", "time", "reference", "balance")]
    return sum((c.cast("int") for c in (*given, F.size("narration") > 0)), F.coalesce(*MONEY).isNotNull().cast("int"))


def usable() -> Column:
    columns = F.array_compact(F.concat(F.array(*ROLES), F.col("narration")))
    return F.col("date").isNotNull() & F.coalesce(*MONEY).isNotNull() & ~F.exists(columns, lambda c: (c < 0) | (c >= F.size("names")))


def scanned_rows(cells: DataFrame, mappings: DataFrame) -> DataFrame:
    """All rows below the header under each mapping, with kind, target and typed cells.

    ``mappings``: file, candidate, data_from, names, synthesized, the roles, date_order (dmy, mdy or null). kind is
    transaction, opening, repeated_header, closing_balance, no_amount, lost, footer, footer_text, above, below, between or
    no_date. target numbers the transaction that a row belongs to: its own, for text below the one before, for text
    above the next one. Of several starts of text above a row the last counts.
    """
    each = ["file", "candidate"]
    told = mappings.select(*each, "data_from", "synthesized", "narration", *ROLES, "date_order", F.regexp_replace(F.array_join(F.transform("names", _tokens), "|"), r"\|+$", "").alias("_head"))
    rows = cells.join(told, "file").where(F.col("line") >= F.col("data_from"))
    cell = lambda role: F.when(F.col(role).isNotNull(), F.get("cells", F.col(role)))
    votes = rows.groupBy(*each).agg(*date_order_votes(cell("date"))).withColumn("_o", F.split(date_order(), ":"))
    orders = votes.select(*each, F.get("_o", F.lit(0)).alias("_order"), F.get("_o", F.lit(1)).alias("_order_status"))
    rows = rows.join(orders, each)
    rows = rows.withColumn("order", F.coalesce("date_order", "_order")).withColumn("order_status", F.when(F.col("date_order").isNotNull(), "certain").otherwise(F.col("_order_status")))
    joined = lambda a: F.array_join(F.filter(a, lambda c: c != ""), " ")
    rows = rows.withColumns(
        {
            "_text": joined(F.transform("cells", clean_cell)),
            "text": joined(F.transform("narration", lambda j: clean_cell(F.get("cells", j)))),
            "_at": F.when(F.col("order") == "mdy", parse_datetime(cell("date"), "mdy")).otherwise(parse_datetime(cell("date"))),
            "_clock": F.when(F.col("time").isNotNull(), parse_time(cell("time"))),
            "_debit": parse_amount(cell("debit")),
            "_credit": parse_amount(cell("credit")),
            "_amount": parse_amount(cell("amount")),
            "_mark": marker_from_word(cell("direction")),
            "_balance": parse_amount(cell("balance")),
            "ref_text": clean_cell(cell("reference")),
            "_same": ~F.col("synthesized") & _begins() & (F.regexp_replace(F.array_join(F.transform("cells", _tokens), "|"), r"\|+$", "") == F.col("_head")),
        }
    ).where("_text <> ''")
    rows = rows.withColumn("row_balance", signed_balance(F.col("_balance")))
    money = [F.col(f"_{m}.value") for m in MONEY]
    rows = rows.withColumn("_moved", F.coalesce(*money).isNotNull())
    bad = F.exists(F.array(*(F.col(f"_{m}.status") for m in (*MONEY, "balance"))), lambda s: s == "invalid")
    dated, level = F.col("_at.dt").isNotNull(), F.col("row_balance").isNotNull()
    first = (
        F.when(F.col("_same"), "repeated_header")
        .when(level & ~F.col("_moved") & F.col("_text").rlike(OPENING), "opening")
        .when(~dated, "undated")
        .when(F.col("_moved"), "transaction")
        .when(bad, "lost")
        .when(level & F.col("_text").rlike(TOTALS), "closing_balance")
        .otherwise("no_amount")
    )
    rows = rows.withColumn("_first", first)

    order = Window.partitionBy(*each).orderBy("line")
    so_far, earlier = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1)
    undated, sound = F.col("_first") == "undated", F.col("_first") == "transaction"
    page, total = F.col("_text").rlike(PAGE_TEXT), F.col("_text").rlike(TOTALS)
    rows = rows.withColumn("_closed", F.coalesce(F.last(F.when(sound, False).when(undated & ~page & total, True), True).over(earlier), F.lit(False)))
    rows = rows.withColumn("_number", F.count_if(sound).over(so_far))
    foot = undated & (F.col("_closed") | page)
    worded = undated & ~foot & ~total & (F.col("text") != "") & ~F.col("_moved") & ~level
    rows = rows.withColumn("_foot", foot).withColumn("_worded", worded).withColumn("_start", worded & F.col("text").rlike(STARTS))
    last = F.last(F.when(sound, "row").when(F.col("_start"), "start"), True)
    rows = rows.withColumn("_above", F.col("_worded") & (F.col("_start") | F.coalesce(last.over(earlier) == "start", F.lit(False))))
    rows = rows.withColumn("_starts", F.count_if("_start").over(so_far))
    inside = Window.partitionBy(*each, "_number").orderBy("line")
    below = F.col("_worded") & ~F.col("_above") & (F.col("_number") > 0)
    done = F.max(F.when(below, F.col("text").rlike(ENDS))).over(inside.rowsBetween(Window.unboundedPreceding, -1))
    final = F.max(F.when(F.col("_above"), F.col("_starts"))).over(Window.partitionBy(*each, "_number"))
    rows = rows.withColumn("_done", F.coalesce(done, F.lit(False))).withColumn("_final", final)
    kind = (
        F.when(~undated, F.col("_first"))
        .when(F.col("_foot"), "footer_text")
        .when(total, "footer")
        .when(F.col("_above"), "above")
        .when(below, F.when(F.col("_done"), "between").otherwise("below"))
        .when(F.col("_moved"), "lost")
        .otherwise("no_date")
    )
    rows = rows.withColumn("kind", kind)
    target = F.when(F.col("kind").isin("transaction", "below"), F.col("_number")).when((F.col("kind") == "above") & (F.col("_starts") == F.col("_final")), F.col("_number") + 1)
    single = direction(F.col("_amount.value"), F.coalesce("_amount.marker", "_mark"))
    debit, credit = F.coalesce(single["debit"], F.abs("_debit.value")), F.coalesce(single["credit"], F.abs("_credit.value"))
    clock = F.col("_clock").isNotNull()
    day = F.date_trunc("day", "_at.dt").cast("timestamp_ntz")
    return rows.select(
        *each, "line", "kind", target.alias("target"), "text", "ref_text", "order", "order_status",
        F.when(clock, day + F.make_dt_interval(secs=F.col("_clock"))).otherwise(F.col("_at.dt")).alias("dt"), (clock | F.col("_at.has_time")).alias("has_time"),
        F.when((debit == 0) & (F.coalesce(credit, F.lit(0)) != 0), None).otherwise(debit).alias("debit"),
        F.when((credit == 0) & (F.coalesce(debit, F.lit(0)) != 0), None).otherwise(credit).alias("credit"), F.col("row_balance").alias("balance"),
    )


#: Kinds of rows that are left out on purpose, and how many of them and of lost rows a report shows.
SKIPPED = ("repeated_header", "footer_text", "footer", "between", "no_date", "closing_balance", "no_amount")
SAMPLES = 10


def parsed_rows(cells: DataFrame, mappings: DataFrame) -> DataFrame:
    """Per file, candidate and target one transaction with its whole text; target 0 has the counts of all other rows."""
    rows = scanned_rows(cells, mappings).withColumn("target", F.coalesce("target", F.lit(0)))
    own = F.col("kind") == "transaction"
    shown = lambda kinds: F.slice(F.array_sort(F.collect_list(F.when(F.col("kind").isin(*kinds) & (F.col("target") == 0), F.struct("line", F.col("kind").alias("reason"))))), 1, SAMPLES)
    piece = F.when((F.col("target") > 0) & (F.col("text") != ""), F.struct("line", "text"))
    ref = F.when(F.col("kind").isin("transaction", "below") & (F.col("ref_text") != ""), F.struct("line", "ref_text"))
    level = F.when(F.col("kind") == "opening", F.struct("line", "balance"))
    out = rows.groupBy("file", "candidate", "target").agg(
        F.max(F.when(own, F.struct("line", "dt", "has_time", "debit", "credit", "balance"))).alias("t"),
        F.array_sort(F.collect_list(piece)).alias("_pieces"), F.min(ref).alias("_ref"), F.min(level).alias("_opening"), F.first("order").alias("order"), F.first("order_status").alias("order_status"),
        F.count_if(F.col("kind") == "lost").alias("n_lost"), F.count_if(F.col("kind").isin(*SKIPPED)).alias("n_skipped"), F.count_if(F.col("kind").isin("above", "below")).alias("n_stitched"),
        shown(("lost",)).alias("lost"), shown(SKIPPED).alias("skipped"),
    )
    text = F.when(F.size("_pieces") > 0, joined_pieces(F.transform("_pieces", lambda p: p["text"]))).otherwise("")
    return out.withColumn("narration", text).withColumn("ref_text", F.col("_ref.ref_text")).drop("_pieces", "_ref")


def _status(checked: Column, passed: Column) -> Column:
    return F.when(checked == 0, "unavailable").when(passed == checked, "pass").when(passed >= 0.9 * checked, "partial").otherwise("fail")


def _rank(status: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, CHAIN)), status)


def proofs(parsed: DataFrame, mappings: DataFrame) -> DataFrame:
    """Every candidate, as mapped and with debit and credit exchanged, with the better reading order and its chain.

    file, candidate, flipped, newest_first, status, checked, passed, n_rows, n_lost, n_skipped, n_stitched, parse_rate,
    completeness, order, order_status, opening, place. An exchanged one takes part only where the mapped one doesn't pass.
    """
    each = ["file", "candidate"]
    facts = parsed.groupBy(*each).agg(
        F.count("t").alias("n_rows"), F.sum("n_lost").alias("n_lost"), F.sum("n_skipped").alias("n_skipped"), F.sum("n_stitched").alias("n_stitched"), F.first("order").alias("order"), F.first("order_status").alias("order_status"),
        F.min("_opening").alias("_opening"), F.max("lost").alias("lost"), F.max("skipped").alias("skipped"),
    )
    facts = facts.withColumn("opening", F.col("_opening.balance")).drop("_opening")
    rows = parsed.where("t is not null").select(*each, "t.*").join(facts.select(*each, "opening"), each)
    w = Window.partitionBy(*each).orderBy("line")
    moved = F.coalesce("credit", F.lit(0)) - F.coalesce("debit", F.lit(0))
    steps = rows.withColumns(
        {
            "_down": F.when(F.row_number().over(w) == 1, F.col("opening")).otherwise(F.lag("balance").over(w)),
            "_up": F.when(F.lead("line").over(w).isNull(), F.col("opening")).otherwise(F.lead("balance").over(w)),
            "_moved": moved,
        }
    )
    made: list[Column] = []
    for way in ("down", "up"):
        made.append(F.count(F.col("balance") - F.col(f"_{way}")).alias(f"checked_{way}"))
        for flip, sign in ((0, 1), (1, -1)):
            made.append(F.count_if(F.abs(F.col("balance") - F.col(f"_{way}") - sign * F.col("_moved")) <= 0.01).alias(f"passed_{way}_{flip}"))
    trend = F.min_by("dt", "line") > F.max_by("dt", "line")
    counts = steps.groupBy(*each).agg(*made, trend.alias("descending"))

    def variant(flip: int) -> Column:
        def way(name: str) -> Column:
            checked, passed = F.col(f"checked_{name}"), F.col(f"passed_{name}_{flip}")
            return F.struct(_rank(_status(checked, passed)).alias("rank"), F.coalesce(passed / F.nullif(checked, F.lit(0)), F.lit(0.0)).alias("rate"), checked.alias("checked"), passed.alias("passed"))

        key = lambda s: F.struct(s["rank"], s["rate"], s["checked"])
        down, up = way("down"), way("up")
        newest = F.when(key(up) > key(down), True).when(key(down) > key(up), False).otherwise(F.col("descending"))
        return F.struct(F.lit(bool(flip)).alias("flipped"), newest.alias("newest_first"), F.when(newest, up).otherwise(down).alias("c"))

    both = counts.withColumn("v", F.array(variant(0), variant(1)))
    both = both.withColumn("v", F.filter("v", lambda x: ~x["flipped"] | (F.get("v", F.lit(0))["c"]["rank"] < len(CHAIN)))).select(*each, F.explode("v").alias("v"))
    info = mappings.select(*each, "place", "source", completeness().alias("completeness"))
    out = both.select(*each, "v.flipped", "v.newest_first", "v.c.*").join(facts, each).join(info, each).where(~F.col("flipped") | (F.col("source") != "user"))
    rate = F.col("n_rows") / (F.col("n_rows") + F.col("n_lost"))
    return out.withColumn("status", F.get(F.array(*map(F.lit, CHAIN)), (F.col("rank") - 1).cast("int"))).withColumn("parse_rate", rate)


def best_candidates(attempts: DataFrame) -> DataFrame:
    """Per file the attempt with the best chain, pass rate, parse rate and completeness; the earlier of equals."""
    key = F.struct("rank", F.round("rate", 4).alias("a"), F.round("parse_rate", 4).alias("b"), "completeness", (-F.col("place")).alias("c"), (~F.col("flipped")).alias("d"))
    return attempts.groupBy("file").agg(F.max_by(F.struct(*(c for c in attempts.columns if c != "file")), key).alias("x")).select("file", "x.*")


def mappings_of(cells: DataFrame, headers: DataFrame, given: DataFrame | None = None) -> DataFrame:
    """One row per file and candidate: the told roles first, then ``given`` ones (file, source, roles, narration, date_order).

    Given mappings come from a user (source ``user``: it stands alone, and is not exchanged) or any other proposer.
    Columns out of range, or without a date or money, make a candidate unusable; it is left out.
    """
    base = column_roles(cells, headers).withColumns({"candidate": F.lit("told"), "source": F.lit("told"), "place": F.lit(0), "date_order": F.lit(None).cast("string")})
    out = base
    if given is not None:
        order = Window.partitionBy("file").orderBy("source", *ROLES)
        other = given.join(headers, "file").withColumn("place", F.row_number().over(order)).withColumn("candidate", F.concat_ws("-", "source", "place"))
        other = other.withColumn("notes", F.array().cast("array<string>")).select(base.columns)
        alone = given.where("source = 'user'").select("file").distinct()
        out = base.join(alone, "file", "left_anti").unionByName(other.join(alone.withColumn("_u", F.lit(True)), "file", "left").where("_u is null or source = 'user'").drop("_u"))
    return out.where(usable())


def judged_mappings(cells: DataFrame, given: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """Cells that aren't blank, headers, mappings, parsed rows and attempts of ``cells``: the flow up to the choice of a mapping."""
    cells = settle(cells.where(F.exists("cells", lambda c: clean_cell(c) != "")).select("file", "line", "cells"))
    headers = settle(find_header(cells))
    mappings = settle(mappings_of(cells, headers, given))
    parsed = settle(parsed_rows(cells, mappings))
    return cells, headers, mappings, parsed, proofs(parsed, mappings)


def read_flow(cells: DataFrame, given: DataFrame | None = None) -> Statements:
    """The whole flow over ``cells`` (file, line, cells), such as ``sources.statements.read_statements`` gives.

    Files without a transaction row have an error (no_transactions), files without usable columns columns_unclear; both
    have no rows. Balances, amounts and dates that can't be read make lost rows, which lower the confidence.
    """
    cells, headers, mappings, parsed, attempts = judged_mappings(cells, given)
    attempts = settle(attempts)
    best = settle(best_candidates(attempts))
    chosen = parsed.where("t is not null").join(best.select("file", "candidate", "flipped", "newest_first"), ["file", "candidate"])
    rows = chosen.select("file", "newest_first", "t.line", "t.dt", "t.has_time", "narration", "ref_text", "t.balance",
                         F.when(F.col("flipped"), F.col("t.credit")).otherwise(F.col("t.debit")).alias("debit"), F.when(F.col("flipped"), F.col("t.debit")).otherwise(F.col("t.credit")).alias("credit"))
    number = F.row_number().over(Window.partitionBy("file").orderBy(F.when(F.col("newest_first"), -F.col("line")).otherwise(F.col("line"))))
    rows = rows.withColumn("place", number).withColumn("_own", extract_reference(F.col("ref_text"))).withColumn("_told", extract_reference(F.col("narration")))
    own = F.col("_own.value").isNotNull()
    rows = rows.withColumns({"ref": F.coalesce("_own.value", "_told.value"), "ref_confidence": F.when(own, "high").otherwise(F.col("_told.confidence")), "statement_row": F.format_string("S%05d", "place"), "name_hint": name_hint(F.col("narration"))})
    rows = settle(rows.select("file", "statement_row", "place", "line", "dt", "has_time", "narration", "debit", "credit", "balance", "ref", "ref_confidence", "name_hint"))
    meta = statement_meta(rows, best, mappings, headers)
    found = headers.select("file").join(best.select("file"), "file", "left_anti").withColumn("error", F.lit("columns_unclear"))
    none = cells.select("file").distinct().join(headers.select("file"), "file", "left_anti").withColumn("error", F.lit("no_transactions"))
    return Statements(rows, meta, attempts.drop("lost", "skipped"), found.unionByName(none))


def _breaks(rows: DataFrame, best: DataFrame) -> DataFrame:
    """Per file the first row that doesn't follow from the one before, with what was expected and why it may be."""
    w = Window.partitionBy("file").orderBy("place")
    steps = rows.join(best.select("file", "opening"), "file")
    debit, credit = F.coalesce("debit", F.lit(0)), F.coalesce("credit", F.lit(0))
    steps = steps.withColumn("_prev", F.when(F.col("place") == 1, F.col("opening")).otherwise(F.lag("balance").over(w)))
    steps = steps.withColumn("expected", (F.col("_prev") + credit - debit).cast("decimal(18,2)")).withColumn("_change", F.abs(F.col("balance") - F.col("_prev")))
    hint = (
        F.when(F.abs(F.col("_prev") + debit - credit - F.col("balance")) <= 0.01, "exchanged")
        .when((debit == 0) & (credit == 0), "no_amount")
        .when((F.col("_change") == debit) | (F.col("_change") == credit), "opposite")
        .otherwise("not_following")
    )
    broken = steps.where(F.abs(F.col("expected") - F.col("balance")) > 0.01)
    return broken.groupBy("file").agg(F.min(F.struct("place", "line", "expected", F.col("balance").alias("actual"), (F.col("balance") - F.col("expected")).cast("decimal(18,2)").alias("difference"), hint.alias("hint"))).alias("first_break"))


def statement_meta(rows: DataFrame, best: DataFrame, mappings: DataFrame, headers: DataFrame) -> DataFrame:
    """Coverage, proof, confidence, warnings (codes) and whether a person should confirm, per file."""
    span = rows.groupBy("file").agg(F.min("dt").alias("_a"), F.max("dt").alias("_b"), F.count_if("has_time").alias("_timed"), F.count("ref").alias("n_refs"), F.count("*").alias("row_count"))
    twice = rows.where("credit is not null and ref is not null").groupBy("file", "ref").count().where("count > 1").groupBy("file").agg(F.count("*").alias("n_repeated"))
    roles = mappings.select("file", "candidate", F.struct(*ROLES, "narration", "date_order").alias("mapping"), "notes", F.size("narration").alias("_told"))
    out = best.join(span, "file").join(twice, "file", "left").join(_breaks(rows, best), "file", "left").join(roles, ["file", "candidate"]).join(headers.select("file", "header_line", "synthesized"), "file")
    timed = 2 * F.col("_timed") >= F.col("row_count")
    day = lambda c: F.date_trunc("day", F.col(c)).cast("timestamp_ntz")
    out = out.withColumn("has_time_of_day", timed)
    out = out.withColumn("coverage_start", F.when(timed, F.col("_a")).otherwise(day("_a"))).withColumn("coverage_end", F.when(timed, F.col("_b")).otherwise(day("_b") + F.make_dt_interval(secs=F.lit(86_399))))
    out = out.withColumn("evidence", F.when(F.col("checked") >= 10, "strong").when(F.col("checked") > 0, "weak").otherwise("none"))
    whole = (F.col("completeness") >= 5) | (F.col("_told") > 0)
    penalty = F.when(F.col("order_status") == "assumed", 0.03).when(F.col("order_status") == "conflict", 0.10).otherwise(0.0) + F.when(F.col("synthesized"), 0.10).otherwise(0.0) + F.when(whole, 0.0).otherwise(0.10)
    out = out.withColumn("parse_confidence", F.round(parse_confidence(F.col("status"), F.col("evidence"), F.col("parse_rate"), penalty), 2))
    warned = (
        ("dates_assumed", F.col("order_status") == "assumed"),
        ("dates_conflict", F.col("order_status") == "conflict"),
        ("no_times", ~timed),
        ("chain_partial", F.col("status") == "partial"),
        ("chain_fail", F.col("status") == "fail"),
        ("no_balance", F.col("status") == "unavailable"),
        ("weak_evidence", (F.col("status") == "pass") & (F.col("evidence") == "weak")),
        ("lost_rows", F.col("n_lost") > 0),
        ("repeated_references", F.col("n_repeated") > 0),
        ("no_references", F.col("n_refs") == 0),
    )
    out = out.withColumn("warnings", F.array_compact(F.array(*(F.when(c, code) for code, c in warned))))
    confirm = (F.col("status") != "pass") | (F.col("parse_confidence") < 0.8) | (F.col("parse_rate") < 0.95)
    return out.withColumn("needs_confirmation", confirm).select(
        "file", "coverage_start", "coverage_end", "has_time_of_day", "parse_confidence", "row_count", "needs_confirmation", "warnings", "notes", "candidate", "flipped", "newest_first",
        "status", "checked", "passed", "evidence", "first_break", "header_line", "synthesized", "order", "order_status", "n_lost", "n_skipped", "n_stitched", "lost", "skipped", "mapping",
    )


def chain_wording() -> Column:
    """The proof in words, from meta's columns."""
    held = F.concat(F.lit("The balance follows on "), F.col("passed"), F.lit(" of "), F.col("checked"), F.lit(" rows"))
    b, hints = F.col("first_break"), {"exchanged": "debit and credit look exchanged", "no_amount": "a row may be missing", "opposite": "the amount has the opposite direction", "not_following": "a row may be missing, doubled or misread"}
    why = F.element_at(F.create_map(*(F.lit(x) for pair in hints.items() for x in pair)), b["hint"])
    order = F.when(F.col("newest_first"), "newest first").otherwise("oldest first")
    broken = F.concat(held, F.lit("; line "), b["line"], F.lit(" has "), b["actual"], F.lit(" instead of "), b["expected"], F.lit(": "), why, F.lit("."))
    return F.when(F.col("status") == "unavailable", "There is no balance to prove the rows with.").when(F.col("status") == "pass", F.concat(held, F.lit(" ("), order, F.lit(")."))).otherwise(F.coalesce(broken, F.concat(held, F.lit("."))))
