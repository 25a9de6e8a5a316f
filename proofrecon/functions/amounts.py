"""Money cells: struct(value decimal(18,2), marker, status) without a UDF."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from proofrecon.functions.text import clean_cell, let

#: Cells that mean "no amount", and words for the two directions.
EMPTY = ("", "-", "--", "---", "—", "–", "nil", "na", "n/a", "null", "none", ".")
DEBIT_WORDS = ("dr", "debit", "debited", "d", "db", "withdrawal", "w", "out", "paid", "sent")
CREDIT_WORDS = ("cr", "credit", "credited", "c", "cred", "deposit", "dep", "in", "received")
CURRENCIES = ("$", "eur", "gbp", "inr", "rs.", "rs", "us$", "usd", "£", "€", "₹")

_CURRENCY = "(?i)" + "|".join(re.escape(c) for c in sorted(CURRENCIES, key=len, reverse=True))
#: A cell without its currency: direction, bracket, sign, digits, rupees-only mark, sign, bracket, direction.
_CELL = r"(?i)^(?:(cr|dr)\.?[:\s]+)?(\()?\s*([+-]?)\s*([\d.,\s]*)(?:/[=-])?\s*(-?)\s*(\))?\s*(?:(c|cr|d|dr)\.?)?$"
#: Shapes of the digits, and what each separator becomes: point for the second of the pair, nothing for the rest.
_PLAIN = r"^\d*\.?\d+$"
COMMA_GROUPS = r"^\d{1,3}(?:(?:,\d\d)*|(?:,\d{3})*),\d{3}(?:\.\d+)?$"
_COMMA_DECIMALS = r"^\d*,\d{1,2}$|^[\d.]*\.[\d.]*,\d+$"
_POINT_GROUPS = r"^\d*\.\d*\.[\d.]*$"


def _number(digits: Column) -> Column:
    """Digits with one decimal point and no groups; null where commas and points don't make a number."""
    return (
        F.when(digits.rlike(_PLAIN), digits)
        .when(digits.rlike(COMMA_GROUPS), F.translate(digits, ",", ""))
        .when(digits.rlike(_COMMA_DECIMALS), F.translate(digits, ",.", "."))
        .when(digits.rlike(_POINT_GROUPS), F.translate(digits, ".", ""))
    )


def parse_amount(x: Column) -> Column:
    """Currency signs, groupings, brackets and minus signs on either side are read; a Dr/Cr word is told, not applied.

    One pattern takes a cell apart. Two directions in one cell, or one bracket of a pair, are invalid.
    """
    text = F.trim(F.translate(F.coalesce(x, F.lit("")), "\u00a0\u2212\u0001", " -"))

    def apart(text: Column) -> Column:
        bare = F.trim(F.regexp_replace(text, _CURRENCY, ""))
        part = F.split(F.regexp_replace(bare, _CELL, "$1$7\u0001$2$6\u0001$3$5\u0001$4"), "\u0001")
        return F.struct(F.lower(text).isin(*EMPTY).alias("empty"), part.alias("part"))

    def typed(cell: Column) -> Column:
        direction, brackets, signs = (F.get(cell["part"], F.lit(k)) for k in range(3))
        direction, digits = F.substring(F.lower(direction), 1, 2), F.translate(F.get(cell["part"], F.lit(3)), " \t\r\n", "")
        known = (F.char_length(F.get(cell["part"], F.lit(0))) <= 2) & brackets.isin("", "()")
        number = F.when(known, F.concat(F.lit("0"), let(digits, _number)).try_cast("decimal(18,2)"))
        return F.struct(
            (cell["empty"] | F.coalesce(known & (direction == "") & (digits == ""), F.lit(False))).alias("empty"),
            F.when((brackets == "()") | signs.contains("-"), -number).otherwise(number).cast("decimal(18,2)").alias("value"),
            F.when(direction.isin("d", "dr"), "dr").when(direction.isin("c", "cr"), "cr").alias("marker"),
        )

    def told(cell: Column) -> Column:
        status = F.when(cell["empty"], "empty").when(cell["value"].isNotNull(), "ok").otherwise("invalid")
        kept = [F.when(~cell["empty"], cell[name]).alias(name) for name in ("value", "marker")]
        return F.struct(*kept, status.alias("status"))

    none = F.struct(F.lit(None).cast("decimal(18,2)").alias("value"), F.lit(None).cast("string").alias("marker"), F.lit("empty").alias("status"))
    return F.when(text == "", none).otherwise(let(text, apart, typed, told))


def signed_balance(p: Column) -> Column:
    """The balance in a parsed amount; a debit marker means an overdrawn, negative one."""
    return F.when(p["marker"] == "dr", -F.abs(p["value"])).otherwise(p["value"]).cast("decimal(18,2)")


def parse_balance(x: Column) -> Column:
    return let(parse_amount(x), signed_balance)


def is_amount_like(x: Column) -> Column:
    """A money amount and not a bare long number."""
    short = lambda s: s.rlike("[.,]") | (F.char_length(F.regexp_replace(s, r"\D", "")) <= 9)
    return F.when(x.rlike("[0-9.]"), let(clean_cell(x), lambda s: short(s) & (parse_amount(s)["status"] == "ok"))).otherwise(F.lit(False))


def marker_from_word(x: Column) -> Column:
    w = F.regexp_replace(F.lower(clean_cell(x)), r"^[.:/ ]+|[.:/ ]+$", "")
    return F.when(w.isin(*DEBIT_WORDS), "dr").when(w.isin(*CREDIT_WORDS), "cr")


def claim_amount(x: Column) -> Column:
    """An amount in free text: a bare number, or the only distinct marked one; else null. Not positive is null."""
    s = clean_cell(x)
    body = r"([0-9][0-9,]*(?:\.[0-9]{1,2})?)"
    marked = F.concat(
        F.regexp_extract_all(s, F.lit(r"(?i)(?:₹|rs\.?|inr)\s*" + body), F.lit(1)), F.regexp_extract_all(s, F.lit(body + r"\s*/-"), F.lit(1))
    )
    values = F.array_distinct(F.transform(marked, lambda m: F.replace(m, F.lit(","), F.lit("")).try_cast("decimal(18,2)")))
    bare = F.when(s.rlike("^" + body + "$"), F.replace(s, F.lit(","), F.lit("")).try_cast("decimal(18,2)"))
    value = F.coalesce(bare, F.when(F.size(values) == 1, F.element_at(values, 1)))
    return F.when(value > 0, value)


def paise(x: Column) -> Column:
    return F.round(x * 100).cast("long")
