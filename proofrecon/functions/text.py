"""Cell and text normalisation as native columns."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(x: Column, *steps) -> Column:
    """Apply ``steps`` one after another, each to the evaluated result of the one before.

    A column that a deep expression uses several times would be repeated in the plan at every use; bound as a lambda's
    variable it is evaluated once.
    """
    for step in steps:
        x = F.get(F.transform(F.array(x), step), F.lit(0))
    return x


def clean_cell(x: Column) -> Column:
    """Collapse all white space (no-break spaces too) and trim; null is empty."""
    return F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), r"(?U)\s+", " "))


#: Characters that compatibility composition turns into one ASCII character: full-width forms, raised and circled digits.
WIDE = {c: n for c in map(chr, range(0x80, 0xD800)) if len(n := unicodedata.normalize("NFKC", c)) == 1 and n.isascii()}
WIDE |= {chr(c): unicodedata.normalize("NFKC", chr(c)) for c in range(0xFF01, 0xFF5F)}


def clean_text(x: Column) -> Column:
    """Fold ``WIDE``, drop control and format characters but tab and line feed, collapse white space, blank to null."""
    kept = F.regexp_replace(F.translate(x, "".join(WIDE), "".join(WIDE.values())), r"[\p{Cc}\p{Cf}&&[^\t\n]]", "")
    return F.nullif(F.trim(F.regexp_replace(kept, r"(?U)\s+", " ")), F.lit(""))


def header_tokens(x: Column) -> Column:
    return F.regexp_extract_all(F.lower(clean_cell(x)), F.lit("[a-z0-9]+"), F.lit(0))


#: Words that a mask leaves readable.
STRUCTURAL = ("dr", "cr", "upi", "imps", "neft", "rtgs", "utr", "rrn", "ref", "jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")


def mask_cell(x: Column) -> Column:
    """Shape-preserving mask: digits to 9, letters to x or X, structural words kept."""
    tokens = F.regexp_extract_all(x, F.lit(r"[A-Za-z]+|[0-9]+|[^A-Za-z0-9]+"), F.lit(0))
    words = F.array(*map(F.lit, STRUCTURAL))
    return F.array_join(F.transform(tokens, lambda t: F.when(F.array_contains(words, F.lower(t)), t).otherwise(F.mask(t, F.lit("X"), F.lit("x"), F.lit("9")))), "")


def indian_grouping(amount: Column) -> Column:
    """A decimal with two places as rupees, grouped 3-2-2."""
    text = F.abs(amount).cast("decimal(18,2)").cast("string")
    whole = F.substring_index(text, ".", 1)
    head = F.substring(whole, F.lit(1), F.greatest(F.char_length(whole) - 3, F.lit(0)))
    grouped = F.concat(F.regexp_replace(head, r"(\d)(?=(\d{2})+$)", "$1,"), F.lit(","), F.right(whole, F.lit(3)))
    body = F.when(F.char_length(whole) > 3, grouped).otherwise(whole)
    return F.concat(F.when(amount < 0, "-").otherwise(""), F.lit("₹"), body, F.lit("."), F.substring_index(text, ".", -1))


def formula_guard(x: Column) -> Column:
    """Prefix an apostrophe where a spreadsheet would read a formula."""
    return F.when(x.rlike(r"^[=+\-@]"), F.concat(F.lit("'"), x)).otherwise(x)


def base_name(x: Column) -> Column:
    return F.regexp_extract(F.replace(x, F.lit("\\"), F.lit("/")), r"([^/]*)$", 1)


def url_part(x: Column, keep_at: bool = False) -> Column:
    """Percent-encoded with %20 for spaces; @ stays where an address needs it."""
    out = F.replace(F.url_encode(x), F.lit("+"), F.lit("%20"))
    return F.replace(out, F.lit("%40"), F.lit("@")) if keep_at else out
