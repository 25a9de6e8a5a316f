"""Fields read from payment screenshots.

Each function gives a struct of value, notes (why a value is missing or changed) and, where it lowers trust, penalty.
What isn't certain is null and noted; a null or blank field is null without a note.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from proofrecon.functions import amounts, dates
from proofrecon.functions.text import clean_text, let

#: What a screenshot may call the rupee.
RUPEE_WORDS = ("rs", "inr", "rupee", "rupees")
#: Words in a status text; failed is asked before pending, pending before success.
STATUS_WORDS = {
    "failed": ("fail", "declin", "unsuccess", "not success", "rejected", "cancel", "reversed"),
    "pending": ("pend", "process", "in progress", "initiated", "awaiting"),
    "success": ("success", "complet", "paid", "sent", "done"),
}
#: Names of payment apps; a key of up to four letters must be the whole text.
APPS = {
    "PhonePe": ("phonepe", "phone pe"),
    "Google Pay": ("google pay", "gpay", "g pay", "tez"),
    "Paytm": ("paytm",),
    "BHIM": ("bhim",),
    "Amazon Pay": ("amazon pay", "amazonpay"),
    "CRED": ("cred",),
}
#: Years that a claim may name.
YEARS = (2000, 2100)

_RUN = r"(\d(?:[\d.,]*\d)?)"
_RUPEES = "(?:" + "|".join(sorted(RUPEE_WORDS, key=len, reverse=True)) + ")"
_BEFORE = rf"(?i)(?:₹|(?<![a-z]){_RUPEES}\.?)\s*{_RUN}"
_BEHIND = rf"(?i)(?<![\d.,]){_RUN}\s*(?:/-|{_RUPEES}(?![a-z]))"
_TIME = rf"(?<![\d:]){dates.CLOCK} ?([ap]m)?(?![\d:])"
_ZONE = r"((?: ?(?:[+-]\d\d:?\d\d|ist|gmt|utc|z)\b)?)"
#: Shapes of a day: d one or two digits, y four, w a word.
DAY_SHAPES = ("d w y", "w d y", "d w d", "d/d/y", "d-d-y", "d.d.y", "d/d/d", "d-d-d", "y/d/d", "y-d-d")


def _notes(*notes: Column) -> Column:
    return F.array_compact(F.array(*notes)) if notes else F.array().cast("array<string>")


def _field(value: Column, *notes: Column, **more: Column) -> Column:
    return F.struct(value.alias("value"), _notes(*notes).alias("notes"), *(c.alias(name) for name, c in more.items()))


def reference(x: Column) -> Column:
    """struct(value, notes, penalty): the one number of twelve digits, in one run or in groups of four."""

    def found(s: Column) -> Column:
        runs = F.regexp_extract_all(s, F.lit(r"(?<!\d)(\d{12})(?!\d)"), F.lit(1))
        groups = F.regexp_extract_all(s, F.lit(r"(?<!\d)((?:\d{4}[ -]){2}\d{4})(?!\d)"), F.lit(1))
        groups = F.transform(groups, lambda g: F.translate(g, " -", ""))
        return F.struct(s.alias("s"), F.array_union(runs, groups).alias("every"), (F.size(F.array_except(groups, runs)) > 0).alias("joined"))

    def judged(f: Column) -> Column:
        one = F.when(F.size(f["every"]) == 1, F.get(f["every"], F.lit(0)))
        same = one == F.repeat(F.substring(one, 1, 1), F.lit(12))
        value = F.when(~same, one)
        why = (
            F.when(F.size(f["every"]) > 1, "several 12-digit numbers; reference left out")
            .when(F.size(f["every"]) == 0, "no 12-digit reference could be read")
            .when(same, "a reference of one repeated digit is refused")
            .when(f["joined"], "reference joined from groups")
        )
        penalty = F.when(value.isNotNull() & f["joined"], 0.95).otherwise(1.0)
        return _field(value, F.when(f["s"].isNotNull(), why), penalty=penalty)

    return let(clean_text(x), found, judged)


def _rupees(run: Column) -> Column:
    """A run of digits, commas and points as rupees, null unless its groups and at most two decimals make a number."""
    plain = run.rlike(r"^\d+(?:\.\d\d?)?$")
    grouped = run.rlike(amounts.COMMA_GROUPS) & ~run.rlike(r"\.\d{3}|^\d{3},\d\d,")
    return F.when(plain | grouped, F.translate(run, ",", "").try_cast("decimal(18,2)"))


def amount(x: Column) -> Column:
    """struct(value, notes, penalty, currency): a bare number, or the only amount that carries a rupee mark."""

    def found(s: Column) -> Column:
        marked = F.concat(F.regexp_extract_all(s, F.lit(_BEFORE), F.lit(1)), F.regexp_extract_all(s, F.lit(_BEHIND), F.lit(1)))
        values = F.array_distinct(F.array_compact(F.transform(marked, _rupees)))
        unmarked = _rupees(F.regexp_replace(s, r"(?i)^(?:₹|rs\.?|inr)\s*", ""))
        return F.struct(s.alias("s"), values.alias("values"), unmarked.alias("unmarked"))

    def judged(f: Column) -> Column:
        n = F.size(f["values"])
        read = F.when(n == 1, F.get(f["values"], F.lit(0))).when(n == 0, F.when(f["s"].rlike(r"^\d"), f["unmarked"]))
        value = F.when(read > 0, read)
        why = F.when(n > 1, "several different amounts; amount left out").when(read.isNull(), "no amount could be read").when(read <= 0, "an amount must be positive")
        penalty = F.when((n == 1) & f["unmarked"].isNull(), 0.9).otherwise(1.0)
        return _field(value, F.when(f["s"].isNotNull(), why), penalty=penalty, currency=F.when((n == 1) & value.isNotNull(), "INR"))

    return let(clean_text(x), found, judged)


def currency(x: Column, marker: Column) -> Column:
    """struct(value, notes): a code that the field or the amount's mark gives; null where they disagree."""

    def judged(s: Column) -> Column:
        code = F.rtrim(F.upper(s), F.lit("."))
        told = F.when((s == "₹") | F.lower(code).isin(*RUPEE_WORDS), "INR").when(code.rlike("^[A-Z]{3}$"), code)
        clash = F.coalesce(told != marker, F.lit(False))
        value = F.when(~clash, F.coalesce(told, marker))
        return _field(value, F.when(clash, "currency field and amount mark disagree"), F.when(value != "INR", F.concat(F.lit("currency other than INR: "), value)))

    return let(clean_text(x), judged)


def timestamp(x: Column) -> Column:
    """struct(iso, date, time, precision, notes): day first, a zone is noted and left out, half a timestamp isn't filled up.

    precision is datetime, date or time. Two times, an impossible time or a day in no known shape give nothing.
    """

    def plain(s: Column) -> Column:
        s = F.regexp_replace(F.lower(s), r"\b([ap])\. ?m\b\.?", "$1m")
        return F.regexp_replace(s, r"(?<=\d)t(?=\d)", " ")

    def apart(s: Column) -> Column:
        return F.split(F.regexp_replace(F.translate(s, "\u0001", " "), rf"^(.*?){_TIME}{_ZONE}(.*)$", "\u0001".join(f"${k}" for k in (1, 2, 3, 4, 5, 6, 7))), "\u0001")

    def read(part: Column) -> Column:
        h, m, s = (F.get(part, F.lit(k)).try_cast("int") for k in (1, 2, 3))
        half = F.get(part, F.lit(4))
        hour = F.when(half == "", h).when(h.between(1, 12), h % 12 + F.when(half == "pm", 12).otherwise(0))
        s = F.coalesce(s, F.lit(0))
        clock = F.when((hour < 24) & (m < 60) & (s < 60), F.format_string("%02d:%02d:%02d", hour, m, s))
        rest = F.concat_ws(" ", F.get(part, F.lit(0)), F.get(part, F.lit(6)))
        rest = F.regexp_replace(F.regexp_replace(rest, r"\b(?:at|on)\b|,", " "), " +", " ")
        rest = F.btrim(F.regexp_replace(rest, r"(?<=\d)(?:st|nd|rd|th)\b", ""), F.lit(" -/."))
        return F.struct(part.isNotNull().alias("given"), (F.size(part) > 1).alias("timed"), clock.alias("clock"), (F.get(part, F.lit(5)) != "").alias("zoned"), rest.alias("rest"))

    def dated(p: Column) -> Column:
        shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(p["rest"], "[a-z]+", "w"), r"(?<!\d)\d{4}(?!\d)", "y"), r"(?<!\d)\d\d?(?!\d)", "d")
        padded = F.regexp_replace(p["rest"], r"(?<!\d)(\d)(?!\d)", "0$1")
        day = F.when(shape.isin(*DAY_SHAPES), dates.parse_datetime(padded)["dt"])
        day = F.when(F.year(day).between(*YEARS), F.date_format(day, "yyyy-MM-dd"))
        return F.struct(*(p[n].alias(n) for n in ("given", "timed", "clock", "zoned", "rest")), day.alias("day"))

    def judged(p: Column) -> Column:
        bad_time, several = p["timed"] & p["clock"].isNull(), p["rest"].rlike(_TIME)
        unread = (p["rest"] != "") & p["day"].isNull()
        refused = F.when(bad_time, "impossible time").when(several, "several times; timestamp left out").when(unread, "no timestamp could be read")
        fine = p["given"] & refused.isNull()
        day, clock = F.when(fine, p["day"]), F.when(fine, p["clock"])
        half = F.when(day.isNotNull() & clock.isNull(), F.concat(F.lit("only a date could be read: "), day)).when(
            day.isNull() & clock.isNotNull(), F.concat(F.lit("only a time could be read: "), clock)
        )
        precision = F.when(day.isNotNull() & clock.isNotNull(), "datetime").when(day.isNotNull(), "date").when(clock.isNotNull(), "time")
        notes = _notes(F.when(p["given"], refused), F.when(fine & p["zoned"], "time zone left out"), half)
        iso = F.when(precision == "datetime", F.concat(day, F.lit("T"), clock))
        return F.struct(iso.alias("iso"), day.alias("date"), clock.alias("time"), precision.alias("precision"), notes.alias("notes"))

    return let(clean_text(x), plain, apart, read, dated, judged)


def name(x: Column) -> Column:
    """struct(value, notes): one letter at least; names in one case get a capital per word."""

    def judged(s: Column) -> Column:
        value = F.when(s.rlike(r"\p{L}"), F.when((F.upper(s) == s) | (F.lower(s) == s), F.initcap(F.lower(s))).otherwise(s))
        return _field(value, F.when(value != x, "name's case or spaces settled"))

    return let(clean_text(x), judged)


def address(x: Column) -> Column:
    """struct(value, notes, masked): a payment address in lower case; a masked one is kept and told."""

    def judged(s: Column) -> Column:
        parts = F.split(s, "@")
        local, bank = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
        fits = (F.size(parts) == 2) & F.char_length(local).between(2, 256) & F.char_length(bank).between(2, 64)
        fits &= local.rlike("^[a-z0-9]") & ~local.rlike(r"[^a-z0-9._*•-]") & bank.rlike("^[a-z]") & ~bank.rlike("[^a-z0-9]")
        masked = fits & local.rlike("[*•]")
        why = F.when(~fits, "not the form of a payment address").when(masked, "payment address is masked")
        return _field(F.when(fits, s), F.when(s.isNotNull(), why), masked=F.coalesce(masked, F.lit(False)))

    return let(F.regexp_replace(F.lower(clean_text(x)), " ", ""), judged)


def status(x: Column) -> Column:
    """struct(value, notes): failed, pending or success."""

    def judged(s: Column) -> Column:
        value = F.coalesce(*(F.when(s.rlike("|".join(words)), kind) for kind, words in STATUS_WORDS.items()))
        return _field(value, F.when(s.isNotNull() & value.isNull(), "unknown status text"))

    return let(F.lower(clean_text(x)), judged)


def app(x: Column) -> Column:
    """struct(value, notes): the payment app's name, a guess."""

    def judged(s: Column) -> Column:
        is_key = lambda key: s.contains(key) if len(key) > 4 else s == key
        value = F.coalesce(*(F.when(is_key(key), shown) for shown, keys in APPS.items() for key in keys))
        return _field(value, F.when(s.isNotNull() & value.isNull(), "unknown payment app"))

    return let(F.lower(clean_text(x)), judged)
