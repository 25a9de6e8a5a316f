"""Verdicts as data for people: what a reply has to say, reasons of a re-check, the export and the report.

A reply is an array of (code, params); words are chosen last. The codes follow from a verdict's status, tier, confidence
level, reason and differences alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofrecon.functions.text import formula_guard
from proofrecon.operators.followup import KEY, RESOLVED

#: Confidence from which on a match is strong or fair.
STRONG, FAIR = 0.85, 0.60
#: What to ask for where a claim can't be verified yet, by the verdict's reason; a follow-up time comes first.
ASKS = {
    "before_start": "earlier_statement", "near_start": "earlier_statement", "no_amount": "tell_amount", "no_timestamp": "tell_time", "currency": "only_rupees", "low_parse_confidence": "clearer_statement",
    "no_rows": "empty_statement", "coverage_unknown": "check_dates", "coverage_inverted": "check_dates",
}


def confidence_level(confidence: Column) -> Column:
    """strong, fair or weak; null for what is no figure from 0 to 1."""
    sound = (confidence >= 0) & (confidence <= 1) & ~F.isnan(confidence)
    return F.when(sound, F.when(confidence >= STRONG, "strong").when(confidence >= FAIR, "fair").otherwise("weak"))


def _said(code: str, **params: Column) -> Column:
    given = F.create_map(*(x for name, c in params.items() for x in (F.lit(name), c.cast("string")))) if params else F.create_map().cast("map<string,string>")
    return F.struct(F.lit(code).alias("code"), given.alias("params"))


def reply_parts() -> Column:
    """array of struct(code, params) in the order in which a reply says them.

    Reads status, tier, row_id, confidence, reason, follow_up_after and diffs (array of field, claimed, shown).
    """
    status, reason = F.col("status"), F.col("reason")
    is_ = lambda *names: status.isin(*names)
    level = confidence_level(F.col("confidence"))
    waits = is_("Can't verify yet")
    ask = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for pair in ASKS.items() for x in pair)), F.coalesce(reason, F.lit(""))), F.lit("newer_statement"))
    differing = F.array_join(F.transform(F.array_sort("diffs"), lambda d: F.concat_ws(" ", d["field"], F.coalesce(d["claimed"], F.lit("?")), F.lit("/"), F.coalesce(d["shown"], F.lit("?")))), "; ")
    told = [
        F.when(is_(*RESOLVED) & F.col("row_id").isNotNull(), _said("matched", row=F.col("row_id"))),
        F.when(is_(*RESOLVED) & level.isNotNull(), _said("strength", level=level)),
        F.when(is_("Likely Match") & (F.col("tier") == 2), _said("by_identity")),
        F.when(is_("Likely Match") & (F.col("tier") == 3), _said("by_time_only")),
        F.when(is_("Likely Match"), _said("send_reference")),
        F.when(is_("Contradicted") & (F.size("diffs") > 0), _said("differences", fields=differing)),
        F.when(is_("Contradicted") & (reason == "direction"), _said("money_went_out")),
        F.when(is_("Contradicted"), _said("check_details")),
        F.when(is_("Not found") & (reason == "lost_contest"), _said("taken")),
        F.when(is_("Not found"), _said("send_bank_reference")),
        F.when(is_("Duplicate") & (reason == "conflicting_names"), _said("different_names")),
        F.when(is_("Duplicate") & (reason == "duplicate"), _said("first_one_counts")),
        F.when(is_("Duplicate"), _said("send_own")),
        F.when(waits & F.col("follow_up_after").isNotNull(), _said("cover_until", date=F.date_format("follow_up_after", "dd MMM yyyy HH:mm"))),
        F.when(waits & F.col("follow_up_after").isNull(), F.struct(ask.alias("code"), F.create_map().cast("map<string,string>").alias("params"))),
    ]
    return F.array_compact(F.array(*told))


#: Our own wording of each code.
WORDS = {
    "matched": "It is line {row} of the statement.", "strength": "The evidence is {level}.", "by_identity": "Amount, time and payer fit, without a reference.", "by_time_only": "Only amount and time fit.",
    "send_reference": "Please send its reference number.", "differences": "These differ: {fields}.", "money_went_out": "The statement shows this reference as money that went out.", "check_details": "Please check the details once more.",
    "taken": "The only fitting line belongs to another payment.", "send_bank_reference": "Please send the reference that your bank shows.", "different_names": "The same reference came with different payer names.",
    "first_one_counts": "Another submission of this payment counts.", "send_own": "Please send the details of your own payment.", "cover_until": "A statement that reaches {date} is needed.", "earlier_statement": "An earlier statement is needed.",
    "newer_statement": "A newer statement is needed.", "tell_amount": "Please tell the amount.", "tell_time": "Please tell the day and the time.", "only_rupees": "Only payments in rupees can be checked.", "clearer_statement": "The statement couldn't be read well; another export is needed.",
    "empty_statement": "The statement has no transactions.", "check_dates": "The statement's dates couldn't be told.",
}


def worded(parts: Column) -> Column:
    """Reply parts as one text."""
    texts = F.create_map(*(F.lit(x) for pair in WORDS.items() for x in pair))

    def sentence(part: Column) -> Column:
        filled = F.element_at(texts, part["code"])
        for name in ("row", "level", "fields", "date"):
            filled = F.replace(filled, F.lit("{" + name + "}"), F.coalesce(F.element_at(part["params"], name), F.lit("")))
        return filled

    return F.array_join(F.transform(parts, sentence), " ")


def shared_reference_notes(rechecked: DataFrame, claims: DataFrame, verdicts: DataFrame) -> DataFrame:
    """batch_id, claim_id, reference, owner, owner_status: re-checked claims whose reference a resolved claim already holds.

    ``rechecked`` has the keys; ``claims`` c_ref. The first resolved claim of a reference owns it. The credit stays its own.
    """
    held = claims.join(verdicts.where(F.col("status").isin(*RESOLVED)).select(*KEY, "status"), KEY).where("c_ref is not null")
    owners = held.groupBy("batch_id", "c_ref").agg(F.min(F.struct("claim_id", "status")).alias("o"))
    mine = rechecked.select(*KEY).join(claims.select(*KEY, "c_ref"), KEY)
    return mine.join(owners, ["batch_id", "c_ref"]).select(*KEY, F.col("c_ref").alias("reference"), F.col("o.claim_id").alias("owner"), F.col("o.status").alias("owner_status"))


#: The export's columns.
EXPORT = ("claim_id", "payer", "amount", "reference", "status", "confidence_pct", "matched_row", "reasons", "differences", "follow_up_after", "suggested_reply")


def export_table(verdicts: DataFrame) -> DataFrame:
    """The export's eleven columns as guarded text, nulls as empty cells.

    Reads claim_id, payer, amount, reference, status, confidence, row_id, reasons (array), diffs, follow_up_after, reply.
    """
    told = {
        "claim_id": F.col("claim_id"), "payer": F.col("payer"), "amount": F.col("amount").cast("string"), "reference": F.col("reference"), "status": F.col("status"),
        "confidence_pct": F.round(F.coalesce("confidence", F.lit(0.0)) * 100).cast("int").cast("string"), "matched_row": F.col("row_id"), "reasons": F.concat_ws(" | ", "reasons"),
        "differences": F.concat_ws(" | ", F.transform("diffs", lambda d: F.concat(d["field"], F.lit(": claim="), F.coalesce(d["claimed"], F.lit("")), F.lit(", statement="), F.coalesce(d["shown"], F.lit(""))))),
        "follow_up_after": F.date_format("follow_up_after", "yyyy-MM-dd'T'HH:mm:ss"), "suggested_reply": F.col("reply"),
    }
    return verdicts.select(*(formula_guard(F.coalesce(told[name], F.lit(""))).alias(name) for name in EXPORT))


def write_export(table: DataFrame, path: str) -> None:
    """CSV files with a header and quoting as spreadsheets read it; a byte-order mark stands before each header."""
    marked = table.withColumnRenamed(table.columns[0], "﻿" + table.columns[0])
    marked.write.option("header", True).option("escape", '"').option("quoteAll", False).csv(path)


def escaped(text: Column) -> Column:
    """Text for HTML."""
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(sign), F.lit(name))
    return text


def report_lines(verdicts: DataFrame, claims: DataFrame, rows: DataFrame) -> DataFrame:
    """One HTML table row per verdict: claim, payer, amount, status, and the narration of its statement row or a dash."""
    lines = verdicts.select(*KEY, "status", "row_id").join(claims.select(*KEY, "payer", "amount"), KEY, "left").join(rows.select("batch_id", "row_id", "narration"), ["batch_id", "row_id"], "left")
    cells = [F.col("claim_id"), F.col("payer"), F.col("amount").cast("string"), F.col("status"), F.col("narration")]
    html = F.concat(*(x for c in cells for x in (F.lit("<td>"), escaped(F.coalesce(c, F.lit("—"))), F.lit("</td>"))))
    return lines.select(*KEY, F.concat(F.lit("<tr>"), html, F.lit("</tr>")).alias("html"))


def adapted_rows(rows: DataFrame, prefix: str = "st-") -> DataFrame:
    """Rows as a client reads them: prefixed ids, money as floating-point numbers, ISO times."""
    money = lambda c: F.col(c).cast("double").alias(c)
    return rows.select(F.concat(F.lit(prefix), "row_id").alias("row_id"), money("debit"), money("credit"), F.date_format("dt", "yyyy-MM-dd'T'HH:mm:ss").alias("dt"))


def status_report(verdicts: DataFrame, rows: DataFrame) -> DataFrame:
    """Per status the number of verdicts, and of those whose reference stands on the statement. ``verdicts``: reference."""
    told = rows.select("batch_id", F.col("ref").alias("reference"), "row_id")
    return verdicts.join(told, ["batch_id", "reference"], "left").groupBy("status").agg(F.count("*").alias("n"), F.count("row_id").alias("on_statement"))


def reference_recall(rows: DataFrame, claims: DataFrame) -> DataFrame:
    """Per batch how many of the credits' references some claim tells, and their share."""
    told = rows.where("ref is not null and credit is not null").select("batch_id", "ref").distinct()
    claimed = claims.select("batch_id", F.col("reference").alias("ref")).distinct().withColumn("claimed", F.lit(True))
    out = told.join(claimed, ["batch_id", "ref"], "left").groupBy("batch_id").agg(F.count("*").alias("n_refs"), F.count("claimed").alias("n_claimed"))
    return out.withColumn("recall", F.round(F.col("n_claimed") / F.col("n_refs"), 4))


def verified_share(labelled: DataFrame, by: str) -> DataFrame:
    """Per class the number of verdicts, of verified ones, and their share."""
    good = F.count_if(F.col("status") == "Verified")
    return labelled.groupBy(by).agg(F.count("*").alias("n"), good.alias("n_verified"), F.round(good / F.count("*"), 4).alias("share"))
