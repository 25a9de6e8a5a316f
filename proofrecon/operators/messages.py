"""Messages and model answers as loosely typed JSON: parsed as VARIANT, read by path, written as plain JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parsed(raw: Column) -> Column:
    """The JSON object from the first opening to the last closing brace of a text as VARIANT; null if there is none."""
    return F.try_parse_json(F.nullif(F.regexp_extract(raw, r"(?s)\{.*\}", 0), F.lit("")))


def kind_of(v: Column) -> Column:
    """string, array, object, number, boolean or null."""
    schema = F.schema_of_variant(v)
    told = {"STRING": "string", "ARRAY": "array", "OBJECT": "object", "BOOLEAN": "boolean", "VOID": "null"}
    out = F.when(v.isNull(), "null")
    for prefix, name in told.items():
        out = out.when(schema.startswith(prefix), name)
    return out.otherwise("number")


def text_at(v: Column, path: str) -> Column:
    """A string at a path, trimmed; null for other kinds, blanks and missing paths."""
    at = F.try_variant_get(v, path, "variant")
    return F.when(kind_of(at) == "string", F.nullif(F.trim(F.try_variant_get(v, path, "string")), F.lit("")))


def number_at(v: Column, path: str) -> Column:
    """A finite number at a path, also one that is told as a string; else null."""
    x = F.try_variant_get(v, path, "string").try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < 1e300), x)


def sender(v: Column) -> Column:
    """The address that a message is from, in lower case: told as a string, with or without a name, as an object or as a list of either."""
    told = F.coalesce(*(text_at(v, f"$.from{step}{field}") for step in ("", "[0]") for field in ("", ".email", ".address")))
    inside = F.regexp_extract(told, r"<([^<>]+)>", 1)
    return F.lower(F.trim(F.when(inside != "", inside).otherwise(told)))


def labels(v: Column) -> Column:
    """Labels as a sorted set in lower case; a lone string is one label, other kinds are none."""
    many = F.try_variant_get(v, "$.labels", "array<string>")
    one = F.when(text_at(v, "$.labels").isNotNull(), F.array(text_at(v, "$.labels")))
    return F.array_sort(F.array_distinct(F.transform(F.array_compact(F.coalesce(one, many, F.array().cast("array<string>"))), F.lower)))


def attachments(v: Column) -> Column:
    """Attachments with a file name, as they are told."""
    kind = "array<struct<id:string,filename:string,content_type:string,size_bytes:bigint>>"
    told = F.coalesce(F.try_variant_get(v, "$.attachments", kind), F.array().cast(kind))
    return F.filter(told, lambda a: F.coalesce(F.trim(a["filename"]) != "", F.lit(False)))


def message(raw: Column) -> Column:
    """struct(id, sender, subject, labels, injection, phishing, analysis, attachments, broken) of a message's JSON text.

    broken: no JSON object, or one without an id. Risk scores below 0 count as 0 and above 1 as 1; unknown ones are null.
    """
    v = parsed(raw)
    risk = lambda name: F.greatest(F.lit(0.0), F.least(F.lit(1.0), number_at(v, f"$.ai.risk.{name}")))
    known = lambda name: F.when(number_at(v, f"$.ai.risk.{name}").isNotNull(), risk(name)).alias(name)
    ident = F.coalesce(text_at(v, "$.id"), F.when(kind_of(F.try_variant_get(v, "$.id", "variant")) == "number", F.try_variant_get(v, "$.id", "string")))
    return F.struct(
        ident.alias("id"), sender(v).alias("sender"), text_at(v, "$.subject").alias("subject"), labels(v).alias("labels"), known("injection"), known("phishing"),
        F.coalesce(text_at(v, "$.analysis.state"), F.lit("unavailable")).alias("analysis"), attachments(v).alias("attachments"), ident.isNull().alias("broken"),
    )


def plain_json(**fields: Column) -> Column:
    """Fields as JSON: decimals as strings with their places, times in ISO form without a zone, nulls kept."""
    return F.to_json(F.struct(*(c.alias(name) for name, c in fields.items())), {"ignoreNullFields": "false", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss"})


def plain_money(amount: Column) -> Column:
    return amount.cast("decimal(18,2)").cast("string")


#: Labels that keep a message out, labels of a sender who isn't who they say, and the score that keeps it out.
BLOCKING_LABELS = ("ai:injection-risk", "ai:phishing", "local:injection-risk")
SPOOF_LABELS = ("dmarc-fail", "spf-fail")
RISKY = 0.5


def assessment() -> Column:
    """struct(decision, severity, reasons) of a message; reasons are struct(code, detail), graver ones first.

    Reads labels (array), injection, phishing, analysis (null where none was asked for), held, held_reason, hidden_text.
    Any reason quarantines. Unknown scores count as none.
    """
    reason = lambda code, detail: F.struct(F.lit(code).alias("code"), detail.cast("string").alias("detail"))
    among = lambda names: F.array_sort(F.array_intersect(F.coalesce("labels", F.array().cast("array<string>")), F.array(*map(F.lit, names))))
    when = lambda c, r: F.when(F.coalesce(c, F.lit(False)), r)
    two = lambda c: F.format_string("%.2f", F.col(c))
    grave = F.concat(
        F.array_compact(F.array(when(F.col("held"), reason("held", F.coalesce("held_reason", F.lit("unknown")))))),
        F.transform(among(BLOCKING_LABELS), lambda x: reason("label", x)),
        F.array_compact(F.array(when(F.col("injection") >= RISKY, reason("injection", two("injection"))), when(F.col("phishing") >= RISKY, reason("phishing", two("phishing"))), when(F.col("hidden_text"), reason("hidden_text", F.lit(None))))),
    )
    spoof = among(SPOOF_LABELS)
    light = F.array_compact(F.array(when(F.size(spoof) > 0, reason("sender", F.array_join(spoof, ", "))), when(F.col("analysis") != "completed", reason("analysis", F.col("analysis")))))
    reasons = F.concat(grave, light)
    severity = F.when(F.size(grave) > 0, "high").when(F.size(light) > 0, "medium").otherwise("none")
    return F.struct(F.when(F.size(reasons) > 0, "quarantined").otherwise("accepted").alias("decision"), severity.alias("severity"), reasons.alias("reasons"))


def intake_record() -> Column:
    """struct(status, subject, severity, reasons): a held message keeps its subject to itself."""
    a = assessment()
    held = F.coalesce("held", F.lit(False))
    return F.struct(F.when(held, "held").otherwise(a["decision"]).alias("status"), F.when(held, "(withheld)").otherwise(F.coalesce("subject", F.lit(""))).alias("subject"), a["severity"].alias("severity"), a["reasons"].alias("reasons"))
