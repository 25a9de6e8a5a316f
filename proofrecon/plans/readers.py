"""Queries on words, archives and messages that are rendered from the driver tables and read back, and on verdicts as data."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofrecon.operators import evidence, geometry, messages
from proofrecon.plans.views import view
from proofrecon.sources.archives import archive_entries

#: Rows of a rendered page.
PAGE = 40


def rendered_words(stmt: DataFrame) -> DataFrame:
    """Words of v_stmt as a printed table: money is flush right, every second page repeats the header, a mark follows the balance."""
    page, place = F.floor(F.col("k") / PAGE), F.col("k") % PAGE

    def word(text: Column | str, x0: Column | float, x1: Column | float, top: Column) -> Column:
        as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
        return F.struct(as_column(text).alias("text"), as_column(x0).cast("double").alias("x0"), as_column(x1).cast("double").alias("x1"), top.cast("double").alias("top"))

    top = place * 14 + 60
    flush = lambda c, x1: word(F.col(c).cast("string"), x1 - F.char_length(F.col(c).cast("string")) * 4.5, float(x1), top + 1)
    some = lambda c, x1: F.when(F.col(c).isNotNull(), flush(c, x1))
    body = F.array_compact(
        F.array(
            word(F.date_format("dt", "dd/MM/yyyy"), 30.0, 78.0, top), word(F.substring_index("narration", " ", 1), 100.0, 200.0, top), word(F.substring_index("narration", " ", -1), 205.0, 300.0, top + 2),
            some("debit", 380), some("credit", 460), flush("balance", 540), word("Cr", 543.0, 552.0, top + 1),
        )
    )
    rows = stmt.select(F.col("batch_id").alias("file"), page.alias("page"), F.explode(body).alias("w"))
    at = F.lit(30.0)
    head = F.array(word("Date", 30.0, 50.0, at), word("Narration", 100.0, 150.0, at), word("Debit", 355.0, 380.0, at), word("Credit", 432.0, 460.0, at), word("Balance", 500.0, 540.0, at), word("INR", 545.0, 560.0, at + 1))
    heads = stmt.select(F.col("batch_id").alias("file"), page.alias("page")).distinct().where("page % 2 = 0").select("file", "page", F.explode(head).alias("w"))
    return rows.unionByName(heads).select("file", "page", "w.*")


GEOMETRY_SQL = f"""
SELECT batch_id AS file, CAST(floor(k / {PAGE}) AS BIGINT) AS page, k % {PAGE} + CASE WHEN floor(k / {PAGE}) % 2 = 0 THEN 1 ELSE 0 END AS line,
 concat_ws('|', strftime(dt, '%d/%m/%Y'), narration, coalesce(CAST(debit AS VARCHAR), ''), coalesce(CAST(credit AS VARCHAR), ''), concat(CAST(balance AS VARCHAR), ' Cr')) AS cells FROM v_stmt
UNION ALL SELECT DISTINCT batch_id, CAST(floor(k / {PAGE}) AS BIGINT), 0, 'Date|Narration|Debit|Credit|Balance' FROM v_stmt WHERE floor(k / {PAGE}) % 2 = 0"""


def q02_table_geometry(spark, sf_dir) -> DataFrame:
    """Statement rows from positioned words, over pages with and without a header of their own."""
    cells = geometry.table_cells(rendered_words(view(spark, sf_dir, "v_stmt")))
    return cells.select("file", F.col("page").cast("long").alias("page"), F.col("line").cast("long").alias("line"), F.array_join("cells", "|").alias("cells"))


def _zipped(frame: pd.DataFrame) -> pd.DataFrame:
    """One conversation as an exported chat: a picture per turn, one of three no picture, and lines that name them."""
    out, told = io.BytesIO(), []
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for turn, role, text in zip(frame["turn"], frame["role"], frame["text"], strict=True):
            name = f"IMG-{turn:05d}.{'png' if turn % 2 else 'jpg'}"
            sign = b"\x89PNG\r\n\x1a\n" if turn % 2 else b"\xff\xd8\xff"
            z.writestr(("../" if turn % 7 == 6 else "media\\") + name, (b"GIF89a" if turn % 3 == 2 else sign) + (text or "").encode())
            told.append(f"[10/10/26, 4:{turn % 60:02d}:30 PM] {role}: <attached: {name}>" if turn % 2 else f"10/10/26, 4:{turn % 60:02d} pm - {role}: {name} (file attached)")
        z.writestr("_chat.txt", "\n".join(told))
    return pd.DataFrame({"archive": [frame["conv_id"].iloc[0]], "content": [out.getvalue()]})


ARCHIVE_SQL = """
WITH c AS (SELECT conv_id, turn, role, coalesce(text, '') AS t, turn % 7 <> 6 AND turn % 3 <> 2 AS fine, concat('IMG-', lpad(CAST(turn AS VARCHAR), 5, '0'), CASE WHEN turn % 2 = 1 THEN '.png' ELSE '.jpg' END) AS entry FROM conversations),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id, fine ORDER BY entry) AS r FROM c)
SELECT conv_id AS archive, entry, CASE WHEN NOT fine THEN 'other' WHEN r > 3 THEN 'over' ELSE 'image' END AS kind, CASE WHEN fine AND r <= 3 THEN r ELSE 0 END AS place, role AS sender,
 concat('10/10/26, 4:', lpad(CAST(turn % 60 AS VARCHAR), 2, '0'), CASE WHEN turn % 2 = 1 THEN ':30 PM' ELSE ' pm' END) AS sent, strlen(t) + CASE WHEN turn % 3 = 2 THEN 6 WHEN turn % 2 = 1 THEN 8 ELSE 3 END AS size FROM n
UNION ALL SELECT DISTINCT conv_id, '_chat.txt', 'other', 0, NULL, NULL, NULL FROM c"""


def q05b_archive_entries(spark, sf_dir) -> DataFrame:
    """Every conversation as a chat archive, opened again: at most three pictures each, with who sent them and when."""
    chats = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    kind = chats.schema["conv_id"].dataType.simpleString()
    ordered = lambda frame: _zipped(frame.sort_values("turn"))
    archives = chats.groupBy("conv_id").applyInPandas(ordered, f"archive {kind}, content binary")
    found = archive_entries(archives, most=3)
    return found.select("archive", "entry", "kind", "place", "sender", "sent", F.when(F.col("entry") != "_chat.txt", F.col("size")).alias("size"))


_MESSAGE = """
concat(CASE CAST(event_id % 5 AS INT) WHEN 1 THEN 'Here it is: ' WHEN 2 THEN '```json ' ELSE '' END, '{"id": ', CASE WHEN event_id % 2 = 0 THEN concat('"', CAST(event_id AS STRING), '"') ELSE CAST(event_id AS STRING) END,
 ', "from": ', CASE CAST(event_id % 6 AS INT) WHEN 0 THEN concat('"User', CAST(user_id AS STRING), '@Mail.example"') WHEN 1 THEN concat('"A User <user', CAST(user_id AS STRING), '@mail.example>"') WHEN 2 THEN concat('{"name": "A", "email": "user', CAST(user_id AS STRING), '@mail.example"}')
 WHEN 3 THEN concat('["user', CAST(user_id AS STRING), '@mail.example", "b@x"]') WHEN 4 THEN concat('[{"address": "USER', CAST(user_id AS STRING), '@mail.example"}]') ELSE 'null' END,
 ', "subject": ', CASE WHEN event_id % 7 = 0 THEN '7' WHEN event_id % 7 = 1 THEN '"  "' ELSE '" Statement "' END, ', "labels": ', CASE CAST(event_id % 4 AS INT) WHEN 0 THEN '["INBOX", "spf_fail", "inbox"]' WHEN 1 THEN '"Blocked"' WHEN 2 THEN '[]' ELSE '{"a": 1}' END,
 ', "ai": {"risk": {"injection": ', CASE CAST(event_id % 3 AS INT) WHEN 0 THEN '0.25' WHEN 1 THEN '"0.75"' ELSE '7' END, ', "phishing": ', CASE WHEN event_id % 3 = 0 THEN '"high"' WHEN event_id % 3 = 1 THEN '-1' ELSE '0.5' END, '}}',
 CASE WHEN event_id % 2 = 0 THEN ', "analysis": {"state": "complete"}' ELSE '' END, ', "attachments": [{"id": "1", "filename": "a.csv", "size_bytes": ', CAST(event_id AS STRING), '}, {"id": "2", "filename": " "}]', CASE WHEN event_id % 11 = 0 THEN ']' ELSE '}' END, CASE WHEN event_id % 5 = 2 THEN ' ``` done' ELSE '' END)"""

MESSAGE_SQL = """
SELECT event_id AS id, event_id % 11 = 0 AS broken, CASE WHEN event_id % 11 <> 0 THEN CAST(event_id AS VARCHAR) END AS told_id, CASE WHEN event_id % 11 <> 0 AND event_id % 6 <> 5 THEN concat('user', CAST(user_id AS VARCHAR), '@mail.example') END AS sender,
 CASE WHEN event_id % 11 <> 0 AND event_id % 7 > 1 THEN 'Statement' END AS subject, CASE WHEN event_id % 11 <> 0 AND event_id % 4 = 0 THEN 'inbox,spf_fail' WHEN event_id % 11 <> 0 AND event_id % 4 = 1 THEN 'blocked' ELSE '' END AS labels,
 CASE WHEN event_id % 11 <> 0 THEN CASE event_id % 3 WHEN 0 THEN 0.25 WHEN 1 THEN 0.75 ELSE 1.0 END END AS injection, CASE WHEN event_id % 11 <> 0 THEN CASE event_id % 3 WHEN 1 THEN 0.0 WHEN 2 THEN 0.5 END END AS phishing,
 CASE WHEN event_id % 11 <> 0 AND event_id % 2 = 0 THEN 'complete' ELSE 'unavailable' END AS analysis, CASE WHEN event_id % 11 <> 0 THEN 1 ELSE 0 END AS attachments FROM events"""


def q41b_messages(spark, sf_dir) -> DataFrame:
    """Messages of every event as loosely typed JSON with junk around it, some of them broken."""
    raw = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("id"), F.expr(_MESSAGE).alias("raw"))
    rows = raw.select("id", messages.message(F.col("raw")).alias("m"))
    return rows.select("id", "m.broken", F.col("m.id").alias("told_id"), "m.sender", "m.subject", F.array_join("m.labels", ",").alias("labels"), "m.injection", "m.phishing", "m.analysis", F.size("m.attachments").alias("attachments"))


JSON_SQL = """
SELECT row_id, concat('{"row_id":"', row_id, '","datetime":"', strftime(dt, '%Y-%m-%dT%H:%M:%S'), '","debit":', CASE WHEN debit IS NULL THEN 'null' ELSE concat('"', CAST(debit AS VARCHAR), '"') END, ',"credit":', CASE WHEN credit IS NULL THEN 'null' ELSE concat('"', CAST(credit AS VARCHAR), '"') END,
 ',"reference":', CASE WHEN ref IS NULL THEN 'null' ELSE concat('"', ref, '"') END, ',"narration":"', replace(narration, '"', '\\"'), '"}') AS json FROM v_stmt"""


def q62b_json_rows(spark, sf_dir) -> DataFrame:
    """Statement rows as plain JSON."""
    c = F.col
    told = messages.plain_json(row_id=c("row_id"), datetime=c("dt"), debit=messages.plain_money(c("debit")), credit=messages.plain_money(c("credit")), reference=c("ref"), narration=c("narration"))
    return view(spark, sf_dir, "v_stmt").select("row_id", told.alias("json"))


ASSESS_SQL = """
WITH m AS (SELECT event_id AS id, (event_id % 21) / 20.0 AS injection, (event_id % 13) / 12.0 AS phishing, CASE CAST(event_id % 5 AS INT) WHEN 0 THEN 'dmarc-fail, spf-fail' WHEN 1 THEN 'spf-fail' END AS spoof, event_id % 5 = 2 AS bad, event_id % 19 = 0 AS held, event_id % 23 = 0 AS hidden,
 CASE CAST(event_id % 7 AS INT) WHEN 0 THEN NULL WHEN 1 THEN 'running' ELSE 'completed' END AS analysis FROM events),
r AS (SELECT *, concat_ws('; ', CASE WHEN held THEN concat('held ', CASE WHEN id % 2 = 0 THEN 'policy' ELSE 'unknown' END) END, CASE WHEN bad THEN 'label ai:phishing' END, CASE WHEN injection >= 0.5 THEN printf('injection %.2f', injection) END, CASE WHEN phishing >= 0.5 THEN printf('phishing %.2f', phishing) END, CASE WHEN hidden THEN 'hidden_text' END) AS grave,
 concat_ws('; ', CASE WHEN spoof IS NOT NULL THEN concat('sender ', spoof) END, CASE WHEN analysis = 'running' THEN 'analysis running' END) AS light FROM m)
SELECT id, CASE WHEN held THEN 'held' WHEN grave <> '' OR light <> '' THEN 'quarantined' ELSE 'accepted' END AS status, CASE WHEN held THEN '(withheld)' WHEN id % 3 = 0 THEN '' ELSE concat('About ', id) END AS subject,
 CASE WHEN grave <> '' THEN 'high' WHEN light <> '' THEN 'medium' ELSE 'none' END AS severity, concat_ws('; ', nullif(grave, ''), nullif(light, '')) AS reasons FROM r"""


def q41c_assessments(spark, sf_dir) -> DataFrame:
    """A record for every event's message: what the policy decides by labels, scores and states, held ones without their subject."""
    e = F.col("event_id")
    sets = F.array(*(F.array(*map(F.lit, x)) if x else F.lit(None).cast("array<string>") for x in (("spf-fail", "inbox", "dmarc-fail"), ("spf-fail",), ("ai:phishing", "x"), ("inbox",), None)))
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        e.alias("id"), F.get(sets, (e % 5).cast("int")).alias("labels"), ((e % 21) / 20).alias("injection"), ((e % 13) / 12).alias("phishing"), F.when(e % 7 == 1, "running").when(e % 7 > 1, "completed").alias("analysis"),
        (e % 19 == 0).alias("held"), F.when(e % 2 == 0, "policy").alias("held_reason"), (e % 23 == 0).alias("hidden_text"), F.when(e % 3 != 0, F.concat(F.lit("About "), e.cast("string"))).alias("subject"),
    )
    told = rows.select("id", messages.intake_record().alias("r"))
    return told.select("id", "r.status", "r.subject", "r.severity", F.array_join(F.transform("r.reasons", lambda x: F.concat_ws(" ", x["code"], x["detail"])), "; ").alias("reasons"))


_STATUS = ("Verified", "Likely Match", "Contradicted", "Not found", "Can't verify yet", "Duplicate")
_REASON = ("assigned", "direction", "lost_contest", "conflicting_names", "duplicate", "before_start", "no_amount", "no_timestamp", "currency", "low_parse_confidence", "no_rows", "coverage_unknown", "after_end")
_quoted = lambda words: ", ".join("'" + w.replace("'", "''") + "'" for w in words)
_TOLD = f"""SELECT *, [{_quoted(_STATUS)}][CAST(pos % 6 AS INT) + 1] AS status, [{_quoted(_REASON)}][CAST(k % 13 AS INT) + 1] AS reason, CASE WHEN pos % 4 > 1 THEN CAST(pos % 4 AS INT) END AS tier,
 CASE WHEN pos % 9 = 8 THEN 1.5 ELSE (pos % 9) / 8.0 END AS confidence, CASE WHEN pos % 5 <> 4 THEN concat('R', CAST(pos AS VARCHAR)) END AS row_id, CASE WHEN k % 13 = 12 THEN ts END AS follow, pos % 3 = 0 AS differs FROM v_claims"""


def _told(spark, sf_dir) -> DataFrame:
    """Claims with verdicts by arithmetic, every status with every reason."""
    pick = lambda words, n: F.get(F.array(*map(F.lit, words)), n.cast("int"))
    pos, k = F.col("pos"), F.col("k")
    diff = F.array(F.struct(F.lit("amount").alias("field"), F.col("amount").cast("string").alias("claimed"), F.lit("1.00").alias("shown")))
    return view(spark, sf_dir, "v_claims").withColumns(
        {
            "status": pick(_STATUS, pos % 6), "reason": pick(_REASON, k % 13), "tier": F.when(pos % 4 > 1, (pos % 4).cast("int")), "confidence": F.when(pos % 9 == 8, 1.5).otherwise((pos % 9) / 8.0),
            "row_id": F.when(pos % 5 != 4, F.concat(F.lit("R"), pos.cast("string"))), "follow_up_after": F.when(k % 13 == 12, F.col("ts")), "diffs": F.when(pos % 3 == 0, diff).otherwise(F.slice(diff, 1, 0)),
        }
    )


_ASK = "CASE " + " ".join(f"WHEN reason = '{r}' THEN '{a}'" for r, a in evidence.ASKS.items()) + " ELSE 'newer_statement' END"
REPLY_SQL = f"""
SELECT claim_id, concat_ws(' ', CASE WHEN pos % 6 < 2 AND row_id IS NOT NULL THEN concat('matched:', row_id) END, CASE WHEN pos % 6 < 2 AND confidence <= 1 THEN concat('strength:', CASE WHEN confidence >= 0.85 THEN 'strong' WHEN confidence >= 0.6 THEN 'fair' ELSE 'weak' END) END,
 CASE WHEN pos % 6 = 1 AND tier = 2 THEN 'by_identity' WHEN pos % 6 = 1 AND tier = 3 THEN 'by_time_only' END, CASE WHEN pos % 6 = 1 THEN 'send_reference' END, CASE WHEN pos % 6 = 2 AND differs THEN concat('differences:amount ', coalesce(CAST(amount AS VARCHAR), '?'), ' / 1.00') END,
 CASE WHEN pos % 6 = 2 AND reason = 'direction' THEN 'money_went_out' END, CASE WHEN pos % 6 = 2 THEN 'check_details' END, CASE WHEN pos % 6 = 3 AND reason = 'lost_contest' THEN 'taken' END, CASE WHEN pos % 6 = 3 THEN 'send_bank_reference' END,
 CASE WHEN pos % 6 = 5 AND reason = 'conflicting_names' THEN 'different_names' WHEN pos % 6 = 5 AND reason = 'duplicate' THEN 'first_one_counts' END, CASE WHEN pos % 6 = 5 THEN 'send_own' END,
 CASE WHEN pos % 6 = 4 AND follow IS NOT NULL THEN concat('cover_until:', strftime(follow, '%d %b %Y %H:%M')) WHEN pos % 6 = 4 THEN {_ASK} END) AS parts FROM ({_TOLD}) t"""


def q66b_reply_parts(spark, sf_dir) -> DataFrame:
    """What the reply to every claim has to say, as codes with their values."""
    parts = F.transform(evidence.reply_parts(), lambda p: F.concat_ws(":", p["code"], F.get(F.map_values(p["params"]), F.lit(0))))
    return _told(spark, sf_dir).select("claim_id", F.array_join(parts, " ").alias("parts"))


NOTES_SQL = f"""
WITH c AS (SELECT *, 'R' || CAST(k // 12 AS VARCHAR) AS g FROM ({_TOLD}) t),
o AS (SELECT batch_id, g, min(claim_id) AS owner, arg_min(status, claim_id) AS owner_status FROM c WHERE pos % 6 < 2 GROUP BY batch_id, g)
SELECT claim_id, concat('7', lpad(substr(c.g, 2), 11, '0')) AS reference, owner, owner_status FROM c JOIN o ON o.batch_id = c.batch_id AND o.g = c.g WHERE pos % 6 IN (3, 4)"""


def q50b_shared_references(spark, sf_dir) -> DataFrame:
    """Claims to re-check whose reference belongs to a claim that is resolved."""
    told = _told(spark, sf_dir).withColumn("c_ref", F.format_string("7%011d", F.floor(F.col("k") / 12)))
    again = told.where(F.col("status").isin("Not found", "Can't verify yet"))
    return evidence.shared_reference_notes(again, told.select("batch_id", "claim_id", "c_ref"), told.select("batch_id", "claim_id", "status")).drop("batch_id")


EXPORT_SQL = f"""
SELECT claim_id, CASE WHEN pos % 8 = 0 THEN concat('''=', coalesce(payer_name, '')) ELSE coalesce(payer_name, '') END AS payer, CAST(amount AS VARCHAR) AS amount, coalesce(reference, '') AS reference, status, CAST(CAST(round(confidence * 100) AS INT) AS VARCHAR) AS confidence_pct,
 coalesce(row_id, '') AS matched_row, concat(reason, CASE WHEN tier IS NULL THEN '' ELSE concat(' | tier ', CAST(tier AS VARCHAR)) END) AS reasons, CASE WHEN differs THEN concat('amount: claim=', CAST(amount AS VARCHAR), ', statement=1.00') ELSE '' END AS differences,
 coalesce(strftime(follow, '%Y-%m-%dT%H:%M:%S'), '') AS follow_up_after, '''- thanks' AS suggested_reply FROM ({_TOLD}) t"""


def q60b_export(spark, sf_dir) -> DataFrame:
    """All eleven columns of the export."""
    payer = F.when(F.col("pos") % 8 == 0, F.concat(F.lit("="), F.coalesce("payer_name", F.lit("")))).otherwise(F.col("payer_name"))
    reasons = F.array_compact(F.array(F.col("reason"), F.concat(F.lit("tier "), F.col("tier").cast("string"))))
    return evidence.export_table(_told(spark, sf_dir).withColumn("payer", payer).withColumn("reasons", reasons).withColumn("reply", F.lit("- thanks")))


REPORT_SQL = f"""
SELECT c.claim_id, concat('<tr><td>', c.claim_id, '</td><td>', coalesce(replace(payer_name || ' <&>', ' <&>', ' &lt;&amp;&gt;'), '—'), '</td><td>', CAST(c.amount AS VARCHAR), '</td><td>', replace(c.status, '''', '&#39;'), '</td><td>', coalesce(r.narration, '—'), '</td></tr>') AS html
FROM ({_TOLD}) c LEFT JOIN v_stmt r ON r.batch_id = c.batch_id AND r.pos = c.pos AND c.row_id IS NOT NULL"""


def q61b_report_lines(spark, sf_dir) -> DataFrame:
    """The printed report's line of every claim, escaped, with its statement row's narration."""
    told = _told(spark, sf_dir)
    verdicts = told.select("batch_id", "claim_id", "status", F.when(F.col("row_id").isNotNull(), F.format_string("S%09d", "pos")).alias("row_id"))
    claims = told.select("batch_id", "claim_id", F.concat("payer_name", F.lit(" <&>")).alias("payer"), "amount")
    return evidence.report_lines(verdicts, claims, view(spark, sf_dir, "v_stmt")).select("claim_id", "html")


QUERIES = {
    "q02_table_geometry": (q02_table_geometry, GEOMETRY_SQL),
    "q05b_archive_entries": (q05b_archive_entries, ARCHIVE_SQL),
    "q41b_messages": (q41b_messages, MESSAGE_SQL),
    "q41c_assessments": (q41c_assessments, ASSESS_SQL),
    "q62b_json_rows": (q62b_json_rows, JSON_SQL),
    "q66b_reply_parts": (q66b_reply_parts, REPLY_SQL),
    "q50b_shared_references": (q50b_shared_references, NOTES_SQL),
    "q60b_export": (q60b_export, EXPORT_SQL),
    "q61b_report_lines": (q61b_report_lines, REPORT_SQL),
}
