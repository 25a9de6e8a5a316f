"""After the verdicts: re-checks, tags, duplicates of images, replies, reports, evaluation."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from proofrecon.functions.references import find_tag, hamming256
from proofrecon.functions.text import formula_guard, indian_grouping, url_part

KEY = ["batch_id", "claim_id"]
RECHECKED = ("Can't verify yet", "Not found")
RESOLVED = ("Verified", "Likely Match")


def to_recheck(claims: DataFrame, verdicts: DataFrame, statuses: tuple[str, ...] = RECHECKED) -> DataFrame:
    """Claims without a verdict or with one of ``statuses``: an anti-join on the others."""
    return claims.join(verdicts.where(~F.col("status").isin(*statuses)).select(*KEY), KEY, "left_anti")


def unconsumed_rows(rows: DataFrame, claims: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Rows none of whose references belongs to a Verified or Likely claim."""
    used = claims.join(verdicts.where(F.col("status").isin(*RESOLVED)).select(*KEY), KEY).where("c_ref is not null")
    used = used.select("batch_id", F.col("c_ref").alias("ref")).distinct()
    hit = rows.select("batch_id", "row_id", F.explode("refs").alias("r")).select("batch_id", "row_id", F.col("r.ref").alias("ref")).join(used, ["batch_id", "ref"], "left_semi")
    return rows.join(hit.select("batch_id", "row_id").distinct(), ["batch_id", "row_id"], "left_anti")


def merged_verdicts(old: DataFrame, new: DataFrame) -> DataFrame:
    """The new verdict of each claim where there is one, else the old."""
    fresh = new.select(*KEY, F.col("status").alias("_new"))
    return old.join(fresh, KEY, "full").select(*KEY, F.coalesce("_new", "status").alias("status"))


def change_log(old: DataFrame, new: DataFrame) -> DataFrame:
    """before, after and whether they differ, for each re-checked claim."""
    before = old.select(*KEY, F.col("status").alias("before"))
    out = new.select(*KEY, F.col("status").alias("after")).join(before, KEY, "left")
    return out.withColumn("changed", ~F.col("before").eqNullSafe(F.col("after")))


def tag_status(issued: DataFrame, rows: DataFrame) -> DataFrame:
    """Issued tags (batch_id, tag, amount) against credits: paid, amount_differs, duplicate or not_found_yet."""
    paid = rows.where("credit is not null").select("batch_id", find_tag(F.col("narration")).alias("tag"), "credit", "row_id").where("tag is not null")
    per = paid.groupBy("batch_id", "tag").agg(F.count("*").alias("n"), F.min_by("credit", "row_id").alias("credit"))
    out = issued.join(per, ["batch_id", "tag"], "left")
    status = F.when(F.col("n").isNull(), "not_found_yet").when(F.col("n") > 1, "duplicate").when(F.abs(F.col("credit") - F.col("amount")) > 0.01, "amount_differs").otherwise("paid")
    return out.withColumn("tag_status", status)


def payment_link(payee: Column, name: Column, amount: Column, tag: Column) -> Column:
    """The payment address as a link."""
    money = F.format_string("%.2f", amount.cast("double"))
    return F.concat(F.lit("upi://pay?pa="), url_part(payee, True), F.lit("&pn="), url_part(name), F.lit("&am="), money, F.lit("&cu=INR&tn="), url_part(tag))


def near_hash_pairs(hashes: DataFrame, most: int = 6) -> DataFrame:
    """Pairs of (id, h: 64 hex digits) within ``most`` (under 7) bits: they share two of eight words, so an equi-join finds them.

    A pair is told at its first shared word only. Equal hashes meet at their group's first id, not pairwise:
    ``hash_members`` tells the others.
    """
    first = hashes.groupBy("h").agg(F.min("id").alias("rep"))
    words = first.select("rep", "h", F.posexplode(F.array(*(F.substring("h", 8 * k + 1, 8) for k in range(8)))).alias("k", "word"))
    a, b = words.alias("a"), words.alias("b")
    pairs = a.join(b, [F.col("a.k") == F.col("b.k"), F.col("a.word") == F.col("b.word"), F.col("a.rep") < F.col("b.rep")])
    bits = hamming256(F.col("a.h"), F.col("b.h"))
    return pairs.select(F.col("a.rep").alias("a"), F.col("b.rep").alias("b"), bits.alias("bits")).where(F.col("bits") <= most).distinct()


def hash_members(hashes: DataFrame) -> DataFrame:
    """Each (id, h)'s id with rep, the first id of the same hash: with ``near_hash_pairs`` every equal or near pair is told."""
    first = hashes.groupBy("h").agg(F.min("id").alias("rep"))
    return hashes.join(first, "h").select("id", "rep")


#: Follow-up order of statuses and our own wording by status and tone.
ORDER = ("Contradicted", "Duplicate", "Not found", "Can't verify yet", "Likely Match", "Verified")
REPLIES = {
    "Verified": "Thank you, your payment has been matched with our account.",
    "Likely Match": "We see a payment that is probably yours; please send its reference so that we can confirm it.",
    "Contradicted": "The reference you gave belongs to a different entry; please check the details.",
    "Duplicate": "This payment was submitted more than once; one submission is enough.",
    "Not found": "We could not find this payment in our account; please ask your bank for its reference.",
    "Can't verify yet": "Our statement does not cover this payment yet; we will look again later.",
}
CLOSINGS = {"friendly": " Many thanks!", "neutral": "", "formal": " Kind regards."}


def reply(status: Column, tone: str = "neutral") -> Column:
    out = F.lit(None).cast("string")
    for name, text in REPLIES.items():
        out = F.when(status == name, F.lit(text + CLOSINGS[tone])).otherwise(out)
    return out


#: Our own wording to payers; {ref: ...} is left out where there is no reference.
PAYER_REPLIES = {
    "en": {
        "greet": "Hello{name},",
        "Verified": "your payment of {amount}{ref: with reference } has reached us. Thank you!",
        "Likely Match": "we see a payment of {amount} that is probably yours. Please send its reference number, so that we can confirm it.",
        "Contradicted": "your details{ref: for reference } and our statement don't agree (you told us {amount}). Please check them once more.",
        "Not found": "we found no payment of {amount}{ref: with reference } in our account. Please send the UTR that your bank app shows.",
        "Duplicate": "this payment{ref: with reference } was sent to us for another payment too. Please send the details of your own.",
        "Can't verify yet": "we have your details for {amount}. Our statement doesn't reach that day yet; you need not do anything.",
    },
    "hi": {
        "greet": "नमस्ते{name},",
        "Verified": "{amount} का भुगतान{ref:, रेफरेंस } हमें मिल गया। धन्यवाद!",
        "Likely Match": "{amount} का एक भुगतान शायद आपका है। पुष्टि के लिए उसका रेफरेंस नंबर भेजें।",
        "Contradicted": "आपका विवरण{ref:, रेफरेंस } हमारे स्टेटमेंट से अलग है (आपने {amount} बताया)। कृपया फिर से देखें।",
        "Not found": "{amount} का भुगतान{ref:, रेफरेंस } हमारे खाते में नहीं मिला। कृपया बैंक ऐप में दिखा UTR भेजें।",
        "Duplicate": "यही भुगतान{ref:, रेफरेंस } किसी और भुगतान के लिए भी आया है। कृपया अपना विवरण भेजें।",
        "Can't verify yet": "{amount} का विवरण मिल गया। हमारा स्टेटमेंट उस दिन तक का नहीं है; आपको कुछ नहीं करना है।",
    },
    "te": {
        "greet": "నమస్తే{name},",
        "Verified": "{amount} చెల్లింపు{ref:, రిఫరెన్స్ } మాకు అందింది. ధన్యవాదాలు!",
        "Likely Match": "{amount} చెల్లింపు ఒకటి బహుశా మీదే. నిర్ధారణకు దాని రిఫరెన్స్ నంబర్ పంపండి.",
        "Contradicted": "మీ వివరాలు{ref:, రిఫరెన్స్ } మా స్టేట్‌మెంట్‌తో కలవడం లేదు (మీరు {amount} అన్నారు). దయచేసి మళ్లీ చూడండి.",
        "Not found": "{amount} చెల్లింపు{ref:, రిఫరెన్స్ } మా ఖాతాలో లేదు. బ్యాంక్ యాప్‌లోని UTR పంపండి.",
        "Duplicate": "ఇదే చెల్లింపు{ref:, రిఫరెన్స్ } మరో చెల్లింపుకూ వచ్చింది. దయచేసి మీ వివరాలు పంపండి.",
        "Can't verify yet": "{amount} వివరాలు అందాయి. మా స్టేట్‌మెంట్ ఆ రోజు వరకు లేదు; మీరు ఏమీ చేయనవసరం లేదు.",
    },
}


def payer_reply(status: Column, lang: Column, name: Column, amount: Column, reference: Column) -> Column:
    """A message to the payer by status and language (en, hi, te); null for others. A null amount shows as ₹—, a name to 40 characters."""

    def filled(template: str) -> Column:
        head, *rest = re.split(r"\{ref:([^}]*)\}", template)
        parts = [F.replace(F.lit(head), F.lit("{amount}"), F.coalesce(indian_grouping(amount), F.lit("₹—")))]
        for word, tail in zip(rest[::2], rest[1::2], strict=True):
            parts.append(F.coalesce(F.concat(F.lit(word), reference), F.lit("")))
            parts.append(F.replace(F.lit(tail), F.lit("{amount}"), F.coalesce(indian_grouping(amount), F.lit("₹—"))))
        return F.concat(*parts)

    out = F.lit(None).cast("string")
    called = F.substring(F.trim(F.coalesce(name, F.lit(""))), 1, 40)
    called = F.when(called == "", "").otherwise(F.concat(F.lit(" "), called))
    for code, texts in PAYER_REPLIES.items():
        greeting = F.replace(F.lit(texts["greet"] + " "), F.lit("{name}"), called)
        for told in ORDER:
            out = F.when((lang == code) & (status == told), F.concat(greeting, filled(texts[told]))).otherwise(out)
    return out


def display_signals() -> Column:
    """Signals for the reader of a verdict, array of struct(mark, label, detail): reference, amount, date or time, payer name.

    Reads status, coverage_end, the claim's c_ref, c_paise, c_ts, c_name and its row's row_id, narration, r_paise, r_dt.
    A row's time at midnight counts as a date only. A claim that waits for coverage has one signal.
    """

    def signal(mark: str, label: str, detail: Column | str) -> Column:
        return F.struct(F.lit(mark).alias("mark"), F.lit(label).alias("label"), (F.lit(detail) if isinstance(detail, str) else detail).alias("detail"))

    rupees = lambda x: indian_grouping((F.col(x) / 100).cast("decimal(18,2)"))
    words = lambda x: F.filter(F.split(F.lower(F.coalesce(x, F.lit(""))), "[^a-z0-9]+"), lambda w: F.char_length(w) >= 3)
    row, ref = F.col("row_id").isNotNull(), F.col("c_ref")
    reference = (
        F.when(ref.isNull(), signal("warn", "Reference", "The screenshot shows no 12-digit reference."))
        .when(~row, signal("warn", "Reference", F.concat(ref, F.lit(" isn't on the statement."))))
        .when(F.coalesce(F.contains("narration", ref), F.lit(False)), signal("ok", "Reference", "The statement's line has it."))
        .otherwise(signal("warn", "Reference", "The statement's line hasn't it."))
    )
    amount = F.when(F.col("c_paise") == F.col("r_paise"), signal("ok", "Amount", F.concat(F.lit("Both tell "), rupees("r_paise"), F.lit(".")))).when(
        F.col("c_paise") != F.col("r_paise"), signal("warn", "Amount", F.concat(F.lit("Screenshot "), rupees("c_paise"), F.lit(", statement "), rupees("r_paise"), F.lit(".")))
    )
    day_only = F.date_format("r_dt", "HH:mm:ss") == "00:00:00"
    same_day = F.to_date("c_ts") == F.to_date("r_dt")
    minutes = F.round(F.abs(F.timestamp_diff("SECOND", F.col("c_ts"), F.col("r_dt"))) / 60).cast("long")
    gap = F.when(minutes < 90, F.concat(minutes.cast("string"), F.lit(" min"))).otherwise(F.concat(F.round(minutes / 60, 1).cast("decimal(18,1)").cast("string"), F.lit(" h")))
    apart = F.concat(gap, F.lit(" apart."))
    time = (
        F.when(day_only & same_day, signal("ok", "Date", "The statement tells the day only; it is the same."))
        .when(day_only & ~same_day, signal("warn", "Date", "The statement tells another day."))
        .when(minutes <= 30, signal("ok", "Time", apart))
        .when(minutes.isNotNull(), signal("warn", "Time", apart))
    )
    own = words(F.col("c_name"))
    shared = F.get(F.array_intersect(own, words(F.col("narration"))), F.lit(0))
    payer = (
        F.when(F.size(own) == 0, signal("info", "Payer name", "The screenshot shows no payer name."))
        .when(shared.isNotNull(), signal("ok", "Payer name", F.concat(F.lit("Both have "), shared, F.lit("."))))
        .otherwise(signal("warn", "Payer name", "The statement's line has no part of the name."))
    )
    waiting = F.array(signal("info", "Coverage", F.concat(F.lit("The statement ends "), F.coalesce(F.date_format("coverage_end", "yyyy-MM-dd"), F.lit("earlier")), F.lit("; it can't be checked yet."))))
    alone = F.array(reference, signal("warn", "Statement", "No credit fits this claim."))
    return F.when((F.col("status") == "Can't verify yet") & ~row, waiting).when(~row, alone).otherwise(F.array_compact(F.array(reference, amount, time, payer)))


def follow_up_order(verdicts: DataFrame) -> DataFrame:
    """Each open verdict's place in its batch: by status, then claim."""
    place = F.array_position(F.array(*map(F.lit, ORDER)), F.col("status"))
    w = Window.partitionBy("batch_id").orderBy(place, "claim_id")
    return verdicts.where("status <> 'Verified'").withColumn("place", F.row_number().over(w))


def money_cards(verdicts: DataFrame) -> DataFrame:
    """Number and paise by card: verified, likely, at_risk, pending."""
    card = F.when(F.col("status") == "Verified", "verified").when(F.col("status") == "Likely Match", "likely").when(F.col("status") == "Can't verify yet", "pending").otherwise("at_risk")
    return verdicts.groupBy("batch_id", card.alias("card")).agg(F.count("*").alias("n"), F.sum("c_paise").alias("paise"))


def confusion(labelled: DataFrame, statuses: tuple[str, ...] = ORDER) -> DataFrame:
    """expected by predicted status."""
    return labelled.groupBy("expected").pivot("status", list(statuses)).count().na.fill(0)


def export_rows(verdicts: DataFrame) -> DataFrame:
    """Cells of the export, guarded against being read as formulas; reasons joined."""
    return verdicts.select(*KEY, formula_guard(F.col("payer")).alias("payer"), F.concat_ws(" | ", "reasons").alias("reasons"))


def union_coverage(a: DataFrame, b: DataFrame) -> DataFrame:
    """Coverage after a second statement: least start, greatest end, summed rows."""
    both = a.unionByName(b)
    return both.groupBy("batch_id").agg(F.min("coverage_start").alias("coverage_start"), F.max("coverage_end").alias("coverage_end"), F.sum("n_rows").alias("n_rows"))
