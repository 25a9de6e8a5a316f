"""Claims against statement rows: candidates, conflicts, scores, assignment, outcomes.

Everything is keyed by batch_id. Money is compared in paise, times as zone-free timestamps. ``claims`` has batch_id,
claim_id, amount, ts, reference, payer_name, payer_upi_id, status_shown, currency, image_hash, conf_amount, conf_ts,
conf_ref, conf_name; ``rows`` has batch_id, row_id, dt, narration, debit, credit, ref, name_hint; ``meta`` has batch_id,
coverage_start, coverage_end, parse_confidence.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from heapq import heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from proofrecon.functions.amounts import paise
from proofrecon.functions.names import all_tokens_in, name_similarity
from proofrecon.functions.references import hamming256, near_reference, normal_reference, reference_set
from proofrecon.functions.text import clean_text
from proofrecon.operators.components import components
from proofrecon.storage import settle_rows


@dataclass(frozen=True)
class MatchConfig:
    """The thresholds of matching."""

    window_minutes: int = 30
    name_similar: float = 0.80
    name_conflict: float = 0.30
    claim_name_conflict: float = 0.50
    reference_hours: int = 24
    ambiguity_points: float = 10.0
    near_hash_bits: int = 6
    corroboration_seconds: int = 60
    follow_up_hours: int = 24
    min_parse_confidence: float = 0.50


DEFAULT = MatchConfig()
FAILED = ("failed", "fail", "failure")


def seconds_between(a: Column, b: Column) -> Column:
    return F.abs(F.timestamp_diff("MICROSECOND", a, b)) / 1e6


def prepared_claims(claims: DataFrame) -> DataFrame:
    """Amounts in paise (positive ones), normal references, lower-cased address and status, upper-cased currency."""
    p = paise(F.col("amount"))
    return claims.select(
        "batch_id",
        "claim_id",
        F.when(p > 0, p).alias("c_paise"),
        F.col("ts").alias("c_ts"),
        normal_reference(F.col("reference")).alias("c_ref"),
        clean_text(F.col("payer_name")).alias("c_name"),
        F.lower(clean_text(F.col("payer_upi_id"))).alias("c_upi"),
        F.lower(clean_text(F.col("status_shown"))).alias("c_status"),
        F.upper(clean_text(F.col("currency"))).alias("c_currency"),
        F.col("image_hash").alias("c_image"),
        *(F.when(F.col(c).cast("double").between(0, 1), F.col(c).cast("double")).alias(c) for c in ("conf_amount", "conf_ts", "conf_ref", "conf_name")),
    )


def prepared_rows(rows: DataFrame) -> DataFrame:
    """Positive paise, references with their places, and whether a row has a date only (midnight)."""
    credit, debit = paise(F.col("credit")), paise(F.col("debit"))
    midnight = F.col("dt") == F.date_trunc("day", F.col("dt")).cast("timestamp_ntz")
    return rows.select(
        "batch_id",
        "row_id",
        F.col("dt").alias("r_dt"),
        F.coalesce(midnight, F.lit(False)).alias("date_only"),
        F.when(credit > 0, credit).alias("r_credit"),
        F.when(debit > 0, debit).alias("r_debit"),
        reference_set(F.col("ref"), F.col("narration")).alias("refs"),
        F.coalesce(F.col("narration"), F.lit("")).alias("narration"),
        F.col("name_hint"),
    )


def route() -> Column:
    """What may judge a prepared claim: currency and no_amount can't be, reference_only for failed payments, else all."""
    return F.when(F.col("c_currency") != "INR", "currency").when(F.col("c_paise").isNull(), "no_amount").when(F.col("c_status").isin(*FAILED), "reference_only").otherwise("all")


def reference_hits(claims: DataFrame, rows: DataFrame) -> DataFrame:
    """Claims joined with the credit rows that carry their reference: an equi-join on (batch_id, reference)."""
    keyed = rows.where("r_credit is not null").select("*", F.explode("refs").alias("_r")).select("*", F.col("_r.ref").alias("c_ref"), F.col("_r.ref_source").alias("ref_source"))
    return claims.join(keyed.drop("_r", "refs"), ["batch_id", "c_ref"])


def debit_hits(claims: DataFrame, rows: DataFrame, credit_hits: DataFrame) -> DataFrame:
    """Per claim without a credit hit the first debit row that carries its reference: batch_id, claim_id, row_id."""
    keyed = rows.where("r_credit is null and r_debit is not null").select("batch_id", "row_id", F.explode("refs").alias("_r")).select("batch_id", "row_id", F.col("_r.ref").alias("c_ref"))
    open_claims = claims.join(credit_hits.select("batch_id", "claim_id").distinct(), ["batch_id", "claim_id"], "left_anti")
    return open_claims.join(keyed, ["batch_id", "c_ref"]).groupBy("batch_id", "claim_id").agg(F.min("row_id").alias("row_id"))


def with_evidence(pairs: DataFrame, names: bool = True) -> DataFrame:
    """Time distance, address in the narration, and name similarity with its source (hint or narration)."""
    upi = F.col("c_upi").isNotNull() & ~F.col("c_upi").rlike("[*•]") & F.lower("narration").contains(F.col("c_upi"))
    out = pairs.withColumn("delta", F.when(~F.col("date_only"), seconds_between(F.col("c_ts"), F.col("r_dt"))))
    out = out.withColumn("upi", F.coalesce(upi, F.lit(False)))
    if not names:
        return out.withColumn("sim", F.lit(None).cast("double")).withColumn("sim_src", F.lit(None).cast("string"))
    hint = name_similarity(F.col("c_name"), F.col("name_hint"))
    told = F.when(F.col("c_name").isNotNull(), all_tokens_in(F.col("c_name"), F.col("narration")))
    out = out.withColumn("_hint", hint).withColumn("_told", told)
    out = out.withColumn("sim", F.coalesce("_hint", F.when(F.col("_told"), F.lit(0.85))))
    return out.withColumn("sim_src", F.when(F.col("_hint").isNotNull(), "hint").when(F.col("sim").isNotNull(), "narration")).drop("_hint", "_told")


def conflicts(cfg: MatchConfig = DEFAULT) -> Column:
    """Array of (field, strength) in which a claim differs from the row with its reference."""
    days = F.abs(F.date_diff(F.col("c_ts").cast("date"), F.col("r_dt").cast("date")))
    late = F.when(F.col("date_only"), days > 1).otherwise(F.col("delta") > cfg.reference_hours * 3600)
    told = (
        ("amount", 0.90, ~F.col("c_paise").eqNullSafe(F.col("r_credit"))),
        ("payer_name", 0.70, (F.col("sim_src") == "hint") & (F.col("sim") < cfg.name_conflict) & ~F.col("upi")),
        ("timestamp", 0.75, late),
        ("status_shown", 0.60, F.col("c_status").isin(*FAILED)),
    )
    item = lambda name, s: F.struct(F.lit(name).alias("field"), F.lit(s).alias("strength"))
    return F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), item(n, s)) for n, s, c in told)))


def least_known(*cols: str) -> Column:
    return F.array_min(F.array_compact(F.array(*map(F.col, cols))))


def points(cfg: MatchConfig = DEFAULT) -> Column:
    """30 for time, 40 for the name, 20 for the address, 10 for reading confidence; missing evidence counts nothing."""
    near = F.greatest(F.lit(0.0), 1 - F.col("delta") / (cfg.window_minutes * 60))
    same_day = F.col("date_only") & (F.col("c_ts").cast("date") == F.col("r_dt").cast("date"))
    prox = F.when(F.col("delta").isNotNull(), near).when(same_day, 0.2).otherwise(0.0)
    read = F.when(F.col("sim").isNotNull(), least_known("conf_amount", "conf_ts", "conf_name")).otherwise(least_known("conf_amount", "conf_ts"))
    return F.bround(30 * prox + 40 * F.coalesce("sim", F.lit(0.0)) + 20 * F.col("upi").cast("int") + 10 * F.coalesce(read, F.lit(0.5)), 3)


def soft_pairs(claims: DataFrame, rows: DataFrame, cfg: MatchConfig = DEFAULT) -> DataFrame:
    """Claims with credit rows of the same amount within the time window (the same day for date-only rows).

    An equi-join on (batch_id, paise, slot): the time axis is cut into window-wide slots, a claim looks into its own
    and both neighbours, so one fixed fee doesn't pair everything with everything.
    """
    width = cfg.window_minutes * 60
    slot = lambda t: F.floor(F.timestamp_diff("SECOND", F.lit("1970-01-01").cast("timestamp_ntz"), t) / width)
    day = lambda t: F.concat(F.lit("d"), t.cast("date").cast("string"))
    left = claims.where("c_paise is not null and c_ts is not null")
    own = [F.concat(F.lit("s"), (slot(F.col("c_ts")) + k).cast("string")) for k in (-1, 0, 1)]
    left = left.withColumn("slot", F.explode(F.array(*own, day(F.col("c_ts")))))
    right = rows.where("r_credit is not null and r_dt is not null").withColumn("c_paise", F.col("r_credit"))
    right = right.withColumn("slot", F.when(F.col("date_only"), day(F.col("r_dt"))).otherwise(F.concat(F.lit("s"), slot(F.col("r_dt")).cast("string"))))
    within = F.col("date_only") | (seconds_between(F.col("c_ts"), F.col("r_dt")) <= width)
    return left.join(right, ["batch_id", "c_paise", "slot"]).where(within).drop("slot")


def soft_edges(pairs: DataFrame, cfg: MatchConfig = DEFAULT) -> DataFrame:
    """``pairs`` with why (ref, name or null where it stays an edge), tier, points, ref_note and near (differing digits)."""
    carries = F.exists("refs", lambda r: r["ref"] == F.col("c_ref"))
    other = F.col("c_ref").isNotNull() & (F.size("refs") > 0) & ~carries
    clash = (F.col("sim_src") == "hint") & (F.col("sim") < cfg.name_conflict) & ~F.col("upi")
    identity = F.col("upi") | F.coalesce(F.col("sim") >= cfg.name_similar, F.lit(False))
    near = F.array_min(F.transform("refs", lambda r: near_reference(F.col("c_ref"), r["ref"])))
    return pairs.withColumns(
        {
            "why": F.when(other, "ref").when(F.coalesce(clash, F.lit(False)), "name"),
            "tier": F.when(identity & ~F.col("date_only"), 2).otherwise(3),
            "points": points(cfg),
            "ref_note": F.when(F.col("c_ref").isNotNull() & (F.size("refs") == 0), "row_without_reference").when(F.col("c_ref").isNull() & (F.size("refs") > 0), "claim_without_reference"),
            "near": F.when(other, near),
        }
    )


def with_ambiguity(edges: DataFrame, cfg: MatchConfig = DEFAULT) -> DataFrame:
    """ambiguous: how many edges of a claim's best tier lie within ``ambiguity_points`` of its best; 0 on other edges."""
    mine = Window.partitionBy("batch_id", "claim_id")
    out = edges.withColumn("_top", F.min("tier").over(mine))
    out = out.withColumn("_best", F.max(F.when(F.col("tier") == F.col("_top"), F.col("points"))).over(mine))
    close = (F.col("tier") == F.col("_top")) & (F.col("_best") - F.col("points") < cfg.ambiguity_points)
    return out.withColumn("ambiguous", F.when(close, F.count_if(close).over(mine)).otherwise(0)).drop("_top", "_best")


def _heaviest_sparse(edges: list[list[tuple[int, int]]], n_right: int) -> list[int]:
    """The partner of each left vertex in a heaviest matching (-1: none); ``edges`` has (right, positive weight) per left vertex.

    Shortest augmenting paths with prices over the given edges only. Each left vertex has one more partner of weight 0,
    its own, so that it may stay alone; time and memory follow the edges, not left times right.
    """
    row_price, col_price = [0] * len(edges), [0] * (n_right + len(edges))
    owner, partner = [-1] * (n_right + len(edges)), [-1] * len(edges)
    for start in range(len(edges)):
        reach: dict[int, int] = {}
        via: dict[int, int] = {}
        done: dict[int, int] = {}
        heap: list[tuple[int, int]] = []
        row, travelled = start, 0
        while True:
            base = travelled - row_price[row]
            for j, w in (*edges[row], (n_right + row, 0)):
                d = base - w - col_price[j]
                if j not in done and (j not in reach or d < reach[j]):
                    reach[j], via[j] = d, row
                    heappush(heap, (d, j))
            travelled, col = heappop(heap)
            while col in done:
                travelled, col = heappop(heap)
            done[col] = travelled
            if owner[col] < 0:
                break
            row = owner[col]
        for j, d in done.items():
            if owner[j] >= 0:
                row_price[owner[j]] += travelled - d
            col_price[j] -= travelled - d
        row_price[start] += travelled
        while True:
            row = owner[col] = via[col]
            partner[row], col = col, partner[row]
            if row == start:
                break
    return [j if j < n_right else -1 for j in partner]


def _heaviest(weight: np.ndarray) -> list[int]:
    """The same from a matrix; what isn't positive is no edge."""
    return _heaviest_sparse([[(int(j), row[j]) for j in np.flatnonzero(row > 0)] for row in weight], weight.shape[1])


def _solved(part: pd.DataFrame) -> list[tuple]:
    """The heaviest matching of one component: batch_id, claim_id, row_id."""
    left, right = sorted(set(part["claim_id"])), sorted(set(part["row_id"]))
    at_l, at_r = {c: i for i, c in enumerate(left)}, {r: j for j, r in enumerate(right)}
    scale = len(left) * (len(right) + 1) + 1
    weights: list[dict[int, int]] = [{} for _ in left]
    for c, r, tier, pts in zip(part["claim_id"], part["row_id"], part["tier"], part["points"], strict=True):
        i, j = at_l[c], at_r[r]
        weights[i][j] = ((4 - int(tier)) * 10_000_000 + round(pts * 1000)) * scale - (i * (len(right) + 1) + j)
    partner = _heaviest_sparse([sorted(w.items()) for w in weights], len(right))
    return [(part["batch_id"].iloc[0], c, right[j]) for c, j in zip(left, partner, strict=True) if j >= 0]


def _each_component(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Solve component after component of rows sorted by component; a component may span frames."""
    rest: list[pd.DataFrame] = []
    for frame in frames:
        runs = frame["component"].ne(frame["component"].shift()).cumsum()
        out = []
        for _, part in frame.groupby(runs, sort=True):
            if rest and part["component"].iloc[0] != rest[0]["component"].iloc[0]:
                out += _solved(pd.concat(rest))
                rest = []
            rest.append(part)
        yield pd.DataFrame(out, columns=["batch_id", "claim_id", "row_id"])
    if rest:
        yield pd.DataFrame(_solved(pd.concat(rest)), columns=["batch_id", "claim_id", "row_id"])


def assign(edges: DataFrame) -> DataFrame:
    """One-to-one assignment of greatest weight: batch_id, claim_id, row_id.

    Weight: (4 - tier) * 10**7 + 1000 * points, ties to smaller ids. An edge whose claim and row have no other is taken as
    it is. The rest is cut into connected components by joins; a task then solves its components one after another,
    each exactly. One component's edges are one task's work, a batch's or an amount's are not.
    """
    edges = settle_rows(edges.select("batch_id", "claim_id", "row_id", "tier", "points"))
    degree = lambda c: F.count("*").over(Window.partitionBy("batch_id", c))
    counted = settle_rows(edges.withColumn("_c", degree("claim_id")).withColumn("_r", degree("row_id")))
    alone = (F.col("_c") == 1) & (F.col("_r") == 1)
    node = lambda kind, c: F.concat_ws("|", F.lit(kind), F.col("batch_id").cast("string"), F.col(c))
    rest = counted.where(~alone).drop("_c", "_r").withColumn("u", node("c", "claim_id"))
    labels = components(rest.select("u", node("r", "row_id").alias("v")))
    placed = rest.join(labels, rest["u"] == labels["node"]).select("component", "batch_id", "claim_id", "row_id", "tier", "points")
    schema = f"batch_id {edges.schema['batch_id'].dataType.simpleString()}, claim_id string, row_id string"
    solved = placed.repartition("component").sortWithinPartitions("component").mapInPandas(_each_component, schema)
    return counted.where(alone).select("batch_id", "claim_id", "row_id").unionByName(solved)


def verified_confidence(cfg: MatchConfig = DEFAULT) -> Column:
    known = F.col("delta").isNotNull()
    dated = F.col("date_only") & F.col("c_ts").isNotNull() & F.col("r_dt").isNotNull()
    read = least_known("conf_ref", "conf_amount")
    less = (
        F.when(known & (F.col("delta") > cfg.window_minutes * 60), 0.07).when(~known & ~dated, 0.02).otherwise(0.0)
        + F.when(F.col("sim").isNotNull() & ~F.col("upi") & (F.col("sim") < cfg.name_similar), 0.04).otherwise(0.0)
        + F.when(F.col("ref_source") == "narration", 0.02).otherwise(0.0)
        + F.when(F.col("c_status").isin("pending", "processing"), 0.03).otherwise(0.0)
        + F.when(read < 0.9, (0.9 - read) * 0.1).otherwise(0.0)
    )
    return F.bround(F.greatest(0.97 - less, F.lit(0.85)), 4)


def likely_confidence(cfg: MatchConfig = DEFAULT) -> Column:
    prox = F.when(F.col("delta").isNotNull(), F.greatest(F.lit(0.0), 1 - F.col("delta") / (cfg.window_minutes * 60))).otherwise(0.2)
    part = F.when(F.col("sim").isNotNull(), F.greatest(F.lit(0.0), (F.least("sim", F.lit(1.0)) - cfg.name_similar) / (1 - cfg.name_similar))).otherwise(0.0)
    second = F.least(F.lit(0.89), 0.65 + 0.15 * part + 0.04 * prox + F.when(F.col("upi"), 0.05).otherwise(0.0))
    third = F.least(F.lit(0.60), 0.40 + 0.14 * prox + F.coalesce(0.04 * F.col("sim"), F.lit(0.0)))
    read = least_known("conf_amount", "conf_ts")
    less = F.when(F.col("ambiguous") > 1, 0.08).otherwise(0.0) + F.when(read < 0.5, 0.10).otherwise(0.0)
    raw = F.when(F.col("tier") == 2, second).otherwise(third)
    return F.bround(F.greatest(raw - less, F.when(F.col("tier") == 2, 0.60).otherwise(0.35)), 4)


def contradicted(hits: DataFrame) -> DataFrame:
    """Per claim whose reference rows all conflict the nearest row: fewest differences, then amount, then row_id."""
    key = F.struct(F.size("diffs").alias("n"), F.abs(F.col("c_paise") - F.col("r_credit")).alias("gap"), "row_id")
    best = hits.groupBy("batch_id", "claim_id").agg(
        F.min_by(F.struct("row_id", "diffs", "conf_ref"), key).alias("b"), F.min(F.size("diffs")).alias("fewest"), F.count("*").alias("n_rows")
    )
    strongest = F.array_max(F.transform("b.diffs", lambda d: d["strength"]))
    raw = F.least(F.lit(0.95), strongest + 0.02 * (F.size("b.diffs") - 1)) * F.when(F.col("b.conf_ref") < 0.5, 0.8).otherwise(1.0)
    fields = F.array_join(F.array_sort(F.transform("b.diffs", lambda d: d["field"])), ",")
    return best.where("fewest > 0").select("batch_id", "claim_id", F.col("b.row_id").alias("row_id"), F.bround(raw, 4).alias("confidence"), fields.alias("fields"), "n_rows")


def coverage_status(cfg: MatchConfig = DEFAULT) -> Column:
    """Why a claim without candidate can't be verified, or not_found; over c_ts, coverage_*, parse_confidence, n_rows."""
    end = F.col("coverage_end")
    whole_day = end == F.date_trunc("day", end).cast("timestamp_ntz")
    end = F.when(whole_day, end + F.make_dt_interval(secs=F.lit(86_399))).otherwise(end)
    start, ts, w = F.col("coverage_start"), F.col("c_ts"), F.make_dt_interval(mins=F.lit(cfg.window_minutes))
    return (
        F.when(F.coalesce("n_rows", F.lit(0)) == 0, "no_rows")
        .when(F.col("parse_confidence") < cfg.min_parse_confidence, "low_parse_confidence")
        .when(ts.isNull(), "no_timestamp")
        .when(start.isNull() | end.isNull(), "coverage_unknown")
        .when(end < start, "coverage_inverted")
        .when(ts > end, "after_end")
        .when(ts > end - w, "near_end")
        .when(ts < start, "before_start")
        .when(ts < start + w, "near_start")
        .otherwise("not_found")
    )


def not_found_confidence() -> Column:
    return F.bround(F.when(F.col("c_ref").isNull(), 0.70).otherwise(0.75) * F.coalesce(0.5 + 0.5 * F.col("parse_confidence"), F.lit(1.0)), 4)


def _near_classes(hashed: DataFrame, most: int) -> DataFrame:
    """batch_id, h1 < h2 of distinct hashes of a batch that differ in at most ``most`` bits.

    Hashes that differ in 6 bits at most agree in two of eight words: they meet on (word number, word), and a pair is kept
    where its first equal word lets it meet.
    """
    one = hashed.select("batch_id", "h").distinct()
    words = F.array(*(F.substring("h", 8 * k + 1, 8) for k in range(8)))
    each = settle_rows(one.withColumn("words", words)).select("batch_id", "h", "words", F.posexplode("words").alias("k", "word"))
    a, b = each.alias("a"), each.alias("b")
    pairs = a.join(b, [*(F.col(f"a.{x}") == F.col(f"b.{x}") for x in ("batch_id", "k", "word")), F.col("a.h") < F.col("b.h")])
    equal = F.zip_with("a.words", "b.words", lambda x, y: x == y)
    met = (F.array_position(equal, True) == F.col("a.k") + 1) & (hamming256(F.col("a.h"), F.col("b.h")) <= most)
    return pairs.where(met).select("a.batch_id", F.col("a.h").alias("h1"), F.col("b.h").alias("h2"))


def claim_links(claims: DataFrame, cfg: MatchConfig = DEFAULT) -> DataFrame:
    """Linked claims (a < b) of a batch with their evidence: same reference, same file hash, identical or near image hash.

    Image links need the same reference, or the same amount within a minute. Links join the same groups as all pairs
    would, and each linked claim has a link of each kind that it has in any pair: of equal references, files and images
    each is linked to the first, in time each to the one before; of near images each to the first of the other image, and
    in time to the next ones of the other image on both sides. So n copies of one image give n links and not n * n.
    """
    c = claims.select("batch_id", "claim_id", "c_ref", "c_image", "c_paise", "c_ts")
    hashed = settle_rows(c.where(F.col("c_image").rlike("^dhash256:[0-9a-f]{64}$")).withColumn("h", F.substring("c_image", 10, 64)))

    def link(rows: DataFrame, kind: str, *evidence: Column) -> DataFrame:
        found = rows.select("batch_id", "claim_id", F.explode(F.array_compact(F.array(*evidence))).alias("o"))
        return found.where("o <> claim_id").select("batch_id", F.least("claim_id", "o").alias("a"), F.greatest("claim_id", "o").alias("b"), F.lit(kind).alias("kind"))

    def chained(rows: DataFrame, kind: str, *keys: str) -> DataFrame:
        first = F.min("claim_id").over(Window.partitionBy("batch_id", *keys))
        return link(rows.where(" and ".join(f"{k} is not null" for k in keys)).withColumn("_f", first), kind, F.col("_f"))

    def close(at: str) -> Column:
        gap = seconds_between(F.col("c_ts"), F.col(f"{at}.c_ts"))
        return F.when(gap <= cfg.corroboration_seconds, F.col(f"{at}.claim_id"))

    timed = hashed.where("c_paise is not null and c_ts is not null")
    who = F.struct("c_ts", "claim_id")
    before = timed.withColumn("_p", F.lag(who).over(Window.partitionBy("batch_id", "h", "c_paise").orderBy("c_ts", "claim_id")))
    same = chained(hashed, "image_identical", "h", "c_ref").unionByName(link(before, "image_identical", close("_p")))

    pairs = settle_rows(_near_classes(hashed, cfg.near_hash_bits))
    member = lambda side: pairs.withColumn("h", F.col(f"h{side}")).join(hashed, ["batch_id", "h"]).withColumn("side", F.lit(side))
    members = settle_rows(member(1).unionByName(member(2)).drop("h", "c_image"))
    pair = ["batch_id", "h1", "h2"]
    firsts = Window.partitionBy(*pair, "c_ref")
    other = lambda side: F.min(F.when(F.col("side") == side, F.col("claim_id"))).over(firsts)
    named = members.where("c_ref is not null").withColumn("_o", F.when(F.col("side") == 1, other(2)).otherwise(other(1)))
    by_ref = link(named, "image_near", F.col("_o"))
    order = Window.partitionBy(*pair, "c_paise").orderBy("c_ts", "claim_id")
    past, future = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing)
    opposite = lambda f, w: F.when(F.col("side") == 1, f(F.when(F.col("side") == 2, who), True).over(w)).otherwise(f(F.when(F.col("side") == 1, who), True).over(w))
    near = members.where("c_paise is not null and c_ts is not null").withColumn("_p", opposite(F.last, past)).withColumn("_n", opposite(F.first, future))
    by_time = link(near, "image_near", close("_p"), close("_n"))
    files = c.withColumn("file", F.when(F.col("c_image").startswith("sha256:"), F.col("c_image")))
    exact = chained(c, "reference", "c_ref").unionByName(chained(files, "file", "file"))
    return exact.unionByName(same.unionByName(by_ref).unionByName(by_time).distinct())


#: How strong each kind of duplicate evidence is.
STRENGTH = {"file": 0.95, "reference": 0.85, "image_identical": 0.80, "image_near": 0.70}


def duplicate_groups(links: DataFrame) -> DataFrame:
    """batch_id, claim_id, group_id (the first claim of the group) of linked claims, whatever a group's size."""
    end = lambda c: F.struct("batch_id", F.col(c).alias("claim_id"))
    return components(links.select(end("a").alias("u"), end("b").alias("v"))).select("node.batch_id", "node.claim_id", F.col("component.claim_id").alias("group_id"))


def verify(claims: DataFrame, rows: DataFrame, meta: DataFrame, cfg: MatchConfig = DEFAULT, *, names: bool = True, duplicates: bool = True) -> DataFrame:
    """One verdict per claim: batch_id, claim_id, status, tier, row_id, confidence, reason (a code), follow_up_after.

    Statuses: Verified, Likely Match, Contradicted, Duplicate, Not found, Can't verify yet. ``meta`` may have n_rows where
    ``rows`` is only a part of the statement.
    """
    key = ["batch_id", "claim_id"]
    c, r = settle_rows(prepared_claims(claims)), settle_rows(prepared_rows(rows))
    readable = F.col("c_currency").isNull() | (F.col("c_currency") == "INR")
    sound = c.where(readable & F.col("c_paise").isNotNull())
    barred = c.where(~readable | F.col("c_paise").isNull()).select(*key, F.when(readable, "no_amount").otherwise("currency").alias("reason"))
    hits = settle_rows(with_evidence(reference_hits(sound, r), names).withColumn("diffs", conflicts(cfg)))
    debits = settle_rows(debit_hits(sound, r, hits))
    against = contradicted(hits)
    sure = hits.where(F.size("diffs") == 0).withColumn("tier", F.lit(1)).withColumn("points", points(cfg))
    routed = hits.select(*key).unionByName(debits.select(*key)).distinct()
    free = sound.where(~F.coalesce(F.col("c_status").isin(*FAILED), F.lit(False))).join(routed, key, "left_anti")
    judged = soft_edges(with_evidence(soft_pairs(free, r, cfg), names), cfg)
    soft = with_ambiguity(judged.where("why is null"), cfg)
    common = [*key, "c_paise", "row_id", "tier", "points", "confidence"]
    edges = sure.withColumn("confidence", verified_confidence(cfg)).select(*common).unionByName(soft.withColumn("confidence", likely_confidence(cfg)).select(*common))
    edges = settle_rows(edges)
    won = settle_rows(assign(edges))
    best = edges.join(won, [*key, "row_id"])
    outs = [
        barred.select(*key, F.lit("Can't verify yet").alias("status"), F.lit(None).cast("int").alias("tier"), F.lit(None).cast("string").alias("row_id"), F.lit(0.0).alias("confidence"), "reason"),
        best.select(*key, F.when(F.col("tier") == 1, "Verified").otherwise("Likely Match").alias("status"), "tier", "row_id", "confidence", F.lit("assigned").alias("reason")),
        against.select(*key, F.lit("Contradicted").alias("status"), F.lit(4).alias("tier"), "row_id", "confidence", F.col("fields").alias("reason")),
        debits.select(*key, F.lit("Contradicted").alias("status"), F.lit(4).alias("tier"), "row_id", F.lit(0.70).alias("confidence"), F.lit("direction").alias("reason")),
    ]
    decided = settle_rows(reduce(DataFrame.unionByName, outs))
    lost = edges.select(*key).distinct().join(decided.select(*key), key, "left_anti")
    decided = decided.unionByName(_contests(lost, edges, won, c, cfg, names))
    covered = meta if "n_rows" in meta.columns else meta.join(rows.groupBy("batch_id").agg(F.count("*").alias("n_rows")), "batch_id", "full")
    rest = c.join(decided.select(*key), key, "left_anti").join(covered, "batch_id", "left").withColumn("reason", coverage_status(cfg))
    missing = F.col("reason") == "not_found"
    absent = rest.select(
        *key,
        F.when(missing, "Not found").otherwise("Can't verify yet").alias("status"),
        F.when(missing, 5).alias("tier"),
        F.lit(None).cast("string").alias("row_id"),
        F.when(missing, not_found_confidence()).otherwise(0.0).alias("confidence"),
        "reason",
    )
    out = decided.unionByName(absent)
    if duplicates:
        out = _demoted(settle_rows(out), best.select(*key, F.col("tier").alias("won_tier")), claim_links(c, cfg), c, hits, cfg, names)
    later = F.when(F.col("reason").isin("after_end", "near_end"), F.col("c_ts") + F.make_dt_interval(hours=F.lit(cfg.follow_up_hours)))
    return out.join(c.select(*key, "c_ts"), key).withColumn("follow_up_after", later).drop("c_ts")


def _contests(lost: DataFrame, edges: DataFrame, won: DataFrame, claims: DataFrame, cfg: MatchConfig, names: bool) -> DataFrame:
    """Claims whose rows went to others: Duplicate of a winner with a similar name and near time, else Not found."""
    key = ["batch_id", "claim_id"]
    who = claims.select(*key, "c_name", "c_ts")
    winner = won.select("batch_id", "row_id", F.col("claim_id").alias("winner"))
    rivals = lost.join(edges.select(*key, "row_id"), key).join(winner, ["batch_id", "row_id"]).join(who, key)
    rivals = rivals.join(who.select("batch_id", F.col("claim_id").alias("winner"), F.col("c_name").alias("w_name"), F.col("c_ts").alias("w_ts")), ["batch_id", "winner"])
    sim = name_similarity(F.col("c_name"), F.col("w_name")) if names else F.lit(None).cast("double")
    rivals = rivals.withColumn("sim", sim)
    same = (F.col("sim") >= cfg.name_similar) & (seconds_between(F.col("c_ts"), F.col("w_ts")) <= cfg.window_minutes * 60)
    judged = rivals.groupBy(*key).agg(F.min(F.when(same, F.struct("winner", "row_id"))).alias("d"))
    dup = F.col("d").isNotNull()
    return judged.select(
        *key,
        F.when(dup, "Duplicate").otherwise("Not found").alias("status"),
        F.when(~dup, 5).alias("tier"),
        F.col("d.row_id").alias("row_id"),
        F.when(dup, 0.70).otherwise(0.55).alias("confidence"),
        F.lit("lost_contest").alias("reason"),
    )


def _conflicting(members: DataFrame, hits: DataFrame, cfg: MatchConfig) -> DataFrame:
    """batch_id, group_id of groups in which two members give one reference but payer names that are hardly alike.

    The statement resolves a pair where one name is like a name hint of the reference's rows and the other isn't.
    Distinct names of a reference meet its first name; all pairs of them only where that finds nothing.
    """
    at = ["batch_id", "c_ref", "c_name"]
    named = members.where("c_ref is not null and c_name is not null").groupBy(*at).agg(F.first("group_id").alias("group_id"), F.bool_or(F.col("ref_row").isNull()).alias("bare"))
    hints = hits.where(F.length("name_hint") > 0).select("batch_id", "c_ref", "name_hint").distinct()
    told = named.join(hints, ["batch_id", "c_ref"]).groupBy(*at).agg(F.max(F.coalesce(name_similarity(F.col("c_name"), F.col("name_hint")), F.lit(0.0))).alias("told"))
    named = settle_rows(named.join(told, at, "left"))

    def clashes(a: DataFrame, b: DataFrame) -> DataFrame:
        pairs = a.alias("a").join(b.alias("b"), (F.col("a.batch_id") == F.col("b.batch_id")) & (F.col("a.c_ref") == F.col("b.c_ref")) & (F.col("a.c_name") < F.col("b.c_name")))
        one = lambda x, y: (F.col(f"{x}.told") >= cfg.name_similar) & (F.col(f"{y}.told") < cfg.claim_name_conflict)
        resolved = F.coalesce(one("a", "b") | one("b", "a"), F.lit(False)) & ~(F.col("a.bare") & F.col("b.bare"))
        unlike = name_similarity(F.col("a.c_name"), F.col("b.c_name")) < cfg.claim_name_conflict
        return pairs.where(~resolved).where(unlike).select("a.batch_id", "a.group_id").distinct()

    first = named.join(named.groupBy("batch_id", "c_ref").agg(F.min("c_name").alias("c_name")), at, "left_semi")
    quick = settle_rows(clashes(first, named))
    rest = named.join(quick, ["batch_id", "group_id"], "left_anti")
    return quick.unionByName(clashes(rest, rest))


def _demoted(out: DataFrame, best: DataFrame, links: DataFrame, claims: DataFrame, hits: DataFrame, cfg: MatchConfig, names: bool) -> DataFrame:
    """Of each duplicate group the best member stays; other members that aren't Contradicted become Duplicate.

    No member stays where two of them give one reference and conflicting names: a credit belongs to one payer only.
    """
    key = ["batch_id", "claim_id"]
    strength = reduce(lambda rest, kv: F.when(F.col("kind") == kv[0], kv[1]).otherwise(rest), STRENGTH.items(), F.lit(0.5))
    each = links.select("batch_id", F.col("a").alias("claim_id"), "kind").unionByName(links.select("batch_id", F.col("b").alias("claim_id"), "kind"))
    each = each.groupBy(*key).agg(F.max(strength).alias("strength")).hint("merge")
    members = out.join(duplicate_groups(links), key).join(best, key, "left").join(each, key)
    members = members.join(claims.select(*key, "c_ref", "c_name"), key).join(hits.groupBy(*key).agg(F.min("row_id").alias("ref_row")), key, "left")
    members = settle_rows(members.where("status <> 'Contradicted'"))
    groups = ["batch_id", "group_id"]
    clash = _conflicting(members, hits, cfg) if names else members.select(*groups).limit(0)
    members = members.join(clash.withColumn("clash", F.lit(True)), groups, "left").withColumn("clash", F.coalesce("clash", F.lit(False)))
    rank = F.when(F.col("won_tier") == 1, 0).when(F.col("won_tier").isNotNull(), 1).otherwise(2)
    order = Window.partitionBy(*groups).orderBy(rank, "claim_id")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    contested = F.coalesce(F.first(F.when(F.col("won_tier") == 1, F.col("row_id")), True).over(whole), F.first("ref_row", True).over(whole))
    kept = F.when(F.col("clash"), contested).otherwise(F.first("row_id").over(order))
    eligible = members.withColumn("place", F.row_number().over(order)).withColumn("kept_row", kept)
    losers = eligible.where("place > 1 or clash").select(*key, F.when(F.col("clash"), 0.65).otherwise(F.col("strength")).alias("_s"), F.col("kept_row").alias("_row"), F.when(F.col("clash"), "conflicting_names").otherwise("duplicate").alias("_dup"))
    joined = out.join(losers, key, "left")
    dup = F.col("_dup").isNotNull()
    return joined.select(
        *key,
        F.when(dup, "Duplicate").otherwise(F.col("status")).alias("status"),
        F.when(~dup, F.col("tier")).alias("tier"),
        F.when(dup, F.col("_row")).otherwise(F.col("row_id")).alias("row_id"),
        F.when(dup, F.col("_s")).otherwise(F.col("confidence")).alias("confidence"),
        F.coalesce("_dup", "reason").alias("reason"),
    )
