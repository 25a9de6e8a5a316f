"""The verifier once more in plain Python: loops over claims and rows of one batch, all pairs, assignment by trying everything."""

import re
from collections import defaultdict
from datetime import timedelta
from functools import lru_cache

from proofrecon.functions.names import similarity, tokens

WINDOW = 1800
STRENGTH = {"file": 0.95, "reference": 0.85, "image_identical": 0.80, "image_near": 0.70}


def reference(x):
    s = re.sub(r"[\s-]", "", x or "")
    return s if re.fullmatch(r"\d{12}", s) and len(set(s)) > 1 else None


def references(row):
    own = reference(row["ref"])
    found = {r for r in re.findall(r"(?<!\d)(\d{12})(?!\d)", row["narration"] or "") if len(set(r)) > 1}
    return {**{r: "narration" for r in found}, **({own: "field"} if own else {})}


def sure(x):
    return float(x) if x is not None and 0 <= x <= 1 else None


def least(*xs):
    known = [x for x in xs if x is not None]
    return min(known) if known else None


def paise(x):
    n = round(x * 100) if x is not None else 0
    return n if n > 0 else None


class Pair:
    """A claim beside a credit row."""

    def __init__(self, c, r):
        self.c, self.r = c, r
        self.date_only = r["dt"] == r["dt"].replace(hour=0, minute=0, second=0, microsecond=0)
        self.delta = None if self.date_only or c["ts"] is None else abs((c["ts"] - r["dt"]).total_seconds())
        upi = (c["payer_upi_id"] or "").lower()
        self.upi = bool(upi) and not re.search("[*•]", upi) and upi in (r["narration"] or "").lower()
        name = c["payer_name"]
        hint = similarity(name, r["name_hint"]) if name is not None and r["name_hint"] is not None else None
        told = name is not None and len(tokens(name)) >= 2 and set(tokens(name)) <= set(tokens(r["narration"]))
        self.sim = hint if hint is not None else 0.85 if told else None
        self.by_hint = hint is not None
        self.tier = None

    def diffs(self):
        c, out = self.c, []
        if c["paise"] != self.r["paise"]:
            out.append(("amount", 0.90))
        if self.by_hint and self.sim < 0.30 and not self.upi:
            out.append(("payer_name", 0.70))
        late = c["ts"] is not None and (abs((c["ts"].date() - self.r["dt"].date()).days) > 1 if self.date_only else self.delta > 86_400)
        return out + [("timestamp", 0.75)] * late + [("status_shown", 0.60)] * c["failed"]

    def points(self):
        c = self.c
        near = max(0.0, 1 - self.delta / WINDOW) if self.delta is not None else 0.2 if self.date_only and c["ts"] and c["ts"].date() == self.r["dt"].date() else 0.0
        read = least(c["conf_amount"], c["conf_ts"], *([c["conf_name"]] if self.sim is not None else []))
        return round(30 * near + 40 * (self.sim or 0.0) + 20 * self.upi + 10 * (0.5 if read is None else read), 3)

    def edge(self):
        """Whether soft evidence stands, with its tier."""
        refs = references(self.r)
        if self.c["ref"] and refs and self.c["ref"] not in refs or self.by_hint and self.sim < 0.30 and not self.upi:
            return False
        self.tier = 2 if (self.upi or (self.sim or 0) >= 0.80) and not self.date_only else 3
        return True

    def confidence(self, ambiguous=0):
        c = self.c
        if self.tier == 1:
            dated = self.date_only and c["ts"] is not None
            read = least(c["conf_ref"], c["conf_amount"])
            less = (0.07 if self.delta is not None and self.delta > WINDOW else 0.02 if self.delta is None and not dated else 0) + (0.04 if self.sim is not None and not self.upi and self.sim < 0.80 else 0)
            less += (0.02 if references(self.r)[c["ref"]] == "narration" else 0) + (0.03 if c["status"] in ("pending", "processing") else 0) + ((0.9 - read) * 0.1 if read is not None and read < 0.9 else 0)
            return max(0.97 - less, 0.85)
        prox = max(0.0, 1 - self.delta / WINDOW) if self.delta is not None else 0.2
        read = least(c["conf_amount"], c["conf_ts"])
        less = (0.08 if ambiguous > 1 else 0) + (0.10 if read is not None and read < 0.5 else 0)
        if self.tier == 2:
            part = max(0.0, (min(self.sim, 1.0) - 0.80) / 0.20) if self.sim is not None else 0.0
            return max(min(0.89, 0.65 + 0.15 * part + 0.04 * prox + 0.05 * self.upi) - less, 0.60)
        return max(min(0.60, 0.40 + 0.14 * prox + 0.04 * (self.sim or 0)) - less, 0.35)


def matched(edges):
    """The best one-to-one choice of one component's (claim, row) -> (tier, points), by trying all."""
    left, right = sorted({c for c, _ in edges}), sorted({r for _, r in edges})
    scale = len(left) * (len(right) + 1) + 1
    weight = {(c, r): ((4 - t) * 10_000_000 + round(p * 1000)) * scale - (left.index(c) * (len(right) + 1) + right.index(r)) for (c, r), (t, p) in edges.items()}

    @lru_cache(None)
    def best(k, used):
        if k == len(left):
            return 0, ()
        out = best(k + 1, used)
        for r in right:
            if (left[k], r) in weight and r not in used:
                w, rest = best(k + 1, used | {r})
                out = max(out, (w + weight[left[k], r], ((left[k], r), *rest)), key=lambda x: x[0])
        return out

    return best(0, frozenset())[1]


def grouped(pairs):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    return {x: root(x) for x in list(parent)}


def coverage(c, meta, n_rows):
    start, end, ts, window = meta["coverage_start"], meta["coverage_end"], c["ts"], timedelta(minutes=30)
    if not n_rows:
        return "no_rows"
    if meta["parse_confidence"] is not None and meta["parse_confidence"] < 0.5:
        return "low_parse_confidence"
    if ts is None:
        return "no_timestamp"
    if end == end.replace(hour=0, minute=0, second=0, microsecond=0):
        end += timedelta(seconds=86_399)
    tests = (("coverage_inverted", end < start), ("after_end", ts > end), ("near_end", ts > end - window), ("before_start", ts < start), ("near_start", ts < start + window))
    return next((name for name, c in tests if c), "not_found")


def links(claims):
    out = defaultdict(set)
    for k, a in enumerate(claims):
        for b in claims[k + 1 :]:
            same, x, y = a["ref"] is not None and a["ref"] == b["ref"], a["image_hash"] or "", b["image_hash"] or ""
            near = a["paise"] is not None and a["paise"] == b["paise"] and a["ts"] and b["ts"] and abs((a["ts"] - b["ts"]).total_seconds()) <= 60
            kinds = {"reference"} if same else set()
            kinds |= {"file"} if x == y and x.startswith("sha256:") else set()
            if x.startswith("dhash256:") and y.startswith("dhash256:") and (same or near):
                bits = bin(int(x[9:], 16) ^ int(y[9:], 16)).count("1")
                kinds |= {"image_near" if bits else "image_identical"} if bits <= 6 else set()
            if kinds:
                out[a["claim_id"], b["claim_id"]] = kinds
    return out


def verified(claims, rows, meta):
    """claim_id to (status, tier, row_id, confidence, reason, follow_up_after) of one batch."""
    for r in rows:
        r["paise"], r["out"] = paise(r["credit"]), paise(r["debit"])
    for c in claims:
        c["paise"], c["ref"], c["status"] = paise(c["amount"]), reference(c["reference"]), (c["status_shown"] or "").lower()
        c["failed"] = c["status"] in ("failed", "fail", "failure")
        for x in ("conf_amount", "conf_ts", "conf_ref", "conf_name"):
            c[x] = sure(c[x])
    by_id, out, edges, hit_rows, firm = {c["claim_id"]: c for c in claims}, {}, {}, defaultdict(list), {}
    for c in claims:
        key = c["claim_id"]
        if c["currency"] not in (None, "INR") or c["paise"] is None:
            out[key] = ("Can't verify yet", None, None, 0.0, "currency" if c["currency"] not in (None, "INR") else "no_amount")
            continue
        hits = [Pair(c, r) for r in rows if r["paise"] and c["ref"] and c["ref"] in references(r)]
        hit_rows[key] = hits
        if hits:
            if all(p.diffs() for p in hits):
                p = min(hits, key=lambda p: (len(p.diffs()), abs(c["paise"] - p.r["paise"]), p.r["row_id"]))
                raw = min(0.95, max(s for _, s in p.diffs()) + 0.02 * (len(p.diffs()) - 1)) * (0.8 if c["conf_ref"] is not None and c["conf_ref"] < 0.5 else 1)
                out[key] = ("Contradicted", 4, p.r["row_id"], raw, ",".join(sorted(f for f, _ in p.diffs())))
            for p in hits:
                if not p.diffs():
                    p.tier = 1
                    edges[key, p.r["row_id"]] = p
            continue
        away = sorted(r["row_id"] for r in rows if not r["paise"] and r["out"] and c["ref"] and c["ref"] in references(r))
        if away:
            out[key] = ("Contradicted", 4, away[0], 0.70, "direction")
        elif not c["failed"] and c["ts"] is not None:
            near = [Pair(c, r) for r in rows if r["paise"] == c["paise"]]
            for p in near:
                if (c["ts"].date() == p.r["dt"].date() if p.date_only else p.delta <= WINDOW) and p.edge():
                    edges[key, p.r["row_id"]] = p
    ambiguous = {}
    for key in by_id:
        own = [(p.tier, p.points()) for (c, _), p in edges.items() if c == key and p.tier > 1]
        if own:
            top = min(t for t, _ in own)
            best = max(x for t, x in own if t == top)
            close = [x for t, x in own if t == top and best - x < 10]
            ambiguous[key] = (top, best, len(close))
    parts = defaultdict(dict)
    where = grouped([(("c", c), ("r", r)) for c, r in edges])
    for (c, r), p in edges.items():
        parts[where["c", c]][c, r] = (p.tier, p.points())
    taken = {}
    for part in parts.values():
        for c, r in matched(part):
            p = edges[c, r]
            n = ambiguous[c][2] if p.tier > 1 and p.tier == ambiguous[c][0] and ambiguous[c][1] - p.points() < 10 else 0
            out[c] = ("Verified" if p.tier == 1 else "Likely Match", p.tier, r, p.confidence(n), "assigned")
            firm[c], taken[r] = p.tier, c
    for key in {c for c, _ in edges} - set(out):
        c, rivals = by_id[key], sorted((taken[r], r) for x, r in edges if x == key and r in taken)
        same = [(w, r) for w, r in rivals if (similarity(c["payer_name"], by_id[w]["payer_name"]) or 0) >= 0.80 and abs((c["ts"] - by_id[w]["ts"]).total_seconds()) <= WINDOW]
        out[key] = ("Duplicate", None, same[0][1], 0.70, "lost_contest") if same else ("Not found", 5, None, 0.55, "lost_contest")
    for c in claims:
        if c["claim_id"] not in out:
            why = coverage(c, meta, len(rows))
            trust = (0.70 if c["ref"] is None else 0.75) * (0.5 + 0.5 * float(meta["parse_confidence"]))
            out[c["claim_id"]] = ("Not found", 5, None, trust, why) if why == "not_found" else ("Can't verify yet", None, None, 0.0, why)
    linked = links(claims)
    groups, strength = grouped(linked), defaultdict(float)
    for (a, b), kinds in linked.items():
        for x in (a, b):
            strength[x] = max(strength[x], *(STRENGTH[k] for k in kinds))
    held = defaultdict(list)
    for x, g in groups.items():
        if out[x][0] != "Contradicted":
            held[g].append(x)
    for members in held.values():
        members.sort(key=lambda x: (0 if firm.get(x) == 1 else 1 if x in firm else 2, x))
        ref_row = {x: min((p.r["row_id"] for p in hit_rows[x]), default=None) for x in members}
        named = defaultdict(dict)
        for x in members:
            c = by_id[x]
            if c["ref"] and c["payer_name"]:
                named[c["ref"]].setdefault(c["payer_name"], []).append(ref_row[x] is None)
        clash = False
        for ref, names in named.items():
            hints = {p.r["name_hint"] for c in claims if c["ref"] == ref for p in hit_rows[c["claim_id"]] if p.r["name_hint"]}
            told = {n: max(similarity(n, h) or 0.0 for h in hints) if hints else None for n in names}
            for a in names:
                for b in names:
                    if a < b and (similarity(a, b) if similarity(a, b) is not None else 1) < 0.50:
                        one = lambda x, y: told[x] is not None and told[x] >= 0.80 and told[y] < 0.50  # noqa: B023, E731
                        clash |= not ((one(a, b) or one(b, a)) and not (any(names[a]) and any(names[b])))
        first = next((out[x][2] for x in members if firm.get(x) == 1), None) or next((ref_row[x] for x in members if ref_row[x]), None)
        kept = first if clash else out[members[0]][2]
        for place, x in enumerate(members):
            if place or clash:
                out[x] = ("Duplicate", None, kept, 0.65 if clash else strength[x], "conflicting_names" if clash else "duplicate")
    later = lambda x: by_id[x]["ts"] + timedelta(hours=24) if out[x][4] in ("after_end", "near_end") else None
    return {x: (*v, later(x)) for x, v in out.items()}
