"""Boolean trigram queries from regular expressions.

A query is a list of clauses (any of them must hold), a clause a set of trigrams (all of them must occur in the
lower-cased text). ``None`` means that no trigram is mandatory: such a rule has to scan fully.
"""

from __future__ import annotations

import re._parser as regex_tree
from itertools import product

#: Most alternatives that are kept apart; beyond it a part counts as "anything".
ALTERNATIVES = 24


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """The trigram query of a pattern: every text that it matches satisfies a clause."""
    clauses: set[frozenset[str]] = {frozenset()}
    for run in _runs(regex_tree.parse(pattern)):
        options = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in run}
        if frozenset() in options or len(clauses) * len(options) > ALTERNATIVES:
            continue
        clauses = {a | b for a, b in product(clauses, options)}
    clauses = {c for c in clauses if not any(d < c for d in clauses)}
    return None if frozenset() in clauses else sorted(clauses, key=sorted)


def _runs(tree) -> list[set[str]]:
    """Consecutive mandatory parts, each as the set of strings that it can be; unknown parts separate them."""
    runs: list[set[str]] = [{""}]
    for op, value in tree:
        part = _strings(str(op), value)
        if part is None:
            if str(op) == "SUBPATTERN":
                runs += [*_runs(value[3]), {""}]
            elif str(op) in ("MAX_REPEAT", "MIN_REPEAT") and value[0] >= 1:
                runs += [*_runs(value[2]), {""}]
            else:
                runs.append({""})
        elif len(runs[-1]) * len(part) <= ALTERNATIVES:
            runs[-1] = {a + b for a in runs[-1] for b in part}
        else:
            runs.append(set(part))
    return runs


def _strings(op: str, value) -> set[str] | None:
    """All strings that a part can match, lower-cased, or None if there are too many."""
    if op == "LITERAL":
        return {chr(value).lower()}
    if op == "IN":
        if any(str(kind) != "LITERAL" for kind, _ in value):
            return None
        return {chr(x).lower() for _, x in value}
    if op == "BRANCH":
        options = [_sequence(branch) for branch in value[1]]
        return None if None in options or sum(map(len, options)) > ALTERNATIVES else set().union(*options)
    if op == "SUBPATTERN":
        return _sequence(value[3])
    if op in ("MAX_REPEAT", "MIN_REPEAT") and value[1] <= 1:
        inner = _sequence(value[2])
        return None if inner is None else inner | ({""} if value[0] == 0 else set())
    return {""} if op == "AT" else None


def _sequence(tree) -> set[str] | None:
    out = {""}
    for op, value in tree:
        part = _strings(str(op), value)
        if part is None or len(out) * len(part) > ALTERNATIVES:
            return None
        out = {a + b for a in out for b in part}
    return out
