"""Tests of the finding of round 3 on op13."""

import numpy as np
import pyarrow as pa

from proofrecon.llm.collocations import _heads, _numbers, collocations


def test_packed_numbers():
    """numbers of one, two and four bytes in one batch are read without a Python step per row."""
    rows = [(1, [3, 250]), (2, [70, 300, 65_535]), (4, []), (1, [9]), (4, [70_000, 1])]
    packed = pa.array([np.array(x, f"<u{w}").tobytes() for w, x in [(1, [8]), *rows]], pa.binary()).slice(1)
    assert _numbers(packed, np.array([w for w, _ in rows])).tolist() == [x for _, xs in rows for x in xs]


def test_more_languages_than_one_byte(spark):
    """languages stand before suffixes as a byte or five, and are told apart all the same."""
    langs = [f"x{n:03d}" for n in range(300)]
    heads = list(_heads(langs).values())
    assert {len(h) for h in heads} == {1, 5} and not any(b.startswith(a) for a in heads for b in heads if a != b)
    rows = [(lang, f"red fox {n % 7} sees, a red fox {n % 7}") for n, lang in enumerate(langs)] * 2
    got = collocations(spark.createDataFrame(rows, "lang string, text string").repartition(3), least=4)
    found = {(r["lang"], r["phrase"], r["a"], r["n"]) for r in got.collect()}
    assert found == {(lang, f"red fox {n % 7}", 4, 16) for n, lang in enumerate(langs)}
