"""Representatives and their members against brute force."""

import itertools

from proofrecon.operators import followup


def test_near_hashes_lose_no_row(spark):
    base = "0123456789abcdef" * 4
    hashes = {1: base, 2: base, 3: base[:-1] + "e", 4: base[:-1] + "e", 5: "f" * 64, 6: "f" * 64, 7: "f" * 63 + "0", 8: "0" * 64, 9: "f" * 62 + "00"}
    df = spark.createDataFrame(list(hashes.items()), "id long, h string")
    rep = {r["id"]: r["rep"] for r in followup.hash_members(df).collect()}
    near = {(r["a"], r["b"]) for r in followup.near_hash_pairs(df).collect()}
    got = {(a, b) for a, b in itertools.combinations(sorted(rep), 2) if rep[a] == rep[b] or tuple(sorted((rep[a], rep[b]))) in near}
    apart = lambda a, b: (int(hashes[a], 16) ^ int(hashes[b], 16)).bit_count()
    assert got == {(a, b) for a, b in itertools.combinations(hashes, 2) if apart(a, b) <= 6} and set(rep) == set(hashes)
