"""Each operator against brute force, an exact round trip or held-out accuracy, with nulls, blanks, repeats and ties."""

import base64
import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from proofrecon.llm import language_id, line_crf
from proofrecon.llm.components import connected_components
from proofrecon.llm.minhash_dedup import near_duplicates
from proofrecon.llm.mixing import mix_sources
from proofrecon.llm.packing import hilbert_keys, pack
from proofrecon.llm.repeated_passages import remove_repeats
from proofrecon.llm.secret_scan import BASE_RULES, RULES, find_secrets, listed, redacted
from proofrecon.llm.token_files import decoded, decoded_blocks, read_token_files, simple8b, write_token_files
from proofrecon.llm.trigrams import trigram_query
from proofrecon.llm.vantage_point import nearest
from proofrecon.llm.warc_archive import read_records, reconstruct, write_archive
from tests.conftest import DATA

tokenizers = pytest.importorskip("tokenizers")
P = pytest.importorskip("public_tokenizers")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
RNG = np.random.default_rng(5)
WORDS = ["".join(RNG.choice(list("abcdeéñ"), RNG.integers(1, 7))) for _ in range(300)]


def prose(n):
    return " ".join(RNG.choice(WORDS, n))


def corpus():
    base = [prose(int(n)) for n in RNG.integers(1, 120, 40)]
    near = [" ".join([*b.split()[:-2], "x", "y"]) for b in base[:15]]
    passage = prose(150)
    shared = [prose(20) + "\n" + passage + "\n" + prose(15) for _ in range(6)]
    odd = [None, "", "  \n\t ", "one", "ONE", base[3], base[3], prose(6000), "two  spaces   é\x1c x", "token=secret1234 AKIA" + "A1" * 10]
    texts = base + near + shared + odd
    rows = [(i, t, None, f"s{i % 4}" if i % 9 else None, None) for i, t in enumerate(texts)]
    return [*rows, (None, base[0], None, "s1", None), (3, base[3], None, "s1", None)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).withColumn("h1", F.lit("clash")).withColumn("size", F.lit(1)).repartition(3)


def shingle_set(text, k):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates(docs, rows, k):
    got = [tuple(r) for r in near_duplicates(docs, words=k).select("doc_id", "n_shingles", "component_id", "kept").collect()]
    sets = [(r[0], shingle_set(r[1], k)) for r in rows]
    parent = {i: i for i, _ in sets if i is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, (a, s) in enumerate(sets):
        for b, t in sets[:n]:
            if a is not None and b is not None and s and t and 100 * len(s & t) >= 80 * len(s | t):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    want = [(i, len(s), None if i is None else root(i), i is None or root(i) == i) for i, s in sets]
    assert Counter(got) == Counter(want)


def test_crowded_buckets(spark):
    """A family around one text whose smallest member links with none but a few."""
    base = prose(100).split()
    texts = []
    for i in range(60):
        w = list(base)
        for j in RNG.choice(100, 25 if i == 0 else int(RNG.integers(0, 8)), replace=False):
            w[j] = f"w{i}_{j}"
        texts.append((i, " ".join(w)))
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates(spark.createDataFrame(texts, "doc_id long, text string"), words=2).collect()}
    sets = [shingle_set(t, 2) for _, t in texts]
    comp = list(range(60))
    for _ in range(60):
        for a in range(60):
            for b in range(60):
                if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    comp[a] = comp[b] = min(comp[a], comp[b])
    assert [got[i] for i in range(60)] == comp


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 101), (7, 7), (200, 3)]
    got = {r[0]: r[1] for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in [*range(51), 200]} | {100: 100, 101: 100}


def test_archive(spark, tmp_path):
    pages = [(1, "u", "aé"), (2, None, "aé"), (3, "v\r\nx", None), (4, "w", ""), (None, "n", "zz"), (9, "o", "zz"), (9, "o", "zz"), (5, "p", "only")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    write_archive(df, str(tmp_path / "a"))
    got = Counter(map(tuple, read_records(spark, str(tmp_path / "a")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()))
    want = Counter()
    for i, _, h in pages:
        b = (h or "").encode()
        owner = min(p for p, _, g in pages if (g or "") == (h or "") and p is not None)
        want[i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if i == owner else "revisit", None if i == owner else owner] += 1
    assert got == want
    assert spark.read.parquet(str(tmp_path / "a/payloads")).count() == 4
    records = {(r["page_id"], bytes(r["record"])) for r in reconstruct(spark, str(tmp_path / "a")).collect()}
    body = next(b for i, b in records if i == 1)
    head, _, rest = body.partition(b"\r\n\r\n")
    assert head.startswith(b"WARC/1.1\r\nWARC-Type: response") and rest.endswith("aé".encode() + b"\r\n\r\n")
    assert int(re.search(rb"Content-Length: (\d+)$", head)[1]) == len(rest) - 4
    write_archive(df, str(tmp_path / "b"), least=3)
    assert {r["record_type"] for r in read_records(spark, str(tmp_path / "b")).where("payload_bytes < 3").collect()} == {"response"}


def test_empty_archive(spark, tmp_path):
    write_archive(spark.createDataFrame([], "page_id long, url string, html string"), str(tmp_path / "a"))
    assert read_records(spark, str(tmp_path / "a")).count() == 0


@pytest.mark.parametrize("most", [1, 300, 70_000, 2**59, 2**64 - 1])
@pytest.mark.parametrize("n", [0, 1, 1024, 1025, 3000])
def test_simple8b(n, most):
    ids = RNG.integers(0, most, n, dtype=np.uint64, endpoint=True)
    ids[: n // 2] >>= np.uint64(7)
    words, blocks = simple8b(ids)
    assert (decoded(words) == ids).all()
    if n > 1024:
        assert (decoded_blocks(words, blocks, 1, 2) == ids[1024:2048]).all()


def ids_of(name, text, end):
    t = tokenizers.Tokenizer.from_file(P.path(name))
    t.encode_special_tokens = True
    return np.array([*t.encode(text or "", add_special_tokens=False).ids, end], "<u4")


def test_token_files(spark, docs, rows, tmp_path):
    write_token_files(docs, str(tmp_path / "t"), tokenizer=P.path("byte_bpe_50k.json"))
    got = read_token_files(spark, str(tmp_path / "t"), with_ids=True).orderBy("start").collect()
    want = sorted(((r[0], r[1]) for r in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    at = 0
    for r, (i, text) in zip(got, want, strict=True):
        ids = ids_of("byte_bpe_50k.json", text, 0)
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (i, at, len(ids), zlib.crc32(ids.tobytes()))
        assert bytes(r["ids"]) == ids.tobytes()
        at += len(ids)


def test_packing(docs, rows):
    got = pack(docs, tokenizer=P.path("word_bpe_49k.json"), length=256).collect()
    pieces, sequences = {}, {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        pieces.setdefault((r["doc_id"], r["start"]), []).append(bytes(r["ids"]))
        assert r["ids_crc32"] == zlib.crc32(bytes(r["ids"]))
    for s in sequences.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at == 256 or at & (at - 1) == 0
    assert sum(len(x) // 4 for v in pieces.values() for x in v) == sum(len(ids_of("word_bpe_49k.json", r[1], 1)) for r in rows)
    for i in {r[0] for r in rows if r[0] not in (None, 3)}:
        text = next(r[1] for r in rows if r[0] == i)
        assert b"".join(x[0] for (d, _), x in sorted((k, v) for k, v in pieces.items() if k[0] == i)) == ids_of("word_bpe_49k.json", text, 1).tobytes()


def test_hilbert():
    grid = np.array([[a, b, c] for a in range(4) for b in range(4) for c in range(4)])
    keys = hilbert_keys(grid, 2)
    assert sorted(keys) == list(range(64)) and (np.abs(np.diff(grid[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()


def test_languages(spark):
    kinds = {"xx": "abcdef", "yy": "ghijkl", "zz": "çñöüéè"}
    made = [(i, " ".join("".join(RNG.choice(list(kinds[k]), 5)) for _ in range(30)), k) for i in range(60) for k in [sorted(kinds)[i % 3]]]
    made += [(90, None, "xx"), (91, "12 ?", "yy"), (None, "abc", "zz"), (92, "ab" * 40_000, None)]
    df = spark.createDataFrame(made, "doc_id long, text string, lang string")
    profiles = language_id.learn(df.where("doc_id % 5 <> 0"))
    got = {r["doc_id"]: r for r in language_id.identify(df, profiles).collect()}
    assert all(got[i]["lang_pred"] == k for i, _, k in made[:60])
    assert got[90]["lang_pred"] == got[91]["lang_pred"] == "und" and got[92]["lang_pred"] == "xx"
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert language_id.learn(df.where("false")) == {} and language_id.identify(df, {}).where("lang_pred <> 'und'").count() == 0


def test_repeats(docs, rows):
    length = 60
    got = Counter(tuple(r) for r in remove_repeats(docs, length=length, digit=20).drop("kept").collect())
    texts = [(r[1] or "").encode() for r in rows]
    seen = Counter(t[p : p + length] for t in texts for p in range(len(t) - length + 1))
    want = Counter()
    for (i, *_), t in zip(rows, texts, strict=True):
        gone = bytearray(len(t))
        for p in range(len(t) - length + 1):
            if seen[t[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        want[i, len(t), sum(gone), len(re.findall(rb"\x01+", bytes(gone))), hashlib.sha256(kept).hexdigest()] += 1
    assert got == want


def test_mixing(docs, rows):
    got = mix_sources(docs).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        assert r["size"] == len((r["text"] or "").encode().split()) and r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 3
        by.setdefault(r["source"], []).append(r)
    total = sum(r["size"] for r in got)
    assert sum(v[0]["target"] for v in by.values()) == pytest.approx(total)
    for v in by.values():
        assert v[0]["source_size"] == sum(r["size"] for r in v) and v[0]["target"] <= 3 * v[0]["source_size"]
        assert abs(sum(r["taken"] for r in v) - v[0]["target"]) <= max(r["size"] for r in v) + 1e-6
        # systematic sampling, recomputed: one offset, boundaries crossed in the order of sizes
        order = sorted(v, key=lambda r: (r["size"], hashlib.md5(str(r["doc_id"]).encode()).hexdigest() if r["doc_id"] is not None else "", r["doc_id"] or 0))
        name = ":".join(["20011"] + ([v[0]["source"]] if v[0]["source"] is not None else []))
        offset, rate = int(hashlib.md5(name.encode()).hexdigest()[:8], 16) / 2**32, v[0]["target"] / v[0]["source_size"] if v[0]["source_size"] else 0.0
        want = [math.floor(k * rate + offset) - math.floor((k - 1) * rate + offset) for k in range(1, len(v) + 1)]
        assert [r["copies"] for r in order if r["size"]] == [c for c, r in zip(want, order, strict=True) if r["size"]]
    again = mix_sources(docs.repartition(2)).collect()
    assert Counter((r["doc_id"], r["copies"]) for r in got) == Counter((r["doc_id"], r["copies"]) for r in again)


def test_trigram_queries():
    assert trigram_query("[0-9a-f]+") is None
    for rule in RULES:
        clauses = trigram_query(rule.pattern)
        assert clauses is None or all(len(c) > 0 for c in clauses)
    assert trigram_query("(abc|de)fg") == [frozenset({"abc", "bcf", "cfg"}), frozenset({"def", "efg"})]


def test_secrets(docs, spark):
    odd = ["é token=abcdef Secret: token: abcdefgh 😀 API_KEY = 'xyz1234' " + "deadbeef" * 4, "password==aaa passwd:abcdef,apikey:\"" + "ab12" * 7 + '"', "-----BEGIN RSA PRIVATE KEY-----", "gho_" + "a" * 36]
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(1000 + i, t) for i, t in enumerate(odd)], "doc_id long, text string"))
    got = find_secrets(df).select("text", listed(F.col("secrets")).alias("s"), redacted(F.col("text"), F.col("secrets")).alias("r")).collect()
    patterns = [(r, re.compile(r.pattern, re.A)) for r in RULES]
    for row in got:
        text = row["text"] or ""
        spans = sorted((m.start(), k, r.kind, m.end()) for k, (r, p) in enumerate(patterns) for m in p.finditer(text) if len(m[r.group]) >= r.least)
        assert row["s"] == ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in spans)
        assert row["r"] == row["text"] or "[SECRET]" in row["r"]
    assert len(BASE_RULES) == 3


def test_quality(spark, docs, rows):
    field = line_crf.LineField(np.ones(int(line_crf.OFFSETS[-1])), np.zeros((2, 2)), np.zeros(2))
    for r in line_crf.quality(docs.select("doc_id", "text"), field).collect():
        text = r["text"] or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        triples = Counter(zip(w, w[1:], w[2:], strict=False))
        covered = {i + d for i in range(len(w) - 2) if triples[tuple(w[i : i + 3])] > 1 for d in range(3)}
        assert (r["n_words"], r["word_chars"], r["n_symbols"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)))
        assert (r["n_dup_lines"], r["n_repeat_words"]) == (len(lines) - len(set(lines)), len(covered))
        assert r["base_failed"] == (len(w) < 50 or 100 * len(covered) > 50 * len(w)) and r["kept"] == (not r["base_failed"])


def test_viterbi_and_fit():
    size = int(line_crf.OFFSETS[-1])
    field = line_crf.LineField(RNG.normal(size=size), RNG.normal(size=(2, 2)), RNG.normal(size=2))
    codes = np.stack([RNG.integers(a, b, 7) for a, b in zip(line_crf.OFFSETS, line_crf.OFFSETS[1:], strict=False)], axis=1)

    def score(y):
        return field.begin[y[0]] + sum(field.emit[c].sum() * v for c, v in zip(codes, y, strict=True)) + sum(field.step[a, b] for a, b in zip(y, y[1:], strict=False))

    best = max((tuple(map(int, f"{k:07b}")) for k in range(128)), key=score)
    assert tuple(line_crf.viterbi(field, codes)) == best
    good, bad = codes.copy(), codes.copy()
    good[:, 1], bad[:, 1] = line_crf.OFFSETS[1], line_crf.OFFSETS[1] + 3
    fitted = line_crf.fit([good, bad] * 5, [np.ones(7, int), np.zeros(7, int)] * 5)
    assert line_crf.viterbi(fitted, good).all() and not line_crf.viterbi(fitted, bad).any()


def test_line_labels():
    """Lines take weak labels of their own, a good document stays mostly content, another one doesn't become it."""
    clean, junk = np.array([line_crf.OFFSETS[:-1] + 1]), np.array([line_crf.OFFSETS[1:] - 1])
    stack = lambda *parts: np.concatenate(parts)
    sequences = [*[np.repeat(clean, 6, axis=0)] * 8, *[np.repeat(junk, 6, axis=0)] * 8, stack(clean, clean, clean, junk), stack(junk, junk, junk, clean), stack(junk, junk), stack(clean, clean)]
    quality = [1] * 8 + [0] * 8 + [1, 0, 1, 0]
    labels = [y.tolist() for y in line_crf.line_labels(sequences, [np.full(len(x), 5) for x in sequences], quality)]
    assert labels == [[1] * 6] * 8 + [[0] * 6] * 8 + [[1, 1, 1, 0], [0, 0, 0, 1], [1, 1], [0, 0]]


def test_quality_shares(spark):
    """The field of the real labels marks a menu pasted into a good text, and leaves the text."""
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    field = line_crf.train(docs, labels)
    menu = "\n".join(["Home | About | Contact | Login", "$$$ ### *** %%%", "Menu | Shop | Cart ***", "<b> | <i> | ### | &&&"] * 2)
    good = docs.join(labels.where("quality = 1"), "doc_id").where("size(split(text, '\n')) > 6").orderBy("doc_id").limit(12).select("doc_id", "text").collect()
    mixed = [(r["doc_id"], "\n".join(x for k, x in enumerate(r["text"].split("\n")) for x in ([menu, x] if k == 3 else [x]))) for r in good]
    shares = [r["content_share"] for r in line_crf.quality(spark.createDataFrame(mixed, "doc_id long, text string"), field).collect()]
    assert len(shares) == 12 and all(0.3 < x < 1 for x in shares)
    long = spark.createDataFrame([(1, "\n".join(f"line {k} of a long text" for k in range(50_000))), (2, None)], "doc_id long, text string")
    line_crf.train(long, spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int"))


def exact_nearest(rows, asks, k=5):
    """query_id -> per asking row the (vec_id, score) of its k nearest by brute force; rows are (vec_id, vector)."""
    x = np.array([v for _, v in rows], float)
    ids, norm = np.array([i for i, _ in rows]), np.sqrt((x**2).sum(axis=1))
    out = []
    for q in asks:
        s = (x * x[q]).sum(axis=1) / (norm * norm[q])
        order = sorted((i for i in range(len(rows)) if i != q), key=lambda i: (-s[i], ids[i]))[:k]
        out.append((int(ids[q]), tuple(int(ids[i]) for i in order), s[order]))
    return out


def test_nearest(spark):
    x = RNG.normal(size=(400, 8)).astype(np.float32)
    x[100:130] = x[7]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    rows += [(50, rows[50][1]), (50, rows[51][1]), (61, rows[61][1])]  # repeated rows and ids
    odd = [(500, None), (550, [0.0] * 8), (600, [float("nan")] * 8), (650, [None] * 8), (None, [1.0] * 8), (700, [1.0, 2.0]), (800, [])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").withColumn("row", F.lit(1)).withColumn("score", F.lit("x"))
    for shard_rows in (150, 20):
        got = {}
        for r in nearest(df, F.col("vec_id") % 50 == 0, factor=1.0, shard_rows=shard_rows).collect():
            got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
        want = exact_nearest(rows, [i for i, (v, _) in enumerate(rows) if v % 50 == 0])
        assert set(got) == {i for i, _, _ in want}
        for i in got:
            mine = sorted((rank, v, round(c, 12)) for rank, v, c in got[i])
            assert mine == sorted((k + 1, v, round(float(c), 12)) for j, vs, cs in want if i == j for k, (v, c) in enumerate(zip(vs, cs, strict=True)))
    assert nearest(df.where("false"), F.col("vec_id") % 50 == 0).count() == 0
    assert nearest(df.where("vec_id = 700"), F.col("vec_id") % 50 == 0).count() == 0


@pytest.mark.parametrize(("spread", "share"), [(0.1, 0.35), (None, 1.0)])
def test_recall_and_visited(spark, spread, share):
    """Recall of the production factor and the share of vectors that a query meets: few on clustered vectors, most on others."""
    rng = np.random.default_rng(11)
    x = rng.normal(size=(4000, 32))
    if spread:
        x = rng.normal(size=(40, 32))[rng.integers(0, 40, 4000)] + spread * x
    rows = [(i, r.tolist()) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got, visited = {}, {}
    for r in nearest(df, F.col("vec_id") % 50 == 0, shard_rows=128).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
        visited[r["query_id"]] = r["visited"]
    want = exact_nearest(rows, range(0, 4000, 50))
    recall = np.mean([len(got[i] & set(v)) / 5 for i, v, _ in want])
    assert recall >= 0.9 and np.mean(list(visited.values())) / len(rows) <= share, (recall, np.mean(list(visited.values())) / len(rows))


@pytest.mark.parametrize("empty", ["near", "repeats", "mix", "secrets", "pack", "quality"])
def test_empty_tables(spark, empty):
    none = spark.createDataFrame([], DOCS)
    made = {
        "near": lambda: near_duplicates(none),
        "repeats": lambda: remove_repeats(none),
        "mix": lambda: mix_sources(none),
        "secrets": lambda: find_secrets(none),
        "pack": lambda: pack(none, tokenizer=P.path("word_bpe_49k.json")),
        "quality": lambda: line_crf.quality(none, line_crf.train(none, spark.createDataFrame([], "doc_id long, quality int"))),
    }
    assert made[empty]().count() == 0
