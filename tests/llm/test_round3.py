"""Winnowing, the Merkle manifest and collocations against brute force, with nulls, blanks, ties and repeated rows."""

import hashlib
import random
import re
from collections import Counter
from itertools import pairwise

import numpy as np
import pytest
from pyspark.sql import functions as F

from proofrecon.llm import language_id, merkle
from proofrecon.llm.collocations import collocations
from proofrecon.llm.mixing import mix_sources
from proofrecon.llm.secret_scan import RULES, find_secrets
from proofrecon.llm.token_files import read_documents, write_token_files
from proofrecon.llm.winnowing import Windows, decontaminate

RNG = random.Random(3)
VOCABULARY = ["".join(RNG.choices("abcdeé1", k=RNG.randint(1, 6))) for _ in range(200)]
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def prose(n):
    return " ".join(RNG.choices(VOCABULARY, k=n))


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


# ---------------------------------------------------------------- winnowing

PASSAGE = prose(30)
ITEMS = [(1, PASSAGE), (2, prose(10)), (3, "Short item, five WORDS"), (4, "x"), (5, None), (6, " -- "), (7, PASSAGE), (None, prose(12)), (10, "Short item, five WORDS"), (11, prose(9))]
DOCS = [
    (1, "Before " + PASSAGE.upper().replace(" ", " , ") + " after"), (2, " ".join(PASSAGE.split()[5:15])), (3, " ".join(PASSAGE.split()[5:14])), (4, None), (5, ""), (6, "..."),
    (7, "a short-item five/words b short item five words"), (8, "x y x"), (9, prose(500) + " " + ITEMS[1][1]), (9, prose(500)), (None, ITEMS[7][1]), (12, PASSAGE + " " + PASSAGE), (13, prose(20_000) + " " + PASSAGE),
    (14, ITEMS[9][1]), (15, " ".join(ITEMS[9][1].split()[1:])),
]


def judged(text, windows):
    words = WORD.findall(lower(text))
    hit, items = set(), set()
    for n in {len(w) for w in windows}:
        for s in range(len(words) - n + 1):
            found = windows.get(tuple(words[s : s + n]))
            if found is not None:
                hit |= set(range(s, s + n))
                items |= found
    return len(words), hit, sorted(items)


def item_windows(items):
    out = {}
    for i, text in items:
        words = WORD.findall(lower(text))
        n = min(10, len(words))
        for s in range(len(words) - n + 1) if n else ():
            out.setdefault(tuple(words[s : s + n]), set()).update([] if i is None else [str(i)])
    return out


@pytest.mark.parametrize("items", [ITEMS, [], ITEMS[5:6]])
def test_decontaminate(spark, items):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string").withColumn("items", F.lit("clash")).repartition(3)
    found = decontaminate(docs, spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1)))
    got = [(r["doc_id"], r["n_words"], r["n_hit"], [tuple(s) for s in r["spans"]], r["items"], r["contaminated"]) for r in found.collect()]
    windows, want = item_windows(items), []
    for i, text in DOCS:
        n, hit, own = judged(text, windows)
        starts, ends = [h for h in sorted(hit) if h - 1 not in hit], [h + 1 for h in sorted(hit) if h + 1 not in hit]
        want.append((i, n, len(hit), list(zip(starts, ends, strict=True)), own, bool(hit)))
    assert Counter(map(str, got)) == Counter(map(str, want))


def test_no_documents(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert decontaminate(docs, spark.createDataFrame(ITEMS, "item_id long, text string")).count() == 0


def test_shared_span_shares_a_fingerprint():
    """The guarantee of winnowing: equal windows in unlike texts have equal fingerprints and hashes."""
    for n in (1, 2, 5, 9, 10):
        span = prose(n)
        a, b = Windows([(prose(7) + " " + span + " " + prose(4)).encode()]), Windows([(prose(2) + "; " + span).encode(), b"z"])
        fa, fb = a.fingerprints(n), b.fingerprints(n)
        assert fa[7] == fb[2] and [x[0] for x in a.hashes(np.array([7]), n)] == [x[0] for x in b.hashes(np.array([2]), n)]


# ---------------------------------------------------------------- manifest


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(leaves, arity):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][k : k + arity]) for k in range(0, len(levels[-1]), arity)])
    return levels


def path(levels, at, arity):
    out = []
    for level in levels[:-1]:
        head = at // arity * arity
        out.append(("".join(level[head:at]), "".join(level[at + 1 : head + arity])))
        at //= arity
    return out


@pytest.mark.parametrize(("arity", "segment"), [(2, 4), (3, 8), (2, 4096)])
def test_manifest(spark, monkeypatch, arity, segment):
    monkeypatch.setattr(merkle, "SEGMENT", segment)
    langs = ["en"] * 37 + ["de"] + [None] * 5 + ["ü"] * 2 + [""] * 3
    rows = [(RNG.randint(0, 25) if RNG.random() < 0.9 else None, x, h(str(k % 40))) for k, x in enumerate(langs)]
    frame = spark.createDataFrame(rows, "doc_id long, lang string, leaf string").withColumn("proof", F.lit("clash")).repartition(5)
    got = [(r["doc_id"], r["lang"], r["leaf"], r["subroot"], r["root"], [tuple(s) for s in r["proof"]]) for r in merkle.manifest(frame, tree="lang", order="doc_id", arity=arity).collect()]
    groups = {}
    for i, x, leaf in rows:
        groups.setdefault(x, []).append(((i is not None, i or 0, leaf), i, leaf))
    keys = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: tree([leaf for *_, leaf in sorted(groups[x])], arity) for x in keys}
    top = tree([trees[x][-1][0] for x in keys], arity)
    want = [(i, x, leaf, trees[x][-1][0], top[-1][0], path(trees[x], at, arity) + path(top, keys.index(x), arity)) for x in keys for at, (_, i, leaf) in enumerate(sorted(groups[x]))]
    assert Counter(map(str, got)) == Counter(map(str, want))


def test_small_manifests(spark):
    one = spark.createDataFrame([(1, "en", "leaf")], "doc_id long, lang string, leaf string")
    row = merkle.manifest(one, tree="lang", order="doc_id").first()
    assert (row["subroot"], row["root"], row["proof"]) == ("leaf", "leaf", [])
    assert merkle.manifest(one.limit(0), tree="lang", order="doc_id").count() == 0


def test_forest_is_a_monoid():
    """Any grouping and order of merges gives the same unresolved nodes."""
    sizes = [1, 2, 7, 16, 33]
    nodes = [((t, n, 0, k), h(str(t), str(k))) for t, n in enumerate(sizes) for k in range(n)]
    want = merkle.merge(nodes, 2, len(sizes))[0]
    assert [k[0] for k in want] == [-1] and len(want) == 1
    for _ in range(20):
        RNG.shuffle(nodes)
        edges = sorted(RNG.sample(range(len(nodes)), 4))
        parts = [merkle.merge(nodes[a:b], 2, len(sizes))[0] for a, b in pairwise([0, *edges, len(nodes)])]
        while len(parts) > 1:
            a, b = parts.pop(RNG.randrange(len(parts))), parts.pop(RNG.randrange(len(parts)))
            parts.append(merkle.merge([*a.items(), *b.items()], 2, len(sizes))[0])
        assert parts[0] == want


def test_leaf_and_fold(spark):
    rows = spark.createDataFrame([(1, None, "é"), (None, "a:b", "")], "i long, a string, b string")
    got = [r[0] for r in rows.select(merkle.leaf_digest(F.col("i"), F.col("a"), F.col("b"))).collect()]
    assert got == [h("1:1", "-", "2:é"), h("-", "3:a:b", "0:")]
    proof = F.array(F.struct(F.lit("x").alias("before"), F.lit("").alias("after")), F.struct(F.lit("").alias("before"), F.lit("").alias("after")))
    row = rows.limit(1).select(merkle.folded(F.lit("leaf"), proof), merkle.proof_digest(proof)).first()
    assert tuple(row) == (h(h("x", "leaf")), h("x"))


# ---------------------------------------------------------------- collocations


def strongest(docs, least, longest, best):
    total, f = Counter(), {}
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            own = f.setdefault(lang, Counter())
            own.update(tuple(words[s : s + n]) for n in range(1, longest + 1) for s in range(len(words) - n + 1))
    out = []
    for lang, counts in f.items():
        rows, longer = [], Counter()
        often = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        for p, a in often.items():
            for n in range(2, len(p)):
                for s in range(len(p) - n + 1):
                    longer[p[s : s + n]] = max(longer[p[s : s + n]], a)
        for p, a in often.items():
            score, at = min((1000 * a * total[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            if longer[p] < a:
                rows.append((-score, -a, " ".join(p).encode(), at, counts[p[:at]], counts[p[at:]]))
        out += [(lang, rank, p.decode(), -a, x, y, total[lang], -s, at) for rank, (s, a, p, at, x, y) in enumerate(sorted(rows)[:best], 1)]
    return out


ODD = ["a\x00b c\x00", "é\x1f b.c,d", "A\tb  C\rd", ". , ;", "", None, "x" * 3000 + " y", "one"]
TALK = [prose(RNG.randint(1, 60)).replace(" e", ". ").replace(" d", "\t") for _ in range(300)] + ["the cat sat on the mat the cat sat"] * 40 + ["so so so so so so so"] * 9 + ODD


@pytest.mark.parametrize(("least", "best"), [(3, 2000), (8, 15), (1, 50)])
def test_collocations(spark, least, best):
    docs = [(("en", "de", None, "und", "x\ny")[k % 5], t) for k, t in enumerate(TALK)]
    frame = spark.createDataFrame(docs, "lang string, text string").withColumn("a", F.lit(1)).withColumn("rank", F.lit(2)).repartition(4)
    got = [tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score", "at")) for r in collocations(frame, least=least, best=best).collect()]
    assert sorted(got) == sorted(strongest(docs, least, 5, best))


def test_hot_pairs(spark):
    """Pairs of coded words are dealt to several tasks; their counts are summed."""
    text = " ".join(RNG.choices("ab", k=4000))
    got = {r["phrase"]: r["a"] for r in collocations(spark.createDataFrame([("en", text)] * 3, "lang string, text string").repartition(3), least=5).collect()}
    assert got == {p: a for _, _, p, a, *_ in strongest([("en", text)] * 3, 5, 5, 2000)}


def test_no_text(spark):
    assert collocations(spark.createDataFrame([(None, None), ("en", " . ")], "lang string, text string")).count() == 0
    assert collocations(spark.createDataFrame([], "lang string, text string")).count() == 0


# ---------------------------------------------------------------- earlier operators


def test_languages_by_plain_distances(spark):
    """Every prediction and score recomputed from gram counts with plain dictionaries."""
    kinds = {"aa": "abcde fgh", "bb": "cdefg hij", "cc": "éèàüñ abc"}
    docs = [(i, " ".join("".join(RNG.choices(kinds[x].replace(" ", ""), k=RNG.randint(1, 7))) for _ in range(RNG.randint(1, 40))), x) for i in range(60) for x in [sorted(kinds)[i % 3]]]
    docs += [(100, "A-B c1d", None), (101, "??", None), (102, None, None), (103, "zzz", None)]

    def grams_of(text):
        out = Counter()
        for word in re.findall(r"[^\W\d_]+", text.lower()):
            padded = "\1" + word + "\1"
            for n in (1, 2, 3):
                out.update(padded[s : s + n] for s in range(len(padded) - n + 1) if padded[s : s + n].strip("\1") and "\1" not in padded[s + 1 : s + n - 1] and not (n == 3 and padded[s] == padded[s + 2] == "\1"))
        return out

    def ranked(counts):
        code = lambda g: sum((1 if c == "\1" else ord(c) + 2) << (21 * (len(g) - 1 - k)) for k, c in enumerate(g))
        return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], code(x[0])))[: language_id.RANKS]]

    learned = [d for d in docs if d[2] and d[0] % 4]
    profiles = {x: ranked(sum((grams_of(t) for _, t, y in learned if y == x), Counter())) for x in kinds}
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    fitted = language_id.learn(frame.where("doc_id % 4 <> 0"))
    got = {r["doc_id"]: (r["lang_pred"], round(r["score"], 9)) for r in language_id.identify(frame.select("doc_id", "text"), fitted).collect()}
    for i, text, _ in docs:
        own = ranked(grams_of(text or ""))
        if not own:
            assert got[i] == ("und", 0.0)
            continue
        far = {x: sum(abs(p.index(g) - k) if g in p else language_id.RANKS for k, g in enumerate(own)) for x, p in profiles.items()}
        best = min(sorted(far), key=far.get)
        assert got[i] == (best, round(1 - far[best] / (language_id.RANKS * len(own)), 9)), i


def test_reading_some_documents(spark, tmp_path):
    public = pytest.importorskip("public_tokenizers")
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    docs = [(k, prose(RNG.choice([0, 3, 700, 3000]))) for k in range(30)] + [(None, "x"), (5, "again")]
    write_token_files(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), str(tmp_path / "t"), tokenizer=public.path("byte_bpe_50k.json"), end_id=0)
    got = Counter((r["doc_id"], tuple(np.frombuffer(r["ids"], "<u4").tolist())) for r in read_documents(spark, str(tmp_path / "t"), [5, 17, 29, 99]).collect())
    assert got == Counter((i, (*t.encode(text, add_special_tokens=False).ids, 0)) for i, text in docs if i in (5, 17, 29))


def test_mixing_recomputed(spark):
    """Copies of every document by a plain running sum in exact order, as the pipeline's mixing stage repeats them."""
    docs = [(k, prose(RNG.randint(0, 60)), RNG.choice(["a", "b", "b", None, "ü"])) for k in range(120)]
    rows = mix_sources(spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(3)).collect()
    got = {r["doc_id"]: r["copies"] for r in rows}
    target = {r["source"]: (r["target"], r["source_size"]) for r in rows}
    names = sorted({s for *_, s in docs}, key=lambda s: (s is None, s or ""))
    sizes = {s: sum(len(t.split()) for _, t, x in docs if x == s) for s in names}
    left, level = set(names), 0.0
    weight = {s: (1, 2, 3)[k % 3] for k, s in enumerate(names)}
    while True:
        level = (sum(sizes.values()) - sum(3 * sizes[s] for s in names if s not in left)) / sum(weight[s] for s in left)
        over = {s for s in left if 3 * sizes[s] < level * weight[s]}
        if not over:
            break
        left -= over
    for s in names:
        assert target[s][1] == sizes[s] and abs(target[s][0] - (level * weight[s] if s in left else 3 * sizes[s])) < 1e-6
        own = sorted(((len(t.split()), hashlib.md5(str(i).encode()).hexdigest(), i) for i, t, x in docs if x == s))
        offset = int(hashlib.md5(":".join(["20011"] + ([s] if s is not None else [])).encode()).hexdigest()[:8], 16) / 2**32
        rate = target[s][0] / sizes[s]
        for k, (*_, i) in enumerate(own, 1):
            assert got[i] == int(k * rate + offset) - int((k - 1) * rate + offset)


def test_many_secrets_in_one_text(spark):
    """Spans of a long text with very many matches, at their places."""
    text = "é " + " ".join(f"token=abcdef{k:06d}" for k in range(20_000))
    row = find_secrets(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    rule = next(r for r in RULES if r.kind == "assign")
    assert [(s["start"], s["end"]) for s in row["secrets"] if s["kind"] == "assign"] == [m.span() for m in re.finditer(rule.pattern, text)]
