"""Quality rules, language models and cross-entropy against plain Python."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from graphloom.llm import bitmaps as B
from graphloom.llm import cross_entropy as C
from graphloom.llm import kneser_ney as K
from graphloom.llm import quality as Q
from graphloom.llm.hash_array import HashArray

WORD = r"[^\x20\x09-\x0D]+"


def plain(t):
    words = re.findall(WORD, t or "")
    seen = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = set()
    for i in range(len(words) - 7):
        if seen[tuple(words[i : i + 8])] > 1:
            covered |= set(range(i, i + 8))
    lines = [x for x in (t or "").split("\n") if re.search(WORD, x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(covered)


def test_base():
    r = random.Random(4)
    for t in [None, "", " \n ", "a\xa0b\x1cc \x85", "x " * 40, "a b\na b\n\na b\n"]:
        assert Q.base(t) == plain(t)
    for _ in range(300):
        t = "".join(r.choice(["a", "b", "c", " ", " ", "\n", "#", "|", "é", "\t"]) for _ in range(r.randrange(120)))
        assert Q.base(t) == plain(t)


def symbols(t):
    return [int(x) for x in K.units("\n\n\n" + t)]


def brute(texts):
    """Modified Kneser-Ney of order 4 in plain Python: probability of a gram of symbols."""
    counts = [Counter(), Counter(), Counter(), Counter()]
    for t in texts:
        s = symbols(t)
        for i in range(3, len(s)):
            counts[3][tuple(s[i - 3 : i + 1])] += 1
    for k in (2, 1, 0):
        for g in counts[k + 1]:
            counts[k][g[1:]] += 1
    discounts, nexts = [], []
    for c in counts:
        n = [sum(v == i for v in c.values()) for i in range(1, 5)]
        y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0
        discounts.append([max(0.05, i - (i + 1) * y * n[i] / n[i - 1]) if n[0] and n[i - 1] else 0.5 for i in (1, 2, 3)])
        nexts.append({})
        for g, v in c.items():
            nexts[-1].setdefault(g[:-1], []).append(v)

    def p(gram, k):
        c, d = counts[k], discounts[k]
        lower = p(gram[1:], k - 1) if k else 1 / K.SYMBOLS
        after = nexts[k][gram[:-1]]
        cut = lambda v: min(d[min(v, 3) - 1], v)
        return (c[gram] - cut(c[gram]) + sum(map(cut, after)) * lower) / sum(after)

    return lambda gram: p(gram, 3)


def packed(gram):
    out = 0
    for x in gram:
        out = out << 16 | x
    return out


def costs(texts):
    """Mean bits a character of each text under the model of all of them."""
    p = brute([t or "" for t in texts])
    found = []
    for t in texts:
        s = symbols(t or "")
        found.append(float(np.mean([-np.log2(p(tuple(s[i - 3 : i + 1]))) for i in range(3, len(s))])) if len(s) > 3 else 0.0)
    return found


def test_model(spark):
    texts = ["the cat sat.", "the hat!", "a cat, a bat 12", "", "theé \U0001f600 猫"]
    docs = spark.createDataFrame([(t, "en") for t in [*texts, None]], "text string, lang string")
    counts = K.count(docs)
    p = brute(texts)
    grams = {packed(g) : g for t in texts for s in [symbols(t)] for g in zip(s, s[1:], s[2:], s[3:], strict=False)}
    table = {r["gram"] % (1 << 64): r["p"] for r in K.smooth(counts).collect()}
    assert set(table) == set(grams)
    for key, g in grams.items():
        assert table[key] == pytest.approx(p(g), rel=1e-9)


def test_stretches(monkeypatch):
    """Grams of texts of any length, in runs shorter than a text."""
    texts = ["abcdefghijklmnop", "", None, "x", "yz" * 9]
    want = Counter((i, packed(g)) for i, t in enumerate(texts) for s in [symbols(t or "")] for g in zip(s, s[1:], s[2:], s[3:], strict=False))
    for run in (5, 7, 16, 1 << 20):
        monkeypatch.setattr(K, "RUN", run)
        found = Counter()
        for owners, lengths, grams in K.runs(texts):
            assert lengths.sum() == len(grams)
            found.update(zip(np.repeat(owners, lengths).tolist(), grams.tolist(), strict=True))
        assert found == want


def test_hash_array():
    r = np.random.default_rng(1)
    for n in (0, 1, 5, 3000):
        keys = np.unique(r.integers(0, 1 << 63, n, dtype=np.uint64))
        array = HashArray(keys, np.arange(len(keys)) + 1.0)
        at = array.find(np.concatenate([keys, r.integers(0, 1 << 63, 500, dtype=np.uint64)]))
        assert array.values[0][at[: len(keys)]].tolist() == (np.arange(len(keys)) + 1.0).tolist()
        assert (at[len(keys) :] == len(keys)).all() and array.values[0][-1] == 0


def test_verdicts(spark):
    r = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "house", "river", "stone", "cloud"]
    clean = [" ".join(r.choice(words) for _ in range(60)) for _ in range(60)]
    junk = " ".join("zq" + r.choice("#|xjqzw") * 5 for _ in range(60))
    rows = [(i, t, "en", "kept!") for i, t in enumerate(clean)] + [(100, junk, "en", ""), (101, None, None, None), (102, "few words", "en", ""), (103, "same eight words come again and again here " * 6, "en", ""), (103, "same eight words come again and again here " * 6, "en", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, kept string")
    out = Q.op3(docs).collect()
    assert len(out) == len(rows)
    kept = {x["doc_id"]: x["kept"] for x in out}
    assert all(kept[i] for i in range(60)) and not any(kept[i] for i in (100, 101, 102, 103))
    assert not next(x for x in out if x["doc_id"] == 100)["base_failed"]
    passed = Q.passing(docs)
    assert passed.columns == docs.columns and sorted(x["doc_id"] for x in passed.collect()) == list(range(60))
    assert all(x["kept"] == "kept!" for x in passed.collect())
    assert Q.op3(docs.limit(0)).count() == 0


def test_cross_entropy(spark):
    r = random.Random(5)
    pick = lambda words, n: " ".join(r.choice(words) for _ in range(n))
    good, bad = ["law", "court", "judge", "case"], ["win", "cash", "now", "click"]
    rows = [(i, pick(good, 50)) for i in range(40)] + [(100 + i, pick(bad, 50)) for i in range(40)] + [(200, None), (201, ""), (None, pick(good, 30))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(20)] + [(100, 0, 0), (7777, 1, 0), (None, 1, 0), (0, 1, 0)], "doc_id long, quality int, toxic int")
    out = {x["doc_id"]: x for x in C.op9(docs, labels).collect()}
    assert len(out) == len(rows)
    assert max(out[i]["ce_diff"] for i in range(20, 40)) < min(out[i]["ce_diff"] for i in range(101, 140))  # held out
    assert out[200]["n_words"] == 0 and out[200]["ce_diff"] is None and out[201]["ce_diff"] is None
    assert out[None]["n_words"] == 30
    assert C.op9(docs.limit(0), labels).count() == 0
    assert C.op9(docs, labels.limit(0)).where("ce_diff is not null").count() == len(rows) - 2


def plain_scores(texts, target):
    """Both cross-entropies of each text, its own counts taken out, in plain Python."""
    words = [[w.lower() for w in re.findall(WORD, t or "")] for t in texts]
    v = max(1, len({w for x in words for w in x}))
    one, two, first = ([Counter(), Counter()] for _ in range(3))
    for x, is_target in zip(words, target, strict=True):
        k = 0 if is_target else 1
        one[k].update(x)
        two[k].update(zip([None, *x], x, strict=False))
        first[k][None] += bool(x)
    out = []
    for x, is_target in zip(words, target, strict=True):
        own, pairs = Counter(x), Counter(zip([None, *x], x, strict=False))
        found = []
        for k in (0, 1):
            less = 1 if is_target == (k == 0) else 0
            n = sum(one[k].values()) - less * len(x)
            p1 = lambda w: (one[k][w] - less * own[w] + C.PRIOR) / (n + C.PRIOR * v)  # noqa: E731, B023
            h = lambda a: one[k][a] - less * own[a] if a is not None else first[k][None] - less  # noqa: E731, B023
            bits = [-np.log2((two[k][a, b] - less * pairs[a, b] + C.MASS * p1(b)) / (h(a) + C.MASS)) for a, b in zip([None, *x], x, strict=False)]
            found.append(float(np.mean(bits)) if bits else None)
        out.append(found)
    return out


def test_scores_against_brute_force(spark, monkeypatch):
    """Hot or not, every word and bigram counts; repeated rows, rows without an id, long texts and clashing names."""
    r = random.Random(6)
    common, rare = [f"c{i}" for i in range(30)], [f"R{i}" for i in range(3000)]
    texts = [" ".join(r.choice(common if r.random() < 0.5 else rare) for _ in range(r.randrange(1, 80))) for _ in range(100)]
    texts += [texts[3], " ".join(["c0 c1"] * 30 + rare[:20]), " ".join(["c0 c1"] * 30 + rare[20:40]), None, "", " ".join(r.choice(common) for _ in range(150_000))]
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)] + [(None, texts[0], "x", 1)] * 2 + [(5, texts[5], "y", 2)]
    targets = {*range(60), 101, 105}
    want = plain_scores([x[1] for x in rows], [x[0] in targets for x in rows])
    docs = spark.createDataFrame(rows, "doc_id long, text string, `a.b` string, CE_diff int")
    asked = spark.createDataFrame([(i,) for i in [*targets, 7777, None, 3]], "doc_id long")
    for words, grams, bits in ((1 << 20, 1 << 21, 1 << 28), (20, 40, 1 << 10), (1, 1, 1 << 16)):  # all hot; some, and a full filter; none
        monkeypatch.setattr(C, "HOT_WORDS", words)
        monkeypatch.setattr(C, "HOT_GRAMS", grams)
        monkeypatch.setattr(B, "FILTER_BITS", bits)
        out = C.score(docs, asked)
        assert out.columns == ["doc_id", "text", "a.b", *C.NEW]
        found = out.collect()
        assert len(found) == len(rows)
        of = {(x[0], x[1]): (w, len(re.findall(WORD, x[1] or ""))) for x, w in zip(rows, want, strict=True)}
        for x in found:
            (t, b), n = of[x["doc_id"], x["text"]]
            assert x["n_words"] == n
            if n:
                assert [x["ce_target"], x["ce_background"], x["ce_diff"]] == pytest.approx([t, b, t - b], rel=1e-4, abs=1e-4)
            else:
                assert x["ce_target"] is None and x["ce_diff"] is None


def shuffled(spark):
    """Records that all stages so far have written to shuffles."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_no_row_for_each_bigram(spark):
    """60,000 cold bigrams, each in two documents, aren't rows of a shuffle."""
    r = random.Random(7)
    texts = [" ".join(f"w{r.randrange(5000)}" for _ in range(1000)) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts * 2)), "doc_id long, text string")
    before = shuffled(spark)
    assert len(C.score(docs, docs.select("doc_id").limit(30)).collect()) == 120
    assert shuffled(spark) - before < 5_000


def test_scores_of_many_blocks(spark, monkeypatch):
    """Blocks of one document or some, ranges of few keys or none; equal rows, and texts without words in blocks of their own."""
    r = random.Random(9)
    texts = [" ".join(r.choice(["Ab", "c", "d", "é", f"x{r.randrange(99)}"]) for _ in range(r.randrange(1, 60))) for _ in range(70)] + [" \n ", "", None]
    rows = [*enumerate(texts), (3, texts[3]), (3, texts[3]), (None, None)]
    want = plain_scores([t for _, t in rows], [i is not None and i < 20 for i, _ in rows])
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for block, of_keys in ((100, 700), (500, 200), (2000, 10**9)):
        monkeypatch.setattr(C, "BLOCK_BYTES", block)
        monkeypatch.setattr(C, "RANGE_BYTES", of_keys)
        found = C.score(docs, docs.select("doc_id").where("doc_id < 20")).collect()
        got = sorted((x["doc_id"] if x["doc_id"] is not None else -1, x["ce_target"] or 0, x["ce_background"] or 0) for x in found)
        assert got == [pytest.approx(x) for x in sorted((-1 if i is None else i, t or 0, b or 0) for (i, _), (t, b) in zip(rows, want, strict=True))]


def test_each_language_has_its_own_model(spark, monkeypatch):
    """Languages that one of 32 hashes would hold together, and more than are broadcast, are judged each by its own texts."""
    r = random.Random(8)
    langs = [None, "", "de", "pl", "en", "da", *(f"x{i}" for i in range(34))]
    own = {x: ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(5)] for x in langs}
    rows = [(x, " ".join(r.choice(own[x]) for _ in range(25 + len(x or ""))), k) for x in langs for k in range(3)] + [("x9", "", 9), ("x9", None, 9)]
    docs = spark.createDataFrame([(i, t, x) for i, (x, t, _) in enumerate(rows)], "doc_id long, text string, lang string")
    want = {}
    for x in ("de", "x7", None):
        one = [(i, t) for i, (y, t, _) in enumerate(rows) if y == x]
        want |= zip([i for i, _ in one], costs([t for _, t in one]), strict=True)
    for hot in (300, 1):
        monkeypatch.setattr(K, "HOT", hot)
        out = {x["doc_id"]: x for x in Q.op3(docs).collect()}
        assert len(out) == len(rows)
        for i, bits in want.items():
            assert out[i]["bits"] == pytest.approx(bits, rel=1e-4)
        bands = {rows[i][0]: x["band_low"] + x["band_high"] for i, x in out.items()}
        assert len({round(v, 6) for v in bands.values()}) > 30


def test_bands_against_brute_force(spark):
    """The verdict of every document, with ties, repeated rows, nulls and columns of clashing names."""
    r = random.Random(9)
    words = ["alpha", "beta", "gamma", "delta", "house", "river"]
    texts = [" ".join(r.choice(words) for _ in range(r.randrange(15, 60))) for _ in range(40)]
    texts += texts[:5] + [texts[0]] * 3 + [None, "", " ".join("zq#" * 4 for _ in range(25)), " ".join("".join(r.choice("qxzjkv") for _ in range(7)) for _ in range(40)), "long " * 3 + "".join(f" w{i}" for i in range(200_000))]
    rows = [(i, t, "en", -1, "mine", 5.0) for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, texts[7], "en", -1, "mine", 5.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, KEPT long, `a.b` string, Bits double")
    bits = costs([x[1] for x in rows])
    plain_base = [plain(x[1]) for x in rows]
    failed = [b[0] < 20 or 100 * b[4] > 30 * b[0] for b in plain_base]
    ranked = sorted(b for b, f in zip(bits, failed, strict=True) if not f)
    low, mid, high = (ranked[max(0, int(np.ceil(len(ranked) * q)) - 1)] for q in (0.25, 0.5, 0.75))
    want = Counter()
    for x, b, f, base in zip(rows, bits, failed, plain_base, strict=True):
        half = Q.REACH * max(Q.SPREAD, high - low) * (1 + 10 / max(base[1], 1) ** 0.5)
        want[(x[0], not f and mid - half <= b <= mid + half)] += 1
    out = Q.quality(docs)
    assert [c for c in out.columns if c.lower() in ("kept", "bits")] == ["bits", "kept"] and "a.b" in out.columns
    assert Counter((x["doc_id"], x["kept"]) for x in out.collect()) == want
    assert {k for (_, k) in want} == {True, False}
    passed = Q.passing(docs)
    assert passed.columns == docs.columns
    assert Counter(x["doc_id"] for x in passed.collect()) == Counter({i: n for (i, k), n in want.items() if k})
    assert Q.passing(docs.limit(0)).count() == 0
