"""SimHash, line templates and decontamination against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from graphloom.llm import bitmaps as B
from graphloom.llm import decontaminate as D
from graphloom.llm import line_dedup as L
from graphloom.llm import simhash as H

WORD = r"[^\x20\x09-\x0D]+"


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def plain_fingerprint(t):
    import xxhash

    words = re.findall(WORD, lower(t))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints():
    r = random.Random(1)
    for t in [None, "", " ", "One", "a B", "a b c", "x " * 900] + ["".join(r.choice(["Ab", "é", "c", " ", "\n", "\x1f"]) for _ in range(r.randrange(80))) for _ in range(60)]:
        assert H.fingerprint(t) % (1 << 64) == plain_fingerprint(t), t


def test_links_are_complete(spark):
    """Random fingerprints with planted neighbours at up to five differing bits."""
    r = random.Random(2)
    prints = [r.getrandbits(64) for _ in range(60)] + [0, (1 << 64) - 1]
    for x in prints[:40]:
        for bits in range(1, 6):
            y = x
            for b in r.sample(range(64), bits):
                y ^= 1 << b
            prints.append(y)
    prints = list(dict.fromkeys(prints))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    distinct = spark.createDataFrame([(signed(x), i) for i, x in enumerate(prints)], "fp long, rep long")
    want = {frozenset((i, j)) for i, x in enumerate(prints) for j, y in enumerate(prints[:i]) if (x ^ y).bit_count() <= 3}
    for blocks in H.BLOCKS:
        found = H.links(distinct, blocks=blocks).collect()
        assert len(found) == len(want) and {frozenset((x["a"], x["b"])) for x in found} == want


def test_comparisons_grow_with_the_fingerprints():
    """By chance a fingerprint meets less than one other in all of its cells, whatever their number."""
    assert H.blocks_for(1000) == H.BLOCKS[0]
    for n in (10**5, 10**6, 10**7, 5 * 10**7):
        meets = n * sum(H.ALIKE ** ((c % (1 << 64)).bit_count() / 2) for c in H.cells(H.blocks_for(n)))
        assert meets < 1, (n, meets)


def test_embedding_bounds(spark):
    r = random.Random(3)
    rows = [(r.getrandbits(64) - (1 << 63), r.getrandbits(64) - (1 << 63)) for _ in range(50)]
    df = spark.createDataFrame(rows, "a long, b long").select("a", "b", F.bit_count(H.embedding("a").bitwiseXOR(H.embedding("b"))).alias("d"))
    for x in df.collect():
        counts = lambda v: [(v >> (2 * i) & 3).bit_count() for i in range(32)]
        a, b = x["a"] % (1 << 64), x["b"] % (1 << 64)
        assert x["d"] == sum(abs(p - q) for p, q in zip(counts(a), counts(b), strict=True)) <= (a ^ b).bit_count()


def test_components(spark):
    r = random.Random(4)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, n = [], 0
    for _ in range(25):
        words = [r.choice(vocabulary) for _ in range(120)]
        for _ in range(r.randrange(1, 5)):
            rows.append((n, " ".join(words)))
            n += 1
            words = list(words)
            words[r.randrange(120)] = "changed"
    rows += [(n, None), (n + 1, ""), (n + 2, "  "), (n + 3, rows[0][1]), (n + 3, rows[0][1]), (None, rows[1][1])]
    docs = spark.createDataFrame([(a, b, 1) for a, b in rows], "doc_id long, text string, fp int")
    got = H.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    prints = [(i, H.fingerprint(t)) for i, t in rows if i is not None]
    root = {i: i for i, _ in prints}
    for _ in prints:
        for i, x in prints:
            for j, y in prints:
                if ((x ^ y) % (1 << 64)).bit_count() <= 3:
                    root[i] = root[j] = min(root[i], root[j])
    assert {(x["doc_id"], x["component_id"]) for x in got if x["doc_id"] is not None} == set(root.items())
    kept = H.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(x["doc_id"] for x in kept.collect() if x["doc_id"] is not None) == sorted(set(root.values()))
    assert kept.where("doc_id is null").count() == 1
    assert H.op7(docs.limit(0)).count() == 0
    assert {len(x["fingerprint"]) for x in H.op7(docs).collect()} == {16}


def plain_templates(lines):
    """The template of each of the different lines."""
    tokens = {x: ["<*>" if re.search("[0-9]", t) else t for t in re.findall(WORD, x)] for x in lines}
    leaf = {x: (len(t), *t[: L.DEPTH]) for x, t in tokens.items()}
    often = Counter((leaf[x], i, w) for x, t in tokens.items() for i, w in enumerate(t) if i >= L.DEPTH and w != "<*>")
    out = {}
    for x, t in tokens.items():
        at = [(i, w, often[leaf[x], i, w]) for i, w in enumerate(t) if i >= L.DEPTH and w != "<*>"]
        middle = sorted(c for _, _, c in at)[(len(at) - 1) // 2] if at else 0
        kept = [(i, w) for i, w, c in at if c > 1 and 2 * c >= middle]
        words, fields = len(at) - len(kept), t.count("<*>")
        out[x] = (leaf[x], tuple(kept)) if 4 * words <= len(t) and 2 * (words + fields) <= len(t) else x
    return out


def plain_lines(rows):
    where = defaultdict(set)
    for i, t in rows:
        if i is not None and t is not None:
            for line in t.split("\n"):
                if re.search(WORD, line):
                    where[line].add(i)
    template = plain_templates(where)
    first, last = {}, {}
    for line, ids in where.items():
        k = template[line]
        first[k], last[k] = min(first.get(k, min(ids)), min(ids)), max(last.get(k, max(ids)), max(ids))
    gone = lambda x, i: x in template and first[template[x]] < i
    return [(i, t) if i is None or t is None else (i, "\n".join(x for x in t.split("\n") if not gone(x, i))) for i, t in rows]


def test_line_templates(spark):
    r = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta", "7", "x9y", "end."]
    pool = [" ".join(r.choice(words) for _ in range(r.randrange(1, 14))) for _ in range(40)] + ["", "  ", "\tuser 12 logged in from 10.0.0.1 at 9 pm today"]
    rows = [(i, "\n".join(r.choice(pool) for _ in range(r.randrange(6)))) for i in range(60)]
    rows += [(None, pool[0]), (70, None), (71, "user 99 logged in from 10.1.1.1 at 8 pm today\r"), (3, rows[3][1]), (72, ""), (73, "one line " * 40_000 + "\n7\n\n7")]
    docs = spark.createDataFrame([(a, b, 5, 7, "x") for a, b in rows], "doc_id long, text string, N_lines int, leaf int, `a.b` string")
    got = L.dedup_lines(docs)
    assert sorted(map(str, ((x["doc_id"], x["text"]) for x in got.collect()))) == sorted(map(str, plain_lines(rows)))
    assert got.columns == ["doc_id", "text", "leaf", "a.b", "n_lines", "n_dropped"]
    same = L.without_lines(docs)
    assert same.columns == docs.columns and {x["N_lines"] for x in same.collect()} == {5}
    assert L.op10(docs.limit(0)).count() == 0


def test_fields_vary(spark):
    a = "the quick brown fox jumps over the lazy dog near the old red barn"
    b = a.replace("lazy", "sleepy").replace("barn", "house").replace("brown", "grey")
    c = "the quick green ant walks under a busy cat far from my new blue house"
    rows = [(1, a), (2, b), (3, c), (4, "x\ny z 3"), (5, "x\ny z 4"), (6, "u v w q"), (7, "u v w r"), (8, "1 2 3"), (9, "4 5 6"), (10, "go to my home"), (11, "go to his house")]
    out = dict(L.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "text").collect())
    assert out == dict(rows) | {2: "", 5: "", 7: ""}


def test_salted_leaves(spark, monkeypatch):
    """A leaf that a third of all lines share."""
    monkeypatch.setattr(L, "SALTED", 3)
    rows = [(i, f"the server a{i // 2} sent all data to host\nown line w{i} here") for i in range(60)] + [(i, f"some other text of doc k{i}") for i in range(60, 90)]
    rows = [(i, re.sub("[0-9]+", lambda m: "abcdefghij"[int(m[0]) % 10] + "klmnopqrst"[int(m[0]) // 10], t)) for i, t in rows]
    got = L.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "text").collect()
    assert sorted(map(tuple, got)) == sorted(plain_lines(rows))
    assert sum("server" in x["text"] for x in got) == 1


def words_of(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))


def plain_hits(text, items, width=10):
    words, hit, who = words_of(text), set(), set()
    for item, t in items:
        w = words_of(t)
        for k in range(max(1, len(w) - width + 1)) if w and item is not None else ():
            window = w[k : k + width]
            for at in range(len(words) - len(window) + 1):
                if words[at : at + len(window)] == window:
                    hit |= set(range(at, at + len(window)))
                    who.add(str(item))
    return len(words), len(hit), len(who), hashlib.sha256(",".join(sorted(who)).encode()).hexdigest(), bool(hit)


def test_decontamination(spark, monkeypatch):
    r = random.Random(6)
    vocabulary = ["a", "b", "c", "É", "d1", "the"]
    make = lambda n: "".join(r.choice(vocabulary) + r.choice([" ", ", ", "\n", " ", "-"]) for _ in range(n))
    items = [(i, make(r.randrange(1, 25))) for i in range(3, 14)] + [(20, None), (21, ""), (22, "--"), (None, "the the the the the"), (2, "Rare, words")]
    items.append((100, items[0][1]))
    rows = [(i, make(r.randrange(0, 80))) for i in range(60)] + [(61, None), (62, "x " + items[1][1].upper() + " y"), (62, "rare-words rare WORDS"), (None, items[2][1]), (63, " ".join(f"q{i % 7}" for i in range(60_000)) + " " + items[3][1])]
    docs = spark.createDataFrame([(a, b, "n", 1, 2) for a, b in rows], "doc_id long, text string, N_words string, k1 int, `a.b` int")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    names = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    want = sorted(str((i, *plain_hits(t, items))) for i, t in rows)
    assert sorted(str((x["doc_id"], *(x[n] for n in names))) for x in D.op5(docs, benchmark).collect()) == want
    out = D.contaminated(docs, benchmark)
    assert out.columns == ["doc_id", "text", "k1", "a.b", "n_words", "hit_spans", "items"]
    for x in out.where("doc_id < 63").collect():
        hit = {i for a, b in zip(x["hit_spans"][::2], x["hit_spans"][1::2], strict=True) for i in range(a, b)}
        assert len(hit) == plain_hits(x["text"], items)[1] and x["items"] == sorted(x["items"])
    monkeypatch.setattr(B, "FILTER_BITS", 8)  # a filter that is full
    kept = D.clean(docs, benchmark)
    assert kept.columns == docs.columns and sorted(str(x["doc_id"]) for x in kept.collect()) == sorted(str(i) for i, t in rows if not plain_hits(t, items)[4])
    assert all(x["N_words"] == "n" for x in kept.collect())
    assert D.op5(docs, benchmark.limit(0)).where("contaminated").count() == 0
    assert D.op5(docs.limit(0), benchmark).count() == 0


def test_lines_without_a_template_go_no_further(spark, monkeypatch):
    """Lines alone in their leaf recur by their own documents; only those with a template are matched by it."""
    kept = {}
    write = L.cut_table
    monkeypatch.setattr(L, "cut_table", lambda df, name: kept.setdefault(name, write(df, name)))
    docs = spark.createDataFrame([(1, "one lone line\nx y z a b c d 1"), (2, "x y z a b c d 2\nshared words here again"), (3, "shared words here again\nanother")], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in L.op10(docs).collect()}
    assert got == {1: "one lone line\nx y z a b c d 1", 2: "shared words here again", 3: "another"}
    assert kept["templates"].count() == 2 < kept["distinct"].count()
