"""Repaired conversations against every edit of short ones, and a plain dynamic programme."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

from graphloom.llm import conversation_repair as C

SCHEMA = "conv_id long, turn long, role string, text string"
GRAMMAR = re.compile("(s?(ua)+)?")


def hurt(rows):
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        show = lambda x: " " if x is None else str(x)
        n = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
        role, text = show(role), show(text)
        out[conv] = out[conv]
        if n == 1:
            text = ""
        if n == 2:
            text = re.sub("[.!?]", "", text)
        if n == 4:
            role = "user"
        if n:
            out[conv] += [(turn, role, text)] * (2 if n == 3 else 1)
    return {c: sorted(r, key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode())) for c, r in out.items()}


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        inner = text.strip(" \t\n\x0b\x0c\r")
        out.append("blank" if not inner else "duplicate" if (role, text) in seen else "truncated" if inner[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def plain(rows, fault):
    """Least (cost, audit, repaired) by states that carry whole audits."""
    follow = {"": "su", "s": "u", "u": "a", "a": "u"}
    best = {"": (0, "", [])}

    def inserted(best):
        for _ in range(2):
            new = dict(best)
            for p, (c, a, t) in best.items():
                x = "a" if p == "u" else "u"
                new[x] = min(new.get(x, (1 << 60, "", [])), (c + 5, a + "I", [*t, f"{C.ROLES[x]}:"]))
            best = new
        return best

    for (_, role, text), f in zip(rows, fault, strict=True):
        new = {}

        def offer(q, x, new=new):
            if q not in new or x < new[q]:
                new[q] = x

        for p, (c, a, t) in inserted(best).items():
            offer(p, (c + 2, a + "D", t))
            if f in ("blank", "duplicate"):
                continue
            c += 5 if f == "truncated" else 0
            for x in follow[p]:
                if x == role[:1]:
                    offer(x, (c, a + "K", [*t, f"{role}:{text}"]))
                elif x != "s":
                    offer(x, (c + 1, a + "R", [*t, f"{C.ROLES[x]}:{text}"]))
        best = new
    return min(v for p, v in inserted(best).items() if p in ("", "a"))


def every(rows, fault):
    """The same by trying all edits of a few turns, with up to two insertions at each place."""
    best = None
    for letters in itertools.product("DKR", repeat=len(rows)):
        for gaps in itertools.product(range(3), repeat=len(rows) + 1):
            audit = "".join("I" * g + x for g, x in zip(gaps, (*letters, ""), strict=True))
            cost = 5 * sum(gaps)
            outs = [[]]
            for g, x, (row, f) in zip(gaps, (*letters, ""), [*zip(rows, fault, strict=True), (None, None)], strict=True):
                outs = [[*o, *(f"{C.ROLES[y]}:" for y in ys)] for o in outs for ys in itertools.product("ua", repeat=g)]
                if x == "":
                    continue
                cost += {"D": 2, "K": 0, "R": 1}[x] + (5 if f == "truncated" and x != "D" else 0)
                if x != "D" and f in ("blank", "duplicate"):
                    cost += 1000
                if x == "K":
                    outs = [[*o, f"{row[1]}:{row[2]}"] for o in outs]
                elif x == "R":
                    outs = [[*o, f"{y}:{row[2]}"] for o in outs for y in C.ROLES.values()]
            for o in outs:
                if GRAMMAR.fullmatch("".join(y[:1] or "-" for y in o)) and (best is None or (cost, audit) < best[:2]):
                    best = (cost, audit, o)
    return best


def wanted(rows):
    out = []
    for conv, own in hurt(rows).items():
        f = faults(own)
        cost, audit, text = plain(own, f)
        turns = [x[0] for x in own if x[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        out.append((str(conv), gaps, f.count("blank"), f.count("duplicate"), f.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(text).encode()).hexdigest()))
    return sorted(out)


def ours(spark, rows, parts=3):
    found = C.op13(spark.createDataFrame(rows, SCHEMA).repartition(parts)).collect()
    return sorted((str(r["conv_id"]), *(r[c] for c in C.COUNTS), r["audit"], r["repaired_sha256"]) for r in found)


def test_the_plain_programme_is_least():
    r = random.Random(3)
    for _ in range(60):
        own = [(i, r.choice(["system", "user", "assistant", "tool", ""]), r.choice(["Yes.", "No", "", "Why?"])) for i in range(r.randrange(4))]
        f = faults(own)
        assert plain(own, f) == every(own, f), own


def test_conversations(spark):
    r = random.Random(4)
    texts = ["Yes.", "No way", " ", "", "Why?\n", "é!", "A. b", "x" * 3000 + ".", None, "\x1f"]
    rows = []
    for conv in [*range(70), None]:
        for t in range(r.randrange(12)):
            turn = r.choice([t, t, t, t + r.randrange(3), None])
            rows.append((conv, turn, r.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None, "sys"]), r.choice(texts)))
    rows += rows[:20]
    assert ours(spark, rows) == wanted(rows)


def test_long_conversations(spark):
    """One conversation has most of the turns, so it is many segments on several levels."""
    r = random.Random(5)
    long = [(7, t, r.choice(["user", "assistant"]), r.choice(["Yes.", "No", "Why?", f"{t}."])) for t in range(9000)]
    rows = long + [(8, t, "user" if t % 2 else "assistant", f"{t}!") for t in range(300)] + [(c, 0, "user", "Hi.") for c in range(20, 30)]
    r.shuffle(rows)
    assert ours(spark, rows, 5) == wanted(rows)


def test_nothing(spark):
    assert ours(spark, []) == []
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    assert ours(spark, [(gone, 0, "user", "Hi.")]) == [(str(gone), 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())]
